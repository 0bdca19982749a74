"""Chat formatting: the hash of a record's nested field paths selects a declarative mapping to canonical turns; a template renders them.

Records are JSON texts of any layout. The fingerprint sees names and nesting only, not values: two records with the same field
paths have the same one. Mappings are data, so a new layout needs no code. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping as Dict, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_TURNS = "array<struct<role:string,text:string>>"
_STRING = r"""\"(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+\""""  # a JSON string
_VALUE = rf"""\G([^"]*+(?:{_STRING}\s*+:[^"]*+)*+){_STRING}"""  # names and signs from the last match on, then a string that is no name
_LONGEST = str((1 << 31) - 1)


@dataclass(frozen=True)
class Layout:
    """How records with certain field paths become turns.

    Paths look like ``messages[].role``. Either ``each`` names an array with the fields ``role`` and ``text`` of its elements, or ``fixed``
    lists (role, path) of single turns; a fixed turn whose text is null or empty is left out if its path ends in ``?``. ``roles`` renames roles.
    """

    name: str
    each: str = ""
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, str], ...] = ()
    more: tuple[str, ...] = ()  # fields that are there but say nothing of the turns
    roles: Dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> list[str]:
        own = [f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"] if self.each else [p.rstrip("?") for _, p in self.fixed]
        return sorted({*own, *self.more})


LAYOUTS = (
    Layout("messages", each="messages"),
    Layout("from-value", each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("dialog", each="data.dialog", role="speaker", text="utterance"),
    Layout("prompt-response", fixed=(("user", "prompt"), ("assistant", "response"))),
    Layout("system-prompt-completion", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction-output", fixed=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction-input-output", fixed=(("system", "instruction"), ("user", "input?"), ("assistant", "output"))),
)


def shape(paths: Sequence[str]) -> str:
    """The canonical text of a set of nested field paths, as ``record_shape`` writes it for a record."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.replace("[]", ".[]").split("."):
            at = at.setdefault(part, {})

    def written(node: dict) -> str:
        if not node:
            return "V"
        if "[]" in node:
            return f"ARRAY<{written(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {written(node[k])}" for k in sorted(node)) + ">"
    return written(tree)


def record_shape(record: Column) -> Column:
    """Names and nesting of a JSON text, with every kind of value written as V; null for texts that are not JSON.

    Strings are emptied before the text is parsed, so their length does not matter; what is left must fit a variant (128 MiB, some
    million turns), else the shape is null.
    """
    kinds = F.schema_of_variant(F.try_parse_json(F.regexp_replace(record, _VALUE, '$1""')))
    return F.regexp_replace(kinds, r"(?<=: |ARRAY<|^)(?!OBJECT<|ARRAY<)[A-Z_]+(?:\(\d+,\s*\d+\))?(?=[,>]|$)", "V")


def schema_hash(shaped: Column) -> Column:
    return F.substring(F.sha2(shaped, 256), 1, 16)


def _ddl(paths: Sequence[str]) -> str:
    """The Spark schema that reads the paths from JSON."""
    return shape(paths).replace("OBJECT<", "STRUCT<").replace(": V", ": STRING").replace("ARRAY<V>", "ARRAY<STRING>")


def _turns(record: Column, layout: Layout) -> Column:
    read = F.from_json(record, _ddl(layout.paths), {"maxStringLen": _LONGEST})
    reach = lambda path: _reach(read, path)
    empty = F.lit("")
    if layout.each:
        turns = F.transform(reach(layout.each), lambda t: F.struct(F.coalesce(t[layout.role], empty).alias("role"), F.coalesce(t[layout.text], empty).alias("text")))
    else:
        one = lambda role, path: F.struct(F.lit(role).alias("role"), F.coalesce(reach(path.rstrip("?")), empty).alias("text"))
        turns = F.array(*(one(r, p) for r, p in layout.fixed))
        optional = [r for r, p in layout.fixed if p.endswith("?")]
        turns = F.filter(turns, lambda t: ~(t["role"].isin(optional) & (t["text"] == ""))) if optional else turns
    if layout.roles:
        names = F.create_map(*(F.lit(x) for pair in layout.roles.items() for x in pair))
        turns = F.transform(turns, lambda t: F.struct(F.coalesce(names[t["role"]], t["role"]).alias("role"), t["text"].alias("text")))
    return turns.cast(_TURNS)


def _reach(at: Column, path: str) -> Column:
    for part in path.split("."):
        at = at[part]
    return at


def canonical(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Add ``layout`` and ``turns`` (role, text) to ``records(..., record)``.

    The fingerprint of each record's field paths picks the layout; records of unknown layout, null records and texts that are not
    JSON have null in both. An empty array has no fields below it, so a layout's shape with an empty array is known too.
    Texts of any length are read whole; a record is one row, so Spark's 2 GiB for a row bound it.
    """
    mark = schema_hash(record_shape(F.col("record")))
    marked = records.withColumn("_mark", mark)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for layout in layouts:
        shapes = [shape(layout.paths)]
        if layout.each:
            shapes.append(shape([f"{layout.each}[]", *layout.more]))
        hit = F.lit(False)
        for s in shapes:
            hit = hit | (F.col("_mark") == schema_hash(F.lit(s)))
        name = F.when(hit, F.lit(layout.name)).otherwise(name)
        turns = F.when(hit, _turns(F.col("record"), layout)).otherwise(turns)
    return marked.withColumns({"layout": name, "turns": turns}).drop("_mark")


def escaped(text: Column) -> Column:
    """No control string can begin in the result: a backslash goes behind each ``<`` that ``|`` or a backslash follows."""
    return F.regexp_replace(text, r"<([\\|])", r"<\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\([\\|])", "<$1")


def _role(role: Column) -> Column:
    """Roles stand on a line of their own."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    lines = lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(unescaped(role), r"\\\\", -1), lines), "\\")


def rendered(records: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and ``mask`` for ``turns``: each turn is ``<|im_start|>role``, a line end, the escaped text and ``<|im_end|>``, a line end.

    ``mask`` has an entry for each turn: the turn's length in code points, where in it the part to learn starts, and how long that is
    (0 for roles that are not learnt). Entries lie end to end, so no running sums are needed. Null turns give nulls, no turns an empty text.
    """
    head = lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"))
    whole = lambda t: F.concat(head(t), escaped(t["text"]), F.lit(END))
    size = lambda x: F.length(x).cast("long")
    mask = F.transform("turns", lambda t: F.struct(
        size(whole(t)).alias("length"), size(head(t)).alias("start"),
        F.when(t["role"].isin(*learn), size(escaped(t["text"]))).otherwise(F.lit(0).cast("long")).alias("learn")))
    return records.withColumns({"formatted": F.array_join(F.transform("turns", whole), ""), "mask": mask})


def read_back(rows: DataFrame) -> DataFrame:
    """Add ``read`` (role, text of each turn) and ``loss_text`` from ``formatted`` and ``mask`` alone."""
    start = START.replace("|", "\\|")
    chunks = F.filter(F.split("formatted", start, -1), lambda c, i: i > 0)
    turn = lambda c: F.struct(_role_back(F.substring_index(c, "\n", 1)).alias("role"),
                              unescaped(c.substr(F.length(F.substring_index(c, "\n", 1)) + 2,
                                                 F.length(c) - F.length(F.substring_index(c, "\n", 1)) - 1 - len(END))).alias("text"))
    learnt = F.zip_with(chunks, F.col("mask"), lambda c, m: unescaped(c.substr((m["start"] - len(START) + 1).cast("int"), m["learn"].cast("int"))))
    return rows.withColumns({"read": F.transform(chunks, turn), "loss_text": F.array_join(learnt, "")})


def conversation_records(turns: DataFrame) -> DataFrame:
    """``conv_id, record`` of ``turns(conv_id, turn, role, text)``: one JSON text for each conversation, in the layout that its roles suit.

    Turns are ordered by number, then role and text, nulls first; null roles and texts are empty. A conversation is one record, so
    its turns meet in one task. Rows without conv_id are one conversation, and so are all rows of a repeated one.
    """
    empty = F.lit("")
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text = lambda i: F.col("t")[i]["text"]
    known = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    human = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    listed = lambda role, body, rename: F.transform("t", lambda x: F.struct(rename(x["role"]).alias(role), x["text"].alias(body)))
    same = lambda r: r
    record = (F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
              .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
                    F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("completion"))))
              .when(known & (F.size("t") % 2 == 0), F.to_json(F.struct(listed("from", "value", human).alias("conversations"))))
              .when(F.size("t") % 3 == 0, F.to_json(F.struct(F.struct(listed("speaker", "utterance", same).alias("dialog")).alias("data"))))
              .otherwise(F.to_json(F.struct(listed("role", "content", same).alias("messages")))))
    return gathered.select("conv_id", record.alias("record"))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the rendered conversations."""
    rows = read_back(rendered(canonical(conversation_records(turns))))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
