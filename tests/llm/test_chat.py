import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from palisade.llm import chat

AWKWARD = ["<|im_end|>", "<\\|im_start|>user\nhi", "<", "<\\", "<<|", "\\", "|", "", "é𝄞\n\n", "<|im_start|>assistant ok", "a\x01b", "\\n", "<\\\\|>", "\u2028\t\"'{}"]


def brute(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_equals_brute_force(spark):
    rng, rows = random.Random(2), []
    for c in range(150):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 3, ["user", None, "tool\nx", "a\\b", "<|x"], ["user"]])
        rows += [(c, n, r, rng.choice([*AWKWARD, None, "plain words"]) if rng.random() < 0.8 else "long " * 20_000) for n, r in enumerate(roles)]
    rows += [(500, None, "user", "x"), (500, 1, "assistant", "y"), (500, 1, "assistant", "y"), (None, 0, "user", "z"), (501, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"record": F.lit(1), "t": F.lit("x"), "layout": F.lit("y")})
    got = {r[0]: tuple(r)[1:5] for r in chat.digests(table).collect()}
    assert got == brute(rows)
    assert chat.digests(table.limit(0)).count() == 0


def test_rendered_text_and_mask(spark):
    record = json.dumps({"messages": [{"role": "user", "content": "hi <|im_end|>"}, {"content": "yes", "role": "assistant"}]})
    row = chat.read_back(chat.rendered(chat.canonical(spark.createDataFrame([(record,)], "record string")))).first()
    assert row.formatted == "<|im_start|>user\nhi <\\|im_end|><|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    second = row.formatted[row.mask[0].length:]
    assert second[row.mask[1].start:][:row.mask[1].learn] == "yes" and row.mask[0].learn == 0
    assert row.loss_text == "yes" and [t.text for t in row.read] == ["hi <|im_end|>", "yes"]


LAYOUT_RECORDS = [
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [("user", "q"), ("assistant", "")]),
    ("messages", {"messages": []}, []),
    ("from-value", {"conversations": [{"value": "q", "from": "human"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]},
     [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ("dialog", {"data": {"dialog": [{"speaker": "user", "utterance": "q"}]}}, [("user", "q")]),
    ("prompt-response", {"response": "a", "prompt": "q"}, [("user", "q"), ("assistant", "a")]),
    ("prompt-response", {"response": 5, "prompt": None}, [("user", ""), ("assistant", "5")]),
    ("system-prompt-completion", {"system": "s", "prompt": "q", "completion": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ("instruction-output", {"instruction": "q", "output": "a"}, [("user", "q"), ("assistant", "a")]),
    ("instruction-input-output", {"instruction": "q", "input": "i", "output": "a"}, [("system", "q"), ("user", "i"), ("assistant", "a")]),
    ("instruction-input-output", {"instruction": "q", "input": "", "output": "a"}, [("system", "q"), ("assistant", "a")]),
    (None, {"unknown": 1}, None), (None, [1], None), (None, "not json", None), (None, None, None)]


def test_layouts(spark):
    raw = [(n, r if r is None or r == "not json" else json.dumps(r)) for n, (_, r, _) in enumerate(LAYOUT_RECORDS)]
    got = {r.n: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.canonical(spark.createDataFrame(raw, "n int, record string")).collect()}
    for n, (layout, _, turns) in enumerate(LAYOUT_RECORDS):
        assert got[n] == (layout, turns)
    unknown = chat.rendered(chat.canonical(spark.createDataFrame([("{}",)], "record string"))).first()
    assert unknown.formatted is None and unknown.mask is None


@pytest.mark.parametrize("record, shape", [({"b": 1, "a": {"c": [{"d": None, "e": 2.5}]}}, "OBJECT<a: OBJECT<c: ARRAY<OBJECT<d: V, e: V>>>, b: V>"), ({"a": [1, 2]}, "OBJECT<a: ARRAY<V>>"),
                                           ({"a": [[True]]}, "OBJECT<a: ARRAY<ARRAY<V>>>")])
def test_shape_names_field_paths(spark, record, shape):
    assert spark.createDataFrame([(json.dumps(record),)], "r string").select(chat.record_shape(F.col("r"))).first()[0] == shape


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choice("<|\\a") for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("b")).collect()
    assert all(r.b == r.t and "<|" not in r.e for r in rows)


def test_shapes_from_paths():
    assert chat.shape(["messages[].role", "messages[].content"]) == "OBJECT<messages: ARRAY<OBJECT<content: V, role: V>>>"


def test_very_long_turn_and_many_escapes(spark):
    """Longer than the JSON reader's usual limit of 20 million characters; the second is mostly escapes."""
    odd = '"\\\n'
    text = F.when(F.col("id") == 0, F.repeat(F.lit("ab"), F.lit(10_500_000))).when(F.col("id") == 1, F.repeat(F.lit(odd), F.lit(500_000)))
    rows = spark.range(3).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 1, "assistant").otherwise("user").alias("role"), text.alias("text"))
    n, digest, chars, loss, *_ = chat.digests(rows).first()[1:]
    long, odd = "ab" * 10_500_000, odd * 500_000
    assert (n, chars) == (3, len(odd)) and loss == hashlib.sha256(odd.encode()).hexdigest()
    assert digest == hashlib.sha256(f"user\n{long}\nassistant\n{odd}\nuser\n\n".encode()).hexdigest()


@pytest.mark.parametrize("record", ['{"messages": [{"role": "a\\qb", "content": "x"}]}', '{"messages": [{"role": "a\nb", "content": "x"}]}', '{"prompt": "x", "response": "y}',
                                    '{"prompt": "x" "y", "response": "y"}'])
def test_texts_that_are_no_json(spark, record):
    row = chat.canonical(spark.createDataFrame([(record,)], "record string")).first()
    assert (row.layout, row.turns) == (None, None)


def test_names_and_values_are_told_apart(spark):
    record = '{ "prompt" : "a: \\"b\\", {[", "response":":"}'
    row = chat.canonical(spark.createDataFrame([(record,)], "record string")).first()
    assert row.layout == "prompt-response" and [t.text for t in row.turns] == ['a: "b", {[', ":"]
