"""Document fingerprints: Merkle trees over sections, paragraphs and sentences, written as strings and compared as strings.

Sections end at blank lines, paragraphs at line ends, sentences behind a full stop, question or exclamation mark and a blank. A
node's hash covers the hashes below it, so equal roots mean equal texts, and a differing branch shows where an edit lies. All of it
is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_MARK = "\u0001"  # set behind each sentence before the split; one that the text holds itself cannot make two texts alike


def _short(kind: str, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(kind), text), 256), 1, 16)


def fingerprint(text: Column) -> Column:
    """``root|section|...``; a section is paragraphs joined by ``;``, a paragraph its sentences' hashes joined by ``,``. Null counts as empty.

    The root is a SHA-256 in hex; a sentence has the first 16 digits of one, an empty sentence nothing.
    """
    sentences = lambda p: F.split(F.regexp_replace(p, "([.!?][ \\t])", f"$1{_MARK}"), _MARK, -1)
    leaf = lambda x: F.when(x == "", F.lit("")).otherwise(_short("l", x))
    tree = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1),
                       lambda s: F.array_join(F.transform(F.split(s, "\n", -1), lambda p: F.array_join(F.transform(sentences(p), leaf), ",")), ";"))
    return F.concat(root(tree), F.lit("|"), F.array_join(tree, "|"))


def root(tree: Column) -> Column:
    """The root of a tree given as an array of sections, each written as in the fingerprint."""
    section = lambda s: _short("s", F.array_join(F.transform(F.split(s, ";", -1), lambda p: _short("p", p)), ";"))
    return F.sha2(F.concat(F.lit("r"), F.array_join(F.transform(tree, section), "|")), 256)


def leaves(mark: Column) -> Column:
    """Different sentence hashes of a fingerprint."""
    return F.array_distinct(F.filter(F.split(F.substring(mark, 66, 1 << 30), "[|;,]", -1), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 for equal roots, else twice the different sentences in common over those of both trees."""
    one, two = leaves(a), leaves(b)
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    both = (F.size(one) + F.size(two)).cast("double")
    return F.when(same, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(one, two)), both), F.lit(0.0)))


def edits(a: Column, b: Column) -> Column:
    """Places ``(section, paragraph)``, from 0, at which two fingerprints differ; equal sections are not opened."""
    parts = lambda x: F.split(F.substring(x, 66, 1 << 30), "\\|", -1)
    lines = lambda s: F.split(F.coalesce(s, F.lit("")), ";", -1)
    numbered = lambda x: F.transform(x, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    sections = F.zip_with(parts(a), parts(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    opened = F.filter(numbered(sections), lambda s: ~s["v"]["x"].eqNullSafe(s["v"]["y"]))
    places = F.transform(opened, lambda s: F.transform(
        F.filter(numbered(F.zip_with(lines(s["v"]["x"]), lines(s["v"]["y"]), lambda x, y: ~x.eqNullSafe(y))), lambda p: p["v"]),
        lambda p: F.struct(s["i"].alias("section"), p["i"].alias("paragraph"))))
    return F.flatten(places)


def _pieces(docs: DataFrame, rows_each: int, most: int) -> tuple[Column, int]:
    """A column that cuts the rows into ranges of doc_id, in order, and the number of ranges. Rows without id are range 0.

    Quantiles (at most 128 numbers) make the coarse ranges, equal widths the finer ones; the balance does not change results.
    """
    n = docs.count()
    wanted = max(1, min(most, n // rows_each))
    cuts = min(128, wanted)
    found = docs.filter("doc_id is not null").approxQuantile("doc_id", [i / cuts for i in range(cuts + 1)], 0.0005) if n else []
    ends = sorted({int(x) for x in found})
    if len(ends) < 2:
        return F.when(F.col("doc_id").isNull(), 0).otherwise(1), 2
    finer = -(-wanted // (len(ends) - 1))
    low = F.array(*(F.lit(x).cast("long") for x in ends))
    coarse = F.greatest(F.lit(1), F.least(F.lit(len(ends) - 1), F.size(F.filter(low, lambda x: x <= F.col("doc_id")))))
    begin, end = F.element_at(low, coarse), F.element_at(low, coarse + 1)
    within = F.floor((F.col("doc_id") - begin).cast("double") / (end - begin).cast("double") * finer)
    fine = F.greatest(F.lit(0), F.least(F.lit(finer - 1), within)).cast("int")
    return F.when(F.col("doc_id").isNull(), 0).otherwise((coarse - 1) * finer + fine + 1), (len(ends) - 1) * finer + 1


def with_next(docs: DataFrame, rows_each: int = 1024, most: int = 65536) -> DataFrame:
    """``docs(doc_id, text)`` with ``next_text``: the text of the next row by descending doc_id (nulls last), after the last of the first.

    Rows meet their neighbours in ranges of doc_id. The first row of the next range that has rows joins each range as a guest behind its
    last row, so whole texts are shuffled once. The table of ranges has at most ``most`` narrow rows, that of guests a row a range.
    """
    piece, _ = _pieces(docs, rows_each, most)
    cut = docs.select("doc_id", "text", piece.cast("int").alias("piece"))
    order = (F.desc_nulls_last("doc_id"), "text")
    down = Window.orderBy(F.desc("piece"))
    follows = cut.select("piece").distinct().select("piece", F.coalesce(F.lead("piece").over(down), F.max("piece").over(Window.partitionBy())).alias("follower"))
    first = cut.withColumn("rn", F.row_number().over(Window.partitionBy("piece").orderBy(*order))).filter("rn = 1")
    guests = follows.join(first.select(F.col("piece").alias("follower"), "text"), "follower").select(
        F.lit(None).cast("long").alias("doc_id"), "text", "piece", F.lit(1).alias("guest"))
    rows = cut.withColumn("guest", F.lit(0)).unionByName(guests)
    follow = F.lead("text").over(Window.partitionBy("piece").orderBy("guest", *order))
    return rows.withColumn("next_text", follow).filter("guest = 0").select("doc_id", "text", "next_text")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``docs(doc_id, text, ...)``.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's, by descending
    doc_id. A null text is empty, and two empty texts have likeness 1. Rows that share a doc_id follow each other by text; rows without one
    come last. An empty table gives no rows; other columns are not looked at.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(plain).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next_text").substr(F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"),
                       fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("next_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
