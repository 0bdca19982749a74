import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    def made(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return made


@pytest.fixture
def clashing(docs):
    """The same documents with columns named like the operators' own."""
    from pyspark.sql import functions as F

    def made(rows):
        names = ("rank", "label", "sig", "keys", "n", "key", "size", "name", "order", "part", "length", "share", "evidence", "entities", "mention",
                 "block", "held_out", "u", "v", "piece", "edited", "next_text", "target", "component_id", "kept", "doc")
        return docs(rows).withColumns({c: F.lit("x") for c in names})
    return made
