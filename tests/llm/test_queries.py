"""The corpus queries against their DuckDB statements, and the columns of the others."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from palisade.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
COLUMNS = {
    "op4_mix_to_weights": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op11_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.mark.parametrize("name", sorted(Q.CHECKS))
def test_query_equals_its_check(spark, name):
    from compare import check, duck
    state, _, note = check(spark, duck(SF), name, SF)
    assert state == "ok", note


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_agreed_columns_over_all_rows(spark, name):
    out = Q.QUERIES[name](spark, SF)
    table = "pages" if name.startswith("op7") else "documents"
    assert out.columns[:len(COLUMNS[name])] == COLUMNS[name]
    assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_every_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in Q.QUERIES if n != "pipeline"]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in Q.QUERIES and set(Q.CHECKS) <= set(Q.QUERIES)
