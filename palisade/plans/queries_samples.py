"""Queries on sample metadata, splits and quality figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import profiling as P
from ..operators import quality as Q
from ..operators import splits as S
from ..session import durable
from . import views as V
from .checks import over
from .registry import query


def _pct(column: str, where: str = "TRUE") -> str:
    return over("samples", f"""SELECT {column}, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM samples
      WHERE {where} AND {column} IS NOT NULL), 2) AS pct FROM samples WHERE {where} AND {column} IS NOT NULL GROUP BY {column}""")


@query("value_counts_pct", _pct("sample_type"))
def value_counts_pct(spark, sf):
    return P.value_counts_pct(V.samples(spark, sf), "sample_type")


@query("value_counts_type", _pct("ransomware_type", "sample_type = 1"))
def value_counts_type(spark, sf):
    return P.value_counts_pct(V.samples(spark, sf).filter("sample_type = 1"), "ransomware_type")


@query("value_counts_family", _pct("ransomware_family", "sample_type = 1"))
def value_counts_family(spark, sf):
    return P.value_counts_pct(V.samples(spark, sf).filter("sample_type = 1"), "ransomware_family")


@query("value_counts_source", _pct("source"))
def value_counts_source(spark, sf):
    return P.value_counts_pct(V.samples(spark, sf), "source")


SAMPLE_COLUMNS = ("sample_id", "sample_type", "source", "ransomware_family", "ransomware_type", "type_label", "submitted", "first_submission", "size")


@query("missing_profile", over("samples", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing,
    round(count(*) FILTER ({c} IS NULL) * 100 / count(*), 2) AS pct FROM samples""" for c in SAMPLE_COLUMNS)))
def missing_profile(spark, sf):
    return P.missing_profile(V.samples(spark, sf))


@query("year_type_crosstab", over("samples", """SELECT CAST(year(submitted) AS INTEGER) AS year, count(*) FILTER (sample_type = 0) AS sample_type_0,
  count(*) FILTER (sample_type = 1) AS sample_type_1 FROM samples WHERE submitted IS NOT NULL GROUP BY ALL"""))
def year_type_crosstab(spark, sf):
    return P.year_type_crosstab(V.samples(spark, sf), "submitted", "sample_type")


@query("year_range", over("samples", """SELECT CAST(min(year(submitted)) AS INTEGER) AS min_year,
  CAST(max(year(submitted)) AS INTEGER) AS max_year FROM samples"""))
def year_range(spark, sf):
    return P.year_range(V.samples(spark, sf), "submitted")


@query("year_bounds_null", over("samples", """SELECT sample_id, CASE WHEN year(submitted) > 1998 THEN NULL ELSE submitted END AS submitted,
  CASE WHEN year(submitted) > 1998 THEN NULL ELSE size END AS size FROM samples"""))
def year_bounds_null(spark, sf):
    rows = V.samples(spark, sf).select("sample_id", "submitted", "size")
    return P.year_bounds_null(rows, "submitted", ("size",), last_year=1998)


@query("missing_rows", over("samples", "SELECT sample_id, source FROM samples WHERE submitted IS NULL"))
def missing_rows(spark, sf):
    return P.missing_rows(V.samples(spark, sf), "submitted").select("sample_id", "source")


@query("mode_impute", over("samples", """
, fam AS (SELECT ransomware_family, submitted, count(*) AS n FROM samples WHERE submitted IS NOT NULL GROUP BY ALL),
fm AS (SELECT ransomware_family, submitted AS m FROM fam QUALIFY row_number() OVER (PARTITION BY ransomware_family
  ORDER BY n DESC, submitted) = 1),
src AS (SELECT source, submitted, count(*) AS n FROM samples WHERE submitted IS NOT NULL GROUP BY ALL),
sm AS (SELECT source, submitted AS m FROM src QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, submitted) = 1)
SELECT sample_id, coalesce(submitted, CASE sample_type WHEN 1 THEN fm.m ELSE sm.m END, DATE '2021-02-04') AS submitted
FROM samples LEFT JOIN fm USING (ransomware_family) LEFT JOIN sm USING (source)"""))
def mode_impute(spark, sf):
    return P.mode_impute(V.samples(spark, sf), "submitted").select("sample_id", "submitted")


@query("epoch_to_date", """SELECT o_orderkey AS sample_id, CAST(o_orderdate AS DATE) AS submitted FROM orders""")
def epoch_to_date(spark, sf):
    seconds = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")) * F.lit(86400) + F.col("o_orderkey") % 1000
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"),
                                               X.epoch_date(seconds.cast("string")).alias("submitted"))


@query("colon_date_parse", """SELECT o_orderkey AS sample_id,
  CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS submitted FROM orders""")
def colon_date_parse(spark, sf):
    day = F.col("o_orderdate").cast("date")
    epoch = (F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400).cast("string")
    text = (F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy:MM:dd"))
            .when(F.col("o_orderkey") % 5 < 3, epoch).when(F.col("o_orderkey") % 5 == 3, "00:00:00"))
    colon_first = F.col("o_orderkey") % 5 != 1
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"),
                                               P.parse_submission(text, colon_first).alias("submitted"))


@query("date_year", over("samples", "SELECT sample_id, CAST(year(submitted) AS INTEGER) AS year FROM samples"))
def date_year(spark, sf):
    return V.samples(spark, sf).select("sample_id", X.date_year(F.col("submitted")).alias("year"))


@query("timestamp_history_join", over("samples", """SELECT sample_id, coalesce(submitted, DATE '2021-02-04') AS submitted,
  submitted AS old_submitted FROM samples"""))
def timestamp_history_join(spark, sf):
    rows = V.samples(spark, sf).select("sample_id", "submitted")
    cleaned = rows.withColumn("submitted", F.coalesce("submitted", F.lit(P.DEFAULT_DATE).cast("date")))
    return P.timestamp_history(cleaned, rows, "sample_id", "submitted")


@query("class_test_quota", over("samples", """SELECT type_label, count(*) AS n, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS test,
  count(*) - CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS train FROM samples GROUP BY type_label"""))
def class_test_quota(spark, sf):
    return P.class_test_quota(V.samples(spark, sf), "type_label")


@query("family_type_map", over("samples", """SELECT ransomware_family, max_by(ransomware_type, sample_id) AS ransomware_type
  FROM samples GROUP BY ALL"""))
def family_type_map(spark, sf):
    return P.family_type_map(V.samples(spark, sf))


@query("goodware_join", """SELECT c_custkey AS sample_id, md5(c_name) AS md5, c_name AS title, n_name AS region_name,
  c_acctbal AS size FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'""")
def goodware_join(spark, sf):
    customers, nations = V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    md5 = F.md5(F.col("c_name").cast("binary")).alias("md5")
    description = customers.select(F.col("c_custkey").alias("sample_id"), md5, F.col("c_name").alias("title"))
    metadata = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("sample_id"), md5, F.lit("other title").alias("title"),
        F.col("n_name").alias("region_name"), F.col("c_acctbal").alias("size"),
        F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1).alias("sample_type"))
    return P.goodware_join(description, metadata).drop("sample_type")


@query("class_filter", over("samples", "SELECT sample_id, source FROM samples WHERE sample_type = 0"))
def class_filter(spark, sf):
    return V.samples(spark, sf).filter(F.col("sample_type") == 0).select("sample_id", "source")


# ---- splits ------------------------------------------------------------------------------------

TEMPORAL = """SELECT sample_id, {k}, CASE WHEN row_number() OVER (PARTITION BY {k} ORDER BY submitted DESC NULLS LAST, sample_id DESC)
  <= round_even(0.2 * count(*) OVER (PARTITION BY {k}), 0) THEN 'test' ELSE 'train' END AS split FROM samples"""


@query("temporal_split", over("samples", TEMPORAL.format(k="sample_type")))
def temporal_split(spark, sf):
    return S.temporal_split(V.samples(spark, sf), "sample_type", "submitted").select("sample_id", "sample_type", "split")


@query("temporal_split_by_type", over("samples", TEMPORAL.format(k="type_label")))
def temporal_split_by_type(spark, sf):
    return S.temporal_split(V.samples(spark, sf), "type_label", "submitted").select("sample_id", "type_label", "split")


@query("union_splits", over("samples", f""", t AS ({TEMPORAL.format(k="type_label")})
SELECT split, count(*) AS n, CAST(sum(type_label) AS BIGINT) AS label_sum FROM t GROUP BY split"""))
def union_splits(spark, sf):
    rows = S.temporal_split(V.samples(spark, sf), "type_label", "submitted").select("sample_id", "type_label", "split")
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    return train.unionByName(test).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("type_label").alias("label_sum"))


SPLIT = """, src AS (SELECT max(label) AS label, source FROM scored GROUP BY source),
ranked AS (SELECT label, source, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || source), source) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM src),
parts AS (SELECT *, CASE WHEN 2 * greatest(1, round_even(0.2 * n, 0)) >= n THEN 1 ELSE greatest(1, round_even(0.2 * n, 0)) END AS p FROM ranked),
assign AS (SELECT source, label, CASE WHEN rn <= p THEN 'test' WHEN rn <= 2 * p THEN 'validation' ELSE 'train' END AS split FROM parts)
"""


def _assigned(spark, sf):
    scored = V.scored(spark, sf)
    return scored, S.source_split(scored)


@query("source_split", over("scored", SPLIT + "SELECT * FROM assign"))
def source_split(spark, sf):
    return _assigned(spark, sf)[1]


@query("split_assignment_join", over("scored", SPLIT + "SELECT window_id, source, split FROM scored JOIN assign USING (source)"))
def split_assignment_join(spark, sf):
    return S.assign_split(*_assigned(spark, sf)).select("window_id", "source", "split")


@query("split_report", over("scored", SPLIT + """SELECT split, count(*) AS windows, count(DISTINCT source) AS sources,
  string_agg(DISTINCT 'set-' || scenario, ',' ORDER BY 'set-' || scenario) AS datasets, 'raw_sysmon' AS representations
  FROM scored JOIN assign USING (source) GROUP BY split"""))
def split_report(spark, sf):
    rows = S.assign_split(*_assigned(spark, sf)).withColumns({"dataset_source": F.concat(F.lit("set-"), "scenario"), "representation": F.lit("raw_sysmon")})
    return S.split_report(rows).withColumns({c: F.array_join(c, ",") for c in ("datasets", "representations")})


@query("leakage_check", over("scored", SPLIT + """SELECT source, count(DISTINCT split) AS splits FROM assign GROUP BY source
  HAVING count(DISTINCT split) > 1"""))
def leakage_check(spark, sf):
    return S.leakage(S.assign_split(*_assigned(spark, sf)))


@query("representation_guard", over("scored", """SELECT count(*) FILTER (label = 0) AS raw_rows, count(*) FILTER (label <> 0) AS proxy_rows,
  'mixed' AS verdict FROM scored"""))
def representation_guard(spark, sf):
    mixed = V.scored(spark, sf).withColumn("representation", F.when(F.col("label") == 0, "raw_sysmon").otherwise("embedded"))
    return S.representation_profile(mixed)


@query("label_guard", over("scored", """SELECT count(*) FILTER (label = 0) AS benign_rows, count(*) FILTER (label = 1) AS attack_rows,
  CAST(0 AS BIGINT) AS other_rows, TRUE AS valid FROM scored"""))
def label_guard(spark, sf):
    return S.label_profile(V.scored(spark, sf))


@query("distinct_scenarios", over("scored", "SELECT DISTINCT scenario FROM scored WHERE label = 1 ORDER BY scenario"))
def distinct_scenarios(spark, sf):
    return S.attack_scenarios(V.scored(spark, sf)).orderBy("scenario")


@query("benign_remainder_anti", over("scored", """, a AS (SELECT count(*) AS n FROM scored WHERE label = 1 AND scenario = 'scenario-1'),
b AS (SELECT window_id, row_number() OVER (ORDER BY md5('42|' || window_id), window_id) AS rn FROM scored WHERE label = 0)
SELECT window_id FROM b, a WHERE rn > greatest(a.n, 500)"""))
def benign_remainder_anti(spark, sf):
    windows = durable(V.lineage(spark, sf).select("window_id", "label", "scenario"))  # counted, ranked and joined below
    test = S.holdout_assignment(windows, "scenario-1", "window_id").filter("part = 'test'")
    benign = windows.filter("label = 0").select("window_id")
    return benign.join(test.select("window_id"), "window_id", "left_anti")


# ---- quality -----------------------------------------------------------------------------------

METRICS = """, c AS (SELECT scenario, count(*) FILTER (risk_score >= 0.5 AND label = 1) AS tp,
  count(*) FILTER (risk_score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (risk_score < 0.5 AND label <> 1) AS tn,
  count(*) FILTER (risk_score < 0.5 AND label = 1) AS fn FROM scored GROUP BY scenario),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS false_positive_rate FROM c)
"""


@query("binary_metrics", over("scored", METRICS + "SELECT * FROM m"))
def binary_metrics(spark, sf):
    return Q.binary_metrics(V.scored(spark, sf), group=("scenario",))


@query("holdout_average", over("scored", METRICS + """SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
  round(avg(false_positive_rate), 6) AS false_positive_rate FROM m"""))
def holdout_average(spark, sf):
    means = Q.holdout_average(Q.binary_metrics(V.scored(spark, sf), group=("scenario",)))
    return means.select(*(F.round(c, 6).alias(c) for c in means.columns))


AUC = """, ranks AS (SELECT scenario, label, rank() OVER (PARTITION BY scenario ORDER BY risk_score)
  + (count(*) OVER (PARTITION BY scenario, risk_score) - 1) / 2.0 AS r FROM scored),
u AS (SELECT scenario, sum(r) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n
  FROM ranks GROUP BY scenario)
SELECT scenario, round(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2) / (p * n) END, 6) AS roc_auc FROM u"""


@query("roc_auc", over("scored", AUC))
def roc_auc(spark, sf):
    areas = Q.roc_auc(V.scored(spark, sf), group=("scenario",))
    return areas.select("scenario", F.round("roc_auc", 6).alias("roc_auc"))


@query("auc_ranks", over("scored", """SELECT DISTINCT risk_score, count(*) OVER (PARTITION BY risk_score) AS n,
  rank() OVER (ORDER BY risk_score) + (count(*) OVER (PARTITION BY risk_score) - 1) / 2 AS rank FROM scored"""))
def auc_ranks(spark, sf):
    return Q.average_ranks(V.scored(spark, sf), "risk_score")


def _classified(spark, sf):
    """Type predicted as the largest of the first ten vector entries."""
    rows = V.vectors(spark, sf)
    scores = F.array(*(F.col(f"f{i}") for i in range(10)))
    return rows.withColumn("predicted", (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


CLASSIFIED = """, cl AS (SELECT *, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS predicted,
  label AS y FROM embeddings)
"""


@query("confusion_matrix", over("vectors", CLASSIFIED + "SELECT y AS actual, predicted, count(*) AS n FROM cl GROUP BY ALL"))
def confusion_matrix(spark, sf):
    return Q.confusion(_classified(spark, sf), "type_label", "predicted")


@query("multiclass_metrics", over("vectors", CLASSIFIED + """
, k AS (SELECT unnest(range(10)) AS c),
p AS (SELECT c, (SELECT count(*) FROM cl WHERE y = c) AS support, (SELECT count(*) FROM cl WHERE predicted = c) AS said,
  (SELECT count(*) FROM cl WHERE y = c AND predicted = c) AS hit FROM k),
q AS (SELECT *, CASE WHEN said = 0 THEN 0.0 ELSE hit / said END AS pr, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS re,
  CASE WHEN said + support = 0 THEN 0.0 ELSE 2 * hit / (said + support) END AS f FROM p)
SELECT round(sum(hit) / sum(support), 4) AS accuracy, round(avg(re) FILTER (support > 0), 4) AS balanced_accuracy,
  round(sum(pr * support) / sum(support), 4) AS precision, round(sum(re * support) / sum(support), 4) AS recall,
  round(sum(f * support) / sum(support), 4) AS f1 FROM q"""))
def multiclass_metrics(spark, sf):
    return Q.multiclass_metrics(_classified(spark, sf), "type_label", "predicted")


@query("multiclass_auc", over("vectors", """, long AS (SELECT c, embedding[c + 1]::DOUBLE AS s, CASE WHEN label = c THEN 1 ELSE 0 END AS y
  FROM embeddings, (SELECT unnest(range(10)) AS c)),
r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 AS r FROM long),
u AS (SELECT c, sum(r) FILTER (y = 1) AS rs, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM r GROUP BY c)
SELECT round(CASE WHEN count(*) FILTER (p = 0 OR n = 0) = 0 THEN sum((rs - p * (p + 1) / 2) / (p * n) * p) / sum(p) END, 4) AS roc_auc FROM u"""))
def multiclass_auc(spark, sf):
    return Q.ovr_auc(V.vectors(spark, sf), "type_label", {c: f"f{c}" for c in range(10)})


LEAD = """, ann AS (SELECT source, max("timestamp") AS encryption_start FROM tel WHERE user_id % 11 % 3 <> 2 GROUP BY source),
firsts AS (SELECT source, min(window_start) AS first_alert FROM scored WHERE label = 1 AND risk_score >= 0.5 GROUP BY source)
"""


def _annotations(spark, sf):
    return (V.telemetry(spark, sf).filter(F.col("user_id") % 11 % 3 != 2).groupBy("source")
            .agg(F.max("timestamp").alias("encryption_start")))


@query("lead_time", over("scored", LEAD + """SELECT source, (epoch_us(encryption_start) - epoch_us(first_alert)) / 1e6 AS lead_seconds
  FROM ann LEFT JOIN firsts USING (source)"""))
def lead_time(spark, sf):
    return Q.lead_time(V.scored(spark, sf), _annotations(spark, sf)).select("source", "lead_seconds")


@query("annotation_left_join", over("scored", LEAD + "SELECT source, encryption_start, first_alert FROM ann LEFT JOIN firsts USING (source)"))
def annotation_left_join(spark, sf):
    return Q.lead_time(V.scored(spark, sf), _annotations(spark, sf)).select("source", "encryption_start", "first_alert")
