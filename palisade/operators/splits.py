"""Train / validation / test assignment without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import RAW_REPRESENTATION
from .ordering import row_numbered
from .profiling import class_test_quota

MIN_SOURCES = 3
TEST_SHARE = 0.2
MIN_HOLDOUT_BENIGN = 500


def seeded_order(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of a key, the same in every SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def source_split(df: DataFrame, seed: int = 42) -> DataFrame:
    """Assign whole sources to train, validation or test, label by label; one row a source.

    A source seen under several labels counts under the largest one, so it gets one split only.
    """
    sources = df.groupBy("source").agg(F.max("label").alias("label")).withColumn("_order", seeded_order(F.col("source"), seed))
    ranked = row_numbered(sources, ("label",), ("_order", "source"), "_rn")
    sizes = sources.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(1), F.bround(F.col("_n") * TEST_SHARE).cast("int"))
    part = F.when(share * 2 >= F.col("_n"), 1).otherwise(share)
    enough = F.when(F.col("_n") >= MIN_SOURCES, part).otherwise(
        F.raise_error(F.lit("At least three distinct source logs are required for each class.")).cast("int"))
    return (ranked.join(sizes.withColumn("_part", enough), "label")
            .select("source", "label", F.when(F.col("_rn") <= F.col("_part"), "test")
                    .when(F.col("_rn") <= F.col("_part") * 2, "validation").otherwise("train").alias("split")))


def assign_split(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows with the split of their source."""
    return df.join(assignment.select("source", "split"), "source")


def leakage(df: DataFrame) -> DataFrame:
    """Sources that occur in more than one split; empty when the split is clean."""
    spread = df.select("source", "split").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("splits"))
    return spread.filter(F.col("splits") > 1)


def temporal_split(df: DataFrame, kind: str, date: str, key: str = "sample_id", share: float = TEST_SHARE) -> DataFrame:
    """Per class, the newest share of rows for testing and the rest for training; the key breaks ties.

    Only class, date and key are ranked; the last test row of each class (one row per class) then splits the
    full rows by comparison.
    """
    ranked = row_numbered(df.select(kind, date, key), (kind,), (F.desc_nulls_last(date), F.desc(key)), "_rn")
    quota = class_test_quota(df, kind, share).select(F.col(kind).alias("_kind"), "test")
    cuts = (ranked.join(quota, F.col(kind).eqNullSafe(F.col("_kind"))).filter(F.col("_rn") == F.col("test"))
            .select("_kind", F.col(date).alias("_date"), F.col(key).alias("_key")))
    same_day = F.col(date).eqNullSafe(F.col("_date")) & (F.col(key) >= F.col("_key"))
    newer = (F.col(date) > F.col("_date")) | (F.col("_date").isNull() & F.col(date).isNotNull())
    held = F.col("_key").isNotNull() & F.coalesce(newer | same_day, F.lit(False))
    return (df.join(cuts, F.col(kind).eqNullSafe(F.col("_kind")), "left")
            .withColumn("split", F.when(held, "test").otherwise("train")).drop("_kind", "_date", "_key"))


def split_report(df: DataFrame) -> DataFrame:
    """Windows and distinct sources per split, and the sorted data sets and representations where the rows name them."""
    named = {"datasets": "dataset_source", "representations": "representation"}
    lists = (F.array_sort(F.collect_set(c)).alias(name) for name, c in named.items() if c in df.columns)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("source").alias("sources"), *lists)


def representation_profile(df: DataFrame) -> DataFrame:
    """Rows with raw and with derived representations, and whether training may use them."""
    raw, derived = F.col("representation") == RAW_REPRESENTATION, F.col("representation") != RAW_REPRESENTATION
    counts = df.agg(F.count_if(raw).alias("raw_rows"), F.count_if(derived).alias("proxy_rows"))
    verdict = (F.when((F.col("raw_rows") > 0) & (F.col("proxy_rows") > 0), "mixed")
               .when(F.col("proxy_rows") > 0, "proxy").otherwise("raw"))
    return counts.withColumn("verdict", verdict)


def guard_representation(df: DataFrame, allow_proxy: bool = False) -> None:
    """Refuse derived or mixed representations; one aggregated row reaches the driver."""
    if "representation" not in df.columns:
        return
    verdict = representation_profile(df).first()["verdict"]
    if verdict != "raw" and not allow_proxy:
        raise ValueError("Dataset contains proxy representations; allow them explicitly or train on raw windows.")
    if verdict == "mixed":
        raise ValueError("Refusing to mix raw windows with proxy representations.")


def label_profile(df: DataFrame) -> DataFrame:
    """Rows per label class and whether the labels are exactly 0 and 1."""
    label = F.col("label")
    counts = df.agg(F.count_if(label == 0).alias("benign_rows"), F.count_if(label == 1).alias("attack_rows"),
                    F.count_if(~label.isin(0, 1)).alias("other_rows"))
    valid = (F.col("benign_rows") > 0) & (F.col("attack_rows") > 0) & (F.col("other_rows") == 0)
    return counts.withColumn("valid", valid)


def guard_labels(df: DataFrame) -> None:
    if not label_profile(df).first()["valid"]:
        raise ValueError("Training requires labelled benign (0) and attack (1) windows.")


def order_cutoff(df: DataFrame, key: str, size: int, total: int, seed: int):
    """The ``size``-th (order, key) of ``df`` in seeded order, or None when there are fewer rows.

    Hashes are uniform, so rows below a hash limit a little above ``size / total`` hold the wanted one; only
    those are ranked. Should the limit ever let too few through, all rows are ranked.
    """
    hashed = df.select(key, seeded_order(F.col(key), seed).alias("_order"))
    share = (size + 10 * size ** 0.5 + 10) / max(total, 1)
    if share < 0.5:
        below = hashed.filter(F.col("_order") < f"{int(share * (1 << 60)):015x}")
        if below.count() >= size:
            hashed = below
    return row_numbered(hashed, (), ("_order", key), "_rn").filter(F.col("_rn") == size).select("_order", key).first()


def first_in_order(key: str, seed: int, cutoff) -> Column:
    """Whether a row comes no later than the cutoff in seeded order."""
    order = seeded_order(F.col(key), seed)
    return (order < cutoff[0]) | ((order == cutoff[0]) & (F.col(key) <= cutoff[1]))


def holdout_assignment(df: DataFrame, scenario: str, key: str, seed: int = 42) -> DataFrame:
    """Rows with ``part``: the held-out scenario and a benign sample are for testing, the rest for training.

    The benign sample has ``min(all, max(attack rows of the scenario, 500))`` rows in seeded order; one row, its
    last, comes to the driver and the sample is a filter.
    """
    benign = F.col("label") == 0
    counts = df.agg(F.count_if(benign).alias("b"),
                    F.count_if((F.col("label") == 1) & (F.col("scenario") == scenario)).alias("a")).first()
    size = max(counts["a"], MIN_HOLDOUT_BENIGN)
    drawn = benign
    if size < counts["b"]:
        drawn = benign & first_in_order(key, seed, order_cutoff(df.filter(benign), key, size, counts["b"], seed))
    held = ((F.col("label") == 1) & F.col("scenario").eqNullSafe(F.lit(scenario))) | drawn
    return df.withColumn("part", F.when(held, "test").otherwise("train"))


def attack_scenarios(df: DataFrame) -> DataFrame:
    """Distinct attack scenarios."""
    return df.filter((F.col("label") == 1) & F.col("scenario").isNotNull()).select("scenario").distinct()


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """Rows with ``fold`` from 0: within each label, dealt in turn in the seeded order of the key, so every fold has its share of each label.

    A null label is one label. The numbering spreads a hot label over many tasks.
    """
    order = row_numbered(df, [label], [seeded_order(F.col(key), seed), key], "_rank")
    return order.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")
