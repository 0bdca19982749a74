"""Sandbox reports to a long sample-by-behaviour table.

Millions of behaviours never become columns: a present behaviour is one row (sample_id, name), an absent
one is no row. Wide matrices are built only for a chosen list of names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import row_numbered

# Report categories and their feature name parts.
REGISTRY_OPERATIONS = {"regkey_opened": "OPENED", "regkey_deleted": "DELETED", "regkey_read": "READ",
                       "regkey_written": "WRITTEN"}
FILE_OPERATIONS = {"file_created": "CREATED", "file_recreated": "RECREATED", "file_opened": "OPENED",
                   "file_written": "WRITTEN", "file_deleted": "DELETED", "file_exists": "EXISTS",
                   "file_failed": "FAILED", "file_read": "READ"}
DIRECTORY_OPERATIONS = {"directory_created": "CREATED", "directory_enumerated": "ENUMERATED"}
NETWORK_OPERATIONS = {"connects_ip": "CONNECTS_IP", "connects_host": "CONNECTS_HOST",
                      "resolves_host": "RESOLVES_HOST"}
SYSTEM_OPERATIONS = {"dll_loaded": "DLL_LOADED", "command_line": "COMMAND_LINE", "mutex": "MUTEX", "guid": "GUID"}
RANSOMWARE_CLASSES = ("WannaCry", "Ryuk", "LockBit", "Conti", "Sodinikibi", "CryptoLocker")


def presence_long(reports: DataFrame, names: Column) -> DataFrame:
    """Distinct (sample_id, name) of an array column of names; samples without names yield no row.

    ``reports`` has one row per sample, so values are made distinct within the row and nothing is shuffled.
    """
    return reports.select("sample_id", F.explode(F.array_distinct(F.array_compact(names))).alias("name"))


def _listed(prefix: str, operations: Mapping[str, str], lower: bool) -> Column:
    """Names of all values listed under the given summary categories."""
    summary = F.col("behavior.summary")

    def named(field: str, part: str) -> Column:
        values = F.coalesce(F.try_element_at(summary, F.lit(field)), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.concat(F.lit(f"{prefix}:{part}:"), F.lower(v) if lower else v))
    return F.concat(*(named(f, p) for f, p in operations.items()))


def _api() -> Column:
    calls = F.flatten(F.transform(F.map_values("behavior.apistats"), F.map_keys))
    return F.transform(calls, lambda a: F.concat(F.lit("API:"), a))


def _string() -> Column:
    return F.transform("strings", lambda s: F.concat(F.lit("STRING:"), F.lower(s)))


def _signature() -> Column:
    return F.transform("signatures", lambda s: F.concat(F.lit("SIGNATURE:"), F.lower(s["name"])))


def _dropped() -> Column:
    """Extensions (text after the last dot) and types of dropped files."""
    def extension(d: Column) -> Column:
        return F.when(F.contains(d["name"], F.lit(".")),
                      F.concat(F.lit("DROP:EXTENSION:"), F.lower(F.substring_index(d["name"], ".", -1))))

    def kind(d: Column) -> Column:
        return F.when(d["type"] != "", F.concat(F.lit("DROP:TYPE:"), F.lower(F.replace(d["type"], F.lit(" "), F.lit("_")))))
    return F.concat(F.transform("dropped", extension), F.transform("dropped", kind))


# Names per feature group; registry keys and API names keep their case.
EXTRACTORS: dict[str, Callable[[], Column]] = {
    "api": _api,
    "registry": lambda: _listed("REG", REGISTRY_OPERATIONS, lower=False),
    "file": lambda: _listed("FILE", FILE_OPERATIONS, lower=True),
    "directory": lambda: _listed("DIRECTORY", DIRECTORY_OPERATIONS, lower=True),
    "string": _string,
    "network": lambda: _listed("NETWORK", NETWORK_OPERATIONS, lower=True),
    "system": lambda: _listed("SYSTEM", SYSTEM_OPERATIONS, lower=True),
    "dropped": _dropped,
    "signature": _signature,
}
GROUPS = tuple(EXTRACTORS)


def extract_group(reports: DataFrame, group: str) -> DataFrame:
    """Distinct (sample_id, name) of one feature group."""
    return presence_long(reports, EXTRACTORS[group]())


def all_features(reports: DataFrame) -> DataFrame:
    """All nine groups as (sample_id, feature_group, name) from one pass over the reports."""
    none = F.array().cast("array<string>")
    groups = F.array(*(F.struct(F.lit(g).alias("g"), F.array_distinct(F.array_compact(F.coalesce(names(), none))).alias("names"))
                       for g, names in EXTRACTORS.items()))
    per_group = reports.select("sample_id", F.explode(groups).alias("e"))
    return per_group.select("sample_id", F.col("e.g").alias("feature_group"), F.explode("e.names").alias("name"))


def presence_matrix(presence: DataFrame, names: Sequence[str], samples: DataFrame | None = None) -> DataFrame:
    """0/1 columns for a chosen list of names, one row per sample (all of ``samples`` when given)."""
    flags = [F.max(F.when(F.col("name") == n, 1).otherwise(0)).alias(n) for n in sorted(names)]
    everyone = (presence.select("sample_id").distinct() if samples is None else samples).select("sample_id", F.lit(None).cast("string").alias("name"))
    rows = presence.filter(F.col("name").isin(*names)).select("sample_id", "name").unionByName(everyone)
    return rows.groupBy("sample_id").agg(*flags)


def group_matrix_outer_join(groups: Sequence[DataFrame]) -> DataFrame:
    """Full outer join of wide 0/1 groups on sample_id, missing cells 0.

    The groups have different columns, so stacking them and taking the maximum per sample needs one
    shuffle instead of one per group.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
    columns = [c for c in stacked.columns if c != "sample_id"]
    return stacked.groupBy("sample_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("int").alias(c) for c in columns))


def selected_matrix_inner_join(groups: Sequence[DataFrame]) -> DataFrame:
    """Inner join of reduced groups on sample_id; refuses groups that share a column."""
    names = [c for g in groups for c in g.columns if c != "sample_id"]
    if len(names) != len(set(names)):
        raise ValueError("Feature groups share column names.")
    marked = [g.withColumn("_g", F.lit(1).cast("long") * (1 << i)) for i, g in enumerate(groups)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    joined = stacked.groupBy("sample_id").agg(F.bit_or("_g").alias("_g"), *(F.max(c).alias(c) for c in names))
    return joined.filter(F.col("_g") == (1 << len(groups)) - 1).drop("_g")


def feature_dictionary(named: DataFrame, start: int = 1) -> DataFrame:
    """Dense numbers from ``start`` for distinct (feature_group, name), by group order and then name."""
    position = F.array_position(F.array(*(F.lit(g) for g in GROUPS)), F.col("feature_group"))
    distinct = named.select("feature_group", "name").distinct().withColumn("_g", position)
    numbered = row_numbered(distinct, (), ("_g", "name"), "_rn")
    return numbered.select((F.col("_rn") + (start - 1)).alias("feature_id"), "feature_group", "name")


def dense_numbering(named: DataFrame, start: int = 1) -> DataFrame:
    """Dense numbers by sorted name."""
    numbered = row_numbered(named.select("name").distinct(), (), ("name",), "_rn")
    return numbered.select((F.col("_rn") + (start - 1)).alias("feature_id"), "name")


def numbered_columns(presence: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace names by numbers."""
    return presence.join(dictionary.select("name", "feature_id"), "name").select("sample_id", "feature_id")


def feature_name_join(numbered: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Restore names from numbers."""
    return numbered.join(dictionary.select("feature_id", "name"), "feature_id")


def dictionary_merge(dictionaries: Sequence[DataFrame]) -> DataFrame:
    """Union of number-to-name tables; for equal numbers the later table wins."""
    ranked = (d.select("feature_id", "name", F.lit(i).alias("_i")) for i, d in enumerate(dictionaries))
    stacked = reduce(DataFrame.unionByName, ranked)
    return stacked.groupBy("feature_id").agg(F.max_by("name", "_i").alias("name"))


def dictionary_ends(dictionary: DataFrame, n: int = 10) -> DataFrame:
    """First and last entries by number."""
    first, last = (dictionary.orderBy(o).limit(n) for o in (F.asc("feature_id"), F.desc("feature_id")))
    return first.withColumn("end", F.lit("first")).unionByName(last.withColumn("end", F.lit("last")))


def constant_features(presence: DataFrame, samples: DataFrame) -> DataFrame:
    """Behaviours that every sample shows."""
    n = samples.agg(F.countDistinct("sample_id"))
    counts = presence.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") == n.scalar())


def duplicate_names(dictionary: DataFrame) -> DataFrame:
    """Names that differ only in case, with their number."""
    counts = dictionary.groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > 1)


def api_calls(reports: DataFrame) -> DataFrame:
    """One row per call: sample, class, score, process number and time, API name."""
    name = F.col("target.file.name")
    processes = reports.select("sample_id", F.col("info.score").alias("score"),
                               F.when(name.isin(*RANSOMWARE_CLASSES), name).otherwise("Normal").alias("class"),
                               F.posexplode("behavior.processes").alias("process", "p"))
    return processes.select("sample_id", "class", "score", "process", F.col("p.time").alias("time"),
                            F.explode("p.calls.api").alias("api"))


def api_vocabulary(calls: DataFrame) -> DataFrame:
    return calls.select("api").distinct()


def api_call_counts(calls: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Calls of each listed API per process."""
    return calls.groupBy("sample_id", "class", "score", "process", "time").agg(
        *(F.count_if(F.col("api") == a).alias(a) for a in vocabulary))
