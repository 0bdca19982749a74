"""Root-less XML event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import first_truthy
from ..schemas import EVENT_TEXT_FIELDS

END_TAG = "</Event>"
EVENT_XML_SCHEMA = """System STRUCT<EventID: STRING, TimeCreated: STRUCT<_SystemTime: STRING>, Computer: STRING>,
EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>, _corrupt_record STRING"""

# Event data names behind each field, in order of preference.
FIELD_SOURCES = {
    "process_guid": ("ProcessGuid", "SourceProcessGUID"), "process_id": ("ProcessId", "SourceProcessId"),
    "image": ("Image", "SourceImage"), "parent_image": ("ParentImage",), "command_line": ("CommandLine",),
    "target_filename": ("TargetFilename",), "target_object": ("TargetObject",),
    "destination_ip": ("DestinationIp",), "destination_port": ("DestinationPort",),
}


def xml_event_scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per event document with its file: the end tag is the line separator, so big files split."""
    lines = (spark.read.option("lineSep", END_TAG).option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).text(path).select("value", F.col("_metadata.file_path").alias("file_path")))
    start = F.regexp_instr("value", F.lit(r"<Event[\s>]"))
    return (lines.filter(start > 0)
            .select("file_path", F.concat(F.substr("value", start), F.lit(END_TAG)).alias("xml")))


def xml_event_parse(documents: DataFrame, strict: bool = True) -> DataFrame:
    """Flat event records; all named data also stay in the map ``extra``.

    ``strict`` fails the job on a document that is no well-formed event, otherwise such rows are kept
    apart in ``corrupt``.
    """
    parsed = documents.withColumn("e", F.from_xml("xml", EVENT_XML_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    named = F.filter(F.coalesce("e.EventData.Data", F.array()), lambda d: F.coalesce(d["_Name"], F.lit("")) != "")
    # the last value of a repeated name wins: sorted by name and place, an entry stays if the next one has another name
    pairs = F.array_sort(F.transform(named, lambda d, i: F.struct(d["_Name"].alias("key"), i.alias("at"), F.coalesce(d["_VALUE"], F.lit("")).alias("value"))))
    rows = parsed.withColumn("pairs", pairs)

    def data(name: str) -> Column:
        """One look through the entries; the map itself is only built where ``extra`` is read."""
        return F.try_element_at(F.filter("pairs", lambda p: p["key"] == name), F.lit(-1))["value"]

    bad = F.col("e._corrupt_record").isNotNull()
    if strict:
        event_id = F.when(bad, F.raise_error(F.concat(F.lit("Incomplete or malformed event in "), "file_path")))
        event_id = event_id.otherwise(F.col("e.System.EventID")).cast("int")
    else:
        event_id = F.col("e.System.EventID").try_cast("int")
    fields = {"timestamp": first_truthy(data("UtcTime"), F.col("e.System.TimeCreated._SystemTime")),
              "event_id": event_id, "computer": F.nullif(F.col("e.System.Computer"), F.lit("")),
              **{f: first_truthy(*(data(n) for n in names)) for f, names in FIELD_SOURCES.items()}}
    order = ("timestamp", "event_id", *EVENT_TEXT_FIELDS)
    corrupt = [] if strict else [F.col("e._corrupt_record").alias("corrupt")]
    # a record is made once, by a generator: conditions on its fields, put into the plan by the caller, cannot be drawn below it and parse again
    record = F.struct(*(fields[f].alias(f) for f in order), "pairs", *corrupt)
    rows = rows.select("file_path", F.explode(F.array(record)).alias("r")).select("file_path", "r.*")
    follower = F.concat(F.transform(F.slice("pairs", 2, F.greatest(F.size("pairs"), F.lit(1))), lambda d: d["key"]), F.array(F.lit(None).cast("string")))
    last = F.filter(F.zip_with("pairs", follower, lambda p, k: F.struct(p["key"].alias("key"), p["value"].alias("value"), k.alias("then"))),
                    lambda p: p["key"].isNotNull() & ~p["key"].eqNullSafe(p["then"]))
    extra = F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))
    return rows.select("file_path", *order, extra.alias("extra"), *([] if strict else ["corrupt"]))
