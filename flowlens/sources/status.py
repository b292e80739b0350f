"""Damaged record files (S2-S4, S14): what can't be read is set aside with its
file and reason, the run goes on, and every file gets a status.

A bad record is a CSV row with more or fewer fields than its header, a flow text
line without a source or a destination, or a JSON file that is no JSON document.
Everything stays distributed but the distinct CSV headers and file names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowlens.operators import unify as un
from flowlens.sources import files as fs

BAD = "source_path string, kind string, reason string, record string"
#: Characters of a bad record that are kept.
SHOWN = 200


def _bad(rows: DataFrame, kind: str, reason: str, record: str) -> DataFrame:
    return rows.select("source_path", F.lit(kind).alias("kind"), F.lit(reason).alias("reason"),
                       F.substring(record, 1, SHOWN).alias("record"))


def csv_records(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(unified records, bad rows) of CSV files with headers, which may differ."""
    by_header: dict[str, list[str]] = {}
    for path, header in fs.csv_headers(spark, paths).collect():
        by_header.setdefault(header, []).append(path)
    good, bad = None, spark.createDataFrame([], BAD)
    for header in sorted(by_header):
        files = sorted(by_header[header])
        names = spark.read.option("header", True).csv(files[0]).columns
        corrupt = "_corrupt"
        while corrupt in names:
            corrupt = f"_{corrupt}"
        schema = StructType([StructField(c, StringType()) for c in [*names, corrupt]])
        rows = fs.provenance(spark.read.schema(schema).options(
            header=True, mode="PERMISSIVE", columnPruning=False, columnNameOfCorruptRecord=corrupt).csv(files))
        # the row where it is bad, else empty; Spark doesn't read the corrupt column alone
        shown = F.concat_ws("", F.col(corrupt), F.substring(F.col(f"`{names[0]}`"), 1, 0))
        wrong = rows.where(shown != "").select("source_path", shown.alias("record"))
        bad = bad.unionByName(_bad(wrong, "csv", "fields unlike the header", "record"))
        part = rows.where(shown == "").drop(corrupt)
        good = part if good is None else good.unionByName(part, allowMissingColumns=True)
    if good is None:
        good = spark.createDataFrame([], "source_file string, source_path string")
    return un.normalize(good, "csv", keep=["source_file", "source_path"]), bad


def json_records(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(unified records, bad files) of JSON documents, one a file."""
    docs = fs.provenance(spark.read.option("wholetext", True).text(paths))
    broken = docs.where(F.try_parse_json("value").isNull() & (F.trim("value") != ""))
    bad = _bad(broken, "json", "no JSON document", "value")
    return fs.read_json_records(spark, paths).join(bad.select("source_path").distinct(), "source_path", "left_anti"), bad


def flow_text_records(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(unified records, bad lines) of flow text files."""
    lines = fs.provenance(spark.read.text(paths))
    lines = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")) \
        .withColumn("m", fs.parse_flow_line(F.col("value")))
    known = (F.col("m")["src_ip"] != "") & (F.col("m")["dst_ip"] != "")
    good = fs.normalize_maps(lines.where(known), "m", "flow_txt", ["source_file", "source_path"])
    return good, _bad(lines.where(~known), "flow_txt", "no source or destination", "value")


READERS = {"csv": csv_records, "json": json_records, "flow_txt": flow_text_records}


def read_checked(spark: SparkSession, folders: dict[str, str | list[str]]) -> tuple[DataFrame, DataFrame]:
    """(unified records, bad records) of folders by kind (see READERS)."""
    good, bad = None, spark.createDataFrame([], BAD)
    for kind, paths in folders.items():
        records, wrong = READERS[kind](spark, paths)
        good = records if good is None else good.unionByName(records)
        bad = bad.unionByName(wrong)
    return good, bad


def file_status(records: DataFrame, bad: DataFrame, files: DataFrame) -> DataFrame:
    """Per file of `files` (source_path): records, bad records, the least of their
    reasons, and ERROR (a bad record), SUCCESS (records) or EMPTY. Counts are
    summed before the join, so a file meets it in two rows."""
    counted = records.groupBy("source_path").agg(F.count(F.lit(1)).alias("records"))
    wrong = bad.groupBy("source_path").agg(F.count(F.lit(1)).alias("bad_records"), F.min("reason").alias("reason"))
    status = F.when(F.col("bad_records") > 0, "ERROR").when(F.col("records") > 0, "SUCCESS").otherwise("EMPTY")
    return files.select("source_path").join(counted, "source_path", "left").join(wrong, "source_path", "left") \
        .fillna(0, ["records", "bad_records"]).select("source_path", "records", "bad_records", "reason", status.alias("status"))


def listed(spark: SparkSession, folders: dict[str, str | list[str]]) -> DataFrame:
    """(source_path) of all files of the folders, empty ones, too."""
    paths = [p for v in folders.values() for p in ([v] if isinstance(v, str) else v)]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths) \
        .select(F.col("path").alias("source_path"))
