"""File sources and sinks.

Readers never infer schemas: record files are read as text columns and typed
by the operators. Provenance comes from the `_metadata` column of Spark's file
sources, so it costs nothing per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.parse import label_from_file_stem, to_iso
from flowlens.operators import unify as un

# fixed values (S1): record loaders by file extension
RECORD_EXTENSIONS = ["csv", "json", "txt", "flow", "pcap"]


def discover_files(spark: SparkSession, roots: list[str] | str, extensions=RECORD_EXTENSIONS) -> DataFrame:
    """Recursive file listing filtered by extension; explicit files accepted.
    Returns (path, extension, length)."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    glob = "*.{" + ",".join(extensions) + "}"
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", glob).load(roots).select("path", "length"))
    return df.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))


def provenance(df: DataFrame) -> DataFrame:
    """source_file (name) and source_path from the file source metadata."""
    return df.withColumns({"source_file": F.col("_metadata.file_name"), "source_path": F.col("_metadata.file_path")})


def csv_headers(spark: SparkSession, paths) -> DataFrame:
    """(source_path, header) of every CSV file: its first line. Lines of a split
    are numbered in order, and the first line lies in the split at offset 0."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_path"),
                                          F.col("_metadata.file_block_start").alias("at"))
    return lines.where("at = 0").withColumn("n", F.monotonically_increasing_id()) \
        .groupBy("source_path").agg(F.min_by("value", "n").alias("header"))


def read_csv_records(spark: SparkSession, paths, source_type: str = "csv", order_col: str | None = None) -> DataFrame:
    """CSV files with a header -> unified records (S2). All columns read as
    text. Files with the same header are read together, and the groups are put
    together by column name, so a folder may mix headers; only the distinct
    headers and the file names reach the driver."""
    by_header: dict[str, list[str]] = {}
    for path, header in csv_headers(spark, paths).collect():
        by_header.setdefault(header, []).append(path)
    raw = None
    for header in sorted(by_header):
        part = provenance(spark.read.option("header", True).option("inferSchema", False).csv(sorted(by_header[header])))
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    if raw is None:
        raw = spark.createDataFrame([], "source_file string, source_path string")
    keep = ["source_file", "source_path"] + ([order_col] if order_col else [])
    return un.normalize(raw, source_type, keep=keep)


def normalize_maps(df: DataFrame, map_col: str, source_type: str, keep: list[str]) -> DataFrame:
    """Unified records from MAP<STRING,STRING> rows (heterogeneous JSON)."""
    m = F.col(map_col)
    out = {}
    for field, names in un.ALIASES.items():
        vals = [un.truthy(F.try_element_at(m, F.lit(n))) for n in names]
        out[field] = F.coalesce(*vals, F.lit(""))
    rest = F.map_filter(m, lambda k, v: ~k.isin(un.UNIFIED_COLUMNS) & v.isNotNull())
    meta = F.when(F.size(rest) > 0, F.to_json(rest)).otherwise(F.lit(""))
    resolved = df.select(*keep, *[out[f].alias(f) for f in un.ALIASES], F.lit(source_type).alias("source_type"),
                         meta.alias("additional_meta"))
    return resolved.withColumn("timestamp", to_iso(F.col("timestamp"))).select(*keep, *un.UNIFIED_COLUMNS)


def read_json_records(spark: SparkSession, paths) -> DataFrame:
    """JSON documents -> unified records (S3): a list of objects, a single
    object, or an object of lists (each element gets __subset=<key>);
    non-object elements are skipped. One document per file (not splittable);
    JSON-lines data should use `spark.read.json` directly."""
    docs = provenance(spark.read.option("wholetext", True).text(paths)).withColumnRenamed("value", "doc")
    s = F.col("doc")
    as_list = F.from_json(s, "array<string>")  # elements kept as JSON text, objects parsed one by one
    as_obj_lists = F.from_json(s, "map<string,array<map<string,string>>>")
    as_obj = F.from_json(s, "map<string,string>")
    first = F.regexp_extract(s, r"^\s*(.)", 1)
    list_rows = docs.where(first == "[").select("source_file", "source_path", F.explode(as_list).alias("e")) \
        .where(F.regexp_like(F.col("e"), F.lit(r"^\s*\{"))) \
        .select("source_file", "source_path", F.from_json("e", "map<string,string>").alias("m"))
    obj = docs.where(first == "{")
    nested = obj.select("source_file", "source_path", F.explode(as_obj_lists).alias("subset", "lst")) \
        .where(F.col("lst").isNotNull()) \
        .select("source_file", "source_path", F.explode("lst").alias("m"), "subset") \
        .withColumn("m", F.map_concat("m", F.create_map(F.lit("__subset"), F.col("subset")))).drop("subset")
    single = obj.where(as_obj_lists.isNull()).select("source_file", "source_path", as_obj.alias("m"))
    maps = list_rows.unionByName(nested).unionByName(single).where(F.col("m").isNotNull())
    return normalize_maps(maps, "m", "json", ["source_file", "source_path"])


def parse_flow_line(line: Column) -> Column:
    """`ts src:port > dst:port proto bytes [label]` -> MAP (S4). The arrow is
    searched; without one it is assumed at token 2 (so the destination is
    token 3, as in the reference); missing trailing fields are ''."""
    parts = F.split(F.trim(line), r"\s+")
    arrow = F.array_position(parts, F.lit(">"))
    a = F.when(arrow > 0, arrow - 1).otherwise(F.lit(2))  # 0-based arrow index

    def at(i):  # 0-based, '' when missing
        return F.coalesce(F.try_element_at(parts, (i + 1).cast("int")), F.lit(""))
    src, dst = at(F.lit(1)), at(a + 1)

    def ip(x):
        return F.split_part(x, F.lit(":"), F.lit(1))

    def port(x):
        return F.coalesce(F.split_part(x, F.lit(":"), F.lit(2)), F.lit(""))
    return F.create_map(F.lit("timestamp"), at(F.lit(0)), F.lit("src_ip"), ip(src), F.lit("dst_ip"), ip(dst),
                        F.lit("src_port"), port(src), F.lit("dst_port"), port(dst),
                        F.lit("protocol"), at(a + 2), F.lit("packet_len"), at(a + 3), F.lit("label"), at(a + 4))


def with_line_order(lines: DataFrame) -> DataFrame:
    """`line_no`: a struct that orders lines by file path, offset of the split in
    the file and position in the task, whichever task reads the split."""
    return lines.withColumn("line_no", F.struct(F.col("_metadata.file_path").alias("path"),
                                                F.col("_metadata.file_block_start").alias("at"),
                                                F.monotonically_increasing_id().alias("n")))


def read_flow_text(spark: SparkSession, paths, order: bool = True) -> DataFrame:
    """Whitespace flow text files -> unified records (S4). Blank and '#'
    lines are skipped. Keeps `line_no` (order of file path, split and line, the
    same however Spark packs the splits) for keep-first."""
    t = provenance(spark.read.text(paths))
    t = with_line_order(t) if order else t
    t = t.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    t = t.withColumn("m", parse_flow_line(F.col("value")))
    keep = ["source_file", "source_path"] + (["line_no"] if order else [])
    return normalize_maps(t, "m", "flow_txt", keep)


def read_labelled_flows(spark: SparkSession, root: str, pattern: str = "*-no-metadata.parquet",
                        label_map: dict | None = None, row_label_col: str | None = None) -> DataFrame:
    """Labelled flow Parquet files; the label comes from the file stem and a
    label dictionary (identity when unknown); a per-row label column can
    take precedence instead (S6, C8, Q11)."""
    from flowlens.operators.align import CIC_ATTACK_LABELS, map_or_keep
    df = provenance(spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(root))
    file_label = map_or_keep(label_from_file_stem(F.col("source_file")), label_map or CIC_ATTACK_LABELS)
    lab = F.coalesce(F.col(row_label_col), file_label) if row_label_col else file_label
    return df.withColumns({"intent_label": lab, "dataset_source": F.lit("CIC-IDS2017")})


def read_firewall_logs(spark: SparkSession, paths) -> DataFrame:
    """Firewall log text by path or glob with the file name as source_file."""
    return with_line_order(provenance(spark.read.text(paths)).withColumnRenamed("value", "line"))


def capture_labels(files: DataFrame, mode: str = "folder") -> DataFrame:
    """Class of a labelled capture from its folder (`App/x.pcap`) or file name
    prefix (`App*.pcap`), with an index by sorted class name (S8)."""
    if mode == "folder":
        cls = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    else:
        cls = F.regexp_extract("path", r"/([A-Za-z]+)[^/]*$", 1)
    from flowlens.operators.images import class_index
    return class_index(files.withColumn("class_name", cls), "class_name")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Sinks (S11): parquet by default, CSV with a header when asked."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Small report tables as JSON lines, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def batch_summary(flows: DataFrame, files: DataFrame, n_features: int) -> DataFrame:
    """Per input file, by its whole path: flows, feature count and a status
    (S14) -- SUCCESS (rows), EMPTY (no rows), ERROR where `files` has an `error`
    (see `pcap.capture_summary`). `flows` name their file in `source_path`."""
    per = flows.groupBy("source_path").agg(F.count(F.lit(1)).alias("flows"))
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    f = files.select(F.col("source_path" if "source_path" in files.columns else "path").alias("source_path"),
                     error.alias("error"))
    return f.join(per, "source_path", "left").select(
        "source_path", F.regexp_extract("source_path", r"([^/]+)$", 1).alias("source_file"),
        F.coalesce("flows", F.lit(0)).alias("flows"), F.lit(n_features).alias("features"),
        F.when(F.col("error").isNotNull(), F.lit("ERROR")).when(F.col("flows") > 0, F.lit("SUCCESS"))
        .otherwise(F.lit("EMPTY")).alias("status"))


def save_feature_names(spark: SparkSession, names: list[str], path: str) -> None:
    """Ordered feature-name list saved next to a model."""
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string") \
        .coalesce(1).orderBy("pos").select("name").write.mode("overwrite").text(path)


def load_feature_names(spark: SparkSession, path: str) -> list[str]:
    """Read the ordered list back (it is a handful of names)."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]
