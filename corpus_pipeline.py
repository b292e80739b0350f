"""From raw documents to packed training sequences.

STAGES lists (name, function): each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `docs`, whatever they are.

Rows that a stage keeps are whole rows of its input; ids and texts may be null
and rows may repeat. A null or empty text goes through like others: the
classifier scores it, exact duplicates of it go, it is linked with nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.bin_packing import pack
from flowlens.llm.content_dedup import distinct_contents
from flowlens.llm.jaccard_rtree import jaccard_components
from flowlens.llm.pii import redact
from flowlens.llm.queries import vocabulary
from flowlens.llm.rule_ensemble import quality_model, with_statistics
from flowlens.session import Scratch, configure

#: Scores under this are rejected.
QUALITY = 0.3


def _free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject. The rules are compiled
    into one column over the text's statistics, so no row moves."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scratch, stats = Scratch(spark, "pipeline-quality"), _free_name(docs, "statistics")
    rules, _ = quality_model(docs, labels, scratch)
    scratch.keep_only()
    return with_statistics(docs, "text", stats).where(rules.score(stats) >= QUALITY).drop(stats)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the row with the largest id."""
    return distinct_contents(docs)


def _numbered(spark: SparkSession, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """`docs` with a number of its own for every row, the same whenever it is
    read: of its file and its place there. Rows that no file holds are written
    first."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    try:
        placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], place.alias(name))
    except AnalysisException:
        docs = scratch.write(docs, "docs")
        placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], place.alias(name))
    files = placed.select(F.col(name)["file_path"].alias("path")).distinct()
    files = scratch.write(files.withColumn("file", F.row_number().over(Window.orderBy("path"))), "files")  # a row a file
    return placed.join(F.broadcast(files), F.col(name)["file_path"] == F.col("path")) \
        .withColumn(name, F.col("file").cast("long") * (1 << 40) + F.col(name)["row_index"]).drop("path", "file")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of the n-gram join connect, the row with the
    smallest id; rows are told apart by their place, not by their ids."""
    name, scratch = _free_name(docs, "row_number"), Scratch(spark, "pipeline-near")
    numbered = _numbered(spark, docs, scratch, name)
    slim = numbered.select(F.col(name).alias("row"), F.col("text"), F.col("doc_id").cast("long").alias("id"))
    groups = jaccard_components(slim, id_col="row")
    first = groups.join(slim.select("row", "id"), "row").groupBy("component_id") \
        .agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    dropped = scratch.write(groups.join(first, "component_id").where("row <> first")
                            .select(F.col("row").alias(name)), "dropped")
    return numbered.join(dropped, name, "left_anti").drop(name)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the personal data that is found, n_chars as they are then."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences, in token ids."""
    return pack(docs, tokenizer=vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: The classifier is trained, which SQL can't express; tests/llm holds run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what is between is written under the shared
    checkpoint folder and goes when the next stage has read it."""
    configure(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.keep_only(f"stage-{k}")
    return docs
