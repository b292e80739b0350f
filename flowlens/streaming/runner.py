"""Run a rollup as a Structured Streaming query over a folder of files.

The checkpoint lives under the cluster's `spark.checkpoint.dir` (a shared,
fault-tolerant folder), so a restarted query resumes from its offsets and
state after executor or driver loss.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from flowlens.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def run_available_now(df: DataFrame, transform: Callable[[DataFrame], DataFrame], sink_path: str, *,
                      output_mode: str = "append", fmt: str = "parquet", name: str | None = None,
                      checkpoint: str | None = None) -> str:
    """transform(stream) -> sink, processing everything available, then stop.
    Returns the checkpoint location used."""
    spark = df.sparkSession
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", name or uuid.uuid4().hex)
    out = transform(df)
    w = out.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if fmt == "memory":
        q = w.format("memory").queryName(name or "flowlens_stream").start()
    else:
        q = w.format(fmt).option("path", sink_path).start()
    q.awaitTermination()
    return ckpt
