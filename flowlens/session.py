"""Session settings every flowlens job relies on.

`configure(spark)` pins the runtime SQL settings the operators assume
(UTC session zone, last-wins map keys, AQE with skew handling) and ships the
package to the executors. It only touches runtime-settable confs, so it is
safe on a shared cluster session.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # every timestamp the operators produce or parse is UTC
    "spark.sql.session.timeZone": "UTC",
    # key=value logs may repeat a key; the later one wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # runtime re-planning: coalesce small shuffles, split skewed join partitions
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # state of streams outside the heap, with the column families that maps and timers need
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """One JVM holds driver and executors, so a folder of this machine is
    shared by all of them (`local-cluster` has executors of its own)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application:
    functions handed to `mapInArrow` and the like are pickled by name, so the
    worker must be able to import them wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="flowlens-"), "flowlens-package")
    stage = tempfile.mkdtemp(prefix="flowlens-")
    shutil.copytree(package, os.path.join(stage, os.path.basename(package)),
                    ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(base, "zip", stage))
    _shipped.add(sc.applicationId)


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app: str = "flowlens") -> SparkSession:
    """Session for tests and the local bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster `spark.checkpoint.dir` is set by the deployment and is read
    as-is; without it there is no folder that driver and executors share, and
    an error is raised. Only a local session (one JVM) gets a folder of its own.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="flowlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


class Scratch:
    """Parquet stages of one run, in a folder of their own under the shared
    checkpoint folder. A stage cuts lineage like `checkpoint()`, survives the
    loss of executors, and later passes read only the columns they need.

    `drop` removes stages that nothing will read again; the caller keeps the
    ones that a returned DataFrame still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    def write(self, df: DataFrame, stage: str, **options: str) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(self.path(stage))
        return self.spark.read.schema(df.schema).parquet(self.path(stage))

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *stages: str) -> None:
        for stage in stages:
            at, fs = self._folder(self.path(stage))
            fs.delete(at, True)

    def keep_only(self, *stages: str) -> None:
        """Drop every stage but these."""
        at, fs = self._folder(self.root)
        if fs.exists(at):
            self.drop(*({f.getPath().getName() for f in fs.listStatus(at)} - set(stages)))


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """`df` as one Parquet stage (see `Scratch`)."""
    return Scratch(df.sparkSession, name).write(df, name)
