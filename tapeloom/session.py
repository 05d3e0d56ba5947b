"""Spark session defaults and lineage cutting."""
from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tapeloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Call sites cost several round trips to the JVM for every column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it uses a folder in its warehouse.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that dependent passes do not recompute it.

    A checkpoint runs its input twice, once for the result and once for the files, so the
    input is kept on the executors' disks in between.
    """
    checkpoint_root(df.sparkSession)
    if df.storageLevel.useDisk or df.storageLevel.useMemory:
        return df.checkpoint()
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        return held.checkpoint()
    finally:
        held.unpersist()


class Scratch:
    """Tables of one run in a folder of their own below the shared folder.

    ``keep`` writes a frame and reads it back, which cuts its lineage; ``remove`` deletes the
    folder, after which no frame read from it can be used.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self._spark = spark
        self.folder = f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self._spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def remove(self) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
