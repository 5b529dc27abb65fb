"""Session construction and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: State on local disk with changes written per batch; the default keeps all state in the executor's heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def get_session(app: str = "channelspark", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """The submitted session; with ``cpus`` (a number or ``*``) a local one for tests and benches.

    Master, memory and the number of shuffle partitions are only set for a local session.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session (tests, benches) may fall back to a temporary folder; on a cluster
    a machine-local folder would lose data with its executor, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="channelspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/channelspark/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own intermediate data, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write (or replace) one small file, wherever the path's file system is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
