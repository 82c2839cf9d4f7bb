"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error, as a machine-local folder would be
    unreadable for the other executors.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or _own.get(sc.applicationId)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="textloom-"))


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it.

    Survives the loss of executors, and later readers prune columns. The table goes when the driver ends, or with ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def release(spark: SparkSession) -> int:
    """Deletes all tables that ``materialize`` wrote in this application; to be called when their results have been consumed. Returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)
    return len(paths)
