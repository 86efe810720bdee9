"""Session helpers: settings a stand-alone run needs, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "inkquarry", conf: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and benches on one machine. On a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config(map=conf or {})
        .getOrCreate()
    )


#: Tables written by this process and not yet removed.
_WRITTEN: list[str] = []


def clear(spark: SparkSession) -> int:
    """Removes the tables that ``stored`` wrote; to be called when all results have been read. Returns their number."""
    jvm, n = spark._jvm, 0
    conf = spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local master may fall back to a folder of this machine."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "inkquarry-shared")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    Cuts the lineage, so what several later steps read is computed once and the loss of an executor costs nothing. The
    files stay until ``clear`` or the caller's cluster removes them: results are lazy and read them later.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
