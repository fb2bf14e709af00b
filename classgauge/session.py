"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "classgauge") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, pass your own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="classgauge-")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``).

    Fitted tables are written there, so a lost executor never costs a refit. Only
    a local master may go without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, computed once and read back from the shared folder."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    back.written_path = path
    return back


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made; the table can't be read after that."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing uses any more: it does when the driver's collector finds them, which a small heap may never do by itself."""
    spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Bytes a plan reads, by Spark's estimate of its scans: file sizes after pruning."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
