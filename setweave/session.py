"""Session factory, session tuning and shared-folder tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every plan here relies on; none of them depends on the size of the data.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    # Shuffle files go when their query ends, so a job of many passes holds the files of one pass only.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: Applications whose tables are removed when this process ends.
_tidied: set[str] = set()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session with the tuning above; used by tests and bench."""
    b = SparkSession.builder.master(master).appName("setweave").config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in {**TUNING, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for k, v in TUNING.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where the setting is absent."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        jd = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jd.isDefined():
            return jd.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="setweave-")
        spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return d


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder; what is left there goes when the process ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/setweave/{spark.sparkContext.applicationId}"
    if folder not in _tidied:
        _tidied.add(folder)
        atexit.register(_tidy, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _tidy(spark: SparkSession, folder: str) -> None:
    try:
        drop_path(spark, folder)
    except Exception:  # noqa: BLE001 - the session ended first, or the folder is gone
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor costs nothing."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._setweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that materialize wrote and nothing reads any more."""
    drop_path(df.sparkSession, df._setweave_path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table under path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [int(n.getName()) for n in names if n.getName().isdigit() and fs.exists(done(n, "_SUCCESS"))]
