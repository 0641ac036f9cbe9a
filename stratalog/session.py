"""Session builder and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Removes the shuffle files of a query when it has ended; else they lie until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "12g"} | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where that is unset (tests) one of our own, which
    only a local master may use: executors on other machines would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.split("[")[0] == "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share: a folder of this machine does not do for {master}")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and what is read twice is computed once.

    Losing an executor loses nothing of the table. It lives until the driver ends, or ``dropped`` lets it go.
    """
    path = staged_path(df)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_path(df: DataFrame, *partitions: str) -> str:
    """The path of ``df`` written to the shared folder, for tasks that read it themselves by a file system of pyarrow."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stratalog-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffles of this write again
    try:
        (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    return path


def dropped(df: DataFrame) -> None:
    """Remove the tables that ``df``, the result of ``staged``, is read from; nothing may read them any more."""
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/stratalog-" in path:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has already ended
        pass
