"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# What the operators rely on. Everything about size (executors, memory, shuffle
# width) is left to the cluster; AQE coalesces or splits from there.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partition folders hold codes such as 01067: never guess their type.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Source files come in code pages beyond the few Spark allows by default.
    "spark.sql.legacy.javaCharsets": "true",
}

# Rows that a task may sort at once, where rows are wide: some 0.2 GB of memory.
ROWS_PER_TASK = 500_000
# A job that moves whole rows takes a table of up to so many at once, and a larger one in
# so many shares: what it shuffles stays on disk until it ends.
ROWS_PER_JOB = 5_000_000
JOBS = 4
FREE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CHECKPOINT_KEY = "spark.checkpoint.dir"
_FOLDERS: set[str] = set()


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session's own that every executor can reach.

    It lies in the folder that ``spark.checkpoint.dir`` names or, where that is unset,
    beside the tables in ``spark.sql.warehouse.dir``, which executors share as well. It
    is deleted when the session ends.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/placebook-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS.add(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an aggregate to the shared folder once and read it back.

    The plan above it then sees the true byte size, so Spark broadcasts it only
    when it is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins
    by shuffle. It also ends the lineage: a lost executor costs a re-read, not a
    re-run of the aggregate.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Lets every action delete what it shuffled as it ends.

    Otherwise these files stay on the executors until the driver happens to collect its
    garbage, which it hardly has to while executors do the work.
    """
    before = spark.conf.get(FREE_KEY, None)
    spark.conf.set(FREE_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_KEY)
        else:
            spark.conf.set(FREE_KEY, before)


def rows_per_job(rows: int) -> int:
    """How many of a table's rows one job moves."""
    return max(ROWS_PER_JOB, -(-rows // JOBS))


def tasks_for(df: DataFrame, rows: int | None = None) -> list[int]:
    """The number of tasks that ``df`` is to be dealt to, as arguments of ``repartition``.

    Nothing while the cores at hand are enough: AQE then chooses by bytes. It would go on
    by bytes for large tables, and a task's memory with the rows that these bytes hold.
    The rows of stored tables are counted from their footers, unless their number is known.
    """
    tasks = -(-(df.count() if rows is None else rows) // ROWS_PER_TASK)
    return [tasks] if tasks > df.sparkSession.sparkContext.defaultParallelism else []
