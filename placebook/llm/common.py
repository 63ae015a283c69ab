"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.llm.arrays import forget
from placebook.session import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def within_arrow(
    batches: Iterable[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, most: int
) -> Iterator[pa.RecordBatch]:
    """Apply ``make`` to runs of rows whose text in ``column`` stays near ``most`` bytes.

    A single longer row makes a run of its own, so memory follows the longest row.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield make(batch.slice(begin, i - begin))
                begin, held = i, 0
            held += int(size)
        if begin < batch.num_rows:
            yield make(batch.slice(begin))
    # The worker stays for later tasks; what this one worked with does not.
    forget()
    pa.default_memory_pool().release_unused()


def block_offsets(totals: DataFrame, block: str, value: str, out: str) -> DataFrame:
    """Sums of ``value`` over all earlier blocks. One row per task's block comes in, so
    the single ordered pass here is over task counts, not over data."""
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(block, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long").alias(out))


def if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast behind a check: ``limit`` bounds the check itself; larger tables are
    left to Spark's own choice of join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
