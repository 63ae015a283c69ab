"""First rows per group, and first occurrences, under an explicit order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebook.session import settle

RANK = "_rank"
LANE = "_lane"
BOUND = "_bound"


def first_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    n: int,
    rank: str | None = None,
    lanes: int = 64,
) -> DataFrame:
    """The first ``n`` rows of every group.

    Each map task keeps at most ``n`` rows per group before anything moves. What
    is left meets in ``lanes`` sub-groups first, so that with very many map tasks
    a hot group never sends all of its candidates to one task.
    """
    candidates = df
    if lanes > 1:
        lane = F.pmod(F.spark_partition_id(), F.lit(lanes))
        within = Window.partitionBy(*group, LANE).orderBy(*order)
        candidates = (
            df.withColumn(LANE, lane)
            .withColumn(RANK, F.row_number().over(within))
            .where(F.col(RANK) <= n)
            .drop(LANE, RANK)
        )
    name = rank or RANK
    over_all = Window.partitionBy(*group).orderBy(*order)
    out = candidates.withColumn(name, F.row_number().over(over_all)).where(F.col(name) <= n)
    return out if rank else out.drop(RANK)


def first_per_group_wide(
    df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, lanes: int = 64
) -> DataFrame:
    """The same for wide rows: only groups and order columns are sorted.

    They give, per group, the place in the order of the last of the first ``n``. Whole
    rows are then read up to that place, and the few there are get ranked.
    """
    keys = first_per_group(df.select(*group, *order), group, order, n, lanes=lanes)
    bounds = settle(keys.groupBy(*group).agg(F.max(F.struct(*order)).alias(BOUND)), "bounds")
    renamed = bounds.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), BOUND)
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    # Structs compare field by field, nulls first, as rows are ordered.
    within = F.struct(*order) <= F.col(BOUND)
    near = df.join(renamed, reduce(lambda a, b: a & b, [*same, within]), "left_semi")
    return first_per_group(near, group, order, n, lanes=1)


def earliest(attributes: Sequence[str], order: Sequence[str], where: Column | None = None) -> Column:
    """Aggregate: the attributes of the first row, all taken from that same row."""
    row = F.struct(*attributes)
    if where is not None:
        row = F.when(where, row)
    key = F.struct(*order) if where is None else F.when(where, F.struct(*order))
    return F.min_by(row, key)


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A dimension table with one row per key, so that joining it never multiplies rows.

    Of several rows of a key the greatest is taken, column by column.
    """
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row"))
    return one.select(*keys, "_row.*")


def first_occurrences(df: DataFrame, key: Column, position: str, alias: str) -> DataFrame:
    """Each key once, at the place where it first came up."""
    return df.groupBy(key.alias(alias)).agg(F.min(position).alias(position))

