"""One honest row per key: keep what all rows agree on, blank the rest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.functions.absence import opinion
from placebook.schema import GROUP, VIEW_KEYS

HIT = "_hit"
HASH = "_hash"


def _agreed(field: T.StructField) -> Column:
    """Aggregate of one column over its opinions.

    One distinct value: that value. None at all: null. Several: the empty string
    for text, null for anything else. ``min`` and ``max`` settle all three cases
    with constant state per key, whatever the number of distinct values.
    """
    low, high = F.min(field.name), F.max(field.name)
    blank = F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(None)
    return F.when(low == high, high).when(low.isNotNull(), blank).alias(field.name)


def consensus(
    df: DataFrame,
    keys: Sequence[str],
    scope: Sequence[str] = (),
    hit: Column | None = None,
) -> DataFrame:
    """One row per distinct ``scope`` + ``keys``, in the column order of ``df``.

    Keys are compared as they are, so null, ``''`` and ``' '`` are three keys.
    The rows of a hot key collapse to one per map task before the single shuffle.
    With ``hit``, only keys for which some row satisfies it are returned.

    String state makes Spark aggregate by sorting. A hash of the keys leads the
    grouping so that the sort compares one number, not a list of strings.

    Do not feed a result back in: a blanked disagreement would read as absence.
    """
    grouping = [*scope, *(k for k in keys if k not in scope)]
    fields = [f for f in df.schema if f.name not in grouping]
    if not fields and hit is None:
        return distinct_keys(df, keys, scope).select(*df.columns)
    spoken = df.select(
        F.xxhash64(*grouping).alias(HASH),
        *grouping,
        *(opinion(f).alias(f.name) for f in fields),
        *([] if hit is None else [F.coalesce(hit, F.lit(False)).alias(HIT)]),
    )
    values = [_agreed(f) for f in fields]
    if hit is not None:
        values.append(F.bool_or(HIT).alias(HIT))
    out = spoken.groupBy(HASH, *grouping).agg(*values)
    return (out if hit is None else out.where(HIT)).select(*df.columns)


def view(df: DataFrame, name: str, group: str = GROUP) -> DataFrame:
    """A named view of the canonical table; ``all_rows`` is the table itself."""
    return consensus(df, VIEW_KEYS[name], [group]) if name in VIEW_KEYS else df


def distinct_keys(df: DataFrame, keys: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    return df.select(*scope, *(k for k in keys if k not in scope)).distinct()


def distinct_counts(
    df: DataFrame, key_sets: dict[str, Sequence[str]], scope: Sequence[str]
) -> DataFrame:
    """(scope, view, rows): distinct key combinations, null being a value.

    Rows meet on scope + keys, never on the scope alone, so a scope holding a
    large part of the table still spreads over all tasks.
    """
    counts = [
        distinct_keys(df, keys, scope)
        .groupBy(*scope)
        .agg(F.count("*").alias("rows"))
        .select(*scope, F.lit(name).alias("view"), "rows")
        for name, keys in key_sets.items()
    ]
    return reduce(DataFrame.unionByName, counts)
