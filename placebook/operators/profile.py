"""How completely each group fills its columns, for all groups in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.functions.absence import has_text, nan_to_null
from placebook.functions.scalars import level_label, percent
from placebook.operators.ranking import earliest
from placebook.schema import FILE_ORDER, GROUP, LEVEL_COLUMNS, LEVEL_ENTRY
from placebook.session import settle

ATTRIBUTES = ["country_iso3", "country_en", "country_lc", "continent_code", "continent_name"]

LevelColumns = dict[int, dict[str, str]]


def row_counts(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("rows"))


def _flags(columns: Sequence[str]) -> list[Column]:
    """1 where a column says something, 0 where not; named ``t_<column>``."""
    return [has_text(c).cast("int").alias(f"t_{c}") for c in dict.fromkeys(columns)]


def any_text(c: str) -> Column:
    """Aggregate over flags: does any row say something here?"""
    return F.coalesce(F.sum(f"t_{c}") > 0, F.lit(False))


def text_count(*columns: str) -> Column:
    """Aggregate over flags: rows in which at least one column says something."""
    either = reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"t_{c}") for c in columns])
    return F.coalesce(F.sum(either), F.lit(0))


def _level_counters(levels: LevelColumns) -> list[Column]:
    out = []
    for n, by_suffix in levels.items():
        out.append(text_count(*by_suffix.values()).alias(f"filled_{n}"))
        for suffix in ("en", "lc"):
            c = by_suffix.get(suffix)
            out.append((any_text(c) if c else F.lit(False)).alias(f"{suffix}_{n}"))
    return out


def _level_columns(levels: LevelColumns) -> list[str]:
    return [c for by_suffix in levels.values() for c in by_suffix.values()]


def depth(levels: LevelColumns) -> Column:
    """Deepest level that carries data; gaps above it do not matter."""
    reached = [F.when(F.col(f"filled_{n}") > 0, F.lit(n)).otherwise(F.lit(0)) for n in levels]
    return F.greatest(F.lit(0), *reached).cast("int")


def level_entries(levels: LevelColumns, has_codes: Column) -> Column:
    entries = [
        F.struct(
            F.lit(n).alias("level"),
            level_label(n, has_codes).alias("label"),
            percent(F.col(f"filled_{n}"), F.col("rows")).alias("filled_pct"),
            F.col(f"en_{n}").alias("has_en"),
            F.col(f"lc_{n}").alias("has_lc"),
        )
        for n in levels
    ]
    return F.array(*entries).cast(f"array<{LEVEL_ENTRY}>")


def first_entries(levels: Column, count: Column) -> Column:
    """The list cut to its first ``count`` entries, by position."""
    return F.filter(levels, lambda _, i: i < count)


def level_profile(
    df: DataFrame, group: str = GROUP, levels: LevelColumns = LEVEL_COLUMNS,
    codes: str = "region_1_iso_code",
) -> DataFrame:
    """One row per group and level, levels without data included."""
    flags = df.select(group, *_flags([*_level_columns(levels), codes]))
    counted = flags.groupBy(group).agg(
        F.count("*").alias("rows"), text_count(codes).alias("code_rows"), *_level_counters(levels)
    )
    entries = level_entries(levels, F.col("code_rows") > 0)
    return counted.select(group, F.inline(entries))


def coverage(
    df: DataFrame,
    group: str = GROUP,
    levels: LevelColumns = LEVEL_COLUMNS,
    codes: str = "region_1_iso_code",
    coordinate: str = "latitude",
    place: str = "place_name",
    bounds: Sequence[Column] = (),
) -> DataFrame:
    """Row count, depth, level list and coverage percentages per group.

    Only sums and minima of fixed width, so that Spark hashes instead of sorting.
    ``bounds`` are extra columns whose smallest value is returned alongside.
    """
    names = [f"_bound_{i}" for i in range(len(bounds))]
    flags = df.select(
        group,
        *_flags([*_level_columns(levels), codes, place]),
        nan_to_null(coordinate).alias("_coordinate"),
        *(b.alias(n) for b, n in zip(bounds, names)),
    )
    counted = flags.groupBy(group).agg(
        F.count("*").alias("rows"),
        *_level_counters(levels),
        F.count("_coordinate").alias("coord_rows"),
        text_count(codes).alias("code_rows"),
        any_text(place).alias("has_place_name"),
        *(F.min(n).alias(n) for n in names),
    )
    return counted.withColumn("admin_depth", depth(levels)).select(
        group,
        "rows",
        "admin_depth",
        first_entries(
            level_entries(levels, F.col("code_rows") > 0), F.col("admin_depth")
        ).alias("admin_levels"),
        percent(F.col("coord_rows"), F.col("rows")).alias("coord_coverage_pct"),
        "has_place_name",
        percent(F.col("code_rows"), F.col("rows")).alias("region_1_iso_coverage_pct"),
        *names,
    )


def _opening(
    candidates: DataFrame, order: Sequence[str], group: str, attributes: Sequence[str], example: str
) -> DataFrame:
    found = candidates.groupBy(group).agg(
        earliest(attributes, order).alias("_first"),
        earliest([example], order, F.col(example).isNotNull()).alias("_example"),
    )
    return found.select(
        group, "_first.*", F.col(f"_example.{example}").alias(f"{example}_example")
    )


def _bounds(order: Sequence[str], example: str) -> list[Column]:
    last = order[-1]
    return [F.col(last), F.when(F.col(example).isNotNull(), F.col(last))]


def _within(df: DataFrame, bounds: DataFrame, keys: Sequence[str], last: str) -> DataFrame:
    """The rows that carry one of their keys' two smallest values of ``last``, or none
    at all: nulls come first in the order."""
    wanted = bounds.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "_bound_0", "_bound_1")
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    near = F.col(last).isNull() | (F.col(last) == F.col("_bound_0")) | (F.col(last) == F.col("_bound_1"))
    return df.join(wanted, reduce(lambda a, b: a & b, [*same, near]), "left_semi")


def _fixed_width(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType))


def opening_values(
    df: DataFrame,
    order: Sequence[str] = tuple(FILE_ORDER),
    group: str = GROUP,
    attributes: Sequence[str] = tuple(ATTRIBUTES),
    example: str = "postal_code",
) -> DataFrame:
    """Attributes of each group's first row, and its first non-null example.

    Keeping text as aggregate state would make Spark sort every row by group. So the
    smallest leading order value per group is found first, which only hashes; the few
    rows that carry it are then ranked by the full order. A path leading a number, as in
    ``FILE_ORDER``, is a key beside the group: one row per group and file is left of the
    table. Any other order led by text takes the sorting way.
    """
    present = df.where(F.col(group).isNotNull())
    needed = list(dict.fromkeys([group, *order, *attributes, example]))
    if _fixed_width(df, order[0]):
        keys, lead = [group], [order[0]]
    elif len(order) == 2 and _fixed_width(df, order[1]):
        keys, lead = [group, order[0]], list(order)
    else:
        return _opening(present.select(*needed), order, group, attributes, example)
    first, with_example = _bounds(lead, example)
    bounds = present.groupBy(*keys).agg(F.min(first).alias("_bound_0"), F.min(with_example).alias("_bound_1"))
    near = _within(present.select(*needed), settle(bounds, "bounds"), keys, lead[-1])
    return _opening(near, order, group, attributes, example)


def profile(
    df: DataFrame,
    order: Sequence[str] = tuple(FILE_ORDER),
    group: str = GROUP,
    levels: LevelColumns = LEVEL_COLUMNS,
    attributes: Sequence[str] = tuple(ATTRIBUTES),
    example: str = "postal_code",
    **columns: str,
) -> DataFrame:
    """:func:`coverage` and :func:`opening_values` together, one row per group.

    The counting pass finds the leading order values as well, so two passes do.
    """
    lead = order[0]
    present = df.where(F.col(group).isNotNull())
    if not _fixed_width(df, lead):
        return coverage(present, group, levels, **columns).join(
            opening_values(present, order, group, attributes, example), group
        )
    bounds = _bounds([lead], example)
    counted = settle(coverage(present, group, levels, bounds=bounds, **columns), "profile")
    needed = list(dict.fromkeys([group, *order, *attributes, example]))
    near = _within(present.select(*needed), counted, [group], lead)
    return counted.drop("_bound_0", "_bound_1").join(
        _opening(near, order, group, attributes, example), group
    )
