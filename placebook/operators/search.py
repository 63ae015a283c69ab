"""Substring search over many columns, on rows and through consensus views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from placebook.functions.absence import column
from placebook.operators.consensus import consensus, distinct_keys
from placebook.schema import (
    ALL_ROWS,
    GROUP,
    NEEDLE_MAX,
    PREVIEW_DEFAULT,
    PREVIEW_MAX,
    SEARCH_COLUMNS,
    VIEW_KEYS,
)
from placebook.session import settle


def in_group(df: DataFrame, code: str, group: str = GROUP) -> DataFrame:
    """Rows of one group. The code is upper-cased here, so the scan gets a constant."""
    return df.where(F.col(group) == code.upper())


def matches(needle: str, columns: Sequence[str] = tuple(SEARCH_COLUMNS)) -> Column | None:
    """Case-insensitive *contains* over any of the columns, or None for no filter.

    ``%``, ``_`` and ``\\`` stand for themselves. Null columns never match.
    """
    needle = needle.strip()
    if not needle:
        return None
    part = F.lower(F.lit(needle))
    return reduce(
        lambda a, b: a | b,
        [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), part), F.lit(False)) for c in columns],
    )


def search_rows(
    df: DataFrame, needle: str, columns: Sequence[str] = tuple(SEARCH_COLUMNS)
) -> DataFrame:
    clause = matches(needle, columns)
    return df if clause is None else df.where(clause)


def search_view(
    df: DataFrame,
    needle: str,
    keys: Sequence[str],
    scope: Sequence[str] = (GROUP,),
    columns: Sequence[str] = tuple(SEARCH_COLUMNS),
) -> DataFrame:
    """Search what the view shows: a blanked value cannot match."""
    return search_rows(consensus(df, keys, scope), needle, columns)


def search_via_source(
    df: DataFrame,
    needle: str,
    keys: Sequence[str],
    scope: Sequence[str] = (GROUP,),
    columns: Sequence[str] = tuple(SEARCH_COLUMNS),
    view: DataFrame | None = None,
) -> DataFrame:
    """View rows whose source rows match, including by values the view blanks.

    The distinct keys of matching rows are settled first, so that a small set of them is
    broadcast. A null-safe semi join by them then picks rows of the materialized
    ``view`` or, without one, the source rows of these keys; only those are aggregated.
    """
    clause = matches(needle, columns)
    if clause is None:
        return consensus(df, keys, scope) if view is None else view
    matching = settle(distinct_keys(df.where(clause), keys, scope), "matches")
    chosen = null_safe_semi(df if view is None else view, matching, [*scope, *keys])
    return consensus(chosen, keys, scope) if view is None else chosen


def null_safe_semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys occur in ``right``, null matching null."""
    renamed = right.select(*(F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)))
    condition = reduce(
        lambda a, b: a & b,
        [column(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)],
    )
    return left.join(renamed, condition, "left_semi")


def first_rows(df: DataFrame, order: Sequence[str], limit: int = PREVIEW_DEFAULT) -> DataFrame:
    """The first rows in ``order``; Spark keeps that many per task and merges them."""
    return df.orderBy(*order).limit(limit)


def match_summary(found: DataFrame, limit: int = PREVIEW_DEFAULT) -> DataFrame:
    """One row: how many matched, how many are shown, whether some are left out."""
    matched = F.count("*")
    return found.agg(
        matched.alias("matched"),
        F.least(matched, F.lit(limit)).alias("shown"),
        (matched > limit).alias("truncated"),
    )


def page_of(found: DataFrame, order: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows and the summary of all, in one evaluation.

    The rows are counted as they pass on the way to the top of the order. That is done
    by tasks of the last stage, which count once however often they are tried. At most
    ``limit`` rows come to the driver, where a page is bound for anyway.
    """
    spark, passed = found.sparkSession, Observation()
    rows = first_rows(found.observe(passed, F.count("*").alias("matched")), order, limit).collect()
    matched = passed.get.get("matched", len(rows))
    summary = [(matched, len(rows), matched > limit)]
    return (
        spark.createDataFrame(rows, found.schema),
        spark.createDataFrame(summary, "matched bigint, shown bigint, truncated boolean"),
    )


def preview(
    df: DataFrame,
    code: str,
    order: Sequence[str],
    needle: str = "",
    view: str = ALL_ROWS,
    limit: int = PREVIEW_DEFAULT,
    stored: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, one-row summary) for one group, as a browsing user sees it: evaluated here,
    once for both.

    ``stored`` is the materialized view, where there is one; it is searched by the keys
    of matching source rows instead of being computed again.
    """
    if len(needle) > NEEDLE_MAX:
        raise ValueError(f"search text is limited to {NEEDLE_MAX} characters")
    if not 1 <= limit <= PREVIEW_MAX:
        raise ValueError(f"limit must be between 1 and {PREVIEW_MAX}")
    if view != ALL_ROWS and view not in VIEW_KEYS:
        raise ValueError(f"unknown view: {view}")
    rows = in_group(df, code)
    if view == ALL_ROWS:
        found = search_rows(rows, needle)
    else:
        of_group = None if stored is None else in_group(stored, code)
        found = search_via_source(rows, needle, VIEW_KEYS[view], view=of_group)
    return page_of(found, order, limit)
