"""Materialized views: one folder per view and group, refreshed when stale."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.operators.consensus import view
from placebook.schema import ALL_ROWS, FILE_ORDER, FORMATS, GROUP, SHEET_ROW_LIMIT, VIEW_KEYS, VIEWS
from placebook.session import freeing, rows_per_job, settle, tasks_for
from placebook.sinks.delimited import write_csv_groups
from placebook.sources.tables import GROUP_FOLDER, VIEW_FOLDER, folder_name, folder_value, read_files

PLACE = "_place"


def tagged_views(
    df: DataFrame, views: Sequence[str] = tuple(VIEWS), group: str = GROUP, count: int | None = None
) -> DataFrame:
    """Rows of several views with the two folder columns, out of one scan.

    Rows are ranged by group and dealt by their number: a small group lies in one task or
    two, while a group holding much of the table is split over as many as its rows call
    for. What that exchange gives is used by every view, as it is by the view of all rows. The
    others are one aggregation each, whose rows largely meet within their task already; the
    place of a row in the range keeps Spark from taking a group's rows for brought together,
    which would leave a whole group to one task. Their results are rebalanced in turn. The
    group column itself stays, so that folder names never have to be read back as values.
    ``count`` is the number of rows of groups, where it is known.
    """
    for name in views:
        _check(name)
    rows = df.where(F.col(group).isNotNull())
    placed = rows.withColumn(PLACE, F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(*tasks_for(rows, count), group, PLACE).drop(PLACE)
    parts = []
    for name in views:
        rows = view(dealt, name, group) if name == ALL_ROWS else view(dealt, name, group).hint("rebalance", group)
        parts.append(rows.withColumn(VIEW_FOLDER, F.lit(name)))
    return reduce(DataFrame.unionByName, parts).withColumn(GROUP_FOLDER, folder_name(F.col(group)))


def write_views(
    df: DataFrame,
    path: str,
    views: Sequence[str] = tuple(VIEWS),
    group: str = GROUP,
    mode: str = "error",
    count: int | None = None,
) -> None:
    """Write views for all groups at once, zstd-compressed: one scan, one job."""
    writer = tagged_views(df, views, group, count).write.mode(mode).partitionBy(VIEW_FOLDER, GROUP_FOLDER)
    writer.options(compression="zstd", partitionOverwriteMode="dynamic").parquet(path)


def _check(view_name: str, fmt: str = "parquet") -> None:
    if view_name not in VIEWS:
        raise ValueError(f"unknown view: {view_name}")
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")


def view_files(spark: SparkSession, path: str) -> DataFrame:
    """(view, group, bytes, modified) of a materialized folder, from its listing."""
    files = read_files(spark, path, "part-*")
    # Spark writes unsafe characters as %XX and leaves the plus sign as it is.
    named = lambda name: F.regexp_extract("path", rf"/{name}=([^/]*)/", 1)
    part = lambda name: F.url_decode(F.replace(named(name), F.lit("+"), F.lit("%2B")))
    return (
        files.select(
            part(VIEW_FOLDER).alias(VIEW_FOLDER), folder_value(part(GROUP_FOLDER)).alias(GROUP_FOLDER), "bytes", "modified"
        )
        .groupBy(VIEW_FOLDER, GROUP_FOLDER)
        .agg(F.sum("bytes").alias("bytes"), F.min("modified").alias("modified"))
    )


def staleness(
    groups: DataFrame, outputs: DataFrame | None, source_modified, views: Sequence[str] = tuple(VIEWS)
) -> DataFrame:
    """(view, group, stale): whether a pair must be written again.

    A pair is fresh only if its output is at least as new as the source table. A
    change anywhere in the source makes every pair stale.
    """
    wanted = groups.select(
        F.col(groups.columns[0]).alias(GROUP_FOLDER), F.explode(F.array(*map(F.lit, views))).alias(VIEW_FOLDER)
    )
    if outputs is None:
        return wanted.select(VIEW_FOLDER, GROUP_FOLDER, F.lit(True).alias("stale"))
    fresh = F.coalesce(F.col("modified") >= F.lit(source_modified), F.lit(False))
    return wanted.join(outputs, [VIEW_FOLDER, GROUP_FOLDER], "left").select(
        VIEW_FOLDER, GROUP_FOLDER, (~fresh).alias("stale")
    )


def refresh_views(
    spark: SparkSession,
    source: str,
    path: str,
    views: Sequence[str] = tuple(VIEWS),
    fmt: str = "parquet",
    group: str = GROUP,
) -> DataFrame:
    """Bring a materialized folder up to date and return what was stale.

    ``fmt`` is parquet or csv; sheets have no writer here, see :func:`sheet_rows`.
    Only stale groups are read and only their folders are replaced; the commit of
    each write is atomic for its reader. Pairs already up to date stay untouched.

    Groups too many for one job are written some after the others, each whole, and what a
    job shuffled is deleted before the next begins.
    """
    for name in views:
        _check(name, fmt)
    if fmt == "xlsx":
        raise ValueError("sheets are not written; see sheet_rows")
    with freeing(spark):
        return _refresh(spark, source, path, views, fmt, group)


def _refresh(spark: SparkSession, source: str, path: str, views: Sequence[str], fmt: str, group: str) -> DataFrame:
    df = spark.read.parquet(source)
    modified = read_files(spark, source, "*.parquet").agg(F.max("modified")).first()[0]
    sizes = settle(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_rows")), "sizes")
    outputs = view_files(spark, path) if _exists(spark, path) else None
    report = settle(staleness(sizes.select(group), outputs, modified, views), "staleness")
    due = report.where("stale").groupBy(F.col(GROUP_FOLDER).alias(group)).agg(F.sort_array(F.collect_set(VIEW_FOLDER)).alias("_lacking"))
    # Groups that lack the same views are one job, so that a row is read and dealt once, or
    # as many jobs as their rows call for.
    due = settle(due.join(sizes, group), "due")
    share = rows_per_job(due.agg(F.sum("_rows")).first()[0] or 0)
    before = F.sum("_rows").over(Window.partitionBy("_lacking").orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    lacking = settle(due.withColumn("_job", F.floor(F.coalesce(before, F.lit(0)) / share)), "lacking")
    jobs = lacking.groupBy("_lacking", "_job").agg(F.sum("_rows")).sort("_lacking", "_job")
    for names, job, count in jobs.collect():
        behind = lacking.where((F.col("_lacking") == F.array(*map(F.lit, names))) & (F.col("_job") == job)).select(group)
        rows = df.join(behind, group, "left_semi").select(*df.columns)
        if fmt == "csv":
            for name in names:
                export_csv(rows, path, name, group, "overwrite")
        else:
            write_views(rows, path, names, group, "overwrite", count)
    return report


def _exists(spark: SparkSession, path: str) -> bool:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        return not files.option("pathGlobFilter", "part-*").load(path).select("path").isEmpty()
    except Exception as error:  # the folder itself may be missing
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns as text, so that no reader takes a code for a number."""
    return df.select(
        *(F.col(c).cast("string").alias(c) if c in columns else F.col(c) for c in df.columns)
    )


def sheet_eligibility(
    df: DataFrame, group: str = GROUP, limit: int = SHEET_ROW_LIMIT
) -> DataFrame:
    """(group, rows, eligible): a group too long for a sheet is left out whole."""
    counted = df.groupBy(group).agg(F.count("*").alias("rows"))
    return counted.withColumn("eligible", F.col("rows") <= limit)


def sheet_rows(
    df: DataFrame, text: Sequence[str], group: str = GROUP, limit: int = SHEET_ROW_LIMIT
) -> DataFrame:
    """All rows of the groups that fit a sheet, text columns forced to text."""
    fits = settle(sheet_eligibility(df, group, limit).where("eligible").select(group), "sheets")
    fits = fits.select(F.col(group).alias("_group"))
    kept = df.join(fits, F.col(group).eqNullSafe(F.col("_group")), "left_semi")
    return as_text(kept, text)


def export_csv(
    df: DataFrame,
    path: str,
    name: str = ALL_ROWS,
    group: str = GROUP,
    mode: str = "error",
    order: Sequence[str] = (),
) -> None:
    """A view as text-safe CSV, with folders per view and group as for Parquet.

    ``order`` names columns of the view; rows of a group of any size are in that order.
    ``FILE_ORDER`` keeps that of the stored table and is itself not written.
    """
    _check(name, "csv")
    out = view(df, name, group).where(F.col(group).isNotNull())
    columns = [c for c in out.columns if c not in FILE_ORDER]
    out = out.withColumn("_folder", folder_name(F.col(group)))
    write_csv_groups(out, f"{path}/{VIEW_FOLDER}={name}", "_folder", order, columns, mode)
