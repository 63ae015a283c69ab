"""The complete build: views, samples and catalog from table and dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.operators import catalog as C
from placebook.operators.profile import profile
from placebook.operators.source_profile import source_profile
from placebook.schema import ALL_ROWS, COLUMNS, GROUP, VIEW_KEYS, VIEWS
from placebook.session import settle
from placebook.sinks.samples import (
    sample_rows,
    sample_sizes,
    source_sample_sizes,
    source_samples,
    write_samples,
    write_source_samples,
)
from placebook.sinks.views import view_files, write_views
from placebook.sources.delimited import SourceFiles, read_versioned_sources
from placebook.sources.tables import GROUP_FOLDER, VIEW_FOLDER, read_sources, read_views


class RawFiles(NamedTuple):
    """Source files of groups without rows, and what is known about them."""

    source: SourceFiles  # called by their paths, as read_versioned_sources reads them
    listing: DataFrame  # the same paths, as read_sources lists them


def raw_sources(spark: SparkSession, versions: DataFrame, master: DataFrame, root: str, group: str = GROUP) -> RawFiles:
    """The source files of groups that have no rows in ``master``, in the dialects the
    version table gives them; files that are not there are left to ``missing_sources``."""
    listing = settle(read_sources(spark, root), "sources")
    empty = versions.join(master.select(group).distinct(), group, "left_anti")
    there = empty.join(listing, F.col("selected_rel_path") == F.col("rel_path"), "left_semi")
    return RawFiles(read_versioned_sources(spark, there, root), listing)


def view_row_counts(written: DataFrame) -> DataFrame:
    """(iso2, view, rows) of the key views, counted where they are stored."""
    return (
        written.where(F.col(VIEW_FOLDER).isin(list(VIEW_KEYS)))
        .groupBy(F.col(GROUP_FOLDER).alias("iso2"), F.col(VIEW_FOLDER).alias("view"))
        .agg(F.count("*").alias("rows"))
    )


def build_entries(
    master: DataFrame,
    dims: C.Dimensions,
    order: Sequence[str],
    folder: str,
    raw: RawFiles | None = None,
    group: str = GROUP,
) -> DataFrame:
    """Write views and samples below ``folder`` and return the catalog entries.

    ``master`` holds the canonical columns and the columns of ``order``. Every step
    covers all groups at once; the number of jobs does not depend on theirs. With
    ``raw``, groups without rows are described by their source files, and all groups
    are as new as theirs.
    """
    spark = master.sparkSession
    if raw is not None:
        dims = replace(dims, versions=C.with_file_dates(dims.versions, raw.listing))
    write_views(master.select(*COLUMNS), f"{folder}/views", VIEWS, group)
    written = read_views(spark, f"{folder}/views")
    stored = settle(view_files(spark, f"{folder}/views"), "files")

    samples = settle(sample_rows(master, order, [*COLUMNS, *order], group), "samples")
    write_samples(samples, f"{folder}/samples", order, COLUMNS, group)

    none = F.lit(None)
    tables = stored.where(F.col(VIEW_FOLDER) == ALL_ROWS).select(
        F.col(GROUP_FOLDER).alias("iso2"), F.lit("parquet").alias("fmt"), "bytes",
        none.alias("raw"), none.alias("name"),
    )
    views = stored.where(F.col(VIEW_FOLDER) != ALL_ROWS).select(
        F.col(GROUP_FOLDER).alias("iso2"), F.col(VIEW_FOLDER).alias("view"), "bytes"
    )
    entries = settle(C.base_entries(dims, profile(master, order, group), group), "entries")
    covered = C.covered_entries(
        entries,
        C.file_map(tables, "fmt", "iso2"),
        C.view_maps(settle(view_row_counts(written), "counts"), "iso2"),
        C.view_file_maps(views, "iso2"),
    )
    sizes = sample_sizes(samples, COLUMNS, group).withColumnRenamed(group, "iso2")
    if raw is None:
        return settle(C.all_entries(covered, C.undescribed(entries), sizes), "catalog")
    named = entries.where(F.col("status") == C.NO_DATA).select("iso2", F.col("source_path").alias("file"))
    first = settle(source_samples(raw.source).join(named, "file"), "samples")
    write_source_samples(first, f"{folder}/source_samples", "iso2")
    sizes = sizes.unionByName(source_sample_sizes(first, "iso2"))
    files = C.raw_file_table(entries, raw.listing).withColumn("raw", F.lit(True))
    uncovered = C.raw_entries(entries, source_profile(raw.source), C.file_map(files, "fmt", "iso2"))
    return settle(C.all_entries(covered, uncovered, sizes), "catalog")
