"""Profiles of source files whose meaning must be read off their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebook.functions.absence import has_text, strip
from placebook.functions.scalars import percent
from placebook.operators.profile import first_entries
from placebook.schema import LEVEL_ENTRY
from placebook.session import settle
from placebook.sources.delimited import SourceFiles

# Header patterns, matched on the stripped lower-case header.
LEVEL_PATTERN = r"^region_?(\d)_?(lc|en)?$"
RANK_PATTERN = r"^order(\d+)_name$"
LATITUDE_HEADERS = ["latitude", "lat"]
PLACE_HEADER = "place_name"


def unique_headers(headers: DataFrame) -> DataFrame:
    """Headers repeated letter by letter get ``.1``, ``.2`` … on their later copies."""
    same = Window.partitionBy("file", "header").orderBy("ordinal")
    copy = F.row_number().over(same) - 1
    unique = F.when(copy > 0, F.concat("header", F.lit("."), copy)).otherwise(F.col("header"))
    return headers.select("file", "ordinal", unique.alias("header"))


def normalized_headers(headers: DataFrame) -> DataFrame:
    """(file, name, position, ordinal, header), one row per normalized header.

    Of headers equal after stripping and lower-casing, the last one supplies the
    data while the first one keeps its place.
    """
    return unique_headers(headers).groupBy("file", F.lower(strip("header")).alias("name")).agg(
        F.min("ordinal").alias("position"),
        F.max("ordinal").alias("ordinal"),
        F.max_by("header", "ordinal").alias("header"),
    )


def _group(name: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(name, pattern, i)


def ranked_headers(names: DataFrame) -> DataFrame:
    """(file, level, suffix, ordinal) for headers numbered by rank, not by level.

    The numbers only give an order; levels are counted 1, 2, 3 … along it.
    """
    number = _group(F.col("name"), RANK_PATTERN, 1).try_cast("bigint")
    ranked = names.where(number.isNotNull())
    by_number = Window.partitionBy("file").orderBy(number, "header")
    return ranked.select(
        "file", F.row_number().over(by_number).alias("level"), F.lit("en").alias("suffix"), "ordinal"
    )


def level_headers(names: DataFrame) -> DataFrame:
    """(file, level, suffix, ordinal): which column carries which level.

    A level header without a suffix counts as ``lc``. If two headers claim the
    same level and suffix the later one counts. Ranked headers are only looked at
    in files that have no level header at all.
    """
    level = _group(F.col("name"), LEVEL_PATTERN, 1).try_cast("int")
    suffix = F.coalesce(F.nullif(_group(F.col("name"), LEVEL_PATTERN, 2), F.lit("")), F.lit("lc"))
    named = (
        names.where(level.isNotNull())
        .groupBy("file", level.alias("level"), suffix.alias("suffix"))
        .agg(F.max_by("ordinal", "position").alias("ordinal"))
    )
    without = names.join(named.select("file").distinct(), "file", "left_anti")
    return named.unionByName(ranked_headers(without))


def _shape(headers: DataFrame) -> DataFrame:
    """One row per file: its levels with their ordinals, and what else it offers."""
    names = normalized_headers(headers)
    by_level = (
        level_headers(names)
        .groupBy("file", "level")
        .agg(
            F.collect_list("ordinal").alias("ordinals"),
            F.bool_or(F.col("suffix") == "en").alias("has_en"),
            F.bool_or(F.col("suffix") == "lc").alias("has_lc"),
        )
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("level", "ordinals", "has_en", "has_lc"))).alias("levels"))
    )
    latitude = [F.max(F.when(F.col("name") == h, F.col("ordinal"))) for h in LATITUDE_HEADERS]
    other = names.groupBy("file").agg(
        F.bool_or(F.col("name") == PLACE_HEADER).alias("has_place_name"),
        F.coalesce(*latitude).alias("latitude"),
    )
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "header")))
    columns = unique_headers(headers).groupBy("file").agg(
        F.transform(listed, lambda x: x.header).alias("source_columns")
    )
    return other.join(columns, "file").join(by_level, "file", "left")


def _fill_counts(source: SourceFiles, shape: DataFrame) -> DataFrame:
    """(file, records, located, filled): counts per file, ``filled`` by level.

    Each record is judged where it lies, once for all counts: its coordinate stands beside
    its levels as the one that has no number. What moves is one counter per file and
    level from each task, so a file holding much of the data is no hot spot.
    """
    says = lambda ordinal: has_text(F.get("fields", ordinal))
    mark = lambda level, filled: F.struct(level.cast("int").alias("level"), filled.cast("int").alias("filled"))
    of_levels = F.transform("levels", lambda x: mark(x.level, F.exists(x.ordinals, says)))
    located = F.array(mark(F.lit(None), F.coalesce(says(F.col("latitude")), F.lit(False))))
    judged = source.records.join(shape.select("file", "levels", "latitude"), "file").select(
        "file", F.inline(F.concat(located, F.coalesce(of_levels, F.slice(located, 1, 0))))
    )
    own = F.col("level").isNull()
    counted = judged.groupBy("file", "level").agg(F.count("*").alias("records"), F.sum("filled").alias("filled"))
    marked = F.collect_list(F.when(~own, F.struct("level", "filled")))
    return counted.groupBy("file").agg(
        F.max(F.when(own, F.col("records"))).alias("records"),
        F.max(F.when(own, F.col("filled"))).alias("located"),
        F.when(F.size(marked) > 0, F.map_from_entries(marked)).alias("filled"),
    )


def source_levels(source: SourceFiles) -> DataFrame:
    """(file, rows, level, filled, has_en, has_lc) for every declared level."""
    shape = settle(_shape(source.headers), "shape")
    counts = _fill_counts(source, shape)
    return (
        shape.select("file", F.inline("levels"))
        .join(counts, "file", "left")
        .select(
            "file",
            F.coalesce("records", F.lit(0)).alias("rows"),
            "level",
            F.coalesce(F.element_at("filled", F.col("level")), F.lit(0)).alias("filled"),
            "has_en",
            "has_lc",
        )
    )


def source_profile(source: SourceFiles) -> DataFrame:
    """One catalog-shaped profile per file, for any number of files in one job.

    The level list is cut to its first ``admin_depth`` entries by position, not by
    level number. ``rows`` is 0: these files add no rows to the canonical table.
    """
    shape = settle(_shape(source.headers), "shape")
    records = F.coalesce("records", F.lit(0))
    filled = lambda x: F.coalesce(F.element_at("filled", x.level), F.lit(0))
    entries = F.transform(
        "levels",
        lambda x: F.struct(
            x.level.alias("level"),
            F.concat(F.lit("Level "), x.level.cast("string")).alias("label"),
            percent(filled(x), records).alias("filled_pct"),
            x.has_en.alias("has_en"),
            x.has_lc.alias("has_lc"),
        ),
    ).cast(f"array<{LEVEL_ENTRY}>")
    reached = F.filter("levels", lambda x: filled(x) > 0)
    depth = F.coalesce(F.array_max(F.transform(reached, lambda x: x.level)), F.lit(0)).cast("int")
    none = F.array().cast(f"array<{LEVEL_ENTRY}>")
    return (
        shape.join(_fill_counts(source, shape), "file", "left")
        .withColumn("admin_depth", depth)
        .select(
            "file",
            F.lit(0).cast("bigint").alias("rows"),
            "admin_depth",
            first_entries(F.coalesce(entries, none), F.col("admin_depth")).alias("admin_levels"),
            percent(F.coalesce("located", F.lit(0)), records).alias("coord_coverage_pct"),
            "has_place_name",
            F.lit(None).cast("string").alias("postal_code_example"),
            F.lit(0.0).alias("region_1_iso_coverage_pct"),
            "source_columns",
        )
    )
