"""Assembling the coverage catalog from profiles and dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebook.functions.scalars import base_name, whole_number
from placebook.operators.ranking import one_per_key
from placebook.schema import FILE_ENTRY, GROUP, LEVEL_ENTRY, entry_type

COVERED, NO_DATA = "covered", "delivered_no_data"

NOTE = "The delivered file has no usable codes; the download is that file as it came."


@dataclass(frozen=True)
class Dimensions:
    """The small tables a catalog is built from; see the README for their columns."""

    versions: DataFrame  # country_iso2, selected_rel_path, selected_batch, n_rows, last_updated
    countries: DataFrame  # country_iso2, country_iso3, country_en, continent_code, continent_name
    no_postal: DataFrame  # country_iso2
    numeric: DataFrame  # alpha_2, numeric
    languages: DataFrame  # country_iso2, language
    translations: DataFrame  # country_iso2, language, name_lc


def status_of(rows: Column) -> Column:
    return F.when(F.coalesce(rows, F.lit(0)) > 0, COVERED).otherwise(NO_DATA)


def with_status(versions: DataFrame, stats: DataFrame, group: str = GROUP) -> DataFrame:
    """The version table, which decides what groups there are, with their profiles."""
    return versions.join(stats, group, "left").withColumn("status", status_of(F.col("rows")))


def with_numeric(df: DataFrame, numeric: DataFrame, group: str = GROUP) -> DataFrame:
    codes = numeric.select(F.col("alpha_2").alias(group), F.col("numeric").alias("iso_numeric"))
    return df.join(one_per_key(codes, [group]), group, "left")


def without_numeric(versions: DataFrame, numeric: DataFrame, group: str = GROUP) -> DataFrame:
    codes = numeric.select(F.col("alpha_2").alias(group))
    return versions.select(group).join(codes, group, "left_anti")


def with_names(
    df: DataFrame,
    countries: DataFrame,
    languages: DataFrame,
    translations: DataFrame,
    group: str = GROUP,
) -> DataFrame:
    """Names and continents: from the table's own rows if covered, even where those
    are null; else from the reference; the name at last from the code itself."""
    ref = countries.select(
        group,
        *(F.col(c).alias(f"_{c}") for c in ("country_iso3", "country_en", "continent_code", "continent_name")),
    )
    names = one_per_key(translations.select(group, "language", "name_lc"), [group, "language"])
    spoken = one_per_key(languages.select(group, "language"), [group])
    local = spoken.join(names, [group, "language"]).select(group, F.col("name_lc").alias("_name_lc"))
    covered = F.col("status") == COVERED
    pick = lambda own, other: F.when(covered, F.col(own)).otherwise(other)
    return (
        df.join(one_per_key(ref, [group]), group, "left")
        .join(local, group, "left")
        .withColumns(
            {
                "iso3": pick("country_iso3", F.col("_country_iso3")),
                "name_en": pick("country_en", F.coalesce("_country_en", group)),
                "name_lc": pick("country_lc", F.col("_name_lc")),
                "_code": pick("continent_code", F.col("_continent_code")),
                "_name": pick("continent_name", F.col("_continent_name")),
            }
        )
        .drop("continent_code", "continent_name")
        .withColumnsRenamed({"_code": "continent_code", "_name": "continent_name"})
    )


def unreported(statuses: DataFrame, no_postal: DataFrame, group: str = GROUP) -> DataFrame:
    """Groups without rows that the no-code report does not list."""
    empty = statuses.where(F.col("status") == NO_DATA).select(group)
    return empty.join(no_postal.select(group), group, "left_anti")


def file_map(files: DataFrame, key: str, group: str = GROUP) -> DataFrame:
    """(group, files): format → {bytes, raw, name}, from one row per file."""
    entry = F.struct("bytes", "raw", "name").cast(FILE_ENTRY)
    pairs = F.collect_list(F.struct(F.col(key).alias("key"), entry.alias("value")))
    return files.groupBy(group).agg(F.map_from_entries(pairs).alias("files"))


def view_maps(stats: DataFrame, group: str = GROUP) -> DataFrame:
    """(group, view_stats) from (group, view, rows)."""
    value = F.struct(F.col("rows").cast("bigint").alias("rows"))
    pairs = F.collect_list(F.struct(F.col("view").alias("key"), value.alias("value")))
    return stats.groupBy(group).agg(F.map_from_entries(pairs).alias("view_stats"))


def view_file_maps(files: DataFrame, group: str = GROUP) -> DataFrame:
    """(group, view_files) from (group, view, bytes)."""
    entry = F.struct("bytes", F.lit(None).alias("raw"), F.lit(None).alias("name")).cast(FILE_ENTRY)
    value = F.create_map(F.lit("parquet"), entry)
    pairs = F.collect_list(F.struct(F.col("view").alias("key"), value.alias("value")))
    return files.groupBy(group).agg(F.map_from_entries(pairs).alias("view_files"))


def base_entries(
    dims: Dimensions, profiles: DataFrame, group: str = GROUP, example: str = "postal_code_example"
) -> DataFrame:
    """The fields every entry has, before the fields of its status are added."""
    joined = with_status(dims.versions, profiles, group)
    joined = with_numeric(joined, dims.numeric, group)
    joined = with_names(joined, dims.countries, dims.languages, dims.translations, group)
    return joined.select(
        F.col(group).alias("iso2"),
        "iso3",
        "iso_numeric",
        "name_en",
        "name_lc",
        "continent_code",
        "continent_name",
        "status",
        "last_updated",
        base_name("selected_rel_path").alias("source_file"),
        F.col("selected_rel_path").alias("source_path"),
        F.col("selected_batch").alias("source_batch"),
        whole_number("n_rows").alias("source_rows"),
        "rows",
        "admin_depth",
        "admin_levels",
        "coord_coverage_pct",
        "has_place_name",
        F.col(example).alias("postal_code_example"),
        "region_1_iso_coverage_pct",
    )


def covered_entries(
    entries: DataFrame,
    files: DataFrame,
    view_stats: DataFrame,
    view_files: DataFrame,
) -> DataFrame:
    """Covered groups with their file, view counts and view files, keyed by iso2."""
    return (
        entries.where(F.col("status") == COVERED)
        .join(files, "iso2", "left")
        .join(view_stats, "iso2", "left")
        .join(view_files, "iso2", "left")
    )


def raw_entries(entries: DataFrame, source_profiles: DataFrame, files: DataFrame) -> DataFrame:
    """Groups without rows, described by their source files, whose profiles are called by
    the path that the version table selects."""
    kept = entries.where(F.col("status") == NO_DATA).select(
        "iso2", "iso3", "iso_numeric", "name_en", "name_lc", "continent_code", "continent_name",
        "status", "last_updated", "source_file", "source_path", "source_batch", "source_rows",
    )
    profiles = source_profiles.withColumnRenamed("file", "source_path")
    described = {"rows": F.coalesce("rows", F.lit(0)), "admin_depth": F.coalesce("admin_depth", F.lit(0))}
    return (
        kept.join(profiles, "source_path", "left")
        .join(files, "iso2", "left")
        .withColumns({**described, "files_are_source": F.lit(True), "note": F.lit(NOTE)})
    )


def undescribed(entries: DataFrame) -> DataFrame:
    """Groups without rows whose source files nobody has profiled."""
    described = ["rows", "admin_depth", "admin_levels"]
    return entries.where(F.col("status") == NO_DATA).drop(*described).withColumns(
        {
            "rows": F.lit(0),
            "admin_depth": F.lit(0),
            "admin_levels": F.array().cast(f"array<{LEVEL_ENTRY}>"),
            "files": F.lit(None).cast(f"map<string,{FILE_ENTRY}>"),
            "files_are_source": F.lit(True),
            "note": F.lit(NOTE),
        }
    )


def all_entries(covered: DataFrame, raw: DataFrame, samples: DataFrame) -> DataFrame:
    """Both kinds in one table. Fields one kind lacks are null there."""
    sample = samples.select("iso2", F.struct("bytes", "rows").alias("sample_csv"))
    both = covered.unionByName(raw, allowMissingColumns=True).join(sample, "iso2", "left")
    fields = entry_type().fields
    return both.select(
        *(
            (F.col(f.name) if f.name in both.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        )
    )


def total_aggregates() -> list[Column]:
    """Grand totals. Continents count covered groups only, dates count all."""
    covered = F.col("status") == COVERED
    continent = F.when(covered & (F.coalesce("continent_name", F.lit("")) != ""), F.col("continent_name"))
    parquet = F.coalesce(F.element_at("files", "parquet")["bytes"], F.lit(0))
    sample = F.coalesce("sample_csv.bytes", F.lit(0))
    return [
        F.count_if(covered).alias("countries"),
        F.count("*").alias("countries_with_files"),
        F.count_if(~covered).alias("delivered_no_data"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.array_sort(F.collect_set(continent)).alias("continents"),
        F.array(F.min("last_updated"), F.max("last_updated")).alias("last_updated_range"),
        F.struct(
            F.coalesce(F.sum(F.when(covered, parquet)), F.lit(0)).alias("parquet"),
            F.coalesce(F.sum(sample), F.lit(0)).alias("sample_csv"),
        ).alias("download_bytes"),
    ]


def catalog_totals(entries: DataFrame) -> DataFrame:
    """One row of grand totals."""
    return entries.agg(*total_aggregates())


def by_name(entries: DataFrame) -> DataFrame:
    """Entries in code-point order of their English name."""
    return entries.orderBy("name_en", "iso2")


def with_file_dates(versions: DataFrame, sources: DataFrame) -> DataFrame:
    """The version table, ``last_updated`` being the day the selected file was changed.

    A file that is not listed leaves what the version table says of it, if anything.
    """
    dates = sources.select(F.col("rel_path").alias("selected_rel_path"), F.col("last_updated").alias("_changed"))
    known = F.col("last_updated") if "last_updated" in versions.columns else F.lit(None).cast("string")
    return versions.join(dates, "selected_rel_path", "left").withColumn("last_updated", F.coalesce("_changed", known)).drop("_changed")


def missing_sources(versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of the version table whose selected file is not there."""
    return versions.join(sources, F.col("selected_rel_path") == F.col("rel_path"), "left_anti")


def raw_file_table(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(iso2, fmt, bytes, name): the source file of each group without rows, found by its
    path, and beside it in the same folder the sheet of the same stem."""
    stem = F.regexp_replace("source_path", r"\.[^./]*$", "")
    of_group = entries.where(F.col("status") == NO_DATA).select(
        "iso2",
        F.explode(
            F.array(
                F.struct(F.lit("csv").alias("fmt"), F.col("source_path").alias("rel_path")),
                F.struct(F.lit("xlsx").alias("fmt"), F.concat(stem, F.lit(".xlsx")).alias("rel_path")),
            )
        ).alias("wanted"),
    )
    listed = sources.select("rel_path", "bytes")
    found = of_group.select("iso2", "wanted.*").join(listed, "rel_path")
    return found.select("iso2", "fmt", "bytes", base_name("rel_path").alias("name"))
