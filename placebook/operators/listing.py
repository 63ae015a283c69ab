"""Browsing the catalog: facets, order, totals, and the map."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebook.functions.scalars import bin_label

ALL = "all"
TEXT_KEYS = ["name_en", "iso2", "continent_name", "last_updated"]
NUMBER_KEYS = ["rows", "admin_area_rows", "admin_depth"]
SEARCHED = ["name_en", "iso2", "iso3", "name_lc"]

# Map features without a numeric code that stand for a group.
FEATURE_ALIASES = {"N. Cyprus": "CY"}

ABSENT, HATCH = "absent", "hatch"


def facets(entries: DataFrame, region: str = ALL, status: str = ALL, text: str = "") -> DataFrame:
    """Entries that pass every facet in use."""
    if region != ALL:
        entries = entries.where(F.col("continent_name") == region)
    if status != ALL:
        entries = entries.where(F.col("status") == status)
    text = text.strip()
    if text:
        part = F.lower(F.lit(text))
        found = [F.contains(F.lower(F.coalesce(c, F.lit(""))), part) for c in SEARCHED]
        entries = entries.where(reduce(lambda a, b: a | b, found))
    return entries


def area_rows() -> Column:
    return F.coalesce(F.element_at("view_stats", "admin_areas")["rows"], F.lit(0))


def listing_order(key: str, descending: bool = False) -> list[Column]:
    """Sort columns: text by language rules with null as ``''``, numbers as numbers."""
    if key in TEXT_KEYS:
        c = F.collate(F.coalesce(key, F.lit("")), "UNICODE")
    elif key in NUMBER_KEYS:
        c = area_rows() if key == "admin_area_rows" else F.col(key)
    else:
        raise ValueError(f"unknown sort key: {key}")
    return [c.desc() if descending else c.asc(), F.col("name_en").asc()]


def sort_entries(entries: DataFrame, key: str = "name_en", descending: bool = False) -> DataFrame:
    return entries.orderBy(*listing_order(key, descending))


def listing_totals(visible: DataFrame) -> DataFrame:
    return visible.agg(
        F.count("*").alias("listed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_listed")
    )


def selection_totals(chosen: DataFrame) -> DataFrame:
    """What a selection can send: entries with a sample, their bytes, those without."""
    return chosen.agg(
        F.count("sample_csv").alias("sendable"),
        F.coalesce(F.sum("sample_csv.bytes"), F.lit(0)).alias("sample_bytes"),
        F.count_if(F.col("sample_csv").isNull()).alias("without_sample"),
    )


def map_features(
    features: DataFrame, entries: DataFrame, aliases: dict[str, str] = FEATURE_ALIASES
) -> DataFrame:
    """Every feature with the entry it shows: by numeric code, else by alias."""
    shown = ["iso2", "status", "rows"]
    by_code = entries.where(F.col("iso_numeric").isNotNull()).select(
        "iso_numeric", F.struct(*shown).alias("_by_code")
    )
    by_group = entries.select(F.col("iso2").alias("_alias"), F.struct(*shown).alias("_by_alias"))
    pairs = [x for pair in aliases.items() for x in map(F.lit, pair)]
    alias = F.element_at(F.create_map(*pairs), F.coalesce("name", F.lit(""))) if pairs else F.lit(None)
    entry = F.coalesce("_by_code", "_by_alias")
    return (
        features.withColumn("_alias", alias.cast("string"))
        .join(by_code, features["id"].cast("string") == F.col("iso_numeric"), "left")
        .join(by_group, "_alias", "left")
        .select(features["id"], "name", entry.alias("_entry"))
        .select("id", "name", "_entry.*")
    )


def fill_state(status: Column | None = None, rows: Column | None = None) -> Column:
    """absent, hatch, or the bin label of the row count."""
    status = F.col("status") if status is None else status
    rows = F.col("rows") if rows is None else rows
    return (
        F.when(status.isNull(), ABSENT)
        .when(status == "covered", bin_label(rows))
        .otherwise(HATCH)
    )
