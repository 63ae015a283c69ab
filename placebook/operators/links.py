"""Matching a folder listing to catalog groups and merging the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names that count, and how a link is written.
NAME_PATTERN = r"^([a-zA-Z]{2})\.(csv|xlsx)$"
LINK_FORMATS = ["csv", "xlsx"]
URL_START, URL_END = "https://drive.google.com/file/d/", "/view"

LINKED, UNMATCHED, UNKNOWN = "linked", "unmatched", "unknown"


def parse_names(listing: DataFrame, pattern: str = NAME_PATTERN) -> DataFrame:
    """The listing with (iso2, fmt) where the name has the right form, else null."""
    part = lambda i: F.nullif(F.regexp_extract("name", pattern, i), F.lit(""))
    return listing.withColumns({"iso2": F.upper(part(1)), "fmt": F.lower(part(2))})


def classify_listing(listing: DataFrame, covered: DataFrame) -> DataFrame:
    """Each listed file as linked, unmatched (name) or unknown (group not covered)."""
    known = covered.select("iso2", F.lit(True).alias("_known"))
    files = parse_names(listing).join(known, "iso2", "left")
    bucket = (
        F.when(F.col("iso2").isNull(), UNMATCHED)
        .when(F.col("_known").isNull(), UNKNOWN)
        .otherwise(LINKED)
    )
    return files.select(*listing.columns, "iso2", "fmt", bucket.alias("bucket"))


def link_table(classified: DataFrame, position: str = "position") -> DataFrame:
    """(iso2, csv, xlsx): one URL per format; the last file listed wins."""
    url = F.concat(F.lit(URL_START), "id", F.lit(URL_END))
    # Null positions never win, so other formats leave no trace in the maximum.
    return (
        classified.where(F.col("bucket") == LINKED)
        .groupBy("iso2")
        .agg(*(
            F.max_by(url, F.when(F.col("fmt") == f, F.col(position))).alias(f) for f in LINK_FORMATS
        ))
    )


def link_map(links: DataFrame) -> DataFrame:
    """(iso2, drive_links): the formats that have a link, as a map."""
    pairs = F.array(*(F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in LINK_FORMATS))
    kept = F.filter(pairs, lambda p: p.value.isNotNull())
    return links.select("iso2", F.map_from_entries(kept).alias("drive_links"))


def merge_links(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Covered entries take the links found now, or lose theirs; others keep theirs."""
    fresh = link_map(links).withColumnRenamed("drive_links", "_links")
    merged = F.when(F.col("status") == "covered", F.col("_links")).otherwise(F.col("drive_links"))
    return (
        entries.join(fresh, "iso2", "left")
        .withColumn("drive_links", merged)
        .select(*entries.columns)
    )


def not_linked(covered: DataFrame, links: DataFrame) -> DataFrame:
    return covered.select("iso2").join(links, "iso2", "left_anti").orderBy("iso2")


def link_summary(covered: DataFrame, links: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: linked groups, with both formats, with one, missing, files ignored."""
    has = {f: F.col(f).isNotNull() for f in LINK_FORMATS}
    marked = covered.select("iso2").distinct().join(links, "iso2", "left")
    groups = marked.agg(
        F.count("*").alias("covered"),
        F.count_if(has["csv"] | has["xlsx"]).alias("linked"),
        F.count_if(has["csv"] & has["xlsx"]).alias("with_both"),
        F.count_if(has["csv"] != has["xlsx"]).alias("with_one"),
        F.count_if(~has["csv"] & ~has["xlsx"]).alias("missing"),
    )
    files = classified.agg(
        F.count_if(F.col("bucket") == UNMATCHED).alias("ignored_name"),
        F.count_if(F.col("bucket") == UNKNOWN).alias("ignored_group"),
    )
    both = groups.unionByName(files, allowMissingColumns=True)
    return both.agg(*(F.sum(c).alias(c) for c in both.columns))
