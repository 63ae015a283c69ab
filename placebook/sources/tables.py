"""Parquet scans, file metadata and nested JSON documents."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.functions.scalars import base_name, day
from placebook.schema import ALL_ROWS, FILE_ORDER, GROUP, document_type
from placebook.session import settle

VIEW_FOLDER, GROUP_FOLDER = "view", "group"


def folder_name(c: Column) -> Column:
    """A group's folder: its name, after ``_`` where it is empty or begins so, because
    an empty folder value reads back as null."""
    return F.when((c == "") | F.startswith(c, F.lit("_")), F.concat(F.lit("_"), c)).otherwise(c)


def folder_value(c: Column) -> Column:
    """The group of a folder."""
    return F.when(F.startswith(c, F.lit("_")), F.substring(c, 2, 2**31 - 1)).otherwise(c)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A projected scan: only these columns are read from the files."""
    return spark.read.parquet(path).select(*columns)


def read_in_order(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with the place they have in their files, as the columns of ``FILE_ORDER``.

    The scan itself tells the place, whatever the splits: nothing is counted or sorted. A
    table of several files is ordered by their paths, which Spark numbers as it writes.
    """
    rows = spark.read.parquet(path)
    place = [F.col(f"_metadata.{c}").alias(c) for c in FILE_ORDER]
    return rows.select(*(columns or rows.columns), *place)


def read_group(spark: SparkSession, path: str, code: str, group: str = GROUP) -> DataFrame:
    """One group's rows; the equality reaches the scan."""
    return spark.read.parquet(path).where(F.col(group) == code)


def read_views(spark: SparkSession, path: str) -> DataFrame:
    """A materialized folder with its view and group, both always text: a group
    called ``01`` must not come back as a number, whatever the session infers."""
    found = spark.read.parquet(path).schema
    text = {VIEW_FOLDER, GROUP_FOLDER}
    fields = [T.StructField(f.name, T.StringType()) if f.name in text else f for f in found]
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    return rows.withColumn(GROUP_FOLDER, folder_value(F.col(GROUP_FOLDER)))


def read_view(
    spark: SparkSession, path: str, view: str = ALL_ROWS, code: str | None = None
) -> DataFrame:
    """A materialized view, or one group of it. Other folders are not opened."""
    rows = read_views(spark, path).where(F.col(VIEW_FOLDER) == view)
    if code is not None:
        # Written so that the condition on the folder itself prunes the others.
        rows = rows.where(F.col(GROUP_FOLDER) == code)
    return rows.drop(VIEW_FOLDER, GROUP_FOLDER)


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, name, bytes, modified, last_updated) of every file below a folder.

    Only the listing is used; the content column is never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path",
        base_name("path").alias("name"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
        day("modificationTime").alias("last_updated"),
    )


def source_path(path: Column | str, root: str, encoded: bool = False) -> Column:
    """The path below ``root`` of the source that a file belongs to.

    The part files of a folder belong to the folder. ``encoded`` paths, as a scan's
    metadata has them, write special characters as ``%XX``.
    """
    path = F.col(path) if isinstance(path, str) else path
    if encoded:
        path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root.rstrip("/"))
    # Whatever stands before the folder is scheme and host, which are written in several ways.
    below = F.regexp_extract(path, rf"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?\Q{base}\E/(.*)$", 1)
    return F.regexp_replace(below, r"/part-[^/]*$", "")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, bytes, modified, last_updated) of every source below a folder, from its
    listing: one row per file, or per folder of part files."""
    files = read_files(spark, root).where(~F.startswith("name", F.lit("_")) & ~F.startswith("name", F.lit(".")))
    by_source = files.groupBy(source_path("path", root).alias("rel_path"))
    found = by_source.agg(F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))
    return found.withColumn("last_updated", day("modified"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog records, one per group, out of the nested document."""
    documents = spark.read.schema(document_type()).json(path, multiLine=True)
    return documents.select(F.inline("countries"))


def read_catalog_header(spark: SparkSession, path: str) -> DataFrame:
    """The document's time stamp and totals."""
    header = T.StructType([f for f in document_type() if f.name != "countries"])
    documents = spark.read.schema(header).json(path, multiLine=True)
    return documents.select("generated_at", "totals.*")


def read_features(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(id, name) of every feature of topology documents; shapes are skipped."""
    schema = T.StructType.fromDDL(
        "objects struct<countries:struct<geometries:array<"
        "struct<id:string,properties:struct<name:string>>>>>"
    )
    features = spark.read.schema(schema).json(path, multiLine=multi_line)
    return features.select(F.explode("objects.countries.geometries").alias("f")).select(
        "f.id", F.col("f.properties.name").alias("name")
    )


def read_listing(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(id, name, position) from saved pages of a folder listing.

    Each page is a document ``{"files": [{"id", "name"}, …]}``, one per file or, with
    ``multi_line`` off, one per line. ``position`` orders entries by file, then by
    their place in it.
    """
    schema = "files array<struct<id:string,name:string>>"
    pages = spark.read.schema(schema).json(path, multiLine=multi_line)
    page = F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    pages = pages.select(page.alias("page"), "files")
    return pages.select("page", F.posexplode("files").alias("entry", "f")).select(
        "f.id", "f.name", F.struct("page.*", "entry").alias("position")
    )


def read_listing_chain(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(id, name, position) from saved pages that name each other by tokens.

    Each page is a document ``{"pageToken", "nextPageToken", "files": [{"id", "name"}, …]}``;
    the first has no token of its own, the last none of a next one. Files hold pages in any
    order: a page's place is its distance along the tokens from the first, found by
    :func:`chain_places`. ``position`` orders entries by page, then by their place in it.
    """
    schema = "pageToken string, nextPageToken string, files array<struct<id:string,name:string>>"
    pages = spark.read.schema(schema).json(path, multiLine=multi_line)
    own = F.coalesce("pageToken", F.lit(""))
    places = chain_places(pages.select(own.alias("token"), F.col("nextPageToken").alias("next")))
    entries = pages.select(own.alias("token"), F.posexplode("files").alias("entry", "f"))
    return entries.join(places, "token").select("f.id", "f.name", F.struct("page", F.col("entry").cast("long").alias("entry")).alias("position"))


def chain_places(links: DataFrame) -> DataFrame:
    """(token, page): places 0, 1, 2 … along a chain ``(token, next)``, by pointer doubling.

    Every page points ahead and knows how many pages that is; a round lets it point where
    the page it points to does. The number of rounds is the logarithm of the length, each
    is one join, and its result is stored. A next page that is not there ends the chain.
    """
    ahead = settle(links.select("token", "next", F.lit(1).cast("long").alias("hops")), "chain")
    length = ahead.count()
    for _ in range(length.bit_length() + 1):
        other = ahead.select(F.col("token").alias("_token"), F.col("next").alias("_next"), F.col("hops").alias("_hops"))
        step = ahead.join(other, F.col("next") == F.col("_token"), "left")
        ahead = settle(step.select("token", F.col("_next").alias("next"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops")), "chain")
        if ahead.where("next is not null").isEmpty():
            break
    else:
        raise ValueError("the pages of the listing go round in a circle")
    first = ahead.agg(F.max("hops")).first()[0] or 0
    return ahead.select("token", (F.lit(first) - F.col("hops")).alias("page"))
