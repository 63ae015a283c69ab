"""Text-safe readers for delimited files."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.session import settle
from placebook.sources.tables import source_path

CORRUPT = "_corrupt_record"
BOM = "\ufeff"

# Names under which Spark knows encodings that source lists write differently.
ENCODINGS = {"utf-8-sig": "UTF-8", "utf8": "UTF-8", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1"}


def _reader(spark: SparkSession, sep: str, encoding: str, multi_line: bool):
    """Everything is text, nothing is a null marker, and blanks are kept."""
    encoding = encoding or "UTF-8"
    return spark.read.options(
        sep=sep or ",",
        encoding=ENCODINGS.get(encoding.lower(), encoding),
        quote='"',
        escape='"',
        nullValue="\x00",
        emptyValue="",
        mode="PERMISSIVE",
        multiLine=multi_line,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        maxCharsPerColumn=-1,
        recursiveFileLookup=True,
        # Whether a row fits is told by its field count, so all fields must be parsed.
        columnPruning=False,
    )


def header_of(spark: SparkSession, path, sep=",", encoding="UTF-8", multi_line=True) -> list[str]:
    """The header of files of one template. A name repeated letter by letter gets
    ``.1``, ``.2`` … on its later copies."""
    first = _reader(spark, sep, encoding, multi_line).csv(path).first()
    names = [n or "" for n in first] if first else []
    if names:
        names[0] = names[0].lstrip(BOM)
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(f"{n}.{seen[n]}" if n in seen else n)
        seen[n] = seen.get(n, 0) + 1
    return out


def _positions(count: int, *extra: str) -> T.StructType:
    """Columns by position: names out of a header may differ in case only."""
    names = [*(f"_{i}" for i in range(count)), *extra]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_text_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = True
) -> DataFrame:
    """A well-formed CSV as text: ``NA`` stays ``NA``, ``01067`` stays ``01067``.

    Missing fields come out as the empty string. Set ``multi_line`` to False to
    split large files that are known to hold no line breaks inside quotes.
    """
    columns = columns or header_of(spark, path, multi_line=multi_line)
    reader = _reader(spark, ",", "UTF-8", multi_line).option("header", True)
    return reader.schema(_positions(len(columns))).csv(path).fillna("").toDF(*columns)


def field_count(record: Column, sep: str) -> Column:
    """Number of fields in a raw record, separators inside quotes not counted."""
    s = re.escape(sep)
    bare = F.regexp_replace(record, rf'(^|{s})"(?:[^"]|"")*"', "$1")
    return F.size(F.split(bare, re.escape(sep), -1))


def read_dialect_csv(
    spark: SparkSession,
    path,
    encoding: str = "UTF-8",
    sep: str = ",",
    columns: list[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Files of one template in a given encoding and separator.

    Rows with too many fields are dropped, short rows are padded with null. One
    column more than the header is asked for, so that every row that fits, or is
    short, reaches the corrupt-record column with its raw text and can be counted.
    """
    columns = columns or header_of(spark, path, sep, encoding, multi_line)
    surplus = "_surplus"
    rows = (
        _reader(spark, sep, encoding, multi_line)
        .options(header=True, enforceSchema=True, columnNameOfCorruptRecord=CORRUPT)
        .schema(_positions(len(columns), surplus, CORRUPT))
        .csv(path)
    )
    # An empty field is '', one that the row does not have is null.
    present = field_count(F.col(CORRUPT), sep or ",")
    fits = F.col(CORRUPT).isNotNull() & F.col(surplus).isNull() & (present <= len(columns))
    values = [F.when(present > i, F.coalesce(f"_{i}", F.lit(""))) for i in range(len(columns))]
    return rows.where(fits).select(*values).toDF(*columns)


class SourceFiles(NamedTuple):
    """Files read together although their headers differ."""

    headers: DataFrame  # (file, ordinal, header)
    records: DataFrame  # (file, block, row, fields), in file order by block and row


def read_source_files(
    spark: SparkSession,
    dialects: dict[tuple[str, str], list[str]],
    multi_line: bool = True,
    source_of: Callable[[Column], Column] | None = None,
) -> SourceFiles:
    """Many files with different headers, as headers and records.

    ``source_of`` turns a file path into the name of the source it belongs to, for
    sources stored as several part files under one header.

    ``dialects`` maps (encoding, separator) to the paths written that way; each
    dialect is one scan, whatever the number of files or templates in it. Records
    with more fields than their header are dropped, short ones are left short.
    """
    scans = [
        _heads(spark, paths, encoding, sep, multi_line).withColumn("_dialect", F.lit(i))
        for i, ((encoding, sep), paths) in enumerate(dialects.items())
    ]
    heads = settle(reduce(DataFrame.unionByName, scans), "headers")
    # As wide as the dialect's widest header, so that records that fit it need no second look.
    widest = {r["_dialect"]: r["_size"] for r in heads.groupBy("_dialect").agg(F.max("_size").alias("_size")).collect()}
    # A file's source is made out once, not beside every record.
    named = source_of or (lambda path: path)
    heads = heads.drop("_dialect").withColumn("_source", named(F.col("_file")))
    # The reader drops the first record of every file, so no row of this scan has to be
    # recognized by what another scan numbered.
    scans = [
        _records(spark, paths, encoding, sep, widest.get(i) or 1, multi_line)
        for i, ((encoding, sep), paths) in enumerate(dialects.items())
    ]
    records = reduce(DataFrame.unionByName, scans)
    kept = records.join(heads.drop("_headers"), F.col("file") == F.col("_file")).where(F.col("size") <= F.col("_size"))
    headers = heads.select(
        F.col("_source").alias("file"), F.posexplode("_headers").alias("ordinal", "header")
    ).withColumn("header", F.ltrim("header", F.lit(BOM)))
    numbered = kept.select(F.col("_source").alias("file"), "block", "row", "fields")
    return SourceFiles(headers.distinct() if source_of else headers, numbered)


def dialects_of(versions: DataFrame, root: str) -> dict[tuple[str, str], list[str]]:
    """(encoding, separator) to the paths written that way, out of the version table.

    One path per group comes to the driver, which Spark's reader needs there to list
    the files. Blank encodings and separators mean UTF-8 and a comma.
    """
    name = F.coalesce(F.nullif(F.lower(F.trim("selected_encoding")), F.lit("")), F.lit("utf-8"))
    sep = F.coalesce(F.nullif("selected_delimiter", F.lit("")), F.lit(","))
    known = F.create_map(*(F.lit(x) for pair in ENCODINGS.items() for x in pair))
    chosen = versions.select(
        F.upper(F.coalesce(F.element_at(known, name), name)).alias("encoding"), sep.alias("sep"), "selected_rel_path"
    )
    out: dict[tuple[str, str], list[str]] = {}
    for encoding, separator, path in chosen.distinct().orderBy("encoding", "sep", "selected_rel_path").collect():
        out.setdefault((encoding, separator), []).append(f"{root.rstrip('/')}/{path}")
    return out


def read_versioned_sources(
    spark: SparkSession, versions: DataFrame, root: str, multi_line: bool = True
) -> SourceFiles:
    """The files a version table selects below ``root``, each in its own dialect.

    A source is called by its path below ``root``, as in ``selected_rel_path``: two files
    of one name in two folders are two sources. A source may be a folder of part files.
    """
    return read_source_files(spark, dialects_of(versions, root), multi_line, lambda path: source_path(path, root, True))


def cells(source: SourceFiles) -> DataFrame:
    """Long form: (file, block, row, ordinal, header, value)."""
    values = source.records.select(
        "file", "block", "row", F.posexplode("fields").alias("ordinal", "value")
    )
    return values.join(source.headers, ["file", "ordinal"]).select(
        "file", "block", "row", "ordinal", "header", "value"
    )


def fields_of(record: Column, sep: str) -> Column:
    """The fields of a raw record, without the quotes around them."""
    s = re.escape(sep)
    pattern = rf'{s}("(?:[^"]|"")*"|[^{s}]*)'
    raw = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(pattern), 1)
    bare = lambda f: F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda f: F.when(F.startswith(f, F.lit('"')), bare(f)).otherwise(f))


def _records(spark, paths, encoding, sep, width, multi_line) -> DataFrame:
    names = [f"_{i}" for i in range(width)]
    rows = (
        _reader(spark, sep, encoding, multi_line)
        .options(header=True, enforceSchema=True, columnNameOfCorruptRecord=CORRUPT)
        .schema(_positions(width, CORRUPT))
        .csv(paths)
    )
    size = F.coalesce(field_count(F.col(CORRUPT), sep or ","), F.lit(width))
    fields = F.array(*(F.coalesce(F.col(c), F.lit("")) for c in names))
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        size.alias("size"),
        F.slice(fields, 1, F.least(size, F.lit(width))).alias("fields"),
    ).where(F.size("fields") > 0)


def _heads(spark, paths, encoding, sep, multi_line) -> DataFrame:
    """A file's header is its first record; row numbers of one scan rise with the
    position. Only the block a file begins with is looked at, and of a record only its
    raw text, so that a header may be of any width."""
    rows = (
        _reader(spark, sep, encoding, multi_line)
        .options(header=False, enforceSchema=True, columnNameOfCorruptRecord=CORRUPT)
        .schema(_positions(1, CORRUPT))
        .csv(paths)
    )
    # A record of one field fits the schema; its text is that field.
    one = F.concat(F.lit('"'), F.replace("_0", F.lit('"'), F.lit('""')), F.lit('"'))
    places = rows.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.struct(F.monotonically_increasing_id().alias("row"), F.coalesce(CORRUPT, one).alias("record")).alias("head"),
    )
    first = places.where(F.col("_block") == 0).groupBy("_file").agg(F.min_by("head", "head.row").alias("head"))
    fields = fields_of(F.col("head.record"), sep or ",")
    return first.select("_file", fields.alias("_headers")).withColumn("_size", F.size("_headers"))
