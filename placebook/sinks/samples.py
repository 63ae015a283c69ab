"""The first rows of every group, as small CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.operators.ranking import first_per_group, first_per_group_wide
from placebook.operators.source_profile import unique_headers
from placebook.schema import COLUMNS, FILE_ORDER, GROUP, SAMPLE_ROWS
from placebook.sinks.delimited import csv_header, csv_line, quoted, write_csv_groups
from placebook.sources.delimited import SourceFiles


def sample_rows(
    df: DataFrame,
    order: Sequence[str] = tuple(FILE_ORDER),
    columns: Sequence[str] = tuple(COLUMNS),
    group: str = GROUP,
    n: int = SAMPLE_ROWS,
) -> DataFrame:
    """First ``n`` rows per group; groups with fewer give what they have. Unless told
    otherwise, in the order of the files that :func:`read_in_order` has read."""
    present = df.where(F.col(group).isNotNull())
    needed = list(dict.fromkeys([group, *order, *columns]))
    return first_per_group_wide(present.select(*needed), [group], order, n).select(*columns)


def sample_sizes(samples: DataFrame, columns: Sequence[str], group: str = GROUP) -> DataFrame:
    """(group, bytes, rows) of each sample file, header line and line ends included."""
    head = len(csv_header(columns).encode()) + 1
    line_bytes = F.octet_length(csv_line(samples, columns)) + 1
    return samples.groupBy(group).agg(
        (F.sum(line_bytes) + head).alias("bytes"), F.count("*").alias("rows")
    )


def write_samples(
    samples: DataFrame,
    path: str,
    order: Sequence[str] = (),
    columns: Sequence[str] = tuple(COLUMNS),
    group: str = GROUP,
    mode: str = "error",
) -> None:
    """One file per group, rows in ``order``."""
    write_csv_groups(samples, path, group, order, columns, mode)


def source_samples(source: SourceFiles, n: int = SAMPLE_ROWS) -> DataFrame:
    """(file, position, header, line): the first rows of source files as CSV lines.

    Everything is text there. Short rows are filled up to the length of the header.
    """
    names = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "header"))), lambda x: x.header
    )
    heads = unique_headers(source.headers).groupBy("file").agg(names.alias("names"))
    first = first_per_group(source.records, ["file"], ["block", "row"], n, rank="position")
    joined = lambda values: F.array_join(F.transform(values, quoted), ",")
    fields = F.transform("names", lambda _, i: F.coalesce(F.get("fields", i), F.lit("")))
    return first.join(heads, "file").select(
        "file", "position", joined(F.col("names")).alias("header"), joined(fields).alias("line")
    )


def source_sample_sizes(samples: DataFrame, name: str = "file") -> DataFrame:
    """(name, bytes, rows) of the files :func:`write_source_samples` makes."""
    size = F.sum(F.octet_length("line") + 1) + F.max(F.octet_length("header")) + 1
    return samples.groupBy(name).agg(size.alias("bytes"), F.count("*").alias("rows"))


def write_source_samples(samples: DataFrame, path: str, name: str, mode: str = "error") -> None:
    """One file per source, in a folder called by the column ``name``. A sample is a
    hundred lines at most, so its text is put together as one value."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "line")))
    body = F.array_join(F.transform(ordered, lambda x: x.line), "\n")
    files = samples.groupBy(F.col(name).alias("group"), "header").agg(body.alias("body"))
    text = F.concat("header", F.lit("\n"), "body")
    files.select(text.alias("value"), "group").write.mode(mode).partitionBy("group").text(path)
