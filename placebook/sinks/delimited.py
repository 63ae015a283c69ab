"""Text-safe CSV output."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.functions.scalars import number_text


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def field_text(field: T.StructField) -> Column:
    """Text in quotes, numbers bare, anything missing an empty pair of quotes."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        text = F.when(~F.isnan(c), number_text(c))
    elif isinstance(field.dataType, T.NumericType):
        text = c.cast("string")
    else:
        text = quoted(c.cast("string"))
    return F.coalesce(text, F.lit('""'))


def csv_line(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One row as the line that :func:`write_csv` puts in the file."""
    return F.concat_ws(",", *(field_text(df.schema[c]) for c in columns or df.columns))


def csv_header(columns: Sequence[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' for c in columns)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with text in quotes and numbers bare; every part file has the header.

    A task writes one file, so the header goes in front of its first row. A table
    without rows is the header alone.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = csv_line(df)
    header = csv_header(df.columns)
    head = F.concat(F.lit(header + "\n"), line)
    lines = df.select(F.when(in_task == 0, head).otherwise(line).alias("value"))
    lines.write.mode(mode).option("maxRecordsPerFile", 0).text(path)
    spark = df.sparkSession
    if spark.read.text(path).isEmpty():
        spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_csv_groups(
    df: DataFrame,
    path: str,
    group: str,
    order: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    mode: str = "error",
    rows_per_file: int | None = None,
) -> None:
    """The same, with files of their own for every group.

    Rows are ranged and sorted by group, then ``order``, which may hold columns that are
    not written. A group of any size is in order over its files by name: a large one
    covers several ranges, each a file with the header, written row by row.
    ``rows_per_file`` sets the number of ranges by counting; else Spark chooses it.
    """
    columns = list(columns or df.columns)
    lines = df.select(
        F.col(group).alias("group"),
        *(F.col(c).alias(f"_order{i}") for i, c in enumerate(order)),
        csv_line(df, columns).alias("value"),
        # Lets a range end between equal rows.
        F.monotonically_increasing_id().alias("_row"),
    )
    keys = [c for c in lines.columns if c != "value"]
    parts = [-(-df.count() // rows_per_file) or 1] if rows_per_file else []
    ranged = lines.repartitionByRange(*parts, *keys).sortWithinPartitions(*keys)
    headed = ranged.select("group", "value").mapInArrow(_headed(csv_header(columns)), "group string, place long, value string")
    # The writer wants rows by group; naming the place too keeps their order.
    writer = headed.sortWithinPartitions("group", "place").select("value", "group").write.mode(mode)
    # Overwriting replaces the whole folder of a group, also when it has fewer files.
    writer.options(maxRecordsPerFile=0, partitionOverwriteMode="dynamic").partitionBy("group").text(path)


def _headed(header: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Put the header before the first row of every group in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = pa.array([], pa.string()), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, values = (batch.column(c).cast(pa.string()) for c in ("group", "value"))
            before = pa.concat_arrays([last, groups.slice(0, batch.num_rows - 1)]) if len(last) else groups.slice(0, batch.num_rows - 1)
            starts = pc.not_equal(groups.slice(batch.num_rows - len(before)), before)
            if not len(last):
                starts = pa.concat_arrays([pa.array([True]), starts])
            headed = pc.binary_join_element_wise(header, values, "\n")
            places = pa.array(np.arange(place, place + batch.num_rows))
            last, place = groups.slice(batch.num_rows - 1), place + batch.num_rows
            yield pa.RecordBatch.from_arrays([groups, places, pc.if_else(starts, headed, values)], ["group", "place", "value"])

    return run
