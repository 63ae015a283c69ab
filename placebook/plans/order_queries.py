"""Queries over the order that rows have in their files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placebook.operators.profile import opening_values
from placebook.plans.registry import query
from placebook.schema import FILE_ORDER, SAMPLE_ROWS
from placebook.session import ROWS_PER_TASK, fresh_path, tasks_for
from placebook.sinks.delimited import write_csv_groups
from placebook.sinks.samples import sample_rows
from placebook.sources.tables import read_in_order

LINES = "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, row_number() OVER () AS seen FROM lineitem"


def lines(spark, folder):
    return read_in_order(spark, f"{folder}/lineitem.parquet", ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"])


@query(
    "file_order_samples",
    f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, seen - 1 AS row_index FROM
    (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY seen) AS rn FROM ({LINES})) WHERE rn <= {SAMPLE_ROWS}""",
)
def file_order_samples(spark, folder):
    columns = ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "row_index"]
    return sample_rows(lines(spark, folder), columns=columns, group="l_suppkey")


PRIORITY = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END"


@query(
    "file_order_opening",
    f"""WITH o AS (SELECT *, {PRIORITY} AS example, row_number() OVER () AS seen FROM orders)
    SELECT o_custkey, arg_min(o_orderstatus, seen) AS o_orderstatus, arg_min(o_orderdate, seen) AS o_orderdate,
    arg_min(example, seen) FILTER (WHERE example IS NOT NULL) AS example_example FROM o GROUP BY o_custkey""",
)
def file_order_opening(spark, folder):
    orders = read_in_order(spark, f"{folder}/orders.parquet").withColumn("example", F.expr(PRIORITY))
    return opening_values(orders, group="o_custkey", attributes=["o_orderstatus", "o_orderdate"], example="example")


@query(
    "file_order_export",
    f"SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY seen) AS line, l_orderkey, l_linenumber FROM ({LINES})",
)
def file_order_export(spark, folder):
    """Files per group, and the place of every line in the files of its group."""
    path, rows = fresh_path(spark, "ordered"), lines(spark, folder)
    # By rows, not by bytes: a path beside every line is next to nothing until it is sorted.
    tasks = tasks_for(rows)
    write_csv_groups(rows, path, "l_suppkey", FILE_ORDER, ["l_orderkey", "l_linenumber"], rows_per_file=ROWS_PER_TASK if tasks else None)
    found = spark.read.text(path).select(
        F.col("group").cast("long").alias("l_suppkey"), "value",
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("place"),
    )
    in_group = Window.partitionBy("l_suppkey").orderBy("place")
    found = found.where(~F.startswith("value", F.lit('"'))).repartition(*tasks, "l_suppkey")
    numbered = found.withColumn("line", F.row_number().over(in_group).cast("long"))
    field = lambda i: F.get(F.split("value", ","), i).cast("long")
    return numbered.select("l_suppkey", "line", field(0).alias("l_orderkey"), field(1).alias("l_linenumber"))
