"""A canonical-shaped table projected from the TPC-H-like tables.

The expressions are portable SQL text: Spark reads them as they are, the DuckDB
checks after replacing the type name STRING.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.schema import COLUMNS
from placebook.session import freeing, rows_per_job, tasks_for

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

CODE = "concat(chr(65 + n_nationkey), chr(65 + n_regionkey))"
# Groups delivered without any usable code.
UNCODED = "n_nationkey % 8 = 7"

EXPRESSIONS = {
    "country_iso2": CODE,
    "country_iso3": f"CASE WHEN n_nationkey % 7 <> 3 THEN concat({CODE}, 'X') END",
    "country_en": "n_name",
    "country_lc": "CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE concat('L-', n_name) END",
    "continent_code": "CASE WHEN r_name = 'AMERICA' THEN 'NA' ELSE substr(r_name, 1, 2) END",
    "continent_name": "r_name",
    "postal_code": "lpad(CAST(l_partkey % 400 AS STRING), 5, '0')",
    "postal_code_norm": "lpad(CAST(l_partkey % 400 AS STRING), 5, '0')",
    "place_name": "CASE WHEN l_partkey % 3 = 0 THEN ' ' WHEN l_partkey % 3 = 1 THEN p_name END",
    "region_1_lc": "CASE WHEN l_suppkey % 3 = 0 THEN concat('l-', p_brand) WHEN l_suppkey % 3 = 1 THEN '' END",
    "region_1_en": "CASE WHEN l_linenumber = 7 THEN '' ELSE p_brand END",
    "region_1_iso_code": f"CASE WHEN n_nationkey % 4 <> 0 AND l_linenumber <> 2 THEN concat({CODE}, '-', substr(p_brand, 7)) ELSE ' ' END",
    "region_2_lc": "CASE WHEN l_suppkey % 5 = 0 THEN '  ' END",
    "region_2_en": "CASE WHEN l_suppkey % 4 = 0 THEN p_type END",
    "region_3_lc": "CAST(NULL AS STRING)",
    "region_3_en": "CAST(NULL AS STRING)",
    "region_4_lc": "CAST(NULL AS STRING)",
    "region_4_en": "CASE WHEN n_nationkey % 3 = 0 AND l_linenumber = 1 THEN p_type END",
    "region_5_lc": "CAST(NULL AS STRING)",
    "region_5_en": "CAST(NULL AS STRING)",
    "latitude": "CASE WHEN l_suppkey % 6 <> 0 THEN round(s_acctbal / 100, 4) END",
    "longitude": "CASE WHEN l_suppkey % 6 <> 0 THEN round(s_acctbal / 60, 4) END",
    "timezone": "concat('Area/', r_name)",
    "utc_offset": "CASE WHEN l_linenumber <> 3 THEN concat('UTC+0', CAST(n_nationkey % 10 AS STRING)) END",
}

# As delivered, before validation: some codes are blank in three different ways, and
# whole groups have none.
DELIVERED_CODE = f"""CASE WHEN {UNCODED} OR l_partkey % 40 = 0 THEN ''
    WHEN l_partkey % 40 = 1 THEN '  '
    WHEN l_partkey % 40 <> 2 THEN lpad(CAST(l_partkey % 400 AS STRING), 5, '0') END"""

SOURCE = """lineitem
JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joined(spark: SparkSession, folder: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Every line item, or those given, with its part, supplier, nation and region.

    No join hints: the sizes of the files decide which sides Spark broadcasts.
    Joining one table after the other keeps those sizes visible to the planner. What the
    tables that grow leave is dealt out then: the files may be few and large, and a join with
    a table too large to broadcast deals by bytes. Rows are dealt by their number instead,
    because what is a few bytes here is a wide row to whoever sorts it. Nations and regions
    are a handful and need not travel with the rows.
    """
    t = {n: table(spark, folder, n) for n in ("lineitem", "part", "supplier", "nation", "region")}
    if lineitem is not None:
        t["lineitem"] = lineitem
    return (
        t["lineitem"]
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .repartition(*tasks_for(t["lineitem"]), "l_orderkey", "l_linenumber")
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )


def places(spark: SparkSession, folder: str, lineitem: DataFrame | None = None) -> DataFrame:
    return joined(spark, folder, lineitem).selectExpr(
        *(f"{EXPRESSIONS[c]} AS {c}" for c in COLUMNS), *ORDER
    )


def write_places(spark: SparkSession, folder: str, path: str, columns: Sequence[str]) -> None:
    """Store the table; line items too many for one job are joined share by share."""
    lineitem = table(spark, folder, "lineitem")
    rows = lineitem.count()
    shares = -(-rows // rows_per_job(rows)) or 1
    share = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(shares))
    with freeing(spark):
        for k in range(shares):
            part = lineitem.where(share == k) if shares > 1 else lineitem
            places(spark, folder, part).select(*columns).write.mode("append").parquet(path)


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    expressions = {**EXPRESSIONS, "postal_code": DELIVERED_CODE}
    return joined(spark, folder).selectExpr(
        *(f"{expressions[c]} AS {c}" for c in COLUMNS), *ORDER
    )


def places_sql(delivered: bool = False) -> str:
    """The same projection as a sub-query for DuckDB."""
    expressions = {**EXPRESSIONS, **({"postal_code": DELIVERED_CODE} if delivered else {})}
    columns = ", ".join(f"{expressions[c]} AS {c}" for c in COLUMNS)
    return f"SELECT {columns}, {', '.join(ORDER)} FROM {SOURCE}".replace("AS STRING", "AS VARCHAR")
