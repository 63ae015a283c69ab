"""Dimension tables for the checks, derived from the nation and region tables.

As in :mod:`placebook.plans.places`, the SQL text is portable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placebook.operators.catalog import Dimensions
from placebook.plans.places import CODE, table

_N = "CAST(n_nationkey AS STRING)"

VERSIONS = f"""SELECT {CODE} AS country_iso2,
  concat('Batch ', CAST(n_regionkey AS STRING), '/SRC_', {CODE}, '_v', CAST(n_nationkey % 3 AS STRING), '.csv') AS selected_rel_path,
  concat('Batch ', CAST(n_regionkey AS STRING)) AS selected_batch,
  CASE WHEN n_nationkey % 9 = 4 THEN '' ELSE CAST(n_nationkey * 10 AS STRING) END AS n_rows,
  concat('2024-', lpad(CAST(1 + n_nationkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + n_nationkey AS STRING), 2, '0')) AS last_updated
FROM nation WHERE n_nationkey <> 24"""

COUNTRIES = f"""SELECT {CODE} AS country_iso2, concat({CODE}, 'R') AS country_iso3,
  concat('Ref ', n_name) AS country_en,
  CASE WHEN r_name = 'AMERICA' THEN 'NA' ELSE substr(r_name, 1, 2) END AS continent_code,
  r_name AS continent_name
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 23"""

NO_POSTAL = f"SELECT {CODE} AS country_iso2 FROM nation WHERE n_nationkey IN (7, 15)"

NUMERIC = f"""SELECT {CODE} AS alpha_2, lpad(CAST(n_nationkey * 4 AS STRING), 3, '0') AS numeric
FROM nation WHERE n_nationkey % 10 <> 9"""

LANGUAGES = f"""SELECT {CODE} AS country_iso2,
  CASE WHEN n_nationkey % 10 = 0 THEN 'en' ELSE concat('l', {_N}) END AS language
FROM nation WHERE n_nationkey % 6 <> 1"""

TRANSLATIONS = f"""SELECT {CODE} AS country_iso2,
  CASE WHEN n_nationkey % 10 = 0 THEN 'en' ELSE concat('l', {_N}) END AS language,
  concat('T-', n_name) AS name_lc
FROM nation WHERE n_nationkey % 4 <> 2"""

TEXTS = {
    "versions": VERSIONS,
    "countries": COUNTRIES,
    "no_postal": NO_POSTAL,
    "numeric": NUMERIC,
    "languages": LANGUAGES,
    "translations": TRANSLATIONS,
}


def _run(spark: SparkSession, folder: str, text: str) -> DataFrame:
    names = {n: f"{{{n}}}" for n in ("nation", "region")}
    tables = {n: table(spark, folder, n) for n in names if f" {n}" in text}
    for n in tables:
        text = text.replace(f"FROM {n}", f"FROM {names[n]}").replace(f"JOIN {n}", f"JOIN {names[n]}")
    return spark.sql(text, **tables)


def dimensions(spark: SparkSession, folder: str) -> Dimensions:
    return Dimensions(**{k: _run(spark, folder, v) for k, v in TEXTS.items()})


def dimension_sql(name: str) -> str:
    return TEXTS[name].replace("AS STRING", "AS VARCHAR")
