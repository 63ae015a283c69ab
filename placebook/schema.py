"""The canonical table: column names, types, view keys and search columns."""

from __future__ import annotations

from pyspark.sql import types as T

# The 24 delivered columns in order. Everything is text except the
# two coordinates.
COLUMNS = [
    "country_iso2",
    "country_iso3",
    "country_en",
    "country_lc",
    "continent_code",
    "continent_name",
    "postal_code",
    "postal_code_norm",
    "place_name",
    "region_1_lc",
    "region_1_en",
    "region_1_iso_code",
    "region_2_lc",
    "region_2_en",
    "region_3_lc",
    "region_3_en",
    "region_4_lc",
    "region_4_en",
    "region_5_lc",
    "region_5_en",
    "latitude",
    "longitude",
    "timezone",
    "utc_offset",
]
NUMERIC_COLUMNS = ["latitude", "longitude"]
TEXT_COLUMNS = [c for c in COLUMNS if c not in NUMERIC_COLUMNS]

MASTER = T.StructType(
    [
        T.StructField(c, T.DoubleType() if c in NUMERIC_COLUMNS else T.StringType())
        for c in COLUMNS
    ]
)

GROUP = "country_iso2"
LEVELS = range(1, 6)

# level -> {suffix: column}
LEVEL_COLUMNS = {n: {s: f"region_{n}_{s}" for s in ("lc", "en")} for n in LEVELS}
REGION_COLUMNS = [c for n in LEVELS for c in LEVEL_COLUMNS[n].values()]

ALL_ROWS = "all_rows"
VIEW_KEYS = {"postal_codes": ["postal_code"], "admin_areas": REGION_COLUMNS}
VIEWS = [ALL_ROWS, *VIEW_KEYS]
FORMATS = ["csv", "xlsx", "parquet"]

SEARCH_COLUMNS = ["postal_code", "postal_code_norm", "place_name", *REGION_COLUMNS]

# Where a row lies in the files of a table: the file's path, and the row in it.
FILE_ORDER = ["file_path", "row_index"]

# Row limits.
SAMPLE_ROWS = 100
SHEET_ROW_LIMIT = 1_048_575
PREVIEW_DEFAULT, PREVIEW_MAX, NEEDLE_MAX = 100, 1000, 100
BUNDLE_MAX = 200

FILE_ENTRY = "struct<bytes:bigint,raw:boolean,name:string>"
LEVEL_ENTRY = (
    "struct<level:int,label:string,filled_pct:double,has_en:boolean,has_lc:boolean>"
)

# One catalog record per group. Optional fields are null where a status lacks them.
CATALOG_ENTRY = f"""
    iso2 string, iso3 string, iso_numeric string, name_en string, name_lc string,
    continent_code string, continent_name string, status string, last_updated string,
    source_file string, source_batch string, source_rows bigint, rows bigint,
    admin_depth int, admin_levels array<{LEVEL_ENTRY}>, coord_coverage_pct double,
    has_place_name boolean, postal_code_example string, region_1_iso_coverage_pct double,
    files map<string,{FILE_ENTRY}>, files_are_source boolean, source_columns array<string>,
    note string, view_stats map<string,struct<rows:bigint>>,
    view_files map<string,map<string,{FILE_ENTRY}>>,
    sample_csv struct<bytes:bigint,rows:bigint>, drive_links map<string,string>
"""

CATALOG_TOTALS = """
    countries bigint, countries_with_files bigint, delivered_no_data bigint, rows bigint,
    continents array<string>, last_updated_range array<string>,
    download_bytes struct<parquet:bigint,sample_csv:bigint>
"""


def entry_type() -> T.StructType:
    return T.StructType.fromDDL(CATALOG_ENTRY)


def document_type() -> T.StructType:
    return T.StructType(
        [
            T.StructField("generated_at", T.StringType()),
            T.StructField("totals", T.StructType.fromDDL(CATALOG_TOTALS)),
            T.StructField("countries", T.ArrayType(entry_type())),
        ]
    )
