"""Catalog assembly, listing, requests, links and the map."""

from __future__ import annotations

from pyspark.sql import functions as F

from placebook.operators import catalog as C
from placebook.operators import links as L
from placebook.operators import listing as B
from placebook.operators import profile as P
from placebook.operators import requests as R
from placebook.operators.consensus import distinct_counts
from placebook.operators.upstream import with_code
from placebook.plans.dimensions import dimension_sql, dimensions
from placebook.plans.places import CODE, ORDER, delivered, table
from placebook.plans.registry import query
from placebook.plans.table_queries import LEVEL_SQL, coverage_sql, opening_sql
from placebook.schema import COLUMNS, GROUP, REGION_COLUMNS, VIEW_KEYS
from placebook.session import settle
from placebook.sinks.samples import sample_rows, sample_sizes

# Stored bytes are unknown to SQL, so the checks give files made-up sizes by rule:
# ten bytes per row of the table, eleven per source row.
BYTES_PER_ROW, BYTES_PER_SOURCE_ROW = 10, 11


def master(spark, folder):
    return with_code(delivered(spark, folder))


def entries(spark, folder, views: bool = True, samples: bool = True):
    """Catalog entries without writing any views; parts nobody asks for are left out."""
    dims = dimensions(spark, folder)
    rows = master(spark, folder)
    if views or samples:
        # Several passes follow; the joins behind the table are worth doing once.
        rows = settle(rows, "master")
    base = settle(C.base_entries(dims, P.profile(rows, ORDER)), "entries")
    none = F.lit(None)
    files = base.where(F.col("status") == C.COVERED).select(
        "iso2", F.lit("parquet").alias("fmt"), (F.col("rows") * BYTES_PER_ROW).alias("bytes"),
        none.alias("raw"), none.alias("name"),
    )
    counts = spark.createDataFrame([], "iso2 string, view string, rows bigint")
    if views:
        counts = distinct_counts(rows, VIEW_KEYS, [GROUP]).withColumnRenamed(GROUP, "iso2")
        counts = settle(counts, "counts")
    stored = counts.select("iso2", "view", (F.col("rows") * BYTES_PER_ROW).alias("bytes"))
    covered = C.covered_entries(
        base, C.file_map(files, "fmt", "iso2"), C.view_maps(counts, "iso2"), C.view_file_maps(stored, "iso2")
    )
    bare = base.where(F.col("status") == C.NO_DATA)
    sources = bare.select(
        "iso2", F.lit("csv").alias("fmt"), (F.col("source_rows") * BYTES_PER_SOURCE_ROW).alias("bytes"),
        F.lit(True).alias("raw"), F.col("source_file").alias("name"),
    )
    uncovered = C.undescribed(bare).drop("files").join(C.file_map(sources, "fmt", "iso2"), "iso2", "left")
    sizes = spark.createDataFrame([], "iso2 string, bytes bigint, rows bigint")
    if samples:
        sizes = sample_sizes(sample_rows(rows, ORDER), COLUMNS).withColumnRenamed(GROUP, "iso2")
    return settle(C.all_entries(covered, uncovered, sizes), "catalog")


def _view_count(keys) -> str:
    return (
        f"SELECT {GROUP}, count(*) AS n FROM (SELECT DISTINCT {', '.join([GROUP, *keys])} FROM master) GROUP BY {GROUP}"
    )


_LINE_BYTES = " + ".join(
    [
        f"CASE WHEN {c} IS NULL THEN 2 ELSE octet_length(encode(replace({c}, '\"', '\"\"'))) + 2 END"
        if c not in ("latitude", "longitude")
        else f"CASE WHEN {c} IS NULL THEN 2 ELSE length(CAST({c} AS VARCHAR)) END"
        for c in COLUMNS
    ]
)
_HEADER_BYTES = sum(len(c) + 2 for c in COLUMNS) + len(COLUMNS) - 1 + 1

SAMPLE_SQL = f"""SELECT {GROUP}, count(*) AS sample_count,
    CAST(sum({_LINE_BYTES} + {len(COLUMNS) - 1} + 1) + {_HEADER_BYTES} AS BIGINT) AS sample_bytes
    FROM (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY {', '.join(ORDER)}) AS rn FROM master)
    WHERE rn <= 100 GROUP BY {GROUP}"""

ENTRIES_SQL = f"""SELECT v.country_iso2 AS iso2,
  CASE WHEN p.rows > 0 THEN o.country_iso3 ELSE r.country_iso3 END AS iso3,
  n.numeric AS iso_numeric,
  CASE WHEN p.rows > 0 THEN o.country_en ELSE coalesce(r.country_en, v.country_iso2) END AS name_en,
  CASE WHEN p.rows > 0 THEN o.country_lc ELSE t.name_lc END AS name_lc,
  CASE WHEN p.rows > 0 THEN o.continent_code ELSE r.continent_code END AS continent_code,
  CASE WHEN p.rows > 0 THEN o.continent_name ELSE r.continent_name END AS continent_name,
  CASE WHEN p.rows > 0 THEN 'covered' ELSE 'delivered_no_data' END AS status,
  v.last_updated,
  regexp_extract(v.selected_rel_path, '[^/]*$') AS source_file,
  v.selected_batch AS source_batch,
  CASE WHEN v.n_rows = '' THEN 0 ELSE CAST(v.n_rows AS BIGINT) END AS source_rows,
  coalesce(p.rows, 0) AS rows,
  coalesce(p.admin_depth, 0) AS admin_depth,
  p.coord_coverage_pct, p.has_place_name, p.region_1_iso_coverage_pct, o.postal_code_example,
  pc.n AS postal_codes_rows, aa.n AS admin_areas_rows,
  s.sample_count, s.sample_bytes
FROM ({dimension_sql('versions')}) v
LEFT JOIN ({coverage_sql('master')}) p ON p.{GROUP} = v.country_iso2
LEFT JOIN ({opening_sql('master')}) o ON o.{GROUP} = v.country_iso2
LEFT JOIN ({dimension_sql('countries')}) r ON r.country_iso2 = v.country_iso2
LEFT JOIN ({dimension_sql('numeric')}) n ON n.alpha_2 = v.country_iso2
LEFT JOIN ({dimension_sql('languages')}) g ON g.country_iso2 = v.country_iso2
LEFT JOIN ({dimension_sql('translations')}) t ON t.country_iso2 = g.country_iso2 AND t.language = g.language
LEFT JOIN ({_view_count(VIEW_KEYS['postal_codes'])}) pc ON pc.{GROUP} = v.country_iso2
LEFT JOIN ({_view_count(REGION_COLUMNS)}) aa ON aa.{GROUP} = v.country_iso2
LEFT JOIN ({SAMPLE_SQL}) s ON s.{GROUP} = v.country_iso2"""

FLAT = [
    "iso2", "iso3", "iso_numeric", "name_en", "name_lc", "continent_code", "continent_name", "status",
    "last_updated", "source_file", "source_batch", "source_rows", "rows", "admin_depth",
    "coord_coverage_pct", "has_place_name", "region_1_iso_coverage_pct", "postal_code_example",
]


def flat(df):
    """Catalog entries without nested fields, so that plain rows can be compared."""
    views = {v: F.element_at("view_stats", v)["rows"].alias(f"{v}_rows") for v in VIEW_KEYS}
    return df.select(
        *FLAT, *views.values(), F.col("sample_csv.rows").alias("sample_count"), F.col("sample_csv.bytes").alias("sample_bytes")
    )


@query("catalog_entries", ENTRIES_SQL)
def catalog_entries(spark, folder):
    return flat(entries(spark, folder))


@query("catalog_order", f"SELECT iso2, name_en FROM ({ENTRIES_SQL}) ORDER BY name_en, iso2")
def catalog_order(spark, folder):
    return C.by_name(entries(spark, folder, views=False, samples=False)).select("iso2", "name_en")


@query(
    "catalog_levels",
    f"""SELECT l.{GROUP} AS iso2, l.level, l.label, l.filled_pct, l.has_en, l.has_lc
    FROM ({LEVEL_SQL.replace('FROM places', 'FROM master')}) l
    JOIN ({coverage_sql('master')}) c USING ({GROUP})
    JOIN ({dimension_sql('versions')}) v ON v.country_iso2 = l.{GROUP} WHERE l.level <= c.admin_depth""",
)
def catalog_levels(spark, folder):
    return entries(spark, folder, views=False, samples=False).select("iso2", F.inline("admin_levels"))


@query(
    "catalog_totals",
    f"""SELECT count(*) FILTER (WHERE status = 'covered') AS countries, count(*) AS countries_with_files,
    count(*) FILTER (WHERE status <> 'covered') AS delivered_no_data, CAST(sum(rows) AS BIGINT) AS rows,
    string_agg(DISTINCT CASE WHEN status = 'covered' AND continent_name <> '' THEN continent_name END, ','
      ORDER BY CASE WHEN status = 'covered' AND continent_name <> '' THEN continent_name END) AS continents,
    min(last_updated) AS first_updated, max(last_updated) AS last_updated,
    CAST(coalesce(sum(rows * {BYTES_PER_ROW}) FILTER (WHERE status = 'covered'), 0) AS BIGINT) AS parquet_bytes,
    CAST(sum(coalesce(sample_bytes, 0)) AS BIGINT) AS sample_bytes FROM ({ENTRIES_SQL})""",
)
def catalog_totals(spark, folder):
    return C.catalog_totals(entries(spark, folder, views=False)).select(
        "countries", "countries_with_files", "delivered_no_data", "rows",
        F.array_join("continents", ",").alias("continents"),
        F.get("last_updated_range", 0).alias("first_updated"),
        F.get("last_updated_range", 1).alias("last_updated"),
        F.col("download_bytes.parquet").alias("parquet_bytes"),
        F.col("download_bytes.sample_csv").alias("sample_bytes"),
    )


STATUS_SQL = f"""SELECT v.country_iso2, CASE WHEN m.n > 0 THEN 'covered' ELSE 'delivered_no_data' END AS status
FROM ({dimension_sql('versions')}) v
LEFT JOIN (SELECT {GROUP}, count(*) AS n FROM master GROUP BY {GROUP}) m ON m.{GROUP} = v.country_iso2"""


def statuses(spark, folder):
    counts = P.row_counts(master(spark, folder), [GROUP])
    return C.with_status(dimensions(spark, folder).versions, counts).select(GROUP, "status")


@query("group_status", STATUS_SQL)
def group_status(spark, folder):
    return statuses(spark, folder)


@query(
    "unreported_groups",
    f"SELECT country_iso2 FROM ({STATUS_SQL}) WHERE status <> 'covered' AND country_iso2 NOT IN ({dimension_sql('no_postal')})",
)
def unreported_groups(spark, folder):
    return C.unreported(statuses(spark, folder), dimensions(spark, folder).no_postal)


@query(
    "groups_without_numeric",
    f"SELECT country_iso2 FROM ({dimension_sql('versions')}) WHERE country_iso2 NOT IN (SELECT alpha_2 FROM ({dimension_sql('numeric')}))",
)
def groups_without_numeric(spark, folder):
    dims = dimensions(spark, folder)
    return C.without_numeric(dims.versions, dims.numeric)


# Listing ---------------------------------------------------------------------


@query(
    "catalog_facets",
    f"""SELECT iso2 FROM ({ENTRIES_SQL}) WHERE continent_name = 'AMERICA' AND status = 'covered'
    AND (name_en ILIKE '%b%' OR iso2 ILIKE '%b%' OR coalesce(iso3, '') ILIKE '%b%'
      OR coalesce(name_lc, '') ILIKE '%b%')""",
)
def catalog_facets(spark, folder):
    return B.facets(entries(spark, folder, views=False, samples=False), "AMERICA", "covered", " B ").select("iso2")


@query(
    "listing_by_areas",
    f"SELECT iso2, coalesce(admin_areas_rows, 0) AS area_rows FROM ({ENTRIES_SQL}) ORDER BY 2 DESC, name_en",
)
def listing_by_areas(spark, folder):
    ordered = B.sort_entries(entries(spark, folder, samples=False), "admin_area_rows", descending=True)
    return ordered.select("iso2", B.area_rows().alias("area_rows"))


@query("listing_by_continent", f"SELECT iso2, continent_name FROM ({ENTRIES_SQL}) ORDER BY continent_name, name_en")
def listing_by_continent(spark, folder):
    return B.sort_entries(entries(spark, folder, views=False, samples=False), "continent_name").select("iso2", "continent_name")


@query(
    "listing_totals",
    f"""SELECT count(*) AS listed, CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows_listed
    FROM ({ENTRIES_SQL}) WHERE continent_name = 'ASIA'""",
)
def listing_totals(spark, folder):
    return B.listing_totals(B.facets(entries(spark, folder, views=False, samples=False), region="ASIA"))


# A request list: codes in mixed case, with repeats, one of them unknown.
REQUESTED = f"""SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower({CODE}) ELSE {CODE} END AS iso2,
  CAST(n_nationkey * 7 % 25 AS BIGINT) AS position FROM nation WHERE n_nationkey % 3 <> 1
UNION ALL SELECT {CODE}, CAST(100 + n_nationkey AS BIGINT) FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT 'zz', CAST(3 AS BIGINT) FROM region WHERE r_regionkey = 0"""


def requested(spark, folder):
    tables = {n: table(spark, folder, n) for n in ("nation", "region")}
    text = REQUESTED.replace("FROM nation", "FROM {nation}").replace("FROM region", "FROM {region}")
    return spark.sql(text, **tables)


SELECTED_SQL = f"SELECT upper(iso2) AS iso2, min(position) AS position FROM ({REQUESTED}) GROUP BY 1"


@query("selected_codes", SELECTED_SQL)
def selected_codes(spark, folder):
    return R.selected_codes(requested(spark, folder))


@query(
    "first_occurrences",
    """SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY seen) AS priorities FROM
    (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def priorities_in_order(spark, folder):
    orders = table(spark, folder, "orders")
    # Repeats go before anything is listed, so a list holds each value once.
    firsts = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("seen"))
    listed = F.array_sort(F.collect_list(F.struct("seen", "o_orderpriority")))
    values = F.transform(listed, lambda x: x.o_orderpriority)
    return firsts.groupBy("o_custkey").agg(F.array_join(values, "|").alias("priorities"))


@query(
    "selection_totals",
    f"""SELECT count(sample_count) AS sendable, CAST(coalesce(sum(sample_bytes), 0) AS BIGINT) AS sample_bytes,
    count(*) FILTER (WHERE sample_count IS NULL) AS without_sample
    FROM ({ENTRIES_SQL}) JOIN ({SELECTED_SQL}) USING (iso2)""",
)
def selection_totals(spark, folder):
    return B.selection_totals(R.selection(entries(spark, folder, views=False), requested(spark, folder)))


EFFECTIVE = {
    "all_rows": "CASE WHEN status = 'covered' THEN rows ELSE source_rows END",
    "postal_codes": "CASE WHEN status = 'covered' THEN coalesce(postal_codes_rows, rows) ELSE source_rows END",
    "admin_areas": "CASE WHEN status = 'covered' THEN coalesce(admin_areas_rows, rows) ELSE source_rows END",
}


@query(
    "effective_rows",
    " UNION ALL ".join(f"SELECT iso2, '{v}' AS view, {e} AS rows FROM ({ENTRIES_SQL})" for v, e in EFFECTIVE.items()),
)
def effective_rows(spark, folder):
    found = entries(spark, folder, samples=False)
    views = F.explode(F.array(*map(F.lit, EFFECTIVE))).alias("view")
    asked = found.select("*", views)
    return asked.select("iso2", "view", R.effective_rows(F.col("view")).alias("rows"))


@query(
    "raw_files",
    f"""SELECT iso2, 'csv' AS fmt, source_file AS name, source_rows * {BYTES_PER_SOURCE_ROW} AS bytes
    FROM ({ENTRIES_SQL}) WHERE status <> 'covered'""",
)
def raw_files(spark, folder):
    return R.raw_files(entries(spark, folder, views=False, samples=False))


# Requests: every code asked for in every format and view, good and bad. So that every
# rule has a row, some covered groups have lost their rows, some do not offer a view, and
# some files are not there.
ASKED_SQL = f"""SELECT iso2, fmt, view FROM ({SELECTED_SQL})
CROSS JOIN (VALUES ('csv'), ('xlsx'), ('parquet'), ('pdf')) f(fmt)
CROSS JOIN (VALUES ('all_rows'), ('postal_codes'), ('admin_areas'), ('other')) v(view)"""
SHEET_LIMIT = 2_300
_NTH = "ascii(iso2) % 7"
EMPTIED, NOT_OFFERED = f"status = 'covered' AND {_NTH} = 1", f"{_NTH} = 2"
NOT_THERE = f"(status <> 'covered' AND {_NTH} = 4) OR (status = 'covered' AND {_NTH} = 5 AND fmt = 'parquet')"

OFFERED_SQL = f"""SELECT * REPLACE (CASE WHEN {EMPTIED} THEN 0 ELSE rows END AS rows,
  CASE WHEN {NOT_OFFERED} THEN NULL ELSE admin_areas_rows END AS admin_areas_rows) FROM ({ENTRIES_SQL})"""

RULES = f"""CASE WHEN fmt NOT IN ('csv', 'xlsx', 'parquet') OR view NOT IN ('all_rows', 'postal_codes', 'admin_areas') THEN '422 unknown format or view'
  WHEN status IS NULL THEN '404 unknown group'
  WHEN status <> 'covered' AND fmt <> 'csv' THEN '409 not available as ' || fmt || ', try csv'
  WHEN status <> 'covered' AND ({NOT_THERE}) THEN '404 file is not in place'
  WHEN status = 'covered' AND rows = 0 THEN '409 no rows to export'
  WHEN status = 'covered' AND CASE view WHEN 'postal_codes' THEN postal_codes_rows IS NULL WHEN 'admin_areas' THEN admin_areas_rows IS NULL ELSE false END THEN '409 view not offered'
  WHEN status = 'covered' AND fmt = 'xlsx' AND served > {SHEET_LIMIT} THEN '409 too many rows for a sheet'
  WHEN status = 'covered' AND ({NOT_THERE}) THEN '409 not generated' ELSE '200 ok' END"""


def decided_sql(asked: str, columns: str) -> str:
    """Requests with the code, reason, file, rows and bytes they get; columns of the catalog beside them."""
    served = f"CASE view WHEN 'postal_codes' THEN {EFFECTIVE['postal_codes']} WHEN 'admin_areas' THEN {EFFECTIVE['admin_areas']} ELSE {EFFECTIVE['all_rows']} END"
    # Materialized step by step, or the engine trips over its own dictionaries of text.
    return f"""WITH offered AS MATERIALIZED ({OFFERED_SQL}), asked AS MATERIALIZED ({asked}),
    both_sides AS MATERIALIZED (SELECT *, {served} AS served FROM asked LEFT JOIN offered USING (iso2)),
    ruled AS MATERIALIZED (SELECT *, {RULES} AS rule FROM both_sides)
    SELECT {columns}, CAST(left(rule, 3) AS INTEGER) AS code, substr(rule, 5) AS reason,
    CASE WHEN rule = '200 ok' THEN CASE WHEN status <> 'covered' THEN source_file
      ELSE iso2 || '.' || CASE WHEN view = 'all_rows' THEN '' ELSE view || '.' END || fmt END END AS file,
    CASE WHEN rule = '200 ok' THEN served END AS rows,
    CASE WHEN rule = '200 ok' THEN CASE WHEN status <> 'covered' THEN source_rows * {BYTES_PER_SOURCE_ROW} ELSE served * {BYTES_PER_ROW} END END AS bytes,
    CASE WHEN rule = '200 ok' THEN last_updated END AS last_updated, CASE WHEN rule = '200 ok' THEN source_file END AS source_file,
    CASE WHEN rule = '200 ok' THEN status <> 'covered' END AS raw
    FROM ruled"""


def offered(spark, folder):
    """(entries, served): a catalog with gaps, and the files that are there."""
    found = entries(spark, folder, samples=False)
    gone = lambda rule: F.expr(rule)
    found = found.withColumn("rows", F.when(gone(EMPTIED), F.lit(0)).otherwise(F.col("rows"))).withColumn(
        "view_stats", F.when(gone(NOT_OFFERED), F.map_filter("view_stats", lambda k, _: k != "admin_areas")).otherwise(F.col("view_stats"))
    )
    each = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    tables = found.where("status = 'covered'").select("*", each(["csv", "xlsx", "parquet"], "fmt")).select("*", each(["all_rows", *VIEW_KEYS], "view"))
    tables = tables.select("iso2", "status", "view", "fmt", (R.effective_rows(F.col("view")) * BYTES_PER_ROW).alias("bytes"))
    raw = R.raw_files(found).select("iso2", F.lit(C.NO_DATA).alias("status"), F.lit("all_rows").alias("view"), "fmt", "bytes")
    return found, settle(tables.unionByName(raw).where(~gone(NOT_THERE)).drop("status"), "served")


@query("request_decisions", decided_sql(ASKED_SQL, "iso2, fmt, view"))
def request_decisions(spark, folder):
    codes = R.selected_codes(requested(spark, folder)).select("iso2")
    each = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    asked = codes.select("iso2", each(["csv", "xlsx", "parquet", "pdf"], "fmt")).select(
        "iso2", "fmt", each(["all_rows", "postal_codes", "admin_areas", "other"], "view")
    )
    return R.decisions(asked, *offered(spark, folder), sheet_limit=SHEET_LIMIT)


# Bundles: those of customers, each asking for the groups of some of their orders, in
# mixed case and more than once. One customer asks for far too many.
BUNDLES = """SELECT CAST(o_custkey % 40 AS STRING) AS bundle,
  concat(CASE WHEN o_orderkey % 2 = 0 THEN chr(CAST(65 + k AS INT)) ELSE chr(CAST(97 + k AS INT)) END, chr(CAST(65 + r AS INT))) AS iso2,
  CASE o_custkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' ELSE 'parquet' END AS fmt,
  CASE o_custkey % 5 WHEN 0 THEN 'postal_codes' WHEN 1 THEN 'admin_areas' ELSE 'all_rows' END AS view, o_orderkey AS position
  FROM (SELECT *, o_orderkey % 25 AS k FROM orders WHERE o_custkey % 40 <> 7 AND o_orderkey % 300 < 8 OR o_custkey % 40 = 7)
  JOIN (SELECT n_nationkey, CASE WHEN n_nationkey = 24 THEN 25 ELSE n_regionkey END AS r FROM nation) ON n_nationkey = k"""
BUNDLES_SQL = BUNDLES.replace("AS STRING", "AS VARCHAR")
MEMBERS_SQL = f"""SELECT bundle, upper(iso2) AS iso2, min(position) AS position, arg_min(fmt, position) AS fmt,
  arg_min(view, position) AS view, count(*) AS asked FROM ({BUNDLES_SQL}) GROUP BY 1, 2"""
DECIDED_SQL = decided_sql(MEMBERS_SQL, "bundle, iso2, position, fmt, view, asked")
VERDICT_SQL = f"""WITH decided AS MATERIALIZED ({DECIDED_SQL}) SELECT bundle, fmt, view, CAST(CASE WHEN asked > 200 THEN 422 ELSE coalesce(fault.code, 200) END AS INTEGER) AS code,
  CASE WHEN asked > 200 THEN 'a bundle holds 1 to 200 groups' ELSE coalesce(fault.reason, 'ok') END AS reason,
  CASE WHEN asked <= 200 THEN fault.iso2 END AS refused,
  CASE WHEN fault IS NULL AND asked <= 200 THEN groups END AS groups, CASE WHEN fault IS NULL AND asked <= 200 THEN total_rows END AS rows,
  CASE WHEN fault IS NULL AND asked <= 200 THEN total_bytes END AS bytes, CASE WHEN fault IS NULL AND asked <= 200 THEN coalesce(raws, '') END AS raw_groups
  FROM (SELECT bundle, arg_min(fmt, position) AS fmt, arg_min(view, position) AS view, sum(asked) AS asked, count(*) AS groups,
    CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(bytes) AS BIGINT) AS total_bytes,
    arg_min({{'iso2': iso2, 'code': code, 'reason': reason}}, position) FILTER (WHERE code <> 200) AS fault,
    string_agg(iso2, ', ' ORDER BY position) FILTER (WHERE raw) AS raws FROM decided GROUP BY bundle)"""
MANIFEST_SQL = f"""WITH lines AS MATERIALIZED ({DECIDED_SQL}), granted AS MATERIALIZED ({VERDICT_SQL})
  SELECT bundle, position, iso2, file, rows, bytes, last_updated, source_file, raw FROM lines
  WHERE bundle IN (SELECT bundle FROM granted WHERE code = 200)"""


def bundles(spark, folder):
    t = {n: table(spark, folder, n) for n in ("orders", "nation")}
    asked = spark.sql(BUNDLES.replace("FROM orders", "FROM {orders}").replace("FROM nation", "FROM {nation}"), **t)
    return R.bundles(asked, *offered(spark, folder), sheet_limit=SHEET_LIMIT)


@query("bundle_verdicts", VERDICT_SQL)
def bundle_verdicts(spark, folder):
    return bundles(spark, folder)[0]


@query("bundle_manifest", MANIFEST_SQL)
def bundle_manifest(spark, folder):
    return R.manifest(bundles(spark, folder)[1])


@query(
    "bundle_totals",
    f"""SELECT bundle, count(*) AS groups, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes,
    coalesce(string_agg(CASE WHEN raw THEN iso2 END, ', ' ORDER BY position), '') AS raw_groups FROM ({MANIFEST_SQL}) GROUP BY bundle""",
)
def bundle_totals(spark, folder):
    return bundles(spark, folder)[0].where(F.col("code") == R.OK).select("bundle", "groups", "rows", "bytes", "raw_groups")


def cell_sql(text, width):
    padded = f"CASE WHEN length({text}) >= {width} THEN {text} || ' ' ELSE rpad({text}, {width}, ' ') END"
    return padded if width else text


# The manifest as its layout says it: titles at these places, then one line per file.
MANIFEST_LINE_SQL = " || ".join(
    cell_sql(text, width)
    for text, width in [
        ("iso2", 8), ("format('{:,}', rows)", 14), ("last_updated", 14), ("file", 36),
        ("source_file || CASE WHEN raw THEN ' (as delivered)' ELSE '' END", 0),
    ]
)


@query(
    "bundle_text",
    f"""WITH listed AS MATERIALIZED ({MANIFEST_SQL}), judged AS MATERIALIZED ({VERDICT_SQL})
    SELECT v.bundle, concat_ws(chr(10), 'group   rows          updated       served as                           made from', lines, '',
    format('{{:,}}', v.groups) || ' groups with ' || format('{{:,}}', v.rows) || ' rows in ' || format('{{:,}}', v.bytes) || ' bytes, '
      || fmt || ' of ' || replace(view, '_', ' ') || ', out of the catalog of 2024-01-01',
    CASE WHEN raw_groups <> '' THEN 'Served as delivered, without codes: ' || raw_groups END,
    CASE WHEN fmt = 'csv' THEN 'Read code columns as text; as numbers they lose leading zeros.' END, '') AS text
    FROM judged v JOIN (SELECT bundle, string_agg({MANIFEST_LINE_SQL}, chr(10) ORDER BY position) AS lines FROM listed GROUP BY bundle) l
    ON l.bundle = v.bundle""",
)
def bundle_text(spark, folder):
    verdicts, members = bundles(spark, folder)
    return R.manifest_text(verdicts, R.manifest(members), "2024-01-01")


@query(
    "sendable_selection",
    f"SELECT iso2, position, sample_bytes FROM ({ENTRIES_SQL}) JOIN ({SELECTED_SQL}) USING (iso2) WHERE sample_count IS NOT NULL",
)
def sendable_selection(spark, folder):
    chosen = R.selection(entries(spark, folder, views=False), requested(spark, folder), with_sample=True)
    return chosen.select("iso2", "position", F.col("sample_csv.bytes").alias("sample_bytes"))


# Links -----------------------------------------------------------------------

# A folder listing with one entry per order: good and bad names, repeats, unknown groups.
LISTING = """SELECT concat('f', CAST(o_orderkey AS STRING)) AS id,
  concat(CASE WHEN o_orderkey % 2 = 0 THEN chr(CAST(65 + o_custkey % 26 AS INT)) ELSE chr(CAST(97 + o_custkey % 26 AS INT)) END,
    CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE chr(CAST(65 + o_custkey % 26 % 5 AS INT)) END,
    CASE WHEN o_orderkey % 7 < 3 THEN '.csv' WHEN o_orderkey % 7 = 3 THEN '.CSV' WHEN o_orderkey % 7 = 4 THEN '.pdf'
    WHEN o_custkey % 26 < 9 THEN '.csv' ELSE '.xlsx' END) AS name,
  o_orderkey AS position FROM orders WHERE o_custkey % 26 <> 3"""
LISTING_SQL = LISTING.replace("AS STRING", "AS VARCHAR")
COVERED_SQL = f"SELECT DISTINCT {GROUP} AS iso2 FROM master WHERE {GROUP} IN (SELECT country_iso2 FROM ({dimension_sql('versions')}))"


def listing(spark, folder):
    return spark.sql(LISTING.replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))


def covered(spark, folder):
    found = statuses(spark, folder).where(F.col("status") == C.COVERED)
    return settle(found.select(F.col(GROUP).alias("iso2")), "covered")


CLASSIFIED_SQL = f"""SELECT id, name, position, iso2, fmt, CASE WHEN iso2 IS NULL THEN 'unmatched'
  WHEN iso2 IN ({COVERED_SQL}) THEN 'linked' ELSE 'unknown' END AS bucket
  FROM (SELECT *, CASE WHEN regexp_full_match(name, '[a-zA-Z]{{2}}\\.(csv|xlsx)') THEN upper(left(name, 2)) END AS iso2,
  CASE WHEN regexp_full_match(name, '[a-zA-Z]{{2}}\\.(csv|xlsx)') THEN substr(name, 4) END AS fmt FROM ({LISTING_SQL}))"""

LINKS_SQL = f"""SELECT iso2,
  'https://drive.google.com/file/d/' || arg_max(id, position) FILTER (WHERE fmt = 'csv') || '/view' AS csv,
  'https://drive.google.com/file/d/' || arg_max(id, position) FILTER (WHERE fmt = 'xlsx') || '/view' AS xlsx
  FROM ({CLASSIFIED_SQL}) WHERE bucket = 'linked' GROUP BY iso2"""


@query("listing_buckets", CLASSIFIED_SQL)
def listing_buckets(spark, folder):
    return L.classify_listing(listing(spark, folder), covered(spark, folder))


@query("link_table", LINKS_SQL)
def link_table(spark, folder):
    return L.link_table(L.classify_listing(listing(spark, folder), covered(spark, folder)))


@query(
    "link_summary",
    f"""SELECT (SELECT count(*) FROM ({COVERED_SQL})) AS covered, count(*) AS linked,
    count(*) FILTER (WHERE csv IS NOT NULL AND xlsx IS NOT NULL) AS with_both,
    count(*) FILTER (WHERE (csv IS NULL) <> (xlsx IS NULL)) AS with_one,
    (SELECT count(*) FROM ({COVERED_SQL})) - count(*) AS missing,
    (SELECT count(*) FROM ({CLASSIFIED_SQL}) WHERE bucket = 'unmatched') AS ignored_name,
    (SELECT count(*) FROM ({CLASSIFIED_SQL}) WHERE bucket = 'unknown') AS ignored_group
    FROM ({LINKS_SQL})""",
)
def link_summary(spark, folder):
    groups = covered(spark, folder)
    classified = L.classify_listing(listing(spark, folder), groups)
    return L.link_summary(groups, L.link_table(classified), classified)


@query(
    "links_missing",
    f"SELECT iso2 FROM ({COVERED_SQL}) WHERE iso2 NOT IN (SELECT iso2 FROM ({LINKS_SQL}))",
)
def links_missing(spark, folder):
    groups = covered(spark, folder)
    links = L.link_table(L.classify_listing(listing(spark, folder), groups))
    return L.not_linked(groups, links)


@query(
    "merged_links",
    f"""SELECT e.iso2, CASE WHEN status = 'covered' THEN l.csv ELSE 'kept' END AS csv,
    CASE WHEN status = 'covered' THEN l.xlsx END AS xlsx
    FROM ({ENTRIES_SQL}) e LEFT JOIN ({LINKS_SQL}) l USING (iso2)""",
)
def merged_links(spark, folder):
    found = entries(spark, folder, views=False, samples=False)
    links = L.link_table(L.classify_listing(listing(spark, folder), covered(spark, folder)))
    before = found.withColumn("drive_links", F.create_map(F.lit("csv"), F.lit("kept")))
    after = L.merge_links(before, links)
    return after.select(
        "iso2", *(F.element_at("drive_links", f).alias(f) for f in L.LINK_FORMATS)
    )


# Map -------------------------------------------------------------------------

# One feature per customer: by numeric code, by alias, or of neither kind.
FEATURES = """SELECT CASE WHEN c_custkey % 5 <> 0 THEN lpad(CAST(c_nationkey * 4 AS STRING), 3, '0') END AS id,
  CASE WHEN c_custkey % 10 = 0 THEN 'N. Alias' ELSE c_name END AS name FROM customer"""
ALIASES = {"N. Alias": "CC"}


def features(spark, folder, *extra):
    text = FEATURES.replace("SELECT", f"SELECT {', '.join([*extra, ''])}", 1)
    return spark.sql(
        text.replace("FROM customer", "FROM {customer}"), customer=table(spark, folder, "customer")
    )


@query(
    "map_features",
    f"""SELECT f.id, f.name, coalesce(a.iso2, b.iso2) AS iso2,
    CASE WHEN a.iso2 IS NULL AND b.iso2 IS NULL THEN 'absent'
    WHEN coalesce(a.status, b.status) <> 'covered' THEN 'hatch'
    WHEN coalesce(a.rows, b.rows) < 1000 THEN '<1K' WHEN coalesce(a.rows, b.rows) < 10000 THEN '1K–10K'
    WHEN coalesce(a.rows, b.rows) < 100000 THEN '10K–100K' WHEN coalesce(a.rows, b.rows) < 500000 THEN '100K–500K'
    ELSE '500K+' END AS fill
    FROM ({FEATURES.replace('AS STRING', 'AS VARCHAR')}) f
    LEFT JOIN ({ENTRIES_SQL}) a ON a.iso_numeric = f.id
    LEFT JOIN ({ENTRIES_SQL}) b ON f.name = 'N. Alias' AND b.iso2 = 'CC'""",
)
def map_features(spark, folder):
    shown = B.map_features(features(spark, folder), entries(spark, folder, views=False, samples=False), ALIASES)
    return shown.select("id", "name", "iso2", B.fill_state().alias("fill"))
