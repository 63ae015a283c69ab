"""Queries that write files from the tables and read them back, and the upstream stages."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placebook.functions.absence import has_text
from placebook.operators import upstream as U
from placebook.operators.consensus import distinct_keys
from placebook.operators.links import classify_listing, link_table
from placebook.operators.source_profile import source_levels, source_profile
from placebook.plans.build import build_entries, raw_sources
from placebook.plans.catalog_queries import (
    ENTRIES_SQL,
    FEATURES,
    LINKS_SQL,
    LISTING_SQL,
    covered,
    entries,
    features,
    flat,
    listing,
    master,
)
from placebook.plans.dimensions import dimension_sql, dimensions
from placebook.plans.places import CODE, ORDER, delivered, places, table, write_places
from placebook.plans.registry import query, says
from placebook.plans.table_queries import consensus_sql, percent_sql
from placebook.schema import COLUMNS, GROUP, NUMERIC_COLUMNS, TEXT_COLUMNS, VIEW_KEYS, VIEWS
from placebook.session import fresh_path, settle
from placebook.sinks import views as V
from placebook.sinks.catalog import write_document, write_records
from placebook.sinks.delimited import csv_line, write_csv
from placebook.sinks.samples import sample_rows, write_samples
from placebook.sources.delimited import (
    ENCODINGS,
    cells,
    read_dialect_csv,
    read_text_csv,
    read_versioned_sources,
)
from placebook.sources.tables import (
    read_catalog,
    read_catalog_header,
    read_features,
    read_files,
    read_listing,
    read_listing_chain,
    read_sources,
    read_view,
    read_views,
)

# Delimited text ----------------------------------------------------------------

# Awkward text on purpose: a code that looks like a null, quotes, padding, blanks,
# line breaks and leading zeros.
AWKWARD = """CASE c_custkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'a "quoted", b' WHEN 2 THEN ' padded '
  WHEN 4 THEN '' WHEN 5 THEN concat('line', chr(10), 'two') WHEN 6 THEN lpad(CAST(c_custkey AS STRING), 8, '0') END"""
AWKWARD_SQL = AWKWARD.replace("AS STRING", "AS VARCHAR")


def awkward(spark, folder):
    return table(spark, folder, "customer").selectExpr("c_custkey", "c_acctbal", f"{AWKWARD} AS note", "c_name")


@query(
    "csv_round_trip",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
    coalesce({AWKWARD_SQL}, '') AS note, c_name FROM customer""",
)
def csv_round_trip(spark, folder):
    path = fresh_path(spark, "csv")
    write_csv(awkward(spark, folder), path)
    return read_text_csv(spark, path)


@query(
    "csv_lines",
    "SELECT concat_ws(',', "
    + ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), '\"\"')" if c in NUMERIC_COLUMNS
        else f"concat('\"', replace(coalesce({c}, ''), '\"', '\"\"'), '\"')"
        for c in COLUMNS
    )
    + ") AS line FROM places",
)
def csv_lines(spark, folder):
    return places(spark, folder).select(*COLUMNS).transform(lambda df: df.select(csv_line(df).alias("line")))


@query(
    "sample_files",
    f"""SELECT {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in COLUMNS)} FROM
    (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY {', '.join(ORDER)}) AS rn FROM places)
    WHERE rn <= 100""",
)
def sample_files(spark, folder):
    path = fresh_path(spark, "samples")
    write_samples(sample_rows(places(spark, folder), ORDER, [*COLUMNS, *ORDER]), path, ORDER)
    return read_text_csv(spark, path, COLUMNS)


# A file in Latin-1 with semicolons. By row: fits, short, too long, too long with an
# empty surplus, quoted separator, accent and an empty last field.
RAGGED = '''CASE c_custkey % 6
  WHEN 0 THEN concat_ws(';', CAST(c_custkey AS STRING), c_name, c_mktsegment)
  WHEN 1 THEN concat_ws(';', CAST(c_custkey AS STRING), c_name)
  WHEN 2 THEN concat_ws(';', CAST(c_custkey AS STRING), c_name, c_mktsegment, 'surplus')
  WHEN 3 THEN concat_ws(';', CAST(c_custkey AS STRING), c_name, c_mktsegment, '', '')
  WHEN 4 THEN concat_ws(';', CAST(c_custkey AS STRING), '"a;""b"""', c_mktsegment)
  ELSE concat_ws(';', CAST(c_custkey AS STRING), concat('é ', c_name), '') END'''


@query(
    "dialect_csv",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 6 WHEN 4 THEN 'a;"b"' WHEN 5 THEN concat('é ', c_name)
    ELSE c_name END AS label, CASE c_custkey % 6 WHEN 1 THEN NULL WHEN 5 THEN '' ELSE c_mktsegment END AS segment
    FROM customer WHERE c_custkey % 6 NOT IN (2, 3)""",
)
def dialect_csv(spark, folder):
    path = fresh_path(spark, "dialect")
    lines = table(spark, folder, "customer").selectExpr(f"{RAGGED} AS `id;label;segment`")
    # The lines are complete: the writer, used for its encoding, must not quote them.
    plain = {"sep": "\x01", "quote": "\x00", "escape": "\x00", "escapeQuotes": False, "header": True}
    lines.write.options(**plain, encoding="ISO-8859-1").csv(path)
    return read_dialect_csv(spark, path, "ISO-8859-1", ";")


# Source files as delivered: every group has one, in one of three templates and dialects.
# A template is a list of header → expression over the delivered rows.
TEMPLATES = [
    {
        "place_name": "place_name", "Lat": "latitude", "region_1": "region_1_lc", "region_1_en": "NULL",
        "region_2": "NULL", "region_3": "region_2_en", "region_en": "region_1_en",
    },
    {
        "country_en": "country_en", "country_code": GROUP, "postal_code": "NULL",
        "region1_lc": "region_1_lc", "region1_en": "region_1_en", " Region2_LC ": "region_2_lc",
        "region2_en": "region_2_en", "region3_lc": "NULL", "region3_en": "NULL", "latitude": "latitude",
    },
    {
        "place_name": "place_name", "order8_name": "region_2_en", "order1_name": "concat('é;,', region_1_en)",
        "latitude": "NULL", "lat": "longitude",
    },
]
DIALECTS = [("UTF-8", ","), ("latin-1", ";"), ("utf-8-sig", "\t")]
_TEMPLATE = f"((ascii({GROUP}) - 65) % 3)"
# All files have one name, each in a folder of its own.
SOURCE_PATH = f"concat('batch=', {GROUP}, '/source=S.csv')"


def source_versions(spark, folder):
    """The version table with where the files really are, and how they are written."""
    pick = lambda i: F.element_at(F.array(*(F.lit(d[i]) for d in DIALECTS)), F.expr(f"{_TEMPLATE} + 1"))
    return dimensions(spark, folder).versions.withColumns(
        {"selected_rel_path": F.expr(SOURCE_PATH), "selected_encoding": pick(0), "selected_delimiter": pick(1)}
    )


def source_files(spark, folder):
    """A folder of source files, one per group."""
    path = fresh_path(spark, "sources")
    rows = delivered(spark, folder).withColumns({"batch": F.col(GROUP), "source": F.lit("S.csv")})
    for i, (columns, (encoding, sep)) in enumerate(zip(TEMPLATES, DIALECTS, strict=True)):
        of_template = rows.where(f"{_TEMPLATE} = {i}").repartition("batch")
        lines = of_template.selectExpr(*(f"CAST({e} AS STRING) AS `{h}`" for h, e in columns.items()), "batch", "source")
        plain = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "", "emptyValue": ""}
        written = lines.write.mode("append").partitionBy("batch", "source").options(header=True, quoteAll=True, escape='"', **plain)
        written.options(sep=sep, encoding=ENCODINGS.get(encoding, encoding)).csv(path)
    return path


def sources(spark, folder):
    root, versions = source_files(spark, folder), source_versions(spark, folder)
    there = versions.join(read_sources(spark, root), F.col("selected_rel_path") == F.col("rel_path"), "left_semi")
    return read_versioned_sources(spark, there, root)


def _level_sql(template, level, columns, en, lc) -> str:
    condition = " OR ".join(says(c) for c in columns) or "false"
    return f"""SELECT {SOURCE_PATH} AS file, CAST({level} AS INTEGER) AS level, count(*) AS rows,
    count(*) FILTER (WHERE {condition}) AS filled, {en} AS has_en, {lc} AS has_lc
    FROM selected WHERE {_TEMPLATE} = {template} GROUP BY {GROUP}"""


# Files that the version table selects.
SELECTED = f"selected AS (SELECT * FROM delivered WHERE {GROUP} IN (SELECT country_iso2 FROM ({dimension_sql('versions')})))"
LEVELS_SQL = " UNION ALL ".join(
    _level_sql(*args)
    for args in [
        (1, 1, ["region_1_lc", "region_1_en"], "true", "true"),
        (1, 2, ["region_2_lc", "region_2_en"], "true", "true"),
        (1, 3, [], "true", "true"),
        (0, 1, ["region_1_lc"], "true", "true"),
        (0, 2, [], "false", "true"),
        (0, 3, ["region_2_en"], "false", "true"),
        (2, 1, ["concat('é;,', region_1_en)"], "true", "false"),
        (2, 2, ["region_2_en"], "true", "false"),
    ]
)


@query("source_levels", f"WITH {SELECTED} {LEVELS_SQL}")
def levels_of_sources(spark, folder):
    return source_levels(sources(spark, folder)).withColumn("level", F.col("level").cast("int"))


# Per template: admin_depth, coordinates, whether places are named.
_SHAPES = [
    (f"CASE WHEN bool_or({says('region_2_en')}) THEN 3 WHEN bool_or({says('region_1_lc')}) THEN 1 ELSE 0 END", percent_sql("latitude IS NOT NULL"), "true"),
    (f"CASE WHEN bool_or({says('region_2_lc')} OR {says('region_2_en')}) THEN 2 WHEN bool_or({says('region_1_lc')} OR {says('region_1_en')}) THEN 1 ELSE 0 END",
     percent_sql("latitude IS NOT NULL"), "false"),
    (f"CASE WHEN bool_or({says('region_2_en')}) THEN 2 WHEN bool_or(region_1_en IS NOT NULL) THEN 1 ELSE 0 END", percent_sql("false"), "true"),
]
PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT {GROUP}, CAST({depth} AS INTEGER) AS admin_depth, {pct} AS coord_coverage_pct, {place} AS has_place_name,
    '{",".join(TEMPLATES[i])}' AS source_columns, count(*) AS lines FROM selected WHERE {_TEMPLATE} = {i} GROUP BY {GROUP}"""
    for i, (depth, pct, place) in enumerate(_SHAPES)
)


@query(
    "source_profile",
    f"""WITH {SELECTED} SELECT {SOURCE_PATH} AS file, CAST(0 AS BIGINT) AS rows, admin_depth, admin_depth AS listed_levels,
    coord_coverage_pct, has_place_name, source_columns FROM ({PROFILE_SQL})""",
)
def profile_of_sources(spark, folder):
    found = source_profile(sources(spark, folder))
    return found.select(
        "file", "rows", "admin_depth", F.size("admin_levels").alias("listed_levels"),
        "coord_coverage_pct", "has_place_name", F.array_join("source_columns", ",").alias("source_columns"),
    )


@query(
    "source_level_list",
    f"""WITH {SELECTED}, l AS (SELECT *, max(CASE WHEN filled > 0 THEN level ELSE 0 END) OVER (PARTITION BY file) AS depth FROM ({LEVELS_SQL}))
    SELECT file, level, concat('Level ', CAST(level AS VARCHAR)) AS label,
    round_even(CAST(100.0 AS DOUBLE) * filled / rows, 1) AS filled_pct, has_en, has_lc FROM l WHERE level <= depth""",
)
def level_list_of_sources(spark, folder):
    return source_profile(sources(spark, folder)).select("file", F.inline("admin_levels"))


@query(
    "source_cells",
    f"WITH {SELECTED} " + " UNION ALL ".join(
        f"""SELECT {SOURCE_PATH} AS file, '{h}' AS header, count(*) AS cells,
        count(*) FILTER (WHERE coalesce(trim(CAST({e} AS VARCHAR)) <> '', false)) AS filled,
        CAST(coalesce(sum(length(CAST({e} AS VARCHAR))), 0) AS BIGINT) AS chars
        FROM selected WHERE {_TEMPLATE} = {i} GROUP BY {GROUP}"""
        for i, columns in enumerate(TEMPLATES)
        for h, e in columns.items()
    ),
)
def cells_of_sources(spark, folder):
    found = cells(sources(spark, folder))
    return found.groupBy("file", "header").agg(
        F.count("*").alias("cells"), F.count_if(has_text("value")).alias("filled"), F.sum(F.length("value")).alias("chars")
    )


# Every template under the canonical names. Where the mapping is silent, or wrong for a
# group, overrides of that group say what a header means.
SOURCE_MAPPING = {
    "country_en": "country_en", "country_code": GROUP, "postal_code": "postal_code", "place_name": "place_name",
    "region1_lc": "region_1_lc", "region1_en": "region_1_en", "region2_lc": "region_2_lc", "region2_en": "region_2_en",
    "region_1": "region_1_lc", "region_1_en": "region_1_en", "region_en": "region_1_en", "latitude": "latitude", "lat": "latitude",
}
_OVERRIDES = [("order1_name", "region_1_en", "true"), ("order8_name", "region_2_en", "true"), ("lat", "longitude", f"{_TEMPLATE} = 2 AND ascii({GROUP}) % 2 = 0")]


def _mapped_sql(template) -> str:
    even = f"ascii({GROUP}) % 2 = 0"
    blank = "''"
    empty = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
    own = {
        # Of two headers for one column the first that says something is taken, else the last as it is.
        0: {"place_name": empty("place_name"), "latitude": "latitude", "region_1_lc": empty("region_1_lc"), "region_1_en": empty("region_1_en")},
        1: {"country_en": "country_en", GROUP: GROUP, "postal_code": blank, "region_1_lc": empty("region_1_lc"), "region_1_en": empty("region_1_en"),
            "region_2_lc": empty("region_2_lc"), "region_2_en": empty("region_2_en"), "latitude": "latitude"},
        2: {"place_name": empty("place_name"), "region_2_en": empty("region_2_en"), "region_1_en": "coalesce(concat('é;,', region_1_en), '')",
            "latitude": f"CASE WHEN NOT {even} THEN longitude END", "longitude": f"CASE WHEN {even} THEN longitude END"},
    }[template]
    columns = ", ".join(f"{own.get(c, 'CAST(NULL AS DOUBLE)' if c in NUMERIC_COLUMNS else 'CAST(NULL AS VARCHAR)')} AS {c}" for c in COLUMNS)
    return f"SELECT {SOURCE_PATH} AS file, {columns} FROM selected WHERE {_TEMPLATE} = {template}"


@query("mapped_sources", f"WITH {SELECTED} " + " UNION ALL ".join(_mapped_sql(i) for i in range(3)))
def mapped_sources(spark, folder):
    """All templates at once under the canonical names."""
    source = sources(spark, folder)
    mapping = spark.createDataFrame(list(SOURCE_MAPPING.items()), "header string, canonical string")
    versions = source_versions(spark, folder)
    own = [versions.where(rule).select(F.col("selected_rel_path").alias("file"), F.lit(h).alias("header"), F.lit(c).alias("canonical")) for h, c, rule in _OVERRIDES]
    return U.map_sources(source, mapping, own[0].unionByName(own[1]).unionByName(own[2]))


def _line_bytes_sql(template) -> str:
    size = "octet_length(encode({}))" if DIALECTS[template][0].startswith(("UTF", "utf")) else "length({})"
    columns = TEMPLATES[template]
    fields = " + ".join(size.format(f"coalesce(CAST({e} AS VARCHAR), '')") for e in columns.values())
    return f"CAST({sum(len(h) + 3 for h in columns)} + sum({fields} + {3 * len(columns)}) AS BIGINT)"


@query(
    "catalog_source_entries",
    f"""WITH {SELECTED}, p AS ({PROFILE_SQL}),
    b AS ({" UNION ALL ".join(f"SELECT {GROUP}, {_line_bytes_sql(i)} AS bytes FROM selected WHERE {_TEMPLATE} = {i} GROUP BY {GROUP}" for i in range(3))})
    SELECT e.iso2, e.name_en, e.status, 'source=S.csv' AS source_file, e.rows,
    CASE WHEN e.status = 'covered' THEN e.admin_depth ELSE p.admin_depth END AS admin_depth,
    CASE WHEN e.status = 'covered' THEN e.coord_coverage_pct ELSE p.coord_coverage_pct END AS coord_coverage_pct,
    CASE WHEN e.status = 'covered' THEN e.has_place_name ELSE p.has_place_name END AS has_place_name,
    CASE WHEN e.status <> 'covered' THEN p.source_columns END AS source_columns,
    CASE WHEN e.status <> 'covered' THEN b.bytes END AS csv_bytes,
    CASE WHEN e.status = 'covered' THEN e.sample_count ELSE least(p.lines, 100) END AS sample_count, true AS dated
    FROM ({ENTRIES_SQL}) e LEFT JOIN p ON p.{GROUP} = e.iso2 LEFT JOIN b ON b.{GROUP} = e.iso2""",
)
def catalog_source_entries(spark, folder):
    """The complete build, groups without rows being described by their source files."""
    stored, root = settle(master(spark, folder), "master"), source_files(spark, folder)
    versions = source_versions(spark, folder)
    dims = replace(dimensions(spark, folder), versions=versions)
    raw = raw_sources(spark, versions, stored, root)
    built = build_entries(stored, dims, ORDER, fresh_path(spark, "build"), raw)
    near = F.abs(F.datediff(F.to_date("last_updated"), F.current_date())) <= 1
    return built.select(
        "iso2", "name_en", "status", "source_file", "rows", "admin_depth", "coord_coverage_pct", "has_place_name",
        F.array_join("source_columns", ",").alias("source_columns"), F.element_at("files", "csv")["bytes"].alias("csv_bytes"),
        F.col("sample_csv.rows").alias("sample_count"), near.alias("dated"),
    )


# Views and their files -----------------------------------------------------------

VIEW_COUNTS_SQL = " UNION ALL ".join(
    [f'SELECT \'all_rows\' AS view, {GROUP} AS "group", count(*) AS rows FROM places GROUP BY {GROUP}']
    + [
        f'SELECT \'{name}\', {GROUP}, count(*) FROM (SELECT DISTINCT {", ".join([GROUP, *keys])} FROM places) GROUP BY {GROUP}'
        for name, keys in VIEW_KEYS.items()
    ]
)


@query("stored_view_counts", VIEW_COUNTS_SQL)
def stored_view_counts(spark, folder):
    path = fresh_path(spark, "views")
    V.write_views(places(spark, folder).select(*COLUMNS), path)
    return read_views(spark, path).groupBy("view", "group").agg(F.count("*").alias("rows"))


@query(
    "stored_view_rows",
    f"SELECT * FROM ({consensus_sql(['postal_code'])}) WHERE {GROUP} = 'DD'",
)
def stored_view_rows(spark, folder):
    path = fresh_path(spark, "views")
    V.write_views(places(spark, folder).select(*COLUMNS), path, ["postal_codes"])
    return read_view(spark, path, "postal_codes", "DD")


@query(
    "view_refresh",
    f"""SELECT 'new' AS round, view, "group", true AS stale FROM ({VIEW_COUNTS_SQL}) WHERE view <> 'all_rows'
    UNION ALL SELECT 'again', view, "group", false FROM ({VIEW_COUNTS_SQL}) WHERE view <> 'all_rows'
    UNION ALL SELECT 'one view more', view, "group", view = 'all_rows' FROM ({VIEW_COUNTS_SQL})
    UNION ALL SELECT 'changed', view, "group", true FROM ({VIEW_COUNTS_SQL})""",
)
def view_refresh(spark, folder):
    """What is stale at first, right after, with a view nobody has written, and after a change."""
    source, path = fresh_path(spark, "table"), fresh_path(spark, "views")
    write_places(spark, folder, source, COLUMNS)
    rounds = [("new", list(VIEW_KEYS)), ("again", list(VIEW_KEYS)), ("one view more", VIEWS)]
    reports = [(name, V.refresh_views(spark, source, path, views)) for name, views in rounds]
    spark.read.parquet(source).limit(1).write.mode("append").parquet(source)
    reports.append(("changed", V.refresh_views(spark, source, path)))
    return reduce(DataFrame.unionByName, (r.select(F.lit(name).alias("round"), "view", "group", "stale") for name, r in reports))


@query("csv_export", f"SELECT {', '.join(f'''coalesce(CAST({c} AS VARCHAR), '') AS {c}''' for c in COLUMNS)} FROM ({consensus_sql(['postal_code'])})")
def csv_export(spark, folder):
    path = fresh_path(spark, "export")
    V.export_csv(places(spark, folder).select(*COLUMNS), path, "postal_codes")
    return read_text_csv(spark, path, COLUMNS)


LIMIT = 2_400


@query(
    "sheet_eligibility",
    f"SELECT {GROUP}, count(*) AS rows, count(*) <= {LIMIT} AS eligible FROM places GROUP BY {GROUP}",
)
def sheet_eligibility(spark, folder):
    return V.sheet_eligibility(places(spark, folder), limit=LIMIT)


@query(
    "sheet_rows",
    f"""SELECT {', '.join(COLUMNS)} FROM places WHERE {GROUP} IN
    (SELECT {GROUP} FROM places GROUP BY {GROUP} HAVING count(*) <= {LIMIT})""",
)
def sheet_rows(spark, folder):
    return V.sheet_rows(places(spark, folder).select(*COLUMNS), TEXT_COLUMNS, limit=LIMIT)


@query(
    "file_metadata",
    """SELECT CAST(c_nationkey AS VARCHAR) AS name, CAST(sum(length(c_name) + 1) AS BIGINT) AS bytes, true AS dated
    FROM customer GROUP BY c_nationkey""",
)
def file_metadata(spark, folder):
    """Names to the byte: one file of customer names per nation, described by its listing."""
    path, since = fresh_path(spark, "names"), F.current_date()
    names = table(spark, folder, "customer").select(F.col("c_name").alias("value"), "c_nationkey")
    names.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    files = read_files(spark, path, "part-*")
    name = F.regexp_extract("path", r"/c_nationkey=([0-9]+)/", 1)
    near = F.abs(F.datediff(F.to_date("last_updated"), since)) <= 1
    return files.groupBy(name.alias("name")).agg(F.sum("bytes").alias("bytes"), F.bool_and(near).alias("dated"))


# Documents -----------------------------------------------------------------------


@query("catalog_document", ENTRIES_SQL)
def catalog_document(spark, folder):
    path = fresh_path(spark, "document")
    write_document(entries(spark, folder), path, "2024-01-01T00:00:00+00:00")
    return flat(read_catalog(spark, path))


@query(
    "catalog_header",
    f"""SELECT '2024-01-01T00:00:00+00:00' AS generated_at, count(*) FILTER (WHERE status = 'covered') AS countries,
    count(*) AS countries_with_files, CAST(sum(rows) AS BIGINT) AS rows FROM ({ENTRIES_SQL})""",
)
def catalog_header(spark, folder):
    path = fresh_path(spark, "document")
    found = entries(spark, folder, views=False, samples=False)
    write_document(found, path, "2024-01-01T00:00:00+00:00")
    header = read_catalog_header(spark, path)
    return header.select("generated_at", "countries", "countries_with_files", "rows")


@query("catalog_records", f"SELECT iso2, status, rows FROM ({ENTRIES_SQL})")
def catalog_records(spark, folder):
    path = fresh_path(spark, "records")
    found = entries(spark, folder, views=False, samples=False)
    write_records(found, path)
    return spark.read.schema(found.schema).json(path).select("iso2", "status", "rows")


@query("catalog_build", ENTRIES_SQL)
def catalog_build(spark, folder):
    stored = settle(master(spark, folder), "master")
    built = build_entries(stored, dimensions(spark, folder), ORDER, fresh_path(spark, "build"))
    return flat(built)


@query("feature_documents", FEATURES.replace("AS STRING", "AS VARCHAR"))
def feature_documents(spark, folder):
    path = fresh_path(spark, "features")
    # A thousand features per document, so that no document outgrows a task.
    geometry = F.struct("id", F.struct("name").alias("properties"))
    documents = (
        features(spark, folder, "c_custkey")
        .groupBy(F.floor(F.col("c_custkey") / 1000))
        .agg(F.collect_list(geometry).alias("geometries"))
    )
    documents.select(
        F.struct(F.struct("geometries").alias("countries")).alias("objects")
    ).write.json(path)
    return read_features(spark, path, multi_line=False)


@query("listing_pages", f"SELECT id, name FROM ({LISTING_SQL})")
def listing_pages(spark, folder):
    path = fresh_path(spark, "pages")
    pages = listing(spark, folder).groupBy(F.floor(F.col("position") / 1000)).agg(
        F.array_sort(F.collect_list(F.struct("position", "id", "name"))).alias("files")
    )
    kept = F.transform("files", lambda f: F.struct(f.id.alias("id"), f["name"].alias("name")))
    pages.select(kept.alias("files")).write.json(path)
    return read_listing(spark, path, multi_line=False).select("id", "name")


# Pages under tokens that say nothing about their order, in files of several pages.
PAGE_SIZE = 250
IN_PAGES = f"""SELECT id, name, position, dense_rank() OVER (ORDER BY position // {PAGE_SIZE}) - 1 AS page,
  row_number() OVER (PARTITION BY position // {PAGE_SIZE} ORDER BY position) - 1 AS entry FROM ({LISTING_SQL})"""


def chained(spark, folder):
    path = fresh_path(spark, "pages")
    entry = F.struct("position", "id", "name")
    number = F.floor(F.col("position") / PAGE_SIZE)
    pages = listing(spark, folder).groupBy(number.alias("number")).agg(F.array_sort(F.collect_list(entry)).alias("files"))
    token = F.when(F.lag("number").over(Window.orderBy("number")).isNotNull(), F.md5(F.col("number").cast("string")))
    following = F.md5(F.lead("number").over(Window.orderBy("number")).cast("string"))
    files = F.transform("files", lambda f: F.struct(f.id.alias("id"), f["name"].alias("name"))).alias("files")
    named = pages.select(token.alias("pageToken"), following.alias("nextPageToken"), files)
    named.repartition(4, "nextPageToken").sortWithinPartitions("nextPageToken").write.json(path)
    return read_listing_chain(spark, path, multi_line=False)


@query("listing_chain", f"SELECT id, name, CAST(page AS BIGINT) AS page, CAST(entry AS BIGINT) AS entry FROM ({IN_PAGES})")
def listing_chain(spark, folder):
    return chained(spark, folder).select("id", "name", "position.page", "position.entry")


@query("links_by_pages", LINKS_SQL)
def links_by_pages(spark, folder):
    """The last file listed wins, whatever the pages are called."""
    return link_table(classify_listing(chained(spark, folder), covered(spark, folder)))


# Upstream ------------------------------------------------------------------------

# Candidate files: one per order, spread over batches, revisions and versions.
CANDIDATES = """SELECT concat(chr(CAST(65 + o_custkey % 26 AS INT)), chr(CAST(65 + o_custkey % 11 AS INT))) AS country_iso2,
  concat(CASE WHEN o_orderkey % 50 = 0 AND o_custkey % 3 <> 0 THEN 'revisions' ELSE concat('Batch ', CAST(o_orderkey % 5 AS STRING)) END,
    '/SRC_', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('_v', CAST(o_orderkey % 12 AS STRING)) END, '.csv') AS rel_path
  FROM orders"""


@query(
    "version_resolution",
    """SELECT country_iso2, rel_path AS selected_rel_path, split_part(rel_path, '/', 1) AS selected_batch, v AS selected_version
    FROM (SELECT *, row_number() OVER (PARTITION BY country_iso2 ORDER BY rel_path LIKE 'revisions/%' DESC, v DESC, rel_path DESC) AS rn
    FROM (SELECT *, CASE WHEN regexp_matches(rel_path, '_v[0-9]+') THEN CAST(regexp_extract(rel_path, '_v([0-9]+)', 1) AS BIGINT) ELSE 0 END AS v
    FROM (""" + CANDIDATES.replace("AS STRING", "AS VARCHAR") + ")))  WHERE rn = 1",
)
def version_resolution(spark, folder):
    files = spark.sql(CANDIDATES.replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))
    return U.resolve_versions(files, "revisions")


# Headers as files spell them, and what they mean.
HEADERS = f"""SELECT DISTINCT {CODE} AS country_iso2, CASE WHEN s_suppkey % 3 = 0 THEN ' Postcode ' WHEN s_suppkey % 3 = 1 THEN 'PLZ'
  ELSE concat('Extra', CAST(s_suppkey % 5 AS STRING)) END AS header FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
MAPPING = "SELECT concat('Extra', CAST(r_regionkey AS STRING)) AS header, concat('region_', CAST(r_regionkey + 1 AS STRING), '_en') AS canonical FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'postcode', 'postal_code' FROM region WHERE r_regionkey = 0"
OVERRIDES = f"SELECT {CODE} AS country_iso2, 'plz' AS header, 'postal_code' AS canonical FROM nation WHERE n_nationkey % 2 = 0"
MAPPED_SQL = f"""SELECT h.country_iso2, h.header, coalesce(o.canonical, m.canonical) AS canonical
  FROM ({HEADERS}) h LEFT JOIN ({MAPPING}) m ON lower(trim(m.header)) = lower(trim(h.header))
  LEFT JOIN ({OVERRIDES}) o ON o.country_iso2 = h.country_iso2 AND o.header = lower(trim(h.header))""".replace("AS STRING", "AS VARCHAR")


def mapped(spark, folder):
    t = {n: table(spark, folder, n) for n in ("supplier", "nation", "region")}
    run = lambda text: spark.sql(
        text.replace("FROM supplier", "FROM {supplier}").replace("JOIN nation", "JOIN {nation}")
        .replace("FROM nation", "FROM {nation}").replace("FROM region", "FROM {region}"), **t
    )
    return U.mapped_headers(run(HEADERS), run(MAPPING), run(OVERRIDES))


@query("mapped_headers", MAPPED_SQL)
def mapped_headers(spark, folder):
    return mapped(spark, folder)


@query("unmapped_headers", f"SELECT country_iso2, header FROM ({MAPPED_SQL}) WHERE canonical IS NULL")
def unmapped_headers(spark, folder):
    return U.unmapped_headers(mapped(spark, folder))


@query(
    "mapped_columns",
    f"""SELECT {', '.join({'country_en': 'CAST(l_orderkey AS VARCHAR)', 'postal_code': "CASE WHEN l_linenumber = 1 THEN '  ' ELSE CAST(l_partkey AS VARCHAR) END", 'latitude': 'l_tax'}.get(c, 'NULL') + ' AS ' + c for c in COLUMNS)} FROM lineitem""",
)
def mapped_columns(spark, folder):
    source = table(spark, folder, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS Country", "'' AS PLZ",
        "CASE WHEN l_linenumber = 1 THEN '  ' ELSE CAST(l_partkey AS STRING) END AS ` Postcode`",
        "concat(' ', CAST(l_tax AS STRING)) AS lat", "'x' AS unused",
    )
    mapping = {"country": "country_en", "plz": "postal_code", "postcode": "postal_code", "lat": "latitude"}
    return U.map_columns(source, mapping)


@query(
    "backfilled_names",
    f"""SELECT p.{GROUP}, CASE WHEN {says('p.country_iso3')} THEN p.country_iso3 ELSE r.country_iso3 END AS country_iso3,
    CASE WHEN {says('p.country_lc')} AND NOT coalesce(p.country_lc = p.country_en AND l.language <> 'en', false)
    THEN p.country_lc ELSE coalesce(t.name_lc, p.country_lc) END AS country_lc, count(*) AS rows
    FROM places p LEFT JOIN ({dimension_sql('countries')}) r ON r.country_iso2 = p.{GROUP}
    LEFT JOIN ({dimension_sql('languages')}) l ON l.country_iso2 = p.{GROUP}
    LEFT JOIN ({dimension_sql('translations')}) t ON t.country_iso2 = l.country_iso2 AND t.language = l.language
    GROUP BY ALL""",
)
def backfilled_names(spark, folder):
    dims = dimensions(spark, folder)
    filled = U.backfill(places(spark, folder), dims.countries, dims.languages, dims.translations)
    return filled.groupBy(GROUP, "country_iso3", "country_lc").agg(F.count("*").alias("rows"))


@query(
    "backfilled_region_codes",
    f"""SELECT {GROUP}, region_1_en, CASE WHEN {says('region_1_iso_code')} THEN region_1_iso_code
    WHEN region_1_en LIKE 'Brand#1%' THEN concat({GROUP}, '-R', substr(region_1_en, 7)) ELSE region_1_iso_code END AS region_1_iso_code,
    count(*) AS rows FROM places GROUP BY ALL""",
)
def backfilled_region_codes(spark, folder):
    # The dimension: the regions that occur, some of them with a code.
    named = distinct_keys(places(spark, folder), ["region_1_en"], [GROUP])
    code = F.concat(GROUP, F.lit("-R"), F.substr("region_1_en", F.lit(7)))
    regions = named.where(F.col("region_1_en").startswith("Brand#1")).withColumn("region_1_iso_code", code)
    regions = settle(regions, "regions")
    filled = U.with_region_code(places(spark, folder), regions)
    return filled.groupBy(GROUP, "region_1_en", "region_1_iso_code").agg(F.count("*").alias("rows"))


@query("validated_rows", f"SELECT {', '.join(COLUMNS)} FROM master")
def validated_rows(spark, folder):
    return master(spark, folder).select(*COLUMNS)


@query(
    "blank_drop_counts",
    f"""SELECT {GROUP}, count(*) AS rows_in, count(*) FILTER (WHERE {says('postal_code')}) AS rows_out,
    count(*) FILTER (WHERE {says('postal_code')}) = 0 AS emptied FROM delivered GROUP BY {GROUP}""",
)
def blank_drop_counts(spark, folder):
    return U.code_counts(delivered(spark, folder))


@query(
    "emptied_groups",
    f"SELECT {GROUP} FROM delivered GROUP BY {GROUP} HAVING count(*) FILTER (WHERE {says('postal_code')}) = 0",
)
def emptied_groups(spark, folder):
    return U.emptied_groups(delivered(spark, folder))


# What a delivery with faults looks like: some rows missing, some changed, some twice.
def faulty(spark, folder):
    rows = places(spark, folder)
    changed = F.when(F.col("l_partkey") % 91 == 1, F.lit("changed")).otherwise(F.col("timezone"))
    times = F.when(F.col("l_partkey") % 97 == 0, 0).when(F.col("l_partkey") % 101 == 2, 2).otherwise(1)
    return rows.withColumn("timezone", changed).withColumn(
        "_copy", F.explode(F.array_repeat(F.lit(1), times))
    )


FAULTY_SQL = f"""SELECT {', '.join("CASE WHEN l_partkey % 91 = 1 THEN 'changed' ELSE timezone END AS timezone" if c == 'timezone' else c for c in COLUMNS)}
FROM places, LATERAL (SELECT unnest(range(CASE WHEN l_partkey % 97 = 0 THEN 0 WHEN l_partkey % 101 = 2 THEN 2 ELSE 1 END)) AS copy) u"""
_LISTED = ", ".join(COLUMNS)


@query(
    "integrity_audit",
    f"""SELECT s.{GROUP}, source_rows, delivered_rows, coalesce(lost, 0) AS lost, coalesce(added, 0) AS added
    FROM (SELECT {GROUP}, count(*) AS source_rows FROM places GROUP BY {GROUP}) s
    LEFT JOIN (SELECT {GROUP}, count(*) AS delivered_rows FROM ({FAULTY_SQL}) GROUP BY {GROUP}) d USING ({GROUP})
    LEFT JOIN (SELECT {GROUP}, count(*) AS lost FROM (SELECT {_LISTED} FROM places EXCEPT ALL SELECT {_LISTED} FROM ({FAULTY_SQL})) GROUP BY {GROUP}) l USING ({GROUP})
    LEFT JOIN (SELECT {GROUP}, count(*) AS added FROM (SELECT {_LISTED} FROM ({FAULTY_SQL}) EXCEPT ALL SELECT {_LISTED} FROM places) GROUP BY {GROUP}) a USING ({GROUP})""",
)
def integrity_audit(spark, folder):
    return U.audit(places(spark, folder), faulty(spark, folder))


@query(
    "row_differences",
    f"""SELECT {_LISTED}, CAST(sum(side) AS BIGINT) AS surplus FROM (SELECT {_LISTED}, -1 AS side FROM places
    UNION ALL SELECT {_LISTED}, 1 FROM ({FAULTY_SQL})) GROUP BY {_LISTED} HAVING sum(side) <> 0""",
)
def row_differences(spark, folder):
    return U.differences(places(spark, folder), faulty(spark, folder))


# Order keys taken for codes: most have the usual length, small ones lost their zeros.
@query(
    "lost_zeros",
    """WITH c AS (SELECT o_orderpriority AS country_iso2, o_orderkey, CAST(o_orderkey AS VARCHAR) AS postal_code FROM orders),
    n AS (SELECT country_iso2, length(postal_code) AS k, count(*) AS n FROM c GROUP BY 1, 2),
    u AS (SELECT country_iso2, CAST(k AS INTEGER) AS usual_length FROM
      (SELECT *, row_number() OVER (PARTITION BY country_iso2 ORDER BY n DESC, k DESC) AS rn FROM n) WHERE rn = 1)
    SELECT c.*, usual_length, lpad(postal_code, usual_length, '0') AS restored
    FROM c JOIN u USING (country_iso2) WHERE length(postal_code) < usual_length""",
)
def lost_zeros(spark, folder):
    codes = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("country_iso2"), "o_orderkey", F.col("o_orderkey").cast("string").alias("postal_code")
    )
    return U.lost_zeros(codes)


@query(
    "code_lengths",
    f"""WITH n AS (SELECT {GROUP}, length(trim(postal_code)) AS k, count(*) AS n FROM master GROUP BY 1, 2)
    SELECT {GROUP}, CAST(arg_max(k, n * 1000 + k) AS INTEGER) AS usual_length, CAST(sum(n) AS BIGINT) AS coded_rows FROM n GROUP BY {GROUP}""",
)
def code_lengths(spark, folder):
    return U.code_lengths(delivered(spark, folder))
