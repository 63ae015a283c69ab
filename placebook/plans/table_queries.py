"""Consensus, profiles, samples and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from placebook.functions.scalars import bin_label, bin_of
from placebook.operators import consensus as K
from placebook.operators import profile as P
from placebook.operators import search as S
from placebook.operators.ranking import first_per_group
from placebook.plans.places import ORDER, places, table
from placebook.plans.registry import query, says, text
from placebook.schema import (
    COLUMNS,
    GROUP,
    LEVELS,
    NUMERIC_COLUMNS,
    REGION_COLUMNS,
    SEARCH_COLUMNS,
    VIEW_KEYS,
)
from placebook.session import settle
from placebook.sinks.samples import sample_rows
from placebook.sources.tables import read_columns, read_group


def agreed_sql(columns, numeric=()) -> str:
    out = []
    for c in columns:
        v = c if c in numeric else text(c)
        blank = "NULL" if c in numeric else "''"
        out.append(f"CASE count(DISTINCT {v}) WHEN 0 THEN NULL WHEN 1 THEN max({v}) ELSE {blank} END AS {c}")
    return ", ".join(out)


def consensus_sql(keys, having="", source="places") -> str:
    grouping = [GROUP, *keys]
    values = [c for c in COLUMNS if c not in grouping]
    return (
        f"SELECT {', '.join(grouping)}, {agreed_sql(values, NUMERIC_COLUMNS)} "
        f"FROM {source} GROUP BY {', '.join(grouping)} {having}"
    )


def any_match_sql(needle: str, columns=SEARCH_COLUMNS) -> str:
    return " OR ".join(f"CAST({c} AS VARCHAR) ILIKE '%{needle}%' ESCAPE '\\'" for c in columns)


def canonical(spark, folder):
    return places(spark, folder).select(*COLUMNS)


@query("consensus_postal", consensus_sql(["postal_code"]))
def consensus_postal(spark, folder):
    return K.view(canonical(spark, folder), "postal_codes")


@query("consensus_admin", consensus_sql(REGION_COLUMNS))
def consensus_admin(spark, folder):
    return K.view(canonical(spark, folder), "admin_areas")


@query(
    "consensus_orders",
    f"""SELECT o_custkey, {agreed_sql(["o_orderstatus", "o_orderpriority"])},
    CASE WHEN count(DISTINCT o_orderdate) = 1 THEN max(o_orderdate) END AS o_orderdate
    FROM orders GROUP BY o_custkey""",
)
def consensus_orders(spark, folder):
    orders = table(spark, folder, "orders")
    return K.consensus(
        orders.select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), ["o_custkey"]
    )


@query(
    "distinct_combinations",
    " UNION ALL ".join(
        f"SELECT {GROUP}, '{name}' AS view, count(*) AS rows FROM "
        f"(SELECT DISTINCT {', '.join([GROUP, *keys])} FROM places) GROUP BY {GROUP}"
        for name, keys in VIEW_KEYS.items()
    ),
)
def distinct_combinations(spark, folder):
    return K.distinct_counts(places(spark, folder), VIEW_KEYS, [GROUP])


@query("distinct_keys", f"SELECT DISTINCT {GROUP}, region_1_en, region_2_en FROM places")
def distinct_keys(spark, folder):
    return K.distinct_keys(places(spark, folder), ["region_1_en", "region_2_en"], [GROUP])


@query("row_counts", f"SELECT {GROUP}, count(*) AS rows FROM places GROUP BY {GROUP}")
def row_counts(spark, folder):
    return P.row_counts(places(spark, folder), [GROUP])


def filled(n: int) -> str:
    return f"({says(f'region_{n}_lc')} OR {says(f'region_{n}_en')})"


def percent_sql(condition: str) -> str:
    return f"round_even(CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE {condition}) / count(*), 1)"


def label_sql(n: int) -> str:
    if n > 1:
        return f"'Level {n}'"
    return f"CASE WHEN bool_or({says('region_1_iso_code')}) THEN 'Subdivision (ISO 3166-2)' ELSE 'Level 1' END"


LEVEL_SQL = " UNION ALL ".join(
    f"""SELECT {GROUP}, CAST({n} AS INTEGER) AS level, {label_sql(n)} AS label,
    {percent_sql(filled(n))} AS filled_pct, bool_or({says(f'region_{n}_en')}) AS has_en,
    bool_or({says(f'region_{n}_lc')}) AS has_lc FROM places GROUP BY {GROUP}"""
    for n in LEVELS
)

DEPTH_SQL = "CAST(greatest(0, {}) AS INTEGER)".format(
    ", ".join(f"CASE WHEN bool_or({filled(n)}) THEN {n} ELSE 0 END" for n in LEVELS)
)


def coverage_sql(source: str = "places") -> str:
    return f"""SELECT {GROUP}, count(*) AS rows, {DEPTH_SQL} AS admin_depth,
    {percent_sql('latitude IS NOT NULL')} AS coord_coverage_pct,
    bool_or({says('place_name')}) AS has_place_name,
    {percent_sql(says('region_1_iso_code'))} AS region_1_iso_coverage_pct
    FROM {source} WHERE {GROUP} IS NOT NULL GROUP BY {GROUP}"""


ORDER_ROW = f"row({', '.join(ORDER)})"


def opening_sql(source: str = "places", attributes=tuple(P.ATTRIBUTES)) -> str:
    """First row by plain ranking; the example from the first row that has one."""
    order = ", ".join(ORDER)
    return f"""SELECT {', '.join(f'a.{c}' for c in [GROUP, *attributes])}, e.postal_code AS postal_code_example
    FROM (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY {order}) AS rn FROM {source}) a
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY {order}) AS rn
      FROM {source} WHERE postal_code IS NOT NULL) e ON e.{GROUP} = a.{GROUP} AND e.rn = 1
    WHERE a.rn = 1"""


@query("level_profile", LEVEL_SQL)
def level_profile(spark, folder):
    return P.level_profile(places(spark, folder))


@query("group_coverage", coverage_sql())
def group_coverage(spark, folder):
    return P.coverage(places(spark, folder)).drop("admin_levels")


@query(
    "trailing_levels_cut",
    f"SELECT l.* FROM ({LEVEL_SQL}) l JOIN ({coverage_sql()}) c USING ({GROUP}) WHERE level <= admin_depth",
)
def trailing_levels_cut(spark, folder):
    return P.coverage(places(spark, folder)).select(GROUP, F.inline("admin_levels"))


@query("opening_values", opening_sql())
def opening_values(spark, folder):
    return P.opening_values(places(spark, folder), ORDER)


@query("group_attributes", f"SELECT * EXCLUDE (postal_code_example) FROM ({opening_sql()})")
def group_attributes(spark, folder):
    return P.opening_values(places(spark, folder), ORDER).drop("postal_code_example")


@query(
    "group_profile",
    f"SELECT c.*, o.* EXCLUDE ({GROUP}) FROM ({coverage_sql('delivered')}) c JOIN ({opening_sql('delivered')}) o USING ({GROUP})",
)
def group_profile(spark, folder):
    from placebook.plans.places import delivered

    return P.profile(delivered(spark, folder), ORDER).drop("admin_levels")


@query(
    "sample_rows",
    f"""SELECT {', '.join(COLUMNS)} FROM
    (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY {', '.join(ORDER)}) AS rn FROM places)
    WHERE rn <= 100""",
)
def samples(spark, folder):
    return sample_rows(places(spark, folder), ORDER)


@query(
    "first_orders",
    """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, CAST(row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""",
)
def first_orders(spark, folder):
    orders = table(spark, folder, "orders")
    return first_per_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3, rank="rank").select(
        "o_custkey", "o_orderkey", "o_totalprice", "rank"
    )


@query("search_rows", f"SELECT {', '.join(COLUMNS)} FROM places WHERE {any_match_sql('brand#13')}")
def search_rows(spark, folder):
    return S.search_rows(canonical(spark, folder), "brand#13 ")


@query(
    "search_documents",
    "SELECT doc_id FROM documents WHERE text ILIKE '%100\\%%' ESCAPE '\\' OR text ILIKE '%é%' ESCAPE '\\'"
    " OR CAST(n_chars AS VARCHAR) ILIKE '%é%' ESCAPE '\\'",
)
def search_documents(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    percent = S.matches("100%", ["text"])
    accent = S.matches("É", ["text", "n_chars"])
    return documents.where(percent | accent).select("doc_id")


@query(
    "search_view",
    f"SELECT * FROM ({consensus_sql(['postal_code'])}) WHERE {any_match_sql('red')}",
)
def search_view(spark, folder):
    return S.search_view(canonical(spark, folder), "red", ["postal_code"])


@query(
    "search_via_source",
    consensus_sql(["postal_code"], f"HAVING bool_or({any_match_sql('brand#13')})"),
)
def search_via_source(spark, folder):
    return S.search_via_source(canonical(spark, folder), "Brand#13", ["postal_code"])


@query(
    "search_stored_view",
    f"""SELECT v.* FROM ({consensus_sql(REGION_COLUMNS)}) v JOIN
    (SELECT DISTINCT {', '.join([GROUP, *REGION_COLUMNS])} FROM places WHERE {any_match_sql('00013')}) m
    ON {' AND '.join(f'v.{c} IS NOT DISTINCT FROM m.{c}' for c in [GROUP, *REGION_COLUMNS])}""",
)
def search_stored_view(spark, folder):
    rows = canonical(spark, folder)
    stored = settle(K.view(rows, "admin_areas"), "view")
    return S.search_via_source(rows, "00013", REGION_COLUMNS, view=stored)


@query(
    "preview_rows",
    f"""SELECT * FROM ({consensus_sql(['postal_code'])}) WHERE {GROUP} = 'CC'
    ORDER BY postal_code LIMIT 100""",
)
def preview_rows(spark, folder):
    rows, _ = S.preview(canonical(spark, folder), "cc", ["postal_code"], view="postal_codes")
    return rows


@query(
    "preview_summary",
    f"""SELECT count(*) AS matched, least(count(*), 100) AS shown, count(*) > 100 AS truncated
    FROM places WHERE {GROUP} = 'CC' AND ({any_match_sql('brand#1')})""",
)
def preview_summary(spark, folder):
    _, summary = S.preview(canonical(spark, folder), "cc", ["postal_code"], "brand#1")
    return summary


# Nothing is found: no rows, and a summary that says so.
@query("preview_of_nothing", "SELECT CAST(0 AS BIGINT) AS matched, CAST(0 AS BIGINT) AS shown, false AS truncated FROM region WHERE r_regionkey = 0")
def preview_of_nothing(spark, folder):
    _, summary = S.preview(canonical(spark, folder), "cc", ["postal_code"], "no such text", view="postal_codes")
    return summary


@query("group_scan", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def group_scan(spark, folder):
    return read_group(spark, f"{folder}/customer.parquet", "building".upper(), "c_mktsegment")


@query("projected_scan", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def projected_scan(spark, folder):
    return read_columns(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "text_presence",
    f"""SELECT {GROUP}, count(*) FILTER (WHERE {says('place_name')}) AS named,
    count(*) FILTER (WHERE NOT {says('place_name')}) AS unnamed FROM places GROUP BY {GROUP}""",
)
def text_presence(spark, folder):
    from placebook.functions.absence import has_text

    return places(spark, folder).groupBy(GROUP).agg(
        F.count_if(has_text("place_name")).alias("named"),
        F.count_if(~has_text("place_name")).alias("unnamed"),
    )


@query(
    "row_bins",
    f"""SELECT {GROUP}, rows, CAST(CASE WHEN rows < 1000 THEN 0 WHEN rows < 10000 THEN 1
    WHEN rows < 100000 THEN 2 WHEN rows < 500000 THEN 3 ELSE 4 END AS INTEGER) AS bin,
    CASE WHEN rows < 1000 THEN '<1K' WHEN rows < 10000 THEN '1K–10K' WHEN rows < 100000 THEN '10K–100K'
    WHEN rows < 500000 THEN '100K–500K' ELSE '500K+' END AS bin_label
    FROM (SELECT {GROUP}, count(*) AS rows FROM places GROUP BY {GROUP})""",
)
def row_bins(spark, folder):
    return P.row_counts(places(spark, folder), [GROUP]).withColumns(
        {"bin": bin_of("rows"), "bin_label": bin_label("rows")}
    )
