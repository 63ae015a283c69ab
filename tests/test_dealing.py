import os
import time

from pyspark.sql import functions as F

from placebook import session
from placebook.functions.scalars import base_name
from placebook.operators.source_profile import _fill_counts, _shape
from placebook.operators.upstream import audit
from placebook.plans import file_queries, order_queries
from placebook.plans import places as P
from placebook.plans.places import places
from placebook.schema import COLUMNS, GROUP
from placebook.sinks import views as V
from placebook.sources.delimited import read_source_files
from placebook.sources.tables import read_views


def small_tables(spark, folder, n):
    tables = {
        "lineitem": spark.range(n).selectExpr("id AS l_orderkey", "cast(1 AS int) AS l_linenumber", "id % 50 AS l_partkey", "id % 7 AS l_suppkey"),
        "part": spark.range(50).selectExpr("id AS p_partkey", "'p' AS p_name", "'Brand#11' AS p_brand", "'t' AS p_type"),
        "supplier": spark.range(7).selectExpr("id AS s_suppkey", "cast(id % 3 AS int) AS s_nationkey", "cast(id AS double) AS s_acctbal"),
        "nation": spark.range(3).selectExpr("cast(id AS int) AS n_nationkey", "'N' AS n_name", "0 AS n_regionkey"),
        "region": spark.range(1).selectExpr("cast(id AS int) AS r_regionkey", "'ASIA' AS r_name"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")


def test_facts_are_dealt_by_rows_not_by_bytes(spark, tmp_path, monkeypatch):
    small_tables(spark, tmp_path, 6000)
    assert len(places(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()) <= 8
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    held = [r["count"] for r in places(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 6000 and len(held) == 30 and max(held) < 400


def test_facts_stay_dealt_by_rows_after_joins_that_shuffle(spark, tmp_path, monkeypatch):
    small_tables(spark, tmp_path, 6000)
    parts = spark.range(2000).selectExpr("id AS p_partkey", "sha2(string(id), 512) AS p_name", "'Brand#11' AS p_brand", "'t' AS p_type")
    parts.write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        held = [r["count"] for r in places(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert sum(held) == 6000 and len(held) == 30 and max(held) < 400


def test_ordered_lines_are_dealt_by_rows_and_stay_in_order(spark, tmp_path, monkeypatch):
    rows = spark.range(6000).selectExpr("id % 3 AS l_suppkey", "9000 - id AS l_orderkey", "cast(id % 7 AS int) AS l_linenumber", "1.0D AS l_quantity")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    asked, write = [], order_queries.write_csv_groups
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(order_queries, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(order_queries, "write_csv_groups", lambda *a, **k: asked.append(k) or write(*a, **k))
    found = {tuple(r) for r in order_queries.file_order_export(spark, str(tmp_path)).collect()}
    assert found == {(i % 3, i // 3 + 1, 9000 - i, i % 7) for i in range(6000)}
    assert asked == [{"rows_per_file": 200}]


def test_stale_views_of_one_set_of_groups_are_one_job(spark, tmp_path, monkeypatch):
    rows = [tuple(g if c == GROUP else None for c in COLUMNS) for g in ("A", "A", "B", None)]
    schema = ", ".join(f"{c} {'double' if c in ('latitude', 'longitude') else 'string'}" for c in COLUMNS)
    source, path, written = str(tmp_path / "table"), str(tmp_path / "views"), []
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    write = V.write_views
    monkeypatch.setattr(V, "write_views", lambda df, path, views, *more: written.append((df.count(), list(views))) or write(df, path, views, *more))
    assert V.refresh_views(spark, source, path, ["postal_codes", "admin_areas"]).where("stale").count() == 4
    assert written == [(3, ["admin_areas", "postal_codes"])]
    assert V.refresh_views(spark, source, path).where("stale").count() == 2
    assert written[1:] == [(3, ["all_rows"])]
    assert V.refresh_views(spark, source, path).where("stale").isEmpty() and len(written) == 2


def grouped(spark, path, sizes):
    """A stored table with so many rows of each group, of two codes each."""
    columns = [F.lit(None).cast("double" if c in ("latitude", "longitude") else "string").alias(c) for c in COLUMNS if c not in (GROUP, "postal_code")]
    rows = spark.createDataFrame([(g, str(i % 2)) for g, n in sizes for i in range(n)], f"{GROUP} string, postal_code string")
    rows.select("*", *columns).select(*COLUMNS).write.parquet(path)


def test_a_large_refresh_is_shared_out_over_jobs_by_whole_groups(spark, tmp_path, monkeypatch):
    source, path, written = str(tmp_path / "table"), str(tmp_path / "views"), []
    sizes = [("", 8), ("A", 10), ("B", 2), ("C", 30), ("D", 9), ("E", 1), ("_", 20)]
    grouped(spark, source, [*sizes, (None, 5)])
    write = V.write_views
    monkeypatch.setattr(V, "write_views", lambda df, *more: written.append({r[0]: r[1] for r in df.groupBy(GROUP).count().collect()}) or write(df, *more))
    monkeypatch.setattr(session, "ROWS_PER_JOB", 1, raising=False)
    assert V.refresh_views(spark, source, path).where("stale").count() == 21
    # A quarter of 80 rows, and the rest of the group that a job begins last.
    assert written == [{"": 8, "A": 10, "B": 2}, {"C": 30}, {"D": 9, "E": 1}, {"_": 20}]
    counted = {tuple(r) for r in read_views(spark, path).groupBy("view", "group").count().collect()}
    rows = {v: 2 if v == "postal_codes" else 1 for v in ("postal_codes", "admin_areas")}
    assert counted == {("all_rows", g, n) for g, n in sizes} | {(v, g, min(n, m)) for v, m in rows.items() for g, n in sizes}
    assert V.refresh_views(spark, source, path).where("stale").isEmpty() and len(written) == 4
    V.refresh_views(spark, source, str(tmp_path / "csv"), fmt="csv")
    assert V.refresh_views(spark, source, str(tmp_path / "csv"), fmt="csv").where("stale").isEmpty()


def test_line_items_of_a_large_table_are_joined_in_shares(spark, tmp_path, monkeypatch):
    small_tables(spark, tmp_path, 6000)
    held, whole = [], P.places
    monkeypatch.setattr(session, "ROWS_PER_JOB", 1, raising=False)
    monkeypatch.setattr(P, "places", lambda spark, folder, part=None: held.append(part.count()) or whole(spark, folder, part))
    P.write_places(spark, str(tmp_path), str(tmp_path / "table"), [*COLUMNS, *P.ORDER])
    assert len(held) == 4 and sum(held) == 6000 and max(held) < 1800
    stored, rows = spark.read.parquet(str(tmp_path / "table")), places(spark, str(tmp_path))
    assert stored.columns == rows.columns and stored.count() == 6000
    assert stored.exceptAll(rows).isEmpty()


def shuffled(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in folders for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}


def test_a_refresh_leaves_no_shuffled_rows_behind(spark, tmp_path):
    small_tables(spark, tmp_path, 6000)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, asked = shuffled(spark), spark.conf.get(key, None)
    report = file_queries.view_refresh(spark, str(tmp_path))
    for _ in range(50):
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(key, None) == asked
    assert {tuple(r) for r in report.where("view = 'all_rows'").select("round", "stale").distinct().collect()} == {("one view more", True), ("changed", True)}


def test_views_of_one_large_group_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    columns = [F.lit(None).cast("double" if c in ("latitude", "longitude") else "string").alias(c) for c in COLUMNS if c not in (GROUP, "postal_code")]
    rows = spark.range(6000).select(F.when(F.col("id") < 20, "B").otherwise("A").alias(GROUP), (F.col("id") % 3000).cast("string").alias("postal_code"), *columns)
    rows.select(*COLUMNS).write.parquet(str(tmp_path / "table"))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    tagged = V.tagged_views(spark.read.parquet(str(tmp_path / "table")))
    held = [r["count"] for r in tagged.where("view = 'all_rows'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 6000 and len(held) == 30 and max(held) < 400
    counted = {tuple(r) for r in tagged.groupBy("view", "group").count().collect()}
    assert counted == {("all_rows", "A", 5980), ("all_rows", "B", 20), ("postal_codes", "A", 3000), ("postal_codes", "B", 20), ("admin_areas", "A", 1), ("admin_areas", "B", 1)}
    # Each view meets by its keys beyond the exchange that deals.
    assert plan_of(tagged).count("hashpartitioning(_hash") == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_of_sources_are_read_once_for_all_counts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("region_1_en,lat\nx,1\n,2\nz,\n")
    (tmp_path / "b.csv").write_text("plain\nx\n\ny\n")
    (tmp_path / "c.csv").write_text("region_2_lc;q;r;lat\nx;;;\n;1;2;3;4\ny\n")
    paths = {("UTF-8", ","): [str(tmp_path / f"{n}.csv") for n in "ab"], ("UTF-8", ";"): [str(tmp_path / "c.csv")]}
    source = read_source_files(spark, paths, source_of=base_name)
    shape = _shape(source.headers)
    counted = _fill_counts(source, shape)
    assert plan_of(counted).count("FileScan csv") == 2
    assert sorted(map(tuple, counted.collect())) == [("a.csv", 3, 2, {1: 2}), ("b.csv", 2, 0, None), ("c.csv", 2, 0, {2: 2})]


def test_audit_moves_no_text_and_tells_nulls_apart(spark):
    schema = "g string, a string, b string, n double"
    one = spark.createDataFrame([("x", "u", None, 0.0), ("x", "u", None, 0.0), ("x", None, "u", None), (None, "", "", 1.0)], schema)
    two = spark.createDataFrame([("x", None, "u", None), ("x", None, "u", None), ("x", "u", None, -0.0), (None, None, "", 1.0)], schema)
    found = audit(one, two, "g", ["g", "a", "b", "n"])
    assert {tuple(r) for r in found.collect()} == {("x", 3, 3, 1, 1), (None, 1, 1, 1, 1)}
    moved = [line for line in plan_of(found).split("\n") if "hashpartitioning" in line]
    assert moved and not any(f"{c}#" in line for line in moved for c in ("a", "b", "n"))
