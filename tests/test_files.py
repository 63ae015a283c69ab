import csv
import glob
import io
import json
import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from placebook.operators import catalog as C
from placebook.operators.consensus import consensus
from placebook.operators.profile import opening_values
from placebook.operators.source_profile import source_levels, source_profile
from placebook.operators.upstream import map_sources
from placebook.schema import COLUMNS, FILE_ORDER, MASTER, TEXT_COLUMNS, VIEW_KEYS
from placebook.sinks import views as V
from placebook.sinks.delimited import write_csv, write_csv_groups
from placebook.sinks.samples import sample_rows
from placebook.sources.delimited import (
    cells,
    dialects_of,
    read_dialect_csv,
    read_source_files,
    read_text_csv,
    read_versioned_sources,
)
from placebook.sources.tables import (
    chain_places,
    read_features,
    read_group,
    read_in_order,
    read_listing,
    read_listing_chain,
    read_sources,
    read_view,
)


def text_of(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/**/part-*", recursive=True)))


def test_csv_bytes_and_round_trip(spark, tmp_path):
    rows = [("NA", '01067', 'say "hi", you', 1.5), (" pad ", None, "two\nlines", None), ("", "x", " ", float("nan"))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d double").coalesce(1)
    path = str(tmp_path / "out")
    write_csv(df, path)
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n")
    writer.writerow(df.columns)
    for r in rows:
        writer.writerow(["" if v is None or v != v else v for v in r])
    assert text_of(path) == out.getvalue()
    found = {tuple(r) for r in read_text_csv(spark, path).collect()}
    assert found == {("NA", "01067", 'say "hi", you', "1.5"), (" pad ", "", "two\nlines", ""), ("", "x", " ", "")}


def test_grouped_csv_splits_hot_groups_and_repeats_the_header(spark, tmp_path):
    rows = [("hot", "same")] * 500 + [("small", str(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, v string").repartition(8)
    path = str(tmp_path / "out")
    write_csv_groups(df, path, "g", rows_per_file=100)
    files = glob.glob(f"{path}/group=hot/part-*")
    assert len(files) > 1
    assert all(open(f).readline() == '"g","v"\n' for f in files)
    found = sorted(tuple(r) for r in read_text_csv(spark, path, ["g", "v"]).collect())
    assert found == sorted(rows)
    write_csv_groups(df.where("g = 'hot'").limit(50), path, "g", mode="overwrite", rows_per_file=100)
    assert len(glob.glob(f"{path}/group=hot/part-*")) == 1 and len(glob.glob(f"{path}/group=small/part-*")) == 1


def test_grouped_csv_keeps_order_in_any_number_of_files(spark, tmp_path):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'b', 'hot') AS g", "3000 - id AS v", "cast(id AS string) AS t").repartition(7)
    for n in (100, 100_000):
        path = str(tmp_path / f"out{n}")
        write_csv_groups(df, path, "g", ["v"], ["g", "t"], rows_per_file=n)
        files = sorted(glob.glob(f"{path}/group=hot/part-*"))
        assert len(files) > 10 if n == 100 else len(files) == 1
        lines = [x for f in files for x in open(f).read().split("\n")[1:] if x]
        assert lines == [f'"hot","{i}"' for i in range(2999, -1, -1) if i % 3]


def test_csv_of_no_rows_has_its_header(spark, tmp_path):
    write_csv(spark.createDataFrame([], "a string, b double"), str(tmp_path / "out"))
    assert text_of(str(tmp_path / "out")) == '"a","b"\n'


def test_group_folders_stand_for_any_name(spark, tmp_path):
    names = ["A+B", "A B", "", "_x", "50%", "a/b", "é=ü"]
    rows = [tuple((g if c == "country_iso2" else g + str(i)) if c in TEXT_COLUMNS else None for c in COLUMNS) for i, g in enumerate(names)]
    schema = ", ".join(f"{c} {'string' if c in TEXT_COLUMNS else 'double'}" for c in COLUMNS)
    source, path = str(tmp_path / "table"), str(tmp_path / "views")
    spark.createDataFrame(rows, schema).write.parquet(source)
    V.refresh_views(spark, source, path)
    assert V.refresh_views(spark, source, path).where("stale").isEmpty()
    for g in names:
        assert [r.country_iso2 for r in read_view(spark, path, "all_rows", g).collect()] == [g]
    V.refresh_views(spark, source, str(tmp_path / "csv"), fmt="csv")
    assert V.refresh_views(spark, source, str(tmp_path / "csv"), fmt="csv").where("stale").isEmpty()


@pytest.mark.parametrize("parts", ["1", "40"])
def test_headers_are_no_records_whatever_the_splits(spark, tmp_path, parts):
    paths = []
    for i in range(12):
        (tmp_path / f"f{i}.csv").write_text("region_1_en,lat\n" + "".join(f"r{j},{j}\n" for j in range(i)))
        paths.append(str(tmp_path / f"f{i}.csv"))
    source = read_source_files(spark, {("UTF-8", ","): paths})
    spark.conf.set("spark.sql.files.minPartitionNum", parts)
    try:
        assert source.records.count() == sum(range(12)) and source.records.where("fields[0] = 'region_1_en'").isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


RAGGED = "id;name;seg\n1;a;x\n2;b\n3;c;x;extra\n4;d;x;;\n5;\"q;\"\"r\"\"\";\n6;é;NA\n\n7;e;x;\n"


@pytest.mark.parametrize("multi_line", [True, False])
def test_dialect_drops_long_rows_and_pads_short_ones(spark, tmp_path, multi_line):
    path = tmp_path / "f.csv"
    path.write_bytes(RAGGED.encode("latin-1"))
    df = read_dialect_csv(spark, str(path), "latin-1", ";", multi_line=multi_line)
    expected = {("1", "a", "x"), ("2", "b", None), ("5", 'q;"r"', ""), ("6", "é", "NA")}
    assert {tuple(r) for r in df.collect()} == expected
    assert df.count() == 4
    assert {r[0] for r in df.select("name").collect()} == {"a", "b", 'q;"r"', "é"}


HEADERS = {
    # three levels, the last one blank
    "a.csv": ("UTF-8", ",", "country_en,postal_code,region1_lc,region1_en,region2_lc,region2_en,region3_lc,region3_en,latitude",
              ["A,,x,x,y,,,,1", "A,,x,,,,,, ", "A,,,,,,,,"]),
    # mislabelled: region_en is no level, level 3 has lc only
    "b.csv": ("UTF-8", ",", "place_name,latitude,region_1,region_1_en,region_2,region_2_en,region_3,region_en",
              ["p,1,a,a,b,b,c,d", "p,,a,,,,c"]),
    # ranked headers
    "c.csv": ("latin-1", ";", "place_name;order8_name;order1_name;lat", ["p;é;é;2", "p;;é;2;surplus", "p;;;"]),
    # level 2 only: the list is cut by position, not by level number
    "d.csv": ("UTF-8", ",", "Region_2_EN, region_2_en ,region_4_lc,name,name", ["x,,,n,m", "x,y,,n,m"]),
    "empty.csv": ("UTF-8", ",", "region_1_en,lat", []),
}


@pytest.fixture
def sources(spark, tmp_path):
    dialects = {}
    for name, (encoding, sep, header, rows) in HEADERS.items():
        (tmp_path / name).write_bytes("\n".join([header, *rows, ""]).encode(encoding))
        dialects.setdefault((encoding, sep), []).append(str(tmp_path / name))
    return lambda: read_source_files(spark, dialects)


def by_file(df):
    return {r.file.rsplit("/", 1)[-1]: r for r in df.collect()}


def test_source_profiles_by_header(sources):
    found = by_file(source_profile(sources()))
    a = found["a.csv"]
    assert a.admin_depth == 2 and [x.filled_pct for x in a.admin_levels] == [66.7, 33.3]
    assert a.coord_coverage_pct == 33.3 and not a.has_place_name and a.rows == 0
    b = found["b.csv"]
    assert b.admin_depth == 3
    assert [(x.has_en, x.has_lc) for x in b.admin_levels] == [(True, True), (True, True), (False, True)]
    c = found["c.csv"]
    assert [(x.level, x.filled_pct, x.has_en, x.has_lc) for x in c.admin_levels] == [(1, 50.0, True, False), (2, 50.0, True, False)]
    assert c.coord_coverage_pct == 50.0
    d = found["d.csv"]
    assert d.admin_depth == 2
    # The later of two equal headers supplies the data: one of two rows.
    assert [(x.level, x.filled_pct) for x in d.admin_levels] == [(2, 50.0), (4, 0.0)]
    assert d.source_columns == ["Region_2_EN", " region_2_en ", "region_4_lc", "name", "name.1"]
    assert found["empty.csv"].admin_depth == 0 and found["empty.csv"].admin_levels == []


def test_source_levels_and_cells(sources):
    levels = {(r.file.rsplit("/", 1)[-1], r.level, r.filled, r.rows) for r in source_levels(sources()).collect()}
    assert {("a.csv", 3, 0, 3), ("b.csv", 3, 2, 2), ("c.csv", 1, 1, 2), ("empty.csv", 1, 0, 0)} <= levels
    long = cells(sources())
    assert long.where("file like '%c.csv'").count() == 8
    assert sources().records.count() == 3 + 2 + 2 + 2


def test_headers_of_any_width_and_spelling(spark, tmp_path):
    wide = [f"c{i}" for i in range(200)]
    hard = {"w.csv": (",", ",".join(wide), [",".join("x" * 200), "1,2"]), "q.csv": ("|", '"a|b"|"say ""x"""||"two\nlines"', ["1|2|3|4", "1"]), "one.csv": (",", "alone", ["x", "y,z"]), "quoted.csv": (",", '"alone"', ["x"])}
    dialects = {}
    for name, (sep, head, rows) in hard.items():
        (tmp_path / name).write_text("\n".join([head, *rows, ""]))
        dialects.setdefault(("UTF-8", sep), []).append(str(tmp_path / name))
    source = read_source_files(spark, dialects)
    heads = {}
    for r in source.headers.orderBy("ordinal").collect():
        heads.setdefault(r.file.rsplit("/", 1)[-1], []).append(r.header)
    assert heads == {"w.csv": wide, "q.csv": ["a|b", 'say "x"', "", "two\nlines"], "one.csv": ["alone"], "quoted.csv": ["alone"]}
    found = sorted((r.file.rsplit("/", 1)[-1], len(r.fields)) for r in source.records.collect())
    assert found == [("one.csv", 1), ("q.csv", 1), ("q.csv", 4), ("quoted.csv", 1), ("w.csv", 2), ("w.csv", 200)]


def test_dialects_and_paths_come_from_the_version_table(spark, tmp_path):
    """Three dialects; two files of one name; a folder of parts; names Spark writes as %XX."""
    root = tmp_path / "in coming %20+x"
    files = {
        "b 1/S.csv": ("latin-1", ";", "name;lat", ["é;1", "x;2"]),
        "b 2/S.csv": ("utf-8", ",", "name,lat", ["é,3", "a,4", "b,5"]),
        "b 2/parts.csv/part-0": ("utf-8-sig", "\t", "name\tlat", ["p\t6"]),
        "b 2/parts.csv/part-1": ("utf-8-sig", "\t", "name\tlat", ["ü\t7", "q\t8\t9"]),
    }
    for name, (encoding, sep, head, rows) in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes("\n".join([head, *rows, ""]).encode(encoding))
    rows = [("AA", "b 1/S.csv", "Latin-1", ";"), ("BB", "b 2/S.csv", "", None), ("CC", "b 2/parts.csv", "utf-8-sig", "\t"), ("DD", "b 3/gone.csv", None, "")]
    versions = spark.createDataFrame(rows, "country_iso2 string, selected_rel_path string, selected_encoding string, selected_delimiter string")
    assert len(dialects_of(versions, str(root))) == 3
    listing = read_sources(spark, str(root))
    assert {(r.rel_path, r.bytes) for r in listing.collect()} == {
        ("b 1/S.csv", 17), ("b 2/S.csv", 22), ("b 2/parts.csv", sum((root / n).stat().st_size for n in files if "part-" in n))}
    assert [r.country_iso2 for r in C.missing_sources(versions, listing).collect()] == ["DD"]
    there = versions.where("country_iso2 <> 'DD'")
    source = read_versioned_sources(spark, there, str(root))
    assert sorted((r.file, r.header, r.value) for r in cells(source).collect()) == sorted(
        (f, h, v) for f, pairs in {"b 1/S.csv": [("é", "1"), ("x", "2")], "b 2/S.csv": [("é", "3"), ("a", "4"), ("b", "5")], "b 2/parts.csv": [("p", "6"), ("ü", "7")]}.items()
        for pair in pairs for h, v in zip(("name", "lat"), pair, strict=True))
    dated = C.with_file_dates(versions.withColumn("last_updated", F.lit("1999-01-01")), listing).collect()
    assert {r.country_iso2: r.last_updated == "1999-01-01" for r in dated} == {"AA": False, "BB": False, "CC": False, "DD": True}
    entries = versions.selectExpr("country_iso2 AS iso2", "selected_rel_path AS source_path", f"'{C.NO_DATA}' AS status")
    assert {(r.iso2, r.fmt, r.bytes, r.name) for r in C.raw_file_table(entries, listing).collect() if r.iso2 in "AABB"} == {
        ("AA", "csv", 17, "S.csv"), ("BB", "csv", 22, "S.csv")}


def canonical(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], MASTER)


ROWS = [
    {"country_iso2": g, "postal_code": c, "place_name": p}
    for g, c, p in [("NA", "01067", "x"), ("NA", "01067", "y"), ("DE", None, " "), ("DE", "", "z"), (None, "1", "q")]
]


def test_views_keep_codes_and_refresh_only_what_is_stale(spark, tmp_path):
    source, out = str(tmp_path / "master"), str(tmp_path / "views")
    canonical(spark, ROWS).write.parquet(source)
    first = V.refresh_views(spark, source, out)
    assert {r.stale for r in first.collect()} == {True} and first.count() == 6
    view = read_view(spark, out, "postal_codes", "NA").collect()
    assert [(r.postal_code, r.place_name) for r in view] == [("01067", "")]
    assert read_view(spark, out, "all_rows").where("postal_code = ''").count() == 1
    again = V.refresh_views(spark, source, out)
    assert {r.stale for r in again.collect()} == {False}
    kept = set(glob.glob(f"{out}/view=all_rows/group=DE/*.parquet"))
    time.sleep(1.1)
    spark.read.parquet(source).where("country_iso2 = 'DE'").write.mode("append").parquet(source + "_new")
    spark.read.parquet(source + "_new").write.mode("append").parquet(source)
    assert {r.stale for r in V.refresh_views(spark, source, out).collect()} == {True}
    assert not kept & set(glob.glob(f"{out}/view=all_rows/group=DE/*.parquet"))
    assert read_view(spark, out, "all_rows", "DE").count() == 4
    with pytest.raises(ValueError):
        V.write_views(canonical(spark, ROWS), out, ["towns"])


def test_a_missing_view_alone_is_written(spark, tmp_path):
    source, out = str(tmp_path / "master"), str(tmp_path / "views")
    canonical(spark, ROWS).write.parquet(source)
    V.refresh_views(spark, source, out, ["all_rows"])
    report = V.refresh_views(spark, source, out)
    assert {r["view"] for r in report.where("stale").collect()} == {"postal_codes", "admin_areas"}


def test_group_filter_reaches_the_scan(spark, tmp_path):
    source = str(tmp_path / "master")
    canonical(spark, ROWS).write.parquet(source)
    plan = read_group(spark, source, "NA").select("postal_code")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(country_iso2,NA)" in plan
    assert "ReadSchema: struct<country_iso2:string,postal_code:string>" in plan


def test_sheet_limit_leaves_groups_out_whole(spark):
    df = canonical(spark, ROWS)
    kept = V.sheet_rows(df, COLUMNS, limit=1)
    assert [r.country_iso2 for r in kept.collect()] == [None]
    assert dict(kept.dtypes)["latitude"] == "string"


def test_documents(spark, tmp_path):
    topo = tmp_path / "topo.json"
    topo.write_text('{"objects": {"countries": {"geometries": [{"id": "040", "properties": {"name": "A"}, "arcs": [1]},\n'
                    '{"properties": {"name": "N. Cyprus"}}]}}}')
    assert [tuple(r) for r in read_features(spark, str(topo)).collect()] == [("040", "A"), (None, "N. Cyprus")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text('{"files": [{"id": "x", "name": "FR.csv"}, {"id": "y", "name": "FR.xlsx"}]}')
    (tmp_path / "p" / "2.json").write_text('{"files": [{"id": "z", "name": "FR.csv"}]}')
    listing = read_listing(spark, str(tmp_path / "p")).orderBy("position")
    assert [r.id for r in listing.collect()] == ["x", "y", "z"]
    assert listing.where(F.col("name") == "FR.csv").count() == 2


def test_csv_views_refresh_too(spark, tmp_path):
    source, out = str(tmp_path / "master"), str(tmp_path / "csv")
    canonical(spark, ROWS).write.parquet(source)
    assert {r.stale for r in V.refresh_views(spark, source, out, fmt="csv").collect()} == {True}
    assert {r.stale for r in V.refresh_views(spark, source, out, fmt="csv").collect()} == {False}
    rows = read_text_csv(spark, f"{out}/view=postal_codes/group=NA", COLUMNS).collect()
    assert [(r.country_iso2, r.postal_code, r.place_name) for r in rows] == [("NA", "01067", "")]
    with pytest.raises(ValueError):
        V.refresh_views(spark, source, out, fmt="pdf")


def test_headers_that_differ_in_case_only(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("\ufeffA,a,A\n1,2,3\n4\n", encoding="utf-8")
    df = read_dialect_csv(spark, str(path))
    assert df.columns == ["A", "a", "A.1"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2", "3"), ("4", None, None)]


def test_group_names_never_become_numbers(spark, tmp_path):
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        rows = [{"country_iso2": g, "postal_code": "1"} for g in ("01", "1", "a/b")]
        V.write_views(canonical(spark, rows), str(tmp_path / "v"), ["postal_codes"])
        for g in ("01", "1", "a/b"):
            found = read_view(spark, str(tmp_path / "v"), "postal_codes", g).collect()
            assert [r.country_iso2 for r in found] == [g]
        assert {r["group"] for r in V.view_files(spark, str(tmp_path / "v")).collect()} == {"01", "1", "a/b"}
    finally:
        spark.conf.set(key, before)


def test_first_rows_follow_the_files(spark, tmp_path):
    """Several files of several splits, read back in the order they lie in."""
    path = str(tmp_path / "table")
    df = spark.range(0, 20_000, 1, 5).selectExpr("id % 7 AS g", "id", "hash(id) AS v", "if(id % 3 = 1, concat('x', id), null) AS t")
    df.repartition(5, "v").write.option("parquet.block.size", 4096).parquet(path)
    rows = [r for f in sorted(glob.glob(f"{path}/part-*")) for r in pq.read_table(f).to_pylist()]
    ordered = read_in_order(spark, path)
    found = sample_rows(ordered, columns=["g", "id", "file_path", "row_index"], group="g", n=20).orderBy("g", *FILE_ORDER).collect()
    assert [(r.g, r.id) for r in found] == [(g, r["id"]) for g in range(7) for r in [x for x in rows if x["g"] == g][:20]]
    first = {r.g: r for r in opening_values(ordered, group="g", attributes=["id", "v"], example="t").collect()}
    for g in range(7):
        own = [x for x in rows if x["g"] == g]
        assert (first[g].id, first[g].v) == (own[0]["id"], own[0]["v"])
        assert first[g].t_example == next(x["t"] for x in own if x["t"])
    out = str(tmp_path / "out")
    write_csv_groups(ordered, out, "g", FILE_ORDER, ["id", "t"], rows_per_file=900)
    for g in range(7):
        lines = [x for f in sorted(glob.glob(f"{out}/group={g}/part-*")) for x in open(f).read().split("\n") if x and x != '"id","t"']
        assert lines == [f'{x["id"]},"{x["t"] or ""}"' for x in rows if x["g"] == g]


def test_all_templates_are_mapped_at_once(spark, sources):
    """Two headers for one column, an override of one file, a header with blanks, short rows."""
    source = sources()
    path = {r.file.rsplit("/", 1)[-1]: r.file for r in source.headers.select("file").distinct().collect()}
    pairs = [("country_en", "country_en"), ("REGION1_lc", "region_1_lc"), ("region1_en", "region_1_lc"), ("latitude", "latitude"),
             ("region_2_en", "region_2_en"), ("name", "place_name"), ("place_name", "place_name"), ("lat", "latitude")]
    mapping = spark.createDataFrame(pairs, "header string, canonical string")
    own = spark.createDataFrame([(path["c.csv"], "lat", "longitude"), (path["c.csv"], " Order1_Name", "region_1_en")], "file string, header string, canonical string")
    found = map_sources(source, mapping, own)
    assert found.columns == ["file", *COLUMNS]
    rows = {}
    for r in found.collect():
        said = {c: r[c] for c in COLUMNS if r[c] is not None}
        rows.setdefault(r.file.rsplit("/", 1)[-1], []).append(tuple(sorted(said.items())))
    want = {
        "a.csv": [{"country_en": "A", "region_1_lc": "x", "latitude": 1.0}, {"country_en": "A", "region_1_lc": "x"}, {"country_en": "A", "region_1_lc": ""}],
        "b.csv": [{"place_name": "p", "latitude": 1.0, "region_2_en": "b"}, {"place_name": "p", "region_2_en": ""}],
        "c.csv": [{"place_name": "p", "region_1_en": "é", "longitude": 2.0}, {"place_name": "p", "region_1_en": ""}],
        "d.csv": [{"region_2_en": "x", "place_name": "n"}, {"region_2_en": "x", "place_name": "n"}],
    }
    assert {f: sorted(r) for f, r in rows.items()} == {f: sorted(tuple(sorted(d.items())) for d in r) for f, r in want.items()}


def test_pages_are_chained_by_their_tokens(spark, tmp_path):
    rng = random.Random(3)
    names = [None, *(f"t{rng.random()}" for _ in range(36))]
    pages = [{"pageToken": t, "nextPageToken": n, "files": [{"id": f"{i}-{j}", "name": "FR.csv"} for j in range(i % 3)]} for i, (t, n) in enumerate(zip(names, [*names[1:], None], strict=True))]
    want = [f["id"] for p in pages for f in p["files"]]
    rng.shuffle(pages)
    (tmp_path / "pages").mkdir()
    for k in range(4):
        (tmp_path / "pages" / f"{k}.json").write_text("\n".join(json.dumps({a: b for a, b in p.items() if b is not None}) for p in pages[k::4]))
    found = read_listing_chain(spark, str(tmp_path / "pages"), multi_line=False).orderBy("position")
    assert [r.id for r in found.collect()] == want
    links = spark.createDataFrame([("", "a"), ("a", "b"), ("b", "gone")], "token string, next string")
    assert {tuple(r) for r in chain_places(links).collect()} == {("", 0), ("a", 1), ("b", 2)}
    assert chain_places(links.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chain_places(links.withColumn("next", F.replace("next", F.lit("gone"), F.lit("a"))))


def test_all_views_come_out_of_one_scan(spark, tmp_path):
    """One aggregation for all key sets, equal to one for each; the exchange below is used twice."""
    rows = [{"country_iso2": g, "postal_code": c, "region_1_en": r, "region_1_lc": k, "place_name": p, "latitude": x}
            for g in ("FR", "NA", "") for c in ("1", None, "") for r, k in (("a", None), ("a", "b"), (None, " "), ("", "")) for p, x in (("x", 1.0), ("y", float("nan")), (" ", 1.0))]
    source = str(tmp_path / "master")
    canonical(spark, rows * 3).write.parquet(source)
    df = spark.read.parquet(source)
    found = V.tagged_views(df)
    got = [tuple(r) for r in found.collect()]
    text = found._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")]
    assert final.count("Scan parquet") == 1 and "ReusedExchange" in final
    for name, keys in VIEW_KEYS.items():
        want = sorted(map(str, (tuple(r) for r in consensus(df, keys, ["country_iso2"]).collect())))
        assert sorted(str(r[:-2]) for r in got if r[-2] == name) == want
    assert sorted(str(r[:-2]) for r in got if r[-2] == "all_rows") == sorted(str(tuple(r)) for r in df.collect())
    one = V.tagged_views(df, ["admin_areas"])
    assert {r["view"] for r in one.collect()} == {"admin_areas"}
