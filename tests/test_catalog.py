import datetime

import pytest
from pyspark.sql import functions as F

from placebook.operators import catalog as C
from placebook.operators import links as L
from placebook.operators import listing as B
from placebook.operators import requests as R
from placebook.operators import upstream as U
from placebook.operators.search import first_rows, match_summary, preview
from placebook.plans.build import build_entries, raw_sources
from placebook.schema import COLUMNS, MASTER
from placebook.sinks.catalog import write_document
from placebook.sinks.views import view_files
from placebook.sources.tables import read_catalog, read_catalog_header, read_sources


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("build")
    rows = [
        {"country_iso2": "FR", "country_en": "France", "continent_name": "Europe", "postal_code": f"0{i % 150}", "region_1_en": "r"}
        for i in range(300)
    ] + [{"country_iso2": "MX", "country_en": "Mexico", "continent_code": "NA", "postal_code": "1"}, {"country_iso2": "ZZ", "postal_code": "1"}]
    schema = "n bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MASTER)
    master = spark.createDataFrame([(i, *(r.get(c) for c in COLUMNS)) for i, r in enumerate(rows)], schema)
    for name in ("b2/SRC_QA.csv", "b3/SRC_QA.csv"):  # one name in two folders
        raw_path = folder / name
        raw_path.parent.mkdir()
        raw_path.write_text("place_name;latitude;region_1\np;1;x\n" + "q;;\n" * ("b3" in name))
    (folder / "b2/SRC_QA.xlsx").write_bytes(b"sheet")
    versions = "country_iso2 string, selected_rel_path string, selected_batch string, n_rows string, last_updated string, selected_encoding string, selected_delimiter string"
    dims = C.Dimensions(
        table(spark, versions, ("FR", "b1/SRC_FR.csv", "b1", "300", "2024-03-01", "", ""), ("MX", "b1/SRC_MX.csv", "b1", "", "2024-01-01", "", ""),
              ("QA", "b2/SRC_QA.csv", "b2", "1", "2024-05-01", "utf-8", ";"), ("QB", "b3/SRC_QA.csv", "b3", "2", "", None, ";"), ("XX", "b2/SRC_XX.csv", "b2", "9", "2023-01-01", "", "")),
        table(spark, "country_iso2 string, country_iso3 string, country_en string, continent_code string, continent_name string",
              ("FR", "REF", "Ref France", "EU", "Europe"), ("QA", "QAT", "Qatar", "AS", "Asia")),
        table(spark, "country_iso2 string", ("QA",)),
        table(spark, "alpha_2 string, numeric string", ("FR", "250"), ("QA", "634")),
        table(spark, "country_iso2 string, language string", ("QA", "ar"), ("FR", "fr")),
        table(spark, "country_iso2 string, language string, name_lc string", ("QA", "ar", "Q-lc"), ("FR", "fr", "F-lc")),
    )
    raw = raw_sources(spark, dims.versions, master, str(folder))
    entries = build_entries(master, dims, ["n"], str(folder / "out"), raw)
    return folder, dims, entries


def test_entries_choose_by_status(built):
    _, _, entries = built
    e = {r.iso2: r for r in entries.collect()}
    assert set(e) == {"FR", "MX", "QA", "QB", "XX"}  # ZZ is not in the version table
    assert (e["FR"].name_en, e["FR"].iso3, e["FR"].name_lc, e["FR"].rows) == ("France", None, None, 300)
    assert e["FR"].view_stats["postal_codes"].rows == 150 and e["FR"].view_stats["admin_areas"].rows == 1
    assert e["FR"].files["parquet"].bytes > 0 and e["FR"].view_files["admin_areas"]["parquet"].bytes > 0
    assert e["FR"].sample_csv.rows == 100 and e["FR"].source_rows == 300 and e["MX"].source_rows == 0
    assert e["MX"].continent_code == "NA"
    qa = e["QA"]
    assert (qa.status, qa.name_en, qa.name_lc, qa.rows, qa.admin_depth) == ("delivered_no_data", "Qatar", "Q-lc", 0, 1)
    assert qa.files_are_source and set(qa.files) == {"csv", "xlsx"} and qa.files["csv"].name == "SRC_QA.csv" and qa.files["csv"].raw
    assert (qa.sample_csv.rows, qa.sample_csv.bytes) == (1, len('"place_name","latitude","region_1"\n"p","1","x"\n'))
    sample = next((built[0] / "out" / "source_samples" / "group=QA").rglob("part-*")).read_text()
    assert sample == '"place_name","latitude","region_1"\n"p","1","x"\n'
    assert qa.source_columns == ["place_name", "latitude", "region_1"] and qa.coord_coverage_pct == 100.0
    assert e["XX"].name_en == "XX" and e["XX"].files is None
    qb, today = e["QB"], datetime.date.today()
    assert (qb.files["csv"].bytes, qa.files["csv"].bytes, set(qb.files)) == (39, 35, {"csv"}) and qb.sample_csv.rows == 2
    assert qb.coord_coverage_pct == 50.0 and (today - datetime.date.fromisoformat(qb.last_updated)).days <= 1
    assert qa.last_updated == qb.last_updated and e["FR"].last_updated == "2024-03-01"  # FR's file is not there


def test_sample_bytes_are_file_sizes(built):
    folder, _, entries = built
    sizes = {r.iso2: r.sample_csv.bytes for r in entries.where("status = 'covered'").collect()}
    for code in ("FR", "MX"):
        files = list((folder / "out" / "samples" / f"group={code}").rglob("part-*"))
        assert sum(f.stat().st_size for f in files) == sizes[code] and len(files) == 1


def test_totals_and_document(spark, built, tmp_path):
    _, dims, entries = built
    totals = C.catalog_totals(entries).first()
    assert (totals.countries, totals.countries_with_files, totals.delivered_no_data, totals.rows) == (2, 5, 3, 301)
    assert totals.continents == ["Europe"] and totals.last_updated_range[0] == "2023-01-01" and totals.last_updated_range[1] > "2026"
    assert totals.download_bytes.sample_csv > totals.download_bytes.parquet * 0
    path = str(tmp_path / "doc")
    write_document(entries, path, "now")
    assert [r.name_en for r in read_catalog(spark, path).collect()] == ["France", "Mexico", "QB", "Qatar", "XX"]
    assert read_catalog_header(spark, path).first().countries == 2
    text = next((tmp_path / "doc").glob("part-*")).read_text()
    assert text.count("files_are_source") == 3  # absent where it does not apply
    statuses = entries.select(F.col("iso2").alias("country_iso2"), "status")
    assert {r[0] for r in C.unreported(statuses, dims.no_postal).collect()} == {"QB", "XX"}
    assert {r[0] for r in C.without_numeric(dims.versions, dims.numeric).collect()} == {"MX", "QB", "XX"}


def test_requests(spark, built):
    _, _, entries = built
    asked = table(
        spark, "iso2 string, fmt string, view string",
        ("fr", "csv", "postal_codes"), ("QA", "csv", "admin_areas"), ("QA", "parquet", "all_rows"), ("YY", "csv", "all_rows"),
        ("FR", "xlsx", "all_rows"), ("FR", "pdf", "all_rows"), ("XX", "csv", "all_rows"),
    )
    found = {tuple(r[c] for c in ("iso2", "fmt", "view")): r for r in R.decisions(asked, entries, sheet_limit=299).collect()}
    ok = found[("FR", "csv", "postal_codes")] if ("FR", "csv", "postal_codes") in found else found[("fr", "csv", "postal_codes")]
    assert (ok.code, ok.file, ok.rows) == (200, "FR.postal_codes.csv", 150)
    assert (found[("QA", "csv", "admin_areas")].file, found[("QA", "csv", "admin_areas")].rows) == ("SRC_QA.csv", 1)
    assert found[("QA", "parquet", "all_rows")].reason == "not available as parquet, try csv or xlsx"
    codes = {k[0] + k[1]: r.code for k, r in found.items()}
    assert (codes["YYcsv"], codes["FRxlsx"], codes["FRpdf"], codes["XXcsv"]) == (404, 409, 422, 409)
    one = asked.where("iso2 in ('QA', 'fr') and fmt = 'csv'")
    none = R.decisions(one, entries, table(spark, "iso2 string, view string, fmt string, bytes bigint"))
    assert {(r.iso2, r.code, r.reason) for r in none.collect()} == {("QA", 404, "file is not in place"), ("FR", 409, "not generated")}
    empty = entries.where("iso2 = 'FR'").withColumn("rows", F.lit(0)).unionByName(entries.where("iso2 = 'MX'").withColumn("view_stats", F.create_map().cast("map<string,struct<rows:bigint>>")))
    rest = table(spark, "iso2 string, fmt string, view string", ("FR", "csv", "all_rows"), ("MX", "csv", "postal_codes"), ("MX", "csv", "all_rows"))
    assert [r.reason for r in R.decisions(rest, empty).orderBy("iso2", "view").collect()] == ["no rows to export", "ok", "view not offered"]


def test_bundles_are_had_whole_or_not_at_all(spark, built):
    """Sizes are those of the stored files; an unknown or unavailable member fails its bundle."""
    folder, dims, entries = built
    listing = read_sources(spark, str(folder)).withColumn("name", F.element_at(F.split("rel_path", "/"), -1))
    sources = listing.where("rel_path like 'b2/%'")
    served = R.served_views(view_files(spark, str(folder / "out" / "views"))).unionByName(R.served_sources(entries, sources))
    asked = {
        "whole": [("qa", "csv"), ("QA", "csv")], "tables": [("mx", "parquet"), ("FR", "parquet"), ("MX", "parquet")],
        "unknown": [("FR", "parquet"), ("zz", "parquet"), ("RR", "parquet")], "raw": [("FR", "parquet"), ("QA", "parquet")],
        "large": [("FR", "parquet")] * 201, "full": [("FR", "parquet")] * 200, "sheet": [("MX", "xlsx")],
    }
    rows = [(b, c, f, "all_rows", i) for b, codes in asked.items() for i, (c, f) in enumerate(codes)]
    verdicts, members = R.bundles(table(spark, "bundle string, iso2 string, fmt string, view string, position int", *rows), entries, served)
    found = {r.bundle: r for r in verdicts.collect()}
    assert {b: (r.code, r.refused) for b, r in found.items()} == {
        "whole": (200, None), "tables": (200, None), "unknown": (404, "ZZ"), "raw": (409, "QA"), "large": (422, None), "full": (200, None), "sheet": (409, "MX")}
    assert found["raw"].reason == "not available as parquet, try csv or xlsx" and found["unknown"].rows is None
    size = {g: sum(f.stat().st_size for f in (folder / "out/views/view=all_rows" / f"group={g}").glob("part-*")) for g in ("FR", "MX")}
    assert (found["tables"].groups, found["tables"].rows, found["tables"].bytes) == (2, 301, sum(size.values()))
    assert (found["whole"].rows, found["whole"].bytes, found["whole"].raw_groups) == (1, 35, "QA")
    lines = R.manifest(members)
    assert [(r.iso2, r.file, r.bytes) for r in lines.where("bundle = 'tables'").orderBy("position").collect()] == [
        ("MX", "MX.parquet", size["MX"]), ("FR", "FR.parquet", size["FR"])]
    assert {r.bundle for r in lines.collect()} == {"whole", "tables", "full"}
    text = {r.bundle: r.text.split("\n") for r in R.manifest_text(verdicts, lines, "today").collect()}
    today = entries.where("iso2 = 'QA'").first().last_updated
    assert text["whole"] == [
        "".join(t.ljust(w) for t, w in R.MANIFEST_COLUMNS), f"{'QA':8}{'1':14}{today:14}{'SRC_QA.csv':36}SRC_QA.csv (as delivered)", "",
        "1 groups with 1 rows in 35 bytes, csv of all rows, out of the catalog of today", "Served as delivered, without codes: QA",
        "Read code columns as text; as numbers they lose leading zeros.", ""]
    long = lines.where("bundle = 'whole'").withColumn("file", F.lit("a-name-longer-than-its-column-is-wide.csv"))
    assert "a-name-longer-than-its-column-is-wide.csv SRC_QA.csv" in R.manifest_text(verdicts, long, "now").first().text
    picked = table(spark, "iso2 string, position int", ("qa", 1), ("FR", 2), ("QA", 3), ("XX", 4), ("no", 5))
    assert B.selection_totals(R.selection(entries, picked)).first().sendable == 2
    assert {r.iso2 for r in R.selection(entries, picked, with_sample=True).collect()} == {"FR", "QA"}


def test_links(spark, built):
    _, _, entries = built
    covered = entries.where("status = 'covered'")
    listing = table(spark, "id string, name string, position int", ("1", "fr.csv", 1), ("2", "FR.csv", 2), ("3", "FR.CSV", 3),
                    ("4", "QA.csv", 4), ("5", "FRA.csv", 5), ("6", "fr.xlsx", 6))
    classified = L.classify_listing(listing, covered)
    assert {r.id: r.bucket for r in classified.collect()} == {
        "1": "linked", "2": "linked", "3": "unmatched", "4": "unknown", "5": "unmatched", "6": "linked"}
    links = L.link_table(classified)
    merged = {r.iso2: r.drive_links for r in L.merge_links(entries, links).collect()}
    assert merged["FR"]["csv"].endswith("/2/view") and set(merged["FR"]) == {"csv", "xlsx"} and merged["MX"] is None
    summary = L.link_summary(covered, links, classified).first()
    assert (summary.linked, summary.with_both, summary.missing, summary.ignored_name, summary.ignored_group) == (1, 1, 1, 2, 1)
    assert [r[0] for r in L.not_linked(covered, links).collect()] == ["MX"]


def test_listing_and_map(spark, built):
    _, _, entries = built
    codes = lambda df: [r.iso2 for r in df.collect()]
    assert codes(B.facets(entries, text=" fr ")) == ["FR"]
    assert set(codes(B.facets(entries, status="covered"))) == {"FR", "MX"}
    assert codes(B.facets(entries, region="Asia")) == ["QA"]
    assert codes(B.sort_entries(entries, "rows", True))[:2] == ["FR", "MX"]
    assert codes(B.sort_entries(entries, "continent_name")) == ["MX", "QB", "XX", "QA", "FR"]
    words = table(spark, "name_en string, x int", ("Cuba", 1), ("austria", 1), ("Côte", 1), ("Austria", 1))
    assert [r.name_en for r in B.sort_entries(words).collect()] == ["austria", "Austria", "Côte", "Cuba"]
    features = table(spark, "id string, name string", ("250", "F"), ("634", "Q"), (None, "N. Mex"), ("999", "no"), (None, None))
    shown = B.map_features(features, entries, {"N. Mex": "MX"}).withColumn("fill", B.fill_state())
    assert {(r.name, r.iso2, r.fill) for r in shown.collect()} == {
        ("F", "FR", "<1K"), ("Q", "QA", "hatch"), ("N. Mex", "MX", "<1K"), ("no", None, "absent"), (None, None, "absent")}


def test_preview_limits(spark):
    df = table(spark, ", ".join(f"{c} string" for c in COLUMNS), *[tuple("FR" if c == "country_iso2" else str(i) for c in COLUMNS) for i in range(120)])
    rows, summary = preview(df, "fr", ["postal_code"])
    assert rows.count() == 100 and tuple(summary.first()) == (120, 100, True)
    assert tuple(match_summary(df.limit(5)).first()) == (5, 5, False)
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            preview(df, "fr", ["postal_code"], limit=bad)
    assert first_rows(df, ["postal_code"], 2000).count() == 120
    with pytest.raises(ValueError):
        preview(df, "fr", ["postal_code"], "x" * 101)
    with pytest.raises(ValueError):
        preview(df, "fr", ["postal_code"], view="towns")


def test_upstream(spark):
    files = table(spark, "country_iso2 string, rel_path string", ("AU", "Batch 1/AU_v9.csv"), ("AU", "rev/AU_v2.csv"), ("AU", "rev/AU.csv"),
                  ("FR", "Batch 1/FR_v10.csv"), ("FR", "Batch 2/FR_v9.csv"))
    best = {r.country_iso2: (r.selected_rel_path, r.selected_batch) for r in U.resolve_versions(files, "rev").collect()}
    assert best == {"AU": ("rev/AU_v2.csv", "rev"), "FR": ("Batch 1/FR_v10.csv", "Batch 1")}
    codes = table(spark, "country_iso2 string, postal_code string", *[("DE", "01067"), ("DE", "10115"), ("DE", "1067"), ("DE", "A1"), ("DE", " "), ("GB", "W1")])
    assert [(r.postal_code, r.restored) for r in U.lost_zeros(codes).collect()] == [("1067", "01067")]
    assert U.with_code(codes).count() == 5
    a = table(spark, "country_iso2 string, v string", ("A", "x"), ("A", "x"), ("A", None), ("B", "y"))
    b = table(spark, "country_iso2 string, v string", ("A", "x"), ("A", None), ("A", "z"), ("B", "y"))
    found = {r.country_iso2: tuple(r)[1:] for r in U.audit(a, b, columns=["country_iso2", "v"]).collect()}
    assert found == {"A": (3, 3, 1, 1), "B": (1, 1, 0, 0)}
    assert {(r.v, r.surplus) for r in U.differences(a, b, ["country_iso2", "v"]).collect()} == {("x", -1), ("z", 1)}


def test_repeated_keys_of_a_dimension_multiply_nothing(spark):
    versions = table(spark, "country_iso2 string, status string, country_iso3 string, country_en string, country_lc string, continent_code string, continent_name string",
                     ("FR", "delivered_no_data", None, None, None, None, None), ("DE", "covered", "x", "y", "z", "c", "d"))
    numeric = table(spark, "alpha_2 string, numeric string", ("FR", "250"), ("FR", "249"), ("FR", "250"))
    assert {tuple(r) for r in C.with_numeric(versions.select("country_iso2"), numeric).collect()} == {("FR", "250"), ("DE", None)}
    countries = table(spark, "country_iso2 string, country_iso3 string, country_en string, continent_code string, continent_name string",
                      ("FR", "A", "B", "C", "D"), ("FR", "A", "C", "B", "D"))
    languages = table(spark, "country_iso2 string, language string", ("FR", "fr"), ("FR", "br"))
    words = table(spark, "country_iso2 string, language string, name_lc string", ("FR", "fr", "F1"), ("FR", "fr", "F2"), ("FR", "br", "B"))
    named = C.with_names(versions, countries, languages, words).collect()
    assert {(r.country_iso2, r.iso3, r.name_en, r.name_lc, r.continent_code) for r in named} == {("FR", "A", "C", "F2", "B"), ("DE", "x", "y", "z", "c")}
    rows = table(spark, "country_iso2 string, country_iso3 string, country_en string, country_lc string, continent_code string, continent_name string, region_1_en string, region_1_iso_code string",
                 ("FR", " ", "E", "E", None, "", "r", ""))
    filled = U.backfill(rows, countries, languages, words).collect()
    assert [tuple(r)[:6] for r in filled] == [("FR", "A", "E", "F2", "B", "D")]
    regions = table(spark, "country_iso2 string, region_1_en string, region_1_iso_code string", ("FR", "r", "FR-1"), ("FR", "r", "FR-2"))
    assert [r.region_1_iso_code for r in U.with_region_code(rows, regions).collect()] == ["FR-2"]
    heads = table(spark, "country_iso2 string, header string", ("FR", " A "))
    means = table(spark, "header string, canonical string", ("a", "x"), ("A", "y"))
    assert [tuple(r) for r in U.mapped_headers(heads, means).collect()] == [("FR", " A ", "y")]
