from pyspark.sql import functions as F

from placebook.functions.scalars import bin_of, number_text, percent, whole_number
from placebook.functions.absence import WHITESPACE, has_text
from placebook.operators.profile import coverage, level_profile, opening_values, profile
from placebook.operators.ranking import first_per_group, first_per_group_wide
from placebook.schema import COLUMNS, MASTER


def canonical(spark, rows):
    schema = "n bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MASTER)
    return spark.createDataFrame([(i, *(r.get(c) for c in COLUMNS)) for i, r in enumerate(rows)], schema)


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


ROWS = [
    {"country_iso2": "AA", "country_en": None, "region_2_lc": " "},
    {"country_iso2": "AA", "country_en": "later", "postal_code": " ", "region_1_en": "r", "latitude": float("nan")},
    {"country_iso2": "AA", "postal_code": "01000", "region_4_lc": "d", "latitude": 1.0},
    {"country_iso2": "BB", "country_en": "B", "region_1_iso_code": "BB-1", "region_1_lc": "x"},
    {"country_iso2": None, "postal_code": "9"},
]


def test_depth_counts_data_and_keeps_gaps(spark):
    found = {r.country_iso2: r for r in coverage(canonical(spark, ROWS)).collect()}
    a, b = found["AA"], found["BB"]
    assert a.admin_depth == 4 and [x.filled_pct for x in a.admin_levels] == [33.3, 0.0, 0.0, 33.3]
    assert [x.label for x in a.admin_levels][:2] == ["Level 1", "Level 2"]
    assert a.coord_coverage_pct == 33.3 and not a.has_place_name
    assert b.admin_depth == 1 and b.admin_levels[0].label == "Subdivision (ISO 3166-2)"
    assert (b.admin_levels[0].has_en, b.admin_levels[0].has_lc) == (False, True)
    assert b.region_1_iso_coverage_pct == 100.0


def test_depth_zero_gives_no_levels(spark):
    found = coverage(canonical(spark, [{"country_iso2": "AA"}])).first()
    assert found.admin_depth == 0 and found.admin_levels == []


def test_opening_values_take_one_row_and_the_first_example(spark):
    df = canonical(spark, ROWS).repartition(3)
    expected = {("AA", None, " "), ("BB", "B", None)}
    columns = ("country_iso2", "country_en", "postal_code_example")
    assert rows(opening_values(df, ["n"]).where("country_iso2 is not null"), *columns) == expected
    assert rows(profile(df, ["n"]), *columns) == expected


def test_profile_with_text_order_agrees(spark):
    df = canonical(spark, ROWS).withColumn("t", F.lpad(F.col("n").cast("string"), 3, "0"))
    columns = ("country_iso2", "rows", "postal_code_example")
    assert rows(profile(df, ["t"]).where("country_iso2 is not null"), *columns) == rows(profile(df, ["n"]), *columns)


def test_level_profile_lists_empty_levels(spark):
    assert level_profile(canonical(spark, ROWS)).where("country_iso2 = 'AA'").count() == 5


def test_first_rows_with_a_hot_group(spark):
    data = [("hot" if i % 3 else f"g{i % 5}", i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i bigint").repartition(16)
    expected = set()
    for g in {g for g, _ in data}:
        expected |= {(g, i) for i in sorted(i for h, i in data if h == g)[:100]}
    for lanes in (1, 4):
        assert rows(first_per_group(df, ["g"], ["i"], 100, lanes=lanes), "g", "i") == expected


def test_blank_is_all_white_space(spark):
    values = ["", " ", "\t\n", WHITESPACE, " ", "x", " x", "　é", "é", "\x7f", "!", "~", "0", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    expected = [bool(v and v.strip()) for v in values]
    assert [r[0] for r in df.select(has_text("v")).collect()] == expected


def test_percent_rounds_half_to_even(spark):
    pairs = [(c, n) for n in (0, 1, 3, 8, 16, 40, 80, 400, 2000) for c in range(0, n + 1, max(1, n // 80))]
    df = spark.createDataFrame(pairs, "c bigint, n bigint")
    for r in df.select("c", "n", percent(F.col("c"), F.col("n")).alias("p")).collect():
        assert r.p == (round(100.0 * r.c / r.n, 1) if r.n else 0.0)


def test_small_scalars(spark):
    df = spark.createDataFrame([(999,), (1000,), (9999,), (10000,), (100000,), (499999,), (500000,)], "n int")
    assert [r[0] for r in df.select(bin_of("n")).collect()] == [0, 1, 1, 2, 3, 3, 4]
    df = spark.createDataFrame([("",), (" 7 ",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(whole_number("t")).collect()] == [0, 7, 0, 0]


def test_number_text_reads_as_python_writes(spark):
    values = [0.0, -0.0, 1.0, -113.1506, 0.001, 0.00012, 0.0001, 1e-5, 1.5e-7, 12345678.9, 1e15, 123456789012345.6, 1e16, 1e22, -2.5e-10]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(number_text("v")).collect()] == [repr(v) for v in values]


def test_null_in_the_leading_order_column_comes_first(spark):
    df = canonical(spark, ROWS).withColumn("n", F.when(F.col("postal_code") != "01000", F.col("n")))
    columns = ("country_iso2", "postal_code_example")
    assert ("AA", "01000") in rows(opening_values(df.withColumn("m", F.col("n")), ["n", "m"]), *columns)


def test_wide_first_rows_agree_with_plain_ones(spark):
    data = [("hot" if i % 3 else None, None if i % 50 == 0 else i % 7, i, "x" * 20) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, a int, i bigint, w string").repartition(8)
    plain = rows(first_per_group(df, ["g"], ["a", "i"], 60), "g", "i", "w")
    assert rows(first_per_group_wide(df, ["g"], ["a", "i"], 60), "g", "i", "w") == plain
    assert len(plain) == 120
