import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from placebook.operators.consensus import consensus, distinct_counts, view
from placebook.operators.search import search_via_source, search_view
from placebook.schema import COLUMNS, MASTER, VIEW_KEYS

NAN = float("nan")
ROWS = [
    ("k1", "a", 1.0, None),
    ("k1", "a", None, ""),
    ("k1", " ", 1.0, "x"),
    ("k2", "a", 0.0, "x"),
    ("k2", "b", -0.0, "x"),
    (None, "z", 2.0, " "),
    (None, "z", 3.0, None),
    ("", "q", NAN, "t"),
    ("", "q", 5.0, "t "),
    (" ", None, NAN, "　"),
]
EXPECTED = {
    ("k1", "a", 1.0, "x"),
    ("k2", "", 0.0, "x"),
    (None, "z", None, None),
    ("", "q", 5.0, ""),
    (" ", None, None, None),
}
SCHEMA = "k string, t string, n double, u string"


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_hand_made_cases(spark):
    assert rows_of(consensus(spark.createDataFrame(ROWS, SCHEMA), ["k"])) == EXPECTED


@pytest.mark.parametrize("seed", range(3))
def test_order_and_partitioning_do_not_matter(spark, seed):
    shuffled = ROWS * 3
    random.Random(seed).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA).repartition(seed + 1)
    assert rows_of(consensus(df, ["k"])) == EXPECTED


def test_columns_keep_their_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).select("u", "n", "k", "t")
    assert consensus(df, ["k"]).columns == ["u", "n", "k", "t"]


def brute(rows, columns, keys, numeric):
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[columns.index(k)] for k in keys), []).append(r)
    out = set()
    for members in groups.values():
        row = []
        for i, c in enumerate(columns):
            if c in keys:
                row.append(members[0][i])
                continue
            said = {m[i] for m in members if m[i] is not None and (c in numeric or m[i].strip())}
            row.append(said.pop() if len(said) == 1 else None if not said or c in numeric else "")
        out.add(tuple(row))
    return out


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(7)
    pick = lambda *xs: rng.choice(xs)
    rows = [
        (pick("A", "B", None), "hot" if i % 3 == 0 else pick("x", "", " ", None, f"c{i % 40}"),
         pick("u", "v", "", None), pick(1.0, None), pick("same", " ", None))
        for i in range(2000)
    ]
    columns = ["g", "k", "t", "n", "s"]
    df = spark.createDataFrame(rows, "g string, k string, t string, n double, s string")
    found = consensus(df, ["k"], ["g"])
    assert rows_of(found) == brute(rows, columns, ["g", "k"], {"n"})
    # As many rows as there are distinct keys, and the same again from other pieces.
    counted = distinct_counts(df, {"v": ["k"]}, ["g"]).agg(F.sum("rows")).first()[0]
    assert found.count() == counted
    assert rows_of(consensus(df.repartition(9, "s"), ["k"], ["g"])) == rows_of(found)


def test_one_code_over_many_places_keeps_what_agrees(spark):
    rows = [("AU", "0822", "NT", f"town {i}") for i in range(111)] + [("AU", "0822", " ", None)]
    df = spark.createDataFrame(rows, "g string, code string, state string, town string")
    assert rows_of(consensus(df, ["code"], ["g"])) == {("AU", "0822", "NT", "")}


def canonical(spark, rows):
    filled = [tuple(r.get(c) for c in COLUMNS) for r in rows]
    return spark.createDataFrame(filled, MASTER)


def test_wholly_empty_key_levels_lose_no_rows(spark):
    df = canonical(
        spark,
        [{"country_iso2": "AU", "region_1_en": "N", "postal_code": str(i)} for i in range(148)],
    )
    found = view(df, "admin_areas").collect()
    assert len(found) == 1 and found[0].postal_code == "" and found[0].region_1_en == "N"
    counts = distinct_counts(df, VIEW_KEYS, ["country_iso2"])
    assert {(r["view"], r["rows"]) for r in counts.collect()} == {("postal_codes", 148), ("admin_areas", 1)}


def test_second_pass_after_reading_blank_as_null_changes_nothing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    once = consensus(df, ["k"])
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    once = once.select("k", blank("t"), "n", blank("u"))
    assert rows_of(consensus(once, ["k"])) == rows_of(once)


def test_search_finds_blanked_values_only_through_the_source(spark):
    df = canonical(
        spark,
        [
            {"country_iso2": "AU", "postal_code": "0872", "place_name": p}
            for p in ("Sydney", "Perth")
        ]
        + [{"country_iso2": "AU", "postal_code": None, "place_name": "Sydney 100%"}],
    )
    keys = ["postal_code"]
    hits = search_via_source(df, "sydney", keys)
    assert {r.postal_code for r in hits.collect()} == {"0872", None}
    assert {r.postal_code for r in search_view(df, "sydney", keys).collect()} == {None}
    stored = view(df, "postal_codes")
    assert rows_of(search_via_source(df, "SYDNEY", keys, view=stored)) == rows_of(hits)
    assert {r.postal_code for r in search_via_source(df, "0%", keys).collect()} == {None}
    assert search_via_source(df, "  ", keys).count() == 2
    assert search_via_source(df, "_", keys).count() == 0


def test_plan_has_one_shuffle(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = consensus(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert reduce(lambda n, word: n + plan.count(word), ["BatchEval", "ArrowEval"], 0) == 0
