"""Differences of sources against the registered SQL and a plain count."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd

from placebook.llm import divergence
from placebook.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text or "")]


def expected(rows, min_docs):
    """All rows of the audit by counting words in plain Python."""
    docs_with, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = terms_of(text)
        counts[lang, source].update(words)
        docs_with[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs_with[lang].items() if n >= min_docs)
        own = {s: [counts[lang, s][t] for t in kept] for s in sources}

        def p(n):
            below = sum(n) + 5 * len(kept)
            return [1 + 10**9 * (c + 5) // below for c in n]

        q = p([sum(c) for c in zip(*own.values(), strict=True)])
        shares = {s: p(n) for s, n in own.items()}
        for s in sources:
            pairs = [(o, sum(abs(a - b) for a, b in zip(shares[s], shares[o], strict=True))) for o in sources - {s}]
            above = [(t, a - b) for t, n, a, b in zip(kept, own[s], shares[s], q, strict=True) if n and a > b]
            for part, found in (("pair", pairs), ("term", above)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1) if part == "pair" or i <= 50]
    return sorted(out)


def got(frame, **more):
    return sorted(tuple(r) for r in divergence.audit(frame, **more).collect())


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op12_source_divergence"](spark, folder)
    assert found.columns == divergence.OUT and dict(found.dtypes)["value"] == "bigint" and dict(found.dtypes)["rank"] == "int"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = db.sql(ORACLES["op12_source_divergence"]).fetchall()
    rows = sorted(tuple(r) for r in found.collect())
    assert len(rows) > 5000 and rows == sorted(want)


def test_hard_documents(spark):
    words = ["The", "the", "été", "ÉTÉ", "x1y", "漢字", "a-b", "\U0001f600", "I'm", "\x00nul", "don’t"]
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice(words, rng.integers(0, 9))), ["en", "", None][rng.integers(3)], [None, "s1", "s2", "s\n3", ""][rng.integers(5)]) for _ in range(300)]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("12 34", "fr", None), ("mot", "de", "z"), ("mot " * 50_000, "en", "long")]
    full = [(*r, "x", 7, "y") for r in rows]
    frame = spark.createDataFrame(full, "text string, lang string, source string, term string, n int, part string")
    for least in (1, 5, 10**6):
        assert got(frame, min_docs=least) == expected(rows, least)
    assert got(frame.limit(0)) == []


def test_source_and_term_blocks(spark, monkeypatch):
    """More sources and terms than a block holds, and one source of a third of all rows."""
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 4)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 8)
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "pqrstuvw"]
    rows = [(" ".join(rng.choice(words, 12)), "en", "hot" if i % 3 == 0 else f"s{rng.integers(20)}") for i in range(400)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(frame, min_docs=2) == expected(rows, 2)


def test_document_vectors(spark):
    frame = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    docs = spark.createDataFrame(frame[["text", "lang", "source"]].values.tolist() + [[None, None, None]], "text string, lang string, source string")
    found = divergence.document_vectors(docs).collect()
    assert len(found) == len(frame) + 1
    want = Counter((r.lang, r.source, *sorted(Counter(terms_of(r.text)).items())) for r in frame.itertuples())
    want[("", "")] += 1
    assert Counter((r.lang, r.source, *zip(r.terms, r.counts, strict=True)) for r in found) == want
