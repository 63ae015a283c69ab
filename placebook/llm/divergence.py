"""How the sources of a language differ in their words.

Documents become sparse vectors of term counts, as a count vectorizer per language with a
least document frequency and no bound on the vocabulary makes them: the terms of a batch
are encoded by a dictionary, and (document, term) pairs counted. Vectors are summed by
(language, source), within batches first and then by Spark, together with the documents
that hold each term; no vocabulary is gathered anywhere, a term stands for itself. Terms in
fewer than ``MIN_DOCS`` documents of a language are left out of it.

A group is a language and one of its sources. Its smoothed share of a term is
``p = 1 + floor(10**9 * (count + 5) / (N + 5 * V))``, ``N`` the sum of its counts and ``V``
the language's number of terms; ``q`` is the same for the whole language. All in integers.

Pairs of sources are compared where either has the term: ``|p - p'|`` over all terms is
``V * |p0 - p0'|``, the shares of absent terms, plus the difference that present terms make.
Terms are dealt to blocks of about ``BLOCK_TERMS`` and sources to blocks of at most about
``BLOCK_SOURCES``; a task holds a matrix of two source blocks by one term block, and
returns one sum per pair.

* Null text, lang or source: empty. A source without terms is a group like any other.
* A language without kept terms: pairs differ by 0, no rows by term. Empty table: no rows.
* Repeated ids: every row is a document. Very long texts: whole, in a batch of their own.
* Equal values: ranked by the item's bytes. Columns besides the three are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placebook.llm.arrays import joined_bytes
from placebook.llm.common import stored, text_or_empty, within_arrow

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
BATCH_BYTES = 16_000_000
BLOCK_TERMS = 1024
BLOCK_SOURCES = 64
OUT = ["lang", "source", "part", "item", "value", "rank"]


def vectors(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse count vectors of texts: the terms, and (text, term, count) of all entries."""
    data, begins = joined_bytes(texts)
    inside = (data >= 128) | (((data | 32) >= 97) & ((data | 32) <= 122))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    letters = data[inside]
    letters = np.where((letters >= 65) & (letters <= 90), letters + np.uint8(32), letters)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64)
    text = np.searchsorted(begins, starts, "right") - 1
    entries, counts = np.unique(text * max(len(terms.dictionary), 1) + code, return_counts=True)
    return terms.dictionary, entries // max(len(terms.dictionary), 1), entries % max(len(terms.dictionary), 1), counts


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(text_or_empty(c).alias(c) for c in ("lang", "source", "text")))


def group_sums(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: vectors summed by group, and how many documents
    hold the term. A null term's row says that the group occurs."""
    schema = "lang string, source string, term string, n long, docs long"

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        groups = pa.StructArray.from_arrays([batch.column(c).cast(pa.large_string()) for c in ("lang", "source")], ["lang", "source"])
        names: dict[tuple, int] = {}
        own = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
        terms, text, term, count = vectors(batch.column("text"))
        key = own[text] * max(len(terms), 1) + term
        sums, at, docs_with = np.unique(key, return_inverse=True, return_counts=True)
        totals = np.zeros(len(sums), np.int64)
        np.add.at(totals, at, count)
        group = np.concatenate([sums // max(len(terms), 1), np.arange(len(names))])
        lang, source = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
        none = len(names)
        columns = [lang.take(pa.array(group)), source.take(pa.array(group))]
        columns.append(pa.concat_arrays([terms.take(pa.array(sums % max(len(terms), 1))).cast(pa.string()), pa.nulls(none, pa.string())]))
        columns += [pa.array(np.concatenate([x, np.zeros(none, np.int64)])) for x in (totals, docs_with)]
        return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    return _plain(docs).mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def document_vectors(docs: DataFrame) -> DataFrame:
    """``lang, source, terms, counts`` of every row: its count vector, terms by their bytes."""
    schema = "lang string, source string, terms array<string>, counts array<long>"

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, text, term, count = vectors(batch.column("text"))
        order = np.argsort(np.array([t.encode() for t in terms.to_pylist()], object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((place[term], text))
        offsets = pa.array(np.searchsorted(text[by], np.arange(batch.num_rows + 1)), pa.int32())
        words = pa.ListArray.from_arrays(offsets, terms.take(pa.array(term[by])).cast(pa.string()))
        counts = pa.ListArray.from_arrays(offsets, pa.array(count[by], pa.int64()))
        return pa.RecordBatch.from_arrays([*(batch.column(c).cast(pa.string()) for c in ("lang", "source")), words, counts], ["lang", "source", "terms", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    return _plain(docs).mapInArrow(run, schema)


def share(count, total, terms):
    """``1 + floor(10**9 * (count + 5) / (N + 5 * V))`` without rounding, at any size."""
    wide = lambda x: x.cast("decimal(28,0)")
    top, below = wide(count + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTHING * terms)
    return (F.call_function("div", top, F.when(below > 0, below)) + 1).cast("long")


def shares(sums: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Entries ``lang, source, term, p, q`` with a count, and groups ``lang, source, terms,
    total, p0, blocks``."""
    by_term = Window.partitionBy("lang", "term")
    whole = sums.where("term is not null").withColumns({"in_docs": F.sum("docs").over(by_term), "of_lang": F.sum("n").over(by_term)})
    kept = stored(whole.where(F.col("in_docs") >= min_docs).drop("docs", "in_docs"), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    words = kept.groupBy("lang", "term").agg(F.max("of_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    found = sums.where("term is null").select("lang", "source")
    groups = found.join(words, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total"])
    groups = groups.withColumn("p0", F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0)))
    groups = stored(groups.withColumn("blocks", F.ceil(F.col("terms") / BLOCK_TERMS)), "groups")
    entries = kept.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("of_lang"), F.col("lang_total"), F.col("terms"))
    return entries.select("lang", "source", "term", p.alias("p"), q.alias("q"), "blocks"), groups


def pair_sums(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, other, more``: by pairs, how much more than absent terms the present
    ones differ, summed over terms."""
    wide = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).alias("parts"))
    sources = stored(groups.where("blocks > 0").join(wide, "lang").select("lang", "source", "p0", "blocks", "parts"), "source-parts")
    own = F.pmod(F.xxhash64("source"), F.col("parts"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    all_blocks = sources.select("lang", "source", F.explode(numbers(F.col("blocks"))).alias("block"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "parts")
    filled = entries.join(sources.select("lang", "source", "parts"), ["lang", "source"]).select("lang", "source", block.alias("block"), "term", "p", "parts")
    # Each pair of source blocks meets once, the smaller number first.
    met = F.transform(numbers(F.col("parts")), lambda x: F.struct(F.least(own, x).alias("low"), F.greatest(own, x).alias("high")))
    rows = all_blocks.unionByName(filled).withColumns({"own": own, "met": F.explode(met)}).select("lang", "source", "block", "term", "p", "own", "met.low", "met.high")
    schema = "lang string, source string, other string, more long"

    def run(table: pa.Table) -> pa.Table:
        place = {c: table.column(c).combine_chunks().dictionary_encode() for c in ("source", "term")}
        source, names = place["source"].indices.to_numpy(), place["source"].dictionary
        absent = table.column("term").is_null().to_numpy()
        p, part = table.column("p").to_numpy(), table.column("own").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        base = np.zeros(len(names), np.int64)
        base[source[absent]] = p[absent]
        where = np.zeros(len(names), np.int64)
        where[source] = part
        matrix = np.repeat(base[:, None], len(place["term"].dictionary), 1)
        term = place["term"].indices.fill_null(0).to_numpy(zero_copy_only=False)
        matrix[source[~absent], term[~absent]] = p[~absent]
        left, right = np.flatnonzero(where == low), np.flatnonzero(where == high)
        first, second, more = [], [], []
        for i in left:
            others = right[right > i] if low == high else right
            first.append(np.full(len(others), i))
            second.append(others)
            more.append(np.abs(matrix[others] - matrix[i]).sum(1) - np.abs(base[others] - base[i]) * matrix.shape[1])
        one, two, sums = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (first, second, more))
        lang = pa.array([table.column("lang")[0].as_py()] * len(one), pa.string())
        return pa.table([lang, names.take(pa.array(one)).cast(pa.string()), names.take(pa.array(two)).cast(pa.string()), pa.array(sums)], ["lang", "source", "other", "more"])

    found = rows.groupBy("lang", "block", "low", "high").applyInArrow(run, schema)
    return found.groupBy(F.col("lang"), F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other")).agg(F.sum("more").alias("more"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far every other source is (``pair``),
    and the terms a source uses most above its language (``term``)."""
    entries, groups = shares(stored(group_sums(docs), "term-sums"), min_docs)
    entries = stored(entries, "term-shares")
    order = F.desc("value"), F.asc("item")
    by_group = Window.partitionBy("lang", "source").orderBy(*order)
    above = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = above.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top_terms)
    own = groups.select("lang", "source", "terms", "p0")
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    pairs = own.join(other, "lang").where("source < other").join(pair_sums(entries, groups), ["lang", "source", "other"], "left")
    value = F.col("terms") * F.abs(F.col("p0") - F.col("q0")) + F.coalesce("more", F.lit(0))
    sides = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("side")
    both = pairs.select("lang", value.alias("value"), sides).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    return both.withColumn("rank", F.row_number().over(by_group)).select(OUT).unionByName(top.select(OUT))


AUDIT_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), words AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), counted AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(c) AS n FROM counted GROUP BY lang, source),
groups AS (
  SELECT g.lang, g.source, coalesce(t.n, 0) AS n, coalesce(s.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN sizes s ON s.lang = g.lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000 * (coalesce(c.c, 0) + 5)::HUGEINT) // (g.n + 5 * g.v) AS p,
    1 + (1000000000 * (k.c + 5)::HUGEINT) // (s.n + 5 * s.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
