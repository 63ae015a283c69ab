"""Repeated passages by content-defined chunks.

A passage is a repeat when its bytes occur elsewhere too and hold at least ``LEAST_RUN``
words; of each run of so many words the first occurrence (smallest document, then place)
stays, the others are removed whole, from their first word to their last.

A gear rolling hash runs over the bytes of each text. Of any ``REACH`` neighbouring words
the one at whose end it is smallest (the last of equals) is a border, so borders depend on
nearby content alone; what lies between two borders is a chunk of up to ``REACH`` words. A
run of ``LEAST_RUN`` words holds two windows of ``REACH`` word ends, apart from each other
and with all the bytes their hashes are of, hence a whole chunk, the same in all copies:
the one after the border that its first window chooses.

1. Chunks are compared by a digest of their bytes and of the ``LEAD`` words before, up to
   ``REACH`` words behind their first border, which every run of theirs holds. One row each.
2. A chunk that comes twice is extended to all the runs it stands for. Where chunks agree
   so far as well, by a 128-bit digest, all but the first are repeats over their whole length.
3. Only the first of each such class, and only where classes share a chunk, is extended
   word by word: its runs are compared by 128-bit digests, which finds the true borders.

Words are what blanks part; a word of more than ``LONG`` bytes, as in scripts without
blanks, is cut into pieces where the rolling hash says so, which count as words.

* Null or empty text: no chunks, the text stays as it is. Very long texts: memory
  follows the longest text of a task; chunk counts follow the bytes.
* Equal ids: texts are told apart by id and hash, so rows equal in both are listed as one
  first occurrence and stay; equal texts under other ids are repeats of the smallest id's.
* Null ids: their texts are left alone. Empty table: no rows. Other columns: untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.arrays import BASE, joined_bytes, mix, span_hashes
from placebook.llm.common import if_small, stored, within_arrow

# Words of the shortest repeat: more than fifty.
LEAST_RUN = 51
# Words before the first word end of a run whose hash has no byte from outside the run: the
# hash is of eight bytes, a word has one at least.
LEAD = 7
REACH = (LEAST_RUN - LEAD) // 2
# Longest word left whole, longest piece of a longer one, and bits that end a piece.
LONG = 32
PIECE = 64
PIECE_BITS = 3
# No chunk has more bytes, blanks aside.
MOST = REACH * PIECE
BATCH_BYTES = 1_000_000
# Documents up to which the ids of those with repeated chunks may be broadcast.
SMALL = 1_000_000
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: ``h = 2 h + gear[byte]`` modulo 2**32.

    Summed over the last 8 bytes, by doubling the reach three times.
    """
    h = GEAR[data]
    for shift in (1, 2, 4):
        moved = np.zeros_like(h)
        moved[shift:] = h[:-shift] << np.uint32(shift)
        h = h + moved
    return h


def word_spans(data: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words, or pieces of long ones, start and end."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long = np.flatnonzero(ends - starts > LONG)
    if not len(long):
        return starts, ends
    whole = np.append((data & 0xC0) != 0x80, True)  # places between characters
    marks = np.flatnonzero((h >> np.uint32(32 - PIECE_BITS) == 0) & whole[1:]) + 1
    cuts: list[int] = []
    for begin, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        own = marks[np.searchsorted(marks, begin, "right") : np.searchsorted(marks, end)]
        for at in [*own.tolist(), end]:
            while at - begin > PIECE:
                begin += PIECE
                while not whole[begin]:
                    begin -= 1
                cuts.append(begin)
            if at < end:
                cuts.append(at)
            begin = at
    return np.sort(np.concatenate([starts, cuts])).astype(np.int64), np.sort(np.concatenate([ends, cuts])).astype(np.int64)


def chosen_words(values: np.ndarray) -> np.ndarray:
    """The word that each window of ``REACH`` words chooses: the last of the smallest."""
    if len(values) < REACH:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(values[::-1], REACH)
    return (len(values) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1)))[::-1]


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of one text end."""
    if not len(data):
        return []
    h = rolling(data)
    _, ends = word_spans(data, h)
    own = ends[np.unique(chosen_words(h[ends - 1]))].tolist()
    return own if own and own[-1] == len(data) else [*own, len(data)]


@dataclass(frozen=True)
class Chunks:
    """Chunks of one text that can be in a repeat: the last word before each, its own last
    word, and the first and last word at which the runs that it stands for begin."""

    starts: np.ndarray
    ends: np.ndarray
    border: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray


def chunks_in(data: np.ndarray) -> Chunks:
    h = rolling(data)
    starts, ends = word_spans(data, h)
    chosen = chosen_words(h[ends - 1][LEAD:]) + LEAD
    borders, runs = np.unique(chosen), chosen[: max(len(ends) - LEAST_RUN + 1, 0)]
    border, low, counts = np.unique(runs, return_index=True, return_counts=True)
    last = borders[np.searchsorted(borders, border, "right")] if len(border) else border
    return Chunks(starts, ends, border, last, low, low + counts - 1)


def _plain(docs: DataFrame) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("version"), F.col("text").cast("string").alias("text"))
    return plain.where("text <> '' and doc_id is not null")


def _by_text(texts: DataFrame, schema: str, rows_of: Callable[[np.ndarray, bytes, np.ndarray | None], list[np.ndarray]]) -> DataFrame:
    """Columns that ``rows_of`` makes of each text and its ``ks``, after ``doc_id, version``."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]
    listed = "ks" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, begins = joined_bytes(batch.column("text"))
            whole, parts = data.tobytes(), []
            for i in range(batch.num_rows):
                a, b = int(begins[i]), int(begins[i + 1]) - 1
                parts.append(rows_of(data[a:b], whole[a:b], batch.column("ks")[i].values.to_numpy() if listed else None))
            rows = pa.array(np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts]))
            columns = [batch.column("doc_id").take(rows), batch.column("version").take(rows)]
            columns += [pa.array(np.concatenate(x).astype(t.to_pandas_dtype())) for x, t in zip(zip(*parts, strict=True), kinds[2:], strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    return texts.mapInArrow(run, schema)


def _digests(whole: bytes, starts: np.ndarray, ends: np.ndarray, marks: Iterable[bytes]) -> list[np.ndarray]:
    found = [hashlib.blake2b(whole[u:v], digest_size=16, person=m).digest() for u, v, m in zip(starts.tolist(), ends.tolist(), marks, strict=True)]
    d = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return [np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1])]


def chunks_of(docs: DataFrame) -> DataFrame:
    """``doc_id, version, k, chunk``: the border before every chunk that can be in a repeat,
    and a digest of the chunk with the words around that its runs must hold."""

    def rows_of(data: np.ndarray, whole: bytes, ks: np.ndarray | None) -> list[np.ndarray]:
        c = chunks_in(data)
        if not len(c.border):
            return [c.border, c.border]
        own = span_hashes(data, c.starts[c.border + 1], c.ends[c.last])
        around = span_hashes(data, c.starts[c.border - LEAD], c.ends[c.border + REACH])
        return [c.border, mix(own * BASE + around).view(np.int64)]

    return _by_text(_plain(docs), "doc_id long, version int, k int, chunk long", rows_of)


def extended(texts: DataFrame) -> DataFrame:
    """``doc_id, version, k, start, length, d1, d2``: of ``texts (doc_id, version, text, ks)``
    the chunks after the borders ``ks``, extended to all the runs they stand for, in bytes."""

    def rows_of(data: np.ndarray, whole: bytes, ks: np.ndarray | None) -> list[np.ndarray]:
        c = chunks_in(data)
        at = np.searchsorted(c.border, np.sort(ks))
        a, b = c.starts[c.low[at]], c.ends[c.high[at] + LEAST_RUN - 1]
        # Where in the stretch the border is belongs to it.
        marks = (bytes(x) for x in np.column_stack([c.border[at] - c.low[at], c.high[at] - c.low[at]]).tolist())
        return [c.border[at], a, b - a, *_digests(whole, a, b, marks)]

    return _by_text(texts, "doc_id long, version int, k int, start int, length int, d1 long, d2 long", rows_of)


def runs_of(texts: DataFrame) -> DataFrame:
    """The same columns for each run of ``LEAST_RUN`` words that the chunks stand for."""

    def rows_of(data: np.ndarray, whole: bytes, ks: np.ndarray | None) -> list[np.ndarray]:
        c = chunks_in(data)
        at = np.searchsorted(c.border, np.sort(ks))
        n = c.high[at] - c.low[at] + 1
        first = np.repeat(c.low[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, b = c.starts[first], c.ends[first + LEAST_RUN - 1]
        return [np.repeat(c.border[at], n), a, b - a, *_digests(whole, a, b, repeat(b"", len(a)))]

    return _by_text(texts, "doc_id long, version int, k int, start int, length int, d1 long, d2 long", rows_of)


def _with_borders(docs: DataFrame, borders: DataFrame, label: str) -> DataFrame:
    """``doc_id, version, text, ks`` of the texts that have any of ``borders (doc_id, version, k)``."""
    row = ["doc_id", "version"]
    listed = stored(borders.groupBy(*row).agg(F.collect_set("k").alias("ks")), label)
    touched = _plain(docs).join(if_small(listed.select(*row), SMALL), row, "left_semi")
    return touched.join(listed, row).select(*row, "text", "ks")


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans that overlap put together; they come sorted by start and by end."""
    if not len(starts):
        return []
    new = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return list(zip(starts[np.concatenate([[0], new])].tolist(), ends[np.concatenate([new - 1, [len(ends) - 1]])].tolist(), strict=True))


def _pieces(starts: np.ndarray, lengths: np.ndarray, later: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, bool, int]]:
    """Start, length, removed and first document of the repeated pieces of one text.

    What a first occurrence covers stays; the rest of later ones is removed.
    """
    order = np.argsort(starts, kind="stable")
    starts, later, firsts = starts[order], later[order], firsts[order]
    ends = starts + lengths[order]
    kept = _merged(starts[~later], ends[~later])
    spans, at = [(a, b, False) for a, b in kept], 0
    for a, b in _merged(starts[later], ends[later]):
        while at < len(kept) and kept[at][1] <= a:
            at += 1
        i = at
        while i < len(kept) and kept[i][0] < b:
            if a < kept[i][0]:
                spans.append((a, kept[i][0], True))
            a = max(a, kept[i][1])
            i += 1
        if a < b:
            spans.append((a, b, True))
    out = []
    for a, b, removed in sorted(spans):
        own = slice(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b))
        out.append((a, b - a, removed, int(firsts[own][later[own] == removed].min())))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, version, start, length, removed, first_doc_id``: repeated runs, in bytes.

    Runs of ``LEAST_RUN`` words or more. Where they come first elsewhere they are
    ``removed``; what is itself a first occurrence is listed too, not removed. ``version``
    is the hash of the text the bytes count in.
    """
    row = ["doc_id", "version"]
    chunks = stored(chunks_of(docs), "chunks")
    # Map-side aggregation holds a digest once per task, so a hot chunk is no hot key. Stored,
    # so that both sides of the join are dealt anew and Spark can split a hot chunk.
    twice = stored(chunks.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk"), "repeated-chunks")
    hits = stored(chunks.join(twice, "chunk"), "chunk-hits")
    longer = stored(extended(_with_borders(docs, hits, "chunk-borders")), "extended-chunks")

    one, place = F.struct("doc_id", "version", "start"), F.struct("doc_id", "version", "start", "k")
    classes = stored(longer.groupBy("d1", "d2").agg(F.min(place).alias("first"), (F.count("*") > 1).alias("many")), "chunk-classes")
    # Classes whose chunk others share too: their runs may come there.
    own = classes.select("many", F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version"), F.col("first.k").alias("k"))
    chunk = hits.select(*row, "k", "chunk").distinct()
    own = stored(own.join(chunk, [*row, "k"]), "class-chunks")
    shared = stored(own.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk"), "shared-chunks")
    open_ = stored(own.join(shared, "chunk").select(*row, "k", "many"), "open-classes")
    runs = stored(runs_of(_with_borders(docs, open_, "open-borders")).join(open_, [*row, "k"]), "word-runs")
    seen = runs.groupBy("d1", "d2").agg(F.min(one).alias("first"), F.count("*").alias("n"), F.max("many").alias("many"))
    seen = stored(seen.where("n > 1 or many").select("d1", "d2", "first"), "repeated-runs")
    single = runs.join(seen, ["d1", "d2"]).select(*row, "k", "start", "length", (one != F.col("first")).alias("later"), F.col("first.doc_id").alias("first_doc_id"))
    single = stored(single, "run-spans")

    # Of a class all but the first are later; the first stays unless its runs were judged alone.
    judged = single.groupBy(F.struct(*row, "k").alias("head")).agg(F.min("first_doc_id").alias("earliest"))
    member = longer.join(classes.where("many").select("d1", "d2", "first"), ["d1", "d2"])
    member = member.withColumn("later", one != F.struct("first.doc_id", "first.version", "first.start"))
    member = member.withColumn("head", F.struct("first.doc_id", "first.version", "first.k")).join(stored(judged, "judged"), "head", "left")
    found = member.where("later or earliest is null").select(*row, "start", "length", "later", F.coalesce("earliest", "first.doc_id").alias("first_doc_id"))
    found = found.unionByName(single.drop("k"))
    # Rows equal in id and text give the same spans twice.
    listed = found.groupBy(*row).agg(F.collect_set(F.struct("start", "length", "later", "first_doc_id")).alias("runs"))
    schema = "doc_id long, version int, start long, length long, removed boolean, first_doc_id long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, version, own in zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), batch.column("runs"), strict=True):
                parts = (x.to_numpy(zero_copy_only=False) for x in own.values.flatten())
                out += [(doc, version, *x) for x in _pieces(*parts)]
            fields = [f.split() for f in schema.split(", ")]
            types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], types[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return listed.mapInArrow(pieces, schema)


def _without(text: str, starts: np.ndarray, lengths: np.ndarray) -> str:
    """The text without byte spans; a line feed parts what would run together."""
    data, at, out = text.encode(), 0, ""
    for start, length in [*sorted(zip(starts.tolist(), lengths.tolist(), strict=True)), (len(data), 0)]:
        part = data[at:start].decode()
        gap = out and part and not out[-1].isspace() and not part[0].isspace()
        out += "\n" * bool(gap) + part
        at = start + length
    return out


def remove_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents without removed spans; columns as they came, ``n_chars`` renewed.

    Texts without spans are not touched.
    """
    cuts = spans.where("removed").groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "length")).alias("cuts"))
    cuts = stored(cuts.select("doc_id", "version", F.col("cuts.start").alias("starts"), F.col("cuts.length").alias("lengths")), "cuts")

    def cut(texts: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), starts, lengths, strict=True)
        return pa.array([t if t is None or not s.is_valid else _without(t, s.values.to_numpy(), n.values.to_numpy()) for t, s, n in rows], pa.string())

    row = docs.select(F.struct(*docs.columns).alias("row"))
    same = (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.hash("row.text") == F.col("version"))
    touched = row.join(cuts, same, "left").withColumn("cut", F.arrow_udf(cut, "string")("row.text", "starts", "lengths"))
    found = F.col("starts").isNotNull()
    new = {"text": F.when(found, F.col("cut")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(found, F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return touched.select([new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
