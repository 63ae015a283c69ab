"""Packing documents into fixed windows: repeat counts of length combinations by NNLS.

1. Every document is encoded once; its full windows stand alone, what is left over (its
   *tail*, shorter than the window) is one of ``window - 1`` lengths.
2. Combinations of one to three tail lengths that fill a window exactly are enumerated.
   Non-negative least squares fits how often to use each to the histogram of tails.
3. Counts are rounded down; a greedy pass over the histogram fills more windows exactly;
   what then remains is laid end to end and cut at window borders.

The histogram, the combinations and the plan are bounded by the window, whatever the
number of documents. Each tail finds its place from its length and its rank among the
tails of that length, so no task sees a whole length. Only the very last window can hold
padding; none is added where its length is a power of two.

* Null or empty text: the end id alone. Very long texts: many full windows and a tail.
* Repeated rows and ids: each row is packed on its own. Empty table: no rows.
* Columns other than ``doc_id`` and ``text`` are ignored. Null document ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placebook.llm.common import if_small, stored, text_or_empty, within_arrow
from placebook.llm.token_store import BATCH_BYTES, END_ID, crc32, id_lists
from placebook.llm.tokens import default_tokenizer, encoder

WINDOW = 1024
STEPS = 400
# One row per full window and one per tail; ``k`` counts a document's full windows.
ENCODED = "doc_id long, block int, k int, n_tokens long, tail int, rank long, ids array<int>"
PLACED = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Rows of the table of ranks by task up to which it may be broadcast.
SMALL = 1_000_000


@dataclass(frozen=True)
class Plan:
    """Where the tail of a given length and rank goes.

    Slots of length ``r`` are ``first[r]:first[r + 1]``; ``until`` counts the tails of that
    length up to and with a slot. ``base`` is the slot's first sequence, ``offset`` its
    place there. Ranks past ``room[r]`` go to the stream, which begins at ``stream[r]``.
    """

    window: int
    first: np.ndarray
    until: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    room: np.ndarray
    stream: np.ndarray
    n_sequences: int
    n_streamed: int


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """All one to three lengths out of ``present`` that fill ``window``; zero pads a row."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    longest = present[has[window - present]]
    longest = longest[2 * longest >= window]
    pairs = np.stack([longest, window - longest, np.zeros_like(longest)], axis=1)
    a, b = (x.ravel() for x in np.meshgrid(present, present, indexing="ij"))
    c = window - a - b
    keep = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[keep], b[keep], c[keep]
    keep = has[c]
    return np.concatenate([pairs, np.stack([a[keep], b[keep], c[keep]], axis=1)]).astype(np.int64)


def non_negative_least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts ``x >= 0`` that bring the used lengths near the histogram.

    Accelerated projected gradient; the matrix stays a list of row numbers.
    """
    n, used = len(combos), combos > 0
    use = lambda x: np.bincount(combos[used], np.repeat(x, used.sum(axis=1)), len(histogram))
    back = lambda r: np.where(used, r[combos], 0).sum(axis=1)
    v = np.ones(n)
    for _ in range(20):  # largest eigenvalue, for the step
        v = back(use(v))
        v /= np.linalg.norm(v)
    rate = 1 / max(np.linalg.norm(back(use(v))) * 1.05, 1e-9)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        z = np.maximum(y - rate * back(use(y) - histogram), 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = z + (before - 1) / t * (z - x), z
    return x


def plan_windows(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Combine tails given how many there are of each length (index: length)."""
    left = histogram.astype(np.int64).copy()
    rows: list[tuple[tuple[int, ...], int]] = []

    def take(combo: list[int], times: int) -> None:
        need = np.bincount(combo, minlength=window + 1)
        times = min(times, int((left[need > 0] // need[need > 0]).min()))
        if times > 0:
            left[: window + 1] -= times * need
            rows.append((tuple(combo), times))

    present = np.flatnonzero(left)
    if len(present) and len(combos := combinations(present, window)):
        counts = non_negative_least_squares(combos, left.astype(float))
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] < 1:
                break
            take([int(v) for v in combos[i] if v], int(counts[i]))
    for longest in range(window - 1, 0, -1):
        while left[longest] > 0:
            combo, gap, free = [longest], window - longest, left.copy()
            free[longest] -= 1
            while gap and len(fit := np.flatnonzero(free[1 : gap + 1])):
                combo.append(int(fit[-1]) + 1)
                free[combo[-1]] -= 1
                gap -= combo[-1]
            if gap:
                break
            take(combo, int(left[longest]))
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]
    base = 0
    for combo, times in rows:
        at = 0
        for v in combo:
            slots[v].append((times, base, at))
            at += v
        base += times
    flat = [s for own in slots for s in own]
    counted = [np.cumsum([s[0] for s in own]) for own in slots]
    lengths = np.arange(window + 1)
    return Plan(
        window,
        np.cumsum([0, *map(len, slots)]),
        np.concatenate([*counted, np.zeros(0)]).astype(np.int64),
        np.array([s[1] for s in flat], np.int64),
        np.array([s[2] for s in flat], np.int64),
        np.array([c[-1] if len(c) else 0 for c in counted], np.int64),
        np.cumsum(left * lengths) - left * lengths,
        base,
        int((left * lengths).sum()),
    )


def place(plan: Plan, length: int, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row numbers, starts, lengths, sequences and offsets of the pieces of tails of one length."""
    rows = np.arange(len(ranks))
    inside = ranks < plan.room[length]
    begin, end = plan.first[length], plan.first[length + 1]
    slot = begin + np.searchsorted(plan.until[begin:end], ranks[inside], side="right")
    earlier = np.where(slot > begin, plan.until[slot - 1], 0) if len(slot) else slot
    parts = [(rows[inside], np.zeros(len(slot), np.int64), np.full(len(slot), length), plan.base[slot] + ranks[inside] - earlier, plan.offset[slot])]
    at = plan.stream[length] + (ranks[~inside] - plan.room[length]) * length
    offset = at % plan.window
    head = np.minimum(plan.window - offset, length)
    sequence = plan.n_sequences + at // plan.window
    parts.append((rows[~inside], np.zeros(len(at), np.int64), head, sequence, offset))
    cut = head < length
    parts.append((rows[~inside][cut], head[cut], length - head[cut], sequence[cut] + 1, np.zeros(cut.sum(), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _encode(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """Full windows and tails; ``rank`` counts, within a task, full windows (``tail`` 0)
    or tails of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block = encoder(tokenizer).encode_all, TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            every, sizes = encode(batch.column("text"), end_id)
            n = -(-sizes // window)
            row = np.repeat(np.arange(len(sizes)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lengths = np.minimum(sizes[row] - k * window, window)
            tails = lengths % window
            order = np.argsort(tails, kind="stable")
            ordered = tails[order]
            ranks = np.empty(len(row), np.int64)
            ranks[order] = seen[ordered] + np.arange(len(row)) - np.searchsorted(ordered, ordered)
            seen[:] += np.bincount(tails, minlength=window)
            ids = id_lists(every, lengths)
            columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (np.full(len(row), block, np.int32), k.astype(np.int32), sizes[row], tails.astype(np.int32), ranks)), ids]
            return pa.RecordBatch.from_arrays(columns, _names(ENCODED))

        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, ENCODED)


def _placed(batch: pa.RecordBatch, plan: Plan, full_from: int) -> pa.RecordBatch:
    """The pieces of a batch of full windows and tails, with their places."""
    tails, ranks = batch.column("tail").to_numpy(), batch.column("rank").to_numpy()
    parts = []
    for v in np.unique(tails):
        own = np.flatnonzero(tails == v)
        if v:
            at, *rest = place(plan, int(v), ranks[own])
        else:
            zeros = np.zeros(len(own), np.int64)
            at, rest = np.arange(len(own)), [zeros, zeros + plan.window, full_from + ranks[own], zeros]
        parts.append((own[at], *rest))
    at, start, length, sequence, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids = batch.column("ids")
    begin, total = ids.offsets.to_numpy()[at] + start, np.cumsum(length)
    chosen = np.repeat(begin - (total - length), length) + np.arange(total[-1] if len(total) else 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], total]), pa.int32()), ids.values.take(pa.array(chosen)))
    take = lambda c: batch.column(c).take(pa.array(at))
    in_doc = take("k").to_numpy().astype(np.int64) * plan.window + start
    columns = [take("doc_id"), pa.array(in_doc), pa.array(length.astype(np.int64)), lists, crc32(lists), take("n_tokens"), pa.array(sequence), pa.array(offset)]
    return pa.RecordBatch.from_arrays(columns, _names(PLACED))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``: one row
    per piece; the checksum is of its ids as little-endian 32-bit integers.

    Ids are written once and, while the ranks by task are few enough to broadcast, are
    not shuffled at all.
    """
    rows = stored(_encode(docs, tokenizer or default_tokenizer(), window, end_id), "packed-tokens")
    counts = stored(rows.groupBy("block", "tail").agg(F.count("*").alias("n")), "tail-counts")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.where("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect():  # below window rows
        histogram[r["tail"]] = r["n"]
    plan = plan_windows(histogram, window)
    full_from = plan.n_sequences + -(-plan.n_streamed // window)
    earlier = Window.partitionBy("tail").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("block", "tail", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("before"))
    ranked = rows.join(if_small(before, SMALL), ["block", "tail"]).withColumn("rank", F.col("rank") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                yield _placed(batch.slice(i, 2000), plan, full_from)

    return ranked.select("doc_id", "k", "n_tokens", "tail", "rank", "ids").mapInArrow(run, PLACED)


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """The pieces without their ids."""
    return pack(docs, tokenizer, window).drop("ids")
