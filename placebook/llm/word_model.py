"""Log probabilities of texts by the words that follow each other in all other texts.

Pairs of neighbours, and words that something follows, are hashes, grouped by the task that
reads a text into blocks of texts of one language. A block sends each range of hashes its
sorted hashes and, for each, the texts that hold it and how often. The task of a range adds
the counts of all blocks, takes each text's own off, and gives back one sum for each text of
a block. These are whole numbers of ``1 / UNIT``, so their order does not matter.

Hashes have 14 bits more than the number of words needs, 47 at most: one pair of 16,000
shares its hash with another, on average. All arrays travel as compressed planes of bytes:
differences of sorted hashes, and of the texts of a hash, are some two bytes each. A task
holds one range (some ``RANGE_WORDS`` entries, however frequent a word: an entry is a text,
not an occurrence) and sums of up to ``HELD_TEXTS`` texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.arrays import BASE, Words, joined_bytes, mix
from placebook.llm.common import within_arrow
from placebook.llm.grams import BATCH_BYTES

STRENGTH = 1.0
UNIT = 1 << 12
# Memory bounds only: pairs and words of a block and of a range, texts of a block (their
# numbers have 16 bits) and of the sums that a task holds.
BLOCK_WORDS = 10_000_000
RANGE_WORDS = 1_500_000
BLOCK_TEXTS = 1 << 16
HELD_TEXTS = 16_000_000
RANGES_PER_TASK = 64
TEXT_BITS, KEY_BITS = 16, 47
PARTS = "part int, block long, lang string, n_texts int, n_keys int, n_entries int, keys binary, holders binary, texts binary, times binary"


def pack(values: np.ndarray) -> bytes:
    """Planes of bytes, compressed: the upper planes of small numbers take next to nothing."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T), codec="zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind)[:, 0]


def word_totals(rows: DataFrame) -> dict[str, int]:
    """Words of each language of ``rows (lang, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, begins = joined_bytes(batch.column("text"))
            inside = (data != 32) & ((data < 9) | (data > 13))
            starts = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0) == 1)
            n = np.diff(np.searchsorted(starts, begins))
            return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n, pa.int64())], ["lang", "n"])

        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    return {r.lang: r.n for r in rows.select("lang", "text").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).collect()}


def entries(words: Words, lang: str, first: int, bits: int) -> np.ndarray:
    """For each word of each text, its pair with the word before and that word: a bit that
    tells which, a hash and the number of the text, from ``first``, in one integer.

    A text begins after a mark of its own.
    """
    salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    before = np.empty_like(words.hashes)
    before[1:] = words.hashes[:-1]
    before[words.first[:-1][words.counts > 0]] = mix(np.ones(1, np.uint64))[0]
    left = mix(before ^ salt)
    texts = np.repeat(np.arange(first, first + len(words.counts), dtype=np.uint64), words.counts)
    down, up, kind = np.uint64(64 - bits), np.uint64(TEXT_BITS), np.uint64(1 << bits)
    pairs = mix(left * BASE + words.hashes) >> down
    return np.concatenate([(pairs << up) | texts, ((left >> down | kind) << up) | texts])


def dealt(block: int, lang: str, n_texts: int, found: np.ndarray, shift: int) -> Iterator[list]:
    """Rows of ``PARTS``, one for each range that a block's entries fall into."""
    if not len(found):
        return
    found.sort()
    at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    times = np.diff(np.append(at, len(found))).astype(np.uint32)
    found = found[at]
    keys, texts = found >> np.uint64(TEXT_BITS), found.astype(np.uint16)
    parts = range(int(keys[0]) >> shift, (int(keys[-1]) >> shift) + 1)
    cuts = [*np.searchsorted(keys, np.array([p << shift for p in parts], np.uint64)).tolist(), len(keys)]
    for part, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        own, held = keys[a:b], texts[a:b]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        steps = np.diff(own[new], prepend=np.uint64(0))
        holders = np.diff(np.append(new, b - a)).astype(np.uint32)
        ahead = np.diff(held, prepend=held[:1])
        ahead[new] = held[new]
        yield [part, block, lang, n_texts, len(new), b - a, pack(steps), pack(holders), pack(ahead), pack(times[a:b])]


def sums_of(parts: list[dict], totals: dict[str, int], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each block with entries in a range, what the range adds to its texts."""
    keys = [np.cumsum(unpack(p["keys"], np.uint64, p["n_keys"])) for p in parts]
    holders = [unpack(p["holders"], np.uint32, p["n_keys"]) for p in parts]
    times = [unpack(p["times"], np.uint32, p["n_entries"]) for p in parts]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    own = [np.add.reduceat(t, np.cumsum(h, dtype=np.int64) - h, dtype=np.int64) for t, h in zip(times, holders, strict=True)]
    counts = np.bincount(at, np.concatenate(own), len(every))
    begin = 0
    for p, k, h, t in zip(parts, keys, holders, times, strict=True):
        others = np.repeat(counts[at[begin : begin + len(k)]], h) - t
        word = np.repeat(k >> np.uint64(bits) != 0, h)
        begin += len(k)
        logs = np.log(others + np.where(word, STRENGTH, STRENGTH / totals[p["lang"]]))
        value = np.rint(np.where(word, -logs, logs) * UNIT).astype(np.int64) * t
        ahead = unpack(p["texts"], np.uint16, p["n_entries"]).astype(np.int64)
        new = np.cumsum(h, dtype=np.int64) - h
        texts = np.cumsum(ahead)
        texts -= np.repeat(texts[new] - ahead[new], h)
        # Whole numbers far under 2**53: exact as floats.
        yield p["block"], np.bincount(texts, value, p["n_texts"]).astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[list[dict]]:
    """Rows that share a value of ``name`` and come one after the other."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if held and held[0][name] != row[name]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def with_logs(rows: DataFrame, judge: Callable[[pa.RecordBatch, str], tuple[pa.RecordBatch, Words]], schema: str) -> DataFrame:
    """What ``judge`` makes of all ``rows`` (``schema``) and ``word_log``, the log probability of
    each text. ``judge`` takes rows of one language and also returns their words."""
    totals = word_totals(rows)
    n = sum(totals.values())
    bits = min(n.bit_length() + 14, KEY_BITS)
    split = (2 * n // RANGE_WORDS).bit_length()
    shift, shared = bits + 1 - split, rows.sparkSession.sparkContext.broadcast(totals)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = min(1 << split, max(2 * cores, (1 << split) // RANGES_PER_TASK))
    sums = "block long, n_texts int, rows binary, sums binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By language: judged rows, their number, and entries by batch.
        held: dict[str, list] = {}
        task, made, full = TaskContext.get().partitionId(), 0, set()

        def out(name: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            judged, n_texts, arrays = held.pop(name)
            block = (task << 32) + made
            made += 1
            table = pa.Table.from_batches(judged)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            # Negative parts only pass by; they are spread over all tasks.
            parts = [[-1 - (block * 31 + made) % 100_003, block, name, n_texts, 0, 0, sink.getvalue().to_pybytes(), b"", b"", b""]]
            found = np.concatenate(arrays)
            arrays.clear()
            parts += dealt(block, name, n_texts, found, shift)
            kinds = [pa.int32(), pa.int64(), pa.string(), *[pa.int32()] * 3, *[pa.binary()] * 4]
            names = [x.split()[0] for x in PARTS.split(", ")]
            for at in range(0, len(parts), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts[at : at + 500], strict=True), kinds, strict=True)], names)

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for name in set(langs.tolist()):
                part = batch.take(pa.array(np.flatnonzero(langs == name)))
                for at in range(0, part.num_rows, BLOCK_TEXTS // 2):
                    judged, words = judge(part.slice(at, BLOCK_TEXTS // 2), name)
                    if name in held and held[name][1] + judged.num_rows > BLOCK_TEXTS:
                        ready.extend(out(name))
                    own = held.setdefault(name, [[], 0, []])
                    own[2].append(entries(words, name, own[1], bits))
                    own[0].append(judged)
                    own[1] += judged.num_rows
            if sum(len(x) for own in held.values() for x in own[2]) > BLOCK_WORDS:
                full.update(held)
            return batch.slice(0, 0)

        ready: list[pa.RecordBatch] = []
        for _ in within_arrow(batches, make, "text", BATCH_BYTES):
            yield from ready
            ready.clear()
            for name in full:
                yield from out(name)
            full.clear()
        yield from ready
        for name in list(held):
            yield from out(name)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def row(block: int, n_texts: int, rows: bytes, packed: bytes) -> pa.RecordBatch:
            kinds = {"block": pa.int64(), "n_texts": pa.int32(), "rows": pa.binary(), "sums": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((block, n_texts, rows, packed), kinds.values(), strict=True)], list(kinds))

        for parts in runs(batches, "part"):
            if parts[0]["part"] < 0:
                yield from (row(p["block"], p["n_texts"], p["keys"], b"") for p in parts)
                continue
            for block, own in sums_of(parts, shared.value, bits):
                held[block] = held[block] + own if block in held else own
            if sum(map(len, held.values())) > HELD_TEXTS:
                yield from (row(b, len(x), b"", pack(x)) for b, x in held.items())
                held.clear()
        yield from (row(b, len(x), b"", pack(x)) for b, x in held.items())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in runs(batches, "block"):
            total = np.zeros(own[0]["n_texts"], np.int64)
            for x in own:
                if x["sums"]:
                    total += unpack(x["sums"], np.int64, x["n_texts"])
            judged = next(pa.ipc.open_stream(x["rows"]).read_all() for x in own if x["rows"])
            yield from judged.append_column("word_log", pa.array(total / UNIT)).combine_chunks().to_batches()

    sent = rows.mapInArrow(send, PARTS).repartition(tasks, "part").sortWithinPartitions("part", "block")
    summed = sent.mapInArrow(add, sums).repartition("block").sortWithinPartitions("block")
    return summed.mapInArrow(finish, schema + ", word_log double")
