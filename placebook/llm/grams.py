"""Counting four-grams of a small alphabet per group, map side first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.common import within_arrow

SIZE = 4
BATCH_BYTES = 1_500_000
# Distinct keys a task holds before it hands them on; a memory bound only.
HELD = 1_500_000


def four_grams(codes: np.ndarray, begins: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of four codes inside a text, and the texts' borders in them."""
    n = np.maximum(np.diff(begins) - SIZE + 1, 0)
    wide = codes.astype(np.uint32)
    keys = np.zeros(max(len(codes) - SIZE + 1, 0), np.uint32)
    for i in range(SIZE):
        keys = (keys << np.uint32(bits)) | wide[i : len(codes) - SIZE + 1 + i]
    inside = np.ones(len(codes) + 1, bool)
    for i in range(1, SIZE):  # starts too near a text's end
        inside[np.maximum(begins[1:] - i, begins[:-1])] = False
    return keys[inside[: len(keys)]], np.concatenate([[0], np.cumsum(n)])


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)


def gram_counts(rows: DataFrame, grams: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``grp, key, n`` over all of ``rows (grp, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, (keys, counts) in held.items():
                k, n = merged(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n)], ["grp", "key", "n"])

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal size
            owners = np.asarray(batch.column("grp").to_pylist(), object)
            for name in set(owners.tolist()):
                own = batch.column("text").take(pa.array(np.flatnonzero(owners == name)))
                keys, counts = np.unique(grams(own)[0], return_counts=True)
                lists = held.setdefault(name, ([], []))
                lists[0].append(keys)
                lists[1].append(counts)
                size += len(keys)
            if size > HELD:
                for name, (keys, counts) in held.items():
                    k, n = merged(keys, counts)
                    held[name] = ([k], [n])
                size = sum(len(k[0]) for k, _ in held.values())
            return batch.slice(0, 0)

        for _ in within_arrow(batches, make, "text", BATCH_BYTES):
            if size > HELD:  # even merged
                yield from out()
                held.clear()
                size = 0
        yield from out()

    return rows.select("grp", "text").mapInArrow(run, "grp string, key long, n long").groupBy("grp", "key").agg(F.sum("n").alias("n"))
