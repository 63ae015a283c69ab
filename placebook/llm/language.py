"""Language by n-gram filters that answer for all languages at once.

Every language has the set of four-byte grams that are frequent in its texts. One Bloom
filter holds all sets bit-sliced: each slot is a bitmask of languages, and the masks at a
gram's slots, and-ed, are the languages that contain it. The bits of all grams of a text
are counted per language, corrected for the false positives that the language's share of
set bits makes expected, and the largest count decides.

Grams are of lower-case text with everything but letters turned to blanks. A gram belongs
to a language when it makes up at least ``LEAST_SHARE`` of its grams and ``OF_BEST`` of
the largest share in any language; so no set exceeds ``1 / LEAST_SHARE`` grams, and the
filter's size is fixed by its parameters, whatever the size of the corpus.

* Null text or text without a letter: ``und``, score 0. A text with letters but too short
  for a gram, or nothing learned from its grams: the most frequent language, score 0.
* Ties: the language that comes first by name. No labelled rows at all: ``und``.
* Null ids, repeated rows: judged like any row. Empty table: no rows. Other columns than
  those asked for are ignored. Very long texts: counted in pieces of a task's batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.arrays import joined_bytes, mix
from placebook.llm.common import stored, within_arrow
from placebook.llm.grams import BATCH_BYTES, four_grams, gram_counts

LEAST_SHARE = 2e-5
OF_BEST = 0.1
SLOT_BITS = 20
# Share of grams below which a text is in none of the learned languages.
LEAST_SCORE = 0.3
PROBES = 4
UNKNOWN = "und"


def _letters_only() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint8)
    letters = (codes >= 128) | ((codes >= ord("a")) & (codes <= ord("z")))
    return np.where(letters, codes, 32).astype(np.uint8)


FOLD = _letters_only()


def text_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte grams of the texts, blank at both ends, and their borders."""
    data, begins = joined_bytes(pc.utf8_lower(texts), " ")
    return four_grams(FOLD[data], begins, 8)


@dataclass(frozen=True)
class Filters:
    """``slots[i]``: languages, one bit each, in 64-bit words. ``wrong``: false positive rates."""

    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray
    usual: str


def _probes(keys: np.ndarray) -> list[np.ndarray]:
    h = mix(keys.astype(np.uint64) + np.uint64(1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    low = np.uint64((1 << SLOT_BITS) - 1)
    return [((h + np.uint64(i) * step) & low).astype(np.int64) for i in range(PROBES)]


def build_filters(sets: dict[str, np.ndarray], usual: str) -> Filters:
    languages = sorted(sets)
    slots = np.zeros((1 << SLOT_BITS, -(-len(languages) // 64)), np.uint64)
    for i, name in enumerate(languages):
        for at in _probes(sets[name]):
            slots[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    filled = [((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))]
    return Filters(languages, slots, np.asarray(filled) ** PROBES, usual)


def learn(labelled: DataFrame, least_share: float = LEAST_SHARE, of_best: float = OF_BEST) -> Filters | None:
    """Filters from ``labelled (lang, text)``; all of its texts are counted."""
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").alias("grp"), "text")
    counts = stored(gram_counts(rows, text_grams), "language-grams").where(F.col("key") != 0x20202020)
    totals = counts.groupBy("grp").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "grp").select("grp", "key", (F.col("n") / F.col("total")).alias("share"))
    best = shares.groupBy("key").agg(F.max("share").alias("best"))
    frequent = shares.where(F.col("share") >= least_share).join(best, "key").where(F.col("share") >= of_best * F.col("best"))
    found = frequent.select("grp", "key").toPandas()  # at most 1 / least_share rows a language
    usual = totals.orderBy(F.desc("total"), "grp").first()
    if usual is None:
        return None
    sets = {name: keys.to_numpy(np.int64) for name, keys in found.groupby("grp")["key"]}
    return build_filters(sets, usual["grp"]) if sets else None


def judge(texts: pa.Array, has_letter: np.ndarray, filters: Filters | None) -> tuple[list[str], np.ndarray]:
    """The language of each text and its corrected share of grams."""
    if filters is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    keys, borders = text_grams(texts)
    known = keys != np.uint32(0x20202020)
    ends = np.concatenate([[0], np.cumsum(known)])[borders]
    keys = keys[known]
    masks = None
    for at in _probes(keys):
        masks = filters.slots[at] if masks is None else masks & filters.slots[at]
    n = np.diff(ends)
    shares = np.zeros((len(filters.languages), len(texts)))
    for i, wrong in enumerate(filters.wrong):
        bits = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
        hits = np.concatenate([[0], np.cumsum(bits)])
        share = (hits[ends[1:]] - hits[ends[:-1]]) / np.maximum(n, 1)
        shares[i] = np.clip((share - wrong) / max(1 - wrong, 1e-9), 0, 1)
    best = shares.argmax(axis=0)
    score = np.where(has_letter, shares.max(axis=0), 0)
    names = [
        UNKNOWN if not letter else filters.languages[b] if s > 0 else filters.usual
        for letter, b, s in zip(has_letter, best, score, strict=True)
    ]
    return names, score


def predict(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # its size is a parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            letter = batch.column("has_letter").to_numpy(zero_copy_only=False)
            names, score = judge(batch.column("text"), letter, shared.value)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def known(docs: DataFrame, filters: Filters | None, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows, as they came, whose text is in a learned language with a score of
    ``least_score`` or more. Judged where they lie: nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def score(texts: pa.Array, letters: pa.Array) -> pa.Array:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            names, found = judge(batch.column("text"), letter, shared.value)
            return pa.RecordBatch.from_arrays([pa.array(np.where(np.asarray(names) == UNKNOWN, -1.0, found))], ["score"])

        rows = pa.RecordBatch.from_arrays([texts, letters], ["text", "letter"])
        parts = [b.column(0) for b in within_arrow([rows], make, "text", BATCH_BYTES)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

    text = F.col("text").cast("string")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return docs.where(F.arrow_udf(score, "double")(text, letter) >= least_score)


def held_out():
    """Every fourth document by checksum of its id is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn_from(docs: DataFrame) -> Filters | None:
    return learn(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("lang", F.col("text").cast("string").alias("text")))


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the rows not held out."""
    return predict(docs, learn_from(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
