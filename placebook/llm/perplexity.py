"""Quality by two perplexities of each language: of words and of their spelling.

The model of words (``word_model``) grows with the corpus. A word ``w`` after ``v`` has the
probability ``(c(v, w) + STRENGTH / N) / (c(v) + STRENGTH)``, ``N`` the words of the language,
counts taken over all texts but the one that is judged: a text does not vouch for itself.
Every pair of neighbours of every text counts. Both counts lie with different tasks, and a
text's log probability is the sum of what these tasks say of its pairs and of its words.

The model of spelling is a modified Kneser-Ney model over an alphabet of 64 symbol classes:
letters, blank, digit, groups of signs and of the bytes of other characters. Spark counts
the four-grams of all texts of a language; raw counts serve the highest order, continuation
counts the lower ones. Keys and probabilities of each order lie in sorted arrays that a task
searches. With 64 classes an order has at most 64**4 keys (64 MB of keys), whatever the size
of the corpus.

A document is rejected when its mean log probability by symbol leaves its language's band:
the median over all documents that pass the base rules, plus and minus ``WIDTH`` robust
deviations. The deviation is the larger of the usual one between documents and the one a
text of its length has by chance. It is also rejected when its mean log probability by word
lies more than ``WORD_WIDTH`` deviations below its language's lower quartile: its words do
not follow each other as they do elsewhere. That deviation is taken from the texts below the
quartile only, and nothing is rejected for words that are all too expected: these are
copies, which are no fault of this kind and, however many, do not narrow the band.

* Null text: no words; every count 0, base rules fail. Empty text likewise.
* Null language: a language of its own. A language without documents that pass the base
  rules has no band and rejects none.
* Repeated rows, null ids: judged like any row. Empty table: no rows. Other columns are
  ignored. Very long texts: memory follows the longest text of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm import word_model
from placebook.llm.arrays import Words, joined_bytes, shingles_of, words_of
from placebook.llm.common import if_small, stored, within_arrow
from placebook.llm.grams import BATCH_BYTES, four_grams, gram_counts

BITS = 6
ORDER = 4
WIDTH = 8.0
WORD_WIDTH = 3.0
LEAST_WORDS = 50
# Languages up to which the table of bands may be broadcast.
LANGUAGES = 100_000
SYMBOLS = b"#*$%&|<>"


def symbol_classes() -> np.ndarray:
    """Class of each byte: 0 blank, 1-26 letters, 27 digit, 28-35 signs, 36-51 inner
    bytes and 52-63 first bytes of longer characters."""
    out = np.zeros(256, np.uint8)
    for b in range(33, 128):
        c = chr(b).lower()
        out[b] = ord(c) - 96 if c.isalpha() else 27 if c.isdigit() else 28 + b % 8
    out[128:192] = 36 + np.arange(64) % 16
    out[192:] = 52 + np.arange(64) % 12
    return out


CLASSES = symbol_classes()


def text_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Four-gram keys of the texts, three blanks before each, and their borders."""
    data, begins = joined_bytes(texts, "   ")
    return four_grams(CLASSES[data], begins, BITS)


@dataclass(frozen=True)
class Model:
    """Sorted keys, log probabilities, and log weights of what follows a context, by order."""

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts of 1, 2, and 3 or more, from the counts of counts."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(float)
    if (n == 0).any():
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
    return np.array([0.0, *np.clip(d, [0.05, 0.05, 0.05], [0.95, 1.95, 2.95])])


def estimate(keys: np.ndarray, counts: np.ndarray) -> Model:
    """Interpolated modified Kneser-Ney from sorted four-gram keys and their counts."""
    levels = [(keys.astype(np.int64), counts.astype(np.int64))]
    for order in range(ORDER - 1, 0, -1):
        suffix = levels[0][0] & ((1 << BITS * order) - 1)
        levels.insert(0, np.unique(suffix, return_counts=True))
    lower, lower_keys = np.full(1, 1 / (1 << BITS)), np.zeros(1, np.int64)
    model = Model([], [], [], [])
    for key, count in levels:
        d = _discounts(count)[np.minimum(count, 3)]
        context, at = np.unique(key >> BITS, return_inverse=True)
        total = np.bincount(at, count, len(context))
        weight = np.bincount(at, d, len(context)) / total
        below = lower[np.searchsorted(lower_keys, key & ((1 << BITS * len(model.keys)) - 1))]  # without the first symbol
        p = (count - d) / total[at] + weight[at] * below
        model.keys.append(key.astype(np.uint32))
        model.logs.append(np.log(p).astype(np.float32))
        model.contexts.append(context.astype(np.uint32))
        model.weights.append(np.log(weight).astype(np.float32))
        lower, lower_keys = p, key
    return model


def log_probabilities(model: Model, keys: np.ndarray) -> np.ndarray:
    """Log probability of the last symbol of each four-gram after the first three."""
    out = np.zeros(len(keys), np.float32)
    rest = np.arange(len(keys))
    for order in range(ORDER, 0, -1):
        own, logs = model.keys[order - 1], model.logs[order - 1]
        key = keys[rest] & np.uint32((1 << BITS * order) - 1)
        at = np.minimum(np.searchsorted(own, key), len(own) - 1)
        hit = own[at] == key
        out[rest[hit]] += logs[at[hit]]
        rest, key = rest[~hit], key[~hit]
        if not len(rest):
            return out
        context = key >> np.uint32(BITS)
        at = np.minimum(np.searchsorted(model.contexts[order - 1], context), len(model.contexts[order - 1]) - 1)
        seen = model.contexts[order - 1][at] == context
        out[rest[seen]] += model.weights[order - 1][at[seen]]
    out[rest] -= np.float32(BITS * np.log(2))
    return out


def text_counts(words: Words) -> dict[str, np.ndarray]:
    """Words, their characters, symbols, repeated lines and repeated words of each text."""
    begins, n = words.begins, len(words.counts)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[begins])
    data = words.data
    first_bytes = (data & 0xC0) != 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    # Lines with a word that equal an earlier one, by exact bytes.
    whole, dup = data.tobytes(), np.zeros(n, np.int64)
    for i in range(n):
        lines = whole[begins[i] : begins[i + 1] - 1].split(b"\n")
        if len(lines) > 1:
            spoken = [x for x in lines if x and x.strip(b" \t\n\x0b\x0c\r")]
            dup[i] = len(spoken) - len(set(spoken))
    keys, borders = shingles_of(words, 3)
    owner = np.repeat(np.arange(n), np.diff(borders))
    has_three = words.counts >= 3
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= has_three[owner] if len(owner) else False
    covered = np.zeros(len(words.hashes) + 1, bool)
    at = np.flatnonzero(twice)
    at = words.first[owner[at]] + at - borders[owner[at]]
    for i in range(3):
        covered[at + i] = True
    repeats = np.diff(np.concatenate([[0], np.cumsum(covered[:-1])])[words.first])
    return {
        "n_words": words.counts,
        "word_chars": sums(first_bytes & ~blank),
        "n_symbols": sums(symbols[data]),
        "n_dup_lines": dup,
        "n_repeat_words": repeats,
    }


def learn(docs: DataFrame) -> dict[str, Model]:
    """A model for each language, from all texts."""
    rows = docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("grp"), F.col("text").cast("string").alias("text"))
    # Bounded by the alphabet: at most 64**4 keys a language.
    counts = gram_counts(rows, text_grams).toPandas().sort_values(["grp", "key"])
    return {name: estimate(own["key"].to_numpy(), own["n"].to_numpy()) for name, own in counts.groupby("grp")}


def score(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """``doc_id, lang``, the base counts, ``n_grams`` and the mean ``log_probability`` (by
    symbol) and ``word_log`` (by word) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams"]
    schema = "doc_id long, lang string, " + ", ".join(f"{x} long" for x in names) + ", log_probability double"

    def judge(batch: pa.RecordBatch, name: str) -> tuple[pa.RecordBatch, Words]:
        texts = batch.column("text")
        words = words_of(texts)
        counts = text_counts(words)
        keys, borders = text_grams(texts)
        total, n = np.zeros(len(texts)), np.diff(borders)
        if name in shared.value:
            logs = log_probabilities(shared.value[name], keys).astype(np.float64)
            total = np.diff(np.concatenate([[0], np.cumsum(logs)])[borders])
        columns = [batch.column("doc_id"), batch.column("lang"), *(pa.array(counts[x]) for x in names[:-1]), pa.array(n), pa.array(total / np.maximum(n, 1))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", *names, "log_probability"]), words

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    summed = word_model.with_logs(rows, judge, schema)
    return summed.withColumn("word_log", F.col("word_log") / F.greatest("n_words", F.lit(1)))


def quality(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """One row per document: base counts, ``base_failed``, both perplexities and bounds, ``kept``."""
    rows = stored(score(docs, learn(docs)), "perplexities")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    sound = rows.where("not base_failed")
    middle = lambda c, part=0.5: F.percentile_approx(c, part, 10000)
    # One row a language: broadcast after a check, so a frequent language is no hot key.
    medians = if_small(sound.groupBy("lang").agg(middle("log_probability").alias("median"), middle("word_log", 0.25).alias("quartile")), LANGUAGES)
    away, below = F.abs(F.col("log_probability") - F.col("median")), F.col("quartile") - F.col("word_log")
    below = F.when(below > 0, below)
    spread = sound.join(medians, "lang").groupBy("lang", "median", "quartile").agg(
        middle(away).alias("between"),
        middle(away * F.sqrt("n_grams")).alias("by_chance"),
        middle(below).alias("word_between"),
        middle(below * F.sqrt("n_words")).alias("word_by_chance"),
    )
    usual = lambda between, chance, size: 1.4826 * F.greatest(F.col(between), F.col(chance) / F.sqrt(F.greatest(size, F.lit(1))))
    judged = (
        rows.join(if_small(spread, LANGUAGES), "lang", "left")
        .withColumn("deviation", usual("between", "by_chance", "n_grams"))
        .withColumn("word_least", F.col("quartile") - WORD_WIDTH * usual("word_between", "word_by_chance", "n_words"))
    )
    inside = F.coalesce(F.abs(F.col("log_probability") - F.col("median")) <= width * F.col("deviation"), F.lit(True))
    inside &= F.coalesce(F.col("word_log") >= F.col("word_least"), F.lit(True))
    bound = lambda sign: F.exp(-F.col("median") + sign * width * F.col("deviation"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.exp(-F.col("log_probability")).alias("perplexity"),
        bound(-1).alias("lower_perplexity"),
        bound(1).alias("upper_perplexity"),
        F.exp(-F.col("word_log")).alias("word_perplexity"),
        F.exp(-F.col("word_least")).alias("upper_word_perplexity"),
        (~F.col("base_failed") & inside).alias("kept"),
    )
