"""Near duplicates by order MinHash, verified by banded alignment.

A sketch of a text takes the smallest few of its occurrence-labelled word k-mers under one
hash and keeps them in text order; two texts agree on it when they share these k-mers in
the same order. Texts that agree on any of the sketches are candidates. A candidate pair
is a link when an alignment of its k-mers inside a diagonal band keeps enough of them:
``kept / (n_a + n_b - kept) >= similarity``, the Jaccard similarity that respects order.

Equal texts are one text here, whatever their number. Texts of a small bucket all meet; in
a large one all meet the smallest. Where this leaves a large bucket with several
components, it is split by the next sketches of its members and so on. Whatever the splits
could not bring together meets in an exact pass over the large buckets that still hold
several components: two texts similar enough share one of their rarest k-mers, and early enough in
the order of rarity, so texts of other components that do are compared, first with one in
eight, then, where that did not connect them, with all. No bucket is capped, and no group of near
copies becomes all its pairs.

* Words are runs of other than white space, in lower case. A text of fewer than k words
  has one k-mer, all of it; an empty text equals every empty text.
* Null text: a class of its own for every id. Null ids: every row comes back, in the class
  of an equal text that has an id, else without class; one_per_class keeps them.
* Repeated rows: every row comes back; equal ids with equal texts share their class. Equal
  ids with different texts are different documents: each text is in the class of its like.
* Empty table: no rows. Other columns are ignored.
* Very long texts: memory follows the longest text of a task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placebook.llm.arrays import BASE, mix, occurrence, shingles_of, words_of
from placebook.llm.common import stored, within_arrow
from placebook.llm.components import components

K = 5
SIMILARITY = 0.8
SKETCHES = 16
MINIMA = 3
# Up to so many members a bucket compares all its texts.
SMALL_BUCKET = 8
# Sketches by which a level splits a large bucket.
NEXT = 2
# Of the texts that share a rare k-mer one in so many is met, round by round; in the last, all.
PARTS = (8, 1)
BATCH_BYTES = 1_500_000
_FAR = np.uint64(2**64 - 1)


def sketch_batch(texts: pa.Array, k: int, sketches: int, minima: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (texts by sketches) and the number of k-mers of each text."""
    hashes, borders = shingles_of(words_of(pc.utf8_lower(texts)), k)
    counts = np.diff(borders)
    out = np.zeros((len(counts), sketches), np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out, counts
    owner = np.repeat(np.arange(len(counts)), counts)
    labels = mix(hashes + BASE * occurrence(hashes, owner).astype(np.uint64))
    bits = np.uint64(max(int(len(labels)).bit_length(), 1))
    low = (np.uint64(1) << bits) - np.uint64(1)
    places = np.arange(len(labels), dtype=np.uint64)
    starts = borders[has]
    for j in range(sketches):
        v = (mix(labels * np.uint64(2 * j + 3) + np.uint64(j)) & ~low) | places
        found = np.empty((minima, len(has)), np.uint64)
        for i in range(minima):
            best = np.minimum.reduceat(v, starts)
            found[i] = best
            real = best != _FAR
            v[(best[real] & low).astype(np.int64)] = _FAR
        at = np.sort(np.where(found == _FAR, _FAR, found & low), axis=0)
        value = np.full(len(has), np.uint64(j))
        for row in at:
            real = row != _FAR
            value = mix(value * BASE + np.where(real, labels[np.where(real, row, 0).astype(np.int64)], np.uint64(1)))
        out[has, j] = value
    return out, counts


def sketches_of(texts: DataFrame, k: int = K, sketches: int = SKETCHES, minima: int = MINIMA) -> DataFrame:
    """``id, n_kmers, sketches`` for ``texts (id, text)``; no sketches where no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, counts = sketch_batch(batch.column("text"), k, sketches, minima)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.view(np.int64).ravel()), sketches).cast(pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), lists], ["id", "n_kmers", "sketches"])

        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    return texts.select("id", "text").mapInArrow(run, "id long, n_kmers long, sketches array<long>").where("n_kmers > 0")


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two runs of distinct keys within a diagonal band."""
    order = np.argsort(b)
    at = order[np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)]
    hit = np.flatnonzero(b[at] == a)
    at = at[hit]
    at = at[np.abs(at - hit) <= band]
    if (np.diff(at) > 0).all():
        return len(at)
    tails: list[int] = []
    for x in at.tolist():
        i = bisect_left(tails, x)
        if i == len(tails):
            tails.append(x)
        else:
            tails[i] = x
    return len(tails)


def alignment_similarity(left: pa.Array, right: pa.Array, k: int, similarity: float) -> np.ndarray:
    """Order-respecting Jaccard similarity of pairs of texts.

    The band is as wide as two texts of that similarity can drift apart, so it loses none.
    """
    sides = []
    for texts in (left, right):
        hashes, borders = shingles_of(words_of(pc.utf8_lower(texts)), k)
        owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        sides.append((mix(hashes + BASE * occurrence(hashes, owner).astype(np.uint64)), borders))
    (a, i), (b, j) = sides
    out = np.zeros(len(left))
    for r in range(len(left)):
        x, y = a[i[r] : i[r + 1]], b[j[r] : j[r + 1]]
        if not len(x) or not len(y):
            out[r] = float(len(x) == len(y))
            continue
        if min(len(x), len(y)) < similarity * max(len(x), len(y)):
            continue
        band = int(np.ceil((1 - similarity) * (len(x) + len(y)))) + 1
        kept = aligned(x, y, band)
        out[r] = kept / (len(x) + len(y) - kept)
    return out


def verified(pairs: DataFrame, texts: DataFrame, k: int = K, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``(a, b)`` whose texts align well enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = alignment_similarity(batch.column("left"), batch.column("right"), k, similarity)
            return batch.select(["a", "b"]).filter(pa.array(score >= similarity))

        yield from within_arrow(batches, make, "left", BATCH_BYTES)

    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def rare_kmers(texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """``id, n_kmers, rank, kmer``: the rarest k-mers of each of ``texts (id, text)``, enough
    that two texts of the similarity share one: ``ceil(s n)`` of ``n`` are common to both, so
    of the others and one more the rarest common one is among them on both sides. ``rank``
    counts them from 1, in an order that is the same for all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, borders = shingles_of(words_of(pc.utf8_lower(batch.column("text"))), k)
            counts = np.diff(borders)
            owner = np.repeat(np.arange(len(counts)), counts)
            labels = mix(hashes + BASE * occurrence(hashes, owner).astype(np.uint64))
            columns = [batch.column("id").take(pa.array(owner)), pa.array(counts[owner]), pa.array(labels.view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["id", "n_kmers", "kmer"])

        yield from within_arrow(batches, make, "text", BATCH_BYTES)

    each = stored(texts.select("id", "text").mapInArrow(run, "id long, n_kmers long, kmer long"), "kmers")
    # Stored, so that both sides of the join are dealt anew and Spark can split a hot k-mer.
    often = stored(each.groupBy("kmer").agg(F.count("*").alias("n")).where("n > 1"), "kmer-counts")
    ranked = each.join(often, "kmer", "left").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(1)), "kmer")))
    enough = F.col("n_kmers") - F.ceil(F.lit(similarity) * F.col("n_kmers") - 1e-9) + 1
    return ranked.where((F.col("rank") <= enough) & F.col("n").isNotNull()).select("id", "n_kmers", "rank", "kmer")


def may_link(n: str, rank: str, other_n: str, other_rank: str, similarity: float):
    """Whether two texts whose rarest common k-mer has these ranks can be similar enough:
    besides it they share at most what comes after it, in the text where that is less."""
    after = F.least(F.col(n) - F.col(rank), F.col(other_n) - F.col(other_rank)) + 1
    return after >= F.ceil(similarity / (1 + similarity) * (F.col(n) + F.col(other_n)) - 1e-9)


def _mixed(members: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``members`` with their ``component``, where those of a ``key`` differ in it."""
    apart = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = apart.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return apart.join(mixed.select(key), key)


def _split(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of a bucket anew, one bucket for each of their next sketches. Pairs that
    agree on none of these are left to the exact pass."""
    following = F.transform(F.slice("sketches", F.col("j") + 2, F.lit(NEXT)), lambda v, i: F.struct((i + F.col("j") + 1).alias("next"), v.alias("value")))
    later = members.join(sketches, "id").select("id", "key", F.explode(following).alias("s"))
    return later.select("id", F.xxhash64("key", "s.value").alias("key"), F.col("s.next").alias("j"))


def near_links(texts: DataFrame, k: int = K, similarity: float = SIMILARITY, sketches: int = SKETCHES, minima: int = MINIMA, levels: int = 3) -> DataFrame:
    """``id, component`` of the distinct ``texts (id, text)`` that have a near duplicate."""
    spark = texts.sparkSession
    sketched = stored(sketches_of(texts, k, sketches, minima).dropDuplicates(["id"]), "sketches")
    members = sketched.select("id", F.posexplode("sketches").alias("j", "key"))
    links, tested = (spark.createDataFrame([], "a long, b long") for _ in range(2))
    labels = spark.createDataFrame([], "id long, component long")
    for level in range(1, levels + 1):
        buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
        members = stored(members.join(buckets, "key"), "buckets")
        if level == 1:  # from here on only texts that share a bucket are read, each once
            shared = texts.join(members.select("id").distinct(), "id", "left_semi")
            texts = stored(shared.dropDuplicates(["id"]), "bucket-texts")
        star = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        small = members.where((F.col("n") > 2) & (F.col("n") <= SMALL_BUCKET)).select("key", "id")
        every = small.select("key", F.col("id").alias("a")).join(small.select("key", F.col("id").alias("b")), "key").where("a < b")
        found = star.union(every.select("a", "b"))
        links, labels, tested = _test(found, tested, links, labels, texts, k, similarity)
        large = members.where(F.col("n") > SMALL_BUCKET).select("id", "key", "j")
        wide = large if level == 1 else wide
        apart = stored(_mixed(large, labels, "key"), "apart")
        if apart.isEmpty():
            break
        members = _split(apart, sketched)
    # Every pair that shares a large bucket shares one of the first level.
    left = stored(_mixed(wide, labels, "key").select("id").distinct(), "left-apart")
    if left.isEmpty():
        return labels
    rare = stored(rare_kmers(texts.join(left, "id", "left_semi"), k, similarity), "rare-kmers")
    # The smaller components of a k-mer meet the rest: a part of it first, whose links spare
    # most texts the others, then all.
    for parts in PARTS:
        apart = stored(_mixed(rare, labels, "kmer"), "rare-apart")
        sizes = apart.groupBy("kmer", "component").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("kmer").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
        few = apart.join(stored(largest, "rare-largest"), "kmer").where("component <> largest")
        few = few.select("kmer", F.col("id").alias("x"), F.col("component").alias("own"), F.col("n_kmers").alias("n"), F.col("rank").alias("at"))
        others = apart.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).select("kmer", "id", "component", "n_kmers", "rank")
        meet = few.join(others, "kmer").where("own <> component").where(may_link("n", "at", "n_kmers", "rank", similarity))
        found = meet.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))
        links, labels, tested = _test(found, tested, links, labels, texts, k, similarity)
    return labels


def _test(found, tested, links, labels, texts, k, similarity):
    """Verify pairs not tested before and not yet connected; update links and components."""
    own = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
    new = found.distinct().join(tested, ["a", "b"], "left_anti").join(own("a"), "a", "left").join(own("b"), "b", "left")
    new = stored(new.where("of_a is null or of_b is null or of_a <> of_b").select("a", "b"), "candidates")
    right = stored(verified(new, texts, k, similarity), "near-links")
    if right.isEmpty():
        return links, labels, tested.union(new)
    links = links.union(right)
    return links, stored(components(links), "near-components"), tested.union(new)


def near_duplicates(docs: DataFrame, k: int = K, similarity: float = SIMILARITY, sketches: int = SKETCHES, minima: int = MINIMA) -> DataFrame:
    """``doc_id, class_id`` for every row; a class is named by its smallest id."""
    return classified(docs, k, similarity, sketches, minima).select("doc_id", "class_id")


def classified(docs: DataFrame, k: int = K, similarity: float = SIMILARITY, sketches: int = SKETCHES, minima: int = MINIMA) -> DataFrame:
    """``doc_id, digest, class_id, component`` for every row. Classes that share a name, two
    texts of one id having founded them, differ in ``component``; null texts have none."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("digest", F.sha2("text", 256))
    keyed = stored(plain.select("doc_id", "digest"), "text-digests")
    # One stand-in per distinct text, numbered by hash.
    heads = keyed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("head"))
    heads = stored(heads.withColumn("id", F.xxhash64("digest")), "text-heads")
    chosen = heads.select("digest", "id", F.col("head").alias("doc_id"))
    near = near_links(plain.join(chosen, ["digest", "doc_id"]).select("id", "text"), k, similarity, sketches, minima)
    classes = heads.join(near, "id", "left").select("digest", "head", F.coalesce("component", "id").alias("component"))
    names = classes.groupBy("component").agg(F.min("head").alias("class_id"))
    classes = stored(classes.join(names, "component").select("digest", "class_id", "component"), "text-classes")
    return keyed.join(classes, "digest", "left").select("doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"), "component")


def one_per_class(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per class of ``classified``, all columns as they came: the smallest id's, of
    its texts the one with the smallest digest. Rows without id stay, and one row per id
    with a null text. Only what comes more than once is shuffled with its text.
    """
    named = classes.where("doc_id is not null")
    own = named.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    blank = named.where("component is null").select("doc_id", "digest").distinct()
    first = own.select("first.doc_id", "first.digest").unionByName(blank)
    keep = named.join(first, named.doc_id.eqNullSafe(first.doc_id) & named.digest.eqNullSafe(first.digest), "left_semi")
    keep = keep.groupBy(F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest")).agg(F.count("*").alias("n"))
    keep = stored(keep, "kept-texts")
    row = docs.select(F.struct(*docs.columns).alias("row"))

    def rows_of(which: DataFrame) -> DataFrame:
        same = (F.col("row.doc_id").cast("long") == F.col("own_id")) & F.sha2(F.col("row.text").cast("string"), 256).eqNullSafe(F.col("own_digest"))
        return row.join(which, same)

    once = rows_of(keep.where("n = 1")).select("row.*")
    more = rows_of(keep.where("n > 1")).dropDuplicates(["own_id", "own_digest"]).select("row.*")
    return once.unionByName(more).unionByName(docs.where("doc_id is null"))
