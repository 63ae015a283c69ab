"""Benchmark passages in documents: SimHash windows, multi-index blocks, exact check.

DataFrame functions only. A window has as many words as a benchmark item; it matches when
the weighted Jaccard similarity of the two multisets of five-word shingles (weight: how
often a shingle occurs) is at least ``SIMILARITY``.

Fingerprinting every window of every document for every item length would be 64 sums per
word and length. Windows are therefore laid only where they can match: such a window holds
at least ``ceil(s m)`` of an item's ``m`` shingles, so it holds one of the item's
``m - ceil(s m) + 1`` rarest. Those are the anchors; in documents with an item's anchor all
places of its shingles are looked up. From the first of them in a matching window on,
``ceil(s m)`` places lie within ``m``, and the window begins at most ``m - ceil(s m)`` before
it: these windows are laid, in whatever order the item's words stand there.

Window and item fingerprints of 64 bits are cut into ``RADIUS + 1`` blocks. Two
fingerprints within the radius agree on at least one block, so a join on item, block
number and bits finds all of them; the radius is five deviations above what windows of the
required similarity show. Windows so found are verified exactly.

* Null text, item or id of an item: matches nothing. Empty texts likewise. A text of under
  five words is one shingle and matches an item of the same words.
* Repeated rows and ids: texts of one id are told apart by hash; equal ones give one row.
* Null document ids: not reported; ``clean`` keeps their rows. Empty tables: no rows.
* Other columns are ignored. Very long texts: one row each; sizes follow the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebook.llm.common import if_small, stored

K = 5
SIMILARITY = 0.8
RADIUS = 24
LANES = 32
# Rows up to which a benchmark-sized table may be broadcast; larger ones are shuffled.
SMALL = 1_000_000


def shingled(df: DataFrame, text: str, *others: str) -> DataFrame:
    """``others`` and ``shingles``: a hash per run of five words, in text order.

    Word hashes are bound once, as a lambda's argument: as a column of their own the
    optimizer might put their expression in place of each use, inside the loop as well.
    """
    words = f"filter(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    runs = f"transform(sequence(1, greatest(size(h) - {K - 1}, 1)), i -> xxhash64(slice(h, i, {K})))"
    one = f"transform(array(transform({words}, w -> xxhash64(w))), h -> if(size(h) = 0, array(), {runs}))"
    return df.select(*others, F.expr(f"element_at({one}, 1)").alias("shingles"))


def fingerprint(shingles: str) -> Column:
    """64-bit SimHash of an array of shingle hashes, repeats counting again.

    Bits are counted in 32-bit lanes, two at a time; more than half sets the bit.
    """
    lane = "4294967297L"  # the lowest bit of each lane
    sums = ", ".join(f"aggregate({shingles}, 0L, (a, x) -> a + (shiftrightunsigned(x, {b}) & {lane}))" for b in range(LANES))
    count = f"(shiftrightunsigned(element_at(array({sums}), i % {LANES} + 1), {LANES} * (i div {LANES})) & 4294967295L)"
    # The sums are bound once, outside the loop over bits.
    count = count.replace(f"array({sums})", "lanes")
    one = f"if(2 * {count} > size({shingles}), shiftleft(1L, i), 0L)"
    loop = f"aggregate(sequence(0, 63), 0L, (f, i) -> f | {one})"
    return F.expr(f"element_at(transform(array(array({sums})), lanes -> {loop}), 1)")


def blocks(fp: str) -> Column:
    """Numbered bit blocks: position above, bits below."""
    cuts = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    parts = [f"{i} * 65536 + cast(shiftrightunsigned({fp}, {a}) & {2 ** (b - a) - 1} as int)" for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.expr(f"array({', '.join(parts)})")


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item_key, item_id, m, item_shingles, item_fp``: one row per distinct item."""
    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text"))
    plain = plain.where("item_id is not null").withColumn("item_key", F.xxhash64("item_id", "item_text")).dropDuplicates(["item_key"])
    rows = shingled(plain, "item_text", "item_key", "item_id").withColumnRenamed("shingles", "item_shingles")
    rows = stored(rows, "item-shingles").where("size(item_shingles) > 0")
    return rows.withColumn("m", F.size("item_shingles")).withColumn("item_fp", fingerprint("item_shingles"))


def needed(similarity: float) -> Column:
    """Shingles of an item that every matching window holds."""
    return F.ceil(F.lit(similarity) * F.col("m") - 1e-9).cast("int")


def anchors_of(items: DataFrame, similarity: float) -> DataFrame:
    """``shingle, item_key``: each item's rarest shingles, enough to meet every match."""
    each = items.select("item_key", "m", F.posexplode("item_shingles").alias("at", "shingle"))
    known = each.groupBy("shingle").agg(F.countDistinct("item_key").alias("n"))
    order = Window.partitionBy("item_key").orderBy("n", "shingle", "at")
    ranked = each.join(known, "shingle").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.col("m") - needed(similarity) + 1).select("shingle", "item_key").distinct()


def starts_of(texts: DataFrame, pairs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, version, item_key, m, start``: every window that holds enough shingles of the
    item of its pair, and some beside."""
    known = if_small(items.select("item_key", "m", F.explode("item_shingles").alias("shingle")).distinct(), SMALL)
    row = ["doc_id", "version", "item_key"]
    each = texts.select("doc_id", "version", F.posexplode("shingles").alias("place", "shingle"))
    hits = each.join(known, "shingle").join(if_small(pairs, SMALL), row, "left_semi")
    placed = hits.groupBy(*row, "m").agg(F.sort_array(F.collect_list("place")).alias("places")).withColumn("need", needed(similarity))
    firsts = "filter(transform(places, (p, i) -> if(get(places, i + need - 1) - p < m, p, null)), p -> p is not null)"
    # Each start once: what an earlier first place has covered is not laid again.
    starts = "flatten(transform(f, (p, i) -> sequence(greatest(p - m + need, coalesce(get(f, i - 1) + 1, p - m + need)), p)))"
    dense = placed.withColumn("starts", F.expr(f"element_at(transform(array({firsts}), f -> {starts}), 1)"))
    return dense.select(*row, "m", F.explode("starts").alias("start"))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, version, item_id, start_word, similarity, distance``: the best window of
    each document and item that match."""
    items = stored(items_of(benchmark), "benchmark-items")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("version"), F.col("text").cast("string").alias("doc_text"))
    plain = plain.where("doc_id is not null and doc_text is not null")
    each = shingled(plain, "doc_text", "doc_id", "version")
    # The outer form spares a second evaluation for a filter on empty arrays.
    each = each.select("doc_id", "version", F.posexplode_outer("shingles").alias("place", "shingle"))
    anchors = if_small(stored(anchors_of(items, similarity), "benchmark-anchors"), SMALL)
    pairs = stored(each.join(anchors, "shingle").select("doc_id", "version", "item_key").distinct(), "anchor-hits")

    found = if_small(pairs.select(F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version")).distinct(), SMALL)
    again = plain.join(found, (F.col("doc_id") == F.col("hit_id")) & (F.col("version") == F.col("hit_version")), "left_semi")
    texts = stored(shingled(again, "doc_text", "doc_id", "version").dropDuplicates(["doc_id", "version"]), "hit-texts")
    small_items = if_small(items, SMALL)
    laid = starts_of(texts, pairs, items, similarity).join(texts, ["doc_id", "version"])
    last = F.greatest(F.size("shingles") - F.col("m"), F.lit(0))
    laid = laid.withColumn("start", F.greatest(F.least("start", last), F.lit(0)).cast("int"))
    windows = laid.select("doc_id", "version", "item_key", "start", F.expr("slice(shingles, start + 1, m)").alias("window")).distinct()
    windows = stored(windows.withColumn("fp", fingerprint("window")), "windows")

    # Multi-index search on distinct fingerprints: equal passages ask once.
    asked = windows.select("item_key", "fp").distinct()
    index = small_items.select("item_key", "item_fp", F.explode(blocks("item_fp")).alias("block"))
    near = asked.select("item_key", "fp", F.explode(blocks("fp")).alias("block")).join(index, ["item_key", "block"])
    near = near.select("item_key", "fp", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance")).where(F.col("distance") <= RADIUS).distinct()

    close = windows.join(near, ["item_key", "fp"])
    window = ["doc_id", "version", "item_key", "start", "distance"]
    counts = close.select(*window, F.size("window").alias("w"), F.explode("window").alias("shingle")).groupBy(*window, "w", "shingle").agg(F.count("*").alias("c"))
    item_counts = items.select("item_key", "item_id", "m", F.explode("item_shingles").alias("shingle")).groupBy("item_key", "item_id", "m", "shingle").agg(F.count("*").alias("d"))
    shared = counts.join(item_counts, ["item_key", "shingle"]).groupBy(*window, "w", "item_id", "m").agg(F.sum(F.least("c", "d")).alias("o"))
    scored = shared.withColumn("similarity", F.col("o") / (F.col("w") + F.col("m") - F.col("o"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "version", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), -F.col("distance"))).alias("best"))
    return best.select(
        "doc_id",
        "version",
        "item_id",
        (-F.col("best.col2")).alias("start_word"),
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.col3")).alias("distance"),
    )


def clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a match, as they came. Of an id with several texts only
    those that match go."""
    bad = stored(found.select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")).distinct(), "contaminated")
    row = docs.select(F.struct(*docs.columns).alias("row"))
    same = (F.col("row.doc_id").cast("long") == F.col("bad_id")) & (F.hash("row.text") == F.col("bad_version"))
    kept = row.join(bad, same, "left_anti")
    return kept.select("row.*")
