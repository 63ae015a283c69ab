"""Near copies among embeddings, found through an inverted multi-index.

Vectors are scaled to unit length and cut into halves. Each half has a codebook of its
own, learned by Lloyd's iteration from a bounded sample; the two nearest centres name the
cell of a product grid in which a vector is filed. How far a vector lies from a cell is
bounded below by its distances to the planes between its own centre and the cell's, half by
half. A multi-sequence traversal visits cells in ascending order of that bound and stops
where a share of ``target_recall`` of partners has been met. Where that is follows from the
sample: its vectors are moved to exactly the threshold's distance, in random directions and
in directions of the data's own spread, and their cells looked up. ``target_recall = 1`` stops at the threshold's
distance instead, beyond which no partner can be.

A pair in two cells is looked for from the cell with the smaller number only, so every pair
is met once. In a cell, all visitors are compared with all members by their cosines; cells
of more than ``BLOCK`` rows are dealt out as pairs of blocks. A group returns one row per
linked vector (its count, and the smallest vector it is connected with there), never pairs.

Vectors link when their labels are equal and their cosine, in double precision, is at least
the threshold. Equal vectors of one label are one node with a count.

* Null, empty or zero vectors, vectors with null or non-finite components, null labels:
  no links, a component of their own.
* Null ``vec_id``: such a row has no name to link by: no links, null component, not kept.
* Repeated ``vec_id``: every row is a vector; links count rows.
* Vectors of different lengths never link. Empty table: no rows.
* Columns other than ``vec_id, embedding, label`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.common import stored
from placebook.llm.components import components

THRESHOLD = 0.98
TARGET_RECALL = 0.999
# Vectors the codebooks are learned from, on average; the only thing that is sampled.
SAMPLE = 20_000
SAMPLE_PARTS = 1 << 30
# Vectors a cell is meant to hold, over all labels, and the most centres of a codebook.
PER_CELL = 256
MOST_CENTRES = 1024
ROUNDS = 8
BLOCK = 2048
RUN = 2048
# Cosines this close to the threshold are computed again without rounding in the sums.
CLOSE = 1e-9


@dataclass(frozen=True)
class Grid:
    """Two codebooks, the distances among their centres, and where traversal stops."""

    books: tuple[np.ndarray, np.ndarray]
    gaps: tuple[np.ndarray, np.ndarray]
    reach: float

    @property
    def width(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        return unit[:, :cut], unit[:, cut:]

    def own(self, unit: np.ndarray) -> np.ndarray:
        first, second = (nearest(x, book) for x, book in zip(self.halves(unit), self.books, strict=True))
        return first * len(self.books[1]) + second

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower bounds of the distance to every centre's region, half by half."""
        out = []
        for x, book, gap in zip(self.halves(unit), self.books, self.gaps, strict=True):
            square = squares(x, book)
            own = square.argmin(1)
            apart = gap[own]
            far = (square - square[np.arange(len(x)), own][:, None]) / np.where(apart > 0, 2 * apart, 1)
            far[np.arange(len(x)), own] = 0
            out.append(np.maximum(far, 0) ** 2)
        return out[0], out[1]

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``row, cell`` of all visits, every row's nearest cells first."""
        first, second = self.bounds(unit)
        return traverse(first, second, self.reach)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (book**2).sum(1) - 2 * x @ book.T


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return squares(x, book).argmin(1)


def traverse(first: np.ndarray, second: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Multi-sequence traversal of all rows in step: of each row's open grid places the one
    with the least sum comes next, until the least exceeds ``reach``."""
    n, width = len(first), second.shape[1]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order1, order2 = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
    sorted1, sorted2 = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
    deep1, deep2 = (int((s <= reach).sum(1).max()) for s in (sorted1, sorted2))
    sorted1 = sorted1[:, :deep1]
    sorted2 = np.concatenate([sorted2[:, :deep2], np.full((n, 1), np.inf)], 1)
    taken = np.zeros((n, deep1), np.int64)  # places of each sequence of the first half
    active, rows, cells = np.arange(n), [], []
    while len(active):
        at = taken[active]
        sums = sorted1[active] + np.take_along_axis(sorted2[active], at, 1)
        sums[:, 1:][at[:, 1:] >= at[:, :-1]] = np.inf  # opens once the sequence before it is ahead
        best = sums.argmin(1)
        inside = sums[np.arange(len(active)), best] <= reach
        active, best = active[inside], best[inside]
        column = taken[active, best]
        rows.append(active)
        cells.append(order1[active, best] * width + order2[active, column])
        taken[active, best] = column + 1
    row, cell = np.concatenate(rows), np.concatenate(cells)
    order = np.argsort(row, kind="stable")
    return row[order], cell[order]


def codebook(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    book = distinct[np.sort(rng.permutation(len(distinct))[:size])].copy()
    for _ in range(ROUNDS):
        own = nearest(x, book)
        counts = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, x)
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def learn(sample: np.ndarray, size: int, threshold: float, target_recall: float) -> Grid:
    """A grid of ``size`` by ``size`` cells from unit vectors."""
    rng = np.random.default_rng(1)
    cut = (sample.shape[1] + 1) // 2
    books = tuple(codebook(x, size, rng) for x in (sample[:, :cut], sample[:, cut:]))
    gaps = tuple(np.sqrt(np.maximum(squares(b, b), 0)) for b in books)
    grid = Grid(books, gaps, max(0.0, 2 - 2 * threshold))
    if target_recall >= 1:
        return grid
    some = sample[rng.permutation(len(sample))[:4096]]
    reaches = [0.0]
    for step in (rng.normal(size=some.shape), some[rng.permutation(len(some))] - some[rng.permutation(len(some))]):
        step = step - (step * some).sum(1, keepdims=True) * some
        size_of = np.linalg.norm(step, axis=1, keepdims=True)
        moved = threshold * some + math.sqrt(1 - threshold**2) * step / np.where(size_of > 0, size_of, 1)
        first, second = grid.bounds(some)
        at, width = grid.own(moved), len(books[1])
        needed = first[np.arange(len(some)), at // width] + second[np.arange(len(some)), at % width]
        reaches.append(float(np.quantile(needed, target_recall, method="higher")))
    return Grid(books, gaps, min(grid.reach, max(reaches)))


def unit_of(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def padded(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of one matrix, zeros behind short ones; and their lengths."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows, with ``usable`` ones marked, and the distinct vectors of each label."""
    whole = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))
    rows = whole.withColumn("label", F.when(usable, F.col("label")))
    nodes = rows.where("label is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    node = F.struct("vec_id", F.xxhash64("label", "embedding").alias("hash")).alias("node")
    return rows, nodes.select(node, "label", "embedding", "copies")


def filed(nodes: DataFrame, grid: Grid) -> DataFrame:
    """``label, dims, cell, member, own, vec_id, hash, copies, vector``: every vector once as
    member of its cell, and once for every cell it visits."""
    schema = "label string, dims int, cell long, member boolean, own boolean, vec_id long, hash long, copies long, vector binary"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, sizes = padded(batch.column("embedding"), grid.width)
        unit = unit_of(x)
        own = grid.own(unit)
        row, cell = grid.visits(unit)
        # Rounding may hide a row's own cell from its visits.
        ahead = cell > own[row]
        row, cell = np.concatenate([row[ahead], np.tile(np.arange(len(x)), 2)]), np.concatenate([cell[ahead], np.tile(own, 2)])
        member = np.zeros(len(row), bool)
        member[len(row) - len(x) :] = True
        data = [v[:n].tobytes() for v, n in zip(x, sizes, strict=True)]
        take = lambda column: column.take(pa.array(row))
        columns = [take(batch.column("label")), pa.array(sizes[row], pa.int32()), pa.array(cell), pa.array(member), pa.array(cell == own[row])]
        columns += [take(batch.column(c)) for c in ("vec_id", "hash", "copies")] + [take(pa.array(data, pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, RUN):
                yield part(batch.slice(begin, RUN))

    return nodes.select("node.vec_id", "node.hash", "label", "embedding", "copies").mapInArrow(run, schema)


def dealt(files: DataFrame) -> DataFrame:
    """The rows of a cell as pairs of blocks: ``visitors`` by ``members``, each of about
    ``BLOCK`` rows at most, however many rows the cell has."""
    keys = ["label", "dims", "cell"]
    sizes = files.groupBy(*keys).agg(F.count(F.when(F.col("member"), 1)).alias("m"), F.count(F.when(~F.col("member"), 1)).alias("v"))
    large = stored(sizes.where(f"v > {BLOCK}").select(*keys, F.ceil(F.col("m") / BLOCK).alias("m"), F.ceil(F.col("v") / BLOCK).alias("v")), "large-cells")
    with_blocks = files.join(large, keys, "left").withColumns({"m": F.coalesce("m", F.lit(1)), "v": F.coalesce("v", F.lit(1))})
    of = lambda n: F.pmod("hash", F.greatest(n, F.lit(1)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)
    pairs = F.when(F.col("member"), F.transform(every(F.col("v")), lambda b: F.struct(b.alias("visitors"), of(F.col("m")).alias("members"))))
    pairs = pairs.otherwise(F.transform(every(F.col("m")), lambda b: F.struct(of(F.col("v")).alias("visitors"), b.alias("members"))))
    return with_blocks.withColumn("block", F.explode(pairs)).select(*files.columns, "block.visitors", "block.members")


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y)))


def links_in(group: dict[str, np.ndarray], vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one pair of blocks: rows that stand for linked vectors, how many rows each is
    linked with here, and the row of the smallest vector it is connected with here."""
    member = group["member"]
    m, v = np.flatnonzero(member), np.flatnonzero(~member)
    order = np.lexsort((group["hash"], group["vec_id"]))
    key = np.stack([group["vec_id"][order], group["hash"][order]])
    node = np.empty(len(order), np.int64)  # the same number for the same vector, ascending
    node[order] = np.cumsum(np.concatenate([[0], (key[:, 1:] != key[:, :-1]).any(0)]))
    unit = unit_of(vectors)
    masks = []
    for begin in range(0, len(v), 512):
        rows = v[begin : begin + 512]
        cosines = unit[rows] @ unit[m].T
        mask = cosines >= threshold + CLOSE
        for i, j in zip(*np.nonzero(np.abs(cosines - threshold) < CLOSE), strict=True):
            mask[i, j] = exact_cosine(vectors[rows[i]], vectors[m[j]]) >= threshold
        mask &= ~group["own"][rows][:, None] | (node[rows][:, None] < node[m])
        masks.append((rows, mask))
    n = np.zeros(node.max() + 1, np.int64)
    for rows, mask in masks:
        n[node[rows]] += mask @ group["copies"][m]
        n[node[m]] += group["copies"][rows] @ mask
    least, before = np.arange(len(n)), None
    while before is None or (least != before).any():
        before = least.copy()
        for rows, mask in masks:
            for own, low in ((node[rows], np.where(mask, least[node[m]], len(n)).min(1)), (node[m], np.where(mask, least[node[rows]][:, None], len(n)).min(0))):
                least[own] = np.minimum(least[own], low)
        least = least[least]
    row_of = np.empty(len(n), np.int64)
    row_of[node] = np.arange(len(node))
    found = np.flatnonzero(n)
    return row_of[found], n[found], row_of[least[found]]


def compared(blocks: DataFrame, threshold: float) -> DataFrame:
    """``node, n, root``: what each pair of blocks says of its linked vectors."""
    schema = "vec_id long, hash long, n long, root_id long, root_hash long"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        group = {c: table.column(c).to_numpy() for c in ("member", "own", "vec_id", "hash", "copies")}
        row = n = root = np.zeros(0, np.int64)
        if group["member"].any() and not group["member"].all():
            vectors = np.frombuffer(b"".join(table.column("vector").to_pylist())).reshape(table.num_rows, -1)
            row, n, root = links_in(group, vectors, threshold)
        columns = [group["vec_id"][row], group["hash"][row], n, group["vec_id"][root], group["hash"][root]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    out = blocks.groupBy("label", "dims", "cell", "visitors", "members").applyInArrow(run, schema)
    return out.select(F.struct("vec_id", "hash").alias("node"), "n", F.struct(F.col("root_id").alias("vec_id"), F.col("root_hash").alias("hash")).alias("root"))


def fitted(nodes: DataFrame, threshold: float, target_recall: float) -> Grid | None:
    """The grid for these vectors; none without vectors."""
    count, width = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not count:
        return None
    size = min(MOST_CENTRES, math.ceil(math.sqrt(count / PER_CELL)))
    share = math.ceil(min(1.0, SAMPLE / count) * SAMPLE_PARTS)
    picked = nodes.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE_PARTS)) < share).select("embedding").limit(2 * SAMPLE).toArrow()
    if not picked.num_rows:
        picked = nodes.select("embedding").limit(1).toArrow()
    sample, _ = padded(picked.column("embedding").combine_chunks(), width)
    return learn(unit_of(sample), size, threshold, target_recall)


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows, nodes = nodes_of(vectors)
    nodes = stored(nodes, "vectors")
    grid = fitted(nodes, threshold, target_recall)
    alone = F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    if grid is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), *alone)
    found = stored(compared(dealt(stored(filed(nodes, grid), "cells")), threshold), "links-by-block")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = nodes.join(counts, "node", "left").join(groups.withColumnRenamed("id", "node"), "node", "left")
    told = told.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component.vec_id", "node.vec_id").alias("least"))
    out = rows.join(stored(told, "linked-vectors"), ["label", "embedding"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
