"""Near copies among vectors against all cosines."""

import math

import numpy as np
import pandas as pd
import pytest

from placebook.llm import multi_index
from placebook.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=multi_index.THRESHOLD):
    """``(vec_id, n_links, component_id, kept)`` from the cosines of all pairs."""

    def sound(row):
        i, x, label = row
        return i is not None and label is not None and bool(x) and all(v is not None and math.isfinite(v) for v in x) and any(x)

    def unit(x):
        top = max(abs(v) for v in x)
        x = [v / top for v in x]
        size = math.sqrt(math.fsum(v * v for v in x))
        return [v / size for v in x]

    units = [unit(r[1]) if sound(r) else None for r in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is None or y is None or rows[i][2] != rows[j][2] or len(x) != len(y):
                continue
            if math.fsum(a * b for a, b in zip(x, y, strict=True)) >= threshold:
                n[i] += 1
                n[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[top(i)] = min(least.get(top(i), row[0]), row[0])
    return sorted((repr(r[0]), n[i], least.get(top(i)), r[0] is not None and r[0] == least[top(i)]) for i, r in enumerate(rows))


def found(frame, **more):
    return sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in multi_index.near_copies(frame, **more).collect())


def test_query_equals_all_pairs(spark):
    frame = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = [(int(i), [float(v) for v in x], label) for i, x, label in frame[["vec_id", "embedding", "label"]].values.tolist()]
    got = QUERIES["op11_multi_index"](spark, SF)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in got.collect()) == brute(rows)


def clusters(rng, n, dims, spread):
    """Vectors around few centres, many beyond the threshold of each other and many not."""
    centres = rng.normal(size=(4, dims))
    return [(int(i), [float(v) for v in centres[rng.integers(4)] + spread * rng.normal(size=dims)], int(rng.integers(2))) for i in rng.permutation(n)]


def test_recall_on_borderline_vectors(spark, monkeypatch):
    """Many cells, so that links run between them; pairs close to the threshold on both sides."""
    monkeypatch.setattr(multi_index, "PER_CELL", 2)
    rows = clusters(np.random.default_rng(7), 600, 12, 0.13)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    links = sum(r[1] for r in want)
    assert links > 2000
    assert found(frame, target_recall=1.0) == want
    got = found(frame)
    assert 0.99 * links <= sum(r[1] for r in got) <= links


def test_hot_cell_in_blocks(spark, monkeypatch):
    """A third of all rows in one cell, dealt out as pairs of small blocks."""
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    rng = np.random.default_rng(8)
    hot = rng.normal(size=20)
    rows = [(i, [float(v) for v in hot + 0.03 * rng.normal(size=20)], 0) for i in range(150)]
    rows += [(1000 + i, [float(v) for v in rng.normal(size=20)], 0) for i in range(300)]
    rows += [(5000 + i, rows[0][1], 0) for i in range(40)]  # equal vectors are one node
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(frame) == brute(rows)


def test_hard_vectors(spark):
    x = [0.3, -1.5, 2.0]
    exact = [0.98, math.sqrt(1 - 0.98**2), 0.0]
    rows = [
        (1, x, 1), (2, x, 1), (2, x, 1), (2, [-v for v in x], 1), (3, x, 2), (4, x, None), (5, None, 1), (6, [], 1),
        (7, [0.0, -0.0, 0.0], 1), (8, [None, 1.0, 2.0], 1), (9, [float("nan"), 1.0, 2.0], 1), (10, [float("inf"), 1.0, 2.0], 1),
        (11, [v * 1e300 for v in x], 1), (12, [v * 1e-310 for v in x], 1), (13, [0.3, -1.5], 1), (14, [0.3, -1.5], 1), (None, x, 1),
        (20, [1.0, 0.0, 0.0], 3), (21, exact, 3), (-4, [1.0, 0.0, -0.0], 3), (22, [0.0, 0.0, 1.0], 3), (9_000_000_000, x, 1),
    ]
    full = [(*r, "cell", 1, True) for r in rows]
    frame = spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, cell string, hash int, member boolean")
    assert found(frame) == brute(rows)
    assert found(frame.limit(0)) == []
    nothing = frame.where("vec_id in (5, 6, 7)")
    assert found(nothing) == [(i, 0, int(i), True) for i in "567"]


def test_traversal_visits_all_cells_within_reach_in_order():
    rng = np.random.default_rng(9)
    first, second = rng.random((50, 7)), rng.random((50, 5))
    first[:, 2] = second[:, 4] = 0
    row, cell = multi_index.traverse(first, second, 0.8)
    sums = (first[:, :, None] + second[:, None, :]).reshape(50, -1)
    for i in range(50):
        mine = cell[row == i]
        assert sorted(mine) == np.flatnonzero(sums[i] <= 0.8).tolist()
        assert (np.diff(sums[i][mine]) >= 0).all()


@pytest.mark.parametrize("size", [1, 4, 9])
def test_bounds_never_exceed_distances(size):
    rng = np.random.default_rng(size)
    unit = multi_index.unit_of(rng.normal(size=(400, 9)))
    grid = multi_index.learn(unit, size, 0.9, 0.99)
    first, second = grid.bounds(unit)
    own, width = grid.own(unit), len(grid.books[1])
    for i in range(0, 400, 7):
        apart = ((unit - unit[i]) ** 2).sum(1)
        assert (first[i, own // width] + second[i, own % width] <= apart + 1e-9).all()
