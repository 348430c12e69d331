"""Near copies of vectors beside brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.llm import grid_join

SCHEMA = "vec_id long, embedding array<{}>, label int, place long, copies long, size int"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2, 3)
                                  for i, v in rows], SCHEMA.format(kind))


def brute(rows, threshold):
    def fit(i, v):
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            return None
        v = np.asarray(v, np.float64)
        return v if (v != 0).any() else None

    vectors = [fit(i, v) for i, v in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(n):
            u, v = vectors[a], vectors[b]
            if a != b and u is not None and v is not None and len(u) == len(v) and (
                    np.dot(u, v) / (np.sqrt(np.dot(u, u)) * np.sqrt(np.dot(v, v))) >= threshold):
                links[a] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if r not in least or (i is not None and i < least[r]) else least[r]
    out = [(i, links[k], least[find(k)]) for k, (i, _) in enumerate(rows)]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 12)).astype(np.float32)
    rows = [(1000 + k, v) for k, v in enumerate(base)]
    for k in range(160):  # near copies, chains and exact copies
        v = base[k % 13] + rng.normal(size=12).astype(np.float32) * np.float32(0.1 * (k % 4))
        rows.append((k, v.astype(np.float32)))
    rows += [(500, None), (501, []), (502, [0.0] * 12), (503, [1.0] * 11 + [None]), (504, [1.0] * 11 + [float("nan")]),
             (505, [1.0] * 11 + [float("inf")]), (None, base[0]), (506, base[0] * np.float32(4)), (1, base[5]),
             (507, [1.0, 2.0]), (508, [2.0, 4.0]), (509, [3.0])]
    return rows


def got(spark, rows, threshold, kind="float"):
    return sorted((tuple(r) for r in grid_join.near_copies(frame(spark, rows, kind), threshold).select(
        "vec_id", "n_links", "component_id", F.when(F.col("vec_id").isNull(), True).otherwise(F.col("kept"))).collect()), key=str)


@pytest.mark.parametrize("threshold", [0.9, 0.5])
def test_links_by_brute_force(spark, vectors, threshold):
    expected = sorted(((i, n, c, True if i is None else k) for i, n, c, k in brute(vectors, threshold)), key=str)
    assert got(spark, vectors, threshold) == expected


def test_small_tiles_and_blocks(spark, vectors, monkeypatch):
    """Many tiles: the recursion has levels, tasks meet groups of tiles, and hot places are cut."""
    monkeypatch.setattr(grid_join, "TILE_BYTES", 1)
    monkeypatch.setattr(grid_join, "SAMPLE", 64)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6)) for i in range(900)]
    rows += [(2000 + i, rows[0][1] + rng.normal(size=6) * 1e-3) for i in range(300)]
    expected = brute(rows, 0.9)
    assert got(spark, rows, 0.9, "double") == expected


def test_cosine_of_exactly_the_threshold_links(spark):
    rows = [(1, [10.0, 0, 0, 0]), (2, [9.0, 3, 3, 1]), (3, [9.0, 3, 3, 1.0001]), (4, [-10.0, 0, 0, 0]), (5, [1e-200, 0, 0, 0]), (6, [1e200, 0, 0, 0])]
    found = {r[0]: r[1] for r in got(spark, rows, 0.9, "double")}
    assert found[2] >= 1 and found[4] == 0 and found[5] == found[6]


def test_distant_blocks_are_skipped():
    """Blocks on opposite sides are not compared."""
    rng = np.random.default_rng(1)
    x = np.repeat(np.array([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0], [-1.0, 0, 0]]), grid_join.BLOCK, 0) + rng.normal(size=(4 * grid_join.BLOCK, 3)) * 0.01
    tile = grid_join.Tile(0, len(x), x.astype("<f8").tobytes(), np.ones(len(x), "<i8").tobytes(), np.eye(3), np.dtype("<f8"))
    assert sorted(grid_join.near_blocks(tile, tile, 0.44)) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_empty_table(spark):
    assert grid_join.near_copies(frame(spark, [])).collect() == []
    assert got(spark, [(1, None), (2, [0.0])], 0.9) == [(1, 0, 1, True), (2, 0, 2, True)]
