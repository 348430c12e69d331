import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.operators import core, knn


def interactions(seed=1, users=60, items=37, rows=500, hub=True):
    rng = np.random.default_rng(seed)
    data = [(int(u), int(i), float(r)) for u, i, r in zip(
        rng.integers(1, users, rows), (rng.pareto(1.0, rows) * 3).astype(int) % items, rng.integers(1, 6, rows))]
    if hub:  # one user with every item, and one item with a third of the rows
        data += [(0, i, 1.0 + i % 5) for i in range(items)]
        data += [(int(u), 5, 3.0) for u in rng.integers(1, users, rows // 2)]
    return data


def matrix(data, users=60, items=37):
    m = np.zeros((users, items))
    for u, i, r in data:
        m[u, i] += r
    return m


def frame(spark, data):
    return spark.createDataFrame(data, "user_id long, item_id long, rating double")


@pytest.mark.parametrize("tile,per_group", [(1024, 10**6), (5, 10**6), (4, 7), (1, 20)])
def test_dots_match_matrix_product(spark, tile, per_group):
    data = interactions()
    m = matrix(data)
    pairs = core.sum_pairs(frame(spark, data))
    got = knn.item_cooccurrence(pairs, "rating", tile, per_group).collect()
    gram = m.T @ m
    expected = {(a, b): gram[a, b] for a in range(37) for b in range(a + 1, 37) if gram[a, b] > 0}
    assert {(r.item_a, r.item_b): r.dot for r in got} == expected
    shared = {(r.item_a, r.item_b): r.dot for r in knn.item_cooccurrence(pairs, None, tile, per_group).collect()}
    assert shared == {k: float(((m[:, k[0]] > 0) & (m[:, k[1]] > 0)).sum()) for k in expected}


@pytest.mark.parametrize("width,step", [(37, 10), (37, 10**6), (4, 10), (4, 10**6), (9, 300)])
def test_sums_in_steps_dense_and_sparse(monkeypatch, width, step):
    # Small steps cut a batch of rows, and a single long row, in several pieces; tile pairs go over batches.
    import pyarrow as pa

    m = matrix(interactions(2))
    monkeypatch.setattr(knn, "_STEP", step)
    tiles = -(-37 // width)
    kind = pa.list_(pa.struct([("local", pa.int64()), ("weight", pa.float64()), ("norm", pa.float64())]))

    def listed(u, t):
        return [{"local": int(i) // tiles, "weight": m[u, i], "norm": float(i + 1)} for i in np.flatnonzero(m[u]) if i % tiles == t]

    rows = [(ta * tiles + tb, listed(u, ta), listed(u, tb)) for ta in range(tiles) for tb in range(ta, tiles) for u in range(60)]
    rows = [r for r in rows if r[1] and r[2]]
    whole = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], kind)],
        ["pair", "a", "b"])
    got = {}
    for keys, sums, norms in knn._cell_sums((whole.slice(at, 7) for at in range(0, len(rows), 7)), width):
        for key, value, norm in zip(keys.tolist(), sums, norms):
            pair, cell = divmod(key, width * width)
            a, b = cell // width * tiles + pair // tiles, cell % width * tiles + pair % tiles
            assert (a, b) not in got and norm == (a + 1) * (b + 1)
            got[a, b] = value
    gram = m.T @ m
    assert got == {(a, b): gram[a, b] for a in range(37) for b in range(37) if gram[a, b] and a % tiles <= b % tiles}


def test_user_in_many_tiles_is_dealt_to_salts(spark, monkeypatch):
    monkeypatch.setattr(knn, "TILES_TOGETHER", 4)
    data = interactions(3)
    m = matrix(data)
    pairs = core.sum_pairs(frame(spark, data))
    cells = pairs.select("user_id", "item_id", F.col("rating").alias("weight"), F.lit(1.0).alias("norm"))
    left, right, _ = knn._meetings(knn._tile_lists(cells, 37))
    salts = {r.salt: r["count"] for r in left.where("user_id = 0").groupBy("salt").count().collect()}
    assert len(salts) >= 7 and sum(salts.values()) == 37 and max(salts.values()) < 15
    assert right.where("user_id = 0").count() == 37 * 10
    got = {(r.item_a, r.item_b): r.dot for r in knn.item_cooccurrence(pairs, "rating", 1).collect()}
    gram = m.T @ m
    assert got == {(a, b): gram[a, b] for a in range(37) for b in range(a + 1, 37) if gram[a, b] > 0}


def test_one_user_with_more_items_than_a_tile(spark):
    # All similarities are equal, so ties go to the smallest ids across tiles and tasks.
    pairs = spark.range(150).selectExpr("0L as user_id", "id as item_id", "2.0D as rating")
    for per_group in (1, 10**6):
        got = knn.nearest_items(pairs, 3, 16, per_group).where("item_id in (0, 70)").orderBy("item_id", "rank").collect()
        assert [r.neighbour for r in got] == [1, 2, 3, 0, 1, 2] and all(r.sim == pytest.approx(1.0) for r in got)


def test_zero_ratings_and_no_rows(spark):
    data = [(0, 0, 0.0), (0, 1, 2.0), (1, 0, 0.0), (1, 1, 3.0), (1, 2, 1.0)]
    assert {(r.item_id, r.neighbour) for r in knn.nearest_items(frame(spark, data), 5).collect()} == {(1, 2), (2, 1)}
    assert knn.nearest_items(frame(spark, []), 5).collect() == []


def test_work_follows_the_products_and_not_the_items(spark, monkeypatch):
    # 98 x 98 tiles with a few products each: no dense block is made.
    made = []
    zeros = np.zeros
    monkeypatch.setattr(knn.np, "zeros", lambda *a, **k: made.append(a) or zeros(*a, **k))
    import pyarrow as pa

    kind = pa.list_(pa.struct([("local", pa.int64()), ("weight", pa.float64()), ("norm", pa.float64())]))
    one = pa.array([[{"local": 3, "weight": 1.0, "norm": 1.0}]] * 5000, kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), one, one], ["pair", "a", "b"])
    assert sum(len(keys) for keys, _, _ in knn._cell_sums(iter([batch]), 1024)) == 5000 and not made


def sims_of(m):
    norms = np.sqrt((m * m).sum(axis=0))
    with np.errstate(invalid="ignore", divide="ignore"):
        s = (m.T @ m) / np.outer(norms, norms)
    s = np.nan_to_num(s)
    np.fill_diagonal(s, 0)
    return s


def neighbours_of(m, k):
    s = sims_of(m)
    out = np.zeros_like(s)
    for i in range(len(s)):
        order = sorted(range(len(s)), key=lambda j: (-round(s[i, j], 9), j))
        for j in order[:k]:
            out[i, j] = s[i, j]
    return out


@pytest.mark.parametrize("tile,per_group", [(8, 10**6), (8, 9), (1, 10**6), (64, 10**6)])
def test_neighbour_lists_without_all_pairs(spark, tile, per_group):
    data = interactions(6)
    pairs = core.sum_pairs(frame(spark, data))
    key = lambda df: sorted((r.item_id, r["rank"], r.neighbour, round(r.sim, 12)) for r in df.collect())
    assert key(knn.nearest_items(pairs, 4, tile, per_group)) == key(knn.topk_neighbours(knn.item_cosine(pairs, tile, per_group), 4))


def test_neighbour_lists_and_scores(spark):
    data = interactions(4)
    m, k = matrix(data), 6
    train = frame(spark, data)
    lists = knn.itemknn_fit(train, k, tile=8)
    top = neighbours_of(m, k)
    got = np.zeros_like(top)
    for r in lists.collect():
        got[r.item_id, r.neighbour] = r.sim
    assert np.allclose(got, top) and lists.groupBy("item_id").count().agg(F.max("count")).first()[0] == k

    pairs = spark.createDataFrame([(u, i, f"{u}-{i}") for u in range(62) for i in range(40)], "user_id long, item_id long, row string")
    history = core.sum_pairs(train)
    for weighted in (True, False):
        expected = top @ (m if weighted else (m > 0)).T
        for way in ("history", "pairs", "auto"):
            scored = knn.itemknn_score(pairs, lists, history, weighted, per_row_work=way).collect()
            assert len(scored) == 62 * 40
            for r in scored:
                inside = r.user_id < 60 and r.item_id < 37
                assert r.score == pytest.approx(expected[r.item_id, r.user_id] if inside else 0.0, abs=1e-8)


def test_recommendations_use_the_history_side_lists(spark):
    data = interactions(5)
    m, k = matrix(data), 5
    train = frame(spark, data)
    lists = knn.itemknn_fit(train, k)
    scores = neighbours_of(m, k).T @ m.T
    assert not np.allclose(neighbours_of(m, k), neighbours_of(m, k).T)
    history = core.sum_pairs(train)
    for without_seen in (True, False):
        got = {}
        for r in knn.itemknn_recommend(train, lists, history, 4, without_seen, fill_from=0).collect():
            got.setdefault(r.user_id, []).append((r["rank"], r.item_id))
        for u in range(60):
            open_items = [i for i in range(37) if scores[i, u] > 1e-12 and not (without_seen and m[u, i] > 0)]
            best = sorted(open_items, key=lambda i: (-round(scores[i, u], 9), i))[:4]
            assert [i for _, i in sorted(got.get(u, []))] == best


def test_short_lists_are_filled(spark):
    # User 9 is known to nobody, user 0 has all items but one.
    data = [(0, i, 1.0) for i in range(7)] + [(1, 0, 2.0), (1, 3, 1.0), (2, 5, 1.0)]
    train = frame(spark, data)
    users = spark.createDataFrame([(0,), (1,), (2,), (9,)], "user_id long")
    lists = knn.itemknn_fit(train, 2)
    history = core.sum_pairs(train)
    plain, full = {}, {}
    for out, fill in ((plain, 0), (full, 8)):
        for r in knn.itemknn_recommend(users, lists, history, 4, fill_from=fill).collect():
            out.setdefault(r.user_id, []).append((r["rank"], r.item_id, r.score))
    seen = {u: {i for v, i, _ in data if v == u} for u in (0, 1, 2, 9)}
    for u in (0, 1, 2, 9):
        got = sorted(full[u])
        listed = sorted(plain.get(u, []))
        assert got[:len(listed)] == listed
        rest = [i for i in range(8) if i not in seen[u] and i not in {x[1] for x in listed}][:4 - len(listed)]
        assert [(r, i) for r, i, _ in got[len(listed):]] == [(len(listed) + 1 + n, i) for n, i in enumerate(rest)]
    assert [i for _, i, _ in sorted(full[0])] == [7] and len(full[9]) == 4


def test_rating_prediction(spark):
    data = interactions(6)
    train = frame(spark, data)
    pairs = {}
    for u, i, r in data:
        pairs.setdefault((u, i), []).append(r)
    m = np.zeros((60, 37))
    for (u, i), r in pairs.items():
        m[u, i] = np.mean(r)
    lists = knn.itemknn_fit(train, 5, "mean")
    top = np.zeros((37, 37))
    for r in lists.collect():
        top[r.item_id, r.neighbour] = r.sim
    overall = np.mean([r for _, _, r in data])
    asked = spark.createDataFrame([(u, i) for u in range(61) for i in range(37)], "user_id long, item_id long")
    for r in knn.itemknn_rating(asked, lists, train).collect():
        expected = overall
        if r.user_id < 60:
            weight = (top[r.item_id] * (m[r.user_id] > 0)).sum()
            if weight > 0:
                expected = (top[r.item_id] * m[r.user_id]).sum() / weight
        assert r.predicted == pytest.approx(min(max(expected, 1), 5), abs=1e-6)


@pytest.mark.parametrize("longest,products,step", [(4096, 4_000_000, 10**6), (5, 60, 40), (3, 400, 7)])
def test_parts_hold_all_of_an_items_pairs(spark, monkeypatch, longest, products, step):
    # Few of many possible pairs share a user: lists go to parts, whatever the number of users, and nothing is added up later.
    data = [(u, i * 40 + 3, r) for u, i, r in interactions(4)]
    monkeypatch.setattr(knn, "LIST", longest)
    monkeypatch.setattr(knn, "PART_PRODUCTS", products)
    monkeypatch.setattr(knn, "_STEP", step)
    monkeypatch.setattr(knn, "_tile_products", lambda *a: pytest.fail("tiles taken"))
    m = matrix([(u, i, r) for u, i, r in data], items=37 * 40)
    gram = m.T @ m
    pairs = core.sum_pairs(frame(spark, data))
    dots = knn.item_cooccurrence(pairs, "rating", users_per_group=7).collect()
    assert len(dots) == len({(r.item_a, r.item_b) for r in dots})
    assert {(r.item_a, r.item_b): r.dot for r in dots} == {
        (a, b): gram[a, b] for a, b in zip(*np.nonzero(np.triu(gram, 1)))}
    norms = np.sqrt(np.diag(gram))
    expected = set()
    for a in np.flatnonzero(norms):
        near = [(-round(gram[a, b] / (norms[a] * norms[b]), 9), b) for b in np.flatnonzero(gram[a]) if a != b]
        expected |= {(a, b, n) for n, (_, b) in enumerate(sorted(near)[:4], 1)}
    got = knn.nearest_items(pairs, 4, users_per_group=7).collect()
    assert {(r.item_id, r.neighbour, r.rank) for r in got} == expected
    assert all(abs(r.sim - gram[r.item_id, r.neighbour] / (norms[r.item_id] * norms[r.neighbour])) < 1e-12 for r in got)


def test_parts_leave_out_rows_without_ids_and_keep_fractions(spark):
    data = [(1, 1, 0.1), (1, 900, 0.7), (2, 1, 0.3), (2, 900, 0.2), (None, 1, 1.0), (None, 5, 1.0), (2, None, 1.0)]
    pairs = frame(spark, data)
    (row,) = knn.item_cooccurrence(pairs, "rating").collect()
    assert (row.item_a, row.item_b) == (1, 900) and abs(row.dot - 0.13) < 1e-15
    assert {(r.item_id, r.neighbour) for r in knn.nearest_items(pairs).collect()} == {(1, 900), (900, 1)}
