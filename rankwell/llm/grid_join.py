"""Near copies among vectors, by an epsilon grid order join.

Vectors of length 1 with a cosine of at least c are at most sqrt(2 - 2c) apart, their reach.

1. Equal vectors become one, with the number of its copies.
2. Vectors are turned to principal axes (fitted on a bounded sample; any axes give the same links).  The
   first ones cut space into cells narrower than the reach; the order of cells, axis by axis, is the grid
   order.  Every vector gets its place in it, range by range.
3. The sequence is cut into tiles of neighbouring places.  A tile has a box: least and largest coordinate on
   the leading axes, and of the length that those axes leave over.  Distances between boxes never exceed
   those between vectors.
4. Intervals of the sequence are joined recursively: from the pair of the whole sequence with itself, a
   pair of intervals goes over to the pairs of its eighths, unless the boxes are further apart than the
   reach.  A level is a join of written tables.  What is left are pairs of tiles.
5. A task joins a tile with up to four others.  It halves both sequences further, skips what is provably
   distant, and compares blocks of vectors by products in double precision.  It sends a row per vector with
   links: how many, and the root of the vector among those the task saw.
6. Links are summed, roots become components.

Defined cases: vectors that are null, empty, zero or hold a null or a component that is not finite, and rows
without a vec_id, link with nothing: no links, a component of their own (null without a vec_id), kept.
Vectors of different lengths never link.  Rows that repeat a vec_id are vectors of their own.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rankwell.functions.ordering import global_rank
from rankwell.llm.components import components
from rankwell.scratch import staged

#: Leading axes: the first ones make the cells, all of them the boxes.
CELL_AXES, BOX_AXES = 8, 16
#: Vectors from which the axes are fitted.
SAMPLE = 4_096
#: Bytes and vectors of a tile.
TILE_BYTES, TILE_ROWS = 2 << 20, 8_192
#: Vectors that are compared by one product.
BLOCK = 256
_FAN = 3  # bits of a step of the recursion
_GROUP = 4  # tiles that a tile meets in one task
_SLACK = 1e-9


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): the numbers as bytes, 8 or (for array<float>) 4 each; null where they cannot link."""
    kind = vectors.schema["embedding"].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    dtype = np.dtype("<f4" if narrow else "<f8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            out: list[bytes | None] = []
            for low in range(0, len(column), 1024):
                part = column.slice(low, 1024)
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.flatten()
                holes = flat.is_null().to_numpy(zero_copy_only=False)
                numbers = flat.to_numpy(zero_copy_only=False).astype(dtype)
                ends = np.cumsum(sizes)
                fit = np.isfinite(numbers) & ~holes
                wrong = np.r_[0, np.cumsum(~fit)]
                full = np.r_[0, np.cumsum(fit & (numbers != 0))]
                for a, b in zip(ends - sizes, ends):
                    good = wrong[a] == wrong[b] and full[b] > full[a]
                    out.append(numbers[a:b].tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    element = "float" if narrow else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    packed = rows.mapInArrow(pack, "vec_id long, vector binary")
    return packed.withColumn("vector", F.when(F.col("vec_id").isNotNull(), F.col("vector")))


def _numbers(raw: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(raw, dtype).reshape(n, -1).astype(np.float64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """By powers of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fitted_axes(distinct: DataFrame, dtype: np.dtype) -> dict[int, np.ndarray]:
    """Per size in bytes of a vector, its leading principal axes.

    The driver gets a row per size, and up to SAMPLE vectors (those of the smallest hashes) of each size
    that has as many; other sizes keep their own first axes.
    """
    axes = {}
    for size, n in distinct.groupBy(F.octet_length("vector")).count().collect():
        width = size // dtype.itemsize
        turn = np.eye(width)
        if n >= SAMPLE:
            rows = distinct.where(F.octet_length("vector") == size).orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").toArrow()
            x = _units(_numbers(b"".join(rows.column("vector").to_pylist()), SAMPLE, dtype))
            turn = np.linalg.eigh(np.cov(x.T))[1][:, ::-1] if width > 1 else turn
        axes[size] = np.ascontiguousarray(turn[:, :BOX_AXES])
    return axes


def _coordinates(units: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the leading axes, and the length of what they leave over."""
    at = units @ axes
    rest = np.sqrt(np.maximum(0, (units * units).sum(1) - (at * at).sum(1)))
    return np.concatenate((at, np.zeros((len(at), BOX_AXES - at.shape[1])), rest[:, None]), axis=1)


def grid_order(distinct: DataFrame, axes: dict[int, np.ndarray], dtype: np.dtype, reach: float, rows: int) -> DataFrame:
    """`distinct` with `size` and `place`, its place in the grid order."""
    shared = distinct.sparkSession.sparkContext.broadcast(axes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            keys = np.zeros((len(raw), 2), np.int64)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                which = np.flatnonzero(sizes == size)
                at = _coordinates(_units(_numbers(b"".join(raw[i] for i in which), len(which), dtype)), shared.value[size])
                # Cells of half the reach; 15 bits hold any number of cells that matters.
                cell = np.clip(np.floor(at[:, :CELL_AXES] * (2 / reach)), -16384, 16383).astype(np.int64) + 16384
                for k in range(CELL_AXES):
                    keys[which, k // 4] = (keys[which, k // 4] << 15) | cell[:, k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1])],
                names=[*batch.schema.names, "size", "cell_1", "cell_2"])

    keyed = staged(distinct.mapInArrow(cells, "vector binary, vec_id long, copies long, size int, cell_1 long, cell_2 long"), "cells")
    order = ["size", "cell_1", "cell_2", "vec_id"]
    return global_rank(keyed, order, "place", max(4, min(1024, rows // 16_384))).drop("cell_1", "cell_2")


def _tiles(placed: DataFrame, axes: dict[int, np.ndarray], dtype: np.dtype, rows: int) -> DataFrame:
    """A row per tile: its first place, its vectors and copies as bytes, and its box."""
    shared = placed.sparkSession.sparkContext.broadcast(axes)

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        n, size = group.num_rows, group.column("size")[0].as_py()
        raw = b"".join(group.column("vector").to_pylist())
        at = _coordinates(_units(_numbers(raw, n, dtype)), shared.value[size])
        return pa.table({
            "size": pa.array([size], pa.int32()), "tile": pa.array([group.column("tile")[0].as_py()], pa.int64()),
            "first": pa.array([group.column("place")[0].as_py()], pa.int64()), "n": pa.array([n], pa.int32()),
            "vectors": pa.array([raw], pa.binary()),
            "copies": pa.array([group.column("copies").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "low": pa.array([at.min(0).tolist()]), "high": pa.array([at.max(0).tolist()])})

    return placed.withColumn("tile", F.floor(F.col("place") / rows)).groupBy("size", "tile").applyInArrow(
        build, "size int, tile long, first long, n int, vectors binary, copies binary, low array<double>, high array<double>")


def _apart(a_low: str, a_high: str, b_low: str, b_high: str) -> Column:
    """The squared distance of two boxes."""
    gaps = F.transform(F.sequence(F.lit(0), F.lit(BOX_AXES)), lambda i: F.greatest(
        F.lit(0.0), F.get(a_low, i) - F.get(b_high, i), F.get(b_low, i) - F.get(a_high, i)))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)


def _coarser(boxes: DataFrame) -> DataFrame:
    """Boxes of the intervals of eight nodes."""
    sides = [f(F.col(c)[i]).alias(f"{c}_{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(BOX_AXES + 1)]
    up = boxes.groupBy("size", F.shiftright("node", _FAN).alias("node")).agg(*sides)
    return up.select("size", "node", *[F.array(*[F.col(f"{c}_{i}") for i in range(BOX_AXES + 1)]).alias(c) for c in ("low", "high")])


def tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """(size, a, b) with a <= b: the pairs of tiles that the recursion from the whole sequence leaves."""
    levels = [staged(tiles.select("size", F.col("tile").alias("node"), "low", "high"), "boxes")]
    last = levels[0].agg(F.max("node")).collect()[0][0] or 0
    while last:
        last >>= _FAN
        levels.append(staged(_coarser(levels[-1]), "boxes"))
    pairs = levels[-1].select("size", F.col("node").alias("a"), F.col("node").alias("b"))
    for boxes in reversed(levels[:-1]):
        x, y = (boxes.select("size", F.shiftright("node", _FAN).alias(up), F.col("node").alias(f"n{up}"),
                             F.col("low").alias(f"l{up}"), F.col("high").alias(f"h{up}")) for up in "ab")
        met = pairs.join(x, ["size", "a"]).join(y, ["size", "b"]).where("na <= nb")
        pairs = staged(met.where(_apart("la", "ha", "lb", "hb") <= reach * reach + _SLACK).select(
            "size", F.col("na").alias("a"), F.col("nb").alias("b")), "tile-pairs")
    return pairs


class Tile:
    """Vectors of one tile inside a task, with the boxes of its blocks."""

    def __init__(self, first: int, n: int, vectors: bytes, copies: bytes, axes: np.ndarray, dtype: np.dtype):
        self.first, self.n = first, n
        self.plain = _scaled(_numbers(vectors, n, dtype))
        self.units = _units(self.plain)
        self.copies = np.frombuffer(copies, "<i8").astype(np.float64)
        at = _coordinates(self.units, axes)
        edges = np.arange(0, n, BLOCK)
        self.low, self.high = np.minimum.reduceat(at, edges), np.maximum.reduceat(at, edges)


def near_blocks(a: Tile, b: Tile, reach: float) -> Iterator[tuple[int, int]]:
    """Pairs of blocks that are not provably distant; both sequences are halved, the longer one first."""
    same = a is b
    waiting = [(0, len(a.low), 0, len(b.low))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        if same and b1 <= a0:
            continue
        gap = np.maximum(0, np.maximum(a.low[a0:a1].min(0) - b.high[b0:b1].max(0), b.low[b0:b1].min(0) - a.high[a0:a1].max(0)))
        if gap @ gap > reach * reach + _SLACK:
            continue
        if a1 - a0 == 1 and b1 - b0 == 1:
            if not same or a0 <= b0:
                yield a0, b0
        elif a1 - a0 >= b1 - b0:
            middle = (a0 + a1) // 2
            waiting += [(a0, middle, b0, b1), (middle, a1, b0, b1)]
        else:
            middle = (b0 + b1) // 2
            waiting += [(a0, a1, b0, middle), (a0, a1, middle, b1)]


class Found:
    """Links and roots of the vectors of a tile and of those it meets."""

    def __init__(self, own: Tile, threshold: float, reach: float):
        self.own, self.threshold, self.reach = own, threshold, reach
        self.links = np.zeros(own.n)
        self.root = np.arange(own.first, own.first + own.n)

    def meet(self, other: Tile) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Compare with `other`; yields (place, links, root) of its vectors that have links."""
        own, same = self.own, other is self.own
        # Roots of both tiles as one forest over places.
        places = np.r_[own.first + np.arange(own.n), () if same else other.first + np.arange(other.n)].astype(np.int64)
        parent = np.arange(len(places))
        links = np.zeros(len(places))
        shift = 0 if same else own.n
        for i, j in near_blocks(own, other, self.reach):
            x, y = slice(i * BLOCK, min(own.n, (i + 1) * BLOCK)), slice(j * BLOCK, min(other.n, (j + 1) * BLOCK))
            product = own.units[x] @ other.units[y].T
            near = product >= self.threshold + _SLACK
            for u, v in zip(*np.nonzero(np.abs(product - self.threshold) < _SLACK)):  # decided by the plain formula
                p, q = own.plain[x.start + u], other.plain[y.start + v]
                near[u, v] = np.dot(p, q) / (np.sqrt(np.dot(p, p)) * np.sqrt(np.dot(q, q))) >= self.threshold
            if same and i == j:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            links[x.start:x.stop] += near @ other.copies[y]
            if not (same and i == j):
                links[shift + y.start:shift + y.stop] += near.T @ own.copies[x]
            u, v = np.nonzero(near)
            both = np.unique(np.stack((parent[x.start + u], parent[shift + y.start + v]), 1), axis=0)
            for p, q in both[both[:, 0] != both[:, 1]].tolist():
                while parent[p] != p:
                    p = int(parent[p])
                while parent[q] != q:
                    q = int(parent[q])
                parent[max(p, q)] = min(p, q)
            while (up := parent[parent] != parent).any():
                parent[up] = parent[parent[up]]
        has = np.flatnonzero(links)
        if len(has):
            yield places[has], links[has].astype(np.int64), places[parent[has]]


def tile_links(tiles: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], dtype: np.dtype, threshold: float, reach: float) -> DataFrame:
    """(place, links, root): per task, the vectors with links, how many (copies counted) and a place they reach."""
    spark = tiles.sparkSession
    shared = spark.sparkContext.broadcast(axes)
    content = ["size", "first", "n", "vectors", "copies"]
    units = pairs.select("size", "a", F.floor(F.col("b") / _GROUP).alias("g")).distinct()
    of_a = tiles.select(F.col("tile").alias("a"), *content)
    of_b = tiles.select(F.col("tile").alias("b"), *content)
    own = units.join(of_a, ["size", "a"]).select(
        "a", "g", (F.col("g") == F.floor(F.col("a") / _GROUP)).cast("int").alias("step"), *content)
    others = pairs.where("a < b").join(of_b, ["size", "b"]).select(
        "a", F.floor(F.col("b") / _GROUP).alias("g"), F.lit(2).alias("step"), *content)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("a", "g", "step", *content)}
                tile = Tile(row["first"], row["n"], row["vectors"], row["copies"], shared.value[row["size"]], dtype)
                if row["step"] < 2:
                    key, state = (row["size"], row["a"], row["g"]), Found(tile, threshold, reach)
                assert key == (row["size"], row["a"], row["g"])
                for place, links, root in state.meet(tile) if row["step"] else ():
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(links), pa.array(root)], names=["place", "links", "root"])

    # A batch holds a task's rows, so a task gets few; tiles and pairs were written, so their counts are at hand.
    tasks = max(1, -(-pairs.count() // 8))
    dealt = own.unionByName(others).repartition(tasks, "size", "a", "g").sortWithinPartitions("size", "a", "g", "step")
    return dealt.select("a", "g", "step", *content).mapInArrow(join, "place long, links long, root long")


def near_copies(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding).

    `n_links` other vectors have a cosine of `threshold` (above 0) or more; `component_id` is the smallest
    vec_id reachable by links; kept are the rows with that id.
    """
    kind = vectors.schema["embedding"].dataType
    dtype = np.dtype("<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8")
    reach = float(np.sqrt(2 - 2 * threshold)) + _SLACK
    rows = staged(packed_vectors(vectors), "vectors")
    distinct = staged(rows.where("vector is not null").groupBy("vector").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "distinct")
    axes = fitted_axes(distinct, dtype)
    count = distinct.count()
    placed = staged(grid_order(distinct, axes, dtype, reach, count), "placed")
    tile_rows = max(64, min(TILE_ROWS, TILE_BYTES // max(axes, default=1)))
    tiles = staged(_tiles(placed, axes, dtype, tile_rows), "tiles")
    found = staged(tile_links(tiles, tile_pairs(tiles, reach), axes, dtype, threshold, reach), "tile-links")
    sums = found.groupBy("place").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("place").alias("a"), F.col("root").alias("b")))
    known = placed.select(F.md5("vector").alias("key"), "place", "vec_id", "copies")
    known = known.join(sums, "place", "left").join(roots.withColumnRenamed("node", "place"), "place", "left").select(
        "key", "vec_id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "place").alias("component"))
    known = staged(known, "known")
    least = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = known.join(least, "component").select("key", "n_links", "component_id")
    return rows.select("vec_id", F.md5("vector").alias("key")).join(known, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
