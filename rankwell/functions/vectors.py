"""Arrays as vectors and id sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hadamard(u: Column | str, v: Column | str) -> Column:
    """Elementwise product in double precision."""
    return F.zip_with(_col(u), _col(v), lambda a, b: a.cast("double") * b.cast("double"))


def dot(u: Column | str, v: Column | str) -> Column:
    return F.aggregate(hadamard(u, v), F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column | str) -> Column:
    a = _col(logits)
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(a, lambda x: F.exp(x - top) / total)


def shift_ids(ids: Column | str, by: int = 1) -> Column:
    """Ids moved up so that zero is free for padding."""
    return F.transform(_col(ids), lambda x: x + by)


def left_pad(ids: Column | str, length: int, pad: int = 0) -> Column:
    """The last `length` ids, padded on the left."""
    a = _col(ids)
    size = F.size(a)
    tail = F.slice(a, F.greatest(size - length, F.lit(0)) + 1, length)
    return F.concat(F.array_repeat(F.lit(pad).cast("long"), F.greatest(length - size, F.lit(0))), tail)


def weighted_vectors(df: DataFrame, keys: list[str], vector: str, dim: int, weight: Column | None = None,
                     mean: bool = False, out: str = "vector") -> DataFrame:
    """Sum (or mean) of the vectors of each key; rows without a vector do not count.

    One aggregate over whole vectors, whatever their length: partial sums are made before the shuffle, so
    a key with very many rows sends one row per task.  `dim` is the length of the vectors.
    """
    numbers = F.col(vector).cast("array<double>")
    if weight is not None:
        numbers = F.transform(F.arrays_zip(numbers.alias("x"), F.array_repeat(weight.cast("double"), dim).alias("w")), lambda p: p["x"] * p["w"])
    rows = df.where(F.col(vector).isNotNull()).select(*keys, array_to_vector(numbers).alias("_v"))
    total = (Summarizer.mean if mean else Summarizer.sum)(F.col("_v"))
    return rows.groupBy(*keys).agg(vector_to_array(total).alias(out))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, dim: int, out: str = "vector") -> DataFrame:
    """Mean of the vectors of each key; rows without a vector do not count.

    Rows of a key that are close together are added up before the shuffle, so a key with very many rows
    sends few of them; the others are sent as they are, in the type of their numbers, and not as sums of one
    row.  After it rows lie in order of the key, and one sum is held at a time.  `dim` is the length of the
    vectors.
    """
    numbers = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    rows = df.where(F.col(vector).isNotNull()).select(*keys, numbers.alias("_one"))
    keyed = [StructField(k, rows.schema[k].dataType) for k in keys]
    total = [StructField("_sum", ArrayType(DoubleType())), StructField("_n", LongType())]
    sent = StructType([*keyed, StructField("_one", rows.schema["_one"].dataType), *total])
    parts = rows.mapInArrow(lambda batches: _added_near(batches, keys, dim), sent)
    sums = parts.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(
        lambda batches: _added_runs(batches, keys, dim), StructType([*keyed, *total]))
    return sums.select(*keys, F.transform("_sum", lambda x: x / F.col("_n")).alias(out))


#: Bytes of sums that a task makes at a time.
_SUM_BYTES = 64 << 20


def _shape(rows: pa.Table, keys: list[str], *more: str) -> pa.Schema:
    """Types of the columns that are passed on: all may be null, and sums are written in one way."""
    own = {"_sum": pa.list_(pa.float64()), "_n": pa.int64()}
    return pa.schema([pa.field(c, own[c] if c in own else rows.schema.field(c).type) for c in [*keys, *more]])


def _codes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Equal numbers for rows of equal keys, nulls included."""
    codes = np.zeros(rows.num_rows, "int64")
    for key in keys:
        column = rows.column(key).combine_chunks()
        one = (column if pa.types.is_dictionary(column.type) else column.dictionary_encode("encode")).indices.to_numpy()
        codes = np.unique(codes * (int(one.max()) + 1) + one, return_inverse=True)[1]
    return codes


def _numbers(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a column without nulls; a null inside them is 0."""
    flat = pc.fill_null(column.combine_chunks().flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def _added_near(batches: Iterator[pa.RecordBatch], keys: list[str], dim: int) -> Iterator[pa.RecordBatch]:
    """Rows that share their key with others nearby as their sum, the others as they are."""
    most = max(1, _SUM_BYTES // (8 * dim))
    for rows in _blocks(batches, most):
        codes = _codes(rows, keys)
        shape = _shape(rows, keys, "_one", "_sum", "_n")
        alone = np.bincount(codes)[codes] == 1
        single = rows.filter(pa.array(alone))
        none = pa.nulls(single.num_rows, pa.list_(pa.float64()))
        one = pa.array(np.ones(single.num_rows, "int64"))
        yield from single.append_column("_sum", none).append_column("_n", one).cast(shape).to_batches()
        if not alone.all():
            shared = rows.filter(pa.array(~alone))
            first, sums, n = _sums(shared, codes[~alone], dim)
            made = shared.take(pa.array(first))
            none = pa.nulls(len(first), shape.field("_one").type)
            yield from pa.table([*[made.column(k) for k in keys], none, _lists(sums), pa.array(n)], shape.names).cast(shape).to_batches()


def _added_runs(batches: Iterator[pa.RecordBatch], keys: list[str], dim: int) -> Iterator[pa.RecordBatch]:
    """One row per key of rows in order of the key; the last key of a block waits for the next one."""
    held = None
    for rows in _blocks(batches, max(1, _SUM_BYTES // (8 * dim))):
        shape, out = _shape(rows, keys, "_one", "_sum", "_n"), _shape(rows, keys, "_sum", "_n")
        rows = rows.select(shape.names).cast(shape)
        if held is not None:
            rows = pa.concat_tables([held, rows])
        codes = _codes(rows, keys)
        first, sums, n = _sums(rows, codes, dim)
        made = rows.take(pa.array(first))
        done = pa.table([*[made.column(k) for k in keys], _lists(sums), pa.array(n)], out.names).cast(out)
        last = np.unique(codes)[:len(first)] == codes[-1]
        yield from done.filter(pa.array(~last)).to_batches()
        kept = done.filter(pa.array(last))
        none = pa.nulls(1, shape.field("_one").type)
        held = pa.table([*[kept.column(k) for k in keys], none, kept.column("_sum"), kept.column("_n")], shape.names).cast(shape)
    if held is not None:
        yield from held.select(out.names).to_batches()


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows as tables of about `most` rows."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            held.append(whole.slice(at, most))
            if sum(b.num_rows for b in held) >= most:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _sums(rows: pa.Table, codes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code in order: a row of it, the sum of its vectors and how many they are."""
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    vectors = np.empty((rows.num_rows, dim))
    alone = rows.column("_one").is_valid().combine_chunks().to_numpy(zero_copy_only=False)
    vectors[alone] = _numbers(rows.column("_one").filter(pa.array(alone)), dim)
    n = np.ones(rows.num_rows, "int64")
    if not alone.all():
        vectors[~alone] = _numbers(rows.column("_sum").filter(pa.array(~alone)), dim)
        n = rows.column("_n").to_numpy()
    return order[starts], np.add.reduceat(vectors[order], starts), np.add.reduceat(n[order], starts)


def _lists(sums: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype="int32") * sums.shape[1]), pa.array(sums.ravel()))
