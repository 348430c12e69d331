"""Small helpers that several operators of this folder use."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are handled at once inside a task; one longer text is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """From now on this session hands rows to Python in batches of at most `most` bytes, whatever their number."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def one_of(characters: str, negated: bool = False) -> str:
    """A class of a regular expression that names every character by itself.

    The JVM tests such a class with one table; ranges are tested one after the other.
    """
    return "[" + "^" * negated + "".join(f"\\x{ord(c):02X}" for c in characters) + "]"


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose labels no model may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def narrow(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, cast to the given types; one that is missing is null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def per_worker(key: str, build: Callable[[], Any]) -> Any:
    """What `build` makes, kept in the Python worker for its next tasks; a worker keeps one such object.

    Functions travel to workers by value, so nothing of this package can hold it there.
    """
    holder = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker"))
    if getattr(holder, "key", None) != key:
        holder.value = None
        holder.key, holder.value = key, build()
    return holder.value


def nothing_kept() -> None:
    """Drop what `per_worker` holds in this Python worker."""
    sys.modules.pop("_kept_in_worker", None)
    gc.collect()  # what was kept may refer to itself


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each value starts (one more at the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, starts, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0]:starts[-1]], starts - starts[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `limit` bytes (or one longer row): first row, end row, bytes, starts."""
    data, starts = utf8(column)
    first, n = 0, len(starts) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, "right")) - 1)
        yield first, end, data[starts[first]:starts[end]], starts[first:end + 1] - starts[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def unmixed(x: np.ndarray) -> np.ndarray:
    """The numbers that `mix` scrambled."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(pow(0x81DADEF4BC2DD44D, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0x7FB5D329728EA185, -1, 1 << 64))
    return x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))


_BASE = 0x9E3779B97F4A7C15
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def running_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the powers that bring a difference of two back to position 0."""
    n = len(data)
    up = np.cumprod(np.full(n, _BASE, np.uint64))
    down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up, out=sums[1:])
    return sums, down


def span_hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, starts: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (bytes not in `blank`), and the number of words before each text."""
    inside = ~blank[data]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    cuts = starts[:-1][np.diff(starts) > 0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = cuts[1:] - 1
    last[ends] = inside[ends]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, starts)


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and the number of words before each text.

    A single text longer than a chunk is hashed in pieces that end between words, so memory per word
    stays small.
    """
    data = LOWER[data]
    begin, end, before = word_spans(data, starts, BLANK)
    out = np.empty(len(begin), np.uint64)
    low = 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(end, begin[low] + 2 * CHUNK_BYTES, "right")))
        sums, down = running_hash(data[begin[low]:end[high - 1]])
        out[low:high] = span_hash(sums, down, begin[low:high] - begin[low], end[low:high] - begin[low])
        low = high
    return out, before


def cut(batch: pa.RecordBatch | pa.Table, columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
