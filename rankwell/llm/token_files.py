"""Token ids in binary shards with a minimal perfect hash index from document keys to places.

A shard is one file: the ids of its documents one after the other, each document closed by the end id,
little-endian unsigned 16 bit if the vocabulary fits and else 32 bit; then a footer with the document
keys and lengths, its number of entries, and a magic number.  Shards are range partitions of the key, so
file order and order inside a file are ascending key order.  Files are written with Spark's text sink,
whose record separator is the end id, and read with its binary file source; both reach any store that
Spark reaches.

The index has one row per bucket of keys: a small table of seeds that sends every key of the bucket to
a slot of its own (no slot is empty), and the slots: a stored fingerprint of the key, shard, first
record, number of records, offset and number of ids.  A key is found by one bucket row, one seed and one
slot, whatever the number of keys; a key that was never written fails the fingerprint (2^-32 aside).

Defined cases: null texts count as empty and yield the end id alone.  Rows that repeat a key are records
of one key, in the order of their text hashes, and stay in one shard.  Rows without a key come first, as
in ascending order, and are not in the index.  An empty table gives no shard and an empty index.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankwell.llm.shared import bounded_batches, chunks, mix, narrow, nothing_kept, per_worker
from rankwell.scratch import staged

#: Text bytes per shard; a shard's ids take about two thirds of it.
SHARD_BYTES = 40 << 20
#: Keys per bucket of the index, on average.
BUCKET_KEYS = 1024
#: Different words that a worker remembers with their ids (about 200 bytes each).
KNOWN_WORDS = 600_000
_MAGIC = 0x52574C31
_NO_KEY = -(1 << 63)
_SLOT = np.dtype([("mark", "<u4"), ("shard", "<i4"), ("record", "<i4"), ("times", "<i4"), ("offset", "<i8"), ("n", "<i8")])


#: The parts of a definition under which a letter run, a digit and a run of other signs are pieces of their own.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words that such a definition cuts by kind of sign alone (no apostrophe), and their pieces in lower case.
_EASY = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-/:-`{-~]+")


class _Encoder:
    """Ids of texts by the tokenizers library, which sees every word once.

    Words are cut at white space, which this kind of tokenizer drops.  Words of ASCII and Latin-1 signs are
    cut into the pieces that the definition makes of them and go to the library's model piece by piece;
    other words, and all words under another definition, go to its encode, joined by a special token, so
    every word is encoded as if it stood alone.  Texts for which that would not be the same (they hold the
    start of a special token or separators that only Python takes for white space) are encoded as they are.
    """

    def __init__(self, definition: str, kind: str, join: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.kind, self.join, self.mark = kind, join, self.tokenizer.token_to_id(join)
        self.sign = "H" if kind == "<u2" else "I"
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        parts = json.loads(definition)
        cuts = (parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_piece = (
            [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])] == _NORMALIZERS
            and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _SPLIT}
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"])
        # The model reads bytes in the letters that stand for them.
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.model = self.tokenizer.model
        self.piece = lru_cache(1 << 16)(self._piece)

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.as_bytes))]
        return struct.pack(f"<{len(ids)}{self.sign}", *ids)

    def _learn(self, words: set[str]) -> None:
        known = self.known
        rest = []
        for w in words:
            if (ids := self.before.get(w)) is not None:
                known[w] = ids
            elif self.by_piece and w.isascii() and w.isalpha():
                known[w] = self._piece(w.lower())
            elif self.by_piece and _EASY.fullmatch(w):
                known[w] = b"".join(map(self.piece, _PIECES.findall(w.lower())))
            else:
                rest.append(w)
        for low in range(0, len(rest), 4096):
            part = rest[low:low + 4096]
            ids = np.array(self.tokenizer.encode(self.join.join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            packed = ids.astype(self.kind)
            for w, a, b in zip(part, np.concatenate(([0], ends + 1)), np.concatenate((ends, [len(ids)]))):
                known[w] = packed[a:b].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS // 2:
            # Words that are still in use move to the new table as they are met.
            self.known, self.before = {}, self.known
        odd = {i for i, t in enumerate(texts) if "<|" in t or any(c in t for c in "\x1c\x1d\x1e\x1f")}
        words = [[] if i in odd else t.split() for i, t in enumerate(texts)]
        self._learn(set().union(*words).difference(self.known))
        return [self.plain(t) if i in odd else b"".join(map(self.known.__getitem__, own))
                for i, (t, own) in enumerate(zip(texts, words))]


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, join: str = "<|endoftext|>",
                       shard_bytes: int = SHARD_BYTES) -> str:
    """Write the shards of `docs` (doc_id, text) below `path`; returns the number type of the ids."""
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    kind = "<u2" if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else "<u4"
    docs = narrow(docs, {"doc_id": "long", "text": "string"})
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(definition)
    name = f"encoder-{zlib.crc32(definition.encode())}-{kind}-{join}"
    end = np.array([end_id], kind).tobytes()
    width = len(end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One encoder per Python worker: its next tasks go on with the words that it has met.
        encoder = per_worker(name, lambda: _Encoder(shared.value, kind, join))
        keys: list[int] = []
        lengths: list[int] = []
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_KEY).to_pylist()
            for first, last, _, _ in chunks(batch.column("text")):
                texts = [t or "" for t in batch.column("text").slice(first, last - first).to_pylist()]
                coded = encoder.encode(texts)
                keys += ids[first:last]
                lengths += [len(c) // width + 1 for c in coded]
                # The sink closes the record, and so its last document, with the end id.
                yield pa.RecordBatch.from_arrays([pa.array([end.join(coded)], pa.binary())], names=["value"])
        if keys:
            foot = np.array(keys, "<i8").tobytes() + np.array(lengths, "<i8").tobytes() + np.array([len(keys), _MAGIC], "<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([foot], pa.binary())], names=["value"])

    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    shards = max(1, -(-size // shard_bytes))
    # With one shard, a range partition would still sample the rows.
    dealt = docs.repartitionByRange(shards, "doc_id") if shards > 1 else docs.coalesce(1)
    (
        dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
        .mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", end.decode("latin-1")).text(path)
    )
    return kind


def read_token_shards(spark: SparkSession, path: str, kind: str, end_id: int = 2) -> DataFrame:
    """(doc_id, shard, record, offset, n, ids_crc32) for every record, read from the shard files.

    `offset` counts the ids of the shard before the record; the checksum is that of the ids as unsigned
    32-bit numbers.
    """
    width = np.dtype(kind).itemsize

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()  # all words are encoded; this worker has no more use for them
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_buffer()  # a shard is read in place, not copied
                size = raw.size - width  # without the separator after the footer
                count, magic = np.frombuffer(raw, "<i8", 2, size - 16)
                if magic != _MAGIC:
                    raise ValueError(f"{name} is not a token shard")
                foot = np.frombuffer(raw, "<i8", 2 * count, size - 16 - 16 * count).copy()
                keys, lengths = foot[:count], foot[count:]
                ids = np.frombuffer(raw, kind, (size - 16 - 16 * count) // width)
                ends = np.cumsum(lengths)
                if len(ids) != ends[-1] or (ids[ends - 1] != end_id).any():
                    raise ValueError(f"{name} is damaged")
                starts = ends - lengths
                shard = int(name.rsplit("/part-", 1)[1].split("-", 1)[0])
                for low in range(0, count, 4096):
                    part = slice(low, low + 4096)
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[part], ends[part])]
                    own = keys[part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == _NO_KEY), pa.array(np.full(len(own), shard, np.int32)),
                         pa.array(np.arange(low, low + len(own), dtype=np.int32)), pa.array(starts[part]), pa.array(lengths[part]),
                         pa.array(sums, pa.int64())], names=["doc_id", "shard", "record", "offset", "n", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(
        parse, "doc_id long, shard int, record int, offset long, n long, ids_crc32 long")


def shard_starts(records: DataFrame) -> DataFrame:
    """(shard, before): ids in all shards before this one.  Sums go by groups of 1024 shards, then inside them."""
    sizes = records.groupBy("shard").agg(F.sum("n").alias("ids")).withColumn("grp", (F.col("shard") / 1024).cast("int"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("grp").agg(F.sum("ids").alias("ids")).select(
        "grp", F.coalesce(F.sum("ids").over(before(Window.orderBy("grp"))), F.lit(0)).alias("_g"))
    inside = F.coalesce(F.sum("ids").over(before(Window.partitionBy("grp").orderBy("shard"))), F.lit(0))
    return sizes.withColumn("_i", inside).join(groups, "grp").select("shard", (F.col("_g") + F.col("_i")).alias("before"))


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) ^ mix(np.array([seed], np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _small(n: int) -> int:
    """Seeds per bucket: one for four keys."""
    return max(1, -(-n // 4))


def perfect_seeds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds that place distinct `keys` in len(keys) slots without a collision, and the slot of each key.

    Keys share a seed in small sets; the largest sets look for a seed first, while most slots are free.
    """
    n = len(keys)
    seeds = np.zeros(_small(n), np.uint32)
    home = (_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(len(seeds) + 1))
    slot = np.full(n, -1, np.int64)
    taken = np.zeros(n, bool)
    for s in np.argsort(-np.diff(edges), kind="stable"):
        own = order[edges[s]:edges[s + 1]]
        if not len(own):
            break
        tried = 1
        while True:
            # A run of seeds at once: more of them as slots get scarce.
            run = np.arange(tried, tried + max(16, n // max(1, n - int(taken.sum()))), dtype=np.uint64)
            salt = mix(run + np.uint64(0x9E3779B97F4A7C15))
            at = (mix(keys[own].astype(np.uint64)[None, :] ^ salt[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(axis=1)
            if len(own) > 1:
                low = np.sort(at, axis=1)
                good &= (low[:, 1:] != low[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[s], slot[own] = run[k], at[k]
                taken[at[k]] = True
                break
            tried += len(run)
    return seeds, slot


def slots_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    home = (_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    salt = mix(seeds[home].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (mix(keys.astype(np.uint64) ^ salt) % np.uint64(n)).astype(np.int64)


def _mark(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0xF17E) >> np.uint64(32)).astype(np.uint32)


def build_index(records: DataFrame, path: str) -> int:
    """Write the index of `records` (doc_id, shard, record, offset, n) below `path`; returns its number of buckets."""
    keys = records.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.struct("shard", "record", "offset", "n")).alias("_f"), F.count("*").cast("int").alias("times"))
    buckets = max(1, keys.count() // BUCKET_KEYS)

    def build(group: pa.Table) -> pa.Table:
        own = group.column("doc_id").to_numpy()
        seeds, slot = perfect_seeds(own)
        rows = np.zeros(len(own), _SLOT)
        for name in ("shard", "record", "times", "offset", "n"):
            rows[name][slot] = group.column(name).to_numpy()
        rows["mark"][slot] = _mark(own)
        return pa.table({"bucket": group.column("bucket")[:1], "keys": pa.array([len(own)], pa.int32()),
                         "seeds": pa.array([seeds.tobytes()], pa.binary()), "slots": pa.array([rows.tobytes()], pa.binary())})

    keys.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "_f.*", "times").groupBy(
        "bucket").applyInArrow(build, "bucket long, keys int, seeds binary, slots binary").write.parquet(path)
    return buckets


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, shard, record, times, offset, n) of those distinct `keys` (doc_id) that the index holds."""
    asked = keys.where("doc_id is not null").select("doc_id").distinct().withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))

    def find(asked: pa.Table, index: pa.Table) -> pa.Table:
        own = asked.column("doc_id").to_numpy().astype(np.int64)
        if len(own) and index.num_rows:
            rows = np.frombuffer(index.column("slots")[0].as_py(), _SLOT)
            seeds = np.frombuffer(index.column("seeds")[0].as_py(), np.uint32)
            rows = rows[slots_of(own, seeds, len(rows))]
            good = rows["mark"] == _mark(own)
            own, rows = own[good], rows[good]
        else:
            own, rows = own[:0], np.zeros(0, _SLOT)
        return pa.table({"doc_id": pa.array(own, pa.int64())} | {
            c: pa.array(np.ascontiguousarray(rows[c]).astype(np.int64)) for c in ("shard", "record", "times", "offset", "n")})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(
        find, "doc_id long, shard long, record long, times long, offset long, n long")


def token_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write shards and index of `docs` below `folder`, read them back: (doc_id, start, n_tokens, ids_crc32) per row.

    Every keyed row is found through the index; the others are read in place.
    """
    spark = docs.sparkSession
    kind = write_token_shards(docs, f"{folder}/shards", tokenizer, end_id)
    records = staged(read_token_shards(spark, f"{folder}/shards", kind, end_id), "records")
    buckets = build_index(records, f"{folder}/index")
    index = spark.read.schema("bucket long, keys int, seeds binary, slots binary").parquet(f"{folder}/index")
    found = look_up(docs.select(F.col("doc_id").cast("long").alias("doc_id")), index, buckets)
    placed = found.select(F.col("doc_id").alias("key"), F.col("shard").cast("int").alias("shard"), F.explode(
        F.sequence(F.col("record").cast("int"), (F.col("record") + F.col("times") - 1).cast("int"))).alias("record"))
    out = records.where("doc_id is not null").drop("doc_id").join(placed, ["shard", "record"]).withColumnRenamed("key", "doc_id")
    out = out.unionByName(records.where("doc_id is null"))
    return out.join(shard_starts(records), "shard").select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
