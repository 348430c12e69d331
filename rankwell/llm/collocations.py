"""Collocations: phrases that occur often enough, found with mergeable summaries and counted exactly.

1. Every n-gram of 1 to `longest` words inside a piece is hashed together with its language.  The hash is
   cut to some bits more than the corpus has n-grams, and its leading bits are the hash partition.  A task
   sums equal keys and sends them, sorted and as gaps, per partition, with the mass (occurrences) they have.
2. A partition first reads all masses.  Its summary (Misra-Gries) may then hold more counters than mass
   divided by the threshold: whenever it has more, the largest counter beyond that number is taken from
   all, and what is not positive leaves.  What was taken from one counter, in all, stays below the
   threshold, so every n-gram that occurs `least` times survives; counters that cannot reach it go.
3. The survivors are marked in a bitmap for every task.  A second pass over the texts sums what is marked
   and sends it the same way; partitions add it up, and the exact counts decide.  n-grams are told apart by
   two hashes of 64 bits, of all their words and of all but the last.  A full bitmap, or cut hashes that
   collide, only cost time.
4. The hash of an n-gram can be undone word by word, so the hashes of all its parts follow from its own and
   those of its beginnings.  A phrase is cut in two at every place, scored by its weakest cut, left out if a
   longer phrase explains half of its occurrences, and ranked within its language, all by hashes.
5. A third pass reads the words of the phrases that can be among the first, equal ones included, and the
   number of words per language.

Defined cases: texts that are null, empty or without words count nothing; languages that are null are
`und`.  Rows are never merged: rows that repeat a doc_id count each.  Texts of any length are taken whole.
Languages without a phrase have no row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.shared import LOWER, chunks, mix, narrow, running_hash, span_hash, unmixed, word_spans
from rankwell.scratch import staged

#: Bytes between words, and those of them that end a piece.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[9, 32]] = True
#: n-grams that a task holds before it sends them.
HELD = 2_000_000
#: Bytes of text for a hash partition.
PARTITION_BYTES = 8 << 20
#: Bits of the filter of surviving n-grams that every task gets (16 MB); a full filter only costs time.
FILTER_BITS = 1 << 27
_MASS, _KEYS = 0, 1


_STEP = 0x9E3779B97F4A7C15
_UNSTEP = np.uint64(pow(_STEP, -1, 1 << 64))


def extended(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram that goes on with a word, from its key and the word's hash."""
    return mix(key * np.uint64(_STEP) + word)


def last_word(key: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The hash of the last word, from the keys with and without it."""
    return unmixed(key) - before * np.uint64(_STEP)


class Grams:
    """The n-grams of some texts: their keys, and where their words begin and end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, seed: np.ndarray, longest: int):
        """`seed` is a number per text that stands for its language."""
        data = LOWER[data]
        begin, end, before = word_spans(data, starts, _BETWEEN)
        self.words = np.diff(before)
        self.begin, self.end = begin, end
        self.text_of = np.repeat(np.arange(len(starts) - 1), self.words)
        self.data = data
        self._slices: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        n = len(begin)
        if not n:
            self.keys = self.before = np.zeros((longest, 0), np.uint64)
            self.fits = np.zeros((longest, 0), bool)
            return
        hashes = np.empty(n, np.uint64)
        low = 0
        while low < n:  # long texts are hashed in pieces that end between words
            high = max(low + 1, int(np.searchsorted(end, begin[low] + (1 << 21), "right")))
            sums, down = running_hash(data[begin[low]:end[high - 1]])
            hashes[low:high] = span_hash(sums, down, begin[low:high] - begin[low], end[low:high] - begin[low])
            low = high
        text = self.text_of
        # A word opens a piece if its text does or if a byte that ends a piece stands before it.
        ends = np.cumsum(_ENDS[data])
        opens = np.r_[True, (text[1:] != text[:-1]) | (ends[begin[1:]] != ends[begin[:-1]])]
        piece = np.cumsum(opens)
        own = seed[text]
        running = extended(own, hashes)
        self.keys, self.fits = np.zeros((longest, n), np.uint64), np.zeros((longest, n), bool)
        self.keys[0], self.fits[0] = running, True
        for k in range(1, longest):
            if k < n:
                running = extended(running[:-1], hashes[k:])
                self.keys[k, :n - k] = running
                self.fits[k, :n - k] = piece[k:] == piece[:n - k]
        #: Keys of the n-grams without their last word; that of a single word is its language.
        self.before = np.concatenate((own[None], self.keys[:-1]))

    def text(self, first: np.ndarray, size: np.ndarray) -> list[str]:
        """The words of n-grams, with one blank between them."""
        if self._slices is None:
            # Words and the byte behind each of them, as a blank; an n-gram is then one slice.
            data, keep = self.data.copy(), ~_BETWEEN[self.data]
            behind = self.end[self.end < len(data)]
            behind = behind[_BETWEEN[data[behind]]]
            keep[behind], data[behind] = True, 32
            place = np.r_[0, np.cumsum(keep)]
            self._slices = data[keep], place[self.begin], place[self.end]
        data, begin, end = self._slices
        begin, end = begin[first], end[first + size - 1]
        offsets = np.r_[0, np.cumsum(end - begin)]
        letters = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)]
        return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters.tobytes())).to_pylist()


def _seeds(langs: list[str | None], known: dict[str, int]) -> np.ndarray:
    """A number per language, made from its bytes."""
    for lang in set(langs) - known.keys():
        raw = np.frombuffer((lang or "").encode() + b"\0", np.uint8)
        sums, down = running_hash(raw)
        known[lang] = int(span_hash(sums, down, np.array([0]), np.array([len(raw)]))[0])
    return np.array([known[x] for x in langs], np.uint64)


def _grams(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Grams, list[str], np.ndarray]]:
    known: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        seeds = _seeds(langs, known)
        for first, last, data, starts in chunks(batch.column("text")):
            yield Grams(data, starts, seeds[first:last], longest), langs[first:last], seeds[first:last]


def packed_keys(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Rising keys as gaps and their counts, the bytes of equal weight together (most of them are zero)."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = []
    for numbers in (gaps, times.astype(np.uint64)):
        width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
        planes.append(bytes([width]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes())
    return len(keys).to_bytes(8, "little") + planes[0] + planes[1]


def unpacked_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at = int.from_bytes(blob[:8], "little"), 8
    out = []
    for _ in range(2):
        width = blob[at]
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(blob, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(planes.view("<u8").ravel())
        at += 1 + n * width
    return np.cumsum(out[0]), out[1].astype(np.int64)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(keys) else times


class Summary:
    """A Misra-Gries summary of weighted keys: at most `capacity` counters, `taken` below mass / capacity.

    A key's true count is between its counter and its counter plus `taken`; keys without a counter
    occurred at most `taken` times.
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        """Merge counters of another summary, or plain sums."""
        self._waiting.append((keys, times))
        self._size += len(keys)
        if self._size > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys, times = (np.concatenate(x) for x in zip((self.keys, self.times), *self._waiting))
        self._waiting, self._size = [], 0
        keys, times = _summed(keys, times)
        if len(keys) > self.capacity:
            # The largest of those that do not fit is taken from all: as many counters lose it.
            least = int(np.partition(times, len(times) - self.capacity - 1)[len(times) - self.capacity - 1])
            self.taken += least
            keep = times > least
            keys, times = keys[keep], times[keep] - least
        self.keys, self.times = keys, times


def summary_parts(docs: DataFrame, longest: int, bits: int, partitions: int) -> DataFrame:
    """(part, kind, mass, keys): per task and hash partition the mass sent, and sums of equal keys."""
    shift, tail = np.uint64(64 - bits), np.uint64(bits - partitions)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        masses = np.zeros(1 << partitions, np.int64)

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            times = np.diff(np.r_[first, len(keys)])
            keys = keys[first]
            part = (keys >> tail).astype(np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.r_[edges[1:], len(part)]
            masses[part[edges]] += np.add.reduceat(times, edges)
            low = keys & ((np.uint64(1) << tail) - np.uint64(1))
            return _rows(part[edges], _KEYS, np.zeros(len(edges), np.int64), [packed_keys(low[a:b], times[a:b]) for a, b in zip(edges, ends)])

        for grams, _, _ in _grams(batches, longest):
            held.append(grams.keys[grams.fits] >> shift)
            size += len(held[-1])
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        sent = np.flatnonzero(masses)
        if len(sent):
            yield _rows(sent, _MASS, masses[sent], [None] * len(sent))

    return docs.select("lang", "text").mapInArrow(send, "part long, kind int, mass long, keys binary")


def _rows(part: np.ndarray, kind: int, mass: np.ndarray, keys: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int64()), pa.array([kind] * len(part), pa.int32()), pa.array(mass, pa.int64()), pa.array(keys, pa.binary())],
        names=["part", "kind", "mass", "keys"])


def surviving_keys(parts: DataFrame, least: int, bits: int, partitions: int) -> DataFrame:
    """(key): what can have occurred `least` times.

    Rows of a partition come masses first, so the capacity of its summary is known before its keys.
    """
    tail = np.uint64(bits - partitions)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass = None, 0
        summary = None

        def finished() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                summary.merge()
                keys = summary.keys[summary.times + summary.taken >= least] | (np.uint64(part) << tail)
                for low in range(0, len(keys), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[low:low + (1 << 18)].astype(np.int64))], names=["key"])

        for batch in batches:
            for p, kind, m, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if p != part:
                    yield from finished()
                    part, mass, summary = p, 0, None
                if kind == _MASS:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(mass // least + 1)
                summary.add(*unpacked_keys(keys.as_py()))
        yield from finished()

    dealt = parts.repartition(1 << partitions, "part").sortWithinPartitions("part", "kind")
    return dealt.mapInArrow(merge, "key long")


def _marks(keys: DataFrame) -> np.ndarray:
    """The filter of surviving keys, at most FILTER_BITS bits; it reaches the driver as bitmaps of 4 kB."""
    bit = F.pmod("key", F.lit(FILTER_BITS))
    rows = keys.select((bit + 1).alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for bucket, packed in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
        out[(bucket - 1) * 4096:(bucket - 1) * 4096 + len(packed)] = np.frombuffer(packed, np.uint8)
    return out


def _sums(keys: np.ndarray, before: np.ndarray, tags: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns with rows of equal keys (both) added up, in the order of keys."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if (same & (before[order[1:]] != before[order[:-1]])).any():
        order = np.lexsort((before, keys))
        same = (keys[order[1:]] == keys[order[:-1]]) & (before[order[1:]] == before[order[:-1]])
    first = np.flatnonzero(np.r_[True, ~same]) if len(keys) else np.zeros(0, np.int64)
    lead = order[first]
    return keys[lead], before[lead], tags[lead], np.add.reduceat(times[order], first) if len(keys) else times


def _open(keys: np.ndarray, marked: np.ndarray, shift: np.uint64) -> np.ndarray:
    bit = (keys >> shift).astype(np.int64) % FILTER_BITS
    return (marked[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def marked_counts(docs: DataFrame, marks: Broadcast, longest: int, bits: int, partitions: int) -> DataFrame:
    """(part, keys, before, tags, langs): per task and hash partition, sums of marked n-grams.

    A tag is a place in `langs`, times `longest`, plus the size less 1.
    """
    shift, tail = np.uint64(64 - bits), np.uint64(64 - partitions)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = marks.value
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        held: list[tuple[np.ndarray, ...]] = [none]
        size = 0
        langs: dict[int, int] = {}

        def merged() -> tuple[np.ndarray, ...]:
            return _sums(*(np.concatenate(x) for x in zip(*held)))

        def sent() -> pa.RecordBatch:
            keys, before, tags, times = held[0]
            part = (keys >> tail).astype(np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.r_[edges[1:], len(part)]
            low = keys & ((np.uint64(1) << tail) - np.uint64(1))
            wide = "<u1" if len(langs) * longest < 256 else "<u4"
            seeds = np.array(list(langs), np.uint64).tobytes()
            pieces = list(zip(edges, ends))
            return pa.RecordBatch.from_arrays(
                [pa.array(part[edges]), pa.array([packed_keys(low[a:b], times[a:b]) for a, b in pieces], pa.binary()),
                 pa.array([before[a:b].tobytes() for a, b in pieces], pa.binary()),
                 pa.array([tags[a:b].astype(wide).tobytes() for a, b in pieces], pa.binary()), pa.array([seeds] * len(pieces), pa.binary())],
                names=["part", "keys", "before", "tags", "langs"])

        for grams, _, seeds in _grams(batches, longest):
            for seed in np.unique(seeds).tolist():
                langs.setdefault(seed, len(langs))
            keys = grams.keys[grams.fits]
            take = _open(keys, marked, shift)
            words, place = np.nonzero(grams.fits)
            lang = np.array([langs[x] for x in seeds.tolist()], np.int64)
            tags = (lang[grams.text_of[place[take]]] * longest + words[take]).astype(np.int64)
            held.append(_sums(keys[take], grams.before[grams.fits][take], tags, np.ones(len(tags), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield sent()
                    held, size = [none], 0
        held = [merged()]
        if len(held[0][0]):
            yield sent()

    return docs.mapInArrow(count, "part long, keys binary, before binary, tags binary, langs binary")


def frequent_grams(counted: DataFrame, least: int, longest: int, partitions: int) -> DataFrame:
    """(lang, size, key, before, f) for every n-gram with f >= `least`; `lang` is a number per language."""
    tail = np.uint64(64 - partitions)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        langs: dict[int, int] = {}

        def finished() -> Iterator[pa.RecordBatch]:
            keys, before, tags, times = _sums(*(np.concatenate(x) for x in zip(*held)))
            keep = times >= least
            seeds = np.array(list(langs), np.uint64)[tags[keep] // longest]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds.astype(np.int64)), pa.array((tags[keep] % longest + 1).astype(np.int32)), pa.array(keys[keep].astype(np.int64)),
                 pa.array(before[keep].astype(np.int64)), pa.array(times[keep])], names=["lang", "size", "key", "before", "f"])

        for batch in batches:
            for p, raw, before, tags, seeds in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                if p != part:
                    if held:
                        yield from finished()
                    part, held, size = p, [], 0
                low, times = unpacked_keys(raw.as_py())
                own = np.array([langs.setdefault(x, len(langs)) for x in np.frombuffer(seeds.as_py(), np.uint64).tolist()], np.int64)
                tags = np.frombuffer(tags.as_py(), "<u1" if len(own) * longest < 256 else "<u4").astype(np.int64)
                held.append((low | (np.uint64(p) << tail), np.frombuffer(before.as_py(), np.uint64), own[tags // longest] * longest + tags % longest, times))
                size += len(low)
                if size > HELD:
                    held = [_sums(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0]) // 2
        if held:
            yield from finished()

    dealt = counted.repartition(1 << partitions, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(add, "lang long, size int, key long, before long, f long")


def phrase_parts(grams: DataFrame, longest: int) -> DataFrame:
    """(lang, key, before, a, k, l_key, l_before, r_key, r_before): every phrase of two or more words with its
    parts at every cut k, and with k = 0 and the part as `l`, every phrase inside it."""
    chained = grams.where("size > 1").withColumn("chain", F.array("before", "key"))
    up = grams.select("lang", F.col("key").alias("_key"), F.col("before").alias("_up"), F.col("size").alias("_size"))
    for k in range(longest - 1):
        # The first of a chain is the key of `size - 1 - k` words; its own beginning goes before it.
        head = chained.join(up, (chained["lang"] == up["lang"]) & (F.get("chain", F.lit(0)) == F.col("_key")) & (F.col("size") - 1 - k == F.col("_size")), "left")
        chained = head.select(chained["lang"], "size", "key", "before", "f", F.when(
            F.col("_up").isNull(), F.col("chain")).otherwise(F.concat(F.array("_up"), "chain")).alias("chain"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                # Keys of the first 0 (the language), 1, ... `size` words, and the words' hashes.
                chain = np.stack(rows.column("chain").to_pylist()).astype(np.int64).view(np.uint64).T
                words = [last_word(chain[i + 1], chain[i]) for i in range(size)]

                def part(i: int, k: int) -> list[np.ndarray]:
                    key, before = chain[0], chain[0]
                    for word in words[i:k]:
                        key, before = extended(key, word), key
                    return [key.view(np.int64), before.view(np.int64)]

                zeros = np.zeros(len(chain[0]), np.int64)
                out = [(k, part(0, k), part(k, size)) for k in range(1, size)]
                out += [(0, part(i, i + m), [zeros, zeros]) for m in range(2, size) for i in range(size - m + 1)]
                for k, left, right in out:
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c) for c in ("lang", "key", "before", "f")), pa.array(np.full(len(zeros), k, np.int32)),
                         *(pa.array(np.ascontiguousarray(x)) for x in (*left, *right))],
                        names=["lang", "key", "before", "a", "k", "l_key", "l_before", "r_key", "r_before"])

    return chained.select("lang", "size", "key", "before", "f", "chain").mapInArrow(
        cut, "lang long, key long, before long, a long, k int, l_key long, l_before long, r_key long, r_before long")


def phrase_words(docs: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """(key, before, lang, phrase, n): the words of `phrases` (key), others may be among them; and, with key
    null, the number of words per language and task."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(phrases.select("key")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = marks.value
        seen: set[tuple[int, int]] = set()
        words: dict[str, int] = {}
        for grams, langs, _ in _grams(batches, longest):
            for lang, n in zip(langs, grams.words.tolist()):
                words[lang] = words.get(lang, 0) + n
            keys = grams.keys[grams.fits]
            take = np.flatnonzero(_open(keys, marked, np.uint64(0)))
            if not len(take):
                continue
            _, first = np.unique(keys[take], return_index=True)
            take = take[first]
            size, place = (x[take] for x in np.nonzero(grams.fits))
            both = list(zip(keys[take].astype(np.int64).tolist(), grams.before[grams.fits][take].astype(np.int64).tolist()))
            new = [i for i, x in enumerate(both) if x not in seen]
            if len(seen) < 100_000:
                seen.update(both)
            texts = grams.text(place[new], size[new] + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([both[i][0] for i in new], pa.int64()), pa.array([both[i][1] for i in new], pa.int64()),
                 pa.array([langs[grams.text_of[place[i]]] for i in new], pa.string()), pa.array(texts, pa.string()), pa.array([0] * len(new), pa.int64())],
                names=["key", "before", "lang", "phrase", "n"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(words), pa.int64()), pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.nulls(len(words), pa.string()),
             pa.array(list(words.values()), pa.int64())], names=["key", "before", "lang", "phrase", "n"])

    return docs.mapInArrow(read, "key long, before long, lang string, phrase string, n long")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2_000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to `longest` words per language.

    `a` (at least `least`) occurrences of the phrase, `l` and `r` of its first part and the rest at the cut
    that scores lowest, `n` words of the language; a phrase is left out if a longer one that holds it has at
    least `share` percent of its occurrences.
    """
    docs = narrow(docs, {"lang": "string", "text": "string"}).withColumn("lang", F.coalesce("lang", F.lit("und")))
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    # Words have six bytes or so; the numbers of bits and partitions only balance the work.
    partitions = max(4, (total // PARTITION_BYTES).bit_length())
    bits = min(62, max(32, (total // 2).bit_length() + 10))
    survivors = surviving_keys(summary_parts(docs, longest, bits, partitions), least, bits, partitions)
    marks = docs.sparkSession.sparkContext.broadcast(_marks(survivors))
    grams = staged(frequent_grams(marked_counts(docs, marks, longest, bits, partitions), least, longest, partitions), "grams")
    marks.destroy()

    # Parts occur at least as often as the phrase, so they are in the table.
    parts = staged(phrase_parts(grams, longest), "phrase-parts")
    left = grams.select("lang", F.col("key").alias("l_key"), F.col("before").alias("l_before"), F.col("f").alias("l"))
    right = grams.select("lang", F.col("key").alias("r_key"), F.col("before").alias("r_before"), F.col("f").alias("r"))
    cuts = parts.where("k > 0").join(left, ["lang", "l_key", "l_before"]).join(right, ["lang", "r_key", "r_before"])
    # Counts below 10^15 leave room for the whole product in 38 digits.
    digits = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    cuts = cuts.withColumn("over", (F.lit(1_000_000).cast("decimal(7,0)") * digits["a"]) * digits["a"]).withColumn("under", digits["l"] * digits["r"])
    cuts = cuts.withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "key", "before", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # Every phrase tells the shorter ones inside it how often it occurs.
    inner = parts.where("k = 0").groupBy("lang", F.col("l_key").alias("key"), F.col("l_before").alias("before")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "key", "before"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = staged(kept.select("lang", "key", "before", "a", "c.l", "c.r", "c.score").withColumn("_r", F.rank().over(by_score)).where(
        F.col("_r") <= top).drop("lang", "_r"), "first-phrases")

    words = staged(phrase_words(docs, first, longest), "phrase-words")
    texts = words.where("key is not null").groupBy("key", "before").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
    totals = words.where("key is null").groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = first.join(texts, ["key", "before"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(docs: str = "documents", least: int = 10, longest: int = 3, top: int = 2_000, share: int = 50) -> str:
    """DuckDB SQL for the rows of `collocations`."""
    grams = " union all ".join(
        f"select lang, array_to_string(w[i:i + {k - 1}], ' ') as phrase, {k} as size, count(*) as f from "
        f"(select lang, w, unnest(generate_series(1, len(w) - {k - 1})) as i from p where len(w) >= {k}) group by all"
        for k in range(1, longest + 1))
    return f"""
with d as (select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from {docs}),
q as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from q),
t as (select lang, sum(len(w))::bigint as n from p group by lang),
g as (select * from ({grams}) where f >= {least}),
c as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w from g where size > 1),
k as (select *, unnest(generate_series(1, size - 1)) as k from c),
s as (select k.lang, k.phrase, k.a, k.size, k.k, x.f as l, y.f as r,
    (1000000::hugeint * k.a * k.a // (x.f::hugeint * y.f))::bigint as score from k
    join g x on x.lang = k.lang and x.phrase = array_to_string(k.w[1:k.k], ' ')
    join g y on y.lang = k.lang and y.phrase = array_to_string(k.w[k.k + 1:k.size], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
h as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer from
    (select *, unnest(generate_series(1, size - m + 1)) as i from
        (select *, unnest(generate_series(2, size - 1)) as m from c where size > 2)) group by all),
z as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
    from b left join h on h.lang = b.lang and h.phrase = b.phrase where h.longer is null or 100 * h.longer < {share} * b.a)
select z.lang, z.rank::bigint as rank, z.phrase, z.a::bigint as a, z.l::bigint as l, z.r::bigint as r, t.n, z.score
from z join t on t.lang = z.lang where z.rank <= {top}"""
