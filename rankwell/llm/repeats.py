"""Removal of byte strings that occurred earlier, through the Burrows-Wheeler transform of bounded groups.

A string of `length` bytes holds exactly one smallest k-gram (by hash, leftmost if equal) among those that
start in it: its anchor.  Equal strings have equal anchors at equal places, so strings are compared only
with strings of the same anchor, and only about one k-gram in 35 is an anchor.

1. Every anchor is noted with a hash of its surroundings, the bytes of all strings that can have it.
   Where surroundings are equal, all but the earliest are repeats as a whole.  (Equal ones that meet in
   one task are settled there, before the shuffle.)
2. Anchors with several different surroundings are open.  The earliest of each surroundings is sent, as
   bytes, to the bucket of its anchor.
3. A bucket is concatenated and transformed.  Intervals of the transform are extended backwards, breadth
   first: a step finds the boundaries between suffixes whose common prefix has exactly the current length,
   so common prefixes come in increasing order, and the expansion stops at `length`.  Suffixes without a
   boundary between them share `length` bytes or more; all but the earliest of them are repeats.
4. Repeats are merged per document and cut out.

Defined cases: null counts as empty; texts shorter than `length` lose nothing; bytes are judged on the
input.  Rows without a doc_id count as earliest.  Rows that repeat a doc_id count as one document: they
share what is removed, by position.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.shared import CHUNK_BYTES, chunks, mix, narrow, running_hash, span_hash, utf8
from rankwell.scratch import staged

_K = 32
_NOTE = np.dtype([("anchor", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("left", "<u2"), ("right", "<u2")])
#: Anchors that a task holds before it sends them.
_HELD = 400_000
#: Bits of the filter of open anchors that every task gets (8 MB); a full filter only costs time.
FILTER_BITS = 1 << 26
_SEPARATOR = 0xFF  # no byte of UTF-8
_NO_DOC = -(1 << 63)


def _anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors in `data`, whose texts end at `ends`; also the k-gram hashes and the hash sums."""
    n = len(data)
    sums, down = running_hash(data)
    grams = mix((sums[_K:] - sums[:-_K]) * down[:n - _K + 1]) if n >= _K else np.zeros(0, np.uint64)
    if n < length:
        return np.zeros(0, np.int64), grams, sums, down
    # Hash above, place below: the minimum is the leftmost smallest.  2^21 places fit a piece.
    key = (grams & ~np.uint64((1 << 21) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width, low = length - _K + 1, key
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[:len(low) - (width - reach)], low[width - reach:])
    places = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
    # Strings that would run into the next text do not count.
    start = np.arange(len(low))
    inside = start + length <= ends[np.searchsorted(ends, start, "right")]
    return np.unique(places[inside]), grams, sums, down


def _noted(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(notes, bytes, place of each note in the bytes) for every piece of the texts of a batch.

    A text longer than a piece is cut into overlapping ones; a string is judged in the piece in which it
    starts, and an anchor's surroundings are always taken from the whole text.
    """
    docs = batch.column("doc_id").fill_null(_NO_DOC).to_numpy()
    side = length - _K
    for first, last, data, starts in chunks(batch.column("text")):
        total = len(data)
        for low in range(0, max(1, total), CHUNK_BYTES):
            if last - first > 1 and low:
                break
            # Chunks of several texts have at most one piece.
            high = total if last - first > 1 else min(total, low + CHUNK_BYTES + length - 1)
            piece = data[low:high]
            ends = starts[1:][starts[1:] > low] - low
            ends = np.minimum(ends, high - low)
            places, grams, sums, down = _anchors(piece, ends, length)
            if not len(places):
                continue
            at = places + low
            text = np.searchsorted(starts, at, "right") - 1
            left = np.minimum(side, at - starts[text])
            right = np.minimum(length, starts[text + 1] - at)
            # Surroundings may reach beyond the piece, up to `length` bytes on either side.
            a, b = max(0, low - length), min(total, high + length)
            if b - a > len(piece):
                sums, down = running_hash(data[a:b])
            s, e = at - left - a, at + right - a
            notes = np.zeros(len(at), _NOTE)
            notes["anchor"] = grams[places]
            notes["around"] = mix((sums[e] - sums[s]) * down[s] + (left * 1000 + right).astype(np.uint64))
            notes["doc"] = docs[first + text]
            notes["at"] = at - starts[text]
            notes["left"], notes["right"] = left, right
            yield notes, data, at


def _settled(notes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest note of each anchor and surroundings, and the others, which are repeats."""
    order = np.lexsort((notes["at"], notes["doc"], notes["around"], notes["anchor"]))
    notes = notes[order]
    same = np.zeros(len(notes), bool)
    same[1:] = (notes["anchor"][1:] == notes["anchor"][:-1]) & (notes["around"][1:] == notes["around"][:-1])
    # A note that two overlapping pieces gave is no repeat of itself.
    again = same.copy()
    again[1:] &= (notes["doc"][1:] == notes["doc"][:-1]) & (notes["at"][1:] == notes["at"][:-1])
    others = notes[same & ~again]
    return notes[~same], others[others["left"].astype(np.int64) + others["right"] >= length]


def _ranges(others: np.ndarray) -> dict[str, np.ndarray]:
    """Ranges of repeats; touching ones of a document are merged."""
    s, e = others["at"] - others["left"], others["at"] + others["right"]
    return _merged(others["doc"], s, e)


def _merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
    order = np.lexsort((s, doc))
    doc, s, e = doc[order].astype(np.int64), s[order].astype(np.int64), e[order].astype(np.int64)
    if not len(doc):
        return {"doc": doc, "s": s, "e": e}
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    # The furthest end so far, restarted per document by lifting documents apart.
    lift = np.cumsum(new_doc) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + lift) - lift
    first = new_doc | np.r_[True, s[1:] > reach[:-1]]
    at = np.flatnonzero(first)
    return {"doc": doc[at], "s": s[at], "e": reach[np.r_[at[1:], len(doc)] - 1]}


def _buckets(notes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of notes.  Anchors are smallest hashes, so they are mixed again before their bits are even."""
    return (mix(notes["anchor"].astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(notes: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    bucket = _buckets(notes, bits)
    order = np.argsort(bucket, kind="stable")
    bucket, notes = bucket[order], notes[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[edges].tolist(), [notes[a:b].tobytes() for a, b in zip(edges, np.append(edges[1:], len(notes)))]


def _batch(bucket: list[int | None], notes: list[bytes | None], parts: list[bytes | None], found: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Notes for buckets, followed by finished ranges, in one schema."""
    n, m = len(bucket), len(found["doc"])
    pad = lambda x: pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x, pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.array(bucket, pa.int64()), pa.nulls(m, pa.int64())]),
         pa.concat_arrays([pa.array(notes, pa.binary()), pa.nulls(m, pa.binary())]),
         pa.concat_arrays([pa.array(parts, pa.binary()), pa.nulls(m, pa.binary())]),
         pad(found["doc"]), pad(found["s"]), pad(found["e"])], names=["bucket", "notes", "parts", "doc", "s", "e"])


_SENT = "bucket long, notes binary, parts binary, doc long, s long, e long"
_NONE = {c: np.zeros(0, np.int64) for c in ("doc", "s", "e")}


def anchor_notes(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Packed notes of all anchors by bucket, and ranges that are already known to be repeats."""

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for notes, _, _ in _noted(batch, length):
                held.append(notes)
                size += len(notes)
                if size >= _HELD:
                    first, others = _settled(np.concatenate(held), length)
                    bucket, packed = _packed(first, bits)
                    yield _batch(bucket, packed, [None] * len(bucket), _ranges(others))
                    held, size = [], 0
        if size:
            first, others = _settled(np.concatenate(held), length)
            bucket, packed = _packed(first, bits)
            yield _batch(bucket, packed, [None] * len(bucket), _ranges(others))

    return docs.mapInArrow(note, _SENT)


def _compared(length: int):
    def compare(group: pa.Table) -> pa.Table:
        """Repeats of a bucket as ranges, and its open anchors (doc null, s the anchor)."""
        notes = np.concatenate([np.frombuffer(x.as_py(), _NOTE) for x in group.column("notes")])
        first, others = _settled(notes, length)
        found = _ranges(others)
        anchor = first["anchor"]
        several = np.flatnonzero(np.r_[anchor[1:] == anchor[:-1], False])
        still = np.unique(anchor[several]).astype(np.int64)
        return pa.table({
            "doc": pa.concat_arrays([pa.array(found["doc"], pa.int64()), pa.nulls(len(still), pa.int64())]),
            "s": np.concatenate((found["s"], still)), "e": np.concatenate((found["e"], np.zeros(len(still), np.int64)))})

    return compare


def open_surroundings(docs: DataFrame, still: DataFrame, length: int, bits: int) -> DataFrame:
    """Packed notes and bytes of the surroundings of open anchors, the earliest of equal ones per task."""
    spark = docs.sparkSession
    bit = F.pmod("s", F.lit(FILTER_BITS))
    # The bitmap functions count from 1.
    marks = still.select((bit + 1).alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for bucket, packed in zip(marks.column("bucket").to_pylist(), marks.column("bits").to_pylist()):
        bitmap[(bucket - 1) * 4096:(bucket - 1) * 4096 + len(packed)] = np.frombuffer(packed, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = shared.value
        held: list[np.ndarray] = []
        bytes_held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            notes = np.concatenate(held)
            order = np.lexsort((notes["at"], notes["doc"], notes["around"], notes["anchor"]))
            notes = notes[order]
            keep = np.r_[True, (notes["anchor"][1:] != notes["anchor"][:-1]) | (notes["around"][1:] != notes["around"][:-1])]
            notes, order = notes[keep], order[keep]
            bucket = _buckets(notes, bits)
            turn = np.argsort(bucket, kind="stable")
            bucket, notes, order = bucket[turn], notes[turn], order[turn]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(edges[1:], len(notes))
            return _batch(bucket[edges].tolist(), [notes[a:b].tobytes() for a, b in zip(edges, ends)],
                          [b"".join(bytes_held[i] for i in order[a:b]) for a, b in zip(edges, ends)], _NONE)

        for batch in batches:
            for notes, data, at in _noted(batch, length):
                place = notes["anchor"].astype(np.int64) % FILTER_BITS
                keep = np.flatnonzero((filter_bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                if not len(keep):
                    continue
                notes, at = notes[keep], at[keep]
                held.append(notes)
                bytes_held += [data[p - x:p + y].tobytes() for p, x, y in zip(at, notes["left"].astype(np.int64), notes["right"].astype(np.int64))]
                size += len(notes)
                if size >= 100_000:
                    yield flush()
                    held, bytes_held, size = [], [], 0
        if size:
            yield flush()

    return docs.mapInArrow(send, _SENT).select("bucket", "notes", "parts")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of `text` in the order of their first `depth` bytes at least."""
    n = len(text)
    wide = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i:i + n]
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    reach = 8
    while reach < depth:
        # The rank of a suffix is the place where those that share `reach` bytes with it begin.
        lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = lead, -1
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            break
        # Only suffixes that are still tied are sorted on, by the rank of what follows.
        start = order[tied]
        key = lead[tied] * (n + 1) + rank[np.minimum(start + reach, n)] + 1
        turn = np.argsort(key)
        order[tied], key = start[turn], key[turn]
        new[tied] = np.r_[True, key[1:] != key[:-1]]
        reach *= 2
    return order


def prefix_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix in `order` with the one before it, for those below `length`; -1 elsewhere.

    Intervals of the transform that stand for a string w are extended by every byte c that precedes it.
    If the boundary behind the interval of cw is not known yet, the suffixes at it share exactly |w|
    bytes, and the interval goes to the next round; otherwise it was found with a shorter w.
    """
    n = len(text)
    before = text[order - 1]  # the transform; the text is taken as a ring
    # Where the suffix one byte longer stands: stable by byte.
    by_byte = np.argsort(before, kind="stable")
    longer = np.empty(n, np.int64)
    longer[by_byte] = np.arange(n)
    leads = text[order].astype(np.int64)
    owner = np.empty(n, np.int64)
    common = np.full(n + 1, -1, np.int16)
    common[0] = common[n] = 0
    low, high = np.array([0]), np.array([n])  # half-open
    for size in range(length):
        if not len(low):
            break
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        to = longer[rows]
        # Intervals of one round are disjoint; a child is what one of them sends to the block of one byte.
        owner[to] = which
        to.sort()
        turn = owner[to] * 256 + leads[to]
        first = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]])
        last = np.r_[first[1:], len(to)] - 1
        child_low, child_high = to[first], to[last] + 1
        new = common[child_high] == -1
        child_low, child_high = child_low[new], child_high[new]
        common[child_high] = size
        # Two intervals cannot end at one boundary with strings of one size, so every child is new once.
        low, high = child_low, child_high
    return common[:n]


def _promising(notes: np.ndarray, starts: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Whether a surroundings can share `length` bytes with another one of its anchor.

    Whatever place the anchor has in a shared string, the string holds one of five spans around the anchor,
    a quarter of the room shorter than itself; one of the five recurs then.
    """
    room = length - _K
    step = max(1, -(-room // 4))
    sums, down = running_hash(data)
    left, right = notes["left"].astype(np.int64), notes["right"].astype(np.int64)
    out = np.zeros(len(notes), bool)
    for before in range(0, room + step, step):
        before = min(before, room)
        after = max(0, room - before - step + 1)
        fits = np.flatnonzero((left >= before) & (right >= _K + after))
        low = starts[fits] + left[fits] - before
        key = mix(span_hash(sums, down, low, low + before + _K + after) ^ notes["anchor"][fits])
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        out[fits[order[1:][same]]] = True
        out[fits[order[:-1][same]]] = True
    return out


def _expanded(length: int):
    def expand(group: pa.Table) -> pa.Table:
        """Repeated strings among the open surroundings of a bucket, as ranges."""
        notes = np.concatenate([np.frombuffer(x.as_py(), _NOTE) for x in group.column("notes")])
        data = np.frombuffer(b"".join(x.as_py() for x in group.column("parts")), np.uint8)
        sizes = notes["left"].astype(np.int64) + notes["right"]
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((notes["at"], notes["doc"], notes["around"], notes["anchor"]))
        sorted_notes = notes[order]
        keep = np.r_[True, (sorted_notes["anchor"][1:] != sorted_notes["anchor"][:-1])
                     | (sorted_notes["around"][1:] != sorted_notes["around"][:-1])]
        anchor = sorted_notes["anchor"][keep]
        lonely = np.r_[True, anchor[1:] != anchor[:-1]] & np.r_[anchor[1:] != anchor[:-1], True]
        order = order[keep][~lonely]
        notes, starts, sizes = notes[order], starts[order], sizes[order]
        out = [np.zeros(0, np.int64)] * 3
        chance = _promising(notes, starts, data, length)
        notes, starts, sizes = notes[chance], starts[chance], sizes[chance]
        # Anchors are independent, so a bucket is transformed in parts of whole anchors.
        edges = np.flatnonzero(np.r_[True, notes["anchor"][1:] != notes["anchor"][:-1]]) if len(notes) else np.zeros(0, int)
        edges = np.r_[edges, len(notes)]
        low = 0
        while low < len(edges) - 1:
            high = low + 1
            while high < len(edges) - 1 and edges[high + 1] - edges[low] <= 4096:
                high += 1
            part = slice(edges[low], edges[high])
            found = repeated_strings(notes[part], [data[s:s + k] for s, k in zip(starts[part], sizes[part])], length)
            out = [np.concatenate(x) for x in zip(out, found)]
            low = high
        merged = _merged(*out)
        return pa.table({c: pa.array(merged[c], pa.int64()) for c in ("doc", "s", "e")})

    return expand


def repeated_strings(notes: np.ndarray, parts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the strings in `parts` that are not the earliest of their kind."""
    sizes = np.array([len(p) + 1 for p in parts])
    begin = np.cumsum(sizes) - sizes
    text = np.full(int(sizes.sum()), _SEPARATOR, np.uint8)
    for b, p in zip(begin, parts):
        text[b:b + len(p)] = p
    order = suffix_order(text, length + 1)
    common = prefix_boundaries(text, order, length)
    kind = np.cumsum(common >= 0)
    shared = (common < 0) | np.r_[common[1:] < 0, False]
    order, kind = order[shared], kind[shared]
    part = np.searchsorted(begin, order, "right") - 1
    inside = order + length <= begin[part] + sizes[part] - 1  # the string does not run into a separator
    order, kind, part = order[inside], kind[inside], part[inside]
    doc = notes["doc"][part]
    at = notes["at"][part] - notes["left"][part] + (order - begin[part])
    turn = np.lexsort((at, doc, kind))
    kind, doc, at = kind[turn], doc[turn], at[turn]
    later = np.zeros(len(kind), bool)
    later[1:] = (kind[1:] == kind[:-1]) & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
    # Copies of the earliest place itself (seen from two anchors) are not repeats.
    lead = np.maximum.accumulate(np.where(np.r_[True, kind[1:] != kind[:-1]], np.arange(len(kind)), 0)) if len(kind) else kind
    later &= (doc != doc[lead]) | (at != at[lead]) if len(kind) else later
    return doc[later], at[later], at[later] + length


def repeated_ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, s, e): byte ranges of `docs` (doc_id, text) covered by strings of `length` bytes that also start earlier.

    Ranges of one document may touch or overlap.
    """
    bits = min(20, max(4, (docs.count() // 1024).bit_length()))
    sent = staged(anchor_notes(docs, length, bits), "anchors")
    compared = staged(sent.where("bucket is not null").select("bucket", "notes").groupBy("bucket").applyInArrow(
        _compared(length), "doc long, s long, e long"), "compared")
    still = compared.where("doc is null").select("s")
    open_parts = open_surroundings(docs, still, length, bits)
    expanded = open_parts.groupBy("bucket").applyInArrow(_expanded(length), "doc long, s long, e long")
    return sent.where("bucket is null").select("doc", "s", "e").unionByName(
        compared.where("doc is not null")).unionByName(expanded)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of `docs` (doc_id, text)."""
    docs = narrow(docs, {"doc_id": "long", "text": "string"})
    ranges = repeated_ranges(docs, length).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                data, starts = utf8(part.column("text"))
                rows = []
                for i, cuts in enumerate(part.column("cuts")):
                    raw = data[starts[i]:starts[i + 1]]
                    spans = 0
                    kept = raw
                    if cuts.is_valid:
                        flat = cuts.values
                        s, e = flat.field("s").to_numpy(), np.minimum(flat.field("e").to_numpy(), len(raw))
                        s = np.minimum(s, len(raw))
                        # Covered where more ranges have begun than ended.
                        level = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(level, s, 1)
                        np.add.at(level, e, -1)
                        covered = np.cumsum(level[:-1]) > 0
                        spans = int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
                        kept = raw[~covered]
                    kept = kept.tobytes()
                    rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                n, removed, spans, digests, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                     pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    keyed = docs.withColumn("doc", F.coalesce("doc_id", F.lit(_NO_DOC).cast("long")))
    return keyed.join(ranges, "doc", "left").select("doc_id", "text", "cuts").mapInArrow(
        cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
