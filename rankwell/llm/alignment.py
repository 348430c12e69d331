"""Alignment of two tokenizations of the same bytes, by divide and conquer at shared cuts.

Both tokenizations of a text cover the same bytes.  A byte offset where a token of each ends is a shared
cut; between neighbouring shared cuts lies a group, the smallest stretch that both cover with whole tokens.

1. An interval starts as a whole text.  Near the middle of its tokens, going outwards, ends of the first
   tokenization are looked up among the ends of the second by bisection; the first that is met cuts the
   interval, and both halves go on.  Ends that were looked up in vain are not tried again, so a text costs
   a bisection per token.  An interval without a shared cut is a group.  All intervals of a piece of texts
   are halved together, breadth first.
2. Inside a text, every stretch between neighbouring ends of either kind is the overlap of one pair of
   tokens: a link.  A document keeps its different links with how often each occurs.
3. Links are counted over the corpus and looked up again per document.  The most frequent ones are
   broadcast, a number of rows that is a parameter; all others are joined by shuffle, and none of them is
   frequent.

Defined cases: texts that are null, empty or whose tokens do not spell them (a blank before the text
included) have no tokens, zeros and an empty digest.  Rows are never merged: rows without a doc_id and
rows that repeat one are documents of their own.  Other columns are ignored.  A text of any length is
taken whole, in one task.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.shared import chunks, narrow, per_worker
from rankwell.scratch import staged

#: Links that are broadcast with their counts (16 bytes each); the others are joined by shuffle.
KNOWN_LINKS = 500_000
#: Runs of blanks that the faster encoder cannot take.
_LONG_BLANK = re.compile(r"\s{20000}")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the entries of byte-level vocabularies.

    Printable bytes stand for themselves; the others are numbered upwards from 256.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: Words whose ids a worker keeps (about 250 bytes each), twice: older ones leave when no longer met.
KNOWN_WORDS = 150_000
#: ... and their characters.
KNOWN_CHARACTERS = 16_000_000
#: A word with the blanks before it; runs of blanks that begin otherwise stay inside.
_WORDS = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
#: Characters that only some engines count as blanks.
_UNSURE = re.compile("[\x1c-\x1f]")
_PACK = np.dtype("<i4")


class ByteTokenizer:
    """A byte-level BPE file: ids of texts, and the bytes of every id."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        special = {t["content"] for t in parsed["added_tokens"]}
        letters = byte_alphabet()
        self.definition = definition
        self.ranks = {bytes(letters[c] for c in w): i for w, i in parsed["model"]["vocab"].items() if w not in special}
        if not {bytes([i]) for i in range(256)} <= set(self.ranks):
            raise ValueError("the byte-level vocabulary lacks single bytes")
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for raw, i in self.ranks.items():
            self.bytes[i] = raw
        self.sizes = np.array([len(x) for x in self.bytes])
        self._fast = self._slow = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encoded(t) for t in texts]

    def _encoded(self, text: str) -> np.ndarray:
        if len(text) >= 20_000 and _LONG_BLANK.search(text):
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_str(self.definition)
                self._slow.encode_special_tokens = True
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, _PACK)
        if self._fast is None:
            import public_tokenizers
            import tiktoken

            # Ids are in the order of the merges, so they are the ranks.
            self._fast = tiktoken.Encoding(
                "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype(_PACK)


class PieceTokenizer:
    """A piece model with byte fallback: ids of texts, and the bytes of every id."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes = [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i)
                      else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.vocab_size())]
        #: No piece goes on with a blank or line end, so words with the blanks before them are encoded apart.
        self.by_word = not any(re.search(r"\S[ \n]", b.decode("utf-8", "replace")) for b in self.bytes)
        self._lead = len(m.encode("x"))
        self.sizes = np.array([len(x) for x in self.bytes])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)

    def encode_words(self, words: list[str]) -> list[int]:
        """Ids of words with the blanks before them, as they are inside a text."""
        return self.model.encode("x" + "".join(words), num_threads=1)[self._lead:]


class PairEncoder:
    """Both tokenizations of texts.  Ids of words are kept, as both kinds of tokens end before a run of blanks."""

    def __init__(self, byte_definition: str, piece_proto: bytes):
        self.a, self.b = ByteTokenizer(byte_definition), PieceTokenizer(piece_proto)
        self.known: dict[str, tuple[bytes, bytes | None]] = {}
        self.before: dict[str, tuple[bytes, bytes | None]] = {}
        self.characters = 0

    def _packed(self, a_ids: list, b_ids: list, texts: list[str]) -> list[tuple[bytes, bytes | None]]:
        """Packed ids of both kinds; None for B where its tokens do not spell the text."""
        spell = self.b.bytes.__getitem__
        return [(a.tobytes(), np.array(b, _PACK).tobytes() if b"".join(map(spell, b)) == t.encode() else None)
                for a, b, t in zip(a_ids, b_ids, texts)]

    def _words(self, words: list[str]) -> list[tuple[bytes, bytes | None]]:
        """The same for words with the blanks before them; all are encoded as one text, which is cut afterwards."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        b = self.b.encode_words(words)
        if b"".join(map(self.b.bytes.__getitem__, b)) != b"".join(raw):
            return [x for w in words for x in self._words([w])] if len(words) > 1 else [(self.a.encode(words)[0].tobytes(), None)]
        out = []
        for ids, sizes in ((self.a.encode(["".join(words)])[0], self.a.sizes), (np.array(b, _PACK), self.b.sizes)):
            cuts = (np.searchsorted(np.cumsum(sizes[ids]), ends) + 1) * _PACK.itemsize
            packed = ids.tobytes()
            out.append([packed[x:y] for x, y in zip([0, *cuts.tolist()], cuts.tolist())])
        return list(zip(*out))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes | None]]:
        """Packed ids of texts that begin with a blank."""
        whole = [not self.b.by_word or _UNSURE.search(t) is not None for t in texts]
        words = [[] if w else _WORDS.findall(t) for t, w in zip(texts, whole)]
        if len(self.known) > KNOWN_WORDS or self.characters > KNOWN_CHARACTERS:
            self.known, self.before, self.characters = {}, self.known, 0
        new = []
        for w in set().union(*words).difference(self.known):
            self.characters += len(w)
            if (ids := self.before.get(w)) is not None:
                self.known[w] = ids
            else:
                new.append(w)
        for low in range(0, len(new), 4096):
            part = new[low:low + 4096]
            self.known.update(zip(part, self._words(part)))
        out = []
        for text, own, plain in zip(texts, words, whole):
            if plain:
                out += self._packed(self.a.encode([text]), self.b.encode([text]), [text])
                continue
            pairs = list(map(self.known.__getitem__, own))
            b = [p[1] for p in pairs]
            out.append((b"".join([p[0] for p in pairs]), None if None in b else b"".join(b)))
        return out


def shared_cut_groups(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of every group in both tokenizations, in order.

    `a_ends`, `b_ends` are rising byte offsets where tokens end, over several texts laid end to end;
    `a_first`, `b_first` are the first tokens of the texts and, at the end, the numbers of tokens.
    Every text must have tokens, and its last two must end together.
    """
    a_lo, a_hi, b_lo, b_hi = a_first[:-1], a_first[1:], b_first[:-1], b_first[1:]
    low, high = a_lo, a_hi - 1  # ends inside the interval that were not looked up yet
    middle, reach = (low + high) // 2, np.zeros(len(a_lo), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a_lo):
        leaf = (low >= high) | (b_hi - b_lo <= 1)
        if leaf.any():
            done.append((a_lo[leaf], b_lo[leaf]))
            a_lo, a_hi, b_lo, b_hi, low, high, middle, reach = (x[~leaf] for x in (a_lo, a_hi, b_lo, b_hi, low, high, middle, reach))
            if not len(a_lo):
                break
        first, last = np.maximum(low, middle - reach), np.minimum(high, middle + reach + 1)
        sizes = last - first
        begin = np.cumsum(sizes) - sizes
        token = np.arange(int(sizes.sum())) + np.repeat(first - begin, sizes)
        end = a_ends[token]
        other = np.searchsorted(b_ends, end)
        far = np.abs(token - np.repeat(middle, sizes))
        far[b_ends[other] != end] = len(a_ends)  # the last end is shared, so `other` is a place
        nearest = np.minimum.reduceat(far, begin)
        found = nearest < len(a_ends)
        # Nothing within reach: the window doubles, until it holds every end of the interval.
        out = ~found & (first == low) & (last == high)
        if out.any():
            done.append((a_lo[out], b_lo[out]))
        on = ~found & ~out
        which = np.flatnonzero(found)
        d, m = nearest[which], middle[which]
        left = m - d
        ok = left >= first[which]
        ok[ok] = far[(begin[which] + left - first[which])[ok]] == d[ok]
        at = np.where(ok, left, m + d)
        cut_b = other[begin[which] + at - first[which]]
        # Ends nearer to the middle than the cut are not shared; neither is the left one if the right was taken.
        new_low = np.r_[low[which], np.where(ok & (d > 0), m + d, at + 1)]
        new_high = np.r_[np.where(ok, at, m - d), high[which]]
        new_high = np.maximum(new_high, new_low)
        a_lo, a_hi = np.r_[a_lo[on], a_lo[which], at + 1], np.r_[a_hi[on], at + 1, a_hi[which]]
        b_lo, b_hi = np.r_[b_lo[on], b_lo[which], cut_b + 1], np.r_[b_hi[on], cut_b + 1, b_hi[which]]
        low, high = np.r_[low[on], new_low], np.r_[high[on], new_high]
        middle = np.r_[middle[on], (new_low + new_high) // 2]
        reach = np.r_[np.maximum(1, reach[on] * 2), np.zeros(len(new_low), np.int64)]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


_ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "links array<long>, times array<int>")


class Aligner:
    def __init__(self, byte_definition: str, piece_proto: bytes):
        self.encoder = PairEncoder(byte_definition, piece_proto)
        a, b = self.encoder.a.bytes, self.encoder.b.bytes
        self.a_size, self.b_size = self.encoder.a.sizes, self.encoder.b.sizes
        # Decimal ids with what follows them: inside a group, at its end, at the end of the text.
        self.shown = [f"{i}{s}".encode() for i in range(len(a)) for s in ",|"]
        self.shown += [f"{i}{s}".encode() for i in range(len(b)) for s in (",", ";", "")]

    def rows(self, texts: list[str], keep: bool) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, links, times, groups) of each text."""
        out: list[tuple] = [(0, 0, 0, 0, "", [], [], b"")] * len(texts)
        filled = [i for i, t in enumerate(texts) if t]
        coded = [(i, a, b) for i, (a, b) in zip(filled, self.encoder.encode([" " + texts[i] for i in filled])) if b is not None]
        if not coded:
            return out
        which, a_parts, b_parts = zip(*coded)
        a_ids, b_ids = (np.frombuffer(b"".join(x), _PACK).astype(np.int64) for x in (a_parts, b_parts))
        a_first, b_first = (np.cumsum([0, *(len(p) // _PACK.itemsize for p in x)]) for x in (a_parts, b_parts))
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        a_group, b_group = shared_cut_groups(a_ends, b_ends, a_first, b_first)
        n_a, n_b = len(a_ids), len(b_ids)
        # The tokens of a group stand together, those of A first.
        a_last, b_last = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        a_last[np.r_[a_group[1:], n_a] - 1] = 1
        b_last[np.r_[b_group[1:], n_b] - 1] = 1
        b_last[b_first[1:] - 1] = 2
        shown = np.empty(n_a + n_b, np.int64)
        a_sizes, b_sizes = np.diff(np.r_[a_group, n_a]), np.diff(np.r_[b_group, n_b])
        shown[np.arange(n_a) + np.repeat(b_group, a_sizes)] = a_ids * 2 + a_last
        shown[np.arange(n_b) + np.repeat(a_group + a_sizes, b_sizes)] = 2 * len(self.a_size) + b_ids * 3 + b_last
        # Ends of both kinds cut a text into overlaps of one pair of tokens each.
        only_b = b_ends[b_last == 0]
        is_a = np.ones(n_a + len(only_b), bool)
        is_a[np.searchsorted(a_ends, only_b) + np.arange(len(only_b))] = False
        is_b = ~is_a
        is_b[is_a] = a_last == 1
        a_kinds, b_kinds = len(self.a_size), len(self.b_size)
        link = a_ids[np.cumsum(is_a) - is_a] * b_kinds + b_ids[np.cumsum(is_b) - is_b]
        n_groups = np.diff(np.searchsorted(a_group, a_first))
        n_links = np.diff(a_first) + np.diff(b_first) - n_groups
        key = np.sort(np.repeat(np.arange(len(which)), n_links) * (a_kinds * b_kinds) + link)
        lead = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(np.r_[lead, len(key)])
        key = key[lead]
        per_text = np.searchsorted(key, np.arange(len(which) + 1) * (a_kinds * b_kinds))
        key %= a_kinds * b_kinds
        links = (key // b_kinds << 32) + key % b_kinds
        shown_first = a_first + b_first
        for k, i in enumerate(which):
            groups = b"".join(map(self.shown.__getitem__, shown[shown_first[k]:shown_first[k + 1]].tolist()))
            x, y = per_text[k], per_text[k + 1]
            out[i] = (int(a_first[k + 1] - a_first[k]), int(b_first[k + 1] - b_first[k]), int(n_groups[k]), int(n_links[k]),
                      hashlib.sha256(groups).hexdigest(), links[x:y], times[x:y], groups if keep else b"")
        return out


def aligned_documents(docs: DataFrame, byte_level: str, pieces: str, groups: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): numbers of tokens, groups and links, the digest of the groups, the
    different links (id of A above, id of B in the lower 32 bits) and how often each occurs.

    `byte_level` and `pieces` are the files of the tokenizers.  With `groups` the groups themselves follow
    as `a1,a2|b1;a3|b2,b3`.
    """
    spark = docs.sparkSession
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        content = (f.read(), g.read())
    files = spark.sparkContext.broadcast(content)
    name = f"aligner-{zlib.crc32(content[0].encode())}-{zlib.crc32(content[1])}"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = per_worker(name, lambda: Aligner(*files.value))
        for batch in batches:
            for first, last, _, _ in chunks(batch.column("text")):
                part = batch.slice(first, last - first)
                rows = aligner.rows(part.column("text").to_pylist(), groups)
                n_a, n_b, n_groups, n_links, digest, links, times, shown = zip(*rows)
                columns = [part.column("row"), part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
                           pa.array(digest), pa.array(links, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"]
                if groups:
                    columns, names = [*columns, pa.array([s.decode() for s in shown])], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    keyed = narrow(docs, {"doc_id": "long", "text": "string"}).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return keyed.mapInArrow(align, _ALIGNED + (", groups string" if groups else ""))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, b, n, best): how often each pair of ids is linked in the corpus; best if no pair of its B id has more."""
    counted = aligned.select(F.inline(F.arrays_zip("links", "times"))).groupBy(F.col("links").alias("link")).agg(F.sum("times").alias("n"))
    counted = staged(counted.withColumn("b", F.col("link").bitwiseAND(F.lit(0xFFFFFFFF))), "link-counts")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("link", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_scores(docs: DataFrame, byte_level: str, pieces: str, known: int = KNOWN_LINKS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs`."""
    aligned = staged(aligned_documents(docs, byte_level, pieces), "aligned")
    counts = staged(link_counts(aligned), "link-best").drop("b")
    links = aligned.select("row", F.inline(F.arrays_zip("links", "times"))).withColumnRenamed("links", "link")
    if counts.count() <= known:
        found = links.join(F.broadcast(counts), "link")
    else:
        frequent = staged(counts.orderBy(F.desc("n"), "link").limit(known), "link-frequent")
        rest = links.join(F.broadcast(frequent.select("link")), "link", "left_anti").join(counts, "link")
        found = links.join(F.broadcast(frequent), "link").unionByName(rest)
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.drop("links", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
