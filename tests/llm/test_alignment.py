"""Token alignment beside a plain walk over both tokenizations."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankwell.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    with open(B, "rb") as f:
        b_bytes = alignment.PieceTokenizer(f.read()).bytes
    return (a, sentencepiece.SentencePieceProcessor(model_file=B),
            lambda i: bytes(letters[c] for c in a.id_to_token(i)), b_bytes)


TEXTS = ["Hello world, hello tokens.", "", None, " ", "  two  blanks ", "▁ a mark", "<s>x</s> <|endoftext|>", "日本語のテキスト と 한국어 🙂🙃",
         "a\n\n  b\x1c c\t\td", "! \x1c", "x\r\ny;\r\n  z", "nul \x00 é é", "same same same", "same same same", "ab " * 4000, "q" * 3000,
         "\n\n\n", " " * 25_000 + "x", "don't 12345 ;) {\r", "　 \xa0e   f"]


def walk(text, coders):
    """Groups, and links as id pairs, by comparing byte ranges of all tokens."""
    a, b, a_bytes, b_bytes = coders
    if not text:
        return None
    whole = (" " + text).encode()
    sides = [[(i, a_bytes(i)) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, b_bytes[i]) for i in b.encode(text)]]
    if any(b"".join(x for _, x in side) != whole for side in sides):
        return None
    spans = []
    for side in sides:
        at, own = 0, []
        for i, x in side:
            own.append((at, at + len(x), i))
            at += len(x)
        spans.append(own)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, links, low = [], [], 0
    at = [0, 0]
    for cut in cuts:
        parts = []
        for k in (0, 1):
            first = at[k]
            while at[k] < len(spans[k]) and spans[k][at[k]][1] <= cut:
                at[k] += 1
            parts.append(spans[k][first:at[k]])
        groups.append("|".join(",".join(str(i) for _, _, i in p) for p in parts))
        links += [(i, j) for s, e, i in parts[0] for t, f, j in parts[1] if max(s, t) < min(e, f)]
        low = cut
    assert low == len(whole)
    return len(sides[0]), len(sides[1]), groups, links


def expected(rows, coders):
    walked = [(i, walk(t, coders)) for i, t in rows]
    times = Counter(x for _, w in walked if w for x in w[3])
    best = {}
    for (_, b), n in times.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        (((i, 0, 0, 0, 0, 0, 0, "") if w is None else
          (i, w[0], w[1], len(w[2]), len(w[3]), sum(times[x] == best[x[1]] for x in w[3]), sum(times[x] for x in w[3]),
           hashlib.sha256(";".join(w[2]).encode()).hexdigest())) for i, w in walked), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row long, link long")


@pytest.mark.parametrize("known", [alignment.KNOWN_LINKS, 20])
def test_scores_by_a_plain_walk(spark, coders, known):
    """Also with most links joined by shuffle; rows that repeat or lack an id are documents of their own."""
    rows = [*enumerate(TEXTS), (None, "no id at all"), (3, "a second three")]
    got = alignment.alignment_scores(frame(spark, rows), A, B, known=known)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, coders)


def test_documents(spark, coders):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = alignment.alignment_scores(frame(spark, rows), A, B)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, coders)


def test_groups_are_carried_on_request(spark, coders):
    rows = [(1, "Hello world"), (2, None)]
    got = {r.doc_id: r.groups for r in alignment.aligned_documents(frame(spark, rows), A, B, groups=True).collect()}
    assert got == {1: ";".join(walk("Hello world", coders)[2]), 2: ""}


@pytest.mark.parametrize("seed", range(30))
def test_groups_of_random_ends(seed):
    """Cuts anywhere: dense, rare, none, at one side only."""
    rng = np.random.default_rng(seed)
    a_all, b_all, a_first, b_first, want, base = [], [], [0], [0], [], 0
    for _ in range(12):
        n = int(rng.integers(1, 400))
        share = rng.choice([0.02, 0.3, 0.9])
        a = np.flatnonzero(rng.random(n) < share) + 1
        b = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.9])) + 1
        if rng.random() < 0.3:
            b = b[b > n // 2]
        a, b = np.union1d(a, [n]) + base, np.union1d(b, [n]) + base
        at = np.intersect1d(a, b)[:-1]
        want += [(a_first[-1], b_first[-1])]
        want += [(a_first[-1] + int(np.searchsorted(a, c)) + 1, b_first[-1] + int(np.searchsorted(b, c)) + 1) for c in at]
        a_all.append(a)
        b_all.append(b)
        a_first.append(a_first[-1] + len(a))
        b_first.append(b_first[-1] + len(b))
        base += n
    got = alignment.shared_cut_groups(np.concatenate(a_all), np.concatenate(b_all), np.array(a_first), np.array(b_first))
    assert list(zip(*(x.tolist() for x in got))) == want


def test_empty_table(spark):
    assert alignment.alignment_scores(frame(spark, []), A, B).collect() == []
