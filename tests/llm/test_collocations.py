"""Collocations beside SQL and beside plain counting; summaries beside their guarantee."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from checks.compare import compare
from rankwell.llm import collocations as col

DOCS = "doc_id long, text string, lang string, key long, n long, part long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS)


def plain(rows, least, longest, top, share):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = {}
    for (lang, w), a in found.items():
        longer = [b for (g, v), b in found.items() if g == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= share * a for b in longer):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    kinds = ["new", "york", "city", "of", "the", "ÉTÉ", "x1", "a", "b", "c", "日本"]
    out = []
    for i in range(120):
        w = rng.choice(kinds, int(rng.integers(0, 60)))
        out.append((i, "".join(x + str(rng.choice([" ", "  ", "\t", ". ", "\n", ",", " New York City "])) for x in w), ["en", "de", None][i % 3]))
    return out + [(None, "new york", "en"), (5, "new york", "en"), (900, None, "en"), (901, "", None), (902, " .,;\n", "fr"),
                  (903, "one two", "rare"), (904, "go on " * 3000, "long"), (905, "end of text", "en"), (906, "start", "en")]


@pytest.mark.parametrize("least,longest,top,share", [(10, 3, 2000, 50), (3, 4, 5, 30), (1, 2, 2000, 100)])
def test_by_plain_counting(spark, rows, least, longest, top, share):
    got = col.collocations(frame(spark, rows), least, longest, top, share)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, longest, top, share)


def test_by_sql(spark, rows):
    import pandas as pd

    duck = duckdb.connect()
    duck.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]))
    assert compare(col.collocations(frame(spark, rows)).toPandas(), duck.execute(col.collocations_sql()).df()) is None


def test_full_filter_and_colliding_keys(spark, rows, monkeypatch):
    """Marks that let everything pass cost no row and add none."""
    monkeypatch.setattr(col, "_marks", lambda keys: np.full(col.FILTER_BITS // 8, 255, np.uint8))
    monkeypatch.setattr(col, "HELD", 100)
    assert sorted(tuple(r) for r in col.collocations(frame(spark, rows)).collect()) == plain(rows, 10, 3, 2000, 50)


@pytest.mark.parametrize("seed", range(8))
def test_summaries_keep_what_is_frequent(seed):
    """Whatever the parts and their order: what occurs `least` times survives, within the stated bounds."""
    rng = np.random.default_rng(seed)
    least = 10
    items = np.r_[rng.integers(0, 20_000, 30_000), np.repeat(rng.integers(0, 50, 40), 12), np.zeros(20_000, np.int64)].astype(np.uint64)
    rng.shuffle(items)
    summary = col.Summary(len(items) // least + 1)
    for part in np.array_split(items, 37):
        keys, times = np.unique(part, return_counts=True)
        blob = col.packed_keys(keys, times)
        a, b = col.unpacked_keys(blob)
        assert (a == keys).all() and (b == times).all()
        summary.add(a, b)
        summary.merge()
    kept = dict(zip(summary.keys.tolist(), summary.times.tolist()))
    assert len(kept) <= summary.capacity and summary.taken < least
    for key, n in Counter(items.tolist()).items():
        assert kept.get(key, 0) <= n <= kept.get(key, 0) + summary.taken


def test_products_beyond_64_bits(spark):
    """The decimal arithmetic of the score, on counts near 10^15."""
    a, l, r = 10**15 - 7, 10**15 - 3, 10**15 - 1
    got = spark.sql(f"select ((cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0))) * cast({a} as decimal(15,0))) "
                    f"div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0))) as s").collect()[0].s
    assert got == 1_000_000 * a * a // (l * r)


def test_empty_table(spark):
    assert col.collocations(frame(spark, [])).collect() == []
