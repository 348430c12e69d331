"""Operators held against brute force on small frames, with nulls, empty texts, ties, repeats and clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.llm import (
    chat, decontamination, language, licenses, mixing, ngram_join, quality, repeats, shared, token_files, toxicity,
)
from rankwell.llm.components import components
from rankwell.scratch import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, n int"


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    full = [(r[0], r[1], *(list(r[2:]) + ["en", "s"][len(r) - 2:])[:2], 0, 1, "x", 2) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n, kinds=200):
    return " ".join(f"w{int(k)}" for k in rng.integers(0, kinds, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = words(rng, 120)
    out = [(i, words(rng, int(rng.integers(1, 160)))) for i in range(30)]
    for i in range(30, 70):  # near copies of one text
        own = base.split()
        for k in rng.integers(0, 120, int(rng.integers(0, 6))):
            own[k] = f"x{i}_{k}"
        out.append((i, " ".join(own)))
    out += [(70, base), (71, base), (72, None), (73, ""), (74, "one two"), (75, "One  two"), (76, " \n "), (None, base),
            (77, words(rng, 4000, 100000))]
    return out


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


@pytest.mark.parametrize("n,percent,often", [(4, 85, 32), (5, 80, 2)])
def test_classes_by_brute_force(spark, texts, n, percent, often):
    sets = {i: shingles(t, n) for i, t in texts if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = sets[a] | sets[b]
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_classes(
        frame(spark, texts), n, percent, often).collect()}
    assert got.pop(None)[1] is None
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k <= 40} == {1} and got[129] == 100 and got[201] == 200


def kept_by_brute_force(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        covered = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            part = raw[p:p + length]
            if part in seen:
                covered[p:p + length] = True
            seen.add(part)
        spans = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        out[i] = (len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_by_brute_force(spark):
    rng = np.random.default_rng(3)
    passage = words(rng, 60)
    rows = [(0, "é" * 300), (1, None), (2, ""), (3, "short"), (4, "ab" * 200), (5, passage), (6, passage)]
    for i in range(7, 40):
        text = words(rng, int(rng.integers(1, 80)), 50)
        rows.append((i, text + passage[:int(rng.integers(0, len(passage)))] + words(rng, 30) + (passage if i % 3 == 0 else "")))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert got == kept_by_brute_force(rows, 100)


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = words(rng, 3000, 3000)
    rows = [(1, text), (2, text[5000:9000] + "!" + text[100:400])]
    batch = shared.cut(None, {"doc_id": np.array([1, 2]), "text": [t for _, t in rows]})
    whole = [n for notes, _, _ in repeats._noted(batch, 100) for n in notes.tolist()]
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4096)
    alone = [shared.cut(None, {"doc_id": np.array([i]), "text": [t]}) for i, t in rows]
    pieces = [n for b in alone for notes, _, _ in repeats._noted(b, 100) for n in notes.tolist()]
    assert set(whole) == set(pieces)


def test_prefix_boundaries_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(40):
        text = rng.integers(97, 100, int(rng.integers(5, 120))).astype(np.uint8)
        text[-1] = 255
        length = int(rng.integers(1, 12))
        order = repeats.suffix_order(text, length + 1)
        common = repeats.prefix_boundaries(text, order, length)
        raw = text.tobytes()
        for r in range(1, len(raw)):
            x, y = raw[order[r - 1]:], raw[order[r]:]
            same = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
            assert common[r] == (same if same < length else -1)


def test_token_files_round_trip(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    odd = [(90, "<|endoftext|> a#b ##"), (91, "a\x1cb c"), (92, "İé\u0301 don't"), (-5, "first"), (93, "dup"), (93, "dup"), (93, "other")]
    rows = [r for r in texts if r[0] is not None] + odd
    got = token_files.token_records(frame(spark, rows), scratch_path(spark, "t"), path).collect()
    plain = Tokenizer.from_file(path)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    want, start = [], 0
    for i in sorted(ids):
        if i != 93:
            want.append((i, start, len(ids[i][0]), zlib.crc32(ids[i][0].tobytes())))
        start += sum(map(len, ids[i]))
    found = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got)
    assert [r for r in found if r[0] != 93] == want
    assert sorted(r[3] for r in found if r[0] == 93) == sorted(zlib.crc32(x.tobytes()) for x in ids[93])


def test_perfect_hash_has_no_gap_and_rejects_strangers(spark):
    keys = np.random.default_rng(1).choice(10**12, 3000, replace=False)
    seeds, slot = token_files.perfect_seeds(keys)
    assert sorted(slot) == list(range(3000)) and (token_files.slots_of(keys, seeds, 3000) == slot).all()
    records = spark.range(5000).select(
        (F.col("id") * 3).alias("doc_id"), F.lit(0).alias("shard"), F.col("id").cast("int").alias("record"),
        F.col("id").alias("offset"), F.lit(1).cast("long").alias("n"))
    path = scratch_path(spark, "index")
    buckets = token_files.build_index(records, path)
    found = token_files.look_up(spark.range(15000).select(F.col("id").alias("doc_id")), spark.read.parquet(path), buckets)
    assert found.count() == 5000 and found.where("doc_id <> record * 3").isEmpty()


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, words(rng, int(rng.integers(1, 60))), "en", "abc"[i % 3] if i % 10 else None) for i in range(900)]
    rows += [(1000 + i, None, "en", "a") for i in range(3)] + [(2000, "x y z", "en", "d")] * 50
    got = mixing.mix_sources(frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    sums = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(sums.target.sum() - sums["size"].sum()) < 1e-6 and (sums.target <= 3 * sums["size"] + 1e-9).all()
    assert (abs(sums.taken - sums.target) <= 60).all()
    again = mixing.mix_sources(frame(spark, rows).repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), (None, 50), ("c", 1)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # Weights 1, 2, 3, 1 of 161: b and c stop at 30 and 3, the rest is shared 1 : 1.
    assert got == pytest.approx({"a": 64.0, "b": 30.0, "c": 3.0, None: 64.0})


def test_chat_round_trip_with_control_strings(spark):
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
            (1, 0, "assistant", None), (1, 1, "assistant", " \\</s>  "), (1, 2, None, "\\\\[ROLE x] [/ROLE]"), (1, 3, "to ]ol", "<s>"),
            (None, 0, "user", "probe"), (2, None, "user", "a"), (2, 1, "user", "b"), (2, 1, "user", "b")]
    rows += [(3, k, ("user", "assistant")[k % 2], f"text {k}" * (k % 5)) for k in range(70)]
    got = {r.conv_id: r for r in chat.formatted_digests(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        formatted = chat.instruction_template([(r or "", t or "") for _, _, r, t in own])
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (
            len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))


def test_templates_that_rewrite_history_are_found(spark):
    def forgets(turns):
        return "".join(f"<{r}>{t if k >= len(turns) - 2 else '...'}" for k, (r, t) in enumerate(turns))

    assert chat.rendered_spans([("u", "a"), ("v", "b")], lambda t: "".join(f"<{r}>{x}" for r, x in t)) == [("<u>a", 3, 4), ("<v>b", 3, 4)]
    assert chat.rendered_spans([("u", "a"), ("v", "b"), ("u", "c")], forgets) is None
    rows = spark.createDataFrame([(1, k, "u", str(k)) for k in range(3)], "conv_id long, turn int, role string, text string")
    assert [r.rewrites for r in chat.format_conversations(rows, forgets).collect()] == [True]


def test_prefixes_are_those_of_the_whole_conversation(spark):
    plain = [("u", f"text {k}") for k in range(40)]
    rows = spark.createDataFrame([(1, k, *t) for k, t in enumerate(plain)], "conv_id long, turn int, role string, text string")

    def numbered(turns):
        return "".join(f"<{k} {r}>{t}" for k, (r, t) in enumerate(turns))

    def rewrites_late(turns):
        return "".join(f"<{r}>{t if len(turns) < 30 or k else '...'}" for k, (r, t) in enumerate(turns))

    got = sorted(chat.format_conversations(rows, numbered).collect(), key=lambda r: r.part)
    assert "".join(r.piece for r in got) == numbered(plain)
    assert [r.piece[r.text_start:r.text_end] for r in got] == [t for _, t in plain]
    got = chat.format_conversations(rows, rewrites_late).collect()
    assert [(r.turns, r.rewrites, r.piece) for r in got] == [(40, True, rewrites_late(plain))]
    with pytest.raises(Exception, match="declared local"):
        chat.format_conversations(rows, lambda turns: str(len(turns)) + numbered(turns), local=True).collect()


def test_license_positions_and_suppression(spark):
    rows = [(1, "Foo CC-BY bar. All  Rights\nreserved cc by"), (2, None), (3, "GNU General Public License, version 3."),
            (4, "Licensed under the Apache License, Version 2.0."), (5, "acc bye allrights reserved"), (6, ""), (7, "cc by cc by")]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (9, 3, 1, 7, "cc-by,reserved")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels) == (0, 0, None, "")
    assert (got[3].base_labels, got[3].first_word, got[4].labels, got[5].n_base, got[7].n_base) == ("gpl", 1, "apache", 0, 2)
    spans = {(r.doc_id, r.start, r.end, r.label) for r in licenses.license_spans(frame(spark, rows)).collect()}
    assert (3, 0, 6, "gpl") in spans and (4, 0, 8, "apache") in spans and len([s for s in spans if s[0] in (3, 4)]) == 2
    assert len(licenses.signature_rules()) > 200
    assert all(any(sign in keyword for sign in licenses.SIGNS) for _, _, keyword, _, _ in licenses.signature_rules())


def test_reparameterised_question_is_found(spark):
    item = "A train leaves the old station with 12 wagons and Peter counts 12 people near the 30 km mark before noon today"
    other = "A train leaves the old station with 45 wagons and Anna counts 45 people near the 99 km mark before noon today"
    wrong = other.replace("45 people", "46 people")
    docs = frame(spark, [(1, "Yes. " + item), (2, "Some words first.\n" + other + ". And more."), (3, wrong), (4, None), (5, ""),
                         (None, item), (6, "a train leaves the old harbour and nobody counts anything"), (7, item[:60])])
    bench = spark.createDataFrame([(9, item, 1), (10, None, 1), (11, "too short", 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, 9), (2, 9)}
    left = decontamination.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 6


def test_every_place_of_an_item_is_tried(spark):
    item = "A train leaves the old station with 12 wagons and Peter counts 12 people near the 30 km mark before noon today"
    wrong = item.replace("12 people", "46 people")
    far = " ".join(f"filler{k}" for k in range(300))
    long = item + " while old John Smith sells seven green apples to his good friend Mary Jones near the river bank"
    docs = frame(spark, [(1, wrong + ". " + item), (2, wrong + ". " + far + ". " + item.replace("12", "45")), (3, wrong + ". " + far + ". " + wrong),
                         (4, f"{wrong}. {wrong}. {item}. {wrong}"), (5, long.replace("John Smith sells", "John Smith Smith sells")),
                         (6, wrong.replace(" and ", ". " + far + " "))])
    bench = spark.createDataFrame([(9, item), (8, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert {(1, 9), (2, 9), (4, 9), (5, 8), (5, 9)} <= got and not {3, 6} & {d for d, _ in got}


def test_items_without_windows_are_found_by_their_tokens(spark):
    items = {1: "12 + 7 * 3 = 33", 2: "Who wrote Hamlet?", 3: "Paris, London, Rome, Madrid, Berlin and Vienna", 4: "pangram", 5: None, 6: "?!",
             7: "Add 17 km to 25 km then 4 km"}
    texts = ["We know that 12 + 7 * 3 = 33.", "12 + 7 * 3 = 34", "He asked: Who wrote Hamlet? Nobody knew", "and who wrote Hamlet", "who wrote hamlets",
             "From Paris, London, Rome, Madrid, Berlin and Vienna it came", "Paris, London, Rome, Madrid, Berlin and Zurich", "a Pangram", "pangrams",
             None, "", "so Add 17 km to 25 km then 4 km", "Add 17 km to 26 km then 4 km", "112 + 7 * 3 = 33", "12 + 7 * 3 = 333"]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, list(enumerate(texts))), bench).collect()}
    cut = lambda x: re.findall(r"\w+", (x or "").lower())
    inside = lambda a, b: any(b[i:i + len(a)] == a for i in range(len(b) - len(a) + 1))
    assert got == {(d, i) for i, x in items.items() for d, y in enumerate(texts) if cut(x) and inside(cut(x), cut(y))}
    assert len(got) == 6


def test_quality_statistics(spark):
    rows = [(1, "a b c a b c x"), (2, None), (3, ""), (4, "l1\nl1\n \n \nl2 #$"), (5, "word " * 60), (6, " ".join(f"Wort{i}" for i in range(60)))]
    got = {r.doc_id: r for r in quality.quality_verdicts(frame(spark, rows)).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_repeat_words) == (7, 7, 6)
    assert (got[2].n_words, got[2].base_failed, got[2].kept) == (0, True, False)
    assert (got[4].n_dup_lines, got[4].n_symbols) == (1, 2)
    assert (got[5].n_repeat_words, got[5].base_failed, got[6].base_failed) == (60, True, False)


def test_order_does_not_change_the_verdict(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rules = [quality.Rule("a", F.col("doc_id") % 2 == 0), quality.Rule("b", F.col("doc_id") % 3 == 0)]
    results = [{r.doc_id for r in quality.cascade(docs, rules, order).where("kept").collect()} for order in (["a", "b"], ["b", "a"])]
    assert results[0] == results[1] == {i for i in range(100) if i % 2 and i % 3}
    assert sorted(quality.rule_order(docs, rules)) == ["a", "b"]


def test_decoder_restores_words(spark):
    rows = [(i, "you are an idiot and a stupid loser, this is plain text about nothing") for i in range(50)]
    reader = toxicity.Reader(toxicity.language_model(frame(spark, rows)))
    assert reader.restorer.restore("1d10t") == "idiot" and reader.restorer.restore("s.t.u.p.1.d") == "stupid"
    assert reader.restorer.restore("looooser") == "loser"
    assert reader.spread("an i d i o t here".split()) == ["idiot"]


def test_every_word_of_labelled_rows_is_known(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = ["".join(letters[i // 26 ** k % 26] for k in range(5)) for i in range(200_050)]
    rows = [(i, " ".join(many)) for i in range(3)] + [(3, "rare, rare; twice"), (4, "x1 x1 x1 (often) often often often"), (5, None)]
    got = toxicity.known_words(frame(spark, rows))
    assert set(got) == {*many, "often"}
    assert got["often"] == pytest.approx(np.log(4 / (3 * len(many) + 3 + 4))) and got[many[-1]] == got[many[0]]


def test_toxicity_finds_obfuscated_words(spark):
    rng = np.random.default_rng(8)
    bad = ["idiot", "stupid", "worthless"]
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, words(rng, 40, 60) + (f" {bad[i % 3]} {bad[(i // 4) % 3]}" if toxic else "")))
        marks.append((i, int(toxic), None))
    rows += [(900, "w1 w2 1d10t w3"), (901, "w1 w2 w3"), (902, None), (903, ""), (904, "w4 s t u p i d w5")]
    labels = spark.createDataFrame([*marks, (None, 1, None), (999, None, None)], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    assert [got[i].predicted for i in (900, 901, 902, 903, 904)] == [1, 0, 0, 0, 1]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and all(got[i].predicted == (i % 4 == 0) for i in held)


def test_spread_and_long_tokens_are_decoded_whole(spark):
    rng = np.random.default_rng(8)
    bad = ["idiot", "stupid", "worthless"]
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, words(rng, 40, 60) + " these are plain words" + (f" {bad[i % 3]} {bad[(i // 4) % 3]}" if toxic else "")))
        marks.append((i, int(toxic)))
    cases = ["s t u p i d i d i o t", "a i d i o t", "w1 y s t u p i d w2", " ".join("these" * 14 + "worthlessidiot" + "words" * 4),
             (30 * ".").join("idiot"), "1D107", "|+1 57 1d107", "these.idiot.words", "s-t-u-p-i-d-i-d-i-o-t"]
    plain = ["t h e s e a r e p l a i n", "455 1234567 $12", " ".join("theseareplainwords" * 6), "x" * 3000, "- - - - 1 1 1 1"]
    rows += [(1000 + k, x) for k, x in enumerate(cases)] + [(2000 + k, x) for k, x in enumerate(plain)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(frame(spark, rows), labels).collect()}
    assert [x for k, x in enumerate(cases) if not got[1000 + k]] == []
    assert [x for k, x in enumerate(plain) if got[2000 + k]] == []
    # A token without any letter is decoded, and one longer than the open steps to its end.
    reader = toxicity.Reader(toxicity.language_model(frame(spark, [(i, "an ass sat in the grass, it was stupid") for i in range(50)])))
    assert "ass" in reader.token_signs("455") and "ass" in reader.token_signs("4$$")
    assert reader.restorer.restore("a" + "." * 2000 + "s" + "." * 2000 + "s") == "ass"
    assert "stupid" in reader.token_signs("s" * 70 + "tupid")


def test_bound_on_labels_keeps_the_ratio_of_classes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, marks = [], []
    for i in range(2400):  # one in eight is toxic, and "idiot" stands in clean rows as well
        toxic = i % 8 == 0
        rows.append((i, words(rng, 10, 60) + (" idiot" if i % (2 if toxic else 7) == 0 else "")))
        marks.append((i, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    whole, sample = toxicity.label_sample(labels), toxicity.label_sample
    monkeypatch.setattr(toxicity, "label_sample", lambda df: sample(df, 420))
    n = {r.toxic: r for r in sample(labels, 420).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    totals = {r.toxic: r["count"] for r in whole.groupBy("toxic").count().collect()}
    assert n[0].n == 210 and {k: round(r.w) for k, r in n.items()} == totals
    bounded = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame(spark, rows), labels).collect()}
    monkeypatch.setattr(toxicity, "label_sample", sample)
    every = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame(spark, rows), labels).collect()}
    logit = lambda p: np.log(p / (1 - p))
    assert np.median([abs(logit(bounded[i]) - logit(every[i])) for i in every]) < 0.7


def test_language_families(spark):
    rng = np.random.default_rng(9)
    parts = {"en": ["the", "ing", "tion", "and"], "de": ["der", "ung", "sch", "ein"], "fr": ["les", "eau", "oui", "que"], "es": ["los", "cion", "ado", "llo"]}
    rows = []
    for i in range(400):
        lang = list(parts)[i % 4]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(30)), lang))
    rows += [(500, None, "en"), (501, "123 !!", "fr"), (502, "schung einder", None)]
    got = {r.doc_id: r for r in language.identify_languages(frame(spark, rows)).collect()}
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0 and got[502].lang_pred == "de"
    held = [(i, r[2]) for i, r in enumerate(rows[:400]) if got[i].held_out]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.95
    empty = language.identify_languages(frame(spark, rows).where("false"))
    assert empty.count() == 0


@pytest.mark.parametrize("operator", [
    lambda d, s: ngram_join.ngram_jaccard_classes(d), lambda d, s: repeats.remove_repeats(d), lambda d, s: licenses.scan_licenses(d),
    lambda d, s: mixing.mix_sources(d), lambda d, s: quality.quality_verdicts(d),
    lambda d, s: decontamination.contaminated(d, s.createDataFrame([], "item_id long, text string")),
    lambda d, s: toxicity.toxicity_scores(d, s.createDataFrame([], "doc_id long, toxic int"))])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [(1, "a")]).where("doc_id > 1"), spark).count() == 0


def test_tokens_that_occur_once_go_across_batches(spark):
    from rankwell.llm.ngram_join import _met_again

    rows = [(t, o, False) for t in range(40) for o in range(1 + t % 4)] + [(99, 1, True), (98, 1, False)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 3, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            frame = spark.createDataFrame(rows, "token long, owner long, hot boolean")
            found = sorted(map(tuple, _met_again(frame, "owner", "token = 98").collect()))
            assert found == sorted([(t, o) for t, o, _ in rows if t < 40 and t % 4] + [(99, 1), (98, 1)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_blocks_count_what_pairs_share(spark):
    """Large groups, small ones beside them, and equal bounds: the pairs kept are those that counting gives."""
    import random

    from rankwell.llm.ngram_join import ngram_jaccard_classes

    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for k in range(260):
        words = list(base)
        for at in rng.sample(range(60), 1 if k < 150 else rng.choice([2, 3, 5])):
            words[at] = f"x{k}_{at}" if k % 3 else f"y{at}"
        docs.append((k, " ".join(words)))
    sets = {i: {tuple(t.split()[j:j + 4]) for j in range(57)} for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = {r.doc_id: r.component_id for r in ngram_jaccard_classes(
        spark.createDataFrame(docs, "doc_id long, text string"), n=4, percent=85).collect()}
    assert found == {i: find(i) for i in sets}


def test_token_encoder_equals_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    from rankwell.llm.queries import word_tokenizer

    definition = open(word_tokenizer(), encoding="utf-8").read()
    whole = Tokenizer.from_str(definition)
    encoder = token_files._Encoder(definition, "<u2", "<|endoftext|>")
    assert encoder.by_piece
    signs = [chr(c) for c in range(1, 256)] + list("'''sdtmvrel.,0129éÉßÿÀ \n") * 6 + ["ı", "İ", "Σ", "é", "中", "１", "<|endoftext|>"]
    draw = random.Random(5)
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 60))) for _ in range(3000)]
    expected = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == expected
    encoder.by_piece, encoder.known, encoder.before = False, {}, {}
    assert encoder.encode(texts) == expected


def test_token_files_hold_little_memory(spark, tmp_path):
    """Batches are bounded by bytes, and no words are held once the shards are read."""
    import sys

    import pyarrow as pa

    from rankwell.llm.queries import word_tokenizer
    from rankwell.llm.shared import per_worker

    docs = spark.createDataFrame([(i, "word " * 20000) for i in range(400)], "doc_id long, text string")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    kind = token_files.write_token_shards(docs, f"{tmp_path}/shards", word_tokenizer())
    sizes = docs.coalesce(1).mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches), "n long")
    largest = sizes.agg({"n": "max"}).first()[0]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert largest <= 2 * (8 << 20)
    rows = token_files.read_token_shards(spark, f"{tmp_path}/shards", kind)
    assert rows.count() == 400
    per_worker("test", list).append(1)
    token_files.nothing_kept()
    assert "_kept_in_worker" not in sys.modules and per_worker("test", list) == []
