import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from rankwell.operators import cleaning
from rankwell.scratch import scratch_path, scratch_root
from rankwell.sources import archives, reviews, tables

GOOD = [
    {"author": "ann", "hotel_url": "h1", "rating": 4, "text": "a\nb", "date": "2015-07-01",
     "property_dict": {"check in": 3, "rooms": "4.0"}},
    {"author": "bob", "hotel_url": "h2", "rating": "5.0", "property_dict": {"check-in": 2.5, "service": "bad"}},
    {"user_id": "carl", "item_id": "h3", "overall_rating": 2.5},
]
ODD = [
    {"author": "dan", "hotel_url": "h1", "rating": 0},
    {"author": "eve", "hotel_url": "h1"},
    {"author": "fay", "hotel_url": "h1", "rating": "great"},
    {"author": "", "hotel_url": "h1", "rating": 3},
    {"author": "gus", "hotel_url": None, "rating": 3},
]
LINES = "\n".join([json.dumps(r) for r in GOOD + ODD] + ["", "   ", "{broken", "17", "[1]", '"text"']) + "\n"


def test_jsonl_skips_what_is_no_record(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(LINES)
    raw = reviews.read_reviews_jsonl(spark, str(tmp_path / "r.jsonl"))
    assert raw.count() == 8
    made = {r.user_key: r for r in cleaning.interactions(raw).collect()}
    assert set(made) == {"ann", "bob", "carl"}
    assert (made["ann"].check_in, made["ann"].rooms, made["ann"].text) == (3.0, 4.0, "a\nb")
    assert (made["bob"].rating, made["bob"].check_in, made["bob"].service) == (5.0, 2.5, None)
    assert (made["carl"].item_key, made["carl"].rating) == ("h3", 2.5)


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD + ODD, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(GOOD[0], indent=1))
    assert reviews.read_reviews_json_array(spark, str(tmp_path)).count() == 9


def members():
    return {
        "d/a.json": json.dumps(GOOD).encode(), "d/b.jsonl": LINES.encode(), "d/one.json": json.dumps(GOOD[0]).encode(),
        "d/lines.json": LINES.encode(), "bad.json": b"\xff\xfe", "skip.csv": b"{}", "empty.json": b"",
    }


EXPECTED = {"d/a.json": 3, "d/b.jsonl": 8, "d/one.json": 1, "d/lines.json": 8}


def write_zip(path):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members().items():
            z.writestr(name, data)


def write_tar(path, mode):
    with tarfile.open(path, mode) as t:
        for name, data in members().items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def per_member(df):
    return {r.member: r["count"] for r in df.groupBy("member").count().collect()}


def test_zip(spark, tmp_path):
    write_zip(tmp_path / "x.zip")
    assert per_member(archives.read_reviews_zip(spark, str(tmp_path))) == EXPECTED
    assert archives.read_reviews_zip(spark, str(tmp_path), max_reviews=5).count() == 5


def test_arrays_are_streamed_whatever_their_name_and_size(spark, tmp_path):
    many = [{**json.loads(json.dumps(GOOD[0])), "title": "x" * 3000} for _ in range(1000)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one_line.json", json.dumps(many))
        z.writestr("array.txt", "\n " + json.dumps(many[:7], indent=1))
        z.writestr("bad_byte.json", json.dumps(many[:3]).encode() .replace(b"xxx", b"\xffxx", 1))
        z.writestr("empty.json", "")
    got = per_member(archives.read_reviews_zip(spark, str(tmp_path)))
    assert got == {"one_line.json": 1000, "array.txt": 7, "bad_byte.json": 3}


def test_corrupt_members_are_an_error_or_a_row(spark, tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("bad.json", json.dumps(GOOD))
        z.writestr("good.json", json.dumps(GOOD))
    raw = path.read_bytes()
    at = raw.index(b"author")
    path.write_bytes(raw[:at] + b"Xuthor" + raw[at + 6:])
    with pytest.raises(Exception, match="CRC"):
        archives.read_reviews_zip(spark, str(tmp_path)).count()
    assert archives.read_reviews_zip(spark, str(tmp_path), lenient=True).where("member = 'good.json'").count() == len(GOOD)
    assert [r.member for r in archives.corrupt_members(spark, str(tmp_path)).collect()] == ["bad.json"]


def _found(text, **limits):
    return list(archives._records(archives._line_parts(io.BytesIO(text.encode()), **limits)))


BROKEN = ['{"a": 1,', '{"a": "x', '{"a": [', '{"a": {"b": 1}', '{', '{"a": 1}}', "words", '"a": 2}', "[", "17"]


@pytest.mark.parametrize("seed", range(60))
def test_members_lose_no_good_object(seed):
    """Objects on one line, on several and side by side, between broken ones: all good ones are found."""
    draw = random.Random(seed)
    good, text = 0, []
    for _ in range(draw.randint(1, 30)):
        if draw.random() < 0.3:
            text.append(draw.choice(BROKEN) + "\n")
            continue
        record = {"id": good, "text": draw.choice(["{", "}", "a\nb", '\\"', "\u2028"]), "p": {"q": [{"r": 1}, {"s": {}}]}}
        good += 1
        text.append(json.dumps(record, indent=draw.choice([None, None, 0, 2]), ensure_ascii=False) + draw.choice(["\n", "\n", "\n\n"]))
    for longest in (7, 1 << 20):
        ids = []
        for kind, piece in _found("".join(text), longest=longest):
            value = archives._is_object(piece) and json.loads(piece)
            ids += [value["id"]] if kind == "object" and value and "id" in value else []
        if longest > 7:
            assert sorted(ids) == list(range(good))
        else:  # parts of lines: no object is given twice
            assert len(ids) == len(set(ids))


def test_broken_first_lines_and_lists_of_them(spark, tmp_path):
    many = [{"author": f"u{k}", "hotel_url": "h", "rating": 3} for k in range(50)]
    lines = "\n".join(json.dumps(r) for r in many)
    pretty = "\n".join(json.dumps(r, indent=2) for r in many[:5])
    members = {"bad_first.txt": '{"author": "x", \n' + lines, "bad_last.jsonl": lines + '\n{"author": "cut', "several.json": pretty,
               "words.txt": "header\n" + lines, "beside.json": "".join(json.dumps(r) for r in many), "after.json": "[1]\n" + lines,
               "one.json": json.dumps(many[0], indent=1), "only_bad.json": '{"author": {'}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z, tarfile.open(tmp_path / "x.tgz", "w:gz") as t:
        for name, text in members.items():
            z.writestr(name, text)
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    want = {"bad_first.txt": 50, "bad_last.jsonl": 50, "several.json": 5, "words.txt": 50, "beside.json": 50, "after.json": 50, "one.json": 1}
    assert per_member(archives.read_reviews_zip(spark, str(tmp_path))) == want
    assert per_member(archives.read_reviews_tar(spark, str(tmp_path))) == want
    faults = [(r.member, r.text) for r in archives.faulty_archive_records(spark, str(tmp_path)).collect()]
    assert sorted(faults) == sorted(2 * [
        ("bad_first.txt", '{"author": "x", '), ("bad_last.jsonl", '{"author": "cut'), ("words.txt", "header"), ("after.json", "1"),
        ("only_bad.json", '{"author": {')])


def test_mixed_folder_keeps_every_row(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD))
    (tmp_path / "b.jsonl").write_text(LINES)
    found = reviews.discover_source(spark, str(tmp_path))
    assert reviews.read_source(spark, found).count() == len(GOOD) + 8


def test_all_archives_and_subfolders(spark, tmp_path):
    for name in ("a.zip", "b.zip"):
        write_zip(tmp_path / name)
    write_tar(tmp_path / "c.tar", "w")
    found = reviews.discover_source(spark, str(tmp_path))
    assert found.n_found == 3 and reviews.read_source(spark, found).count() == 3 * sum(EXPECTED.values())
    assert reviews.discover_source(spark, str(tmp_path), first_only=True).n_found == 1
    deep = tmp_path / "deep"
    for sub in ("x", "y"):
        (deep / sub).mkdir(parents=True)
        (deep / sub / "s.json").write_text(json.dumps(GOOD))
    found = reviews.discover_source(spark, str(deep))
    assert found.n_found == 2 and reviews.read_source(spark, found).count() == 2 * len(GOOD)


@pytest.mark.parametrize("name,mode", [("x.tar", "w"), ("x.tgz", "w:gz"), ("x.tar.gz", "w:gz"), ("x.tar.bz2", "w:bz2")])
def test_tar(spark, tmp_path, name, mode):
    write_tar(tmp_path / name, mode)
    assert per_member(archives.read_reviews_tar(spark, str(tmp_path))) == EXPECTED


def test_discover(spark, tmp_path):
    folder = tmp_path / "data"
    names = lambda found: [p.rstrip("/").rsplit("/", 1)[1] for p in found.paths]
    (folder / "sub" / "deeper").mkdir(parents=True)
    (folder / "sub" / "s.json").write_text(json.dumps(GOOD))
    (folder / "sub" / "deeper" / "t.json").write_text(json.dumps(GOOD))
    found = reviews.discover_source(spark, str(folder), first_only=True)
    assert (found.kind, names(found), found.n_found) == ("json_files", ["sub"], 1)
    assert reviews.read_source(spark, found).count() == 3
    for n in ("b.txt", "a.jsonl", "c.csv"):
        (folder / n).write_text(LINES)
    found = reviews.discover_source(spark, str(folder), 1)
    assert names(found) == ["a.jsonl"] and found.n_found == 2
    assert reviews.read_source(spark, found).count() == 8
    found = reviews.discover_source(spark, str(folder))
    assert names(found) == ["data"] and reviews.read_source(spark, found).count() == 16
    write_zip(folder / "z.zip")
    found = reviews.discover_source(spark, str(folder))
    assert found.kind == "archive" and reviews.read_source(spark, found).count() == sum(EXPECTED.values())
    (tmp_path / "none").mkdir()
    assert reviews.discover_source(spark, str(tmp_path / "none")).kind is None


def test_tables(spark, tmp_path):
    df = spark.range(5).select(F.col("id"), F.col("id").cast("string").alias("s"))
    df.write.option("header", True).csv(f"{tmp_path}/t.csv")
    assert tables.load_table(spark, str(tmp_path), "t", "id long, s string").count() == 5
    path = tables.write_table(df, f"{tmp_path}/t.parquet")
    assert tables.load_table(spark, str(tmp_path), "t").count() == 5
    tables.write_table(df.limit(1), path, if_present="skip")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):
        tables.write_table(df, path)
    tables.write_table(df.limit(2), path, if_present="overwrite")
    assert spark.read.parquet(path).count() == 2
    assert tables.is_present(spark, path) and not tables.is_present(spark, f"{tmp_path}/nothing")
    for _ in range(3):
        tables.write_table(df, f"{tmp_path}/runs", if_present="new_run")
    assert tables.read_runs(spark, f"{tmp_path}/runs").select("run").distinct().count() == 3


def test_run_metrics(spark, tmp_path):
    for name, hr in (("test_metrics_L1_d64_grc.json", 0.5), ("test_metrics_L2_d128.json", 0.6), ("other.json", 0.1)):
        (tmp_path / name).write_text(json.dumps({"HR@10": hr}, indent=1))
    got = {(r.layers, r.dim, r.tiers): r["HR@10"] for r in tables.load_run_metrics(spark, str(tmp_path)).collect()}
    assert got == {(1, 64, "grc"): 0.5, (2, 128, None): 0.6, (None, None, None): 0.1}


def test_epoch_log(spark, tmp_path):
    for e in (1, 2):
        tables.append_epoch_log(spark.createDataFrame([(e, 0.1 * e)], "epoch long, hr double"), f"{tmp_path}/log")
    assert tables.load_log(spark, f"{tmp_path}/log").count() == 2


def test_scratch_is_the_configured_folder(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_root(spark) == root.rstrip("/") and scratch_path(spark, "x").startswith(root)
