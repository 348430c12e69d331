"""How evenly work is dealt, and what tasks need."""

import subprocess
import sys

import numpy as np

from rankwell.llm import repeats
from rankwell.llm.shared import mix, unmixed


def test_anchors_fill_buckets_evenly():
    """Anchors are smallest hashes; their buckets must not be skewed for it."""
    import duckdb

    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").arrow()
    docs = docs.read_all() if hasattr(docs, "read_all") else docs
    notes = np.concatenate([n for b in docs.combine_chunks().to_batches() for n, _, _ in repeats._noted(b, 100)])
    anchors = np.unique(notes["anchor"])
    share = np.bincount(repeats._buckets(notes[np.unique(notes["anchor"], return_index=True)[1]], 8), minlength=256) / len(anchors)
    assert share.max() < 0.02


def test_suffix_order_and_boundaries():
    """Beside sorting by slices: any order of suffixes that share `depth` bytes will do."""
    rng = np.random.default_rng(2)
    for kinds in (2, 5, 40):
        text = rng.integers(97, 97 + kinds, 700).astype(np.uint8)
        text[100:400] = text[300:600]
        text[-1] = 255
        raw, length = text.tobytes(), 20
        order = repeats.suffix_order(text, length + 1)
        cuts = [raw[i:i + length + 1] for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and cuts == sorted(cuts)
        common = repeats.prefix_boundaries(text, order, length)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1]:], raw[order[k]:]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[k] == (same if same < length else -1)


def test_mixing_can_be_undone():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (unmixed(mix(x)) == x).all()


_PROBE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {folder!r}).getOrCreate())
for name in ("op5_token_files", "op12_token_alignment", "op13_collocations"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Executors are processes of their own, started in another folder without the package on their path."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", _PROBE.format(root=root, folder=str(tmp_path / "shared"))], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "op5_token_files 200" in done.stdout and "op12_token_alignment 200" in done.stdout
