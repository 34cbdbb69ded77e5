"""Rows that share an id, as one document, against brute force; and near duplicates on several executors."""

import json
import os
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from peerlens.llm import linededup, neardup

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def by_hand(rows):
    """{doc_id: the smallest id it reaches}, where rows of one id are one document with the links of all its texts."""

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    low = {d: d for d, _ in sets}
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def family(rng, n):
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            words[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(words))
    return out


def test_one_id_with_several_texts(spark):
    rows = [(3, "A"), (5, "A"), (5, "B"), (9, "B"), (11, "C"), (11, None), (11, ""), (12, "C"), (20, None), (20, "D"), (30, ""), (None, "A"), (None, "B")]
    texts = {k: t[0] for k, t in zip("ABCD", (family(random.Random(i), 1) for i in range(4)), strict=True)}
    rows = [(d, texts.get(t, t)) for d, t in rows]
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {3: 3, 5: 3, 9: 3, 11: 11, 12: 11, 20: 20, 30: 30, None: None}
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"]) for r in got)


def test_shared_ids_against_brute_force(spark):
    rng = random.Random(8)
    texts = [t for _ in range(12) for t in family(rng, rng.randrange(1, 6))]
    rows = [(rng.randrange(25), t) for t in texts for _ in range(rng.choice([1, 1, 2]))] + [(i, None) for i in range(0, 30, 3)]
    want = by_hand(rows)
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and all(r["component_id"] == want[r["doc_id"]] for r in got)


def test_repeated_rows_lose_lines_once(spark):
    line = "A line that stands in many of the documents."
    rows = [(1, f"{line}\nown\n{line}")] * 300 + [(2, line), (3, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lost = linededup.dropped_lines(docs).collect()
    assert sorted((r["doc_id"], len(r["drops"])) for r in lost) == [(1, 1), (2, 1)]
    assert linededup.keep_bitmaps(docs).where("doc_id = 1 AND n_dropped = 2").count() == 300


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_three_executors_give_one_result(spark, tmp_path):
    """Rows dealt in another order each time, to three executors: the same components each time, and those of brute force."""
    script = textwrap.dedent("""
        import json, sys
        from pyspark.sql import SparkSession, functions as F
        from peerlens.llm import neardup
        out = sys.argv[1]
        spark = SparkSession.builder.master("local-cluster[3,1,1024]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g").config("spark.checkpoint.dir", f"{out}/shared").config("spark.sql.warehouse.dir", f"{out}/warehouse").getOrCreate()
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
        found = []
        for turn in range(3):
            dealt = docs.repartition(6, F.xxhash64("doc_id", F.lit(turn)))
            found.append(sorted([r["doc_id"], r["component_id"]] for r in neardup.link(dealt).collect()))
        json.dump(found, open(f"{out}/found.json", "w"))
        spark.stop()
    """)
    (tmp_path / "run.py").write_text(script)
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text")).collect()]
    want = sorted([d, c] for d, c in by_hand(rows).items())
    assert json.loads((tmp_path / "found.json").read_text()) == [want] * 3
