"""The Merkle manifest against trees built by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from peerlens.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(the last node, for each leaf the list of (before, after))."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for leaf, i in enumerate(at):
            run = runs[i // 3]
            steps[leaf].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[leaf] = i // 3
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], steps


def by_hand(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, own = {}, {}
    for s in sources:
        own[s] = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[s] = tree([leaf_of(r, r[1]) for r in own[s]])
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for r, steps in zip(own[s], trees[s][1], strict=True):
            path = steps + above[k]
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf_of(r, text)
            for before, after in path:
                h = sha(before + h + after)
            out.append((r[0], leaf_of(r, r[1]), trees[s][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def rows_of(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "no break", "é\n\n漢", "-", "1:a"])
            rows.append((rng.choice([rng.randrange(10_000), rng.randrange(10_000), 7, None]), text, rng.choice(["en", None, ""]), s, rng.choice([3, None])))
    return rows


def run(spark, rows, path):
    clash = ["node", "own", "at", "part", "g", "idx", "n", "path", "leaf"]
    spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in clash]).repartition(3).write.parquet(f"{path}/documents.parquet")
    got = manifest.op12_merkle_manifest(spark, str(path)).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3}, {None: 1, "a": 10, "b": 28, "": 2, "é": 1, "z": 4}, {"a": 300, **{f"s{i}": 1 for i in range(10)}}], ids=["lone", "one run", "uneven", "hot"])
def test_manifest_against_trees_by_hand(spark, tmp_path, sizes):
    rows = rows_of(sizes)
    got = run(spark, rows, tmp_path)
    assert got == sorted(by_hand(rows), key=repr)
    if sum(sizes.values()) > 40:
        assert {r[-1] for r in got} == {True, False}


def test_nothing(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("s").alias("s"))
    assert all(r["x"] == r["at"] for r in manifest.numbered(rows, "s", "x").collect())


def test_long_text(spark, tmp_path):
    rows = [(1, "word\n" * 500_000, "en", "a", 1), (2, "x", "en", "a", 1)]
    assert run(spark, rows, tmp_path) == sorted(by_hand(rows), key=repr)
