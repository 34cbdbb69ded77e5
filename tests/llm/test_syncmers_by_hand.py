"""Closed syncmers chosen by hand, from the letters of a text on, with hashes of another library."""

import random

import xxhash
from pyspark.sql import functions as F

from peerlens.llm import syncmers

BLANK = " \t\n\x0b\x0c\r"


def hashed(parts):
    """Hashes in a chain, each the seed of the next; texts as UTF-8 and numbers as eight bytes."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def pieces_of(text):
    out, run = [], ""
    for c in text + " ":
        if c in BLANK or len(run) == syncmers.PIECE:
            out += [run] if run else []
            run = ""
        if c not in BLANK:
            run += c
    return out


def by_hand(text):
    """(place, hash) of each k-mer whose least inner s-mer lies at an edge; of all s-mers where there is no such k-mer."""
    p, width = pieces_of(text), syncmers.K - syncmers.S + 1
    s = [hashed(p[i : i + syncmers.S]) for i in range(len(p) - syncmers.S + 1)] if len(p) >= syncmers.S else [hashed([x]) for x in p]
    short = lambda own: (hashed(own) & (1 << 64) - 1) >> 33
    kept = []
    for i in range(len(s) - width + 1):
        inner = s[i : i + width]
        where = [k for k, x in enumerate(inner) if x == min(inner)]
        if 0 in where or width - 1 in where:
            kept.append((i, short(inner)))
    return kept or [(i, short([x])) for i, x in enumerate(s)]


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(6)
    words = ["alpha", "be", "gamma,", "d", "Épsilon", "zeta-eta", "\U0001f600\U0001f600", "漢字漢字漢", "alpha", "x"]
    texts = [rng.choice(["", " ", "\n"]).join([""] + [rng.choice(words) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(rng.randrange(60))]) for _ in range(120)]
    texts += ["", "   ", "one", "one two", "a b c d e", "x " * 500, "same " * 50, "y" * 4001]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", syncmers.anchors(F.col("t")).alias("a"), syncmers.packed(F.col("t")).alias("p")).collect()
    for r in rows:
        want = by_hand(texts[r["i"]])
        assert [(x["place"], x["hash"]) for x in r["a"] or []] == want, texts[r["i"]][:80]
        assert [(x & (1 << 31) - 1, x >> 32) for x in r["p"]] == want
    some = [by_hand(t) for t in texts[:120] if len(pieces_of(t)) > 20]
    share = sum(map(len, some)) / sum(len(pieces_of(t)) for t in texts[:120] if len(pieces_of(t)) > 20)
    assert 0.3 < share < 0.75  # two of four places


def test_a_very_long_text_keeps_its_places(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(1000)}" for _ in range(40_000))
    got = spark.createDataFrame([(text,)], "t string").select(syncmers.packed(F.col("t"))).first()[0]
    assert [(x & (1 << 31) - 1, x >> 32) for x in got] == by_hand(text)
