"""Conversation repair against all edit scripts, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from peerlens.llm import repair
from peerlens.llm.common import running

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def scripts(n):
    """All edit scripts over n turns with up to two insertions at a place."""
    gaps = ["", "I", "II"]
    for own in itertools.product("KRD", repeat=n):
        for ins in itertools.product(gaps, repeat=n + 1):
            if sum(map(len, ins)) <= n + 2:
                yield "".join(i + o for i, o in zip(ins, own, strict=False)) + ins[-1]


def outcome(audit, turns):
    """(cost, repaired) of a script, or None if it isn't allowed: all choices of roles are tried."""
    ways, at = [(0, [])], 0
    for e in audit:
        if e == "I":
            ways = [(c + 2, [*k, (r, "")]) for c, k in ways for r in ("user", "assistant")]
            continue
        role, text, fault = turns[at]
        at += 1
        if e == "D":
            ways = [(c + 3, k) for c, k in ways]
        elif fault in ("blank", "duplicate"):
            return None
        else:
            broken = fault == "truncated"
            ways = [(c + broken + 2 * (e == "R"), [*k, (r, text)]) for c, k in ways for r in ([role] if e == "K" else ["user", "assistant"])]
    good = [(c, k) for c, k in ways if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in k))]
    assert len({repr(x) for x in good}) <= 1
    return good[0] if good else None


def by_hand(rows):
    live = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        made = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        live += [made] * (0 if fate == 0 else 2 if fate == 3 else 1)
    live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns, seen = [], set()
    for _, role, text in live:
        bare = text.strip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        turns.append((role, text, fault))
    known = [t for t, _, _ in live if t is not None]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:], strict=False)]
    best = min((found[0], audit, found[1]) for audit in scripts(len(turns)) if (found := outcome(audit, turns)))
    counts = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
    return [max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], best[2]]


def conversations():
    rng, rows = random.Random(5), []
    texts = ["Yes.", "No!", "broken", "", None, " \t", "why? ", "a.b", "x\ny.", "Yes."]
    for conv in range(36):
        turn = 0
        for _ in range(rng.choice([1, 2, 2, 3, 3])):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(texts)))
    return [*rows, (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, 2, "assistant", "Ho.")]


def test_repair_against_all_scripts(spark, tmp_path):
    rows = conversations()
    clash = ["live", "fault", "seen", "best", "turns", "cost", "audit", "_time"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in clash]).repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    own = {r["conv_id"]: r for r in repair.repair(repair.damage(df)).collect()}
    query = {r["conv_id"]: r for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(own) == set(query) == {r[0] for r in rows}
    for conv, r in own.items():
        want = by_hand([x for x in rows if x[0] == conv])
        got = [r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")]
        assert got == want[:-1], conv
        assert [tuple(t) for t in r["repaired"]] == want[-1], conv
        assert query[conv]["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in want[-1]).encode()).hexdigest()


def test_nothing_and_nothing_live(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damage(none)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.repair(repair.damage(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", [])]


def test_long_conversations_and_long_texts(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(True).alias("live"))
    r = repair.repair(rows).collect()[0]
    assert (r["cost"], r["audit"]) == (0, "K" * 3000) and [t["text"] for t in r["repaired"]] == [f"Turn {i}." for i in range(3000)]
    long = spark.createDataFrame([(1, 1, "user", "word " * 400_000 + "."), (1, 2, "assistant", "end" + "." * 400_000 + "x")], SCHEMA).withColumn("live", F.lit(True))
    r = repair.repair(long).collect()[0]
    assert (r["truncated"], r["cost"], r["audit"]) == (1, 1, "KK")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    xs = [i % 7 for i in range(n)]
    got = spark.createDataFrame([(xs,)], "xs array<long>").select(running(F.col("xs"))).first()[0]
    assert got == [sum(xs[:i]) for i in range(n + 1)]
