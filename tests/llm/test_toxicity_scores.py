"""Scores of op10 from the text on, against dictionaries: llr of models that leave a third out, the curve, and the score."""

import math
import random
import zlib

import numpy as np

from peerlens.llm import letters, toxicity

from .test_corpus import SCHEMA, kneser_ney, prose


def llr_of(text, p, types):
    """The largest sum of log ratios over a window of a text's n-grams, worked out gram by gram."""
    table, symbols = letters.letter_table(1 << toxicity.BITS), [0] * (toxicity.ORDER - 1)
    for c in text + "\n":
        s = int(table[ord(c)])
        if s or symbols[-1]:
            symbols.append(s)
    grams = [tuple(symbols[i - toxicity.ORDER + 1 : i + 1]) for i in range(toxicity.ORDER - 1, len(symbols))]
    known = {g[:-1] for g in types}
    values, w = [math.log(p(g, 1) / p(g, 0)) if g[:-1] in known else 0.0 for g in grams], toxicity.WINDOW
    return max(sum(values[i : i + w]) for i in range(max(len(values) - w, 0) + 1)) / w


def test_scores_against_brute_force(spark):
    rng = random.Random(4)
    texts = {i: prose(i, rng.randrange(3, 12)) + (" you zorkfug" * rng.randrange(1, 4) if i % 3 == 0 else "") for i in range(36)} | {40: "", 41: "12 !", 42: "idiot", 43: "zorkfug"}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    labels = {i: int(i % 3 == 0) for i in texts}
    learnt = [i for i in texts if fold(i) != 2]
    pairs, cross = [], {}
    for h in toxicity.FOLDS:
        p, types = kneser_ney([(texts[i], labels[i]) for i in learnt if fold(i) != h])
        cross |= {i: llr_of(texts[i], p, types) for i in learnt if fold(i) == h}
    pairs = [(math.floor(cross[i] / toxicity.STEP) * toxicity.STEP, labels[i]) for i in learnt]
    assert len({x for x, _ in pairs}) > 20
    x, y = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs], float)
    w = np.zeros(2)  # the curve by plain gradient ascent, where the module takes Newton's steps
    X = np.stack([x * 10, np.ones_like(x)], 1)
    for _ in range(400_000):
        w += 0.02 * (X.T @ (y - 1 / (1 + np.exp(-X @ w))) - 1e-3 * w)
    p, types = kneser_ney([(texts[i], labels[i]) for i in learnt])
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], SCHEMA).repartition(3)
    known = spark.createDataFrame([(i, 1, v) for i, v in labels.items()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, known).collect()}
    for i, t in texts.items():
        want = 1 / (1 + math.exp(-(llr_of(t, p, types) * w[0] * 10 + w[1])))
        assert abs(got[i]["score"] - want) < 1e-3, (i, got[i]["score"], want)
        assert got[i]["held_out"] == (fold(i) == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    strong = sorted((llr_of(texts[i], p, types), got[i]["score"]) for i in (42, 43))
    assert strong[0][1] != strong[1][1]  # no clip: short texts over any bound don't tie


def test_ties_and_long_texts(spark):
    rows = [(i, prose(i, 30) + (" zorkfug" if i % 3 == 0 else ""), "en", "a", 0) for i in range(60)]
    rows += [(100, prose(9, 30_000), "en", "a", 0), (101, "zorkfug " * 60_000, "en", "a", 0), (102, rows[0][1], "en", "a", 0), (102, rows[0][1], "en", "a", 0)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {}
    for r in toxicity.score_documents(spark.createDataFrame(rows, SCHEMA), labels).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert len(got[102]) == 2 and len({*got[102], *got[0]}) == 1 and got[101][0] > got[100][0] and all(0 <= s <= 1 for v in got.values() for s in v)
