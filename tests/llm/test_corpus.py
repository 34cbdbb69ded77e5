"""Corpus operators on awkward rows, against brute force and round trips."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.llm import components, langid, letters, linededup, mixing, neardup, packing, syncmers, tokens, toxicity, warc, webp, webpbatch, webpstore

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "A line that many documents have in common."
WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "er"]) for _ in range(n))


def awkward():
    base = prose(1, 80)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (4, "ünï çødé 漢字 \U0001f600", "xx", None, 5), (None, base, "en", "a", 9), (5, base, "en", "a", 9), (6, base, "en", "a", 9), (6, base, "en", "a", 9)]
    rows += [(7, base.replace("the", "thy", 1), "en", "b", 9), (8, prose(2, 30_000), "en", "b", 9), (9, "one two three", "en", "b", 9), (10, "One  TWO\nthree", "en", "b", 9)]
    rows += [(20 + i, f"{prose(30 + i, 12)}\n  {LINE.upper() if i % 2 else LINE} \n{'x' * 19}\n{LINE}", "en", "a", 9) for i in range(5)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["_score", "_drops", "_key", "_n", "k", "h", "node", "copy", "item", "s", "n", "family"]
    return spark.createDataFrame(awkward(), SCHEMA).select("*", *[F.lit(1).alias(c) for c in clash]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_letter_codes_by_hand():
    codes, n = letters.ngram_codes(["Ab!", "", "12"], 6, 3)
    assert n.tolist() == [3, 0, 0]
    assert codes.tolist() == [1, 1 << 6 | 2, 1 << 12 | 2 << 6]


def test_language_id(spark, docs, empty):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.identify(empty).count() == 0
    rows = [(i, prose(i, 40) if i % 2 else "zwölf über schön " + " ".join(random.Random(i).choices(["der", "schiff", "und", "kraft", "zug", "über"], k=30)), "en" if i % 2 else "de", "a", 0) for i in range(120)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA)).where("held_out").collect()
    assert len(got) > 10 and all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in got)


def test_language_id_against_brute_force(spark):
    texts = [("the old mill by the water", "en"), ("der alte Baum am See", "de"), ("zwölf über schön", "de"), ("a thin wire", "en"), (None, "en"), ("12 !", "de"), ("und", None), ("the sea, the wind", "en")]
    rows = spark.createDataFrame([(i, t, lang, "a", 0) for i, (t, lang) in enumerate(texts)], SCHEMA)
    vectors, table = langid.letter_vectors().astype(np.int64), letters.letter_table(1 << langid.BITS)

    def bundle(text):
        out, seen = np.zeros(langid.DIMS), [0, 0]
        for c in (text or "") + "\n":
            x = int(table[ord(c)])
            if x or seen[-1]:
                seen.append(x)
        for a, b, c in zip(seen, seen[1:], seen[2:], strict=False):
            out += [vectors[a][(i - 2) % langid.DIMS] * vectors[b][(i - 1) % langid.DIMS] * vectors[c][i] for i in range(langid.DIMS)]
        return out

    sums = {}
    for i, (t, lang) in enumerate(texts):
        if lang and t and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + bundle(t)
    unit = {x: v / np.linalg.norm(v) for x, v in sums.items()}
    centred = {x: v - 0.5 * sum(unit.values()) / len(unit) for x, v in unit.items()}
    for r in langid.identify(rows).collect():
        text = texts[r["doc_id"]][0]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = bundle(text)
        cosines = {x: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for x, p in centred.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r["lang_pred"] == best and abs(r["score"] - max(0, cosines[best])) < 1e-5


def test_held_out_is_crc32(spark, docs):
    from peerlens.llm.common import held_out

    for r in docs.select("doc_id", held_out().alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxicity(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(empty, none).count() == 0
    assert {round(r["score"], 6) for r in toxicity.score_documents(docs, none).collect()} == {0.5}
    rows = [(i, prose(i, 60) + (" you zorkfug quib" * 3 if i % 3 == 0 else ""), "en", "a", 0) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(spark.createDataFrame(rows, SCHEMA), labels).where("held_out").collect()
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in got) >= 0.97 * len(got)
    kept = toxicity.drop_toxic(spark.createDataFrame(rows, SCHEMA), labels)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and 240 < kept.count() < 290
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def kneser_ney(texts):
    """P(symbol | context) of order ORDER by class, from dictionaries of n-grams as tuples; ``texts`` are (text, toxic)."""
    order, d, size = toxicity.ORDER, toxicity.DISCOUNT, 1 << toxicity.BITS
    table, top = letters.letter_table(size), [{}, {}]
    for text, y in texts:
        symbols = [0] * (order - 1)
        for c in text + "\n":
            s = int(table[ord(c)])
            if s or symbols[-1]:
                symbols.append(s)
        for i in range(order - 1, len(symbols)):
            g = tuple(symbols[i - order + 1 : i + 1])
            top[y][g] = top[y].get(g, 0) + 1
    types = {order: set(top[0]) | set(top[1])}
    for k in range(order - 1, 0, -1):
        types[k] = {g[1:] for g in types[k + 1]}

    def below(g):
        if not g:
            return 1 / size
        before = [h for h in types[len(g) + 1] if h[1:-1] == g[:-1]]
        if not before:
            return below(g[1:])
        own, kinds = sum(h[1:] == g for h in before), len({h[-1] for h in before})
        return (max(own - d, 0) + d * kinds * below(g[1:])) / len(before)

    def p(g, y):
        own = {h: n for h, n in top[y].items() if h[:-1] == g[:-1]}
        total = sum(own.values())
        return (max(own.get(g, 0) - d, 0) + d * len(own) * below(g[1:])) / total if total else below(g[1:])

    return p, types[order]


def test_kneser_ney_against_brute_force(spark):
    texts = [(prose(3, 40), 0), (prose(4, 25) + " zorkfug", 1), ("zwölf über 漢字", 1), ("", 0), (prose(5, 30), 0)]
    p, seen = kneser_ney(texts)
    rng = random.Random(1)
    for g in rng.sample(sorted(seen), 4) + [(1, 2, 500, 7)]:
        for y in (0, 1):
            assert abs(sum(p((*g[:-1], s), y) for s in range(1 << toxicity.BITS)) - 1) < 1e-9
    rows = spark.createDataFrame([(t, y, 0) for t, y in texts], "text string, toxic int, fold int")
    model = {r["code"]: r["value"] for r in toxicity.ratios(toxicity.count_ngrams(rows)).where(F.col("model") == toxicity.ALL).collect()}
    code = lambda g: sum(s << toxicity.BITS * i for i, s in enumerate(reversed(g)))
    contexts = {g[:-1] for g in seen}
    assert set(model) == {code(g) for g in seen} | {-1 - code(c) for c in contexts}
    for g in rng.sample(sorted(seen), 60):
        assert abs(model[code(g)] - np.log(p(g, 1) / p(g, 0))) < 1e-9
        new = next((*g[:-1], s) for s in range(511, 0, -1) if (*g[:-1], s) not in seen)
        assert abs(model[-1 - code(g[:-1])] - np.log(p(new, 1) / p(new, 0))) < 1e-9


def test_dense_and_sparse_ngrams_alike():
    few = letters.ngram_codes([prose(i, 400) for i in range(300)], toxicity.BITS, toxicity.ORDER)[0]
    many = letters.ngram_codes(["".join(map(chr, range(0x4E00, 0x5000))), prose(1, 50)], toxicity.BITS, toxicity.ORDER)[0]
    for codes in (few, many, few[:0]):
        got, want = letters.counted(codes, toxicity.BITS, toxicity.ORDER), np.unique(codes, return_counts=True)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    kinds = np.unique(few)[::3]
    model = np.unique(np.concatenate([kinds, -1 - (kinds >> toxicity.BITS)]))
    values = toxicity.Values(model, np.random.default_rng(3).normal(size=len(model)).astype(np.float32))
    assert values.dense.fits
    asked = np.concatenate([few[:5000], many])
    quick = values(asked)
    values.dense.fits = False
    assert np.array_equal(quick, values(asked).astype(np.float32)) and len(set(quick.tolist())) > 50


def test_toxicity_sent_or_joined_alike(spark, docs):
    rows = spark.createDataFrame([(prose(i, 30) + " quibzork" * (i % 2), i % 2, (0, 1, 3)[i % 3]) for i in range(12)], "text string, toxic int, fold int")
    model = toxicity.materialise(toxicity.ratios(toxicity.count_ngrams(rows)), "ratios")
    asked = docs.select("doc_id", "text", F.lit(toxicity.ALL).alias("model"))
    both = [sorted((r["doc_id"] or 0, r["text"] or "", round(r["llr"], 5)) for r in toxicity.with_llr(asked, model, "llr", most).collect()) for most in (1 << 22, 0)]
    assert both[0] == both[1] and len({x for _, _, x in both[0]}) > 3


def brute_lines(rows):
    keys = {}
    for d, t, *_ in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                k = line.strip(" \t\n\x0b\x0c\r")
                k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
                if len(k) >= 20:
                    keys.setdefault(k, set()).add(d)
    out = []
    for d, t, *_ in rows:
        kept, lines = [], (t or "").split("\n")
        for line in lines:
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if d is None or len(keys.get(k, ())) < 3 or d == max(keys[k]):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(docs, empty):
    got = linededup.keep_bitmaps(docs)
    assert sorted([tuple(r[:4]) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()], key=repr) == brute_lines(awkward())
    for r in got.collect():
        keep = linededup.mask_of_runs(r["keep_bitmap"])
        assert (len(keep), int((~keep).sum())) == (r["n_lines"], r["n_dropped"])
    assert {r["doc_id"]: r["keep_bitmap"] for r in got.where("doc_id IN (20, 24)").collect()} == {20: "1,1,1,1", 24: "4"}
    assert linededup.keep_runs(np.array([False, False, True])) == "0,2,1"
    cut = linededup.apply(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("doc_id = 1").first()["text"] is None and LINE not in cut.where("doc_id = 20").first()["text"]
    assert linededup.keep_bitmaps(empty).count() == 0


def test_line_stream_over_partition_edges():
    import pandas as pd

    rng = random.Random(4)
    for many in (30, 4):
        rows = sorted({(rng.choice([1, 2, 2, 2, 3, 4]), 0, -rng.randrange(many), rng.randrange(4)) for _ in range(90)})
        df = pd.DataFrame([(h, g, -d, r, b"") for h, g, d, r in rows], columns=["h1", "h2", "doc_id", "row", "places"])
        docs_of = df.groupby("h1")["doc_id"].agg(set)
        want = {(h, d) for h, own in docs_of.items() if len(own) >= 3 for d in own if d != max(own)}
        for cuts in ([], [10], [5, 6, 30], list(range(1, len(df)))):
            parts = [df[a:b] for a, b in zip([0, *cuts], [*cuts, len(df)], strict=True)]
            for step in (1, 4, 1000):
                out = pd.concat([x for p in parts for x in linededup.decide(iter([p[i : i + step] for i in range(0, len(p), step)]))])
                edges = {}
                for r in sorted(out[out["kind"] == "edge"].itertuples(), key=lambda r: (-r.doc_id, -r.row)):
                    n, last, top = edges.get(r.h1, (0, None, r.doc_id))
                    edges[r.h1] = n + r.n - (last == r.doc_id), r.row, top
                late = {(r.h1, r.doc_id) for r in out[out["kind"] == "open"].itertuples() if edges[r.h1][0] >= 3 and r.doc_id != edges[r.h1][2]}
                assert late | {(r.h1, r.doc_id) for r in out[out["kind"] == "drop"].itertuples()} == want


def test_repeated_documents_count_once_over_edges(spark):
    """Rows of one document on both sides of a partition's edge are one document: two documents don't drop a line."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(7, f"{LINE}\n{i}") for i in range(40)] + [(5, LINE)]
        assert linededup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0] == 0
        got = linededup.keep_bitmaps(spark.createDataFrame([*rows, (6, LINE)], "doc_id long, text string")).where("n_dropped > 0").collect()
        assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(5, 1), (6, 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_near_duplicates(spark, docs, empty):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.link(docs).collect()}
    by = {d: v for (d, _), v in got.items()}
    assert by[1] == (1, True) and by[2] == (2, True) and by[None] == (None, True)
    assert by[5] == by[5] == (5, True) and by[6] == (5, False) and by[7] == (5, False)
    assert by[9] == (9, True) and by[10] == (9, False)
    assert neardup.drop_copies(docs).columns == docs.columns
    assert neardup.link(empty).count() == 0


def test_pruning_and_exact_verification():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**60, 200, np.uint64))]
    for share in (0.0, 0.05, 0.14, 0.15, 0.3, 0.9):
        x = sets[0].copy()
        x[: int(share * len(x))] = rng.integers(0, 2**60, int(share * len(x)), np.uint64)
        sets.append(np.unique(x))
    sizes = [(len(np.intersect1d(a, b)), len(np.union1d(a, b))) for a in sets for b in sets]
    want = {(i // len(sets), i % len(sets)) for i, (c, u) in enumerate(sizes) if 100 * c >= 75 * u}
    assert set(zip(*(x.tolist() for x in neardup.linked(sets, sets)), strict=True)) == want
    sigs = np.stack([neardup.signature(s) for s in sets])
    assert want <= set(zip(*(x.tolist() for x in neardup.survivors(sigs, sigs)), strict=True))


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 1)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: find(x) for x in up}


def test_mixing(spark, docs, empty):
    big = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'cold' END AS source")
    out = mixing.mix(big, {"hot": 3.0, None: 1.0, "cold": 0.0}, 8000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert "cold" not in n and abs(n["hot"] - 6000) < 400 and abs(n[None] - 2000) < 250
    assert out.count() == mixing.mix(big.repartition(7), {"hot": 3.0, None: 1.0, "cold": 0.0}, 8000).count()
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(docs)
    assert got.columns == [c for c in docs.columns if c != "copy"] + ["copy", "shuffle_key"] and {r["_n"] for r in got.collect()} <= {1}
    us = [0.01, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    for mean in (0.1, 1.5, 15.0):
        want, p, below, k = [], np.exp(-mean), np.exp(-mean), 0
        for u in us:
            while below < u:
                k += 1
                p *= mean / k
                below += p
            want.append(k)
        assert [r[0] for r in df.select(mixing.poisson_quantile(F.lit(mean), F.col("u"))).collect()] == want


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabularies here")
def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole, encoder, rng = Tokenizer.from_file(tokens.vocabulary_path()), tokens.WordEncoder(), random.Random(5)
    letters_ = ["a", "B", "don", "the", "\u0130", "I", "\u0131", "\u00e9", "e\u0301", "\u0301", "\u0307", "\u03a3", "\u03c3", "\u01c5", "\ufb01", "\u1e9e", "\u6f22", "\u0e01\u0e33", "\U0001f600", "7", "\u00b2"]
    others = [*tokens.MARKS, "'s", "'", "n't", "<|endoftext|>", "<|", "|>", "\u00a0", "\u3000", "\x85", "\x1c", "\u200d", "\u00ad"]
    texts = ["b\u0130##", "xY\u0130-", ""]
    for _ in range(20_000):
        texts.append("".join(rng.choice(rng.choice([letters_, letters_, others, [" ", "\n", "\t"]])) for _ in range(rng.randint(1, 12))))
    ids, n = encoder.encode(texts)
    stops = np.cumsum(n)
    wrong = [t for t, b, m in zip(texts, stops.tolist(), n.tolist()) if ids[b - m : b].tolist() != whole.encode(t, add_special_tokens=False).ids]
    assert not wrong, wrong[:5]
    assert encoder.lengths(texts).tolist() == n.tolist()


def test_packing_and_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    lengths = [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in awkward()]
    got = packing.pack(docs).collect()
    assert sum(r["length"] for r in got) == sum(lengths) + len(lengths)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    assert len(bins) <= -(-sum(r["length"] for r in got) // packing.LENGTH) + 1
    want = []
    for d, text, *_ in awkward():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((d, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    items = [r["item"] for r in packing.pieces(docs).collect()]
    assert len(set(items)) == len(items) == len(got)
    assert packing.pack(empty).count() == 0
    hist = tokens.length_histogram(tokens.token_lengths(docs.select("text"))).collect()
    for r in hist:
        L = r["n_tokens"]
        assert r["truncated_tokens"] == sum(min(L, n) for n in lengths) and r["docs_longer"] == sum(n > L for n in lengths) and r["total_tokens"] == sum(lengths)
    assert tokens.length_histogram(tokens.token_lengths(empty.select("text"))).count() == 0
    held = tokens.length_histogram(tokens.token_lengths(docs.select("text")))
    asked = [0, 1, 50, 99, 10**6]
    assert {r["limit"]: (r["docs_longer"], r["truncated_tokens"]) for r in tokens.at_limits(held, asked).collect()} == {x: (sum(n > x for n in lengths), sum(min(x, n) for n in lengths)) for x in asked}
    shares = [0.1, 0.5, 0.9, 1.0]
    want = {q: next(n for n in sorted(lengths) if sum(m <= n for m in lengths) >= q * len(lengths)) for q in shares}
    assert {r["share"]: r["n_tokens"] for r in tokens.quantiles(held, shares).collect()} == want


def test_genetic_packing_is_valid_and_no_worse():
    rng = np.random.default_rng(3)
    sizes = rng.integers(300, 1200, 300)
    first = packing.Packing(sizes, 2048).fit()
    bins = packing.evolve(sizes, 2048, 1, [])
    assert np.bincount(bins, sizes).max() <= 2048 and bins.min() == 0 and bins.max() + 1 <= len(first.loads)
    child = packing.crossover(first, packing.Packing(sizes, 2048).fit(np.arange(300)), rng)
    assert (child.bins >= 0).all() and np.bincount(child.bins, sizes).max() <= 2048


def test_genetic_packing_betters_best_fit():
    rng = np.random.default_rng(0)
    sizes = []
    for _ in range(150):  # triplets that fill a bin
        a = int(rng.integers(780, 1000))
        b = int(rng.integers((2048 - a) // 2 - 150, (2048 - a) // 2 + 150))
        sizes += [a, b, 2048 - a - b]
    sizes = np.array(sizes)
    best_fit = len(packing.Packing(sizes, 2048).fit().loads)
    first = [packing.evolve(sizes, 2048, k, [], k) for k in (0, 1)]
    second = packing.evolve(sizes, 2048, 5, first, 0)
    assert np.bincount(second, sizes).max() <= 2048 and packing.least_bins(sizes, 2048) == 150
    assert second.max() + 1 <= min(x.max() + 1 for x in first) and second.max() + 1 <= 152 < best_fit


def test_least_bins_is_a_bound():
    import itertools

    rng = random.Random(2)

    def fewest(sizes, length):
        best = len(sizes)
        for order in itertools.permutations(sizes):  # first fit over every order finds the fewest
            loads = []
            for x in order:
                k = next((k for k, load in enumerate(loads) if load + x <= length), None)
                if k is None:
                    loads.append(x)
                else:
                    loads[k] += x
            best = min(best, len(loads))
        return best

    for _ in range(40):
        sizes = [rng.randint(1, 10) for _ in range(rng.randint(1, 6))]
        assert packing.least_bins(np.array(sizes), 10) <= fewest(sizes, 10)
    assert packing.least_bins(np.array([6, 6, 6, 5, 5]), 10) == 4 and packing.least_bins(np.array([], np.int64), 10) == 0


def test_syncmers_are_context_free_and_followers_wrap(spark, docs, empty):
    got = syncmers.fingerprint(docs)
    ordered = sorted({(r[0], r[1] or "") for r in awkward() if r[0] is not None}, reverse=True) + [(None, awkward()[4][1])]
    text = dict(ordered)
    assert got.count() == len(awkward())
    follow = {a[0]: b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    for r in got.collect():
        t = text[r["doc_id"]]
        w = len(t) // 3
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - w] + follow[r["doc_id"]][:w]).encode()).hexdigest()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[5]["fingerprint"] == by[6]["fingerprint"] and by[6]["near_next"] == 1.0 and by[2]["fingerprint"] == ""
    assert syncmers.fingerprint(empty).count() == 0
    p = prose(9, 60)
    df = spark.createDataFrame([(p,), ("quite other words " + p + " and more",)], "t string")
    a, b = (({x["hash"] for x in r[0]}) for r in df.select(syncmers.anchors(F.col("t"))).collect())
    assert len(a) > 20 and a <= b


def test_fingerprints_hold_all_anchors_and_places(spark):
    passage = prose(70, 50)
    texts = {2: f"{prose(71, 3000)} {passage} {prose(72, 900)}".replace("the", "tho"), 1: f"{prose(73, 4000).replace('e', 'u')} {passage} and".replace("the", "tho"), 0: "one of one of one of one of one of one of one of one of"}
    rows = [(d, t, "en", "a", 0) for d, t in texts.items()]
    got = {r["doc_id"]: r for r in syncmers.fingerprint(spark.createDataFrame(rows, SCHEMA)).collect()}
    df = spark.createDataFrame(list(texts.items()), "d long, t string")
    all_of = {r[0]: [(x["hash"], x["place"]) for x in r[1]] for r in df.select("d", syncmers.anchors(F.col("t"))).collect()}
    for d, own in all_of.items():
        f = got[d]["fingerprint"]
        assert [(int(f[i : i + 8], 16), int(f[i + 8 : i + 16], 16)) for i in range(0, len(f), 16)] == own
        assert got[d]["sketch"] == "".join(f"{h:08X}" for h in sorted({h for h, _ in own})[: syncmers.SIZE])
        a, b = ({} for _ in range(2))
        for to, of in ((a, own), (b, all_of[(d - 1) % 3])):
            for h, place in of:
                to.setdefault(h, place)
        common = a.keys() & b.keys()
        assert got[d]["near_next"] == len(common) / len(a.keys() | b.keys())
        stretches = {}
        for h in common:
            stretches.setdefault(b[h] - a[h], []).append(a[h])
        assert got[d]["passages_next"] == " ".join(f"{min(p)}-{max(p)}{s:+d}" for s, p in sorted(stretches.items()))
    assert got[2]["near_next"] > 0 and got[2]["passages_next"]


def test_short_texts_without_syncmers_have_anchors(spark):
    rows = [(1, "Ingea therre he.", "en", "a", 0), (2, "Thtiedly erly anwhan.", "en", "a", 0), (3, "Hahere ananing re.", "en", "a", 0), (4, "", "en", "a", 0)]
    rows += [(10 + i, " ".join(random.Random(i).choices(WORDS, k=5 + i % 2)), "en", "a", 0) for i in range(40)]
    got = {r["doc_id"]: r for r in syncmers.fingerprint(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {d for d, r in got.items() if r["fingerprint"] == ""} == {4}
    assert got[3]["near_next"] == got[2]["near_next"] == 0.0


def test_warc(spark):
    html = '<html lang="en"><head><title>A &amp; B</title></head><body><script>x</script><p>One &lt;two&gt;</p><a href="/q?a=1&amp;b=2">l</a><br>three</body></html>'
    pages = spark.createDataFrame([(1, "http://e.org/", html), (2, None, None)], "page_id long, url string, html string")
    got = {(r["page_id"], r["warc_type"]): r for r in warc.derive(warc.responses(pages)).collect()}
    c, m = got[1, "conversion"], got[1, "metadata"]
    assert c["block"] == "One <two>\nl\nthree" and "title: A & B\r\n" in m["block"] and "outlink: /q?a=1&b=2" in m["block"]
    assert c["refers_to"] == m["refers_to"] and c["record_id"] != m["record_id"]
    assert c["source_digest"] == "sha1:" + hashlib.sha1(html.encode()).hexdigest() and c["block_digest"] == "sha1:" + hashlib.sha1(c["block"].encode()).hexdigest()
    assert got[2, "conversion"]["content_length"] == 0
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
    dated = warc.derive(warc.responses(spark.createDataFrame([(1, "http://a/\r\nEvil: 1", "<p>x</p>")], "page_id int, url string, html string"), F.lit("2024-05-06T07:08:09Z")), F.lit("2025-01-02T03:04:05Z"))
    for r in dated.join(warc.record(dated), "record_id").collect():
        head, block = r["record"].split("\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        assert fields["WARC-Date"] == "2025-01-02T03:04:05Z" and fields["WARC-Refers-To-Date"] == "2024-05-06T07:08:09Z" and "Evil" not in fields
        assert block == r["block"] + "\r\n\r\n" and int(fields["Content-Length"]) == len(r["block"].encode())


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, v, k):
        self.value |= v << self.n
        self.n += k


def coded(w, image, width, main=False, cache=0, block=None, far=None):
    """An entropy-coded image of simple and of coded prefix codes: greens 0 to 255 in 9 bits, with lengths, references and cache."""
    w.put(int(cache > 0), 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(0, 1)
    size = 256 + 24 + (1 << cache if cache else 0)
    lengths = {s: 9 for s in range(size)}
    for i in range(512 - size):
        lengths[i] = 8
    for n, table in ((size, lengths), (256, None), (256, None), (256, None)):
        own = table or {s: 8 for s in range(n)}
        w.put(0, 1), w.put(13 - 4, 4)
        for s in webp.LENGTH_ORDER[:13]:
            w.put({8: 1, 9: 1}.get(s, 0), 3)
        w.put(0, 1)
        for s in range(n):
            w.put(int(own[s] == 9), 1)
    w.put(1, 1), w.put(1, 1), w.put(0, 1), w.put(0, 1), w.put(1, 8)  # distance symbols 0 and 1
    codes, code, before = {}, 0, 0
    for k, s in sorted((v, s) for s, v in lengths.items()):
        code <<= k - before
        codes[s], before = (code, k), k
        code += 1

    def sym(v, k):
        w.put(int(format(v, f"0{k}b")[::-1], 2), k)

    kept, i = {}, 0
    while i < len(image):
        run = 0
        while i >= width and i + run < len(image) and image[i + run] == image[i + run - width] and run < 4:
            run += 1
        a, r, g, b = ((image[i] >> s) & 255 for s in (24, 16, 8, 0))
        slot = (image[i] * webp.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache) if cache else None
        if run >= 2:
            sym(*codes[256 + run - 1]), w.put(0, 1)  # distance code 1: the pixel above
            done = run
        elif cache and kept.get(slot) == image[i]:
            sym(*codes[280 + slot])
            done = 1
        else:
            sym(*codes[g]), sym(r, 8), sym(b, 8), sym(a, 8)
            done = 1
        for x in image[i : i + done]:
            if cache:
                kept[(x * webp.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache)] = x
        i += done


def wrapped(w, width, height):
    body = b"\x2f" + (width - 1 | (height - 1) << 14 | w.value << 32).to_bytes((w.n + 32 + 7) // 8 + 1, "little")
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def picture(width, height, seed, kinds=None):
    rng = random.Random(seed)
    pool = [rng.getrandbits(32) for _ in range(kinds or 9)]
    return [rng.choice(pool) if kinds or rng.random() < 0.6 else rng.getrandbits(32) for _ in range(width * height)]


def samples(image, width, height):
    return webp.channels(np.array(image))[:, [1, 2, 3, 0]].astype(np.uint8).reshape(height, width, 4)


def test_webp_prefix_codes_references_and_cache():
    for cache in (0, 4):
        image = picture(11, 9, cache)
        image[33:44] = image[22:33]
        w = Writer()
        w.put(0, 1)
        coded(w, image, 11, True, cache)
        assert (webp.decode(wrapped(w, 11, 9)) == samples(image, 11, 9)).all()


def test_webp_transforms():
    width, height, block = 9, 6, 2
    rest, sub = picture(width, height, 5), [(m << 8) for m in (1, 11, 12, 13, 5, 10)]
    w = Writer()
    w.put(1, 1), w.put(2, 2)  # subtract green
    w.put(1, 1), w.put(0, 2), w.put(block - 2, 3)
    coded(w, sub, 3)
    factors = [0xFF102030, 0xFFE0F011, 0xFF000000, 0xFF7F8001, 0xFF223344, 0xFF010203]
    w.put(1, 1), w.put(1, 2), w.put(block - 2, 3)
    coded(w, factors, 3)
    w.put(0, 1)
    coded(w, rest, width, True)
    got = webp.decode(wrapped(w, width, height))

    def c(p):
        return [(p >> s) & 255 for s in (24, 16, 8, 0)]

    s8 = lambda v: v - 256 if v > 127 else v
    out = []
    for i, p in enumerate(rest):
        a, r, g, b = c(p)
        f = factors[(i // width >> block) * 3 + (i % width >> block)]
        r = (r + (s8(f & 255) * s8(g) >> 5)) & 255
        b = (b + (s8(f >> 8 & 255) * s8(g) >> 5) + (s8(f >> 16 & 255) * s8(r) >> 5)) & 255
        out.append([a, r, g, b])
    for i in range(len(out)):
        y, x = divmod(i, width)
        if i == 0:
            p = [255, 0, 0, 0]
        elif y == 0:
            p = out[i - 1]
        elif x == 0:
            p = out[i - width]
        else:
            L, T, TL, TR = out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1]
            mode = sub[(y >> block) * 3 + (x >> block)] >> 8
            avg = lambda u, v: [(m + n) // 2 for m, n in zip(u, v, strict=True)]
            cl = lambda v: max(0, min(255, v))
            if mode == 1:
                p = L
            elif mode == 5:
                p = avg(avg(L, TR), T)
            elif mode == 10:
                p = avg(avg(L, TL), avg(T, TR))
            elif mode == 11:
                guess = [m + n - q for m, n, q in zip(L, T, TL, strict=True)]
                p = L if sum(abs(g - m) for g, m in zip(guess, L, strict=True)) < sum(abs(g - m) for g, m in zip(guess, T, strict=True)) else T
            elif mode == 12:
                p = [cl(m + n - q) for m, n, q in zip(L, T, TL, strict=True)]
            else:
                p = [cl(m + int((m - q) / 2)) for m, q in zip(avg(L, T), TL, strict=True)]
        out[i] = [(m + n) & 255 for m, n in zip(out[i], p, strict=True)]
    want = [[(r + g) & 255, g, (b + g) & 255, a] for a, r, g, b in out]
    assert got.reshape(-1, 4).tolist() == want


def test_webp_palette():
    width, height = 10, 4
    for n in (2, 4, 16, 40):
        palette = picture(n, 1, n, n)
        rng = random.Random(n)
        places = [rng.randrange(n) for _ in range(width * height)]
        pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        across = (width + (1 << pack) - 1) >> pack
        packed = []
        for y in range(height):
            for x in range(across):
                own = places[y * width + (x << pack) : min((y + 1) * width, y * width + ((x + 1) << pack))]
                packed.append(sum(v << (i * (8 >> pack)) for i, v in enumerate(own)) << 8)
        steps = webp.channels(np.array(palette))
        steps[1:] = (steps[1:] - steps[:-1]) & 255
        w = Writer()
        w.put(1, 1), w.put(3, 2), w.put(n - 1, 8)
        coded(w, webp.numbers(steps).tolist(), n)
        w.put(0, 1)
        coded(w, packed, across, True)
        assert (webp.decode(wrapped(w, width, height)) == samples([palette[p] for p in places], width, height)).all()


def test_webp_stores_texts(spark, docs, empty):
    got = {r["doc_id"]: r for r in webpstore.stored_texts(docs).collect()}
    for d, t, *_ in awkward():
        raw = (t or "").encode()
        own = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]))
    assert webpstore.stored_texts(empty).count() == 0
    blobs = spark.createDataFrame([(bytearray(webpstore.store([bytes(range(192))])[0]),), (bytearray(b"RIFFxxxx"),), (None,)], "image binary")
    assert [r["height"] for r in webp.pixel_arrays(blobs).collect()] == [1, None, None]
    dotted = blobs.select(F.col("image").alias("a.b"), F.lit(3).alias("width"), F.lit(4).alias("x.y"))
    got = webp.pixel_arrays(dotted, "a.b").collect()
    assert [r["x.y"] for r in got] == [4, 4, 4] and got[0]["width"] == 64 and len(got[0]["pixels"]) == 256
    big = bytes(192 * 133)
    assert len(webpstore.load(webpstore.store([big]))[0]) == 133


def payloads():
    rng = np.random.default_rng(4)
    out = [(prose(5, 9000) + " " * 192)[: 192 * 150].encode(), (prose(6, 40)[:192] * 9).encode(), rng.integers(0, 256, 192 * 9, dtype=np.uint8).tobytes()]
    out += [rng.integers(0, n, 192 * 5, dtype=np.uint8).tobytes() for n in (1, 2, 3, 5, 40)] + [bytes(192 * 500), b" " * 192, bytes(range(192)) * 3]
    return out + [(prose(7 + i, 10 + 40 * i)[: 192 * (1 + i)] + " " * 192 * (1 + i))[: 192 * (1 + i)].encode() for i in range(12)]


def test_webp_stored_texts_are_coded(monkeypatch):
    """The query's own files hold coded lengths, references, a cache and a palette, and are read by what decodes these."""
    seen, tokens_, palette, lengths = set(), webpbatch.read_tokens, webpbatch.undo_palette, webpbatch.read_lengths

    def reading(stream, width, sizes, cache_bits):
        seen.add("cache" if (cache_bits > 0).any() else "no cache")
        return tokens_(stream, width, sizes, cache_bits)

    def number(stream, at, prefix):
        seen.add("reference")
        return whole(stream, at, prefix)

    def coded(stream, sizes):
        found = lengths(stream, sizes)
        seen.add("codes" if ((found > 0).sum(1) > 2).any() else "few symbols")
        return found

    whole = webpbatch._number
    monkeypatch.setattr(webpbatch, "read_tokens", reading)
    monkeypatch.setattr(webpbatch, "_number", number)
    monkeypatch.setattr(webpbatch, "read_lengths", coded)
    monkeypatch.setattr(webpbatch, "undo_palette", lambda *a: seen.add("palette") or palette(*a))
    own = payloads()
    stored = webpstore.store(own)
    assert [p[..., :3].tobytes() for p in webpstore.load(stored)] == own
    assert {"codes", "cache", "reference", "palette"} <= seen
    assert sum(map(len, stored)) < sum(map(len, own))


def test_webp_batches_equal_single_images():
    own = payloads()
    stored = webpstore.store(own)
    assert [webpstore.store([p])[0] for p in own] == stored  # what else is in a batch changes nothing
    for p, media in zip(own, stored, strict=True):
        at, rows = 0, []
        while at < len(media):
            size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
            rows.append(webp.decode(media[at : at + size]))
            at += size
        assert np.concatenate(rows)[..., :3].tobytes() == p
    with pytest.raises(ValueError):
        webp.decode(stored[0][: len(stored[0]) // 40])
    cut = stored[0][:20] + stored[0][20 : 20 + 300]
    with pytest.raises(ValueError):
        webpbatch.read([cut])


def test_webp_code_lengths_are_optimal_and_bounded():
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 50, (40, 60)) * (rng.random((40, 60)) < 0.5)
    counts[0], counts[1], counts[2, :] = 0, 0, 0
    counts[1, 7] = 5
    counts[3, :40] = 2 ** np.arange(40)
    for limit in (7, 15):
        lengths = webpbatch.code_lengths(counts, limit)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit
        for c, n in zip(counts.tolist(), lengths.tolist(), strict=True):
            used = [(x, k) for x, k in zip(c, n, strict=True) if x]
            if len(used) < 2:
                continue
            assert sum(2.0**-k for _, k in used) == 1.0
            heap = sorted(x for x, _ in used)
            cost = 0
            while len(heap) > 1:  # the least total of any code is the sum of all merged weights
                a, b, *rest = heap
                cost, heap = cost + a + b, sorted([*rest, a + b])
            got = sum(x * k for x, k in used)
            assert got >= cost and (got == cost or max(k for _, k in used) >= limit - 2)


def poisson_by_hand(doc_id, rate):
    n = max(1, -(-int(np.ceil(rate)) // 16)) if rate > 16 else 1
    total = 0
    for i in range(1, n + 1):
        u = (int(hashlib.md5(f"17:{'' if doc_id is None else doc_id}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        k, term, below = 0, np.exp(-rate / n), np.exp(-rate / n)
        while below < u:
            k += 1
            term *= rate / n / k
            below += term
        total += k
    return total


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages over planted toxic texts, lines and copies, awkward rows and columns whose names clash."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(i, prose(i, 60) + (" you zorkfug quib" * 3 if i % 4 == 0 else ""), "en", "hot" if i % 3 else "b", 0) for i in range(160)]
    rows += [(200 + i, f"{prose(500 + i, 50)}\n{LINE}\n{prose(700 + i, 50)}", "en", None if i % 2 else "hot", 0) for i in range(6)]
    copy = prose(900, 90)
    rows += [(300, copy, "en", "b", 0), (301, copy, "en", "hot", 0), (302, copy + " again", "en", "b", 0), (None, copy, "en", "b", 0), (303, None, "en", "b", None), (304, "", "en", "b", 0), (301, copy, "en", "hot", 0)]
    clash = ["copy", "shuffle_key", "_hit", "node", "r", "drops", "model", "_text", "score"]
    made = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in clash])
    made.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)

    left = [r for r in rows if r[0] is None or r[0] >= 160 or r[0] % 4]
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(map(repr, (tuple(r[:5]) for r in kept.collect()))) == sorted(map(repr, left))

    left = [(d, None if t is None else "\n".join(x for x in t.split("\n") if x != LINE or d == 205), a, b, c) for d, t, a, b, c in left]
    left = [(d, t, a, b, None if t is None else len(t)) for d, t, a, b, _ in left]
    lines = corpus_pipeline.dedup_lines(spark, kept, sf)
    assert lines.columns == docs.columns and sorted(map(repr, (tuple(r[:5]) for r in lines.collect()))) == sorted(map(repr, left))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, first = {d: shingles(t) for d, t, *_ in left if d is not None}, {}
    for d in sorted(sets):
        first[d] = min([first[e] for e in first if sets[d] and 4 * len(sets[d] & sets[e]) >= 3 * len(sets[d] | sets[e])], default=d)
    left = [r for r in left if r[0] is None or first[r[0]] == r[0]]
    assert {301, 302} & {r[0] for r in left} == set()
    once = corpus_pipeline.dedup_documents(spark, lines, sf)
    assert once.columns == docs.columns and sorted(map(repr, (tuple(r[:5]) for r in once.collect()))) == sorted(map(repr, left))

    n = {s: sum(r[3] == s for r in left) for s in ("hot", "b", None)}
    left = [r for r in left for _ in range(poisson_by_hand(r[0], len(left) / 3 / n[r[3]]))]
    mixed = corpus_pipeline.mix_sources(spark, once, sf)
    assert mixed.columns == docs.columns and sorted(map(repr, (tuple(r[:5]) for r in mixed.collect()))) == sorted(map(repr, left))

    t, want = Tokenizer.from_file(tokens.vocabulary_path()), []
    for d, text, *_ in left:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((d, 0, 0, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(repr, (tuple(r[:5]) for r in got))) == sorted(map(repr, want))
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    lines = corpus_pipeline.dedup_lines(spark, kept, sf)
    assert lines.count() == kept.count() > 0.8 * docs.count()
    once = corpus_pipeline.dedup_documents(spark, lines, sf)
    assert {r["doc_id"] for r in once.select("doc_id").collect()} == {r["doc_id"] for r in neardup.link(lines).where("kept").select("doc_id").collect()}
    assert [c.columns for c in (kept, lines, once, corpus_pipeline.mix_sources(spark, once, sf))] == [docs.columns] * 4
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_a_block_that_meets_itself_in_another_order():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, 40, np.uint64)) for _ in range(4)]
    ids = np.array([10, 11, 12, 13, 20, 21])
    sets = [*base, base[1], base[3]]
    for turn in range(20):
        p, q = rng.permutation(6), rng.permutation(6)
        i, j = neardup.linked([sets[x] for x in p], [sets[x] for x in q])
        found = neardup.told(np.concatenate([ids[p], ids[q]]), i, j + 6)
        assert set(found.itertuples(index=False, name=None)) == {(20, 11), (21, 13)}
