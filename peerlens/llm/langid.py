"""Language identification with hyperdimensional profiles.

Every letter symbol has a random vector of -1 and 1. A trigram's vector is the product of its letters' vectors, each
rotated by its place; a document's vector is the sum of its trigrams' vectors; a language's prototype is the sum of its
training documents' vectors less the mean direction that all languages share. A document gets the language whose prototype has the largest
cosine with it.

Prototypes are sums of integers, so their value doesn't depend on the partitioning. What comes to the driver is one
vector of ``DIMS`` numbers a language.

Defined results: a text that is null or has no letter gets ``und`` with score 0, and so does every text if nothing could
be learnt; ties go to the alphabetically first language; rows that repeat are predicted alike; a null doc_id counts as
not held out; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, runs, small_batches
from .letters import ngram_codes

BITS = 7
DIMS = 512
SEED = 20240611
MAX_HELD = 16


@cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (1 << BITS, DIMS))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of -1 and 1 for each trigram code: letters bound by multiplication, each rotated by its place."""
    letters, mask = letter_vectors(), (1 << BITS) - 1
    first, second, third = (letters[(codes >> BITS * k) & mask] for k in (2, 1, 0))
    return np.roll(first, 2, 1) * np.roll(second, 1, 1) * third


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Bundler:
    """Document vectors, with the vectors of up to 2**15 known trigrams at hand."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(1 << 3 * BITS, -1, np.int32)
        self.vectors, self.used = np.empty((1 << 15, DIMS), np.float32), 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.slot[codes] < 0]
        if len(new):
            if self.used + len(new) > len(self.vectors):
                self.clear()
                new = codes
                if len(new) > len(self.vectors):
                    return trigram_vectors(codes).astype(np.float32)
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.vectors[self.used : self.used + len(new)] = trigram_vectors(new)
            self.used += len(new)
        return self.vectors[self.slot[codes]]

    def bundle(self, codes: np.ndarray) -> np.ndarray:
        kinds, n = np.unique(codes, return_counts=True)
        return n.astype(np.float32) @ self.rows(kinds)


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Each language's prototype, of unit length. ``docs``: text, lang.

    A task holds the trigram counts of up to MAX_HELD languages at a time, 16 MB each, and hands out what it has beyond that."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                if lang not in counts and len(counts) >= MAX_HELD:
                    yield from bundled(counts)
                    counts.clear()
                for a, b in runs(texts):
                    own = counts.setdefault(lang, np.zeros(1 << 3 * BITS, np.int64))
                    own += np.bincount(ngram_codes(texts[a:b], BITS, 3)[0], minlength=len(own))
        yield from bundled(counts)

    def bundled(counts: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, n in counts.items():
            kinds, total = np.flatnonzero(n), np.zeros(DIMS, np.int64)
            for a in range(0, len(kinds), 4096):
                total += n[kinds[a : a + 4096]] @ trigram_vectors(kinds[a : a + 4096]).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "dim": np.arange(DIMS), "total": total})

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = known.mapInPandas(partial, "lang string, dim int, total long").groupBy("lang", "dim").agg(F.sum("total").alias("total")).toPandas()
    raw = {}
    for lang, part in sorted(sums.groupby("lang")):
        v = part.sort_values("dim")["total"].to_numpy(np.float64)
        if np.any(v):
            raw[lang] = v / np.linalg.norm(v)
    mean = sum(raw.values()) / len(raw) if len(raw) > 1 else 0.0
    out = {lang: v - 0.5 * mean for lang, v in raw.items()}
    return {lang: v / (np.linalg.norm(v) or 1) for lang, v in out.items()}


def predictor(spark: SparkSession, prototypes: dict[str, np.ndarray]):
    """A pandas UDF from text to (lang_pred, score); the score is the cosine, at least 0."""
    langs = sorted(prototypes)
    sent = spark.sparkContext.broadcast(np.stack([prototypes[x] for x in langs], 1).astype(np.float32) if langs else None)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matrix, bundler = sent.value, Bundler()
        for s in texts:
            own = s.fillna("").tolist()
            pred, score = np.full(len(own), "und", object), np.zeros(len(own))
            for a, b in runs(own) if langs else ():
                codes, n = ngram_codes(own[a:b], BITS, 3)
                ends = np.cumsum(n)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                vectors = np.stack([bundler.bundle(codes[ends[i] - n[i] : ends[i]]) for i in some])
                cosines = vectors @ matrix / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                best = cosines.argmax(1)
                pred[a + some] = np.array(langs, object)[best]
                score[a + some] = np.clip(cosines[np.arange(len(some)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``, learnt from its rows that are not held out."""
    predict = predictor(small_batches(docs.sparkSession), learn(docs.where(~held_out())))
    out = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text")).alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
