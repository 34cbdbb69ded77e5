"""Token ids of whole texts, and the exact histogram of token counts."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, runs, small_batches

#: ASCII marks that, in a row after letters, are one piece of their own; an apostrophe may be part of a contraction.
MARKS = ".,;:!?|#$%&*()[]{}+-=/~@^_"
DEFAULT_VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stays_letters(core: str) -> bool:
    """Whether a word is letters before and after the vocabulary composes it and lower-cases it.

    Lower-casing can make a mark of a letter's part (capital i with a dot), which would join the marks that follow. Beyond the
    code points named here tables of letters differ between Unicode versions, so such words are always encoded whole."""
    if core.isascii():
        return core.isalpha()
    return max(core) < "\u0530" and core.isalpha() and core.lower().isalpha() and unicodedata.is_normalized("NFC", core)


class WordEncoder:
    """Ids of texts under a vocabulary that never joins characters across white space.

    Each distinct word is encoded once and remembered; ``remember`` bounds how many words are. What is remembered of a word is a
    64-bit hash and its ids, some 30 bytes; a word that isn't known is taken for one of a million that are with a probability of
    6 in 10**14."""

    def __init__(self, vocabulary: str | None = None, remember: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(vocabulary or vocabulary_path()), remember
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by hash
        self.start, self.length = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int32)  # by slot
        self.ids, self.used = np.zeros(1 << 12, np.uint32), 0
        self.tails: dict[str, list[int]] = {}

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slots of words, -1 for those that aren't known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.slots[at], np.int32(-1))

    def _add(self, hashes: np.ndarray, ids: Sequence[list[int]]) -> None:
        """Remembers words that aren't known, of distinct hashes."""
        if not len(ids):
            return
        first, sizes = len(self.hashes), np.fromiter(map(len, ids), np.int32, len(ids))
        while first + len(ids) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[first : first + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.length[first : first + len(ids)] = sizes
        self.ids[self.used : self.used + total] = [x for own in ids for x in own]
        self.used += total
        own = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[own])
        self.hashes = np.insert(self.hashes, place, hashes[own])
        self.slots = np.insert(self.slots, place, (first + own).astype(np.int32))

    def _marks(self, tail: str) -> list[int]:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
        return self.tails[tail]

    def _learn(self, words: dict[int, str]) -> None:
        """Encodes words, by hash, that aren't known. Letters and the marks after them are cut apart by the vocabulary, so letters
        known alone needn't be encoded again."""
        whole, cut = dict[int, str](), dict[int, tuple[int, str]]()
        for h, word in words.items():
            core = word.rstrip(MARKS)
            if core != word and stays_letters(core):
                c = xxhash.xxh3_64_intdigest(core)
                cut[h] = c, word[len(core) :]
                whole[c] = core
            else:
                whole[h] = word
        hashes = np.fromiter(whole, np.uint64, len(whole))
        new = np.flatnonzero(self._find(hashes) < 0)
        texts = list(whole.values())
        self._add(hashes[new], [self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in new.tolist()])
        left = {h: x for h, x in cut.items() if h not in whole}
        at = self._find(np.fromiter((c for c, _ in left.values()), np.uint64, len(left)))
        own = [[*self.ids[self.start[k] : self.start[k] + self.length[k]].tolist(), *self._marks(tail)] for k, (_, tail) in zip(at.tolist(), left.values(), strict=True)]
        self._add(np.fromiter(left, np.uint64, len(left)), own)

    def _words(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its slot, and how many words each text has."""
        if len(self.hashes) > self.remember:
            self.clear()
        whole = pa.array(texts, pa.large_string())
        if not pc.any(pc.match_substring(whole, "<|")).as_py():  # else the case may tell a special token from its letters
            whole = pc.ascii_lower(whole)
        split = pc.ascii_split_whitespace(whole)
        kinds = split.flatten().dictionary_encode()
        words = kinds.dictionary.to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        new = np.flatnonzero(self._find(hashes) < 0)
        if len(new):
            self._learn({int(hashes[i]): words[i] for i in new.tolist()})
        slots = self._find(hashes)
        return slots[kinds.indices.to_numpy()] if len(words) else np.zeros(0, np.int32), np.diff(split.offsets.to_numpy())

    def lengths(self, texts: Sequence[str]) -> np.ndarray:
        slots, n = self._words(texts)
        return np.bincount(np.repeat(np.arange(len(texts)), n), self.length[slots], len(texts)).astype(np.int64)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each."""
        slots, n = self._words(texts)
        size = self.length[slots].astype(np.int64)
        ends = np.cumsum(size)
        place = np.repeat(self.start[slots] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[place], np.bincount(np.repeat(np.arange(len(texts)), n), size, len(texts)).astype(np.int64)


@cache
def encoder_for(vocabulary: str | None) -> WordEncoder:
    """One encoder in each Python worker, which keeps its words from task to task."""
    return WordEncoder(vocabulary)


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with n_tokens added: the ids of the whole text, 0 for a null or empty one.

    A column of that name is replaced, all others stay; long texts are split into runs of words for the encoder's bounds, which
    changes no id, as the vocabulary joins nothing across white space; an empty table stays empty."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_for(vocabulary)
        for s in texts:
            own, out = s.fillna("").tolist(), np.zeros(len(s), np.int64)
            for a, b in runs(own, 1 << 22):
                out[a:b] = encoder.lengths(own[a:b])
            yield pd.Series(out)

    return docs.withColumn("n_tokens", count("text"))


#: Lengths are grouped into this many consecutive ones for the suffix sums.
BLOCK = 1024


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct n_tokens with suffix sums, which answer for the context limit L = n_tokens:

    n_docs (documents of exactly L tokens), docs_up_to and docs_longer (documents of at most, of more than L tokens),
    tokens_up_to and tokens_longer (their tokens), truncated_tokens (tokens left if every document is cut to L),
    total_docs and total_tokens. Every sum is exact. Null lengths count as 0; an empty table gives an empty result.

    Documents are first counted by length, so what follows has a row per distinct length and no key is hot. The suffix
    sums are taken within blocks of BLOCK lengths and over the blocks' totals, of which there are BLOCK times fewer.
    """
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    kinds = lengths.groupBy(n.alias("n_tokens")).agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    kinds = materialise(kinds, "lengths")
    tokens = F.col("n_docs") * F.col("n_tokens")
    blocks = kinds.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = [F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("d", "t")]
    blocks = blocks.select("block", *over, F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = (F.coalesce(F.sum("n_docs").over(own), F.lit(0)) + F.col("d_later")).alias("docs_longer"), (F.coalesce(F.sum(tokens).over(own), F.lit(0)) + F.col("t_later")).alias("tokens_longer")
    out = kinds.join(blocks, "block").select("n_tokens", "n_docs", *sums, "total_docs", "total_tokens")
    return out.select(
        "n_tokens", "n_docs", (F.col("total_docs") - F.col("docs_longer")).alias("docs_up_to"), "docs_longer",
        (F.col("total_tokens") - F.col("tokens_longer")).alias("tokens_up_to"), "tokens_longer",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"), "total_docs", "total_tokens",
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, docs_longer, truncated_tokens) for any context limits, from the histogram alone."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    more = F.col("n_tokens") > F.col("limit")
    cut = F.least("n_tokens", "limit") * F.col("n_docs")
    return histogram.select("n_tokens", "n_docs").join(F.broadcast(asked)).groupBy("limit").agg(F.coalesce(F.sum(F.when(more, F.col("n_docs"))), F.lit(0)).alias("docs_longer"), F.sum(cut).alias("truncated_tokens"))


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents doesn't exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return histogram.join(F.broadcast(asked)).where(F.col("docs_up_to") >= F.col("share") * F.col("total_docs")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(documents(spark, sf_dir).select("text")))
