"""Nearest vectors by cosine, block against block.

Vectors of a group are dealt to blocks of bounded size by a hash of their keys, and each block meets each other block of its group as
two matrices, in a task of its own. A meeting returns, for each vector, its nearest few of the other block and no other pair, so
that what is shuffled grows with the vectors and blocks, not with the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def nearest(vectors: DataFrame, group: str, key: str, vector: str, top: int, decimals: int = 6, block: int = BLOCK) -> DataFrame:
    """(group, key, place, other, cosine): the ``top`` nearest others of each vector within its group, by cosine to ``decimals`` and
    then by key. A vector of no length is at 0 to all; null vectors and vectors of a null group have no neighbours."""
    own = vectors.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(group, F.col(key).cast("long").alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    sizes = own.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = own.join(sizes, group).withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int"))
    held = dealt.groupBy(group, "_block", "_blocks").agg(F.collect_list(F.struct("_key", "_v")).alias("_m"))
    left = held.select(group, F.col("_m._key").alias("keys"), F.col("_m._v").alias("rows"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    right = held.select(group, "_block", F.col("_m._key").alias("other_keys"), F.col("_m._v").alias("other_rows"))

    def unit(rows) -> np.ndarray:  # noqa: ANN001
        m = np.stack([np.asarray(x, float) for x in rows])
        length = np.sqrt((m * m).sum(1))
        return m / np.where(length > 0, length, 1.0)[:, None]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, keys, rows, others, other_rows in pdf.itertuples(index=False, name=None):
                keys, others = np.asarray(keys), np.asarray(others)
                order = np.argsort(others)
                others = others[order]
                cosine = np.round(unit(rows) @ unit(other_rows)[order].T, decimals) + 0.0
                cosine[keys[:, None] == others[None, :]] = -np.inf
                best = np.argsort(-cosine, axis=1, kind="stable")[:, :top]
                i = np.repeat(np.arange(len(keys)), best.shape[1])
                found = pd.DataFrame({"g": [g] * len(i), "key": keys[i], "other": others[best.ravel()], "cosine": cosine[i, best.ravel()]})
                yield found[np.isfinite(found["cosine"])]

    pairs = left.join(right, [group, "_block"]).select(F.col(group).alias("g"), "keys", "rows", "other_keys", "other_rows")
    met = pairs.mapInPandas(meet, f"g {dict(vectors.dtypes)[group]}, key long, other long, cosine double")
    place = Window.partitionBy("g", "key").orderBy(F.desc("cosine"), "other")
    out = met.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    return out.select(F.col("g").alias(group), F.col("key").alias(key), "place", "other", "cosine")
