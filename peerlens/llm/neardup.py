"""Near duplicates by MinHash bands, sequential Bayesian pruning and exact verification.

1. Each text becomes its set of distinct 5-word shingles, as 64-bit hashes, and from that a digest of the set and
   ``HASHES`` minhash values of 16 bits. Rows with one digest are a class with the smallest doc_id as its
   representative; from here on only representatives move.
2. ``BANDS`` bands of ``ROWS`` values put representatives into buckets. Buckets that share a member join to families, by
   each bucket's smallest member: no pairs are made.
3. Within a family, blocks of signatures meet blocks of signatures. Pairs are compared a batch of values at a time; a
   pair is pruned once the posterior probability that its similarity reaches the threshold, after m matches among n
   values and a uniform prior, is below ``MISS``. What survives joins to smaller families.
4. Within those, blocks of full shingle sets meet, and a link is a pair with 100 * intersection >= 75 * union. Blocks
   return no pairs but each member's smallest linked fellow, and the components of these are the result.

A block is bounded in members and bytes, whatever a family's size, and a family of n blocks makes n * (n + 1) / 2 rows.
Two texts at the threshold share no band with probability ``(1 - 0.75**ROWS)**BANDS``, 2 in 100,000.

Defined results: a text that is null or has no word has an empty set and is linked with nothing; a null doc_id is linked
with nothing, is kept and has a null component; rows that share a doc_id are one document that has the links of all of
them (the representatives of its texts are linked, and an empty text among them goes with the others); ties and repeated rows have no order to depend on; further columns are ignored, or kept by ``drop_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, documents, give_back, hits, marked, materialise, over_keys, packed_rows, runs, salt, small_batches, unpacked
from .components import components

WORDS = 5
#: A link is 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS = 40
ROWS = 5
HASHES = BANDS * ROWS
#: Minhash values compared at a time.
BATCH = 25
#: The posterior probability of a missed link at which a pair is pruned.
MISS = 1e-6
#: Blocks hold about so many signatures, or so many bytes of sets.
BLOCK_MEMBERS = 1024
BLOCK_BYTES = 2 << 20

_RNG = np.random.default_rng(75)
_PLACES = _RNG.integers(1, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Sequence[str]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    words = split.flatten()
    kinds = words.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in kinds.dictionary.to_pylist()), np.uint64, len(kinds.dictionary))
    real = np.asarray(pc.binary_length(words)) > 0
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))[real]
    each = hashes[kinds.indices.to_numpy()[real]] if len(hashes) else np.zeros(0, np.uint64)
    n = np.bincount(owner, minlength=len(texts))
    rolled = np.zeros(max(len(each) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        rolled += each[k : k + len(rolled)] * _PLACES[k]
    rolled, stops, out = mixed(rolled), np.cumsum(n), []
    for stop, m in zip(stops.tolist(), n.tolist(), strict=True):
        if m >= WORDS:
            out.append(np.unique(rolled[stop - m : stop - WORDS + 1]))
        elif m:
            out.append(mixed(np.array([(each[stop - m : stop] * _PLACES[:m]).sum()], np.uint64), m))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits, mixed, of the least shingle under each of HASHES multiplications."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 256):
        np.minimum(low, (shingles[a : a + 256, None] * _MIX).min(0), out=low)
    return mixed(low).astype(np.uint16)


def _sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        own, out = s.fillna("").tolist(), []
        for a, b in runs(own):
            for x in shingle_sets(own[a:b]):
                d1, d2 = (int(mixed(x, k).sum(dtype=np.uint64).astype(np.int64)) for k in (1, 2))
                out.append((len(x), d1, d2, signature(x).tobytes() if len(x) else None))
        yield pd.DataFrame(out, columns=["n", "d1", "d2", "sig"])
    give_back()


def _packed_set(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        own, out = s.fillna("").tolist(), []
        for a, b in runs(own):
            out += [x.tobytes() for x in shingle_sets(own[a:b])]
        yield pd.Series(out, dtype=object)
    give_back()


def least_matches(n: int) -> int:
    """The fewest matches among n values at which P(similarity >= threshold) is at least MISS, under a uniform prior.

    The posterior of the similarity is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m)."""
    t, tail = PERCENT / 100, 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= MISS:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs of signatures that no batch prunes."""
    first = np.zeros((len(a), len(b)), np.uint8)
    for k in range(BATCH):
        first += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(first >= least_matches(BATCH))
    found = first[i, j].astype(np.int64)
    for k in range(BATCH, HASHES, BATCH):
        keep = np.zeros(len(i), bool)
        for x in range(0, len(i), 1 << 16):
            part = slice(x, x + (1 << 16))
            found[part] += (a[i[part], k : k + BATCH] == b[j[part], k : k + BATCH]).sum(1)
            keep[part] = found[part] >= least_matches(k + BATCH)
        i, j, found = i[keep], j[keep], found[keep]
    return i, j


def linked(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs of sets that are links, by exact intersections as sums over shared shingles."""
    size = np.array([len(x) for x in a + b])
    owner = np.repeat(np.arange(len(size)), size)
    values, column, n = np.unique(np.concatenate(a + b), return_inverse=True, return_counts=True)
    shared = n > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner, width = place[column[keep]], owner[keep], int(shared.sum())
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for x in range(0, width, 4096):
        p, q = np.searchsorted(column, (x, x + 4096))
        dense = np.zeros((len(size), min(4096, width - x)), np.float32)
        dense[owner[p:q], column[p:q] - x] = 1
        common += dense[: len(a)] @ dense[len(a) :].T
    common = np.rint(common).astype(np.int64)
    return np.nonzero((common > 0) & (100 * common >= PERCENT * (size[: len(a), None] + size[None, len(a) :] - common)))


def told(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """(a, b): for each member that the pairs (i, j) connect with a smaller one, the smallest so connected."""
    label = ids.copy()
    while True:
        low, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    moved = label < ids
    return pd.DataFrame({"a": ids[moved], "b": label[moved]})


def cut(families: DataFrame, weight: Column, bound: int) -> DataFrame:
    """(node, family, block, blocks): each family cut into blocks of about ``bound`` by a hash of its members.

    This is done before members get their payload, and a hot family's rows are dealt to several tasks."""
    salted = families.select("node", "family", weight.alias("_weight"), salt("node").alias("_salt"))
    blocks = over_keys(salted, ["family"], [F.sum("_weight").alias("w")], [F.ceil(F.sum("w") / bound).cast("int").alias("blocks")])
    found = salted.join(blocks.select("family", "blocks", F.explode("_salts").alias("_salt")), ["family", "_salt"])
    return found.select("node", "family", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks")


def meet(members: DataFrame, payload: str, sets: bool) -> DataFrame:
    """Links (a, b) within each family. ``members``: family, block, blocks, node and ``payload``, a signature or a set.

    Each block of a family meets itself and the later ones. Both sides of a meeting bring their own nodes, also where a block
    meets itself, as its two copies may have been gathered in different orders; there a member meets itself, which is a link."""
    held = members.groupBy("family", "block", "blocks").agg(F.collect_list(F.struct("node", payload)).alias("m"))
    held = held.select("family", "block", "blocks", F.col("m.node").alias("nodes"), F.col(f"m.{payload}").alias("data"))
    left = held.select("family", F.col("nodes").alias("nodes_a"), F.col("data").alias("data_a"), "block", F.explode(F.expr("sequence(block, blocks - 1)")).alias("other"))
    right = held.select("family", F.col("block").alias("other"), F.col("nodes").alias("nodes_b"), F.col("data").alias("data_b"))
    pairs = left.join(right, ["family", "other"]).select("nodes_a", "data_a", "nodes_b", "data_b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for na, da, nb, db in pdf.itertuples(index=False, name=None):
                if sets:
                    a, b = ([np.frombuffer(x, np.uint64) for x in d] for d in (da, db))
                    i, j = linked(a, b)
                else:
                    a, b = (np.frombuffer(b"".join(d), np.uint16).reshape(-1, HASHES) for d in (da, db))
                    i, j = survivors(a, b)
                yield told(np.concatenate([na, nb]).astype(np.int64), i, j + len(na))

    return pairs.mapInPandas(compare, "a long, b long")


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    sketch = F.pandas_udf(_sketch, "n long, d1 long, d2 long, sig binary")
    packed_set = F.pandas_udf(_packed_set, "binary")
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), sketch("text").alias("s")).select("doc_id", "s.*", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt"))
    rows = materialise(rows, "sketches")
    one = [F.min("node").alias("node"), F.first("sig").alias("sig")]
    classes = over_keys(rows.where("n > 0 AND doc_id IS NOT NULL").withColumnRenamed("doc_id", "node"), ["n", "d1", "d2"], one, one)
    classes = materialise(classes, "classes")

    width = 2 * ROWS
    bands = classes.select("node", salt("node").alias("_salt"), F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))")).alias("bucket"))
    buckets = over_keys(bands, ["bucket"], [F.count("*").alias("many"), F.min("node").alias("low")], [F.sum("many").alias("many"), F.min("low").alias("low")])
    buckets = buckets.where("many > 1").select("bucket", "low", F.explode("_salts").alias("_salt"))
    candidates = bands.join(buckets, ["bucket", "_salt"]).select(F.col("node").alias("a"), F.col("low").alias("b"))

    families = components(candidates).withColumnRenamed("component", "family")
    members = classes.select("node", "sig").join(cut(families, F.lit(1), BLOCK_MEMBERS), "node")
    families = components(meet(members, "sig", False)).withColumnRenamed("component", "family")
    sizes = classes.groupBy("node").agg(F.sum("n").alias("n"))
    families = materialise(cut(families.join(sizes, "node"), 8 * F.col("n"), BLOCK_BYTES), "families")
    texts = marked(docs.select(key.alias("node"), "text"), F.col("node"), families).join(families, "node")
    full = materialise(texts.select("family", "block", "blocks", "node", packed_set("text").alias("set")), "sets")
    reps = classes.select("n", "d1", "d2", "node", F.explode("_salts").alias("_salt"))
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.min(c).alias(f"low_{c}") for c in ("n", "d1", "d2")], *[F.max(c).alias(f"top_{c}") for c in ("n", "d1", "d2")])
    several = several.where("low_n < top_n OR low_d1 < top_d1 OR low_d2 < top_d2").select("doc_id")
    shared = rows.where("n > 0").join(several, "doc_id").join(reps, ["n", "d1", "d2", "_salt"]).select("doc_id", "node").distinct()
    shared = materialise(shared.join(shared.groupBy("doc_id").agg(F.min("node").alias("low")), "doc_id"), "shared-ids")
    links = components(meet(full, "set", True).union(shared.select("node", "low")))

    found = classes.select("n", "d1", "d2", "node", "_salts").join(links, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("_component"), F.explode("_salts").alias("_salt"))
    out = rows.select("doc_id", "n", "d1", "d2", "_salt").join(found, ["n", "d1", "d2", "_salt"], "left")
    of_id = shared.join(links, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("_of_id"))
    out = out.join(of_id, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("_component")), F.col("_of_id"), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, with all their columns. Only rows that a bitmap
    takes for others are shuffled."""
    gone = link(docs).where(~F.col("kept")).select(F.col("doc_id").alias("node")).distinct()
    gone = materialise(gone, "gone")
    rows = hits(docs.select(packed_rows(docs).alias("r"), F.col("doc_id").cast("long").alias("node")), F.col("node"), gone)
    kept = rows.where("NOT _hit").select("r").union(rows.where("_hit").join(gone, "node", "left_anti").select("r"))
    return kept.select(*unpacked(docs, "r"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  WITH RECURSIVE r(node, seen) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.node, links.b FROM r JOIN links ON r.seen = links.a)
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id, sets.doc_id = component_id AS kept FROM sets JOIN reach ON sets.doc_id = reach.node
"""
