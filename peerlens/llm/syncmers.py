r"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's letters are its pieces: runs of up to ``PIECE`` characters that are not blank, counted from each word's start.
A k-mer of ``K`` pieces is kept if the least of its inner s-mers of ``S`` = 2 pieces, by hash, is its first or its last
one. That depends on the k-mer alone, so the same passage gives the same anchors in any context. A fingerprint is every
anchor of the whole text with its place. Two texts are matched by the first places of their common hashes: likeness is the
share of common hashes among all hashes of either, and passages are the stretches of matches of one shift between the
places. ``sketch`` keeps the ``SIZE`` least hashes besides.

Documents follow each other in descending doc_id. Ids alone are range-partitioned to find each one's next; a document
then sends its text to its predecessor, and anchors are made where both texts meet.

Defined results: a null text is empty; a text without a closed syncmer has its s-mers for anchors; an empty text has an empty
fingerprint, which is like another empty one (1.0) and unlike all else (0.0); rows with one doc_id follow each other by
the hash of their text, null ids come last, and rows that repeat are one document with a result row for each; a single
document is its own next; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, shuffle_parts

PIECE = 4
K = 5
S = 2
SIZE = 128


def smers(text: Column) -> Column:
    """Hashes of all pairs of neighbouring pieces; of the only piece, if there is one."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), 0)
    pair = lambda p: F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(1))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.array(pieces), pair)[0]


def _kmer(s: Column, i: Column, found: Column) -> Column:
    """``found`` if the k-mer of the s-mers from i on is a closed syncmer, else null."""
    inner = [F.get(s, i + k) for k in range(K - S + 1)]
    least = F.least(*inner)
    return F.when((inner[0] == least) | (inner[-1] == least), found)


def _each(text: Column, make) -> Column:
    """``make(s-mers, place)`` for each closed syncmer, or for each s-mer of a text without one; the s-mers are made once."""
    window = K - S + 1
    every = lambda s: F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - window), lambda i: _kmer(s, i, make(s, i, True))), lambda x: x.isNotNull())
    short = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: make(s, i, False))
    some = lambda s: F.transform(F.array(every(s)), lambda found: F.when(F.size(found) > 0, found).otherwise(short(s)))[0]
    return F.transform(F.array(smers(text)), lambda s: F.when(F.size(s) >= window, some(s)).when(F.size(s) > 0, short(s)))[0]


def _hash(s: Column, i: Column, whole: bool) -> Column:
    mixed = F.xxhash64(*[F.get(s, i + k) for k in range(0, K - S + 1)]) if whole else F.xxhash64(F.get(s, i))
    return F.shiftrightunsigned(mixed, 33).cast("int")


def anchors(text: Column) -> Column:
    """array<struct<place int, hash int>>: each anchor and the number of its first piece, in order; null without one."""
    return _each(text, lambda s, i, whole: F.struct(i.alias("place"), _hash(s, i, whole).alias("hash")))


def packed(text: Column) -> Column:
    """Each anchor's hash, and its place in the lower 32 bits, in order of places; empty without one."""
    own = lambda s, i, whole: F.shiftleft(_hash(s, i, whole).cast("long"), 32).bitwiseOR(i.cast("long"))
    return F.coalesce(_each(text, own), F.array().cast("array<long>"))


def _high(x: Column) -> Column:
    return F.shiftright(x, 32)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << 31) - 1))


def _begins(s: Column) -> Column:
    """The elements of sorted ``s`` whose upper half isn't that of the one before."""
    return F.filter(s, lambda x, i: (i == 0) | (_high(x) != _high(F.get(s, i - 1))))


def _ends(s: Column) -> Column:
    return F.filter(s, lambda x, i: (i == F.size(s) - 1) | (_high(x) != _high(F.get(s, i + 1))))


def firsts(packed: Column) -> Column:
    """Each distinct hash with its first place, by hash."""
    return F.transform(F.array(F.sort_array(packed)), _begins)[0]


def matches(a: Column, b: Column) -> Column:
    """For each hash in both of two ``firsts`` the shift from its place in ``a`` to that in ``b``, and the place in ``a`` in the
    lower 32 bits, by shift and then place."""
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(1 << 31)))))
    pair = lambda x, y: F.when(_high(x) == _high(y), F.shiftleft(_low(y) - _low(x), 32).bitwiseOR(_low(x)))
    pairs = F.transform(F.array(both), lambda s: F.transform(s, lambda x, i: pair(x, F.get(s, i + 1))))[0]
    return F.sort_array(F.filter(pairs, lambda x: x.isNotNull()))


def likeness(matches: Column, a: Column, b: Column) -> Column:
    """The share of hashes in both among those of either; 1.0 if both are empty."""
    common = F.size(matches)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def passages(matches: Column) -> Column:
    """first-last+shift for each stretch of matches of one shift, with the places of its first and last anchor."""
    told = lambda x, y: F.concat(_low(x).cast("string"), F.lit("-"), _low(y).cast("string"), F.when(_high(x) < 0, F.lit("")).otherwise(F.lit("+")), _high(x).cast("string"))
    return F.array_join(F.zip_with(_begins(matches), _ends(matches), told), " ")


def sketch(firsts: Column) -> Column:
    """Eight hex digits for each of the SIZE least hashes."""
    return F.array_join(F.transform(F.slice(firsts, 1, SIZE), lambda x: F.lpad(F.hex(_high(x)), 8, "0")), "")


def as_text(packed: Column) -> Column:
    """Eight hex digits of the hash and eight of the place for each anchor."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def followers(ids: DataFrame) -> DataFrame:
    """``ids`` (k, h: distinct pairs; n) with next_k and next_h, by descending id and then h, the last before the first.

    Each range of ids is one partition of a window; a range's last row gets the first of the next range, from a table
    with one row per range."""
    order = [(F.col("h") % 2 != 0).asc(), F.col("k").desc(), F.col("h").asc()]
    dealt = materialise(ids.repartitionByRange(shuffle_parts(ids.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ids")
    rows = dealt.withColumn("next", F.lead(F.struct("k", "h")).over(Window.partitionBy("part").orderBy(*order)))
    heads = dealt.groupBy("part").agg(F.min_by(F.struct("k", "h"), F.struct(F.col("h") % 2 != 0, -F.col("k"), F.col("h"))).alias("head"))
    around = Window.orderBy("part")
    after = heads.select(F.col("part").alias("_part"), F.coalesce(F.lead("head").over(around), F.first("head").over(around)).alias("head"))
    following = F.coalesce("next", "head")
    return rows.join(F.broadcast(after), F.col("part") == F.col("_part")).select("k", "h", "n", following["k"].alias("next_k"), following["h"].alias("next_h"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, sketch, passages_edited,
    passages_next) for every row.

    A row's key is its id, 0 for null, and a hash of its text whose lowest bit tells null ids apart. Both joins read the
    same shuffle of (key, text)."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().cast("long").alias("null"))
    base = base.select("k", (F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("null"))).alias("h"), "text")
    pairs = materialise(followers(base.select("k", "h", F.length("text").alias("n")).distinct()), "followers")
    held = base.select("k", "h", "text").repartition(shuffle_parts(docs.sparkSession), "k", "h")
    asked = pairs.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.col("next_k").alias("k"), F.col("next_h").alias("h"))
    sent = held.join(asked, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.col("text").alias("next_text")).dropDuplicates(["k", "h"])
    both = held.join(sent, ["k", "h"])
    n = F.length("text")
    kept = F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int"))
    head = F.substring("next_text", F.lit(1), F.floor(n / 3).cast("int"))
    edited = both.select(F.when(F.col("h") % 2 == 0, F.col("k")).alias("doc_id"), n.cast("long").alias("n_chars"), "text", "next_text", F.concat(kept, head).alias("edited"))
    of = {"own": "text", "new": "edited", "next": "next_text"}
    made = edited.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), *[packed(F.col(c)).alias(a) for a, c in of.items()])
    first = made.select("*", *[firsts(F.col(a)).alias(f"{a}_first") for a in of])
    matched = first.select("*", *[matches(F.col("own_first"), F.col(f"{a}_first")).alias(f"{a}_match") for a in ("new", "next")])
    near = {a: likeness(F.col(f"{a}_match"), F.col("own_first"), F.col(f"{a}_first")) for a in ("new", "next")}
    return matched.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"), near["new"].alias("near_edited"), near["next"].alias("near_next"),
        sketch(F.col("own_first")).alias("sketch"), passages(F.col("new_match")).alias("passages_edited"), passages(F.col("next_match")).alias("passages_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))
