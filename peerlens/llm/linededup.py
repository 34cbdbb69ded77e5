"""Lines that repeat across documents, found in order of their hash and told as keep bitmaps.

Every document's lines become (hash, document, positions). These are range-partitioned by hash and then document, from
the largest id down, and sorted the same way, so that a key's first occurrence is in the document that keeps it and a
very common key spreads over many partitions. Each partition is read as a stream: groups that lie inside it are decided
on the way; of a group that reaches over a partition's edge the rows are passed on with a count and its outermost documents,
and those counts, two a partition at most, decide them; a document on both sides of an edge counts once. Only dropped
positions move on; each document gets them as one compressed bitmap: the lengths of the runs of lines that stay and that
go in turn, from one that stays (0 if the first line goes). Texts of documents that lose nothing aren't shuffled.

Defined results: a null or empty text is one empty line; lines whose key is shorter than ``MIN_CHARS`` code points always
stay; rows with a null doc_id neither count nor lose lines; rows that share a doc_id are one document when documents are
counted, and each row loses its own lines; further columns are ignored, or kept by ``apply``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, give_back, hits, materialise, packed_rows, shuffle_parts, small_batches, unpacked

MIN_CHARS = 20
MIN_DOCS = 3
#: The characters stripped at both ends of a line: \x20 and \x09 to \x0D.
BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    return [line.strip(BLANK).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def counts(key: bytes) -> bool:
    """Whether a key has MIN_CHARS code points: bytes that begin one are those not of the form 10xxxxxx."""
    return len(key) >= MIN_CHARS and (len(key) >= 4 * MIN_CHARS or len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS)


def occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, row, places): each key of each document row once, with its line numbers as packed int32."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for doc, row, text in zip(pdf["doc_id"].tolist(), pdf["row"].tolist(), pdf["text"].tolist(), strict=True):
                places: dict[bytes, list[int]] = {}
                for i, key in enumerate(line_keys(text)):
                    if counts(key):
                        places.setdefault(key, []).append(i)
                for key, own in places.items():
                    h = hashlib.blake2b(key, digest_size=16).digest()
                    out.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), doc, row, np.array(own, "<i4").tobytes()))
            yield pd.DataFrame(out, columns=["h1", "h2", "doc_id", "row", "places"])
        give_back()

    small_batches(docs.sparkSession)
    keyed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", row_key().alias("row"), "text")
    return keyed.withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(split, "h1 long, h2 long, doc_id long, row long, places binary")


def row_key(text: Column | None = None) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(F.col("text") if text is None else text, F.lit("")))


class Stream:
    """Decides the groups of one sorted partition while its rows pass by.

    Yields rows of kind ``drop`` (decided), ``open`` (for the counts of all partitions to decide) and ``edge`` (of the first
    and the last group, as either may reach over the partition's edge, the documents, the largest doc_id and as ``row`` the
    smallest one).
    """

    columns = ["kind", "h1", "h2", "doc_id", "row", "places", "n"]

    def __init__(self) -> None:
        self.first = True  # the current group is the partition's first
        self.key: tuple[int, int] | None = None
        self.n, self.top, self.last_doc = 0, 0, None  # documents of the current group, its first and its latest one
        self.waiting: list[pd.DataFrame] = []  # its rows while fewer than MIN_DOCS documents are known

    def edge(self) -> pd.DataFrame:
        return pd.DataFrame([("edge", *self.key, self.top, int(self.last_doc), None, self.n)], columns=self.columns)

    def begin(self, key: tuple[int, int], rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if self.key is not None and self.first:
            yield self.edge()
            self.first = False
        self.key, self.n, self.top, self.last_doc, self.waiting = key, 0, int(rows["doc_id"].iat[0]), None, []
        yield from self.extend(rows)

    def extend(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        docs = rows["doc_id"].to_numpy()
        self.n += int((docs[1:] != docs[:-1]).sum()) + int(docs[0] != self.last_doc)
        self.last_doc = docs[-1]
        if self.first:
            yield rows.assign(kind="open", n=0)
            return
        self.waiting.append(rows)
        if self.n >= MIN_DOCS:
            ready, self.waiting = pd.concat(self.waiting), []
            yield ready[ready["doc_id"] != self.top].assign(kind="drop", n=0)

    def batch(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        h, doc = rows[["h1", "h2"]].to_numpy(), rows["doc_id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(1)])
        stops, g = np.r_[starts[1:], len(rows)], 0
        if self.key == tuple(h[0]):
            yield from self.extend(rows[: stops[0]])
            g = 1
        elif self.key is None:
            yield from self.begin(tuple(h[0]), rows[: stops[0]])
            g = 1
        if g == len(starts):
            return
        if g < len(starts) - 1:  # groups that this batch holds whole
            a, b, sizes = starts[g], starts[-1], np.diff(starts[g:])
            fresh = np.r_[True, (doc[a + 1 : b] != doc[a : b - 1])]
            fresh[starts[g:-1] - a] = True
            many = np.add.reduceat(fresh.astype(np.int64), starts[g:-1] - a) >= MIN_DOCS
            yield rows[a:b][np.repeat(many, sizes) & (doc[a:b] != np.repeat(doc[starts[g:-1]], sizes))].assign(kind="drop", n=0)
        yield from self.begin(tuple(h[starts[-1]]), rows[starts[-1] :])

    def end(self) -> Iterator[pd.DataFrame]:
        if self.key is not None:
            yield from (x.assign(kind="open", n=0) for x in self.waiting)
            yield self.edge()


def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stream = Stream()
    for rows in batches:
        if len(rows):
            for out in stream.batch(rows):
                yield out[Stream.columns]
    for out in stream.end():
        yield out[Stream.columns]


def dropped_places(docs: DataFrame) -> DataFrame:
    """(doc_id, row, places): for each key and document row the line numbers that go."""
    parts = shuffle_parts(docs.sparkSession)
    order = [F.col("h1"), F.col("h2"), F.desc("doc_id"), F.col("row")]
    held = materialise(occurrences(docs), "lines")  # read once for the bounds of the ranges and once to be dealt to them
    dealt = held.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = materialise(dealt.mapInPandas(decide, "kind string, h1 long, h2 long, doc_id long, row long, places binary, n long"), "line-groups")
    discard(held)
    #: two rows a partition at most
    along = Window.partitionBy("h1", "h2").orderBy(F.desc("doc_id"), F.desc("row"))
    twice = F.coalesce((F.lag("row").over(along) == F.col("doc_id")).cast("int"), F.lit(0))
    edges = found.where("kind = 'edge'").withColumn("twice", twice)
    edges = edges.groupBy("h1", "h2").agg(F.sum(F.col("n") - F.col("twice")).alias("docs"), F.max("doc_id").alias("keeper"))
    late = found.where("kind = 'open'").join(F.broadcast(edges.where(F.col("docs") >= MIN_DOCS)), ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    return found.where("kind = 'drop'").select("doc_id", "row", "places").unionAll(late.select("doc_id", "row", "places"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, drops): the packed line numbers that each document row loses; rows that lose none are absent. Rows that
    repeat have the same places, which count once."""
    return dropped_places(docs).groupBy("doc_id", "row").agg(F.collect_set("places").alias("drops"))


def keep_mask(n_lines: int, drops: list[bytes] | None) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    for d in drops if drops is not None else ():
        keep[np.frombuffer(d, "<i4")] = False
    return keep


def keep_runs(keep: np.ndarray) -> str:
    """The lengths of the runs of kept and dropped lines in turn, from a kept one."""
    cuts = np.flatnonzero(keep[1:] != keep[:-1]) + 1
    sizes = np.diff(np.concatenate([[0], cuts, [len(keep)]])).tolist()
    return ",".join(map(str, sizes if keep[0] else [0, *sizes]))


def mask_of_runs(runs: str) -> np.ndarray:
    """A bit a line from ``keep_runs``."""
    sizes = [int(x) for x in runs.split(",")]
    return np.repeat(np.arange(len(sizes)) % 2 == 0, sizes)


def _joined(docs: DataFrame) -> DataFrame:
    """(r, drops): each row of ``docs`` as a struct; the row key is worked out anew, as it is a function of the text. Only
    rows that a bitmap takes for ones that lose lines are shuffled."""
    found = materialise(dropped_lines(docs), "drops")
    keyed = hits(docs.select(packed_rows(docs).alias("r"), F.col("doc_id").cast("long").alias("doc_id")), F.col("doc_id"), found.select(F.col("doc_id").alias("node")))
    asked = keyed.where("_hit").select("r", "doc_id", row_key(F.col("r.text")).alias("row"))
    rest = keyed.where("NOT _hit").select("r", F.lit(None).cast("array<binary>").alias("drops"))
    return rest.union(asked.join(found, ["doc_id", "row"], "left").select("r", "drops"))


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap) for every row."""

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string, keep_bitmap string")
    def fold(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, d in zip(texts.tolist(), drops.tolist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if d is None:
                n = raw.count(b"\n") + 1
                out.append((n, 0, hashlib.sha256(raw).hexdigest(), str(n)))
                continue
            lines = raw.split(b"\n")
            keep = keep_mask(len(lines), d)
            kept = b"\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)
            out.append((len(lines), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), keep_runs(keep)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_sha256", "keep_bitmap"])

    return _joined(docs.select("doc_id", "text")).select("r.doc_id", fold("r.text", "drops").alias("f")).select("doc_id", "f.*")


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that stay; n_chars, where there is one, follows the text. A null text stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, drops: pd.Series) -> pd.Series:
        out = []
        for text, d in zip(texts.tolist(), drops.tolist(), strict=True):
            if text is not None and d is not None:
                lines = text.split("\n")
                text = "\n".join(x for x, k in zip(lines, keep_mask(len(lines), d).tolist(), strict=True) if k)
            out.append(text)
        return pd.Series(out, dtype=object)

    text = F.when(F.col("drops").isNull(), F.col("r.text")).otherwise(cut("r.text", "drops"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return _joined(docs).select("r", text.alias("_text")).select(*unpacked(docs, "r", **new))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_bitmaps(documents(spark, sf_dir))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS place
  FROM documents
), keyed AS (
  SELECT doc_id, place, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id <> common.keeper AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k
), islands AS (
  SELECT doc_id, gone, min(place) AS first, count(*) AS many
  FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id, gone ORDER BY place) AS island FROM marked) GROUP BY doc_id, gone, island
), bits AS (
  SELECT doc_id, CASE WHEN bool_or(gone AND first = 1) THEN '0,' ELSE '' END || string_agg(many::VARCHAR, ',' ORDER BY first) AS keep_bitmap FROM islands GROUP BY doc_id
)
SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256, any_value(keep_bitmap) AS keep_bitmap
FROM marked m JOIN bits b ON m.doc_id IS NOT DISTINCT FROM b.doc_id GROUP BY m.doc_id
"""
