"""Merkle manifest of a dataset: a digest of each row, a subroot of each source, one root, and a proof of each row.

Leaves stand in order within their source. Level by level, the numbers of nodes are divided by the fanout and the nodes of one
quotient, sorted, are hashed into their parent, until each source has one node left. The subroots, ordered by source, are then
hashed into the root in the same way. Going down again, each level is joined to the runs below it, and every node of a run
appends its siblings to the path of its parent.

Row numbers come from a range-partitioned sort: a row's number is its place in its partition plus the rows of the partitions
before it, so no task sorts a whole source. A level is grouped by (source, number / fanout), so a hot source is spread as others
are. Levels shrink by the fanout; each is written once and read by the level above and on the way down. Texts are hashed where
they are read and never shuffled; a leaf's path is shuffled once, with its parent's.

Defined results: a field that is null is ``-`` in the digest; a null source is a source of its own and comes first; a null doc_id
comes first in its source and is never tampered with; rows of one source and doc_id stand in the order of their leaves, and rows
that repeat have equal leaves with a proof each; a lone leaf is its source's subroot, with its path from there; an empty text
has length 0; further columns are not read, whatever their names; a table without rows gives one without rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CRC_SQL, crc_sql, documents, materialise, shuffle_parts

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Numbers of rows within a partition take so many bits of what Spark counts up.
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hexed(node: Column) -> Column:
    return F.lower(F.hex(node))


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(**replaced: Column) -> Column:
    return digest(*[field(replaced.get(c, F.col(c))) for c in FIELDS])


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, written, with ``at``, their number from 0 in the order of ``keys`` (nulls first), and ``part``, their partition.

    Only one count for each partition is ordered in one task and broadcast."""
    order = [F.asc_nulls_first(k) for k in keys]
    placed = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    kept = materialise(placed.withColumn("_row", row).select("*", F.shiftright("_row", ROW_BITS).cast("int").alias("part")), "manifest-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("part").agg(F.count("*").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), "part").withColumn("at", F.col("_start") + F.col("_row").bitwiseAND((1 << ROW_BITS) - 1)).drop("_row", "_start")


@dataclass(frozen=True)
class Tree:
    """``levels`` hold the runs of each level, lowest first: (g, idx, n, kids, node) with the parent's place and digest and the
    number of nodes on its level. ``tops`` holds (g, depth, node, own): the last node of each group and the level it is on."""

    levels: list[DataFrame]
    tops: DataFrame


def build(leaves: DataFrame, most: int) -> Tree:
    """The trees of ``leaves`` (g, idx, n, node, own), one for each group g of n leaves; no group has over ``most`` of them."""
    levels, tops, nodes = [], [leaves.where("n = 1").select("g", F.lit(0).alias("depth"), "node")], leaves.where("n > 1")
    while most > 1:
        kid = F.struct((F.col("idx") % FANOUT).cast("int").alias("pos"), *[c for c in ("node", "own") if c in nodes.columns])
        runs = nodes.groupBy("g", F.floor(F.col("idx") / FANOUT).alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        runs = materialise(runs.withColumn("node", F.unhex(digest(F.concat_ws("", F.transform("kids", lambda k: hexed(k["node"])))))), f"manifest-level{len(levels)}")
        levels.append(runs)
        most = -(-most // FANOUT)
        tops.append(runs.where("n = 1").select("g", F.lit(len(levels)).alias("depth"), "node"))
        nodes = runs.where("n > 1").select("g", "idx", "n", "node")
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return Tree(levels, found)


def joined(nodes: Column) -> Column:
    return F.aggregate(nodes, F.unhex(F.lit("")), lambda done, x: F.concat(done, x))


def proofs(tree: Tree, tops: DataFrame) -> DataFrame:
    """(own, node, path, subroot, root) of each leaf that isn't alone in its group; ``tops`` has (g, depth, path, subroot, root).

    ``path`` holds what stands before and after the node in its run, as digests in a row, for each level from the leaf's up."""
    carried = ["path", "subroot", "root"]
    known = None
    for k in reversed(range(len(tree.levels))):
        above = tops.where(F.col("depth") == k + 1).select("g", F.lit(0).cast("long").alias("idx"), *carried)
        met = tree.levels[k].join(above if known is None else known.unionByName(above), ["g", "idx"])
        nodes = F.transform("kids", lambda kid: kid["node"])
        step = lambda i: F.struct(joined(F.slice(nodes, F.lit(1), i)).alias("before"), joined(F.slice(nodes, i + 2, F.lit(FANOUT))).alias("after"))  # noqa: E731, B023
        kids = met.select("g", "idx", *carried, F.explode(F.transform("kids", lambda kid, i: F.struct(kid.alias("kid"), step(i).alias("step")))).alias("_k"))  # noqa: B023
        path = F.concat(F.array("_k.step"), "path").alias("path")
        if k:
            known = kids.select("g", (F.col("idx") * FANOUT + F.col("_k.kid.pos")).alias("idx"), path, "subroot", "root")
        else:
            return kids.select(F.col("_k.kid.own").alias("own"), F.col("_k.kid.node").alias("node"), path, "subroot", "root")
    raise ValueError("a tree without levels has no runs")


NO_PATH = "CAST(array() AS array<struct<before: binary, after: binary>>)"


def manifest(rows: DataFrame) -> DataFrame:
    """(own, node, path, subroot, root) of every row of ``rows`` (source, doc_id, node, own): its digest, the way to the root, the
    digest of its source and that of the whole. ``own`` is a struct of whatever belongs to the row; digests are binary."""
    leaves = numbered(rows, "source", "doc_id", "node")
    parts = leaves.groupBy("part", "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    sources = numbered(parts.groupBy("source").agg(F.min("first").alias("first"), F.sum("n").alias("n")), "first")
    n_sources, most = sources.agg(F.count("*"), F.max("n")).first()
    sources = sources.select(F.col("source").alias("_source"), F.col("at").alias("g"), "first", "n")
    of_part = parts.select("part", "source").join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("part").alias("_part"), "_source", "g", "first", "n")
    placed = leaves.join(of_part, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))).select("g", (F.col("at") - F.col("first")).alias("idx"), "n", "node", "own")
    lower = build(placed, most or 0)
    roots = materialise(lower.tops, "manifest-subroots")
    upper = build(roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(n_sources).cast("long").alias("n"), "node", F.struct("g", "depth").alias("own")), n_sources)
    if upper.levels:
        top = upper.tops.where("depth > 0").select("g", "depth", F.expr(NO_PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("root"))
        tops = proofs(upper, top).select("own.g", "own.depth", "path", F.col("node").alias("subroot"), "root")
    else:
        tops = roots.select("g", "depth", F.expr(NO_PATH).alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    tops = materialise(tops, "manifest-tops")
    alone = placed.where("n = 1").join(tops.where("depth = 0").select("g", "path", "subroot", "root"), "g").select("own", "node", "path", "subroot", "root")
    return proofs(lower, tops).unionByName(alone) if lower.levels else alone


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex, that a leaf's digest and a path lead to."""
    return F.aggregate(path, hexed(leaf), lambda h, s: digest(hexed(s["before"]), h, hexed(s["after"])))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    shown = F.when(tampered, row_digest(text=F.translate("text", "\n", ""))).otherwise(F.col("leaf"))
    hashed = documents(spark, sf_dir).withColumn("leaf", row_digest()).select("source", "doc_id", F.unhex("leaf").alias("node"), F.struct(F.col("doc_id"), F.unhex(shown).alias("shown")).alias("own"))
    found = manifest(hashed).select(
        F.col("own.doc_id").alias("doc_id"), hexed(F.col("node")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        F.sha2(hexed(joined(F.transform("path", lambda s: F.concat(s["before"], s["after"])))).cast("binary"), 256).alias("proof_sha256"), folded(F.col("own.shown"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _side_sql(tree: str, frame: str, order: str) -> str:
    return f"coalesce(string_agg(node, '') OVER (PARTITION BY {tree}, lvl, idx // 3 ORDER BY idx ROWS BETWEEN {frame}), '') AS {order}"


_SIDES = f"{_side_sql('source', 'UNBOUNDED PRECEDING AND 1 PRECEDING', 'before')}, {_side_sql('source', '1 FOLLOWING AND UNBOUNDED FOLLOWING', 'after')}"

ORACLE = f"""
WITH RECURSIVE {CRC_SQL},
hashed AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {crc_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS shown
  FROM documents, crcs
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed
), lower AS (
  SELECT source, 0 AS lvl, idx, n, leaf AS node FROM leaves
  UNION ALL
  SELECT source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM lower WHERE n > 1 GROUP BY source, lvl, idx // 3, n
), subroots AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM lower WHERE n = 1
), upper AS (
  SELECT 0 AS source, 0 AS lvl, place AS idx, n, subroot AS node FROM subroots
  UNION ALL
  SELECT source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY source, lvl, idx // 3, n
), sides AS (
  SELECT *, {_SIDES} FROM lower WHERE n > 1
), upper_sides AS (
  SELECT *, {_SIDES} FROM upper WHERE n > 1
), climbed AS (
  SELECT doc_id, source, leaf, leaf AS own, shown AS h, '' AS proof, idx AS at, 0 AS lvl, n, idx AS row FROM leaves
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, sha256(before || own || after), sha256(before || h || after), proof || before || after, c.at // 3, c.lvl + 1, (c.n + 2) // 3, row
  FROM climbed c JOIN sides s ON c.source IS NOT DISTINCT FROM s.source AND c.lvl = s.lvl AND c.at = s.idx WHERE c.n > 1
), on_top AS (
  SELECT c.doc_id, c.source, c.leaf, c.own AS subroot, c.own, c.h, c.proof, p.place AS at, 0 AS lvl, p.n, c.row FROM climbed c JOIN subroots p ON c.source IS NOT DISTINCT FROM p.source WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.subroot, sha256(before || own || after), sha256(before || h || after), proof || before || after, c.at // 3, c.lvl + 1, (c.n + 2) // 3, row
  FROM on_top c JOIN upper_sides s ON c.lvl = s.lvl AND c.at = s.idx WHERE c.n > 1
)
SELECT doc_id, leaf, subroot, own AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = own AS verified FROM on_top WHERE n = 1
"""
