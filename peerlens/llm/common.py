"""Helpers shared by the corpus operators: reading, splitting, writing between jobs."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in runs of about this many characters, so that a task's arrays stay small.
RUN_CHARS = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small_batches(spark: SparkSession) -> SparkSession:
    """Hands texts to Python in batches of a few megabytes, as one row may be long.

    Spark reads these settings when a job runs, which is after an operator has returned, so they hold for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder beside the warehouse
    is set in local mode; on a cluster it is an error, as a folder of one machine would split the data."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What ``materialise`` has written since the innermost ``tidied`` began.
_written: list[list[DataFrame]] = []


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage durably. ``keep``: ``tidied`` leaves it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _written and not keep:
        _written[-1].append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote and that nothing will read again."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidied() -> Iterator[None]:
    """Deletes at its end all tables that were materialised inside. What is to be read later is written before or after."""
    _written.append([])
    try:
        yield
    finally:
        discard(*_written.pop())


#: The parts that the rows of one key are dealt to where they meet what was aggregated over that key.
SALTS = 32


def salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def over_keys(rows: DataFrame, keys: Sequence[str], partial: Sequence[Column], final: Sequence[Column]) -> DataFrame:
    """Aggregates of ``rows`` (with a column _salt) over ``keys``, with the array _salts of the salts that a key's rows have.

    ``partial`` aggregates by key and salt and ``final`` these over the key, so no key's rows meet in one task. A join on keys
    and _salt, after ``F.explode("_salts")``, brings the result back to the rows, a hot key's in SALTS parts."""
    parts = rows.groupBy(*keys, "_salt").agg(*partial)
    return parts.groupBy(*keys).agg(*final, F.collect_list("_salt").alias("_salts"))


#: Bits of the filter that marks documents whose text is fetched; it takes 1 MB at most, whatever the corpus.
MARK_BITS = 1 << 23


def hits(rows: DataFrame, node: Column, nodes: DataFrame, name: str = "_hit") -> DataFrame:
    """``rows`` with a column that is false where ``node`` is surely none of the column node of ``nodes``.

    A bitmap of hashed nodes, of at most MARK_BITS bits, is broadcast. If it fills up, all rows are hits."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARK_BITS)) + 1
    maps = nodes.select(place(F.col("node")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    found = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(node)) == F.col("_bucket"), "left")
    at = F.bitmap_bit_position(place(node))
    byte = F.conv(F.hex(F.col("_bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1, F.lit(False)) & node.isNotNull()
    return found.withColumn(name, hit).drop("_bucket", "_bits")


def marked(docs: DataFrame, node: Column, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``node`` may be one of ``nodes``, so that most texts that nobody asks for aren't shuffled;
    which of them are is for a join to tell."""
    return hits(docs, node, nodes).where("_hit").drop("_hit")


def packed_rows(docs: DataFrame) -> Column:
    """A row of ``docs`` as a struct, so that further columns can stand beside it whatever its own are named."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(docs: DataFrame, row: str, **new: Column) -> list[Column]:
    """The columns of ``docs`` from the struct ``row``, some of them replaced."""
    return [new[c].alias(c) if c in new else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns]


#: Elements whose sums are run up at once in ``running``.
RUN_BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def running(counts: Column) -> Column:
    """The sums of what stands before each element of an array of integers, and at last the sum of all.

    Sums are run up in blocks and over the blocks, so that a long array isn't copied for each of its elements."""
    zero = F.array(F.lit(0).cast("long"))
    up = lambda xs: F.aggregate(xs, zero, lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(counts) / RUN_BLOCK).cast("int") - 1, F.lit(0)))
    blocks = F.transform(starts, lambda b: up(F.slice(counts, b * RUN_BLOCK + 1, F.lit(RUN_BLOCK))))
    totals = lambda found: up(F.transform(found, lambda sums: F.element_at(sums, -1)))
    moved = lambda found, before: F.flatten(F.transform(found, lambda sums, i: F.transform(F.slice(sums, F.lit(1), F.size(sums) - 1), lambda x: x + before[i])))
    return bound(blocks, lambda found: bound(totals(found), lambda before: F.concat(moved(found, before), F.array(F.element_at(before, -1)))))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns memory that a task has used to the system, which workers that wait for the next task would keep: Arrow's, and what
    the C library holds, where it can be asked to."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def runs(texts: Sequence[str], limit: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds (start, stop) of consecutive runs of texts, each of at least one text and about ``limit`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


#: DuckDB SQL: a table of one row with the 256 values of which CRC-32 is made.
CRC_SQL = "crcs AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) AS c FROM range(256) r(i)))"


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text of ASCII characters, where the table ``crcs`` is joined."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"
