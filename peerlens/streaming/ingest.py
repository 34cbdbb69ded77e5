"""Resumable ingestion: a stream that takes what is there and stops; its checkpoint remembers what was done."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Appends new JSON-lines files of ``source`` to the Parquet table ``target`` and ends."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Ingest:
    """Records of a stream, each once, into ``folder``, which holds the rows, a ledger of the ids that are done, and the checkpoint.

    Of the records with one ``key`` the first to come is kept; later ones within ``late`` of the newest ``at`` are repeats, which
    the stream's state knows, so the state stays as large as that span. Each micro-batch writes the folder of its own number,
    replacing what an attempt that died left there: a batch that runs again leaves the same rows. A run ends when nothing new is
    left or at its deadline; the next one goes on from the checkpoint."""

    spark: SparkSession
    folder: str
    key: str
    at: str
    late: str = "2 days"
    #: Called with the number of each batch once its rows are written and before its ids are.
    after_rows: Callable[[int], None] | None = None

    def _rows(self) -> str:
        return f"{self.folder.rstrip('/')}/rows"

    def _done(self) -> str:
        return f"{self.folder.rstrip('/')}/done"

    def _sink(self, batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.write.mode("overwrite").parquet(f"{self._rows()}/batch={number}")
            if self.after_rows:
                self.after_rows(number)
            held.select(self.key).distinct().write.mode("overwrite").parquet(f"{self._done()}/batch={number}")
        finally:
            held.unpersist()

    def start(self, records: DataFrame) -> StreamingQuery:
        once = records.withWatermark(self.at, self.late).dropDuplicatesWithinWatermark([self.key])
        return once.writeStream.foreachBatch(self._sink).option("checkpointLocation", f"{self.folder.rstrip('/')}/checkpoint").trigger(availableNow=True).start()

    def run(self, records: DataFrame, seconds: float | None = None) -> bool:
        """Takes what is there; False if the deadline of ``seconds`` came first. A batch that is stopped in the middle runs again
        the next time. Raises what the stream raised."""
        query, began = self.start(records), time.monotonic()
        while query.isActive:
            left = None if seconds is None else seconds - (time.monotonic() - began)
            if left is not None and left <= 0:
                query.stop()
                return False
            query.awaitTermination(1 if left is None else max(0.05, min(1.0, left)))
        query.awaitTermination()
        return True

    def _read(self, path: str, schema: str | None = None) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at) or not any(fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")) for x in fs.listStatus(at)):
            return None
        return self.spark.read.parquet(path)

    def rows(self) -> DataFrame | None:
        """What was written so far, without the number of its batch; None before the first batch."""
        df = self._read(self._rows())
        return None if df is None else df.drop("batch")

    def accounting(self, wanted: DataFrame) -> DataFrame:
        """One row (wanted, done, pending, unasked, complete): how many of the ids in ``wanted`` are done, how many are not, and how
        many are done that nobody asked for."""
        done = self._read(self._done())
        ids = wanted.select(self.key).distinct().withColumn("_wanted", F.lit(True))
        if done is None:
            both = ids.withColumn("_done", F.lit(None).cast("boolean"))
        else:
            both = ids.join(done.select(self.key).distinct().withColumn("_done", F.lit(True)), self.key, "full")
        sums = both.agg(F.count("_wanted").alias("wanted"), F.count_if(F.col("_wanted") & F.col("_done")).alias("done"), F.count_if(F.col("_wanted") & F.col("_done").isNull()).alias("pending"), F.count_if(F.col("_wanted").isNull()).alias("unasked"))
        return sums.withColumn("complete", F.col("pending") == 0)

    def pending(self, wanted: DataFrame) -> DataFrame:
        """The ids of ``wanted`` that aren't done, for the next run to ask for."""
        ids, done = wanted.select(self.key).distinct(), self._read(self._done())
        return ids if done is None else ids.join(done.select(self.key).distinct(), self.key, "left_anti")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums by hour and type, for streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
