"""Tables that one query reads more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in spark.checkpoint.dir.

    Where that is unset, a folder beside the warehouse serves in local mode; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder and read back, so that it is worked out once and survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: More partitions than a table has.
MANY = 1 << 20


def apart(df: DataFrame) -> DataFrame:
    """``df`` as it is, with the code that Spark generates for it apart from that of what follows, as the JVM compiles no method of
    8,000 bytes. ``coalesce`` generates none, and to more partitions than there are it moves nothing."""
    return df.coalesce(MANY)
