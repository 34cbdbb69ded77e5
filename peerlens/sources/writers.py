"""Sinks: guarded CSV text, quarantine, and publication by a pointer once a guard agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quality import publishable


def cell(df: DataFrame, name: str) -> Column:
    """A value as CSV text: doubles with one decimal, ISO dates, null as empty, and no text that a sheet would run."""
    kind = dict(df.dtypes)[name]
    v = F.col(name)
    text = F.format_string("%.1f", v) if kind in ("double", "float") else v.cast("string")
    text = F.when(v.isNotNull(), text).otherwise("")
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text) if kind == "string" else text


def csv_lines(df: DataFrame) -> DataFrame:
    """One column, line: every field quoted, quotes doubled."""
    return df.select(F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(cell(df, c), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]).alias("line"))


#: What tells spreadsheets that a file is UTF-8.
BYTE_ORDER_MARK = "\ufeff"


def csv_document(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(place, line): the lines of a whole file, a head after a byte order mark and then the rows by ``order``. Lines are numbered by
    a sort of the rows, as a file that a person opens has one order; it is meant for what a person reads."""
    head = df.sparkSession.createDataFrame([(0, BYTE_ORDER_MARK + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns))], "place long, line string")
    line = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(cell(df, c), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns])
    rows = df.select(F.row_number().over(Window.orderBy(*[F.asc_nulls_first(c) for c in order])).cast("long").alias("place"), line.alias("line"))
    return head.union(rows)


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*[cell(df, c).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).option("quoteAll", True).option("lineSep", "\r\n").csv(path)


def write_split(marked: DataFrame, good: str, bad: str) -> None:
    """Rows marked by ``quality.split``: what no rule refuses to ``good``, the rest with its reasons to ``bad``."""
    marked.where(F.size("refused") == 0).drop("refused").write.mode("append").parquet(good)
    marked.where(F.size("refused") > 0).write.mode("append").parquet(bad)


def publish(candidate: DataFrame, served: DataFrame, path: str) -> bool:
    """Writes the candidate as a new version if the guard agrees; readers take the version their caller points at."""
    if not publishable(candidate, served).first()["publish"]:
        return False
    candidate.write.mode("errorifexists").parquet(path)
    return True
