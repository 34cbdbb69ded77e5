"""Profiles of nested records: every leaf's path with its types, how often it is known, its range and an example.

A record is a VARIANT, so records of any shape are profiled without a schema. Objects are walked to their leaves, which get dotted
paths; a list is a leaf whose value is a marker of its length, as its shape matters and not what it holds. Each task counts by
path and type before anything is shuffled, so as many rows move as there are paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objects within objects that are walked; an object deeper down is a leaf of the type ``object``.
DEPTH = 12
EXAMPLE_CHARS = 60
#: What a schema of a VARIANT begins with, and the type that a profile names.
KINDS = (("VOID", "null"), ("BOOLEAN", "bool"), ("BIGINT", "int"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("FLOAT", "float"), ("OBJECT", "object"), ("STRING", "str"))


def records_of(payload: Column) -> Column:
    """The records that a VARIANT holds, as an array: its own elements, those under ``data``, or itself. What isn't an object is left out."""
    as_list = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    inner = F.when(_members(F.try_variant_get(payload, "$.data", "variant")).isNotNull(), F.array(F.try_variant_get(payload, "$.data", "variant")))
    found = F.coalesce(as_list(payload, "$"), as_list(payload, "$.data"), inner, F.array(payload))
    return F.filter(found, lambda r: _members(r).isNotNull())


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _leaf(path: Column, kind: Column, text: Column, number: Column) -> Column:
    return F.struct(path.alias("path"), kind.alias("kind"), text.alias("text"), number.alias("number"))


def leaves(value: Column, path: Column | None = None, depth: int = DEPTH) -> Column:
    """An array of (path, kind, text, number) of the leaves below an object; number is null for what is no number."""
    schema = F.schema_of_variant(value)
    kind = F.lit("other")
    for start, name in reversed(KINDS):
        kind = F.when(schema.startswith(start), name).otherwise(kind)
    items = F.try_variant_get(value, "$", "array<variant>")
    number = F.when(kind.isin("int", "float"), F.try_variant_get(value, "$", "double"))
    scalar = _leaf(path if path is not None else F.lit(""), kind, F.when(kind != "null", F.try_variant_get(value, "$", "string")), number)
    marker = _leaf(path if path is not None else F.lit(""), F.lit("list"), F.concat(F.lit("["), F.size(items).cast("string"), F.lit(" items]")), F.lit(None).cast("double"))
    own = F.array(F.when(items.isNotNull(), marker).otherwise(scalar))
    if not depth:
        return own

    def below(entry: Column) -> Column:
        inner = entry["key"] if path is None else F.concat(path, F.lit("."), entry["key"])
        return leaves(entry["value"], inner, depth - 1)

    inside = F.flatten(F.transform(F.map_entries(_members(value)), below))
    return inside if path is None else F.coalesce(inside, own)


def nested_profile(records: DataFrame, record: str, key: str, depth: int = DEPTH) -> DataFrame:
    """(path, kinds, seen, known, null_share, least, most, example) of all leaves of the VARIANTs in ``record``.

    ``kinds`` are the types seen, sorted and joined by ``|`` (null only if nothing else was seen); least and most are those of the
    numbers; the example is the text of the row of the least ``key`` that has one, cut to EXAMPLE_CHARS."""
    rows = records.select(F.col(key).alias("_key"), F.explode(leaves(F.col(record), None, depth)).alias("_l")).select("_key", "_l.*")
    known = F.col("kind") != "null"
    shown = known & (F.col("text") != "")
    by_kind = rows.groupBy("path", "kind").agg(
        F.count("*").alias("_n"), F.min("number").alias("_low"), F.max("number").alias("_high"),
        F.min(F.when(shown, F.struct("_key", F.substring("text", 1, EXAMPLE_CHARS).alias("text")))).alias("_first"),
    )
    kinds = F.array_join(F.sort_array(F.collect_list(F.when(known, F.col("kind")))), "|")
    seen, held = F.sum("_n"), F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0))
    return by_kind.groupBy("path").agg(
        F.coalesce(F.nullif(kinds, F.lit("")), F.lit("null")).alias("kinds"), seen.alias("seen"), held.alias("known"), ((seen - held) / seen).alias("null_share"),
        F.min("_low").alias("least"), F.max("_high").alias("most"), F.min("_first")["text"].alias("example"),
    )
