"""A data source over folders of snapshots: ``spark.read.format("snapshot_folder")`` and ``spark.readStream`` likewise.

A table is a folder of CSV files (with a header) or of JSON lines, plain or gzipped, in folders named ``key=value`` or not. Each
file is one partition of the read. Comparisons with constants are pushed to the reader: those on a folder's key leave whole files
out, the others leave rows out before they reach Spark, and both are shown by the plan as pushed filters. As a stream, a read takes
the files that have come since the last one, by time and name.

Values are read as text and cast safely: what doesn't parse is null, as are the strings that stand for an unknown value. JSON
records may be nested: the option ``paths`` maps columns to dotted paths, and a number in a date column counts seconds since 1970.
A line that holds its records under ``data``, alone or as a list, is taken apart.

Files are opened by pyarrow's file systems, so a folder may be local to all machines or in a store that they reach.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "snapshot_folder"
#: Strings that stand for an unknown value.
UNKNOWN = ("", "Missing")
#: JSON records, or bytes of CSV, that a reader holds at a time. A row of CSV must fit in those.
BATCH = 8192
BLOCK_BYTES = 8 << 20
#: Patterns of text that parses; others are null.
WHOLE, NUMBER, DAY = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"^\d{4}-\d{2}-\d{2}"
COMPARISONS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class File(InputPartition):
    """A file with the values of the folders that it lies in, and when it was last changed."""

    path: str
    keys: tuple[tuple[str, str | None], ...]
    at: int

    def order(self) -> str:
        return f"{self.at:020d} {self.path}"


def files_of(folder: str) -> list[File]:
    """The data files below a folder in the order of their times; names that begin with ``_`` or ``.`` are no data."""
    fs, base = file_system(folder)
    if fs.get_file_info(base).type == pyarrow.fs.FileType.NotFound:
        raise ValueError(f"no folder {folder}")
    found = []
    for info in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)):
        inner = info.path[len(base) :].strip("/").split("/")
        if info.type != pyarrow.fs.FileType.File or any(x.startswith(("_", ".")) for x in inner):
            continue
        keys = tuple((k, None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)) for k, sep, v in (x.partition("=") for x in inner[:-1]) if sep)
        found.append(File(info.path, keys, info.mtime_ns or 0))
    return sorted(found, key=File.order)


def cast(values: pa.Array, kind: pa.DataType) -> pa.Array:
    """Text as ``kind``: null where it is unknown or doesn't parse."""
    values = pc.if_else(pc.is_in(values, pa.array(UNKNOWN, values.type)), None, values)
    fitting = lambda pattern: pc.if_else(pc.match_substring_regex(values, pattern), pc.ascii_trim_whitespace(values), None)
    if pa.types.is_integer(kind):
        whole = pc.cast(pc.replace_substring_regex(fitting(WHOLE), r"^\+", ""), pa.int64())
        low, high = -(1 << kind.bit_width - 1), (1 << kind.bit_width - 1) - 1
        return pc.cast(pc.if_else(pc.and_(pc.greater_equal(whole, low), pc.less_equal(whole, high)), whole, None), kind)
    if pa.types.is_floating(kind):
        return pc.cast(pc.replace_substring_regex(fitting(NUMBER), r"^\+", ""), kind)
    if pa.types.is_date(kind) or pa.types.is_timestamp(kind):
        days = pc.strptime(pc.utf8_slice_codeunits(fitting(DAY), 0, 10), format="%Y-%m-%d", unit="s", error_is_null=True)
        real = pc.equal(pc.strftime(days, format="%Y-%m-%d"), pc.utf8_slice_codeunits(values, 0, 10))  # not the 30th of February
        return pc.cast(pc.if_else(real, days, None), kind)
    if pa.types.is_boolean(kind):
        low = pc.utf8_lower(values)
        return pc.if_else(pc.is_in(low, pa.array(["true", "1", "yes"], low.type)), True, pc.if_else(pc.is_in(low, pa.array(["false", "0", "no"], low.type)), False, None))
    return pc.cast(values, kind)


def dig(record: Any, path: str) -> Any:
    """The value at a dotted path, or None."""
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def records_of(line: Any) -> list[dict]:
    """The records of a parsed line: itself, or what it holds under ``data``."""
    data = line.get("data", line) if isinstance(line, dict) else line
    return [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]


def as_text(value: Any, kind: pa.DataType) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        if pa.types.is_date(kind):
            return datetime.fromtimestamp(value, UTC).strftime("%Y-%m-%d")
        return str(int(value)) if pa.types.is_integer(kind) and value == int(value) else repr(value)
    return json.dumps(value, sort_keys=True)


def text_batches(file: File, columns: Sequence[str], schema: pa.Schema, paths: dict[str, str], only_kind: str | None) -> Iterator[dict[str, pa.Array]]:
    """The file's rows as text, some thousands at a time; columns that it lacks are absent."""
    fs, path = file_system(file.path)
    name = path.removesuffix(".gz")
    with fs.open_input_stream(path, compression=None) as raw:
        stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        if name.endswith((".json", ".jsonl")):
            rows: dict[str, list] = {c: [] for c in columns}
            for line in io.TextIOWrapper(stream, "utf-8"):
                parsed = json.loads(line) if line.strip() else None
                if parsed is None or only_kind and (not isinstance(parsed, dict) or parsed.get("kind") != only_kind):
                    continue
                for record in records_of(parsed):
                    for c in columns:
                        rows[c].append(as_text(dig(record, paths.get(c, c)), schema.field(c).type))
                if len(rows[columns[0]]) >= BATCH:
                    yield {c: pa.array(v, pa.string()) for c, v in rows.items()}
                    rows = {c: [] for c in columns}
            if rows[columns[0]]:
                yield {c: pa.array(v, pa.string()) for c, v in rows.items()}
        else:
            named = [paths.get(c, c) for c in columns]
            as_read = pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(named, pa.string()), include_columns=named, include_missing_columns=True, null_values=[])
            try:
                reader = pyarrow.csv.open_csv(stream, pyarrow.csv.ReadOptions(block_size=BLOCK_BYTES), pyarrow.csv.ParseOptions(newlines_in_values=True), as_read)
            except pa.ArrowInvalid as e:
                if "Empty CSV file" in str(e):
                    return
                raise
            for batch in reader:  # not sliced: if_else of pyarrow 23 gives wrong offsets for slices of text
                yield {c: batch.column(i) for i, c in enumerate(columns)}


class Reading:
    """What a batch and a stream read share: the schema, the options and the rows of a file."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("a snapshot folder needs a path")
        self.path, self.kind = options["path"], options.get("kind")
        self.paths = json.loads(options.get("paths", "{}"))
        self.arrow = to_arrow_schema(schema)
        self.filters: list[Filter] = []

    def takes(self, f: Filter) -> bool:
        """Whether a filter is one that rows can be tested by: a comparison of a column with a constant that isn't null."""
        if isinstance(f, (IsNull, IsNotNull)):
            return len(f.attribute) == 1
        if isinstance(f, In):
            return len(f.attribute) == 1 and all(v is not None for v in f.value)
        return type(f) in COMPARISONS and len(f.attribute) == 1 and f.value is not None

    def passes(self, f: Filter, values: pa.Array) -> pa.Array:
        if isinstance(f, IsNull):
            return pc.is_null(values)
        if isinstance(f, IsNotNull):
            return pc.is_valid(values)
        if isinstance(f, In):
            return pc.and_(pc.is_valid(values), pc.is_in(values, pa.array(list(f.value), values.type)))
        return pc.fill_null(COMPARISONS[type(f)](values, pa.scalar(f.value, values.type)), False)

    def keyed(self, file: File, name: str, n: int) -> pa.Array:
        value = dict(file.keys)[name]
        return cast(pa.array([value] * n, pa.string()), self.arrow.field(name).type)

    def wanted(self, file: File) -> bool:
        """Whether the file's folders pass all filters on their keys."""
        keys = dict(file.keys)
        return all(self.passes(f, self.keyed(file, f.attribute[0], 1))[0].as_py() for f in self.filters if f.attribute[0] in keys)

    def rows(self, file: File) -> Iterator[pa.RecordBatch]:
        names = self.arrow.names
        own = [c for c in names if c not in dict(file.keys)]
        for found in text_batches(file, own or names[:1], self.arrow, self.paths, self.kind):
            n = len(next(iter(found.values())))
            made = {c: cast(found[c], self.arrow.field(c).type) if c in own else self.keyed(file, c, n) for c in names}
            keep = None
            for f in self.filters:
                one = self.passes(f, made[f.attribute[0]])
                keep = one if keep is None else pc.and_(keep, one)
            batch = pa.RecordBatch.from_arrays([made[c] for c in names], schema=self.arrow)
            batch = batch if keep is None else batch.filter(keep)
            if batch.num_rows:
                yield batch


class FolderReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.reading = Reading(schema, options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualNullSafe) and f.value is not None:
                f = EqualTo(f.attribute, f.value)  # noqa: PLW2901
            if self.reading.takes(f):
                self.reading.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[File]:
        return [x for x in files_of(self.reading.path) if self.reading.wanted(x)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, File):  # a read without files asks for one partition that is none
            yield from self.reading.rows(partition)


class FolderStreamReader(DataSourceStreamReader):
    """Offsets name the last file taken, by time and name, so they stay small. Files come into the folder whole, by a rename."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.reading = Reading(schema, options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max((x.order() for x in files_of(self.reading.path)), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[File]:
        return [x for x in files_of(self.reading.path) if start["after"] < x.order() <= end["after"]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, File):
            yield from self.reading.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to give back: files stay."""


class SnapshotFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("a snapshot folder is read under a stated schema, as types aren't guessed")

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> FolderStreamReader:  # noqa: N802
        return FolderStreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark push filters to sources that are written in Python."""
    spark.dataSource.register(SnapshotFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
