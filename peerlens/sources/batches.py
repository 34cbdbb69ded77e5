"""Loading into a database by batches, of which a refused one is halved until the rows that it was refused for stand alone.

Each task writes its partition in one transaction. A batch is one statement behind a savepoint; if the database refuses a value in
it, the batch is rolled back and each half is tried again, down to the single row, which is set aside with the name of the
constraint. Other errors (a missing reference, a row that is there twice) are faults of the load and end it: to set such rows
aside would turn a defect into a smaller load.

What was set aside and that the partition is done are written in the same transaction. A task that runs again after its
executor was lost finds its partition done and tells what it had set aside, so rows are written once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BATCH = 5000
DONE, REFUSED = "load_done", "load_refused"


def check_violation(error: Exception) -> str | None:
    """The constraint that refused a value, as sqlite3 tells it; None for any other error."""
    text = str(error)
    return text.partition("CHECK constraint failed: ")[2] or None if "CHECK constraint failed" in text else None


def halves(rows: Sequence[tuple], insert: Callable[[Sequence[tuple]], None], refused: Callable[[Exception], str | None]) -> Iterator[tuple[tuple, str]]:
    """Inserts ``rows``; yields those that are refused alone, with the reason. ``insert`` takes all rows or none."""
    waiting = [rows]
    while waiting:
        batch = waiting.pop()
        try:
            insert(batch)
        except Exception as error:
            reason = refused(error)
            if reason is None:
                raise
            if len(batch) == 1:
                yield batch[0], reason
            else:
                middle = len(batch) // 2
                waiting += [batch[middle:], batch[:middle]]


def ledgers() -> list[str]:
    """The statements that make the tables of loads that are done and of rows that were set aside."""
    return [
        f"CREATE TABLE IF NOT EXISTS {DONE} (load_id TEXT NOT NULL, part INTEGER NOT NULL, n_rows INTEGER NOT NULL, PRIMARY KEY (load_id, part))",
        f"CREATE TABLE IF NOT EXISTS {REFUSED} (load_id TEXT NOT NULL, part INTEGER NOT NULL, place INTEGER NOT NULL, row_json TEXT NOT NULL, reason TEXT NOT NULL)",
    ]


def load(rows: DataFrame, table: str, connect: Callable[[], Any], load_id: str, batch: int = BATCH, mark: str = "?", refused: Callable[[Exception], str | None] = check_violation) -> DataFrame:
    """Writes ``rows`` to ``table`` and gives (part, n_rows, row_json, reason): a row for each that was set aside, and one without
    a reason for each partition, with the number of rows that it wrote.

    ``connect`` opens a connection as of Python's database interface, in each task, without a transaction of its own; ``load_id``
    names the load; ``mark`` is the database's placeholder. The tables of ``ledgers`` are made beforehand. The load runs when
    the result is read, and reading it again writes nothing more."""
    names = rows.columns
    into = f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join([mark] * len(names))})"
    schema = "part int, n_rows long, row_json string, reason string"
    arrow = pa.schema([("part", pa.int32()), ("n_rows", pa.int64()), ("row_json", pa.string()), ("reason", pa.string())])

    def told(part: int, n_rows: int, aside: Sequence[tuple[str, str]]) -> pa.RecordBatch:
        every = [(part, n_rows, None, None), *[(part, None, text, reason) for text, reason in aside]]
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in every], schema=arrow)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, connection = context.partitionId() if context else 0, connect()
        try:
            cursor = connection.cursor()
            cursor.execute("BEGIN IMMEDIATE" if mark == "?" else "BEGIN")
            cursor.execute(f"SELECT n_rows FROM {DONE} WHERE load_id = {mark} AND part = {mark}", (load_id, part))
            if before := cursor.fetchone():
                cursor.execute(f"SELECT row_json, reason FROM {REFUSED} WHERE load_id = {mark} AND part = {mark} ORDER BY place", (load_id, part))
                yield told(part, before[0], cursor.fetchall())
                return

            def insert(some: Sequence[tuple]) -> None:
                cursor.execute("SAVEPOINT batch")
                try:
                    cursor.executemany(into, some)
                except Exception:
                    cursor.execute("ROLLBACK TO batch")
                    raise
                finally:
                    cursor.execute("RELEASE batch")

            n, aside = 0, []
            for found in batches:
                for start in range(0, found.num_rows, batch):
                    some = [tuple(r.values()) for r in found.slice(start, batch).to_pylist()]
                    bad = [(json.dumps(dict(zip(names, r, strict=True)), default=str), why) for r, why in halves(some, insert, refused)]
                    n, aside = n + len(some) - len(bad), aside + bad
            cursor.executemany(f"INSERT INTO {REFUSED} VALUES ({', '.join([mark] * 5)})", [(load_id, part, i, *x) for i, x in enumerate(aside)])
            cursor.execute(f"INSERT INTO {DONE} VALUES ({', '.join([mark] * 3)})", (load_id, part, n))
            cursor.execute("COMMIT")
            yield told(part, n, aside)
        finally:
            connection.close()  # what wasn't committed is rolled back

    return rows.mapInArrow(write, schema)
