"""Batches that are refused, versions behind a pointer, and ingestion that is stopped midway."""

import json
import os
import sqlite3
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from peerlens.sources import batches
from peerlens.sources.versions import RefusedError, Versions
from peerlens.streaming.ingest import Ingest, hourly

PLAYERS = "CREATE TABLE players (id INTEGER PRIMARY KEY, height INTEGER CONSTRAINT sane_height CHECK (height IS NULL OR height BETWEEN 140 AND 220), goals INTEGER NOT NULL CONSTRAINT no_negative CHECK (goals >= 0))"


def database(path):
    c = sqlite3.connect(path)
    for s in (PLAYERS, *batches.ledgers()):
        c.execute(s)
    c.commit()
    c.close()
    return lambda: sqlite3.connect(path, timeout=60, isolation_level=None)


def test_bad_rows_stand_alone_and_the_rest_is_written_once(spark, tmp_path):
    connect = database(str(tmp_path / "db"))
    bad = {17: (17, 1000, 0), 5005: (5005, 180, -1), 9999: (9999, 18, 3)}
    rows = spark.createDataFrame([bad.get(i, (i, 150 + i % 60, i % 5)) for i in range(10_000)], "id long, height int, goals int").repartition(3, "id")
    for _ in range(2):  # a load that is read again, as by a task that runs again, writes nothing more
        out = batches.load(rows, "players", connect, "first", batch=700).collect()
        assert sorted((json.loads(r["row_json"])["id"], r["reason"]) for r in out if r["reason"]) == [(17, "sane_height"), (5005, "no_negative"), (9999, "sane_height")]
        assert sum(r["n_rows"] or 0 for r in out) == 9997
        with connect() as c:
            assert c.execute("SELECT count(*), count(DISTINCT id), sum(id) FROM players").fetchone() == (9997, 9997, sum(i for i in range(10_000) if i not in bad))
            assert c.execute("SELECT count(*) FROM load_refused").fetchone() == (3,)


def test_faults_of_the_load_end_it(spark, tmp_path):
    connect = database(str(tmp_path / "db"))
    for rows in ([(1, 180, 1), (1, 181, 1)], [(2, 180, None)]):
        with pytest.raises(Exception, match="constraint failed"):
            batches.load(spark.createDataFrame(rows, "id long, height int, goals int").coalesce(1), "players", connect, "x").collect()
    with connect() as c:
        assert c.execute("SELECT count(*) FROM players").fetchone() == (0,) and c.execute("SELECT count(*) FROM load_done").fetchone() == (0,)
    assert [r["n_rows"] for r in batches.load(spark.createDataFrame([], "id long, height int, goals int").coalesce(1), "players", connect, "none").collect()] in ([0], [])


def test_halving_takes_few_statements():
    seen = []

    def insert(rows):
        seen.append(len(rows))
        if any(r[0] < 0 for r in rows):
            raise ValueError("CHECK constraint failed: sign")

    rows = [(i,) for i in range(1024)]
    rows[300] = (-1,)
    assert list(batches.halves(rows, insert, batches.check_violation)) == [((-1,), "sign")]
    assert len(seen) == 21 and sum(n for n in seen) < 3 * 1024


def test_promotion_is_seen_as_a_whole_and_refusals_leave_what_is_served(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "table"))
    df = lambda n, mark: spark.range(n).withColumn("mark", F.lit(mark))
    assert versions.served() is None and versions.history() == []
    with pytest.raises(RefusedError):
        versions.promote(df(0, "empty"))
    assert versions.promote(df(100, "a"), "v1") == "v1"
    seen, stop = set(), threading.Event()

    def read():
        while not stop.is_set():
            seen.add(tuple(map(tuple, versions.served().groupBy("mark").count().collect())))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        versions.promote(df(200, "b"), "v2")
        with pytest.raises(RefusedError):
            versions.promote(df(100, "c"), "v3")
        assert versions.history() == ["v2", "v1"]
        assert versions.promote(df(5, "never written"), "v2") == "v2"
        versions.promote(df(100, "d"), "v4", force=True)
    finally:
        stop.set()
        reader.join()
    assert seen and seen <= {(("a", 100),), (("b", 200),), (("d", 100),)}
    assert versions.served().first()["mark"] == "d" and versions.rollback() == "v2" and versions.served().count() == 200
    assert versions.rollback("v1") == "v1" and versions.served().first()["mark"] == "a"
    for bad in (lambda: versions.rollback(), lambda: versions.rollback("v9"), lambda: versions.promote(df(1, "x"), "../x")):
        with pytest.raises(ValueError):
            bad()
    assert versions.prune(1) == ["v2", "v4"] and versions.served().count() == 100
    assert not [p.name for p in (tmp_path / "table").iterdir() if p.name.startswith(".CURRENT-")]


def test_a_run_that_dies_before_the_rename_leaves_what_is_served(spark, tmp_path, monkeypatch):
    versions = Versions(spark, str(tmp_path / "t"))
    versions.promote(spark.range(10), "v1")
    with monkeypatch.context() as m:
        m.setattr(Versions, "_point", lambda self, names: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            versions.promote(spark.range(20), "v2")
    assert versions.served().count() == 10
    assert versions.promote(spark.range(30), "v2") == "v2" and versions.served().count() == 30


RECORDS = "id long, at timestamp, text string"


def records(spark, path):
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).json(str(path))


def put(path, name, rows):
    """A file whose time follows from its name, as files are taken in the order of their times."""
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps({"id": i, "at": f"2024-01-{d:02d}T00:00:00", "text": t}) + "\n" for i, d, t in rows))
    os.utime(path / name, (1_700_000_000 + int(name[0]),) * 2)


def test_ingestion_that_dies_midway_finds_each_record_once(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for f in range(4):
        put(source, f"{f}.json", [(10 * f + k, 1 + f, "x") for k in range(5)] + ([(10 * f - 10, 1 + f, "again")] if f else []))
    wanted = spark.createDataFrame([(i,) for i in (0, 1, 10, 30, 99)], "id long")

    def dies(number):
        if number == 2:
            raise RuntimeError("lost in batch 2")

    first = Ingest(spark, target, "id", "at", after_rows=dies)
    assert first.rows() is None and first.accounting(wanted).first()["pending"] == 5
    with pytest.raises(Exception, match="lost in batch 2"):
        first.run(records(spark, source))
    half = Ingest(spark, target, "id", "at")
    got = half.accounting(wanted).first()
    assert (got["wanted"], got["done"], got["pending"], got["complete"]) == (5, 3, 2, False)
    assert sorted(r["id"] for r in half.pending(wanted).collect()) == [30, 99]
    assert half.run(records(spark, source))
    want = sorted(10 * f + k for f in range(4) for k in range(5))
    assert sorted(r["id"] for r in half.rows().collect()) == want and half.rows().where("text = 'again'").count() == 0
    put(source, "9.json", [(0, 20, "late repeat, long after"), (99, 20, "x")])
    assert half.run(records(spark, source))
    got = half.accounting(wanted).first()
    assert (got["done"], got["pending"], got["unasked"], got["complete"]) == (5, 0, 16, True)


def test_ingestion_stops_at_its_deadline_and_goes_on(spark, tmp_path):
    import time

    source, target = tmp_path / "in", str(tmp_path / "out")
    for f in range(5):
        put(source, f"{f}.json", [(f, 1, "x")])
    slow = Ingest(spark, target, "id", "at", after_rows=lambda n: time.sleep(2) if n else None)
    assert not slow.run(records(spark, source), seconds=6)
    rest = Ingest(spark, target, "id", "at")
    assert rest.run(records(spark, source), seconds=600)
    assert sorted(r["id"] for r in rest.rows().collect()) == list(range(5))


def test_hourly_counts_of_a_stream_leave_late_rows_out(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    schema = "ts timestamp, event_type string, value double"
    line = lambda h, m, v: json.dumps({"ts": f"2024-01-01T{h:02d}:{m:02d}:00", "event_type": "a", "value": v}) + "\n"
    out, made = [], hourly(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)), "2 hours")
    keep = lambda df, _: out.extend((r["hour"], r["n"], r["total"]) for r in df.collect())
    run = lambda: made.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    for name, lines in (("0", line(1, 0, 1) + line(1, 59, 2)), ("1", line(2, 30, 5)), ("2", line(5, 0, 7)), ("3", line(1, 30, 100) + line(4, 0, 9)), ("4", line(9, 0, 1))):
        (source / f"{name}.json").write_text(lines)
        run()
    hour = lambda h: datetime(2024, 1, 1, h)
    assert sorted(out) == [(hour(1), 2, 3.0), (hour(2), 1, 5.0), (hour(4), 1, 9.0), (hour(5), 1, 7.0)]
    whole = spark.read.schema(schema).json(str(source))
    assert hourly(whole).where(F.col("hour") == F.lit("2024-01-01 01:00:00").cast("timestamp")).first()["n"] == 3
