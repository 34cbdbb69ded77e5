import json

from pyspark.sql import functions as F

from peerlens.operators import quality
from peerlens.sources import readers, writers
from peerlens.streaming.ingest import ingest


def test_csv_unknowns_and_guard(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,height\n1,Missing,180\n2,=cmd,17\n3,,\n")
    df = readers.read("csv", spark, str(tmp_path / "a.csv"), "id long, name string, height int")
    assert [r["name"] for r in df.orderBy("id").collect()] == [None, "=cmd", None]
    kept, bad = readers.ranged(df, "height", 140, 220)
    assert [r["height"] for r in kept.orderBy("id").collect()] == [180, None, None] and bad.count() == 1
    lines = [r["line"] for r in writers.csv_lines(df.where("id < 3")).collect()]
    assert lines == ['"1","","180"', '"2","\'=cmd","17"']
    writers.write_csv(df, str(tmp_path / "out"))


def test_snapshot_paths_and_casts(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"kind": "roster"}) + "\n" + json.dumps({"kind": "player", "player_id": 5, "detailed": {"goals": "3", "xg": "x"}}) + "\n")
    df = readers.snapshot(spark, str(tmp_path / "s.jsonl"), "kind string, player_id long, detailed struct<goals: string, xg: string>")
    row = readers.mapped(df, {"id": "player_id", "goals": "detailed.goals", "xg": "detailed.xg"}, {"goals": "int", "xg": "double"}).first()
    assert (row["id"], row["goals"], row["xg"]) == ("5", 3, None)


def test_quarantine_and_publication(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id long, m long")
    marked = quality.split(df, [("negative", F.col("m") < 0)])
    writers.write_split(marked, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).first()["refused"] == ["negative"]
    assert writers.publish(df, df, str(tmp_path / "v1")) and not writers.publish(df.limit(1), df, str(tmp_path / "v2"))


def test_ingestion_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest(spark, str(tmp_path / "in"), "id long", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"id": i}))
        run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 1]
