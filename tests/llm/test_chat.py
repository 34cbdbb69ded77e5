"""Chat formatting: layouts, escapes and masks against Python, and awkward rows."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from peerlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def canonical(spark, records, **more):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, raw string").select("id", F.parse_json("raw").alias("record"))
    return [chat_row for chat_row in chat.canonical(df, **more).orderBy("id").collect()]


RECORDS = [
    ({"messages": [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Ho"}], "id": 7}, "messages", [("user", "Hi"), ("assistant", "Ho")]),
    ({"messages": [{"content": "x", "role": "tool", "name": "n"}, {"role": "user", "content": None}]}, "messages", [("tool", "x"), ("user", "")]),
    ({"messages": []}, "messages", []),
    ({"messages": None, "score": {"a": [1]}}, "messages", []),
    ({"conversations": [{"from": "system", "value": "S"}, {"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]}, "turns_from_value", [("system", "S"), ("user", "Q"), ("assistant", "A")]),
    ({"prompt": "P", "response": "R"}, "prompt_response", [("user", "P"), ("assistant", "R")]),
    ({"prompt": "P", "response": "R", "system_prompt": "S"}, "prompt_response", [("system", "S"), ("user", "P"), ("assistant", "R")]),
    ({"prompt": "P", "completion": None}, "prompt_completion", [("user", "P"), ("assistant", "")]),
    ({"question": "Q", "answer": "A", "context": "C"}, "question_answer", [("user", "C\n\nQ"), ("assistant", "A")]),
    ({"question": 12, "answer": True}, "question_answer", [("user", "12"), ("assistant", "true")]),
    ({"instruction": "I", "input": "", "output": "O"}, "instruction", [("user", "I"), ("assistant", "O")]),
    ({"instruction": "I", "input": "N", "output": "O", "history": [["a", "b"], ["c", "d"]], "system": "S"}, "instruction", [("system", "S"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "I\n\nN"), ("assistant", "O")]),
    ({"prompt": [{"role": "user", "content": "x"}], "completion": "y"}, None, None),
    ({"prompt": "only"}, None, None),
    ([1, 2], None, None),
    ("text", None, None),
    ({}, None, None),
    (None, None, None),
]


def test_layouts(spark):
    got = canonical(spark, [r for r, _, _ in RECORDS])
    for r, (record, layout, turns) in zip(got, RECORDS, strict=True):
        assert r["layout"] == layout, record
        assert (None if r["turns"] is None else [tuple(t) for t in r["turns"]]) == turns, record
        assert r["fingerprint"] == chat.fingerprint_of(r["paths"])
    none = spark.createDataFrame([], "id long, raw string").select(F.parse_json("raw").alias("record"))
    assert chat.formatted(none).count() == 0


def test_new_layouts_are_declarations(spark):
    extra = chat.Layout("dialogue", (chat.Messages("data.dialog", "who", "said", {"A": "user", "B": "assistant"}),))
    record = {"data": {"dialog": [{"who": "A", "said": "1"}, {"who": "B", "said": "2"}]}}
    assert canonical(spark, [record])[0]["layout"] is None
    with pytest.raises(ValueError):
        chat.declared([extra, chat.Layout("again", extra.parts)])
    paths = chat.Layout("dialogue", (chat.Messages("dialog", "who", "said", {"A": "user", "B": "assistant"}),))
    got = canonical(spark, [record["data"]], layouts=[*chat.LAYOUTS, paths])[0]
    assert (got["layout"], [tuple(t) for t in got["turns"]]) == ("dialogue", [("user", "1"), ("assistant", "2")])


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["<", "\\", "|", "im_start|>", "a", "\n", "<|", "<|im_end|>", "%", "$1", "\U0001f600"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e")))
    for r in rows.collect():
        assert "<|" not in r["e"] and r["back"] == r["t"]
    pairs = [(a, b) for a, b in zip(texts, reversed(texts), strict=True)]
    turns = spark.createDataFrame([([{"role": a, "text": b}, {"role": "assistant", "text": a + "<"}, {"role": b, "text": ""}],) for a, b in pairs], "turns array<struct<role: string, text: string>>")
    out = turns.select("turns", chat.render(F.col("turns")).alias("o")).select("turns", chat.parsed(F.col("o.formatted")).alias("back"), chat.under_loss(F.col("o.formatted"), F.col("o.loss")).alias("learnt"))
    for r in out.collect():
        assert r["back"] == r["turns"]
        assert r["learnt"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")


def by_hand(turns):
    texts = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(texts), sha(texts)


def test_query_on_awkward_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, rng.choice([t, t, 1, None]), rng.choice(["user", "assistant", "system", None, "to\nol", "<|x%"]), rng.choice(["Hi.", "", None, "<|im_end|>", "\U0001f600 <\\|", "a\r\nb"])) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(100, 0, "user", "q"), (100, 1, "assistant", "a"), (101, 0, "system", "s"), (101, 1, "user", "q"), (101, 2, "assistant", "<|im_start|>"), (103, 0, "user", "q"), (103, 1, "assistant", "a"), (103, 2, "user", "q"), (103, 2, "user", "q")]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (200, 0, "user", "word " * 300_000), (200, 1, "assistant", "<|" * 100_000)]
    clash = ["record", "turns", "paths", "layout", "fingerprint", "formatted", "loss", "t"]
    spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in clash]).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op11_chat_formatting(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(((t is not None, t or 0, (role or "").encode(), (text or "").encode()) for conv, t, role, text in rows if conv == c))
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == by_hand([(role.decode(), text.decode()) for _, _, role, text in own]), c
    layouts = {r["layout"] for r in chat.canonical(chat.as_records(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert layouts == {"messages", "turns_from_value", "prompt_response", "instruction"}


def test_empty_table_and_many_turns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in chat.op11_chat_formatting(spark, str(tmp_path)).collect()] == [-1]
    rows = spark.range(5000).select(F.lit(3).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), F.col("id").cast("string")).alias("text"))
    r = chat.formatted(chat.as_records(rows)).select(chat.parsed(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("learnt")).first()
    assert [t["text"] for t in r["turns"]] == [f"Turn {i}" for i in range(5000)] and r["learnt"] == "".join(f"Turn {i}" for i in range(1, 5000, 2))
