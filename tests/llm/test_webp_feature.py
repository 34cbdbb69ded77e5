"""The feature of a stored text, and its digests, from the text's bytes alone."""

import hashlib
import math
import re
import zlib

import pytest

from peerlens.llm import webpstore

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", "a", "plain text " * 40, "Ünïcödé 漢字 \U0001f600\n" * 300, "line of a page\n" * 2000, "x" * 192, "x" * 193]


def by_hand(text):
    raw = (text or "").encode()
    raw += b" " * ((-len(raw)) % 192 or (0 if raw else 192))
    channels = [raw[k::3] for k in range(3)]
    mean = [sum(c) / len(c) for c in channels]
    deviation = [math.sqrt(sum((x - m) ** 2 for x in c) / len(c)) for c, m in zip(channels, mean, strict=True)]
    green = [channels[1][i : i + 64] for i in range(0, len(channels[1]), 64)]
    steps = [abs(a - b) for one, two in zip(green, green[1:], strict=False) for a, b in zip(one, two, strict=True)]
    return raw, [len(green), *mean, *deviation, sum(steps) / len(steps) if steps else 0.0]


def test_features_and_digests(spark):
    rows = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(TEXTS)], SCHEMA).repartition(2)
    for r in webpstore.stored_texts(rows).collect():
        raw, feature = by_hand(TEXTS[r["doc_id"]])
        assert [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?", r["feature"])] == pytest.approx(feature, abs=2e-3)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len((TEXTS[r["doc_id"]] or "").encode()), len(raw), hashlib.sha256(raw).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(raw[-16:])
