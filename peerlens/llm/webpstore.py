"""Texts kept as lossless WebP images, read back and measured.

A text's bytes, filled up with blanks, are the r, g, b samples of images of 64 pixels a row and at most 64 rows; a longer
text has several images in a row, so that no image grows with its text. Images are written and read many at a time.

Defined results: a null or empty text is stored as 192 blanks; rows that repeat are stored alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, runs, small_batches
from .webpbatch import MOST_PIXELS, read, write

UNIT = 192
WIDTH = UNIT // 3
#: Characters of texts whose images are handled at once.
RUN = 3 << 20


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % UNIT or (0 if raw else UNIT)), len(raw)


def store(payloads: Sequence[bytes]) -> list[bytes]:
    """Each payload, of a multiple of UNIT bytes, as one image or several in a row."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 3).astype(np.int64)
    flat = 255 << 24 | samples[:, 0] << 16 | samples[:, 1] << 8 | samples[:, 2]
    images, many, at = [], [], 0
    for p in payloads:
        stop = at + len(p) // 3
        own = [flat[a : min(stop, a + MOST_PIXELS)] for a in range(at, stop, MOST_PIXELS)]
        images += own
        many.append(len(own))
        at = stop
    files = iter(write(images, WIDTH))
    return [b"".join(next(files) for _ in range(n)) for n in many]


def load(media: Sequence[bytes]) -> list[np.ndarray]:
    """For each of what ``store`` made its pixels (rows, WIDTH, 4)."""
    files, many = [], []
    for data in media:
        at, before = 0, len(files)
        while at < len(data):
            size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            files.append(data[at : at + size])
            at += size
        many.append(len(files) - before)
    images = iter(read(files))
    return [np.concatenate([next(images) for _ in range(n)]) for n in many]


def described(pixels: np.ndarray) -> str:
    """Height, and each channel's mean, its standard deviation and the mean step from row to row."""
    rgb = pixels[..., :3].reshape(-1, 3)
    mean = rgb.mean(0)
    deviation = np.sqrt(np.maximum(np.square(rgb, dtype=np.float32).mean(0, dtype=np.float64) - mean**2, 0))
    steps = np.abs(np.diff(pixels[..., 1].astype(np.int16), axis=0)).mean() if len(pixels) > 1 else 0.0
    return f"h={len(pixels)};mean={','.join(f'{x:.4f}' for x in mean)};std={','.join(f'{x:.4f}' for x in deviation)};step={steps:.4f}"


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) for every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def keep(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            out, own = [], s.fillna("").tolist()
            for a, b in runs(own, RUN):
                payloads, sizes = zip(*map(padded, own[a:b]), strict=True)
                media = store(payloads)
                for n, m, pixels in zip(sizes, media, load(media), strict=True):
                    back = np.ascontiguousarray(pixels[..., :3]).tobytes()
                    out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), described(pixels)))
            yield pd.DataFrame(out, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", keep("text").alias("k")).select("doc_id", "k.*")


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(documents(spark, sf_dir))
