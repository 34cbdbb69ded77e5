"""Lossless WebP: images in a binary column become pixel arrays.

``decode`` reads the format as published: canonical prefix codes, simple or with coded lengths, back-references with the
short distance map, the colour cache, groups of codes by an entropy image, and the predictor, cross-colour, subtract-green
and palette transforms, undone in reverse order. ``webpbatch`` reads and writes many images at once.

Defined results of ``pixel_arrays``: a null blob has null pixels, and so has one that isn't a lossless WebP; rows that repeat
are read alike; an empty table gives an empty result; further columns are kept, those named height, width and pixels replaced.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: the order in which lengths of the code-length code come, and the near distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
#: Bytes of a stream that are laid out at a time while it is decoded.
WINDOW = 1 << 13


class Bits:
    """Bits of a byte string, the lowest of each byte first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first, skip = divmod(self.at, 8)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the image ends early")
        return (int.from_bytes(self.data[first : first + 8], "little") >> skip) & ((1 << n) - 1)


@cache
def _reversal(n: int) -> np.ndarray:
    """For each number of n bits the one with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for k in range(n):
        out = np.concatenate([out, out | 1 << (n - 1 - k)])
    return out


class PrefixCode:
    """A canonical code, from each symbol's bits: for each value of the next ``longest`` bits the symbol that they begin
    with and how many of them it takes."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        n = lengths[used] if len(used) != 1 else np.zeros(1, np.int64)
        self.longest = int(n.max()) if len(used) else 0
        width = 1 << (self.longest - n)
        if not len(used) or self.longest > 15 or width.sum() != 1 << self.longest:
            raise ValueError("not a complete prefix code")
        order = np.argsort(n, kind="stable")
        place = _reversal(self.longest)
        self.symbols, self.taken = (np.repeat(x[order].astype(np.int32), width[order])[place] for x in (used, n))

    def read(self, bits: Bits) -> int:
        found = bits.read(self.longest)
        bits.at -= self.longest - int(self.taken[found])
        return int(self.symbols[found])


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        many, wide = bits.read(1), bits.read(1)
        lengths[[bits.read(8 if wide else 1)] + ([bits.read(8)] if many else [])] = 1
        return PrefixCode(lengths)
    count, own = 4 + bits.read(4), np.zeros(len(LENGTH_ORDER), np.int64)
    for s in LENGTH_ORDER[:count]:
        own[s] = bits.read(3)
    coder = PrefixCode(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    symbols, taken, mask = coder.symbols.tolist(), coder.taken.tolist(), (1 << coder.longest) - 1
    window, skip, limit = 0, 0, -1  # some bytes of the stream as one number, so that a symbol is a shift and two look-ups
    at, before = 0, 8
    while at < alphabet and left > 0:
        if skip > limit:
            bits.read(max(skip, 0))
            window, skip = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 64], "little") >> (bits.at & 7), 0
            limit = 480
        left -= 1
        found = window >> skip & mask
        s, skip = symbols[found], skip + taken[found]
        if s < 16:
            lengths[at] = s
            at, before = at + 1, s or before
            continue
        n, least, value = ((2, 3, before), (3, 3, 0), (7, 11, 0))[s - 16]
        run = (window >> skip & ((1 << n) - 1)) + least
        skip += n
        if at + run > alphabet:
            raise ValueError("more lengths than symbols")
        if value:
            lengths[at : at + run] = value
        at += run
    bits.read(skip)
    return PrefixCode(lengths)


def read_pixels(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_of, block, many, across = None, 0, 1, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        groups_of = (read_pixels(bits, across, (height + (1 << block) - 1) >> block) >> 8) & 0xFFFF
        groups_of, many = groups_of.tolist(), int(groups_of.max()) + 1
    groups = [[read_code(bits, n) for n in (256 + 24 + (cache_bits and 1 << cache_bits), 256, 256, 256, 40)] for _ in range(many)]
    return np.array(_tokens(bits, width, width * height, groups, cache_bits, groups_of, block, across), np.int64)


def _tables(codes: list[PrefixCode]) -> tuple:
    """For each alphabet a list of what the next bits stand for, times 16, plus the bits that it takes, and the mask of those
    bits. Red comes in its place in the pixel, together with alpha if that never varies."""
    green, red, blue, alpha, far = codes
    fixed = int(alpha.symbols[0]) << 24 if not alpha.longest else 0
    red_part = (red.symbols.astype(np.int64) << 16 | fixed) << 4 | red.taken
    lists = [red_part.tolist() if c is red else (c.symbols << 4 | c.taken).tolist() for c in codes]
    return *lists, *[(1 << c.longest) - 1 for c in codes]


def _tokens(bits: Bits, width: int, n: int, groups: list[list[PrefixCode]], cache_bits: int, groups_of: list[int] | None, block: int, across: int) -> list[int]:
    """The pixels of an image in the order of its stream. ``ahead`` has for each of the next bytes the eight from there on as
    one number, so that a symbol is a shift and a look-up; what the cache holds is worked out when a token asks for it."""
    tables = [_tables(codes) for codes in groups]
    green, red, blue, alpha, far, green_mask, red_mask, blue_mask, alpha_mask, far_mask = tables[0]
    data, end, near = bits.data, 8 * len(bits.data), _near(width).tolist()
    kept, cached, at = [0] * (1 << cache_bits), 0, 0
    start, p, held, out = bits.at, 0, -1, []
    while at < n:
        if p > held:
            start += p
            if start > end:
                raise ValueError("the image ends early")
            own = data[start >> 3 : (start >> 3) + WINDOW + 8] + bytes(24)
            ahead = np.lib.stride_tricks.sliding_window_view(np.frombuffer(own, np.uint8), 8).copy().view("<u8").ravel().tolist()
            start, p, held = start & ~7, start & 7, 8 * min(WINDOW, len(own) - 24)
        if groups_of is not None:
            green, red, blue, alpha, far, green_mask, red_mask, blue_mask, alpha_mask, far_mask = tables[groups_of[(at // width >> block) * across + (at % width >> block)]]
        w = ahead[p >> 3] >> (p & 7)
        g = green[w & green_mask]
        k = g & 15
        if g < 4096:
            w >>= k
            r = red[w & red_mask]
            j = r & 15
            b = blue[w >> j & blue_mask]
            p += k + j + (b & 15)
            pixel = r >> 4 | (g << 4 & 0xFF00) | b >> 4
            if alpha_mask:
                a = alpha[ahead[p >> 3] >> (p & 7) & alpha_mask]
                p += a & 15
                pixel |= a >> 4 << 24
            out.append(pixel)
            at += 1
            continue
        s, p = g >> 4, p + k
        if s < 280:
            more = max(0, s - 258 >> 1)
            length = (s - 256 if s < 260 else (2 + (s & 1) << more) + (w >> k & ((1 << more) - 1))) + 1
            p += more
            f = far[ahead[p >> 3] >> (p & 7) & far_mask]
            p, f = p + (f & 15), f >> 4
            more = max(0, f - 2 >> 1)
            d = (f if f < 4 else (2 + (f & 1) << more) + (ahead[p >> 3] >> (p & 7) & ((1 << more) - 1))) + 1
            p += more
            d = d - 120 if d > 120 else near[d]
            if d > at or at + length > n:
                raise ValueError("a reference leaves the image")
            out += out[at - d : at - d + length] if d >= length else (out[at - d :] * (length // d + 1))[:length]
            at += length
        else:
            for pixel in out[cached:]:
                kept[(pixel * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel
            cached = at
            out.append(kept[s - 280])
            at += 1
    bits.at = start + p
    if bits.at > end:
        raise ValueError("the image ends early")
    return out


@cache
def _near(width: int) -> np.ndarray:
    """The distances that the codes 1 to 120 stand for."""
    return np.array([0] + [max(1, x + y * width) for x, y in NEAR], np.int64)


def channels(argb: np.ndarray) -> np.ndarray:
    """(n, 4) samples a, r, g, b of ARGB numbers."""
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], -1)


def numbers(samples: np.ndarray) -> np.ndarray:
    s = samples.astype(np.int64)
    return s[..., 0] << 24 | s[..., 1] << 16 | s[..., 2] << 8 | s[..., 3]


def predicted(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    mean = lambda p, q: [(x + y) >> 1 for x, y in zip(p, q, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode in (0, 1, 2, 3, 4):
        return ([255, 0, 0, 0], left, top, top_right, top_left)[mode]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), top_left, strict=True)]
    return [255, 0, 0, 0]


def undo_predictor(argb: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    rest, across = channels(argb).tolist(), (width + (1 << block) - 1) >> block
    kinds = ((modes >> 8) & 15).tolist()
    for i, own in enumerate(rest):
        y, x = divmod(i, width)
        if i == 0:
            p = [255, 0, 0, 0]
        elif y == 0:
            p = rest[i - 1]
        elif x == 0:
            p = rest[i - width]
        else:
            p = predicted(kinds[(y >> block) * across + (x >> block)], rest[i - 1], rest[i - width], rest[i - width - 1], rest[i - width + 1])
        rest[i] = [(a + b) & 255 for a, b in zip(own, p, strict=True)]
    return numbers(np.array(rest))


def undo_cross_colour(argb: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    own = factors[(y >> block) * ((width + (1 << block) - 1) >> block) + (x >> block)]
    signed = lambda v: ((v & 255) ^ 128) - 128
    a, r, g, b = channels(argb).T
    r = (r + (signed(own) * signed(g) >> 5)) & 255
    b = (b + (signed(own >> 8) * signed(g) >> 5) + (signed(own >> 16) * signed(r) >> 5)) & 255
    return numbers(np.stack([a, r, g, b], -1))


def undo_green(argb: np.ndarray) -> np.ndarray:
    a, r, g, b = channels(argb).T
    return numbers(np.stack([a, (r + g) & 255, g, (b + g) & 255], -1))


def undo_palette(argb: np.ndarray, width: int, height: int, pack: int, palette: np.ndarray) -> np.ndarray:
    rows = ((argb >> 8) & 255).reshape(height, -1)
    bits = 8 >> pack
    split = np.stack([(rows >> (bits * k)) & ((1 << bits) - 1) for k in range(1 << pack)], -1).reshape(height, -1)[:, :width].ravel()
    return np.where(split < len(palette), palette[np.minimum(split, len(palette) - 1)], 0)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) samples r, g, b, a of one lossless WebP file; ValueError if it isn't one."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP")
    bits = Bits(data[21 : 20 + struct.unpack_from("<I", data, 16)[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind == 2:
            undo.append((undo_green, ()))
        elif kind == 3:
            n = bits.read(8) + 1
            steps = channels(read_pixels(bits, n, 1))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((undo_palette, (coded, height, pack, numbers(np.cumsum(steps, 0) & 255))))
            coded = (coded + (1 << pack) - 1) >> pack
        else:
            block = bits.read(3) + 2
            sub = read_pixels(bits, (coded + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block)
            undo.append((undo_cross_colour if kind else undo_predictor, (coded, height, block, sub)))
    argb = read_pixels(bits, coded, height, True)
    for step, own in reversed(undo):
        argb = step(argb, *own)
    return channels(argb)[:, [1, 2, 3, 0]].astype(np.uint8).reshape(height, width, 4)


def pixel_arrays(images: DataFrame, column: str = "image") -> DataFrame:
    """``images`` with height, width and pixels (binary, r g b a row by row) of the lossless WebP in ``column``."""

    @F.pandas_udf("height int, width int, pixels binary")
    def read(blobs: pd.Series) -> pd.DataFrame:
        out = []
        for blob in blobs:
            try:
                p = decode(bytes(blob)) if blob is not None else None
            except (ValueError, IndexError):
                p = None
            out.append((None, None, None) if p is None else (p.shape[0], p.shape[1], p.tobytes()))
        return pd.DataFrame(out, columns=["height", "width", "pixels"]).astype({"height": "Int32", "width": "Int32"})

    kept = [c for c in images.columns if c not in ("height", "width", "pixels")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("r")
    return images.select(row, read(F.col(f"`{column}`")).alias("p")).select(*[F.col(f"r.`{c}`").alias(c) for c in kept], "p.*")
