"""Texts as small letter codes, for models over character n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np


@cache
def letter_table(size: int) -> np.ndarray:
    """For each code point a symbol below ``size``: 0 for what is no letter, 1 to 26 for a to z in either case,
    and for other letters a slot from 27 on that a multiplicative hash of the lower-case code point picks."""
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ord(ch.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + ((low * 2654435761 & 0xFFFFFFFF) >> 12) % (size - 27)
    return table


def ngram_codes(texts: Sequence[str], bits: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams over letter symbols, runs of other characters being one boundary symbol 0.

    Each text begins in a context of boundaries and ends with one. Returns the codes of all texts in a row and
    the number of codes of each text; a text without a letter has none.
    """
    if not texts:
        return np.zeros(0, np.uint32 if bits * order <= 32 else np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = letter_table(1 << bits)[points]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[np.cumsum(lengths) - lengths] = 0
    keep = (symbols != 0) | (before != 0)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[keep]
    symbols = symbols[keep]
    at = np.arange(len(symbols), dtype=np.int32) + (owner + 1) * np.int32(order - 1)
    kind = np.uint32 if bits * order <= 32 else np.int64
    padded = np.zeros(len(symbols) + (len(texts) + 1) * (order - 1), kind)
    padded[at] = symbols
    codes = np.zeros(len(symbols), kind)
    for back in range(order):
        codes |= padded[at - back] << kind(bits * back)
    return codes, np.bincount(owner, minlength=len(texts))


#: The most entries of a table with a place for every n-gram over the symbols that occur.
DENSE = 1 << 22


class Dense:
    """Numbers n-grams over few of the possible symbols without gaps; ``fits`` if DENSE places suffice for all of them and
    for one more symbol, which stands for all others."""

    def __init__(self, symbols: np.ndarray, bits: int, order: int) -> None:
        self.bits, self.order, self.symbols, self.size = bits, order, symbols, len(symbols) + 1
        self.place = np.full(1 << bits, len(symbols), np.int32)
        self.place[symbols] = np.arange(len(symbols))
        self.fits = self.size**order <= DENSE

    def number(self, codes: np.ndarray, order: int | None = None) -> np.ndarray:
        out = np.zeros(len(codes), np.int32)
        for k in range((order or self.order) - 1, -1, -1):
            out = out * self.size + self.place[codes >> self.bits * k & ((1 << self.bits) - 1)]
        return out

    def code(self, numbers: np.ndarray) -> np.ndarray:
        out, numbers = np.zeros(len(numbers), np.int64), numbers.astype(np.int64)
        for k in range(self.order):
            out |= self.symbols[numbers % self.size].astype(np.int64) << self.bits * k
            numbers //= self.size
        return out


def symbols_of(codes: np.ndarray, bits: int, order: int) -> np.ndarray:
    """The symbols that occur in n-grams, in order."""
    seen = np.zeros(1 << bits, bool)
    for k in range(order):
        seen[codes >> bits * k & ((1 << bits) - 1)] = True
    return np.flatnonzero(seen)


def counted(codes: np.ndarray, bits: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and how often each occurs."""
    dense = Dense(symbols_of(codes, bits, 1), bits, order)  # an n-gram's last symbol; those before it are last ones too, or 0
    if 0 not in dense.symbols:
        dense = Dense(np.concatenate([[0], dense.symbols]), bits, order)
    if not dense.fits or len(codes) * 64 < dense.size**order:
        return np.unique(codes, return_counts=True)
    n = np.bincount(dense.number(codes))
    kinds = np.flatnonzero(n)
    found = dense.code(kinds)
    order_ = np.argsort(found)
    return found[order_], n[kinds][order_]
