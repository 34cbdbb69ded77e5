"""Many small lossless WebP images written and read at once, as columns.

``write`` codes each image with references to earlier runs of pixels, a colour cache and a palette where these save bits,
and Huffman codes. ``read`` is the counterpart: all images' codes, and then all their pixels, are decoded in step, one
symbol of every image at a time; references and the cache become pointers to earlier pixels, which are followed at the
end. Each step is a few array operations over all images, so what a batch costs depends on its pixels, not on how
many images they are in. Images that have other transforms or several groups of codes are left to ``webp.decode``.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

from .webp import CACHE_FACTOR, LENGTH_ORDER, Bits, _near, channels, decode, numbers, read_pixels, undo_palette

#: The fewest pixels of a reference, and the most bits of a cache.
LEAST_RUN, MOST_CACHE = 3, 9
#: The most pixels of one image: no reference is longer, and each image takes as many steps to read as it has tokens.
MOST_PIXELS = 4096
GREENS = 280 + (1 << MOST_CACHE)
LONGEST_CODE, LONGEST_CODER = 15, 7


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _stable_order(key: np.ndarray) -> np.ndarray:
    """The order of keys that are 0 or more, equal ones as they come: sorted with their places in the lower bits where both fit, which
    takes less time than sorting places stably; else by how many different keys come before them."""
    bits = max(len(key) - 1, 1).bit_length()
    if len(key) and int(key.max()) < 1 << (62 - bits):
        return np.sort(key.astype(np.int64) << bits | np.arange(len(key))) & ((1 << bits) - 1)
    order = np.argsort(key)
    kind = np.zeros(len(key), np.int64)
    np.cumsum(key[order[1:]] != key[order[:-1]], out=kind[1:])
    return np.sort(kind << bits | order) & ((1 << bits) - 1)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the groups of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@cache
def _reversed_bits() -> np.ndarray:
    """The numbers of LONGEST_CODE bits, each with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for k in range(LONGEST_CODE):
        out = np.concatenate([out, out | 1 << (LONGEST_CODE - 1 - k)])
    return out


@cache
def _times_log() -> np.ndarray:
    """n * log2(n)."""
    n = np.arange(1, MOST_PIXELS + 1, dtype=np.float64)
    return np.concatenate([[0.0], n * np.log2(n)])


@cache
def _near_codes(width: int) -> np.ndarray:
    """For each distance up to MOST_PIXELS the code of a near one, else the distance itself and 120."""
    out, near = np.arange(MOST_PIXELS + 1) + 120, _near(width)
    for code in range(len(near) - 1, 0, -1):
        if near[code] <= MOST_PIXELS:
            out[near[code]] = code
    return out


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for lengths or distances from 1 on."""
    x = values - 1
    high = np.maximum(np.frexp(x.astype(np.float64))[1] - 1, 1)
    n = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> n & 1)), x & ((1 << n) - 1), n


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """For each row of counts the bits of its symbols in a Huffman code of at most ``limit`` bits; 1 for one that is alone.

    All rows are merged in step: the two lightest of the leaves and of the nodes made so far, both in order of weight."""
    out = np.zeros(counts.shape, np.int64)
    row, symbol = np.nonzero(counts)
    many = np.bincount(row, minlength=len(counts))
    single = many[row] == 1
    out[row[single], symbol[single]] = 1
    weights, todo = counts[row, symbol], np.flatnonzero(many > 1)
    while len(todo):
        mine = np.isin(row, todo)
        r, s, w = row[mine], symbol[mine], weights[mine]
        order = np.lexsort((s, w, r))
        r, s, w = r[order], s[order], w[order]
        k = np.bincount(r, minlength=len(counts))[todo]
        by_size = np.argsort(-k, kind="stable")  # so that the rows that are still at work are the first ones
        todo, k = todo[by_size], k[by_size]
        place = np.zeros(len(counts), np.int64)
        place[todo] = np.arange(len(todo))
        most = int(k[0])
        leaves, nodes = np.full((len(todo), most + 1), 1 << 40), np.full((len(todo), most), 1 << 41)
        at = place[r], _within(np.bincount(r, minlength=len(counts))[np.unique(r)])
        leaves[at] = w
        up, leaf, node = np.zeros((len(todo), 2 * most), np.int64), np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        every, active = np.arange(len(todo)), len(todo) - np.searchsorted(k[::-1], np.arange(1, most) + 1, "left")
        for t, n in enumerate(active.tolist()):
            own, total = every[:n], 0
            for _ in range(2):
                a, b = leaves[own, leaf[:n]], nodes[own, node[:n]]
                first = a <= b
                up[own, np.where(first, leaf[:n], most + node[:n])] = t
                leaf[:n] += first
                node[:n] += ~first
                total = total + np.where(first, a, b)
            nodes[:n, t] = total
        depth = np.zeros((len(todo), most), np.int64)
        for t in range(most - 3, -1, -1):
            n = int(active[t + 1])
            depth[:n, t] = depth[every[:n], up[:n, most + t]] + 1
        bits = depth[at[0], up[at]] + 1
        out[r, s] = bits
        long = np.zeros(len(counts), bool)
        long[r[bits > limit]] = True
        todo = np.flatnonzero(long)
        weights = np.where(long[row], (weights + 1) >> 1, weights)
    return out


def code_words(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row each symbol's bits, the first one lowest, and their number; none for a symbol that is alone."""
    words, taken = np.zeros_like(lengths), lengths.copy()
    taken[(lengths > 0).sum(1) < 2] = 0
    row, symbol = np.nonzero(taken)
    n = taken[row, symbol]
    order = _stable_order(row * 16 + n)
    row, symbol, n = row[order], symbol[order], n[order]
    steps = 1 << (LONGEST_CODE - n)
    before = np.cumsum(steps) - steps  # whole codes before come to a multiple of 1 << LONGEST_CODE
    words[row, symbol] = _reversed_bits()[before & ((1 << LONGEST_CODE) - 1)]
    return words, taken


def told_lengths(lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, symbol, extra bits, their number) of what tells each row's lengths, of which it has ``sizes``: literals and runs."""
    flat = lengths[np.arange(lengths.shape[1]) < sizes[:, None]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]))
    n, left, of = flat[starts], np.diff(np.concatenate([starts, [len(flat)]])), owner[starts]
    first = (n > 0).astype(np.int64)
    left = left - first
    most = np.where(n > 0, 6, 138)
    full, rest = left // most, left % most
    many = first + full + np.where(rest >= 3, 1, rest)
    run, j = np.repeat(np.arange(len(n)), many), _within(many) - np.repeat(first, many)
    n, first, full, rest = n[run], first[run], full[run], rest[run]
    size = np.where(j < full, np.where(n > 0, 6, 138), rest)
    is_run = (j >= 0) & ((j < full) | (rest >= 3))
    kind = np.where(n > 0, 16, np.where(size >= 11, 18, 17))
    least, wide = np.where(kind == 18, 11, 3), np.where(kind == 16, 2, np.where(kind == 17, 3, 7))
    return of[run], np.where(is_run, kind, n), np.where(is_run, size - least, 0), np.where(is_run, wide, 0)


class Images:
    """Images side by side: all their pixels in a row, with how each image is coded."""

    def __init__(self, pixels: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> None:
        self.sizes, self.starts = sizes, _offsets(sizes)[:-1]
        many, n = len(sizes), len(pixels)
        image = np.repeat(np.arange(many), sizes)
        at, length, far = self.references(pixels, image)
        first = np.zeros(n + 1, np.int64)
        first[at] += 1
        np.subtract.at(first, at + length, 1)
        begins, ref = np.cumsum(first[:-1]) == 0, np.zeros(n, bool)
        begins[at], ref[at] = True, True
        token = np.flatnonzero(begins)
        self.ref, own, self.image = ref[token], pixels[token], image[token]
        length_symbol, *self.length_extra = prefixed(length)
        codes = far + 120
        for w in np.unique(widths):
            mine = widths[image[at]] == w
            codes[mine] = _near_codes(int(w))[far[mine]]
        self.far_of, *self.far_extra = prefixed(codes)
        green = (own >> 8) & 255
        green[self.ref] = 256 + length_symbol
        cache_bits = np.clip(np.frexp(sizes.astype(np.float64))[1] - 4, 1, MOST_CACHE)
        slot = (pixels * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits[image])
        order, hit = _stable_order(image << MOST_CACHE | slot), np.zeros(n, bool)
        hit[order[1:]] = (pixels[order[1:]] == pixels[order[:-1]]) & (image[order[1:]] == image[order[:-1]])
        self.samples = [(own >> k) & 255 for k in (16, 0, 24)]
        tried, logs = [], _times_log()
        for cached in (False, True):
            symbols = np.where(hit[token] & ~self.ref, 280 + slot[token], green) if cached else green
            plain = symbols < 256
            greens = np.bincount(self.image * GREENS + symbols, minlength=many * GREENS).reshape(many, GREENS)
            rest = [np.bincount((self.image * 256 + x)[plain], minlength=many * 256).reshape(many, 256) for x in self.samples]
            # the entropy of all alphabets, and about 4 bits for each symbol to describe its code
            bits = sum(logs[c.sum(1)] - logs[c].sum(1) + 4 * np.count_nonzero(c, 1) for c in (greens, *rest))
            tried.append((bits, symbols, greens, rest))
        (bits0, symbols0, greens0, rest0), (bits1, symbols1, greens1, rest1) = tried
        use = bits1 < bits0
        self.cache_bits = np.where(use, cache_bits, 0)
        self.symbols = np.where(use[self.image], symbols1, symbols0)
        fars = np.bincount(self.image[self.ref] * 40 + self.far_of, minlength=many * 40).reshape(many, 40)
        self.greens, self.rest = np.where(use[:, None], greens1, greens0), [np.where(use[:, None], b, a) for a, b in zip(rest0, rest1, strict=True)] + [fars]
        extra = np.bincount(self.image[self.ref], self.length_extra[1] + self.far_extra[1], many)
        self.bits = np.where(use, bits1, bits0) + extra + logs[fars.sum(1)] - logs[fars].sum(1)

    @staticmethod
    def references(pixels: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and distances of runs of at least LEAST_RUN pixels that are as far as before like earlier ones."""
        n = len(pixels) - LEAST_RUN + 1
        if n < 2:
            return (np.zeros(0, np.int64),) * 3
        key = image[:n].astype(np.uint64)
        for k in range(LEAST_RUN):
            key = (key ^ pixels[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        order = _stable_order(key)
        here, there = order[1:], order[:-1]
        same = key[here] == key[there]
        here, there = here[same], there[same]
        alike = image[there] == image[here + LEAST_RUN - 1]
        for k in range(LEAST_RUN):
            alike &= pixels[here + k] == pixels[there + k]
        d = np.zeros(n + 2, np.int64)
        d[here[alike] + 1] = (here - there)[alike]
        starts = np.flatnonzero((d[1:-1] > 0) & (d[1:-1] != d[:-2]))
        stops = np.flatnonzero((d[1:-1] > 0) & (d[1:-1] != d[2:])) + LEAST_RUN
        far = d[starts + 1]
        starts = np.maximum(starts, np.concatenate([[0], stops[:-1]]))
        held = stops - starts >= LEAST_RUN
        return starts[held], (stops - starts)[held], far[held]

    def coded(self, kept: np.ndarray, main: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(image, value, bits) of all fields of the images ``kept``, in each one's order; ``main`` tells those that may have groups."""
        row_of = np.cumsum(kept) - 1
        rows = np.flatnonzero(kept)
        many, cached = len(rows), self.cache_bits[rows]
        head = (rows, np.where(cached > 0, 1 | cached << 1, 0), np.where(cached > 0, 5, 1) + main[rows])
        lengths = [code_lengths(self.greens[rows], LONGEST_CODE)]
        lengths += list(code_lengths(np.concatenate([c[rows] for c in self.rest[:3]]), LONGEST_CODE).reshape(3, many, 256))
        lengths.append(code_lengths(self.rest[3][rows], LONGEST_CODE))
        sizes = [280 + np.where(cached > 0, 1 << cached, 0)] + [np.full(many, n) for n in (256, 256, 256, 40)]
        told = [self.descriptions(own, size) for own, size in zip(lengths, sizes, strict=True)]
        words = [code_words(x) for x in lengths]
        mine = kept[self.image]
        image, symbols, ref = self.image[mine], self.symbols[mine], self.ref[mine]
        at = row_of[image]
        values, bits = (x[at, symbols] for x in words[0])
        plain = symbols < 256
        for (w, n), sample in zip(words[1:4], self.samples, strict=True):
            here = at[plain], sample[mine][plain]
            values[plain] |= w[here] << bits[plain]
            bits[plain] += n[here]
        mine = mine[self.ref]
        here = at[ref], self.far_of[mine]
        for w, n in ([x[mine] for x in self.length_extra], [x[here] for x in words[4]], [x[mine] for x in self.far_extra]):
            values[ref] |= w << bits[ref]
            bits[ref] += n
        parts = [head, *[(rows[r], v, n) for r, v, n in told], (image, values, bits)]
        owner = np.concatenate([p[0] for p in parts])
        order = _stable_order(owner)
        return owner[order], np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order]

    @staticmethod
    def descriptions(lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, value, bits) of the fields that describe each row's code."""
        used = lengths > 0
        many, low, high = used.sum(1), used.argmax(1), lengths.shape[1] - 1 - used[:, ::-1].argmax(1)
        simple = (many < 3) & ((many == 0) | (high < 256))
        s = np.flatnonzero(simple)
        two = many[s] == 2
        fields = [(s, 5 | two << 1 | np.where(many[s] > 0, low[s], 0) << 3 | np.where(two, high[s], 0) << 11, np.where(two, 19, 11))]
        rest = np.flatnonzero(~simple)
        if len(rest):
            of, symbol, extra, wide = told_lengths(lengths[rest], sizes[rest])
            coder = code_lengths(np.bincount(of * 19 + symbol, minlength=19 * len(rest)).reshape(-1, 19), LONGEST_CODER)
            words, bits = code_words(coder)
            own = coder[:, LENGTH_ORDER]
            count = np.maximum(4, 19 - (own[:, ::-1] > 0).argmax(1))
            fields.append((rest, (count - 4) << 1, np.full(len(rest), 5)))
            fields.append((rest, (own << 3 * np.arange(19)).sum(1), 3 * count + 1))
            fields.append((rest[of], words[of, symbol] | extra << bits[of, symbol], bits[of, symbol] + wide))
        row, value, bits = (np.concatenate([f[i] for f in fields]) for i in range(3))
        order = _stable_order(row)
        return row[order], value[order], bits[order]


def write(images: list[np.ndarray], width: int) -> list[bytes]:
    """A lossless WebP file for each of ``images``, opaque ARGB numbers row by row, of up to MOST_PIXELS pixels."""
    sizes = np.array([len(x) for x in images])
    flat = np.concatenate(images)
    number, strips = np.repeat(np.arange(len(images)), sizes), len(images)
    colours, places = np.unique(number << 32 | flat, return_inverse=True)
    many = np.bincount(colours >> 32, minlength=strips)
    first = _offsets(many)
    starts = _offsets(sizes)
    all_pixels, all_sizes, widths, of = [flat], list(sizes), [width] * strips, {}
    for i in np.flatnonzero((many <= 256) & (2 * many <= sizes)).tolist():  # else a table of colours takes more than it saves
        n = int(many[i])
        pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        across = (width + (1 << pack) - 1) >> pack
        wide = np.zeros((sizes[i] // width, across << pack), np.int64)
        wide[:, :width] = (places[starts[i] : starts[i + 1]] - first[i]).reshape(-1, width)
        packed = (wide.reshape(-1, across, 1 << pack) << np.arange(1 << pack) * (8 >> pack)).sum(-1).ravel()
        steps = channels(colours[first[i] : first[i + 1]] & 0xFFFFFFFF)
        steps[1:] = (steps[1:] - steps[:-1]) & 255
        of[i] = len(all_sizes)
        all_pixels += [numbers(steps), packed << 8]
        all_sizes += [n, len(packed)]
        widths += [n, across]
    made = Images(np.concatenate(all_pixels), np.array(all_sizes), np.array(widths))
    kept, main = np.zeros(len(all_sizes), bool), np.ones(len(all_sizes), bool)
    kept[:strips] = True
    for i, k in list(of.items()):
        if made.bits[k] + made.bits[k + 1] < made.bits[i]:
            kept[i], kept[k : k + 2], main[k] = False, True, False
        else:
            del of[i]
    image, value, bits = made.coded(kept, main)
    total = np.bincount(image, bits, len(all_sizes)).astype(np.int64)
    # each strip: mark, size, then a table if there is one, then the pixels
    with_table = np.array(sorted(of), np.int64)
    table = np.array([of[i] for i in with_table.tolist()], np.int64)
    before, main_image = np.full(strips, 41), np.arange(strips)
    before[with_table] = 52 + total[table]
    main_image[with_table] = table + 1
    length = (before + total[main_image] + 7) // 8
    base = 8 * _offsets(length)
    at = np.zeros(len(all_sizes), np.int64)
    at[main_image] = base[:-1] + before
    at[table] = base[with_table] + 51
    place = at[image] + np.cumsum(bits) - bits - (np.cumsum(total) - total)[image]
    height = sizes // width
    head = 0x2F | (width - 1) << 8 | (height - 1) << 22
    heads = [(base[:-1], head, np.full(strips, 40)), (base[with_table] + 40, 1 | 3 << 1 | (many[with_table] - 1) << 3, np.full(len(with_table), 11))]
    place, value, bits = (np.concatenate([own, *[h[k] for h in heads]]) for k, own in enumerate((place, value, bits)))
    word, skip = place >> 6, (place & 63).astype(np.uint64)
    out = np.zeros(int(base[-1]) // 64 + 2, np.uint64)
    value = value.astype(np.uint64)
    np.bitwise_or.at(out, word, value << skip)
    np.bitwise_or.at(out, word + 1, value >> np.uint64(1) >> (np.uint64(63) - skip))
    body, stops = out.astype("<u8").tobytes(), (base >> 3).tolist()
    return [_framed(body[a:b]) for a, b in zip(stops, stops[1:], strict=False)]


def _framed(body: bytes) -> bytes:
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


class Stream:
    """Many bit streams in one buffer; ``at`` holds a place for each."""

    def __init__(self, parts: list[bytes], at: list[int]) -> None:
        joined = b"".join(x + bytes(16) for x in parts) + bytes(16)
        self.ahead = np.ndarray((len(joined) - 8,), "<i8", joined, strides=(1,))
        starts = 8 * _offsets(np.array([len(x) + 16 for x in parts], np.int64))[:-1]
        self.at, self.end = starts + np.array(at, np.int64), starts + 8 * np.array([len(x) for x in parts], np.int64)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place on; those above are not to be used."""
        return self.ahead[np.minimum(at >> 3, len(self.ahead) - 1)] >> (at & 7)

    def take(self, rows: np.ndarray, n) -> np.ndarray:
        found = self.peek(self.at[rows]) & ((1 << n) - 1)
        self.at[rows] += n
        return found


class Codes:
    """A prefix code for each row, as one table: the next bits of row i, masked, from ``base`` on, lead to symbol * 16 + bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        row, symbol = np.nonzero(lengths)
        n = lengths[row, symbol]
        alone = np.bincount(row, minlength=len(lengths))[row] == 1
        n = np.where(alone, 0, n)
        longest = np.zeros(len(lengths), np.int64)
        np.maximum.at(longest, row, n)
        width = 1 << (longest[row] - n)
        full = np.bincount(row, width, len(lengths))
        if (full != 1 << longest).any():
            raise ValueError("not a complete prefix code")
        order = _stable_order(row * 16 + n)
        entries = np.repeat((symbol << 4 | n)[order].astype(np.int32), width[order])
        self.base = _offsets(1 << longest)[:-1]
        local, of = _within(1 << longest), np.repeat(np.arange(len(lengths)), 1 << longest)
        self.table = entries[self.base[of] + (_reversed_bits()[local] >> (LONGEST_CODE - longest[of]))]
        self.mask = (1 << longest) - 1


def read_lengths(stream: Stream, sizes: np.ndarray) -> np.ndarray:
    """The code lengths that come next in each stream, for alphabets of these sizes."""
    every = np.arange(len(sizes))
    lengths = np.zeros((len(sizes), int(sizes.max())), np.int64)
    simple = stream.take(every, 1) > 0
    s = every[simple]
    two, wide = stream.take(s, 1), stream.take(s, 1)
    lengths[s, stream.take(s, np.where(wide > 0, 8, 1))] = 1
    lengths[s[two > 0], stream.take(s[two > 0], 8)] = 1
    rows = every[~simple]
    if not len(rows):
        return lengths
    count = 4 + stream.take(rows, 4)
    packed = stream.take(rows, 3 * count)
    own = np.zeros((len(rows), 19), np.int64)
    own[:, LENGTH_ORDER] = packed[:, None] >> 3 * np.arange(19) & 7
    codes = Codes(own)
    left = np.full(len(rows), 1 << 30)
    limited = np.flatnonzero(stream.take(rows, 1))
    if len(limited):
        bits = 2 + 2 * stream.take(rows[limited], 3)
        left[limited] = 2 + stream.take(rows[limited], bits)
    base, mask, at, p, before = codes.base, codes.mask, np.zeros(len(rows), np.int64), stream.at[rows], np.full(len(rows), 8)
    size, told = sizes[rows], []
    while len(rows):
        w = stream.peek(p)
        found = codes.table[base + (w & mask)]
        symbol, n = found >> 4, found & 15
        w = w >> n
        run = symbol >= 16
        wide = np.where(run, np.array([2, 3, 7])[np.maximum(symbol - 16, 0)], 0)
        times = np.where(run, (w & ((1 << wide) - 1)) + np.where(symbol == 18, 11, 3), 1)
        value = np.where(symbol < 16, symbol, np.where(symbol == 16, before, 0))
        told.append((rows, at, times, value))
        before = np.where((symbol < 16) & (symbol > 0), symbol, before)
        at, p, left = at + times, p + n + wide, left - 1
        stream.at[rows] = p
        if (at > size).any():
            raise ValueError("more lengths than symbols")
        on = (at < size) & (left > 0)
        if not on.all():
            rows, base, mask, at, p, before, size, left = (x[on] for x in (rows, base, mask, at, p, before, size, left))
    rows, at, times, value = (np.concatenate([t[i] for t in told]) for i in range(4))
    some = value > 0
    rows, at, times, value = rows[some], at[some], times[some], value[some]
    lengths[np.repeat(rows, times), np.repeat(at, times) + _within(times)] = np.repeat(value, times)
    return lengths


def _roots(source: np.ndarray) -> np.ndarray:
    """Follows each place's source to one that is its own."""
    while not np.array_equal(further := source[source], source):
        source = further
    return source


def read_tokens(stream: Stream, width: np.ndarray, sizes: np.ndarray, cache_bits: np.ndarray) -> np.ndarray:
    """The pixels of all images in a row, each of one group of codes that comes next in its stream."""
    alphabets = [280 + np.where(cache_bits > 0, 1 << cache_bits, 0)] + [np.full(len(sizes), n) for n in (256, 256, 256, 40)]
    green, red, blue, alpha, far = [Codes(read_lengths(stream, n)) for n in alphabets]
    starts = _offsets(sizes)[:-1]
    total = int(sizes.sum())
    value, source, slot = np.zeros(total, np.int64), np.arange(total), np.full(total, -1, np.int16)
    row, p, at, stop, told = np.arange(len(sizes)), stream.at.copy(), starts.copy(), starts + sizes, []
    base, mask = [c.base.copy() for c in (green, red, blue)], [c.mask.copy() for c in (green, red, blue)]
    alpha_varies = bool((alpha.mask > 0).any())
    opaque = (alpha.table[alpha.base] >> 4).astype(np.int64) << 24
    while len(row):
        w = stream.peek(p)
        g = green.table[base[0] + (w & mask[0])]
        w = w >> (g & 15)
        r = red.table[base[1] + (w & mask[1])]
        b = blue.table[base[2] + (w >> (r & 15) & mask[2])]
        symbol = g >> 4
        p = p + (g & 15)
        after = p + (r & 15) + (b & 15)
        pixel = opaque[row] | (r >> 4).astype(np.int64) << 16 | symbol << 8 | b >> 4
        if alpha_varies:
            found = alpha.table[alpha.base[row] + (stream.peek(after) & alpha.mask[row])]
            after, pixel = after + (found & 15), pixel & 0xFFFFFF | (found >> 4).astype(np.int64) << 24
        value[at] = pixel
        step = 1
        if (other := symbol >= 256).any():
            after = np.where(other, p, after)
            hit = np.flatnonzero(symbol >= 280)
            slot[at[hit]] = symbol[hit] - 280
            refs = np.flatnonzero(other & (symbol < 280))
            if len(refs):
                step, q, own = np.ones(len(row), np.int64), p[refs], row[refs]
                step[refs], q = _number(stream, q, symbol[refs] - 256)
                found = far.table[far.base[own] + (stream.peek(q) & far.mask[own])]
                d, after[refs] = _number(stream, q + (found & 15), found >> 4)
                told.append((at[refs], step[refs], d, own))
        at, p = at + step, after
        on = at < stop
        if not on.all():
            done = ~on
            stream.at[row[done]] = p[done]
            if (at[done] > stop[done]).any():
                raise ValueError("a reference leaves the image")
            row, p, at, stop, *rest = (x[on] for x in (row, p, at, stop, *base, *mask))
            base, mask = rest[:3], rest[3:]
    if (stream.at > stream.end).any():
        raise ValueError("the image ends early")
    if told:
        at, length, d, own = (np.concatenate([t[i] for t in told]) for i in range(4))
        far_of = d - 120
        for w in np.unique(width):
            mine = (d <= 120) & (width[own] == w)
            far_of[mine] = _near(int(w))[d[mine]]
        if (far_of > at - starts[own]).any():
            raise ValueError("a reference leaves the image")
        where = np.repeat(at, length) + _within(length)
        source[where] = where - np.repeat(far_of, length)
    cached = np.flatnonzero(slot >= 0)
    if len(cached):
        image = np.repeat(np.arange(len(sizes)), sizes)
        wide = cache_bits[image]
        slots = np.where(slot < 0, (value * CACHE_FACTOR & 0xFFFFFFFF) >> np.where(wide > 0, 32 - wide, 31), slot)[_roots(source)]
        order = _stable_order(image << 11 | slots)
        before = np.full(total, -1)
        same = (slots[order[1:]] == slots[order[:-1]]) & (image[order[1:]] == image[order[:-1]])
        before[order[1:][same]] = order[:-1][same]
        if (before[cached] < 0).any():
            raise ValueError("the cache is read before it is filled")
        source[cached] = before[cached]
    return value[_roots(source)]


def _number(stream: Stream, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of these prefix symbols with the extra bits at ``at``, and the places after those."""
    prefix = prefix.astype(np.int64)
    more = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << more) + (stream.peek(at) & ((1 << more) - 1))) + 1, at + more


def read(files: list[bytes]) -> list[np.ndarray]:
    """The (height, width, 4) samples r, g, b, a of each of ``files``."""
    out: list = [None] * len(files)
    bodies, places, todo = [], [], []
    for i, data in enumerate(files):
        bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
        width, height = bits.read(14) + 1, bits.read(14) + 1
        palette, coded, plain = None, width, data[8:16] == b"WEBPVP8L" and bits.read(4) & 14 == 0
        if plain and bits.read(1):
            plain = bits.read(2) == 3
            if plain:
                n = bits.read(8) + 1
                steps = channels(read_pixels(bits, n, 1))
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                palette, coded = (coded, height, pack, numbers(np.cumsum(steps, 0) & 255)), (width + (1 << pack) - 1) >> pack
                plain = not bits.read(1)
        wide = bits.read(4) if plain and bits.read(1) else 0
        if plain and not bits.read(1):
            bodies.append(bits.data), places.append(bits.at), todo.append((i, width, height, palette, coded, wide))
        else:
            out[i] = decode(data)
    if todo:
        coded, sizes, wide = (np.array(x, np.int64) for x in zip(*[(c, c * h, b) for _, _, h, _, c, b in todo], strict=True))
        flat = read_tokens(Stream(bodies, places), coded, sizes, wide)
        starts = _offsets(sizes).tolist()
        rgba = channels(flat)[:, [1, 2, 3, 0]].astype(np.uint8)
        for (i, width, height, palette, _, _), a, b in zip(todo, starts, starts[1:], strict=False):
            out[i] = (channels(undo_palette(flat[a:b], *palette))[:, [1, 2, 3, 0]].astype(np.uint8) if palette else rgba[a:b]).reshape(height, width, 4)
    return out
