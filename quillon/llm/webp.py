"""Media columns: lossless WebP images, decoded to pixel arrays and written."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Callable, Sequence
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import keyed, kind_of, map_columns, read

#: Fixed values of the format: the order in which code length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (left, up) of the 120 distance codes for near pixels.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Fixed value of the format: the colour cache's hash multiplier.
CACHE_MULTIPLIER = 0x1E35A7BD
#: Fixed value of the format: the largest width and height.
MOST = 16384


class Bits:
    """Reads bits, least significant first; beyond the end they are zero."""

    def __init__(self, data: bytes):
        self.data = data
        self.seek(0)

    def seek(self, position: int) -> None:
        self.at, self.word, self.held = position >> 3, 0, 0
        self.read(position & 7)

    def fill(self) -> None:
        self.word |= int.from_bytes(self.data[self.at : self.at + 8].ljust(8, b"\0"), "little") << self.held
        self.at += 8
        self.held += 64

    def read(self, n: int) -> int:
        if self.held < n:
            self.fill()
        out = self.word & ((1 << n) - 1)
        self.word >>= n
        self.held -= n
        return out

    @property
    def position(self) -> int:
        return self.at * 8 - self.held

    def check(self) -> None:
        if self.position > 8 * len(self.data):
            raise ValueError("the image data are cut short")


@lru_cache(maxsize=16)
def _reversed(width: int) -> np.ndarray:
    """All numbers of ``width`` bits with their bits in reverse."""
    out = np.zeros(1, np.intp)
    for _ in range(width):
        out = np.concatenate((2 * out, 2 * out + 1))
    return out


class PrefixCode:
    """A canonical prefix code as two tables, symbol and size, indexed by the next ``width`` bits."""

    def __init__(self, lengths: list[int] | np.ndarray):
        lengths = np.asarray(lengths)
        used = lengths.nonzero()[0]
        sizes = lengths[used]
        if len(used) < 2:  # a single symbol takes no bits
            self.width = 0
            self.symbol, self.size = np.array([used[0] if len(used) else 0], np.int32), np.zeros(1, np.int32)
        else:
            self.width = int(sizes.max())
            order = np.argsort(sizes, kind="stable")
            spans = 1 << (self.width - sizes[order])
            if spans.sum() != 1 << self.width:
                raise ValueError("a prefix code isn't complete")
            back = _reversed(self.width)
            self.symbol = np.repeat(used[order].astype(np.int32), spans)[back]
            self.size = np.repeat(sizes[order].astype(np.int32), spans)[back]
        self.mask = np.uint32((1 << self.width) - 1)

    @cached_property
    def lists(self) -> tuple[list[int], list[int]]:
        """Both tables, for reading one by one."""
        return self.symbol.tolist(), self.size.tolist()

    def read(self, bits: Bits) -> int:
        if bits.held < self.width:
            bits.fill()
        at = bits.word & ((1 << self.width) - 1)
        size = self.lists[1][at]
        bits.word >>= size
        bits.held -= size
        return self.lists[0][at]


@lru_cache(maxsize=512)
def _single(symbol: int) -> PrefixCode:
    return PrefixCode([0] * symbol + [1])


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        second = bits.read(8) if two else first
        if max(first, second) >= alphabet:
            raise ValueError("a prefix code has a symbol too many")
        if first == second:
            return _single(first)
        lengths = [0] * alphabet
        lengths[first] = lengths[second] = 1
        return PrefixCode(lengths)
    lengths = [0] * alphabet
    of_lengths = [0] * 19
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = _lengths_code(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    symbols, sizes, mask = *code.lists, (1 << code.width) - 1
    at, previous, word, held = 0, 8, bits.word, bits.held
    while at < alphabet and left:
        left -= 1
        if held < 16:
            bits.word, bits.held = word, held
            bits.fill()
            word, held = bits.word, bits.held
        symbol, size = symbols[word & mask], sizes[word & mask]
        word >>= size
        held -= size
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            previous = symbol or previous
            continue
        value, extra, n = (previous, 2, 3) if symbol == 16 else (0, 3, 3) if symbol == 17 else (0, 7, 11)
        n += word & ((1 << extra) - 1)
        word >>= extra
        held -= extra
        if at + n > alphabet:
            raise ValueError("code lengths run over")
        lengths[at : at + n] = [value] * n
        at += n
    bits.word, bits.held = word, held
    return PrefixCode(lengths)


@lru_cache(maxsize=64)
def _lengths_code(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(lengths)


#: Of each length or distance code, how many extra bits follow and the value without them.
_EXTRA = np.array([0 if c < 4 else (c - 2) >> 1 for c in range(40)], np.int32)
_LEAST = np.array([c + 1 if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1)) + 1 for c in range(40)], np.int32)
_MASK = np.array([(1 << n) - 1 for n in range(19)], np.uint32)
#: Bytes of a stream that are looked up at once.
SEGMENT = 1 << 14


class _Segment:
    """A stretch of a stream: the bits that follow each of its bit positions, and where each symbol there would end."""

    def __init__(self, data: bytes, first: int, groups: list[list[PrefixCode]]):
        piece = data[first : first + SEGMENT]
        self.limit = 8 * len(piece) if first + SEGMENT < len(data) else 8 * len(piece) + 64
        raw = np.frombuffer(data[first : first + SEGMENT + 16].ljust(len(piece) + 28, b"\0"), np.uint8).astype(np.uint32)
        words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        self.bits = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
        self.groups, self.steps = groups, {}

    def look(self, code: PrefixCode, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at some positions, and the positions after them."""
        if not code.width:
            return np.broadcast_to(code.symbol, at.shape), at
        index = self.bits[at] & code.mask
        return code.symbol[index], at + code.size[index]

    def span(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of length or distance codes whose extra bits are at some positions, and the positions after them."""
        extra = _EXTRA[code]
        return _LEAST[code] + (self.bits[at] & _MASK[extra]).astype(np.int32), at + extra

    def step(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """From each position under a group's codes: the next symbol's position, and the pixels that this one gives.

        Positions from ``limit`` on lead to themselves.
        """
        if g not in self.steps:
            green, red, blue, alpha, distance = self.groups[g]
            symbol, end = self.look(green, np.arange(self.limit, dtype=np.int32))
            after = end
            for code in (red, blue, alpha):
                if code.width:
                    after = self.look(code, after)[1]
            run = np.ones(self.limit, np.int32)
            if (special := (symbol >= 256).nonzero()[0]).size:
                after = after.copy() if after is end else after
                after[special] = end[special]
                back = special[symbol[special] < 280]
                run[back], at = self.span(symbol[back] - 256, end[back])
                code, at = self.look(distance, at)
                after[back] = at + _EXTRA[code]
            self.steps[g] = np.concatenate((after, np.arange(self.limit, self.limit + 80, dtype=np.int32))), run
        return self.steps[g]

    def follow(self, at: int, n: int) -> tuple[np.ndarray, int, int]:
        """Positions of the symbols from ``at`` on that give ``n`` pixels, or stand before the limit; where they end; their pixels.

        Eight steps are looked up at once, so that the chain is followed in strides.
        """
        one, run = self.step(0)
        two = one[one]
        four = two[two]
        eight = four[four].data
        strides = []
        while at < self.limit:
            strides.append(at)
            at = eight[at]
        places = np.array(strides, np.int32)
        for jump in (four, two, one):
            places = np.stack((places, jump[places]), axis=1).ravel()
        places = places[: places.searchsorted(self.limit)]
        upto = run[places].cumsum()
        last = int(upto.searchsorted(n))
        if last < len(places):
            return places[: last + 1], int(one[places[last]]), int(upto[last])
        return places, int(one[places[-1]]), int(upto[-1])

    def read(self, g: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of symbols at some positions: the green symbol; the pixel, cache index or distance code; the pixels that it gives."""
        green, red, blue, alpha, distance = self.groups[g]
        symbol, end = self.look(green, at)
        value = np.maximum(symbol - 280, 0).astype(np.uint32)
        run = np.ones(len(at), np.int32)
        plain = (symbol < 256).nonzero()[0]
        r, after = self.look(red, end[plain])
        b, after = self.look(blue, after)
        a, _ = self.look(alpha, after)
        value[plain] = a.astype(np.uint32) << np.uint32(24) | r.astype(np.uint32) << np.uint32(16) | symbol[plain].astype(np.uint32) << np.uint32(8) | b.astype(np.uint32)
        if (back := ((symbol >= 256) & (symbol < 280)).nonzero()[0]).size:
            run[back], after = self.span(symbol[back] - 256, end[back])
            code, after = self.look(distance, after)
            value[back] = self.span(code, after)[0]
        return symbol, value, run


@lru_cache(maxsize=16)
def _near(width: int) -> np.ndarray:
    """Distances in pixels of the 120 codes for near pixels."""
    return np.array([0, *(max(1, dx + dy * width) for dx, dy in NEAR)], np.int64)


def _root(to: np.ndarray) -> np.ndarray:
    """Where each place's references end, by doubling."""
    while not np.array_equal(further := to[to], to):
        to = further
    return to


def _hash(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return (pixels * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)


def _place(out: np.ndarray, start: int, symbol: np.ndarray, value: np.ndarray, run: np.ndarray, width: int, cache: np.ndarray, cache_bits: int) -> int:
    """Write the pixels that some symbols give from ``start`` on; where they end.

    Literals are placed at once, then stretches are copied in order.  With a
    cache, references and cache codes are pointers to earlier pixels, all followed
    at once; ``cache`` holds the colours before ``start`` and is brought up to date.
    """
    first = np.cumsum(run) - run
    n = int(run.sum())
    pixels = np.zeros(n, np.uint32)
    to = np.arange(n) if cache_bits else None
    plain = symbol < 256
    pixels[first[plain]] = value[plain]
    back = ((symbol >= 256) & (symbol < 280)).nonzero()[0]
    if len(back):
        far = value[back].astype(np.int64)
        far = np.where(far > 120, far - 120, _near(width)[np.minimum(far, 120)])
        if (far > start + first[back]).any() or start + n > len(out):
            raise ValueError("a back-reference leaves the image")
        if not cache_bits:
            out[start : start + n] = pixels
            view = out.data
            for i, d, m in zip((start + first[back]).tolist(), far.tolist(), run[back].tolist(), strict=True):
                while m > d:  # the copy meets itself: what stands there doubles
                    view[i : i + d] = view[i - d : i]
                    i, m, d = i + d, m - d, 2 * d
                view[i : i + m] = view[i - d : i - d + m]
            return start + n
        each = run[back]
        place = np.arange(int(each.sum())) + np.repeat(first[back] - (np.cumsum(each) - each), each)
        source = place - np.repeat(far, each)
        inside = source >= 0
        to[place[inside]] = source[inside]
        pixels[place[~inside]] = out[start + source[~inside]]
        to = _root(to)
    if cache_bits:
        coded = first[symbol >= 280]
        slot = _hash(pixels, cache_bits)
        slot[coded] = value[symbol >= 280]
        slot = slot[to]
        order = np.argsort(slot, kind="stable")
        same = np.flatnonzero(slot[order[1:]] == slot[order[:-1]])
        before = np.full(n, -1)
        before[order[1:][same]] = order[:-1][same]
        fresh = coded[before[coded] < 0]
        pixels[fresh] = cache[slot[fresh]]
        if ((pixels[fresh] == 0) & (slot[fresh] > 0)).any():
            raise ValueError("a colour cache code before its colour")
        coded = coded[before[coded] >= 0]
        link = np.arange(n)
        link[coded] = to[before[coded]]
        to = _root(link)[to]
        pixels = pixels[to]
        cache[slot] = pixels
    out[start : start + n] = pixels
    return start + n


def _pixels(bits: Bits, groups: list[list[PrefixCode]], meta: list[int] | None, shift: int, width: int, n: int, cache_bits: int) -> np.ndarray:
    """The pixels of an image: symbols are found by following next positions, then all placed at once."""
    out, cache = np.zeros(n, np.uint32), np.zeros(1 << cache_bits, np.uint32)
    green = groups[0][0]
    if len(groups) == 1 and not green.width and (green.symbol[0] >= 256 or not any(c.width for c in groups[0][1:4])):
        # No pixel takes a bit: all are the one colour, or what an empty cache holds.
        if 256 <= green.symbol[0] < 280:
            raise ValueError("a back-reference leaves the image")
        if green.symbol[0] < 256:
            a, r, g, b = (int(groups[0][k].symbol[0]) for k in (3, 1, 0, 2))
            out[:] = a << 24 | r << 16 | g << 8 | b
        return out
    across, i, position = -(-width >> shift), 0, bits.position
    while i < n:
        segment = _Segment(bits.data, position >> 3, groups)
        origin, at, limit, start = position & ~7, position & 7, segment.limit, i
        places: list[int] | np.ndarray = []
        owners: list[int] = []
        if meta is None:
            places, at, gives = segment.follow(at, n - i)
            i += gives
        while i < n and at < limit and meta is not None:
            y, x = divmod(i, width)
            g = meta[(y >> shift) * across + (x >> shift)]
            after, run = segment.step(g)
            places.append(at)
            owners.append(g)
            i += int(run[at])
            at = int(after[at])
        position = origin + at
        if position > 8 * len(bits.data):
            raise ValueError("the image data are cut short")
        where = np.asarray(places, np.int32)
        if meta is None:
            found = segment.read(0, where)
        else:
            found = tuple(np.zeros(len(where), kind) for kind in (np.int32, np.uint32, np.int32))
            whose = np.array(owners)
            for g in np.unique(whose).tolist():
                chosen = whose == g
                for whole, part in zip(found, segment.read(g, where[chosen]), strict=True):
                    whole[chosen] = part
        if found[0].max(initial=0) >= 280 and not cache_bits:
            raise ValueError("a colour cache code without its cache")
        if _place(out, start, *found, width, cache, cache_bits) != i or i > n:
            raise ValueError("a back-reference leaves the image")
    bits.seek(position)
    return out


def _few_pixels(bits: Bits, group: list[PrefixCode], n: int) -> np.ndarray | None:
    """A small image of literals only, one by one; None where there is another symbol."""
    green, red, blue, alpha, _ = group
    out = []
    for _ in range(n):
        if (g := green.read(bits)) >= 256:
            return None
        r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
        out.append(a << 24 | r << 16 | g << 8 | b)
    return np.array(out, np.uint32)


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image: ARGB values, row by row."""
    n = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = ((read_image(bits, -(-width >> shift), -(-height >> shift)) >> 8) & 0xFFFF).tolist()
    size = 1 << cache_bits if cache_bits else 0
    groups = []
    for _ in range(max(meta) + 1 if meta else 1):
        groups.append([read_code(bits, a) for a in (280 + size, 256, 256, 256, 40)])
        bits.check()
    if meta is None and n <= 256:
        start = bits.position
        if (few := _few_pixels(bits, groups[0], n)) is not None:
            bits.check()
            return few
        bits.seek(start)
    return _pixels(bits, groups, meta, shift, width, n, cache_bits)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = (channels & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray | int:
    """A mode's guess from the channels of the pixels to the left, above, above right and above left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return (((left + right) >> 1) + top) >> 1
    if mode == 6:
        return (left + corner) >> 1
    if mode == 7:
        return (left + top) >> 1
    if mode == 8:
        return (corner + top) >> 1
    if mode == 9:
        return (top + right) >> 1
    if mode == 10:
        return (((left + corner) >> 1) + ((top + right) >> 1)) >> 1
    if mode == 11:  # the plane through the three has left's distance |top - corner|, and top's |left - corner|
        to_left, to_top = np.abs(top - corner).sum(axis=-1, keepdims=True), np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = (left + top) >> 1
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int32), 0, 255)
    return np.array([255, 0, 0, 0], np.int32)


def undo_predictor(argb: np.ndarray, width: int, height: int, shift: int, modes: np.ndarray) -> np.ndarray:
    """Add the guesses back, wave by wave: pixels of equal x + 2 y need none of each other."""
    across = -(-width >> shift)
    kinds = ((modes >> 8) & 0xF).astype(np.int64)
    out = _channels(argb)
    out[0] = (out[0] + (255, 0, 0, 0)) & 0xFF
    out[1:width] = (np.cumsum(out[:width], axis=0)[1:]) & 0xFF
    for wave in range(2, width + 2 * height - 2):
        y = np.arange(max(1, (wave - width + 2) // 2), min(height - 1, wave // 2) + 1)
        x = wave - 2 * y
        here = y * width + x
        # Right of the last pixel of the row above comes the first of this row.
        left, top, right, corner = out[here - 1], out[here - width], out[here - width + 1], out[here - width - 1]
        kind = np.where(x == 0, 2, kinds[(y >> shift) * across + (x >> shift)])
        for mode in np.unique(kind).tolist():
            own = kind == mode
            guess = _predict(mode, left[own], top[own], right[own], corner[own])
            out[here[own]] = (out[here[own]] + guess) & 0xFF
    return _packed(out)


def undo_cross_color(argb: np.ndarray, width: int, height: int, shift: int, elements: np.ndarray) -> np.ndarray:
    across = -(-width >> shift)
    y, x = np.divmod(np.arange(width * height), width)
    e = _channels(elements)[(y >> shift) * across + (x >> shift)].astype(np.int8).astype(np.int32)
    c = _channels(argb)
    green = c[:, 2].astype(np.int8).astype(np.int32)
    c[:, 1] += (e[:, 3] * green) >> 5
    red = (c[:, 1] & 0xFF).astype(np.int8).astype(np.int32)
    c[:, 3] += ((e[:, 2] * green) >> 5) + ((e[:, 1] * red) >> 5)
    return _packed(c)


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    green = (argb >> np.uint32(8)) & np.uint32(0xFF)
    both = (argb & np.uint32(0xFF00FF)) + green * np.uint32(0x10001)
    return (argb & np.uint32(0xFF00FF00)) | (both & np.uint32(0xFF00FF))


def undo_palette(argb: np.ndarray, width: int, height: int, packing: int, palette: np.ndarray) -> np.ndarray:
    per, size = 1 << packing, 8 >> packing
    index = (argb >> 8) & 0xFF
    index = ((index[:, None] >> (np.arange(per, dtype=np.uint32) * size)) & ((1 << size) - 1)).reshape(height, -1)[:, :width].ravel()
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


#: Pixels of the largest image that is decoded where no other limit is given.
MOST_PIXELS = 1 << 26


def decode_image(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[np.ndarray, int]:
    """The first image in ``data`` as (height, width) ARGB values, and the bytes that it takes.

    Raises ValueError for whatever isn't a whole lossless image, and for one of
    more than ``most_pixels``, before memory is taken for it.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    total = 8 + int.from_bytes(data[4:8], "little")
    if total > len(data):
        raise ValueError("the file is cut short")
    at = 12
    while at + 8 <= total and data[at : at + 4] != b"VP8L":
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + n + (n & 1)
    if data[at : at + 4] != b"VP8L" or data[at + 8 : at + 9] != b"\x2f":
        raise ValueError("no lossless image")
    bits = Bits(data[at + 9 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if width * height > most_pixels:
        raise ValueError(f"the image has more than {most_pixels} pixels")
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, across = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind == 2:
            undo.append((undo_subtract_green, ()))
        elif kind == 3:
            n = bits.read(8) + 1
            steps = _channels(read_image(bits, n, 1))
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((undo_palette, (across, height, packing, _packed(np.cumsum(steps, axis=0)))))
            across = -(-across >> packing)
        else:
            shift = bits.read(3) + 2
            image = read_image(bits, -(-across >> shift), -(-height >> shift))
            undo.append((undo_cross_color if kind else undo_predictor, (across, height, shift, image)))
    bits.check()
    pixels = read_image(bits, across, height, main=True)
    for f, args in reversed(undo):
        pixels = f(pixels, *args)
    return pixels.reshape(height, width), total


class _Out:
    """Collects bits, least significant first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.n
        self.n += n

    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8), bitorder="little")[: self.n]


def _huffman(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code, ``most`` at most; two symbols at least have one where any has a count."""
    used = counts.nonzero()[0].tolist()
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        up = [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            x, a = heapq.heappop(heap)
            y, b = heap[0]
            up[a] = up[b] = node
            heapq.heapreplace(heap, (x + y, node))
        depth = [0] * len(up)
        for k in range(len(up) - 2, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = [1 + w // 2 for w in weights]


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code, as it is written; 0 without one, or for a single symbol."""
    out = np.zeros(len(lengths), np.uint32)
    used = lengths.nonzero()[0]
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        width = int(lengths.max())
        spans = 1 << (width - lengths[order])
        out[order] = _reversed(width)[np.cumsum(spans) - spans]
    return out


def _declare(out: _Out, lengths: np.ndarray) -> None:
    if lengths is _NONE:
        out.put(1, 4)  # a single symbol, 0
        return
    used = lengths.nonzero()[0].tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1), out.put(len(used) - 1, 1), out.put(int(used[0] > 1), 1), out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    values = lengths[: used[-1] + 1]
    plain, at = values.tolist(), 0
    tokens: list[int] = []  # symbol and, above its five bits, what its extra bits say
    # Only stretches of zeros are put short.
    places = values.nonzero()[0]
    gaps = np.append(places[0], places[1:] - places[:-1] - 1)
    for k in (gaps >= 3).nonzero()[0].tolist():
        end, n = int(places[k]), int(gaps[k])
        tokens += plain[at : end - n]
        while n >= 3:
            symbol, least, most = (17, 3, 10) if n <= 10 else (18, 11, 138)
            tokens.append(symbol | (min(n, most) - least) << 5)
            n -= min(n, most)
        at = end - n
    tokens += plain[at:]
    wide = next(k for k in range(8) if len(tokens) - 2 < 1 << (2 + 2 * k))
    out.put(_LENGTHS_DECLARED.value, _LENGTHS_DECLARED.n), out.put(1, 1), out.put(wide, 3), out.put(len(tokens) - 2, 2 + 2 * wide)
    word, taken = 0, 0
    for t in tokens:
        symbol = t & 31
        word |= (_LENGTHS_CODES[symbol] | (t >> 5) << _LENGTHS_SIZES[symbol]) << taken
        taken += _LENGTHS_TAKEN[symbol]
    out.put(word, taken)


#: The code that lengths are written in: the sizes of 0 to 15 and of the stretches 16 to 18; 13 to 16 aren't used.
_LENGTHS_SIZES = (3, 7, 7, 6, 3, 3, 3, 3, 4, 4, 4, 4, 4, 0, 0, 0, 0, 6, 6)
_LENGTHS_CODES = _codes(np.array(_LENGTHS_SIZES)).tolist()
_LENGTHS_TAKEN = [size + extra for size, extra in zip(_LENGTHS_SIZES, [0] * 17 + [3, 7], strict=True)]
_LENGTHS_DECLARED = _Out()
_LENGTHS_DECLARED.put(0, 1)
_LENGTHS_DECLARED.put(15, 4)  # all 19 follow
for _size in (_LENGTHS_SIZES[c] for c in LENGTH_ORDER):
    _LENGTHS_DECLARED.put(_size, 3)


#: Bits of a symbol at most.
LONGEST = 12
#: Pixels among which repeats are sought and written at once, and the shortest repeat that is written as one.
BLOCK = 1 << 18
SHORTEST = 5
_PLACE, _PLACES = np.uint64(18), np.arange(BLOCK, dtype=np.uint64)


def _repeats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where repeats start, their lengths and distances: greedy, each against the last place of its first values.

    A repeat goes on as long as the last places do so side by side.
    """
    n = len(x) - SHORTEST + 1
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    # The first values and the place in one number, so that one sort brings equal ones together in order.
    key = x[:n].astype(np.uint64)
    for k in range(1, SHORTEST):
        key <<= np.uint64(8)
        key |= x[k : k + n]
    key <<= _PLACE
    key |= _PLACES[:n]
    key.sort()
    place = (key & np.uint64(BLOCK - 1)).astype(np.int64)
    key >>= _PLACE
    again = (key[1:] == key[:-1]).nonzero()[0]
    far = np.zeros(n, np.int64)
    later = place[1:][again]
    far[later] = later - place[:-1][again]
    where = far.nonzero()[0]
    if not len(where):
        return where, where, where
    # The last place of a stretch of equal distances ends its repeats.
    change = far[1:] != far[:-1]
    ends = np.append(change.nonzero()[0], n - 1)
    stretch = np.zeros(n, np.int64)
    change.cumsum(out=stretch[1:])
    length = np.minimum(ends[stretch[where]] - where + SHORTEST, 4096)
    # How many of ``where`` come before each place.
    before = np.zeros(n + SHORTEST, np.int64)
    (far > 0).cumsum(out=before[1 : n + 1])
    before[n + 1 :] = before[n]
    following = before[where + length].tolist()
    chosen, at = [], 0
    end = len(following)
    while at < end:
        chosen.append(at)
        at = following[at]
    starts = where[chosen]
    return starts, length[chosen], far[starts]


def _spans(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length or distance codes of values from 1, the numbers of their extra bits, and those."""
    code = _LEAST.searchsorted(values, side="right") - 1
    return code, _EXTRA[code], (values - _LEAST[code]).astype(np.uint32)


@lru_cache(maxsize=16)
def _near_codes(width: int) -> np.ndarray:
    """Distance in pixels to the least of the 120 codes that means it; 0 for none."""
    near = _near(width)
    out = np.zeros(int(near.max()) + 1, np.int64)
    out[near[:0:-1]] = np.arange(120, 0, -1)
    return out


def _symbols(x: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """A block's values as symbols: green, then of the references the extra bits of lengths, distance codes and theirs."""
    starts, lengths, back = _repeats(x)
    green = x.astype(np.int32)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return green, none, none, none, none, none
    code, n_length, length = _spans(lengths)
    near = _near_codes(width)
    short = near[np.minimum(back, len(near) - 1)] * (back < len(near))
    distance, n_far, far = _spans(np.where(short > 0, short, back + 120))
    green[starts] = 256 + code
    edge = np.zeros(len(x) + 1, np.int8)
    edge[starts + 1] += 1
    edge[starts + lengths] -= 1  # no two repeats end at one place
    return green[np.cumsum(edge[:-1]) == 0], n_length, length, distance, n_far, far


def _packed_bits(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = sizes.cumsum()
    place = np.arange(int(ends[-1]) if len(ends) else 0) - (ends - sizes).repeat(sizes)
    return ((values.repeat(sizes) >> place.astype(np.uint32)) & np.uint32(1)).astype(np.uint8)


def _palette(out: _Out, values: np.ndarray, blank: bool) -> int:
    """Declare a palette of green values, and of a transparent one if ``blank``; how many times entries share a pixel, as a power of two."""
    entries = len(values) + blank
    out.put(1, 1), out.put(3, 2), out.put(entries - 1, 8)
    green = np.diff(np.array([*values, *[0] * blank]), prepend=0) & 255
    alpha = np.diff(np.array([255] * len(values) + [0] * blank), prepend=0) & 255
    own = [_huffman(np.bincount(v, minlength=n), LONGEST) for v, n in ((green, 280), (alpha, 256))]
    out.put(0, 1)
    for lengths in (own[0], _NONE, _NONE, own[1], _NONE):
        _declare(out, lengths)
    codes = [(_codes(v).tolist(), v.tolist() if np.count_nonzero(v) > 1 else [0] * len(v)) for v in own]
    for g, a in zip(green.tolist(), alpha.tolist(), strict=True):
        out.put(codes[0][0][g], codes[0][1][g]), out.put(codes[1][0][a], codes[1][1][a])
    return 3 if entries <= 2 else 2 if entries <= 4 else 1 if entries <= 16 else 0


_NONE = np.zeros(256, np.int64)
_OPAQUE = np.eye(1, 256, 255, dtype=np.int64)[0]


def encode_image(samples: np.ndarray, blank: int = 0) -> bytes:
    """A lossless WebP of (height, width) 8-bit samples as grey pixels; the last ``blank`` are transparent instead.

    Subtract-green leaves one channel.  Where values are few, or some pixels
    transparent, a palette takes several to a pixel.  Repeats become
    back-references, and all are written under prefix codes of their counts.  Other
    transforms and a colour cache don't make one channel shorter, as a literal is
    one symbol already.
    """
    height, width = samples.shape
    index = samples.ravel()
    values = np.flatnonzero(np.bincount(index[: len(index) - blank], minlength=256))
    out = _Out()
    for x, n in ((width - 1, 14), (height - 1, 14), (int(blank > 0), 1), (0, 3)):
        out.put(x, n)
    out.put(1, 1), out.put(2, 2)  # subtract green
    alpha = _OPAQUE
    if blank or len(values) <= 16:
        if len(values) + bool(blank) > 256:
            raise ValueError("no palette has room for all values and a transparent one")
        place = np.zeros(256, np.uint8)
        place[values] = np.arange(len(values))
        index = place[index]
        index[len(index) - blank :] = len(values)
        alpha, packing = _NONE, _palette(out, values, blank > 0)
        if packing:
            across = -(-width >> packing)
            rows = np.zeros((height, across << packing), np.uint8)
            rows[:, :width] = index.reshape(height, width)
            index = (rows.reshape(-1, 1 << packing) << (np.arange(1 << packing, dtype=np.uint8) * (8 >> packing))).sum(axis=1, dtype=np.uint8)
            width = across
    out.put(0, 1)  # no more transforms
    out.put(0, 1), out.put(0, 1)  # no cache, no meta codes
    blocks = [_symbols(index[i : i + BLOCK], width) for i in range(0, len(index), BLOCK)]
    counts = [sum(np.bincount(block[k], minlength=n) for block in blocks) for k, n in ((0, 280), (3, 40))]
    lengths = [_huffman(c, LONGEST) for c in counts]
    for v in (lengths[0], _NONE, _NONE, alpha, lengths[1]):
        _declare(out, v)
    greens, distances = _codes(lengths[0]), _codes(lengths[1])
    sizes = [v if np.count_nonzero(v) > 1 else np.zeros_like(v) for v in lengths]
    parts, bits = [], out.bits()
    for symbol, n_length, length, distance, n_far, far in blocks:
        back = (symbol >= 256).nonzero()[0]
        # Three more values follow a reference.
        place = np.arange(len(symbol))
        if len(back):
            place[1:] += 3 * (symbol[:-1] >= 256).cumsum()
        written, taken = np.zeros(len(symbol) + 3 * len(back), np.uint32), np.zeros(len(symbol) + 3 * len(back), np.int64)
        written[place], taken[place] = greens[symbol], sizes[0][symbol]
        for k, v, n in ((1, length, n_length), (2, distances[distance], sizes[1][distance]), (3, far, n_far)):
            written[place[back] + k], taken[place[back] + k] = v, n
        bits = np.concatenate((bits, _packed_bits(written, taken)))
        whole = len(bits) & ~7
        parts.append(np.packbits(bits[:whole], bitorder="little").tobytes())
        bits = bits[whole:]
    data = b"".join([b"\x2f", *parts, np.packbits(bits, bitorder="little").tobytes()])
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


#: Samples across a row of a stored payload, or a multiple of it where the rows would be too many.
ROW = 192
#: Samples in one image at most.
PART = MOST // ROW * ROW * MOST


def store(text: str | None) -> bytes:
    """A text as one lossless image of a grey pixel for each byte; null counts as empty.

    The samples are its UTF-8 bytes, with spaces up to a positive multiple of
    ROW.  Rows are as much wider as keeps them to MOST in number; what is left of
    the last row is transparent then.  A text of over PART bytes (267 million)
    takes several images, laid end to end.
    """
    raw = (text or "").encode()
    payload = np.frombuffer(raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW)), np.uint8)
    out = []
    for i in range(0, len(payload), PART):
        part = payload[i : i + PART]
        width = ROW * -(-len(part) // (ROW * MOST))
        blank = -len(part) % width
        out.append(encode_image(np.pad(part, (0, blank)).reshape(-1, width), blank))
    return b"".join(out)


def load(media: bytes, most_pixels: int = MOST_PIXELS) -> list[np.ndarray]:
    """All images of a cell as ARGB arrays."""
    out, at = [], 0
    while at < len(media):
        image, n = decode_image(media[at:] if at else media, most_pixels)
        out.append(image)
        at += n
    return out


def samples(image: np.ndarray) -> np.ndarray:
    """The samples that ``store`` made an image of: green of the pixels that aren't transparent."""
    flat = image.ravel()
    return (flat[flat >> np.uint32(24) == 255] >> np.uint32(8)).astype(np.uint8)


def describe(payload: np.ndarray) -> str:
    """Rows of ROW samples: width, height, sum, and a 64-bit hash of block brightness."""
    light = payload.reshape(-1, ROW)
    height = len(light)
    rows = np.add.reduceat(light, np.arange(8) * height // 8 if height >= 8 else np.minimum(np.arange(8), height - 1), axis=0, dtype=np.int64)
    blocks = np.add.reduceat(rows, np.arange(8) * ROW // 8, axis=1)
    mark = int.from_bytes(np.packbits(blocks * 64 > blocks.sum()).tobytes(), "big")
    return f"{ROW}x{height};{light.sum(dtype=np.int64)};{mark:016x}"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each row's text and its UTF-8 size, as lossless WebP; see ``store``.  Narrow, row by row."""

    def run(_: None, x: dict) -> dict:
        return {"id": x["id"], "n_bytes": [len((t or "").encode()) for t in x["text"]], "media": [store(t) for t in x["text"]]}

    rows = keyed(docs, id_col, text_col)
    return map_columns(rows, run, f"id {kind_of(rows, 'id')}, n_bytes bigint, media binary")


def map_images(media: DataFrame, fn: Callable[[bytes, list[np.ndarray]], dict], schema: str, keep: Sequence[str] = ("id",), media_col: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """``keep``, the columns of ``schema`` that ``fn`` makes of each cell and its decoded images, and ``error``.

    Null and empty cells have nulls; broken ones too, and the reason as
    ``error``.  Other rows are not affected.  Narrow, row by row.
    """
    names = [f.split()[0] for f in re.split(r",\s*(?![^<]*>)", schema)]

    def run(_: None, x: dict) -> dict:
        out: dict = {k: x[k] for k in keep} | {n: [] for n in (*names, "error")}
        for data in x["media"]:
            row: dict = {}
            try:
                if data:
                    row = fn(data, load(data, most_pixels))
            except (ValueError, IndexError) as e:
                row = {"error": str(e)}
            for name in (*names, "error"):
                out[name].append(row.get(name))
        return out

    rows = media.select(*keep, F.col(media_col).alias("media"))
    kept = "".join(f"{k} {kind_of(rows, k)}, " for k in keep)
    return map_columns(rows, run, f"{kept}{schema}, error string")


def decode_media(media: DataFrame, id_col: str = "id", media_col: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """``id, images, error``: a media column's pixel arrays, an element for each image in a cell.

    An image has its ``width``, ``height`` and ``argb``, a value for each pixel,
    row by row (alpha in the highest byte; as a signed number).  An image of over
    ``most_pixels`` is an error.  Null, empty and broken media as in ``map_images``.
    """

    def whole(_: bytes, images: list[np.ndarray]) -> dict:
        return {"images": [{"width": i.shape[1], "height": i.shape[0], "argb": i.ravel().view(np.int32)} for i in images]}

    source = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return map_images(source, whole, "images array<struct<width:int,height:int,argb:array<int>>>", most_pixels=most_pixels)


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as lossless WebP and read back from it."""

    def digest(media: bytes, images: list[np.ndarray]) -> dict:
        payload = np.concatenate([samples(i) for i in images])
        raw = payload.tobytes()
        return {
            "payload_bytes": len(raw),
            "payload_sha256": hashlib.sha256(raw).hexdigest(),
            "tail_crc32": zlib.crc32(raw[-16:]),
            "media_bytes": len(media),
            "media_sha256": hashlib.sha256(media).hexdigest(),
            "feature": describe(payload),
        }

    media = store_media(read(spark, sf_dir, "documents"))
    schema = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_images(media, digest, schema, ("id", "n_bytes"), most_pixels=PART).withColumnRenamed("id", "doc_id").drop("error")
