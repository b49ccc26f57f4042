"""Lossless WebP in numpy: a decoder for every feature of the bit stream and an encoder to store bytes with.

Decoding vectorises what is usually a bit-by-bit loop: the symbol and length that would be read are looked
up for every bit position at once, four lookups are composed into "where does the next pixel begin", and
only that chain is followed one pixel at a time. Back-references and colour-cache codes stop the chain and
are read singly.
"""

from __future__ import annotations

import heapq
import struct
from bisect import bisect_left
from functools import cached_property, lru_cache
from itertools import groupby, repeat

import numpy as np

# Fixed values of the bit stream format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_MULTIPLIER = 0x1E35A7BD
NEAR = 120
LENGTH_CODES, DISTANCE_CODES = 24, 40
MAX_SIDE = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


def _near_offsets() -> list[tuple[int, int]]:
    """The offsets (x to the left, y up) of the short distance codes: by distance, then by the larger side, then left before right."""
    cells = [(x, y) for y in range(8) for x in range(-7, 9) if (y > 0 or x > 0) and (y or x)]
    return sorted(cells, key=lambda c: (c[0] ** 2 + c[1] ** 2, abs(c[0]), -c[0]))[:NEAR]


class Bad(ValueError):
    """Not a lossless WebP stream."""


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(16), 0, 8 * len(data)

    def read(self, n: int) -> int:
        byte, self.at = self.at >> 3, self.at + n
        if self.at > self.end:
            raise Bad("the stream ends early")
        return int.from_bytes(self.data[byte : byte + 8], "little") >> ((self.at - n) & 7) & ((1 << n) - 1)

    def ahead(self, n: int) -> int:
        """The next n bits, without moving on."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)


@lru_cache(maxsize=16)
def _reversed(n: int) -> np.ndarray:
    """Every number of n bits with its bits in the other order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def _canonical(lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, lengths and codes as they stand in the stream (lowest bit first) of a complete code, by length; one symbol alone has no bits."""
    lengths = np.asarray(lengths, np.int64)
    symbols = np.flatnonzero(lengths)
    if len(symbols) < 2:
        return symbols, 0 * symbols, 0 * symbols
    own = lengths[symbols]
    order = np.argsort(own, kind="stable")
    symbols, own = symbols[order], own[order]
    shares = 1 << 15 - own
    ends = np.cumsum(shares)
    if ends[-1] != 1 << 15:
        raise Bad("a prefix code isn't complete")
    return symbols, own, _reversed(15)[ends - shares]


class Code:
    """A prefix code as a table over the next ``bits`` bits: symbol << 4 | length."""

    def __init__(self, lengths):
        symbols, own, _ = _canonical(lengths)
        self.bits = int(own.max(initial=0))
        self.table = np.repeat((symbols << 4 | own).astype(np.int32), 1 << self.bits - own) if len(symbols) else np.zeros(1, np.int32)
        self.table = self.table[_reversed(self.bits)]
        self.lengths = (self.table & 15).astype(np.int64)
        self.longer = bool((symbols >= 256).any())

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.table[0]) >> 4
        found = int(self.table[int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 4], "little") >> (bits.at & 7) & ((1 << self.bits) - 1)])
        bits.at += found & 15
        return found >> 4


def _small_table(lengths: list[int]) -> tuple[list[int], int]:
    """``Code.table`` and its bits, for the few symbols of code lengths."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [used[0][1] << 4 if used else 0], 0
    width = used[-1][0]
    table, code, reverse = [0] * (1 << width), 0, _reversed(width).tolist()
    for n, s in used:
        if code >= 1 << width:
            raise Bad("a prefix code isn't complete")
        table[reverse[code] :: 1 << n] = [s << 4 | n] * (1 << width - n)
        code += 1 << width - n
    if code != 1 << width:
        raise Bad("a prefix code isn't complete")
    return table, width


def _read_lengths(bits: Bits, alphabet: int) -> tuple[int, ...]:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        lengths = [0] * max(alphabet, 256)
        for s in symbols:
            lengths[s] = 1
        return tuple(lengths)
    own = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    table, width = _small_table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, last = [], 8
    mask = (1 << width) - 1
    here = bits.at
    ahead = int.from_bytes(bits.data[here >> 3 : (here >> 3) + 14 * alphabet // 8 + 16], "little") >> (here & 7)  # 14 bits a symbol at most
    while len(lengths) < alphabet and left:
        left -= 1
        found = table[ahead & mask]
        n, used = found >> 4, found & 15
        ahead >>= used
        if n < 16:
            lengths.append(n)
            last = n or last
        else:
            value, extra, least = (last, 2, 3) if n == 16 else (0, 3, 3) if n == 17 else (0, 7, 11)
            lengths += [value] * (least + (ahead & ((1 << extra) - 1)))
            ahead >>= extra
            used += extra
        here += used
    bits.at = here
    if here > bits.end:
        raise Bad("the stream ends early")
    if len(lengths) > alphabet:
        raise Bad("too many code lengths")
    return tuple(lengths + [0] * (alphabet - len(lengths)))


def _prefixed(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


class _Group:
    """Five prefix codes; for every bit position: where a literal pixel that starts there ends (0: it is no literal)."""

    def __init__(self, bits: Bits, cache_size: int):
        made: dict[tuple, Code] = {}  # channels often have the same code
        self.codes, before, first, size = [], 0, 0, 0
        for alphabet in (256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES):
            at = bits.at
            if alphabet == before and at + size <= bits.end and bits.ahead(size) == first:  # the header of the channel before, bit for bit
                self.codes.append(self.codes[-1])
                bits.at += size
                continue
            lengths = _read_lengths(bits, alphabet)
            key = lengths[:256] if not any(lengths[256:]) else lengths
            if key not in made:
                made[key] = Code(lengths)
            self.codes.append(made[key])
            size, bits.at = bits.at - at, at
            before, first = alphabet, bits.ahead(size)
            bits.at = at + size

    def lookups(self, windows: np.ndarray, n: int) -> None:
        """windows: what follows every bit position; the last 64 serve only to look beyond the n positions asked for."""
        by_code: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.found, self.steps = [], []
        for code in self.codes[:4]:
            if id(code) not in by_code:
                index = windows & ((1 << code.bits) - 1)
                by_code[id(code)] = index, code.lengths.take(index)
            index, step = by_code[id(code)]
            self.found.append((code.table, index))
            self.steps.append(step)
        ends = np.arange(n) + self.steps[0][:n]
        for step in self.steps[1:]:
            ends += step.take(ends)
        if self.codes[0].longer:
            ends = np.where(self.codes[0].table[self.found[0][1][:n]] >> 4 < 256, ends, -1)
        self.ends = memoryview(ends)

    def literals(self, at: np.ndarray) -> np.ndarray:
        """ARGB of the literal pixels that start at these places."""
        out = []
        for (table, index), step in zip(self.found, self.steps, strict=True):
            out.append((table[index[at]] >> 4).astype(np.uint32))
            at = at + step[at]
        g, r, b, a = out
        return a << 24 | r << 16 | g << 8 | b


def _read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as ARGB, without its transforms."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Bad("colour cache")
    which = tile_bits = None
    if top and bits.read(1):
        tile_bits = bits.read(3) + 2
        across = -(-width >> tile_bits)
        which = (_read_pixels(bits, across, -(-height >> tile_bits), False) >> 8 & 0xFFFF).tolist()
    groups = [_Group(bits, 1 << cache_bits if cache_bits else 0) for _ in range(max(which) + 1 if which else 1)]
    if top or width * height > 64:
        end = bits.end
    else:  # a small image within the stream: no need to look at all that follows
        end = min(bits.end, bits.at + width * height * 75 + 64)
    base = bits.at & ~7
    n = end - base
    raw = np.frombuffer(bits.data, np.uint8, (n + 7 >> 3) + 10, base >> 3).astype(np.int64)
    three = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    windows = (three[:, None] >> np.arange(8)).reshape(-1) & 0x7FFF
    for g in groups:
        g.lookups(windows, n + 1)
    total, px, p = width * height, 0, bits.at
    starts: list[int] = []  # of literal pixels, in bits after base
    events: list[tuple[int, int, int]] = []  # (pixel, length, distance) or (pixel, 0, cache index)
    owners: list[int] | None = [] if which else None
    ends, codes = groups[0].ends, groups[0].codes
    here = p - base
    try:
        while px < total:
            if which:
                y, x = divmod(px, width)
                g = which[(y >> tile_bits) * across + (x >> tile_bits)]
                ends, codes = groups[g].ends, groups[g].codes
                if (q := ends[here]) >= 0:
                    starts.append(here)
                    owners.append(g)
                    px, here = px + 1, q
                    continue
            else:  # as many literals as follow one another
                before = len(starts)
                for _ in repeat(None, total - px):
                    if (q := ends[here]) < 0:
                        break
                    starts.append(here)
                    here = q
                px += len(starts) - before
                if px == total:
                    break
            bits.at = here + base
            s = codes[0].read(bits) - 256
            if s < LENGTH_CODES:
                n = _prefixed(bits, s)
                d = _prefixed(bits, codes[4].read(bits))
                if d > NEAR:
                    d -= NEAR
                else:
                    x, y = OFFSETS[d - 1]
                    d = max(1, x + y * width)
                if d > px or n > total - px:
                    raise Bad("a back-reference leaves the image")
                events.append((px, n, d))
                px += n
            else:
                events.append((px, 0, s - LENGTH_CODES))
                px += 1
            here = bits.at - base
    except IndexError:
        raise Bad("the stream ends early") from None
    bits.at = here + base
    if bits.at > bits.end:
        raise Bad("the stream ends early")
    at = np.array(starts, np.int64)
    if owners is None:
        literal = groups[0].literals(at)
    else:
        literal, own = np.zeros(len(at), np.uint32), np.array(owners)
        for k, g in enumerate(groups):
            literal[own == k] = g.literals(at[own == k])
    return literal if not events else _resolve(literal, events, total, cache_bits)


def _slots(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return (argb * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)


def _resolve(literal: np.ndarray, events: list[tuple[int, int, int]], total: int, cache_bits: int) -> np.ndarray:
    """Puts copies and cached colours between the literal pixels."""
    if cache_bits:
        return _resolve_cached(literal, events, total, cache_bits)
    out = np.zeros(total, np.uint32)
    taken = filled = 0
    for px, n, d in [*events, (total, 0, 0)]:
        out[filled:px] = literal[taken : taken + px - filled]
        taken += px - filled
        filled = px
        while n:  # a copy that overlaps itself repeats its first d pixels
            k = min(n, d)
            out[filled : filled + k] = out[filled - d : filled - d + k]
            filled, n = filled + k, n - k
    return out


def _resolve_cached(literal: np.ndarray, events: list[tuple[int, int, int]], total: int, cache_bits: int) -> np.ndarray:
    """With each pixel's slot beside it, since every pixel goes into the cache."""
    cache = [0] * (1 << cache_bits)
    literals, places = literal.tolist(), _slots(literal, cache_bits).tolist()
    out, slots, taken = [], [], 0

    def add(pixels: list[int], where: list[int]) -> None:
        out.extend(pixels)
        slots.extend(where)
        for s, p in zip(where, pixels, strict=True):
            cache[s] = p

    for px, n, d in [*events, (total, -1, 0)]:
        k = px - len(out)
        if k:
            add(literals[taken : taken + k], places[taken : taken + k])
            taken += k
        if n > 0:
            while n:
                at = len(out) - d
                k = min(n, d)
                add(out[at : at + k], slots[at : at + k])
                n -= k
        elif n == 0:
            add([cache[d]], [(cache[d] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)])
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> list[np.ndarray]:
    return [(argb >> s & 0xFF).astype(np.int32) for s in (24, 16, 8, 0)]


def _argb(channels) -> np.ndarray:
    a, r, g, b = ((c & 0xFF).astype(np.uint32) for c in channels)
    return a << 24 | r << 16 | g << 8 | b


def _cross_colour(argb: np.ndarray, elements: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes off (-1) what green and red say about red and blue; elements: one per pixel."""
    signed = lambda x: x.astype(np.int8).astype(np.int32)
    a, r, g, b = _channels(argb)
    _, red_to_blue, green_to_blue, green_to_red = (signed(c) for c in _channels(elements))
    red = (r + sign * (green_to_red * signed(g) >> 5)) & 0xFF
    blue = b + sign * ((green_to_blue * signed(g) >> 5) + (red_to_blue * signed(red if sign > 0 else r) >> 5))
    return _argb((a, red, g, blue))


def _subtract_green(argb: np.ndarray, sign: int) -> np.ndarray:
    a, r, g, b = _channels(argb)
    return _argb((a, r + sign * g, g, b + sign * g))


def _predict(mode: int, left, top, top_left, top_right):
    """The predicted channels; scalars' rows or whole arrays of shape (..., 4)."""
    half = lambda x, y: (x + y) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left, to_top = abs(top - top_left).sum(-1, keepdims=True), abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        d = mean - top_left
        return np.clip(mean + np.sign(d) * (abs(d) >> 1), 0, 255)
    return np.array([255, 0, 0, 0], np.int32)


NO_LEFT = {0, 2, 3, 4, 8, 9}


def _undo_predictor(argb: np.ndarray, width: int, height: int, modes: np.ndarray) -> np.ndarray:
    """modes: of each pixel, shape (height, width). Whole rows where no pixel looks left, else diagonals x + 2y, whose pixels don't look at one another."""
    image = np.stack(_channels(argb), -1).reshape(height, width, 4)
    image[0, 0] += [255, 0, 0, 0]
    image[0] = np.cumsum(image[0], axis=0) & 0xFF
    image[:, 0] = np.cumsum(image[:, 0], axis=0) & 0xFF
    # one row after another; the right neighbour above the last pixel of a row is the row's first one
    flat, own = image.reshape(-1, 4), modes.reshape(-1)

    def undo(at: np.ndarray) -> None:
        kinds = own[at]
        for m in np.unique(kinds).tolist():
            i = at[kinds == m]
            flat[i] = (flat[i] + _predict(m, flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])) & 0xFF

    if set(np.unique(modes[1:, 1:]).tolist()) <= NO_LEFT:
        for y in range(1, height):
            undo(np.arange(y * width + 1, (y + 1) * width))
    else:
        for t in range(3, width + 2 * height - 2):
            y = np.arange(max(1, (t - width + 2) // 2), min(height - 1, (t - 1) // 2) + 1)
            undo(y * width + t - 2 * y)
    return _argb(np.moveaxis(flat, -1, 0))


def _spread(tiles: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """A value per tile as a value per pixel."""
    across = -(-width >> bits)
    return tiles.reshape(-1, across)[np.arange(height) >> bits][:, np.arange(width) >> bits]


def _palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode(data: bytes) -> tuple[int, int, np.ndarray, int]:
    """width, height, RGBA samples (uint8), and the bytes that this image takes of ``data``."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Bad("no WebP")
    size, at = 8 + struct.unpack_from("<I", data, 4)[0], 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > min(size, len(data)):
            raise Bad("no lossless image")
        n = struct.unpack_from("<I", data, at + 4)[0]
        at += 8 + n + n % 2
    n = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + n])
    if bits.read(8) != 0x2F:
        raise Bad("signature")
    width, height, _ = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)  # whether alpha is used is a hint only
    if bits.read(3):
        raise Bad("version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == k for k, *_ in undo):
            raise Bad("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            undo.append((kind, now, tile, _read_pixels(bits, -(-now >> tile), -(-height >> tile), False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = np.stack(_channels(_read_pixels(bits, n, 1, False)))
            undo.append((kind, now, n, _argb(np.cumsum(steps, axis=1))))
            now = -(-now >> _palette_bits(n))
        else:
            undo.append((kind, now, 0, None))
    argb = _read_pixels(bits, now, height, True)
    for kind, width_then, a, b in reversed(undo):
        if kind == PREDICTOR:
            argb = _undo_predictor(argb, width_then, height, _spread(b >> 8 & 15, a, width_then, height))
        elif kind == CROSS_COLOUR:
            argb = _cross_colour(argb, _spread(b, a, width_then, height).reshape(-1), 1)
        elif kind == SUBTRACT_GREEN:
            argb = _subtract_green(argb, 1)
        else:
            per = _palette_bits(a)
            depth = 8 >> per
            green = (argb >> 8 & 0xFF).reshape(height, -1, 1)
            index = (green >> (np.arange(1 << per, dtype=np.uint32) * np.uint32(depth)) & ((1 << depth) - 1)).reshape(height, -1)[:, :width_then].reshape(-1)
            argb = np.concatenate([b, np.zeros(256, np.uint32)])[index]
    rgba = np.ascontiguousarray((argb << np.uint32(8) | (argb >> np.uint32(24))).astype(">u4")).view(np.uint8)
    return width, height, rgba, size + size % 2


def decode_all(media: bytes) -> tuple[int, int, bytes]:
    """width, rows and RGBA samples of images of one width that stand one after another."""
    parts, rows, width = [], 0, 0
    while media:
        width, height, rgba, size = decode(media)
        parts.append(rgba.tobytes())
        rows, media = rows + height, media[size:]
    return width, rows, b"".join(parts)


# ---- encoder ----


def code_lengths(counts: np.ndarray, most: int) -> list[int]:
    """Lengths of a complete prefix code, none over ``most``; counts are flattened until that holds."""
    lengths = [0] * len(counts)
    symbols = np.flatnonzero(counts).tolist()
    if len(symbols) < 2:
        for s in symbols:
            lengths[s] = 1
        return lengths
    weights = counts[symbols].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, k = [0] * (2 * len(heap)), len(heap)
        while len(heap) > 1:
            w, i = heap[0]
            heapq.heappop(heap)
            v, j = heap[0]
            parent[i] = parent[j] = k
            heapq.heapreplace(heap, (w + v, k))
            k += 1
        depth = [0] * k
        for i in range(k - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(weights)]) <= most:
            for i, s in enumerate(symbols):
                lengths[s] = depth[i]
            return lengths
        weights = [(w >> 1) | 1 for w in weights]


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _write_lengths(out: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    tokens, last = [], 8  # (symbol, extra, extra bits)
    for n, run in ((n, len(list(same))) for n, same in groupby(lengths)):
        while run:
            if not n and run >= 3:
                k = min(run, 138)
                tokens.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
            elif n == last and run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
            else:
                k = 1
                tokens.append((n, 0, 0))
                last = n or last
            run -= k
    counts = [0] * 19
    for s, *_ in tokens:
        counts[s] += 1
    own = code_lengths(np.array(counts), 7)
    codes = {s: (n, c) for s, n, c in zip(*(x.tolist() for x in _canonical(own)), strict=True)}
    order = [own[k] for k in CODE_LENGTH_ORDER]
    while len(order) > 4 and not order[-1]:
        order.pop()
    out.put(0, 1)
    out.put(len(order) - 4, 4)
    for n in order:
        out.put(n, 3)
    out.put(0, 1)
    value = at = 0
    for s, extra, bits in tokens:
        n, c = codes[s]
        value |= (c | extra << n) << at
        at += n + bits
    out.put(value, at)


def _prefix_of(value: int) -> tuple[int, int, int]:
    """prefix code, extra bits' value and number for a length or distance code from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def _pack(codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int]:
    """Bytes that hold all codes (of 15 bits at most), lowest bit first, one after another; and the bits in all."""
    ends = np.cumsum(lengths)
    at, total = ends - lengths, int(ends[-1])
    value, word, n = codes << (at & 31), at >> 5, (total >> 5) + 2
    packed = np.bincount(word, value & 0xFFFFFFFF, n)  # no two share a bit, so sums are unions
    packed[1:] += np.bincount(word, value >> 32, n)[:-1]
    return packed.astype("<u4").tobytes()[: total + 7 >> 3], total


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by key and place, and whether each but the first has the key of the one before; of a key the upper 44 bits count, mixed."""
    low = np.uint64(20)  # an image has fewer pixels
    mixed = key * np.uint64(0xD6E8FEB86659FD93) >> low << low
    order = np.sort(mixed | np.arange(len(key), dtype=np.uint64))
    same = order[1:] >> low == order[:-1] >> low
    return (order & np.uint64((1 << 20) - 1)).astype(np.int64), same


def _repeats(x: np.ndarray) -> int:
    """How many values occurred before."""
    x = np.sort(x)
    return int(np.count_nonzero(x[1:] == x[:-1]))


def _copies(argb: np.ndarray, least: int = 3, most: int = 4096) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs that stand at an earlier place too, from the first on; the latest earlier place of ``least`` pixels counts."""
    n = len(argb) - least + 1
    if n < 2:
        return []
    wide = argb.astype(np.uint64)
    key = wide[:n]
    for k in range(1, least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + wide[k : n + k]
    order, same = _groups(key)
    at, source = order[1:][same], order[:-1][same]
    for k in range(least):  # equal keys are nearly always equal pixels
        fine = argb[at + k] == argb[source + k]
        at, source = at[fine], source[fine]
    by_place = np.argsort(at)
    at, source = at[by_place], source[by_place]
    out, i, places, sources = [], 0, at.tolist(), source.tolist()
    while i < len(places):
        p, q, length, step = places[i], sources[i], least, 32
        while length < most and p + length < len(argb):
            step = min(step, len(argb) - p - length, most - length)
            differ = np.flatnonzero(argb[p + length : p + length + step] != argb[q + length : q + length + step])
            if len(differ):
                length += int(differ[0])
                break
            length, step = length + step, 2 * step
        out.append((p, length, p - q))
        i = bisect_left(places, p + length, i + 1)
    return out


#: n log2 n.
_WEIGHT = np.arange(1 << 16) * np.log2(np.maximum(np.arange(1 << 16), 1))


def _bits_of(counts: np.ndarray) -> float:
    """About how many bits the symbols take with a code of their own, and its header."""
    n = int(counts.sum())
    if n >= len(_WEIGHT):
        used = counts[counts > 0]
        return float((used * np.log2(n / used)).sum()) + 5 * len(used)
    return float(_WEIGHT[n] - _WEIGHT[counts].sum()) + 5 * int(np.count_nonzero(counts))


def _shared_bits(every: np.ndarray) -> float:
    """With one code for all channels, which is written four times; counts of all samples."""
    return _bits_of(every) + 15 * int(np.count_nonzero(every))


def _literal_bits(argb: np.ndarray) -> float:
    """About what the pixels take as literals, with one code for all channels or one for green."""
    samples = argb.view(np.uint8)
    every, green = np.bincount(samples, minlength=256), np.bincount(samples[1::4], minlength=256)
    rest = every - green
    return min(_shared_bits(every), _bits_of(green) + _bits_of(rest) + 10 * int(np.count_nonzero(rest)))


class _Tokens:
    """What stands for the pixels of an image: literals, cache codes and copies."""

    def __init__(self, argb: np.ndarray, width: int, copies: list[tuple[int, int, int]], cache_bits: int):
        self.n, self.copies, self.cache_bits, self.cached = len(argb), copies, cache_bits, np.zeros(0, np.int64)
        if copies or cache_bits:
            self._found(argb)
        else:
            self.literal = np.arange(self.n)
        near = {max(1, x + y * width): k for k, (x, y) in reversed(list(enumerate(OFFSETS, 1)))} if copies else {}
        self.places = np.array([p for p, *_ in copies], np.int64)
        self.lengths = np.array([_prefix_of(n) for _, n, _ in copies], np.int64).reshape(-1, 3)
        self.distances = np.array([_prefix_of(near.get(d, d + NEAR)) for *_, d in copies], np.int64).reshape(-1, 3)
        g, r, b, a = (argb[self.literal] >> np.uint32(s) & np.uint32(0xFF) for s in (8, 16, 0, 24))
        self.samples = [x.astype(np.int64) for x in (g, r, b, a)]
        green = np.bincount(self.samples[0], minlength=256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0))
        green += np.bincount(256 + self.lengths[:, 0], minlength=len(green))
        if cache_bits:
            green += np.bincount(256 + LENGTH_CODES + self.slots, minlength=len(green))
        # the other channels' codes are one, made for all of them
        rest = sum(np.bincount(x, minlength=256) for x in self.samples[1:])
        self.counts = [green, rest, np.bincount(self.distances[:, 0], minlength=DISTANCE_CODES)]

    def _found(self, argb: np.ndarray) -> None:
        """Which pixels are literals and which come from the cache."""
        single = np.ones(len(argb), bool)
        for p, n, _ in self.copies:
            single[p : p + n] = False
        hit = np.zeros(len(argb), bool)
        if self.cache_bits:
            slots = _slots(argb, self.cache_bits).astype(np.int64)
            order = np.sort(slots << 20 | np.arange(len(argb))) & ((1 << 20) - 1)
            again = (slots[order[1:]] == slots[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
            hit[order[1:][again]] = True  # what went into the slot last is this pixel
            self.cached = np.flatnonzero(single & hit)
            self.slots = slots[self.cached]
        self.literal = np.flatnonzero(single & ~hit)

    @cached_property
    def size(self) -> float:
        """In bits, about."""
        extra = int(self.lengths[:, 2].sum() + self.distances[:, 2].sum())
        headers = 2 * 5 * int(np.count_nonzero(self.counts[1]))  # the code of three channels is written three times
        return sum(map(_bits_of, self.counts)) + headers + extra

    def _mixed(self, tables: list[np.ndarray]) -> np.ndarray:
        """Codes and their lengths in their order: a literal has four, a copy five, a cached colour one."""
        each = np.zeros(self.n, np.int64)
        each[self.literal], each[self.cached], each[self.places] = 4, 1, 5
        ends = np.cumsum(each)
        begin = ends - each
        codes = np.zeros((int(ends[-1]), 2), np.int64)
        at = begin[self.literal]
        for nth, x in enumerate(self.samples):
            codes[at + nth] = tables[min(nth, 1)][x]
        if self.cache_bits:
            codes[begin[self.cached]] = tables[0][256 + LENGTH_CODES + self.slots]
        if len(self.places):
            at, low = begin[self.places], np.minimum(self.distances[:, 2], 12)
            codes[at] = tables[0][256 + self.lengths[:, 0]]
            codes[at + 1] = self.lengths[:, 1:]
            codes[at + 2] = tables[2][self.distances[:, 0]]
            codes[at + 3] = np.stack([self.distances[:, 1] & ((1 << low) - 1), low], 1)
            codes[at + 4] = np.stack([self.distances[:, 1] >> low, self.distances[:, 2] - low], 1)
        return codes

    def write(self, out: Writer) -> None:
        every = self.counts[0][:256] + self.counts[1]
        if not len(self.places) and not self.cache_bits and _shared_bits(every) < self.size:
            rest = code_lengths(every, 15)
            lengths = [rest + [0] * LENGTH_CODES, rest, [0] * DISTANCE_CODES]
        else:
            lengths = [code_lengths(c, 15) for c in self.counts]
        tables = []
        for own, times in zip(lengths, (1, 3, 1), strict=True):
            head = Writer()
            _write_lengths(head, own)
            for _ in range(times):
                out.put(head.value, head.n)
            table = np.zeros((len(own), 2), np.int64)
            symbols, sizes, codes = _canonical(own)
            table[symbols] = np.stack([codes, sizes], 1)
            tables.append(table)
        if len(self.literal) == self.n:
            codes = np.stack([tables[min(nth, 1)][x] for nth, x in enumerate(self.samples)], 1).reshape(-1, 2)
        else:
            codes = self._mixed(tables)
        packed, n = _pack(codes[:, 0], codes[:, 1])
        out.put(int.from_bytes(packed, "little"), n)


#: Size of the colour cache in bits, and the share of an image's bits that back-references must save to be used; a cache three times that, as each cached colour is read singly.
CACHE_BITS, SAVES = 9, 0.04


def _best_tokens(argb: np.ndarray, width: int) -> _Tokens:
    """With back-references and a colour cache where each saves enough, by estimates."""
    tokens, least = None, _literal_bits(argb)
    copies = _copies(argb)
    # a copy takes some 24 bits in place of its pixels' share
    if sum(n for _, n, _ in copies) * least / len(argb) - 24 * len(copies) > SAVES * least:
        tokens = _Tokens(argb, width, copies, 0)
        tokens, least = (tokens, tokens.size) if tokens.size < (1 - SAVES) * least else (None, least)
    tokens = tokens or _Tokens(argb, width, [], 0)
    # a pixel that was there before takes some ten bits less from the cache
    if 10 * _repeats(argb[tokens.literal]) > 3 * SAVES * least:
        cached = _Tokens(argb, width, tokens.copies, CACHE_BITS)
        if cached.size < (1 - 3 * SAVES) * least:
            tokens = cached
    return tokens


def _write_pixels(out: Writer, argb: np.ndarray, width: int, top: bool, cache_bits: int = 0, copies: bool = False, best: bool = False) -> None:
    """An entropy-coded image; ``best``: with what makes it smaller."""
    tokens = _best_tokens(argb, width) if best else _Tokens(argb, width, _copies(argb) if copies else [], cache_bits)
    out.put(1 if tokens.cache_bits else 0, 1)
    if tokens.cache_bits:
        out.put(tokens.cache_bits, 4)
    if top:
        out.put(0, 1)
    tokens.write(out)


def encode(rgba: np.ndarray, width: int, height: int, *, predictor: int | None = None, cross_colour: tuple[int, int, int] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, copies: bool = False, best: bool = False) -> bytes:
    """One image. The transforms are applied in the order predictor, cross-colour, subtract green; a palette goes first."""
    four = rgba.reshape(-1, 4).astype(np.uint32)
    argb = four[:, 3] << 24 | four[:, 0] << 16 | four[:, 1] << 8 | four[:, 2]
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    now = width
    if palette:
        colours, index = np.unique(argb, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        steps = [np.diff(c, prepend=0) for c in _channels(colours)]
        _write_pixels(out, _argb(steps), len(colours), False)
        per = _palette_bits(len(colours))
        depth, now = 8 >> per, -(-width >> per)
        grid = np.zeros((height, now << per), np.uint32)
        grid[:, :width] = index.reshape(height, width)
        bundled = (grid.reshape(height, now, 1 << per) << (np.arange(1 << per, dtype=np.uint32) * np.uint32(depth))).sum(-1).astype(np.uint32)
        argb = (bundled << np.uint32(8) | np.uint32(0xFF000000)).reshape(-1)
    if predictor is not None:
        image = np.stack(_channels(argb), -1).reshape(height, now, 4)
        rest = image.copy()
        rest[0, 1:] -= image[0, :-1]
        rest[0, 0] -= [255, 0, 0, 0]
        rest[1:, 0] -= image[:-1, 0]
        if height > 1 and now > 1:
            right = np.concatenate([image[:-1, 2:], image[1:, :1]], axis=1)
            rest[1:, 1:] -= _predict(predictor, image[1:, :-1], image[:-1, 1:], image[:-1, :-1], right)
        out.put(1 | PREDICTOR << 1, 3)
        out.put(7, 3)
        tiles = (-(-now >> 9)) * (-(-height >> 9))
        _write_pixels(out, np.full(tiles, 0xFF000000 | predictor << 8, np.uint32), -(-now >> 9), False)
        argb = _argb(np.moveaxis(rest.reshape(-1, 4), -1, 0))
    if cross_colour is not None:
        red_to_blue, green_to_blue, green_to_red = (x & 0xFF for x in cross_colour)
        element = np.uint32(0xFF000000 | red_to_blue << 16 | green_to_blue << 8 | green_to_red)
        out.put(1 | CROSS_COLOUR << 1, 3)
        out.put(7, 3)
        tiles = (-(-now >> 9)) * (-(-height >> 9))
        _write_pixels(out, np.full(tiles, element, np.uint32), -(-now >> 9), False)
        argb = _cross_colour(argb, np.full(len(argb), element, np.uint32), -1)
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        argb = _subtract_green(argb, -1)
    out.put(0, 1)
    _write_pixels(out, argb, now, True, cache_bits, copies, best)
    return _file(out.value.to_bytes(-(-out.n // 8), "little"))


def _file(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


OFFSETS = _near_offsets()

# ---- storing bytes ----

WIDTH = 16
def _best_transform(samples: np.ndarray) -> dict:
    """The transform with which the pixels of an image of WIDTH columns take fewest bits as literals, by estimates."""
    four = samples.reshape(-1, 4).astype(np.uint32)
    argb = four[:, 3] << 24 | four[:, 0] << 16 | four[:, 1] << 8 | four[:, 2]
    above = np.concatenate([np.zeros(WIDTH, np.uint32), argb[:-WIDTH]])
    steps = (argb.view(np.uint8) - above.view(np.uint8)).view(np.uint32)
    tried = []
    # a transform can help where it makes many zeros
    if 8 * np.count_nonzero(steps.view(np.uint8) == 0) > len(samples):
        tried.append(({"predictor": 2}, steps, 100))
    if 8 * sum(np.count_nonzero(samples[c::4] == samples[1::4]) for c in (0, 2)) > len(samples) // 2:
        tried.append(({"subtract_green": True}, _subtract_green(argb, -1), 8))
    if _repeats(argb[:128]) >= len(argb[:128]) // 2 and len(colours := np.unique(argb)) <= min(256, len(argb) // 4):
        per = _palette_bits(len(colours))
        index = np.searchsorted(colours, argb).astype(np.uint32).reshape(-1, WIDTH >> per, 1 << per)
        bundled = (index << (np.arange(1 << per, dtype=np.uint32) * np.uint32(8 >> per))).sum(-1, dtype=np.uint32).reshape(-1)
        tried.append(({"palette": True}, bundled << np.uint32(8) | np.uint32(0xFF000000), 20 * len(colours) + 60))
    form, least = {}, (1 - SAVES) * _literal_bits(argb) if tried else 0.0
    for more, changed, header in tried:
        if (bits := _literal_bits(changed) + header) < least:
            form, least = more, bits
    return form


def store(payload: bytes) -> bytes:
    """Images of WIDTH columns, one after another, whose RGBA samples are the payload (a multiple of 4 * WIDTH bytes).

    Each has the transform, back-references and colour cache that make it smaller, by estimates.
    """
    out = []
    for at in range(0, len(payload), 4 * WIDTH * MAX_SIDE):
        samples = np.frombuffer(payload[at : at + 4 * WIDTH * MAX_SIDE], np.uint8)
        out.append(encode(samples, WIDTH, len(samples) // (4 * WIDTH), best=True, **_best_transform(samples)))
    return b"".join(out)
