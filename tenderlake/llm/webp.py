"""Lossless WebP: a decoder for the whole format, an encoder, and media columns of payloads.

The decoder reads prefix codes, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms.  Where an image has one group
of codes, the pixel that would start at each bit is looked up for all bits at once, and one
pass over the pixels follows the chain; images with several groups are read symbol by symbol.
Predicted rows are inverted as arrays for modes that look at the row above or, alone, to the
left; other modes go pixel by pixel.

``store`` writes every payload with fitted prefix codes, predictor and cross-colour transforms of
least estimated entropy, a colour cache and back-references; an image of few colours becomes a
palette.  ``store_many`` writes the same files, with the codes of many short payloads built together.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small_batches, table, trim

# Fixed by the format: the order of code-length codes, and the near distances by growing distance.
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = sorted(
    ((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)
_HASH = 0x1E35A7BD


class _Bits:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.end = raw + b"\0" * 8, 0, 8 * len(raw)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.raw[byte : byte + 3], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        byte = self.at >> 3
        x = int.from_bytes(self.raw[byte : byte + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream is too short")
        return x & ((1 << n) - 1)


_TURN = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.uint16)

_TURN_OF = _TURN.tolist()


@lru_cache(maxsize=16)
def _turned(n: int) -> np.ndarray:
    """The numbers of ``n`` bits in the order of their bits read backwards."""
    return _TURN[: 1 << n] >> np.uint16(15 - n)


class _Code:
    """A canonical prefix code from ascending symbols and their lengths, as one table over the next
    ``most`` bits of 16 times the symbol and its length."""

    def __init__(self, symbols: list[int], lengths: list[int]):
        self.only, self.most = None, 0
        if len(symbols) == 1:
            self.only = int(symbols[0])
            return
        self.most = most = max(lengths)
        lengths = np.array(lengths)
        order = lengths.argsort(kind="stable")
        lengths = lengths[order]
        each = 1 << (most - lengths)
        if int(each.sum()) != 1 << most:
            raise ValueError("a prefix code is not complete")
        self.entry = (np.array(symbols)[order] << 4 | lengths).repeat(each).take(_turned(most))

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        entry = int(self.entry[bits.peek(self.most)])
        bits.read(entry & 15)
        return entry >> 4


def _read_code(bits: _Bits, size: int) -> _Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = {bits.read(8 if wide else 1)} | ({bits.read(8)} if two else set())
        return _Code(sorted(symbols), [1] * len(symbols))
    lens, n = [0] * 19, 4 + bits.read(4)
    word = bits.read(3 * n)
    for i in range(n):
        lens[_ORDER[i]] = word >> 3 * i & 7
    used = [i for i, n in enumerate(lens) if n]
    if not used:
        raise ValueError("a prefix code is not complete")
    code = _Code(used, [lens[i] for i in used])
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    entry = [16 * code.only] if code.only is not None else code.entry.tolist()
    mask = (1 << code.most) - 1
    symbols, lengths, at, last = [], [], 0, 8
    # Tokens of up to 14 bits are taken from a number that holds the next bytes.
    held = have = 0
    while at < size and left:
        if have < 14:
            byte = bits.at >> 3
            held, have = int.from_bytes(bits.raw[byte : byte + 24], "little") >> (bits.at & 7), 184
        left -= 1
        s = entry[held & mask]
        n = s & 15
        s >>= 4
        if s < 16:
            if s:
                symbols.append(at)
                lengths.append(s)
                last = s
            at += 1
        elif s == 16:
            k = 3 + (held >> n & 3)
            symbols += range(at, at + k)
            lengths += [last] * k
            at += k
            n += 2
        elif s == 17:
            at += 3 + (held >> n & 7)
            n += 3
        else:
            at += 11 + (held >> n & 127)
            n += 7
        held >>= n
        have -= n
        bits.at += n
    if bits.at > bits.end:
        raise ValueError("the stream is too short")
    if at > size:
        raise ValueError("too many code lengths")
    return _Code(symbols, lengths) if symbols else _Code([0], [1])


def _read_group(bits: _Bits, sizes: tuple[int, ...]) -> list[_Code]:
    """The five codes of a group; one whose bits repeat those of the code before is that code."""
    out, known = [], None
    for size in sizes:
        begin = bits.at
        if known is not None and known[0] == size:
            _, n, word = known
            byte = begin >> 3
            if int.from_bytes(bits.raw[byte : byte + (n >> 3) + 2], "little") >> (begin & 7) & ((1 << n) - 1) == word:
                bits.at += n
                out.append(out[-1])
                continue
        out.append(_read_code(bits, size))
        n, byte = bits.at - begin, begin >> 3
        known = (size, n, int.from_bytes(bits.raw[byte : byte + (n >> 3) + 2], "little") >> (begin & 7) & ((1 << n) - 1))
    return out


def _extra(bits: _Bits, prefix: int) -> int:
    """The value (from 1) of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


#: Pixels looked up at a time, so that memory does not grow with the image.
_SPAN = 1 << 16
_EIGHT = np.arange(8)


def _one_group(bits: _Bits, codes: list[_Code], n: int, w: int, cache_bits: int) -> np.ndarray:
    """n pixels of an image with one group of codes."""
    parts, events, i = [], [], 0
    raw = np.frombuffer(bits.raw, np.uint8)
    green = codes[0]
    plain = (green.only if green.only is not None else int(green.entry.max()) >> 4) < 256
    done = 0  # literal and cached pixels so far
    if all(c.only is not None for c in codes[:4]) and green.only < 256:
        g, r, b, a = (c.only for c in codes[:4])
        return np.full(n, a << 24 | r << 16 | g << 8 | b, np.uint32)
    while i < n:
        first = bits.at >> 3
        part = raw[first : first + _SPAN + 16].astype(np.int64)
        if bits.at > bits.end or len(part) < 9:
            raise ValueError("the stream is too short")
        three = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        # The bits from each one on; past the end, where the four codes of a pixel may reach, are zeros.
        size = 8 * len(three)
        window = np.zeros(size + 64, np.int64)
        np.right_shift(three[:, None], _EIGHT, out=window[:size].reshape(-1, 8))
        base, at = 8 * first, np.arange(size + 64)
        if green.only is None:
            entry = green.entry.take(window[:size] & ((1 << green.most) - 1), mode="clip")  # clip: without checks
            step, kind = at[:size] + (entry & 15), entry >> 4
        else:
            step, kind = at[:size], np.full(size, green.only)
        nxt, where, after = step, [], {}
        for c in codes[1:4]:
            where.append(nxt)
            if c.only is None:
                # Where a symbol from each bit on ends; channels of one code share this.
                if id(c) not in after:
                    after[id(c)] = (c.entry & 15).take(window & ((1 << c.most) - 1), mode="clip")
                    after[id(c)] += at
                nxt = after[id(c)].take(nxt, mode="clip")
        if not plain:
            other = np.flatnonzero(kind >= 256)
            nxt = nxt.copy() if nxt is step else nxt
            nxt[other] = np.where(kind[other] >= 280, step[other], -1)
        jump = memoryview(nxt)
        p, own = bits.at - base, []
        stop = size - 64 if first + _SPAN + 16 < len(raw) else min(size - 1, bits.end - base + 1)
        add = own.append
        while i < n and p < stop:
            q = jump[p]
            if q >= 0:
                add(p)
                p = q
                i += 1
                continue
            bits.at = base + p
            length = _extra(bits, green.read(bits) - 256)
            events.append((done + len(own), length, _extra(bits, codes[4].read(bits))))
            i += length
            p = bits.at - base
        bits.at = base + p
        if bits.at > bits.end or (i < n and p < size - 64 and p >= stop):
            raise ValueError("the stream is too short")
        own = np.array(own, np.int64)
        seen = kind[own]
        channels = []
        for c, w_at in zip(codes[1:4], where):
            channels.append(c.entry.take(window.take(w_at[own]) & ((1 << c.most) - 1)) >> 4 if c.only is None else c.only)
        r, b, a = channels
        parts.append((seen, (seen << 8 | (a << 24 | r << 16 | b)).astype(np.uint32)))
        done += len(own)
    if i > n:
        raise ValueError("a back-reference leaves the image")
    kind, px = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
    hit = kind >= 280
    if not events:
        return _from_cache(px, kind, hit, cache_bits) if hit.any() else px
    return _resolved(px, kind, hit, events, n, w, cache_bits)


def _slots(px: np.ndarray, cache_bits: int) -> np.ndarray:
    return (px.astype(np.uint32) * np.uint32(_HASH)) >> np.uint32(32 - cache_bits)


def _from_cache(px: np.ndarray, kind: np.ndarray, hit: np.ndarray, cache_bits: int) -> np.ndarray:
    """Pixels where cached ones take the last literal of their slot, which none other has replaced."""
    n = len(px)
    slot = np.where(hit, kind - 280, _slots(px, cache_bits)).astype(np.uint16)
    order = slot.argsort(kind="stable")
    ordered, late = slot[order], hit[order]
    begin = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=begin[1:])
    # The nearest literal before in the same slot, or the slot's first pixel: an empty one holds zero.
    at = np.maximum.accumulate(np.where(begin | ~late, np.arange(n), 0))
    out = np.empty(n, np.uint32)
    out[order] = np.where(late[at], np.uint32(0), px[order][at])
    return out


def _resolved(px: np.ndarray, kind: np.ndarray, hit: np.ndarray, events: list, n: int, w: int, cache_bits: int) -> np.ndarray:
    """Pixels with back-references and, where there is one, the colour cache, in order."""
    # The symbol that each pixel is or, through copies, comes from.
    ids, taken, i = np.arange(len(px)), 0, 0
    root = np.empty(len(px) + sum(length for _, length, _ in events), np.int64)
    own = np.ones(len(root), bool)
    for upto, length, code in events:
        back = code - 120 if code > 120 else max(1, _NEAR[code - 1][0] + _NEAR[code - 1][1] * w)
        begin = i + upto - taken
        root[i:begin] = ids[taken:upto]
        taken, i = upto, begin + length
        if back > begin or i > n:
            raise ValueError("a back-reference leaves the image")
        root[begin:i] = root[begin - back : i - back] if back >= length else np.resize(root[begin - back : begin], length)
        own[begin:i] = False
    root[i:] = ids[taken:]
    if not hit.any():
        return px[root]
    # A symbol's slot is known, so copies bring theirs along; a cached pixel is what entered its slot last.
    slot = np.where(hit, kind - 280, _slots(px, cache_bits)).astype(np.uint16)
    while True:
        entered = slot[root]
        order = entered.argsort(kind="stable")
        entered, source = entered[order], root[order]
        asks = np.flatnonzero(hit[source] & own[order])
        empty = entered[asks] != entered[asks - 1]
        empty[asks == 0] = True
        if not empty.any():
            break
        # An empty slot gives zero, which enters its own.
        none, hit, px = source[asks[empty]], hit.copy(), px.copy()
        hit[none], px[none], slot[none] = False, 0, 0
    ids[source[asks]] = source[asks - 1]
    while hit[ids].any():
        ids = ids[ids]
    return px[ids[root]]


#: Five codes of one symbol of eight bits each: the bits that say so, and what they are.
_SOLE = sum(7 << 11 * k for k in range(5))
_SOLE_IS = sum(5 << 11 * k for k in range(5))


def _image(bits: _Bits, w: int, h: int, main: bool) -> np.ndarray:
    """An entropy-coded image of ARGB words."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    meta, shift, groups = None, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        mw = (w + (1 << shift) - 1) >> shift
        mh = (h + (1 << shift) - 1) >> shift
        meta = (_image(bits, mw, mh, False) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(meta.max()) + 1
    cached = 1 << cache_bits if cache_bits else 0
    sizes = (256 + 24 + cached, 256, 256, 256, 40)
    n = w * h
    if groups == 1:
        byte = bits.at >> 3
        word = int.from_bytes(bits.raw[byte : byte + 8], "little") >> (bits.at & 7)
        if word & _SOLE == _SOLE_IS and bits.at + 55 <= bits.end:
            bits.at += 55
            g, r, b, a = (word >> k & 255 for k in (3, 14, 25, 36))
            return np.full(n, a << 24 | r << 16 | g << 8 | b, np.uint32)
    codes = [_read_group(bits, sizes) for _ in range(groups)]
    if groups == 1:
        return _one_group(bits, codes[0], n, w, cache_bits)
    out, cache, done = [0] * n, [0] * cached, 0
    group = codes[0]
    i = 0

    def remember(upto: int) -> None:
        nonlocal done
        if cached:
            for p in out[done:upto]:
                cache[(_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        done = upto

    while i < n:
        if meta is not None:
            group = codes[int(meta[(i // w >> shift) * mw + (i % w >> shift)])]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[i] = a << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 280:
            length, code = _extra(bits, s - 256), _extra(bits, group[4].read(bits))
            back = code - 120 if code > 120 else max(1, _NEAR[code - 1][0] + _NEAR[code - 1][1] * w)
            if back > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            for j in range(i, i + length):
                out[j] = out[j - back]
            i += length
        else:
            remember(i)
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.uint32)


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _bytes(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def predict(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode < 10:
        return _mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    l, t, tl = _bytes(left), _bytes(top), _bytes(top_left)
    if mode == 11:
        to_left = sum(abs(a - b) for a, b in zip(t, tl))
        to_top = sum(abs(a - b) for a, b in zip(l, tl))
        return left if to_left < to_top else top
    if mode == 12:
        c = [min(255, max(0, a + b - d)) for a, b, d in zip(l, t, tl)]
    else:
        mean = _bytes(_mean(left, top))
        c = [min(255, max(0, m + int((m - d) / 2))) for m, d in zip(mean, tl)]
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _neighbours(px, i: int, x: int, w: int) -> tuple[int, int, int, int]:
    """Left, top, top left and top right; the last column's top right is the row's first pixel."""
    return px[i - 1], px[i - w], px[i - w - 1], px[i - w + 1]


def _mode_at(modes, shift: int, tiles: int, x: int, y: int) -> int:
    if y == 0:
        return 0 if x == 0 else 1
    return 2 if x == 0 else int(modes[(y >> shift) * tiles + (x >> shift)]) >> 8 & 15


def _halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)


def _unpredict(px: np.ndarray, w: int, h: int, shift: int, modes: np.ndarray) -> np.ndarray:
    """Pixels from what the predictor left, a band of tiles at a time."""
    out, tiles = np.ascontiguousarray(px).view(np.uint8).reshape(h, w, 4).copy(), (w + (1 << shift) - 1) >> shift
    out[0, 0, 3:] += np.uint8(255)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
    kinds = (modes >> np.uint32(8) & np.uint32(15)).reshape(-1, tiles)
    if w == 1:
        return out.view(np.uint32).ravel()
    for k, mode in enumerate(kinds):
        first, last = max(1, k << shift), min(h, (k + 1) << shift)
        m = int(mode[0]) if (mode == mode[0]).all() else -1
        if m in (0, 14, 15):  # the rows of such a band go at once
            out[first:last, 1:, 3] += np.uint8(255)
        elif m == 1:
            out[first:last] = out[first:last].cumsum(axis=1, dtype=np.uint8)
        elif m == 2:
            out[first - 1 : last, 1:] = out[first - 1 : last, 1:].cumsum(axis=0, dtype=np.uint8)
        else:
            for y in range(first, last):
                _unpredict_row(out[y], out[y - 1], mode, m, shift)
    return out.view(np.uint32).ravel()


def _unpredict_row(row: np.ndarray, up: np.ndarray, mode: np.ndarray, m: int, shift: int) -> None:
    """A row after the first, in place; ``m`` is the mode of all its tiles or -1."""
    if m == 4:
        row[1:] += up[:-1]
    elif m == 8:
        row[1:] += _halves(up[:-1], up[1:])
    elif m in (3, 9):
        right = np.concatenate([up[2:], row[:1]])
        row[1:] += right if m == 3 else _halves(up[1:], right)
    else:
        words, above = row.view(np.uint32).ravel().tolist(), up.view(np.uint32).ravel().tolist()
        for x in range(1, len(words)):
            right = above[x + 1] if x + 1 < len(words) else words[0]
            words[x] = _add(words[x], predict(int(mode[x >> shift]), words[x - 1], above[x], above[x - 1], right))
        row.view(np.uint32).ravel()[:] = words


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int32)


def _cross(px: np.ndarray, w: int, h: int, shift: int, elements: np.ndarray, sign: int) -> np.ndarray:
    """Add (sign 1: decode) or take away the colour that green, and red, foretell."""
    tiles = (w + (1 << shift) - 1) >> shift
    if not (elements & np.uint32(0xFFFFFF)).any():
        return px
    if len(elements) == 1:
        e = elements
    else:
        at = np.arange(w * h)
        e = elements[(at // w >> shift) * tiles + (at % w >> shift)]
    return _crossed(px, e, sign)


def _crossed(px: np.ndarray, e: np.ndarray, sign: int) -> np.ndarray:
    """As ``_cross``, by the element of each pixel or one of all."""
    to_red, to_blue, red_to_blue = _signed(e & 255), _signed(e >> 8 & 255), _signed(e >> 16 & 255)
    green = _signed(px >> 8 & 255)
    red, blue = (px >> 16 & 255).astype(np.int32), (px & 255).astype(np.int32)
    new_red = red + sign * (to_red * green >> 5)
    base = new_red if sign > 0 else red
    new_blue = blue + sign * ((to_blue * green >> 5) + (red_to_blue * _signed(base & 255) >> 5))
    return px & np.uint32(0xFF00FF00) | (new_red & 255).astype(np.uint32) << np.uint32(16) | (new_blue & 255).astype(np.uint32)


def _green(px: np.ndarray, sign: int) -> np.ndarray:
    g = px >> 8 & 255
    red, blue = (px >> 16) + (g if sign > 0 else 256 - g) & 255, px + (g if sign > 0 else 256 - g) & 255
    return px & np.uint32(0xFF00FF00) | red << np.uint32(16) | blue


def decode(raw: bytes) -> np.ndarray:
    """ARGB words [height, width] of a lossless WebP file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("not WebP")
    at = 12
    while raw[at : at + 4] != b"VP8L":
        if at + 8 > len(raw):
            raise ValueError("no lossless image")
        at += 8 + (struct.unpack_from("<I", raw, at + 4)[0] + 1 & ~1)
    size = struct.unpack_from("<I", raw, at + 4)[0]
    bits = _Bits(raw[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, full = [], w
    while bits.read(1):
        kind = bits.read(2)
        if kind == 3:
            n = bits.read(8) + 1
            delta = _image(bits, n, 1, False)
            channels = np.cumsum(delta.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8)
            steps.append((3, w, 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0, np.ascontiguousarray(channels).view(np.uint32).ravel()))
            pack_ = steps[-1][2]
            w = (w + (1 << pack_) - 1) >> pack_
        elif kind == 2:
            steps.append((2, w, 0, None))
        else:
            shift = bits.read(3) + 2
            side = lambda n: (n + (1 << shift) - 1) >> shift
            steps.append((kind, w, shift, _image(bits, side(w), side(h), False)))
    px = _image(bits, w, h, True)
    for kind, width, shift, data in reversed(steps):
        if kind == 0:
            px = _unpredict(px, width, h, shift, data)
        elif kind == 1:
            px = _cross(px, width, h, shift, data, 1)
        elif kind == 2:
            px = _green(px, 1)
        else:
            index = (px >> 8 & 255).astype(np.uint8).reshape(h, -1)
            if shift:
                per, depth = 1 << shift, 8 >> shift
                index = (index[:, :, None] >> (np.arange(per, dtype=np.uint8) * depth)) & ((1 << depth) - 1)
                index = index.reshape(h, -1)[:, :width]
            colours = np.zeros(256, np.uint32)
            colours[: len(data)] = data
            px = colours[index].ravel()
    return px.reshape(h, full)


class _Out:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_words(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of up to 64 bits each, in order."""
        at = np.cumsum(sizes) - sizes + self.n
        total = int(sizes.sum()) + self.n
        words = np.zeros((total >> 6) + 2, np.uint64)
        _place(words, at, values)
        self.value |= int.from_bytes(words.tobytes(), "little")
        self.n = total

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _place(words: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Set values of up to 64 bits each at ascending bits of ``words``; no two share a bit."""
    place, shift = at >> 6, (at & 63).astype(np.uint64)
    over = np.where(shift > 0, values >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    if len(place):
        # No two values share a bit, so those of one word add up.
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        words[place[first]] |= np.add.reduceat(values << shift, first)
        words[place[first] + 1] |= np.add.reduceat(over, first)


def _fitted(counts: np.ndarray | list[int], most: int = 12) -> np.ndarray:
    """Lengths of a complete prefix code close to the counts' entropy, none above ``most``; 1 for a
    sole symbol, and for symbol 0 where there is none."""
    counts = counts if isinstance(counts, list) else counts.tolist()
    used = [i for i, n in enumerate(counts) if n]
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used or 0] = 1
        return out
    used.sort(key=lambda i: -counts[i])
    total = sum(counts)
    # The least length whose share of the code is no more than the symbol's share of the counts.
    least = {n: min(most, max(1, (-(-total // n) - 1).bit_length())) for n in {counts[i] for i in used}}
    size = [least[counts[i]] for i in used]
    room = (1 << most) - sum(1 << (most - n) for n in size)
    while room < 0:  # lengths that were cut to the most: others grow, the rarest first
        for i in reversed(range(len(size))):
            if size[i] < most and room < 0:
                size[i] += 1
                room += 1 << (most - size[i])
    while room > 0:  # what is left over shortens the most frequent that fit
        for i, n in enumerate(size):
            if n > 1 and (gain := 1 << (most - n)) <= room:
                size[i] = n - 1
                room -= gain
                if not room:
                    break
    out[used] = size
    return out


def _written(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits in stream order, their number) by symbol of a code of these lengths."""
    used = np.flatnonzero(lengths)
    bits, sizes = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        each = 1 << (15 - lengths[order])
        bits[order] = _TURN[np.cumsum(each) - each]
        sizes[used] = lengths[used]
    return bits, sizes


def _put_code(out: _Out, lengths: np.ndarray) -> None:
    symbols = np.flatnonzero(lengths).tolist()
    if len(symbols) <= 2 and symbols[-1] < 256 and lengths[symbols].max() == 1:
        out.put(1 | (len(symbols) - 1) << 1 | 1 << 2, 3)
        for s in symbols:
            out.put(s, 8)
        return
    edge = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    tokens, last, seen = [], 8, [0] * 19
    for n, begin, end in zip(lengths[edge[:-1]].tolist(), edge, edge[1:]):
        run = end - begin
        if n and n != last:
            tokens.append((n, 0, 0))
            seen[n] += 1
            last, run = n, run - 1
        while run:
            if n and run >= 3:
                k = min(6, run)
                token = (16, k - 3, 2)
            elif not n and run >= 11:
                k = min(138, run)
                token = (18, k - 11, 7)
            elif not n and run >= 3:
                k = min(10, run)
                token = (17, k - 3, 3)
            else:
                k, token = 1, (n, 0, 0)
            tokens.append(token)
            seen[token[0]] += 1
            run -= k
    lens = _fitted(seen, 7).tolist()
    used = max(4, max(i for i, x in enumerate(_ORDER) if lens[x]) + 1)
    head = 0
    for i, x in enumerate(_ORDER[:used]):
        head |= lens[x] << 3 * i
    out.put((used - 4) << 1 | head << 5, 5 + 3 * used)
    out.put(0, 1)
    code, at = [(0, 0)] * 19, 0
    if sum(map(bool, lens)) > 1:
        for n, s in sorted((n, s) for s, n in enumerate(lens) if n):
            code[s] = (_TURN_OF[at], n)
            at += 1 << (15 - n)
    word = at = 0
    for s, extra, wide in tokens:
        bits, n = code[s]
        word |= (bits | extra << n) << at
        at += n + wide
    out.put(word, at)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, their number) of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


@lru_cache(maxsize=32)
def _near_codes(w: int) -> dict[int, int]:
    """The short code of each near distance in an image ``w`` wide."""
    return {dx + dy * w: k for k, (dx, dy) in reversed(list(enumerate(_NEAR, 1))) if dx + dy * w >= 1}


def _put_image(out: _Out, px: list[int], w: int, main: bool, cache_bits: int = 0, references: bool = True) -> None:
    """An entropy-coded image with fitted prefix codes, back-references and a colour cache."""
    seen: dict[tuple, int] = {}
    cache = [None] * (1 << cache_bits)
    parts, i = [], 0
    threes = list(zip(px, px[1:], px[2:])) if references else []
    while i < len(px):
        back = seen.get(threes[i]) if i < len(threes) else None
        n = 0
        if back is not None:
            most = min(4096, len(px) - i)
            while n + 64 <= most and px[back + n : back + n + 64] == px[i + n : i + n + 64]:
                n += 64
            while n < most and px[back + n] == px[i + n]:
                n += 1
        slot = (_HASH * px[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if n >= 3:
            parts.append(("ref", n, i - back))
        elif cache_bits and cache[slot] == px[i]:
            parts.append(("hit", slot, 0))
        else:
            parts.append(("raw", px[i], 0))
        end = i + (n if n >= 3 else 1)
        seen.update(zip(threes[i:end], range(i, end)))
        if cache_bits:
            for j in range(i, end):
                cache[(_HASH * px[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[j]
        i = end
    counts: list[dict[int, int]] = [{}, {}, {}, {}, {}]
    add = lambda k, s: counts[k].__setitem__(s, counts[k].get(s, 0) + 1)
    near = _near_codes(w)
    coded = []
    for kind, a, b in parts:
        if kind == "raw":
            t = (a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)
            for k, s in enumerate(t):
                add(k, s)
            coded.append((kind, t))
        elif kind == "hit":
            add(0, 280 + a)
            coded.append((kind, 280 + a))
        else:
            p, q = _prefix(a), _prefix(near.get(b, b + 120))
            add(0, 256 + p[0])
            add(4, q[0])
            coded.append((kind, (p, q)))
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    fits = []
    for c, size in zip(counts, sizes):
        n = np.zeros(size, np.int64)
        n[list(c)] = list(c.values())
        fits.append(_fitted(n))
        _put_code(out, fits[-1])
    codes = []
    for f in fits:
        bits, lens = _written(f)
        codes.append(list(zip(bits.tolist(), lens.tolist())))
    words = []
    for kind, x in coded:
        if kind == "raw":
            words += [c[s] for c, s in zip(codes, x)]
        elif kind == "hit":
            words.append(codes[0][x])
        else:
            (p, e, n), (q, f, m) = x
            words += [codes[0][256 + p], (e, n), codes[4][q], (f, m)]
    if words:
        values, lens = zip(*words)
        out.put_words(np.array(values, np.uint64), np.array(lens, np.int64))


def _file(data: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _header(w: int, h: int) -> _Out:
    out = _Out()
    for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out


def encode(px: np.ndarray, modes: int | None = None, cross: int | None = None, green: bool = False, palette: bool = False,
           cache_bits: int = 0, references: bool = True) -> bytes:
    """A lossless WebP file of ARGB words [height, width] with the named features."""
    h, w = px.shape
    out, px = _header(w, h), px.astype(np.uint32).ravel()
    shift = 3
    tiles = ((w + 7) >> 3) * ((h + 7) >> 3)
    if modes is not None:
        # Tile k takes the mode ``modes + k``, modulo 14.
        data = np.array([((modes + k) % 14) << 8 | 0xFF000000 for k in range(tiles)], np.uint32)
        out.put(1 | 0 << 1 | (shift - 2) << 3, 6)
        _put_image(out, data.tolist(), (w + 7) >> 3, False)
        old, new = px.tolist(), []
        for i in range(w * h):
            y, x = divmod(i, w)
            near = (old[i - 1] if i else 0, 0, 0, 0) if y == 0 else _neighbours(old, i, x, w)
            p = predict(_mode_at(data, shift, (w + 7) >> 3, x, y), *near)
            new.append(_sub(old[i], p))
        px = np.array(new, np.uint32)
    if cross is not None:
        data = np.full(tiles, cross, np.uint32)
        out.put(1 | 1 << 1 | (shift - 2) << 3, 6)
        _put_image(out, data.tolist(), (w + 7) >> 3, False)
        px = _cross(px, w, h, shift, data, -1)
    if green:
        out.put(1 | 2 << 1, 3)
        px = _green(px, -1)
    if palette:
        colours, index = np.unique(px, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        out.put(1 | 3 << 1 | (len(colours) - 1) << 3, 11)
        channels = colours.view(np.uint8).reshape(-1, 4)
        delta = np.diff(np.vstack([np.zeros((1, 4), np.uint8), channels]), axis=0).astype(np.uint8)
        _put_image(out, np.ascontiguousarray(delta).view(np.uint32).ravel().tolist(), len(colours), False)
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        per, depth, index = 1 << bits, 8 >> bits, index.reshape(h, w)
        index = np.pad(index, ((0, 0), (0, -w % per))).reshape(h, -1, per)
        px = ((index << (np.arange(per) * depth)).sum(axis=2).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).ravel()
        w = (w + per - 1) >> bits
    out.put(0, 1)
    _put_image(out, px.tolist(), w, True, cache_bits, references)
    return _file(out.bytes())


def _sub(a: int, b: int) -> int:
    return sum(((x - y) & 255) << s for x, y, s in zip(_bytes(a), _bytes(b), (24, 16, 8, 0)))


def _entropy(px: np.ndarray) -> float:
    """Bits that the four channels of pixels [n, 4] take by their own counts, less a constant."""
    n = np.bincount((px + _CHANNEL).ravel())
    n = n[n > 1]
    return -float(n @ np.log2(n))


_CHANNEL = np.array([0, 256, 512, 768], np.int64)


def _residuals(px: np.ndarray, mode: int) -> np.ndarray:
    """What a mode leaves of pixels [h, w, 4]: the first row looks left, the first column up."""
    out = px.copy()
    out[0, 0, 3:] -= np.uint8(255)
    out[0, 1:] -= px[0, :-1]
    out[1:, 0] -= px[:-1, 0]
    if px.shape[0] > 1 and px.shape[1] > 1:
        up, own = px[:-1], out[1:, 1:]
        if mode == 0:
            own[:, :, 3] -= 255
        elif mode == 1:
            own -= px[1:, :-1]
        elif mode == 2:
            own -= up[:, 1:]
        elif mode == 4:
            own -= up[:, :-1]
        else:
            own -= _halves(up[:, :-1], up[:, 1:])
    return out


def _slope(a: np.ndarray, b: np.ndarray) -> int:
    """The multiplier, in 32nds, by which ``a`` foretells ``b`` best, as a byte."""
    a = a.astype(np.float64)
    square = float((a * a).sum())
    return int(np.clip(round(32 * float((a * b).sum()) / square), -128, 127)) & 255 if square else 0


def _matches(px: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(positions, earlier positions) where ``least`` pixels have the hash of the latest earlier place."""
    none = np.zeros(0, np.int64)
    n = len(px) - least + 1
    if n < 2:
        return none, none
    key = np.zeros(n, np.uint64)
    for i in range(least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + px[i : i + n]
    # Half of the hash and the place, so that one sort brings like places together in order.
    key = np.sort(key & np.uint64(0xFFFFFFFF << 32) | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero(key[1:] >> np.uint64(32) == key[:-1] >> np.uint64(32))
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return place[same + 1], place[same]


def _parse(px: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy back-references (position, length, distance) of four pixels or more."""
    here, back = _matches(px)
    if not len(here):
        return []
    order = np.argsort(here)
    found, free, words = [], 0, px.tolist()
    for i, j in zip(here[order].tolist(), back[order].tolist()):
        if i < free or words[i : i + 4] != words[j : j + 4]:
            continue
        n = 4
        while n < 4096 and i + n < len(words) and words[i + n] == words[j + n]:
            n += 1
        found.append((i, n, i - j))
        free = i + n
    return found


def _put_pixels(out: _Out, px: np.ndarray, w: int, cache_bits: int) -> None:
    """The main image with one group of fitted prefix codes: every back-reference, and a colour
    cache for the pixels between them; copied pixels enter the cache too.  Red, blue and alpha, or
    red and blue, take one code where that costs at most a tenth more than theirs."""
    n = len(px)
    near, head = _near_codes(w), np.ones(n, bool)
    green = (px >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    literal, far = np.ones(n, bool), {}
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
        slot = _slots(px, cache_bits)
        order = slot.astype(np.uint16).argsort(kind="stable")
        hit = order[1:][(slot[order[1:]] == slot[order[:-1]]) & (px[order[1:]] == px[order[:-1]])]
        literal[hit] = False
        green[hit] = 280 + slot[hit].astype(np.int64)
    for i, length, distance in _parse(px):
        head[i + 1 : i + length] = False
        literal[i] = False
        far[i] = (*_prefix(length), *_prefix(near.get(distance, distance + 120)))
        green[i] = 256 + far[i][0]
    at = np.flatnonzero(head)
    out.put(0, 1)  # one group of codes
    lit = literal[at]
    channels = np.stack([px >> np.uint32(16), px, px >> np.uint32(24)]).astype(np.uint8)
    own = channels[:, at[lit]]
    counts = np.bincount((own + _CHANNEL[:3, None]).ravel(), minlength=768).reshape(3, 256)
    tried = np.vstack([counts, counts.cumsum(axis=0)[1:]])
    total = tried.sum(axis=1)
    bits = total * np.log2(np.maximum(total, 1)) - (tried * np.log2(np.maximum(tried, 1))).sum(axis=1)
    k = next((k for k in (3, 2) if 10 * bits[k + 1] <= 11 * bits[:k].sum()), 1)
    fits = [*[_fitted(tried[k + 1 if k > 1 else 0])] * k, *map(_fitted, counts[k:])]
    fits = [_fitted(np.bincount(green[at], minlength=280 + (1 << cache_bits if cache_bits else 0))), *fits,
            _fitted(np.bincount([f[3] for f in far.values()], minlength=40) if far else np.zeros(40, np.int64))]
    made: dict[int, tuple] = {}
    for f in fits:
        if id(f) not in made:
            code = _Out()
            _put_code(code, f)
            made[id(f)] = (code.value, code.n, _written(f))
        out.put(*made[id(f)][:2])
    tables = [made[id(f)][2] for f in fits]
    value, size = tables[0][0][green[at]], tables[0][1][green[at]]
    for (bits, lens), c in zip(tables[1:4], channels):
        x = c[at]
        value |= np.where(lit, bits[x], np.uint64(0)) << size.astype(np.uint64)
        size = size + np.where(lit, lens[x], 0)
    for k, i in zip(np.searchsorted(at, sorted(far)).tolist(), sorted(far)):
        _, extra, wide, p, more, m = far[i]
        word, width = int(value[k]) | extra << int(size[k]), int(size[k]) + wide
        word |= int(tables[4][0][p]) << width
        width += int(tables[4][1][p])
        value[k], size[k] = word | more << width, width + m
    out.put_words(value, size)


def _put_small(out: _Out, words: list[int], w: int) -> None:
    """The image of a transform's bands; one word alone is five codes of one symbol."""
    if len(words) > 1:
        _put_image(out, words, w, False, references=False)
        return
    word = _SOLE_IS
    for k, s in enumerate((words[0] >> 8 & 255, words[0] >> 16 & 255, words[0] & 255, words[0] >> 24)):
        word |= s << 11 * k + 3
    out.put(word << 1, 56)


#: Bytes of payload that one image takes: 4,096 pixels squared.
PART = 1 << 26


def _shaped(payload: bytes) -> np.ndarray:
    px = np.frombuffer(payload, ">u4").astype(np.uint32)
    w = 16
    while w * w < len(px) and w < 1 << 14:
        w *= 2
    if len(px) > w << 14:
        raise ValueError("a payload above 1 GiB is no image of this format")
    return np.pad(px, (0, -len(px) % w)).reshape(-1, w)


def _few_colours(px: np.ndarray) -> bool:
    ordered = np.sort(px, axis=None)
    return np.count_nonzero(ordered[1:] != ordered[:-1]) < min(256, px.size // 4)


def store(payload: bytes, cache_bits: int = 6) -> bytes:
    """A payload of 4 n bytes as a lossless WebP file of four bytes a pixel, about square.

    An image of at most 256 colours, each twice as frequent as the palette costs, is written as
    a palette.  Any other has a predictor (mode 0, 1 or 2: of all 14, these alone were best on
    texts, see README) and a cross-colour transform in bands of 512 rows, the
    mode and the multipliers those of least entropy.  Payloads beyond 16,384 pixels squared
    (1 GiB) are refused.
    """
    px = _shaped(payload)
    h, w = px.shape
    if _few_colours(px):
        return encode(px, palette=True)
    out, bands = _header(w, h), range(0, h, 512)
    image = px.view(np.uint8).reshape(h, w, 4)
    left, modes, factors = [], [], []
    for y in bands:
        # The row above a band foretells its first one.
        rows = image[max(0, y - 1) : y + 512]
        tried = {m: _residuals(rows, m)[1 if y else 0 :] for m in (0, 1, 2)}
        best = min(tried, key=lambda m: _entropy(tried[m].reshape(-1, 4)))
        modes.append(best)
        left.append(tried[best])
    left = np.ascontiguousarray(np.concatenate(left)).view(np.uint32).reshape(h, w)
    if w > 512:
        modes = [m for m in modes for _ in range((w + 511) >> 9)]
    out.put(1 | 0 << 1 | 7 << 3, 6)
    _put_small(out, [m << 8 | 0xFF000000 for m in modes], (w + 511) >> 9)
    flat, crossed = left.ravel(), []
    for y in bands:
        band = left[y : y + 512].ravel()
        g, r, b = (_signed(band >> np.uint32(s) & np.uint32(255)) for s in (8, 16, 0))
        options = [0, _slope(g, r) | _slope(g, b) << 8 | _slope(r, b) << 16]
        made = {e: _cross(band, w, len(band) // w, 9, np.array([e], np.uint32), -1) if e else band for e in dict.fromkeys(options)}
        best = min(made, key=lambda e: _entropy(np.ascontiguousarray(made[e]).view(np.uint8).reshape(-1, 4)))
        factors.append(best | 0xFF000000)
        crossed.append(made[best])
    if w > 512:
        factors = [f for f in factors for _ in range((w + 511) >> 9)]
    out.put(1 | 1 << 1 | 7 << 3, 6)
    _put_small(out, factors, (w + 511) >> 9)
    flat = np.concatenate(crossed).astype(np.uint32)
    out.put(0, 1)
    _put_pixels(out, flat, w, cache_bits)
    return _file(out.bytes())


def _fitted_rows(counts: np.ndarray, most: int = 12) -> np.ndarray:
    """``_fitted`` of each row of counts [codes, symbols], all rows a symbol at a time."""
    used = np.count_nonzero(counts, axis=1)
    # One sort a row: the most frequent first, those alike by symbol.
    key = np.sort((counts.max() - counts) << 10 | np.arange(counts.shape[1]), axis=1)[:, : max(1, int(used.max()))]
    symbol = key & 1023
    own = (counts.max() - (key >> 10)).T
    total = counts.sum(axis=1)
    size = np.frexp((-(-total // np.maximum(own, 1)) - 1).astype(np.float64))[1].clip(1, most).astype(np.int32)
    size[own == 0] = 1  # never shortened
    room = ((1 << most) - ((own > 0) << (most - size)).sum(axis=0)).astype(np.int32)
    cut = np.flatnonzero((room < 0) & (used > 1))
    room[(room < 0) | (used < 2)] = 0
    gains = np.array([0, 1 << 20, *(1 << (most - n) for n in range(2, most + 1))], np.int32)
    while len(short := np.flatnonzero(room)):
        part, left = np.ascontiguousarray(size[:, short]), room[short]
        for n in part[: int(used[short].max())]:
            gain = gains[n]
            gain *= gain <= left
            left -= gain
            n -= gain > 0
        size[:, short], room[short] = part, left
    out = np.zeros(counts.shape, np.int64)
    np.put_along_axis(out, symbol, np.where(own > 0, size, 0).T, axis=1)
    out[used == 0, 0] = 1
    for k in cut:  # lengths that were cut to the most
        out[k] = _fitted(counts[k], most)
    return out


def _written_rows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_written`` of each row of lengths [codes, symbols]."""
    used = np.count_nonzero(lengths, axis=1)
    key = np.sort(np.where(lengths > 0, lengths << 10, 1 << 20) | np.arange(lengths.shape[1]), axis=1)[:, : int(used.max())]
    size = key >> 10
    own = size < 16
    each = np.where(own, 1 << (15 - np.minimum(size, 15)), 0)
    begin = np.where(own & (used > 1)[:, None], each.cumsum(axis=1) - each, 0)
    bits = np.zeros(lengths.shape, np.uint64)
    np.put_along_axis(bits, key & 1023, _TURN[begin].astype(np.uint64), axis=1)
    return bits, np.where((used > 1)[:, None], lengths, 0)


def _code_rows(lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_put_code`` writes of each row's first ``sizes`` lengths: values, their bits, and how
    many there are a row."""
    used = lengths > 0
    many, first, last = used.sum(axis=1), used.argmax(axis=1), lengths.shape[1] - 1 - used[:, ::-1].argmax(axis=1)
    short = (many <= 2) & (last < 256)
    long = np.flatnonzero(~short)
    runs = np.ones(len(lengths), np.int64)
    if len(long):
        flat = lengths[long][np.arange(lengths.shape[1]) < sizes[long][:, None]]
        code = np.repeat(np.arange(len(long)), sizes[long])
        begin = np.concatenate([[0], np.flatnonzero((flat[1:] != flat[:-1]) | (code[1:] != code[:-1])) + 1])
        n, code, run = flat[begin], code[begin], np.diff(begin, append=len(flat))
        # The last length before a run that is not zero, 8 at first: one run back, or two.
        n1, n2 = np.concatenate([[0], n[:-1]]), np.concatenate([[0, 0], n[:-2]])
        same1, same2 = np.concatenate([[False], code[1:] == code[:-1]]), np.concatenate([[False, False], code[2:] == code[:-2]])[: len(n)]
        before = np.where(same1 & (n1 > 0), n1, np.where(same2, n2[: len(n)], 8))
        new = (n > 0) & (n != before)
        full, rest = np.divmod(run - new, np.where(n > 0, 6, 138))
        far = rest >= 11
        token = np.stack([n, np.where(n > 0, 16, 18), np.where(rest < 3, n, np.where(n > 0, 16, np.where(far, 18, 17)))], axis=1)
        extra = np.stack([0 * n, np.where(n > 0, 3, 127), np.where(rest < 3, 0, np.where(far, rest - 11, rest - 3))], axis=1)
        wide = np.stack([0 * n, np.where(n > 0, 2, 7), np.where(rest < 3, 0, np.where(n > 0, 2, np.where(far, 7, 3)))], axis=1)
        times = np.stack([new, full, np.where(rest < 3, rest, 1)], axis=1)
        code = np.repeat(code, times.sum(axis=1))
        token, extra, wide = (np.repeat(x.ravel(), times.ravel()) for x in (token, extra, wide))
        lens = _fitted_rows(np.bincount(code * 19 + token, minlength=19 * len(long)).reshape(-1, 19), 7)
        head = lens[:, _ORDER]
        heads = np.maximum(4, 19 - (head[:, ::-1] > 0).argmax(axis=1))
        bits, width = _written_rows(lens)
        width = width[code, token]
        runs[long] += np.bincount(code, minlength=len(long))
    begin = runs.cumsum() - runs
    value, size = np.zeros(int(runs.sum()), np.uint64), np.zeros(int(runs.sum()), np.int64)
    value[begin] = 1 | (many - 1) << 1 | 1 << 2 | first << 3 | np.where(many == 2, last, 0) << 11
    size[begin] = 3 + 8 * many
    if len(long):
        value[begin[long]] = (heads - 4) << 1 | (head << 3 * np.arange(19)).sum(axis=1) << 5
        size[begin[long]] = 6 + 3 * heads
        tokens = np.ones(len(value), bool)
        tokens[begin] = False
        value[tokens] = bits[code, token] | extra.astype(np.uint64) << width.astype(np.uint64)
        size[tokens] = width + wide
    return value, size, runs


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix`` of each value."""
    v = value - 1
    n = np.maximum(np.frexp(v.astype(np.float64))[1].astype(np.int64) - 2, 0)
    return np.where(v < 4, v, 2 * n + 2 + (v >> n & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), n


def _entropies(px: np.ndarray, image: np.ndarray, m: int) -> np.ndarray:
    """``_entropy`` of the pixels of each of m images."""
    n = np.bincount(((image << 10)[:, None] + (px.view(np.uint8).reshape(-1, 4) + _CHANNEL)).ravel(), minlength=m << 10)
    return np.array([-float(x @ np.log2(x)) for x in (row[row > 1] for row in n.reshape(m, 1024))])


def _sole_words(words: np.ndarray) -> np.ndarray:
    """What ``_put_small`` writes of each word alone."""
    out = np.full(len(words), _SOLE_IS, np.uint64)
    for k, s in enumerate((8, 16, 0, 24)):
        out |= (words >> np.uint64(s) & np.uint64(255)) << np.uint64(11 * k + 3)
    return out << np.uint64(1)


def _foretold(px: np.ndarray, image: np.ndarray, first: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pixels, mode, cross-colour element) of images of one band each, laid one after another,
    under the predictor and the multipliers of least entropy."""
    m, wide, at = len(first), w[image], np.arange(len(px))
    q = at - first[image]
    top, origin = q < wide, q == 0
    border = top | (q & (wide - 1) == 0)
    lanes = px.view(np.uint8).reshape(-1, 4)
    from_left, plain = lanes.copy(), lanes.copy()
    from_left[1:] -= lanes[:-1]
    plain[:, 3] -= np.uint8(255)
    from_top = lanes - px[np.maximum(at - wide, 0)].view(np.uint8).reshape(-1, 4)
    from_left, from_top, plain = (x.view(np.uint32).ravel() for x in (from_left, from_top, plain))
    edge = np.where(top, from_left, from_top)
    edge[origin] = plain[origin]
    tried = [np.where(border, edge, x) for x in (plain, from_left, from_top)]
    cost = np.stack([_entropies(x, image, m) for x in tried])
    mode = cost.argmin(axis=0)
    left = np.choose(mode[image], tried)
    g, r, b = (_signed(left >> np.uint32(s) & np.uint32(255)) for s in (8, 16, 0))
    total = lambda a, b: np.add.reduceat(a * b, first, dtype=np.int64).tolist()
    slope = lambda ab, aa: int(np.clip(round(32 * float(ab) / aa), -128, 127)) & 255 if aa else 0
    gg, rr, gr, gb, rb = total(g, g), total(r, r), total(g, r), total(g, b), total(r, b)
    element = np.array([slope(gr[i], gg[i]) | slope(gb[i], gg[i]) << 8 | slope(rb[i], rr[i]) << 16 for i in range(m)], np.uint32)
    made = _crossed(left, element[image], -1)
    element[_entropies(made, image, m) >= cost.min(axis=0)] = 0
    return np.where(element[image] > 0, made, left), mode, element


def _store_together(images: list[np.ndarray], cache_bits: int = 6) -> list[bytes]:
    """``store`` of images of one band each and of many colours, with all codes fitted and written at once."""
    m = len(images)
    h, w = (np.array([x.shape[k] for x in images]) for k in (0, 1))
    n = h * w
    first, image = n.cumsum() - n, np.repeat(np.arange(m), n)
    px, mode, element = _foretold(np.concatenate([x.ravel() for x in images]), image, first, w)
    # Symbols: cached pixels, then the back-references, over whose pixels no others are written.
    green, literal, head = (px >> np.uint32(8) & np.uint32(255)).astype(np.int64), np.ones(len(px), bool), np.ones(len(px), bool)
    slot = _slots(px, cache_bits).astype(np.int64)
    key = image << cache_bits | slot
    order = key.astype(np.uint16 if m << cache_bits <= 1 << 16 else np.int64).argsort(kind="stable")
    hit = order[1:][(key[order[1:]] == key[order[:-1]]) & (px[order[1:]] == px[order[:-1]])]
    literal[hit] = False
    green[hit] = 280 + slot[hit]
    found = []
    for i, (begin, size, width) in enumerate(zip(first.tolist(), n.tolist(), w.tolist())):
        near = _near_codes(width)
        found += [(begin + k, length, near.get(far, far + 120)) for k, length, far in _parse(px[begin : begin + size])]
    place, length, far = np.array(found, np.int64).reshape(-1, 3).T
    (kind, extra, more), (kind2, extra2, more2) = _prefixes(length), _prefixes(far)
    literal[place] = False
    green[place] = 256 + kind
    head[np.repeat(place + length - length.cumsum() + np.arange(len(place)), length - 1) + np.arange(1, int((length - 1).sum()) + 1)] = False
    at = np.flatnonzero(head)
    own, lit, green = image[at], literal[at], green[at]
    channels = [(px[at] >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24)]
    counts = np.stack([np.bincount((own << 8 | x)[lit], minlength=m << 8).reshape(m, 256) for x in channels], axis=1)
    # Codes, as ``_put_pixels`` shares them: red, blue and alpha, red and blue, or none.
    tried = np.concatenate([counts, counts.cumsum(axis=1)[:, 1:]], axis=1)
    total = tried.sum(axis=2)
    bits = total * np.log2(np.maximum(total, 1)) - (tried * np.log2(np.maximum(tried, 1))).sum(axis=2)
    two = bits[:, 0] + bits[:, 1]
    share = np.where(10 * bits[:, 4] <= 11 * (two + bits[:, 2]), 3, np.where(10 * bits[:, 3] <= 11 * two, 2, 1))
    which = np.array([[0, 0, 0], [0, 1, 2], [3, 3, 2], [4, 4, 4]])[share]
    new = np.ones((m, 3), bool)
    new[:, 1:] = which[:, 1:] != which[:, :-1]
    whose, c = np.nonzero(new)
    wide = 280 + (1 << cache_bits)
    rows = np.zeros((2 * m + len(whose), wide), np.int64)
    rows[:m] = np.bincount(own * wide + green, minlength=m * wide).reshape(m, wide)
    rows[m:-m, :256] = tried[whose, which[whose, c]]
    rows[-m:, :40] = np.bincount(image[place] * 40 + kind2, minlength=m * 40).reshape(m, 40)
    row = np.column_stack([np.arange(m), m - 1 + new.ravel().cumsum().reshape(m, 3), len(rows) - m + np.arange(m)])
    fits = _fitted_rows(rows)
    bits, lens = _written_rows(fits)
    value, size = bits[own, green], lens[own, green]
    for k, x in enumerate(channels, 1):
        r = row[own, k]
        value |= np.where(lit, bits[r, x], np.uint64(0)) << size.astype(np.uint64)
        size += np.where(lit, lens[r, x], 0)
    k, r = np.searchsorted(at, place), row[image[place], 4]
    for word, width in ((extra, more), (bits[r, kind2], lens[r, kind2]), (extra2, more2)):
        value[k] |= word.astype(np.uint64) << size[k].astype(np.uint64)
        size[k] += width
    # The streams of all images in one array, each from a word of its own: heads, codes, pixels.
    heads = [(0x2F | (w - 1) << 8 | (h - 1) << 22 | 1 << 36, 40), (1 | 7 << 3, 6), (_sole_words(mode.astype(np.uint64) << np.uint64(8) | np.uint64(0xFF000000)), 56),
             (1 | 1 << 1 | 7 << 3, 6), (_sole_words(element.astype(np.uint64) | np.uint64(0xFF000000)), 56), (1 << 1 | cache_bits << 2, 7)]
    codes, code_bits, runs = _code_rows(fits, np.repeat([wide, 256, 40], [m, len(whose), m]))
    turn = row.ravel()
    begin = np.repeat(runs.cumsum()[turn] - runs[turn].cumsum(), runs[turn])
    token = begin + np.arange(len(begin))
    ends = lambda sizes, whose: np.bincount(whose, sizes, minlength=m).astype(np.int64)
    token_of = np.repeat(np.repeat(np.arange(m), 5), runs[turn])
    head_bits, token_bits, pixel_bits = sum(n for _, n in heads), ends(code_bits[token], token_of), ends(size, own)
    total = head_bits + token_bits + pixel_bits
    each = (total >> 6) + 2
    start = 64 * (each.cumsum() - each)
    words = np.zeros(int(each.sum()), np.uint64)
    shift = np.cumsum([0, *(n for _, n in heads)][:-1])
    _place(words, (start[:, None] + shift).ravel(), np.column_stack([np.broadcast_to(np.asarray(v).astype(np.uint64), m) for v, _ in heads]).ravel())
    along = lambda sizes, whose, bits, begin: sizes.cumsum() - sizes + (begin - (bits.cumsum() - bits))[whose]
    _place(words, along(code_bits[token], token_of, token_bits, start + head_bits), codes[token])
    _place(words, along(size, own, pixel_bits, start + head_bits + token_bits), value)
    raw = words.tobytes()
    return [_file(raw[s >> 3 : (s >> 3) + (t + 7 >> 3)]) for s, t in zip(start.tolist(), total.tolist())]


#: Bytes of payload up to which images are stored together, and pixels of those that go at once.
_SHORT, _AT_ONCE = 1 << 18, 1 << 16


def store_many(payloads: list[bytes], part: int = PART) -> list[bytes]:
    """``store_parts`` of each payload: the same files, with the codes of short payloads built together."""
    out: list[bytes] = [b""] * len(payloads)
    waiting: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        for (i, _), file in zip(waiting, _store_together([px for _, px in waiting])):
            out[i] = file
        waiting.clear()

    held = 0
    for i, payload in enumerate(payloads):
        if not 0 < len(payload) <= min(part, _SHORT):
            out[i] = store_parts(payload, part)
            continue
        px = _shaped(payload)
        if _few_colours(px):
            out[i] = encode(px, palette=True)
            continue
        waiting.append((i, px))
        held += px.size
        if held >= _AT_ONCE:
            flush()
            held = 0
    if waiting:
        flush()
    return out


def store_parts(payload: bytes, part: int = PART) -> bytes:
    """Files of at most ``part`` bytes of payload, one after another; most payloads are one file.
    ``part`` is four times the square of a power of two from 16, so that no file but the last is padded."""
    return b"".join(store(payload[i : i + part]) for i in range(0, len(payload), part))


def decode_parts(raw: bytes) -> list[np.ndarray]:
    """The images of files that lie one after another."""
    images, at = [], 0
    while at < len(raw):
        size = 8 + struct.unpack_from("<I", raw, at + 4)[0]
        images.append(decode(raw[at : at + size]))
        at += size
    return images


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64, part: int = PART) -> DataFrame:
    """(id, n_bytes, media, pixels, payload, feature): UTF-8 of whole texts, padded with zeros to a
    positive multiple of ``unit``, stored as lossless WebP and read back from it.

    ``feature`` has the images' widths and heights and the mean of each channel read back;
    ``pixels`` are the ARGB words of the images in rows, as signed integers.  A payload above
    ``part`` bytes is several files one after another.  A null text is empty; rows and ids repeat
    as they come; an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession, 500)

    def read(text: bytes, size: int, file: bytes) -> tuple:
        images = decode_parts(file)
        px = images[0].ravel() if len(images) == 1 else np.concatenate([x.ravel() for x in images])
        back = px.astype(">u4").tobytes()[:size]
        means = np.frombuffer(back, np.uint8).reshape(-1, 4).mean(axis=0)
        shape = "+".join(f"{x.shape[1]}x{x.shape[0]}" for x in images) + " " + " ".join(f"{m:.3f}" for m in means)
        return len(text), file, px.view(np.int32), back, shape

    def run(batches):
        done: dict = {}  # short copies of one text are stored alike, so once a task
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            new = [t for t in dict.fromkeys(texts) if t not in done]
            sizes = [max(unit, -(-len(t) // unit) * unit) for t in new]
            files = store_many([t.ljust(n, b"\0") for t, n in zip(new, sizes)], part)
            own = {t: read(t, n, f) for t, n, f in zip(new, sizes, files)}
            rows = [own[t] if t in own else done[t] for t in texts]
            if len(done) + len(own) > 1000:
                done.clear()
            done.update((t, row) for t, row in own.items() if len(t) < 1 << 14)
            n, files, arrays, payloads, features = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(files, pa.binary()), pa.array(arrays, pa.list_(pa.int32())), pa.array(payloads, pa.binary()), pa.array(features, pa.string())],
                names=["id", "n_bytes", "media", "pixels", "payload", "feature"],
            )
        trim()

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_bytes long, media binary, pixels array<int>, payload binary, feature string").withColumnRenamed("id", id_col)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each row of ``documents`` as stored media and as read back; a null text is empty."""
    return media(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.size("pixels").cast("long").alias("n_pixels"),
    )
