"""Operator 9: media columns as progressive JPEG, decoded by numpy for many images at once.

The decoder accumulates spectral selection and successive approximation scans into coefficient arrays, undoes the cosine
transform, upsamples chroma and gives full-resolution RGB. The writer stores any bytes without loss as quantised coefficients.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import batches, prepared, table

# Fixed values of the format: markers, and the order of coefficients along the diagonals, made by rule.
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, APP9 = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xE9
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))])
#: The cosine basis in whole numbers of 1/4096: sums of products stay whole, so results don't depend on their order.
_BASIS = np.round(4096 * np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]))


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks
    high: int = 0
    first: int = 0  # its first block among all blocks of the batch


@dataclass
class Image:
    width: int = 0
    height: int = 0
    restart: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    extra: bytes = b""
    scans: list[tuple] = field(default_factory=list)


def _lookup(counts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """For each 16 bits that can come next: 256 * the length of the code they begin with + its symbol; 0 for none."""
    out, at, k = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            span = 1 << (16 - length)
            out[at : at + span] = 256 * length + int(symbols[k])
            at, k = at + span, k + 1
    return out


_TABLES: dict[bytes, np.ndarray] = {}


def _table(counts: bytes, symbols: bytes) -> np.ndarray:
    key = counts + symbols
    if key not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[key] = _lookup(np.frombuffer(counts, np.uint8), np.frombuffer(symbols, np.uint8))
    return _TABLES[key]


#: A marker: FF and then neither 0 (a stuffed FF), FF, nor one of the restart markers, which stay inside scans.
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def parse(data: bytes) -> Image:
    """The headers of a progressive image and where the bytes of its scans are; only baseline-precision SOF2 files."""
    if data[:2] != bytes([0xFF, SOI]):
        raise ValueError("not a JPEG")
    image, tables, at = Image(), {}, 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        mark = data[at + 1]
        if mark == EOI:
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == SOF2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            for i, c in enumerate(image.components):
                c.name = body[6 + 3 * i]
            across, down = (max(c.h for c in image.components), max(c.v for c in image.components))
            mw, mh = -(-image.width // (8 * across)), -(-image.height // (8 * down))
            for c in image.components:
                c.wide, c.high = mw * c.h, mh * c.v
        elif 0xC0 <= mark <= 0xCF and mark not in (DHT, 0xC8, 0xCC):
            raise ValueError("only progressive images with Huffman codes are read")
        elif mark == DQT:
            while body:
                if body[0] >> 4:
                    image.quants[body[0] & 15], body = np.frombuffer(body[1:129], ">u2").astype(np.float64), body[129:]
                else:
                    image.quants[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.float64), body[65:]
        elif mark == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif mark == DRI:
            image.restart = int.from_bytes(body, "big")
        elif mark == APP9:
            image.extra = body
        elif mark == SOS:
            n = body[0]
            chosen = [next(i for i, c in enumerate(image.components) if c.name == body[1 + 2 * k]) for k in range(n)]
            codes = [(tables.get(body[2 + 2 * k] >> 4), tables.get(16 + (body[2 + 2 * k] & 15))) for k in range(n)]
            low, high, approx = body[1 + 2 * n : 4 + 2 * n]
            stop = _MARKER.search(data, at).start()
            image.scans.append((tuple(chosen), tuple(codes), low, high, approx >> 4, approx & 15, at, stop))
            at = stop


class Bits:
    """Many bit strings in one array, read side by side; each caller keeps the places its rows have come to."""

    def __init__(self, data: np.ndarray) -> None:
        d = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
        pair = d[:-1] << np.uint64(8) | d[1:]
        four = pair[:-2] << np.uint64(16) | pair[2:]
        #: The 56 bits from each byte on.
        self.words = (four[:-3] << np.uint64(24) | four[3:] & np.uint64(0xFFFFFF)).astype(np.int64)

    def peek(self, at: np.ndarray, n: int) -> np.ndarray:
        """The next n bits (48 at most) at each place."""
        return (self.words[at >> 3] >> (56 - n - (at & 7))) & ((1 << n) - 1)

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits, n by row; moves the places on."""
        value = (self.words[at >> 3] >> (56 - n - (at & 7))) & ((1 << n) - 1)
        at += n
        return value

    def symbol(self, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(zeros to pass, size of the value, value bits) of the next symbol; its code and its bits are read together."""
        word = (self.words[at >> 3] >> (16 - (at & 7))) & 0xFFFFFFFFFF  # 40 bits
        found = table[word >> 24]
        if len(found) and found.min() < 256:
            raise ValueError("the bits hold no code")
        length, run, n = found >> 8, found >> 4 & 15, found & 15
        value = (word >> (40 - length - n)) & ((1 << n) - 1)
        at += length
        return run, n, value


def _signed(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(value < (1 << n) >> 1, value - (1 << n) + 1, value)


def scan_dc(bits: Bits, places: np.ndarray, blocks: np.ndarray, component: np.ndarray, coefs: np.ndarray, tables: dict[int, np.ndarray], refine: bool, shift: int) -> None:
    """blocks: (strings, steps) the block read at each step of each string, -1 for none; component: of each step."""
    last = {c: np.zeros(len(blocks), np.int64) for c in np.unique(component)}
    for t in range(blocks.shape[1]):
        rows = np.flatnonzero(blocks[:, t] >= 0)
        at, b = places[rows], blocks[rows, t]
        if refine:
            coefs[b, 0] |= (bits.peek(at, 1) << shift).astype(coefs.dtype)
            at += 1
        else:
            c = component[t]
            _, n, value = bits.symbol(at, tables[c])
            at += n
            last[c][rows] += _signed(value, n)
            coefs[b, 0] = last[c][rows] << shift
        places[rows] = at


def scan_ac_first(bits: Bits, places: np.ndarray, blocks: np.ndarray, coefs: np.ndarray, table: np.ndarray, low: int, high: int, shift: int) -> None:
    skip = np.zeros(len(blocks), np.int64)  # blocks still to pass by an end-of-band run
    for t in range(blocks.shape[1]):
        rows = np.flatnonzero(blocks[:, t] >= 0)
        held = skip[rows] > 0
        skip[rows[held]] -= 1
        rows = rows[~held]
        at = places[rows]
        got = np.zeros((high - low + 1, len(rows)), coefs.dtype)
        k = 0
        while k <= high - low and len(rows):  # as long as all rows are at the same coefficient
            before = at.copy()
            run, n, value = bits.symbol(at, table)
            if run.any() or not n.all():
                at = before
                break
            at += n
            got[k] = _signed(value, n) << shift
            k += 1
        live = np.arange(len(rows)) if k <= high - low else np.zeros(0, np.int64)
        now = np.full(len(live), k)
        while len(live):
            own = at[live]
            run, n, value = bits.symbol(own, table)
            now += run
            some = n > 0
            over = ~some & (run < 15)
            if (now > high - low).any() and (now[some] > high - low).any():
                raise ValueError("a coefficient lies beyond its band")
            got[now[some], live[some]] = _signed(value[some], n[some]) << shift
            own += n
            if over.any():
                end = own[over]
                skip[rows[live[over]]] = (1 << run[over]) - 1 + bits.take(end, run[over])
                own[over] = end
                now[over] = 64
            now += 1
            at[live] = own
            go = now <= high - low
            live, now = live[go], now[go]
        places[rows] = at
        coefs[blocks[rows, t], low : high + 1] = got.T


def scan_ac_refine(bits: Bits, places: np.ndarray, blocks: np.ndarray, coefs: np.ndarray, table: np.ndarray, low: int, high: int, shift: int) -> None:
    """Each row passes so many zero coefficients, giving every other one a bit, and then puts a new one, until its band ends."""
    skip = np.zeros(len(blocks), np.int64)
    bit, width = 1 << shift, high - low + 1
    for t in range(blocks.shape[1]):
        rows = np.flatnonzero(blocks[:, t] >= 0)
        at = places[rows]
        c = coefs[blocks[rows, t], low : high + 1].astype(np.int32)
        had = c != 0
        now = np.zeros(len(rows), np.int64)  # the coefficient each row has come to
        ended = skip[rows] > 0
        skip[rows[ended]] -= 1
        while not ended.all():
            live = np.flatnonzero(~ended)
            own = at[live]
            run, n, _ = bits.symbol(own, table)
            over = (n == 0) & (run < 15)
            sign = bits.peek(own, 1)
            own += n  # a new coefficient is one bit: its sign
            if over.any():
                end = own[over]
                skip[rows[live[over]]] = (1 << run[over]) - 1 + bits.take(end, run[over])
                own[over] = end
                ended[live[over]] = True
            at[live] = own
            # The others go to the zero coefficient after `run` more of them, or to the band's end.
            go, want = live[~over], run[~over]
            zeros = np.cumsum((~had[go] & (np.arange(width) >= now[go, None])), 1)
            stop = np.where(zeros[:, -1] > want, (zeros > want[:, None]).argmax(1), width)
            _corrections(bits, at, c, had, go, now[go], stop, bit)
            new = (n[~over] > 0) & (stop < width)
            c[go[new], stop[new]] = np.where(sign[~over][new] == 1, bit, -bit)
            now[go] = stop + 1
            ended[go[now[go] >= width]] = True
        _corrections(bits, at, c, had, np.arange(len(rows)), now, np.full(len(rows), width), bit)
        places[rows] = at
        coefs[blocks[rows, t], low : high + 1] = c


def _corrections(bits: Bits, at: np.ndarray, c: np.ndarray, had: np.ndarray, rows: np.ndarray, start: np.ndarray, stop: np.ndarray, bit: int) -> None:
    """One bit for each coefficient in [start, stop) of the rows that was there before."""
    if not len(rows):
        return
    width = c.shape[1]
    all_rows = len(rows) == len(c)
    if all_rows and not start.any() and (stop == width).all() and had.all():
        for lo in range(0, width, 32):
            n = min(32, width - lo)
            more = (bits.peek(at, n)[:, None] >> np.arange(n - 1, -1, -1)) & 1
            part = c[:, lo : lo + n]
            part += np.where(part > 0, bit, -bit) * more.astype(np.int32)
            at += n
        return
    steps = np.arange(width)
    here = had[rows] & (steps >= start[:, None]) & (steps < stop[:, None])
    order = np.cumsum(here, 1)
    r, k = np.nonzero(here)
    more = bits.peek(at[rows[r]] + order[r, k] - 1, 1)
    old = c[rows[r], k]
    c[rows[r], k] = old + np.where(old > 0, bit, -bit) * more.astype(np.int32)
    at[rows] += order[:, -1]


def _strings(part: np.ndarray, scans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of several scans without stuffed zeros, where the strings between restart markers begin in them)."""
    ff = np.flatnonzero(part[:-1] == 0xFF)
    after = part[ff + 1]
    marks, stuffed = ff[(after >= 0xD0) & (after <= 0xD7)], ff[after == 0] + 1
    begins = np.sort(np.concatenate([scans, marks + 2]))
    begins -= np.searchsorted(stuffed, begins)
    return (np.delete(part, stuffed) if len(stuffed) else part), begins


def _places(image: Image, chosen: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(component of each block of a scan's unit, the scan's units by their blocks)."""
    across, down = max(x.h for x in image.components), max(x.v for x in image.components)
    if len(chosen) == 1:
        c = image.components[chosen[0]]
        w, h = -(-image.width * c.h // (8 * across)), -(-image.height * c.v // (8 * down))  # units beyond the picture aren't coded
        return np.array(chosen), c.first + _grid(w, h, c.wide, 1, 1)[:, :1]
    parts, who = [], []
    for i in chosen:
        c = image.components[i]
        parts.append(c.first + _grid(c.wide // c.h, c.high // c.v, c.wide, c.h, c.v))
        who += [i] * (c.h * c.v)
    return np.array(who), np.concatenate(parts, 1)


@lru_cache(maxsize=4096)
def _grid(across: int, down: int, wide: int, h: int, v: int) -> np.ndarray:
    """The blocks of each unit of h by v, in a plane that is `wide` blocks wide."""
    y, x, dy, dx = np.ix_(np.arange(down), np.arange(across), np.arange(v), np.arange(h))
    return ((y * v + dy) * wide + x * h + dx).reshape(across * down, h * v)


def coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """(the images, all their blocks of quantised coefficients along the diagonals); scans alike are read side by side."""
    images, blocks = [parse(x) for x in files], 0
    for image in images:
        for c in image.components:
            c.first = blocks
            blocks += c.wide * c.high
    coefs = np.zeros((blocks, 64), np.int16)
    for k in range(max((len(x.scans) for x in images), default=0)):
        alike: dict[tuple, list[int]] = {}
        for i, image in enumerate(images):
            if k < len(image.scans):
                alike.setdefault((*image.scans[k][:6], image.restart), []).append(i)
        for (chosen, codes, low, high, before, shift, restart), members in alike.items():
            parts, rows = [], []
            for i in members:
                parts.append(files[i][images[i].scans[k][6] : images[i].scans[k][7]])
                who, units = _places(images[i], chosen)
                n = restart or len(units)
                if short := -len(units) % n:
                    units = np.concatenate([units, np.full((short, units.shape[1]), -1)])
                rows.append(units.reshape(-1, n * units.shape[1]))
            width = max(r.shape[1] for r in rows)
            rows = np.concatenate([r if r.shape[1] == width else np.pad(r, ((0, 0), (0, width - r.shape[1])), constant_values=-1) for r in rows])
            data, begins = _strings(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(x) for x in parts[:-1]]))
            if len(begins) != len(rows):
                raise ValueError("a scan doesn't have the restart markers that it should")
            bits, places = Bits(data), begins * 8
            if low == 0:
                tables = {c: _table(*code[0]) for c, code in zip(chosen, codes, strict=True) if code[0]}
                scan_dc(bits, places, rows, np.resize(who, width), coefs, tables, before > 0, shift)
            else:
                (scan_ac_refine if before else scan_ac_first)(bits, places, rows, coefs, _table(*codes[0][1]), low, high, shift)
    return images, coefs


def pixels(image: Image, coefs: np.ndarray) -> np.ndarray:
    """(height, width, 3) RGB: inverse transform in whole numbers, chroma repeated to full resolution, BT.601 in whole numbers."""
    planes = []
    across, down = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        x = np.empty((c.wide * c.high, 64))
        x[:, ZIGZAG] = coefs[c.first : c.first + len(x)] * image.quants[c.quant]
        x = x.reshape(-1, 8, 8) @ _BASIS
        x = _BASIS.T @ x
        plane = np.clip(np.floor(x / (1 << 24) + 0.5) + 128, 0, 255).astype(np.int32)
        plane = plane.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)
        planes.append(plane.repeat(down // c.v, 0).repeat(across // c.h, 1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.stack(planes * 3, 2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    rgb = np.stack([(y + 91881 * cr + half) >> 16, (y - 22554 * cb - 46802 * cr + half) >> 16, (y + 116130 * cb + half) >> 16], 2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def decode(files: list[bytes]) -> list[np.ndarray]:
    images, coefs = coefficients(files)
    return [pixels(image, coefs) for image in images]


# ---- the writer ---------------------------------------------------------------------------------------------------


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body


def _codes(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(body of a table's segment without its name, {symbol: (code, length)}) for the given lengths of codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, out, code, last = [0] * 16, {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
        counts[last - 1] += 1
    return bytes(counts) + bytes(order), out


# A value of s bits has a code of 12 - s bits (DC) or 8 - s bits (AC): every coefficient is as wide as any other, and the
# fields of all blocks are set by whole columns. The end of a band has one bit where a scan only refines.
_DC_BODY, _DC = _codes({s: 12 - s for s in range(9)})
_AC_BODY, _AC = _codes({**{s: 8 - s for s in range(1, 8)}, 0: 8})
_FIX_BODY, _FIX = _codes({0: 1, 1: 2})
#: Scans of AC coefficients: the first and last one, and the component.
_BANDS = ((1, 5, 1), (6, 63, 1), (1, 63, 2), (1, 63, 3))


def _fields(values: np.ndarray, codes: dict[int, tuple[int, int]], total: int) -> np.ndarray:
    """Each value's code and bits as one number of `total` bits."""
    n = np.zeros(values.shape, np.int32)
    size = np.abs(values)
    for k in range(9):
        n += size >= (1 << k)
    code = np.zeros(16, np.int32)
    for s, (c, _) in codes.items():
        code[s] = c
    return (code[n] << n) + np.where(values < 0, values + (1 << n) - 1, values)


def shapes(n_blocks: int) -> tuple[int, int]:
    """Width and height in units of 16 by 16 pixels, six blocks each, that hold so many blocks."""
    units = -(-n_blocks // 6)
    wide = -(-units // 4095)
    return wide, -(-units // wide)


#: A byte's coefficient: none is 0 or 1 away from it, so that each has a first scan and one bit of refinement.
_COEF = np.where(np.arange(256) < 128, np.arange(256) - 129, np.arange(256) - 126).astype(np.int16)
_WIDE = _COEF.astype(np.int32)
_FIRST = _fields(_WIDE >> 1, _DC, 12) << 4 | 0xF  # 12 bits and a filling of ones
#: What each byte becomes in each kind of scan.
_DC_BYTES = np.stack([_FIRST >> 8, _FIRST & 255], 1).astype(np.uint8)
_DC_MORE = ((_WIDE & 1) << 7 | 0x7F).astype(np.uint8)
_AC_BYTES = _fields(np.sign(_WIDE) * (np.abs(_WIDE) >> 1), _AC, 8).astype(np.uint8)
_AC_MORE = (np.abs(_WIDE) & 1).astype(np.uint8)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as a progressive 4:2:0 image whose coefficients are its bytes.

    Blocks fill Y, then Cb, then Cr; each block is a restart interval, so that readers can go through all blocks at once.
    """
    sizes = [shapes(len(p) // 64) for p in payloads]
    counts = [6 * w * h for w, h in sizes]
    at = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(64 * at[-1], np.uint8)
    for p, a in zip(payloads, at, strict=False):
        flat[64 * a : 64 * a + len(p)] = np.frombuffer(p, np.uint8)
    flat = flat.reshape(-1, 64)
    parts = {"dc": _DC_BYTES[flat[:, 0]], "dc+": _DC_MORE[flat[:, :1]]}
    for low, high in {b[:2] for b in _BANDS}:
        parts[low, high] = _AC_BYTES[flat[:, low : high + 1]]
    bits = np.zeros((len(flat), 64), np.uint8)  # a bit that ends the band, and one for each coefficient
    bits[:, 1:] = _AC_MORE[flat[:, 1:]]
    parts["ac+"] = np.packbits(bits, axis=1)
    tables = _segment(DQT, b"\0" + bytes([1]) * 64) + _segment(DHT, b"\x00" + _DC_BODY + b"\x10" + _AC_BODY + b"\x11" + _FIX_BODY) + _segment(DRI, b"\0\1")
    # Blocks in their order are Y, Cb, Cr of each image; markers count up from each component's first block.
    units = np.array([w * h for w, h in sizes])
    spans = np.concatenate([[0], np.cumsum((units[:, None] * [4, 1, 1]).reshape(-1))])
    place = np.arange(spans[-1]) - np.repeat(spans[:-1], np.diff(spans))
    files = [[b"\xff\xd8", _segment(APP9, len(p).to_bytes(8, "big")), tables, _segment(SOF2, b"\x08" + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))] for p, (w, h) in zip(payloads, sizes, strict=True)]
    script = [("dc", 0, 0, 0x01, 0, c) for c in (1, 2, 3)] + [("dc+", 0, 0, 0x10, 0, c) for c in (1, 2, 3)] + [((low, high), low, high, 0x01, 0, c) for low, high, c in _BANDS] + [("ac+", 1, 63, 0x10, 1, c) for c in (1, 2, 3)]
    written = {part: _scan(rows, place) for part, rows in parts.items()}
    cuts = {part: starts[spans].tolist() for part, (_, starts) in written.items()}
    for part, low, high, approx, ac, c in script:
        head, data, cut = _segment(SOS, bytes([1, c, ac, low, high, approx])), written[part][0], cuts[part]
        for k, out in enumerate(files):
            out += (head, data[cut[3 * k + c - 1] : cut[3 * k + c] - 2])
    return [b"".join([*out, b"\xff\xd9"]) for out in files]


def _scan(rows: np.ndarray, place: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(rows of bytes with a zero after each FF and a restart marker after each row, where rows begin and the end)."""
    n, width = rows.shape
    body = np.empty((n, width + 2), np.uint8)
    body[:, :width] = rows
    body[:, width] = 0xFF
    body[:, width + 1] = 0xD0 + place % 8
    flat, starts = body.reshape(-1), np.arange(n + 1) * (width + 2)
    ff = np.flatnonzero(rows == 0xFF)
    if len(ff):
        at = ff // width * (width + 2) + ff % width + 1
        flat, starts = np.insert(flat, at, 0), starts + np.searchsorted(at, starts, "right")
    return flat.tobytes(), starts


def payload(image: Image, coefs: np.ndarray) -> bytes:
    """The bytes that encode() stored."""
    v = coefs[image.components[0].first : image.components[-1].first + image.components[-1].wide * image.components[-1].high].reshape(-1)
    return np.where(v < 0, v + 129, v + 126).astype(np.uint8).tobytes()[: int.from_bytes(image.extra, "big")]


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and image (the stored file) of each row of docs (doc_id, text); null texts are empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, files = [], []
            for _, raws in batches(frame["text"].tolist(), 1 << 19):
                sizes += [len(r) for r in raws]
                files += encode([padded(r) for r in raws])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": sizes, "image": files})

    prepared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, image binary")


def tensors(images: DataFrame) -> DataFrame:
    """images (doc_id, image) with height, width and rgb (bytes, row by row) of the decoded pictures.

    Null images give nulls; a file that isn't a progressive JPEG fails the job with what is wrong with it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, image in zip(frame["doc_id"], frame["image"], strict=True):
                rgb = None if image is None else decode([bytes(image)])[0]
                rows.append((doc_id, *((None, None, None) if rgb is None else (rgb.shape[0], rgb.shape[1], rgb.tobytes()))))
            yield pd.DataFrame(rows, columns=["doc_id", "height", "width", "rgb"])

    prepared(images.sparkSession)
    return images.select("doc_id", "image").mapInPandas(run, "doc_id long, height int, width int, rgb binary")


def describe(image: Image, rgb: np.ndarray) -> str:
    """Size, mean colour in thousandths, and the shares of eight levels of green in thousandths: whole numbers all."""
    n = rgb.shape[0] * rgb.shape[1]
    means = [int(rgb[:, :, k].sum(dtype=np.int64)) * 1000 // n for k in range(3)]
    levels = np.bincount(rgb[:, :, 1].reshape(-1) >> 5, minlength=8) * 1000 // n
    return f"{image.width}x{image.height} " + ",".join(map(str, means)) + " " + ",".join(map(str, levels))


def store(docs: DataFrame) -> DataFrame:
    """Each text of docs (doc_id, text) stored as an image and read back: sizes, digests, and features of its RGB tensor.

    The payload is the text's UTF-8 bytes and zeros up to a positive multiple of 64; null is empty. Files are written and
    decoded in groups of a bounded number of bytes, a longer text by itself. Equal texts give equal values, whatever they
    are batched with: all arithmetic is in whole numbers. Repeated rows are rows of their own; an empty table gives none;
    other columns aren't kept.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for _, raws in batches(frame["text"].tolist(), 1 << 19):
                files = encode([padded(r) for r in raws])
                images, coefs = coefficients(files)
                for raw, file, image in zip(raws, files, images, strict=True):
                    back = payload(image, coefs)
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), describe(image, pixels(image, coefs))))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    prepared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents"))


QUERIES = {"op9_media": op9_media}
ORACLES: dict[str, str] = {}
