"""Lossless WebP (VP8L, RFC 9649): a decoder of all its features, an encoder, and media columns.

The decoder reads prefix codes (simple and normal, with meta codes), literals,
back-references and colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms.  ``webp_lanes`` reads the entropy-coded pixels of many images at once.

``media_columns`` stores UTF-8 texts as RGB images of 64 pixels a row (tiles of at most
64 rows, one file after another), reads them back and computes features.  A tile has literals, or literals with
back-references and a colour cache, or a palette with back-references, whichever is shortest.

Nulls and empties: a null text is empty; an empty text is one row of blanks; an empty table gives no rows.  Equal texts
give equal media.  A null doc_id stays null; repeated rows count each; extra columns are ignored.  A long text is
stored whole, as many tiles.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
SIGNATURE = 0x2F
FARTHEST = (1 << 20) - 120


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.value = data, 0, 0, 0

    def fill(self) -> None:
        chunk = self.data[self.at : self.at + 6]
        self.at += 6
        self.value |= int.from_bytes(chunk, "little") << self.held
        self.held += 48

    def read(self, n: int) -> int:
        if self.held < n:
            self.fill()
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.held -= n
        return out

    def place(self) -> int:
        """The bit that comes next."""
        return self.at * 8 - self.held


class BitWriter:
    def __init__(self):
        self.done, self.held, self.left, self.n = bytearray(), 0, 0, 0

    def write(self, x: int, n: int) -> None:
        self.held |= x << self.left
        self.left += n
        self.n += n
        if self.left >= 1024:
            whole = self.left >> 3
            self.done += (self.held & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.held >>= 8 * whole
            self.left -= 8 * whole

    @property
    def value(self) -> int:
        return int.from_bytes(self.bytes(), "little")

    def bytes(self) -> bytes:
        return bytes(self.done) + self.held.to_bytes((self.left + 7) // 8, "little")


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (bits in stream order, length) of a canonical code."""
    out, code = {}, 0
    for n in range(1, 16):
        code <<= 1
        for s, length in enumerate(lengths):
            if length == n:
                out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
                code += 1
    return out


class Code:
    """A prefix code to read; a single symbol has no bits."""

    def __init__(self, lengths: list[int]):
        self.lengths = tuple(lengths)
        used = [s for s, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else (0 if not used else None)
        self.by_bits = {(n, c): s for s, (c, n) in canonical(lengths).items()} if self.single is None else {}
        self.depth = max(lengths, default=0)

    def next(self, r: BitReader) -> int:
        if self.single is not None:
            return self.single
        if r.held < 16:
            r.fill()
        for n in range(1, self.depth + 1):
            s = self.by_bits.get((n, r.value & ((1 << n) - 1)))
            if s is not None:
                r.value >>= n
                r.held -= n
                return s
        raise ValueError("no such prefix code")


_short: dict[tuple, list[tuple[int, int]]] = {}


def _short_table(lengths: tuple) -> list[tuple[int, int]]:
    """For each 7 bits the symbol of a code of code lengths and its bits."""
    if lengths not in _short:
        if len(_short) > 64:
            _short.clear()
        code = Code(list(lengths))
        table = [(code.single or 0, 0)] * 128
        for (n, c), s in code.by_bits.items():
            for k in range(c, 128, 1 << n):
                table[k] = (s, n)
        _short[lengths] = table
    return _short[lengths]


def read_lengths(r: BitReader, size: int) -> list[int]:
    """Code lengths of a prefix code of an alphabet."""
    lengths = [0] * size
    if r.read(1):
        several, wide = r.read(1), r.read(1)
        first = r.read(8 if wide else 1)
        lengths[first] = 1
        if several:
            lengths[r.read(8)] = 1
        return lengths
    own = [0] * 19
    for k in range(4 + r.read(4)):
        own[CODE_LENGTH_ORDER[k]] = r.read(3)
    table = _short_table(tuple(own))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        if r.held < 16:
            r.fill()
        s, used = table[r.value & 127]
        r.value >>= used
        r.held -= used
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            value, n = (last, 3 + r.read(2)) if s == 16 else (0, 3 + r.read(3) if s == 17 else 11 + r.read(7))
            if at + n > size:
                raise ValueError("code lengths run over")
            lengths[at : at + n] = [value] * n
            at += n
    return lengths


def _value(code: int, r: BitReader) -> int:
    """Length or distance of a prefix symbol."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + r.read(extra) + 1


_near: dict[int, dict[int, int]] = {}


def _near_codes(width: int) -> dict[int, int]:
    """The first code of each distance that has a short one in images of a width."""
    if width not in _near:
        if len(_near) > 64:
            _near.clear()
        _near[width] = {_distance(c, width): c for c in range(120, 0, -1)}
    return _near[width]


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _div(a: int, b: int) -> int:
    return -(-a // b)


def read_image(r: BitReader, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB numbers of an entropy-coded image."""
    bits = r.read(4) if r.read(1) else 0
    cache_size = 1 << bits if bits else 0
    meta, meta_bits, groups = None, 0, 1
    if top and r.read(1):
        meta_bits = r.read(3) + 2
        meta = (read_image(r, _div(width, 1 << meta_bits), _div(height, 1 << meta_bits), False) >> 8 & 0xFFFF).reshape(_div(height, 1 << meta_bits), -1).tolist()
        groups = max(max(row) for row in meta) + 1
    lengths = [[read_lengths(r, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    codes = [[Code(x) for x in group] for group in lengths]
    out: list[int] = []
    cache = [0] * cache_size
    total, shift, cached = width * height, 32 - bits, 0
    group = codes[0]
    while len(out) < total:
        at = len(out)
        if meta is not None:
            group = codes[meta[at // width >> meta_bits][at % width >> meta_bits]]
        s = group[0].next(r)
        if s < 256:
            red, blue, alpha = (c.next(r) for c in group[1:4])
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = _value(s - 256, r)
            back = _distance(_value(group[4].next(r), r), width)
            if back > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            piece = out[at - back : at - back + n]
            out += piece if len(piece) == n else (piece * _div(n, back))[:n]
        else:
            for x in out[cached:]:
                cache[(CACHE_FACTOR * x & 0xFFFFFFFF) >> shift] = x
            cached = at
            out.append(cache[s - 280])
        if cache_size and len(out) - cached > 4096:
            for x in out[cached:]:
                cache[(CACHE_FACTOR * x & 0xFFFFFFFF) >> shift] = x
            cached = len(out)
    return np.array(out, np.uint32)


# inverse transforms, on channel arrays (height, width, 4) of A, R, G, B


def _split(argb: np.ndarray, width: int, height: int) -> np.ndarray:
    a = argb.astype(np.uint32)
    return np.stack([a >> 24, a >> 16 & 255, a >> 8 & 255, a & 255], axis=-1).astype(np.int32).reshape(height, width, 4)


def predict(mode: int, left, top, right, corner):
    """The predicted pixel from its left, top, top-right and top-left neighbours."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return ((left + right) // 2 + top) // 2
    if mode < 10:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return (a + b) // 2
    if mode == 10:
        return ((left + corner) // 2 + (top + right) // 2) // 2
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    half = (left + top) // 2
    d = half - corner
    return np.clip(half + (np.sign(d) * (np.abs(d) // 2)), 0, 255)


def _predictor_pass(image: np.ndarray, modes: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    height, width, _ = image.shape
    out = image.copy()
    done = out if undo else image
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = np.array([255, 0, 0, 0]) if x == 0 else done[0, x - 1]
            elif x == 0:
                p = done[y - 1, 0]
            else:
                right = done[y - 1, x + 1] if x + 1 < width else done[y, 0]
                p = predict(int(modes[y >> bits, x >> bits]), done[y, x - 1], done[y - 1, x], right, done[y - 1, x - 1])
            out[y, x] = (image[y, x] + p if undo else image[y, x] - p) & 255
    return out


def _signed(x):
    return (x & 255 ^ 128) - 128


def _cross_pass(image: np.ndarray, factors: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """factors: (blocks, blocks, 4) with red-to-blue, green-to-blue and green-to-red in R, G and B."""
    height, width, _ = image.shape
    f = _signed(np.repeat(np.repeat(factors, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width])
    out = image.copy()
    green = _signed(image[..., 2])
    red_step = f[..., 3] * green >> 5
    out[..., 1] = (image[..., 1] + (red_step if undo else -red_step)) & 255
    red = _signed(out[..., 1] if undo else image[..., 1])
    step = (f[..., 2] * green >> 5) + (f[..., 1] * red >> 5)
    out[..., 3] = (image[..., 3] + (step if undo else -step)) & 255
    return out


def _green_pass(image: np.ndarray, undo: bool) -> np.ndarray:
    out = image.copy()
    for k in (1, 3):
        out[..., k] = (image[..., k] + (image[..., 2] if undo else -image[..., 2])) & 255
    return out


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of A, R, G, B of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return _decode_chunk(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def _decode_chunk(chunk: bytes) -> np.ndarray:
    r = BitReader(chunk)
    if r.read(8) != SIGNATURE:
        raise ValueError("bad signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    steps, coded = [], width
    while r.read(1):
        kind = r.read(2)
        if any(k == kind for k, *_ in steps):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            w, h = _div(coded, 1 << bits), _div(height, 1 << bits)
            steps.append((kind, coded, bits, _split(read_image(r, w, h, False), w, h)))
        elif kind == PALETTE:
            size = r.read(8) + 1
            table = _split(read_image(r, size, 1, False), size, 1)[0]
            steps.append((kind, coded, palette_bits(size), np.cumsum(table, axis=0) & 255))
            coded = _div(coded, 1 << palette_bits(size))
        else:
            steps.append((kind, coded, 0, None))
    image = _split(read_image(r, coded, height, True), coded, height)
    for kind, w, bits, more in reversed(steps):
        if kind == PREDICTOR:
            image = _predictor_pass(image, more[..., 2] & 15, bits, True)
        elif kind == CROSS_COLOUR:
            image = _cross_pass(image, more, bits, True)
        elif kind == SUBTRACT_GREEN:
            image = _green_pass(image, True)
        else:
            per = 1 << bits
            depth = 8 >> bits
            k = np.arange(w)
            index = image[:, k >> bits, 2] >> ((k & (per - 1)) * depth) & ((1 << depth) - 1)
            table = np.zeros((256, 4), np.int32)
            table[: len(more)] = more
            image = table[index]
    return image


# encoder


def code_lengths(counts: list[int], limit: int = 15) -> list[int]:
    """Lengths of a Huffman code of at most ``limit`` bits; counts are flattened until it fits."""
    used = [s for s, n in enumerate(counts) if n]
    if len(used) < 2:
        return [1 if s in used else 0 for s in range(len(counts))]
    floor = 0
    while True:
        heap = [(max(counts[s], floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        out = [0] * len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(out) <= limit:
            return out
        floor = max(1, floor * 2)


def write_lengths(w: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        w.write(1, 1)
        for s in used:
            w.write(s, 8)
        return
    tokens, at = [], 0
    while at < len(lengths):
        n = at
        while n < len(lengths) and lengths[n] == lengths[at]:
            n += 1
        run, value = n - at, lengths[at]
        at = n
        if value:
            tokens.append((value, 0, 0))
            run -= 1
        while run >= 3:
            if value:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
            elif run < 11:
                k = run
                tokens.append((17, k - 3, 3))
            else:
                k = min(run, 138)
                tokens.append((18, k - 11, 7))
            run -= k
        tokens += [(value, 0, 0)] * run
    counts = [0] * 19
    for s, _, _ in tokens:
        counts[s] += 1
    own = code_lengths(counts, 7)
    w.write(0, 1)
    last = max(k for k in range(19) if own[CODE_LENGTH_ORDER[k]])
    last = max(last, 3)
    w.write(last - 3, 4)
    for k in range(last + 1):
        w.write(own[CODE_LENGTH_ORDER[k]], 3)
    w.write(0, 1)
    code = canonical(own) if sum(n > 0 for n in own) > 1 else {}
    for s, extra, n in tokens:
        w.write(*code.get(s, (0, 0)))
        w.write(extra, n)


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & ((1 << n) - 1), n


def write_image(w: BitWriter, argb: list[int], width: int, top: bool, cache_bits: int = 0, references: bool = False) -> None:
    """An entropy-coded image, with a colour cache and back-references if asked for."""
    w.write(1 if cache_bits else 0, 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if top:
        w.write(0, 1)
    cache, tokens, at, seen, codes_near = [0] * (1 << cache_bits), [], 0, {}, _near_codes(width)
    while at < len(argb):
        n = 0
        if references and at + 3 <= len(argb):
            before = seen.get(tuple(argb[at : at + 3]))
            if before is not None and at - before <= FARTHEST:
                while at + n < len(argb) and n < 4096 and argb[before + n] == argb[at + n]:
                    n += 1
        for k in range(at, at + max(1, n)):
            seen[tuple(argb[k : k + 3])] = k
        if n >= 3:
            back = at - before
            near = codes_near.get(back, back + 120)
            tokens.append((256 + _prefix(n)[0], _prefix(n), _prefix(near)))
        else:
            n = 1
            x = argb[at]
            slot = (CACHE_FACTOR * x & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache[slot] == x:
                tokens.append((280 + slot, None, None))
            else:
                tokens.append((x >> 8 & 255, x, None))
        if cache_bits:
            for x in argb[at : at + n]:
                cache[(CACHE_FACTOR * x & 0xFFFFFFFF) >> (32 - cache_bits)] = x
        at += n
    counts = [[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for s, x, y in tokens:
        counts[0][s] += 1
        if s < 256:
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                counts[k][x >> shift & 255] += 1
        elif s < 280:
            counts[4][y[0]] += 1
    lengths = [code_lengths(c) for c in counts]
    codes = []
    for n in lengths:
        write_lengths(w, n)
        codes.append(canonical(n) if sum(x > 0 for x in n) > 1 else {})
    for s, x, y in tokens:
        w.write(*codes[0].get(s, (0, 0)))
        if s < 256:
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                w.write(*codes[k].get(x >> shift & 255, (0, 0)))
        elif s < 280:
            w.write(x[1], x[2])
            w.write(*codes[4].get(y[0], (0, 0)))
            w.write(y[1], y[2])


def _join(image: np.ndarray) -> list[int]:
    a = image.reshape(-1, 4).astype(np.uint32)
    return (a[:, 0] << 24 | a[:, 1] << 16 | a[:, 2] << 8 | a[:, 3]).tolist()


def _file(chunk: bytes) -> bytes:
    pad = b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad


def encode(image: np.ndarray, transforms=(), cache_bits: int = 0, references: bool = False) -> bytes:
    """A file of pixels (height, width, 4) of A, R, G, B.

    ``transforms``, in the order of the file: ("predictor", bits, modes), ("cross", bits, factors), ("green",), ("palette",).
    """
    height, width, _ = image.shape
    w = BitWriter()
    w.write(SIGNATURE, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    image = image.astype(np.int32)
    for name, *more in transforms:
        w.write(1, 1)
        if name == "green":
            w.write(SUBTRACT_GREEN, 2)
            image = _green_pass(image, False)
        elif name == "palette":
            table, index = np.unique(image.reshape(-1, 4), axis=0, return_inverse=True)
            index, bits = index.reshape(image.shape[:2]), palette_bits(len(table))
            w.write(PALETTE, 2)
            w.write(len(table) - 1, 8)
            steps = np.diff(table, axis=0, prepend=0) & 255
            write_image(w, _join(steps), len(table), False)
            wide = _div(image.shape[1], 1 << bits)
            packed = np.zeros((height, wide), np.int32)
            for x in range(image.shape[1]):
                packed[:, x >> bits] |= index[:, x] << ((x & ((1 << bits) - 1)) * (8 >> bits))
            image = np.zeros((height, wide, 4), np.int32)
            image[..., 0], image[..., 2] = 255, packed
        else:
            bits, data = more
            w.write(PREDICTOR if name == "predictor" else CROSS_COLOUR, 2)
            w.write(bits - 2, 3)
            if name == "predictor":
                sub = np.zeros((*data.shape, 4), np.int32)
                sub[..., 0], sub[..., 2] = 255, data
                image = _predictor_pass(image, data, bits, False)
            else:
                sub = data
                image = _cross_pass(image, data, bits, False)
            write_image(w, _join(sub), sub.shape[1], False)
    w.write(0, 1)
    write_image(w, _join(image), image.shape[1], True, cache_bits, references)
    return _file(w.bytes())


# texts

ROW = 64
MAX_ROWS = 64
UNIT = 3 * ROW
#: Bytes of text that are stored and read together.
WINDOW = 4 * K.WINDOW
#: Bytes from frequent to rare, by which the code of texts is made.
_FREQUENT = b" eatinhrosdlcumgfpwybv,.\nkEATINSHRD-|'xjqzLCUMGFPWYBVKXJQZ0123456789\xc3:;!?()\"/#$%&*+=@_<>[]{}\t"


def text_counts() -> list[int]:
    counts = [1] * 256
    for rank, byte in enumerate(_FREQUENT):
        counts[byte] = 200_000 // (rank + 3)
    for byte in range(0x80, 0xC0):
        counts[byte] = 1_200
    return counts


def text_lengths() -> list[int]:
    return code_lengths(text_counts(), 14)


def store(payloads: list[np.ndarray]) -> list[bytes]:
    """For each payload of whole rows its files, one for each tile.

    A tile has the shortest of: literals of a fixed code; literals, back-references and cached colours of another;
    a palette with back-references, where its colours are few.
    """
    from .webp_lanes import encode_tiles

    rows = [np.minimum(MAX_ROWS, len(x) // UNIT - np.arange(0, len(x) // UNIT, MAX_ROWS)) for x in payloads]
    files = iter(encode_tiles(np.concatenate(payloads), np.concatenate(rows)))
    return [b"".join(next(files) for _ in n) for n in rows]


def read_payload(media: bytes) -> np.ndarray:
    """RGB samples of all tiles of a media value, in order."""
    from .webp_lanes import decode_all

    return decode_all([media])[0]


def feature(payload: np.ndarray) -> str:
    """Mean and mean absolute step to the right of each channel, in thousandths, from whole-number sums."""
    p = payload.reshape(-1, ROW, 3).astype(np.int64)
    n = p.shape[0]
    mean = p.sum(axis=(0, 1)) * 1000 // (n * ROW)
    step = np.abs(np.diff(p, axis=1)).sum(axis=(0, 1)) * 1000 // (n * (ROW - 1))
    return "m" + ",".join(map(str, mean.tolist())) + ";s" + ",".join(map(str, step.tolist()))


SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, feature string"


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the stored ``media``, the ``payload`` read back from it and its features, for each row; a narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .webp_lanes import decode_all

        for batch in batches:
            raw, off = K.text_buffers(batch.column("text"))
            for i, j in K.windows(off, WINDOW):
                payloads = []
                for k in range(i, j):
                    data = raw[off[k] : off[k + 1]]
                    whole = np.full(max(1, _div(len(data), UNIT)) * UNIT, 32, np.uint8)
                    whole[: len(data)] = data
                    payloads.append(whole)
                media = store(payloads)
                back = decode_all(media)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(media, pa.binary()),
                        pa.array([x.tobytes() for x in back], pa.binary()), pa.array([feature(x) for x in back], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "media", "payload", "feature"],
                )

    return docs.select("doc_id", "text").mapInArrow(K.tidy(run), SCHEMA)
