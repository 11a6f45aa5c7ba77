"""Many lossless WebP images at once: texts are encoded, and entropy-coded pixels read, for arrays of images.

Encoding finds, for all tiles of a window together, the nearest earlier place of each run of three
pixels, the lengths of the matches there, the tokens that a greedy parse takes and the hits of the
colour cache, and lays the tokens' bits into words.

Reading goes through all images in lockstep (*lanes*): each step gives one pixel of every image that is not
done, by a literal, a colour of the cache, or the next pixel of a back-reference.  Prefix
codes are looked up by as many bits as the longest code has.
"""

from __future__ import annotations

import struct

import numpy as np

from . import kernels as K
from . import webp as W

#: Bits of the colour cache of texts, and weights of cached colours, lengths and distances against literals in their code.
CACHE_BITS = 9
CACHED, COPIED = 0.3, 0.12
#: Tiles with at most this many colours are also tried with a palette.
FEW_COLOURS = 16
_U = np.uint64


def _reference_code() -> list[list[int]]:
    """Code lengths of texts with colour cache and back-references: literals as in ``webp.text_lengths``."""
    literal = W.text_counts()
    total = sum(literal)
    lengths = [max(1, int(COPIED * total / (k + 2) ** 1.5)) for k in range(24)]
    cached = [max(1, int(CACHED * total / (1 << CACHE_BITS)))] * (1 << CACHE_BITS)
    distances = [1 << min(k, 20) for k in range(40)]
    green = W.code_lengths(literal + lengths + cached, 14)
    plain = W.code_lengths(literal, 14)
    return [green, plain, plain, [0] * 255 + [1], W.code_lengths(distances, 12)]


class Preset:
    """A fixed set of five prefix codes, with the bits that say so at the head of an image."""

    def __init__(self, lengths: list[list[int]], cache_bits: int):
        self.lengths, self.cache_bits = lengths, cache_bits
        w = W.BitWriter()
        w.write(0, 1)  # no transform
        w.write(1 if cache_bits else 0, 1)
        if cache_bits:
            w.write(cache_bits, 4)
        w.write(0, 1)  # no meta codes
        for n in lengths:
            W.write_lengths(w, n)
        self.head, self.head_bits = w.value, w.n + 40
        self.bits, self.size = [], []
        for n in lengths:
            bits, size = np.zeros(len(n), np.uint64), np.zeros(len(n), np.int64)
            if sum(x > 0 for x in n) > 1:
                for s, (code, k) in W.canonical(n).items():
                    bits[s], size[s] = code, k
            self.bits.append(bits)
            self.size.append(size)

    def head_bytes(self, rows: int) -> np.ndarray:
        value = W.SIGNATURE | (W.ROW - 1) << 8 | (rows - 1) << 22 | 1 << 36 | self.head << 40
        return np.frombuffer(value.to_bytes(-(-self.head_bits // 8), "little"), np.uint8)


_presets: list[Preset] = []


def presets() -> list[Preset]:
    """Literals alone; literals, cached colours and back-references."""
    if not _presets:
        text = W.text_lengths()
        _presets.extend([Preset([text + [0] * 24, text, text, [0] * 255 + [1], [1] + [0] * 39], 0), Preset(_reference_code(), CACHE_BITS)])
    return _presets


def _last_same(key: np.ndarray, bits: int) -> np.ndarray:
    """For each place the nearest earlier one of an equal key, or -1; ``key`` has at most ``bits`` bits, places have the rest."""
    n, wide = len(key), _U(64 - bits)
    both = np.sort(key << wide | np.arange(n, dtype=np.uint64))
    place = (both & ((_U(1) << wide) - _U(1))).astype(np.int64)
    same = both[1:] >> wide == both[:-1] >> wide
    out = np.full(n, -1, np.int64)
    out[place[1:][same]] = place[:-1][same]
    return out


def matches(pixel: np.ndarray, tile: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of a match of three pixels or more at each place with the nearest earlier place of its tile, lengths 1 where there is none."""
    n = len(pixel)
    length, back = np.ones(n, np.int64), np.zeros(n, np.int64)
    if n < 3:
        return length, back
    three = np.flatnonzero(np.arange(n) + 3 <= end[tile])
    p = pixel.astype(np.uint64)
    h = K.mix64(K.mix64(p[three] << _U(24) | p[three + 1]) + (p[three + 2] << _U(32)) + tile[three].astype(np.uint64))
    wide = max(1, n - 1).bit_length()
    before = _last_same(h >> _U(wide), 64 - wide)
    some = before >= 0
    at, before = three[some], three[before[some]]
    same = tile[at] == tile[before]
    for k in range(3):
        same &= pixel[at + k] == pixel[before + k]
    at, before = at[same], before[same]
    back[at] = at - before
    go_on = np.zeros(n, dtype=bool)  # the match goes on at the next place
    go_on[:-1] = (back[1:] == back[:-1]) & (back[1:] > 0) & (tile[1:] == tile[:-1])
    stop = np.flatnonzero(~go_on)
    run = stop[np.searchsorted(stop, at)] - at
    length[at] = np.minimum(run + 3, 4096)
    return length, back


def taken(length: np.ndarray, start: np.ndarray, end: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """The places at which a greedy parse of each tile has a token, by doubling the steps."""
    n = len(length)
    jump = np.arange(n + 1)
    jump[:n] += length
    done = jump[:n] >= end[tile]
    jump[:n][done] = n
    out = np.zeros(n + 1, dtype=bool)
    out[start] = True
    longest = int((end - start).max())
    step = 1
    while step < longest:
        new = jump[np.flatnonzero(out)]
        out[new] = True
        jump = jump[jump]
        step *= 2
    return np.flatnonzero(out[:n])


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their number) of lengths or distances."""
    v = value - 1
    bits = np.maximum(np.frexp(v.astype(np.float64))[1] - 2, 0)
    symbol = np.where(v < 4, v, 2 * (bits + 1) + (v >> bits & 1))
    bits = np.where(v < 4, 0, bits)
    return symbol, (v & ((1 << bits) - 1)).astype(np.uint64), bits


_near: list[np.ndarray] = []


def _distance_codes(back: np.ndarray) -> np.ndarray:
    if not _near:
        table = np.arange(1024) + 120
        for distance, code in W._near_codes(W.ROW).items():
            table[distance] = code
        _near.append(table)
    return np.where(back < 1024, _near[0][np.minimum(back, 1023)], back + 120)


def _literal_bits(code: Preset, pixel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    red, green, blue = pixel >> 16, pixel >> 8 & 255, pixel & 255
    n, value = code.size[0][green], code.bits[0][green]
    for k, channel in ((1, red), (2, blue)):
        value = value | code.bits[k][channel] << n.astype(np.uint64)
        n = n + code.size[k][channel]
    return value, n


def encode_tiles(samples: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """A file of each tile; ``samples`` are the RGB bytes of tiles of ``rows`` rows, one after the other."""
    rgb = samples.reshape(-1, 3)
    pixel = rgb[:, 0].astype(np.int64) << 16 | rgb[:, 1].astype(np.int64) << 8 | rgb[:, 2]
    size = rows * W.ROW
    end = np.cumsum(size)
    start = end - size
    tile = np.repeat(np.arange(len(rows)), size)
    plain, rich = presets()
    value, n = _literal_bits(plain, pixel)
    cost = plain.head_bits + np.add.reduceat(n, start)
    # tokens of the parse
    length, back = matches(pixel, tile, end)
    at = taken(length, start, end, tile)
    slot = (_U(W.CACHE_FACTOR) * (pixel.astype(np.uint64) | _U(0xFF000000)) & _U(0xFFFFFFFF)) >> _U(32 - rich.cache_bits)
    last = _last_same(tile.astype(np.uint64) << _U(rich.cache_bits) | slot, len(rows).bit_length() + rich.cache_bits)
    hit = (last >= 0) & (pixel[last] == pixel)
    v, m = _literal_bits(rich, pixel[at])
    cached = np.flatnonzero(hit[at])
    symbol = 280 + slot[at[cached]].astype(np.int64)
    v[cached], m[cached] = rich.bits[0][symbol], rich.size[0][symbol]
    copied = np.flatnonzero(length[at] >= 3)
    s, extra, bits = _prefixes(length[at[copied]])
    vv, mm = rich.bits[0][256 + s], rich.size[0][256 + s]
    vv |= extra << mm.astype(np.uint64)
    mm = mm + bits
    s, extra, bits = _prefixes(_distance_codes(back[at[copied]]))
    vv |= rich.bits[4][s] << mm.astype(np.uint64)
    mm = mm + rich.size[4][s]
    vv |= extra << mm.astype(np.uint64)
    v[copied], m[copied] = vv, mm + bits
    rich_cost = rich.head_bits + np.add.reduceat(m, np.searchsorted(at, start))
    # the cheaper of both for each tile
    better = rich_cost < cost
    use = ~better[tile]
    mine = better[tile[at]]
    use[at[mine]] = True
    value[at[mine]], n[at[mine]] = v[mine], m[mine]
    place = np.flatnonzero(use)
    value, n, owner = value[place], n[place], tile[place]
    head = np.where(better, rich.head_bits, plain.head_bits)
    total = np.minimum(cost, rich_cost)
    words = (total + 63) // 64 + 1
    base = (np.cumsum(words) - words) * 64
    run = np.cumsum(n) - n
    bit = base[owner] + head[owner] + run - run[np.searchsorted(owner, np.arange(len(rows)))][owner]
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    begin = K.runs(word)
    out[word[begin]] = np.add.reduceat(value << shift, begin)
    over = np.flatnonzero((bit & 63) + n > 64)
    out[word[over] + 1] += value[over] >> (_U(64) - shift[over])
    data = out.view(np.uint8)
    files = []
    colours = None
    if (size >= 4 * FEW_COLOURS).any():
        seen = np.sort(tile.astype(np.uint64) << _U(24) | pixel.astype(np.uint64))
        seen = seen[K.runs(seen)] >> _U(24)
        colours = np.bincount(seen.astype(np.int64), minlength=len(rows))
    for k in range(len(rows)):
        a, b = int(base[k]) >> 3, (int(total[k]) + 7) >> 3
        h = (rich if better[k] else plain).head_bytes(int(rows[k]))
        data[a : a + len(h)] |= h
        file = W._file(data[a : a + b].tobytes())
        if colours is not None and colours[k] <= FEW_COLOURS:
            file = min(file, _by_palette(pixel[start[k] : end[k]]), key=len)
        files.append(file)
    return files


_palettes: dict[bytes, bytes] = {}


def _by_palette(pixel: np.ndarray) -> bytes:
    """A file with a palette and back-references; few are kept, as blank tiles are many."""
    key = pixel.astype("<u4").tobytes()
    if key not in _palettes:
        if len(_palettes) >= 256:
            _palettes.clear()
        image = np.full((len(pixel) // W.ROW, W.ROW, 4), 255, np.int32)
        for k, shift in ((1, 16), (2, 8), (3, 0)):
            image[..., k] = (pixel >> shift & 255).reshape(-1, W.ROW)
        _palettes[key] = W.encode(image, [("palette",)], 0, True)
    return _palettes[key]


# reading


class LaneCode:
    """Lookup tables of five codes, by as many bits as the longest code of each has."""

    def __init__(self, lengths: list[list[int]], cache_bits: int):
        self.cache_bits, self.symbols, self.sizes, self.at, self.mask = cache_bits, [], [], [], []
        at = 0
        for n in lengths:
            code = W.Code(list(n))
            depth = code.depth if code.single is None else 0
            symbol, size = np.full(1 << depth, code.single or 0, np.int32), np.zeros(1 << depth, np.uint8)
            for (k, c), s in code.by_bits.items():
                symbol[c :: 1 << k], size[c :: 1 << k] = s, k
            self.symbols.append(symbol)
            self.sizes.append(size)
            self.at.append(at)
            self.mask.append((1 << depth) - 1)
            at += 1 << depth


_heads: dict[bytes, list[tuple[int, int, LaneCode | None]]] = {}


def head_of(chunk: bytes) -> tuple[int, LaneCode | None]:
    """(bit at which pixels begin, tables) of an image; no tables if it has transforms or meta codes.

    Heads met before are known by their bits.
    """
    known = _heads.setdefault(chunk[5:13], [])
    for n, value, code in known:
        if int.from_bytes(chunk[5 : 5 + (n + 7) // 8], "little") & ((1 << n) - 1) == value:
            return 40 + n, code
    r = W.BitReader(chunk)
    r.read(40)
    code, n = None, 1
    if not r.read(1):
        bits = r.read(4) if r.read(1) else 0
        if not r.read(1):
            code = LaneCode([W.read_lengths(r, k) for k in (280 + (1 << bits if bits else 0), 256, 256, 256, 40)], bits)
            n = r.place() - 40
    if len(_heads) > 256:
        _heads.clear()
        known = _heads.setdefault(chunk[5:13], [])
    if len(known) < 16:
        known.append((n, int.from_bytes(chunk[5 : 5 + (n + 7) // 8], "little") & ((1 << n) - 1), code))
    return 40 + n, code


_OFFSETS = {}


def _offsets(width: int) -> np.ndarray:
    """The distance of each short code in images of a width."""
    if width not in _OFFSETS:
        _OFFSETS[width] = np.array([0, *(W._distance(c, width) for c in range(1, 121))])
    return _OFFSETS[width]


def read_lanes(chunks: list[bytes], begin: list[int], codes: list[LaneCode], width: int, size: np.ndarray) -> list[np.ndarray]:
    """ARGB numbers of entropy-coded images of one width, of ``size`` pixels, without transforms or meta codes."""
    lanes = len(chunks)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    data = np.frombuffer(b"".join(chunks[k] + bytes(16) for k in order), np.uint8)
    room = np.array([len(chunks[k]) + 16 for k in order])
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()
    bit = (np.cumsum(room) - room) * 8 + np.array([begin[k] for k in order])
    limit = np.cumsum(room) * 8 - 128
    distinct = list({id(c): c for c in codes}.values())
    number = {id(c): k for k, c in enumerate(distinct)}
    symbol = np.concatenate([x for c in distinct for x in c.symbols]).astype(np.int64)
    bits_of = np.concatenate([x for c in distinct for x in c.sizes]).astype(np.uint64)
    base = np.cumsum([0, *(sum(map(len, c.symbols)) for c in distinct)])
    mine = np.array([number[id(codes[k])] for k in order])
    table = [(np.array([base[k] + c.at[f] for k, c in enumerate(distinct)], np.uint64)[mine], np.array([c.mask[f] for c in distinct], np.uint64)[mine]) for f in range(5)]
    cache_bits = np.array([c.cache_bits for c in distinct])[mine]
    cache_at = np.cumsum(1 << cache_bits) - (1 << cache_bits)
    cache = np.zeros(int((1 << cache_bits).sum()), np.int64)
    shift = (32 - cache_bits).astype(np.uint64)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int64)
    left, back = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    near = _offsets(width)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # lanes with more than t pixels
    copying = 0
    for t, m in enumerate(active.tolist()):
        lane = slice(0, m)
        if copying:
            copy = left[:m] > 0
            lane = np.flatnonzero(~copy)
        if isinstance(lane, slice) or len(lane):
            p = bit[lane]
            word = words[p >> 3] >> (p & 7).astype(np.uint64)
            key = (table[0][0][lane] + (word & table[0][1][lane])).view(np.int64)
            green, used = symbol[key], bits_of[key]
            value, rest, all_ = green << 8, word >> used, used
            for f, up in ((1, 16), (2, 0), (3, 24)):
                key = (table[f][0][lane] + (rest & table[f][1][lane])).view(np.int64)
                value = value | symbol[key] << up
                n = bits_of[key]
                rest = rest >> n
                all_ = all_ + n
            other = np.flatnonzero(green >= 256)
            if len(other):
                k = other if isinstance(lane, slice) else lane[other]
                s, spent = green[other], used[other]
                hit = s >= 280
                value[other[hit]] = cache[cache_at[k[hit]] + s[hit] - 280]
                ref = np.flatnonzero(~hit)
                if len(ref):
                    k, s, spent_ref = k[ref], s[ref] - 256, spent[ref]
                    after = word[other[ref]] >> spent_ref
                    extra = np.maximum((s - 2) >> 1, 0)
                    run = np.where(s < 4, s, ((2 + (s & 1)) << extra) + (after & ((_U(1) << extra.astype(np.uint64)) - _U(1))).view(np.int64)) + 1
                    q = bit[k] + (spent_ref + extra.astype(np.uint64)).view(np.int64)
                    after = words[q >> 3] >> (q & 7).astype(np.uint64)
                    key = (table[4][0][k] + (after & table[4][1][k])).view(np.int64)
                    s, n = symbol[key], bits_of[key]
                    after = after >> n
                    extra_ = np.maximum((s - 2) >> 1, 0)
                    far = np.where(s < 4, s, ((2 + (s & 1)) << extra_) + (after & ((_U(1) << extra_.astype(np.uint64)) - _U(1))).view(np.int64)) + 1
                    far = np.where(far > 120, far - 120, near[np.minimum(far, 120)])
                    if (far > t).any() or (t + run > size[k]).any():
                        raise ValueError("a back-reference leaves the image")
                    spent[ref] = spent_ref + (extra + extra_).astype(np.uint64) + n
                    value[other[ref]] = out[start[k] + t - far]
                    left[k], back[k] = run, far
                    copying += int((run > 1).sum())
                all_[other] = spent
            bit[lane] = p + all_.view(np.int64)
            if copying or len(other):
                left[lane] -= left[lane] > 0
            out[start[lane] + t] = value
        if not isinstance(lane, slice):
            k = np.flatnonzero(copy)
            value = out[start[k] + t - back[k]]
            out[start[k] + t] = value
            left[k] -= 1
            copying -= int((left[k] == 0).sum())
        color = out[start[:m] + t]
        slot = (color.view(np.uint64) * _U(W.CACHE_FACTOR) & _U(0xFFFFFFFF)) >> shift[:m]
        cache[cache_at[:m] + slot.view(np.int64)] = color
    if (bit > limit).any():
        raise ValueError("an image ends early")
    result: list[np.ndarray] = [np.zeros(0, np.uint32)] * lanes
    for k, a, n in zip(order.tolist(), start.tolist(), size.tolist(), strict=True):
        result[k] = out[a : a + n].astype(np.uint32)
    return result


def decode_files(media: bytes) -> list[tuple[int, int]]:
    """(start, end) of each file's image data in a run of files."""
    found, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        stop = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        if stop > len(media):
            raise ValueError("a file is cut short")
        k = at + 12
        while media[k : k + 4] != b"VP8L":
            k += 8 + (struct.unpack_from("<I", media, k + 4)[0] + 1) // 2 * 2
            if k + 8 > stop:
                raise ValueError("no lossless image")
        found.append((k + 8, k + 8 + struct.unpack_from("<I", media, k + 4)[0]))
        at = stop
    return found


def decode_all(media: list[bytes]) -> list[np.ndarray]:
    """RGB samples of each run of files, in order; images of plain heads are read in lanes, others one by one."""
    pieces: list[list[np.ndarray | None]] = []
    by_width: dict[int, list[tuple]] = {}
    for k, x in enumerate(media):
        pieces.append([])
        for a, b in decode_files(x):
            chunk = x[a:b]
            head = int.from_bytes(chunk[:5], "little")
            if head & 255 != W.SIGNATURE or head >> 37:
                raise ValueError("bad signature or version")
            width, height = (head >> 8 & 16383) + 1, (head >> 22 & 16383) + 1
            bit, code = head_of(chunk)
            if code is None:
                pieces[-1].append(W._decode_chunk(chunk)[..., 1:].astype(np.uint8).reshape(-1))
            else:
                by_width.setdefault(width, []).append((k, len(pieces[-1]), chunk, bit, code, width * height))
                pieces[-1].append(None)
    for width, lanes in by_width.items():
        done = read_lanes([x[2] for x in lanes], [x[3] for x in lanes], [x[4] for x in lanes], width, np.array([x[5] for x in lanes]))
        for (k, at, *_), argb in zip(lanes, done, strict=True):
            pieces[k][at] = np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=1).astype(np.uint8).reshape(-1)
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in pieces]
