"""Byte-level BPE as a monoid: encode halves, join neighbours at their seam; decode by concatenation up the tree.

Two trees of the same kind stand on one another.

*Merges.*  A stretch of bytes is halved down to ``LEAF_BYTES``, which are merged by the ranks, many
stretches at once (``merged_all``).  Neighbours are joined by encoding again a window of ``k`` tokens on each side of the seam, with k = 0, 1, 2, 4, ...
until the tokens outside are proven to stay.  The proof is by pairs: a sequence of tokens
is the encoding of its bytes exactly if each two neighbours are that of
theirs.  All pairs inside both halves and the window are such, so only the two pairs where the
window meets the rest are looked at.

*Matches.*  A text is halved down to ``LEAF_CHARS`` characters, which are cut into matches of ``PATTERN``.
A match depends only on the text from its start to two characters after its end (the pattern looks no further ahead),
so of the left half all matches that end two characters before the seam stay.  The matches
from there on are made again over a window that takes 2, 4, 8, ... matches of the right
half, until one of them ends, two characters before the window does, where a match of the right half
ends: from a common end on the matches are the same.

Nulls and empties: a null or empty text has no ids and decodes to no bytes; an empty table gives no rows.  A null doc_id
stays null.  Repeated rows give equal values.  Extra columns are ignored.  A long text is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

LEAF_CHARS = 128
LEAF_BYTES = 32
#: Characters after a match that the pattern may look at.
AHEAD = 2
#: Matches (twice as many) and pairs of tokens whose encodings a worker keeps.
KEPT = 100_000
_NONE = 1 << 30
SCHEMA = "doc_id long, ids binary, decoded binary"


class TreeEncoder:
    """Encodes and decodes texts by the ranks of a file."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import base64

        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.matches = regex.compile(pattern).findall
        self.leaf_chars = leaf_chars
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # pairs of tokens that merge, by hash, and the token that they give
        keys, given = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                x, y = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if x is not None and y is not None:
                    keys.append(x << 32 | y)
                    given.append(rank)
        self.merges = K.HashIndex(max(12, (4 * len(keys)).bit_length()))
        self.merges.add(K.mix64(np.array(keys, np.uint64) + np.uint64(1)))
        self.given = np.array([*given, _NONE], np.int32)
        self.byte_ids = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.pairs: dict[tuple[int, int], bool] = {}

    def together(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that each pair gives, _NONE where none; it is the pair's rank."""
        return self.given[self.merges.find(K.mix64((x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)) + np.uint64(1)))]

    def merged_all(self, stretches: list[bytes]) -> list[tuple[int, ...]]:
        """The merges of many short stretches: each step merges the lowest pair, the leftmost of equal ones, of every stretch that has one."""
        size = np.array([len(x) for x in stretches])
        if len(size) == 0 or size.max() == 0:
            return [()] * len(stretches)
        width = int(size.max())
        column = np.arange(width, dtype=np.int32)
        inside = column < size[:, None]
        token = np.zeros(inside.shape, np.int32)
        token[inside] = self.byte_ids[np.frombuffer(b"".join(stretches), np.uint8)]
        after = np.minimum(column + 1, size[:, None]).astype(np.int32)  # the next token's place; the stretch's end where there is none
        before = np.broadcast_to(column - 1, inside.shape).copy()
        rank = np.full(inside.shape, _NONE, np.int32)
        has = column + 1 < size[:, None]
        rank[:, :-1][has[:, :-1]] = self.together(token[:, :-1][has[:, :-1]], token[:, 1:][has[:, :-1]])
        alive, row = inside, np.arange(len(size))
        while len(row):
            at = rank[row].argmin(axis=1)
            best = rank[row, at]
            row, at, best = row[best < _NONE], at[best < _NONE], best[best < _NONE]
            if len(row) == 0:
                break
            gone = after[row, at]
            token[row, at] = best
            alive[row, gone] = False
            rank[row, gone] = _NONE
            then = after[row, gone]
            after[row, at] = then
            more = then < size[row]
            r, a, t = row[more], at[more], then[more]
            before[r, t] = a
            rank[r, a] = self.together(token[r, a], token[r, t])
            rank[row[~more], at[~more]] = _NONE
            left = before[row, at]
            some = left >= 0
            r, a, b = row[some], at[some], left[some]
            rank[r, b] = self.together(token[r, b], token[r, a])
        flat, ends = token[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def merged(self, data: bytes) -> list[int]:
        """Merges by rank, the lowest first, of the leftmost first."""
        ranks, n = self.ranks, len(data)
        part = [data[k : k + 1] for k in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if not part[k] or after[k] >= n or ranks.get(part[k] + part[after[k]]) != rank:
                continue
            gone = after[k]
            part[k] += part[gone]
            part[gone] = b""
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := ranks.get(part[before[k]] + part[k])) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [ranks[x] for x in part if x]

    def stays(self, x: int, y: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        known = self.pairs.get((x, y))
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[x, y] = self.merged(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        k = 0
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            middle = left[a - 1 : a] + window + right[b : b + 1]
            if (a == 0 or self.stays(*middle[:2])) and (b == len(right) or self.stays(*middle[-2:])):
                return left[:a] + window + right[b:]
            k = max(1, 2 * k)

    def tokens(self, data: bytes) -> list[int]:
        """ids of one match."""
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        m = len(data) // 2
        return self.join_tokens(self.tokens(data[:m]), self.tokens(data[m:]))

    def learn(self, matches: set[str]) -> None:
        """Makes all of a set of matches known; when too many are kept, the older half of those that aren't asked for makes room."""
        if len(self.known) >= KEPT:
            self.older, self.known = self.known, {}
        matches = matches - self.known.keys()
        for x in matches & self.older.keys():
            self.known[x] = self.older[x]
        matches -= self.known.keys()
        short = {m: x for m in matches if len(x := m.encode()) <= LEAF_BYTES}
        by_size = sorted(short, key=lambda m: len(short[m]))
        for at in range(0, len(by_size), 4096):
            some = by_size[at : at + 4096]
            self.known.update(zip(some, self.merged_all([short[m] for m in some]), strict=True))
        for m in matches - short.keys():
            self.known[m] = tuple(self.tokens(m.encode()))

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """Matches of a text from those of its halves; changes ``left``."""
        open_, kept = [], 0
        while left and kept < AHEAD:
            kept += len(left[-1])
            open_.append(left.pop())
        begin = "".join(reversed(open_))
        take = 2
        while True:
            whole = take >= len(right)
            window = begin + "".join(right[:take])
            ends, at = {}, len(begin)
            for k, x in enumerate(right[:take]):
                at += len(x)
                ends[at] = k + 1
            made, at = [], 0
            for x in self.matches(window):
                made.append(x)
                at += len(x)
                if at in ends and (whole or at + AHEAD <= len(window)):
                    left += made
                    left += right[ends[at] :]
                    return left
            take *= 2

    def cut(self, text: str) -> list[str]:
        """The matches of a text."""
        if len(text) <= self.leaf_chars:
            return self.matches(text)
        m = len(text) // 2
        return self.join(self.cut(text[:m]), self.cut(text[m:]))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        cuts = [self.cut(x) for x in texts]
        new: set[str] = set()
        for c in cuts:
            new.update(c)
        self.learn(new)
        known, out = self.known, []
        for c in cuts:
            ids: list[int] = []
            for match in c:
                ids += known[match]
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


_made: dict[tuple, TreeEncoder] = {}


def encoder(path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeEncoder:
    key = (path, pattern, leaf_chars)
    if key not in _made:
        _made[key] = TreeEncoder(*key)
    return _made[key]


def encode_and_decode(docs: DataFrame, path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the bytes decoded from those ids; a narrow pass without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(path, pattern, leaf_chars)
        for batch in batches:
            doc_id, text = batch.column("doc_id"), batch.column("text")
            _, off = K.text_buffers(text)
            for at, end in K.windows(off):
                ids = tree.encode_all([x or "" for x in text.slice(at, end - at).to_pylist()])
                back = [tree.decode(x) for x in ids]
                ids = [np.array(x, "<u4") for x in ids]
                yield pa.RecordBatch.from_arrays([doc_id.slice(at, end - at), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
