"""Token ids of whole texts through the ``tokenizers`` library, one call per distinct unit.

A text falls into *units* at places where the tokenizer always starts a new
word: at ASCII white space (which it drops) and between an ASCII letter or
digit and one of the marks in ``CUT``.  ``'`` begins contractions and ``|``
stands inside the names of special tokens, so neither is a cut.  The ids of a
text are therefore the ids of its units in turn, and only distinct units of a
worker are encoded; units are told apart by a 64-bit hash and their length.
"""

from __future__ import annotations

import re

import numpy as np

from . import kernels as K

CUT = np.zeros(256, dtype=bool)
CUT[list(b".,!?;:)]}\"<>-$%&*#@/+=~^_(")] = True
ASCII_ALNUM = K.byte_table([(48, 57), (65, 90), (97, 122)])
SPECIAL = re.compile(rb"<\|(?:start|end)oftext\|>", re.IGNORECASE)
CACHE_UNITS = 1_200_000


def unit_spans(raw: np.ndarray, offsets: np.ndarray):
    """Units of a window: (start, end, hash, document index)."""
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), empty
    mask = K.NOT_SPACE[raw]
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    begins[1:] = ~mask[:-1] | (ASCII_ALNUM[raw[:-1]] & CUT[raw[1:]])
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = True
    begins &= mask
    starts = np.flatnonzero(begins)
    stops = np.empty(n, dtype=bool)
    stops[:-1] = ~mask[1:] | begins[1:]
    stops[-1] = True
    stops[inner - 1] = True
    stops &= mask
    ends = np.flatnonzero(stops) + 1
    cs = np.empty(n + 1, dtype=np.uint64)
    cs[0] = 0
    prod = raw.astype(np.uint64)
    prod += np.uint64(1)
    prod *= K.power_table(K._P, n)
    np.cumsum(prod, out=cs[1:])
    h = (cs[ends] - cs[starts]) * K.power_table(K._PINV, n)[starts]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends, K.mix64(h + (ends - starts).astype(np.uint64)) | np.uint64(1), doc


class WordTokenizer:
    """ids of windows of texts; keeps the units it has met, up to a bound."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.index = K.HashIndex()
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count per unit) of units, by a few calls on many units."""
        ids, counts = [], []
        for a in range(0, len(units), 8192):
            part = units[a : a + 8192]
            whole = self.inner.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(whole.ids, np.int64))
            counts.append(np.bincount(np.array(whole.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, offsets of the texts in them) of a window."""
        data = raw.tobytes()
        if not SPECIAL.search(data):  # the tokenizer lower-cases all but the names of special tokens
            raw = K.LOWER[raw]
            data = raw.tobytes()
        starts, ends, h, doc = unit_spans(raw, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        place = self.index.find(h)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            if self.index.count + len(new) > CACHE_UNITS:
                self.forget()
                new, first = np.unique(h, return_index=True)
            units = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            ids, counts = self._encode(units)
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(counts) - counts])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint16)])
            self.size = np.concatenate([self.size, counts.astype(np.int32)])
            self.index.add(new)
            place = self.index.find(h)
        at, size = self.at[place], self.size[place].astype(np.int64)
        ids = self.ids[K.ranges_concat(at, size)]
        ends_at = np.concatenate([[0], np.cumsum(size)])
        return ids, ends_at[np.searchsorted(doc, np.arange(len(offsets)))]


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
