"""Packing of tokenised documents into fixed windows by the sum-of-squares rule.

A document becomes its token ids and one closing id.  Whole windows are cut off
its front; the rest goes to the open window whose fill level makes the sum of
squared counts of partly filled windows smallest afterwards.  A level array
holds those counts.  When a partition's input ends, its open windows are poured
together: the emptiest give their pieces, cut where needed, to the fullest, so
at most one window of a partition stays short.

Each partition packs what it reads, without a shuffle, and numbers its windows
from ``partition << 33``; memory is that of one Arrow batch and the open
windows.  A lost task packs the same rows again to the same result.

Nulls and empties: a null or empty text is the closing id alone.  A null doc_id
stays null.  Repeated rows are packed each.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import word_tokens

WINDOW_TOKENS = 2048
END_ID = 1
SCHEMA = T.StructType().add("doc_id", "long").add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")


class SumOfSquares:
    """Open windows of one partition. ``done`` gets (pieces, fill) of closed windows; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int = WINDOW_TOKENS):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)  # open windows by fill; entry 0 stands for a new one, entry size for a full one
        self.open: list[list[list]] = [[] for _ in range(size)]
        self.done: list[list] = []

    def place(self, n: int) -> int:
        """The fill level that a piece of n < size tokens joins; 0: a new window."""
        top = self.size - n
        fits = self.level[1 : top + 1]
        live = np.flatnonzero(fits)
        rise = 2 * int(self.level[n]) + 1
        if len(live) == 0:
            return 0
        at = live + 1
        after = 2 * self.level[at + n] + 1
        after[at + n == self.size] = 0
        change = after - 2 * self.level[at] + 1
        if self.size - n >= 1:
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
            if change[k] <= rise:
                return int(at[k])
        return 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self.done.append([(doc_id, start, ids[start : start + self.size], total)])
            start += self.size
        n = total - start
        if n == 0:
            return
        h = self.place(n)
        if h:
            window = self.open[h].pop()
            self.level[h] -= 1
        else:
            window = []
        window.append((doc_id, start, ids[start:].copy(), total))
        if h + n == self.size:
            self.done.append(window)
        else:
            self.open[h + n].append(window)
            self.level[h + n] += 1

    def pour(self) -> None:
        """Empty the emptiest open windows into the fullest."""
        rest = [(h, w) for h in range(self.size - 1, 0, -1) for w in self.open[h]]
        a, b = 0, len(rest) - 1
        while a < b:
            fill, window = rest[a]
            while fill < self.size and a < b:
                left, giver = rest[b]
                doc_id, start, ids, total = giver.pop()
                take = min(self.size - fill, len(ids))
                cut = len(ids) - take
                window.append((doc_id, start + cut, ids[cut:], total))
                if cut:
                    giver.append((doc_id, start, ids[:cut], total))
                fill += take
                rest[b] = (left - take, giver)
                if not giver:
                    b -= 1
            rest[a] = (fill, window)
            if fill == self.size:
                self.done.append(window)
                a += 1
        if a == b:
            self.done.append(rest[a][1])
        self.open = [[] for _ in range(self.size)]
        self.level[:] = 0


def _rows(windows: list[list], first: int) -> pa.RecordBatch:
    """Pieces of closed windows as rows; windows are numbered from first."""
    ids_, start, length, data, tokens, seq, offset = [], [], [], [], [], [], []
    for k, window in enumerate(windows):
        at = 0
        for doc_id, s, ids, total in window:
            ids_.append(doc_id)
            start.append(s)
            length.append(len(ids))
            data.append(ids.astype("<u4").tobytes())
            tokens.append(total)
            seq.append(first + k)
            offset.append(at)
            at += len(ids)
    arrays = [pa.array(x, pa.int64()) for x in (ids_, start, length)] + [pa.array(data, pa.binary())] + [pa.array(x, pa.int64()) for x in (tokens, seq, offset)]
    return pa.RecordBatch.from_arrays(arrays, names=SCHEMA.names)


def pack(docs: DataFrame, tokenizer_path: str, size: int = WINDOW_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all rows; ids are little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        encode, packer = word_tokens.tokenizer(tokenizer_path), SumOfSquares(size)
        for batch in batches:
            raw, off = K.text_buffers(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j in K.windows(off, 2 * K.WINDOW):
                ids, o = encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = np.insert(ids, o[1:], end_id)
                o = o + np.arange(len(o))
                for k in range(j - i):
                    packer.add(doc_ids[i + k], ids[o[k] : o[k + 1]])
                if packer.done:
                    yield _rows(packer.done, number)
                    number += len(packer.done)
                    packer.done = []
        packer.pour()
        if packer.done:
            yield _rows(packer.done, number)
        encode.forget()

    return docs.select("doc_id", "text").mapInArrow(K.tidy(run), SCHEMA)


def packed_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces with the unsigned CRC of their ids in place of the ids."""
    p = pack(docs, tokenizer_path)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
