"""Array kernels shared by the text operators.

Texts reach Python as Arrow batches; the kernels look at the bytes of many
documents at once, so no Python object is made per word.  Everything works on
*windows*: runs of whole documents of about ``WINDOW`` bytes (a longer document
is a window of its own), which bounds memory by the longest single document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the life of the worker while short."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, WINDOW + (1 << 16))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * WINDOW:
            _powers[key] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def windows(offsets: np.ndarray, limit: int = WINDOW):
    """Ranges (i, j) of documents of about ``limit`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Boolean table over 256 byte values, true inside the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of bytes other than ASCII white space.
NOT_SPACE = ~byte_table([(9, 13), (32, 32)])
#: Words are runs of ASCII letters and digits and of bytes of other scripts.
ALNUM = byte_table([(48, 57), (65, 90), (97, 122), (128, 255)])


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True):
    """Words of a window: (start, end, hash, document index), in text order.

    ``offsets`` are relative to ``raw``; words never cross documents.  The hash
    is a mixed 64-bit polynomial of the (lower-cased) bytes.
    """
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), empty
    mask = inside[raw]
    edge = np.empty(n, dtype=bool)
    edge[0] = mask[0]
    np.greater(mask[1:], mask[:-1], out=edge[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    edge[inner] = mask[inner]
    starts = np.flatnonzero(edge)
    edge[:-1] = mask[:-1] & ~mask[1:]
    edge[-1] = mask[-1]
    edge[inner - 1] = mask[inner - 1]
    ends = np.flatnonzero(edge) + 1
    low = LOWER[raw] if lower else raw
    cs = np.empty(n + 1, dtype=np.uint64)
    cs[0] = 0
    prod = low.astype(np.uint64)
    prod += np.uint64(1)
    prod *= power_table(_P, n)
    np.cumsum(prod, out=cs[1:])
    h = (cs[ends] - cs[starts]) * power_table(_PINV, n)[starts]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends, mix64(h), doc


def word_hash(word: bytes) -> int:
    """The hash that :func:`word_spans` gives one (lower-case) word."""
    raw = np.frombuffer(word, np.uint8)
    return int(word_spans(raw, np.array([0, len(raw)]), np.ones(256, bool), False)[2][0])


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(0, np.int64)
    flag = np.empty(len(sorted_values), dtype=bool)
    flag[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=flag[1:])
    return np.flatnonzero(flag)


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of keys in their order, the sorted keys); where key and place fit a word together they are sorted as one, which is much faster."""
    n = len(keys)
    wide = np.uint64(max(1, n - 1).bit_length())
    if n and int(keys.max()).bit_length() + int(wide) <= 64:
        both = np.sort(keys << wide | np.arange(n, dtype=np.uint64))
        return (both & ((np.uint64(1) << wide) - np.uint64(1))).view(np.int64), both >> wide
    order = np.argsort(keys)
    return order, keys[order]


def ranges_concat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start+length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, dtype=np.int64)
    at = np.cumsum(lengths)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out, out=out)


def trim() -> None:
    """Hands memory that is free in this worker back to the system; workers live on for the stages that follow."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """An Arrow map function that trims when its task is over."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def hot_conf(spark) -> int:
    """Partitions of exchanges: what the session asks for, sized by the cluster to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_own_folder: list[str] = []


def shared_folder(sc) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine (tests)."""
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_folder:
            import tempfile

            _own_folder.append(tempfile.mkdtemp(prefix="strandlake-checkpoint-"))
        folder = _own_folder[0]
    return folder


def checkpoint(df):
    """Cut lineage through the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(sc))
    return df.checkpoint()


def written(df, name: str):
    """A frame as a new Parquet table in the shared folder, read again."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark.sparkContext).rstrip('/')}/strandlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(checkpointed) -> None:
    """Removes the files of a checkpointed frame that nothing will read again."""
    sc = checkpointed.sparkSession.sparkContext
    file = checkpointed._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class HashIndex:
    """Open-addressing table from distinct non-zero 64-bit hashes to 0, 1, 2, ... in order of arrival, probed for whole arrays at once."""

    def __init__(self, bits: int = 22):
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is not there."""
        slot = self._slot(h)
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((key != h) & (key != 0))
        last = (1 << self.bits) - 1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & last
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Number hashes that are distinct and not there yet."""
        value = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        slot, last = self._slot(h), (1 << self.bits) - 1
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = h[free]
            won = np.zeros(len(h), dtype=bool)
            won[free] = self.keys[slot[free]] == h[free]
            self.values[slot[won]] = value[won]
            h, value, slot = h[~won], value[~won], (slot[~won] + 1) & last
