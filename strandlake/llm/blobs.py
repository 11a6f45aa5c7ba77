"""Compact binary rows for exchanges: arrays and record batches in compressed blobs.

An exchange of hundreds of millions of tiny records would write several times
the input to disk; blobs of sorted, delta-coded, byte-planed columns write a few
bytes a record and pass Spark as one row for each task and target.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


def _squeeze(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.compress(data, codec=_CODEC, asbytes=True)


def _expand(blob: bytes) -> bytes:
    (n,) = struct.unpack_from("<Q", blob)
    return pa.decompress(memoryview(blob)[8:], decompressed_size=n, codec=_CODEC, asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any numeric dtype, their bytes split into planes."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        name = a.dtype.str.encode()
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros(0, np.uint8)
        parts += [struct.pack("<BQ", len(name), len(a)), name, planes.tobytes()]
    return _squeeze(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = _expand(blob), 4, []
    (count,) = struct.unpack_from("<I", data)
    for _ in range(count):
        size, n = struct.unpack_from("<BQ", data, at)
        at += 9
        dtype = np.dtype(data[at : at + size].decode())
        at += size
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
        at += n * dtype.itemsize
    return out


def delta(a: np.ndarray) -> np.ndarray:
    """First value, then differences (modulo the dtype)."""
    out = a.copy()
    if len(a):
        out[1:] -= a[:-1]
    return out


def undelta(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)


def pack_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()
