"""Similarity self-join on word shingles: candidates by bands, Bayesian pruning, exact verification.

Texts are lower-cased (A-Z) and cut at ASCII white space; a text's set holds the
hashes of all runs of ``WORDS`` words (all words, where there are fewer).  Two
texts are linked if the Jaccard similarity of their sets is ``THRESHOLD`` or more.

1. Each text gets 128 MinHash values of 16 bits.  Texts of equal sets are
   one *node* from here on, named by the number of one of their rows.
2. Nodes that agree in one of 32 bands of four values are candidates: a pair at the threshold is
   missed with probability (1 - 0.8**4)**32 < 1e-7.  In each band bucket every
   node is compared with the least one, as BayesLSH does: values are compared
   step by step, and a pair is dropped once the posterior probability that its
   similarity reaches the threshold is below ``TOLERANCE``.  The pairs that remain join
   nodes to candidate groups; pairs of one bucket that are still in different groups are then
   compared too, so each candidate pair is either dropped by its own
   values or ends in one group.
3. Each candidate group is cut into tiles (pairs of blocks of a bounded number of nodes).  A
   tile compares all its pairs as in 2 and verifies the rest exactly on the sets
   of the whole texts.  It returns a row a node with a count of links and the
   least node that the tile links it with, never a row a pair.
4. Links of tiles, and of nodes that stand under one doc_id, join to classes; a class
   is named by its least doc_id.

No task holds more than two blocks of nodes; a group of n nodes makes n/BLOCK
copies of its texts, which is what counting all its links takes.

Nulls and empties: a null text counts as empty; texts without words are equal to one
another and to nothing else.  A row with a null doc_id gets a null class and no
links.  Rows of one doc_id are one document in classes, whether or not their texts are equal, and are
counted each in links.  An empty table gives no rows.  A very long text is one row of a tile.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
TOLERANCE = 1e-7
BLOCK = 512
_STEP = 16

_seeds = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 32, size=(2, VALUES), dtype=np.uint64)
_A = (_seeds[0] | np.uint64(1)).astype(np.uint32)
_B = _seeds[1].astype(np.uint32)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds): the distinct shingles of document k are hashes[bounds[k]:bounds[k+1]], sorted."""
    _, _, h, doc = K.word_spans(raw, offsets, K.NOT_SPACE)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    out_doc, out = [], []
    if len(h) >= words:
        g = h[: len(h) - words + 1].copy()
        for k in range(1, words):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - words + 1 + k]
        d = doc[: len(g)]
        same = d == doc[words - 1 :]
        out.append(K.mix64(g[same]))
        out_doc.append(d[same])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        g = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = count[short] > k
            g[has] = g[has] * np.uint64(0x9E3779B97F4A7C15) + h[first[short[has]] + k]
        out.append(K.mix64(g + count[short].astype(np.uint64)))
        out_doc.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    d, g = np.concatenate(out_doc), np.concatenate(out)
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    d, g = d[keep], g[keep]
    return g, np.searchsorted(d, np.arange(n_docs + 1))


def signatures(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(MinHash values, two set hashes, sizes) of the sets g[bounds[k]:bounds[k+1]]."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    sig = np.zeros((n, VALUES), np.uint16)
    sets = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        at = bounds[:-1][some]
        low = (g >> np.uint64(32)).astype(np.uint32)
        x = np.empty_like(low)
        for k in range(VALUES):
            np.multiply(low, _A[k], out=x)
            x += _B[k]
            sig[some, k] = (np.minimum.reduceat(x, at) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)
        sets[some, 0] = np.add.reduceat(g, at)
        sets[some, 1] = np.add.reduceat(K.mix64(g ^ np.uint64(0xA0761D6478BD642F)), at)
    return sig, sets, size


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, values: int = VALUES, step: int = _STEP) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m equal ones is dropped.

    With a uniform prior the posterior of the similarity is Beta(m+1, n-m+1); its
    upper tail at the threshold is a binomial distribution function.
    """
    out = []
    for n in range(step, values + 1, step):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out.append((n, m))
                break
    return out


_LEAST = least_matches()


def likely(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which of the pairs (rows of a and b) are left after the incremental comparison."""
    left = np.flatnonzero(np.minimum(size_a, size_b) >= THRESHOLD * np.maximum(size_a, size_b) - 1e-9)
    same = np.zeros(len(left), np.int32)
    for n, m in _LEAST:
        same += (a[left, n - _STEP : n] == b[left, n - _STEP : n]).sum(axis=1, dtype=np.int32)
        keep = same >= m
        left, same = left[keep], same[keep]
        if len(left) == 0:
            break
    out = np.zeros(len(a), dtype=bool)
    out[left] = True
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = K.text_buffers(batch.column("text"))
        for i, j in K.windows(off):
            sig, sets, size = signatures(*shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * VALUES), j - i, [None, pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(sets[:, k].view(np.int64)) for k in (0, 1)), pa.array(size.astype(np.int64)), data.cast(pa.binary())], names=["doc_id", "h1", "h2", "size", "sig"])


def _sig(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, VALUES)


def _likely_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = likely(_sig(batch.column("sig").to_pylist()), _sig(batch.column("leader_sig").to_pylist()), np.asarray(batch.column("size")), np.asarray(batch.column("leader_size")))
        yield batch.select(["node", "leader"]).filter(pa.array(keep))


class Forest:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _pairs(block: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that this tile owns, row by row in chunks: those of block i with j, or of i alone."""
    left = np.flatnonzero(block == i)
    right = np.flatnonzero(block == j)
    for at in range(0, len(left), 64):
        x = np.repeat(left[at : at + 64], len(right))
        y = np.tile(right, len(left[at : at + 64]))
        if i == j:
            keep = x < y
            x, y = x[keep], y[keep]
        yield x, y


def _bucket_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one tile of a bucket: edges between groups that likely pairs of its nodes join."""
    rows = rows.sort_values("node").reset_index(drop=True)
    sig, size, group = _sig(rows["sig"]), rows["size"].to_numpy(), rows["component"].to_numpy()
    block = rows["block"].to_numpy()
    names, number = np.unique(group, return_inverse=True)
    joined = Forest(len(names))
    for x, y in _pairs(block, int(rows["i"].iloc[0]), int(rows["j"].iloc[0])):
        other = number[x] != number[y]
        x, y = x[other], y[other]
        ok = likely(sig[x], sig[y], size[x], size[y])
        for a, b in np.unique(np.stack([number[x[ok]], number[y[ok]]]), axis=1).T:
            joined.union(int(a), int(b))
    up = np.array([joined.root(k) for k in range(len(names))])
    moved = up != np.arange(len(names))
    return pd.DataFrame({"node": names[moved], "leader": names[up[moved]]})


def _verify(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one tile of a group: links (in documents) and the least linked node, for each of its nodes."""
    rows = rows.sort_values("node").reset_index(drop=True)
    raw, off = K.text_buffers(pa.array(rows["text"], pa.string()))
    found = [shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in K.windows(off)]
    sizes = np.concatenate([np.diff(b) for _, b in found])
    g = np.concatenate([x for x, _ in found])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    sig, sets, size = signatures(g, bounds)
    # a doc_id that stands in several rows: only the text of this node counts, once
    mine = (sets[:, 0].view(np.int64) == rows["h1"].to_numpy()) & (sets[:, 1].view(np.int64) == rows["h2"].to_numpy())
    mine &= ~rows["node"].where(mine, -1 - np.arange(len(rows))).duplicated().to_numpy()
    node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
    block = np.where(mine, rows["block"].to_numpy(), -1)
    ids, place, held = np.unique(g, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(held > 1)
    rank = np.full(len(ids), -1, np.int64)
    rank[shared] = np.arange(len(shared))
    owner = np.repeat(np.arange(len(rows)), size)
    col = rank[place]
    owner, col = owner[col >= 0], col[col >= 0]
    bits = np.zeros((len(rows), (len(shared) + 63) // 64), np.uint64)
    np.bitwise_or.at(bits, (owner, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
    links = np.zeros(len(rows), np.int64)
    joined = Forest(len(rows))
    for x, y in _pairs(block, int(rows["i"].iloc[0]), int(rows["j"].iloc[0])):
        ok = likely(sig[x], sig[y], size[x], size[y])
        x, y = x[ok], y[ok]
        for at in range(0, len(x), 4096):
            p, q = x[at : at + 4096], y[at : at + 4096]
            common = np.zeros(len(p), np.int64)
            for c in range(0, bits.shape[1], 64):
                common += np.bitwise_count(bits[p, c : c + 64] & bits[q, c : c + 64]).sum(axis=1, dtype=np.int64)
            good = common >= THRESHOLD * (size[p] + size[q] - common) - 1e-9
            p, q = p[good], q[good]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            for a, b in zip(p.tolist(), q.tolist(), strict=True):
                joined.union(a, b)
    del bits, g, found, raw
    if len(rows) > 200:
        K.trim()
    keep = np.flatnonzero(mine & (links > 0))
    root = [joined.root(int(k)) for k in keep]
    return pd.DataFrame({"node": node[keep], "links": links[keep], "root": node[root]})


def _tiles(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows dealt to tiles (key, i, j): a group of n rows has ceil(n / block) blocks, and each row meets every block once."""
    counted = rows.groupBy(key).agg(F.count("*").alias("members"))
    dealt = rows.join(counted, key).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("members", "blocks", "other")


def jaccard_classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, copy_of (least doc_id of an equal set), n_links (other documents linked), class_id (least doc_id that links lead to)."""
    docs = docs.select("doc_id", "text")
    signed = docs.mapInArrow(K.tidy(_signed), "doc_id long, h1 long, h2 long, size long, sig binary").where("doc_id is not null")
    signed = K.checkpoint(signed.withColumn("row", F.monotonically_increasing_id()))
    sets = signed.groupBy("h1", "h2", "size").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    sets = K.checkpoint(sets)
    full = sets.where("size > 0").select("node", "h1", "h2", "doc", "size", "copies", "sig")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring(F.col("sig"), b * (2 * ROWS) + 1, F.lit(2 * ROWS)), b))
    rows = full.select(F.explode(bands).alias("bucket"), "node")
    least = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    member = K.checkpoint(rows.join(least, "bucket"))
    stars = member.where("node != leader").select("node", "leader").distinct()
    slim = full.select("node", "size", "sig")
    other = slim.select(F.col("node").alias("leader"), F.col("size").alias("leader_size"), F.col("sig").alias("leader_sig"))
    first = K.checkpoint(stars.join(slim, "node").join(other, "leader").mapInArrow(K.tidy(_likely_edges), "node long, leader long"))
    group = components(first, "node", "leader")
    # pairs of one bucket that are in different groups
    placed = member.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("leader")
    split = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("bucket")
    open_ = _tiles(placed.join(split, "bucket"), "bucket", 2 * block).join(slim, "node")
    more = open_.groupBy("bucket", "i", "j").applyInPandas(_bucket_links, "node long, leader long").distinct()
    candidate = K.checkpoint(components(first.union(more), "node", "leader"))
    # exact verification
    tiles = _tiles(candidate, "component", block).join(full.select("node", "h1", "h2", "doc", "copies"), "node")
    tiles = tiles.join(docs.withColumnRenamed("doc_id", "doc"), "doc").drop("doc")
    linked = K.checkpoint(tiles.groupBy("component", "i", "j").applyInPandas(_verify, "node long, links long, root long"))
    # texts under one doc_id are one document of a class
    ids = signed.select("doc_id", "h1", "h2", "size")
    again = ids.groupBy("doc_id").agg(F.count_distinct("h1", "h2", "size").alias("texts")).where("texts > 1").select("doc_id")
    held = ids.join(again, "doc_id", "left_semi").join(sets.select("h1", "h2", "size", "node"), ["h1", "h2", "size"]).select("doc_id", "node").distinct()
    shared = held.join(held.groupBy("doc_id").agg(F.min("node").alias("root")), "doc_id").select("node", "root")
    together = K.checkpoint(components(linked.select("node", "root").union(shared), "node", "root"))
    named = together.join(sets.select("node", "doc"), "node")
    classes = named.join(named.groupBy("component").agg(F.min("doc").alias("class_id")), "component").select("node", "class_id")
    counted = linked.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = sets.select("h1", "h2", "size", "node", "doc", "copies").join(counted, "node", "left").join(classes, "node", "left")
    found = ids.join(nodes, ["h1", "h2", "size"]).select("doc_id", F.col("doc").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("class_id", "doc").alias("class_id"))
    return found.union(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long")))


#: The classes in DuckDB SQL, by counting common shingles of all pairs that share one; for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN len(w) || ':' || array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c / (x.n + y.n - c) = 1 AS equal FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
near AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM l WHERE l.a = doc_id AND equal), doc_id)) AS copy_of, (SELECT count(*) FROM l WHERE l.a = doc_id) AS n_links, least(doc_id, coalesce(near.b, doc_id)) AS class_id FROM documents LEFT JOIN near ON near.a = doc_id
"""
