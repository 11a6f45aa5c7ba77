import random

import numpy as np
import pyarrow as pa

from strandlake.llm import blobs, graph
from strandlake.llm import kernels as K


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in up if x not in loops}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    """What fits one task runs no rounds of exchanges, whatever the number of partitions; rounds give the same components."""
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(400, 400 + k) for k in range(1, 40)] + [(rng.randint(500, 600), rng.randint(500, 600)) for _ in range(60)]
    frame = spark.createDataFrame(edges, "a long, b long")
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()

    def tasks(name, alone):
        sc.setJobGroup(name, name)
        found = {r.node: r.component for r in graph.components(frame, "a", "b", alone=alone).collect()}
        sc._jsc.clearJobGroup()
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
        return found, sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        few, n_few = tasks("few", graph.ALONE)
        part, n_part = tasks("part", 115)  # some rounds, then one task
        rounds, n_rounds = tasks("rounds", -1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert few == part == rounds
    assert all(few[k] == 0 for k in range(41)) and all(few[400 + k] == 400 for k in range(40))
    assert n_few < 6 * 9 < n_rounds and n_few <= n_part


def test_words_do_not_depend_on_windows():
    texts = ["Alpha beta", "", None, "beta  ALPHA\tbeta", "é1 é1", "x" * 5000 + " y"]
    raw, off = K.text_buffers(pa.array(texts))
    starts, ends, h, doc = K.word_spans(raw, off, K.NOT_SPACE)
    words = [raw[a:b].tobytes().lower() for a, b in zip(starts, ends, strict=True)]
    assert words == [b"alpha", b"beta", b"beta", b"alpha", b"beta", "é1".encode(), "é1".encode(), b"x" * 5000, b"y"]
    assert doc.tolist() == [0, 0, 3, 3, 3, 4, 4, 5, 5]
    assert [int(x) for x in h] == [K.word_hash(w) for w in words]
    assert len(set(h.tolist())) == len(set(words))


def test_blobs_and_index():
    rng = np.random.default_rng(1)
    arrays = [np.sort(rng.integers(0, 1 << 60, 1000)).astype(np.uint64), rng.normal(size=7), np.zeros(0, np.int32), np.arange(5, dtype=np.uint16)]
    back = blobs.unpack(blobs.pack(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True))
    assert (blobs.undelta(blobs.delta(arrays[0])) == arrays[0]).all()
    batch = pa.RecordBatch.from_pydict({"a": [1, None], "b": ["x", "é"]})
    assert blobs.unpack_rows(blobs.pack_rows(batch)).to_pylist() == batch.to_pylist()
    index = K.HashIndex(8)
    h = np.unique(rng.integers(1, 1 << 63, 100).astype(np.uint64) | np.uint64(1))
    index.add(h[:60])
    index.add(h[60:])
    assert index.find(h).tolist() == list(range(len(h)))
    assert (index.find(h + np.uint64(2)) == -1).sum() >= len(h) - 1
    assert K.ranges_concat(np.array([5, 1, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
