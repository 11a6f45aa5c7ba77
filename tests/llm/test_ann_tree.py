import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import ann_tree as A


def brute(vectors, q, k):
    near = sorted((float(np.sqrt(((np.array(v, float) - np.array(vectors[q], float)) ** 2).sum())), i) for i, v in vectors.items() if i != q)
    return near[:k]


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in A.search(frame, F.col("vec_id") % 10 == 0, **more).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 12)) * 3
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 12))).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    vectors = {k: v for k, v, _ in rows}
    got = run(spark, rows, sample_rows=800, block=100)
    found = 0
    for q in range(0, 3000, 10):
        want = brute(vectors, q, 10)
        assert [r for r, *_ in got[q]] == list(range(1, 11))
        for _, i, s in got[q]:
            assert abs(s - float(np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum()))) < 1e-9
        found += len({i for _, i in want} & {i for _, i, _ in got[q]})
    assert found >= 0.9 * 3000


def test_ties_and_odd_rows(spark):
    same = [1.0, 2.0]
    rows = [(k, same, 0) for k in range(40)] + [(40, None, 0), (50, [0.0, 0.0], 0), (60, [float("nan"), 1.0], 0), (70, [1.0, None], 0), (80, [float("inf"), 1.0], 0), (90, [1.0, 2.0, 3.0], 0), (None, same, 0), (41, [1.0, 3.0], 0), (0, same, 0)]
    got = run(spark, rows, block=7)
    assert set(got) == {0, 10, 20, 30}
    assert [i for _, i, _ in got[0]] == list(range(1, 11))
    assert all(s == 0 for _, _, s in got[0])
    assert run(spark, []) == {}
    few = run(spark, [(0, [1.0, 1.0], 0), (1, [2.0, 2.0], 0), (2, [5.0, 5.0], 0)])
    assert [i for _, i, _ in few[0]] == [1, 2]


def test_recall_on_embeddings(spark):
    """Neighbours of the table's own queries against all rows by brute force."""
    from strandlake.llm.queries import op5_ann_tree

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding is not null").collect()
    vectors = {r.vec_id: r.embedding for r in table if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    got = {}
    for r in op5_ann_tree(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == {q for q in vectors if q % 100 == 0}
    hits = [len({i for _, i in brute(vectors, q, 10)} & set(near)) for q, near in got.items()]
    assert sum(hits) >= 0.9 * 10 * len(got)


def test_a_query_id_of_several_vectors(spark):
    """The least vector is the query, whatever the order of the rows; all its rows are candidates of others."""
    rows = [(0, [5.0, 5.0], 0), (0, [1.0, 1.0], 0), (1, [1.0, 1.1], 0), (2, [5.0, 5.1], 0), (10, [5.0, 5.2], 0)]
    for order in (rows, rows[::-1]):
        got = run(spark, order)
        assert [i for _, i, _ in got[0]] == [1, 2, 10]
        assert sorted(i for _, i, _ in got[10]) == [0, 0, 1, 2]
