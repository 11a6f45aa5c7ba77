import math
import random
import zlib

import numpy as np

from strandlake.llm import toxicity as T


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    docs, labels = [], []
    for d in range(1500):
        w = [rng.choice(words) for _ in range(rng.randint(5, 400))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["Nasty", "vile", "awful"]))
        docs.append((d, " ".join(w), 0.5))
        labels.append((d, int(toxic)))
    docs += [(9001, None, 0.1), (9002, "", 0.1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (5, labels[5][1])], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in T.toxicity(frame, marks).collect()}
    assert len(rows) == len(docs)
    truth = dict(labels)
    held = [r for r in rows.values() if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert rows[9001].score == rows[9002].score
    weights = T.train(frame, marks.withColumnRenamed("toxic", "label"))
    assert 0 < len(weights[0]) < 5000


def test_without_labels(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = T.toxicity(frame, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r.score for r in rows] == [0.5, 0.5]
    assert T.toxicity(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_scores_do_not_depend_on_windows():
    import pyarrow as pa

    from strandlake.llm import kernels as K

    rng = np.random.default_rng(2)
    dense = np.where(rng.random(1 << 22) < 0.01, rng.normal(size=1 << 22), 0).astype(np.float32)
    texts = ["alpha beta gamma delta", "", "alpha beta gamma delta " * 3, "x"]
    whole = T.score_texts(*K.text_buffers(pa.array(texts)), dense, 0.1)
    one = [T.score_texts(*K.text_buffers(pa.array([t])), dense, 0.1)[0] for t in texts]
    assert np.allclose(whole, one)


def brute_weights(rows, epochs=3, alpha=0.3, beta=1.0, l1=4.0, l2=1.0):
    """FTRL-proximal by dictionaries, coordinate by coordinate; rows are (features, label) in order."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        cut = 0.0 if i == "bias" else l1
        if abs(zi) <= cut:
            return 0.0
        return -(zi - math.copysign(cut, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for found, label in rows:
            w = {i: weight(i) for i in [*sorted(found), "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i, wi in w.items():
                ni = n.get(i, 0.0)
                sigma = (math.sqrt(ni + g * g) - math.sqrt(ni)) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = ni + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_weights_against_plain_ftrl(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = [(d, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) + (" vile" if d % 3 == 0 else "")) for d in range(200)]
    marks = [(d, int(d % 3 == 0)) for d, _ in docs]
    frame, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, label int")
    order = [r.doc_id for r in frame.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()]
    text = dict(docs)
    rows = []
    for d in order:
        raw = np.frombuffer(text[d].encode(), np.uint8)
        rows.append((set(T.features(raw, np.array([0, len(raw)]))[1].tolist()), float(d % 3 == 0)))
    expected = brute_weights(rows)
    i, w, bias = T.train(frame, labels)
    assert abs(bias - expected.pop("bias")) < 1e-2
    got = dict(zip(i.tolist(), w.tolist(), strict=True))
    assert set(got) == set(expected)
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-2


def test_bounds_repeats_and_long_texts(spark):
    docs = [(d, "vile word" if d % 2 else "kind word") for d in range(60)]
    docs += [(1, "another text of one document"), (None, "vile"), (70, "kind " * 300_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(71)], "doc_id long, label int")
    rows = T.score(frame, T.train(frame, labels, max_rows=50, max_bytes=300)).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 for r in rows)
    few = T.train(frame, labels, max_bytes=0)
    assert len(few[0]) == 0 and few[2] == 0.0
