import random

import numpy as np

from strandlake.llm import suffix_dedup as S
from strandlake.llm.suffix_dedup import remove_repeats


def brute(docs):
    """{doc_id: (kept bytes, removed, spans)} by a dictionary of all 50-byte strings."""
    first = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            g = t[i : i + 50]
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, bytes(c for c, g in zip(t, gone, strict=True) if not g), sum(gone), spans))
    return sorted(out)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "béta", "gamma", "of", "the", "x", "zeta", "öl"]) for _ in range(n))


def check(spark, docs, **more):
    rows = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string, lang string, kept string"), **more).collect()
    got = sorted((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in rows)
    assert got == brute([(d, (t or "").encode()) for d, t, *_ in docs])
    assert all(r.n_bytes == len(r.kept) + r.n_removed for r in rows)


def test_against_brute_force(spark):
    rng = random.Random(5)
    shared = [words(rng, 30) for _ in range(4)]
    docs = []
    for d in range(80):
        text = words(rng, rng.randint(0, 60))
        if d % 3 == 0:
            text += rng.choice(shared)[rng.randint(0, 9) :] + words(rng, 5)
        docs.append((d * 7 % 80, text, "en", "?"))
    docs += [(90 + k, "a" * (45 + k), "en", None) for k in range(12)]  # runs of one byte
    docs += [(300 + k, "<" * 30 + words(rng, 3) + shared[0][:60], "en", None) for k in range(20)]  # many strings of one trigger
    docs += [(200, shared[0], None, None), (201, shared[0], None, None), (201, shared[0], None, None)]  # a repeated row
    check(spark, docs)
    check(spark, docs, heavy=2, batch_bytes=2000, part_bytes=5000)  # split triggers, many batches and parts


def test_corpus_order_against_sorted_suffixes():
    rng = random.Random(8)
    base = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(50, 300))) for _ in range(6)] + [b"\0" * 90, b"a" * 120, words(rng, 40).encode()]
    strings = [(b := rng.choice(base))[(k := rng.randint(0, 9)) : max(k + 50, rng.randint(0, len(b)))] for _ in range(80)]
    strings = [x for x in strings if len(x) >= S.LENGTH]
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(x) for x in strings])
    begin = np.cumsum(size) - size
    places = np.concatenate([np.arange(b, b + n - S.LENGTH + 1) for b, n in zip(begin, size, strict=True)])
    order = S.corpus_order(data, size, places)
    grams = [bytes(data[p : p + S.LENGTH]) for p in places[order]]
    assert sorted(order.tolist()) == list(range(len(places)))
    assert grams == sorted(grams)


def test_texts_are_exchanged_once(spark):
    done = remove_repeats(spark.createDataFrame([(1, "a" * 60), (2, "a" * 60)], "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in done.collect()} == {1: 0, 2: 60}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_edges(spark):
    check(spark, [(1, None, None, None), (2, "", None, None), (3, "x" * 49, None, None), (4, "x" * 50, None, None), (5, "x" * 50, None, None)])
    rows = remove_repeats(spark.createDataFrame([(None, "y" * 60), (1, "y" * 60), (2, "y" * 60)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {None: 0, 1: 0, 2: 60}
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text(spark):
    rng = random.Random(2)
    long_ = words(rng, 60_000)
    rows = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(1, long_), (2, "new " + long_)], "doc_id long, text string")).collect()}
    assert rows[1].n_removed == 0
    assert rows[2].n_removed >= len(long_.encode())
