import random

import numpy as np

from strandlake.llm import jaccard_join as J


def sets_of(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(docs):
    s = {d: sets_of(t) for d, t in docs}
    up = {d: d for d in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(s, 0)
    for a in s:
        for b in s:
            if a < b:
                union = len(s[a] | s[b])
                if union == 0 or len(s[a] & s[b]) >= 0.8 * union:
                    links[a] += 1
                    links[b] += 1
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    copy = {}
    for d in sorted(s):
        copy.setdefault(s[d], d)
    return sorted((d, copy[s[d]], links[d], root(d)) for d in s)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 150]))] for _ in range(12)]
    docs = []
    for d in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.1:
            w = [rng.choice(vocabulary) for _ in range(30)]
        docs.append((d * 13 % n, " ".join(w).upper() if d % 5 == 0 else "\n".join(w)))
    return docs


def run(spark, docs, **more):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, node string, size int")
    return sorted((r.doc_id, r.copy_of, r.n_links, r.class_id) for r in J.jaccard_classes(frame, **more).collect())


def test_against_brute_force(spark):
    docs = corpus(3, 211) + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "one")]
    assert run(spark, docs) == brute(docs)


def test_tiles(spark):
    """Groups of many blocks give the same classes and links."""
    docs = corpus(4, 127)
    assert run(spark, docs, block=7) == brute(docs)


def test_one_doc_id_with_several_texts(spark):
    """Rows of one doc_id are one document: their texts' links all count, and their classes are one."""
    rng = random.Random(9)
    a, b, c = ([rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(80)] for _ in range(3))

    def near(w, k):
        return " ".join([*w[:k], "other", *w[k + 1 :]])

    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 3)), (5, near(a, 70)), (3, near(b, 5)), (4, near(b, 60)), (6, " ".join(c)), (7, " ".join(c)), (7, " ".join(c)), (8, None)]
    expected = [(1, 1, 2, 1), (1, 1, 2, 1), (2, 2, 1, 1), (5, 5, 1, 1), (3, 3, 1, 1), (4, 4, 1, 1), (6, 6, 2, 6), (7, 6, 2, 6), (7, 6, 2, 6), (8, 8, 0, 8)]
    for shift in range(3):
        assert run(spark, docs[shift:] + docs[:shift]) == sorted(expected)


def test_very_long_text(spark):
    rng = random.Random(10)
    w = [str(rng.randint(0, 9999)) for _ in range(60_000)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:59_000])), (3, " ".join(w[30_000:]))]
    assert run(spark, docs) == [(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 0, 3)]


def test_null_ids_and_empty_table(spark):
    rows = J.jaccard_classes(spark.createDataFrame([(None, "a b"), (1, "a b"), (2, "a b")], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in rows), key=str) == [(1, 1, 1), (2, 1, 1), (None, 0, None)]
    assert J.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, size=(20_000, J.VALUES)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 16, size=a.shape)).astype(np.uint16)
    size = np.full(len(a), 100)
    assert J.likely(a, b, size, size).all()
    assert not J.likely(a, a[::-1], size, size).any()
