import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from strandlake.llm import hpyp as H


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    follow = {w: rng.sample(words, 5) for w in words}
    docs = []
    for d in range(n):
        w = [rng.choice(words)]
        for _ in range(rng.randint(0, 80)):
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.8 else rng.choice(words))
        docs.append((d, " ".join(w).title() + rng.choice(["", "\n", " Zz%d" % d])))
    return docs


def tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w] + [None]


def test_base_scores_and_gain(spark):
    docs = corpus(300) + [(1000, None), (1001, ""), (1002, "never seen words")]
    rows = H.score_texts(spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double").repartition(5)).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    train = [d for d in text if zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for d in train for w in tokens(text[d]))
    n, v = sum(c.values()), len(c)
    gain = 0
    for r in rows:
        t = tokens(text[r.doc_id])
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - base) < 1e-6
        assert r.score < 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0.2 * sum(r.n_tokens for r in rows if r.held_out)


def test_parts_and_repeated_rows(spark):
    """Rows count each; an empty table and one without training rows have results."""
    docs = [(None, "a b"), (5, "a b"), (5, "a b"), (7, "a")]
    rows = H.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["5", "5", "7", "None"]
    assert H.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    (row,) = H.score_texts(spark.createDataFrame([(held, "x y")], "doc_id long, text string")).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score)


def brute(docs):
    """{doc_id: score} by dictionaries: the same draws by key, one dish at a time, and plain sums; also each state's root and restaurants."""
    one = lambda x: np.array([x], np.uint64)
    hashed = {}

    def hash_of(w):
        if w not in hashed:
            hashed[w] = H.END if w is None else np.uint64(H.K.word_hash(w.encode()))
        return hashed[w]

    def context_of(w):
        return H.K.mix64(one(H.BEGIN if w == "" else hash_of(w)) * np.uint64(0x9FB21C651E98DF25))[0]

    c, customers_of, t = Counter(), Counter(), {}
    for d, x in docs:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            w = tokens(x)
            for u, v in zip(["", *w[:-1]], w, strict=True):
                c[u, v] += 1
                customers_of[u] += 1
    t = dict.fromkeys(c, 1)
    words = sorted({w for _, w in c}, key=str)
    v = len(words)
    root_tables = dict.fromkeys(words, 1)
    states = []
    for sweep in range(1, H.BURN_IN + H.SAMPLES + 1):
        root = Counter()
        for (_, w), n in t.items():
            root[w] += n
        weight = {w: max(1.0, round(H.gamma(one(hash_of(w)), np.array([root[w] - H.ROOT_DISCOUNT * root_tables[w]]), sweep - 1)[0] * (1 << 20))) for w in words}
        all_tables = sum(root_tables.values())
        new = H.gamma(one(H._HOT_KEY ^ np.uint64(1)), np.array([H.ROOT_STRENGTH + H.ROOT_DISCOUNT * all_tables]), sweep - 1)[0] * (1 << 20)
        g = {w: (weight[w] + new / (v + 1)) / (sum(weight.values()) + new) for w in words}
        tables_of = Counter()
        for (u, _), n in t.items():
            tables_of[u] += n
        x = {u: H.gamma(one(context_of(u)), np.array([H.STRENGTH / H.DISCOUNT + tables_of[u]]), sweep)[0] for u in tables_of}
        t = {(u, w): int(H.draw_tables(np.array([n]), np.array([H.DISCOUNT * x[u] * g[w]]), H.DISCOUNT, H._pair_keys(one(hash_of(w)), one(context_of(u))), sweep)[0]) for (u, w), n in c.items()}
        root, tables_of = Counter(), Counter()
        for (u, w), n in t.items():
            root[w] += n
            tables_of[u] += n
        x0 = H.gamma(one(H._HOT_KEY), np.array([H.ROOT_STRENGTH / H.ROOT_DISCOUNT + all_tables]), sweep)[0]
        root_tables = {w: int(H.draw_tables(np.array([root[w]]), np.array([H.ROOT_DISCOUNT * x0 / (v + 1)]), H.ROOT_DISCOUNT, one(hash_of(w)), sweep)[0]) for w in words}
        if sweep > H.BURN_IN:
            states.append((t, tables_of, root, root_tables))

    def probability(u, w, state):
        t, tables_of, root, root_tables = state
        p = (root[w] - H.ROOT_DISCOUNT * root_tables.get(w, 0) + (H.ROOT_STRENGTH + H.ROOT_DISCOUNT * sum(root_tables.values())) / (v + 1)) / (H.ROOT_STRENGTH + sum(root.values()))
        return (c[u, w] - H.DISCOUNT * t.get((u, w), 0) + (H.STRENGTH + H.DISCOUNT * tables_of[u]) * p) / (H.STRENGTH + customers_of[u])

    scores = []
    for d, x in docs:
        w = tokens(x)
        scores.append((d, sum(math.log10(sum(probability(u, z, s) for s in states) / len(states)) for u, z in zip(["", *w[:-1]], w, strict=True))))
    return scores, words, customers_of, states, probability


def test_scores_against_brute_force_for_any_number_of_parts(spark):
    """The distributed sampler gives the scores of dictionaries, whatever the number of parts and tasks; few contexts are hot, or all."""
    docs = corpus(90) + [(1000, None), (1001, ""), (1002, "never seen words"), (1003, "w1 w2"), (1003, "w1 w2")]
    expected = sorted(brute(docs)[0])
    for parts, tasks in ((2, 3), (4, 1), (9, 6)):
        rows = H.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(tasks), parts).collect()
        got = sorted((r.doc_id, r.score) for r in rows)
        assert [d for d, _ in got] == [d for d, _ in expected]
        assert max(abs(x - y) for (_, x), (_, y) in zip(got, expected, strict=True)) < 1e-6


def test_probabilities_sum_to_one():
    """In each state, over all known words and the class of the others, in every context."""
    _, words, customers_of, states, probability = brute(corpus(30))
    for state in states:
        for u in [*customers_of, "not a context"]:
            assert abs(sum(probability(u, w, state) for w in [*words, "not a word"]) - 1) < 1e-9


def log_stirling(d, n, most):
    """log S(n, t) for t up to most, by the recursion."""
    row = np.full(most + 1, -np.inf)
    row[0] = 0.0
    t = np.arange(most + 1)
    for c in range(n):
        new = np.full(most + 1, -np.inf)
        with np.errstate(divide="ignore"):
            new[1:] = np.logaddexp(row[:-1], np.log(np.maximum(c - t[1:] * d, 0)) + row[1:])
        row = new
    return row[1:]


def test_table_counts_follow_the_seating_distribution():
    """Draws by exact numbers, by their sum and by the normal limit against the exact distribution."""
    n = 40_000
    keys = H.K.mix64(np.arange(n, dtype=np.uint64))
    for d in (H.DISCOUNT, H.ROOT_DISCOUNT):
        for c, z in ((2, 0.1), (6, 0.7), (200, 3.0), (257, 0.05), (300, 2.0), (1500, 9.0), (700, 60.0), (4000, 100.0)):
            t = H.draw_tables(np.full(n, c), np.full(n, z), d, keys, 3)
            most = min(c, 400)
            p = log_stirling(d, c, most) + np.log(z) * np.arange(1, most + 1)
            p = np.exp(p - p.max())
            p /= p.sum()
            k = np.arange(1, most + 1)
            mean, deviation = (p * k).sum(), math.sqrt((p * k * k).sum() - (p * k).sum() ** 2)
            assert abs(t.mean() - mean) < 0.02 * mean + 5 * deviation / math.sqrt(n), (c, z, d, t.mean(), mean)
            assert abs(t.std() - deviation) < 0.05 * deviation + 0.02, (c, z, d, t.std(), deviation)
            assert np.abs(np.cumsum(np.bincount(t, minlength=most + 1)[1 : most + 1] / n) - np.cumsum(p)).max() < 0.06


def test_gamma_draws():
    keys = H.K.mix64(np.arange(50_000, dtype=np.uint64))
    for shape in (0.2, 0.4, 1.0, 3.5, 400.0):
        x = H.gamma(keys, np.full(len(keys), shape), 2)
        assert abs(x.mean() - shape) < 5 * math.sqrt(shape / len(keys))
        assert abs(x.var() - shape) < 0.06 * shape


def test_contexts_are_told_apart(spark):
    """Many previous words, one always before x and one always before y; every context has its own restaurant."""
    train = [d for d in range(400) if zlib.crc32(str(d).encode()) % 5 != 1]
    held = [d for d in range(400, 500) if zlib.crc32(str(d).encode()) % 5 == 1][:2]
    docs = [(d, (" ".join(f"p{d}_{k}" for k in range(200))) + (" a x" if d % 2 else " b y")) for d in train] + [(held[0], "a x"), (held[1], "a y")]
    score = {r.doc_id: r.score for r in H.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert score[held[0]] > score[held[1]] + 0.3


def test_very_long_text(spark):
    rng = random.Random(12)
    long_ = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(200_000))
    docs = [(0, long_), (2, "w1 w2"), (3, long_)]
    rows = {r.doc_id: r for r in H.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[0].n_tokens == 200_001
    assert rows[0].score == rows[3].score > rows[0].base_score
