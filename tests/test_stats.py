import math

import numpy as np

from strandlake.operators import rare, rvibd, stats


def test_tails():
    assert abs(stats.chi2_cdf([3.841458820694124], 1)[0] - 0.95) < 1e-9
    assert abs(stats.chi2_cdf([18.307038053275146], 10)[0] - 0.95) < 1e-9
    assert abs(stats.chi2_quantile(0.95, 3.7) - 9.04) < 0.1
    lam = np.array([3.0, 2, 1, 0.5, 0.2])
    s = (np.random.default_rng(0).chisquare(1, (400_000, 5)) * lam).sum(1)
    for q in (2, 7, 15):
        assert abs((s > q).mean() - stats.mixture_tail(np.array([q]), lam)[0]) < 3e-3


def test_pvalues(spark):
    got = [r.p for r in spark.createDataFrame([(0.0,), (3.841458820694124,), (None,)], "x double").select(stats.chi2_1_pvalue("x").alias("p")).collect()]
    assert got[0] == 1.0 and abs(got[1] - 0.05) < 1e-9 and got[2] is None


def test_association_is_uniform_without_effect_and_small_with_one():
    rng = np.random.default_rng(1)
    n = 400
    z = rng.binomial(2, rng.uniform(0.005, 0.05, 25), (n, 25)).astype(float)
    x = rng.normal(size=(n, 2))
    p = [stats.skat_o(x, z, (rng.random(n) < 0.5).astype(float)) for _ in range(30)]
    assert 0.3 < np.mean(p) < 0.7
    risk = 1 / (1 + np.exp(-(z[:, :10].sum(1) * 2 - 0.8)))
    assert stats.skat_o(x, z, (rng.random(n) < risk).astype(float)) < 1e-3


def test_windows_of_sites(spark):
    rows = [(s, p, 1) for s in range(40) for p in range(12) if (s * 7 + p * 3) % 5 == 0]
    g = spark.createDataFrame(rows, "sample long, pos long, dose long")
    p = spark.createDataFrame([(s, s % 2, [s / 40.0]) for s in range(40)], "sample long, y int, x array<double>")
    got = stats.skat_windows(g, p, 6, 3).orderBy("window").collect()
    assert [(r.window, r.n_sites) for r in got] == [(0, 6), (1, 6), (2, 6), (3, 3)]
    assert all(0 <= r.pval <= 1 for r in got)


def test_xirs_against_the_full_matrix(spark):
    rng = np.random.default_rng(3)
    sites = np.arange(5, 200, 7)
    freq = rng.uniform(0.1, 0.9, len(sites))
    segs = [(int(a), int(b), 0, int(s), int(s + w)) for a, b, s, w in zip(rng.integers(3, 6, 20), rng.integers(0, 3, 20), rng.integers(0, 150, 20), rng.integers(5, 60, 20), strict=True)]
    n = 30
    status, c = np.zeros((len(sites), n)), {}
    for a, b, _, s, e in segs:
        k = c.setdefault((a, b), len(c))
        status[:, k] += (sites >= s) & (sites < e)
    x = status - status.mean(0)
    x -= x.mean(1, keepdims=True)
    # a pair that two segments cover at once counts twice in coverage, so compare on pairs of disjoint segments alone
    if status.max() <= 1:
        want = (x**2).sum(1) / (freq * (1 - freq))
        got = stats.xirs_raw(spark.createDataFrame(segs, "g1 int, g2 int, chrid int, s long, e long"), spark.createDataFrame([(0, int(p), float(f)) for p, f in zip(sites, freq, strict=True)], "chrid int, pos long, freq double"), n)
        assert np.allclose([r.raw for r in got.orderBy("pos").collect()], want)
    one = {}
    for s in segs:
        one.setdefault(s[:2], s)
    status = np.array([(sites >= s) & (sites < e) for _, _, _, s, e in one.values()]).T.astype(float)
    status = np.hstack([status, np.zeros((len(sites), n - len(one)))])
    x = status - status.mean(0)
    x -= x.mean(1, keepdims=True)
    got = stats.xirs_raw(spark.createDataFrame(list(one.values()), "g1 int, g2 int, chrid int, s long, e long"), spark.createDataFrame([(0, int(p), float(f)) for p, f in zip(sites, freq, strict=True)], "chrid int, pos long, freq double"), n)
    assert np.allclose([r.raw for r in got.orderBy("pos").collect()], (x**2).sum(1) / (freq * (1 - freq)))


def test_relationship_against_dense_matrix(spark):
    rng = np.random.default_rng(4)
    m = (rng.random((30, 8)) < 0.3) * 2.0
    m = m[(m.sum(1) > 0) & (m.sum(1) < 16)]
    rec = spark.createDataFrame([(int(p), int(g), 1) for p, g in zip(*np.nonzero(m), strict=True)], "pos long, genome long, allele long")
    p = m.mean(1, keepdims=True) / 2
    z = (m - 2 * p) / np.sqrt(2 * p * (1 - p))
    want = z.T @ z / len(m)
    for r in rare.grm(rec, 8).collect():
        assert math.isclose(r.rel, want[r.g1, r.g2], abs_tol=1e-9)


def test_counters_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rec = {(int(p), int(g)): int(a) for p, g, a in zip(rng.integers(0, 40, 120), rng.integers(0, 6, 120), rng.integers(1, 3, 120), strict=True)}
    segs = [(int(max(a, b)), int(min(a, b)), int(s), int(s + w)) for a, b, s, w in zip(rng.integers(0, 6, 15), rng.integers(0, 6, 15), rng.integers(0, 35, 15), rng.integers(1, 20, 15), strict=True) if a != b]
    want = dict.fromkeys(["ibd_one", "ibd_eq", "ibd_ne", "out_one", "out_eq", "out_ne"], 0)
    for g1 in range(6):
        for g2 in range(g1):
            for p in range(40):
                a, b = rec.get((p, g1)), rec.get((p, g2))
                if a is None and b is None:
                    continue
                inside = any(x == g1 and y == g2 and s <= p < e for x, y, s, e in segs)
                want[("ibd_" if inside else "out_") + ("one" if a is None or b is None else "eq" if a == b else "ne")] += 1
    df = spark.createDataFrame([(p, g, a) for (p, g), a in rec.items()], "pos long, genome long, allele long")
    got = rvibd.pair_counters(df, spark.createDataFrame(segs, "g1 long, g2 long, s long, e long")).first()
    assert got.asDict() == want


def test_many_tails_are_those_of_each(monkeypatch):
    """Tails of many points come from few evaluations; windows are not joined into few tasks; a quantile stops when it is found."""
    from strandlake.operators import stats

    r = np.random.default_rng(1)
    for lam in (r.random(50), np.ones(30), np.geomspace(1, 1e-4, 40)):
        q = np.linspace(0.01, 3, 1500) * lam.sum()
        want = np.concatenate([stats.mixture_tail(q[k : k + 50], lam) for k in range(0, 1500, 50)])
        calls = []
        sin = np.sin
        monkeypatch.setattr(np, "sin", lambda x: calls.append(1) or sin(x))
        assert np.abs(stats.mixture_tail(q, lam) - want).max() < 1e-12
        monkeypatch.undo()
        assert len(calls) < 750
    assert (stats.mixture_tail(np.array([-300.0, 0.0]), np.ones(5)) == 1).all()
    count = []
    cdf = stats.chi2_cdf
    monkeypatch.setattr(stats, "chi2_cdf", lambda x, df: count.append(1) or cdf(x, df))
    assert abs(cdf(stats.chi2_quantile(0.3, 7.5), 7.5)[0] - 0.3) < 1e-13 and len(count) < 80
    assert stats.chi2_quantile(0.0, 2) == 0 and abs(stats.chi2_quantile(0.5, 2) - 2 * math.log(2)) < 1e-13
