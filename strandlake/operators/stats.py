"""Selection statistic over segment coverage, p-values, and variant-set association tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import intervals as I
from .matrix import numbered

FAR = 1 << 60


def rank_below(values: DataFrame, sites: DataFrame, col: str) -> DataFrame:
    """(chrid, col, rank) of distinct values: the number of sites (chrid, pos) of the chromosome below each."""
    points = values.select("chrid", F.col(col).alias("p")).distinct()
    steps = sites.select("chrid", (F.col("pos") + 1).alias("s"), F.lit(FAR).alias("e"))
    return I.sweep_coverage(points, steps, ["chrid"]).select("chrid", F.col("p").alias(col), F.col("cov").alias("rank"))


def xirs_raw(segs: DataFrame, sites: DataFrame, n_pairs: int) -> DataFrame:
    """(chrid, pos, freq, raw) of sites (chrid, pos, freq): squared pair status after centring by pair and site, over p(1-p).

    ``segs`` are (g1, g2, chrid, s, e) of haplotype pairs, ``n_pairs`` counts all pairs.  Pair status enters through sums over
    coverage and coverage weighted by each pair's mean status, so no pairs-by-sites matrix exists.
    """
    sites = sites.where("freq > 0 and freq < 1")
    m = sites.agg(F.count("*").alias("m"))
    held = segs.join(rank_below(segs, sites, "s").withColumnRenamed("rank", "rs"), ["chrid", "s"]).join(rank_below(segs, sites, "e").withColumnRenamed("rank", "re"), ["chrid", "e"])
    c = held.groupBy("g1", "g2").agg(F.sum(F.col("re") - F.col("rs")).alias("k")).join(F.broadcast(m)).select("g1", "g2", (F.col("k") / F.col("m")).alias("c"))
    total = c.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("c1"), F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)).alias("c2"))
    points = sites.select("chrid", F.col("pos").alias("p"), "freq")
    x = I.sweep_coverage(points, segs.select("chrid", "s", "e"), ["chrid"]).withColumnRenamed("cov", "x")
    xc = I.sweep_coverage(points.select("chrid", "p"), segs.join(c, ["g1", "g2"]), ["chrid"], weight=F.col("c")).withColumnRenamed("cov", "xc")
    n = F.lit(float(n_pairs))
    j = x.join(xc, ["chrid", "p"]).join(F.broadcast(total)).withColumn("r", (F.col("x") - F.col("c1")) / n)
    raw = F.col("x") + F.col("c2") + n * F.col("r") * F.col("r") - 2 * F.col("xc") - 2 * F.col("r") * F.col("x") + 2 * F.col("r") * F.col("c1")
    return j.select("chrid", F.col("p").alias("pos"), "freq", (raw / (F.col("freq") * (1 - F.col("freq")))).alias("raw"))


def xirs_row_sums(sites: DataFrame) -> DataFrame:
    """The other published form: sums of rows after subtracting row means, which are zero by algebra."""
    return sites.select("chrid", "pos", "freq", F.lit(0.0).alias("raw"))


def xirs_norm(raw: DataFrame, bins: int = 100) -> DataFrame:
    """Adds bin (equal counts by freq, ties by place), z and xirs = z * z."""
    n = raw.agg(F.count("*").alias("_n"))
    q, more, r = F.floor(F.col("_n") / bins), F.col("_n") % bins, F.col("_r")
    wide = more * (q + 1)  # rows in the first bins, which hold one more
    bin_ = F.when(r <= wide, F.ceil(r / (q + 1))).otherwise(more + F.ceil((r - wide) / F.greatest(q, F.lit(1))))
    b = numbered(raw, ["freq", "chrid", "pos"], "_r").join(F.broadcast(n)).withColumn("bin", bin_.cast("int")).drop("_r", "_n")
    w = W.partitionBy("bin")
    z = (F.col("raw") - F.avg("raw").over(w)) / F.nullif(F.stddev_pop("raw").over(w), F.lit(0.0))
    return b.withColumn("z", z).withColumn("xirs", F.col("z") * F.col("z"))


@F.pandas_udf(T.DoubleType())
def chi2_1_pvalue(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(max(v, 0.0) / 2)))


def xirs_pvalues(norm: DataFrame) -> DataFrame:
    return norm.withColumn("pval", chi2_1_pvalue("xirs"))


# variant-set association


def gamma_lower(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, by series and continued fraction."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.zeros_like(x)
    low = (x > 0) & (x < a + 1)
    if low.any():
        v = x[low]
        term = np.full_like(v, 1 / a)
        total = term.copy()
        for k in range(1, 2000):
            term = term * v / (a + k)
            total += term
            if (term < 1e-16 * total).all():
                break
        out[low] = total * np.exp(-v + a * np.log(v) - math.lgamma(a))
    high = x >= a + 1
    if high.any():
        v = x[high]
        b = v + 1 - a
        c, d = np.full_like(v, 1e300), 1 / b
        h = d.copy()
        for k in range(1, 2000):
            an = -k * (k - a)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            step = c * d
            h *= step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - np.exp(-v + a * np.log(v) - math.lgamma(a)) * h
    return out


def chi2_cdf(x, df: float):
    return gamma_lower(df / 2, np.asarray(x, float) / 2)


def chi2_quantile(p: float, df: float) -> float:
    if p <= 0:
        return 0.0
    lo, hi = 0.0, max(10.0, df * 2)
    while chi2_cdf(hi, df)[0] < p and hi < 1e6:
        hi *= 2
    x = (lo + hi) / 2
    for _ in range(200):  # Newton's steps inside the bracket, else its middle
        over = chi2_cdf(x, df)[0] - p
        lo, hi = (x, hi) if over < 0 else (lo, x)
        slope = math.exp((df / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(df / 2)) / 2
        to = x - over / slope if slope > 0 else lo
        to = to if lo < to < hi else (lo + hi) / 2
        if to in (lo, hi) or abs(to - x) <= 1e-15 * x:
            break
        x = to
    return x


def moment_match(lam: np.ndarray) -> tuple[float, float, float]:
    """(mean, deviation, degrees) of the chi-square that matches a mixture up to kurtosis (Lee et al. 2012)."""
    c1, c2, c3, c4 = (float((lam**k).sum()) for k in (1, 2, 3, 4))
    s1, s2 = c3 / c2**1.5, c4 / c2**2
    if s1 * s1 > s2:
        a = 1 / (s1 - math.sqrt(s1 * s1 - s2))
        d = s1 * a**3 - a * a
        df = a * a - 2 * d
    else:
        df = 1 / s2
    return c1, math.sqrt(2 * c2), max(df, 1e-8)


def mixture_tail(q: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """P(sum lam_k chi2_1 > q) by numerical inversion of the characteristic function (Imhof 1961); 1 for q of 0 or less."""
    all_q = np.atleast_1d(np.asarray(q, float))
    out, q = np.ones(len(all_q)), all_q[all_q > 0]
    if not len(q):
        return out
    lam = lam[lam > lam.max() * 1e-10]
    scale = lam.sum()
    lam, q = lam / scale, q / scale
    top = 1.0
    while np.prod((1 + (lam * top) ** 2) ** 0.25) * top < 1e7 and top < 1e5:
        top *= 1.5
    edges = np.concatenate([[0], np.geomspace(min(1e-3, top / 10), top, 400)])
    nodes, weights = np.polynomial.legendre.leggauss(24)
    u = (edges[:-1, None] + edges[1:, None]) / 2 + np.diff(edges)[:, None] / 2 * nodes
    w = np.diff(edges)[:, None] / 2 * weights
    u, w = u.ravel(), w.ravel()
    theta = 0.5 * np.arctan(u[:, None] * lam).sum(1)
    rho = np.exp(0.25 * np.log1p((u[:, None] * lam) ** 2).sum(1))
    share = w / (u * rho)
    tail = lambda at: np.array([0.5 + (share * np.sin(theta - 0.5 * u * x)).sum() / math.pi for x in at])
    # with u up to top, the integral is a function of x of bounded frequency, which so many Chebyshev nodes give to rounding
    half, mid = (q.max() - q.min()) / 2, (q.max() + q.min()) / 2
    nodes = math.ceil(top / 2 * half) + 64
    if nodes < len(q) / 2 and half > 0:
        fit = np.polynomial.chebyshev.chebinterpolate(lambda z: tail(mid + half * z), nodes)
        out[all_q > 0] = np.polynomial.chebyshev.chebval((q - mid) / half, fit)
    else:
        out[all_q > 0] = tail(q)
    return np.clip(out, 0, 1)


def logistic_null(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fitted probabilities of a logistic regression with intercept, by reweighted least squares."""
    d = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(d.shape[1])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-d @ b))
        step = np.linalg.solve(d.T * (mu * (1 - mu)) @ d, d.T @ (y - mu))
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return 1 / (1 + np.exp(-d @ b))


def skat_o(x: np.ndarray, z: np.ndarray, y: np.ndarray, rhos=(0.1, 0.3, 0.5, 0.7, 0.9)) -> float:
    """SKAT-O p-value of genotypes z (0/1/2) for a binary outcome y with covariates x; weights Beta(maf; 1, 25)."""
    maf = z.mean(0) / 2
    maf = np.minimum(maf, 1 - maf)
    keep = maf > 0
    g = z[:, keep] * (25 * (1 - maf[keep]) ** 24)
    mu = logistic_null(x, y)
    v = mu * (1 - mu)
    d = np.column_stack([np.ones(len(y)), x])
    vd = d * v[:, None]
    half = np.linalg.solve(d.T @ vd, vd.T @ g)
    root = np.sqrt(v)[:, None]
    z1 = (g * root - (d * root) @ half) / math.sqrt(2)
    s = g.T @ (y - mu)
    m = g.shape[1]
    q = np.array([((1 - r) * (s @ s) + r * s.sum() ** 2) / 2 for r in rhos])
    k = z1.T @ z1
    p, fits = [], []
    for r, x_ in zip(rhos, q, strict=True):
        lam = np.linalg.eigvalsh(_mixed(k, r, m))
        lam = lam[lam > lam[lam > 0].mean() / 1e5]
        mean, sd, df = moment_match(lam)
        p.append(1 - float(chi2_cdf((x_ - mean) * math.sqrt(2 * df) / sd + df, df)[0]))
        fits.append((mean, sd, df))
    least = min(p)
    limits = np.array([(chi2_quantile(1 - least, df) - df) / math.sqrt(2 * df) * sd + mean for mean, sd, df in fits])
    mean_z = z1.mean(1)
    along = mean_z @ z1 / (mean_z @ mean_z)
    shared = np.outer(mean_z, along)
    rest = z1 - shared
    lam = np.linalg.eigvalsh(rest.T @ rest)
    lam = lam[lam > lam[lam > 0].mean() / 1e5]
    zeta = 4 * ((shared.T @ shared) * (rest.T @ rest)).sum()
    mean, var = lam.sum(), 2 * (lam**2).sum() + zeta
    r = np.array(rhos)
    tau = m * m * r * (mean_z @ mean_z) + (1 - r) * (along @ along) * (mean_z @ mean_z)
    scale = math.sqrt(2 * (lam**2).sum()) / math.sqrt(var)
    nodes, weights = np.polynomial.legendre.leggauss(24)
    top, panels = math.sqrt(40.0), 80  # over the root of a chi-square with one degree; panels for the kinks of the least limit
    edges = np.linspace(0, top, panels + 1)
    t = ((edges[:-1, None] + edges[1:, None]) / 2 + top / panels / 2 * nodes).ravel()
    weights = np.tile(weights, panels) / panels
    cut = np.min((limits[None, :] - tau[None, :] * (t**2)[:, None]) / (1 - r)[None, :], axis=1)
    inner = np.where(cut > 0, mixture_tail((cut - mean) * scale + mean, lam), 1.0)
    density = 2 / math.sqrt(2 * math.pi) * np.exp(-t * t / 2)
    return float(min(1.0, (weights * top / 2 * inner * density).sum()))


def _mixed(k: np.ndarray, rho: float, m: int) -> np.ndarray:
    root = np.linalg.cholesky(np.full((m, m), rho) + np.diag(np.full(m, 1 - rho)))
    return root.T @ k @ root


#: Samples whose phenotypes are collected and broadcast at most.
MOST_SAMPLES = 2_000_000

#: Partitions of windows: their time is in the statistic, not in the bytes by which Spark would join partitions.
WINDOW_PARTS = 256


def skat_windows(genotypes: DataFrame, phenotypes: DataFrame, size: int, step: int) -> DataFrame:
    """(window, n_sites, pval) over windows of ``size`` sites, every ``step``, of dosages (sample, pos, dose).

    ``phenotypes`` (sample, y, x array of covariates) is a row a sample, collected and broadcast; each window is a group of
    its own carriers alone.
    """
    if phenotypes.count() > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    rows = phenotypes.select("sample", "y", "x").orderBy("sample").collect()
    ids = {r.sample: k for k, r in enumerate(rows)}
    y, x = np.array([r.y for r in rows], float), np.array([r.x for r in rows], float)
    site = numbered(genotypes.select("pos").distinct(), ["pos"], "k").withColumn("k", F.col("k") - 1)
    lo = F.greatest(F.lit(0), F.ceil((F.col("k") - size + 1) / step))
    placed = site.withColumn("window", F.explode(F.sequence(lo.cast("long"), F.floor(F.col("k") / step))))
    sent = genotypes.sparkSession.sparkContext.broadcast((ids, x, y))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        ids, x, y = sent.value
        sites = {p: k for k, p in enumerate(sorted(g["pos"].unique()))}
        z = np.zeros((len(y), len(sites)))
        for s, p, d in zip(g["sample"], g["pos"], g["dose"], strict=True):
            if s in ids:
                z[ids[s], sites[p]] = d
        return pd.DataFrame({"window": [g["window"].iloc[0]], "n_sites": [len(sites)], "pval": [skat_o(x, z, y)]})

    return genotypes.join(placed.drop("k"), "pos").repartition(WINDOW_PARTS, "window").groupBy("window").applyInPandas(one, "window long, n_sites long, pval double")
