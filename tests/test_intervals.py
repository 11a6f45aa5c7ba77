import random

from pyspark.sql import functions as F

from strandlake.operators import ibd
from strandlake.operators import intervals as I


def frame(spark, rows):
    return spark.createDataFrame([(1, s, e) for s, e in rows], "k int, s long, e long")


def pairs(df):
    return sorted((r.s, r.e) for r in df.collect())


def test_merge_and_complement(spark):
    df = frame(spark, [(1, 3), (1, 4), (3, 4), (5, 6), (5, 10), (12, 13)])
    assert pairs(I.islands(df, ["k"])) == [(1, 4), (5, 10), (12, 13)]
    bounds = spark.createDataFrame([(1, 0, 20)], "k int, lo long, hi long")
    assert pairs(I.complement(df, bounds, ["k"])) == [(0, 1), (4, 5), (10, 12), (13, 20)]
    assert pairs(I.complement(df.where("false"), bounds, ["k"])) == [(0, 20)]


def test_nested_merge_in_both_modes(spark):
    df = frame(spark, [(1, 10), (2, 3), (5, 6)])
    assert pairs(I.islands(df, ["k"])) == [(1, 10)]
    assert pairs(I.islands(df, ["k"], "reference")) == [(1, 3), (5, 6)]


def test_histogram(spark):
    values = [0.0] + [1.0] * 2 + [2.0] * 3 + [3.0] * 4 + [4.0] * 5
    got = I.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", [1, 2, 3]).orderBy("bin_start").collect()
    assert [r.n for r in got] == [2, 3, 9]


def test_coverage(spark):
    points = spark.createDataFrame([(1, p) for p in (10, 20, 30, 40)], "k int, p long")
    segs = frame(spark, [(10, 22), (10, 21), (1, 34)])
    for width in (5, 1000):
        assert [r["cov"] for r in I.sweep_coverage(points, segs, ["k"], width=width).orderBy("p").collect()] == [3, 3, 1, 0]
    assert [r["cov"] for r in I.sweep_coverage(points, segs.where("false"), ["k"]).orderBy("p").collect()] == [0, 0, 0, 0]


def test_join_against_all_pairs(spark):
    rng = random.Random(1)
    rows = lambda n: [(s, s + rng.randint(1, 300)) for s in (rng.randint(0, 2000) for _ in range(n))]
    a, b = rows(80), rows(60)
    want = sorted((s, e, x, y) for s, e in a for x, y in b if s < y and x < e)
    for width in (7, 100, 10_000):
        got = I.interval_join(frame(spark, a), frame(spark, b), ["k"], width)
        assert sorted((r.s, r.e, r.s_b, r.e_b) for r in got.collect()) == want
    assert I.interval_join(frame(spark, a).drop("k"), frame(spark, b).drop("k"), [], 50).count() == len(want)


def test_bridge_merge(spark):
    segs = spark.createDataFrame([(2, 1, 0, 0, 15_000), (2, 1, 0, 20_000, 40_000)], "ind1 int, ind2 int, chrid int, s long, e long")
    sites = spark.createDataFrame([(2, 1, 16_000), (2, 1, 17_000)], "ind1 int, ind2 int, pos long")
    assert ibd.bridge_merge(segs, sites, 1.0, 2).count() == 1
    assert ibd.bridge_merge(segs, sites, 1.0, 1).count() == 2
    assert ibd.bridge_merge(segs, sites, 0.1, 2).count() == 2


def test_low_density_windows(spark):
    genome = spark.createDataFrame([(k, f"c{k}", 10_000_000, k * 10_000_000) for k in range(3)], "chrid int, chrom string, size long, gwstart long")
    per_cm = 1_000_000
    sites = spark.range(0, 30_000_000, 10_000).where("not (id >= 4000000 and id < 6000000)").select(F.col("id").alias("pos"))
    assert [(r.s, r.e) for r in ibd.low_density_windows(sites, genome, per_cm, 10, True).collect()] == [(4_000_000, 6_000_000)]
    assert [(r.s, r.e) for r in I.islands(ibd.low_density_windows(sites, genome, per_cm, 200).withColumn("k", F.lit(1)), ["k"]).collect()] == [(0, 30_000_000)]


def test_ploidy_and_predicates(spark):
    mk = lambda rows: spark.createDataFrame(rows, "ind1 long, hap1 int, ind2 long, hap2 int, s long, e long")
    kind = lambda rows: ibd.infer_ploidy(mk(rows)).first().ploidy
    assert kind([]) == "Haploid"
    assert kind([(2, 3, 1, 3, 0, 5)]) == "Haploid"
    assert kind([(2, 0, 1, 1, 0, 5)]) == "Diploid"
    assert kind([(2, 2, 1, 2, 0, 5), (2, 0, 1, 1, 0, 5)]) == "DiploidMerged"
    assert kind([(2, 3, 1, 0, 0, 5)]) == "Unknown"
    n = ibd.normalize(mk([(1, 0, 2, 1, 0, 5), (2, 0, 2, 1, 0, 5)])).collect()
    assert sorted((r.ind1, r.hap1, r.ind2, r.hap2) for r in n) == [(2, 1, 1, 0), (2, 1, 2, 0)]


def test_unrelated():
    assert ibd.unrelated([0, 1, 2, 3, 4], [(0, 1), (0, 2), (0, 3), (3, 4)]) == [1, 2, 4]
    assert ibd.unrelated([5, 6], []) == [5, 6]


def test_peaks(spark):
    cov = spark.createDataFrame([(0, k * 10, 5 + (40 if 48 <= k <= 50 else 1 if 45 <= k <= 53 else 0)) for k in range(100)], "chrid int, p long, cov long")
    assert [(r.s, r.e) for r in ibd.peaks(cov, 10).collect()] == [(450, 540)]
