"""Analyses of shared segments (ind1, ind2, chrid, s, e): merges, totals, overlap, coverage, peaks, relatedness."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coords
from . import intervals as I
from .matrix import numbered

PAIR = ["ind1", "ind2"]
BP_PER_CM = 15_000.0


def normalize(df: DataFrame) -> DataFrame:
    """Pairs turned so that (ind1, hap1) >= (ind2, hap2)."""
    turn = (F.col("ind1") < F.col("ind2")) | ((F.col("ind1") == F.col("ind2")) & (F.col("hap1") < F.col("hap2")))
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    rest = [c for c in df.columns if c not in ("ind1", "hap1", "ind2", "hap2")]
    return df.select(pick("ind1", "ind2").alias("ind1"), pick("hap1", "hap2").alias("hap1"), pick("ind2", "ind1").alias("ind2"), pick("hap2", "hap1").alias("hap2"), *rest)


def turned(df: DataFrame) -> DataFrame:
    """Adds ``was_turned``, whether ``normalize`` turns the pair, and turns it."""
    turn = (F.col("ind1") < F.col("ind2")) | ((F.col("ind1") == F.col("ind2")) & (F.col("hap1") < F.col("hap2")))
    return normalize(df.withColumn("was_turned", turn.cast("int")))


def of_pair(df: DataFrame, a: int, b: int) -> DataFrame:
    """The segments of one pair, in either order of its ids."""
    return df.where((F.col("ind1") == max(a, b)) & (F.col("ind2") == min(a, b)))


def with_cm(df: DataFrame, gmap: DataFrame | None = None) -> DataFrame:
    """Adds ``cm``, the length of (s, e): by a map (x1, x2, y1, y2) as the difference of its values at both ends, else at the constant rate."""
    if gmap is None:
        return df.withColumn("cm", (F.col("e") - F.col("s")) / BP_PER_CM)
    return coords.bp_to_cm(coords.bp_to_cm(df, gmap, "s", "_cs"), gmap, "e", "_ce").withColumn("cm", F.col("_ce") - F.col("_cs")).drop("_cs", "_ce")


def min_cm(df: DataFrame, least: float, gmap: DataFrame | None = None) -> DataFrame:
    return with_cm(df, gmap).where(F.col("cm") >= least)


def predicates(df: DataFrame) -> DataFrame:
    """haploid (code 3 on both sides), diploid (codes 0 and 1), merged (code 2 on a side), valid (s < e and pair in order)."""
    return df.select(
        "*", ((F.col("hap1") == 3) & (F.col("hap2") == 3)).alias("is_haploid"), (F.col("hap1").isin(0, 1, 2) & F.col("hap2").isin(0, 1, 2)).alias("is_diploid"),
        ((F.col("hap1") == 2) | (F.col("hap2") == 2)).alias("is_merged"), ((F.col("s") < F.col("e")) & ((F.col("ind1") > F.col("ind2")) | ((F.col("ind1") == F.col("ind2")) & (F.col("hap1") >= F.col("hap2"))))).alias("is_valid"),
    )


def infer_ploidy(df: DataFrame) -> DataFrame:
    """One row: Haploid, Diploid, DiploidMerged or Unknown; an empty set is Haploid."""
    p = predicates(df).agg(F.coalesce(F.every("is_haploid"), F.lit(True)).alias("h"), F.coalesce(F.every("is_diploid"), F.lit(False)).alias("d"), F.coalesce(F.some("is_merged"), F.lit(False)).alias("m"))
    return p.select(F.when(F.col("h"), "Haploid").when(F.col("d") & F.col("m"), "DiploidMerged").when(F.col("d"), "Diploid").otherwise("Unknown").alias("ploidy"))


def haploid_to_diploid(df: DataFrame, ploidy: DataFrame) -> DataFrame:
    """Haploid ids to (diploid id, haplotype) by the dimension ploidy (hap, dip, which)."""
    one = F.broadcast(ploidy.select(F.col("hap").alias("ind1"), F.col("dip").alias("d1"), F.col("which").alias("w1")))
    two = F.broadcast(ploidy.select(F.col("hap").alias("ind2"), F.col("dip").alias("d2"), F.col("which").alias("w2")))
    rest = [c for c in df.columns if c not in ("ind1", "hap1", "ind2", "hap2")]
    j = df.join(one, "ind1").join(two, "ind2")
    return normalize(j.select(F.col("d1").alias("ind1"), F.col("w1").alias("hap1"), F.col("d2").alias("ind2"), F.col("w2").alias("hap2"), *rest))


def diploid_to_haploid(df: DataFrame, ploidy: DataFrame) -> DataFrame:
    one = F.broadcast(ploidy.select(F.col("dip").alias("ind1"), F.col("which").alias("hap1"), F.col("hap").alias("h1")))
    two = F.broadcast(ploidy.select(F.col("dip").alias("ind2"), F.col("which").alias("hap2"), F.col("hap").alias("h2")))
    rest = [c for c in df.columns if c not in ("ind1", "hap1", "ind2", "hap2")]
    j = df.join(one, ["ind1", "hap1"]).join(two, ["ind2", "hap2"])
    return normalize(j.select(F.col("h1").alias("ind1"), F.lit(3).cast("long").alias("hap1"), F.col("h2").alias("ind2"), F.lit(3).cast("long").alias("hap2"), *rest))


def diploid_merge(df: DataFrame, mode: str = "corrected") -> DataFrame:
    """Islands of each pair; ``reference`` leaves the first segment of a pair as it is."""
    if mode == "corrected":
        return I.islands(df, [*PAIR, "chrid"])
    first = F.row_number().over(W.partitionBy(*PAIR).orderBy("s", "e"))
    r = df.select(*PAIR, "chrid", "s", "e").withColumn("_k", first)
    return r.where("_k = 1").drop("_k").unionByName(I.islands(r.where("_k > 1"), [*PAIR, "chrid"]))


def bridge_merge(df: DataFrame, sites: DataFrame, max_cm: float, max_discord: int, gmap: DataFrame | None = None) -> DataFrame:
    """Islands that also bridge a gap of one chromosome shorter than max_cm with at most max_discord discordant sites.

    ``sites`` (ind1, ind2, pos) lists opposite homozygotes.  Whether a gap bridges depends on the largest end before it alone.
    """
    keys = [*PAIR, "chrid"]
    order = W.partitionBy(*keys).orderBy("s", "e")
    r = df.select(*keys, "s", "e").withColumn("_end", F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)))
    gaps = r.where("s > _end").select(*keys, F.col("_end").alias("gs"), F.col("s").alias("ge")).distinct()
    bad = gaps.join(sites, PAIR).where("pos >= gs and pos < ge").groupBy(*keys, "gs", "ge").agg(F.count("*").alias("bad"))
    few = gaps.join(bad, [*keys, "gs", "ge"], "left").where(F.coalesce("bad", F.lit(0)) <= max_discord).select(*keys, F.col("gs").alias("s"), F.col("ge").alias("e"))
    bridged = with_cm(few, gmap).where(F.col("cm") < max_cm).drop("cm")
    return I.islands(r.drop("_end").unionByName(bridged), keys)


def pair_totals(df: DataFrame, gmap: DataFrame | None = None) -> DataFrame:
    """Total cM of each pair over its merged segments."""
    isl = I.islands(df, [*PAIR, "chrid"])
    if gmap is None:
        return isl.groupBy(*PAIR).agg((F.sum(F.col("e") - F.col("s")) / BP_PER_CM).alias("total_cm"))
    return with_cm(isl, gmap).groupBy(*PAIR).agg(F.sum("cm").alias("total_cm"))


def all_pairs(ids: DataFrame, col: str) -> DataFrame:
    """Pairs (ind1 > ind2) of a stated id list."""
    a, b = ids.select(F.col(col).alias("ind1")), ids.select(F.col(col).alias("ind2"))
    return a.join(b, F.col("ind1") > F.col("ind2"))


def pair_totals_both(a: DataFrame, b: DataFrame, ids: DataFrame, col: str, gmap: DataFrame | None = None) -> DataFrame:
    """Totals of both sets for all pairs of ids, zeros included."""
    p = all_pairs(ids, col)
    p = p.join(pair_totals(a, gmap).withColumnRenamed("total_cm", "a_cm"), PAIR, "left").join(pair_totals(b, gmap).withColumnRenamed("total_cm", "b_cm"), PAIR, "left")
    return p.select(*PAIR, F.coalesce("a_cm", F.lit(0.0)).alias("a_cm"), F.coalesce("b_cm", F.lit(0.0)).alias("b_cm"))


def length_spectrum(a: DataFrame, b: DataFrame, width: float = 0.05, gmap: DataFrame | None = None) -> DataFrame:
    """Sums of cM by length bin of both sets; centres are (k + 0.5) * width."""
    total = (F.sum(F.col("e") - F.col("s")) / BP_PER_CM) if gmap is None else F.sum("cm")
    one = lambda d, name: with_cm(d, gmap).groupBy(F.floor(F.col("cm") / width).alias("k")).agg(total.alias(name))
    j = one(a, "a_cm").join(one(b, "b_cm"), "k", "full")
    return j.select(((F.col("k") + 0.5) * width).alias("center"), F.coalesce("a_cm", F.lit(0.0)).alias("a_cm"), F.coalesce("b_cm", F.lit(0.0)).alias("b_cm"))


def overlap_shares(a: DataFrame, b: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each segment of a with the share of it that b's merged segments of the pair cover; ``extra`` keys (windows) must agree too."""
    keys = [*PAIR, "chrid", *extra]
    s = a.select(*keys, "s", "e").groupBy(*keys, "s", "e").agg(F.count("*").alias("n"))
    j = I.interval_join(s, I.islands(b, keys), keys)
    covered = j.groupBy(*keys, "s", "e").agg(F.sum(F.least("e", "e_b") - F.greatest("s", "s_b")).alias("covered"))
    return s.join(covered, [*keys, "s", "e"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def overlap_rates(a: DataFrame, b: DataFrame, bins: list[float], extra: tuple[str, ...] = (), gmap: DataFrame | None = None) -> DataFrame:
    """Mean and population deviation of overlap shares by length bin of a's segments, and a row of -1 for pairs genome-wide; for each value of ``extra`` keys (windows) apart.

    Equal segments count by their number, in weighted sums.
    """
    sh = with_cm(overlap_shares(a, b, extra), gmap).withColumn("share", F.col("covered") / (F.col("e") - F.col("s")))
    bin_ = F.lit(None).cast("double")
    for x in sorted(bins):
        bin_ = F.when(F.col("cm") >= x, F.lit(float(x))).otherwise(bin_)
    each = sh.withColumn("bin_start", bin_).where("bin_start is not null")
    each = each.groupBy(*extra, "bin_start").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("mean"), (F.sum(F.col("n") * F.col("share") * F.col("share")) / F.sum("n")).alias("square"))
    each = each.select(*extra, "bin_start", "mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"), "n")
    merged = overlap_shares(I.islands(a, [*PAIR, "chrid", *extra]), b, extra).groupBy(*extra, *PAIR).agg((F.sum("covered") / F.sum(F.col("e") - F.col("s"))).alias("share"))
    whole = merged.groupBy(*extra).agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("std"), F.count("*").alias("n")).select(*extra, F.lit(-1.0).alias("bin_start"), "mean", "std", "n")
    return each.unionByName(whole)


def windowed_rates(a: DataFrame, b: DataFrame, genome: DataFrame, size: int, bins: list[float]) -> DataFrame:
    """Overlap rates of both directions inside each window of ``size`` bp: a row a window and length bin of 12 columns."""
    wa, wb = window_clip(a, genome, size), window_clip(b, genome, size)
    keys = ["w_chrid", "k"]
    tag = lambda d: d.withColumn("w_chrid", F.col("chrid"))
    one = overlap_rates(tag(wa), tag(wb), bins, tuple(keys))
    two = overlap_rates(tag(wb), tag(wa), bins, tuple(keys))
    name = lambda d, x: d.select(*keys, "bin_start", F.col("mean").alias(f"{x}_mean"), F.col("std").alias(f"{x}_std"), F.col("n").alias(f"{x}_n"))
    j = name(one, "a_by_b").join(name(two, "b_by_a"), [*keys, "bin_start"], "full").withColumnRenamed("w_chrid", "chrid")
    g = F.broadcast(genome.select("chrid", "chrom", "gwstart", "size"))
    start = F.col("k") * size
    return j.join(g, "chrid").select("chrid", "chrom", "k", start.alias("start"), F.least(start + size, F.col("size")).alias("end"), "bin_start", "a_by_b_mean", "a_by_b_std", "a_by_b_n", "b_by_a_mean", "b_by_a_std", "b_by_a_n")


def window_clip(df: DataFrame, genome: DataFrame, size: int) -> DataFrame:
    """Segments cut at half-open windows of ``size`` bp of their chromosomes."""
    g = F.broadcast(genome.select("chrid", "gwstart", "size"))
    j = df.join(g, "chrid").withColumn("k", F.explode(F.sequence(F.floor((F.col("s") - F.col("gwstart")) / size), F.floor((F.col("e") - 1 - F.col("gwstart")) / size))))
    lo, hi = F.col("gwstart") + F.col("k") * size, F.col("gwstart") + F.least((F.col("k") + 1) * size, F.col("size"))
    return j.select(*PAIR, "chrid", "k", F.greatest("s", lo).alias("s"), F.least("e", hi).alias("e")).where("s < e")


def clip_to_regions(df: DataFrame, regions: DataFrame, least_cm: float = 0.0, gmap: DataFrame | None = None) -> DataFrame:
    """Segments cut to regions (chrid, s, e), those of at least ``least_cm`` left."""
    return min_cm(I.clip(I.interval_join(df, regions, ["chrid"])), least_cm, gmap).drop("cm")


def remove_regions(df: DataFrame, regions: DataFrame, genome: DataFrame, least_cm: float = 0.0, gmap: DataFrame | None = None) -> DataFrame:
    bounds = genome.select("chrid", F.col("gwstart").alias("lo"), (F.col("gwstart") + F.col("size")).alias("hi"))
    return clip_to_regions(df, I.complement(regions, bounds, ["chrid"]), least_cm, gmap)


def related_pairs(df: DataFrame, genome_cm: float, threshold: float, gmap: DataFrame | None = None) -> DataFrame:
    return pair_totals(df, gmap).where(F.col("total_cm") > threshold * genome_cm)


#: Related pairs that the greedy removal takes to the driver at most.
MOST_EDGES = 5_000_000


def related_edges(df: DataFrame, genome_cm: float, threshold: float, gmap: DataFrame | None = None, most: int = MOST_EDGES) -> list[tuple[int, int]]:
    """The related pairs, of which there may be ``most``; one more is an error."""
    pairs = related_pairs(df, genome_cm, threshold, gmap).select(*PAIR).limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError(f"more than {most} related pairs")
    return [tuple(r) for r in pairs]


def unrelated(ids: list[int], edges: list[tuple[int, int]]) -> list[int]:
    """Ids left after removing, again and again, the one with most edges (ties: the smallest); greedy on the related pairs alone.

    A heap holds each id with its edges at the time; entries that are out of date are passed over.
    """
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    heap = [(-len(ys), x) for x, ys in near.items()]
    heapq.heapify(heap)
    gone = set()
    while heap:
        n, worst = heapq.heappop(heap)
        if worst in gone or -n != len(near[worst]):
            continue
        if n == 0:
            break
        for y in near.pop(worst):
            near[y].discard(worst)
            heapq.heappush(heap, (-len(near[y]), y))
        gone.add(worst)
    return sorted(set(ids) - gone)


def low_density_windows(sites: DataFrame, genome: DataFrame, size: int, least: int, merge: bool = False) -> DataFrame:
    """Windows (chrid, s, e), genome-wide, with fewer than ``least`` distinct sites (pos, genome-wide)."""
    g = genome.select("chrid", "gwstart", "size")
    w = g.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / size)))).withColumn("s", F.col("gwstart") + F.col("k") * size)
    w = w.withColumn("e", F.least(F.col("s") + size, F.col("gwstart") + F.col("size")))
    at = sites.select("pos").distinct().join(F.broadcast(g), (F.col("pos") >= F.col("gwstart")) & (F.col("pos") < F.col("gwstart") + F.col("size")))
    n = at.groupBy("chrid", F.floor((F.col("pos") - F.col("gwstart")) / size).alias("k")).agg(F.count("*").alias("n"))
    low = w.join(n, ["chrid", "k"], "left").where(F.coalesce("n", F.lit(0)) < least).select("chrid", "s", "e")
    return I.islands(low, ["chrid"]) if merge else low


def extreme_regions(cov: DataFrame, step: int, k: float = 10.0, trim: float = 0.03) -> DataFrame:
    """Regions (chrid, s, e) of points above the trimmed mean and k deviations of their chromosome."""
    t = I.trimmed(cov, ["chrid"], "cov", trim).groupBy("chrid").agg((F.avg("cov") + k * F.stddev_pop("cov")).alias("limit"))
    return I.runs_of_points(cov.join(F.broadcast(t), "chrid"), ["chrid"], "cov > limit", step)


def peaks(cov: DataFrame, step: int, trim: float = 0.05, k: float = 2.0) -> DataFrame:
    """Regions above the median that hold a point above the trimmed mean and k deviations (cut to whole counts)."""
    t = I.trimmed(cov, ["chrid"], "cov", trim).groupBy("chrid").agg(F.expr("percentile(cov, 0.5)").alias("mid"), F.floor(F.avg("cov") + k * F.stddev_pop("cov")).alias("limit"))
    marked = cov.join(F.broadcast(t), "chrid")
    wide = I.runs_of_points(marked, ["chrid"], "cov > mid", step)
    core = I.runs_of_points(marked, ["chrid"], "cov > limit", step).select("chrid", F.col("s").alias("cs"), F.col("e").alias("ce"))
    return wide.join(core, (wide.chrid == core.chrid) & (F.col("cs") < F.col("e")) & (F.col("s") < F.col("ce")), "left_semi")


def filter_peaks(found: DataFrame, pvalues: DataFrame, level: float = 0.05) -> DataFrame:
    """Peaks that hold a point p whose p-value times n over its rank is below ``level``."""
    n = pvalues.agg(F.count("*").alias("n"))
    hits = numbered(pvalues, ["pval", "p"], "_rank").join(F.broadcast(n)).where(F.col("pval") * F.col("n") / F.col("_rank") < level).select(F.col("chrid").alias("hc"), "p")
    return found.join(hits, (F.col("chrid") == F.col("hc")) & (F.col("s") <= F.col("p")) & (F.col("p") < F.col("e")), "left_semi")
