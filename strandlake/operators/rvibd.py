"""Rare variants against shared segments: records (pos, genome, allele) and segments between genomes (g1 > g2, s, e)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals as I
from . import rare


def _at(rec: DataFrame, genome: str, *more: str) -> DataFrame:
    """Records as points (s, e) of a genome column of the given name."""
    return rec.select(F.col("pos").alias("s"), (F.col("pos") + 1).alias("e"), F.col("genome").alias(genome), *more)


def position_scan(rec: DataFrame, segs: DataFrame, width: int = 100_000) -> DataFrame:
    """For positions of one allele with two carriers or more: segments over it with both, one or no carrying ends.

    Segments enter as coverage by pair, by genome and in all, so none meets the records under it: those with both ends are the
    coverage of pairs of carriers, and the coverage of carriers counts these twice and those with one end once.
    """
    keep = rec.groupBy("pos").agg(F.count("*").alias("carriers"), F.min("allele").alias("_a"), F.max("allele").alias("_b")).where("_a = _b and carriers >= 2").select("pos", "carriers")
    near = F.broadcast(I.reached(segs, width))
    bin_ = F.floor(F.col("pos") / width)
    r = rec.withColumn("_bin", bin_).join(near, "_bin", "left_semi").join(keep.withColumn("_bin", bin_).join(near, "_bin", "left_semi").select("pos"), "pos", "left_semi")
    s = segs.where("s < e").select(F.greatest("g1", "g2").alias("g1"), F.least("g1", "g2").alias("g2"), "s", "e")
    a, b = r.select("pos", F.col("genome").alias("g1")), r.select("pos", F.col("genome").alias("g2"))
    pairs = a.join(b, "pos").where("g1 > g2").select("g1", "g2", F.col("pos").alias("p"))
    within = I.sweep_coverage(pairs, s, ["g1", "g2"], width=width).groupBy("p").agg(F.sum("cov").alias("within"))
    ends = s.select(F.explode(F.array_distinct(F.array("g1", "g2"))).alias("genome"), "s", "e")
    met = I.sweep_coverage(r.select("genome", F.col("pos").alias("p")), ends, ["genome"], width=width).groupBy("p").agg(F.sum("cov").alias("met"))
    points = keep.select(F.lit(0).alias("z"), F.col("pos").alias("p"), "carriers")
    cov = I.sweep_coverage(points, segs.select(F.lit(0).alias("z"), "s", "e"), ["z"], width=width)
    out = cov.join(met, "p", "left").join(within, "p", "left").fillna(0, ["met", "within"]).withColumn("between", F.col("met") - 2 * F.col("within"))
    return out.select(F.col("p").alias("pos"), "carriers", "within", "between", (F.col("cov") - F.col("within") - F.col("between")).alias("outside"))


def pair_counters(rec: DataFrame, segs: DataFrame, width: int = 100_000) -> DataFrame:
    """Over all pairs of genomes: positions that one or both carry, with equal or different alleles, inside and outside shared segments.

    Only whether any segment of the pair covers a position matters, so segments merge first; records meet them by genome and bin.
    """
    pairs = rare.pair_table(rec)
    whole = pairs.agg(F.sum(F.col("n1") + F.col("n2") - 2 * F.col("both")).alias("one"), F.sum("eq").alias("eq"), F.sum(F.col("both") - F.col("eq")).alias("ne"))
    s = I.islands(segs, ["g1", "g2"])

    def covered(own: str, other: str) -> DataFrame:
        j = I.interval_join(_at(rec, own, F.col("allele").alias(f"a_{own}")), s, [own], width)
        return j.select(own, F.col(f"{other}_b").alias(other), F.col("s").alias("pos"), f"a_{own}")

    j = covered("g1", "g2").join(covered("g2", "g1"), ["g1", "g2", "pos"], "full")
    inside = j.agg(F.coalesce(F.sum((F.col("a_g1").isNull() | F.col("a_g2").isNull()).cast("long")), F.lit(0)).alias("ibd_one"), F.coalesce(F.sum((F.col("a_g1") == F.col("a_g2")).cast("long")), F.lit(0)).alias("ibd_eq"), F.coalesce(F.sum((F.col("a_g1") != F.col("a_g2")).cast("long")), F.lit(0)).alias("ibd_ne"))
    return whole.crossJoin(inside).select("ibd_one", "ibd_eq", "ibd_ne", (F.col("one") - F.col("ibd_one")).alias("out_one"), (F.col("eq") - F.col("ibd_eq")).alias("out_eq"), (F.col("ne") - F.col("ibd_ne")).alias("out_ne"))


def matched_rows(rec: DataFrame, segs: DataFrame, width: int = 100_000) -> DataFrame:
    """Positions where a pair carries equal alleles, with the least segment (s, e) of the pair over it, if any.

    Of each pair's segments in a bin that end at one place the one of least start counts; from the largest end down, the least
    (s, e) that has not ended before a position is the answer if it starts there or before.  Positions in bins that no segment
    reaches meet none.
    """

    def matches(r: DataFrame) -> DataFrame:
        a = r.select("pos", F.col("genome").alias("g1"), F.col("allele").alias("a1"))
        b = r.select("pos", F.col("genome").alias("g2"), F.col("allele").alias("a2"))
        return a.join(b, "pos").where("g1 > g2 and a1 = a2").select("g1", "g2", "pos", F.col("a1").alias("allele"))

    near = F.broadcast(I.reached(segs, width))
    binned = rec.withColumn("_bin", F.floor(F.col("pos") / width))
    none = F.lit(None).cast("long")
    far = matches(binned.join(near, "_bin", "left_anti")).select("g1", "g2", "pos", "allele", none.alias("s"), none.alias("e"))
    points = matches(binned.join(near, "_bin", "left_semi")).withColumn("_bin", F.floor(F.col("pos") / width)).withColumn("_at", F.col("pos"))
    bins = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))
    ends = segs.where("s < e").select("g1", "g2", "s", "e", bins.alias("_bin")).groupBy("g1", "g2", "_bin", "e").agg(F.min("s").alias("s"))
    events = points.unionByName(ends.withColumn("_at", F.col("e") - 1), allowMissingColumns=True)
    down = W.partitionBy("g1", "g2", "_bin").orderBy(F.desc("_at"))  # equal places are in: a segment's last position is its end less one
    best = F.min(F.when(F.col("s").isNotNull(), F.struct("s", "e"))).over(down)
    got = events.withColumn("_x", best).where("pos is not null").withColumn("_x", F.when(F.col("_x.s") <= F.col("pos"), F.col("_x")))
    return far.unionByName(got.select("g1", "g2", "pos", "allele", F.col("_x.s").alias("s"), F.col("_x.e").alias("e")))


def similarity(rec: DataFrame, segs: DataFrame, every: int = 64, bp_per_cm: float = 15_000.0) -> DataFrame:
    """Pairs of every k-th genome: share of the records' span in segments, cosine and Jaccard of carriage."""
    r = rec.where(F.col("genome") % every == 0)
    span = rec.agg(((F.max("pos") - F.min("pos")) / bp_per_cm).alias("span"))
    tot = segs.groupBy("g1", "g2").agg((F.sum(F.col("e") - F.col("s")) / bp_per_cm).alias("cm"))
    p = rare.pair_table(r).join(tot, ["g1", "g2"], "left").join(F.broadcast(span))
    return p.select("g1", "g2", (F.coalesce("cm", F.lit(0.0)) / F.col("span")).alias("ibd_prop"), (F.col("both") / F.sqrt(F.col("n1") * F.col("n2"))).alias("cosine"), (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("jaccard"))
