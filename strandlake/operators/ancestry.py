"""Local ancestry: runs of calls, ancestry of pairs, ancestry-specific segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import intervals as I


def runs(windows: DataFrame, end: int) -> DataFrame:
    """Runs (hap, s, e, anc) of equal calls (hap, s, anc); the last ends at ``end``."""
    order = W.partitionBy("hap").orderBy("s")
    first = windows.withColumn("_before", F.lag("anc").over(order)).where(F.col("_before").isNull() | (F.col("_before") != F.col("anc"))).drop("_before")
    return first.select("hap", "s", F.coalesce(F.lead("s").over(order), F.lit(end).cast("long")).alias("e"), "anc").where("s < e")


def pair_runs(la: DataFrame, pairs: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Intersections of the runs of both haplotypes of stated pairs (hap1, hap2)."""
    one = la.join(pairs, la.hap == pairs.hap1).select("hap1", "hap2", "s", "e", F.col("anc").alias("anc1"))
    two = la.join(pairs, la.hap == pairs.hap2).select("hap1", "hap2", "s", "e", F.col("anc").alias("anc2"))
    return I.clip(I.interval_join(one, two, ["hap1", "hap2"], width)).withColumnRenamed("anc2_b", "anc2")


def ancestry_segments(segs: DataFrame, la: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Segments (hap1, hap2, s, e) cut at the runs of both haplotypes, with anc1 and anc2."""
    one = I.clip(I.interval_join(segs, la.withColumnRenamed("hap", "hap1"), ["hap1"], width)).withColumnRenamed("anc_b", "anc1")
    return I.clip(I.interval_join(one, la.withColumnRenamed("hap", "hap2"), ["hap2"], width)).withColumnRenamed("anc_b", "anc2")


def best_calls(long: DataFrame, unknown: str, least: float = 0.9) -> DataFrame:
    """(hap, s, anc) from probabilities (hap, s, k, anc, prob): the last of the most probable, or ``unknown`` below ``least``."""
    best = long.groupBy("hap", "s").agg(F.max(F.struct("prob", "k", "anc")).alias("b"))
    return best.select("hap", "s", F.when(F.col("b.prob") < least, F.lit(unknown)).otherwise(F.col("b.anc")).alias("anc"))
