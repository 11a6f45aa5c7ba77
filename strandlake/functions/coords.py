"""Coordinates: chromosome, genome-wide bp and cM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def genome_starts(sizes: DataFrame) -> DataFrame:
    """(chrid, chrom, size) with gwstart, the sum of the sizes before; a dimension of a few hundred rows."""
    before = W.orderBy("chrid").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("gwstart", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))


def chrom_to_gw(df: DataFrame, genome: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    g = F.broadcast(genome.select(F.col("chrom").alias("_c"), F.col("gwstart").alias("_g")))
    return df.join(g, F.col(chrom) == F.col("_c")).withColumn("gwpos", F.col("_g") + F.col(pos)).drop("_c", "_g")


def gw_to_chrom(df: DataFrame, genome: DataFrame, gw: str = "gwpos") -> DataFrame:
    """Adds chrid, chrom and pos; the chromosome dimension is broadcast."""
    g = F.broadcast(genome.select("chrid", "chrom", F.col("gwstart").alias("_g"), (F.col("gwstart") + F.col("size")).alias("_end")))
    return df.join(g, (F.col(gw) >= F.col("_g")) & (F.col(gw) < F.col("_end"))).withColumn("pos", F.col(gw) - F.col("_g")).drop("_g", "_end")


def _binned(gmap: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Knots dealt to the bins of ``width`` that they reach."""
    return gmap.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))


def bp_to_cm(df: DataFrame, gmap: DataFrame, bp: str, out: str = "cm", width: int = 1_000_000) -> DataFrame:
    """Piecewise linear, and clamped to the map's ends outside; distinct positions meet the knots of their bin, then rejoin."""
    p = df.select(F.col(bp).alias("_p")).distinct().withColumn("_bin", F.floor(F.col("_p") / width))
    y = F.col("y1") + (F.col("_p") - F.col("x1")) * ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    at = p.join(_binned(gmap, "x1", "x2", width), "_bin").where((F.col("_p") >= F.col("x1")) & (F.col("_p") < F.col("x2"))).select("_p", F.greatest("y1", F.least("y2", y)).alias("_y"))
    ends = F.broadcast(gmap.agg(F.min("x1").alias("_x1"), F.min("y1").alias("_y1"), F.max("y2").alias("_y2")))  # one row
    found = df.join(at, F.col(bp) == F.col("_p"), "left").join(ends)
    outside = F.when(F.col(bp) < F.col("_x1"), F.col("_y1")).when(F.col(bp).isNotNull(), F.col("_y2"))
    return found.withColumn(out, F.coalesce("_y", outside)).drop("_p", "_y", "_x1", "_y1", "_y2")


def cm_to_bp(df: DataFrame, gmap: DataFrame, cm: str, out: str = "bp", width: float = 10.0) -> DataFrame:
    """Inverse of the map, cut to whole bp and clamped to the knots; distinct values meet the knots of their bin, then rejoin."""
    p = df.select(F.col(cm).alias("_c")).distinct().withColumn("_bin", F.floor(F.col("_c") / width))
    x = F.floor(F.col("x1") + (F.col("_c") - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
    at = p.join(_binned(gmap, "y1", "y2", width), "_bin").where((F.col("_c") >= F.col("y1")) & (F.col("_c") < F.col("y2"))).select("_c", F.greatest("x1", F.least("x2", x)).alias(out))
    return df.join(at, F.col(cm) == F.col("_c"), "left").drop("_c")


def constant_cm(bp: Column, bp_per_cm: float = 15_000.0) -> Column:
    return bp / F.lit(bp_per_cm)
