"""Queries of lengths in cM by a genetic map of two rates a chromosome, on segments placed in chromosomes of 4 Mb."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ibd
from ..operators import intervals as I
from ..sources import readers as R
from ..sources import sinks as S
from ..sources.scratch import scratch
from . import catalog as C
from . import roundtrips as T
from .catalog import query, r6

KEYS = ("ind1", "ind2", "chrid", "s", "e")


def two_rates(spark) -> DataFrame:
    """100 cM on the first half of each chromosome, 50 on the second."""
    return R.map_from_lists(spark, [[(0, 0.0), (T.SIZE // 2, 100.0), (T.SIZE, 150.0)]] * 7, T.genome(spark))


def cm(x: str) -> str:
    return f"({x} // 4000000 * 150 + CASE WHEN {x} % 4000000 < 2000000 THEN {x} % 4000000 / 20000.0::DOUBLE ELSE 100 + ({x} % 4000000 - 2000000) / 40000.0::DOUBLE END)"


LENGTH = f"({cm('e')} - {cm('s')})"


def placed(sql: str) -> str:
    """SQL over the placed segments with lengths by the map."""
    return T.SEGS.rstrip() + sql.replace("FROM seg", "FROM ps").replace("(e - s) / 15000.0", LENGTH)


def sides(spark, d):
    s = T.segments(spark, d)
    return s.where("l_linestatus = 'F'"), s.where("l_linestatus = 'O'")


@query(placed(f" SELECT ind1, ind2, chrid, s, e, round({LENGTH}, 6) AS cm FROM seg WHERE round({LENGTH}, 9) >= 3"))
def map_min_cm(spark, d):
    long = ibd.with_cm(T.segments(spark, d), two_rates(spark)).where(F.round("cm", 9) >= 3)
    return long.select(*KEYS, r6("cm", "cm"))


TOTALS = C.ISLANDS.format(src="seg") + f"SELECT ind1, ind2, round(sum({LENGTH}), 6) AS total_cm FROM isl GROUP BY 1, 2"


@query(placed(TOTALS))
def map_pair_totals(spark, d):
    return ibd.pair_totals(T.segments(spark, d), two_rates(spark)).select("ind1", "ind2", r6("total_cm", "total_cm"))


@query(placed(TOTALS + f" HAVING sum({LENGTH}) > 0.15 * 1050"))
def map_related_pairs(spark, d):
    return ibd.related_pairs(T.segments(spark, d), 1050.0, 0.15, two_rates(spark)).select("ind1", "ind2", r6("total_cm", "total_cm"))


@query(placed(f" SELECT round((k + 0.5) * 0.5, 6) AS center, round(sum(CASE WHEN l_linestatus = 'F' THEN cm ELSE 0 END), 5) AS a_cm, round(sum(CASE WHEN l_linestatus = 'O' THEN cm ELSE 0 END), 5) AS b_cm FROM (SELECT *, floor(round({LENGTH}, 9) / 0.5::DOUBLE) AS k, {LENGTH} AS cm FROM seg) GROUP BY k"))
def map_length_spectrum(spark, d):
    """Sums by bins of half a cM, of lengths rounded to nine places."""
    m = two_rates(spark)
    bins = lambda x: ibd.with_cm(x, m).groupBy(F.floor(F.round("cm", 9) / 0.5).alias("k"))
    a, b = sides(spark, d)
    j = bins(a).agg(F.sum("cm").alias("a")).join(bins(b).agg(F.sum("cm").alias("b")), "k", "full")
    return j.select(F.round((F.col("k") + 0.5) * 0.5, 6).alias("center"), F.round(F.coalesce("a", F.lit(0.0)), 5).alias("a_cm"), F.round(F.coalesce("b", F.lit(0.0)), 5).alias("b_cm"))


RATES = C.OVER.format(a="F", b="O").replace("(e - s) / 15000.0 >=", f"round({LENGTH}, 9) >=").replace(">= 6 THEN 6.0", ">= 3.003 THEN 4.0").replace(">= 4 THEN 4.0", ">= 2.003 THEN 3.0").replace("ELSE 3.0 END", "ELSE 2.0 END").replace(">= 3)", ">= 1.003)")


@query(placed(RATES))
def map_overlap_rates(spark, d):
    """Bins begin between the lengths that occur, so that rounding moves no segment."""
    a, b = sides(spark, d)
    r = ibd.overlap_rates(a, b, [1.003, 2.003, 3.003], gmap=two_rates(spark))
    name = F.when(F.col("bin_start") < 0, F.lit(-1.0)).when(F.col("bin_start") < 2, F.lit(2.0)).when(F.col("bin_start") < 3, F.lit(3.0)).otherwise(F.lit(4.0))
    return r.select(name.alias("bin_start"), r6("mean", "mean"), r6("std", "std"), "n")


REGIONS = C.CHROM[: C.CHROM.index("st AS (")].rstrip().rstrip(",")


@query(placed(REGIONS + f" SELECT ind1, ind2, chrid, s, e FROM (SELECT ind1, ind2, seg.chrid, greatest(seg.s, reg.s) AS s, least(seg.e, reg.e) AS e FROM seg JOIN reg ON seg.chrid = reg.chrid AND seg.s < reg.e AND reg.s < seg.e) WHERE round({LENGTH}, 9) >= 1.003".replace("seg.", "ps.")))
def map_clip_regions(spark, d):
    s = T.segments(spark, d)
    regions = I.islands(s.join(F.broadcast(s.agg(F.max(F.col("e") - F.col("s")).alias("top"))), F.col("e") - F.col("s") == F.col("top"), "left_semi"), ["chrid"])
    return ibd.clip_to_regions(s.select(*KEYS), regions, 1.003, two_rates(spark)).select(*KEYS)


@query(T.SEGS.rstrip() + " SELECT * FROM (VALUES ('x')) t(name)")
def map_of_a_genome_file(spark, d):
    """A genome of two rates written as text and read again gives the lengths of the map."""
    path = scratch(spark, "two-rates") + "/genome.toml"
    S.write_genome_text(T.genome(spark), two_rates(spark), path)
    _, m = R.read_genome_text(spark, path)
    s = T.segments(spark, d).select("s", "e").distinct()
    worst = ibd.with_cm(s, m).withColumnRenamed("cm", "a").join(ibd.with_cm(s, two_rates(spark)), ["s", "e"]).agg(F.max(F.abs(F.col("a") - F.col("cm"))).alias("x"))
    return worst.select(F.when(F.col("x") < 0.01, "x").otherwise("differs").alias("name"))
