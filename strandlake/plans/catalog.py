"""Named queries over the domain views, each with DuckDB SQL of the same result where SQL expresses it.

``query(sql)`` registers a function of (spark, sf_dir); floats are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords as C
from ..operators import ancestry as A
from ..operators import ibd, matrix, rare, rvibd, stats
from ..operators import intervals as I
from ..sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

POINT_STEP = 10_000
GW = 1000  # bp of a record's position


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (X.SQL.replace("WITH", "WITH RECURSIVE", 1) if "gone AS" in sql else X.SQL) + sql
        return f

    return add


def r6(col, name: str):
    return F.round(col, 6).alias(name)


def sides(spark, d):
    s = X.seg(spark, d)
    return s.where("l_linestatus = 'F'"), s.where("l_linestatus = 'O'")


def sites(spark, d) -> DataFrame:
    """(chrid, pos, freq) of record positions, genome-wide."""
    f = rare.allele_freq(X.rec(spark, d), 50).where("freq > 0 and freq < 1")
    pos = F.col("pos") * GW
    return f.select(F.floor(pos / X.SIZE).cast("int").alias("chrid"), pos.alias("pos"), "freq")


def hap_segs(spark, d) -> DataFrame:
    """Segments between genomes g1 > g2."""
    return X.seg(spark, d).select((F.col("ind1") + 0).alias("g1"), F.col("ind2").alias("g2"), "chrid", "s", "e")


def rec_gw(spark, d) -> DataFrame:
    return X.rec(spark, d).select((F.col("pos") * GW).alias("pos"), "genome", "allele")


#: The allele that most carriers of a site have, and now and then the other; so that sites of one allele and of two occur.
SITE_ALLELE = "1 + (pos + CASE WHEN (pos * 31 + genome * 17) % 61 = 0 THEN 1 ELSE 0 END) % 2"


def rec_by_site(spark, d) -> DataFrame:
    return X.rec(spark, d).withColumn("allele", F.expr(SITE_ALLELE))


# coordinates


@query("SELECT s AS gwpos, chrid, 'c' || chrid AS chrom, s - chrid * 3000000 AS pos FROM (SELECT DISTINCT s, CAST(s // 3000000 AS INTEGER) AS chrid FROM seg)")
def gw_to_chrom(spark, d):
    return C.gw_to_chrom(X.seg(spark, d).select(F.col("s").alias("gwpos")).distinct(), X.genome(spark)).select("gwpos", "chrid", "chrom", "pos")


@query("SELECT chrom, pos, gwstart + pos AS gwpos FROM (SELECT DISTINCT 'c' || l_linenumber % 7 AS chrom, l_partkey * 100 AS pos FROM lineitem) JOIN genome USING (chrom)")
def chrom_to_gw(spark, d):
    li = X.table(spark, d, "lineitem")
    p = li.select(F.concat(F.lit("c"), (F.col("l_linenumber") % 7).cast("string")).alias("chrom"), (F.col("l_partkey") * 100).alias("pos")).distinct()
    return C.chrom_to_gw(p, X.genome(spark)).select("chrom", "pos", "gwpos")


@query("SELECT s, round(greatest(y1, least(y2, y1 + (s - x1) * ((y2 - y1) / (x2 - x1)))), 6) AS cm FROM (SELECT DISTINCT s FROM seg) JOIN gmap ON s >= x1 AND s < x2")
def bp_to_cm(spark, d):
    return C.bp_to_cm(X.seg(spark, d).select("s").distinct(), X.gmap(spark), "s").select("s", r6("cm", "cm"))


@query("SELECT cm, CAST(greatest(x1, least(x2, floor(x1 + (cm - y1) * ((x2 - x1) / (y2 - y1))))) AS BIGINT) AS bp FROM (SELECT DISTINCT l_partkey * 7 % 1050 / 2.0::DOUBLE AS cm FROM lineitem) JOIN gmap ON cm >= y1 AND cm < y2")
def cm_to_bp(spark, d):
    p = X.table(spark, d, "lineitem").select((F.col("l_partkey") * 7 % 1050 / 2.0).alias("cm")).distinct()
    return C.cm_to_bp(p, X.gmap(spark), "cm").select("cm", F.col("bp").cast("long").alias("bp"))


@query("SELECT chrid, chrom, size, CAST(coalesce(sum(size) OVER (ORDER BY chrid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gwstart, round(gwstart / 15000.0, 6) AS start_cm FROM genome")
def genome_dimension(spark, d):
    return C.genome_starts(X.genome(spark).drop("gwstart")).withColumn("start_cm", F.round(C.constant_cm(F.col("gwstart")), 6))


# intervals


@query("SELECT CASE WHEN e - s >= 80000 THEN 80000.0 WHEN e - s >= 40000 THEN 40000.0 ELSE 10000.0 END::DOUBLE AS bin_start, count(*) AS n FROM seg WHERE e - s >= 10000 GROUP BY 1")
def histogram(spark, d):
    return I.histogram(X.seg(spark, d).withColumn("len", F.col("e") - F.col("s")), "len", [10000, 40000, 80000])


ISLANDS = """, o AS (SELECT ind1, ind2, chrid, s, e, max(e) OVER (PARTITION BY ind1, ind2, chrid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {src}),
n AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY ind1, ind2, chrid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
isl AS (SELECT ind1, ind2, chrid, min(s) AS s, max(e) AS e FROM n GROUP BY ind1, ind2, chrid, k)
"""


@query(ISLANDS.format(src="seg") + "SELECT * FROM isl")
def interval_merge(spark, d):
    return I.islands(X.seg(spark, d), ["ind1", "ind2", "chrid"])


REF = """, o AS (SELECT ind1, ind2, chrid, s, e, lag(e) OVER (PARTITION BY ind1, ind2, chrid ORDER BY s, e) AS b FROM {src}),
n AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY ind1, ind2, chrid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
isl AS (SELECT ind1, ind2, chrid, min(s) AS s, CAST((max(s * 1000000 + (e - s)) % 1000000 + max(s)) AS BIGINT) AS e FROM n GROUP BY ind1, ind2, chrid, k)
"""


@query(REF.format(src="seg") + "SELECT * FROM isl")
def interval_merge_ref(spark, d):
    return I.islands(X.seg(spark, d), ["ind1", "ind2", "chrid"], "reference")


def chrom_islands(spark, d) -> DataFrame:
    """Merged segments of the greatest length that occurs, by chromosome."""
    s = X.seg(spark, d)
    return I.islands(s.join(F.broadcast(s.agg(F.max(F.col("e") - F.col("s")).alias("top"))), F.col("e") - F.col("s") == F.col("top"), "left_semi"), ["chrid"])


CHROM = """, o AS (SELECT chrid, s, e, max(e) OVER (PARTITION BY chrid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM seg WHERE e - s = (SELECT max(e - s) FROM seg)),
n AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY chrid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
reg AS (SELECT chrid, min(s) AS s, max(e) AS e FROM n GROUP BY chrid, k),
st AS (SELECT * FROM reg UNION ALL SELECT chrid, gwstart + size, gwstart + size FROM genome),
gap AS (SELECT * FROM (SELECT chrid, coalesce(lag(e) OVER (PARTITION BY chrid ORDER BY s, e), gwstart) AS s, s AS e FROM st JOIN genome USING (chrid)) WHERE s < e)
"""


@query(CHROM + "SELECT * FROM gap")
def interval_complement(spark, d):
    bounds = X.genome(spark).select("chrid", F.col("gwstart").alias("lo"), (F.col("gwstart") + F.col("size")).alias("hi"))
    return I.complement(chrom_islands(spark, d), bounds, ["chrid"])


@query("SELECT chrid, k * 700000 AS s, least(k * 700000 + 700000, size) AS e FROM genome, range(5) t(k) WHERE k * 700000 < size")
def genome_windows(spark, d):
    return I.genome_windows(X.genome(spark), 700_000)


@query(CHROM + ", pts AS (SELECT chrid, s - gwstart AS p FROM reg JOIN genome USING (chrid) UNION SELECT chrid, 0 FROM genome UNION SELECT chrid, size FROM genome) SELECT chrid, p AS s, e, chrom || '_' || p AS name FROM (SELECT chrid, p, lead(p) OVER (PARTITION BY chrid ORDER BY p) AS e FROM pts) JOIN genome USING (chrid) WHERE e IS NOT NULL")
def split_chrom(spark, d):
    g = X.genome(spark)
    cuts = chrom_islands(spark, d).join(F.broadcast(g.select("chrid", "gwstart")), "chrid").select("chrid", (F.col("s") - F.col("gwstart")).alias("p"))
    return I.split_chromosomes(g, cuts)


@query("SELECT DISTINCT p FROM (SELECT s AS p FROM seg UNION ALL SELECT e FROM seg)")
def endpoints(spark, d):
    return I.endpoints(X.seg(spark, d))


@query("SELECT a.ind1, a.ind2, count(*) AS n, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS shared FROM seg a JOIN seg b ON a.ind1 = b.ind1 AND a.ind2 = b.ind2 AND a.chrid = b.chrid AND a.s < b.e AND b.s < a.e WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O' GROUP BY 1, 2")
def interval_overlap_join(spark, d):
    a, b = sides(spark, d)
    keys = ["ind1", "ind2", "chrid"]
    j = I.clip(I.interval_join(a.select(*keys, "s", "e"), b.select(*keys, "s", "e"), keys))
    return j.groupBy("ind1", "ind2").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("shared"))


# segments


@query("SELECT greatest(a, b) AS ind1, CASE WHEN a < b THEN 1 ELSE 0 END AS was_turned, count(*) AS n FROM seg0 WHERE a <> b GROUP BY 1, 2")
def seg_turned(spark, d):
    li = X.table(spark, d, "lineitem")
    raw = li.select((F.col("l_suppkey") % 40).alias("ind1"), F.lit(0).alias("hap1"), (F.col("l_partkey") % 40).alias("ind2"), F.lit(0).alias("hap2")).where("ind1 <> ind2")
    return ibd.turned(raw).groupBy("ind1", "was_turned").agg(F.count("*").alias("n"))


@query("SELECT ind1, hap1, ind2, hap2, CAST(count(*) AS BIGINT) AS n FROM seg GROUP BY ALL")
def seg_normalize(spark, d):
    li = X.table(spark, d, "lineitem")
    raw = li.select((F.col("l_suppkey") % 40).alias("ind1"), (F.floor(F.col("l_suppkey") / 40) % 2).alias("hap1"), (F.col("l_partkey") % 40).alias("ind2"), (F.floor(F.col("l_partkey") / 40) % 2).alias("hap2")).where("ind1 <> ind2")
    return ibd.normalize(raw).groupBy("ind1", "hap1", "ind2", "hap2").agg(F.count("*").alias("n"))


@query("SELECT ind1, ind2, chrid, s, e, round((e - s) / 15000.0, 6) AS cm FROM seg WHERE (e - s) / 15000.0 >= 6")
def seg_min_cm(spark, d):
    return ibd.min_cm(X.seg(spark, d), 6).select("ind1", "ind2", "chrid", "s", "e", r6("cm", "cm"))


@query("SELECT l_linestatus AS part, 'Diploid' AS ploidy FROM seg GROUP BY 1 UNION ALL SELECT 'none', 'Haploid' UNION ALL SELECT 'merged', 'DiploidMerged'")
def infer_ploidy(spark, d):
    s = X.seg(spark, d)
    cases = [("F", s.where("l_linestatus = 'F'")), ("O", s.where("l_linestatus = 'O'")), ("none", s.where("false")), ("merged", s.withColumn("hap2", F.lit(2)))]
    out = [ibd.infer_ploidy(x).select(F.lit(n).alias("part"), "ploidy") for n, x in cases]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def ploidy_dim(spark) -> DataFrame:
    return spark.range(40).select(F.col("id").alias("hap"), F.floor(F.col("id") / 2).alias("dip"), (F.col("id") % 2).alias("which"))


@query("SELECT ind1 // 2 AS ind1, ind1 % 2 AS hap1, ind2 // 2 AS ind2, ind2 % 2 AS hap2, count(*) AS n FROM seg GROUP BY ALL")
def ploidy_h2d(spark, d):
    return ibd.haploid_to_diploid(X.seg(spark, d), ploidy_dim(spark)).groupBy("ind1", "hap1", "ind2", "hap2").agg(F.count("*").alias("n"))


@query("SELECT ind1, ind2, CAST(3 AS BIGINT) AS hap1, CAST(3 AS BIGINT) AS hap2, count(*) AS n FROM seg GROUP BY ALL")
def ploidy_d2h(spark, d):
    p = ploidy_dim(spark)
    return ibd.diploid_to_haploid(ibd.haploid_to_diploid(X.seg(spark, d), p), p).groupBy("ind1", "ind2", "hap1", "hap2").agg(F.count("*").alias("n"))


def coverage(spark, d, step: int = POINT_STEP, offset: int = 0, closed: bool = False, least_cm: float = 0.0) -> DataFrame:
    return I.sweep_coverage(I.grid(X.genome(spark), step, offset), ibd.min_cm(X.seg(spark, d), least_cm), ["chrid"], closed=closed)


LONG = 6.0  # least cM of the segments whose coverage is looked at for extremes and peaks
LONG_SQL = f" AND (e - s) / 15000.0 >= {LONG}"


COV = ", pt AS (SELECT chrid, gwstart + k * {step} + {off} AS p FROM genome, range({n}) t(k)), cov AS (SELECT chrid, p, (SELECT count(*) FROM seg WHERE seg.chrid = pt.chrid AND s <= p{w}) - (SELECT count(*) FROM seg WHERE seg.chrid = pt.chrid AND e {op} p{w}) AS cov FROM pt)\n"


@query(COV.format(step=10000, off=0, n=300, op="<=", w="") + "SELECT chrom, p - gwstart AS pos, p AS gwpos, round((p - cov.chrid) / 15000.0, 6) AS cm, cov FROM cov JOIN genome USING (chrid)")
def coverage_points(spark, d):
    c = C.gw_to_chrom(coverage(spark, d).withColumnRenamed("p", "gwpos").drop("chrid"), X.genome(spark))
    return c.select("chrom", "pos", "gwpos", F.round((F.col("gwpos") - F.col("chrid")) / 15_000.0, 6).alias("cm"), "cov")


@query(COV.format(step=7500, off=0, n=400, op="<=", w="") + "SELECT p, cov FROM cov")
def coverage_cm_grid(spark, d):
    return coverage(spark, d, 7500).select("p", "cov")


@query(COV.format(step=10000, off=0, n=300, op="<=", w="") + "SELECT chrid, round(avg(cov), 6) AS mean, median(cov) AS median FROM cov GROUP BY chrid")
def coverage_stats(spark, d):
    return I.coverage_stats(coverage(spark, d), ["chrid"]).select("chrid", r6("mean", "mean"), "median")


@query(COV.format(step=3750, off=1875, n=800, op="<", w="") + "SELECT p, cov FROM cov")
def coverage_closed(spark, d):
    return coverage(spark, d, 3750, 1875, True).select("p", "cov")


@query(CHROM + "SELECT ind1, ind2, seg.chrid, greatest(seg.s, reg.s) AS s, least(seg.e, reg.e) AS e FROM seg JOIN reg ON seg.chrid = reg.chrid AND seg.s < reg.e AND reg.s < seg.e WHERE (least(seg.e, reg.e) - greatest(seg.s, reg.s)) / 15000.0 >= 2")
def seg_clip_regions(spark, d):
    return ibd.clip_to_regions(X.seg(spark, d).select("ind1", "ind2", "chrid", "s", "e"), chrom_islands(spark, d), 2.0).select("ind1", "ind2", "chrid", "s", "e")


@query(CHROM + "SELECT ind1, ind2, seg.chrid, greatest(seg.s, gap.s) AS s, least(seg.e, gap.e) AS e FROM seg JOIN gap ON seg.chrid = gap.chrid AND seg.s < gap.e AND gap.s < seg.e WHERE (least(seg.e, gap.e) - greatest(seg.s, gap.s)) / 15000.0 >= 2")
def seg_remove_regions(spark, d):
    return ibd.remove_regions(X.seg(spark, d).select("ind1", "ind2", "chrid", "s", "e"), chrom_islands(spark, d), X.genome(spark), 2.0).select("ind1", "ind2", "chrid", "s", "e")


@query("SELECT ind1, ind2, chrid, k, greatest(s, chrid * 3000000 + k * 500000) AS s, least(e, chrid * 3000000 + k * 500000 + 500000) AS e FROM seg, range(6) t(k) WHERE s < chrid * 3000000 + k * 500000 + 500000 AND e > chrid * 3000000 + k * 500000")
def window_clip(spark, d):
    return ibd.window_clip(X.seg(spark, d), X.genome(spark), 500_000)


@query(ISLANDS.format(src="seg WHERE l_linestatus = 'F'") + "SELECT * FROM isl")
def diploid_merge(spark, d):
    return ibd.diploid_merge(sides(spark, d)[0])


FIRST = ", f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ind1, ind2 ORDER BY s, e) AS rn FROM seg)"


@query(FIRST + ISLANDS.format(src="f WHERE rn > 1") + "SELECT * FROM isl UNION ALL SELECT ind1, ind2, chrid, s, e FROM f WHERE rn = 1")
def diploid_merge_ref(spark, d):
    return ibd.diploid_merge(X.seg(spark, d), "reference")


@query(", ps AS (SELECT a.genome AS ind1, b.genome AS ind2, a.pos * 1000 AS pos FROM rec a JOIN rec b ON a.pos = b.pos AND a.genome > b.genome AND a.allele <> b.allele), r0 AS (SELECT ind1, ind2, chrid, s, e, max(e) OVER (PARTITION BY ind1, ind2, chrid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM seg), g AS (SELECT DISTINCT ind1, ind2, chrid, b AS gs, s AS ge FROM r0 WHERE s > b), br AS (SELECT g.* FROM g LEFT JOIN ps ON ps.ind1 = g.ind1 AND ps.ind2 = g.ind2 AND pos >= gs AND pos < ge GROUP BY ALL HAVING count(pos) <= 1 AND (ge - gs) / 15000.0 < 2), al AS (SELECT ind1, ind2, chrid, s, e FROM seg UNION ALL SELECT ind1, ind2, chrid, gs, ge FROM br)" + ISLANDS.format(src="al") + "SELECT * FROM isl")
def bridge_merge(spark, d):
    a = rec_gw(spark, d).select("pos", F.col("genome").alias("ind1"), F.col("allele").alias("a1"))
    b = rec_gw(spark, d).select("pos", F.col("genome").alias("ind2"), F.col("allele").alias("a2"))
    return ibd.bridge_merge(X.seg(spark, d), a.join(b, "pos").where("ind1 > ind2 and a1 <> a2").select("ind1", "ind2", "pos"), 2.0, 1)


@query(ISLANDS.format(src="seg") + "SELECT ind1, ind2, round(sum(e - s) / 15000.0, 6) AS total_cm FROM isl GROUP BY 1, 2")
def total_ibd_matrix(spark, d):
    return ibd.pair_totals(X.seg(spark, d)).select("ind1", "ind2", r6("total_cm", "total_cm"))


TWO = """, oa AS (SELECT l_linestatus AS ls, ind1, ind2, chrid, s, e, max(e) OVER (PARTITION BY l_linestatus, ind1, ind2, chrid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM seg),
na AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY ls, ind1, ind2, chrid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM oa),
isl AS (SELECT ls, ind1, ind2, chrid, min(s) AS s, max(e) AS e FROM na GROUP BY ls, ind1, ind2, chrid, k)
"""


@query(TWO + ", t AS (SELECT ls, ind1, ind2, sum(e - s) / 15000.0 AS cm FROM isl GROUP BY 1, 2, 3) SELECT a.k AS ind1, b.k AS ind2, round(coalesce(max(CASE WHEN ls = 'F' THEN cm END), 0), 6) AS a_cm, round(coalesce(max(CASE WHEN ls = 'O' THEN cm END), 0), 6) AS b_cm FROM range(40) a(k) JOIN range(40) b(k) ON a.k > b.k LEFT JOIN t ON t.ind1 = a.k AND t.ind2 = b.k GROUP BY 1, 2")
def pair_totals_ab(spark, d):
    a, b = sides(spark, d)
    return ibd.pair_totals_both(a, b, spark.range(40), "id").select("ind1", "ind2", r6("a_cm", "a_cm"), r6("b_cm", "b_cm"))


@query("SELECT round((k + 0.5) * 0.05, 6) AS center, round(sum(CASE WHEN l_linestatus = 'F' THEN e - s ELSE 0 END) / 15000.0, 6) AS a_cm, round(sum(CASE WHEN l_linestatus = 'O' THEN e - s ELSE 0 END) / 15000.0, 6) AS b_cm FROM (SELECT *, floor((e - s) / 15000.0::DOUBLE / 0.05::DOUBLE) AS k FROM seg) GROUP BY k")
def length_spectrum(spark, d):
    a, b = sides(spark, d)
    return ibd.length_spectrum(a, b).select(r6("center", "center"), r6("a_cm", "a_cm"), r6("b_cm", "b_cm"))


OVER = TWO + """, c AS (SELECT a.ind1, a.ind2, a.chrid, a.s, a.e, a.rn, coalesce(sum(CASE WHEN b.s IS NULL THEN 0 ELSE least(a.e, b.e) - greatest(a.s, b.s) END), 0) AS covered FROM (SELECT *, row_number() OVER () AS rn FROM seg WHERE l_linestatus = '{a}') a
  LEFT JOIN isl b ON b.ls = '{b}' AND a.ind1 = b.ind1 AND a.ind2 = b.ind2 AND a.chrid = b.chrid AND a.s < b.e AND b.s < a.e GROUP BY ALL),
bins AS (SELECT CASE WHEN (e - s) / 15000.0 >= 6 THEN 6.0 WHEN (e - s) / 15000.0 >= 4 THEN 4.0 ELSE 3.0 END::DOUBLE AS bin_start, CAST(covered AS DOUBLE) / (e - s) AS share FROM c WHERE (e - s) / 15000.0 >= 3),
w AS (SELECT a.ind1, a.ind2, a.chrid, a.s, a.e, coalesce(sum(CASE WHEN b.s IS NULL THEN 0 ELSE least(a.e, b.e) - greatest(a.s, b.s) END), 0) AS covered FROM isl a LEFT JOIN isl b ON b.ls = '{b}' AND a.ind1 = b.ind1 AND a.ind2 = b.ind2 AND a.chrid = b.chrid AND a.s < b.e AND b.s < a.e WHERE a.ls = '{a}' GROUP BY ALL),
g AS (SELECT CAST(sum(covered) AS DOUBLE) / sum(e - s) AS share FROM w GROUP BY ind1, ind2)
SELECT bin_start, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS std, count(*) AS n FROM bins GROUP BY 1 UNION ALL SELECT -1.0, round(avg(share), 6), round(stddev_pop(share), 6), count(*) FROM g"""


def _rates(a, b):
    return ibd.overlap_rates(a, b, [3, 4, 6, 10, 18]).select("bin_start", r6("mean", "mean"), r6("std", "std"), "n")


@query(OVER.format(a="F", b="O"))
def overlap_a_by_b(spark, d):
    a, b = sides(spark, d)
    return _rates(a, b)


@query(OVER.format(a="O", b="F"))
def overlap_b_by_a(spark, d):
    a, b = sides(spark, d)
    return _rates(b, a)


@query(", wc AS (SELECT l_linestatus AS ls, ind1, ind2, chrid, k, greatest(s, chrid * 3000000 + k * 500000) AS s, least(e, chrid * 3000000 + k * 500000 + 500000) AS e FROM seg, range(6) t(k) WHERE s < chrid * 3000000 + k * 500000 + 500000 AND e > chrid * 3000000 + k * 500000), o AS (SELECT *, max(e) OVER (PARTITION BY ls, ind1, ind2, chrid, k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM wc), n AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY ls, ind1, ind2, chrid, k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM o), isl AS (SELECT ls, ind1, ind2, chrid, k, min(s) AS s, max(e) AS e FROM n GROUP BY ls, ind1, ind2, chrid, k, i) SELECT a.chrid, a.k, count(*) AS n, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS shared FROM isl a JOIN isl b ON a.ind1 = b.ind1 AND a.ind2 = b.ind2 AND a.chrid = b.chrid AND a.k = b.k AND a.s < b.e AND b.s < a.e WHERE a.ls = 'F' AND b.ls = 'O' GROUP BY 1, 2")
def overlap_by_window(spark, d):
    a, b = sides(spark, d)
    g, keys = X.genome(spark), ["ind1", "ind2", "chrid", "k"]
    j = I.clip(I.interval_join(I.islands(ibd.window_clip(a, g, 500_000), keys), I.islands(ibd.window_clip(b, g, 500_000), keys), keys))
    return j.groupBy("chrid", "k").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("shared"))


@query("SELECT chrid, chrid * 3000000 + k * 15000 AS s, least(chrid * 3000000 + k * 15000 + 15000, chrid * 3000000 + 3000000) AS e FROM genome, range(200) t(k) WHERE (SELECT count(DISTINCT pos) FROM rec WHERE pos * 1000 >= chrid * 3000000 + k * 15000 AND pos * 1000 < chrid * 3000000 + k * 15000 + 15000) < 15")
def low_snp_windows(spark, d):
    return ibd.low_density_windows(X.rec(spark, d).select((F.col("pos") * GW).alias("pos")), X.genome(spark), 15_000, 15)


TRIM = ", tr AS (SELECT chrid, cov, row_number() OVER (PARTITION BY chrid ORDER BY cov, p) AS r, count(*) OVER (PARTITION BY chrid) AS n FROM cov), kept AS (SELECT * FROM tr WHERE r > floor(n * {t}::DOUBLE) AND r <= n - floor(n * {t}::DOUBLE))"
RUNS = "SELECT chrid, min(p) AS s, max(p) + 10000 AS e FROM (SELECT chrid, p, k - row_number() OVER (PARTITION BY chrid ORDER BY p) AS g FROM (SELECT cov.*, {lim}, row_number() OVER (PARTITION BY chrid ORDER BY p) AS k FROM cov JOIN lim USING (chrid)) WHERE {hit}) GROUP BY chrid, g"


@query(COV.format(step=10000, off=0, n=300, op="<=", w=LONG_SQL) + TRIM.format(t="0.03") + ", lim AS (SELECT chrid, avg(cov) + 1.5 * stddev_pop(cov) AS lim FROM kept GROUP BY 1) " + RUNS.format(lim="lim", hit="cov > lim"))
def extreme_coverage(spark, d):
    return ibd.extreme_regions(coverage(spark, d, least_cm=LONG), POINT_STEP, 1.5)


PEAKS = COV.format(step=10000, off=0, n=300, op="<=", w=LONG_SQL) + TRIM.format(t="0.05") + ", lim AS (SELECT chrid, median(cov) AS mid, floor(avg(cov) + 2 * stddev_pop(cov)) AS top FROM kept GROUP BY 1), wide AS (" + RUNS.format(lim="mid, top", hit="cov > mid") + "), core AS (" + RUNS.format(lim="mid, top", hit="cov > top") + "), pk AS (SELECT * FROM wide WHERE EXISTS (SELECT 1 FROM core WHERE core.chrid = wide.chrid AND core.s < wide.e AND wide.s < core.e))"


@query(PEAKS + " SELECT * FROM pk")
def ibd_peaks(spark, d):
    return ibd.peaks(coverage(spark, d, least_cm=LONG), POINT_STEP)


@query(PEAKS + ", pv AS (SELECT chrid, p, CAST((p * 7919) % 100003 AS DOUBLE) / 100003 / 100 AS pval FROM cov), rk AS (SELECT *, row_number() OVER (ORDER BY pval, p) AS r, count(*) OVER () AS n FROM pv), hit AS (SELECT * FROM rk WHERE pval * n / r < 0.0098) SELECT * FROM pk WHERE EXISTS (SELECT 1 FROM hit WHERE hit.chrid = pk.chrid AND pk.s <= hit.p AND hit.p < pk.e)")
def peak_filter(spark, d):
    cov = coverage(spark, d, least_cm=LONG)
    pv = cov.select("chrid", "p", ((F.col("p") * 7919 % 100_003).cast("double") / 100_003 / 100).alias("pval"))
    return ibd.filter_peaks(ibd.peaks(cov, POINT_STEP), pv, 0.0098)


@query(ISLANDS.format(src="seg") + "SELECT ind1, ind2, round(sum(e - s) / 15000.0, 6) AS total_cm FROM isl GROUP BY 1, 2 HAVING sum(e - s) / 15000.0 > 0.15 * 1400")
def related_pairs(spark, d):
    return ibd.related_pairs(X.seg(spark, d), 1400.0, 0.15).select("ind1", "ind2", r6("total_cm", "total_cm"))


GREEDY = """, rel AS (SELECT ind1 AS a, ind2 AS b FROM isl GROUP BY 1, 2 HAVING sum(e - s) / 15000.0 > 0.15 * 1400), ends AS MATERIALIZED (SELECT a AS x, b AS y FROM rel UNION ALL SELECT b, a FROM rel),
gone AS (SELECT 0 AS step, []::BIGINT[] AS ids UNION ALL SELECT step + 1, list_append(ids, worst) FROM (SELECT step, ids, (SELECT arg_max(x, n * 1000000 - x) FROM (SELECT x, count(*) AS n FROM ends WHERE NOT list_contains(ids, x) AND NOT list_contains(ids, y) GROUP BY x)) AS worst FROM gone) WHERE worst IS NOT NULL)
SELECT k AS ind FROM range(40) t(k) WHERE NOT list_contains((SELECT arg_max(ids, step) FROM gone), k)"""


@query(ISLANDS.format(src="seg") + GREEDY)
def unrelated(spark, d):
    edges = ibd.related_edges(X.seg(spark, d), 1400.0, 0.15)
    return spark.createDataFrame([(x,) for x in ibd.unrelated(list(range(40)), edges)], "ind long")


@query("SELECT ind1, ind2, s, e, l_linestatus FROM seg WHERE ind1 = 7 AND ind2 = 3")
def plot_pair(spark, d):
    return ibd.of_pair(X.seg(spark, d), 3, 7).select("ind1", "ind2", "s", "e", "l_linestatus")


@query("SELECT s_suppkey AS ind, s_name AS name FROM supplier WHERE contains(s_name, '7') ORDER BY s_suppkey LIMIT 5")
def sample_search(spark, d):
    return matrix.search_names(X.inds(spark, d), "7")


# rare variants


@query(f", r AS (SELECT pos, genome, {SITE_ALLELE} AS allele FROM rec) SELECT * FROM r WHERE pos IN (SELECT pos FROM r GROUP BY pos HAVING count(DISTINCT allele) = 1)")
def multiallelic_filter(spark, d):
    return rare.drop_multiallelic(rec_by_site(spark, d))


@query("SELECT pos, genome, allele FROM rec WHERE genome IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")
def rec_subset(spark, d):
    return rare.subset(X.rec(spark, d), X.inds(spark, d).where("ind % 3 = 0").select(F.col("ind").alias("genome"))).select("pos", "genome", "allele")


@query("SELECT coalesce(a.pos, b.pos) AS pos, a.allele AS allele_a, b.allele AS allele_b FROM (SELECT * FROM rec WHERE genome = 3) a FULL JOIN (SELECT * FROM rec WHERE genome = 8) b ON a.pos = b.pos")
def share_pair(spark, d):
    return rare.share_pair(X.rec(spark, d), 3, 8)


@query("SELECT pos, round(count(*) / 50.0, 6) AS freq FROM rec GROUP BY 1")
def allele_freq(spark, d):
    return rare.allele_freq(X.rec(spark, d), 50).select("pos", r6("freq", "freq"))


@query("SELECT pos, count(*) AS n FROM rec GROUP BY 1")
def allele_count(spark, d):
    return rare.allele_counts(X.rec(spark, d))


@query("SELECT pos, string_agg(CAST(genome AS VARCHAR), ',' ORDER BY genome) AS carriers FROM rec GROUP BY 1")
def matrix_view(spark, d):
    return rare.matrix_rows(X.rec(spark, d))


@query("SELECT pos, genome, allele FROM rec")
def record_packing(spark, d):
    return rare.unpack(rare.pack(X.rec(spark, d)), "packed")


@query("SELECT pos, genome, allele, CAST(CAST(allele + 250 AS HUGEINT) * 72057594037927936 + CAST(genome AS HUGEINT) * 4294967296 + pos AS VARCHAR) AS packed FROM rec")
def packed_bits(spark, d):
    """The numbers that records pack to, with alleles that reach the sign bit."""
    p = rare.pack(X.rec(spark, d).withColumn("allele", F.col("allele") + 250))
    return rare.unpack(p.withColumn("text", F.col("packed").cast("string")), "packed", "text").select("pos", "genome", (F.col("allele") - 250).alias("allele"), F.col("text").alias("packed"))


PAIRS = ", n AS (SELECT genome, count(*) AS n FROM rec GROUP BY 1), m AS (SELECT a.genome AS g1, b.genome AS g2, count(*) AS met, count(*) FILTER (WHERE a.allele = b.allele) AS eq FROM rec a JOIN rec b ON a.pos = b.pos AND a.genome > b.genome GROUP BY 1, 2), pt AS (SELECT x.genome AS g1, y.genome AS g2, x.n AS n1, y.n AS n2, coalesce(met, 0) AS met, coalesce(eq, 0) AS eq FROM n x JOIN n y ON x.genome > y.genome LEFT JOIN m ON m.g1 = x.genome AND m.g2 = y.genome) "


@query(PAIRS + "SELECT g1, g2, n1 + n2 - met AS total, eq AS shared, round(eq / (n1 + n2 - met), 6) AS jaccard FROM pt")
def jaccard(spark, d):
    return rare.jaccard(X.rec(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


LISTS = ", x AS (SELECT s_suppkey % 50 AS genome FROM supplier WHERE s_acctbal >= 0), y AS (SELECT s_suppkey % 50 AS genome FROM supplier WHERE s_nationkey >= 10), pl AS (SELECT DISTINCT greatest(x.genome, y.genome) AS g1, least(x.genome, y.genome) AS g2 FROM x JOIN y ON x.genome <> y.genome) "


def two_lists(spark, d) -> DataFrame:
    s = X.table(spark, d, "supplier").withColumn("genome", F.col("s_suppkey") % 50)
    return rare.pairs_of_lists(s.where("s_acctbal >= 0").select("genome"), s.where("s_nationkey >= 10").select("genome"))


@query(PAIRS + LISTS + "SELECT g1, g2, n1 + n2 - met AS total, eq AS shared, round(eq / (n1 + n2 - met), 6) AS jaccard FROM pt JOIN pl USING (g1, g2)")
def jaccard_of_lists(spark, d):
    return rare.jaccard(X.rec(spark, d), two_lists(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@query(PAIRS + LISTS + "SELECT g1, g2, round((2 * eq - met) / sqrt(n1 * n2), 6) AS cosine FROM pt JOIN pl USING (g1, g2) WHERE 2 * eq - met >= 1 AND least(n1, n2) >= 5 AND (2 * eq - met) / sqrt(n1 * n2) >= 0.005")
def cosine_of_lists(spark, d):
    return rare.cosine(X.rec(spark, d), two_lists(spark, d), 1, 5, 0.005).withColumn("cosine", F.round("cosine", 6))


@query(PAIRS + "SELECT g1, g2, round((2 * eq - met) / sqrt(n1 * n2), 6) AS cosine FROM pt")
def cosine(spark, d):
    return rare.cosine(X.rec(spark, d)).withColumn("cosine", F.round("cosine", 6))


@query(", w AS (SELECT pos, f, 4 * f * f / (2 * f * (1 - f)) AS t, -(4 * f * f) / (2 * f * (1 - f)) - 2 * f * (2 - 2 * f) / (2 * f * (1 - f)) AS d1, -(4 * f * f) / (2 * f * (1 - f)) + (2 - 2 * f) * (2 - 2 * f) / (2 * f * (1 - f)) AS d2 FROM (SELECT pos, count(*) / 50.0::DOUBLE AS f FROM rec GROUP BY 1) WHERE f > 0 AND f < 1), r AS (SELECT rec.*, d1, d2 FROM rec JOIN w USING (pos)), o AS (SELECT genome, sum(d1) AS d FROM r GROUP BY 1), fx AS (SELECT a.genome AS g1, b.genome AS g2, sum(CASE WHEN a.allele = b.allele THEN a.d2 - 2 * a.d1 ELSE -2 * a.d1 END) AS fix FROM r a JOIN r b ON a.pos = b.pos AND a.genome > b.genome GROUP BY 1, 2) SELECT x.genome AS g1, y.genome AS g2, round(((SELECT sum(t) FROM w) + x.d + y.d + coalesce(fix, 0)) / (SELECT count(*) FROM w), 6) AS rel FROM o x JOIN o y ON x.genome > y.genome LEFT JOIN fx ON g1 = x.genome AND g2 = y.genome")
def grm(spark, d):
    return rare.grm(X.rec(spark, d), 50).withColumn("rel", F.round("rel", 6))


DOSE = ", ds AS (SELECT genome // 2 AS sample, pos, count(*) AS dose FROM rec GROUP BY 1, 2), ids AS (SELECT DISTINCT sample FROM ds), pr AS (SELECT a.sample AS s1, b.sample AS s2 FROM ids a JOIN ids b ON a.sample > b.sample)"


@query(DOSE + " SELECT s1, s2, (SELECT count(*) FROM ds WHERE sample = s1) + (SELECT count(*) FROM ds WHERE sample = s2) - (SELECT count(*) + count(*) FILTER (WHERE a.dose = b.dose) FROM ds a JOIN ds b ON a.pos = b.pos WHERE a.sample = s1 AND b.sample = s2) AS discordance FROM pr")
def sample_diff(spark, d):
    return rare.sample_discordance(X.rec(spark, d))


@query(DOSE + " SELECT s1, s2, (SELECT count(*) FROM ds a WHERE sample = s1 AND dose = 2 AND NOT EXISTS (SELECT 1 FROM ds b WHERE b.sample = s2 AND b.pos = a.pos)) + (SELECT count(*) FROM ds a WHERE sample = s2 AND dose = 2 AND NOT EXISTS (SELECT 1 FROM ds b WHERE b.sample = s1 AND b.pos = a.pos)) AS discordance FROM pr")
def discordance(spark, d):
    return rare.opposite_homozygotes(X.rec(spark, d))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey")
def id_pairs(spark, d):
    i = X.inds(spark, d).select(F.col("ind").alias("id"))
    return rare.id_pairs(i, i)


# rare variants against segments

HS = ", hs AS (SELECT ind1 AS g1, ind2 AS g2, chrid, s, e, row_number() OVER () AS id FROM seg), rg AS (SELECT pos * 1000 AS pos, genome, allele FROM rec)"


@query(HS.replace("genome, allele FROM rec", f"genome, {SITE_ALLELE} AS allele FROM rec") + ", one AS (SELECT pos FROM rg GROUP BY pos HAVING count(DISTINCT allele) = 1 AND count(*) >= 2), r AS (SELECT * FROM rg WHERE pos IN (SELECT pos FROM one)), per AS (SELECT r.pos, hs.id, count(*) AS k FROM r JOIN hs ON s <= pos AND pos < e AND (genome = g1 OR genome = g2) GROUP BY 1, 2), c AS (SELECT pos, count(*) FILTER (WHERE k = 2) AS w, count(*) FILTER (WHERE k = 1) AS b FROM per GROUP BY 1), cv AS (SELECT pos, count(id) AS cov FROM one LEFT JOIN hs ON s <= pos AND pos < e GROUP BY 1) SELECT pos, (SELECT count(*) FROM r WHERE r.pos = cv.pos) AS carriers, coalesce(w, 0) AS within, coalesce(b, 0) AS between, cov - coalesce(w, 0) - coalesce(b, 0) AS outside FROM cv LEFT JOIN c USING (pos)")
def position_scan(spark, d):
    return rvibd.position_scan(rec_by_site(spark, d).withColumn("pos", F.col("pos") * GW), hap_segs(spark, d))


@query(HS + PAIRS.replace("FROM rec ", "FROM rg ").replace("JOIN rec b", "JOIN rg b") + ", ins AS (SELECT DISTINCT g1, g2, pos, x, y FROM (SELECT h.g1, h.g2, coalesce(a.pos, b.pos) AS pos, a.allele AS x, b.allele AS y, s, e FROM (SELECT DISTINCT g1, g2 FROM hs) h JOIN rg a ON a.genome = g1 LEFT JOIN rg b ON b.genome = g2 AND b.pos = a.pos JOIN hs z ON z.g1 = h.g1 AND z.g2 = h.g2 AND z.s <= a.pos AND a.pos < z.e UNION ALL SELECT h.g1, h.g2, b.pos, a.allele, b.allele, s, e FROM (SELECT DISTINCT g1, g2 FROM hs) h JOIN rg b ON b.genome = g2 LEFT JOIN rg a ON a.genome = g1 AND b.pos = a.pos JOIN hs z ON z.g1 = h.g1 AND z.g2 = h.g2 AND z.s <= b.pos AND b.pos < z.e)), i AS (SELECT count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS io, count(*) FILTER (WHERE x = y) AS ie, count(*) FILTER (WHERE x <> y) AS ine FROM ins), t AS (SELECT CAST(sum(n1 + n2 - 2 * met) AS BIGINT) AS o, CAST(sum(eq) AS BIGINT) AS e, CAST(sum(met - eq) AS BIGINT) AS ne FROM pt) SELECT io AS ibd_one, ie AS ibd_eq, ine AS ibd_ne, o - io AS out_one, e - ie AS out_eq, ne - ine AS out_ne FROM i, t")
def rv_ibd_counters(spark, d):
    return rvibd.pair_counters(rec_gw(spark, d), hap_segs(spark, d))


@query(HS + " SELECT a.genome AS g1, b.genome AS g2, a.pos, a.allele, min(s * 1000000 + (e - s)) // 1000000 AS s, min(s * 1000000 + (e - s)) // 1000000 + min(s * 1000000 + (e - s)) % 1000000 AS e FROM rg a JOIN rg b ON a.pos = b.pos AND a.genome > b.genome AND a.allele = b.allele LEFT JOIN hs ON g1 = a.genome AND g2 = b.genome AND s <= a.pos AND a.pos < e GROUP BY 1, 2, 3, 4")
def rv_ibd_matched(spark, d):
    return rvibd.matched_rows(rec_gw(spark, d), hap_segs(spark, d))


@query(HS + ", q AS (SELECT * FROM rg WHERE genome % 4 = 0)" + PAIRS.replace("FROM rec ", "FROM q ").replace("JOIN rec b", "JOIN q b") + ", tt AS (SELECT g1, g2, sum(e - s) / 15000.0 AS cm FROM hs GROUP BY 1, 2) SELECT pt.g1, pt.g2, round(coalesce(cm, 0) / (SELECT (max(pos) - min(pos)) / 15000.0 FROM q), 6) AS ibd_prop, round(met / sqrt(n1 * n2), 6) AS cosine, round(met / (n1 + n2 - met), 6) AS jaccard FROM pt LEFT JOIN tt ON tt.g1 = pt.g1 AND tt.g2 = pt.g2")
def rv_ibd_similarity(spark, d):
    return rvibd.similarity(rec_gw(spark, d), hap_segs(spark, d), 4).select("g1", "g2", r6("ibd_prop", "ibd_prop"), r6("cosine", "cosine"), r6("jaccard", "jaccard"))


# selection statistic

XIRS = ", st AS (SELECT CAST(pos * 1000 // 3000000 AS INTEGER) AS chrid, pos * 1000 AS pos, count(*) / 50.0::DOUBLE AS freq FROM rec GROUP BY pos), sc AS (SELECT chrid, s, e, ind1, ind2, (SELECT count(*) FROM st WHERE st.chrid = seg.chrid AND pos < e) - (SELECT count(*) FROM st WHERE st.chrid = seg.chrid AND pos < s) AS k FROM seg), c AS (SELECT ind1, ind2, sum(k) / (SELECT count(*)::DOUBLE FROM st) AS c FROM sc GROUP BY 1, 2), ct AS (SELECT sum(c) AS c1, sum(c * c) AS c2 FROM c), xs AS (SELECT st.chrid, st.pos, freq, count(z.s) AS x, coalesce(sum(c), 0) AS xc FROM st LEFT JOIN (SELECT seg.*, c.c FROM seg JOIN c USING (ind1, ind2)) z ON z.chrid = st.chrid AND z.s <= st.pos AND st.pos < z.e GROUP BY 1, 2, 3), rw AS (SELECT chrid, pos, freq, (x + c2 + 780 * r * r - 2 * xc - 2 * r * x + 2 * r * c1) / (freq * (1 - freq)) AS raw FROM (SELECT *, (x - c1) / 780.0::DOUBLE AS r FROM xs, ct))"


def _raw(spark, d):
    return stats.xirs_raw(hap_segs(spark, d), sites(spark, d), 780)


@query(XIRS + " SELECT chrid, pos, round(freq, 6) AS freq, round(raw, 5) AS raw FROM rw")
def xirs_raw2(spark, d):
    return _raw(spark, d).select("chrid", "pos", r6("freq", "freq"), F.round("raw", 5).alias("raw"))


@query(" SELECT CAST(pos * 1000 // 3000000 AS INTEGER) AS chrid, pos * 1000 AS pos, 0.0::DOUBLE AS raw FROM rec GROUP BY pos")
def xirs_raw1(spark, d):
    return stats.xirs_row_sums(sites(spark, d)).select("chrid", "pos", "raw")


@query(XIRS + ", nb AS (SELECT *, ntile(100) OVER (ORDER BY freq, chrid, pos) AS bin FROM rw), zz AS (SELECT *, (raw - avg(raw) OVER (PARTITION BY bin)) / nullif(stddev_pop(raw) OVER (PARTITION BY bin), 0) AS z FROM nb) SELECT chrid, pos, CAST(bin AS INTEGER) AS bin, round(z, 5) AS z, round(z * z, 5) AS xirs FROM zz")
def xirs_norm(spark, d):
    return stats.xirs_norm(_raw(spark, d)).select("chrid", "pos", "bin", F.round("z", 5).alias("z"), F.round("xirs", 5).alias("xirs"))


# twice the upper tail of the normal distribution, by Simpson's rule on 400 steps of (0, z)
PVAL = XIRS + ", nb AS (SELECT *, ntile(100) OVER (ORDER BY freq, chrid, pos) AS bin FROM rw), zz AS (SELECT *, abs((raw - avg(raw) OVER (PARTITION BY bin)) / nullif(stddev_pop(raw) OVER (PARTITION BY bin), 0)) AS z FROM nb), tail AS (SELECT chrid, pos, 1 - 2 * sum((CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * k / 400.0::DOUBLE) * (z * k / 400.0::DOUBLE) / 2)) * z / 1200 / sqrt(2 * pi()) AS pval FROM zz, range(401) t(k) GROUP BY chrid, pos, z)"


@query(PVAL + " SELECT chrid, pos, round(freq, 6) AS freq, round(raw, 5) AS raw, round(z * z, 5) AS xirs, round(pval, 6) AS pval FROM zz JOIN tail USING (chrid, pos)")
def xirs_pval(spark, d):
    p = stats.xirs_pvalues(stats.xirs_norm(_raw(spark, d)))
    return p.select("chrid", "pos", r6("freq", "freq"), F.round("raw", 5).alias("raw"), F.round("xirs", 5).alias("xirs"), F.round("pval", 6).alias("pval"))


@query()
def skat(spark, d):
    dose = X.rec(spark, d).groupBy((F.col("genome")).alias("sample"), "pos").agg(F.count("*").alias("dose"))
    p = spark.range(50).select(F.col("id").alias("sample"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"), F.array((F.pmod(F.xxhash64("id"), F.lit(97)) / 97.0)).alias("x"))
    return stats.skat_windows(dose, p, 200, 200)


# ancestry

LA = ", lr AS (SELECT * FROM (SELECT *, lag(anc) OVER (PARTITION BY hap ORDER BY s) AS b FROM la) WHERE b IS NULL OR b <> anc), run AS (SELECT * FROM (SELECT hap, s, coalesce(lead(s) OVER (PARTITION BY hap ORDER BY s), 21000000) AS e, anc FROM lr) WHERE s < e)"


def _runs(spark, d):
    return A.runs(X.la_windows(spark, d), 21_000_000)


@query(LA + " SELECT hap, s, e, anc FROM run")
def la_runs(spark, d):
    return _runs(spark, d)


@query(LA + " SELECT a.hap AS hap1, b.hap AS hap2, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, a.anc AS anc1, b.anc AS anc2 FROM run a JOIN run b ON b.hap = a.hap + 1 AND a.s < b.e AND b.s < a.e WHERE a.hap % 2 = 0")
def la_pair_runs(spark, d):
    pairs = spark.range(20).select((F.col("id") * 2).alias("hap1"), (F.col("id") * 2 + 1).alias("hap2"))
    return A.pair_runs(_runs(spark, d), pairs).select("hap1", "hap2", "s", "e", "anc1", "anc2")


@query(LA + " SELECT ind1 AS hap1, ind2 AS hap2, greatest(seg.s, a.s, b.s) AS s, least(seg.e, a.e, b.e) AS e, a.anc AS anc1, b.anc AS anc2, count(*) AS n FROM seg JOIN run a ON a.hap = ind1 AND seg.s < a.e AND a.s < seg.e JOIN run b ON b.hap = ind2 AND seg.s < b.e AND b.s < seg.e WHERE greatest(seg.s, a.s, b.s) < least(seg.e, a.e, b.e) GROUP BY ALL")
def asibd(spark, d):
    s = X.seg(spark, d).select(F.col("ind1").alias("hap1"), F.col("ind2").alias("hap2"), "s", "e")
    return A.ancestry_segments(s, _runs(spark, d)).groupBy("hap1", "hap2", "s", "e", "anc1", "anc2").agg(F.count("*").alias("n"))



# matrices, pairs, order


@query(", t AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey) SELECT i, j, (i - 1) * i // 2 + j AS idx, i AS i_back, j AS j_back FROM t")
def triangular_index(spark, d):
    p = matrix.triangle(X.inds(spark, d).select(F.col("ind").alias("id"))).toDF("i0", "j0")
    m = matrix.from_pair_index(matrix.with_pair_index(p, "i0", "j0"))
    return m.select(F.col("i0").alias("i"), F.col("j0").alias("j"), "idx", F.col("i").alias("i_back"), F.col("j").alias("j_back"))


CELLS = ", f AS (SELECT ind1 AS row, ind2 AS col, CAST(count(*) AS BIGINT) AS value FROM seg WHERE l_linestatus = 'F' GROUP BY 1, 2), o AS (SELECT ind1 AS row, ind2 AS col, CAST(count(*) AS BIGINT) AS value FROM seg WHERE l_linestatus = 'O' GROUP BY 1, 2)"


def _cells(segs) -> DataFrame:
    return segs.groupBy(F.col("ind1").alias("row"), F.col("ind2").alias("col")).agg(F.count("*").alias("value"))


@query(CELLS + " SELECT f.row, f.col, coalesce(o.value, f.value) AS value FROM f LEFT JOIN o ON o.row = f.row AND o.col = f.col")
def matrix_update(spark, d):
    a, b = sides(spark, d)
    return matrix.update(_cells(a), _cells(b))


@query(CELLS + " SELECT col AS row, row AS col, value FROM f WHERE row % 3 = 0 AND col < 10")
def matrix_subset(spark, d):
    ids = spark.range(40).select(F.col("id").alias("name"))
    return matrix.transpose(matrix.subset(_cells(sides(spark, d)[0]), ids.where("name % 3 = 0"), ids.where("name < 10")))


@query(", x AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal >= 0), y AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey >= 10) SELECT a.id AS a, b.id AS b, 'between' AS part FROM (SELECT id FROM x EXCEPT SELECT id FROM y) a, (SELECT id FROM y EXCEPT SELECT id FROM x) b UNION ALL SELECT a.id, b.id, 'within' FROM (SELECT id FROM x INTERSECT SELECT id FROM y) a JOIN (SELECT id FROM x INTERSECT SELECT id FROM y) b ON a.id > b.id")
def id_pair_blocks(spark, d):
    s = X.table(spark, d, "supplier").withColumnRenamed("s_suppkey", "id")
    return matrix.pair_blocks(s.where("s_acctbal >= 0").select("id"), s.where("s_nationkey >= 10").select("id"))


@query("SELECT chrid, ind1, ind2, s, e, hap1, hap2, row_number() OVER (PARTITION BY ind1, ind2 ORDER BY s, e, hap1, hap2, l_linestatus) - 1 AS place FROM seg")
def seg_order(spark, d):
    o = matrix.ordered(X.seg(spark, d), ["s", "e", "hap1", "hap2", "l_linestatus"], ["ind1", "ind2"])
    return o.select("chrid", "ind1", "ind2", "s", "e", "hap1", "hap2", F.col("place").cast("long").alias("place"))


@query("SELECT genome, pos, row_number() OVER (PARTITION BY genome ORDER BY pos) - 1 AS place FROM rec")
def rec_order(spark, d):
    return matrix.ordered(X.rec(spark, d), ["pos"], ["genome"]).select("genome", "pos", F.col("place").cast("long").alias("place"))


@query("SELECT DISTINCT ind1 AS id FROM seg WHERE l_linestatus = 'F' EXCEPT SELECT ind2 FROM seg WHERE l_linestatus = 'O'")
def id_difference(spark, d):
    a, b = sides(spark, d)
    return matrix.id_difference(a.select(F.col("ind1").alias("id")), b.select(F.col("ind2").alias("id")))


@query(TWO + ", x AS (SELECT DISTINCT ind1, ind2, chrid, s, e FROM seg WHERE l_linestatus = 'F') SELECT x.ind1, x.ind2, x.chrid, x.s, x.e, CAST(coalesce(sum(CASE WHEN b.s IS NULL THEN 0 ELSE least(x.e, b.e) - greatest(x.s, b.s) END), 0) AS BIGINT) AS covered FROM x LEFT JOIN isl b ON b.ls = 'O' AND x.ind1 = b.ind1 AND x.ind2 = b.ind2 AND x.chrid = b.chrid AND x.s < b.e AND b.s < x.e GROUP BY ALL")
def overlap_details(spark, d):
    a, b = sides(spark, d)
    return ibd.overlap_shares(a, b).select("ind1", "ind2", "chrid", "s", "e", F.col("covered").cast("long").alias("covered"))
