"""Queries of sources and sinks: each writes a view in a format, reads it again and returns what was read; the SQL is that of the view.

Files go to a new folder under spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ancestry as A
from ..operators import ibd
from ..sources import fixtures as X
from ..sources import readers as R
from ..sources import sinks as S
from ..sources.scratch import scratch, write_named_text
from . import catalog as C
from .catalog import query, r6

# segments with positions inside chromosomes of 4 Mb, and 40 named individuals
SIZE = 4_000_000
SHIFT = 1_200_000
SEGS = ", ps AS (SELECT ind1, hap1, ind2, hap2, chrid, s - chrid * 3000000 + 1200000 + chrid * 4000000 AS s, e - chrid * 3000000 + 1200000 + chrid * 4000000 AS e, l_linestatus FROM seg) "
COLUMNS = ("ind1", "hap1", "ind2", "hap2", "chrid", "s", "e")


def genome(spark) -> DataFrame:
    return R.genome_from_lists(spark, [f"c{k}" for k in range(7)], [SIZE] * 7)


def people(spark) -> DataFrame:
    return spark.range(40).select(F.col("id").alias("ind"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("name"))


def segments(spark, d) -> DataFrame:
    move = F.lit(SHIFT) + F.col("chrid").cast("long") * (SIZE - X.SIZE)
    return X.seg(spark, d).withColumn("s", F.col("s") + move).withColumn("e", F.col("e") + move)


def _same(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("int" if c == "chrid" else "long").alias(c) for c in names])


ALL = "SELECT ind1, hap1, ind2, hap2, chrid, s, e FROM ps"
HAPLOID = "SELECT ind1, CAST(3 AS BIGINT) AS hap1, ind2, CAST(3 AS BIGINT) AS hap2, chrid, s, e FROM ps"


@query(SEGS + ALL)
def hapibd_file(spark, d):
    path = scratch(spark, "hapibd")
    S.hapibd_csv(segments(spark, d), people(spark), genome(spark), path)
    return _same(R.read_hapibd(spark, path, people(spark), genome(spark)), *COLUMNS)


@query(SEGS + ALL)
def hapibd_folder(spark, d):
    path = scratch(spark, "hapibd-folder")
    S.hapibd_csv(segments(spark, d), people(spark), genome(spark), path + "-flat")
    lines = spark.read.text(path + "-flat").select(F.split("value", "\t")[4].alias("chrom"), "value")
    write_named_text(lines, path, "chrom", gzip=True, extension=".ibd.gz")
    return _same(R.read_hapibd_dir(spark, path, people(spark), genome(spark)), *COLUMNS)


def _lines(spark, d, *more) -> DataFrame:
    """Segments with names, the chromosome's name and 1-based positions in it."""
    one, two = people(spark).toDF("ind1", "n1"), people(spark).toDF("ind2", "n2")
    j = segments(spark, d).join(F.broadcast(one), "ind1").join(F.broadcast(two), "ind2").join(F.broadcast(genome(spark).select("chrid", "chrom", "gwstart")), "chrid")
    return j.select("chrom", "n1", "n2", (F.col("s") - F.col("gwstart") + 1).alias("a"), (F.col("e") - F.col("gwstart") + 1).alias("b"), "l_linestatus")


def _tskibd(spark, d) -> str:
    path = scratch(spark, "tskibd")
    value = F.concat_ws("\t", "n1", "n2", F.concat(F.col("a").cast("string"), F.lit(".25")), F.concat(F.col("b").cast("string"), F.lit(".75")), F.lit("0"), F.lit("1.0"), F.lit("0"))
    write_named_text(_lines(spark, d).select("chrom", value.alias("value")), path, "chrom", "Id1\tId2\tStart\tEnd\tAncestor\tTmrca\tHasMutation", extension=".ibd")
    return path


@query(SEGS + HAPLOID + " WHERE chrid = 2")
def tskibd_file(spark, d):
    return _same(R.read_tskibd(spark, _tskibd(spark, d) + "/c2.ibd", people(spark), genome(spark)), *COLUMNS)


@query(SEGS + HAPLOID)
def tskibd_folder(spark, d):
    return _same(R.read_tskibd_dir(spark, _tskibd(spark, d), people(spark), genome(spark)), *COLUMNS)


def _hmmibd(spark, d) -> str:
    """Segments of set A are shared (state 0), those of B are not."""
    path = scratch(spark, "hmmibd")
    value = F.concat_ws("\t", "n1", "n2", "chrom", F.col("a").cast("string"), F.col("b").cast("string"), F.when(F.col("l_linestatus") == "F", "0").otherwise("1"), F.lit("9"))
    write_named_text(_lines(spark, d).select("chrom", value.alias("value")), path, "chrom", "sample1\tsample2\tchr\tstart\tend\tdifferent\tNsnp", extension=".hmm.txt")
    return path


@query(SEGS + HAPLOID + " WHERE l_linestatus = 'F' AND chrid = 3")
def hmmibd_file(spark, d):
    return _same(R.read_hmmibd(spark, _hmmibd(spark, d) + "/c3.hmm.txt", people(spark), genome(spark)), *COLUMNS)


@query(SEGS + HAPLOID + " WHERE l_linestatus = 'F' AND (e - s) / 15000.0 >= 2")
def hmmibd_folder(spark, d):
    return _same(R.read_hmmibd_dir(spark, _hmmibd(spark, d), people(spark), genome(spark)), *COLUMNS)


@query(SEGS + ALL)
def eibd_file(spark, d):
    path = scratch(spark, "eibd") + ".eibd"
    S.write_eibd(segments(spark, d), path)
    return _same(R.read_eibd(spark, path, genome(spark)), *COLUMNS)


# genomes, maps, lists


KNOTS = "SELECT x1, least(x2, chrid * 3000000 + 2999999) AS x2, round(y1 - chrid * (50.0 / 1500000), 6) AS y1, round(y1 - chrid * (50.0 / 1500000) + (y2 - y1) * (least(x2, chrid * 3000000 + 2999999) - x1) / (x2 - x1), 6) AS y2 FROM (SELECT *, x1 // 3000000 AS chrid FROM gmap)"


@query(KNOTS)
def genome_text(spark, d):
    path = scratch(spark, "genome") + "/genome.toml"
    S.write_genome_text(X.genome(spark), X.gmap(spark), path)
    return R.read_genome_text(spark, path)[1].select("x1", "x2", r6("y1", "y1"), r6("y2", "y2"))


@query("SELECT x1, x2, y1, y2 FROM gmap")
def genome_tables(spark, d):
    path = scratch(spark, "genome-tables")
    S.write_genome_tables(X.genome(spark), X.gmap(spark), path)
    return R.read_genome_tables(spark, path)[1]


@query("SELECT x1, x2, y1, y2 FROM gmap")
def map_of_lists(spark, d):
    return R.map_from_lists(spark, [[(0, 0.0), (1_500_000, 100.0), (3_000_000, 150.0)]] * 7, X.genome(spark))


@query("SELECT s_suppkey AS ind, s_name AS name FROM supplier")
def individuals_table(spark, d):
    path = scratch(spark, "individuals")
    S.write_names(X.inds(spark, d), path)
    return R.read_names(spark, path)


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS hap, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 2 AS BIGINT) AS dip, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) % 2 AS INTEGER) AS which FROM supplier")
def individuals_text(spark, d):
    path = scratch(spark, "names")
    lines = X.inds(spark, d).orderBy("ind").select(F.concat_ws("\t", "name", F.concat(F.lit("d"), F.floor(F.col("ind") / 2).cast("string"))).alias("value"))
    lines.coalesce(1).write.text(path)
    return R.read_individuals(spark, path)[1]


@query("SELECT DISTINCT l_partkey AS id FROM lineitem")
def id_list(spark, d):
    path = scratch(spark, "ids")
    X.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("value")).distinct().write.text(path)
    return R.read_ids(spark, path)


@query("SELECT CAST(l_partkey % 7 AS INTEGER) AS k, l_partkey AS pos, CAST(l_partkey % 7 AS BIGINT) * 4000000 + l_partkey AS gw FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def position_list(spark, d):
    path = scratch(spark, "positions")
    p = F.col("l_partkey")
    X.table(spark, d, "lineitem").select(F.concat_ws("\t", F.concat(F.lit("c"), (p % 7).cast("string")), p.cast("string")).alias("value")).distinct().write.text(path)
    gw = R.read_positions(spark, path, genome(spark)).select(F.col("pos").alias("gw"))
    return gw.select(F.floor(F.col("gw") / SIZE).cast("int").alias("k"), (F.col("gw") % SIZE).alias("pos"), "gw")


# variants

VREC = ", vr AS (SELECT pos * 1000 AS pos, genome, allele FROM rec), al AS (SELECT pos, allele, count(*) AS n FROM vr GROUP BY 1, 2), cr AS (SELECT pos, count(*) AS n FROM vr GROUP BY 1) "


def _vcf(spark, d, alleles: int = 3) -> str:
    path = scratch(spark, "vcf")
    rec = C.rec_gw(spark, d)
    if alleles == 2:
        rec = rec.withColumn("allele", F.lit(1).cast("long"))
    names = ["A", "C", "G"][:alleles]
    sites = rec.select("pos").distinct().withColumn("alleles", F.array(*map(F.lit, names)))
    S.write_vcf(rec, sites, vcf_genome(spark), [f"s{k}" for k in range(25)], path)
    return path


def vcf_genome(spark) -> DataFrame:
    """One chromosome as long as all positions of records need."""
    return R.genome_from_lists(spark, ["v"], [1 << 40])


@query(VREC + "SELECT vr.pos, genome, vr.allele FROM vr JOIN al ON al.pos = vr.pos AND al.allele = vr.allele WHERE al.n < 12 UNION ALL SELECT cr.pos, g, 0 FROM cr, range(50) t(g) WHERE 50 - cr.n < 12 AND 50 - cr.n > 0 AND NOT EXISTS (SELECT 1 FROM vr WHERE vr.pos = cr.pos AND vr.genome = g)")
def vcf_rare_records(spark, d):
    return R.read_vcf_rare(spark, _vcf(spark, d), vcf_genome(spark), 0.25)[0].select("pos", "genome", "allele")


@query(VREC + "SELECT vr.pos, genome - 10 AS genome, vr.allele FROM vr JOIN (SELECT pos, allele, count(*) AS n FROM vr WHERE genome BETWEEN 10 AND 29 GROUP BY 1, 2) a ON a.pos = vr.pos AND a.allele = vr.allele WHERE genome BETWEEN 10 AND 29 AND a.n < 6 AND vr.pos >= 100000 AND vr.pos < 1500000 UNION ALL SELECT c.pos, g, 0 FROM (SELECT DISTINCT pos FROM vr) c JOIN range(20) t(g) ON true LEFT JOIN (SELECT pos, count(*) AS n FROM vr WHERE genome BETWEEN 10 AND 29 GROUP BY 1) m ON m.pos = c.pos WHERE c.pos >= 100000 AND c.pos < 1500000 AND 20 - coalesce(m.n, 0) < 6 AND 20 - coalesce(m.n, 0) > 0 AND NOT EXISTS (SELECT 1 FROM vr WHERE vr.pos = c.pos AND vr.genome = g + 10)")
def vcf_region_of_samples(spark, d):
    return R.read_vcf_rare(spark, _vcf(spark, d), vcf_genome(spark), 0.3, [f"s{k}" for k in range(5, 15)], ("v", 100_000, 1_500_000))[0].select("pos", "genome", "allele")


@query(VREC + "SELECT vr.pos, genome FROM vr JOIN cr USING (pos) WHERE cr.n >= 20 AND 50 - cr.n >= 20")
def vcf_common_matrix(spark, d):
    return R.read_vcf_matrix(spark, _vcf(spark, d, 2), vcf_genome(spark), 0.4)


@query(VREC + "SELECT pos, round(n / 50.0, 6) AS freq FROM cr")
def vcf_allele_freq(spark, d):
    return R.read_vcf_afreq(spark, _vcf(spark, d, 2), vcf_genome(spark)).select("pos", r6("freq", "freq"))


@query(VREC + "SELECT pos FROM cr")
def vcf_position_list(spark, d):
    return R.vcf_positions(spark, _vcf(spark, d), vcf_genome(spark))


@query("SELECT pos, genome, allele FROM rec")
def records_table(spark, d):
    path = scratch(spark, "records")
    S.write_packed_records(X.rec(spark, d), path, "2")
    return R.read_packed_records(spark, path)[0]


@query("SELECT CAST(genome AS BIGINT) AS row, pos AS col FROM rec")
def bool_matrix_table(spark, d):
    path = scratch(spark, "bool")
    r = X.rec(spark, d).select(F.col("genome").alias("row"), F.col("pos").alias("col"))
    S.write_bool_matrix(r, 50, r.agg(F.max("col") + 1).first()[0], path)
    return R.read_bool_matrix(spark, path)


@query(", s AS (SELECT DISTINCT pos, CASE WHEN pos % 2 = 0 THEN 'A C' ELSE 'A G T' END AS alleles FROM rec) SELECT row_number() OVER (ORDER BY pos) - 1 AS site_id, pos, alleles FROM s")
def sites_table(spark, d):
    path = scratch(spark, "sites")
    s = X.rec(spark, d).select("pos").distinct().withColumn("alleles", F.when(F.col("pos") % 2 == 0, F.array(F.lit("A"), F.lit("C"))).otherwise(F.array(F.lit("A"), F.lit("G"), F.lit("T"))))
    S.write_sites(s, path)
    return R.read_sites(spark, path).select(F.col("site_id").cast("long").alias("site_id"), "pos", F.array_join("alleles", " ").alias("alleles"))


@query(", n AS (SELECT ind1, ind2, count(*)::DOUBLE AS v FROM seg GROUP BY 1, 2) SELECT a.k AS row, b.k AS col, coalesce(v, 0) AS value FROM range(40) a(k) JOIN range(40) b(k) ON true LEFT JOIN n ON n.ind1 = a.k AND n.ind2 = b.k")
def matrix_triple(spark, d):
    path = scratch(spark, "matrix")
    ids = spark.range(40).select(F.col("id").alias("name"))
    S.write_matrix_triple(C._cells(X.seg(spark, d)), ids, ids, path)
    return R.read_matrix_triple(spark, path)


@query("SELECT l_orderkey, round(l_quantity, 6) AS q, round(l_extendedprice, 6) AS p FROM lineitem")
def number_table(spark, d):
    path = scratch(spark, "numbers")
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    li.write.csv(path, sep="\t")
    v = R.read_matrix(spark, path)
    return v.select(F.col("values")[0].cast("long").alias("l_orderkey"), F.round(F.col("values")[1], 6).alias("q"), F.round(F.col("values")[2], 6).alias("p"))


# ancestry

CALLS = ", w AS (SELECT DISTINCT s FROM la), k AS (SELECT DISTINCT anc FROM la) "


@query(CALLS + "SELECT h.k AS hap, w.s, coalesce(la.anc, '?') AS anc FROM range(40) h(k) JOIN w ON true LEFT JOIN la ON la.hap = h.k AND la.s = w.s")
def ancestry_table(spark, d):
    """Calls written as probabilities: 0.95 for the call; where a haplotype has none, equal ones."""
    path = scratch(spark, "ancestry")
    la = X.la_windows(spark, d)
    kinds = [r.anc for r in la.select("anc").distinct().orderBy("anc").collect()]
    rows = la.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("hap", "anc"))).alias("calls"))
    other = (1 - 0.95) / max(1, len(kinds) - 1)

    def prob(hap: int, anc: str):
        call = F.try_element_at("calls", F.lit(hap).cast("long"))
        return F.when(call.isNull(), F.lit(f"{1 / len(kinds):.6f}")).when(call == anc, F.lit("0.95")).otherwise(F.lit(f"{other:.6f}"))

    window = (F.col("s") / 50_000).cast("long")
    line = F.concat_ws("\t", F.lit("c0"), F.col("s").cast("string"), F.lit("0.0"), (window * 2).cast("string"), *[prob(h, a) for h in range(40) for a in kinds])
    head = ["#reference_panel_population: " + " ".join(kinds), "\t".join(["chromosome", "physical_position", "genetic_position", "genetic_marker_index", *[f"i{h // 2}:::hap{h % 2 + 1}:::{a}" for h in range(40) for a in kinds]])]
    text = spark.createDataFrame([(-2, head[0]), (-1, head[1])], "s long, value string").unionByName(rows.select("s", line.alias("value")))
    text.orderBy("s").select("value").write.text(path)
    positions = rows.select(F.lit(0).alias("chrid"), (window * 2 - 1).alias("idx"), F.col("s").alias("p"))
    return R.read_ancestry(spark, path, positions, R.genome_from_lists(spark, ["c0"], [2_000_000_000]), people(spark))


@query(C.LA + " SELECT CAST(ind1 // 2 AS BIGINT) AS i1, CAST(ind1 % 2 + 1 AS BIGINT) AS h1, CAST(ind2 // 2 AS BIGINT) AS i2, CAST(ind2 % 2 + 1 AS BIGINT) AS h2, greatest(seg.s, a.s, b.s) // 3000000 AS chrid, greatest(seg.s, a.s, b.s) % 3000000 + 1 AS s, least(seg.e, a.e, b.e) - greatest(seg.s, a.s, b.s) AS len, a.anc AS anc1, b.anc AS anc2, count(*) AS n FROM seg JOIN run a ON a.hap = ind1 AND seg.s < a.e AND a.s < seg.e JOIN run b ON b.hap = ind2 AND seg.s < b.e AND b.s < seg.e WHERE greatest(seg.s, a.s, b.s) < least(seg.e, a.e, b.e) GROUP BY ALL")
def asibd_file(spark, d):
    path = scratch(spark, "asibd")
    s = X.seg(spark, d).select(F.col("ind1").alias("hap1"), F.col("ind2").alias("hap2"), "s", "e")
    S.ancestry_tsv(A.ancestry_segments(s, C._runs(spark, d)), X.genome(spark), path)
    t = spark.read.csv(path, sep="\t", header=True)
    long = lambda c: F.col(c).cast("long")
    t = t.select(long("Ind1").alias("i1"), long("Hap1").alias("h1"), long("Ind2").alias("i2"), long("Hap2").alias("h2"), F.substring("Chrom", 2, 9).cast("long").alias("chrid"), long("Start").alias("s"), (long("End") - long("Start")).alias("len"), "anc1", "anc2")
    return t.groupBy(*t.columns).agg(F.count("*").alias("n"))


# results


@query(C.COV.format(step=10000, off=0, n=300, op="<=", w="") + "SELECT p AS \"Start\", p + 10000 AS \"End\", cov AS \"Coverage\" FROM cov")
def coverage_table(spark, d):
    path = scratch(spark, "coverage")
    S.coverage_table(C.coverage(spark, d), C.POINT_STEP, path)
    return spark.read.parquet(path)


@query(C.COV.format(step=10000, off=0, n=300, op="<=", w="") + "SELECT chrom AS \"Chrom\", p - gwstart AS \"Pos\", round((p - gwstart) / 15000.0, 6) AS \"Cm\", p AS \"GwPos\", round(p / 15000.0, 6) AS \"GwCm\", cov AS \"Coverage\" FROM cov JOIN genome USING (chrid)")
def coverage_csv(spark, d):
    path = scratch(spark, "coverage-csv")
    S.coverage_csv(C.coverage(spark, d), X.genome(spark), path)
    t = spark.read.csv(path, header=True, schema="Chrom string, Pos long, Cm double, GwPos long, GwCm double, Coverage long")
    return t.withColumn("Cm", F.round("Cm", 6)).withColumn("GwCm", F.round("GwCm", 6))


@query(C.XIRS + " SELECT chrid, pos, round(raw, 5) AS raw FROM rw")
def xirs_table(spark, d):
    path = scratch(spark, "xirs")
    S.write_parquet(C._raw(spark, d), path)
    return spark.read.parquet(path).select("chrid", "pos", F.round("raw", 5).alias("raw"))


def _over(a: str, b: str) -> str:
    return C.OVER.format(a=a, b=b)


@query("SELECT CASE WHEN x.bin_start < 0 THEN 'genome_wide' ELSE CAST(x.bin_start AS VARCHAR) END AS \"LenBinStart\", x.mean AS \"RateAOverlapByBMean\", x.std AS \"RateAOverlapByBStd\", y.mean AS \"RateBOverlapByAMean\", y.std AS \"RateBOverlapByAStd\" FROM (" + X.SQL + _over("F", "O") + ") x FULL JOIN (" + X.SQL + _over("O", "F") + ") y ON x.bin_start = y.bin_start")
def overlap_csv(spark, d):
    path = scratch(spark, "overlap")
    a, b = C.sides(spark, d)
    S.overlap_csv(C._rates(a, b), C._rates(b, a), path)
    return spark.read.csv(path, header=True, schema="LenBinStart string, RateAOverlapByBMean double, RateAOverlapByBStd double, RateBOverlapByAMean double, RateBOverlapByAStd double")


WINDOWED = """, wc AS (SELECT l_linestatus AS ls, ind1, ind2, chrid, k, greatest(s, chrid * 3000000 + k * 500000) AS s, least(e, chrid * 3000000 + k * 500000 + 500000) AS e FROM seg, range(6) t(k) WHERE s < chrid * 3000000 + k * 500000 + 500000 AND e > chrid * 3000000 + k * 500000),
o AS (SELECT *, max(e) OVER (PARTITION BY ls, ind1, ind2, chrid, k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM wc),
n AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY ls, ind1, ind2, chrid, k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM o),
isl AS (SELECT ls, ind1, ind2, chrid, k, min(s) AS s, max(e) AS e FROM n GROUP BY ls, ind1, ind2, chrid, k, i),
al AS (SELECT ls, 0 AS merged, ind1, ind2, chrid, k, s, e, row_number() OVER () AS rn FROM wc UNION ALL SELECT ls, 1, ind1, ind2, chrid, k, s, e, row_number() OVER () FROM isl),
c AS (SELECT x.ls, x.merged, x.ind1, x.ind2, x.chrid, x.k, x.s, x.e, x.rn, coalesce(sum(CASE WHEN y.s IS NULL THEN 0 ELSE least(x.e, y.e) - greatest(x.s, y.s) END), 0) AS covered FROM al x LEFT JOIN isl y ON y.ls <> x.ls AND y.ind1 = x.ind1 AND y.ind2 = x.ind2 AND y.chrid = x.chrid AND y.k = x.k AND x.s < y.e AND y.s < x.e GROUP BY ALL),
bi AS (SELECT ls, chrid, k, CASE WHEN (e - s) / 15000.0 >= 6 THEN 6.0 WHEN (e - s) / 15000.0 >= 4 THEN 4.0 ELSE 3.0 END::DOUBLE AS bin_start, CAST(covered AS DOUBLE) / (e - s) AS share FROM c WHERE merged = 0 AND (e - s) / 15000.0 >= 3),
g AS (SELECT ls, chrid, k, CAST(sum(covered) AS DOUBLE) / sum(e - s) AS share FROM c WHERE merged = 1 GROUP BY ls, chrid, k, ind1, ind2),
r AS (SELECT ls, chrid, k, bin_start, avg(share) AS mean, stddev_pop(share) AS std, count(*) AS n FROM bi GROUP BY ALL UNION ALL SELECT ls, chrid, k, -1.0::DOUBLE, avg(share), stddev_pop(share), count(*) FROM g GROUP BY ALL),
f AS (SELECT * FROM r WHERE ls = 'F'), h AS (SELECT * FROM r WHERE ls = 'O')
SELECT coalesce(f.chrid, h.chrid) AS chrid, 'c' || coalesce(f.chrid, h.chrid) AS chrom, coalesce(f.k, h.k) AS k, coalesce(f.k, h.k) * 500000 AS start, coalesce(f.k, h.k) * 500000 + 500000 AS "end", coalesce(f.bin_start, h.bin_start) AS bin_start,
  round(f.mean, 6) AS a_by_b_mean, round(f.std, 6) AS a_by_b_std, f.n AS a_by_b_n, round(h.mean, 6) AS b_by_a_mean, round(h.std, 6) AS b_by_a_std, h.n AS b_by_a_n
FROM f FULL JOIN h ON f.chrid = h.chrid AND f.k = h.k AND f.bin_start = h.bin_start"""


@query(WINDOWED)
def windowed_overlap_csv(spark, d):
    """Overlap rates of both directions inside windows, 12 columns."""
    path = scratch(spark, "windows")
    a, b = C.sides(spark, d)
    inside = lambda x: x.where((F.col("e") > F.col("chrid").cast("long") * X.SIZE) & (F.col("s") < (F.col("chrid").cast("long") + 1) * X.SIZE))
    rates = ibd.windowed_rates(inside(a), inside(b), X.genome(spark), 500_000, [3, 4, 6, 10, 18]).where("k between 0 and 5")
    S.windowed_overlap_csv(rates, path)
    t = spark.read.csv(path, header=True, schema="chrid int, chrom string, k long, start long, end long, bin_start double, a_by_b_mean double, a_by_b_std double, a_by_b_n long, b_by_a_mean double, b_by_a_std double, b_by_a_n long")
    for c in ("a_by_b_mean", "a_by_b_std", "b_by_a_mean", "b_by_a_std"):
        t = t.withColumn(c, F.round(c, 6))
    return t


@query(C.ORACLES["overlap_details"][len(X.SQL) :])
def overlap_details_tsv(spark, d):
    path = scratch(spark, "details")
    a, b = C.sides(spark, d)
    S.overlap_details_tsv(ibd.overlap_shares(a, b), path)
    return spark.read.csv(path, sep="\t", header=True, schema="ind1 long, ind2 long, chrid int, s long, e long, covered long")


@query(C.ORACLES["pair_totals_ab"][len(X.SQL) :])
def pair_totals_table(spark, d):
    path = scratch(spark, "totals")
    S.write_parquet(C.pair_totals_ab(spark, d), path)
    return spark.read.parquet(path)


@query("SELECT center AS \"BinCenter\", a_cm AS \"PopTotIbdA\", b_cm AS \"PopTotIbdB\" FROM (" + C.ORACLES["length_spectrum"] + ")")
def population_totals_csv(spark, d):
    path = scratch(spark, "spectrum")
    S.totals_csv(C.length_spectrum(spark, d), path)
    return spark.read.csv(path, header=True, schema="BinCenter double, PopTotIbdA double, PopTotIbdB double")


@query(C.CHROM + "SELECT 'c' || g.chrid AS \"Chrom\", greatest(reg.s, g.gwstart) - g.gwstart AS \"Start\", least(reg.e, g.gwstart + g.size) - g.gwstart AS \"End\" FROM reg JOIN genome g ON reg.s < g.gwstart + g.size AND g.gwstart < reg.e")
def regions_file(spark, d):
    path = scratch(spark, "regions")
    S.regions_tsv(C.chrom_islands(spark, d), X.genome(spark), path)
    return spark.read.csv(path, sep="\t", header=True, schema="Chrom string, Start long, End long")


@query(C.ORACLES["histogram"][len(X.SQL) :])
def histogram_file(spark, d):
    path = scratch(spark, "histogram")
    S.write_csv(C.histogram(spark, d), path, "\t")
    return spark.read.csv(path, sep="\t", header=True, schema="bin_start double, n long")


@query(C.ORACLES["position_scan"][len(X.SQL) :])
def position_scan_file(spark, d):
    path = scratch(spark, "scan")
    S.write_csv(C.position_scan(spark, d), path, "\t")
    return spark.read.csv(path, sep="\t", header=True, schema="pos long, carriers long, within long, between long, outside long")


@query(C.ORACLES["rv_ibd_matched"][len(X.SQL) :])
def matched_rows_table(spark, d):
    path = scratch(spark, "matched")
    S.write_parquet(C.rv_ibd_matched(spark, d), path)
    return spark.read.parquet(path)


@query(C.ORACLES["rv_ibd_similarity"][len(X.SQL) :])
def similarity_file(spark, d):
    path = scratch(spark, "similarity")
    S.write_csv(C.rv_ibd_similarity(spark, d), path, "\t")
    return spark.read.csv(path, sep="\t", header=True, schema="g1 long, g2 long, ibd_prop double, cosine double, jaccard double")


@query("SELECT s1 AS sample_id1, s2 AS sample_id2, discordance FROM (" + C.ORACLES["sample_diff"] + ")")
def sample_diff_table(spark, d):
    path = scratch(spark, "diff")
    S.write_parquet(C.sample_diff(spark, d).toDF("sample_id1", "sample_id2", "discordance"), path)
    return spark.read.parquet(path)


@query("SELECT s_name AS value FROM supplier WHERE s_acctbal >= 0")
def name_list(spark, d):
    """Names of the individuals that stay, as a text of one name a line."""
    path = scratch(spark, "unrelated")
    stay = X.table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("ind"))
    S.unrelated_list(stay, X.inds(spark, d), path)
    return spark.read.text(path)
