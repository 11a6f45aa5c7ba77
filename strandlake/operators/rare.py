"""Analyses of sparse rare-variant records (pos, genome, allele): filters, frequencies, pairwise similarity."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import listed, triangle


def unpack(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """Packed 64-bit records to (pos, genome, allele) and the columns of ``keep``: bits 0-31, 32-55, 56-63; unsigned numbers come as decimals."""
    x = F.col(col)
    if "decimal" in dict(df.dtypes)[col]:
        x = F.when(x >= F.lit(Decimal(1 << 63)), x - F.lit(Decimal(1 << 64))).otherwise(x)
    x = x.cast("long")
    return df.select(x.bitwiseAND((1 << 32) - 1).alias("pos"), F.shiftright(x, 32).bitwiseAND((1 << 24) - 1).alias("genome"), F.shiftrightunsigned(x, 56).alias("allele"), *keep)


def pack(df: DataFrame) -> DataFrame:
    """One unsigned 64-bit number a record, as a decimal, which Parquet readers of unsigned columns give too."""
    x = F.shiftleft(F.col("allele").cast("long"), 56).bitwiseOR(F.shiftleft(F.col("genome").cast("long"), 32)).bitwiseOR(F.col("pos").cast("long"))
    d = x.cast("decimal(20,0)")
    return df.select(F.when(x < 0, d + F.lit(Decimal(1 << 64))).otherwise(d).cast("decimal(20,0)").alias("packed"))


def drop_multiallelic(rec: DataFrame) -> DataFrame:
    """Records of positions with one distinct allele."""
    one = rec.groupBy("pos").agg(F.min("allele").alias("a"), F.max("allele").alias("b")).where("a = b").select("pos")
    return rec.join(one, "pos", "left_semi")


def subset(rec: DataFrame, genomes: DataFrame) -> DataFrame:
    return rec.join(genomes.select("genome").distinct(), "genome", "left_semi")


def share_pair(rec: DataFrame, a: int, b: int) -> DataFrame:
    """(pos, allele of a, allele of b) over the positions of either genome."""
    one = rec.where(F.col("genome") == a).select("pos", F.col("allele").alias("allele_a"))
    two = rec.where(F.col("genome") == b).select("pos", F.col("allele").alias("allele_b"))
    return one.join(two, "pos", "full")


def allele_counts(rec: DataFrame) -> DataFrame:
    return rec.groupBy("pos").agg(F.count("*").alias("n"))


def allele_freq(rec: DataFrame, genomes: int) -> DataFrame:
    return allele_counts(rec).select("pos", (F.col("n") / F.lit(genomes)).alias("freq"))


def pairs_of_lists(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Pairs g1 > g2 of one list of genomes (genome), or of one of each of two lists."""
    ids = lambda d: d.select(F.col("genome").alias("id"))
    return id_pairs(ids(first), ids(first if second is None else second)).toDF("g1", "g2")


def pair_matches(rec: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(g1 > g2, both, eq): positions both carry, and those with equal alleles; one self-join by position, for stated pairs over the records of their genomes."""
    if pairs is not None:
        genomes = pairs.select(F.col("g1").alias("genome")).union(pairs.select("g2")).distinct()
        rec = rec.join(F.broadcast(genomes), "genome", "left_semi")
    a = rec.select("pos", F.col("genome").alias("g1"), F.col("allele").alias("a1"))
    b = rec.select("pos", F.col("genome").alias("g2"), F.col("allele").alias("a2"))
    met = a.join(b, "pos").where("g1 > g2").groupBy("g1", "g2").agg(F.count("*").alias("both"), F.sum((F.col("a1") == F.col("a2")).cast("long")).alias("eq"))
    return met if pairs is None else met.join(pairs.select("g1", "g2"), ["g1", "g2"], "left_semi")


def pair_table(rec: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """All pairs g1 > g2 of genomes that have records, or stated pairs of such, with n1, n2, both and eq (zeros included)."""
    n = rec.groupBy("genome").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("genome").alias("g1"), F.col("n").alias("n1")), n.select(F.col("genome").alias("g2"), F.col("n").alias("n2"))
    sized = a.join(b, F.col("g1") > F.col("g2")) if pairs is None else pairs.select("g1", "g2").join(a, "g1").join(b, "g2")
    return sized.join(pair_matches(rec, pairs), ["g1", "g2"], "left").fillna(0, ["both", "eq"])


def jaccard(rec: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    total = F.col("n1") + F.col("n2") - F.col("both")
    return pair_table(rec, pairs).select("g1", "g2", total.alias("total"), F.col("eq").alias("shared"), F.when(total > 0, F.col("eq") / total).alias("jaccard"))


def cosine(rec: DataFrame, pairs: DataFrame | None = None, least_dot: int | None = None, least_size: int | None = None, least: float | None = None) -> DataFrame:
    """Cosines of pairs; of those with at least ``least_dot`` for the dot product, ``least_size`` records on both sides and a cosine of ``least``, where given."""
    p = pair_table(rec, pairs)
    if least_dot is not None:
        p = p.where(2 * F.col("eq") - F.col("both") >= least_dot)
    if least_size is not None:
        p = p.where(F.least("n1", "n2") >= least_size)
    out = p.select("g1", "g2", ((2 * F.col("eq") - F.col("both")) / F.sqrt(F.col("n1") * F.col("n2"))).alias("cosine"))
    return out if least is None else out.where(F.col("cosine") >= least)


def grm(rec: DataFrame, genomes: int) -> DataFrame:
    """Relationship of haploid genomes coded 0/2: all-reference sum over sites, corrected at carriers."""
    p = allele_freq(rec, genomes).where("freq > 0 and freq < 1")
    q = 1 / (2 * F.col("freq") * (1 - F.col("freq")))
    twice = 2 * F.col("freq")
    t = twice * twice * q
    d1 = -t + (-twice) * (2 - twice) * q
    d2 = -t + (2 - twice) * (2 - twice) * q
    w = p.select("pos", t.alias("t"), d1.alias("d1"), d2.alias("d2"))
    r = rec.join(w, "pos")
    own = r.groupBy("genome").agg(F.sum("d1").alias("d"))
    base = w.agg(F.sum("t").alias("t"), F.count("*").alias("sites"))
    a = r.select("pos", F.col("genome").alias("g1"), F.col("allele").alias("a1"), "d1", "d2")
    b = rec.select("pos", F.col("genome").alias("g2"), F.col("allele").alias("a2"))
    fix = a.join(b, "pos").where("g1 > g2").groupBy("g1", "g2").agg(F.sum(F.when(F.col("a1") == F.col("a2"), F.col("d2") - 2 * F.col("d1")).otherwise(-2 * F.col("d1"))).alias("fix"))
    one, two = own.select(F.col("genome").alias("g1"), F.col("d").alias("s1")), own.select(F.col("genome").alias("g2"), F.col("d").alias("s2"))
    pairs = one.join(two, F.col("g1") > F.col("g2")).join(fix, ["g1", "g2"], "left").join(F.broadcast(base))
    return pairs.select("g1", "g2", ((F.col("t") + F.col("s1") + F.col("s2") + F.coalesce("fix", F.lit(0.0))) / F.col("sites")).alias("rel"))


def sample_discordance(rec: DataFrame) -> DataFrame:
    """Sites at which two samples (genomes 2k and 2k+1) have different dosages, for all pairs s1 > s2."""
    dose = rec.groupBy(F.floor(F.col("genome") / 2).alias("genome"), "pos").agg(F.count("*").alias("allele"))
    return pair_table(dose).select(F.col("g1").alias("s1"), F.col("g2").alias("s2"), (F.col("n1") + F.col("n2") - F.col("both") - F.col("eq")).alias("discordance"))


def opposite_homozygotes(rec: DataFrame) -> DataFrame:
    """Counts of positions where one sample carries on both genomes and the other on none (s1 > s2)."""
    dose = rec.groupBy(F.floor(F.col("genome") / 2).alias("sample"), "pos").agg(F.count("*").alias("dose"))
    two = dose.where("dose = 2")
    n2 = two.groupBy("sample").agg(F.count("*").alias("n"))
    met = two.select(F.col("sample").alias("x"), "pos").join(dose.select(F.col("sample").alias("y"), "pos"), "pos").where("x <> y").groupBy("x", "y").agg(F.count("*").alias("m"))
    ids = dose.select("sample").distinct()
    side = lambda x, y: ids.select(F.col("sample").alias(x))
    pairs = side("s1", None).join(side("s2", None), F.col("s1") > F.col("s2"))
    m1, m2 = met.select(F.col("x").alias("s1"), F.col("y").alias("s2"), F.col("m").alias("m1")), met.select(F.col("x").alias("s2"), F.col("y").alias("s1"), F.col("m").alias("m2"))
    c1, c2 = n2.select(F.col("sample").alias("s1"), F.col("n").alias("c1")), n2.select(F.col("sample").alias("s2"), F.col("n").alias("c2"))
    j = pairs.join(m1, ["s1", "s2"], "left").join(m2, ["s1", "s2"], "left").join(c1, "s1", "left").join(c2, "s2", "left").fillna(0)
    return j.select("s1", "s2", (F.col("c1") - F.col("m1") + F.col("c2") - F.col("m2")).alias("discordance"))


def matrix_rows(rec: DataFrame) -> DataFrame:
    """Each position's carriers as an ordered list of genomes."""
    return rec.groupBy("pos").agg(F.array_join(F.array_sort(F.collect_list("genome")), ",").alias("carriers"))


def id_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of two id lists (id): all a > b of ids in both, and the cross of ids of one alone with ids of the other list."""
    met = triangle(listed(first, second)).where("in_a_x and in_b_y or in_b_x and in_a_y")
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"))
