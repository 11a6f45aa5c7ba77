"""Interval algebra on half-open intervals (s, e): islands, complement, joins, coverage, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.fixtures import BP_PER_CM  # noqa: F401


def islands(df: DataFrame, keys: list[str], mode: str = "corrected") -> DataFrame:
    """Union of the intervals of each key; touching ones merge.

    ``corrected`` ends an island at its largest end; ``reference`` at the end of its last interval, and compares with the
    interval before alone.
    """
    order = W.partitionBy(*keys).orderBy("s", "e")
    if mode == "reference":
        before = F.lag("e").over(order)
    else:
        before = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.select(*keys, "s", "e").withColumn("_new", (before.isNull() | (F.col("s") > before)).cast("int"))
    end = F.max("e")
    if mode == "reference":  # the end of the row before the next island, or of the last row; a number, so that sums are hashed, not sorted again
        nxt = F.lead("_new").over(order)
        marked, end = marked.withColumn("_end", F.when(F.coalesce(nxt, F.lit(1)) == 1, F.col("e"))), F.max("_end")
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("s").alias("s"), end.alias("e")).drop("_island")


def complement(df: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps of each key's islands within its bounds (keys, lo, hi); keys without intervals give their bounds."""
    isl = islands(df, keys)
    stops = isl.unionByName(bounds.select(*keys, F.col("hi").alias("s"), F.col("hi").alias("e")))
    order = W.partitionBy(*keys).orderBy("s", "e")
    gaps = stops.withColumn("_from", F.lag("e").over(order)).join(F.broadcast(bounds), keys)
    return gaps.select(*keys, F.coalesce("_from", "lo").alias("_s"), F.col("s").alias("e")).withColumnRenamed("_s", "s").where("s < e")


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], width: int = 100_000, small: bool = False) -> DataFrame:
    """Overlapping pairs of two frames (keys, s, e, ...); b's columns but the keys get the suffix ``_b``.

    Both sides are dealt to bins of ``width`` bp, so the join has an equality even without keys; a pair is kept in
    the first bin that both reach.
    """
    bins = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))
    left = a.where("s < e").withColumn("_bin", bins)
    right = b.where("s < e").withColumn("_bin", bins)
    right = right.select(*keys, "_bin", *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    both = left.join(F.broadcast(right) if small else right, [*keys, "_bin"])
    return both.where((F.col("s") < F.col("e_b")) & (F.col("s_b") < F.col("e")) & (F.floor(F.greatest("s", "s_b") / width) == F.col("_bin"))).drop("_bin")


def reached(segs: DataFrame, width: int) -> DataFrame:
    """(_bin) of the bins of ``width`` bp that any interval reaches, each once: a dimension, of the genome's length over ``width`` rows."""
    return segs.where("s < e").select(F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))).alias("_bin")).distinct()


def clip(joined: DataFrame) -> DataFrame:
    """Each pair of an interval join cut to what both share."""
    return joined.withColumn("s", F.greatest("s", "s_b")).withColumn("e", F.least("e", "e_b")).drop("s_b", "e_b")


def sweep_coverage(points: DataFrame, segs: DataFrame, keys: list[str], weight=None, closed: bool = False, width: int = 100_000) -> DataFrame:
    """Points (keys, p, ...) with ``cov``, the weight of segments with s <= p < e (closed: p <= e).

    Starts and ends become signed steps, summed by place; running sums are taken inside bins, on top of a running sum of
    whole bins, so no task holds more than a bin of places.
    """
    w = F.lit(1) if weight is None else weight
    end = F.col("e") + 1 if closed else F.col("e")
    steps = segs.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("p"), w.alias("w")), F.struct(end.alias("p"), (-w).alias("w")))).alias("x")).select(*keys, "x.p", "x.w")
    steps = steps.groupBy(*keys, "p").agg(F.sum("w").alias("w"))
    cell = F.floor(F.col("p") / width)
    totals = steps.groupBy(*keys, cell.alias("_cell")).agg(F.sum("w").alias("w"))
    asked = points.groupBy(*keys, cell.alias("_cell")).agg(F.lit(None).cast("double").alias("_"))
    run = totals.join(asked.drop("_"), [*keys, "_cell"], "full").withColumn("_base", F.coalesce(F.sum("w").over(W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("w")
    rest = [c for c in points.columns if c not in (*keys, "p")]
    tagged = points.withColumn("_cell", cell).withColumn("w", F.lit(None)).withColumn("_point", F.lit(True))
    events = tagged.unionByName(steps.withColumn("_cell", cell).withColumn("_point", F.lit(False)), allowMissingColumns=True)
    inside = F.coalesce(F.sum("w").over(W.partitionBy(*keys, "_cell").orderBy("p").rangeBetween(W.unboundedPreceding, 0)), F.lit(0))
    got = events.withColumn("_inside", inside).where("_point")
    return got.join(run, [*keys, "_cell"]).select(*keys, "p", *rest, (F.col("_base") + F.col("_inside")).alias("cov"))


def endpoints(segs: DataFrame) -> DataFrame:
    """(p) of the distinct starts and ends."""
    return segs.select(F.col("s").alias("p")).union(segs.select("e")).distinct()


def coverage_stats(cov: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median of ``cov`` for each key."""
    return cov.groupBy(*keys).agg(F.avg("cov").alias("mean"), F.expr("percentile(cov, 0.5)").alias("median"))


def grid(genome: DataFrame, step: int, offset: int = 0) -> DataFrame:
    """Points every ``step`` bp of each chromosome, genome-wide."""
    return genome.select("chrid", F.explode(F.sequence(F.col("gwstart") + offset, F.col("gwstart") + F.col("size") - 1, F.lit(step).cast("long"))).alias("p"))


def genome_windows(genome: DataFrame, size: int, closed: bool = False) -> DataFrame:
    """Windows (chrid, s, e) of ``size`` bp in chromosome coordinates; closed: the next starts after the end."""
    step = size + 1 if closed else size
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long")))
    return genome.select("chrid", "size", start.alias("s")).withColumn("e", F.least(F.col("s") + size, F.col("size"))).drop("size")


def split_chromosomes(genome: DataFrame, cuts: DataFrame) -> DataFrame:
    """Contigs between the cut points (chrid, p) of each chromosome, named chrom_start."""
    ends = genome.select("chrid", F.explode(F.array(F.lit(0).cast("long"), F.col("size"))).alias("p")).union(cuts.select("chrid", F.col("p").cast("long"))).distinct()
    nxt = F.lead("p").over(W.partitionBy("chrid").orderBy("p"))
    return ends.withColumn("e", nxt).where("e is not null").join(F.broadcast(genome.select("chrid", "chrom")), "chrid").select("chrid", F.col("p").alias("s"), "e", F.concat_ws("_", "chrom", F.col("p").cast("string")).alias("name"))


def histogram(df: DataFrame, value: str, starts: list[float]) -> DataFrame:
    """Counts by the last start at or below a value; smaller values are ignored, the last bin is open."""
    bin_ = F.lit(None).cast("double")
    for s in sorted(starts):
        bin_ = F.when(F.col(value) >= s, F.lit(float(s))).otherwise(bin_)
    return df.withColumn("bin_start", bin_).where("bin_start is not null").groupBy("bin_start").agg(F.count("*").alias("n"))


def trimmed(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Rows of each key without the ``share`` lowest and highest, by the rank of the value."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(value, "p"))
    n = F.count("*").over(W.partitionBy(*keys))
    cut = F.floor(n * share)
    return df.withColumn("_r", r).withColumn("_n", n).withColumn("_cut", cut).where("_r > _cut and _r <= _n - _cut").drop("_r", "_n", "_cut")


def runs_of_points(df: DataFrame, keys: list[str], hit: str, step: int) -> DataFrame:
    """Regions (keys, s, e) of neighbouring points p where ``hit`` holds; a region ends at the point after its last."""
    order = W.partitionBy(*keys).orderBy("p")
    g = df.withColumn("_k", F.row_number().over(order)).where(hit).withColumn("_run", F.col("_k") - F.row_number().over(order))
    return g.groupBy(*keys, "_run").agg(F.min("p").alias("s"), (F.max("p") + step).alias("e")).drop("_run")
