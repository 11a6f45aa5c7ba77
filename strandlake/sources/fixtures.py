"""Domain views over plain tables: genome, genetic map, segments, rare-variant records, individuals, ancestry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHROMS, SIZE, BP_PER_CM = 7, 3_000_000, 15_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genome(spark: SparkSession) -> DataFrame:
    """(chrid, chrom, size, gwstart) of seven chromosomes."""
    k = F.col("id")
    return spark.range(CHROMS).select(k.cast("int").alias("chrid"), F.concat(F.lit("c"), k.cast("string")).alias("chrom"), F.lit(SIZE).cast("long").alias("size"), (k * SIZE).alias("gwstart"))


def gmap(spark: SparkSession) -> DataFrame:
    """Knots (x1, x2, y1, y2): on each chromosome 100 cM on the first half, 50 on the second."""
    k, half = F.floor(F.col("id") / 2), F.col("id") % 2
    x1 = k * SIZE + half * (SIZE // 2)
    y1 = (k * 150 + half * 100).cast("double")
    return spark.range(2 * CHROMS).select(x1.cast("long").alias("x1"), (x1 + SIZE // 2).cast("long").alias("x2"), y1.alias("y1"), (y1 + F.when(half == 0, 100.0).otherwise(50.0)).alias("y2"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared segments (ind1 > ind2, hap1, hap2, chrid, s, e, l_linestatus), half open in genome-wide bp."""
    li = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    ha, hb = F.floor(F.col("l_suppkey") / 40) % 2, F.floor(F.col("l_partkey") / 40) % 2
    chrid = (F.col("l_linenumber") % CHROMS).cast("int")
    s = chrid.cast("long") * SIZE + F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long") * 1000
    return li.where(a != b).select(
        F.greatest(a, b).alias("ind1"), F.least(a, b).alias("ind2"), F.when(a > b, ha).otherwise(hb).alias("hap1"), F.when(a > b, hb).otherwise(ha).alias("hap2"),
        chrid.alias("chrid"), s.alias("s"), (s + F.col("l_quantity").cast("long") * 2000).alias("e"), "l_linestatus",
    )


def rec(spark: SparkSession, sf_dir: str, line: int | None = None) -> DataFrame:
    """Rare-variant records (pos, genome, allele) of all line items, or of those of one line number."""
    li = table(spark, sf_dir, "lineitem")
    li = li if line is None else li.where(F.col("l_linenumber") == line)
    g = li.groupBy(F.col("l_partkey").alias("pos"), (F.col("l_suppkey") % 50).alias("genome")).agg(F.min("l_quantity").alias("q"))
    return g.select("pos", "genome", (1 + F.col("q").cast("long") % 2).alias("allele"))


def inds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ind"), F.col("s_name").alias("name"))


def la_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestry calls (hap, s, anc) in windows that begin at s, from events."""
    ev = table(spark, sf_dir, "events")
    hap = F.col("user_id") % 40
    k = F.row_number().over(W.partitionBy(hap).orderBy("ts", "event_id"))
    return ev.select(hap.alias("hap"), ((k - 1).cast("long") * 50_000).alias("s"), F.col("event_type").alias("anc"))


#: The same views in DuckDB SQL.
SQL = """WITH genome AS (SELECT CAST(k AS INTEGER) AS chrid, 'c' || k AS chrom, CAST(3000000 AS BIGINT) AS size, k * 3000000 AS gwstart FROM range(7) t(k)),
gmap AS (SELECT (k // 2) * 3000000 + (k % 2) * 1500000 AS x1, (k // 2) * 3000000 + (k % 2) * 1500000 + 1500000 AS x2,
  CAST((k // 2) * 150 + (k % 2) * 100 AS DOUBLE) AS y1, CAST((k // 2) * 150 + (k % 2) * 100 + CASE WHEN k % 2 = 0 THEN 100 ELSE 50 END AS DOUBLE) AS y2 FROM range(14) t(k)),
seg0 AS (SELECT l_suppkey % 40 AS a, l_partkey % 40 AS b, l_suppkey // 40 % 2 AS ha, l_partkey // 40 % 2 AS hb, CAST(l_linenumber % 7 AS INTEGER) AS chrid,
  CAST(l_linenumber % 7 AS BIGINT) * 3000000 + date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) * 1000 AS s, CAST(l_quantity AS BIGINT) * 2000 AS len, l_linestatus FROM lineitem),
seg AS (SELECT greatest(a, b) AS ind1, least(a, b) AS ind2, CASE WHEN a > b THEN ha ELSE hb END AS hap1, CASE WHEN a > b THEN hb ELSE ha END AS hap2, chrid, s, s + len AS e, l_linestatus FROM seg0 WHERE a <> b),
rec AS (SELECT l_partkey AS pos, l_suppkey % 50 AS genome, 1 + CAST(min(l_quantity) AS BIGINT) % 2 AS allele FROM lineitem GROUP BY 1, 2),
la AS (SELECT user_id % 40 AS hap, (row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) - 1) * 50000 AS s, event_type AS anc FROM events)
"""
