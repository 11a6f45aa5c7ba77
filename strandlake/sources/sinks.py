"""Writers of results; each takes a DataFrame and a path of any store."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coords


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def write_packed_records(rec: DataFrame, path: str, status: str = "0") -> None:
    from ..operators.rare import pack

    pack(rec).withColumnRenamed("packed", status).write.mode("overwrite").parquet(path)


def write_bool_matrix(cells: DataFrame, n_rows: int, n_cols: int, path: str) -> None:
    """True cells (row, col) as one boolean column, row after row, whose name is the number of columns.

    Cells become bits of words of 64 columns, so the work is that of the cells and of the words written.
    """
    words = -(-n_cols // 64)
    col = F.col("col").cast("long")
    held = cells.where((col >= 0) & (col < n_cols)).groupBy((F.col("row").cast("long") * words + F.floor(col / 64)).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(col % 64 AS INT))")).alias("bits"))
    dense = cells.sparkSession.range(n_rows * words).join(held, "id", "left").repartitionByRange("id").sortWithinPartitions("id")
    last = F.least(F.lit(63).cast("long"), n_cols - 1 - F.col("id") % words * 64).cast("int")
    bits = F.coalesce("bits", F.lit(0).cast("long"))
    dense.select(F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.getbit(bits, k) == 1)).alias(str(n_cols))).write.mode("overwrite").parquet(path)


def write_matrix_triple(cells: DataFrame, rows: DataFrame, cols: DataFrame, path: str, metric: str = "jaccard") -> None:
    """A matrix (row, col, value) as three tables: values row after row (absent cells 0), names (name) of rows and of columns in their order."""
    rows.orderBy("name").coalesce(1).write.mode("overwrite").parquet(f"{path}.row")
    cols.orderBy("name").coalesce(1).write.mode("overwrite").parquet(f"{path}.col")
    names = cols.agg(F.array_sort(F.collect_list("name")).alias("_names"))
    by_row = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("value").cast("double")))).alias("_cells"))
    dense = rows.select(F.col("name").alias("row")).join(by_row, "row", "left").join(F.broadcast(names)).repartitionByRange("row").sortWithinPartitions("row")
    dense.select(F.explode(F.transform("_names", lambda c: F.coalesce(F.try_element_at("_cells", c), F.lit(0.0)))).alias(metric)).write.mode("overwrite").parquet(path)


def write_genome_text(genome: DataFrame, gmap: DataFrame, path: str, name: str = "genome") -> None:
    """A genome description with a PLINK map a chromosome beside it; a dimension of a row a chromosome and knot."""
    from .scratch import write_bytes

    spark = genome.sparkSession
    folder, chroms = path.rsplit("/", 1)[0], genome.orderBy("chrid").collect()
    quoted = lambda xs: ", ".join(f'"{x}"' for x in xs)
    text = f'name = "{name}"\nchromsize = [{", ".join(str(r["size"]) for r in chroms)}]\nchromnames = [{quoted(r.chrom for r in chroms)}]\ngmaps = [{quoted(f"{r.chrom}.map" for r in chroms)}]\n[idx]\n' + "".join(f"{r.chrom} = {r.chrid}\n" for r in chroms)
    write_bytes(spark, path, text.encode())
    g = F.broadcast(genome.select("chrom", "gwstart", (F.col("gwstart") + F.col("size")).alias("_end")))
    own = gmap.join(g, (F.col("x1") >= F.col("gwstart")) & (F.col("x1") < F.col("_end")))
    base = own.groupBy("chrom").agg(F.min("y1").alias("_base"))
    rate = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    last = F.least(F.col("x2"), F.col("_end") - 1)
    knots = own.join(base, "chrom").select("chrom", (last - F.col("gwstart")).alias("bp"), (F.col("y1") + (last - F.col("x1")) * rate - F.col("_base")).alias("cm"))
    lines = knots.orderBy("chrom", "bp").collect()
    for r in chroms:
        write_bytes(spark, f"{folder}/{r.chrom}.map", "".join(f"{k.chrom} . {k.cm!r} {k.bp + 1}\n" for k in lines if k.chrom == r.chrom).encode())


def write_genome_tables(genome: DataFrame, gmap: DataFrame, path: str) -> None:
    genome.write.mode("overwrite").parquet(f"{path}/genome")
    gmap.write.mode("overwrite").parquet(f"{path}/gmap")


def write_sites(sites: DataFrame, path: str) -> None:
    sites.select(F.col("pos").alias("gw_pos"), F.array_join("alleles", " ").cast("binary").alias("alleles")).write.mode("overwrite").parquet(path)


def write_names(inds: DataFrame, path: str) -> None:
    inds.orderBy("ind").select(F.col("name").alias("chrnames")).coalesce(1).write.mode("overwrite").parquet(path)


def write_named_matrix(df: DataFrame, path: str) -> None:
    df.select("row", "col", "value").write.mode("overwrite").parquet(path)


def pivot_matrix(df: DataFrame) -> DataFrame:
    """The dense form of (row, col, value), for export of matrices of a few thousand columns."""
    return df.groupBy("row").pivot("col").agg(F.first("value")).orderBy("row")


def mirrored(df: DataFrame) -> DataFrame:
    """Both halves of a symmetric matrix (row, col, value) of which one half is there."""
    return df.unionByName(df.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


def coverage_csv(cov: DataFrame, genome: DataFrame, path: str, bp_per_cm: float = 15_000.0) -> None:
    c = coords.gw_to_chrom(cov.withColumnRenamed("p", "gwpos").drop("chrid"), genome)
    cm = lambda x: F.col(x) / bp_per_cm
    write_csv(c.select(F.col("chrom").alias("Chrom"), F.col("pos").alias("Pos"), cm("pos").alias("Cm"), F.col("gwpos").alias("GwPos"), cm("gwpos").alias("GwCm"), F.col("cov").alias("Coverage")), path)


def overlap_csv(a_by_b: DataFrame, b_by_a: DataFrame, path: str) -> None:
    """A row a length bin and one for the whole genome (-1)."""
    one = a_by_b.select("bin_start", F.col("mean").alias("RateAOverlapByBMean"), F.col("std").alias("RateAOverlapByBStd"))
    two = b_by_a.select("bin_start", F.col("mean").alias("RateBOverlapByAMean"), F.col("std").alias("RateBOverlapByAStd"))
    name = F.when(F.col("bin_start") < 0, F.lit("genome_wide")).otherwise(F.col("bin_start").cast("string"))
    write_csv(one.join(two, "bin_start", "full").orderBy("bin_start").select(name.alias("LenBinStart"), "RateAOverlapByBMean", "RateAOverlapByBStd", "RateBOverlapByAMean", "RateBOverlapByAStd"), path)


def regions_tsv(regions: DataFrame, genome: DataFrame, path: str) -> None:
    """Genome-wide regions (s, e), cut at chromosome ends, in chromosome coordinates."""
    g = F.broadcast(genome.select("chrom", "gwstart", (F.col("gwstart") + F.col("size")).alias("gwend")))
    j = regions.join(g, (F.col("s") < F.col("gwend")) & (F.col("gwstart") < F.col("e")))
    write_csv(j.select(F.col("chrom").alias("Chrom"), (F.greatest("s", "gwstart") - F.col("gwstart")).alias("Start"), (F.least("e", "gwend") - F.col("gwstart")).alias("End")), path, "\t")


def hapibd_csv(segs: DataFrame, inds: DataFrame, genome: DataFrame, path: str, bp_per_cm: float = 15_000.0) -> None:
    """The tab form of segments: names, haplotypes 1, 2 or 0 (merged), 1-based positions."""
    one, two = inds.select(F.col("ind").alias("ind1"), F.col("name").alias("n1")), inds.select(F.col("ind").alias("ind2"), F.col("name").alias("n2"))
    code = lambda c: F.when(F.col(c) == 2, 0).otherwise(F.col(c) + 1)
    g = F.broadcast(genome.select("chrid", "chrom", "gwstart"))
    j = segs.join(F.broadcast(one), "ind1").join(F.broadcast(two), "ind2").join(g, "chrid")
    write_csv(j.select("n1", code("hap1").alias("h1"), "n2", code("hap2").alias("h2"), "chrom", (F.col("s") - F.col("gwstart") + 1).alias("s1"), (F.col("e") - F.col("gwstart") + 1).alias("e1"), ((F.col("e") - F.col("s")) / bp_per_cm).alias("cm")), path, "\t", False)


def ancestry_tsv(segs: DataFrame, genome: DataFrame, path: str) -> None:
    """Ancestry-specific segments with 1-based positions and haplotypes counted from 1 (hap = 2 * individual + side)."""
    j = coords.gw_to_chrom(segs.withColumn("gwpos", F.col("s")), genome)
    write_csv(j.select(F.floor(F.col("hap1") / 2).alias("Ind1"), (F.col("hap1") % 2 + 1).alias("Hap1"), F.floor(F.col("hap2") / 2).alias("Ind2"), (F.col("hap2") % 2 + 1).alias("Hap2"), F.col("chrom").alias("Chrom"), (F.col("pos") + 1).alias("Start"), (F.col("pos") + 1 + F.col("e") - F.col("s")).alias("End"), "anc1", "anc2"), path, "\t")


#: Segments that one binary file may have: it is read as one row.
EIBD_MOST = 4_000_000


def eibd_bytes(segs: DataFrame, most: int = EIBD_MOST) -> bytes:
    """The binary form of a segment set small enough for one file; larger sets are refused here and are written as several files."""
    n = segs.count()
    if n > most:
        raise ValueError(f"{n} segments are too many for one file of at most {most}")
    rows = _eibd_columns(segs).orderBy("i", "j", "s", "e").toArrow()
    return _eibd_file([np.asarray(rows.column(c)) for c in "ijse"])


def _eibd_columns(segs: DataFrame) -> DataFrame:
    return segs.select((F.col("ind1") * 4 + F.col("hap1")).alias("i"), (F.col("ind2") * 4 + F.col("hap2")).alias("j"), "s", "e")


def _eibd_file(columns: list[np.ndarray]) -> bytes:
    return struct.pack("<Q", len(columns[0])) + np.stack([c.astype("<u4") for c in columns], axis=1).tobytes()


def write_eibd(segs: DataFrame, path: str, most: int = EIBD_MOST, each: int = 1_000_000) -> None:
    """A segment set in binary form: one file, or for more than ``most`` segments a folder of whole files of ``each`` at most, whose names give the order.

    Files are put together by tasks, of a range of the sorted segments each.
    """
    from .scratch import write_byte_files, write_bytes

    n = segs.count()
    if n <= most:
        return write_bytes(segs.sparkSession, path, eibd_bytes(segs, most))
    # ranges of about half a file; the last column parts segments that are equal
    ranges = _eibd_columns(segs).withColumn("_", F.monotonically_increasing_id()).repartitionByRange(-(-2 * n // each), "i", "j", "s", "e", "_").drop("_").sortWithinPartitions("i", "j", "s", "e")

    def files(batches):
        held, rows = [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_eibd_file([np.concatenate(c) for c in zip(*held, strict=True)])], pa.binary())], names=["content"])

        for batch in batches:
            columns = [batch.column(c).to_numpy().astype("<u4") for c in "ijse"]
            for at in range(0, batch.num_rows, each):
                part = [c[at : at + each] for c in columns]
                if held and rows + len(part[0]) > each:
                    yield file()
                    held, rows = [], 0
                held.append(part)
                rows += len(part[0])
        if held:
            yield file()

    write_byte_files(ranges.mapInArrow(files, "content binary"), path, ".eibd")


def coverage_table(cov: DataFrame, step: int, path: str) -> None:
    """(Start, End, Coverage) of points of a grid."""
    write_parquet(cov.select(F.col("p").alias("Start"), (F.col("p") + step).alias("End"), F.col("cov").alias("Coverage")), path)


def totals_csv(spectrum: DataFrame, path: str) -> None:
    write_csv(spectrum.select(F.col("center").alias("BinCenter"), F.col("a_cm").alias("PopTotIbdA"), F.col("b_cm").alias("PopTotIbdB")), path)


def windowed_overlap_csv(rates: DataFrame, path: str) -> None:
    """A row a window, length bin: rates of both directions (``ibd.windowed_rates`` of both, joined)."""
    write_csv(rates, path)


def overlap_details_tsv(shares: DataFrame, path: str) -> None:
    """Each segment with the bp of it that the other set covers."""
    write_csv(shares.select("ind1", "ind2", "chrid", "s", "e", "covered"), path, "\t")


def unrelated_list(ids: DataFrame, inds: DataFrame, path: str) -> None:
    """Names of ids (ind) that are left."""
    inds.join(ids, "ind", "left_semi").select(F.col("name").alias("value")).write.mode("overwrite").text(path)


def vcf_lines(rec: DataFrame, sites: DataFrame, genome: DataFrame, samples: list[str]) -> DataFrame:
    """(chrid, pos, value) of VCF lines of records; haplotypes without a record carry the site's one common allele (0, or the least allele that no record has)."""
    n = 2 * len(samples)
    r = rec.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("genome", "allele"))).alias("calls"), F.collect_set("allele").alias("rare"))
    j = coords.gw_to_chrom(sites.join(r, "pos", "left").withColumnRenamed("pos", "gwpos"), genome)
    numbers = F.sequence(F.lit(0).cast("long"), F.size("alleles").cast("long") - 1)
    common = F.coalesce(F.array_min(F.array_except(numbers, F.coalesce("rare", F.array().cast("array<bigint>")))), F.lit(0).cast("long"))
    one = lambda k: F.coalesce(F.try_element_at("calls", k), F.col("common")).cast("string")
    j = j.withColumn("common", common)
    calls = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 2).cast("long"), F.lit(2).cast("long")), lambda k: F.concat(one(k), F.lit("|"), one(k + 1)))
    line = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), F.col("alleles")[0], F.array_join(F.slice("alleles", 2, 1 << 30), ","), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), F.array_join(calls, "\t"))
    return j.select("chrid", "pos", line.alias("value"))


def write_vcf(rec: DataFrame, sites: DataFrame, genome: DataFrame, samples: list[str], path: str) -> None:
    spark = rec.sparkSession
    head = ["##fileformat=VCFv4.2", *[f"##contig=<ID={r.chrom},length={r.size}>" for r in genome.orderBy("chrid").collect()], '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples)]
    first = spark.createDataFrame([(-1, k, h) for k, h in enumerate(head)], "chrid int, pos long, value string")
    first.unionByName(vcf_lines(rec, sites, genome, samples)).orderBy("chrid", "pos").select("value").write.mode("overwrite").text(path)
