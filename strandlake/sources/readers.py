"""Readers of the domain's text and binary formats as DataFrames.

Dimensions (genome, individuals) are small frames of a row a chromosome or
sample and are broadcast; data files are read by Spark's own sources, so paths
may be of any store.
"""

from __future__ import annotations

import tomllib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coords
from ..operators.ibd import BP_PER_CM, normalize
from ..operators.matrix import numbered

# dimensions


def genome_from_lists(spark: SparkSession, names: list[str], sizes: list[int]) -> DataFrame:
    if len(names) != len(sizes):
        raise ValueError("as many sizes as names are needed")
    start, rows = 0, []
    for k, (n, s) in enumerate(zip(names, sizes, strict=True)):
        rows.append((k, n, int(s), start))
        start += int(s)
    return spark.createDataFrame(rows, "chrid int, chrom string, size long, gwstart long")


def read_genome_toml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(genome, aliases (alias, chrid), map files) of a genome description; every name must be in its index."""
    text = spark.read.text(path, wholetext=True).first().value
    t = tomllib.loads(text)
    names, sizes, idx = t["chromnames"], t["chromsize"], t["idx"]
    if missing := [n for n in names if n not in idx]:
        raise ValueError(f"names without index: {missing}")
    return genome_from_lists(spark, names, sizes), aliases(spark, idx), list(t.get("gmaps", []))


def aliases(spark: SparkSession, idx: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in idx.items()], "alias string, chrid int")


def named_genome(spark: SparkSession, name: str) -> DataFrame:
    """Built-in constant-rate genomes of 14 chromosomes."""
    # Fixed chromosome sizes.
    pf3d7 = [640851, 947102, 1067971, 1200490, 1343557, 1418242, 1445207, 1472805, 1541735, 1687656, 2038340, 2271494, 2925236, 3291936]
    if name == "pf3d7_const15k":
        return genome_from_lists(spark, [f"Pf3D7_{k + 1:02d}_v3" for k in range(14)], pf3d7)
    if name == "sim14chr100cm_const15k":
        return genome_from_lists(spark, [str(k + 1) for k in range(14)], [1_500_000] * 14)
    raise ValueError(f"no genome of that name: {name}")


def constant_map(genome: DataFrame, bp_per_cm: float = BP_PER_CM) -> DataFrame:
    """Knots (x1, x2, y1, y2) of a constant rate, chromosome after chromosome."""
    c = F.col("size") / F.lit(bp_per_cm)
    before = W.orderBy("chrid").rowsBetween(W.unboundedPreceding, -1)
    return genome.withColumn("y1", F.coalesce(F.sum(c).over(before), F.lit(0.0))).select(F.col("gwstart").alias("x1"), (F.col("gwstart") + F.col("size")).alias("x2"), "y1", (F.col("y1") + c).alias("y2"))


def read_plink_map(spark: SparkSession, path: str, genome: DataFrame, chrom: str) -> DataFrame:
    """Knots of one chromosome's map (chrom id cM bp, 1-based), from (0, 0) to the end at the mean rate, in chromosome bp."""
    size = genome.where(F.col("chrom") == chrom).select(F.max("size").alias("size"))
    raw = spark.read.csv(path, sep=" ", schema="chrom string, id string, cm double, bp long").where("bp > 1").select((F.col("bp") - 1).alias("bp"), "cm")
    last = raw.agg(F.max(F.struct("bp", "cm")).alias("m")).crossJoin(size)
    end = last.where("m.bp < size - 1").select((F.col("size") - 1).alias("bp"), (F.col("m.cm") * (F.col("size") - 1) / F.col("m.bp")).alias("cm"))
    knots = spark.createDataFrame([(0, 0.0)], "bp long, cm double").unionByName(raw).unionByName(end)
    order = W.orderBy("bp")
    return knots.select(F.col("bp").alias("x1"), F.lead("bp").over(order).alias("x2"), F.col("cm").alias("y1"), F.lead("cm").over(order).alias("y2")).where("x2 is not null")


def genome_wide_map(maps: list[DataFrame], genome: DataFrame) -> DataFrame:
    """One map over all chromosomes from theirs, in the order of the genome: positions and cM go on from the one before."""
    rows = genome.orderBy("chrid").collect()
    out, cm = None, 0.0
    for r, m in zip(rows, maps, strict=True):
        total = m.agg(F.max("y2").alias("y")).first().y
        part = m.select((F.col("x1") + r.gwstart).alias("x1"), (F.col("x2") + r.gwstart).alias("x2"), (F.col("y1") + cm).alias("y1"), (F.col("y2") + cm).alias("y2"))
        out = part if out is None else out.unionByName(part)
        cm += total
    return out


def read_individuals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, str | None]:
    """(individuals (ind, name), ploidy (hap, dip, which) or None, direction) of a list of 1, 2 (haploid, diploid) or 3 (diploid, both haploids) columns."""
    lines = [x.value.split() for x in spark.read.text(path).collect() if x.value.strip()]
    if not lines:
        raise ValueError("an empty sample list")
    width = {len(x) for x in lines}
    if len(width) != 1 or not width <= {1, 2, 3}:
        raise ValueError("lines of 1, 2 or 3 names are needed")
    number = lambda names: {n: k for k, n in enumerate(dict.fromkeys(names))}
    inds = lambda d: spark.createDataFrame([(k, n) for n, k in d.items()], "ind long, name string")
    kind = width.pop()
    if kind == 1:
        return inds(number(x[0] for x in lines)), None, None
    if kind == 2:
        hap, dip = number(x[0] for x in lines), number(x[1] for x in lines)
        seen: dict[str, int] = {}
        rows = []
        for h, d in lines:
            rows.append((hap[h], dip[d], seen.get(d, 0)))
            seen[d] = seen.get(d, 0) + 1
        return inds(hap), spark.createDataFrame(rows, "hap long, dip long, which int"), "haploid"
    dip, hap = number(x[0] for x in lines), number(n for x in lines for n in x[1:])
    return inds(dip), spark.createDataFrame([(hap[x[k + 1]], dip[x[0]], k) for x in lines for k in (0, 1)], "hap long, dip long, which int"), "diploid"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").cast("long").alias("id")).orderBy("id")


# genome files and map constructors


def map_from_knots(spark: SparkSession, knots: list[tuple[int, float]]) -> DataFrame:
    """A map (x1, x2, y1, y2) from (bp, cM) knots in order."""
    if any(b[0] <= a[0] or b[1] < a[1] for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("knots must increase")
    return spark.createDataFrame([(int(a[0]), int(b[0]), float(a[1]), float(b[1])) for a, b in zip(knots, knots[1:], strict=False)], "x1 long, x2 long, y1 double, y2 double")


def map_from_lists(spark: SparkSession, chromosomes: list[list[tuple[int, float]]], genome: DataFrame) -> DataFrame:
    """A genome-wide map from a list of (bp, cM) knots for each chromosome."""
    return genome_wide_map([map_from_knots(spark, k) for k in chromosomes], genome)


def read_genome_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(genome, genome-wide map) of a description and the PLINK maps that it names, relative to its folder."""
    genome, _, maps = read_genome_toml(spark, path)
    folder = path.rsplit("/", 1)[0]
    names = [r.chrom for r in genome.orderBy("chrid").collect()]
    return genome, genome_wide_map([read_plink_map(spark, m if "/" in m else f"{folder}/{m}", genome, c) for m, c in zip(maps, names, strict=True)], genome)


def read_genome_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(genome, genome-wide map) of a folder of two tables."""
    return spark.read.parquet(f"{path}/genome"), spark.read.parquet(f"{path}/gmap")


# segments


def _placed(df: DataFrame, inds: DataFrame, genome: DataFrame, name1: str, name2: str) -> DataFrame:
    """Names to ids (rows of unknown names go) and chromosome positions to genome-wide ones."""
    one = F.broadcast(inds.select(F.col("name").alias(name1), F.col("ind").alias("ind1")))
    two = F.broadcast(inds.select(F.col("name").alias(name2), F.col("ind").alias("ind2")))
    g = F.broadcast(genome.select("chrom", "chrid", "gwstart"))
    j = df.join(one, name1).join(two, name2).join(g, "chrom")
    j = j.withColumn("s", F.col("gwstart") + F.col("start")).withColumn("e", F.col("gwstart") + F.col("end"))
    return normalize(j.select("ind1", "hap1", "ind2", "hap2", "chrid", "s", "e"))


def read_hapibd(spark: SparkSession, path, inds: DataFrame, genome: DataFrame, min_cm: float | None = None) -> DataFrame:
    """hap-IBD files (tab, no header): haplotypes 1, 2, 0 become 0, 1 and merged (2); positions are 1-based."""
    raw = spark.read.csv(path, sep="\t", mode="DROPMALFORMED", schema="name1 string, h1 int, name2 string, h2 int, chrom string, start1 long, end1 long, cm double")
    if min_cm is not None:
        raw = raw.where(F.col("cm") >= min_cm)
    code = lambda c: F.when(F.col(c) == 1, 0).when(F.col(c) == 2, 1).when(F.col(c) == 0, 2)
    df = raw.select("name1", code("h1").alias("hap1"), "name2", code("h2").alias("hap2"), "chrom", (F.col("start1") - 1).alias("start"), (F.col("end1") - 1).alias("end"))
    return _placed(df, inds, genome, "name1", "name2")


def read_hapibd_dir(spark: SparkSession, path: str, inds: DataFrame, genome: DataFrame) -> DataFrame:
    return read_hapibd(spark, _glob(spark, path, "*ibd.gz"), inds, genome)


def _glob(spark: SparkSession, path: str, pattern: str) -> str:
    return f"{path.rstrip('/')}/{pattern}"


def read_tskibd(spark: SparkSession, path: str, inds: DataFrame, genome: DataFrame) -> DataFrame:
    """tskibd files (tab, header Id1 Id2 Start End ...); the chromosome is the file's stem; empty segments go; all haploid (3)."""
    raw = spark.read.csv(path, sep="\t", header=True)
    need = ["Id1", "Id2", "Start", "End", "Ancestor", "Tmrca", "HasMutation"]
    if raw.columns != need:
        raise ValueError(f"header {raw.columns}; {need} is needed")
    zero = lambda c: F.greatest(F.floor(F.col(c).cast("double")) - 1, F.lit(0))
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1)
    df = raw.select("*", stem.alias("chrom")).select(F.col("Id1").alias("name1"), F.col("Id2").alias("name2"), "chrom", zero("Start").alias("start"), zero("End").alias("end"), F.lit(3).alias("hap1"), F.lit(3).alias("hap2"))
    return _placed(df.where("start < end"), inds, genome, "name1", "name2")


def read_tskibd_dir(spark: SparkSession, path: str, inds: DataFrame, genome: DataFrame) -> DataFrame:
    return read_tskibd(spark, _glob(spark, path, "*ibd"), inds, genome)


def read_hmmibd(spark: SparkSession, path: str, inds: DataFrame, genome: DataFrame, min_cm: float | None = None) -> DataFrame:
    """hmmIBD files (tab, header sample1 sample2 chr start end different Nsnp): rows of state 0; all haploid (3)."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="name1 string, name2 string, chrom string, start1 long, end1 long, different int, nsnp long", enforceSchema=True)
    df = raw.where("different = 0").select("name1", "name2", "chrom", (F.col("start1") - 1).alias("start"), (F.col("end1") - 1).alias("end"), F.lit(3).alias("hap1"), F.lit(3).alias("hap2"))
    if min_cm is not None:
        df = df.where((F.col("end") - F.col("start")) / BP_PER_CM >= min_cm)
    return _placed(df, inds, genome, "name1", "name2")


def read_hmmibd_dir(spark: SparkSession, path: str, inds: DataFrame, genome: DataFrame) -> DataFrame:
    """As the files, with the directory form's least length of 2 cM."""
    return read_hmmibd(spark, _glob(spark, path, "*.hmm.txt"), inds, genome, 2.0)


def read_eibd(spark: SparkSession, path: str, genome: DataFrame | None = None) -> DataFrame:
    """Binary segments: a little-endian 64-bit count, then rows of four 32-bit numbers; ids are ind * 4 + hap.

    With a genome, chrid is that of the chromosome in which a segment starts.  The path is a file or a folder of files.  A file
    is one row of Spark's binary source; its segments leave in slices.
    """
    names = ["ind1", "hap1", "ind2", "hap2", "s", "e"]

    def rows(batches):
        for batch in batches:
            for data in batch.column("content"):
                raw = data.as_buffer()
                n = int(np.frombuffer(raw, "<u8", 1)[0])
                if len(raw) < 8 + 16 * n:
                    raise ValueError("fewer segments than the count says")
                x = np.frombuffer(raw, "<u4", 4 * n, 8).reshape(-1, 4)
                for at in range(0, n, 1 << 16):
                    i, j, s, e = (x[at : at + (1 << 16), k].astype(np.int64) for k in range(4))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i // 4, i % 4, j // 4, j % 4, s, e)], names=names)

    segs = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, ", ".join(f"{n} long" for n in names))
    if genome is None:
        return segs
    g = F.broadcast(genome.select("chrid", "gwstart", (F.col("gwstart") + F.col("size")).alias("_end")))
    return segs.join(g, (F.col("s") >= F.col("gwstart")) & (F.col("s") < F.col("_end"))).select("ind1", "hap1", "ind2", "hap2", "chrid", "s", "e")


# variants


def vcf_samples(spark: SparkSession, path) -> list[str]:
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    if line is None:
        raise ValueError("no #CHROM line")
    return line.value.rstrip("\n").split("\t")[9:]


def _vcf_lines(spark: SparkSession, path, genome: DataFrame, region: tuple[str, int, int] | None) -> DataFrame:
    """(line, chrid, pos genome-wide, alleles, calls) of SNP lines; ``region`` is (chrom, start, end) in 0-based half-open bp."""
    c = F.split("value", "\t", 0)
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("line", F.monotonically_increasing_id())
    raw = raw.select("line", F.get(c, F.lit(0)).alias("chrom"), (F.get(c, F.lit(1)).try_cast("long") - 1).alias("p"), F.concat(F.array(F.get(c, F.lit(3))), F.split(F.get(c, F.lit(4)), ",")).alias("alleles"), F.slice(c, 10, 1 << 30).alias("calls"))
    raw = raw.where(F.forall("alleles", lambda a: (F.length(a) == 1) & (a != "*") & (a != ".")))
    if region:
        raw = raw.where((F.col("chrom") == region[0]) & (F.col("p") >= region[1]) & (F.col("p") < region[2]))
    g = F.broadcast(genome.select("chrom", "chrid", "gwstart"))
    return raw.join(g, "chrom").select("line", "chrid", (F.col("gwstart") + F.col("p")).alias("pos"), "alleles", "calls")


def _haplotypes(lines: DataFrame, names: list[str], chosen: list[str] | None) -> tuple[DataFrame, int]:
    """(line, pos, alleles, genome, code) of phased calls of chosen samples; genome = 2 * sample + side.  A missing call is an error."""
    keep = [k for k, n in enumerate(names) if chosen is None or n in set(chosen)]
    number = F.create_map(*[F.lit(x) for k, s in enumerate(keep) for x in (s, k)]) if keep else F.create_map(F.lit(-1), F.lit(-1))
    calls = lines.select("line", "pos", "alleles", F.posexplode("calls").alias("sample", "call")).withColumn("sample", F.try_element_at(number, F.col("sample"))).where("sample is not null")
    gt = F.split(F.split("call", ":")[0], r"[|/]")
    sides = calls.select("line", "pos", "alleles", "sample", F.posexplode(gt).alias("side", "code"))
    code = F.when(F.col("code") == ".", F.raise_error(F.lit("a missing genotype"))).otherwise(F.col("code").cast("int"))
    return sides.select("line", "pos", "alleles", (F.col("sample") * 2 + F.col("side")).cast("long").alias("genome"), code.alias("code")), len(keep)


def read_vcf_rare(spark: SparkSession, path, genome: DataFrame, max_maf: float = 0.001, samples: list[str] | None = None, region=None) -> tuple[DataFrame, DataFrame]:
    """(records (pos, genome, allele), sites (pos, alleles)) of rare SNP alleles.

    Lines of one position merge: its alleles are REF and the ALTs of its lines in turn, and an allele's number is its place among them.
    Alleles on fewer than floor(2 * samples * max_maf) haplotypes are kept, a record for each carrier.
    """
    lines = _vcf_lines(spark, path, genome, region)
    haps, n = _haplotypes(lines, vcf_samples(spark, path), samples)
    limit = int(n * max_maf * 2)
    per_line = lines.select("line", "pos", "alleles").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("line", "alleles"))).alias("all"))
    merged = per_line.select("pos", F.array_distinct(F.concat(F.array(F.col("all")[0]["alleles"][0]), F.flatten(F.transform("all", lambda x: F.slice(x["alleles"], 2, 1 << 30))))).alias("alleles"))
    alt = haps.where("code > 0").select("pos", "genome", F.get("alleles", F.col("code")).alias("a")).join(merged, "pos").select("pos", "genome", (F.array_position("alleles", F.col("a")) - 1).alias("allele")).dropDuplicates(["pos", "genome"])
    few = alt.groupBy("pos", "allele").agg(F.count("*").alias("n")).where(F.col("n") < limit).select("pos", "allele")
    out = alt.join(few, ["pos", "allele"], "left_semi")
    carried = alt.groupBy("pos").agg(F.count("*").alias("n"))
    ref_rare = merged.join(carried, "pos", "left").where((2 * n - F.coalesce("n", F.lit(0)) < limit) & (2 * n - F.coalesce("n", F.lit(0)) > 0)).select("pos")
    ref = haps.join(ref_rare, "pos", "left_semi").select("pos", "genome").distinct().join(alt, ["pos", "genome"], "left_anti").select("pos", F.lit(0).cast("long").alias("allele"), "genome")
    rec = out.select("pos", "genome", F.col("allele").cast("long").alias("allele")).unionByName(ref.select("pos", "genome", "allele"))
    return rec, merged


def read_vcf_matrix(spark: SparkSession, path, genome: DataFrame, min_maf: float, samples: list[str] | None = None, region=None) -> DataFrame:
    """(pos, genome) of alternative alleles at two-allele SNPs where both alleles are on floor(2 * samples * min_maf) haplotypes or more."""
    haps, n = _haplotypes(_vcf_lines(spark, path, genome, region).where(F.size("alleles") == 2), vcf_samples(spark, path), samples)
    limit = int(n * min_maf * 2)
    ok = haps.groupBy("pos").agg(F.sum(F.col("code")).alias("ac"), F.count("*").alias("n")).where((F.col("ac") >= limit) & (F.col("n") - F.col("ac") >= limit)).select("pos")
    return haps.where("code = 1").join(ok, "pos", "left_semi").select("pos", "genome")


def read_vcf_afreq(spark: SparkSession, path, genome: DataFrame) -> DataFrame:
    """(pos, freq) of two-allele SNPs over calls that aren't missing."""
    lines = _vcf_lines(spark, path, genome, None).where(F.size("alleles") == 2)
    codes = F.flatten(F.transform("calls", lambda c: F.split(F.split(c, ":")[0], r"[|/]")))
    alt, ref = F.size(F.filter(codes, lambda x: x == "1")), F.size(F.filter(codes, lambda x: x == "0"))
    return lines.select("pos", alt.alias("a"), ref.alias("r")).where("a + r > 0").select("pos", (F.col("a") / (F.col("a") + F.col("r"))).alias("freq")).orderBy("pos")


def read_positions(spark: SparkSession, path, genome: DataFrame) -> DataFrame:
    """Genome-wide positions of a list of (chrom, pos) lines, as they stand (not shifted)."""
    return coords.chrom_to_gw(spark.read.csv(path, sep="\t", schema="chrom string, pos long"), genome).select(F.col("gwpos").alias("pos"))


def vcf_positions(spark: SparkSession, path, genome: DataFrame) -> DataFrame:
    c = F.split("value", "\t")
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.get(c, F.lit(0)).alias("chrom"), (F.get(c, F.lit(1)).try_cast("long") - 1).alias("pos"))
    return coords.chrom_to_gw(raw, genome).select(F.col("gwpos").alias("pos"))


def read_packed_records(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(records, sort status) of a table of packed 64-bit records whose column name is the sort status."""
    from ..operators.rare import unpack

    raw = spark.read.parquet(path)
    return unpack(raw, raw.columns[0]), raw.columns[0]


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, pos, alleles array) of a sites table (gw_pos, alleles as bytes of names with blanks)."""
    raw = spark.read.parquet(path).select(F.col("gw_pos").cast("long").alias("pos"), F.split(F.col("alleles").cast("string"), " ").alias("alleles"))
    return numbered(raw, ["pos", "alleles"], "site_id").withColumn("site_id", F.col("site_id") - 1)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(ind, name) of a one-column table of names, in the order of the file."""
    raw = spark.read.parquet(path)
    return spark.createDataFrame([(k, r[0]) for k, r in enumerate(raw.collect())], "ind long, name string")


# ancestry


def read_ancestry(spark: SparkSession, path, positions: DataFrame, genome: DataFrame, inds: DataFrame, min_prob: float = 0.9) -> DataFrame:
    """(hap, s, anc) of calls of forward-backward tables: the most probable ancestry of each haplotype (the last of equal ones), ``?`` below min_prob.

    hap is 2 * individual + haplotype; individuals that aren't listed are left out.  A window begins half way between the
    SNPs of its predecessor and itself; SNP positions (chrid, idx, p) are in chromosome order.
    """
    from ..operators.ancestry import best_calls

    text = spark.read.text(path)
    first = text.where(F.col("value").startswith("#")).first()
    ancestries = first.value.lstrip("#").split(":")[-1].split()
    header = text.where(F.col("value").startswith("chromosome\t")).first().value.split("\t")[4:]
    who = {r.name: r.ind for r in inds.collect()}
    labels = [h.split(":::") for h in header]
    rows = [(k, who[s] * 2 + int(h[-1]) - 1, ancestries.index(a), a) for k, (s, h, a) in enumerate(labels) if s in who]
    cols = F.broadcast(spark.createDataFrame(rows, "col int, hap long, k int, anc string"))
    c = F.split("value", "\t")
    body = text.where(~F.col("value").startswith("#") & ~F.col("value").startswith("chromosome\t")).select(F.get(c, F.lit(0)).alias("chrom"), F.get(c, F.lit(3)).try_cast("long").alias("idx"), F.posexplode(F.slice(c, 5, 1 << 30)).alias("col", "prob"))
    long = body.join(cols, "col").join(F.broadcast(genome.select("chrom", "chrid", "gwstart")), "chrom")
    idx = body.select("chrom", "idx").distinct().join(F.broadcast(genome.select("chrom", "chrid", "gwstart")), "chrom")
    before = F.lag("idx").over(W.partitionBy("chrid").orderBy("idx"))
    start = idx.withColumn("mid", F.floor((before + F.col("idx")) / 2)).join(positions.select("chrid", F.col("idx").alias("mid"), "p"), ["chrid", "mid"], "left")
    start = start.select("chrid", "idx", (F.col("gwstart") + F.coalesce("p", F.lit(0))).alias("s"))
    calls = long.join(start, ["chrid", "idx"]).select("hap", "s", "k", "anc", F.col("prob").cast("double").alias("prob"))
    return best_calls(calls, "?", min_prob)


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds ``place``, the number of each row of Parquet files in the order of their names and of rows inside; sums of a row a file are collected."""
    named = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted((r["_file"], r["n"]) for r in named.groupBy("_file").agg(F.count("*").alias("n")).collect())
    begin, rows = 0, []
    for file, n in sizes:
        rows.append((file, begin))
        begin += n
    starts = F.broadcast(df.sparkSession.createDataFrame(rows, "_file string, _begin long"))
    return named.join(starts, "_file").withColumn("place", F.col("_begin") + F.col("_row")).drop("_file", "_row", "_begin")


def read_bool_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col) of the true cells of a table of one boolean column, whose name is the number of columns, row after row."""
    raw = spark.read.parquet(path)
    (name,) = raw.columns
    return in_file_order(raw).where(F.col(name)).select(F.floor(F.col("place") / int(name)).alias("row"), (F.col("place") % int(name)).alias("col"))


def read_matrix_triple(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a matrix in three tables: values row after row, names of rows, names of columns."""
    values, rows, cols = (in_file_order(spark.read.parquet(f"{path}{x}")) for x in ("", ".row", ".col"))
    n = cols.count()
    value = [c for c in values.columns if c != "place"][0]
    v = values.select(F.col(value).alias("value"), F.floor(F.col("place") / n).alias("_i"), (F.col("place") % n).alias("_j"))
    r, c = (x.select(F.col(x.columns[0]).alias(name), F.col("place").alias(at)) for x, name, at in ((rows, "row", "_i"), (cols, "col", "_j")))
    return v.join(r, "_i").join(c, "_j").select("row", "col", "value")


def read_matrix(spark: SparkSession, path) -> DataFrame:
    """A tab-separated number table without header as (row values) arrays."""
    return spark.read.text(path).select(F.transform(F.split("value", "\t"), lambda x: x.cast("double")).alias("values"))


def read_named_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a matrix written by :func:`strandlake.sources.sinks.write_named_matrix`."""
    return spark.read.parquet(path)


def packed_id(ind: Column, hap: Column) -> Column:
    return ind * 4 + hap
