"""Command line over Parquet and text inputs: python -m strandlake.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import ancestry, ibd, matrix, rare, rvibd, stats
from .operators import intervals as I
from .sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *args: tuple) -> None:
        c = sub.add_parser(name, help=text)
        c.add_argument("-o", "--out", required=True)
        for flags, kw in args:
            c.add_argument(*flags, **kw)

    genome = (("-g", "--genome"), {"required": True, "help": "genome TOML"})
    rec = (("-r", "--records"), {"required": True, "help": "records (pos, genome, allele) as Parquet"})
    segs = (("-i", "--ibd"), {"required": True, "help": "segments as Parquet or a directory of the named format"})
    fmt = (("-f", "--format"), {"default": "parquet", "choices": ["parquet", "hapibd", "tskibd", "hmmibd"]})
    samples = (("-s", "--samples"), {"help": "sample list"})
    add("encode-vcf", "rare variants of a VCF", genome, (("-v", "--vcf"), {"required": True}), (("-m", "--maf"), {"type": float, "default": 0.001}))
    add("records", "records by position or genome", rec, (("-p", "--pos"), {"type": int}), (("-n", "--id"), {"type": int}))
    lists = (("--lists",), {"nargs": "+", "help": "one or two files of genome ids: pairs of one list, or of one with the other"})
    add("jaccard", "pairwise Jaccard similarity", rec, lists, (("--min-jaccard",), {"type": float}), (("--min-shared",), {"type": int}), (("--min-total",), {"type": int}))
    add("cosine", "pairwise cosine similarity", rec, lists, (("--min-cosine",), {"type": float}), (("--min-magnitude",), {"type": int}), (("--min-dot-prod",), {"type": int}))
    add("grm", "relationship matrix", rec, (("--genomes",), {"type": int, "required": True}))
    add("share", "positions of a pair", rec, (("-a",), {"type": int, "required": True}), (("-b",), {"type": int, "required": True}))
    add("sample-diff", "sites of different dosage", rec)
    add("coverage", "coverage at cM steps", genome, segs, fmt, samples, (("--start-cm",), {"type": float, "default": 0.01}), (("--step-cm",), {"type": float, "default": 0.01}), (("--prevent-flatten",), {"action": "store_true"}))
    add("compare", "overlap of two sets", genome, segs, fmt, samples, (("--other",), {"required": True}), (("--window",), {"type": int, "help": "bp of windows for rates inside them"}), (("--details",), {"action": "store_true"}), (("--to-diploid",), {"action": "store_true", "help": "haploid ids to diploid ones by the sample list"}), (("--length-bins",), {"default": "3,4,6,10,18"}), (("--min-cm",), {"type": float, "default": 2.0}))
    add("encode-ibd", "segments without extreme coverage and sparse windows", genome, segs, fmt, samples, (("--positions",), {"required": True}), (("--outlier",), {"type": float, "default": 10.0}), (("--min-snp",), {"type": int, "default": 15}), (("--min-cm",), {"type": float, "default": 2.0}))
    add("get-unrelated", "a set without related pairs", genome, segs, fmt, samples, (("--threshold",), {"type": float, "default": 0.5}))
    add("skato", "variant-set association over windows of sites", rec, (("--phenotypes",), {"required": True, "help": "Parquet of (sample, y, x array)"}), (("--window",), {"type": int, "default": 200}), (("--step",), {"type": int, "default": 200}))
    add("rvibd", "rare variants against segments", genome, segs, fmt, samples, rec, (("--every",), {"type": int, "default": 64}))
    add("export", "records as a VCF", genome, rec, (("--sites",), {"required": True}), (("-s", "--samples"), {"required": True}))
    add("matrix", "common variants of a VCF as a boolean table", genome, (("-v", "--vcf"), {"required": True}), (("-m", "--min-maf"), {"type": float, "default": 0.01}))
    add("sites", "sites with their alleles", (("--sites",), {"required": True}), (("-p", "--pos"), {"type": int}))
    add("samples", "samples whose name has a text", (("-s", "--samples"), {"required": True}), (("--contains",), {"default": ""}))
    add("asibd", "segments by local ancestry", genome, segs, fmt, samples, (("--ancestry",), {"required": True, "help": "forward-backward tables"}), (("--positions",), {"required": True, "help": "chrom and bp of SNPs"}), (("--min-prob",), {"type": float, "default": 0.9}))
    add("genome", "a genome as text with its maps, or as tables", (("-g", "--genome"), {}), (("--name",), {"help": "a built-in genome"}), (("--tables",), {"action": "store_true"}))
    add("plot-ibd", "the segments of a pair, to draw", segs, fmt, samples, genome, (("-a",), {"type": int, "required": True}), (("-b",), {"type": int, "required": True}))
    return p


def genetic_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The map that a genome description names; None (constant rate) where it names none."""
    return readers.read_genome_text(spark, path)[1] if readers.read_genome_toml(spark, path)[2] else None


def segments(spark: SparkSession, args, path: str, genome: DataFrame) -> DataFrame:
    if args.format == "parquet":
        return spark.read.parquet(path)
    inds = readers.read_individuals(spark, args.samples)[0]
    read = {"hapibd": readers.read_hapibd_dir, "tskibd": readers.read_tskibd_dir, "hmmibd": readers.read_hmmibd_dir}[args.format]
    return read(spark, path, inds, genome)


def cm_grid(genome: DataFrame, start: float, step: float) -> DataFrame:
    """Genome-wide points at start + k * step cM of the constant map."""
    total = F.sum("size").alias("total")
    k = F.explode(F.sequence(F.lit(0), F.floor((F.col("total") / ibd.BP_PER_CM - start) / step).cast("int")))
    p = genome.agg(total).select(k.alias("k")).select(F.floor((start + F.col("k") * step) * ibd.BP_PER_CM).cast("long").alias("p"))
    g = F.broadcast(genome.select("chrid", "gwstart", (F.col("gwstart") + F.col("size")).alias("_end")))
    return p.join(g, (F.col("p") >= F.col("gwstart")) & (F.col("p") < F.col("_end"))).select("chrid", "p")


def run(spark: SparkSession, argv: list[str]) -> None:
    args = parser().parse_args(argv)
    genome = readers.read_genome_toml(spark, args.genome)[0] if "genome" in args and args.genome else None
    gmap = genetic_map(spark, args.genome) if "genome" in args and args.genome else None
    rec = spark.read.parquet(args.records) if "records" in args and args.command != "records" else None
    ids = [readers.read_ids(spark, x).withColumnRenamed("id", "genome") for x in (getattr(args, "lists", None) or [])]
    pairs = rare.pairs_of_lists(*ids[:2]) if ids else None
    if args.command == "encode-vcf":
        records, sites = readers.read_vcf_rare(spark, args.vcf, genome, args.maf)
        sinks.write_parquet(records, f"{args.out}/records")
        sinks.write_parquet(sites, f"{args.out}/sites")
    elif args.command == "records":
        r = spark.read.parquet(args.records)
        r = r if args.pos is None else r.where(F.col("pos") == args.pos)
        sinks.write_parquet(r if args.id is None else r.where(F.col("genome") == args.id), args.out)
    elif args.command == "jaccard":
        j = rare.jaccard(rec, pairs)
        for name, least in (("jaccard", args.min_jaccard), ("shared", args.min_shared), ("total", args.min_total)):
            j = j if least is None else j.where(F.col(name) >= least)
        sinks.write_parquet(j, args.out)
    elif args.command == "cosine":
        sinks.write_parquet(rare.cosine(rec, pairs, args.min_dot_prod, args.min_magnitude, args.min_cosine), args.out)
    elif args.command == "sample-diff":
        sinks.write_parquet(rare.sample_discordance(rec), args.out)
    elif args.command == "skato":
        dose = rec.groupBy(F.floor(F.col("genome") / 2).alias("sample"), "pos").agg(F.count("*").alias("dose"))
        sinks.write_parquet(stats.skat_windows(dose, spark.read.parquet(args.phenotypes), args.window, args.step), args.out)
    elif args.command == "rvibd":
        s = segments(spark, args, args.ibd, genome)
        s = s.select((F.col("ind1") * 2 + F.col("hap1")).alias("g1"), (F.col("ind2") * 2 + F.col("hap2")).alias("g2"), "chrid", "s", "e")
        sinks.write_csv(rvibd.position_scan(rec, s), f"{args.out}/positions", "\t")
        sinks.write_csv(rvibd.pair_counters(rec, s), f"{args.out}/counters", "\t")
        sinks.write_parquet(rvibd.matched_rows(rec, s), f"{args.out}/matched")
        sinks.write_csv(rvibd.similarity(rec, s, args.every), f"{args.out}/similarity", "\t")
    elif args.command == "export":
        inds = readers.read_individuals(spark, args.samples)[0]
        sinks.write_vcf(rec, spark.read.parquet(args.sites), genome, [r.name for r in inds.orderBy("ind").collect()], args.out)
    elif args.command == "matrix":
        cells = readers.read_vcf_matrix(spark, args.vcf, genome, args.min_maf)
        sites = matrix.numbered(cells.select("pos").distinct(), ["pos"], "row").withColumn("row", F.col("row") - 1)
        sinks.write_parquet(sites, f"{args.out}/sites")
        sinks.write_bool_matrix(cells.join(sites, "pos").select("row", F.col("genome").alias("col")), sites.count(), 2 * len(readers.vcf_samples(spark, args.vcf)), f"{args.out}/matrix")
    elif args.command == "sites":
        found = spark.read.parquet(args.sites)
        sinks.write_parquet(found if args.pos is None else found.where(F.col("pos") == args.pos), args.out)
    elif args.command == "samples":
        sinks.write_csv(readers.read_individuals(spark, args.samples)[0].where(F.contains("name", F.lit(args.contains))), args.out, "\t")
    elif args.command == "asibd":
        inds = readers.read_individuals(spark, args.samples)[0]
        s = segments(spark, args, args.ibd, genome).select((F.col("ind1") * 2 + F.col("hap1")).alias("hap1"), (F.col("ind2") * 2 + F.col("hap2")).alias("hap2"), "s", "e")
        place = F.row_number().over(W.partitionBy("chrid").orderBy("p")) - 1
        snps = spark.read.csv(args.positions, sep="\t", schema="chrom string, p long").join(F.broadcast(genome.select("chrom", "chrid")), "chrom").select("chrid", "p").withColumn("idx", place.cast("long"))
        calls = readers.read_ancestry(spark, args.ancestry, snps, genome, inds, args.min_prob)
        end = genome.agg(F.max(F.col("gwstart") + F.col("size"))).first()[0]
        sinks.ancestry_tsv(ancestry.ancestry_segments(s, ancestry.runs(calls, end)), genome, args.out)
    elif args.command == "genome":
        if args.name:
            genome, gmap = readers.named_genome(spark, args.name), None
        gmap = readers.constant_map(genome) if gmap is None else gmap
        if args.tables:
            sinks.write_genome_tables(genome, gmap, args.out)
        else:
            sinks.write_genome_text(genome, gmap, f"{args.out}/genome.toml", args.name or "genome")
    elif args.command == "plot-ibd":
        s = segments(spark, args, args.ibd, genome)
        sinks.write_csv(ibd.of_pair(s, args.a, args.b).orderBy("s"), args.out, "\t")
    elif args.command == "grm":
        sinks.write_parquet(rare.grm(rec, args.genomes), args.out)
    elif args.command == "share":
        sinks.write_parquet(rare.share_pair(rec, args.a, args.b), args.out)
    elif args.command == "coverage":
        s = segments(spark, args, args.ibd, genome)
        s = s if args.prevent_flatten else ibd.diploid_merge(s)
        sinks.coverage_csv(I.sweep_coverage(cm_grid(genome, args.start_cm, args.step_cm), s, ["chrid"]), genome, args.out)
    elif args.command == "compare":
        a, b = (ibd.min_cm(segments(spark, args, x, genome), args.min_cm, gmap).drop("cm") for x in (args.ibd, args.other))
        if args.to_diploid:
            ploidy = readers.read_individuals(spark, args.samples)[1]
            a, b = ibd.haploid_to_diploid(a, ploidy), ibd.haploid_to_diploid(b, ploidy)
        bins = [float(x) for x in args.length_bins.split(",")]
        sinks.overlap_csv(ibd.overlap_rates(a, b, bins, gmap=gmap), ibd.overlap_rates(b, a, bins, gmap=gmap), f"{args.out}/overlap")
        if args.window:
            sinks.windowed_overlap_csv(ibd.windowed_rates(a, b, genome, args.window, bins), f"{args.out}/windows")
        if args.details:
            sinks.overlap_details_tsv(ibd.overlap_shares(a, b), f"{args.out}/details-a")
            sinks.overlap_details_tsv(ibd.overlap_shares(b, a), f"{args.out}/details-b")
        sinks.totals_csv(ibd.length_spectrum(a, b, gmap=gmap), f"{args.out}/spectrum")
        people = a.select(F.col("ind1").alias("id")).union(a.select("ind2")).union(b.select("ind1")).union(b.select("ind2")).distinct()
        sinks.write_parquet(ibd.pair_totals_both(a, b, people, "id", gmap), f"{args.out}/totals")
    elif args.command == "encode-ibd":
        s = segments(spark, args, args.ibd, genome)
        step = int(0.25 * ibd.BP_PER_CM)
        cov = I.sweep_coverage(I.grid(genome, step, step // 2), s, ["chrid"], closed=True)
        bad = ibd.extreme_regions(cov, step, args.outlier)
        bad = bad.unionByName(ibd.low_density_windows(readers.read_positions(spark, args.positions, genome), genome, int(ibd.BP_PER_CM), args.min_snp))
        sinks.regions_tsv(I.islands(bad, ["chrid"]), genome, f"{args.out}/removed")
        sinks.write_parquet(ibd.remove_regions(s, bad, genome, args.min_cm, gmap), f"{args.out}/segments")
    elif args.command == "get-unrelated":
        s = segments(spark, args, args.ibd, genome)
        total = genome.agg(F.sum("size") / ibd.BP_PER_CM).first()[0] if gmap is None else gmap.agg(F.max("y2")).first()[0]
        edges = ibd.related_edges(s, total, args.threshold, gmap)
        kept = set(ibd.unrelated(sorted({x for e in edges for x in e}), edges))
        gone = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e} - kept)], "ind long")
        everyone = s.select(F.col("ind1").alias("ind")).union(s.select("ind2")).distinct()
        sinks.write_csv(everyone.join(gone, "ind", "left_anti").orderBy("ind"), args.out, header=False)


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.appName("strandlake").getOrCreate(), sys.argv[1:])
