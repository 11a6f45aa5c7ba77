from pyspark.sql import functions as F

from strandlake import cli
from strandlake.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_commands(spark, tmp_path):
    g = tmp_path / "g.toml"
    names = [f"c{k}" for k in range(7)]
    g.write_text(f'name = "x"\nchromsize = {[3_000_000] * 7}\nchromnames = {names}\ngmaps = []\n[idx]\n' + "".join(f"{n} = {k}\n" for k, n in enumerate(names)))
    seg, rec = X.seg(spark, SF), X.rec(spark, SF)
    seg.where("l_linestatus = 'F'").write.parquet(str(tmp_path / "a"))
    seg.where("l_linestatus = 'O'").write.parquet(str(tmp_path / "b"))
    rec.write.parquet(str(tmp_path / "r"))
    rec.select(F.lit("c0"), "pos").distinct().write.csv(str(tmp_path / "p"), sep="\t")
    out = lambda n: str(tmp_path / n)
    cli.run(spark, ["jaccard", "-r", out("r"), "-o", out("j"), "--min-shared", "1"])
    assert spark.read.parquet(out("j")).where("shared < 1").count() == 0
    for c in ("cosine", "sample-diff"):
        cli.run(spark, [c, "-r", out("r"), "-o", out(c)])
    cli.run(spark, ["grm", "-r", out("r"), "--genomes", "50", "-o", out("grm")])
    cli.run(spark, ["share", "-r", out("r"), "-a", "3", "-b", "8", "-o", out("share")])
    cli.run(spark, ["records", "-r", out("r"), "-n", "3", "-o", out("rec")])
    assert {r.genome for r in spark.read.parquet(out("rec")).collect()} == {3}
    cli.run(spark, ["coverage", "-g", str(g), "-i", out("a"), "-o", out("cov"), "--start-cm", "1", "--step-cm", "10"])
    assert spark.read.csv(out("cov"), header=True).count() == 140
    cli.run(spark, ["compare", "-g", str(g), "-i", out("a"), "--other", out("b"), "-o", out("cmp")])
    assert spark.read.csv(out("cmp/overlap"), header=True).where("LenBinStart = 'genome_wide'").count() == 1
    cli.run(spark, ["encode-ibd", "-g", str(g), "-i", out("a"), "--positions", out("p"), "--min-snp", "1", "--outlier", "3", "-o", out("enc")])
    kept = spark.read.parquet(out("enc/segments"))
    assert kept.where("e - s < 30000").count() == 0 and {"ind1", "ind2", "chrid"} <= set(kept.columns)
    cli.run(spark, ["get-unrelated", "-g", str(g), "-i", out("a"), "--threshold", "0.01", "-o", out("un")])
    assert 0 < spark.read.csv(out("un")).count() <= 40


def genome_file(tmp_path):
    g = tmp_path / "g.toml"
    names = [f"c{k}" for k in range(7)]
    g.write_text(f'name = "x"\nchromsize = {[3_000_000] * 7}\nchromnames = {names}\ngmaps = []\n[idx]\n' + "".join(f"{n} = {k}\n" for k, n in enumerate(names)))
    return str(g)


def test_variant_commands(spark, tmp_path):
    g, out = genome_file(tmp_path), lambda n: str(tmp_path / n)
    X.rec(spark, SF).withColumn("pos", F.col("pos") * 1000).write.parquet(out("r"))
    X.seg(spark, SF).write.parquet(out("s"))
    (tmp_path / "one").write_text("1\n2\n3\n")
    (tmp_path / "two").write_text("3\n4\n")
    cli.run(spark, ["jaccard", "-r", out("r"), "--lists", out("one"), "-o", out("j1")])
    assert {(r.g1, r.g2) for r in spark.read.parquet(out("j1")).collect()} <= {(2, 1), (3, 1), (3, 2)}
    cli.run(spark, ["cosine", "-r", out("r"), "--lists", out("one"), out("two"), "--min-magnitude", "1", "-o", out("c2")])
    assert {(r.g1, r.g2) for r in spark.read.parquet(out("c2")).collect()} <= {(3, 1), (3, 2), (4, 1), (4, 2), (4, 3)}
    spark.range(25).select(F.col("id").alias("sample"), (F.col("id") % 2).alias("y"), F.array((F.col("id") % 7).cast("double")).alias("x")).write.parquet(out("ph"))
    cli.run(spark, ["skato", "-r", out("r"), "--phenotypes", out("ph"), "--window", "100", "--step", "100", "-o", out("sk")])
    assert 0 < spark.read.parquet(out("sk")).where("pval >= 0 and pval <= 1").count()
    cli.run(spark, ["rvibd", "-g", g, "-i", out("s"), "-r", out("r"), "--every", "5", "-o", out("rv")])
    assert len(spark.read.csv(out("rv/counters"), sep="\t", header=True).columns) == 6
    spark.read.parquet(out("r")).select("pos").distinct().withColumn("alleles", F.array(F.lit("A"), F.lit("C"), F.lit("G"))).write.parquet(out("sites"))
    (tmp_path / "names").write_text("".join(f"s{k}\n" for k in range(25)))
    cli.run(spark, ["export", "-g", g, "-r", out("r"), "--sites", out("sites"), "-s", out("names"), "-o", out("v.vcf")])
    cli.run(spark, ["encode-vcf", "-g", g, "-v", out("v.vcf"), "-m", "0.9", "-o", out("back")])
    assert spark.read.parquet(out("back/records")).where("allele > 0").count() == spark.read.parquet(out("r")).count()
    two = spark.read.text(out("v.vcf")).select(F.regexp_replace(F.regexp_replace("value", "\tC,G\t", "\tC\t"), "2", "1").alias("value"))
    two.coalesce(1).write.text(out("v2.vcf"))
    cli.run(spark, ["sites", "--sites", out("sites"), "-p", "5000", "-o", out("st")])
    assert spark.read.parquet(out("st")).count() <= 1
    cli.run(spark, ["samples", "-s", out("names"), "--contains", "2", "-o", out("sm")])
    assert {r.name for r in spark.read.csv(out("sm"), sep="\t", header=True).collect()} == {"s2", "s12", "s20", "s21", "s22", "s23", "s24"}


def test_segment_commands(spark, tmp_path):
    g, out = genome_file(tmp_path), lambda n: str(tmp_path / n)
    s = X.seg(spark, SF)
    s.where("l_linestatus = 'F'").write.parquet(out("a"))
    s.where("l_linestatus = 'O'").write.parquet(out("b"))
    cli.run(spark, ["compare", "-g", g, "-i", out("a"), "--other", out("b"), "--window", "500000", "--details", "-o", out("cmp")])
    assert len(spark.read.csv(out("cmp/windows"), header=True).columns) == 12
    assert spark.read.csv(out("cmp/details-a"), sep="\t", header=True).count() > 0
    cli.run(spark, ["plot-ibd", "-g", g, "-i", out("a"), "-a", "3", "-b", "7", "-o", out("pl")])
    cli.run(spark, ["genome", "--name", "sim14chr100cm_const15k", "-o", out("gt")])
    cli.run(spark, ["genome", "-g", out("gt/genome.toml"), "--tables", "-o", out("gb")])
    assert spark.read.parquet(out("gb/genome")).count() == 14
    assert abs(spark.read.parquet(out("gb/gmap")).agg(F.max("y2")).first()[0] - 1400) < 0.1
    # local ancestry: one window of each chromosome's start
    (tmp_path / "names").write_text("".join(f"s{k}\n" for k in range(40)))
    head = "#reference_panel_population: X Y\n" + "\t".join(["chromosome", "physical_position", "genetic_position", "genetic_marker_index", *[f"s{k}:::hap{h}:::{a}" for k in range(40) for h in (1, 2) for a in "XY"]])
    (tmp_path / "fb.tsv").write_text(head + "\n" + "\n".join("\t".join(["c0", str(p), "0", str(i), *(["0.95", "0.05"] * 80)]) for i, p in ((0, 0), (2, 2_000_000))) + "\n")
    (tmp_path / "pos").write_text("c0\t0\nc0\t1000000\nc0\t2000000\n")
    cli.run(spark, ["asibd", "-g", g, "-i", out("a"), "-s", out("names"), "--ancestry", out("fb.tsv"), "--positions", out("pos"), "-o", out("as")])
    t = spark.read.csv(out("as"), sep="\t", header=True)
    assert t.count() > 0 and {(r.anc1, r.anc2) for r in t.collect()} == {("X", "X")}
