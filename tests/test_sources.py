import gzip
import struct

import pytest
from pyspark.sql import functions as F

from strandlake.sources import readers as R
from strandlake.sources import sinks as S


@pytest.fixture()
def dims(spark):
    genome = R.genome_from_lists(spark, ["1", "2"], [1000, 2000])
    inds = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ind long, name string")
    return genome, inds


def test_genome_toml_and_maps(spark, tmp_path):
    p = tmp_path / "g.toml"
    p.write_text('name = "x"\nchromsize = [100, 200]\nchromnames = ["c1", "c2"]\ngmaps = ["m1", "m2"]\n[idx]\nc1 = 0\nc2 = 1\nchr1 = 0\n')
    genome, aliases, maps = R.read_genome_toml(spark, str(p))
    assert [(r.chrom, r.gwstart) for r in genome.orderBy("chrid").collect()] == [("c1", 0), ("c2", 100)]
    assert aliases.count() == 3 and maps == ["m1", "m2"]
    m = tmp_path / "m1"
    m.write_text("c1 . 0.5 51\nc1 . 1.0 76\n")
    knots = R.read_plink_map(spark, str(m), genome, "c1").collect()
    assert [(k.x1, k.x2, k.y1, k.y2) for k in knots][:2] == [(0, 50, 0.0, 0.5), (50, 75, 0.5, 1.0)]
    assert knots[-1].x2 == 99 and abs(knots[-1].y2 - 99 / 75) < 1e-9
    whole = R.genome_wide_map([R.read_plink_map(spark, str(m), genome, "c1")] * 2, genome)
    assert whole.agg(F.max("y2")).first()[0] == pytest.approx(2 * 99 / 75)
    assert R.constant_map(genome, 100.0).agg(F.max("y2")).first()[0] == 3.0
    assert R.named_genome(spark, "pf3d7_const15k").count() == 14


def test_segment_formats(spark, tmp_path, dims):
    genome, inds = dims
    d = tmp_path / "h"
    d.mkdir()
    with gzip.open(d / "x.ibd.gz", "wt") as f:
        f.write("a\t1\tb\t2\t1\t11\t101\t2.5\nc\t0\ta\t0\t2\t1\t51\t1.0\nnobody\t1\ta\t1\t1\t5\t9\t9.0\n")
    got = sorted(tuple(r) for r in R.read_hapibd_dir(spark, str(d), inds, genome).collect())
    assert got == [(1, 1, 0, 0, 0, 10, 100), (2, 2, 0, 2, 1, 1000, 1050)]
    assert R.read_hapibd(spark, str(d), inds, genome, 2.0).count() == 1
    t = tmp_path / "t"
    t.mkdir()
    (t / "2.ibd").write_text("Id1\tId2\tStart\tEnd\tAncestor\tTmrca\tHasMutation\na\tb\t11.7\t31.2\t5\t9.0\t0\na\tc\t9\t9\t5\t9.0\t0\n")
    assert [tuple(r) for r in R.read_tskibd_dir(spark, str(t), inds, genome).collect()] == [(1, 3, 0, 3, 1, 1010, 1030)]
    h = tmp_path / "hm"
    h.mkdir()
    (h / "x.hmm.txt").write_text("sample1\tsample2\tchr\tstart\tend\tdifferent\tNsnp\na\tb\t1\t1\t901\t0\t5\na\tb\t1\t1\t901\t1\t5\n")
    assert [tuple(r) for r in R.read_hmmibd(spark, str(h), inds, genome).collect()] == [(1, 3, 0, 3, 0, 0, 900)]
    assert R.read_hmmibd_dir(spark, str(h), inds, genome).count() == 0
    e = tmp_path / "x.eibd"
    e.write_bytes(struct.pack("<Q4I", 1, 1 * 4 + 2, 0 * 4 + 2, 10, 20))
    seg = R.read_eibd(spark, str(e))
    assert [tuple(r) for r in seg.collect()] == [(1, 2, 0, 2, 10, 20)]
    assert S.eibd_bytes(seg) == e.read_bytes()
    S.hapibd_csv(seg.withColumn("chrid", F.lit(0)), inds, genome, str(tmp_path / "out"))
    back = R.read_hapibd(spark, str(tmp_path / "out"), inds, genome)
    assert [tuple(r) for r in back.collect()] == [(1, 2, 0, 2, 0, 10, 20)]


def test_sample_lists(spark, tmp_path):
    p = tmp_path / "s"
    p.write_text("a\nb\n")
    assert R.read_individuals(spark, str(p))[0].count() == 2
    p.write_text("h1\td1\nh2\td1\nh3\td2\n")
    inds, ploidy, way = R.read_individuals(spark, str(p))
    assert way == "haploid" and sorted(tuple(r) for r in ploidy.collect()) == [(0, 0, 0), (1, 0, 1), (2, 1, 0)]
    p.write_text("d1\th1\th2\nd2\th3\th4\n")
    assert sorted(tuple(r) for r in R.read_individuals(spark, str(p))[1].collect()) == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)]
    p.write_text("a b c d\n")
    with pytest.raises(ValueError):
        R.read_individuals(spark, str(p))
    p.write_text("3\n1\n")
    assert [r.id for r in R.read_ids(spark, str(p)).collect()] == [1, 3]


VCF = """##fileformat=VCFv4.2
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	a	b	c
1	11	.	A	C	.	.	.	GT	0|1	0|0	0|0
1	11	.	A	G	.	.	.	GT	0|0	1|0	0|0
1	21	.	A	AT	.	.	.	GT	0|1	0|0	0|0
2	31	.	T	G,C	.	.	.	GT:DP	1|2:3	2|2:3	2|2:3
2	41	.	C	A	.	.	.	GT	1|1	1|1	1|0
"""


def test_vcf(spark, tmp_path, dims):
    genome, inds = dims
    p = tmp_path / "x.vcf"
    p.write_text(VCF)
    rec, sites = R.read_vcf_rare(spark, str(p), genome, 0.34)
    assert sorted(tuple(r) for r in rec.collect()) == [(10, 1, 1), (10, 2, 2), (1030, 0, 1), (1040, 5, 0)]
    assert {r.pos: r.alleles for r in sites.collect()} == {10: ["A", "C", "G"], 1030: ["T", "G", "C"], 1040: ["C", "A"]}
    assert R.read_vcf_rare(spark, str(p), genome, 0.34, ["a"])[0].count() == 0
    assert R.read_vcf_rare(spark, str(p), genome, 0.34, None, ("1", 0, 100))[0].count() == 2
    assert {r.pos for r in R.read_vcf_matrix(spark, str(p), genome, 0.17).collect()} == {10, 1040}
    assert [(r.pos, round(r.freq, 4)) for r in R.read_vcf_afreq(spark, str(p), genome).collect()] == [(10, 0.1667), (10, 0.1667), (1040, 0.8333)]
    assert sorted(r.pos for r in R.vcf_positions(spark, str(p), genome).collect()) == [10, 10, 20, 1030, 1040]
    S.write_vcf(rec, sites, genome, ["a", "b", "c"], str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "1\t11\t.\tA\tC,G\t.\tPASS\t.\tGT\t0|1\t2|0\t0|0" in lines
    again, _ = R.read_vcf_rare(spark, str(tmp_path / "out"), genome, 0.34)
    assert sorted(tuple(r) for r in again.where("pos = 10").collect()) == [(10, 1, 1), (10, 2, 2)]
    p.write_text(VCF.replace("1|0\n", ".|0\n"))
    with pytest.raises(Exception, match="missing genotype"):
        R.read_vcf_rare(spark, str(p), genome, 0.34)[0].collect()


def test_tables(spark, tmp_path, dims):
    genome, inds = dims
    rec = spark.createDataFrame([(4_000_000_000, 16_000_000, 255), (7, 1, 2)], "pos long, genome long, allele long")
    S.write_packed_records(rec, str(tmp_path / "rec"), "2")
    back, status = R.read_packed_records(spark, str(tmp_path / "rec"))
    assert status == "2" and sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in rec.collect())
    S.write_sites(spark.createDataFrame([(5, ["A", "C"])], "pos long, alleles array<string>"), str(tmp_path / "sit"))
    assert R.read_sites(spark, str(tmp_path / "sit")).first().alleles == ["A", "C"]
    S.write_names(inds, str(tmp_path / "ind"))
    assert [r.name for r in R.read_names(spark, str(tmp_path / "ind")).orderBy("ind").collect()] == ["a", "b", "c"]
    m = spark.createDataFrame([("x", "x", 1.0), ("y", "x", 0.5), ("y", "y", 1.0)], "row string, col string, value double")
    S.write_named_matrix(S.mirrored(m), str(tmp_path / "mat"))
    assert [r.asDict() for r in S.pivot_matrix(R.read_named_matrix(spark, str(tmp_path / "mat"))).collect()] == [{"row": "x", "x": 1.0, "y": 0.5}, {"row": "y", "x": 0.5, "y": 1.0}]
    cov = spark.createDataFrame([(0, 10, 3), (1, 1010, 4)], "chrid int, p long, cov long")
    S.coverage_csv(cov, genome, str(tmp_path / "cov"))
    assert spark.read.csv(str(tmp_path / "cov"), header=True).columns == ["Chrom", "Pos", "Cm", "GwPos", "GwCm", "Coverage"]
    S.regions_tsv(spark.createDataFrame([(900, 1100)], "s long, e long"), genome, str(tmp_path / "reg"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "reg"), header=True, sep="\t").collect()) == [("1", "900", "1000"), ("2", "0", "100")]
    rate = spark.createDataFrame([(3.0, 0.5, 0.1, 4), (-1.0, 0.4, 0.2, 9)], "bin_start double, mean double, std double, n long")
    S.overlap_csv(rate, rate, str(tmp_path / "ov"))
    assert spark.read.csv(str(tmp_path / "ov"), header=True).where("LenBinStart = 'genome_wide'").count() == 1


def test_ancestry_table(spark, tmp_path, dims):
    genome, inds = dims
    p = tmp_path / "fb.tsv"
    p.write_text("#reference_panel_population:\tX\tY\n" + "\t".join(["chromosome", "physical_position", "genetic_position", "genetic_marker_index", "a:::hap1:::X", "a:::hap1:::Y", "a:::hap2:::X", "a:::hap2:::Y"]) + "\n1\t5\t0.1\t4\t0.95\t0.05\t0.5\t0.5\n1\t9\t0.1\t8\t0.02\t0.98\t0.0\t1.0\n")
    positions = spark.createDataFrame([(0, k, k * 10) for k in range(12)], "chrid int, idx long, p long")
    got = sorted(tuple(r) for r in R.read_ancestry(spark, str(p), positions, genome, inds).collect())
    assert got == [(0, 0, "X"), (0, 60, "Y"), (1, 0, "?"), (1, 60, "Y")]


def test_api_and_stream(spark, tmp_path):
    from strandlake import api
    from strandlake.streaming.coverage import stream_cell_coverage

    g = api.GInfo(spark, ["1", "2"], [1000, 2000], {"chr1": 0})
    with pytest.raises(ValueError):
        api.GInfo(spark, ["1", "2"], [1000, 2000], {"2": 0})
    m = api.GMap(g, 100.0)
    assert m.get_cm(spark.createDataFrame([(150,)], "bp long"), "bp").first().cm == 1.5
    assert m.get_bp(spark.createDataFrame([(1.5,)], "cm double"), "cm").first().bp == 150
    segs = spark.createDataFrame([(0, 0, 1, 0, 0, 10, 500), (1, 0, 2, 1, 1, 1200, 1900)], "ind1 long, hap1 int, ind2 long, hap2 int, chrid int, s long, e long")
    s = api.IBD(segs, g)
    assert s.get_coverage(100).agg(F.sum("cov")).first()[0] == 4 + 7
    assert s.get_totals().count() == 2
    sites = spark.createDataFrame([(0, 50, 0.3), (1, 1300, 0.4)], "chrid int, pos long, freq double")
    assert s.get_xirs(sites, 6).count() == 2
    r = api.RVar(spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 1, 1)], "pos long, genome long, allele long"))
    assert r.get_jaccard().first().jaccard == 0.5
    with pytest.raises(ValueError):
        r.get_sites()
    src = tmp_path / "in"
    segs.write.parquet(str(src))
    q = stream_cell_coverage(spark.readStream.schema(segs.schema).parquet(str(src)), 300).writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.chrid, r.cell): r.bp for r in spark.table("cells").collect()} == {(0, 0): 290, (0, 1): 200, (1, 4): 300, (1, 5): 300, (1, 6): 100}


def test_binary_segments_in_several_files(spark, tmp_path):
    rows = [(k % 5 + 1, 0, 0, 1, 10 * (k % 7), 10 * (k % 7) + 5) for k in range(23)] + [(9, 1, 2, 0, 4, 8)] * 9
    seg = spark.createDataFrame(rows, "ind1 long, hap1 long, ind2 long, hap2 long, s long, e long")
    path = tmp_path / "x.eibd"
    S.write_eibd(seg, str(path), most=10, each=4)
    parts = [p.read_bytes() for p in sorted(path.glob("*.eibd"))]
    assert all(0 < (len(p) - 8) // 16 <= 4 and struct.unpack("<Q", p[:8]) == ((len(p) - 8) // 16,) for p in parts)
    assert b"".join(p[8:] for p in parts) == S.eibd_bytes(seg)[8:]
    assert sorted(map(tuple, R.read_eibd(spark, str(path)).collect())) == sorted(rows)


def test_bool_matrix_of_many_columns(spark, tmp_path):
    """Ragged last words, empty rows, repeated cells, cells outside; as many columns as would take minutes by searching a row's list for each."""
    for n_rows, n_cols in ((3, 1), (3, 64), (4, 130), (2, 200_001)):
        want = sorted({(r, c) for r in range(0, n_rows, 2) for c in range(0, n_cols, 3)} | {(0, n_cols - 1)})
        cells = spark.createDataFrame([*want, *want[:5], (0, n_cols), (n_rows, 0)], "row long, col long")
        path = str(tmp_path / f"m{n_cols}")
        S.write_bool_matrix(cells, n_rows, n_cols, path)
        raw = spark.read.parquet(path)
        assert raw.columns == [str(n_cols)] and raw.count() == n_rows * n_cols
        assert sorted(map(tuple, R.read_bool_matrix(spark, path).collect())) == want


def test_header_is_first_in_large_named_texts(spark, tmp_path):
    from strandlake.sources.scratch import write_named_text

    lines = spark.range(0, 400_000, 1, 8).selectExpr("concat('c', id % 2) AS chrom", "concat('line ', id) AS value")
    for gz in (False, True):
        path = str(tmp_path / f"t{gz}")
        write_named_text(lines, path, "chrom", "a header", gz, ".txt.gz" if gz else ".txt")
        for k in range(2):
            with (gzip.open if gz else open)(f"{path}/c{k}.txt" + (".gz" if gz else ""), "rt") as f:
                got = f.read().splitlines()
            assert got[0] == "a header" and sorted(got[1:]) == sorted(f"line {x}" for x in range(k, 400_000, 2))
