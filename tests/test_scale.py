"""Steps whose work must grow no faster than the input, against plain loops and by their plans."""

import random

from pyspark.sql import functions as F

from strandlake.operators import intervals as I
from strandlake.operators import matrix, rare, rvibd

REC = sorted({(p, g): (p * 1000, g, 1 + (p * 7 + g) % 2 if p % 3 else 1) for p, g in ((random.Random(k).randrange(60), random.Random(k + 999).randrange(9)) for k in range(240))}.values())


def segments():
    r = random.Random(5)
    out = [(a, b, s, s + r.choice([0, 500, 1000, 4000, 9000])) for a in range(9) for b in range(a) for s in (r.randrange(45) * 500 for _ in range(5))]
    return out + out[:20] + [(4, 4, 1000, 9000)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark):
    return spark.createDataFrame(REC, "pos long, genome long, allele long"), spark.createDataFrame(segments(), "g1 long, g2 long, s long, e long")


def test_position_scan_sums_coverage(spark):
    rec, segs = frames(spark)
    got = rvibd.position_scan(rec, segs, 3000)
    want = []
    for p in sorted({x[0] for x in REC}):
        at = [x for x in REC if x[0] == p]
        if len({x[2] for x in at}) > 1 or len(at) < 2:
            continue
        held = {x[1] for x in at}
        ends = [len({a, b} & held) for a, b, s, e in segments() if s <= p < e]
        want.append((p, len(at), ends.count(2), ends.count(1), ends.count(0)))
    assert sorted(map(tuple, got.collect())) == want
    assert "seg_id" not in plan(got)  # no row for each position under a segment


def test_matched_rows_sweep(spark):
    rec, segs = frames(spark)
    got = rvibd.matched_rows(rec, segs, 3000)
    want = []
    for p, a, x in REC:
        for q, b, y in REC:
            if p == q and a > b and x == y:
                s, e = min(((s, e) for g, h, s, e in segments() if (g, h) == (a, b) and s <= p < e), default=(None, None))
                want.append((a, b, p, x, s, e))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(x[4] is None for x in want) and any(x[4] is not None for x in want)
    assert "s_b" not in plan(got)  # no join of positions with the segments over them


def test_stated_pairs_shuffle_records_once(spark):
    rec, _ = frames(spark)
    pairs = spark.createDataFrame([(3, 1), (8, 2), (5, 4)], "g1 long, g2 long")
    got = rare.pair_matches(rec, pairs)
    want = {tuple(r)[:2]: tuple(r) for r in rare.pair_matches(rec).collect()}
    assert {tuple(r) for r in got.collect()} == {want[k] for k in ((3, 1), (8, 2), (5, 4)) if k in want}
    assert not any("pos#" in x and "g2#" in x.split("hashpartitioning")[1] for x in plan(got).splitlines() if "hashpartitioning(pos" in x)


def test_reference_islands_are_hashed(spark):
    rows = [(1, 0, 10), (1, 2, 3), (1, 2, 3), (1, 3, 5), (1, 6, 6), (1, 6, 9), (2, 5, 7), (1, 20, 21)]
    got = I.islands(spark.createDataFrame(rows, "k long, s long, e long"), ["k"], "reference")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 5), (1, 6, 9), (1, 20, 21), (2, 5, 7)]
    assert "SortAggregate" not in plan(got)


def test_id_difference_has_no_join(spark):
    a = spark.range(100).select((F.col("id") % 7).alias("id"))
    got = matrix.id_difference(a, a.where("id > 2"))
    assert sorted(r.id for r in got.collect()) == [0, 1, 2] and "Join" not in plan(got)


def test_positions_of_the_largest_tables_are_on_the_vcf_chromosome(spark):
    from strandlake.plans import roundtrips

    assert roundtrips.vcf_genome(spark).first()["size"] > 360 * 20_000 * 1000
