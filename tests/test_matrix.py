from strandlake.operators import matrix as M


def test_pair_index(spark):
    got = M.from_pair_index(spark.range(6).withColumnRenamed("id", "idx")).orderBy("idx").collect()
    assert [(r.i, r.j) for r in got] == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    far = M.from_pair_index(spark.createDataFrame([(k * (k - 1) // 2 + d,) for k in (10**6, 10**7) for d in (0, k - 1)], "idx long")).collect()
    assert [(r.i, r.j) for r in far] == [(10**6, 0), (10**6, 10**6 - 1), (10**7, 0), (10**7, 10**7 - 1)]


def test_order_and_equality(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 4)], "k int, o int, v int")
    assert M.is_sorted(a.where("o < 3"), ["v"], ["o"], ["k"]) and not M.is_sorted(a, ["v"], ["o"], ["k"])
    assert M.is_equal(a, a.orderBy("v")) and not M.is_equal(a, a.union(a.limit(1)))
    inds = spark.createDataFrame([(0, "a"), (1, "b")], "ind int, name string")
    assert M.same_individuals(inds, inds)
    assert M.union_all([a, a, a]).count() == 9


def test_paths():
    assert M.with_extension("/x/y.ibd.gz", "eibd") == "/x/y.eibd"
    assert M.with_extension("y", ".rec") == "y.rec"


def test_pairs_in_tiles(spark):
    names = [3, 7, 7, 1, 9, None, 4]
    ids = spark.createDataFrame([(x,) for x in names], "id long")
    want = sorted((x, y) for x in names for y in names if x is not None and y is not None and x > y)
    for tiles in (1, 3, 32):
        assert sorted(map(tuple, M.triangle(ids, tiles).collect())) == want
    words = ids.selectExpr("'n' || id AS id")
    assert sorted(map(tuple, M.triangle(words, 3).collect())) == [(f"n{x}", f"n{y}") for x, y in want]
    assert sorted(map(repr, M.cross(ids, ids, 3).collect())) == sorted(map(repr, ids.toDF("x").crossJoin(ids.toDF("y")).collect()))


def test_pairs_are_not_shuffled(spark):
    """The pairs' number grows with the square of the ids': only ids may go through an exchange, in as many partitions whatever their size."""
    from strandlake.operators import rare

    ids = spark.range(50)
    for df in (rare.id_pairs(ids, ids), M.pair_blocks(ids, ids.where("id % 2 = 0")), M.triangle(ids)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
        above = plan[: plan.index("SortMergeJoin")]
        assert "Exchange" not in above.replace("BroadcastExchange", "") and "Aggregate" not in above
        assert df.rdd.getNumPartitions() >= M.TILE_PARTS


def test_ids_of_one_list(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id long") for xs in ([1, 1, 2, None], [1, 3]))
    assert sorted(map(repr, M.id_difference(a, b).collect())) == ["Row(id=2)", "Row(id=None)"]
    # an id that one list has twice and the other once is in both
    assert sorted(map(tuple, M.pair_blocks(a.where("id is not null"), b).collect())) == [(2, 3, "between")]
