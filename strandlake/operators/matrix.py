"""Long matrices (row, col, value), pair numbering, order checks and id sets."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePath

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def subset(m: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cells whose row is in rows (name) and whose column is in cols (name)."""
    return m.join(rows.select(F.col("name").alias("row")), "row", "left_semi").join(cols.select(F.col("name").alias("col")), "col", "left_semi").select("row", "col", "value")


def update(m: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of m, with the values of ``other`` where it has the cell."""
    o = other.select("row", "col", F.col("value").alias("_v"), F.lit(True).alias("_has"))
    return m.join(o, ["row", "col"], "left").select("row", "col", F.when(F.col("_has"), F.col("_v")).otherwise(F.col("value")).alias("value"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def is_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, as often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def is_sorted(df: DataFrame, by: list[str], order: list[str], keys: list[str]) -> bool:
    """Whether the rows of each key, in the order of ``order``, never fall in ``by``."""
    s = F.struct(*by)
    before = F.lag(s).over(W.partitionBy(*keys).orderBy(*order))
    return df.select((before > s).alias("bad")).where("bad").isEmpty()


def with_pair_index(df: DataFrame, i: str, j: str) -> DataFrame:
    """Adds idx, the place of (i, j) with i > j in the lower triangle."""
    return df.withColumn("idx", ((F.col(i) - 1) * F.col(i) / 2).cast("long") + F.col(j))


def from_pair_index(df: DataFrame) -> DataFrame:
    """Adds i and j of idx; exact for idx below 2**50."""
    near = F.floor((1 + F.sqrt(1 + 8 * F.col("idx").cast("double"))) / 2)
    tri = lambda x: ((x - 1) * x / 2).cast("long")
    i = F.when(tri(near) > F.col("idx"), near - 1).when(tri(near + 1) <= F.col("idx"), near + 1).otherwise(near)
    return df.withColumn("i", i.cast("long")).withColumn("j", F.col("idx") - tri(F.col("i")))


def listed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, in_a, in_b) of the ids (id) of two lists, each once."""
    both = a.select("id", F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(b.select("id", F.lit(False).alias("in_a"), F.lit(True).alias("in_b")))
    return both.groupBy("id").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def id_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids (id) of one list that the other doesn't have, each once."""
    return listed(a, b).where("in_a and not in_b").select("id")


def search_names(inds: DataFrame, text: str, most: int = 5) -> DataFrame:
    """The first individuals (ind, name) whose name has a text: a top list of ``most``."""
    return inds.where(F.contains("name", F.lit(text))).orderBy("ind").limit(most)


#: Tiles that ids are dealt to for pairs, and partitions of pairs of tiles.
TILES, TILE_PARTS = 32, 256


def _quantile_cell(df: DataFrame, col: str, bins: int, error: float):
    """The bin of a numeric column between quantiles, of which a list of at most ``bins`` numbers is collected."""
    cuts = sorted(set(df.approxQuantile(col, [k / bins for k in range(1, bins)], error))) if bins > 1 else []
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x <= F.col(col).cast("double"))) if cuts else F.lit(0)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two sides that have the same pair of tiles (_at): one sorted join in a fixed number of partitions, as the pairs, not the ids, are the work."""
    return left.repartition(TILE_PARTS, "_at").hint("merge").join(right.repartition(TILE_PARTS, "_at").hint("merge"), "_at").drop("_at")


def triangle(ids: DataFrame, tiles: int = TILES) -> DataFrame:
    """Pairs of rows with id x > y; further columns come with the suffixes _x and _y.

    Numeric ids are dealt to tiles by quantiles, others by hash; each is copied once for each tile it meets.  A task holds
    one tile's ids, and nothing of the pairs is shuffled.
    """
    rest = [c for c in ids.columns if c != "id"]
    known = ids.where("id is not null")
    numeric = dict(ids.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    tile = _quantile_cell(known, "id", tiles, 0.001) if numeric else F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    t = known.withColumn("_t", tile)
    side = lambda s: [F.col("id").alias(s), F.col("_t").alias(f"_t{s}"), *[F.col(c).alias(f"{c}_{s}") for c in rest]]
    left = t.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("_t")), lambda u: F.col("_t") * tiles + u)).alias("_at"), *side("x"))
    right = t.select(F.explode(F.transform(F.sequence(F.col("_t"), F.lit(tiles - 1)), lambda u: u * tiles + F.col("_t"))).alias("_at"), *side("y"))
    met = _met(left, right).where("_tx <> _ty or x > y")
    turned = lambda a, b: F.when(F.col("x") > F.col("y"), F.col(a)).otherwise(F.col(b))
    names = ["x", *[f"{c}_x" for c in rest]]
    other = ["y", *[f"{c}_y" for c in rest]]
    return met.select(*[turned(a, b).alias(a) for a, b in zip(names, other, strict=True)], *[turned(b, a).alias(b) for a, b in zip(names, other, strict=True)])


def cross(first: DataFrame, second: DataFrame, tiles: int = TILES) -> DataFrame:
    """Each id x of one list with each id y of the other, dealt to tiles as in :func:`triangle`."""
    tile, every = F.pmod(F.xxhash64("id"), F.lit(tiles)), F.sequence(F.lit(0), F.lit(tiles - 1))
    left = first.select(F.explode(F.transform(every, lambda u: tile * tiles + u)).alias("_at"), F.col("id").alias("x"))
    right = second.select(F.explode(F.transform(every, lambda u: u * tiles + tile)).alias("_at"), F.col("id").alias("y"))
    return _met(left, right).select("x", "y")


def pair_blocks(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b, part) of two id lists (id): ids of one list alone against ids of the other alone, and a > b of ids in both."""
    ids = listed(first, second)
    only1, only2, both = (ids.where(x).select("id") for x in ("in_a and not in_b", "in_b and not in_a", "in_a and in_b"))
    between = cross(only1, only2).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit("between").alias("part"))
    return between.unionByName(triangle(both).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit("within").alias("part")))


def ordered(df: DataFrame, by: list[str], keys: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place within its key in the order of ``by`` (the permutation of a sort)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*by)) - 1)


def numbered(df: DataFrame, by: list[str], name: str = "place", bins: int = 256) -> DataFrame:
    """Adds each row's number, from 1, in the order of ``by`` over the whole frame.

    Rows are dealt to bins at quantiles of the first (numeric) column, of which a list of at most ``bins`` numbers is collected; a row's number is
    that inside its bin after the sizes of the bins before, so no task holds more than a bin (rows of one value are in one).
    """
    binned = df.withColumn("_cell", _quantile_cell(df, by[0], bins, 0.0005))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over a row a bin
    sizes = binned.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_before", before).select("_cell", "_before")
    inside = F.row_number().over(W.partitionBy("_cell").orderBy(*by))
    return binned.withColumn(name, inside.cast("long")).join(F.broadcast(sizes), "_cell").withColumn(name, F.col(name) + F.col("_before")).drop("_cell", "_before")


def same_individuals(a: DataFrame, b: DataFrame) -> bool:
    """Whether two individual lists (ind, name) are equal in order."""
    return is_equal(a.select("ind", "name"), b.select("ind", "name"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_extension(path: str, extension: str) -> str:
    """The path with all its extensions replaced by one."""
    p = PurePath(path)
    return str(p.with_name(p.name.split(".")[0] + "." + extension.lstrip(".")))
