"""Running coverage of segments as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_cell_coverage(segs: DataFrame, width: int, time: str | None = None, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Covered bp and segments of each cell of ``width`` bp, kept up to date over a stream of (chrid, s, e).

    With an event-time column the counts are per window and late rows beyond ``late`` are let go.
    """
    cells = segs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    shared = F.least(F.col("e"), (F.col("cell") + 1) * width) - F.greatest(F.col("s"), F.col("cell") * width)
    keys = ["chrid", "cell"]
    if time:
        cells = cells.withWatermark(time, late)
        keys = [F.window(time, window), *map(F.col, keys)]
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(shared).alias("bp"))
