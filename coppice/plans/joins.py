"""Range joins by binning, as-of joins by union and window, null-safe differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.plans.scans import BLOCK_ROWS, Running, scanned


#: Rows of one task of a join of large tables, and so many tasks at least, or Spark deals the rows.
TASK_ROWS, TASKS = 500_000, 8


def dealt(keys: list[str], *sides: DataFrame, counted: list[DataFrame] | None = None, task_rows: int | None = None) -> list[DataFrame]:
    """The sides of a join by keys over so many partitions that a task gets some task_rows of the largest; sides of few rows stay as they are.

    Left alone, Spark puts partitions together until they are as few as its cores, so what a
    task sorts grows with the table. The rows of one key still share a task. `counted` stands for sides that are dear
    to count.
    """
    parts = max(s.count() for s in counted or sides) // (task_rows or TASK_ROWS)
    if parts < TASKS:
        return list(sides)
    # with fewer partitions than the session's Spark would shuffle again
    parts = max(parts, int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return [s.repartition(parts, *keys) for s in sides]


def containing_span(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, bin_width: int = 1024) -> DataFrame:
    """Each point with the spans of its keys for which start <= point < end.

    A span is listed under every bin it touches and a point under its own, so the join is an
    equi-join on keys and bin with a filter, and a long document is dealt over many tasks.
    """
    binned = spans.filter(F.col(end) > F.col(start)).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor((F.col(end) - 1) / bin_width)))
    )
    at = points.withColumn("_bin", F.floor(F.col(point) / bin_width))
    return at.join(binned, [*keys, "_bin"]).filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop("_bin")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], forward: bool = False, strict: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """left with the `take` columns of the nearest right row at or before it (after it, if forward), by keys.

    Both sides go in one segmented scan, so no pair of rows is compared and a hot key is spread over tasks; strict leaves equal
    times out. left keeps its rows, with nulls where nothing is found.
    """
    kind = right.select(F.struct(*take)).schema[0].dataType
    # at equal times the right row counts as before the left one, unless forward or strict turns that round
    rank = F.lit(0 if forward == strict else 1)
    mine = left.select("*", F.col(left_at).alias("_at"), F.lit(True).alias("_left"), F.lit(0.5).alias("_rank"), F.lit(None).cast(kind).alias("_got"))
    other = right.select(*keys, F.col(right_at).alias("_at"), F.lit(False).alias("_left"), rank.cast("double").alias("_rank"), F.struct(*take).alias("_got"))
    both = mine.unionByName(other, allowMissingColumns=True).withColumnRenamed("_got", "_had")
    both = scanned(both, keys, ["_at", "_rank"], {"_got": Running("last", F.col("_had"), backward=forward)}, block_rows)
    return both.filter("_left").select(*left.columns, *[F.col("_got")[c].alias(c) for c in take])


def changed(a: str, b: str, columns: list[str]) -> Column:
    """True where any of the columns differs between struct columns a and b, nulls being equal."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out
