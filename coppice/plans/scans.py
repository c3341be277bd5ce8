"""Running values over ordered rows of a key, in blocks, so that a hot key is spread over all tasks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.plans.staging import stage

#: Rows of a block: what a window sorts in one task at most (but for rows that are equal in order).
BLOCK_ROWS = 1_000_000


@dataclass(frozen=True)
class Running:
    """count, sum, max, last (of non-null values) or lag (of any value) of the rows up to this one; strict leaves it out, backward starts at the end."""

    kind: str
    value: Column | None = None
    strict: bool = False
    backward: bool = False


def blocked(rows: DataFrame, order: list[str], block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """rows with _block, which ascends with the order, and the number of blocks.

    Blocks are the partitions of a range exchange over all rows, whatever their keys, so they
    are about equally full, and a key with very many rows has rows in many of them. They are
    staged, as a partition's number must not change between two reads.
    """
    parts = -(-rows.count() // block_rows)
    if parts <= 1:
        return rows.withColumn("_block", F.lit(0)), 1
    return stage(rows.repartitionByRange(parts, *order).withColumn("_block", F.spark_partition_id())), parts


def joined_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left join by keys, null keys being equal."""
    renamed = right.withColumnsRenamed({k: f"_its_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_its_{k}")) for k in keys])
    return left.join(renamed, on, "left").drop(*[f"_its_{k}" for k in keys])


def scanned(rows: DataFrame, keys: list[str], order: list[str], wanted: dict[str, Running], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with a column for each running value over the rows of their keys (all rows, if there are no keys), in the order given.

    A segmented scan: each block of a key is scanned alone; the blocks' totals, a row a key and
    block, are scanned in their turn; what comes in from the blocks before is added. Rows that
    are equal in order share a block, and stand in any order in it. Null keys are a key.
    """
    made, parts = blocked(rows, order, block_rows)
    place = F.struct(*order)
    inner, totals, carried, out = {}, [], {}, {}
    for name, r in wanted.items():
        value = {"count": F.lit(1), "lag": F.struct(r.value.alias("v")) if r.value is not None else None}.get(r.kind, r.value)
        strict = r.strict or r.kind == "lag"
        w = Window.partitionBy(*keys, "_block").orderBy(*order)
        w = w.rowsBetween(1 if strict else 0, Window.unboundedFollowing) if r.backward else w.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        over = Window.partitionBy(*keys).orderBy("_block")
        over = over.rowsBetween(1, Window.unboundedFollowing) if r.backward else over.rowsBetween(Window.unboundedPreceding, -1)
        pick = F.first if r.backward else F.last
        if r.kind in ("count", "sum"):
            inner[f"_in_{name}"], totals = F.sum(value).over(w), [*totals, F.sum(value).alias(f"_all_{name}")]
            carried[f"_from_{name}"] = F.sum(f"_all_{name}").over(over)
            both = F.coalesce(F.col(f"_in_{name}") + F.col(f"_from_{name}"), F.col(f"_in_{name}"), F.col(f"_from_{name}"))
            out[name] = F.coalesce(both, F.lit(0)).cast("long") if r.kind == "count" else both
        elif r.kind == "max":
            inner[f"_in_{name}"], totals = F.max(value).over(w), [*totals, F.max(value).alias(f"_all_{name}")]
            carried[f"_from_{name}"] = F.max(f"_all_{name}").over(over)
            out[name] = F.greatest(f"_in_{name}", f"_from_{name}")  # leaves nulls out
        elif r.kind in ("last", "lag"):
            some = (F.min_by if r.backward else F.max_by)(value, F.when(value.isNotNull(), place))
            inner[f"_in_{name}"], totals = pick(value, True).over(w), [*totals, some.alias(f"_all_{name}")]
            carried[f"_from_{name}"] = pick(f"_all_{name}", True).over(over)
            got = F.coalesce(f"_in_{name}", f"_from_{name}")
            out[name] = got["v"] if r.kind == "lag" else got
        else:
            raise ValueError(f"no running value is called {r.kind}")
    done = made.withColumns(inner)
    if parts == 1:
        done = done.withColumns({c: F.lit(None).cast(done.schema[c.replace("_from_", "_in_")].dataType) for c in carried})
    else:
        sums = made.groupBy(*keys, "_block").agg(*totals).withColumns(carried)
        done = joined_by(done, sums.select(*keys, "_block", *carried), [*keys, "_block"])
    return done.select(*rows.columns, *[c.alias(name) for name, c in out.items()])
