"""Helpers that the corpus operators share: staging, size-checked broadcasts, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.staging import shared_dir, ship_package, stage

__all__ = ["BROADCAST_ROWS", "ROW", "TIE", "bit_map", "columns_of", "drop_rows", "free_name", "keep_smallest", "maybe_broadcast", "rows_of", "shared_dir", "ship", "stage", "table", "with_marks", "with_rows"]

#: Columns that with_rows adds.
ROW, TIE = "coppice_row", "coppice_tie"

#: Rows of a narrow key table (some 50 bytes a row) that may be broadcast: 1,000,000 rows are about 50 MB.
BROADCAST_ROWS = 1_000_000

#: Texts go to Python in batches of so many bytes, or one text where that is longer: both sides hold a batch in full.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that they need no copy of their own; and keeps Arrow batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """df hinted for broadcast if a count shows that it is within the bound; the other way is a shuffled join that AQE may split."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of df (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bit maps have between these powers of two of bits: 64 MB at most. One row of a map has 2 ** 15, as bitmap_construct_agg makes them.
MAP_LEAST, MAP_MOST = 15, 29


def bit_map(hashes: DataFrame, n: int, most: int = MAP_MOST) -> tuple[DataFrame, int]:
    """Rows (coppice_cell, coppice_bits) of a bit map in which each of n hashes (one long column, hash) is set at 16 bits a hash, and its size in bits.

    A map of the largest size fills up beyond some 30 million hashes; it then says yes more often than it need.
    """
    size = 1 << min(most, max(MAP_LEAST, (16 * n).bit_length()))
    slot = F.col("hash").bitwiseAND(size - 1)
    cells = hashes.groupBy(F.bitmap_bucket_number(slot).alias("coppice_cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("coppice_bits"))
    return stage(cells), size


def with_marks(df: DataFrame, hash_: Column, cells: DataFrame, size: int) -> DataFrame:
    """df with coppice_hit: whether the map has the hash's bit. The map is broadcast; its size is bounded."""
    slot = hash_.bitwiseAND(size - 1)
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("coppice_bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("coppice_cell", F.bitmap_bucket_number(slot)).join(F.broadcast(cells), "coppice_cell", "left")
    return found.withColumn("coppice_hit", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("coppice_cell", "coppice_bits")


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[list[list]]:
    """Column lists of a few hundred rows at a time, so that only these texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [c.to_pylist() for c in part.columns]


def _scan_of(docs: DataFrame) -> bool:
    """Whether docs is Parquet files as they are, or columns of them: then each row has a file and a place."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "Project":
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().toString().lower().startswith("parquet")


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row (ROW), and a hash of its columns (TIE).

    The key must be the same at every read: of Parquet files, and of a selection of their
    columns, it is the number of the file and the place in it, and any other input is staged
    with a number. Columns of docs that have names used here, in any case, get underscores
    before them; drop_rows gives the old names back.
    """
    own = (ROW, TIE, "coppice_path", "coppice_file", "coppice_at", "_metadata")
    names = [free_name(docs, "_" + c) if c.lower() in own else c for c in docs.columns]
    tie = F.xxhash64(*[c for c, (_, kind) in zip(columns_of(docs), docs.dtypes, strict=True) if "map<" not in kind]).alias(TIE)
    mine = [c.alias(n) for c, n in zip(columns_of(docs), names, strict=True)]
    if not _scan_of(docs) or "_metadata" in (c.lower() for c in docs.columns):
        return stage(docs.select(*mine, tie, F.monotonically_increasing_id().alias(ROW)))
    # one short row a file; in one partition the numbers have no gaps
    files = stage(docs.select(F.col("_metadata.file_path").alias("coppice_path")).distinct().coalesce(1).withColumn("coppice_file", F.monotonically_increasing_id()))
    placed = docs.select(*mine, tie, F.col("_metadata.file_path").alias("coppice_path"), F.col("_metadata.row_index").alias("coppice_at"))
    files, _ = maybe_broadcast(files)
    key = (F.shiftleft("coppice_file", 36) + F.col("coppice_at")).alias(ROW)
    return placed.join(files, "coppice_path").select(*columns_of(placed)[: len(names)], TIE, key)


def drop_rows(rows: DataFrame, dropped: DataFrame, names: list[str]) -> DataFrame:
    """What with_rows was given, whose columns had these names, without the rows whose key is in dropped (one narrow column, ROW)."""
    keys, _ = maybe_broadcast(dropped)
    return rows.join(keys, ROW, "left_anti").drop(ROW, TIE).toDF(*names)


def keep_smallest(rows: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """One row of each group stays: the one with the smallest non-null id. groups has ROW and component; rows not in it stay."""
    ranked = groups.join(rows.select(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", TIE, ROW).alias("rank")), ROW)
    stay = ranked.groupBy("component").agg(F.min("rank")[ROW].alias(ROW))
    return drop_rows(rows, stage(groups.join(stay, ROW, "left_anti").select(ROW)), names)
