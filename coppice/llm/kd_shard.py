"""Sharding by a k-d tree: split at weighted medians along the widest metadata dimension. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.llm.common import maybe_broadcast, stage

#: A split key has 48 bits: 12 of the dimension's cell, 24 of the text's hash, 12 of the row's hash.
DIGIT_BITS, DIGITS = 12, 4
CELLS = 1 << DIGIT_BITS
#: Cells of a histogram lighter than this share of their node are not divided further.
TOLERANCE = 1e-4
#: Slots are numbered inside so many buckets of a shard, then offset.
SLOT_BUCKETS = 1024


def text_dimensions(text: Column) -> dict[str, Column]:
    """Metadata that depends on the text alone, each as a cell from 0 to 4095; equal texts get equal cells."""
    size, chars = F.octet_length(text) + 1, F.greatest(F.char_length(text), F.lit(1))
    spaces = F.char_length(text) - F.char_length(F.replace(text, F.lit(" ")))
    cell = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(CELLS - 1)).cast("long")
    return {
        "length": cell(F.log2(size) * 128),
        "width": cell((F.octet_length(text) / chars - 1) / 3 * CELLS),
        "spacing": cell(spaces / chars * CELLS),
    }


def _picked(dims: list[str]) -> Column:
    """The row's key in the dimension that its node is split on."""
    return F.coalesce(*[F.when(F.col("dim") == i, F.col(f"_k_{d}")) for i, d in enumerate(dims)])


def _cuts(rows: DataFrame, nodes: DataFrame, dims: list[str]) -> DataFrame:
    """node, dim, leaves, first, cut: for each node (node, dim, leaves, first, total, want) the largest key of its left part.

    The weight up to the cut is as near to `want` as a histogram of 4096 cells can tell, refined
    inside the cell where it is reached, a digit of the key at a time, until that cell is light
    or the key is at its end.
    """
    held = ["node", "dim", "leaves", "first", "total", "want"]
    open_ = stage(nodes.select(*held, F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")))
    done: DataFrame | None = None
    for digit in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - digit)
        few, _ = maybe_broadcast(open_)
        cells = (
            rows.join(few, "node").withColumn("key", _picked(dims)).filter(F.shiftright("key", shift + DIGIT_BITS) == F.col("prefix"))
            .groupBy("node", F.shiftright("key", shift).bitwiseAND(CELLS - 1).alias("cell")).agg(F.sum("size").alias("w"))
        )
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))  # at most 4096 rows a node
        reached = cells.withColumn("upto", upto).join(few, "node").filter(F.col("before") + F.col("upto") >= F.col("want"))
        at = reached.groupBy(*held, "prefix", "before").agg(F.min(F.struct("cell", "w", "upto")).alias("c"))
        low = F.shiftleft("prefix", DIGIT_BITS).bitwiseOR(F.col("c.cell"))
        start = F.col("before") + F.col("c.upto") - F.col("c.w")
        at = stage(at.select(*held, low.alias("prefix"), start.alias("before"), F.col("c.w").alias("w")))
        ends = F.lit(digit == DIGITS - 1) | (F.col("w") <= TOLERANCE * F.col("total"))
        with_it = F.abs(F.col("before") + F.col("w") - F.col("want")) <= F.abs(F.col("before") - F.col("want"))
        cut = F.shiftleft(F.col("prefix") + F.when(with_it, 1).otherwise(0), shift) - 1
        found = at.filter(ends).select("node", "dim", "leaves", "first", cut.alias("cut"))
        done = found if done is None else done.union(found)
        open_ = at.filter(~ends).select(*held, "prefix", "before")
        if open_.isEmpty():
            break
    return stage(done)


def kd_shard(docs: DataFrame, n_shards: int = 8, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row.

    Law `bytes`: each split halves the bytes of its node along its widest dimension (or cuts
    them in proportion to the leaves on either side), exact to one row or 0.01 % of the node.
    Rows that tie on a dimension are ordered by text hash, then by a hash of id and row, so
    equal texts stay together unless a cut falls inside their group, and a group of repeated
    rows may be cut anywhere. With target_bytes, leaves are as many as keep each at or under
    the target. Null text counts as empty (size 1); a very long text is one row like any other
    and may make its shard the larger by itself; null ids are rows like any other; repeated
    rows get slots of their own; an empty table gives no rows; other columns are not read.

    Scale: texts are read once and never shuffled. Each level costs one min/max pass and one
    to four histogram passes over a narrow staged table; histograms have 4096 cells a node. The
    tree is a table: its nodes are broadcast up to a bound and joined by a shuffle beyond it,
    and the driver sees counts only. Slots come from 1024 hash buckets a shard, so no shard is
    numbered in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cells = dimensions or text_dimensions(text)
    dims = list(cells)
    row = F.monotonically_increasing_id()
    within = F.xxhash64(text).bitwiseAND((1 << 24) - 1) * F.lit(CELLS) + F.xxhash64(F.col(id_col), row).bitwiseAND(CELLS - 1)
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), text, row), F.lit(SLOT_BUCKETS)).alias("bucket"),
        *[(c * F.lit(1 << 36) + within).alias(f"_k_{d}") for d, c in cells.items()],
    ))
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, -(-total // target_bytes))
    one = F.lit(1).cast("long")
    # a node knows how many leaves it has and the number of its first one
    rows = rows.withColumns({"node": one, "leaves": F.lit(n_shards).cast("long"), "first": F.lit(0).cast("long")})
    for _ in range((n_shards - 1).bit_length()):
        spread = [(F.max(F.shiftright(f"_k_{d}", 36)) - F.min(F.shiftright(f"_k_{d}", 36))).alias(f"r_{i}") for i, d in enumerate(dims)]
        seen = rows.filter("leaves > 1").groupBy("node", "leaves", "first").agg(F.sum("size").alias("total"), *spread)
        widest = F.greatest(*[F.col(f"r_{i}") for i in range(len(dims))]) if len(dims) > 1 else F.col("r_0")
        dim = F.coalesce(*[F.when(F.col(f"r_{i}") == widest, i) for i in range(len(dims))])
        left = F.ceil(F.col("leaves") / 2)
        nodes = stage(seen.select("node", dim.alias("dim"), "leaves", "first", "total", (F.col("total") * left / F.col("leaves")).alias("want")))
        cuts, _ = maybe_broadcast(_cuts(rows.select("node", "size", *[f"_k_{d}" for d in dims]), nodes, dims).select("node", "dim", "cut"))
        split = rows.join(cuts, "node", "left")
        right, inner = _picked(dims) > F.col("cut"), F.col("cut").isNotNull()
        rows = stage(split.select(
            "doc_id", "size", "text_crc32", "bucket", *[f"_k_{d}" for d in dims],
            F.when(inner, F.col("node") * 2 + F.when(right, 1).otherwise(0)).otherwise(F.col("node")).alias("node"),
            F.when(~inner, F.col("leaves")).when(right, F.col("leaves") - left).otherwise(left).alias("leaves"),
            (F.col("first") + F.when(inner & right, left).otherwise(0)).alias("first"),
        ))
    sharded = rows.select("doc_id", "size", "text_crc32", "bucket", F.col("first").cast("int").alias("shard"))
    counts = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 1024 rows a shard
    start, _ = maybe_broadcast(stage(counts.select("shard", "bucket", before.alias("start"))))
    place = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return sharded.withColumn("place", F.row_number().over(place)).join(start, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return kd_shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards=8)
