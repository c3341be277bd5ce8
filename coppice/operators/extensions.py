"""Name rows, canonical order, caps, guarded inserts, and extension points (gates, splitters)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.operators.refs import violations
from coppice.operators.tree import append_child
from coppice.registration import Registry
from coppice.sources.adapters import EDGES_SQL, NODES_SQL, SEGMENTS_SQL, edges, nodes, read, segments, with_sql

REG = Registry()

#: Bytes of texts in one batch for Python, and in one run of rows that are Python strings at once.
BATCH_BYTES, RUN_BYTES = 4 << 20, 1 << 20


def name_rows(segs: DataFrame, pattern: str) -> DataFrame:
    """PRJ-9 (re-aimed): module, child_index, name, offset: the token that the declaration pattern's first group names.

    The match is by text and offset, so an equal word earlier in the segment (in a remark,
    say) is not taken for the name. Whether a whole token stands at the offset is told by the
    segment alone: a word character before it, or more of them after the name, and there is
    none. So a segment's tokens are no rows, and nothing is shuffled.
    """
    name = F.regexp_extract("payload", pattern, 2)
    at = F.char_length(F.regexp_extract("payload", pattern, 1))
    before, rest = F.substr("payload", at, F.lit(1)), F.substr("payload", at + 1)
    whole = (F.regexp_extract(rest, r"^\w+", 0) == name) & (name != "") & ((at == 0) | ~before.rlike(r"\w"))
    return segs.filter(F.col("payload").rlike(pattern) & whole).select("module", "child_index", name.alias("name"), at.cast("long").alias("offset"))


@REG.add("prj_name_rows", with_sql(r"""
SELECT module, child_index, regexp_extract(payload, '^([A-Z][a-z]+ [a-z]+ )([a-z]+)\b', 2) AS name, length(regexp_extract(payload, '^([A-Z][a-z]+ [a-z]+ )([a-z]+)\b', 1)) AS "offset"
FROM seg WHERE regexp_matches(payload, '^([A-Z][a-z]+ [a-z]+ )([a-z]+)[ .,]')""", seg=SEGMENTS_SQL))
def prj_name_rows(spark, sf_dir):
    """The third word of lines that begin with two plain words."""
    return name_rows(segments(spark, sf_dir), r"^([A-Z][a-z]+ [a-z]+ )([a-z]+)[ .,]")


@REG.add("srt_canonical_order", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS place FROM part")
def srt_canonical_order(spark, sf_dir):
    """SRT-1: order by UTF-8 bytes, Spark's own for strings, within each brand."""
    return read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")).cast("long").alias("place"))


@REG.add("srt_capped_ids", """
SELECT l_partkey, count(DISTINCT l_orderkey) AS total, count(DISTINCT l_orderkey) > 64 AS truncated, count(DISTINCT l_orderkey) FILTER (WHERE r <= 64) AS listed FROM (
  SELECT l_partkey, l_orderkey, dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS r FROM lineitem) GROUP BY l_partkey""")
def srt_capped_ids(spark, sf_dir, cap: int = 64):
    """SRT-5: id lists capped at 64, with the total and a flag (the cap is the feature)."""
    ids = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    total = ids.groupBy("l_partkey").agg(F.count("*").alias("total"))
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey"))).filter(F.col("r") <= cap).groupBy("l_partkey").agg(F.count("*").alias("listed"))
    return total.join(first, "l_partkey").select("l_partkey", "total", (F.col("total") > cap).alias("truncated"), "listed")


def insert_checked(segs: DataFrame, payload: str, allowed: str) -> DataFrame:
    """EDT-5: a validated row at the end of each module; a payload that does not fit the pattern is refused."""
    if not re.fullmatch(allowed, payload):
        raise ValueError(f"not allowed: {payload!r}")
    return append_child(segs, payload)


@REG.add("edt_insert_row", with_sql("SELECT module, max(child_index) AS child_index, max(child_index) + 1 AS closing FROM seg GROUP BY module", seg=SEGMENTS_SQL))
def edt_insert_row(spark, sf_dir):
    """Where the new import went, and where the closing row is now."""
    grown = insert_checked(segments(spark, sf_dir), "import a from b\n", r"import \w+ from \w+\n")
    return grown.groupBy("module").agg(F.max(F.when(F.col("was").isNull(), F.col("child_index"))).alias("child_index"), F.max("child_index").alias("closing"))


def gates(*checks: tuple[str, DataFrame]) -> DataFrame:
    """UDX-2: extra acceptance gates, each a violations table (key, n), as one table: gate, violations, pass."""
    out = None
    for name, df in checks:
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations", (F.col("violations") == 0).alias("pass"))
        out = one if out is None else out.union(one)
    return out


@REG.add("udx_gates", with_sql("""
SELECT 'integrity' AS gate, count(DISTINCT to_id) AS violations, count(DISTINCT to_id) = 0 AS pass FROM edges WHERE to_id NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'named', count(*), count(*) = 0 FROM nodes WHERE payload = ''
UNION ALL SELECT 'small_orders', count(*), count(*) = 0 FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 7)""", nodes=NODES_SQL, edges=EDGES_SQL))
def udx_gates(spark, sf_dir):
    tree = nodes(spark, sf_dir)
    big = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().filter("count > 7")
    return gates(("integrity", violations(tree, edges(spark, sf_dir))), ("named", tree.filter("payload = ''")), ("small_orders", big))


def split_rows(rows: DataFrame, splitter: Callable[[str], list[str]], id_col: str = "module") -> DataFrame:
    """UDX-3: any Python splitter of a text, one row in and many out, in batches: id, place, piece.

    Texts come to Python in batches of BATCH_BYTES, and are Python strings with their pieces for
    some RUN_BYTES at a time, so a task's memory does not grow with the table; a text and its pieces are held whole.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    most = RUN_BYTES

    def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, at = pc.binary_length(batch.column(1)).to_pylist(), 0
        while at < batch.num_rows:
            end, held = at + 1, sizes[at] or 0
            while end < batch.num_rows and held + (sizes[end] or 0) <= most:
                held, end = held + (sizes[end] or 0), end + 1
            yield batch.slice(at, end - at)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                ids, made = part.column(0).to_pylist(), [splitter(text or "") for text in part.column(1).to_pylist()]
                owner = pa.array([i for i, m in zip(ids, made, strict=True) for _ in m], pa.int64())
                places, pieces = [place for m in made for place in range(len(m))], [piece for m in made for piece in m]
                yield pa.RecordBatch.from_arrays([owner, pa.array(places, pa.int64()), pa.array(pieces, pa.string())], ["id", "place", "piece"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, place long, piece string")


@REG.add("udx_split", "SELECT id, place - 1 AS place, md5(parts[place]) AS piece_md5 FROM (SELECT doc_id AS id, string_split(text, '. ') AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS place)")
def udx_split(spark, sf_dir):
    made = split_rows(read(spark, sf_dir, "documents"), lambda t: t.split(". "), "doc_id")
    return made.select("id", "place", F.md5("piece").alias("piece_md5"))


QUERIES, SQL = REG.queries, REG.sql
