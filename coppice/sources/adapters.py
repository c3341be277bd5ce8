"""The sample tables as node, edge, log, segment, ticket and sample tables; each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sql(body: str, **ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


def _id(letter: str, *cols: str):
    return F.concat(F.lit(letter), *[F.col(c).cast("string") for c in cols])


def _rank(by: str, *order: str):
    return (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with pos, the place of a line in its order from 0."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").withColumn("pos", _rank("l_orderkey", *order))


LINES_SQL = """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem"""


def nodes(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """id, kind, parent_id, child_index, payload: regions, nations, customers, orders, order lines (numbered ones, if they are at hand)."""
    part = lambda df, i, kind, parent, rank, payload: df.select(
        i.alias("id"), F.lit(kind).alias("kind"), parent.alias("parent_id"), rank.alias("child_index"), F.col(payload).cast("string").alias("payload")
    )
    none, nul = F.lit(None).cast("string"), F.lit(None).cast("long")
    lines = order_lines(spark, sf_dir) if lines is None else lines
    return (
        part(read(spark, sf_dir, "region"), _id("R", "r_regionkey"), "Module", none, nul, "r_name")
        .union(part(read(spark, sf_dir, "nation"), _id("N", "n_nationkey"), "Nation", _id("R", "n_regionkey"), _rank("n_regionkey", "n_nationkey"), "n_name"))
        .union(part(read(spark, sf_dir, "customer"), _id("C", "c_custkey"), "Customer", _id("N", "c_nationkey"), _rank("c_nationkey", "c_custkey"), "c_name"))
        .union(part(read(spark, sf_dir, "orders"), _id("O", "o_orderkey"), "Order", _id("C", "o_custkey"), _rank("o_custkey", "o_orderkey"), "o_orderpriority"))
        .union(part(lines, F.concat(_id("L", "l_orderkey"), F.lit("-"), F.col("pos").cast("string")), "Line", _id("O", "l_orderkey"), F.col("pos"), "l_returnflag"))
    )


NODES_SQL = f"""
SELECT 'R' || r_regionkey AS id, 'Module' AS kind, NULL::VARCHAR AS parent_id, NULL::BIGINT AS child_index, r_name AS payload FROM region
UNION ALL SELECT 'N' || n_nationkey, 'Nation', 'R' || n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1, n_name FROM nation
UNION ALL SELECT 'C' || c_custkey, 'Customer', 'N' || c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1, c_name FROM customer
UNION ALL SELECT 'O' || o_orderkey, 'Order', 'C' || o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, o_orderpriority FROM orders
UNION ALL SELECT 'L' || l_orderkey || '-' || pos, 'Line', 'O' || l_orderkey, pos, l_returnflag FROM ({LINES_SQL})"""


def edges(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, kind: order -> customer (value), line -> part (type); one edge a source."""
    lines = order_lines(spark, sf_dir) if lines is None else lines
    return (
        read(spark, sf_dir, "orders").select(_id("O", "o_orderkey").alias("from_id"), _id("C", "o_custkey").alias("to_id"), F.lit("value").alias("kind"))
        .union(lines.select(F.concat(_id("L", "l_orderkey"), F.lit("-"), F.col("pos").cast("string")), _id("P", "l_partkey"), F.lit("type")))
    )


EDGES_SQL = f"""
SELECT 'O' || o_orderkey AS from_id, 'C' || o_custkey AS to_id, 'value' AS kind FROM orders
UNION ALL SELECT 'L' || l_orderkey || '-' || pos, 'P' || l_partkey, 'type' FROM ({LINES_SQL})"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, session, kind, ts_ms, k, value, params: the events table as an operation log."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.col("event_type").alias("kind"),
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").alias("ts_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value", F.col("props").alias("params"),
    )


LOG_SQL = """
SELECT event_id AS seq, user_id AS session, event_type AS kind, epoch_us(ts) // 1000 AS ts_ms, (props::JSON ->> '$.k')::BIGINT AS k, value, props AS params FROM events"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module, child_index, payload: the lines of each document, newline kept but on the last."""
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    return (
        read(spark, sf_dir, "documents").select(F.col("doc_id").alias("module"), F.size(parts).alias("n"), F.posexplode(parts).alias("child_index", "line"))
        .select("module", F.col("child_index").cast("long").alias("child_index"),
                F.when(F.col("child_index") < F.col("n") - 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("payload"))
    )


SEGMENTS_SQL = """
SELECT doc_id AS module, i - 1 AS child_index, CASE WHEN i < len(parts) THEN parts[i] || chr(10) ELSE parts[i] END AS payload
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)"""
