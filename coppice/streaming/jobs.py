"""Structured Streaming jobs over file streams; each agrees with its batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators.audit import ALLOWED, LEASE, LIFECYCLE_SQL
from coppice.operators.versions import apply_changes, content_digest
from coppice.plans.staging import folder, stage
from coppice.registration import Registry
from coppice.sources.adapters import LOG_SQL, log, read, with_sql
from coppice.streaming.mirror import Mirror
from coppice.streaming.processors import leases, lifecycles, rocks

REG = Registry()
#: A feed has four ranges at least, and one for each so many rows; a range has a file for each so many.
PARTS, RANGE_ROWS, FILE_ROWS = 4, 500_000_000, 1_000_000


def ranges_of(df: DataFrame, order: str, parts: int = PARTS) -> tuple[list[DataFrame], int]:
    """Ranges of df by equal spans of `order`, empty ones left out, and how many files each of them can fill."""
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("n")).first()
    lo, hi, parts = span["lo"] or 0, (span["hi"] or 0) + 1, max(parts, -(-span["n"] // RANGE_ROWS))
    number = F.floor((F.col(order) - lo) * parts / (hi - lo))
    counts = {r["i"]: r["n"] for r in df.groupBy(number.alias("i")).agg(F.count("*").alias("n")).collect()}  # a row a range
    return [df.filter(number == i) for i in sorted(counts)], max(1, min(counts.values(), default=1) // FILE_ROWS)


def write_range(part: DataFrame, path: str, files: int, form: str = "parquet") -> None:
    """A range as so many files, dealt out row by row."""
    part.repartition(files).write.mode("append").format(form).save(path)


def file_stream(df: DataFrame, order: str, parts: int = PARTS, form: str = "parquet") -> DataFrame:
    """df written range by range and read back as a stream, a range a micro-batch.

    Ranges are written one after another, since a file stream takes files by their time; the
    files of one range are read by as many tasks. Rows of a micro-batch are in no order.
    """
    path = folder(df.sparkSession, "feed")
    ranges, files = ranges_of(df, order, parts)
    (df.limit(0) if not ranges else ranges[0].limit(0)).write.mode("append").format(form).save(path)
    for part in ranges:
        write_range(part, path, files, form)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).format(form).load(path)


def run_to_table(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> str:
    """Runs what is there to its end; with no sink, each batch is written to a folder, which is returned. The same checkpoint and folder again go on where the last run ended."""
    spark = stream.sparkSession
    out = out or folder(spark, "out")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or folder(spark, "ckpt")).foreachBatch(sink or append).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


@REG.add("stream_resumable_read", with_sql("SELECT seq, kind FROM l WHERE seq > 50", l=LOG_SQL))
def stream_resumable_read(spark, sf_dir):
    """STR-1, STR-13: events after a cursor from a feed of JSON lines; a reader that stops half way and starts again goes on where it was."""
    rows = log(spark, sf_dir).select("seq", "kind")
    path, ckpt, out = folder(spark, "feed"), folder(spark, "ckpt"), folder(spark, "out")
    ranges, files = ranges_of(rows, "seq")
    for part in (ranges[:2], ranges[2:]):
        for r in part:
            write_range(r, path, files, "json")
        feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).json(path)
        run_to_table(feed.filter("seq > 50"), checkpoint=ckpt, out=out)
    return spark.read.schema("seq long, kind string, batch long").parquet(out).select("seq", "kind")


@REG.add("stream_acknowledge", with_sql("SELECT session, max(least(k * 20, seq)) AS acknowledged, count(*) AS n FROM l GROUP BY session", l=LOG_SQL))
def stream_acknowledge(spark, sf_dir):
    """STR-2: what each client has acknowledged: it never falls, and never passes the head, which is the row's own number when it comes. Streaming state; the last batch has all of it."""
    feed = file_stream(log(spark, sf_dir).select("session", "seq", "k"), "seq")
    counts = feed.groupBy("session").agg(F.max(F.least(F.col("k") * 20, F.col("seq"))).alias("acknowledged"), F.count("*").alias("n"))
    done = spark.read.parquet(run_to_table(counts, mode="complete"))
    last = done.agg(F.max("batch")).first()[0]
    return done.filter(F.col("batch") == last).select("session", "acknowledged", "n")


@REG.add("stream_idempotent", with_sql("SELECT session || '/' || kind AS key FROM l GROUP BY 1", l=LOG_SQL))
def stream_idempotent(spark, sf_dir):
    """STR-3: a key is passed on once."""
    keys = file_stream(log(spark, sf_dir).select(F.concat_ws("/", F.col("session").cast("string"), "kind").alias("key"), "seq"), "seq").select("key").dropDuplicates(["key"])
    return spark.read.parquet(run_to_table(keys)).select("key")


@REG.add("stream_lifecycle", with_sql(f"SELECT session, state, transitions, refused FROM ({LIFECYCLE_SQL})", l=LOG_SQL))
def stream_lifecycle(spark, sf_dir):
    """STR-5: state machines keyed by session, in the state store: what is refused changes nothing, also over the bounds of micro-batches."""
    feed = file_stream(log(spark, sf_dir).select("session", "kind", "seq"), "seq")
    with rocks(spark):
        done = spark.read.parquet(run_to_table(lifecycles(feed, ALLOWED)))
    newest = done.groupBy("session").agg(F.max_by(F.struct("state", "transitions", "refused"), "seq").alias("m"))
    return newest.select("session", "m.*")


@REG.add("stream_expire", with_sql("""
SELECT session, seq, 'lease_expired' AS event, CASE WHEN kind = 'click' THEN 'cancelled' ELSE 'requeued' END AS outcome FROM (SELECT *, lead(ts_ms // 60000) OVER (PARTITION BY session ORDER BY seq) AS next_at FROM l)
WHERE kind IN ('click', 'view', 'signup') AND coalesce(next_at, (SELECT max(ts_ms) // 60000 FROM l)) >= ts_ms // 60000 + CASE kind WHEN 'click' THEN 120 WHEN 'view' THEN 30 ELSE 60 END""", l=LOG_SQL))
def stream_expire(spark, sf_dir):
    """STR-4: leases that expire leave an event, by the session's next event or by an event-time timer; drafts are cancelled, offers and claims queued again."""
    rows = log(spark, sf_dir).select("session", "kind", "seq", F.floor(F.col("ts_ms") / 60000).alias("tick"), F.timestamp_millis("ts_ms").alias("at"))
    with rocks(spark):
        return spark.read.parquet(run_to_table(leases(file_stream(rows, "seq"), LEASE))).select("session", "seq", "event", "outcome")


#: Buckets of the mirror that the queries keep.
BUCKETS = 16


def delta_frames(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A table, and eight frames of deltas to it with the digests that their sender states.

    Three fit. One is far ahead, one behind, one on other data than the mirror's; one has a row
    that is not granted, and one has seen a clock that no key has.
    """
    orders = read(spark, sf_dir, "orders")
    top = orders.agg(F.max("o_orderkey")).first()[0] + 1
    frame = F.floor(F.col("o_orderkey") * 8 / top)
    rows = stage(orders.select(frame.alias("frame"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 6 == 0, "delete").otherwise("upsert").alias("op"),
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), (frame != 6).alias("granted"), F.when(frame == 7, 99).cast("long").alias("seen")))
    table = stage(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")))
    digest = lambda t: content_digest(t, ["key", "value"]).first()["digest"]
    states = [table]
    for i in range(3):
        states.append(stage(apply_changes(states[-1], rows.filter(F.col("frame") == i), "key", ["value"], ["pos"])))
    d = [digest(t) for t in states]
    stated = spark.createDataFrame([(0, 0, d[0], d[1]), (1, 1, d[1], d[2]), (2, 2, d[2], d[3]), (3, 9, d[3], d[3]), (4, 1, d[1], d[2]), (5, 3, d[2], d[3]), (6, 3, d[3], d[3]), (7, 3, d[3], d[3])], "frame long, base long, base_digest string, target_digest string")
    return table, rows.join(F.broadcast(stated), "frame")  # eight rows


FRAMES_SQL = "SELECT o_custkey AS key, o_orderpriority AS value, CASE WHEN o_orderkey % 6 = 0 THEN 'delete' ELSE 'upsert' END AS op, o_orderkey * 8 // (SELECT max(o_orderkey) + 1 FROM orders) AS frame, o_orderkey AS pos FROM orders"
FRAMES = "SELECT DISTINCT o_orderkey * 8 // (SELECT max(o_orderkey) + 1 FROM orders) AS frame FROM orders"


def mirrored(spark, sf_dir) -> Mirror:
    table, frames = delta_frames(spark, sf_dir)
    made = Mirror(spark, folder(spark, "mirror"), "key", ["value"], BUCKETS)
    made.hydrate(table)
    run_to_table(file_stream(frames, "frame", 8), made.merge)
    return made


@REG.add("stream_mirror", with_sql("""
SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM last) UNION ALL SELECT key, value FROM last WHERE op <> 'delete'""",
    base="SELECT c_custkey AS key, c_mktsegment AS value FROM customer", c=FRAMES_SQL,
    last="SELECT * FROM c WHERE frame < 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY frame DESC, pos DESC) = 1"))
def stream_mirror(spark, sf_dir):
    """STR-7, STR-16: the table after eight frames, of which five are refused."""
    return mirrored(spark, sf_dir).rows()


@REG.add("stream_mirror_refusals", f"""
SELECT frame, CASE frame WHEN 3 THEN 'gap' WHEN 4 THEN 'ahead' WHEN 5 THEN 'digest-mismatch' WHEN 6 THEN 'scope' WHEN 7 THEN 'stale' ELSE 'attest' END AS outcome,
  CASE WHEN frame < 3 THEN frame + 1 ELSE -1 END AS generation FROM ({FRAMES})""")
def stream_mirror_refusals(spark, sf_dir):
    """STR-7, STR-16: what became of each frame: the generation that it made, or why it was refused (place, digests, scope and clocks are looked at)."""
    made = mirrored(spark, sf_dir)
    merged = made.events().filter("event = 'attest'").select("frame", F.lit("attest").alias("outcome"), "generation")
    return merged.unionByName(made.refusals().select("frame", F.col("reason").alias("outcome"), F.lit(-1).cast("long").alias("generation")))


@REG.add("stream_late_rows", with_sql("""
SELECT ts_ms // 86400000 AS day, count_if(NOT late)::BIGINT AS in_time, count_if(late AND (ts_ms // 86400000 + 1) * 86400000 > (SELECT max(ts_ms) - 86400000 FROM l WHERE seq % 50 <> 7))::BIGINT AS late_kept
FROM (SELECT *, seq % 50 = 7 AS late FROM l) GROUP BY 1 HAVING in_time + late_kept > 0""", l=LOG_SQL))
def stream_late_rows(spark, sf_dir):
    """STR-12: counts by event-time day under a watermark of a day. Every fiftieth row comes after all others; of these, only days that the watermark has not passed still count."""
    rows = log(spark, sf_dir)
    top = rows.agg(F.max("seq")).first()[0] + 1
    late = F.col("seq") % 50 == 7
    feed = rows.select(F.when(late, F.col("seq") + 3 * top).otherwise(F.col("seq")).alias("place"), late.alias("late"), "ts_ms", F.timestamp_millis("ts_ms").alias("at"))
    days = file_stream(feed, "place", 8).withWatermark("at", "1 day").groupBy(F.window("at", "1 day")).agg(F.min(F.floor(F.col("ts_ms") / 86400000)).alias("day"), F.count_if(~F.col("late")).alias("in_time"), F.count_if("late").alias("late_kept"))
    done = spark.read.parquet(run_to_table(days.select("day", "in_time", "late_kept"), mode="update"))
    return done.groupBy("day").agg(F.max("in_time").alias("in_time"), F.max("late_kept").alias("late_kept"))


QUERIES, SQL = REG.queries, REG.sql
