"""Snapshots, deltas, replay, digests (changes: generation, pos, op, key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.plans.digests import row_text, row_text_sql, summed_digest, summed_digest_sql
from coppice.plans.joins import as_of
from coppice.plans.staging import stage
from coppice.registration import Registry
from coppice.sources.adapters import LOG_SQL, log, read, with_sql

REG = Registry()
#: Tables and columns that agg_content_digest goes over.
DIGESTED = (("documents", ("doc_id", "text", "lang", "source")), ("orders", ("o_orderkey", "o_custkey", "o_orderstatus")))

#: Two snapshots of orders by a fixed rule: the older lacks every 10th and has other statuses on every 7th.
BEFORE_SQL = "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 10 <> 0"
AFTER_SQL = "SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 10 <> 1"
#: Changes to customers from orders: generation is the month, the order's key gives place and kind.
CHANGES_SQL = "SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS generation, o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, o_custkey AS key, o_orderpriority AS value FROM orders"
BASE_SQL = "SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 3 = 0"


def before(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").filter(k % 10 != 0).select(
        k.alias("key"), F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 13 != 0, F.col("o_orderpriority")).alias("priority"))


def after(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def changes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("long").alias("generation"), F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderkey") % 5 == 0, "delete").otherwise("upsert").alias("op"), F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))


def base(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))


def diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """JOI-11: key, op (delete, insert, update) and the new values; unchanged rows are left out, nulls being equal."""
    a = old.select(key, F.struct(*values).alias("old"))
    b = new.select(key, F.struct(*values).alias("new"))
    op = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return a.join(b, key, "full_outer").withColumn("op", op).filter("op is not null").select(key, "op", *[F.col(f"new.{v}").alias(v) for v in values])


def apply_changes(table: DataFrame, delta: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """SET-1, SET-2: table after all changes; of each key the last change in `order` wins, however many generations there are."""
    last = delta.groupBy(key).agg(F.max_by(F.struct("op", *values), F.struct(*order)).alias("c"))
    kept = table.join(last.select(key), key, "left_anti").select(key, *values)
    return kept.unionByName(last.filter("c.op <> 'delete'").select(key, *[F.col(f"c.{v}").alias(v) for v in values]))


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-29: rows and digest of a table, whatever its order and partitioning.

    Sums of row hashes stand for the sorted list, so nothing is gathered; equal tables get
    equal digests, and repeated rows count.
    """
    return df.agg(F.count("*").alias("rows"), summed_digest(row_text(*columns)).alias("digest"))


@REG.add("joi_snapshot_diff", with_sql("""
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'delete' WHEN a.key IS NULL THEN 'insert' ELSE 'update' END AS op, b.status, b.priority
FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.status IS DISTINCT FROM b.status OR a.priority IS DISTINCT FROM b.priority""", a=BEFORE_SQL, b=AFTER_SQL))
def joi_snapshot_diff(spark, sf_dir):
    return diff(before(spark, sf_dir), after(spark, sf_dir), "key", ["status", "priority"])


@REG.add("set_apply_delta", with_sql("SELECT * FROM b", b=AFTER_SQL))
def set_apply_delta(spark, sf_dir):
    """SET-1: the difference applied to the older snapshot gives the newer one."""
    old, new = before(spark, sf_dir), after(spark, sf_dir)
    delta = diff(old, new, "key", ["status", "priority"]).withColumns({"op": F.when(F.col("op") == "delete", "delete").otherwise("upsert"), "pos": F.lit(0)})
    return apply_changes(old, delta, "key", ["status", "priority"], ["pos"])


@REG.add("set_replay", with_sql("""
SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM last) UNION ALL SELECT key, value FROM last WHERE op <> 'delete'""", base=BASE_SQL, c=CHANGES_SQL,
    last="SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY generation DESC, pos DESC) = 1"))
def set_replay(spark, sf_dir):
    """SET-2: all generations folded at once."""
    return apply_changes(base(spark, sf_dir), changes(spark, sf_dir), "key", ["value"], ["generation", "pos"])


@REG.add("joi_snapshot_as_of", with_sql("""
SELECT d.session, d.seq, coalesce(max(s.seq), -1) AS snapshot FROM d LEFT JOIN s ON d.session = s.session AND s.seq <= d.seq GROUP BY d.session, d.seq""",
    l=LOG_SQL, d="SELECT * FROM l WHERE kind <> 'signup'", s="SELECT * FROM l WHERE kind = 'signup'"))
def joi_snapshot_as_of(spark, sf_dir):
    """JOI-9: for each event the newest sign-up at or before it."""
    events = log(spark, sf_dir)
    snaps = events.filter("kind = 'signup'").select("session", F.col("seq").alias("at"), F.col("seq").alias("snapshot"))
    return as_of(events.filter("kind <> 'signup'").select("session", "seq"), snaps, ["session"], "seq", "at", ["snapshot"]).fillna(-1, ["snapshot"])


def bind_next(records: DataFrame, requests: DataFrame, keys: list[str], at: str, trailing: str = "error") -> DataFrame:
    """JOI-10: each record with the `at` of the next request of its keys as `request`.

    A record after the last request is an error as soon as its row is read; trailing="null"
    leaves its request null, trailing="drop" leaves the record out.
    """
    found = as_of(records, requests.select(*keys, F.col(at).alias("request_at"), F.col(at).alias("request")), keys, at, "request_at", ["request"], forward=True, strict=True)
    if trailing == "drop":
        return found.filter("request is not null")
    if trailing == "null":
        return found
    unbound = F.raise_error(F.concat(F.lit("no request follows record "), F.col(at).cast("string")))
    return found.withColumn("request", F.when(F.col("request").isNull(), unbound.cast("long")).otherwise(F.col("request")))


@REG.add("joi_next_request", with_sql("""
SELECT d.session, d.seq, min(s.seq) AS request FROM d JOIN s ON d.session = s.session AND s.seq > d.seq GROUP BY d.session, d.seq""",
    l=LOG_SQL, d="SELECT * FROM l WHERE kind = 'view'", s="SELECT * FROM l WHERE kind = 'purchase'"))
def joi_next_request(spark, sf_dir):
    """JOI-10: each view up to its session's last purchase is bound to the next purchase; one that is not would be an error."""
    events = log(spark, sf_dir)
    reqs = events.filter("kind = 'purchase'").select("session", "seq")
    last = reqs.groupBy("session").agg(F.max("seq").alias("last"))
    views = events.filter("kind = 'view'").select("session", "seq").join(last, "session").filter("seq < last").select("session", "seq")
    return bind_next(views, reqs, ["session"], "seq")


@REG.add("joi_identity_churn", with_sql("""
SELECT coalesce(a.key, b.key) AS key FROM a FULL JOIN b ON a.key = b.key
WHERE (a.key IS NULL OR b.key IS NULL OR a.status IS DISTINCT FROM b.status OR a.priority IS DISTINCT FROM b.priority) AND coalesce(a.key, b.key) % 7 <> 0""", a=BEFORE_SQL, b=AFTER_SQL))
def joi_identity_churn(spark, sf_dir):
    """JOI-20: rows that changed though they were not declared (declared: keys divisible by 7)."""
    touched = read(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("key"))
    return diff(before(spark, sf_dir), after(spark, sf_dir), "key", ["status", "priority"]).select("key").join(touched, "key", "left_anti")


@REG.add("joi_inventory", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'differs' END AS fault
FROM (SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 9 <> 4) a
FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 8 = 1 THEN text || '.' ELSE text END) AS digest FROM documents WHERE doc_id % 11 <> 6) b ON a.doc_id = b.doc_id
WHERE a.digest IS DISTINCT FROM b.digest""")
def joi_inventory(spark, sf_dir):
    """JOI-17: expected files against those found; digests only are joined."""
    docs = read(spark, sf_dir, "documents")
    a = docs.filter("doc_id % 9 <> 4").select("doc_id", F.md5("text").alias("digest"))
    b = docs.filter("doc_id % 11 <> 6").select("doc_id", F.md5(F.when(F.col("doc_id") % 8 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("digest"))
    out = diff(a, b, "doc_id", ["digest"])
    return out.select("doc_id", F.when(F.col("op") == "delete", "missing").when(F.col("op") == "insert", "extra").otherwise("differs").alias("fault"))


@REG.add("joi_unexpected_changes", """
SELECT doc_id FROM documents WHERE doc_id % 8 = 1 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def joi_unexpected_changes(spark, sf_dir):
    """JOI-18: changed documents outside the allowed set (those with a label)."""
    docs = read(spark, sf_dir, "documents")
    after_ = docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 8 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("digest"))
    moved = diff(docs.select("doc_id", F.md5("text").alias("digest")), after_, "doc_id", ["digest"]).select("doc_id")
    return moved.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@REG.add("agg_content_digest", " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS rows, {summed_digest_sql(row_text_sql(*cols))} AS digest FROM {name}" for name, cols in DIGESTED))
def agg_content_digest(spark, sf_dir):
    """AGG-29 over documents and orders."""
    one = lambda name, cols: content_digest(read(spark, sf_dir, name), list(cols)).select(F.lit(name).alias("name"), "rows", "digest")
    out = [one(*x) for x in DIGESTED]
    return out[0].union(out[1])


@REG.add("agg_generation_digests", with_sql(f"""
SELECT generation, count(*) AS n, {summed_digest_sql(row_text_sql("pos", "op", "key", "value"))} AS digest FROM c GROUP BY generation""", c=CHANGES_SQL))
def agg_generation_digests(spark, sf_dir):
    """AGG-29: a digest of each generation's changes; a place counts as part of its row, so order is in it."""
    return changes(spark, sf_dir).groupBy("generation").agg(F.count("*").alias("n"), summed_digest(row_text("pos", "op", "key", "value")).alias("digest"))


def generation_faults(gens: DataFrame, current: int) -> DataFrame:
    """WIN-7: fault, prev, generation: `gap` where generations (a column, one row each) are not consecutive, `short_head` where the last one is not `current`."""
    prev = F.lag("generation").over(Window.orderBy("generation"))  # one row a generation
    gaps = gens.withColumn("prev", prev).filter("generation - prev <> 1").select(F.lit("gap").alias("fault"), "prev", "generation")
    head = gens.agg(F.max("generation").alias("prev")).filter(F.coalesce("prev", F.lit(-1)) < current)
    return gaps.union(head.select(F.lit("short_head"), "prev", F.lit(current).cast("long")))


@REG.add("win_generation_gaps", with_sql("""
SELECT 'gap' AS fault, prev, generation FROM (SELECT generation, lag(generation) OVER (ORDER BY generation) AS prev FROM (SELECT DISTINCT generation FROM c WHERE generation % 11 <> 4)) WHERE generation - prev <> 1
UNION ALL SELECT 'short_head', max(generation), 1000 FROM c WHERE generation % 11 <> 4 HAVING max(generation) < 1000""", c=CHANGES_SQL))
def win_generation_gaps(spark, sf_dir):
    """WIN-7: gaps, and a head shorter than the declared generation 1000."""
    return generation_faults(changes(spark, sf_dir).filter("generation % 11 <> 4").select("generation").distinct(), 1000)


@REG.add("agg_affected_ids", with_sql(f"SELECT generation, count(*) AS n, min(key) AS first_id, max(key) AS last_id, {summed_digest_sql('key::VARCHAR')} AS ids FROM (SELECT DISTINCT generation, key FROM c) GROUP BY generation", c=CHANGES_SQL))
def agg_affected_ids(spark, sf_dir):
    """AGG-27: the distinct ids that each delta touches, as a count, bounds and a digest; `affected_ids` has the rows."""
    ids = affected_ids(changes(spark, sf_dir))
    return ids.groupBy("generation").agg(F.count("*").alias("n"), F.min("key").alias("first_id"), F.max("key").alias("last_id"), summed_digest(F.col("key").cast("string")).alias("ids"))


def affected_ids(delta: DataFrame) -> DataFrame:
    """AGG-27: generation, key: a row for each distinct id."""
    return delta.select("generation", "key").distinct()


@REG.add("agg_net_renames", with_sql("""
SELECT key, first(value ORDER BY generation, pos) AS was, last(value ORDER BY generation, pos) AS now FROM c WHERE generation > 24 GROUP BY key HAVING was <> now""", c=CHANGES_SQL))
def agg_net_renames(spark, sf_dir, since: int = 24):
    """AGG-28: the net rename of each node since a generation, no-ops dropped."""
    return net_renames(changes(spark, sf_dir).filter(F.col("generation") > since))


def net_renames(delta: DataFrame) -> DataFrame:
    """AGG-28: key, was, now: the first and the last value of each key where they differ. Two values a key and task are shuffled, however often it was renamed."""
    order = F.struct("generation", "pos")
    return delta.groupBy("key").agg(F.min_by("value", order).alias("was"), F.max_by("value", order).alias("now")).filter("was <> now")


#: So many renames one report holds (the cap is the feature; the rest is counted).
RENAMES_MOST = 256


def rename_report(delta: DataFrame, cap: int = RENAMES_MOST) -> DataFrame:
    """SRT-5: place, key, was, now, total, truncated: the first net renames in the order of keys, with the number of all and whether some are left out. No rows if there are none."""
    net = stage(net_renames(delta))
    total = net.agg(F.count("*").alias("total"))
    first = net.orderBy("key").limit(cap)
    place = F.row_number().over(Window.orderBy("key")).cast("long")  # cap rows
    return first.crossJoin(F.broadcast(total)).select(place.alias("place"), "key", "was", "now", "total", (F.col("total") > cap).alias("truncated"))  # one row


@REG.add("srt_capped_renames", with_sql(f"""
SELECT row_number() OVER (ORDER BY key) AS place, key, was, now, (SELECT count(*) FROM net) AS total, (SELECT count(*) FROM net) > {RENAMES_MOST} AS truncated FROM net ORDER BY key LIMIT {RENAMES_MOST}""",
    c=CHANGES_SQL, net="SELECT key, first(value ORDER BY generation, pos) AS was, last(value ORDER BY generation, pos) AS now FROM c GROUP BY key HAVING was <> now"))
def srt_capped_renames(spark, sf_dir):
    """SRT-5 over all generations."""
    return rename_report(changes(spark, sf_dir))


@REG.add("agg_resource_clocks", with_sql("SELECT k.c_custkey AS key, count(DISTINCT c.generation) AS clock FROM customer k LEFT JOIN c ON c.key = k.c_custkey GROUP BY k.c_custkey", c=CHANGES_SQL))
def agg_resource_clocks(spark, sf_dir):
    """AGG-30: a key's clock is the number of publications that touched it, zero if none."""
    clock = changes(spark, sf_dir).groupBy("key").agg(F.countDistinct("generation").alias("clock"))
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return keys.join(clock, "key", "left").select("key", F.coalesce("clock", F.lit(0).cast("long")).alias("clock"))


@REG.add("set_touched_keys", with_sql("""
SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'node:' || key AS r, 'node' AS kind FROM c UNION
  SELECT DISTINCT 'children:' || k.c_nationkey, 'children' FROM c JOIN customer k ON k.c_custkey = c.key WHERE op = 'delete') GROUP BY kind""", c=CHANGES_SQL))
def set_touched_keys(spark, sf_dir):
    """SET-3: resources touched by the deltas; an upsert of a payload leaves the parent's membership alone."""
    c = changes(spark, sf_dir)
    nation = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")
    keys = c.select(F.concat(F.lit("node:"), F.col("key").cast("string")).alias("r"), F.lit("node").alias("kind")).union(
        c.filter("op = 'delete'").join(nation, "key").select(F.concat(F.lit("children:"), F.col("c_nationkey").cast("string")), F.lit("children")))
    return keys.distinct().groupBy("kind").agg(F.count("*").alias("n"))


def retained(delta: DataFrame, entries: int, size: int) -> DataFrame:
    """STR-8: the newest generations within both caps and without a gap, oldest dropped first. delta: generation, n, bytes; one row a generation.

    Nothing older than a gap is kept: a batch over it would not be sound.
    """
    newest = Window.orderBy(F.desc("generation"))  # one row a generation
    so_far = newest.rowsBetween(Window.unboundedPreceding, 0)
    gap = (F.lag("generation").over(newest) - F.col("generation")) > 1
    rows = delta.withColumns({"entries": F.sum("n").over(so_far), "total": F.sum("bytes").over(so_far), "gap": F.coalesce(gap, F.lit(False)).cast("int")})
    rows = rows.withColumn("gaps", F.sum("gap").over(so_far))
    return rows.filter((F.col("entries") <= entries) & (F.col("total") <= size) & (F.col("gaps") == 0)).drop("gap", "gaps")


def batch_of(log: DataFrame, base_generation: int, target: int) -> DataFrame:
    """STR-8: the retained generations after base up to target; an error unless all of them are there."""
    found = log.filter((F.col("generation") > base_generation) & (F.col("generation") <= target))
    n = found.count()
    if target <= base_generation or n != target - base_generation:
        raise ValueError(f"generations {base_generation + 1} to {target} are not all retained: {n} of {target - base_generation}")
    return found


@REG.add("str_retained_log", with_sql("""
SELECT generation, n, bytes FROM (SELECT *, sum(n) OVER w AS e, sum(bytes) OVER w AS t, sum(gap) OVER w AS gaps FROM (SELECT *, coalesce(lag(generation) OVER (ORDER BY generation DESC) - generation > 1, false)::INT AS gap FROM g) WINDOW w AS (ORDER BY generation DESC))
WHERE e <= 4096 AND t <= 30000 AND gaps = 0""",
    c=CHANGES_SQL, g="SELECT generation, count(*) AS n, sum(strlen(value))::BIGINT AS bytes FROM c WHERE generation <> 70 GROUP BY generation"))
def str_retained_log(spark, sf_dir):
    """Generation 70 is missing, so nothing before it is kept."""
    g = changes(spark, sf_dir).filter("generation <> 70").groupBy("generation").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))
    return retained(g, 4096, 30000).select("generation", "n", "bytes")


@REG.add("str_recover", with_sql("""
SELECT key, value FROM (WITH last AS (SELECT * FROM c WHERE generation <= 60 QUALIFY row_number() OVER (PARTITION BY key ORDER BY generation DESC, pos DESC) = 1)
SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM last) UNION ALL SELECT key, value FROM last WHERE op <> 'delete')""", base=BASE_SQL, c=CHANGES_SQL))
def str_recover(spark, sf_dir, to: int = 60, every: int = 24):
    """STR-9: the newest snapshot at or before a generation, and the changes after it, each checked against the digest its writer recorded."""
    c = changes(spark, sf_dir)
    recorded = c.filter(F.col("generation") <= to).groupBy("generation").agg(F.count("*").alias("n"), summed_digest(row_text("pos", "op", "key", "value")).alias("digest"))
    at = (c.filter((F.col("generation") % every == 0) & (F.col("generation") <= to)).agg(F.max("generation")).first()[0]) or 0
    snapshot = apply_changes(base(spark, sf_dir), c.filter(F.col("generation") <= at), "key", ["value"], ["generation", "pos"])
    return recover(snapshot, at, c.filter(F.col("generation") <= to), recorded)


def recover(snapshot: DataFrame, at: int, delta: DataFrame, recorded: DataFrame) -> DataFrame:
    """STR-9: the snapshot of generation `at` with the later changes of delta folded in.

    recorded (generation, digest) says what each generation's changes must be; a generation
    that is missing on either side or differs is an error, and nothing is recovered.
    """
    later = delta.filter(F.col("generation") > at)
    found = later.groupBy("generation").agg(summed_digest(row_text("pos", "op", "key", "value")).alias("found"))
    both = found.join(recorded.filter(F.col("generation") > at).select("generation", "digest"), "generation", "full_outer")
    wrong = both.filter(~F.col("found").eqNullSafe(F.col("digest"))).agg(F.min("generation")).first()[0]
    if wrong is not None:
        raise ValueError(f"generation {wrong} differs from its recorded digest")
    return apply_changes(snapshot, later, "key", ["value"], ["generation", "pos"])


@REG.add("win_first_seen_wins", with_sql("""
SELECT key, count(*) AS n FROM c c1 WHERE op = 'delete' AND (SELECT op FROM c c2 WHERE c2.key = c1.key ORDER BY generation, pos LIMIT 1) = 'delete' GROUP BY key""", c=CHANGES_SQL))
def win_first_seen_wins(spark, sf_dir):
    """WIN-13: deletes to restore at rollback, of keys whose first change was a delete; what was inserted first is not restored."""
    c = changes(spark, sf_dir)
    first = c.groupBy("key").agg(F.min_by("op", F.struct("generation", "pos")).alias("first_op"), F.count_if(F.col("op") == "delete").alias("n"))
    return first.filter("first_op = 'delete'").select("key", "n")


@REG.add("agg_table_counts", """
SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents""")
def agg_table_counts(spark, sf_dir):
    """AGG-35."""
    out = None
    for name in ("orders", "customer", "lineitem", "events", "documents"):
        one = read(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


QUERIES, SQL = REG.queries, REG.sql
