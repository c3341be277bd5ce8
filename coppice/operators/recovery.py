"""Recovery from a snapshot and a log: the digest of the state at each generation, and an audit of all that must agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.operators.versions import BASE_SQL, CHANGES_SQL, apply_changes, base, changes, content_digest
from coppice.plans.digests import PARTS, digest_of, row_parts, row_text, row_text_sql, summed_digest_sql
from coppice.plans.joins import dealt
from coppice.plans.scans import BLOCK_ROWS, Running, scanned
from coppice.plans.staging import stage
from coppice.registration import Registry
from coppice.sources.adapters import read, with_sql

REG = Registry()


def state_digests(snapshot: DataFrame, at: int, delta: DataFrame, key: str, values: list[str], order: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """AGG-29, STR-9: generation, n, digest of the table at generation `at` (snapshot) and after each later generation of delta (generation, op, key, values).

    No state is made: what a generation does to a key takes the key's row before it out of the
    sums of row hashes and puts the row after it in, so one pass over the changes, and a running
    sum over generations, give the digests of all states, as content_digest gives them of one.
    The row before is a segmented scan, so a key with very many changes is spread over tasks.
    Of changes of a key in one generation the last in `order` counts. Keys of snapshot are
    unique; null keys are a key.
    """
    last = F.max_by(F.struct("op", *values), F.struct(*order)).alias("c")
    later = delta.filter(F.col("generation") > at).groupBy(key, F.col("generation").cast("long").alias("generation")).agg(last)
    row = row_text(key, *[F.col(f"c.{v}").alias(v) for v in values])
    new = later.select(key, "generation", F.when(F.col("c.op") != "delete", row).alias("new"))
    rows = snapshot.select(key, F.lit(at).cast("long").alias("generation"), row_text(key, *values).alias("new")).union(new)
    both = scanned(rows, [key], ["generation"], {"old": Running("lag", F.col("new"))}, block_rows)
    sums = [f"s{i}" for i in range(PARTS)]
    steps = both.groupBy("generation").agg(
        F.sum(F.col("new").isNotNull().cast("long") - F.col("old").isNotNull().cast("long")).alias("n"),
        *[F.sum(a - b).alias(s) for s, a, b in zip(sums, row_parts(F.col("new")), row_parts(F.col("old")), strict=True)])
    if snapshot.isEmpty():
        zero = steps.sparkSession.range(1).select(F.lit(at).cast("long").alias("generation"), F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("decimal(38,0)").alias(s) for s in sums])
        steps = steps.unionByName(zero)
    so_far = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)  # one row a generation
    states = steps.select("generation", *[F.sum(c).over(so_far).alias(c) for c in ("n", *sums)])
    return states.select("generation", "n", digest_of(F.col("n"), *[F.when(F.col("n") > 0, F.col(s)) for s in sums]).alias("digest"))


def recover_states(snapshot: DataFrame, at: int, delta: DataFrame, recorded: DataFrame, to: int, key: str, values: list[str], order: list[str]) -> DataFrame:
    """STR-9: the table at generation `to`, from the snapshot of `at` and the later changes; an error, and nothing recovered, unless every state on the way is the recorded one.

    recorded: generation, digest, for the snapshot and each later generation that has changes.
    The first generation whose state differs, that has no record, or whose changes are not
    there although a record says that they did something, is named.
    """
    if to < at:
        raise ValueError(f"the snapshot of generation {at} is later than {to}")
    delta = delta.filter((F.col("generation") > at) & (F.col("generation") <= to))
    found = state_digests(snapshot, at, delta, key, values, order).select("generation", F.col("digest").alias("found"))
    both = found.join(recorded.filter(F.col("generation").between(at, to)).select("generation", "digest"), "generation", "full_outer")
    held = F.last("found", True).over(Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0))  # one row a generation; one without changes keeps the state
    wrong = both.withColumn("held", held).filter(~F.col("held").eqNullSafe(F.col("digest"))).agg(F.min("generation")).first()[0]
    if wrong is not None:
        raise ValueError(f"the state of generation {wrong} differs from its recorded digest")
    return apply_changes(snapshot, delta, key, values, order if "generation" in order else ["generation", *order])


STATES_SQL = f"""
SELECT generation, count(key) AS n, CASE WHEN count(key) = 0 THEN sha256('0') ELSE {summed_digest_sql(row_text_sql("key", "value"))} END AS digest FROM (
  SELECT g.generation, b.key, b.value FROM gens g JOIN base b ON NOT EXISTS (SELECT 1 FROM c WHERE c.key = b.key AND c.generation <= g.generation)
  UNION ALL SELECT generation, key, value FROM (SELECT g.generation, c.key, c.value, c.op FROM gens g JOIN c ON c.generation <= g.generation QUALIFY row_number() OVER (PARTITION BY g.generation, c.key ORDER BY c.generation DESC, c.pos DESC) = 1) WHERE op <> 'delete') GROUP BY generation"""


@REG.add("str_state_digests", with_sql(STATES_SQL, c=CHANGES_SQL, base=BASE_SQL, gens="SELECT DISTINCT generation FROM c UNION SELECT min(generation) - 1 FROM c"))
def str_state_digests(spark, sf_dir):
    """STR-9: the digest of the whole table after each generation of changes."""
    c = changes(spark, sf_dir)
    first = c.agg(F.min("generation")).first()[0]
    return state_digests(base(spark, sf_dir), (first or 0) - 1, c, "key", ["value"], ["pos"])


@REG.add("str_recover_states", with_sql("""
SELECT key, value FROM (WITH last AS (SELECT * FROM c WHERE generation <= 60 QUALIFY row_number() OVER (PARTITION BY key ORDER BY generation DESC, pos DESC) = 1)
SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM last) UNION ALL SELECT key, value FROM last WHERE op <> 'delete')""", base=BASE_SQL, c=CHANGES_SQL))
def str_recover_states(spark, sf_dir, to: int = 60, every: int = 24):
    """STR-9: the newest snapshot at or before a generation, and the changes after it; each state checked against a digest of that whole table, made of the rows that all changes up to it leave."""
    c, order = stage(changes(spark, sf_dir)), ["generation", "pos"]
    state = lambda g: apply_changes(base(spark, sf_dir), c.filter(F.col("generation") <= g), "key", ["value"], order)
    at = c.filter((F.col("generation") % every == 0) & (F.col("generation") <= to)).agg(F.max("generation")).first()[0] or 0
    writer = [content_digest(state(g), ["key", "value"]).select(F.lit(g).cast("long").alias("generation"), "digest") for g in range(at, to + 1)]
    return recover_states(stage(state(at)), at, c, stage(reduce(DataFrame.union, writer)), to, "key", ["value"], order)


def recovery_faults(current: int, markers: DataFrame, tickets: DataFrame, events: DataFrame, index: DataFrame, dependencies: DataFrame, clocks: DataFrame,
                    attempts: DataFrame, change_sets: DataFrame, operations: DataFrame, digests: DataFrame) -> DataFrame:
    """STR-10: rule, what: one row for each thing in the tables of a store at generation `current` that does not agree; none if it is sound.

    markers: name, value. tickets: queue_sequence. events, index: event_id, sequence.
    dependencies: resource, clock. clocks: resource. attempts: attempt, generation, change_set,
    digest. change_sets: change_set, state, generation. operations: generation, change_set.
    digests: generation, digest.

    The markers are five numbers, so they alone come to the driver; all else is aggregates and
    joins by key; events, index and
    dependencies are joined in more tasks as they grow. Of a resource that many dependencies
    name, one row is joined.
    """
    spark = markers.sparkSession
    known = {r["name"]: r["value"] for r in markers.filter(F.col("name").isin(*MARKERS)).groupBy("name").agg(F.max("value").alias("value")).collect()}
    own = [("marker_missing", m) for m in MARKERS if known.get(m) is None]
    value = lambda m: known.get(m) or 0
    if value("scheduler_revision") != value("latest_lifecycle_revision"):
        own.append(("lifecycle_marker", str(value("latest_lifecycle_revision"))))
    if value("clocked_publication_generation") > current:
        own.append(("clock_marker", str(value("clocked_publication_generation"))))
    if value("clocked_publication_generation") > 0 and clocks.isEmpty():
        own.append(("clocks_empty", str(value("clocked_publication_generation"))))

    one = lambda df, rule, what: df.select(F.lit(rule).alias("rule"), F.col(what).cast("string").alias("what"))
    queue = tickets.agg(F.greatest(F.coalesce(F.max("queue_sequence") + 1, F.lit(1)), F.lit(1)).cast("long").alias("next"))
    head = events.agg(F.coalesce(F.max("sequence"), F.lit(0)).cast("long").alias("last"))
    pairs, entries = dealt(["event_id", "sequence"], events.select("event_id", "sequence"), index.select("event_id", "sequence"))
    named, known_ids = dealt(["event_id"], events.select("event_id", "sequence"), index.select("event_id"))
    wanted, clocked = dealt(["resource"], dependencies.filter("clock > 0").select("resource"), clocks.select("resource"))
    joined = (
        attempts.join(change_sets.select("change_set", "state", F.col("generation").alias("committed")), "change_set", "left")
        .join(operations.select("generation", F.col("change_set").alias("operation")), "generation", "left").join(digests.select("generation", F.col("digest").alias("recorded")), "generation", "left")
    )
    bound = F.coalesce((F.col("state") == "committed") & (F.col("committed") == F.col("generation")), F.lit(False))
    return reduce(DataFrame.union, [
        spark.createDataFrame(own, "rule string, what string"),
        one(queue.filter(F.col("next") != value("next_queue_sequence")), "queue_marker", "next"),
        one(head.filter(F.col("last") != value("current_event_sequence")), "event_marker", "last"),
        one(named.groupBy("event_id").count().filter("count > 1"), "event_twice", "event_id"),
        one(entries.join(pairs, ["event_id", "sequence"], "left_anti"), "index_differs", "event_id"),
        one(named.join(known_ids, "event_id", "left_anti"), "index_missing", "event_id"),
        one(wanted.distinct().join(clocked.distinct(), "resource", "left_anti"), "clock_missing", "resource"),
        one(joined.filter(~F.coalesce(F.col("generation").between(1, current), F.lit(False))), "attempt_generation", "attempt"),
        one(joined.filter(~bound), "attempt_unbound", "attempt"),
        one(joined.filter(~F.col("operation").eqNullSafe(F.col("change_set"))), "attempt_operation", "attempt"),
        one(joined.filter(~F.col("digest").eqNullSafe(F.col("recorded"))), "attempt_digest", "attempt"),
    ])


#: The markers that a store must have.
MARKERS = ("next_queue_sequence", "current_event_sequence", "scheduler_revision", "latest_lifecycle_revision", "clocked_publication_generation")

#: Months are generations, and the first order of each is its change set; events are indexed, parts have clocks. Faults are planted by number.
STORE = {
    "o": "SELECT o_orderkey AS k, o_orderstatus AS status, (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS g FROM orders",
    "tickets": "SELECT o_orderkey AS queue_sequence FROM orders",
    "ev": "SELECT 'e' || CAST(CASE WHEN event_id % 500 = 499 THEN event_id - 1 ELSE event_id END AS VARCHAR(20)) AS event_id, event_id AS sequence FROM events",
    "idx": "SELECT event_id, CASE WHEN sequence % 89 = 0 THEN sequence + 1 ELSE sequence END AS sequence FROM ev WHERE sequence % 97 <> 0",
    "dependencies": "SELECT 'part:' || CAST(l_partkey AS VARCHAR(20)) AS resource, l_linenumber - 1 AS clock FROM lineitem",
    "clocks": "SELECT 'part:' || CAST(p_partkey AS VARCHAR(20)) AS resource FROM part WHERE p_partkey % 50 <> 7",
    "change_sets": "SELECT k AS change_set, CASE WHEN status = 'P' THEN 'queued' ELSE 'committed' END AS state, g AS generation FROM o",
    "operations": "SELECT g AS generation, CASE WHEN g % 11 = 0 THEN max(k) ELSE min(k) END AS change_set FROM o WHERE g % 13 <> 0 GROUP BY g",
    "digests": "SELECT g AS generation, CAST(sum(k) AS VARCHAR(40)) AS digest FROM o GROUP BY g",
    "attempts": "SELECT 'a' || CAST(g AS VARCHAR(20)) AS attempt, g AS generation, min(k) AS change_set, CAST(sum(k) + CASE WHEN g % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR(40)) AS digest FROM o GROUP BY g",
    "markers": """SELECT 'next_queue_sequence' AS name, max(k) + 1 AS value FROM o UNION ALL SELECT 'current_event_sequence', count(*) FROM events
        UNION ALL SELECT 'scheduler_revision', count(*) FROM o WHERE status = 'F' UNION ALL SELECT 'clocked_publication_generation', max(g) + 1 FROM o""",
}
AUDIT_SQL = """
SELECT rule, count(*) AS n, min(what) AS first_one, max(what) AS last_one FROM (
  SELECT 'marker_missing' AS rule, 'latest_lifecycle_revision' AS what UNION ALL SELECT 'lifecycle_marker', '0' FROM markers WHERE name = 'scheduler_revision' AND value <> 0
  UNION ALL SELECT 'clock_marker', value::VARCHAR FROM markers WHERE name = 'clocked_publication_generation' AND value > (SELECT max(g) FROM o)
  UNION ALL SELECT 'queue_marker', (max(queue_sequence) + 1)::VARCHAR FROM tickets HAVING max(queue_sequence) + 1 <> (SELECT value FROM markers WHERE name = 'next_queue_sequence')
  UNION ALL SELECT 'event_marker', max(sequence)::VARCHAR FROM ev HAVING max(sequence) <> (SELECT value FROM markers WHERE name = 'current_event_sequence')
  UNION ALL SELECT 'event_twice', event_id FROM ev GROUP BY event_id HAVING count(*) > 1
  UNION ALL SELECT 'index_differs', event_id FROM idx WHERE (event_id, sequence) NOT IN (SELECT (event_id, sequence) FROM ev)
  UNION ALL SELECT 'index_missing', event_id FROM ev WHERE event_id NOT IN (SELECT event_id FROM idx)
  UNION ALL SELECT DISTINCT 'clock_missing', resource FROM dependencies WHERE clock > 0 AND resource NOT IN (SELECT resource FROM clocks)
  UNION ALL SELECT 'attempt_generation', attempt FROM attempts WHERE generation < 1 OR generation > (SELECT max(g) FROM o)
  UNION ALL SELECT 'attempt_unbound', attempt FROM attempts a WHERE NOT EXISTS (SELECT 1 FROM change_sets c WHERE c.change_set = a.change_set AND c.state = 'committed' AND c.generation = a.generation)
  UNION ALL SELECT 'attempt_operation', attempt FROM attempts a WHERE NOT EXISTS (SELECT 1 FROM operations c WHERE c.change_set = a.change_set AND c.generation = a.generation)
  UNION ALL SELECT 'attempt_digest', attempt FROM attempts a WHERE NOT EXISTS (SELECT 1 FROM digests d WHERE d.generation = a.generation AND d.digest = a.digest)) GROUP BY rule"""


@REG.add("str_recovery_audit", with_sql(AUDIT_SQL, **STORE))
def str_recovery_audit(spark, sf_dir):
    """STR-10: what disagrees between markers, queue, events and their index, clocks and publications, by rule."""
    o = stage(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).cast("long").alias("g")))
    k, g, seq, part = F.col("k"), F.col("g"), F.col("sequence"), F.col("p_partkey")
    named = lambda name, n: F.struct(F.lit(name).alias("name"), n.cast("long").alias("value"))
    ev = read(spark, sf_dir, "events").select(F.col("event_id").alias("sequence")).select(F.concat(F.lit("e"), F.when(seq % 500 == 499, seq - 1).otherwise(seq).cast("string")).alias("event_id"), "sequence")
    first = stage(o.groupBy(g.alias("generation")).agg(F.min("k").alias("low"), F.max("k").alias("high"), F.sum("k").alias("total")))
    gen = F.col("generation")
    ends = o.agg(F.max("k").alias("k"), F.count_if(F.col("status") == "F").alias("final"), F.max("g").alias("g"), F.lit(1).alias("one")).join(ev.agg(F.count("*").alias("events"), F.lit(1).alias("one")), "one")  # one row each
    markers = ends.select(F.explode(F.array(
        named("next_queue_sequence", k + 1), named("current_event_sequence", F.col("events")), named("scheduler_revision", F.col("final")), named("clocked_publication_generation", g + 1))).alias("m")).select("m.*")
    return recovery_faults(
        o.agg(F.max("g")).first()[0] or 0, markers, o.select(k.alias("queue_sequence")), ev,
        ev.filter(seq % 97 != 0).select("event_id", F.when(seq % 89 == 0, seq + 1).otherwise(seq).alias("sequence")),
        read(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("resource"), (F.col("l_linenumber") - 1).alias("clock")),
        read(spark, sf_dir, "part").filter(part % 50 != 7).select(F.concat(F.lit("part:"), part.cast("string")).alias("resource")),
        first.select(F.concat(F.lit("a"), gen.cast("string")).alias("attempt"), "generation", F.col("low").alias("change_set"), (F.col("total") + F.when(gen % 9 == 0, 1).otherwise(0)).cast("string").alias("digest")),
        o.select(k.alias("change_set"), F.when(F.col("status") == "P", "queued").otherwise("committed").alias("state"), g.alias("generation")),
        first.filter(gen % 13 != 0).select("generation", F.when(gen % 11 == 0, F.col("high")).otherwise(F.col("low")).alias("change_set")),
        first.select("generation", F.col("total").cast("string").alias("digest")),
    ).groupBy("rule").agg(F.count("*").alias("n"), F.min("what").alias("first_one"), F.max("what").alias("last_one"))


QUERIES, SQL = REG.queries, REG.sql
