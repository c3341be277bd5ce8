"""Pending change sets: conflicts, admission by round, scopes, containment (items: item, seq; keys: item, key)."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.functions.columns import key_class
from coppice.plans.scans import blocked
from coppice.plans.staging import ship_package, stage
from coppice.registration import Registry
from coppice.sources.adapters import EDGES_SQL, LOG_SQL, NODES_SQL, edges, log, nodes, read, with_sql

REG = Registry()

#: Items are orders with the parts they take; status P is queued, O is active, F is done.
KEYS_SQL = "SELECT DISTINCT l_orderkey AS item, l_partkey AS key FROM lineitem"
ITEMS_SQL = "SELECT o_orderkey AS item, o_orderkey AS seq, CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN CASE WHEN o_orderkey % 40 = 0 THEN 'active' ELSE 'done' END ELSE 'done' END AS state FROM orders"


def items(spark, sf_dir) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("item"), k.alias("seq"), F.when(s == "P", "queued").when((s == "O") & (k % 40 == 0), "active").otherwise("done").alias("state"))


def keys(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("key")).distinct()


def ready(queued: DataFrame, item_keys: DataFrame, active: DataFrame) -> DataFrame:
    """JOI-13, STR-6: items that are the oldest waiting on every one of their keys, none of which is active.

    queued: item, seq; item_keys: item, key; active: key. A minimum a key replaces the
    self-join of items over shared keys, so a key with very many items stays one row.
    """
    mine = item_keys.join(queued, "item")
    oldest = mine.groupBy("key").agg(F.min("seq").alias("oldest"))
    blocked = mine.join(oldest, "key").filter("seq > oldest").select("item")
    held = mine.join(active.select("key").distinct(), "key", "left_semi").select("item")
    return queued.join(blocked.union(held).distinct(), "item", "left_anti")


@REG.add("joi_ready_items", with_sql("""
SELECT item FROM q WHERE NOT EXISTS (SELECT 1 FROM k a JOIN k b ON a.key = b.key JOIN q o ON o.item = b.item WHERE a.item = q.item AND o.seq < q.seq)
AND item NOT IN (SELECT a.item FROM k a JOIN k b ON a.key = b.key JOIN i ON i.item = b.item AND i.state = 'active')""", k=KEYS_SQL, i=ITEMS_SQL, q="SELECT * FROM i WHERE state = 'queued'"))
def joi_ready_items(spark, sf_dir):
    i, k = items(spark, sf_dir), keys(spark, sf_dir)
    active = k.join(i.filter("state = 'active'").select("item"), "item", "left_semi")
    return ready(i.filter("state = 'queued'").select("item", "seq"), k, active).select("item")


#: So many (item, key) rows are few enough for one task: 200,000 rows are some 5 MB.
ONE_TASK_ROWS = 200_000

#: Blocks of the queue that go on together, at least, and groups of such blocks, at most.
GROUP_BLOCKS, GROUPS = 8, 16


#: Keys whose highest waves one task may hold, at four bytes a key.
KEYS_MOST = 100_000_000


def waves(queued: DataFrame, item_keys: DataFrame, one_task_rows: int = ONE_TASK_ROWS, keys_most: int = KEYS_MOST) -> DataFrame:
    """STR-6: item, wave: a round admits the ready items and takes them away; the number of the round that admits an item.

    That is one more than the highest wave of the items before it, in the order of seq and item,
    on any of its keys; so the rounds themselves need not be run. Keys are numbered, and the
    queue is sorted by all tasks into files of some one_task_rows (item, key) rows; one task
    then goes through the files in order, a batch at a time. It holds the highest wave of each
    key, and nothing of the items behind it, so its memory does not grow with the queue. Where
    there are more than keys_most keys, the waves are found in turns (_in_turns). Both are
    evaluated more than once.
    """
    queued, item_keys = queued.select("item", "seq"), item_keys.select("item", "key")
    numbers, n = _numbered(item_keys.select("key").filter("key is not null").distinct())
    if n > keys_most:
        return _in_turns(queued, item_keys, one_task_rows)
    ship_package(queued.sparkSession)
    rows = stage(queued.join(item_keys, "item", "left").join(numbers, "key", "left").select("seq", "item", "number"))
    parts = -(-rows.count() // max(one_task_rows, 1))
    files = sorted(stage(rows.repartitionByRange(max(parts, 1), "seq", "item").sortWithinPartitions("seq", "item")).inputFiles(), key=lambda f: f.rsplit("/", 1)[1])  # in the order of partitions
    return stage(queued.sparkSession.range(0, 1, 1, 1).mapInArrow(_through(files, n), f"item {dict(rows.dtypes)['item']}, wave long"))


def _numbered(keys: DataFrame) -> tuple[DataFrame, int]:
    """key, number from 0 without gaps, for distinct keys; and how many there are."""
    at = stage(keys.select("key", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a task
    starts, n = [], 0
    for r in sizes:
        starts.append((r["part"], n))
        n += r["n"]
    before = at.sparkSession.createDataFrame(starts, "part long, start long")
    number = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    return at.withColumn("part", part).join(F.broadcast(before), "part").select("key", number.cast("int").alias("number")), n


def _through(files: list[str], n: int):
    """Waves of the items of files (item, number of a key; in the order of the queue, the rows of an item following one another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = array("i", bytes(4 * n))

        def admitted(keys: list[int]) -> int:
            wave = 0
            for k in keys:
                if k >= 0 and high[k] > wave:
                    wave = high[k]
            wave += 1
            for k in keys:
                if k >= 0:
                    high[k] = wave
            return wave

        for _ in batches:
            item, keys = None, None  # the last item so far, which may go on
            for name in files:
                store, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), re.sub("^file:/+", "/", name))
                with store.open_input_file(path) as source:
                    for batch in pq.ParquetFile(source).iter_batches(ONE_TASK_ROWS, columns=["item", "number"]):
                        if not batch.num_rows:
                            continue
                        numbers = batch.column("number").fill_null(-1).to_numpy().tolist()
                        runs = pc.run_end_encode(batch.column("item"))
                        ends, items = [0, *runs.run_ends.to_pylist()], runs.values
                        held = [numbers[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                        if keys is not None and item.equals(items[:1]):
                            held[0] = keys + held[0]
                        elif keys is not None:
                            held, items = [keys, *held], pa.concat_arrays([item, items])
                        if len(held) > 1:
                            yield pa.RecordBatch.from_arrays([items[:-1], pa.array([admitted(h) for h in held[:-1]], pa.int64())], ["item", "wave"])
                        item, keys = items[-1:], held[-1]
            if keys is not None:
                yield pa.RecordBatch.from_arrays([item, pa.array([admitted(keys)], pa.int64())], ["item", "wave"])

    return run


def _in_turns(queued: DataFrame, item_keys: DataFrame, one_task_rows: int) -> DataFrame:
    """waves, without holding all keys.

    The queue is cut in blocks of some one_task_rows (item, key) rows. A task goes through a
    block in order, from the highest waves of its keys in the blocks before, as far as these are
    known; what it then knows of its keys is carried on, and blocks that began from too little
    go again, until none did. In a group of n blocks this ends after n turns at most, as the
    first block's waves are right at once, and after few where conflicts are near one another or
    far apart. Groups follow each other. No chain of conflicts, however long, is more jobs or a
    larger task.
    """
    rows, n = blocked(stage(queued.join(item_keys, "item", "left")), ["seq", "item"], max(one_task_rows, 1))
    kinds = dict(rows.dtypes)
    made = f"_block int, item {kinds['item']}, key {kinds['key']}, wave long, had long"
    size = max(GROUP_BLOCKS, -(-n // GROUPS))
    highs, done = rows.select("key", F.lit(0).cast("long").alias("wave")).limit(0), []
    for first in range(0, max(n, 1), size):
        group = rows.filter(F.col("_block").between(first, first + size - 1))
        ends = group.filter("key is not null").select("_block", "key").distinct().select("_block", "key", F.lit(0).cast("long").alias("wave"), F.lit(None).cast("long").alias("had"))
        todo, parts = None, []
        while todo is None or todo:
            known = stage(_carried(highs, ends))
            if parts:
                todo = [r["_block"] for r in known.filter("high > had").select("_block").distinct().collect()]  # at most the blocks of a group
                if not todo:
                    break
            mine = lambda df: df.filter(F.col("_block").isin(todo)) if todo else df  # noqa: B023, E731
            turn = mine(group).select("_block", "seq", "item", "key", F.lit(None).cast("long").alias("high")).unionByName(mine(known).select("_block", "key", "high"), allowMissingColumns=True)
            turn = turn.repartitionById(size, (F.col("_block") - first).cast("int")).sortWithinPartitions("_block", F.col("high").isNull(), "seq", "item")
            parts = [p.filter(~F.col("_block").isin(todo)) for p in parts] + [stage(turn.mapInArrow(_in_turn(), made))]
            whole = reduce(DataFrame.union, parts)
            ends = whole.filter("had is not null").select("_block", "key", "wave", "had")
        done.append(whole.filter("had is null").select("item", "wave"))
        if first + size < n:
            highs = stage(highs.union(ends.select("key", "wave")).groupBy("key").agg(F.max("wave").alias("wave")))
    return reduce(DataFrame.union, done)


def _carried(highs: DataFrame, ends: DataFrame) -> DataFrame:
    """ends (_block, key, wave: the highest on the key by the end of the block, had) with high: the highest wave on the key before the block."""
    before = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    both = ends.unionByName(highs.withColumn("_block", F.lit(-1)), allowMissingColumns=True)
    return both.withColumn("high", F.coalesce(F.max("wave").over(before), F.lit(0))).filter("_block >= 0")


def _in_turn():
    """Waves of items in the order of the queue, for each block by itself, and then the highest wave on each of its keys with the one it began from (had).

    Rows of a block: first those with high, the highest wave on a key before it; then those of items, the rows of an item following one another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, high, came, item, keys, out, kinds = None, {}, {}, None, None, [], None

        def close() -> None:
            wave = 1 + max((high.get(k, 0) for k in keys), default=0)
            high.update(dict.fromkeys(keys, wave))
            out.append((block, item, None, wave, None))

        def made() -> pa.RecordBatch:
            ends = [(block, None, k, high[k], h) for k, h in came.items()]
            cols = zip(*(out + ends), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["_block", "item", "key", "wave", "had"])

        for batch in batches:
            kinds = [pa.int32(), batch.schema.field("item").type, batch.schema.field("key").type, pa.int64(), pa.int64()]
            for b, i, key, h in zip(*(batch.column(c).to_pylist() for c in ("_block", "item", "key", "high")), strict=True):
                if (b != block or i != item) and keys is not None:
                    close()
                    keys = None
                if b != block:
                    if out:
                        yield made()
                    block, high, came, out = b, {}, {}, []
                if h is not None:
                    high[key] = came[key] = h
                    continue
                if keys is None:
                    item, keys = i, []
                if key is not None:
                    keys.append(key)
        if keys is not None:
            close()
        if out:
            yield made()

    return run


@REG.add("str_admission_waves")
def str_admission_waves(spark, sf_dir):
    """STR-6: all queued orders in batches that can go one after another without conflicts. (No SQL twin: a recursive one over all orders is too slow; tests hold it to a plain version.)"""
    queued = stage(items(spark, sf_dir).filter("state = 'queued'").select("item", "seq"))
    mine = stage(keys(spark, sf_dir).join(queued.select("item"), "item", "left_semi"))
    return waves(queued, mine)


@REG.add("str_admission_round", with_sql("""
SELECT q.item, CASE WHEN b.item IS NULL THEN 'admitted' ELSE 'waiting' END AS outcome, q.age + CASE WHEN b.item IS NULL THEN 0 ELSE 1 END AS age FROM q LEFT JOIN b USING (item)""", k=KEYS_SQL, i=ITEMS_SQL,
    busy="SELECT DISTINCT k.key FROM k JOIN i USING (item) WHERE i.state = 'active' OR (i.state = 'queued' AND i.item % 50 = 0)",
    q="SELECT item, seq, item % 4 AS age FROM i WHERE state = 'queued' AND item % 50 <> 0",
    m="SELECT k.item, k.key, row_number() OVER (PARTITION BY k.key ORDER BY q.age DESC, q.seq) AS place FROM k JOIN q USING (item)",
    b="SELECT DISTINCT item FROM m WHERE place > 1 OR key IN (SELECT key FROM busy)"))
def str_admission_round(spark, sf_dir):
    """STR-6: one round over all queued orders that have waited some rounds already, beside active and offered ones (every fiftieth is on offer)."""
    i, k = items(spark, sf_dir), keys(spark, sf_dir)
    offered = (F.col("state") == "queued") & (F.col("item") % 50 == 0)
    busy = k.join(i.filter((F.col("state") == "active") | offered).select("item"), "item", "left_semi").select("key").distinct()
    queued = i.filter("state = 'queued' and item % 50 <> 0").select("item", "seq", (F.col("item") % 4).alias("age"))
    return admission_round(queued, k, busy)


def admission_round(queued: DataFrame, item_keys: DataFrame, busy: DataFrame) -> DataFrame:
    """STR-6: item, outcome, age. An item is admitted if on none of its keys, all free, another waits that is older in rounds or, at equal age, in sequence; the rest age by one.

    queued: item, seq, age; busy: keys of active and offered items.
    """
    mine = item_keys.join(queued, "item").withColumn("rank", F.struct(-F.col("age"), F.col("seq")))
    first = mine.groupBy("key").agg(F.min("rank").alias("first"))
    behind = mine.join(first, "key").filter("rank > first").select("item")
    held = mine.join(busy, "key", "left_semi").select("item")
    waiting = behind.union(held).distinct().withColumn("waits", F.lit(True))
    out = queued.join(waiting, "item", "left")
    return out.select("item", F.when(F.col("waits"), "waiting").otherwise("admitted").alias("outcome"), (F.col("age") + F.when(F.col("waits"), 1).otherwise(0)).alias("age"))


@REG.add("set_pairwise_disjoint", with_sql("SELECT key, count(*) AS holders, min(item) AS first_item FROM k JOIN i USING (item) WHERE i.state = 'active' GROUP BY key HAVING count(*) > 1", k=KEYS_SQL, i=ITEMS_SQL))
def set_pairwise_disjoint(spark, sf_dir):
    """SET-6: keys that more than one active item holds."""
    held = keys(spark, sf_dir).join(items(spark, sf_dir).filter("state = 'active'").select("item"), "item", "left_semi")
    return held.groupBy("key").agg(F.count("*").alias("holders"), F.min("item").alias("first_item")).filter("holders > 1")


#: An order's lines are the changes of one delta: a line returned (R) is deleted, one accepted (A) is moved to the order, another has its payload written.
#: The scope of an order grants its first two lines, their parts, and the order itself if it is final (F).
NEEDED_SQL = """
SELECT DISTINCT item, kind, r FROM (
  SELECT l_orderkey AS item, 'write' AS kind, 'node:L' || l_orderkey || '-' || l_linenumber AS r FROM lineitem
  UNION ALL SELECT l_orderkey, 'write', 'edge:L' || l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, 'reserve', 'node:P' || l_partkey FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, 'reserve', 'node:O' || l_orderkey FROM lineitem WHERE l_returnflag <> 'N')"""
GRANTED_SQL = """
SELECT DISTINCT item, kind, r FROM (
  SELECT l_orderkey AS item, 'write' AS kind, 'node:L' || l_orderkey || '-' || l_linenumber AS r FROM lineitem WHERE l_linenumber <= 2
  UNION ALL SELECT l_orderkey, 'write', 'edge:L' || l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_linenumber <= 2
  UNION ALL SELECT l_orderkey, 'reserve', 'node:P' || l_partkey FROM lineitem WHERE l_linenumber <= 2
  UNION ALL SELECT o_orderkey, 'reserve', 'node:O' || o_orderkey FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT l_orderkey, 'write', 'node:L' || l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_linenumber > 5
  UNION ALL SELECT l_orderkey, 'reserve', 'node:P' || l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 45)"""


def needed_authority(lines: DataFrame) -> DataFrame:
    """SET-4: item, kind, r: what a delta must be allowed to write and to have reserved. A written payload alone does not touch the parent."""
    line, part, order = F.concat_ws("-", F.concat(F.lit("L"), F.col("l_orderkey")), "l_linenumber"), F.concat(F.lit("node:P"), F.col("l_partkey")), F.concat(F.lit("node:O"), F.col("l_orderkey"))
    entry = lambda kind, r: F.struct(F.lit(kind).alias("kind"), r.alias("r"))
    moved, shape = F.col("l_returnflag") == "A", F.col("l_returnflag") != "N"
    wants = F.array(entry("write", F.concat(F.lit("node:"), line)), F.when(moved, entry("write", F.concat(F.lit("edge:"), line))), F.when(moved, entry("reserve", part)), F.when(shape, entry("reserve", order)))
    return lines.select(F.col("l_orderkey").alias("item"), F.explode(F.array_compact(wants)).alias("w")).select("item", "w.kind", "w.r").distinct()


def allowances(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """SET-4: what needs no grant: children that the delta itself makes (lines after the fifth), and pinned targets (large parts)."""
    line = F.concat_ws("-", F.concat(F.lit("node:L"), F.col("l_orderkey")), "l_linenumber")
    new = lines.filter("l_linenumber > 5").select(F.col("l_orderkey").alias("item"), F.lit("write").alias("kind"), line.alias("r"))
    pinned = lines.join(parts.filter("p_size >= 45").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    return new.union(pinned.select(F.col("l_orderkey").alias("item"), F.lit("reserve"), F.concat(F.lit("node:P"), F.col("l_partkey"))))


@REG.add("set_authority_gap", with_sql("""
SELECT item, kind, count(*) AS missing, min(r) AS first_key FROM (SELECT * FROM needed EXCEPT SELECT * FROM granted) GROUP BY ALL""", needed=NEEDED_SQL, granted=GRANTED_SQL))
def set_authority_gap(spark, sf_dir):
    """SET-4: what the delta of each order writes or touches beyond its scope, by kind."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    first = needed_authority(lines.filter("l_linenumber <= 2").withColumn("l_returnflag", F.lit("A"))).filter("r not like 'node:O%'")
    final = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item"), F.lit("reserve").alias("kind"), F.concat(F.lit("node:O"), F.col("o_orderkey")).alias("r"))
    allowed = first.union(final).union(allowances(lines, read(spark, sf_dir, "part")))
    return authority_gap(needed_authority(lines), allowed)


def authority_gap(needed: DataFrame, granted: DataFrame) -> DataFrame:
    """item, kind, missing, first_key of the authority needed and not granted."""
    return needed.join(granted.distinct(), ["item", "kind", "r"], "left_anti").groupBy("item", "kind").agg(F.count("*").alias("missing"), F.min("r").alias("first_key"))


@REG.add("set_scope_drift", with_sql("""
SELECT item, CASE WHEN gone = 0 AND new = 0 THEN 'unchanged' WHEN gone = 0 THEN 'expanded' WHEN new = 0 THEN 'contracted' ELSE 'material' END AS drift, new::BIGINT AS new, gone::BIGINT AS gone FROM (
  SELECT item, count_if(key % 7 = 0 AND key % 11 <> 0) AS new, count_if(key % 11 = 0 AND key % 7 <> 0) AS gone FROM k GROUP BY item)""", k=KEYS_SQL))
def set_scope_drift(spark, sf_dir):
    """SET-5: the old scope lacks keys divisible by 7, the new one those divisible by 11."""
    k = F.col("key")
    scopes = keys(spark, sf_dir).groupBy("item").agg(F.collect_set(F.when(k % 7 != 0, k)).alias("old"), F.collect_set(F.when(k % 11 != 0, k)).alias("new"))  # an order's own parts
    n, g = F.size(F.array_except("new", "old")).cast("long"), F.size(F.array_except("old", "new")).cast("long")
    drift = F.when((n == 0) & (g == 0), "unchanged").when(g == 0, "expanded").when(n == 0, "contracted").otherwise("material")
    return scopes.select("item", drift.alias("drift"), n.alias("new"), g.alias("gone"))


@REG.add("set_scope_fingerprint", with_sql("SELECT item, sha256(string_agg(key::VARCHAR, ',' ORDER BY key)) AS fingerprint, count(*) AS n FROM k GROUP BY item", k=KEYS_SQL))
def set_scope_fingerprint(spark, sf_dir):
    """SET-7, SET-8: sorted distinct keys, and their hash."""
    listed = F.array_sort(F.collect_set("key"))
    return keys(spark, sf_dir).groupBy("item").agg(F.sha2(F.array_join(listed.cast("array<string>"), ","), 256).alias("fingerprint"), F.count("*").alias("n"))


@REG.add("agg_merged_scopes", """
SELECT o_custkey AS change_set, count(DISTINCT l_partkey) AS keys, min(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END) AS policy, bool_or(o_orderstatus = 'P') AS needs_decision,
  string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def agg_merged_scopes(spark, sf_dir):
    """AGG-34: scopes of all intents of a change set: united keys, the strictest policy, any need of a decision."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("change_set"), "o_orderstatus",
        F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2).alias("policy"))
    j = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey")
    return j.groupBy("change_set").agg(F.countDistinct("l_partkey").alias("keys"), F.min("policy").alias("policy"), F.bool_or(F.col("o_orderstatus") == "P").alias("needs_decision"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"))


SCOPE_SQL = """
SELECT o_orderkey AS intent, 'write' AS part, 'node:O' || o_orderkey AS r FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'read', 'node:O' || o_orderkey FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'read', 'edge:O' || o_orderkey FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'write', 'node:' || n.id FROM orders JOIN nodes n ON n.parent_id = 'O' || o_orderkey WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'read', 'edge:' || n.id FROM orders JOIN nodes n ON n.parent_id = 'O' || o_orderkey WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'validate', 'to:' || e.to_id FROM orders JOIN nodes n ON n.parent_id = 'O' || o_orderkey JOIN edges e ON e.from_id = n.id WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'reserve', 'children:O' || o_orderkey FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'reserve', 'node:C' || o_custkey FROM orders WHERE o_orderstatus = 'P'"""


@REG.add("set_inferred_scope", with_sql("""
SELECT intent, part, split_part(r, ':', 1) AS class, count(*) AS n, min(r) AS first_key FROM (SELECT DISTINCT * FROM s) GROUP BY ALL""", nodes=NODES_SQL, edges=EDGES_SQL, s=SCOPE_SQL))
def set_inferred_scope(spark, sf_dir):
    """SET-9, FUN-12: what each pending order will write, read, validate and reserve, by class of key."""
    intents = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("intent"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("target"))
    scope = inferred_scope(intents, stage(nodes(spark, sf_dir)), edges(spark, sf_dir))
    return scope.groupBy("intent", "part", key_class(F.col("r")).alias("class")).agg(F.count("*").alias("n"), F.min("r").alias("first_key"))


def inferred_scope(intents: DataFrame, tree: DataFrame, refs: DataFrame) -> DataFrame:
    """SET-9: intent, part, r. An intent (intent, target) rewrites a node and its children.

    It writes and reads the node, reads its edge, writes its children and reads their edges;
    what the children refer to must be validated (its incoming edges change), and the node's
    membership of children and its parent are reserved.
    """
    key = lambda part, kind, c: F.struct(F.lit(part).alias("part"), F.concat(F.lit(kind + ":"), F.col(c)).alias("r"))
    own = tree.select(F.col("id").alias("target"), "parent_id")
    mine = intents.join(own, "target", "left").select("intent", F.explode(F.array(
        key("write", "node", "target"), key("read", "node", "target"), key("read", "edge", "target"), key("reserve", "children", "target"), key("reserve", "node", "parent_id"))).alias("k"))
    kids = intents.join(tree.select(F.col("parent_id").alias("target"), F.col("id").alias("child")), "target").join(refs.select(F.col("from_id").alias("child"), "to_id"), "child", "left")
    theirs = kids.select("intent", F.explode(F.array(key("write", "node", "child"), key("read", "edge", "child"), key("validate", "to", "to_id"))).alias("k"))
    return mine.union(theirs).select("intent", "k.part", "k.r").filter("r is not null").distinct()


@REG.add("str_optimistic_check", with_sql("""
SELECT item, bool_and(seen = now) AS holds, count(*) AS dependencies FROM (SELECT k.item, c.n AS now, CASE WHEN k.key % 9 = 0 THEN c.n - 1 ELSE c.n END AS seen FROM k JOIN c USING (key)) GROUP BY item""", k=KEYS_SQL, c="SELECT key, count(*) AS n FROM k GROUP BY key"))
def str_optimistic_check(spark, sf_dir):
    """STR-11: is every clock that a claim depends on still what it was."""
    k = keys(spark, sf_dir)
    clock = k.groupBy("key").agg(F.count("*").alias("now"))
    deps = k.join(clock, "key").withColumn("seen", F.when(F.col("key") % 9 == 0, F.col("now") - 1).otherwise(F.col("now")))
    return deps.groupBy("item").agg(F.bool_and(F.col("seen") == F.col("now")).alias("holds"), F.count("*").alias("dependencies"))


@REG.add("str_requeue_limit", with_sql("""
SELECT session, seq, CASE WHEN n <= 3 THEN 'requeued' ELSE 'needs_decision' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM l WHERE kind = 'error')""", l=LOG_SQL))
def str_requeue_limit(spark, sf_dir):
    """STR-15: the first three expansions of a change set requeue it, further ones need a decision."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    return log(spark, sf_dir).filter("kind = 'error'").select("session", "seq", F.when(n <= 3, "requeued").otherwise("needs_decision").alias("outcome"))


@REG.add("win_priority_order", """
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'""")
def win_priority_order(spark, sf_dir):
    """WIN-15: higher age first, then sequence, within each queue."""
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderkey") % 4).desc(), "o_orderkey")
    return read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("place"))


QUERIES, SQL = REG.queries, REG.sql
