"""Small cases of what went wrong, or grew too fast, on larger tables."""

import glob
import hashlib
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from coppice.operators import admission, extensions, recovery, refs, stats, tree
from coppice.plans import digests, joins
from coppice.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rendered_files_of_any_module_id(spark, tmp_path):
    docs = [(-5, "a\nb"), (7, ""), (None, "x"), (12, "é")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = [(i, hashlib.sha256((t + "\n").encode()).hexdigest(), len(t.encode()) + 1) for i, t in docs]
    assert rows(files.src_render_tree(spark, str(tmp_path))) == sorted(made, key=str)


def test_arm_ratio_on_the_edge_of_a_place(spark):
    parts = [(1, "click", 600.5), (1, "click", 44.02), (1, "view", 670.72), (2, "view", 0.1), (2, "view", 0.2), (2, "click", 0.375)]
    df = spark.createDataFrame(parts, "session long, kind string, value double")
    for order in (F.col("value"), F.col("value").desc()):
        got = rows(stats.arm_costs(df.repartition(1).sortWithinPartitions(order)))
        assert got == [(1, 644.52, 670.72, 0.960938, False), (2, 0.375, 0.3, 1.25, False)]  # 0.9609375, and exactly at the threshold


def test_leaves_are_in_no_round_of_ancestry(spark, monkeypatch):
    mids = [(f"m{i}", "mid", "r") for i in range(3)] + [(f"n{i}", "mid", f"m{i}") for i in range(3)]
    leaves = [(f"x{i}", "leaf", f"n{i % 3}") for i in range(60)]
    lost = [("c", "mid", "d"), ("d", "mid", "c"), ("under", "leaf", "c"), ("gone", "leaf", "nowhere"), ("alone", "root", None)]
    df = spark.createDataFrame([("r", "root", None), *mids, *leaves, *lost], "id string, kind string, parent_id string")
    sizes, stage = [], tree.stage
    monkeypatch.setattr(tree, "stage", lambda d: sizes.append(d.count()) or stage(d))
    got = {r["id"]: tuple(r)[1:] for r in tree.ancestry(df, path=True).select("id", "root", "depth", "path").collect()}
    assert len(got) == 1 + 6 + 60 + 1
    assert got["x4"] == ("r", 3, "r/m1/n1/x4") and got["alone"] == ("alone", 0, "alone")
    assert max(sizes[1:]) < 60
    under = {r["id"]: (r["root"], r["depth"]) for r in tree.ancestry(df, df.filter("id in ('m1', 'x0')").select("id")).collect()}
    assert under["x4"] == ("m1", 2) and under["x0"] == ("x0", 0) and under["x3"] == ("r", 3)


def test_edges_without_source_meet_no_null_parent(spark):
    edges = spark.createDataFrame([("o1", "c1", "value"), ("l1", "p1", "type"), ("l2", "p1", "type"), ("o2", "c9", "value")], "from_id string, to_id string, kind string")
    sources = spark.createDataFrame([("o1", "c1"), ("o2", "c9")], "from_id string, parent_id string")
    nodes = spark.createDataFrame([("c1", "Customer"), ("o1", "Order")], "id string, kind string")
    out = refs.enriched_uses(edges, sources, nodes)
    assert rows(out.select("from_id", "parent_id", "under")) == sorted([("o1", "c1", "Customer"), ("l1", None, None), ("l2", None, None), ("o2", "c9", None)], key=str)


def test_resolved_links_are_distinct_without_an_exchange(spark, sf_dir):
    got = refs.joi_resolve_all(spark, sf_dir)
    assert got.count() == got.distinct().count()
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_digest_parts_are_sums_of_longs(spark):
    texts = [f"row {i}" for i in range(500)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    made = df.agg(*digests.summed_parts(F.col("t")))
    hashes = [hashlib.sha256(("\0" if t is None else t).encode()).hexdigest() for t in texts]
    assert tuple(made.first()) == (502, *[sum(int(h[15 * i : 15 * i + 15], 16) for h in hashes) for i in range(4)])
    assert "as decimal(38,0)))" not in made._jdf.queryExecution().analyzed().toString()  # no sum takes decimals
    assert df.filter("t = 'none'").agg(*digests.summed_parts(F.col("t"))).first()["s0"] is None


def test_name_rows_are_whole_tokens_and_shuffle_nothing(spark):
    lines = [(1, 0, "def run(x)"), (1, 1, "def runs"), (1, 2, "defer a"), (None, 3, "def run, run"), (2, 0, "é def run"), (2, 1, "")]
    segs = spark.createDataFrame(lines, "module long, child_index long, payload string")
    made = extensions.name_rows(segs, r"^((?:é )?def )(run)")
    assert rows(made) == sorted([(1, 0, "run", 4), (None, 3, "run", 4), (2, 0, "run", 6)], key=str)
    assert rows(extensions.name_rows(segs, r"^(d)(ef)")) == []  # inside a token
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_long_chain_of_conflicts_is_few_turns(spark, monkeypatch):
    items = [(f"i{i}", i // 2) for i in range(300)]
    keys = [(i, 7) for i, _ in items] + [("i5", 8), ("i290", 8), ("i9", None), ("gone", 7)]
    staged, stage = [], admission.stage
    monkeypatch.setattr(admission, "stage", lambda d: staged.append(1) or stage(d))
    got = admission.waves(spark.createDataFrame([*items, ("free", None)], "item string, seq long"), spark.createDataFrame(keys, "item string, key long"), 80)
    order = sorted(items, key=lambda r: (r[1], r[0]))
    assert rows(got) == sorted([("free", 1), *[(i, n + 1) for n, (i, _) in enumerate(order)]], key=str)
    assert len(staged) < 20


def test_large_joins_get_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    ids = spark.range(1000).selectExpr("'o' || id AS id", "'c' || id % 50 AS c")
    edges = ids.selectExpr("id AS from_id", "c AS to_id", "'value' AS kind")
    nodes = ids.selectExpr("c AS id", "'Customer' AS kind").distinct()
    out = refs.enriched_uses(edges, ids.selectExpr("id AS from_id", "c AS parent_id"), nodes)
    assert out.count() == 1000 and out.filter("under = 'Customer'").count() == 1000
    assert "RepartitionByExpression [from_id" in out._jdf.queryExecution().optimizedPlan().toString()


def test_large_logs_are_audited_in_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    ev = spark.range(200).selectExpr("'e' || id AS event_id", "id AS sequence")
    none = lambda ddl: spark.createDataFrame([], ddl)
    found = recovery.recovery_faults(
        1, spark.createDataFrame([(m, 0) for m in recovery.MARKERS], "name string, value long"), none("queue_sequence long"), ev, ev.filter("sequence <> 7"),
        ev.selectExpr("event_id AS resource", "1L AS clock"), ev.filter("sequence <> 9").selectExpr("event_id AS resource"), none("attempt string, generation long, change_set long, digest string"),
        none("change_set long, state string, generation long"), none("generation long, change_set long"), none("generation long, digest string"))
    got = rows(found)
    assert {("index_missing", "e7"), ("clock_missing", "e9")} <= set(got) and not [r for r in got if r[0] in ("index_differs", "event_twice")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [resource") == 2


def test_split_texts_are_few_at_a_time(spark, monkeypatch):
    """Pieces leave Python by runs of texts of so many bytes, and a longer text alone; null texts, ids and none at all are rows as before."""
    monkeypatch.setattr(extensions, "RUN_BYTES", 100)
    texts = [(i, f"a{i}. b. é" * (1 + i % 3)) for i in range(40)] + [(99, "x. " * 200), (100, None), (None, "p. q"), (101, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = [(i, k, piece) for i, t in texts for k, piece in enumerate((t or "").split(". "))]
    made = extensions.split_rows(docs, lambda t: t.split(". "), "doc_id")
    assert rows(made) == sorted(want, key=str)

    seen = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: seen.append(f) or self)
    extensions.split_rows(docs, lambda t: t.split(". "), "doc_id")
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array([t for _, t in texts])], ["id", "text"])
    out = list(seen[0](iter([batch])))
    assert len(out) > 10 and sum(b.num_rows for b in out) == len(want)
    assert all(b.num_rows == 201 or sum(len(x) for x in b.column(2).to_pylist()) <= 100 for b in out)


def test_members_meet_as_rows_and_are_summed_up_by_shares(spark):
    """What is shuffled is rows, not their sums; a key of very many rows is a row a share."""
    edges = [(f"l{i}", f"p{i % 7}", "type") for i in range(300)] + [(None, "p1", "type"), ("x", None, "value")]
    df = spark.createDataFrame(edges, "from_id string, to_id string, kind string").repartition(6)
    want = {r[0]: r[1] for r in df.groupBy("to_id").agg(digests.summed_digest(digests.row_text("from_id", "kind"))).collect()}
    whole = tree.memberships(df, "to_id", "from_id", "kind")
    shares = tree.memberships(df, "to_id", "from_id", "kind", member_rows=60)
    assert {r[0]: r[1] for r in whole.collect()} == {r[0]: r[1] for r in shares.collect()} == want
    steps = [w for w in re.findall("Aggregate|Exchange", whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]) if w]
    assert steps == ["Aggregate", "Aggregate", "Exchange", "Exchange"] or steps == ["Aggregate", "Aggregate", "Exchange"]  # the last one is the table's own
    made = tree.resource_versions(spark.createDataFrame([("p1", "Part", None, None, "x")], "id string, kind string, parent_id string, child_index long, payload string"), df)
    assert made.filter("resource = 'to:p1'").first()["version"] == want["p1"]
    assert "RepartitionByExpression [to_id" in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_staged_frame_leaves_no_shuffle_files(spark):
    from coppice.plans import staging

    kept = lambda: {f for f in glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True)}
    before = kept()
    made = staging.stage(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    for _ in range(20):
        if not kept() - before:
            break
        time.sleep(0.2)
    assert not kept() - before and made.count() == 7
    assert spark.conf.get(staging.CLEANUP) == "false"


def test_rendered_files_are_listed_by_tasks(spark, sf_dir, monkeypatch):
    """The driver has no list of the files, which are as many as the modules."""
    monkeypatch.setattr(files, "BATCH_FILES", 3)
    monkeypatch.setattr(files, "CHUNK", 100)
    made = files.src_render_tree(spark, sf_dir)
    assert made.inputFiles() == [] and "binaryFile" not in made._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert rows(made) == sorted([(r[0], hashlib.sha256((r[1] + "\n").encode()).hexdigest(), len(r[1].encode()) + 1) for r in docs], key=str)


def test_waves_are_one_pass_whatever_the_conflicts(spark, monkeypatch):
    """Each row of the queue is gone through once; as in turns, over many files and batches, with texts, keys that are null and items without one."""
    queue = [(f"i{i:03}", i // 3) for i in range(200)] + [("none", None), ("free", 7)]
    held = [(i, f"k{(hash_ * 7) % 23}") for hash_, (i, _) in enumerate(queue[:200])] + [(i, "hot") for i, _ in queue[40:160:2]] + [("i005", None), ("gone", "hot")]
    q, k = spark.createDataFrame(queue, "item string, seq long"), spark.createDataFrame(held, "item string, key string")
    want = rows(admission.waves(q, k, 30, keys_most=0))
    assert len(want) == 202 and max(w for _, w in want) > 50
    monkeypatch.setattr(admission, "ONE_TASK_ROWS", 7)
    monkeypatch.setattr(admission, "_in_turn", None)
    assert rows(admission.waves(q, k, 30)) == rows(admission.waves(q, k, 10_000)) == want
