"""Deep trees, versions on disk, the mirror over restarts, bounds that are errors, and plain versions of folds."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from coppice.operators import admission, audit, edits, refs, stats, tree, vectors, versions
from coppice.plans.digests import row_text, summed_digest
from coppice.plans.staging import folder
from coppice.sources import files
from coppice.streaming.jobs import run_to_table
from coppice.streaming.mirror import Mirror
from coppice.streaming.processors import leases, lifecycles, rocks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- trees ------------------------------------------------------------------------------------


def chain(spark, n):
    return spark.createDataFrame([(f"n{i:04}", "k", None if i == 0 else f"n{i - 1:04}") for i in range(n)], "id string, kind string, parent_id string")


def test_a_chain_of_200_levels(spark):
    t = chain(spark, 200)
    assert rows(tree.ancestry(t, path=True).select("id", "root", "depth")) == [(f"n{i:04}", "n0000", i) for i in range(200)]
    assert rows(tree.descend(t, t.filter("id = 'n0003'")).select("id", "depth")) == [(f"n{i:04}", i - 3) for i in range(3, 200)]
    seeds = t.filter("id = 'n0070'")
    assert rows(tree.lifted_closure(t, seeds)) == [(f"n{i:04}",) for i in range(1, 200)]


def test_each_node_counts_under_its_nearest_stop(spark):
    t = chain(spark, 9)
    got = rows(tree.ancestry(t, t.filter("id in ('n0003', 'n0006')").select("id")).select("id", "root"))
    assert got == [(f"n{i:04}", f"n{i // 3 * 3:04}") for i in range(9)]
    assert rows(tree.descend(t, t.filter("id in ('n0003', 'n0006')")).select("id", "root")) == got[3:]


def test_cycles_and_loose_ends_have_no_root(spark):
    t = spark.createDataFrame([("a", "k", None), ("b", "k", "c"), ("c", "k", "b"), ("d", "k", "c"), ("e", "k", "gone"), ("f", "k", "e"), ("g", "k", "g")], "id string, kind string, parent_id string")
    assert rows(tree.ancestry(t).select("id")) == [("a",)]
    assert rows(tree.parent_faults(t)) == [("b", "cycle"), ("c", "cycle"), ("d", "cycle"), ("e", "dangling"), ("f", "under_dangling"), ("g", "cycle")]


def test_random_trees_as_in_plain_python(spark):
    rnd = random.Random(5)
    parent = {i: None if i < 3 else rnd.randrange(max(0, i - 4), i) for i in range(300)}
    t = spark.createDataFrame([(str(i), "k", None if p is None else str(p)) for i, p in parent.items()], "id string, kind string, parent_id string")

    def up(i):
        path = [i]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        return path[::-1]

    want = sorted((str(i), str(up(i)[0]), len(up(i)) - 1, "/".join(map(str, up(i)))) for i in parent)
    assert rows(tree.ancestry(t, path=True).select("id", "root", "depth", "path")) == want


# --- versions ---------------------------------------------------------------------------------


def lines_of(spark, texts):
    return spark.createDataFrame([(m, i, x) for m, t in texts.items() for i, x in enumerate(t)], "module long, child_index long, payload string")


def test_generations_commit_and_roll_back(spark):
    made = edits.Generations(spark, folder(spark, "g"))
    assert made.head() == -1
    made.seed(lines_of(spark, {1: ["one", "two"], 2: ["three"]}))
    edit = spark.createDataFrame([(1, 0, 0, 3, "one", "ONE"), (2, 0, 1, 2, "h", "H")], "module long, child_index long, start_at int, end_at int, old string, new string")
    assert made.commit("t", edit) == 1
    assert rows(made.read(1)) == [(1, 0, "ONE"), (1, 1, "two"), (2, 0, "tHree")]
    with pytest.raises(ValueError):
        made.commit("u", edit)
    assert made.head() == 1
    again = edits.Generations(spark, made.path)
    assert again.rollback("t") == 2 and again.rollback("t") == 2 and again.rollback("unknown") == 2
    assert rows(again.read(2)) == rows(again.read(0))
    log = again.log().filter("module is not null")
    assert rows(log.select("generation", "tx", "kind", "module", "n")) == [(1, "t", "commit", 1, 1), (1, "t", "commit", 2, 1), (2, "t", "rollback", 1, 1), (2, "t", "rollback", 2, 1)]


def test_recovery_refuses_other_changes(spark):
    snap = spark.createDataFrame([(1, "x")], "key long, value string")
    delta = spark.createDataFrame([(5, 0, "upsert", 1, "y"), (6, 0, "upsert", 2, "z")], "generation long, pos long, op string, key long, value string")
    recorded = delta.groupBy("generation").agg(summed_digest(row_text("pos", "op", "key", "value")).alias("digest"))
    assert rows(versions.recover(snap, 4, delta, recorded)) == [(1, "y"), (2, "z")]
    with pytest.raises(ValueError, match="generation 6"):
        versions.recover(snap, 4, delta.filter("generation = 5"), recorded)
    with pytest.raises(ValueError, match="generation 5"):
        versions.recover(snap, 4, delta.withColumn("value", F.lit("other")), recorded)


def test_retained_batches_are_contiguous(spark):
    log = spark.createDataFrame([(g, 1, 1) for g in (1, 2, 4, 5, 6)], "generation long, n long, bytes long")
    kept = versions.retained(log, 10, 10)
    assert [r[0] for r in rows(kept.select("generation"))] == [4, 5, 6]
    assert [r[0] for r in rows(versions.batch_of(kept, 4, 6).select("generation"))] == [5, 6]
    for base, target in ((3, 7), (2, 5), (6, 6)):
        with pytest.raises(ValueError):
            versions.batch_of(kept, base, target)


def test_bind_next_refuses_a_trailing_record(spark):
    rec = spark.createDataFrame([(1, 1), (1, 5)], "k int, t long")
    req = spark.createDataFrame([(1, 3)], "k int, t long")
    assert {r["t"]: r["request"] for r in versions.bind_next(rec, req, ["k"], "t", "null").collect()} == {1: 3, 5: None}
    assert rows(versions.bind_next(rec, req, ["k"], "t", "drop")) == [(1, 1, 3)]
    with pytest.raises(Exception, match="no request follows"):
        versions.bind_next(rec, req, ["k"], "t").collect()


# --- the mirror -------------------------------------------------------------------------------

FRAME = "frame long, pos long, op string, key long, value string"


def digest(spark, content):
    return versions.content_digest(spark.createDataFrame(sorted(content.items()), "key long, value string"), ["key", "value"]).first()["digest"]


def test_mirror_over_a_restart(spark):
    states = [{1: "a", 2: "b"}, {1: "a2", 3: "c"}, {1: "a2", 3: "c", 4: "d"}]
    d = [digest(spark, s) for s in states]
    one = spark.createDataFrame([(0, 0, "upsert", 1, "a1"), (0, 1, "upsert", 1, "a2"), (0, 2, "delete", 2, None), (0, 3, "upsert", 3, "c")], FRAME)
    two = spark.createDataFrame([(1, 0, "upsert", 4, "d")], FRAME)
    f = lambda n, base, a, b: {"frame": n, "base": base, "base_digest": a, "target_digest": b}
    path = folder(spark, "mirror")
    m = Mirror(spark, path, "key", ["value"])
    assert m.sync(f(0, 0, d[0], d[1]), one) == "gap"
    start = spark.createDataFrame(sorted(states[0].items()), "key long, value string")
    assert m.hydrate(start, "other") == "digest-mismatch" and m.head() is None
    assert m.hydrate(start, d[0]) == "attest"
    assert m.sync(f(0, 0, d[0], d[2]), one) == "digest-mismatch"  # and nothing of it stays
    assert m.head()["digest"] == d[0] and dict(rows(m.rows())) == states[0]
    assert m.sync(f(0, 0, d[0], d[1]), one) == "attest"
    again = Mirror(spark, path, "key", ["value"])  # after a restart
    assert again.sync(f(0, 0, d[0], d[1]), one) == "done"
    assert again.sync(f(7, 0, d[0], d[1]), one) == "ahead" and again.sync(f(7, 5, d[1], d[2]), two) == "gap"
    assert again.sync(f(7, 1, d[0], d[2]), two) == "digest-mismatch"
    assert again.sync(f(7, 1, d[1], d[2]), two.withColumn("granted", F.lit(False))) == "scope"
    assert again.sync(f(7, 1, d[1], d[2]), two.withColumn("seen", F.lit(3).cast("long"))) == "stale"
    assert again.sync(f(1, 1, d[1], d[2]), two.withColumn("seen", F.lit(0).cast("long"))) == "attest"
    assert dict(rows(again.rows())) == states[2] and again.head()["digest"] == d[2]
    assert {r["key"]: r["clock"] for r in again.rows(clocks=True).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_mirror_compacts(spark):
    m = Mirror(spark, folder(spark, "mirror"), "key", ["value"])
    m.COMPACT = 2
    content = {0: "x"}
    m.hydrate(spark.createDataFrame(sorted(content.items()), "key long, value string"))
    for i in range(5):
        was = digest(spark, content)
        content = {**content, i: f"v{i}"}
        f = {"frame": i, "base": i, "base_digest": was, "target_digest": digest(spark, content)}
        assert m.sync(f, spark.createDataFrame([(i, 0, "upsert", i, f"v{i}")], FRAME)) == "attest"
    assert dict(rows(m.rows())) == content


def test_refused_hydration_leaves_the_mirror(spark):
    m = Mirror(spark, folder(spark, "mirror"), "key", ["value"], 8)
    good = spark.createDataFrame([(1, "good")], "key long, value string")
    bad = spark.createDataFrame([(1, "BAD"), (2, "BAD")], "key long, value string")
    assert m.hydrate(good, digest(spark, {1: "good"})) == "attest"
    head = m.head()
    assert m.hydrate(bad, "no such digest") == "digest-mismatch"
    assert dict(rows(m.rows())) == {1: "good"} and m.head() == head
    assert m.hydrate(bad, digest(spark, {1: "BAD", 2: "BAD"}), generation=5) == "attest"
    assert dict(rows(m.rows())) == {1: "BAD", 2: "BAD"} and m.head()["generation"] == 5


def test_mirror_touches_only_the_buckets_of_a_frame(spark):
    """A frame reads and writes the buckets of its keys; two mirrors find the buckets that differ."""
    content = {i: f"v{i}" for i in range(200)}
    table = spark.createDataFrame(sorted(content.items()), "key long, value string")
    a, b = (Mirror(spark, folder(spark, "mirror"), "key", ["value"], 64) for _ in range(2))
    for m in (a, b):
        assert m.hydrate(table) == "attest"
    assert a.depth() == 2 and a.differing(b) == []
    assert {r["digest"] for r in a.nodes(0).collect()} == {digest(spark, content)}
    places = {r["bucket"]: r["place"] for r in a.index().collect()}
    after = {**content, 7: "new", 300: "more"}
    change = spark.createDataFrame([(0, 0, "upsert", 7, "new"), (0, 1, "upsert", 300, "more")], FRAME)
    assert a.sync({"frame": 0, "base": 0, "base_digest": digest(spark, content), "target_digest": digest(spark, after)}, change) == "attest"
    moved = {r["bucket"] for r in a.index().collect() if r["place"] != places[r["bucket"]]}
    of = {r["bucket"] for r in change.select(a._bucket()).collect()}
    assert moved == of == set(a.differing(b)) and len(of) <= 2
    assert dict(rows(a.rows())) == after and dict(rows(b.rows())) == content
    assert [tuple(r)[1:] for r in a.events().orderBy("number").collect()] == [(0, -1, "hydrate"), (1, 0, "attest")]


# --- machines and leases ------------------------------------------------------------------------


def plain_lifecycle(log):
    out = {}
    for session, kind, seq, ts in sorted(log, key=lambda r: r[2]):
        state, done, refused, first, last, longest = out.get(session, (None, 0, 0, None, None, 0))
        if audit.allowed(state, kind):
            out[session] = (kind, done + 1, refused, ts if first is None else first, ts, max(longest, ts - last if last is not None else 0))
        else:
            out[session] = (state, done, refused + 1, first, last, longest)
    return {k: (s, d, r, None if f is None else la - f, lo) for k, (s, d, r, f, la, lo) in out.items()}


LOG = "session long, kind string, seq long, ts_ms long"


def machine_log(n=300):
    rnd = random.Random(2)
    kinds = ["signup", "view", "click", "error", "purchase", "odd"]
    log = [(rnd.choice([0, 0, 0, 1, 2, 3]), rnd.choices(kinds, [4, 6, 6, 3, 1, 1])[0], i, i * 7000 + rnd.randrange(9000)) for i in range(n)]
    return [*log, (8, "signup", n, 0), (8, "purchase", n + 1, 5), (8, "view", n + 2, 9), (9, "signup", n + 3, 0), (9, "signup", n + 4, 1), (10, "odd", n + 5, 3), (11, "view", n + 6, 0), (11, "purchase", n + 7, 1), (11, "view", n + 8, 2)]


@pytest.mark.parametrize("fold_rows", [7, 50, 10_000])
def test_refused_transitions_change_nothing(spark, fold_rows):
    """Functions of blocks of events, composed, give what a fold event by event gives; one session has half of all events."""
    log = machine_log()
    got = {r[0]: tuple(r)[1:] for r in audit.lifecycle(spark.createDataFrame(log, LOG).repartition(5), fold_rows).collect()}
    want = plain_lifecycle(log)
    assert got == want
    assert got[8][:3] == ("view", 2, 1) and got[9][:3] == ("signup", 1, 1) and got[10][:3] == (None, 0, 1) and got[11][:3] == ("purchase", 2, 1)


def streamed(spark, make, log, cuts, ddl):
    """What a stream gives whose micro-batches end at these places."""
    path, out = folder(spark, "feed"), folder(spark, "out")
    ckpt = folder(spark, "ckpt")
    spark.createDataFrame([], ddl).write.parquet(path)
    for lo, hi in zip((0, *cuts[:-1]), cuts, strict=True):
        spark.createDataFrame(log[lo:hi], ddl).coalesce(1).write.mode("append").parquet(path)
        with rocks(spark):
            run_to_table(make(spark.readStream.schema(ddl).parquet(path)), checkpoint=ckpt, out=out)
    return spark.read.parquet(out)


def test_stream_of_machines(spark):
    log = machine_log(60)
    feed = [(s, k, q) for s, k, q, _ in log]
    got = streamed(spark, lambda f: lifecycles(f, audit.ALLOWED), feed, (31, len(feed)), "session long, kind string, seq long")
    newest = {r["session"]: tuple(r["m"]) for r in got.groupBy("session").agg(F.max_by(F.struct("state", "transitions", "refused"), "seq").alias("m")).collect()}
    assert newest == {k: v[:3] for k, v in plain_lifecycle(log).items()}


def test_leases_expire_without_a_later_event(spark):
    """A lease that nothing follows goes when the watermark passes its end; batch and stream agree."""
    minute = 60_000
    log = [(1, "view", 0, 0), (2, "click", 1, 1 * minute), (3, "signup", 2, 2 * minute), (1, "error", 3, 10 * minute), (4, "view", 4, 20 * minute), (3, "view", 5, 70 * minute), (9, "error", 6, 4999 * minute), (9, "view", 7, 5000 * minute)]
    feed = [(s, k, q, t // minute, datetime.fromtimestamp(t / 1000, UTC)) for s, k, q, t in log]
    got = streamed(spark, lambda f: leases(f, audit.LEASE), feed, (3, 6, 8), "session long, kind string, seq long, tick long, at timestamp")
    gone = sorted(tuple(r)[:4] for r in got.select("session", "seq", "event", "outcome").collect())
    assert gone == [(2, 1, "lease_expired", "cancelled"), (3, 2, "lease_expired", "requeued"), (3, 5, "lease_expired", "requeued"), (4, 4, "lease_expired", "requeued")]
    batch = audit.expired_leases(spark.createDataFrame(log, LOG), 3).filter("expired").select("session", "seq", "event", "outcome")
    assert sorted(tuple(r) for r in batch.collect()) == gone


# --- bounds, folds, files ---------------------------------------------------------------------


def test_bounds_are_errors(spark):
    many = spark.range(70).withColumnRenamed("id", "seq")
    assert refs.matches_within(many, 70).count() == 70
    with pytest.raises(ValueError):
        refs.matches_within(many, 64)
    assert audit.page_after(many, "seq", 5, 10).count() == 10
    assert audit.page_after(many, "seq", 60, 10, complete=True).count() == 9
    with pytest.raises(ValueError):
        audit.page_after(many, "seq", 5, 10, complete=True)


@pytest.mark.parametrize("bound", [0, 40, 200_000])
def test_waves_as_in_plain_python(spark, bound):
    rnd = random.Random(3)
    held = {i: {rnd.randrange(30) for _ in range(rnd.randrange(4))} for i in range(60)}
    high, want = {}, []
    for i in range(60):
        w = 1 + max((high.get(k, 0) for k in held[i]), default=0)
        high.update(dict.fromkeys(held[i], w))
        want.append((i, w))
    q = spark.createDataFrame([(i, i) for i in held], "item long, seq long")
    k = spark.createDataFrame([(i, x) for i, ks in held.items() for x in ks], "item long, key long")
    assert rows(admission.waves(q, k, bound)) == want
    assert admission.waves(q.limit(0), k.limit(0), bound).count() == 0


def test_percentiles_are_exact(spark):
    import statistics

    rnd = random.Random(1)
    data = [(g, rnd.choice([rnd.random(), 5.0, -1e6, 1e9])) for g in range(3) for _ in range(rnd.randrange(1, 400))] + [(9, 2.5), (8, None)]
    df = spark.createDataFrame(data, "g int, v double").repartition(3)
    shares = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 1.0, "e": 0.0}
    got = {r["g"]: r for r in stats.percentiles(df, ["g"], "v", shares).collect()}
    smooth = {r["g"]: r for r in stats.percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.5}, interpolated=True).collect()}
    assert set(got) == {0, 1, 2, 9}
    for g in got:
        v = sorted(x for k, x in data if k == g)
        for name, p in shares.items():
            assert got[g][name] == v[max(1, -(-int(p * 100) * len(v) // 100)) - 1]
        assert smooth[g]["b"] == pytest.approx(statistics.median(v))
        at = (len(v) - 1) * 0.25
        assert smooth[g]["a"] == pytest.approx(v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at)))


def test_checkpoints_are_refused_ahead_or_with_another_digest(spark):
    df, path = spark.range(5), folder(spark, "snap")
    good = versions.content_digest(df, ["id"]).first()["digest"]
    for generation, head, d in ((6, 5, good), (3, 5, "other")):
        with pytest.raises(ValueError):
            files.export_snapshot(df, path, generation, ["id"], head, d)
    files.export_snapshot(df, path, 3, ["id"], 5, good)
    assert spark.read.parquet(path).count() == 5


def test_chain_audit(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sound = []
    prev = ""
    for i in range(5):
        entry = sha(f"{prev}|b{i}")
        sound.append([i, prev, entry, f"b{i}"])
        prev = entry
    journals = {"sound": sound, "changed": [[*r[:3], "x"] if r[0] == 2 else r for r in sound], "cut": sound[:4] + [[4, sound[4][1], None, "b"]], "hole": [r for r in sound if r[0] != 1], "inner": [[r[0], r[1], None, r[3]] if r[0] == 1 else r for r in sound]}
    df = spark.createDataFrame([(name, *r) for name, j in journals.items() for r in j], "j string, seq long, previous_hash string, entry_hash string, body string")
    assert rows(audit.chain_breaks(df, "j")) == [("changed", 2, 5, False), ("cut", -1, 4, True), ("hole", 2, 4, False), ("inner", 1, 5, False), ("sound", -1, 5, False)]


def test_embeddings_are_refreshed_where_they_changed(spark):
    calls = []
    c = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "")], "doc_id long, context string")
    empty = spark.createDataFrame([], "doc_id long, embedding array<float>, content_hash string")
    first, counts = vectors.refresh_embeddings(c, empty, vectors.hashing_provider(8), 8, "m")
    assert tuple(counts.first()) == (3, 0, 3)
    held = spark.createDataFrame(first.collect(), first.schema)
    now = c.withColumn("context", F.when(F.col("doc_id") == 2, "d d").otherwise(F.col("context")))
    after, counts = vectors.refresh_embeddings(now, held, vectors.hashing_provider(8), 8, "m")
    assert tuple(counts.first()) == (1, 2, 3) and not calls
    assert {r["doc_id"]: sum(r["embedding"]) for r in after.collect()} == {1: 2.0, 2: 2.0, 3: 0.0}


def test_a_folder_is_wanted_on_a_cluster(spark, monkeypatch):
    from coppice.plans import staging

    class Far:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Far)
