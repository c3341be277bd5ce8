"""Transactions on nodes and edges held to plain dicts; refusals leave nothing."""

import random

import pytest
from pyspark.sql import functions as F

from coppice.operators.generations import GRAPH, SUMS, Store
from coppice.operators.versions import rename_report
from coppice.plans.digests import digest_of, row_text, summed_digest
from coppice.plans.staging import folder

NODE = "id string, kind string, parent_id string, child_index long, payload string"
EDGE = "from_id string, to_id string, kind string"


def small(spark):
    store = Store(spark, folder(spark, "store"), GRAPH, buckets=4)
    store.seed(nodes=spark.createDataFrame([(x, "k", None, 0, x) for x in "abcd"], NODE), edges=spark.createDataFrame([("a", "b", "e"), ("b", "c", "e"), ("c", "d", "e")], EDGE))
    return store


def nodes(spark, *rows):
    return spark.createDataFrame([(i, "k", None, 0, p, p is None) for i, p in rows], f"{NODE}, gone boolean")


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, "e", gone) for a, b, gone in rows], f"{EDGE}, gone boolean")


def state(store):
    g = store.head()
    return {r["id"]: r["payload"] for r in store.at("nodes", g).collect()}, sorted(tuple(r)[:2] for r in store.at("edges", g).collect())


SEED = ({x: x for x in "abcd"}, [("a", "b"), ("b", "c"), ("c", "d")])


def test_an_older_transaction_goes_back_under_a_newer_one(spark):
    store = small(spark)
    store.commit("t", nodes=nodes(spark, ("b", None), ("e", "new"), ("nowhere", None)), edges=edges(spark, ("e", "a", False)))
    assert state(store) == ({"a": "a", "c": "c", "d": "d", "e": "new"}, [("c", "d"), ("e", "a")])
    store.commit("u", nodes=nodes(spark, ("d", "D")))
    assert store.rollback("t") == 3 and store.rollback("t") == 3 and store.rollback("unknown") == 3
    assert state(store) == ({**SEED[0], "d": "D"}, SEED[1])
    again = Store(spark, store.path, GRAPH, buckets=4)
    assert again.rollback("u") == 4 and state(again) == SEED
    assert [tuple(r) for r in store.log().filter("name = 'nodes'").orderBy("generation").select("kind", "affected", "inserted", "deleted", "n").collect()] == [
        ("seed", 0, 0, 0, 4), ("commit", 2, 1, 1, 4), ("commit", 1, 0, 0, 4), ("rollback", 2, 1, 1, 4), ("rollback", 1, 0, 0, 4)]


def test_what_is_refused_leaves_nothing(spark):
    store = small(spark)
    with pytest.raises(ValueError, match="edges.to_id"):
        store.commit("t", edges=edges(spark, ("a", "none", False)))
    with pytest.raises(ValueError, match="null or comes twice"):
        store.commit("t", nodes=nodes(spark, ("a", "x"), ("a", "y")))
    with pytest.raises(ValueError, match="null or comes twice"):
        store.commit("t", nodes=nodes(spark, (None, "x")))
    assert store.head() == 0 and state(store) == SEED
    store.commit("t", nodes=nodes(spark, ("e", "E"), ("a", "A")))
    store.commit("u", edges=edges(spark, ("e", "a", False)))
    with pytest.raises(ValueError, match="edges.from_id"):
        store.rollback("t")  # u has since tied an edge to what t put in
    store.commit("v", nodes=nodes(spark, ("a", "AA")))
    with pytest.raises(ValueError, match="has been changed since"):
        store.rollback("t")
    with pytest.raises(ValueError, match="already"):
        store.commit("t", nodes=nodes(spark, ("a", "x")))
    assert store.head() == 3 and state(store) == ({**SEED[0], "a": "AA", "e": "E"}, [("a", "b"), ("b", "c"), ("c", "d"), ("e", "a")])


def test_empty_tables_and_empty_transactions(spark):
    store = Store(spark, folder(spark, "store"), GRAPH, buckets=2)
    store.seed(nodes=spark.createDataFrame([], NODE), edges=spark.createDataFrame([], EDGE))
    assert store.commit("t") == 1 and store.rollback("t") == 2 and state(store) == ({}, [])


def test_many_generations_over_bases_as_in_plain_dicts(spark, monkeypatch):
    monkeypatch.setattr(Store, "COMPACT", 2)
    store, rnd = small(spark), random.Random(3)
    kept, ties = dict(SEED[0]), set(SEED[1])
    for t in range(3):
        before = dict(kept), set(ties)
        put = {rnd.choice("abcdefgh"): f"{t}" for _ in range(2)}
        gone = rnd.choice([x for x in "abcdefgh" if x not in put])
        store.commit(f"t{t}", nodes=nodes(spark, *put.items(), (gone, None)))
        kept = {k: v for k, v in {**kept, **put}.items() if k != gone}
        ties = {e for e in ties if gone not in e}
        assert state(store) == (kept, sorted(ties))
        logged = store.log().filter(F.col("generation") == store.head()).select("name", digest_of(F.col("n"), *[F.col(s) for s in SUMS]).alias("d"))
        want = {n: store.at(n, store.head()).agg(summed_digest(row_text(*GRAPH[n].columns)).alias("d")).first()["d"] for n in GRAPH if store.at(n, store.head()).count()}
        assert {r["name"]: r["d"] for r in logged.collect() if r["name"] in want} == want
    store.rollback("t2")
    assert state(store)[1] == sorted(before[1]) and state(store)[0] == before[0]


def test_a_rename_report_is_capped_and_says_so(spark):
    rows = [(g, p, k, v) for g, p, k, v in ((1, 0, 3, "c"), (1, 1, 2, "b"), (2, 0, 3, "C"), (2, 1, 2, "x"), (3, 0, 2, "b"), (3, 1, 1, "a"), (4, 0, 1, "A"), (4, 1, 1, "AA"))]
    delta = spark.createDataFrame(rows, "generation long, pos long, key long, value string")
    assert [tuple(r) for r in rename_report(delta, 1).collect()] == [(1, 1, "a", "AA", 2, True)]
    assert sorted(tuple(r) for r in rename_report(delta, 2).collect()) == [(1, 1, "a", "AA", 2, False), (2, 3, "c", "C", 2, False)]
    assert rename_report(delta.limit(0)).collect() == []


def test_digests_of_all_generations_read_a_base_once(spark, tmp_path, monkeypatch):
    """The same as of each table as it is read, over bases, rows that go and come back, and no rows at all; no generation is merged for it."""
    from coppice.operators.generations import Kept, Store
    from coppice.plans.digests import row_text, summed_digest

    monkeypatch.setattr(Store, "COMPACT", 3)
    store = Store(spark, str(tmp_path / "store"), {"t": Kept(("k",), "k long, v string")}, 2)
    change = lambda *rows: spark.createDataFrame(list(rows), "k long, v string, gone boolean")
    store.seed(t=spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string"))
    store.commit("t1", t=change((1, "b", False), (2, None, True), (4, "d", False)))
    store.commit("t2", t=change((1, None, True), (3, None, True), (4, None, True)))
    store.commit("t3", t=change((2, "z", False)))
    store.commit("t4", t=change((2, "y", False), (5, "", False)))
    want = {g: store.at("t", g).agg(summed_digest(row_text("k", "v"))).first()[0] for g in range(store.head() + 1)}
    assert len(want) == 5 and store.at("t", 2).count() == 0
    monkeypatch.setattr(store, "_merged", None)
    assert {r["generation"]: r["read_digest"] for r in store.digests("t").collect()} == want


def test_a_rollback_reads_rows_once_and_links_are_looked_up_together(spark, monkeypatch):
    """Tables read as of a generation: in a commit those of its keys and of what hangs on them, and one look-up a linked table; in a rollback, once for what it puts back."""
    store, read, merged = small(spark), [], Store._merged
    monkeypatch.setattr(Store, "_merged", lambda self, name, *a: read.append(name) or merged(self, name, *a))
    store.commit("t", nodes=nodes(spark, ("b", None), ("e", "new")), edges=edges(spark, ("e", "a", False), ("e", "e", False)))
    assert sorted(read) == ["edges"] * 3 + ["nodes"] * 2
    read.clear()
    store.rollback("t")
    assert sorted(read) == ["edges"] * 3 + ["nodes"] * 2
    assert state(store) == SEED
    with pytest.raises(ValueError, match="edges.from_id"):
        store.commit("u", nodes=nodes(spark, ("a", None)), edges=edges(spark, ("a", "c", False)))
    assert store.head() == 2
