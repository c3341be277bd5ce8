"""Digests of states against states made one by one, refused recoveries, and stores with one fault each."""

import random

import pytest
from pyspark.sql import functions as F

from coppice.operators.recovery import MARKERS, recover_states, recovery_faults, state_digests
from coppice.operators.versions import apply_changes, content_digest

DELTA = "generation long, pos long, op string, key long, value string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def made(spark, seed, n=120):
    """Half of the changes have key 1, some values are null, some changes repeat what is there, some delete what is not."""
    rnd = random.Random(seed)
    changes = [(4 + i * 6 // n + (i * 6 // n > 2), i, rnd.choice(["upsert", "upsert", "delete"]), rnd.choice([1, 1, 1, 2, 3, 4, 9]), rnd.choice(["x", "y", None, ""])) for i in range(n)]
    return spark.createDataFrame([(1, "x"), (2, None), (7, "z")], "key long, value string"), spark.createDataFrame(changes, DELTA).repartition(3).cache()


@pytest.mark.parametrize("block_rows", [5, 1_000_000])
def test_states_as_made_one_by_one(spark, block_rows):
    base, delta = made(spark, 1)
    got = {g: (n, d) for g, n, d in rows(state_digests(base, 3, delta, "key", ["value"], ["pos"], block_rows))}
    assert sorted(got) == [3, 4, 5, 6, 8, 9, 10]  # 7 has no changes
    for g in got:
        state = apply_changes(base, delta.filter(F.col("generation") <= g), "key", ["value"], ["generation", "pos"])
        assert tuple(content_digest(state, ["key", "value"]).first()) == got[g]


def test_states_of_nothing(spark):
    base, delta = made(spark, 2)
    empty = content_digest(base.limit(0), ["key", "value"]).first()["digest"]
    assert rows(state_digests(base.limit(0), 3, delta.limit(0), "key", ["value"], ["pos"])) == [(3, 0, empty)]
    gone = spark.createDataFrame([(4, i, "delete", k, None) for i, k in enumerate((1, 2, 7, 8))], DELTA)
    assert rows(state_digests(base, 3, gone, "key", ["value"], ["pos"]))[1] == (4, 0, empty)


def test_a_recovery_names_the_first_state_that_differs(spark):
    base, delta = made(spark, 3)
    recorded = state_digests(base, 3, delta, "key", ["value"], ["pos"]).cache()
    go = lambda d, r, to=10: recover_states(base, 3, d, r, to, "key", ["value"], ["pos"])
    for to in (3, 6, 7, 10):
        assert rows(go(delta, recorded, to)) == rows(apply_changes(base, delta.filter(F.col("generation") <= to), "key", ["value"], ["generation", "pos"]))
    changed = delta.withColumn("value", F.when((F.col("generation") == 6) & (F.col("op") != "delete"), F.lit("other")).otherwise(F.col("value")))
    with pytest.raises(ValueError, match="generation 6"):
        go(changed, recorded)
    assert rows(go(changed, recorded, 5)) == rows(go(delta, recorded, 5))
    with pytest.raises(ValueError, match="generation 8"):
        go(delta.filter("generation <> 8"), recorded)
    with pytest.raises(ValueError, match="generation 9"):
        go(delta, recorded.filter("generation <> 9"))
    with pytest.raises(ValueError, match="generation 3"):
        recover_states(base.filter("key <> 7"), 3, delta, recorded, 10, "key", ["value"], ["pos"])
    with pytest.raises(ValueError, match="later than"):
        go(delta, recorded, 2)


STORE = {
    "markers": ([(m, v) for m, v in zip(MARKERS, (6, 3, 8, 8, 2), strict=True)], "name string, value long"),
    "tickets": ([(2,), (5,)], "queue_sequence long"),
    "events": ([("a", 1), ("b", 3)], "event_id string, sequence long"),
    "index": ([("a", 1), ("b", 3)], "event_id string, sequence long"),
    "dependencies": ([("r", 1), ("s", 0), ("r", 2)], "resource string, clock long"),
    "clocks": ([("r",)], "resource string"),
    "attempts": ([("p", 2, 10, "d2")], "attempt string, generation long, change_set long, digest string"),
    "change_sets": ([(10, "committed", 2), (11, "queued", None)], "change_set long, state string, generation long"),
    "operations": ([(2, 10)], "generation long, change_set long"),
    "digests": ([(1, "d1"), (2, "d2")], "generation long, digest string"),
}
FAULTS = [
    ({}, []),
    ({"markers": STORE["markers"][0][:3] + STORE["markers"][0][4:]}, [("lifecycle_marker", "0"), ("marker_missing", "latest_lifecycle_revision")]),
    ({"tickets": []}, [("queue_marker", "1")]),
    ({"tickets": [(6,)]}, [("queue_marker", "7")]),
    ({"events": [("a", 1), ("b", 3), ("b", 4)]}, [("event_marker", "4"), ("event_twice", "b")]),
    ({"index": [("a", 2), ("c", 3)]}, [("index_differs", "a"), ("index_differs", "c"), ("index_missing", "b")]),
    ({"clocks": []}, [("clock_missing", "r"), ("clocks_empty", "2")]),
    ({"markers": STORE["markers"][0][:4] + [(MARKERS[4], 4)]}, [("clock_marker", "4")]),
    # an attempt of no generation is bound to nothing; its digest is as unknown as that of the generation
    ({"attempts": [("p", 0, 10, None)]}, [("attempt_generation", "p"), ("attempt_operation", "p"), ("attempt_unbound", "p")]),
    ({"change_sets": [(10, "queued", 2)]}, [("attempt_unbound", "p")]),
    ({"operations": []}, [("attempt_operation", "p")]),
    ({"operations": [(2, 11)]}, [("attempt_operation", "p")]),
    ({"digests": [(2, "d1")]}, [("attempt_digest", "p")]),
]

@pytest.mark.parametrize("change, want", FAULTS)
def test_faults_of_a_store(spark, change, want):
    tables = {k: spark.createDataFrame(change.get(k, data), schema) for k, (data, schema) in STORE.items()}
    assert rows(recovery_faults(3, **tables)) == want


def test_an_empty_store_lacks_its_markers(spark):
    tables = {k: spark.createDataFrame([], schema) for k, (_, schema) in STORE.items()}
    assert rows(recovery_faults(0, **tables)) == sorted([("marker_missing", m) for m in MARKERS] + [("queue_marker", "1")])
