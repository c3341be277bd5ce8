"""Edge rules and algebraic laws on small frames."""

import pytest
from pyspark.sql import functions as F

from coppice.functions import columns as C
from coppice.operators import admission, edits, refs, tree, versions
from coppice.plans.joins import as_of, containing_span


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_descend_refuses_a_cycle(spark):
    t = spark.createDataFrame([("a", "k", None), ("b", "k", "a"), ("c", "k", "d"), ("d", "k", "c")], "id string, kind string, parent_id string")
    assert rows(tree.descend(t, tree.roots_of(t)).select("id", "depth")) == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError):
        tree.descend(t, t.filter("id = 'c'").select("id"), 5)
    assert rows(tree.parent_faults(t)) == [("c", "cycle"), ("d", "cycle")]


def test_hierarchy_of_an_empty_table(spark):
    t = spark.createDataFrame([], "id string, kind string, parent_id string")
    assert tree.descend(t, tree.roots_of(t)).count() == 0


def test_as_of_edges(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (1, 12, "c")], "k int, at int, v string")
    back = as_of(left, right, ["k"], "t", "at", ["v"])
    assert {(r.k, r.t): r.v for r in back.collect()} == {(1, 5): "a", (1, 10): "b", (2, 1): None}
    strict = as_of(left, right, ["k"], "t", "at", ["v"], strict=True)
    assert {(r.k, r.t): r.v for r in strict.collect()} == {(1, 5): None, (1, 10): "b", (2, 1): None}
    ahead = as_of(left, right, ["k"], "t", "at", ["v"], forward=True)
    assert {(r.k, r.t): r.v for r in ahead.collect()} == {(1, 5): "a", (1, 10): "c", (2, 1): None}
    beyond = as_of(left, right, ["k"], "t", "at", ["v"], forward=True, strict=True)
    assert {(r.k, r.t): r.v for r in beyond.collect()} == {(1, 5): "b", (1, 10): "c", (2, 1): None}


def test_spans_are_half_open_and_may_cross_bins(spark):
    spans = spark.createDataFrame([(1, 0, 3, "a"), (1, 3, 5000, "b"), (1, 5000, 5000, "empty")], "m int, s int, e int, n string")
    points = spark.createDataFrame([(1, 0), (1, 3), (1, 2), (1, 4999), (1, 5000)], "m int, p int")
    assert rows(containing_span(points, spans, ["m"], "p", "s", "e").select("p", "n")) == [(0, "a"), (2, "a"), (3, "b"), (4999, "b")]


def test_diff_and_apply_are_inverse(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "key int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z"), (4, None)], "key int, v string")
    d = versions.diff(a, b, "key", ["v"])
    assert rows(d.select("key", "op")) == [(1, "delete"), (2, "update"), (4, "insert")]
    delta = d.withColumns({"op": F.when(F.col("op") == "delete", "delete").otherwise("upsert"), "pos": F.lit(0)})
    got = versions.apply_changes(a, delta, "key", ["v"], ["pos"])
    assert {r.key: r.v for r in got.collect()} == {2: "y", 3: "z", 4: None}


def test_last_change_wins(spark):
    base = spark.createDataFrame([(1, "x")], "key int, v string")
    delta = spark.createDataFrame([(1, 0, "delete", 1, None), (1, 1, "upsert", 1, "again"), (2, 0, "upsert", 5, "p"), (2, 1, "delete", 5, None)], "generation int, pos int, op string, key int, v string")
    assert rows(versions.apply_changes(base, delta, "key", ["v"], ["generation", "pos"])) == [(1, "again")]


def test_digest_knows_content_not_order(spark):
    data = [(i, f"t{i % 7}") for i in range(100)]
    one = versions.content_digest(spark.createDataFrame(data, "i int, t string"), ["i", "t"]).first()
    two = versions.content_digest(spark.createDataFrame(data[::-1], "i int, t string").repartition(7), ["i", "t"]).first()
    three = versions.content_digest(spark.createDataFrame(data[1:] + [(0, None)], "i int, t string"), ["i", "t"]).first()
    assert one == two and one != three


def test_splice_refuses_other_text_and_overlap(spark):
    r = spark.createDataFrame([(1, "abcdef"), (2, "abcdef"), (3, "abcdef"), (4, "x")], "id int, payload string")
    e = spark.createDataFrame([(1, 0, 1, "a", "AA"), (1, 4, 6, "ef", ""), (2, 1, 2, "z", "Z"), (3, 0, 3, "abc", "1"), (3, 2, 4, "cd", "2")], "id int, start_at int, end_at int, old string, new string")
    assert rows(edits.splice(r, e, "id")) == [(1, "AAbcd", True), (2, "abcdef", False), (3, "abcdef", False), (4, "x", True)]


def test_shift_is_strict_or_inclusive(spark):
    m = spark.createDataFrame([(1, 5), (1, 6)], "id int, offset int")
    e = spark.createDataFrame([(1, 5, 6, "long")], "id int, start_at int, end_at int, new string")
    assert rows(edits.shift_offsets(m, e, "id", False)) == [(1, 5, 5), (1, 6, 9)]
    assert rows(edits.shift_offsets(m, e, "id", True)) == [(1, 5, 8), (1, 6, 9)]


def test_ready_rule_equals_the_pairwise_one(spark):
    import random

    rnd = random.Random(1)
    keys = [(i, rnd.randrange(12)) for i in range(20) for _ in range(2)]
    k = spark.createDataFrame(keys, "item int, key int").distinct()
    q = spark.createDataFrame([(i, i) for i in range(20)], "item int, seq int")
    active = spark.createDataFrame([(3,)], "key int")
    by = {i: {b for a, b in keys if a == i} for i in range(20)}
    want = sorted(i for i in range(20) if 3 not in by[i] and not any(by[i] & by[j] for j in range(i)))
    assert sorted(r.item for r in admission.ready(q, k, active).collect()) == want


def test_waves_never_share_a_key(spark):
    k = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")], "item int, key string")
    q = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "item int, seq int")
    assert rows(admission.waves(q, k)) == [(1, 1), (2, 2), (3, 3), (4, 1)]


def test_rename_of_the_same_name_is_nothing(spark):
    t = spark.createDataFrame([("d", "x"), ("e", "y")], "id string, payload string")
    r = spark.createDataFrame([("u", "d", "value"), ("v", "e", "value")], "from_id string, to_id string, kind string")
    asked = spark.createDataFrame([("d", "x"), ("e", "z")], "id string, to_name string")
    assert rows(refs.rename(t, r, asked).select("id", "to_name")) == [("e", "z"), ("v", "z")]


def test_paths_and_redaction(spark):
    df = spark.createDataFrame([("/a/./b/../c",), ("../x",), ("a//b",)], "p string")
    assert [r[0] for r in df.select(C.normal_path(F.col("p"))).collect()] == ["/a/c", "../x", "a/b"]
    assert spark.range(1).select(C.redacted(F.lit("mail me@x.org at 10.1.2.3"))).first()[0] == "mail [mail] at [address]"


# --- logs that end in a cut line ----------------------------------------------------------------


@pytest.mark.parametrize("split", [None, 64])
def test_only_an_open_last_line_is_a_cut_tail(spark, tmp_path, split):
    from pyspark.sql import types as T

    from coppice.sources.files import read_tolerant

    schema = T._parse_datatype_string("a long, b string")
    line = lambda i: f'{{"a": {i}, "b": "text é {i}"}}\n'
    logs = {
        "whole": "".join(map(line, range(20))) + "\n  \n", "cut": "".join(map(line, range(20, 30))) + '{"a": 99, "b": "te', "open": line(30) + line(31).rstrip("\n"),
        "blank": line(40) + "   ", "empty": "", "one": '{"a"',
    }
    for name, text in logs.items():
        (tmp_path / f"{name}.jsonl").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = read_tolerant(spark, str(tmp_path), schema).collect()
        assert sorted(r["a"] for r in got if not r["truncated"]) == [*range(31), 40]
        assert [(r["a"], r["b"]) for r in got if r["truncated"]] == [(None, None)] * 3
        (tmp_path / "broken.jsonl").write_text(line(1) + '{"a": 2, "b"\n' + line(3))
        with pytest.raises(Exception, match="(?i)malformed"):
            read_tolerant(spark, str(tmp_path), schema).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_nested_strings_are_redacted(spark, tmp_path):
    from pyspark.sql import types as T

    from coppice.sources.files import write_contract

    schema = T._parse_datatype_string("id long, note string, deep struct<mails:array<string>,by:map<string,string>,n:int>")
    rows = spark.createDataFrame([(1, "from 10.0.0.1", (["a@b.org", None], {"a@b.org": "c@d.org"}, 3)), (2, None, None)], schema)
    write_contract(rows, f"{tmp_path}/out", schema)
    got = {r["id"]: r for r in spark.read.schema(schema).json(f"{tmp_path}/out").collect()}
    assert "b.org" not in str(got[1]["deep"]["mails"]) and got[1]["deep"]["mails"][1] is None
    assert "d.org" not in got[1]["deep"]["by"]["a@b.org"] and got[1]["deep"]["n"] == 3
    assert got[2]["deep"] is None
