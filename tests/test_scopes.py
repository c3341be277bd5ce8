"""Scopes by kind of intent, and deltas against them, on a small tree."""

import pytest

from coppice.operators import scopes
from coppice.operators.scopes import below, containment_gaps, intent_scopes

TREE = [
    ("m", "Module", None, None, None), ("f", "FunctionDeclaration", "m", 0, None), ("fn", "Identifier", "f", 0, "f"), ("g", "FunctionDeclaration", "f", 1, None), ("gn", "Identifier", "g", 0, "g"),
    ("s1", "ExpressionStatement", "g", 1, None), ("u1", "Identifier", "s1", 0, "f"), ("s2", "ExpressionStatement", "m", 1, None), ("u2", "Identifier", "s2", 0, "f"), ("u3", "Identifier", "s2", 1, "h"),
    ("s3", "ImportDeclaration", "m", 2, None), ("u4", "Identifier", "s3", 0, "f"), ("h", "ClassDeclaration", "m", 3, None), ("hn", "Identifier", "h", 0, "h"),
]
REFS = [("u1", "fn", "call"), ("u2", "fn", "value"), ("u3", "hn", "value"), ("u4", "fn", "call")]
INTENTS = "intent long, op string, target string, new_name string, content array<string>"
CHANGES = "intent long, op string, id string, kind string, parent_id string, child_index long, to_id string"


@pytest.fixture(scope="module")
def code(spark):
    return (spark.createDataFrame(TREE, "id string, kind string, parent_id string, child_index long, payload string").cache(), spark.createDataFrame(REFS, "from_id string, to_id string, kind string").cache())


@pytest.fixture(scope="module")
def scope(spark, code):
    rows = [(1, "rename", "f", "k", None), (2, "add_parameter", "f", None, ["h", "m"]), (3, "rename", "s2", "k", None), (4, "rename", "f", "", None), (5, "inline", "f", "k", None), (6, None, None, None, None), (7, "add_parameter", "g", None, [])]
    return intent_scopes(spark.createDataFrame(rows, INTENTS), *code).cache()


def part(scope, intent, name):
    return {r["r"] for r in scope.filter(f"intent = {intent} and part = '{name}'").collect()}


def test_rename_writes_all_uses_and_both_names(scope):
    spaces = {f"{k}:m:{n}" for k in ("namespace", "absence:FunctionDeclaration") for n in ("f", "k")}
    assert part(scope, 1, "write") == {f"node:{x}" for x in ("f", "fn", "s1", "u1", "s2", "u2", "s3", "u4")} | {f"children:{x}" for x in ("f", "s1", "s2", "s3")} | spaces
    # the module is no parent to reserve, but the function above s1 is
    assert part(scope, 1, "reserve") == {f"node:{x}" for x in ("f", "fn", "s1", "g", "u1", "s2", "u2", "s3", "u4")} | {"symbol:f"}
    assert part(scope, 1, "read") == part(scope, 1, "validate") - spaces
    assert {"refs:fn", "edge:u4", "children:m", "children:g"} <= part(scope, 1, "read")


def test_new_parameter_writes_direct_calls_only(scope):
    assert part(scope, 2, "write") == {f"node:{x}" for x in ("f", "fn", "s1", "u1")} | {"children:f", "children:s1"}
    assert {"node:u2", "node:s2", "children:s2", "edge:u2", "edge:u4", "node:s3"} <= part(scope, 2, "read")
    only = part(scope, 2, "validate") - part(scope, 2, "read")
    assert only == {"node:h", "children:h", "node:hn", "namespace:m:h", "absence:ClassDeclaration:m:h"}
    assert not {"node:h", "node:hn"} & part(scope, 2, "reserve")
    # what the body of g refers to lies outside of it
    assert {"edge:u1", "refs:fn", "node:fn"} <= part(scope, 7, "read")
    assert part(scope, 7, "write") == {"node:g", "node:gn", "children:g"}


def test_refusals(scope):
    assert [part(scope, i, "refused") for i in (3, 4, 5, 6)] == [{"not a declaration with a name"}, {"no new name"}, {"unknown operation"}, {"unknown operation"}]
    assert scope.filter("intent in (3, 4, 5, 6) and part <> 'refused'").isEmpty()


def test_no_rows(spark, code):
    tree, refs = code
    none = spark.createDataFrame([], INTENTS)
    assert intent_scopes(none, tree, refs).isEmpty()
    assert intent_scopes(none, tree.limit(0), refs.limit(0)).isEmpty()
    assert containment_gaps(spark.createDataFrame([], CHANGES), intent_scopes(none, tree, refs), tree, refs).isEmpty()


def test_a_top_may_lie_below_another(spark, code):
    got = below(code[0], spark.createDataFrame([("f",), ("g",)], "id string"))
    assert {tuple(r) for r in got.collect()} == {("f", x) for x in ("fn", "g", "gn", "s1", "u1")} | {("g", x) for x in ("gn", "s1", "u1")}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    with pytest.raises(ValueError):
        below(ring, spark.createDataFrame([("a",)], "id string"))


def gaps(spark, code, scope, *changes):
    got = containment_gaps(spark.createDataFrame(changes, CHANGES), scope, *code)
    return {(r["part"], r["r"]) for r in got.collect()}


def test_what_a_scope_gives(spark, code, scope):
    assert gaps(spark, code, scope, (1, "upsert_node", "fn", "Identifier", "f", 0, None), (1, "upsert_node", "u1", "Identifier", "s1", 0, None)) == set()
    # a payload alone needs no parent; another place or kind does, and the module is not reserved
    assert gaps(spark, code, scope, (1, "upsert_node", "f", "FunctionDeclaration", "m", 0, None)) == set()
    assert gaps(spark, code, scope, (1, "upsert_node", "f", "FunctionDeclaration", "m", 5, None)) == {("reserve", "node:m")}
    assert gaps(spark, code, scope, (1, "delete_node", "h", None, None, None, None)) == {("write", "node:h"), ("reserve", "node:h"), ("reserve", "node:m")}
    assert gaps(spark, code, scope, (1, "delete_ref", "u3", None, None, None, None)) == {("reserve", "node:hn")}  # u3 goes with s2, its target does not


def test_identifiers_go_with_a_parent_that_may_be_written(spark, code, scope):
    new = (2, "upsert_node", "x", "Identifier", "f", 2, None)
    assert gaps(spark, code, scope, new) == set()
    assert gaps(spark, code, scope, (2, "upsert_node", "x", "Literal", "f", 2, None)) == {("write", "node:x"), ("reserve", "node:x")}
    assert gaps(spark, code, scope, (2, "upsert_node", "x", "Identifier", "s2", 2, None)) == {("write", "node:x"), ("reserve", "node:x")}  # s2 is read only
    assert gaps(spark, code, scope, (1, "upsert_node", "u3", "Identifier", "s2", 0, None)) == {("write", "node:u3"), ("reserve", "node:u3")}  # moved
    assert gaps(spark, code, scope, new, new) == set()


def test_new_references_to_pinned_targets(spark, code, scope):
    new, ref = (2, "upsert_node", "x", "Identifier", "f", 2, None), (2, "upsert_ref", "x", None, None, None, "hn")
    assert gaps(spark, code, scope, new, ref) == set()
    assert gaps(spark, code, scope, new, (2, "upsert_ref", "x", None, None, None, "gn")) == {("reserve", "node:gn")}  # not pinned
    assert gaps(spark, code, scope, ref) == {("write", "edge:x"), ("reserve", "node:x"), ("reserve", "node:hn")}  # its source is nowhere
    # another change needs the same target
    assert ("reserve", "node:hn") in gaps(spark, code, scope, new, ref, (2, "delete_ref", "u3", None, None, None, None))


def test_a_use_is_one_row_whatever_its_parts(spark):
    """Parts of a resource do not go through a shuffle as rows of their own."""
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "intent long, id string")
    spread = scopes._spread(rows, scopes._uses("read validate reserve", scopes._resource("node", "id")), scopes._uses("write", scopes._resource("node", "id")))
    assert spread.count() == 4
    assert sorted(map(tuple, scopes._by_part([spread]).collect())) == [(1, p, "node:a") for p in ("read", "reserve", "validate", "write")]


def test_the_tree_is_shuffled_once_a_staged_step(spark, sf_dir, monkeypatch):
    """Shuffle files stay until a step ends, so no step that reads the tree, or the references, has more than a few joins (eleven before)."""
    from coppice.operators import scopes

    tree, refs = scopes.code(spark, sf_dir)
    places = {f.split("/data/")[0] for f in [*tree.inputFiles(), *refs.inputFiles()]}
    monkeypatch.setattr(scopes, "code", lambda *_: (tree, refs))
    joins, stage = [], scopes.stage

    def seen(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins.append(plan.count("Join ") if places & {f.split("/data/")[0] for f in df.inputFiles()} else 0)
        return stage(df)

    monkeypatch.setattr(scopes, "stage", seen)
    assert scopes.set_containment_gaps(spark, sf_dir).count() > 0
    assert len(joins) > 10 and max(joins) <= 4
