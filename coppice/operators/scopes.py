"""What a pending change reads, writes, must see unchanged and reserves, by its kind; and what a delta does beyond that.

Trees are id, kind, parent_id, child_index, payload; references from_id, to_id, kind, one a
source. Sources and names are nodes of kind Identifier, declarations of a kind that ends in
Declaration. Resources are texts: node:x, edge:x (of a source), children:x, refs:x (incoming),
symbol:x, namespace:container:name and absence:kind:container:name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.columns import key_class
from coppice.operators.tree import small
from coppice.plans.staging import stage
from coppice.registration import Registry
from coppice.sources.adapters import LINES_SQL, order_lines, read, with_sql

REG = Registry()

#: A use of a resource names its parts by bits, in this order, so that it is one row however many parts it has.
PARTS = ("read", "write", "validate", "reserve", "refused")


def _resource(kind: str, *ids: str | Column) -> Column:
    return F.concat(F.lit(kind), *[x for i in ids for x in (F.lit(":"), F.col(i) if isinstance(i, str) else i)])


def _uses(parts: str, resource: Column) -> Column:
    """An array of one (parts, r), with a bit for each part named."""
    return F.array(F.struct(F.lit(_bits(parts)).alias("parts"), resource.alias("r")))


def _bits(parts: str) -> int:
    return sum(1 << PARTS.index(p) for p in parts.split())


def _if(condition: Column, uses: Column) -> Column:
    return F.when(condition, uses).otherwise(F.array().cast("array<struct<parts:int,r:string>>"))


def _spread(rows: DataFrame, *uses: Column) -> DataFrame:
    """intent, parts, r of each use; those of an id that is null are left out."""
    return rows.select("intent", F.explode(F.concat(*uses)).alias("u")).select("intent", "u.parts", "u.r").filter("r is not null")


def _by_part(uses: list[DataFrame]) -> DataFrame:
    """intent, part, r, each once: uses of a resource meet as one row, and are spread over their parts after that."""
    met = _all(uses).groupBy("intent", "r").agg(F.bit_or("parts").alias("parts"))
    each = F.array(*[F.when(F.col("parts").bitwiseAND(1 << i) != 0, p) for i, p in enumerate(PARTS)])
    return met.select("intent", F.explode(F.array_compact(each)).alias("part"), "r")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def declared(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """id, kind, container, name_id, name of those ids that are declarations with a name: the first Identifier among their children."""
    first = F.min_by(F.struct("id", "payload"), F.struct("child_index", "id")).alias("n")
    names = tree.filter("kind = 'Identifier'").join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").groupBy("parent_id").agg(first)
    found = tree.filter(F.col("kind").endswith("Declaration")).join(ids, "id", "left_semi")
    return found.join(names.withColumnRenamed("parent_id", "id"), "id").select(
        "id", F.col("kind").alias("decl_kind"), F.coalesce("parent_id", F.lit("root")).alias("container"), F.col("n.id").alias("name_id"), F.col("n.payload").alias("name"))


def below(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """root, id of all that lies below each of tops (a column id), whether or not one top lies below another; a top below itself is an error. tree is read once a level."""
    links = tree.select("id", "parent_id").filter("parent_id is not null")
    level = stage(tops.select(F.col("id").alias("root"), "id").distinct())
    found = []
    while not level.isEmpty():
        level = stage(small(level.withColumnRenamed("id", "parent_id")).join(links, "parent_id").select("root", "id"))
        if not level.filter("root = id").isEmpty():
            raise ValueError("a node lies below itself")
        found.append(level)
    return _all(found) if found else level


def intent_scopes(intents: DataFrame, tree: DataFrame, refs: DataFrame, calls: str = "call", imports: str = "ImportDeclaration") -> DataFrame:
    """SET-9: intent, part (read, write, validate, reserve, refused), r.

    intents: intent (unique), op, target, new_name, content (an array of declarations that what
    is put in names; may be null).

    `rename` writes the declaration, its name, and the statement and source of every reference
    to the name; the old and the new name in the container are written too, as spaces of names
    and as absences. `add_parameter` writes the function, its name, and the statements and
    sources of direct calls (references of kind `calls`). It only reads other references to the
    name, their statements, sources and targets, and likewise what the function's own body
    refers to; a reference in an import (a statement of kind `imports`) does without its target.
    Declarations in `content` must stay as they are, by name too, and are neither written nor
    reserved.

    What is read is validated also, along with its parent's membership of children. A node that
    is read is reserved with its parent, unless that is a Module. An intent is refused, with the
    reason for r, if its target is no declaration with a name, its op is unknown, or its new
    name is null or empty. Empty tables give an empty result. A name that
    very many references share is one key of one join, against one row an intent, which AQE splits.
    """
    tree = tree.select("id", "kind", "parent_id", "child_index", "payload")
    asked = stage(intents.select("intent", "op", "target", "new_name", "content"))
    content = asked.select("intent", F.explode("content").alias("id")).distinct()
    decl = stage(declared(tree, asked.select(F.col("target").alias("id")).union(content.select("id")).distinct()))
    both = asked.join(decl.withColumnRenamed("id", "target"), "target", "left")
    why = (
        F.when(~F.coalesce(F.col("op").isin("rename", "add_parameter"), F.lit(False)), "unknown operation")
        .when(F.col("name_id").isNull(), "not a declaration with a name")
        .when((F.col("op") == "rename") & (F.coalesce("new_name", F.lit("")) == ""), "no new name")
    )
    judged = stage(both.withColumn("why", why))
    good = judged.filter("why is null").select("intent", "op", "target", "new_name", "decl_kind", "container", "name_id", "name")
    added = good.filter("op = 'add_parameter'")

    place = tree.select(F.col("id").alias("from_id"), F.col("parent_id").alias("statement"))
    role = F.when(F.col("op") == "rename", "write").when(F.col("statement_kind") == imports, "import").when(F.col("kind") == calls, "write").otherwise("risk")
    to_names = good.select("intent", "op", F.col("name_id").alias("to_id")).join(refs.select("from_id", "to_id", "kind"), "to_id").join(place, "from_id")
    incoming = stage(to_names.join(tree.select(F.col("id").alias("statement"), F.col("kind").alias("statement_kind")), "statement", "left").select("intent", "from_id", "to_id", "statement", role.alias("role")))
    inside = below(tree, added.select(F.col("target").alias("id"))).withColumnsRenamed({"root": "target", "id": "from_id"})
    outgoing = added.select("intent", "target").join(inside, "target").join(refs.select("from_id", "to_id"), "from_id").select("intent", "from_id", "to_id", F.lit("body").alias("role"))
    met = incoming.unionByName(outgoing.withColumn("statement", F.lit(None).cast("string")))

    # nodes that are touched: written or not, children read, children written
    touch = lambda rows, c, w, r, cw: rows.select("intent", F.col(c).alias("id"), F.lit(w).alias("w"), F.lit(r).alias("r"), F.lit(cw).alias("cw"))
    hard = incoming.filter("role = 'write'")
    touched = _all([
        touch(good, "target", True, True, True), touch(good, "name_id", True, False, False),
        touch(hard, "statement", True, True, True), touch(hard, "from_id", True, False, False),
        touch(incoming.filter("role <> 'write'"), "statement", False, True, False),
        touch(met.filter("role <> 'write'"), "from_id", False, False, False),
        touch(met.filter("role in ('risk', 'body')"), "to_id", False, False, False),
    ]).filter("id is not null").groupBy("intent", "id").agg(*[F.bool_or(c).alias(c) for c in ("w", "r", "cw")])
    touched = stage(touched)  # so that the tree, when it is shuffled for these, is not on disk along with what made them
    modules = small(tree.filter("kind = 'Module'").select(F.col("id").alias("parent_id"), F.lit(True).alias("module")))
    touched = stage(touched.join(tree.select("id", "parent_id"), "id", "left").join(modules, "parent_id", "left"))
    loose = F.col("module").isNull()
    nodes = _spread(touched,
        _uses("read validate reserve", _resource("node", "id")), _uses("read validate", _resource("children", "parent_id")), _if(loose, _uses("reserve", _resource("node", "parent_id"))),
        _if(F.col("w"), _uses("write", _resource("node", "id"))), _if(F.col("r"), _uses("read validate", _resource("children", "id"))), _if(F.col("cw"), _uses("write", _resource("children", "id"))))

    links = _spread(met, _uses("read validate", _resource("edge", "from_id")), _uses("read validate", _resource("refs", "to_id")), _uses("reserve", _resource("node", "to_id")), _uses("reserve", _resource("node", "from_id")))
    spaces = lambda parts, name: (_uses(parts, _resource("namespace", "container", name)), _uses(parts, _resource("absence", "decl_kind", "container", name)))
    heads = _spread(good, _uses("reserve", _resource("symbol", "target")), _uses("read validate", _resource("refs", "name_id")), _uses("reserve", _resource("node", "name_id")))
    names = _spread(good.filter("op = 'rename'"), *spaces("write validate", "name"), *spaces("write validate", "new_name"))
    pinned = added.select("intent").join(content, "intent").join(decl, "id")
    kept = _spread(pinned, *[_uses("validate", _resource(k, c)) for k, c in (("node", "id"), ("children", "id"), ("node", "name_id"))], *spaces("validate", "name"))
    refused = judged.filter("why is not null").select("intent", F.lit(_bits("refused")).alias("parts"), F.col("why").alias("r"))
    return _by_part([nodes, links, heads, names, kept, refused])


def containment_gaps(changes: DataFrame, scope: DataFrame, tree: DataFrame, refs: DataFrame) -> DataFrame:
    """SET-4: intent, part (write, reserve), r of what a delta's changes need and its scope does not give; no rows if it is contained.

    changes: intent, op, id, kind, parent_id, child_index, to_id. `upsert_node` and
    `delete_node` write node:id; `upsert_ref` and `delete_ref` (id is the source) write edge:id.
    All need node:id reserved. A node that is deleted, new, or changed in more than its payload
    needs its parents reserved, old and new; a reference its targets, old and new.

    Two allowances. Identifiers whose parent (a Statement or Declaration that is there) may be
    written go with it: they, and their edges, need no grant of their own, unless an upsert
    moves one. A new reference from such a node needs no reservation of a target that the
    scope reads or validates as node:, unless another change of the delta needs that target.
    A delta upserts a node once; repeated changes count as one.
    """
    c = stage(changes.select("intent", "op", "id", "kind", "parent_id", "child_index", "to_id").distinct())  # each step that shuffles the tree, or the references, is staged by itself, as the shuffle files of a step stay until its end
    old = tree.select("id", F.col("kind").alias("old_kind"), F.col("parent_id").alias("old_parent"), F.col("child_index").alias("old_index"), F.lit(True).alias("there"))
    c = stage(c.join(old, "id", "left"))
    c = stage(c.join(refs.select(F.col("from_id").alias("id"), F.col("to_id").alias("old_to")), "id", "left"))
    made = c.filter("op = 'upsert_node'").groupBy("intent", "id").agg(F.max(F.when(F.col("kind") == "Identifier", F.struct("parent_id"))).alias("made"))
    c = stage(c.join(made, ["intent", "id"], "left"))

    node_op, ref_op, upsert = F.col("op").isin("upsert_node", "delete_node"), F.col("op").isin("upsert_ref", "delete_ref"), F.col("op") == "upsert_node"
    same = F.col("old_parent").eqNullSafe(F.col("parent_id")) & F.col("old_index").eqNullSafe(F.col("child_index"))
    in_place = F.col("there").isNotNull() & same & F.col("old_kind").eqNullSafe(F.col("kind"))
    was = F.when(F.col("old_kind") == "Identifier", F.col("old_parent"))
    home = (
        F.when(F.col("there").isNotNull(), F.when(upsert, F.when(same & (F.col("kind") == "Identifier"), was)).otherwise(was))
        .when(upsert | (F.col("op") == "upsert_ref"), F.col("made.parent_id"))
    )
    writable = scope.filter("part = 'write'").select("intent", F.col("r").alias("home_key")).distinct()
    holds = tree.filter(F.col("kind").rlike("(Statement|Declaration)$")).select(F.col("id").alias("home"))
    carried = c.select("intent", "id", home.alias("home")).filter("home is not null").join(holds, "home", "left_semi")
    carried = stage(carried.withColumn("home_key", _resource("node", "home")).join(writable, ["intent", "home_key"], "left_semi").select("intent", "id").distinct())

    c = c.join(carried.withColumn("carried", F.lit(True)), ["intent", "id"], "left")
    fresh = (F.col("op") == "upsert_ref") & F.col("old_to").isNull() & F.col("carried").isNotNull()
    need = lambda part, kind, i, firm: F.struct(F.lit(part).alias("part"), _resource(kind, i).alias("r"), firm.alias("firm"), fresh.alias("fresh"))
    yes, no = F.lit(True), F.lit(False)
    wants = F.array(
        F.when(node_op, need("write", "node", "id", no)), F.when(ref_op, need("write", "edge", "id", no)), need("reserve", "node", "id", F.col("op") == "delete_ref"),
        F.when(upsert & ~in_place | (F.col("op") == "delete_node"), need("reserve", "node", "old_parent", yes)), F.when(upsert & ~in_place, need("reserve", "node", "parent_id", yes)),
        F.when(F.col("op") == "upsert_ref", need("reserve", "node", "to_id", ~fresh)), F.when(ref_op, need("reserve", "node", "old_to", yes)))
    to_new = F.col("fresh") & (F.col("r") == F.col("to_key"))
    needed = (
        c.select("intent", _resource("node", "to_id").alias("to_key"), F.explode(F.array_compact(wants)).alias("n")).select("intent", "to_key", "n.*").filter("r is not null")
        .groupBy("intent", "part", "r").agg(F.bool_or("firm").alias("firm"), F.bool_or(F.coalesce(to_new, no)).alias("fresh"))
    )
    own = carried.select("intent", F.explode(F.array(_resource("node", "id"), _resource("edge", "id"))).alias("r"))
    pins = scope.filter("part in ('read', 'validate') and r like 'node:%'").select("intent", "r", F.lit(True).alias("pin")).distinct()
    left = needed.join(scope.filter("part in ('write', 'reserve')").select("intent", "part", "r").distinct(), ["intent", "part", "r"], "left_anti").join(own, ["intent", "r"], "left_anti")
    left = left.join(pins, ["intent", "r"], "left")
    return left.filter(~((F.col("part") == "reserve") & F.col("fresh") & ~F.col("firm") & F.col("pin").isNotNull())).select("intent", "part", "r")


#: Parts are functions with a name, brands their modules; the orders of the customer of a part's number are the statements of its body, and their lines refer to the names of parts.
#: Orders of low priority are imports, lines accepted (A) direct calls.
CODE_SQL = f"""
SELECT DISTINCT 'M' || p_brand AS id, 'Module' AS kind, NULL::VARCHAR AS parent_id, NULL::BIGINT AS child_index, p_brand AS payload FROM part
UNION ALL SELECT 'P' || p_partkey, 'FunctionDeclaration', 'M' || p_brand, p_partkey, NULL FROM part
UNION ALL SELECT 'I' || p_partkey, 'Identifier', 'P' || p_partkey, 0, p_name FROM part
UNION ALL SELECT 'O' || o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'ImportDeclaration' ELSE 'ExpressionStatement' END, 'P' || o_custkey, o_orderkey, NULL FROM orders
UNION ALL SELECT 'L' || l_orderkey || '-' || pos, 'Identifier', 'O' || l_orderkey, pos, l_returnflag FROM ({LINES_SQL})"""
CODE_REFS_SQL = f"SELECT 'L' || l_orderkey || '-' || pos AS from_id, 'I' || l_partkey AS to_id, CASE l_returnflag WHEN 'A' THEN 'call' ELSE 'value' END AS kind FROM ({LINES_SQL})"
#: Every tenth part is renamed, or gets a parameter whose default names the part before it; one that is not there is refused.
INTENTS_SQL = """
SELECT p_partkey AS intent, CASE p_partkey % 20 WHEN 0 THEN 'rename' ELSE 'add_parameter' END AS op, 'P' || p_partkey AS target, p_name || ' 2' AS new_name, 'P' || (p_partkey - 1) AS content FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT -1, 'rename', 'nowhere', 'x', NULL"""


def code(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part, orders, lines = read(spark, sf_dir, "part"), read(spark, sf_dir, "orders"), stage(order_lines(spark, sf_dir).select("l_orderkey", "pos", "l_partkey", "l_returnflag"))
    cat = lambda letter, *cs: F.concat(F.lit(letter), *[F.col(c).cast("string") for c in cs])
    none, kind = F.lit(None).cast("string"), F.when(F.col("o_orderpriority") == "5-LOW", "ImportDeclaration").otherwise("ExpressionStatement")
    line = F.concat(cat("L", "l_orderkey"), F.lit("-"), F.col("pos").cast("string"))
    tree = (
        part.select(cat("M", "p_brand").alias("id"), F.lit("Module").alias("kind"), none.alias("parent_id"), F.lit(None).cast("long").alias("child_index"), F.col("p_brand").alias("payload")).distinct()
        .union(part.select(cat("P", "p_partkey"), F.lit("FunctionDeclaration"), cat("M", "p_brand"), "p_partkey", none))
        .union(part.select(cat("I", "p_partkey"), F.lit("Identifier"), cat("P", "p_partkey"), F.lit(0).cast("long"), "p_name"))
        .union(orders.select(cat("O", "o_orderkey"), kind, cat("P", "o_custkey"), "o_orderkey", none))
        .union(lines.select(line, F.lit("Identifier"), cat("O", "l_orderkey"), "pos", "l_returnflag"))
    )
    refs = lines.select(line.alias("from_id"), cat("I", "l_partkey").alias("to_id"), F.when(F.col("l_returnflag") == "A", "call").otherwise("value").alias("kind"))
    return stage(tree), refs


def code_intents(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    cat = lambda x: F.concat(F.lit("P"), x.cast("string"))
    some = read(spark, sf_dir, "part").filter(k % 10 == 0).select(
        k.alias("intent"), F.when(k % 20 == 0, "rename").otherwise("add_parameter").alias("op"), cat(k).alias("target"), F.concat("p_name", F.lit(" 2")).alias("new_name"), F.array(cat(k - 1)).alias("content"))
    return some.union(spark.createDataFrame([(-1, "rename", "nowhere", "x", None)], "intent long, op string, target string, new_name string, content array<string>"))


SCOPE_CTES = {
    "t": CODE_SQL, "e": CODE_REFS_SQL, "i": INTENTS_SQL,
    "good": "SELECT i.*, n.id AS name_id, n.payload AS name, d.parent_id AS container FROM i JOIN t d ON d.id = i.target JOIN t n ON n.parent_id = d.id AND n.kind = 'Identifier'",
    "inc": """SELECT g.intent, e.from_id, e.to_id, s.id AS statement, CASE WHEN op = 'rename' THEN 'w' WHEN s.kind = 'ImportDeclaration' THEN 'i' WHEN e.kind = 'call' THEN 'w' ELSE 'r' END AS role
        FROM good g JOIN e ON e.to_id = g.name_id JOIN t f ON f.id = e.from_id JOIN t s ON s.id = f.parent_id""",
    "inner_refs": "SELECT g.intent, e.from_id, e.to_id FROM good g JOIN t s ON s.parent_id = g.target JOIN t f ON f.parent_id = s.id JOIN e ON e.from_id = f.id WHERE op = 'add_parameter'",
    "reads": """SELECT intent, target AS id FROM good UNION SELECT intent, name_id FROM good UNION SELECT intent, statement FROM inc UNION SELECT intent, from_id FROM inc
        UNION SELECT intent, to_id FROM inc WHERE role = 'r' UNION SELECT intent, from_id FROM inner_refs UNION SELECT intent, to_id FROM inner_refs""",
    "writes": "SELECT intent, target AS id FROM good UNION SELECT intent, name_id FROM good UNION SELECT intent, statement FROM inc WHERE role = 'w' UNION SELECT intent, from_id FROM inc WHERE role = 'w'",
    "links": "SELECT intent, from_id, to_id FROM inc UNION SELECT intent, from_id, to_id FROM inner_refs",
    "spaces": """SELECT intent, op, 'namespace:' || container || ':' || n AS r FROM (SELECT *, unnest([name, new_name]) AS n FROM good WHERE op = 'rename')
        UNION ALL SELECT intent, op, 'absence:FunctionDeclaration:' || container || ':' || n FROM (SELECT *, unnest([name, new_name]) AS n FROM good WHERE op = 'rename')""",
    "seen": """SELECT intent, 'node:' || id AS r FROM reads UNION ALL SELECT intent, 'children:' || t.parent_id FROM reads JOIN t USING (id) UNION ALL SELECT intent, 'children:' || target FROM good UNION ALL SELECT intent, 'children:' || statement FROM inc
        UNION ALL SELECT intent, 'edge:' || from_id FROM links UNION ALL SELECT intent, 'refs:' || to_id FROM links UNION ALL SELECT intent, 'refs:' || name_id FROM good""",
    "pins": """SELECT g.intent, unnest(['node:' || d.id, 'children:' || d.id, 'node:' || n.id, 'namespace:' || d.parent_id || ':' || n.payload, 'absence:' || d.kind || ':' || d.parent_id || ':' || n.payload]) AS r
        FROM good g JOIN t d ON d.id = g.content JOIN t n ON n.parent_id = d.id AND n.kind = 'Identifier' WHERE op = 'add_parameter'""",
    "s": """SELECT intent, 'read' AS part, r FROM seen WHERE r IS NOT NULL UNION SELECT intent, 'validate', r FROM seen WHERE r IS NOT NULL UNION SELECT intent, 'validate', r FROM pins
        UNION SELECT intent, 'write', 'node:' || id FROM writes UNION SELECT intent, 'write', 'children:' || target FROM good UNION SELECT intent, 'write', 'children:' || statement FROM inc WHERE role = 'w'
        UNION SELECT intent, 'write', r FROM spaces UNION SELECT intent, 'validate', r FROM spaces UNION SELECT intent, 'reserve', 'symbol:' || target FROM good UNION SELECT intent, 'reserve', 'node:' || id FROM reads
        UNION SELECT intent, 'reserve', 'node:' || p.id FROM reads JOIN t USING (id) JOIN t p ON p.id = t.parent_id WHERE p.kind <> 'Module' UNION SELECT intent, 'reserve', 'node:' || from_id FROM links
        UNION SELECT intent, 'reserve', 'node:' || to_id FROM links UNION SELECT intent, 'refused', 'not a declaration with a name' FROM i WHERE intent NOT IN (SELECT intent FROM good)""",
}


@REG.add("set_intent_scopes", with_sql("SELECT intent, part, split_part(r, ':', 1) AS class, count(*) AS n, min(r) AS first_key, max(r) AS last_key FROM s GROUP BY ALL", **SCOPE_CTES))
def set_intent_scopes(spark, sf_dir):
    """SET-9: renames and new parameters, and a rename of what is not there."""
    tree, refs = code(spark, sf_dir)
    scope = intent_scopes(code_intents(spark, sf_dir), tree, refs)
    return scope.groupBy("intent", "part", key_class(F.col("r")).alias("class")).agg(F.count("*").alias("n"), F.min("r").alias("first_key"), F.max("r").alias("last_key"))


#: A rename's delta writes the name and the sources of all its references; it deletes the first statement of the body if its number divides by three.
#: A new parameter's delta makes an identifier under the function, and a reference from it to the name of the part before; those that divide by three also move the function to the first place, and those that divide by seven point that part's references at the function's name.
DELTA_SQL = """
SELECT intent, 'upsert_node' AS op, n.id, n.kind, n.parent_id, n.child_index, NULL::VARCHAR AS to_id FROM good g JOIN t n ON n.id = g.name_id WHERE op = 'rename'
UNION ALL SELECT intent, 'upsert_node', n.id, n.kind, n.parent_id, n.child_index, NULL FROM inc JOIN t n ON n.id = inc.from_id WHERE intent % 20 = 0
UNION ALL SELECT intent, 'delete_node', 'O' || min(o_orderkey), NULL, NULL, NULL, NULL FROM good JOIN orders ON o_custkey = intent WHERE op = 'rename' AND intent % 3 = 0 GROUP BY intent
UNION ALL SELECT intent, 'upsert_node', 'X' || intent, 'Identifier', target, 1, NULL FROM good WHERE op <> 'rename'
UNION ALL SELECT intent, 'upsert_ref', 'X' || intent, NULL, NULL, NULL, 'I' || (intent - 1) FROM good WHERE op <> 'rename'
UNION ALL SELECT intent, 'upsert_node', target, 'FunctionDeclaration', container, 0, NULL FROM good WHERE op <> 'rename' AND intent % 3 = 0
UNION ALL SELECT intent, 'upsert_ref', from_id, NULL, NULL, NULL, name_id FROM good JOIN e ON e.to_id = 'I' || (intent - 1) WHERE op <> 'rename' AND intent % 7 = 0"""
GAPS_CTES = SCOPE_CTES | {
    "c": f"SELECT c.*, o.id IS NOT NULL AS there, o.kind AS ok, o.parent_id AS op_, o.child_index AS oi, e.to_id AS oto FROM ({DELTA_SQL}) c LEFT JOIN t o ON o.id = c.id LEFT JOIN e ON e.from_id = c.id",
    "homes": """SELECT intent, id, op_ AS home FROM c WHERE there AND ok = 'Identifier' AND (op <> 'upsert_node' OR (kind = ok AND op_ IS NOT DISTINCT FROM parent_id AND oi IS NOT DISTINCT FROM child_index))
        UNION SELECT c.intent, c.id, m.parent_id FROM c JOIN c m ON m.intent = c.intent AND m.id = c.id AND m.op = 'upsert_node' AND m.kind = 'Identifier' WHERE NOT c.there AND c.op IN ('upsert_node', 'upsert_ref')""",
    "mat": "SELECT DISTINCT h.intent, h.id FROM homes h JOIN t p ON p.id = h.home AND (p.kind LIKE '%Statement' OR p.kind LIKE '%Declaration') JOIN s ON s.intent = h.intent AND s.part = 'write' AND s.r = 'node:' || h.home",
    "shape": "SELECT * FROM c WHERE op = 'delete_node' OR (op = 'upsert_node' AND NOT (there AND ok = kind AND op_ IS NOT DISTINCT FROM parent_id AND oi IS NOT DISTINCT FROM child_index))",
    "new_refs": "SELECT c.* FROM c JOIN mat USING (intent, id) WHERE op = 'upsert_ref' AND oto IS NULL",
    "firm": """SELECT intent, 'node:' || op_ AS r FROM shape UNION SELECT intent, 'node:' || parent_id FROM shape UNION SELECT intent, 'node:' || oto FROM c WHERE op LIKE '%_ref'
        UNION SELECT intent, 'node:' || to_id FROM c WHERE op = 'upsert_ref' AND (intent, id) NOT IN (SELECT (intent, id) FROM new_refs)""",
    "need": """SELECT intent, 'write' AS part, CASE WHEN op LIKE '%_ref' THEN 'edge:' ELSE 'node:' END || id AS r FROM c UNION SELECT intent, 'reserve', 'node:' || id FROM c UNION SELECT intent, 'reserve', r FROM firm
        UNION SELECT intent, 'reserve', 'node:' || to_id FROM new_refs""",
    "free": """SELECT intent, 'node:' || to_id AS r FROM new_refs WHERE (intent, 'node:' || to_id) NOT IN (SELECT (intent, r) FROM firm WHERE r IS NOT NULL)
        AND (intent, 'node:' || to_id) IN (SELECT (intent, r) FROM s WHERE part IN ('read', 'validate'))""",
}


@REG.add("set_containment_gaps", with_sql("""
SELECT intent, part, r FROM need WHERE r IS NOT NULL AND (intent, part, r) NOT IN (SELECT (intent, part, r) FROM s) AND (intent, r) NOT IN (SELECT (intent, 'node:' || id) FROM mat UNION ALL SELECT (intent, 'edge:' || id) FROM mat)
AND NOT (part = 'reserve' AND (intent, r) IN (SELECT (intent, r) FROM free))""", **GAPS_CTES))
def set_containment_gaps(spark, sf_dir):
    """SET-4: deltas of renames and new parameters, some of which go beyond the scopes of their intents."""
    tree, refs = code(spark, sf_dir)
    intents = code_intents(spark, sf_dir)
    scope = stage(intent_scopes(intents, tree, refs))
    k, none, nul = F.col("intent"), F.lit(None).cast("string"), F.lit(None).cast("long")
    cat = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    row = lambda df, op, i, kind=none, parent=none, place=nul, to=none: df.select("intent", F.lit(op).alias("op"), i.alias("id"), kind.alias("kind"), parent.alias("parent_id"), place.alias("child_index"), to.alias("to_id"))
    renamed, added = intents.filter("op = 'rename' and intent >= 0").withColumn("name_id", cat("I", k)), intents.filter("op = 'add_parameter'").withColumn("name_id", cat("I", k))
    whole = tree.select("id", "kind", "parent_id", "child_index")
    uses = stage(renamed.select("intent", F.col("name_id").alias("to_id")).join(refs, "to_id").select("intent", F.col("from_id").alias("id")))
    first = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("intent")).agg(F.min("o_orderkey").alias("o"))
    brand = whole.select(F.col("id").alias("target"), "parent_id")
    other = stage(added.filter(k % 7 == 0).select("intent", "name_id", cat("I", k - 1).alias("to_id")).join(refs.select("from_id", "to_id"), "to_id"))
    changes = _all([
        row(renamed.select("intent", F.col("name_id").alias("id")).union(uses).join(whole, "id"), "upsert_node", F.col("id"), F.col("kind"), F.col("parent_id"), F.col("child_index")),
        row(renamed.filter(k % 3 == 0).join(first, "intent"), "delete_node", cat("O", F.col("o"))),
        row(added, "upsert_node", cat("X", k), F.lit("Identifier"), F.col("target"), F.lit(1).cast("long")),
        row(added, "upsert_ref", cat("X", k), to=cat("I", k - 1)),
        row(added.filter(k % 3 == 0).join(brand, "target"), "upsert_node", F.col("target"), F.lit("FunctionDeclaration"), F.col("parent_id"), F.lit(0).cast("long")),
        row(other, "upsert_ref", F.col("from_id"), to=F.col("name_id")),
    ])
    return containment_gaps(changes, scope, tree, refs)


QUERIES, SQL = REG.queries, REG.sql
