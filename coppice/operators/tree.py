"""Hierarchy: ancestors, descendants, children, integrity, positions (nodes: id, kind, parent_id, child_index, payload)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.plans.digests import digest_of, row_text, row_text_sql, summed_digest, summed_digest_sql, summed_parts
from coppice.plans.staging import stage
from coppice.registration import Registry
from coppice.sources.adapters import EDGES_SQL, NODES_SQL, SEGMENTS_SQL, edges, nodes, order_lines, read, segments, with_sql

REG = Registry()
#: A narrow frontier or a list of roots of so many rows may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows_most: int = BROADCAST_ROWS) -> DataFrame:
    """df hinted for broadcast if a count shows that it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows_most + 1).count() <= rows_most else df


def ancestry(tree: DataFrame, stops: DataFrame | None = None, path: bool = False) -> DataFrame:
    """id, kind, root, depth (and path, root/.../id) for every node below a root or below one of `stops` (a column id), these included.

    Nodes without children come last, by one join to their parents. The others go by pointer
    doubling: each round a node takes over the pointer of the node it points at, so rounds grow
    with the logarithm of the depth and no depth is too much. A round whose nodes point at few
    (near the roots, many at the same few) gets these by broadcast. A node counts under the
    nearest stop at or above it. What hangs on a missing parent or on a cycle is left out: such
    nodes are those left when a round ends none. tree is read twice.
    """
    rows = tree.select("id", "kind", "parent_id")
    if stops is not None:
        rows = rows.join(stops.select("id", F.lit(True).alias("stop")), "id", "left")
        rows = rows.select("id", "kind", F.when(F.col("stop").isNull(), F.col("parent_id")).alias("parent_id"))
    parents = tree.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct().withColumn("inner", F.lit(True))
    text = [F.col("id").alias("path")] if path else []
    ends = F.col("parent_id").isNull()
    state = stage(rows.join(parents, "id", "left").select("id", "kind", F.when(ends, F.col("id")).alias("root"), F.when(ends, 0).otherwise(1).cast("long").alias("depth"), F.col("parent_id").alias("up"), *text, "inner"))
    leaves = state.filter("up is not null and inner is null").drop("inner")
    done, rest = state.filter("up is null").drop("inner"), state.filter("up is not null and inner").drop("inner")

    def lifted(nodes_: DataFrame, over: DataFrame) -> DataFrame:
        above = over.select(F.col("id").alias("up"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("up").alias("a_up"), *([F.col("path").alias("a_path")] if path else []))
        text = [F.concat_ws("/", "a_path", "path").alias("path")] if path else []
        wanted = stage(nodes_.select("up").distinct())
        if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            above = F.broadcast(above.join(F.broadcast(wanted), "up", "left_semi"))
        return nodes_.join(above, "up").select("id", "kind", F.col("a_root").alias("root"), (F.col("depth") + F.col("a_depth")).alias("depth"), F.col("a_up").alias("up"), *text)

    left = rest.count()
    while left:
        state = stage(lifted(rest, done.union(rest)))
        done, rest = done.union(state.filter("up is null")), state.filter("up is not null")
        was, left = left, rest.count()
        if left == was:
            break
    return done.union(lifted(leaves, done)).drop("up")


def descend(tree: DataFrame, tops: DataFrame, levels: int = 16) -> DataFrame:
    """id, kind, root, depth for every descendant of tops (a column id), tops included, each under the nearest top.

    One join a level against the frontier only (a broadcast while that is small); a tree deeper
    than `levels` is finished by pointer doubling. A cycle through a top is an error.
    """
    tree = stage(tree.select("id", "kind", "parent_id"))
    tops = stage(tops.select("id").distinct())
    level = stage(tree.join(small(tops), "id").select("id", "kind", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth")))
    out = level
    for depth in range(1, levels + 1):
        up = level.select(F.col("id").alias("parent_id"), "root")
        level = stage(tree.join(small(up), "parent_id").select("id", "kind", "root", F.lit(depth).cast("long").alias("depth")))
        if level.filter("id = root").limit(1).count():
            raise ValueError("a top is its own descendant")
        level = level.join(small(tops), "id", "left_anti")
        if level.isEmpty():
            return out
        out = out.union(level)
    ends = stage(level.select("id", F.col("root").alias("first"), F.col("depth").alias("so_far")))
    deep = ancestry(tree.join(out.select("id"), "id", "left_anti").union(tree.join(ends.select("id"), "id", "left_semi")), ends)
    deep = deep.filter("depth > 0").join(ends.select(F.col("id").alias("root"), "first", "so_far"), "root")
    deep = stage(deep.select("id", "kind", F.col("first").alias("root"), (F.col("depth") + F.col("so_far")).alias("depth")))
    if not deep.join(tops, "id", "left_semi").isEmpty():
        raise ValueError("a top is its own descendant")
    return out.union(deep)


def roots_of(tree: DataFrame) -> DataFrame:
    return tree.filter("parent_id is null")


WALK_SQL = """walk(id, kind, root, depth, path) AS (
  SELECT id, kind, id, 0, id FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, n.kind, w.root, w.depth + 1, w.path || '/' || n.id FROM nodes n JOIN walk w ON n.parent_id = w.id)"""


def recursive(body: str, walk: str = WALK_SQL, **more: str) -> str:
    extra = "".join(f", {k} AS ({v})" for k, v in more.items())
    return f"WITH RECURSIVE nodes AS ({NODES_SQL}), {walk}{extra} {body}"


@REG.add("hie_tree_rollup", recursive("SELECT root, kind, count(*) AS n, max(depth)::BIGINT AS depth, min(path) AS first_path FROM walk GROUP BY root, kind"))
def hie_tree_rollup(spark, sf_dir):
    walked = ancestry(stage(nodes(spark, sf_dir).select("id", "kind", "parent_id")), path=True)
    return walked.groupBy("root", "kind").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.min("path").alias("first_path"))


@REG.add("hie_root_of_all", recursive("SELECT w.id, w.root, r.payload AS root_payload FROM walk w JOIN nodes r ON w.root = r.id"))
def hie_root_of_all(spark, sf_dir):
    """HIE-1: root and its payload for every node."""
    tree = stage(nodes(spark, sf_dir).select("id", "kind", "parent_id", "payload"))
    tops = small(roots_of(tree).select(F.col("id").alias("root"), F.col("payload").alias("root_payload")))
    return ancestry(tree).join(tops, "root").select("id", "root", "root_payload")


def enclosing(tree: DataFrame, of: DataFrame, kinds: list[str], steps: int = 16) -> DataFrame:
    """HIE-2: the nearest ancestor-or-self of one of the kinds within so many steps, for each id in `of`."""
    at = of.select("id", F.col("id").alias("at"))
    found: DataFrame | None = None
    up = stage(tree.select(F.col("id").alias("at"), "kind", "parent_id", "payload"))
    for step in range(steps + 1):
        here = stage(at.join(up, "at"))
        if here.isEmpty():
            break
        hit = here.filter(F.col("kind").isin(kinds)).select("id", F.col("at").alias("enclosing_id"), F.col("payload").alias("name"), F.lit(step).cast("long").alias("steps"))
        found = hit if found is None else found.union(hit)
        at = here.filter(~F.col("kind").isin(kinds) & F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("at"))
    none = of.select("id", F.lit(None).cast("string").alias("enclosing_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("steps"))
    return none.limit(0) if found is None else found


@REG.add("hie_enclosing", recursive("""SELECT enclosing_id, name, steps::BIGINT AS steps, count(*) AS n FROM up WHERE kind = 'Customer' GROUP BY ALL""",
    walk="""up(id, node, kind, name, parent_id, steps, enclosing_id) AS (
  SELECT id, id, kind, payload, parent_id, 0, id FROM nodes WHERE kind = 'Line'
  UNION ALL SELECT u.id, n.id, n.kind, n.payload, n.parent_id, u.steps + 1, n.id FROM up u JOIN nodes n ON u.parent_id = n.id WHERE u.kind <> 'Customer' AND u.steps < 16)"""))
def hie_enclosing(spark, sf_dir):
    tree = nodes(spark, sf_dir)
    got = enclosing(tree, tree.filter("kind = 'Line'"), ["Customer"])
    return got.groupBy("enclosing_id", "name", "steps").agg(F.count("*").alias("n"))


def lifted_closure(tree: DataFrame, seeds: DataFrame) -> DataFrame:
    """HIE-3: the ids under the top-level ancestors (children of roots) of the seeds, at any depth. tree is read several times."""
    tree = tree.select("id", "kind", "parent_id")
    roots = small(stage(roots_of(tree).select(F.col("id").alias("parent_id"))))
    tops = tree.join(roots, "parent_id", "left_semi").select("id")
    under = stage(ancestry(tree.filter("parent_id is not null"), tops).select("id", F.col("root").alias("top")))
    wanted = stage(under.join(seeds.select("id"), "id", "left_semi").select("top").distinct())
    return under.join(wanted, "top", "left_semi").select("id")


def leaving(inside: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges from inside a closure to what lies outside it."""
    return refs.join(inside.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(inside.select(F.col("id").alias("to_id")), "to_id", "left_anti")


@REG.add("hie_closure_edges", recursive("""SELECT e.to_id, count(*) AS n FROM edges e JOIN inside i ON e.from_id = i.id
LEFT JOIN inside j ON e.to_id = j.id WHERE j.id IS NULL GROUP BY e.to_id""", edges=EDGES_SQL,
    walk=WALK_SQL, seeds="SELECT id FROM nodes WHERE id IN ('O0', 'O7', 'C3')",
    tops="SELECT DISTINCT split_part(path, '/', 2) AS top FROM walk JOIN seeds USING (id)",
    inside="SELECT id FROM walk WHERE split_part(path, '/', 2) IN (SELECT top FROM tops)"))
def hie_closure_edges(spark, sf_dir):
    """HIE-3: edges that leave the closure, counted by target."""
    lines = stage(order_lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_returnflag", "pos"))
    tree = stage(nodes(spark, sf_dir, lines).select("id", "kind", "parent_id"))
    inside = stage(lifted_closure(tree, tree.filter(F.col("id").isin("O0", "O7", "C3"))))
    return leaving(inside, edges(spark, sf_dir, lines)).groupBy("to_id").agg(F.count("*").alias("n"))


@REG.add("hie_deep_closure", """
WITH RECURSIVE tree AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 200 = 1 THEN 0 ELSE c_custkey - 1 END AS parent_id FROM customer),
walk(id, top) AS (
  SELECT id, id FROM tree WHERE parent_id = 0 UNION ALL SELECT t.id, w.top FROM tree t JOIN walk w ON t.parent_id = w.id),
inside AS (SELECT id FROM walk WHERE top IN (SELECT top FROM walk WHERE id % 1000 IN (70, 700))),
refs AS (SELECT c_custkey AS from_id, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS to_id FROM customer)
SELECT to_id::VARCHAR AS to_id, count(*) AS n FROM refs WHERE from_id IN (SELECT id FROM inside) AND to_id NOT IN (SELECT id FROM inside) GROUP BY 1""")
def hie_deep_closure(spark, sf_dir):
    """HIE-3 on chains of 200 customers one below the other."""
    rows, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    parent = F.when(k == 0, F.lit(None)).when(k % 200 == 1, F.lit(0)).otherwise(k - 1)
    tree = rows.select(k.cast("string").alias("id"), F.lit("Customer").alias("kind"), parent.cast("string").alias("parent_id"))
    refs = rows.select(k.cast("string").alias("from_id"), ((k * 7 + 3) % F.lit(rows.count())).cast("string").alias("to_id"))
    inside = stage(lifted_closure(tree, rows.filter((k % 1000).isin(70, 700)).select(k.cast("string").alias("id"))))
    return leaving(inside, refs).groupBy("to_id").agg(F.count("*").alias("n"))


@REG.add("hie_subtree", recursive("SELECT kind, depth::BIGINT AS depth, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM walk WHERE root = 'R1' GROUP BY kind, depth"))
def hie_subtree(spark, sf_dir):
    """HIE-4."""
    tree = nodes(spark, sf_dir)
    return descend(tree, tree.filter("id = 'R1'")).groupBy("kind", "depth").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@REG.add("hie_children_bounded", with_sql("""
SELECT n.parent_id, n.id, n.child_index, c.n > 10 AS over_bound FROM nodes n
JOIN (SELECT parent_id, count(*) AS n FROM nodes GROUP BY parent_id) c USING (parent_id) WHERE n.kind = 'Order' AND (c.n <= 10 OR n.child_index < 10)""", nodes=NODES_SQL))
def hie_children_bounded(spark, sf_dir, bound: int = 10):
    """HIE-5: children in order up to a bound; a parent with more is flagged, not silently cut."""
    tree = nodes(spark, sf_dir).filter("kind = 'Order'")
    n = tree.groupBy("parent_id").agg(F.count("*").alias("n"))
    return tree.join(n, "parent_id").filter((F.col("n") <= bound) | (F.col("child_index") < bound)).select("parent_id", "id", "child_index", (F.col("n") > bound).alias("over_bound"))


def parent_faults(tree: DataFrame) -> DataFrame:
    """HIE-6: id and fault: `dangling` (parent missing), `under_dangling`, or `cycle` (no end upwards)."""
    links = tree.select("id", "parent_id")
    lost = stage(links.filter("parent_id is not null").join(links.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id"))
    ended = stage(ancestry(links.withColumn("kind", F.lit("")), lost).join(lost.select(F.col("id").alias("root"), F.lit(True).alias("lost")), "root", "left").select("id", "depth", "lost"))
    bad = ended.filter("lost").select("id", F.when(F.col("depth") == 0, "dangling").otherwise("under_dangling").alias("fault"))
    return bad.union(links.select("id").join(ended.select("id"), "id", "left_anti").select("id", F.lit("cycle").alias("fault")))


@REG.add("hie_cycles", """
WITH RECURSIVE links AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN -c_custkey
    WHEN c_custkey % 101 = 7 THEN c_custkey WHEN c_custkey = 10 THEN 20 ELSE c_custkey // 2 END AS parent_id FROM customer),
good(id) AS (SELECT id FROM links WHERE parent_id IS NULL UNION ALL SELECT l.id FROM links l JOIN good g ON l.parent_id = g.id),
lost(id, depth) AS (
  SELECT id, 0 FROM links WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM links)
  UNION ALL SELECT l.id, p.depth + 1 FROM links l JOIN lost p ON l.parent_id = p.id)
SELECT id::VARCHAR AS id, CASE WHEN depth = 0 THEN 'dangling' ELSE 'under_dangling' END AS fault FROM lost
UNION ALL SELECT id::VARCHAR, 'cycle' FROM links WHERE id NOT IN (SELECT id FROM good) AND id NOT IN (SELECT id FROM lost)""")
def hie_cycles(spark, sf_dir):
    """A heap-shaped tree over customers with faults put in by rule."""
    k = F.col("c_custkey")
    links = read(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"),
        F.when(k == 0, F.lit(None)).when(k % 97 == 5, -k).when(k % 101 == 7, k).when(k == 10, F.lit(20)).otherwise(F.floor(k / 2)).cast("string").alias("parent_id"),
    )
    return parent_faults(links)


@REG.add("prj_children", with_sql("""
SELECT p.id AS parent_id, p.payload, coalesce(c.child_index, -1) AS place, c.id AS child_id, count(c.id) OVER (PARTITION BY p.id) AS n
FROM nodes p LEFT JOIN nodes c ON c.parent_id = p.id""", nodes=NODES_SQL))
def prj_children(spark, sf_dir):
    """PRJ-3, PRJ-10: nodes with their children, a row a child with its place; a node without children has one row. No parent's children are gathered."""
    tree = stage(nodes(spark, sf_dir))
    kids = tree.filter("parent_id is not null").select(F.col("parent_id").alias("id"), F.col("child_index").alias("place"), F.col("id").alias("child_id"))
    parents = tree.select("id", "payload")
    n = kids.groupBy("id").agg(F.count("*").alias("n"))
    out = parents.join(n, "id", "left").join(kids, "id", "left")
    return out.select(F.col("id").alias("parent_id"), "payload", F.coalesce("place", F.lit(-1).cast("long")).alias("place"), "child_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@REG.add("agg_children_by_kind", with_sql("SELECT parent_id, kind, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id, kind", nodes=NODES_SQL))
def agg_children_by_kind(spark, sf_dir):
    """AGG-9."""
    return nodes(spark, sf_dir).filter("parent_id is not null").groupBy("parent_id", "kind").agg(F.count("*").alias("n"))


@REG.add("agg_declarations_per_module", with_sql("SELECT m.id, count(d.id) AS declarations FROM nodes m LEFT JOIN nodes d ON d.parent_id = m.id AND d.kind = 'Order' WHERE m.kind = 'Customer' GROUP BY m.id", nodes=NODES_SQL))
def agg_declarations_per_module(spark, sf_dir):
    """AGG-10: zeros kept; children are counted before the join."""
    tree = nodes(spark, sf_dir)
    n = tree.filter("kind = 'Order'").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    return tree.filter("kind = 'Customer'").select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("declarations"))


@REG.add("agg_resource_versions", with_sql(f"""
SELECT 'node:' || id AS resource, sha256(concat_ws('|', id, kind, coalesce(parent_id, ''), coalesce(child_index::VARCHAR, ''), payload)) AS version FROM nodes
UNION ALL SELECT 'children:' || parent_id, {summed_digest_sql(row_text_sql("id", "kind", "child_index"))} FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id
UNION ALL SELECT 'edge:' || from_id, sha256(from_id || '|' || to_id || '|' || kind) FROM edges
UNION ALL SELECT 'to:' || to_id, {summed_digest_sql(row_text_sql("from_id", "kind"))} FROM edges GROUP BY to_id""", nodes=NODES_SQL, edges=EDGES_SQL))
def agg_resource_versions(spark, sf_dir):
    """AGG-31: a version hash per node, edge, child membership (shape, not payload) and incoming membership."""
    lines = stage(order_lines(spark, sf_dir).select("l_orderkey", "pos", "l_partkey", "l_returnflag"))
    return resource_versions(stage(nodes(spark, sf_dir, lines)), edges(spark, sf_dir, lines))


def resource_versions(tree: DataFrame, refs: DataFrame) -> DataFrame:
    """resource, version. Memberships are summed up once their rows have met; tree and refs are read more than once."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return (
        tree.select(F.concat(F.lit("node:"), "id").alias("resource"), F.sha2(F.concat_ws("|", "id", "kind", text("parent_id"), text("child_index"), "payload"), 256).alias("version"))
        .union(memberships(tree.filter("parent_id is not null"), "parent_id", "id", "kind", "child_index").select(F.concat(F.lit("children:"), "parent_id"), "digest"))
        .union(refs.select(F.concat(F.lit("edge:"), "from_id"), F.sha2(F.concat_ws("|", "from_id", "to_id", "kind"), 256)))
        .union(memberships(refs, "to_id", "from_id", "kind").select(F.concat(F.lit("to:"), "to_id"), "digest"))
    )


#: So many rows of one key are summed up by one task.
MEMBER_ROWS = 50_000_000


def memberships(rows: DataFrame, key: str, *columns: str, member_rows: int = MEMBER_ROWS) -> DataFrame:
    """key, digest: the summed digest of the rows of each key.

    Rows are shuffled, not sums: where a task has few rows of a key, their sums are several
    times as wide as they, and do not compress. A table of more than member_rows is dealt by
    shares of the tasks that read it as well, and sums of shares are added up, so that a parent
    of very many children, or a much-used target, is a row a share.
    """
    rows = rows.select(key, *columns)
    shares = rows.count() // member_rows + 1
    if shares == 1:
        return rows.repartition(key).groupBy(key).agg(summed_digest(row_text(*columns)).alias("digest"))
    dealt = rows.withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(shares))).repartition(key, "_share")
    parts = dealt.groupBy(key, "_share").agg(*summed_parts(row_text(*columns)))
    sums = [F.sum(c) for c in parts.columns[2:]]
    return parts.groupBy(key).agg(digest_of(*sums).alias("digest"))


#: Declarations on one line of the index.
LINE_ENTRIES = 100


@REG.add("agg_module_index", with_sql(f"""
SELECT m.id, coalesce(d.child_index // {LINE_ENTRIES}, 0) AS page, string_agg(d.payload || CASE WHEN d.child_index % 2 = 0 THEN '*' ELSE '' END, ', ' ORDER BY d.child_index) AS line
FROM nodes m LEFT JOIN nodes d ON d.parent_id = m.id WHERE m.kind <> 'Line' GROUP BY ALL""", nodes=NODES_SQL))
def agg_module_index(spark, sf_dir):
    """AGG-32: what each node above the lines declares, at every level, in order with a flag, a hundred a line, so that a very large module is many lines."""
    tree = stage(nodes(spark, sf_dir))
    modules = tree.filter("kind <> 'Line'").select("id")
    entry = F.concat("payload", F.when(F.col("child_index") % 2 == 0, "*").otherwise(""))
    kids = tree.filter("parent_id is not null").select(F.col("parent_id").alias("id"), F.floor(F.col("child_index") / LINE_ENTRIES).alias("page"), F.struct("child_index", entry.alias("s")).alias("k"))
    line = kids.groupBy("id", "page").agg(F.array_sort(F.collect_list("k")).alias("k")).select("id", "page", F.concat_ws(", ", F.transform("k", lambda x: x["s"])).alias("line"))
    return modules.join(line, "id", "left").select("id", F.coalesce("page", F.lit(0).cast("long")).alias("page"), "line")


@REG.add("win_source_map", with_sql("""
SELECT module, child_index, coalesce(sum(length(payload)) OVER (PARTITION BY module ORDER BY child_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at,
       sum(length(payload)) OVER (PARTITION BY module ORDER BY child_index)::BIGINT AS end_at FROM seg""", seg=SEGMENTS_SQL))
def win_source_map(spark, sf_dir):
    """WIN-1."""
    return source_map(segments(spark, sf_dir))


def source_map(segs: DataFrame) -> DataFrame:
    """module, child_index, start_at, end_at: half-open character span of each segment in the rendered text."""
    w = Window.partitionBy("module").orderBy("child_index").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.char_length("payload")).over(w)
    return segs.select("module", "child_index", (end - F.char_length("payload")).alias("start_at"), end.alias("end_at"))


def derived_id(*parts: str):
    """ING-3: first 16 hex digits of SHA-1 over the zero-byte separated parts."""
    return F.substring(F.sha1(F.concat_ws(chr(0), *[F.col(p).cast("string") for p in parts])), 1, 16)


# --- growing and shrinking modules: ids derive from places, so edges must follow -----------

#: Edges between lines: every line after the first refers to the line before it, and every fifth line to the first line of the next module.
LINE_EDGES_SQL = """SELECT module, child_index, 'value' AS kind, module AS to_module, child_index - 1 AS to_index FROM seg WHERE child_index > 0 AND child_index % 5 <> 0
UNION ALL SELECT s.module, s.child_index, 'type', t.module, 0 FROM seg s JOIN (SELECT DISTINCT module FROM seg) t ON t.module = s.module + 1 WHERE s.child_index % 5 = 0"""


def line_edges(segs: DataFrame) -> DataFrame:
    """from_id, to_id, kind over derived ids of lines."""
    near = segs.filter("child_index > 0 and child_index % 5 <> 0").select("module", "child_index", F.lit("value").alias("kind"), F.col("module").alias("to_module"), (F.col("child_index") - 1).alias("to_index"))
    there = segs.select((F.col("module") - 1).alias("module")).distinct()
    far = segs.filter("child_index % 5 = 0").join(there, "module", "left_semi").select("module", "child_index", F.lit("type"), F.col("module") + 1, F.lit(0).cast("long"))
    return near.union(far).select(derived_id("module", "child_index").alias("from_id"), derived_id("to_module", "to_index").alias("to_id"), "kind")


def rekeyed(refs: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges with both ends given their new ids (moved: old_id, new_id, one row for each row that is still there); edges with an end that is gone go."""
    a, b = moved.select(F.col("old_id").alias("from_id"), F.col("new_id").alias("a")), moved.select(F.col("old_id").alias("to_id"), F.col("new_id").alias("b"))
    return refs.join(a, "from_id").join(b, "to_id").select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "kind")


ID_SQL = "left(sha1(concat_ws(chr(0), ({0})::VARCHAR, ({1})::VARCHAR)), 16)"


def rekeyed_sql(origin: str = "module") -> str:
    """The same over e (LINE_EDGES_SQL) and moved (origin, was, module, now)."""
    return f"""SELECT {ID_SQL.format("a.module", "a.now")} AS from_id, {ID_SQL.format("b.module", "b.now")} AS to_id, e.kind
FROM e JOIN moved a ON a.{origin} = e.module AND a.was = e.child_index JOIN moved b ON b.{origin} = e.to_module AND b.was = e.to_index"""


@REG.add("win_append_child", with_sql(f"""
SELECT s.module, s.child_index + CASE WHEN s.child_index = c.place THEN 1 ELSE 0 END AS child_index, md5(s.payload) AS payload_md5 FROM seg s JOIN closing c USING (module)
UNION ALL SELECT module, place, md5('appended' || chr(10)) FROM closing""", seg=SEGMENTS_SQL, closing="SELECT module, max(child_index) AS place FROM seg GROUP BY module"))
def win_append_child(spark, sf_dir):
    """WIN-2: a new row takes the closing row's place, which moves on by one."""
    grown = append_child(segments(spark, sf_dir), "appended\n")
    return grown.select("module", "child_index", F.md5("payload").alias("payload_md5"))


def append_child(segs: DataFrame, payload: str) -> DataFrame:
    """WIN-2, with derived ids (old and new) so that edges can be re-keyed."""
    last = segs.groupBy("module").agg(F.max("child_index").alias("at"))
    moved = segs.join(last, "module").select("module", "child_index", "payload", (F.col("child_index") + (F.col("child_index") == F.col("at")).cast("long")).alias("to"))
    rows = moved.select("module", F.col("child_index").alias("was"), F.col("to").alias("child_index"), "payload").union(
        last.select("module", F.lit(None).cast("long"), "at", F.lit(payload)))
    return rows.withColumns({"new_id": derived_id("module", "child_index"), "old_id": F.when(F.col("was").isNotNull(), derived_id("module", "was"))})


@REG.add("win_append_edges", with_sql(f"SELECT from_id, to_id, kind FROM ({rekeyed_sql()})", seg=SEGMENTS_SQL, e=LINE_EDGES_SQL,
    moved="SELECT module, child_index AS was, child_index + CASE WHEN child_index = max(child_index) OVER (PARTITION BY module) THEN 1 ELSE 0 END AS now FROM seg"))
def win_append_edges(spark, sf_dir):
    """WIN-2: edges from and to the closing row follow it to its new id."""
    segs = stage(segments(spark, sf_dir))
    return rekeyed(line_edges(segs), append_child(segs, "appended\n").filter("old_id is not null").select("old_id", "new_id"))


@REG.add("win_remove_children", with_sql("""
SELECT module, child_index AS was, row_number() OVER (PARTITION BY module ORDER BY child_index) - 1 AS child_index,
       left(sha1(concat_ws(chr(0), module::VARCHAR, child_index::VARCHAR)), 16) AS old_id,
       left(sha1(concat_ws(chr(0), module::VARCHAR, (row_number() OVER (PARTITION BY module ORDER BY child_index) - 1)::VARCHAR)), 16) AS new_id
FROM seg WHERE child_index % 3 <> 1""", seg=SEGMENTS_SQL))
def win_remove_children(spark, sf_dir):
    """WIN-3: every third line goes; the rest close up and get new ids."""
    return remove_children(segments(spark, sf_dir), F.col("child_index") % 3 == 1).select("module", "was", "child_index", "old_id", "new_id")


def remove_children(segs: DataFrame, gone) -> DataFrame:
    place = (F.row_number().over(Window.partitionBy("module").orderBy("child_index")) - 1).cast("long")
    kept = segs.filter(~gone).select("module", F.col("child_index").alias("was"), place.alias("child_index"), "payload")
    return kept.withColumns({"old_id": derived_id("module", "was"), "new_id": derived_id("module", "child_index")})


@REG.add("win_remove_edges", with_sql(f"SELECT from_id, to_id, kind FROM ({rekeyed_sql()})", seg=SEGMENTS_SQL, e=LINE_EDGES_SQL,
    moved="SELECT module, child_index AS was, row_number() OVER (PARTITION BY module ORDER BY child_index) - 1 AS now FROM seg WHERE child_index % 3 <> 1"))
def win_remove_edges(spark, sf_dir):
    """WIN-3: edges of the removed lines go, the others are keyed by the survivors' new ids."""
    segs = stage(segments(spark, sf_dir))
    return rekeyed(line_edges(segs), remove_children(segs, F.col("child_index") % 3 == 1).select("old_id", "new_id"))


QUERIES, SQL = REG.queries, REG.sql
