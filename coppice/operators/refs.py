"""Reference edges: lookups, resolution, classification, integrity, renames (edges: from_id, to_id, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.functions.columns import capped
from coppice.operators.edits import tokens
from coppice.plans.digests import row_text, row_text_sql, summed_digest, summed_digest_sql
from coppice.plans.joins import dealt
from coppice.plans.staging import stage
from coppice.registration import Registry
from coppice.sources.adapters import EDGES_SQL, NODES_SQL, SEGMENTS_SQL, edges, nodes, order_lines, read, segments, with_sql

REG = Registry()


def incoming(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """JOI-1: edges into each target; a much-used target is a hot key of the join, which AQE splits."""
    return refs.join(targets.select(F.col("id").alias("to_id"), F.col("payload").alias("to_payload")), "to_id")


@REG.add("joi_incoming", with_sql("SELECT e.to_id, n.payload AS to_payload, count(*) AS uses, min(e.from_id) AS first_use FROM edges e JOIN nodes n ON e.to_id = n.id GROUP BY ALL", nodes=NODES_SQL, edges=EDGES_SQL))
def joi_incoming(spark, sf_dir):
    return incoming(edges(spark, sf_dir), nodes(spark, sf_dir)).groupBy("to_id", "to_payload").agg(F.count("*").alias("uses"), F.min("from_id").alias("first_use"))


@REG.add("joi_outgoing", with_sql("SELECT n.id, e.to_id, e.kind AS edge_kind FROM nodes n LEFT JOIN edges e ON e.from_id = n.id WHERE n.kind IN ('Order', 'Customer')", nodes=NODES_SQL, edges=EDGES_SQL))
def joi_outgoing(spark, sf_dir):
    """JOI-2: at most one edge a source; nodes without one are kept."""
    n = nodes(spark, sf_dir).filter("kind in ('Order', 'Customer')").select("id")
    return n.join(edges(spark, sf_dir).select(F.col("from_id").alias("id"), "to_id", F.col("kind").alias("edge_kind")), "id", "left")


@REG.add("joi_two_hop", with_sql("""
SELECT d.id AS declaration, c.id AS name_row, count(e.from_id) AS uses FROM nodes d JOIN nodes c ON c.parent_id = d.id AND c.kind = 'Customer'
JOIN edges e ON e.to_id = c.id WHERE d.kind = 'Nation' GROUP BY ALL""", nodes=NODES_SQL, edges=EDGES_SQL))
def joi_two_hop(spark, sf_dir):
    """JOI-3: declaration -> name rows -> uses; uses are counted before they meet the names."""
    tree = nodes(spark, sf_dir)
    uses = edges(spark, sf_dir).groupBy(F.col("to_id").alias("name_row")).agg(F.count("*").alias("uses"))
    names = tree.filter("kind = 'Customer'").select(F.col("parent_id").alias("declaration"), F.col("id").alias("name_row"))
    return names.join(tree.filter("kind = 'Nation'").select(F.col("id").alias("declaration")), "declaration").join(uses, "name_row").select("declaration", "name_row", "uses")


@REG.add("joi_enriched_uses", with_sql("""
SELECT e.kind, coalesce(p.kind, 'unknown') AS under, count(*) AS uses, count(DISTINCT n.parent_id) AS modules FROM edges e
LEFT JOIN nodes n ON e.from_id = n.id AND n.kind = 'Order' LEFT JOIN nodes p ON n.parent_id = p.id GROUP BY ALL""", nodes=NODES_SQL, edges=EDGES_SQL))
def joi_enriched_uses(spark, sf_dir):
    """JOI-4: uses with what encloses them; orphans stay as unknown."""
    lines = stage(order_lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_returnflag", "pos"))
    tree = nodes(spark, sf_dir, lines)
    n = tree.filter("kind = 'Order'").select(F.col("id").alias("from_id"), "parent_id")
    joined = enriched_uses(edges(spark, sf_dir, lines), n, tree.select("id", "kind"))
    return joined.groupBy("kind", F.coalesce("under", F.lit("unknown")).alias("under")).agg(F.count("*").alias("uses"), F.countDistinct("parent_id").alias("modules"))


def enriched_uses(refs: DataFrame, sources: DataFrame, tree: DataFrame) -> DataFrame:
    """JOI-4: refs with parent_id (of the source, from sources: from_id, parent_id) and under, the parent's kind; nulls where there is none.

    Sources get their parents' kinds before they meet the edges: edges without a source would
    all have the same null parent, and go through one task of the second join. Both joins take
    more tasks as the tables grow.
    """
    sources, parents = dealt(["parent_id"], sources, tree.select(F.col("id").alias("parent_id"), F.col("kind").alias("under")))
    under = sources.join(parents, "parent_id", "left")
    refs, under = dealt(["from_id"], refs, under, counted=[refs, sources])
    return refs.join(under, "from_id", "left")


#: What follows a name says how it is used: a call, passed on, given another name, or something else.
AFTER = (("call", "^,"), ("aliased", "^[.;:]"), ("passed", "^ [a-z]"))

#: Uses are the long words of lines; by rule some of their token rows, some of their lines, and some of the texts at their offsets are not there.
USES_SQL = """SELECT module, child_index, i AS token_index, found[i] AS word, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::BIGINT AS place, payload
FROM (SELECT *, regexp_split_to_array(payload, '[a-z]{8,}') AS gaps, regexp_extract_all(payload, '[a-z]{8,}') AS found FROM seg WHERE regexp_matches(payload, '[a-z]{8,}')), LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i)"""


@REG.add("joi_classify_uses", with_sql("""
SELECT class, count(*) AS uses, count(DISTINCT word) AS words, count(DISTINCT module) AS modules FROM (
  SELECT *, CASE WHEN (module + place) % 17 = 3 THEN 'missing_reference' WHEN (module + child_index) % 19 = 4 THEN 'missing_statement' WHEN (module + place) % 23 = 5 THEN 'not_found'
    WHEN regexp_matches(after, '^,') THEN 'call' WHEN regexp_matches(after, '^[.;:]') THEN 'aliased' WHEN regexp_matches(after, '^ [a-z]') THEN 'passed' ELSE 'other' END AS class
  FROM (SELECT *, substr(payload, place + length(word) + 1, 4) AS after FROM u)) GROUP BY class""", seg=SEGMENTS_SQL, u=USES_SQL))
def joi_classify_uses(spark, sf_dir):
    """JOI-5 (re-aimed): every use of a name by what follows it in its line, or by the reason why it cannot be told."""
    segs = stage(segments(spark, sf_dir))
    found = stage(tokens(segs, "[a-z]{8,}"))
    uses = found.select("module", "child_index", F.col("offset").alias("place"), F.col("token").alias("word"))
    known = found.filter("(module + offset) % 17 <> 3").select("module", "child_index", F.col("offset").alias("place"), F.when(F.expr("(module + offset) % 23 = 5"), "?").otherwise(F.col("token")).alias("text"))
    lines = segs.filter("(module + child_index) % 19 <> 4")
    classed = classify_uses(uses, known, lines)
    return classed.groupBy("class").agg(F.count("*").alias("uses"), F.countDistinct("word").alias("words"), F.countDistinct("module").alias("modules"))


def classify_uses(uses: DataFrame, known: DataFrame, lines: DataFrame) -> DataFrame:
    """module, child_index, place, word, class for each use: left joins to its token row and to its line, then the text at the offset.

    missing_reference: there is no token row; missing_statement: no line; not_found: the line
    has another text at the offset. Else by what follows the word.
    """
    rows = uses.join(known.select("module", "child_index", "place", "text"), ["module", "child_index", "place"], "left")
    rows = rows.join(lines.select("module", "child_index", "payload"), ["module", "child_index"], "left")
    start = F.col("place").cast("int") + 1
    after = F.substring(F.col("payload"), start + F.char_length("text"), F.lit(4))
    kind = (F.when(F.col("text").isNull(), "missing_reference").when(F.col("payload").isNull(), "missing_statement")
            .when(F.substring(F.col("payload"), start, F.char_length("text")) != F.col("text"), "not_found"))
    for name, pattern in AFTER:
        kind = kind.when(after.rlike(pattern), name)
    return rows.select("module", "child_index", "place", "word", kind.otherwise("other").alias("class"))


def refresh_edges(refs: DataFrame, owned: DataFrame, resolved: DataFrame) -> DataFrame:
    """JOI-6: edges with an endpoint in `owned` go; `resolved` takes the place of those that start there."""
    a, b = owned.select(F.col("id").alias("from_id")), owned.select(F.col("id").alias("to_id"))
    kept = refs.join(a, "from_id", "left_anti").join(b, "to_id", "left_anti")
    return kept.select("from_id", "to_id", "kind").unionByName(resolved.join(a, "from_id", "left_semi").select("from_id", "to_id", "kind"))


@REG.add("joi_refresh_edges", with_sql("""
SELECT kind, count(*) AS n, count(DISTINCT to_id) AS targets FROM (
  SELECT * FROM edges WHERE from_id NOT IN (SELECT id FROM owned) AND to_id NOT IN (SELECT id FROM owned)
  UNION ALL SELECT from_id, 'C0', 'namespace' FROM edges WHERE from_id IN (SELECT id FROM owned)) GROUP BY kind""",
    edges=EDGES_SQL, owned="SELECT 'O' || o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 3 UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_partkey % 11 = 0"))
def joi_refresh_edges(spark, sf_dir):
    refs = edges(spark, sf_dir)
    owned = (read(spark, sf_dir, "orders").filter("o_orderkey % 7 = 3").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"))
             .union(read(spark, sf_dir, "part").filter("p_partkey % 11 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")))))
    again = refs.select("from_id", F.lit("C0").alias("to_id"), F.lit("namespace").alias("kind"))
    return refresh_edges(refs, owned, again).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("to_id").alias("targets"))


def violations(tree: DataFrame, refs: DataFrame) -> DataFrame:
    """JOI-7: rule, key, n: duplicate ids, missing parents, more than one edge a source, missing endpoints."""
    tree, refs = stage(tree.select("id", "parent_id")), stage(refs.select("from_id", "to_id"))  # each is read several times
    ids = tree.select("id").distinct()
    out = tree.groupBy(F.col("id").alias("key")).count().filter("count > 1").select(F.lit("duplicate_id").alias("rule"), "key", F.col("count").alias("n"))
    out = out.union(refs.groupBy(F.col("from_id").alias("key")).count().filter("count > 1").select(F.lit("many_edges"), "key", "count"))
    for rule, col, df in (("no_parent", "parent_id", tree.filter("parent_id is not null")), ("no_source", "from_id", refs), ("no_target", "to_id", refs)):
        lost = df.groupBy(F.col(col).alias("id")).count().join(ids, "id", "left_anti")
        out = out.union(lost.select(F.lit(rule), "id", "count"))
    return out


@REG.add("joi_integrity", with_sql("""
SELECT rule, key, n FROM (
  SELECT 'duplicate_id' AS rule, id AS key, count(*) AS n FROM nodes GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'many_edges', from_id, count(*) FROM edges GROUP BY from_id HAVING count(*) > 1
  UNION ALL SELECT 'no_parent', parent_id, count(*) FROM nodes WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM nodes) GROUP BY parent_id
  UNION ALL SELECT 'no_source', from_id, count(*) FROM edges WHERE from_id NOT IN (SELECT id FROM nodes) GROUP BY from_id
  UNION ALL SELECT 'no_target', to_id, count(*) FROM edges WHERE to_id NOT IN (SELECT id FROM nodes) GROUP BY to_id)""", nodes=NODES_SQL, edges=EDGES_SQL))
def joi_integrity(spark, sf_dir):
    """Parts are no nodes of this tree, so lines' targets are reported."""
    lines = stage(order_lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_returnflag", "pos"))
    return violations(nodes(spark, sf_dir, lines), edges(spark, sf_dir, lines))


@REG.add("joi_sources_under", with_sql("SELECT n.parent_id, e.to_id, count(*) AS n FROM edges e JOIN nodes n ON e.from_id = n.id WHERE n.parent_id LIKE 'O%' GROUP BY ALL HAVING count(*) > 1", nodes=NODES_SQL, edges=EDGES_SQL))
def joi_sources_under(spark, sf_dir):
    """JOI-14: edges whose source's parent is a given node (here each order with a repeated part)."""
    n = nodes(spark, sf_dir).filter("parent_id like 'O%'").select(F.col("id").alias("from_id"), "parent_id")
    return edges(spark, sf_dir).join(n, "from_id").groupBy("parent_id", "to_id").agg(F.count("*").alias("n")).filter("n > 1")


# --- links between pages and names between documents --------------------------------------

LINKS_SQL = """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""


def links(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


PAGE_NAMES_SQL = r"""SELECT page_id, lower(regexp_extract(html, '<title>\s*([^\s<]+)', 1)) || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.html' ELSE '/index' END AS name FROM pages"""
ING_EDGES_SQL = with_sql("", links="SELECT DISTINCT * FROM (" + LINKS_SQL + ")", names=PAGE_NAMES_SQL, edges="""SELECT page_id, href, rank, target FROM (SELECT l.page_id, l.href, c.rank, min(p.page_id) AS target FROM links l
JOIN (SELECT 0 AS rank, '' AS ext UNION ALL SELECT 1, '.html' UNION ALL SELECT 2, '/index') c ON true
JOIN names p ON p.name = lower(trim(l.href, '/')) || c.ext
GROUP BY l.page_id, l.href, c.rank)
QUALIFY rank = min(rank) OVER (PARTITION BY page_id, href)""")


def spelled(spark, sf_dir: str) -> DataFrame:
    """page_id, href, rank, name: the spellings (bare, .html, /index) that a link may mean."""
    rows = links(spark, sf_dir).distinct().withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("ext")) for i, e in enumerate(("", ".html", "/index"))])))
    return rows.select("page_id", "href", F.col("c.rank").alias("rank"), F.concat(F.lower(F.trim("href", F.lit("/"))), "c.ext").alias("name"))


def page_names(spark, sf_dir: str) -> DataFrame:
    """name, target: what each page is known by."""
    page = F.col("page_id")
    ending = F.when(page % 3 == 0, "").when(page % 3 == 1, ".html").otherwise("/index")
    return read(spark, sf_dir, "pages").select(F.concat(F.lower(F.regexp_extract("html", r"<title>\s*([^\s<]+)", 1)), ending).alias("name"), page.alias("target"))


def import_edges(spark, sf_dir: str) -> DataFrame:
    names = page_names(spark, sf_dir).groupBy("name").agg(F.min("target").alias("target"))
    best = spelled(spark, sf_dir).join(names, "name").groupBy("page_id", "href").agg(F.min(F.struct("rank", "target")).alias("b"))
    return best.select("page_id", "href", F.col("b.rank").alias("rank"), F.col("b.target").alias("target"))


@REG.add("ing_import_edges", ING_EDGES_SQL + " SELECT * FROM edges")
def ing_import_edges(spark, sf_dir):
    """ING-7 (re-aimed): a link resolves to the first candidate spelling that a page is known by."""
    return import_edges(spark, sf_dir)


#: A page's links one hop around those that changed.
DIRTY = "page_id % 10 = 3"


@REG.add("ing_dirty_closure", ING_EDGES_SQL + f""",
dirty AS (SELECT page_id FROM pages WHERE {DIRTY})
SELECT page_id, min(hop) AS hop FROM (SELECT page_id, 0 AS hop FROM dirty
  UNION ALL SELECT target, 1 FROM edges WHERE page_id IN (SELECT page_id FROM dirty) UNION ALL SELECT page_id, 1 FROM edges WHERE target IN (SELECT page_id FROM dirty)) GROUP BY page_id""")
def ing_dirty_closure(spark, sf_dir):
    """ING-7: the changed pages, and those that link to them or are linked from them."""
    refs = stage(import_edges(spark, sf_dir).select("page_id", "target"))
    return one_hop(read(spark, sf_dir, "pages").filter(DIRTY).select("page_id"), refs)


def one_hop(dirty: DataFrame, refs: DataFrame) -> DataFrame:
    """page_id, hop: dirty pages (0) and their neighbours over refs (page_id, target) either way (1)."""
    out = refs.join(dirty, "page_id", "left_semi").select(F.col("target").alias("page_id"))
    back = refs.join(dirty.select(F.col("page_id").alias("target")), "target", "left_semi").select("page_id")
    near = out.union(back).distinct().join(dirty, "page_id", "left_anti").select("page_id", F.lit(1).alias("hop"))
    return dirty.distinct().select("page_id", F.lit(0).alias("hop")).union(near)


@REG.add("joi_resolve_all", with_sql(r"""
SELECT l.page_id, l.href, c.rank, p.page_id AS target FROM links l JOIN (SELECT 0 AS rank, '' AS ext UNION ALL SELECT 1, '.html' UNION ALL SELECT 2, '/index') c ON true
JOIN names p ON p.name = lower(trim(l.href, '/')) || c.ext WHERE p.page_id <> l.page_id""", links="SELECT DISTINCT * FROM (" + LINKS_SQL + ")", names=PAGE_NAMES_SQL))
def joi_resolve_all(spark, sf_dir):
    """JOI-15: a link to every page known by one of its spellings; all pages of one name are kept, a page itself is not."""
    # spellings are distinct, and so are names: what they give needs no exchange to be so
    return spelled(spark, sf_dir).join(page_names(spark, sf_dir).distinct(), "name").filter("target <> page_id").select("page_id", "href", "rank", "target")


@REG.add("ing_resolve_names", r"""
WITH words AS (SELECT DISTINCT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS name FROM documents),
own AS (SELECT source, name, min(doc_id) AS target FROM words GROUP BY ALL),
far AS (SELECT lang, name, min(doc_id) AS target FROM words GROUP BY ALL)
SELECT via, count(*) AS n, count(DISTINCT name) AS names, sum(target)::BIGINT AS targets FROM (
  SELECT w.doc_id, w.name, CASE WHEN o.target <> w.doc_id THEN 'own' ELSE 'import' END AS via, CASE WHEN o.target <> w.doc_id THEN o.target ELSE f.target END AS target
  FROM words w JOIN own o ON w.source = o.source AND w.name = o.name JOIN far f ON w.lang = f.lang AND w.name = f.name)
WHERE target <> doc_id GROUP BY via""")
def ing_resolve_names(spark, sf_dir):
    """ING-4: a word refers to its first document in the own source, else in the language; self-edges go."""
    got = resolved_words(read(spark, sf_dir, "documents"))
    return got.groupBy("via").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.sum("target").alias("targets"))


def resolved_words(docs: DataFrame, pattern: str = "[a-z]{9,}") -> DataFrame:
    """doc_id, name, via, target."""
    words = docs.select("doc_id", "lang", "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0)).alias("name")).distinct()
    own = words.groupBy("source", "name").agg(F.min("doc_id").alias("own"))
    far = words.groupBy("lang", "name").agg(F.min("doc_id").alias("far"))
    got = words.join(own, ["source", "name"]).join(far, ["lang", "name"])
    here = F.col("own") != F.col("doc_id")
    return got.select("doc_id", "name", F.when(here, "own").otherwise("import").alias("via"), F.when(here, F.col("own")).otherwise(F.col("far")).alias("target")).filter("target <> doc_id")


@REG.add("ing_batch", with_sql(f"""
SELECT 'nodes' AS part, count(*) AS n, {summed_digest_sql(row_text_sql("module", "child_index", "md5(payload)"))} AS digest FROM seg
UNION ALL SELECT 'tokens', count(*), {summed_digest_sql(row_text_sql("module", "child_index", "place", "word"))} FROM u
UNION ALL SELECT 'edges', count(*), {summed_digest_sql(row_text_sql("doc_id", "name", "target"))} FROM r
UNION ALL SELECT 'modules', count(*), {summed_digest_sql("doc_id::VARCHAR")} FROM documents""", seg=SEGMENTS_SQL, u=USES_SQL,
    words="SELECT DISTINCT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS name FROM documents",
    r="""SELECT doc_id, name, target FROM (SELECT w.doc_id, w.name, CASE WHEN o.target <> w.doc_id THEN o.target ELSE f.target END AS target FROM words w
      JOIN (SELECT source, name, min(doc_id) AS target FROM words GROUP BY ALL) o ON w.source = o.source AND w.name = o.name
      JOIN (SELECT lang, name, min(doc_id) AS target FROM words GROUP BY ALL) f ON w.lang = f.lang AND w.name = f.name) WHERE target <> doc_id"""))
def ing_batch(spark, sf_dir):
    """ING-6: a corpus taken in as a whole: lines, their tokens, edges between documents, and the list of modules; a count and a digest of each part."""
    parts = ingest(read(spark, sf_dir, "documents"), segments(spark, sf_dir))
    texts = {"nodes": row_text("module", "child_index", F.md5("payload")), "tokens": row_text("module", "child_index", "offset", "token"), "edges": row_text("doc_id", "name", "target"), "modules": F.col("module").cast("string")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n"), summed_digest(texts[name]).alias("digest")).select(F.lit(name).alias("part"), "n", "digest")
        out = one if out is None else out.union(one)
    return out


def ingest(docs: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """ING-6: nodes, tokens, edges and modules of a corpus."""
    lines = stage(lines)
    return {"nodes": lines, "tokens": tokens(lines, "[a-z]{8,}"), "edges": resolved_words(docs), "modules": docs.select(F.col("doc_id").alias("module"))}


@REG.add("ing_edge_kind", with_sql("""
SELECT CASE WHEN to_id LIKE 'P%' THEN 'type' WHEN to_id LIKE 'C%' THEN 'value' ELSE 'namespace' END AS kind, count(*) AS n FROM edges GROUP BY 1""", edges=EDGES_SQL))
def ing_edge_kind(spark, sf_dir):
    """ING-5."""
    kind = F.when(F.col("to_id").startswith("P"), "type").when(F.col("to_id").startswith("C"), "value").otherwise("namespace")
    return edges(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


TARGETS = ("the", "and", "de", "die")


@REG.add("ing_occurrences", r"""
WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[^\s]+')) AS w FROM documents),
n AS (SELECT doc_id, source, w AS target, count(*) AS n FROM w WHERE w IN ('the', 'and', 'de', 'die') GROUP BY ALL),
f AS (SELECT source, target, min(doc_id) AS first_doc FROM n GROUP BY ALL)
SELECT n.doc_id, n.target, n.n, CASE WHEN f.first_doc IS NULL OR f.first_doc = n.doc_id THEN 0 ELSE n.n END AS resolved,
  CASE WHEN f.first_doc IS NULL OR f.first_doc = n.doc_id THEN 'textual' WHEN n.n > 20 THEN 'many' ELSE 'few' END AS class, md5(n.target || ':' || n.n) AS digest
FROM n LEFT JOIN f ON n.source = f.source AND n.target = f.target""")
def ing_occurrences(spark, sf_dir):
    """ING-8: how often each target occurs in each file, how many of these resolve to an edge (to the source's first file that has the word), and a class."""
    words = read(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s]+"), 0)).alias("target"))
    n = words.filter(F.col("target").isin(*TARGETS)).groupBy("doc_id", "source", "target").agg(F.count("*").alias("n"))
    first = n.groupBy("source", "target").agg(F.min("doc_id").alias("first_doc"))
    rows = n.join(first, ["source", "target"], "left")
    own = F.col("first_doc").isNull() | (F.col("first_doc") == F.col("doc_id"))
    return rows.select("doc_id", "target", "n", F.when(own, 0).otherwise(F.col("n")).alias("resolved"),
        F.when(own, "textual").when(F.col("n") > 20, "many").otherwise("few").alias("class"), F.md5(F.concat_ws(":", "target", "n")).alias("digest"))


@REG.add("agg_in_degree", with_sql("SELECT n.id, coalesce(e.n, 0) AS in_degree FROM nodes n LEFT JOIN (SELECT to_id, count(*) AS n FROM edges GROUP BY to_id) e ON e.to_id = n.id WHERE n.kind = 'Customer'", nodes=NODES_SQL, edges=EDGES_SQL))
def agg_in_degree(spark, sf_dir):
    """AGG-8."""
    n = edges(spark, sf_dir).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n"))
    return nodes(spark, sf_dir).filter("kind = 'Customer'").select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("in_degree"))


def rename(tree: DataFrame, refs: DataFrame, renames: DataFrame) -> DataFrame:
    """EDT-1: node id and new payload for each named row and each use; equal names are no change. renames: id, to_name."""
    hits = renames.join(tree.select("id", "payload"), "id").filter("payload <> to_name").select("id", "to_name")
    uses = refs.join(hits.select(F.col("id").alias("to_id"), "to_name"), "to_id").select(F.col("from_id").alias("id"), "to_name", F.col("to_id").alias("declaration"))
    return hits.select("id", "to_name", F.col("id").alias("declaration")).union(uses)


RENAMES_SQL = "SELECT id, CASE WHEN child_index % 2 = 0 THEN 'renamed_' || id ELSE payload END AS to_name FROM nodes WHERE kind = 'Customer' AND child_index % 2 = 0"
NAMED_SQL = "SELECT id, to_name, id AS declaration FROM hits UNION ALL SELECT e.from_id, h.to_name, h.id FROM edges e JOIN hits h ON e.to_id = h.id"


def asked_renames(tree: DataFrame) -> DataFrame:
    """Even customers get a new name, odd ones their own, which is a no-op."""
    return tree.filter("kind = 'Customer'").select("id", F.when(F.col("child_index") % 2 == 0, F.concat(F.lit("renamed_"), "id")).otherwise(F.col("payload")).alias("to_name"))


def renamed(tree: DataFrame, named: DataFrame) -> DataFrame:
    """EDT-1: the next version of the tree. A row that several renames touch takes the name of the least declaration."""
    new = named.groupBy("id").agg(F.min_by("to_name", "declaration").alias("to_name"))
    return tree.join(new, "id", "left").withColumn("payload", F.coalesce("to_name", "payload")).drop("to_name")


@REG.add("edt_rename", with_sql("""
SELECT declaration, to_name, count(*) AS affected, min(id) AS first_id, max(id) AS last_id FROM named GROUP BY ALL""", nodes=NODES_SQL, edges=EDGES_SQL, hits=RENAMES_SQL, named=NAMED_SQL))
def edt_rename(spark, sf_dir):
    """EDT-1: one log row a rename that is none to the same name, with how many rows it touches."""
    tree = stage(nodes(spark, sf_dir))
    return rename(tree, edges(spark, sf_dir), asked_renames(tree)).groupBy("declaration", "to_name").agg(F.count("*").alias("affected"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@REG.add("edt_rename_version", with_sql(f"""
SELECT n.kind, count(*) AS n, count_if(c.to_name IS NOT NULL)::BIGINT AS renamed, {summed_digest_sql(row_text_sql("n.id", "n.parent_id", "n.child_index", "coalesce(c.to_name, n.payload)"))} AS digest
FROM nodes n LEFT JOIN (SELECT id, min_by(to_name, declaration) AS to_name FROM named GROUP BY id) c ON c.id = n.id GROUP BY n.kind""", nodes=NODES_SQL, edges=EDGES_SQL, hits=RENAMES_SQL, named=NAMED_SQL))
def edt_rename_version(spark, sf_dir):
    """EDT-1: the version of the whole tree after all renames, by kind, with how many rows have another text and a digest."""
    tree = stage(nodes(spark, sf_dir))
    new = renamed(tree, rename(tree, edges(spark, sf_dir), asked_renames(tree)))
    both = new.join(tree.select("id", F.col("payload").alias("was")), "id")
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("payload") != F.col("was")).alias("renamed"), summed_digest(row_text("id", "parent_id", "child_index", "payload")).alias("digest"))


# --- projections --------------------------------------------------------------------------


@REG.add("prj_point_lookup", with_sql("SELECT * FROM nodes WHERE id = 'O11'", nodes=NODES_SQL))
def prj_point_lookup(spark, sf_dir):
    """PRJ-1."""
    return nodes(spark, sf_dir).filter("id = 'O11'")


@REG.add("prj_roots", with_sql("SELECT id, payload, row_number() OVER (ORDER BY id) AS place FROM nodes WHERE kind = 'Module'", nodes=NODES_SQL))
def prj_roots(spark, sf_dir):
    """PRJ-2: the few roots in order."""
    return nodes(spark, sf_dir).filter("kind = 'Module'").select("id", "payload", F.row_number().over(Window.orderBy("id")).cast("long").alias("place"))


@REG.add("prj_declarations", with_sql("SELECT id, parent_id, payload FROM nodes WHERE kind IN ('Order', 'Nation') AND payload = '1-URGENT' OR kind = 'Nation'", nodes=NODES_SQL))
def prj_declarations(spark, sf_dir):
    """PRJ-4: declarations by kind and name."""
    return nodes(spark, sf_dir).filter("kind in ('Order', 'Nation') and payload = '1-URGENT' or kind = 'Nation'").select("id", "parent_id", "payload")


@REG.add("prj_module_exports", with_sql("SELECT parent_id, id, payload, payload LIKE '1-%' OR payload LIKE '2-%' AS exported FROM nodes WHERE kind = 'Order'", nodes=NODES_SQL))
def prj_module_exports(spark, sf_dir):
    """PRJ-6, PRJ-7, PRJ-8: every module's declarations with an exported flag from the payload."""
    return module_exports(nodes(spark, sf_dir))


def module_exports(tree: DataFrame, module: str | None = None) -> DataFrame:
    """Declarations of one module, or of all."""
    rows = tree.filter("kind = 'Order'")
    rows = rows.filter(F.col("parent_id") == module) if module else rows
    return rows.select("parent_id", "id", "payload", F.col("payload").rlike("^[12]-").alias("exported"))


def matches_within(found: DataFrame, bound: int = 64) -> DataFrame:
    """PRJ-5: found, or an error if it has more rows than the bound."""
    if found.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} matches")
    return found


@REG.add("prj_find_declarations", with_sql("SELECT 7::BIGINT AS generation, id, kind, payload FROM nodes WHERE kind = 'Customer' AND payload LIKE '%00000001_'", nodes=NODES_SQL))
def prj_find_declarations(spark, sf_dir, generation: int = 7):
    """PRJ-5: declarations of one version of the tree by kind and name, with the version; rows without a name are none, more than 64 are an error."""
    found = nodes(spark, sf_dir).filter("kind = 'Customer' and payload is not null and payload like '%00000001_'")
    return matches_within(found).select(F.lit(generation).cast("long").alias("generation"), "id", "kind", "payload")


@REG.add("prj_bounded_matches", with_sql("""
SELECT payload, count(*) AS n, count(*) > 64 AS truncated, string_agg(id, ',' ORDER BY id) FILTER (WHERE rn <= 64) AS first_ids
FROM (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY id) AS rn FROM nodes WHERE kind = 'Order') GROUP BY payload""", nodes=NODES_SQL))
def prj_bounded_matches(spark, sf_dir, bound: int = 64):
    """PRJ-16: matches by name: the first 64 ids, the total, and whether there are more."""
    found = nodes(spark, sf_dir).filter("kind = 'Order'")
    first = found.withColumn("rn", F.row_number().over(Window.partitionBy("payload").orderBy("id"))).filter(F.col("rn") <= bound)  # pruned before the shuffle
    ids = first.groupBy("payload").agg(F.concat_ws(",", F.array_sort(F.collect_list("id"))).alias("first_ids"))
    n = found.groupBy("payload").agg(F.count("*").alias("n"))
    return n.join(ids, "payload").select("payload", "n", (F.col("n") > bound).alias("truncated"), "first_ids")


@REG.add("prj_bounded_payload", "SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 239) || '~' ELSE text END AS value, length(text)::BIGINT AS total, length(text) > 240 AS truncated FROM documents")
def prj_bounded_payload(spark, sf_dir, bound: int = 240):
    """PRJ-16: a payload cut at 240 characters, with its full length and whether it was cut."""
    n = F.char_length("text")
    return read(spark, sf_dir, "documents").select("doc_id", capped(F.col("text"), bound).alias("value"), n.cast("long").alias("total"), (n > bound).alias("truncated"))


@REG.add("prj_kind_labels", with_sql("""SELECT CASE kind WHEN 'Module' THEN 'module' WHEN 'Nation' THEN 'namespace' WHEN 'Customer' THEN 'class' WHEN 'Order' THEN 'function' ELSE 'statement' END AS label, count(*) AS n FROM nodes GROUP BY 1""", nodes=NODES_SQL))
def prj_kind_labels(spark, sf_dir):
    """PRJ-12."""
    labels = F.create_map(*[F.lit(x) for kv in (("Module", "module"), ("Nation", "namespace"), ("Customer", "class"), ("Order", "function")) for x in kv])
    return nodes(spark, sf_dir).groupBy(F.coalesce(F.try_element_at(labels, F.col("kind")), F.lit("statement")).alias("label")).agg(F.count("*").alias("n"))


@REG.add("prj_suffix_match", r"""
SELECT suffix, n, min_url, CASE WHEN n = 0 THEN 'absent' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS state FROM (
  SELECT s.suffix, count(p.url) AS n, min(p.url) AS min_url FROM (SELECT unnest(['/25#top', 'ref=x', '#top', 'no-such-page', '?page=2&ref=x']) AS suffix) s LEFT JOIN pages p ON ends_with(p.url, s.suffix) GROUP BY s.suffix)""")
def prj_suffix_match(spark, sf_dir):
    """PRJ-14: pages by url suffix, absence and ambiguity reported."""
    suffixes = ["/25#top", "ref=x", "#top", "no-such-page", "?page=2&ref=x"]
    url = F.col("url")
    counts = read(spark, sf_dir, "pages").agg(*[x for i, s in enumerate(suffixes) for x in (F.count_if(url.endswith(s)).alias(f"n{i}"), F.min(F.when(url.endswith(s), url)).alias(f"u{i}"))])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("suffix"), F.col(f"n{i}").alias("n"), F.col(f"u{i}").alias("min_url")) for i, s in enumerate(suffixes)])).alias("r")).select("r.*")
    return rows.withColumn("state", F.when(F.col("n") == 0, "absent").when(F.col("n") > 1, "ambiguous").otherwise("found"))


@REG.add("prj_scope_of", r"""
SELECT split_part(regexp_replace(url, '^https?://[^/]*/', ''), '/', 1) AS scope, count(*) AS n FROM pages GROUP BY 1""")
def prj_scope_of(spark, sf_dir):
    """PRJ-15: the relative path's first directory."""
    rel = F.regexp_replace("url", "^https?://[^/]*/", "")
    return read(spark, sf_dir, "pages").groupBy(F.split_part(rel, F.lit("/"), F.lit(1)).alias("scope")).agg(F.count("*").alias("n"))


@REG.add("prj_identifier_guard", r"""
SELECT word, regexp_full_match(word, '[A-Za-z_$][A-Za-z0-9_$]*') AS is_name, regexp_full_match(word, '0|[1-9][0-9]{0,18}') AS is_number, count(*) AS n
FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL HAVING count(*) > 3""")
def prj_identifier_guard(spark, sf_dir):
    """PRJ-17: which words would do as an identifier or as a canonical number."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n > 3")
    return words.select("word", F.col("word").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*\z").alias("is_name"), F.col("word").rlike(r"^(0|[1-9][0-9]{0,18})\z").alias("is_number"), "n")


@REG.add("prj_first_line", r"""
SELECT doc_id, CASE WHEN length(line) > 72 THEN substr(line, 1, 71) || '~' ELSE line END AS line FROM (
  SELECT doc_id, trim(split_part(regexp_replace(text, '^([A-Z][a-z]+\.\s+)+', ''), chr(10), 1), ' ') AS line FROM documents)""")
def prj_first_line(spark, sf_dir):
    """PRJ-13: the first line after leading remarks, capped at 72."""
    line = F.trim(F.split_part(F.regexp_replace("text", r"^([A-Z][a-z]+\.\s+)+", ""), F.lit("\n"), F.lit(1)))
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.char_length(line) > 72, F.concat(F.substring(line, 1, 71), F.lit("~"))).otherwise(line).alias("line"))


QUERIES, SQL = REG.queries, REG.sql
