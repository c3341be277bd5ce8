"""Text as ordered segments: ingest, tokens, spans, splices, offset shifts, rendering, acceptance checks, commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.operators.generations import SUMS, Kept, Store
from coppice.operators.tree import LINE_EDGES_SQL, derived_id, line_edges, rekeyed, rekeyed_sql, source_map
from coppice.plans.digests import digest_of, row_text, row_text_sql, summed_digest, summed_digest_sql
from coppice.plans.joins import containing_span
from coppice.plans.staging import folder, stage
from coppice.registration import Registry
from coppice.sources.adapters import LOG_SQL, SEGMENTS_SQL, log, read, segments, with_sql

REG = Registry()


def node_id(path: Column, index_path: Column, kind: Column) -> Column:
    """ING-3."""
    return F.substring(F.sha1(F.concat_ws(chr(0), path, index_path, kind)), 1, 16)


@REG.add("ing_lower", with_sql("""
SELECT module::VARCHAR AS module, left(sha1(concat_ws(chr(0), 'doc/' || module, child_index::VARCHAR, 'Statement')), 16) AS id, 'Statement' AS kind, child_index, md5(payload) AS payload_md5 FROM seg WHERE payload <> ''
UNION ALL SELECT doc_id::VARCHAR, left(sha1(concat_ws(chr(0), 'doc/' || doc_id, '', 'Module')), 16), 'Module', -1, md5('doc/' || doc_id) FROM documents
UNION ALL SELECT module::VARCHAR, left(sha1(concat_ws(chr(0), 'doc/' || module, max(child_index + CASE WHEN payload <> '' THEN 1 ELSE 0 END)::VARCHAR, 'Closing')), 16), 'Closing', max(child_index + CASE WHEN payload <> '' THEN 1 ELSE 0 END), md5('') FROM seg GROUP BY module""", seg=SEGMENTS_SQL))
def ing_lower(spark, sf_dir):
    """ING-1, ING-3, ING-6: module, ordered statement rows and a closing row for each document; payloads join back to the text."""
    segs = segments(spark, sf_dir)
    path = F.concat(F.lit("doc/"), F.col("module").cast("string"))
    row = lambda df, kind, at, payload: df.select(
        F.col("module").cast("string").alias("module"), node_id(path, F.when(at >= 0, at.cast("string")).otherwise(""), F.lit(kind)).alias("id"), F.lit(kind).alias("kind"), at.alias("child_index"), F.md5(payload).alias("payload_md5"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("module"))
    ends = segs.groupBy("module").agg(F.max(F.col("child_index") + (F.col("payload") != "").cast("long")).alias("at"))
    return (row(segs.filter("payload <> ''"), "Statement", F.col("child_index"), F.col("payload"))
            .union(row(docs, "Module", F.lit(-1).cast("long"), path)).union(row(ends, "Closing", F.col("at"), F.lit(""))))


def tokens(segs: DataFrame, pattern: str = r"\S+") -> DataFrame:
    """ING-2 (re-aimed): module, child_index, token_index, token, offset for matches of the pattern.

    A token's offset is the running length of gaps and tokens before it, in code points: a
    window sum by segment over a row a token. No Python is run.
    """
    gaps, found = F.split("payload", pattern, -1), F.regexp_extract_all("payload", F.lit(f"({pattern})"), 1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("token"))
    rows = segs.select("module", "child_index", F.posexplode(pairs).alias("token_index", "p")).select("module", "child_index", F.col("token_index").cast("long").alias("token_index"), F.col("p.gap").alias("gap"), F.col("p.token").alias("token"))
    w = Window.partitionBy("module", "child_index").orderBy("token_index").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.char_length("gap") + F.char_length("token")).cast("long")).over(w)
    return rows.select("module", "child_index", "token_index", "token", (end - F.char_length("token")).alias("offset"))


@REG.add("ing_tokens", with_sql(r"""
SELECT module, child_index, count(*) AS n, sum(pos)::BIGINT AS offsets, max(pos)::BIGINT AS last_offset FROM (
  SELECT module, child_index, i, length(parts[i]) AS len, sum(length(parts[i]) + 1) OVER (PARTITION BY module, child_index ORDER BY i) - length(parts[i]) - 1 AS pos
  , parts[i] AS tok FROM (SELECT module, child_index, string_split(replace(payload, chr(10), ' '), ' ') AS parts FROM seg), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))
WHERE tok <> '' GROUP BY ALL""", seg=SEGMENTS_SQL))
def ing_tokens(spark, sf_dir):
    rows = tokens(segments(spark, sf_dir), r"[^ \n]+").filter("token <> ''")
    return rows.groupBy("module", "child_index").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"), F.max("offset").alias("last_offset"))


@REG.add("prj_segments", with_sql("SELECT module, child_index, i - 1 AS part, md5(trim(parts[i], ' ')) AS part_md5 FROM (SELECT module, child_index, string_split(payload, '. ') AS parts FROM seg), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)", seg=SEGMENTS_SQL))
def prj_segments(spark, sf_dir):
    """PRJ-11: indexed sub-segments of a payload."""
    rows = segments(spark, sf_dir).select("module", "child_index", F.posexplode(F.split("payload", r"\. ", -1)).alias("part", "text"))
    return rows.select("module", "child_index", F.col("part").cast("long").alias("part"), F.md5(F.trim("text")).alias("part_md5"))


@REG.add("joi_position_to_span", with_sql("""
SELECT p.module, p.place, m.child_index, m.start_at FROM (SELECT doc_id AS module, unnest(range(0, length(text), 997)) AS place FROM documents) p
JOIN m ON m.module = p.module AND m.start_at <= p.place AND p.place < m.end_at""", seg=SEGMENTS_SQL,
    m="""SELECT module, child_index, (sum(length(payload)) OVER w - length(payload))::BIGINT AS start_at, (sum(length(payload)) OVER w)::BIGINT AS end_at FROM seg WINDOW w AS (PARTITION BY module ORDER BY child_index)"""))
def joi_position_to_span(spark, sf_dir):
    """JOI-8: every 997th character of a document to the line that holds it, by bins of 1024 characters."""
    points = read(spark, sf_dir, "documents").filter("char_length(text) > 0").select(
        F.col("doc_id").alias("module"), F.explode(F.sequence(F.lit(0).cast("long"), (F.char_length("text") - 1).cast("long"), F.lit(997).cast("long"))).alias("place"))
    return containing_span(points, source_map(segments(spark, sf_dir)), ["module"], "place", "start_at", "end_at").select("module", "place", "child_index", "start_at")


def splice(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """WIN-4: key, payload, ok: all edits (key, start_at, end_at, old, new; offsets from 0) applied at once.

    If an edit's old text is not what stands there, or edits overlap, the payload is left and
    ok is false. A payload's edits are as many as it can hold, and travel to it as one array;
    the new payload is joined from the pieces between them, in time that grows with its length.
    """
    e = F.array_sort(F.collect_list(F.struct(F.col("start_at").cast("int").alias("start_at"), F.col("end_at").cast("int").alias("end_at"), "old", "new")))
    joined = rows.select(key, "payload").join(edits.groupBy(key).agg(e.alias("edits")), key, "left")
    n = F.size("edits")
    # a piece is the text from the end of the edit before to the start of this one, then the new text
    pieces = F.transform("edits", lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.try_element_at("edits", i)["end_at"]).alias("from_at"), x["start_at"].alias("to_at"), x["new"].alias("new"),
        ((x["end_at"] >= x["start_at"]) & (F.substring(F.col("payload"), x["start_at"] + 1, x["end_at"] - x["start_at"]) == x["old"])).alias("fits")))
    parts = F.transform("pieces", lambda x: F.concat(F.substring(F.col("payload"), x["from_at"] + 1, x["to_at"] - x["from_at"]), x["new"]))
    tail = F.substring(F.col("payload"), F.try_element_at("edits", n)["end_at"] + 1, F.char_length("payload"))
    ok = F.col("edits").isNull() | F.forall("pieces", lambda x: x["fits"] & (x["to_at"] >= x["from_at"]))
    marked = joined.withColumn("pieces", pieces).withColumn("ok", F.coalesce(ok, F.lit(False)))
    return marked.select(key, F.when(F.col("ok") & F.col("edits").isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("payload")).alias("payload"), "ok")


EDITS_SQL = "SELECT doc_id, i * 200 AS start_at, i * 200 + 5 AS end_at, CASE WHEN doc_id % 10 = 3 AND i = 1 THEN 'wrong' ELSE substr(text, i * 200 + 1, 5) END AS old, '<' || i || '>' AS new FROM documents, LATERAL (SELECT unnest(range(0, length(text) // 200)) AS i)"


def edits(spark, sf_dir):
    """An edit at every 200th character; in every tenth document one edit expects another text."""
    rows = read(spark, sf_dir, "documents").filter("char_length(text) >= 200").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("text") / 200).cast("int") - 1)).alias("i"))
    old = F.when((F.col("doc_id") % 10 == 3) & (F.col("i") == 1), "wrong").otherwise(F.substring(F.col("text"), F.col("i") * 200 + 1, F.lit(5)))
    return rows.select("doc_id", (F.col("i") * 200).alias("start_at"), (F.col("i") * 200 + 5).alias("end_at"), old.alias("old"), F.concat(F.lit("<"), F.col("i").cast("string"), F.lit(">")).alias("new"))


@REG.add("win_splice", with_sql("""
SELECT d.doc_id, CASE WHEN bad.doc_id IS NULL AND p.body IS NOT NULL THEN md5(p.body || substr(d.text, (length(d.text) // 200) * 200 + 1)) ELSE md5(d.text) END AS payload_md5, bad.doc_id IS NULL AS ok
FROM documents d LEFT JOIN (SELECT e.doc_id, string_agg(new || substr(d.text, e.end_at + 1, 195), '' ORDER BY start_at) AS body FROM e JOIN documents d USING (doc_id) GROUP BY e.doc_id) p ON p.doc_id = d.doc_id
LEFT JOIN (SELECT DISTINCT e.doc_id FROM e JOIN documents d USING (doc_id) WHERE old <> substr(d.text, e.start_at + 1, 5)) bad ON bad.doc_id = d.doc_id""", e=EDITS_SQL))
def win_splice(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("payload"))
    return splice(docs, edits(spark, sf_dir), "doc_id").select("doc_id", F.md5("payload").alias("payload_md5"), "ok")


def shift_offsets(marks: DataFrame, edits_: DataFrame, key: str, inclusive: bool) -> DataFrame:
    """WIN-5: marks (key, offset) moved by the length changes of edits before them: start <= offset if inclusive, else start < offset.

    Edits and marks go in one sorted window by document; no pairs are made.
    """
    e = edits_.select(key, F.col("start_at").cast("long").alias("offset"), (F.char_length("new") - (F.col("end_at") - F.col("start_at"))).cast("long").alias("delta"), F.lit(0 if inclusive else 2).alias("rank"), F.lit(False).alias("is_mark"))
    m = marks.select(key, F.col("offset").cast("long").alias("offset"), F.lit(0).cast("long").alias("delta"), F.lit(1).alias("rank"), F.lit(True).alias("is_mark"))
    w = Window.partitionBy(key).orderBy("offset", "rank").rowsBetween(Window.unboundedPreceding, 0)
    return e.union(m).withColumn("moved", F.col("offset") + F.sum("delta").over(w)).filter("is_mark").select(key, "offset", "moved")


@REG.add("win_shift_offsets", with_sql("""
SELECT m.doc_id, m.place AS "offset", m.place + coalesce(sum(length(e.new) - 5) FILTER (WHERE e.start_at < m.place), 0)::BIGINT AS strict, m.place + coalesce(sum(length(e.new) - 5) FILTER (WHERE e.start_at <= m.place), 0)::BIGINT AS inclusive
FROM (SELECT doc_id, unnest(range(0, length(text), 500)) AS place FROM documents) m LEFT JOIN e ON e.doc_id = m.doc_id AND e.start_at <= m.place GROUP BY m.doc_id, m.place""", e=EDITS_SQL))
def win_shift_offsets(spark, sf_dir):
    marks = read(spark, sf_dir, "documents").filter("char_length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(500))).alias("offset"))
    e = edits(spark, sf_dir)
    a, b = shift_offsets(marks, e, "doc_id", False), shift_offsets(marks, e, "doc_id", True)
    return a.withColumnRenamed("moved", "strict").join(b.withColumnRenamed("moved", "inclusive"), ["doc_id", "offset"])


def render(segs: DataFrame) -> DataFrame:
    """EDT-7: module, text: segments joined in order; a module's segments make one text, so they are gathered."""
    s = F.array_sort(F.collect_list(F.struct("child_index", "payload")))
    return segs.groupBy("module").agg(F.array_join(F.transform(s, lambda x: x["payload"]), "").alias("text"))


@REG.add("edt_render", "SELECT doc_id AS module, md5(text) AS text_md5, length(text)::BIGINT AS n FROM documents")
def edt_render(spark, sf_dir):
    """Rendering what was lowered gives the documents back."""
    return render(segments(spark, sf_dir)).select("module", F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("n"))


#: Pending edits of lines: the first word of every third line gives way to a mark of its length.
LINE_EDITS_SQL = """SELECT module, child_index, 0 AS start_at, length(old) AS end_at, old, '<' || length(old) || '>' AS new
FROM (SELECT *, regexp_extract(payload, '^[A-Za-z]+', 0) AS old FROM seg WHERE child_index % 3 = 0) WHERE old <> ''"""


def line_edits(segs: DataFrame) -> DataFrame:
    old = F.regexp_extract("payload", "^[A-Za-z]+", 0)
    rows = segs.filter("child_index % 3 = 0").select("module", "child_index", old.alias("old")).filter("old <> ''")
    return rows.select("module", "child_index", F.lit(0).alias("start_at"), F.char_length("old").alias("end_at"), "old", F.concat(F.lit("<"), F.char_length("old").cast("string"), F.lit(">")).alias("new"))


def edited_lines(segs: DataFrame, pending: DataFrame) -> DataFrame:
    """module, child_index, payload, ok: lines with their pending edits applied."""
    key = F.struct("module", "child_index")
    done = splice(segs.select(key.alias("at"), "payload"), pending.select(key.alias("at"), "start_at", "end_at", "old", "new"), "at")
    return done.select("at.module", "at.child_index", "payload", "ok")


EDITED_SQL = "SELECT s.module, s.child_index, coalesce(p.new || substr(s.payload, p.end_at + 1), s.payload) AS payload, p.new IS NOT NULL AS touched FROM seg s LEFT JOIN p USING (module, child_index)"


@REG.add("edt_render_pending", with_sql("SELECT module, md5(string_agg(payload, '' ORDER BY child_index)) AS text_md5, count_if(touched)::BIGINT AS edited FROM done GROUP BY module", seg=SEGMENTS_SQL, p=LINE_EDITS_SQL, done=EDITED_SQL))
def edt_render_pending(spark, sf_dir):
    """EDT-7: modules rendered with their pending edits applied; nothing is committed."""
    segs = stage(segments(spark, sf_dir))
    pending = stage(line_edits(segs))
    n = pending.groupBy("module").agg(F.count("*").alias("edited"))
    text = render(edited_lines(segs, pending)).select("module", F.md5("text").alias("text_md5"))
    return text.join(n, "module", "left").select("module", "text_md5", F.coalesce("edited", F.lit(0).cast("long")).alias("edited"))


@REG.add("edt_replace_span", r"""
SELECT doc_id, start_at, length(old)::BIGINT AS width, md5(CASE WHEN old = '' THEN text ELSE left(text, start_at) || '{' || source || ':' || length(old) || '}' || substr(text, start_at + length(old) + 1) END) AS text_md5
FROM (SELECT doc_id, text, source, old, CASE WHEN old = '' THEN -1 ELSE strpos(text, old) - 1 END AS start_at FROM (SELECT *, regexp_extract(text, '\. [A-Z][^.]*\.', 0) AS old FROM documents))""")
def edt_replace_span(spark, sf_dir):
    """EDT-4: one span of each document (its first whole sentence after a full stop) gives way to a body made from its scope; as an edit with the old text, so that splice checks it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", F.regexp_extract("text", r"\. [A-Z][^.]*\.", 0).alias("old"))
    docs = docs.withColumn("start_at", F.when(F.col("old") == "", F.lit(-1)).otherwise(F.instr("text", F.col("old")) - 1).cast("long"))
    new = F.concat(F.lit("{"), "source", F.lit(":"), F.char_length("old").cast("string"), F.lit("}"))
    asked = docs.filter("start_at >= 0").select("doc_id", "start_at", (F.col("start_at") + F.char_length("old")).alias("end_at"), "old", new.alias("new"))
    done = splice(docs.select("doc_id", F.col("text").alias("payload")), asked, "doc_id")
    where = docs.select("doc_id", "start_at", F.char_length("old").cast("long").alias("width"))
    return done.join(where, "doc_id").select("doc_id", "start_at", "width", F.md5("payload").alias("text_md5"))


# --- an argument for every call site ---------------------------------------------------------

#: A call is a long word before a comma; a long word before a full stop passes the name on and is a risk.
CALL = r"[a-z]{8,},"
SITES_SQL = f"""SELECT doc_id, scope, count_if(hit LIKE '%,')::BIGINT AS sites, count_if(hit LIKE '%.')::BIGINT AS risks,
  {summed_digest_sql("concat_ws('|', doc_id::VARCHAR, hit, regexp_replace(hit, ',$', '(' || scope || '),'))")} AS manifest
FROM (SELECT doc_id, coalesce(source, '') AS scope, unnest(regexp_extract_all(text, '[a-z]{{8,}}[,.]')) AS hit FROM documents) GROUP BY ALL"""


@REG.add("edt_add_argument", SITES_SQL)
def edt_add_argument(spark, sf_dir):
    """EDT-2: at every call site an argument chosen by scope is put in; a manifest of before and after by document, and sites where the name is passed on instead of called."""
    sites = call_sites(read(spark, sf_dir, "documents"))
    before_after = F.concat_ws("|", F.col("doc_id").cast("string"), "hit", "after")
    return sites.groupBy("doc_id", "scope").agg(F.count_if(F.col("hit").endswith(",")).alias("sites"), F.count_if(F.col("hit").endswith(".")).alias("risks"), summed_digest(before_after).alias("manifest"))


def call_sites(docs: DataFrame) -> DataFrame:
    """doc_id, scope, hit (a call or a risk site), after (the same with the scope's argument, or unchanged)."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("scope"), F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]{8,}[,.]"), 0)).alias("hit"))
    call = F.concat(F.substring("hit", F.lit(1), F.char_length("hit") - 1), F.lit("("), F.col("scope"), F.lit("),"))
    return rows.withColumn("after", F.when(F.col("hit").endswith(","), call).otherwise(F.col("hit")))


@REG.add("edt_argument_imports", r"""
WITH e AS (SELECT doc_id, coalesce(source, '') AS scope, text, unnest(regexp_extract_all(text, '[a-z]{8,},')) AS hit FROM documents),
h AS (SELECT DISTINCT doc_id, scope FROM e), d AS (SELECT doc_id, coalesce(source, '') AS scope, regexp_replace(text, '([a-z]{8,}),', '\1(' || coalesce(source, '') || '),', 'g') AS body FROM documents)
SELECT d.doc_id, CASE WHEN h.doc_id IS NULL OR contains(d.body, 'use ' || d.scope || ';') THEN 0 ELSE 1 END AS imported,
  md5(CASE WHEN h.doc_id IS NULL OR contains(d.body, 'use ' || d.scope || ';') THEN d.body ELSE 'use ' || d.scope || ';' || chr(10) || d.body END) AS text_md5 FROM d LEFT JOIN h USING (doc_id, scope)""")
def edt_argument_imports(spark, sf_dir):
    """EDT-3: the argument put into the documents, and a line that brings its scope in on top of each document that now needs it, unless it has one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("scope"), "text")
    body = F.regexp_replace(F.col("text"), F.lit(r"([a-z]{8,}),"), F.concat(F.lit("$1("), F.col("scope"), F.lit("),")))
    docs = docs.withColumns({"body": body, "called": F.regexp_count("text", F.lit(CALL)) > 0})
    line = F.concat(F.lit("use "), "scope", F.lit(";"))
    needs = F.col("called") & ~F.col("body").contains(line)
    return docs.select("doc_id", needs.cast("int").alias("imported"), F.md5(F.when(needs, F.concat(line, F.lit("\n"), "body")).otherwise(F.col("body"))).alias("text_md5"))


# --- moving lines between modules ------------------------------------------------------------

MOVED_SQL = """SELECT module AS from_module, child_index AS was, CASE WHEN moves THEN module + 1 ELSE module END AS module,
  row_number() OVER (PARTITION BY CASE WHEN moves THEN module + 1 ELSE module END ORDER BY moves, child_index) - 1 AS child_index, payload FROM (
  SELECT *, child_index = 0 AND module % 2 = 0 AND module + 1 IN (SELECT module FROM seg) AS moves FROM seg)"""


def moved_lines(segs: DataFrame) -> DataFrame:
    """EDT-6: from_module, was, module, child_index, payload: the first line of every even module goes to the end of the next; both close up."""
    there = segs.select((F.col("module") - 1).alias("module")).distinct().withColumn("has", F.lit(True))
    goes = (F.col("child_index") == 0) & (F.col("module") % 2 == 0) & F.coalesce("has", F.lit(False))
    rows = segs.join(there, "module", "left").select(F.col("module").alias("from_module"), F.col("child_index").alias("was"), F.when(goes, F.col("module") + 1).otherwise(F.col("module")).alias("module"), goes.alias("late"), "payload")
    place = F.row_number().over(Window.partitionBy("module").orderBy("late", "was")) - 1
    return rows.select("from_module", "was", "module", place.cast("long").alias("child_index"), "payload")


@REG.add("edt_move", with_sql("SELECT module, child_index, md5(payload) AS payload_md5 FROM (" + MOVED_SQL + ")", seg=SEGMENTS_SQL))
def edt_move(spark, sf_dir):
    return moved_lines(segments(spark, sf_dir)).select("module", "child_index", F.md5("payload").alias("payload_md5"))


@REG.add("edt_move_edges", with_sql(rekeyed_sql("from_module"), seg=SEGMENTS_SQL, e=LINE_EDGES_SQL, m=MOVED_SQL, moved="SELECT from_module, was, module, child_index AS now FROM m"))
def edt_move_edges(spark, sf_dir):
    """EDT-6: edges to and from moved lines, and those whose place changed, keyed by old to new id."""
    segs = stage(segments(spark, sf_dir))
    ids = moved_lines(segs).select(derived_id("from_module", "was").alias("old_id"), derived_id("module", "child_index").alias("new_id"))
    return rekeyed(line_edges(segs), ids)


@REG.add("edt_move_importers", r"""
WITH names AS (SELECT page_id, lower(regexp_extract(html, '<title>\s*([^\s<]+)', 1)) AS name FROM pages),
moving AS (SELECT DISTINCT name FROM names WHERE page_id % 4 = 0 AND name <> ''),
links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, CASE WHEN m.name IS NULL THEN href ELSE 'moved/' || m.name END AS href, m.name IS NOT NULL AS rewritten, count(*) AS n
FROM links LEFT JOIN moving m ON m.name = lower(trim(href, '/')) GROUP BY ALL""")
def edt_move_importers(spark, sf_dir):
    """EDT-6: pages that move (a quarter of them, under a new folder), and the links of the pages that name them rewritten."""
    pages = read(spark, sf_dir, "pages")
    names = pages.filter("page_id % 4 = 0").select(F.lower(F.regexp_extract("html", r"<title>\s*([^\s<]+)", 1)).alias("name")).filter("name <> ''").distinct()
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).withColumn("name", F.lower(F.trim("href", F.lit("/"))))
    out = links.join(names.withColumn("moves", F.lit(True)), "name", "left")
    moves = F.coalesce("moves", F.lit(False))
    return out.groupBy("page_id", F.when(moves, F.concat(F.lit("moved/"), "name")).otherwise(F.col("href")).alias("href"), moves.alias("rewritten")).agg(F.count("*").alias("n"))


# --- checks, plans, commits --------------------------------------------------------------------

RULES = (("starts_upper", "^[A-Z]", True), ("no_token_key", r'token = "', False), ("has_full_stop", r"\.", True), ("no_license", "(?i)license", False))
#: A rule that a pattern occurs so often at least, and at most.
COUNTED = (("few_shouts", "!", 0, 3), ("has_words", "[a-z]+", 5, 1 << 30))


@REG.add("edt_text_checks", "SELECT rule, count(*) AS modules, count_if(pass)::BIGINT AS passed, bool_and(pass) AS all_pass, sum(hits)::BIGINT AS hits FROM (" + " UNION ALL ".join(
    [f"SELECT '{n}' AS rule, regexp_matches(text, '{p}') = {str(w).lower()} AS pass, len(regexp_extract_all(text, '{p}')) AS hits FROM documents" for n, p, w in RULES]
    + [f"SELECT '{n}', len(regexp_extract_all(text, '{p}')) BETWEEN {a} AND {b}, len(regexp_extract_all(text, '{p}')) FROM documents" for n, p, a, b in COUNTED]
    + ["SELECT 'same_bytes', strlen(text) = n_chars, strlen(text) FROM documents"]) + ") GROUP BY rule")
def edt_text_checks(spark, sf_dir):
    """EDT-11: must-match and must-not-match rules, bounds on occurrences, and byte lengths as recorded, over all modules in one pass."""
    text = F.col("text")
    hits = lambda p: F.regexp_count("text", F.lit(p))
    rules = [F.struct(F.lit(n).alias("rule"), (text.rlike(p) == F.lit(w)).alias("pass"), hits(p).cast("long").alias("hits")) for n, p, w in RULES]
    rules += [F.struct(F.lit(n).alias("rule"), hits(p).between(a, b).alias("pass"), hits(p).cast("long").alias("hits")) for n, p, a, b in COUNTED]
    rules.append(F.struct(F.lit("same_bytes").alias("rule"), (F.octet_length("text") == F.col("n_chars")).alias("pass"), F.octet_length("text").cast("long").alias("hits")))
    t = read(spark, sf_dir, "documents").select(F.explode(F.array(*rules)).alias("c")).select("c.*")
    return t.groupBy("rule").agg(F.count("*").alias("modules"), F.count_if("pass").alias("passed"), F.bool_and("pass").alias("all_pass"), F.sum("hits").alias("hits"))


@REG.add("edt_operation_logged", with_sql("SELECT session, count_if(kind = 'signup' AND k = 50) = 1 AS logged FROM l GROUP BY session", l=LOG_SQL))
def edt_operation_logged(spark, sf_dir):
    """EDT-12: exactly one row of a kind with the expected parameter."""
    return log(spark, sf_dir).groupBy("session").agg((F.count_if((F.col("kind") == "signup") & (F.col("k") == 50)) == 1).alias("logged"))


PLAN_SQL = "SELECT s.module, s.child_index, s.payload, d.payload AS new FROM seg s JOIN done d USING (module, child_index)"


@REG.add("edt_plan", with_sql("""
SELECT m.module, coalesce(count(p.module), 0) AS edits, coalesce(count_if(p.payload <> p.new), 0)::BIGINT AS rederived, coalesce(bool_and(p.payload = p.new), true) AS noop
FROM (SELECT DISTINCT module FROM seg) m LEFT JOIN (SELECT d.* FROM pl d JOIN p USING (module, child_index)) p ON p.module = m.module GROUP BY m.module""", seg=SEGMENTS_SQL, p=LINE_EDITS_SQL, done=EDITED_SQL, pl=PLAN_SQL))
def edt_plan(spark, sf_dir):
    """EDT-10: for every module its pending edits, the lines whose tokens must be derived again, and whether it all comes to nothing."""
    segs = stage(segments(spark, sf_dir))
    return plan(segs, stage(line_edits(segs)))


def plan(segs: DataFrame, pending: DataFrame) -> DataFrame:
    """module, edits, rederived, noop; modules without edits are no-ops."""
    touched = segs.join(pending.select("module", "child_index").distinct(), ["module", "child_index"], "left_semi")
    new = edited_lines(touched, pending).select("module", "child_index", F.col("payload").alias("new"))
    per = touched.join(new, ["module", "child_index"]).groupBy("module").agg(F.count_if(F.col("payload") != F.col("new")).alias("rederived"))
    n = pending.groupBy("module").agg(F.count("*").alias("edits"))
    zero = F.lit(0).cast("long")
    out = segs.select("module").distinct().join(n, "module", "left").join(per, "module", "left")
    return out.select("module", F.coalesce("edits", zero).alias("edits"), F.coalesce("rederived", zero).alias("rederived"), (F.coalesce("rederived", zero) == 0).alias("noop"))


class Generations:
    """EDT-8, EDT-9: a store of lines alone, whose commits are pending edits of text."""

    def __init__(self, spark, path: str):
        self.store = Store(spark, path, {"lines": Kept(("module", "child_index"), "module long, child_index long, payload string")})
        self.path, self.head, self.rollback = path, self.store.head, self.store.rollback

    def read(self, generation: int) -> DataFrame:
        return self.store.at("lines", generation)

    def log(self) -> DataFrame:
        """generation, tx, kind, module, n: how many lines of a module a generation touched; for each generation also a row without a module, with the digest of all lines."""
        logged = self.store.log().select("generation", "tx", "kind", digest_of(F.col("n"), *[F.col(s) for s in SUMS]).alias("digest"))
        per = self.store.delta("lines", 1, self.head()).groupBy("generation", "module").agg(F.count("*").alias("n"))
        whole = logged.select("generation", F.lit(None).cast("long").alias("module"), F.lit(0).cast("long").alias("n"))
        return per.unionByName(whole).join(logged, "generation").select("generation", "tx", "kind", "module", "n", "digest")

    def seed(self, lines: DataFrame) -> int:
        return self.store.seed(lines=lines)

    def commit(self, tx: str, pending: DataFrame) -> int:
        """The head with pending edits applied becomes the next generation. An edit that does not fit is an error, and nothing is committed."""
        pending = stage(pending)
        touched = self.store.at("lines", self.head(), pending)
        done = stage(edited_lines(touched, pending))
        if not done.filter("not ok").isEmpty():
            raise ValueError("an edit does not fit the text it is for")
        return self.store.commit(tx, lines=done.select("module", "child_index", "payload", F.lit(False).alias("gone")))


@REG.add("edt_commit_rollback", with_sql(f"""
SELECT 0 AS generation, 'seed' AS kind, count(*) AS lines, 0::BIGINT AS affected, {summed_digest_sql(row_text_sql("module", "child_index", "payload"))} AS digest FROM seg
UNION ALL SELECT 1, 'commit', count(*), count_if(touched)::BIGINT, {summed_digest_sql(row_text_sql("module", "child_index", "payload"))} FROM done
UNION ALL SELECT 2, 'rollback', count(*), (SELECT count(*) FROM seg s JOIN done d USING (module, child_index) WHERE s.payload <> d.payload), {summed_digest_sql(row_text_sql("module", "child_index", "payload"))} FROM seg""", seg=SEGMENTS_SQL, p=LINE_EDITS_SQL, done=EDITED_SQL))
def edt_commit_rollback(spark, sf_dir):
    """EDT-8, EDT-9: all documents as generation 0, pending edits committed as generation 1, and rolled back (twice, to the same effect) as generation 2; digests and log rows of each."""
    made = Generations(spark, folder(spark, "generations"))
    made.seed(segments(spark, sf_dir))
    made.commit("t1", line_edits(made.read(0)))
    made.rollback("t1")
    made.rollback("t1")
    out = None
    for g in range(made.head() + 1):
        logged = made.log().filter(F.col("generation") == g).agg(F.max("kind").alias("kind"), F.sum("n").alias("affected"), F.max("digest").alias("digest"))
        one = logged.join(made.read(g).agg(F.count("*").alias("lines")))  # one row each
        one = one.select(F.lit(g).alias("generation"), "kind", "lines", "affected", "digest")
        out = one if out is None else out.union(one)
    return out


@REG.add("joi_expected_by_scope", r"""
SELECT doc_id, source, count(*) AS n, bool_and(length(hit) >= 8 + (length(source) - 4)) AS pass FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '[a-z]{8,},')) AS hit FROM documents) GROUP BY ALL""")
def joi_expected_by_scope(spark, sf_dir):
    """JOI-19: each match against what its scope expects; a module passes if it has some and all agree."""
    docs = read(spark, sf_dir, "documents")
    scope = docs.select("source").distinct().select("source", (8 + F.char_length("source") - 4).alias("least"))
    hits = docs.select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]{8,},"), 0)).alias("hit"))
    return hits.join(scope, "source").groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.bool_and(F.char_length("hit") >= F.col("least")).alias("pass"))


QUERIES, SQL = REG.queries, REG.sql
