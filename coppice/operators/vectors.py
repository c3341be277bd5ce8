"""Embeddings: context texts, incremental refresh, nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.functions.columns import clamp, l2_distance
from coppice.plans.staging import stage
from coppice.registration import Registry
from coppice.sources.adapters import LOG_SQL, log, read, with_sql

REG = Registry()
#: Queries of one broadcast: this many of 1536 floats are 6 MB.
QUERIES_MOST = 1000


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """SRT-2: query_id, rank, id, raw (the distance) and distance (rounded to 6 places): the k nearest rows by L2 for each query, ties to the smaller id.

    queries (query_id, q) are a stated set; they are broadcast in blocks of 1000, one pass over
    the rows for each. Each task keeps k rows a query before anything is shuffled.
    """
    asked = stage(queries.select("query_id", "q"))
    blocks = max(1, -(-asked.count() // QUERIES_MOST))
    vectors = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    out: DataFrame | None = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        scored = vectors.crossJoin(F.broadcast(block)).select("query_id", "id", l2_distance(F.col("v"), F.col("q")).alias("raw"))  # a block of stated queries against all rows
        out = scored if out is None else out.union(scored)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("raw", "id"))
    return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "id", "raw", F.round("raw", 6).alias("distance"), "rank")


RAW = "sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"


@REG.add("vec_semantic_search", f"""
SELECT query_id, id, round(raw, 6) AS distance, rank, label FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {RAW} AS raw, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {RAW}, v.vec_id) AS rank
FROM embeddings v, embeddings q WHERE q.vec_id IN (3, 14, 15)) WHERE rank <= 10""")
def vec_semantic_search(spark, sf_dir, k: int = 10):
    """SRT-2, VEC-4, FUN-10: with node metadata joined back."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id in (3, 14, 15)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = nearest(rows, asked, k)
    return found.join(rows.select(F.col("vec_id").alias("id"), "label"), "id").select("query_id", "id", "distance", "rank", "label")


@REG.add("vec_past_tasks", f"""
SELECT id, round(raw, 6) AS distance, round(greatest(0, least(1, 1 - raw)), 6) AS similarity, rank FROM (SELECT v.vec_id AS id, {RAW} AS raw, row_number() OVER (ORDER BY {RAW}, v.vec_id) AS rank
FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id = 26) q WHERE v.label = 1) WHERE rank <= 5""")
def vec_past_tasks(spark, sf_dir, k: int = 5):
    """SRT-4, VEC-6: similarity is 1 - distance, clamped to 0 to 1; no rows on a cold start. The raw distance is rounded once, at the end."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id = 26").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = nearest(rows.filter("label = 1"), asked, k)
    return found.select("id", "distance", F.round(clamp(1 - F.col("raw"), 0.0, 1.0), 6).alias("similarity"), "rank")


@REG.add("vec_context_text", """
SELECT d.doc_id, md5(concat_ws(chr(10), d.source, d.lang, coalesce(l.n, 0)::VARCHAR, split_part(d.text, chr(10), 1), left(d.text, 400))) AS context_md5 FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id""")
def vec_context_text(spark, sf_dir):
    """VEC-1."""
    return context(spark, sf_dir).select("doc_id", F.md5("context").alias("context_md5"))


def context(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    d = read(spark, sf_dir, "documents").join(n, "doc_id", "left")
    return d.select("doc_id", F.concat_ws("\n", "source", "lang", F.coalesce("n", F.lit(0)).cast("string"), F.split_part("text", F.lit("\n"), F.lit(1)), F.substring("text", 1, 400)).alias("context"))


def hashing_provider(dim: int = 64) -> Callable:
    """UDX-1: texts in, vectors out; a bag of hashed words, for want of a model. Any such function will do in its place."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.split():
                v[zlib.crc32(w.encode()) % dim] += 1.0
            out.append(v)
        return out

    return embed


def embed_texts(rows: DataFrame, provider: Callable, dim: int, batch: int = 100) -> DataFrame:
    """VEC-3: id, text -> id, embedding, in batches; a vector of another width is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                made = provider(part["text"].tolist())
                if any(len(v) != dim for v in made):
                    raise ValueError("vector width")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": made})

    return rows.select("id", "text").mapInPandas(run, "id long, embedding array<float>")


def stale(contexts: DataFrame, meta: DataFrame, model: str) -> DataFrame:
    """VEC-2, VEC-5: contexts whose (model, content hash) differs from what meta holds; only ids and hashes are joined."""
    now = contexts.select("doc_id", F.sha2(F.concat(F.lit(model), F.lit(chr(0)), "context"), 256).alias("content_hash"))
    return now.join(meta.select("doc_id", F.col("content_hash").alias("was")), "doc_id", "left").filter(~F.col("content_hash").eqNullSafe(F.col("was"))).select("doc_id", "content_hash")


def refresh_embeddings(contexts: DataFrame, held: DataFrame, provider: Callable, dim: int, model: str) -> tuple[DataFrame, DataFrame]:
    """VEC-2: (doc_id, embedding, content_hash) after an incremental run, and counts (embedded, skipped, total).

    held is what there was. Only contexts that are new or changed are embedded; their rows
    replace the old ones. Vectors of ids without a context stay.
    """
    due = stage(stale(contexts, held, model))
    made = embed_texts(contexts.join(due, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("context").alias("text")), provider, dim)
    fresh = stage(made.withColumnRenamed("id", "doc_id").join(due, "doc_id").select("doc_id", "embedding", "content_hash"))
    after = held.join(due, "doc_id", "left_anti").select("doc_id", "embedding", "content_hash").union(fresh)
    n = contexts.agg(F.count("*").alias("n")).join(fresh.agg(F.count("*").alias("embedded")))  # one row each
    counts = n.select("embedded", (F.col("n") - F.col("embedded")).alias("skipped"), F.col("n").alias("total"))
    return after, counts


@REG.add("vec_incremental", """
SELECT doc_id, doc_id % 10 IN (2, 7) AS embedded, sha256('m1' || chr(0) || concat_ws(chr(10), d.source, d.lang, coalesce(l.n, 0)::VARCHAR, split_part(d.text, chr(10), 1), left(d.text, 400))) AS content_hash
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l USING (doc_id)""")
def vec_incremental(spark, sf_dir):
    """VEC-2: a tenth of the documents is new, a tenth has an old hash; the table after the run, and which rows were embedded by it."""
    c = stage(context(spark, sf_dir))
    current = F.sha2(F.concat(F.lit("m1"), F.lit(chr(0)), "context"), 256)
    kept = F.array(F.lit(-1.0).cast("float"))
    held = c.filter("doc_id % 10 <> 7").select("doc_id", kept.alias("embedding"), F.when(F.col("doc_id") % 10 == 2, "old").otherwise(current).alias("content_hash"))
    after, _ = refresh_embeddings(c, held, hashing_provider(), 64, "m1")
    return after.select("doc_id", (F.size("embedding") == 64).alias("embedded"), "content_hash")


@REG.add("vec_incremental_counts", "SELECT count_if(doc_id % 10 IN (2, 7))::BIGINT AS embedded, count_if(doc_id % 10 NOT IN (2, 7))::BIGINT AS skipped, count(*) AS total FROM documents")
def vec_incremental_counts(spark, sf_dir):
    """VEC-2: the counts of the same run."""
    c = stage(context(spark, sf_dir))
    current = F.sha2(F.concat(F.lit("m1"), F.lit(chr(0)), "context"), 256)
    held = c.filter("doc_id % 10 <> 7").select("doc_id", F.array(F.lit(-1.0).cast("float")).alias("embedding"), F.when(F.col("doc_id") % 10 == 2, "old").otherwise(current).alias("content_hash"))
    return refresh_embeddings(c, held, hashing_provider(), 64, "m1")[1]


@REG.add("vec_embed_batches", r"""
SELECT d.doc_id, coalesce(m.mass, 0) AS mass, 64 AS width FROM documents d LEFT JOIN (SELECT doc_id, sum(1)::BIGINT AS mass FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n]+')) AS w FROM documents) GROUP BY doc_id) m USING (doc_id)""")
def vec_embed_batches(spark, sf_dir):
    """VEC-3, UDX-1: vectors by the hashing provider for every document; a vector's mass is the document's number of words."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    made = embed_texts(docs, hashing_provider(), 64)
    return made.select(F.col("id").alias("doc_id"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).cast("long").alias("mass"), F.size("embedding").alias("width"))


PATTERNS_SQL = "SELECT session, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS context FROM l GROUP BY session"


@REG.add("vec_pattern_embed", with_sql("""
SELECT session, session % 3 <> 1 AS embedded, sha256('m1' || chr(0) || context) AS content_hash, CASE WHEN session % 3 <> 1 THEN len(string_split(context, ' ')) ELSE -1 END::BIGINT AS mass FROM p""", l=LOG_SQL, p=PATTERNS_SQL))
def vec_pattern_embed(spark, sf_dir):
    """VEC-5: patterns of transactions (their kinds in order) embedded, but for those whose (model, content hash) is what it was (every third session)."""
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), " ")  # five kinds
    p = stage(log(spark, sf_dir).groupBy(F.col("session").alias("doc_id")).agg(kinds.alias("context")))
    current = F.sha2(F.concat(F.lit("m1"), F.lit(chr(0)), "context"), 256)
    held = p.filter("doc_id % 3 = 1").select("doc_id", F.array(F.lit(-1.0).cast("float")).alias("embedding"), current.alias("content_hash"))
    after, _ = refresh_embeddings(p, held, hashing_provider(), 64, "m1")
    mass = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).cast("long")
    return after.select(F.col("doc_id").alias("session"), (F.size("embedding") == 64).alias("embedded"), "content_hash", mass.alias("mass"))


QUERIES, SQL = REG.queries, REG.sql
