"""The function families (FUN) as queries over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import columns as C
from coppice.registration import Registry
from coppice.sources.adapters import LOG_SQL, log, read, with_sql

REG = Registry()


@REG.add("fun_hashes", "SELECT doc_id, sha1(text) AS a, sha256(text) AS b, left(sha1(text), 16) AS c, strlen(text) AS n_bytes FROM documents")
def fun_hashes(spark, sf_dir):
    """FUN-1, FUN-13."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("a"), F.sha2("text", 256).alias("b"), F.substring(F.sha1("text"), 1, 16).alias("c"), F.octet_length("text").cast("long").alias("n_bytes"))


@REG.add("fun_json", """SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, json_valid(CASE WHEN event_id % 5 = 0 THEN left(props, 4) ELSE props END) AS valid, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS again FROM events""")
def fun_json(spark, sf_dir):
    """FUN-2."""
    broken = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json(broken).isNotNull().alias("valid"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("again"))


@REG.add("fun_regex", r"""SELECT doc_id, regexp_matches(text, 'token') AS has, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS numbers, regexp_extract(text, '([A-Z][a-z]+)', 1) AS first_word, md5(regexp_replace(text, '[0-9]', '#', 'g')) AS masked FROM documents""")
def fun_regex(spark, sf_dir):
    """FUN-3."""
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("token").alias("has"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"),
        F.regexp_extract("text", "([A-Z][a-z]+)", 1).alias("first_word"), F.md5(F.regexp_replace("text", "[0-9]", "#")).alias("masked"))


@REG.add("fun_strings", """SELECT c_custkey, substr(c_name, 3, 4) AS part, lpad(c_custkey::VARCHAR, 8, '0') AS padded, starts_with(c_name, 'Cust') AS a, ends_with(c_name, '7') AS b, contains(c_name, '#0') AS c, substr(c_name, 1, 3) || '<>' || substr(c_name, 6) AS spliced FROM customer""")
def fun_strings(spark, sf_dir):
    """FUN-4."""
    n = F.col("c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", F.substring(n, 3, 4).alias("part"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), n.startswith("Cust").alias("a"), n.endswith("7").alias("b"), n.contains("#0").alias("c"), F.overlay(n, F.lit("<>"), F.lit(4), F.lit(2)).alias("spliced"))


@REG.add("fun_paths", r"""SELECT page_id, '/' || split_part(url, '/', 4) AS head, regexp_replace(p, '/[^/]*$', '') AS dir, '/x/' || split_part(url, '/', 4) AS normal, regexp_replace(p, '\.[A-Za-z0-9]+$', '') AS bare FROM (SELECT *, regexp_replace(url, '^https?://[^/]*', '') AS p FROM pages)""")
def fun_paths(spark, sf_dir):
    """FUN-5: paths of pages, and a path with dots in it brought to normal form."""
    p = F.regexp_replace("url", "^https?://[^/]*", "")
    first = F.split_part("url", F.lit("/"), F.lit(4))
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), first).alias("head"), C.directory(p).alias("dir"), C.normal_path(F.concat(F.lit("/x/./y//../"), first)).alias("normal"), C.extension_stripped(p).alias("bare"))


@REG.add("fun_numbers", "SELECT o_orderkey, greatest(0, least(1, o_totalprice / 300000)) AS share, CASE WHEN o_custkey = 0 THEN -1 ELSE o_totalprice / o_custkey END AS ratio, ceil(o_totalprice * 0.95)::BIGINT AS rank, o_orderkey / 1e6 AS ms FROM orders")
def fun_numbers(spark, sf_dir):
    """FUN-6."""
    p = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select("o_orderkey", C.clamp(p / 300000, 0.0, 1.0).alias("share"), C.ratio(p, F.col("o_custkey"), -1.0).alias("ratio"), F.ceil(p * 0.95).alias("rank"), (F.col("o_orderkey") / 1e6).alias("ms"))


@REG.add("fun_arrays", with_sql("""SELECT session, len(a)::BIGINT AS n, list_sum(list_filter(a, lambda x: x % 2 = 0))::BIGINT AS evens, array_to_string(a[1:3], ',') AS first3, list_contains(a, 5) AS has5 FROM (SELECT session, list_sort(list(DISTINCT k)) AS a FROM l GROUP BY session)""", l=LOG_SQL))
def fun_arrays(spark, sf_dir):
    """FUN-7."""
    a = F.col("a")
    t = log(spark, sf_dir).groupBy("session").agg(F.array_sort(F.collect_set("k")).alias("a"))  # k has 100 values
    evens = F.aggregate(F.filter(a, lambda x: x % 2 == 0), F.lit(0).cast("long"), lambda s, x: s + x)
    return t.select("session", F.size(a).cast("long").alias("n"), evens.alias("evens"), F.array_join(F.slice(a, 1, 3).cast("array<string>"), ",").alias("first3"), F.array_contains(a, F.lit(5).cast("long")).alias("has5"))


@REG.add("fun_maps", with_sql("SELECT session, string_agg(kind || ':' || n, ',' ORDER BY kind) FILTER (WHERE n > 10) AS many, max(n) FILTER (WHERE kind = 'view') AS views FROM (SELECT session, kind, count(*) AS n FROM l GROUP BY ALL) GROUP BY session", l=LOG_SQL))
def fun_maps(spark, sf_dir):
    """FUN-8."""
    n = log(spark, sf_dir).groupBy("session", "kind").agg(F.count("*").alias("n"))
    m = n.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("m"))
    many = F.array_sort(F.transform(F.map_entries(F.map_filter("m", lambda k, v: v > 10)), lambda e: F.concat_ws(":", e["key"], e["value"])))
    return m.select("session", F.nullif(F.array_join(many, ","), F.lit("")).alias("many"), F.try_element_at("m", F.lit("view")).alias("views"))


@REG.add("fun_time", with_sql("SELECT seq, ts_ms, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S') AS iso, ts_ms // 60000 + 120 AS expires FROM l", l=LOG_SQL))
def fun_time(spark, sf_dir):
    """FUN-9: epoch milliseconds, ISO stamp (UTC, whatever the session's zone), logical tick arithmetic."""
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(floor(ts_ms / 1000) as decimal(18,6)))")
    return log(spark, sf_dir).select("seq", "ts_ms", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (F.floor(F.col("ts_ms") / 60000) + 120).alias("expires"))


@REG.add("fun_seeded", "SELECT c_custkey, CAST('0x' || substr(md5('9:' || c_custkey), 1, 13) AS BIGINT) % 10 AS pick FROM customer")
def fun_seeded(spark, sf_dir):
    """FUN-11."""
    from coppice.operators.stats import draw

    return read(spark, sf_dir, "customer").select("c_custkey", draw(F.lit(10), F.lit("9"), F.col("c_custkey").cast("string")).alias("pick"))


@REG.add("fun_redact", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'token = "[0-9a-f]{40}"', 'token = "[secret]"', 'g'), '\b[0-9]{16}\b', '[number]', 'g'),
 '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[address]', 'g'), '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '[mail]', 'g')) AS text_md5 FROM documents""")
def fun_redact(spark, sf_dir):
    """SRC-7."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(C.redacted(F.col("text"))).alias("text_md5"))


QUERIES, SQL = REG.queries, REG.sql
