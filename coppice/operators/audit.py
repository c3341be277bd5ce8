"""Audits of ordered logs: hash chains, numbering, tokens, transitions, expiry, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.plans.scans import BLOCK_ROWS, Running, blocked, scanned
from coppice.registration import Registry
from coppice.sources.adapters import LOG_SQL, log, read, with_sql

REG = Registry()
TERMINAL = ("purchase",)


def chain_breaks(journal: DataFrame, stream: str) -> DataFrame:
    """WIN-6: stream, first_break (-1 if none), entries, truncated. journal: stream, seq, previous_hash, entry_hash, body; the hash covers previous hash and body.

    A last entry without a hash is a tail cut short: it is dropped and no break. One inside a
    stream is a break.
    """
    w = Window.partitionBy(stream).orderBy("seq")
    rows = journal.select(stream, "seq", "previous_hash", "entry_hash", "body", F.lag("entry_hash", 1, "").over(w).alias("prev"), F.lead("seq").over(w).isNull().alias("is_last"))
    cut = F.col("is_last") & F.col("entry_hash").isNull()
    bad = ~F.col("previous_hash").eqNullSafe(F.col("prev")) | ~F.col("entry_hash").eqNullSafe(F.sha2(F.concat_ws("|", "previous_hash", "body"), 256))
    return rows.select(stream, "seq", (bad & ~cut).alias("bad"), cut.alias("cut")).groupBy(stream).agg(
        F.coalesce(F.min(F.when(F.col("bad"), F.col("seq"))), F.lit(-1).cast("long")).alias("first_break"), F.count_if(~F.col("cut")).alias("entries"), F.bool_or("cut").alias("truncated"))


#: Entries of one journal. A session's log is a journal for each so many sequence numbers, so that each is short enough to be chained in one fold.
JOURNAL_SPAN = 5000
JOURNAL_SQL = f"""
WITH RECURSIVE l AS ({LOG_SQL}),
r AS (SELECT session || '/' || seq // {JOURNAL_SPAN} AS journal, seq, kind || ':' || k AS body, row_number() OVER (PARTITION BY session, seq // {JOURNAL_SPAN} ORDER BY seq) AS i, count(*) OVER (PARTITION BY session, seq // {JOURNAL_SPAN}) AS n FROM l),
c(journal, i, n, seq, body, previous_hash, entry_hash) AS (
  SELECT journal, i, n, seq, body, '', sha256('|' || body) FROM r WHERE i = 1
  UNION ALL SELECT r.journal, r.i, r.n, r.seq, r.body, c.entry_hash, sha256(c.entry_hash || '|' || r.body) FROM c JOIN r ON r.journal = c.journal AND r.i = c.i + 1),
j AS (SELECT journal, seq, i, n, previous_hash, CASE WHEN seq % 211 = 17 THEN body || '!' ELSE body END AS body, CASE WHEN seq % 97 = 5 AND i = n THEN NULL ELSE entry_hash END AS entry_hash FROM c)"""


def journals(spark, sf_dir) -> DataFrame:
    """journal, seq, previous_hash, entry_hash, body: sound chains, then some bodies changed after the fact and some last lines cut short."""
    rows = log(spark, sf_dir).select(F.concat_ws("/", F.col("session").cast("string"), F.floor(F.col("seq") / JOURNAL_SPAN).cast("string")).alias("journal"), F.struct("seq", F.concat_ws(":", "kind", F.col("k").cast("string")).alias("body")).alias("e"))
    entries = rows.groupBy("journal").agg(F.array_sort(F.collect_list("e")).alias("e"))  # at most JOURNAL_SPAN
    start = F.array(F.struct(F.lit(None).cast("long").alias("seq"), F.lit("").alias("body"), F.lit("").alias("previous_hash"), F.lit("").alias("entry_hash")))
    link = lambda s, x: F.struct(x["seq"].alias("seq"), x["body"].alias("body"), F.element_at(s, -1)["entry_hash"].alias("previous_hash"), F.sha2(F.concat_ws("|", F.element_at(s, -1)["entry_hash"], x["body"]), 256).alias("entry_hash"))
    chained = entries.select("journal", F.posexplode(F.aggregate("e", start, lambda s, x: F.concat(s, F.array(link(s, x))))).alias("i", "c"), F.size("e").alias("n")).filter("i > 0")
    rows = chained.select("journal", "i", "n", "c.*")
    return rows.select("journal", "seq", "previous_hash", F.when(F.col("seq") % 211 == 17, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"),
        F.when(~((F.col("seq") % 97 == 5) & (F.col("i") == F.col("n"))), F.col("entry_hash")).alias("entry_hash"))


@REG.add("win_hash_chain", JOURNAL_SQL + """
SELECT journal, coalesce(min(seq) FILTER (WHERE NOT cut AND (previous_hash <> prev OR entry_hash IS DISTINCT FROM sha256(previous_hash || '|' || body))), -1) AS first_break, count_if(NOT cut)::BIGINT AS entries, bool_or(cut) AS truncated FROM (
  SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY journal ORDER BY seq), '') AS prev, entry_hash IS NULL AND i = n AS cut FROM j) GROUP BY journal""")
def win_hash_chain(spark, sf_dir):
    """Most journals are sound; in some a body was changed, in some the last line was cut short."""
    return chain_breaks(journals(spark, sf_dir), "journal")


def numbered(rows: DataFrame, order: list[str], start: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """WIN-8: rows with number, consecutive over all of them in the order given: a scan over blocks, so no task sees all rows."""
    return scanned(rows, [], order, {"number": Running("count")}, block_rows).withColumn("number", (F.col("number") + start).cast("long"))


@REG.add("win_number_events", with_sql("SELECT seq, row_number() OVER (ORDER BY ts_ms // 86400000, kind, seq) + 1000 AS number FROM l", l=LOG_SQL))
def win_number_events(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("day", F.floor(F.col("ts_ms") / 86400000))
    return numbered(rows, ["day", "kind", "seq"], 1000).select("seq", "number")


@REG.add("win_fence_tokens", with_sql("""
SELECT session, seq, token, k <= coalesce(max(k) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS stale FROM (
 SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS token FROM l)""", l=LOG_SQL))
def win_fence_tokens(spark, sf_dir):
    """WIN-9: tokens issued per resource in order; a claim at or below the highest consumed one is stale."""
    return fence_tokens(log(spark, sf_dir), "session", "seq", "k").select("session", "seq", "token", "stale")


def fence_tokens(rows: DataFrame, key: str, order: str, claim: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    running = {"token": Running("count"), "_high": Running("max", F.col(claim), strict=True)}
    return scanned(rows, [key], [order], running, block_rows).withColumn("stale", F.col(claim) <= F.coalesce("_high", F.lit(-1))).drop("_high")


@REG.add("win_terminal_left", with_sql("""
SELECT session, seq, 'purchase' AS prev, kind FROM (SELECT *, max(CASE WHEN kind = 'purchase' THEN 1 END) OVER (PARTITION BY session, k % 5 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM l)
WHERE over = 1 AND kind <> 'purchase'""", l=LOG_SQL))
def win_terminal_left(spark, sf_dir):
    """WIN-10."""
    rows = log(spark, sf_dir).withColumn("part", F.col("k") % 5)
    return terminal_left(rows, ["session", "part"], "seq", "kind").select("session", "seq", "prev", "kind")


def terminal_left(rows: DataFrame, keys: list[str], order: str, state: str, terminal: tuple[str, ...] = TERMINAL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """WIN-10: rows that would leave a terminal state, with that state. They are refused, so the state stays terminal for all that follow; another terminal state is let in."""
    ends = F.when(F.col(state).isin(*terminal), F.col(state))
    return scanned(rows, keys, [order], {"prev": Running("last", ends, strict=True)}, block_rows).filter(F.col("prev").isNotNull() & ends.isNull())


@REG.add("win_running_tick", with_sql("SELECT session, seq, max(k) OVER (PARTITION BY session ORDER BY seq) AS tick FROM l", l=LOG_SQL))
def win_running_tick(spark, sf_dir):
    """WIN-11."""
    return scanned(log(spark, sf_dir).select("session", "seq", "k"), ["session"], ["seq"], {"tick": Running("max", F.col("k"))}).select("session", "seq", "tick")


def page_after(rows: DataFrame, order: str, after: int, limit: int, complete: bool = False) -> DataFrame:
    """SRT-3: the first rows after a cursor. Where the result must be complete, more rows than the limit are an error."""
    found = rows.filter(F.col(order) > after)
    if complete and found.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows after {after}")
    return found.orderBy(order).limit(limit)


@REG.add("srt_page_after", with_sql("SELECT seq, kind, session FROM l WHERE seq > 100 ORDER BY seq LIMIT 64", l=LOG_SQL))
def srt_page_after(spark, sf_dir, after: int = 100, limit: int = 64):
    """SRT-3, STR-1: the page after a cursor (a limit is the feature here)."""
    return page_after(log(spark, sf_dir), "seq", after, limit).select("seq", "kind", "session")


@REG.add("str_acknowledge", with_sql("SELECT session, least(max(k * 20), (SELECT max(seq) FROM l)) AS acknowledged FROM l GROUP BY session", l=LOG_SQL))
def str_acknowledge(spark, sf_dir):
    """STR-2: monotonic per client, never beyond the head."""
    rows = log(spark, sf_dir)
    head = rows.agg(F.max("seq")).first()[0]
    return rows.groupBy("session").agg(F.least(F.max(F.col("k") * 20), F.lit(head)).cast("long").alias("acknowledged"))


@REG.add("str_idempotent", with_sql("""
SELECT key, count(*) AS requests, count(DISTINCT kind) AS bodies, min_by(seq, seq) AS first_seq, CASE WHEN count(DISTINCT kind) > 1 THEN 'violation' WHEN count(*) > 1 THEN 'duplicate' ELSE 'new' END AS state FROM (SELECT session || '/' || k AS key, * FROM l) GROUP BY key""", l=LOG_SQL))
def str_idempotent(spark, sf_dir):
    """STR-3: the same key again is a duplicate; with another body it is a violation."""
    bodies = F.countDistinct("kind")
    return log(spark, sf_dir).groupBy(F.concat_ws("/", F.col("session").cast("string"), F.col("k").cast("string")).alias("key")).agg(
        F.count("*").alias("requests"), bodies.alias("bodies"), F.min("seq").alias("first_seq"), F.when(bodies > 1, "violation").when(F.count("*") > 1, "duplicate").otherwise("new").alias("state"))


LEASE = {"click": 120, "view": 30, "signup": 60}


@REG.add("str_expire_leases", with_sql("""
SELECT session, seq, kind, expires_at, expired, CASE WHEN NOT expired THEN 'none' WHEN kind = 'click' THEN 'cancelled' ELSE 'requeued' END AS outcome, CASE WHEN expired THEN 'lease_expired' END AS event FROM (
SELECT session, seq, kind, expires_at, coalesce(next_at, (SELECT max(ts_ms) // 60000 FROM l)) >= expires_at AS expired
FROM (SELECT *, ts_ms // 60000 + CASE kind WHEN 'click' THEN 120 WHEN 'view' THEN 30 ELSE 60 END AS expires_at, lead(ts_ms // 60000) OVER (PARTITION BY session ORDER BY seq) AS next_at FROM l) WHERE kind IN ('click', 'view', 'signup'))""", l=LOG_SQL))
def str_expire_leases(spark, sf_dir):
    """STR-4 (batch): a draft (click), offer (view) or claim (signup) ends at tick + 120, 30 or 60 unless the session's next event comes before that; with no next event, if the last tick of the log has reached its end. What expires leaves an event; a draft is cancelled, the others go back to the queue."""
    return expired_leases(log(spark, sf_dir))


def expired_leases(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    rows = rows.select("session", "seq", "kind", F.floor(F.col("ts_ms") / 60000).alias("tick"))
    now = rows.agg(F.max("tick")).first()[0]
    length = F.when(F.col("kind") == "click", LEASE["click"]).when(F.col("kind") == "view", LEASE["view"]).otherwise(LEASE["signup"])
    rows = scanned(rows, ["session"], ["seq"], {"next_at": Running("lag", F.col("tick"), backward=True)}, block_rows).filter(F.col("kind").isin(*LEASE))
    gone = F.coalesce("next_at", F.lit(now)) >= F.col("tick") + length
    outcome = F.when(~gone, "none").when(F.col("kind") == "click", "cancelled").otherwise("requeued")
    return rows.select("session", "seq", "kind", (F.col("tick") + length).alias("expires_at"), gone.alias("expired"), outcome.alias("outcome"), F.when(gone, "lease_expired").alias("event"))


#: Which state may follow which; a purchase ends a lifecycle.
ALLOWED = {"signup": ("view", "click"), "view": ("view", "click", "purchase", "error"), "click": ("view", "click", "purchase", "error"), "error": ("view", "click"), "purchase": ()}
#: States by number; 0 is a machine that has not begun, which anything may begin.
STATES = tuple(ALLOWED)
#: Events that are folded to one function in a task.
FOLD_ROWS = 10_000


def allowed(state: str | None, kind: str) -> bool:
    return kind in STATES if state is None else kind in ALLOWED[state]


def lifecycle(rows: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """STR-5: session, state, transitions, refused, lifetime_ms, longest_ms of the machine that each session's events drive, in the order of seq.

    A transition that is not allowed is refused and changes nothing; so does an event that is no
    state. An event is thus a function from state to state. A block of a session's events is
    folded to one function (what it makes of each of six states), and these are composed;
    composition is associative, so a session of any length is folded in parts. Times
    are between accepted transitions. A session whose events are all refused has a null state.
    """
    size = len(STATES) + 1
    table = F.array(*[F.lit(allowed(STATES[s - 1] if s else None, STATES[k - 1]) if k else False) for s in range(size) for k in range(size)])
    code = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("kind")), F.lit(0)).cast("int")
    none = F.lit(None).cast("long")
    made = lambda end, refused, accepted, first, last, longest: F.struct(end.cast("int").alias("end"), refused.alias("refused"), accepted.alias("accepted"), first.alias("first"), last.alias("last"), longest.alias("longest"))
    zero = F.lit(0).cast("long")
    start = F.array(*[made(F.lit(s), zero, zero, none, none, zero) for s in range(size)])
    gap = lambda later, earlier: F.coalesce(later - earlier, zero)

    def step(acc, e):
        def one(a):
            goes = F.element_at(table, a["end"] * size + e["code"] + 1)
            moved = made(e["code"], a["refused"], a["accepted"] + 1, F.coalesce(a["first"], e["at"]), e["at"], F.greatest(a["longest"], gap(e["at"], a["last"])))
            return F.when(goes, moved).otherwise(made(a["end"], a["refused"] + 1, a["accepted"], a["first"], a["last"], a["longest"]))

        return F.transform(acc, one)

    def compose(acc, g):
        def one(a):
            b = F.element_at(g["f"], a["end"] + 1)
            longest = F.greatest(a["longest"], b["longest"], gap(b["first"], a["last"]))
            return made(b["end"], a["refused"] + b["refused"], a["accepted"] + b["accepted"], F.coalesce(a["first"], b["first"]), F.coalesce(b["last"], a["last"]), longest)

        return F.transform(acc, one)

    events, _ = blocked(rows.select("session", "seq", code.alias("code"), F.col("ts_ms").alias("at")), ["seq"], fold_rows)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "code", "at")))  # fold_rows at most
    parts = events.groupBy("session", "_block").agg(F.aggregate(ordered, start, step).alias("f"))
    whole = parts.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("_block", "f"))).alias("fs"))  # one for each so many events
    end = F.element_at(F.aggregate("fs", start, compose), 1)
    state = F.when(F.col("e.end") > 0, F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("e.end")))
    return whole.select("session", end.alias("e")).select("session", state.alias("state"), F.col("e.accepted").alias("transitions"), F.col("e.refused").alias("refused"),
        (F.col("e.last") - F.col("e.first")).alias("lifetime_ms"), F.col("e.longest").alias("longest_ms"))


_GOES_SQL = " OR ".join(f"(a.state = '{a}' AND b.state IN ({', '.join(repr(b) for b in bs)}))" for a, bs in ALLOWED.items() if bs)
#: The same as a left fold over each session's events; the first one begins.
LIFECYCLE_SQL = f"""
SELECT session, f.state AS state, f.accepted AS transitions, f.refused AS refused, f.last_at - f.first_at AS lifetime_ms, f.longest AS longest_ms FROM (
  SELECT session, list_reduce(list({{'state': kind, 'accepted': 1::BIGINT, 'refused': 0::BIGINT, 'first_at': ts_ms, 'last_at': ts_ms, 'longest': 0::BIGINT}} ORDER BY seq), lambda a, b: CASE WHEN {_GOES_SQL}
    THEN {{'state': b.state, 'accepted': a.accepted + 1, 'refused': a.refused, 'first_at': a.first_at, 'last_at': b.last_at, 'longest': greatest(a.longest, b.last_at - a.last_at)}}
    ELSE {{'state': a.state, 'accepted': a.accepted, 'refused': a.refused + 1, 'first_at': a.first_at, 'last_at': a.last_at, 'longest': a.longest}} END) AS f FROM l GROUP BY session)"""


@REG.add("str_lifecycle", with_sql(LIFECYCLE_SQL, l=LOG_SQL))
def str_lifecycle(spark, sf_dir):
    """STR-5 (batch)."""
    return lifecycle(log(spark, sf_dir))


@REG.add("str_log_audit", with_sql("""
SELECT 'duplicate_id' AS rule, count(*) AS n FROM (SELECT seq FROM l GROUP BY seq HAVING count(*) > 1)
UNION ALL SELECT 'sequence_gap', (max(seq) - min(seq) + 1) - count(DISTINCT seq) FROM l WHERE seq % 100 <> 50
UNION ALL SELECT 'bad_params', count_if(k IS NULL)::BIGINT FROM l
UNION ALL SELECT 'unknown_session', count(*) FROM l WHERE session NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 9)
UNION ALL SELECT 'time_backwards', count(*) FROM (SELECT ts_ms, lag(ts_ms) OVER (PARTITION BY session ORDER BY seq) AS p FROM l) WHERE ts_ms < p""", l=LOG_SQL))
def str_log_audit(spark, sf_dir):
    """STR-10: one violations table of aggregates and anti-joins."""
    rows = log(spark, sf_dir)
    known = read(spark, sf_dir, "customer").filter("c_custkey % 10 <> 9").select(F.col("c_custkey").alias("session"))
    back = rows.select("ts_ms", F.lag("ts_ms").over(Window.partitionBy("session").orderBy("seq")).alias("p")).filter("ts_ms < p")
    parts = (
        ("duplicate_id", rows.groupBy("seq").count().filter("count > 1").agg(F.count("*"))),
        ("sequence_gap", rows.filter("seq % 100 <> 50").agg(F.max("seq") - F.min("seq") + 1 - F.countDistinct("seq"))),
        ("bad_params", rows.agg(F.count_if(F.col("k").isNull()))),
        ("unknown_session", rows.join(known, "session", "left_anti").agg(F.count("*"))),
        ("time_backwards", back.agg(F.count("*"))),
    )
    out = None
    for rule, df in parts:
        one = df.toDF("n").select(F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n"))
        out = one if out is None else out.union(one)
    return out


@REG.add("str_stale_input", with_sql("SELECT seq, session, k, high FROM (SELECT *, max(k) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM l) WHERE k < high - 60", l=LOG_SQL))
def str_stale_input(spark, sf_dir):
    """STR-12: late rows by a running maximum, for a side sink."""
    high = F.max("k").over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return log(spark, sf_dir).select("seq", "session", "k", high.alias("high")).filter("k < high - 60")


@REG.add("str_close_orphans", with_sql("SELECT session, CASE WHEN last(kind ORDER BY seq) IN ('purchase', 'error') THEN last(kind ORDER BY seq) ELSE 'rolled_back' END AS state FROM l GROUP BY session", l=LOG_SQL))
def str_close_orphans(spark, sf_dir):
    """STR-14: what is still open at a restart is rolled back."""
    last = log(spark, sf_dir).groupBy("session").agg(F.max_by("kind", "seq").alias("kind"))
    return last.select("session", F.when(F.col("kind").isin("purchase", "error"), F.col("kind")).otherwise("rolled_back").alias("state"))


@REG.add("joi_log_to_nodes", with_sql("""
SELECT n_name, kind, count(*) AS n FROM (SELECT kind, unnest([session, k, session + k]) AS custkey FROM l) JOIN customer ON c_custkey = custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""", l=LOG_SQL))
def joi_log_to_nodes(spark, sf_dir):
    """JOI-16: log rows exploded to the ids they touch, and those to their module."""
    ids = log(spark, sf_dir).select("kind", F.explode(F.array("session", "k", F.col("session") + F.col("k"))).alias("c_custkey"))
    n = ids.groupBy("kind", "c_custkey").agg(F.count("*").alias("n"))
    j = n.join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(read(spark, sf_dir, "nation"), "n_nationkey")
    return j.groupBy("n_name", "kind").agg(F.sum("n").alias("n"))


@REG.add("agg_commit_patterns", with_sql("""
SELECT session, left(string_agg(params, ' ' ORDER BY seq), 200) AS prompt, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT k) AS modules FROM l GROUP BY session""", l=LOG_SQL))
def agg_commit_patterns(spark, sf_dir):
    """AGG-33: a transaction's prompt cut at 200, its kinds and distinct modules. The prompt needs the first 25 rows only (each has 8 characters at least)."""
    rows = log(spark, sf_dir)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy("seq"))).filter("r <= 25")
    prompt = first.groupBy("session").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "params"))), lambda x: x["params"]), " "), 1, 200).alias("prompt"))
    rest = rows.groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("k").alias("modules"))
    return prompt.join(rest, "session")


QUERIES, SQL = REG.queries, REG.sql
