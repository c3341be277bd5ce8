"""Trials, samples and sessions: distributions, bootstraps, verdicts, accounting, audits of ordered records."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.plans.digests import row_text, row_text_sql, summed_digest, summed_digest_sql
from coppice.plans.joins import as_of
from coppice.plans.scans import BLOCK_ROWS, Running, joined_by, scanned
from coppice.plans.staging import stage
from coppice.registration import Registry
from coppice.sources.adapters import LOG_SQL, log, read, with_sql

REG = Registry()
MUTATING = ("purchase", "signup")


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], interpolated: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """AGG-1, AGG-2: keys and a column for each wanted share, exact. Nulls are no values; a group without any has no row.

    Nearest rank: the value at rank ceil(p n), an observed one. Interpolated: between the two
    values around place p (n - 1). Values are counted first; counts are added up by a scan in
    blocks that a range exchange makes about equally full, whatever the values are, so an
    outlier or a hot group changes nothing for the others.
    """
    v = F.col(value).cast("double")
    counts = rows.filter(v.isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("c"))
    ranked = scanned(counts, keys, ["v"], {"last": Running("sum", F.col("c"))}, block_rows).withColumn("first", F.col("last") - F.col("c"))
    n = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    ranked = joined_by(ranked, n, keys) if keys else ranked.crossJoin(F.broadcast(n))  # without keys n is one row
    out = []
    for name, p in wanted.items():
        at = (F.col("n") - 1) * F.lit(p)
        if interpolated:
            low = F.max(F.when((F.col("first") <= F.floor(at)) & (F.floor(at) < F.col("last")), F.col("v")))
            high = F.max(F.when((F.col("first") <= F.ceil(at)) & (F.ceil(at) < F.col("last")), F.col("v")))
            share = F.max(at - F.floor(at))
            out.append((low + (high - low) * share).alias(name))
        else:
            rank = F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)) - 1
            out.append(F.max(F.when((F.col("first") <= rank) & (rank < F.col("last")), F.col("v"))).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-1: n, mean, interpolated quartiles, population deviation, extremes; null on no values. Rounded to 6 places."""
    r = lambda c, n: F.round(c, 6).alias(n)
    v = F.col(value)
    plain = rows.groupBy(*keys).agg(F.count(v).alias("n"), r(F.avg(v), "mean"), r(F.stddev_pop(v), "sd"), F.min(v).alias("least"), F.max(v).alias("most"))
    shares = percentiles(rows, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, interpolated=True)
    return plain.join(shares.select(*keys, *[r(F.col(c), c) for c in ("p25", "p50", "p75")]), keys, "left")


def nearest_rank(value: str, p: float, name: str) -> Column:
    """AGG-2 as an aggregate, for groups whose values are few enough for one task each (resamples, arms)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name)


@REG.add("agg_distribution", """SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS p50,
  round(quantile_cont(l_quantity, 0.75), 6) AS p75, round(stddev_pop(l_quantity), 6) AS sd, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ALL""")
def agg_distribution(spark, sf_dir):
    return distribution(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@REG.add("agg_nearest_rank", """SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY event_type""")
def agg_nearest_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    plain = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return plain.join(percentiles(rows, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "event_type", "left")


@REG.add("agg_trial_summary", """
SELECT o_orderpriority AS config, count(*) AS trials, count_if(o_orderstatus = 'F')::BIGINT AS successes, round(count_if(o_orderstatus = 'F') / count(*), 6) AS rate,
  round(quantile_cont(o_totalprice, 0.5), 4) AS cost_p50, round(avg(o_totalprice), 4) AS cost_mean, count_if(o_totalprice > 250000)::BIGINT AS expensive FROM orders GROUP BY 1""")
def agg_trial_summary(spark, sf_dir):
    """AGG-3."""
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "config")
    won = F.count_if(F.col("o_orderstatus") == "F")
    plain = rows.groupBy("config").agg(F.count("*").alias("trials"), won.alias("successes"), F.round(won / F.count("*"), 6).alias("rate"),
        F.round(F.avg("o_totalprice"), 4).alias("cost_mean"), F.count_if(F.col("o_totalprice") > 250000).alias("expensive"))
    middle = percentiles(rows, ["config"], "o_totalprice", {"p50": 0.5}, interpolated=True)
    return plain.join(middle.select("config", F.round("p50", 4).alias("cost_p50")), "config", "left")


@REG.add("agg_histogram", with_sql("SELECT session, string_agg(kind || '=' || n, ',' ORDER BY kind) AS histogram FROM (SELECT session, kind, count(*) AS n FROM l GROUP BY ALL) GROUP BY session", l=LOG_SQL))
def agg_histogram(spark, sf_dir):
    """AGG-4: counts by value as one map a group; two levels, so only totals are gathered."""
    n = log(spark, sf_dir).groupBy("session", "kind").agg(F.count("*").alias("n"))
    m = F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n")))
    return n.groupBy("session").agg(F.array_join(m, ",").alias("histogram"))


@REG.add("agg_team_accounting", with_sql("""
SELECT session, count(*) AS events, sum(k)::BIGINT AS tokens, max(ts_ms) - min(ts_ms) AS makespan_ms, count_if(kind = 'error')::BIGINT AS failures,
  CASE WHEN count_if(kind = 'error') = 0 THEN 'clean' WHEN count_if(kind = 'error') * 4 > count(*) THEN 'failing' ELSE 'mixed' END AS status FROM l GROUP BY session""", l=LOG_SQL))
def agg_team_accounting(spark, sf_dir):
    """AGG-5."""
    bad = F.count_if(F.col("kind") == "error")
    return log(spark, sf_dir).groupBy("session").agg(F.count("*").alias("events"), F.sum("k").alias("tokens"), (F.max("ts_ms") - F.min("ts_ms")).alias("makespan_ms"), bad.alias("failures"),
        F.when(bad == 0, "clean").when(bad * 4 > F.count("*"), "failing").otherwise("mixed").alias("status"))


@REG.add("agg_failure_classes", with_sql("SELECT CASE kind WHEN 'error' THEN 'provider' WHEN 'view' THEN 'none' WHEN 'click' THEN 'none' WHEN 'purchase' THEN 'budget' WHEN 'signup' THEN 'setup' END AS class, count(*) AS n FROM l GROUP BY 1", l=LOG_SQL))
def agg_failure_classes(spark, sf_dir):
    """AGG-6: a value outside the vocabulary is an error."""
    classes = F.create_map(*[F.lit(x) for kv in (("error", "provider"), ("view", "none"), ("click", "none"), ("purchase", "budget"), ("signup", "setup")) for x in kv])
    got = F.try_element_at(classes, F.col("kind"))
    known = F.when(got.isNull(), F.raise_error(F.concat(F.lit("unknown failure value: "), F.col("kind")))).otherwise(got)
    return log(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")).groupBy(known.alias("class")).agg(F.sum("n").alias("n"))


@REG.add("agg_round_budget", with_sql("""
SELECT session, count(*) AS done, sum(k)::BIGINT AS spent FROM (
  SELECT *, coalesce(sum(k) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) WHERE before < 500 GROUP BY session""", l=LOG_SQL))
def agg_round_budget(spark, sf_dir, budget: int = 500):
    """AGG-7: the prefix of each ordered ledger up to and with the row that breaks the budget."""
    rows = scanned(log(spark, sf_dir).select("session", "seq", "k"), ["session"], ["seq"], {"_sum": Running("sum", F.col("k"), strict=True)})
    rows = rows.withColumn("before", F.coalesce("_sum", F.lit(0)))
    return rows.filter(F.col("before") < budget).groupBy("session").agg(F.count("*").alias("done"), F.sum("k").alias("spent"))


@REG.add("agg_overlap", """
SELECT a.event_type AS a, b.event_type AS b, coalesce(a.lo <= b.hi AND b.lo <= a.hi, true) AS overlap FROM (SELECT event_type, min(value) FILTER (WHERE value > 40) AS lo, max(value) FILTER (WHERE value > 40) AS hi FROM events GROUP BY 1) a
JOIN (SELECT event_type, min(value) FILTER (WHERE value < 50) AS lo, max(value) FILTER (WHERE value < 50) AS hi FROM events GROUP BY 1) b ON a.event_type < b.event_type""")
def agg_overlap(spark, sf_dir):
    """AGG-11: do the ranges of two arms overlap; an empty one counts as overlapping. One row an arm is compared."""
    arms = read(spark, sf_dir, "events").groupBy("event_type").agg(*[f(F.when(c, F.col("value"))).alias(n) for n, f, c in (
        ("alo", F.min, F.col("value") > 40), ("ahi", F.max, F.col("value") > 40), ("blo", F.min, F.col("value") < 50), ("bhi", F.max, F.col("value") < 50))])
    a, b = arms.select(F.col("event_type").alias("a"), "alo", "ahi"), arms.select(F.col("event_type").alias("b"), "blo", "bhi")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.coalesce((F.col("alo") <= F.col("bhi")) & (F.col("blo") <= F.col("ahi")), F.lit(True)).alias("overlap"))


@REG.add("agg_suite_verdict", """
SELECT l_linestatus, bool_and(sep) FILTER (WHERE l_returnflag <> 'N') AND NOT bool_or(sep) FILTER (WHERE l_returnflag = 'N') AS holds, count(*) AS tasks, sum(n)::BIGINT AS n,
  CASE WHEN min(n) < 3 THEN 'n<3' ELSE '' END AS caveat FROM (SELECT l_linestatus, l_returnflag, max(l_discount) - min(l_discount) > 0.05 AS sep, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_linestatus""")
def agg_suite_verdict(spark, sf_dir):
    """AGG-12, AGG-13, AGG-26: all structural tasks separate and the control does not; small samples carry a caveat."""
    t = read(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag").agg((F.max("l_discount") - F.min("l_discount") > 0.05).alias("sep"), F.count("*").alias("n"))
    control = F.col("l_returnflag") == "N"
    return t.groupBy("l_linestatus").agg((F.bool_and(F.when(~control, F.col("sep"))) & ~F.bool_or(F.when(control, F.col("sep")))).alias("holds"), F.count("*").alias("tasks"), F.sum("n").alias("n"), F.when(F.min("n") < 3, "n<3").otherwise("").alias("caveat"))


@REG.add("agg_worst_verdict", """
SELECT o_custkey, CASE WHEN worst = 3 THEN 'fail' WHEN worst = 2 OR NOT has_required THEN 'inconclusive' ELSE 'pass' END AS state, has_required,
  CASE WHEN worst = 3 THEN 1 WHEN worst = 2 OR NOT has_required THEN 2 ELSE 0 END AS exit_code
FROM (SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) AS worst, count_if(o_orderpriority = '5-LOW') > 0 AS has_required FROM orders GROUP BY 1)""")
def agg_worst_verdict(spark, sf_dir):
    """AGG-14: the worst state of a customer's orders; without one of the required kind there is no pass."""
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    t = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(level).alias("worst"), (F.count_if(F.col("o_orderpriority") == "5-LOW") > 0).alias("has_required"))
    capped = (F.col("worst") == 2) | ~F.col("has_required")
    return t.select("o_custkey", F.when(F.col("worst") == 3, "fail").when(capped, "inconclusive").otherwise("pass").alias("state"), "has_required",
        F.when(F.col("worst") == 3, 1).when(capped, 2).otherwise(0).alias("exit_code"))


def draw(n: Column, *parts: Column) -> Column:
    """FUN-11: a seeded whole number from 0 to n - 1: the first 13 hex digits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") % n).cast("long")


PAIRS_SQL = """SELECT i, a.value AS kernel, b.value AS base FROM
 (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events WHERE event_type = 'click') a JOIN
 (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events WHERE event_type = 'view') b USING (i)"""


def paired_by_rank(spark, sf_dir) -> DataFrame:
    """JOI-12: two arms paired by their order; ranks come from per-session counts, so no arm is ranked in one task."""
    rows = read(spark, sf_dir, "events").filter("event_type in ('click', 'view')").select("event_type", "event_id", "value", F.floor(F.col("event_id") / 1000).alias("block"))
    counts = rows.groupBy("event_type", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("event_type").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("event_type", "block", before.alias("start"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("event_type", "block").orderBy("event_id"))).join(base, ["event_type", "block"])
    ranked = ranked.select((F.col("start") + F.col("r") - 1).alias("i"), "event_type", "value")
    a = ranked.filter("event_type = 'click'").select("i", F.col("value").alias("kernel"))
    return a.join(ranked.filter("event_type = 'view'").select("i", F.col("value").alias("base")), "i")


@REG.add("joi_paired_arms", with_sql("SELECT i, kernel, base, kernel > base AS slower FROM p", p=PAIRS_SQL))
def joi_paired_arms(spark, sf_dir):
    return paired_by_rank(spark, sf_dir).select("i", "kernel", "base", (F.col("kernel") > F.col("base")).alias("slower"))


@REG.add("joi_arm_checks", """
WITH s AS (SELECT event_type AS arm, user_id AS pair, count(*) AS n, min(event_id) AS first_seq FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT coalesce(a.pair, b.pair) AS pair, CASE WHEN a.pair IS NULL THEN 'no_click' WHEN b.pair IS NULL THEN 'no_view' WHEN a.n <> b.n THEN 'uneven' WHEN a.first_seq > b.first_seq THEN 'order' ELSE 'sound' END AS state
FROM (SELECT * FROM s WHERE arm = 'click') a FULL JOIN (SELECT * FROM s WHERE arm = 'view') b ON a.pair = b.pair""")
def joi_arm_checks(spark, sf_dir):
    """JOI-12: users as pairs of two arms; which lack an arm, have other numbers of samples on each side, or came in the wrong order."""
    rows = read(spark, sf_dir, "events").filter("event_type in ('click', 'view')").select(F.col("event_type").alias("arm"), F.col("user_id").alias("pair"), F.col("event_id").alias("seq"))
    return arm_checks(rows, "click", "view")


def arm_checks(samples: DataFrame, first: str, second: str) -> DataFrame:
    """JOI-12: pair, state: what is wrong with a pair of arms (samples: arm, pair, seq), or `sound`."""
    s = samples.groupBy("arm", "pair").agg(F.count("*").alias("n"), F.min("seq").alias("at"))
    a = s.filter(F.col("arm") == first).select("pair", F.col("n").alias("a_n"), F.col("at").alias("a_at"))
    b = s.filter(F.col("arm") == second).select("pair", F.col("n").alias("b_n"), F.col("at").alias("b_at"))
    state = F.when(F.col("a_n").isNull(), f"no_{first}").when(F.col("b_n").isNull(), f"no_{second}").when(F.col("a_n") != F.col("b_n"), "uneven").when(F.col("a_at") > F.col("b_at"), "order").otherwise("sound")
    return a.join(b, "pair", "full_outer").select("pair", state.alias("state"))


#: Blocks of values for either side of the pairs: the square root of their number by eight, within these bounds.
GRID = (4, 1024)


def _blocks_of(rows: DataFrame, value: str, parts: int) -> DataFrame:
    """rows with <value>_block: about equally full ranges of values, equal values together. The driver holds the splitters."""
    cuts = sorted(set(rows.approxQuantile(value, [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    if not cuts:
        return rows.withColumn(f"{value}_block", F.lit(0.0))
    splits = [-math.inf, *cuts, math.inf]
    return Bucketizer(splits=splits, inputCol=value, outputCol=f"{value}_block").transform(rows)


def _draw_cells(cells: pd.DataFrame, seed: int):
    """For each resample: how often each cell comes, which block of either side holds the wanted rank, and the rank inside it."""
    share = cells["c"].to_numpy() / cells["c"].sum()
    n, sides = int(cells["c"].sum()), {s: cells[f"{s}_block"].to_numpy().astype(int) for s in ("kernel", "base")}
    wanted = math.ceil(n * 95 / 100)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for b in part["id"]:
                x = np.random.default_rng([seed, b]).multinomial(n, share)
                out = {"b": b, "kernel_block": sides["kernel"], "base_block": sides["base"], "x": x}
                for s, block in sides.items():
                    upto = np.cumsum(np.bincount(block, x))
                    at = int(np.searchsorted(upto, wanted))
                    out[f"{s}_rank"] = np.where(block == at, wanted - (upto[at - 1] if at else 0), 0).astype(int)
                frame = pd.DataFrame(out)
                yield frame[(frame["x"] > 0) & ((frame["kernel_rank"] > 0) | (frame["base_rank"] > 0))]

    return run


def _draw_pairs(seed: int):
    """For one cell: its draws in each resample that asks for it, dealt over its pairs. The same for both sides, which keeps the pairs together."""

    def run(key, asked: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values(["kernel", "base"])
        share, out = pairs["c"].to_numpy() / pairs["c"].sum(), []
        for r in asked.itertuples():
            c = np.random.default_rng([seed, r.b, int(r.kernel_block), int(r.base_block)]).multinomial(r.x, share)
            for side, s in enumerate(("kernel", "base")):
                if getattr(r, f"{s}_rank") > 0:
                    out.append(pd.DataFrame({"b": r.b, "side": side, "rank": getattr(r, f"{s}_rank"), "v": pairs[s].to_numpy(), "c": c})[c > 0])
        return pd.concat(out) if out else pd.DataFrame({"b": [], "side": [], "rank": [], "v": [], "c": []})

    return run


def bootstrap_ratio(pairs: DataFrame, seed: int, resamples: int, grid: int | None = None) -> DataFrame:
    """AGG-15, AGG-16: point, lcb, ucb, verdict of the ratio of p95s (kernel / base, nearest rank) over resamples of the pairs.

    Each resample has as many pairs as there are, drawn with replacement, pairs staying
    together. Their numbers are multinomial, and are drawn down a tree: first over the cells
    of a grid (a block of kernel values by a block of base values), then, inside the one row
    and the one column of cells where the two ranks lie, over pairs. What the other cells hold
    does not change the percentiles and is not drawn. Draws depend on seed, resample and cell.

    Scale: the grid is at most 1024 by 1024 cells, held by the driver; a resample touches some
    2 / grid of the pairs. No pairs give no row; a pair with a null value is none.
    """
    pairs = pairs.filter("kernel is not null and base is not null")
    counted = pairs.groupBy(F.col("kernel").cast("double").alias("kernel"), F.col("base").cast("double").alias("base")).agg(F.count("*").alias("c"))
    parts = grid or max(GRID[0], min(GRID[1], int(pairs.count() ** 0.5 / 8)))
    held = stage(_blocks_of(_blocks_of(counted, "kernel", parts), "base", parts))
    by = ["kernel_block", "base_block"]
    cells = held.groupBy(*by).agg(F.sum("c").alias("c")).orderBy(*by).toPandas()  # grid squared at most
    if not len(cells):
        return pairs.sparkSession.createDataFrame([], "point double, lcb double, ucb double, verdict string")
    tasks = max(1, min(resamples, 64))
    asked = pairs.sparkSession.range(0, resamples, 1, tasks).mapInPandas(_draw_cells(cells, seed), "b long, kernel_block double, base_block double, x long, kernel_rank long, base_rank long")
    drawn = stage(asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(_draw_pairs(seed), "b long, side int, rank long, v double, c long"))
    values = drawn.groupBy("b", "side", "rank", "v").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("b", "side").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # one block's values
    at = values.withColumn("upto", upto).filter(F.col("upto") >= F.col("rank")).groupBy("b", "side").agg(F.min("v").alias("v"))
    ratio = (F.max(F.when(F.col("side") == 0, F.col("v"))) / F.max(F.when(F.col("side") == 1, F.col("v")))).alias("ratio")
    spread = at.groupBy("b").agg(ratio).agg(nearest_rank("ratio", 0.05, "lcb"), nearest_rank("ratio", 0.95, "ucb"))  # a row a resample
    p95 = lambda side: percentiles(pairs, [], side, {side: 0.95})
    point = p95("kernel").crossJoin(F.broadcast(p95("base"))).select((F.col("kernel") / F.col("base")).alias("point"))  # one row each
    verdict = F.when(F.col("ucb") <= 1.25, "PASS").when(F.col("lcb") > 1.25, "FAIL").otherwise("INCONCLUSIVE")
    return point.crossJoin(F.broadcast(spread)).select(*[F.round(c, 6).alias(c) for c in ("point", "lcb", "ucb")], verdict.alias("verdict"))  # one row each


@REG.add("agg_bootstrap_ratio")
def agg_bootstrap_ratio(spark, sf_dir):
    """Without SQL, which has no multinomial draws: tests hold it to draws of all pairs."""
    return bootstrap_ratio(stage(paired_by_rank(spark, sf_dir)), 7, 100)


@REG.add("agg_memory_verdict", """
SELECT o_orderstatus, CASE WHEN a_max > 500000 OR a_growth > 1.3 * c_growth THEN 'FAIL' WHEN c_growth > 3 THEN 'INCONCLUSIVE' ELSE 'PASS' END AS verdict, a_max, round(a_growth, 6) AS growth FROM (
 SELECT o_orderstatus, max(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS a_max, avg(o_totalprice) FILTER (WHERE o_orderkey % 4 = 2) / avg(o_totalprice) FILTER (WHERE o_orderkey % 4 = 0) AS a_growth,
  avg(o_totalprice) FILTER (WHERE o_orderkey % 4 = 3) / avg(o_totalprice) FILTER (WHERE o_orderkey % 4 = 1) AS c_growth FROM orders GROUP BY 1)""")
def agg_memory_verdict(spark, sf_dir):
    """AGG-17, AGG-21: cap and growth against a control arm; a control without a base is refused."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    part = lambda r: F.avg(F.when(k % 4 == r, v))
    t = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.max(F.when(k % 2 == 0, v)).alias("a_max"), (part(2) / part(0)).alias("a"), (part(3) / part(1)).alias("c"))
    verdict = F.when(F.col("c").isNull(), F.raise_error(F.lit("no control"))).when((F.col("a_max") > 500000) | (F.col("a") > 1.3 * F.col("c")), "FAIL").when(F.col("c") > 3, "INCONCLUSIVE").otherwise("PASS")
    return t.select("o_orderstatus", verdict.alias("verdict"), "a_max", F.round("a", 6).alias("growth"))


@REG.add("agg_drift", with_sql("""
SELECT session, quantile_disc(value, 0.5) FILTER (WHERE r <= n // 2) AS first_p50, quantile_disc(value, 0.5) FILTER (WHERE r > n - n // 2) AS last_p50 FROM (
 SELECT session, value, row_number() OVER (PARTITION BY session ORDER BY seq) AS r, count(*) OVER (PARTITION BY session) AS n FROM l) WHERE n > 1 GROUP BY session""", l=LOG_SQL))
def agg_drift(spark, sf_dir):
    """AGG-18: medians of the first and last half of each session, the middle one left out on odd counts."""
    rows = log(spark, sf_dir).select("session", "seq", "value")
    n = rows.groupBy("session").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = scanned(rows, ["session"], ["seq"], {"r": Running("count")}).join(n, "session")
    half = F.floor(F.col("n") / 2)
    side = F.when(F.col("r") <= half, "first").when(F.col("r") > F.col("n") - half, "last")
    halves = ranked.select("session", side.alias("side"), "value").filter("side is not null")
    middle = percentiles(halves, ["session", "side"], "value", {"p50": 0.5})
    return middle.groupBy("session").agg(*[F.max(F.when(F.col("side") == s, F.col("p50"))).alias(f"{s}_p50") for s in ("first", "last")])


@REG.add("agg_sequence_parity", with_sql(f"""
SELECT session, count_if(kind <> other) = 0 AS same, min(r) FILTER (WHERE kind <> other) AS first_other, {summed_digest_sql(row_text_sql("r", "kind"))} AS trace FROM (
  SELECT a.session, a.r, a.kind, b.kind AS other FROM (SELECT session, kind, row_number() OVER (PARTITION BY session ORDER BY seq) AS r FROM l) a
  JOIN (SELECT session, kind, row_number() OVER (PARTITION BY session ORDER BY ts_ms, seq) AS r FROM l) b ON a.session = b.session AND a.r = b.r) GROUP BY session""", l=LOG_SQL))
def agg_sequence_parity(spark, sf_dir):
    """AGG-19: the trace by sequence against the trace by time, place by place; traces are compared as joined rows and digested as sums."""
    rows = log(spark, sf_dir)
    placed = lambda *c: scanned(rows.select("session", "kind", "seq", "ts_ms"), ["session"], [*c], {"r": Running("count")})
    a, b = placed("seq").select("session", "kind", "r"), placed("ts_ms", "seq").select("session", F.col("kind").alias("other"), "r")
    return sequence_parity(a, b, "session")


def sequence_parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, same, first_other (the first place that differs), trace (digest of a). a has key, r, kind; b key, r, other."""
    both = a.join(b, [key, "r"], "full_outer")
    differs = ~F.col("kind").eqNullSafe(F.col("other"))
    return both.groupBy(key).agg((F.count_if(differs) == 0).alias("same"), F.min(F.when(differs, F.col("r"))).cast("long").alias("first_other"), summed_digest(row_text("r", "kind")).alias("trace"))


@REG.add("agg_profile_by_leg", with_sql("""
SELECT session, leg, n, starts, runs, high, (leg = 0 AND starts = 0) OR (leg > 0 AND starts = 1) AS one_start, starts = runs AS spawns_match FROM (
 SELECT session, leg, count(*) AS n, count_if(kind = 'signup')::BIGINT AS starts, count_if(kind = 'purchase')::BIGINT AS runs, max(coalesce(k, 0)) AS high FROM (
  SELECT *, sum((kind = 'signup')::INT) OVER (PARTITION BY session ORDER BY seq)::BIGINT AS leg FROM l) GROUP BY ALL)""", l=LOG_SQL))
def agg_profile_by_leg(spark, sf_dir):
    """AGG-20: records split at restarts; does each leg have exactly one start (none before the first), and as many runs as starts."""
    rows = scanned(log(spark, sf_dir).select("session", "seq", "kind", "k"), ["session"], ["seq"], {"leg": Running("sum", (F.col("kind") == "signup").cast("long"))})
    t = rows.groupBy("session", "leg").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "signup").alias("starts"), F.count_if(F.col("kind") == "purchase").alias("runs"), F.max(F.coalesce("k", F.lit(0).cast("long"))).alias("high"))
    return t.withColumns({"one_start": F.col("starts") == F.when(F.col("leg") == 0, 0).otherwise(1), "spawns_match": F.col("starts") == F.col("runs")})


@REG.add("agg_exactly_one", with_sql("SELECT session, ts_ms // 86400000 AS day, count(*) AS n FROM l WHERE kind = 'signup' GROUP BY ALL HAVING count(*) <> 1", l=LOG_SQL))
def agg_exactly_one(spark, sf_dir):
    """AGG-23: windows that do not have exactly one start."""
    rows = log(spark, sf_dir).filter("kind = 'signup'").groupBy("session", F.floor(F.col("ts_ms") / 86400000).alias("day")).agg(F.count("*").alias("n"))
    return rows.filter("n <> 1")


@REG.add("agg_stage_decomposition", with_sql("""
SELECT request, wall, parts, greatest(0, wall - parts) AS residual FROM (
 SELECT r.seq AS request, r.k * 10 AS wall, coalesce(sum(d.k), 0)::BIGINT AS parts FROM l r LEFT JOIN (
  SELECT d.session, d.k, (SELECT min(seq) FROM l s WHERE s.kind = 'purchase' AND s.session = d.session AND s.seq > d.seq) AS request FROM l d WHERE d.kind = 'view') d ON d.request = r.seq WHERE r.kind = 'purchase' GROUP BY ALL)""", l=LOG_SQL))
def agg_stage_decomposition(spark, sf_dir):
    """AGG-22, JOI-10: a request's wall time less the parts bound to it, zero at least."""
    rows = log(spark, sf_dir)
    reqs = rows.filter("kind = 'purchase'")
    bound = as_of(rows.filter("kind = 'view'").select("session", "seq", "k"), reqs.select("session", F.col("seq").alias("at"), F.col("seq").alias("request")), ["session"], "seq", "at", ["request"], forward=True, strict=True)
    parts = bound.filter("request is not null").groupBy("request").agg(F.sum("k").alias("parts"))
    out = reqs.select(F.col("seq").alias("request"), (F.col("k") * 10).alias("wall")).join(parts, "request", "left").fillna(0, ["parts"])
    return out.select("request", "wall", "parts", F.greatest(F.lit(0).cast("long"), F.col("wall") - F.col("parts")).alias("residual"))


@REG.add("agg_arm_cost", with_sql("""
SELECT session, round(a, 4) AS a, round(b, 4) AS b, CASE WHEN b = 0 THEN -1.0 ELSE round(a / b, 6) END AS ratio, coalesce(a > 1.25 * b, false) AS over FROM (
 SELECT session, coalesce(sum(value) FILTER (WHERE kind = 'click'), 0) AS a, coalesce(sum(value) FILTER (WHERE kind = 'view'), 0) AS b FROM l GROUP BY session)""", l=LOG_SQL))
def agg_arm_cost(spark, sf_dir):
    return arm_costs(log(spark, sf_dir))


def arm_costs(rows: DataFrame) -> DataFrame:
    """AGG-24: cost of two arms, their ratio (-1 on a zero base), and a threshold flag.

    What the order of a sum of doubles leaves in its last places is rounded off before sums are
    divided or compared, so that a ratio on the edge of a place does not turn on the order.
    """
    arm = lambda kind: F.round(F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)), 9)
    t = rows.groupBy("session").agg(arm("click").alias("a"), arm("view").alias("b"))
    ratio = F.round(F.round(F.try_divide("a", "b"), 12), 6)
    return t.select("session", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.coalesce(ratio, F.lit(-1.0)).alias("ratio"), (F.col("a") > F.round(1.25 * F.col("b"), 9)).alias("over"))


@REG.add("agg_session_metrics", with_sql("""
SELECT session, sum(k)::BIGINT AS tokens, count_if(kind = 'click')::BIGINT AS calls, last(kind ORDER BY seq) AS terminal, count_if(kind = 'error' AND later)::BIGINT AS retries FROM (
 SELECT *, coalesce(max((kind IN ('purchase', 'signup'))::INT) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS later FROM l) GROUP BY session""", l=LOG_SQL))
def agg_session_metrics(spark, sf_dir):
    """AGG-25, WIN-14: a retry is a failed check followed by any later mutation. The last mutation of a session decides, so no window is needed."""
    rows = log(spark, sf_dir)
    last = rows.groupBy("session").agg(F.max(F.when(F.col("kind").isin(*MUTATING), F.col("seq"))).alias("last"))
    out = rows.join(last, "session")
    return out.groupBy("session").agg(F.sum("k").alias("tokens"), F.count_if(F.col("kind") == "click").alias("calls"), F.max_by("kind", "seq").alias("terminal"), F.count_if((F.col("kind") == "error") & (F.col("seq") < F.col("last"))).alias("retries"))


@REG.add("win_repeat_edits", with_sql("SELECT session, count(*) - count(DISTINCT k) AS repeats FROM l GROUP BY session", l=LOG_SQL))
def win_repeat_edits(spark, sf_dir):
    """WIN-14: edits of an already edited path."""
    return log(spark, sf_dir).groupBy("session").agg((F.count("*") - F.countDistinct("k")).alias("repeats"))


@REG.add("win_balanced_schedule", """
SELECT c_custkey, CASE WHEN r % 2 = 0 THEN 'kernel' ELSE 'base' END AS first_arm FROM (
 SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('5:' || c_custkey), c_custkey) AS r FROM customer)""")
def win_balanced_schedule(spark, sf_dir, seed: int = 5):
    """WIN-12: a seeded balanced order of arms within each block (nation)."""
    w = Window.partitionBy("c_nationkey").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "c_custkey")), "c_custkey")
    return read(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).select("c_custkey", F.when(F.col("r") % 2 == 0, "kernel").otherwise("base").alias("first_arm"))


@REG.add("agg_task_rollup", """SELECT coalesce(l_returnflag, 'all') AS task, coalesce(l_linestatus, 'all') AS config, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def agg_task_rollup(spark, sf_dir):
    """Per-task and suite totals in one report."""
    t = read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return t.select(F.coalesce("l_returnflag", F.lit("all")).alias("task"), F.coalesce("l_linestatus", F.lit("all")).alias("config"), "n", "quantity")


@REG.add("prj_rerun_eligible", with_sql("SELECT seq FROM l WHERE kind IN ('error', 'view') AND value < 10 AND k IS NOT NULL AND seq NOT IN (SELECT seq + 1 FROM l WHERE kind = 'error')", l=LOG_SQL))
def prj_rerun_eligible(spark, sf_dir):
    """PRJ-19: retryable class, little cost, no rerun before."""
    rows = log(spark, sf_dir)
    prior = rows.filter("kind = 'error'").select((F.col("seq") + 1).alias("seq"))
    return rows.filter("kind in ('error', 'view') and value < 10 and k is not null").join(prior, "seq", "left_anti").select("seq")


@REG.add("prj_session_operations", with_sql("SELECT seq, kind, k, row_number() OVER (ORDER BY ts_ms, seq) AS place FROM l WHERE session = 3", l=LOG_SQL))
def prj_session_operations(spark, sf_dir):
    """PRJ-18: one transaction's operations by time."""
    return log(spark, sf_dir).filter("session = 3").select("seq", "kind", "k", F.row_number().over(Window.partitionBy("session").orderBy("ts_ms", "seq")).cast("long").alias("place"))


@REG.add("prj_operation_lookup", with_sql("""SELECT 'id' AS asked_by, seq, session, kind, k FROM l WHERE seq IN (17, 99999999) UNION ALL SELECT 'generation', seq, session, kind, k FROM l WHERE ts_ms // 86400000 = (SELECT min(ts_ms) // 86400000 + 2 FROM l)""", l=LOG_SQL))
def prj_operation_lookup(spark, sf_dir):
    """PRJ-18: an operation by its id (an unknown id gives no row), and those of one generation (here a day)."""
    rows = log(spark, sf_dir)
    day = rows.agg(F.floor(F.min("ts_ms") / 86400000)).first()[0] + 2
    cols = ["seq", "session", "kind", "k"]
    by_id = rows.filter(F.col("seq").isin(17, 99999999)).select(F.lit("id").alias("asked_by"), *cols)
    return by_id.union(rows.filter(F.floor(F.col("ts_ms") / 86400000) == day).select(F.lit("generation"), *cols))


QUERIES, SQL = REG.queries, REG.sql
