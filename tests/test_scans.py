"""Segmented scans, percentiles and bootstraps against plain Python, with a hot key and outliers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.operators import audit, stats
from coppice.plans.joins import as_of
from coppice.plans.scans import Running, blocked, scanned


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows have one key, and some have none."""
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), i, rnd.choice([None, rnd.randrange(50)]), rnd.choice("abc")) for i in range(400)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "key int, at long, v long, c string").repartition(4).cache()


@pytest.mark.parametrize("block_rows", [9, 64, 1_000_000])
@pytest.mark.parametrize("keys", [["key"], []])
def test_scan(hot, keys, block_rows):
    wanted, want = {}, {}
    for backward in (False, True):
        for strict in (False, True):
            w = Window.partitionBy(*keys).orderBy("at")
            w = w.rowsBetween(1 if strict else 0, Window.unboundedFollowing) if backward else w.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
            end = f"{backward}{strict}".lower()
            wanted |= {f"n{end}": Running("count", None, strict, backward), f"s{end}": Running("sum", F.col("v"), strict, backward), f"m{end}": Running("max", F.col("v"), strict, backward), f"l{end}": Running("last", F.col("v"), strict, backward)}
            want |= {f"n{end}": F.count(F.lit(1)).over(w), f"s{end}": F.sum("v").over(w), f"m{end}": F.max("v").over(w), f"l{end}": (F.first if backward else F.last)("v", True).over(w)}
        wanted[f"g{backward}"] = Running("lag", F.col("v"), backward=backward)
        want[f"g{backward}"] = (F.lead if backward else F.lag)("v").over(Window.partitionBy(*keys).orderBy("at"))
    got = scanned(hot, keys, ["at"], wanted, block_rows).orderBy("at").collect()
    assert got == hot.withColumns(want).orderBy("at").select(*hot.columns, *wanted).collect()


def test_a_hot_key_is_spread(hot):
    made, parts = blocked(hot, ["at"], 40)
    sizes = [r["count"] for r in made.filter("key = 1").groupBy("_block").count().collect()]
    assert parts == 10 and len(sizes) >= 8 and max(sizes) <= 60


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, hot, forward, strict):
    right = hot.filter("at % 3 = 0").select("key", F.col("at").alias("r"))
    left = hot.filter("at % 2 = 0").select("key", "at")
    one, many = (sorted(as_of(left, right, ["key"], "at", "r", ["r"], forward, strict, block_rows=b).collect(), key=str) for b in (1_000_000, 30))
    assert one == many
    by = {}
    for r in right.collect():
        by.setdefault(r["key"], []).append(r["r"])
    for key, at, got in one:
        side = [x for x in by.get(key, []) if (x > at if strict else x >= at) if forward] or [x for x in by.get(key, []) if not forward and (x < at if strict else x <= at)]
        assert got == (min(side) if forward else max(side)) if side else got is None


def test_numbers_and_tokens(hot):
    got = audit.numbered(hot, ["c", "at"], 10, block_rows=25).select("c", "at", "number").collect()
    assert [r["number"] for r in sorted(got, key=lambda r: (r["c"], r["at"]))] == list(range(11, 411))
    plain, parts = (audit.fence_tokens(hot, "key", "at", "v", b).orderBy("at").collect() for b in (1_000_000, 30))
    assert plain == parts


def test_percentiles_with_an_outlier(spark):
    """One value far from the others does not put them in one block, and all shares are exact."""
    rnd = random.Random(6)
    values = [(rnd.choice("aab"), float(rnd.randrange(10_000))) for _ in range(5000)] + [("a", 1e15), ("b", None), ("c", None)]
    rows = spark.createDataFrame(values, "g string, v double").repartition(4)
    shares = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for interpolated in (False, True):
        for block_rows in (100, 1_000_000):
            got = {r["g"]: r for r in stats.percentiles(rows, ["g"], "v", shares, interpolated, block_rows).collect()}
            assert set(got) == {"a", "b"}
            for g, r in got.items():
                mine = sorted(v for k, v in values if k == g and v is not None)
                for name, p in shares.items():
                    assert r[name] == pytest.approx(np.quantile(mine, p) if interpolated else mine[max(0, int(np.ceil(len(mine) * p)) - 1)])
    distinct = rows.filter("v is not null").select("v").distinct()
    made, parts = blocked(distinct, ["v"], 100)
    assert parts > 30 and max(r["count"] for r in made.groupBy("_block").count().collect()) < 300


def plain_bootstrap(pairs, seed, resamples, kernel_block, base_block):
    """The same draws, of all cells and all their pairs, and percentiles over all of them."""
    n, want = len(pairs), int(np.ceil(len(pairs) * 95 / 100))
    cells = {}
    for p in pairs:
        cells.setdefault((kernel_block(p[0]), base_block(p[1])), []).append(p)
    names = sorted(cells)
    ratios = []
    for b in range(resamples):
        x = np.random.default_rng([seed, b]).multinomial(n, np.array([len(cells[c]) for c in names]) / n)
        drawn = []
        for c, count in zip(names, x, strict=True):
            distinct = sorted(set(cells[c]))
            share = np.array([cells[c].count(p) for p in distinct]) / len(cells[c])
            for p, k in zip(distinct, np.random.default_rng([seed, b, *c]).multinomial(count, share), strict=True):
                drawn += [p] * k
        assert len(drawn) == n  # each resample is as large as the sample
        ratios.append(sorted(p[0] for p in drawn)[want - 1] / sorted(p[1] for p in drawn)[want - 1])
    ratios.sort()
    rank = lambda p: ratios[max(0, int(np.ceil(p * resamples)) - 1)]
    return rank(0.05), rank(0.95)


@pytest.mark.parametrize("grid", [1, 4, 12])
def test_bootstrap(spark, grid):
    """Only the blocks that hold the ranks are drawn, and the result is that of drawing everything."""
    rnd = random.Random(9)
    pairs = [(b * rnd.uniform(0.9, 1.6), b) for b in (round(rnd.lognormvariate(3, 1), 1) for _ in range(300))]
    pairs = [(round(k, 1), b) for k, b in pairs]
    frame = spark.createDataFrame(pairs, "kernel double, base double").repartition(3)
    counted = frame.groupBy("kernel", "base").count()
    cuts = {s: sorted(set(counted.approxQuantile(s, [i / grid for i in range(1, grid)], 0.25 / grid))) if grid > 1 else [] for s in ("kernel", "base")}
    block = {s: (lambda v, c=c: int(np.searchsorted(c, v, "right"))) for s, c in cuts.items()}
    lcb, ucb = plain_bootstrap(pairs, 7, 40, block["kernel"], block["base"])
    got = stats.bootstrap_ratio(frame, 7, 40, grid=grid).first()
    at = int(np.ceil(300 * 0.95)) - 1
    assert got["point"] == pytest.approx(sorted(p[0] for p in pairs)[at] / sorted(p[1] for p in pairs)[at], abs=1e-6)
    assert (got["lcb"], got["ucb"]) == (pytest.approx(lcb, abs=1e-6), pytest.approx(ucb, abs=1e-6))
    assert got["lcb"] <= got["point"] <= got["ucb"]


def test_bootstrap_of_nothing(spark):
    assert stats.bootstrap_ratio(spark.createDataFrame([], "kernel double, base double"), 7, 10).collect() == []
