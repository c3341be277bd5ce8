"""Search over pivots gives what scoring everything gives."""

import numpy as np

from coppice.operators.pivots import PivotIndex

ROW, ASKED = "vec_id long, embedding array<double>", "query_id long, q array<double>"


def plain(rows, asked, k):
    out = []
    for q, v in asked:
        best = sorted((float(np.linalg.norm(np.array(w) - np.array(v))), i) for i, w in rows)[:k]
        out += [(q, i, r + 1) for r, (_, i) in enumerate(best)]
    return sorted(out)


def got(index, spark, asked, k):
    return sorted((r["query_id"], r["id"], r["rank"]) for r in index.search(spark.createDataFrame(asked, ASKED), k).collect())


def test_as_in_scoring_everything(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.integers(-40, 40, (6, 8))
    rows = [(i, (centres[i % 6 if i % 3 else 0] + rnd.integers(-2, 3, 8)).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(7)]  # ties
    bad = [(900, None), (901, [1.0]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [None] * 8)]
    index = PivotIndex(spark.createDataFrame(rows + bad, ROW), pivots=8, rings=4)
    asked = [(i, rows[i][1]) for i in (0, 5, 7, 100)] + [(1000, [90.0] * 8)]
    assert got(index, spark, asked, 5) == plain(rows, asked, 5)
    assert index.share(spark.createDataFrame(asked, ASKED), 5) < 0.5


def test_fewer_rows_than_asked_for(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    assert got(PivotIndex(spark.createDataFrame(rows, ROW)), spark, [(1, [1.0, 0.0])], 9) == plain(rows, [(1, [1.0, 0.0])], 9)
    assert got(PivotIndex(spark.createDataFrame([], ROW)), spark, [(1, [1.0, 0.0])], 9) == []


def test_queries_meet_rows_as_matrices_and_ties_are_exact(spark, monkeypatch):
    """Few plans whatever the number of queries; equal and nearly equal distances far from the origin, more rows than are looked at together, ids that are texts."""
    from coppice.operators import pivots

    monkeypatch.setattr(pivots, "PAIRS", 300)
    monkeypatch.setattr(pivots, "EXACT_PAIRS", 70)
    rnd = np.random.default_rng(7)
    base = rnd.integers(0, 3, (40, 4)).astype(float) + 1e7
    rows = [(i, (base[i % 40] + (1e-9 if i % 5 == 0 else 0.0)).tolist()) for i in range(900)]
    asked = [(i, rows[i][1]) for i in range(0, 900, 9)] + [(-1, None), (-2, [1.0]), (-3, [float("nan")] * 4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    want = sorted((q, i, r + 1) for q, v in asked[:-3] for r, (_, i) in enumerate(sorted((dist(w, v), i) for i, w in rows)[:7]))
    index, staged = PivotIndex(spark.createDataFrame(rows, ROW), pivots=4, rings=3), []
    stage = pivots.stage
    monkeypatch.setattr(pivots, "stage", lambda d: staged.append(1) or stage(d))
    assert got(index, spark, asked, 7) == want and len(staged) == 2
    monkeypatch.setattr(pivots, "ROUND_BYTES", 30 * 8 * (4 + 4 * 12 + 4 * 7))  # rounds of some thirty queries
    assert got(index, spark, asked, 7) == want and len(staged) > 5
    text = PivotIndex(spark.createDataFrame([(f"{i:04}", v) for i, v in rows], "vec_id string, embedding array<double>"), pivots=4, rings=3)
    found = text.search(spark.createDataFrame(asked, ASKED), 7).collect()
    assert sorted((r["query_id"], int(r["id"]), r["rank"]) for r in found) == want
