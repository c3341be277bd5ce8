"""Exact nearest neighbours by L2 over an index of pivots: what the triangle inequality rules out is not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.operators.vectors import RAW
from coppice.plans.staging import folder, ship_package, shuffles_dropped, stage
from coppice.registration import Registry
from coppice.sources.adapters import read

REG = Registry()

#: Pivots are chosen among so many rows, those of the least hash of their ids.
SAMPLE = 1000


def _far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors (fewer, if fewer differ), each the farthest from those before it."""
    picked = [0]
    gap = np.linalg.norm(vectors - vectors[0], axis=1)
    while len(picked) < n and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(vectors - vectors[picked[-1]], axis=1))
    return vectors[picked]


class PivotIndex:
    """SRT-2, VEC-4, SRT-4: rows in blocks, by their nearest pivot and by rings of distance to it.

    A query q at distance dq from a pivot is at least dq - hi and lo - dq away from any row of a
    block whose distances to the pivot are lo to hi. So blocks whose bound is beyond the k-th
    best are not read. The rows of the others are held against all their queries at once, as a
    product of matrices; that is off by a known bound at most, and what it leaves a chance is
    scored exactly. Answers are those of scoring everything, ties to the smaller id; how much is
    saved depends on how the rows cluster.

    The driver holds the pivots, a line for each block (pivots * rings), and the queries of a
    round (ROUND_BYTES). Rows whose vector is null, has another length than the pivots, or holds
    null or non-finite parts, take no part; neither do queries that are null, of another length
    or hold nulls or NaN.
    """

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 16, rings: int = 8):
        self.spark, self.rings = rows.sparkSession, rings
        ship_package(self.spark)
        finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        vectors = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.col("v").isNotNull() & finite & F.col("id").isNotNull())
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        self.width = width = len(sample[0]["v"]) if sample else 0
        self.pivots = picked = _far_apart(np.array([r["v"] for r in sample if len(r["v"]) == width], dtype=float), pivots) if sample else np.zeros((0, 0))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column(1), width)
                away = np.stack([_distance(v, p) for p in picked], axis=1)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away[np.arange(len(v)), cell]), pa.array(cell.astype(np.int32))], ["id", "v", "d", "cell"])

        kinds = dict(vectors.dtypes)
        away = vectors.filter(F.size("v") == width).mapInArrow(near, f"id {kinds['id']}, v {kinds['v']}, d double, cell int")
        cuts = away.groupBy("cell").agg(F.percentile_approx("d", [i / rings for i in range(1, rings)], 1000).alias("cuts"))  # a row a pivot
        ring = F.aggregate("cuts", F.lit(0), lambda n, c: n + (F.col("d") > c).cast("int"))
        path = folder(self.spark, "pivots")
        out = away.join(F.broadcast(cuts), "cell").select("id", "v", "d", (F.col("cell") * rings + ring).alias("block"))
        with shuffles_dropped(self.spark):
            out.hint("rebalance", F.col("block")).write.partitionBy("block").parquet(path)
        self.rows = self.spark.read.schema(out.schema).parquet(path)
        lines = self.rows.groupBy("block").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).orderBy("block").collect()  # pivots * rings
        self.blocks = np.array([r["block"] for r in lines], dtype=int)
        self.n, self.lo, self.hi = (np.array([r[c] for r in lines], dtype=float) for c in ("n", "lo", "hi"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, id, raw and distance (rounded to 6 places), as vectors.nearest gives them. queries (query_id, q), a stated set with an id each."""
        out = None
        for asked in self._rounds(queries, k):
            found, _ = self._search(asked, k)
            out = found if out is None else out.unionByName(found)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("raw", "id"))
        return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "id", "raw", F.round("raw", 6).alias("distance"), "rank")

    def share(self, queries: DataFrame, k: int) -> float:
        """Rows held against queries in a search, as a share of queries times rows."""
        held, every = 0.0, queries.count() * float(self.n.sum())
        for asked in self._rounds(queries, k):
            held += self._search(asked, k)[1]
        return held / every if every else 0.0

    def _rounds(self, queries: DataFrame, k: int) -> Iterator[DataFrame]:
        """The queries in rounds; what a round holds at once is some ROUND_BYTES, in the driver and in a task."""
        asked = stage(queries.select("query_id", "q"))
        most = max(1, ROUND_BYTES // (8 * (self.width + 4 * len(self.blocks) + 4 * k)))
        rounds = max(1, -(-asked.count() // most))
        for i in range(rounds):
            yield asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i) if rounds > 1 else asked

    def _search(self, asked: DataFrame, k: int) -> tuple[DataFrame, float]:
        """query_id, id, raw of at least the k nearest of each query, and the number of pairs that were held against each other."""
        kind = asked.schema["query_id"].dataType.simpleString()
        held = [r for r in asked.collect() if r["q"] is not None and len(r["q"]) == self.width and not any(x is None or x != x for x in r["q"])]  # a round
        q = np.array([r["q"] for r in held], dtype=float).reshape(len(held), self.width)
        names = self.spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(held)], f"place int, query_id {kind}")
        may, low, tau = self._bounds(q, k)
        order = np.argsort(np.where(may, low, np.inf), axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(np.where(may, self.n, 0), order, axis=1), axis=1)
        first = np.zeros_like(may)
        np.put_along_axis(first, order, np.concatenate([np.zeros((len(q), 1)), before[:, :-1]], axis=1) < k if before.size else first, axis=1)
        first &= may
        one = stage(self._scored(q, first, tau, k))
        kth = one.select("place", "raw", F.row_number().over(Window.partitionBy("place").orderBy("raw")).alias("n")).filter(F.col("n") == k).collect()  # a number a query
        for r in kth:
            tau[r["place"]] = min(tau[r["place"]], r["raw"])
        rest = may & ~first & self._within(low, tau, q)
        scored = one.unionByName(self._scored(q, rest, tau, k))
        return scored.join(F.broadcast(names), "place").select("query_id", "id", "raw"), float(((first | rest) * self.n).sum())

    def _bounds(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By query and block, whether the block may hold one of the k nearest, and how near its rows are at best; by query, how far the k-th is at most."""
        with np.errstate(invalid="ignore", over="ignore"):
            away = np.stack([_distance(q, p) for p in self.pivots], axis=1) if len(self.pivots) else np.zeros((len(q), 0))
            mine = away[:, self.blocks // self.rings]
            low = np.maximum(0.0, np.maximum(mine - self.hi, self.lo - mine))
            top = mine + self.hi
            order = np.argsort(top, axis=1, kind="stable")
            enough = np.cumsum(self.n[order], axis=1) >= k
            tops = np.where(enough, np.take_along_axis(top, order, axis=1), np.inf)
            tau = tops.min(axis=1, initial=np.inf)
            return self._within(low, tau, q), low, tau

    def _within(self, low: np.ndarray, tau: np.ndarray, q: np.ndarray) -> np.ndarray:
        """At most tau, with room for the rounding of distances to pivots."""
        size = 1 + np.sqrt((q * q).sum(axis=1)) + (np.abs(self.pivots).max() * np.sqrt(self.width) if self.pivots.size else 0.0) + self.hi.max(initial=0.0)
        return ~(low > (tau * (1 + 1e-9) + 1e-12 * size)[:, None])

    def _scored(self, q: np.ndarray, pairs: np.ndarray, tau: np.ndarray, k: int) -> DataFrame:
        """place, id, raw: from each task the k nearest rows at most for each query, of the blocks that are paired with it and not beyond tau."""
        kind, width = self.rows.schema["id"].dataType.simpleString(), self.width
        wanted = pairs.any(axis=0)
        given = self.spark.sparkContext.broadcast((q, {int(b): np.flatnonzero(pairs[:, i]) for i, b in enumerate(self.blocks) if wanted[i]}, tau))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, queries_of, tau = given.value
            best = _Best(q, tau.copy(), k)
            for batch in batches:
                ids, blocks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                v = _matrix(batch.column(1), width)
                for b in np.unique(blocks):
                    rows = np.flatnonzero(blocks == b)
                    mine = queries_of[int(b)]
                    step = max(1, PAIRS // len(mine))
                    for at in range(0, len(rows), step):
                        some = rows[at : at + step]
                        best.add(v[some], ids[some], mine)
            place, ids, raw = best.all()
            for at in range(0, len(place), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(place[part].astype(np.int32)), pa.array(ids[part]), pa.array(raw[part])], ["place", "id", "raw"])

        found = self.rows.filter(F.col("block").isin([int(b) for b in self.blocks[wanted]])) if wanted.any() else self.rows.limit(0)
        return found.select("id", "v", "block").mapInArrow(run, f"place int, id {kind}, raw double")


#: Bytes that the queries of a round take in all, and pairs of a row and a query that are looked at together.
ROUND_BYTES, PAIRS = 128 << 20, 2_000_000

#: Pairs that are scored exactly together.
EXACT_PAIRS = 50_000


class _Best:
    """The k nearest rows so far of each query, ties to the smaller id."""

    def __init__(self, q: np.ndarray, most: np.ndarray, k: int):
        """most: by query, a distance beyond which nothing is wanted."""
        self.q, self.most, self.k = q, most, k
        self.qq = np.einsum("ij,ij->i", q, q)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.sorted, self.new = 0, 0

    def add(self, v: np.ndarray, ids: np.ndarray, mine: np.ndarray) -> None:
        """Rows that may be near the queries mine."""
        with np.errstate(invalid="ignore", over="ignore"):
            q, qq, vv = self.q[mine], self.qq[mine], np.einsum("ij,ij->i", v, v)
            eps = (q.shape[1] + 8) * np.finfo(float).eps
            slack = 8 * eps * (qq + vv.max(initial=0.0))  # more than either way of summing is off
            gap = v @ q.T
            gap *= -2.0
            gap += vv[:, None]
            gap += qq
            limit = self.most[mine] ** 2 * (1 + 8 * eps) + slack
            near = ~(gap > limit)  # what is no number has a chance
            if len(v) > self.k and near.sum() > 4 * self.k * len(mine):
                kth = np.partition(gap, self.k - 1, axis=0)[self.k - 1]
                near &= ~(gap > np.abs(kth) * (1 + 8 * eps) + 4 * slack)
            rows, cols = np.nonzero(near)
            for at in range(0, len(rows), EXACT_PAIRS):
                r, c = rows[at : at + EXACT_PAIRS], cols[at : at + EXACT_PAIRS]
                raw, place = _distance(v[r], q[c]), mine[c]
                keep = ~(raw > self.most[place])
                self.kept.append((place[keep], ids[r[keep]], raw[keep]))
                self.new += int(keep.sum())
                if self.new > max(4 * EXACT_PAIRS, self.sorted):
                    self._cut()

    def _cut(self) -> None:
        if not self.new:
            return
        place, ids, raw = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        by_id = ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((by_id, raw, place))
        place, ids, raw = place[order], ids[order], raw[order]
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        nth = np.arange(len(place)) - np.repeat(start, np.diff(np.append(start, len(place))))
        last = nth == self.k - 1
        self.most[place[last]] = np.minimum(self.most[place[last]], raw[last])
        keep = nth < self.k
        self.kept = [(place[keep], ids[keep], raw[keep])]
        self.sorted, self.new = int(keep.sum()), 0

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        return self.kept[0] if self.kept else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As l2_distance: squares are added up in the order of the parts."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = a[:, j] - b[..., j]
        out += gap * gap
    return np.sqrt(out)


@REG.add("vec_pruned_search", f"""
SELECT query_id, id, round(raw, 6) AS distance, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {RAW} AS raw, row_number() OVER (PARTITION BY q.vec_id ORDER BY {RAW}, v.vec_id) AS rank
FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def vec_pruned_search(spark, sf_dir, k: int = 10):
    """SRT-2, VEC-4: for every hundredth vector, the nearest of all."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return PivotIndex(rows).search(asked, k).drop("raw")


QUERIES, SQL = REG.queries, REG.sql
