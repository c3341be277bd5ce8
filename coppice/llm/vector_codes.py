"""Vector code compression: codebooks by part of the vector, each part's nearest entry by equal-average search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import maybe_broadcast, rows_of, ship, stage, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Below this size of a component, squared distances of a part fit 64 bits; wider ones are Python integers.
NARROW = 1 << 24


def whole(vectors: list[list[float]], scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of all components, a row a vector: 64-bit integers where they are small, else Python integers."""
    x = np.array(vectors, np.float64)
    y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < NARROW:
        return y.astype(np.int64)
    exact = lambda v: int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale)
    return np.array([[exact(float(v)) for v in row] for row in x], object)


class Book:
    """The entries of one part of the vectors, sorted by the sum of their components."""

    def __init__(self, entries: np.ndarray) -> None:
        sums = entries.sum(1)
        self.place = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)))
        self.entries, self.sums = entries[self.place], sums[self.place]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row, ties to the lower index.

        A squared distance is at least the squared gap of the sums over the dimension. Each row
        looks outward from its own sum, to the side of the smaller gap, and stops when the bound
        of what is left is strictly more than its best.
        """
        n, most, dim = len(x), len(self.place), x.shape[1]
        sums = x.sum(1)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best, index = np.zeros(n, x.dtype), np.full(n, -1)
        rows = np.arange(n)
        while len(rows):
            lo, hi = left[rows], right[rows]
            below = sums[rows] - self.sums[np.maximum(lo, 0)]
            above = self.sums[np.minimum(hi, most - 1)] - sums[rows]
            down = (lo >= 0) & ((hi >= most) | (below <= above).astype(bool))
            gap = np.where(down, below, above)
            more = ((lo >= 0) | (hi < most)) & ((index[rows] < 0) | (gap * gap <= best[rows] * dim).astype(bool))
            rows, down, lo, hi = rows[more], down[more], lo[more], hi[more]
            at = np.where(down, lo, hi)
            diff = x[rows] - self.entries[at]
            far, place = (diff * diff).sum(1), self.place[at]
            better = (index[rows] < 0) | (far < best[rows]).astype(bool) | ((far == best[rows]).astype(bool) & (place < index[rows]))
            best[rows[better]], index[rows[better]] = far[better], place[better]
            left[rows[down]] -= 1
            right[rows[~down]] += 1
        return index, best


def _assign(books: list[np.ndarray], vectors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as integers; nearest entries and squared distances, a row a vector and a column a part."""
    x = whole(vectors)
    if x.dtype == object or books[0].dtype == object:
        x, books = x.astype(object), [b.astype(object) for b in books]
    found = [Book(b).nearest(p) for b, p in zip(books, np.split(x, len(books), 1), strict=True)]
    return x, np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def _totals(books: list[np.ndarray]):
    """Sums and counts of the parts that each entry is nearest to, in 32-bit limbs so that they add up in longs at any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = len(books[0]), books[0].shape[1]
        sums = np.zeros((len(books), k, dim + 1), object)
        for (vectors,) in rows_of(batches, 4096):
            x, index, _ = _assign(books, vectors)
            for p, part in enumerate(np.split(x, len(books), 1)):
                held = np.zeros((k, dim + 1), x.dtype)
                np.add.at(held, index[:, p], np.concatenate([part, np.ones((len(part), 1), x.dtype)], 1))
                sums[p] += held.astype(object)
        out = []
        for (p, e, place), v in np.ndenumerate(sums):
            limb = 0
            while v:
                low = v & 0xFFFFFFFF
                if -(1 << 31) <= v < 0:
                    low = v  # the sign stays in the last limb
                out.append((p, e, place, limb, int(low)))
                v, limb = (v - low) >> 32, limb + 1
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 4 + [pa.int64()], strict=True)], ["part", "entry", "place", "limb", "v"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                _, index, far = _assign(books, part.column(2).to_pylist())
                errors = [int(v) for v in far.sum(1)]
                codes = ["".join(f"{i:02x}" for i in row) for row in index]
                cols = [part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array([v if v < 1 << 63 else None for v in errors], pa.int64()), pa.array([str(v) for v in errors], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "code", "error", "exact_error"])

    return run


def _usable(v: Column, width: int | None, parts: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    size = F.size(v)
    return v.isNotNull() & (size == width if width else (size > 0) & (size % parts == 0)) & finite


def train(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> list[np.ndarray]:
    """The codebooks of vectors (vec_id, label, v): first the parts of the smallest ids, then rounds of assigning and averaging.

    The driver holds `entries` vectors and their sums; each round is one pass over the table.
    """
    first = [r.v for r in vectors.select("v").orderBy(F.asc_nulls_last(vectors["vec_id"]), "v").limit(entries).collect()]
    books = np.split(whole(first), parts, 1)
    for _ in range(rounds):
        totals = vectors.select("v").mapInArrow(_totals(books), "part int, entry int, place int, limb int, v long").groupBy("part", "entry", "place", "limb").agg(F.sum("v").alias("v"))
        dim = books[0].shape[1]
        sums = np.zeros((parts, len(first), dim + 1), object)
        for r in totals.collect():  # at most entries * (width + parts) numbers of a few limbs
            sums[r.part, r.entry, r.place] += r.v << (32 * r.limb)
        new = [np.array([[s // n for s in row[:-1]] if (n := row[-1]) else list(old) for row, old in zip(part, book, strict=True)], object) for part, book in zip(sums, books, strict=True)]
        small = all(abs(v) < NARROW for b in new for v in b.flat)
        books = [b.astype(np.int64) if small else b for b in new]
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 and exact_error for every vector that takes part.

    Vectors that are null or hold null or non-finite components take no part; nor do those whose
    length is not that of the vector with the smallest id among those of a positive multiple of
    `parts`. Components become floor(256 * x). Equal ids, null ids and repeated rows are rows
    like any other; null ids come last, and equal ones by vector, in the choice of the first
    entries. Fewer vectors than entries make smaller codebooks; none give no rows. Components of
    any finite size are exact; an error beyond a long is null in `error`, and in the
    `label_error` of its label, and whole in `exact_error` (decimal digits). Other columns are not read.

    Scale: each round is one pass without a shuffle of vectors; a task gives sums for each entry,
    added up by a partial aggregation. Errors are summed by label before they meet the rows; the sums are
    broadcast only where a count shows them to be few.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    head = rows.filter(_usable(F.col("v"), None, parts)).select(F.size("v").alias("n"), "vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).select("n").collect()
    kinds = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("label", rows.schema["label"].dataType), *T._parse_datatype_string("code string, error long, exact_error string")])
    if not head:
        out, digest = vectors.sparkSession.createDataFrame([], kinds), None
    else:
        rows = rows.filter(_usable(F.col("v"), head[0].n, parts))
        books = train(rows, entries, rounds, parts)
        digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.flat).encode()).hexdigest()
        out = stage(rows.mapInArrow(_codes(books), kinds))
    total = F.when(F.count("error") == F.count("exact_error"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = stage(out.groupBy(F.col("label").alias("its")).agg(total.try_cast("long").alias("label_error")))
    sums, _ = maybe_broadcast(sums)
    joined = out.join(sums, out["label"].eqNullSafe(sums["its"]), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"), "exact_error")


def query(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


_NEAR = """
SELECT p.*, (SELECT min(list_sum(list_transform(list_zip(p.x, c.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::HUGEINT * 1000 + c.e) FROM {book} c WHERE c.part = p.part) AS best FROM p"""
_NEXT = """
SELECT c.part, c.e, coalesce(n.x, c.x) AS x FROM {book} c LEFT JOIN (
  SELECT part, e, list(v ORDER BY place) AS x FROM (
    SELECT part, best % 1000 AS e, place, floor(sum(x[place])::DOUBLE / count(*))::BIGINT AS v
    FROM {near} CROSS JOIN (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM p))) AS place) GROUP BY ALL)
  GROUP BY part, e) n ON n.part = c.part AND n.e = c.e"""

SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS no, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0),
w AS (SELECT * FROM v WHERE len(v) = (SELECT len(v) FROM v WHERE no = 1)),
p AS MATERIALIZED (SELECT no, vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM w, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY no) - 1 AS e, x FROM p WHERE no IN (SELECT no FROM w ORDER BY no LIMIT {ENTRIES})),
n0 AS MATERIALIZED ({_NEAR.format(book="b0")}), b1 AS MATERIALIZED ({_NEXT.format(book="b0", near="n0")}),
n1 AS MATERIALIZED ({_NEAR.format(book="b1")}), b2 AS MATERIALIZED ({_NEXT.format(book="b1", near="n1")}),
n2 AS MATERIALIZED ({_NEAR.format(book="b2")}),
r AS (SELECT no, vec_id, label, string_agg(printf('%02x', (best % 1000)::BIGINT), '' ORDER BY part) AS code, sum(best // 1000)::BIGINT AS error FROM n2 GROUP BY no, vec_id, label)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(list_aggregate(x, 'string_agg', ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256, error::VARCHAR AS exact_error
FROM r
"""

