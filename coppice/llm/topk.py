"""Exact top-k inner products by a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coppice.llm.common import rows_of, ship, stage, table

K, SCALE, EVERY = 5, 256, 50
#: A block of the index holds at most so many rows, and so many bytes of vectors.
ROWS_MOST, BLOCK_BYTES = 32_768, 4 << 20
#: A block of queries holds at most so many, and so many bytes of vectors.
QUERIES_MOST, QUERY_BYTES = 256, 1 << 20
#: Slices of an attribute in the index: its top bits within the block. What is below them is made up for by bounds.
SLICES = 5
#: Attributes whose sums over all subsets are made together: a query looks its own up instead of adding them one by one.
GROUP = 8
#: Words of 64 rows times queries that one bitmap operation works on.
LANE_WORDS = 4096
#: A vector with a component of more bits than this goes to a block of wide vectors.
NARROW_BITS = 24
#: Wide vectors are scored in limbs of so many bits.
LIMB = 20

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

# --- quantising ---------------------------------------------------------------------------


def quantised(vector: list | None, scale: int = SCALE) -> list[int] | None:
    """floor(scale * x) of each component as a Python integer, x as double; None where the vector takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        made = np.floor(x * scale)
    if len(x) and np.abs(made).max() >= 2.0**52:  # a double that large is a whole number already
        return [int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in x.tolist()]
    return made.astype(np.int64).tolist()


def limbs_of(vectors: list[list[int]], width: int) -> np.ndarray:
    """(limbs, rows, width) of signed digits to the base 2 ** LIMB, least first."""
    out: list[np.ndarray] = []
    rest = [v + [0] * (width - len(v)) for v in vectors]
    while True:
        out.append(np.array([[abs(x) % (1 << LIMB) * (1 if x >= 0 else -1) for x in v] for v in rest], np.int64).reshape(len(rest), width))
        rest = [[(abs(x) >> LIMB) * (1 if x >= 0 else -1) for x in v] for v in rest]
        if not any(any(v) for v in rest):
            return np.stack(out)


def order_key(score: int) -> str:
    """Sorts as text as the scores sort as numbers, of whatever length."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + "".join(chr(105 - ord(c)) for c in digits)


# --- the index ----------------------------------------------------------------------------


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bitmaps over rows (the last axis) as words of 64 rows."""
    wide = -(-bits.shape[-1] // 64) * 64
    padded = np.zeros((*bits.shape[:-1], wide), np.uint8)
    padded[..., : bits.shape[-1]] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def slices_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps over rows (width, SLICES, words) of the top bits of each attribute above its least value.

    Attributes come in the order of their ranges; each GROUP of them leaves out the same number
    of lower bits. Returns bitmaps, order, and bits left out, an entry an attribute.
    """
    above = x - x.min(axis=0, initial=0)
    bits = np.array([int(m).bit_length() for m in above.max(axis=0, initial=0)], np.int64)
    order = np.argsort(bits, kind="stable")
    shift = np.array([max(0, bits[order[at - at % GROUP : at - at % GROUP + GROUP]].max() - SLICES) for at in range(len(order))], np.int64)
    top = (above[:, order] >> shift).T
    return _packed((top[:, None, :] >> np.arange(SLICES)[None, :, None] & 1).astype(np.uint8)), order, shift


def _blocks(index: bool, scale: int):
    """Vectors of a task as blocks: ids, vectors (narrow ones as 32-bit, wide ones as text), and for the index their slices."""

    def batch(ids: list[int], numbers: list[int], vectors: list[list[int]], wide: bool) -> pa.RecordBatch:
        width = max(map(len, vectors))
        planes, order, shift = b"", b"", b""
        if wide:
            raw = "\n".join(",".join(map(str, v)) for v in vectors).encode()
        else:
            x = np.zeros((len(vectors), width), np.int64)
            for i, v in enumerate(vectors):
                x[i, : len(v)] = v
            raw = x.astype("<i4").tobytes()
            if index:
                p, o, s = slices_of(x)
                planes, order, shift = p.tobytes(), o.astype("<i8").tobytes(), s.astype("<i8").tobytes()
        return pa.RecordBatch.from_pydict(
            {"ids": [np.array(ids, "<i8").tobytes()], "numbers": [np.array(numbers, "<i4").tobytes()], "width": [width], "wide": [wide], "raw": [raw], "planes": [planes], "order": [order], "shift": [shift]}, BLOCK
        )

    most, size = (ROWS_MOST, BLOCK_BYTES) if index else (QUERIES_MOST, QUERY_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list, list, list]] = {False: ([], [], []), True: ([], [], [])}
        used = {False: 0, True: 0}
        for ids, numbers, vectors in rows_of(batches, 1024):
            for i, number, vector in zip(ids, numbers, vectors, strict=True):
                v = quantised(vector, scale)
                if v is None:
                    continue
                wide = any(-(1 << NARROW_BITS) > c or c >= 1 << NARROW_BITS for c in v)
                rows = held[wide]
                if rows[0] and (len(rows[0]) >= most or used[wide] + 4 * len(v) > size):
                    yield batch(*rows, wide)
                    held[wide], used[wide] = ([], [], []), 0
                    rows = held[wide]
                rows[0].append(i)
                rows[1].append(number)
                rows[2].append(v)
                used[wide] += 4 * max(1, len(v)) if not wide else 8 * sum(1 + c.bit_length() // 24 for c in v)
        for wide, rows in held.items():
            if rows[0]:
                yield batch(*rows, wide)

    return run


BLOCK = pa.schema([("ids", pa.binary()), ("numbers", pa.binary()), ("width", pa.int32()), ("wide", pa.bool_()), ("raw", pa.binary()), ("planes", pa.binary()), ("order", pa.binary()), ("shift", pa.binary())])
BLOCK_DDL = "ids binary, numbers binary, width int, wide boolean, raw binary, planes binary, order binary, shift binary"

# --- adding slices ------------------------------------------------------------------------


class Adder:
    """Sums of bitmaps of many weights, by carry-save addition: three bitmaps of one weight become one of it and one of the next."""

    def __init__(self, shape: tuple[int, int]):
        self.shape, self.free, self.waiting = shape, [], {}

    def take(self) -> np.ndarray:
        return self.free.pop() if self.free else np.empty(self.shape, np.uint64)

    def add(self, weight: int, bits: np.ndarray) -> None:
        """Adds a bitmap of its own (its memory is used again)."""
        while True:
            held = self.waiting.setdefault(weight, [])
            if len(held) < 2:
                held.append(bits)
                return
            a, b = held
            carry = self.take()
            np.bitwise_and(a, b, out=carry)
            np.bitwise_xor(a, b, out=a)
            np.bitwise_and(a, bits, out=b)
            np.bitwise_or(carry, b, out=carry)
            np.bitwise_xor(a, bits, out=a)
            self.free += [b, bits]
            self.waiting[weight] = [a]
            weight, bits = weight + 1, carry

    def planes(self) -> list[np.ndarray]:
        """One bitmap a weight, least first, after the last carries have gone through. Empty where nothing was added."""
        out, carry, weight = [], None, min(self.waiting, default=0)
        while carry is not None or any(w >= weight for w in self.waiting):
            held = self.waiting.pop(weight, [])
            terms = [*held, *([] if carry is None else [carry])]
            carry = None
            if not terms:
                plane = self.take()
                plane[:] = 0
            elif len(terms) == 1:
                plane = terms[0]
            else:
                plane = terms[0] ^ terms[1]
                carry = terms[0] & terms[1]
                if len(terms) == 3:
                    carry |= plane & terms[2]
                    plane ^= terms[2]
            out.append(plane)
            weight += 1
        return out


def subset_sums(planes: np.ndarray) -> np.ndarray:
    """(planes, 2 ** n, words): for each subset of n attributes (n, SLICES, words) the sum of their slices, bitmap by bitmap with carries."""
    n, wide = len(planes), SLICES + len(planes).bit_length()
    out = np.zeros((wide, 1 << n, planes.shape[2]), np.uint64)
    for i in range(n):
        half = 1 << i
        carry = None
        for p in range(wide):
            a, to = out[p, :half], out[p, half : 2 * half]
            if p < SLICES:
                b = planes[i, p][None, :]
                np.bitwise_xor(a, b, out=to)
                more = a & b
                if carry is not None:
                    more |= to & carry
                    to ^= carry
                carry = more
            else:
                np.bitwise_xor(a, carry, out=to)
                carry = a & carry
    return out


def tables_of(planes: np.ndarray) -> list[np.ndarray]:
    """The subset sums of each group of attributes: made once for a block of queries."""
    return [subset_sums(planes[at : at + GROUP]) for at in range(0, len(planes), GROUP)]


def sums_of(q: np.ndarray, tables: list[np.ndarray], shift: np.ndarray) -> tuple[list[np.ndarray], int]:
    """For queries (n, width): bitmaps (n, words) of the weighted sum of the slices, least first, and the weight of the first.

    A bit of the components of a group picks the sum of the attributes that have it, which is
    added at that bit's weight. The sign bit, in two's complement, counts negative: its sums
    are added complemented, which moves all rows of a query by the same amount.
    """
    adder = Adder((len(q), tables[0].shape[2]))
    top = int(np.abs(q).max(initial=0)).bit_length()
    for g, sums in enumerate(tables):
        part = q[:, g * GROUP : (g + 1) * GROUP]
        for a in range(top + 1):
            picked = ((part >> a & 1) << np.arange(part.shape[1])).sum(axis=1)
            if not picked.any():
                continue
            found = sums[:, picked]
            if a == top:
                np.invert(found, out=found)
            for p in range(len(found)):
                adder.add(int(shift[g * GROUP]) + a + p, found[p])
    low = min(adder.waiting, default=0)
    return adder.planes(), low


def boundary(sums: list[np.ndarray], low: int, valid: np.ndarray, slack: list[int], k: int) -> np.ndarray:
    """Bitmaps (n, words) of the rows, of those in valid, that may be among the k best of each query.

    From the most significant slice of the sum downward, rows with the bit come before those
    without it: that gives the k-th highest sum (zero where there are fewer rows). All rows
    whose sum is less than that by no more than the query's slack stay.
    """
    level, sure, kth = valid, np.zeros(len(slack), np.int64), [0] * len(slack)
    for at in range(len(sums) - 1, -1, -1):
        with_bit = level & sums[at]
        count = np.bitwise_count(with_bit).sum(axis=1, dtype=np.int64)
        enough = sure + count >= k
        level = np.where(enough[:, None], with_bit, level & ~sums[at])
        sure += np.where(enough, 0, count)
        for i in np.flatnonzero(enough).tolist():
            kth[i] += 1 << at
    bar = [max(0, v - (s >> low) - 1) if s else v for v, s in zip(kth, slack, strict=True)]
    above, equal = np.zeros_like(valid), valid
    for at in range(len(sums) - 1, -1, -1):
        bit = np.array([_ALL if b >> at & 1 else 0 for b in bar], np.uint64)[:, None]
        above |= equal & sums[at] & ~bit
        equal = equal & ~(sums[at] ^ bit)
    return above | equal


# --- searching ----------------------------------------------------------------------------


def _vectors(raw: bytes, wide: bool, rows: int, width: int) -> list[list[int]] | np.ndarray:
    if wide:
        return [[int(c) for c in line.split(",")] if line else [] for line in raw.decode().split("\n")]
    return np.frombuffer(raw, "<i4").reshape(rows, width)


def _bits(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), int(x.max(initial=0))).bit_length()


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id; scores may be Python integers."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bar)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _search(k: int):
    """The k best rows of a block of the index for each query of a block of queries."""

    def sliced(x: np.ndarray, planes: np.ndarray, order: np.ndarray, shift: np.ndarray, ids: np.ndarray, q: np.ndarray, asked: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        every, tables = _packed(np.ones(len(ids), np.uint8)), tables_of(planes)
        lanes = max(1, LANE_WORDS // len(every))
        own = set(ids[np.isin(ids, asked)].tolist())
        for at in range(0, len(q), lanes):
            part, names = q[at : at + lanes], asked[at : at + lanes]
            valid = np.repeat(every[None, :], len(part), axis=0)
            for i, name in enumerate(names):
                if name in own:
                    valid[i] &= ~_packed((ids == name).astype(np.uint8))
            sums, low = sums_of(part[:, order], tables, shift)
            kept = boundary(sums, low, valid, (np.abs(part[:, order]) @ ((1 << shift) - 1)).tolist(), k)
            rows_bits = np.unpackbits(kept.view(np.uint8), axis=1, bitorder="little")
            for i in range(len(part)):
                rows = np.flatnonzero(rows_bits[i])
                yield at + i, rows, x[rows].astype(np.int64) @ part[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(c)[row].as_py() for c, name in enumerate(batch.schema.names)}
                ids, asked = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8").tolist()
                numbers = np.frombuffer(r["q_numbers"], "<i4").tolist()
                width = max(r["width"], r["q_width"])
                x, q = _vectors(r["raw"], r["wide"], len(ids), r["width"]), _vectors(r["q_raw"], r["q_wide"], len(asked), r["q_width"])
                shared = min(r["width"], r["q_width"])  # what one side lacks is zero and adds nothing
                if shared and not r["wide"] and not r["q_wide"] and _bits(x) + _bits(q) + shared.bit_length() < 63:
                    planes = np.frombuffer(r["planes"], "<u8").reshape(r["width"], SLICES, -1)
                    fitted = np.zeros((len(q), r["width"]), np.int64)
                    fitted[:, :shared] = q[:, :shared]
                    found = sliced(x, planes, np.frombuffer(r["order"], "<i8"), np.frombuffer(r["shift"], "<i8"), ids, fitted, asked)
                else:
                    found = _by_limbs(x, q, width, ids, asked)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for i, rows, scores in found:
                    top = _best(ids[rows], scores, k)
                    out[0].extend([asked[i]] * len(top))
                    out[1].extend([numbers[i]] * len(top))
                    out[2].extend(ids[rows[top]].tolist())
                    out[3].extend(int(s) for s in scores[top])
                exact = [s if -(1 << 63) <= s < 1 << 63 else None for s in out[3]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(exact, pa.int64()), pa.array(map(str, out[3]), pa.string()), pa.array(map(order_key, out[3]), pa.string())],
                    ["query_id", "query_no", "vec_id", "score", "exact_score", "key"],
                )

    return run


def _by_limbs(x, q, width: int, ids: np.ndarray, asked: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Wide vectors, or very many components: every row scored in limbs that fit 64 bits, added up as Python integers."""
    xs = limbs_of([list(map(int, v)) for v in x], width)
    step = 1 << max(0, 62 - 2 * LIMB)  # so many products of two limbs add up within 62 bits
    for i, v in enumerate(q):
        rows = np.flatnonzero(ids != asked[i])
        total = np.zeros(len(rows), object)
        for b, limb in enumerate(limbs_of([list(map(int, v))], width)[:, 0]):
            for a in range(len(xs)):
                for at in range(0, width, step):
                    total += (xs[a][rows, at : at + step] @ limb[at : at + step]).astype(object) << (LIMB * (a + b))
        yield i, rows, total


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, query_no, rank, vec_id, score, exact_score: for each query its k rows with the highest integer inner product, ties to the smaller id.

    Components are floor(scale * x). Every row is a candidate, repeated ones too, but for rows
    under the query's own id. Rows of `queries` that repeat an id and a vector ask once;
    different vectors under one id have rankings of their own, numbered by query_no from 1 in
    the order of the vectors. Vectors that are null or hold a null or non-finite component take
    no part, nor do rows with a null id. A shorter vector counts as padded with zeros. Scores
    are exact at any size: exact_score has them as text, score is null where 64 bits do not hold
    it. Other columns are not read. Empty tables give no rows.

    The index is made and written once: blocks of rows with, for each attribute, bitmaps over
    the rows of its top bits. A query adds up slices with bitmap arithmetic, shifted by its own
    bits; the slices of the sum are gone through from the most significant downward for the
    k-th highest; rows that the left-out low bits might lift that far are scored exactly.
    Vectors with components beyond 24 bits lie in blocks of their own and are scored in limbs.

    Scale: blocks of rows meet blocks of queries, both some megabytes; each meeting is a task's
    work and gives k rows a query; the window keeps k a task before its shuffle. No query or
    vector passes the driver. Work grows with rows times queries.
    """
    ship(vectors.sparkSession)
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))"
    row = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(f"id is not null and v is not null and {finite}")
    index = stage(row(vectors).select("id", F.lit(1).alias("number"), "v").mapInArrow(_blocks(True, scale), BLOCK_DDL))
    numbered = row(queries).distinct().withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("v"))).select("id", "number", "v")
    asked = stage(numbered.mapInArrow(_blocks(False, scale), BLOCK_DDL)).select("ids", "numbers", "width", "wide", "raw")
    asked = asked.toDF("q_ids", "q_numbers", "q_width", "q_wide", "q_raw")
    met = index.crossJoin(asked)  # blocks of rows by blocks of stated queries
    found = met.mapInArrow(_search(k), "query_id long, query_no int, vec_id long, score long, exact_score string, key string")
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("key"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "query_no", "rank", "vec_id", "score", "exact_score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (
  SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY embedding) AS no
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % {EVERY} = 0)),
pairs AS (
  SELECT q.vec_id AS query_id, q.no AS query_no, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::HUGEINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_no ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, query_no::INT AS query_no, rank::INT AS rank, vec_id, try_cast(score AS BIGINT) AS score, score::VARCHAR AS exact_score FROM ranked WHERE rank <= {K}
"""
