"""op11 against a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from same import assert_same, sql_rows

from coppice.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, `Error` int"


def plain(rows, entries=64, rounds=2, parts=16):
    kept = [r for r in rows if r[1] and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    floor = lambda x: int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256)
    vectors = [[floor(x) for x in r[1]] for r in kept]
    dim = len(vectors[0]) // parts
    cut = [[v[p * dim : (p + 1) * dim] for p in range(parts)] for v in vectors]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for v in cut:
                of.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(of[i]) for c in zip(*of[i], strict=True)] if i in of else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(kept, errors, strict=True):
        by.setdefault(r[2], []).append(e)
    fits = lambda v: v if v < 1 << 63 else None
    total = {k: fits(sum(v)) if all(e < 1 << 63 for e in v) else None for k, v in by.items()}
    return [(r[0], r[2], "".join(f"{i:02x}" for _, i in f), fits(e), total[r[2]], digest, str(e)) for r, f, e in zip(kept, found, errors, strict=True)]


def rows_of(seed, n=150, width=32, spread=1.0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, spread) for _ in range(width)], rnd.choice([0, 1, None]), "c", 1) for i in range(n)]
    rows += [(n, None, 0, "c", 1), (n + 1, [], 0, "c", 1), (n + 2, [1.0] * (width - 1) + [math.nan], 0, "c", 1), (n + 3, [math.inf] * width, 0, "c", 1), (n + 4, [None] * width, 0, "c", 1)]
    rows += [(n + 5, [0.5] * 16, 0, "c", 1), (n + 6, [0.5] * 7, 0, "c", 1), (None, [0.25] * width, None, None, None), rows[3], rows[3], (5, [0.0] * width, 1, "c", 1)]
    return rows + [(n + 10 + i, [float(i % 3)] * width, 1, "c", 1) for i in range(20)]  # ties


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.01), (3, 1e9), (4, 1e200)])
def test_plain(spark, seed, spread):
    rows = rows_of(seed, spread=spread)
    assert got(vc.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3))) == sorted(plain(rows), key=str)


def test_few(spark):
    rows = [(1, [1.0] * 16, 3, "c", 1), (2, [2.0] * 16, 3, "c", 1)]
    assert got(vc.vector_codes(spark.createDataFrame(rows, SCHEMA))) == sorted(plain(rows), key=str)


def test_none(spark):
    for rows in ([], [(1, None, 1, "c", 1), (2, [1.0] * 5, 1, "c", 1)]):
        out = vc.vector_codes(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256", "exact_error"]


def test_search():
    """The search stops early and still finds the nearest entry, the lower index at ties."""
    rng = np.random.default_rng(7)
    entries = rng.integers(-3, 4, (64, 4))
    x = rng.integers(-5, 6, (3000, 4))
    index, far = vc.Book(entries).nearest(x)
    all_ = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (far == all_.min(1)).all() and (index == all_.argmin(1)).all()


def test_sql(spark, sf_dir):
    assert_same(vc.query(spark, sf_dir).toPandas(), sql_rows(sf_dir, vc.SQL))
