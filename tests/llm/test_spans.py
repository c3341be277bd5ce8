"""op12 against every 200-byte string of small tables."""

import hashlib
import random

import numpy as np
import pytest
from hard import hard_rows, text

from coppice.llm import span_dedup
from coppice.llm.span_dedup import LENGTH, repeated_spans


def plain(rows, keep="none"):
    """rows: (doc_id, text) in the order that counts."""
    texts, where = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows], {}
    for d, b in enumerate(texts):
        for i in range(len(b) - LENGTH + 1):
            where.setdefault(b[i : i + LENGTH], []).append((d, i))
    out = []
    for d, ((doc_id, _), b) in enumerate(zip(rows, texts, strict=True)):
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            found = where[b[i : i + LENGTH]]
            if len(found) > 1 and (keep == "none" or found[0] != (d, i)):
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def passages(seed, n=60):
    """Texts of random pieces of a few shared passages, some exactly 200 bytes long or one byte less, some with one byte changed."""
    rnd = random.Random(seed)
    letters = "abcdefghij klmnop\nqé"
    shared = ["".join(rnd.choice(letters) for _ in range(rnd.choice([230, 420, 900]))) for _ in range(4)]
    exact = shared[0].encode()[:LENGTH].decode("utf-8", "ignore")
    out = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(shared)
            a, b = sorted(rnd.sample(range(len(p) + 1), 2))
            p = rnd.choice([p, p[a:b], exact, exact[1:], p[: len(p) // 2] + "#" + p[len(p) // 2 :]])
            parts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))), p]
        out.append((i, "".join(parts)))
    return [*out, (n, "z" * 199), (n + 1, "y" * 200), (n + 2, "x" * 201), (n + 3, "ab" * 400), (None, shared[1]), (7, "")]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block_bytes", [1, 3000, 1 << 20])
def test_passages(spark, seed, block_bytes):
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(repeated_spans(docs, block_bytes=block_bytes)) == sorted(plain(rows), key=str)


def test_keep_first(spark):
    rows = passages(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(repeated_spans(docs, keep="first", block_bytes=2000)) == sorted(plain(rows, "first"), key=str)
    with pytest.raises(ValueError):
        repeated_spans(docs, keep="last")


def test_hard_rows(hard):
    rows = [r[:2] for r in hard_rows()]
    assert got(repeated_spans(hard)) == sorted(plain(rows), key=str)


def test_none(none):
    assert repeated_spans(none).collect() == []


def test_tiles(monkeypatch):
    """A long document in small tiles gives the same anchors and classes as in one."""
    raw = " ".join(text(i, 30) for i in range(200)).encode()
    t, ends = np.frombuffer(raw, np.uint8), np.array([5000, 5100, len(raw)])
    whole = span_dedup.anchors(t, ends)
    monkeypatch.setattr(span_dedup, "TILE", 1000)
    parts = span_dedup.anchors(t, ends)
    starts = lambda runs: {s: (a, g) for a, g, lo, hi in zip(*runs, strict=True) for s in range(lo, hi + 1)}
    assert starts(whole) == starts(parts)
    at = np.arange(0, len(raw) - LENGTH + 1)
    small = span_dedup.hashes(t, at, LENGTH)
    monkeypatch.undo()
    assert (small == span_dedup.hashes(t, at, LENGTH)).all()
    strings = {raw[i : i + LENGTH]: h for i, h in zip(at, small, strict=True)}
    assert all(strings[raw[i : i + LENGTH]] == h for i, h in zip(at, small, strict=True)) and len(set(strings.values())) == len(strings)
