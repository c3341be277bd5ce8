"""Exact dedup and SimHash against plain Python on hard rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hard import hard_rows

from coppice.llm import components, exact_dedup, simhash


def test_exact(hard):
    got = exact_dedup.exact_dedup(hard, carry={"h": F.sha2(F.coalesce("text", F.lit("")), 256)}).drop("text_hash").collect()
    rows = hard_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_exact_by_shuffled_path(hard, monkeypatch):
    """Beyond the broadcast bound the answer is the same."""
    near = exact_dedup.exact_dedup(hard).collect()
    monkeypatch.setattr(exact_dedup, "maybe_broadcast", lambda df, *a: (df, False))
    assert sorted(map(str, exact_dedup.exact_dedup(hard).collect())) == sorted(map(str, near))


def test_exact_with_a_full_map(hard, monkeypatch):
    """A map too small for its keys costs hashes and changes no answer; so does one whose every bit is set."""
    want = sorted(str(tuple(r)[:4]) for r in exact_dedup.exact_dedup(hard).collect())
    monkeypatch.setattr(exact_dedup, "with_marks", lambda df, *a: df.withColumn("coppice_hit", F.lit(True)))
    assert sorted(str(tuple(r)[:4]) for r in exact_dedup.exact_dedup(hard).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(exact_dedup, "_key_hash", lambda: F.lit(0).cast("long"))
    assert sorted(str(tuple(r)[:4]) for r in exact_dedup.exact_dedup(hard).collect()) == want


def test_exact_hashes_survivors_only(spark):
    """Texts whose length or beginning is their own are never hashed in full."""
    texts = ["a", "bb", "cc", "x" * 70 + "1", "x" * 70 + "2", "same", "same"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.text_hash} == {5, 6}
    assert [got[i].group_size for i in range(7)] == [1, 1, 1, 1, 1, 2, 2]


def test_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def test_fingerprints_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    want = plain_fingerprint(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "WORD_BLOCK", 10)
    assert simhash.fingerprint(text) == want


def test_fuzzy_keys_meet_within_four_bits():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 400, np.int64).astype(np.uint64)
    for bits in range(5):
        other = fps.copy()
        for _ in range(bits):
            other ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
        (r1, k1), (r2, k2) = simhash.fuzzy_keys(fps), simhash.fuzzy_keys(other)
        a, b = defaultdict(set), defaultdict(set)
        for r, k in zip(r1.tolist(), k1.tolist()):
            a[r].add(k)
        for r, k in zip(r2.tolist(), k2.tolist()):
            b[r].add(k)
        assert all(a[i] & b[i] for i in range(len(fps)))


def brute_components(pairs):
    """Smallest id reachable, over fingerprints that differ in four bits or fewer."""
    ids = [i for i, _ in pairs]
    fps = np.array([f for _, f in pairs], np.uint64)
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            parent[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return sorted(((ids[i], f"{int(fps[i]):016x}", low.get(find(i))) for i in range(len(ids))), key=str)


def test_simhash(hard):
    got = sorted(map(tuple, simhash.simhash_groups(hard).collect()), key=str)
    assert got == brute_components([(r[0], plain_fingerprint(r[1] or "")) for r in hard_rows()])


def test_long_runs_and_chains():
    """A tight ball and a chain longer than the short-run limit give the components of brute force, whatever the block."""
    rng = np.random.default_rng(1)
    ball = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    chain = np.cumsum(np.ones(64, np.uint64)) * 0 + np.array([(1 << i) - 1 for i in range(0, 60, 3)] * 4)[:64].astype(np.uint64)
    for fps in (ball, np.unique(chain)):
        label = simhash._balls(fps, 4)
        want = brute_components(list(enumerate(fps.tolist())))
        low = {}
        for i, x in enumerate(label.tolist()):
            low.setdefault(x, i)
        assert sorted(((i, f"{int(fps[i]):016x}", low[label[i]]) for i in range(len(fps))), key=str) == want


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 30)] + [(200, 100), (300, 100), (300, 200), (-5, -9)]
    got = {r.a: r.b for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 200: 100, 300: 100, -5: -9}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
