"""Near dedup of the pipeline against all pairs in plain Python."""

import random

from hard import hard_rows, text

import corpus_pipeline
from coppice.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(t):
    words = t.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Smallest id of each component of texts whose sets have a Jaccard of 0.8 or more."""
    sets = {i: plain_set(t or "") for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            both, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and both * 5 >= whole * 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i for i in parent if find(i) == i}


def edited(base, n, seed):
    words, draw = base.split(), random.Random(seed)
    for at in draw.sample(range(len(words)), n):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


def test_near_stage(spark):
    draw = random.Random(3)
    rows = [(i, r[1]) for i, r in enumerate(hard_rows())]
    for k in range(60):  # similarity from about 0.55 to 0.97, on both sides of the bound
        base = " ".join(f"w{draw.randrange(5000)}" for _ in range(draw.choice((40, 100, 300))))
        rows += [(1000 + 10 * k, base), *((1000 + 10 * k + j, edited(base, max(1, len(base.split()) * j // 100), k * 10 + j)) for j in range(1, 6))]
    rows += [(3000 + i, text(i, 30 + i % 40)) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == plain_kept(rows)


def test_pairs_left_by_the_stars(spark, monkeypatch):
    """With one key for all, each pair that the pivots leave open is checked."""
    monkeypatch.setattr(near_dedup, "STARS_MOST", 1)
    from pyspark.sql import functions as F

    rows = [(10 * k + j, t) for k in range(12) for base in [" ".join(f"a{k}b{i}" for i in range(60))] for j, t in enumerate([base, edited(base, 1, k), edited(base, 1, 100 + k)])]
    docs = spark.createDataFrame(rows, "_row long, text string")
    real = near_dedup.F.explode
    monkeypatch.setattr(near_dedup.F, "explode", lambda c: real(F.array(F.lit(1).cast("long"))))
    got = {r._row: r.component for r in near_dedup.near_groups(docs).collect()}
    by = {}
    for i, c in got.items():
        by.setdefault(c, set()).add(i // 10)
    assert len(by) == 12 and all(len(s) == 1 for s in by.values())


def test_empty(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], "_row long, text string")).count() == 0


def look_alikes(n):
    """Texts that share 75 words of 100 and nothing more: a Jaccard of about 0.57, so there is no link."""
    common = [f"same{i}" for i in range(75)]
    return [(i, " ".join([*common, *(f"own{i}x{j}" for j in range(25))])) for i in range(n)]


def candidates(spark, monkeypatch, rows):
    """Pairs that are compared for these texts, and the components."""
    made, real = [], near_dedup._ordered
    monkeypatch.setattr(near_dedup, "_ordered", lambda pairs: made.append(real(pairs)) or made[-1])
    got = {r._row: r.component for r in near_dedup.near_groups(spark.createDataFrame(rows, "_row long, text string").repartition(3)).collect()}
    monkeypatch.undo()
    return sum(p.count() for p in made), got


def test_look_alikes_cost_no_more_than_they_are(spark, monkeypatch):
    small, _ = candidates(spark, monkeypatch, look_alikes(200))
    large, got = candidates(spark, monkeypatch, look_alikes(400))
    assert len(set(got.values())) == 400
    assert large <= 2.3 * small + 100


def test_links_among_look_alikes(spark, monkeypatch):
    """Near copies inside a large group of look-alikes are still found."""
    rows = look_alikes(150)
    rows += [(1000 + i, edited(t, 2, i)) for i, t in rows[:40]]
    _, got = candidates(spark, monkeypatch, rows)
    kept = plain_kept(rows)
    assert {c for c in got.values()} == kept


def test_rarest_makes_rows_of_no_more_than_it_keeps(spark, monkeypatch):
    """Near pairs share a kept shingle whatever the number of slots, and shingles that are not kept are no rows of any stage."""
    rows = look_alikes(60) + [(1000 + i, edited(t, 2, i)) for i, t in look_alikes(20)]
    rows += [(2000, ""), (2001, None), (2002, "one two")]
    texts = spark.createDataFrame([(i, t or "") for i, t in rows], "_row long, text string").repartition(3)
    sets = {i: plain_set(t or "") for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4}
    assert len(near) >= 20
    real, sizes = near_dedup.stage, []
    monkeypatch.setattr(near_dedup, "stage", lambda df: sizes.append((made := real(df)).count()) or made)
    for slots in (64, 1 << 21):
        by = {}
        for r in near_dedup._rarest(texts, slots).collect():
            assert r.n == len(sets[r.node])
            by.setdefault(r.node, set()).add(r.key)
        assert all(by[a] & by[b] for a, b in near)
        assert max(len(k) for k in by.values()) <= 96 - 77 + 1
    assert max(sizes) <= sum(len(s) - -(-len(s) * 4 // 5) + 1 for s in sets.values())


def test_fingerprints_link_what_they_see(spark, monkeypatch):
    """Without any band key, near copies within four bits still come together, by the fingerprints; a text of like fingerprint that is not near does not."""
    from coppice.llm.simhash import fingerprint

    draw = random.Random(8)
    rows, want = [], {}
    for k in range(12):
        base = " ".join(f"w{draw.randrange(5000)}" for _ in range(400))
        copies = [t for j in range(40) if (fingerprint(t := edited(base, 1, 100 * k + j)) ^ fingerprint(base)).bit_count() <= 4][:3]
        rows += [(10 * k + j, t) for j, t in enumerate([base, *copies])]
        want |= {10 * k + j: 10 * k for j in range(len(copies) + 1)}
    assert len(want) >= 24
    round_ = "p q r s t " * 200
    rows += [(500 + j, round_ + " ".join(f"own{j}x{i}" for i in range(10))) for j in range(2)]
    assert (fingerprint(rows[-1][1]) ^ fingerprint(rows[-2][1])).bit_count() <= 4
    want |= {500: 500, 501: 501}
    real = near_dedup.F.explode
    monkeypatch.setattr(near_dedup.F, "explode", lambda c: real(near_dedup.F.array().cast("array<long>")))
    assert {r._row: r.component for r in near_dedup.near_groups(spark.createDataFrame(rows, "_row long, text string")).collect()} == want


def test_open_keys_are_not_joined_again_each_round(spark, monkeypatch):
    """Whatever the rounds, members of open keys are joined with their keys for the next round or the last pairs, not to be counted."""
    kind, calls = type(spark.range(1)), []
    real = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: calls.append((tuple(other.columns), how)) or real(self, other, on, how))
    got = near_dedup.near_groups(spark.createDataFrame(look_alikes(200), "_row long, text string").repartition(3))
    assert len({r.component for r in got.collect()}) == 200
    assert sum(columns == ("key", "top") and how is None for columns, how in calls) <= 1
