"""Sharding, mixing, language, toxicity, search and preference formatting; the queries' SQL twins."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hard import SCHEMA, hard_rows, text
from pyspark.sql import functions as F

from coppice.llm import kd_shard, language_id, poisson_mix, preference, registry, topk, toxicity

from same import assert_same, sql_rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir).toPandas(), sql_rows(sf_dir, registry.oracle_sql()[name]))


# --- sharding -----------------------------------------------------------------------------


def check_shards(rows, n, slack):
    total = sum(r["size"] for r in rows)
    by = Counter()
    for r in rows:
        by[r["shard"]] += r["size"]
    assert set(by) <= set(range(n))
    assert all(abs(b - total / n) <= slack for b in by.values())
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_shards(spark):
    docs = spark.createDataFrame([(i, text(i, 10 + i % 60), "en", "s", 1, "k", 1, "f", 2) for i in range(1500)], SCHEMA)
    rows = kd_shard.kd_shard(docs, 8).collect()
    assert len(rows) == 1500 and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    longest = max(r["size"] for r in rows)
    check_shards(rows, 8, 4 * longest)
    want = {i: zlib.crc32(text(i, 10 + i % 60).encode()) for i in range(1500)}
    assert all(r["text_crc32"] == want[r["doc_id"]] for r in rows)


def plain_shards(rows, n):
    """The same tree in plain Python: rows are (index, size, keys by dimension, each (cell, within))."""
    out = {}

    def split(part, k, first):
        if k == 1 or not part:
            out.update(dict.fromkeys((r[0] for r in part), first))
            return
        spread = [max(r[2][d] >> 36 for r in part) - min(r[2][d] >> 36 for r in part) for d in range(3)]
        d = spread.index(max(spread))
        left = k // 2 + k % 2
        total = sum(r[1] for r in part)
        want, prefix, before = total * left / k, 0, 0
        for digit in range(4):
            shift = 12 * (3 - digit)
            cells = Counter()
            for r in part:
                if r[2][d] >> (shift + 12) == prefix:
                    cells[r[2][d] >> shift & 4095] += r[1]
            for cell in sorted(cells):
                if before + cells[cell] >= want:
                    break
                before += cells[cell]
            low, w = prefix << 12 | cell, cells[cell]
            if digit == 3 or w <= kd_shard.TOLERANCE * total:
                with_it = abs(before + w - want) <= abs(before - want)
                cut = ((low + with_it) << shift) - 1
                break
            prefix = low
        split([r for r in part if r[2][d] <= cut], left, first)
        split([r for r in part if r[2][d] > cut], k - left, first + left)

    split(rows, n, 0)
    return out


@pytest.mark.parametrize("n", [8, 5, 1])
def test_shards_as_in_plain_python(spark, n):
    """Cuts, dimensions and shard numbers against the plain version; row hashes are taken from Spark, in one partition so that rows have their numbers."""
    rows = [(i, text(i, 3 + i * i % 90) if i % 7 else "same " * (i % 3)) for i in range(700)] + [(5, text(5)), (5, text(5)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    t = F.coalesce("text", F.lit(""))
    number = F.monotonically_increasing_id()
    within = F.xxhash64(t).bitwiseAND((1 << 24) - 1) * 4096 + F.xxhash64("doc_id", number).bitwiseAND(4095)
    keys = docs.select(*[(c * F.lit(1 << 36) + within).alias(d) for d, c in kd_shard.text_dimensions(t).items()]).collect()
    plain = plain_shards([(i, len((x or "").encode()) + 1, tuple(k)) for i, ((_, x), k) in enumerate(zip(rows, keys, strict=True))], n)
    want = Counter((rows[i][0], zlib.crc32((rows[i][1] or "").encode()), s) for i, s in plain.items())
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in kd_shard.kd_shard(docs, n).collect()) == want


def test_shards_by_shuffled_tree(spark, monkeypatch):
    """Beyond the broadcast bound the answer is the same."""
    docs = spark.createDataFrame([(i, text(i, 10 + i % 60)) for i in range(300)], "doc_id long, text string").coalesce(1)
    want = sorted((r["doc_id"], r["shard"]) for r in kd_shard.kd_shard(docs, 4).collect())
    monkeypatch.setattr(kd_shard, "maybe_broadcast", lambda df, *a: (df, False))
    assert sorted((r["doc_id"], r["shard"]) for r in kd_shard.kd_shard(docs, 4).collect()) == want


def test_shards_of_one_row_many_times(spark):
    docs = spark.createDataFrame([(7, "same row")] * 2000, "doc_id long, text string")
    check_shards(kd_shard.kd_shard(docs, 8).collect(), 8, 40)


def test_shards_of_one_text(spark):
    """Copies of one text are divided by their rows, so shards stay near equal."""
    docs = spark.createDataFrame([(i, "same text", None, None, 1, "k", 1, "f", 2) for i in range(2000)], SCHEMA)
    check_shards(kd_shard.kd_shard(docs, 8).collect(), 8, 20)


def test_shards_of_hard_rows_and_none(hard, none):
    rows = kd_shard.kd_shard(hard, 5).collect()
    assert len(rows) == len(hard_rows())
    assert Counter(r["size"] for r in rows) == Counter(len((r[1] or "").encode()) + 1 for r in hard_rows())
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert kd_shard.kd_shard(none, 8).count() == 0


def test_leaves_keep_to_the_target(spark):
    docs = spark.createDataFrame([(i, "x" * 99, None, None, 1, "k", 1, "f", 2) for i in range(300)], SCHEMA)
    rows = kd_shard.kd_shard(docs, target_bytes=5000).collect()
    assert len({r["shard"] for r in rows}) == 6


# --- mixing -------------------------------------------------------------------------------


def plain_poisson(u, mean):
    k, p = 0, math.exp(-mean)
    c = p
    while c < u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_poisson_inverse(spark):
    pairs = [(u, m) for u in (1e-9, 0.1, 0.5, 0.9, 0.999999) for m in (0.0, 0.2, 1.0, 7.5, 150.0)]
    df = spark.createDataFrame(pairs, "u double, m double").select("u", "m", poisson_mix.poisson_inverse(F.col("u"), F.col("m")).alias("k"))
    assert all(r["k"] == plain_poisson(r["u"], r["m"]) for r in df.collect())


def test_large_means_have_the_right_moments(spark):
    k = [r[0] for r in spark.range(400).select(poisson_mix.copies_of(F.lit(2000.0), 1, F.col("id").cast("string"))).collect()]
    assert abs(np.mean(k) - 2000) < 12 and 25 < np.std(k) < 65


def test_mix_meets_targets(spark):
    docs = spark.createDataFrame([(i, "x" * 50, "en", "a" if i % 4 else None, 50, "k", 1, "f", 2) for i in range(4000)], SCHEMA)
    weights = spark.createDataFrame([("a", 1.0), (None, 1.0)], "source string, weight double")
    rates = poisson_mix.source_rates(docs, weights)
    got = Counter(r["source"] for r in poisson_mix.poisson_mix(docs, rates).select("source").collect())
    assert abs(got["a"] - 2000) < 200 and abs(got[None] - 2000) < 200
    again = poisson_mix.poisson_mix(docs.repartition(7), rates)
    first = poisson_mix.poisson_mix(docs, rates)
    assert sorted(map(str, again.select("doc_id", "copy", "mix_key").collect())) == sorted(map(str, first.select("doc_id", "copy", "mix_key").collect()))


def test_mix_of_clashing_names(spark):
    """Columns of the user named like the operator's own stay as they are."""
    schema = "doc_id long, text string, source string, copy string, Mix_Key int, _rate int, _source int, _n int, n int, rate int, key int, `a.b` int, row int, mass int, weight int"
    docs = spark.createDataFrame([(i, "x" * 50, f"s{i % 3}", "mine", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) for i in range(60)], schema)
    out = poisson_mix.poisson_mix(docs, poisson_mix.source_rates(docs))
    assert out.columns == [*docs.columns, "_copy", "_mix_key"]
    rows = out.collect()
    assert rows and all(tuple(r)[3:15] == ("mine", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11) for r in rows)
    plain = poisson_mix.poisson_mix(docs.select("doc_id", "text", "source"), poisson_mix.source_rates(docs)).collect()
    assert Counter((r["doc_id"], r["_copy"]) for r in rows) == Counter((r["doc_id"], r["copy"]) for r in plain)


def test_mix_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (None, "b", "s"), (None, None, "s"), (2, "c", "none")], "doc_id long, text string, source string")
    rates = spark.createDataFrame([("s", 3.0), ("none", None)], "source string, rate double")
    got = Counter((r["doc_id"], r["text"]) for r in poisson_mix.poisson_mix(docs, rates).collect())
    u = lambda key: (int(__import__("hashlib").md5(f"{poisson_mix.SEED}|{key}|1".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    one, null = plain_poisson(u("1"), 3.0), plain_poisson(u("null"), 3.0)
    assert got == +Counter({(1, "a"): 2 * one, (None, "b"): null, (None, None): null})


def test_mix_of_hard_rows_and_none(hard, none):
    out = poisson_mix.poisson_mix(hard, poisson_mix.source_rates(hard))
    assert set(hard.columns) < set(out.columns) and out.count() >= 0
    assert poisson_mix.poisson_mix(none, poisson_mix.source_rates(none)).count() == 0


# --- language -----------------------------------------------------------------------------


def test_language(spark, sf_dir):
    rows = registry.queries()["op7_language_id"](spark, sf_dir).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    assert len(rows) == len(docs)
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in rows["held_out"].items())
    held = rows[rows["held_out"]].join(docs)
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert rows["score"].between(0, 1).all()


def test_language_of_hard_rows(hard, none):
    profiles = language_id.learn_profiles(hard)
    got = sorted(map(tuple, language_id.language_id(hard, profiles).select("doc_id", "lang_pred").collect()), key=str)
    want = sorted(((r[0], "en" if r[1] and any(c.isalpha() for c in r[1]) else "und") for r in hard_rows()), key=str)
    assert got == want
    assert {r["lang_pred"] for r in language_id.language_id(hard, {}).collect()} == {"und"}
    assert language_id.learn_profiles(none) == {} and language_id.language_id(none, profiles).count() == 0


def test_language_as_in_plain_python(spark):
    """Bound, bundled and compared letter by letter, without counts or tables of n-grams."""
    L = language_id
    letters = np.random.default_rng(L.SEED).integers(0, 2, (L.CLASSES, L.DIM), np.int8).astype(float) * 2 - 1

    def vector(t):
        classes = [0, *(0 if not c.isalpha() else ord(c.lower()[0]) - 96 if "a" <= c.lower()[0] <= "z" else 27 + ord(c.lower()[0]) % (L.CLASSES - 27) for c in t), 0]
        total = np.zeros(L.DIM)
        for a, b, c in zip(classes, classes[1:], classes[2:]):
            if b:
                total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    rows = [(i, text(i, 20), "en") for i in range(6)] + [(10 + i, "der schnelle Fuchs springt über den faulen Hund und schläft " * (i + 1), "de") for i in range(3)] + [(20, "日本語の文章です", "ja"), (21, "12 34", "en"), (22, None, "de"), (23, "ünïcödé wörds", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sums = {}
    for _, t, lang in rows:
        if t and lang:
            sums[lang] = sums.get(lang, 0) + vector(t)
    profiles = L.learn_profiles(docs)
    assert sorted(profiles) == sorted(sums) and all(np.allclose(profiles[k], sums[k]) for k in sums)
    for r in L.language_id(docs, profiles).collect():
        v = vector(dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "")
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r["lang_pred"] == best and math.isclose(r["score"], max(cosines[best], 0), abs_tol=1e-5)


def test_grams_in_blocks(monkeypatch):
    text_ = "Les naïfs ægithales hâtifs pondant à Noël " * 20
    whole = np.sort(np.concatenate(list(language_id.grams_of(text_))))
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 17)
    assert (np.sort(np.concatenate(list(language_id.grams_of(text_)))) == whole).all()


# --- toxicity -----------------------------------------------------------------------------


def test_toxicity(spark):
    bad = ["you utter scoundrel", "vile wretch of a man"]
    docs = [(i, text(i, 60) + (" " + bad[i % 2] if i % 4 == 0 else ""), "en", "s", 1, "k", 1, "f", 2) for i in range(800)]
    df = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    train = language_id.fold("doc_id", 3) != 1
    model = toxicity.learn_toxicity(df.filter(train), labels.filter(train))
    rows = {r["doc_id"]: r for r in toxicity.toxicity(df, model).collect()}
    assert len(rows) == 800
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(rows[i]["predicted"] == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())


def plain_ftrl(rows):
    """FTRL-proximal as published, one coordinate at a time, over (set of slots, label)."""
    T = toxicity
    seen = Counter(s for x, _ in rows for s in x)
    value = {s: math.log((1 + len(rows)) / (1 + n)) / T.RARE for s, n in seen.items()}
    share = sum(y for _, y in rows) / len(rows)
    rise = {1: min(0.5 / share, 10), 0: min(0.5 / (1 - share), 10)}
    z, n, bias, bias_n = Counter(), Counter(), 0.0, 0.0
    weight = lambda s: 0.0 if abs(z[s]) <= T.L1 else (math.copysign(T.L1, z[s]) - z[s]) / ((T.BETA + math.sqrt(n[s])) / T.ALPHA + T.L2)
    for epoch in range(T.EPOCHS):
        for i in np.random.default_rng(3 + epoch).permutation(len(rows)).tolist():
            x, y = rows[i]
            w = {s: weight(s) for s in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[s] * value[s] for s in x) + bias))))
            loss = (p - y) * rise[y]
            for s in x:
                g = loss * value[s]
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / T.ALPHA * w[s]
                n[s] += g * g
            bias_n += loss * loss
            bias -= T.ALPHA / (T.BETA + math.sqrt(bias_n)) * loss
    return {s: weight(s) * value[s] for s in value}, bias


def test_ftrl_as_published(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 50, 8)), int(rng.random() < 0.3)) for _ in range(120)]
    rows = [(np.unique(np.append(x, 99)) if y else x, y) for x, y in rows]
    weights, bias = toxicity.ftrl(rows)
    want, want_bias = plain_ftrl([(x.tolist(), y) for x, y in rows])
    assert math.isclose(bias, want_bias, rel_tol=1e-9)
    assert all(math.isclose(weights[s], w, rel_tol=1e-9, abs_tol=1e-12) for s, w in want.items())
    assert weights[99] > 0 and any(w == 0 for w in want.values())


def test_scores_add_up(spark):
    """Scores of documents against features made and weighed one by one."""
    import re

    import xxhash

    slot = lambda h: ((h * int(toxicity._MIX)) % (1 << 64)) >> 45
    h = lambda w, seed=0: xxhash.xxh64_intdigest(w, seed)

    def plain(t):
        ws = re.findall(r"[^\W_]+", t.lower())
        out = {slot(h(w)) for w in ws} | {slot(h(w[:4], 1)) for w in ws}
        out |= {slot((h(a) * int(toxicity._PAIR) + h(b)) % (1 << 64)) for a, b in zip(ws, ws[1:])} | {slot((h(a) * int(toxicity._SKIP) + h(b)) % (1 << 64)) for a, b in zip(ws, ws[2:])}
        for seed, bag in ((2, set(ws)), (3, ws)):
            counts = Counter(w[:4] for w in bag)
            out |= {slot(h(s, seed)) for s, n in counts.items() if n >= 2 and n * toxicity.DENSE >= len(ws)}
        return out

    texts = [text(i, 5 + 40 * i) for i in range(9)] + ["", "walls wallet", "one"]
    rng = np.random.default_rng(2)
    model = {s: float(np.float32(rng.normal())) for t in texts for s in sorted(plain(t))[::3]} | {-1: -0.5}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.toxicity(docs, model).collect():
        total = -0.5 + sum(model.get(s, 0.0) for s in plain(texts[r["doc_id"]]))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-35, min(35, total)))), rel_tol=1e-6)


def test_sample_is_bounded_and_keeps_the_rare_label(spark):
    marked = spark.range(20_000).select(F.col("id"), (F.col("id") % 40 == 0).cast("int").alias("label"))
    got = Counter(r["label"] for r in toxicity.bounded_sample(marked, 2000).collect())
    assert got[1] == 500 and abs(got[0] - 1500) < 150
    assert toxicity.bounded_sample(marked, 20_000).count() == 20_000


def test_toxicity_of_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(3, 1, 1), (3, 1, 1), (4, 1, None), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn_toxicity(hard, labels)
    assert toxicity.toxicity(hard, model).count() == len(hard_rows())
    empty = toxicity.learn_toxicity(none, labels.limit(0))
    assert toxicity.toxicity(hard, empty).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(none, model).count() == 0


# --- search -------------------------------------------------------------------------------


def plain_topk(rows, queries, k):
    out = []
    for q, qv in queries:
        scores = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(0, 0.3, 70)]) for i in range(300)]
    data += [(300 + i, data[5][1]) for i in range(20)]  # ties
    bad = [(1000, None), (1001, [None] + [0.1] * 69), (1002, [float("nan")] * 70), (1003, [float("inf")] * 70), (None, data[0][1]), (1004, []), data[7]]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").repartition(5)
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data] + [(1004, [])]
    ints.append(ints[7])
    got = topk.exact_topk(df, df.filter("vec_id % 50 = 0"), 5)
    want = plain_topk(ints, [q for q in ints if q[0] % 50 == 0], 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == want


def test_topk_keeps_repeated_rows(spark):
    """Each row is a candidate, its copies too; a query id with two vectors has two rankings."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (3, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r)[:5] for r in topk.exact_topk(df, df.filter("vec_id = 0"), 3).collect())
    assert got == [(0, 1, 1, 2, 32768), (0, 1, 2, 1, 16384), (0, 1, 3, 1, 16384), (0, 2, 1, 1, 32768), (0, 2, 2, 1, 32768), (0, 2, 3, 2, 16384)]


@pytest.mark.parametrize("width,scale_", [(768, 1.0), (200, 2000.0), (64, 65535.0), (5, 1e30)])
def test_topk_of_wide_vectors(spark, width, scale_):
    """Many components, and components beyond what 64 bits hold: scores are exact."""
    rng = np.random.default_rng(width)
    data = [(i, [float(x) for x in rng.normal(0, scale_, width)]) for i in range(60)] + [(60, [1.0, 2e6]), (61, [0.001] * width), (62, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(2)
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in data]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], int(r["exact_score"])) for r in topk.exact_topk(df, df.filter("vec_id % 30 = 0"), 4).collect())
    assert got == plain_topk(ints, [q for q in ints if q[0] % 30 == 0], 4)
    assert all(r["score"] == (int(r["exact_score"]) if abs(int(r["exact_score"])) < 1 << 63 else None) for r in topk.exact_topk(df, df.filter("vec_id % 30 = 0"), 4).collect())


def test_order_keys():
    scores = [0, 1, -1, 9, 10, -9, -10, 10**30, -(10**30), 10**30 + 1, 99, 100, -99, -100]
    assert sorted(scores, key=topk.order_key) == sorted(scores)


def test_sums_of_slices_are_bounded(monkeypatch):
    """Of every block of rows, the best are among those that the slices leave."""
    rng = np.random.default_rng(8)
    for rows, width, least, most in ((500, 64, -100, 100), (63, 3, 0, 1), (200, 20, -(1 << 20), 1 << 20), (129, 9, 5, 6)):
        x, q = rng.integers(least, most, (rows, width)), rng.integers(least, most, (17, width))
        planes, order, shift = topk.slices_of(x)
        sums, low = topk.sums_of(q[:, order], topk.tables_of(planes), shift)
        valid = np.repeat(topk._packed(np.ones(rows, np.uint8))[None], len(q), 0)
        kept = topk.boundary(sums, low, valid, (np.abs(q[:, order]) @ ((1 << shift) - 1)).tolist(), 5)
        for i in range(len(q)):
            have = set(np.flatnonzero(np.unpackbits(kept[i].view(np.uint8), bitorder="little")).tolist())
            scores = x @ q[i]
            bar = np.sort(scores)[-5]
            assert set(np.flatnonzero(scores >= bar).tolist()) <= have and max(have) < rows


def test_topk_small_and_empty(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [-0.5]), (2, [100000.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_topk(df, df.filter("vec_id = 0"), 5).collect()]
    assert sorted(got) == [(0, 1, 2, 128 * 25600000), (0, 2, 1, -128 * 128)]
    assert topk.exact_topk(df.limit(0), df.limit(0)).count() == 0 and topk.exact_topk(df, df.limit(0)).count() == 0


# --- preference ---------------------------------------------------------------------------

TURNS = "pair_id long, turn long, role string, text string, part string, n int"


def test_preference(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "so"), (2, 0, "user", "same"), (3, 0, "user", None), (4, 0, "system", "only chosen"), (None, 0, "user", "x"), (5, None, "user", "first"), (5, 0, "assistant", "a"), (6, 0, "user", "t"), (6, 0, "user", "t")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "same"), (3, 0, "user", ""), (5, None, "user", "first"), (5, 0, "assistant", "b"), (6, 0, "user", "t")]
    frame = lambda rows: spark.createDataFrame([(*x, "p", 1) for x in rows], TURNS)
    got = {(x["pair_id"], x["part"], x["turn"], x["rendered"], x["rendered"][x["train_from"] : x["train_to"]]) for x in preference.preference_segments(frame(c), frame(r)).collect()}
    u, a = "<|user|>\n", "<|assistant|>\n"
    assert got == {
        (1, "prompt", 0, u + "hi<|end|>\n", ""), (1, "chosen", 1, a + "yes<|end|>\n", "yes<|end|>\n"), (1, "chosen", 2, u + "so<|end|>\n", ""), (1, "rejected", 1, a + "no<|end|>\n", "no<|end|>\n"),
        (2, "prompt", 0, u + "same<|end|>\n", ""), (3, "chosen", 0, u + "<|end|>\n", ""), (3, "rejected", 0, u + "<|end|>\n", ""), (4, "chosen", 0, "<|system|>\nonly chosen<|end|>\n", ""),
        (5, "prompt", None, u + "first<|end|>\n", ""), (5, "chosen", 0, a + "a<|end|>\n", "a<|end|>\n"), (5, "rejected", 0, a + "b<|end|>\n", "b<|end|>\n"),
        (6, "chosen", 0, u + "t<|end|>\n", ""), (6, "rejected", 0, u + "t<|end|>\n", ""),
    }
    assert preference.preference_segments(frame(c).limit(0), frame(r).limit(0)).count() == 0


def test_preference_pairs(spark):
    """Prompt and completions in one row; spans point at what bears loss; repeated rows are one."""
    c = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "so"), (1, 3, "assistant", "end"), (2, 0, None, None), (3, 0, "user", "alone"), (None, 0, "user", "x")]
    r = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None)]
    frame = lambda rows: spark.createDataFrame([(*x, "p", 1) for x in rows], TURNS)
    got = {x["pair_id"]: x for x in preference.preference_pairs(frame(c), frame(r)).collect()}
    u, a, e = "<|user|>\n", "<|assistant|>\n", "<|end|>\n"
    assert set(got) == {1, 2, 3} and {(x["page"], x["sub"]) for x in got.values()} == {(0, 0)}
    assert (got[1]["prompt"], got[1]["chosen"], got[1]["rejected"]) == (f"{u}hi{e}", f"{a}yes{e}{u}so{e}{a}end{e}", f"{a}no{e}")
    assert [got[1]["chosen"][s["from"] : s["to"]] for s in got[1]["chosen_spans"]] == [f"yes{e}", f"end{e}"]
    assert [got[1]["rejected"][s["from"] : s["to"]] for s in got[1]["rejected_spans"]] == [f"no{e}"]
    assert (got[2]["prompt"], got[2]["chosen"], got[2]["rejected"]) == (f"<|unknown|>\n{e}", "", "")
    assert (got[3]["prompt"], got[3]["chosen"], got[3]["chosen_spans"]) == ("", f"{u}alone{e}", [])


def test_long_pairs_are_paged(spark):
    """A conversation of 200 turns, and a turn of 300 different rows, in pages that join to the whole."""
    c = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(200)] + [(2, 70, "assistant", f"x{i:03}") for i in range(300)]
    r = [(1, 0, "user", "t0"), (1, 1, "assistant", "other")]
    frame = lambda rows: spark.createDataFrame([(*x, "p", 1) for x in rows], TURNS).repartition(3)
    rows = sorted(preference.preference_pairs(frame(c), frame(r)).collect(), key=lambda x: (x["pair_id"], x["page"], x["sub"]))
    one, two = [x for x in rows if x["pair_id"] == 1], [x for x in rows if x["pair_id"] == 2]
    render = lambda role, t: f"<|{role}|>\n{t}<|end|>\n"
    assert [x["page"] for x in one] == [0, 1, 2, 3] and len(two) > 3
    assert "".join(x["prompt"] for x in one) == render("user", "t0")
    assert "".join(x["chosen"] for x in one) == "".join(render("assistant" if i % 2 else "user", f"t{i}") for i in range(1, 200))
    assert "".join(x["rejected"] for x in one) == render("assistant", "other")
    assert sorted(m for x in two for s in x["chosen_spans"] for m in [x["chosen"][s["from"] : s["to"]]]) == [f"x{i:03}<|end|>\n" for i in range(300)]
    assert all(len(x["chosen_spans"]) < 130 for x in two)


def test_swapped_replies(spark):
    """The next conversation's reply, over gaps of ids; repeated rows stay as many as they are."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "A"), (1, 1, "assistant", "A"), (7, 0, "user", "b"), (7, 1, "assistant", "B"), (7, 1, "assistant", "B2"), (8, 0, "user", "none"), (90, 0, "assistant", "C"), (None, 0, "assistant", "lost")]
    got = Counter(tuple(r) for r in preference.swapped_replies(spark.createDataFrame(rows, "pair_id long, turn long, role string, text string").repartition(3)).collect())
    assert got == Counter([(1, 0, "user", "a"), (1, 1, "assistant", "B"), (1, 1, "assistant", "B2"), (7, 0, "user", "b"), (7, 1, "assistant", "C"), (8, 0, "user", "none"), (None, 0, "assistant", "lost")])
    many = spark.createDataFrame(rows * 40, "pair_id long, turn long, role string, text string")
    assert preference.swapped_replies(many).count() == 40 * sum(got.values())
