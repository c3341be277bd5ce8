"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import rows_of, ship, stage, table
from coppice.llm.language_id import fold

#: Hashed features; weights are 4 bytes each.
SLOTS = 1 << 19
#: FTRL-proximal: learning rate, its smoothing, L1 and L2. Chosen by cross-validation inside the learned folds.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 16.0, 0.1
#: What the logarithm of a feature's rareness is divided by.
RARE = 4.0
#: A stem comes densely from one in so many words on.
DENSE = 256
EPOCHS = 4
#: The fit takes about this many labelled rows at most, chosen by a hash of their ids. They are read by one task.
ROWS_MOST = 12_000
THRESHOLD = 0.7
#: Inflected words share their first letters; each word also counts under this many of them.
STEM = 4
#: Words taken at a time from a long text.
WORD_BLOCK = 100_000

_WORD = re.compile(r"[^\W_]+")
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - 19)).astype(np.int64)


def features(text: str) -> Iterator[np.ndarray]:
    """Slots of the words, of their stems, of neighbouring pairs, of pairs with one word between, a block of words at a time; then of the stems that come densely.

    A stem comes densely if two different words have it (or, as another feature, two words do)
    and one in DENSE words or more.
    """
    words = _WORD.findall(text.lower())
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words), WORD_BLOCK):
        h = np.array([digest(w) for w in words[at : at + WORD_BLOCK + 2]], np.uint64)
        stems = np.array([digest(w[:STEM], 1) for w in words[at : at + WORD_BLOCK + 2]], np.uint64)
        yield np.concatenate([_slots(h), _slots(stems), _slots(h[:-1] * _PAIR + h[1:]), _slots(h[:-2] * _SKIP + h[2:])])
    least = max(2, -(-len(words) // DENSE))
    found = []
    for seed, counts in ((2, Counter(w[:STEM] for w in set(words))), (3, Counter(w[:STEM] for w in words))):
        found += [digest(stem, seed) for stem, n in counts.items() if n >= least]
    if found:
        yield _slots(np.array(found, np.uint64))


def distinct(text: str) -> np.ndarray:
    found = list(features(text))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes in a fixed random order; the rarer class is weighted up to balance.

    A feature's value is the logarithm of how rare it is among the rows, over RARE, so that
    rare words can carry a verdict and frequent ones hardly count; weights come multiplied by it.
    """
    z, n, bias, bias_n, seen = np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0, np.zeros(SLOTS)
    labels = np.array([y for _, y in rows])
    for x, _ in rows:
        seen[x] += 1
    value = np.log((1 + len(rows)) / (1 + seen)) / RARE
    share = max(labels.mean(), 1e-6) if len(rows) else 0.5
    rise = {1: min(0.5 / share, 10.0), 0: min(0.5 / max(1 - share, 1e-6), 10.0)}
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(seed + epoch).permutation(len(rows)).tolist():
            x, y = rows[i]
            zi, ni, vi = z[x], n[x], value[x]
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip((w * vi).sum() + bias, -35, 35)))
            loss = (p - y) * rise[y]
            g = loss * vi
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g
            bias_n += loss * loss
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * loss
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)) * value, bias


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(i, distinct(t), y) for ids, texts, labels in rows_of(batches) for i, t, y in zip(ids, texts, labels, strict=True)]
    found.sort(key=lambda r: (r[0], r[2], r[1].tobytes()))  # the order of arrival says nothing
    weights, bias = ftrl([(x, y) for _, x, y in found])
    used = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([[-1], used]), pa.int64()), pa.array(np.concatenate([[bias], weights[used]]), pa.float64())], ["slot", "weight"]
    )


def learn_toxicity(docs: DataFrame, labels: DataFrame, rows_most: int = ROWS_MOST, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[int, float]:
    """Sparse weights (slot -1 is the bias) from rows whose label is 0 or 1.

    At most about rows_most labelled rows, by a hash of their ids, half of them of either label
    as far as there are as many; the driver gets at most SLOTS weights, whatever the input. An
    id with both labels counts as toxic; labels of a null id, and null labels, are left out;
    rows that share a labelled id all count. Without labels the bias is all there is.
    """
    ship(docs.sparkSession)
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = stage(marked.filter("id is not null").groupBy("id").agg(F.max("label").alias("label")))
    chosen = bounded_sample(marked, rows_most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "label")  # rows_most rows of 12 bytes
    fit = rows.repartition(1).mapInArrow(_fit, "slot long, weight double").collect()
    return {r["slot"]: r["weight"] for r in fit}


def bounded_sample(marked: DataFrame, rows_most: int) -> DataFrame:
    """About rows_most rows at most, by a hash of their ids: of each label half of them, or all where there are fewer; what one label leaves free the other may take."""
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    zero, one = counts.get(0, 0), counts.get(1, 0)
    want = {1: min(one, max(rows_most // 2, rows_most - zero)), 0: min(zero, max(rows_most // 2, rows_most - one))}
    if zero + one <= rows_most:
        return marked
    place = F.xxhash64("id", F.lit("toxicity"))  # even over the whole range of 64 bits
    keep = F.lit(False)
    for label, n in want.items():
        share = n / max(1, counts.get(label, 0))
        bar = min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)) if share < 1 else (1 << 63) - 1
        keep = keep | ((F.col("label") == label) & (place <= F.lit(bar)))
    return marked.filter(keep)


def _score(model: dict[int, float]):
    bias = model.get(-1, 0.0)
    slots = np.array([s for s in model if s >= 0], np.int64)
    values = np.array([model[s] for s in slots.tolist()], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(SLOTS, np.float32)
        weights[slots] = values
        for ids, texts in rows_of(batches):
            sums = np.full(len(texts), bias)
            for i, text in enumerate(texts):
                hit = [x[weights[x] != 0] for x in features(text)]  # only what carries weight
                if hit:
                    sums[i] += weights[np.unique(np.concatenate(hit))].sum(dtype=np.float64)
            score = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: dict[int, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) for every row.

    Features are presences over the whole text, however long. Null text counts as empty and
    scores the bias alone; repeated rows and null ids are rows like any other; an empty table
    gives no rows; ids are integers; other columns are not read.

    Scale: one pass, no shuffle. The weights are sparse and at most 2 ** 19.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = fold("doc_id", 3) != 1
    out = toxicity(docs, learn_toxicity(docs.filter(learned), labels.filter(learned)))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
