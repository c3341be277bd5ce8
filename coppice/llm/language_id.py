"""Language ID by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import ROW, drop_rows, rows_of, ship, stage, table, with_rows

#: Width of the vectors, letters in an n-gram, and classes of letters (0 is the gap between words).
DIM, GRAM, CLASSES, SEED = 512, 3, 40, 11
#: Characters taken at a time; a longer text is summed over several turns.
BLOCK_CHARS = 1 << 20
GRAMS = CLASSES**GRAM
#: A document whose cosine with every profile is lower is like none of them.
SCORE_LEAST = 0.05
#: Profiles are broadcast: this many languages are 20 MB.
LANGUAGES_MOST = 10_000

_made: dict = {}


def _letters() -> np.ndarray:
    """Class of each code point below 0x3000: a-z without case are 1 to 26, other letters share the rest by number."""
    if "letters" not in _made:
        out = np.zeros(0x3000, np.int64)
        for p in range(0x3000):
            c = chr(p)
            if c.isalpha():
                low = c.lower()[0]
                out[p] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) % (CLASSES - 27))
        _made["letters"] = out
    return _made["letters"]


def letter_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table_ = _letters()
    if len(points) and points.max() >= len(table_):
        out = np.zeros(len(points), np.int64)
        low = points < len(table_)
        out[low] = table_[points[low]]
        far = np.flatnonzero(~low)
        out[far] = [27 + (ord(text[i]) % (CLASSES - 27)) if text[i].isalpha() else 0 for i in far.tolist()]
        return out
    return table_[points]


def gram_vectors() -> np.ndarray:
    """One +1/-1 vector an n-gram: the letters' random vectors, each rolled by its place, multiplied together."""
    if "grams" not in _made:
        letters = np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIM), np.int8) * 2 - 1
        out = np.ones((1, DIM), np.int8)
        for place in range(GRAM):
            rolled = np.roll(letters, GRAM - 1 - place, axis=1)
            out = (out[:, None, :] * rolled[None, :, :]).reshape(-1, DIM)
        _made["grams"] = out
    return _made["grams"]


def grams_of(text: str) -> Iterator[np.ndarray]:
    """Codes of the n-grams that touch a letter in their middle, a block of the text at a time."""
    for at in range(0, len(text), BLOCK_CHARS):
        c = letter_classes(" " * (at == 0) + text[max(0, at - 2) : at + BLOCK_CHARS] + " " * (at + BLOCK_CHARS >= len(text)))
        codes = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        yield codes[c[1:-1] > 0]


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(documents x n-grams seen) counts, and the n-grams seen."""
    rows, codes = [], []
    small = np.zeros((len(texts), 0))
    for i, text in enumerate(texts):
        for part in grams_of(text):
            if len(text) > BLOCK_CHARS:  # keep a very long text as counts
                part, n = np.unique(part, return_counts=True)
                codes.append(part)
                rows.append(np.stack([np.full(len(part), i), n]))
            else:
                codes.append(part)
                rows.append(np.stack([np.full(len(part), i), np.ones(len(part), np.int64)]))
    if not codes:
        return small, np.empty(0, np.int64)
    codes, (rows, weight) = np.concatenate(codes), np.concatenate(rows, axis=1)
    seen = np.flatnonzero(np.bincount(codes, minlength=GRAMS))
    column = np.zeros(GRAMS, np.int64)
    column[seen] = np.arange(len(seen))
    flat = np.bincount(rows * len(seen) + column[codes], weights=weight, minlength=len(texts) * len(seen))
    return flat.reshape(len(texts), len(seen)).astype(np.float32), seen


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the summed vectors of each language."""
    sums: dict[str, np.ndarray] = {}
    for texts, langs in rows_of(batches, 128):
        counts, seen = _counts(texts)
        if not len(seen):
            continue
        by = sorted(set(langs))
        pick = np.zeros((len(by), len(texts)), np.float32)
        pick[[by.index(x) for x in langs], np.arange(len(texts))] = 1
        made = (pick @ counts).astype(np.float64) @ gram_vectors()[seen].astype(np.float64)
        for lang, v in zip(by, made, strict=True):
            sums[lang] = sums[lang] + v if lang in sums else v
    if sums:
        n = len(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(list(sums), DIM), pa.string()), pa.array(np.tile(np.arange(DIM, dtype=np.int32), n)), pa.array(np.concatenate(list(sums.values())))], ["lang", "place", "value"]
        )


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A bundled vector for each non-null language. Tasks sum their own documents first; the driver gets one vector a language."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = rows.mapInArrow(_bundle, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value")))["value"].alias("v"))
    found = vectors.orderBy("lang").limit(LANGUAGES_MOST + 1).collect()
    if len(found) > LANGUAGES_MOST:
        raise ValueError(f"more than {LANGUAGES_MOST} languages")
    return {r["lang"]: np.array(r["v"]) for r in found}


def _predict(names: list[str], profiles: np.ndarray):
    unit = (profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            counts, seen = _counts([t or "" for t in texts])
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if len(seen) and len(names):
                vectors = counts @ gram_vectors()[seen].astype(np.float32)
                norm = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ unit.T) / np.maximum(norm, 1e-9)[:, None]
                best = cosines.argmax(1)
                has = counts.sum(1) > 0
                lang = [names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                score = np.where(has, np.clip(cosines.max(1), 0, 1), 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (cosine with the nearest profile, 0 at least) for every row.

    `und` with score 0 if text is null or has no letter, or if nothing was learned. Ties go to
    the language that sorts first. A very long text is read whole, a block at a time. Repeated
    rows and null ids are rows like any other; an empty table gives no rows; ids are integers;
    other columns are not read.

    Scale: one pass, no shuffle. The model is one vector of 512 numbers a language.
    """
    ship(docs.sparkSession)
    names = sorted(profiles)
    matrix = np.stack([profiles[n] for n in names]) if names else np.zeros((0, DIM))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _predict(names, matrix), "doc_id long, lang_pred string, score double"
    )


def fold(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def learned_on_folds(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from the rows outside fold 2 of 4; rows with a null id are never learned from."""
    return learn_profiles(docs.filter(fold("doc_id", 4) != 2))


def drop_unidentified(docs: DataFrame, least: float = SCORE_LEAST) -> DataFrame:
    """docs without the texts that have no letter or are like no learned language; all columns stay.

    Rows are judged one by one by a key of their own: null, shared and repeated ids make no
    difference, and a copy of a rejected text goes as well. An empty table stays empty.
    """
    rows = with_rows(docs)
    said = language_id(rows, learned_on_folds(rows), id_col=ROW)
    return drop_rows(rows, stage(said.filter((F.col("lang_pred") == "und") | (F.col("score") < least)).select(F.col("doc_id").alias(ROW))), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id(docs, learned_on_folds(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
