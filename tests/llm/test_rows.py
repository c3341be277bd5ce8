"""Filtering stages judge rows, not ids: null ids, repeated rows, and ids shared by different texts."""

from collections import Counter

from hard import hard_rows, text

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)


def left(step, spark, rows):
    return Counter((r.doc_id, r.text) for r in step(spark, docs_of(spark, rows), "").collect())


def test_language_stage(spark):
    rows = [(i, text(i)) for i in range(12)] + [(None, "12345"), (None, text(30)), (3, "67 8"), (5, None)]
    want = Counter(r for r in rows if r[1] not in ("12345", "67 8", None))
    assert left(corpus_pipeline.identify, spark, rows) == want


def test_exact_stage(spark):
    a, b, c, d = (text(i) for i in (1, 2, 3, 4))
    rows = [(1, a), (2, a), (None, a), (3, b), (3, b), (4, c), (4, d), (9, c), (None, "lost"), (None, "lost"), (7, "x"), (7, "y")]
    want = Counter([(2, a), (3, b), (9, c), (4, d), (None, "lost"), (7, "x"), (7, "y")])
    assert left(corpus_pipeline.dedup_exact, spark, rows) == want


def test_near_stage(spark):
    a, b, c = text(1, 60), text(2, 60), text(3, 60)
    rows = [(5, a), (2, a.upper()), (None, a + " "), (2, b), (8, b), (8, b), (8, c), (None, "lost words"), (None, "LOST words")]
    got = left(corpus_pipeline.dedup_near, spark, rows)
    assert sum(got.pop((None, t), 0) for t in ("lost words", "LOST words")) == 1
    assert got == Counter([(2, a.upper()), (2, b), (8, c)])


def test_whole_hard_rows(spark):
    """No text that the language stage or a dedup stage takes out comes back through a null or repeated id."""
    rows = [r[:2] for r in hard_rows()]
    docs = docs_of(spark, rows)
    for _, step in corpus_pipeline.STAGES[:3]:
        docs = step(spark, docs, "")
    got = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({t for _, t in got}) == len(got)
    assert {i for i, _ in got if i is None} == {None}  # only "lost", which has no id and no copy
    assert (None, "lost") in got and (None, hard_rows()[3][1]) not in got


def test_reserved_names(spark, tmp_path):
    """Columns with names that the row keys use, in memory and in files, come back as they were."""
    from coppice.llm import exact_dedup, language_id, near_dedup

    names = ["doc_id", "text", "lang", "source", "Coppice_Row", "coppice_tie", "coppice_path", "_coppice_row", "coppice_at"]
    rows = [(i, text(i % 9), "en", "s", 1, "t", "p", 3, i) for i in range(12)]
    docs = spark.createDataFrame(rows, names)
    docs.write.parquet(f"{tmp_path}/plain")
    docs.withColumnRenamed("coppice_at", "_metadata").write.parquet(f"{tmp_path}/meta")
    for given in (docs, spark.read.parquet(f"{tmp_path}/plain"), spark.read.parquet(f"{tmp_path}/meta")):
        for step, want in ((exact_dedup.drop_exact_copies, {*range(3, 12)}), (near_dedup.drop_near_copies, {*range(9)}), (language_id.drop_unidentified, {*range(12)})):
            got = step(given)
            assert got.columns == given.columns
            assert {r.doc_id for r in got.collect()} == want
