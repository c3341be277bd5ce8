"""The pipeline against the same steps in plain Python."""

import hashlib
import math
import os
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_near import edited, plain_kept
from test_others import plain_poisson
from tokenizers import Tokenizer

import corpus_pipeline
from coppice.llm import language_id, poisson_mix


def draws(doc_id, rate):
    u = (int(hashlib.md5(f"{poisson_mix.SEED}|{doc_id}|1".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    return plain_poisson(u, rate)


def test_pipeline(spark, tmp_path):
    """Rows are told apart by their place, as ids are null or shared in some."""
    from hard import hard_rows, text

    rows = [r[:5] for r in hard_rows()] + [(100 + i, text(i, 30 + i % 40), "en", f"s{i % 4}", 1) for i in range(80)] + [(300 + i, text(i, 30 + i % 40), "en", "s1", 1) for i in range(10)]
    rows += [(400 + i, edited(text(60 + i, 90), 1, i), "en", "s2", 1) for i in range(6)] + [(420 + i, text(60 + i, 90), "en", "s2", 1) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    # names that the stages use for themselves
    docs.withColumns({"coppice_row": docs["doc_id"], "coppice_path": docs["text"]}).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    numbered = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], schema)
    said = {r["doc_id"]: r for r in language_id.language_id(numbered, language_id.learned_on_folds(docs)).collect()}
    kept = [r for i, r in enumerate(rows) if said[i]["lang_pred"] != "und" and said[i]["score"] >= language_id.SCORE_LEAST]
    last = {}
    for r in kept:
        if r[1] not in last or (r[0] is not None and (last[r[1]][0] is None or last[r[1]][0] < r[0])):
            last[r[1]] = r
    kept = sorted(last.values(), key=lambda r: (r[0] is None, r[0] or 0))  # the smallest id of a component comes first, a null id last
    near = plain_kept([(i, r[1]) for i, r in enumerate(kept)])
    assert len(near) < len(kept)
    kept = [r for i, r in enumerate(kept) if i in near]
    mass = defaultdict(int)
    for r in kept:
        mass[r[3]] += len(r[1].encode()) + 1
    whole = sum(m**poisson_mix.ALPHA for m in mass.values())
    rate = {s: round(sum(mass.values()) * m**poisson_mix.ALPHA / whole / m, 6) for s, m in mass.items()}
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in kept:
        ids = tok.encode(r[1], add_special_tokens=False).ids
        line = (r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want[line] += draws("null" if r[0] is None else r[0], rate[r[3]])
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want
    assert math.isclose(sum(got.values()), sum(want.values()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "poisson_mix", "bpe_roundtrip"]
