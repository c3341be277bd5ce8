"""Token counts and the BPE round trip against the tokenizers library on hard rows."""

import hashlib

import numpy as np
import public_tokenizers
from hard import hard_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coppice.llm import bpe_roundtrip, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_counts(hard):
    tok = Tokenizer.from_file(BYTE)
    want = []
    for r in hard_rows():
        t = r[1] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want.append((r[0], len(t.encode()), n, n > 512))
    assert order(token_counts.token_counts(hard, BYTE).collect()) == order(want)


def test_equal_blocks_stay_apart(spark, hard):
    """The same rows twice in other tasks, and null-id rows of one word each in tasks of their own."""
    tok = Tokenizer.from_file(BYTE)
    once = order(token_counts.token_counts(hard, BYTE).collect())
    assert order(token_counts.token_counts(hard.union(hard), BYTE).collect()) == order(once + once)
    long_ = "internationalisation " * 9
    lone = spark.createDataFrame([(None, "one")], "doc_id long, text string").union(spark.createDataFrame([(None, long_)], "doc_id long, text string"))
    want = [(None, len(t), len(tok.encode(t, add_special_tokens=False).ids), False) for t in ("one", long_)]
    assert order(token_counts.token_counts(lone, BYTE).collect()) == order(want)


def test_counts_in_many_blocks(hard, monkeypatch):
    """Blocks of a text each, many buckets."""
    want = order(token_counts.token_counts(hard, BYTE).collect())
    monkeypatch.setattr(token_counts, "BUCKETS_LEAST", 200)
    assert order(token_counts.token_counts(hard, BYTE).collect()) == want


def test_roundtrip(hard):
    tok = Tokenizer.from_file(WORD)
    want = []
    for r in hard_rows():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert order(bpe_roundtrip.digests(bpe_roundtrip.bpe_roundtrip(hard, WORD)).collect()) == order(want)


def test_roundtrip_by_shuffled_path(hard, monkeypatch):
    """Beyond the broadcast bounds the answer is the same."""
    want = order(bpe_roundtrip.digests(bpe_roundtrip.bpe_roundtrip(hard, WORD)).collect())
    monkeypatch.setattr(bpe_roundtrip, "maybe_broadcast", lambda df, *a: (df, False))
    assert order(bpe_roundtrip.digests(bpe_roundtrip.bpe_roundtrip(hard, WORD)).collect()) == want


def test_empty(none):
    assert token_counts.token_counts(none, BYTE).count() == 0
    assert bpe_roundtrip.bpe_roundtrip(none, WORD).count() == 0


TEXTS = st.text(st.sampled_from(list("aZ é\n\t  .,'s0  \x1c<|endoftext|>日́")), max_size=80)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_pre_tokens_add_up(text):
    tok = token_counts.tokenizer(BYTE)
    parts = token_counts.pre_tokens(text)
    assert "".join(parts) == text
    assert sum(len(e) for e in tok.encode_batch(parts, add_special_tokens=False)) == len(tok.encode(text, add_special_tokens=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=12))
def test_chunks_join_to_the_text(parts):
    text = "".join(p * 40 for p in parts)
    made = bpe_roundtrip.chunks(text)
    assert "".join(made) == bpe_roundtrip.plain(text)
    assert all(0 < len(c) <= bpe_roundtrip.CHUNK_MOST for c in made)


def test_shared_passages_are_cut_alike():
    passage = " ".join(f"word{i}" for i in range(2000))
    a, b = bpe_roundtrip.chunks("short start " + passage), bpe_roundtrip.chunks("another, longer start of the text " * 30 + passage)
    assert len(set(a) & set(b)) > len(a) * 0.8


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZé'st0,.!İß日<|endoftext|>\x1ć-")), min_size=1, max_size=9), max_size=30))
def test_words_are_as_the_library_has_them(words):
    """Joined by blanks or one by one, and with a cache of two words a generation."""
    words = [w for w in words if w]
    made = bpe_roundtrip.Words(WORD)
    for at in range(0, len(words), 5):
        made.learn(set(words[at : at + 5]))
        got = np.frombuffer(made.ids(words[at : at + 5]), "<u4").tolist()
        assert got == [i for w in words[at : at + 5] for i in made.tok.encode(w, add_special_tokens=False).ids]


def test_small_cache(monkeypatch):
    monkeypatch.setattr(bpe_roundtrip, "CACHE_WORDS", 2)
    made, words = bpe_roundtrip.Words(WORD), ["one", "two", "three", "one", "four", "two"]
    for w in words:
        made.learn({w, "one"})
        assert made.ids([w]) == np.array(made.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
