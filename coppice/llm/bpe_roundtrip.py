"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import maybe_broadcast, rows_of, ship, stage, table
from coppice.llm.token_counts import tokenizer

#: Chunks end where a rolling hash over WINDOW characters has its top CUT_BITS bits zero: about 1200 characters on average.
WINDOW, CUT_BITS, CHUNK_LEAST, CHUNK_MOST = 16, 10, 256, 8192
_MULTIPLIER = 0x9E3779B97F4A7C15
_BLOCK = 1 << 16
#: How tokens at the end of a piece are marked, and how an ASCII word falls into pieces: fixed values of the tokenizer.
END = "</w>"
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Words encoded in one call.
JOINED = 2000
#: Words of a generation whose ids a worker remembers; it keeps two.
CACHE_WORDS = 100_000


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_BLOCK + WINDOW, base, np.uint64)]), dtype=np.uint64)


_UP, _DOWN = _powers(_MULTIPLIER), _powers(pow(_MULTIPLIER, -1, 1 << 64))


def chunk_ends(text: str) -> list[int]:
    """Ends of the chunks of text. They depend on nearby characters only, so shared passages are cut alike."""
    n, out, last = len(text), [], 0
    if n > CHUNK_LEAST:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, n, _BLOCK):
            part = points[max(0, at - WINDOW) : at + _BLOCK].astype(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _DOWN[: len(part)], dtype=np.uint64)])
            hashes = (sums[WINDOW:] - sums[:-WINDOW]) * _UP[WINDOW - 1 : len(part)] * np.uint64(_MULTIPLIER)
            for end in (np.flatnonzero(hashes >> np.uint64(64 - CUT_BITS) == 0) + (WINDOW + max(0, at - WINDOW))).tolist():
                while end - last > CHUNK_MOST:
                    last += CHUNK_MOST
                    out.append(last)
                if end - last >= CHUNK_LEAST:
                    out.append(end)
                    last = end
    while n - last > CHUNK_MOST:
        last += CHUNK_MOST
        out.append(last)
    return [*out, n] if n > last else out


def plain(text: str) -> str:
    """Each ASCII white space as a blank: the tokenizer drops white space, whatever it is."""
    for c in "\t\n\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return text


def chunks(text: str) -> list[str]:
    text, at, out = plain(text), 0, []
    for end in chunk_ends(text):
        out.append(text[at:end])
        at = end
    return out


def key_of(chunk: str) -> tuple[int, int]:
    """A 128-bit hash as two signed longs: the first one finds a chunk, both together tell that it is the one."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass")))


class Words:
    """Ids of blank-delimited words by the tokenizers library, a bounded number of them remembered.

    Words whose pieces are plain to count go to the library joined by blanks, which is some
    three times as fast as one by one; each piece ends in a token that says so.
    """

    def __init__(self, path: str):
        self.tok, self.known, self.old = tokenizer(path), {}, {}
        self.last = np.array([(self.tok.id_to_token(i) or "").endswith(END) for i in range(self.tok.get_vocab_size())])
        self.narrow = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32

    def learn(self, words: set[str]) -> None:
        fresh = []
        for w in words:
            if w not in self.known:
                was = self.old.get(w)
                if was is None:
                    fresh.append(w)
                else:
                    self.known[w] = was
        if len(self.known) + len(fresh) > CACHE_WORDS:  # words of the last generation stay within reach once more
            self.old, self.known = self.known, {w: self.known[w] for w in words if w in self.known}
        joined, counts = [], []
        for w in fresh:
            if w.isalpha() and (w.isascii() or (unicodedata.is_normalized("NFC", w) and w.lower().isalpha())):
                counts.append(1)
                joined.append(w)
            elif w.isascii() and w.isprintable() and "<|" not in w:
                counts.append(len(_ASCII_PIECES.findall(w.lower())))
                joined.append(w)
            else:
                self.one(w)
        for at in range(0, len(joined), JOINED):
            part, pieces = joined[at : at + JOINED], np.array(counts[at : at + JOINED])
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != pieces.sum():  # not as counted: one by one, then
                for w in part:
                    self.one(w)
                continue
            stops = (4 * ends[np.cumsum(pieces) - 1]).tolist()
            raw, start = ids.tobytes(), 0
            for w, stop in zip(part, stops, strict=True):
                self.known[w] = raw[start:stop]
                start = stop

    def one(self, word: str) -> None:
        self.known[word] = np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, words: list[str]) -> bytes:
        known = self.known
        return b"".join([known[w] for w in words])


def _inner(chunk: str) -> tuple[str, str, str] | None:
    """What lies before the first blank, between first and last, and after the last; None without a blank."""
    first = chunk.find(" ")
    if first < 0:
        return None
    last = chunk.rfind(" ")
    return chunk[:first], chunk[first + 1 : last] if last > first else "", chunk[last + 1 :]


def _split(text: str) -> list[str]:
    return [w for w in text.split(" ") if w]


def _list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in rows_of(batches):
        owners, keys = [], []
        for doc_id, text in zip(ids, texts, strict=True):
            found = {key_of(c)[0] for c in chunks(text)}
            keys += found
            owners += [doc_id] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(keys, pa.int64())], ["id", "key"])


def _encode_owned(path: str):
    """Encodes the inner part of each chunk that its document is to encode for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        for texts, wanted in rows_of(batches, 64):
            found: dict[tuple[int, int], list[str]] = {}
            for text, keys in zip(texts, wanted, strict=True):
                need = set(keys)
                for c in chunks(text):
                    if (k := key_of(c))[0] in need:
                        part = _inner(c)
                        found[k] = _split(part[1]) if part else []
            words.learn({w for ws in found.values() for w in ws})
            coded = [np.frombuffer(words.ids(ws), "<u4").astype(words.narrow).tobytes() for ws in found.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(coded, pa.binary())], ["key", "check", "coded"]
            )

    return run


def _assemble(path: str):
    """Joins chunks: what is cut at a join is encoded again, widened until it ends at blanks on both sides, where encodings agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        names = [words.tok.id_to_token(i) or "" for i in range(words.tok.get_vocab_size())]
        for ids, texts, lent in rows_of(batches, 64):
            plans, same = [], []
            for i, (text, borrowed) in enumerate(zip(texts, lent, strict=True)):
                same.append(i > 0 and ids[i] is not None and ids[i] == ids[i - 1] and text == texts[i - 1])
                if same[-1]:  # rows come sorted by id: a repeated row has the result of the one before
                    plans.append(plans[-1])
                    continue
                have = {(b["key"], b["check"]): b["coded"] for b in borrowed or ()}
                plan, open_run, own = [], "", []
                for c in chunks(text):
                    part = _inner(c)
                    if part is None:
                        open_run += c
                        continue
                    if run := open_run + part[0]:
                        own.append(run)
                    if part[1]:
                        coded = have.get(key_of(c)) if have else None
                        if coded is None:
                            own += _split(part[1])
                        else:
                            plan.append((own, coded))
                            own = []
                    open_run = part[2]
                if open_run:
                    own.append(open_run)
                plan.append((own, b""))
                plans.append(plan)
            words.learn({w for plan in plans for own, _ in plan for w in own})
            coded, decoded = [], []
            for again, plan in zip(same, plans, strict=True):
                if again:
                    coded.append(coded[-1])
                    decoded.append(decoded[-1])
                    continue
                coded.append(b"".join(words.ids(own) + np.frombuffer(c, words.narrow).astype("<u4").tobytes() for own, c in plan))
                decoded.append(" ".join([names[i] for i in np.frombuffer(coded[-1], "<u4").tolist()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(coded, pa.binary()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return run


def bpe_roundtrip(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded for every row.

    For tokenizers that drop white space and have no decoder of their own (decoding joins
    token strings by blanks). Texts are cut by a rolling hash; a chunk that occurs under more
    than one id is encoded once, by the smallest id that has it, and joined to the rest.
    The final pass looks chunks up by a 128-bit hash of their content and encodes what it is
    not lent, so results never depend on which chunks are shared.

    Null text counts as empty (no ids, decoded ''); repeated rows and null ids are rows like
    any other (null ids are lent nothing, and their chunks are not listed); a very long text is cut like any other; an empty
    table gives no rows; ids are integers; other columns are not read.

    Scale: chunk keys are counted with map-side sums; a chunk in very many documents is a hot
    key of the join to the encoded chunks, where both sides come from exchanges AQE may split.
    Texts cross one shuffle, to meet what their document is lent; those that are lent nothing
    stay where they are, as long as the ids of the others are few enough to broadcast.
    """
    ship(docs.sparkSession)
    clean = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    listed = stage(clean.filter("id is not null").mapInArrow(_list_chunks, "id long, key long"))
    shared = stage(listed.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter("id < last").select("key", "id"))
    owners = shared.groupBy("id").agg(F.collect_list("key").alias("keys"))  # a document's own chunks
    owners, _ = maybe_broadcast(owners, 300_000)
    encoded = stage(clean.join(owners, "id").select("text", "keys").mapInArrow(_encode_owned(tokenizer_file), "key long, check long, coded binary"))
    keys, _ = maybe_broadcast(shared.select("key"))
    pairs = stage(listed.join(keys, "key", "left_semi"))
    lent = pairs.join(encoded, "key").groupBy("id").agg(F.collect_set(F.struct("key", "check", "coded")).alias("lent"))
    ids, small = maybe_broadcast(pairs.select("id").distinct())
    if small:  # documents that are lent nothing need not move
        meet = clean.join(ids, "id", "left_semi").join(lent, "id", "left").select("id", "text", "lent")
        rows = meet.union(clean.join(ids, "id", "left_anti").select("id", "text", F.lit(None).cast(meet.schema["lent"].dataType)))
    else:
        # rows without an id would all meet in one task of the join
        rows = clean.filter("id is not null").join(lent, "id", "left").select("id", "text", "lent")
        rows = rows.union(clean.filter("id is null").select("id", "text", F.lit(None).cast(rows.schema["lent"].dataType)))
    return rows.mapInArrow(_assemble(tokenizer_file), "doc_id long, n_tokens long, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(bpe_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
