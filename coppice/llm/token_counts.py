"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import rows_of, ship, stage, table

OVER = 512
#: Texts are packed in blocks of about so many characters; a longer text is a block of its own.
BLOCK_CHARS = 12_000_000
#: Distinct pre-tokens are dealt by hash over buckets; one bucket for each so many input bytes.
BUCKET_BYTES = 4_000_000
BUCKETS_LEAST = 24

#: Characters that \\s matches in the tokenizer's own pattern (Unicode White_Space): fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
_PIECES = re.compile(f"[{SPACE}]+[^{SPACE}]*|[^{SPACE}]+")
_RUN = re.compile(f"[{SPACE}](?= |\n)|[ \n](?=[{SPACE}])|\0")
_loaded: dict = {}


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[path] = tok
    return _loaded[path]


def pre_tokens(text: str) -> list[str]:
    """Cuts text wherever a space follows a non-space.

    A byte-level pattern never joins a non-space to a space after it, so the token counts of
    the parts add up to that of the text. (The quick way gives the same parts but for
    other spaces than blank and newline, which then stay inside a part.)
    """
    if _RUN.search(text):
        return _PIECES.findall(text)
    parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return parts if parts[0] else parts[1:]


def _bucket(part: str, buckets: int) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % buckets


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(n).astype(np.int64)


def _pack(buckets: int):
    """Blocks of documents: a row of packed frequencies for each block, and a row of its distinct pre-tokens for each bucket."""

    def block(name: int, ids: list, sizes: list, seen: dict[str, int], freqs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        parts = list(seen)
        home = np.fromiter((_bucket(p, buckets) for p in parts), np.int32, len(parts))
        order = np.argsort(home, kind="stable")
        place = np.empty(len(parts), np.uint32)
        place[order] = np.arange(len(parts), dtype=np.uint32)
        each = np.array([len(x[0]) for x in freqs], np.int64)
        index = place[np.concatenate([x[0] for x in freqs])].astype(np.int64)
        freq = np.concatenate([x[1] for x in freqs])
        sort = np.lexsort((index, np.repeat(np.arange(len(ids)), each)))
        index, freq = index[sort], freq[sort]
        first = (np.cumsum(each) - each)[each > 0]
        gaps = np.diff(index, prepend=0)
        gaps[first] = index[first]
        # gaps of sorted indices, stored byte plane by byte plane, pack to half the size of the indices
        matrix = zlib.compress(b"".join([np.array([len(ids), len(index)], np.uint64).tobytes(), _planes(each), _planes(gaps), _planes(freq)]), 1)
        out = [(name, -1, ids, sizes, matrix)]
        # only buckets that occur in the block: at most one a distinct pre-token
        cut = np.flatnonzero(np.diff(home[order], prepend=-1))
        for lo, hi in zip(cut, np.append(cut, len(order))[1:], strict=True):
            payload = "\0".join(parts[i].replace("\x01", "\x01b").replace("\0", "\x01a") for i in order[lo:hi])
            out.append((name, int(home[order[lo]]), None, None, zlib.compress(payload.encode("utf-8", "surrogatepass"), 1)))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())],
            ["block", "bucket", "ids", "sizes", "payload"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # partition and number name a block: no two blocks share a name, whatever they hold
        name = TaskContext.get().partitionId() << 32
        ids, sizes, seen, freqs, chars = [], [], {}, [], 0
        for doc_ids, texts in rows_of(batches):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                if ids and chars + len(text) > BLOCK_CHARS:
                    yield block(name, ids, sizes, seen, freqs)
                    name += 1
                    ids, sizes, seen, freqs, chars = [], [], {}, [], 0
                parts = pre_tokens(text)
                got = np.fromiter((seen.setdefault(p, len(seen)) for p in parts), np.int64, len(parts))
                freqs.append(np.unique(got, return_counts=True))
                ids.append(doc_id)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                chars += len(text)
        if ids:
            yield block(name, ids, sizes, seen, freqs)

    return run


def _count(path: str):
    """Counts each distinct pre-token of a bucket once, and answers every block that asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        known: dict[int, dict[str, int]] = {}
        for names, buckets, payloads in rows_of(batches, 16):
            out = []
            for name, b, payload in zip(names, buckets, payloads, strict=True):
                parts = [p.replace("\x01a", "\0").replace("\x01b", "\x01") if "\x01" in p else p for p in zlib.decompress(payload).decode("utf-8", "surrogatepass").split("\0")]
                have = known.setdefault(b, {})
                fresh = [p for p in parts if p not in have]
                have.update(zip(fresh, (len(e) for e in tok.encode_batch(fresh, add_special_tokens=False)), strict=True))
                counts = np.fromiter((have[p] for p in parts), np.uint32, len(parts))
                out.append((name, b, zlib.compress(counts.tobytes(), 1)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["block", "bucket", "counts"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sizes, matrices, answers in rows_of(batches, 1):
        raw = zlib.decompress(matrices[0])
        n, m = (int(x) for x in np.frombuffer(raw, np.uint64, 2))
        each, gaps, freq = (_from_planes(raw, k, 16 + 4 * at) for k, at in ((n, 0), (m, n), (m, n + m)))
        index = np.cumsum(gaps)
        first = (np.cumsum(each) - each)[each > 0]
        index -= np.repeat(index[first] - gaps[first], each[each > 0])
        counts = [np.frombuffer(zlib.decompress(a["counts"]), np.uint32) for a in sorted(answers[0] or [], key=lambda a: a["bucket"])]
        counts = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(counts[index] * freq)])
        ends = np.cumsum(each)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[0], pa.int64()), pa.array(sizes[0], pa.int64()), pa.array(sums[ends] - sums[ends - each], pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, as the byte-level tokenizer file's own library counts.

    A pre-token here is a run of space with the non-space after it: the library's own pieces
    never cross such a cut. Blocks of documents keep their pre-token frequencies as packed
    sparse rows; distinct pre-tokens travel to hash buckets, are counted there once, and
    their counts travel back to the blocks. Ids are never kept.

    Null text counts as empty (0 tokens); repeated rows and null ids are rows like any other;
    special strings in a text are special tokens, as is the library's default; an empty table
    gives no rows; ids must be integers; columns other than id and text are not read. A text
    longer than a block is a block of its own, counted whole.

    A block is named by the partition and the place where it was made, and written before it is
    read, so equal blocks stay apart.

    Scale: blocks hold about 12 MB of text and buckets grow in number with the input, so no
    task holds more than its share. A very common pre-token arrives once a block.
    """
    ship(docs.sparkSession)
    clean = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(BUCKETS_LEAST, int(size // BUCKET_BYTES))
    packed = stage(clean.mapInArrow(_pack(buckets), "block long, bucket int, ids array<long>, sizes array<long>, payload binary"))
    asked = packed.filter("bucket >= 0").select("block", "bucket", "payload").repartition("bucket")
    counted = asked.mapInArrow(_count(tokenizer_file), "block long, bucket int, counts binary")
    answers = counted.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))  # at most one a bucket, 12 MB of text a block
    blocks = packed.filter("bucket < 0").select("block", "ids", "sizes", F.col("payload").alias("matrix"))
    out = blocks.join(answers, "block", "left").select("ids", "sizes", "matrix", "answers").mapInArrow(_total, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > over)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
