"""Repeated byte spans: matches by neighbours in suffix order, for anchors, then classes of starts, then single starts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import rows_of, ship, stage, table

#: Bytes that two places must have in common.
LENGTH = 200
#: Anchors are the least hashed strings of so many bytes in each window of LENGTH bytes; equal windows have equal anchors.
ANCHOR = 64
#: Starts that lie so near to each other, counted from their anchor, are a class.
CLASS = 16
#: How hard texts are packed.
LEVEL = 6
#: Texts are packed in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Starts that are hashed at a time.
TILE = 1 << 18
#: Keys are dealt by their leading bits over buckets: one for each so many input bytes, a power of two, at least.
BUCKET_BYTES, BITS_LEAST, BITS_MOST = 8_000_000, 6, 31

_made: dict = {}


def _powers(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number a byte value, and powers of an odd base and of its inverse modulo 2 ** 64."""
    if which not in _made:
        rng = np.random.default_rng(12 + which)
        values = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 1 << 61)) * 8 + 5
        steps = np.full(TILE + 2 * LENGTH, base, np.uint64)
        steps[0] = 1
        back = np.full(TILE + 2 * LENGTH, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        _made[which] = values, np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _made[which]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _sums(t: np.ndarray, which: int) -> np.ndarray:
    values, powers, _ = _powers(which)
    out = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(values[t] * powers[: len(t)], out=out[1:])
    return out


def hashes(t: np.ndarray, at: np.ndarray, width: int | np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the strings of width bytes at ascending places, a tile at a time."""
    out = np.empty(len(at), np.uint64)
    back, wide = _powers(which)[2], np.broadcast_to(width, at.shape)
    for begin in range(0, len(t), TILE):
        lo, hi = np.searchsorted(at, [begin, begin + TILE])
        if lo < hi:
            sums, here = _sums(t[begin : begin + TILE + 2 * LENGTH], which), at[lo:hi] - begin
            out[lo:hi] = _mixed((sums[here + wide[lo:hi]] - sums[here]) * back[here])
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of width values."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _starts(ends: np.ndarray, length: int) -> np.ndarray:
    """Which places of concatenated documents start a string of that length within their document."""
    out = np.ones(ends[-1] if len(ends) else 0, bool)
    for begin, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        out[max(begin, end - length + 1) : end] = False
    return out


def anchors(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated documents, for each run of starts with one anchor: its place, the hash of its ANCHOR bytes, the first and last start.

    Tiles overlap by a window, so a long document is seen whole, with memory for a tile.
    """
    valid, found = _starts(ends, LENGTH), []
    for at in range(0, len(t) - LENGTH + 1, TILE):
        part = t[at : at + TILE + LENGTH - 1]
        s = np.flatnonzero(valid[at : at + len(part) - LENGTH + 1])
        if not len(s):
            continue
        sums = _sums(part, 0)
        grams = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * _powers(0)[2][: len(sums) - ANCHOR])
        # the least by 44 bits, then the leftmost: what a window chooses depends on the window alone
        least = _least((grams >> np.uint64(20) << np.uint64(20)) | np.arange(len(grams), dtype=np.uint64), LENGTH - ANCHOR + 1)
        chosen = (least[s] & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(s, prepend=-2) != 1))
        last = np.concatenate([first[1:], [len(s)]]) - 1
        found.append((chosen[first] + at, grams[chosen[first]], s[first] + at, s[last] + at))
    if not found:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def classes(t: np.ndarray, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts cut into classes of CLASS by their distance to the anchor: first and last start, inner and outer hash.

    The inner hash is of the bytes that all starts of a class would share: where two starts
    match, the inner hashes of their classes are equal. The outer hash is of all bytes from the
    first start on, and of where the run lies: where two are equal, every start of one class has a match.
    """
    low, high = (anchor - hi) // CLASS, (anchor - lo) // CLASS
    each = high - low + 1
    of = np.repeat(np.arange(len(each)), each)
    number = high[of] - (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each))  # from the far class to the near, so starts ascend
    base = anchor[of] - CLASS * number
    first, last = np.maximum(lo[of], base - CLASS + 1), np.minimum(hi[of], base)
    up = np.argsort(base, kind="stable")
    inner = np.empty(len(base), np.uint64)
    inner[up] = hashes(t, base[up], LENGTH - CLASS + 1)
    outer = hashes(t, first, last - first + LENGTH)
    outer ^= (((base - first) * (2 * LENGTH) + (last - first)) * CLASS + number % CLASS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return first, last, inner, _mixed(outer)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of ascending runs."""
    each = last - first + 1
    return np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())


class Order:
    """Suffixes, given in text order, in the order of their keys and then of their places.

    A key stands for a prefix, so suffixes with that prefix in common form a run. Inside it the
    previous smaller place is the entry before, the next greater one the entry after: `earlier`
    and `later` say whether they are there.
    """

    def __init__(self, *keys: np.ndarray) -> None:
        n = len(keys[0])
        self.order = np.lexsort(keys[::-1])
        same = np.ones(max(n - 1, 0), bool)
        for k in keys:
            same &= k[self.order[1:]] == k[self.order[:-1]]
        self.earlier, self.later = np.zeros(n, bool), np.zeros(n, bool)
        self.earlier[self.order[1:]], self.later[self.order[:-1]] = same, same
        #: Where a run begins in the order; one suffix of each run; for each suffix the number of its run.
        self.begins = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), ~same]))
        self.firsts = self.order[self.begins]
        self.number = np.empty(n, np.int64)
        self.number[self.order] = np.repeat(np.arange(len(self.begins)), np.diff(self.begins, append=n))

    def any(self, flags: np.ndarray) -> np.ndarray:
        """For each run, whether a suffix in it has the flag."""
        return np.logical_or.reduceat(flags[self.order], self.begins) if len(self.begins) else np.empty(0, bool)


def _short(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket, and the next 32 bits: enough to sift by, as what passes is looked at again."""
    return x >> np.uint64(64 - bits), (x << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)


def _start_keys(t: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket, and the next 64 bits of a 96-bit hash of LENGTH bytes."""
    a, b = hashes(t, at, LENGTH), hashes(t, at, LENGTH, 1)
    return a >> np.uint64(64 - bits), (a << np.uint64(bits)) | (b >> np.uint64(64 - bits))


#: What is asked for: anchors, classes of starts, single starts; and the fields of a question besides its bucket.
ANCHORS, CLASSES, STARTS = range(3)
FIELDS = {ANCHORS: (np.uint32,), CLASSES: (np.uint32, np.uint64, np.bool_), STARTS: (np.uint64,)}


def _questions(block: int, kind: int, home: np.ndarray, *fields: np.ndarray) -> Iterator[tuple]:
    """A row (block, kind, bucket, payload) for each bucket that distinct keys, sorted by bucket, fall in."""
    cut = np.flatnonzero(np.diff(home.astype(np.int64), prepend=-1))
    for lo, hi in zip(cut, np.append(cut, len(home))[1:], strict=True):
        yield block, kind, int(home[lo]), b"".join(f[lo:hi].tobytes() for f in fields)


def _fields(kind: int, payload: bytes) -> list[np.ndarray]:
    types = [np.dtype(x) for x in FIELDS[kind]]
    n, at, out = len(payload) // sum(x.itemsize for x in types), 0, []
    for x in types:
        out.append(np.frombuffer(payload, x, n, at))
        at += n * x.itemsize
    return out


def _answer(keep: str) -> Callable:
    """Answers questions that are sorted by kind, bucket and block, with two flags a key.

    Anchors and starts: whether an earlier and whether a later block has it. Classes: whether
    all starts match, and whether to ask for them one by one. They are settled where all
    classes of one inner hash have one outer hash, or where each of these comes twice; else the
    first of each outer hash asks, and by that lends its starts to the others.
    """

    def classes_told(inner: np.ndarray, outer: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by, group = Order(inner, outer), Order(inner)
        again = (by.any(twice) | (np.diff(by.begins, append=len(inner)) > 1))[by.number]
        mixed = np.bincount(group.number[by.firsts], minlength=len(group.begins)) > 1
        if keep != "first":
            mixed &= group.any(~again)
        return (by.earlier if keep == "first" else again), mixed[group.number] & ~by.earlier

    def told(asked: list[tuple]) -> pa.RecordBatch:
        kind, bucket = asked[0][1:3]
        parts = [_fields(kind, payload) for *_, payload in asked]
        fields = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if kind == CLASSES:
            x, y = classes_told(*fields)
        else:
            order = Order(*fields)
            x, y = order.earlier, order.later
        sizes = [len(p[0]) for p in parts]
        cut = np.cumsum(sizes)[:-1]
        bits = [np.packbits(np.concatenate(both)).tobytes() for both in zip(np.split(x, cut), np.split(y, cut), strict=True)]
        cols = [pa.array([a[0] for a in asked], pa.int64()), pa.array([bucket] * len(asked), pa.int32()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["block", "bucket", "n", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple] = []
        for columns in rows_of(batches):
            for row in zip(*columns, strict=True):
                if asked and row[1:3] != asked[0][1:3]:
                    yield told(asked)
                    asked = []
                asked.append(row)
        if asked:
            yield told(asked)

    return run


def _flags(rows: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Both flags of each of a block's distinct keys, in order."""
    x, y = [np.empty(0, bool)], [np.empty(0, bool)]
    for r in sorted(rows or [], key=lambda r: r["bucket"]):
        both = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=2 * r["n"]).astype(bool)
        x.append(both[: r["n"]])
        y.append(both[r["n"] :])
    return np.concatenate(x), np.concatenate(y)


ASKED = "block long, kind int, bucket int, payload binary"
TEXTS = "ids array<long>, sizes array<long>, texts binary"
RUNS = "gone binary, asked binary"
DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Rows that are no questions.
BLOCK, FINISHED = -1, -2


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows as a batch; rows that are too short have nulls at their end."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    named = [x.split(" ") for x in ddl.split(", ")]
    cols = list(zip(*(r + (None,) * (len(named) - len(r)) for r in rows), strict=True)) or [[] for _ in named]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, named, strict=True)], [n for n, _ in named])


def _unpacked(texts: bytes, sizes: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(texts, max(1, sum(sizes)))
    return raw, np.frombuffer(raw, np.uint8), np.cumsum(sizes, dtype=np.int64)


def _pack(bits: int, block_bytes: int) -> Callable:
    """Blocks of documents with their texts, and their questions for anchors."""

    def block(name: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        sizes, raw = [len(x) for x in texts], b"".join(texts)
        _, grams, _, _ = anchors(np.frombuffer(raw, np.uint8), np.cumsum(sizes, dtype=np.int64))
        home, low = _short(grams, bits)
        firsts = Order(home, low).firsts
        rows = [(name, BLOCK, -1, None, ids, sizes, zstandard.compress(raw, LEVEL))]
        return _table([*rows, *_questions(name, ANCHORS, home[firsts], low[firsts])], f"{ASKED}, {TEXTS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for doc_ids, some in rows_of(batches):
            for doc_id, text in zip(doc_ids, some, strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if ids and held + len(raw) > block_bytes:
                    yield block(name, ids, texts)
                    name, ids, texts, held = name + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield block(name, ids, texts)

    return run


def _result(doc_id: int | None, raw: bytes, at: np.ndarray) -> tuple:
    """The digest row of a document from the ascending places whose LENGTH bytes go."""
    if not len(at):
        return doc_id, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    cut = np.flatnonzero(np.diff(at, prepend=at[0] - LENGTH - 1) > LENGTH)
    begins, stops = at[cut], at[np.concatenate([cut[1:], [len(at)]]) - 1] + LENGTH
    kept = hashlib.sha256(raw[: begins[0]])
    for stop, begin in zip(stops, [*begins[1:], len(raw)], strict=True):
        kept.update(raw[stop:begin])
    return doc_id, len(raw), int((stops - begins).sum()), len(cut), kept.hexdigest()


def _sift(bits: int) -> Callable:
    """Answers about anchors: documents without a repeated anchor are finished; the others move on, and ask for classes of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), (ids,), (sizes,), (texts,), (answers,) in rows_of(batches, 1):
            raw, t, ends = _unpacked(texts, sizes)
            anchor, grams, lo, hi = anchors(t, ends)
            order = Order(*_short(grams, bits))
            met = order.any(order.earlier) | np.logical_or(*_flags(answers))
            runs = [x[met[order.number]] for x in (anchor, lo, hi)]
            begins = ends - sizes
            wait = np.zeros(len(ids), bool)
            wait[np.searchsorted(ends, runs[0], "right")] = True
            rows = [(name, FINISHED, *[None] * 5, *_result(ids[i], raw[begins[i] : ends[i]], anchor[:0])) for i in np.flatnonzero(~wait)]
            if wait.any():
                # the documents that wait move together: places move by what is left out before them
                shift = np.cumsum(np.where(wait, 0, sizes))[np.searchsorted(ends, runs[0], "right")]
                whole = b"".join(raw[begins[i] : ends[i]] for i in np.flatnonzero(wait))
                mine = [[x for x, w in zip(some, wait, strict=True) if w] for some in (ids, sizes)]
                _, _, inner, outer = classes(np.frombuffer(whole, np.uint8), *(x - shift for x in runs))
                home, low = _short(inner, bits)
                order = Order(home, low, outer)
                firsts, twice = order.firsts, np.diff(order.begins, append=len(outer)) > 1
                held = zstandard.compress(np.concatenate([np.diff(x - shift, prepend=0) for x in runs]).astype(np.int32).tobytes(), LEVEL)
                rows.append((name, BLOCK, -1, held, *mine, zstandard.compress(whole, LEVEL)))
                rows += _questions(name, CLASSES, home[firsts], low[firsts], outer[firsts], twice)
            yield _table(rows, f"{ASKED}, {TEXTS}, {DONE}")

    return run


def _settle(bits: int, keep: str) -> Callable:
    """Answers about classes: which starts go, as runs, and questions for those that must be looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,), (held,), (sizes,), (texts,), (answers,) in rows_of(batches, 1):
            _, t, _ = _unpacked(texts, sizes)
            runs = np.frombuffer(zstandard.decompress(held), np.int32).astype(np.int64)
            first, last, inner, outer = classes(t, *np.cumsum(runs.reshape(3, -1), axis=1))
            order = Order(*_short(inner, bits), outer)
            every, ask = _flags(answers)
            gone = every[order.number]
            if keep == "first":
                gone = gone | order.earlier
            ask = ask[order.number] & ~order.earlier
            home, low = _start_keys(t, _spread(first[ask], last[ask]), bits)
            firsts = Order(home, low).firsts
            rows = [(name, BLOCK, -1, None, *(np.stack([first[x], last[x]]).astype(np.int64).tobytes() for x in (gone, ask)))]
            yield _table([*rows, *_questions(name, STARTS, home[firsts], low[firsts])], f"{ASKED}, {RUNS}")

    return run


def _finish(bits: int, keep: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), (sizes,), (texts,), (gone,), (asked,), (answers,) in rows_of(batches, 1):
            raw, t, ends = _unpacked(texts, sizes)
            gone, asked = (_spread(*np.frombuffer(x, np.int64).reshape(2, -1)) for x in (gone, asked))
            order = Order(*_start_keys(t, asked, bits))
            earlier, later = (x[order.number] for x in _flags(answers))
            hit = order.earlier | earlier if keep == "first" else order.earlier | order.later | earlier | later
            gone = np.union1d(gone, asked[hit])
            cuts = np.searchsorted(gone, np.concatenate([[0], ends]))
            yield _table([_result(i, raw[end - size : end], gone[lo:hi] - (end - size)) for i, size, end, lo, hi in zip(ids, sizes, ends, cuts[:-1], cuts[1:], strict=True)], DONE)

    return run


def _told(made: DataFrame, keep: str) -> DataFrame:
    """The answers to the questions among the rows, gathered by block: at most one row a key of the block."""
    dealt = made.filter("kind >= 0").select("block", "kind", "bucket", "payload").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block")
    told = dealt.mapInArrow(_answer(keep), "block long, bucket int, n int, bits binary")
    return told.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "none", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row: each byte goes that lies in a 200-byte string which also starts elsewhere.

    keep="none" takes out all copies, keep="first" leaves the copy that comes first in the order
    of the blocks (partition, then place in it). Matches never cross documents; overlapping and
    self-overlapping ones count; strings are judged on the input. Texts are UTF-8 bytes, null
    counts as empty. Null ids, shared ids and repeated rows are rows like any other (a repeated
    row of 200 bytes or more is a copy); texts under 200 bytes lose nothing; an empty table
    gives no rows; ids must be integers; other columns are not read.

    The longest previous factor of a place is read off the suffix order: within a run of
    suffixes that share their first 200 bytes, the previous smaller place is the neighbour
    before. Suffixes stand in the order of a hash of these bytes, then of their places: what is
    shorter than 200 does not count, so no other order is needed. The hash has 64 bits below
    those that name the bucket, which grow with the input.

    Few suffixes need to be ordered. Of each 200-byte window the least 64-byte string by hash is
    its anchor, and equal windows have equal anchors: where an anchor is nowhere else, nothing
    matches. Starts at repeated anchors are taken in classes of 16; most classes match whole or
    not at all, and only what is left is ordered start by start.

    Scale: a block of 8 MB asks for each distinct key once, so a passage that a third of all
    documents share costs a key a block; buckets of keys grow in number with the input, and are
    the most that a task holds. Texts travel packed: all to their first answers, those with a
    repeated anchor twice more.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    ship(docs.sparkSession)
    clean = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(BITS_MOST, max(BITS_LEAST, (size // BUCKET_BYTES).bit_length()))
    mine = f"kind = {BLOCK}"
    packed = stage(clean.mapInArrow(_pack(bits, block_bytes), f"{ASKED}, {TEXTS}"))
    blocks = packed.filter(mine).select("block", "ids", "sizes", "texts")
    sifted = stage(blocks.join(_told(packed, keep), "block", "left").select("block", "ids", "sizes", "texts", "answers").mapInArrow(_sift(bits), f"{ASKED}, {TEXTS}, {DONE}"))
    waiting = sifted.filter(mine).join(_told(sifted, keep), "block", "left").select("block", "payload", "sizes", "texts", "answers")
    settled = stage(waiting.mapInArrow(_settle(bits, keep), f"{ASKED}, {RUNS}"))
    last = sifted.filter(mine).select("block", "ids", "sizes", "texts").join(settled.filter(mine).select("block", "gone", "asked"), "block").join(_told(settled, keep), "block", "left")
    last = last.select("ids", "sizes", "texts", "gone", "asked", "answers").mapInArrow(_finish(bits, keep), DONE)
    return sifted.filter(f"kind = {FINISHED}").select(*last.columns).unionByName(last)


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
