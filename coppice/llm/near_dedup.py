"""Near dedup for the pipeline: SimHash fingerprints, then MinHash bands for what these cannot see, give candidates; exact Jaccard on each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import ROW, bit_map, keep_smallest, maybe_broadcast, rows_of, ship, stage, with_marks, with_rows
from coppice.llm.components import connected_components
from coppice.llm.simhash import fingerprint, linked

WORDS, SEED = 5, 42
#: Texts link at a Jaccard of NUM / DEN or more.
NUM, DEN = 4, 5
#: A pair of Jaccard j becomes a candidate with probability 1 - (1 - j ** WIDTH) ** BANDS: 0.999988 at 0.8, 0.09 at 0.5, 0.01 at 0.4.
BANDS, WIDTH = 100, 10
#: Shingles whose MinHash values are made at a time.
SHINGLE_BLOCK = 128
#: Star rounds with other pivots are taken while more pairs than there are texts would be left.
STARS_MOST = 4
#: Slots of the parities by which open pairs are joined.
FOLD = 1024
#: Slots in which shingles of open texts are counted, in so many rows; powers of two.
SLOTS_MOST, CHUNKS = 1 << 21, 64

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_made: dict = {}


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles, ASCII case aside; a shorter text is one shingle, a text without words none.

    A shingle's hash is made of the XXH64 hashes of its words, each of which is hashed once.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    words = min(words, len(tokens))
    made = h[: len(h) - words + 1].copy()
    for k in range(1, words):
        made *= _STEP
        made += h[k : len(h) - words + 1 + k]
    made ^= made >> np.uint64(29)
    made *= _MIX
    made ^= made >> np.uint64(32)
    return np.unique(made)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of the least values that its hash functions take over the upper halves of the hashes."""
    if "factors" not in _made:
        rng = np.random.default_rng(SEED)
        _made["factors"] = rng.integers(0, 1 << 32, (2, BANDS * WIDTH), np.int64).astype(np.uint32) | np.uint32(1)
        _made["block"] = np.empty((SHINGLE_BLOCK, BANDS * WIDTH), np.uint32)
    times, plus = _made["factors"]
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint32).max, np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), SHINGLE_BLOCK):
        part = upper[at : at + SHINGLE_BLOCK, None]
        block = _made["block"][: len(part)]
        np.multiply(part, times, out=block)
        np.add(block, plus, out=block)
        np.minimum(least, block.min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(v.tobytes(), i) for i, v in enumerate(least.reshape(BANDS, WIDTH))], np.uint64)


def parities(hashes: np.ndarray) -> bytes:
    """One bit for each of 4 to 8 slots a hash: whether an odd number of hashes fall in it. The count of slots is a power of two."""
    slots = max(64, 1 << (4 * len(hashes)).bit_length())
    odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_near(x: bytes, y: bytes, n: int, m: int) -> bool:
    """False only if the sets cannot be near: a slot of unequal parity has a hash of its own that one set lacks."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (DEN + NUM) <= (n + m) * (DEN - NUM)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in rows_of(batches):
        sets = [shingles(t) for t in texts]
        keys = np.concatenate([band_keys(s) for s in sets]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys)), pa.array([parities(s) for s in sets], pa.binary()),
                pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)),
            ],
            ["_row", "same", "n", "keys", "odd", "fp"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in rows_of(batches):
        sets = [shingles(t) for t in texts]
        tokens = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), tokens], ["node", "hashes", "tokens"])


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parities of each text's hashes over FOLD slots."""
    for ids, texts in rows_of(batches):
        odd = [(np.bincount((shingles(t) & np.uint64(FOLD - 1)).astype(np.int64), minlength=FOLD) & 1).astype(np.uint8) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.packbits(x).view(np.int64) for x in odd], pa.list_(pa.int64()))], ["node", "fold"])


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of sorted distinct hashes have a Jaccard of NUM / DEN or more; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DEN >= (len(a) + len(b) - both) * NUM


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n, m, x, y = batch.columns
        keep = pa.array([may_be_near(p, q, i, j) for i, j, p, q in zip(*(c.to_pylist() for c in (n, m, x, y)), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = batch.columns
        hit = [near(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y, strict=True)]
        keep = pa.array(hit, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def _close(x: str, y: str):
    """Sizes that allow a Jaccard of NUM / DEN."""
    return (F.col(x) * DEN >= F.col(y) * NUM) & (F.col(y) * DEN >= F.col(x) * NUM)


def _alike(n: str, m: str, x: str, y: str) -> Column:
    """may_be_near for parities of a fixed number of slots, in SQL: pairs that cannot be near are no rows of a join on it."""
    odd = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("int")), F.lit(0), lambda s, v: s + v)
    return odd * (DEN + NUM) <= (F.col(n) + F.col(m)) * (DEN - NUM)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def _still_open(keyed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Members of keys (key, node, n, label), the keys that two components share (key, and top: its commonest label), and how many pairs of these are open."""
    marked = stage(keyed.join(labels.select(F.col("a").alias("node"), F.col("b").alias("_label")), "node", "left").select("key", "node", "n", F.coalesce("_label", "node").alias("label")))
    shares = marked.groupBy("key", "label").agg(F.count("*").alias("c"))
    squares = F.sum(F.col("c") * F.col("c")).alias("squares")
    runs = stage(shares.groupBy("key").agg(F.sum("c").alias("all"), squares, F.max(F.struct("c", "label"))["label"].alias("top")).filter("squares < all * all"))
    left = runs.agg(F.sum((F.col("all") * F.col("all") - F.col("squares")).cast("decimal(38,0)") / 2)).first()[0] or 0  # one number
    return marked, runs.select("key", "top"), left


def _slot_counts(slots: int):
    """How many shingles of a task's texts fall in each slot, as CHUNKS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.uint32)
        for (texts,) in rows_of(batches):
            for t in texts:
                np.add.at(counts, (shingles(t) & np.uint64(slots - 1)).astype(np.int64), np.uint32(1))
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in counts.reshape(CHUNKS, -1)], pa.binary())], ["chunk", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of each chunk, which come one after another."""
    at, held = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["chunk", "counts"])

    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            more = np.frombuffer(counts.as_buffer(), np.uint32)
            if chunk == at:
                held = held + more
            else:
                if at is not None:
                    yield out()
                at, held = chunk, more
    if at is not None:
        yield out()


def _firsts(counted):
    """(key, node, n): the first n - ceil(0.8 n) + 1 shingles of each text by the counts of their slots, without those that are alone in theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in counted.value])
        for ids, texts in rows_of(batches):
            keys, sizes, lengths = [], [], []
            for t in texts:
                h = shingles(t)
                c = counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)]
                first = np.lexsort((h, c))[: len(h) + len(h) * NUM // -DEN + 1]
                keys.append(h[first[c[first] > 1]])
                sizes.append(len(keys[-1]))
                lengths.append(len(h))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.repeat(np.array(lengths, np.int64), sizes))], ["key", "node", "n"])

    return run


def _rarest(texts: DataFrame, most: int = SLOTS_MOST) -> DataFrame:
    """(key, node, n): for each text the shingles among its n - ceil(0.8 n) + 1 rarest that another text may have too.

    In one order of all shingles, two sets of a Jaccard of 0.8 or more share one of so many of
    their first. The order is by how many shingles of these texts fall in a shingle's slot, then
    by hash; so any number of slots misses nothing, and the more there are the nearer it is to
    the order by how many texts have a shingle. Texts that have much in common but are not near
    share only shingles that come later, so they meet no more. A shingle that is alone in its
    slot is nobody's meeting point. Only what is kept becomes rows; the counts are 8 MB at most.
    """
    counted = stage(texts.select("text").mapInArrow(_slot_counts(most), "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_added, "chunk int, counts binary"))
    rows = [bytes(r["counts"]) for r in counted.orderBy("chunk").collect()]  # CHUNKS rows, 8 MB at most
    shared = texts.sparkSession.sparkContext.broadcast(rows or [bytes(4)])
    return stage(texts.mapInArrow(_firsts(shared), "key long, node long, n long"))


def near_groups(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """_row, component for every row: components of texts linked by a Jaccard of 0.8 or more over distinct five-word shingles.

    rows has a unique _row. Null text counts as empty; texts without words are equal to each
    other. Rows with equal sets are one node, so copies cost nothing. Nodes whose fingerprints
    link (operator 6) are candidates with the least of their component. At 0.8 fingerprints
    differ in about ten bits, which no keys of four bits can see, so nodes that share one of
    100 band keys are candidates too. Parity bits reject most that are not near, and never one that
    is; each link is checked on the sets themselves, so no link is wrong; one of exactly 0.8 is missed once in some 80,000.

    After the fingerprints, each node is checked against one pivot of each of its keys; a group of near copies
    comes together by this, without its pairs. Then what shares a key but not yet a component
    is checked pair by pair, if that is no more than there are texts. Else the texts that are
    still open are indexed by their rarest shingles, which misses nothing, and pairs of these are checked.

    Scale: texts are read once, and again for the sets of links; a candidate pair shuffles about
    half a byte a shingle, a pair past the parity bits 8 bytes. Each distinct set makes 100 keys,
    which are counted; those that come more than once are kept, by a bit map of at most 64 MB.
    """
    ship(rows.sparkSession)
    clean = rows.select("_row", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = stage(clean.mapInArrow(_sketches, "_row long, same binary, n long, keys array<long>, odd binary, fp long"))
    same = stage(made.groupBy("same").agg(F.min("_row").alias("node")))
    firsts, _ = maybe_broadcast(same.select(F.col("node").alias("_row")))
    nodes = made.select("_row", "n", "keys").join(firsts, "_row", "left_semi").select(F.col("_row").alias("node"), "n", "keys")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    busy = stage(keyed.groupBy("key").count().filter("count > 1").select(F.col("key").alias("hash")))
    keyed = stage(with_marks(keyed, F.col("key"), *bit_map(busy, busy.count())).filter("coppice_hit").select("key", "node", "n"))
    most = keyed.select("node").distinct().count()

    def checked(pairs: DataFrame) -> DataFrame:
        ends = stage(pairs.select(F.col("a").alias("_row")).union(pairs.select("b")).distinct())
        few, _ = maybe_broadcast(ends)
        held = made.select("_row", "n", "odd").join(few, "_row", "left_semi")
        x, y = (held.select(F.col("_row").alias(k), F.col("n").alias(i), F.col("odd").alias(v)) for k, i, v in (("a", "i", "x"), ("b", "j", "y")))
        pairs = stage(pairs.join(x, "a").join(y, "b").select("a", "b", "i", "j", "x", "y").mapInArrow(_sift, "a long, b long"))
        ends = stage(pairs.select(F.col("a").alias("_row")).union(pairs.select("b")).distinct())
        few, _ = maybe_broadcast(ends)
        sets = stage(clean.join(few, "_row", "left_semi").mapInArrow(_sets, "node long, hashes binary, tokens array<long>").select("node", "hashes"))
        held = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        return stage(held.select("a", "b", "x", "y").mapInArrow(_check, "a long, b long"))

    prints = stage(made.select("_row", "fp").join(firsts, "_row", "left_semi").select(F.col("_row").alias("doc_id"), "fp"))
    stars = prints.join(linked(prints), "fp").filter("doc_id <> component_id")
    tried = stage(_ordered(stars.select(F.col("doc_id").alias("node"), F.col("component_id").alias("other"))))
    links = checked(tried)
    labels = was = None
    for salt in range(STARS_MOST):
        # the least node first, which is the same for all keys of a group; then others
        rank = F.col("node") if salt == 0 else F.xxhash64("node", "key", F.lit(salt))
        pivots = keyed.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "n")).alias("p")).select("key", F.col("p.node").alias("other"), F.col("p.n").alias("m"))
        pairs = _ordered(keyed.join(pivots, "key").filter((F.col("node") != F.col("other")) & _close("n", "m")))
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        links = stage(links.union(checked(pairs)).distinct())
        labels = connected_components(links)
        marked, runs, left = _still_open(keyed, labels)
        if left <= most or (was is not None and 2 * left > was) or salt == STARS_MOST - 1:  # few are left, or stars find no more
            break
        was = left
        keyed = stage(marked.join(runs, "key", "left_semi").select("key", "node", "n"))  # keys without an open pair are done with
    if left > most:
        # members that share keys and yet are not near: their rarest shingles may leave fewer pairs than the keys
        few, _ = maybe_broadcast(keyed.select(F.col("node").alias("_row")).distinct())
        by_rarest, shared, fewer = _still_open(_rarest(clean.join(few, "_row", "left_semi")), labels)
        if fewer < left:
            marked, runs, left = by_rarest, shared, fewer
    if left:
        open_ = stage(marked.join(runs, "key"))
        few, _ = maybe_broadcast(open_.select(F.col("node").alias("_row")).distinct())
        folds = stage(clean.join(few, "_row", "left_semi").mapInArrow(_folds, "node long, fold array<long>"))
        open_ = stage(open_.join(folds, "node"))
        rest = open_.filter("label <> top").select("key", "node", "n", "label", "fold")  # one side of each open pair, at least
        others = open_.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("label").alias("its"), F.col("fold").alias("their"))
        on = [rest["key"] == others["key"], F.col("label") != F.col("its"), _close("n", "m"), _alike("n", "m", "fold", "their")]
        pairs = _ordered(rest.join(others, on))
        links = stage(links.union(checked(stage(pairs.join(tried, ["a", "b"], "left_anti")))).distinct())
        labels = connected_components(links)
    of = same.join(labels.select(F.col("a").alias("node"), F.col("b").alias("_label")), "node", "left").select("same", F.coalesce("_label", "node").alias("component"))
    return made.select("_row", "same").join(of, "same").select("_row", "component")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with the smallest id of each group of near copies, one row where ids are null or shared; all columns stay.

    A group keeps the row with the smallest non-null id, among repeated rows one of them, and a
    null id only where it has no other. Texts of their own stay, also under a shared id; all
    texts without words are one group. An empty table stays empty.
    """
    rows = with_rows(docs)
    groups = near_groups(rows.select(F.col(ROW).alias("_row"), "text")).withColumnRenamed("_row", ROW)
    return keep_smallest(rows, stage(groups), docs.columns)
