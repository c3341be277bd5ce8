"""SimHash near-dedup with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import rows_of, ship, stage, table
from coppice.llm.components import connected_components

WORDS, BITS = 4, 4
SEED = 42
#: Words hashed at a time, so that a very long text never has all its shingles in memory.
WORD_BLOCK = 200_000
#: Segments of the fingerprint (start, width), each padded to the 23 bits of a Golay word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Key rows looked at together; a longer run of one key is kept whole.
LINK_BLOCK = 400_000
#: Runs longer than this are searched ball by ball instead of shift by shift.
RUN_SHORT = 24

# --- fingerprints -------------------------------------------------------------------------


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; 0 for a text without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return 0
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, n - words + 1)
    for at in range(0, total, WORD_BLOCK):
        part = tokens[at : at + WORD_BLOCK + words - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        ends = (ends - 1).tolist()
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :] or ends[-1:], strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            made = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return run


# --- Golay keys ---------------------------------------------------------------------------


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """near[s]: up to six error patterns of weight at most 4 with syndrome s; and how many.

    The code is the cyclic [23, 12] one; every word has exactly one codeword within 3, and
    five more at distance 4 when that one is at 3. Two words within 2 of each other always
    share one of these codewords.
    """
    from itertools import combinations

    remainder = np.array([_syndrome_of(1 << i) for i in range(23)])
    near, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(remainder[list(bits)])) if bits else 0
            near[s, count[s]] = sum(1 << b for b in bits)
            count[s] += 1
    return near, count


def _syndrome_of(word: int, poly: int = 0b101011100011) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= poly << (i - 11)
    return word


_golay: list = []


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: six codeword indices (12 bits) and which of them count."""
    if not _golay:
        single = np.array([_syndrome_of(1 << i) for i in range(23)])
        low = np.zeros(1 << 12, np.int64)
        high = np.zeros(1 << 11, np.int64)
        for i in range(12):
            low[np.arange(1 << 12) >> i & 1 == 1] ^= single[i]
        for i in range(11):
            high[np.arange(1 << 11) >> i & 1 == 1] ^= single[12 + i]
        _golay.extend((low, high, *_golay_tables()))
    low, high, near, count = _golay
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ near[s]) >> 11, np.arange(6)[None, :] < count[s][:, None]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each fuzzy key of each fingerprint.

    Four differing bits over three segments leave some two segments with at most two; within
    two, either segment shares a Golay index, so the pair of indices is a shared key.
    """
    seg = [golay_indices(((fps >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64)) for a, w in SEGMENTS]
    rows, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        key = (p << 24) | (seg[i][0][:, :, None] << 12) | seg[j][0][:, None, :]
        r, a, b = np.nonzero(seg[i][1][:, :, None] & seg[j][1][:, None, :])
        rows.append(r)
        keys.append(key[r, a, b])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            fps = batch.column(0).slice(at, 2048).to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32), pa.int32()), pa.array(fps[rows], pa.int64())], ["key", "fp"])


# --- links --------------------------------------------------------------------------------


def _balls(fps: np.ndarray, bits: int) -> np.ndarray:
    """Component labels (positions) of one long run, by breadth-first search over what is not yet reached."""
    labels, rest = np.empty(len(fps), np.int64), np.arange(len(fps))
    while len(rest):
        root, frontier, rest = rest[0], rest[:1], rest[1:]
        labels[root] = root
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), bool)
            for f in fps[frontier]:
                hit |= np.bitwise_count(fps[rest] ^ f) <= bits
            frontier, rest = rest[hit], rest[~hit]
            labels[frontier] = root
    return labels


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between fingerprints, (member, least member) for each component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _links(bits: int):
    """Rows come sorted by key. Emits a spanning forest of the links found in each block, never all pairs of a group."""

    def block(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(keys)]]))
        found_a, found_b = [], []
        for s, n in zip(starts[lengths > RUN_SHORT].tolist(), lengths[lengths > RUN_SHORT].tolist(), strict=True):
            run = np.unique(fps[s : s + n])
            label = _balls(run, bits)
            linked = label != np.arange(len(run))
            found_a.append(run[linked])
            found_b.append(run[label[linked]])
        short = np.repeat(lengths <= RUN_SHORT, lengths)
        keys, fps = keys[short], fps[short]
        for shift in range(1, RUN_SHORT):
            if len(keys) <= shift:
                break
            same = np.flatnonzero(keys[shift:] == keys[:-shift])
            if not len(same):
                break
            near = same[np.bitwise_count(fps[same] ^ fps[same + shift]) <= bits]
            found_a.append(fps[near])
            found_b.append(fps[near + shift])
        a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (found_a, found_b))
        if not len(a):
            return None
        a, b = (x.view(np.uint64) for x in _forest(a.view(np.int64), b.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if sum(len(k) for k, _ in held) >= LINK_BLOCK and held[0][0][0] != held[-1][0][-1]:
                keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                last = np.searchsorted(keys, keys[-1])
                if made := block(keys[:last], fps[:last]):
                    yield made
                held = [(keys[last:], fps[last:])]
        if held and (made := block(*(np.concatenate(x) for x in zip(*held, strict=True)))):
            yield made

    return run


def linked(made: DataFrame, bits: int = BITS) -> DataFrame:
    """fp, component_id (least doc_id reachable over links) for every fingerprint of made (doc_id, fp); made is read once."""
    nodes = stage(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    keyed = nodes.select("fp").mapInArrow(_keys, "key int, fp long").repartition("key").sortWithinPartitions("key")
    stars = connected_components(keyed.mapInArrow(_links(bits), "a long, b long"))
    members = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    members = stage(members.join(nodes, "fp"))
    low = stage(members.groupBy("root").agg(F.min("least").alias("component_id")))
    grouped = stage(members.join(low, "root").select("fp", "component_id"))
    return stage(nodes.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable over links) for every row.

    Fingerprints link when they differ in at most `bits` (4 or fewer) bits. Equal fingerprints
    are one node from the start, so exact copies cost nothing; links between nodes are found
    by fuzzy keys, checked in full, and thinned to a forest where they are found.

    Null text counts as empty: texts without words share fingerprint zero, which links like
    any other. Repeated rows get equal results. Null ids get the component's least non-null
    id (null if it has none). A very long text is hashed whole, a block of words at a time.
    Fingerprints that tie are one node. An empty table gives no rows; ids are integers; other
    columns are not read.

    Scale: texts are read once and never shuffled. Each distinct fingerprint makes some 85
    rows of 12 bytes. A key's rows meet in one task as a sorted run in constant memory a row;
    only the forest leaves it.
    """
    if bits > 4:
        raise ValueError("the keys find links of at most 4 bits")
    ship(docs.sparkSession)
    clean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = stage(clean.mapInArrow(_fingerprints(words), "doc_id long, fp long"))
    of = linked(made, bits)
    return made.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
