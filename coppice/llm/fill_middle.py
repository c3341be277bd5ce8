"""Fill-in-middle: texts cut in three, put together in another order by a secondary sort, and rebuilt from what came out."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import ROW, ship, table, with_rows

SEED = 42
#: Of a hundred documents so many are rearranged, and of a hundred of these so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Units of one piece; a piece of more characters is cut.
PIECE_UNITS, PIECE_CHARS = 4096, 1 << 16
#: Output order of the sections, and the places of pieces in a section.
ORDERS = {"spm": (SUFFIX, PREFIX, MIDDLE), "psm": (PREFIX, SUFFIX, MIDDLE)}
TEXT_ORDER = (PREFIX, MIDDLE, SUFFIX)
_SECTION, _LAST = 1 << 40, 1 << 60

_units = re.compile(UNIT)
_marks = re.compile("<[PSM]>")

PIECES = "_row long, place long, piece string, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of a SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in ddl.split(", ")), strict=True)
    cols = list(zip(*(r + (None,) * (len(names) - len(r)) for r in rows), strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(cols, kinds, strict=True)], list(names))


def _batched(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """Batches of some 4 MB of pieces."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + len(r[2] or "") if len(r) > 2 and isinstance(r[2], str) else 100
        if size > 4 << 20:
            yield _batch(held, ddl)
            held, size = [], 0
    yield _batch(held, ddl)


def cut(text: str, h1: int, h2: int) -> tuple[int, int, int, array]:
    """Number of units; units before the middle and before the suffix; where each unit ends."""
    ends = array("q", (m.end() for m in _units.finditer(text)))
    a, b = h1 % (len(ends) + 1), h2 % (len(ends) + 1)
    return len(ends), min(a, b), max(a, b), ends


def pieces(text: str, ends: array, lo: int, hi: int) -> Iterator[tuple[str, int, str]]:
    """(section, number, text): runs of whole units of each section, in text order; an empty section has none."""
    for section, first, stop in ((PREFIX, 0, lo), (MIDDLE, lo, hi), (SUFFIX, hi, len(ends))):
        number = 0
        for u in range(first, stop, PIECE_UNITS):
            begin, end = ends[u - 1] if u else 0, ends[min(u + PIECE_UNITS, stop) - 1]
            for at in range(begin, end, PIECE_CHARS):
                yield section, number, text[at : min(at + PIECE_CHARS, end)]
                number += 1


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of documents at their places in the output; the mark of a section is the piece before its first."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for at in range(batch.num_rows):
                row, doc_id, form, h1, h2, text = (c[at].as_py() for c in batch.columns)
                n, lo, hi, ends = cut(text, h1, h2)
                place = {mark: i * _SECTION for i, mark in enumerate(ORDERS[form])}
                begin, middle = (ends[k - 1] if k else 0 for k in (lo, hi))
                yield row, _LAST, None, doc_id, n, form, begin, middle - begin
                for mark in TEXT_ORDER:
                    yield row, place[mark], mark
                for section, number, piece in pieces(text, ends, lo, hi):
                    yield row, place[section] + 1 + number, piece

    return _batched(rows(), PIECES)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


class Sections:
    """Reads an output piece by piece and tells which section each part of it belongs to, by the marks alone."""

    def __init__(self) -> None:
        self.section, self.number, self.held = None, 0, ""

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[str, int, str]]:
        piece = self.held + piece
        # the end may be the beginning of a mark
        keep = 0 if last else next((k for k in (2, 1) if any(mark.startswith(piece[-k:]) for mark in TEXT_ORDER) and len(piece) >= k), 0)
        piece, self.held = piece[: len(piece) - keep], piece[len(piece) - keep :]
        at = 0
        for m in _marks.finditer(piece):
            yield from self._part(piece[at : m.start()])
            self.section, self.number, at = m[0], 0, m.end()
        yield from self._part(piece[at:])

    def _part(self, text: str) -> Iterator[tuple[str, int, str]]:
        if text:
            yield self.section, self.number, text
            self.number += 1


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order go into a digest as they come, and on to their places in the text."""

    def rows() -> Iterator[tuple]:
        digest, sections = hashlib.sha256(), Sections()
        back = {mark: i * _SECTION for i, mark in enumerate(TEXT_ORDER)}
        for row, place, piece, *facts in _streams(batches):
            if place < _LAST:
                digest.update(piece.encode("utf-8", "surrogatepass"))
                found = sections.feed(piece)
            else:
                found = sections.feed("", last=True)
            for section, number, part in found:
                yield row, back[section] + number, part
            if place == _LAST:
                yield row, _LAST, None, *facts[:5], digest.hexdigest()
                digest, sections = hashlib.sha256(), Sections()

    return _batched(rows(), PIECES)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        digest = hashlib.sha256()
        for _, place, piece, *facts in _streams(batches):
            if place < _LAST:
                digest.update(piece.encode("utf-8", "surrogatepass"))
            else:
                yield *facts, digest.hexdigest()
                digest = hashlib.sha256()

    return _batched(rows(), RESULT)


def sort_pieces(made: DataFrame) -> DataFrame:
    """Secondary sort: the pieces of a document in one partition, in the order of their places."""
    return made.repartition("_row").sortWithinPartitions("_row", "place")


def with_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """_row, doc_id, text, form, h1, h2: how each document is to be written."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = with_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    return rows.select(F.col(ROW).alias("_row"), "doc_id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2"))


def assembled(rows: DataFrame) -> DataFrame:
    """_row, place, piece of every rearranged text in output order, with a last row for each document that holds its facts and no piece."""
    made = rows.filter("form <> 'plain'").select("_row", "doc_id", "form", "h1", "h2", "text").mapInArrow(_emit, PIECES)
    return sort_pieces(made)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every row.

    Units are runs of space with the non-space after them. Draws of seed and id choose the form
    and two cuts between units. Rearranged texts are cut into pieces keyed by document and output
    place; a secondary sort brings a document's pieces together in order, and they stream into a
    digest. The text is rebuilt from that stream alone: marks say which section a part
    belongs to, a second sort by text place restores it, and a digest of it is taken.

    Null text counts as empty and is plain, like every text that holds a mark; a null id draws as
    an empty one; equal ids draw alike, but their rows stay apart, as repeated rows do; an empty
    table gives no rows; ids must be integers; other columns are not read.

    Scale: plain texts are not shuffled, the others twice, in pieces of at most 64 K characters,
    so a task holds a batch of pieces and one digest however long a text is. Each row is a key
    of its own, so there is none that many rows share.
    """
    ship(docs.sparkSession)
    rows = with_forms(docs, id_col, text_col, seed, rate, suffix_first)
    text = F.col("text")
    digest = F.sha2(text.cast("binary"), 256)
    none = F.lit(None).cast("long")
    plain = rows.filter("form = 'plain'").select(
        "doc_id", F.size(F.regexp_extract_all("text", F.lit(UNIT), 0)).cast("long").alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), digest.alias("output_sha256"), digest.alias("restored_sha256")
    )
    restored = sort_pieces(assembled(rows).mapInArrow(_assemble, PIECES)).select(*[x.split(" ")[0] for x in PIECES.split(", ")]).mapInArrow(_restore, RESULT)
    return plain.unionByName(restored)


def query(spark, sf_dir: str) -> DataFrame:
    return fill_middle(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, CASE WHEN text = '' THEN []::VARCHAR[] ELSE regexp_extract_all(text, '{UNIT}') END AS units,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
             CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
                  WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, array_to_string(units[1 : lo], '') AS p, array_to_string(units[lo + 1 : hi], '') AS m, array_to_string(units[hi + 1 : n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""
