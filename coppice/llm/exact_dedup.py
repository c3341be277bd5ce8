"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import ROW, TIE, bit_map, drop_rows, maybe_broadcast, stage, with_marks, with_rows

PREFIX_CHARS = 64


def _key_hash() -> Column:
    return F.xxhash64("_len", "_prefix")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_hash, and the carried columns.

    Texts are equal when identical; null counts as empty. The largest id of a group stays.
    Refinement: texts are grouped by byte length, and inside a length by a hash of their first
    64 characters (one aggregation, keyed by both); only texts of groups with more than one
    member are read to their end, for a SHA-256 (text_hash, null for all others); groups of
    equal length and SHA-256 are copies.

    - repeated rows (same id, same text) count in group_size and share one verdict;
    - null ids never stay unless all ids of the group are null, then all of them do;
    - a very long text is hashed whole like any other; an empty table gives an empty result;
    - other columns are ignored unless carried.

    Scale: the text column is read twice, and texts are never shuffled: shuffles carry lengths
    and hashes. Which texts get a full hash is looked up in a bit map of at most 64 MB (a
    broadcast of proven size); two keys may share a bit, which costs a hash and changes
    nothing. Groups are pre-aggregated; the last join puts rows of a hot group to its one
    summary row and is split by AQE.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_prefix"),
        *[c.alias(f"_c_{k}") for k, c in carry.items()],
    )
    carried = [f"_c_{k}" for k in carry]
    keys = stage(base.groupBy("_len", "_prefix").count().filter("count > 1").select(_key_hash().alias("hash")))
    seen = with_marks(base, _key_hash(), *bit_map(keys, keys.count()))
    hashed = F.when(F.col("coppice_hit"), F.sha2("_text", 256))
    # texts with a hash and those without lie in folders of their own, so that each is read once
    probe = stage(seen.select("_id", "_len", hashed.alias("_full"), *carried).withColumn("_hit", F.col("_full").isNotNull()), by="_hit")
    candidates = probe.filter("_hit")
    groups = stage(
        candidates.groupBy("_len", "_full").agg(F.count("*").alias("_n"), F.max("_id").alias("_keep"))
        .filter("_n > 1").select("_full", "_n", "_keep")
    )
    few, _ = maybe_broadcast(groups)
    named = [F.col(f"_c_{k}").alias(k) for k in carry]
    dup = candidates.join(few, "_full", "left").select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_n").isNull() | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.when(F.col("_n").isNotNull(), F.col("_full")).alias("text_hash"), *named,
    )
    alone = probe.filter("not _hit").select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lit(None).cast("string").alias("text_hash"), *named,
    )
    return dup.unionByName(alone)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, also where ids are null or shared; all columns stay.

    The row with the largest id stays, among repeated rows one of them, and a null id only where
    the group has no other. Null text counts as empty, so one row of those stays too. An empty
    table stays empty.
    """
    rows = with_rows(docs)
    found = exact_dedup(rows, carry={ROW: F.col(ROW), TIE: F.col(TIE)})
    verdict = stage(found.filter("group_size > 1").select("kept", "text_hash", ROW, TIE))
    stay = verdict.filter("kept").groupBy("text_hash").agg(F.min(F.struct(TIE, ROW))[ROW].alias(ROW))
    return drop_rows(rows, stage(verdict.join(stay, ROW, "left_anti").select(ROW)), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, carry={"text_sha256": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)}).drop("text_hash")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
