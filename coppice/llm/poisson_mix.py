"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import columns_of, free_name, maybe_broadcast, stage, table

SEED = 17
#: Sources get shares in proportion to (their bytes) ** ALPHA.
ALPHA = 0.7
#: A mean above this is drawn as a sum of equal parts, since exp(-mean) would underflow.
PART = 300.0


def uniform(*parts: Column) -> Column:
    """In (0, 1): the first 52 bits of an MD5 over the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose cumulative probability is at least u.

    u has 52 bits, so k stays below mean + 10 sqrt(mean) + 40: the fold always gets there.
    """
    top = F.ceil(mean + 10 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(s["c"] >= u, s).otherwise(
        F.struct((s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"), i.alias("k"))
    )
    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["k"])


def copies_of(mean: Column, seed: int, key: Column) -> Column:
    n = F.greatest(F.ceil(mean / PART), F.lit(1)).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + poisson_inverse(uniform(F.lit(str(seed)), key, i.cast("string")), mean / n)
    )


def source_rates(docs: DataFrame, weights: DataFrame | None = None, budget_bytes: int | None = None, alpha: float = ALPHA,
                 source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, mass, rate: the mean number of times that a document of the source is repeated.

    weights has (source, weight), one row a source; without it, weight is mass ** alpha. The
    budget is the input's own mass unless given. Mass counts UTF-8 bytes plus one a row, so
    that null and empty texts have a mass too. A null source is a source of its own. An empty
    table gives no rows. Other columns are not read.
    """
    mine = docs.select(F.col(source_col).alias("source"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    mass = mine.groupBy("source").agg(F.sum(F.col("n") + 1).alias("mass"))
    if weights is not None:
        given = weights.select(F.col("source").alias("given"), "weight")
        mass = mass.join(given, F.col("source").eqNullSafe(F.col("given"))).select("source", "mass", "weight")
    else:
        mass = mass.withColumn("weight", F.pow(F.col("mass").cast("double"), F.lit(alpha)))
    mass = stage(mass)
    whole = mass.agg(F.sum("weight").cast("double").alias("w"), F.sum("mass").alias("m")).first()  # two numbers
    budget = F.lit((whole["m"] or 0) if budget_bytes is None else budget_bytes).cast("long")
    return mass.select("source", "mass", F.round(budget * F.col("weight") / F.lit(whole["w"]) / F.col("mass"), 6).alias("rate"))


def poisson_mix(docs: DataFrame, rates: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs repeated as Poisson draws say and shuffled; adds copy (from 1) and mix_key.

    A document's draw depends on seed and id alone, so a rerun repeats it; rows that share an
    id, repeated rows too, share its count, and rows with a null id share one. A source
    without a rate (or with rate 0, or a null rate) gives no rows; a null source is a source of
    its own. Texts are carried along whole, null, empty or very long. An empty table gives no
    rows. All columns of docs stay as they are, whatever their names: where one of them is
    named copy or mix_key, the added column has an underscore before its name.

    The number of sources decides whether the rates are broadcast; beyond the bound the join
    is shuffled and AQE splits a hot source. The shuffle at the end deals rows by an MD5 of
    their own, so a hot source or id is spread over all tasks.
    """
    mine, key_name = columns_of(docs), F.col(id_col).cast("string")
    copy, mix_key = free_name(docs, "copy"), free_name(docs, "mix_key")
    row = docs.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(mine)]).alias("row"), F.coalesce(key_name, F.lit("null")).alias("key"), F.col(source_col).alias("from_source"))
    small, _ = maybe_broadcast(stage(rates.select(F.col("source").alias("rate_source"), "rate")))
    met = row.join(small, F.col("from_source").eqNullSafe(F.col("rate_source"))).withColumn("n", copies_of(F.col("rate"), seed, F.col("key"))).filter("n > 0")
    out = met.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    out = out.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), "key", F.col("copy").cast("string"))))
    out = out.repartition("mix_key").sortWithinPartitions("mix_key")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("copy").alias(copy), F.col("mix_key").alias(mix_key))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return poisson_mix(docs, source_rates(docs)).select("doc_id", "source", "copy", "mix_key", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = f"""
WITH RECURSIVE mass AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1) AS mass FROM documents GROUP BY source),
w AS (SELECT sum(pow(mass::DOUBLE, {ALPHA})) AS w, sum(mass) AS m FROM mass),
rates AS (SELECT source, round(m * pow(mass::DOUBLE, {ALPHA}) / w / mass, 6) AS rate FROM mass, w),
cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 10 * sqrt(rate) + 40)),
u AS (
  SELECT doc_id, source, sha256(coalesce(text, '')) AS text_sha256,
         (CAST('0x' || substr(md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, '1')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
n AS (
  SELECT u.doc_id, u.source, u.text_sha256, min(k) AS n
  FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c >= u.u
  GROUP BY ALL)
SELECT doc_id, source, copy::INT AS copy, md5(concat_ws('|', '{SEED}:order', doc_id::VARCHAR, copy::VARCHAR)) AS mix_key, text_sha256
FROM n, LATERAL (SELECT unnest(range(1, n.n + 1)) AS copy)
"""
