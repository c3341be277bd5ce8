"""Digests of tables and groups that depend on no order: sums of row hashes, so that no group is gathered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A row's SHA-256 counts as so many numbers of so many hex digits, each summed by itself.
PARTS, DIGITS = 4, 15


#: Numbers are summed in two halves, which stay longs for up to 2 ** 33 rows of a group; sums of decimals take several times as long.
HALF = 30


def summed_parts(text: Column) -> list[Column]:
    """Aggregates n, s0 to s3: the number of rows and the sums of their hashes. They add up and subtract over parts of a table."""
    row = F.sha2(F.coalesce(text, F.lit("\0")), 256)

    def summed(i: int) -> Column:
        number = F.conv(F.substring(row, 1 + DIGITS * i, DIGITS), 16, 10).cast("long")
        high, low = F.sum(F.shiftright(number, HALF)), F.sum(number.bitwiseAND((1 << HALF) - 1))
        return (high.cast("decimal(28,0)") * F.lit(1 << HALF).cast("decimal(10,0)") + low.cast("decimal(28,0)")).cast("decimal(38,0)")

    return [F.count(F.lit(1)).alias("n"), *[summed(i).alias(f"s{i}") for i in range(PARTS)]]


def row_parts(text: Column) -> list[Column]:
    """What one row's text adds to the sums of summed_parts; zeros for a null, which is no row here."""
    row = F.sha2(text, 256)
    return [F.coalesce(F.conv(F.substring(row, 1 + DIGITS * i, DIGITS), 16, 10), F.lit("0")).cast("decimal(38,0)") for i in range(PARTS)]


def digest_of(n: Column, *sums: Column) -> Column:
    """The digest that goes with such numbers."""
    return F.sha2(F.concat_ws(":", n.cast("string"), *[s.cast("string") for s in sums]), 256)


def summed_digest(text: Column) -> Column:
    """Aggregate: a SHA-256 over the number of rows and the sums of their hashes. Equal rows count as often as they come; null texts count as rows."""
    return digest_of(*summed_parts(text))


def summed_digest_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    row = f"sha256(coalesce({text}, chr(0)))"
    sums = ", ".join(f"sum(CAST('0x' || substr({row}, {1 + DIGITS * i}, {DIGITS}) AS BIGINT))::VARCHAR" for i in range(PARTS))
    return f"sha256(concat_ws(':', count(*)::VARCHAR, {sums}))"


def row_text(*columns: str | Column) -> Column:
    """Columns as one text, nulls apart from empty texts."""
    return F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N")) for c in columns])


def row_text_sql(*columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(({c})::VARCHAR, '\\N')" for c in columns) + ")"
