"""Column functions that Spark lacks or that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_distance(a: Column, b: Column) -> Column:
    """FUN-10: Euclidean distance of two arrays, in double."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def clamp(x: Column, low: float, high: float) -> Column:
    """FUN-6."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column, zero: float = float("nan")) -> Column:
    """FUN-6: a / b, with a set value on a zero base."""
    return F.when(b == 0, F.lit(zero)).otherwise(a / b)


def normal_path(path: Column) -> Column:
    """FUN-5: `.` and empty parts go, `..` takes the part before it, if there is one; a leading slash stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    pop = lambda s, p: (p == "..") & (F.size(s) > 0) & (F.try_element_at(s, F.lit(-1)) != "..")
    step = lambda s, p: F.when(pop(s, p), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).when((p == "..") & path.startswith("/"), s).otherwise(F.concat(s, F.array(p)))
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(folded, "/"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension_stripped(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def capped(text: Column, n: int) -> Column:
    """FUN-4, PRJ-16: text cut at n characters, the last one a mark of it."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("~"))).otherwise(text)


def key_class(key: Column) -> Column:
    """FUN-12."""
    return F.split_part(key, F.lit(":"), F.lit(1))


#: What redaction takes out: pattern and replacement.
SECRETS = (
    (r"token = \"[0-9a-f]{40}\"", "token = \"[secret]\""),
    (r"\b[0-9]{16}\b", "[number]"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[address]"),
    (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "[mail]"),
)


def redacted(text: Column) -> Column:
    """SRC-7: secrets and personal data replaced, one pattern after another."""
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text
