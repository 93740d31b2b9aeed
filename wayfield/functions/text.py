"""Names and labels: normalising, fuzzy matching, quality keys, safe numbers."""

from __future__ import annotations

import os
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that are another letter with marks, and that other letter (lower case, of two bytes at most)."""
    pairs = []
    for point in range(0xC0, 0x250):
        c = chr(point)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize(text: Column) -> Column:
    """Lower case, trimmed, Latin letters without their marks, loose marks dropped."""
    bare = F.translate(F.lower(F.trim(text)), *_accents())
    return F.regexp_replace(bare, r"\p{Mn}+", "")


def token_sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normalize(text), r"\s+")), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the texts with their words in order."""
    x, y = token_sorted(a), token_sorted(b)
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def best_match(df: DataFrame, column: str, name: str, order: str) -> DataFrame:
    """The row whose ``column`` equals ``name`` when both are normalised, else the most similar (the least ``order`` among equals)."""
    wanted = F.lit(name)
    exact = (normalize(F.col(column)) == normalize(wanted)).cast("int")
    ranked = df.withColumns({"__exact": F.coalesce(exact, F.lit(0)), "__like": F.coalesce(similarity(F.col(column), wanted), F.lit(-1.0))})
    return ranked.orderBy(F.desc("__exact"), F.desc("__like"), order).limit(1).drop("__exact", "__like")


def best_matches(names: DataFrame, df: DataFrame, name: str, column: str, order: str, least: float = 0.6) -> DataFrame:
    """The best match of each of a few names (broadcast; at most 1,000 are taken), where it is at least ``least`` similar."""
    if names.limit(1001).count() > 1000:
        raise ValueError("at most 1,000 names can be matched at once")
    met = df.join(F.broadcast(names.select(F.col(name).alias("__wanted")).distinct()), similarity(F.col(column), F.col("__wanted")) >= least)
    score = F.struct((normalize(F.col(column)) == normalize(F.col("__wanted"))).cast("int").alias("e"), similarity(F.col(column), F.col("__wanted")).alias("s"))
    best = met.withColumn("__score", score).groupBy("__wanted").agg(F.max(F.struct("__score", (-F.col(order)).alias("o"), F.col(column).alias("m"))).alias("b"))
    return best.select(F.col("__wanted").alias(name), F.col("b.m").alias("match"), F.round("b.__score.s", 6).alias("similarity"))


def sanitized(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def quality_key(value: Column) -> Column:
    """A quality in thousandths, for comparisons that binary fractions cannot upset."""
    return F.round(value * 1000).cast("int")


def quality_text(value: Column) -> Column:
    """A quality as text with three decimals; null stays null."""
    key = quality_key(value)
    return F.when(value.isNotNull(), F.concat(F.when(key < 0, "-").otherwise(""), F.floor(F.abs(key) / 1000).cast("string"), F.lit("."), F.lpad((F.abs(key) % 1000).cast("string"), 3, "0")))


def without_null_words(df: DataFrame, columns: list[str]) -> DataFrame:
    """"nan", "None" and NaN are null; rows with null in all of ``columns`` go."""
    kinds = dict(df.dtypes)
    fixed = {}
    for c in columns:
        if kinds[c] == "string":
            fixed[c] = F.when(~F.col(c).isin("nan", "None"), F.col(c))
        elif kinds[c] in ("double", "float"):
            fixed[c] = F.when(~F.isnan(c), F.col(c))
    return df.withColumns(fixed).na.drop(how="all", subset=columns)


def number(value: Column) -> Column:
    """Text as a double, null where it is none; infinite counts as 0."""
    v = value.try_cast("double")
    return F.when(F.isnan(v), None).when(F.abs(v) == F.lit(sys.float_info.max) * 10, 0.0).otherwise(v)


def condensed(df: DataFrame, columns: list[str], listed: list[str] | None = None) -> Column:
    """The first non-null of the columns; with ``listed`` the first listed value that any of them has."""
    if listed is None:
        return F.coalesce(*(F.col(c) for c in columns))
    values = F.array(*(F.col(c) for c in columns))
    return F.coalesce(*(F.when(F.array_contains(values, v), F.lit(v)) for v in listed))


def folder_of(path: str) -> str:
    """The folder of a path that ends in a file name with an extension, else the path itself."""
    return os.path.dirname(path) if os.path.splitext(path)[1] else path
