"""Abbreviations that texts explain: "long form (LF)"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import LEAD_WORDS
from ..functions.text import boundary_safe, text_of

EXPLAINED = r"([A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z][A-Za-z0-9-]*){1,5})\s*\(\s*([A-Za-z][A-Za-z0-9-]{1,9})\s*\)"


def long_form(phrase: Column, short: Column) -> Column:
    """The last words of a phrase whose initials are the abbreviation, or null."""
    words = F.split(F.lower(phrase), r"\s+")
    n = F.length(short)
    tail = F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n)
    initials = F.array_join(F.transform(tail, lambda w: F.substring(w, 1, 1)), "")
    fits = (F.size(words) >= n) & (initials == F.lower(short)) & ~F.get(tail, F.lit(0)).isin(*sorted(LEAD_WORDS))
    return F.when(fits, F.array_join(tail, " "))


def mine(texts: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(short, long, n): the long form seen most for each abbreviation, at least `least` times; ties go to the smaller text."""
    whole = F.regexp_extract_all(text_of(F.col(text)), F.lit(EXPLAINED), F.lit(0))
    found = texts.select(F.explode(whole).alias("at")).select(F.regexp_extract("at", EXPLAINED, 1).alias("phrase"), F.lower(F.regexp_extract("at", EXPLAINED, 2)).alias("short"))
    pairs = found.select("short", long_form(F.col("phrase"), F.col("short")).alias("long")).filter("long is not null")
    counted = pairs.groupBy("short", "long").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    best = Window.partitionBy("short").orderBy(F.desc("n"), "long")
    return counted.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")


def long_without_short(texts: DataFrame, doc: str, text: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(short, doc): texts that have a long form but not its abbreviation; pairs: (short, long), a bounded list."""
    safe = F.lower(boundary_safe(text_of(F.col(text))))
    tests = [F.when(safe.rlike(rf"\b{long.replace(' ', chr(92) + 's+')}\b") & ~safe.rlike(rf"\b{short}\b"), short) for short, long in pairs]
    return texts.select(F.col(doc).alias("doc"), F.explode(F.array_compact(F.array(*tests))).alias("short"))
