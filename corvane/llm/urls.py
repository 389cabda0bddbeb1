"""URL block and allow lists by host suffix and path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name

HASH_PREFIX_BYTES = 4


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs, a rule being host then path, as rows (rule, verdict, host, path, digest)."""
    rows = [(rule, verdict, rule.partition("/")[0].lower(), "".join(rule.partition("/")[1:])) for verdict, rule in rules]
    made = spark.createDataFrame(rows, "rule string, verdict string, rule_host string, rule_path string")
    return made.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 2 * HASH_PREFIX_BYTES), 16, 10).cast("long")


def expressions(urls: DataFrame, lengths: list[int], host: str = "host", path: str = "path") -> DataFrame:
    """Each row once for every suffix of its host and every listed length of its path, as (.., host_suffix, path_prefix)."""
    labels = F.split(F.col(host), "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    spread = urls.withColumn("host_suffix", F.explode(suffixes)).withColumn("prefix_length", F.explode(fitting))
    return spread.withColumn("path_prefix", F.substring(F.col(path), F.lit(1), F.col("prefix_length"))).drop("prefix_length")


def judge_urls(pages: DataFrame, rules: DataFrame, lengths: list[int], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    rules: as from rule_table; lengths: the lengths of their paths. A rule fits its host and
    all subdomains if the path starts with the rule's, character by character. The longest
    rule wins; of equally long ones that with the longer host, then the smaller text. Without
    a rule: rule null, the default verdict. A null url, or one without ://, has an empty host
    and path, which no rule fits. Every distinct (host, path) is judged once, so that a host or
    URL with a third of the rows costs one row; repeated rows stay. Columns of the input that
    clash with the four new ones are replaced.
    """
    if not lengths:
        found = pages.sparkSession.createDataFrame([], "host string, path string, rule string, verdict string")
    else:
        keyed = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).distinct()
        wide = expressions(keyed, lengths).withColumn("own_digest", _digest(F.col("host_suffix"), F.col("path_prefix")))
        short_rules = rules.withColumn("short", _short(F.col("digest")))
        hits = wide.withColumn("short", _short(F.col("own_digest"))).join(short_rules, "short").filter("own_digest = digest")
        rank = F.struct((-F.length("rule")).alias("n"), (-F.length("rule_host")).alias("m"), F.col("rule"), F.col("verdict"))
        found = hits.groupBy("host", "path").agg(F.min(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    plain = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    own_url = free_name(plain, "url_")
    base = plain.withColumn(own_url, F.col(url)).drop("host", "path", "rule", "verdict").select(
        "*", host_of(F.col(own_url)).alias("host"), path_of(F.col(own_url)).alias("path")
    ).drop(own_url)
    joined = base.join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return joined.select(*[c for c in base.columns if c not in ("host", "path")], "host", "path", "rule", "verdict")
