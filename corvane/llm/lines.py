"""Line dedup by log templates, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, store

WILDCARD = "<*>"
#: Slots of the bounded filter that goes ahead of the join of lines with the leaves of interest.
SLOTS = 1 << 16


#: A token with a digit, which may be a variable field.
FIELD = "[^ ]*[0-9][^ ]*"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def masked(line: Column, similarity: float) -> Column:
    """A trimmed line whose tokens with a digit are a wildcard; tokens are what single spaces separate.

    A line of which less than `similarity` of the tokens would be left stays as it is, so that
    rows of numbers only recur if they are equal.
    """
    trimmed = F.trim(line)
    tokens = _spaces(trimmed) + 1
    few = tokens - F.regexp_count(trimmed, F.lit(FIELD)) >= similarity * tokens
    return F.when(trimmed.rlike("[0-9]") & few, F.regexp_replace(trimmed, FIELD, WILDCARD)).otherwise(trimmed)


def leaf_of(template: Column, depth: int) -> Column:
    """The leaf of the parse tree: token count, then the leading tokens, as a hash."""
    return F.xxhash64(_spaces(template), F.substring_index(template, " ", depth))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _parsed(docs: DataFrame, id_col: str, text: str, depth: int, similarity: float) -> DataFrame:
    """For each document the leaf and the two template hashes (64 and 32 bits) of every line; blank lines have null."""
    entry = F.transform(
        F.transform(_lines(F.col("text")), lambda x: masked(x, similarity)),
        lambda t: F.when(t != "", F.struct(leaf_of(t, depth).alias("leaf"), F.xxhash64(t).alias("line"), F.hash(t).alias("check"))),
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return rows.select("id", F.xxhash64("text").alias("text_hash"), entry.alias("lines"))


def _variants(docs: DataFrame, text: str, exact: DataFrame, depth: int, min_docs: int, similarity: float) -> DataFrame:
    """Generalised templates (line, check, template, template_check) of the leaves in which lines differ.

    A token is constant if its leaf has it at its position in min_docs documents; other
    positions and tokens with a digit are wildcards. A line takes part if enough of its tokens are constant.
    """
    leaves = exact.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("kinds")).filter(f"docs >= {min_docs} and kinds > 1").select("leaf")
    wanted = store(exact.join(leaves, "leaf", "left_semi"), "variants")
    slots = wanted.select(F.pmod("leaf", F.lit(SLOTS)).alias("slot")).distinct()
    lines = docs.select(F.explode(_lines(F.col(text))).alias("raw")).select(masked(F.col("raw"), similarity).alias("text")).filter("text <> ''")
    lines = lines.withColumn("leaf", leaf_of(F.col("text"), depth)).withColumn("slot", F.pmod("leaf", F.lit(SLOTS)))
    near = lines.join(F.broadcast(slots), "slot", "left_semi")  # at most SLOTS numbers
    texts = near.select(F.xxhash64("text").alias("line"), F.hash("text").alias("check"), "text").distinct()
    tokens = wanted.join(texts, ["line", "check"]).select("leaf", "line", "check", "n", F.posexplode(F.split("text", " ", -1)).alias("pos", "token"))
    tokens = store(tokens, "tokens")
    support = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("support")).filter(f"support >= {min_docs}").select("leaf", "pos", "token", F.lit(1).alias("same"))
    general = tokens.join(support, ["leaf", "pos", "token"], "left").groupBy("leaf", "line", "check").agg(
        F.count("*").alias("tokens"),
        F.count(F.when(F.col("token") != WILDCARD, F.col("same"))).alias("constants"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("same") == 1, F.col("token")).otherwise(WILDCARD).alias("token")))), lambda x: x["token"]), " ").alias("shape"),
    )
    return general.filter(F.col("constants") >= similarity * F.col("tokens")).select("line", "check", F.xxhash64("leaf", "shape").alias("template"), F.hash("leaf", "shape").alias("template_check"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = 4, min_docs: int = 3, similarity: float = 0.8) -> DataFrame:
    """Drops the lines whose template recurs in at least min_docs documents, but for its first line.

    A fixed-depth tree sorts lines by token count and leading tokens; tokens with a digit
    are wildcards from the start, and within a leaf so are positions whose token has too few
    documents. At least `similarity` of a template's tokens are constant, so that lines which
    differ in more than that recur only as they are. Lines and templates are told apart by 96 bits of two hashes. First is the line of the smallest (id, hash of the text, line number), which
    stays. Adds n_lines and n_dropped and replaces the text; clashing columns are replaced.

    Null texts stay null with 0 lines, empty ones are one line, blank lines always stay. Rows of equal id
    and text share their decisions and count as documents of their own; a null id is an id
    like any other, the smallest. Within one document repeated lines count once. A template
    with a third of all rows is counted with partial sums, and its lines meet their decision
    in a join that can be split.
    """
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c not in (id_col, text)])
    parsed = store(_parsed(docs, id_col, text, depth, similarity), "lines")
    lines = parsed.select("id", "text_hash", F.posexplode("lines").alias("no", "at")).filter("at is not null").select("id", "text_hash", "no", "at.line", "at.check")
    once = parsed.select("id", "text_hash", F.explode(F.array_distinct("lines")).alias("at")).filter("at is not null").select("id", "text_hash", "at.leaf", "at.line", "at.check")
    exact = store(once.groupBy("leaf", "line", "check").agg(F.count("*").alias("n"), F.min(F.struct("id", "text_hash")).alias("first")), "templates")
    general = _variants(docs, text, exact, depth, min_docs, similarity)
    names = [F.coalesce("template", "line").alias("template"), F.coalesce("template_check", "check").alias("template_check")]
    groups = exact.join(general, ["line", "check"], "left").select("line", "check", *names, "n", "first")
    recurring = groups.groupBy("template", "template_check").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter(f"n >= {min_docs}").select("template", "template_check", "first")
    decided = store(groups.select("line", "check", "template", "template_check").join(recurring, ["template", "template_check"]), "decided")
    hit = lines.join(decided, ["line", "check"])
    own_first = F.struct("id", "text_hash").eqNullSafe(F.col("first"))
    per_doc = hit.groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_set(F.when(~own_first, F.col("no")))).alias("others"),
        F.sort_array(F.collect_set(F.when(own_first, F.struct("template", "template_check", "no")))).alias("own"),
    )
    # Of the lines whose first document this is, the first of each template stays.
    later = let(F.col("own"), lambda own: F.filter(F.transform(own, lambda x, i: F.when((i > 0) & (F.get(own, i - 1)["template"] == x["template"]) & (F.get(own, i - 1)["template_check"] == x["template_check"]), x["no"])), lambda n: n.isNotNull()))
    drops = per_doc.select(F.col("id").alias("d_id"), F.col("text_hash").alias("d_hash"), F.concat("others", later).alias("drop_"))
    hash_ = free_name(docs, "hash_")
    left = docs.withColumn(hash_, F.xxhash64(F.col(text)))
    met = left.join(drops, F.col(id_col).eqNullSafe(F.col("d_id")) & (F.col(hash_) == F.col("d_hash")), "left")
    all_lines = _lines(F.col(text))
    kept = let(all_lines, lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("drop_")), lambda i: F.get(own, i)))
    dropped = F.when(F.col("drop_").isNull(), 0).otherwise(F.size("drop_"))
    return met.select(
        *[F.when(F.col("drop_").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    )
