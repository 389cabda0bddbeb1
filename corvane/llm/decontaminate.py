"""Benchmark decontamination by winnowing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, let, store

#: Up to so many rows (of at most some hundred bytes) a benchmark's table, or the ids of candidates, are broadcast, beyond it joined by a shuffle.
BROADCAST_ROWS = 200_000
GRAM = 4
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, then runs of digits, letters and anything beyond ASCII."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), ""), F.array().cast("array<string>"))


def _starts(n_words: Column, span: int) -> Column:
    return F.when(n_words >= span, F.sequence(F.lit(0), n_words - span)).otherwise(F.array().cast("array<int>"))


def _gram_hashes(words: Column, gram: int) -> Column:
    return F.transform(_starts(F.size(words), gram), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(gram)]))


def fingerprints(words: Column, span: int) -> Column:
    """Winnowing: the minimum gram hash of every window of `span` words, once a run of windows, as (start, last, fp).

    Grams have GRAM words, or `span` in shorter windows. Equal windows have equal
    minima, so a shared span of that many words is always found.
    """
    gram = min(GRAM, span)
    wide = span - gram + 1
    minima = lambda h: F.transform(_starts(F.size(h), wide), lambda i: F.array_min(F.slice(h, i + 1, wide)))
    firsts = lambda m: F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (x != F.get(m, i - 1)), F.struct(i.alias("start"), x.alias("fp")))), lambda s: s.isNotNull())
    ended = lambda r, n: F.transform(r, lambda x, i: F.struct(x["start"].alias("start"), (F.coalesce(F.get(r, i + 1)["start"], n) - 1).alias("last"), x["fp"].alias("fp")))
    return let(words, lambda w: let(_gram_hashes(w, gram), lambda h: let(minima(h), lambda m: let(firsts(m), lambda r: ended(r, F.size(m))))))


def _window(words: Column, start: Column, span: int) -> Column:
    return F.array_join(F.slice(words, start + 1, span), " ")


def _fit(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = 8, min_items: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_hit, n_items, items and contaminated to the kept columns of every document.

    A window is `span` consecutive words of an item; an item of fewer words, but not none, is
    one window. A word inside any occurrence of a window is hit; items are the sorted ids (as
    strings) of those with an occurring window; contaminated: at least min_items of them.

    Null and empty texts have no words. Items without an id or words count for nothing, and
    rows with one id are one item. Repeated documents are repeated; rows of equal id and text
    share their figures. Clashing columns are replaced. A window that a third of the
    documents have meets the benchmark's tables in a broadcast while these have at most
    BROADCAST_ROWS rows, else in a join that can be split.
    """
    new = ("n_words", "n_hit", "n_items", "items", "contaminated")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    items = bench.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).filter("item is not null and size(words) > 0")
    longest = store(items.withColumn("span", F.least(F.size("words"), F.lit(span))), "items")
    spans = sorted(r[0] for r in longest.select("span").distinct().collect())  # 1 to span
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("text is not null")
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), "text")
    found = None
    for n in spans:
        own = longest.filter(F.col("span") == n)
        windows = own.select("item", F.explode(let(F.col("words"), lambda w: F.transform(_starts(F.size(w), n), lambda i: _window(w, i, n)))).alias("window")).distinct()
        windows = store(windows, "windows")
        n_windows = windows.count()
        test = own.select(F.explode(fingerprints(F.col("words"), n)).alias("at")).select("at.fp").distinct()
        marked = rows.select("id", "text_hash", F.explode(fingerprints(words_of(F.col("text")), n)).alias("at")).select("id", "text_hash", "at.start", "at.last", "at.fp")
        candidates = marked.join(_fit(test, n_windows), "fp", "left_semi").groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "last")).alias("runs"))
        candidates = store(candidates.withColumnsRenamed({"id": "c_id", "text_hash": "c_hash"}), "candidates")
        same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash"))
        few = candidates.count() <= BROADCAST_ROWS  # then only their texts are shuffled
        texts = rows.join(F.broadcast(candidates.select("c_id", "c_hash")), same, "left_semi") if few else rows
        met = texts.join(candidates, same).drop("c_id", "c_hash").dropDuplicates(["id", "text_hash"])
        spread = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["last"])))
        tried = let(words_of(F.col("text")), lambda w: F.transform(spread, lambda i: F.struct(i.alias("start"), _window(w, i, n).alias("window"))))
        hits = met.select("id", "text_hash", F.explode(tried).alias("at")).select("id", "text_hash", "at.start", "at.window")
        hits = hits.join(_fit(windows.select("window").distinct(), n_windows), "window", "left_semi")
        part = store(hits.select("id", "text_hash", "start", F.lit(n).alias("n"), "window"), "hits")
        per_item = part.select("id", "text_hash", "window").distinct().join(_fit(windows, n_windows), "window").select("id", "text_hash", "item").distinct()
        part = (part.select("id", "text_hash", "start", "n"), per_item)
        found = part if found is None else tuple(a.unionByName(b) for a, b in zip(found, part, strict=True))
    base = docs.select(*keep, F.col(id_col).alias(free_name(docs, "id_")), F.xxhash64(text).alias(free_name(docs, "hash_")), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    empty = F.array().cast("array<string>")
    if found is None:
        return base.select(*keep, "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), empty.alias("items"), F.lit(0 >= min_items).alias("contaminated"))
    spots, item_hits = found
    # Covered words: each interval adds what lies beyond the ends of those before it.
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).alias("sum"), F.greatest(a["end"], x["end"]).alias("end"))
    cover = spots.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("at")).select("id", "text_hash", F.aggregate("at", start, step)["sum"].cast("long").alias("hit"))
    listed = item_hits.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("list"))
    both = cover.join(listed, cover["id"].eqNullSafe(listed["id"]) & (cover["text_hash"] == listed["text_hash"])).select(cover["id"].alias("r_id"), cover["text_hash"].alias("r_hash"), "hit", "list")
    id_, hash_ = base.columns[len(keep) : len(keep) + 2]
    met = base.join(both, F.col(id_).eqNullSafe(F.col("r_id")) & (F.col(hash_) == F.col("r_hash")), "left")
    n_items = F.when(F.col("list").isNull(), 0).otherwise(F.size("list")).cast("long")
    return met.select(*keep, "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.coalesce("list", empty).alias("items"), (n_items >= min_items).alias("contaminated"))
