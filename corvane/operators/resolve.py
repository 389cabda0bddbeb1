"""Records: which are the same, whom they belong to, and texts put together."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import country_label, is_junk_name, region_label, section_label, village
from ..functions.text import slug, strip, text_of
from .places import globally

# Words of institutions that names are compared without.
NOISE_WORDS = ("university", "universite", "universitat", "universidad", "college", "school", "institute", "technology", "team", "the")
MATCH_RANK = {"exact": 0, "relaxed": 1, "fuzzy": 2, "prefix": 3}
CLOSE = 0.88
PREFIX_LENGTH = 5
FIRST_YEAR, LAST_YEAR = 2004, 2025


def first_records(raw: DataFrame) -> DataFrame:
    """One record for each (slug, year) of years 2004 to 2025: that of the first root, then path. raw: (slug, year, root, path, ..)."""
    order = Window.partitionBy("slug", "year").orderBy("root", "path")
    kept = raw.filter((F.col("slug") != "") & F.col("year").between(FIRST_YEAR, LAST_YEAR))
    return kept.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def numbered(records: DataFrame) -> DataFrame:
    """Adds doc, the place in the order of (slug, year), from 0 on."""
    return globally(records, [F.col("slug"), F.col("year")], "doc").withColumn("doc", F.col("doc") - 1)


def name_keys(name: Column, noise: tuple[str, ...] = NOISE_WORDS) -> Column:
    """The slug, then without a year at its end, then without noise words."""
    s = slug(name)
    plain = F.regexp_replace(s, "(19|20)[0-9]{2}$", "")
    bare = F.regexp_replace(plain, "|".join(noise), "")
    keys = F.array(s, F.when(plain != "", plain), F.when(bare != "", bare))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def directory_keys(directory: DataFrame, noise: tuple[str, ...] = NOISE_WORDS) -> DataFrame:
    """(key, year, row): the first row of a directory (row, name, year, ..) for each key and year."""
    spread = directory.select("row", "year", F.explode(name_keys(F.col("name"), noise)).alias("key"))
    return spread.groupBy("key", "year").agg(F.min("row").alias("row"))


def resolve(records: DataFrame, directory: DataFrame, noise: tuple[str, ...] = NOISE_WORDS) -> DataFrame:
    """(id, row, match) for records (id, name, year): whom the directory (row, name, year) says each belongs to.

    In turn: no record's name, no year, a year the directory hasn't; the same slug; a
    relaxed key; one name a prefix of the other (keys of five letters and more, one row only);
    a spelling at least 0.88 alike. Only what a step leaves goes to the next, and each step
    is a join on (year, ..): prefixes by expanding the name's own prefixes and the keys', and
    close spellings within a year, in batches, against that year's keys.
    """
    keys = directory_keys(directory, noise)
    base = records.select("id", "name", "year", slug(F.col("name")).alias("s"), name_keys(F.col("name"), noise).alias("keys"))
    years = keys.select("year").distinct().withColumn("known", F.lit(True))
    based = base.join(years, "year", "left")
    no_match = F.when(is_junk_name(F.col("name")), "not-a-team").when(F.col("year").isNull(), "no-year").when(F.col("known").isNull(), "no-such-year")
    outside = based.filter(no_match.isNotNull()).select("id", F.lit(None).cast("long").alias("row"), no_match.alias("match"))
    left = based.filter(no_match.isNull()).drop("known")
    tried = left.select("id", "year", F.posexplode("keys").alias("step", "key")).join(keys, ["year", "key"])
    equal = tried.groupBy("id").agg(F.min_by("row", "step").alias("row"), F.min("step").alias("step"))
    equal = equal.select("id", "row", F.when(F.col("step") == 0, "exact").otherwise("relaxed").alias("match"))
    left = left.join(equal, "id", "left_anti")
    long_keys = keys.filter(F.length("key") >= PREFIX_LENGTH)
    prefixes = lambda c, least: F.transform(F.sequence(F.lit(least), F.greatest(F.length(c), F.lit(least))), lambda n: F.substring(c, F.lit(1), n))
    # A key that starts the name is one of the name's prefixes; a name that starts a key one of the key's.
    starts = left.select("id", "year", F.explode(F.array_distinct(prefixes(F.col("s"), PREFIX_LENGTH))).alias("key")).join(long_keys, ["year", "key"])
    longer = long_keys.select("year", "row", F.explode(prefixes(F.col("key"), 1)).alias("s")).join(left.select("id", "year", "s"), ["year", "s"])
    unique = starts.select("id", "row").unionByName(longer.select("id", "row")).groupBy("id").agg(F.min("row").alias("row"), F.max("row").alias("other")).filter("row = other")
    by_prefix = unique.select("id", "row", F.lit("prefix").alias("match"))
    left = left.join(by_prefix, "id", "left_anti")
    fuzzy = close_names(left.select("id", "year", "s"), keys).select("id", "row", F.lit("fuzzy").alias("match"))
    rest = left.join(fuzzy, "id", "left_anti").select("id", F.lit(None).cast("long").alias("row"), F.lit("unmatched").alias("match"))
    return outside.unionByName(equal).unionByName(by_prefix).unionByName(fuzzy).unionByName(rest)


def _pieces(col: Column) -> Column:
    """(at, text) of a name's pieces: more of them than letters can differ between it and a name that is CLOSE to it."""
    n = F.length(col)
    # Alike means 2 M >= CLOSE (a + b) for M equal letters, so b <= (2 / CLOSE - 1) a, and all but 2 M letters differ.
    differ = F.floor((1 - CLOSE) * n * (2 / CLOSE) + 1e-9)
    cut = lambda i: F.floor(i * n / (differ + 1)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0).cast("long"), differ), lambda i: F.substring(col, cut(i) + 1, cut(i + 1) - cut(i))), lambda x: x != "")


def close_names(names: DataFrame, keys: DataFrame, cutoff: float = CLOSE) -> DataFrame:
    """(id, row): the keys of the year that are most alike (Ratcliff-Obershelp), if one alone or both of the best two are of one row.

    Names and keys meet at the name's pieces, one of which a close key has as it is; only pairs of
    fitting lengths are compared. names: (id, year, s), keys: (year, key, row).
    """

    @F.pandas_udf("double")
    def alike(key: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, k, s).ratio() for k, s in zip(key, name, strict=True)], dtype="float64")

    wanted = names.filter("s <> ''").select("id", "year", "s", F.explode(F.array_distinct(_pieces(F.col("s")))).alias("piece")).withColumn("size", F.length("piece"))
    sizes = wanted.select("year", "size").distinct()
    places = F.sequence(F.lit(1), F.greatest(F.length("key") - F.col("size") + 1, F.lit(1)))
    spread = keys.filter("key <> ''").join(sizes, "year").filter(F.length("key") >= F.col("size"))
    spread = spread.select("year", "row", "key", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("key", i, F.col("size"))))).alias("piece"))
    fits = 2 * F.least(F.length("s"), F.length("key")) >= cutoff * (F.length("s") + F.length("key")) - 1e-9
    pairs = wanted.join(spread, ["year", "piece"]).filter(fits).select("id", "s", "key", "row").distinct()
    near = pairs.withColumn("ratio", alike("key", "s")).filter(F.col("ratio") >= cutoff)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ratio"), F.desc("key")))
    two = near.withColumn("nth", best).filter("nth <= 2").groupBy("id").agg(F.min("row").alias("row"), F.max("row").alias("other"))
    return two.filter("row = other").select("id", "row")


def page_name(url: Column) -> Column:
    """Letters and digits of an address's last part, after a colon if it has one."""
    last = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "([^/]*)$", 1)
    return slug(F.regexp_replace(last, "^[^:]*:", ""))


def duplicate_groups(records: DataFrame) -> DataFrame:
    """(id, winner) of all records but examples: those of one address are one, whose winner stays.

    records: (id, name, url, match, ..). The winner has the best match, a name like its page's,
    the shortest name, then the smallest id. A record without an address is alone. Groups are rows, however many
    records one address has.
    """
    kept = records.filter(~F.coalesce(F.col("name"), F.lit("")).rlike(r"(?i)^example([\W_]|$)"))
    group = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.col("url")).otherwise(F.col("id"))
    rank = F.lit(4)
    for name, r in MATCH_RANK.items():
        rank = F.when(F.col("match") == name, r).otherwise(rank)
    order = F.struct(rank.alias("r"), (slug(F.col("name")) != page_name(F.col("url"))).alias("d"), F.length(F.coalesce("name", F.lit(""))).alias("l"), F.col("id").alias("i"))
    marked = kept.select("id", group.alias("_group"), order.alias("_order"))
    best = marked.groupBy("_group").agg(F.min("_order")["i"].alias("winner"))
    return marked.join(best, "_group").select("id", "winner").distinct()


def dedupe(records: DataFrame) -> DataFrame:
    """The records that stay, with n_merged, the number of others that each stands for."""
    groups = duplicate_groups(records).groupBy(F.col("winner").alias("id")).agg((F.count("*") - 1).alias("n_merged"))
    return records.join(groups, "id")


def merge_lines(texts: DataFrame) -> DataFrame:
    """(grp, text) from (grp, part, text): the first part, 0, whole, of the others the lines not seen before.

    Lines are compared without white space at their ends; blank ones stay. The others lose their outer line feeds,
    blank parts go, the rest is joined by blank lines. A first part alone stays as it is.
    """
    lines = texts.select("grp", "part", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("no", "line"))
    lines = lines.withColumn("bare", strip(F.col("line")))
    seen = F.row_number().over(Window.partitionBy("grp", "bare").orderBy("part", "no"))
    kept = lines.withColumn("nth", seen).filter((F.col("part") == 0) | (F.col("bare") == "") | (F.col("nth") == 1))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda x: x["line"])
    parts = kept.groupBy("grp", "part").agg(F.array_join(ordered, "\n").alias("body"))
    own = F.when(F.col("part") == 0, F.col("body")).otherwise(F.regexp_replace("body", "^\n+|\n+\\z", ""))
    listed = parts.select("grp", "part", own.alias("body")).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("part", "body"))).alias("parts"))
    filled = F.transform(F.filter("parts", lambda p: strip(p["body"]) != ""), lambda p: p["body"])
    alone = (F.size("parts") == 1) & (F.get("parts", F.lit(0))["part"] == 0)
    return listed.select("grp", F.when(alone, F.get("parts", F.lit(0))["body"]).otherwise(F.array_join(filled, "\n\n")).alias("text"))


def annotate(records: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds qa from notes (slug, year as text, n, qa): the last note of a record wins; notes whose year is no number are skipped."""
    dated = notes.withColumn("year", F.expr("try_cast(trim(year) as int)")).filter("year is not null")
    last = dated.groupBy("slug", "year").agg(F.max_by("qa", "n").alias("qa"))
    return records.join(last, ["slug", "year"], "left")


def enrich(records: DataFrame, matches: DataFrame, directory: DataFrame) -> DataFrame:
    """Records (id, f, ..) with what the directory says of those that `matches` (id, row, match) found there.

    Adds match and city, and to the facets f the labels of region, country and section as far as
    they are given, and today's topic of the track (from village) if it has one. Records without a match keep theirs.
    """
    said = directory.select("row", *[F.col(c).alias(f"d_{c}") for c in ("village", "region", "country", "section", "city")])
    met = records.join(matches.filter("row is not null"), "id", "left").join(said, "row", "left")
    track, domain = strip(text_of(F.col("d_village"))), F.coalesce(F.get(F.try_element_at("f", F.lit("domain")), F.lit(0)), F.lit(""))
    labels = {"track": village(track, domain), "region": region_label(F.col("d_region")), "country": country_label(F.col("d_country")), "section": section_label(F.col("d_section"))}
    labels["track"] = F.when(track != "", labels["track"]).otherwise("")
    given = F.map_filter(F.create_map(*[x for k, c in labels.items() for x in (F.lit(k), F.array(c))]), lambda _, v: F.get(v, F.lit(0)) != "")
    enriched = met.withColumn("f", F.map_concat(F.map_filter("f", lambda k, _: ~F.map_contains_key(given, k)), given))
    return enriched.select(*records.columns, "match", F.coalesce("d_city", F.lit("")).alias("city"))


def sampled(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Evenly spaced rows: those at int(i * n / size). order: columns, ascending."""
    n = rows.count()
    if n <= size:
        return rows
    at = globally(rows, order, "_at").withColumn("_at", F.col("_at") - 1)
    nearest = F.ceil(F.col("_at") * size / n)
    return at.filter(F.floor(nearest * n / size) == F.col("_at")).drop("_at")
