"""Raw summaries to records, cards and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import canonical, is_junk_name
from ..functions.fixed import NOT_TEAMS
from ..functions.text import let, model_name, part_code, part_slug, strip, text_of

ITEM = "struct<name:string,importance:string,role:string>"
ITEMS = f"array<{ITEM}>"
KINDS = {"chassis": "chassis_organisms", "technique": "molecular_techniques", "part": "biological_parts", "molecule": "target_molecules"}
TEXTS = ("summary", "problem_statement", "approach_statement", "novelty_claim")
LISTS = ("key_results", "failure_modes", "key_references")
#: The order in which core names are listed.
CORE_ORDER = ("chassis", "technique", "part", "molecule")


def _elements(raw: Column) -> Column:
    """The elements of JSON text that is a list, as variants."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"), F.array().cast("array<variant>"))


def _string(x: Column, path: str = "$") -> Column:
    """A variant's text at a path if it is text there, else null."""
    found = F.try_variant_get(x, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(x, path, "string"))


def strings_of(raw: Column) -> Column:
    """The texts of a list as JSON; what else it holds goes."""
    return F.filter(F.transform(_elements(raw), lambda x: _string(x)), lambda x: x.isNotNull())


def items_of(raw: Column) -> Column:
    """Items from a list as JSON of objects or texts, or from one text, quoted as JSON or as it is.

    Objects keep name, importance (lower case, "mentioned" unless given) and role; a bare
    text is a core item. Blank names, and whatever is neither object nor text, go.
    """
    stripped = strip(text_of(raw))

    def item(x: Column) -> Column:
        return let(_string(x), lambda bare: named(x, bare))

    def named(x: Column, bare: Column) -> Column:
        given = lambda key, default: F.coalesce(F.nullif(F.try_variant_get(x, f"$.{key}", "string"), F.lit("")), F.lit(default))
        importance = F.when(bare.isNotNull(), "core").otherwise(F.lower(given("importance", "mentioned")))
        role = F.when(bare.isNotNull(), "").otherwise(given("role", ""))
        return F.struct(strip(text_of(F.coalesce(bare, _string(x, "$.name")))).alias("name"), importance.alias("importance"), role.alias("role")).cast(ITEM)

    single = F.coalesce(_string(F.try_parse_json(F.when(stripped.startswith('"'), stripped))), stripped)
    one = F.array(F.struct(strip(single).alias("name"), F.lit("core").alias("importance"), F.lit("").alias("role")).cast(ITEM))
    found = F.when(stripped.startswith("["), F.transform(_elements(stripped), item)).when(stripped.startswith("{") | (stripped == "null"), F.array().cast(ITEMS)).otherwise(one)
    return F.filter(found, lambda x: x["name"] != "")


def names(items: Column) -> Column:
    return F.transform(items, lambda x: x["name"])


def core_names(items: Column) -> Column:
    return names(F.filter(items, lambda x: x["importance"] == "core"))


def labels(kind: str, items: Column) -> Column:
    """Canonical labels, each once, in the order of first sight."""
    return F.array_distinct(F.filter(F.transform(names(items), lambda x: canonical(kind, x)), lambda x: x.isNotNull()))


def coded_parts(items: Column) -> Column:
    """Parts with the registry's code and address slug where their name has one."""
    code = lambda x: part_code(x["name"])
    return F.transform(items, lambda x: F.struct(x["name"].alias("name"), x["importance"].alias("importance"), x["role"].alias("role"), code(x).alias("registry_id"), part_slug(code(x)).alias("registry_slug")))


def build_records(raw: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Records from raw ones (slug, year, team, path and the columns below, all text): junk names go.

    Texts without a value are empty, lists keep their texts, items are parsed; the model's name follows from what is
    declared or the file's name. f has the facets domain, year and the labels of every item column; core the names of core items.
    """
    kept = raw.withColumn("name", strip(F.coalesce(F.nullif(F.col("team"), F.lit("")), F.lit("")))).filter(~is_junk_name(F.col("name")) & ~F.col("slug").isin(*sorted(NOT_TEAMS)))
    items = {kind: items_of(F.col(c)) for kind, c in KINDS.items()}
    given = kept.select(
        F.concat_ws("-", "slug", F.col("year").cast("string")).alias("id"), "slug", "year", "name", *[text_of(F.col(c)).alias(c) for c in TEXTS], *[strings_of(F.col(c)).alias(c) for c in LISTS],
        *[items[kind].alias(c) for kind, c in KINDS.items()], *[strip(text_of(F.col(c))).alias(c) for c in ("track", "application_domain")], model_name(F.col("model"), F.col("processed_by"), F.col("path"), aliases).alias("model"),
    )
    domain = canonical("domain", F.col("application_domain"))
    labelled = {"domain": F.when(domain.isNotNull(), F.array(domain)), **{kind: labels(kind, F.col(c)) for kind, c in KINDS.items()}, "year": F.array(F.col("year").cast("string"))}
    facets = F.map_filter(F.create_map(*[x for kind, c in labelled.items() for x in (F.lit(kind), c)]), lambda _, v: F.size(F.coalesce(v, F.array().cast("array<string>"))) > 0)
    core = F.concat(*[core_names(F.col(KINDS[k])) for k in CORE_ORDER])
    full = given.withColumn("f", facets).withColumn("core", core)
    return full.withColumn("biological_parts", coded_parts(F.col("biological_parts"))).withColumn("target_molecules", names(F.col("target_molecules")))


def with_cards(results: DataFrame, cards: DataFrame) -> DataFrame:
    """Results (doc, ..) with what is shown of each document; a result without a card is left out."""
    return results.join(cards, "doc")


def by_id(records: DataFrame, ids: list[str]) -> DataFrame:
    """Records by their id, whatever its case."""
    return records.filter(F.lower("id").isin(*[i.lower() for i in ids]))


def searchable_names(*arrays: Column, more: tuple[Column, ...] = ()) -> Column:
    """All names of a record as one text, fields being joined by a space."""
    return F.concat_ws(" ", *arrays, *more)


def cards(records: DataFrame) -> DataFrame:
    """What a list of results shows of a record."""
    domain = F.coalesce(F.nullif(F.col("application_domain"), F.lit("")), F.col("track"), F.lit(""))
    return records.select(
        "doc", "id", F.col("name"), "year", domain.alias("domain"), "summary", (strip(text_of(F.col("summary"))) == "").alias("needs_summary"),
        F.slice("chassis_organisms", 1, 4).alias("chassis"), F.slice("molecular_techniques", 1, 4).alias("techniques"), F.slice("target_molecules", 1, 3).alias("molecules"),
    )


def parts_catalogue(items: DataFrame, most_ids: int = 8) -> DataFrame:
    """(key, name, n, ids, code) from items (pos, id, name): names that differ in case and white space only are one.

    The name and code are the first's; ids are those of the first most_ids items, which may
    repeat. Only these are listed, so a name that most records have costs no more.
    """
    keyed = items.withColumn("key", F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))).filter("key <> ''")
    first = Window.partitionBy("key").orderBy("pos")
    listed = keyed.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most_ids)
    ids = listed.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("name", "pos").alias("name"))
    return counted.join(ids, "key").withColumn("code", part_code(F.col("name")))


def catalogue_order() -> list[Column]:
    return [F.desc("n"), F.asc("key")]


def overview(records: DataFrame, year: str, model: str, kinds: dict[str, Column]) -> DataFrame:
    """One row: the number of records, the years, the models by frequency and the exact number of different values of each kind."""
    by_model = records.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("n"))
    models = by_model.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "model"))).alias("m")).select(F.transform("m", lambda x: F.concat(x["model"], F.lit("="), (-x["n"]).cast("string"))).alias("models"))
    counted = records.agg(F.count("*").alias("records"), F.sort_array(F.collect_set(year)).alias("years"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), *[F.count_distinct(c).alias(f"distinct_{k}") for k, c in kinds.items()])
    return counted.join(F.broadcast(models), F.lit(True), "inner")  # one row each


def join_rate(records: DataFrame, match: str = "match") -> DataFrame:
    return records.agg(F.round(100 * F.avg(F.col(match).isNotNull().cast("int")), 2).alias("rate"))


def newest_first(posts: DataFrame, shown: int = 3) -> DataFrame:
    """Pinned posts first, otherwise as given; posts: (pos, pinned, ..)."""
    return posts.orderBy(F.desc(F.coalesce("pinned", F.lit(False))), "pos").limit(shown)


def last_messages(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", most: int = 24) -> DataFrame:
    """The last messages of every conversation, the oldest being dropped."""
    back = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))
    return messages.withColumn("back", back).filter(F.col("back") <= most)
