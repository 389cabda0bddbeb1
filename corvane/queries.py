"""One query for each family of operators, on the driver's tables, with the same results as DuckDB SQL where SQL has them.

Documents are the records: doc is doc_id, the summary the whole text, the name its source, and
facets are lang, source and a size class. Searches read indexes that are stored at their first use in a session.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canon, html, text
from .functions.fixed import COUNTRY_LABEL, DOMAIN_VILLAGE, GENERIC, JUNK, KEEP_UPPER, LEAD_WORDS, OLD_TRACK, REGION_LABEL, RULES, SECTION_LABEL, VILLAGES
from .operators import evaluate, facets, index, records, resolve, synonyms, vectors
from .operators.places import globally
from .plans import search
from .plans.query import Vocabulary, parse
from .sources.index_files import Kept, indexed, shared_folder
from .streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

GROUPS = {"mit license": ("mit license", "apache license"), "apache license": ("mit license", "apache license")}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return docs.select(F.col("doc_id").alias("doc"), "text", F.col("text").alias("summary"), "lang", "source", "n_chars", size.alias("size"))


def primary_of(docs: DataFrame, **keep) -> index.Index:
    fields = {"name": F.col("source"), "core": F.col("lang"), "support": F.concat_ws(" ", "lang", "source"), "body": F.col("summary")}
    return index.summary_index(docs, "doc", fields, **keep)


def primary(spark: SparkSession, sf_dir: str) -> index.Index:
    """The weighted index, stored."""
    return indexed(spark, f"{sf_dir}/documents.parquet", "primary", lambda keep: primary_of(documents(spark, sf_dir), keep=keep))


def full_text(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of all texts, stored."""
    return indexed(spark, f"{sf_dir}/documents.parquet", "full_text", lambda keep: index.full_text_index(documents(spark, sf_dir), "doc", "text", keep))


def document_facets(docs: DataFrame) -> DataFrame:
    return facets.facet_docs(docs, "doc", {"lang": F.col("lang"), "source": F.col("source"), "size": F.col("size")})


# SQL fragments


def sql_tokens(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    safe = rf"regexp_replace(regexp_replace({t}, '[^\x00-\x7F\p{{L}}\p{{N}}]', '|', 'g'), '[^\x00-\x7F]', '_', 'g')"
    return rf"""(regexp_extract_all({t}, '[a-z0-9]{{2,32}}')
        || list_transform(regexp_extract_all({safe}, '\b([a-z])\.\s*([a-z]{{3,}})\b'), lambda y: regexp_replace(y, '\.\s*', ''))
        || list_transform(regexp_extract_all({t}, '[a-z0-9]+(?:[-_][a-z0-9]+)+'), lambda y: translate(y, '-_', '')))"""


DOCS = """docs AS (SELECT doc_id AS doc, text, text AS summary, lang, source, n_chars,
        CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS size FROM documents)"""
WEIGHTED = f"""{DOCS},
    occurrences AS (
        SELECT doc, unnest({sql_tokens("source")}) AS term, 12 AS w FROM docs
        UNION ALL SELECT doc, unnest({sql_tokens("lang")}), 7 FROM docs
        UNION ALL SELECT doc, unnest({sql_tokens("concat_ws(' ', lang, source)")}), 3 FROM docs
        UNION ALL SELECT doc, unnest({sql_tokens("summary")}), 2 FROM docs),
    weights AS (SELECT term, doc, sum(w)::BIGINT AS w FROM occurrences GROUP BY ALL),
    lengths AS (SELECT doc, coalesce(sum(w), 0)::BIGINT AS dl FROM docs LEFT JOIN weights USING (doc) GROUP BY doc),
    stats AS (SELECT count(*) AS n, round(avg(dl), 2) AS avgdl FROM lengths),
    frequent AS (SELECT term, count(*) AS df FROM weights GROUP BY term HAVING count(*) >= 2 OR length(term) >= 4),
    postings AS (SELECT term, doc, least(w, 65535) AS w FROM weights SEMI JOIN frequent USING (term))"""
FULL = f"""full_counts AS (SELECT term, doc, count(*) AS w FROM (SELECT doc_id AS doc, unnest({sql_tokens("text")}) AS term FROM documents) GROUP BY ALL),
    full_lengths AS (SELECT doc_id AS doc, len({sql_tokens("text")}) AS dl FROM documents),
    full_postings AS MATERIALIZED (SELECT term, doc, least(w, 255) AS w FROM full_counts SEMI JOIN (SELECT term FROM full_counts GROUP BY term HAVING count(*) >= 2) USING (term))"""
FACETS = """facets AS (SELECT doc, kind, label, CASE WHEN k = '' THEN 'x' ELSE k END AS key FROM (
        SELECT doc, kind, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS k FROM (
            SELECT doc, 'lang' AS kind, lang AS label FROM docs UNION SELECT doc, 'source', source FROM docs UNION SELECT doc, 'size', size FROM docs)
        WHERE label <> ''))"""


def sql_search(queries: dict[int, list], name: str = "scores") -> str:
    """(qid, doc, score) of parsed queries over postings, lengths and stats."""
    rows = ", ".join(
        f"({qid}, {g}, {u}, {len(units)}, {s}, {len(set(sp.words))}, '{w}', {sp.words.count(w)}, {sp.weight}::DOUBLE)"
        for qid, groups in queries.items()
        for g, units in enumerate(groups)
        for u, unit in enumerate(units)
        for s, sp in enumerate(unit.spellings)
        for w in dict.fromkeys(sp.words)
    )
    return f"wanted(qid, grp, unit, units, spelling, words, term, times, weight) AS (VALUES {rows}), {sql_scores(name)}"


def sql_scores(name: str = "scores") -> str:
    return f"""dfs AS (SELECT term, count(*) AS df FROM postings SEMI JOIN wanted USING (term) GROUP BY term),
    spelled AS (
        SELECT qid, doc, grp, unit, spelling, units, weight * sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * w * 4.0 / (w + 3.0 * (0.45 + 0.55 * dl / avgdl))) AS score
        FROM wanted JOIN postings USING (term) JOIN dfs USING (term) JOIN lengths USING (doc), stats
        GROUP BY qid, doc, grp, unit, spelling, units, words, weight HAVING count(*) = words),
    by_unit AS (SELECT qid, doc, grp, unit, units, max(score) AS score FROM spelled GROUP BY ALL),
    by_group AS (SELECT qid, doc, grp, sum(score) AS score FROM by_unit GROUP BY qid, doc, grp, units HAVING count(*) = units),
    {name} AS (SELECT qid, doc, max(score) AS score FROM by_group GROUP BY qid, doc)"""


TOP20 = "SELECT doc, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS rank FROM scores ORDER BY rank LIMIT 20"


def top20(scores: DataFrame) -> DataFrame:
    return search.ranked(search.top(scores, 20)).select("doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Tokens and indexes


@register(f"SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize_tf(spark, sf_dir):
    return index.token_counts(documents(spark, sf_dir), "doc", "text").select("doc", "term", "tf")


@register("""SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(lower(html), '[a-z0-9]+(?:[-_][a-z0-9]+)+'), lambda y: translate(y, '-_', ''))) AS term FROM pages) GROUP BY term""")
def compound_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(text.compound_tokens(F.col("html"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@register(r"""SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(
        regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F\p{L}\p{N}]', '|', 'g'), '[^\x00-\x7F]', '_', 'g'), '\b([a-z])\.\s*([a-z]{3,})\b'), lambda y: regexp_replace(y, '\.\s*', ''))) AS term FROM documents) GROUP BY term""")
def abbrev_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(text.abbreviation_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@register(f"""SELECT (list_reduce(list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 33 + c) % 4294967296, 5381::BIGINT) % 256)::INTEGER AS shard, count(*) AS n
    FROM (SELECT DISTINCT unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY shard""")
def shard_histogram(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return terms.groupBy(text.shard_of(F.col("term")).alias("shard")).agg(F.count("*").alias("n"))


@register(f"WITH {WEIGHTED} SELECT term, doc, w FROM postings")
def field_weighted_tf(spark, sf_dir):
    return primary_of(documents(spark, sf_dir)).postings.select("term", "doc", "w")


@register(f"WITH {WEIGHTED} SELECT doc, dl, n, avgdl FROM lengths, stats")
def doc_lengths(spark, sf_dir):
    own = primary(spark, sf_dir)
    return own.lengths.join(F.broadcast(own.stats), F.lit(True)).select("doc", "dl", "n", "avgdl")


@register(f"WITH {WEIGHTED} SELECT term, count(*) AS df FROM postings GROUP BY term")
def vocab_pruned(spark, sf_dir):
    return primary(spark, sf_dir).vocabulary()


@register(f"WITH {FULL} SELECT term, count(*) AS df, max(w) AS most FROM full_postings GROUP BY term")
def full_text_vocabulary(spark, sf_dir):
    own = index.full_text_index(documents(spark, sf_dir), "doc", "text")
    return own.cut(own.blocks).groupBy("term").agg(F.sum("n").alias("df"), F.max(F.array_max("ws")).cast("long").alias("most"))


@register(f"""WITH {FULL}, vocabulary AS (SELECT term, count(*) AS df FROM full_postings GROUP BY term),
    tried AS (
        SELECT term, 0 AS rule, left(term, -3) || 'y' AS stem FROM vocabulary WHERE term LIKE '%ies' AND length(term) >= 6
        UNION ALL SELECT term, 1, left(term, -1) FROM vocabulary WHERE term LIKE '%s' AND length(term) >= 4
        UNION ALL SELECT term, 2, left(term, -2) FROM vocabulary WHERE regexp_matches(term, '(s|x|z|ch|sh)es$') AND length(term) >= 5),
    stems AS (SELECT t.term, arg_min(stem, rule) AS stem FROM tried t JOIN vocabulary v ON v.term = stem AND v.df >= 20 GROUP BY t.term)
    SELECT term, stem AS other FROM stems UNION SELECT stem, term FROM stems""")
def plural_folds(spark, sf_dir):
    return index.folds(full_text(spark, sf_dir).vocabulary())


# Searches

#: What a tail's first segment asks for: more than the tail, since both see whole texts.
NARROW = "that with from"
AND, OR, SYNONYM = "that with", "from that or inter-alia or with have", "mit license"
NO_GROUPS, OWN_GROUPS = Vocabulary(), Vocabulary(GROUPS, {"mit": ("mits",)})


@register(f"WITH {WEIGHTED}, {sql_search({0: parse(AND, NO_GROUPS)})} {TOP20}")
def bm25_and(spark, sf_dir):
    return top20(search.lexical(primary(spark, sf_dir), parse(AND, NO_GROUPS)))


@register(f"WITH {WEIGHTED}, {sql_search({0: parse(OR, NO_GROUPS)})} {TOP20}")
def bm25_or(spark, sf_dir):
    return top20(search.lexical(primary(spark, sf_dir), parse(OR, NO_GROUPS)))


@register(f"WITH {WEIGHTED}, {sql_search({0: parse(SYNONYM, OWN_GROUPS)})} {TOP20}")
def bm25_synonyms(spark, sf_dir):
    return top20(search.lexical(primary(spark, sf_dir), parse(SYNONYM, OWN_GROUPS)))


FILTERS = {"lang": ["en", "fr"], "size": ["medium"]}
ALLOW = "allow AS (SELECT doc FROM docs WHERE lang IN ('en', 'fr') AND size = 'medium')"


@register(f"WITH {WEIGHTED}, {sql_search({0: parse(AND, NO_GROUPS)}, 'all_scores')}, {ALLOW}, scores AS (SELECT * FROM all_scores SEMI JOIN allow USING (doc)) {TOP20}")
def bm25_filtered(spark, sf_dir):
    found = search.lexical(primary(spark, sf_dir), parse(AND, NO_GROUPS))
    return top20(facets.filtered(found, document_facets(documents(spark, sf_dir)), FILTERS))


@register(f"WITH {WEIGHTED}, {sql_search({0: parse('that', NO_GROUPS)})} SELECT doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS rank FROM scores) WHERE rank BETWEEN 21 AND 40")
def page_two(spark, sf_dir):
    found = search.page(search.lexical(primary(spark, sf_dir), parse("that", NO_GROUPS)), 2)
    return found.select("doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


BATCH = {i: q for i, q in enumerate(["that with", "the and of", "from or with that", "der die und", "que los", "les des", "have been", "source src1", "this are", "on in to", "mit license", "all rights reserved"])}


@register(f"WITH {WEIGHTED}, {sql_search({i: parse(q, OWN_GROUPS) for i, q in BATCH.items()})} SELECT qid, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM scores) WHERE rank <= 20")
def bm25_batch(spark, sf_dir):
    parsed = search.query_table(spark, {i: parse(q, OWN_GROUPS) for i, q in BATCH.items()})
    found = search.batch_ranked(search.batch(primary(spark, sf_dir), parsed), 20)
    return found.select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def sql_mentions(units: list) -> str:
    """(doc, hits, total, dl) of one group over full_postings."""
    rows = ", ".join(f"({u}, {s}, {len(set(sp.words))}, '{w}')" for u, unit in enumerate(units) for s, sp in enumerate(unit.spellings) for w in dict.fromkeys(sp.words))
    return f"""asked(unit, spelling, words, term) AS (VALUES {rows}),
    m_spelled AS (SELECT doc, unit, spelling, min(w) AS n FROM asked JOIN full_postings USING (term) GROUP BY doc, unit, spelling, words HAVING count(*) = words),
    m_unit AS (SELECT doc, unit, sum(n) AS n FROM m_spelled GROUP BY ALL),
    mentioned AS (SELECT doc, min(n)::BIGINT AS hits, sum(n)::BIGINT AS total, any_value(dl) AS dl FROM m_unit JOIN full_lengths USING (doc) GROUP BY doc HAVING count(*) = {len(units)})"""


@register(f"""WITH {WEIGHTED}, {FULL}, {sql_search({0: parse(NARROW, NO_GROUPS)})}, {sql_mentions(parse(AND, NO_GROUPS)[0])}
    SELECT doc, hits, total, dl, row_number() OVER (ORDER BY hits DESC, total DESC, dl, doc) AS rank FROM mentioned ANTI JOIN scores USING (doc)""")
def mention_tail(spark, sf_dir):
    first = search.lexical(primary(spark, sf_dir), parse(NARROW, NO_GROUPS))
    tail = search.mention_tail(full_text(spark, sf_dir), parse(AND, NO_GROUPS), first)
    return globally(tail, search.mention_order(), "rank").select("doc", "hits", "total", "dl", "rank")


TWO_GROUPS = "mit license or that und"


def sql_two_groups() -> str:
    groups = parse(TWO_GROUPS, OWN_GROUPS)
    parts = []
    for g, units in enumerate(groups):
        one = sql_mentions(units)
        for name in ("asked", "m_spelled", "m_unit", "mentioned"):
            one = re.sub(rf"\b{name}\b", f"{name}_{g}", one)
        parts.append(one)
    union = " UNION ALL ".join(f"SELECT * FROM mentioned_{g}" for g in range(len(groups)))
    return f"{', '.join(parts)}, both_ AS ({union}) SELECT doc, (max((hits, total)))[1] AS hits, (max((hits, total)))[2] AS total, any_value(dl) AS dl FROM both_ GROUP BY doc"


@register(f"WITH {FULL}, {sql_two_groups()}")
def mention_groups(spark, sf_dir):
    """Groups of alternatives, whose spellings count together."""
    return search.mention_tail(full_text(spark, sf_dir), parse(TWO_GROUPS, OWN_GROUPS)).select("doc", "hits", "total", "dl")


@register(f"""WITH {WEIGHTED}, {FULL}, {sql_search({0: parse(NARROW, NO_GROUPS)})}, {sql_mentions(parse(AND, NO_GROUPS)[0])}
    SELECT 0 AS segment_no, 'lexical' AS segment, doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS place FROM scores
    UNION ALL SELECT 1, 'full_text', doc, row_number() OVER (ORDER BY hits DESC, total DESC, dl, doc) FROM mentioned ANTI JOIN scores USING (doc)""")
def segmented_results(spark, sf_dir):
    first, tail = search.lexical(primary(spark, sf_dir), parse(NARROW, NO_GROUPS)), search.mention_tail(full_text(spark, sf_dir), parse(AND, NO_GROUPS))
    found = search.segmented(("lexical", first, search.score_order()), ("full_text", tail, search.mention_order()))
    return found.select("segment_no", "segment", "doc", F.col("place").cast("long").alias("place"))


@register(r"""WITH flat AS (SELECT doc_id AS doc, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
    placed AS (SELECT doc, t, list_min(list_filter([instr(lower(t), 'that'), instr(lower(t), 'und')], lambda p: p > 0)) AS pos FROM flat)
    SELECT doc, CASE WHEN pos IS NULL THEN CASE WHEN length(t) > 260 THEN substr(t, 1, 260) || ' …' ELSE t END
        ELSE (CASE WHEN pos - 1 - 90 > 0 THEN '… ' ELSE '' END) || trim(substr(t, greatest(pos - 91, 0) + 1, least(pos - 1 + 190, length(t)) - greatest(pos - 91, 0)))
            || (CASE WHEN pos - 1 + 190 < length(t) THEN ' …' ELSE '' END) END AS snippet FROM placed""")
def snippet(spark, sf_dir):
    return documents(spark, sf_dir).select("doc", text.snippet(F.col("text"), ["that", "und"]).alias("snippet"))


# Facets


@register(f"WITH {DOCS}, {FACETS} SELECT kind, label, key, count(*) AS n FROM facets GROUP BY ALL")
def facet_values(spark, sf_dir):
    return facets.values(document_facets(documents(spark, sf_dir)))


@register(f"WITH {WEIGHTED}, {FACETS}, {sql_search({0: parse(AND, NO_GROUPS)})} SELECT kind, key, label, count(*) AS n FROM facets SEMI JOIN scores USING (doc) GROUP BY ALL")
def facet_counts(spark, sf_dir):
    found = search.lexical(primary(spark, sf_dir), parse(AND, NO_GROUPS))
    return facets.counts(found, document_facets(documents(spark, sf_dir)))


@register(f"""WITH {WEIGHTED}, {FACETS}, {sql_search({0: parse('that', NO_GROUPS)})}
    SELECT kind, key, label, count(*) AS n FROM facets JOIN scores USING (doc) JOIN docs USING (doc)
    WHERE CASE kind WHEN 'lang' THEN size = 'medium' WHEN 'size' THEN lang IN ('en', 'fr') ELSE size = 'medium' AND lang IN ('en', 'fr') END GROUP BY kind, key, label""")
def facet_counts_disjunctive(spark, sf_dir):
    found = search.lexical(primary(spark, sf_dir), parse("that", NO_GROUPS))
    return facets.disjunctive_counts(found, document_facets(documents(spark, sf_dir)), FILTERS)


@register(f"""WITH {DOCS}, {FACETS}, counted AS (SELECT kind, label, key, count(*) AS n FROM facets GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, label) AS rank FROM counted)
    SELECT kind, label, n, rank FROM placed WHERE rank <= 14 OR kind = 'source' AND rank <= (SELECT rank FROM placed WHERE kind = 'source' AND key = 'src7')""")
def facet_panel(spark, sf_dir):
    shown = facets.shown(facets.values(document_facets(documents(spark, sf_dir))), {"source": ["src7"]})
    return shown.select("kind", "label", "n", F.col("rank").cast("long").alias("rank"))


@register("SELECT c_custkey AS doc, c_name AS name, c_nationkey AS year FROM customer ORDER BY year DESC, name COLLATE en, doc LIMIT 50")
def browse_order(spark, sf_dir):
    cards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("year"))
    return search.browse(cards).limit(50)


# Records

PAGE_RECORDS = """recs AS (SELECT page_id, lpad(page_id::VARCHAR, 9, '0') AS id, regexp_extract(url, '://([^./]*)', 1) AS name, regexp_extract(url, '^([^?#]*?)[/]?[0-9]*[^0-9/]*$', 1) AS url,
        ['exact', 'relaxed', 'fuzzy', 'prefix', NULL][(page_id % 5 + 1)::INTEGER] AS match FROM pages)"""


@register(rf"""WITH {PAGE_RECORDS}, marked AS (
        SELECT *, CASE WHEN coalesce(url, '') <> '' THEN url ELSE id END AS grp,
            CASE match WHEN 'exact' THEN 0 WHEN 'relaxed' THEN 1 WHEN 'fuzzy' THEN 2 WHEN 'prefix' THEN 3 ELSE 4 END AS r,
            regexp_replace(lower(name), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '^[^:]*:', '')), '[^a-z0-9]', '', 'g') AS d
        FROM recs WHERE NOT regexp_matches(name, '^example([\W_]|$)', 'i')),
    best AS (SELECT grp, arg_min(id, (r, d, length(name), id)) AS winner FROM marked GROUP BY grp)
    SELECT DISTINCT id, winner FROM marked JOIN best USING (grp)""")
def dedupe_records(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    match = F.element_at(F.array(F.lit("exact"), F.lit("relaxed"), F.lit("fuzzy"), F.lit("prefix"), F.lit(None)), (F.col("page_id") % 5 + 1).cast("int"))
    rows = pages.select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("id"), F.regexp_extract("url", "://([^./]*)", 1).alias("name"), F.regexp_extract("url", "^([^?#]*?)[/]?[0-9]*[^0-9/]*$", 1).alias("url"), match.alias("match"))
    return resolve.duplicate_groups(rows)


WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+\\z', '', 'g')"


@register(rf"""WITH texts AS (SELECT doc_id // 4 AS grp, doc_id % 4 AS part, concat(CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) ELSE chr(9) END, text, chr(13), chr(10), ' ', chr(10)) AS text FROM documents),
    lines AS (SELECT grp, part, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM texts),
    bare AS (SELECT *, {sql_strip("line")} AS bare FROM lines),
    seen AS (SELECT *, row_number() OVER (PARTITION BY grp, bare ORDER BY part, no) AS nth FROM bare),
    others AS (SELECT grp, part, trim(string_agg(line, chr(10) ORDER BY no), chr(10)) AS body FROM seen WHERE part > 0 AND (bare = '' OR nth = 1) GROUP BY grp, part),
    parts AS (SELECT grp, part, text AS body FROM texts WHERE part = 0 UNION ALL SELECT * FROM others),
    sizes AS (SELECT grp, count(*) = 1 AND min(part) = 0 AS alone FROM texts GROUP BY grp)
    SELECT grp, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY part) FILTER (alone OR {sql_strip("body")} <> ''), '') AS text FROM parts JOIN sizes USING (grp) GROUP BY grp""")
def merge_lines(spark, sf_dir):
    outer = F.when(F.col("doc") % 3 == 0, "\n\n").otherwise("\t")
    texts = documents(spark, sf_dir).select(F.floor(F.col("doc") / 4).alias("grp"), (F.col("doc") % 4).alias("part"), F.concat(outer, F.coalesce("text", F.lit("")), F.lit("\r\n \n")).alias("text"))
    return resolve.merge_lines(texts)


@register("""WITH items AS (SELECT p_partkey AS pos, p_brand AS id, p_type AS name, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS key FROM part),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS nth FROM items)
    SELECT key, arg_min(name, pos) AS name, count(*) AS n, string_agg(id, ',' ORDER BY pos) FILTER (nth <= 8) AS ids FROM numbered GROUP BY key""".replace("\\\\s", "\\s"))
def parts_catalogue(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("id"), F.col("p_type").alias("name"))
    return records.parts_catalogue(items).select("key", "name", "n", F.array_join("ids", ",").alias("ids"))


@register("""SELECT count(*) AS records, array_to_string(list_sort(list(DISTINCT n_chars % 7)), ',') AS years, min(n_chars % 7) AS first_year, max(n_chars % 7) AS last_year,
        (SELECT string_agg(source || '=' || n, ',' ORDER BY n DESC, source) FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)) AS models,
        count(DISTINCT lang) AS distinct_lang, count(DISTINCT text) AS distinct_text FROM documents""")
def meta_counts(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("year", F.col("n_chars") % 7)
    found = records.overview(docs, "year", "source", {"lang": F.col("lang"), "text": F.col("text")})
    return found.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ",")).withColumn("models", F.array_join("models", ","))


@register("""WITH a AS (SELECT doc_id::VARCHAR AS name, substr(sha256(text), 1, 16) AS sha FROM documents WHERE n_chars > 300),
    b AS (SELECT doc_id::VARCHAR AS name, substr(sha256(replace(text, 'Of.', 'If.')), 1, 16) AS sha FROM documents WHERE n_chars < 9000)
    SELECT coalesce(a.name, b.name) AS name FROM a FULL JOIN b ON a.name = b.name WHERE a.sha IS DISTINCT FROM b.sha""")
def manifest_diff(spark, sf_dir):
    from .sources.files import changed

    docs = documents(spark, sf_dir)
    sha = lambda c: F.substring(F.sha2(c, 256), 1, 16).alias("sha")
    name = F.col("doc").cast("string").alias("name")
    return changed(docs.filter("n_chars > 300").select(name, sha(F.col("text"))), docs.filter("n_chars < 9000").select(name, sha(F.replace("text", F.lit("Of."), F.lit("If.")))))


NAMES = [
    "E. coli BL21 (DE3)", "Saccharomyces cerevisiae", "β-galactosidase", "mCherry", "T7 promoter", "not specified", "PCR", "RT-qPCR", "Gibson Assembly", "Cas9 / gRNA", "human HEK 293 cells",
    "cadmium", "PET plastic", "synthetic biology", "BBa_J23100", "linker", "dna origami", "Unknown", "water", "3D-printed chip", "pSB1C3 backbone", "α-pinene", "Kinase;phosphatase", "none explicitly mentioned",
]
KINDS = list(RULES)


def names_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = spark.createDataFrame([(n,) for n in NAMES], "raw string")
    parts = table(spark, sf_dir, "part")
    return literal.unionByName(parts.select(F.col("p_type").alias("raw"))).unionByName(parts.select(F.col("p_name").alias("raw"))).distinct()


def sql_quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RAW = f"""raw AS (SELECT unnest([{", ".join(map(sql_quote, NAMES))}]) AS raw UNION SELECT p_type FROM part UNION SELECT p_name FROM part),
    folded AS (SELECT raw, replace(replace(replace(replace(replace(replace(replace(lower(trim(raw)), 'α', 'alpha'), 'β', 'beta'), 'γ', 'gamma'), 'δ', 'delta'), 'μ', 'u'), 'µ', 'u'), '’', '''') AS s FROM raw),
    normal AS (SELECT raw, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '\\([^)]*\\)', ' ', 'g'), '[_/,;:]+', ' ', 'g'), '[^a-z0-9+. -]', ' ', 'g'), ' +', ' ', 'g'), ' .-') AS n FROM folded)"""


@register(f"WITH {RAW} SELECT raw, n AS normal FROM normal")
def canon_norm(spark, sf_dir):
    return names_frame(spark, sf_dir).select("raw", text.normal_name(F.col("raw")).alias("normal"))


def sql_canonical(kind: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(n, {sql_quote(p)}) THEN {sql_quote(label)}" for label, p in RULES[kind])
    generic = ", ".join(map(sql_quote, sorted(GENERIC.get(kind, {""}))))
    upper = ", ".join(map(sql_quote, sorted(KEEP_UPPER)))
    title = f"array_to_string(list_transform(string_split(n, ' '), lambda w: CASE WHEN w IN ({upper}) THEN upper(w) ELSE w END), ' ')"
    return f"CASE WHEN n <> '' AND length(n) <= 90 AND NOT regexp_matches(n, {sql_quote(JUNK)}) AND n NOT IN ({generic}) THEN CASE {rules} ELSE upper(substr({title}, 1, 1)) || substr({title}, 2) END END"


@register(f"WITH {RAW} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, raw, {sql_canonical(k)} AS label FROM normal" for k in KINDS))
def canon_rules(spark, sf_dir):
    rows = names_frame(spark, sf_dir)
    labels = F.array(*[F.struct(F.lit(k).alias("kind"), canon.canonical(k, F.col("raw")).alias("label")) for k in KINDS])
    return rows.select("raw", F.explode(labels).alias("at")).select("at.kind", "raw", "at.label")


@register(r"""WITH found AS (SELECT page_id, regexp_extract_all(concat(html, ' see ', url, ', and (', url, ')."'), '\bhttps?://[^\s<>"''`]+') AS urls FROM pages)
    SELECT page_id, url FROM (SELECT page_id, unnest(list_transform(urls, lambda x: regexp_replace(x, '[.,;:!?)\]}"'']+$', ''))) AS url FROM found) WHERE length(url) > 10""")
def url_spans(spark, sf_dir):
    quoted = F.concat(F.col("html"), F.lit(" see "), F.col("url"), F.lit(", and ("), F.col("url"), F.lit(').\"'))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.url_spans(quoted)).alias("url"))


@register("SELECT doc_id AS doc, least(len(string_split(lower(text), 'the')) - 1, 2000) AS n FROM documents")
def find_in_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc", text.find_count(F.col("text"), "The").cast("long").alias("n"))


@register(r"""SELECT doc_id AS doc, concat_ws(chr(10) || chr(10), 'Language: ' || lang, 'Source: ' || source, substr(text, 1, 120000)) AS context FROM documents""")
def grounding(spark, sf_dir):
    sections = [("Language", F.col("lang")), ("Nothing", F.nullif(F.lit(" "), F.lit(" "))), ("Source", F.col("source"))]
    return documents(spark, sf_dir).select("doc", text.grounding(sections, F.col("text")).alias("context"))


@register("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 24")
def history_cap(spark, sf_dir):
    found = records.last_messages(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "text", F.col("back").cast("long").alias("back"))


@register(r"""SELECT p_partkey, 'Part ' || p_name || ' has size ' || p_size || ' and {{unknown}}' AS text FROM part""")
def template_fill(spark, sf_dir):
    filled = text.fill_template(F.lit("Part {{name}} has size {{size}} and {{unknown}}"), {"name": F.col("p_name"), "size": F.col("p_size")})
    return table(spark, sf_dir, "part").select("p_partkey", filled.alias("text"))


NAMED = """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN n_name WHEN 1 THEN concat('The University of ', n_name) WHEN 2 THEN concat(lower(n_name), '2020') WHEN 3 THEN substr(n_name, 1, 5)
        WHEN 4 THEN concat(substr(n_name, 1, 3), 'x', substr(n_name, 4)) WHEN 5 THEN 'template' WHEN 6 THEN concat(n_name, 'lands of old') ELSE n_name END AS name,
        CASE c_custkey % 16 WHEN 7 THEN 2019 WHEN 15 THEN NULL ELSE 2020 END AS year FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def entity_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers under spellings of their nation's name, and the nations as a directory."""
    named = spark.sql(NAMED.replace("FROM customer JOIN nation", "FROM {customer} AS customer JOIN {nation} AS nation"), customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    directory = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row"), F.col("n_name").alias("name"), F.lit(2020).alias("year"))
    return named, directory


def sql_entities() -> str:
    keys = lambda c: f"list_distinct(list_filter([{c}, nullif(regexp_replace({c}, '(19|20)[0-9]{{2}}$', ''), ''), nullif(regexp_replace(regexp_replace({c}, '(19|20)[0-9]{{2}}$', ''), '{'|'.join(resolve.NOISE_WORDS)}', '', 'g'), '')], lambda x: x IS NOT NULL))"
    return f"""WITH ent AS ({NAMED}), nations AS (SELECT n_nationkey, n_name FROM nation),
    base AS (SELECT id, name, year, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS s FROM ent),
    dir AS (SELECT key, min(row) AS row FROM (SELECT n_nationkey AS row, unnest({keys("regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')")}) AS key FROM nations) GROUP BY key),
    own AS (SELECT id, s, unnest({keys("s")}) AS key FROM base WHERE year = 2020 AND s NOT IN ('template') AND NOT regexp_matches(name, '[\\[\\]{{}}<>]')),
    eq AS (SELECT id, arg_min(row, own.key <> s) AS row, CASE WHEN bool_or(own.key = s) THEN 'exact' ELSE 'relaxed' END AS match FROM own JOIN dir USING (key) GROUP BY id),
    pre AS (SELECT id, min(row) AS row, 'prefix' AS match FROM (SELECT DISTINCT id, s FROM own ANTI JOIN eq USING (id)) JOIN dir ON length(key) >= 5 AND (starts_with(key, s) OR starts_with(s, key)) GROUP BY id HAVING count(DISTINCT row) = 1),
    outside AS (SELECT id, NULL AS row, CASE WHEN s = 'template' OR regexp_matches(name, '[\\[\\]{{}}<>]') THEN 'not-a-team' WHEN year IS NULL THEN 'no-year' ELSE 'no-such-year' END AS match FROM base
        WHERE s = 'template' OR regexp_matches(name, '[\\[\\]{{}}<>]') OR year IS NULL OR year <> 2020)
    SELECT id::BIGINT AS id, row::BIGINT AS row, match FROM (SELECT * FROM eq UNION ALL SELECT * FROM pre UNION ALL SELECT * FROM outside)"""


@register(sql_entities())
def entity_join(spark, sf_dir):
    return resolve.resolve(*entity_frames(spark, sf_dir)).filter("match not in ('fuzzy', 'unmatched')")


@register()
def entity_fuzzy(spark, sf_dir):
    return resolve.resolve(*entity_frames(spark, sf_dir)).filter("match in ('fuzzy', 'unmatched')")


@register()
def html_sanitised(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.sanitised(F.col("html")).alias("html"))


# Vectors


def vector_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))


def vector_queries(docs: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 20."""
    return docs.filter("doc % 20 = 0").select(F.col("doc").alias("qid"), "vec")


SQL_CONCEPT = "concept AS (SELECT q.vec_id AS qid, e.vec_id AS doc, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cos FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"


@register(f"WITH {SQL_CONCEPT} SELECT qid, doc, round(cos, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 9) DESC, doc) AS rank FROM concept WHERE cos > 0.12 QUALIFY rank <= 20")
def vector_topk(spark, sf_dir):
    docs = vector_docs(spark, sf_dir)
    found = vectors.top_similar(docs, vector_queries(docs), k=20)
    return found.select("qid", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(f"""WITH {WEIGHTED}, {sql_search({0: parse(AND, NO_GROUPS)})}, {SQL_CONCEPT}
    SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 9) DESC, doc) AS rank FROM concept ANTI JOIN scores USING (doc) WHERE cos > 0.12 QUALIFY rank <= 400""")
def hybrid_tail(spark, sf_dir):
    """For every query vector the tail of documents that a search's words don't find."""
    vecs = vector_docs(spark, sf_dir)
    first = search.lexical(primary(spark, sf_dir), parse(AND, NO_GROUPS))
    return vectors.top_similar(vecs, vector_queries(vecs), exclude=first).select("qid", "doc", F.col("rank").cast("long").alias("rank"))


@register(f"""WITH {WEIGHTED}, {FULL}, {sql_search({0: parse(NARROW, NO_GROUPS)})}, {sql_mentions(parse(AND, NO_GROUPS)[0])}, {SQL_CONCEPT},
    alike AS (SELECT doc, cos FROM concept ANTI JOIN scores USING (doc) WHERE qid = 0 AND cos > 0.12 ORDER BY round(cos, 9) DESC, doc LIMIT 400)
    SELECT 0 AS segment_no, 'lexical' AS segment, doc, row_number() OVER (ORDER BY round(score, 9) DESC, doc) AS place FROM scores
    UNION ALL SELECT 1, 'concept', doc, row_number() OVER (ORDER BY round(cos, 9) DESC, doc) FROM alike
    UNION ALL SELECT 2, 'full_text', doc, row_number() OVER (ORDER BY hits DESC, total DESC, dl, doc) FROM mentioned ANTI JOIN scores USING (doc) ANTI JOIN alike USING (doc)""")
def hybrid_segments(spark, sf_dir):
    """One search in hybrid mode: what matches, what is like the query's vector, what mentions the words."""
    vecs = vector_docs(spark, sf_dir)
    first = search.lexical(primary(spark, sf_dir), parse(NARROW, NO_GROUPS))
    query = [float(x) for x in vecs.filter("doc = 0").first()["vec"]]
    found = search.hybrid(first, vectors.concept_tail(vecs, query, exclude=first), search.mention_tail(full_text(spark, sf_dir), parse(AND, NO_GROUPS)))
    return found.select("segment_no", "segment", "doc", F.col("place").cast("long").alias("place"))


@register(f"""WITH {WEIGHTED}, {FULL}, {FACETS}, {sql_search({0: parse(NARROW, NO_GROUPS)})}, {sql_mentions(parse(AND, NO_GROUPS)[0])},
    everything AS (SELECT doc FROM scores UNION SELECT doc FROM mentioned)
    SELECT kind, key, label, count(*) AS n FROM facets JOIN everything USING (doc) JOIN docs USING (doc)
    WHERE CASE kind WHEN 'lang' THEN size = 'medium' WHEN 'size' THEN lang IN ('en', 'fr') ELSE size = 'medium' AND lang IN ('en', 'fr') END GROUP BY kind, key, label""")
def facet_counts_all_segments(spark, sf_dir):
    """Disjunctive counts over what a search finds in all segments, not in its first alone."""
    first, tail = search.lexical(primary(spark, sf_dir), parse(NARROW, NO_GROUPS)), search.mention_tail(full_text(spark, sf_dir), parse(AND, NO_GROUPS))
    found = search.segmented(("lexical", first, search.score_order()), ("full_text", tail, search.mention_order()))
    return facets.disjunctive_counts(found.select("doc"), document_facets(documents(spark, sf_dir)), FILTERS)


@register(f"""WITH {WEIGHTED}, {FULL}, {FACETS}, {sql_search({0: parse(NARROW, NO_GROUPS)})}, {sql_mentions(parse(AND, NO_GROUPS)[0])}, {SQL_CONCEPT},
    flags AS (SELECT doc, unnest(list_filter([CASE WHEN size = 'medium' AND lang IN ('en', 'fr') THEN '' END, CASE WHEN size = 'medium' THEN 'lang' END, CASE WHEN lang IN ('en', 'fr') THEN 'size' END], lambda x: x IS NOT NULL)) AS pool FROM docs),
    alike AS (SELECT doc, pool FROM concept ANTI JOIN scores USING (doc) JOIN flags USING (doc) WHERE qid = 0 AND cos > 0.12 QUALIFY row_number() OVER (PARTITION BY pool ORDER BY round(cos, 9) DESC, doc) <= 400),
    members AS (SELECT * FROM alike UNION SELECT doc, pool FROM (SELECT doc FROM scores UNION SELECT doc FROM mentioned) JOIN flags USING (doc))
    SELECT kind, key, label, count(*) AS n FROM facets JOIN members USING (doc) WHERE pool = CASE WHEN kind IN ('lang', 'size') THEN kind ELSE '' END GROUP BY kind, key, label""")
def facet_counts_hybrid(spark, sf_dir):
    """Disjunctive counts in hybrid mode, where every active kind has a tail of its own."""
    vecs, own = vector_docs(spark, sf_dir), document_facets(documents(spark, sf_dir))
    first, tail = search.lexical(primary(spark, sf_dir), parse(NARROW, NO_GROUPS)), search.mention_tail(full_text(spark, sf_dir), parse(AND, NO_GROUPS))
    query = [float(x) for x in vecs.filter("doc = 0").first()["vec"]]
    return facets.pooled_counts(search.hybrid_pools(first, vectors.concept_scores(vecs, query), tail, own, FILTERS), own, FILTERS)


@register("""WITH s AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x)))) AS m FROM embeddings)
    SELECT vec_id AS doc, array_to_string(list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::DOUBLE * 127 / m::DOUBLE, 0)))::TINYINT), ',') AS vec FROM embeddings, s""")
def vectors_quantised(spark, sf_dir):
    found = vectors.quantise(vector_docs(spark, sf_dir).withColumn("vec", F.col("vec").cast("array<double>")))
    return found.select("doc", F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("vec"))


@register()
def concept_model(spark, sf_dir):
    terms, docs = vectors.train(documents(spark, sf_dir), "doc", "text")
    return docs.select("doc", F.size("vec").alias("dimensions"), F.round(vectors.norm(F.col("vec")), 6).alias("length"))


# Evaluation

MINE_SQL = f"""{DOCS}, spread AS (SELECT DISTINCT doc, unnest(regexp_extract_all(lower(summary), '[a-z0-9]{{2,32}}')) AS term FROM docs),
    m_df AS (SELECT term, count(*) AS df FROM spread GROUP BY term),
    m_nth AS (SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY df, term DESC) AS nth FROM spread JOIN m_df USING (term)),
    mined AS (SELECT doc, string_agg(term, ' ' ORDER BY nth) AS query FROM m_nth WHERE nth <= 8 GROUP BY doc HAVING count(*) >= 3)"""


@register(f"WITH {MINE_SQL} SELECT doc, query FROM mined")
def known_item_mine(spark, sf_dir):
    said = evaluate.known_item_text(F.col("summary"), F.col("source"))
    return evaluate.rarest_words(documents(spark, sf_dir), "doc", said)


@register("""WITH placed AS (SELECT doc_id AS doc, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT doc FROM placed SEMI JOIN (SELECT i * (SELECT count(*) FROM documents) // 100 AS pos FROM range(100) t(i)) USING (pos)""")
def systematic_sample(spark, sf_dir):
    return resolve.sampled(documents(spark, sf_dir).select("doc"), [F.col("doc")], 100)


def mined_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A search for each document's own query, equal ones once, and the document that each wants."""
    own = primary(spark, sf_dir)
    mined = Kept(spark, shared_folder(spark))(evaluate.rarest_words(documents(spark, sf_dir), "doc", F.col("summary")))
    asked = mined.groupBy("query").agg(F.min("doc").alias("qid"))
    found = search.batch_ranked(search.every_word(own, asked.select("qid", F.split("query", " ").alias("words")), 10), 10)
    each = mined.join(asked, "query").select(F.col("doc").alias("of"), "qid")
    ranked = found.join(each, "qid").select(F.col("of").alias("qid"), "doc", "score", "rank")
    return ranked, mined.select(F.col("doc").alias("qid"), "doc")


RUN_SQL = f"""WITH {WEIGHTED}, {MINE_SQL.removeprefix(DOCS + ", ")},
    parts AS (SELECT doc AS qid, string_split(query, ' ') AS ws FROM mined),
    wanted AS (SELECT qid, 0 AS grp, generate_subscripts(ws, 1) AS unit, len(ws) AS units, 0 AS spelling, 1 AS words, unnest(ws) AS term, 1 AS times, 1.0::DOUBLE AS weight FROM parts),
    {sql_scores()},
    ranked AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM scores QUALIFY rank <= 10)"""


@register(f"""{RUN_SQL}, firsts AS (SELECT parts.qid, min(rank) AS first FROM parts LEFT JOIN ranked r ON r.qid = parts.qid AND r.doc = parts.qid GROUP BY parts.qid)
    SELECT count(*) AS n, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first IS NOT NULL THEN 1 / log2(first + 1) ELSE 0 END), 6) AS ndcg,
        round(avg(CASE WHEN first = 1 THEN 1 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN first IS NULL THEN 1 ELSE 0 END), 6) AS no_hit FROM firsts""")
def mrr_ndcg(spark, sf_dir):
    ranked, relevant = mined_run(spark, sf_dir)
    found = evaluate.summary(evaluate.per_query(ranked, relevant))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "hit1", "no_hit")])


@register("""WITH placed AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (pos = floor(0.95 * (n - 1))) AS p95, max(value) FILTER (pos = n // 2) AS median FROM placed GROUP BY event_type""")
def percentile_index(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p95": 0.95}).select("event_type", "p95", "median")


@register(r"""SELECT w AS word, CASE WHEN length(w) < 4 THEN w WHEN w LIKE '%ies' THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(s|x|ch|sh)es$') THEN left(w, -2) WHEN w LIKE '%s' THEN left(w, -1)
        WHEN regexp_matches(w, '[^aeiou]y$') THEN left(w, -1) || 'ies' WHEN regexp_matches(w, '(x|ch|sh)$') THEN w || 'es' ELSE w || 's' END AS flipped
    FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,32}')) AS w FROM benchmark)""")
def flipped_numbers(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,32}"), F.lit(0))).alias("word")).distinct()
    return words.select("word", evaluate.flipped_number(F.col("word")).alias("flipped"))


@register("""WITH o AS (SELECT o_custkey AS team, year(o_orderdate) AS y, min(o_orderkey) AS doc FROM orders GROUP BY ALL), t AS (SELECT team, count(*) - 1 AS n_rel FROM o GROUP BY team HAVING count(*) >= 2)
    SELECT team, doc, n_rel FROM o JOIN t USING (team)""")
def team_lineages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("team"), F.year("o_orderdate").alias("year")).agg(F.min("o_orderkey").alias("doc"))
    return evaluate.lineages(orders.withColumn("id", F.col("doc"))).select("team", "doc", "n_rel")


SQL_PICK = lambda name, least, most, size: f"""{name}_all AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS pos, count(*) OVER () AS n FROM (SELECT term, count(*) AS df FROM full_postings WHERE regexp_matches(term, '^[a-z]{{5,}}$') GROUP BY term HAVING count(*) BETWEEN {least} AND {most})),
    {name} AS (SELECT a.term, a.df, i AS place FROM {name}_all a, range({size}) t(i) WHERE i < least({size}, n) AND pos = i * n // least({size}, n))"""  # noqa: E731


@register(f"WITH {FULL}, {SQL_PICK('one', 5, 40, 150)} SELECT term, df, place FROM one")
def term_queries(spark, sf_dir):
    return evaluate.chosen(evaluate.term_queries(full_text(spark, sf_dir).vocabulary()), 150).select("term", "df", "place")


@register(f"""WITH {FULL}, {SQL_PICK('mid', 8, 150, 400)}, size AS (SELECT count(*) AS c FROM mid),
    asked AS (SELECT a.term AS a, a.place AS i, j, b.term AS b FROM mid a, range(1, 60) t(j), size, mid b WHERE a.place % 2 = 0 AND b.place = (a.place + j * 7) % c AND a.term <> b.term),
    own AS MATERIALIZED (SELECT term, doc FROM full_postings SEMI JOIN mid USING (term)),
    shared AS (SELECT a, b, i, j, count(*) AS n FROM asked JOIN own pa ON pa.term = a JOIN own pb ON pb.term = b AND pb.doc = pa.doc GROUP BY ALL HAVING count(*) BETWEEN 3 AND 40),
    best AS (SELECT a, i, arg_min(b, j) AS b, arg_min(n, j) AS n FROM shared GROUP BY a, i)
    SELECT a, b, n FROM best ORDER BY i LIMIT 50""")
def pair_queries(spark, sf_dir):
    own = full_text(spark, sf_dir)
    terms = evaluate.chosen(evaluate.term_queries(own.vocabulary(), least=8, most=150), 400)
    return evaluate.pair_queries(own.of(terms).postings, terms)


@register(f"""WITH w AS (SELECT string_split(p_name, ' ') AS w FROM part), tails AS (SELECT w[-2:] AS tail FROM w WHERE len(w) >= 2),
    pairs AS (SELECT array_to_string(list_transform(tail, lambda x: x[1]), '') AS short, array_to_string(tail, ' ') AS long FROM tails WHERE tail[1] NOT IN ({", ".join(map(sql_quote, sorted(LEAD_WORDS)))})),
    counted AS (SELECT short, long, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 2)
    SELECT short, long, n FROM counted QUALIFY row_number() OVER (PARTITION BY short ORDER BY n DESC, long) = 1""")
def abbreviations_mined(spark, sf_dir):
    """Names of parts, each explained by the initials of its last two words."""
    words = F.split("p_name", " ")
    initials = F.array_join(F.transform(F.slice(words, -2, 2), lambda w: F.substring(w, 1, 1)), "")
    explained = table(spark, sf_dir, "part").filter(F.size(words) >= 2).select(F.concat("p_name", F.lit(" ("), initials, F.lit(") and more")).alias("text"))
    return synonyms.mine(explained, "text").select("short", "long", "n")


@register("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def event_stream_text(spark, sf_dir):
    """Conversations as bodies of event streams, a turn an event in one of the known forms."""
    turns = table(spark, sf_dir, "conversations")
    forms = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"choices":[{"delta":'), F.to_json(F.struct(F.col("text").alias("content"))), F.lit("}]}")))
    forms = forms.when(F.col("turn") % 3 == 1, F.concat(F.lit('{"delta":'), F.to_json(F.struct("text")), F.lit("}"))).otherwise(F.concat(F.lit('{"candidates":[{"content":{"parts":['), F.to_json(F.struct("text")), F.lit("]}}]}")))
    lines = turns.select("conv_id", "turn", F.concat(F.lit("event: x\r\ndata: "), forms).alias("line"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    bodies = lines.groupBy("conv_id").agg(F.concat(F.lit(": comment\n\ndata: {bad\n\n"), F.array_join(ordered, "\n\n"), F.lit("\n\ndata: [DONE]\n\n")).alias("body"))
    return bodies.select("conv_id", events.event_text(F.col("body")).alias("text"))


# Operators on the driver's other tables


def customer_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.concat(F.lit("Way "), "c_nationkey", F.lit(" "), "c_mktsegment")
    return facets.facet_docs(table(spark, sf_dir, "customer"), "c_custkey", {"technique": way, "segment": F.col("c_mktsegment")})


CURATED = ", ".join(sql_quote(label) for label, _ in RULES["technique"])
CUSTOMER_VALUES = f"""raw_values AS (SELECT kind, label, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS key, doc FROM (SELECT 'technique' AS kind, concat('Way ', c_nationkey, ' ', c_mktsegment) AS label, c_custkey AS doc FROM customer UNION SELECT 'segment', c_mktsegment, c_custkey FROM customer) WHERE label <> ''),
    kept_values AS (SELECT kind, label, key, count(*) AS n FROM raw_values GROUP BY ALL HAVING kind <> 'technique' OR count(*) >= 10 OR label IN ({CURATED}))"""


@register(f"WITH {CUSTOMER_VALUES} SELECT * FROM kept_values")
def facet_values_tail(spark, sf_dir):
    """A long-tailed kind, of which rare values that no rule names are left out."""
    return facets.values(customer_facets(spark, sf_dir))


@register(f"WITH {CUSTOMER_VALUES} SELECT kind, label, doc // 64 AS chunk, any_value(n) AS n, string_agg(doc::VARCHAR, ',' ORDER BY doc) AS docs FROM raw_values JOIN kept_values USING (kind, label) GROUP BY kind, label, doc // 64")
def facet_documents(spark, sf_dir):
    found = facets.value_documents(customer_facets(spark, sf_dir), chunk=64)
    return found.select("kind", "label", "chunk", "n", F.array_join(F.transform("docs", lambda d: d.cast("string")), ",").alias("docs"))


@register(f"WITH {CUSTOMER_VALUES} SELECT kind, label, n FROM kept_values WHERE kind = 'technique' AND n BETWEEN 3 AND 25 AND length(key) >= 3")
def cohesive_values(spark, sf_dir):
    return evaluate.cohesive_values(facets.values(customer_facets(spark, sf_dir)), "technique").select("kind", "label", "n")


@register(rf"""SELECT doc, array_to_string(ws[:60], ' ') AS opening FROM (SELECT doc_id AS doc, string_split_regex({sql_strip("coalesce(text, '')")}, '[ \t\n\x0b\f\r]+') AS ws FROM documents) WHERE len(ws) >= 12""")
def opening_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc", evaluate.opening_words(F.col("text")).alias("opening")).filter("opening is not null")


@register(rf"""SELECT doc, len(s) AS n, s[1] AS first FROM (SELECT doc_id AS doc, list_filter(string_split(regexp_replace({sql_strip("coalesce(text, '')")}, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)""")
def sentences(spark, sf_dir):
    found = text.sentences(F.col("text"))
    return documents(spark, sf_dir).select("doc", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS said FROM orders")
def long_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.long_date(F.col("o_orderdate").cast("string")).alias("said"))


@register(rf"""WITH lines AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
    bare AS (SELECT doc, {sql_strip(r"regexp_replace(regexp_replace(regexp_replace(x, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '__([^_]+)__', '\1', 'g')")} AS x FROM lines)
    SELECT doc, count(DISTINCT x) AS n, md5(string_agg(DISTINCT x, '|' ORDER BY x)) AS digest FROM bare WHERE x <> '' GROUP BY doc""")
def references(spark, sf_dir):
    """Lines as references: each once."""
    found = documents(spark, sf_dir).filter("text is not null").select("doc", text.distinct_references(F.split("text", "\n", -1)).alias("refs")).filter(F.size("refs") > 0)
    return found.select("doc", F.size("refs").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("refs"), "|")).alias("digest"))


@register(f"""WITH {FULL}, vocabulary AS (SELECT term, count(*) AS df FROM full_postings GROUP BY term),
    typed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{2,32}}')) || 's' AS term FROM benchmark),
    tried AS (
        SELECT term, 0 AS rule, left(term, -3) || 'y' AS stem FROM typed WHERE term LIKE '%ies' AND length(term) >= 6
        UNION ALL SELECT term, 1, left(term, -1) FROM typed WHERE term LIKE '%s' AND length(term) >= 4
        UNION ALL SELECT term, 2, left(term, -2) FROM typed WHERE regexp_matches(term, '(s|x|z|ch|sh)es$') AND length(term) >= 5)
    SELECT t.term, arg_min(stem, rule) AS stem FROM tried t JOIN vocabulary v ON v.term = stem AND v.df >= 20 ANTI JOIN vocabulary w ON w.term = t.term GROUP BY t.term""")
def fold_fallbacks(spark, sf_dir):
    """Words that the index doesn't have, which find their stems."""
    typed = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,32}"), F.lit(0))).alias("word"))
    return index.fallbacks(typed.select(F.concat("word", F.lit("s")).alias("term")).distinct(), full_text(spark, sf_dir).vocabulary())


def sql_lookup(x: str, pairs: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {sql_quote(k)} THEN {sql_quote(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


@register(f"""SELECT n_nationkey, {sql_lookup("upper(trim(n_name))", COUNTRY_LABEL, "trim(n_name)")} AS country,
        {sql_lookup("lower(trim(r_name))", REGION_LABEL, "array_to_string(list_transform(string_split(replace(trim(r_name), '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")} AS region,
        {sql_lookup("lower(trim(r_name))", SECTION_LABEL, "upper(replace(trim(r_name), '-', ' ')[1]) || lower(replace(trim(r_name), '-', ' ')[2:])")} AS section
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def place_labels(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", canon.country_label(F.col("n_name")).alias("country"), canon.region_label(F.col("r_name")).alias("region"), canon.section_label(F.col("r_name")).alias("section"))


TRACKS = [*VILLAGES, *OLD_TRACK, "None of these"]
DOMAINS = [*DOMAIN_VILLAGE, "none"]


@register(f"""WITH given AS (SELECT p_partkey, [{", ".join(map(sql_quote, TRACKS))}][p_partkey % {len(TRACKS)} + 1] AS track, [{", ".join(map(sql_quote, DOMAINS))}][p_partkey // 7 % {len(DOMAINS)} + 1] AS domain FROM part)
    SELECT p_partkey, CASE WHEN track IN ({", ".join(map(sql_quote, sorted(VILLAGES)))}) THEN track ELSE {sql_lookup("track", OLD_TRACK, "(" + sql_lookup("domain", DOMAIN_VILLAGE, "''") + ")")} END AS topic FROM given""")
def topics(spark, sf_dir):
    """Old tracks and domains, dealt out to the parts."""
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at % len(names) + 1).cast("int"))
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", canon.village(pick(TRACKS, key), pick(DOMAINS, F.floor(key / 7))).alias("topic"))


@register(r"""SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN concat('https://', 2020 + s_suppkey % 6, '.new.example/', trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-'), '/')
        ELSE concat('https://', 2000 + s_suppkey % 22, '.old.example/Team:', replace(n, ' ', '_')) END AS url FROM (SELECT *, concat(s_name, ' (HS)  Team') AS n FROM supplier)""".replace("2020 + s_suppkey % 6", "2022 + s_suppkey % 4"))
def page_urls(spark, sf_dir):
    own, key = F.concat("s_name", F.lit(" (HS)  Team")), F.col("s_suppkey")
    name = F.when(key % 9 == 0, " \t").otherwise(F.concat(F.lit(" "), own, F.lit("\n")))
    year = F.when(key % 2 == 0, 2022 + key % 4).otherwise(2000 + key % 22).cast("int")
    official = F.when(key % 9 == 0, "").when(key % 5 == 0, own)
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.page_url("new.example", "old.example", name, year, official).alias("url"))


@register(r"""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'the-old-one' WHEN 1 THEN 'by-' || lower(s_name) WHEN 2 THEN regexp_replace('m ' || lower(s_name), '\s+', '-', 'g') ELSE 'unknown' END AS model FROM supplier""")
def model_names(spark, sf_dir):
    key = F.col("s_suppkey")
    declared, by = F.when(key % 4 == 0, " Old One "), F.when(key % 4 == 1, F.concat(F.lit("By "), F.col("s_name"))).otherwise("")
    path = F.when(key % 4 == 2, F.concat(F.lit("a/metadata_M "), F.col("s_name"), F.lit(".json"))).otherwise("a/other.json")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.model_name(declared, by, path, {"old-one": "the-old-one"}).alias("model"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw records, with lists as JSON."""
    parts = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    items = F.concat(F.lit('["'), F.col("p_brand"), F.lit('", {"name": " '), F.col("p_type"), F.lit('", "importance": "Core"}, 7, {"name": ""}, {"name": "BBa_B0034 of "}]'))
    return parts.select(
        text.slug(F.col("p_name")).alias("slug"), (2004 + F.col("p_partkey") % 20).cast("int").alias("year"), F.concat(F.lit(" "), F.col("p_name")).alias("team"), F.lit("x/metadata_Big One.json").alias("path"),
        *[none.alias(c) for c in ("problem_statement", "approach_statement", "novelty_claim", "failure_modes", "key_references", "chassis_organisms", "molecular_techniques", "application_domain", "model", "processed_by")],
        F.lit('["a", 1, {"b": 2}, "c"]').alias("key_results"), F.col("p_type").alias("summary"), F.col("p_name").alias("target_molecules"), items.alias("biological_parts"), F.lit(" T ").alias("track"),
    )


@register("""SELECT concat(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), '-', 2004 + p_partkey % 20) AS id, p_name AS name, p_type AS summary, '' AS problem_statement, 'a,c' AS key_results, 'big-one' AS model, 'T' AS track,
        concat(p_brand, ',', p_type, ',BBa_B0034 of') AS parts, 'BBa_B0034' AS code, concat(p_brand, ',', p_type, ',', p_name) AS core, (2004 + p_partkey % 20)::VARCHAR AS year FROM part""")
def records_built(spark, sf_dir):
    built = records.build_records(raw_records(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",")
    return built.select(
        "id", "name", "summary", "problem_statement", joined("key_results").alias("key_results"), "model", "track", joined(F.transform("biological_parts", lambda x: x["name"])).alias("parts"),
        F.element_at(F.col("biological_parts"), -1)["registry_id"].alias("code"), joined("core").alias("core"), joined(F.try_element_at("f", F.lit("year"))).alias("year"),
    )


@register(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'exact' END AS match, CASE WHEN c_custkey % 3 > 0 THEN concat('City of ', n_name) ELSE '' END AS city,
        CASE WHEN c_custkey % 3 > 0 THEN {sql_lookup("upper(trim(n_name))", COUNTRY_LABEL, "trim(n_name)")} ELSE 'old' END AS country, CASE WHEN c_custkey % 3 = 0 THEN 'kept' END AS track FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def records_enriched(spark, sf_dir):
    """Customers with what their nation says of them; the others keep their facets."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    own = F.map_filter(F.create_map(F.lit("country"), F.array(F.lit("old")), F.lit("track"), F.array(F.when(key % 3 == 0, "kept"))), lambda _, v: F.get(v, F.lit(0)).isNotNull())
    rows = customers.select(key.alias("id"), own.alias("f"))
    matches = customers.filter(key % 3 > 0).select(key.alias("id"), F.col("c_nationkey").alias("row"), F.lit("exact").alias("match"))
    directory = nations.select(F.col("n_nationkey").alias("row"), F.lit("").alias("village"), F.lit(None).cast("string").alias("region"), F.col("n_name").alias("country"), F.lit(" ").alias("section"), F.concat(F.lit("City of "), "n_name").alias("city"))
    found = resolve.enrich(rows, matches, directory)
    first = lambda k: F.get(F.try_element_at("f", F.lit(k)), F.lit(0))
    return found.select("id", "match", "city", first("country").alias("country"), first("track").alias("track"))


@register("""WITH notes AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 5 > 0)
    SELECT c_custkey, qa FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, o_orderkey) AS qa FROM notes GROUP BY 1) USING (c_custkey)""")
def records_annotated(spark, sf_dir):
    """Customers with their last order's priority as a note; every fifth note has no year."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("slug"), F.lit(2020).alias("year"))
    notes = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("slug"), F.when(F.col("o_orderkey") % 5 > 0, " 2020").otherwise("none").alias("year"), F.col("o_orderkey").alias("n"), F.col("o_orderpriority").alias("qa"))
    return resolve.annotate(rows, notes).select("c_custkey", "qa")


@register(f"WITH {WEIGHTED}, {sql_search({0: parse(AND, NO_GROUPS)})}, top AS ({TOP20}) SELECT rank, doc, source AS name, lang AS domain, length(text) AS size FROM top JOIN docs USING (doc)")
def result_cards(spark, sf_dir):
    """A page of results with what is shown of each."""
    cards = documents(spark, sf_dir).select("doc", F.col("source").alias("name"), F.col("lang").alias("domain"), F.length("text").cast("long").alias("size"))
    return records.with_cards(top20(search.lexical(primary(spark, sf_dir), parse(AND, NO_GROUPS))), cards).select("rank", "doc", "name", "domain", "size")


EVALUATED = f"""WITH {WEIGHTED}, {sql_search({i: parse(q, OWN_GROUPS) for i, q in BATCH.items()})},
    ranked AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM scores QUALIFY rank <= 20),
    relevant AS (SELECT qid, doc FROM docs, range({len(BATCH)}) t(qid) WHERE size = 'medium' AND doc % 3 = qid % 3),
    hits AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM ranked JOIN relevant USING (qid, doc)),
    sizes AS (SELECT qid, count(*) AS n_rel FROM relevant GROUP BY qid),
    sums AS (SELECT qid, min(rank) AS first, count(*) FILTER (rank <= 10) AS top, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg, sum(nth / rank) AS precisions FROM hits GROUP BY qid),
    ideals AS (SELECT qid, (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_rel) AS ideal FROM sizes),
    per AS (SELECT qid, n_rel, first, coalesce(1 / first, 0) AS rr, coalesce(top / n_rel, 0) AS recall, coalesce(dcg / ideal, 0) AS ndcg, coalesce(precisions / n_rel, 0) AS ap, coalesce(top / 10, 0) AS precision FROM sizes LEFT JOIN sums USING (qid) JOIN ideals USING (qid))"""


@register(f"""{EVALUATED} SELECT count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(ap), 6) AS map, round(avg(precision), 6) AS precision,
        round(avg(least(n_rel, 10) / n_rel), 6) AS recall_ceiling, round(avg(n_rel), 6) AS mean_relevant FROM per""")
def evaluation_summary(spark, sf_dir):
    """All measures of a run of twelve queries, against documents that the run doesn't know to be wanted."""
    ranked, relevant = evaluated_run(spark, sf_dir, list(BATCH.values()))
    found = evaluate.summary(evaluate.per_query(ranked, relevant))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "ndcg", "map", "precision", "recall_ceiling", "mean_relevant")])


def evaluated_run(spark: SparkSession, sf_dir: str, asked: list[str]) -> tuple[DataFrame, DataFrame]:
    ranked = search.batch_ranked(search.batch(primary(spark, sf_dir), search.query_table(spark, {i: parse(q, OWN_GROUPS) for i, q in enumerate(asked)})), 20)
    wanted = documents(spark, sf_dir).filter("size = 'medium'").select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(asked) - 1).cast("long"))).alias("qid"))
    return ranked, wanted.filter(F.col("doc") % 3 == F.col("qid") % 3).select("qid", "doc")


@register(f"""{EVALUATED}, valued AS (SELECT qid, n_chars, lag(n_chars) OVER (PARTITION BY qid ORDER BY rank) AS before FROM ranked JOIN docs USING (doc))
    SELECT qid, count(*) FILTER (n_chars > before) AS inversions FROM valued GROUP BY qid""")
def rank_inversions(spark, sf_dir):
    """How often a document is longer than the one ranked before it."""
    ranked, _ = evaluated_run(spark, sf_dir, list(BATCH.values()))
    return evaluate.inversions(ranked.join(documents(spark, sf_dir).select("doc", "n_chars"), "doc"), "n_chars")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

