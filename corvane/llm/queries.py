"""The operators applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lines, media, packing, pii, quality, simhash, suffixes, urls
from .common import is_training, table

#: The rules of the URL query.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = """
    WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    lines AS (
        SELECT doc_id, no, CASE WHEN n_tokens - len(regexp_extract_all(x, '[^ ]*[0-9][^ ]*')) >= 0.8 * n_tokens THEN regexp_replace(x, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE x END AS t
        FROM (SELECT doc_id, no, x, length(x) - length(replace(x, ' ', '')) + 1 AS n_tokens FROM (SELECT doc_id, trim(unnest(ls)) AS x, generate_subscripts(ls, 1) AS no FROM raw))),
    parsed AS (
        SELECT doc_id, no, t, concat(length(t) - length(replace(t, ' ', '')), '|', array_to_string(string_split(t, ' ')[1:4], ' ')) AS leaf
        FROM lines WHERE t <> ''),
    exact AS (SELECT leaf, t, count(DISTINCT doc_id) AS n, min(doc_id) AS first_doc FROM parsed GROUP BY ALL),
    leaves AS (SELECT leaf FROM exact GROUP BY leaf HAVING sum(n) >= 3 AND count(*) > 1),
    tokens AS (
        SELECT leaf, t, n, unnest(string_split(t, ' ')) AS token, generate_subscripts(string_split(t, ' '), 1) AS pos
        FROM exact SEMI JOIN leaves USING (leaf)),
    support AS (SELECT leaf, pos, token FROM tokens GROUP BY ALL HAVING sum(n) >= 3),
    general AS (
        SELECT leaf, t, concat(leaf, '|', string_agg(coalesce(s.token, '<*>'), ' ' ORDER BY tokens.pos)) AS template
        FROM tokens LEFT JOIN support s USING (leaf, pos, token) GROUP BY leaf, t
        HAVING count(s.token) FILTER (tokens.token <> '<*>') >= 0.8 * count(*)),
    groups AS (SELECT e.t, coalesce(template, 'line ' || e.t) AS template, n, first_doc FROM exact e LEFT JOIN general g ON e.t = g.t),
    recurring AS (SELECT template, min(first_doc) AS first_doc FROM groups GROUP BY template HAVING sum(n) >= 3),
    hits AS (
        SELECT doc_id, no, doc_id = r.first_doc AND row_number() OVER (PARTITION BY doc_id, template ORDER BY no) = 1 AS stays
        FROM parsed JOIN groups USING (t) JOIN recurring r USING (template)),
    kept AS (
        SELECT doc_id, string_agg(x, chr(10) ORDER BY no) AS text
        FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS no FROM raw) r
        ANTI JOIN (SELECT * FROM hits WHERE NOT stays) h USING (doc_id, no) GROUP BY doc_id),
    dropped AS (SELECT doc_id, count(*) AS n_dropped FROM hits WHERE NOT stays GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
        CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n_dropped, 0) AS n_dropped
    FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN dropped USING (doc_id)"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urls.rule_table(spark, URL_RULES)
    lengths = sorted({len(rule.partition("/")[2]) + 1 for _, rule in URL_RULES})
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules, lengths).drop("url")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), is_training)
    scored = quality.score_quality(docs, model, keep=["doc_id"])
    held_out = (~is_training(F.col("doc_id"))).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ("task", "nth")
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0, numbered=numbers)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests, capacity=2048, numbered=numbers)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language_model(docs, is_training(F.col("doc_id")))
    found = langid.identify_language(docs, model, keep=["doc_id"])
    return found.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


OP7_SQL = r"""
    WITH doc AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
    windows AS (
        SELECT DISTINCT item_id, least(8, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i : i + 7], ' '))) AS win
        FROM item WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM windows),
    spots AS (
        SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS win
        FROM doc, sizes WHERE len(w) >= n),
    hits AS (SELECT DISTINCT doc_id, s, n, win FROM spots SEMI JOIN windows USING (n, win)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits JOIN windows USING (n, win)) GROUP BY doc_id)
    SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
    FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


#: The key of the query's pseudonyms; a real run passes its own secret to pii.pseudonymize.
PSEUDONYM_KEY = b"published key of the query"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PSEUDONYM_KEY, keep=["doc_id", "text"])


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.store_media(table(spark, sf_dir, "documents")))
    tail = F.substring(F.col("payload"), F.length("payload") - 31, F.lit(32))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), depth=100, keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_simhash": op2_simhash, "op3_url_filter": op3_url_filter, "op4_quality": op4_quality, "op5_packing": op5_packing, "op6_language_id": op6_language_id, "op7_decontaminate": op7_decontaminate, "op8_pii": op8_pii, "op9_media": op9_media, "op10_suffix_dedup": op10_suffix_dedup}


def oracle_sql() -> dict[str, str]:
    values = ", ".join(f"('{verdict}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{rule}')" for verdict, rule in URL_RULES)
    return {
        "op1_line_dedup": OP1_SQL,
        "op7_decontaminate": OP7_SQL,
        "op3_url_filter": f"""
            WITH rules(verdict, rh, rp, rule) AS (VALUES {values}),
            split AS (
                SELECT page_id,
                    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
                FROM pages),
            keyed AS (SELECT DISTINCT host, path FROM split),
            best AS (
                SELECT host, path, rule, verdict FROM keyed JOIN rules
                    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
                QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, length(rh) DESC, rule) = 1)
            SELECT page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict
            FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path"""
    }
