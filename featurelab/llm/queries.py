"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.llm import align, ann, chat, divergence, language, mixing, packing, pii, quality, sharding, simhash, topk, urls
from featurelab.llm.pii_labels import MARKED
from featurelab.sources.work import materialize

CAPACITY = 2048
SHARDS = 24
GOOD = 0.7
RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]
CONTROL_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer's file lies: below ``TOKENIZERS_DIR`` if that is set, else where its
    package says. Workers read the file, so the path must be theirs too."""
    if "TOKENIZERS_DIR" in os.environ:
        return os.path.join(os.environ["TOKENIZERS_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, max_bits=2, seed=42)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY, 0)


def op3_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.uniform_shards(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@lru_cache(maxsize=1)
def private_data_model() -> pii.Crf:
    """The CRF of the small labelled table."""
    return pii.train_crf(pii.labelled_rows(MARKED))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"), private_data_model())
    base = F.filter("spans", lambda s: ~s["added"])

    def told(spans):
        line = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(line, ",")

    def of_kind(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [of_kind(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(CONTROL_CHAT, "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    events = turns.select(
        "conv_id", F.monotonically_increasing_id().alias("message"), F.col("turn").alias("position"), F.col("turn").alias("seq"),
        F.lit("message").alias("kind"), "role", "text",
    )
    told = chat.format_chats(events).withColumn("turns", chat.turns_of(F.col("formatted")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    told = told.withColumn("learned", F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), ""))
    return told.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), share=1.5, max_epochs=2.0).drop("source", "copies")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("double"))
    # Components that are not finite stay as they are, for the operator to leave out.
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = _table(spark, sf_dir, "embeddings").where(finite).select("vec_id", whole.alias("embedding"))
    return topk.top_k(rows, F.col("id") % 20 == 0, 20).withColumn("score", F.col("score").cast("bigint"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align.align_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    # Written once: the counts of the whole corpus come before the sums of a document.
    rows = materialize(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return align.with_counts(rows, align.link_counts(rows)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    named = language.predict(docs, language.fit(docs))
    return named.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_simhash_near_duplicates, op2_best_fit_packing, op3_uniform_shards, op4_private_data, op5_url_filters, op6_chat_format,
        op7_quality, op8_nearest_neighbours, op9_mixture, op10_top_k, op11_token_alignment, op12_language, op13_source_divergence,
    )
}


def _sql_escaped(text: str) -> str:
    for k, word in enumerate(("~", *chat.CONTROL)):
        text = f"replace({text}, '{word}', '~{k}')"
    return text


_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)

ORACLE = {
    "op5_url_filters": rf"""
WITH RECURSIVE rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
tags AS (
  SELECT url AS src, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^<>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
links AS (
  SELECT src, trim(replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link\s(.*\s)?rel\s*=\s*["'']?([^"''<>]*\s)?canonical["''\s/>]') THEN regexp_replace(
      regexp_extract(tag, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 0), '(?is)^\shref\s*=\s*["'']?|["'']$', '', 'g')
    WHEN regexp_matches(tag, '(?is)^<meta\s(.*\s)?http-equiv\s*=\s*["'']?refresh["''\s/>]') THEN
      regexp_extract(tag, '(?is)\scontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''>]*)', 1) END, '&amp;', '&')) AS link
  FROM tags),
ends AS (
  SELECT src, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(src, '^([^:/?#]*)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(src, '^[^:/?#]*://[^/?#]*', 0) || link
    WHEN starts_with(link, '#') THEN src
    WHEN starts_with(link, '?') THEN regexp_extract(src, '^[^?#]*', 0) || link
    ELSE regexp_extract(src, '^[^:/?#]*://[^/?#]*', 0)
      || coalesce(nullif(regexp_extract(src, '^[^:/?#]*://[^/?#]*([^?#]*/)?', 1), ''), '/') || link END AS dst
  FROM links WHERE link <> ''),
urls AS (
  SELECT DISTINCT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION ALL SELECT dst FROM ends)),
parts AS (
  SELECT url, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM urls),
ruled AS (
  SELECT p.*, CASE WHEN tail IS NOT NULL THEN host || chr(10) || tail END AS node, r.rule, r.verdict
  FROM parts p LEFT JOIN (
    SELECT url, rule_host || rule_path AS rule, verdict
    FROM parts, rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1) r USING (url)),
edges AS (
  SELECT a.node AS a, b.node AS b FROM ends JOIN ruled a ON a.url = src JOIN ruled b ON b.url = dst
  UNION SELECT b.node, a.node FROM ends JOIN ruled a ON a.url = src JOIN ruled b ON b.url = dst),
tainted(node) AS (
  SELECT node FROM ruled WHERE verdict = 'block' AND node IN (SELECT a FROM edges)
  UNION SELECT b FROM tainted JOIN edges ON a = node)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  coalesce(verdict, CASE WHEN node IN (SELECT node FROM tainted) THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN ruled USING (url)""",
    "op6_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_sql_escaped('role')}) + length({_sql_escaped('text')}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op9_mixture": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
o AS (
  SELECT *, cap / weight AS ratio, sum(cap) OVER p AS caps, sum(weight) OVER p AS weights,
    lead(cap / weight) OVER (ORDER BY cap / weight, source NULLS LAST) AS next
  FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(weight) AS weights FROM w),
l AS (
  SELECT min(level) AS level FROM (
    SELECT budget / weights AS level FROM t WHERE (SELECT min(ratio) FROM o) > budget / weights
    UNION ALL
    SELECT (budget - caps) / (t.weights - o.weights) FROM o, t
    WHERE next IS NOT NULL AND next > (budget - caps) / (t.weights - o.weights)
      AND ratio <= (budget - caps) / (t.weights - o.weights))),
g AS (SELECT source, source_size, least(cap, weight * coalesce(level, 'inf'::DOUBLE)) AS target FROM w, l),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
p AS (
  SELECT d.doc_id, d.size, h.source_size, h.target, h.whole, h.target - h.whole * h.source_size AS extra,
    coalesce(sum(d.size) OVER (PARTITION BY h.source ORDER BY draw, d.size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, (least(whole + (begins + size / 2.0::DOUBLE <= extra)::BIGINT, 2) * size)::BIGINT AS taken FROM p""",
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vector, c.vector)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT f.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * terms) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * terms) AS q FROM f JOIN v ON f.lang = v.lang),
pair AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(s.value, 0) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term)
QUALIFY part = 'pair' OR rank <= 10""",
}
