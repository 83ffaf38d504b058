"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (
    bpe,
    exact_dedup,
    langid,
    lexical,
    ngram_join,
    packing,
    quality,
    token_store,
    topk,
    toxicity,
    url_filter,
    warc,
    whitening,
)
from panelcast.llm.common import in_fold, labelled, read

# The rules and limits that the queries are asked to apply: fixed values.
URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, folder, "pages", "page_id", "url"), URL_RULES)


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return ngram_join.similar_documents(docs, ngram_join.Rule(words=3, num=90, den=100))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(read(spark, folder, "documents", "doc_id", "text"), ranks)


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages", "page_id", "url", "html")
    return warc.archive_pages(pages).drop("url")


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return exact_dedup.exact_copies(docs).drop("chars")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(in_fold("doc_id", 3) == 1, F.lit(False))
    languages = langid.learn(docs.where(~held_out))
    found = langid.identify(docs, languages)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "reliable")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    labels = read(spark, folder, "labels", "doc_id", "toxic")
    model = toxicity.fit(labelled(docs, labels.where(in_fold("doc_id", 5) != 0), "toxic"))
    held_out = F.coalesce(in_fold("doc_id", 5) == 0, F.lit(False))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang")
    labels = read(spark, folder, "labels", "doc_id", "quality").where("quality = 1")
    return quality.quality(docs, labelled(docs, labels, "quality"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return lexical.search(docs, read(spark, folder, "benchmark", "item_id", "text"), 50)


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_embeddings(read(spark, folder, "embeddings", "vec_id", "embedding"), 4)


def op13_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    store = token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    return token_store.read_store(store)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_warc": op6_warc,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_store": op13_token_store,
}

_RULE_ROWS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)

_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), "
    f"'{url_filter.UPPER}', '{url_filter.UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

ORACLES = {
    "op2_ngram_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
lists AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS grams
  FROM words
),
sets AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM lists),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT lists.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM lists JOIN reach ON reach.doc_id = lists.doc_id
GROUP BY lists.doc_id, grams
""",
    "op5_exact_top_k": """
WITH components AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
),
bad AS (SELECT DISTINCT vec_id FROM components WHERE x IS NULL OR NOT isfinite(x)),
ints AS (
  SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM components WHERE vec_id NOT IN (SELECT vec_id FROM bad)
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY q.vec_id, c.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op7_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code_points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
),
ranked AS (
  SELECT doc_id, t,
    first_value(doc_id) OVER (PARTITION BY t ORDER BY n_code_points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY t) AS group_size
  FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM ranked
""",
    "op1_url_filter": f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}),
rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
),
fits AS (
  SELECT parts.page_id, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY parts.page_id ORDER BY length(r_host || r_path) DESC) AS n
  FROM parts JOIN rules
    ON (host = r_host OR suffix(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT parts.page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id AND fits.n = 1
""",
    "op6_warc": """
WITH sized AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest,
    octet_length(encode(coalesce(html, ''))) AS payload_bytes
  FROM pages
),
ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM sized
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM ranked
""",
    "op11_ranked_search": f"""
WITH words AS (SELECT doc_id, {_TERMS} AS w FROM documents),
totals AS (SELECT count(*) AS docs, sum(len(w)) AS terms FROM words WHERE len(w) > 0),
sized AS (
  SELECT doc_id, 100 - 50 + ((50 * len(w) * docs) // terms) AS m FROM words, totals WHERE len(w) > 0
),
counts AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY doc_id, term
),
weights AS (
  SELECT term,
    CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term
),
items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN sized USING (doc_id)
  GROUP BY item_id, doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
""",
}
