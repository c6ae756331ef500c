"""Registered queries of the subpackage, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from benchloom.llm import decontaminate, language, lm, mixing, near, phrases, quality, repeats, suffixes, topk, toxicity, trie, warc
from benchloom.llm.frames import held_out
from benchloom.plans.registry import Registry
from benchloom.sources.tables import load

registry = Registry()

TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

WARC_SQL = r"""
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
           lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
           regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(\?[^#]+)', 1) AS query
    FROM pages
), keyed AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
           array_to_string(list_reverse(string_split(regexp_replace(host, '^www\.', ''), '.')), ',') || ')'
           || lower(CASE WHEN path = '' THEN '/' ELSE path END || query) AS url_key
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
       url_key, row_number() OVER (ORDER BY url_key, page_id) AS history_seq,
       row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS capture_no
FROM keyed
"""

DECONTAMINATION_SQL = r"""
WITH lowered AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
    FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i)
    WHERE len(w) > 0
), hits AS (
    SELECT d.doc_id, d.i, x.m, x.item_id
    FROM (
        SELECT doc_id, i, l.m, array_to_string(w[i:i + l.m - 1], ' ') AS words
        FROM (SELECT DISTINCT m FROM item_windows) l, lowered, unnest(range(1, len(w) - l.m + 2)) AS r(i)
    ) d JOIN item_windows x ON d.m = x.m AND d.words = x.words
), covered AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + m)) AS r(k) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@registry.query()
def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    model = quality.fit(docs.where(~held_out()), load(spark, d, "labels").select("doc_id", "quality"))
    scored = quality.score(docs.select("doc_id", "text", "source", "lang", "n_chars"), model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "text_score", "page_score", "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@registry.query()
def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(~held_out()), load(spark, d, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@registry.query()
def op3_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.suffix_dedup(load(spark, d, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@registry.query(TOP_K_SQL)
def op4_topk_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors)


@registry.query(WARC_SQL)
def op5_warc_history(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive_history(load(spark, d, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_seq", "capture_no",
    )


@registry.query(DECONTAMINATION_SQL)
def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.scan(load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@registry.query()
def op7_language(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    found = language.identify(docs.select("doc_id", "text"), model, reject=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@registry.query()
def op8_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near.near_duplicates(load(spark, d, "documents"), common=None)


@registry.query()
def op9_entropy_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


REPEATS_SQL = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words FROM split, unnest(range(1, len(w) - 18)) AS r(i)
), later AS (
    SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1
), gone AS (
    SELECT DISTINCT doc_id, k FROM later, unnest(range(i, i + 20)) AS r(k)
), counted AS (
    SELECT doc_id, count(*) AS n, list(k) AS ks FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ks, i)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN counted USING (doc_id)
"""


@registry.query(REPEATS_SQL)
def op10_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeats(load(spark, d, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents)
), followed AS (
    SELECT lang, w, lead(w) OVER piece AS w2, lead(w, 2) OVER piece AS w3
    FROM (SELECT lang, piece_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM pieces)
    WINDOW piece AS (PARTITION BY piece_id ORDER BY i)
), counted AS (
    SELECT lang, 1 AS m, w AS phrase, count(*) AS f FROM followed GROUP BY ALL
    UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM followed WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM followed WHERE w3 IS NOT NULL GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang
), found AS (
    SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1 AND f >= 10
), cuts AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
           CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM (SELECT *, lang || chr(9) || array_to_string(w[1:k], ' ') AS head, lang || chr(9) || array_to_string(w[k + 1:], ' ') AS tail
          FROM found, unnest(range(1, m)) AS r(k)) c
    JOIN counted x ON x.lang || chr(9) || x.phrase = head JOIN counted y ON y.lang || chr(9) || y.phrase = tail
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
    SELECT lang, phrase, max(a) AS holder
    FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM found WHERE m = 3) GROUP BY ALL
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN held USING (lang, phrase) JOIN totals USING (lang)
WHERE holder IS NULL OR 100 * holder < 50 * a
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000
"""


@registry.query(COLLOCATIONS_SQL)
def op11_collocations(spark: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(load(spark, d, "documents").select("lang", "text"))


@registry.query()
def op13_lm_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    return lm.fit_and_score(docs, ~held_out(of=7), ["doc_id"]).withColumn("held_out", held_out(of=7))


@registry.query()
def op12_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.prefix_trie(load(spark, d, "conversations").select("conv_id", "turn", "role", "text"), graft=True)
