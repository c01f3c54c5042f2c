"""The queries of the ten operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_text, line_dedup, lm_score, sentencepiece_codec, simhash_dedup, syncmers, toxicity, url_filter

#: The folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("CHUNKLAKE_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"
RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"), url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]
#: Pages whose id this divides make up the list of blocked URLs.
LISTED_EVERY = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, token_ids, n_tokens`` and the length and hash of the text that the ids decode to."""
    return tokenise(_table(spark, sf_dir, "documents"))


def tokenise(docs: DataFrame) -> DataFrame:
    pieces = sentencepiece_codec.load_pieces(f"{TOKENIZERS}/{PIECE_MODEL}")
    coded = sentencepiece_codec.encode(docs, pieces, decoded="decoded")
    return coded.select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"), F.char_length("decoded").cast("bigint").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, n_chars, n_removed`` of every document after line dedup."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.char_length("text").cast("bigint").alias("n_chars"), F.col("n_removed").cast("bigint").alias("n_removed"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(_table(spark, sf_dir, "pages"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, log10_score, mean_log10`` under the trigram counts of all other documents."""
    out = lm_score.score_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, severity, p_toxic, toxic`` of every document."""
    return judged(_table(spark, sf_dir, "documents"), sf_dir).select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("severity") >= toxicity.TOXIC_FROM).alias("toxic"))


def judged(docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.score(docs, model_for(docs, sf_dir))


def model_for(docs: DataFrame, sf_dir: str) -> toxicity.OrdinalModel:
    """A model fitted on the labels of ``sf_dir``."""
    graded = _table(docs.sparkSession, sf_dir, "labels").select("doc_id", (F.col("toxic") > 0).cast("int").alias("grade"))
    return toxicity.train(docs, graded)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, pages.where(F.col("page_id") % LISTED_EVERY == 0), RULES)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are written as ``start-end`` joined by commas."""
    out = chat_format.format_preferences(chat_format.preference_pairs(_table(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({c: text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_decontaminate, op4_html_text, op5_simhash_dedup, op6_lm_score, op7_syncmers, op8_toxicity, op9_url_filter, op10_chat_format)}

_OP2 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), solid AS (
  SELECT doc_id, pos, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx FROM lines WHERE trim(line) <> ''
), wins AS (
  SELECT doc_id, idx, t AS a, lead(t) OVER w AS b, lead(t, 2) OVER w AS c FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, idx, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, idx) AS rn FROM wins WHERE c IS NOT NULL
), gone AS (
  SELECT DISTINCT s.doc_id, s.pos FROM ranked r JOIN solid s ON s.doc_id = r.doc_id AND s.idx BETWEEN r.idx AND r.idx + 2 WHERE r.rn > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.text, '')) END AS n_chars,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_OP6 = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), toks AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words
), grams AS (
  SELECT doc_id, pos, w AS w3, lag(w) OVER d AS w2, lag(w, 2) OVER d AS w1 FROM toks WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), counted AS (
  SELECT doc_id, pos, w1, w2, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n,
         count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY doc_id, w3) AS f1,
         count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY doc_id, w2, w3) AS f2,
         count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS f3
  FROM grams
), contexts AS (
  SELECT *, lag(f1) OVER d AS c1, lag(f2) OVER d AS c2 FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), one AS (SELECT *, log10(greatest(f1, 1)::double / greatest(n, 1)) AS s1 FROM contexts
), two AS (SELECT *, CASE WHEN w2 IS NULL THEN s1 WHEN f2 > 0 THEN log10(f2::double / c1) ELSE log10(0.4::double) + s1 END AS s2 FROM one
), scored AS (
  SELECT doc_id, CASE WHEN w1 IS NULL THEN s2 WHEN f3 > 0 THEN log10(f3::double / c2) ELSE log10(0.4::double) + s2 END AS s FROM two
), sums AS (SELECT doc_id, count(*) AS n_words, sum(s) AS total FROM scored GROUP BY doc_id)
SELECT w.doc_id, coalesce(s.n_words, 0) AS n_words, round(coalesce(s.total, 0.0), 4) AS log10_score, round(s.total / s.n_words, 6) AS mean_log10
FROM words w LEFT JOIN sums s ON s.doc_id = w.doc_id
"""

_OP9 = r"""
WITH parts AS (
  SELECT page_id, coalesce(instr(url, '://') > 0, false) AS ok, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, ok, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS fields
  FROM parts
), keyed AS (
  SELECT *, CASE WHEN ok THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS key FROM cut
), judged AS (
  SELECT page_id, host, path, key IN (SELECT key FROM keyed WHERE page_id % 50 = 0 AND key IS NOT NULL) AS hit,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM keyed
)
SELECT page_id, host, path, rule, coalesce(hit, false) AS listed,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN hit THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_OP10 = r"""
WITH t AS (
  SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS idx, role, text FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT id, xor(id, 1) AS partner FROM t),
last AS (SELECT id, max(idx) AS last FROM t WHERE role = 'assistant' GROUP BY id),
reply AS (SELECT t.id, t.role, t.text FROM t JOIN last l ON l.id = t.id AND l.last = t.idx),
rejected AS (
  SELECT t.id, t.idx, t.role, t.text FROM t LEFT JOIN last l ON l.id = t.id WHERE l.last IS NULL OR t.idx < l.last
  UNION ALL
  SELECT i.id, coalesce(l.last, (SELECT max(idx) + 1 FROM t WHERE t.id = i.id)) AS idx, r.role, r.text FROM ids i JOIN reply r ON r.id = i.partner LEFT JOIN last l ON l.id = i.id
), pair AS (
  SELECT coalesce(c.id, r.id) AS id, coalesce(c.idx, r.idx) AS idx, c.idx IS NOT NULL AND r.idx IS NOT NULL AND c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text AS same
  FROM t c FULL JOIN rejected r ON c.id = r.id AND c.idx = r.idx
), prefix AS (SELECT id, coalesce(min(CASE WHEN NOT same THEN idx END) - 1, max(idx)) AS n FROM pair GROUP BY id),
sides AS (SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r' AS side, * FROM rejected),
drawn AS (
  SELECT side, id, idx, role, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body FROM sides
), placed AS (
  SELECT d.*, p.n, sum(length(head) + length(body)) OVER (PARTITION BY side, d.id, d.idx > p.n ORDER BY d.idx) AS stop FROM drawn d JOIN prefix p ON p.id = d.id
), made AS (
  SELECT id, side, string_agg(CASE WHEN idx <= n THEN head || body END, '' ORDER BY idx) AS prompt, string_agg(CASE WHEN idx > n THEN head || body END, '' ORDER BY idx) AS completion,
         string_agg(CASE WHEN idx > n AND role = 'assistant' THEN (stop - length(body))::bigint || '-' || stop::bigint END, ',' ORDER BY idx) AS spans
  FROM placed GROUP BY id, side
)
SELECT p.id AS pair_id, p.n::int AS n_prompt_turns, coalesce(c.prompt, '') AS prompt, coalesce(c.completion, '') AS chosen_completion, coalesce(c.spans, '') AS chosen_spans,
       coalesce(r.completion, '') AS rejected_completion, coalesce(r.spans, '') AS rejected_spans
FROM prefix p LEFT JOIN made c ON c.id = p.id AND c.side = 'c' LEFT JOIN made r ON r.id = p.id AND r.side = 'r'
"""

ORACLES = {"op2_line_dedup": _OP2, "op6_lm_score": _OP6, "op9_url_filter": _OP9, "op10_chat_format": _OP10}
