"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import flac, htmltemplates, jaccard, languagemodel, packing, pivots, sentencepieces, suffixdedup, toxicity, urlrules
from graphloom.llm.sparkio import fold, table

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


#: Verdict, host and path of the rules that come before mined ones.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: A mined rule needs as many bad URLs, and bad ones must be as many of the URLs that it holds for: more than good ones.
URL_COUNT, URL_CONFIDENCE = 10, 0.5


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languagemodel.score(table(spark, sf_dir, "documents", "doc_id", "text"), folds=10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.learn(docs, labels, may_learn=fold("doc_id", 3) != 1)
    return toxicity.score(docs, model, threshold=0.7).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltemplates.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    rules = urlrules.mine(pages.join(bad, "page_id"), min_count=URL_COUNT, min_confidence=URL_CONFIDENCE)
    return urlrules.judge(pages, rules, URL_RULES)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return sentencepieces.round_trip_digests(docs, public_tokenizers.path(PIECES))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(flac.store(table(spark, sf_dir, "documents", "doc_id", "text")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(BYTES), length=2048, end_id=1)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents", "doc_id", "text"), percent=80)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=10, query="id % 100 = 0")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.kept_digests(table(spark, sf_dir, "documents", "doc_id", "text"), width=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm": op1_lm,
        "op2_toxicity": op2_toxicity,
        "op3_html": op3_html,
        "op4_urls": op4_urls,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_flac": op6_flac,
        "op7_packing": op7_packing,
        "op8_jaccard": op8_jaccard,
        "op9_topk": op9_topk,
        "op10_suffix": op10_suffix,
    }


SQL9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


SQL8 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingles
  FROM w
), class AS (
  SELECT shingles, min(doc_id) AS class_id, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles
), t AS (
  SELECT class_id, n, unnest(shingles) AS shingle FROM class
), links AS (
  SELECT a.class_id AS a, b.class_id AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT class_id AS a, class_id AS b FROM class
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), component AS (
  SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(class.class_id, s.doc_id) AS class_id, coalesce(component.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN class ON s.shingles = class.shingles LEFT JOIN component ON class.class_id = component.class_id
"""
SQL10 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS pos, h FROM d
), v AS (
  SELECT doc_id, pos, substr(h, 2 * pos + 1, 100) AS bytes FROM w
), least AS (
  SELECT bytes, min(doc_id) AS first_id FROM v GROUP BY bytes
), hit AS (
  SELECT DISTINCT v.doc_id, v.pos FROM v JOIN least ON v.bytes = least.bytes WHERE v.doc_id > least.first_id
), step AS (
  SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM hit
), run AS (
  SELECT doc_id, pos, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM step
), span AS (
  SELECT doc_id, min(pos) AS lo, max(pos) + 50 AS hi FROM run GROUP BY doc_id, run
), spans AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, list(lo ORDER BY lo) AS lows, list(hi ORDER BY lo) AS highs FROM span GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         CASE WHEN lows IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(lows) + 2), lambda i:
           substr(h, 2 * CASE WHEN i = 1 THEN 0 ELSE highs[i - 1] END + 1, 2 * (CASE WHEN i > len(lows) THEN len(h) // 2 ELSE lows[i] END - CASE WHEN i = 1 THEN 0 ELSE highs[i - 1] END))), '') END AS rest
  FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""


def sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op8_jaccard": SQL8, "op9_topk": SQL9, "op10_suffix": SQL10}
