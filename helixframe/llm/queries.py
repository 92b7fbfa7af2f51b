"""One query per operator over its whole table, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import (
    byte_bpe,
    decontaminate,
    fingerprints,
    html_text,
    jaccard_join,
    line_crf,
    masked_lm,
    mixing,
    pii,
    ranked_search,
    resampling,
    spann,
    toxicity,
)
from helixframe.llm.base import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, folder, "documents").select("doc_id", "text"))


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_texts(table(spark, folder, "pages"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return spann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return byte_bpe.digests(docs, ranks, public_tokenizers.PATTERN)


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents").select("doc_id", "text"))


def op8_masked_lm(spark: SparkSession, folder: str) -> DataFrame:
    return masked_lm.score_corpus(table(spark, folder, "documents").select("doc_id", "text"))


def op9_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_crf.score(docs, line_crf.train(docs, table(spark, folder, "labels")))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("tokens"))
    return mixing.mix(rows).select("doc_id", "source", F.col("tokens").alias("n_tokens"), "epoch", "block", "position")


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, folder, "benchmark")).drop("n_words")


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ranked_search.search(docs, table(spark, folder, "benchmark"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.digests(docs, table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_html_text,
        op3_jaccard_join,
        op4_toxicity,
        op5_nearest,
        op6_byte_bpe,
        op7_pii,
        op8_masked_lm,
        op9_line_crf,
        op10_mixing,
        op11_resampling,
        op12_ranked_search,
        op13_decontamination,
    )
}

_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
      WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
      ELSE [] END AS shingles
  FROM words
), cells AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM cells a JOIN cells b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id
GROUP BY s.doc_id, len(s.shingles)
"""

_MIXING_SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents
), src AS (
  SELECT source, sum(n_tokens)::BIGINT AS tokens FROM rows WHERE n_tokens > 0 GROUP BY source
), shares AS (
  SELECT *, tokens / (sum(tokens) OVER ())::DOUBLE AS share, count(*) OVER () AS n FROM src
), tried AS (
  SELECT k, k::DOUBLE / 1048576 AS e, sum(pow(share, k::DOUBLE / 1048576)) AS z,
         sum(pow(share, k::DOUBLE / 1048576) * ln(share)) AS zl, max(pow(share, k::DOUBLE / 1048576) / share) AS top,
         max(n) AS n
  FROM range(0, 1048577) g(k), shares GROUP BY k
), chosen AS (
  SELECT CASE WHEN max(n) < 2 THEN 1.0 ELSE greatest(
           max(e) FILTER (WHERE (ln(z) - e * zl / z) / ln(n) >= 0.95),
           coalesce(min(e) FILTER (WHERE top / z <= 4.0), 1.0)) END AS e
  FROM tried
), budgets AS (
  SELECT source, tokens,
         round(round(pow(share, e) / sum(pow(share, e)) OVER (), 12) * sum(tokens) OVER ())::BIGINT AS budget
  FROM shares, chosen
), m AS (
  SELECT greatest(1, round(sum(budget) / 200000.0))::BIGINT AS blocks FROM budgets
), drawn AS (
  SELECT doc_id, source, n_tokens, tokens, budget,
         unnest(range(0, ((budget - 1) // tokens) + 1))::INTEGER AS epoch
  FROM rows JOIN budgets USING (source) WHERE n_tokens > 0 AND budget > 0
), placed AS (
  SELECT *, ('0x' || substr(md5('7:order:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS place
  FROM drawn
), summed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place, doc_id, n_tokens
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM placed
), fits AS (
  SELECT doc_id, source, n_tokens, epoch, floor(start::DOUBLE * blocks / budget)::BIGINT AS block,
         ('0x' || substr(md5('7:block:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS mixed
  FROM summed, m WHERE start + n_tokens <= budget
)
SELECT doc_id, source, n_tokens, epoch, block,
       row_number() OVER (PARTITION BY block ORDER BY mixed, doc_id, source, epoch, n_tokens) AS position
FROM fits
"""

_RESAMPLING_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS step
  FROM range(256) g(i)
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM texts
), features AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), counted AS (
  SELECT side, id, f, count(*) AS n FROM features GROUP BY side, id, f
), distinct_features AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
         lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM distinct_features, crc_table
), filled AS (
  SELECT side, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY side, bucket
), totals AS (
  SELECT coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::BIGINT AS s_all, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::BIGINT AS t_all FROM filled
), gains AS (
  SELECT d.bucket, floor(1000 * ln(((coalesce(b.n, 0) + 1)::DOUBLE * (s_all + 10000)) / ((d.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT * FROM filled WHERE side = 'd') d LEFT JOIN (SELECT * FROM filled WHERE side = 'b') b USING (bucket), totals
), weights AS (
  SELECT id, sum(c.n)::BIGINT AS n_features, sum(c.n * gain)::BIGINT AS total
  FROM counted c JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
         coalesce(CASE WHEN total % n_features < 0 THEN total // n_features - 1 ELSE total // n_features END, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM words w LEFT JOIN weights ON weights.id = w.id WHERE side = 'd'
), ranked AS (
  SELECT *, weight + noise AS score,
         CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) END AS place,
         count(*) FILTER (WHERE n_words >= 20) OVER () AS able
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * 25 // 100 THEN place END AS rank FROM ranked
"""

_RANKED_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents
), item_terms AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), corpus AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, sum(len(w))::BIGINT AS total FROM doc_words
), postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM doc_words)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus
), impacts AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS impact
  FROM postings JOIN weights USING (term), corpus
), scored AS (
  SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""

_DECONTAMINATION_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), item_words AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT n, win, item_id FROM (
    SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM sized)
), lengths AS (
  SELECT DISTINCT n FROM windows
), cells AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM doc_words, lengths
), met AS (
  SELECT doc_id, pos, c.n, item_id FROM cells c JOIN windows USING (n, win)
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM met) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op3_jaccard_join": _JACCARD_SQL,
    "op10_mixing": _MIXING_SQL,
    "op11_resampling": _RESAMPLING_SQL,
    "op12_ranked_search": _RANKED_SQL,
    "op13_decontamination": _DECONTAMINATION_SQL,
}
