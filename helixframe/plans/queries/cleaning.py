"""Cleaning and cutting of genome corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.config import QualityOptions, WindowOptions
from helixframe.operators import curation, dedup, windows
from helixframe.plans import views
from helixframe.plans.registry import query
from helixframe.plans.views import sql

_KMER = "substr(sequence, i, {k})"
_STRANDLESS = "least({kmer}, translate(reverse({kmer}), 'ACGT', 'TGCA'))"


def _kmer_sets(k: int) -> str:
    kmer = _STRANDLESS.format(kmer=_KMER.format(k=k))
    short = _STRANDLESS.format(kmer="sequence")
    return f"""SELECT doc_id, CASE WHEN length(sequence) >= {k}
                   THEN list_distinct(list_transform(range(1, length(sequence) - {k} + 2), lambda i: {kmer}))
                   WHEN length(sequence) > 0 THEN [{short}] ELSE [] END AS kmers FROM strands"""


@query(
    "near_dedup",
    sql(
        "SELECT s.doc_id, len(s.kmers)::BIGINT AS n_kmers, coalesce(g.group_id, s.doc_id) AS group_id FROM sets s LEFT JOIN named g USING (doc_id)",
        sets=_kmer_sets(21),
        cells="SELECT doc_id, len(kmers) AS n, unnest(kmers) AS kmer FROM sets",
        links="""SELECT a.doc_id AS a, b.doc_id AS b FROM cells a JOIN cells b ON a.kmer = b.kmer AND a.doc_id <> b.doc_id
                 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.85 * (a.n + b.n - count(*))""",
        named="""SELECT a AS doc_id, min(c) AS group_id FROM (
                     WITH RECURSIVE reach AS (SELECT DISTINCT a, a AS c FROM links UNION SELECT links.b, reach.c FROM reach JOIN links ON reach.a = links.a)
                     SELECT * FROM reach) GROUP BY a""",
    ),
)
def near_dedup(spark, folder):
    """Groups of chunks whose strand-neutral k-mer sets are alike; the SQL compares all pairs."""
    return dedup.near_duplicates(views.strands(spark, folder), "doc_id")


_WIDTH, _STRIDE, _LINE = 512, 200, 60


@query(
    "chunk_windows",
    sql(
        f"""SELECT doc_id, w AS "window", w * {_STRIDE} AS start, length(substr(sequence, w * {_STRIDE} + 1, {_WIDTH}))::INT AS sequence_length,
                   substr(sequence, w * {_STRIDE} + 1, {_WIDTH}) AS sequence
            FROM (SELECT doc_id, sequence, unnest(range(CASE WHEN length(sequence) = 0 THEN 0
                      ELSE greatest(0, ceil((length(sequence) - {_WIDTH}) / {_STRIDE}))::BIGINT + 1 END)) AS w FROM strands)"""
    ),
)
def chunk_windows(spark, folder):
    """Overlapping windows of sequences that come as lines of 60 letters; the last one of each may be shorter."""
    lines = windows.pieces(views.strands(spark, folder), "doc_id", "sequence", _LINE)
    return windows.cut_windows(lines, "doc_id", options=WindowOptions(_WIDTH, _STRIDE, windows_per_block=8))


@query(
    "full_windows",
    sql(
        f"""SELECT doc_id, count(*) AS n, sum(length(piece)) AS letters, md5(string_agg(piece, '' ORDER BY w)) AS digest
            FROM (SELECT doc_id, w, substr(sequence, w * {_WIDTH} + 1, {_WIDTH}) AS piece
                  FROM (SELECT doc_id, sequence, unnest(range(length(sequence) // {_WIDTH})) AS w FROM strands)) GROUP BY doc_id"""
    ),
)
def full_windows(spark, folder):
    """Consecutive full windows, the rest of each sequence left out."""
    whole = views.strands(spark, folder).select("doc_id", F.lit(0).alias("start"), "sequence")
    rows = windows.cut_windows(whole, "doc_id", options=WindowOptions(_WIDTH, _WIDTH, keep_rest=False, windows_per_block=4))
    text = F.expr("listagg(sequence, '') WITHIN GROUP (ORDER BY window)")
    joined = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("sequence_length").alias("letters"), text.alias("text"))
    return joined.select("doc_id", "n", "letters", F.md5("text").alias("digest"))


@query(
    "window_counts",
    sql(
        f"""SELECT doc_id, length(sequence)::BIGINT AS length,
                   CASE WHEN length(sequence) = 0 THEN 0 ELSE greatest(0, ceil((length(sequence) - {_WIDTH}) / {_STRIDE}))::BIGINT + 1 END AS n_windows
            FROM strands"""
    ),
)
def window_counts(spark, folder):
    return windows.window_counts(views.strands(spark, folder), "doc_id", options=WindowOptions(_WIDTH, _STRIDE))


_STATS = {
    "lines": """SELECT doc_id, text, list_transform(string_split(regexp_replace(text, '\\n\\z', ''), chr(10)), lambda x: length(x)) AS lines,
                       length(text) AS n, length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS plain,
                       len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS tokens FROM documents""",
    "stats": """SELECT doc_id, text, list_max(lines)::INT AS line_max, list_sum(lines) / len(lines) AS line_mean,
                       CASE WHEN n > 0 THEN plain / n ELSE 0 END AS alnum_fraction, CASE WHEN tokens > 0 THEN n / tokens END AS token_ratio FROM lines""",
}
_LIMITS = QualityOptions(line_mean=300, alnum_fraction=0.75, token_ratio=4.5)


@query(
    "line_stats",
    sql(
        "SELECT doc_id, line_max, round(line_mean, 6) AS line_mean, round(alnum_fraction, 6) AS alnum_fraction, round(token_ratio, 6) AS token_ratio FROM stats",
        **_STATS,
    ),
)
def line_stats(spark, folder):
    rows = curation.line_stats(views.table(spark, folder, "documents").select("doc_id", "text"), "text").drop("text")
    return views.rounded(rows, "line_mean", "alnum_fraction", "token_ratio")


@query(
    "quality_filter",
    sql(
        f"""SELECT doc_id, md5(text) AS digest FROM stats WHERE line_max <= {_LIMITS.line_max} AND line_mean <= {_LIMITS.line_mean}
            AND alnum_fraction >= {_LIMITS.alnum_fraction} AND coalesce(token_ratio, 99) >= {_LIMITS.token_ratio}""",
        **_STATS,
    ),
)
def quality_filter(spark, folder):
    """Texts within all limits; the limits are such that each rule drops some of these texts."""
    rows = curation.quality_filter(views.table(spark, folder, "documents").select("doc_id", "text"), "text", _LIMITS)
    return rows.select("doc_id", F.md5("text").alias("digest"))


_DROP = 0.7


@query(
    "drop_by_class",
    f"""SELECT doc_id FROM documents WHERE NOT (source = (SELECT min(source) FROM documents)
            AND {views.sql_uniform('drop:first source', 5, 'doc_id')} < {_DROP})
        AND NOT (n_chars < 500 AND {views.sql_uniform('drop:short', 5, 'doc_id')} < 0.25)""",
)
def drop_by_class(spark, folder):
    """Seven in ten rows of one source and a quarter of the short ones go, by seeded draws."""
    docs = views.table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    source = docs.agg(F.min("source")).head()[0]
    classes = {"first source": (F.col("source") == source, _DROP), "short": (F.col("n_chars") < 500, 0.25)}
    return curation.drop_by_class(docs, classes, ["doc_id"], 5).select("doc_id")


@query(
    "corpus_profile",
    sql(
        """SELECT lang, source, 2 - grouping(lang) - grouping(source) AS level, count(*) AS n_chunks, sum(length(sequence))::BIGINT AS n_letters,
                  count(DISTINCT doc_id // 4) AS n_genomes, true AS sketch_fits FROM strands GROUP BY ROLLUP (lang, source)"""
    ),
)
def corpus_profile(spark, folder):
    """Chunks, letters and genomes per language and source, per language and in all; four documents in turn are a genome."""
    rows = views.strands(spark, folder)
    found = curation.corpus_profile(rows, ["lang", "source"], F.expr("doc_id div 4"), F.char_length("sequence"))
    fits = F.abs(F.col("n_genomes_sketch") - F.col("n_genomes")) <= 0.05 * F.col("n_genomes")
    return found.withColumn("sketch_fits", fits).drop("n_genomes_sketch")
