"""Row filters of a corpus and its profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.config import QualityOptions
from helixframe.functions.hashing import digest, unit_below

# line and character statistics ------------------------------------------------------------------


def line_stats(df: DataFrame, text: str, n_tokens: Column | None = None) -> DataFrame:
    """Add ``line_max``, ``line_mean``, ``alnum_fraction`` and ``token_ratio`` of a text; all in one pass of column functions.

    Lines end with a line feed, one at the very end adds no empty line. Letters and digits of any script count as
    alphanumeric. ``token_ratio`` is characters per token, tokens being ``n_tokens`` or else what white space
    divides. An empty text has one empty line, fraction 0 and no ratio (NULL); a NULL text has NULLs.
    """
    value = F.col(text)
    lines = F.transform(F.split(F.regexp_replace(value, r"\n\z", ""), "\n"), lambda line: F.char_length(line))
    n_chars = F.char_length(value)
    plain = F.char_length(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))
    tokens = F.size(F.array_remove(F.split(value, r"\s+"), "")) if n_tokens is None else n_tokens
    return (
        df.withColumn("_lines", lines)
        .withColumns(
            {
                "line_max": F.array_max("_lines"),
                "line_mean": F.aggregate("_lines", F.lit(0).cast("bigint"), lambda a, n: a + n) / F.size("_lines"),
                "alnum_fraction": F.when(value.isNotNull(), F.when(n_chars > 0, plain / n_chars).otherwise(0.0)),
                "token_ratio": F.when(tokens > 0, n_chars / tokens),
            }
        )
        .drop("_lines")
    )


def quality_verdict(options: QualityOptions = QualityOptions()) -> Column:
    """Why a row with ``line_stats`` goes: the first rule it breaks, NULL if it stays. NULL statistics break their rule, except no ratio."""
    broken = lambda fits: ~F.coalesce(fits, F.lit(False))
    return (
        F.when(broken(F.col("line_max") <= options.line_max), "line_max")
        .when(broken(F.col("line_mean") <= options.line_mean), "line_mean")
        .when(broken(F.col("alnum_fraction") >= options.alnum_fraction), "alnum_fraction")
        .when(F.col("token_ratio") < options.token_ratio, "token_ratio")
    )


def quality_filter(df: DataFrame, text: str, options: QualityOptions = QualityOptions(), n_tokens: Column | None = None) -> DataFrame:
    """The rows whose text breaks no rule."""
    return line_stats(df, text, n_tokens).where(quality_verdict(options).isNull()).select(*[F.col(f"`{c}`") for c in df.columns])


# rows dropped by chance -------------------------------------------------------------------------


def drop_by_class(df: DataFrame, classes: Mapping[str, tuple[Column, float]], keys: Sequence[str | Column], seed: int) -> DataFrame:
    """Rows that survive the draws of the classes they belong to.

    Each entry gives a class's condition and the probability that a row of it goes. A row of several classes
    has a draw in each; one in none stays, and a NULL condition counts as none. Draws come from md5 of seed,
    class and keys, so they do not depend on how the rows lie; rows that repeat the keys stay or go together, and a
    NULL key counts as an empty one.
    """
    names = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    goes = F.lit(False)
    for name, (member, probability) in classes.items():
        goes = goes | (F.coalesce(member, F.lit(False)) & unit_below(digest(f"drop:{name}", seed, *names), probability))
    return df.where(~goes)


# profile ----------------------------------------------------------------------------------------


def corpus_profile(df: DataFrame, by: Sequence[str], genome: Column, letters: Column, sketch_bits: int = 14) -> DataFrame:
    """Chunks, letters and genomes for every level of ``by`` from the whole corpus down: rolled-up columns are NULL, ``level`` counts those left.

    Genomes are counted twice: exactly, which moves each distinct (group, genome) once, and by a sketch that is built
    per finest group and merged for the levels above, which moves some kilobytes a group. Chunks without a genome
    count as chunks only; a NULL group is a group of its own.
    """
    rows = df.select(*by, genome.alias("_genome"), letters.alias("_letters"))
    finest = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_letters").alias("_sum"),
        F.hll_sketch_agg(F.when(F.col("_genome").isNotNull(), F.xxhash64("_genome")), F.lit(sketch_bits)).alias("_sketch"),
    )
    kept = F.lit(len(by))
    for c in by:
        kept = kept - F.grouping(c)
    counted = finest.rollup(*by).agg(
        kept.alias("level"), F.sum("_n").alias("n_chunks"), F.sum("_sum").cast("bigint").alias("n_letters"),
        F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias("n_genomes_sketch"),
    )
    distinct = rows.where("_genome is not null").select(*by, "_genome").distinct()
    exact = None
    for level in range(len(by) + 1):
        group = list(by[:level])
        here = distinct.select(*group, "_genome").distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n_genomes"))
        here = here.select(*group, *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in by[level:]], F.lit(level).alias("level"), "n_genomes")
        exact = here if exact is None else exact.unionByName(here)
    names = exact.withColumnsRenamed({c: f"_{c}" for c in [*by, "level"]})
    same = F.col("level") == F.col("_level")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = counted.join(names, same, "left")
    return out.select(*by, "level", "n_chunks", "n_letters", F.coalesce("n_genomes", F.lit(0)).alias("n_genomes"), "n_genomes_sketch")
