"""Mixing sources to target weights by temperature, with DataFrame functions only.

Token shares of the sources are raised to an exponent and normalised. The exponent is found by
bisection: as close to 1 as the target entropy allows, but large enough that no source is repeated more often than
the limit. The weights are then realised as a sequence of blocks: every source is dealt
out in a fresh random permutation per epoch until its share of the token budget is spent, and every
block takes the same share of each source's sequence, in random order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.session import settle

BITS = 20  # the exponent is a multiple of 2^-20
_HALVINGS = 5  # per pass
_DIGITS = 12  # of a hash in hex
_SUPER = 1_024


@dataclass(frozen=True)
class Settings:
    entropy: float = 0.95  # wanted entropy of the weights, as a share of that of equal weights
    repetition: float = 4.0  # epochs of any source, at most
    budget: float = 1.0  # tokens to deal out, as a multiple of all tokens there are
    block_tokens: int = 200_000
    bucket_rows: int = 256  # rows of a stretch of a permutation that are added up together
    seed: int = 7


def n_tokens(text: Column) -> Column:
    """Words of a text: longest runs of bytes other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def draw(*parts: Column | str | int) -> Column:
    """A whole number below 16^12 from md5, the same in any engine."""
    text = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, (int, str)) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("bigint")


def _bisect(sources: DataFrame, low: int, high: int, holds: str, s: Settings) -> int:
    """The least k in (low, high] from which on ``holds`` is false or, failing that, high. 

    ``holds`` is a condition on H (entropy / log of the number of sources) and top (most epochs), true
    below some exponent k / 2^BITS and false above. Each pass over the sources tries 32 exponents.
    """
    while high - low > 1:
        step = max(1, (high - low) >> _HALVINGS)
        tries = list(range(low + step, high, step))
        power = F.pow("share", F.col("k") / float(1 << BITS))
        rows = sources.select("share", F.explode(F.array(*map(F.lit, tries))).alias("k")).groupBy("k").agg(
            F.sum(power).alias("z"),
            F.sum(power * F.ln("share")).alias("zl"),
            F.max(power / F.col("share")).alias("top"),
            F.count(F.lit(1)).alias("n"),
        )
        entropy = (F.ln("z") - F.col("k") / float(1 << BITS) * F.col("zl") / F.col("z")) / F.ln("n")
        told = rows.select("k", entropy.alias("H"), (F.col("top") / F.col("z") * s.budget).alias("top"))
        kept = [r["k"] for r in told.where(holds).collect()]
        low = max([low, *kept])
        high = min(high, low + step)
    return high


def exponent(sources: DataFrame, s: Settings) -> float:
    """The exponent for sources (source, tokens, share) with tokens. Runs a few small jobs."""
    one = 1 << BITS
    if sources.count() < 2:
        return 1.0
    # H falls and top rises as the exponent grows from 0 to 1 and back: bisect each, the limit wins
    flat_enough = _bisect(sources, 0, one + 1, f"H >= {s.entropy!r}", s) - 1
    repeated = _bisect(sources, -1, one, f"top > {s.repetition!r}", s)
    return max(flat_enough, repeated) / one


def source_budgets(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(source, docs, tokens, weight, budget) of ``docs`` (source, tokens), settled. Runs jobs.

    A NULL source is the source ''. Sources without tokens have no row. If the whole budget cannot be met inside the repetition limit,
    the budget shrinks to it.
    """
    named = docs.withColumn("source", F.coalesce("source", F.lit("")))
    sources = named.where("tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    whole = Window.partitionBy()
    sources = settle(sources.withColumn("share", F.col("tokens") / F.sum("tokens").over(whole)))
    power = F.pow("share", F.lit(exponent(sources, s)))
    weight = F.round(power / F.sum(power).over(whole), 12)
    total = F.floor(F.sum("tokens").over(whole) * min(s.budget, s.repetition)).cast("bigint")
    weighed = sources.select("source", "docs", "tokens", weight.alias("weight"), total.alias("total"))
    return settle(weighed.withColumn("budget", F.round(F.col("weight") * F.col("total")).cast("bigint")))


def running_tokens(rows: DataFrame) -> DataFrame:
    """``rows`` with ``before``: tokens of the same (source, epoch) that come earlier in its permutation.

    A permutation is cut into buckets by hash, buckets into groups; windows only ever see one bucket, one group's
    buckets, or the groups of one permutation, so a source with a third of all rows is spread out too.
    """
    keys = ["source", "epoch"]
    inside = Window.partitionBy(*keys, "bucket").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    past = (Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "bucket").agg(F.sum("tokens").alias("n")).withColumn("group", F.floor(F.col("bucket") / _SUPER))
    in_group = Window.partitionBy(*keys, "group").orderBy("bucket").rowsBetween(*past)
    groups = sums.groupBy(*keys, "group").agg(F.sum("n").alias("n"))
    groups = groups.select(*keys, "group", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("group").rowsBetween(*past)), F.lit(0)).alias("ahead"))
    offsets = (
        sums.withColumn("near", F.coalesce(F.sum("n").over(in_group), F.lit(0)))
        .join(groups, [*keys, "group"])
        .select(*keys, "bucket", (F.col("ahead") + F.col("near")).alias("offset"))
    )
    local = rows.withColumn("local", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return local.join(settle(offsets), [*keys, "bucket"]).withColumn("before", F.col("offset") + F.col("local")).drop("offset", "local")


def mix(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, source, tokens, epoch, block, position) of every draw, from rows (doc_id, source, tokens).

    A NULL source is the source ''. Rows without tokens are never drawn; of the last, unfinished
    epoch the documents that still fit the source's budget are. Any further columns of ``rows`` ride
    along. Runs jobs.
    """
    rows = settle(rows.withColumn("source", F.coalesce("source", F.lit(""))))  # texts are read once
    budgets = source_budgets(rows.select("source", "tokens"), s)
    total = budgets.agg(F.sum("budget")).first()[0] or 0
    blocks = max(1, round(total / s.block_tokens))
    last = F.floor((F.col("budget") - 1) / F.col("all_tokens")).cast("int")
    drawn = (
        rows.where("tokens > 0")
        .join(budgets.select("source", "docs", F.col("tokens").alias("all_tokens"), "budget"), "source")
        .where("budget > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("place", draw(s.seed, "order", F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    )
    n_buckets = F.ceil(F.col("docs") / s.bucket_rows)
    bucket = F.floor(F.col("place") * n_buckets / float(16**_DIGITS)).cast("bigint")
    placed = running_tokens(drawn.withColumn("bucket", bucket))
    at = F.col("epoch") * F.col("all_tokens") + F.col("before")
    block = F.floor(at.cast("double") * blocks / F.col("budget")).cast("bigint")
    fits = placed.where(at + F.col("tokens") <= F.col("budget")).withColumn("block", block)
    mixed = draw(s.seed, "block", F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    order = Window.partitionBy("block").orderBy(mixed, "doc_id", "source", "epoch", "tokens")
    return fits.withColumn("position", F.row_number().over(order).cast("bigint")).drop(
        "docs", "all_tokens", "budget", "place", "bucket", "before"
    )


def mix_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents in mixed order, repeated or left out as the weights say, with all their columns.

    Draws are worked out on ids and token counts; the texts move once to meet them and once into
    order. Rows that repeat an id are told apart by their texts.
    """
    same = Window.partitionBy("doc_id").orderBy("_text", "tokens")
    copy = F.row_number().over(same)
    light = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("tokens"), F.xxhash64("text").alias("_text"))
    draws = mix(light.withColumn("copy", copy).drop("_text"), s).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "block", "position")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    full = docs.select(row, F.col("doc_id"), F.xxhash64("text").alias("_text"), n_tokens(F.col("text")).alias("tokens"))
    full = full.withColumn("copy", copy)
    # the copy is compared after the join, so that rows are dealt out by id alone, as for the window
    met = full.join(draws, full["doc_id"].eqNullSafe(draws["_id"]) & (full["copy"] - draws["_copy"] == 0))
    return met.orderBy("block", "position").select("_row.*")
