"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document is its words weighted by how often they occur. For sample j a word's hash gives r and c from
Gamma(2, 1) and beta from [0, 1). With weight w, t = floor(ln w / r + beta) and a = c exp(-r (t - beta + 1));
the word of least a, together with its t, is the sample. Two documents share a sample with a
probability that equals their generalised Jaccard similarity, the sum of the smaller weights over the sum of the larger.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.session import settle

SAMPLES = 32
TAG_BITS = 24
_WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unit(bits: Column, shift: int) -> Column:
    """A number inside (0, 1) from 21 bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)


def gamma_sample(j: int, term: Column, log_weight: Column) -> Column:
    """One whole number per word: ln a in the high bits, a tag of (word, t) in the low ones.

    The least of them over a document's words is its j-th sample.
    """
    first, second = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
    r = -F.ln(_unit(first, 0) * _unit(first, 21))
    beta = _unit(first, 42)
    c = -F.ln(_unit(second, 0) * _unit(second, 21))
    t = F.floor(log_weight / r + beta)
    log_a = F.ln(c) - r * (t - beta + F.lit(1.0))
    scaled = ((F.greatest(log_a, F.lit(-63.0)) + F.lit(64.0)) * F.lit(2.0**31)).cast("bigint")
    tag = term.bitwiseXOR(t).bitwiseAND(F.lit((1 << TAG_BITS) - 1))
    return F.shiftleft(scaled, TAG_BITS).bitwiseOR(tag)


def with_fingerprints(texts: DataFrame, keys: Sequence[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint): per row, named by its keys, the array of its sample tags; NULLs for no words.

    Words are counted inside the row and the samples are plain minima, so a table that is already
    dealt out by some of the keys is not moved again.
    """
    hashes = F.sort_array(F.transform(F.split(F.col(text_col), _WHITE), lambda w: F.when(w != "", F.xxhash64(w))))
    hashes = F.array_compact(hashes)
    runs = lambda h: F.array_compact(F.transform(h, lambda x, i: F.when((i == 0) | (x != F.get(h, i - 1)), i)))
    both = let(hashes, lambda h: F.struct(h.alias("h"), runs(h).alias("at")))
    counted = texts.select(*keys, F.inline(F.array(both)))
    terms = counted.select(*keys, "h", "at", F.posexplode_outer("at").alias("place", "start"))
    weight = F.coalesce(F.get("at", F.col("place") + 1), F.size("h")) - F.col("start")
    terms = terms.select(*keys, F.get("h", F.col("start")).alias("_term"), F.ln(weight.cast("double")).alias("_log_weight"))
    least = [F.min(gamma_sample(j, F.col("_term"), F.col("_log_weight"))).alias(f"_s{j}") for j in range(samples)]
    mask = F.lit((1 << TAG_BITS) - 1)
    tags = F.array(*[F.col(f"_s{j}").bitwiseAND(mask) for j in range(samples)])
    return terms.groupBy(*keys).agg(*least).select(*keys, tags.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two documents without words are alike."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.size(a)


def as_text(fingerprint: Column) -> Column:
    width = TAG_BITS // 4
    return F.array_join(F.transform(fingerprint, lambda x: F.coalesce(F.lpad(F.hex(x), width, "0"), F.lit("-" * width))), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint) of every row; rows that repeat id and text give one row. NULL texts are empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("_text", F.xxhash64("text"))
    return with_fingerprints(keyed, ["id", "_text"], "text", samples).select(F.col("id").alias(id_col), "fingerprint")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``value``, by a coarse and a fine look at the sorted bounds."""
    step = max(1, round(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b).cast("bigint") for b in bounds[::step]])
    fine = F.array(*[F.array(*[F.lit(b).cast("bigint") for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    group = F.size(F.filter(coarse, lambda b: b <= value))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(group, F.lit(1))), lambda b: b <= value))
    return F.when(value.isNull() | (group == 0), 0).otherwise((group - 1) * step + inside)


def with_next(docs: DataFrame, id_col: str, text_col: str, per_partition: int = 8) -> DataFrame:
    """(block, guest, row, id, text, next_text): each row with the next text in ascending id order.

    After the last row comes the first; NULL ids come first, equal ids in the order of their texts. Rows
    are dealt out by id ranges of near-equal size, and the first rows of a range visit the one before as
    ``guest`` rows, so that a window inside a range suffices and the texts move once. Runs jobs: the
    range bounds, some per shuffle partition, are fetched, and one row per range is settled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("id", F.array(*map(F.lit, shares)), F.lit(20 * n))).first()[0]
    bounds = sorted(set(found or []))
    blocked = rows.withColumn("block", _range_of(F.col("id"), bounds) if bounds else F.lit(0))
    order = Window.orderBy("block")
    firsts = blocked.groupBy("block").agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("null_first"))
    last = F.max("block").over(Window.partitionBy())
    firsts = firsts.select(
        "block", F.when(~F.col("null_first"), F.col("first")).alias("first"), F.coalesce(F.lag("block").over(order), last).alias("before")
    )
    firsts = settle(firsts)
    stay = lambda block, guest: F.struct(F.col(block).alias("block"), F.lit(guest).alias("guest"))
    visits = F.when(
        F.col("id").eqNullSafe(F.col("first")), F.array(stay("block", False), stay("before", True))
    ).otherwise(F.array(stay("block", False)))
    placed = blocked.join(firsts, "block").select("id", "text", F.inline(visits))
    along = Window.partitionBy("block").orderBy("guest", F.col("id").asc_nulls_first(), "text")
    return placed.select(
        "block", "guest", F.row_number().over(along).alias("row"), "id", "text", F.lead("text").over(along).alias("next_text")
    )


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next text are.

    The edited form has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in ascending id order, the first document following the last.
    """
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    rows = with_next(docs, id_col, text_col).select("block", "guest", "row", "id", "text", F.when(~F.col("guest"), edited).alias("edited"))
    # the keys travel with every word: digests and lengths are taken before, texts are dropped after
    rows = rows.select(
        "block", "guest", "row", "id", F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("text"), F.col("edited"),
    )
    either = F.array(*[F.struct(F.lit(i).alias("form"), F.col(c).alias("words")) for i, c in enumerate(("text", "edited"))])
    forms = rows.select("block", "guest", "row", "id", "n_chars", "edited_sha256", F.inline(either)).where("form = 0 or not guest")
    keys = ["block", "guest", "row", "id", "n_chars", "edited_sha256", "form"]
    prints = with_fingerprints(forms, keys, "words", samples)
    along = Window.partitionBy("block").orderBy("guest", "row", "form")
    found = prints.select(
        "*", F.lead("fingerprint", 1).over(along).alias("edited"), F.lead("fingerprint", 2).over(along).alias("next")
    ).where("form = 0 and not guest")
    return found.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
