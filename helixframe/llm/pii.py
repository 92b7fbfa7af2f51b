"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are what four fixed patterns find (emails, IP addresses, card and phone numbers) and, as a fifth kind, tokens
that look like secrets: long, of letters and digits. The words around
them are lexical patterns; patterns and the tokens they surround form a graph. In every round a pattern's
confidence is the confidence of its instances, averaged over all its occurrences, and an instance gets the
confidence of its best pattern. Tokens that look like identifiers and stand in high-confidence patterns
are found too, in every document. A token that looks like a secret is a span only where such a pattern stands by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.fingerprints import let
from helixframe.session import settle

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"  # a kind of its own, after the others

# The contract's patterns. Loops are possessive, which changes no match (what follows a loop never
# begins with what the loop takes) but keeps Java's matcher from recursing; a start inside a run that
# has failed from its first character is not tried again.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAYBE = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\."),
    "card": lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda text: text.contains("+"),
}
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_STEP = 128
_SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    support: int = 5  # different seeds a pattern must surround
    confidence: float = 0.8  # of a pattern that may find new instances
    smoothing: float = 1.0  # occurrences that count against every pattern
    secret: int = 20  # letters and digits of a token that looks like a secret, at least
    digits: int = 4  # a token without '@' needs so many digits to look like an identifier


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:  # i counts from the right
        x = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    parts = F.transform(F.sequence(F.lit(1), F.length(digits)), value)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    if kind == "ip":
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & F.when(F.length(_digits(match)).between(16, 19), _luhn(_digits(match)))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _before(sizes: Column) -> tuple[Column, Callable[[Column, Column], Column]]:
    """(offsets of stretches of 128 entries, sum of all entries before i given these)."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    stretches = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(sizes) / _STEP).cast("int")),
        lambda c: total(F.slice(sizes, c * _STEP + 1, F.lit(_STEP))),
    )
    offsets = lambda sums: F.transform(sums, lambda _, c: total(F.slice(sums, F.lit(1), c)))
    return let(stretches, offsets), lambda ahead, i: F.get(ahead, F.floor(i / _STEP).cast("int")) + total(
        F.slice(sizes, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP)
    )


def matches(text: Column, pattern: str) -> Column:
    """All matches in order: array of (start, end, match, gap before, gap after), in code points.

    ``pattern`` never matches nothing, so cutting the text at the matches leaves one gap more than matches.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def place(found: Column) -> Column:
        m, g = found["m"], found["g"]
        steps = F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda a, b: F.char_length(a) + F.char_length(b))

        def rows(sizes: Column) -> Column:
            stretches, before = _before(sizes)

            def row(ahead: Column) -> Column:
                def one(a: Column, i: Column) -> Column:
                    start = before(ahead, i) + F.char_length(F.get(g, i))
                    return F.struct(
                        start.cast("int").alias("start"),
                        (start + F.char_length(a)).cast("int").alias("end"),
                        a.alias("match"),
                        F.get(g, i).alias("left"),
                        F.get(g, i + 1).alias("right"),
                    )

                return F.transform(m, one)

            return let(stretches, row)

        return let(steps, rows)

    return let(both, place)


def _spans_of(kind: str, text: Column) -> Column:
    good = F.filter(matches(text, _PATTERN[kind]), lambda x: _valid(kind, x["match"]))
    spans = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.when(_MAYBE[kind](text), spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """The seeds: (kind, start, end) by kind as in ``KINDS``, then start; end is exclusive."""
    return F.concat(*[_spans_of(kind, text) for kind in KINDS])


def _words(gap: Column, last: bool, n: int) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(gap), r"\s+", " "))
    return F.substring_index(clean, " ", -n if last else n)


def _looks_like_secret(core: Column, s: Settings) -> Column:
    return core.rlike(rf"^[A-Za-z0-9_+/=-]{{{s.secret},}}$") & core.rlike("[A-Za-z]") & (F.length(_digits(core)) >= s.digits)


def occurrences(text: Column, spans: Column, s: Settings = Settings()) -> Column:
    """Tokens with a digit or '@': (kind of the seed that begins in it, value, start, end, patterns).

    Tokens that a seed begun earlier runs through are left out; the value of a seed is all of it. The patterns are the word before, the
    two words before and the word after.
    """

    def one(x: Column) -> Column:
        lead = F.char_length(F.regexp_extract(x["match"], r"^[^\p{L}\p{N}+@]*+", 0))
        core = F.regexp_replace(F.regexp_replace(x["match"], r"^[^\p{L}\p{N}+@]++", ""), r"[^\p{L}\p{N}]++$", "")
        start = x["start"] + lead
        end = start + F.char_length(core)
        touching = F.filter(spans, lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"]))
        first = F.get(touching, F.lit(0))
        inside = F.exists(touching, lambda s: s["start"] < x["start"])
        seed = F.lower(F.substring(text, first["start"] + 1, first["end"] - first["start"]))
        kind = F.coalesce(first["kind"], F.when(_looks_like_secret(core, s), SECRET))
        return F.struct(
            F.when(inside, "").otherwise(kind).alias("kind"),
            F.when(first.isNull(), F.lower(core)).otherwise(seed).alias("value"),
            start.alias("start"),
            end.alias("end"),
            F.array(
                F.concat(F.lit("1 "), _words(x["left"], True, 1)),
                F.concat(F.lit("2 "), _words(x["left"], True, 2)),
                F.concat(F.lit("+ "), _words(x["right"], False, 1)),
            ).alias("patterns"),
        )

    found = F.filter(F.transform(matches(text, _TOKEN), one), lambda x: ~x["kind"].eqNullSafe("") & (x["value"] != ""))
    return F.when(text.rlike("[0-9@]"), found)


def read_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, key, base, found) of every row, settled: its seeds, and its occurrences. Runs a job.

    ``key`` names a row by its id and text; NULL texts are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.lit("pii"), F.col(id_col), text).alias("key"))
    seeded = rows.select("id", "key", F.inline(F.array(F.struct("text", base_spans(F.col("text")).alias("base")))))
    return settle(seeded.select("id", "key", "base", occurrences(F.col("text"), F.col("base"), s).alias("found")))


def _looks_like_identifier(value: Column, s: Settings) -> Column:
    return value.contains("@") | (F.length(_digits(value)) >= s.digits)


def bootstrap(read: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(key, kind, start, end) of the tokens found by context alone. Runs jobs.

    Patterns keep their score per kind; only one of ``support`` different seeds and ``confidence`` may
    find. An instance that the fixed patterns know keeps its kind.
    """
    seen = read.dropDuplicates(["key"]).select("key", F.inline("found"))
    tokens = settle(seen.select("key", "kind", "value", "start", "end", "patterns"))
    edges = settle(
        tokens.select("value", "kind", F.explode("patterns").alias("pattern"))
        .where(F.length(F.trim(F.substring("pattern", 2, 1_000_000))) > 0)
        .groupBy("pattern", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("seed"))
    )
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    believed = edges.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    seeds = believed
    good = None
    for _ in range(s.rounds):
        held = edges.join(believed, "value")
        scores = held.groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("belief")).alias("held"), F.count(F.when(F.col("seed") == F.col("kind"), 1)).alias("support")
        )
        confidence = F.col("held") / (F.col("total") + s.smoothing)
        good = settle(
            scores.where(F.col("support") >= s.support)
            .join(totals, "pattern")
            .select("pattern", "kind", confidence.alias("confidence"))
            .where(F.col("confidence") >= s.confidence)
        )
        new = (
            edges.where(F.col("seed").isNull() & _looks_like_identifier(F.col("value"), s))
            .join(good, "pattern")
            .groupBy("value", "kind")
            .agg(F.max("confidence").alias("belief"))
        )
        believed = settle(seeds.unionByName(new))
    open_tokens = tokens.where((F.col("kind").isNull() & _looks_like_identifier(F.col("value"), s)) | (F.col("kind") == SECRET))
    placed = open_tokens.select("key", "start", "end", F.col("kind").alias("_own"), F.explode("patterns").alias("pattern")).join(good, "pattern")
    placed = placed.where(F.coalesce(F.col("_own") == F.col("kind"), F.lit(True)))
    return placed.groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")).select(
        "key", "kind", "start", "end"
    )


def _by_kind(spans: Column) -> Column:
    ranked = F.transform(
        spans, lambda x: F.struct(F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), x["kind"]).alias("r"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    )
    return F.transform(F.array_sort(ranked), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def spans_as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, key, base, spans) of every row: its seeds, and these with what context added. Runs jobs.

    Both are arrays of (kind, start, end) by kind, then start. Rows without spans have empty arrays.
    """
    read = read_documents(docs, id_col, text_col, settings)
    added = settle(bootstrap(read, settings))
    added = added.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))  # of one document
    joined = read.select("id", "key", "base").join(added, "key", "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(_by_kind(F.concat("base", "added")))
    return joined.select(F.col("id").alias(id_col), "key", "base", spans.alias("spans"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Counts of the seeds per kind, digest of the seeds, and all spans as text."""
    found = find(docs, id_col, text_col, settings)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        id_col,
        *[count(k) for k in KINDS],
        F.sha2(spans_as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans_as_text(F.col("spans")).alias("spans"),
    )


def masked_text(text: Column, spans: Column) -> Column:
    """``text`` with every stretch of overlapping spans replaced by the kind of its first one in brackets."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.aggregate(in_order, start, step, done)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with personal data in the text masked and, if there is one, n_chars brought up to date.

    All columns stay, NULL texts too. Runs jobs; the texts are read twice and not moved, unless
    context alone found more than a broadcast holds.
    """
    added = settle(bootstrap(read_documents(docs, id_col, text_col, settings), settings))
    added = added.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("_added"))
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.xxhash64(F.lit("pii"), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    spans = F.concat(base_spans(text), F.coalesce("_added", F.array().cast(_SPANS)))
    told = keyed.join(settle(added), "key", "left").select("_row", F.inline(F.array(F.struct(text.alias("_text"), spans.alias("_spans")))))
    masked = F.when(F.size("_spans") == 0, F.col("_text")).otherwise(masked_text(F.col("_text"), F.col("_spans")))
    told = told.withColumn("_masked", F.when(F.col("_row")[text_col].isNull(), F.lit(None)).otherwise(masked))
    columns = []
    for c in docs.columns:
        value = F.col("_row")[c]
        if c == text_col:
            value = F.col("_masked")
        elif c == "n_chars":
            value = F.when(F.size("_spans") == 0, value).otherwise(F.char_length("_masked").cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return told.select(*columns)
