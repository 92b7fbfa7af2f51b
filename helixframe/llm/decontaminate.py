"""Benchmark decontamination by winnowing, in column functions alone.

Texts are words; every five neighbouring words have a hash, and of each six neighbouring hashes the least is kept.
Ten shared words hold six such hashes, so documents and benchmark items that share ten words keep the same hash of
the same place among them: the kept hashes find every shared span, and two texts meet only where they keep a common one.
From there a hit is extended word by word, at most five to either side, which is as far as a window
that holds the place can reach; ten words or more in a row are hit.

Before documents unfold into rows, kept hashes are looked up in a bit table of those of the items, so that only
places that may be hits move. Items of fewer than ten words are one window each, looked up by the hash of the whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import settle

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    window: int = 10  # words of the shortest shared span that counts
    gram: int = 5  # words of a hash
    bits_per_hash: int = 64  # of the bit table: about one place in 64 passes by chance
    most_bits: int = 1 << 26  # its largest size; beyond some 10^6 hashes more pass by chance, none is lost

    @property
    def around(self) -> int:
        """Hashes of a window, less the one itself: how far a window reaches beyond the hash it keeps."""
        return self.window - self.gram


def words_of(text: Column) -> Column:
    """The lower-cased words (A-Z only); none for NULL."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _SEPARATOR), "")


def _part(words: Column, start: Column, length: Column | int) -> Column:
    """Words from a place on that counts from 0; what lies outside the text is left out."""
    length = F.lit(length) if isinstance(length, int) else length
    low = F.greatest(start, F.lit(0))
    return F.slice(words, low + 1, F.greatest(start + length - low, F.lit(0)))


def _kept(texts: DataFrame, needs: list[int], wanted: dict, s: Settings, start: int) -> DataFrame:
    """The places whose hashes ``wanted[need]`` lets through: the columns of ``texts``, n_words, hash, need, at, left, middle, right.

    ``needs`` are the lengths of windows to look for: the full one is winnowed, shorter ones are looked up at
    every place. Windows start at ``start`` or later; one at -1, if asked for, is a row without a hash.

    The words unfold inside one generated loop, which reads neighbours from the arrays that all rows of a text
    share and passes on only what a window that was let through can reach.
    """
    i, size, reach, wide = F.col("i"), F.size("words"), s.around, s.around + 1
    shifted = [F.slice("words", F.lit(k + 1), F.greatest(size - k, F.lit(0))) for k in range(s.gram)]
    grams = F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(x))  # those of the last words are not whole
    rows = texts.withColumn("words", words_of(F.col("text"))).drop("text").withColumn("grams", grams)
    last = size - (1 if any(n < s.window for n in needs) else s.window)
    rows = rows.select("*", F.explode(F.sequence(F.lit(start), F.greatest(last, F.lit(start)))).alias("i"))

    def whole(need: int, n: Column) -> Column:
        return (i >= 0) & (i + need <= n)

    def short(need: int, words: Column, at: Column) -> Column:
        return F.xxhash64(F.lit(need), *[F.get(words, at + k) for k in range(need)])

    passed = i < 0
    for need in needs:
        grams_here = [F.get(F.col("grams"), i + k) for k in range(wide)]
        least = F.least(*grams_here) if wide > 1 else grams_here[0]
        test = wanted[need](least if need == s.window else short(need, F.col("words"), i))
        passed = passed | F.coalesce(whole(need, size) & test, F.lit(False))
    rows = rows.where(passed).select(
        *[c for c in texts.columns if c != "text"], size.alias("n_words"), "i",
        _part(F.col("grams"), i - 1, wide + 1).alias("own"), _part(F.col("words"), i - reach, s.window + 2 * reach).alias("near"),
    )
    here, near, own = F.least(i, F.lit(reach)), F.col("near"), F.col("own")  # where ``near`` has the window's first word

    def place(k: Column, n: int, need: int, around: int, hash_: Column) -> Column:
        at = here + k
        return F.struct(
            hash_.alias("hash"), F.lit(need).alias("need"), (i + k).alias("at"), F.reverse(_part(near, at - around, around)).alias("left"),
            _part(near, at, n).alias("middle"), _part(near, at + n, around).alias("right"),
        )

    found = [F.array(F.when(i < 0, place(F.lit(0), 0, 0, 0, F.lit(None).cast("bigint"))))]
    for need in needs:
        if need < s.window:
            hash_ = short(need, near, here)
            found.append(F.array(F.when(whole(need, F.col("n_words")) & wanted[need](hash_), place(F.lit(0), need, need, 0, hash_))))
            continue
        mine = F.slice(own, F.least(i, F.lit(1)) + 1, F.lit(wide))
        least = F.array_min(mine)
        # a place is passed on by the first window that keeps it: if the one before kept it too, only its newcomer is left
        again = (i > 0) & (F.array_min(F.slice(own, F.lit(1), F.lit(wide))) == least)
        spots = F.filter(F.sequence(F.lit(0), F.lit(reach)), lambda k: (F.get(mine, k) == least) & (~again | (k == reach)))
        test = whole(need, F.col("n_words")) & wanted[need](least)
        found.append(F.when(test, F.transform(spots, lambda k: place(k, s.gram, need, reach, least))).otherwise(F.array()))
    rows = rows.withColumn("place", F.explode(F.concat(*found))).where("place is not null")
    return rows.select(*[c for c in texts.columns if c != "text"], F.col("n_words").cast("bigint").alias("n_words"), "place.*")


def item_places(items: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(hash, need, left, middle, right, items): the places of the benchmark, those that look alike as one row. Settled.

    ``need`` is how many words in a row count as a hit: the window, or all words of a shorter item. Runs jobs.
    """
    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    sized = texts.withColumn("_n", F.size(words_of(F.col("text"))))
    lengths = sorted(r[0] for r in sized.select(F.least("_n", F.lit(s.window)).alias("n")).distinct().collect() if r[0])
    every = {n: lambda h: h.isNotNull() for n in {*lengths, s.window}}
    kinds = [_kept(sized.where(F.col("_n") >= s.window), [s.window], every, s, 0)]
    kinds += [_kept(sized.where(F.col("_n") == n), [n], every, s, 0) for n in lengths if n < s.window]
    found = kinds[0]
    for more in kinds[1:]:
        found = found.unionByName(more)
    return settle(found.groupBy("hash", "need", "left", "middle", "right").agg(F.collect_set("item").alias("items")))


class _BitTable:
    """Bits of the hashes of some places, as one literal array that column functions read."""

    def __init__(self, places: DataFrame, s: Settings):
        n = places.select("hash").distinct().count()
        bits = 64
        while bits < min(s.bits_per_hash * n, s.most_bits):
            bits *= 2
        self.mask = bits - 1
        spot = F.col("hash").bitwiseAND(F.lit(self.mask))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(63)).cast("int"))
        words = places.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        table = [0] * (bits // 64)
        for row in words.collect():  # at most most_bits / 64 rows
            table[row["word"]] = row["bits"]
        self.table = F.from_json(F.lit(json.dumps(table)), "array<bigint>")  # folded into one literal

    def __call__(self, hash_: Column) -> Column:
        spot = hash_.bitwiseAND(F.lit(self.mask))
        word = F.get(self.table, F.shiftright(spot, 6).cast("int"))
        return F.getbit(word, spot.bitwiseAND(F.lit(63)).cast("int")) == 1


def document_places(docs: DataFrame, places: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, text_hash, n_words, hash, need, at, left, middle, right): the places that may be hits. Settled.

    Every document also has a row with ``at`` -1 and no hash, so its texts are read once.
    """
    needs = sorted(r[0] for r in places.select("need").distinct().collect())  # at most ``window`` numbers
    wanted = {n: _BitTable(places.where(F.col("need") == n), s) for n in needs}
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return settle(_kept(texts, needs, wanted, s, -1))


def _alike(a: Column, b: Column) -> Column:
    """How many words from the start on are the same in both."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def hits(found: DataFrame, places: DataFrame) -> DataFrame:
    """(id, text_hash, n_hit, items) of the documents with hits: words inside any of them, and the ids of their items."""
    mine = found.where("at >= 0").drop("n_words").withColumnsRenamed({"left": "my_left", "right": "my_right"})
    met = mine.join(places, ["hash", "need", "middle"])
    grown = met.select(
        "id", "text_hash", "items", "at", "need", F.size("middle").alias("n"),
        _alike(F.col("my_left"), F.col("left")).alias("before"), _alike(F.col("my_right"), F.col("right")).alias("after"),
    ).where("before + n + after >= need")
    spans = F.collect_set(F.struct((F.col("at") - F.col("before")).alias("low"), (F.col("at") + F.col("n") + F.col("after")).alias("high")))
    by_text = grown.groupBy("id", "text_hash").agg(
        F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    add = lambda a, x: F.struct(
        F.greatest(a["end"], x["high"]).alias("end"), (a["n"] + F.greatest(x["high"] - F.greatest(a["end"], x["low"]), F.lit(0))).alias("n")
    )
    return by_text.select("id", "text_hash", F.aggregate("spans", start, add)["n"].alias("n_hit"), "items")


def report(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", settings: Settings = Settings()
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row of ``docs``; ``items`` are sorted ids. Runs jobs.

    NULL and wordless texts have no words and no hits, wordless items no windows. Rows that repeat an id are
    told apart by a hash of their texts, equal rows get equal results, and so do rows without an id. Items that share an id
    count once, those without one together as an empty id. Empty tables: no rows, or no hits.
    """
    places = item_places(items, item_col, text_col, settings)
    found = document_places(docs, places, id_col, text_col, settings)
    hit = hits(found, places).withColumnsRenamed({"id": "_id", "text_hash": "_text"})
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_text"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("bigint"), F.coalesce("items", F.array().cast("array<string>"))
    return found.where("at < 0").select("id", "text_hash", "n_words").join(hit, same, "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        ids.alias("items"), (n_hit > 0).alias("contaminated"),
    )


def digests(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``report`` with the sorted item ids as one SHA-256 of them, comma-joined."""
    rows = report(docs, items, settings=settings)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns; rows without an id are judged by their texts too."""
    places = item_places(items, "item_id", "text", settings)
    hit = hits(document_places(docs, places, id_col, text_col, settings), places)
    leaking = settle(hit.select(F.col("id").alias("_id"), F.col("text_hash").alias("_text")).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_hash"))
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    return rows.join(leaking, same, "left_anti").select("_row.*")
