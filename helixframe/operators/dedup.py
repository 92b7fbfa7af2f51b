"""Near duplicates among genome chunks: banded MinHash over strand-neutral k-mers, verified exactly.

A chunk is the set of its k-mers, each taken as one with its reverse complement, so a chunk and its other
strand are equal. Sets that are alike in ``threshold`` fall into a common bucket of some band almost surely: with 5
rows and 16 bands, 99.99% of those at 0.85. Candidates are compared by their exact sets, read from the
sequences again, so nothing but true links is reported.

Large groups of copies do not unfold into their pairs. Equal sets are one vertex; every set is first compared with the
leader it shares most buckets with, for some rounds; then only buckets that still hold several components count, and hot
ones among them are split by size. Sets that merely share a passage meet in many buckets, in number as the square of those that
share it: before a pair is joined to its sequences, sizes and profiles of some hundred bytes rule out what cannot be alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.config import NearDuplicateOptions
from helixframe.functions import fixed
from helixframe.operators.graph import connected_components
from helixframe.session import release, settle


def _kmer_reader(k: int):
    """A function from sequences to groups of them, (indices, codes of their k-mers in one array, number of each), and one that sorts each one's codes and drops repeats.

    Built from locals only, so they travel to the Python workers by value. A code is base 4 in the order of the nucleotides,
    the smaller one of both strands, below the length. Letters other than nucleotides break k-mers; a shorter
    sequence is one k-mer of its own length. A group is worked on as one text, of some 64,000 letters or one sequence. Words are
    doubled, 1 letter, 2, 4 and so on, in the smallest type that holds them.
    """
    letters = fixed.NUCLEOTIDES.encode()
    table = bytes(letters.index(i) if i in letters else 4 for i in range(256))

    def per_text(marked: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(marked)])[ends], prepend=0)

    def codes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([len(x) for x in texts])
        coded = b"".join(texts).translate(table)
        bases = np.frombuffer(coded, dtype=np.uint8)
        forward, backward, done = np.zeros(len(bases), dtype=np.uint64), np.zeros(len(bases), dtype=np.uint64), 0
        word, other, width = bases & 3, 3 - (bases & 3), 1
        while True:
            if size & width:  # these letters follow those that are done
                n = len(bases) - done - width + 1
                forward = (forward[:n] << np.uint64(2 * width)) | word[done : done + n]
                backward = backward[:n] | (other[done : done + n].astype(np.uint64) << np.uint64(2 * done))
                done += width
            if done == size:
                break
            wide, n = np.dtype(f"u{max(1, width // 2)}").type, len(word) - width
            word, other = word.astype(wide), other.astype(wide)
            word, other = (word[:n] << wide(2 * width)) | word[width:], other[:n] | (other[width:] << wide(2 * width))
            width *= 2
        whole = np.ones(len(bases), dtype=bool)
        whole[(ends[:, None] - np.arange(1, size)).ravel()] = False
        if b"\x04" in coded:
            broken = np.concatenate([[0], np.cumsum(bases == 4)])
            whole[: len(forward)] &= broken[size:] == broken[:-size]
        return np.minimum(forward, backward)[whole[: len(forward)]] | np.uint64(size << 58), per_text(whole, ends)

    def read(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        groups: dict[int, tuple[list[int], int]] = {}
        for i, text in enumerate(texts):
            if size := min(k, len(text)):
                group, held = groups.get(size, ([], 0))
                if group and (held + len(text) > 1 << 16 or len(group) == 256):
                    yield group, *codes([texts[j] for j in group], size)
                    group, held = [], 0
                groups[size] = [*group, i], held + len(text)
        for size, (group, _) in groups.items():
            yield group, *codes([texts[j] for j in group], size)

    def distinct(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(counts)
        for start, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            found[start:end].sort()
        new = np.ones(len(found), dtype=bool)
        new[1:] = found[1:] != found[:-1]
        new[(ends - counts)[counts > 0]] = True
        return found[new], per_text(new, ends)

    return read, distinct


def _mixer():
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    return mix


_FINE = 16  # cells of a profile to a value of the sketch


def sketches(df: DataFrame, key: str, sequence: str, options: NearDuplicateOptions = NearDuplicateOptions()) -> DataFrame:
    """(key, text_hash, set, n, bands, profile): a hash of the k-mer set, its size, a bucket for each band and the profile (none for an empty set).

    All values of a sketch come from one pass: hashes are dealt into as many cells, and a value is the least hash
    in its cell. A cell without hashes takes the value of another, the first that has one in an order of its own. Two sets agree in a
    value with the probability of their Jaccard similarity, as with a hash function for each value.

    The profile has sixteen times the cells: a bit for each that holds a hash, then a bit of the least one in it.
    """
    (read, distinct), mix, bands, rows = _kmer_reader(options.k), _mixer(), options.bands, options.rows
    values, fine, start, up = bands * rows, bands * rows * _FINE, np.uint64(options.seed << 32), np.uint64(32)
    n_bytes, per_value = -(-fine // 64) * 8, _FINE
    factors = mix(np.arange(1, fine + 1, dtype=np.uint64) + start) | np.uint64(1)
    order = np.argsort(mix(np.arange(1, values * values + 1, dtype=np.uint64) + start).reshape(values, values), axis=1)

    def sketch(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.repeat(np.arange(len(counts)), counts)
        cell = text * fine + ((own >> up) * np.uint64(fine) >> up).astype(np.int64)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        at, found = cell[first], own[first]
        bits = np.zeros((2, len(counts), n_bytes * 8), dtype=np.uint8)
        bits[0, at // fine, at % fine] = 1
        bits[1, at // fine, at % fine] = found * factors[at % fine] >> np.uint64(63)
        first = np.flatnonzero(np.diff(value := at // per_value, prepend=-1))
        least, full = np.zeros((len(counts), values), dtype=np.uint64), np.zeros((len(counts), values), dtype=bool)
        least.ravel()[value[first]], full.ravel()[value[first]] = found[first], True
        for i in np.flatnonzero(~full.all(axis=1) & full.any(axis=1)):
            bare = np.flatnonzero(~full[i])
            least[i, bare] = least[i, order[bare, full[i, order[bare]].argmax(axis=1)]]
        buckets = np.tile(np.arange(bands, dtype=np.uint64), (len(counts), 1))
        for j in range(rows):
            buckets = mix(buckets * np.uint64(0x9E3779B97F4A7C15) + least[:, j::rows])
        return buckets, np.packbits(bits, axis=2).transpose(1, 0, 2).reshape(len(counts), 2 * n_bytes).view(np.uint64)

    def lists(x: np.ndarray, some: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * x.shape[1])]).astype(np.int32), x[some].ravel().view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 2048) for at in range(0, whole.num_rows, 2048)):
                n = batch.num_rows
                sizes, sums, xors = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                buckets, profiles = np.zeros((n, bands), dtype=np.uint64), np.zeros((n, n_bytes // 4), dtype=np.uint64)
                for group, found, counts in read([(text or "").encode() for text in batch.column(2).to_pylist()]):
                    own, counts = distinct(mix(found), counts)
                    sizes[group] = counts
                    buckets[group], profiles[group] = sketch(own, counts)
                    ends = np.cumsum(counts)
                    for i, start, end in zip(group, (ends - counts).tolist(), ends.tolist(), strict=True):
                        sums[i], xors[i] = own[start:end].sum(dtype=np.uint64), np.bitwise_xor.reduce(own[start:end])
                some = sizes > 0
                sets = pa.array(mix(sums + mix(xors + sizes.astype(np.uint64)) * np.uint64(3)).view(np.int64), mask=~some)
                made = [sets, pa.array(sizes), lists(buckets, some), lists(profiles, some)]
                names = ["key", "text_hash", "set", "n", "bands", "profile"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("key"), F.xxhash64(sequence).alias("text_hash"), F.col(sequence).alias("sequence"))
    return texts.mapInArrow(run, f"key {kind}, text_hash bigint, set bigint, n bigint, bands array<bigint>, profile array<bigint>")


def _alike(options: NearDuplicateOptions):
    """A function from the sizes and profiles of two rows of sets: which pairs can reach the threshold.

    The least hashes of a cell differ only if one of the sets lacks one of them, so cells that differ are at most the elements not shared.
    Of the cells with hashes, a share of 1 - Jaccard differs, half of those that both fill unseen; a pair is ruled out
    beyond six standard deviations.
    """
    t = options.threshold

    def alike(n: np.ndarray, profile: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
        half = profile.shape[1] // 2
        total = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        apart = profile ^ other
        one, share = apart[:, :half], total(profile[:, :half] | other[:, :half]) * (1 - t)
        differ = total(one | apart[:, half:])
        few = (differ <= (n + m) * ((1 - t) / (1 + t)) + 1e-6) & (2 * differ - total(one) <= share + 6 * np.sqrt(2 * share) + 2)
        return few & (np.minimum(n, m) >= t * np.maximum(n, m))

    return alike


def _profiles():
    """A function from a column of profiles, none of them missing, to their words by row."""

    def words(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)

    return words


def verified_pairs(pairs: DataFrame, sequences: DataFrame, options: NearDuplicateOptions) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity reaches the threshold, settled.

    ``sequences`` has one (set, sequence) for each set. The pairs are settled before they meet the
    sequences, so few pairs are broadcast and many are shuffled. Sets are built anew from the two sequences of a pair:
    stored sets would take eight times the space of the letters. Those last used are kept, some million codes at most.
    """
    (read, distinct), threshold = _kmer_reader(options.k), options.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                names = [batch.column(c).to_pylist() for c in (0, 1)]
                if sum(map(len, known.values())) > 1 << 21:
                    known = {}
                new = {x: (c, i) for c in (0, 1) for i, x in enumerate(names[c]) if x not in known}
                for group, found, counts in read([batch.column(2 + c)[i].as_py().encode() for c, i in new.values()]):
                    own, counts = distinct(found, counts)
                    order = list(new)
                    known |= zip((order[i] for i in group), np.split(own, np.cumsum(counts)[:-1]), strict=True)
                kept = []
                for x, y in zip(*names, strict=True):
                    met = np.concatenate([known[x], known[y]])
                    met.sort()
                    both = np.count_nonzero(met[1:] == met[:-1])
                    kept.append(both >= threshold * (len(met) - both))
                yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    found = settle(pairs.select("a", "b").distinct())
    side = lambda name: sequences.select(F.col("set").alias(name), F.col("sequence").alias(f"_{name}"))
    rows = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b")
    return settle(rows.mapInArrow(run, "a bigint, b bigint"))


def _open(buckets: DataFrame, components: DataFrame | None) -> DataFrame:
    """(bucket, set, component, rows) of the buckets that hold several components."""
    labelled = buckets.withColumn("component", F.col("set"))
    if components is not None:
        named = components.withColumnsRenamed({"vertex": "set", "component": "_c"})
        labelled = buckets.join(named, "set", "left").withColumn("component", F.coalesce("_c", "set")).drop("_c")
    parts = labelled.groupBy("bucket").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("rows")
    )
    several = settle(parts.where("_low <> _high").select("bucket", "rows"))
    return labelled.join(several, "bucket")


def _leader_pairs(opened: DataFrame, seed: int, own: DataFrame, options: NearDuplicateOptions) -> DataFrame:
    """(a, b): every set with one leader of another component, the one it shares most buckets with, if they can be alike."""
    lead = opened.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "set").alias("h"), "set", "component")).alias("lead"))
    met = opened.join(lead, "bucket").where(F.col("lead.component") != F.col("component"))
    shared = met.groupBy("set", F.col("lead.set").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    pairs = settle(shared.groupBy(F.col("set").alias("a")).agg(F.max_by("b", F.struct("shared", "b")).alias("b")))
    alike, words = _alike(options), _profiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(c).to_numpy() for c in (2, 4))
                yield batch.select([0, 1]).filter(pa.array(alike(n, words(batch.column(3)), m, words(batch.column(5)))))

    side = lambda name: own.select(F.col("set").alias(name), F.col("n").alias(f"_n{name}"), F.col("profile").alias(f"_p{name}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_na", "_pa", "_nb", "_pb")
    return rows.mapInArrow(run, "a bigint, b bigint")


def _bucket_pairs(opened: DataFrame, own: DataFrame, options: NearDuplicateOptions) -> DataFrame:
    """(a, b) of sets of different components in a bucket that can be alike.

    Sets of a bucket come by size, and each meets those before it that are not too small to be alike. Large buckets are split by
    classes of sizes, ``splits`` to a step of the threshold; a set is also in so many classes below, to meet the sets there.
    """
    alike, words, t = _alike(options), _profiles(), options.threshold
    rows = opened.join(own, "set").withColumns({"class": F.lit(0).cast("bigint"), "below": F.lit(0)})
    if options.splits:
        step = max(-math.log(max(t, 1e-9)), 1e-6) * (1 + 1e-9) / options.splits
        large = F.col("rows") > options.small_bucket
        rows = rows.withColumn("class", F.when(large, F.floor(F.log("n") / step)).otherwise(F.col("class")))
        rows = rows.withColumn("below", F.explode(F.sequence(F.lit(0), F.when(large, options.splits).otherwise(F.lit(0)))))
        rows = rows.withColumn("class", F.col("class") - F.col("below"))
    columns = ["bucket", "class", "below", "set", "component", "n", "profile"]
    rows = rows.select(*columns).repartition("bucket", "class").sortWithinPartitions("bucket", "class", "n", "below", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [*(c.to_numpy() for c in batch.columns[:6]), words(batch.column(6))]
            held = 0 if last is None else len(last[0])
            bucket, size, below, name, part, n, profile = (np.concatenate(x) for x in zip(last, new, strict=True)) if held else new
            j, back = np.arange(held, len(n)), 0
            while len(j):
                back += 1
                j = j[j >= back]
                i = j - back
                j = j[(bucket[i] == bucket[j]) & (size[i] == size[j]) & (n[i] >= t * n[j])]
                two = j[(below[j - back] == 0) & (part[j - back] != part[j])]
                for at in range(0, len(two), 4096):
                    y = two[at : at + 4096]
                    x = y - back
                    found = alike(n[x], profile[x], n[y], profile[y])
                    if found.any():
                        yield pa.RecordBatch.from_arrays([pa.array(name[x[found]]), pa.array(name[y[found]])], ["a", "b"])
            open_ = (bucket == bucket[-1]) & (size == size[-1]) & (n >= t * n[-1])
            last = [x[open_] for x in (bucket, size, below, name, part, n, profile)]

    return rows.mapInArrow(run, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(
    df: DataFrame, key: str = "seq_id", sequence: str = "sequence", options: NearDuplicateOptions = NearDuplicateOptions()
) -> DataFrame:
    """(key, n_kmers, group_id) of every row of ``df``: the smallest key reachable by links. Runs jobs.

    A sequence without k-mers (NULL, empty, only unknown letters) links with nothing. Rows that repeat a key are rows
    of their own with one name. A row without a key can link others but gives no group its name. Sets are told
    apart by 64-bit hashes.
    """
    rows, by_set = _grouped(df, key, sequence, options)
    found = by_set.select("set", F.col("least.key").alias("group_id"))
    group = F.when(F.col("set").isNull(), F.col("key")).otherwise(F.col("group_id"))
    return rows.join(found, "set", "left").select(F.col("key").alias(key), F.col("n").alias("n_kmers"), group.alias("group_id"))


def _grouped(df: DataFrame, key: str, sequence: str, options: NearDuplicateOptions) -> tuple[DataFrame, DataFrame]:
    """(key, text_hash, set, n, bands) of every row, and for every set the least (key, text_hash) of its group."""
    rows = settle(sketches(df, key, sequence, options))
    buckets = settle(rows.select("set", F.explode("bands").alias("bucket")).distinct())
    first = settle(_open(buckets, None).select("bucket", "set"))
    release(buckets)
    # one row and one sequence for each set that shares a bucket with another
    one = rows.join(settle(first.select("set").distinct()), "set").groupBy("set")
    one = settle(one.agg(F.min(F.struct("text_hash", "key")).alias("row"), F.first("n").alias("n"), F.first("profile").alias("profile")))
    own = one.select("set", "n", "profile")
    wanted = one.select("row.key").distinct()
    texts = df.join(wanted.hint("shuffle_hash"), df[key].eqNullSafe(wanted["key"]), "left_semi").select(F.col(sequence).alias("sequence"))
    texts = texts.join(one.select("set", F.col("row.text_hash").alias("_hash")), F.xxhash64("sequence") == F.col("_hash"))
    sequences = settle(texts.groupBy("set").agg(F.min("sequence").alias("sequence")))

    links = components = None
    for step in range(options.leader_rounds):
        more = verified_pairs(_leader_pairs(_open(first, components), step, own, options), sequences, options)
        if not more.limit(1).count():
            break
        links = more if links is None else settle(links.unionByName(more))
        components = connected_components(links)
    more = verified_pairs(_bucket_pairs(settle(_open(first, components)), own, options), sequences, options)
    if more.limit(1).count():
        links = more if links is None else settle(links.unionByName(more))
        components = connected_components(links)

    first_row = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "text_hash"))).alias("_least")
    by_set = rows.where("set is not null").groupBy("set").agg(first_row).withColumn("component", F.col("set"))
    if components is not None:
        named = components.withColumnsRenamed({"vertex": "set", "component": "_c"})
        by_set = by_set.join(named, "set", "left").withColumn("component", F.coalesce("_c", "component")).drop("_c")
    names = by_set.groupBy("component").agg(F.min("_least").alias("least"))
    return rows, by_set.join(names, "component").select("set", "least")


def drop_near_duplicates(
    df: DataFrame, key: str = "seq_id", sequence: str = "sequence", options: NearDuplicateOptions = NearDuplicateOptions()
) -> DataFrame:
    """One row of each group, the least by key and text, with all columns; rows without a key or k-mers all stay. Runs jobs.

    Rows that repeat both the key and the sequence stay together.
    """
    rows, by_set = _grouped(df, key, sequence, options)
    same = (F.col("key") == F.col("least.key")) & (F.col("text_hash") == F.col("least.text_hash"))
    gone = rows.where("key is not null").join(by_set, "set").where(~same)
    gone = settle(gone.select(F.col("key").alias("_key"), F.col("text_hash").alias("_text")).distinct())
    return df.join(gone, (F.col(key) == F.col("_key")) & (F.xxhash64(sequence) == F.col("_text")), "left_anti")
