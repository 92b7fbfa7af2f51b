"""Exact Jaccard join on word n-grams, with a count-vector R-tree inside blocks.

Every document is the set of its shingle hashes. Shingles are hashed into groups, and the counts per group make a
document a point. Two sets cannot share more than the sum of the smaller counts of each group, and a box
of points bounds all of them at once by its largest counts: an R-tree over the points finds the
pairs that may link, and exact intersections decide.

Group counts of unrelated texts are all alike, so a tree over the whole corpus would visit nearly
every leaf. Documents therefore meet in blocks first. A set that links to another shares some of its
first shingles with it in any fixed order of shingles (the prefix filter), so a block is the
documents that have a rare shingle among their first ones. No link is lost. Large groups of near
copies never unfold into their pairs: documents that are already connected are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.llm import textbytes
from helixframe.llm.base import connected_components, slices
from helixframe.session import release, settle


@dataclass(frozen=True)
class Settings:
    size: int = 5  # words of a shingle
    percent: int = 75  # links need 100 x intersection >= percent x union
    spare: float = 0.10  # share of a set that is looked at beyond the shortest prefix
    groups: int = 128  # coordinates of a point
    leaf: int = 16  # points of a leaf, and boxes of a node
    piece: int = 1_024  # documents of a block that stay together
    leader_rounds: int = 4  # at most
    bloom_bits: int = 1 << 27  # filter that keeps most unlinked sets from being written


#: Letters of a chunk: some ten arrays of 64-bit numbers of that length are held at a time.
CHUNK_BYTES = 1 << 18


# sets ------------------------------------------------------------------------------------------


def sets_of(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of the set, sorted distinct shingle hashes as signed numbers) of each text."""
    for _, data, bounds in textbytes.chunks(texts, CHUNK_BYTES):
        words = textbytes.find_words(data, bounds)
        hashes, first = textbytes.shingles(words, size)
        for low, high in zip(first, first[1:], strict=False):
            own = np.unique(hashes[low:high].view(np.int64))
            yield _set_id(own), own


def _set_id(own: np.ndarray) -> int:
    """One hash for the whole set: the mixed sum and exclusive or of its members, and its size."""
    x = textbytes.mix(own.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    both = np.array([x.sum(dtype=np.uint64) + np.uint64(len(own)) * np.uint64(3), np.bitwise_xor.reduce(x) if len(x) else np.uint64(0)])
    return int(textbytes.mix(both[:1] + textbytes.mix(both[1:]) * np.uint64(5)).view(np.int64)[0])


def needed(n: int | np.ndarray, percent: int):
    """The least overlap with which a set of n can link at all: percent of its own size, rounded up."""
    return -((-percent * n) // 100)


def first_shingles(docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """(set, wanted, token): the first shingles of each set in the order of their hashes.

    With ``k`` spare shingles, two linked sets share k + 1 of their first shingles. ``wanted`` is that
    number for the smallest set this one can link to. Each task sends a set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            ids, wants, tokens = [], [], []
            for name, own in sets_of(batch.column(0), s.size):
                if len(own) and name not in seen:
                    seen.add(name)
                    n, need = len(own), needed(len(own), s.percent)
                    own = own[: min(n, n - need + 1 + int(s.spare * n))]
                    ids.append(np.full(len(own), name, dtype=np.int64))
                    wants.append(np.full(len(own), 1 + int(s.spare * need), dtype=np.int32))
                    tokens.append(own)
            if ids:
                part = [pa.array(np.concatenate(x)) for x in (ids, wants, tokens)]
                yield pa.RecordBatch.from_arrays(part, ["set", "wanted", "token"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "set bigint, wanted int, token bigint")


def possible_sets(docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """(set) of the sets of which enough first shingles also come first in some other set."""
    by_token = Window.partitionBy("token")
    met = first_shingles(docs, text_col, s).withColumn("_other", F.min("set").over(by_token) != F.max("set").over(by_token))
    once = met.where("_other").dropDuplicates(["token", "set"])  # several tasks may have sent the set
    shared = once.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("wanted"))
    return shared.where("n >= wanted").select("set")


def _bits(names: np.ndarray, bits: int) -> np.ndarray:
    x = names.view(np.uint64)
    return np.stack([textbytes.mix(x + np.uint64(k)) % np.uint64(bits) for k in (1, 2, 3)], axis=-1)


def bloom_filter(sets: DataFrame, bits: int) -> np.ndarray:
    """A bit per possible hash place, set for every set; its size is fixed, so it can be sent to all tasks.

    Built by bitwise or of 64-bit words over the cluster; only words with a bit are fetched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = _bits(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            bit = (np.uint64(1) << (at % np.uint64(64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(64)).astype(np.int64)), pa.array(bit)], ["word", "bit"])

    words = sets.mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _in_bloom(name: int, bloom: np.ndarray) -> bool:
    at = _bits(np.array([name], dtype=np.int64), len(bloom) * 64)[0]
    return bool(((bloom[at // np.uint64(64)] >> (at % np.uint64(64))) & np.uint64(1)).all())


def members(docs: DataFrame, possible: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(id, set, n, text_hash, shingles) of every row, settled; the shingles only of sets that may link, once per task."""
    context = docs.sparkSession.sparkContext
    bloom = context.broadcast(bloom_filter(possible, s.bloom_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            names, sizes, kept = [], [], []
            for name, own in sets_of(batch.column(1), s.size):
                names.append(name)
                sizes.append(len(own))
                fresh = len(own) > 0 and name not in seen and _in_bloom(name, bloom.value)
                if fresh:
                    seen.add(name)
                kept.append(own if fresh else None)
            columns = [batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), batch.column(2), pa.array(kept, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "set", "n", "text_hash", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return settle(rows.mapInArrow(run, f"id {kind}, set bigint, n bigint, text_hash bigint, shingles array<bigint>"))


def rare_first(found: DataFrame, s: Settings) -> DataFrame:
    """(set, n, need, tokens) of the sets that can link, settled.

    The few sets that came through the filter by chance are judged like the others.
    ``tokens`` are the shingles that other sets have too, rare ones first. A set can only link if
    these are ``need`` of its shingles; shingles of no other set cannot be shared and are dropped.
    """
    rows = found.where("shingles is not null")
    tokens = rows.select("set", "n", F.explode("shingles").alias("token")).repartition("token")
    tokens = tokens.dropDuplicates(["token", "set"])
    counted = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    by_set = counted.groupBy("set", "n").agg(F.collect_list(F.struct("df", "token")).alias("tokens"))  # of one document
    need = F.ceil(F.col("n") * s.percent / 100.0).cast("bigint")
    by_set = by_set.withColumn("need", need).where(F.size("tokens") >= F.col("need"))
    return settle(by_set.select("set", "n", "need", F.transform(F.array_sort("tokens"), lambda t: t["token"]).alias("tokens")))


# points and their tree --------------------------------------------------------------------------


def count_vector(tokens: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount(textbytes.mix(tokens.view(np.uint64)) % np.uint64(groups), minlength=groups).astype(np.uint32)


def packed(counts: np.ndarray) -> bytes:
    """A count vector in the narrowest of one, two and four bytes a count; its length tells which."""
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def unpacked(vectors: list[bytes], groups: int) -> np.ndarray:
    """The count vectors as rows, in the width of the widest."""
    width = max((len(v) for v in vectors), default=groups) // groups
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
    out = np.empty((len(vectors), groups), dtype=kinds[width])
    sizes = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors)) // groups
    for own in np.unique(sizes):
        rows = np.flatnonzero(sizes == own)
        out[rows] = np.frombuffer(b"".join([vectors[i] for i in rows]), dtype=kinds[int(own)]).reshape(-1, groups)
    return out


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all ``range(start, stop)``, one after the other."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + (starts - (ends - sizes))[owner]


class Trees:
    """One R-tree per block, packed bottom up side by side.

    Of a box only its largest counts, the range of its set sizes and of its components are needed. Level 0 are
    the points, each block's in the order of component and size, so that near copies share a box.
    """

    def __init__(self, block: np.ndarray, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, leaf: int):
        self.order = order = np.lexsort((sizes, parts, block))
        block, tops, low, part_low = block[order], points[order], sizes[order], parts[order]
        high, part_high, first = low, part_low, np.arange(len(low))
        self.levels = []
        while True:
            self.levels.append((tops, low, high, part_low, part_high, first, block))
            opens = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            if len(opens) == len(block):
                return
            inside = np.arange(len(block)) - np.repeat(opens, np.diff(np.append(opens, len(block))))
            first = np.flatnonzero(inside % leaf == 0)
            tops, low, high = np.maximum.reduceat(tops, first, axis=0), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            part_low, part_high, block = np.minimum.reduceat(part_low, first), np.maximum.reduceat(part_high, first), block[first]

    def search(
        self, block: np.ndarray, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, percent: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asker, row, slack) of the points of other components in its block that each asker may link to.

        Slack is how far the sum of coordinate minima exceeds what a link needs, relative to the sizes.
        """
        roots = self.levels[-1][-1]
        node = np.minimum(np.searchsorted(roots, block), len(roots) - 1)
        asker = np.flatnonzero(roots[node] == block)
        node = node[asker]
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, low, high, part_low, part_high, first, _ = self.levels[depth]
            n, part = sizes[asker], parts[asker]
            fits = (100 * high[node] >= percent * n) & (100 * n >= percent * low[node])
            fits &= (part_low[node] != part) | (part_high[node] != part)
            asker, node = asker[fits], node[fits]
            bound = np.zeros(len(asker), dtype=np.int64)
            for at in range(0, len(asker), 8192):
                here = slice(at, at + 8192)
                bound[here] = np.minimum(tops[node[here]], points[asker[here]]).sum(axis=1, dtype=np.int64)
            total = sizes[asker] + low[node]
            slack = bound * (100 + percent) - percent * total
            fits = slack >= 0
            asker, node, slack = asker[fits], node[fits], slack[fits] / total[fits]
            if depth:
                stops = np.append(first[1:], len(self.levels[depth - 1][0]))
                place, node = _ranges(first[node], stops[node])
                asker = asker[place]
        return asker, self.order[node], slack


def block_pairs(rows: pd.DataFrame, s: Settings, all_pairs: bool) -> pd.DataFrame:
    """Pairs (a, b) inside whole blocks that may link and are not connected yet, with the components x of a and y of b.

    Rows with ``home`` are in their block's tree, rows with ``visits`` ask. Unless ``all_pairs``, a component
    gives only its pair of most slack.
    """
    keys = rows[["token", "piece", "part"]].to_numpy()
    block = np.cumsum(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    points = unpacked(rows["vector"].tolist(), s.groups)
    sets, sizes, parts = (rows[c].to_numpy() for c in ("set", "n", "component"))
    home, visits = rows["home"].to_numpy(), rows["visits"].to_numpy()
    at, ask = np.flatnonzero(home), np.flatnonzero(visits)
    found = [pd.DataFrame({"a": [], "b": [], "x": [], "y": [], "slack": []}, dtype=np.int64)]
    if len(at) and len(ask):
        trees = Trees(block[at], points[at], sizes[at], parts[at], s.leaf)
        homes = np.bincount(block[at], minlength=block[-1] + 1)
        work = np.cumsum(homes[block[ask]])
        for chunk in np.split(ask, np.flatnonzero(np.diff(work // 500_000)) + 1):
            asker, row, slack = trees.search(block[chunk], points[chunk], sizes[chunk], parts[chunk], s.percent)
            a, b = chunk[asker], at[row]
            once = ~visits[b] | (sets[a] < sets[b])  # two askers meet twice
            a, b = a[once], b[once]
            found.append(pd.DataFrame({"a": sets[a], "b": sets[b], "x": parts[a], "y": parts[b], "slack": slack[once]}))
    pairs = pd.concat(found).drop_duplicates(["a", "b"])
    return pairs if all_pairs else best_of_component(pairs)


def best_of_component(pairs: pd.DataFrame) -> pd.DataFrame:
    pairs = pairs.sort_values(["slack", "a", "b"], ascending=[False, True, True], kind="stable")
    order = np.argsort(np.concatenate([np.arange(len(pairs)) * 2, np.arange(len(pairs)) * 2 + 1]), kind="stable")
    ends = np.concatenate([pairs["x"].to_numpy(), pairs["y"].to_numpy()])[order]
    _, first = np.unique(ends, return_index=True)
    return pairs.iloc[np.unique(first // 2)]


def whole_blocks(frames: Iterator[pd.DataFrame], rows: int = 8_000) -> Iterator[pd.DataFrame]:
    """Frames of about ``rows`` rows that end with a block, from rows that come sorted by block."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[["token", "piece", "part"]].to_numpy()
        opens = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        last = int(opens[-1]) if len(opens) else 0
        starts_new = bool(held) and tuple(held[-1][["token", "piece", "part"]].iloc[-1]) != tuple(keys[0])
        if sum(map(len, held)) >= rows and (starts_new or last):
            cut = 0 if starts_new else int(opens[0])
            yield pd.concat([*held, frame.iloc[:cut]])
            held, frame = [], frame.iloc[cut:]
        held.append(frame)
    if held:
        yield pd.concat(held)


# links ------------------------------------------------------------------------------------------


def open_blocks(blocks: DataFrame, components: DataFrame | None) -> DataFrame:
    """(token, set, component) of the blocks that hold several components. Settled.

    Components only grow, so a block that is closed stays closed and need not be looked at again.
    """
    if components is None:
        labelled = blocks.select("token", "set", F.col("set").alias("component"))
    else:
        labelled = blocks.select("token", "set").join(components, "set", "left").withColumn("component", F.coalesce("component", "set"))
    ends = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return settle(labelled.join(ends.where("low <> high").select("token"), "token"))


def leaders(opened: DataFrame, seed: int) -> DataFrame:
    """(a, b): every set of an open block with one set of another component, the block leader it meets most often.

    The leader of a block is its set of least hash, so large groups of near copies agree on few leaders.
    """
    lead = opened.groupBy("token").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "set").alias("h"), "set", "component")).alias("lead"))
    met = opened.join(lead, "token").where(F.col("lead.component") != F.col("component"))
    often = met.groupBy("set", F.col("lead.set").alias("b")).agg(F.count(F.lit(1)).alias("often"))
    return often.groupBy(F.col("set").alias("a")).agg(F.max_by("b", F.struct("often", "b")).alias("b"))


def candidate_pairs(opened: DataFrame, ready: DataFrame, s: Settings, all_pairs: bool) -> DataFrame:
    """(a, b) of sets of different components that share a block and may link.

    Only blocks with several components count. Their largest component stays at home in pieces; the documents of
    the others visit every piece, in parts of bounded size, so the work follows what is not yet connected. Unless
    ``all_pairs``, a component gives only its likeliest pair.
    """
    parts = opened.groupBy("token", "component").agg(F.count(F.lit(1)).alias("rows"))
    base = F.max_by("component", F.struct("rows", "component")).alias("base")
    pieces = F.ceil(F.sum("rows") / s.piece).cast("int").alias("pieces")
    visitors = F.ceil((F.sum("rows") - F.max("rows")) / (4 * s.piece)).cast("int").alias("parts")
    rows = opened.join(parts.groupBy("token").agg(base, pieces, visitors), "token")
    visits = F.col("component") != F.col("base")
    own_piece = F.pmod(F.xxhash64("set"), F.col("pieces")).cast("int")
    own_part = F.pmod(F.xxhash64(F.lit("part"), "set"), F.col("parts")).cast("int")
    every = lambda n, own: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.struct(i.alias("i"), (i == own).alias("own")))
    placed = rows.select(
        "token", "set", "component", visits.alias("_v"), "parts", own_part.alias("_part"), F.explode(every("pieces", own_piece)).alias("p")
    ).where("_v or p.own")
    placed = placed.select("token", "set", "component", "_v", "p", F.explode(every("parts", F.col("_part"))).alias("q")).where("p.own or q.own")
    points = ready.select("set", "n", "tokens").mapInArrow(_vectors(s), "set bigint, n bigint, vector binary")
    met = placed.join(points, "set").select(
        "token", F.col("p.i").alias("piece"), F.col("q.i").alias("part"), "set", "n", "component", "vector",
        F.col("p.own").alias("home"), (F.col("_v") & F.col("q.own")).alias("visits"),
    )
    keys = ["token", "piece", "part"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in whole_blocks(frames):
            yield block_pairs(some, s, all_pairs)

    sorted_rows = met.repartition(*keys).sortWithinPartitions(*keys)
    pairs = sorted_rows.mapInPandas(run, "a bigint, b bigint, x bigint, y bigint, slack double")
    if all_pairs:
        return pairs.select("a", "b").distinct()
    pairs = settle(pairs)
    ends = pairs.select("a", "b", "slack", F.explode(F.array("x", "y")).alias("component"))
    likeliest = ends.groupBy("component").agg(F.max(F.struct("slack", "a", "b")).alias("best"))
    return likeliest.select("best.a", "best.b").distinct()


def _vectors(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            vectors = [packed(count_vector(flat[a:b], s.groups)) for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["set", "n", "vector"])

    return run


def verified(pairs: DataFrame, ready: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that link, by their exact intersections. Settled.

    The pairs are settled first: as long as they are few they are broadcast, and only the sets
    they name move.
    """
    found = settle(pairs.select("a", "b"))
    ends = found.select("a", "b", F.explode(F.array("a", "b")).alias("set"))
    sides = ready.join(ends, "set").groupBy("a", "b").agg(F.collect_list(F.struct("n", "tokens")).alias("two"))  # exactly two
    p, q = F.element_at("two", 1), F.element_at("two", 2)
    both = F.size(F.array_intersect(p["tokens"], q["tokens"]))
    links = sides.where(both * (100 + s.percent) >= (p["n"] + q["n"]) * s.percent)
    out = settle(links.select("a", "b"))
    release(found)
    return out


def link_sets(ready: DataFrame, s: Settings) -> DataFrame:
    """(set, component) of the sets that link to another; every link between different sets counts. Runs jobs.

    First every set is compared with one leader, in a few rounds. Then, as long as it connects anything, with
    the likeliest pair of each component; at last with all pairs that remain possible between different components.
    """
    # of the first n - need + 1 shingles, the n - size(tokens) that no other set has come first
    prefix = F.slice("tokens", F.lit(1), (F.size("tokens") - F.col("need") + 1).cast("int"))
    blocks = ready.select(F.explode(prefix).alias("token"), "set")
    opened = open_blocks(blocks, None)
    components, links, step = ready.select("set", F.col("set").alias("component")).limit(0), None, 0
    while True:
        all_pairs = step > s.leader_rounds
        pairs = leaders(opened, step) if step < s.leader_rounds else candidate_pairs(opened, ready, s, all_pairs)
        more = verified(pairs, ready, s)
        grew = more.limit(1).count() > 0
        if grew:
            before, links = links, more if links is None else settle(links.unionByName(more))
            if before is not None:
                release(before, more)
            components = connected_components(links).select(F.col("vertex").alias("set"), "component")
            last, opened = opened, open_blocks(opened, components)
            release(last)
        if all_pairs:
            release(opened)
            return components
        if step < s.leader_rounds:
            step = step + 1 if grew else s.leader_rounds
        elif not grew:
            step += 1


def _grouped(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, set, n) of every row, and (set, component, component_id) of every set that has words. Runs jobs."""
    possible = settle(possible_sets(docs, text_col, s))
    found = members(docs, possible, id_col, text_col, s)
    release(possible)
    ready = rare_first(found, s)
    components = link_sets(ready, s)
    rows = found.select("id", "text_hash", "set", "n")
    smallest = rows.where("n > 0").groupBy("set").agg(F.min("id").alias("least"))
    named = smallest.join(components, "set", "left").withColumn("component", F.coalesce("component", "set"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = settle(named.join(names, "component").select("set", "component", "component_id"))
    release(ready)
    return rows, out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id reachable by links. Runs jobs.

    Equal sets are one vertex. Texts without words (empty, NULL) have no shingles and link with nothing,
    not even each other. A row whose id is NULL can link others but gives no component its name.
    Sets and shingles are told apart by 64-bit hashes.
    """
    rows, by_set = _grouped(docs, id_col, text_col, settings)
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return rows.join(by_set.drop("component"), "set", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row of each group, the least by id and text hash, with all its columns; rows without an id all stay.

    Rows that repeat an id are told apart by their texts. Those without words are one group per id.
    """
    rows, by_set = _grouped(docs.where(F.col(id_col).isNotNull()), id_col, text_col, settings)
    least = F.min(F.struct("id", "text_hash")).alias("least")
    of_set = rows.groupBy("set", F.when(F.col("n") == 0, F.col("id")).alias("wordless")).agg(least)
    of_group = of_set.join(by_set, "set", "left").groupBy("component", "wordless").agg(F.min("least").alias("least"))
    kept = of_group.select(F.col("least.id").alias("_kept"), F.col("least.text_hash").alias("_kept_text")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"))
    same = (rows["_id"] == F.col("_kept")) & (rows["_text"] == F.col("_kept_text"))
    kept_rows = rows.join(settle(kept), same, "left_semi")
    first = F.row_number().over(Window.partitionBy("_id", "_text").orderBy("_text"))  # rows that repeat id and text
    with_id = kept_rows.withColumn("_place", first).where("_place = 1").select("_row.*")
    return with_id.unionByName(docs.where(F.col(id_col).isNull()))
