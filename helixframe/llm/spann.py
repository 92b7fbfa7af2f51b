"""Approximate nearest neighbours by balanced posting lists.

A hierarchical, balanced k-means on a bounded sample gives the centroids. Every vector goes to the
posting list of its nearest centroid and, if it lies near a boundary, to those of further ones too.
Centroids are found by best-first search over their in-memory neighbour graph; a query reads the
lists whose centroid is not much farther than the nearest one. Equal vectors count as one point in the
index, and a long list is read in pieces, so no list, however popular, meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixframe.session import settle


@dataclass(frozen=True)
class Settings:
    sample: int = 16_384  # vectors the centroids are fitted on, at most; all vectors are indexed
    list_size: int = 256  # vectors a list should hold
    most_lists: int = 4_096  # bound on the centroids held in memory
    links: int = 16  # neighbours of a centroid in the graph
    copies: int = 3  # lists of one vector, at most
    boundary: float = 0.08  # a vector joins a list up to this much farther than its nearest
    prune: float = 0.22  # a query reads a list up to this much farther than its nearest
    beam: float = 0.5  # share of the centroids a query's graph search keeps, at least 128 of them
    piece: int = 2_048  # vectors of a list, and queries, that meet in one group
    seed: int = 5


@dataclass(frozen=True)
class Index:
    """Unit centroids, their neighbours, and where searches start."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray


def _halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for the half of the rows nearer to one of two means; both halves are equally large."""
    a, b = x[rng.choice(len(x), 2, replace=False)]
    side = np.zeros(len(x), dtype=bool)
    for _ in range(8):
        lean = x @ (a - b)
        side = np.zeros(len(x), dtype=bool)
        side[np.argsort(-lean, kind="stable")[: len(x) // 2]] = True
        a, b = x[side].mean(axis=0), x[~side].mean(axis=0)
    return side


def fit(sample: np.ndarray, lists: int, s: Settings) -> Index:
    """Balanced bisection of unit vectors into ``lists`` leaves, then three rounds of k-means."""
    rng = np.random.default_rng(s.seed)
    leaves = [sample]
    while len(leaves) < lists and max(map(len, leaves)) > 1:
        leaves.sort(key=len)
        largest = leaves.pop()
        side = _halves(largest, rng)
        leaves += [largest[side], largest[~side]]
    centroids = _unit(np.stack([x.mean(axis=0) for x in leaves]))
    for _ in range(3):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        filled = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids[filled] = _unit(sums[filled])
    alike = centroids @ centroids.T
    np.fill_diagonal(alike, np.inf)
    graph = np.argsort(-alike, axis=1, kind="stable")[:, : s.links + 1]
    ring = (np.arange(len(centroids)) + 1) % len(centroids)  # keeps the graph in one piece
    graph[:, -1] = ring
    step = max(1, len(centroids) // 8)
    return Index(centroids, graph, np.arange(0, len(centroids), step))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def search_graph(index: Index, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for many unit vectors side by side: (centroids, distances), nearest first.

    Distance is that between unit vectors. Places the search did not fill hold infinity.
    """
    n, total = len(x), len(index.centroids)
    beam = min(beam, total)
    at = np.arange(n)[:, None]
    seen = np.zeros((n, total), dtype=bool)
    ids = np.zeros((n, beam), dtype=np.int64)
    far = np.full((n, beam), np.inf)
    done = np.ones((n, beam), dtype=bool)
    new = np.broadcast_to(index.entries, (n, len(index.entries)))
    while True:
        fresh = ~seen[at, new]
        seen[at, new] = True
        dots = np.einsum("nd,nkd->nk", x, index.centroids[new])
        reach = np.where(fresh, np.sqrt(np.maximum(0, 2 - 2 * dots)), np.inf)
        all_ids, all_far = np.concatenate([ids, new], axis=1), np.concatenate([far, reach], axis=1)
        all_done = np.concatenate([done, ~fresh], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        ids, far, done = all_ids[at, order], all_far[at, order], all_done[at, order]
        waiting = np.where(done, np.inf, far)
        best = waiting.argmin(axis=1)
        live = np.isfinite(waiting[at[:, 0], best])
        if not live.any():
            return ids, far
        done[at[:, 0], best] = True
        new = index.graph[ids[at[:, 0], best]]


def posting_lists(index: Index, x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest list, and further ones near whose boundary the vector lies.

    A further list is passed over if a nearer centroid is closer to its centroid than the vector is,
    since then searches that come by there read the nearer list too.
    """
    ids, far = search_graph(index, x, max(s.copies * 3, 16))
    ids, far = ids[:, : s.copies * 2], far[:, : s.copies * 2]
    near = far <= (1 + s.boundary) * far[:, :1] + 1e-12
    keep = near.copy()
    for j in range(1, ids.shape[1]):
        earlier = np.einsum("nkd,nd->nk", index.centroids[ids[:, :j]], index.centroids[ids[:, j]])
        apart = np.sqrt(np.maximum(0, 2 - 2 * earlier))
        shaded = (keep[:, :j] & (apart < far[:, j, None] * 0.5)).any(axis=1)
        keep[:, j] &= ~shaded & (keep[:, :j].sum(axis=1) < s.copies)
    row, place = np.nonzero(keep)
    return row, ids[row, place]


def lists_to_read(index: Index, x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs of the lists a query reads, by the ratio of distances."""
    ids, far = search_graph(index, x, max(128, round(s.beam * len(index.centroids))))
    row, place = np.nonzero(far <= (1 + s.prune) * far[:, :1] + 1e-12)
    return row, ids[row, place]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) as doubles, without NULL ids, and NULL, empty, zero or not wholly finite vectors."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0.0), F.lit(False)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths that neither overflow nor vanish."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine; each value depends on its own two rows alone, to the last bit."""
    na, nb = _norms(a), _norms(b)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        plain = (a * b).sum(axis=1) / (na * nb)
    scaled = ((a / na[:, None]) * (b / nb[:, None])).sum(axis=1)
    return np.where(np.isfinite(plain), plain, scaled)


def _best(q: pd.DataFrame, p: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 best points of one piece of a list for each query; ties to the smaller id."""
    qv, pv, points = _matrix(q["vec"]), _matrix(p["vec"]), p["id"].to_numpy()
    qu, pu = qv / _norms(qv)[:, None], pv / _norms(pv)[:, None]
    out = []
    for at in range(0, len(q), 256):
        rough = qu[at : at + 256] @ pu.T
        if rough.shape[1] > k + 1:
            floor = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1), None] - 1e-9
            row, col = np.nonzero(rough >= floor)
        else:
            row, col = (x.ravel() for x in np.indices(rough.shape))
        exact = cosines(qv[at + row], pv[col])
        order = np.lexsort((points[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place <= k
        out.append(pd.DataFrame({"query_id": q["id"].to_numpy()[at + row[keep]], "point": points[col[keep]], "score": exact[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "point": [], "score": []})


def _in_lists(rows: DataFrame, shared, chooser, s: Settings) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                x = _matrix(part["vec"])
                row, lists = chooser(shared.value, x / _norms(x)[:, None], s)
                yield pd.DataFrame({"list": lists, "id": part["id"].to_numpy()[row], "vec": part["vec"].to_numpy()[row]})

    return rows.mapInPandas(run, "list int, id bigint, vec array<double>")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    settings: Settings = Settings(),
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies ``queries`` its k nearest others.

    Nearness is the cosine in double precision, ties go to the smaller id, a query is not its own
    neighbour. Vectors that are not usable (see ``usable``), or not of the most common length, take
    no part; repeated rows count once; an id with several vectors queries by the smallest of them.
    Runs jobs: the vectors are counted, a bounded sample is fetched for the centroids (bounded as well)
    and postings are settled. All else stays distributed.
    """
    s = settings
    flagged = vectors.withColumn("_is_query", F.coalesce(queries, F.lit(False)))
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = lengths[0]["n"] if lengths else 0
    rows = rows.where(F.size("vec") == size).distinct()
    by_vector = Window.partitionBy("vec")
    # equal vectors are one point; only the k + 1 smallest of their ids can be among k nearest
    copies = rows.withColumn("_place", F.row_number().over(by_vector.orderBy("id"))).where(F.col("_place") <= k + 1)
    copies = settle(copies.withColumn("point", F.min("id").over(by_vector)))
    points = copies.where("_place = 1").select("id", "vec")
    asked = usable(flagged.where("_is_query"), id_col, vec_col).where(F.size("vec") == size)
    asked = asked.groupBy("id").agg(F.min("vec").alias("vec"))

    n_points = points.count()
    if not n_points:
        return copies.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    sample = points.orderBy(F.xxhash64("id"), "id").limit(s.sample).toPandas()
    x = _matrix(sample["vec"])
    index = fit(x / _norms(x)[:, None], max(1, min(s.most_lists, n_points // s.list_size)), s)
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # at most most_lists centroids

    postings = settle(_in_lists(points, shared, posting_lists, s))
    reads = settle(_in_lists(asked, shared, lists_to_read, s))
    pieces = lambda n: F.ceil(F.count(F.lit(1)) / s.piece).cast("int").alias(n)
    cut = settle(postings.groupBy("list").agg(pieces("n_piece")).join(reads.groupBy("list").agg(pieces("n_part")), "list"))
    piece, part = F.pmod(F.xxhash64("id"), F.col("n_piece")), F.pmod(F.xxhash64("id"), F.col("n_part"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = postings.join(cut, "list").select("list", piece.cast("int").alias("piece"), every("n_part").alias("part"), "id", "vec")
    right = reads.join(cut, "list").select("list", every("n_piece").alias("piece"), part.cast("int").alias("part"), "id", "vec")
    keys = ["list", "piece", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda p, q: _best(q, p, k), "query_id bigint, point bigint, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "point")
    ranked = found.groupBy("query_id", "point").agg(F.max("score").alias("score"))
    ranked = ranked.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k + 1).drop("_place")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        ranked.join(copies.select("point", F.col("id").alias("vec_id")), "point")
        .where("vec_id <> query_id")
        .dropDuplicates(["query_id", "vec_id"])
        .withColumn("rank", F.row_number().over(final).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
