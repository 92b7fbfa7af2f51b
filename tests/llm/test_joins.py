"""The Jaccard join and the neighbour index against brute force, and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import jaccard_join, spann
from helixframe.session import settle


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held, overlap, first = defaultdict(list), Counter(), {}
    for i, s in enumerate(sets):
        if s and first.setdefault(s, i) != i:
            parent[root(i)] = root(first[s])
        elif s:
            for t in s:
                for j in held[t]:
                    overlap[j, i] += 1
                held[t].append(i)
    for (i, j), n in overlap.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d if d is not None else -1, len(sets[i]), least.get(root(i), -1)) for i, (d, _) in enumerate(rows))


def near_copies():
    rnd = random.Random(2)
    base = [" ".join(f"w{rnd.randint(0, 50)}" for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(240):
        words = base[i % 3].split()
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(60)] = f"x{rnd.randint(0, 400)}"
        rows.append((1000 + i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, passage + " " + " ".join(f"q{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    rows += [(3000, None), (3001, ""), (3002, "a b"), (3003, "A\tb"), (3004, "a"), (None, "a b"), (3006, "a b c d e f g"), (3007, "a b c d e f g h")]
    return [*rows, rows[0], (None, passage)]


@pytest.mark.parametrize("settings", [jaccard_join.Settings(), jaccard_join.Settings(piece=16, leaf=4, leader_rounds=0, bloom_bits=1 << 12)])
def test_components_are_those_of_all_pairs(documents, settings):
    rows = near_copies()
    df = documents(rows, "set", "n", "token").repartition(3)
    got = jaccard_join.near_duplicates(df, settings=settings).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"])) for r in got) == brute_components(rows)


def test_one_of_each_group_stays(documents):
    rows = near_copies()
    df = documents(rows, "_id", "_row", "set")
    kept = jaccard_join.keep_one(df)
    wanted = {c for d, _, c in brute_components([r for r in rows if r[0] is not None])}
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(wanted) and ids.count(None) == 2
    assert jaccard_join.near_duplicates(documents([])).count() == 0 and jaccard_join.keep_one(documents([])).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_texts(documents):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(1, texts[0]), (5, texts[1]), (5, texts[2]), (6, texts[0]), (6, texts[3]), (6, texts[3]), (7, texts[2]), (8, ""), (8, None)]
    kept = jaccard_join.keep_one(documents(rows)).collect()
    got = sorted((r["doc_id"], r["text"] or "") for r in kept)
    assert got == sorted([(1, texts[0]), (5, texts[1]), (5, texts[2]), (6, texts[3]), (8, "")])


def test_counts_of_large_sets_do_not_wrap():
    assert jaccard_join.count_vector(np.arange(70_000, dtype=np.int64), 1).tolist() == [70_000]


def test_tree_finds_what_all_bounds_find():
    rng = np.random.default_rng(1)
    n, s = 400, jaccard_join.Settings(groups=8, leaf=4)
    points = rng.poisson(2.0, (n, 8)).astype(np.uint16)
    sizes, block, parts = points.sum(axis=1, dtype=np.int64), np.sort(rng.integers(0, 5, n)), rng.integers(0, 6, n)
    trees = jaccard_join.Trees(block, points, sizes, parts, s.leaf)
    asker, row, _ = trees.search(block, points, sizes, parts, s.percent)
    both = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=np.int64)
    want = (both * 175 >= 75 * (sizes[:, None] + sizes[None])) & (block[:, None] == block[None]) & (parts[:, None] != parts[None])
    want &= (100 * sizes[:, None] >= 75 * sizes[None]) & (100 * sizes[None] >= 75 * sizes[:, None])
    assert set(zip(asker.tolist(), row.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))


def exact(vectors, k=5):
    good = [(i, np.array(v, dtype=float)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = set()
    for i, q in good:
        if i % 50 == 0:
            found = {(-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 12), j) for j, v in good if j != i}
            out |= {(i, rank, j) for rank, (_, j) in enumerate(sorted(found)[:k], 1)}
    return out


def test_few_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(i, rows[7][1]) for i in range(200, 230)] + [(50, rows[50][1]), (300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 0.0, 0.0]),
             (304, [float("nan")] * 4), (350, [float("inf")] + [0.0] * 3), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, point int")
    got = spann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    vectors = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == exact(vectors)
    assert spann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(6000, 32)) + 1.5 * rng.normal(size=(20, 32))[rng.integers(0, 20, 6000)]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(6000), "embedding": vectors.tolist()}))
    got = spann.nearest(df, F.col("vec_id") % 50 == 0, settings=spann.Settings(piece=500)).toPandas()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q, found in got.groupby("query_id"):
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(set(np.argsort(-scores)[:5]) & set(found["vec_id"]))
        assert np.allclose(found.sort_values("rank")["score"], scores[found.sort_values("rank")["vec_id"]])
    assert len(got) == 600 and hits >= 0.9 * 600


def test_pipeline_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, sf))
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in ("toxicity", "ngram_jaccard_join"):
            assert docs.join(before, docs.columns, "left_anti").count() == 0 and docs.count() <= before.count()
        if name == "ngram_jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({c for _, _, c in brute_components(rows)})
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0


def test_pipeline_takes_empty_tables(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
