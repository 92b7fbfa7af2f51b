"""Resampling, ranked search and decontamination against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import alnum, decontaminate, ranked_search, resampling, textbytes

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["rank", "score", "id", "hash", "words", "item", "at", "text_hash"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def prose(rnd, n, letters="abcde"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 2))) for _ in range(n))


@pytest.fixture(scope="module")
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id bigint, text string")

    return make


def test_checksums_of_words_and_pairs():
    rnd = random.Random(1)
    texts = ["", "Éa b-C__d 9", "日本 x" * 3, "q" * 500 + " a " + "z" * 64 + " " + "y" * 65, *(prose(rnd, 40) for _ in range(20)), None]
    got = []
    for _, data, bounds in textbytes.chunks(pa.array(texts), 300):
        spans = alnum.find_spans(data, bounds)
        crc = alnum.crc32_words(spans)
        left, pairs = alnum.crc32_pairs(spans, crc)
        got += [*crc.tolist(), *pairs.tolist()]
        hashes = alnum.hash_words(spans)
        seen = {bytes(spans.data[a:b]): h for a, b, h in zip(spans.start, spans.end, hashes, strict=True)}
        assert len(set(seen.values())) == len(seen)
    want = []
    for text in texts:
        w = words_of(text)
        want += [zlib.crc32(x.encode()) for x in w] + [zlib.crc32(" ".join(p).encode()) for p in zip(w, w[1:], strict=False)]
    assert Counter(got) == Counter(want)


# resampling -------------------------------------------------------------------------------------


def brute_resample(rows, target, s):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(f.encode()) % s.buckets for f in [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]]

    corpus, wanted = Counter(), Counter()
    for _, text in rows:
        corpus.update(features(text))
    for _, text in target:
        wanted.update(features(text))
    big, small = sum(corpus.values()) + s.buckets, sum(wanted.values()) + s.buckets
    out = []
    for i, text in rows:
        f = features(text)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * big / ((corpus[b] + 1) * small))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = [r for r in out if r[1] >= s.least_words]
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: s.percent * len(able) // 100]):
        r[5] = place + 1
    return out


@pytest.mark.parametrize("s", [resampling.Settings(), resampling.Settings(buckets=50, spare=1e-9, accuracy=2), resampling.Settings(percent=100)])
def test_resampling(documents, items, s):
    rnd = random.Random(5)
    rows = [(i * 3, prose(rnd, rnd.choice([0, 5, 19, 20, 21, 60]), rnd.choice(["abc", "cde", "éabc"]))) for i in range(150)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(9000, None), (9001, ""), (9002, "x " * 30_000), (9003, "-+-")]
    target = [(1, prose(rnd, 50, "abc")), (2, None), (2, "A b C")]
    got = resampling.resample(documents(rows, *ODD), items(target), settings=s).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, brute_resample(rows, target, s)))


def test_resampling_of_repeated_and_missing_ids(documents, items):
    rnd = random.Random(6)
    rows = [(None, prose(rnd, 30)) for _ in range(40)] + [(7, prose(rnd, 25))] * 40 + [(7, prose(rnd, 25)) for _ in range(40)]
    s = resampling.Settings(percent=60)
    got = resampling.resample(documents(rows), items([(1, "a b")]), settings=s).collect()
    want = brute_resample(rows, [(1, "a b")], s)
    assert Counter(r[:5] for r in map(tuple, got)) == Counter(tuple(r[:5]) for r in want)
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 73))
    assert [r["score"] for r in drawn] == sorted((r[4] for r in want), reverse=True)[:72]


def test_resampling_of_nothing(documents, items):
    assert resampling.resample(documents([]), items([(1, "a")])).count() == 0
    got = resampling.resample(documents([(1, "a b"), (2, None)]), items([])).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in sorted(got)] == [(1, 3, None), (2, 0, None)]


# ranked search ----------------------------------------------------------------------------------


def brute_search(rows, queries, best):
    counts = [(i, Counter(words_of(t)), len(words_of(t))) for i, t in rows]
    n_docs, n_terms = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_docs) // max(n_terms, 1)
            score = 0
            for t in set(words_of(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        scored.sort()
        out += [(item, rank + 1, None if none else i, -score) for rank, (score, none, i) in enumerate(scored[:best])]
    return out


def searched(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("leaf, shard", [(1, 64), (8, 10_000), (64, 100)])
def test_ranked_search(documents, items, leaf, shard):
    rnd = random.Random(9)
    rows = [(i * 2, prose(rnd, rnd.choice([0, 3, 10, 60]), rnd.choice(["abcd", "cdef", "éa"]))) for i in range(400)]
    rnd.shuffle(rows)
    copy = prose(rnd, 20)
    rows += [(1001 + 2 * i, copy) for i in range(90)] + [(None, copy), (5000, None), (5001, "Zz " * 40_000), (5002, "-")]
    queries = [(i, prose(rnd, rnd.choice([1, 5, 30]))) for i in range(12)] + [(3, copy), (3, copy), (None, "ZZ"), (20, None), (21, "unseen")]
    s = ranked_search.Settings(leaf=leaf, shard_documents=shard)
    got = ranked_search.search(documents(rows, *ODD), items(queries), settings=s)
    assert searched(got) == Counter(brute_search(rows, queries, 50))


def test_ranked_search_in_blocks_of_queries_and_with_small_results(documents, items):
    rnd = random.Random(10)
    rows = [(i, prose(rnd, 12)) for i in range(200)]
    queries = [(i, prose(rnd, 6)) for i in range(9)]
    s = ranked_search.Settings(best=3, block_terms=20, leaf=2, shard_postings=50)
    assert searched(ranked_search.search(documents(rows), items(queries), settings=s)) == Counter(brute_search(rows, queries, 3))


def test_ranked_search_of_nothing(documents, items):
    assert ranked_search.search(documents([]), items([(1, "a")])).count() == 0
    assert ranked_search.search(documents([(1, "a")]), items([])).count() == 0


def test_largest_impacts_of_ranges():
    rnd = np.random.default_rng(3)
    documents = np.concatenate([np.sort(rnd.choice(200, n, replace=False)) for n in (1, 50, 200)]).astype(np.int32)
    row = {
        "ids": np.arange(200, dtype=np.int64).tobytes(), "lengths": np.full(200, 10, dtype=np.int64).tobytes(), "terms": [0, 1, 2],
        "counts": [1, 50, 200], "documents": documents.tobytes(), "frequencies": rnd.integers(1, 9, 251).astype(np.int32).tobytes(),
    }
    shard = ranked_search.Shard(row, ranked_search.Corpus(1, 200, 2000, np.array([1, 50, 200])), ranked_search.Settings())
    low = rnd.integers(51, 250, 300)
    high = np.minimum(low + rnd.integers(1, 200, 300), 251)
    places, tops = shard.maxima(low, high)
    for a, b, place, top in zip(low, high, places, tops, strict=True):
        assert a <= place < b and shard.impacts[place] == top == shard.impacts[a:b].max()


# decontamination --------------------------------------------------------------------------------


def brute_hits(rows, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = words_of(text)
        hit, names = set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if found := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def planted(rnd):
    bench = [(k, prose(rnd, rnd.choice([10, 11, 14, 40]), "abcdefgh")) for k in range(12)]
    rows = []
    for i in range(150):
        parts = [prose(rnd, rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            w = words_of(rnd.choice(bench)[1])
            low = rnd.randint(0, len(w) - 1)
            parts += [" ".join(w[low : low + rnd.randint(5, 30)]).upper(), prose(rnd, rnd.randint(0, 4))]
        rows.append((i, ", ".join(parts)))
    return bench, rows


def hit_rows(docs, bench, **settings):
    return Counter(tuple(r) for r in decontaminate.digests(docs, bench, decontaminate.Settings(**settings)).collect())


@pytest.mark.parametrize("settings", [{}, {"bits_per_hash": 1, "most_bits": 64}, {"gram": 10}, {"gram": 1}])
def test_decontamination(documents, items, settings):
    bench, rows = planted(random.Random(2))
    bench += [(3, bench[4][1]), (None, bench[5][1]), (40, "a a a a a a a a a a a a a a"), (41, None), (42, "--")]
    rows += [(None, rows[3][1]), (7, rows[8][1]), (8, rows[8][1]), (8, rows[8][1]), (500, None), (501, ""), (502, "a " * 5_000)]
    assert hit_rows(documents(rows, *ODD), items(bench), **settings) == Counter(brute_hits(rows, bench))


def test_decontamination_by_short_items(documents, items):
    bench, rows = planted(random.Random(3))
    bench = bench[:3] + [(50, "A"), (51, "ab, cd"), (52, "é é é"), (53, "a b c d e f g h i"), (54, "aa b")]
    rows += [(600, "a"), (601, "é É é é é é"), (602, "a b c d e f g h i"), (603, "x a b c d e f g h i a")]
    assert hit_rows(documents(rows), items(bench)) == Counter(brute_hits(rows, bench))
    assert hit_rows(documents(rows), items(bench[3:])) == Counter(brute_hits(rows, bench[3:]))


def test_decontamination_of_nothing(documents, items):
    assert decontaminate.digests(documents([]), items([(1, "a")])).count() == 0
    got = decontaminate.report(documents([(1, "a b")]), items([])).collect()
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got] == [(2, 0, [], False)]


def test_clean_documents_stay_whole(documents, items):
    bench, rows = planted(random.Random(4))
    rows += [(None, rows[0][1]), (None, "untouched"), (900, None)]
    docs = documents(rows, *ODD)
    kept = decontaminate.clean(docs, items(bench))
    want = Counter((i, t) for (i, t), r in zip(rows, brute_hits(rows, bench), strict=True) if not r[-1])
    assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want


def test_decontamination_runs_no_python(documents, items):
    bench, rows = planted(random.Random(5))
    plan = decontaminate.digests(documents(rows[:5]), items(bench))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
