"""Near duplicates, windows, filters and the corpus profile against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.config import NearDuplicateOptions, QualityOptions, WindowOptions
from helixframe.operators import curation, dedup, graph, windows

OTHER = str.maketrans("ACGT", "TGCA")


def strand(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def edited(rnd, text, changes):
    out = list(text)
    for at in rnd.sample(range(len(out)), changes):
        out[at] = rnd.choice("ACGT")
    return "".join(out)


def other_strand(text):
    return text.translate(OTHER)[::-1]


# near duplicates --------------------------------------------------------------------------------


def kmers(text, k):
    text = text or ""
    size = min(k, len(text))
    found = {text[i : i + size] for i in range(len(text) - size + 1)} if size else set()
    return {min(x, other_strand(x)) for x in found if set(x) <= set("ACGT")}


def brute_groups(rows, options):
    sets = [(key, kmers(text, options.k)) for key, text in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) >= options.threshold * len(a | b):
                links += 1
                parent[root(i)] = root(j)
    names = {}
    for i, (key, own) in enumerate(sets):
        if key is not None and own:
            names[root(i)] = min(key, names.get(root(i), key))
    return [(key, len(own), names.get(root(i)) if own else key) for i, (key, own) in enumerate(sets)], links


def copies(rnd, n_families, n_copies, length=400, most=6):
    rows = []
    for _ in range(n_families):
        base = strand(rnd, length)
        for _ in range(rnd.randint(1, n_copies)):
            text = edited(rnd, base, rnd.randint(0, most))
            rows.append(other_strand(text) if rnd.random() < 0.5 else text)
    return rows


@pytest.mark.parametrize(
    "options",
    [
        NearDuplicateOptions(k=11),
        NearDuplicateOptions(k=7, threshold=0.6, bands=24, rows=3, leader_rounds=0, small_bucket=2, splits=1),
    ],
)
def test_near_duplicates(spark, options):
    rnd = random.Random(3)
    texts = copies(rnd, 40, 6)
    whole = strand(rnd, 300)
    texts += [whole] * 25 + [other_strand(whole)] * 5 + [edited(rnd, whole, 2) for _ in range(30)]  # a large group
    texts += ["", None, "ACG", "CGT", "AAAAA", "NNNNNNNNNNNNNNN", whole[:150] + "N" + whole[150:], "ACGT" * 6000]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [(5, texts[0]), (5, texts[-1]), (None, texts[1]), (None, None)]
    df = spark.createDataFrame(rows, "seq_id bigint, sequence string").withColumns({c: F.lit("x") for c in ("set", "n", "a", "b", "component")})
    got = Counter(map(tuple, dedup.near_duplicates(df, options=options).collect()))
    want, links = brute_groups(rows, options)
    assert links > 300 and got == Counter(want)
    if options.leader_rounds == 0:
        return
    kept = dedup.drop_near_duplicates(df, options=options)
    assert kept.columns == df.columns
    names = Counter(key for key, _, group in want if key is not None and key == group) + Counter({None: 2})
    assert Counter(r["seq_id"] for r in kept.collect()) == names


def test_recall_of_sketches_against_all_pairs(spark):
    """Of the pairs that link, the share that ends in one group: at least 0.9, without the help of other copies."""
    rnd, options = random.Random(8), NearDuplicateOptions(k=11)
    pairs = [(base := strand(rnd, 500), edited(rnd, base, rnd.randint(2, 5))) for _ in range(400)]
    rows = [(2 * i + side, p[side]) for i, p in enumerate(pairs) for side in (0, 1)]
    groups = {r["seq_id"]: r["group_id"] for r in dedup.near_duplicates(spark.createDataFrame(rows, "seq_id bigint, sequence string"), options=options).collect()}
    alike = lambda a, b: len(a & b) >= options.threshold * len(a | b)
    linked = [i for i, (x, y) in enumerate(pairs) if alike(kmers(x, 11), kmers(y, 11))]
    found = [i for i in linked if groups[2 * i] == groups[2 * i + 1]]
    print(f"recall {len(found) / len(linked):.4f} of {len(linked)} pairs")
    assert len(linked) > 100 and len(found) >= 0.9 * len(linked)
    assert sum(groups[2 * i] == groups[2 * i + 1] for i in range(400)) == len(found)


@pytest.mark.parametrize("splits", [0, 2])
def test_unlike_sets_of_a_bucket_do_not_meet_their_sequences(spark, monkeypatch, splits):
    """Texts that share a passage share buckets; only pairs that can be alike are compared letter by letter."""
    rnd, options = random.Random(5), NearDuplicateOptions(k=11, leader_rounds=0, small_bucket=8, splits=splits)
    passage = strand(rnd, 300)
    texts = [passage + strand(rnd, rnd.randint(200, 400)) for _ in range(120)]
    texts += [edited(rnd, x, 2) for x in texts[:20]] + [x[:3] + x for x in texts[20:30]]
    rows, met, verify = list(enumerate(texts)), [], dedup.verified_pairs

    def counted(pairs, *rest):
        met.append(pairs.distinct().count())
        return verify(pairs, *rest)

    monkeypatch.setattr(dedup, "verified_pairs", counted)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # sets of a bucket come in several batches
    try:
        got = Counter(map(tuple, dedup.near_duplicates(spark.createDataFrame(rows, "seq_id bigint, sequence string"), options=options).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want, links = brute_groups(rows, options)
    assert got == Counter(want) and 20 < sum(met) < 2 * links


def test_profiles_rule_out_no_pair_that_is_alike(spark):
    rnd, options = random.Random(6), NearDuplicateOptions(k=11)
    texts = [strand(rnd, n) for n in (11, 12, 15, 20, 40, 90, 300, 900, 3000, 20_000) for _ in range(6)]
    texts += [edited(rnd, x, len(x) // 150) for x in texts] + [x + strand(rnd, len(x) // 8) for x in texts] + [x + strand(rnd, 2 * len(x)) for x in texts]
    rows = {r["key"]: r for r in dedup.sketches(spark.createDataFrame(list(enumerate(texts)), "i bigint, t string"), "i", "t", options).collect()}
    alike, sets = dedup._alike(options), [kmers(t, 11) for t in texts]
    part = lambda i: (np.array([rows[i]["n"]]), np.array([rows[i]["profile"]], dtype=np.int64).view(np.uint64))
    true = [(i, j) for i in range(60) for j in (i + 60, i + 120) if len(sets[i] & sets[j]) >= options.threshold * len(sets[i] | sets[j])]
    assert all(rows[i]["n"] == len(x) and len(rows[i]["bands"]) == options.bands for i, x in enumerate(sets))
    assert len(true) > 50 and all(alike(*part(i), *part(j))[0] for i, j in true)
    assert not any(alike(*part(i), *part(j))[0] for i in range(30, 60) for j in [i + 180, *range(60)] if i // 6 != j // 6 or i != j and j < 60)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "seq_id bigint, sequence string")
    assert dedup.near_duplicates(empty).count() == 0 and dedup.drop_near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(7, i) for i in range(300, 400)] + [(9, 9), (1, 400), (1, 400)]
    got = {r["vertex"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got) == {*range(200, 261), 7, 1, 400, *range(300, 400)}
    assert {got[i] for i in range(200, 261)} == {200} and {got[i] for i in [7, *range(300, 400)]} == {7} or got[400] == 1
    assert got[400] == 1 and got[350] == 7 and got[1] == 1
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert graph.connected_components(none).count() == 0


# windows ----------------------------------------------------------------------------------------


def brute_windows(text, o):
    text = text or ""
    out, at = [], 0
    while at < len(text) and (at == 0 or at - o.stride + o.width < len(text)):
        piece = text[at : at + o.width]
        if len(piece) == o.width or o.keep_rest:
            out.append((at // o.stride, at, len(piece), piece))
        at += o.stride
    return out


@pytest.mark.parametrize("keep_rest", [True, False])
@pytest.mark.parametrize("width,stride,per_block", [(10, 4, 3), (10, 10, 1), (7, 9, 2), (1, 1, 5), (512, 256, 4096)])
def test_windows(spark, width, stride, per_block, keep_rest):
    rnd = random.Random(width)
    o = WindowOptions(width, stride, keep_rest, per_block, windows_per_task=16)
    texts = {i: strand(rnd, n) for i, n in enumerate([0, 1, 6, 7, 9, 10, 11, 13, 14, 18, 19, 28, 40, 41, 300, 1023, 1024, 1025])} | {50: None}
    df = spark.createDataFrame(list(texts.items()), "id bigint, sequence string")
    want = Counter((i, *w) for i, t in texts.items() for w in brute_windows(t, o))
    for parts in (windows.pieces(df, "id", "sequence", 6), windows.pieces(df, "id", "sequence", 500), df.selectExpr("id", "0 as start", "sequence")):
        got = windows.cut_windows(parts.orderBy(F.rand(1)), "id", options=o)
        assert Counter(map(tuple, got.collect())) == want
        counts = {r["id"]: (r["length"], r["n_windows"]) for r in windows.window_counts(parts, "id", options=o).collect()}
        assert all(counts.get(i, (0, 0)) == (len(t or ""), len(brute_windows(t, o))) for i, t in texts.items())


def test_one_long_sequence_spreads_over_many_tasks(spark):
    text = strand(random.Random(1), 200_000)
    lines = windows.pieces(spark.createDataFrame([("c1", text)], "seq_id string, sequence string"), "seq_id", "sequence", 80)
    o = WindowOptions(100, 50, windows_per_block=64, windows_per_task=400)
    cut = windows.cut_windows(lines, "seq_id", options=o).withColumn("task", F.spark_partition_id())
    rows = cut.collect()
    assert len(rows) == len(brute_windows(text, o)) and len({r["task"] for r in rows}) >= 8
    assert all(r["sequence"] == text[r["start"] : r["start"] + 100] for r in rows)


def test_windows_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, start bigint, sequence string")
    assert windows.cut_windows(empty, "id").count() == 0


# filters ----------------------------------------------------------------------------------------

TEXTS = ["", "a", "a\n", "\n", "\n\n", "ab cd\n\nxyz", "é ü\t1", "-- --", "x" * 1001, "word " * 50, " lead", "日本 語", None, "q w e r t y\r\nz"]


def test_line_stats(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string").withColumn("_line", F.lit(1))
    got = {r["id"]: r for r in curation.line_stats(df, "text").collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        if text is None:
            assert r["line_max"] is r["line_mean"] is r["alnum_fraction"] is r["token_ratio"] is None
            continue
        lines = [len(x) for x in (text[:-1] if text.endswith("\n") else text).split("\n")]
        tokens = text.split()
        plain = sum(c.isalnum() for c in text)
        assert (r["line_max"], r["line_mean"]) == (max(lines), pytest.approx(sum(lines) / len(lines)))
        assert r["alnum_fraction"] == pytest.approx(plain / len(text) if text else 0.0)
        assert r["token_ratio"] == (pytest.approx(len(text) / len(tokens)) if tokens else None)


def test_quality_filter_and_its_reasons(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    o = QualityOptions(line_max=1000, line_mean=100, alnum_fraction=0.25, token_ratio=1.5)
    why = {r["id"]: r["why"] for r in curation.line_stats(df, "text").select("id", curation.quality_verdict(o).alias("why")).collect()}
    assert why[0] == why[3] == "alnum_fraction" and why[8] == "line_max" and why[9] == "line_mean" and why[1] == "token_ratio"
    assert why[12] == "line_max" and why[5] is None
    kept = curation.quality_filter(df, "text", o)
    assert kept.columns == ["id", "text"] and {r["id"] for r in kept.collect()} == {i for i, w in why.items() if w is None}


def test_drops_by_class_do_not_depend_on_partitions(spark):
    rows = [(i, ["config", "test", "other", None][i % 4]) for i in range(4000)] + [(None, "config"), (8, "config"), (8, "other")]
    df = spark.createDataFrame(rows, "id bigint, kind string")
    classes = {"config": (F.col("kind") == "config", 0.7), "test": (F.col("kind") == "test", 1.0), "low": (F.col("id") < 0, 1.0)}
    kept = lambda part: Counter(map(tuple, curation.drop_by_class(part, classes, ["id"], 3).collect()))
    first = kept(df)
    assert first == kept(df.repartition(7, "kind")) and first != Counter(map(tuple, curation.drop_by_class(df, classes, ["id"], 4).collect()))
    share = sum(n for (_, kind), n in first.items() if kind == "config") / 1000
    assert abs(share - 0.3) < 0.05 and not any(kind == "test" for _, kind in first)
    assert sum(n for (_, kind), n in first.items() if kind in ("other", None)) == 2001

    def goes(i):
        return int(hashlib.md5(f"drop:config:3:{'' if i is None else i}".encode()).hexdigest()[:8], 16) < 0.7 * 2**32

    assert all(((i, "config") in first) == (not goes(i)) for i, kind in rows if kind == "config")
    assert curation.drop_by_class(df.limit(0), classes, ["id"], 3).count() == 0


def test_corpus_profile(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["x", "y", None]), rnd.choice(["p", "q", None]), rnd.choice([None, *range(3000)]), rnd.randint(0, 9)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "domain string, assembly string, genome bigint, n int")
    got = curation.corpus_profile(df, ["domain", "assembly"], F.col("genome"), F.col("n")).collect()
    want = {}
    for d, a, g, n in rows:
        for key in ((d, a, 2), (d, None, 1), (None, None, 0)):
            c = want.setdefault(key, [0, 0, set()])
            c[0], c[1] = c[0] + 1, c[1] + n
            c[2] |= {g} - {None}
    assert {(r["domain"], r["assembly"], r["level"]): (r["n_chunks"], r["n_letters"], r["n_genomes"]) for r in got} == {
        k: (c, s, len(g)) for k, (c, s, g) in want.items()
    }
    assert len(got) == len(want) and all(math.isclose(r["n_genomes_sketch"], r["n_genomes"], rel_tol=0.05) for r in got)
    assert [r["n_chunks"] for r in curation.corpus_profile(df.limit(0), ["domain", "assembly"], F.col("genome"), F.col("n")).collect()] in ([], [0])


def test_profile_moves_no_rows_unaggregated(spark):
    df = spark.createDataFrame([("x", "p", 1, 2)], "domain string, assembly string, genome bigint, n int")
    plan = curation.corpus_profile(df, ["domain", "assembly"], F.col("genome"), F.col("n"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
