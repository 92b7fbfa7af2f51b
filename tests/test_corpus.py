"""Corpus preparation."""

import re

import pytest
from pyspark.sql import functions as F

from helixframe.config import CorpusOptions
from helixframe.functions import fixed
from helixframe.operators import corpus

SEQUENCES = ["", "A", "ACGTACGT", "ACGTNACGTACGT", "acgtac", "NNNNNN", "ACGTAC" * 200, "AACCGGTTAACCGGTTA\nAC", None]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(list(enumerate(SEQUENCES)), "id bigint, sequence string")


def brute_ids(text, k=6):
    out, i = [], 0
    while i < len(text):
        word = text[i : i + k]
        if len(word) == k and set(word) <= set("ACGT"):
            out.append(5 + sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(word)))
            i += k
        else:
            out.append(5 + 4**k + "ACGT".index(text[i]) if text[i] in "ACGT" else fixed.UNK)
            i += 1
    return out


def test_kmer_ids(seqs):
    got = {r["id"]: r for r in seqs.select("id", corpus.kmer_ids(F.col("sequence")).alias("a"), corpus.kmer_ids_batched(F.col("sequence")).alias("b")).collect()}
    for i, text in enumerate(SEQUENCES):
        want = None if text is None else brute_ids(text)
        assert got[i]["a"] == want and got[i]["b"] == want


def test_ids_are_dense():
    assert corpus.kmer_vocab_size() == 5 + 4096 + 4
    assert brute_ids("TTTTTT") == [5 + 4095] and brute_ids("T") == [corpus.kmer_vocab_size() - 1]


def test_truncate_and_pad(seqs):
    rows = corpus.pad(corpus.tokenise(seqs.where("sequence is not null"), max_length=64), 64).collect()
    assert "sequence" not in rows[0]
    for r in rows:
        body = brute_ids(SEQUENCES[r["id"]])[:62]
        ids = [fixed.CLS, *body, fixed.SEP]
        assert r["input_ids"] == ids + [fixed.PAD] * (64 - len(ids))
        assert r["attention_mask"] == [1] * len(ids) + [0] * (64 - len(ids))


def test_pad_in_batches(spark):
    df = spark.createDataFrame([(i, "ACGTAC" * (i % 7)) for i in range(0, 100, 3)], "id bigint, sequence string")
    rows = corpus.pad_in_batches(corpus.tokenise(df), "id", 5).orderBy("id").collect()
    for n, r in enumerate(rows):
        assert r["batch_id"] == n // 5
        mates = rows[n // 5 * 5 : n // 5 * 5 + 5]
        assert len(r["input_ids"]) == max(m["id"] % 7 for m in mates) + 2 == len(r["attention_mask"])
    assert corpus.pad_in_batches(corpus.tokenise(df), "id", 5, drop_last=True).count() == 30


def test_collate(spark):
    df = spark.createDataFrame([(i, i // 3, [9] * (i + 1)) for i in range(7)], "id bigint, batch_id bigint, input_ids array<int>")
    rows = {r["batch_id"]: r for r in corpus.collate_batches(df, "id").collect()}
    assert rows[0]["keys"] == [0, 1, 2] and rows[0]["width"] == 3
    assert rows[0]["input_ids"] == [[9, 0, 0], [9, 9, 0], [9, 9, 9]]
    assert rows[2]["input_ids"] == [[9] * 7]


def test_masking(spark):
    ids = [fixed.CLS] + [5 + i for i in range(400)] + [fixed.SEP] + [fixed.PAD] * 50
    df = spark.createDataFrame([(i, ids) for i in range(200)], "id bigint, input_ids array<int>")
    first = corpus.mask_tokens(df, "id", 4105)
    rows = first.orderBy("id").collect()
    chosen = kept = to_mask = 0
    for r in rows:
        for before, after, label in zip(ids, r["input_ids"], r["labels"]):
            if label == corpus.IGNORED_LABEL:
                assert before == after
                continue
            assert label == before >= fixed.SPECIAL_COUNT
            chosen += 1
            kept += after == before
            to_mask += after == fixed.MASK
    total = 200 * 400
    assert abs(chosen / total - 0.15) < 4 * (0.15 * 0.85 / total) ** 0.5
    assert abs(to_mask / chosen - 0.8) < 4 * (0.16 / chosen) ** 0.5
    assert abs(kept / chosen - 0.1) < 4 * (0.09 / chosen) ** 0.5
    assert rows == corpus.mask_tokens(df.repartition(3), "id", 4105).orderBy("id").collect()
    assert rows != corpus.mask_tokens(df, "id", 4105, epoch=1).orderBy("id").collect()


def test_nothing_is_cut_by_default(spark):
    df = spark.createDataFrame([(1, "ACGT" * 3000)], "id int, sequence string")
    assert len(corpus.tokenise(df).first()["input_ids"]) == 2000 + 2
    assert len(corpus.tokenise(df, max_length=512).first()["input_ids"]) == 512


def test_effective_buffer():
    assert CorpusOptions().effective_buffer() == 1280
    assert CorpusOptions(shuffle_buffer=512).effective_buffer() == 512


def test_token_pattern_is_one_regex_pass(seqs):
    plan = corpus.tokenise(seqs)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and "Exchange" not in plan and "Python" not in plan
    assert re.search("ArrowEval", seqs.select(corpus.kmer_ids_batched(F.col("sequence")))._jdf.queryExecution().executedPlan().toString())
