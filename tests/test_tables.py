"""Projection, filters, joins and reshaping."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import fixed, text
from helixframe.operators import tables


def texts(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_dataset_names(spark):
    names = ["H3K4me1", "splice_sites_all", "splice_sites_donors", "splice_sites_acceptors", "enhancers_types",
             "promoter_no_tata", "H2AFZ", "four_kingdoms", "enhancers"]
    assert texts(spark, text.clean_dataset_name, *names) == [
        "H3K4me1", "All", "Donors", "Acceptors", "Enhancers (types)", "Promoter (no TATA)", "H2AFZ", "Four kingdoms", "Enhancers"
    ]
    assert texts(spark, text.task_group, "H3K9ac", "enhancers", "promoter_all", "splice_sites_all", "plasmid", None) == [
        "Chromatin profiles", "Regulatory elements", "Regulatory elements", "Splicing", "Genome origin", None
    ]


def test_model_names(spark):
    names = ["seqm_4096_512_46M", "seqm_8192_512_111M", "seqm_4096_512_46M-Ms", "seqm_4096_512_89M-at-base-multi",
             "seqm_esm_4096_512_97M", "nucleotide-transformer-v2-100m-multi-species", "nt_50_avg", "seqm_4096", None]
    assert texts(spark, lambda x: text.model_family(x, "seqm"), *names) == ["DeBERTa"] * 4 + ["ESM", "NT", "NT", "DeBERTa", None]
    assert texts(spark, lambda x: text.model_size_million(x, "seqm"), *names) == [46.0, 111.0, 46.0, 89.0, 97.0, 100.0, None, None, None]
    assert texts(spark, lambda x: text.model_vocab_size(x, "seqm"), *names) == [4096.0, 8192.0, 4096.0, 4096.0, 4096.0, 4096.0, 4096.0, 4096.0, None]


def test_path_and_step_names(spark):
    assert texts(spark, text.file_stem, "a/b/c.d.csv", "plain", "x/step_10") == ["c.d", "plain", "step_10"]
    assert texts(spark, text.step_from_name, "step_123", "last", "step_", None) == [123, None, None, None]
    assert texts(spark, lambda x: text.tokenizer_source(x, "-at-base-nt", "big"), "m-at-base-nt", "m-at-base") == ["big", "m-at-base"]
    assert texts(spark, lambda x: text.percent(x.cast("double"), 1), "0.1234") == ["12.3%"]
    assert texts(spark, lambda x: text.safe_double(x), "1.5", "no", None) == [1.5, None, None]


def test_vector_columns_round_trip(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, vec array<double>")
    wide = tables.unpack_vector(df, "vec", 3)
    assert wide.columns == ["id", "v_0", "v_1", "v_2"]
    assert tables.pack_matching(wide, "^v_").first()["vec"] == [1.0, 2.0, 3.0]
    assert tables.pack_leading(wide.select("v_2", "v_0", "id"), 2).first()["vec"] == [3.0, 1.0]


def test_unknown_code_fails(spark):
    ok = spark.createDataFrame([(0,), (1,), (None,)], "label int")
    assert [r["name"] for r in tables.map_codes(ok, "label", fixed.PLASMID_LABELS, "name").collect()] == ["Chromosome", "Plasmid", None]
    with pytest.raises(Exception, match="no name for label = 7"):
        tables.map_codes(spark.createDataFrame([(7,)], "label int"), "label", fixed.PLASMID_LABELS, "name").collect()


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("é",)], "label string")
    assert {r["label"]: r["code"] for r in tables.label_codes(df, "label").collect()} == {"a": 0, "b": 1, "é": 2, None: None}


def test_membership_with_missing_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r[0] for r in df.where(tables.is_in("x", ["a"])).collect()] == ["a"]
    assert [r[0] for r in df.where(tables.not_in("x", ["a"])).collect()] == ["b", None]
    assert [r[0] for r in df.select(tables.level_order("x", ["b", "a"])).collect()] == [2, 1, None]


def test_clamp_keeps_missing(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(tables.clamp_negative(F.col("v"))).collect()] == [0.0, 2.0, None]


def test_null_keys_match(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    out = tables.left_join_nulls_match(left, right, ["k"])
    assert {r["x"]: r["y"] for r in out.collect()} == {1: 10, 2: 20, 3: None}


def test_pending_runs(spark):
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    datasets = spark.createDataFrame([("d1",), ("d2",), ("d2",)], "dataset string")
    finished = spark.createDataFrame([("m1", "d1"), ("m9", "d9")], "model string, dataset string")
    assert sorted(tuple(r) for r in tables.pending_runs(models, datasets, finished).collect()) == [
        ("m1", "d2"), ("m2", "d1"), ("m2", "d2")
    ]
    assert tables.pending_runs(models, datasets, tables.run_grid(models, datasets)).count() == 0


def test_align_by_key(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "token string, v double")
    b = spark.createDataFrame([("y", 5.0)], "token string, v double")
    out = tables.align_by_key({"a": a, "b": b}, "token", "v")
    assert {r["token"]: (r["a"], r["b"]) for r in out.collect()} == {"x": (1.0, None), "y": (2.0, 5.0)}
    with pytest.raises(Exception, match="repeated token in b: y"):
        tables.align_by_key({"a": a, "b": b.union(b)}, "token", "v").collect()


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 4.0)], "k string, test double, validation double")
    long = tables.wide_to_long(wide, ["k"], ["test", "validation"], "set", "v")
    assert long.count() == 4
    back = tables.long_to_wide(long, ["k"], "set", "v", ["test", "validation"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, wide.collect()), key=str)
    assert {r["k"]: r["difference"] for r in tables.generalisation_gap(wide).collect()} == {"a": None, "b": -1.0}


def test_concat_rows_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "t")], "x int, y string")
    assert sorted(map(tuple, tables.concat_rows(a, b).collect())) == [(1, None), (2, "t")]
