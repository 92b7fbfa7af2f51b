"""Readers and writers."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe import schemas
from helixframe.session import release, settle, shared_folder
from helixframe.sources import files


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def test_chunks_take_the_split_of_their_file(spark, tmp_path):
    head = "split\tassembly_id\tassembly_accession\tstart\tsequence_length\tseq_id\tsequence\n"
    train = write(f"{tmp_path}/train.txt", head + "x\ta1\tc1\t0\t4\ts1\tACGT\nx\ta1\tc1\t4\t0\ts2\t\n")
    valid = write(f"{tmp_path}/val.txt", head + "x\ta2\tc2\t0\t6\ts3\tnnACGT\n")
    df = files.read_chunks(spark, {"train": train, "valid": valid})
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.GENOME_CHUNKS]
    got = sorted((r["split"], r["seq_id"], r["sequence"]) for r in df.collect())
    assert got == [("train", "s1", "ACGT"), ("train", "s2", ""), ("valid", "s3", "nnACGT")]


def test_lines_keep_an_unfinished_last_line(spark, tmp_path):
    path = write(f"{tmp_path}/names.txt", "plasmid_detection\nfour_kingdoms")
    assert [r[0] for r in files.read_lines(spark, path, "dataset").collect()] == ["plasmid_detection", "four_kingdoms"]


def test_table_with_index_and_missing_values(spark, tmp_path):
    path = write(f"{tmp_path}/t.csv", ",score,label\n0,1.5,a\n1,NA,b\n")
    schema = T.StructType().add("score", "double").add("label", "string")
    df = files.read_table(spark, path, schema, index=True)
    assert df.columns == ["score", "label"]
    assert [tuple(r) for r in df.orderBy("label").collect()] == [(1.5, "a"), (None, "b")]


def test_variants_are_named_after_their_files(spark, tmp_path):
    paths = [
        write(f"{tmp_path}/emb{s}.csv", f"0,1,token,token_length\n{i},2,aa_c,4\n") for i, s in enumerate(["", "-Ms", "-Mp", "-Me"])
    ]
    df = files.read_variants(spark, paths, "emb", schemas.token_embedding_csv(2))
    assert sorted((r["model"], r["0"]) for r in df.collect()) == [("Me", 3.0), ("Mp", 2.0), ("Ms", 1.0), ("base", 0.0)]
    assert {r["token"] for r in df.collect()} == {"aa_c"}


def test_vector_folder(spark, tmp_path):
    head = ",v_0,v_1,vec_type,model_type,label\n"
    write(f"{tmp_path}/plasmid_fine.csv", head + "0,1.0,2.0,Mean,Fine-tuned,Plasmid\n")
    write(f"{tmp_path}/four_kingdoms.csv", head + "0,3.0,4.0,CLS,Base,Virus\n")
    rows = files.read_vector_folder(spark, f"{tmp_path}/*.csv", 2).orderBy("label").collect()
    assert [(r["dataset"], r["fine_tuned"], r["vec"]) for r in rows] == [
        ("plasmid", "Yes", [1.0, 2.0]),
        ("four_kingdom", "No", [3.0, 4.0]),
    ]


def test_results_of_full_and_adapter_runs(spark, tmp_path):
    head = "model,dataset,evaluation_set,metric,score\n"
    write(f"{tmp_path}/m1_results_d_1.csv", head + "m1,d_1,validation,eval_mcc,0.5\nm1,d_1,test,eval_mcc,\n")
    write(f"{tmp_path}/lora_32_8_m1_results_d_1.csv", head + "m1,d_1,validation,eval_mcc,0.25\nm1-LoRA,d_1,test,eval_mcc,0.75\n")
    write(f"{tmp_path}/lora_32_8_m2_results_d_2.csv", head + "m2-LoRA,d_2,validation,eval_mcc,0.1\nm2,d_2,test,eval_mcc,0.2\n")
    merged = files.normalise_methods(files.read_results(spark, f"{tmp_path}/*.csv"))
    got = sorted((r["model"], r["method"], r["evaluation_set"], r["score"]) for r in merged.fillna(-1.0).collect())
    assert got == [
        ("m1", "full", "test", -1.0),
        ("m1", "full", "validation", 0.5),
        ("m1-LoRA", "LoRA", "test", 0.75),
        ("m1-LoRA", "LoRA", "validation", 0.25),
        ("m2-LoRA", "LoRA", "test", 0.2),
        ("m2-LoRA", "LoRA", "validation", 0.1),
    ]
    runs = files.finished_runs(spark, f"{tmp_path}/m*.csv")
    assert [tuple(r) for r in runs.collect()] == [("m1", "d_1")]


def test_split_read_prunes_partitions(spark, tmp_path):
    df = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dataset"), F.lit("train").alias("split"))
    files.write_partitioned(df, f"{tmp_path}/c", "dataset", "split")
    part = files.read_split(spark, f"{tmp_path}/c", "a", "train")
    assert part.count() == 20
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan


def test_rerun_replaces_only_its_partitions(spark, tmp_path):
    root = f"{tmp_path}/p"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    files.write_partitioned(df, root, "k")
    files.write_partitioned(df.where("k = 'a'").withColumn("x", F.lit(9)), root, "k")
    assert sorted((r["x"], r["k"]) for r in spark.read.parquet(root).collect()) == [(2, "b"), (9, "a")]


def test_append(spark, tmp_path):
    for _ in range(2):
        files.append_metrics(spark.range(3), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6


def test_shared_folder_follows_the_session(spark, monkeypatch):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_folder(spark, "x")
    assert path != shared_folder(spark, "x")
    if base:
        assert path.startswith(base)


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster(), "x")


def test_settled_tables_are_broadcast_by_their_real_size(spark):
    small = settle(spark.range(1000000).groupBy((F.col("id") % 3).alias("k")).count())
    plan = spark.range(100).withColumn("k", F.col("id") % 3).join(small, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_columns_are_found_by_their_names(spark, tmp_path):
    write(f"{tmp_path}/m1_results_d_1.csv", "score,dataset,model,metric,evaluation_set\n0.5,d_1,m1,eval_mcc,test\nodd,d_1,m1,eval_mcc,test\n")
    rows = files.read_results(spark, f"{tmp_path}/*.csv").orderBy("score").collect()
    assert [(r["model"], r["dataset"], r["score"]) for r in rows] == [("m1", "d_1", None), ("m1", "d_1", 0.5)]
    write(f"{tmp_path}/m2_results_d_1.csv", "score,dataset,model,evaluation_set\n0.5,d_1,m1,test\n")
    with pytest.raises(Exception, match="metric"):
        files.read_results(spark, f"{tmp_path}/m2_results_d_1.csv").collect()


def test_folder_names_say_nothing_about_the_file(spark, tmp_path):
    folder = tmp_path / "refined plasmid+%"
    folder.mkdir()
    write(f"{folder}/kingdoms.csv", ",v_0,v_1,vec_type,model_type,label\n0,1.0,2.0,Mean,Base,Virus\n")
    row = files.read_vector_folder(spark, str(folder), 2).first()
    assert (row["dataset"], row["fine_tuned"]) == ("four_kingdom", "No")


def test_released_tables_are_gone_and_others_stay(spark):
    kept, gone = settle(spark.range(3)), settle(spark.range(4))
    release(gone, None, spark.range(2))
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()
