"""Round trips through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe import schemas
from helixframe.functions import text
from helixframe.operators import corpus, stats, tables, trainlog
from helixframe.plans import views
from helixframe.plans.queries.corpus import _FRAMED
from helixframe.plans.registry import query
from helixframe.plans.views import rounded, sql
from helixframe.session import shared_folder
from helixframe.sources import files, shards


def chunk_rows(spark, folder):
    """Sequences in the layout of genome chunk files."""
    return views.seqs(spark, folder).select(
        F.lit("").alias("split"),
        F.concat(F.lit("asm_"), F.col("source")).alias("assembly_id"),
        F.col("lang").alias("assembly_accession"),
        F.lit(0).cast("bigint").alias("start"),
        F.char_length("sequence").alias("sequence_length"),
        F.col("doc_id").cast("string").alias("seq_id"),
        F.concat(F.lit("N"), F.col("sequence")).alias("sequence"),
    )


@query(
    "scan_tsv",
    sql(
        """SELECT CASE WHEN lang = 'en' THEN 'train' ELSE 'valid' END AS split, 'asm_' || source AS assembly_id,
                  lang AS assembly_accession, 0::BIGINT AS start, length(sequence)::INT AS sequence_length,
                  doc_id::VARCHAR AS seq_id, 'N' || sequence AS sequence FROM seqs"""
    ),
)
def scan_tsv(spark, folder):
    """Chunk files written as tab-separated text, read back as two named splits."""
    root = shared_folder(spark, "tsv")
    rows = chunk_rows(spark, folder)
    files.write_csv(rows.where("assembly_accession = 'en'"), f"{root}/train", sep="\t")
    files.write_csv(rows.where("assembly_accession <> 'en'"), f"{root}/valid", sep="\t")
    return files.read_chunks(spark, {"train": f"{root}/train", "valid": f"{root}/valid"})


@query(
    "scan_csv_typed",
    sql("SELECT model, dataset, evaluation_set, metric, round(score, 6) AS score FROM results"),
)
def scan_csv_typed(spark, folder):
    """Result rows through a comma-separated file with NA for missing scores."""
    path = shared_folder(spark, "results-csv")
    files.write_csv(views.results(spark, folder).drop("event_id"), path)
    return rounded(files.read_table(spark, path, schemas.RESULTS), "score")


@query(
    "scan_csv_index",
    "SELECT vec_id, label::VARCHAR AS label, round(embedding[1]::DOUBLE, 6) AS v_0, round(embedding[2]::DOUBLE, 6) AS v_1 FROM embeddings",
)
def scan_csv_index(spark, folder):
    """A file whose first, unnamed column is a row index."""
    path = shared_folder(spark, "indexed-csv")
    rows = views.table(spark, folder, "embeddings").select(
        (F.col("vec_id") + 1000).alias("_c0"),
        "vec_id",
        F.col("label").cast("string"),
        F.get("embedding", F.lit(0)).cast("double").alias("v_0"),
        F.get("embedding", F.lit(1)).cast("double").alias("v_1"),
    )
    files.write_csv(rows, path)
    schema = T.StructType().add("vec_id", "long").add("label", "string").add("v_0", "double").add("v_1", "double")
    return rounded(files.read_table(spark, path, schema, index=True), "v_0", "v_1")


@query("scan_lines", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name")
def scan_lines(spark, folder):
    """A work list with one name per line."""
    path = shared_folder(spark, "lines")
    views.table(spark, folder, "part").select("p_name").write.text(path)
    return stats.group_counts(files.read_lines(spark, path, "name"), ["name"])


@query(
    "scan_split",
    sql("SELECT doc_id, sequence, lang AS dataset, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM seqs WHERE lang = 'fr' AND doc_id % 5 <> 0"),
)
def scan_split(spark, folder):
    """One split of one named dataset out of a partitioned corpus."""
    root = shared_folder(spark, "corpus")
    rows = views.seqs(spark, folder).select(
        "doc_id",
        "sequence",
        F.col("lang").alias("dataset"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    files.write_partitioned(rows, root, "dataset", "split", rebalance=True)
    return files.read_split(spark, root, "fr", "train")


@query(
    "route_outputs",
    sql("SELECT CASE WHEN dataset LIKE '%plasmid%' THEN 'plasmid' ELSE 'other' END AS route, count(*) AS n, count(score) AS n_scores FROM results GROUP BY ALL"),
)
def route_outputs(spark, folder):
    """Rows routed to one of two output folders by a predicate, written twice to show that a rerun replaces."""
    root = shared_folder(spark, "routes")
    rows = views.results(spark, folder).withColumn(
        "route", F.when(F.col("dataset").contains("plasmid"), "plasmid").otherwise("other")
    )
    files.write_partitioned(rows, root, "route", rows_per_file=100_000)
    files.write_partitioned(rows.where("route = 'plasmid'"), root, "route")
    return spark.read.parquet(root).groupBy(F.col("route").cast("string")).agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scores")
    )


@query(
    "scan_variant_files",
    sql("SELECT token, token_length, model, round(list_sum(vec), 5) AS total FROM tokens"),
)
def scan_variant_files(spark, folder):
    """One embedding file per variant, tagged by the file name on the way back."""
    root = shared_folder(spark, "variants")
    suffix = F.when(F.col("model") == "base", "").otherwise(F.concat(F.lit("-"), F.col("model")))
    rows = views.tokens(spark, folder).select(
        *[F.get("vec", F.lit(i)).alias(str(i)) for i in range(64)],
        "token",
        "token_length",
        F.concat(F.lit("tokenizer_embeddings"), suffix, F.lit(".csv")).alias("file"),
    )
    files.write_named_csv(rows, root, "file")
    read = files.read_variants(spark, f"{root}/*", "tokenizer_embeddings", schemas.token_embedding_csv(64))
    packed = tables.pack_leading(read, 64)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return packed.select("token", "token_length", "model", F.round(total, 5).alias("total"))


@query(
    "scan_vector_folder",
    sql(
        """SELECT CASE WHEN vec_type = 'Mean' THEN 'plasmid' ELSE 'four_kingdom' END AS dataset, fine_tuned, vec_type, p.label::VARCHAR AS label,
                  count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total
           FROM (SELECT vec_id, "Label" AS label, vec_type, fine_tuned FROM points) p JOIN embeddings USING (vec_id) GROUP BY ALL"""
    ),
)
def scan_vector_folder(spark, folder):
    """Vector files whose dataset and fine-tuning state are in their names."""
    root = shared_folder(spark, "vectors")
    rows = views.points(spark, folder).join(views.table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id")
    name = F.concat(
        F.when(F.col("vec_type") == "Mean", "plasmid").otherwise("four_kingdoms"),
        F.when(F.col("fine_tuned") == "Yes", "_fine.csv").otherwise(".csv"),
    )
    cells = [F.get("embedding", F.lit(i)).cast("double").alias(f"v_{i}") for i in range(64)]
    tags = ["vec_type", F.lit("Base").alias("model_type"), F.col("Label").alias("label")]
    files.write_named_csv(rows.select(F.col("vec_id").alias("_c0"), *cells, *tags, name.alias("file")), root, "file")
    read = files.read_vector_folder(spark, f"{root}/*", 64)
    total = F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))
    return read.groupBy("dataset", "fine_tuned", "vec_type", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(total, 4).alias("total")
    )


def _result_files(spark, folder):
    """One result file per model and dataset; adapter runs are named after their model, and only their test rows carry the suffix."""
    root = shared_folder(spark, "runs")
    rows = views.results(spark, folder).drop("event_id")
    adapter, bare = F.col("model").endswith("-LoRA"), F.regexp_replace("model", "-LoRA$", "")
    named = rows.select(
        F.when(F.col("evaluation_set") == "test", F.col("model")).otherwise(bare).alias("model"),
        "dataset",
        "evaluation_set",
        "metric",
        "score",
        F.concat(F.when(adapter, "lora_32_8_").otherwise(""), text.result_file_name(bare, F.col("dataset")), F.lit(".csv")).alias("file"),
    )
    files.write_named_csv(named, root, "file")
    return f"{root}/*"


@query(
    "merge_results",
    sql(
        """SELECT model, CASE WHEN model LIKE '%-LoRA' THEN 'LoRA' ELSE 'full' END AS method, dataset, evaluation_set, metric,
                  count(*) AS n, count(score) AS n_scores, round(sum(score), 5) AS total FROM results GROUP BY ALL"""
    ),
)
def merge_results(spark, folder):
    """Result files of all models merged, with one model name per adapter run."""
    merged = files.normalise_methods(files.read_results(spark, _result_files(spark, folder)))
    return merged.groupBy("model", "method", "dataset", "evaluation_set", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scores"), F.round(F.sum("score"), 5).alias("total")
    )


@query("finished_runs", sql("SELECT DISTINCT regexp_replace(model, '-LoRA$', '') AS model, dataset FROM results"))
def finished_runs(spark, folder):
    """Runs that need not be started again, from the names of their result files."""
    return files.finished_runs(spark, _result_files(spark, folder))


@query(
    "normalise_lora",
    sql(
        """SELECT event_id, CASE WHEN method = 'LoRA' THEN regexp_replace(model, '-LoRA$', '') || '-LoRA' ELSE model END AS model, method
           FROM (SELECT event_id, CASE WHEN dataset LIKE 'spl%' THEN 'LoRA' ELSE 'full' END AS method,
                        CASE WHEN dataset LIKE 'spl%' AND evaluation_set = 'test' THEN model || '-LoRA' ELSE model END AS model FROM results)"""
    ),
)
def normalise_lora(spark, folder):
    method = F.when(F.col("dataset").startswith("spl"), "LoRA").otherwise("full")
    rows = views.results(spark, folder).withColumn("method", method)
    broken = F.when((F.col("method") == "LoRA") & (F.col("evaluation_set") == "test"), F.concat("model", F.lit("-LoRA")))
    rows = rows.withColumn("model", F.coalesce(broken, F.col("model")))
    return files.normalise_methods(rows).select("event_id", "model", "method")


@query(
    "append_log",
    sql(
        """SELECT run::VARCHAR AS run, small_step AS step, epoch_us(ts) AS ts, 'micro' AS kind, 'loss_per_step/train' AS metric, round(loss, 6) AS score FROM log
           UNION ALL SELECT run::VARCHAR, small_step, epoch_us(ts), 'micro', 'small_steps', small_step::DOUBLE FROM log
           UNION ALL SELECT run::VARCHAR, max(small_step), epoch_us(max_by(ts, small_step)), 'step', 'loss/train', round(sum(loss / 4), 6) FROM log
           GROUP BY run, (small_step - 1) // 4 HAVING count(*) = 4"""
    ),
)
def append_log(spark, folder):
    """Log records of two kinds with different metrics, appended in two goes, one row per metric."""
    path = shared_folder(spark, "log")
    log = views.log(spark, folder)
    micro = F.create_map(
        F.lit("loss_per_step/train"), F.col("loss"), F.lit("small_steps"), F.col("small_step").cast("double")
    )

    def records(rows, kind, metrics):
        return rows.select(
            F.col("run").cast("string").alias("run"),
            F.col("small_step").alias("step"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.lit(kind).alias("kind"),
            metrics.alias("metrics"),
        )

    files.append_metrics(records(log, "micro", micro), path)
    steps = trainlog.loss_rollup(log, 4, last=["ts"])
    files.append_metrics(records(steps, "step", F.create_map(F.lit("loss/train"), F.col("loss"))), path)
    read = spark.read.schema(schemas.TRAIN_LOG).parquet(path)
    read = read.withColumn("ts", F.unix_micros("ts"))
    return rounded(tables.metrics_to_rows(read, ["run", "step", "ts", "kind"]), "score")


_PER_SHARD = 48


@query(
    "pretokenised_write",
    sql(
        f"""SELECT doc_id, position, position // {_PER_SHARD} AS shard, array_to_string(ids, ',') AS input_ids
            FROM framed JOIN (SELECT doc_id, row_number() OVER (ORDER BY md5('shuffle:{views.SHUFFLE_SEED}:' || doc_id), doc_id) - 1 AS position
                              FROM documents) USING (doc_id)""",
        **_FRAMED,
    ),
)
def pretokenised_write(spark, folder):
    """The tokenised corpus as shards of equal size; a second run finds nothing missing."""
    path = shared_folder(spark, "shards")
    rows = corpus.tokenise(views.seqs(spark, folder).select("doc_id", "sequence"))
    for _ in range(2):
        shards.write_shards(rows, path, "doc_id", _PER_SHARD, views.SHUFFLE_SEED)
    found = shards.read_shards(spark, path, rows)
    return found.select("doc_id", "position", "shard", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"))
