"""Stand-in inputs derived from the given tables, in Spark and as SQL.

Each view has a function (spark, folder) -> DataFrame and a common table
expression of the same name in ``SQL``; ``sql(...)`` puts the needed ones in front
of a statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.config import ReportNames
from helixframe.functions.hashing import uniform
from helixframe.functions.vector import as_double
from helixframe.operators.folds import assign_folds
from helixframe.operators.ordering import int_block, row_index

FOLD_SEED, PRED_SEED, SHUFFLE_SEED, MASK_SEED = 123, 7, 42, 1

# Stand-in names of the own models, made by a rule in the shape that score files use:
# prefix, vocabulary, width, size in millions, suffix of a variant or head.
PREFIX = "seqm"


def own_model(size: int, vocabulary: int = 4096, family: str = "", suffix: str = "") -> str:
    return "_".join([PREFIX, *([family] if family else []), str(vocabulary), "512", f"{size}M"]) + suffix


def foreign_model(size: int) -> str:
    """A name of the other family: version, size and data, between hyphens."""
    return f"nucleotide-transformer-v2-{size}m-multi-species"


SIZES = [10 * 2**i for i in range(4)]
MIDDLE, LARGEST, FOREIGN = SIZES[2], SIZES[-1], (50, 100)
LENDER = own_model(LARGEST, suffix="-at-base")
CONTINUED = {tag: own_model(MIDDLE, suffix=f"-{tag}") for tag in ("Mp", "Ms", "Me")}
HEADS = {head: f"pooled_{head}" for head in ("max", "concat", "mean")}
ADAPTERS = [f"{LENDER}-LoRA", "NT-100-LoRA"]
MODELS = [
    *map(own_model, SIZES),
    *(own_model(size + 5, vocabulary=2**bits) for bits in (13, 14) for size in SIZES[:2]),
    *(own_model(size + 10, family="esm") for size in SIZES[2:]),
    *map(foreign_model, FOREIGN),
    *CONTINUED.values(),
    *HEADS.values(),
    LENDER,
    *ADAPTERS,
    f"{PREFIX}_4096",  # too few parts
]
DATASETS = [
    "H3K4me1",
    "splice_sites_all",
    "enhancers_types",
    "promoter_no_tata",
    "promoter_tata",
    "plasmid_detection",
    "four_kingdoms",
]
_SHOWN = {foreign_model(size): f"NT-{size}" for size in FOREIGN}


def _slice(*models: str) -> list[tuple[str, str]]:
    return [(m, _SHOWN.get(m, m)) for m in models]


NAMES = ReportNames(
    prefix=PREFIX,
    excluded=(*CONTINUED.values(), *HEADS.values()),
    slices={
        "pooling_heads": [(foreign_model(FOREIGN[0]), "[CLS]"), *((name, head.title()) for head, name in HEADS.items())],
        "continual": _slice(own_model(MIDDLE), *CONTINUED.values()),
        "architecture": _slice(*map(own_model, SIZES), LENDER),
        "family": _slice(*map(foreign_model, FOREIGN), *(own_model(size + 10, family="esm") for size in SIZES[2:]), LENDER),
        "lora_vs_full": _slice(LENDER, foreign_model(FOREIGN[1]), *ADAPTERS),
    },
    variants={"base": own_model(MIDDLE)} | CONTINUED,
    lender=LENDER,
)
METRICS = ["eval_mcc", "eval_accuracy", "eval_f1_score", "eval_samples_per_second"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(names: list[str], index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def seqs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return spread(documents, "doc_id").select("doc_id", "lang", "source", letters(F.col("text")).alias("sequence"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table dealt out by key: pieces of a file are no measure, as a row group falls to one of them however large it is."""
    return df.repartition(key)


_NUCLEOTIDES, _ASCII = "ACGTacgt", [chr(i) for i in range(1, 128)]
_OTHERS = "".join(c for c in _ASCII if c not in _NUCLEOTIDES)


def letters(text):
    """A text as a sequence: every character is kept, those that are no nucleotide as N."""
    plain = F.translate(text, _OTHERS + "acgt", "N" * len(_OTHERS) + "ACGT")
    return F.regexp_replace(plain, "[^ACGTN]", "N")


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_BASES = "".join("ACGT"[i % 4] for i in range(len(_ALPHABET)))


def strands(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as genome chunks: every letter a-z stands for a nucleotide, all else is left out."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return spread(documents, "doc_id").select("doc_id", "lang", "source", nucleotides(F.col("text")).alias("sequence"))


def nucleotides(text):
    letters_first = _ALPHABET + _ALPHABET.upper()
    others = "".join(c for c in _ASCII if c not in letters_first)  # beyond the replacements, so left out
    return F.regexp_replace(F.translate(text, letters_first + others, _BASES * 2), "[^ACGT]", "")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Three classification tasks: (dataset, id, label, k)."""
    tags = table(spark, folder, "labels")
    vectors = table(spark, folder, "embeddings")
    task = lambda df, name, key, label, k: df.select(
        F.lit(name).alias("dataset"), F.col(key).alias("id"), F.col(label).alias("label"), F.lit(k).alias("k")
    )
    return (
        task(tags, "quality", "doc_id", "quality", 2)
        .unionByName(task(tags, "toxic", "doc_id", "toxic", 2))
        .unionByName(task(vectors, "class10", "vec_id", "label", 10))
    )


def preds(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with a stand-in prediction that is wrong for about a fifth of the rows."""
    wrong = uniform("pred", PRED_SEED, "dataset", "id") < 0.2
    return labelled(spark, folder).withColumn(
        "pred", F.when(wrong, (F.col("label") + 1) % F.col("k")).otherwise(F.col("label"))
    )


def folded(spark: SparkSession, folder: str) -> DataFrame:
    return assign_folds(preds(spark, folder), "id", 10, FOLD_SEED, by=["dataset"])


def results(spark: SparkSession, folder: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    return table(spark, folder, "events").select(
        "event_id",
        _pick(MODELS, user % len(MODELS)).alias("model"),
        _pick(DATASETS, F.expr("event_id div 3") % len(DATASETS)).alias("dataset"),
        F.when(event % 11 == 0, "test").otherwise("validation").alias("evaluation_set"),
        _pick(METRICS, (event + user) % len(METRICS)).alias("metric"),
        F.when(event % 997 != 0, (F.col("value") - 100.0) / 333.0).alias("score"),
    )


def log(spark: SparkSession, folder: str, settled: bool = False) -> DataFrame:
    """Steps of a run; ``settled`` (a job) for those who read them several times."""
    indexed = row_index(
        table(spark, folder, "events"), ["event_id"], int_block("event_id"), keys=["user_id"], name="_no", settled=settled
    )
    return indexed.select(
        F.col("user_id").alias("run"),
        (F.col("_no") + 1).alias("small_step"),
        "event_id",
        "ts",
        (F.col("value") / 333.0).alias("loss"),
        (F.col("event_id") % 4).alias("rank"),
    )


def hidden(spark: SparkSession, folder: str) -> DataFrame:
    vec_id = F.col("vec_id")
    seq_id = F.expr("vec_id div 8")
    return table(spark, folder, "embeddings").select(
        seq_id.alias("seq_id"),
        (vec_id % 8).alias("pos"),
        F.when(vec_id % 8 < (seq_id % 6), 1).otherwise(0).alias("mask"),
        as_double(F.col("embedding")).alias("vec"),
        "label",
    )


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token vectors of a base model and three drifted variants."""
    v = F.col("vec_id")
    word = F.translate(F.conv((v * v + 300).cast("string"), 10, 4), "0123", "acgt")
    base = table(spark, folder, "embeddings").select(
        "vec_id", word.alias("token"), F.char_length(word).alias("token_length"), as_double(F.col("embedding")).alias("_b")
    )
    kinds = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(s).alias("_s")) for m, s in (("base", 0.0), ("Ms", 0.01), ("Mp", 0.03), ("Me", 0.05))]
    )
    moved = F.transform("_b", lambda x, i: x + F.col("_s") * ((i + v) % 5 - 2))
    return base.select("*", F.inline(kinds)).select("vec_id", "token", "token_length", "model", moved.alias("vec"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Two-dimensional coordinates with label and facet columns."""
    v = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.get("embedding", F.lit(0)).cast("double").alias("UMAP1"),
        F.get("embedding", F.lit(1)).cast("double").alias("UMAP2"),
        F.col("label").cast("string").alias("Label"),
        _pick(["Mean", "Max", "CLS"], v % 3).alias("vec_type"),
        F.when(F.expr("vec_id div 3") % 2 == 0, "Yes").otherwise("No").alias("fine_tuned"),
    )


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def sql_uniform(purpose: str, seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{purpose}:{seed}:' || {key}), 1, 8))::BIGINT / 4294967296::DOUBLE)"


SQL = {
    "seqs": """
        SELECT doc_id, lang, source, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS sequence FROM documents""",
    "strands": f"""
        SELECT doc_id, lang, source,
               regexp_replace(translate(text, '{_ALPHABET + _ALPHABET.upper()}', '{_BASES * 2}'), '[^ACGT]', '', 'g') AS sequence FROM documents""",
    "labelled": """
        SELECT 'quality' AS dataset, doc_id AS id, quality AS label, 2 AS k FROM labels
        UNION ALL SELECT 'toxic', doc_id, toxic, 2 FROM labels
        UNION ALL SELECT 'class10', vec_id, label, 10 FROM embeddings""",
    "preds": f"""
        SELECT *, CASE WHEN {sql_uniform('pred', PRED_SEED, "dataset || ':' || id")} < 0.2
                  THEN (label + 1) % k ELSE label END AS pred FROM labelled""",
    "folded": f"""
        SELECT *, ntile(10) OVER (PARTITION BY dataset
                  ORDER BY md5('fold:{FOLD_SEED}:' || dataset || ':' || id), id)::INT AS fold FROM preds""",
    "results": f"""
        SELECT event_id, {_list(MODELS)}[user_id % {len(MODELS)} + 1] AS model,
               {_list(DATASETS)}[(event_id // 3) % {len(DATASETS)} + 1] AS dataset,
               CASE WHEN event_id % 11 = 0 THEN 'test' ELSE 'validation' END AS evaluation_set,
               {_list(METRICS)}[(event_id + user_id) % {len(METRICS)} + 1] AS metric,
               CASE WHEN event_id % 997 <> 0 THEN (value - 100) / 333 END AS score
        FROM events""",
    "log": """
        SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS small_step,
               event_id, ts, value / 333 AS loss, event_id % 4 AS rank FROM events""",
    "hidden": """
        SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos,
               CASE WHEN vec_id % 8 < (vec_id // 8) % 6 THEN 1 ELSE 0 END AS mask,
               embedding::DOUBLE[] AS vec, label FROM embeddings""",
    "hidden_cells": """
        SELECT seq_id, pos, mask, label, unnest(range(64)) AS dim, unnest(vec) AS x FROM hidden""",
    "tokens": """
        SELECT vec_id, translate(to_base(vec_id * vec_id + 300, 4), '0123', 'acgt') AS token,
               length(to_base(vec_id * vec_id + 300, 4))::INT AS token_length, m.model,
               list_transform(embedding::DOUBLE[], lambda x, i: x + m.s * ((i - 1 + vec_id) % 5 - 2)) AS vec
        FROM embeddings CROSS JOIN (VALUES ('base', 0.0::DOUBLE), ('Ms', 0.01::DOUBLE), ('Mp', 0.03::DOUBLE), ('Me', 0.05::DOUBLE)) m(model, s)""",
    "token_cells": """
        SELECT token, model, unnest(range(64)) AS dim, unnest(vec) AS x FROM tokens""",
    "points": """
        SELECT vec_id, embedding[1]::DOUBLE AS UMAP1, embedding[2]::DOUBLE AS UMAP2, label::VARCHAR AS "Label",
               ['Mean', 'Max', 'CLS'][vec_id % 3 + 1] AS vec_type,
               CASE WHEN (vec_id // 3) % 2 = 0 THEN 'Yes' ELSE 'No' END AS fine_tuned FROM embeddings""",
}

# Views a view reads; each comes before those that use it.
_NEEDS = {
    "preds": ["labelled"],
    "folded": ["labelled", "preds"],
    "hidden_cells": ["hidden"],
    "token_cells": ["tokens"],
}


def sql(statement: str, **extra: str) -> str:
    """The statement with the views it names, and ``extra`` ones, as WITH clauses."""
    named = [v for v in SQL if re.search(rf"\b{v}\b", statement + " ".join(extra.values()))]
    wanted: list[str] = []
    for view in named:
        for v in [*_NEEDS.get(view, []), view]:
            if v not in wanted:
                wanted.append(v)
    clauses = [f"{v} AS ({SQL[v]})" for v in SQL if v in wanted]
    clauses += [f"{name} AS ({body})" for name, body in extra.items()]
    return ("WITH " + ",\n".join(clauses) + "\n" if clauses else "") + statement


def sql_scores(source: str, keys: str) -> dict[str, str]:
    """Clauses that end in ``scores``: accuracy, F1 and MCC per ``keys``."""
    return {
        "cm": f"SELECT {keys}, label, pred, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL",
        "cls": f"""SELECT {keys}, cls, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM (
            SELECT {keys}, label AS cls, n AS t, 0 AS p, CASE WHEN label = pred THEN n ELSE 0 END AS tp FROM cm
            UNION ALL SELECT {keys}, pred, 0, n, 0 FROM cm) GROUP BY ALL""",
        "sums": f"""SELECT {keys}, sum(t) AS s, sum(tp) AS c, sum(p * t) AS pt, sum(p * p) AS pp,
            sum(t * t) AS tt, sum(t * 2 * tp / (p + t)) AS f1 FROM cls GROUP BY ALL""",
        "scores": f"""SELECT {keys}, c / s AS accuracy, f1 / s AS f1_score,
            CASE WHEN sqrt(s * s - pp) * sqrt(s * s - tt) = 0 THEN 0
                 ELSE (c * s - pt) / (sqrt(s * s - pp) * sqrt(s * s - tt)) END AS mcc FROM sums""",
    }


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sql_rounded(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
