"""Corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.config import CorpusOptions
from helixframe.functions import fixed
from helixframe.operators import corpus, ordering
from helixframe.plans import flows, views
from helixframe.plans.registry import query
from helixframe.plans.views import sql

_DIGITS = " + ".join(f"(instr('ACGT', t[{i + 1}]) - 1) * {4 ** (5 - i)}" for i in range(6))
_IDS = f"""list_transform(regexp_extract_all(sequence, '[ACGT]{{6}}|.'), lambda t:
    CASE WHEN t = 'N' THEN 1 WHEN length(t) = 6 THEN 5 + {_DIGITS} ELSE 5 + 4096 - 1 + instr('ACGT', t) END)"""

_TOKENISED = {"ids": f"SELECT doc_id, lang, {_IDS} AS body FROM seqs"}
_FRAMED = _TOKENISED | {"framed": "SELECT doc_id, list_concat([2], body, [3]) AS ids FROM ids"}
_CUT = _TOKENISED | {"cut": "SELECT doc_id, list_concat([2], body[1:510], [3]) AS ids FROM ids"}
_PAD = "list_concat(ids, list_transform(range(greatest(0, {width} - len(ids))), lambda x: 0))"


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@query(
    "kmer_tokenise",
    sql("SELECT doc_id, lang, len(ids) AS n_tokens, array_to_string(ids, ',') AS input_ids FROM framed JOIN seqs USING (doc_id)", **_FRAMED),
)
def kmer_tokenise(spark, folder):
    """Token ids of whole sequences."""
    rows = corpus.tokenise(views.seqs(spark, folder).drop("source"), max_length=None)
    return rows.select("doc_id", "lang", F.size("input_ids").cast("bigint").alias("n_tokens"), _joined("input_ids"))


@query(
    "udf_batch_map",
    sql("SELECT doc_id, array_to_string(body, ',') AS input_ids FROM ids", **_TOKENISED),
)
def udf_batch_map(spark, folder):
    """The same ids from the Arrow-batched mapper."""
    rows = views.seqs(spark, folder).select("doc_id", corpus.kmer_ids_batched(F.col("sequence")).alias("input_ids"))
    return rows.select("doc_id", _joined("input_ids"))


@query(
    "pad_truncate",
    sql(
        f"""SELECT doc_id, array_to_string({_PAD.format(width=512)}, ',') AS input_ids, 
                   list_sum(list_transform(ids, lambda x: 1))::BIGINT AS n_real,
                   (512 - len(ids))::BIGINT AS n_pad FROM cut""",
        **_CUT,
    ),
)
def pad_truncate(spark, folder):
    """Model inputs of fixed length 512."""
    rows = corpus.pad(corpus.tokenise(views.seqs(spark, folder).select("doc_id", "sequence"), max_length=512), 512)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint")
    return rows.select("doc_id", _joined("input_ids"), real.alias("n_real"), (F.size("attention_mask") - real).alias("n_pad"))


_BATCHED = _FRAMED | {
    "batched": "SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM framed"
}


def _batches(spark, folder, size=16, drop_last=False):
    rows = ordering.assign_batches(views.seqs(spark, folder).select("doc_id", "sequence"), "doc_id", size, drop_last)
    return corpus.tokenise(rows)  # letters move, not ids


@query(
    "dynamic_pad",
    sql(
        f"""SELECT doc_id, batch_id, len(ids) AS n_tokens, width, array_to_string({_PAD.format(width='width')}, ',') AS input_ids
            FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM batched)""",
        **_BATCHED,
    ),
)
def dynamic_pad(spark, folder):
    rows = corpus.tokenise_in_batches(views.seqs(spark, folder).select("doc_id", "sequence"), "doc_id", 16)
    return rows.select("doc_id", "batch_id", "n_tokens", F.size("input_ids").cast("bigint").alias("width"), _joined("input_ids"))


@query(
    "udf_group_collate",
    sql(
        """SELECT batch_id, max(len(ids))::INT AS width, count(*) AS n_rows,
                  string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS keys,
                  sum(list_sum(ids))::BIGINT AS id_sum FROM batched GROUP BY batch_id""",
        **_BATCHED,
    ),
)
def udf_group_collate(spark, folder):
    rows = corpus.collate_batches(_batches(spark, folder), "doc_id")
    total = F.aggregate(F.flatten("input_ids"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "batch_id", "width", F.size("input_ids").cast("bigint").alias("n_rows"), _joined("keys"), total.alias("id_sum")
    )



def _mask_sql(rows: str = "cut") -> dict[str, str]:
    digest = f"md5('mask:{views.MASK_SEED}:0:' || doc_id || ':' || (i - 1))"
    part = lambda start: f"('0x' || substr({digest}, {start}, 8))::BIGINT"
    u1, u2 = f"{part(1)} / 4294967296::DOUBLE", f"{part(9)} / 4294967296::DOUBLE"
    vocab = corpus.kmer_vocab_size()
    shown = f"CASE WHEN {u2} < 0.8 THEN 4 WHEN {u2} < 0.9 THEN {part(17)} % {vocab} ELSE x END"
    chosen = f"x >= 5 AND {u1} < 0.15"
    return _TOKENISED | {rows: (_CUT | _FRAMED)[rows]} | {
        "masked": f"""SELECT doc_id,
            list_transform(ids, lambda x, i: CASE WHEN {chosen} THEN {shown} ELSE x END) AS input_ids,
            list_transform(ids, lambda x, i: CASE WHEN {chosen} THEN x ELSE -100 END) AS labels FROM {rows}"""
    }


@query(
    "mlm_mask",
    sql("SELECT doc_id, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels FROM masked", **_mask_sql("framed")),
)
def mlm_mask(spark, folder):
    rows = corpus.tokenise(views.seqs(spark, folder).select("doc_id", "sequence"))
    masked = corpus.mask_tokens(rows, "doc_id", corpus.kmer_vocab_size(), seed=views.MASK_SEED)
    return masked.select("doc_id", _joined("input_ids"), _joined("labels"))


def _flow_sql(batches: str) -> str:
    padded = f"list_concat({{ids}}, list_transform(range(512 - len({{ids}})), lambda x: {{fill}}))"
    ids, labels = padded.format(ids="input_ids", fill=0), padded.format(ids="labels", fill=-100)
    return f"""SELECT doc_id, batch_id, array_to_string({ids}, ',') AS input_ids, array_to_string({labels}, ',') AS labels
               FROM masked JOIN ({batches}) USING (doc_id)"""


@query(
    "training_batches",
    sql(
        _flow_sql(
            f"""SELECT doc_id, (buffer * 256 + row_number() OVER (PARTITION BY buffer
                       ORDER BY md5('shuffle:{views.MASK_SEED}:' || doc_id), doc_id) - 1) // 16 AS batch_id
                FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS buffer FROM documents)"""
        ),
        **_mask_sql(),
    ),
)
def training_batches(spark, folder):
    """Tokenise, pad, shuffle in buffers, mask and batch the whole corpus."""
    options = CorpusOptions(shuffle_buffer=256, train_batch_size=16, seed=views.MASK_SEED)
    rows = flows.training_batches(views.seqs(spark, folder).select("doc_id", "sequence"), "doc_id", options)
    return rows.select("doc_id", "batch_id", _joined("input_ids"), _joined("labels"))


@query(
    "evaluation_batches",
    sql(
        _flow_sql(
            """SELECT * FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM documents)
               WHERE batch_id <= 7"""
        ),
        **_mask_sql(),
    ),
)
def evaluation_batches(spark, folder):
    """Evaluation inputs in table order, capped at 7 steps, which keeps eight batches."""
    options = CorpusOptions(valid_batch_size=16, max_eval_steps=7, seed=views.MASK_SEED)
    rows = flows.evaluation_batches(views.seqs(spark, folder).select("doc_id", "sequence"), "doc_id", options)
    return rows.select("doc_id", "batch_id", _joined("input_ids"), _joined("labels"))


@query(
    "det_shuffle",
    sql(f"SELECT doc_id, row_number() OVER (ORDER BY md5('shuffle:{views.SHUFFLE_SEED}:' || doc_id), doc_id) - 1 AS position FROM documents"),
)
def det_shuffle(spark, folder):
    rows = views.table(spark, folder, "documents").select("doc_id")
    return ordering.shuffled_index(rows, "doc_id", views.SHUFFLE_SEED)


@query(
    "buffered_shuffle",
    sql(
        f"""SELECT doc_id, buffer * 100 + row_number() OVER (PARTITION BY buffer
                   ORDER BY md5('shuffle:{views.SHUFFLE_SEED}:' || doc_id), doc_id) - 1 AS position
            FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS buffer FROM documents)"""
    ),
)
def buffered_shuffle(spark, folder):
    rows = views.table(spark, folder, "documents").select("doc_id")
    return ordering.buffered_shuffle(rows, "doc_id", 100, views.SHUFFLE_SEED)


@query(
    "batch_drop_last",
    """SELECT doc_id, batch_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 48 AS batch_id,
           count(*) OVER () AS total FROM documents) WHERE batch_id < total // 48""",
)
def batch_drop_last(spark, folder):
    rows = views.table(spark, folder, "documents").select("doc_id")
    return ordering.assign_batches(rows, "doc_id", 48, drop_last=True)


@query(
    "eval_cap",
    """SELECT batch_id, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id
       FROM documents) WHERE batch_id <= 5 GROUP BY batch_id""",
)
def eval_cap(spark, folder):
    """Batches that an evaluation capped at 5 steps really runs: six."""
    rows = views.table(spark, folder, "documents").select("doc_id")
    capped = ordering.cap_batches(ordering.assign_batches(rows, "doc_id", 16), 5)
    return capped.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
