"""Corpus pipeline over ``documents``: quality rules, SimHash near-dedup, substring dedup, PII, packing.

Cases, for each stage: the result has the columns of documents (packing has its own); other columns are dropped whatever
their names, and columns that a table lacks are null.  Empty tables give empty results.  Null texts are empty:
the rules reject them; beside them the stages leave them null.  A null id is no id: such rows stay apart by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from betascape.llm import compact_windows, contextual_pii, online_packing, quality_rules, simhash_dedup
from betascape.llm.common import cut, ready

#: The columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def whole(docs: DataFrame) -> DataFrame:
    """The columns of documents, null where the table lacks one."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the corpus policy; repeated rows are judged each for itself."""
    rows = quality_rules.ledger(whole(docs), keep=("text", "lang", "source", "n_chars"))
    return quality_rules.apply_policy(rows, "corpus").where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the least doc_id, nulls last, and of one id the least text digest.

    Rows are told apart by doc_id and text; of those that repeat both any one stays.
    """
    docs = whole(docs)
    keep = simhash_dedup.representatives(docs.select("doc_id", "text")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    rows = docs.withColumn("__d", simhash_dedup.digest_of())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest"))
    return rows.join(keep, same, "left_semi").dropDuplicates(["doc_id", "__d"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that come earlier, in another document or the same; n_chars follows the text.

    All rows stay, those that repeat id and text alike; a text may become empty.
    """
    return counted(compact_windows.remove(whole(docs)))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the names of its kinds; n_chars follows the text.  All rows stay."""
    return counted(contextual_pii.redact(whole(docs)))


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into windows of 2,048 ids; an empty document is its end id."""
    return online_packing.pack(whole(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("contextual_pii", pii),
    ("online_packing", packing),
]

#: SQL has no SimHash, so the pipeline is tested against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before left in the shared checkpoint folder."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
