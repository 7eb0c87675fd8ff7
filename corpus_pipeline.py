"""From ``documents`` to token ids: language, exact and near copies, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmloom.llm.exact import drop_exact_copies
from tmloom.llm.folds import fold
from tmloom.llm.language import UNDETERMINED, identify
from tmloom.llm.mix import mixed_documents
from tmloom.llm.pieces import encode
from tmloom.llm.queries import table, tokenizer_path
from tmloom.llm.simhash import drop_near_copies
from tmloom.operators.scale import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, of however many languages; undetermined ones go."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_doc"))
    learn = docs.select("doc_id", "text", "lang").where(fold("doc_id", 3) != 1)
    named = identify(rows, learn, carry=["_doc"])
    return named.where(F.col("lang_pred") != UNDETERMINED).select("_doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, a part where it takes a part."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): each text's ids, and whether they decode to it."""
    encoded = encode(docs, tokenizer_path(), carry=["lang", "source", "text"])
    return encoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mixing),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None  # fingerprints and token ids have no SQL; the tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
