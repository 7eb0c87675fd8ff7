"""Exact-match translation memory, scoped per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmloom.functions.text import source_hash
from tmloom.operators.scale import materialize, previous_value

_BLOCK_BITS = 31  # a block number is an int, as is a page
_RESULT_FIELDS = (
    "page", "block_id", "source_text", "translation", "term_pairs", "attempts",
    "elapsed_seconds", "status", "error_message", "cache_hit",
)


def _first_seen(memory: DataFrame) -> Column:
    """A merged log tells when a hash was first seen; in a plain one that is its first entry."""
    return F.min("first_seq" if "first_seq" in memory.columns else "seq")


def _only(memory: DataFrame, *fields: str) -> DataFrame:
    """``memory`` with these fields of its results, so that texts nobody asked for are not moved."""
    return memory.withColumn("result", F.struct(*(f"result.{c}" for c in fields)))


def latest_memory(memory: DataFrame) -> DataFrame:
    """(doc_key, source_hash, result, first_seq): the last log entry per hash wins."""
    return memory.groupBy("doc_key", "source_hash").agg(
        F.max_by("result", "seq").alias("result"), _first_seen(memory).alias("first_seq")
    )


def merged_memory(memory: DataFrame) -> DataFrame:
    """A shorter log that reads the same: the last entry per hash, and when the hash was first seen."""
    return memory.groupBy("doc_key", "source_hash").agg(
        F.max_by("result", "seq").alias("result"), _first_seen(memory).alias("first_seq"), F.max("seq").alias("seq")
    ).select("seq", "first_seq", "doc_key", "source_hash", "result")


def term_frequencies(memory: DataFrame) -> DataFrame:
    """(doc_key, source, target, frequency, first_seen) over the latest entries."""
    return (
        latest_memory(_only(memory, "term_pairs"))
        .select("doc_key", "first_seq", F.posexplode("result.term_pairs").alias("pos", "pair"))
        .groupBy("doc_key", "pair.source", "pair.target")
        .agg(
            F.count(F.lit(1)).alias("frequency"),
            F.min(F.struct("first_seq", "pos")).alias("first_seen"),
        )
    )


def lookup_exact(blocks: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits as results, misses as blocks).

    The key is the hash and the text itself, so equal hashes of different texts
    do not mix.  Copies of one text may fill a large part of the blocks; the
    join's own skew handling splits them.  Entries, whose texts pack well, are not
    broadcast through the driver, however small they look.  The outcome is written once, since
    hits and misses are read apart.
    """
    entries = latest_memory(_only(memory, "source_text", "translation", "term_pairs")).select(
        "doc_key",
        "source_hash",
        F.col("result.source_text").alias("source_text"),
        F.struct("result.translation", "result.term_pairs").alias("_hit"),
    )
    looked = materialize(
        blocks.withColumn("source_hash", source_hash("source_text")).join(
            entries.hint("merge"), ["doc_key", "source_hash", "source_text"], "left"
        ),
        "looked",
    )
    hits = looked.where(F.col("_hit").isNotNull()).select(
        "doc_key",
        "page",
        "block_no",
        "block_id",
        "source_text",
        "_hit.translation",
        "_hit.term_pairs",
        F.lit(0).alias("attempts"),
        F.lit(0.0).alias("elapsed_seconds"),
        F.lit("ok").alias("status"),
        F.lit("").alias("error_message"),
        F.lit(True).alias("cache_hit"),
    )
    misses = looked.where(F.col("_hit").isNull()).select(*blocks.columns)
    return hits, misses


def combine_results(hits: DataFrame, fresh: DataFrame) -> DataFrame:
    return hits.unionByName(fresh)


def _fingerprint(text: Column, translation: Column, terms: Column) -> Column:
    content = F.struct(text.alias("s"), translation.alias("t"), terms.alias("p"))
    return F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)


def upsert_memory(memory: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_key, seq, source_hash, result): the entries to append to the log.

    Freshly translated ok results only.  A result equal in text, translation
    and terms to the entry before it, in the log or in this run, adds nothing.
    ``seq`` follows page and block number within a document; entries of the log,
    whose order need not be of the same type, come before all of a run.
    """
    fresh = results.where((F.col("status") == "ok") & ~F.col("cache_hit")).select(
        "doc_key",
        (
            F.shiftleft(F.col("page").cast("long"), _BLOCK_BITS)
            .bitwiseOR(F.col("block_no").cast("long"))
        ).alias("seq"),
        source_hash("source_text").alias("source_hash"),
        F.struct(*_RESULT_FIELDS).alias("result"),
    )
    r = F.col("result")
    print_of = _fingerprint(r["source_text"], r["translation"], r["term_pairs"])
    logged = memory.groupBy("doc_key", "source_hash").agg(
        F.max_by(print_of, "seq").alias("_print"), F.lit(-1).cast("long").alias("seq")
    )
    chain = logged.select(
        "doc_key", "seq", "source_hash", "_print", F.lit(None).cast(fresh.schema["result"].dataType).alias("result")
    ).unionByName(fresh.withColumn("_print", print_of))
    compared = previous_value(chain, ["doc_key", "source_hash"], "seq", F.col("_print"), "_before")
    return compared.where(
        r.isNotNull() & ~F.col("_print").eqNullSafe(F.col("_before"))
    ).select("doc_key", "seq", "source_hash", "result")
