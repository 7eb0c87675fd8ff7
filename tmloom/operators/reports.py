"""Views, glossary, review and document assembly over block results.

Reports are rows with an order, not one text cell per document: a document that
holds a large part of all blocks is then written by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.functions.text import (
    ascii_letter_count,
    han_char_count,
    normalize_term,
    round2,
    strip,
)
from tmloom.operators.segment import skipped_page_lists

BLOCK_ORDER = ("doc_key", "page", "block_no")
TERM_PARTS = 8  # lists of a block's terms, and tasks that share a document's


def order_results(results: DataFrame, block_id_as_text: bool = False) -> DataFrame:
    """Document order by block number, or by the text of the block id."""
    last = "block_id" if block_id_as_text else "block_no"
    return results.orderBy("doc_key", "page", last)


def english_heavy(results: DataFrame) -> DataFrame:
    """Non-empty translations with more ASCII letters than Han characters."""
    return results.where(
        (F.col("translation") != "")
        & (ascii_letter_count("translation") > han_char_count("translation"))
    )


def bilingual_view(results: DataFrame) -> DataFrame:
    columns = (
        "page", "block_id", "source_text", "translation", "status", "cache_hit",
        "attempts", round2("elapsed_seconds"), "error_message",
    )
    named = [
        (F.col(c) if isinstance(c, str) else c).alias(n)
        for c, n in zip(columns, fv.BILINGUAL_COLUMNS)
    ]
    return results.select("doc_key", *named)


def attach_skipped(blocks: DataFrame, skipped_lists: DataFrame) -> DataFrame:
    """Add ``skipped_pages`` as one text per document, empty where none."""
    text = skipped_lists.select(
        "doc_key", F.array_join(F.col("skipped_pages").cast("array<string>"), ", ").alias("skipped_pages")
    )
    return blocks.join(text, "doc_key", "left").withColumn(
        "skipped_pages", F.coalesce("skipped_pages", F.lit(""))
    )


def extraction_view(blocks: DataFrame, skipped_lists: DataFrame) -> DataFrame:
    columns = (
        "page", "block_id", "source_text", "source_word_count", "source_char_count",
        "extraction_backend", "skipped_pages",
    )
    return attach_skipped(blocks, skipped_lists).select(
        "doc_key", *[F.col(c).alias(n) for c, n in zip(columns, fv.EXTRACTION_COLUMNS)]
    )


def scored_view(scored: DataFrame) -> DataFrame:
    columns = ("source", "target", "score_raw")
    return scored.select(
        "row_id", *[F.col(c).alias(n) for c, n in zip(columns, fv.SCORED_COLUMNS)]
    )


def glossary(
    results: DataFrame, keys: Sequence[str] = ("doc_key",), example_chars: int = fv.EXAMPLE_CHARS
) -> DataFrame:
    """(keys, source, target, frequency, pages, example, first_seen).

    The terms of a block travel as ``TERM_PARTS`` lists, with its page and its
    example once for each list, so that a term sends little but its letters.
    What a part of a document holds of a term is counted, and given the example
    of the block that was first, where the lists arrive.
    """
    part, block = [*keys, "_part"], [*keys, "_part", "_block"]

    def term(pair: Column, pos: Column) -> Column:
        source, target = normalize_term(pair["source"]), strip(pair["target"])
        return F.struct(pos.alias("pos"), source.alias("source"), target.alias("target"))

    def parted(term: Column) -> Column:
        # hashed once, not once for each list
        home = F.pmod(F.xxhash64(term["source"], term["target"]), F.lit(TERM_PARTS))
        return F.struct(term["pos"].alias("pos"), term["source"].alias("source"), term["target"].alias("target"), home.alias("part"))

    lists = (
        results.select(
            *keys,
            "page",
            "block_no",
            F.monotonically_increasing_id().alias("_block"),
            F.substring("source_text", 1, example_chars).alias("_text"),
            F.transform(
                F.filter(F.transform("term_pairs", term), lambda t: (t["source"] != "") & (t["target"] != "")), parted
            ).alias("_terms"),
        )
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1))))
        .withColumn("_terms", F.filter("_terms", lambda t: t["part"] == F.col("_part")))
        .where(F.size("_terms") > 0)
        # a list for each field packs better than one of structs
        .select(*block, "page", "block_no", "_text", *(F.col(f"_terms.{c}").alias(c) for c in ("pos", "source", "target")))
        .repartition(*part)
    )
    # one row of a list keeps the example for the others
    rows = lists.select(
        *block, "page", "block_no", "_text", F.posexplode(F.arrays_zip("pos", "source", "target")).alias("_i", "_term")
    ).select(
        *block, "page", "block_no", "_term.*", (F.col("_i") == 0).alias("_holds"),
        F.when(F.col("_i") == 0, F.col("_text")).alias("_text"),
    )
    seen = Window.partitionBy(*part, "source", "target").orderBy("page", "block_no", "pos")
    all_ = seen.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = rows.select(
        "*",
        (F.row_number().over(seen) == 1).alias("_first"),
        F.count(F.lit(1)).over(all_).alias("frequency"),
        F.collect_set("page").over(all_).alias("_pages"),
    ).where(F.col("_first") | F.col("_holds"))
    return (
        counted.withColumn("_pages", F.when(F.col("_first"), F.col("_pages")))
        .withColumn("example", F.max("_text").over(Window.partitionBy(*block)))
        .where("_first")
        .select(
            *keys,
            "source",
            "target",
            "frequency",
            F.array_join(F.array_sort("_pages").cast("array<string>"), ", ").alias("pages"),
            "example",
            F.struct("page", "block_no", "pos").alias("first_seen"),
        )
    )


def glossary_view(terms: DataFrame, keys: Sequence[str] = ("doc_key",)) -> DataFrame:
    """The glossary with report headings: frequent terms first, then first seen."""
    columns = ("source", "target", "frequency", "pages", "example")
    return terms.orderBy(*keys, F.desc("frequency"), "first_seen").select(
        *keys, *[F.col(c).alias(n) for c, n in zip(columns, fv.GLOSSARY_COLUMNS)]
    )


def run_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals per document (or of the whole run) and blocks per second."""
    heavy = (F.col("translation") != "") & (
        ascii_letter_count("translation") > han_char_count("translation")
    )
    seconds = F.sum(F.col("elapsed_seconds").cast("decimal(38,18)")).cast("double")
    sums = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(heavy).alias("suspicious"),
        F.coalesce(seconds, F.lit(0.0)).alias("elapsed_seconds"),
    )
    rate = F.when(F.col("elapsed_seconds") > 0, F.col("total") / F.col("elapsed_seconds"))
    return sums.withColumn("blocks_per_second", F.coalesce(rate, F.lit(0.0)))


def assemble_document(results: DataFrame) -> DataFrame:
    """(doc_key, page, part, block_no, text): title, page headings, paragraphs.

    Ordered by those columns the rows are the document.  A heading stands once
    before the blocks of its page, so headings are the distinct pages and no
    block needs to look at its neighbour.
    """
    pages = results.select("doc_key", "page").distinct()
    titles = pages.select("doc_key").distinct().select(
        "doc_key",
        F.lit(-1).alias("page"),
        F.lit(0).alias("part"),
        F.lit(0).alias("block_no"),
        F.concat("doc_key", F.lit(fv.DOCUMENT_TITLE_SUFFIX)).alias("text"),
    )
    headings = pages.select(
        "doc_key",
        "page",
        F.lit(1).alias("part"),
        F.lit(0).alias("block_no"),
        F.concat(
            F.lit(fv.PAGE_HEADING_PREFIX), F.col("page").cast("string"), F.lit(fv.PAGE_HEADING_SUFFIX)
        ).alias("text"),
    )
    failed = F.concat(F.lit(fv.FAILED_BLOCK_PREFIX), "block_id", F.lit("\n"), "source_text")
    paragraphs = results.select(
        "doc_key",
        "page",
        F.lit(2).alias("part"),
        "block_no",
        F.when(F.col("status") == "ok", F.col("translation")).otherwise(failed).alias("text"),
    )
    return titles.unionByName(headings).unionByName(paragraphs)


def review_report(results: DataFrame, listed: int = fv.SUSPICIOUS_LISTED) -> DataFrame:
    """(doc_key, section, page, block_no, line): the Markdown review, line by line.

    Sections: 0-7 head and counts, 8 failed blocks, 9-10 heading, 11 suspicious
    blocks.  Only the suspicious list is a report limit (its count is not).
    """
    counts = run_summary(results, ["doc_key"])

    def fixed(*lines: tuple[int, object]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(n).alias("section"), text.alias("line")) for n, text in lines])
        return counts.select("doc_key", F.inline(rows)).where(F.col("line").isNotNull()).select(
            "doc_key", "section", F.lit(-1).alias("page"), F.lit(0).alias("block_no"), "line"
        )

    def counted(label: str, column: str):
        return F.concat(F.lit(label), F.col(column).cast("string"))

    head = fixed(
        (0, F.lit(fv.REVIEW_TITLE)),
        (1, F.lit("")),
        (2, counted(fv.REVIEW_TOTAL, "total")),
        (3, counted(fv.REVIEW_OK, "ok")),
        (4, counted(fv.REVIEW_FAILED, "failed")),
        (5, counted(fv.REVIEW_SUSPICIOUS, "suspicious")),
        (6, F.lit("")),
        (7, F.lit(fv.REVIEW_FAILED_HEADING)),
        (8, F.when(F.col("failed") == 0, fv.REVIEW_NONE)),
        (9, F.lit("")),
        (10, F.lit(fv.REVIEW_SUSPICIOUS_HEADING)),
        (11, F.when(F.col("suspicious") == 0, fv.REVIEW_NONE)),
    )
    where = F.concat(
        F.lit("- "), "block_id", F.lit(" (page "), F.col("page").cast("string"), F.lit(")")
    )
    error = F.when(F.col("error_message") != "", F.col("error_message")).otherwise(fv.UNKNOWN_ERROR)
    failures = results.where(F.col("status") != "ok").select(
        "doc_key", F.lit(8).alias("section"), "page", "block_no",
        F.concat(where, F.lit(": "), error).alias("line"),
    )
    first = F.row_number().over(Window.partitionBy("doc_key").orderBy("page", "block_no"))
    suspicious = (
        english_heavy(results)
        .select("doc_key", "page", "block_no", where.alias("line"))
        .withColumn("_n", first)
        .where(F.col("_n") <= listed)
        .select("doc_key", F.lit(11).alias("section"), "page", "block_no", "line")
    )
    return head.unionByName(failures).unionByName(suspicious)


def run_manifest(
    blocks: DataFrame,
    results: DataFrame,
    chosen: DataFrame,
    parameters: str = "{}",
    artifacts: dict[str, str] | None = None,
    generated_at: str | None = None,
) -> DataFrame:
    """One row per document: parameters, skipped pages, counts, output paths."""
    stamp = generated_at or datetime.now(timezone.utc).isoformat()
    documents = chosen.select("doc_key").distinct()
    block_counts = blocks.groupBy("doc_key").agg(F.count(F.lit(1)).alias("blocks"))
    summary = run_summary(results, ["doc_key"]).select("doc_key", "ok", "failed", "cache_hits")
    paths = F.map_from_entries(
        F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in (artifacts or {}).items()])
    ) if artifacts else F.create_map().cast("map<string,string>")
    joined = (
        documents.join(block_counts, "doc_key", "left")
        .join(summary, "doc_key", "left")
        .join(skipped_page_lists(chosen), "doc_key", "left")
    )
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_key",
        F.lit(stamp).alias("generated_at"),
        F.lit(parameters).alias("parameters"),
        F.coalesce("skipped_pages", F.array().cast("array<int>")).alias("skipped_pages"),
        *[F.coalesce(c, zero).alias(c) for c in ("blocks", "ok", "failed", "cache_hits")],
        paths.alias("artifacts"),
    )
