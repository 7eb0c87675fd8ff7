"""Pages to numbered text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.functions import text as t
from tmloom.sources.pages import pages_with_fallback


def clean_pages(pages: DataFrame) -> DataFrame:
    """(doc_key, page, text) with each page's primary text cleaned."""
    return pages.select("doc_key", "page", t.clean_page("primary_text").alias("text"))


def blocks_of(chosen: DataFrame, max_chars: int = fv.CHUNK_MAX_CHARS) -> DataFrame:
    """Blocks of pages that went through ``pages_with_fallback`` already."""
    # The outer form of explode: the plain form would add a filter on the array's
    # size, and with it a second evaluation of the whole chunking expression.
    parts = F.transform(F.split("text", "\n\n"), t.strip)
    units = F.flatten(F.transform(parts, lambda p: t.chunk_text(p, max_chars)))
    return (
        chosen.where(F.col("text").isNotNull())
        .select("doc_key", "page", "backend", F.posexplode_outer(units).alias("pos", "unit"))
        .withColumn("source_text", t.strip("unit"))
        .where(F.col("source_text") != "")
        .select(
            "doc_key",
            F.col("page").cast("int").alias("page"),
            (F.col("pos") + 1).alias("block_no"),
            t.block_id(F.col("page").cast("int"), F.col("pos") + 1).alias("block_id"),
            "source_text",
            t.word_count("source_text").alias("source_word_count"),
            t.char_count("source_text").alias("source_char_count"),
            F.col("backend").alias("extraction_backend"),
        )
    )


def to_blocks(pages: DataFrame, max_chars: int = fv.CHUNK_MAX_CHARS) -> DataFrame:
    """Numbered blocks of every usable page.  One narrow pass, no shuffle."""
    return blocks_of(pages_with_fallback(pages), max_chars)


def skipped_pages(chosen: DataFrame) -> DataFrame:
    """(doc_key, page) of the pages without usable text, one row per page."""
    return chosen.where(F.col("text").isNull()).select("doc_key", "page")


def skipped_page_lists(chosen: DataFrame) -> DataFrame:
    """(doc_key, skipped_pages): distinct page numbers in order.

    Page numbers are combined before the shuffle, so a list is bounded by the
    pages of its document, not by the number of rows.
    """
    return (
        skipped_pages(chosen)
        .groupBy("doc_key")
        .agg(F.array_sort(F.collect_set("page")).alias("skipped_pages"))
    )


def page_backends(chosen: DataFrame) -> DataFrame:
    """(doc_key, page, backend) of the usable pages."""
    return chosen.where(F.col("backend").isNotNull()).select("doc_key", "page", "backend")


def page_backend_maps(chosen: DataFrame) -> DataFrame:
    """(doc_key, page_backends): a map of page to backend, bounded by the page count."""
    return (
        page_backends(chosen)
        .groupBy("doc_key")
        .agg(
            F.map_from_entries(
                F.array_sort(F.collect_set(F.struct("page", "backend")))
            ).alias("page_backends")
        )
    )


def limit_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` blocks in document order; 0 keeps all."""
    if n <= 0:
        return blocks
    return blocks.orderBy("doc_key", "page", "block_no").limit(n)
