"""Pages to blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog import standins as s
from catalog.standins import sql
from catalog.text import RAW_SQL, clean_sql, flush_sql, raw_page, reduce_sql, words_sql
from tmloom.functions import text as t
from tmloom.operators import segment as seg
from tmloom.sources.pages import pages_with_fallback

SIZE = 300  # conversation turns are short; a small limit makes chunking work
_PRIMARY = clean_sql(RAW_SQL.replace("text", "primary_text"))
_FALLBACK = clean_sql(RAW_SQL.replace("text", "fallback_text"))

s.add_cte(
    "chosen",
    ("page_texts",),
    f"""SELECT doc_key, page, CASE WHEN p <> '' THEN p WHEN f <> '' THEN f END AS text,
               CASE WHEN p <> '' THEN 'pdfplumber' WHEN f <> '' THEN 'PyPDF2' END AS backend
        FROM (SELECT doc_key, page, {_PRIMARY} AS p, {_FALLBACK} AS f FROM page_texts)""",
)
s.add_cte(
    "blocks",
    ("chosen",),
    f"""SELECT doc_key, page, n::INT AS block_no, printf('P%03d-B%03d', page, n) AS block_id,
               u AS source_text, {words_sql('u')}::INT AS source_word_count,
               length(u)::INT AS source_char_count, backend AS extraction_backend
        FROM (SELECT doc_key, page, backend, u,
                     row_number() OVER (PARTITION BY doc_key, page ORDER BY part, i) AS n
              FROM (SELECT doc_key, page, backend, part, unnest(c) AS u, unnest(range(len(c))) AS i
                    FROM (SELECT doc_key, page, backend, part, {flush_sql('a', 'p', SIZE)} AS c
                          FROM (SELECT *, {reduce_sql('p', SIZE)} AS a
                                FROM (SELECT doc_key, page, backend,
                                             unnest(string_split(text, chr(10) || chr(10))) AS p,
                                             unnest(range(len(string_split(text, chr(10) || chr(10)))))
                                               AS part FROM chosen WHERE text IS NOT NULL)))))""",
)
_LONG = clean_sql("primary_text")
s.add_cte(
    "long_blocks",
    ("long_page_texts",),
    f"""SELECT doc_key, page, u AS source_text,
               row_number() OVER (PARTITION BY doc_key, page ORDER BY part, i)::INT AS block_no
        FROM (SELECT doc_key, page, part, unnest(c) AS u, unnest(range(len(c))) AS i
              FROM (SELECT doc_key, page, part, {flush_sql('a', 'p', 1800)} AS c
                    FROM (SELECT *, {reduce_sql('p', 1800)} AS a
                          FROM (SELECT doc_key, page,
                                       unnest(string_split(text, chr(10) || chr(10))) AS p,
                                       unnest(range(len(string_split(text, chr(10) || chr(10)))))
                                         AS part
                                FROM (SELECT doc_key, page, {_LONG} AS text FROM long_page_texts)
                                WHERE text <> ''))))""",
)


def raw_pages(spark, d):
    return s.pages(spark, d).withColumns(
        {c: raw_page(F.col(c)) for c in ("primary_text", "fallback_text")}
    )


def chosen(spark, d):
    return pages_with_fallback(raw_pages(spark, d))


def blocks(spark, d):
    return seg.to_blocks(raw_pages(spark, d), SIZE)


@register("pages_with_fallback", sql("SELECT * FROM chosen", "chosen"))
def _(spark, d):
    return chosen(spark, d)


@register("clean_pages", sql(f"SELECT doc_key, page, {_PRIMARY} AS text FROM page_texts", "page_texts"))
def _(spark, d):
    return seg.clean_pages(raw_pages(spark, d))


@register("to_blocks", sql("SELECT * FROM blocks", "blocks"))
def _(spark, d):
    return blocks(spark, d)


@register("to_blocks_long", sql("SELECT * FROM long_blocks", "long_blocks"))
def _(spark, d):
    return seg.to_blocks(s.long_pages(spark, d)).select("doc_key", "page", "block_no", "source_text")


@register(
    "skipped_pages",
    sql(
        """SELECT doc_key, string_agg(page, ',' ORDER BY page) AS skipped_pages FROM chosen
           WHERE text IS NULL GROUP BY doc_key""",
        "chosen",
    ),
)
def _(spark, d):
    lists = seg.skipped_page_lists(chosen(spark, d))
    return lists.select(
        "doc_key",
        F.array_join(F.col("skipped_pages").cast("array<string>"), ",").alias("skipped_pages"),
    )


@register(
    "page_backends",
    sql("SELECT doc_key, page, backend FROM chosen WHERE text IS NOT NULL", "chosen"),
)
def _(spark, d):
    maps = seg.page_backend_maps(chosen(spark, d))
    return maps.select("doc_key", F.explode("page_backends").alias("page", "backend"))


@register(
    "limit_blocks",
    sql(
        """SELECT doc_key, page, block_no, source_text FROM blocks
           ORDER BY doc_key, page, block_no LIMIT 100""",
        "blocks",
    ),
)
def _(spark, d):
    return seg.limit_blocks(blocks(spark, d), 100).select(
        "doc_key", "page", "block_no", "source_text"
    )
