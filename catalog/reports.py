"""Views, glossary, review, document assembly and file sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog import standins as s
from catalog.batches import fresh_path, scored_batches
from catalog.documents import blocks, chosen
from catalog.standins import sql
from tmloom.functions import fixed_values as fv
from tmloom.operators import progress as p
from tmloom.operators import reports as r
from tmloom.operators import segment as seg
from tmloom.operators.scale import numbered_in_place
from tmloom.plans.score_pairs import attach_scores
from tmloom.sources import files, sinks

_HEAVY = """translation <> '' AND len(regexp_extract_all(translation, '[A-Za-z]'))
            > length(regexp_replace(translation, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))"""


def snake(df):
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


@register(
    "block_failures",
    sql("SELECT doc_key, page, error_message FROM results WHERE status <> 'ok'", "results"),
)
def _(spark, d):
    return p.block_failures(s.results(spark, d)).select("doc_key", "page", "error_message")


@register("english_heavy", sql(f"SELECT doc_key, page FROM results WHERE {_HEAVY}", "results"))
def _(spark, d):
    return r.english_heavy(s.results(spark, d)).select("doc_key", "page")


_BILINGUAL = """SELECT doc_key, page, block_id, source_text, translation AS chinese_translation, status,
    cache_hit, attempts, format('{:.2f}', elapsed_seconds)::DOUBLE AS elapsed_seconds, error_message
    FROM results"""


@register("bilingual_view", sql(_BILINGUAL, "results"))
def _(spark, d):
    return snake(r.bilingual_view(s.results(spark, d)))


s.add_cte(
    "skipped_lists",
    ("chosen",),
    """SELECT doc_key, string_agg(page, ', ' ORDER BY page) AS skipped_pages
       FROM chosen WHERE text IS NULL GROUP BY doc_key""",
)
_EXTRACTION = """SELECT doc_key, page, block_id, source_text, source_word_count AS word_count,
    source_char_count AS character_count, extraction_backend,
    coalesce(skipped_pages, '') AS skipped_pages
    FROM blocks LEFT JOIN skipped_lists USING (doc_key)"""


@register("extraction_view", sql(_EXTRACTION, "blocks", "skipped_lists"))
def _(spark, d):
    return snake(r.extraction_view(blocks(spark, d), seg.skipped_page_lists(chosen(spark, d))))


@register(
    "attach_skipped",
    sql(
        """SELECT doc_key, page, block_no, coalesce(skipped_pages, '') AS skipped_pages
           FROM blocks LEFT JOIN skipped_lists USING (doc_key)""",
        "blocks",
        "skipped_lists",
    ),
)
def _(spark, d):
    joined = r.attach_skipped(blocks(spark, d), seg.skipped_page_lists(chosen(spark, d)))
    return joined.select("doc_key", "page", "block_no", "skipped_pages")


def scored(spark, d):
    """Pairs with their text length as a recorded score."""
    batches = scored_batches(spark, d)
    lengths = F.transform("targets", lambda t: F.length(t).cast("string"))
    return attach_scores(batches.withColumn("scores", lengths))


@register(
    "scored_view",
    sql(
        """SELECT seq AS row_id, src AS source, tgt AS target, length(tgt)::VARCHAR AS score
           FROM progress""",
        "progress",
    ),
)
def _(spark, d):
    return snake(r.scored_view(scored(spark, d)))


@register(
    "write_scored",
    sql(
        """SELECT row_number() OVER (ORDER BY seq) - 1 AS n, src AS source, tgt AS target,
                  length(tgt)::VARCHAR AS score_raw, length(tgt)::INT AS score FROM progress""",
        "progress",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "scored")
    for _ in range(2):  # a repeated run replaces its rows
        sinks.write_scored(r.scored_view(scored(spark, d)), path, "run-0")
    from catalog.batches import dense_rank

    back = files.read_scored(spark, path)
    return dense_rank(back.withColumn("target", F.coalesce("target", F.lit(""))))


_GLOSSARY = r"""SELECT doc_key, source, target, count(*) AS frequency,
    array_to_string(list_sort(list_distinct(list(page))), ', ') AS pages,
    arg_min(left(source_text, 180), ord) AS example, min(ord) AS first_seen
    FROM (SELECT doc_key, page, source_text, page * 1000000 + pos AS ord, trim(term.target) AS target,
                 regexp_replace(trim(term.source), '\s+', ' ', 'g') AS source
          FROM (SELECT doc_key, page, source_text, unnest(term_pairs) AS term,
                       unnest(range(len(term_pairs))) AS pos FROM results))
    WHERE length(source) >= 2 AND regexp_matches(source, '[\pL\pN]') AND target <> ''
    GROUP BY doc_key, source, target"""
s.add_cte("glossary", ("results",), _GLOSSARY)


@register("glossary", sql("SELECT * EXCLUDE (first_seen) FROM glossary", "glossary"))
def glossary(spark, d):
    return r.glossary(s.results(spark, d)).drop("first_seen")


@register(
    "glossary_view",
    sql(
        """SELECT doc_key, source AS english_term, target AS chinese_term, frequency, pages, example,
                  row_number() OVER (ORDER BY doc_key, frequency DESC, first_seen) - 1 AS n
           FROM glossary""",
        "glossary",
    ),
)
def _(spark, d):
    """The view with the place of each row in it."""
    return numbered_in_place(snake(r.glossary_view(r.glossary(s.results(spark, d)))), "n")


_SUMMARY = f"""SELECT <keys> count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
    count(*) FILTER (status <> 'ok') AS failed, count(*) FILTER (cache_hit) AS cache_hits,
    count(*) FILTER ({_HEAVY}) AS suspicious,
    sum(elapsed_seconds::DECIMAL(18, 6))::DOUBLE AS elapsed_seconds,
    coalesce(count(*) / nullif(sum(elapsed_seconds::DECIMAL(18, 6))::DOUBLE, 0), 0)
      AS blocks_per_second FROM results <group>"""


@register("run_summary", sql(_SUMMARY.replace("<keys>", "").replace("<group>", ""), "results"))
def _(spark, d):
    return r.run_summary(s.results(spark, d))


@register(
    "run_summary_by_document",
    sql(_SUMMARY.replace("<keys>", "doc_key,").replace("<group>", "GROUP BY doc_key"), "results"),
)
def _(spark, d):
    return r.run_summary(s.results(spark, d), ["doc_key"])


_DOCUMENT = f"""SELECT DISTINCT doc_key, -1 AS page, 0 AS part, 0 AS block_no,
        doc_key || '{fv.DOCUMENT_TITLE_SUFFIX}' AS text FROM results
    UNION ALL SELECT doc_key, page, 1, 0,
        '{fv.PAGE_HEADING_PREFIX}' || page || '{fv.PAGE_HEADING_SUFFIX}' FROM (
        SELECT *, lag(page) OVER (PARTITION BY doc_key ORDER BY page, block_no) AS before FROM results)
        WHERE page IS DISTINCT FROM before
    UNION ALL SELECT doc_key, page, 2, block_no, CASE WHEN status = 'ok' THEN translation
        ELSE '{fv.FAILED_BLOCK_PREFIX}' || block_id || chr(10) || source_text END FROM results"""
s.add_cte("document", ("results",), _DOCUMENT)


@register("assemble_document", sql("SELECT * FROM document", "document"))
def _(spark, d):
    return r.assemble_document(s.results(spark, d))


@register(
    "write_document",
    sql(
        """SELECT doc_key, string_agg(text, chr(10) ORDER BY page, part, block_no) AS text
           FROM document GROUP BY doc_key""",
        "document",
    ),
)
def _(spark, d):
    """Written documents read back whole; a volume here is fifty pages."""
    path = fresh_path(spark, "document")
    sinks.write_document(r.assemble_document(s.results(spark, d)), path)
    back = files.read_texts(spark, path)
    rows = F.array_sort(F.collect_list(F.struct("place", "value")))
    return back.groupBy("doc_key").agg(F.array_join(rows["value"], "\n").alias("text"))


_REVIEW = f"""SELECT doc_key, section, -1 AS page, 0 AS block_no, line FROM (
        SELECT doc_key, unnest(range(12))::INT AS section, unnest([
            '{fv.REVIEW_TITLE}', '', '{fv.REVIEW_TOTAL}' || total, '{fv.REVIEW_OK}' || (total - failed),
            '{fv.REVIEW_FAILED}' || failed, '{fv.REVIEW_SUSPICIOUS}' || heavy, '',
            '{fv.REVIEW_FAILED_HEADING}', CASE WHEN failed = 0 THEN '{fv.REVIEW_NONE}' END, '',
            '{fv.REVIEW_SUSPICIOUS_HEADING}', CASE WHEN heavy = 0 THEN '{fv.REVIEW_NONE}' END]) AS line
        FROM (SELECT doc_key, count(*) AS total, count(*) FILTER (status <> 'ok') AS failed,
                     count(*) FILTER ({_HEAVY}) AS heavy FROM results GROUP BY doc_key))
    WHERE line IS NOT NULL
    UNION ALL SELECT doc_key, 8, page, block_no, '- ' || block_id || ' (page ' || page || '): '
        || CASE WHEN error_message <> '' THEN error_message ELSE 'unknown error' END
        FROM results WHERE status <> 'ok'
    UNION ALL SELECT doc_key, 11, page, block_no, '- ' || block_id || ' (page ' || page || ')' FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY page, block_no) AS rn
        FROM results WHERE {_HEAVY}) WHERE rn <= <listed>"""


@register("review_report", sql(_REVIEW.replace("<listed>", "20"), "results"))
def _(spark, d):
    return r.review_report(s.results(spark, d))


@register("review_report_short_list", sql(_REVIEW.replace("<listed>", "5"), "results"))
def _(spark, d):
    return r.review_report(s.results(spark, d), listed=5)


@register(
    "order_results",
    sql(
        """SELECT doc_key, page, block_id, row_number() OVER (ORDER BY doc_key, page, block_id) - 1 AS n
           FROM results""",
        "results",
    ),
)
def _(spark, d):
    """Written in order, then numbered by file position."""
    from catalog.batches import dense_rank

    path = fresh_path(spark, "ordered")
    r.order_results(s.results(spark, d)).select("doc_key", "page", "block_id").write.csv(path)
    back = spark.read.schema("doc_key string, page int, block_id string").csv(path)
    return dense_rank(files.with_file_order(back, "row_id"))


@register("write_tables", sql(_BILINGUAL, "results"))
def _(spark, d):
    path = fresh_path(spark, "tables")
    results = s.results(spark, d)
    skipped = seg.skipped_page_lists(chosen(spark, d))
    paths = sinks.write_tables(
        r.extraction_view(blocks(spark, d), skipped),
        r.bilingual_view(results),
        r.glossary_view(r.glossary(results)),
        path,
    )
    schema = (
        "doc_key string, page int, block_id string, source_text string, chinese_translation string, "
        "status string, cache_hit boolean, attempts int, elapsed_seconds double, error_message string"
    )
    back = spark.read.schema(schema).options(
        header=True, escape='"', multiLine=True, enforceSchema=True
    ).csv(paths["bilingual"])
    return back.fillna("", ["chinese_translation", "error_message"])


@register(
    "write_results_json",
    sql(
        """SELECT doc_key, page, translation, unnest(term_pairs).source AS source,
                  unnest(term_pairs).target AS target FROM results""",
        "results",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "results")
    results = s.results(spark, d)
    sinks.write_results_json(results, path)
    back = spark.read.schema(results.schema).json(path)
    return back.select("doc_key", "page", "translation", F.inline("term_pairs"))


@register(
    "run_manifest",
    sql(
        """SELECT doc_key, '{}' AS parameters, 'now' AS generated_at,
                  coalesce(skipped_pages, '') AS skipped_pages, coalesce(n, 0) AS blocks,
                  coalesce(n, 0) AS ok, 0 AS failed, 0 AS cache_hits
           FROM (SELECT DISTINCT doc_key FROM chosen)
           LEFT JOIN (SELECT doc_key, count(*) AS n FROM blocks GROUP BY 1) USING (doc_key)
           LEFT JOIN skipped_lists USING (doc_key)""",
        "blocks",
        "skipped_lists",
    ),
)
def _(spark, d):
    made = blocks(spark, d)
    results = made.select(
        "doc_key", "page", "block_no", F.col("source_text").alias("translation"),
        F.lit("ok").alias("status"), F.lit(False).alias("cache_hit"),
        F.lit(0.0).alias("elapsed_seconds"),
    )
    manifest = r.run_manifest(made, results, chosen(spark, d), "{}", {"results": "x"}, "now")
    pages = F.array_join(F.col("skipped_pages").cast("array<string>"), ", ")
    return manifest.withColumn("skipped_pages", pages).drop("artifacts")
