"""The composed chains, with answers recorded as tables instead of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog import standins as s
from catalog.batches import fresh_path
from catalog.documents import SIZE, blocks, raw_pages
from catalog.standins import MARK, sql
from tmloom.functions import text as t
from tmloom.operators import progress as p
from tmloom.operators.scale import materialize
from tmloom.plans.parameters import DocumentParameters, LineParameters
from tmloom.plans.score_pairs import score_pairs
from tmloom.plans.translate_documents import translate_documents
from tmloom.plans.translate_lines import translate_lines
from tmloom.streaming.incremental import progress_log, refresh_memory_per_batch, run_incremental


def answer(requests, attempt, body, code=None):
    """An attempts table from a body column."""
    return requests.select(
        "request_id", F.lit(attempt).alias("attempt"),
        (F.lit(200) if code is None else code).alias("status_code"),
        F.lit(None).cast("string").alias("retry_after"), body.alias("body"),
        F.when(F.lit(False) if code is None else code >= 400, "HTTPError: 500").alias("error_message"),
        F.lit(0.5).alias("elapsed_seconds"),
    )


def line_answers(requests, attempt):
    """Batches answer in turn with a chatty head line, too short at first, or well;
    every seventh never answers in full."""
    turn, upper = F.col("request_id") % 3, F.upper("payload")
    short = F.substring_index(upper, "\n", 1)
    body = F.when(F.col("request_id") % 7 == 6, F.lit(""))
    if attempt == 1:
        body = body.when(turn == 0, F.concat(F.lit("Here it is:\n"), upper))
        body = body.when(turn == 1, F.concat(short, F.lit("\n\n\n")))
    return answer(requests, attempt, body.otherwise(upper))


def yes(requests, attempt):
    return answer(requests, attempt, F.lit(" Yes."))


s.add_cte(
    "new_rows",
    ("pending",),
    f"""SELECT rn + 4398046511104 AS seq, src,
               CASE WHEN rn // 25 % 7 = 6 THEN '{MARK}' ELSE upper(src) END AS tgt
        FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS rn FROM pending)""",
)


@register(
    "translate_lines",
    sql(
        f"""SELECT row_id, src, coalesce(tgt, '{MARK}') AS tgt FROM lines LEFT JOIN (
              SELECT src, arg_max(tgt, seq) AS tgt FROM (
                SELECT seq, src, tgt FROM progress UNION ALL SELECT * FROM new_rows) GROUP BY src)
            USING (src)""",
        "lines",
        "progress",
        "new_rows",
    ),
)
def _(spark, d):
    run = translate_lines(s.lines(spark, d), s.progress(spark, d), line_answers, yes)
    return run.restored


@register(
    "translate_lines_waves",
    sql(
        f"""SELECT row_id, src, coalesce(tgt, '{MARK}') AS tgt FROM lines LEFT JOIN (
              SELECT src, arg_max(tgt, seq) AS tgt FROM (
                SELECT seq, src, tgt FROM progress UNION ALL SELECT * FROM new_rows) GROUP BY src)
            USING (src)""",
        "lines",
        "progress",
        "new_rows",
    ),
)
def _(spark, d):
    """The same run in twenty waves, each with the successes before it as history."""
    run = translate_lines(s.lines(spark, d), s.progress(spark, d), line_answers, yes, waves=20)
    return run.restored


@register(
    "judge_failed_calls",
    sql(
        f"""SELECT row_id, src, CASE WHEN max(batch) OVER (PARTITION BY src) % 5 < 3 THEN '{MARK}'
                                     ELSE upper(src) END AS tgt
            FROM (SELECT row_id, src, row_number() OVER (ORDER BY row_id) - 1 AS batch FROM lines)""",
        "lines",
    ),
)
def _(spark, d):
    """One-row batches; error pages of status 429, 500 and 503 have just as many lines."""

    def answers(requests, attempt):
        code = F.element_at(
            F.array(*map(F.lit, (429, 500, 503, 200, 200))), (F.col("request_id") % 5 + 1).cast("int")
        )
        body = F.when(code >= 400, F.lit("Internal Server Error")).otherwise(F.upper("payload"))
        return answer(requests, attempt, body, code)

    none = s.progress(spark, d).limit(0)
    params = LineParameters(batch_size=1, max_attempts=2)
    return translate_lines(s.lines(spark, d), none, answers, params=params).restored


def score_answers(requests, attempt):
    """A score from each target's length; some answers miss a line, some always do."""
    lines = F.transform("targets", lambda x: (F.length(x) % 11).cast("string"))
    full = F.array_join(lines, "\n")
    body = F.when(F.col("request_id") % 9 == 8, F.lit("no scores"))
    if attempt == 1:
        body = body.when(F.col("request_id") % 4 == 0, F.concat(full, F.lit("\n7")))
    return answer(requests, attempt, body.otherwise(full))


@register(
    "score_pairs",
    sql(
        """SELECT seq AS row_id, src AS source, tgt AS target,
                  CASE WHEN n <> 1 AND rn // 10 % 9 = 8 THEN '-1' WHEN rn // 10 % 9 = 8 THEN 'no scores'
                       ELSE (length(tgt) % 11)::VARCHAR END AS score_raw
           FROM (SELECT *, count(*) OVER (PARTITION BY rn // 10) AS n FROM (
             SELECT *, row_number() OVER (ORDER BY seq) - 1 AS rn FROM progress))""",
        "progress",
    ),
)
def _(spark, d):
    pairs = s.progress(spark, d).select(
        F.col("seq").alias("row_id"), F.col("src").alias("source"), F.col("tgt").alias("target")
    )
    run = score_pairs(pairs, score_answers, max_attempts=3)
    return run.scored.select("row_id", "source", "target", "score_raw")


def block_answers(requests, attempt):
    """Fenced JSON with every word as a term; every fifth block of a page never answers."""
    terms = F.rtrim(s.json_terms(s.long_words(F.col("source_text"))), F.lit(","))
    body = F.concat(
        F.lit('```json\n{"translation":"new '), s.json_text(F.col("source_text")),
        F.lit('","terms":['), terms, F.lit(']}\n```'),
    )
    down = F.col("block_no") % 5 == 0
    return answer(requests, attempt, F.when(~down, body), F.when(down, 500).otherwise(200))


def earlier_memory(spark, d):
    """The blocks of even pages as translated by an earlier run."""
    words = s.long_words(F.col("source_text"))
    even = blocks(spark, d).where(F.col("page") % 2 == 0)
    result = F.struct(
        "page", "block_id", "source_text",
        F.concat(F.lit("old "), "source_text").alias("translation"),
        F.transform(
            words, lambda w: F.struct(w.alias("source"), F.upper(w).alias("target"))
        ).alias("term_pairs"),
        F.lit(1).alias("attempts"), F.lit(0.5).alias("elapsed_seconds"), F.lit("ok").alias("status"),
        F.lit("").alias("error_message"), F.lit(False).alias("cache_hit"),
    )
    return even.select(
        (F.col("page") * 100000 + F.col("block_no")).cast("long").alias("seq"), "doc_key",
        t.source_hash("source_text").alias("source_hash"), result.alias("result"),
    )


_TRANSLATED = sql(
    """SELECT doc_key, page, block_no, cache_hit, CASE WHEN cache_hit THEN 0 WHEN block_no % 5 = 0
                  THEN 2 ELSE 1 END AS attempts,
                  CASE WHEN NOT cache_hit AND block_no % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
                  CASE WHEN cache_hit THEN 'old ' || source_text WHEN block_no % 5 = 0 THEN ''
                       ELSE 'new ' || source_text END AS translation
           FROM (SELECT *, EXISTS (SELECT 1 FROM blocks m WHERE m.doc_key = b.doc_key
                   AND m.source_text = b.source_text AND m.page % 2 = 0) AS cache_hit FROM blocks b)""",
    "blocks",
)


@register("translate_documents_waves", _TRANSLATED)
def _(spark, d):
    """The same run in three waves, each with the terms of those before it as hints."""
    return translated(spark, d, 3)


@register("translate_documents", _TRANSLATED)
def _(spark, d):
    return translated(spark, d, 1)


def translated(spark, d, waves):
    memory = materialize(earlier_memory(spark, d), "memory")
    params = DocumentParameters(max_chars=SIZE, max_attempts=2, retry_base_delay=0.0)
    run = translate_documents(raw_pages(spark, d), memory, block_answers, params, waves)
    return run.results.select(
        "doc_key", "page", "block_no", "cache_hit", "attempts", "status", "translation"
    )


def upper_answers(requests, attempt):
    return answer(requests, attempt, F.upper("payload"))


@register("run_incremental", sql("SELECT row_id, src, upper(src) AS tgt FROM lines", "lines"))
def _(spark, d):
    """Lines arriving in three files, one per micro-batch."""
    lines = s.lines(spark, d)
    arriving, log, state = (fresh_path(spark, n) for n in ("arriving", "log", "state"))
    lines.repartition(3, "row_id").write.parquet(arriving)
    stream = (
        spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    )
    run_incremental(stream, log, state, upper_answers).awaitTermination()
    return p.restore_order(lines, p.latest_progress(progress_log(spark, log)))


@register(
    "run_incremental_failing",
    sql(
        f"""SELECT row_id, src, CASE WHEN src LIKE '%ring%' THEN '{MARK}' ELSE upper(src) END AS tgt,
                   CASE WHEN src LIKE '%ring%' THEN 2 ELSE 1 END AS micro_batches
            FROM lines""",
        "lines",
    ),
)
def _(spark, d):
    """Lines arriving in four files; those with a ring fail in two micro-batches and are given up."""
    lines = s.lines(spark, d)
    arriving, log, state = (fresh_path(spark, n) for n in ("arriving", "log", "state"))
    # the last file brings sources of the first again, so that a failure has a micro-batch after its own
    home = F.least(F.pmod(F.xxhash64("src"), F.lit(3)), F.lit(2))
    for n in range(3):
        lines.where(home == n).coalesce(1).write.mode("append").parquet(arriving)
    lines.where(home == 0).coalesce(1).write.mode("append").parquet(arriving)
    stream = (
        spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    )

    def answers(requests, attempt):
        return answer(requests, attempt, F.when(~F.col("payload").contains("ring"), F.upper("payload")))

    params = LineParameters(batch_size=1, max_attempts=1)
    run_incremental(stream, log, state, answers, params=params, max_batches=2).awaitTermination()
    rows = progress_log(spark, log)
    sent = rows.groupBy("src").agg(F.countDistinct("run_id").cast("int").alias("micro_batches"))
    return p.restore_order(lines, p.latest_progress(rows)).join(sent, "src")


@register(
    "refresh_memory_per_batch",
    sql(
        """SELECT doc_key, page, block_no, 'new ' || source_text AS translation FROM blocks""",
        "blocks",
    ),
)
def _(spark, d):
    """Pages arriving in six files; each batch sees the memory of those before it, which is merged on the way."""
    pages = raw_pages(spark, d)
    arriving, memory, results, state = (
        fresh_path(spark, n) for n in ("arriving", "memory", "results", "state")
    )
    pages.repartition(6, "doc_key", "page").write.parquet(arriving)
    stream = (
        spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    )

    def always(requests, attempt):
        return block_answers(requests.withColumn("block_no", F.lit(1)), attempt)

    refresh_memory_per_batch(
        stream, memory, results, state, always, DocumentParameters(max_chars=SIZE)
    ).awaitTermination()
    done = spark.read.parquet(results)
    return done.select(
        "doc_key", "page", "block_no", "translation"
    )
