"""Sources, sinks and operators of the line chain."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import register
from catalog import standins as s
from catalog.standins import MARK, sql, strip_sql
from tmloom.operators import batches as b
from tmloom.operators import fuzzy
from tmloom.operators import progress as p
from tmloom.operators.scale import durable_dir
from tmloom.sources import files, sinks


def fresh_path(spark, name: str) -> str:
    """A new folder beside the written intermediate tables."""
    return f"{durable_dir(spark)}/{name}-{uuid.uuid4().hex}"


def dense_rank(df, id_col="row_id"):
    """File ids are unique and ordered but not dense; compare positions instead."""
    return b.global_rank(df, id_col, "n").drop(id_col)


LINE_SQL = "replace(src, ' ', ', \"q\" ')"


def _quoted(spark, d):
    """Lines with commas and quotes, as hard CSV cells."""
    return s.lines(spark, d).withColumn("src", F.replace("src", F.lit(" "), F.lit(', "q" ')))


@register(
    "read_lines",
    sql(f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS n, {LINE_SQL} AS src FROM lines", "lines"),
)
def _(spark, d):
    path = fresh_path(spark, "lines")
    sinks.write_ordered(_quoted(spark, d), path)
    return dense_rank(files.read_lines(spark, path))


@register(
    "read_progress",
    sql(
        f"""SELECT row_number() OVER (ORDER BY seq) - 1 AS n, {LINE_SQL} AS src,
                   CASE WHEN tgt = '' THEN '' ELSE tgt END AS tgt FROM progress""",
        "progress",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "progress")
    log = s.progress(spark, d).withColumn("src", F.replace("src", F.lit(" "), F.lit(', "q" ')))
    sinks.write_ordered(log, path, "seq")
    back = files.read_progress_csv(spark, path)
    return dense_rank(back.withColumn("tgt", F.coalesce("tgt", F.lit(""))), "seq")


@register(
    "read_pairs",
    sql(
        """SELECT row_number() OVER (ORDER BY seq) - 1 AS n, src AS source, tgt AS target
           FROM progress""",
        "progress",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "pairs")
    sinks.write_ordered(s.progress(spark, d), path, "seq")
    return dense_rank(files.read_pairs(spark, path))


@register(
    "append_progress",
    sql("SELECT seq, src, tgt FROM progress", "progress"),
)
def appended(spark, d):
    """Two runs of a log, the second one repeated, through the sink and its reader."""
    path = fresh_path(spark, "log")
    log = s.progress(spark, d)
    later = F.col("seq") >= s.LATER
    sinks.append_progress(log.where(~later), path, "run-0")
    for _ in range(2):
        sinks.append_progress(log.where(later), path, "run-1")
    return files.read_progress(spark, path)


@register("resume_lines", sql("SELECT row_id, src FROM pending", "pending"))
def _(spark, d):
    """What a rerun has to send after reading its log back."""
    return p.pending(s.lines(spark, d), appended(spark, d))


_RESTORED = f"""SELECT row_id, src, coalesce(tgt, '{MARK}') AS tgt
                FROM lines LEFT JOIN latest USING (src)"""


@register(
    "write_ordered",
    sql(
        f"""SELECT row_number() OVER (ORDER BY row_id) - 1 AS n, src, nullif(tgt, '') AS tgt
            FROM ({_RESTORED})""",
        "lines",
        "latest",
    ),
)
def _(spark, d):
    path = fresh_path(spark, "ordered")
    log = s.progress(spark, d)
    sinks.write_ordered(p.restore_order(s.lines(spark, d), p.latest_progress(log)), path)
    back = files.read_progress_csv(spark, path)
    return dense_rank(back.withColumn("tgt", F.nullif("tgt", F.lit(""))), "seq")


@register("latest_progress", sql("SELECT src, tgt FROM latest", "latest"))
def _(spark, d):
    return p.latest_progress(s.progress(spark, d))


@register("pending", sql("SELECT row_id, src FROM pending", "pending"))
def _(spark, d):
    return p.pending(s.lines(spark, d), s.progress(spark, d))


@register("valid_history", sql("SELECT seq, src, tgt FROM history", "history"))
def _(spark, d):
    return p.valid_history(s.progress(spark, d))


@register(
    "line_failures",
    sql(f"SELECT row_id, src, tgt FROM ({_RESTORED}) WHERE tgt = '{MARK}'", "lines", "latest"),
)
def _(spark, d):
    log = s.progress(spark, d)
    return p.line_failures(p.restore_order(s.lines(spark, d), p.latest_progress(log)))


@register("restore_order", sql(_RESTORED, "lines", "latest"))
def restore_order(spark, d):
    log = s.progress(spark, d)
    return p.restore_order(s.lines(spark, d), p.latest_progress(log))


@register(
    "count_failed",
    sql(
        f"""SELECT count(*) AS total, count(*) FILTER (tgt = '{MARK}') AS failed FROM ({_RESTORED})""",
        "lines",
        "latest",
    ),
)
def _(spark, d):
    return p.count_failed(restore_order(spark, d))


@register(
    "count_pending",
    sql(
        """SELECT (SELECT count(*) FROM lines) AS total, (SELECT count(*) FROM pending) AS pending""",
        "pending",
    ),
)
def _(spark, d):
    return p.count_pending(s.lines(spark, d), s.progress(spark, d))


@register(
    "extend_history",
    sql(
        f"""SELECT seq, src, tgt FROM history UNION ALL
            SELECT row_id + 2199023255552, src, upper(src) FROM pending WHERE upper(src) <> '{MARK}'""",
        "history",
        "pending",
    ),
)
def _(spark, d):
    log = s.progress(spark, d)
    new = p.pending(s.lines(spark, d), log).select(
        (F.col("row_id") + 2 * s.LATER).alias("seq"), "src", F.upper("src").alias("tgt")
    )
    return p.extend_history(p.valid_history(log), new)


@register("assign_batches", sql("SELECT row_id, src, batch, pos FROM batched", "batched"))
def batched(spark, d):
    return b.assign_batches(s.lines(spark, d))


@register(
    "batch_requests",
    sql(
        """SELECT batch, count(*)::INT AS expected_lines,
                  string_agg(src, chr(10) ORDER BY pos) AS input_text FROM batched GROUP BY batch""",
        "batched",
    ),
)
def _(spark, d):
    return b.batch_requests(batched(spark, d)).select("batch", "expected_lines", "input_text")


@register(
    "batch_requests_events",
    """SELECT batch, count(*)::INT AS expected_lines, string_agg(src, chr(10) ORDER BY rn) AS input_text
       FROM (SELECT rn, rn // 25 AS batch, event_type || ' ' || props AS src FROM (
           SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events)) GROUP BY batch""",
)
def _(spark, d):
    rows = s.table(spark, d, "events").select(
        F.col("event_id").alias("row_id"), F.concat_ws(" ", "event_type", "props").alias("src")
    )
    return b.batch_requests(b.assign_batches(rows)).select("batch", "expected_lines", "input_text")


def scored_batches(spark, d):
    pairs = s.progress(spark, d).select(
        F.col("seq").alias("row_id"), F.col("src").alias("source"), F.col("tgt").alias("target")
    )
    return b.score_requests(b.assign_batches(pairs, 10))


_SCORE_BATCHES = """SELECT rn // 10 AS batch, count(*)::INT AS expected_lines,
    string_agg({line}, '' ORDER BY rn) AS input_text
    FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS rn FROM progress) GROUP BY 1""".format(
    line=f"{strip_sql('src')} || ', ' || {strip_sql('tgt')} || chr(10)"
)
s.add_cte("score_batches", ("progress",), _SCORE_BATCHES)


@register("score_requests", sql("SELECT * FROM score_batches", "score_batches"))
def _(spark, d):
    return scored_batches(spark, d).select("batch", "expected_lines", "input_text")


@register(
    "align_lines",
    sql("SELECT batch, pos, row_id, src, upper(src) AS tgt FROM batched", "batched"),
)
def _(spark, d):
    requests = b.batch_requests(batched(spark, d))
    answered = requests.withColumn("lines", F.split(F.upper("input_text"), "\n"))
    return b.align_lines(answered)


s.add_cte(
    "postings",
    ("history",),
    """SELECT unnest(ts) AS token, seq, unnest(range(len(ts)))::INT AS tok_pos, src, tgt
       FROM (SELECT *, regexp_extract_all(src, '[A-Za-z0-9]{2,}') AS ts FROM history)""",
)


@register(
    "last_postings",
    sql(
        """SELECT token, seq, tok_pos, src, tgt FROM (SELECT *, row_number() OVER (
               PARTITION BY token ORDER BY seq DESC, tok_pos DESC) AS rn FROM postings) WHERE rn <= 20""",
        "postings",
    ),
)
def _(spark, d):
    return fuzzy.last_postings(fuzzy.postings(p.valid_history(s.progress(spark, d))))
