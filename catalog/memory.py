"""Translation memory, glossary hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog import standins as s
from catalog.batches import fresh_path
from catalog.standins import sql
from tmloom.operators import hints as h
from tmloom.operators import memory as m
from tmloom.sources import files, sinks

_ENTRY = """doc_key, source_hash, page, block_id, source_text, translation, attempts,
            elapsed_seconds, status, error_message, cache_hit, len(term_pairs)::INT AS terms"""


def flat(df):
    return df.select(
        "doc_key", "source_hash", "result.page", "result.block_id", "result.source_text",
        "result.translation", "result.attempts", "result.elapsed_seconds", "result.status",
        "result.error_message", "result.cache_hit", F.size("result.term_pairs").alias("terms"),
    )


@register("read_memory", sql(f"SELECT {_ENTRY} FROM memory", "memory"))
def _(spark, d):
    path = fresh_path(spark, "memory")
    s.memory(spark, d).select("doc_key", "source_hash", "result").write.json(path)
    return flat(files.read_memory(spark, path))


@register(
    "append_memory",
    sql(f"SELECT {_ENTRY} FROM memory", "memory"),
)
def _(spark, d):
    return flat(appended(spark, d))


def appended(spark, d):
    """Two runs of a log whose positions overlap: both start at the same page numbers."""
    path = fresh_path(spark, "memory")
    log = s.memory(spark, d)
    later = F.col("seq") >= s.LATER
    sinks.append_memory(log.where(~later), path, "run-0")
    sinks.append_memory(log.where(later).withColumn("seq", F.col("seq") - s.LATER), path, "run-1")
    return files.read_memory_log(spark, path)


@register("append_memory_latest", sql(f"SELECT {_ENTRY} FROM latest_memory", "latest_memory"))
def _(spark, d):
    """The last entry of each hash after two appends."""
    return flat(m.latest_memory(appended(spark, d)))


@register("latest_memory", sql(f"SELECT first_seq, {_ENTRY} FROM latest_memory", "latest_memory"))
def _(spark, d):
    latest = m.latest_memory(s.memory(spark, d))
    return flat(latest).withColumn("source_hash", F.col("source_hash")).join(
        latest.select("doc_key", "source_hash", "first_seq"), ["doc_key", "source_hash"]
    )


@register(
    "term_frequencies",
    sql("SELECT doc_key, source, target, frequency, first_seen FROM terms", "terms"),
)
def _(spark, d):
    terms = m.term_frequencies(s.memory(spark, d))
    seen = F.col("first_seen")
    return terms.withColumn("first_seen", seen["first_seq"] * 1000000 + seen["pos"])


s.add_cte(
    "whole_blocks",
    (),
    """SELECT lang AS doc_key, doc_id::INT AS page, 1 AS block_no,
              printf('P%03d-B%03d', doc_id, 1) AS block_id, text AS source_text FROM documents""",
)
s.add_cte(
    "hits",
    ("whole_blocks", "latest_memory"),
    """SELECT b.*, l.translation, l.term_pairs FROM whole_blocks b JOIN latest_memory l
         ON b.doc_key = l.doc_key AND sha1(b.source_text) = l.source_hash
        AND b.source_text = l.source_text""",
)


@register(
    "lookup_exact_hits",
    sql(
        """SELECT doc_key, page, block_no, block_id, translation, len(term_pairs)::INT AS terms,
                  0 AS attempts, 0.0::DOUBLE AS elapsed_seconds, 'ok' AS status, '' AS error_message,
                  true AS cache_hit FROM hits""",
        "hits",
    ),
)
def _(spark, d):
    hits, _misses = m.lookup_exact(s.whole_blocks(spark, d), s.memory(spark, d))
    return hits.withColumn("terms", F.size("term_pairs")).drop("term_pairs", "source_text")


@register(
    "lookup_exact_misses",
    sql(
        """SELECT doc_key, page, source_text FROM whole_blocks b
           WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.page = b.page)""",
        "hits",
    ),
)
def _(spark, d):
    _hits, misses = m.lookup_exact(s.whole_blocks(spark, d), s.memory(spark, d))
    return misses.select("doc_key", "page", "source_text")


@register(
    "combine_results",
    sql(
        """SELECT doc_key, page, translation, true AS cache_hit FROM hits
           UNION ALL SELECT doc_key, page, 'fresh ' || source_text, false FROM whole_blocks b
           WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.page = b.page)""",
        "hits",
    ),
)
def _(spark, d):
    hits, misses = m.lookup_exact(s.whole_blocks(spark, d), s.memory(spark, d))
    columns = ["doc_key", "page", "translation", "cache_hit"]
    fresh = misses.withColumns(
        {"translation": F.concat(F.lit("fresh "), "source_text"), "cache_hit": F.lit(False)}
    )
    return m.combine_results(hits.select(*columns), fresh.select(*columns))


@register(
    "upsert_memory",
    sql(
        """SELECT doc_key, page, source_hash, translation FROM (
             SELECT *, lag(v) OVER (PARTITION BY doc_key, source_hash ORDER BY fresh, page) AS before
             FROM (SELECT doc_key, page, sha1(source_text) AS source_hash, translation, true AS fresh,
                          [source_text, translation, term_pairs::VARCHAR] AS v
                   FROM lang_results WHERE status = 'ok' AND NOT cache_hit
                   UNION ALL SELECT doc_key, 0, source_hash, translation, false,
                          [source_text, translation, term_pairs::VARCHAR] FROM latest_memory))
           WHERE fresh AND v IS DISTINCT FROM before""",
        "latest_memory",
    ),
)
def _(spark, d):
    new = m.upsert_memory(s.memory(spark, d), s.results(spark, d, by_lang=True))
    return new.select("doc_key", "result.page", "source_hash", "result.translation")


s.add_cte(
    "contained",
    ("whole_blocks", "terms"),
    """SELECT b.doc_key, b.page, b.block_no, t.source, t.target, t.frequency, t.first_seen
       FROM whole_blocks b JOIN terms t ON b.doc_key = t.doc_key
        AND contains(lower(b.source_text), lower(t.source)) AND t.source <> ''""",
)
s.add_cte(
    "hinted",
    ("contained",),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, page, block_no
           ORDER BY frequency DESC, length(source) DESC, first_seen, source, target)::INT AS rank
           FROM contained) WHERE rank <= 8""",
)


def terms(spark, d):
    return m.term_frequencies(s.memory(spark, d))


@register(
    "contained_terms",
    sql("SELECT doc_key, page, block_no, source, target, frequency FROM contained", "contained"),
)
def _(spark, d):
    found = h.contained_terms(s.whole_blocks(spark, d), terms(spark, d))
    return found.drop("first_seen")


s.add_cte(
    "shared_terms",
    ("terms",),
    """SELECT source, target, sum(frequency)::BIGINT AS frequency FROM terms WHERE source <> '' GROUP BY ALL""",
)


@register(
    "contained_terms_large",
    sql(
        """SELECT b.doc_key, b.page, b.block_no, t.source, t.target, t.frequency
           FROM whole_blocks b JOIN shared_terms t ON contains(lower(b.source_text), lower(t.source))""",
        "whole_blocks",
        "shared_terms",
    ),
)
def _(spark, d):
    """One glossary for all documents."""
    found = h.contained_terms(s.whole_blocks(spark, d), terms(spark, d), scope=())
    return found.drop("first_seen")


@register(
    "top_hints",
    sql("SELECT doc_key, page, block_no, source, target, rank FROM hinted", "hinted"),
)
def _(spark, d):
    return h.best_terms(s.whole_blocks(spark, d), terms(spark, d))


@register(
    "glossary_hints",
    sql(
        """SELECT doc_key, page, block_no,
                  string_agg(source || '=' || target, '|' ORDER BY rank) AS hints
           FROM hinted GROUP BY ALL""",
        "hinted",
    ),
)
def _(spark, d):
    lists = h.glossary_hints(s.whole_blocks(spark, d), terms(spark, d))
    text = F.transform("hints", lambda p: F.concat_ws("=", p["source"], p["target"]))
    return lists.withColumn("hints", F.array_join(text, "|"))
