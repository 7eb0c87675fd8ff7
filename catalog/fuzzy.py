"""Retrieval of similar past lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog import standins as s
from catalog.batches import batched as ranked_lines
from catalog.standins import MARK, sql
from tmloom.operators import fuzzy as f
from tmloom.operators import progress as p
from tmloom.operators.scale import materialize

def add_chain(x: str) -> None:
    """From ``{x}met_pairs`` to ``{x}kept_hits``: similar pairs, first hits, ranks, and the walk that drops near duplicates."""
    s.add_ratios(f"{x}pair_ratios", (f"{x}met_pairs",), f"SELECT text AS a, hist_source AS b FROM {x}met_pairs")
    s.add_cte(
        f"{x}passing",
        (f"{x}met_pairs", f"{x}pair_ratios"),
        f"""SELECT m.*, sim FROM {x}met_pairs m JOIN {x}pair_ratios r ON r.a = m.text AND r.b = m.hist_source WHERE sim > 0.1""",
    )
    s.add_cte(
        f"{x}first_hits",
        (f"{x}passing",),
        f"""SELECT batch, hist_source, arg_min(hist_target, first) AS hist_target, arg_min(sim, first) AS sim, min(first) AS first
           FROM {x}passing GROUP BY batch, hist_source""",
    )
    s.add_cte(
        f"{x}ranked_hits",
        (f"{x}first_hits",),
        f"SELECT *, row_number() OVER (PARTITION BY batch ORDER BY sim DESC, first)::INT AS rank FROM {x}first_hits",
        stored=True,
    )
    s.add_ratios(
        f"{x}hit_ratios",
        (f"{x}ranked_hits",),
        f"""SELECT y.hist_source AS a, x.hist_source AS b FROM {x}ranked_hits x JOIN {x}ranked_hits y USING (batch)
           WHERE x.rank < y.rank""",
    )
    s.add_cte(
        f"{x}near_ones",
        (f"{x}hit_ratios",),
        f"SELECT a AS hist_source, list(b) AS near FROM {x}hit_ratios WHERE sim > 0.8 GROUP BY a",
        stored=True,
    )
    s.add_cte(
        f"{x}walk",
        (f"{x}ranked_hits", f"{x}near_ones"),
        f"""SELECT batch, 0 AS rank, []::VARCHAR[] AS kept FROM (SELECT DISTINCT batch FROM {x}ranked_hits)
           UNION ALL
           SELECT w.batch, w.rank + 1, CASE WHEN len(kept) < 50 AND NOT list_has_any(kept, coalesce(near, []))
                                            THEN list_append(kept, c.hist_source) ELSE kept END
           FROM {x}walk w JOIN {x}ranked_hits c ON c.batch = w.batch AND c.rank = w.rank + 1
           LEFT JOIN {x}near_ones n ON n.hist_source = c.hist_source""",
        recursive=True,
    )
    s.add_cte(
        f"{x}kept_hits",
        (f"{x}walk",),
        f"""SELECT h.batch, h.rank, h.hist_source, h.hist_target FROM {x}ranked_hits h
           JOIN (SELECT batch, arg_max(kept, rank) AS kept FROM {x}walk GROUP BY batch) w
             ON w.batch = h.batch AND list_contains(w.kept, h.hist_source)""",
    )


s.add_cte(
    "line_tokens",
    ("batched",),
    """SELECT batch, pos AS line_pos, src AS text, token, min(i)::INT AS tok_pos FROM (
         SELECT batch, pos, src, unnest(ts) AS token, unnest(range(len(ts))) AS i
         FROM (SELECT *, regexp_extract_all(src, '[A-Za-z0-9]{2,}') AS ts FROM batched))
       GROUP BY ALL""",
)
s.add_cte("wanted", ("line_tokens",), "SELECT DISTINCT batch, token FROM line_tokens")
s.add_cte(
    "recent",
    ("wanted", "postings"),
    """SELECT batch, token, src, tgt, seq, tok_pos FROM wanted JOIN (
         SELECT *, row_number() OVER (PARTITION BY token ORDER BY seq DESC, tok_pos DESC) AS rn
         FROM postings) USING (token) WHERE rn <= 20""",
)
s.add_cte(
    "done",
    ("batched",),
    "SELECT batch, pos, src, upper(src) AS tgt FROM batched WHERE src NOT LIKE '%ring%'",
)
s.add_cte(
    "causal",
    ("causal_recent",),
    "SELECT batch, token, src, tgt FROM causal_recent",
)
s.add_cte(
    "causal_recent",
    ("wanted", "postings", "done"),
    """SELECT batch, token, b, o, tok_pos, src, tgt FROM (
         SELECT w.batch, w.token, p.b, p.o, p.tok_pos, p.src, p.tgt, row_number() OVER (
                  PARTITION BY w.batch, w.token ORDER BY p.b DESC, p.o DESC, p.tok_pos DESC) AS rn
         FROM wanted w JOIN (
           SELECT token, -1 AS b, seq AS o, tok_pos, src, tgt FROM postings
           UNION ALL SELECT unnest(ts), batch, pos, unnest(range(len(ts))), src, tgt
           FROM (SELECT *, regexp_extract_all(src, '[A-Za-z0-9]{2,}') AS ts FROM done)) p
         ON p.token = w.token AND p.b < w.batch) WHERE rn <= 20""",
)


def batched(spark, d):
    """Ranked once and written, as the line chain does before retrieval."""
    return materialize(ranked_lines(spark, d), "batched")


def history(spark, d):
    return p.valid_history(s.progress(spark, d))


def wanted(lines):
    return f.line_tokens(lines).select("batch", "token").distinct()


def done(lines):
    """Finished rows of the same lines; those with a ring failed."""
    finished = F.when(F.col("src").contains("ring"), MARK).otherwise(F.upper("src"))
    rows = lines.withColumn("tgt", finished)
    return rows.where(F.col("tgt") != MARK).select("batch", "pos", "src", "tgt")


def snapshot_pairs(spark, d):
    lines = f.line_tokens(batched(spark, d))
    return f.in_batches(f.text_pairs(lines, f.postings(history(spark, d))), lines)


def passing(spark, d):
    lines = f.line_tokens(batched(spark, d))
    return f.in_batches(f.similar_text_pairs(f.text_pairs(lines, f.postings(history(spark, d)))), lines)


@register("line_tokens", sql("SELECT * FROM line_tokens", "line_tokens"))
def _(spark, d):
    return f.line_tokens(batched(spark, d))


@register("snapshot_postings", sql("SELECT batch, token, src, tgt FROM recent", "recent"))
def _(spark, d):
    posted = f.postings(history(spark, d))
    return f.snapshot_postings(wanted(batched(spark, d)), posted).drop("ord")


@register("causal_postings", sql("SELECT * FROM causal", "causal"))
def _(spark, d):
    lines = batched(spark, d)
    return f.causal_postings(wanted(lines), history(spark, d), done(lines)).drop("ord")


@register(
    "candidate_pairs",
    sql(
        """SELECT batch, text, src AS hist_source, arg_min(tgt, row(line_pos, t.tok_pos, r.seq, r.tok_pos))
                  AS hist_target
           FROM line_tokens t JOIN recent r USING (batch, token) GROUP BY ALL""",
        "line_tokens",
        "recent",
    ),
)
def _(spark, d):
    """Inverted-index retrieval before the similarity check."""
    return snapshot_pairs(spark, d).drop("at")


s.add_cte(
    "met_pairs",
    ("line_tokens", "recent"),
    """SELECT batch, text, src AS hist_source, arg_min(tgt, row(line_pos, t.tok_pos, r.seq, r.tok_pos)) AS hist_target,
              min(row(line_pos, t.tok_pos, r.seq, r.tok_pos)) AS first
       FROM line_tokens t JOIN recent r USING (batch, token) GROUP BY ALL""",
)
add_chain("")
s.add_cte(
    "causal_met_pairs",
    ("line_tokens", "causal_recent"),
    """SELECT batch, text, src AS hist_source, arg_min(tgt, row(line_pos, t.tok_pos, b, o, r.tok_pos)) AS hist_target,
              min(row(line_pos, t.tok_pos, b, o, r.tok_pos)) AS first
       FROM line_tokens t JOIN causal_recent r USING (batch, token) GROUP BY ALL""",
)
add_chain("causal_")


@register(
    "fuzzy_candidates",
    sql("SELECT batch, text, hist_source, hist_target, sim FROM passing", "passing"),
)
def _(spark, d):
    return passing(spark, d).drop("at")


def first_hits(spark, d):
    return f.first_passing_hit(passing(spark, d))


@register(
    "first_passing_hit", sql("SELECT batch, hist_source, hist_target, sim FROM first_hits", "first_hits")
)
def _(spark, d):
    return first_hits(spark, d).drop("at")


@register(
    "rank_candidates", sql("SELECT batch, hist_source, hist_target, sim, rank FROM ranked_hits", "ranked_hits")
)
def _(spark, d):
    return f.rank_candidates(first_hits(spark, d)).drop("at")


@register(
    "suppress_near_duplicates", sql("SELECT batch, rank, hist_source, hist_target FROM kept_hits", "kept_hits")
)
def kept(spark, d):
    return f.suppress_near_duplicates(f.rank_candidates(first_hits(spark, d)))


_LISTS = """SELECT batch, '[' || string_agg('{"source":"' || hist_source || '","target":"' || hist_target || '"}', ','
                              ORDER BY rank) || ']' AS tm_list
    FROM <kept> GROUP BY batch"""


@register("tm_lists", sql(_LISTS.replace("<kept>", "kept_hits"), "kept_hits"))
def _(spark, d):
    return f.tm_lists(kept(spark, d)).withColumn("tm_list", F.to_json("tm_list"))


@register("retrieve_hints_causal", sql(_LISTS.replace("<kept>", "causal_kept_hits"), "causal_kept_hits"))
def _(spark, d):
    lines = batched(spark, d)
    lists = f.retrieve_hints(lines, history(spark, d), done(lines))
    return lists.withColumn("tm_list", F.to_json("tm_list"))
