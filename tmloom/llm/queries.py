"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmloom.llm.exact import exact_groups
from tmloom.llm.flat_graph import near_vectors
from tmloom.llm.folds import fold
from tmloom.llm.html import main_text
from tmloom.llm.language import identify
from tmloom.llm.mix import mix
from tmloom.llm.neighbours import nearest
from tmloom.llm.pieces import encode
from tmloom.llm.quality import score_quality
from tmloom.llm.repair import repair
from tmloom.llm.runs import periodic_runs
from tmloom.llm.simhash import near_groups
from tmloom.llm.toxicity import score_toxicity
from tmloom.llm.urls import (
    BLOCKED_WORDS,
    DEFAULT_VERDICT,
    filter_urls,
    rules_table,
    site_rule,
    word_rule,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def bind(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return bind


def tokenizer_path() -> str:
    """The model file that the queries encode with; the operator takes any."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@register(
    "op1_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
              doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register(
    "op7_mix_sources",
    r"""
WITH sizes AS (
  SELECT doc_id AS id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM sizes GROUP BY source),
b AS (
  SELECT *, [5, 2, 1][(source_no % 3 + 1)::INT] AS weight, 2 * source_size AS bound FROM s),
t AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total,
         ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE
           - coalesce(sum(bound) OVER (ORDER BY bound::DOUBLE / weight, source_no
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT::DOUBLE)
         / (sum(weight) OVER (ORDER BY bound::DOUBLE / weight, source_no
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT::DOUBLE AS lvl
  FROM b),
target AS (
  SELECT *, least(bound::DOUBLE, weight::DOUBLE * max(lvl) OVER ()) AS target,
         floor(total / 32 + 0.5)::BIGINT AS all_blocks FROM t),
-- every quotient of every source: the plain rule
q AS (
  SELECT source_no, k, target / (2 * k - 1) AS quotient, all_blocks
  FROM (SELECT source_no, target, all_blocks,
               unnest(range(1, (floor(target / 32 + 0.5) + 100)::BIGINT)) AS k FROM target)),
won AS (
  SELECT source_no, count(*) AS quota
  FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source_no, k) AS r FROM q)
  WHERE r <= all_blocks AND quotient > 0 GROUP BY source_no),
dealt AS (
  SELECT x.id, x.size, g.source_no, g.source_size, g.target, coalesce(w.quota, 0) AS quota,
         ('0x' || substr(md5('42|shard|' || coalesce(x.id::VARCHAR, '')), 1, 8))::BIGINT
           % ceil(g.source_rows / 4096)::BIGINT AS shard
  FROM sizes x JOIN target g ON x.source IS NOT DISTINCT FROM g.source
  LEFT JOIN won w ON w.source_no = g.source_no),
shards AS (
  SELECT source_no, shard, sum(size)::BIGINT AS words, ceil(sum(size)::BIGINT / 32.0::DOUBLE)::BIGINT AS blocks,
         any_value(quota) AS quota
  FROM dealt GROUP BY source_no, shard),
sq AS (
  SELECT source_no, shard, k, words::DOUBLE / (2 * k - 1) AS quotient, quota
  FROM (SELECT *, unnest(range(1, 2 * blocks + 1)) AS k FROM shards)),
swon AS (
  SELECT source_no, shard, count(*) AS seats
  FROM (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY quotient DESC, shard, k) AS r
        FROM sq)
  WHERE r <= quota AND quotient > 0 GROUP BY source_no, shard),
sel AS (
  SELECT h.source_no, h.shard, h.blocks, coalesce(w.seats, 0) // greatest(h.blocks, 1) AS copies,
         coalesce(w.seats, 0) % greatest(h.blocks, 1) AS rest,
         ('0x' || substr(md5('42|start|' || h.source_no || '|' || h.shard), 1, 8))::BIGINT
           % greatest(h.blocks, 1) AS a
  FROM shards h LEFT JOIN swon w ON w.source_no = h.source_no AND w.shard = h.shard),
placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source_no, shard
                ORDER BY md5('42|' || coalesce(id::VARCHAR, '')), id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS stop FROM dealt)
SELECT p.id AS doc_id, size, source_size, target,
       (copies * size
        + greatest(0, least(stop, least(a + rest, blocks) * 32) - greatest(stop - size, a * 32))
        + greatest(0, least(stop, (a + rest - blocks) * 32) - (stop - size)))::BIGINT AS taken
FROM placed p JOIN sel ON sel.source_no = p.source_no AND sel.shard = p.shard""",
)
def op7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@register("op3_simhash_near_dedup")
def op3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return near_groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@register("op6_sentencepiece")
def op6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return encode(docs, tokenizer_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@register("op5_toxicity")
def op5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    return score_toxicity(docs, labels.where(fold("doc_id", 5) != 0)).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@register("op10_language_id")
def op10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return identify(docs, docs.where(fold("doc_id", 3) != 1)).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


@register("op8_quality")
def op8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return score_quality(docs, labels.where(fold("doc_id", 4) != 2)).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


SITE_RULES = (
    site_rule("org", "/", "allow"),
    site_rule("example.org", "/es/", "block"),
    site_rule("example.org", "/en/1", "block"),
    site_rule("com", "/fr/", "allow"),
    site_rule("com", "/de/", "block"),
)
_ALTERNATIVES = "|".join(BLOCKED_WORDS)


@register(
    "op4_url_filter",
    rf"""
WITH split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT page_id, host, path,
         (SELECT arg_max(h || p || '>' || v, length(h || p)) FROM rules
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS won
  FROM split)
SELECT page_id, host, path, split_part(won, '>', 1) AS rule,
       CASE WHEN won IS NOT NULL THEN split_part(won, '>', 2)
            WHEN regexp_matches(host, '(^|[^a-z0-9])({_ALTERNATIVES})([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged""",
)
def op4(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    rules = rules_table(spark, [*SITE_RULES, *map(word_rule, BLOCKED_WORDS)])
    return filter_urls(pages, rules).select(
        "page_id", "host", "path",
        F.when(F.col("rank") > 0, F.col("rule")).alias("rule"),
        F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )


@register("op9_html_extraction")
def op9(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    return main_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


@register("op2_nearest_neighbours")
def op2(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations as ``op11`` damages them; a null is one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"),
        copies.alias("copy"),
    )


@register(
    "op11_repair",
    r"""
WITH RECURSIVE
table_ AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
               lambda c: ascii(c)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM conversations, table_),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM given WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
              ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i,
         regexp_extract(text, '(?s)([^ 	-
])[ 	-
]*$', 1) AS mark
  FROM rows_),
faults AS (
  SELECT *, left(role, 1) AS x,
         CASE WHEN mark = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM placed),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
         count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
-- v[s + 1]: cheapest cost c and least letters l from place i to the end in state s (begin, after s, u, a)
suffix AS (
  SELECT conv_id, n AS i, [{'c': 0, 'l': ''}, {'c': 4, 'l': 'II'}, {'c': 2, 'l': 'I'}, {'c': 0, 'l': ''}] AS v FROM sums
  UNION ALL
  SELECT conv_id, i, list_transform([0, 1, 2, 3], lambda s: least(e[s + 1],
           {'c': 2 + e[CASE s WHEN 2 THEN 4 ELSE 3 END].c, 'l': 'I' || e[CASE s WHEN 2 THEN 4 ELSE 3 END].l},
           {'c': 4 + e[CASE s WHEN 2 THEN 3 ELSE 4 END].c, 'l': 'II' || e[CASE s WHEN 2 THEN 3 ELSE 4 END].l}))
  FROM (
    SELECT f.conv_id, f.i - 1 AS i, list_transform([0, 1, 2, 3], lambda s: least(
             {'c': 3 + v[s + 1].c, 'l': 'D' || v[s + 1].l},
             CASE WHEN fault IN ('blank', 'duplicate') THEN {'c': 1000000000, 'l': ''}
                  ELSE {'c': 2 + (fault = 'truncated')::INT + v[CASE s WHEN 2 THEN 4 ELSE 3 END].c,
                        'l': 'R' || v[CASE s WHEN 2 THEN 4 ELSE 3 END].l} END,
             CASE WHEN fault IN ('blank', 'duplicate') THEN {'c': 1000000000, 'l': ''}
                  WHEN (x = 's' AND s = 0) OR (x = 'u' AND s <> 2) OR (x = 'a' AND s = 2)
                  THEN {'c': (fault = 'truncated')::INT + v[CASE x WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c,
                        'l': 'K' || v[CASE x WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].l}
                  ELSE {'c': 1000000000, 'l': ''} END)) AS e
    FROM suffix JOIN faults f ON f.conv_id IS NOT DISTINCT FROM suffix.conv_id AND f.i = suffix.i)),
best AS (SELECT conv_id, v[1].c AS cost, v[1].l AS audit FROM suffix WHERE i = 0),
letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS y, unnest(range(1, length(audit) + 1)) AS k FROM best WHERE audit <> ''),
walked AS (
  SELECT *, count_if(y <> 'I') OVER w AS i, count_if(y <> 'D') OVER w AS nth FROM letters
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
told AS (
  SELECT w.conv_id, k, y, nth, f.role, f.text, coalesce(max(CASE WHEN nth = 1 AND y = 'K' AND x = 's' THEN 1 END)
           OVER (PARTITION BY w.conv_id), 0) AS lead_
  FROM walked w LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE y <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN y = 'K' THEN role WHEN (nth - lead_) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || CASE WHEN y = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said
  FROM told GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id""",
)
def op11(spark, d):
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(given)).withColumnRenamed("conv_id", "_conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = given.select("conv_id").distinct()
    return every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def with_loops(docs: DataFrame) -> DataFrame:
    """Documents whose id hashes to a multiple of ten repeat a stretch of their words to the end; null ids do not."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    placed = cut.select("*", F.size("words").alias("n"), F.pmod("g", F.greatest(F.size("words"), F.lit(1))).alias("a"))
    loop = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    looped = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return placed.withColumn("p", loop).select(
        "doc_id", F.when(F.col("n") > 0, F.array_join(looped, " ")).otherwise(F.col("text")).alias("text")
    )


@register(
    "op13_periodic_runs",
    r"""
WITH table_ AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
given AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
               lambda c: ascii(c)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM documents, table_),
sized AS (
  SELECT *, len(words)::BIGINT AS n, h // 10 AS g, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM given),
docs AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
           words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE words END AS w
  FROM sized),
placed AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
-- five words at a time: a stretch of m matching places holds m - 4 matching fives
fives AS (
  SELECT r, n, i, string_agg(word, ' ') OVER f AS g, count(*) OVER f AS k FROM placed
  WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
pairs AS (
  SELECT a.r, a.i, b.i - a.i AS q FROM fives a JOIN fives b ON a.r = b.r AND a.g = b.g AND b.i > a.i
  WHERE a.k = 5 AND b.k = 5 AND 4 * (b.i - a.i) <= a.n),
stretches AS (
  SELECT r, q, min(i) AS s, max(i) + 5 AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
runs AS MATERIALIZED (
  SELECT r, s AS start, e - s + q AS length, min(q) AS period FROM stretches
  WHERE e - s >= greatest(3 * q, 6 - q) GROUP BY r, s, e - s + q),
told AS (
  SELECT r, count(*) AS n_runs, min({'n': -length, 's': start, 'q': period}) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, -best.n AS length, best.q AS period,
       -1000 * best.n // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (r) LEFT JOIN kept USING (r)""",
)
def op13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = periodic_runs(with_loops(docs), digest=True)
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    order = lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    best = F.array_max(F.transform("runs", order))
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), "best.length",
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


@register(
    "op12_near_vectors",
    """
WITH RECURSIVE
valid AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM valid a JOIN valid b
  ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT r AS a, r AS b FROM valid
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN valid ON valid.r = reach.b GROUP BY 1),
judged AS (
  SELECT vec_id, component_id, (SELECT count(*) FROM links WHERE links.a = valid.r) AS n_links
  FROM valid JOIN least USING (r))
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM judged
UNION ALL
SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE NOT coalesce(label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)""",
)
def op12(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return near_vectors(rows).select("vec_id", "n_links", "component_id", "kept")


@register("pipeline")
def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)
