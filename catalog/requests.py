"""Requests, attempts and responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import register
from catalog import standins as s
from catalog.batches import batched, scored_batches
from catalog.memory import terms
from catalog.standins import sql, strip_sql
from tmloom.functions import fixed_values as fv
from tmloom.functions import responses as r
from tmloom.operators import attempts as a
from tmloom.operators import batches as b
from tmloom.operators import prompts
from tmloom.operators.hints import glossary_hints
from tmloom.operators.scale import materialize


def q(text: str) -> str:
    """A fixed text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# What is contained, by the words of the texts: a term of one word lies inside a word.
s.add_cte(
    "hinted_by_word",
    ("whole_blocks", "terms"),
    """SELECT doc_key, page, block_no, source, target, row_number() OVER (PARTITION BY doc_key, page, block_no
             ORDER BY frequency DESC, length(source) DESC, first_seen, source, target) AS rank
       FROM (
         WITH words AS (
           SELECT DISTINCT doc_key, page, block_no, unnest(regexp_extract_all(lower(source_text), '[a-z]+')) AS word
           FROM whole_blocks),
         inside AS (
           SELECT w.doc_key, word, source FROM (SELECT DISTINCT doc_key, word FROM words) w
           JOIN (SELECT DISTINCT doc_key, source FROM terms WHERE regexp_full_match(source, '[a-z]+')) t
             ON w.doc_key = t.doc_key AND contains(word, source))
         SELECT b.*, t.target, t.frequency, t.first_seen
         FROM (SELECT DISTINCT doc_key, page, block_no, source FROM words JOIN inside USING (doc_key, word)) b
         JOIN terms t USING (doc_key, source)
         UNION ALL
         SELECT b.doc_key, b.page, b.block_no, t.source, t.target, t.frequency, t.first_seen
         FROM whole_blocks b JOIN terms t ON b.doc_key = t.doc_key AND t.source <> ''
           AND NOT regexp_full_match(t.source, '[a-z]+') AND contains(lower(b.source_text), lower(t.source)))
       QUALIFY rank <= 8""",
)


@register(
    "block_prompts",
    sql(
        f"""SELECT doc_key, page, {q(fv.BLOCK_SYSTEM)} AS system_text,
                   {q(fv.BLOCK_ID_LABEL)} || block_id || chr(10) || {q(fv.BLOCK_PAGE_LABEL)} || page
                   || chr(10) || {q(fv.BLOCK_ASK)} || source_text || coalesce({q(fv.BLOCK_HINTS_HEAD)}
                   || hints || {q(fv.BLOCK_HINTS_TAIL)}, '') AS user_text
            FROM whole_blocks LEFT JOIN (
              SELECT doc_key, page, block_no,
                     string_agg('- ' || source || ' => ' || target, chr(10) ORDER BY rank) AS hints
              FROM hinted_by_word GROUP BY ALL) USING (doc_key, page, block_no)""",
        "hinted_by_word",
    ),
)
def _(spark, d):
    blocks = s.whole_blocks(spark, d)
    made = prompts.block_prompts(blocks, glossary_hints(blocks, terms(spark, d)))
    return made.select("doc_key", "page", "system_text", "user_text")


def past_hints(spark, d):
    """One recorded hint per batch: its first line with the upper-case text."""
    first = batched(spark, d).where(F.col("pos") == 0)
    pair = F.struct(F.col("src").alias("source"), F.upper("src").alias("target"))
    return first.select("batch", F.array(pair).alias("tm_list"))


s.add_cte(
    "request_texts",
    ("batched",),
    """SELECT batch, string_agg(src, chr(10) ORDER BY pos) AS input_text, arg_min(src, pos) AS first
       FROM batched GROUP BY batch""",
)
_TM = """'[{"source":"' || first || '","target":"' || upper(first) || '"}]'"""


@register(
    "line_requests",
    sql(
        f"""SELECT batch, input_text, '{{"source_lang":"zh","target_lang":"en","tm_list":' || {_TM}
                   || ',"domains":' || {q('"' + fv.LINE_INSTRUCTION.replace(chr(10), chr(92) + 'n') + '"}')}
                   AS options FROM request_texts""",
        "request_texts",
    ),
)
def _(spark, d):
    made = prompts.line_requests(b.batch_requests(batched(spark, d)), past_hints(spark, d))
    return made.select("batch", "input_text", "options")


@register(
    "batch_audit",
    sql(
        f"""SELECT batch * 25 AS batch_index, 1 AS tm_count, {_TM} AS tm_content, input_text
            FROM request_texts""",
        "request_texts",
    ),
)
def _(spark, d):
    requests = b.batch_requests(batched(spark, d)).join(past_hints(spark, d), "batch")
    return b.batch_audit(requests)


@register(
    "score_prompts",
    sql(
        f"""SELECT batch, {q(fv.SCORE_SYSTEM)} AS system_text,
                   {q(fv.SCORE_RUBRIC_HEAD)} || input_text || chr(10) AS user_text
            FROM score_batches""",
        "score_batches",
    ),
)
def _(spark, d):
    made = prompts.score_prompts(scored_batches(spark, d))
    return made.select("batch", "system_text", "user_text")


@register(
    "verify_prompts",
    sql(
        f"""SELECT batch, {q(fv.VERIFY_HEAD + fv.VERIFY_SOURCE_LABEL)} || string_agg(src, chr(10) ORDER BY pos)
                   || chr(10) || chr(10) || {q(fv.VERIFY_TARGET_LABEL)}
                   || string_agg(upper(src), chr(10) ORDER BY pos) AS user_text
            FROM batched GROUP BY batch HAVING batch % 3 <> 0""",
        "batched",
    ),
)
def _(spark, d):
    """Every third batch has a list that is one line short: no question asked."""
    requests = b.batch_requests(batched(spark, d))
    upper = F.transform("sources", F.upper)
    short = F.slice(upper, F.lit(1), F.size("sources") - 1)
    candidates = F.when(F.col("batch") % 3 == 0, short).otherwise(upper)
    made = prompts.verify_prompts(requests.withColumn("candidates", candidates))
    return made.select("batch", "user_text")


def upper_model_factory():
    def build():
        return lambda request: {"body": request["payload"].upper(), "status_code": 200}

    return build


@register(
    "call_model",
    sql(
        """SELECT batch AS request_id, 1 AS attempt, 200 AS status_code, upper(input_text) AS body
           FROM request_texts""",
        "request_texts",
    ),
)
def _(spark, d):
    requests = b.batch_requests(batched(spark, d)).select(
        F.col("batch").alias("request_id"), F.col("input_text").alias("payload")
    )
    made = a.call_model(requests, upper_model_factory())
    return made.select("request_id", "attempt", "status_code", "body")


@register(
    "replay_attempts",
    sql(
        """SELECT request_id, attempt, body FROM attempts""",
        "attempts",
    ),
)
def _(spark, d):
    """All waves of the recorded attempts, one after the other."""
    attempts = s.attempts(spark, d).withColumns(
        {"status_code": F.lit(200), "retry_after": F.lit(None).cast("string")}
    )
    # a record is a stored table; every wave reads it
    recorded = materialize(attempts, "recorded")
    requests = materialize(recorded.select("request_id").distinct(), "asked")
    call = a.replay_caller(recorded)
    waves = [call(requests, n).select("request_id", "attempt", "body") for n in range(1, 8)]
    return reduce(DataFrame.unionByName, waves)


@register(
    "resolve_attempts",
    sql(
        """SELECT request_id, CASE WHEN bool_or(accepted) THEN 'ok' ELSE 'failed' END AS status,
                  coalesce(min(attempt) FILTER (accepted), 7) AS attempts,
                  arg_min(body, attempt) FILTER (accepted) AS body,
                  sum(elapsed_seconds) AS elapsed_seconds,
                  CASE WHEN bool_or(accepted) THEN '' ELSE arg_max(error_message, attempt) END
                    AS error_message
           FROM attempts GROUP BY request_id""",
        "attempts",
    ),
)
def _(spark, d):
    return a.resolve_attempts(s.attempts(spark, d), 7, ["body"])


# --- alignment of answers ---------------------------------------------------------


def answers(spark, d):
    """Whole documents as answers; the expected count is right, short or long by language."""
    n = F.size(F.split(F.btrim("text", F.lit("\n")), "\n"))
    lang = F.col("lang")
    expected = (
        F.when(lang == "fr", F.greatest(n - 1, F.lit(1))).when(lang == "de", n + 1).otherwise(n)
    )
    verdict = F.when(F.col("n_chars") % 2 == 0, "yes.").otherwise("No")
    return s.table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("body"), expected.alias("expected_lines"),
        verdict.alias("verdict"),
    )


s.add_cte(
    "answers",
    (),
    f"""SELECT doc_id, ls, CASE lang WHEN 'fr' THEN greatest(n - 1, 1) WHEN 'de' THEN n + 1 ELSE n END AS n,
               n_chars % 2 = 0 AS yes
        FROM (SELECT doc_id, lang, n_chars, string_split({strip_sql('text')}, chr(10)) AS ls,
                     len(string_split(trim(text, chr(10)), chr(10))) AS n FROM documents)""",
)
s.add_cte(
    "aligned",
    ("answers",),
    """SELECT doc_id, n, CASE WHEN len(ls) = n THEN ls WHEN len(ls) > n AND yes THEN ls[-n:] END AS ls
       FROM answers""",
)


@register(
    "align_or_repair",
    sql("SELECT doc_id, array_to_string(ls, '|') AS lines FROM aligned", "aligned"),
)
def _(spark, d):
    lines = r.align_or_repair("body", "expected_lines", "verdict")
    return answers(spark, d).select("doc_id", F.array_join(lines, "|").alias("lines"))


@register(
    "fill_failed_lines",
    sql(
        f"""SELECT doc_id AS request_id, coalesce(array_to_string(ls, '|'),
                   array_to_string(list_transform(range(n), lambda i: '{fv.FAILURE_MARK}'), '|')) AS lines,
                   CASE WHEN ls IS NULL THEN 'failed' ELSE 'ok' END AS status FROM aligned""",
        "aligned",
    ),
)
def _(spark, d):
    requests = answers(spark, d).withColumnRenamed("doc_id", "request_id")
    lines = r.align_or_repair("body", "expected_lines", "verdict")
    resolved = requests.select("request_id", lines.alias("lines"), F.lit("ok").alias("status"))
    filled = a.fill_failed_lines(requests, resolved.where(F.col("lines").isNotNull()))
    return filled.select("request_id", F.array_join("lines", "|").alias("lines"), "status")


# --- JSON bodies -------------------------------------------------------------------

_OBJECT = (
    "regexp_extract(CASE WHEN regexp_matches(trim(body, chr(10)), '(?s)^```(json)?.*```$') "
    "THEN regexp_replace(body, '```(json)?', '', 'g') ELSE body END, '(?s)\\{.*\\}')"
)
s.add_cte(
    "parsed",
    ("bodies",),
    f"""SELECT doc_id, CASE WHEN json_valid(o) THEN o END AS o FROM (
        SELECT doc_id, {_OBJECT} AS o FROM bodies)""",
)


@register(
    "parse_json_body",
    sql(
        f"""SELECT doc_id, nullif({strip_sql("json_extract_string(o, '$.translation')")}, '') AS translation
            FROM parsed""",
        "parsed",
    ),
)
def _(spark, d):
    payload = r.parse_json_body("body")
    return s.bodies(spark, d).select("doc_id", r.parse_translation(payload).alias("translation"))


@register(
    "parse_terms",
    sql(
        """SELECT doc_id, trim(json_extract_string(t, '$.source')) AS source,
                  trim(json_extract_string(t, '$.target')) AS target
           FROM (SELECT doc_id, unnest(from_json(json_extract(o, '$.terms'), '["JSON"]')) AS t
                 FROM parsed WHERE o IS NOT NULL)
           WHERE json_type(t) = 'OBJECT' AND trim(coalesce(json_extract_string(t, '$.source'), '')) <> ''
             AND trim(coalesce(json_extract_string(t, '$.target'), '')) <> ''""",
        "parsed",
    ),
)
def _(spark, d):
    payloads = s.bodies(spark, d).select("doc_id", r.parse_json_body("body").alias("payload"))
    return payloads.select("doc_id", F.inline(r.parse_terms(F.col("payload"))))


@register(
    "fill_failed_blocks",
    sql(
        """SELECT p.doc_id AS page, coalesce(nullif(trim(json_extract_string(o, '$.translation'), ' '
                  || chr(10)), ''), '') AS translation,
                  CASE WHEN o IS NULL THEN 4 ELSE 1 END AS attempts,
                  CASE WHEN o IS NULL THEN 'failed' ELSE 'ok' END AS status,
                  CASE WHEN o IS NULL THEN 'ValueError: no usable translation' ELSE '' END AS error_message
           FROM parsed p JOIN documents d USING (doc_id) WHERE trim(d.text) <> ''""",
        "parsed",
    ),
)
def _(spark, d):
    """Judged, resolved and filled block answers."""
    requests = s.whole_blocks(spark, d).withColumn("request_id", F.col("page").cast("long"))
    raw = s.bodies(spark, d).select(
        F.col("doc_id").alias("request_id"), "body", F.lit(1).alias("attempt"),
        F.lit(None).cast("string").alias("error_message"), F.lit(0.0).alias("elapsed_seconds"),
    )
    judged = a.block_judge(requests.join(raw, "request_id"))
    resolved = a.resolve_attempts(judged, 4, ["translation", "term_pairs"])
    filled = a.fill_failed_blocks(requests, resolved, 4)
    return filled.select(
        F.col("page").cast("long").alias("page"), "translation", "attempts", "status", "error_message"
    )


# --- scores ------------------------------------------------------------------------


def score_bodies(spark, d):
    """Ten labels per answer with a blank line; answers with a toxic row lose a line."""
    ranked = b.assign_batches(s.table(spark, d, "labels"), 10, "doc_id")
    rows = F.array_sort(F.collect_list(F.struct("pos", "quality", "toxic")))
    score = F.transform(
        "rows",
        lambda x: F.when((x["pos"] == 0) & F.exists("rows", lambda y: y["toxic"] == 1), "").otherwise(
            (x["quality"] * 10).cast("string")
        ),
    )
    return (
        ranked.groupBy("batch")
        .agg(rows.alias("rows"))
        .select(
            F.col("batch").alias("request_id"),
            F.size("rows").alias("expected_lines"),
            F.concat(F.array_join(score, " \n"), F.lit("\n\n")).alias("body"),
        )
    )


s.add_cte(
    "score_rows",
    (),
    """SELECT batch AS request_id, n, CASE WHEN toxic THEN NULL ELSE scores END AS scores FROM (
         SELECT rn // 10 AS batch, count(*)::INT AS n, bool_or(toxic = 1) AS toxic,
                string_agg((quality * 10)::VARCHAR, '|' ORDER BY rn) AS scores
         FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM labels) GROUP BY 1)""",
)


@register("parse_scores", sql("SELECT request_id, scores FROM score_rows", "score_rows"))
def _(spark, d):
    scores = r.parse_scores("body", "expected_lines")
    return score_bodies(spark, d).select("request_id", F.array_join(scores, "|").alias("scores"))


@register(
    "fill_failed_scores",
    sql(
        """SELECT request_id, coalesce(scores, array_to_string(list_transform(range(n), lambda i: '-1'), '|'))
                  AS scores FROM score_rows""",
        "score_rows",
    ),
)
def _(spark, d):
    requests = score_bodies(spark, d)
    scores = r.parse_scores("body", "expected_lines")
    resolved = requests.select("request_id", scores.alias("scores")).where(
        F.col("scores").isNotNull()
    )
    filled = a.fill_failed_scores(requests, resolved)
    return filled.select("request_id", F.array_join("scores", "|").alias("scores"))


_CALLS = """CASE WHEN event_type = 'error' THEN 429 ELSE 500 END AS status_code,
    CASE event_type WHEN 'error' THEN CASE WHEN value > 100 THEN 'soon' WHEN value > 1 THEN value::VARCHAR
         END END AS retry_after, user_id % 6 + 1 AS attempt"""


@register(
    "retry_delay",
    f"""SELECT event_id, CASE WHEN status_code = 429 THEN
              CASE WHEN try_cast(retry_after AS DOUBLE) IS NOT NULL
                   THEN greatest(retry_after::DOUBLE, 2.0) ELSE least(2.0 * 2 ** (attempt - 1), 15.0) END
              ELSE least(2.0 * attempt, 8.0) END::DOUBLE AS delay
        FROM (SELECT event_id, {_CALLS} FROM events)""",
)
def _(spark, d):
    limited = F.col("event_type") == "error"
    status = F.when(limited, 429).otherwise(500)
    header = F.when(
        limited,
        F.when(F.col("value") > 100, "soon").when(F.col("value") > 1, F.col("value").cast("string")),
    )
    attempt = F.col("user_id") % 6 + 1
    return s.table(spark, d, "events").select(
        "event_id", r.retry_delay(status, header, attempt).alias("delay")
    )


@register(
    "parameter_score",
    """SELECT p_partkey, CASE WHEN len(list_filter(
              regexp_extract_all(src, '[A-Za-z]*[0-9][A-Za-z0-9]*'), lambda x: NOT list_contains(
                regexp_extract_all(tgt, '[A-Za-z]*[0-9][A-Za-z0-9]*'), x))) > 0 THEN 0 ELSE -1 END AS score
       FROM (SELECT p_partkey, p_name || ' ' || p_brand || ' M' || p_partkey || '/' || p_size AS src,
                    'M' || (p_partkey // 2 * 2) || '/' || p_size || ' ' || p_brand AS tgt FROM part)""",
)
def _(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    src = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" M"), key.cast("string"), F.lit("/"), size)
    even = (F.floor(key / 2) * 2).cast("string")
    tgt = F.concat(F.lit("M"), even, F.lit("/"), size, F.lit(" "), "p_brand")
    return s.table(spark, d, "part").select(
        "p_partkey", F.coalesce(r.parameter_score(src, tgt), F.lit(-1)).alias("score")
    )
