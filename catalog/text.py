"""Text functions on whole documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog import register
from catalog.standins import RE_WS, add_ratios, sql, strip_sql, table
from tmloom.functions import segmenter as seg
from tmloom.functions import similarity as sim
from tmloom.functions import text as t

WORD = r"\pL\pN_"


def raw_page(c: Column) -> Column:
    """Put page noise, hyphenated breaks and headings into a text."""
    for old, new in (
        (", ", "-\n"), (". ", ".\n7\n"), (" the ", "\n4 the\t\n"), (" and ", "\r\n2.1 and "),
        (" la ", "\n\n\n\nla "), ("tion", "t­ion"),
    ):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


RAW_SQL = (
    "replace(replace(replace(replace(replace(replace(text, ', ', '-' || chr(10)), "
    "'. ', '.' || chr(10) || '7' || chr(10)), ' the ', chr(10) || '4 the' || chr(9) || chr(10)), "
    "' and ', chr(13) || chr(10) || '2.1 and '), ' la ', repeat(chr(10), 4) || 'la '), "
    "'tion', 't' || chr(173) || 'ion')"
)


def norm_sql(x: str) -> str:
    joined = (
        f"regexp_replace(replace({x}, chr(173), ''), "
        rf"'([{WORD}])-[{RE_WS}]*\n[{RE_WS}]*([{WORD}])', '\1\2', 'g')"
    )
    return strip_sql(
        f"regexp_replace(regexp_replace(replace({joined}, chr(13), chr(10)), '[ \\t]+', ' ', 'g'), "
        "'\\n{3,}', chr(10) || chr(10), 'g')"
    )


def words_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{RE_WS}]+'))"


def heading_sql(x: str) -> str:
    return (
        f"(length({x}) <= 120 AND (regexp_matches({x}, '^(Chapter|Appendix)($|[^{WORD}])') "
        rf"OR regexp_matches({x}, '^\p{{Nd}}+(\.\p{{Nd}}+)*($|[^{WORD}])')))"
    )


def denoise_sql(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip_sql('l')}), "
        rf"lambda l: NOT (regexp_full_match(l, '\p{{Nd}}+') OR "
        rf"(regexp_matches(l, '^\p{{Nd}}+[{RE_WS}]+[A-Za-z]') AND {words_sql('l')} <= 8)))"
    )


def merge_sql(lines: str) -> str:
    """Another route to the same paragraphs: mark breaks, join, split at the marks."""
    marked = (
        f"list_transform({lines}, lambda l: CASE WHEN l = '' THEN chr(1) "
        f"WHEN {heading_sql('l')} THEN chr(1) || l || chr(1) ELSE l END)"
    )
    return (
        f"array_to_string(list_filter(regexp_split_to_array(array_to_string({marked}, ' '), "
        r"' *\x01 *'), lambda p: p <> ''), chr(10) || chr(10))"
    )


def clean_sql(x: str) -> str:
    return merge_sql(denoise_sql(norm_sql(x)))


def sentences_sql(x: str) -> str:
    compact = strip_sql(f"replace({x}, chr(10), ' ')")
    cut = (
        rf"regexp_replace({compact}, '([.?!;:])[{RE_WS}]+([A-Z0-9" + '"“‘(])' + r"', '\1'"
        rf" || chr(1) || '\2', 'g')"
    )
    # a one-character sentence lets two cuts share a character, so cut twice
    again = cut.replace(compact, cut, 1)
    return (
        f"list_filter(list_transform(string_split({again}, chr(1)), "
        f"lambda s: {strip_sql('s')}), lambda s: s <> '')"
    )


def reduce_sql(x: str, size: int) -> str:
    """The packing fold; ``flush_sql`` turns its state into chunks."""
    empty = "[]::VARCHAR[]"
    flushed = "CASE WHEN a.u = '' THEN a.c ELSE list_append(a.c, a.u) END"
    slices = f"list_transform(range(0, length(e.u), {size}), lambda i: substring(e.u, i + 1, {size}))"
    return (
        f"list_reduce(list_prepend({{'c': {empty}, 'u': ''}}, list_transform({sentences_sql(x)}, "
        f"lambda s: {{'c': {empty}, 'u': s}})), lambda a, e: "
        f"CASE WHEN length(e.u) > {size} THEN {{'c': list_concat({flushed}, {slices}), 'u': ''}} "
        f"WHEN a.u = '' THEN {{'c': a.c, 'u': e.u}} "
        f"WHEN length(a.u) + 1 + length(e.u) > {size} "
        "THEN {'c': list_append(a.c, a.u), 'u': e.u} "
        "ELSE {'c': a.c, 'u': a.u || ' ' || e.u} END)"
    )


def flush_sql(state: str, x: str, size: int) -> str:
    return (
        f"CASE WHEN length({x}) <= {size} THEN [{x}] ELSE list_filter(list_transform("
        f"CASE WHEN {state}.u = '' THEN {state}.c ELSE list_append({state}.c, {state}.u) END, "
        f"lambda s: {strip_sql('s')}), lambda s: s <> '') END"
    )


def _docs(spark, d):
    return table(spark, d, "documents")


@register("normalize_whitespace", f"SELECT doc_id, {norm_sql(RAW_SQL)} AS text FROM documents")
def _(spark, d):
    return _docs(spark, d).select(
        "doc_id", t.normalize_whitespace(raw_page(F.col("text"))).alias("text")
    )


LINE = (
    "CASE pos % 4 WHEN 0 THEN pos || '.1 ' || line WHEN 1 THEN 'Chapter ' || line "
    "WHEN 2 THEN pos || line ELSE line END"
)


@register(
    "is_heading",
    f"""SELECT doc_id, pos, {heading_sql('x')} AS heading FROM (SELECT doc_id, pos, {LINE} AS x FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents))""",
)
def _(spark, d):
    rows = _docs(spark, d).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    pos = F.col("pos").cast("string")
    kind = F.col("pos") % 4
    line = (
        F.when(kind == 0, F.concat(pos, F.lit(".1 "), "line"))
        .when(kind == 1, F.concat(F.lit("Chapter "), "line"))
        .when(kind == 2, F.concat(pos, "line"))
        .otherwise(F.col("line"))
    )
    return rows.select("doc_id", "pos", t.is_heading(line).alias("heading"))


@register(
    "drop_noise_lines",
    f"SELECT doc_id, array_to_string({denoise_sql(RAW_SQL)}, '|') AS kept FROM documents",
)
def _(spark, d):
    lines = F.split(raw_page(F.col("text")), "\n")
    return _docs(spark, d).select(
        "doc_id", F.array_join(t.drop_noise_lines(lines), "|").alias("kept")
    )


@register(
    "merge_paragraphs",
    f"""SELECT doc_id, {merge_sql('lines')} AS text
        FROM (SELECT doc_id, {denoise_sql(RAW_SQL)} AS lines FROM documents)""",
)
def _(spark, d):
    lines = t.drop_noise_lines(F.split(raw_page(F.col("text")), "\n"))
    return _docs(spark, d).select("doc_id", t.merge_paragraphs(lines).alias("text"))


@register(
    "split_sentences",
    f"""SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s)))::INT AS pos
        FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)""",
)
def _(spark, d):
    return _docs(spark, d).select(
        "doc_id", F.posexplode(t.split_sentences("text")).alias("pos", "sentence")
    )


@register(
    "chunk_text",
    f"""SELECT doc_id, unnest(c) AS chunk, unnest(range(len(c)))::INT AS pos FROM (
        SELECT doc_id, {flush_sql('a', 'text', 1800)} AS c
        FROM (SELECT doc_id, text, {reduce_sql('text', 1800)} AS a FROM documents))""",
)
def _(spark, d):
    return _docs(spark, d).select(
        "doc_id", F.posexplode(t.chunk_text("text")).alias("pos", "chunk")
    )


@register(
    "normalize_term",
    rf"""SELECT doc_id, pos, CASE WHEN length(x) < 2 OR regexp_full_match(x, '[^\pL\pN]+') THEN ''
               ELSE x END AS term
        FROM (SELECT doc_id, pos, {strip_sql(f"regexp_replace(part, '[{RE_WS}]+', ' ', 'g')")} AS x
        FROM (SELECT doc_id, unnest(string_split(text, '.')) AS part,
                     unnest(range(len(string_split(text, '.'))))::INT AS pos FROM documents))""",
)
def _(spark, d):
    parts = _docs(spark, d).select(
        "doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "part")
    )
    return parts.select("doc_id", "pos", t.normalize_term("part").alias("term"))


MIXED_SQL = "translate(text, 'aeiou', '铜芯电力缆')"


def mixed(c: Column) -> Column:
    return F.translate(c, "aeiou", "铜芯电力缆")


@register(
    "ascii_letter_count",
    f"SELECT doc_id, len(regexp_extract_all({MIXED_SQL}, '[A-Za-z]'))::INT AS letters FROM documents",
)
def _(spark, d):
    return _docs(spark, d).select("doc_id", t.ascii_letter_count(mixed(F.col("text"))).alias("letters"))


@register(
    "han_char_count",
    rf"""SELECT doc_id, length(regexp_replace({MIXED_SQL}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g'))::INT
               AS han FROM documents""",
)
def _(spark, d):
    return _docs(spark, d).select("doc_id", t.han_char_count(mixed(F.col("text"))).alias("han"))


@register(
    "word_and_char_count",
    f"""SELECT doc_id, {words_sql('text')}::INT AS words, length(text)::INT AS chars FROM documents""",
)
def _(spark, d):
    return _docs(spark, d).select(
        "doc_id", t.word_count("text").alias("words"), t.char_count("text").alias("chars")
    )


@register(
    "block_id",
    "SELECT conv_id, turn, printf('P%03d-B%03d', conv_id, turn + 1) AS block_id FROM conversations",
)
def _(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", t.block_id("conv_id", F.col("turn") + 1).alias("block_id")
    )


@register("source_hash", "SELECT doc_id, sha1(text) AS source_hash FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", t.source_hash("text").alias("source_hash"))


@register(
    "doc_key",
    "SELECT page_id, 'page' || page_id || '_' || left(sha1(url), 10) AS doc_key FROM pages",
)
def _(spark, d):
    stem = F.concat(F.lit("page"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", t.doc_key(stem, "url").alias("doc_key"))


@register(
    "tokens",
    rf"""SELECT conv_id, turn, token, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1)::INT
               AS pos FROM (
          SELECT conv_id, turn, i, CASE
              WHEN regexp_full_match(x[i:i+1], '[\x{{4e00}}-\x{{9fff}}]{{2}}') THEN x[i:i+1]
              WHEN i = 1 OR NOT regexp_matches(x[i-1:i-1], '[A-Za-z0-9]')
                THEN regexp_extract(x[i:], '^[A-Za-z0-9]{{2,}}') ELSE '' END AS token
          FROM (SELECT conv_id, turn, {MIXED_SQL} AS x, unnest(range(1, length(text) + 1)) AS i
                FROM conversations)) WHERE token <> ''""",
)
def _(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.posexplode(t.tokens(mixed(F.col("text")))).alias("pos", "token")
    )


# Latin letters as Han characters, so that the given texts are running Han text.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HAN = "".join(chr(0x4E00 + 7 * k) for k in range(26))
# A dictionary of syllables and their costs.
_SYLLABLES = {
    "th": 2100, "er": 2200, "on": 2300, "an": 2400, "re": 2500, "he": 2600, "in": 2700, "ed": 2800, "nd": 2900,
    "ha": 3000, "at": 3100, "en": 3200, "es": 3300, "of": 3400, "or": 3500, "ti": 3600, "to": 3700, "ing": 2000,
    "tion": 1500, "the": 1800, "and": 1900, "ly": 3800, "st": 3900, "ion": 2900, "ght": 2000, "e": 4000, "t": 4100,
}


def running_han(c):
    return F.translate(F.lower(c), _LETTERS, _HAN)


_WORDS_SQL = rf"""
grams AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(flatten(list_transform(range(1, least(length(run), 4) + 1),
             lambda k: list_transform(range(1, length(run) - k + 2), lambda i: substr(run, i, k))))) AS word
    FROM (SELECT unnest(regexp_extract_all(translate(lower(text), '{_LETTERS}', '{_HAN}'), '[\x{{4e00}}-\x{{9fff}}]+')) AS run
          FROM documents))
  GROUP BY word),
total AS (SELECT sum(n)::HUGEINT AS total FROM grams WHERE length(word) = 1),
cuts AS (
  SELECT word, n, substr(word, 1, k) AS l, substr(word, k + 1) AS r
  FROM (SELECT word, n, unnest(range(1, length(word))) AS k FROM grams WHERE length(word) > 1 AND n >= 5)),
held AS (
  SELECT c.word, any_value(c.n) AS n FROM cuts c JOIN grams a ON a.word = l JOIN grams b ON b.word = r, total
  GROUP BY c.word HAVING bool_and(c.n::HUGEINT * total >= 20 * a.n::HUGEINT * b.n))"""


@register(
    "learned_words",
    f"""WITH {_WORDS_SQL}
    SELECT word, n, round(1000 * ln(total::DOUBLE / n))::INT AS cost
    FROM (SELECT word, n FROM grams WHERE length(word) = 1 UNION ALL SELECT * FROM held), total""",
)
def _(spark, d):
    """A dictionary from the given texts, written in Han characters."""
    texts = table(spark, d, "documents").select(running_han(F.col("text")).alias("text"))
    return seg.learn_words(texts)


@register(
    "dictionary_tokens",
    rf"""WITH RECURSIVE dictionary AS (
      SELECT translate(w, '{_LETTERS}', '{_HAN}') AS word, c AS cost
      FROM (VALUES {', '.join(f"('{w}', {c})" for w, c in _SYLLABLES.items())}) v(w, c)),
    runs AS (
      SELECT DISTINCT unnest(regexp_extract_all(translate(lower(text), '{_LETTERS}', '{_HAN}'), '[\x{{4e00}}-\x{{9fff}}]+')) AS run
      FROM conversations),
    -- best[k]: cost and words of the cheapest cut of the last k - 1 characters
    paths AS (
      SELECT run, length(run) AS i, [{{'c': 0, 'z': 0, 'w': []::VARCHAR[]}}] AS best FROM runs
      UNION ALL
      SELECT run, i - 1, list_append(best, list_min(list_filter(list_transform([1, 2, 3, 4], lambda z:
               CASE WHEN z > len(best) THEN NULL
                    WHEN costs[substr(run, i, z)] IS NOT NULL
                      THEN {{'c': best[len(best) + 1 - z].c + costs[substr(run, i, z)], 'z': -z,
                             'w': list_prepend(substr(run, i, z), best[len(best) + 1 - z].w)}}
                    WHEN z = 1 THEN {{'c': best[len(best)].c + unknown, 'z': -1,
                                      'w': list_prepend(substr(run, i, 1), best[len(best)].w)}} END),
             lambda x: x IS NOT NULL)))
      FROM paths, (SELECT map_from_entries(list((word, cost))) AS costs, max(cost) + 1000 AS unknown FROM dictionary)
      WHERE i > 0),
    cut AS (SELECT run, list_filter(best[len(best)].w, lambda w: length(w) > 1) AS words FROM paths WHERE i = 0),
    pieces AS (
      SELECT conv_id, turn, unnest(p) AS piece, unnest(range(len(p))) AS nth FROM (
        SELECT conv_id, turn, regexp_extract_all(translate(lower(text), '{_LETTERS}', '{_HAN}'),
                                                 '[\x{{4e00}}-\x{{9fff}}]+|[A-Za-z0-9]{{2,}}') AS p FROM conversations)),
    told AS (
      SELECT conv_id, turn, nth, unnest(words) AS token, unnest(range(len(words))) AS k FROM (
        SELECT conv_id, turn, nth, coalesce(words, [piece]) AS words FROM pieces LEFT JOIN cut ON run = piece))
    SELECT conv_id, turn, token, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY nth, k) - 1)::INT AS pos FROM told""",
)
def _(spark, d):
    costs = {w.translate(str.maketrans(_LETTERS, _HAN)): c for w, c in _SYLLABLES.items()}
    segment = seg.DictionarySegmenter(costs)
    turns = table(spark, d, "conversations").withColumn("words", segment(running_han(F.col("text"))))
    return turns.select("conv_id", "turn", F.posexplode("words").alias("pos", "token"))


add_ratios(
    "line_ratios",
    (),
    """SELECT p_name || ' ' || p_brand || ' ' || p_type AS a, p_type || ' ' || p_name || ' ' || p_brand AS b FROM part""",
)


@register(
    "similarity",
    sql(
        """SELECT p_partkey, sim, 1.0::DOUBLE AS bound FROM part JOIN line_ratios
           ON a = p_name || ' ' || p_brand || ' ' || p_type AND b = p_type || ' ' || p_name || ' ' || p_brand""",
        "line_ratios",
    ),
)
def _(spark, d):
    line = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    other = F.concat_ws(" ", "p_type", "p_name", "p_brand")
    return table(spark, d, "part").select(
        "p_partkey", sim.similarity(line, other).alias("sim"),
        sim.similarity_bound(line, other).alias("bound"),
    )


@register(
    "round2",
    """SELECT event_id, format('{:.2f}', value / 7)::DOUBLE AS seventh,
              format('{:.2f}', value + 0.005)::DOUBLE AS half FROM events""",
)
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        t.round2(F.col("value") / 7).alias("seventh"),
        t.round2(F.col("value") + 0.005).alias("half"),
    )


@register(
    "is_yes",
    "SELECT conv_id, turn, regexp_matches(text, '(?i)yes') AS yes FROM conversations",
)
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", t.is_yes("text").alias("yes"))
