"""Stand-in tables for lines, logs, pages, results and memories.

Each is a whole-table derivation of the given tables, once as a DataFrame and
once as a DuckDB common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.functions import text as t

MARK = fv.FAILURE_MARK
LATER = 1 << 40

# Python whitespace for RE2, as the inside of a class and as characters.
RE_WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CHARS = " || ".join(f"chr({ord(c)})" for c in t.WS_CHARS)


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


_TEXT_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the rows of text tables, costly ones in few splits, are dealt by key."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(*_TEXT_KEYS[name]) if name in _TEXT_KEYS else df


def in_place(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given text table, its rows left where they are if they make a split for each core; else dealt by key."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # only the footers are read
    splits = df.select(F.spark_partition_id().alias("split")).distinct().count()
    return df if splits >= spark.sparkContext.defaultParallelism else table(spark, sf_dir, name)


# --- lines and progress ------------------------------------------------------


def lines(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), F.concat_ws(" ", "p_name", "p_brand").alias("src")
    )
    supplier = table(spark, d, "supplier").select(
        (F.col("s_suppkey") + LATER).alias("row_id"), F.col("s_name").alias("src")
    )
    return part.unionByName(supplier)


def _first_pass(spark: SparkSession, d: str) -> DataFrame:
    src = F.concat_ws(" ", "p_name", "p_brand")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"),
        src.alias("src"),
        F.when(F.col("p_size") % 7 == 0, MARK)
        .when(F.col("p_size") % 11 == 0, "")
        .otherwise(F.upper(src))
        .alias("tgt"),
        "p_type",
    )


def progress(spark: SparkSession, d: str) -> DataFrame:
    """A first pass with failures, then a rerun that repaired most of them."""
    first = _first_pass(spark, d)
    rerun = first.where((F.col("tgt") == MARK) & (F.col("p_type") != "ECONOMY")).select(
        (F.col("seq") + LATER).alias("seq"), "src", F.upper("src").alias("tgt")
    )
    return first.drop("p_type").unionByName(rerun)


# --- pages ---------------------------------------------------------------------


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as pages, some without primary or fallback text."""
    text = F.col("text")
    return table(spark, d, "conversations").select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("doc_key"),
        (F.col("turn") + 1).cast("int").alias("page"),
        F.when(F.col("turn") % 5 == 0, "").otherwise(text).alias("primary_text"),
        F.when(F.col("conv_id") % 11 == 0, "").otherwise(text).alias("fallback_text"),
    )


def long_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of volumes of fifty."""
    return table(spark, d, "documents").select(
        F.concat(F.lit("vol"), F.floor(F.col("doc_id") / 50).cast("string")).alias("doc_key"),
        (F.col("doc_id") % 50 + 1).cast("int").alias("page"),
        F.col("text").alias("primary_text"),
        F.lit("").alias("fallback_text"),
    )


# --- results, terms, memory ------------------------------------------------------


def long_words(c: Column) -> Column:
    """Distinct Latin words of the whole text, longest first."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    sized = F.array_sort(
        F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    )
    return F.transform(sized, lambda s: s["w"])


def _pair(source: Column, target: Column) -> Column:
    return F.struct(source.alias("source"), target.alias("target"))


def term_pairs(words: Column, lang: Column) -> Column:
    """A pair for every word, a repeat, a whitespace variant and a symbol-only term."""
    w = [F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i in range(3)]
    base = F.concat(
        F.transform(words, lambda x: _pair(x, F.upper(x))),
        F.array(
            _pair(F.concat(w[1], F.lit("  "), w[2]), F.upper(w[1])), _pair(F.lit("--"), F.lit("x"))
        ),
    )
    return F.when(lang == "fr", F.concat(base, F.array(_pair(w[0], F.upper(w[0]))))).otherwise(base)


def results(spark: SparkSession, d: str, by_lang: bool = False, labelled: bool = False) -> DataFrame:
    """Documents as translated blocks; labels decide which of them failed.

    Words are cut after the join, so that a join that sorts does not sort them too,
    and of documents that no label names not at all if only ``labelled`` ones are asked for.
    """
    docs, labels = in_place(spark, d, "documents"), table(spark, d, "labels")
    if labelled:
        page = F.col("doc_id").cast("int")
        docs = docs.withColumn("_page", page).join(labels.select(page.alias("_page")), "_page", "left_semi").drop("_page")
    joined = docs.join(labels, "doc_id", "left").withColumn("words", long_words(F.col("text")))
    ok = F.coalesce(F.col("quality") != 0, F.lit(True))
    doc = F.col("doc_id")
    page = (doc if by_lang else doc % 50 + 1).cast("int")
    volume = F.concat(F.lit("vol"), F.floor(doc / 50).cast("string"))
    han = F.repeat(F.lit("译"), F.col("n_chars").cast("int"))
    return joined.select(
        (F.col("lang") if by_lang else volume).alias("doc_key"),
        page.alias("page"),
        F.lit(1).alias("block_no"),
        t.block_id(page, F.lit(1)).alias("block_id"),
        F.col("text").alias("source_text"),
        F.when(~ok, "").when(F.col("lang") == "en", F.col("text")).otherwise(han).alias("translation"),
        term_pairs(F.col("words"), F.col("lang")).alias("term_pairs"),
        F.when(ok, 1 + doc % 3).otherwise(4).cast("int").alias("attempts"),
        (F.col("n_chars") * 0.00125).alias("elapsed_seconds"),
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(~ok & (F.col("toxic") == 0), "HTTPError: 500").otherwise("").alias("error_message"),
        (ok & (F.col("n_chars") < 400)).alias("cache_hit"),
    )


def memory(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as a log; toxic ones were translated again later."""
    logged = results(spark, d, by_lang=True, labelled=True).join(
        table(spark, d, "labels").select(F.col("doc_id").cast("int").alias("page"), "toxic"), "page"
    )
    fields = [
        "page", "block_id", "source_text", "translation", "term_pairs", "attempts",
        "elapsed_seconds", "status", "error_message", "cache_hit",
    ]
    entry = logged.select(
        F.col("page").cast("long").alias("seq"),
        "doc_key",
        t.source_hash("source_text").alias("source_hash"),
        F.struct(*fields).alias("result"),
        "toxic",
    )
    runs = F.when(F.col("toxic") == 1, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False))
    )
    translation = F.col("result.translation")
    return entry.withColumn("again", F.explode(runs)).select(
        F.when(F.col("again"), F.col("seq") + LATER).otherwise(F.col("seq")).alias("seq"),
        "doc_key",
        "source_hash",
        F.col("result")
        .withField(
            "translation",
            F.when(F.col("again"), F.concat(F.lit("again "), translation)).otherwise(translation),
        )
        .alias("result"),
    )


def whole_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each document as one block, keyed by language."""
    page = F.col("doc_id").cast("int")
    return table(spark, d, "documents").select(
        F.col("lang").alias("doc_key"),
        page.alias("page"),
        F.lit(1).alias("block_no"),
        t.block_id(page, F.lit(1)).alias("block_id"),
        F.col("text").alias("source_text"),
    )


# --- attempts and responses --------------------------------------------------------


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as attempts: the returned ones were rejected."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("attempt"))
        .agg(
            (F.max("l_returnflag") != "R").alias("accepted"),
            F.concat(F.lit("body "), F.sum("l_partkey").cast("string")).alias("body"),
            F.concat(F.lit("rejected "), F.max("l_suppkey").cast("string")).alias("error_message"),
            F.sum("l_quantity").alias("elapsed_seconds"),
        )
    )


def json_text(c: Column) -> Column:
    """Escape a text for a JSON string by plain replacements."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def json_terms(words: Column, space: str = "") -> Column:
    """Terms of a JSON list, each followed by a comma: every word and its upper case."""
    term = lambda w: F.concat(
        F.lit(f'{{"source":"{space}'), w, F.lit(f'{space}","target":"'), F.upper(w), F.lit('"},')
    )
    return F.array_join(F.transform(words, term), "")


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """Model answers: plain, fenced, wrapped in prose or cut off, by language."""
    text = F.col("escaped")
    inner = F.concat(
        F.lit('{"translation":" '), text, F.lit(' ","terms":['), json_terms(F.col("words"), " "),
        F.lit('7,{"source":"","target":"x"},{"source":"y"}]}'),
    )
    lang = F.col("lang")
    prepared = table(spark, d, "documents").select(
        "doc_id",
        "lang",
        json_text(F.col("text")).alias("escaped"),
        long_words(F.col("text")).alias("words"),
    )
    return prepared.select(
        "doc_id",
        F.when(lang == "en", inner)
        .when(lang == "fr", F.concat(F.lit("```json\n"), inner, F.lit("\n```\n")))
        .when(lang == "de", F.concat(F.lit("Antwort: "), inner, F.lit(" Ende")))
        .otherwise(F.concat(F.lit('{"translation": "'), text))
        .alias("body"),
    )


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (
        (),
        f"""SELECT p_partkey AS row_id, p_name || ' ' || p_brand AS src FROM part
            UNION ALL SELECT s_suppkey + {LATER}, s_name FROM supplier""",
    ),
    "first_pass": (
        (),
        f"""SELECT p_partkey AS seq, p_name || ' ' || p_brand AS src,
                   CASE WHEN p_size % 7 = 0 THEN '{MARK}' WHEN p_size % 11 = 0 THEN ''
                        ELSE upper(p_name || ' ' || p_brand) END AS tgt, p_type
            FROM part""",
    ),
    "progress": (
        ("first_pass",),
        f"""SELECT seq, src, tgt FROM first_pass
            UNION ALL SELECT seq + {LATER}, src, upper(src) FROM first_pass
            WHERE tgt = '{MARK}' AND p_type <> 'ECONOMY'""",
    ),
    "latest": (("progress",), "SELECT src, arg_max(tgt, seq) AS tgt FROM progress GROUP BY src"),
    "pending": (
        ("lines", "latest"),
        f"""SELECT row_id, src FROM lines WHERE src NOT IN
            (SELECT src FROM latest WHERE tgt <> '{MARK}')""",
    ),
    "history": (
        ("progress",),
        f"SELECT seq, src, tgt FROM progress WHERE tgt <> '{MARK}' AND {strip_sql('tgt')} <> ''",
    ),
    "batched": (
        ("lines",),
        """SELECT row_id, src, rn // 25 AS batch, (rn % 25)::INT AS pos
           FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS rn FROM lines)""",
    ),
    "page_texts": (
        (),
        """SELECT 'conv' || conv_id AS doc_key, (turn + 1)::INT AS page,
                  CASE WHEN turn % 5 = 0 THEN '' ELSE text END AS primary_text,
                  CASE WHEN conv_id % 11 = 0 THEN '' ELSE text END AS fallback_text
           FROM conversations""",
    ),
    "long_page_texts": (
        (),
        """SELECT 'vol' || (doc_id // 50) AS doc_key, (doc_id % 50 + 1)::INT AS page,
                  text AS primary_text, '' AS fallback_text FROM documents""",
    ),
    "doc_words": (
        (),
        """SELECT doc_id, list_transform(list_sort(list_transform(
                      list_distinct(regexp_extract_all(lower(text), '[a-z]+')),
                      lambda w: {'n': -length(w), 'w': w})), lambda s: s.w) AS words
           FROM documents""",
    ),
    "base_results": (
        ("doc_words",),
        """SELECT d.doc_id, d.lang, d.n_chars, d.text AS source_text, l.toxic,
                  coalesce(l.quality <> 0, true) AS good,
                  CASE WHEN NOT coalesce(l.quality <> 0, true) THEN ''
                       WHEN d.lang = 'en' THEN d.text ELSE repeat('译', n_chars) END AS translation,
                  list_concat(list_concat(
                    list_transform(w.words, lambda x: {'source': x, 'target': upper(x)}), [
                      {'source': coalesce(w.words[2], '') || '  ' || coalesce(w.words[3], ''),
                       'target': upper(coalesce(w.words[2], ''))},
                      {'source': '--', 'target': 'x'}]),
                    CASE WHEN d.lang = 'fr' THEN
                      [{'source': coalesce(w.words[1], ''), 'target': upper(coalesce(w.words[1], ''))}]
                    ELSE [] END) AS term_pairs,
                  d.n_chars * 0.00125::DOUBLE AS elapsed_seconds
           FROM documents d JOIN doc_words w USING (doc_id) LEFT JOIN labels l USING (doc_id)""",
    ),
    "results": (
        ("base_results",),
        """SELECT 'vol' || (doc_id // 50) AS doc_key, (doc_id % 50 + 1)::INT AS page, 1 AS block_no,
                  printf('P%03d-B%03d', (doc_id % 50 + 1)::INT, 1) AS block_id, source_text,
                  translation, term_pairs,
                  (CASE WHEN good THEN 1 + doc_id % 3 ELSE 4 END)::INT AS attempts, elapsed_seconds,
                  CASE WHEN good THEN 'ok' ELSE 'failed' END AS status,
                  CASE WHEN NOT good AND toxic = 0 THEN 'HTTPError: 500' ELSE '' END AS error_message,
                  good AND n_chars < 400 AS cache_hit
           FROM base_results""",
    ),
    "lang_results": (
        ("base_results",),
        """SELECT lang AS doc_key, doc_id::INT AS page, 1 AS block_no,
                  printf('P%03d-B%03d', doc_id::INT, 1) AS block_id, source_text, translation,
                  term_pairs, (CASE WHEN good THEN 1 + doc_id % 3 ELSE 4 END)::INT AS attempts,
                  elapsed_seconds, CASE WHEN good THEN 'ok' ELSE 'failed' END AS status,
                  CASE WHEN NOT good AND toxic = 0 THEN 'HTTPError: 500' ELSE '' END AS error_message,
                  good AND n_chars < 400 AS cache_hit, toxic
           FROM base_results""",
    ),
    "memory": (
        ("lang_results",),
        f"""SELECT r.page::BIGINT + k.shift AS seq, r.doc_key, sha1(r.source_text) AS source_hash,
                   r.page, r.block_id, r.source_text, k.word || r.translation AS translation,
                   r.term_pairs, r.attempts, r.elapsed_seconds, r.status, r.error_message, r.cache_hit
            FROM lang_results r JOIN labels l ON l.doc_id = r.page
            JOIN (VALUES (0, 0, ''), (1, {LATER}, 'again ')) k(again, shift, word)
              ON k.again = 0 OR l.toxic = 1""",
    ),
    "latest_memory": (
        ("memory",),
        """SELECT * EXCLUDE (rn) FROM (SELECT *, min(seq) OVER (PARTITION BY doc_key, source_hash)
               AS first_seq, row_number() OVER (PARTITION BY doc_key, source_hash ORDER BY seq DESC)
               AS rn FROM memory) WHERE rn = 1""",
    ),
    "terms": (
        ("latest_memory",),
        """SELECT doc_key, source, target, count(*) AS frequency,
                  min(first_seq * 1000000 + pos) AS first_seen
           FROM (SELECT doc_key, first_seq, unnest(term_pairs).source AS source,
                        unnest(term_pairs).target AS target,
                        unnest(range(len(term_pairs))) AS pos FROM latest_memory)
           GROUP BY doc_key, source, target""",
    ),
    "attempts": (
        (),
        """SELECT l_orderkey AS request_id, l_linenumber AS attempt,
                  max(l_returnflag) <> 'R' AS accepted, 'body ' || sum(l_partkey) AS body,
                  'rejected ' || max(l_suppkey) AS error_message, sum(l_quantity) AS elapsed_seconds
           FROM lineitem GROUP BY ALL""",
    ),
    "bodies": (
        ("doc_words",),
        r"""SELECT doc_id, CASE lang WHEN 'en' THEN body
                     WHEN 'fr' THEN '```json' || chr(10) || body || chr(10) || '```' || chr(10)
                     WHEN 'de' THEN 'Antwort: ' || body || ' Ende'
                     ELSE '{"translation": "' || esc END AS body
            FROM (SELECT *, '{"translation":" ' || esc || ' ","terms":[' || list
                         || '7,{"source":"","target":"x"},{"source":"y"}]}' AS body
                  FROM (SELECT doc_id, lang, coalesce(array_to_string(list_transform(words,
                                 lambda w: '{"source":" ' || w || ' ","target":"' || upper(w) || '"},'), ''),
                               '') AS list,
                               replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'),
                                 chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS esc
                        FROM documents JOIN doc_words USING (doc_id)))""",
    ),
}


_RECURSIVE: set[str] = set()
_STORED: set[str] = set()


def add_cte(name: str, needs: tuple[str, ...], body: str, recursive: bool = False, stored: bool = False) -> None:
    """``stored``: worked out once, though steps of a recursion read it."""
    _CTES[name] = (needs, body)
    if recursive:
        _RECURSIVE.add(name)
    if stored:
        _STORED.add(name)


def add_ratios(name: str, needs: tuple[str, ...], pairs: str) -> None:
    """``name`` (a, b, sim): the matching-block ratio of the distinct ``pairs`` (a, b) of texts below 200 characters.

    The longest common block of two ranges, of equal ones the first in a and
    then in b, splits them into ranges to its left and right, and so on; twice
    the letters in blocks, by all letters, is the ratio.
    """
    add_cte(
        f"{name}_asked", needs, f"SELECT a, b, row_number() OVER () AS p FROM (SELECT DISTINCT a, b FROM ({pairs}))",
        stored=True,
    )
    add_cte(
        f"{name}_cells",
        (f"{name}_asked",),
        f"""SELECT p, i, j, max(i) OVER (PARTITION BY p, i - j, g) - i + 1 AS n FROM (
              SELECT p, i, j, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS g
              FROM (SELECT p, unnest(string_split(a, '')) AS c, unnest(range(1, length(a) + 1)) AS i FROM {name}_asked)
              JOIN (SELECT p, unnest(string_split(b, '')) AS c, unnest(range(1, length(b) + 1)) AS j FROM {name}_asked)
              USING (p, c))""",
        stored=True,
    )
    add_cte(
        f"{name}_blocks",
        (f"{name}_cells",),
        f"""SELECT p, 1::BIGINT AS alo, length(a) + 1 AS ahi, 1::BIGINT AS blo, length(b) + 1 AS bhi, 0::BIGINT AS n
            FROM {name}_asked
            UNION ALL
            SELECT p, x.alo, x.ahi, x.blo, x.bhi, x.n FROM (
              SELECT p, unnest([
                {{'alo': alo, 'ahi': m.i, 'blo': blo, 'bhi': m.j, 'n': 0::BIGINT}},
                {{'alo': m.i - m.n, 'ahi': ahi, 'blo': m.j - m.n, 'bhi': bhi, 'n': 0::BIGINT}},
                {{'alo': 0::BIGINT, 'ahi': 0::BIGINT, 'blo': 0::BIGINT, 'bhi': 0::BIGINT, 'n': -m.n}}]) AS x
              FROM (SELECT p, alo, ahi, blo, bhi, min({{'n': -least(c.n, ahi - i, bhi - j), 'i': i, 'j': j}}) AS m
                    FROM {name}_blocks r JOIN {name}_cells c USING (p)
                    WHERE r.n = 0 AND i >= alo AND i < ahi AND j >= blo AND j < bhi
                    GROUP BY p, alo, ahi, blo, bhi))
            WHERE x.n > 0 OR (x.alo < x.ahi AND x.blo < x.bhi)""",
        recursive=True,
    )
    add_cte(
        name,
        (f"{name}_blocks",),
        f"""SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE
                   ELSE 2.0::DOUBLE * m / (length(a) + length(b)) END AS sim
            FROM {name}_asked JOIN (SELECT p, sum(n)::BIGINT AS m FROM {name}_blocks GROUP BY p) USING (p)""",
    )


def sql(body: str, *needs: str) -> str:
    """``body`` behind the common table expressions it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    first = "WITH RECURSIVE " if _RECURSIVE.intersection(ordered) else "WITH "
    told = lambda n: "AS MATERIALIZED" if n in _STORED else "AS"
    return first + ",\n".join(f"{n} {told(n)} ({_CTES[n][1]})" for n in ordered) + "\n" + body
