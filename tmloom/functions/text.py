"""Text functions as Column expressions: no Python runs per row.

Whitespace and word characters follow Unicode, spelled out once below because
the JVM's ``\\s``/``\\w`` are ASCII-only unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv

# Unicode whitespace, once as the inside of a regex class, once as characters.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = "".join(
    chr(c)
    for lo, hi in (
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
        (0x3000, 0x3000),
    )
    for c in range(lo, hi + 1)
)
WORD = r"\p{L}\p{N}_"

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnOrName) -> Column:
    """Trim Unicode whitespace on both ends (Spark's trim knows spaces only)."""
    return F.btrim(as_col(c), F.lit(WS_CHARS))


def normalize_whitespace(c: ColumnOrName) -> Column:
    """Soft hyphens out, hyphenated line ends joined, blanks and blank lines squeezed.

    Patterns are written to match only where something changes: single blanks
    are left alone, and words are searched for broken ends only in texts that
    have a hyphen before a line feed.
    """
    c = F.replace(as_col(c), F.lit("\u00ad"), F.lit(""))
    broken = rf"-[{WS}]*\n"
    c = F.when(
        c.rlike(broken), F.regexp_replace(c, rf"([{WORD}]){broken}[{WS}]*([{WORD}])", "$1$2")
    ).otherwise(c)
    c = F.replace(c, F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, r"[ \t]{2,}|\t", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def is_heading(c: ColumnOrName, max_chars: int = fv.HEADING_MAX_CHARS) -> Column:
    """A short line that opens with Chapter/Appendix or with a number."""
    c = as_col(c)
    opening = c.rlike(rf"^(?:Chapter|Appendix|\p{{Nd}}+)(?:\z|[^{WORD}])")
    return (F.length(c) <= max_chars) & opening


def drop_noise_lines(lines: ColumnOrName, max_words: int = fv.NOISE_MAX_WORDS) -> Column:
    """Strip each line; drop bare page numbers and short 'number + words' headers."""
    stripped = F.transform(as_col(lines), strip)

    def keep(x: Column) -> Column:
        page_number = x.rlike(r"^\p{Nd}+\z")
        running_header = x.rlike(rf"^\p{{Nd}}+[{WS}]+[A-Za-z]") & (word_count(x) <= max_words)
        return ~(page_number | running_header)

    return F.filter(stripped, keep)


def merge_paragraphs(lines: ColumnOrName) -> Column:
    """Join consecutive lines into paragraphs, paragraphs with a blank line.

    Each line decides from itself and its predecessor whether it continues a
    paragraph, so no running state is needed.
    """
    tagged = F.transform(as_col(lines), lambda x: F.struct(x.alias("t"), is_heading(x).alias("h")))

    def piece(tags: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            before = F.get(tags, i - 1)
            continues = (~x["h"]) & (F.coalesce(before["t"], F.lit("")) != "") & (~before["h"])
            return (
                F.when(x["t"] == "", "")
                .when(continues, F.concat(F.lit(" "), x["t"]))
                .otherwise(F.concat(F.lit("\n\n"), x["t"]))
            )

        return F.substring(F.array_join(F.transform(tags, place), ""), 3, 2147483647)

    # Bind the tagged array once: a one-element transform works as a let.
    return F.get(F.transform(F.array(tagged), piece), F.lit(0))


def clean_page(c: ColumnOrName) -> Column:
    """Raw page text to paragraphs separated by blank lines."""
    return merge_paragraphs(drop_noise_lines(F.split(normalize_whitespace(c), "\n")))


def split_sentences(c: ColumnOrName) -> Column:
    """Split after . ? ! ; : where whitespace and an opening character follow."""
    compact = strip(F.replace(as_col(c), F.lit("\n"), F.lit(" ")))
    # opens with the blank, then looks back: most positions fail at once
    parts = F.split(compact, rf"[{WS}](?<=[.?!;:][{WS}])[{WS}]*(?=[A-Z0-9\"“‘(])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def fixed_slices(c: Column, size: int) -> Column:
    """Cut into consecutive slices of ``size`` characters."""
    last = F.floor((F.greatest(F.length(c), F.lit(1)) - 1) / size).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(c, i * size + 1, F.lit(size))
    )


def chunk_text(c: ColumnOrName, max_chars: int = fv.CHUNK_MAX_CHARS) -> Column:
    """Pack sentences greedily into chunks of at most ``max_chars`` characters."""
    c = as_col(c)
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def flush(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["open"]))
        )

    def step(acc: Column, s: Column) -> Column:
        joined = F.concat(acc["open"], F.lit(" "), s)
        return (
            F.when(
                F.length(s) > max_chars,
                F.struct(
                    F.concat(flush(acc), fixed_slices(s, max_chars)).alias("done"),
                    F.lit("").alias("open"),
                ),
            )
            .when(acc["open"] == "", F.struct(acc["done"].alias("done"), s.alias("open")))
            .when(
                F.length(acc["open"]) + 1 + F.length(s) > max_chars,
                F.struct(flush(acc).alias("done"), s.alias("open")),
            )
            .otherwise(F.struct(acc["done"].alias("done"), joined.alias("open")))
        )

    packed = F.aggregate(split_sentences(c), start, step, flush)
    trimmed = F.filter(F.transform(packed, strip), lambda x: x != "")
    return F.when(F.length(c) <= max_chars, F.array(c)).otherwise(trimmed)


def normalize_term(c: ColumnOrName) -> Column:
    """Collapse whitespace; one-character and symbol-only terms become empty."""
    c = strip(F.regexp_replace(as_col(c), rf"[{WS}]+", " "))
    return F.when((F.length(c) < 2) | ~c.rlike(r"[\p{L}\p{N}]"), "").otherwise(c)


def ascii_letter_count(c: ColumnOrName) -> Column:
    return F.regexp_count(as_col(c), F.lit("[A-Za-z]"))


def han_char_count(c: ColumnOrName) -> Column:
    return F.regexp_count(as_col(c), F.lit(r"[\x{4e00}-\x{9fff}]"))


def word_count(c: ColumnOrName) -> Column:
    c = strip(c)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, rf"[{WS}]+")))


def char_count(c: ColumnOrName) -> Column:
    return F.length(as_col(c))


def block_id(page: ColumnOrName, block_no: ColumnOrName) -> Column:
    return F.format_string("P%03d-B%03d", as_col(page), as_col(block_no))


def source_hash(c: ColumnOrName) -> Column:
    return F.sha1(as_col(c))


def doc_key(stem: ColumnOrName, path: ColumnOrName) -> Column:
    """Key that scopes a translation memory to one document."""
    return F.concat_ws("_", as_col(stem), F.substring(F.sha1(as_col(path)), 1, 10))


def tokens(c: ColumnOrName) -> Column:
    """Latin/digit runs of two or more characters and overlapping Han pairs, in order."""
    pattern = r"(?=([\x{4e00}-\x{9fff}]{2}|(?<![A-Za-z0-9])[A-Za-z0-9]{2,}))"
    return F.regexp_extract_all(as_col(c), F.lit(pattern), F.lit(1))


def round2(c: ColumnOrName) -> Column:
    """Round to two places by the double's exact binary value, ties to even.

    Spark's own round works on the shortest decimal text of the double, so it
    turns 2.675 (stored slightly below) into 2.68.  Here the distance to the
    midpoint is taken exactly by splitting the factor into two short halves.
    """
    x = as_col(c).cast("double")
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    low = x - high
    below = F.floor(x * 100.0).cast("double")
    middle = below * 2.0 + 1.0
    over = (high * 200.0 - middle) + low * 200.0
    up = (over > 0) | ((over == 0) & (F.pmod(below, F.lit(2.0)) == 1.0))
    return F.when(up, below + 1.0).otherwise(below) / 100.0


def is_yes(c: ColumnOrName) -> Column:
    return F.contains(F.upper(as_col(c)), F.lit("YES"))
