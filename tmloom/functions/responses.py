"""Reading model output: alignment, JSON bodies, scores, retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.functions.text import WS, ColumnOrName, as_col, is_yes, strip

_PAIRS = "array<struct<source:string,target:string>>"


def output_lines(body: ColumnOrName) -> Column:
    """The response split on line feeds; single lines keep their blanks."""
    return F.split(strip(body), "\n")


def tail_lines(lines: Column, n: Column) -> Column:
    """The last ``n`` lines, or null when there are fewer."""
    return F.when(F.size(lines) >= n, F.slice(lines, F.size(lines) - n + 1, n))


def align_or_repair(body: ColumnOrName, n: ColumnOrName, verdict: ColumnOrName) -> Column:
    """Lines to accept for a batch of ``n``, or null when the attempt is rejected.

    Equal counts pass.  Longer output passes with its last ``n`` lines when the
    verification answer says yes.  Shorter output is rejected.
    """
    lines, n = output_lines(body), as_col(n)
    return F.when(F.size(lines) == n, lines).when(
        (F.size(lines) > n) & is_yes(verdict), tail_lines(lines, n)
    )


def needs_verification(body: ColumnOrName, n: ColumnOrName) -> Column:
    return F.size(output_lines(body)) > as_col(n)


def json_object_text(body: ColumnOrName) -> Column:
    """Unwrap a code fence, then cut from the first ``{`` to the last ``}``."""
    text = strip(body)
    fence = rf"(?s)^```(?:json)?[{WS}]*(.*?)[{WS}]*```\z"
    inner = F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    return F.regexp_extract(inner, r"(?s)\{.*\}", 0)


def parse_json_body(body: ColumnOrName) -> Column:
    """The response object as a variant; null when it cannot be read."""
    return F.try_parse_json(json_object_text(body))


def parse_translation(payload: Column) -> Column:
    """Stripped translation text, or null when absent or blank (rejected)."""
    text = strip(F.try_variant_get(payload, "$.translation", "string"))
    return F.when(text != "", text)


def parse_terms(payload: Column) -> Column:
    """Term pairs; entries that are no objects or have a blank side are skipped."""
    raw = F.try_variant_get(payload, "$.terms", "array<variant>")
    pairs = F.transform(
        raw,
        lambda v: F.struct(
            strip(F.try_variant_get(v, "$.source", "string")).alias("source"),
            strip(F.try_variant_get(v, "$.target", "string")).alias("target"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: (F.coalesce(p["source"], F.lit("")) != "")
        & (F.coalesce(p["target"], F.lit("")) != ""),
    )
    return F.coalesce(kept, F.array().cast(_PAIRS))


def parse_scores(body: ColumnOrName, n: ColumnOrName) -> Column:
    """Non-blank lines as scores when there are exactly ``n``, else null."""
    lines = F.filter(F.transform(F.split(as_col(body), "\n"), strip), lambda x: x != "")
    return F.when(F.size(lines) == as_col(n), lines)


def retry_delay(
    status_code: ColumnOrName,
    retry_after: ColumnOrName,
    attempt: ColumnOrName,
    base: float = fv.RETRY_BASE_DELAY,
    rate_limit_cap: float = fv.RATE_LIMIT_DELAY_CAP,
    error_cap: float = fv.ERROR_DELAY_CAP,
) -> Column:
    """Seconds to wait before the next try of a request."""
    header, attempt = as_col(retry_after), as_col(attempt)
    number = rf"^[{WS}]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[{WS}]*\z"
    asked = F.when(header.rlike(number), strip(header).try_cast("double"))
    limited = F.when(asked.isNotNull(), F.greatest(asked, F.lit(float(base)))).otherwise(
        F.least(F.pow(F.lit(2.0), attempt - 1) * base, F.lit(float(rate_limit_cap)))
    )
    return F.when(as_col(status_code) == 429, limited).otherwise(
        F.least(attempt * F.lit(float(base)), F.lit(float(error_cap)))
    )


def parameters(c: ColumnOrName) -> Column:
    """Model numbers, sizes and figures: ASCII runs holding a digit."""
    return F.regexp_extract_all(
        as_col(c), F.lit(r"[A-Za-z]*[0-9][A-Za-z0-9]*"), F.lit(0)
    )


def parameter_score(source: ColumnOrName, target: ColumnOrName) -> Column:
    """0 when a parameter of the source is missing in the target, else null."""
    missing = F.array_except(parameters(source), parameters(target))
    return F.when(F.size(missing) > 0, F.lit(0))
