"""Similar past translations for each batch: inverted index, verify, suppress.

Two modes.  ``snapshot`` sees the history as it was at the start of a run.
``causal`` gives batch *b* the history and the successful rows of the batches
before *b*, which is what a strictly sequential run sees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmloom.functions import fixed_values as fv
from tmloom.functions.similarity import letters_bound, similarity, similarity_bound
from tmloom.functions.text import tokens
from tmloom.operators.scale import materialize, release

Segmenter = Callable[[Column], Column]

_CHUNK_BATCHES = 256  # batches whose postings are counted by one window group
_LETTER_BINS = 128
_RANGE_BITS = 16  # batches among which a pair of texts is compared once


def postings(history: DataFrame, segment: Segmenter = tokens) -> DataFrame:
    """(token, seq, tok_pos, src, tgt): one row per token occurrence."""
    rows = history.select(
        F.posexplode_outer(segment(F.col("src"))).alias("tok_pos", "token"), "seq", "src", "tgt"
    )
    return rows.where(F.col("token").isNotNull()).select("token", "seq", "tok_pos", "src", "tgt")


def last_postings(posted: DataFrame, n: int = fv.POSTINGS_PER_TOKEN) -> DataFrame:
    """The last ``n`` occurrences of each token.

    The rank limit is applied before the shuffle too, so a token held by a
    large part of the history sends at most ``n`` rows per task.
    """
    latest = Window.partitionBy("token").orderBy(F.desc("seq"), F.desc("tok_pos"))
    return (
        posted.withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= n)
        .drop("_back")
    )


_BROADCAST_TOKENS = 500_000  # rows of tokens that may be sent to all tasks


@dataclass(frozen=True)
class PostingsIndex:
    """The last ``n`` postings of every token, in parts that are merged as they are asked for.

    A part holds the last postings of a stretch of the log, of a history or of
    the rows one wave added.  What a wave adds is a new part; only small parts
    are merged with each other, never the large first one.  Asking for tokens
    sends the tokens to the parts where they are few, so nothing of the history
    is shuffled.
    """

    parts: tuple[DataFrame, ...]
    n: int = fv.POSTINGS_PER_TOKEN
    segment: Segmenter = tokens
    fan: int = 8

    @classmethod
    def of(cls, history: DataFrame, n: int = fv.POSTINGS_PER_TOKEN, segment: Segmenter = tokens) -> PostingsIndex:
        return cls((materialize(last_postings(postings(history, segment), n), "postings"),), n, segment)

    def extended(self, rows: DataFrame) -> PostingsIndex:
        """With the postings of successful ``rows`` (seq, src, tgt), which come after all others.

        Parts that are merged are deleted, so an index is read no more once it was extended.
        """
        added = materialize(last_postings(postings(rows, self.segment), self.n), "postings")
        first, *later = [*self.parts, added]
        if len(later) >= self.fan:
            merged = materialize(last_postings(reduce(DataFrame.unionByName, later), self.n), "postings")
            release(*later)
            later = [merged]
        return replace(self, parts=(first, *later))

    def of_tokens(self, wanted: DataFrame) -> DataFrame:
        """The postings of the tokens in ``wanted``, at most ``n`` of each from each part."""
        asked = materialize(wanted.select("token").distinct(), "tokens")
        if asked.count() <= _BROADCAST_TOKENS:
            asked = F.broadcast(asked)
        return reduce(DataFrame.unionByName, (p.join(asked, "token", "left_semi") for p in self.parts))


def line_tokens(batched: DataFrame, segment: Segmenter = tokens) -> DataFrame:
    """(batch, line_pos, tok_pos, token, text), first occurrence of a token per line."""
    distinct = F.array_distinct(segment(F.col("src")))
    return batched.select(
        "batch",
        F.col("pos").alias("line_pos"),
        F.col("src").alias("text"),
        F.posexplode_outer(distinct).alias("tok_pos", "token"),
    ).where(F.col("token").isNotNull())


def _recent(rows: DataFrame, *keys: str) -> DataFrame:
    """Pack the (at most ``n``) postings of a key into one row."""
    return rows.groupBy(*keys).agg(
        F.collect_list(F.struct("ord", "src", "tgt")).alias("recent")
    )


def snapshot_postings(wanted: DataFrame, posted: DataFrame, n: int = fv.POSTINGS_PER_TOKEN) -> DataFrame:
    """(batch, token, ord, src, tgt): the last ``n`` postings of each wanted token."""
    packed = _recent(
        last_postings(posted, n).withColumn("ord", F.struct("seq", "tok_pos")), "token"
    )
    met = wanted.join(packed, "token")
    return met.select("batch", "token", F.inline("recent"))


def causal_postings(
    wanted: DataFrame,
    history: DataFrame,
    done: DataFrame,
    n: int = fv.POSTINGS_PER_TOKEN,
    segment: Segmenter = tokens,
) -> DataFrame:
    """(batch, token, ord, src, tgt): the last ``n`` postings before each batch.

    Postings of a token are numbered along the log and ``upto`` counts those
    before a batch, so "the last n before b" becomes an equi-join on blocks of
    ``n`` consecutive numbers.  Numbers are built from per-chunk counts and a
    rank inside the chunk: no task ever sees a whole token.  No batch sees more
    of the prior history than a token's last ``n`` postings, so only these
    enter, as chunk -1.
    """
    at = lambda batch, pos: F.struct(batch.alias("batch"), pos.alias("pos"))
    prior = last_postings(postings(history, segment), n)
    made = postings(done.select(at(F.col("batch"), F.col("pos").cast("long")).alias("seq"), "src", "tgt"), segment)
    posted = prior.withColumn("seq", at(F.lit(-1).cast("long"), F.col("seq"))).unionByName(made)
    marks = wanted.select(
        "token", at(F.col("batch"), F.lit(-1).cast("long")).alias("seq"), F.lit(-1).alias("tok_pos"), "batch"
    )
    events = (
        posted.withColumn("_posting", F.lit(1))
        .unionByName(marks.withColumn("_posting", F.lit(0)), allowMissingColumns=True)
        .withColumn("_chunk", F.floor(F.col("seq.batch") / _CHUNK_BATCHES))
    )
    before = Window.partitionBy("token").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = (
        events.groupBy("token", "_chunk")
        .agg(F.sum("_posting").alias("_n"))
        .select("token", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    running = Window.partitionBy("token", "_chunk").orderBy(
        "seq", "_posting", "tok_pos"
    ).rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        events.withColumn("_run", F.sum("_posting").over(running))
        .join(bases, ["token", "_chunk"])
        .withColumn("ord", F.col("_base") + F.col("_run"))
    )
    packed = _recent(
        numbered.where(F.col("_posting") == 1).withColumn(
            "_block", F.floor((F.col("ord") - 1) / n)
        ),
        "token",
        "_block",
    )
    asked = numbered.where((F.col("_posting") == 0) & (F.col("ord") > 0)).select(
        "token", "batch", F.col("ord").alias("upto")
    )
    low = F.greatest(F.col("upto") - n, F.lit(0))
    blocks = F.sequence(F.floor(low / n), F.floor((F.col("upto") - 1) / n))
    met = asked.withColumn("_block", F.explode(blocks)).join(packed, ["token", "_block"])
    return (
        met.select("batch", "token", "upto", F.inline("recent"))
        .where((F.col("ord") <= F.col("upto")) & (F.col("ord") > F.col("upto") - n))
        .drop("upto")
    )


def _tasks(df: DataFrame) -> int:
    """Tasks for rows that are small but costly, which Spark would otherwise put together by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def candidate_pairs(lines: DataFrame, recent: DataFrame) -> DataFrame:
    """(batch, text, hist_source, at, hist_target): the first meeting of each pair.

    ``at`` = (line, token, posting) position.  Rows of a batch are brought
    together once; the steps after it keep that placement.  The number of tasks
    is given, because small rows are costly ones here: each is compared in Python.
    """
    met = lines.join(
        recent.select("batch", "token", "ord", F.col("src").alias("hist_source"), F.col("tgt").alias("hist_target")),
        ["batch", "token"],
    )
    return (
        met.repartition(_tasks(lines), "batch")
        .groupBy("batch", "text", "hist_source")
        .agg(
            F.min_by(
                F.struct(F.struct("line_pos", "tok_pos", "ord").alias("at"), "hist_target"),
                F.struct("line_pos", "tok_pos", "ord"),
            ).alias("_m")
        )
        .select("batch", "text", "hist_source", "_m.at", "_m.hist_target")
    )


def text_pairs(lines: DataFrame, posted: DataFrame, n: int = fv.POSTINGS_PER_TOKEN) -> DataFrame:
    """(text, hist_source, place, hist_target): the first meeting of each distinct text with each past source.

    What a text meets in a snapshot is the same in every batch, so it is looked
    up once for a text.  ``place`` = (token, posting) position.
    """
    recent = last_postings(posted, n).select(
        "token", F.struct("seq", "tok_pos").alias("ord"), F.col("src").alias("hist_source"), F.col("tgt").alias("hist_target")
    )
    met = lines.select("text", "token", "tok_pos").distinct().join(recent, "token")
    place = F.struct("tok_pos", "ord")
    return (
        met.groupBy("text", "hist_source")
        .agg(F.min_by(F.struct(place.alias("place"), "hist_target"), place).alias("_m"))
        .select("text", "hist_source", "_m.place", "_m.hist_target")
    )


def similar_text_pairs(pairs: DataFrame, min_similarity: float = fv.MIN_SIMILARITY) -> DataFrame:
    """``text_pairs`` more similar than the threshold, with ``sim``: each is compared once, whatever its batches."""
    # the bound from letters asks for the row, so it is not copied below the grouping
    letters = F.when(F.col("place").isNotNull(), letters_bound("text", "hist_source"))
    spread = pairs.repartition(_tasks(pairs), "text", "hist_source")
    near = spread.where(similarity_bound("text", "hist_source") > min_similarity).where(letters > min_similarity)
    return near.withColumn("sim", similarity("text", "hist_source")).where(F.col("sim") > min_similarity)


def in_batches(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs of texts as pairs of the batches that hold the texts; ``at`` as in ``candidate_pairs``."""
    # a row for each line: few bytes when packed, far more as a broadcast table in the driver
    held = lines.groupBy("batch", "text").agg(F.min("line_pos").alias("line_pos")).hint("merge")
    rest = [c for c in pairs.columns if c not in ("text", "hist_source", "place", "hist_target")]
    return held.join(pairs, "text").select(
        "batch", "text", "hist_source", F.struct("line_pos", "place.tok_pos", "place.ord").alias("at"), "hist_target", *rest
    )


def fuzzy_candidates(pairs: DataFrame, min_similarity: float = fv.MIN_SIMILARITY) -> DataFrame:
    """Pairs more similar than the threshold, with ``sim``.

    A pair of texts is compared once for a range of batches, whatever the number
    of them it occurs in; the range bounds the group.  The bounds from lengths
    and letters are exact, so they remove only pairs that would fail anyway and
    spare them the Python comparison.
    """
    near = compared_pairs(pairs, min_similarity).where(F.col("sim") > min_similarity)
    return near.select("text", "hist_source", "sim", F.inline("met"))


def compared_pairs(pairs: DataFrame, min_similarity: float = fv.MIN_SIMILARITY) -> DataFrame:
    """(text, hist_source, met, sim): the rows that Python compares, with the batches they were met in."""
    keys = ["text", "hist_source", "_range"]
    ranged = pairs.withColumn("_range", F.shiftright("batch", _RANGE_BITS)).repartition(_tasks(pairs), *keys)
    met = ranged.groupBy(*keys).agg(
        F.collect_list(F.struct("batch", "at", "hist_target")).alias("met")
    )
    # the bound from letters asks for the group, so it is not copied below it, to every single meeting
    letters = F.when(F.size("met") > 0, letters_bound("text", "hist_source"))
    near = met.where(similarity_bound("text", "hist_source") > min_similarity).where(letters > min_similarity)
    return near.withColumn("sim", similarity("text", "hist_source")).drop("_range")


def first_passing_hit(candidates: DataFrame, best: bool = False) -> DataFrame:
    """(batch, hist_source, hist_target, sim, at): the first hit of each past
    source, not its best one (unless ``best``).

    Rows of a batch come together, for the steps that follow.
    """
    hit = F.struct("hist_target", "sim", "at")
    pick = F.max_by(hit, F.struct("sim")) if best else F.min_by(hit, "at")
    return (
        candidates.repartition(_tasks(candidates), "batch")
        .groupBy("batch", "hist_source")
        .agg(pick.alias("_h"))
        .select("batch", "hist_source", "_h.hist_target", "_h.sim", "_h.at")
    )


def rank_candidates(hits: DataFrame) -> DataFrame:
    """Add ``rank`` within the batch: most similar first, then first met."""
    order = Window.partitionBy("batch").orderBy(F.desc("sim"), "at")
    return hits.withColumn("rank", F.row_number().over(order))


_REMEMBERED = 200_000  # compared pairs a task keeps before it starts afresh


@lru_cache(maxsize=10_000)
def _letter_counts(source: str) -> np.ndarray:
    points = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(points % _LETTER_BINS, minlength=_LETTER_BINS)


def keep_distinct(
    sources: list[str], threshold: float, cap: int, known: dict[tuple[str, str], bool] | None = None
) -> list[int]:
    """Indexes kept when each source is compared with those kept before it.

    ``known`` tells of pairs compared before, at the same threshold, and is added to.

    The ratio never exceeds what the shared letters of two texts allow.  That
    bound is taken for all kept sources at once from letter counts; letters fall
    into a fixed number of bins, which can only raise it.  Only pairs above the
    bound are compared.
    """
    known = {} if known is None else known
    lengths = np.array([len(source) for source in sources])
    counts = np.zeros((cap, _LETTER_BINS), dtype=np.int32)  # of the kept ones
    kept: list[int] = []
    matchers: dict[int, SequenceMatcher] = {}  # each indexes one kept source, once
    for i, source in enumerate(sources):
        if len(kept) >= cap:
            break
        own = _letter_counts(source)
        shared = np.minimum(counts[: len(kept)], own).sum(axis=1)
        bound = 2.0 * shared / np.maximum(lengths[kept] + lengths[i], 1)
        for at in np.flatnonzero((bound > threshold) | (lengths[kept] + lengths[i] == 0)):
            j = kept[at]
            pair = (source, sources[j])
            if pair not in known:
                if j not in matchers:
                    matchers[j] = SequenceMatcher(None, "", sources[j])
                matchers[j].set_seq1(source)
                known[pair] = matchers[j].ratio() > threshold
            if known[pair]:
                break
        else:
            counts[len(kept)] = own
            kept.append(i)
    return kept


def suppress_near_duplicates(
    ranked: DataFrame,
    threshold: float = fv.DUPLICATE_SIMILARITY,
    cap: int = fv.MAX_HINTS_PER_BATCH,
) -> DataFrame:
    """(batch, rank, hist_source, hist_target): greedy selection in rank order.

    A batch is one request, so its candidates are bounded by lines, tokens and
    postings per token; the greedy walk needs them together, as one list.  The
    same past sources meet in many batches: a task compares a pair of them once.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "hist_source", "hist_target")))
    lists = ranked.groupBy("batch").agg(rows.alias("_rows"))
    kept = F.transform(_kept_places(threshold, cap)("_rows.hist_source"), lambda i: F.get("_rows", i))
    return lists.select(F.col("batch").cast("long").alias("batch"), F.inline(kept)).select(
        "batch", F.col("rank").cast("int").alias("rank"), "hist_source", "hist_target"
    )


def _kept_places(threshold: float, cap: int) -> Callable[..., Column]:
    """``keep_distinct`` over a column of lists: a list, too, is walked once in a task while it is remembered."""
    known: dict[tuple[str, str], bool] = {}  # of a task, as the other two
    walked: dict[tuple[str, ...], list[int]] = {}
    held = [0]  # sources in ``walked``

    def choose(sources: list[str]) -> list[int]:
        key = tuple(sources)
        if key not in walked:
            if len(known) > _REMEMBERED:
                known.clear()
            if held[0] > _REMEMBERED:
                walked.clear()
                held[0] = 0
            walked[key] = keep_distinct(sources, threshold, cap, known)
            held[0] += len(key)
        return walked[key]

    # pickled in small portions, whatever the session's way of passing rows to Python
    return F.udf(choose, "array<int>", useArrow=False)


def tm_lists(kept: DataFrame) -> DataFrame:
    """(batch, tm_list): ordered {source, target} hints, at most the cap."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "hist_source", "hist_target")))
    return (
        kept.groupBy("batch")
        .agg(rows.alias("_r"))
        .select(
            "batch",
            F.transform(
                "_r",
                lambda r: F.struct(r["hist_source"].alias("source"), r["hist_target"].alias("target")),
            ).alias("tm_list"),
        )
    )


def retrieve_hints(
    batched: DataFrame,
    history: DataFrame | PostingsIndex,
    done: DataFrame | None = None,
    segment: Segmenter = tokens,
    postings_per_token: int = fv.POSTINGS_PER_TOKEN,
    min_similarity: float = fv.MIN_SIMILARITY,
    threshold: float = fv.DUPLICATE_SIMILARITY,
    cap: int = fv.MAX_HINTS_PER_BATCH,
) -> DataFrame:
    """(batch, tm_list).  With ``done`` (batch, pos, src, tgt) the causal mode.

    ``history`` may be an index, made by the same segmenter.
    """
    lines = line_tokens(batched, segment)
    wanted = lines.select("batch", "token").distinct()
    if isinstance(history, PostingsIndex):
        posted = history.of_tokens(wanted)
    elif done is None:
        posted = postings(history, segment)
    else:
        recent = causal_postings(wanted, history, done, postings_per_token, segment)
        hits = first_passing_hit(fuzzy_candidates(candidate_pairs(lines, recent), min_similarity))
        return tm_lists(suppress_near_duplicates(rank_candidates(hits), threshold, cap))
    passing = similar_text_pairs(text_pairs(lines, posted, postings_per_token), min_similarity)
    hits = first_passing_hit(in_batches(passing, lines))
    return tm_lists(suppress_near_duplicates(rank_candidates(hits), threshold, cap))
