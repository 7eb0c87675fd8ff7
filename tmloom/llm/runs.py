"""Periodic runs of words: tiles for each octave of periods, solved apart, their fragments stitched."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tmloom.operators.scale import materialize

LEAST_REPEATS = 4  # a run is at least so many periods long
LEAST_WORDS = 6
TILE_WORDS = 8192  # of a tile; periods above an eighth of it have longer tiles
WINDOW_WORDS = 64  # within a tile, likewise
SCREEN_WORDS = 8  # compared for all periods at once before a Z-function is worked out
SLICE_CHARS = 4_000_000
_PAIRS = 1 << 21  # compared in one step


@dataclass(frozen=True)
class Octave:
    """The periods from 2^k to 2^(k+1) - 1, and the sizes that follow from them.

    Place i *matches* period q if word i equals word i + q.  A run of period q
    is a stretch of at least ``need(q)`` matching places.  Boundaries lie
    ``gap`` places apart, so every such stretch holds one with at least
    ``screen`` matching places from there on.
    """

    k: int
    repeats: int = LEAST_REPEATS
    words: int = LEAST_WORDS

    @property
    def low(self) -> int:
        return 1 << self.k

    @property
    def high(self) -> int:
        return 2 << self.k

    @property
    def gap(self) -> int:
        return 2 << self.k

    def need(self, q: int) -> int:
        return max((self.repeats - 1) * q, self.words - q)

    @property
    def overlap(self) -> int:
        return max(self.need(self.low), self.need(self.high - 1))

    @property
    def screen(self) -> int:
        return max(1, min(SCREEN_WORDS, min(self.need(q) - self.gap + 1 for q in (self.low, self.low + 1, self.high - 1))))

    def least_length(self) -> int:
        return max(self.repeats * self.low, self.words)

    def stride(self, least: int) -> int:
        return max(least, 8 << self.k)


def screened(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, octave: Octave) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (boundary, period) whose next ``screen`` places match, of all texts at once.

    ``words`` holds the texts one after another; boundaries are places in it.
    """
    long = ends - starts >= octave.least_length()
    starts, ends = starts[long], ends[long]
    counts = -(-(ends - starts) // octave.gap)
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    at = np.repeat(starts, counts) + (np.arange(total) - np.repeat(first, counts)) * octave.gap
    end = np.repeat(ends, counts)
    periods = np.arange(octave.low, octave.high)
    step = max(1, _PAIRS // len(periods))
    places, found = [], []
    for s in range(0, total, step):
        c, e = at[s : s + step, None], end[s : s + step, None]
        other = np.minimum(c + periods, len(words) - 1)
        row, column = np.nonzero((words[other] == words[c]) & (c + periods < e))
        c, e, q = c[row, 0], e[row, 0], periods[column]
        for j in range(1, octave.screen):
            inside = np.minimum(c + q + j, len(words) - 1)
            ok = (c + q + j < e) & (words[inside] == words[inside - q])
            c, e, q = c[ok], e[ok], q[ok]
        places.append(c)
        found.append(q)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(found)


def z_function(s: list) -> list[int]:
    """For each place, how many items from there on equal those from the start (0 for the start)."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        m = 0
        if i < right:
            m = z[i - left]
            if m < right - i:
                z[i] = m
                continue
            m = right - i
        while i + m < n and s[m] == s[i + m]:
            m += 1
        z[i] = m
        if i + m > right:
            left, right = i, i + m
    return z


def _prime_divisors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def _window_fragments(words: list, octave: Octave, low: int, high: int, pairs) -> Iterator[tuple[int, int, int]]:
    """Stretches (period, start, stop) of matching places in words[low:high], long enough and of smallest period.

    ``pairs`` are the screened (boundary, periods) of the window.  At a boundary
    one Z-function over the words after it and one over the words before it
    give, for every period at once, how far matching places reach to either side.
    """
    reached: dict[int, int] = {}
    for c, periods in pairs:
        fresh = [q for q in periods if reached.get(q, -1) <= c and c + q < high]
        if not fresh:
            continue
        ahead = z_function(words[c:high])
        before = words[low:c][::-1]
        span = min(octave.high - 1, high - c)
        behind = z_function([*before, None, *words[c : c + span][::-1], *before])
        base = len(before) + 1 + span
        for q in fresh:
            left, right = behind[base - q] if before else 0, ahead[q]
            reached[q] = c + right
            if left + right < octave.need(q):
                continue
            divided = any(
                (not left or behind[base - q // p] >= left) and ahead[q // p] >= right + q - q // p
                for p in _prime_divisors(q)
            )
            if not divided:
                yield q, c - left, c + right


def stitched(fragments) -> list[tuple[int, int, int]]:
    """(period, start, stop) with touching ones of a period made one."""
    out: list[tuple[int, int, int]] = []
    for q, start, stop in sorted(fragments):
        if out and out[-1][0] == q and start <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(stop, out[-1][2]))
        else:
            out.append((q, start, stop))
    return out


def tile_fragments(words: np.ndarray, octave: Octave) -> list[tuple[int, int, int]]:
    """All stretches (period, start, stop) of one tile that are long enough, each of smallest period.

    The tile is worked through in windows that overlap by the longest stretch
    asked for, so a stretch is whole in one of them or its parts touch.
    """
    c, q = screened(words, np.zeros(1, np.int64), np.array([len(words)]), octave)
    if not len(c):
        return []
    items = words.tolist()
    order = np.lexsort((q, c))
    c, q = c[order], q[order]
    first = np.flatnonzero(np.append(True, np.diff(c) != 0))
    places = c[first]
    periods = [x.tolist() for x in np.split(q, first[1:])]
    stride = octave.stride(WINDOW_WORDS)
    out = []
    for w in np.unique(np.concatenate([places // stride, np.maximum(places - octave.overlap, 0) // stride])).tolist():
        low = w * stride
        a, b = np.searchsorted(places, [low, low + stride + octave.overlap])
        high = min(len(items), low + stride + octave.overlap + octave.high)
        out += _window_fragments(items, octave, low, high, zip(places[a:b].tolist(), periods[a:b], strict=True))
    return stitched(out)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _rendered(words: list[bytes], digest: bool) -> str:
    joined = b" ".join(words)
    return hashlib.sha256(joined).hexdigest() if digest else joined.decode()


def _exploded(rows: DataFrame, repeats: int, least: int, tile_words: int, digest: bool) -> DataFrame:
    """One row for each text (``octave`` null), and one for each of its tiles that may hold a run.

    Texts without such a tile are settled: ``collapsed`` is set and ``text`` is null.
    """
    fields = "_row long, octave int, start long, words binary, n_words long, text string, collapsed string"
    schema = StructType([rows.schema["_id"], *StructType.fromDDL(fields).fields])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def batch_of(ids, out):
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *columns], schema.names)

    def tiles(ids, rows, texts):
        numbers = _Numbers()
        words = [(t or "").encode().split() for t in texts]
        ends = np.cumsum([len(w) for w in words])
        starts = np.append(0, ends[:-1])
        flat = np.fromiter((numbers[w] for text in words for w in text), np.int32, int(ends[-1]))
        open_ = set()
        out, size = [], 0
        k, longest = 0, int((ends - starts).max())
        while (octave := Octave(k, repeats, least)).least_length() <= longest:
            k += 1
            place, _ = screened(flat, starts, ends, octave)
            if not len(place):
                continue
            place = np.unique(place)
            text = np.searchsorted(ends, place, side="right")
            inside = place - starts[text]
            stride = octave.stride(tile_words)
            last = inside // stride
            one = np.maximum(inside - octave.overlap + 1, 0) // stride
            each = np.unique(np.concatenate([np.stack([text, last]), np.stack([text, one])], axis=1), axis=1)
            for t, tile in each.T.tolist():
                open_.add(t)
                low = int(starts[t]) + tile * stride
                high = min(int(ends[t]), low + stride + octave.overlap + octave.high)
                out.append((rows[t], octave.k, tile * stride, flat[low:high].tobytes(), None, None, None))
                size += high - low
                if size > SLICE_CHARS:
                    yield batch_of(pa.nulls(len(out), ids.type), out)
                    out, size = [], 0
        if out:
            yield batch_of(pa.nulls(len(out), ids.type), out)
        out = []
        for t, w in enumerate(words):
            settled = t not in open_
            out.append((rows[t], None, None, None, len(w), None if settled else texts[t],
                        _rendered(w, digest) if settled else None))
        yield batch_of(ids, out)

    def run(batches):
        for batch in batches:
            rows, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < SLICE_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                yield from tiles(batch.column(0).slice(at, end - at), rows[at:end], texts[at:end])
                at = end

    return rows.mapInArrow(run, schema)


def _fragments(tiles: DataFrame, repeats: int, least: int) -> DataFrame:
    """(``_row``, ``period``, ``start``, ``stop``) of every tile, each tile on its own."""

    def run(batches):
        for batch in batches:
            out = []
            for row, k, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                octave = Octave(k, repeats, least)
                out += [
                    (row, q, start + a, start + b)
                    for q, a, b in tile_fragments(np.frombuffer(words, np.int32), octave)
                ]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["_row", "period", "start", "stop"]
            )

    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(parts, "_row", "octave", "start").select("_row", "octave", "start", "words")
    return dealt.mapInArrow(run, "_row long, period long, start long, stop long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """(``_row``, ``start``, ``length``, ``period``): fragments of a text and period that touch made one.

    A text sends at most one fragment of a period from each ``TILE_WORDS`` words
    that one run fills.
    """
    by = Window.partitionBy("_row", "period").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("_new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    parts = parts.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("_row", "period", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return whole.select("_row", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = LEAST_REPEATS,
    least_words: int = LEAST_WORDS, digest: bool = False, tile_words: int = TILE_WORDS,
) -> DataFrame:
    """(``id_col``, ``n_words``, ``runs``, ``collapsed``) for every row.

    Words are runs of characters but ASCII white space, numbered from 0.  A run
    is a longest stretch of words of one smallest period, at least ``repeats``
    (three or more) times as long and of ``least_words`` words; ``runs`` lists
    (start, length, period) by start, then period.  ``collapsed`` joins by a
    space the words that no run holds after its first period; with ``digest``
    its SHA-256 in hex instead.  Null and empty texts have no words, no runs and
    the empty text; ids may be null or repeat, each row stands for itself.  An
    empty table gives an empty result; other columns are left out.

    Each text is cut into overlapping tiles, anew for each octave of periods;
    only tiles are written in which the words after some boundary recur at a
    distance of that octave.  Tiles are solved apart, wherever they are dealt,
    and the stretches of a text and period are stitched where they touch.  So a
    long text is worked on by many tasks.
    """
    if repeats < 3:
        raise ValueError("boundaries lie too far apart for runs of fewer than three periods")
    numbered = docs.select(
        F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"),
        F.col(text_col).cast("string").alias("_text"),
    )
    exploded = materialize(_exploded(numbered, repeats, least_words, tile_words, digest), "tiles")
    tiles = exploded.where(F.col("octave").isNotNull())
    found = _stitched(_fragments(tiles, repeats, least_words))
    runs = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
    texts = exploded.where(F.col("octave").isNull())
    open_ = texts.where(F.col("collapsed").isNull()).join(runs, "_row", "left")

    def collapse(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                for r in runs or ():
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                dropped = np.cumsum(change)[:-1] > 0
                out.append(_rendered([w for w, d in zip(words, dropped.tolist(), strict=True) if not d], digest))
            arrays = [batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "n_words", "_runs", "collapsed"])

    kind = "array<struct<start: bigint, period: bigint, length: bigint>>"
    made = StructType([
        open_.schema["_id"], *StructType.fromDDL(f"n_words long, _runs {kind}, collapsed string").fields
    ])
    collapsed = open_.select("_id", "n_words", "text", "_runs").mapInArrow(collapse, made)
    settled = texts.where(F.col("collapsed").isNotNull()).select(
        "_id", "n_words", F.lit(None).cast(kind).alias("_runs"), "collapsed"
    )
    listed = F.transform(
        F.coalesce("_runs", F.array().cast(kind)), lambda r: F.struct(r["start"], r["length"], r["period"])
    )
    return settled.unionByName(collapsed).select(
        F.col("_id").alias(id_col), "n_words", listed.alias("runs"), "collapsed"
    )
