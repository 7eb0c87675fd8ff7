"""Language of mixed texts: scripts, word scores, and Viterbi with a switching penalty."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.llm.folds import bounded_sample
from tmloom.llm.texts import Shared, map_texts, words_of

SAMPLE_ROWS = 2000  # labelled rows of each language, at most
BUCKETS = 1 << 17
GRAM = 3
SMOOTHING = 0.5
SWITCH = 8.0
SCRIPT_SHARE = 0.01  # of a language's letters, for a script to make it a candidate
CACHE_WORDS = 300_000
UNDETERMINED = "und"
# First code points of ranges, and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0250, "other"), (0x0370, "Greek"), (0x0400, "Cyrillic"),
    (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"),
    (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"),
    (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"),
    (0xFB00, "other"), (0x20000, "Han"), (0x32000, "other"),
]
_FROM = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def script_of(letters: np.ndarray) -> np.ndarray:
    """Number of the script of each code point."""
    return _SCRIPT_OF[np.searchsorted(_FROM, letters, side="right") - 1]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character grams of all words, number of grams of each, and script of each.

    A word's script is that of its first letter.
    """
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    key = np.zeros(len(points), np.uint64)
    for k in range(GRAM):
        key[: len(points) - k] += points[k:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 ** (k + 1) % 2**64)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (key >> np.uint64(32)).astype(np.int64) % BUCKETS
    left = np.repeat(ends, lengths) - np.arange(len(points))
    return bucket[left >= GRAM], lengths - GRAM + 1, script_of(points[starts + 1])


@dataclass
class LanguageModel:
    """``values`` is log P(gram | language), (BUCKETS, languages)."""

    languages: list[str]
    values: np.ndarray
    candidates: np.ndarray  # scripts x languages
    common: int

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-posteriors (even prior) of the candidate languages of each word's script.

        A language that does not use the script gets the floor; a word in a
        script that no language uses scores all alike.
        """
        bucket, counts, script = word_grams(words)
        sums = np.add.reduceat(self.values[bucket], np.cumsum(counts) - counts, axis=0)
        open_ = self.candidates[script]
        open_[~open_.any(axis=1)] = True
        sums = np.where(open_, sums, -np.inf)
        sums -= sums.max(axis=1, keepdims=True)
        scores = sums - np.log(np.exp(sums).sum(axis=1, keepdims=True))
        none = ~self.candidates[script].any(axis=1)
        scores[none] = -np.log(len(self.languages))
        return np.maximum(scores, -30.0).astype(np.float32)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Gram counts by language from (text, language) rows, added up in Spark.

    At most BUCKETS counts and a few script counts of each language reach the
    driver.  Rows without language are left out; None if no row is left.
    """

    def run(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words[lang].update(words_of(text))
        for lang, counted in words.items():
            if not counted:
                continue
            times = np.fromiter(counted.values(), np.int64, len(counted))
            bucket, counts, script = word_grams(list(counted))
            sums = np.bincount(bucket, np.repeat(times, counts), BUCKETS)
            scripts = np.bincount(script, times, len(_NAMES))
            used, kinds = np.flatnonzero(sums), np.flatnonzero(scripts)
            slots = np.concatenate([used, -1 - kinds])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slots), pa.string()), pa.array(slots),
                 pa.array(np.concatenate([sums[used], scripts[kinds]]))],
                ["lang", "slot", "n"],
            )

    rows = (
        labelled.where(F.col(lang_col).isNotNull())
        .select(text_col, lang_col)
        .mapInArrow(run, "lang string, slot long, n double")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    at = rows["lang"].map({name: k for k, name in enumerate(languages)}).to_numpy()
    slot, n = rows["slot"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros((BUCKETS, len(languages)))
    gram = slot >= 0
    counts[slot[gram], at[gram]] = n[gram]
    scripts = np.zeros((len(_NAMES), len(languages)))
    scripts[-1 - slot[~gram], at[~gram]] = n[~gram]
    kinds = (counts.sum(axis=1) > 0).sum()
    values = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * kinds)
    return LanguageModel(
        languages, values.astype(np.float32), scripts > SCRIPT_SHARE * scripts.sum(axis=0),
        int(scripts.sum(axis=0).argmax()),
    )


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word, for many texts at once.

    ``scores`` holds the words of all texts one after another.  A path gains
    the words' scores and loses ``switch`` at each change of language.  Texts
    go side by side, word by word, the longest first, so that those with words
    left are always the first ones.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n, langs = len(lengths), scores.shape[1]
    longest = int(lengths[0]) if n else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    came = np.zeros((len(scores), langs), bool)  # the best path into this word switched here
    best_from = np.zeros(len(scores), np.int16)
    total = np.zeros((n, langs))
    for t in range(longest):
        k = active[t]
        at = starts[:k] + t
        if t:
            before = total[:k]
            best = before.argmax(axis=1)
            moved = before[np.arange(k), best][:, None] - switch
            change = moved > before
            came[at], best_from[at] = change, best
            total[:k] = np.where(change, moved, before) + scores[at]
        else:
            total[:k] = scores[at]
    labels = np.zeros(len(scores), np.int16)
    state = total.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        here = state[:k]
        labels[at] = here
        state[:k] = np.where(came[at, here], best_from[at], here)
    return labels


def label_texts(model: LanguageModel, texts: list, cache: dict[str, int], table: list, switch: float):
    """For each text its spans (language, words, letters) in order, and letters by language."""
    found = [words_of(t) for t in texts]
    if len(cache) > CACHE_WORDS:
        cache.clear()
        table.clear()
    new = list(set().union(*found).difference(cache))
    if new:
        cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
        table.append(model.word_scores(new))
        table[:] = [np.concatenate(table)]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lengths) - lengths
    spans, letters = [[] for _ in found], np.zeros((len(found), len(model.languages)))
    total = int(lengths.sum())
    if not total:
        return spans, letters
    flat = [w for words in found for w in words]
    index = np.fromiter(map(cache.__getitem__, flat), np.int64, total)
    size = np.fromiter(map(len, flat), np.int64, total)
    labels = viterbi(table[0][index], starts, lengths, switch)
    text = np.repeat(np.arange(len(found)), lengths)
    first = np.flatnonzero(np.append(True, (np.diff(labels) != 0) | (np.diff(text) != 0)))
    words = np.diff(np.append(first, total))
    chars = np.add.reduceat(size, first)
    np.add.at(letters, (text[first], labels[first]), chars)
    for t, lang, w, c in zip(text[first].tolist(), labels[first].tolist(), words.tolist(), chars.tolist(), strict=True):
        spans[t].append({"lang": model.languages[lang], "words": w, "letters": c})
    return spans, letters


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    switch: float = SWITCH,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(``id_col``, ``carry``, ``lang_pred``, ``score``, ``spans``) for every row of ``docs``.

    Learns from ``labelled`` rows with a language, at most about
    ``sample_rows`` of each.  ``spans`` lists the runs of words of one language
    in order; ``lang_pred`` is the language with most letters (ties: the first
    by name), ``score`` its share of all letters and marks.  Texts that are null, empty
    or without letters, and all texts if nothing was learned, are ``und`` with
    score 0.
    """
    known = labelled.where(F.col(lang_col).isNotNull())
    sample, _ = bounded_sample(known, id_col, lang_col, sample_rows)
    model = fit(sample, text_col, lang_col)
    shared = Shared(docs.sparkSession, model)

    def prepare():
        model, cache, table = shared.value, {}, []

        def work(texts):
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            spans: list = [[] for _ in texts]
            if model is not None:
                spans, letters = label_texts(model, texts, cache, table, switch)
                total = letters.sum(axis=1)
                scores = letters.max(axis=1) / np.maximum(total, 1)
                names = [
                    model.languages[b] if n else UNDETERMINED
                    for b, n in zip(letters.argmax(axis=1).tolist(), total.tolist(), strict=True)
                ]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("letters", pa.int64())]))
            return [pa.array(names, pa.string()), pa.array(scores), pa.array(spans, kind)]

        return work

    return map_texts(
        docs, [id_col, *carry], text_col, prepare,
        "lang_pred string, score double, spans array<struct<lang string, words long, letters long>>",
    )
