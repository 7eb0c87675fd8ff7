"""Toxicity from two Kneser-Ney models of spelling, one for each class."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.llm.folds import bounded_labels
from tmloom.llm.texts import Shared, map_texts, words_of
from tmloom.operators.scale import materialize

ORDER = 6
SAMPLE_ROWS = 6000  # labelled rows of each class that the models are fitted on, at most
DISCOUNT = 0.75
MARGIN = 4.0  # nats by which a word must favour class 1 to stand out
CACHE_WORDS = 300_000
_MULTIPLIER = 0x9E3779B97F4A7C15


def grams_of(word: str, order: int = ORDER) -> list[str]:
    """For each letter and the end mark, the letter with up to ``order`` - 1 before it."""
    marked = f"^{word}$"
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def gram_counts(
    labelled: DataFrame, text_col: str, class_col: str, half_col: str, order: int = ORDER
) -> DataFrame:
    """(``gram``, ``c0`` to ``c3``): how often each gram occurs in class + 2 * half.

    Words are counted inside each task first, so one row per gram and task is
    shuffled.
    """
    names = ["c0", "c1", "c2", "c3"]

    def run(batches):
        words = [Counter() for _ in names]
        for batch in batches:
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words[int(label) + 2 * int(half)].update(words_of(text))
        grams: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for slot, counted in enumerate(words):
            for word, n in counted.items():
                for g in grams_of(word, order):
                    grams[g][slot] += n
        counts = np.array(list(grams.values()), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(grams), pa.string()), *[pa.array(c) for c in counts.T.copy()]], ["gram", *names]
        )

    return (
        labelled.select(text_col, class_col, half_col)
        .mapInArrow(run, "gram string, c0 long, c1 long, c2 long, c3 long")
        .groupBy("gram")
        .agg(*[F.sum(c).alias(c) for c in names])
    )


@dataclass
class SpellingModels:
    """For grams seen in a class, log P1 - log P0; for histories, the difference of their backoff."""

    gram_keys: np.ndarray
    gram_values: np.ndarray
    history_keys: np.ndarray
    history_values: np.ndarray
    order: int
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, grams: list[tuple[str, int, int]], order: int = ORDER) -> SpellingModels:
        """Kneser-Ney with one discount.

        The counts of whole grams belong to a class.  Every shorter history is
        estimated from continuation counts (the different letters seen before a
        gram) of both classes together, so both models back off to the same
        distribution, and a rare spelling that neither class knows weighs
        nothing.
        """
        shared: dict[str, float] = {}
        followers: dict[str, set[str]] = defaultdict(set)
        for g, _, _ in grams:
            for k in range(1, len(g)):
                followers[g[k:]].add(g[k - 1])
        counts = {g: len(before) for g, before in followers.items()}
        letters = len({g[-1] for g in counts}) + 1
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        for g in sorted(counts, key=len):
            h = g[:-1]
            lower = shared[g[1:]] if h else 1 / letters
            shared[g] = (max(counts[g] - DISCOUNT, 0) + DISCOUNT * kinds[h] * lower) / total[h]
        seen = [(Counter(), Counter()), (Counter(), Counter())]
        for g, *c in grams:
            for k in (0, 1):
                if c[k]:
                    seen[k][0][g[:-1]] += c[k]
                    seen[k][1][g[:-1]] += 1
        backoff = [
            {h: DISCOUNT * kinds_[h] / n for h, n in total_.items()} for total_, kinds_ in seen
        ]
        gram_value, history_value = {}, {}
        for g, *c in grams:
            h = g[:-1]
            lower = shared.get(g[1:], 1 / letters)
            p = [
                max(c[k] - DISCOUNT, 0) / seen[k][0][h] + backoff[k][h] * lower
                if h in backoff[k] else lower
                for k in (0, 1)
            ]
            gram_value[g] = np.log(p[1]) - np.log(p[0])
        for h in backoff[0].keys() | backoff[1].keys():
            history_value[h] = np.log(backoff[1].get(h, 1.0)) - np.log(backoff[0].get(h, 1.0))
        return cls(*_sorted(gram_value, False), *_sorted(history_value, True), order)

    def word_values(self, words: list[str]) -> np.ndarray:
        """log-likelihood under class 1 less that under class 0, for each word."""
        points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.cumsum(lengths) - lengths
        inside = np.arange(len(points)) - np.repeat(starts, lengths)
        gram, history = _rolled(points, inside, self.order)
        value, found = _looked_up(self.gram_keys, self.gram_values, gram)
        back, _ = _looked_up(self.history_keys, self.history_values, history)
        value = np.where(inside > 0, np.where(found, value, back), 0.0)
        return np.add.reduceat(value, starts)


def _rolled(points: np.ndarray, inside: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the gram that ends at each place, and of its history."""
    gram, history = np.zeros(len(points), np.uint64), np.zeros(len(points), np.uint64)
    power = np.uint64(1)
    for back in range(min(order, len(points))):
        part = np.zeros(len(points), np.uint64)
        part[back:] = (points[: len(points) - back].astype(np.uint64) + np.uint64(1)) * power
        part[inside < back] = 0
        gram += part
        if back:
            history += part
        power = np.uint64((int(power) * _MULTIPLIER) % 2**64)
    return gram, history


def _key(gram: str, history: bool) -> int:
    key, power = 0, _MULTIPLIER if history else 1
    for ch in reversed(gram):
        key = (key + (ord(ch) + 1) * power) % 2**64
        power = power * _MULTIPLIER % 2**64
    return key


def _sorted(values: dict[str, float], history: bool) -> tuple[np.ndarray, np.ndarray]:
    keys = np.fromiter((_key(g, history) for g in values), np.uint64, len(values))
    order = np.argsort(keys)
    return keys[order], np.fromiter(values.values(), np.float32, len(values))[order]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray):
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], 0.0), found


def ratios(models: SpellingModels, texts, cache: dict[str, float]) -> np.ndarray:
    """Of each text: sum of the words' log-likelihood differences, sum of their excess over MARGIN, words."""
    found = [words_of(t) for t in texts]
    if len(cache) > CACHE_WORDS:
        cache.clear()
    new = list(set().union(*found).difference(cache))
    if new:
        cache.update(zip(new, models.word_values(new).tolist(), strict=True))
    out = np.zeros((len(texts), 3))
    for k, words in enumerate(found):
        values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        out[k] = values.sum(), np.maximum(values - MARGIN, 0).sum(), len(words)
    return out


def _features(sums: np.ndarray) -> np.ndarray:
    total, excess, words = sums.reshape(-1, 3).T
    n = np.maximum(words, 1)
    return np.column_stack([np.ones(len(n)), total / n, 100 * excess / n, np.log1p(excess)])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(``id_col``, ``score``, ``log_ratio``, ``excess``, ``words``) for every row of ``docs``.

    ``labels`` holds (``id_col``, ``label_col``) of the rows to learn from.  Two spelling
    models are fitted on a bounded sample.  The length-normalised difference of
    their log-likelihoods becomes a probability by a logistic fit, on each half
    of the sample as the models of the other half see it.  Beside the mean over all words it sees the excess of single
    words over MARGIN, per word and in all, since the mean also moves with the
    share of languages in either class.  Nulls count as the empty text; texts
    without words get the fitted score of ratio 0.  With fewer than two classes every score is the share of class 1.
    """
    spark = docs.sparkSession
    chosen, _ = bounded_labels(labels, id_col, label_col, sample_rows)
    docs = docs.select(id_col, text_col)
    sample = docs.join(F.broadcast(chosen), id_col)
    half = F.pmod(F.xxhash64(F.lit("half"), F.col(id_col)), F.lit(2))
    sample = materialize(sample.select(id_col, text_col, label_col, half.alias("_half")), "sample")
    grams = gram_counts(sample, text_col, label_col, "_half").collect()
    of = lambda c: [(g, *n) for g, *x in grams if sum(n := c(*x))]
    by_half = [
        Shared(spark, SpellingModels.fit(of(c)))
        for c in (lambda a, b, c, d: (c, d), lambda a, b, c, d: (a, b))
    ]
    shared = Shared(spark, SpellingModels.fit(of(lambda a, b, c, d: (a + c, b + d))))
    held = pd.concat(
        [
            _scored(sample.where(F.col("_half") == k), by_half[k], id_col, text_col, [label_col], None)
            .select(label_col, "log_ratio", "excess", "words").toPandas()
            for k in (0, 1)
        ]
    )
    weights = fit_logistic(
        _features(held[["log_ratio", "excess", "words"]].to_numpy(float)),
        held[label_col].to_numpy().astype(float),
    )
    return _scored(docs, shared, id_col, text_col, [], weights)


def _scored(docs, shared, id_col, text_col, rest, weights) -> DataFrame:
    def prepare():
        models, cache = shared.value, {}

        def work(texts):
            sums = ratios(models, texts, cache)
            logit = np.clip(_features(sums) @ (np.zeros(4) if weights is None else weights), -40, 40)
            score = 1 / (1 + np.exp(-logit))
            return [*map(pa.array, (score, sums[:, 0], sums[:, 1], sums[:, 2].astype(np.int64)))]

        return work

    fields = "score double, log_ratio double, excess double, words long"
    return map_texts(docs, [id_col, *rest], text_col, prepare, fields)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, classes weighing the same."""
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1])
        w[0] = 0.0 if not len(y) else (20.0 if y[0] > 0 else -20.0)
        return w
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
