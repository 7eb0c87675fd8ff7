"""Document quality from a conditional random field over the lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.llm.folds import bounded_labels
from tmloom.llm.texts import Shared, map_texts

SAMPLE_ROWS = 1500  # labelled documents of each class that the field is fitted on, at most
ROUNDS = 100  # of the fit, at most
FLAT = 1e-4  # slope at which it ends
RIDGE = 1e-3
CHAIN_LINES = 512  # of a training text that go as one chain

_KINDS = ("upper", "lower", "digit", "space", "stop", "mark", "symbol", "other")
_CLASS = np.full(256, _KINDS.index("other"), np.uint8)
for _name, _chars in (
    ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("digit", b"0123456789"),
    ("space", b" \t\x0b\x0c\r"), ("stop", b".?"), ("mark", b",;:'\"()-"),
    ("symbol", b"!#$%&*+/<=>@[\\]^_`{|}~"),
):
    _CLASS[list(_chars)] = _KINDS.index(_name)
FEATURES = 16


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, bytes of each line, and number of lines of each text.

    Bytes are counted by kind for all lines at once.  An empty or null text is
    one empty line.
    """
    lines = [(t or "").split("\n") for t in texts]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer("\n".join("\n".join(x) for x in lines).encode() + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    kind = _CLASS[data]
    kind[ends] = _KINDS.index("space")
    share = {
        name: (np.add.reduceat((kind == k).astype(np.int32), starts) - (name == "space")).astype(float)
        for k, name in enumerate(_KINDS)
    }
    gap = kind == _KINDS.index("space")
    word_start = ~gap
    word_start[1:] &= gap[:-1]
    words = np.add.reduceat(word_start.astype(np.int32), starts).astype(float)
    doubled = np.zeros(len(data), np.int32)
    doubled[1:] = (data[1:] == data[:-1]) & (kind[1:] == _KINDS.index("symbol"))
    stuttered, bare = _word_shares(data, kind, word_start, starts)
    some, n = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(share["upper"] + share["lower"] + share["other"], 1)
    last = kind[np.maximum(ends - 1, 0)]
    repeated = np.concatenate([_seen_before(x) for x in lines]) if lines else np.zeros(0)
    features = np.column_stack([
        np.ones(len(size)),
        share["upper"] / letters,
        (share["upper"] > 0.5 * letters) * 1.0,
        share["symbol"] / some * 5,
        np.minimum(share["symbol"] / n, 2),
        np.add.reduceat(doubled, starts) / n,
        share["digit"] / some * 5,
        share["stop"] / n * 3,
        share["mark"] / n * 2,
        np.minimum((some - share["space"]) / n, 20) / 10,
        np.log1p(size) / 5,
        np.isin(last, [_KINDS.index("stop"), _KINDS.index("mark")]) * 1.0,
        (size == 0) * 1.0,
        repeated,
        stuttered / n,
        bare / n,
    ])
    return features, size.astype(float), counts


def _word_shares(data, kind, word_start, starts) -> tuple[np.ndarray, np.ndarray]:
    """Words of each line that equal the word before them, and words without a letter."""
    gap = kind == _KINDS.index("space")
    first = np.flatnonzero(word_start)
    stuttered, bare = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
    if len(first):
        number = np.cumsum(word_start) - 1
        inside = np.arange(len(data)) - first[np.maximum(number, 0)]
        value = np.where(gap, 0, (data + 1.0) * np.sin(inside + 1.0))
        sums = np.add.reduceat(value, first)
        length = np.add.reduceat((~gap).astype(np.int32), first)
        line = np.searchsorted(starts, first, side="right")
        same = (np.abs(np.diff(sums)) < 1e-6) & (np.diff(length) == 0) & (np.diff(line) == 0)
        stuttered[first[1:]] = same
        letters = np.isin(kind, [_KINDS.index(k) for k in ("upper", "lower", "other")])
        bare[first] = np.add.reduceat(letters.astype(np.int32), first) == 0
    return np.add.reduceat(stuttered, starts), np.add.reduceat(bare, starts)


def _seen_before(lines: list[str]) -> np.ndarray:
    seen: set[str] = set()
    out = np.zeros(len(lines))
    for k, line in enumerate(lines):
        if line in seen:
            out[k] = bool(line)
        seen.add(line)
    return out


def with_neighbours(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it (zero at the ends)."""
    first = np.cumsum(counts) - counts
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:] = features[:-1]
    after[:-1] = features[1:]
    before[first] = 0
    after[first + counts - 1] = 0
    return np.concatenate([features, before[:, 1:], after[:, 1:]], axis=1)


def marginals(unary: np.ndarray, step: np.ndarray, counts: np.ndarray):
    """Forward-backward for many chains at once.

    ``unary`` (lines, 2) and ``step`` (2, 2) are log-potentials.  Returns each
    line's log-marginals, and the probability of each transition (n, 2, 2) from
    the lines that have a next one, with the numbers of those lines.  Chains go side by side, the longest first.
    """
    start = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    start, counts = start[order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest), side="left")
    ahead, behind = np.zeros_like(unary), np.zeros_like(unary)
    for t in range(longest):
        at = start[: active[t]] + t
        if t:
            prior = ahead[at - 1][:, :, None] + step
            ahead[at] = np.logaddexp(prior[:, 0], prior[:, 1]) + unary[at]
        else:
            ahead[at] = unary[at]
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        later = step + (unary[at + 1] + behind[at + 1])[:, None, :]
        behind[at] = np.logaddexp(later[:, :, 0], later[:, :, 1])
    end = start + counts - 1
    whole = np.empty(len(counts))
    whole[order] = np.logaddexp(ahead[end, 0], ahead[end, 1])
    back = np.empty_like(counts)
    back[order] = counts
    per_line = np.repeat(whole, back)
    inner = np.ones(len(unary), bool)
    inner[end] = False
    i = np.flatnonzero(inner)
    pair = np.exp(
        ahead[i][:, :, None] + step + (unary[i + 1] + behind[i + 1])[:, None, :] - per_line[i][:, None, None]
    )
    return ahead + behind - per_line[:, None], pair, i


def chain_gradient(theta: np.ndarray, x: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray):
    """Summed loss and gradient of some chains, every line bearing its chain's label and weight.

    ``x`` holds the lines' features with their neighbours', chain after chain.
    """
    width = x.shape[1]
    weights, step = theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)
    unary = x @ weights
    target = np.repeat(label, counts).astype(int)
    mass = np.repeat(weight, counts)
    log_p, pair, inner = marginals(unary, step, counts)
    grad_w = x.T @ ((np.exp(log_p) - np.column_stack([1 - target, target])) * mass[:, None])
    # the loss is that of the whole labelling: of the first line's mark, and of each next one given the one before
    first = np.cumsum(counts) - counts
    given = np.log(np.maximum(pair[np.arange(len(inner)), target[inner], target[inner]], 1e-300)) - log_p[inner, target[inner]]
    loss = -(log_p[first, target[first]] @ weight) - given @ mass[inner]
    pair = pair.copy()
    pair[np.arange(len(inner)), target[inner], target[inner]] -= 1
    grad_s = (pair * mass[inner][:, None, None]).sum(axis=0)
    return loss, np.concatenate([grad_w.ravel(), grad_s.ravel()])


def least_point(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int) -> np.ndarray:
    """Where a convex ``loss`` (value, gradient) is least, from zero on.

    Steps follow the curvature that the last gradients show (limited-memory
    BFGS), each halved until the loss goes down.
    """
    at = np.zeros(size)
    value, slope = loss(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        if np.abs(slope).max() < FLAT:
            break
        way, shares = slope.copy(), []
        for step, turn in reversed(past):
            share = step @ way / (step @ turn)
            way -= share * turn
            shares.append(share)
        if past:
            step, turn = past[-1]
            way *= step @ turn / (turn @ turn)
        for (step, turn), share in zip(past, reversed(shares), strict=True):
            way += (share - turn @ way / (step @ turn)) * step
        size_ = 1.0 if past else 1.0 / max(1.0, np.abs(slope).sum())
        while True:
            after = at - size_ * way
            new, bend = loss(after)
            if new <= value - 1e-4 * size_ * (slope @ way) or size_ < 1e-6:
                break
            size_ /= 2
        if new > value:
            break
        if (after - at) @ (bend - slope) > 0:
            past = [*past[-9:], (after - at, bend - slope)]
        at, value, slope = after, new, bend
    return at


@dataclass
class LineField:
    weights: np.ndarray  # features x 2
    step: np.ndarray  # 2 x 2

    @classmethod
    def fit(cls, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, mass: np.ndarray) -> LineField:
        """Maximum conditional likelihood with a ridge, every line bearing its document's label.

        A document weighs ``mass``, shared among its lines.  Lines have their
        true neighbours' features; for the steps between lines a document is
        taken in runs of at most CHAIN_LINES, which go side by side, so a very
        long one takes no more rounds than others.
        """
        x = with_neighbours(features, counts)
        pieces = -(-counts // CHAIN_LINES)
        size = np.full(int(pieces.sum()), CHAIN_LINES)
        size[np.cumsum(pieces) - 1] = counts - (pieces - 1) * CHAIN_LINES
        label = np.repeat(labels, pieces)
        weight = np.repeat(mass / np.maximum(counts, 1), pieces)

        def loss(theta):
            value, slope = chain_gradient(theta, x, size, label, weight)
            return value / mass.sum() + RIDGE / 2 * theta @ theta, slope / mass.sum() + RIDGE * theta

        width = x.shape[1]
        theta = least_point(loss, 2 * width + 4)
        return cls(theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2))

    def line_goodness(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Marginal probability of the good label of each line."""
        return np.exp(marginals(with_neighbours(features, counts) @ self.weights, self.step, counts)[0][:, 1])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(``id_col``, ``score``, ``lines``, ``good_lines``) for every row of ``docs``.

    A linear-chain field over the lines is fitted on all lines of a bounded
    sample of ``labels``.  ``score`` is the mean of the lines' marginals of being good,
    weighted by length in bytes plus one; ``good_lines`` counts those above a
    half.  Nulls count as the empty text, which is one empty line.  If the
    labels hold fewer than two classes, every score is the share of class 1
    (0.5 if there are none).
    """
    spark = docs.sparkSession
    chosen, counts = bounded_labels(labels, id_col, label_col, sample_rows)
    docs = docs.select(id_col, text_col)
    sample = docs.join(F.broadcast(chosen), id_col)

    def read(frames):
        for frame in frames:
            features, _, counts = line_features(frame[text_col].tolist())
            ends = np.cumsum(counts)
            kept = [features[e - c : e].astype("<f4").tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pd.DataFrame({"label": frame[label_col].astype(float), "features": kept})

    rows = sample.select(text_col, label_col).mapInPandas(read, "label double, features binary").toPandas()
    labels = rows["label"].to_numpy()
    field, share = None, labels.mean() if len(labels) else 0.5
    if len(np.unique(labels)) == 2:
        blocks = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for x in rows["features"]]
        field = LineField.fit(
            np.concatenate(blocks).astype(float), np.array(list(map(len, blocks))), labels,
            np.where(labels > 0, counts[1] / (labels > 0).sum(), counts[0] / (labels < 1).sum()),
        )
    shared = Shared(spark, (field, share))

    def prepare():
        field, share = shared.value

        def work(texts):
            features, size, counts = line_features(texts)
            good = field.line_goodness(features, counts) if field else np.full(len(size), share)
            first = np.cumsum(counts) - counts
            score = np.add.reduceat(good * (size + 1), first) / np.add.reduceat(size + 1, first)
            fine = np.add.reduceat((good > 0.5).astype(np.int64), first)
            return [*map(pa.array, (np.clip(score, 0, 1), counts, fine))]

        return work

    return map_texts(docs, [id_col], text_col, prepare, "score double, lines long, good_lines long")
