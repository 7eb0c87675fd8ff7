"""Words of running Han text: a dictionary learned from a corpus, and the best path through each text.

``learn_words`` counts on Spark; ``DictionarySegmenter`` takes the place of
``functions.text.tokens`` wherever an operator takes a segmenter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmloom.functions.text import ColumnOrName, as_col
from tmloom.operators.scale import materialize

_HAN = r"\x{4e00}-\x{9fff}"
_PIECE = re.compile("[一-鿿]+|[A-Za-z0-9]{2,}")
COST_UNIT = 1000  # costs are whole thousandths of a nat, so sums and ties are exact
MOST_WORDS = 500_000  # of a dictionary that goes to every task
REMEMBERED = 200_000  # runs a task keeps before it starts afresh


def learn_words(
    texts: DataFrame, text_col: str = "text", longest: int = 4, least: int = 5, cohesion: int = 20
) -> DataFrame:
    """(word, n, cost): single Han characters, and longer stretches that hold together.

    A stretch of at most ``longest`` characters is a word if it occurs ``least``
    times, and ``cohesion`` times as often as chance would bring together the
    two parts of any cut through it.  ``cost`` is the negative logarithm of its
    share of all characters, in thousandths.  Counts are whole numbers, added up
    before the shuffle.
    """
    # a look-ahead matches at every character once, so a long run costs no more than many short ones
    of_size = [
        F.regexp_extract_all(as_col(text_col), F.lit(f"(?=([{_HAN}]{{{n}}}))"), F.lit(1)) for n in range(1, longest + 1)
    ]
    grams = texts.select(F.explode(F.concat(*of_size)).alias("word"))
    counts = materialize(grams.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "grams")
    total = counts.where(F.length("word") == 1).agg(F.sum("n")).first()[0] or 0
    often = counts.where((F.length("word") > 1) & (F.col("n") >= least))
    cuts = often.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")).select(
        "word", "n", F.expr("substring(word, 1, at)").alias("left"), F.expr("substring(word, at + 1)").alias("right")
    )
    left = counts.select(F.col("word").alias("left"), F.col("n").alias("nl"))
    right = counts.select(F.col("word").alias("right"), F.col("n").alias("nr"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    held = whole("n") * F.lit(total).cast("decimal(19,0)") >= cohesion * whole("nl") * whole("nr")
    words = (
        cuts.join(left, "left").join(right, "right").groupBy("word")
        .agg(F.max("n").alias("n"), F.min(held.cast("int")).alias("held")).where("held = 1").select("word", "n")
    )
    every = counts.where(F.length("word") == 1).unionByName(words)
    cost = F.round(COST_UNIT * F.log(F.lit(float(max(total, 1))) / F.col("n"))).cast("int")
    return every.select("word", "n", cost.alias("cost"))


def best_path(run: str, costs: Mapping[str, int], longest: int, unknown: int) -> list[str]:
    """The cheapest cut of ``run`` into words; of equal ones, the first word as long as can be, and so on.

    A character that is no word costs ``unknown``.
    """
    n = len(run)
    best, take = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        options = []
        for size in range(1, min(longest, n - i) + 1):
            cost = costs.get(run[i : i + size], unknown if size == 1 else None)
            if cost is not None:
                options.append((cost + best[i + size], -size))
        best[i], size = min(options)
        take[i] = -size
    out, i = [], 0
    while i < n:
        out.append(run[i : i + take[i]])
        i += take[i]
    return out


class DictionarySegmenter:
    """A segmenter over a dictionary of (word, cost): words of two or more characters, in order, repeats kept.

    Han runs are cut along the cheapest path; Latin and digit runs stand as
    they are.  The dictionary goes to every task, so it holds ``MOST_WORDS`` at
    most.
    """

    def __init__(self, costs: Mapping[str, int]):
        if len(costs) > MOST_WORDS:
            raise ValueError(f"{len(costs)} words are more than {MOST_WORDS}: raise least or cohesion")
        costs = dict(costs)
        longest = max(map(len, costs), default=1)
        unknown = max(costs.values(), default=0) + COST_UNIT

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, list[str]] = {}

            def words(text: str | None) -> list[str] | None:
                if text is None:
                    return None
                out: list[str] = []
                for piece in _PIECE.findall(text):
                    if piece[0] < "一":
                        out.append(piece)
                        continue
                    if piece not in known:
                        known[piece] = [w for w in best_path(piece, costs, longest, unknown) if len(w) > 1]
                    out += known[piece]
                return out

            for batch in batches:
                if len(known) > REMEMBERED:
                    known.clear()
                yield batch.map(words)

        self._cut = cut

    @classmethod
    def from_words(cls, words: DataFrame) -> DictionarySegmenter:
        """Of a table (word, cost), ``learn_words`` say."""
        rows = words.select("word", "cost").limit(MOST_WORDS + 1).collect()
        return cls({r["word"]: r["cost"] for r in rows})

    def __call__(self, text: ColumnOrName) -> Column:
        return self._cut(as_col(text))
