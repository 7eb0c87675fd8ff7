"""String similarity: the one scalar that needs Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tmloom.functions.text import ColumnOrName, as_col


_REMEMBERED = 200_000  # pairs a task keeps before it starts afresh


@F.pandas_udf(DoubleType())
def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Repeated pairs of a task are compared once; a run of equal second texts
    is indexed once."""
    matcher, indexed, known = SequenceMatcher(None), None, {}
    for a, b in batches:
        out = []
        if len(known) > _REMEMBERED:
            known = {}
        for pair in zip(a, b):
            if pair not in known:
                x, y = pair
                if x is None or y is None:
                    known[pair] = None
                else:
                    if y != indexed:
                        matcher.set_seq2(y)
                        indexed = y
                    matcher.set_seq1(x)
                    known[pair] = matcher.ratio()
            out.append(known[pair])
        yield pd.Series(out, dtype="float64")


# A filter on the ratio would otherwise be copied below the joins and groupings
# that shrink its input, and the ratio computed twice.
_pinned_ratios = _ratios.asNondeterministic()


def similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Matching-block ratio 2M/T; the order of the two arguments matters."""
    return _pinned_ratios(as_col(a), as_col(b))


def similarity_bound(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Exact upper bound of ``similarity`` from the two lengths alone, JVM-side."""
    la, lb = F.length(as_col(a)), F.length(as_col(b))
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(F.least(la, lb) * 2.0 / (la + lb))


_SHORT = 256  # longer texts share most of their letters anyway


def _numbered_letters(c: Column) -> Column:
    """The letters of a text, repeats told apart by a number: a set in place of a multiset.

    The sorted letters are bound to a name by a list of one, so that they are
    worked out once and not for every letter.
    """
    numbered = lambda letters: F.transform(
        letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x)).cast("string"))
    )
    return F.transform(F.array(F.sort_array(F.split(c, ""))), numbered)[0]


def letters_bound(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Exact upper bound of ``similarity`` from the letters both texts have, JVM-side; 1 for long texts."""
    a, b = as_col(a), as_col(b)
    total = F.length(a) + F.length(b)
    shared = F.size(F.array_intersect(_numbered_letters(a), _numbered_letters(b)))
    return F.when((total == 0) | (F.greatest(F.length(a), F.length(b)) > _SHORT), F.lit(1.0)).otherwise(
        shared * 2.0 / total
    )
