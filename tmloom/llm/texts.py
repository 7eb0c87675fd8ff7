"""Whole texts through a Python function, a few million characters at a time."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_CHARS = 4_000_000


_ASSIGNED = (*range(0x40000), *range(0xE0000, 0xE0200))  # planes with letters or marks
_PLAIN = re.compile(r"[^\W\d_]+")


def _ranges(kinds: str, among=_ASSIGNED) -> str:
    points = [p for p in among if unicodedata.category(chr(p)) in kinds.split()]
    runs = [[p for _, p in run] for _, run in groupby(enumerate(points), lambda x: x[1] - x[0])]
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


@cache
def _word_patterns() -> tuple[re.Pattern, re.Pattern]:
    """A number sign, combining mark or rare character; and a letter with the letters and marks after it."""
    letters, marks = _ranges("Lu Ll Lt Lm Lo"), _ranges("Mn Mc Me")
    odd = f"[{_ranges('Mn Mc Me Nl No', range(0x10000))}\U00010000-\U0010ffff]"
    return re.compile(odd), re.compile(f"[{letters}][{letters}{marks}]*")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and combining marks that begin with a letter, in lower case.

    The word class of ``re`` takes number signs for letters and leaves marks
    out; texts that hold neither, most of them, go by it, as it is the faster.
    """
    lowered = (text or "").lower()
    if lowered.isascii():
        return _PLAIN.findall(lowered)
    odd, word = _word_patterns()
    return (word if odd.search(lowered) else _PLAIN).findall(lowered)


class Shared:
    """A value broadcast to the executors; its classes travel with it, so they need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return cloudpickle.loads(self._packed.value)


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    text_col: str,
    prepare: Callable[[], Callable[[list], Sequence]],
    fields: str,
    slice_chars: int = SLICE_CHARS,
) -> DataFrame:
    """The columns ``keep`` unchanged, and what the function of ``prepare`` makes of the texts.

    ``prepare`` runs once in each task and returns a function from a list of
    texts (None for null) to Arrow arrays, one for each of ``fields``.  A call
    gets texts of some ``slice_chars`` characters, a longer text alone.  A kept
    column named like one of ``fields`` gives way to it.
    """
    made_fields = StructType.fromDDL(fields).fields
    taken = {f.name.lower() for f in made_fields}
    keep = [c for c in keep if c.lower() not in taken]
    schema = StructType([*[df.schema[c] for c in keep], *made_fields])
    names = [*keep, *[f.name for f in made_fields]]
    wide = len(keep)

    def run(batches):
        work = prepare()
        for batch in batches:
            texts = batch.column(wide).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < slice_chars):
                    chars += len(texts[end] or "")
                    end += 1
                made = list(work(texts[at:end]))
                arrays = [batch.column(k).slice(at, end - at) for k in range(wide)] + made
                yield pa.RecordBatch.from_arrays(arrays, names)
                at = end

    own = "_text"
    while own in keep:
        own += "_"
    selected = df.select(*keep, F.col(text_col).cast("string").alias(own))
    return selected.mapInArrow(run, schema)
