"""Keyed logs that stay cheap to read: sorted, bucketed runs, merged level by level.

Each batch writes one run.  When a level holds ``fan`` runs they become one run
of the next level, in which ``merge`` keeps what later reads need (the latest row
of a key, the last postings of a token).  So a row is rewritten once for each
level, and at most ``fan`` runs of each of few levels are read, whatever the
number of batches.  Runs are folders named by their level and the batches they
cover; one counts when Spark has marked it complete, and a merged run hides
those it covers.  Reading for given keys touches their buckets only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"L(\d+)-(\d+)-(\d+)$")
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Run:
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"L{self.level}-{self.first:012d}-{self.last:012d}"

    def covers(self, other: Run) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last and self.level > other.level


@dataclass(frozen=True)
class LevelTable:
    """A table of ``schema`` under ``path``, found by ``keys``.

    ``merge`` maps rows of several runs to the rows that replace them; it must
    give the same when its result is merged again.  Batch numbers grow, and one
    writer works at a time.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str]
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = 64
    fan: int = 4

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def runs(self) -> list[Run]:
        """All complete runs, those that a merged one covers too."""
        files, path = self._files()
        if not files.exists(path):
            return []
        found = []
        for status in files.listStatus(path):
            match = _NAME.search(status.getPath().getName())
            done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if match and files.exists(done):
                found.append(Run(*map(int, match.groups())))
        return sorted(found, key=lambda r: (r.first, r.level))

    def live(self, before: int | None = None) -> list[Run]:
        """The runs to read: of batches below ``before``, not covered by a merged one."""
        runs = [r for r in self.runs() if before is None or r.last < before]
        return [r for r in runs if not any(o.covers(r) for o in runs)]

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, runs: Sequence[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], f"{self.schema}, {_BUCKET} int")
        each = [
            self.spark.read.schema(f"{self.schema}, {_BUCKET} int").parquet(f"{self.path}/{r.name}") for r in runs
        ]
        return reduce(DataFrame.unionByName, each)

    def read(self, wanted: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The rows of batches below ``before``; with ``wanted`` (rows of keys) of these keys only.

        The buckets of the wanted keys, at most ``buckets`` numbers, prune the
        scan; the keys themselves follow by a semi join.
        """
        rows = self._read(self.live(before))
        if wanted is None:
            return rows.drop(_BUCKET)
        keys = wanted.select(*self.keys).distinct()
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        return rows.where(F.col(_BUCKET).isin(touched)).drop(_BUCKET).join(keys, list(self.keys), "left_semi")

    def _write(self, df: DataFrame, run: Run) -> None:
        placed = df.withColumn(_BUCKET, self._bucket())
        (
            placed.repartition(_BUCKET)
            .sortWithinPartitions(_BUCKET, *self.keys)
            .write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/{run.name}")
        )

    def append(self, df: DataFrame, batch: int) -> None:
        """Write the run of one batch; a repeated batch replaces its own."""
        self._write(df, Run(0, batch, batch))

    def compact(self, before: int) -> int:
        """Merge full levels of batches below ``before`` and drop what earlier merges cover; returns merges made.

        Called at the start of a batch: then all earlier ones are committed and
        nothing reads the covered runs any more.
        """
        files, path = self._files()
        runs = self.runs()
        for r in runs:
            if any(o.covers(r) for o in runs):
                files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, r.name), True)
        merges, level = 0, 0
        while True:
            here = [r for r in self.live(before) if r.level == level]
            if not here and not any(r.level > level for r in self.live(before)):
                return merges
            if len(here) >= self.fan:
                merged = Run(level + 1, here[0].first, here[-1].last)
                self._write(self.merge(self._read(here).drop(_BUCKET)), merged)
                merges += 1
            level += 1
