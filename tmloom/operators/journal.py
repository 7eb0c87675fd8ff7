"""A journal of model answers, written call by call, so that no answered call is sent twice.

A task appends each answer, under a key of the request, its payload and the
number of the attempt, to a file of its own below its partition's folder, in any
place that Arrow's file systems reach.  A task that runs again reads what earlier
runs of its partition left there.  A job that runs again reads the whole journal
as a table.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROTATE = 64  # answers in one file; where only closed files are seen, so many can be lost
ANSWER = "status_code int, retry_after string, body string, error_message string, elapsed_seconds double"


def request_key(id_col: str, payload: list[str]) -> Column:
    """Requests with other contents are other requests, whatever their id."""
    return F.sha2(F.to_json(F.struct(id_col, *payload), {"ignoreNullFields": "false"}), 256)


def attempt_path(journal: str, attempt: int) -> str:
    return f"{journal.rstrip('/')}/attempt={attempt}"


def answered(spark: SparkSession, journal: str, attempt: int) -> DataFrame | None:
    """(``_key``, the answer) of all calls of an attempt so far; None if there are none."""
    files, path = fs.FileSystem.from_uri(_uri(attempt_path(journal, attempt)))
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return None
    # the last line of a task that was killed may be cut short; it has no key then
    rows = spark.read.schema(f"_key string, {ANSWER}").option("recursiveFileLookup", True).json(attempt_path(journal, attempt))
    return rows.where(F.col("_key").isNotNull()).dropDuplicates(["_key"])


def _uri(path: str) -> str:
    return path if ":/" in path else f"file://{path}"


class Journal:
    """The journal as one task sees it; ``record`` may be called by several threads."""

    def __init__(self, journal: str, attempt: int, partition: int):
        self._files, self._folder = fs.FileSystem.from_uri(_uri(f"{attempt_path(journal, attempt)}/{partition:06d}"))
        self._files.create_dir(self._folder, recursive=True)
        self._lock, self._stream, self._written = threading.Lock(), None, 0
        self.known: dict[str, dict] = {}
        for info in self._files.get_file_info(fs.FileSelector(self._folder)):
            with self._files.open_input_stream(info.path) as stream:
                for line in stream.read().split(b"\n"):
                    try:
                        row = json.loads(line)
                    except ValueError:
                        continue  # empty, or cut short
                    self.known[row.pop("_key")] = row

    def record(self, key: str, answer: dict) -> None:
        with self._lock:
            if self._stream is None:
                self._stream = self._files.open_output_stream(f"{self._folder}/{uuid.uuid4().hex}.json")
            self._stream.write(json.dumps({"_key": key, **answer}).encode() + b"\n")
            self._stream.flush()
            self._written += 1
            if self._written % ROTATE == 0:
                self.close()

    def close(self) -> None:
        if self._stream is not None:
            self._stream.close()
            self._stream = None
