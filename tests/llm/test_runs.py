"""Periodic runs against comparing every word with every later one."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tmloom.llm.queries import ORACLES, QUERIES
from tmloom.llm.runs import Octave, periodic_runs, stitched, tile_fragments, z_function


def all_runs(words, repeats=4, least=6):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def looping(rng, n):
    out = []
    while len(out) < n:
        base = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 30, 40]))]
        out += base * rng.choice([1, 2, 3, 4, 4, 5, 9])
        out += base[: rng.randrange(len(base) + 1)]
    return out[:n]


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert z_function(s)[1:] == want[1:]


@pytest.mark.parametrize("repeats", [3, 4, 6])
def test_tiles_hold_every_run(repeats):
    rng = random.Random(repeats)
    for size in [0, 1, 5, 6, 7, 40, 200, 900] * 6:
        words = looping(rng, size)
        got = []
        for k in range(12):
            octave = Octave(k, repeats, 6)
            got += tile_fragments(np.array([ord(w) for w in words], np.int32), octave)
        assert sorted((a, b - a + q, q) for q, a, b in got) == all_runs(words, repeats)


def test_fragments_meet():
    assert stitched([(2, 5, 9), (2, 0, 5), (3, 4, 6), (2, 10, 12)]) == [(2, 0, 9), (2, 10, 12), (3, 4, 6)]


@pytest.mark.parametrize("tile", [64, 8192])
def test_runs_of_texts(spark, tile):
    rng = random.Random(tile)
    texts = [" ".join(looping(rng, rng.choice([0, 3, 50, 400, 2000]))) for _ in range(40)]
    texts += [None, "", " \n", "a " * 5, "a " * 6, "\ta b\x0ba\x0cb a\rb a b ", "w " * 30_000, "x y z " * 9_000 + "x"]
    texts += [" ".join(rng.choice(["the", "of", "a"]) for _ in range(3000)), texts[3], texts[3]]
    rows = [(k if k != 7 else None, t) for k, t in enumerate(texts)] + [(3, "other of one id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", F.lit("own").alias("_row"), F.lit(1).alias("runs"), F.lit(2).alias("_id"), F.lit(3).alias("words")
    )
    got = periodic_runs(df, tile_words=tile).collect()
    want = []
    for k, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = all_runs(words) if len(set(words)) > 1 or len(words) < 9 else [(0, len(words), 1)]
        if words[:3] == ["x", "y", "z"]:
            runs = [(0, len(words), 3)]
        want.append((k, len(words), runs, collapsed(words, runs)))
    have = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    digests = periodic_runs(df, digest=True, tile_words=tile).collect()
    assert sorted(r.collapsed for r in digests) == sorted(hashlib.sha256(w[3].encode()).hexdigest() for w in want)
    assert periodic_runs(df.limit(0)).count() == 0


def test_the_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(looping(rng, rng.choice([0, 1, 7, 60, 300])))) for k in range(150)] + [(None, "a " * 7), (151, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(k).encode()) if k is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        r = got[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(ORACLES["op13_periodic_runs"]).fetchall(), key=repr) == sorted(map(tuple, got.values()), key=repr)
    assert got[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
