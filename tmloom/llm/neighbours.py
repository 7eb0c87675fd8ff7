"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmloom.operators.scale import materialize

DEGREE = 40
REVERSE = 100  # links into a node that meet in one group; a node with more has several groups
TABLES = 12
CHUNK = 2000
FIRST = 16  # neighbours of a node taken from one comparison of a run
ROUNDS = 8  # at most
SETTLED = 0.02  # share of new links after a round, below which the graph is done
BEAM = 48
WIDTH = 16
PLANES = 24
_ROWS = 1 << 16


def _matrix(column, dtype: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.zeros((0, 1), dtype)


def vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(``id``, ``vec``) of the rows that take part, vectors packed as bytes; and their number type.

    Rows without id, with a null, empty or zero vector, with null or non-finite
    components, or with another length than most, take no part.
    """
    element = dict(df.dtypes)[vec_col].removeprefix("array<").removesuffix(">")
    dtype = "<f4" if element == "float" else "<f8"
    x = F.col(vec_col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    good = df.where(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0))
    size = good.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = size["n"] if size else 1

    def pack(batches):
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten()).astype(dtype) + 0.0
            rows = flat.reshape(batch.num_rows, -1)
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["id", "vec"])

    chosen = good.where(F.size(x) == width).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))
    return chosen.mapInArrow(pack, "id long, vec binary"), dtype


def _heaps(batches) -> Iterator[pa.Table]:
    """Batches put together to some _ROWS rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(batches, *keys: int) -> Iterator[pa.Table]:
    """Batches of rows sorted by some columns, cut so that no values of them are in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < _ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(key).to_numpy() for key in keys]
        other = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` most similar neighbours of each node; a link known before is not new."""
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    dealt = edges.repartition("node")  # one shuffle for both steps
    distinct = dealt.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return distinct.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= degree).drop("_r")


def first_graph(nodes: DataFrame, dtype: str, tables: int, chunk: int, seed: int) -> DataFrame:
    """Neighbours among nodes on like sides of random planes.

    For each of ``tables`` sets of planes, nodes are range-partitioned by their
    sides and compared in runs of ``chunk``, so a run never grows with a dense
    region.
    """

    def sides(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dtype).astype(float)
            rng = np.random.default_rng(seed)
            for t in range(tables):
                planes = rng.standard_normal((x.shape[1], PLANES))
                code = ((x @ planes > 0) @ (1 << np.arange(PLANES)[::-1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(code), batch.column(0), batch.column(1)],
                    ["t", "code", "node", "vec"],
                )

    def compare(batches):
        for table in _heaps(batches):
            ids = table.column(0).to_numpy()
            x = _matrix(table.column(1), dtype).astype(np.float32)
            for part in np.array_split(np.arange(len(ids)), max(1, round(len(ids) / chunk))):
                k = min(FIRST, len(part) - 1)
                if k < 1:
                    continue
                sims = x[part] @ x[part].T
                sims[ids[part][:, None] == ids[part][None, :]] = -np.inf
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(sims, top, axis=1)
                fine = np.isfinite(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[part], k).reshape(-1, k)[fine]), pa.array(ids[part][top][fine]),
                     pa.array(value[fine].astype(float)), pa.array(np.ones(fine.sum(), bool))],
                    ["node", "nbr", "sim", "new"],
                )

    coded = nodes.mapInArrow(sides, "t int, code long, node long, vec binary")
    dealt = coded.repartitionByRange("t", "code", "node").sortWithinPartitions("t", "code", "node")
    return dealt.select("node", "vec").mapInArrow(compare, "node long, nbr long, sim double, new boolean")


def _small(nodes: DataFrame, dtype: str) -> DataFrame:
    """Vectors with components as bytes and one scale, for choosing candidates."""

    def shrink(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dtype).astype(np.float32)
            scale = np.abs(x).max(axis=1, keepdims=True) / 127
            packed = np.concatenate(
                [scale.astype("<f4").view(np.uint8), np.rint(x / scale).astype(np.int8).view(np.uint8)], axis=1
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["node", "small"]
            )

    return nodes.mapInArrow(shrink, "node long, small binary")


def _unpack(column) -> np.ndarray:
    raw = _matrix(column, "u1")
    return np.ascontiguousarray(raw[:, 4:]).view(np.int8) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def descend(edges: DataFrame, small: DataFrame, degree: int, reverse: int, turn: int = 0) -> DataFrame:
    """One round of NN-descent: neighbours of a node, out and in, are offered to each other.

    Pairs that were both there the round before have met already and are left
    out.  An offer is kept if it beats the worst neighbour a node has.

    A node with more than ``reverse`` links into it deals them to groups of
    about that many, by a hash that differs from ``turn`` to ``turn``.  Each
    group meets all of the node's links out, so every link takes part in every
    round.  Links of one group meet whether new or not, as they may have been in
    different groups until now.
    """
    hubs = (
        edges.groupBy(F.col("nbr").alias("mid")).count().where(F.col("count") > reverse)
        .select("mid", F.ceil(F.col("count") / reverse).cast("int").alias("groups"))
    )
    hubs = materialize(hubs, "hubs")
    dealt = F.pmod(F.xxhash64("mid", "node", F.lit(turn)), F.col("groups")).cast("int")
    into = (
        edges.select(F.col("nbr").alias("mid"), "node", "new").join(hubs, "mid", "left")
        .select("mid", F.coalesce(dealt, F.lit(0)).alias("part"), "node", "new",
                F.lit(False).alias("out"), F.col("groups").isNotNull().alias("hub"))
    )
    out = (
        edges.select(F.col("node").alias("mid"), F.col("nbr").alias("node"), "new").join(hubs, "mid", "left")
        .select("mid", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)).alias("part"), "node", "new",
                F.lit(True).alias("out"), F.col("groups").isNotNull().alias("hub"))
    )
    meet = out.unionByName(into).groupBy("mid", "part", "node").agg(
        F.max("new").alias("new"), F.max("out").alias("out"), F.max("hub").alias("hub")
    )
    worst = edges.groupBy("node").agg(
        F.when(F.count(F.lit(1)) >= degree, F.min("sim")).otherwise(float("-inf")).alias("worst")
    )
    offered = (
        meet.join(small.join(worst, "node"), "node")
        .repartition("mid", "part").sortWithinPartitions("mid", "part")
        .select("mid", "part", "node", "worst", "new", "out", "hub", "small")
    )

    def join(batches):
        for table in _runs(batches, 0, 1):
            mid, group, ids, floor, new, out, hub = (table.column(k).to_numpy() for k in range(7))
            x = _unpack(table.column(7))
            change = (mid[1:] != mid[:-1]) | (group[1:] != group[:-1])
            starts = np.append(np.flatnonzero(np.append(True, change)), len(mid))
            left, right, value = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                fresh = new[a:b]
                if not hub[a] and not fresh.any():
                    continue
                meets = fresh[:, None] | fresh
                if hub[a]:
                    ins = ~out[a:b]
                    meets |= ins[:, None] & ins
                sims = x[a:b] @ x[a:b].T
                better = (sims > floor[a:b, None]) & meets
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                left.append(ids[a + i])
                right.append(ids[a + j])
                value.append(sims[i, j])
            if left:
                sims = np.concatenate(value).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(left)), pa.array(np.concatenate(right)), pa.array(sims),
                     pa.array(np.ones(len(sims), bool))],
                    ["node", "nbr", "sim", "new"],
                )

    offers = offered.mapInArrow(join, "node long, nbr long, sim double, new boolean")
    return _best(edges.withColumn("new", F.lit(False)).unionByName(offers), degree)


def build_graph(
    nodes: DataFrame, dtype: str, degree: int = DEGREE, rounds: int = ROUNDS, tables: int = TABLES, seed: int = 7
) -> DataFrame:
    """(``node``, ``nbr``, ``sim``): about the ``degree`` nearest of every node, by inner product.

    ``nodes`` holds (``node``, ``vec``) with distinct vectors.  A graph from
    random planes is bettered by joins of neighbours of neighbours, until few
    links of a round are new, or ``rounds`` are done.  Larger tables need more
    rounds.
    """
    edges = materialize(_best(first_graph(nodes, dtype, tables, CHUNK, seed), degree), "graph")
    small = materialize(_small(nodes, dtype), "small")
    for turn in range(rounds):
        edges = materialize(descend(edges, small, degree, REVERSE, turn), "graph")
        fresh = edges.agg(F.avg(F.col("new").cast("int"))).first()[0]
        if fresh is None or fresh < SETTLED:
            break
    return edges


def greedy_search(
    queries: DataFrame, nodes: DataFrame, edges: DataFrame, dtype: str, entries: DataFrame,
    beam: int = BEAM, width: int = WIDTH,
) -> DataFrame:
    """(``query``, ``node``, ``score``): the ``beam`` nearest nodes found for each query.

    ``queries`` holds (``query``, ``vec``), ``entries`` (``query``, ``node``)
    where each starts.  Every round opens the ``width`` nearest nodes of a beam
    not yet opened and meets all their neighbours, out and in, until no beam
    holds an unopened node.  Queries whose beam is settled take no part in
    further rounds.  A beam only gets nearer, so a node that left it never comes
    back and the rounds end.  Scores are inner products in double precision.
    """
    links = edges.select("node", "nbr").unionByName(
        edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))
    ).distinct()
    links = materialize(links, "links")

    def score(pairs: DataFrame) -> DataFrame:
        def dot(batches):
            for batch in batches:
                a, b = (_matrix(batch.column(k), dtype).astype(np.float64) for k in (2, 3))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", a, b)),
                     pa.array(np.zeros(batch.num_rows, bool))],
                    ["query", "node", "score", "opened"],
                )

        met = pairs.join(nodes, "node").join(queries.withColumnRenamed("vec", "asked"), "query")
        return met.select("query", "node", "vec", "asked").mapInArrow(
            dot, "query long, node long, score double, opened boolean"
        )

    near = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    whole = Window.partitionBy("query")

    def beams(rows: DataFrame) -> DataFrame:
        """The best rows of each query, and whether any of them is to be opened."""
        best = rows.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= beam).drop("_r")
        return materialize(best.withColumn("open", F.max(~F.col("opened")).over(whole)), "beam")

    state, turn = beams(score(entries.distinct())), 0
    settled = []
    while True:
        settled.append(state.where("not open").select("query", "node", "score"))
        state = state.where("open").drop("open")
        if state.isEmpty():
            break
        chosen = state.where("not opened").withColumn("_r", F.row_number().over(near))
        chosen = chosen.where(F.col("_r") <= (1 if turn == 0 else width)).select("query", "node")
        met = chosen.join(links, "node").select("query", F.col("nbr").alias("node")).distinct()
        fresh = score(met.join(state.select("query", "node"), ["query", "node"], "left_anti"))
        opened = state.join(chosen.withColumn("_now", F.lit(True)), ["query", "node"], "left").select(
            "query", "node", "score", (F.col("opened") | F.coalesce("_now", F.lit(False))).alias("opened")
        )
        state, turn = beams(opened.unionByName(fresh)), turn + 1
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    return found


def nearest(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20
) -> DataFrame:
    """(``query_id``, ``rank``, id, ``score``): ``k`` nearest rows found for each row of ``queries``.

    ``queries`` are rows of ``df``; a row is no candidate of its own.  Nearness
    is the inner product.  Equal vectors are one node of the graph, so copies
    neither crowd out neighbours nor multiply work; the ``k`` + 1 smallest ids
    of a node stand for it.  A query starts at its own node.  Queries whose
    vector takes no part have no rows.
    """
    rows, dtype = vectors(df, id_col, vec_col)
    rows = materialize(rows, "vectors")
    nodes = materialize(rows.groupBy("vec").agg(F.min("id").alias("node")).select("node", "vec"), "nodes")
    member = rows.join(nodes, "vec").select("id", "node")
    member = materialize(member, "members")
    asked = queries.select(F.col(id_col).cast("long").alias("query")).distinct()
    entries = asked.join(member, F.col("query") == F.col("id")).select("query", "node").distinct()
    entries = materialize(entries, "entries")
    # Queries with one vector ask once, in the name of their node.
    starts = entries.select(F.col("node").alias("query"), "node").distinct()
    vecs = starts.join(nodes, "node").select("query", "vec")
    edges = build_graph(nodes, dtype, max(DEGREE, k + 4))
    found = greedy_search(vecs, nodes, edges, dtype, starts, max(BEAM, 2 * k))
    first = Window.partitionBy("node").orderBy("id")
    stand = member.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    answers = (
        found.withColumnRenamed("query", "asked").join(stand, "node")
        .withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
        .select("asked", "id", "score")
    )
    return (
        entries.select(F.col("query").alias("query_id"), F.col("node").alias("asked"))
        .join(answers, "asked").where("id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
