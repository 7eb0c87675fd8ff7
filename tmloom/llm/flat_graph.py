"""Near-duplicate vectors of one label: pruned graphs on overlapping shards, range search, verified links."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmloom.llm.graph import components
from tmloom.operators.scale import materialize

LEAST_COSINE = 0.93
SHARD_NODES = 1024  # aimed at
MOST_NODES = 4096  # in one task; larger shards are split, dense ones dealt to pairs of blocks
MOST_CENTRES = 64  # of one split
OVERLAP = 2  # nearest centres that a vector goes to, at each split
ROWS_OF_A_SALT = 1 << 16  # vectors of a shard that one task assigns
DENSE = 0.5  # share of a shard that, gathered at one centre, no split parts
DEGREE = 24
LISTED = 64  # nearest that pruning chooses from
ALPHA = 1.2
BEAM = 32
MEDOIDS = 4
SLACK = 0.05  # below the least cosine, within which the range is still expanded
AUDITED = 256  # vectors of the audit, at most
LEAST_RECALL = 0.99
TRIES = 3


def _valid(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors of a label made one node, and the node of each row that has one.

    Copies are counted before the shuffle.  Nodes are (``node``, ``site``,
    ``vector``, ``copies``, ``least``); a site is a label and a vector length.
    """
    marked = rows.where(_valid(F.col("vector")) & F.col("label").isNotNull()).select(
        "row", "id", F.concat_ws(":", F.col("label").cast("string"), F.size("vector")).alias("site"), "vector",
        F.sha2(F.col("vector").cast("string").cast("binary"), 256).alias("sha"),
    )
    nodes = materialize(
        marked.groupBy("site", "sha")
        .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    member = marked.select("row", "site", "sha").join(nodes.select("site", "sha", "node"), ["site", "sha"])
    return nodes.drop("sha"), member.select("row", "node")


def _apart(centres: np.ndarray, least: float) -> np.ndarray:
    """Those centres that are not linked to an earlier one."""
    sims, kept = centres @ centres.T, []
    for k in range(len(centres)):
        if not (sims[k, kept] >= least).any():
            kept.append(k)
    return centres[kept]


def _assigned(members: DataFrame, sizes: DataFrame, least: float, overlap: int, seed: int) -> DataFrame:
    """(``shard``, ``centre``, ``node``): the ``overlap`` nearest of a shard's centres for each of its vectors.

    A shard's centres are vectors of its own, chosen by a hash, no two of them
    linked: so a group of near copies gathers at one centre.  A large shard is
    dealt to several tasks, each of which gets its centres first and then its
    vectors, as one sorted stream.
    """
    wanted = sizes.withColumn(
        "centres", F.least(F.lit(MOST_CENTRES), F.ceil(overlap * F.col("n") / SHARD_NODES)).cast("int")
    ).withColumn("salts", F.ceil(F.col("n") / ROWS_OF_A_SALT).cast("int"))
    sized = members.join(wanted, "shard")
    first = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "node"), "node")
    centres = (
        sized.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= MOST_CENTRES)
        .where("rank <= centres")
    )
    stream = centres.select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"),
        F.col("rank").cast("long").alias("node"), "vector",
    ).unionByName(
        sized.select(
            "shard", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"),
            "node", "vector",
        )
    )
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stream.repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "node")

    def run(batches):
        key, found, centres = None, [], None
        for batch in batches:
            shard, salt, kind = (batch.column(k).to_pylist() for k in range(3))
            node = batch.column(3).to_numpy()
            flat, offsets = batch.column(4).flatten().to_numpy(), batch.column(4).offsets.to_numpy()
            offsets = offsets - offsets[0]
            n = len(shard)
            cuts = [i for i in range(n) if i == 0 or (shard[i], salt[i], kind[i]) != (shard[i - 1], salt[i - 1], kind[i - 1])]
            out = ([], [], [])
            for a, b in zip(cuts, [*cuts[1:], n], strict=True):
                vectors = flat[offsets[a] : offsets[b]].reshape(b - a, -1)
                vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                if kind[a] == 0:
                    found = [*found, vectors] if key == (shard[a], salt[a]) else [vectors]
                    key, centres = (shard[a], salt[a]), None
                    continue
                if centres is None:
                    centres = _apart(np.concatenate(found), least)
                sims = vectors @ centres.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                out[0].append(np.full(near.size, shard[a]))
                out[1].append(near.ravel())
                out[2].append(np.repeat(node[a:b], near.shape[1]))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["shard", "centre", "node"]
                )

    return dealt.mapInArrow(run, "shard long, centre long, node long")


def shards(nodes: DataFrame, least: float, overlap: int, seed: int = 0) -> DataFrame:
    """(``task``, ``shard``, ``a``, ``b``, ``block``, ``node``): vectors in overlapping shards of at most ``MOST_NODES``.

    A site is a shard.  Shards above the limit are split at centres, each vector
    going to its ``overlap`` nearest, until none is above.  A shard of which one
    centre gathers more than DENSE is a dense group that no split parts: its
    vectors are dealt to blocks, and every pair of blocks (``a``, ``b``) is a
    task.  The tables that tell shards apart hold a row for each shard.
    """
    key = lambda *parts: F.xxhash64(*parts)
    current = materialize(nodes.select(key("site").alias("shard"), "node", "vector"), "shards")
    leaves, level = [], 0
    while True:
        sizes = materialize(current.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "sizes")
        small = sizes.where(F.col("n") <= MOST_NODES).select("shard")
        leaves.append(current.join(small, "shard").select("shard", "node", F.lit(1).alias("blocks")))
        large = sizes.where(F.col("n") > MOST_NODES)
        if large.isEmpty():
            break
        open_ = current.join(large.select("shard"), "shard", "left_semi")
        level += 1
        dealt = materialize(_assigned(open_, large, least, overlap, seed + level), "dealt")
        gathered = dealt.groupBy("shard", "centre").agg(F.count(F.lit(1)).alias("m"))
        judged = materialize(
            gathered.join(large, "shard").withColumn(
                "dense", (F.col("m") > MOST_NODES) & (F.col("m") > DENSE * F.col("n"))
            ), "judged",
        )
        named = dealt.join(judged, ["shard", "centre"]).select(
            key("shard", "centre", F.lit(level)).alias("shard"), "node", "m", "dense"
        )
        blocks = F.ceil(2 * F.col("m") / MOST_NODES).cast("int")
        leaves.append(named.where("dense").select("shard", "node", blocks.alias("blocks")))
        rest = named.where("not dense").select("shard", "node")
        current = materialize(rest.join(nodes.select("node", "vector"), "node").select("shard", "node", "vector"), "shards")
    every = leaves[0]
    for part in leaves[1:]:
        every = every.unionByName(part)
    block = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    paired = every.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = paired.select(
        "shard", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node"
    )
    return pair.select(key("shard", "a", "b").alias("task"), "*")


def pruned(unit: np.ndarray, degree: int = DEGREE, listed: int = LISTED, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: each vector's out-links (n, degree), -1 where there are fewer.

    From the nearest ``listed`` the nearest is kept, and all go that are
    ``alpha`` times nearer to it than to the vector itself; and so on.
    """
    n = len(unit)
    listed = min(listed, n - 1)
    links = np.full((n, degree), -1)
    if listed < 1:
        return links
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    near = np.argpartition(-sims, listed - 1, axis=1)[:, :listed]
    order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    far = np.arccos(np.clip(np.take_along_axis(sims, near, 1), -1, 1))
    alive = np.ones(near.shape, bool)
    rows = np.arange(n)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        chosen = near[rows, at]
        links[some, k] = chosen[some]
        between = np.arccos(np.clip(sims[chosen[:, None], near], -1, 1))
        alive &= alpha * between > far
        alive[rows, at] = False
    return links


def range_search(unit: np.ndarray, links: list[np.ndarray], entries: np.ndarray, least: float, beam: int) -> np.ndarray:
    """For every vector, which others a greedy search over ``links`` finds within the range (n x n booleans).

    All searches go side by side.  Each starts at ``entries`` and opens the
    nearest unopened node of its ``beam`` nearest until there is none; then its
    own node and all nodes found in the range are opened, and what they lead to
    in the range, until the range holds nothing unopened.
    """
    n = len(unit)
    width = max(map(len, links), default=0)
    table = np.full((n, max(width, 1)), -1)
    for k, x in enumerate(links):
        table[k, : len(x)] = x
    sims = np.full((n, n), -2.0, np.float32)
    opened = np.zeros((n, n), bool)
    sims[:, entries] = unit @ unit[entries].T

    def open_pairs(q, v):
        opened[q, v] = True
        step = max(1, (1 << 22) // (table.shape[1] * unit.shape[1]))
        for s in range(0, len(q), step):
            to = table[v[s : s + step]]
            who = np.repeat(q[s : s + step], to.shape[1])
            to = to.ravel()
            fresh = to >= 0
            who, to = who[fresh], to[fresh]
            fresh = sims[who, to] < -1.5
            who, to = who[fresh], to[fresh]
            sims[who, to] = np.einsum("ij,ij->i", unit[who], unit[to])

    active = np.arange(n)
    while len(active):
        known = np.where(opened[active], -2.0, sims[active])
        best = known.argmax(axis=1)
        value = known[np.arange(len(active)), best]
        if n > beam:
            bar = np.partition(sims[active], n - beam, axis=1)[:, n - beam]
        else:
            bar = np.full(len(active), -1.5)
        go = (value > -1.5) & (value >= bar)
        active, best = active[go], best[go]
        open_pairs(active, best)
    sims[np.arange(n), np.arange(n)] = 1
    while True:
        q, v = np.nonzero((sims >= least - SLACK) & ~opened)
        if not len(q):
            return sims >= least - 1e-5
        open_pairs(q, v)


def _medoids(unit: np.ndarray) -> np.ndarray:
    """The vector nearest to the mean, and those nearest to the means of what lies about the farthest ones."""
    out = [int((unit @ unit.mean(axis=0)).argmax())]
    nearest = unit @ unit[out[0]]
    while len(out) < min(MEDOIDS, len(unit)):
        far = unit @ unit[int(nearest.argmin())]
        near = np.argsort(-far, kind="stable")[: max(1, len(unit) // MEDOIDS)]
        out.append(int((unit @ unit[near].mean(axis=0)).argmax()))
        nearest = np.maximum(nearest, np.maximum(far, unit @ unit[out[-1]]))
    return np.unique(out)


def _graph(dealt: DataFrame, vectors: DataFrame) -> DataFrame:
    """(``node``, ``links``): each node's out- and in-links of all its shards together."""

    def build(frame):
        vector = np.stack(frame["vector"].to_numpy())
        unit = vector / np.linalg.norm(vector, axis=1, keepdims=True)
        links = pruned(unit)
        a, k = np.nonzero(links >= 0)
        node = frame["node"].to_numpy()
        a, b = node[a], node[links[a, k]]
        return pd.DataFrame({"node": np.concatenate([a, b]), "to": np.concatenate([b, a])})

    built = dealt.join(vectors, "node").groupBy("task").applyInPandas(build, "node long, to long")
    return built.groupBy("node").agg(F.collect_set("to").alias("links"))


def _searched(dealt: DataFrame, vectors: DataFrame, graph: DataFrame, least: float, beam: int) -> DataFrame:
    """(``node``, ``n``, ``root``) from each task: copies linked to a node there, and a node that its links reach.

    Found pairs are verified in double precision.  A pair of nodes that several
    tasks hold is counted in the one shard, of those the two share, that comes
    first; and of a dense shard's tasks in the one of their two blocks.
    """
    held = dealt.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    rows = dealt.join(vectors, "node").join(held, "node").join(graph, "node", "left")

    def search(frame):
        vector = np.stack(frame["vector"].to_numpy())
        norm = np.linalg.norm(vector, axis=1)
        node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        block, shard = frame["block"].to_numpy(), frame["shard"].to_numpy()[0]
        within = {x: k for k, x in enumerate(node.tolist())}
        links = [
            np.array([within[x] for x in ([] if to is None else to) if x in within], np.int64) for to in frame["links"]
        ]
        found = range_search(vector / norm[:, None], links, _medoids(vector / norm[:, None]), least, beam)
        i, j = np.nonzero(np.triu(found | found.T, 1))
        if frame["a"].iloc[0] != frame["b"].iloc[0]:
            i, j = (x[block[i] != block[j]] for x in (i, j))
        width = max(map(len, frame["shards"]))
        shards = np.full((len(node), width), np.iinfo(np.int64).max)
        for k, x in enumerate(frame["shards"]):
            shards[k, : len(x)] = x
        total, linked = np.zeros(len(node), np.int64), []
        for s in range(0, len(i), 1 << 18):
            p, q = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            true = np.einsum("ij,ij->i", vector[p], vector[q]) / (norm[p] * norm[q]) >= least
            p, q = p[true], q[true]
            linked.append(np.stack([p, q]))
            common = np.where((shards[p][:, :, None] == shards[q][:, None, :]).any(axis=2), shards[p], np.iinfo(np.int64).max)
            here = common.min(axis=1) == shard
            total += np.bincount(p[here], copies[q[here]], len(node)).astype(np.int64)
            total += np.bincount(q[here], copies[p[here]], len(node)).astype(np.int64)
        root = np.arange(len(node))
        pairs = np.concatenate(linked, axis=1) if linked else np.zeros((2, 0), np.int64)
        while True:
            low = np.minimum(root[pairs[0]], root[pairs[1]])
            new = root.copy()
            np.minimum.at(new, root[pairs[0]], low)
            np.minimum.at(new, root[pairs[1]], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = (total > 0) | (root != np.arange(len(node)))
        return pd.DataFrame({"node": node[some], "n": total[some], "root": node[root[some]]})

    return rows.groupBy("task").applyInPandas(search, "node long, n long, root long")


def _audit(nodes: DataFrame, counted: DataFrame, least: float) -> float:
    """Share of the true links of at most AUDITED vectors, compared with every vector of their label, that were found."""
    first = nodes.orderBy(F.xxhash64(F.lit("audit"), "node"), "node").limit(AUDITED)
    asked = first.join(counted, "node", "left").select(
        "node", "site", "vector", F.coalesce("n", F.lit(0)).alias("n")
    ).collect()
    by_site: dict[str, list] = {}
    for r in asked:
        by_site.setdefault(r["site"], []).append(r)
    sets = {}
    for site, rows in by_site.items():
        vector = np.array([r["vector"] for r in rows])
        sets[site] = np.array([r["node"] for r in rows]), vector, np.linalg.norm(vector, axis=1)

    def compare(frames):
        for frame in frames:
            found: dict[int, int] = {}
            for site, part in frame.groupby("site"):
                if site in sets:
                    node, vector, norm = sets[site]
                    other = np.stack(part["vector"].to_numpy())
                    near = vector @ other.T / (norm[:, None] * np.linalg.norm(other, axis=1)) >= least
                    near &= node[:, None] != part["node"].to_numpy()
                    for x, n in zip(node.tolist(), (near @ part["copies"].to_numpy()).tolist(), strict=True):
                        found[x] = found.get(x, 0) + int(n)
            yield pd.DataFrame({"node": list(found), "n": list(found.values())}, dtype="int64")

    true = nodes.select("site", "node", "vector", "copies").mapInPandas(compare, "node long, n long")
    total = true.agg(F.sum("n")).first()[0] or 0
    return sum(r["n"] for r in asked) / total if total else 1.0


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = LEAST_COSINE,
) -> DataFrame:
    """(``id_col``, ``n_links``, ``component_id``, ``kept``) for every row.

    Rows of one label link if the cosine of their vectors, in double precision,
    is at least ``least``.  ``n_links`` counts the linked rows; ``component_id``
    is the smallest id reachable over links, the row's own included; ``kept``
    tells whether that is its own id.  Rows whose label is null, or whose vector
    is null, empty, zero or holds a null or non-finite number, link with
    nothing, and so do vectors of different lengths.  Repeated rows count each;
    a null id names a component only if it has no other.  Other columns are
    left out; an empty table gives an empty result.

    Recall is audited against all vectors for a bounded sample; below
    LEAST_RECALL everything is done anew with more overlap and a wider beam, at
    most TRIES times in all.
    """
    every = materialize(
        rows.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
            F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"),
        ), "rows",
    )
    nodes, member = _nodes(every)
    vectors = nodes.select("node", "vector", "copies")
    for again in range(TRIES):
        dealt = materialize(shards(nodes, least, OVERLAP + again, seed=again), "dealt")
        graph = materialize(_graph(dealt, vectors), "graph")
        found = materialize(_searched(dealt, vectors, graph, least, BEAM << again), "found")
        counted = found.groupBy("node").agg(F.sum("n").alias("n"))
        recall = _audit(nodes, counted, least)
        if recall >= LEAST_RECALL:
            break
    roots = materialize(components(found.where("node <> root").select("node", "root")), "roots")
    placed = nodes.join(roots, "node", "left").select(
        "node", "copies", "least", F.coalesce("root", "node").alias("root")
    )
    least_id = placed.groupBy("root").agg(F.min("least").alias("component"))
    judged = placed.join(counted, "node", "left").join(least_id, "root").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"
    )
    out = every.select("row", "id").join(member, "row", "left").join(judged, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
