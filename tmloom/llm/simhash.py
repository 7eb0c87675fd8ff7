"""Near duplicates: SimHash fingerprints linked by a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmloom.llm.graph import components
from tmloom.llm.texts import map_texts
from tmloom.operators.scale import materialize

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
_SLICE = 1 << 15  # shingles whose bits are counted at once
_FLUSH = 1 << 18  # fingerprints joined at once
_HOT = 1 << 18  # fingerprints of one key that stay together
_PAIRS = 1 << 19  # node pairs expanded at once
_LEAF = 48  # pairs below a node pair that are compared one by one


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned number.

    A-Z are lower-cased, words are runs of anything but space and the controls
    9 to 13, shingles are ``words`` words joined by spaces, repeats included; a
    shorter text is one shingle, a text without words has fingerprint 0.  A bit
    is set if it is set in over half of the shingles' XXH64.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    total = max(1, len(found) - words + 1)
    counts = np.zeros(64, np.int64)
    if len(found) < words:
        shingles: Iterator[bytes] = iter([b" ".join(found)])
    else:
        shingles = map(b" ".join, zip(*[found[i:] for i in range(words)], strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    for at in range(0, total, _SLICE):
        some = np.fromiter(hashes, np.uint64, min(_SLICE, total - at))
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int32
        )
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS, seed: int = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(``id_col``, ``carry``, ``fp``): the fingerprint's bits as a long.  Null texts have fingerprint 0."""

    def prepare():
        def work(texts):
            bits = np.fromiter((fingerprint(t, words, seed) for t in texts), np.uint64, len(texts))
            return [pa.array(bits.view(np.int64))]

        return work

    return map_texts(docs, [id_col, *carry], text_col, prepare, "fp long")


def blocks(max_distance: int) -> list[int]:
    """Where the 64 bits are cut into one block more than bits may differ, and the end."""
    n = max_distance + 1
    return [64 * i // n for i in range(n + 1)]


def trie_links(bits: np.ndarray, starts: np.ndarray, depth: int, budget: np.ndarray) -> np.ndarray:
    """For sorted distinct fingerprints, the index of a linked representative of each.

    ``starts`` are the first rows of the groups that share their first ``depth``
    bits.  Node pairs of the binary trie are traversed together, starting with
    each group's root against itself; a pair is split by the next bit into its
    pairs of children, differing bits add up, and a pair goes once they exceed
    ``budget[d]`` at depth d.  A node is a range of the sorted rows.  Pairs with
    few rows below them are compared row by row.  A pair whose rows are all
    linked to each other already is left out: it can add no link.

    Rows with the same result are linked, directly or through others.
    """
    n = len(bits)
    root = np.arange(n)
    ends = np.append(starts[1:], n)
    more = ends - starts > 1
    stack = [(depth, starts[more], ends[more], starts[more], ends[more], np.zeros(more.sum(), np.int8))]
    changes = np.arange(n)
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > _PAIRS:
            stack.append((d, *(x[_PAIRS:] for x in (alo, ahi, blo, bhi, err))))
            alo, ahi, blo, bhi, err = (x[:_PAIRS] for x in (alo, ahi, blo, bhi, err))
        linked = (
            (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo])
            & (root[alo] == root[blo])
        )
        alo, ahi, blo, bhi, err = (x[~linked] for x in (alo, ahi, blo, bhi, err))
        pairs = (ahi - alo) * (bhi - blo)
        leaf = (pairs <= _LEAF) if d < 64 else np.ones(len(alo), bool)
        if leaf.any():
            count = pairs[leaf]
            owner = np.repeat(np.arange(len(count)), count)
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            width = (bhi - blo)[leaf][owner]
            i, j = alo[leaf][owner] + inside // width, blo[leaf][owner] + inside % width
            near = (i < j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget[64])
            if near.any():
                root = _union(root, i[near], j[near])
                changes = np.cumsum(np.append(True, root[1:] != root[:-1]))
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        shift = np.uint64(63 - d)
        middle = lambda lo, hi: np.clip(
            np.searchsorted(bits, ((bits[lo] >> shift) | np.uint64(1)) << shift), lo, hi
        )
        same = alo == blo
        am, bm = middle(alo, ahi), middle(blo, bhi)
        off = ~same
        parts = [
            (alo, am, blo, bm, err),
            (am, ahi, bm, bhi, err),
            (alo, am, bm, bhi, err + 1),
            (am[off], ahi[off], blo[off], bm[off], err[off] + 1),
        ]
        nxt = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= budget[d + 1])
        keep &= ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        if keep.any():
            stack.append((d + 1, *(x[keep] for x in nxt)))
    return root


def _union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (``a``, ``b``) that join all of ``fp`` at ``max_distance`` or fewer differing bits.

    The bits are cut into max_distance + 1 blocks.  For any pair in reach, some
    rotation of the blocks has at most l - 1 differing bits in its first l
    blocks, for every l (else the excesses would add up to more than the whole).
    So the trie is joined once for each rotation, with that budget at each
    depth: the first block must agree and is the shuffle key.  Of the links
    found in one task only as many as connect their rows are returned.

    A key that more than ``_HOT`` fingerprints share is split by the next block,
    in which a pair may differ by one bit: each fingerprint is dealt to its own
    value and to those with one of its bits cleared, so any pair in reach meets
    at the lower of its two values.
    """
    cuts = blocks(max_distance)
    widths = np.diff(cuts)
    turned = []
    for r, cut in enumerate(cuts[:-1]):
        turn = F.col("fp")
        if cut:
            turn = F.shiftleft("fp", cut).bitwiseOR(F.shiftrightunsigned("fp", 64 - cut))
        turned.append(F.struct(F.lit(r).alias("r"), turn.alias("bits"),
                               F.shiftrightunsigned(turn, 64 - int(widths[r])).alias("key"),
                               _lower_values(turn, int(widths[r]), int(np.roll(widths, -r)[1]) if len(widths) > 1 else 0).alias("lower")))
    budgets = []
    for r in range(len(widths)):
        order = np.roll(widths, -r)
        budgets.append(np.concatenate([[0], np.repeat(np.arange(len(order)), order)]))

    def flush(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (r, _), some in rows.groupby(["r", "sub"]):
            bits = np.sort(some["bits"].to_numpy().view(np.uint64))
            depth = int(widths[r])
            key = bits >> np.uint64(64 - depth)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            root = trie_links(bits, starts, depth, budgets[r])
            tied = np.flatnonzero(root != np.arange(len(bits)))
            back = bits
            if cuts[r]:
                back = (bits >> np.uint64(cuts[r])) | (bits << np.uint64(64 - cuts[r]))
            out.append(pd.DataFrame({"a": back[tied].view(np.int64), "b": back[root[tied]].view(np.int64)}))
        return pd.concat(out)

    place = ["r", "key", "sub"]

    def run(frames):
        held: list[pd.DataFrame] = []
        size, open_ = 0, None
        for frame in frames:
            if not len(frame):
                continue
            first, last = (tuple(frame[place].iloc[k]) for k in (0, -1))
            # as long as one group goes on, its frames are only kept
            if size >= _FLUSH and (first != open_ or last != open_):
                rows = pd.concat([*held, frame])
                tail = (rows[place] == last).all(axis=1)
                yield flush(rows[~tail])
                held, size = [rows[tail]], int(tail.sum())
            else:
                held.append(frame)
                size += len(frame)
            open_ = last
        if held:
            yield flush(pd.concat(held))

    each = distinct.select(F.explode(F.array(*turned)).alias("x")).select("x.*")
    hot = each.groupBy("r", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _HOT).select(
        "r", "key", F.lit(True).alias("hot")
    )
    dealt = each.join(materialize(hot, "hot"), ["r", "key"], "left").select(
        "r", "bits", "key",
        F.explode(F.when(F.col("hot"), F.col("lower")).otherwise(F.array(F.lit(-1).cast("long")))).alias("sub"),
    )
    return dealt.repartition(*place).sortWithinPartitions(*place).mapInPandas(run, "a long, b long")


def _lower_values(turn: Column, skipped: int, width: int) -> Column:
    """The block of ``width`` bits after the first ``skipped`` ones, and it with each of its bits cleared in turn."""
    if not width:
        return F.array(F.lit(-1).cast("long"))
    value = F.shiftrightunsigned(F.shiftleft(turn, skipped), 64 - width)
    cleared = [value.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << k)).cast("long")) for k in range(width)]
    return F.array_distinct(F.array(value, *cleared))


def _rooted(nodes: DataFrame, max_distance: int) -> DataFrame:
    """``nodes`` (``fp``, ``_least``) with ``_root``, the fingerprint that names their component."""
    roots = materialize(components(links(nodes.select("fp"), max_distance)), "roots")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("_root")
    )


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """(``id_col``, ``fp``, ``component_id``) for every row.

    ``component_id`` is the smallest id reachable over links between
    fingerprints of at most ``max_distance`` differing bits.  Equal fingerprints
    are one node, so copies cost one row each.  Null ids take part and never
    name a component unless it has no other.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("_least")), "nodes")
    rooted = _rooted(nodes, max_distance)
    named = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    placed = rooted.select("fp", "_root").join(named, "_root").select("fp", "component_id")
    return marked.join(placed, "fp").select(id_col, "fp", "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, null ids last.

    A row is known by its id and its text's hash, so rows that share an id, or
    have none, stay or go by their own texts.  Rows equal in both are one group,
    of which one stays.
    """
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), sha.alias("_sha"))
    marked = materialize(fingerprints(rows, "_key", "_text", words, carry=["_sha"]), "fingerprints")
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("id"), F.col("_sha").alias("sha")))
    nodes = materialize(marked.groupBy("fp").agg(first.alias("_least")), "nodes")
    best = _rooted(nodes, max_distance).groupBy("_root").agg(F.min("_least").alias("_best"))
    stay = materialize(best.select(F.col("_best.id").alias("_id"), F.col("_best.sha").alias("_stay")), "stay")
    rows = docs.select(F.col(id_col).alias("_key"), sha.alias("_sha"), F.struct(*docs.columns).alias("_doc"))
    kept = rows.join(stay, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_stay")), "left_semi")
    if not marked.groupBy("_key", "_sha").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_key", "_sha"])
    return kept.select("_doc.*")
