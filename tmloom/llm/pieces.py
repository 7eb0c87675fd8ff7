"""SentencePiece BPE over whole texts: merge rounds on flat arrays."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tmloom.llm.texts import Shared, map_texts

SPACE = "▁"
CACHE_UNITS = 200_000
CACHE_CHARS = 64  # longer units are encoded each time they occur
SLICE_CHARS = 2_000_000
_NONE = np.int32(2**31 - 1)


@dataclass
class Pieces:
    """A model's vocabulary as arrays; ``pairs`` are sorted left * size + right."""

    chars: dict[str, int]
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    size: int
    byte_ids: list[int]
    texts: list[bytes]
    unit: str

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read a BPE model with byte fallback, identity normalisation and a dummy prefix.

        Any other model raises: its ids could differ from the library's.
        """
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _require_supported(model, path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = {
            p: i for i, p in enumerate(names)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        byte_ids = [i for i in range(n) if model.is_byte(i)]
        if len(byte_ids) != 256 or any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("the model has no byte fallback, or pieces over word borders")
        scores = np.array([model.get_score(i) for i in range(n)])
        order = np.unique(-scores, return_inverse=True)[1]
        found = [
            (plain[p[:k]] * n + plain[p[k:]], order[i], i)
            for p, i in plain.items()
            for k in range(1, len(p))
            if p[:k] in plain and p[k:] in plain
        ]
        pairs, ranks, merged = (np.array(x) for x in zip(*sorted(found), strict=True))
        texts = [p.replace(SPACE, " ").encode() for p in names]
        for b, i in enumerate(byte_ids):
            texts[i] = bytes([b])
        for i in range(n):
            if model.is_control(i):
                texts[i] = b""
            elif model.is_unknown(i):
                texts[i] = " ⁇ ".encode()
        chars = {p: i for p, i in plain.items() if len(p) == 1}
        line = "" if "\n" in "".join(plain) else "\n"
        unit = f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else "")
        return cls(chars, pairs, ranks.astype(np.int32), merged.astype(np.int32), n, byte_ids, texts, unit)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of symbol pairs; pairs that cannot merge have the highest rank."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[at], _NONE), self.merged[at]


def _require_supported(model, path: str) -> None:
    """Raise unless the model's file says what ``Pieces`` assumes."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    trainer, normalizer, denormalizer = proto.trainer_spec, proto.normalizer_spec, proto.denormalizer_spec
    faults = {
        "not BPE": trainer.model_type != trainer.BPE,
        "text is normalised": bool(normalizer.precompiled_charsmap or denormalizer.precompiled_charsmap),
        "spaces are removed": normalizer.remove_extra_whitespaces,
        "no dummy prefix": not normalizer.add_dummy_prefix or trainer.treat_whitespace_as_suffix,
        "spaces are not marked": not normalizer.escape_whitespaces,
        "user-defined or unused pieces": any(
            p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces
        ),
    }
    if any(faults.values()):
        raise ValueError(f"{path}: {', '.join(k for k, v in faults.items() if v)}")


def merge_rounds(pieces: Pieces, units: list[str]) -> list[bytes]:
    """The ids of each unit, as little-endian 32-bit numbers.

    All units lie one after another in one array of symbols.  A round takes in
    every unit the pair of least rank, merges all its occurrences, in a run of
    overlapping ones every other from the left, and closes the gaps.  Units
    without a mergeable pair leave the array.
    """
    out = [b""] * len(units)
    if not units:
        return out
    text = "".join(units)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    unit = np.repeat(np.arange(len(units), dtype=np.int32), lengths)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ids = np.zeros(int(points.max()) + 1, np.int32)
    for c in set(text):
        ids[ord(c)] = pieces.chars.get(c, -1 - ord(c))
    symbol = ids[points]
    rank, merged = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int32)
    inner = np.flatnonzero(unit[1:] == unit[:-1])
    rank[inner], merged[inner] = pieces.rank(symbol[inner], symbol[inner + 1])
    starts = np.cumsum(lengths) - lengths
    done_symbol, done_unit = [], []
    while len(symbol):
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbol)))
        over = least == _NONE
        keep = np.ones(len(symbol), bool)
        if over.any():
            keep = ~np.repeat(over, sizes)
            done_symbol.append(symbol[~keep])
            done_unit.append(unit[~keep])
            least[over] = -1
        chosen = np.flatnonzero(rank == np.repeat(least, sizes))
        if len(chosen):
            run = np.append(True, np.diff(chosen) != 1)
            first = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            chosen = _unhurried(pieces, chosen, symbol, unit, rank, merged)
            symbol[chosen] = merged[chosen]
            keep[chosen + 1] = False
        place = np.cumsum(keep) - 1
        starts = place[starts[~over]]
        symbol, unit, rank, merged = (x[keep] for x in (symbol, unit, rank, merged))
        here = place[chosen]
        changed = np.zeros(len(symbol), bool)
        changed[here] = True
        changed[here[here > 0] - 1] = True
        touched = np.flatnonzero(changed)
        rank[touched] = _NONE
        touched = touched[touched + 1 < len(symbol)]
        touched = touched[unit[touched] == unit[touched + 1]]
        rank[touched], merged[touched] = pieces.rank(symbol[touched], symbol[touched + 1])
    symbol, unit = np.concatenate(done_symbol), np.concatenate(done_unit)
    order = np.argsort(unit, kind="stable")
    symbol, unit = symbol[order], unit[order]
    if (symbol < 0).any():
        spelled = [
            [s] if s >= 0 else [pieces.byte_ids[b] for b in chr(-1 - s).encode()]
            for s in symbol.tolist()
        ]
        unit = np.repeat(unit, list(map(len, spelled)))
        symbol = np.array([i for x in spelled for i in x])
    flat = symbol.astype("<i4").tobytes()
    ends = (np.searchsorted(unit, np.arange(len(units)), side="right") * 4).tolist()
    start = 0
    for k, end in enumerate(ends):
        out[k] = flat[start:end]
        start = end
    return out


def _unhurried(pieces, chosen, symbol, unit, rank, merged) -> np.ndarray:
    """Of a unit's merges in one round, those up to the first that opens a pair of the same or a lower rank.

    One at a time, such a pair would be merged before the same pair's next
    occurrence (of one rank the leftmost goes first), and could take a symbol
    from it.
    """
    several = np.append(unit[chosen[1:]] == unit[chosen[:-1]], False)
    several[1:] |= several[:-1].copy()
    if not several.any():
        return chosen
    at = chosen[several]
    left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
    twin = np.append(False, (np.diff(at) == 2) & (unit[at[1:]] == unit[at[:-1]]))
    before = np.where(twin, merged[np.append(at[:1], at[:-1])], symbol[left])
    limit = rank[at]
    opens = (pieces.rank(before, merged[at])[0] <= limit) & ((unit[left] == unit[at]) & (left < at))
    opens |= twin & (pieces.rank(symbol[left], merged[at])[0] <= limit)
    opens |= (pieces.rank(merged[at], symbol[right])[0] <= limit) & (unit[right] == unit[at]) & (right > at + 1)
    if not opens.any():
        return chosen
    seen = np.cumsum(opens)
    fresh = np.append(True, unit[at[1:]] != unit[at[:-1]])
    base = np.maximum.accumulate(np.where(fresh, seen - opens, 0))
    keep = np.ones(len(chosen), bool)
    keep[np.flatnonzero(several)[seen - opens > base]] = False
    return chosen[keep]


def encode_texts(pieces: Pieces, texts: list[str], cache: dict[str, bytes]) -> list[bytes]:
    """The ids of each text.

    A text is the dummy prefix and the text with spaces marked, cut where no
    piece reaches across: before a run of space marks and at line ends.
    """
    find = re.compile(pieces.unit).findall
    cut = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    new = list(set().union(*cut).difference(cache))
    if len(cache) + len(new) > CACHE_UNITS:
        cache.clear()
        new = list(set().union(*cut))
    fresh = dict(zip(new, merge_rounds(pieces, new), strict=True))
    cache.update(fresh)
    out = [b"".join(map(cache.__getitem__, units)) for units in cut]
    if len(cache) > CACHE_UNITS:
        cache.clear()
    else:
        for u in new:
            if len(u) > CACHE_CHARS:
                del cache[u]
    return out


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    """The text of a list of ids: pieces with spaces, byte pieces as bytes, less the dummy prefix.

    Bytes that are no UTF-8 become U+FFFD, one for each byte.
    """
    joined = b"".join(map(pieces.texts.__getitem__, ids))
    if ids and joined[:1] == b" ":
        joined = joined[1:]
    try:
        return joined.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "�", joined.decode(errors="surrogateescape"))


def encode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(``id_col``, ``carry``, ``ids`` array<int>, ``decoded`` string): each whole text encoded, and decoded again.

    ``model`` is the path of the model file on the driver; its tables are
    broadcast (some MB, fixed by the model).  Null and empty texts have no ids.
    """
    spark = docs.sparkSession
    shared = Shared(spark, Pieces.load(model))

    def prepare():
        pieces, cache = shared.value, {}

        def work(texts):
            found = encode_texts(pieces, [t or "" for t in texts], cache)
            lists = [np.frombuffer(x, "<i4") for x in found]
            offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists), pa.int32()))
            return [ids, pa.array([decode_ids(pieces, x.tolist()) for x in lists], pa.string())]

        return work

    return map_texts(docs, [id_col, *carry], text_col, prepare, "ids array<int>, decoded string", SLICE_CHARS)
