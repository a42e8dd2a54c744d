"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id.

Not every suffix is sorted. In each string of LENGTH bytes the 12-byte gram with the smallest
hash (the leftmost of equals) is its anchor. The choice depends on the string alone, so equal
strings have equal anchors at equal places, and only the suffixes that begin at anchors, about
one in twenty, are needed. A suffix is cut where the last string with this anchor ends, and
carries the bytes before the anchor back to where the first such string begins.

* A task sorts the suffixes of its block into a run, combines equal ones (all but the smallest
  id are marked at once) and sends the run front-coded: length of the prefix shared with the
  suffix before, and the rest. Ranges of the suffix order are the bins of the exchange.
* Suffixes with one of the first 8 bytes that fill whole bins by themselves (hot heads) are dealt over
  several bins instead. Each goes out twice: for the strings with at most HALF bytes before the anchor
  to a bin chosen by the HALF bytes behind, which all of them hold, and for the other strings to one
  chosen by the HALF + 1 bytes before. Equal strings still meet, each in one of the two.
* The runs of a bin are merged by a loser tree whose players carry the length of the prefix they
  share with the last winner; two players are compared only behind a prefix known to be equal.
* The merged order comes with the common prefixes of neighbours. Strings whose part behind the
  anchor is longer than any common prefix are unique; the others are grouped by the hash of
  all their bytes, the bytes are compared, and every one but those of the smallest id is marked.

The marks, a few numbers for each repeated stretch, are gathered for each document and applied:
sent to the texts if they are small enough, else joined with them by one exchange of the texts.

Defined cases: NULL or empty texts have no bytes; texts shorter than LENGTH are kept; rows with
a NULL id are kept whole and remove nothing; rows of equal id count as one document and are
taken to have equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from fieldpulse.llm import text as texts
from fieldpulse.llm.registry import query, table
from fieldpulse.session import materialize

LENGTH = 50
GRAM = 12
SPAN = LENGTH - GRAM + 1  # grams in a string
LEFT = LENGTH - GRAM  # most bytes before an anchor
HALF = LENGTH // 2  # strings of a hot head are dealt by so many bytes behind the anchor, or one more before it
RUN_SUFFIXES = 300_000  # suffixes in a run
BIN_BYTES = 6 << 20  # bytes of text whose suffixes share a bin, on average
GROUPED = 20_000  # suffixes whose strings are grouped together, on average
BROADCAST_BYTES = 32 << 20  # marks up to this size are sent to the texts; beyond it, texts and marks are exchanged
SAMPLE_ROWS = 2_000  # rows that the bins' boundaries are drawn from, on average
PLACE_BITS = 24  # a place within a block; longer texts are worked through in overlapping pieces
PIECE = 8 << 20
SUFFIXES, MARKS = 0, 1

PACKED = "bin bigint, kind int, data binary"
MARK_COLUMNS = "doc_id bigint, begin bigint, end bigint"


def _eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every place, as one number each, first byte highest."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for o in range(8):
        part = out[o::8]
        part[:] = padded[o : o + 8 * len(part)].view(">u8")
    return out


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of every run of strings with the same anchor."""
    n = len(data)
    nothing = np.zeros(0, np.int64)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    starts = np.flatnonzero(room >= LENGTH)
    if not len(starts):
        return nothing, nothing, nothing
    eight = _eight(data)
    later = np.concatenate([eight[GRAM - 8 :], np.zeros(GRAM - 8, np.uint64)])
    place = np.uint64((1 << PLACE_BITS) - 1)
    low = texts.mix(eight * np.uint64(0x9E3779B97F4A7C15) ^ texts.mix(later))
    low = (low & ~place) | np.arange(n, dtype=np.uint64)
    del eight, later
    width = 1
    while 2 * width <= SPAN:
        low[: n - width] = np.minimum(low[: n - width], low[width:])
        width *= 2
    rest = SPAN - width
    low[: n - rest] = np.minimum(low[: n - rest], low[rest:])
    anchor = (low[starts] & place).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    last = np.concatenate([np.flatnonzero(new)[1:], [len(starts)]]) - 1
    return anchor[new], starts[new], starts[last]


def _planes(numbers: np.ndarray) -> np.ndarray:
    """First all lowest bytes, then all second ones and so on: the high ones, mostly alike, compress well."""
    return np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


class Run:
    """Suffixes of a block in order: `key` (zero-padded rows), its length, the bytes before, document and place."""

    def __init__(self, data: np.ndarray, anchor, first, last, doc, place):
        self.size = (last + LENGTH - anchor).astype(np.uint8)
        self.left_size = (anchor - first).astype(np.uint8)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH + 8, np.uint8)])
        columns = np.arange(LENGTH + 6)
        self.key = padded[(anchor + LEFT)[:, None] + columns]
        self.key[columns >= self.size[:, None]] = 0
        self.left = padded[anchor[:, None] + np.arange(LEFT)]
        self.left[np.arange(LEFT) < LEFT - self.left_size[:, None].astype(np.int64)] = 0
        self.doc, self.place = doc, place
        factors = texts.mix(np.arange(7, 7 + LEFT, dtype=np.uint64))
        left_hash = np.zeros(len(anchor), np.uint64)
        for i in range(LEFT):
            left_hash += self.left[:, i] * factors[i]
        left_hash = texts.mix(left_hash ^ self.left_size)
        words = self.key.view(">u8").astype(np.uint64)
        order = np.argsort(words[:, 0], kind="stable")
        same = words[order[1:], 0] == words[order[:-1], 0]
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        rows = order[tied]  # only suffixes with equal first words need the other keys
        rest = [words[rows, i] for i in reversed(range(words.shape[1]))]
        order[tied] = rows[np.lexsort((doc[rows], left_hash[rows], self.size[rows], *rest))]
        for name in ("size", "left_size", "key", "left", "doc", "place"):
            setattr(self, name, getattr(self, name)[order])
        self.head = words[order, 0]
        self.left_hash = left_hash[order]

    def take(self, rows: np.ndarray) -> None:
        for name in ("size", "left_size", "key", "left", "doc", "place", "head", "left_hash"):
            setattr(self, name, getattr(self, name)[rows])

    def common(self) -> np.ndarray:
        """Bytes that each suffix shares with the one before."""
        out = np.zeros(len(self.size), np.int64)
        if len(out) > 1:
            differs = self.key[1:] != self.key[:-1]
            out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH + 6)
            out[1:] = np.minimum(out[1:], np.minimum(self.size[1:], self.size[:-1]))
        return out

    def combine(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drop suffixes equal to one of a smaller document; (doc, begin, end) of what they mark."""
        n = len(self.size)
        if not n:
            return self.doc, self.doc, self.doc
        common = self.common()
        same = np.zeros(n, bool)
        same[1:] = (common[1:] == self.size[1:]) & (self.size[1:] == self.size[:-1])
        same[1:] &= (self.left_hash[1:] == self.left_hash[:-1]) & (self.left_size[1:] == self.left_size[:-1])
        smallest = self.doc[~same][np.cumsum(~same) - 1]
        gone = self.doc > smallest
        begin = self.place[gone] - self.left_size[gone]
        marks = self.doc[gone], begin, self.place[gone] + self.size[gone]
        self.take(np.flatnonzero(~gone))
        return marks

    def dealt(self, bins: Bins) -> Iterator[tuple[Run, np.ndarray]]:
        """The run in parts with the bin of each suffix: those of ordinary heads, and twice those of hot ones."""
        hot = np.isin(self.head, bins.hot)
        if not hot.any():
            yield self, np.searchsorted(bins.splitters, self.head, side="right")
            return
        ordinary = self.part(~hot)
        yield ordinary, np.searchsorted(bins.splitters, ordinary.head, side="right")
        behind = self.part(hot & (self.size >= HALF))
        behind.left_size = np.minimum(behind.left_size, HALF).astype(np.uint8)
        yield behind, bins.of_hot(behind.head, behind.key[:, :HALF], 1)
        before = self.part(hot & (self.left_size > HALF))
        before.size = np.minimum(before.size, LENGTH - HALF - 1).astype(np.uint8)
        yield before, bins.of_hot(before.head, before.left[:, LEFT - HALF - 1 :], 2)

    def part(self, rows: np.ndarray) -> Run:
        out = copy.copy(self)
        out.take(np.flatnonzero(rows))
        return out

    def packed(self, bins: Bins) -> Iterator[tuple[int, bytes]]:
        """The run cut into bins, each piece front-coded and compressed."""
        for part, places in self.dealt(bins):
            order = np.argsort(places, kind="stable")
            if (np.diff(order) < 0).any():
                part = copy.copy(part)
                part.take(order)
            yield from part._pieces_of(places[order])

    def _pieces_of(self, bins: np.ndarray) -> Iterator[tuple[int, bytes]]:
        if not len(bins):
            return
        common = self.common()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1, [len(bins)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            shared = common[a:b].copy()
            shared[0] = 0
            size, left_size = self.size[a:b], self.left_size[a:b]
            columns = np.arange(LENGTH + 6)
            rest = self.key[a:b][(columns >= shared[:, None]) & (columns < size[:, None])]
            left = self.left[a:b][np.arange(LEFT) >= LEFT - left_size[:, None].astype(np.int64)]
            parts = [np.array([b - a, len(rest), len(left)], np.int64), shared.astype(np.uint8), size, left_size,
                     _planes(self.doc[a:b]), _planes(self.place[a:b]), rest, left]
            raw = b"".join(p.tobytes() for p in parts)
            yield int(bins[a]), len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


class Bins:
    """Ranges of the suffix order, and behind them the bins of the hot heads."""

    def __init__(self, sample: np.ndarray, wanted: int):
        """From sorted heads drawn from the suffixes: a head at two or more of the boundaries is hot."""
        cuts = sample[np.linspace(0, len(sample) - 1, wanted + 1).astype(np.int64)[1:-1]] if len(sample) else sample
        self.splitters, times = np.unique(cuts, return_counts=True)
        self.hot = self.splitters[times > 1]
        # each suffix of a hot head is sent twice
        self.slots = 2 * times[times > 1].astype(np.int64) + 2
        self.first = len(self.splitters) + 1 + np.cumsum(self.slots) - self.slots
        self.number = int(len(self.splitters) + 1 + self.slots.sum())

    def of_hot(self, head: np.ndarray, bytes_: np.ndarray, kind: int) -> np.ndarray:
        which = np.searchsorted(self.hot, head)
        hashes = np.full(len(head), kind, np.uint64)
        for i in range(bytes_.shape[1]):
            hashes = texts.mix(hashes * np.uint64(0x9E3779B97F4A7C15) + bytes_[:, i])
        return self.first[which] + (hashes % self.slots[which].astype(np.uint64)).astype(np.int64)


def _unpacked(blob: bytes) -> tuple:
    """(suffixes, shared, size, left_size, doc, place, left) of a packed piece."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, n_rest, n_left = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24
    columns = []
    for count in (n, n, n, 8 * n, 8 * n, n_rest, n_left):
        columns.append(np.frombuffer(raw, np.uint8, count, at))
        at += count
    shared, size, left_size, doc, place, rest, left = columns
    doc, place = (np.ascontiguousarray(x.reshape(8, -1).T).view(np.int64).ravel() for x in (doc, place))
    body = rest.tobytes()
    suffixes, before, begin = [], b"", 0
    for common, new in zip(shared.tolist(), (size - shared).tolist(), strict=True):
        before = before[:common] + body[begin : begin + new]
        begin += new
        suffixes.append(before)
    return suffixes, shared, size, left_size, doc, place, left


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of (strings, prefix shared with the string before) with a loser tree.

    Returns the run of each string in merged order, and the prefix each shares with the one
    before. A node holds the loser of its last game and the prefix it shares with the winner.
    The player that moves up shares a known prefix with that same winner, so the longer one
    of the two prefixes decides; only equal ones need a look at the bytes behind.
    """
    n = len(runs)
    if n == 0:
        return [], []
    if n == 1:
        return [0] * len(runs[0][0]), list(runs[0][1])
    size = 1
    while size < n:
        size *= 2
    strings = [r[0] for r in runs] + [[] for _ in range(size - n)]
    shares = [r[1] for r in runs] + [[] for _ in range(size - n)]
    ends = [len(s) for s in strings]
    at = [0] * size
    current = [s[0] if s else None for s in strings]
    loser, common = [0] * size, [0] * size
    # the nodes between each run and the root
    paths = [[(run + size) >> level for level in range(1, size.bit_length())] for run in range(size)]

    def play(a: int, b: int, known: int) -> tuple[int, int, int]:
        """(winner, loser, prefix they share)"""
        x, y = current[a], current[b]
        if x is None or y is None:
            return (b, a, 0) if x is None else (a, b, 0)
        if x[known:] == y[known:]:
            return a, b, len(x)
        top = min(len(x), len(y))
        while known < top and x[known] == y[known]:
            known += 1
        if known == len(x) or (known < len(y) and x[known] < y[known]):
            return a, b, known
        return b, a, known

    def first(node: int) -> int:
        if node >= size:
            return node - size
        winner, lost, known = play(first(2 * node), first(2 * node + 1), 0)
        loser[node], common[node] = lost, known
        return winner

    winner, shared = first(1), 0
    order, out = [], []
    while current[winner] is not None:
        order.append(winner)
        out.append(shared)
        place = at[winner] = at[winner] + 1
        player = winner
        if place < ends[player]:
            current[player] = strings[player][place]
            shared = shares[player][place]
        else:
            current[player] = None
            shared = -1  # a finished run loses every game
        for node in paths[player]:
            known = common[node]
            if known < shared:
                continue
            if known > shared:
                # the waiting player is nearer to the last winner
                player, loser[node] = loser[node], player
                common[node], shared = shared, known
            elif known >= 0:
                player, loser[node], common[node] = play(player, loser[node], known)
        winner = player
    return order, out


def _bin_marks(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, begin, end) of the strings of a bin that a smaller document has as well."""
    pieces = [_unpacked(bytes(b)) for b in blobs]
    nothing = np.zeros(0, np.int64)
    if not pieces:
        return nothing, nothing, nothing
    order, shared = merge([(p[0], p[1].tolist()) for p in pieces])
    order = np.array(order, np.int64)
    # the k-th string of a run is the k-th of its run in the merged order
    begin_of = np.concatenate([[0], np.cumsum([len(p[0]) for p in pieces])])
    row = np.empty(len(order), np.int64)
    by_run = np.argsort(order, kind="stable")
    row[by_run] = np.arange(len(order))
    size, left_size, doc, place = (np.concatenate([p[i] for p in pieces])[row] for i in (2, 3, 4, 5))
    size, left_size = size.astype(np.int64), left_size.astype(np.int64)
    left_at = np.concatenate([[0], np.cumsum(np.concatenate([p[3] for p in pieces]), dtype=np.int64)])[row]
    left = np.concatenate([p[6] for p in pieces])
    shared = np.array([*shared, 0], np.int64)
    reach = np.maximum(shared[:-1], shared[1:])
    # a string with r bytes before the anchor has LENGTH - r behind it
    low = np.maximum(LENGTH - size, LENGTH - reach)
    chosen = np.flatnonzero(low <= left_size)
    suffixes = [p[0] for p in pieces]
    found = []
    # equal strings have equal anchors, so groups of strings can be closed wherever the gram changes
    gram = np.cumsum(shared[:-1] < GRAM)[chosen]
    begin = 0
    while begin < len(chosen):
        end = min(begin + GROUPED, len(chosen))
        end = int(np.searchsorted(gram, gram[end - 1], side="right"))
        part = chosen[begin:end]
        tails = [suffixes[r][i] for r, i in zip(order[part].tolist(), (row[part] - begin_of[order[part]]).tolist(), strict=True)]
        fronts = [left[a : a + n].tobytes() for a, n in zip(left_at[part].tolist(), left_size[part].tolist(), strict=True)]
        found.append(_group_marks(fronts, tails, low[part], doc[part], place[part]))
        begin = end
    return _joined(*[np.concatenate([nothing, *[f[i] for f in found]]) for i in range(3)])


def _group_marks(fronts: list[bytes], tails: list[bytes], low: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple:
    """(doc, begin, end) of the strings, with `low` bytes or more before the anchor, that a smaller document has as well."""
    whole = np.frombuffer(b"".join(x for pair in zip(fronts, tails, strict=True) for x in pair), np.uint8)
    left_size, size = np.array([len(x) for x in fronts]), np.array([len(x) for x in tails])
    anchor = np.cumsum(left_size + size) - size
    n_strings = left_size - low + 1
    owner = np.repeat(np.arange(len(low)), n_strings)
    before = np.arange(n_strings.sum()) - np.repeat(np.cumsum(n_strings) - n_strings, n_strings) + low[owner]
    begin = anchor[owner] - before
    hashes = texts.hashes_of(whole, begin, begin + LENGTH)
    docs = doc[owner]
    in_order = np.lexsort((docs, hashes))
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[in_order][1:] != hashes[in_order][:-1]
    smallest = in_order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = docs[in_order] > docs[smallest]
    gone, first = in_order[later], smallest[later]
    if not _same_bytes(whole, begin[gone], begin[first]):
        gone = _later_by_bytes(whole, begin, docs)
    start = place[owner[gone]] - before[gone]
    return _joined(docs[gone], start, start + LENGTH)


def _same_bytes(whole: np.ndarray, one: np.ndarray, other: np.ndarray) -> bool:
    """Whether all the strings that begin at `one` equal those at `other`."""
    return all(np.array_equal(whole[one + k], whole[other + k]) for k in range(LENGTH))


def _later_by_bytes(whole: np.ndarray, begin: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The strings that a smaller document has as well, told apart by their bytes: for equal hashes of unequal strings."""
    smallest: dict[bytes, int] = {}
    keys = [whole[b : b + LENGTH].tobytes() for b in begin.tolist()]
    for key, doc in zip(keys, docs.tolist(), strict=True):
        smallest[key] = min(doc, smallest.get(key, doc))
    return np.flatnonzero([doc > smallest[key] for key, doc in zip(keys, docs.tolist(), strict=True)])


def _joined(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching marks of a document made one. No mark is longer than the strings of one anchor span."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((end, begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    new = np.ones(len(doc), bool)
    # begins are in order, so the furthest end so far within a document is a running maximum
    shift = np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]])) * (int(end.max()) + 1)
    furthest = np.maximum.accumulate(end + shift) - shift
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > furthest[:-1])
    last = np.concatenate([np.flatnonzero(new)[1:], [len(doc)]]) - 1
    return doc[new], begin[new], furthest[last]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, document, place of its first byte in the document) of blocks; long texts in overlapping pieces."""
    for batch in texts.blocks(batches, limit=min(texts.BLOCK_BYTES // 2, PIECE)):
        data, offsets = texts.joined(batch.column(1))
        docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(data) <= PIECE:
            yield data, offsets, docs, np.zeros(len(docs), np.int64)
            continue
        for low in range(0, len(data), PIECE):
            part = data[low : low + PIECE + LENGTH - 1]
            yield part, np.array([0, len(part)]), docs[:1], np.array([low])


def _collect(data, offsets, docs, base, held: list) -> int:
    anchor, first, last = _anchors(data, offsets)
    if not len(anchor):
        return 0
    of = np.searchsorted(offsets, anchor, side="right") - 1
    held.append((data, anchor, first, last, docs[of], anchor - offsets[of] + base[of]))
    return len(anchor)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[Run]:
    """Sorted runs of about RUN_SUFFIXES suffixes."""
    held, size = [], 0

    def run() -> Run:
        shift = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
        places = [np.concatenate([h[i] + s for h, s in zip(held, shift, strict=True)]) for i in (1, 2, 3)]
        return Run(np.concatenate([h[0] for h in held]), *places, *[np.concatenate([h[i] for h in held]) for i in (4, 5)])

    for piece in _pieces(batches):
        size += _collect(*piece, held)
        if size >= RUN_SUFFIXES:
            yield run()
            held, size = [], 0
    if size:
        yield run()


def _bins(docs: DataFrame, wanted: int, n_rows: int) -> Bins:
    """About `wanted` bins in the order of suffixes, from the anchors of about SAMPLE_ROWS rows."""
    if wanted <= 1:
        return Bins(np.zeros(0, np.uint64), 1)
    every = max(1, n_rows // SAMPLE_ROWS)

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, _, _ in _pieces(batches):
            anchor = _anchors(data, offsets)[0]
            kept = _eight(data)[anchor][:: max(1, len(anchor) // 20_000)]
            yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary())], names=["heads"])

    found = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(heads, "heads binary").collect()
    sample = np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(bytes(r["heads"]), np.uint64) for r in found]]))
    return Bins(sample, wanted)


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end): byte ranges to remove, several for a document, of (doc_id, bytes `text`)."""
    n_rows, n_bytes = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    bins = _bins(docs, int((n_bytes or 0) // BIN_BYTES + 1), n_rows)

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(bin_: list, kind: list, data: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(bin_, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["bin", "kind", "data"])

        for run in _runs(batches):
            found = _joined(*run.combine())
            pieces = list(run.packed(bins))
            yield row([p[0] for p in pieces], [SUFFIXES] * len(pieces), [p[1] for p in pieces])
            if len(found[0]):
                data = np.stack(found, axis=1).astype(np.int64).tobytes()
                yield row([zlib.crc32(data) % bins.number], [MARKS], [data])

    def combine(part: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(bytes(x), np.int64).reshape(-1, 3) for x in part.loc[part["kind"] == MARKS, "data"]]
        merged = np.stack(_bin_marks(part.loc[part["kind"] == SUFFIXES, "data"]), axis=1)
        return pd.DataFrame(np.concatenate([*found, merged]), columns=["doc_id", "begin", "end"])

    packed = docs.mapInArrow(sort, PACKED)
    return packed.repartition(bins.number, "bin").groupBy("bin").applyInPandas(combine, MARK_COLUMNS)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


SPANS = "array<struct<begin:bigint,end:bigint>>"


def _merge_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Touching marks of each document made one; they come in order of their begins."""
    for batch in batches:
        lists = batch.column(1)
        owner = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        begin, end = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        owner, begin, end = _joined(owner, begin, end)
        offsets = np.searchsorted(owner, np.arange(len(lists) + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], names=["begin", "end"])
        merged = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), merged], names=["doc_id", "_marks"])


def _cut(raw: bytes, found: list[dict] | None) -> tuple[bytes, int]:
    """The bytes that stay and the number of maximal removed runs."""
    spans: list[list[int]] = []
    for m in sorted((m["begin"], m["end"]) for m in found or ()):
        if spans and m[0] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], m[1])
        else:
            spans.append(list(m))
    kept, at = [], 0
    for begin, end in spans:
        kept.append(raw[at:begin])
        at = end
    return b"".join([*kept, raw[at:]]), len(spans)


def remove_repeats(docs: DataFrame, row_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row for every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, `kept` (the bytes that stay)."""
    body = docs.select(F.col(row_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    found = marks(body.filter("doc_id IS NOT NULL"))
    gathered = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_marks"))
    by_doc = materialize(gathered.mapInArrow(_merge_marks, f"doc_id bigint, _marks {SPANS}"), "marks")
    n_docs, n_marks = by_doc.agg(F.count(F.lit(1)), F.sum(F.size("_marks"))).first()
    small = 64 * n_docs + 40 * (n_marks or 0) <= BROADCAST_BYTES
    by_doc = F.broadcast(by_doc) if small else by_doc.hint("shuffle_hash")
    both = body.join(by_doc, "doc_id", "left").select("doc_id", "text", "_marks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches):
            rows = []
            for raw, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = raw.as_py()
                kept, n = _cut(raw, own)
                rows.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            out = pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)
            yield out if with_text else out.select(names[:-1])

    return both.mapInArrow(run, RESULT + (", kept binary" if with_text else ""))


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(generate_series(0, n - 50)) AS i FROM h)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE w.doc_id > m.first),
o AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50 AS opens FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o) GROUP BY doc_id, run),
e AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM r),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed,
             string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept
      FROM e JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""


@query("op3_suffix_dedup", SQL)
def op3_suffix_dedup(spark, folder):
    return remove_repeats(table(spark, folder, "documents"))
