"""Exact Jaccard join of texts on word shingles, by partition of the universe and pigeonhole.

The 64-bit hashes of shingles are the universe. Sets are put into bands by size. For the pairs
whose larger set is in band k at most H shingles can differ, so the universe is cut into
segments of total weight H + 1 + e. A segment of weight 1 is indexed by the shingles in it; one
of weight 2 also by its one-deletion neighbourhood, so that missing it costs two differences.
Two similar sets then agree in segments of weight 1 + e at least; hence each set may leave out
its e least selective weight-1 segments, ranked by content alike on both sides (fewest shingles,
not counting those that a sample of texts shows to be frequent, such as the shingles of a common
passage), and still shares an index entry with every similar set. How many segments get weight 2
and how many are left out is chosen for each band by cost: entries to exchange plus expected
candidates, from the number of sets and what sampled sets have in common. The list of frequent
shingles and the choice change the work, never the result.

Copies (equal sets) are one class, represented by the smallest id. Candidates are first judged
by their sizes and the bits in which two bitmaps differ, a lower bound of their differences;
those that may be similar are verified exactly on the whole texts. No bucket of the index is expanded into all its pairs: a first round
compares the members of a bucket with its smallest id only and forms components of verified
links. Buckets whose members stay in different components after failed comparisons are then
looked at again, and there every pair across components is verified, so no link between
components is lost. Buckets are combined before the exchange: in the first round a task sends
one entry for each signature of its block.

Defined cases: a NULL, empty or wordless text has no shingles and is its own component; rows
of equal id and text are one document; a NULL id is never linked and has component NULL; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldpulse.llm import text as texts
from fieldpulse.llm.components import connected_components
from fieldpulse.llm.dealing import join_dealt
from fieldpulse.llm.registry import query, table
from fieldpulse.session import materialize

SHINGLE = 5
SIMILARITY = (80, 100)
SAMPLE_SETS = 10_000  # texts, on average, in which frequent shingles and the overlap are measured
FREQUENT = 100_000  # most frequent shingles to keep
FREQUENT_FROM = 3  # sampled sets that hold a frequent shingle
FLUSH_ENTRIES = 1_000_000  # index entries a task combines before it sends them on
BIN_BYTES = 24 << 20  # index entries that one task groups, on average
CANDIDATE_COST = 20.0  # cost of verifying a candidate, in index entries

_factors = texts.mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text of the block."""
    words = texts.Words(*texts.joined(batch.column(batch.schema.get_field_index("text"))))
    hashes = words.strong_hashes()
    n = len(hashes)
    rolling = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolling += hashes[k : k + len(rolling)] * _factors[k]
    rolling = texts.mix(rolling)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolling[a : b - SHINGLE + 1]))
        elif b > a:
            # the number of words goes in, so that a short text never equals a shingle by its first words
            parts = np.concatenate([hashes[a:b], [np.uint64(b - a)]]) * _factors[: b - a + 1]
            out.append(texts.mix(parts.sum(keepdims=True, dtype=np.uint64) ^ np.uint64(0x5555)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the members only, as two signed numbers."""
    first, second = texts.mix(found).sum(dtype=np.uint64), texts.mix(found ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


class Bands:
    """Size bands and, for each, the allocation (H + 1, weight-2 segments, left-out segments)."""

    def __init__(self, largest: int, n_sets: int = 0, overlap: float = 0.0, frequent: np.ndarray | None = None, share: float = 0.0):
        self.frequent = np.zeros(0, np.uint64) if frequent is None else np.sort(frequent)
        self.low = [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * SIMILARITY[1] // SIMILARITY[0]))
        self.low.append(max(self.low[-1] + 1, self.low[-1] * SIMILARITY[1] // SIMILARITY[0]))
        a, b = SIMILARITY
        # |x - y| + |y - x| <= (b - a) / (a + b) * (|x| + |y|) for similar sets
        self.need = [(b - a) * 2 * (high - 1) // (a + b) + 1 for high in self.low[1:]]
        self.parts, self.first = np.ones(len(self.need), np.int64), np.arange(len(self.need) + 1)
        self.choice = [self._choose(need, low, n_sets, overlap, share) for need, low in zip(self.need, self.low[:-1], strict=True)]

    @staticmethod
    def _choose(need: int, size: int, n_sets: int, overlap: float, share: float) -> tuple[int, int]:
        """`overlap`: chance that a rare shingle is in another set; `share`: of frequent shingles in a set."""
        best = None
        for share_out in (0.0, 0.25, 0.5, 1.0):
            for share_two in (0.0, 0.1, 0.25):
                out, two = int(need * share_out), int(need * share_two)
                units = need + out
                single, kept = units - 2 * two, units - 2 * two - out
                if kept < 0:
                    continue
                mean = size * (1 - share) / units
                one, double = Bands._poisson(mean), Bands._poisson(2 * mean)
                counts = np.arange(len(one))
                alike = n_sets * overlap ** counts.astype(float)
                # the left-out segments are those with the fewest rare shingles
                spare = out / single if single else 0.0
                left = np.diff(np.concatenate([[0.0], np.maximum(np.cumsum(one) - spare, 0.0)]))
                # a segment of weight 2 meets others by all its shingles and by all but one
                by_deletion = counts * np.concatenate([[0.0], alike[:-1]])
                candidates = single * (left * alike).sum() + two * (double * (alike + by_deletion)).sum()
                entries = kept + two * (1 + 2 * size / units)
                cost = entries + CANDIDATE_COST * candidates
                if best is None or cost < best[0]:
                    best = (cost, out, two)
        return best[1], best[2]

    @staticmethod
    def _poisson(mean: float) -> np.ndarray:
        counts = np.arange(0, 60)
        return np.exp(counts * math.log(max(mean, 1e-9)) - mean - np.array([math.lgamma(c + 1) for c in counts]))

    def is_frequent(self, found: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
        return self.frequent[at] == found

    def spread(self, sizes: list[tuple[float, int]]) -> int:
        """Give every band its own bins, from (size, number of sets); the number of all bins.

        A pair of sets shares many entries of at most two bands; in bins by band it comes up in
        few bins, in bins by entry alone it would come up in nearly all of them.
        """
        load = np.zeros(len(self.need))
        for size, n in sizes:
            band = self.of(size)
            load[band] += 16.0 * n * self.need[band]
            load[band + 1] += 16.0 * n * self.need[band + 1]
        self.parts = np.maximum(1, np.ceil(load / BIN_BYTES)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.parts)])
        return int(self.first[-1])

    def of(self, size: float) -> int:
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def entries(self, found: np.ndarray) -> np.ndarray:
        """All index entries of one set: those of its own band and of the next."""
        return self.placed_entries(found)[0]

    def placed_entries(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index entries of one set and the bin of each."""
        band = self.of(len(found))
        both = [self._entries(found, band), self._entries(found, band + 1)]
        bins = [e % np.uint64(self.parts[band + i]) + np.uint64(self.first[band + i]) for i, e in enumerate(both)]
        return np.concatenate(both), np.concatenate(bins)

    def _entries(self, found: np.ndarray, band: int) -> np.ndarray:
        out, two = self.choice[band]
        units = self.need[band] + out
        unit = ((found >> np.uint64(32)) * np.uint64(units)) >> np.uint64(32)
        # the first 2 * two units form the segments of weight 2; hashes are sorted, so segments are runs
        segment = np.where(unit < 2 * two, unit >> np.uint64(1), unit - np.uint64(two)).astype(np.int64)
        n = np.bincount(segment, minlength=units - two)
        mixed = texts.mix(found ^ np.uint64(0x3C3C3C3C))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        last = np.cumsum(n)
        total = sums[last] - sums[last - n]
        name = texts.mix(np.arange(units - two, dtype=np.uint64) + np.uint64(band << 32))
        whole = texts.mix(total ^ name)
        single = np.arange(two, units - two)
        if out:
            # ranked by number of rare shingles, of all shingles, then by content; the lowest are left out
            rare = np.bincount(segment, weights=~self.is_frequent(found), minlength=units - two)
            rank = (np.minimum(rare[single], 255).astype(np.uint64) << np.uint64(56)) | (whole[single] >> np.uint64(16))
            rank |= np.minimum(n[single], 255).astype(np.uint64) << np.uint64(48)
            single = single[np.argpartition(rank, out - 1)[out:]]
        pieces = [whole[single]]
        if two:
            pieces.append(whole[:two])
            inside = segment < two
            pieces.append(texts.mix((total[segment[inside]] - mixed[inside]) ^ name[segment[inside]]))
        return np.concatenate(pieces)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = sorted((len(x), len(y)))
    a, b = SIMILARITY
    if b * small < a * large:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return b * common >= a * (len(x) + len(y) - common)


def _bitmap(found: np.ndarray, width: int | None = None) -> bytes:
    """One bit for each residue of the hashes; without `width` four bits or more for each member, a power of two in all."""
    width = width or (max(64, 1 << (4 * len(found) - 1).bit_length()) if len(found) else 64)
    bits = np.zeros(width, bool)
    bits[(found & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _may_be_similar(n_x: int, n_y: int, x: bytes, y: bytes) -> bool:
    """False only for sets that cannot be similar: by size, or by the bits that differ.

    Every differing bit stands for a member that only one set has. A wider bitmap is folded to
    the narrower one's width.
    """
    a, b = SIMILARITY
    if b * min(n_x, n_y) < a * max(n_x, n_y):
        return False
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) < len(q):
        p, q = q, p
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    return (a + b) * int(np.bitwise_count(p ^ q).sum()) <= (b - a) * (n_x + n_y)


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, bits): number of shingles, digest and bitmap of the set."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches):
            sets = shingle_sets(batch)
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()), pa.array([_bitmap(s) for s in sets], pa.binary())],
                names=["doc_id", "n", "d1", "d2", "bits"],
            )
    return docs.mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bits binary")


def _packed(bins: np.ndarray, columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
    """One row for each bin, the columns' values of it as bytes."""
    order = np.argsort(bins, kind="stable")
    own, first = np.unique(bins[order], return_index=True)
    edges = [*first.tolist(), len(order)]
    sorted_columns = [c[order] for c in columns]
    arrays = [pa.array([c[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for c in sorted_columns]
    while len(arrays) < 3:
        arrays.append(pa.array([b""] * len(own), pa.binary()))
    return pa.RecordBatch.from_arrays(
        [pa.array(own.astype(np.int64), pa.int64()), pa.array([kind] * len(own), pa.int32()), *arrays],
        names=["bin", "kind", "x", "y", "z"],
    )


PACKED = "bin bigint, kind int, x binary, y binary, z binary"
ENTRIES, PAIRS, SKETCHES = 0, 1, 2
SKETCH_BITS = 1024  # width of the bitmaps in the bins of the second round


def _star(entries: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by (entry, id): which are first of their bucket, and (smallest id, id) for the others."""
    new = np.ones(len(entries), bool)
    new[1:] = entries[1:] != entries[:-1]
    center = ids[new][np.cumsum(new) - 1]
    other = ~new & (center != ids)
    return new, center[other], ids[other]


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _index(docs: DataFrame, bands: Bands, bins: int, labelled: bool) -> DataFrame:
    """Packed index entries of (doc_id, text[, component]). Unlabelled: combined per block, with its star pairs."""
    def packed(entries: list, places: list, ids: list, labels: list, sketches: dict) -> Iterator[pa.RecordBatch]:
        e, own, d = np.concatenate(entries), np.concatenate(places), np.concatenate(ids)
        if labelled:
            yield _packed(own, [e, d, np.concatenate(labels)], ENTRIES)
            seen_in = np.unique(np.stack([own.astype(np.int64), d], axis=1), axis=0)
            bits = np.array([np.frombuffer(sketches[i][1], np.uint64) for i in seen_in[:, 1].tolist()])
            sizes = np.array([sketches[i][0] for i in seen_in[:, 1].tolist()], np.int64)
            yield _packed(seen_in[:, 0], [seen_in[:, 1], sizes, bits], SKETCHES)
            return
        order = np.lexsort((d, e))
        e, d, own = e[order], d[order], own[order]
        new, a, b = _star(e, d)
        yield _packed(own[new], [e[new], d[new]], ENTRIES)
        a, b = _unique_pairs(a, b)
        if len(a):
            yield _packed(texts.mix(a.astype(np.uint64)) % np.uint64(bins), [a, b], PAIRS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = ([], [], [], [], {}), 0, set()
        for batch in texts.blocks(batches):
            marks = batch.column(2).to_pylist() if labelled else [0] * batch.num_rows
            for doc_id, mark, found in zip(batch.column(0).to_pylist(), marks, shingle_sets(batch), strict=True):
                if not len(found) or (digest := _digest(found)) in seen:
                    continue  # a copy of a text of this block: its class is known
                seen.add(digest)
                own, places = bands.placed_entries(found)
                for part, values in zip(held, (own, places, np.full(len(own), doc_id, np.int64), np.full(len(own), mark, np.int64)), strict=False):
                    part.append(values)
                if labelled:
                    held[4][doc_id] = (len(found), _bitmap(found, SKETCH_BITS))
                size += len(own)
            if size >= FLUSH_ENTRIES:
                yield from packed(*held)
                held, size, seen = ([], [], [], [], {}), 0, set()
        if size:
            yield from packed(*held)

    return docs.mapInArrow(run, PACKED)


def _numbers(column: pd.Series, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in column]) if len(column) else np.zeros(0, dtype)


def _star_candidates(part: pd.DataFrame) -> pd.DataFrame:
    found, pairs = part[part["kind"] == ENTRIES], part[part["kind"] == PAIRS]
    e, d = _numbers(found["x"], np.uint64), _numbers(found["y"], np.int64)
    order = np.lexsort((d, e))
    _, a, b = _star(e[order], d[order])
    a, b = _unique_pairs(np.concatenate([a, _numbers(pairs["x"], np.int64)]), np.concatenate([b, _numbers(pairs["y"], np.int64)]))
    return pd.DataFrame({"a": a, "b": b})


def _cross_candidates(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs of each bucket whose components differ and whose sizes and bitmaps allow similarity."""
    own, sketches = part[part["kind"] == ENTRIES], part[part["kind"] == SKETCHES]
    e, d, c = _numbers(own["x"], np.uint64), _numbers(own["y"], np.int64), _numbers(own["z"], np.int64)
    ids, first = np.unique(_numbers(sketches["x"], np.int64), return_index=True)
    n = _numbers(sketches["y"], np.int64)[first]
    bits = _numbers(sketches["z"], np.uint64).reshape(-1, SKETCH_BITS // 64)[first]
    d = np.searchsorted(ids, d)  # from here on documents are rows of `ids`
    sizes = n[d]
    order = np.lexsort((d, sizes, e))
    e, d, c, sizes = e[order], d[order], c[order], sizes[order]
    edges = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1], [True]]))
    s, t = SIMILARITY

    def possible(held: list[np.ndarray]) -> pd.DataFrame:
        pairs = np.unique(np.concatenate(held))
        a, b = pairs // len(ids), pairs % len(ids)
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        good = (s + t) * differ <= (t - s) * (n[a] + n[b])
        a, b = ids[a[good]], ids[b[good]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    mixed = np.minimum.reduceat(c, edges[:-1]) != np.maximum.reduceat(c, edges[:-1]) if len(c) else []
    done, held, size = set(), [], 0
    for low, high in zip(edges[:-1][mixed].tolist(), edges[1:][mixed].tolist(), strict=True):
        if (key := d[low:high].tobytes()) in done:
            continue
        done.add(key)
        # in the order of sizes, the partners of a set end where sizes grow too large for it
        ends = low + np.searchsorted(s * sizes[low:high], t * sizes[low:high], side="right")
        for i, end in enumerate(ends.tolist(), low):
            other = d[i + 1 : end][c[i + 1 : end] != c[i]]
            if len(other):
                held.append(np.minimum(d[i], other) * len(ids) + np.maximum(d[i], other))
                size += len(other)
            if size > 500_000:
                yield possible(held)
                held, size = [], 0
    if held:
        yield possible(held)


def _cross_group(part: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *_cross_candidates(part)]).drop_duplicates()


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, possible): pairs whose sizes and bitmaps allow them to be similar; no text is needed for that."""
    both = pairs
    for end in ("a", "b"):
        both = both.join(sketches.select(F.col("doc_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True)
            out = pa.array([_may_be_similar(*row) for row in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["a", "b", "possible"])

    chosen = both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint, possible boolean")
    return materialize(chosen, "possible")


def _texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids in the pairs, written once; equal ids are copies of one text."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return materialize(docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "candidates")


def _similar_pairs(pairs: DataFrame, needed: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, on the whole texts, which are sent along once for each pair."""
    second = pairs.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, None
        for whole in batches:
            for batch in texts.blocks([whole], "text_b"):
                sets = shingle_sets(batch.select(["text_b"]).rename_columns(["text"]))
                out = []
                for i, a in enumerate(batch.column(0).to_pylist()):
                    if a != known:
                        known, own = a, shingle_sets(batch.slice(i, 1).select(["text_a"]).rename_columns(["text"]))[0]
                    out.append(_similar(own, sets[i]))
                yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"), "links")


def _frequent(docs: DataFrame, n_rows: int) -> tuple[np.ndarray, float, float]:
    """Shingles that several sampled sets hold (the FREQUENT most frequent), and two measures of the sample.

    The second is the chance that one of the other shingles is in another given set, the third
    twice the share of the frequent ones in all sets, as an estimate for sets that have many.
    """
    every = max(1, n_rows // SAMPLE_SETS)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(every)) == 0)

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches):
            distinct = list({s.tobytes(): s for s in shingle_sets(batch)}.values())
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *distinct]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"])

    held = sample.mapInArrow(shingles, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    held = materialize(held, "sampled-shingles")
    top = held.filter(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").collect()
    frequent = np.sort(np.array([r["shingle"] for r in top], np.int64).view(np.uint64))
    n, rare = F.col("n"), F.col("n") < FREQUENT_FROM
    total, rare_total, shared = held.agg(F.sum(n), F.sum(F.when(rare, n)), F.sum(F.when(rare, n * (n - 1)))).first()
    if not total:
        return frequent, 0.0, 0.0
    overlap = float(shared or 0) / max(float(rare_total or 0) * (n_rows / every), 1.0)
    return frequent, min(0.5, overlap), min(0.6, 2 * (1 - float(rare_total or 0) / float(total)))


def join_components(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set) and component_id of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(row_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(profile(docs), "profile")
    classes = rows.filter("doc_id IS NOT NULL AND n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"))
    joined = join_dealt(rows.drop("bits"), classes, ["d1", "d2", "n"], "left")
    members = materialize(joined.select("doc_id", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")), "members")
    one = members.filter("doc_id = class_id AND n > 0").select("doc_id", "n").distinct()
    n_sets, largest = one.agg(F.count(F.lit(1)), F.max("n")).first()
    links = spark.createDataFrame([], "a bigint, b bigint")
    if n_sets:
        texted = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
        frequent, overlap, share = _frequent(texted, n_sets)
        bands = Bands(largest, n_sets, overlap, frequent, share)
        # sizes to within a quarter are enough to spread the bins
        step = F.floor(F.log(F.col("n").cast("double")) / math.log(1.25))
        bins = bands.spread([(1.25 ** r["step"], r["count"]) for r in one.groupBy(step.alias("step")).count().collect()])
        sketches = rows.filter("doc_id IS NOT NULL AND n > 0").select("doc_id", "n", "bits").dropDuplicates(["doc_id"])
        links = _linked(texted, members, sketches, bands, bins)
    parts = connected_components(links)
    return (
        members.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id")).alias("component_id"),
        )
    )


def _by_class(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pairs of class representatives."""
    to = members.filter("n > 0").select("doc_id", "class_id").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(to.withColumnRenamed("doc_id", end), end).drop(end).withColumnRenamed("class_id", end)
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(docs: DataFrame, members: DataFrame, sketches: DataFrame, bands: Bands, bins: int) -> DataFrame:
    """(a, b): links between class representatives that connect every component."""
    first = _index(docs, bands, bins, False).repartition(bins, "bin").groupBy("bin").applyInPandas(_star_candidates, "a bigint, b bigint")
    pairs = _possible(_by_class(first, members), sketches)
    needed = _texts_of(pairs, docs)
    links = _similar_pairs(pairs.filter("possible").select("a", "b"), needed)
    parts = materialize(connected_components(links), "parts")
    # compared pairs whose ends are in different components failed; buckets with one are open
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    labelled = materialize(nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labelled")
    apart = pairs.select("a", "b")
    for end in ("a", "b"):
        apart = apart.join(labelled.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}")), end)
    apart = apart.filter("part_a <> part_b")
    open_parts = apart.select(F.col("part_a").alias("component")).union(apart.select("part_b")).distinct()
    again = materialize(labelled.join(open_parts, "component", "left_semi").select(F.col("node").alias("doc_id"), "component"), "open")
    if again.isEmpty():
        return links
    indexed = _index(needed.join(again, "doc_id").select("doc_id", "text", "component"), bands, bins, True)
    crossing = indexed.repartition(bins, "bin").groupBy("bin").applyInPandas(_cross_group, "a bigint, b bigint").distinct()
    more = _possible(crossing.join(pairs, ["a", "b"], "left_anti"), sketches).filter("possible")
    return links.unionByName(_similar_pairs(more.select("a", "b"), needed))


def keep_one(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without those linked to a smaller id; rows with a NULL id stay."""
    found = join_components(docs, row_id, text)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[row_id] == gone["_gone"], "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


@query("op5_jaccard_join", SQL)
def op5_jaccard_join(spark, folder):
    return join_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
