"""Jaccard join, suffix dedup and components against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldpulse.llm import components, jaccard_join, suffix_dedup
from fieldpulse.llm.dealing import join_dealt
from fieldpulse.llm.queries import QUERIES
from fieldpulse.session import materialize


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(docs):
    sets, where, groups = {d: shingles(t) for d, t in docs}, defaultdict(list), Sets()
    for d in sorted(sets):
        common = Counter(y for x in sets[d] for y in where[x])
        for y, n in common.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[y]) - n):
                groups.join(d, y)
        for x in sets[d]:
            where[x].append(d)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def check_join(df, docs):
    want = plain_components(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    assert got == want
    return want


def test_join_on_the_table(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = check_join(QUERIES["op5_jaccard_join"].run(spark, folder), docs)
    assert len({c for _, c in want.values()}) < len(docs)


def near_copies(seed, n, chain):
    """Chains of small edits: neighbours are similar, ends are not; so buckets hold failed pairs."""
    pick, docs = random.Random(seed), []
    words = [f"w{i}" for i in range(4000)]
    for _ in range(n):
        text = pick.choices(words, k=pick.choice([3, 5, 9, 30, 60, 200]))
        for _ in range(chain):
            docs.append(" ".join(text))
            text = list(text)
            for _ in range(max(1, len(text) // 60)):
                text[pick.randrange(len(text))] = pick.choice(words)
    pick.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_edits(spark, seed):
    docs = near_copies(seed, 12, 9)
    check_join(jaccard_join.join_components(spark.createDataFrame(docs, "doc_id bigint, text string")), docs)


def test_every_similar_pair_shares_an_entry():
    pick = np.random.default_rng(5)
    for overlap, share in ((0.0, 0.0), (0.3, 0.0), (0.01, 0.6)):
        frequent = pick.integers(0, 2**63, 500, dtype=np.uint64)
        bands = jaccard_join.Bands(3000, 100_000, overlap, frequent, share)
        for size in (1, 2, 4, 5, 8, 9, 17, 40, 99, 500, 2500):
            for _ in range(12):
                x = pick.integers(0, 2**63, size, dtype=np.uint64)
                x = np.unique(np.concatenate([x[size // 2 :], pick.choice(frequent, size // 2)]) if share else x)
                gone = int(pick.integers(0, size // 5 + 1))
                added = pick.integers(0, 2**63, int(pick.integers(0, size // 8 + 1)), dtype=np.uint64)
                y = np.unique(np.concatenate([pick.permutation(x)[gone:], added]))
                if len(y) and jaccard_join._similar(x, y):
                    assert len(np.intersect1d(bands.entries(x), bands.entries(y)))


def test_bitmaps_never_refuse_a_similar_pair():
    pick = np.random.default_rng(11)
    refused = 0
    for _ in range(400):
        x = np.unique(pick.integers(0, 2**63, int(pick.integers(1, 300)), dtype=np.uint64))
        y = np.unique(np.concatenate([x[pick.random(len(x)) > pick.random() * 0.4], pick.integers(0, 2**63, int(pick.integers(0, 40)), dtype=np.uint64)]))
        if not len(y):
            continue
        possible = jaccard_join._may_be_similar(len(x), len(y), jaccard_join._bitmap(x), jaccard_join._bitmap(y))
        assert possible or not jaccard_join._similar(x, y)
        refused += not possible
    assert refused > 100


def test_crossing_bins_lose_no_similar_pair():
    docs = near_copies(3, 14, 9)
    sets = jaccard_join.shingle_sets(pa.RecordBatch.from_arrays([pa.array([t for _, t in docs])], names=["text"]))
    bands = jaccard_join.Bands(300, 200, 0.01)
    bands.spread([(30.0, 50), (200.0, 60)])
    ids = np.arange(len(sets), dtype=np.int64)
    entries = [bands.entries(s) if len(s) else np.zeros(0, np.uint64) for s in sets]
    owner = np.repeat(ids, [len(e) for e in entries])
    sketches = [jaccard_join._bitmap(s, jaccard_join.SKETCH_BITS) for s in sets]
    part = pd.DataFrame([
        {"kind": jaccard_join.ENTRIES, "x": np.concatenate(entries).tobytes(), "y": owner.tobytes(), "z": owner.tobytes()},
        {"kind": jaccard_join.SKETCHES, "x": ids.tobytes(), "y": np.array([len(s) for s in sets], np.int64).tobytes(), "z": b"".join(sketches)},
    ])
    got = {tuple(r) for r in jaccard_join._cross_group(part).itertuples(index=False)}
    same = lambda x, y: x.tobytes() == y.tobytes()
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and not same(x, y) and jaccard_join._similar(x, y)}
    assert want and want <= got | {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if same(x, y)}


def test_allocations_use_deletions_and_left_out_segments():
    chosen = {c for n, overlap in ((10, 0.0), (10**9, 0.2), (10**12, 0.45)) for c in jaccard_join.Bands(5000, n, overlap).choice}
    assert any(out for out, _ in chosen) and any(two for _, two in chosen)


def test_join_edge_rows(spark, edge, none, edge_rows):
    rows = jaccard_join.join_components(edge).collect()
    assert len(rows) == len(edge_rows)
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert of[1] == [(0, 1)] and of[2] == [(0, 2)] and of[3] == [(0, 3)] and of[None] == [(1, None)]
    assert of[8][0][1] == 7 and [c for _, c in of[7]] == [7, 7]
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(edge_rows) - 1
    assert jaccard_join.join_components(none).count() == 0 == jaccard_join.keep_one(none).count()


def test_components(spark):
    pick = random.Random(4)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1400)]
    groups = Sets()
    for a, b in links:
        groups.join(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: groups.find(n) for a, b in links if a != b for n in (a, b)}


def plain_removal(docs, length=50):
    first, out = {}, {}
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        gone, own = bytearray(len(raw)), set()
        for i in range(len(raw) - length + 1):
            own.add(raw[i : i + length])
            if raw[i : i + length] in first:
                gone[i : i + length] = b"\1" * length
        for w in own:
            first.setdefault(w, doc_id)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc_id] = (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def check_removal(df, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}
    want = plain_removal(docs)
    assert got == want
    return want


def test_removal_on_the_table(spark, folder, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BIN_BYTES", 100_000)
    monkeypatch.setattr(suffix_dedup, "RUN_SUFFIXES", 3_000)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = check_removal(QUERIES["op3_suffix_dedup"].run(spark, folder), docs)
    assert sum(w[1] for w in want.values())


def test_removal_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BIN_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "RUN_SUFFIXES", 50)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    pick = random.Random(6)
    base = "".join(pick.choices("abcdé \x00", k=3000))
    docs = [(0, base[:400]), (1, "x" * 200), (2, "x" * 49), (3, "x" * 50 + "y"), (4, base[351:800]), (5, base), (6, base[:49]),
            (7, "ab" * 300), (8, "ba" * 30), (9, base[100:160] + "!" + base[100:160]), (10, None), (11, "")]
    docs += [(20 + i, base[(a := pick.randrange(2900)) : a + pick.randrange(120)]) for i in range(40)]
    check_removal(suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")), docs)


def around_a_hot_gram(n):
    """Texts of 90 bytes around one gram that is the anchor of all their strings; some share a side, some all."""
    pick = random.Random(8)
    grams = np.random.default_rng(8).integers(97, 123, (20_000, 12), dtype=np.uint8)
    data = grams.ravel()
    eight = suffix_dedup._eight(data)
    later = np.concatenate([eight[4:], np.zeros(4, np.uint64)])
    hashes = suffix_dedup.texts.mix(eight * np.uint64(0x9E3779B97F4A7C15) ^ suffix_dedup.texts.mix(later))[::12]
    gram = grams[hashes.argmin()].tobytes().decode()
    sides = ["".join(pick.choices("klmnop", k=39)) for _ in range(n)]
    docs = []
    for i in range(n):
        left = sides[i] if i % 3 else sides[i // 9]
        right = sides[-i] if i % 4 else sides[i // 8]
        docs.append((i, left + gram + right))
    return docs


def test_hot_head_is_dealt_over_bins(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BIN_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "RUN_SUFFIXES", 50)
    docs = around_a_hot_gram(400)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    bins = suffix_dedup._bins(df, 15, len(docs))
    assert len(bins.hot) >= 1 and bins.number > 15
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1].encode() for d in docs])], names=["doc_id", "text"])
    sizes = {}
    for run in suffix_dedup._runs([batch]):
        run.combine()
        for bin_, blob in run.packed(bins):
            sizes[bin_] = sizes.get(bin_, 0) + len(suffix_dedup._unpacked(blob)[0])
    assert max(sizes.values()) < 2 * sum(sizes.values()) / len(sizes) and max(sizes) < bins.number
    want = check_removal(suffix_dedup.remove_repeats(df), docs)
    assert sum(w[1] > 0 for w in want.values()) > 50


def test_equal_hashes_of_unequal_strings(monkeypatch):
    """Strings are told apart by their bytes, whatever their hashes."""
    docs = around_a_hot_gram(60)
    cut = [(t[:30].encode(), (t[30:] + t)[:40].encode()) for _, t in docs]
    fronts, tails = zip(*[c for c in cut if len(c[0]) == 30 and len(c[1]) == 40], strict=True)
    n = len(fronts)
    args = (list(fronts) * 2, list(tails) * 2, np.full(2 * n, 12), np.arange(2 * n) % (n + 3), np.full(2 * n, 100))
    want = suffix_dedup._group_marks(*args)
    monkeypatch.setattr(suffix_dedup.texts, "hashes_of", lambda data, begin, end: np.zeros(len(begin), np.uint64))
    got = suffix_dedup._group_marks(*args)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True)) and len(want[0])


@pytest.mark.parametrize("n_runs", [1, 2, 3, 5, 8, 13])
def test_loser_tree(n_runs):
    pick = random.Random(n_runs)
    runs = [sorted(bytes(pick.choices(b"ab\x00", k=pick.randrange(12))) for _ in range(pick.randrange(40))) for _ in range(n_runs)]

    def shared(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    order, common = suffix_dedup.merge([(r, [0] + [shared(a, b) for a, b in zip(r[:-1], r[1:], strict=True)]) for r in runs])
    heads = [iter(r) for r in runs]
    merged = [next(heads[k]) for k in order]
    assert merged == sorted(x for r in runs for x in r)
    assert common[1:] == [shared(a, b) for a, b in zip(merged[:-1], merged[1:], strict=True)]


def test_removal_edge_rows(spark, edge, none, edge_rows):
    rows = suffix_dedup.remove_repeats(edge, with_text=True).collect()
    assert len(rows) == len(edge_rows)
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["n_bytes"] == 0 and of[None]["n_removed"] == 0 and of[7]["n_removed"] == 0
    assert of[8]["n_removed"] == of[8]["n_bytes"] and bytes(of[8]["kept"]) == b""
    assert of[4]["n_removed"] == 0  # repeats within one document stay
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_long_words_of_regular_build_are_told_apart(spark):
    """A word of 1024 bytes and its complement, on which polynomials modulo 2^64 agree."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    docs = [(1, f"p q r s {word}"), (2, f"p q r s {other}"), (3, f"p q r s {word}")]
    rows = jaccard_join.join_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 1}


def test_dealt_join_equals_join(spark):
    rows = materialize(spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 50 = 1 THEN NULL ELSE id % 700 END AS k"), "dealt-test")
    one = spark.range(-1, 650).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left"):
        got, plain = (sorted(map(tuple, df.select("id", "k", "v").fillna(-7).collect())) for df in (join_dealt(rows, one, ["k"], how), rows.join(one, "k", how)))
        assert got == plain
    assert join_dealt(rows.limit(0), one, ["k"]).count() == 0


def test_large_bucket_compares_sets_of_like_size_only():
    """2 000 sets of one bucket, all in components of their own, of 1 to 2 000 shingles."""
    n, words = 2000, jaccard_join.SKETCH_BITS // 64
    numbers = np.random.default_rng(1)
    bits = np.zeros((n, words), np.uint64)
    bits[:, 0] = numbers.integers(0, 2**63, n, dtype=np.uint64)
    ids, sizes = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    part = pd.DataFrame([
        {"kind": jaccard_join.ENTRIES, "x": np.zeros(n, np.uint64).tobytes(), "y": ids.tobytes(), "z": ids.tobytes()},
        {"kind": jaccard_join.SKETCHES, "x": ids.tobytes(), "y": sizes.tobytes(), "z": bits.tobytes()},
    ])
    got = {tuple(r) for r in jaccard_join._cross_group(part).itertuples(index=False)}
    want = set()
    for a in range(n):
        differ = np.bitwise_count(bits[a, 0] ^ bits[a + 1 :, 0]).astype(np.int64)
        fits = (100 * sizes[a] >= 80 * sizes[a + 1 :]) & (180 * differ <= 20 * (sizes[a + 1 :] + sizes[a]))
        want |= {(a, a + 1 + b) for b in np.flatnonzero(fits).tolist()}
    assert got == want and 0 < len(want) < n * n // 4
