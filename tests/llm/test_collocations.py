"""Phrase mining against a plain version that counts every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldpulse.llm import collocations
from fieldpulse.llm.queries import QUERIES


def plain(rows, least, top=2000, covered=80):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= least}
        longer = defaultdict(int)
        for p, c in frequent.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    part = " ".join(w[i : i + size])
                    longer[part] = max(longer[part], c)
        found = []
        for p, a in frequent.items():
            w = p.split(" ")
            if len(w) > 1 and not 100 * longer[p] >= covered * a:
                cuts = [(counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w))]
                score, _, (left, right) = min((2_000_000 * a // (x + y), k, (x, y)) for k, (x, y) in enumerate(cuts))
                found.append((-score, -a, p.encode(), p, left, right))
        for rank, (score, a, _, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p, -a, left, right, n[lang], -score))
    return sorted(out)


def made_up(n=300):
    rng = random.Random(11)
    words = ["the", "The", "of", "a\x00b", "日本", "É", "new", "york", "city", "x" * 300, "'s", "in-a"]
    breaks = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\x0b", "?", "\x1c "]
    rows = []
    for i in range(n):
        body = "".join(rng.choice(words) + rng.choice(breaks) for _ in range(rng.randrange(60)))
        rows.append((body + (" new york city hall" if i % 3 else ""), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_size": 9, "at_once": 2}, {"top": 5}])
def test_against_counting_everything(spark, sizes):
    rows = made_up()
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5, **sizes)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5, top=sizes.get("top", 2000))


def test_small_chunks(spark, monkeypatch):
    found = []
    rows = [(t.encode(), c) for t, c in made_up(40)]
    for limit in (1, 10**9):
        monkeypatch.setattr(collocations, "CHUNK_BYTES", limit)
        import pyarrow as pa
        batch = pa.record_batch({"lang": pa.array([(c or "und").encode() for _, c in rows], pa.binary()), "text": pa.array([t for t, _ in rows], pa.binary())})
        total = Counter()
        for chunk in collocations._chunks([batch]):
            total.update((chunk.langs[a], chunk.words[b]) for a, b in zip(chunk.lang.tolist(), chunk.code.tolist()))
        found.append(total)
    assert found[0] == found[1]


def test_query_on_the_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_collocations"].run(spark, folder).collect()) == plain(rows, 30)


def test_edge_rows(spark, edge, edge_rows, none):
    clashing = edge.withColumns({c: edge.doc_id for c in ("phrase", "n", "id", "word", "shard", "rank", "a", "l", "r", "f")})
    rows = [(r[1], r[2]) for r in edge_rows]
    assert sorted(tuple(r) for r in collocations.collocations(clashing, least=2).collect()) == plain(rows, 2)
    assert collocations.collocations(none).count() == 0


def test_large_counts_are_exact(spark):
    big = 4 * 10**15
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, 2 * big)]
    (cut,) = collocations._best_cuts(spark.createDataFrame(rows, "lang string, phrase string, words int, f bigint")).collect()
    assert cut["score"] == 2_000_000 * big // (3 * big + 1)


@pytest.mark.parametrize("alphabet", [3, 40, 256])
def test_double_array_holds_its_keys_only(alphabet):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, alphabet, (3000, 3)).astype(np.uint8), axis=0)
    trie = collocations.DoubleArray(keys)
    other = np.concatenate([keys, rng.integers(0, 256, (3000, 3)).astype(np.uint8)]).astype(np.int64)
    at, state = np.arange(len(other)), np.zeros(len(other), np.int64)
    for level in range(3):
        there, state = trie.step(state, other[at, level])
        at = at[there]
    accepted = dict(zip(at.tolist(), trie.accept[state].tolist()))
    number = {tuple(k): i for i, k in enumerate(keys.tolist())}
    assert accepted == {i: number[tuple(k)] for i, k in enumerate(other.tolist()) if tuple(k) in number}


@pytest.mark.parametrize("sizes", [{}, {"shard_size": 9, "at_once": 2}])
def test_levels_do_not_read_the_texts(spark, sizes):
    """One pass counts the words, the other writes their numbers; four levels come after them."""
    rows, seen = made_up(), spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "text string, lang string").mapInArrow(counting, "text string, lang string")
    frequent, _ = collocations.phrase_counts(docs, least=5, **sizes)
    assert frequent.filter("words = 4").count() > 0
    assert seen.value == 2 * len(rows)


def test_more_words_than_two_bytes_can_number(spark):
    names = [f"w{i}" for i in range(70_000)]
    rows = [(" ".join(names[i : i + 1000]) + ". " + " ".join(names[i : i + 3]), "en") for i in range(0, len(names), 1000)]
    frequent, _ = collocations.phrase_counts(spark.createDataFrame(rows, "text string, lang string"), least=2)
    got = {r["phrase"]: r["f"] for r in frequent.collect()}
    triples = [names[i : i + 3] for i in range(0, len(names), 1000)]
    assert got == {" ".join(t[a:b]): 2 for t in triples for a in range(3) for b in range(a + 1, 4)}
    few, _ = collocations.phrase_counts(spark.createDataFrame(rows, "text string, lang string"), least=1)
    assert few.count() == 70_000 + sum(70 * (1000 - k) for k in (1, 2, 3))
