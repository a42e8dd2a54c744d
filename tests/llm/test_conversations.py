"""The conversation trie against a plain one built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fieldpulse.llm import conversation_trie as trie
from fieldpulse.llm.queries import QUERIES

KIND = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, who in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(who) - 1) * len(key[-1][1]) if key else 0
    return sorted(
        (who[0], len(key), members[key[:-1]][0] if key else None, len(who), children[key], leaves[key], saved[key],
         hashlib.sha256(",".join(map(str, ends[key])).encode()).hexdigest())
        for key, who in members.items()
    )


def built_by_spark(df, **sizes):
    turns, lengths = trie.rebuilt(trie.turns_of(df))
    return sorted(tuple(r) for r in trie.prefix_trie(turns, lengths, **sizes).collect())


def made_up(n=400):
    rng = random.Random(9)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(120), rng.randrange(-250, 900), 100 * rng.randrange(4), 700])
        rows.append((c, rng.choice([None, rng.randrange(8)]), rng.choice(["user", "assistant", None, ""]), rng.choice(["é日", "hi", "", None, "x" * 2000])))
    rows += [(800 + i, t, "user", "the same") for i in range(60) for t in range(6)]  # a large group of copies
    rows += [(None, 1, "user", "nobody"), (5, 3, "user", "twice"), (5, 3, "user", "twice")]
    return rows


@pytest.mark.parametrize(("limit", "run"), [(50_000, 4096), (60, 3)])
def test_against_a_plain_trie(spark, monkeypatch, limit, run):
    monkeypatch.setattr(trie, "RUN", run)
    rows = made_up()
    got = built_by_spark(spark.createDataFrame(rows, KIND).repartition(5), limit=limit)
    assert got == plain(rows)


def test_long_conversation(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(800)] + [(7, t, "user", f"turn {t}") for t in range(10)]
    assert built_by_spark(spark.createDataFrame(rows, KIND), limit=300) == plain(rows)


def test_query_on_the_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_trie"].run(spark, folder)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_empty_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], KIND)
    assert built_by_spark(none) == []
    assert built_by_spark(spark.createDataFrame([(None, 1, "user", "x")], KIND)) == []
    turnless = [(205, 0, "user", "x"), (301, None, None, None)]
    assert built_by_spark(spark.createDataFrame(turnless, KIND)) == plain(turnless)
    rows = made_up(40)
    clashing = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("c", "d", "m", "digest", "chars", "place", "part", "n", "size", "depth")})
    assert built_by_spark(clashing) == plain(rows)


@pytest.mark.parametrize("shape", ["random", "chain", "star", "forest"])
def test_decomposition_of_forests(shape):
    rng, n = np.random.default_rng(4), 2000
    parent = {"random": lambda i: rng.integers(0, i), "chain": lambda i: i - 1, "star": lambda i: 0, "forest": lambda i: rng.integers(-1, i)}[shape]
    parents = np.array([-1, *(parent(i) for i in range(1, n))])
    weights = rng.integers(-5, 50, (n, 2))
    size, want = np.ones(n, np.int64), weights.copy()
    for i in range(n - 1, 0, -1):
        if parents[i] >= 0:
            size[parents[i]] += size[i]
            want[parents[i]] += want[i]
    names = rng.permutation(n)  # nodes in any order
    mixed = np.empty(n, np.int64)
    mixed[names] = np.where(parents >= 0, names[parents], -1)
    got = trie.decompose(mixed, size[np.argsort(names)], weights[np.argsort(names)])
    assert (got == want[np.argsort(names)]).all()
