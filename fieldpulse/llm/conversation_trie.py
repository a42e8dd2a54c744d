"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

Every conversation is a sequence of (role, text) turns. Each different beginning of sequences is a
node; its name is the smallest conversation that begins so, with the depth. Nodes are found by
one aggregation over all turns: a beginning is known by the sum, over its turns, of a SHA-256 of
place and turn. Such sums need no walk along a conversation: a conversation of any length is cut
into runs of `RUN` turns, which are added up first.

Subtree totals come from a centroid decomposition. While a component of the forest has more than
`LIMIT` nodes, a round finds its centroid (the deepest node below which at least half of it
lies), adds the total of the centroid's side to all nodes on the way from the centroid to the
component's top, and splits the component: each child of the centroid becomes the top of a
component, the rest stays one. Every round at least halves the large components, so the rounds
grow with the logarithm of the trie, and a long conversation is no long chain of steps. Smaller
components are dealt by hash to tasks of about `LIMIT` nodes, which go on by the same rule with
numpy, all components of a task at once.

Defined cases: rows with a NULL conv_id name no conversation and are left out; turns are ordered by
number, NULL first, equal numbers by role and text; repeated rows are turns of their own; a NULL
role or text is empty; `%` has the sign of its left side; texts of any length are hashed whole;
an empty table has no conversation and no node; further columns of any name are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldpulse.llm.registry import query, table
from fieldpulse.session import materialize

LIMIT = 50_000  # nodes of a component, or of several, that one task decomposes
RUN = 4096  # turns of a conversation summed in one group
LIMBS = 8
HEAD = 5  # most turns that the rebuilding rule takes over
PIECE_BYTES = 1 << 16
ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
NONE_SHA256 = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, j, digest, chars): turns numbered from 0 in each conversation.

    All rows are sorted and written once; a turn's number is its place in the partition, less
    the place where its conversation begins there, plus the turns in partitions before.
    """
    role, text = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in (role, text))
    rows = conversations.filter(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("bigint").alias("c"), F.col(f"`{turn}`").alias("turn"), role.alias("role"), text.alias("text")
    )
    body = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")
    ordered = rows.orderBy("c", F.col("turn").asc_nulls_first(), "role", "text").select(
        "c", F.sha2(body, 256).alias("digest"), F.char_length("text").cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("place"),
    )
    ordered = materialize(ordered, "turns").withColumn("part", F.shiftright("place", ROW_BITS))
    pieces = ordered.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("begin"))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.select("c", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("begin")).alias("shift"))
    return ordered.join(shift, ["c", "part"]).select("c", (F.col("place") + F.col("shift")).alias("j"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, p, digest, chars) of the rebuilt conversations, and (c, size) of all of them.

    Conversation c begins with the first h turns of conversation c - c % 100 and goes on with its
    own turns after its first h; h is the unsigned CRC-32 of its number in decimal, modulo 6.
    """
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(
        "c", "n", (F.crc32(F.col("c").cast("string").cast("binary")) % (HEAD + 1)).alias("h"), (F.col("c") - F.col("c") % 100).alias("base")
    )
    lengths = convs.filter("c = base").select("base", F.col("n").alias("base_n"))
    convs = materialize(
        convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
        .select("c", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    heads = turns.filter((F.col("c") % 100 == 0) & (F.col("j") < HEAD)).withColumnRenamed("c", "base")
    begun = convs.select("c", "base", "h").join(heads, "base").filter("j < h").select("c", F.col("j").alias("p"), "digest", "chars")
    own = turns.join(convs.select("c", "h", "taken"), "c").filter("j >= h").select("c", (F.col("j") - F.col("h") + F.col("taken")).alias("p"), "digest", "chars")
    return begun.unionByName(own), convs.select("c", "size")


def _limbs(text: Column, limbs: int, digits: int) -> list[Column]:
    """Numbers of `digits` hexadecimal digits each from the SHA-256 of a text."""
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + digits * i, digits), 16, 10).cast("bigint") for i in range(limbs)]


def beginnings(turns: DataFrame) -> DataFrame:
    """(c, d, k1, k2, p1, p2, chars): the key of the first d turns of each conversation, and of the first d - 1."""
    terms = turns.select("c", (F.col("p") + 1).alias("d"), "chars", F.struct(*[
        x.alias(f"x{i}") for i, x in enumerate(_limbs(F.concat_ws(":", F.col("p").cast("string"), "digest"), LIMBS, 64 // LIMBS))
    ]).alias("x")).select("c", "d", "chars", "x.*", F.floor((F.col("d") - 1) / RUN).alias("run"))
    names = [f"x{i}" for i in range(LIMBS)]
    terms = materialize(terms, "turn-terms")
    runs = terms.groupBy("c", "run").agg(*[F.sum(x).alias(x) for x in names])
    earlier = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("c", "run", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"b{x}") for x in names]).filter("run > 0")
    within = Window.partitionBy("c", "run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    sums = terms.select("*", *[F.sum(x).over(within).alias(f"s{x}") for x in names]).join(before, ["c", "run"], "left")
    whole = [F.col(f"s{x}") + F.coalesce(f"b{x}", F.lit(0)) for x in names]
    here = F.concat_ws(",", F.col("d").cast("string"), *[w.cast("string") for w in whole])
    above = F.concat_ws(",", (F.col("d") - 1).cast("string"), *[(w - F.col(x)).cast("string") for w, x in zip(whole, names, strict=True)])
    keys = [k.alias(n) for n, k in zip(("k1", "k2", "p1", "p2"), [*_limbs(here, 2, 15), *_limbs(above, 2, 15)], strict=True)]
    return sums.select("c", "d", *keys, "chars")


def _find_nodes(begun: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (m, d, pm, n, chars), named by their smallest member m and depth d; and places (c, d, m) on every conversation's path."""
    found = begun.groupBy("k1", "k2").agg(
        F.min("c").alias("m"), F.min("d").alias("d"), F.count(F.lit(1)).alias("n"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    found = materialize(found, "trie-keys")
    first, n = sizes.agg(F.min("c"), F.count(F.lit(1))).first()  # the root's two numbers
    first = F.lit(first).cast("bigint")
    parents = found.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("m").alias("pm"))
    below = found.join(parents, ["p1", "p2"], "left")
    below = below.select("m", "d", F.when(F.col("d") == 1, first).otherwise(F.col("pm")).alias("pm"), "n", "chars")
    number = lambda value: F.lit(value).cast("bigint")
    top = found.sparkSession.range(1 if n else 0).select(
        first.alias("m"), number(0).alias("d"), number(None).alias("pm"), number(n).alias("n"), number(0).alias("chars"))
    places = begun.join(found.select("k1", "k2", "m"), ["k1", "k2"]).select("c", "d", "m")
    starts = sizes.select("c", number(0).alias("d"), first.alias("m"))
    return materialize(below.unionByName(top), "trie-nodes"), materialize(places.unionByName(starts), "trie-places")


def _forest(nodes: DataFrame, places: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes as one component with the number of nodes below each, and the paths of the naming conversations.

    A conversation names the nodes from some depth of its path to the end, so the nodes below a
    node are counted by the conversations that pass through it.
    """
    names = places.filter("c = m").groupBy("c").agg(F.min("d").alias("b"))
    paths = materialize(places.join(names, "c").join(sizes, "c"), "trie-paths")
    below = paths.groupBy("m", "d").agg(F.sum(F.col("size") - F.greatest("d", "b") + 1).alias("size"))
    children = nodes.filter("d > 0").groupBy(F.col("pm").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(below, ["m", "d"]).join(children, ["m", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    top = nodes.filter("d = 0").first()
    full = full.withColumns({"tm": F.lit(top["m"] if top else None).cast("bigint"), "td": F.lit(0).cast("bigint")})
    forest = full.select("m", "d", "pm", "n", "n_children", "size", "tm", "td", (F.col("n_children") == 0).cast("bigint").alias("leaves"),
                         ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    return materialize(forest, "trie-forest"), paths.select("c", "d", "m")


def _split_large(forest: DataFrame, paths: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Parts of the forest with no component above `limit` nodes, and what the rounds add (m, d, leaves, saved)."""
    small, added = [], []
    columns = ["m", "d", "pm", "size", "tm", "td", "leaves", "saved"]
    rest = forest.select(*columns)
    while True:
        tops = rest.filter("m = tm AND d = td").select("tm", "td", F.col("size").alias("total"))
        large = tops.filter(F.col("total") > limit)
        small.append(rest.join(large.select("tm", "td"), ["tm", "td"], "left_anti").select(*columns))
        if large.isEmpty():
            return small, added
        rest = rest.join(large, ["tm", "td"])
        heavy = rest.filter("2 * size >= total")  # a chain from the top down
        deepest = heavy.groupBy("tm", "td").agg(F.max("d").alias("xd"))
        centres = materialize(heavy.join(deepest, ["tm", "td"]).filter("d = xd").select("tm", "td", F.col("m").alias("xm"), "xd", F.col("size").alias("xsize")), "centroids")
        at = rest.join(centres, ["tm", "td"])
        passed = paths.select(F.col("c").alias("m"), F.col("d").alias("xd"), F.col("m").alias("am"))
        through = paths.select(F.col("c").alias("m"), (F.col("d") - 1).alias("xd"), F.col("m").alias("cm"))
        at = at.join(passed, ["m", "xd"], "left").join(through, ["m", "xd"], "left")
        inside = (F.col("d") >= F.col("xd")) & F.coalesce(F.col("am") == F.col("xm"), F.lit(False))
        at = materialize(at.select(*columns, "xd", "xm", "xsize", "cm", inside.alias("inside")), "split")
        totals = at.filter("inside").groupBy("tm", "td").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        way = centres.join(totals, ["tm", "td"]).join(paths.select(F.col("c").alias("xm"), "d", "m"), "xm").filter("d BETWEEN td AND xd")
        way = materialize(way.select("m", "d", "leaves", "saved", "xsize"), "centroid-paths")
        added.append(way.select("m", "d", "leaves", "saved"))
        under = at.filter("inside AND d > xd").withColumns({"tm": F.col("cm"), "td": F.col("xd") + 1}).select(*columns)
        lessened = way.select("m", "d", F.col("xsize").alias("less"))
        above = at.filter("NOT inside").join(lessened, ["m", "d"], "left").withColumn("size", F.col("size") - F.coalesce("less", F.lit(0))).select(*columns)
        rest = materialize(under.unionByName(above), "components")


def decompose(parent: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Subtree sums of `weights` (columns) in a forest: `parent` is -1 at the tops, `size` counts the nodes below and itself."""
    n = len(parent)
    order = np.lexsort((np.arange(n), parent))
    before = np.cumsum(size[order]) - size[order]
    first = np.concatenate([[True], parent[order][1:] != parent[order][:-1]])
    offset = np.empty(n, np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    begin, above = offset + (parent >= 0), parent.copy()
    while (above >= 0).any():  # each step doubles the length of the way added up
        below = np.flatnonzero(above >= 0)
        begin[below], above[below] = begin[below] + begin[above[below]], above[above[below]]
    end = begin + size  # the tree in depth-first order: a subtree is a range
    node = np.argsort(begin, kind="stable")
    component = np.cumsum(parent[node] < 0) - 1
    sums = np.zeros_like(weights)
    while len(node):
        key = component * np.int64(n + 1) + begin[node]
        stop = np.searchsorted(key, component * np.int64(n + 1) + end[node])
        here = np.arange(len(node))
        head = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1]]))
        total = np.diff(np.append(head, len(node)))
        which = np.repeat(np.arange(len(head)), total)
        heavy = 2 * (stop - here) >= total[which]
        centre = np.maximum.reduceat(np.where(heavy, here, -1), head)
        running = np.concatenate([np.zeros((1, weights.shape[1]), weights.dtype), np.cumsum(weights[node], axis=0)])
        gained = running[stop[centre]] - running[centre]
        on_way = (here <= centre[which]) & (end[node] >= end[node[centre]][which])
        sums[node[on_way]] += gained[which[on_way]]
        inside = (here > centre[which]) & (here < stop[centre][which])
        child = parent[node] == node[centre][which]
        component = np.where(inside, len(head) + np.cumsum(child), which)
        stays = here != centre[which]
        node, component = node[stays], component[stays]
        order = np.argsort(component, kind="stable")
        node, component = node[order], component[order]
    return sums


def _decompose_task(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.reset_index(drop=True)
    numbers = rows[["m", "d"]].assign(at=np.arange(len(rows)))
    numbers = numbers.rename(columns={"m": "pm", "d": "pd", "at": "parent"})
    top = (rows["m"] == rows["tm"]) & (rows["d"] == rows["td"])
    found = rows.assign(pd=rows["d"] - 1)[["pm", "pd"]].merge(numbers, "left", ["pm", "pd"])["parent"]
    parent = np.where(top, -1, found.fillna(-1).to_numpy()).astype(np.int64)
    sums = decompose(parent, rows["size"].to_numpy(np.int64), rows[["leaves", "saved"]].to_numpy(np.int64))
    return pd.DataFrame({"m": rows["m"], "d": rows["d"], "leaves": sums[:, 0], "saved": sums[:, 1]})


def rollup(forest: DataFrame, paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(m, d, leaves, saved) summed over the subtree of every node."""
    parts, added = _split_large(forest, paths, limit)
    small = functools.reduce(DataFrame.unionByName, parts)
    bins = -(-forest.count() // limit)
    small = small.withColumn("bin", F.pmod(F.xxhash64("tm", "td"), F.lit(max(bins, 1))))
    local = small.groupBy("bin").applyInPandas(_decompose_task, "m bigint, d bigint, leaves bigint, saved bigint")
    return functools.reduce(DataFrame.unionByName, added, local).groupBy("m", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (m, d, c) to pieces of the list of c of each node."""
    for batch in batches:
        m, d, c = (x.to_numpy() for x in batch.columns)
        cut = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (d[1:] != d[:-1])])) if len(m) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(m)], strict=True):
            for i in range(a, b, PIECE_BYTES // 20):
                part = c[i : min(b, i + PIECE_BYTES // 20)]
                out.append((m[a], d[a], part[0], ",".join(map(str, part.tolist())).encode()))
        for i in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 500], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["m", "d", "first", "piece"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to the digest of each node's whole list, read piece by piece."""
    last, state, out = None, None, []
    for batch in batches:
        for m, d, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if (m, d) == last:
                state.update(b",")
            else:
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = (m, d), hashlib.sha256()
            state.update(piece.as_py())
        if len(out) > 5000:
            yield _digests(out)
            out = []
    if last is not None:
        yield _digests([*out, (*last, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    m, d, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(d, pa.int64()), pa.array(digest, pa.string())], names=["m", "d", "ends_sha256"])


def _ends(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """(m, d, ends_sha256) of the nodes where conversations end."""
    ends = sizes.join(places, [sizes["c"] == places["c"], sizes["size"] == places["d"]]).select(places["m"], places["d"], places["c"])
    ends = ends.repartitionByRange("m", "d", "c").sortWithinPartitions("m", "d", "c")
    pieces = ends.mapInArrow(_listed, "m bigint, d bigint, first bigint, piece binary")
    return pieces.repartition("m", "d").sortWithinPartitions("m", "d", "first").mapInArrow(_hashed, "m bigint, d bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of `turns` (c, p, digest, chars); `sizes` (c, size) lists all conversations."""
    begun = materialize(beginnings(turns), "beginnings")
    nodes, places = _find_nodes(begun, sizes)
    forest, paths = _forest(nodes, places, sizes)
    sums = rollup(forest, paths, limit)
    return forest.select("m", "d", "pm", "n", "n_children").join(sums, ["m", "d"]).join(_ends(places, sizes), ["m", "d"], "left").select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("pm").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256"),
    )


SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS j,
       {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) AS n, c - c % 100 AS base, string_split(c::VARCHAR, '') AS s FROM t GROUP BY c),
v AS (SELECT c, n, base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(s, lambda y: ascii(y)::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda w, z: xor(w >> 1, 3988292384 * (w & 1)))), 4294967295) % 6 AS h FROM k),
w AS (SELECT v.c, t.j AS p, t.x FROM v JOIN t ON t.c = v.base AND t.j < v.h
      UNION ALL
      SELECT t.c, t.j - v.h + least(v.h, coalesce(b.n, 0)), t.x FROM t JOIN v ON v.c = t.c LEFT JOIN v b ON b.c = v.base WHERE t.j >= v.h),
a AS (SELECT c, p + 1 AS d, list(x) OVER (PARTITION BY c ORDER BY p) AS s, length(x.t) AS chars FROM w UNION ALL SELECT c, 0, [], 0 FROM v),
o AS (SELECT d, s, min(c) AS m, count(*) AS n, min(chars) AS chars FROM a GROUP BY d, s),
e AS (SELECT a.c, a.d, o.m FROM a JOIN o ON o.d = a.d AND o.s = a.s),
p AS (SELECT o.m, o.d, o.n, o.chars, e.m AS pm FROM o LEFT JOIN e ON e.c = o.m AND e.d = o.d - 1),
q AS (SELECT pm AS m, d - 1 AS d, count(*) AS n_children FROM p WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN q ON q.m = p.m AND q.d = p.d),
r AS (SELECT e.m, e.d, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n - 1) * f.chars) AS saved FROM f JOIN e ON e.c = f.m AND e.d <= f.d GROUP BY 1, 2),
l AS (SELECT c, max(d) AS d FROM a GROUP BY c),
g AS (SELECT e.m, e.d, string_agg(e.c::VARCHAR, ',' ORDER BY e.c) AS ends FROM e JOIN l ON l.c = e.c AND l.d = e.d GROUP BY 1, 2)
SELECT f.m AS conv_id, f.d AS depth, f.pm AS parent_conv_id, f.n AS n_convs, f.n_children, r.n_leaves::BIGINT AS n_leaves,
       r.saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM f JOIN r ON r.m = f.m AND r.d = f.d LEFT JOIN g ON g.m = f.m AND g.d = f.d
"""


@query("op11_conversation_trie", SQL)
def op11_conversation_trie(spark, folder):
    turns, sizes = rebuilt(materialize(turns_of(table(spark, folder, "conversations")), "numbered-turns"))
    return prefix_trie(turns, sizes)
