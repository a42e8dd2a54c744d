"""Phrases of two to four words that occur more often together than their parts would let expect.

Per language, level by level: the words with enough occurrences are counted and numbered, and every
text is written once as the numbers of its words, 0 standing for what lies between pieces and for
rarer words, which no frequent phrase holds. The words are dealt by hash into shards of about
`SHARD`, sent in rounds of at most `SHARDS_AT_ONCE`; with several rounds the texts are written anew
in each. The levels read the numbers only. The candidates of a level are dealt by hash into shards
as well; a task per shard builds a double-array trie over the bytes of the numbers, and the tries are
broadcast in rounds of the same size, so what is sent at once is bounded whatever the number of
phrases. Every task puts all positions of a chunk into the root and advances them word by word; the
accepting states of a level are counted by `bincount`, and the counts of all tasks are summed. Where
neighbouring positions accept, the two phrases make one of the next level whose parts are all
frequent: no other phrase can be frequent (the Apriori rule). Those travel as one 64-bit number of
phrase and next word and are counted only up to the threshold in a chunk, to choose the next
candidates; the trie then counts their occurrences exactly. With several rounds the second phrase may
lie in another round; then the first one alone decides what is counted up to the threshold.

Defined cases: a NULL text is empty, a NULL language `und`; a phrase never crosses texts or pieces;
repeated rows all count; texts of any length are read whole, a chunk holding one text at least;
equal scores are ordered by occurrences, then by the phrase, so ties have one result; languages
without a candidate and empty tables give no rows; further columns of any name are not read.
"""

from __future__ import annotations

import functools
import io
import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldpulse.llm import text as texts
from fieldpulse.llm.registry import query, table
from fieldpulse.session import materialize

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words
SHARD = 400_000  # candidates of one trie
SHARDS_AT_ONCE = 8
CHUNK_BYTES = 6 << 20  # words worked on together, at 8 bytes each; at 4 bytes each once they are numbered
FLUSH_WORDS = 500_000
COVERED = 80  # per cent of the occurrences that lie in a longer candidate
TOP = 2000
SALTS = 64

# Ends of pieces (. , ; : ! ? and the line breaks 0A to 0D) become 0xFF, which UTF-8 never holds.
_BREAK = b"\xff"
_BETWEEN = b"\xfe"  # not in UTF-8 either
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))


def words_of(body: bytes) -> list[bytes]:
    """Words in order, with a break between pieces and after the last one."""
    return (body + b"\n").translate(_TABLE).replace(_BREAK, b" " + _BREAK + b" ").split()  # of white space only blanks are left


def _texts(block: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    for lang, body in zip(block.column("lang").to_pylist(), block.column("text"), strict=True):
        value = body.as_py()
        yield lang, words_of(value) if value else []


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word, and of all words (NULL), by language."""
    counts: dict[bytes, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(_BREAK, None)
            names, n = list(words), list(words.values())
            for begin in range(0, len(names), 50_000):
                part, numbers = names[begin : begin + 50_000], n[begin : begin + 50_000]
                yield _rows([lang] * len(part), part, numbers)
            yield _rows([lang], [None], [sum(n)])
        counts.clear()

    for block in texts.blocks(batches, "text"):
        for lang, words in _texts(block):
            counts[lang].update(words)
            if sum(map(len, counts.values())) > FLUSH_WORDS:
                yield from flush()
    yield from flush()


def _rows(lang: list, word: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.binary()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


class DoubleArray:
    """A trie over rows of digits (0 to 255) of equal length: child of s by d is `base[s] + d` where `check` names s."""

    def __init__(self, keys: np.ndarray):
        """`keys`: different rows, ascending; row i ends in the state whose `accept` is i."""
        n, depth = keys.shape
        node = np.zeros(n, np.int64)  # of each row, at the present level
        digits, parents, level_nodes, total = [], [], [node], 1
        for level in range(depth):
            fresh = np.ones(n, bool)
            fresh[1:] = (node[1:] != node[:-1]) | (keys[1:, level] != keys[:-1, level])
            parents.append(node[fresh])
            digits.append(keys[fresh, level].astype(np.int64))
            node = total + np.cumsum(fresh) - 1
            total += int(fresh.sum())
            level_nodes.append(node)
        parent, digit = np.concatenate(parents), np.concatenate(digits)
        inner, first = np.unique(parent, return_index=True)  # parents ascend
        base, size = _place(np.append(first, len(digit)), digit)
        base_of = np.zeros(total, np.int64)
        base_of[inner] = base
        state = np.zeros(total, np.int64)
        state[1:] = base_of[parent] + digit
        self.base, self.check, self.accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[state] = base_of
        self.check[state[1:]] = state[parent]
        self.accept[state[node]] = np.arange(n)

    def step(self, state: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have such a child, and these children."""
        child = self.base[state] + digit
        there = self.check[child] == state
        return there, child[there]


def _place(first: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, int]:
    """A base for every node such that no two children share a place; children of node i: digit[first[i]:first[i + 1]].

    Wide nodes get 256 places of their own. The others draw bases, all of a width at a time,
    keep those that are free and draw again. Single children fill free places in order.
    Place 0 is the root's; every base leaves room for 256 digits.
    """
    m = np.diff(first)
    rng = np.random.default_rng(7)
    wide = np.flatnonzero(m > 64)
    size = 256 * (len(wide) + 2)
    base = np.zeros(len(m), np.int64)
    base[wide] = 256 * np.arange(1, len(wide) + 1)
    used = np.zeros(size, bool)
    used[0] = True
    used[_flat(first, wide, base, digit)] = True
    for least, share in ((33, 0.04), (17, 0.07), (9, 0.12), (5, 0.2), (3, 0.35), (2, 0.5)):
        pending = np.flatnonzero((m >= least) & (m <= 64) & (base == 0))
        while len(pending):
            wanted = int((used.sum() + m[pending].sum()) / share) + 512
            if wanted > len(used):
                used = np.concatenate([used, np.zeros(wanted - len(used), bool)])
            base[pending] = rng.integers(1, len(used) - 256, len(pending))
            place = _flat(first, pending, base, digit)
            owner = np.full(len(used), -1, np.int64)
            who = np.repeat(pending, m[pending])
            owner[place[::-1]] = who[::-1]
            good = np.logical_and.reduceat(~used[place] & (owner[place] == who), np.cumsum(m[pending]) - m[pending])
            used[_flat(first, pending[good], base, digit)] = True
            pending = pending[~good]
    single = np.flatnonzero(m == 1)
    free = np.flatnonzero(~used[256:]) + 256
    lacking = len(single) - len(free)
    if lacking > 0:
        free = np.concatenate([free, len(used) + np.arange(lacking)])
    base[single] = free[: len(single)] - digit[first[single]]
    return base, int(max(len(used), free[-1] + 1 if len(free) else 0)) + 256


def _flat(first: np.ndarray, nodes: np.ndarray, base: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Places of all children of the nodes."""
    m = first[nodes + 1] - first[nodes]
    at = np.arange(m.sum()) + np.repeat(first[nodes] - (np.cumsum(m) - m), m)
    return digit[at] + np.repeat(base[nodes], m)


def _digits(symbols: np.ndarray, width: int) -> np.ndarray:
    return np.stack([(symbols >> (8 * (width - 1 - i))) & 255 for i in range(width)], axis=-1).astype(np.uint8)


def _builder(width: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        """The trie of one shard, packed; its phrases are placed in the order of their numbers."""
        codes = np.stack(rows["codes"].to_numpy()[np.argsort(rows["place"].to_numpy())]).astype(np.int64)
        trie = DoubleArray(_digits(codes, width).reshape(len(rows), -1))
        out = io.BytesIO()
        np.savez_compressed(out, base=trie.base, check=trie.check, accept=trie.accept, width=width, size=len(rows))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "packed": [out.getvalue()]})
    return build


class Shard:
    """An unpacked trie."""

    def __init__(self, packed: bytes):
        parts = np.load(io.BytesIO(packed))
        self.trie = DoubleArray.__new__(DoubleArray)
        self.trie.base, self.trie.check, self.trie.accept = parts["base"], parts["check"], parts["accept"]
        self.width, self.size = int(parts["width"]), int(parts["size"])

    def accepted(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a phrase of the shard begins, and its place. The last code is 0 and thus in no phrase."""
        at = np.flatnonzero(codes).astype(np.int32)
        state = np.zeros(len(at), np.int32)
        for step in range(length):
            sign = codes[at + step]
            for i in range(self.width):
                there, state = self.trie.step(state, (sign >> (8 * (self.width - 1 - i))) & 255)
                at, sign = at[there], sign[there]
        return at, self.trie.accept[state]


class Chunk:
    """Texts in a row: a code for every word of a language, 0 for a break, and what the codes stand for."""

    def __init__(self):
        self.fresh = itertools.count(1).__next__
        self.numbers: dict[bytes, dict[bytes, int]] = {}
        self.parts: list[np.ndarray] = []
        self.owners: list[tuple[int, int]] = []
        self.rows: list[pa.RecordBatch] = []
        self.tongue: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.bytes = 0

    def add(self, lang: bytes, words: list[bytes]) -> None:
        number = self.numbers.setdefault(lang, defaultdict(self.fresh, {_BREAK: 0}))
        self.parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.owners.append((self.tongue[lang], len(words)))
        self.bytes += 8 * len(words)

    def close(self) -> "Chunk":
        self.code = np.concatenate([np.zeros(0, np.int32), *self.parts])
        owner = np.array(self.owners, np.int64).reshape(-1, 2)
        self.langs, self.lang = list(self.tongue), np.repeat(owner[:, 0].astype(np.int32), owner[:, 1])
        self.ends = np.concatenate([[0], np.cumsum(owner[:, 1])])  # of the texts
        self.words = [b" "] * self.fresh()  # a break is never part of a phrase
        self.keys = [b""] * len(self.words)
        for lang, number in self.numbers.items():
            for word, code in number.items():
                if code:
                    self.words[code], self.keys[code] = word, lang + _BREAK + word
        return self


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for block in texts.blocks(batches, "text"):
        begin = 0
        for end, (lang, words) in enumerate(_texts(block), 1):
            chunk.add(lang, words)
            if chunk.bytes > CHUNK_BYTES:
                chunk.rows.append(block.slice(begin, end - begin))
                yield chunk.close()
                chunk, begin = Chunk(), end
        if begin < len(block):
            chunk.rows.append(block.slice(begin))
    yield chunk.close()


def _pack_words(rows: pd.DataFrame) -> pd.DataFrame:
    """The words of one shard in the order of their places."""
    rows = rows.sort_values("place")
    keys = [lang + _BREAK + word for lang, word in zip(rows["lang"], rows["phrase"], strict=True)]
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "packed": [zlib.compress(_BETWEEN.join(keys))]})


def _unpacked(packed: bytes) -> pa.Array:
    return pa.array(zlib.decompress(packed).split(_BETWEEN), pa.binary())


def _number(place, shard, shards: int):
    """Numbers from 1 on, nearly without gaps, as the shards are dealt by hash."""
    return place * shards + shard + 1


def _encoder(sent: list, shards: int, last: bool, dtype: str):
    """Texts as the numbers of their words; before the `last` round the texts stay beside what is known by then."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _unpacked(sent[0][1].value) if len(sent) == 1 else None
        for chunk in _chunks(batches):
            keys, known = pa.array(chunk.keys, pa.binary()), np.zeros(len(chunk.keys), np.int32)
            for shard, packed in sent:  # one dictionary at a time
                words = _unpacked(packed.value) if only is None else only
                place = np.asarray(pa.compute.fill_null(pa.compute.index_in(keys, value_set=words), -1))
                known[place >= 0] = _number(place[place >= 0], shard, shards)
            code = known[chunk.code]
            if chunk.rows and "codes" in chunk.rows[0].schema.names:
                code = np.maximum(code, np.concatenate([texts.joined(r.column("codes"))[0] for r in chunk.rows]).view(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([_without_gaps(code, chunk.ends, dtype)], names=["codes"])
                continue
            codes, begin = _binary(code, chunk.ends), 0
            for rows in chunk.rows:
                yield pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("text"), codes.slice(begin, len(rows))], names=["lang", "text", "codes"])
                begin += len(rows)
    return run


def _binary(code: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = (ends * code.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(code))])


def _without_gaps(code: np.ndarray, ends: np.ndarray, dtype: str) -> pa.Array:
    """One 0 behind every run of numbers; texts without a number are left out."""
    keep = code > 0
    keep[1:] |= code[:-1] > 0  # the last code of a text is 0
    before = np.concatenate([[0], np.cumsum(keep)])
    return _binary(code[keep].astype(dtype), np.unique(before[ends]))


def _positions(batches: Iterable[pa.RecordBatch], dtype: str) -> Iterator[np.ndarray]:
    for block in texts.blocks(batches, "codes", CHUNK_BYTES // 4 * np.dtype(dtype).itemsize):
        yield texts.joined(block.column("codes"))[0].view(dtype).astype(np.int32)


def _counter(sent: list, shards: int, length: int, least: int, complete: bool, base: int, dtype: str):
    """Counts of the phrases of the shards sent, and of each phrase with the next word up to `least`.

    `key` is the phrase's number times `base`, plus the next word's number. Words are phrases without
    a trie and have their counts already. If the shards sent hold all candidates (`complete`), a next
    word counts only where the phrase that ends with it is a candidate as well.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Shard(sent[0][1].value) if len(sent) == 1 else None
        counts: dict[int, np.ndarray] = {}
        for codes in _positions(batches, dtype):
            phrase = codes if length == 1 else np.zeros(len(codes), np.int64)
            shard = None
            for number, packed in sent:
                shard = None  # one trie at a time
                shard = only or Shard(packed.value)
                at, place = shard.accepted(codes, length)
                phrase[at] = _number(place.astype(np.int64), number, shards)
                counts[number] = counts.get(number, 0) + np.bincount(place, minlength=shard.size)
            shard = None
            if length < LONGEST:
                yield from _next_words(codes, phrase, length, least, complete, base)
        for number, n in counts.items():
            seen = np.flatnonzero(n)
            yield from _numbers(_number(seen, number, shards) * base, n[seen])
    return run


def _next_words(codes: np.ndarray, phrase: np.ndarray, length: int, least: int, complete: bool, base: int) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero((phrase[:-1] > 0) & (phrase[1:] > 0) if complete else phrase[:-1] > 0)
    follows = codes[at + length]  # a 0 stands behind the last word of a text
    at, follows = at[follows > 0], follows[follows > 0]
    key, n = np.unique(phrase[at].astype(np.int64) * base + follows, return_counts=True)
    yield from _numbers(key, np.minimum(n, least))


def _numbers(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 100_000):
        part = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(key[part], pa.int64()), pa.array(n[part], pa.int64())], names=["key", "n"])


def _numbered(candidates: DataFrame, order: list[str], shard_size: int) -> tuple[DataFrame, int]:
    """Candidates (`order` tells them apart) with their shard, place in it and number; and the number of shards."""
    candidates = materialize(candidates, "phrase-candidates")
    shards = -(-candidates.count() // shard_size)
    shard = F.pmod(F.xxhash64(*order), F.lit(max(shards, 1)))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(*order)) - 1
    numbered = candidates.withColumn("shard", shard.cast("bigint")).withColumn("place", place)
    return materialize(numbered.withColumn("number", _number(F.col("place").cast("bigint"), F.col("shard"), shards)), "phrases"), shards


def _rounds(packed: DataFrame, shards: int, at_once: int) -> Iterator[list]:
    """The packed shards, broadcast, at most `at_once` of them at a time."""
    context = packed.sparkSession.sparkContext
    for begin in range(0, shards, at_once):
        rows = packed.filter(F.col("shard").between(begin, begin + at_once - 1)).collect()
        sent = [(r["shard"], context.broadcast(bytes(r["packed"]))) for r in rows]
        yield sent
        for _, shard in sent:
            shard.unpersist()


def _encoded(body: DataFrame, words: DataFrame, shards: int, dtype: str, at_once: int) -> DataFrame:
    """`codes` of every text, as bytes; texts without a numbered word are left out."""
    packed = materialize(words.groupBy("shard").applyInPandas(_pack_words, "shard bigint, packed binary"), "word-shards")
    for i, sent in enumerate(_rounds(packed, shards, at_once), 1):
        last = i * at_once >= shards
        columns = "codes binary" if last else "lang binary, text binary, codes binary"
        body = materialize(body.mapInArrow(_encoder(sent, shards, last, dtype), columns), "numbered-texts")
    return body


def _level(codes: DataFrame, words: DataFrame, phrases: DataFrame, shards: int, length: int, least: int, base: int, dtype: str,
           at_once: int) -> tuple[DataFrame, DataFrame]:
    """Numbered phrases of `length` words with their exact counts `f` (words have theirs); and candidates of the next length."""
    if length == 1:
        rounds = [[]]
    else:
        width = ((base - 1).bit_length() + 7) // 8
        tries = materialize(phrases.groupBy("shard").applyInPandas(_builder(width), "shard bigint, packed binary"), "tries")
        rounds = _rounds(tries, shards, at_once)
    counted = []
    for sent in rounds:
        found = codes.mapInArrow(_counter(sent, shards, length, least, length == 1 or shards <= at_once, base, dtype), "key bigint, n bigint")
        found = found.groupBy("key").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("key") % base == 0))
        counted.append(materialize(found, "phrase-counts"))
    counted = functools.reduce(DataFrame.unionByName, counted)
    counted = counted.select(F.expr(f"key div {base}").alias("number"), (F.col("key") % base).alias("word"), F.col("n").alias("f"))
    counts = counted.filter("word = 0").join(phrases, "number").select("lang", "phrase", "f")
    following = words.select(F.col("number").alias("word"), F.col("phrase").alias("next"))
    longer = counted.filter("word > 0").join(phrases, "number").join(following, "word")
    return counts, longer.select("lang", F.concat("phrase", F.lit(b" "), "next").alias("phrase"), F.concat("codes", F.array("word")).alias("codes"))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shard_size: int = SHARD,
                  at_once: int = SHARDS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases with at least `least` occurrences, and (lang, n) of all words."""
    body = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).cast("binary").alias("lang"),
        F.col(f"`{text}`").cast("binary").alias("text"),
    )
    counted = body.mapInArrow(_count_words, "lang binary, phrase binary, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    counted = materialize(counted.filter((F.col("n") >= least) | F.col("phrase").isNull()), "word-counts")
    words, shards = _numbered(counted.filter(F.col("phrase").isNotNull()), ["lang", "phrase"], shard_size)
    levels = [words.select(_text("lang"), _text("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))]
    if shards:
        base = words.agg(F.max("number")).first()[0] + 1
        dtype = "uint16" if base <= 1 << 16 else "int32"
        codes = _encoded(body, words, shards, dtype, at_once)
        phrases = words.drop("n").withColumn("codes", F.array("number"))
        for length in range(1, LONGEST + 1):
            counts, longer = _level(codes, words, phrases, shards, length, least, base, dtype, at_once)
            if length > 1:
                levels.append(counts.select(_text("lang"), _text("phrase"), F.lit(length).alias("words"), "f"))
            if length < LONGEST:
                phrases, shards = _numbered(longer, ["codes"], shard_size)
                if not shards:
                    break
    totals = counted.filter(F.col("phrase").isNull()).select(_text("lang"), "n")
    return materialize(functools.reduce(DataFrame.unionByName, levels), "frequent-phrases"), totals


def _text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def _best_cuts(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the lowest-scoring cut of every candidate."""
    parts = F.split("phrase", " ")
    cuts = (
        frequent.filter("words > 1").withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("first", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "))
        .withColumn("rest", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " "))
    )
    first = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    # 2 000 000 * a passes 64 bits for large counts: divided as decimals
    scored = scored.withColumn("score", F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def _inside_longer(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the most occurrences of a longer candidate that holds the phrase."""
    parts = F.split("phrase", " ")
    longer = frequent.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    held = longer.select("lang", F.array_join(F.slice(parts, F.col("at"), F.col("size")), " ").alias("phrase"), "f")
    return held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED,
                 shard_size: int = SHARD, at_once: int = SHARDS_AT_ONCE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `top` phrases of each language."""
    frequent, totals = phrase_counts(docs, text, lang, least, shard_size, at_once)
    scored = _best_cuts(frequent).join(_inside_longer(frequent), ["lang", "phrase"], "left")
    kept = scored.filter(F.col("longer").isNull() | (F.lit(100) * _exact("longer") < F.lit(covered) * _exact("a")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the first of every salt, then the first of all: a language with most candidates is not one task
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    some = some.filter(F.col("rank") <= top).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
s AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS p FROM d)),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM s GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS ws, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
b AS (SELECT c.lang, c.phrase, size, a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:size], ' ')),
m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, f, ws, size, i FROM (SELECT lang, f, ws, k, size, unnest(generate_series(1, k - size + 1)) AS i
      FROM (SELECT lang, f, k, string_split(phrase, ' ') AS ws, unnest(generate_series(2, k - 1)) AS size FROM f WHERE k > 2))),
h AS (SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(f) AS longer FROM o GROUP BY 1, 2),
q AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank
      FROM m LEFT JOIN h ON h.lang = m.lang AND h.phrase = m.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark, folder):
    return collocations(table(spark, folder, "documents"))
