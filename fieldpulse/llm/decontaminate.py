"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items form one suffix automaton over words. The words of a document
are streamed through it; at every word the state gives the longest match that ends there, so
all words inside an occurrence of a window (13 words of an item, or a whole shorter item) are
known. Words in such spans are hit.

Items are dealt over tasks, and each task builds automata of at most `BLOCK_WORDS` words; an item
with more words is cut into pieces that overlap by a window less one word, so no window is lost. The
automata are written to the shared folder and broadcast, `AT_ONCE` at a time: the documents pass
through these one after another in one stage, without an exchange, and each pass adds to the row's
spans. With more automata the rows are written between the rounds and the last round's are let go,
so neither the driver nor a task ever holds more than `AT_ONCE`, whatever the number of items.
Documents are never grouped or exchanged.

Defined cases: a NULL or wordless text has no words and is not contaminated; a NULL or wordless
item has no window; very long texts and items are read whole; item rows of equal id count as one item,
a NULL id shows as `null`; a passage that several items share counts for each of them; repeated document
rows are all returned; empty tables give empty or unhit results.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldpulse.llm.registry import query, table
from fieldpulse.llm.text import plain_words
from fieldpulse.session import materialize

WINDOW = 13
BLOCK_WORDS = 100_000  # words of the items in one automaton, at most
AT_ONCE = 4  # automata that are broadcast together
COVERAGE = 20  # contaminated from one hit word in twenty

# a word of `plain_words`, before lower-casing
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = "array<int>"  # begin, end, begin, end, ... as word numbers, end exclusive, apart from each other


class SuffixAutomaton:
    """Recognises every run of words of the given items."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        named = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, words in named:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # items by the state of each of their windows; short items by (length, item) at their state
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, words in named:
            if len(words) < window:
                self.short.setdefault(self._state(words), []).append((len(words), name))
            else:
                for i in range(len(words) - window + 1):
                    self.items.setdefault(self._state(words[i : i + window]), set()).add(name)
        self.on_short_path = [False] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.on_short_path[state] = state in self.short or (state > 0 and self.on_short_path[self.link[state]])

    def _extend(self, last: int, word: int) -> int:
        """Append `word` to the string that ends in state `last`; the state of the longer string."""
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        new = self._add({}, 0, self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            exact = self.length[target] == self.length[state] + 1
            self.link[new] = target if exact else self._split(state, word, target)
        return new

    def _split(self, state: int, word: int, target: int) -> int:
        """Give the shorter strings of `target` a state of their own."""
        copy = self._add(dict(self.next[target]), self.link[target], self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _state(self, words: list[int]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal spans of hit words and the items whose windows occur."""
        following, link, length, window = self.next, self.link, self.length, self.window
        spans: list[list[int]] = []
        seen: set[int] = set()
        found: set[str] = set()
        state = size = 0
        for place, word in enumerate(map(self.words.get, words), 1):
            if word is None:
                state = size = 0
                continue
            step = following[state].get(word)
            if step is None:
                while step is None and state:
                    state = link[state]
                    step = following[state].get(word)
                size = length[state]
                if step is None:
                    continue
            state = step
            size += 1
            reach = 0
            if size >= window:
                reach = size
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                seen.add(at)
            elif self.on_short_path[state]:
                reach = self._short_items(state, size, found)
            if size >= window and self.on_short_path[state]:
                self._short_items(state, size, found)
            if reach:
                _cover(spans, place - reach, place)
        for at in seen:
            found |= self.items[at]
        return spans, found

    def _short_items(self, state: int, size: int, found: set[str]) -> int:
        longest = 0
        while state > 0 and self.on_short_path[state]:
            for n, name in self.short.get(state, ()):
                if n <= size:
                    found.add(name)
                    longest = max(longest, n)
            state = self.link[state]
        return longest


def _cover(spans: list[list[int]], begin: int, end: int) -> None:
    """Add a span that ends no earlier than all before it."""
    while spans and spans[-1][1] >= begin:
        begin = min(begin, spans.pop()[0])
    spans.append([begin, end])


def _merged(flat: list[int] | None, spans: list[list[int]]) -> list[int]:
    out: list[list[int]] = []
    pairs = list(zip(flat[::2], flat[1::2], strict=True)) if flat else []
    for begin, end in sorted([*pairs, *map(tuple, spans)]):
        if out and out[-1][1] >= begin:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [x for span in out for x in span]


def _item_blocks(items: Iterable[tuple[str, list[bytes]]], window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items, longer ones in overlapping pieces, in blocks of at most `block_words` words."""
    longest = max(block_words, window)
    block, size = [], 0
    for name, words in items:
        for begin in range(0, max(1, len(words) - window + 1), longest - window + 1):
            piece = words[begin : begin + longest]
            if block and size + len(piece) > longest:
                yield block
                block, size = [], 0
            block.append((name, piece))
            size += len(piece)
    if block:
        yield block


def build_automata(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
                   block_words: int = BLOCK_WORDS) -> DataFrame | None:
    """Pickled automata of all items, one a row, built in tasks and written to the shared folder; None without words."""
    name = F.coalesce(F.col(item_id).cast("string"), F.lit("null"))
    items = benchmark.select(name.alias("name"), F.col(text).alias("text")).filter("text IS NOT NULL").distinct()
    n_words = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0]
    if not n_words:
        return None

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((n.as_py(), plain_words(t.as_py())) for batch in batches for n, t in zip(batch.column(0), batch.column(1), strict=True))
        for block in _item_blocks(pairs, window, block_words):
            data = pickle.dumps(vars(SuffixAutomaton(block, window)), pickle.HIGHEST_PROTOCOL)
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["automaton"])

    n_tasks = -(-n_words // max(block_words, window))
    # the number of automata follows from the words alone, also where a session raises the number of partitions
    dealt = items.select("name", F.col("text").cast("binary")).repartition(n_tasks, "name", "text").coalesce(n_tasks)
    return materialize(dealt.mapInArrow(build, "automaton binary"), "automata")


@functools.lru_cache(maxsize=AT_ONCE)
def _loaded(data: bytes) -> SuffixAutomaton:
    """The automaton of a broadcast, kept for the worker's next tasks."""
    own = SuffixAutomaton.__new__(SuffixAutomaton)
    vars(own).update(pickle.loads(data))
    return own


def _pass(automaton) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over the texts: fills or extends the columns n_words, spans and items."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(automaton.value) if automaton else None
        for batch in batches:
            names = batch.schema.names
            numbers, spans, items = [], [], []
            before = zip(batch.column(names.index("_spans")).to_pylist(), batch.column(names.index("_items")).to_pylist(), strict=True)
            for raw, (old_spans, old_items) in zip(batch.column(names.index("_text")), before, strict=True):
                words = plain_words(raw.as_py())
                new, found = own.matches(words) if own else ([], set())
                numbers.append(len(words))
                spans.append(_merged(old_spans, new) if new else old_spans or [])
                items.append(sorted(found | set(old_items or ())))
            made = {"_n_words": pa.array(numbers, pa.int64()), "_spans": pa.array(spans, pa.list_(pa.int32())),
                    "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)
    return run


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """`_row` (the input's columns), `_n_words`, `_spans` (hit words) and `_items` (ids, sorted)."""
    spark = docs.sparkSession
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).cast("binary").alias("_text"),
        F.lit(0).cast("bigint").alias("_n_words"), F.array().cast(SPANS).alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
    )
    automata = build_automata(benchmark, window=window, block_words=block_words)
    if automata is None:
        return df.mapInArrow(_pass(None), df.schema).select("_row", "_n_words", "_spans", "_items")
    schema, sent = df.schema, []
    for row in automata.toLocalIterator():
        if len(sent) == AT_ONCE:
            df = materialize(df, "matches")
            for old in sent:
                old.destroy()
            sent = []
        sent.append(spark.sparkContext.broadcast(bytes(row["automaton"])))
        df = df.mapInArrow(_pass(sent[-1]), schema)
    return df.select("_row", "_n_words", "_spans", "_items")


def hit_words() -> Column:
    places = F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda total, x: total + x)


def is_contaminated() -> Column:
    return (hit_words() > 0) & (COVERAGE * hit_words() >= F.col("_n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that are not contaminated, unchanged."""
    return with_matches(docs, benchmark, text).filter(~is_contaminated()).select("_row.*")


def _without_spans(raw: bytes | None, spans: list[int], least: int) -> str | None:
    """The text without the spans of at least `least` words, from their first letter to their last."""
    if raw is None:
        return None
    pieces, kept, place, number = [], 0, 0, 0
    low = raw.lower()
    bounds = []
    for word in plain_words(raw):
        begin = low.index(word, place)
        place = begin + len(word)
        bounds.append((begin, place))
    for number in range(0, len(spans), 2):
        first, last = spans[number], spans[number + 1] - 1
        if last - first + 1 >= least:
            pieces.append(raw[kept : bounds[first][0]])
            kept = bounds[last][1]
    return b"".join([*pieces, raw[kept:]]).decode("utf-8", "replace")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: int = WINDOW) -> DataFrame:
    """Contaminated rows dropped, and spans of at least `least` hit words cut out of the others' text."""
    matched = with_matches(docs, benchmark, text).filter(~is_contaminated())

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, spans = (batch.column(i).to_pylist() for i in (1, 2))
            new = [_without_spans(t, s, least) for t, s in zip(bodies, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["_row", "_new"])

    kind = matched.schema["_row"].dataType.simpleString()
    body = F.col("_row").getField(text).cast("binary")
    new = matched.select("_row", body.alias("_text"), "_spans").mapInArrow(cut, f"_row {kind}, _new string")
    return new.select(*[(F.col("_new") if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS s
      FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM iw WHERE len(ws) > 0)),
g AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
      FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM p))),
h AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.n = p.n AND g.s = p.s),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op2_decontamination", SQL)
def op2_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = with_matches(docs, table(spark, folder, "benchmark"))
    return found.select(
        "_row.doc_id", F.col("_n_words").alias("n_words"), hit_words().alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )
