"""BPE encoding and decoding of texts in batched numpy merge rounds.

A text is cut at the special tokens of the vocabulary file, normalised and split into words by
the rules the file names. The symbols of all words not seen before lie in one flat array. Every
round looks up all neighbouring pairs by binary search over the sorted pair keys, finds the
lowest rank of every word, and merges the pairs of that rank, left to right; words without a
known pair leave the array. Two neighbours that no merge can ever join divide a word beforehand,
so that long words fall into short ones. Merging all places of the lowest rank at once is exact
if every part of a merge is a base symbol or made by an earlier merge; for a file where that does
not hold only the first place is merged in a round.

Everything happens where the texts are, without an exchange. Only the vocabulary file is
broadcast; it does not grow with the data. A worker remembers the words it has encoded, up to
`CACHED_WORDS`. Texts are taken in blocks of 2 MB or one text, whole.

Defined cases: a NULL or empty text has no tokens (an empty array) and decodes to an empty text;
characters without a base symbol give no token; unknown ids are left out in decoding; a NULL array
of ids decodes to an empty text; very long texts and words are encoded whole; repeated rows are
all returned; an empty table gives an empty result; input columns of the names `ids` or `decoded`
are replaced.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from fieldpulse.llm import text as texts
from fieldpulse.llm.registry import query, table

VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 200_000
CACHED_BYTES = 32 << 20
NO_MERGE = np.int64(1) << 40

# White space of the Unicode standard.
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the split of byte-level files that name no pattern of their own.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def _pattern(source: str):
    source = source.replace(r"[^\s", rf"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
    return regex.compile(source) if r"\p" in source else re.compile(source)


def _ascii_pattern(pattern):
    """The same pattern for texts of ASCII characters only, without Unicode properties."""
    letters, digits = "A-Za-z", "0-9"
    source = pattern.pattern
    for name, members in ((r"\p{L}", letters), (r"\p{N}", digits)):
        source = source.replace(f"[{name}]", f"[{members}]")
        pieces = re.split(r"(\[[^\]]*\])", source)
        source = "".join(p.replace(name, members) if p.startswith("[") else p.replace(name, f"[{members}]") for p in pieces)
    return pattern if r"\p" in source else re.compile(source)


def _lower(text: str) -> str:
    return text.replace("Σ", "σ").lower()  # letter by letter: no final form of sigma


class Vocabulary:
    """Rules, base symbols and merges of a tokenizer file."""

    def __init__(self, source: bytes):
        rules = json.loads(source)
        model = rules["model"]
        plain = {"dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False, "unk_token": None}
        odd = [k for k, v in plain.items() if (model.get(k) or v) != v]
        if model.get("type", "BPE") != "BPE" or odd:
            raise ValueError(f"not a plain BPE vocabulary: {model.get('type')} {odd}")
        self.source = source
        self.normal = [self._normal(r) for r in _listed(rules.get("normalizer"), "normalizers")]
        self.seen: set[str] = set()
        self.words, prefix_space = self._split(_listed(rules.get("pre_tokenizer"), "pretokenizers"))
        if prefix_space:
            raise ValueError("a prefix space is not supported")
        self.ascii_words = _ascii_pattern(self.words)
        decoder = (rules.get("decoder") or {}).get("type")
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {decoder}")
        self.decodes_bytes = decoder == "ByteLevel"
        self.special = {t["content"]: t["id"] for t in rules.get("added_tokens", ())}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in rules.get("added_tokens", ())):
            raise ValueError("special tokens must be plain strings of the text")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.tokens = {i: t for t, i in (model["vocab"] | self.special).items()}
        self._merges(model)

    @staticmethod
    def _normal(rule: dict) -> Callable[[str], str]:
        kind = rule["type"]
        if kind in ("NFC", "NFD", "NFKC", "NFKD"):
            return functools.partial(unicodedata.normalize, kind)
        if kind == "Lowercase":
            return _lower
        if kind == "Replace" and "Regex" in rule["pattern"]:
            pattern, new = _pattern(rule["pattern"]["Regex"]), rule["content"].replace("\\", "\\\\")
            return lambda text: pattern.sub(new, text)
        raise ValueError(f"unknown normalizer {kind}")

    @staticmethod
    def _split(steps: list[dict]) -> tuple[re.Pattern, bool]:
        pattern, prefix = None, False
        for step in steps:
            if step["type"] == "Split" and step["invert"] and step["behavior"] == "Removed" and pattern is None:
                pattern = step["pattern"]["Regex"]
            elif step["type"] == "ByteLevel":
                prefix |= step["add_prefix_space"]
                if step.get("use_regex", True) and pattern is None:
                    pattern = BYTE_LEVEL_SPLIT
            else:
                raise ValueError(f"unknown pre-tokenizer {step['type']}")
        if pattern is None or not steps or steps[-1]["type"] != "ByteLevel":
            raise ValueError("the vocabulary must split by a pattern and work on bytes")
        return _pattern(pattern), prefix

    def _merges(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        known = {int(i) for i in (*self.inner, *self.last)}
        self.in_order = len(set(made.tolist())) == len(made)
        begins, ends = {i: i for i in known}, {i: i for i in known}
        joins = set()
        for a, b, c in zip(left.tolist(), right.tolist(), made.tolist(), strict=True):
            if a not in begins or b not in begins:  # its parts are made later
                self.in_order = False
                break
            joins.add(ends[a] << 32 | begins[b])
            begins[c], ends[c] = begins[a], ends[b]
        self.joins = np.array(sorted(joins), np.int64) if self.in_order else None

    def symbols_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words in a row, and the number of tokens of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[data], np.repeat(np.arange(len(words)), size)
        closing = np.cumsum(size)[size > 0] - 1
        symbols[closing] = self.last[data[closing]]
        symbols, word = symbols[symbols >= 0], word[symbols >= 0]
        unit = word
        if self.joins is not None and len(symbols) > 1:
            apart = (word[1:] != word[:-1]) | ~_contains(self.joins, symbols[:-1] << 32 | symbols[1:])
            unit = np.concatenate([[0], np.cumsum(apart)])
        word_of_unit = word[_first_of(unit)]
        done = []
        while len(symbols):
            symbols, unit = self._round(symbols, unit, done)
        symbols, unit = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*done, strict=True)) if done else (symbols, unit)
        order = np.argsort(unit, kind="stable")
        owner = word_of_unit[unit] if self.joins is not None and len(unit) else unit
        return symbols[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _round(self, symbols: np.ndarray, unit: np.ndarray, done: list) -> tuple[np.ndarray, np.ndarray]:
        """Merge the lowest-ranked pair of every unit; units without a pair move to `done`."""
        rank, made = np.full(len(symbols), NO_MERGE), np.zeros(len(symbols), np.int64)
        pair = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        hit = np.flatnonzero((self.keys[at] == pair) & (unit[:-1] == unit[1:])) if len(self.keys) else np.zeros(0, np.int64)
        rank[hit], made[hit] = self.ranks[at[hit]], self.made[at[hit]]
        begin = _first_of(unit)
        lowest = np.minimum.reduceat(rank, begin)
        lowest = np.repeat(lowest, np.diff(np.append(begin, len(unit))))
        alive = lowest < NO_MERGE
        if not alive.all():
            done.append((symbols[~alive], unit[~alive]))
            symbols, unit, rank, made, lowest = (x[alive] for x in (symbols, unit, rank, made, lowest))
        place = np.flatnonzero(rank == lowest)
        if not len(place):
            return symbols, unit
        if self.in_order:  # of touching places every second one, from the left
            new_run = np.concatenate([[True], place[1:] != place[:-1] + 1])
            run = np.flatnonzero(new_run)
            place = place[(np.arange(len(place)) - run[np.cumsum(new_run) - 1]) % 2 == 0]
        else:
            place = place[_first_of(unit[place])]
        symbols = symbols.copy()
        symbols[place] = made[place]
        stays = np.ones(len(symbols), bool)
        stays[place + 1] = False
        return symbols[stays], unit[stays]

    def split(self, text: str) -> list[str | int]:
        """The words of a text; special tokens as their ids."""
        pieces = self.cut.split(text) if self.cut else [text]
        out: list[str | int] = []
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                if not self._all_assigned(piece):
                    out += self._split_by_library(piece)
                    continue
                for step in self.normal:
                    piece = step(piece)
                out += (self.ascii_words if piece.isascii() else self.words).findall(piece)
        return out

    def _all_assigned(self, piece: str) -> bool:
        """Whether Python's Unicode tables know all characters; on others libraries may differ."""
        if piece.isascii():
            return True
        new = set(piece) - self.seen
        self.seen |= {c for c in new if unicodedata.category(c) != "Cn"}
        return new <= self.seen

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.source.decode())

    def _split_by_library(self, piece: str) -> list[str]:
        """Texts with characters newer than Python's tables: the library's own tables decide."""
        piece = self._library.normalizer.normalize_str(piece) if self._library.normalizer else piece
        return [piece[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(piece)]


def _listed(rule: dict | None, name: str) -> list[dict]:
    return [] if rule is None else rule[name] if rule["type"] == "Sequence" else [rule]


def _contains(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _first_of(groups: np.ndarray) -> np.ndarray:
    """Places where a new group begins."""
    if not len(groups):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))


class Encoder:
    """Encodes texts and remembers the tokens of their words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str | int, int] = defaultdict(itertools.count().__next__)
        self.ids = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)

    def _learn(self) -> None:
        new = list(itertools.islice(self.number, len(self.size), None))
        plain = [w if isinstance(w, str) else "" for w in new]
        ids, size = self.vocabulary.symbols_of([w.encode() for w in plain])
        special = np.array([not isinstance(w, str) for w in new], bool)
        if special.any():
            ids = np.insert(ids, (np.cumsum(size) - size)[special], [w for w in new if not isinstance(w, str)])
            size[special] = 1
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])

    def encode(self, bodies: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and where each text begins and ends in them."""
        if len(self.number) > CACHED_WORDS or self.ids.nbytes > CACHED_BYTES:
            self._forget()
        codes, first = [], [0]
        for body in bodies:
            words = self.vocabulary.split(body.decode("utf-8", "replace")) if body else ()
            codes.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            first.append(first[-1] + len(words))
        code = np.concatenate([np.zeros(0, np.int64), *codes])
        if len(self.number) > len(self.size):
            self._learn()
        size, begin = self.size[code], (np.cumsum(self.size) - self.size)[code]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        return ids, np.concatenate([[0], ends])[first]


@functools.lru_cache(2)
def vocabulary_of(source: bytes) -> Vocabulary:
    return Vocabulary(source)


def _columns(df: DataFrame, keep: Sequence[str] | None, new: str) -> list[str]:
    return [c for c in (df.columns if keep is None else keep) if c != new]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) and the token ids of the whole text, as array<int>.

    `vocabulary` is the path of a tokenizer file that the driver can read.
    """
    with open(vocabulary, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = _columns(docs, keep, ids)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("none"))
    df = docs.select(row.alias("_row"), F.col(f"`{text}`").cast("binary").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_of(source.value))
        for block in texts.blocks(batches, "_text"):
            flat, first = encoder.encode(v.as_py() for v in block.column(1))
            tokens = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column(0), tokens], names=["_row", "_ids"])

    kind = df.schema["_row"].dataType.simpleString()
    out = df.mapInArrow(run, f"_row {kind}, _ids array<int>")
    return out.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(kept)], F.col("_ids").alias(ids))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) and the text that the token ids stand for, special tokens included."""
    with open(vocabulary, "rb") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    kept = _columns(df, keep, decoded)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("none"))
    df = df.select(row.alias("_row"), F.col(f"`{ids}`").cast("array<int>").alias("_ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary_of(source.value)
        token = own.tokens.get
        byte_of = {c: b for b, c in enumerate(byte_letters())}

        def spell(numbers: list[int | None]) -> str:
            found = [t for t in map(token, numbers) if t is not None]
            if not own.decodes_bytes:
                return " ".join(found)
            letters = (bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode() for t in found)
            return b"".join(letters).decode("utf-8", "replace")

        for batch in batches:
            for begin in range(0, len(batch), 100):  # output in small pieces
                part = batch.slice(begin, 100)
                made = pa.array([spell(v.as_py() or []) for v in part.column(1)], pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["_row", "_decoded"])

    kind = df.schema["_row"].dataType.simpleString()
    out = df.mapInArrow(run, f"_row {kind}, _decoded string")
    return out.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(kept)], F.col("_decoded").alias(decoded))


@query("op12_bpe")
def op12_bpe(spark, folder):
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    encoded = encode(table(spark, folder, "documents"), path, keep=["doc_id"])
    digests = encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
    )
    decoded = decode(digests, path, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")
