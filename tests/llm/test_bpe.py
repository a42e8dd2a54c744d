"""BPE encoding against the tokenizers library, token by token, and decoding against its decode."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldpulse.llm import bpe
from fieldpulse.llm.queries import QUERIES

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
FILES = [WORD_FILE, public_tokenizers.path("byte_bpe_50k.json")]
PIECES = ["a", "b", "e", "th", " ", "\n", "'s", "'", "1", "é", "ß", "日", "本", "Σ", "İ", "ſ", "<|endoftext|>", "<|startoftext|>",
          "<|endof", "\x1c", "\x85", " ", "😀", "é", "K", "--", "\x00", "͸", "\U00010940", "Ᲊ", "ǅ", "한", "가"]


def own(path):
    with open(path, "rb") as f:
        return bpe.Encoder(bpe.Vocabulary(f.read()))


@pytest.mark.parametrize("path", FILES)
def test_tokens_of_random_texts(path):
    encoder, library, rng = own(path), Tokenizer.from_file(path), random.Random(5)
    bodies = ["".join(rng.choices(PIECES, k=rng.randrange(40))) for _ in range(1500)]
    ids, first = encoder.encode(b.encode() for b in bodies)
    for i, body in enumerate(bodies):
        assert ids[first[i] : first[i + 1]].tolist() == library.encode(body, add_special_tokens=False).ids, body


def test_every_character():
    encoder, library = own(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(letters), 60_000):
        body = " x".join(letters[begin : begin + 60_000])
        ids, _ = encoder.encode([body.encode()])
        assert ids.tolist() == library.encode(body, add_special_tokens=False).ids


def test_long_words():
    library, rng = Tokenizer.from_file(WORD_FILE), random.Random(3)
    for body in ["a" * 100_000, "".join(rng.choices("abcdefghijklmno", k=50_000)), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(20_000))]:
        ids, _ = own(WORD_FILE).encode([body.encode()])
        assert ids.tolist() == library.encode(body, add_special_tokens=False).ids


def plain_bpe(word, merges):
    """One merge at a time: the lowest rank, leftmost."""
    rank = {tuple(m): i for i, m in enumerate(merges)}
    parts = list(word)
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if found is None:
            return parts
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("merges", [
    [("a", "b"), ("ab", "c"), ("c", "c"), ("a", "a")],
    [("aa", "a"), ("ab", "a"), ("a", "a"), ("a", "b"), ("b", "aa")],  # parts are made by later merges
    [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc"), ("abc", "a")],  # two ways to one token
    [],
])
def test_merge_order_against_single_merges(merges):
    letters = bpe.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    rules = {"model": {"vocab": vocab, "merges": [list(m) for m in merges]}, "added_tokens": [],
             "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
    encoder, rng = bpe.Encoder(bpe.Vocabulary(json.dumps(rules).encode())), random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 30))) for _ in range(400)]
    ids, first = encoder.encode(w.encode() for w in words)
    for i, word in enumerate(words):
        assert [encoder.vocabulary.tokens[t] for t in ids[first[i] : first[i + 1]]] == plain_bpe(word, merges)


def test_unknown_rules_are_refused():
    with open(WORD_FILE) as f:
        rules = json.load(f)
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(rules | {"normalizer": {"type": "StripAccents"}}).encode())
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(rules | {"model": rules["model"] | {"dropout": 0.1}}).encode())


def expected(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_query_on_the_table(spark, folder):
    library = Tokenizer.from_file(WORD_FILE)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op12_bpe"].run(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r[0]: expected(r[1], library) for r in docs}


def test_edge_rows(spark, edge, edge_rows, none):
    library = Tokenizer.from_file(WORD_FILE)
    clashing = edge.withColumns({"ids": edge.doc_id, "decoded": edge.doc_id, "_ids": edge.doc_id, "c0": edge.doc_id})
    encoded = bpe.encode(clashing, WORD_FILE)
    rows = bpe.decode(encoded, WORD_FILE).collect()
    assert len(rows) == len(edge_rows) and set(rows[0].asDict()) == set(clashing.columns)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) and r["c0"] == r["doc_id"]
    assert bpe.decode(bpe.encode(none, WORD_FILE), WORD_FILE).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [3306, None, 999_999])], "doc_id int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, WORD_FILE).orderBy("doc_id").collect()] == ["", "hello</w>"]


def test_byte_level_round_trip(spark, edge):
    path = FILES[1]
    for r in bpe.decode(bpe.encode(edge.select("doc_id", "text"), path), path).collect():
        assert r["decoded"] == (r["text"] or "")
