"""Language of whole texts and of their spans.

Script ranges narrow the candidates: the script of a word's first letter leaves only the
languages that use it in the learned texts. Every word then gets a score for each candidate
from its byte trigrams and its hash, and a Viterbi pass over the words, with a penalty for each
change of language, labels spans. The text's language is the one with most bytes in its spans,
the score its share of them.

Learning counts trigrams and words by language over a bounded share of the labelled texts, in
one aggregation whose result has at most 2 * 2**16 rows for each language.

Defined cases: a NULL text or one without a letter is `und` with score 0; words in a script no
learned language uses count for none of them, and a text that has no others is `und` or, with
`all_scripts` as in the query, gets the learned language with the best score; ties go to the alphabetically first language;
repeated rows are all returned; without any learned row every text with a letter is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldpulse.llm import text as texts
from fieldpulse.llm.registry import query, table

TRAINING_ROWS = 8_000  # texts of each language to learn from, chosen by hash, on average
BUCKET_BITS = 16
SWITCH = 12.0  # penalty for a change of language, in units of log probability
SMOOTHING = 0.5
CLEAREST = 12.0  # one word counts at most so much for or against a language
SCRIPT_SHARE = 0.02  # a language is a candidate in a script in which it has this share of its words
UNKNOWN = "und"
BLOCK = 6 << 20

# First code points of ranges of characters and the script of their letters; `common` has none,
# `other` gathers scripts that are not told apart.
RANGES = (
    (0x0, "common"), (0x41, "latin"), (0x5B, "common"), (0x61, "latin"), (0x7B, "common"), (0xAA, "latin"),
    (0xAB, "common"), (0xBA, "latin"), (0xBB, "common"), (0xC0, "latin"), (0xD7, "common"), (0xD8, "latin"),
    (0xF7, "common"), (0xF8, "latin"), (0x300, "common"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"),
    (0x590, "hebrew"), (0x600, "arabic"), (0x700, "syriac"), (0x750, "arabic"), (0x780, "thaana"), (0x7C0, "nko"),
    (0x800, "other"), (0x860, "syriac"), (0x870, "arabic"), (0x900, "devanagari"), (0x980, "bengali"),
    (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "odia"), (0xB80, "tamil"), (0xC00, "telugu"),
    (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"),
    (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1400, "canadian"), (0x1680, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "canadian"),
    (0x1900, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1CD0, "common"),
    (0x1D00, "latin"), (0x1DC0, "common"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"),
    (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"),
    (0x2D80, "ethiopic"), (0x2DE0, "common"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xA8E0, "devanagari"),
    (0xA900, "other"), (0xAB30, "latin"), (0xAB70, "cherokee"), (0xABC0, "other"), (0xAC00, "hangul"),
    (0xD7B0, "common"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "common"), (0xFE70, "arabic"), (0xFF00, "common"), (0xFF21, "latin"), (0xFF3B, "common"),
    (0xFF41, "latin"), (0xFF5B, "common"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "common"),
    (0x10000, "other"), (0x1F000, "common"), (0x20000, "han"),
)
SCRIPTS = ("common", *sorted({name for _, name in RANGES} - {"common"}))
_starts = np.array([r[0] for r in RANGES])
_kinds = np.array([SCRIPTS.index(r[1]) for r in RANGES], dtype=np.int8)
_letter = re.compile(r"[^\W\d_]")

NO_LETTERS = texts.SPACES.copy()
NO_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = True


def _scripts_at(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The scripts of the characters that begin at these bytes; `data` has three bytes more than the text."""
    lead = data[place].astype(np.int32)
    one, two, three = (data[place + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
    code = np.select(
        [lead < 0x80, lead < 0xE0, lead < 0xF0],
        [lead, ((lead & 0x1F) << 6) | one, ((lead & 0x0F) << 12) | (one << 6) | two],
        ((lead & 0x07) << 18) | (one << 12) | (two << 6) | three,
    )
    return _kinds[np.searchsorted(_starts, code, side="right") - 1]


def first_scripts(words: texts.Words) -> np.ndarray:
    """The script of each word, from its first letter; 0 for a word without one."""
    data = np.concatenate([words.data, np.zeros(3, np.uint8)])
    out = _scripts_at(data, words.begin)
    rest = np.flatnonzero(out == 0)  # a word that begins with a quote, a dash and the like is read on
    n = words.end[rest] - words.begin[rest]
    owner = np.repeat(rest, n)
    place = np.arange(n.sum()) + np.repeat(words.begin[rest] - (np.cumsum(n) - n), n)
    starts = (data[place] & 0xC0) != 0x80
    owner, script = owner[starts], _scripts_at(data, place[starts])
    owner, script = owner[script > 0], script[script > 0]
    owner, at = np.unique(owner, return_index=True)
    out[owner] = script[at]
    return out


def features(words: texts.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams, the first trigram of each word, and the bucket of each word.

    A word of k bytes has k trigrams: it is read with a space before and behind it.
    """
    n = words.end - words.begin
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(first[-1]) - np.repeat(first[:-1] - words.begin, n)
    data = words.data.astype(np.uint32)
    before = data[place - 1] if len(place) else data[:0]
    before[first[:-1]] = 32
    behind = data[np.minimum(place + 1, len(data) - 1)]
    behind[first[1:] - 1] = 32
    trigram = (before << np.uint32(16)) | (data[place] << np.uint32(8)) | behind
    trigram = (trigram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    whole = (words.hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (1 << BUCKET_BITS)
    return trigram.astype(np.int64), first, whole


def _block_words(batch: pa.RecordBatch) -> texts.Words:
    return texts.Words(*texts.joined(batch.column(batch.schema.get_field_index("text"))), NO_LETTERS)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n); scripts are counted in buckets behind those of trigrams and words."""
    for batch in texts.blocks(batches):
        words = _block_words(batch)
        langs = np.asarray(batch.column(batch.schema.get_field_index("lang")).to_pylist(), dtype=object)
        trigram, first, whole = features(words)
        script = first_scripts(words).astype(np.int64) + (2 << BUCKET_BITS)
        of_text = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
        for lang in sorted(set(langs)):
            mine = (langs == lang)[of_text]
            kept = np.concatenate([trigram[np.repeat(mine, np.diff(first))], whole[mine], script[mine]])
            bucket, n = np.unique(kept, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket, pa.int64()), pa.array(n, pa.int64())],
                names=["lang", "bucket", "n"],
            )


class Model:
    """Log probabilities by bucket and language, and the candidates of each script."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({c[0] for c in counts})
        size = 1 << BUCKET_BITS
        table = np.zeros((2 * size + len(SCRIPTS), len(self.langs)))
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, bucket, n in counts:
            table[bucket, number[lang]] = n
        self.logs = np.zeros((2 * size, len(self.langs)), np.float32)
        for begin in (0, size):
            part = table[begin : begin + size] + SMOOTHING
            logs = np.log(part / part.sum(axis=0))
            self.logs[begin : begin + size] = logs - logs.mean(axis=1, keepdims=True) if self.langs else logs
        scripts = table[2 * size :]
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.candidates = share >= SCRIPT_SHARE

    def scores(self, words: texts.Words, all_scripts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """One row for each word: how much it speaks for each language, 0 at best; and whether it counts.

        With `all_scripts`, a text that has no word in a learned script is scored for all languages.
        """
        trigram, first, whole = features(words)
        out = np.empty((len(whole), len(self.langs)), np.float32)
        for i in range(len(self.langs)):
            column = np.ascontiguousarray(self.logs[:, i])
            out[:, i] = np.add.reduceat(column[trigram], first[:-1]) + column[whole] if len(whole) else 0
        script = first_scripts(words)
        allowed = self.candidates[script]
        known = allowed.any(axis=1)
        if all_scripts:
            has = lambda marks: np.repeat(np.diff(np.concatenate([[0], np.cumsum(marks)])[words.first]) > 0, np.diff(words.first))
            left = ~has(known) & ((script > 0) | ~has(script > 0))
            allowed[left] = True
            known |= left
        out[~allowed] = -np.inf
        out[~known] = 0  # no learned language uses the script: no evidence
        out -= out.max(axis=1, keepdims=True)
        return np.maximum(out, -CLEAREST), known


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word, all texts side by side, longest first."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    n_langs = scores.shape[1]
    back = np.zeros(scores.shape, bool)  # TRUE: a change from the best language is better than staying
    best = np.zeros(len(scores), np.int16)  # the best language so far at each word
    ends = np.zeros(len(scores), np.int16)
    value = np.zeros((len(length), n_langs), np.float32)
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    for step, n in enumerate(active):
        at = begin[:n] + step
        value = value[:n]
        if step:
            top = value.argmax(axis=1)
            jump = value[np.arange(n), top][:, None] - penalty
            back[at] = jump > value
            best[at] = top
            value = np.maximum(value, jump)
        value = value + scores[at]
        ends[at] = value.argmax(axis=1)
    labels = ends.copy()
    for step in range(len(active) - 1, 0, -1):
        n = active[step]
        at = begin[:n] + step
        mine = labels[at]
        labels[at - 1] = np.where(back[at, mine], best[at], mine)
    return labels


SPANS = "array<struct<lang:string,begin:bigint,end:bigint>>"


def identify(docs: DataFrame, model: Model, row_id: str = "doc_id", text: str = "text", penalty: float = SWITCH,
             all_scripts: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and `lang_spans` (language and word numbers, end exclusive) of every row.

    With `all_scripts`, every text with a letter gets a learned language, also if none of them uses its script.
    """
    df = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = df.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches, limit=BLOCK):
            words = _block_words(batch)
            scores, known = model.scores(words, all_scripts) if model.langs else (np.zeros((len(words.begin), 1), np.float32), np.zeros(len(words.begin), bool))
            labels = viterbi(scores, words.first, penalty)
            weight = np.where(known, words.end - words.begin, 0)
            lettered = [t is not None and _letter.search(t) is not None for t in batch.column(1).to_pylist()]
            langs, shares, spans = [], [], []
            for i, has_letter in enumerate(lettered):
                a, b = words.first[i], words.first[i + 1]
                bytes_of = np.bincount(labels[a:b], weights=weight[a:b], minlength=max(1, len(model.langs)))
                total = bytes_of.sum()
                if not has_letter or not total:
                    langs.append(UNKNOWN)
                    shares.append(0.0)
                    spans.append([])
                    continue
                won = int(bytes_of.argmax())
                langs.append(model.langs[won])
                shares.append(float(bytes_of[won] / total))
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels[a:b])) + 1, [b - a]]).tolist()
                spans.append([{"lang": model.langs[labels[a + s]], "begin": s, "end": e} for s, e in zip(cuts[:-1], cuts[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, pa.list_(span))],
                names=["doc_id", "lang_pred", "score", "lang_spans"],
            )

    return df.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, lang_spans {SPANS}")


def learn(labelled: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang",
          rows_per_language: int = TRAINING_ROWS) -> Model:
    """A model from the rows with text and language, about `rows_per_language` of each, chosen by hash of the id."""
    rows = labelled.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna(subset=["text", "lang"])
    sizes = labelled.groupBy(F.col(lang).alias("lang")).count().dropna().collect()
    kept = F.lit(False)
    for r in sizes:
        share = min(1.0, rows_per_language / r["count"])
        kept = kept | ((F.col("lang") == r["lang"]) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    counted = rows.filter(kept).select("text", "lang").mapInArrow(_count, "lang string, bucket bigint, n bigint")
    return Model([tuple(r) for r in counted.groupBy("lang", "bucket").agg(F.sum("n")).toLocalIterator()])


@query("op8_language_id")
def op8_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    model = learn(docs.filter(~held_out))
    return identify(docs, model, all_scripts=True).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
