"""Quality of texts by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded as surface statistics and a
hashed bag of words. Only texts carry labels, so a gated attention (tanh branch times sigmoid
branch) learns which passages of a text matter; the attention-weighted sum of the passages is
scored by a logistic unit. All weights are trained together by gradient descent on a bounded
sample of labelled texts, encoded on the executors.

Defined cases: an empty or NULL text is one passage without words and gets a score as well;
repeated rows are all scored; labels other than 0 and 1, NULL ids and NULL labels are not
learned from; several labels of one id count as the smallest; without any labelled row, or
with one class only, every score is the share of label 1 (one half if there are none).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldpulse.llm import text as texts
from fieldpulse.llm.registry import query, table

TRAINING_ROWS = 6_000  # labelled texts to learn from, chosen by hash of the id
PASSAGE_WORDS = 64
HASHED = 24  # dimensions of the hashed bag of words
HIDDEN = 12  # width of both attention branches
EPOCHS = 60
BATCH = 256  # texts in one gradient step
RATE = 0.01
DECAY = 1e-4

# Character classes counted in every passage.
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "stop": b".!?",
    "loud": b"!", "quote": b"\"'()[]{}", "comma": b",;:", "line": b"\n", "beyond": range(128, 256),
}
N_STATS = len(CLASSES) + 7
_class_of = {name: np.isin(np.arange(256), list(members)) for name, members in CLASSES.items()}


def encode(batch: pa.RecordBatch, hashed: int = HASHED) -> tuple[np.ndarray, np.ndarray]:
    """One row for each passage of the block, and the first passage of each text (at least one each).

    A row has N_STATS surface statistics and `hashed` dimensions of the hashed bag of words.
    """
    data, offsets = texts.joined(batch.column(batch.schema.get_field_index("text")))
    words = texts.Words(data, offsets)
    hashes = words.hashes()
    n_words = np.diff(words.first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n_passages)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], n_passages)
    of_text = np.repeat(np.arange(len(n_words)), n_passages)
    low = words.first[:-1][of_text] + number * PASSAGE_WORDS
    high = np.minimum(low + PASSAGE_WORDS, words.first[1:][of_text])
    count = high - low
    out = np.zeros((first[-1], N_STATS + hashed), np.float32)
    filled = np.flatnonzero(count)
    if len(filled):
        a, b = words.begin[low[filled]], words.end[high[filled] - 1]
        width = (b - a).astype(np.float32)
        for i, members in enumerate(_class_of.values()):
            sums = np.concatenate([[0], np.cumsum(members[data], dtype=np.int64)])
            out[filled, i] = (sums[b] - sums[a]) / width
        at = len(CLASSES)
        lengths = (words.end - words.begin).astype(np.float32)
        starts = low[filled]
        n = count[filled].astype(np.float32)
        mean = _sums(lengths, starts, high[filled]) / n
        out[filled, at] = mean / 10
        out[filled, at + 1] = np.sqrt(np.maximum(_sums(lengths**2, starts, high[filled]) / n - mean**2, 0)) / 10
        out[filled, at + 2] = width / n / 10
        same = np.zeros(len(hashes), np.float32)
        same[1:] = hashes[1:] == hashes[:-1]
        out[filled, at + 3] = _sums(same, starts, high[filled]) / n
        out[filled, at + 4] = _distinct(hashes, starts, high[filled]) / n
        out[filled, at + 5] = np.log1p(n) / 4
        for j in range(hashed):
            sign = ((hashes >> np.uint64(j)) & np.uint64(1)).astype(np.float32) * 2 - 1
            out[filled, N_STATS + j] = _sums(sign, starts, high[filled]) / n
    out[:, N_STATS - 1] = np.log1p(np.repeat(n_words, n_passages)) / 10
    return out, first


def _sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[high] - total[low]


def _distinct(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distinct words of each passage."""
    n = high - low
    passage = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    inside = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    # passage in the upper half, half of the hash in the lower: sorting brings equal words of a passage together
    key = np.sort((passage << np.uint64(32)) | (hashes[inside] >> np.uint64(32)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(32)).astype(np.int64), minlength=len(n))


class AttentionModel:
    """Gated attention over passages; `weights` is trained by `fit`."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.weights = prior, None

    def fit(self, passages: np.ndarray, first: np.ndarray, label: np.ndarray, seed: int = 7) -> AttentionModel:
        self.prior = float(label.mean()) if len(label) else 0.5
        if len(set(label.tolist())) < 2:
            return self
        self.mean, self.scale = passages.mean(axis=0), passages.std(axis=0) + 1e-3
        x = (passages - self.mean) / self.scale
        pick = np.random.default_rng(seed)
        d = x.shape[1]
        w = {
            "V": pick.normal(0, d**-0.5, (d, HIDDEN)), "U": pick.normal(0, d**-0.5, (d, HIDDEN)),
            "a": pick.normal(0, HIDDEN**-0.5, HIDDEN), "c": np.zeros(d), "b": np.zeros(1) + np.log(self.prior / (1 - self.prior)),
        }
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        step = 0
        for _ in range(EPOCHS):
            order = pick.permutation(len(label))
            for begin in range(0, len(order), BATCH):
                bags = order[begin : begin + BATCH]
                n = first[bags + 1] - first[bags]
                rows = np.arange(n.sum()) + np.repeat(first[bags] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                gradient = self._gradient(w, x[rows], n, label[bags])
                step += 1
                for k, g in gradient.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w[k] = w[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = {k: v.astype(np.float32) for k, v in w.items()}
        return self

    @staticmethod
    def _forward(w: dict, x: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple:
        t, s = np.tanh(x @ w["V"]), _sigmoid(x @ w["U"])
        e = (t * s) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        attention = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(x * attention[:, None], starts, axis=0)
        return t, s, attention, z, _sigmoid(z @ w["c"] + w["b"])

    def _gradient(self, w: dict, x: np.ndarray, n: np.ndarray, label: np.ndarray) -> dict:
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        t, s, attention, z, p = self._forward(w, x, starts, n)
        g = (p - label) / len(label)
        gz = np.repeat(g, n)[:, None] * w["c"]
        ga = (gz * x).sum(axis=1)
        ge = attention * (ga - np.repeat(np.add.reduceat(attention * ga, starts), n))
        gts = ge[:, None] * w["a"]
        return {
            "c": z.T @ g + DECAY * w["c"], "b": g.sum(keepdims=True), "a": (t * s).T @ ge + DECAY * w["a"],
            "V": x.T @ (gts * s * (1 - t * t)) + DECAY * w["V"], "U": x.T @ (gts * t * s * (1 - s)) + DECAY * w["U"],
        }

    def score(self, passages: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text and the attention of each passage."""
        if self.weights is None:
            n = np.diff(first)
            return np.full(len(n), self.prior), np.repeat(1 / n, n)
        x = ((passages - self.mean) / self.scale).astype(np.float32)
        _, _, attention, _, p = self._forward(self.weights, x, first[:-1], np.diff(first))
        return p, attention


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAINING_ROWS) -> AttentionModel:
    """A model from at most `rows` labelled texts. The labels of the sample, at most `rows`, are broadcast."""
    marks = (
        labels.select(F.col(row_id).alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    sample = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(marks), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches):
            passages, first = encode(batch)
            coded = [passages[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(coded, pa.binary())], names=["id", "label", "passages"])

    kind = sample.schema["id"].dataType.simpleString()
    found = sample.select("id", "label", "text").mapInArrow(run, f"id {kind}, label int, passages binary").collect()
    bags = [np.frombuffer(bytes(r["passages"]), np.float32).reshape(-1, N_STATS + HASHED)
            for r in sorted(found, key=lambda r: (r["id"], bytes(r["passages"])))]
    label_of = np.array([r["label"] for r in sorted(found, key=lambda r: (r["id"], bytes(r["passages"])))], np.float64)
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    return AttentionModel().fit(np.concatenate(bags) if bags else np.zeros((0, N_STATS + HASHED)), first, label_of)


def score(docs: DataFrame, model: AttentionModel, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and `attention` (one weight for each passage) of every row."""
    df = docs.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches):
            passages, first = encode(batch)
            scores, attention = model.score(passages, first)
            weights = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(attention.astype(np.float64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores.astype(np.float64)), weights], names=["doc_id", "score", "attention"]
            )

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double, attention array<double>")


@query("op6_quality_model")
def op6_quality_model(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = learn(docs, table(spark, folder, "labels").filter(~held_out))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
