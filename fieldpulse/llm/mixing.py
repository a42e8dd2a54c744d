"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives every text posteriors over the domains. Each
text i with n_i tokens gets a nonnegative rate x_i such that the expected tokens of each domain,
the sum of n_i x_i p_ik, match the targets. The rates come from projected-gradient least
squares, distributed: starting from rate 1, every round sums the expected tokens in one
aggregation, and each text moves by its posteriors times the whitened residual and is cut off
at zero. A text's rate follows from its posteriors and the residuals of all rounds, so only
one vector for each round reaches the driver and no rate has to be stored between rounds.

Rates become whole numbers of copies: the whole part, and one more with the probability of the
rest, by hash, whatever the rate, so that the expected tokens of the copies are those of the rates.

Defined cases: a NULL or empty text has no tokens and gets a rate like any other; repeated rows
have equal rates and are drawn alike; domains that no row is labelled with have posterior 0;
without labelled rows all posteriors are equal shares; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldpulse.llm import text as texts
from fieldpulse.llm.quality_model import N_STATS, encode
from fieldpulse.llm.registry import query, table
from fieldpulse.session import materialize

TRAINING_ROWS = 6_000  # labelled texts to learn from, chosen by hash of the id
BUCKET_BITS = 13
EPOCHS = 80
RATE = 0.05
DECAY = 1e-4
ROUNDS = 40  # most gradient rounds
TOLERANCE = 1e-4  # largest residual, as a share of all tokens, at which the rounds end

DOMAINS = ("good", "poor")
TARGETS = {"good": 0.98, "poor": 0.02}


def domain_of_labels() -> Column:
    """The domain of a row of the labelled table."""
    return F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean passage of each text, the word buckets of all texts, and the first word of each."""
    passages, first = encode(batch, hashed=0)
    dense = np.add.reduceat(passages, first[:-1], axis=0) / np.diff(first)[:, None]
    words = texts.Words(*texts.joined(batch.column(batch.schema.get_field_index("text"))), texts.PUNCTUATION)
    return dense, (words.hashes() >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), words.first


class SoftDomains:
    """Softmax regression on the mean passage and the hashed words of a text."""

    def __init__(self, domains: Sequence[str]):
        self.domains = list(domains)
        k = len(self.domains)
        self.mean, self.scale = np.zeros(N_STATS), np.ones(N_STATS)
        self.dense, self.words = np.zeros((N_STATS, k)), np.zeros((1 << BUCKET_BITS, k))
        self.bias = np.zeros(k)

    def posteriors(self, dense: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = ((dense - self.mean) / self.scale) @ self.dense + self.bias
        n = np.diff(first)
        for k in range(z.shape[1]):
            total = np.concatenate([[0], np.cumsum(self.words[buckets, k])])
            z[:, k] += (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(n, 1))
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, dense: np.ndarray, buckets: np.ndarray, first: np.ndarray, domain: np.ndarray) -> SoftDomains:
        if not len(domain):
            return self
        wanted = np.eye(len(self.domains))[domain]
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
        self.bias = np.log(wanted.mean(axis=0) + 1e-9)
        x = (dense - self.mean) / self.scale
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        weight = 1 / np.sqrt(np.maximum(n, 1))
        parameters = [self.dense, self.words, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        for step in range(1, EPOCHS + 1):
            g = (self.posteriors(dense, buckets, first) - wanted) / len(n)
            by_word = np.stack([np.bincount(buckets, (g[:, k] * weight)[owner], 1 << BUCKET_BITS) for k in range(g.shape[1])], axis=1)
            gradients = [x.T @ g + DECAY * self.dense, by_word + DECAY * self.words, g.sum(axis=0)]
            for p, d, (m, v) in zip(parameters, gradients, moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def learn(docs: DataFrame, labelled: DataFrame, domains: Sequence[str] = DOMAINS, row_id: str = "doc_id", text: str = "text",
          rows: int = TRAINING_ROWS) -> SoftDomains:
    """A classifier from at most `rows` rows of `labelled` (doc_id, domain); the chosen ids are broadcast."""
    marks = (
        labelled.select(F.col("doc_id").alias("id"), F.col("domain")).dropna().filter(F.col("domain").isin(list(domains)))
        .groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    sample = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(marks), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches):
            dense, buckets, first = _features(batch)
            bags = [buckets[a:b].astype(np.uint16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "domain")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([d.tobytes() for d in dense.astype(np.float32)], pa.binary()), pa.array(bags, pa.binary())],
                names=["id", "domain", "dense", "bag"],
            )

    kind = sample.schema["id"].dataType.simpleString()
    found = sample.select("id", "domain", "text").mapInArrow(run, f"id {kind}, domain string, dense binary, bag binary").collect()
    found.sort(key=lambda r: (r["id"], bytes(r["bag"])))
    dense = np.array([np.frombuffer(bytes(r["dense"]), np.float32) for r in found]).reshape(len(found), N_STATS)
    bags = [np.frombuffer(bytes(r["bag"]), np.uint16) for r in found]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    buckets = np.concatenate(bags).astype(np.int64) if bags else np.zeros(0, np.int64)
    return SoftDomains(domains).fit(dense, buckets, first, np.array([list(domains).index(r["domain"]) for r in found], np.int64))


def _score(model: SoftDomains) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches):
            dense, buckets, first = _features(batch)
            p = model.posteriors(dense, buckets, first)
            tokens = texts.Words(*texts.joined(batch.column(batch.schema.get_field_index("text")))).first
            made = [pa.array(np.diff(tokens), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", "tokens", "p"])
    return run


def with_posteriors(docs: DataFrame, model: SoftDomains, text: str = "text") -> DataFrame:
    """The input's rows as a struct `row`, with `tokens` and the posteriors `p`."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return whole.mapInArrow(_score(model), f"row {whole.schema['row'].dataType.simpleString()}, tokens bigint, p array<double>")


def _dot(vector: Sequence[float]) -> Column:
    return sum((F.get("p", F.lit(k)) * F.lit(float(v)) for k, v in enumerate(vector)), F.lit(0.0))


def rate_column(moves: Sequence[Sequence[float]]) -> Column:
    """The rate after the given rounds: each moves it by -p . move and cuts it off at zero."""
    if not len(moves):
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in move]) for move in moves])

    def one(x, move):
        along = sum((F.get("p", F.lit(k)) * F.get(move, F.lit(k)) for k in range(len(moves[0]))), F.lit(0.0))
        return F.greatest(x - along, F.lit(0.0))

    return F.aggregate(steps, F.lit(1.0), one)


def fit_rates(soft: DataFrame, targets: Sequence[float], budget: float | None = None,
              rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """The moves of all rounds. `soft` has `tokens` and `p`; it is read once a round.

    Without `budget` the total is the one at which the domain with the largest weight keeps
    its tokens; the others are then thinned out or repeated to meet their shares.
    The residual is whitened with the token-weighted second moments of the posteriors of the
    texts whose rate is above zero, so that rare domains converge as fast as common ones; the
    step is halved whenever the residual has grown. Targets that the texts cannot meet are warned
    of with what is missing; the moves are those up to the smallest residual.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    weights = np.array(targets, float) / sum(targets)
    p = lambda i: F.get("p", F.lit(i))
    moves: list[list[float]] = []
    n, step, size_before, best = 0.0, 1.0, np.inf, (np.inf, 0)
    while True:
        live = F.when(F.col("x") > 0, F.col("tokens")).otherwise(0)
        row = soft.select("tokens", "p", rate_column(moves).alias("x")).agg(
            F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("x") * p(i)) for i in range(k)],
            *[F.sum(live * p(i) * p(j)) for i, j in pairs],
        ).first()
        if not moves:
            n = float(row[0] or 0)
            if not n:
                return []
        expected = np.array([float(v) for v in row[1 : k + 1]]) / n
        if not moves:
            total = budget / n if budget else expected[weights.argmax()] / weights.max()
        moments = np.zeros((k, k))
        for (i, j), value in zip(pairs, row[k + 1 :], strict=True):
            moments[i, j] = moments[j, i] = value / n
        residual = expected - total * weights
        size = np.abs(residual).max()
        if size < best[0]:
            best = size, len(moves)
        if size <= tolerance or len(moves) == rounds:
            if best[0] > tolerance:
                shares = ", ".join(f"{x:.4f}" for x in (expected / max(expected.sum(), 1e-300)))
                warnings.warn(f"targets missed: residual {best[0]:.2e} of the tokens after {len(moves)} rounds, shares {shares}", stacklevel=2)
            return moves[: best[1]]
        step = step / 2 if size > size_before else min(1.0, 1.5 * step)
        size_before = size
        moves.append((step * np.linalg.pinv(moments, rcond=1e-6) @ residual).tolist())


def copies_column(rate: Column, key: Column) -> Column:
    """Whole copies of a text with this rate: its whole part, and one more with the probability of the rest, by hash of `key`."""
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(share < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None,
        row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`row` (the input's columns), `tokens`, posteriors `p`, `rate` and `copies` of every row."""
    model = learn(docs, labelled, list(targets), row_id, text)
    soft = with_posteriors(docs, model, text)
    slim = materialize(soft.select("tokens", "p"), "posteriors")
    rate = rate_column(fit_rates(slim, list(targets.values()), budget))
    key = F.coalesce(F.col("row").getField(row_id).cast("string"), F.col("row").getField(text), F.lit(""))
    return soft.withColumn("rate", rate).withColumn("copies", copies_column(F.col("rate"), key))


def draw(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """The rows of `docs`, each as often as its copies."""
    mixed = mix(docs, labelled, targets, budget).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


@query("op4_mixing")
def op4_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labelled = table(spark, folder, "labels").select("doc_id", domain_of_labels().alias("domain"))
    shown = [F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(TARGETS)]
    return mix(docs, labelled).select("row.doc_id", F.col("tokens").alias("n_tokens"), *shown, "rate", "copies")
