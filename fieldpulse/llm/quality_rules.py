"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule rejects a text by one or two measures of it. On a sample drawn from all rows each
rule is timed, measures included, and its share of rejected texts is counted. The rules then
stand in a cascade ordered by rejection per cost: a measure is computed only for the texts that
every rule before has let pass. The order changes the work, never the verdict: a text is
kept exactly when no rule rejects it.

The cost of a rule is a slope: the sample is run through once and many times over, and the
difference in time, divided by the difference in rows, leaves out scheduling and compilation.

Defined cases: a NULL text has no words; texts without words are rejected by `few_words`; very
long texts are measured whole; repeated rows are judged alike and all returned; rules whose worth
is not clearly different keep the order in which they are given, as all rules do for an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldpulse.llm.registry import query, table
from fieldpulse.session import materialize

# White space between words, and the characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
CAPITAL = "[A-Z]"

SAMPLE_ROWS = 400  # rows, on average, on which cost and selectivity are estimated
TIMED_CHARS = 1_000_000  # characters of one timing: the sample is repeated until it has about so many
REPEATS = 16  # times that the sample is repeated at most
TIMINGS = 2  # the shorter one counts
LEAST_COST = 0.05  # a rule costs at least so much of what splitting a text into words costs
CLEARLY = 2.0  # a rule goes ahead of another if it is worth so many times as much

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BODY, WORDS, LIVE = "_body", "_words", "_live"


@dataclass(frozen=True)
class Rule:
    """`rejects` is TRUE for a text to go; `needs` names the measures it reads."""

    needs: tuple[str, ...]
    rejects: Column


def _occurrences(pattern: str) -> Column:
    return (F.size(F.split(BODY, pattern)) - 1).cast("bigint")


def _add(df: DataFrame, name: str, value: Column, live: Column) -> DataFrame:
    return df.withColumn(name, F.when(live, value))


def _lines(df: DataFrame, live: Column) -> DataFrame:
    lines = F.filter(F.split(BODY, "\n"), lambda line: line.rlike(NOT_SPACE))
    df = _add(df, "_lines", lines, live)
    df = _add(df, "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"), live)
    return _add(df, "n_lines", F.size("_lines").cast("bigint"), live).drop("_lines")


def _repeats(df: DataFrame, live: Column) -> DataFrame:
    """Words in repeated three-word windows.

    Each window is a 64-bit hash of its words; the hashes with their places are sorted
    within the row, and neighbours that agree mark their places. Only rows whose hashes
    are not all distinct are sorted. Every step is a column of its own, because inside a
    lambda an expression would be evaluated for each element.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(WORDS) - 3),
        lambda i: F.xxhash64(F.get(WORDS, i), F.get(WORDS, i + 1), F.get(WORDS, i + 2)),
    )
    df = df.withColumn("_grams", F.when(live & (F.size(WORDS) >= 3), hashes))
    in_order = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), in_order)).drop("_grams")
    twice = F.filter(
        "_sorted",
        lambda x, k: (F.get("_sorted", k - 1)["g"] == x["g"]) | (F.get("_sorted", k + 1)["g"] == x["g"]),
    )
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    number = F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("bigint")
    found = F.when(F.col("_sorted").isNull(), F.lit(0).cast("bigint")).otherwise(number)
    return _add(df, "n_repeat_words", found, live).drop("_sorted")


# How each measure is added; a step may add more than the measure it is named after.
STEPS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "n_words": lambda df, live: _add(df, "n_words", F.size(WORDS).cast("bigint"), live),
    "word_chars": lambda df, live: _add(df, "word_chars", F.length(F.array_join(WORDS, "")).cast("bigint"), live),
    "n_symbols": lambda df, live: _add(df, "n_symbols", _occurrences(SYMBOL), live),
    "n_capitals": lambda df, live: _add(df, "n_capitals", _occurrences(CAPITAL), live),
    "n_dup_lines": _lines,
    "n_lines": _lines,
    "n_repeat_words": _repeats,
}


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(BODY, body).withColumn(WORDS, F.array_remove(F.split(BODY, SPACE), ""))


def _measured(df: DataFrame, names: Sequence[str], live: Column) -> DataFrame:
    for name in names:
        if name not in df.columns:
            df = STEPS[name](df, live)
    return df


def base_rules() -> dict[str, Rule]:
    """The two rules every text must pass."""
    return {
        "few_words": Rule(("n_words",), F.col("n_words") < 50),
        "repeated_words": Rule(("n_words", "n_repeat_words"), 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    }


def default_rules() -> dict[str, Rule]:
    """Base rules and the further ones."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return base_rules() | {
        "symbols": Rule(("n_words", "n_symbols"), 2 * F.col("n_symbols") > n),
        "duplicate_lines": Rule(("n_dup_lines", "n_lines"), 2 * F.col("n_dup_lines") > F.col("n_lines")),
        "word_length": Rule(("n_words", "word_chars"), (chars < 2 * n) | (chars > 20 * n)),
        "capitals": Rule(("n_capitals",), 2 * F.col("n_capitals") > F.length(BODY)),
    }


def cascade_order(docs: DataFrame, rules: Mapping[str, Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejected share per cost, estimated on a sample of all rows.

    The sample is written to the shared folder, so no text reaches the driver.
    """
    n_docs = docs.count()
    if not n_docs:
        return list(rules)
    drawn = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, sample_rows / n_docs), seed=7)
    sample = materialize(drawn.repartition(1), "rule-sample")
    n, chars = sample.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    if not n:
        return list(rules)
    many = 1 + max(1, min(REPEATS, TIMED_CHARS // max(chars or 0, 1)))

    def run(rule: Rule, times: int) -> tuple[float, int]:
        rows = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_again"))
        measured = _measured(_prepared(rows, "text"), rule.needs, F.lit(True))
        begin = time.perf_counter()
        hits = measured.agg(F.count_if(rule.rejects)).first()[0]
        return time.perf_counter() - begin, hits

    def per_row(rule: Rule) -> tuple[float, float]:
        """(seconds, share of rejected texts)"""
        _, hits = run(rule, 1)  # compiles
        once, often = (min(run(rule, times)[0] for _ in range(TIMINGS)) for times in (1, many))
        return max(often - once, 0.0) / (n * (many - 1)), hits / n

    splitting, _ = per_row(Rule((), F.size(WORDS) < 0))
    worth = {}
    for name, rule in rules.items():
        seconds, share = per_row(rule)
        worth[name] = share / max(seconds - splitting, LEAST_COST * splitting, 1e-9)
    return by_worth(worth)


def by_worth(worth: Mapping[str, float], clearly: float = CLEARLY) -> list[str]:
    """Names by falling worth; one moves ahead of another only if it is worth `clearly` times as much."""
    order: list[str] = []
    for name, own in worth.items():
        place = len(order)
        while place and own > clearly * worth[order[place - 1]]:
            place -= 1
        order.insert(place, name)
    return order


def apply_rules(docs: DataFrame, rules: Mapping[str, Rule] | None = None, order: Sequence[str] | None = None,
                text: str = "text", measures: Sequence[str] = ()) -> DataFrame:
    """`_row` (the input's columns), `rejected_by` (NULL if no rule rejects the text) and `kept`.

    `measures` are computed for every row and returned; others only where the cascade
    needs them. `rejected_by` names the first rule that rejects, so with several failing
    rules it follows from the measured order.
    """
    rules = rules or default_rules()
    order = order or cascade_order(docs, rules, text)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = _prepared(docs.select(whole.alias("_row"), F.col(text).alias("_text")), "_text")
    df = _measured(df, measures, F.lit(True)).withColumn(LIVE, F.lit(True))
    rejected_by = F.lit(None).cast("string")
    for name in order:
        df = _measured(df, rules[name].needs, F.col(LIVE))
        df = df.withColumn(LIVE, F.col(LIVE) & ~F.coalesce(rules[name].rejects, F.lit(False)))
    for name in reversed(order):
        rejected_by = F.when(rules[name].rejects, F.lit(name)).otherwise(rejected_by)
    # the row number never decides; it keeps a filter on `kept` above the measures, instead of
    # being pushed below them with a copy of every measure's expression inside
    kept = F.col(LIVE) & (F.monotonically_increasing_id() >= 0)
    return df.select("_row", *measures, rejected_by.alias("rejected_by"), kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, with the columns of `docs` only."""
    return apply_rules(docs, text=text).filter("kept").select("_row.*")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, len(ws)::BIGINT AS n_words, len(ls)::BIGINT AS n_lines,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN v ON w.doc_id = v.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR 2 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > length(t)) AS kept
FROM f
"""


@query("op9_quality_rules", SQL)
def op9_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = apply_rules(docs, measures=MEASURES)
    failed = base_rules()["few_words"].rejects | base_rules()["repeated_words"].rejects
    return judged.select("_row.doc_id", *MEASURES, failed.alias("base_failed"), "kept")
