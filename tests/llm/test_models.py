"""Classifiers on held-out rows, mixing against its equations, and the pipeline against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldpulse.llm import language, mixing, quality_model
from fieldpulse.llm.queries import QUERIES
from fieldpulse.session import materialize

MEDIUM = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op8_language_id"].run(spark, MEDIUM).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def learned(spark, n=60):
    words = {"de": "der die und nicht ist eine".split(), "en": "the and of with that this".split(), "ru": "это что как его она для".split()}
    pick = random.Random(1)
    rows = [(i, " ".join(pick.choices(words[lang], k=40)), lang) for i, lang in enumerate(list(words) * n)]
    return language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")), words, pick


def test_spans_of_mixed_text(spark):
    model, words, pick = learned(spark)
    mixed = " ".join([*pick.choices(words["de"], k=30), *pick.choices(words["ru"], k=10), *pick.choices(words["en"], k=15)])
    row = language.identify(spark.createDataFrame([(1, mixed)], "doc_id bigint, text string"), model).first()
    assert [(s["lang"], s["begin"], s["end"]) for s in row["lang_spans"]] == [("de", 0, 30), ("ru", 30, 40), ("en", 40, 55)]
    assert row["lang_pred"] == "de"


def test_viterbi_against_all_paths():
    pick = np.random.default_rng(2)
    lengths = [0, 1, 5, 3, 0, 6]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = pick.normal(0, 3, (first[-1], 3)).astype(np.float32)
    got = language.viterbi(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = np.stack(np.meshgrid(*[range(3)] * (b - a), indexing="ij"), -1).reshape(-1, b - a) if b > a else np.zeros((1, 0), int)
        value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * (np.diff(p) != 0).sum()  # noqa: B023, E731
        assert value(got[a:b]) == pytest.approx(max(value(p) for p in paths), abs=1e-4)


def test_language_edge_rows(spark, edge, none, edge_rows):
    model, _, _ = learned(spark)
    rows = language.identify(edge, model).collect()
    assert len(rows) == len(edge_rows)
    of = {r["doc_id"]: r for r in rows}
    assert all(of[i]["lang_pred"] == "und" and of[i]["score"] == 0 for i in (1, 2, 3, 10))
    assert language.identify(none, model).count() == 0
    empty = language.learn(none)
    assert {r["lang_pred"] for r in language.identify(edge, empty).collect()} == {"und"}
    greek = language.identify(spark.createDataFrame([(1, "αυτό είναι")], "doc_id bigint, text string"), model).first()
    assert greek["lang_pred"] == "und"


def test_script_of_the_first_letter():
    made = ["«été", "¿qué", "“the", "—and", "«это", "…", "日本", "plain", "€", "🙂ok", "«“—где", "ລາວ", "ខ្មែរ", "አማርኛ", "தமிழ்", "ᚠᚢ"]
    data = " ".join(made).encode()
    words = language.texts.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), language.NO_LETTERS)
    want = ["latin", "latin", "latin", "latin", "cyrillic", "common", "han", "latin", "common", "latin", "cyrillic", "lao", "khmer", "ethiopic", "tamil", "other"]
    assert [language.SCRIPTS[k] for k in language.first_scripts(words)] == want


def test_every_text_with_a_letter_gets_a_language(spark, tmp_path):
    words = {"de": "der die und nicht ist eine".split(), "en": "the and of with that this".split()}
    pick = random.Random(4)
    rows = [(i, " ".join(pick.choices(words[lang], k=30)), lang) for i, lang in enumerate(list(words) * 100)]
    odd = ["это что как", "日本語", "αυτό είναι", "«und» “nicht” —ist", "¿the “and", "µ", "ℝ", "это … — the"]
    blank = [None, "", "12 34", "— … «»", "🙂"]
    rows += [(1000 + i, t, "en") for i, t in enumerate(odd)] + [(2000 + i, t, "en") for i, t in enumerate(blank)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    of = {r["doc_id"]: r for r in QUERIES["op8_language_id"].run(spark, str(tmp_path)).collect()}
    assert len(of) == len(rows)
    assert all(of[1000 + i]["lang_pred"] in words and 0 < of[1000 + i]["score"] <= 1 for i in range(len(odd)))
    assert all(of[2000 + i]["lang_pred"] == "und" and of[2000 + i]["score"] == 0 for i in range(len(blank)))
    assert of[1003]["lang_pred"] == "de" and of[1004]["lang_pred"] == "en"


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op6_quality_model"].run(spark, MEDIUM).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_attention_finds_the_bad_passage(spark):
    pick = random.Random(9)
    plain = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(240):
        words = [pick.choice(plain) for _ in range(64 * 5)]
        if i % 2:
            words[128:192] = ["###$$$"] * 64
        rows.append((i, " ".join(words)))
        marks.append((i, 1 - i % 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = quality_model.learn(docs, spark.createDataFrame(marks, "doc_id bigint, quality int"))
    out = quality_model.score(docs, model).collect()
    assert all((r["score"] < 0.5) == bool(r["doc_id"] % 2) for r in out)
    assert np.mean([np.argmax(r["attention"]) == 2 for r in out if r["doc_id"] % 2]) > 0.9
    assert all(sum(r["attention"]) == pytest.approx(1, abs=1e-4) for r in out)


def test_gradients():
    pick = np.random.default_rng(3)
    x, n, label = pick.normal(size=(9, 5)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    h = quality_model.HIDDEN
    w = {"V": pick.normal(size=(5, h)), "U": pick.normal(size=(5, h)), "a": pick.normal(size=h), "c": pick.normal(size=5), "b": np.zeros(1)}
    model = quality_model.AttentionModel()

    def loss():
        p = model._forward(w, x, np.array([0, 2, 5]), n)[-1]
        own = -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()
        return own + quality_model.DECAY / 2 * sum((w[k] ** 2).sum() for k in "VUac")

    gradient = model._gradient(w, x, n, label)
    for k, g in gradient.items():
        at = tuple(0 for _ in g.shape)
        before = w[k][at]
        w[k][at] = before + 1e-5
        up = loss()
        w[k][at] = before - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], abs=1e-6)
        w[k][at] = before


def test_quality_edge_rows(spark, edge, none, edge_rows):
    marks = spark.createDataFrame([(1, 0), (2, 0), (7, 1), (8, None), (None, 1), (4, 1), (4, 0), (9, 5)], "doc_id bigint, quality int")
    model = quality_model.learn(edge, marks)
    assert quality_model.score(edge, model).count() == len(edge_rows)
    assert quality_model.score(none, model).count() == 0
    blank = quality_model.learn(edge, marks.limit(0))
    assert {r["score"] for r in quality_model.score(edge, blank).collect()} == {0.5}


def test_mixing_meets_its_targets(spark):
    rows = QUERIES["op4_mixing"].run(spark, MEDIUM).collect()
    n = np.array([r["n_tokens"] for r in rows])
    p = np.array([[r["p_good"], r["p_poor"]] for r in rows])
    x = np.array([r["rate"] for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (x >= 0).all()
    totals = (n * x) @ p
    assert totals / totals.sum() == pytest.approx([0.98, 0.02], abs=2e-3)
    assert totals[0] == pytest.approx((n @ p)[0], rel=2e-3)
    assert all(abs(r["copies"] - r["rate"]) <= 1 for r in rows)


def test_rates_equal_plain_gradient_descent(spark):
    pick = np.random.default_rng(8)
    p = pick.dirichlet([1, 0.4, 0.2], 400)
    n = pick.integers(0, 500, 400)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "tokens bigint, p array<double>")
    targets = [0.2, 0.2, 0.6]
    moves = mixing.fit_rates(soft, targets, budget=float(n.sum()))
    x = np.ones(400)
    for move in moves:
        x = np.maximum(x - p @ move, 0)
    assert ((n * x) @ p) / n.sum() == pytest.approx(targets, abs=2e-3)
    got = [r["x"] for r in soft.select(mixing.rate_column(moves).alias("x")).collect()]
    assert got == pytest.approx(x.tolist(), abs=1e-9)
    assert len(moves) > 1 and (x == 0).any()


def test_mixing_edge_rows(spark, edge, none, edge_rows):
    marks = spark.createDataFrame([(4, "good"), (7, "poor"), (None, "good"), (8, None), (9, "other")], "doc_id bigint, domain string")
    out = mixing.mix(edge, marks)
    assert out.count() == len(edge_rows)
    assert mixing.draw(edge, marks).columns == edge.columns
    assert mixing.draw(none, marks).count() == 0 and mixing.mix(edge, marks.limit(0)).count() == len(edge_rows)


def test_copies(spark):
    rows = spark.range(20_000).select(mixing.copies_column(F.lit(1.3), F.col("id").cast("string")).alias("c"), mixing.copies_column(F.lit(0.95), F.col("id").cast("string")).alias("one"))
    assert rows.agg(F.avg("c")).first()[0] == pytest.approx(1.3, abs=0.02)
    assert rows.agg(F.avg("one")).first()[0] == pytest.approx(0.95, abs=0.01) and rows.filter("one > 1").count() == 0


def test_targets_out_of_reach_are_reported(spark):
    """All texts are one tenth of the second domain: half and half cannot be drawn from them."""
    soft = spark.createDataFrame([(10, [0.9, 0.1])] * 50, "tokens int, p array<double>")
    with pytest.warns(UserWarning, match="targets missed"):
        mixing.fit_rates(soft, [0.5, 0.5])


def two_kinds(spark, n=4000, poor=0.3):
    """Texts of two vocabularies, every tenth row twice, and labels of all; the text tells the domain."""
    pick = random.Random(12)
    words = {1: [f"good{i}" for i in range(40)], 0: [f"poor{i}" for i in range(40)]}
    rows = []
    for i in range(n):
        kind = int(pick.random() >= poor)
        rows += [(i, " ".join(pick.choices(words[kind], k=pick.randint(5, 60))))] * (1 + (i % 10 == 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(d, int(t.startswith("good"))) for d, t in dict(rows).items()], "doc_id bigint, quality int")
    return docs, marks


def test_copies_meet_the_targets(spark):
    docs, marks = two_kinds(spark)
    rows = mixing.mix(docs, marks.select("doc_id", mixing.domain_of_labels().alias("domain"))).collect()
    n = np.array([r["tokens"] for r in rows])
    p = np.array([r["p"] for r in rows])
    x, copies = (np.array([r[c] for r in rows]) for c in ("rate", "copies"))
    assert ((np.floor(x) <= copies) & (copies <= np.ceil(x))).all()
    totals = (n * copies) @ p
    assert totals / totals.sum() == pytest.approx([0.98, 0.02], abs=5e-3)
    assert totals[0] == pytest.approx((n @ p)[0], rel=2e-2)
    repeated = {}
    for r in rows:
        repeated.setdefault(r["row"]["doc_id"], set()).add(r["copies"])
    assert all(len(c) == 1 for c in repeated.values())


def test_pipeline_mixing_meets_the_targets(spark, tmp_path):
    docs, marks = two_kinds(spark)
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    drawn = [r["text"] for r in corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()]
    tokens = {kind: sum(len(t.split()) for t in drawn if t.startswith(kind)) for kind in ("good", "poor")}
    assert tokens["poor"] / sum(tokens.values()) == pytest.approx(0.02, abs=5e-3)


def test_pipeline_stages(spark, folder):
    from test_duplicates import plain_components
    from test_native import checked
    from test_scans import plain_matches

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), "stage")
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if name != "sharding":
            assert docs.columns == columns
    rules, single, clean, mixed, shards = kept
    want = QUERIES["op9_quality_rules"].run(spark, folder).filter("kept").select("doc_id").collect()
    assert set(rules) == {r[0] for r in want}
    parts = plain_components([(d, r["text"]) for d, r in rules.items()])
    assert set(single) == {d for d, (_, c) in parts.items() if c == d}
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {d: plain_matches(r["text"], items) for d, r in single.items()}
    assert set(clean) == {d for d, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n)}
    assert set(mixed) <= set(clean) and len(mixed) > 0.8 * len(clean)
    assert set(shards) == set(mixed)
    checked(shards.values(), corpus_pipeline.SHARDS)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def xxhash64(data, seed=42):
    """Spark's hash of a string, in plain Python."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    m = (1 << 64) - 1
    rotl = lambda x, r: ((x << r) | (x >> (64 - r))) & m
    lane = lambda acc, x: rotl((acc + x * p2) & m, 31) * p1 & m
    word = lambda i, k: int.from_bytes(data[i : i + k], "little")
    i, n = 0, len(data)
    if n >= 32:
        v = [(seed + p1 + p2) & m, (seed + p2) & m, seed, (seed - p1) & m]
        while i + 32 <= n:
            v = [lane(v[k], word(i + 8 * k, 8)) for k in range(4)]
            i += 32
        h = sum(rotl(x, r) for x, r in zip(v, (1, 7, 12, 18), strict=True)) & m
        for x in v:
            h = ((h ^ lane(0, x)) * p1 + p4) & m
    else:
        h = (seed + p5) & m
    h = (h + n) & m
    while i + 8 <= n:
        h = (rotl(h ^ lane(0, word(i, 8)), 27) * p1 + p4) & m
        i += 8
    if i + 4 <= n:
        h = (rotl(h ^ (word(i, 4) * p1 & m), 23) * p2 + p3) & m
        i += 4
    for b in data[i:]:
        h = rotl(h ^ (b * p5 & m), 11) * p1 & m
    h = (h ^ (h >> 33)) * p2 & m
    h = (h ^ (h >> 29)) * p3 & m
    return h ^ (h >> 32)


def plain_copies(docs, n, p, targets):
    """Copies of every row: gradient rounds over whole arrays, then the draw by hash of the id."""
    weights = np.array(targets) / sum(targets)
    total = (n @ p / n.sum())[weights.argmax()] / weights.max()
    x, step, before = np.ones(len(n)), 1.0, np.inf
    for _ in range(mixing.ROUNDS):
        residual = (n * x) @ p / n.sum() - total * weights
        if np.abs(residual).max() <= mixing.TOLERANCE:
            break
        live = n * (x > 0)
        step = step / 2 if np.abs(residual).max() > before else min(1.0, 1.5 * step)
        before = np.abs(residual).max()
        x = np.maximum(x - p @ (step * np.linalg.pinv((p * live[:, None]).T @ p / n.sum(), rcond=1e-6) @ residual), 0)
    share = np.array([signed(xxhash64(str(d).encode())) % (1 << 30) / (1 << 30) for d in docs])
    return np.floor(x) + (share < x - np.floor(x))


def test_pipeline_mixing_stage_against_plain_copies(spark, tmp_path):
    """The copies of every row that the stage returns, repeats included, but the posteriors are those of the model."""
    docs, marks = two_kinds(spark, 1500)
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    labels = marks.select("doc_id", mixing.domain_of_labels().alias("domain"))
    soft = mixing.with_posteriors(docs, mixing.learn(docs, labels, list(mixing.TARGETS))).collect()
    ids = [r["row"]["doc_id"] for r in soft]
    copies = plain_copies(ids, np.array([r["tokens"] for r in soft], float), np.array([r["p"] for r in soft]), list(mixing.TARGETS.values()))
    want, got = {}, {}
    for d, c in zip(ids, copies, strict=True):
        if c:
            want[d] = want.get(d, 0) + int(c)
    for r in corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want


def test_pipeline_of_nothing(spark, none, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
