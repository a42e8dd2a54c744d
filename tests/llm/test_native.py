"""Quality rules and sharding: SQL, plain versions, edge rows, plans without Python."""

import zlib

import oracle
import pytest
from pyspark.sql import functions as F

from fieldpulse.llm import quality_rules, sharding
from fieldpulse.llm.queries import QUERIES


def test_quality_rules_equal_sql(spark, folder):
    query = QUERIES["op9_quality_rules"]
    assert oracle.differences(query.run(spark, folder), oracle.connect(folder), query.sql) is None


def plain_repeats(text):
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


@pytest.mark.parametrize("text", ["", "a", "a b c a b c", "a a a a", "a b c x a b c y a b c", "x y z\nx y z\n\n x y z"])
def test_repeats(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = quality_rules.apply_rules(docs, order=list(quality_rules.default_rules()), measures=quality_rules.MEASURES).first()
    assert row["n_repeat_words"] == plain_repeats(text) and row["n_words"] == len(text.split())
    lines = [line for line in text.split("\n") if line.split()]
    assert row["n_dup_lines"] == len(lines) - len(set(lines))


def test_order_changes_no_verdict(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rules = quality_rules.default_rules()
    orders = [list(rules), list(reversed(rules))]
    kept = [sorted(r[0] for r in quality_rules.apply_rules(docs, rules, o).filter("kept").select("_row.doc_id").collect()) for o in orders]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()
    assert sorted(quality_rules.cascade_order(docs, rules)) == sorted(rules)


def test_order_goes_by_clear_differences_only():
    assert quality_rules.by_worth({"a": 1.0, "b": 1.9, "c": 5.0, "d": 0.0, "e": 4.0}) == ["c", "e", "a", "b", "d"]
    assert quality_rules.by_worth({"a": 0.0, "b": 0.0}) == ["a", "b"] and quality_rules.by_worth({}) == []


def test_order_is_estimated_from_all_rows(spark):
    """Only the last tenth of the rows breaks the rule on symbols, the others are rejected by none."""
    good = " ".join(f"plain{i}" for i in range(80))
    bad = " ".join(f"#plain{i}##" for i in range(80))
    docs = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") < 3600, good).otherwise(bad).alias("text"))
    rules = quality_rules.default_rules()
    orders = [quality_rules.cascade_order(docs, rules) for _ in range(2)]
    assert {order[0] for order in orders} == {"symbols"}
    assert quality_rules.cascade_order(docs.limit(0), rules) == list(rules)


def test_quality_edge_rows(spark, edge, none, edge_rows):
    out = quality_rules.apply_rules(edge, measures=quality_rules.MEASURES)
    assert out.count() == len(edge_rows)
    assert out.filter("_row.doc_id = 1").first()["n_words"] == 0
    assert quality_rules.keep_good(edge).columns == edge.columns
    assert quality_rules.keep_good(none).count() == 0 and quality_rules.apply_rules(none).count() == 0


def test_no_python_in_the_plans(spark, folder):
    for name in ("op7_sharding", "op9_quality_rules"):
        plan = QUERIES[name].run(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sharding_equals_sql(spark, folder):
    got = QUERIES["op7_sharding"].run(spark, folder)
    assert oracle.differences(got.drop("text_crc32"), oracle.connect(folder), sharding.SQL) is None
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got.collect())


def checked(rows, n_shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < n_shards for s in by_shard)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in by_shard.items()}


def test_hot_text_is_spread(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))).alias("text"))
    sizes = checked(sharding.shard(docs, 7).collect(), 7)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 2 * 97


def test_cells_and_tolerance(spark, folder, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 10)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = checked(sharding.shard(docs, 5).collect(), 5)
    loose = checked(sharding.shard(docs, 5, tolerance=10_000).collect(), 5)
    assert sum(sizes.values()) == sum(loose.values())


def test_hot_text_is_numbered_in_small_cells(spark, monkeypatch):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string")).alias("text"))
    sized = sharding.with_key(docs)
    levels = sharding.find_cells(sized, 6000, 20)
    assert len(levels) > 3 and levels[-1][1] == []
    cells = sized.groupBy(sharding.cell_of(levels).alias("cell")).count()
    assert cells.agg(F.max("count")).first()[0] <= 40
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 20)
    rows = sharding.shard(docs, 5).collect()
    sizes = checked(rows, 5)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 12
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 10_000)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shard(docs, 5).collect()))


def test_rows_of_one_key_end_the_cutting(spark):
    docs = spark.range(100).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))
    levels = sharding.find_cells(sharding.with_key(docs), 100, 5)
    assert levels[-1] == (0, [])


def test_sharding_edge_rows(spark, edge, none, edge_rows):
    rows = sharding.shard(edge, 3).collect()
    assert len(rows) == len(edge_rows) and sharding.shard(none, 3).count() == 0
    checked(rows, 3)
    (null,) = [r for r in rows if r["doc_id"] == 1]
    assert null["size"] == 8 and null["text_crc32"] == 0
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    assert checked(sharding.shard(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), 24).collect(), 24)
