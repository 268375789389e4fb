import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing as M


def documents(spark):
    rng = random.Random(1)
    rows = [(i, ("Big Site", "big site ", "BIG SITE")[i % 3], rng.randrange(20, 60), 1.0, 1) for i in range(6000)] + [(9000 + i, "small_one", rng.randrange(20, 60), 0.5, 1) for i in range(60)] + [(9900, None, 9, 1.0, 1), (9901, "big site", 0, 1.0, 1), (9902, "untargeted", 50, 1.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, weight double, slice int")
    targets = spark.createDataFrame([("big site", 0.7, 2), ("Small-One", 0.2, 4), ("gone", 0.1, 5)], "source string, target_share double, max_repeats int")
    return docs, targets, sum(r[2] for r in rows if r[1] and r[1].strip().lower() == "big site"), sum(r[2] for r in rows if r[1] == "small_one")


def test_small_sources_fall_short_and_the_total_is_kept(spark):
    docs, targets, big, small = documents(spark)
    drawn, report = M.mix(docs, targets)
    got = {r.source: r for r in report.collect()}
    assert got["small-one"].tokens == 4 * small and got["small-one"].most_repeats == 4  # asked for more than its cap gives
    assert abs(got["big site"].tokens - (big + small - 4 * small)) < 60  # gets what the small source lacks
    assert got["gone"].tokens == 0 and got["gone"].effective_share == 0 and got["gone"].shortfall == 0.1
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect()
    assert {r.source: r.t for r in used} == {s: r.tokens for s, r in got.items() if r.tokens}
    assert drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    assert [tuple(r) for r in M.mix(docs, targets)[0].orderBy("doc_id").collect()] == [tuple(r) for r in drawn.orderBy("doc_id").collect()]


def test_shares_are_met_where_sources_suffice(spark):
    docs, targets, big, small = documents(spark)
    got = {r.source: r for r in M.mix(docs, targets, total_tokens=9000)[1].collect()}
    assert abs(got["big site"].actual_share - 0.7 / 0.9) < 0.01 and abs(got["small-one"].actual_share - 0.2 / 0.9) < 0.01
    assert got["small-one"].epochs == 9000 * 0.2 / 0.9 // small
    got = {r.source: r for r in M.mix(docs, targets, total_tokens=10**9)[1].collect()}  # more than there is: all at their caps
    assert got["big site"].tokens == 2 * big and got["small-one"].tokens == 4 * small


def test_one_tiny_source_does_not_shrink_the_total(spark):
    docs = spark.range(1001).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "big").otherwise("tiny").alias("source"), F.lit(100).cast("bigint").alias("tokens"), F.lit(1.0).alias("weight"))
    targets = spark.createDataFrame([("big", 0.5, 2), ("tiny", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in M.mix(docs, targets, total_tokens=50_000)[1].collect()}
    assert got["tiny"].tokens == 200 and abs(got["big"].tokens - 49_800) <= 100 and got["tiny"].shortfall > 0.49


def test_ranges_are_narrowed_to_the_same_cut(spark, monkeypatch):
    docs, targets, _, _ = documents(spark)
    whole = sorted(map(tuple, M.mix(docs, targets, total_tokens=30_000)[0].collect()))
    monkeypatch.setattr(M, "ORDERED", 1)
    assert sorted(map(tuple, M.mix(docs, targets, total_tokens=30_000)[0].collect())) == whole


def test_weights_raise_the_chance(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("bigint").alias("tokens"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.1).alias("weight"))
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    drawn = M.mix(docs, targets, total_tokens=4000)[0]
    heavy = drawn.where("doc_id % 2 = 0").count()
    assert drawn.count() == 400 and heavy > 320


def test_nulls_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", 10, None), (1, "a", 10, None), (2, "A", None, 1.0), (None, "a", 10, 1.0), (3, "b", 10, 1.0)], "doc_id bigint, source string, tokens bigint, weight double")
    targets = spark.createDataFrame([("a", 0.5, None), (None, 0.2, 1), ("b", None, 1), (" A", 0.3, 2)], "source string, target_share double, max_repeats int")
    drawn, report = M.mix(docs, targets)
    assert sorted((r.source, r.repeats) for r in drawn.collect()) == [("a", 1)] * 3
    assert {r.source: (r.tokens, r.max_repeats) for r in report.collect()} == {"a": (30, 1), "b": (0, 1)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, weight double")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    drawn, report = M.mix(docs, targets)
    assert drawn.count() == 0 and [r.actual_share for r in report.collect()] == [0.0]
    assert M.mix(docs, targets.limit(0))[1].count() == 0


def test_too_many_targets_are_refused(spark):
    docs, _, _, _ = documents(spark)
    many = spark.range(10_001).select(F.col("id").cast("string").alias("source"), F.lit(0.0).alias("target_share"), F.lit(1).alias("max_repeats"))
    with pytest.raises(ValueError, match="10000"):
        M.mix(docs, many)
