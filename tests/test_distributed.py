"""Work along one order, Bloom filters and metrics on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import bloom, metrics, ordered


@pytest.mark.parametrize("parts", ["1", "7"])
def test_order_of_a_whole_table(spark, monkeypatch, parts):
    """Numbers, running sums and sliding windows over ranges and segments that are cut everywhere; nulls first."""
    monkeypatch.setattr(ordered, "SEGMENT", 5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        r = random.Random(1)
        rows = [(k if k else None, r.randint(-9, 9) if r.random() < 0.9 else None) for k in range(200)]
        frame = spark.createDataFrame(rows, "k long, v long").repartition(3)
        value = [v or 0 for _, v in rows]
        got = {x["k"]: x[ordered.NUMBER] for x in ordered.numbered(frame, "k").collect()}
        assert got == {k: i for i, (k, _) in enumerate(rows)}
        got = {x["k"]: x["total"] for x in ordered.running(frame, ["k"], {"total": "v"}).collect()}
        assert got == {k: sum(value[: i + 1]) for i, (k, _) in enumerate(rows)}
        for width in (1, 2, 6, 9):
            found = ordered.sliding(frame, ["k"], width, {"s": lambda w: F.sum(F.coalesce("v", F.lit(0))).over(w), "n": lambda w: F.count("*").over(w)})
            assert {x["k"]: (x["s"], x["n"]) for x in found.collect()} == {k: (sum(value[i : i + width]), len(value[i : i + width])) for i, (k, _) in enumerate(rows)}
        assert ordered.numbered(frame.limit(0), "k").count() == ordered.sliding(frame.limit(0), ["k"], 3, {"n": lambda w: F.count("*").over(w)}).count() == 0
        with pytest.raises(ValueError):
            ordered.sliding(frame, ["k"], 0, {})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_bloom_filter(spark, monkeypatch):
    monkeypatch.setattr(bloom, "PIECE", 64)
    frame = spark.range(0, 40_000, 4).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("t")).repartition(5)
    for error in (0.1, 0.01, 0.001):
        own = bloom.build(frame, ["k", "t"], error)
        there = frame.where(bloom.maybe_in(own, ["k", "t"])).count()
        others = spark.range(1, 80_000, 2).select(F.col("id").alias("k"), F.lit("x").alias("t"))
        wrong = others.where(bloom.maybe_in(own, ["k", "t"])).count() / 40_000
        assert there == 10_000 and wrong < 1.6 * error + 0.0005, (error, wrong)
        assert own.bits == bloom.shape(10_000, error)[0]
    nothing = bloom.build(frame.limit(0), ["k"])
    assert frame.where(bloom.maybe_in(nothing, ["k"])).count() == 0


def test_thinned_join_equals_the_join(spark, monkeypatch):
    large = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 500).alias("k"), F.col("id").alias("v")).repartition(4)
    small = spark.createDataFrame([(3, "a"), (3, "b"), (499, "c"), (9999, "d"), (None, "e")], "k long, w string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(large.join(small, ["k"]))
    assert rows(bloom.thinned_join(large, small, ["k"])) == want
    plan = bloom.thinned_join(large, small, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    monkeypatch.setattr(bloom, "MOST_BYTES", 1)
    assert bloom.build(large, ["k"]) is None and rows(bloom.thinned_join(large, small, ["k"])) == want


def test_areas_and_curve(spark):
    r = random.Random(4)
    rows = [(round(r.random(), 2), int(r.random() < 0.3)) for _ in range(500)] + [(None, 1), (0.5, None)]
    frame = spark.createDataFrame(rows, "s double, y int").repartition(6)
    known = [x for x in rows if None not in x]
    curve = metrics.thresholds(frame, "s", "y")
    found = metrics.areas(curve).first()
    up, down = [s for s, y in known if y], [s for s, y in known if not y]
    assert found["area_roc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down))
    points = [(sum(a >= t for a in up), sum(b >= t for b in down)) for t in sorted({s for s, _ in known}, reverse=True)]
    precision, recall = [a / (a + b) for a, b in points], [a / len(up) for a, _ in points]
    pr = sum((x1 - x0) * (p0 + p1) / 2 for x0, x1, p0, p1 in zip([0.0, *recall], recall, [precision[0], *precision], precision))
    assert found["area_pr"] == pytest.approx(pr) and found["rows"] == 500
    assert sorted((x["tp"], x["fp"]) for x in curve.collect()) == sorted(points)
    few = metrics.binned_curve(curve, 10).collect()
    assert len(few) == 10 and {(x["tp"], x["fp"]) for x in few} <= set(points) and max(x["tp"] for x in few) == len(up)
    alone = metrics.areas(metrics.thresholds(frame.where("y = 1"), "s", "y")).first()
    assert alone["area_roc"] is None and alone["area_pr"] == pytest.approx(1.0)
    assert metrics.areas(metrics.thresholds(frame.limit(0), "s", "y")).first()["rows"] == 0


def test_rankings(spark):
    rows = [([1, 2, 3, 4], [2, 4, 9]), ([5, 6], []), ([7, 7, 8], [7, 8]), ([], [1]), ([9, 8, 7, 6, 5, 4], [4])]
    k, want = 3, []
    for predicted, relevant in rows:
        seen, hits, ap, gain, first = set(), 0, 0.0, 0.0, 0
        for i, x in enumerate(predicted):
            if x in relevant and x not in seen:
                hits += 1
                ap += hits / (i + 1)
                gain += 1 / math.log2(i + 2) if i < k else 0
                first += i < k
            seen.add(x)
        ideal = sum(1 / math.log2(i + 2) for i in range(min(k, len(relevant))))
        want.append((first / k, ap / len(relevant), gain / ideal) if relevant else (0.0, 0.0, 0.0))
    got = metrics.ranking_metrics(spark.createDataFrame(rows, "p array<long>, r array<long>"), "p", "r", k).first()
    assert got["rows"] == 5 and [got["precision"], got["average_precision"], got["ndcg"]] == pytest.approx(list(np.mean(want, 0)))
