"""How well scores and rankings tell what they are to tell, exactly and without a task that sees all scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.shared import materialize
from wayfold.operators.ordered import NUMBER, numbered, running


def thresholds(df: DataFrame, score: str, label: str) -> DataFrame:
    """Of each distinct score, from the highest: its positive and negative rows, and those of all scores as high. Rows without score or label are left out."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("threshold"))
    positive = F.col(label).cast("double") > 0.5
    counts = counts.agg(F.sum(positive.cast("long")).alias("positive"), F.sum((~positive).cast("long")).alias("negative"))
    return running(counts, [F.col("threshold").desc()], {"tp": "positive", "fp": "negative"})


def areas(curve: DataFrame) -> DataFrame:
    """One row: rows, positives, area under the receiver operating characteristic and under precision by recall (trapezoids)."""
    curve = materialize(curve, "curve")
    total = curve.agg(F.sum("positive").alias("p"), F.sum("negative").alias("n")).first()
    p, n = total["p"] or 0, total["n"] or 0
    tp0, fp0 = F.col("tp") - F.col("positive"), F.col("fp") - F.col("negative")
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(now)
    over = lambda of, by: F.sum(of) / F.lit(float(by)) if by else F.lit(None).cast("double")
    return curve.agg(
        F.lit(p + n).cast("long").alias("rows"),
        F.lit(p).cast("long").alias("positives"),
        over(F.col("negative") * (tp0 + F.col("tp")) / 2.0, p * n).alias("area_roc"),
        over(F.col("positive") * (now + before) / 2.0, p).alias("area_pr"),
    )


def binned_curve(curve: DataFrame, bins: int) -> DataFrame:
    """At most ``bins`` points of a curve: of each bin of thresholds, in order, the last."""
    rows = materialize(numbered(curve, F.col("threshold").desc()), "curve-numbers")
    n = rows.count()
    last = F.struct(*(F.col(c) for c in ("threshold", "tp", "fp")))
    found = rows.groupBy(F.floor(F.col(NUMBER) * bins / max(n, 1)).alias("bin")).agg(F.max_by(last, NUMBER).alias("last"))
    return found.select("bin", "last.threshold", "last.tp", "last.fp")


def ranking(predicted: str, relevant: str, k: int) -> dict[str, Column]:
    """Columns of a row's ranking (ids from the best) against its set of relevant ids: precision and discounted gain at k, average precision."""
    hit = f"array_contains({relevant}, x)"
    marks = f"transform({predicted}, (x, i) -> struct(i AS i, CAST(i < array_position({predicted}, x) AND {hit} AS INT) AS h))"  # a repeated id counts once
    gain = lambda of: f"aggregate({of}, 0D, (a, m) -> a + m.h / log2(m.i + 2))"
    hits = f"aggregate({marks}, named_struct('n', 0, 's', 0D), (a, m) -> named_struct('n', a.n + m.h, 's', a.s + IF(m.h = 1, (a.n + 1) / (m.i + 1), 0D)), a -> a.s)"
    ideal = f"aggregate(sequence(0, greatest(least({k}, size({relevant})), 1) - 1), 0D, (a, i) -> a + 1 / log2(i + 2))"
    some = f"size({relevant}) > 0"
    zero = lambda text: F.expr(f"CASE WHEN {some} THEN {text} ELSE 0D END")
    return {
        "precision": zero(f"aggregate(slice({marks}, 1, {k}), 0D, (a, m) -> a + m.h) / {k}"),
        "average_precision": zero(f"{hits} / size({relevant})"),
        "ndcg": zero(f"{gain(f'slice({marks}, 1, {k})')} / {ideal}"),
    }


def ranking_metrics(df: DataFrame, predicted: str, relevant: str, k: int) -> DataFrame:
    """One row: the means of the ranking's measures over all rows; a row without relevant ids counts 0."""
    return df.agg(F.count("*").alias("rows"), *(F.avg(c).alias(n) for n, c in ranking(predicted, f"array_distinct({relevant})", k).items()))
