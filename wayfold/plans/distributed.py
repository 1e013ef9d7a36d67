"""Queries of the operators along one order, of Bloom filters, metrics and matrices, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.shared import materialize
from wayfold.operators import bloom, matrix, metrics, ordered


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all lines in the order of their shipping: the quantity of each and the six after it, and the dearest of them."""
    item = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("price"))
    found = ordered.sliding(item, ["l_shipdate", "l_orderkey", "l_linenumber", "price", "q"], 7, {"sum_q": lambda w: F.sum("q").over(w), "top": lambda w: F.max("price").over(w), "n": lambda w: F.count("*").over(w)})
    return found.select("l_orderkey", "l_linenumber", F.round("sum_q", 4).alias("sum_q"), "top", "n")


def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by date with their place and the sum of all prices up to each, in cents."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice").cast("double") * 100).cast("long").alias("cents"))
    total = ordered.running(o, ["o_orderdate", "o_orderkey"], {"total": "cents"})
    return ordered.numbered(total, "o_orderdate", "o_orderkey").select("o_orderkey", F.col(ordered.NUMBER).alias("place"), "total")


def bloom_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the dearest orders; the lines are thinned by a filter of these orders' keys before they move."""
    o = _table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("key"), "o_orderdate")
    item = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_quantity")
    return bloom.thinned_join(item, o, ["key"]).select("key", "l_linenumber", "l_quantity", "o_orderdate")


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _table(spark, sf_dir, "lineitem")
    return metrics.thresholds(item.select(F.col("l_extendedprice").cast("double").alias("score"), (F.col("l_quantity") > 25).cast("int").alias("label")), "score", "label")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a line's price tells a large quantity."""
    return metrics.areas(_curve(spark, sf_dir)).select("rows", "positives", F.round("area_roc", 9).alias("area_roc"), F.round("area_pr", 9).alias("area_pr"))


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binned_curve(_curve(spark, sf_dir), 40)


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders ranked by price against those of the two highest priorities."""
    o = _table(spark, sf_dir, "orders")
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("k")))), lambda x: x["k"])
    wanted = F.collect_list(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderkey")))
    rows = o.groupBy("o_custkey").agg(ranked.alias("predicted"), wanted.alias("relevant"))
    found = metrics.ranking_metrics(rows, "predicted", "relevant", 5)
    return found.select("rows", *(F.round(c, 9).alias(c) for c in ("precision", "average_precision", "ndcg")))


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' quantities of parts, as entries of a matrix."""
    item = _table(spark, sf_dir, "lineitem")
    return item.select(F.col("l_suppkey").cast("long").alias("i"), (F.col("l_partkey") % 300).cast("long").alias("j"), F.col("l_quantity").cast("double").alias("value"))


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' quantities multiplied over all suppliers: the Gram matrix of the sales."""
    sales = materialize(matrix.blocks(_sales(spark, sf_dir)), "sales")
    return matrix.entries(matrix.gram(sales)).select("i", "j", F.round("value", 4).alias("value"))


def singular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest singular values of the sales."""
    sales = materialize(matrix.blocks(_sales(spark, sf_dir)), "sales")
    found = matrix.singular_values(sales, 3, rounds=12)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(found)], "place long, value double")


QUERIES = {
    "matrix_gram": product,
    "matrix_singular_values": singular,
    "ordered_moving": moving,
    "ordered_running_total": running_total,
    "join_bloom": bloom_join,
    "metrics_areas": areas,
    "metrics_curve": curve,
    "metrics_ranking": rankings,
}

_CURVE = """c AS (SELECT l_extendedprice::DOUBLE AS threshold, count(*) FILTER (l_quantity > 25) AS p, count(*) FILTER (l_quantity <= 25) AS n FROM lineitem GROUP BY 1),
    r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM c WINDOW w AS (ORDER BY threshold DESC))"""
SQL = {
    "matrix_gram": """WITH a AS (SELECT l_suppkey AS s, l_partkey % 300 AS p, sum(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY 1, 2)
        SELECT x.p AS i, y.p AS j, round(sum(x.v * y.v), 4) AS value FROM a x JOIN a y ON x.s = y.s GROUP BY 1, 2""",
    "ordered_moving": """SELECT l_orderkey, l_linenumber, round(sum(l_quantity::DOUBLE) OVER w, 4) AS sum_q, max(l_extendedprice::DOUBLE) OVER w AS top, count(*) OVER w AS n
        FROM lineitem WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)""",
    "ordered_running_total": """SELECT o_orderkey, row_number() OVER w - 1 AS place, (sum(round(o_totalprice::DOUBLE * 100)::BIGINT) OVER w)::BIGINT AS total
        FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""",
    "join_bloom": "SELECT l_orderkey AS key, l_linenumber, l_quantity, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 450000",
    "metrics_areas": f"""WITH {_CURVE}, s AS (SELECT sum(p) AS ps, sum(n) AS ns FROM c)
        SELECT (any_value(ps) + any_value(ns))::BIGINT AS rows, any_value(ps)::BIGINT AS positives, round(sum(n * (tp - p + tp) / 2.0) / (any_value(ps)::DOUBLE * any_value(ns)), 9) AS area_roc,
               round(sum(p * (tp / (tp + fp) + coalesce((tp - p) / nullif(tp - p + fp - n, 0), tp / (tp + fp))) / 2.0) / any_value(ps)::DOUBLE, 9) AS area_pr FROM r, s""",
    "metrics_curve": f"""WITH {_CURVE}, k AS (SELECT *, row_number() OVER (ORDER BY threshold DESC) - 1 AS i, count(*) OVER () AS m FROM r)
        SELECT i * 40 // m AS bin, arg_max(threshold, i) AS threshold, arg_max(tp, i)::BIGINT AS tp, arg_max(fp, i)::BIGINT AS fp FROM k GROUP BY 1""",
    "metrics_ranking": """WITH o AS (SELECT o_custkey AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i, o_orderpriority IN ('1-URGENT', '2-HIGH') AS h FROM orders),
        c AS (SELECT *, sum(h::INT) OVER (PARTITION BY u ORDER BY i) AS hits, sum(h::INT) OVER (PARTITION BY u) AS m FROM o),
        a AS (SELECT u, any_value(m) AS m, sum(h::INT) FILTER (i <= 5) / 5.0 AS precision, sum(CASE WHEN h THEN hits / i END) / nullif(any_value(m), 0) AS average_precision,
                     sum(CASE WHEN h AND i <= 5 THEN 1 / log2(i + 1) END) / nullif(list_sum(list_transform(range(1, 1 + least(5, any_value(m))::BIGINT), lambda j: 1 / log2(j + 1))), 0) AS ndcg FROM c GROUP BY u)
        SELECT count(*) AS rows, round(avg(coalesce(precision, 0)), 9) AS precision, round(avg(coalesce(average_precision, 0)), 9) AS average_precision, round(avg(coalesce(ndcg, 0)), 9) AS ndcg FROM a""",
}
