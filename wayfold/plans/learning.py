"""Queries of Spark's machine-learning library: features, models and their measures, over the test tables.

Features and closed-form models have SQL; models that are fitted in rounds give
figures that a test holds against bounds.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import evaluation as E
from pyspark.ml import feature as T
from pyspark.ml import fpm, recommendation
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest, Correlation, KolmogorovSmirnovTest, Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.shared import dealt

def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their size and price as a vector, dealt by key into parts of about ``DEALT`` rows, in order within each."""
    part = dealt(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    rows = part.select("p_partkey", "p_name", "p_type", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return T.VectorAssembler(inputCols=["size", "price"], outputCol="v").transform(rows)


def _at(column: str, k: int, digits: int = 9):
    return F.round(vector_to_array(column)[k], digits)


def scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max, max-abs, standard and norm scalers of two columns."""
    stages = [
        T.MinMaxScaler(inputCol="v", outputCol="minmax"), T.MaxAbsScaler(inputCol="v", outputCol="maxabs"), T.StandardScaler(inputCol="v", outputCol="standard", withMean=True),
        T.Normalizer(inputCol="v", outputCol="norm", p=2.0), T.ElementwiseProduct(scalingVec=Vectors.dense([2.0, 3.0]), inputCol="v", outputCol="product"), T.PolynomialExpansion(degree=2, inputCol="v", outputCol="poly"),
        T.VectorSlicer(inputCol="v", outputCol="slice", indices=[1]),
    ]
    rows = _part(spark, sf_dir)
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    return out.select("p_partkey", _at("minmax", 0).alias("minmax"), _at("maxabs", 0).alias("maxabs"), _at("standard", 0, 6).alias("standard"), _at("norm", 0).alias("norm"), _at("product", 1, 4).alias("product"), _at("poly", 1, 4).alias("square"), _at("slice", 0, 4).alias("sliced"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binarizer, Bucketizer, Imputer, SQLTransformer, StringIndexer and OneHotEncoder."""
    rows = _part(spark, sf_dir).withColumn("hole", F.expr("CASE WHEN size > 10 THEN size END"))
    stages = [
        T.Binarizer(threshold=25.0, inputCol="size", outputCol="large"), T.Bucketizer(splits=[0.0, 10.0, 20.0, float("inf")], inputCol="size", outputCol="bucket"),
        T.Imputer(inputCols=["hole"], outputCols=["filled"]), T.SQLTransformer(statement="SELECT *, size * 2 AS twice FROM __THIS__"),
        T.StringIndexer(inputCol="p_type", outputCol="type", stringOrderType="alphabetAsc"), T.OneHotEncoder(inputCols=["type"], outputCols=["hot"], dropLast=False),
    ]
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    return out.select("p_partkey", "large", "bucket", F.round("filled", 6).alias("filled"), "twice", "type", F.array_position(vector_to_array("hot"), 1.0).cast("int").alias("hot"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenizer, StopWordsRemover, NGram, CountVectorizer and IDF of part names."""
    rows = _part(spark, sf_dir)
    stages = [T.Tokenizer(inputCol="p_name", outputCol="w"), T.StopWordsRemover(inputCol="w", outputCol="kept", stopWords=["small", "red"]), T.NGram(n=2, inputCol="w", outputCol="pairs"), T.CountVectorizer(inputCol="w", outputCol="counts"), T.IDF(inputCol="counts", outputCol="idf"), T.HashingTF(inputCol="w", outputCol="hashed", numFeatures=64)]
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    total = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, x: s + x)
    return out.select("p_partkey", F.size("w").alias("n"), F.array_join("kept", " ").alias("kept"), F.array_join("pairs", "+").alias("pairs"), total("counts").alias("counted"), F.round(total("idf"), 6).alias("idf"), total("hashed").alias("hashed"))


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of price on size, and its measures."""
    rows = T.VectorAssembler(inputCols=["size"], outputCol="x").transform(_part(spark, sf_dir))
    model = R.LinearRegression(featuresCol="x", labelCol="price", solver="normal").fit(rows)
    fitted = model.transform(rows)
    measure = lambda name: E.RegressionEvaluator(labelCol="price", metricName=name).evaluate(fitted)
    return spark.createDataFrame([("slope", float(model.coefficients[0])), ("intercept", model.intercept), ("r2", measure("r2")), ("rmse", measure("rmse"))], "kind string, v double").select("kind", F.round("v", 5).alias("v"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summarizer and both correlations of the two columns."""
    rows = _part(spark, sf_dir)
    s = rows.select(Summarizer.metrics("mean", "variance", "min", "max", "count").summary(F.col("v")).alias("s")).first()["s"]
    pearson, spearman = (Correlation.corr(rows, "v", m).first()[0][0, 1] for m in ("pearson", "spearman"))
    values = [("mean", s["mean"][0]), ("variance", s["variance"][0]), ("min", s["min"][1]), ("max", s["max"][1]), ("count", float(s["count"])), ("pearson", pearson), ("spearman", spearman)]
    return spark.createDataFrame([(k, float(v)) for k, v in values], "kind string, v double").select("kind", F.round("v", 5).alias("v"))


def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's statistic of independence of order status and priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_orderpriority")
    rows = T.StringIndexer(inputCols=["o_orderstatus", "o_orderpriority"], outputCols=["a", "b"]).fit(o).transform(o)
    rows = T.VectorAssembler(inputCols=["a"], outputCol="x").transform(rows)
    found = ChiSquareTest.test(rows, "x", "b", True).first()
    return spark.createDataFrame([(round(float(found["statistic"]), 6), int(found["degreesOfFreedom"]))], "statistic double, freedom int")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a class that follows from size and price, for classifiers."""
    return _part(spark, sf_dir).withColumn("label", F.expr("CAST(size + p_partkey % 3 > 25 AS DOUBLE)"))


def classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each classifier's area under the curve or accuracy on the rows it has seen."""
    rows = _pairs(spark, sf_dir).cache()
    scaled = T.StandardScaler(inputCol="v", outputCol="x", withMean=True).fit(rows).transform(rows).cache()
    models = {
        "logistic": C.LogisticRegression(featuresCol="x"), "svc": C.LinearSVC(featuresCol="x", maxIter=20), "tree": C.DecisionTreeClassifier(featuresCol="x"), "forest": C.RandomForestClassifier(featuresCol="x", numTrees=5, seed=1),
        "boosted": C.GBTClassifier(featuresCol="x", maxIter=5, seed=1), "bayes": C.NaiveBayes(featuresCol="x", modelType="gaussian"), "perceptron": C.MultilayerPerceptronClassifier(featuresCol="x", layers=[2, 8, 2], seed=5, maxIter=200), "machine": C.FMClassifier(featuresCol="x", seed=1, maxIter=60),
    }
    accuracy = E.MulticlassClassificationEvaluator(metricName="accuracy")
    found = [(name, accuracy.evaluate(model.fit(scaled).transform(scaled))) for name, model in models.items()]
    area = E.BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(models["logistic"].fit(scaled).transform(scaled))
    return spark.createDataFrame([*found, ("area", area)], "model string, measure double")


def regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each regressor's error against that of the mean, on price by size and name."""
    rows = _part(spark, sf_dir).withColumn("target", F.col("size") * 3 + F.col("price") / 100).cache()
    models = {
        "tree": R.DecisionTreeRegressor(featuresCol="v", labelCol="target"), "forest": R.RandomForestRegressor(featuresCol="v", labelCol="target", numTrees=5, seed=1), "boosted": R.GBTRegressor(featuresCol="v", labelCol="target", maxIter=5, seed=1),
        "isotonic": R.IsotonicRegression(featuresCol="v", labelCol="target"), "generalized": R.GeneralizedLinearRegression(featuresCol="v", labelCol="target"), "lasso": R.LinearRegression(featuresCol="v", labelCol="target", regParam=0.01, elasticNetParam=1.0),
    }
    r2 = E.RegressionEvaluator(labelCol="target", metricName="r2")
    return spark.createDataFrame([(name, r2.evaluate(m.fit(rows).transform(rows))) for name, m in models.items()], "model string, measure double")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes of three clusterings, and the perplexity of a topic model."""
    part = _part(spark, sf_dir).cache()
    rows = T.StandardScaler(inputCol="v", outputCol="features").fit(part).transform(part).cache()
    quality = E.ClusteringEvaluator()
    models = {"kmeans": K.KMeans(k=3, seed=1), "bisecting": K.BisectingKMeans(k=3, seed=1), "mixture": K.GaussianMixture(k=2, seed=1)}
    found = [(name, quality.evaluate(m.fit(rows).transform(rows))) for name, m in models.items()]
    counted = T.CountVectorizer(inputCol="w", outputCol="features").fit(named := T.Tokenizer(inputCol="p_name", outputCol="w").transform(part)).transform(named)
    found.append(("topics", float(K.LDA(k=2, seed=1, maxIter=3).fit(counted).logPerplexity(counted))))
    return spark.createDataFrame(found, "model string, measure double")


def itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statuses and priorities that occur together: frequent sets with their counts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.array("o_orderstatus", "o_orderpriority").alias("items"))
    found = fpm.FPGrowth(minSupport=0.01).fit(o).freqItemsets
    return found.select(F.array_join(F.sort_array("items"), "+").alias("items"), F.col("freq").alias("n"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating least squares of users, event types and their counts: the error on what it has seen."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").cast("int").alias("user"), F.col("event_type")).agg(F.count("*").cast("float").alias("rating"))
    rows = T.StringIndexer(inputCol="event_type", outputCol="k").fit(e).transform(e).withColumn("item", F.col("k").cast("int")).cache()
    model = recommendation.ALS(userCol="user", itemCol="item", ratingCol="rating", rank=4, seed=1, maxIter=5).fit(rows)
    error = E.RegressionEvaluator(labelCol="rating", metricName="rmse").evaluate(model.transform(rows))
    return spark.createDataFrame([("als", error)], "model string, measure double")


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components, cosine transform, both hash families, quantile buckets and a formula."""
    rows = _part(spark, sf_dir).cache()
    pca = T.PCA(k=1, inputCol="v", outputCol="p").fit(rows)
    dct = T.DCT(inputCol="v", outputCol="d").transform(rows).select(F.max(vector_to_array("d")[0])).first()[0]
    near = T.BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=4.0, numHashTables=2, seed=1).fit(rows)
    counted = T.CountVectorizer(inputCol="w", outputCol="c", binary=True).fit(named := T.Tokenizer(inputCol="p_name", outputCol="w").transform(rows)).transform(named)
    sets = T.MinHashLSH(inputCol="c", outputCol="h", numHashTables=2, seed=1).fit(counted)
    quantile = T.QuantileDiscretizer(numBuckets=4, inputCol="size", outputCol="q").fit(rows).transform(rows).select("q").distinct().count()
    formula = T.RFormula(formula="price ~ size + p_type").fit(rows).transform(rows).select("features").first()[0].size
    found = [("pca", float(pca.explainedVariance[0])), ("dct", float(dct)), ("near", float(near.transform(rows).count())), ("sets", float(sets.transform(counted).count())), ("quantiles", float(quantile)), ("formula", float(formula))]
    return spark.createDataFrame(found, "model string, measure double")


def tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation and a validation split over a grid of two values."""
    rows = _pairs(spark, sf_dir).select("label", F.col("v").alias("features")).cache()
    model = C.DecisionTreeClassifier(seed=1)
    grid = ParamGridBuilder().addGrid(model.maxDepth, [1, 4]).build()
    judge = E.MulticlassClassificationEvaluator(metricName="accuracy")
    crossed = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=judge, numFolds=2, seed=1).fit(rows)
    split = TrainValidationSplit(estimator=model, estimatorParamMaps=grid, evaluator=judge, seed=1).fit(rows)
    ks = KolmogorovSmirnovTest.test(_part(spark, sf_dir), "size", "norm", 25.0, 15.0).first()["statistic"]
    return spark.createDataFrame([("crossed", float(max(crossed.avgMetrics))), ("split", float(max(split.validationMetrics))), ("ks", float(ks))], "model string, measure double")


QUERIES = {
    "ml_scalers": scalers, "ml_buckets": buckets, "ml_words": words, "ml_linear": linear, "ml_summary": summary, "ml_chi_square": chi_square, "ml_itemsets": itemsets,
    "ml_classifiers": classifiers, "ml_regressors": regressors, "ml_clusters": clusters, "ml_factors": factors, "ml_projections": projections, "ml_tuning": tuning,
}

_W = "string_split(p_name, ' ')"
SQL = {
    "ml_scalers": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS r FROM part) SELECT p_partkey, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()), 9) AS minmax,
        round(s / max(abs(s)) OVER (), 9) AS maxabs, round((s - avg(s) OVER ()) / stddev_samp(s) OVER (), 6) AS standard, round(s / sqrt(s * s + r * r), 9) AS norm,
        round(3 * r, 4) AS product, round(s * s, 4) AS square, round(r, 4) AS sliced FROM p""",
    "ml_buckets": """SELECT p_partkey, CAST(p_size > 25 AS INT)::DOUBLE AS large, CASE WHEN p_size < 10 THEN 0.0 WHEN p_size < 20 THEN 1.0 ELSE 2.0 END AS bucket,
        round(CASE WHEN p_size > 10 THEN p_size ELSE (SELECT avg(p_size) FROM part WHERE p_size > 10) END, 6) AS filled, p_size * 2.0 AS twice,
        (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS type, CAST(dense_rank() OVER (ORDER BY p_type) AS INT) AS hot FROM part""",
    "ml_words": f"""WITH t AS (SELECT p_partkey, unnest({_W}) AS w FROM part), d AS (SELECT w, count(DISTINCT p_partkey) AS n FROM t GROUP BY w),
        s AS (SELECT p_partkey, sum(ln(((SELECT count(*) FROM part) + 1.0) / (n + 1.0))) AS idf FROM t JOIN d USING (w) GROUP BY p_partkey)
        SELECT p_partkey, len({_W}) AS n, array_to_string(list_filter({_W}, lambda x: x NOT IN ('small', 'red')), ' ') AS kept, array_to_string(list_transform(range(1, len({_W})), lambda k: ({_W})[k] || ' ' || ({_W})[k + 1]), '+') AS pairs,
        len({_W})::DOUBLE AS counted, round(idf, 6) AS idf, len({_W})::DOUBLE AS hashed FROM part JOIN s USING (p_partkey)""",
    "ml_linear": """WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS a, regr_intercept(p_retailprice, p_size) AS b, regr_r2(p_retailprice, p_size) AS r FROM part)
        SELECT 'slope' AS kind, round(a, 5) AS v FROM f UNION ALL SELECT 'intercept', round(b, 5) FROM f UNION ALL SELECT 'r2', round(r, 5) FROM f
        UNION ALL SELECT 'rmse', round(sqrt(avg((p_retailprice - a * p_size - b) ** 2)), 5) FROM part, f""",
    "ml_summary": """WITH k AS (SELECT p_size, p_retailprice, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part)
        SELECT unnest(['mean', 'variance', 'min', 'max', 'count', 'pearson', 'spearman']) AS kind, round(unnest([avg(p_size), var_samp(p_size), min(p_retailprice), max(p_retailprice), count(*)::DOUBLE, corr(p_size, p_retailprice), corr(a, b)]), 5) AS v FROM k""",
    "ml_chi_square": """WITH c AS (SELECT a, b, count(o_orderkey)::DOUBLE AS n FROM (SELECT DISTINCT o_orderstatus AS a FROM orders), (SELECT DISTINCT o_orderpriority AS b FROM orders) LEFT JOIN orders ON o_orderstatus = a AND o_orderpriority = b GROUP BY ALL),
        e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS m FROM c)
        SELECT round(sum((n - m) ** 2 / m), 6) AS statistic, CAST((SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM c) AS INT) AS freedom FROM e""",
    "ml_itemsets": """SELECT items, n FROM (SELECT o_orderstatus AS items, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1
        UNION ALL SELECT o_orderpriority || '+' || o_orderstatus, count(*) FROM orders GROUP BY 1) WHERE n >= ceil(0.01 * (SELECT count(*) FROM orders))""",
}
