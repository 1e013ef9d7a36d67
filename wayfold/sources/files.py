"""Round trips of tables through the file formats, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.shared import materialize, shared_dir


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/wayfold/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round_trip(form: str, **options: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part, path = _table(spark, sf_dir, "part"), place(spark, form)
        part.write.options(**options).format(form).save(path)
        return spark.read.schema(part.schema).options(**options).format(form).load(path)

    return run


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each row, split again on reading."""
    path = place(spark, "text")
    _table(spark, sf_dir, "part").select(F.concat_ws("|", "p_partkey", "p_name").alias("value")).write.option("compression", "gzip").text(path)
    fields = F.split("value", r"\|")
    return spark.read.text(path).select(fields[0].cast("long").alias("p_partkey"), fields[1].alias("p_name"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array over several lines as one document, of a column that is bounded: the regions."""
    path = place(spark, "multiline")
    region = _table(spark, sf_dir, "region").agg(F.to_json(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name")))).alias("value"))
    region.select(F.regexp_replace("value", ",", ",\n")).write.text(path)
    return spark.read.schema("r_regionkey int, r_name string").option("multiLine", True).json(path)


def malformed(mode: str):
    """Lines of which every third has a word for the number: nulls and the raw line, or no row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = place(spark, "malformed")
        key = F.when(F.col("p_partkey") % 3 == 0, F.lit("none")).otherwise(F.col("p_partkey").cast("string"))
        _table(spark, sf_dir, "part").select(F.concat_ws(",", key, "p_brand").alias("value")).write.text(path)
        schema = "p_partkey long, p_brand string" + (", bad string" if mode == "PERMISSIVE" else "")
        rows = spark.read.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", "bad").csv(path)
        if mode == "DROPMALFORMED":
            return rows.select("p_partkey", "p_brand")
        rows = materialize(rows, "malformed")  # the raw line can't be asked for without the columns it is read for
        return rows.groupBy(F.col("bad").isNotNull().alias("broken")).agg(F.count("*").alias("n"), F.count("p_partkey").alias("keys"))

    return run


def save_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append, overwrite and ignore on one path; the rows that are there after each."""
    nation, path = _table(spark, sf_dir, "nation"), place(spark, "modes")
    counts = []
    for mode in ("errorifexists", "append", "ignore", "overwrite"):
        nation.write.mode(mode).parquet(path)
        counts.append((mode, spark.read.parquet(path).count()))
    return spark.createDataFrame(counts, "mode string, n long")


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in folders by a column; the filter reads the folders that it names."""
    path = place(spark, "partitioned")
    _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").parquet(path).where("o_orderstatus IN ('F', 'P')")


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables in buckets of one key: their join needs no shuffle."""
    names = []
    for name, key, columns in (("orders", "o_custkey", ["o_custkey", "o_orderkey"]), ("customer", "c_custkey", ["c_custkey", "c_name"])):
        table = f"bucketed_{name}_{uuid.uuid4().hex}"
        path = place(spark, "bucketed")
        _table(spark, sf_dir, name).select(columns).write.bucketBy(4, key).sortBy(key).option("path", path).saveAsTable(table)
        names.append(table)
    return spark.table(names[0]).hint("merge").join(spark.table(names[1]), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "binary")
    _table(spark, sf_dir, "region").select("r_name").coalesce(1).write.text(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).agg(F.sum("length").alias("bytes"))


def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table under each codec of Parquet."""
    out = None
    for codec in ("none", "snappy", "gzip", "zstd"):
        path = place(spark, codec)
        _table(spark, sf_dir, "nation").write.option("compression", codec).parquet(path)
        one = spark.read.parquet(path).select(F.lit(codec).alias("codec"), "n_name")
        out = one if out is None else out.unionByName(one)
    return out


def libsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and features as LibSVM lines, read as vectors."""
    from pyspark.ml.functions import vector_to_array

    path = place(spark, "libsvm")
    line = F.format_string("%d 1:%s 2:%s", "p_partkey", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    _table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    v = vector_to_array("features")
    return spark.read.format("libsvm").option("numFeatures", 2).load(path).select(F.col("label").cast("long").alias("p_partkey"), v[0].cast("int").alias("p_size"), v[1].alias("p_retailprice"))


PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
QUERIES = {
    "src_csv": _round_trip("csv", header="true", quote='"'),
    "src_json": _round_trip("json"),
    "src_orc": _round_trip("orc"),
    "src_parquet": _round_trip("parquet"),
    "src_csv_gzip": _round_trip("csv", compression="gzip", sep="\t"),
    "src_text": text,
    "src_json_multiline": json_lines,
    "src_malformed_dropped": malformed("DROPMALFORMED"),
    "src_malformed_kept": malformed("PERMISSIVE"),
    "src_save_modes": save_modes,
    "src_partitioned": partitioned,
    "src_bucketed_join": bucketed,
    "src_binary_files": binary_files,
    "src_codecs": codecs,
    "src_libsvm": libsvm,
}
SQL = {
    **{f"src_{k}": PART for k in ("csv", "json", "orc", "parquet", "csv_gzip")},
    "src_text": "SELECT p_partkey, p_name FROM part",
    "src_json_multiline": "SELECT r_regionkey, r_name FROM region",
    "src_malformed_dropped": "SELECT p_partkey, p_brand FROM part WHERE p_partkey % 3 != 0",
    "src_malformed_kept": "SELECT p_partkey % 3 = 0 AS broken, count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 != 0) AS keys FROM part GROUP BY 1",
    "src_save_modes": "SELECT mode, k * (SELECT count(*) FROM nation) AS n FROM (VALUES ('errorifexists', 1), ('append', 2), ('ignore', 2), ('overwrite', 1)) t(mode, k)",
    "src_partitioned": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "src_bucketed_join": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "src_binary_files": "SELECT CAST(sum(length(r_name) + 1) AS BIGINT) AS bytes FROM region",
    "src_codecs": "SELECT codec, n_name FROM nation, (VALUES ('none'), ('snappy'), ('gzip'), ('zstd')) t(codec)",
    "src_libsvm": "SELECT p_partkey, p_size, p_retailprice FROM part",
}
