"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task, about, where a few bytes make much work.
DEALT = 50_000

def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = getattr(sc, "_wayfold_shared", None) or "file://" + tempfile.mkdtemp(prefix="wayfold-shared-")
        sc._wayfold_shared = where
    return where.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with files that every executor can read, so that a
    lost executor costs a re-read and not a recomputation, and so that a table
    used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayfold/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        # .. /wayfold/<application>/<table>/..
        for f in {"/".join(p.split("/")[: p.split("/").index("wayfold") + 3]) for p in df.inputFiles() if "/wayfold/" in p}:
            if f.rsplit("/", 2)[-2] == spark.sparkContext.applicationId:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key, ``DEALT`` to a task or so, in the key's order within it.

    Files of a few MB are read by one task, or by a few, however many rows they
    hold. With this the tasks grow in number with the rows, and not in size. The
    same rows lie together each time, whichever way the file is read.
    """
    parts = -(-df.count() // DEALT)
    return df.repartition(parts, key).sortWithinPartitions(key) if parts > 1 else df
