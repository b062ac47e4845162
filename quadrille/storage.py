"""Tables in the folder that the cluster shares: short lineage that survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; a folder of our own only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quadrille-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_quads(quads: DataFrame, path: str, buckets: int = 0) -> None:
    """Quads clustered by predicate and sorted by subject.

    With few predicates each is a folder (partition pruning); with many, ``buckets`` hash folders
    keep their number bounded.
    """
    from pyspark.sql import functions as F

    if buckets:
        part = F.pmod(F.xxhash64("p"), F.lit(buckets)).cast("int")
        quads.withColumn("p_bucket", part).repartition("p_bucket").sortWithinPartitions("p", "s").write.partitionBy("p_bucket").parquet(path)
    else:
        quads.repartition("p").sortWithinPartitions("s").write.partitionBy("p").parquet(path)


def load_quads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("g", "s", "p", "o")
