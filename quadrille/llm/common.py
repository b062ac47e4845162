"""Shared pieces of the corpus operators: word rule, shared tables, labels of partitions.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere.  Intermediate tables go to the folder that the
cluster names in ``spark.checkpoint.dir``; they are ordinary Parquet written with Spark's commit
protocol, so a lost executor costs only the re-run of its tasks.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty array for null, empty or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{WS_CLASS}]+")
    )


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Arrow batches of Spark's default size hold 64 MB of text, several times over in a worker.
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": (64 << 20, 4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, 2_000)}


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches to 4 MB and 2,000 rows for the session, unless it has bounds of its own."""
    for key, (default, bound) in _BATCH.items():
        if int(spark.conf.get(key).rstrip("b")) == default:
            spark.conf.set(key, bound)


def carried(docs: DataFrame, **fields: Column) -> DataFrame:
    """The columns of docs as one struct ``row`` beside the fields, so that no name of the caller's can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in fields.items()])


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; made here only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quadrille-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_folder: contextvars.ContextVar[str] = contextvars.ContextVar("folder", default="")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{_folder.get()}{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession, tag: str):
    """Puts the tables written inside it in one folder, and removes that at the end."""
    name = f"{tag}-{uuid.uuid4().hex}/"
    token = _folder.set(_folder.get() + name)
    try:
        yield
    finally:
        path = f"{shared_root(spark)}/{_folder.get()}"
        _folder.reset(token)
        remove(spark, path.rstrip("/"))


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = path or shared_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
