"""What the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.corpus import spread

#: The most keys that ``hot_join`` broadcasts.
MAX_HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Arrow batches are cut by size, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share.  A session that names
    none gets a temporary folder if it runs on this machine alone, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{what}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def until_exit(spark: SparkSession, path: str) -> None:
    """``path`` goes when the driver's JVM ends; results that read it are lazy, so not before."""
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)


#: Paths of the tables that ``stored`` wrote, by the DataFrames that read them.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a written table in the shared folder: lineage ends there."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Removes tables that ``stored`` returned and that nothing reads any more: what came of them is written."""
    for df in tables:
        path = _PATHS.pop(df, None) if df is not None else None
        if path:
            p, fs = _hadoop(df.sparkSession, path)
            fs.delete(p, True)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner equi-join where single keys may own a large part of ``left``.

    ``right`` has one row per key; ``weight`` says how many rows of ``left``
    have the key, and these sum to ``total`` at most.  So fewer than
    ``MAX_HOT_KEYS`` keys reach ``total / MAX_HOT_KEYS`` and can be broadcast;
    no other key holds more than that share of a shuffle.
    """
    limit = max(2, -(-total // MAX_HOT_KEYS))
    hot = F.broadcast(right.filter(F.col(weight) >= limit))
    cold = right.filter(F.col(weight) < limit)
    few = left.join(hot, keys)
    rest = left.join(F.broadcast(right.filter(F.col(weight) >= limit).select(*keys)), keys, "left_anti").join(cold, keys)
    return few.unionByName(rest)


def text_bytes(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id, text as UTF-8 (Arrow hands it over as bytes) and ``more``."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0.  Rows with a null doc_id are never learnt from, so they count as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True)).alias("held_out")
