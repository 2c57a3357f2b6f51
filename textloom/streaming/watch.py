"""Keeping a snapshot up to date from a stream of changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import search
from textloom.operators.search import Request
from textloom.sources import corpus as store

CHANGE = "path string, content binary, deleted boolean, at timestamp"


def backoff(failures: int, most: int = 60) -> int:
    """Seconds before the next attempt: 1, 2, 4, ... up to ``most``."""
    return min(most, 1 << min(failures, 16))


def latest(changes: DataFrame) -> DataFrame:
    """One change a path, the last; ties prefer a deletion."""
    row = F.struct("at", "deleted", "content")
    return changes.groupBy("path").agg(F.max(row).alias("r")).select("path", F.col("r.content").alias("content"), F.col("r.deleted").alias("deleted"))


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """``base`` after a batch of changes."""
    last = latest(changes)
    ids = F.xxhash64("path")
    gone = last.filter("deleted").select("path")
    new = store.with_text(last.filter("NOT deleted").select(ids.alias("file_id"), "path", "content"))
    return store.append(base.select("file_id", "path", "content", "text", "size", "binary"), new, gone)


def maintain(spark: SparkSession, changes: DataFrame, snapshot: str, checkpoint: str, on_generation: Callable[[DataFrame], None] | None = None):
    """A streaming query that adds each micro-batch of ``changes`` to the snapshot as a segment of its own.

    A batch costs what it changes: the generation is rewritten only when compaction is due.  A batch that is run
    again replaces its segment, or repeats changes of whole files, and so gives the same snapshot.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(df: DataFrame, number: int) -> None:
        last = latest(df)
        new = store.with_text(last.filter("NOT deleted").select(F.xxhash64("path").alias("file_id"), "path", "content"))
        store.add_segment(spark, snapshot, new, last.filter("deleted").select("path"), f"segment-{stream}-{number}")
        if on_generation:
            on_generation(store.load(spark, snapshot, verify=False))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matching_lines(stream: DataFrame, r: Request) -> DataFrame:
    """Selected lines of a stream of documents (file_id, text): stateless, so any trigger will do."""
    return search.selected_lines(stream, r)


def match_rates(stream: DataFrame, text: str, at: str, r: Request, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents and documents with a match per window of event time; late ones beyond the watermark are left out."""
    p = r.patterns[0]
    hit = F.contains(F.col(text), F.lit(p.pure)) if p.pure is not None else F.col(text).rlike(p.java)
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w")).agg(F.count(F.lit(1)).alias("documents"), F.sum(hit.cast("bigint")).alias("matched")).select(F.col("w.start").alias("start"), "documents", "matched")
