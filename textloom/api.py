"""The library in four names: Pattern options, Index, Searcher, SearchOptions."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import index as ix
from textloom.operators import regions, search, select
from textloom.operators.index import IndexOptions
from textloom.operators.search import Request
from textloom.plans.pattern import Case, Engine, Pattern, PatternOptions, compile_pattern
from textloom.sources import corpus as store

__all__ = ["Case", "Engine", "Index", "IndexOptions", "Pattern", "PatternOptions", "SearchOptions", "Searcher", "compile_pattern"]


@dataclass(frozen=True)
class SearchOptions:
    overlapping: bool = False
    invert: bool = False
    include_binary: bool = False
    max_matches: int = 0  # 0: all; a prefix in (file_id, start) order
    first: bool = False
    files_without: bool = False
    scope: tuple[int, ...] | DataFrame = ()  # ids, or a table with a column file_id
    should_cancel: Callable[[], bool] | None = None  # see Searcher.collected


class Index:
    """A corpus, with postings on request."""

    def __init__(self, corpus: DataFrame, options: IndexOptions = IndexOptions()):
        self.corpus, self.options = corpus, options
        self.postings: DataFrame | None = None
        self.stats: DataFrame | None = None

    @classmethod
    def build(cls, spark: SparkSession, root: str, options: IndexOptions = IndexOptions(), hidden: bool = True, follow: bool = False) -> Index:
        return cls(store.scan(spark, root, hidden, follow), options)

    @classmethod
    def from_documents(cls, spark: SparkSession, docs: list[tuple[str, bytes | str]], options: IndexOptions = IndexOptions()) -> Index:
        return cls(store.from_documents(spark, docs), options)

    @classmethod
    def load(cls, spark: SparkSession, path: str, manifest: dict | None = None) -> Index:
        return cls(store.load(spark, path, manifest))

    def save(self, path: str, manifest: dict | None = None) -> None:
        store.save(self.corpus, path, manifest)

    def with_postings(self) -> Index:
        self.postings, self.stats = ix.postings(self.corpus, self.options), ix.qgram_stats(self.corpus, self.options)
        return self

    def append(self, changed: DataFrame, tombstones: DataFrame | None = None, files: int | None = None, size: int | None = None) -> Index:
        return Index(store.renumbered(store.append(self.corpus, changed, tombstones, files, size)), self.options)

    def fresh(self, root: str) -> bool:
        return "mtime_ns" in self.corpus.columns and store.fresh(self.corpus, root)


def until_cancelled(df: DataFrame, should_cancel: Callable[[], bool] | None, every: float = 0.2) -> Iterator:
    """Rows of ``df`` by way of ``toLocalIterator``.

    ``should_cancel`` is asked before the first row, after each, and all the while by a watcher, which stops the Spark
    job.  Once it says so there are no more rows; callers that promise all or nothing drop what they have.
    """
    if should_cancel is None:
        yield from df.toLocalIterator()
        return
    context, group, done, cancelled = df.sparkSession.sparkContext, f"search-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not done.wait(every):
            if should_cancel():
                cancelled.set()
                context.cancelJobsWithTag(group)
                return

    if should_cancel():
        return
    context.addJobTag(group)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        for row in df.toLocalIterator():
            if cancelled.is_set() or should_cancel():
                return
            yield row
    except Exception:
        if not cancelled.is_set():
            raise
    finally:
        done.set()
        context.removeJobTag(group)


class Searcher:
    """Runs patterns over an index; everything stays lazy."""

    def __init__(self, index: Index):
        self.index = index

    def _corpus(self, o: SearchOptions) -> DataFrame:
        c = self.index.corpus
        if isinstance(o.scope, DataFrame) or o.scope:
            ids = o.scope if isinstance(o.scope, DataFrame) else c.sparkSession.createDataFrame([(i,) for i in o.scope], "file_id long")
            c = select.scoped(c, ids.select("file_id"))
        return c if o.include_binary or "binary" not in c.columns else c.filter(~F.col("binary"))

    def find(self, p: Pattern, o: SearchOptions = SearchOptions()) -> DataFrame:
        """Spans in (file_id, start) order where a prefix is asked for."""
        c = self._corpus(o)
        if o.invert:
            out = search.selected_lines(c, Request((p,), invert=True, separator=p.options.separator, crlf=p.options.crlf)).select("file_id", F.col("begin").alias("start"), "end")
        elif self.index.postings is not None:
            out = ix.indexed_find(c, self.index.postings, p, self.index.options, o.overlapping, self.index.stats).select("file_id", "start", "end")
        elif not o.overlapping and p.options.multiline and regions.bounded(p):
            out = regions.find(c, p)
        else:
            out = search.find(c, [p], o.overlapping).select("file_id", "start", "end")
        n = 1 if o.first else o.max_matches
        return search.first_matches(out, n) if n else out

    def collected(self, p: Pattern, o: SearchOptions = SearchOptions()) -> list:
        """All spans as rows, or none if ``should_cancel`` said so before the last of them."""
        stopped = False

        def asked() -> bool:
            nonlocal stopped
            stopped = stopped or o.should_cancel()
            return stopped

        rows = list(until_cancelled(self.find(p, o), asked if o.should_cancel else None))
        return [] if stopped else rows

    def files(self, p: Pattern, o: SearchOptions = SearchOptions()) -> DataFrame:
        """Files with a match (or without), ascending."""
        out = search.files_with(self._corpus(o), Request((p,), o.invert, separator=p.options.separator, crlf=p.options.crlf), o.files_without).select("file_id", "path")
        n = 1 if o.first else o.max_matches
        return out.orderBy("file_id").limit(n) if n else out

    def captures(self, p: Pattern, o: SearchOptions = SearchOptions()) -> DataFrame:
        return search.captures(self._corpus(o), p)
