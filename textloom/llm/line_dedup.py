"""Line deduplication that can be undone.

Each line of at least ``MIN_POINTS`` code points (after trimming and ASCII
lower-casing) is a key.  The state is a folder with

* ``filters``: per shard of keys one cuckoo filter of the keys that are referred
  to; cuckoo filters, unlike Bloom filters, can forget keys;
* ``counts``: the exact reference counts, as additive rows (key, references,
  smallest and largest doc_id);
* ``repeated``: the keys of two or more documents, with the document that keeps
  their lines;
* ``refs``: key and doc_id of every reference, which make deletions exact.

``insert`` streams a batch's references (summed up per task first, so that a hot
key is a few rows) through the filter of their shard.  A key that the filter
denies is new: it is filed there, its row is appended to the counts and nothing
else is looked up.  A key that the filter may have, or that a single row already
shows in two documents, is a candidate; only candidates are counted exactly, over
the old rows and the new.  So the filters decide what is ever looked at, and their
false positives cost a count each; a false negative would lose a repetition.

``delete`` takes documents out again: keys of theirs are counted anew, keys nobody
refers to leave the filters.  ``apply`` rewrites documents by the present state: a
key found in two or more documents keeps its lines only in the smallest doc_id.
When the keys outgrow the filters, their number or size is doubled and they are
filled again from the counts.

Defined cases: null or empty text is one empty line.  A null doc_id is no
holder of keys and loses no lines.  Rows with the same doc_id are one document
for counting; each is rewritten.  Other columns stay as they are.  Lines of
100,000 code points are keys like any other; documents are never cut.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, hot_join, table, text_bytes, until_exit, work_dir

MIN_POINTS = 10
SLOTS = 4
#: Shards of a new store, and the most buckets of a shard: 1 MB, some 300,000 keys.
SHARDS, MOST_BUCKETS = 8, 1 << 17
#: How full filters may become before they are made anew.
LOAD = 0.7
#: References that a task sums up at once.
_SUMMED = 1 << 20


def line_key(line: bytes) -> bytes | None:
    """Trimmed of ``[\\x20\\x09-\\x0D]`` and lower-cased in A-Z; None if too short."""
    key = line.strip().lower()
    if len(key) < MIN_POINTS or (len(key) < 4 * MIN_POINTS and len(key.decode("utf-8", "replace")) < MIN_POINTS):
        return None
    return key


def _halves(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, k1, k2 = [], [], []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text is None or doc is None:
                continue
            for key in {line_key(x) for x in text.split(b"\n")}:
                if key is not None:
                    x, y = _halves(key)
                    ids.append(doc)
                    k1.append(x)
                    k2.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ids, pa.int64())], ["k1", "k2", "doc_id"])


class CuckooFilter:
    """16-bit fingerprints, buckets of four; vectorised membership and bulk
    insertion, eviction chains only for what finds both buckets full."""

    def __init__(self, buckets: int):
        self.buckets = buckets  # a power of two
        self.slots = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        f = cls(len(data) // (2 * SLOTS))
        f.slots = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return f

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = k2.astype(np.int64).view(np.uint64)
        mark = (u >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1  # zero is an empty slot
        one = (u & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket, mark):
        return bucket ^ ((np.asarray(mark).astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, k2: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(k2)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def _fill(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts what fits, at most one a bucket and round; True where it did."""
        done = np.zeros(len(mark), bool)
        for _ in range(SLOTS):
            todo = np.flatnonzero(~done)
            first = todo[np.unique(bucket[todo], return_index=True)[1]]
            free = self.slots[bucket[first]] == 0
            first, free = first[free.any(1)], free[free.any(1)]
            if not len(first):
                break
            self.slots[bucket[first], free.argmax(1)] = mark[first]
            done[first] = True
        return done

    def insert(self, k2: np.ndarray, kicks: int = 500) -> bool:
        """Distinct keys.  False: full, the filter must be built anew, larger."""
        mark, one, two = self._places(k2)
        left = np.flatnonzero(~self._fill(mark, one))
        left = left[~self._fill(mark[left], two[left])]
        rng = np.random.default_rng(7)
        for i in left:
            m, at = int(mark[i]), int(one[i])
            for _ in range(kicks):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = m
                    break
                j = int(rng.integers(SLOTS))
                m, self.slots[at, j] = int(self.slots[at, j]), m
                at = int(self._other(at, m))
            else:
                return False
        return True

    def delete(self, k2: np.ndarray) -> None:
        """Keys that are in the filter, once each."""
        for m, a, b in zip(*self._places(k2), strict=True):
            for at in (a, b):
                hit = np.flatnonzero(self.slots[at] == m)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break


_COUNTS = "k1 long, k2 long, n long, keep long, last long"
_PROBED = f"shard int, op int, bits binary, {_COUNTS}"
_COUNT_COLS = ["k1", "k2", "n", "keep", "last"]
#: What a row of a shard's stream is: its filter, a new row, a key to be filed or taken out without a question.
FILTER, ROW, FILE, DROP = 0, 1, 2, 3
#: What comes out: the new filter, a row that was new, a row whose key may be known, a filter that is full.
NEW, MAYBE, FULL = 1, 2, 3


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References to counts, as far as one task sees them: no key is hot afterwards."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        k1, k2, d = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("k1", "k2", "doc_id"))
        order = np.lexsort((d, k2, k1))
        k1, k2, d = k1[order], k2[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(k1) != 0) | (np.diff(k2) != 0)]))
        end = np.concatenate([first[1:], [len(d)]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[first], k2[first], end - first, d[first], d[end - 1])], _COUNT_COLS)

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _SUMMED:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def _through_filters(buckets: int):
    """A shard after the other, each with its filter first and the rows in any order after it; one filter in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, f, full = None, None, False

        def flush() -> Iterator[pa.RecordBatch]:
            if shard is not None:
                nothing = [pa.nulls(1, pa.int64())] * 5
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([FULL if full else FILTER], pa.int32()), pa.array([f.dump()], pa.binary()), *nothing], ["shard", "op", "bits", *_COUNT_COLS])

        for b in batches:
            shards, ops = b.column("shard").to_numpy(), b.column("op").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(shards) != 0) | (np.diff(ops) != 0)) + 1, [len(ops)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    yield from flush()
                    shard, f, full = int(shards[lo]), CuckooFilter(buckets), False
                if ops[lo] == FILTER:
                    f = CuckooFilter.load(b.column("bits")[lo].as_py())
                    continue
                part = b.slice(lo, hi - lo)
                k1, k2 = part.column("k1").to_numpy(zero_copy_only=False), part.column("k2").to_numpy(zero_copy_only=False)
                if ops[lo] == DROP:
                    f.delete(k2)
                    continue
                order = np.lexsort((k2, k1))
                lead = np.concatenate([[True], (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)])
                first, again = order[lead], order[~lead]
                if ops[lo] == FILE:
                    full |= not f.insert(k2[first])
                    continue
                known = np.zeros(len(k1), bool)
                known[first] = f.contains(k2[first])
                full |= not f.insert(k2[first[~known[first]]])
                known[again] = f.contains(k2[again])
                kind = np.where(known, MAYBE, NEW).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("shard"), pa.array(kind), pa.nulls(len(kind), pa.binary()), *(part.column(c) for c in _COUNT_COLS)], ["shard", "op", "bits", *_COUNT_COLS])
        yield from flush()

    return run


class LineDedupStore:
    """The state of line deduplication in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, most_buckets: int = MOST_BUCKETS):
        self.spark, self.path, self.most_buckets = spark, path, most_buckets
        bounded_batches(spark)
        #: the filters' number, size and keys, and the current generation's folders
        self.meta: dict = {"shards": SHARDS, "buckets": 64, "keys": 0, "refs": [], "counts": [], "repeated": None, "filters": None}

    # -- the small description of the current generation --------------------
    def _hadoop(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/current.json")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self) -> None:
        """Names the new generation; written last, so a failed step leaves the old one."""
        p, fs = self._hadoop()
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(self.meta).encode()))
        out.close()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineDedupStore:
        s = cls(spark, path)
        s.meta = json.loads(spark.read.text(f"{path}/current.json", wholetext=True).first()[0])
        return s

    def _new(self, kind: str) -> str:
        return f"{self.path}/{kind}/{uuid.uuid4().hex}"

    def _table(self, paths, schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))

    def _kept(self, df: DataFrame, kind: str) -> str:
        df.write.parquet(path := self._new(kind))
        return path

    # -- tables --------------------------------------------------------------
    def refs(self) -> DataFrame:
        return self._table(self.meta["refs"], "k1 long, k2 long, doc_id long")

    def count_rows(self) -> DataFrame:
        return self._table(self.meta["counts"], _PROBED).filter(F.col("op").isin(NEW, MAYBE)).select(*_COUNT_COLS)

    def counts(self) -> DataFrame:
        """Exact per key: references to it, its smallest and largest doc_id."""
        return _totals(self.count_rows())

    def repeated(self) -> DataFrame:
        """The keys of two or more documents."""
        return self._table(self.meta["repeated"], _COUNTS)

    def filters(self) -> DataFrame:
        return self._table(self.meta["filters"], "shard int, bits binary")

    def _sharded(self, keys: DataFrame, op: int) -> DataFrame:
        """Rows of the shards' streams."""
        cols = [F.col(c) if c in keys.columns else F.lit(None).cast("long").alias(c) for c in _COUNT_COLS]
        return keys.select(F.pmod("k1", F.lit(self.meta["shards"])).cast("int").alias("shard"), F.lit(op).alias("op"), F.lit(None).cast("binary").alias("bits"), *cols)

    def _streamed(self, filters: DataFrame, *rows: DataFrame) -> DataFrame:
        first = filters.select("shard", F.lit(FILTER).alias("op"), "bits", *(F.lit(None).cast("long").alias(c) for c in _COUNT_COLS))
        for r in rows:
            first = first.unionByName(r)
        return first.repartition("shard").sortWithinPartitions("shard", "op").mapInArrow(_through_filters(self.meta["buckets"]), _PROBED)

    def _grown(self, keys: int) -> DataFrame:
        """The filters, made anew from the counts if ``keys`` more don't fit."""
        m, need = self.meta, self.meta["keys"] + keys
        shards, buckets = m["shards"], m["buckets"]
        while need > LOAD * SLOTS * buckets * shards:
            buckets, shards = (buckets * 2, shards) if buckets < self.most_buckets else (buckets, shards * 2)
        if (shards, buckets) == (m["shards"], m["buckets"]):
            return self.filters()
        m |= {"shards": shards, "buckets": buckets}
        none = self._table(None, "shard int, bits binary")
        if not m["counts"]:
            return none
        path = self._kept(self._streamed(none, self._sharded(self.counts().select("k1", "k2"), FILE)).filter("bits IS NOT NULL"), "filters")
        return self.spark.read.schema(_PROBED).parquet(path).select("shard", "bits")

    # -- changes -------------------------------------------------------------
    def insert(self, docs: DataFrame) -> None:
        """Adds the documents' lines.  A doc_id may come again: its new lines add to the old."""
        m = self.meta = dict(self.meta)
        refs = self._kept(text_bytes(docs).mapInArrow(_refs, "k1 long, k2 long, doc_id long"), "refs")
        fresh = self._table(refs, "k1 long, k2 long, doc_id long")
        filters = self._grown(fresh.count())
        while True:
            # a batch's rows, each judged by its shard's filter, and the filters after them
            probed = self._kept(self._streamed(filters, self._sharded(fresh.mapInArrow(_summed, _COUNTS), ROW)), "counts")
            seen = self._table(probed, _PROBED)
            if seen.filter(F.col("op") == FULL).isEmpty():
                break
            m["buckets"] *= 2  # a shard that is full against all odds
            filters = self._grown(0) if not m["counts"] else self._refilled()
        rows = seen.filter(F.col("op").isin(NEW, MAYBE))
        candidates = rows.filter((F.col("op") == MAYBE) | (F.col("keep") < F.col("last"))).select("k1", "k2").distinct()
        mine = rows.select(*_COUNT_COLS, (F.col("op") == NEW).alias("filed")).unionByName(self.count_rows().select(*_COUNT_COLS, F.lit(True).alias("filed")))
        exact = mine.join(candidates, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("keep").alias("keep"), F.max("last").alias("last"), F.max("filed").alias("filed"))
        judged = self._table(self._kept(exact, "candidates"), f"{_COUNTS}, filed boolean")
        # keys that the filter took for others are new after all, and are filed too
        late = self._sharded(judged.filter("NOT filed").select("k1", "k2"), FILE)
        old = self.repeated().join(judged.select("k1", "k2"), ["k1", "k2"], "left_anti")
        now = judged.filter("keep < last").select(*_COUNT_COLS)
        blobs = seen.filter(F.col("op") == FILTER).select("shard", "bits")
        m |= {
            "filters": self._kept(self._streamed(blobs, late).filter("bits IS NOT NULL").select("shard", "bits"), "filters"),
            "repeated": self._kept(old.unionByName(now) if m["repeated"] else now, "repeated"),
            "refs": [*m["refs"], refs],
            "counts": [*m["counts"], probed],
            "keys": m["keys"] + rows.filter(F.col("op") == NEW).count() + judged.filter("NOT filed").count(),
        }
        self.save()

    def _refilled(self) -> DataFrame:
        none = self._table(None, "shard int, bits binary")
        return self._streamed(none, self._sharded(self.counts().select("k1", "k2"), FILE)).filter("bits IS NOT NULL").select("shard", "bits")

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes documents (column doc_id) out: an exact inverse of their insertion."""
        m = self.meta = dict(self.meta)
        gone = doc_ids.select("doc_id").distinct()
        refs = self._kept(self.refs().join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id"), "refs")
        touched = self._table(self._kept(self.refs().join(gone, "doc_id", "left_semi").select("k1", "k2").distinct(), "touched"), "k1 long, k2 long")
        left = self._table(refs, "k1 long, k2 long, doc_id long").join(touched, ["k1", "k2"], "left_semi").mapInArrow(_summed, _COUNTS)
        left = self._table(self._kept(_totals(left), "candidates"), _COUNTS)
        dropped = touched.join(left, ["k1", "k2"], "left_anti")
        counts = self.counts().join(touched, ["k1", "k2"], "left_anti").unionByName(left)
        m |= {
            "counts": [self._kept(self._sharded(counts, NEW), "counts")],
            "filters": self._kept(self._streamed(self.filters(), self._sharded(dropped, DROP)).filter("bits IS NOT NULL").select("shard", "bits"), "filters"),
            "repeated": self._kept(self.repeated().join(touched, ["k1", "k2"], "left_anti").unionByName(left.filter("keep < last")), "repeated"),
            "refs": [refs],
            "keys": m["keys"] - dropped.count(),
        }
        self.save()

    # -- use -----------------------------------------------------------------
    def drops(self) -> DataFrame:
        """doc_id and the keys whose lines it loses."""
        refs = self.refs()
        return hot_join(refs, self.repeated(), ["k1", "k2"], "n", refs.count()).filter("doc_id > keep").groupBy("doc_id").agg(F.collect_set("k1").alias("lost"))

    def apply(self, docs: DataFrame, digest: bool = False) -> DataFrame:
        """``docs`` with rewritten texts; with ``digest`` doc_id, counts and the
        kept text's SHA-256 instead.

        Within one document lines are told apart by the first 64 bits of the
        128-bit key that decided across documents.
        """
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        packed = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"), *([] if digest else [F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []))
        joined = packed.join(self.drops(), "doc_id", "left")
        if digest:
            return joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
        kind = joined.schema
        out = joined.select(*[c for c in joined.columns if c != "lost"], "lost").mapInArrow(_rewritten, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind if f.name not in ("lost", "rest")) + (f", rest {kind['rest'].dataType.simpleString()}" if rest else ""))
        cols = [F.col("doc_id") if c == "doc_id" else F.col("text").cast("string").alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]
        return out.select(*cols)


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("keep").alias("keep"), F.max("last").alias("last"))


def _kept(text: bytes | None, lost: list[int] | None) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    if not lost:
        return len(lines), 0, text or b""
    gone, keep = set(lost), []
    for x in lines:
        key = line_key(x)
        if key is None or _halves(key)[0] not in gone:
            keep.append(x)
    return len(lines), len(lines) - len(keep), b"\n".join(keep)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, d, h = [], [], []
        for text, lost in zip(b.column("text").to_pylist(), b.column("lost").to_pylist(), strict=True):
            lines, dropped, kept = _kept(text, lost)
            n.append(lines)
            d.append(dropped)
            h.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [_kept(t, x)[2] if x else t for t, x in zip(b.column("text").to_pylist(), b.column("lost").to_pylist(), strict=True)]
        names = [c for c in b.schema.names if c != "lost"]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()) if c == "text" else b.column(c) for c in names], names)


def _fresh(docs: DataFrame, path: str | None) -> LineDedupStore:
    spark = docs.sparkSession
    store = LineDedupStore(spark, path or work_dir(spark, "lines"))
    store.insert(docs)
    if path is None:
        until_exit(spark, store.path)
    return store


def dedup_lines(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One batch from an empty state: inserts ``docs``, then rewrites them."""
    return _fresh(docs, path).apply(docs)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _fresh(docs, None).apply(docs, digest=True)


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS loc
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (
  SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id > held.keep, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY loc) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
