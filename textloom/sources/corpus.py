"""Corpora: directories, tables, encodings, archives, saved snapshots and changes."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import os
import re
import shlex
import subprocess
import tarfile
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.globs import name_regex
from textloom.operators.select import is_binary

SCHEMA = "file_id long, path string, content binary, text string, size long, mtime_ns long, binary boolean"


def from_table(df: DataFrame, file_id: str, path: str | Column, text: str) -> DataFrame:
    """Any table of texts as a corpus."""
    p = F.col(path) if isinstance(path, str) else path
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(file_id).cast("long").alias("file_id"), p.alias("path"), t.alias("text"), F.octet_length(t).cast("long").alias("size"))


#: Tables under this size a core are spread over all cores, whatever files they come in.
SMALL_PER_CORE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Small tables in fewer files than there are cores: one row group is one task
    otherwise.  Larger tables stay as they are read; they have tasks enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_PER_CORE * cores and len(df.inputFiles()) < cores else df


def from_documents(spark: SparkSession, docs: list[tuple[str, bytes | str]]) -> DataFrame:
    """In-memory documents, in path order; repeated paths are kept."""
    rows = [(i, p, c if isinstance(c, bytes) else c.encode()) for i, (p, c) in enumerate(sorted(docs, key=lambda d: d[0]))]
    return with_text(spark.createDataFrame(rows, "file_id long, path string, content binary"))


def with_text(df: DataFrame, encoding: str = "auto") -> DataFrame:
    """Adds text, size and binary from content."""
    return df.withColumn("text", decoded(F.col("content"), encoding)).withColumn("size", F.octet_length("content").cast("long")).withColumn("binary", is_binary(F.col("content")))


def decoded(content: Column, encoding: str = "auto") -> Column:
    """Text from bytes: ``auto`` looks for UTF-16 marks; bytes that are not valid UTF-8 are replaced."""
    plain = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.make_valid_utf8(content.cast("string")))
    head = F.hex(F.substring(content, 1, 2))
    name = {"utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-16": "UTF-16", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "ascii": "US-ASCII"}.get(encoding.lower())
    if encoding.lower() in ("auto", ""):
        return F.when(head == "FFFE", F.decode(F.substring(content, F.lit(3), F.octet_length(content)), "UTF-16LE")).when(head == "FEFF", F.decode(F.substring(content, F.lit(3), F.octet_length(content)), "UTF-16BE")).otherwise(plain)
    if encoding.lower() in ("none", "utf-8", "utf8"):
        return plain
    if name:
        return F.decode(content, name)
    return _foreign(encoding)(content)


def _foreign(encoding: str):
    """Encodings that only Python has."""
    "".encode(encoding)  # raises for an unknown name

    @F.pandas_udf("string")
    def run(content):
        return content.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return run


# -- directories --------------------------------------------------------------


def list_files(root: str, hidden: bool = True, follow: bool = False, one_device: bool = False) -> list[tuple[str, int, int]]:
    """(relative path, size, mtime in ns) of regular files, sorted; unreadable ones are skipped.

    Links are followed on request, each directory once; ``one_device`` stays on the root's file system.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    found, seen, device = [], set(), os.stat(root).st_dev
    for at, dirs, files in os.walk(root, followlinks=follow):
        if follow:
            real = os.path.realpath(at)
            if real in seen:
                dirs[:] = []
                continue
            seen.add(real)
        if not hidden:
            dirs[:] = [d for d in dirs if not d.startswith(".")]
        if one_device:
            dirs[:] = [d for d in dirs if os.stat(os.path.join(at, d)).st_dev == device]
        for name in files:
            full = os.path.join(at, name)
            if (not hidden and name.startswith(".")) or not os.path.isfile(full) or (os.path.islink(full) and not follow):
                continue
            try:
                s = os.stat(full)
                if one_device and s.st_dev != device:
                    continue
                if os.access(full, os.R_OK):
                    found.append((os.path.relpath(full, root).replace(os.sep, "/"), s.st_size, s.st_mtime_ns))
            except OSError:
                continue
    return sorted(found)


def scan(
    spark: SparkSession, root: str, hidden: bool = True, follow: bool = False, pre: Callable[[str, bytes], bytes] | str | None = None, archives: bool = False, encoding: str = "auto", pre_globs: tuple[str, ...] = (), one_device: bool = False
) -> DataFrame:
    """A directory as a corpus; contents are read by the executors, which must reach ``root``.

    A root with a scheme (hdfs://, s3a://, file://) is listed by Spark, in parallel and on any file
    system that it knows; links and devices are then left to that file system, and names that begin with
    a dot or an underscore aren't listed.  ``pre`` goes to files that match one of ``pre_globs``, or to all.
    """
    # globs come in Java's notation for code points
    wanted = re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), name_regex(list(pre_globs)))) if pre_globs else None

    def content(path: str, full: str, data: bytes) -> bytes:
        if pre is not None and (wanted is None or wanted.search(path)):
            data = preprocessed(pre, full, data)
        return unpacked(path, data) if archives else data

    if "://" in root:
        return with_text(_listed(spark, root, hidden, content if pre is not None or archives else None), encoding).select("file_id", "path", "content", "text", "size", "mtime_ns", "binary")
    rows = [(i, p, s, m) for i, (p, s, m) in enumerate(list_files(root, hidden, follow, one_device))]
    names = spark.createDataFrame(rows, "file_id long, path string, size long, mtime_ns long")
    parts = max(1, min(len(rows), sum(r[2] for r in rows) // (16 << 20) + spark.sparkContext.defaultParallelism))

    def run(batches):
        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                full = os.path.join(root, path)
                with open(full, "rb") as f:
                    out.append(content(path, full, f.read()))
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("path"), pa.array(out, pa.binary()), b.column("mtime_ns")], ["file_id", "path", "content", "mtime_ns"])

    read = names.repartition(parts).mapInArrow(run, "file_id long, path string, content binary, mtime_ns long")
    return with_text(read, encoding).select("file_id", "path", "content", "text", "size", "mtime_ns", "binary")


def _listed(spark: SparkSession, root: str, hidden: bool, content: Callable[[str, str, bytes], bytes] | None) -> DataFrame:
    """file_id (a hash of the path: no driver list, no order to keep), path, content, mtime_ns."""
    base, fs = _hadoop(spark, root)
    top = fs.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root)
    # Spark writes one slash after the scheme of local files, Hadoop three
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9A-Z+.-]+:(//[^/]*)?", ""), "^" + re.escape(top), "")
    rows = found.select(F.xxhash64(path).alias("file_id"), path.alias("path"), F.col("path").alias("full"), "content", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    if not hidden:
        rows = rows.filter(~F.col("path").rlike(r"(^|/)\."))
    if content is None:
        return rows.drop("full")

    def run(batches):
        for b in batches:
            out = [content(p, f, d) for p, f, d in zip(*(b.column(c).to_pylist() for c in ("path", "full", "content")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("path"), pa.array(out, pa.binary()), b.column("mtime_ns")], ["file_id", "path", "content", "mtime_ns"])

    return rows.mapInArrow(run, "file_id long, path string, content binary, mtime_ns long")


def with_times(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, more) with atime_ns and ctime_ns (of birth where the system keeps it, else of the last change)."""
    packed = files.select("path", F.struct(*files.columns).alias("row"))

    def run(batches):
        for b in batches:
            stats = [os.stat(os.path.join(root, p)) for p in b.column("path").to_pylist()]
            born = [int(getattr(s, "st_birthtime", 0) * 1e9) or s.st_ctime_ns for s in stats]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([s.st_atime_ns for s in stats], pa.int64()), pa.array(born, pa.int64())], ["row", "atime_ns", "ctime_ns"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, atime_ns long, ctime_ns long").select("row.*", "atime_ns", "ctime_ns")


def preprocessed(pre: Callable[[str, bytes], bytes] | str, path: str, data: bytes) -> bytes:
    """A callable, or a command that gets the file on its input and as its last argument; failure is fatal."""
    if callable(pre):
        return pre(path, data)
    done = subprocess.run([*shlex.split(pre), path], input=data, capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"preprocessor failed on {path}: {done.stderr.decode(errors='replace')[:200]}")
    return done.stdout


def unpacked(path: str, data: bytes) -> bytes:
    """Contents by file name; members of archives one after the other, each ending in a newline."""
    name = path.lower()
    if name.endswith((".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".tar")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return b"".join(_ended(t.extractfile(m).read()) for m in t.getmembers() if m.isfile())
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return b"".join(_ended(z.read(i)) for i in z.infolist() if not i.is_dir())
    if name.endswith(".gz"):
        return gzip.decompress(data)
    if name.endswith(".bz2"):
        return bz2.decompress(data)
    if name.endswith((".xz", ".lzma")):
        return lzma.decompress(data)
    if name.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
    if name.endswith(".lz4"):
        with pa.CompressedInputStream(pa.BufferReader(data), "lz4") as f:
            return f.read()
    return data


def _ended(data: bytes) -> bytes:
    return data if data.endswith(b"\n") or not data else data + b"\n"


# -- snapshots ----------------------------------------------------------------

FORMAT = 1


class SnapshotError(RuntimeError):
    """A snapshot that is absent, damaged, or another than asked for."""


def fingerprint(corpus: DataFrame) -> DataFrame:
    """One row: an order-independent digest of (path, size, content hash)."""
    row = F.xxhash64("path", F.col("size"), "text")
    return corpus.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("digest"))


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


CURRENT = "current.json"


def _put(spark: SparkSession, path: str, meta: dict) -> None:
    """Written under another name and moved in one step, on any file system that Hadoop knows."""
    tmp = f"{path}/.tmp.{uuid.uuid4().hex}"
    p, fs = _hadoop(spark, tmp)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    fs_class, options = spark._jvm.org.apache.hadoop.fs, getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    context = fs_class.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(p), fs.makeQualified(fs_class.Path(f"{path}/{CURRENT}")), how)


def _current(spark: SparkSession, path: str) -> dict:
    p, fs = _hadoop(spark, f"{path}/{CURRENT}")
    if not fs.exists(p):
        raise SnapshotError(f"no snapshot in {path}")
    try:
        # read by the JVM's own text reader: the file may be anywhere
        return json.loads(spark.read.text(str(p.toString()), wholetext=True).first()[0])
    except (ValueError, TypeError) as e:
        raise SnapshotError(f"no snapshot in {path}") from e


def save(corpus: DataFrame, path: str, manifest: dict | None = None) -> None:
    """A new generation beside the old one; a small file names the current one and is replaced in one step."""
    spark, name = corpus.sparkSession, f"generation-{uuid.uuid4().hex}"
    corpus.write.parquet(f"{path}/{name}")
    f = fingerprint(spark.read.parquet(f"{path}/{name}")).first()
    _put(spark, path, {"format": FORMAT, "generation": name, "files": f.files, "bytes": f.bytes, "digest": f.digest, "manifest": manifest or {}})


def load(spark: SparkSession, path: str, manifest: dict | None = None, verify: bool = True) -> DataFrame:
    """The current generation with its segments; what ``manifest`` asks for must agree, what it leaves out may be anything."""
    meta = _current(spark, path)
    if meta.get("format") != FORMAT:
        raise SnapshotError("another format")
    if "generation" not in meta:
        raise SnapshotError(f"no snapshot in {path}")
    for k, v in (manifest or {}).items():
        if v is not None and meta["manifest"].get(k) != v:
            raise SnapshotError(f"snapshot has another {k}")
    try:
        found = spark.read.parquet(f"{path}/{meta['generation']}")
        if verify:
            f = fingerprint(found).first()
            if (f.files, f.bytes, f.digest) != (meta["files"], meta["bytes"], meta["digest"]):
                raise SnapshotError("snapshot is damaged")
        return _with_segments(spark, found, path, meta.get("segments", []))
    except (AnalysisException, PySparkException) as e:
        raise SnapshotError("snapshot is damaged") from e


def _with_segments(spark: SparkSession, base: DataFrame, path: str, segments: list[str]) -> DataFrame:
    """The last word on each path: of the segments the newest, else the generation."""
    if not segments:
        return base
    parts = [spark.read.parquet(f"{path}/{s}").withColumn("_seq", F.lit(i)) for i, s in enumerate(segments)]
    changes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    cols = [c for c in base.columns if c in changes.columns]
    row = F.struct("_seq", "_deleted", *cols)
    last = changes.groupBy("path").agg(F.max_by(row, "_seq").alias("r"))
    new = last.filter("NOT r._deleted").select(*(F.col(f"r.{c}").alias(c) for c in cols))
    return base.select(*cols).join(changes.select("path").distinct(), "path", "left_anti").select(*cols).unionByName(new)


def add_segment(spark: SparkSession, path: str, changed: DataFrame, gone: DataFrame, name: str | None = None) -> None:
    """Changes beside the current generation, which isn't rewritten: ``changed`` files and ``gone`` paths.

    A segment of the same name replaces itself, so a batch that is run again changes nothing.  When ``compaction_due``
    says so the generation and its segments become a new generation.
    """
    meta = _current(spark, path)
    name = name or f"segment-{uuid.uuid4().hex}"
    rows = changed.withColumn("_deleted", F.lit(False)).unionByName(gone.select("path", F.lit(True).alias("_deleted")), allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{path}/{name}")
    written = spark.read.parquet(f"{path}/{name}").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first().b
    segments = [*(s for s in meta.get("segments", []) if s != name), name]
    appended = meta.get("appended", 0) + written
    if compaction_due(len(segments), appended, meta["bytes"]):
        _put(spark, path, meta | {"segments": segments, "appended": appended})
        save(load(spark, path, verify=False), path, meta["manifest"])
    else:
        _put(spark, path, meta | {"segments": segments, "appended": appended})


def clean_orphans(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes what broken-off saves left, and generations and segments that are no longer current but for the newest
    ``keep`` (readers may be on them still); returns how many."""
    meta = _current(spark, path)
    p, fs = _hadoop(spark, path)
    live = {meta["generation"], *meta.get("segments", [])}
    found = [(s.getModificationTime(), s.getPath()) for s in fs.listStatus(p)]
    tmp = [q for _, q in found if q.getName().startswith(".tmp.")]
    old = sorted(((t, q) for t, q in found if q.getName().startswith("generation-") and q.getName() not in live), key=lambda x: x[0], reverse=True)
    dead = [q for _, q in old[keep:]]
    if not old[:keep]:
        dead += [q for _, q in found if q.getName().startswith("segment-") and q.getName() not in live]
    for q in tmp + dead:
        fs.delete(q, True)
    return len(tmp) + len(dead)


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files that differ by presence, size or time; empty means fresh."""
    a = old.select("path", F.col("size").alias("size_a"), F.col("mtime_ns").alias("mtime_a"))
    b = new.select("path", F.col("size").alias("size_b"), F.col("mtime_ns").alias("mtime_b"))
    both = a.join(b, "path", "full_outer")
    return both.filter(~(F.col("size_a").eqNullSafe(F.col("size_b")) & F.col("mtime_a").eqNullSafe(F.col("mtime_b"))) | F.col("size_a").isNull() | F.col("size_b").isNull())


def fresh(old: DataFrame, root: str, hidden: bool = True, follow: bool = False) -> bool:
    rows = list_files(root, hidden, follow)
    return stale(old, old.sparkSession.createDataFrame(rows, "path string, size long, mtime_ns long")).isEmpty()


def append(base: DataFrame, changed: DataFrame, tombstones: DataFrame | None = None, files: int | None = None, size: int | None = None) -> DataFrame:
    """A new generation: tombstoned paths go, changed ones are replaced or added.  Declared totals must be right."""
    cols = [c for c in base.columns if c in changed.columns]
    kept = base if tombstones is None else base.join(tombstones.select("path").distinct(), "path", "left_anti")
    kept = kept.join(changed.select("path").distinct(), "path", "left_anti")
    out = kept.select(*cols).unionByName(changed.select(*cols))
    if files is not None or size is not None:
        got = out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
        if (files is not None and got.n != files) or (size is not None and got.b != size):
            raise SnapshotError(f"declared totals are wrong: {got.n} files, {got.b} bytes")
    return out


def renumbered(corpus: DataFrame) -> DataFrame:
    """Dense file_id in path order, without a single-task window: counts of range partitions first."""
    spread = corpus.drop("file_id").repartitionByRange("path").sortWithinPartitions("path").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    spread = spread.persist()  # numbers and sizes must come from the same partitions
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("low")).collect()  # one row a partition
    base, total = {}, 0
    for r in sorted(sizes, key=lambda r: r._p):
        base[r._p] = total - r.low
        total += r.n
    if not base:
        return corpus
    shift = F.element_at(F.create_map(*(F.lit(x) for kv in base.items() for x in kv)), F.col("_p"))
    return spread.withColumn("file_id", F.col("_m") + shift).drop("_p", "_m").select(*corpus.columns)


SEGMENT_LIMIT, APPENDED_PERCENT = 64, 25


def compaction_due(segments: int, appended_bytes: int, corpus_bytes: int) -> bool:
    return segments > SEGMENT_LIMIT or (corpus_bytes > 0 and appended_bytes * 100 > corpus_bytes * APPENDED_PERCENT)
