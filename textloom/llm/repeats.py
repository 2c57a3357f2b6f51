"""Removal of repeated byte strings of ``LENGTH`` bytes: sparse suffix sorting.

Sorting all suffixes, in memory or by external induced sorting, moves at least
eight bytes for each byte of text, several times.  Induced sorting needs only
the order of a sparse set of suffixes chosen by local content; here that set is
sparser still, since only matches of ``LENGTH`` bytes or more count:

1. ``sampled``: of each window of ``LENGTH`` bytes the ``GRAM``-byte string with
   the least hash is a sample.  Equal windows have equal samples at equal places,
   so two equal windows always meet in a sample.
2. Samples whose string occurs once in the corpus are dropped (counts by hash).
3. The rest carry the ``SIDE`` bytes before and after them.  A window around a
   sample is the sample and ``SIDE`` of these bytes, at one of ``SIDE + 1``
   shifts.  For each shift the samples with equal strings (128 bits of XXH3) are
   sorted by the hash of the window's side bytes; neighbours with equal hashes are
   compared byte by byte, and equal ones are repeated windows.  Sorting goes in
   blocks of whole groups.
   Groups past ``HOT_GROUP`` members are first grouped by whole equal sides: all
   windows of members that agree there are repeated, and one member of each such
   class goes on.  These are spread over the cluster by shift and side bytes.
4. Covered bytes of each document are the union of its repeated windows.

Nothing grows with a document's or a group's length in one task but a document's
own list of samples.

Defined cases: null text is empty; texts under ``LENGTH`` bytes have no window.
Rows are told apart by doc_id and text; rows that agree in both repeat each
other.  Null doc_ids are allowed.  Windows of one document may overlap.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, forget, hot_join, stored, table

LENGTH = 400
SIDE = 128
GRAM = LENGTH - SIDE
BLOCK = 1 << 17
#: Members of a group that one task takes.
HOT_GROUP = 20_000
_ROWS = 4096

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240))
_T1, _T2 = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2))
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, base & (2**64 - 1), np.uint64))])


class _Poly:
    """Hashes of all substrings of one length, position-independent, modulo 2^64."""

    def __init__(self, base: int, symbols: np.ndarray, most: int):
        self.symbols = symbols
        self.up, self.down = _powers(base, most + 1), _powers(pow(base, -1, 2**64), most + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        p = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.symbols[data] * self.down[: len(data)], out=p[1:])
        return p

    def at(self, sums: np.ndarray, pos: np.ndarray | slice, n: int, length: int) -> np.ndarray:
        if isinstance(pos, slice):
            return (sums[length:] - sums[: n - length + 1]) * self.up[: n - length + 1]
        return (sums[pos + length] - sums[pos]) * self.up[pos]


_MOST = 2 * BLOCK + 2 * LENGTH
_P: list[_Poly] = []


def _polys() -> list[_Poly]:
    if not _P:
        _P.extend([_Poly(_B1, _T1, _MOST), _Poly(_B2, _T2, _MOST)])
    return _P


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(29))


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each window of ``width`` (a power of two, plus one)."""
    step, n = 1, len(x) - width + 1
    while step < width - 1:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[:n], x[1 : n + 1])


def sampled(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of samples in ``data``, texts laid end to end that end at ``ends``."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    p = _polys()[0]
    h = _mix(p.at(p.sums(data), slice(None), n, GRAM))
    least = _sliding(np.minimum, h, SIDE + 1)  # for each window start 0 .. n - LENGTH
    for e in ends[:-1]:
        least[max(0, e - LENGTH + 1) : e] = 0  # windows must not cross texts
    pad = np.zeros(SIDE, np.uint64)
    most = _sliding(np.maximum, np.concatenate([pad, least, pad]), SIDE + 1)
    return np.flatnonzero((most == h) & (most != 0))


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(bytes, ends, [(row, offset of the piece in the row)]) of about BLOCK bytes; long texts in overlapping pieces."""
    parts: list[bytes] = []
    who: list[tuple[int, int]] = []
    size = 0

    def out():
        lens = np.cumsum([len(x) for x in parts])
        return np.frombuffer(b"".join(parts), np.uint8), lens, list(who)

    for row, t in enumerate(texts):
        if t is None or len(t) < LENGTH:
            continue
        for at in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            piece = t[at : at + BLOCK + LENGTH - 1]
            if parts and size + len(piece) > 2 * BLOCK:
                yield out()
                parts, who, size = [], [], 0
            parts.append(piece)
            who.append((row, at))
            size += len(piece)
    if parts:
        yield out()


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = _polys()[0]
    for b in batches:
        rid = b.column("rid").to_numpy()
        for data, ends, who in _blocks(b.column("text").to_pylist()):
            x = sampled(data, ends)
            piece = np.searchsorted(ends, x, side="right")
            begin = np.concatenate([[0], ends[:-1]])
            row, at = np.array([w[0] for w in who]), np.array([w[1] for w in who], np.int64)
            h = p.at(p.sums(data), x, len(data), GRAM).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rid[row[piece]]), pa.array(x - begin[piece] + at[piece])], ["h1", "rid", "pos"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each remaining sample with its sides, and the shifts that stay in the text."""
    for b in batches:
        cols: list[list] = [[] for _ in range(9)]
        for rid, r2, text, pos, n in zip(*(b.column(c).to_pylist() for c in ("rid", "r2", "text", "pos", "n")), strict=True):
            for x, k in set(zip(pos, n, strict=True)):
                if x + GRAM > len(text):
                    continue  # another text's sample, under a colliding row hash
                h = xxhash.xxh3_128_digest(text[x : x + GRAM])
                h1, h2 = int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)
                left, right = text[max(0, x - SIDE) : x], text[x + GRAM : x + LENGTH]
                row = (h1, h2, left.rjust(SIDE, b"\0") + right.ljust(SIDE, b"\0"), max(0, x + LENGTH - len(text)), min(SIDE, x), rid, r2, x, k)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            if len(cols[0]) > 20_000:
                yield _context_batch(cols)
                cols = [[] for _ in range(9)]
        yield _context_batch(cols)


_CONTEXT = "h1 long, h2 long, sides binary, lo int, hi int, rid long, r2 long, pos long, n long"


def _context_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h1", "h2", "sides", "lo", "hi", "rid", "r2", "pos", "n"])


def _window_hashes(sides: np.ndarray) -> np.ndarray:
    """rows x (SIDE + 1): column c is the window at shift SIDE - c.  Only hashes in the same column compare."""
    p = _polys()[1]
    sums = np.zeros((len(sides), 2 * SIDE + 1), np.uint64)
    np.cumsum(p.symbols[sides] * p.down[: 2 * SIDE], axis=1, out=sums[:, 1:])
    return sums[:, SIDE:] - sums[:, : SIDE + 1]


def _valid(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    shift = SIDE - np.arange(SIDE + 1)
    return (shift >= lo[:, None]) & (shift <= hi[:, None])


def _repeated(group: np.ndarray, sides: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which windows of these samples (rows x SIDE + 1) occur again among samples of the same group number."""
    h = _mix(_window_hashes(sides) + (group.astype(np.uint64) * _U(0x9E3779B97F4A7C15))[:, None])
    ok = _valid(lo, hi)
    h[~ok] = np.arange(np.count_nonzero(~ok), dtype=np.uint64) * _U(0xD1B54A32D192ED03) + _U(1)
    order = np.argsort(h, axis=0, kind="stable")
    s = np.take_along_axis(h, order, 0)
    same = s[1:] == s[:-1]
    hit = np.zeros(h.shape, bool)
    hit[1:] |= same
    hit[:-1] |= same
    for c in np.flatnonzero(same.any(0)):  # equal hashes are a proposal; the bytes decide
        k = np.flatnonzero(same[:, c])
        a, b = order[k, c], order[k + 1, c]
        if not ((group[a] == group[b]) & ok[a, c] & ok[b, c]).all() or not np.array_equal(sides[a, c : c + SIDE], sides[b, c : c + SIDE]):
            hit[:, c] = _by_bytes(group, sides[:, c : c + SIDE], ok[:, c])[order[:, c]]
    out = np.zeros(h.shape, bool)
    np.put_along_axis(out, order, hit, 0)
    return out & ok


def _by_bytes(group: np.ndarray, windows: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Without hashes: for a column in which two different windows share one."""
    keys = [(g, w.tobytes()) if o else None for g, w, o in zip(group.tolist(), windows, ok.tolist(), strict=True)]
    n = Counter(keys)
    return np.array([k is not None and n[k] > 1 for k in keys], bool)


def _runs(hit: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last window start) of runs of repeated windows."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1] - 1
    return row, pos[row] - SIDE + a, pos[row] - SIDE + b


_STARTS = "rid long, r2 long, a long, b long"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (h1, h2).  Whole groups are gathered up to _ROWS rows."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h1, h2, lo, hi, rid, r2, pos = (t.column(c).to_numpy() for c in ("h1", "h2", "lo", "hi", "rid", "r2", "pos"))
        new = np.concatenate([[True], (np.diff(h1) != 0) | (np.diff(h2) != 0)])
        group = np.cumsum(new)
        alone = new & np.concatenate([new[1:], [True]])
        keep = np.flatnonzero(~alone)
        if len(keep):
            sides = np.frombuffer(b"".join(t.column("sides").take(pa.array(keep)).to_pylist()), np.uint8).reshape(-1, 2 * SIDE)
            row, a, b = _runs(_repeated(group[keep], sides, lo[keep], hi[keep]), pos[keep])
            yield pa.RecordBatch.from_arrays([pa.array(rid[keep][row]), pa.array(r2[keep][row]), pa.array(a), pa.array(b)], ["rid", "r2", "a", "b"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            held.append(part)
            n += part.num_rows
            if n < _ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            h1, h2 = t.column("h1").to_numpy(), t.column("h2").to_numpy()
            cut = int(np.flatnonzero((h1 != h1[-1]) | (h2 != h2[-1]))[-1]) + 1 if h1[0] != h1[-1] or h2[0] != h2[-1] else 0
            if cut:
                yield from run(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            n = t.num_rows - cut
    if n:
        yield from run(pa.Table.from_batches(held).combine_chunks())


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One member of each class of a hot group: a row for each window, with 128 bits of its side bytes besides those of the sample."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            h1, h2, lo, hi, cls = (b.column(c).to_numpy() for c in ("h1", "h2", "lo", "hi", "cls"))
            sides = np.frombuffer(b"".join(b.column("sides").to_pylist()), np.uint8).reshape(-1, 2 * SIDE)
            row, col = np.nonzero(_valid(lo, hi))
            windows = np.lib.stride_tricks.sliding_window_view(sides, SIDE, axis=1)[row, col]
            w = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, windows)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[row], h2[row], col.astype(np.int32), w[:, 0].copy(), w[:, 1].copy(), cls[row])], ["h1", "h2", "col", "w1", "w2", "cls"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by two hashes of doc_id and text."""
    return docs.select("*", F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64(F.lit("r2"), "text", "doc_id").alias("r2"))


def repeated_starts(docs: DataFrame, hot: int = HOT_GROUP) -> DataFrame:
    """rid, r2 and ranges [a, b] of starts of repeated windows, of ``docs`` (doc_id, text)."""
    keyed = _keyed(docs).withColumn("text", F.col("text").cast("binary"))
    samples = stored(keyed.filter(F.length("text") >= LENGTH).select("rid", "text").mapInArrow(_samples, "h1 long, rid long, pos long"), "samples")
    again = stored(samples.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    lists = hot_join(samples, again, ["h1"], "n", samples.count()).groupBy("rid").agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"))
    found = keyed.filter(F.length("text") >= LENGTH).join(lists, "rid").select("rid", "r2", "text", "pos", "n").mapInArrow(_contexts, _CONTEXT)
    spread = (again.agg(F.max("n")).first()[0] or 0) > hot
    if spread:
        found = stored(found, "contexts")
        forget(samples, again)
    cold = found.filter(F.col("n") <= hot)
    solved = cold.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(_solve, _STARTS)
    if not spread:
        return solved
    # classes of members with the same sides: told apart by their bytes, numbered by a hash of them
    like = ["h1", "h2", "sides", "lo", "hi"]
    warm = found.filter(F.col("n") > hot)
    classes = stored(warm.groupBy(*like).agg(F.count(F.lit(1)).alias("m")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    wide = stored(classes.mapInArrow(_spread, "h1 long, h2 long, col int, w1 long, w2 long, cls long"), "windows")
    keys = ["h1", "h2", "col", "w1", "w2"]
    twice = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    cols = hot_join(wide, twice, keys, "k", wide.count()).groupBy("cls").agg(F.collect_list("col").alias("cols"))
    every = F.transform(F.sequence(F.lit(SIDE) - F.col("hi"), F.lit(SIDE) - F.col("lo")), lambda c: c.cast("int"))
    again = classes.join(cols, "cls", "left").withColumn("cols", F.when(F.col("m") > 1, every).otherwise(F.col("cols"))).filter("cols IS NOT NULL").select(*like, "m", F.sort_array("cols").alias("cols"))
    # runs of neighbouring columns: [first, last]
    first = F.filter(F.col("cols"), lambda c: ~F.array_contains("cols", c - 1))
    last = F.filter(F.col("cols"), lambda c: ~F.array_contains("cols", c + 1))
    runs = stored(again.select(*like, "m", F.arrays_zip(first.alias("a"), last.alias("b")).alias("runs")), "runs")
    hits = hot_join(warm.drop("n"), runs, like, "m", warm.count())
    out = hits.select("rid", "r2", "pos", F.explode("runs").alias("x")).select("rid", "r2", (F.col("pos") - SIDE + F.col("x.a")).alias("a"), (F.col("pos") - SIDE + F.col("x.b")).alias("b"))
    forget(wide, classes)
    return solved.unionByName(out)


def _removed(starts: list[int] | None, lasts: list[int] | None, n: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs."""
    if not starts:
        return []
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.array(starts), 1)
    np.add.at(edge, np.array(lasts) + LENGTH, -1)
    on = np.cumsum(edge[:-1]) > 0
    e = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(e[::2].tolist(), e[1::2].tolist(), strict=True))


def _keep(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for text, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "a", "b")), strict=True):
            text = text or b""
            runs = _removed(a, b, len(text))
            kept = _keep(text, runs) if runs else text
            for c, v in zip(cols, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_ranges(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, text (binary) and each row's ranges."""
    ranges = stored(starts, "starts").groupBy("rid", "r2").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return _keyed(docs).withColumn("text", F.col("text").cast("binary")).join(ranges, ["rid", "r2"], "left")


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id and its maximal removed byte runs, as array<struct<a, b>>."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            spans = [[{"a": x, "b": y} for x, y in _removed(a, b, len(t or b""))] for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "a", "b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return _with_ranges(docs, repeated_starts(docs)).select("doc_id", "text", "a", "b").mapInArrow(run, "doc_id long, spans array<struct<a: long, b: long>>")


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _with_ranges(docs, repeated_starts(docs)).select("doc_id", "text", "a", "b").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
