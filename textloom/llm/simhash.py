"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are 64-bit majorities of XXH64 (seed 42) over 3-word shingles.
Documents with equal fingerprints share one node.  Distinct fingerprints at
``RADIUS`` or fewer differing bits are found without comparing everything: of
five blocks of bits at least three are untouched by two flips, so each
fingerprint goes into ten buckets, one for each choice of three blocks.  A
bucket is compared exactly with numpy, tile against tile (exclusive-or, then bit
counts).  Fingerprints are in the order of their population counts, tiles end
where the count changes, and tile pairs whose counts differ by more than the
radius are skipped.  A bucket past ``TILE_LIMIT`` fingerprints is split again by
thirds of its free bits, by the same argument.

A bucket's links are joined at once: it hands on a star for each of its
components, never all pairs.  Components of the stars come from alternating
large-star and small-star steps over distributed tables, written to the shared
folder after each step.

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other.  One or two words: the whole sequence is the shingle.  A null
doc_id takes part and gets the component's smallest doc_id.  Rows with the same
doc_id are separate documents of the same id.  An empty table gives no rows.
A radius above two raises ValueError: two of the five blocks may differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, forget, hot_join, stored, table, text_bytes

RADIUS = 2
TILE = 2048
TILE_LIMIT = 65_536
#: Buckets up to this size are one tile.
SMALL = 256
_EDGES = (0, 13, 26, 39, 52, 64)
BLOCKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES, _EDGES[1:], strict=False)]
MASKS = [sum(x) for x in combinations(BLOCKS, 3)]
_HASHES = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None) -> int:
    """Unsigned.  Whole texts; long ones are counted in pieces of shingles."""
    ws = text.lower().split() if text else []
    if not ws:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(ws) - 2)
    if len(ws) < 3:
        return digest(b" ".join(ws), 42)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        h = np.array([digest(b"%b %b %b" % x, 42) for x in zip(ws[at : at + min(_HASHES, n - at)], ws[at + 1 :], ws[at + 2 :], strict=False)], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_signed(fingerprint(t)) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long)."""
    bounded_batches(docs.sparkSession)
    return text_bytes(docs).mapInArrow(_prints, "doc_id long, fp long")


def tiles(ones: np.ndarray, tile: int = TILE) -> list[tuple[int, int]]:
    """Ranges of at most ``tile`` fingerprints; few fingerprints are one, more are cut where the count changes."""
    cuts = [] if len(ones) <= SMALL else (np.flatnonzero(np.diff(ones)) + 1).tolist()
    edges = [0, *cuts, len(ones)]
    return [(i, min(i + tile, b)) for a, b in zip(edges, edges[1:], strict=False) for i in range(a, b, tile)]


def close_pairs(fp: np.ndarray, radius: int = RADIUS, tile: int = TILE, seen: list[int] | None = None) -> Iterator[np.ndarray]:
    """All pairs of distinct uint64 ``fp`` within ``radius``, as n x 2 arrays; ``seen`` counts tile pairs compared and skipped."""
    ones = np.bitwise_count(fp)
    order = np.argsort(ones, kind="stable")
    fp, ones = fp[order], ones[order].astype(np.int64)
    parts = tiles(ones, tile)
    for k, (i, i2) in enumerate(parts):
        a, top = fp[i:i2], ones[i2 - 1]
        for m, (j, j2) in enumerate(parts[k:], k):
            if ones[j] - top > radius:
                if seen:
                    seen[1] += len(parts) - m
                break  # counts ascend: no later tile comes closer
            if seen:
                seen[0] += 1
            b = fp[j:j2]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if k == m:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield np.stack([a[x], b[y]], 1)


def _split(fp: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Parts of a large bucket such that every close pair is in one of them: radius + 1 parts of the free bits, one of which is equal."""
    free = int(np.bitwise_or.reduce(fp ^ fp[0]))
    for part in np.array_split(np.array([i for i in range(64) if free >> i & 1], np.uint64), radius + 1):
        key = fp & np.uint64(sum(1 << int(i) for i in part))
        order = np.argsort(key, kind="stable")
        yield from (g for g in np.split(fp[order], np.flatnonzero(np.diff(key[order])) + 1) if len(g) > 1)


def joined(fp: np.ndarray, radius: int = RADIUS, tile: int = TILE, limit: int | None = None) -> np.ndarray:
    """Stars (member, root) of the components of sorted distinct ``fp``, n x 2."""
    root = np.arange(len(fp))
    groups = _split(fp, radius) if len(fp) > (limit or TILE_LIMIT) else [fp]
    for g in groups:
        for pairs in close_pairs(g, radius, tile):
            at = np.searchsorted(fp, pairs)
            while len(at):
                at = np.sort(root[at], axis=1)
                at = at[at[:, 0] != at[:, 1]]
                if len(at):
                    np.minimum.at(root, at[:, 1], at[:, 0])
                    while not np.array_equal(root, root[root]):
                        root = root[root]
    member = np.flatnonzero(root != np.arange(len(fp)))
    return np.stack([fp[member], fp[root[member]]], 1).view(np.int64)


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input is sorted by bucket; a bucket that goes on in the next batch waits for it."""
        held: list[np.ndarray] = []
        held_key = None

        def flush():
            fp = np.unique(np.concatenate(held))
            p = joined(fp, radius) if len(fp) > 1 else np.zeros((0, 2), np.int64)
            for k in range(0, len(p), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(p[k : k + 100_000, 0]), pa.array(p[k : k + 100_000, 1])], ["a", "b"])

        for batch in batches:
            which, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("which", "key", "fp"))
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(which) != 0) | (np.diff(key) != 0)) + 1, [len(fp)]])
            lone = np.diff(cuts) == 1
            for k in range(len(cuts) - 1):
                if lone[k] and 0 < k < len(cuts) - 2:
                    continue
                a, b = int(cuts[k]), int(cuts[k + 1])
                if a == b:
                    continue
                me = (which[a], key[a])
                if me != held_key and held:
                    yield from flush()
                    held = []
                held_key = me
                held.append(fp[a:b].view(np.uint64))
        if held:
            yield from flush()

    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in ``nodes.fp`` that connect what is linked: stars of each bucket's components."""
    if not 0 <= radius <= 2:
        raise ValueError("the radius must be 0, 1 or 2: two of five blocks may differ")
    keys = F.array(*(F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(MASKS)))
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("k.which", "k.key", "fp")
    return rows.repartition("which", "key").sortWithinPartitions("which", "key").mapInArrow(_bucket_links(radius), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (smallest node of its component) for every node on an edge."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        size = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
        # done when every node has one edge and none leads on: stars of the smallest nodes
        if size.n == size.u and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        for small in (False, True):
            both = e.select("u", "v") if small else e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
            joint = hot_join(both, least, ["u"], "n", size.n * 2)
            if small:
                new = joint.select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
            else:
                new = joint.filter("v > u").select(F.col("v").alias("x"), "m")
            old, e = e, stored(new.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "edges")
            forget(old)
            size = e.agg(F.count(F.lit(1)).alias("n")).first()
    else:
        raise RuntimeError("components didn't settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id."""
    prints = stored(fingerprints(docs.select("doc_id", "text")), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    edges = stored(links(nodes, radius), "links")
    if edges.isEmpty():
        named = nodes.select("fp", "n", F.col("rep").alias("component_id"))
    else:
        roots = components(edges)
        member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        lowest = member.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("w"))
        named = hot_join(member, lowest, ["root"], "w", nodes.count()).select("fp", "n", "component_id")
    classes = stored(named, "classes")
    forget(edges, nodes)
    return hot_join(prints, classes, ["fp"], "n", prints.count()).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents with the smallest doc_id of each component.  Of rows with
    the same doc_id one stays: that with the smallest text.  Documents with a
    null doc_id stay only where their whole component has none."""
    found = near_duplicates(docs, radius).filter("doc_id <=> component_id").select(F.col("doc_id").alias("id")).distinct()
    packed = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = packed.alias("d").join(found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")), "left_semi")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept.select("row.*")
    # rows are told apart by their text first; maps have no order, so they go by their text form
    order = F.struct(F.col("body"), F.col("row").cast("string"))
    return kept.groupBy("id").agg(F.min_by("row", order).alias("row")).select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
