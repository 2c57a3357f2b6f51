"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one automaton.  A document's words
are streamed through it, tracking the length of the longest suffix that occurs
in some item.  Wherever that reaches ``WINDOW`` words (or all of an item that is
shorter) the words are hit.

Most text never meets an item, so streaming starts only near an anchor: any
window of L words has a word triple inside whose start is a multiple of L - 2,
hence looking up every (L - 2)-th triple of the document misses no occurrence.
From an anchor the automaton runs from L words before it to where the match
falls below three words again.

The benchmark is read in groups of items of at most ``MAX_ITEM_WORDS`` words, and
no worker holds more than one automaton.  With one group, marks come straight from
the scan.  With several, each group is a pass that writes the hits of documents
that have any, and nothing of the others; the hits then meet the documents.

Defined cases: null text, and null items, have no words; an item without words
is no window.  Repeated item_ids and items are allowed; an item_id counts once.
Null item_ids make hits but aren't listed.  Rows with equal or null doc_id are
independent documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, stored, table

WINDOW = 10
#: Words in items that one automaton takes: about 200 MB in each Python worker.
MAX_ITEM_WORDS = 300_000
#: Keys that the rows of one text are dealt to.
SALTS = 16

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton over word numbers of several items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = [(i, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, ws in items if ws]
        ends: list[tuple[int, int]] = []
        for n, (_, seq) in enumerate(self.items):
            last = 0
            for w in seq:
                last = self._extend(last, w)
                ends.append((last, n))
        # whose windows a state stands for: its own ends and those of all states that link to it
        self.owners: list[set[int]] = [set() for _ in self.go]
        for state, n in ends:
            self.owners[state].add(n)
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] > 0:
                self.owners[self.link[state]] |= self.owners[state]
        #: whole items shorter than the window, by their word numbers
        self.short: dict[tuple[int, ...], set[int]] = {}
        for n, (_, seq) in enumerate(self.items):
            if len(seq) < window:
                self.short.setdefault(tuple(seq), set()).add(n)
        self.short_sizes = sorted({len(k) for k in self.short})
        least = min([window, *self.short_sizes])
        self.step = max(1, least - 2)
        self.gram = min(3, least)
        self.triples = {tuple(seq[i : i + self.gram]) for _, seq in self.items for i in range(len(seq) - self.gram + 1)}

    def _extend(self, last: int, w: int) -> int:
        go, link, length = self.go, self.link, self.length
        if w in go[last]:
            q = go[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in go[p]:
            go[p][w] = cur
            p = link[p]
        if p != -1:
            q = go[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        go, link, length = self.go, self.link, self.length
        c = len(go)
        go.append(dict(go[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and go[p].get(w) == q:
            go[p][w] = c
            p = link[p]
        return c

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (disjoint, ascending) and the numbers of items with occurring windows."""
        n, g, get, triples = len(ws), self.gram, self.number.get, self.triples
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        upto = 0  # words before it were streamed
        if g == 3:
            anchors = (i for i in range(0, n - 2, self.step) if (a := get(ws[i])) is not None and (b := get(ws[i + 1])) is not None and (a, b, get(ws[i + 2])) in triples)
        else:
            anchors = (i for i in range(0, n - g + 1, self.step) if tuple(get(w) for w in ws[i : i + g]) in triples)
        for at in anchors:
            if at + g <= upto:
                continue
            upto, part = self._stream(ws, max(at - self.window, 0), at + g, found)
            hits += part
        return _merge(hits), found

    def _stream(self, ws: list[bytes], start: int, least: int, found: set[int]) -> tuple[int, list[tuple[int, int]]]:
        """Where streaming stopped, and the hit ranges it met: ascending among themselves, but they may lie before and in ranges of earlier streams."""
        go, link, length, win, get = self.go, self.link, self.length, self.window, self.number.get
        state = size = 0
        recent: list[int | None] = []
        hits: list[tuple[int, int]] = []
        for j in range(start, len(ws)):
            w = get(ws[j])
            recent.append(w)
            if w is None:
                state = size = 0
            else:
                while state and w not in go[state]:
                    state = link[state]
                    size = length[state]
                if w in go[state]:
                    state = go[state][w]
                    size += 1
                else:
                    size = 0
            took = 0
            if size >= win:
                took = size
                s = state
                while length[link[s]] >= win:
                    s = link[s]
                found |= self.owners[s]
            for m in self.short_sizes:
                if m > size:
                    break
                own = self.short.get(tuple(recent[-m:]))
                if own:
                    found |= own
                    took = max(took, m)
            if took:
                a = j + 1 - took
                while hits and a <= hits[-1][1]:
                    a = min(a, hits.pop()[0])
                hits.append((a, j + 1))
            if size < self.gram and j + 1 >= least:
                return j + 1, hits
        return len(ws), hits


def _groups(benchmark: DataFrame, most: int) -> Iterator[tuple[list[tuple[object, list[bytes]]], bool]]:
    """Items in groups of at most ``most`` words (or one item), and whether the group is the last; one at a time."""
    group: list[tuple[object, list[bytes]]] = []
    size = 0
    for i, t in benchmark.select("item_id", F.col("text").cast("binary")).distinct().toLocalIterator():
        ws = words(bytes(t) if t is not None else None)
        if not ws:
            continue
        if group and size + len(ws) > most:
            yield group, False
            group, size = [], 0
        group.append((i, ws))
        size += len(ws)
    yield group, True


_BUILT: dict[bytes, ItemAutomaton] = {}


def _automaton(items: list[tuple[object, list[bytes]]], window: int) -> ItemAutomaton:
    """Built once a worker."""
    key = hashlib.sha256(repr((items, window)).encode()).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemAutomaton(items, window)
    return _BUILT[key]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = "n_words long, starts array<long>, ends array<long>, item_ids array<string>"


def _scanned(rows: DataFrame, shared, window: int, head: list[str], only_hits: bool) -> DataFrame:
    """``rows`` (text as binary) marked by one group of items: the columns ``head``, n_words, hit ranges, item_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(shared.value, window)
        longs, names = pa.list_(pa.int64()), pa.list_(pa.string())
        for b in batches:
            n, starts, ends, ids = [], [], [], []
            for text in b.column("text").to_pylist():
                ws = words(text)
                spans, found = a.scan(ws) if a.items else ([], set())
                n.append(len(ws))
                starts.append([x for x, _ in spans])
                ends.append([x for _, x in spans])
                ids.append(sorted({str(a.items[k][0]) for k in found if a.items[k][0] is not None}))
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in head), pa.array(n, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(ids, names)], [*head, "n_words", "starts", "ends", "item_ids"])
            yield out.filter(pa.array([bool(x) for x in starts], pa.bool_())) if only_hits else out

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in head) + f", {_HITS}")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of all rows, and their hits of several groups as one list."""
    longs, names = pa.list_(pa.int64()), pa.list_(pa.string())
    for b in batches:
        n, starts, ends, ids = [], [], [], []
        for text, s, e, i in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "ends", "item_ids")), strict=True):
            spans = _merge([p for x, y in zip(s or (), e or (), strict=True) for p in zip(x, y, strict=True)])
            n.append(len(words(text)))
            starts.append([x for x, _ in spans])
            ends.append([x for _, x in spans])
            ids.append(sorted({x for part in i or () for x in part}))
        yield pa.RecordBatch.from_arrays([b.column("rest"), b.column("text"), pa.array(n, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(ids, names)], ["rest", "text", "n_words", "starts", "ends", "item_ids"])


def _marked(rows: DataFrame, benchmark: DataFrame, window: int, most: int, keep_text: bool) -> DataFrame:
    """``rows`` (text as binary, rest: any struct) with n_words, hit ranges and item_ids; text only on request."""
    spark = rows.sparkSession
    head = ["rest", "text"] if keep_text else ["rest"]
    # equal texts have equal hits, so rows are known by two hashes of their text
    known = rows.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("t2"), "text").alias("t2"))
    passes: list[DataFrame] = []
    for items, last in _groups(benchmark, most):
        shared = spark.sparkContext.broadcast(items)
        if last and not passes:
            return _scanned(rows, shared, window, head, False)
        if items:
            passes.append(stored(_scanned(known.select("text", "t1", "t2"), shared, window, ["t1", "t2"], True).dropDuplicates(["t1", "t2"]), "hits"))
        shared.unpersist()
    hits = reduce(DataFrame.unionByName, passes).groupBy("t1", "t2").agg(*(F.collect_list(c).alias(c) for c in ("starts", "ends", "item_ids")))
    # a text may have a third of all rows, so rows of one text are dealt to SALTS keys
    few = hits.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = known.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    both = salted.join(few, ["t1", "t2", "salt"], "left").select("rest", "text", "starts", "ends", "item_ids")
    kind = rows.schema["rest"].dataType.simpleString()
    return both.mapInArrow(_joined, f"rest {kind}, text binary, {_HITS}").select(*head, "n_words", "starts", "ends", "item_ids")


def hit_ranges(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MAX_ITEM_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, hit word ranges ``[start, end)`` and the item_ids (as sorted strings)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct("doc_id").alias("rest"), F.col("text").cast("binary").alias("text"))
    return _marked(rows, benchmark, window, most, False).select("rest.doc_id", "n_words", "starts", "ends", "item_ids")


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each range."""
    plain = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8)))
    firsts, lasts = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : firsts[a]])
        at = int(lasts[b - 1])
    out.append(text[at:])
    return b"".join(out)


def _without_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [_cut(t, list(zip(s, e, strict=True))) if s else t for t, s, e in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.binary())], ["rest", "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5, most: int = MAX_ITEM_WORDS, rounds: int = 20) -> DataFrame:
    """``docs`` with hit spans cut out of their texts; documents of which more
    than ``max_share`` of the words are hit go.  All columns are kept.

    What a cut brings together may be a window again, so the few documents that
    were cut are looked at again until nothing is hit.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("rest"), F.col("text").cast("binary").alias("text"))
    schema = f"rest {packed.schema['rest'].dataType.simpleString()}, text binary"
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    done, todo, first = None, packed, True
    for _ in range(rounds):
        marked = stored(_marked(todo, benchmark, window, most, True), "marked")
        clean = marked.filter(F.size("starts") == 0).select("rest", "text")
        done = clean if done is None else done.unionByName(clean)
        hit = marked.filter(F.size("starts") > 0)
        if first:
            hit = hit.filter(n_hit <= max_share * F.col("n_words"))
        if hit.isEmpty():
            break
        todo, first = stored(hit.mapInArrow(_without_hits, schema), "cut"), False
    else:
        raise RuntimeError("cutting didn't settle")
    return done.select(*(F.col("text").cast("string").alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hit_ranges(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[loc : loc + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS loc FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS loc FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT doc_id, loc, p.n, item_id FROM (SELECT doc_id, n, loc, array_to_string(w[loc : loc + n - 1], ' ') AS g FROM places) p
  JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(loc, loc + n)) AS pos FROM hits) GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
