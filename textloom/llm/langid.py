"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sampled training text.
A text is encoded with each of them, in pieces of ``PIECE`` letters so that long
texts gain as much from the dictionary as short ones; the language with the
smallest sum of sizes wins.  If the second is within ``MARGIN`` of it the answer
is rejected (column ``rejected``).

Dictionaries hold ``DICT_PIECES`` pieces a language, of texts in the order of a
hash of doc_id, and every learned value of lang has one.  They are taken in groups
of ``GROUP`` languages: a group is one pass over the texts without a shuffle, and
with several groups the two smallest sums so far are carried from pass to pass.

Defined cases: null text, and text without a letter, is ``und`` with score 0.
Ties go to the language that sorts first.  Null languages and null doc_ids are
not learnt from.  Equal pieces enter a dictionary once.  Without any training
row all predictions are ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, held_out, stored, table

PIECE = 2000
#: Pieces of training text in a language's dictionary (bounded sample).
DICT_PIECES = 60
#: Languages whose dictionaries a worker holds at once: about 120 KB of text each.
GROUP = 200
MARGIN = 0.01
LEVEL = 3
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> str:
    """Lower-cased words (letters with their marks), single spaces.  Dictionaries and texts both go through it."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first = [letters(t)[:PIECE] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("doc_id"), pa.array(first, pa.string())], ["lang", "doc_id", "piece"])


def dictionaries(docs: DataFrame, split: bool = True) -> dict[str, bytes]:
    """Per language its raw content; one entry a learned value of lang."""
    bounded_batches(docs.sparkSession)
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    if split:
        known = known.filter(~held_out())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = docs.sparkSession.createDataFrame([(k, min(1.0, 4 * DICT_PIECES / n)) for k, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = known.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").filter(draw <= F.col("share"))
    piece = some.select("lang", "doc_id", "text").mapInArrow(_pieces, "lang string, doc_id long, piece string").filter("piece <> ''")
    first = piece.groupBy("lang", "piece").agg(F.min("doc_id").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = first.withColumn("rank", rank).filter(F.col("rank") <= DICT_PIECES).orderBy("lang", "rank").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.piece)
    return {k: " ".join(v).encode() for k, v in out.items()}


class Classifier:
    def __init__(self, raw: dict[str, bytes]):
        self.coders = []
        for lang in sorted(raw):
            d = zstandard.ZstdCompressionDict(raw[lang].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def sizes(self, text: str | None) -> list[tuple[int, str]] | None:
        """The two smallest sums of sizes with their languages; None for a text without letters."""
        clean = letters(text) if text else ""
        if not any(map(str.isalpha, clean)):
            return None
        pieces = [clean[i : i + PIECE].encode("utf-8", "replace") for i in range(0, len(clean), PIECE)]
        return sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in self.coders)[:2]


def verdict(sizes: list[tuple[int, str]] | None) -> tuple[str, float, bool]:
    """Language, score, whether the margin is too narrow."""
    if not sizes:
        return "und", 0.0, True
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    margin = sizes[1][0] / sizes[0][0] - 1
    return sizes[0][1], 1 - 0.5 * math.exp(-20 * margin), margin < MARGIN


def predicted(docs: DataFrame, raw: dict[str, bytes], group: int = GROUP) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    names = sorted(raw)
    groups = [names[i : i + group] for i in range(0, len(names), group)] or [[]]
    best = pa.list_(pa.struct([("n", pa.int64()), ("lang", pa.string())]))
    rows = docs.select("doc_id", "text")
    for k, part in enumerate(groups):
        shared, last = spark.sparkContext.broadcast({x: raw[x] for x in part}), k == len(groups) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, carry=k > 0, last=last) -> Iterator[pa.RecordBatch]:
            c = Classifier(shared.value)
            for b in batches:
                got = [c.sizes(t) for t in b.column("text").to_pylist()]
                if carry:
                    before = ([(x["n"], x["lang"]) for x in s or ()] for s in b.column("best").to_pylist())
                    got = [None if g is None else sorted([*g, *s])[:2] for g, s in zip(got, before, strict=True)]
                if last:
                    said = [verdict(g) for g in got]
                    cols = [pa.array([v[0] for v in said], pa.string()), pa.array([v[1] for v in said], pa.float64()), pa.array([v[2] for v in said], pa.bool_())]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "lang_pred", "score", "rejected"])
                else:
                    two = pa.array([[{"n": n, "lang": x} for n, x in g or ()] for g in got], best)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), two], ["doc_id", "text", "best"])

        if last:
            rows = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
        else:
            rows = stored(rows.mapInArrow(run, "doc_id long, text string, best array<struct<n: long, lang: string>>"), "languages")
    return rows


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, dictionaries(docs)).select("doc_id", held_out(), "lang_pred", "score", "rejected")
