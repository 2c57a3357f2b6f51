"""Matching only where a match can be.

A pattern with literals at bounded distances from the start of a match can begin
only where each of them says so: every occurrence of a literal gives an interval
of starts, and the intervals of all literals are joined by their overlap.  A
pattern of bounded width then needs no text beyond its intervals and that width.
On long texts that match rarely this is what keeps verification small.

All of it are array expressions of one row: no shuffle.  Offsets are bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import once, running, running_max
from textloom.operators import search
from textloom.plans.pattern import Pattern, PatternOptions, compile_pattern, looks_around, spots

#: Bytes that a region has beyond what a match can reach: boundaries look at one code point.
MARGIN = 4


def bounded(p: Pattern) -> bool:
    """Whether regions find the same matches as whole texts."""
    return p.node is not None and not p.extended and search.whole_text(p) and p.most is not None and p.least > 0 and not looks_around(p.node) and bool(spots(p.node))


def literal_starts(text: Column, literal: str) -> Column:
    """Byte offsets of all occurrences, overlapping ones as well."""
    p = compile_pattern(literal, PatternOptions(fixed=True))
    return F.transform(search.span_array(text, p, overlapping=True), lambda s: s["start"])


def merged(intervals: Column) -> Column:
    """Disjoint ascending intervals [lo, hi] of the same positions."""

    def of(s: Column) -> Column:
        def cut(past: Column) -> Column:
            """``past``: one more than the largest end before each interval."""
            first = F.filter(F.transform(s, lambda x, i: F.struct(x["lo"].alias("lo"), F.get(past, i).alias("before"), i.alias("i"))), lambda x: (x["i"] == 0) | (x["lo"] > x["before"]))
            ended = lambda f: F.transform(f, lambda x, k: F.struct(x["lo"].alias("lo"), (F.coalesce(F.get(f, k + 1)["before"], F.element_at(past, -1)) - 1).alias("hi")))
            return once(first, ended)

        return F.when(F.size(s) > 0, once(running_max(F.transform(s, lambda x: x["hi"] + 1)), cut)).otherwise(s)

    return once(F.sort_array(intervals), of)


def with_start_intervals(corpus: DataFrame, p: Pattern) -> DataFrame:
    """``corpus`` with ``starts``, array<struct<lo, hi>>: where a match may begin, by all its literals.

    Built column by column: as one expression it would be nested too deep for the analyzer.
    """
    places = spots(p.node)
    names = [f"_l{i}" for i in range(len(places))]
    df = corpus.withColumns({n: literal_starts(F.col("text"), x) for n, (x, _, _) in zip(names, places, strict=True)})
    for name, (_, low, high) in zip(names, places, strict=True):
        each = F.transform(name, lambda x: F.struct(F.greatest(x - F.lit(high), F.lit(0)).alias("lo"), (x - F.lit(low)).alias("hi")))  # noqa: B023 (used at once)
        df = df.withColumn(name, merged(each))
    edges = lambda x: F.array(F.struct(x["lo"].alias("pos"), F.lit(1).alias("step")), F.struct((x["hi"] + 1).alias("pos"), F.lit(-1).alias("step")))
    df = df.withColumn("_e", F.sort_array(F.concat(*(F.flatten(F.transform(F.filter(n, lambda x: x["hi"] >= 0), edges)) for n in names))))
    # arrays meet element by element: a column that is used once, inside a lambda, would be computed for each element
    opened = lambda e: once(running(F.transform(e, lambda x: x["step"])), lambda n: F.zip_with(e, F.slice(n, 2, F.greatest(F.size(e), F.lit(1))), lambda x, k: F.struct(x["pos"].alias("pos"), k.alias("n"))))
    df = df.withColumn("_e", once(F.col("_e"), opened))
    # where as many intervals are open as there are literals
    rows = F.transform("_e", lambda x, i: F.struct(x["pos"].alias("lo"), (F.get("_e", i + 1)["pos"] - 1).alias("hi"), x["n"].alias("n")))
    found = F.transform(F.filter(rows, lambda x: (x["n"] == len(places)) & (x["hi"] >= x["lo"])), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))
    return df.withColumn("starts", found).drop("_e", *names)


def with_regions(corpus: DataFrame, p: Pattern) -> DataFrame:
    """``corpus`` with ``regions``, array<struct<lo, hi>>: disjoint byte ranges [lo, hi] that hold all matches and what they look at."""
    wide = F.transform("starts", lambda x: F.struct(F.greatest(x["lo"] - MARGIN, F.lit(0)).alias("lo"), F.least(x["hi"] + (p.most + MARGIN), F.octet_length("text").cast("bigint") - 1).alias("hi")))
    return with_start_intervals(corpus, p).withColumn("regions", wide).withColumn("regions", merged(F.col("regions"))).drop("starts")


def find(corpus: DataFrame, p: Pattern) -> DataFrame:
    """The same spans as ``search.find``; patterns that aren't ``bounded`` are searched whole."""
    if not bounded(p):
        return search.find(corpus, [p]).select("file_id", "start", "end")
    some = search._candidates(corpus, [p]).select("file_id", search.tidy(F.col("text")).alias("text"))
    data = F.col("text").cast("binary")

    def part(x: Column) -> Column:
        """A region's text from its first whole code point on; a code point that is cut at the end is out of reach."""
        size = (x["hi"] - x["lo"] + 1).cast("int")
        raw = F.substring(data, (x["lo"] + 1).cast("int"), size)
        skip = (F.length(F.regexp_extract(F.hex(F.substring(raw, F.lit(1), F.lit(4))), "^(?:[89AB][0-9A-F]){0,3}", 0)) / 2).cast("int")
        return F.struct((x["lo"] + skip).alias("lo"), F.substring(raw, skip + 1, size).cast("string").alias("part"))

    rows = search.each(with_regions(some, p), F.transform("regions", part), "file_id")
    need = p.prefilter(F.col("x.part"))
    rows = rows if need is None else rows.filter(need)
    return search.each(rows, search.span_array(F.col("x.part"), p, base=F.col("x.lo")), "file_id", name="s").select("file_id", "s.start", "s.end")


def coverage(corpus: DataFrame, p: Pattern) -> DataFrame:
    """One row: files, regions, bytes in them and bytes in all."""
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (F.octet_length("text").cast("bigint") - 1).alias("hi")))
    each = (with_regions(corpus, p) if bounded(p) else corpus.withColumn("regions", whole)).select(F.col("regions").alias("r"), F.octet_length("text").cast("bigint").alias("n"))
    zero = F.lit(0).cast("bigint")
    touched = F.aggregate("r", zero, lambda s, x: s + x["hi"] - x["lo"] + 1)
    return each.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size("r").cast("bigint")), zero).alias("regions"), F.coalesce(F.sum(touched), zero).alias("region_bytes"), F.coalesce(F.sum("n"), zero).alias("bytes"))
