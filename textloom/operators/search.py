"""Search over a corpus: lines, selection, spans, contexts, limits.

A corpus is any DataFrame with ``file_id`` and ``text`` (and ``path`` where output
wants it).  All of a file's lines live in one array column until the end, so
contexts, limits and offsets need no shuffle and no window: rows are independent.
Offsets are bytes of the UTF-8 text, half-open.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import once, running
from textloom.plans.pattern import Pattern, PatternOptions, _Emitter, compile_pattern

#: Noncharacters that frame matches while a text is being taken apart.  A text
#: that holds them has them replaced by U+FFFD, which is as long.
OPEN, CLOSE = "￾", "￿"


def tidy(text: Column) -> Column:
    return F.when(text.contains(OPEN) | text.contains(CLOSE), F.regexp_replace(text, f"[{OPEN}{CLOSE}]", "�")).otherwise(text)


def _java_literal(s: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):X}}}" for c in s)


def each(df: DataFrame, array: Column, *keep: str, name: str = "x") -> DataFrame:
    """A row for each element.  A plain generator makes the optimizer infer that the array isn't empty, push that below the
    projection and so compute the array twice; an outer one doesn't."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


# -- records ------------------------------------------------------------------


def line_array(text: Column, separator: str = "\n", crlf: bool = False) -> Column:
    """array<struct<no, begin, end, term_end, line>>: records without their separators.

    An empty text is one empty record; a final separator adds none.
    """
    parts = F.split(text, _java_literal(separator), -1)
    n = len(separator.encode())

    def build(p: Column) -> Column:
        whole = F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), F.slice(p, 1, F.size(p) - 1)).otherwise(p)

        def located(q: Column) -> Column:
            def rows(r: Column) -> Column:
                def row(x: Column, i: Column) -> Column:
                    strip = x.endswith("\r") if crlf else F.lit(False)
                    line = F.when(strip, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x) if crlf else x
                    begin = F.get(r, i)
                    return F.struct((i + 1).cast("bigint").alias("no"), begin.alias("begin"), (begin + F.octet_length(line)).alias("end"), F.least(F.get(r, i + 1), F.octet_length(text).cast("bigint")).alias("term_end"), line.alias("line"))

                return F.transform(q, row)

            return once(running(F.transform(q, lambda x: F.octet_length(x) + n)), rows)

        return once(whole, located)

    return once(parts, build)


def lines(corpus: DataFrame, separator: str = "\n", crlf: bool = False) -> DataFrame:
    """One row a record: file_id, line_no, begin, end, term_end, line."""
    rows = each(corpus, line_array(F.col("text"), separator, crlf), "file_id")
    return rows.select("file_id", F.col("x.no").alias("line_no"), F.col("x.begin").alias("begin"), F.col("x.end").alias("end"), F.col("x.term_end").alias("term_end"), F.col("x.line").alias("line"))


# -- spans --------------------------------------------------------------------


def span_array(text: Column, p: Pattern, overlapping: bool = False, base: Column | None = None) -> Column:
    """array<struct<start, end, hit>> of the matches in ``text``, in one pass of the matcher.

    Matches are framed by noncharacters; what lies between frames gives the
    offsets.  Empty matches are found as Java's ``find`` does: the next search
    begins one code point on.  Overlapping: a match at every start, framed
    copies before the text they match.
    """
    if overlapping:
        java = f"(?=({_Emitter(p.options).emit(_shifted(p.node))}))"
        marked = F.regexp_replace(tidy(text), F.lit(java), F.lit(f"{OPEN}$1{CLOSE}"))
    else:
        marked = F.regexp_replace(tidy(text), F.lit(p.java), F.lit(f"{OPEN}$0{CLOSE}"))
    off = F.lit(0).cast("bigint") if base is None else base

    def found(pieces: Column) -> Column:
        n = F.size(pieces).cast("int")
        hits = ((n - 1) / 2).cast("int")

        def of(r: Column) -> Column:
            def span(k: Column) -> Column:
                a = off + (F.get(r, k) if overlapping else F.get(r, k * 2 + 1))
                hit = F.get(pieces, k * 2 + 1)
                return F.struct(a.alias("start"), (a + F.octet_length(hit)).alias("end"), hit.alias("hit"))

            return F.when(hits > 0, F.transform(F.sequence(F.lit(0), F.greatest(hits - 1, F.lit(0))), span)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>"))

        if overlapping:
            # gaps alone make up the text
            gaps = F.transform(F.filter(F.transform(pieces, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["i"] % 2 == 0), lambda y: F.octet_length(y["x"]))
            return once(F.slice(running(gaps), 2, F.greatest(hits, F.lit(0))), of)
        return once(running(F.transform(pieces, lambda x: F.octet_length(x))), of)

    return once(F.split(marked, f"[{OPEN}{CLOSE}]", -1), found)


def _shifted(n):
    """Backreferences one higher, under one more group."""
    items = tuple(_shifted(x) if hasattr(x, "kind") else x for x in n.items)
    return replace(n, items=items, group=n.group + 1) if n.kind == "backref" else replace(n, items=items)


def whole_text(p: Pattern) -> bool:
    """Whether matches may cross records."""
    return p.options.multiline or (p.options.fixed and not p.options.line) or (p.pure is not None)


def _candidates(corpus: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Files that may match, by necessary literals (before any regular expression runs)."""
    need = [p.prefilter(F.col("text")) for p in patterns]
    if not need or any(c is None for c in need):
        return corpus
    return corpus.filter(reduce(lambda a, b: a | b, need))


def find(corpus: DataFrame, patterns: list[Pattern], overlapping: bool = False) -> DataFrame:
    """Match spans: file_id, start, end, hit.

    Each pattern runs alone; of several the union without repeated spans.
    """
    parts = []
    for p in patterns:
        some = _candidates(corpus, [p])
        if whole_text(p):
            spans = each(some, span_array(F.col("text"), p, overlapping), "file_id", name="s")
        else:
            o = p.options
            records = lines(some, o.separator, o.crlf)
            need = p.prefilter(F.col("line"))
            records = records.filter(F.col("line").rlike(p.java) if need is None else need & F.col("line").rlike(p.java))
            spans = each(records, span_array(F.col("line"), p, overlapping, F.col("begin")), "file_id", name="s")
        parts.append(spans.select("file_id", "s.start", "s.end", "s.hit"))
    out = reduce(DataFrame.unionByName, parts)
    return out if len(parts) == 1 else out.dropDuplicates(["file_id", "start", "end"])


def first_matches(found: DataFrame, n: int) -> DataFrame:
    """A prefix of the matches in (file_id, start) order, over all files."""
    return found.orderBy("file_id", "start", "end").limit(n)


def captures(corpus: DataFrame, p: Pattern) -> DataFrame:
    """Spans with the offsets of all groups, which the JVM functions don't give: Arrow batches.

    Groups that took no part have matched = false and zero offsets.
    """
    import pyarrow as pa

    names = {v: k for k, v in p.names}
    o, code, groups, whole = p.options, p.python, 0 if p.pure is not None else p.groups, whole_text(p)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("matched", pa.bool_()), ("name", pa.string())]))

    def run(batches):
        import regex

        matcher = regex.compile(code)
        for b in batches:
            ids, starts, ends, caps = [], [], [], []
            for file_id, text in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                at = 0
                records = [text] if whole else text.split(o.separator)
                if not whole and len(records) > 1 and records[-1] == "":
                    records.pop()
                for record in records:
                    body = record[:-1] if o.crlf and not whole and record.endswith("\r") else record
                    size = (lambda i: i) if body.isascii() else (lambda i, t=body: len(t[:i].encode()))
                    for m in matcher.finditer(body):
                        ids.append(file_id)
                        starts.append(at + size(m.start()))
                        ends.append(at + size(m.end()))
                        caps.append([{"start": at + size(m.start(g)), "end": at + size(m.end(g)), "matched": True, "name": names.get(g, "")} if m.start(g) >= 0 else {"start": 0, "end": 0, "matched": False, "name": names.get(g, "")} for g in range(groups + 1)] if groups else [])
                    at += len(record.encode()) + len(o.separator.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(caps, kind)], ["file_id", "start", "end", "captures"])

    schema = "file_id long, start long, end long, captures array<struct<start: long, end: long, matched: boolean, name: string>>"
    return _candidates(corpus, [p]).select("file_id", "text").mapInArrow(run, schema)


def replacement(template: str, p: Pattern) -> str:
    """A replacement in Java's notation: ``$0 $1 $name ${name} $$``; unknown names are empty."""
    names, out, i = dict(p.names), [], 0
    while i < len(template):
        c = template[i]
        if c == "\\":
            out.append("\\\\")
            i += 1
        elif c != "$":
            out.append(c)
            i += 1
        elif template.startswith("$$", i):
            out.append("\\$")
            i += 2
        else:
            j = i + 1
            if template.startswith("{", j):
                end = template.find("}", j)
                key, nxt = (template[j + 1 : end], end + 1) if end > 0 else ("", j)
            else:
                nxt = j
                while nxt < len(template) and (template[nxt].isascii() and template[nxt].isalnum() or template[nxt] == "_"):
                    nxt += 1
                key = template[j:nxt]
            if not key:
                out.append("\\$")
                i += 1
                continue
            number = int(key) if key.isdigit() else names.get(key, -1)
            if 0 <= number <= p.groups:
                out.append(f"${number}")
                if template[nxt : nxt + 1].isdigit():
                    out.append("\\")  # keeps the next digit out of the number
            i = nxt
    return "".join(out)


def replaced(c: Column, p: Pattern, template: str) -> Column:
    """Matches replaced by the template."""
    return F.regexp_replace(c, F.lit(p.java), F.lit(replacement(template, p)))


# -- selected lines -----------------------------------------------------------


@dataclass(frozen=True)
class Request:
    """What to select and how much of it."""

    patterns: tuple[Pattern, ...]
    invert: bool = False
    max_count: int | None = None
    stop_on_nonmatch: bool = False
    before: int = 0
    after: int = 0
    passthru: bool = False
    separator: str = "\n"
    crlf: bool = False

    @staticmethod
    def of(*sources: str, invert: bool = False, max_count: int | None = None, stop_on_nonmatch: bool = False, before: int = 0, after: int = 0, passthru: bool = False, **options) -> Request:
        o = PatternOptions(**options)
        return Request(tuple(compile_pattern(s, o) for s in sources), invert, max_count, stop_on_nonmatch, before, after, passthru, o.separator, o.crlf)


_LINE = "array<struct<no:bigint,begin:bigint,end:bigint,term_end:bigint,line:string,sel:boolean,hits:bigint>>"


def _below(values: Column, at: Column) -> Column:
    """For each element of the ascending ``at``, how many ``values`` are less: one sort of both together."""
    events = F.sort_array(F.concat(F.transform(at, lambda x: F.struct(x.alias("pos"), F.lit(0).alias("value"))), F.transform(values, lambda x: F.struct(x.alias("pos"), F.lit(1).alias("value")))))

    def counted(e: Column) -> Column:
        def of(n: Column) -> Column:
            return F.transform(F.filter(F.transform(e, lambda x, i: F.struct(x["value"].alias("value"), F.get(n, i).alias("n"))), lambda x: x["value"] == 0), lambda x: x["n"])

        return once(running(F.transform(e, lambda x: x["value"])), of)

    return once(events, counted)


def _touches(lines_: Column, spans: Column) -> Column:
    """Which lines a span touches, without looking at each pair: of the spans that begin before a line's end those are
    left that don't end before it; an empty one belongs to the line it lies in."""
    begins, ends = F.transform(lines_, lambda x: x["begin"]), F.transform(lines_, lambda x: x["term_end"])
    full, empty = F.filter(spans, lambda s: s["end"] > s["start"]), F.filter(spans, lambda s: s["end"] == s["start"])
    start = lambda a: F.transform(a, lambda s: s["start"])
    parts = F.arrays_zip(
        _below(start(full), ends).alias("a"), _below(F.transform(full, lambda s: s["end"]), F.transform(begins, lambda x: x + 1)).alias("b"), _below(start(empty), ends).alias("c"), _below(start(empty), begins).alias("d")
    )
    return F.transform(parts, lambda x: (x["a"] > x["b"]) | (x["c"] > x["d"]))


def _begun(lines_: Column, spans: Column) -> Column:
    """How many spans begin in each line."""
    start = F.transform(spans, lambda s: s["start"])
    parts = F.arrays_zip(_below(start, F.transform(lines_, lambda x: x["term_end"])).alias("a"), _below(start, F.transform(lines_, lambda x: x["begin"])).alias("b"))
    return F.transform(parts, lambda x: x["a"] - x["b"])


def selected(corpus: DataFrame, r: Request, with_hits: bool = True) -> DataFrame:
    """``corpus`` with ``lines``: every record with ``sel`` and, on request, ``hits`` (matches that begin in it)."""
    rec = [p for p in r.patterns if not whole_text(p) or p.pure is not None and r.separator not in p.pure]
    wide = [p for p in r.patterns if p not in rec]
    base = corpus.select("*", line_array(F.col("text"), r.separator, r.crlf).alias("_l"), *(span_array(F.col("text"), p).alias(f"_s{i}") for i, p in enumerate(wide)))
    base = base.withColumns({f"_t{i}": _touches(F.col("_l"), F.col(f"_s{i}")) for i in range(len(wide))})
    alone = with_hits and not rec
    if alone:
        bare = lambda i: F.transform(f"_s{i}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        base = base.withColumn("_h", _begun(F.col("_l"), F.array_distinct(F.concat(*(bare(i) for i in range(len(wide)))))) if wide else F.transform("_l", lambda x: F.lit(0).cast("bigint")))

    def hit(x: Column, z: Column) -> Column:
        tests = []
        for p in rec:
            need = p.prefilter(x["line"]) if p.pure is None else None
            test = F.contains(x["line"], F.lit(p.pure)) if p.pure is not None else x["line"].rlike(p.java)
            tests.append(test if need is None else need & test)
        tests += [z[f"_t{i}"] for i in range(len(wide))]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    def hits(x: Column, z: Column) -> Column:
        if alone:
            return z["_h"]
        if len(r.patterns) == 1 and rec:
            return F.regexp_count(x["line"], F.lit(rec[0].java)).cast("bigint")
        spans = [F.transform(span_array(x["line"], p, base=x["begin"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for p in rec]
        spans += [F.transform(F.filter(f"_s{i}", lambda s: (s["start"] >= x["begin"]) & (s["start"] < x["term_end"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for i in range(len(wide))]
        return F.size(F.array_distinct(F.concat(*spans))).cast("bigint") if spans else F.lit(0).cast("bigint")

    def row(z: Column) -> Column:
        x = z["_l"] if extra else z
        sel, zero = hit(x, z), F.lit(0).cast("bigint")
        n = F.when(sel, hits(x, z)).otherwise(zero) if with_hits else zero
        return F.struct(*(x[c].alias(c) for c in ("no", "begin", "end", "term_end", "line")), (~sel if r.invert else sel).alias("sel"), n.alias("hits"))

    # what belongs to a line comes along with it: a column looked up inside the lambda may be computed for each line
    extra = [*(f"_t{i}" for i in range(len(wide))), *(["_h"] if alone else [])]
    zipped = F.arrays_zip("_l", *extra) if extra else F.col("_l")
    out = base.withColumn("lines", F.transform(zipped, row).cast(_LINE)).drop("_l", "_h", *(f"_{k}{i}" for i in range(len(wide)) for k in "st"))
    return _limited(out, r)


def _limited(df: DataFrame, r: Request) -> DataFrame:
    """Selection cut by stop-on-nonmatch and max-count."""
    if r.stop_on_nonmatch:
        def stopped(a: Column) -> Column:
            first = F.array_position(F.transform(a, lambda x: x["sel"]), True)
            tail = F.slice(a, F.greatest(first, F.lit(1)).cast("int"), F.size(a))
            run = F.array_position(F.transform(tail, lambda x: x["sel"]), False)
            last = F.when(run == 0, F.lit(1 << 60)).otherwise(first + run - 2)
            return F.transform(a, lambda x, i: x.withField("sel", x["sel"] & (i + 1 >= first) & (i + 1 <= last)))

        df = df.withColumn("lines", once(F.col("lines"), stopped))
    if r.max_count is not None:
        def cut(a: Column) -> Column:
            before = running(F.transform(a, lambda x: x["sel"].cast("int")))
            return F.zip_with(a, F.slice(before, 1, F.size(a)), lambda x, n: x.withField("sel", x["sel"] & (n < r.max_count)))

        df = df.withColumn("lines", once(F.col("lines"), cut))
    return df


def selected_lines(corpus: DataFrame, r: Request) -> DataFrame:
    """file_id, line_no, begin, end, line of the selected records."""
    some = corpus if r.invert else _candidates(corpus, list(r.patterns))
    rows = each(selected(some, r, False), F.filter("lines", lambda x: x["sel"]), "file_id")
    return rows.select("file_id", F.col("x.no").alias("line_no"), F.col("x.begin").alias("begin"), F.col("x.end").alias("end"), F.col("x.line").alias("line"))


def context_lines(corpus: DataFrame, r: Request) -> DataFrame:
    """Emitted lines: file_id, line_no, line, matched, gap (a separator goes before it), begin."""
    some = corpus if r.invert or r.passthru else _candidates(corpus, list(r.patterns))
    df = selected(some, r, False)

    def near(a: Column) -> Column:
        flags = F.transform(a, lambda x: x["sel"])

        def emitted(f: Column) -> Column:
            def keep(x: Column, i: Column) -> Column:
                if r.passthru:
                    return F.lit(True)
                low = F.greatest(i - r.after, F.lit(0))
                return F.array_contains(F.slice(f, low + 1, i + r.before - low + 1), True)

            return F.filter(a, keep)

        return once(flags, emitted)

    shown = df.withColumn("_e", near(F.col("lines")))
    gap = lambda x, i: F.struct(x.alias("x"), F.coalesce(x["no"] - F.get("_e", i - 1)["no"] > 1, F.lit(False)).alias("gap"))
    rows = each(shown, F.transform("_e", gap), "file_id", name="y")
    return rows.select("file_id", F.col("y.x.no").alias("line_no"), F.col("y.x.line").alias("line"), F.col("y.x.sel").alias("matched"), "y.gap", F.col("y.x.begin").alias("begin"))


# -- counts and file lists ----------------------------------------------------


def _count(a: str) -> Column:
    return F.size(F.filter(a, lambda x: x["sel"])).cast("bigint")


def _sum_hits(a: str) -> Column:
    return F.aggregate(F.filter(a, lambda x: x["sel"]), F.lit(0).cast("bigint"), lambda s, x: s + x["hits"])


def _counted(df: DataFrame, n: Column, include_zero: bool) -> DataFrame:
    """Zero rows go inside a generator: a filter would sink below the projection and count twice."""
    return df.select("file_id", n.alias("n")) if include_zero else each(df, F.filter(F.array(n), lambda x: x > 0), "file_id", name="n")


def count_lines(corpus: DataFrame, r: Request, include_zero: bool = False) -> DataFrame:
    """file_id, n: selected lines of each file."""
    some = corpus if r.invert or include_zero else _candidates(corpus, list(r.patterns))
    return _counted(selected(some, r, False), _count("lines"), include_zero)


def count_matches(corpus: DataFrame, r: Request, include_zero: bool = False) -> DataFrame:
    """file_id, n: matches in the selected lines; lines where the selection is inverted."""
    if r.invert:
        return count_lines(corpus, r, include_zero)
    some = corpus if include_zero else _candidates(corpus, list(r.patterns))
    return _counted(selected(some, r), _sum_hits("lines"), include_zero)


def files_with(corpus: DataFrame, r: Request, without: bool = False) -> DataFrame:
    """Files with (or without) a selected line."""
    quick = not r.invert and all(p.pure is not None for p in r.patterns)
    if quick:
        test = reduce(lambda a, b: a | b, (F.contains("text", F.lit(p.pure)) for p in r.patterns))
        return corpus.filter(~test if without else test)
    if not without and not r.invert:
        corpus = _candidates(corpus, list(r.patterns))
    df = selected(corpus, replace(r, max_count=None, stop_on_nonmatch=False), False)
    test = F.exists("lines", lambda x: x["sel"])
    return df.filter(~test if without else test).drop("lines")


def stats(corpus: DataFrame, r: Request) -> DataFrame:
    """One row of totals."""
    df = selected(corpus, r, not r.invert).select(_count("lines").alias("n"), (_count("lines") if r.invert else _sum_hits("lines")).alias("m"), F.octet_length("text").cast("bigint").alias("b"))
    zero = F.lit(0).cast("bigint")
    return df.agg(F.coalesce(F.sum("m"), zero).alias("matches"), F.coalesce(F.sum("n"), zero).alias("matched_lines"), F.coalesce(F.sum((F.col("n") > 0).cast("bigint")), zero).alias("files_with_matches"), F.count(F.lit(1)).alias("files_searched"), F.coalesce(F.sum("b"), zero).alias("bytes_searched"))


# -- many patterns ---------------------------------------------------------------


def count_needles(corpus: DataFrame, needles: DataFrame, most: int = 4 << 20) -> DataFrame:
    """file_id, n: rows of ``needles`` (a column needle) that the text holds; files without one are left out.

    Equal needles are one with a count.  They are read in groups of at most ``most`` bytes; each group is broadcast
    as one automaton and is one pass over the texts, with no shuffle but that of the sums.
    """
    import pyarrow as pa

    spark = corpus.sparkSession
    rows = needles.filter("needle IS NOT NULL").groupBy("needle").agg(F.count(F.lit(1)).alias("n"))

    def groups():
        part, size = [], 0
        for r in rows.toLocalIterator():
            if part and size + len(r.needle) > most:
                yield part
                part, size = [], 0
            part.append((r.needle, r.n))
            size += len(r.needle.encode())
        if part:
            yield part

    def scanned(shared) -> DataFrame:
        def run(batches):
            import ahocorasick

            a, empty = ahocorasick.Automaton(), 0
            for k, (needle, n) in enumerate(shared.value):
                if needle:
                    a.add_word(needle, (k, n))
                else:
                    empty += n
            a.make_automaton()
            for b in batches:
                ids, out = [], []
                for i, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    total = empty + (sum(n for _, n in {x for _, x in a.iter(t)}) if len(a) and t else 0)
                    if total:
                        ids.append(i)
                        out.append(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], ["file_id", "n"])

        return corpus.select("file_id", "text").mapInArrow(run, "file_id long, n long")

    parts = [scanned(spark.sparkContext.broadcast(g)) for g in groups()]
    if not parts:
        return spark.createDataFrame([], "file_id long, n long")
    return reduce(DataFrame.unionByName, parts).groupBy("file_id").agg(F.sum("n").alias("n"))
