"""Rows as they are shown: standard, vimgrep, only-matching, JSON events, sorted file lists."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import search
from textloom.operators.search import Request

OMITTED = "[Omitted long matching line]"


def trimmed(line: Column) -> Column:
    """Without leading spaces and tabs."""
    return F.regexp_replace(line, r"^[ \t]+", "")


def limited_width(line: Column, most: int, preview: bool = False) -> Column:
    """Lines of more than ``most`` bytes are left out, or cut with ``preview``."""
    long = F.octet_length(line) > most
    cut = F.make_valid_utf8(F.substring(line.cast("binary"), 1, most).cast("string")) if preview else F.lit("")
    shown = F.concat(cut, F.lit(" [... omitted end of long line]")) if preview else F.lit(OMITTED)
    return F.when(long, shown).otherwise(line)


def text_or_bytes(content: Column) -> Column:
    """``{"text": ...}``, or ``{"bytes": base64}`` where it isn't valid UTF-8."""
    text = content.cast("string")
    ok = F.is_valid_utf8(text)
    return F.when(ok, F.to_json(F.struct(text.alias("text")))).otherwise(F.to_json(F.struct(F.base64(content).alias("bytes"))))


def only_matching(corpus: DataFrame, r: Request) -> DataFrame:
    """file_id, line_no, column (1-based, bytes), offset, text: one row a match in a selected line.

    Matches over several lines belong to the line they begin in.
    """
    rows = _spans_by_line(corpus, r)
    return rows.select("file_id", F.col("x.no").alias("line_no"), (F.col("s.start") - F.col("x.begin") + 1).alias("column"), F.col("s.start").alias("offset"), F.col("s.hit").alias("text"))


def vimgrep(corpus: DataFrame, r: Request) -> DataFrame:
    """file_id, line_no, column, line: the line again for each match in it."""
    rows = _spans_by_line(corpus, r)
    return rows.select("file_id", F.col("x.no").alias("line_no"), (F.col("s.start") - F.col("x.begin") + 1).alias("column"), F.col("x.line").alias("line"))


def _spans_by_line(corpus: DataFrame, r: Request) -> DataFrame:
    some = search._candidates(corpus, list(r.patterns))
    df = search.selected(some, r, False)
    rec = [p for p in r.patterns if not search.whole_text(p) or p.pure is not None and r.separator not in p.pure]
    wide = [p for p in r.patterns if p not in rec]
    df = df.select("file_id", F.filter("lines", lambda x: x["sel"]).alias("lines"), *(search.span_array(F.col("text"), p).alias(f"_w{i}") for i, p in enumerate(wide)))
    rows = search.each(df, F.col("lines"), "file_id", *(f"_w{i}" for i in range(len(wide))))
    x = F.col("x")
    spans = [search.span_array(x["line"], p, base=x["begin"]) for p in rec] + [F.filter(f"_w{i}", lambda s: (s["start"] >= x["begin"]) & (s["start"] < x["term_end"])) for i in range(len(wide))]
    return search.each(rows, F.sort_array(F.array_distinct(F.concat(*spans))), "file_id", "x", name="s")


@dataclass(frozen=True)
class Style:
    """How rows are put together.  ``colours``: kind (path, line, column, match) to the codes that are switched on."""

    match_separator: str = ":"
    context_separator: str = "-"
    gap: str | None = "--"
    colours: tuple[tuple[str, str], ...] = ()

    def paint(self, kind: str, c: Column) -> Column:
        codes = dict(self.colours).get(kind)
        return F.concat(F.lit(f"\x1b[0m\x1b[{codes}m"), c, F.lit("\x1b[0m")) if codes else c

    def matches(self, line: Column, patterns) -> Column:
        """``line`` with its matches painted; of several patterns all in one pass, the first that fits at a place."""
        codes = dict(self.colours).get("match")
        if not codes:
            return line
        java = "|".join(f"(?:{p.java})" for p in patterns)
        return F.regexp_replace(line, F.lit(java), F.lit(f"\x1b[0m\x1b[{codes}m$0\x1b[0m"))


DEFAULT_COLOURS = {"path": "35", "line": "32", "match": "1;31"}
_COLOUR = {n: i for i, n in enumerate(("black", "red", "green", "yellow", "blue", "magenta", "cyan", "white"))}
_STYLE = {"bold": "1", "nobold": "22", "intense": "1", "nointense": "22", "underline": "4", "nounderline": "24", "italic": "3", "noitalic": "23"}


def colours(specs: list[str]) -> tuple[tuple[str, str], ...]:
    """Of ``kind:none``, ``kind:fg:red``, ``kind:bg:12``, ``kind:fg:0x10,20,30`` and ``kind:style:bold``, over the defaults."""
    table: dict[str, list[str]] = {k: v.split(";") for k, v in DEFAULT_COLOURS.items()}
    for spec in specs:
        kind, _, rest = spec.partition(":")
        what, _, value = rest.partition(":")
        if kind not in ("path", "line", "column", "match") or what not in ("none", "fg", "bg", "style") or (what == "none") == bool(value):
            raise ValueError(f"bad colour {spec!r}")
        if what == "none":
            table[kind] = []
        elif what == "style":
            if value not in _STYLE:
                raise ValueError(f"bad style {spec!r}")
            table.setdefault(kind, []).append(_STYLE[value])
        else:
            base = 30 if what == "fg" else 40
            parts = value.split(",")
            try:
                numbers = [int(x, 0) for x in parts]
            except ValueError:
                numbers = []
            if value in _COLOUR:
                code = str(base + _COLOUR[value])
            elif len(numbers) in (1, 3) and all(0 <= x <= 255 for x in numbers):
                code = f"{base + 8};{'5' if len(numbers) == 1 else '2'};{';'.join(map(str, numbers))}"
            else:
                raise ValueError(f"bad colour {spec!r}")
            table[kind] = [c for c in table.get(kind, []) if not c.startswith(("3" if what == "fg" else "4"))] + [code]
    return tuple((k, ";".join(v)) for k, v in table.items() if v)


def standard(corpus: DataFrame, r: Request, number: bool = True, trim: bool = False, max_columns: int | None = None, preview: bool = False, replace: str | None = None, style: Style = Style(), prefix: Column | None = None, column: bool = False, offset: bool = False) -> DataFrame:
    """file_id, line_no, shown: ``:`` after numbers of selected lines, ``-`` of context, ``--`` before gaps.

    ``prefix`` (over the corpus' columns) goes first in each line, ``column`` and ``offset`` (of the first match) after the number.
    """
    name = (prefix if prefix is not None else F.lit(None).cast("string")).alias("_name")
    names = corpus.select("file_id", name)
    rows = search.context_lines(corpus, r)
    if prefix is not None:
        rows = rows.join(names, "file_id")
    line, bare = F.col("line"), F.col("line")
    if replace:
        line = F.when(F.col("matched"), search.replaced(line, r.patterns[0], replace)).otherwise(line)
    if trim:
        line = trimmed(line)
    if max_columns:
        line = limited_width(line, max_columns, preview)
    line = F.when(F.col("matched"), style.matches(line, r.patterns)).otherwise(line) if style.colours and not replace else line
    sep = F.when(F.col("matched"), style.match_separator).otherwise(style.context_separator)
    parts = [F.col("_name"), sep] if prefix is not None else []
    if number:
        parts += [style.paint("line", F.col("line_no").cast("string")), sep]
    if column:
        first = search.span_array(bare, r.patterns[0])
        at = F.when(F.col("matched") & (F.size(first) > 0), F.concat(style.paint("column", (F.get(first, F.lit(0))["start"] + 1).cast("string")), sep)).otherwise(F.lit(""))
        parts.append(at)
    if offset:
        parts += [F.col("begin").cast("string"), sep]
    body = F.concat(*parts, line)
    shown = body if style.gap is None else F.when(F.col("gap"), F.concat(F.lit(style.gap + "\n"), body)).otherwise(body)
    return rows.select("file_id", "line_no", shown.alias("shown"))


def json_events(corpus: DataFrame, r: Request) -> DataFrame:
    """file_id, part, line_no, event: begin, match (with submatches) and end of each file with matches; order by the first three."""
    some = search._candidates(corpus, list(r.patterns)) if not r.invert else corpus
    df = search.selected(some, r).withColumn("lines", F.filter("lines", lambda x: x["sel"]))
    path = F.struct(F.col("path").alias("text"))
    rec = [p for p in r.patterns if not search.whole_text(p) or p.pure is not None]

    def sub(x: Column) -> Column:
        found = F.sort_array(F.array_distinct(F.concat(*(search.span_array(x["line"], p) for p in rec)))) if rec and not r.invert else F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
        return F.transform(found, lambda s: F.struct(F.struct(s["hit"].alias("text")).alias("match"), s["start"].alias("start"), s["end"].alias("end")))

    def match(x: Column) -> Column:
        data = F.struct(path.alias("path"), F.struct(x["line"].alias("text")).alias("lines"), x["no"].alias("line_number"), x["begin"].alias("absolute_offset"), sub(x).alias("submatches"))
        return F.struct(F.lit(1).alias("part"), x["no"].alias("line_no"), F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data"))).alias("event"))

    def edge(kind: str, part: int, data: Column) -> Column:
        return F.array(F.struct(F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("line_no"), F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data"))).alias("event")))

    totals = F.struct(F.size("lines").alias("matched_lines"), search._sum_hits("lines").alias("matches"), F.octet_length("text").alias("bytes_searched"))
    events = F.concat(edge("begin", 0, F.struct(path.alias("path"))), F.transform("lines", match), edge("end", 2, F.struct(path.alias("path"), totals.alias("stats"))))
    return search.each(df, F.when(F.size("lines") > 0, events), "file_id", name="e").select("file_id", "e.part", "e.line_no", "e.event")


def sorted_files(files: DataFrame, by: str = "path", descending: bool = False) -> DataFrame:
    """By path, or by modified (mtime_ns)."""
    names = {"path": "path", "modified": "mtime_ns", "accessed": "atime_ns", "created": "ctime_ns"}
    if by not in names or names[by] not in files.columns:
        raise ValueError(f"can't sort by {by}")
    c = F.col(names[by])
    return files.orderBy(c.desc() if descending else c.asc(), "path")


LINKS = {"default": "file://{host}{path}", "file": "file://{host}{path}", "vscode": "vscode://file{path}:{line}:{column}"}


def hyperlink(path: Column, label: Column, form: str = "file", host: str = "") -> Column:
    """A terminal link by a named format or one with {path}, {host}, {line} and {column}; lines and columns are 1."""
    form = LINKS.get(form, form)
    if "{path}" not in form or set(re.findall(r"\{(\w*)\}", form)) - {"path", "host", "line", "column", "wslprefix"}:
        raise ValueError(f"bad link format {form!r}")
    before, after = (x.replace("{host}", host).replace("{wslprefix}", "").replace("{line}", "1").replace("{column}", "1") for x in form.split("{path}", 1))
    return F.concat(F.lit("\x1b]8;;" + before), F.replace(path, F.lit(" "), F.lit("%20")), F.lit(after + "\x1b\\"), label, F.lit("\x1b]8;;\x1b\\"))


def coloured(c: Column, code: int = 31) -> Column:
    return F.concat(F.lit(f"\x1b[{code}m"), c, F.lit("\x1b[0m"))
