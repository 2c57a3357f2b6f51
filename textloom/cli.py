"""Command line: search a directory (or a table) and print what was asked for.

    python -m textloom.cli [flags] PATTERN [PATH...]

Printing goes file by file in path order through ``toLocalIterator``; nothing is
collected at once.  Exit code 0: a match, 1: none, 2: an error.
"""

from __future__ import annotations

import os
import re
import shlex
import sys
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.filetypes import TYPES
from textloom.functions.globs import IgnoreRule, parse_rules, size_bytes
from textloom.operators import output, search
from textloom.operators.search import Request
from textloom.operators.select import Selection, choose
from textloom.plans.pattern import Case, Engine, PatternError, PatternOptions, compile_pattern
from textloom.sources import corpus as store

VERSION = "0.1"
CONFIG_VARIABLE = "TEXTLOOM_CONFIG_PATH"


class UsageError(ValueError):
    pass


#: Flags with a value; short names first.
VALUED = {
    "after-context": "A", "before-context": "B", "context": "C", "color": "", "colors": "", "context-separator": "", "dfa-size-limit": "", "encoding": "E", "engine": "", "field-context-separator": "",
    "field-match-separator": "", "file": "f", "generate": "", "glob": "g", "hostname-bin": "", "hyperlink-format": "", "iglob": "", "ignore-file": "", "max-columns": "M", "max-count": "m", "max-depth": "d",
    "max-filesize": "", "path-separator": "", "pre": "", "pre-glob": "", "regex-size-limit": "", "regexp": "e", "replace": "r", "sort": "", "sortr": "", "threads": "j", "type": "t", "type-add": "", "type-clear": "", "type-not": "T",
}
#: Flags without one.
PLAIN = {
    "auto-hybrid-regex": "", "binary": "", "block-buffered": "", "byte-offset": "b", "case-sensitive": "s", "column": "", "count": "c", "count-matches": "", "crlf": "", "debug": "", "files": "", "files-with-matches": "l",
    "files-without-match": "", "fixed-strings": "F", "follow": "L", "glob-case-insensitive": "", "heading": "", "help": "h", "hidden": ".", "ignore-case": "i", "ignore-file-case-insensitive": "", "include-zero": "", "invert-match": "v",
    "json": "", "line-buffered": "", "line-number": "n", "no-line-number": "N", "line-regexp": "x", "max-columns-preview": "", "mmap": "", "multiline": "U", "multiline-dotall": "", "no-config": "", "no-filename": "I", "with-filename": "H",
    "no-ignore": "", "no-ignore-dot": "", "no-ignore-exclude": "", "no-ignore-files": "", "no-ignore-global": "", "no-ignore-parent": "", "no-ignore-vcs": "", "no-messages": "", "no-pcre2-unicode": "", "no-require-git": "", "no-unicode": "",
    "null": "0", "null-data": "", "one-file-system": "", "only-matching": "o", "passthru": "", "pcre2": "P", "pcre2-version": "", "pretty": "p", "quiet": "q", "search-zip": "z", "smart-case": "S", "sort-files": "", "stats": "",
    "stop-on-nonmatch": "", "text": "a", "trace": "", "trim": "", "type-list": "", "unicode": "", "unrestricted": "u", "version": "V", "vimgrep": "", "word-regexp": "w", "ignore-messages": "", "messages": "", "no-heading": "", "no-context-separator": "",
}
_SHORT = {s: k for t in (VALUED, PLAIN) for k, s in t.items() if s}
#: A flag takes back another.
_PAIRS = (("with-filename", "no-filename"), ("no-filename", "with-filename"), ("heading", "no-heading"), ("no-heading", "heading"), ("line-number", "no-line-number"), ("no-line-number", "line-number"), ("no-context-separator", "context-separator"))
_MODES = ("count", "count-matches", "files-with-matches", "files-without-match", "files", "json", "vimgrep")


@dataclass
class Arguments:
    patterns: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    values: dict[str, list[str]] = field(default_factory=dict)
    on: dict[str, int] = field(default_factory=dict)
    mode: str = ""
    case: Case = Case.SENSITIVE
    bounds: str = ""

    def last(self, name: str, default: str | None = None) -> str | None:
        return self.values.get(name, [default])[-1]

    def number(self, name: str) -> int | None:
        v = self.last(name)
        if v is not None and not v.isdigit():
            raise UsageError(f"--{name} needs a number")
        return None if v is None else int(v)


def parse(argv: list[str]) -> Arguments:
    """Flags and operands; later flags win over earlier ones of the same group."""
    config = os.environ.get(CONFIG_VARIABLE)
    if config and "--no-config" not in argv:
        with open(config) as f:
            argv = [row.strip() for row in f if row.strip() and not row.startswith("#")] + argv
    a, rest, i = Arguments(), [], 0

    def take(name: str, value: str | None) -> None:
        if value is not None:
            a.values.setdefault(name, []).append(value)
            if name == "context-separator":
                a.on.pop("no-context-separator", None)
            return
        a.on[name] = a.on.get(name, 0) + 1
        if name in _MODES and not (a.mode == "files" and name != "files"):
            a.mode = name
        a.case = {"ignore-case": Case.INSENSITIVE, "case-sensitive": Case.SENSITIVE, "smart-case": Case.SMART}.get(name, a.case)
        a.bounds = {"word-regexp": "word", "line-regexp": "line"}.get(name, a.bounds)
        for one, other in _PAIRS:
            if name == one:
                a.on.pop(other, None)
                a.values.pop(other, None)
        if name == "pretty":
            a.on |= {"heading": 1, "line-number": 1}
            a.values.setdefault("color", []).append("always")
        if name == "sort-files":
            a.values.setdefault("sort", []).append("path")
        if name == "null-data":
            a.on.pop("crlf", None)
        if name == "crlf":
            a.on.pop("null-data", None)

    while i < len(argv):
        x = argv[i]
        i += 1
        if x == "--":
            rest += argv[i:]
            break
        if x.startswith("--"):
            name, eq, value = x[2:].partition("=")
            if name in VALUED:
                if not eq:
                    if i >= len(argv):
                        raise UsageError(f"--{name} needs a value")
                    value, i = argv[i], i + 1
                take(name, value)
            elif name in PLAIN and not eq:
                take(name, None)
            elif name.startswith("no-") and name[3:] in VALUED | PLAIN:
                a.on.pop(name[3:], None)
                a.values.pop(name[3:], None)
            else:
                raise UsageError(f"unknown flag --{name}")
        elif x.startswith("-") and len(x) > 1:
            body = x[1:]
            while body:
                name = _SHORT.get(body[0])
                if name is None:
                    raise UsageError(f"unknown flag -{body[0]}")
                body = body[1:]
                if name in VALUED:
                    if not body:
                        if i >= len(argv):
                            raise UsageError(f"-{VALUED[name]} needs a value")
                        body, i = argv[i], i + 1
                    take(name, body.removeprefix("="))
                    break
                take(name, None)
        else:
            rest.append(x)
    a.patterns = list(a.values.get("regexp", []))
    for name in a.values.get("file", []):
        with sys.stdin if name == "-" else open(name) as f:
            a.patterns += f.read().removesuffix("\n").split("\n")
    if not a.patterns and not {"files", "type-list", "version", "help", "pcre2-version"} & a.on.keys():
        if not rest:
            raise UsageError("a pattern is needed")
        a.patterns, rest = [rest[0]], rest[1:]
    a.paths = rest or ["."]
    if "json" in a.on and {"count", "count-matches", "files-with-matches", "files-without-match"} & a.on.keys():
        raise UsageError("--json goes with no counting or listing")
    return a


def pattern_options(a: Arguments) -> PatternOptions:
    on, engine = a.on, a.last("engine", "default")
    if engine not in ("default", "pcre2", "auto"):
        raise UsageError(f"unknown engine {engine}")
    how = Engine.EXTENDED if "pcre2" in on or engine == "pcre2" else Engine.AUTO if "auto-hybrid-regex" in on or engine == "auto" else Engine.DEFAULT
    unicode = "no-unicode" not in on and "no-pcre2-unicode" not in on
    return PatternOptions("fixed-strings" in on, a.case, how, a.bounds == "word", a.bounds == "line", "multiline" in on, "multiline-dotall" in on, unicode, "crlf" in on, "\0" if "null-data" in on else "\n")


def request(a: Arguments) -> Request:
    o = pattern_options(a)
    both = a.number("context") or 0
    count = a.number("max-count")
    limit = lambda name: a.number(name) if a.number(name) is not None else both
    return Request(tuple(compile_pattern(p, o) for p in a.patterns) if count != 0 else (), "invert-match" in a.on, count, "stop-on-nonmatch" in a.on, limit("before-context"), limit("after-context"), "passthru" in a.on, o.separator, o.crlf)


def common_root(paths: list[str]) -> tuple[str, tuple[tuple[str, bool], ...]]:
    """The longest common directory, and each path relative to it."""
    full = [os.path.realpath(p) for p in paths]
    for p, raw in zip(full, paths, strict=True):
        if not os.path.exists(p):
            raise UsageError(f"path does not exist: {raw}")
    root = os.path.commonpath([p if os.path.isdir(p) else os.path.dirname(p) for p in full])
    return root, tuple((os.path.relpath(p, root).replace(os.sep, "/"), os.path.isdir(p)) for p in full)


def ignore_rules(root: str, a: Arguments) -> tuple[IgnoreRule, ...]:
    """In rising precedence: named files, the user's, the repository's, then those found, outer before inner."""
    on, rules = a.on, []
    if "no-ignore" in on or on.get("unrestricted", 0) >= 1:
        return ()

    def read(path: str, base: str, icase: bool = False) -> None:
        if os.path.isfile(path):
            with open(path, errors="replace") as f:
                rules.extend(parse_rules(f.read(), base, icase))

    top = root
    while not os.path.exists(os.path.join(top, ".git")) and os.path.dirname(top) != top:
        top = os.path.dirname(top)
    git = os.path.exists(os.path.join(top, ".git"))
    vcs = (git or "no-require-git" in on) and "no-ignore-vcs" not in on
    if "no-ignore-files" not in on:
        for p in a.values.get("ignore-file", []):
            read(p, "", "ignore-file-case-insensitive" in on)
    if vcs and "no-ignore-global" not in on:
        read(os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git/ignore"), "")
    if git and top == root and "no-ignore-exclude" not in on:
        read(os.path.join(top, ".git/info/exclude"), "")
    names = ([".gitignore"] if vcs else []) + ([".ignore", ".rgignore"] if "no-ignore-dot" not in on else [])
    if "no-ignore-parent" not in on:
        up, at = [], os.path.dirname(root)
        while True:
            up.insert(0, at)
            if os.path.dirname(at) == at:
                break
            at = os.path.dirname(at)
        for d in up:
            for n in names:
                read(os.path.join(d, n), "")
    for at, dirs, files in sorted(os.walk(root), key=lambda x: (x[0].count(os.sep), x[0])):
        dirs.sort()
        rel = os.path.relpath(at, root).replace(os.sep, "/")
        for n in names:
            if n in files:
                read(os.path.join(at, n), "" if rel == "." else rel)
    return tuple(rules)


def selection(root: str, selectors: tuple[tuple[str, bool], ...], a: Arguments) -> Selection:
    free, size = a.on.get("unrestricted", 0), a.last("max-filesize")
    return Selection(selectors, "hidden" in a.on or free >= 2, tuple(a.values.get("glob", [])), tuple(a.values.get("iglob", [])), "glob-case-insensitive" in a.on, tuple(a.values.get("type", [])), tuple(a.values.get("type-not", [])), tuple(a.values.get("type-add", [])), tuple(a.values.get("type-clear", [])), ignore_rules(root, a), a.number("max-depth"), size_bytes(size) if size else None)


def unescaped(text: str) -> str:
    """Separators may hold \\n, \\t, \\r, \\0, \\\\ and \\xNN."""
    plain = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\"}
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|[ntr0\\])", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "x" else plain[m[1]], text)


def style(a: Arguments) -> output.Style:
    when = a.last("color", "auto")
    if when not in ("auto", "always", "ansi", "never"):
        raise UsageError(f"--color can't be {when}")
    # what is written is a stream of rows, so auto is never
    painted = output.colours(a.values.get("colors", [])) if when in ("always", "ansi") else ()
    output.colours(a.values.get("colors", []))  # bad ones are errors anyway
    gap = None if "no-context-separator" in a.on else unescaped(a.last("context-separator", "--"))
    return output.Style(unescaped(a.last("field-match-separator", ":")), unescaped(a.last("field-context-separator", "-")), gap, painted)


def corpus(spark: SparkSession, a: Arguments) -> tuple[DataFrame, DataFrame | None]:
    """What is searched, and binary files that only say whether they match (``--binary``)."""
    root, selectors = common_root(a.paths)
    pre = a.last("pre")
    if pre:
        shlex.split(pre)
    found = store.scan(spark, root, True, "follow" in a.on, pre, "search-zip" in a.on, a.last("encoding") or "auto", tuple(a.values.get("pre-glob", [])), "one-file-system" in a.on)
    chosen = choose(found, selection(root, selectors, a))
    if (a.last("sort") or a.last("sortr")) in ("accessed", "created"):
        chosen = store.with_times(chosen, root)
    if "text" in a.on:
        return chosen, None
    told = "binary" in a.on or a.on.get("unrestricted", 0) >= 3
    if told and a.mode in ("", "vimgrep"):
        return chosen.filter(~F.col("binary")), chosen.filter("binary")
    return (chosen if told else chosen.filter(~F.col("binary"))), None


def _binary_rows(c: DataFrame, r: Request, name: Column | None) -> DataFrame:
    """A line for each binary file that matches."""
    hit = search.files_with(c, r).select("path", "content", *([name.alias("_n")] if name is not None else []))
    pairs = F.split(F.regexp_replace(F.hex("content"), "(..)", "$1 "), " ")
    at = F.array_position(pairs, "00") - 1
    text = F.concat(F.lit('binary file matches (found "\\0" byte around offset '), at.cast("string"), F.lit(")"))
    return hit.select("path", F.lit(-1).cast("bigint").alias("order"), (F.concat(F.col("_n"), F.lit(": "), text) if name is not None else text).alias("row"))


def shown(c: DataFrame, r: Request, a: Arguments, heading: bool = False) -> DataFrame:
    """path, order, row: what is printed, in the order of the first two."""
    on, look = a.on, style(a)
    path = F.replace("path", F.lit("/"), F.lit(a.last("path-separator"))) if a.last("path-separator") else F.col("path")
    path = look.paint("path", path)
    link = a.last("hyperlink-format", "none")
    if link != "none":
        linked = output.hyperlink(F.concat(F.lit(common_root(a.paths)[0] + "/"), F.col("path")), path, link)
        path = linked if look.colours else path  # links go with colours
    sep = "\0" if "null" in on else look.match_separator
    bare = "no-filename" in on or heading
    names = c.select("file_id", "path")
    prefix = F.lit("") if bare else F.concat(path, F.lit(sep))
    at = lambda df, order, row: df.join(names, "file_id").select("path", order.alias("order"), F.concat(prefix, row).alias("row"))
    zero = F.lit(0).cast("bigint")
    if a.mode in ("files-with-matches", "files-without-match"):
        return search.files_with(c, r, a.mode == "files-without-match").select("path", zero.alias("order"), path.alias("row"))
    if a.mode in ("count", "count-matches"):
        count = search.count_matches if a.mode == "count-matches" or "only-matching" in on else search.count_lines
        return at(count(c, r, "include-zero" in on), zero, F.col("n").cast("string"))
    if a.mode == "json":
        return output.json_events(c, r).join(names, "file_id").select("path", (F.col("part") * (1 << 40) + F.col("line_no")).alias("order"), F.col("event").alias("row"))
    if "only-matching" in on or a.mode == "vimgrep":
        df = output.vimgrep(c, r) if a.mode == "vimgrep" else output.only_matching(c, r)
        body = F.col("line") if a.mode == "vimgrep" else search.replaced(F.col("text"), r.patterns[0], a.last("replace")) if a.last("replace") else F.col("text")
        body = look.matches(body, r.patterns) if a.mode == "vimgrep" else look.paint("match", body)
        parts = []
        if a.mode == "vimgrep" or "line-number" in on or "column" in on:
            parts.append(look.paint("line", F.col("line_no").cast("string")))
        if a.mode == "vimgrep" or "column" in on:
            parts.append(look.paint("column", F.col("column").cast("string")))
        if "byte-offset" in on and a.mode != "vimgrep":
            parts.append(F.col("offset").cast("string"))
        return at(df, F.col("line_no") * (1 << 20) + F.col("column"), F.concat_ws(look.match_separator, *parts, body))
    number = ("line-number" in on or "column" in on) and "no-line-number" not in on
    if "null" in on and not bare:
        df = output.standard(c, r, number, "trim" in on, a.number("max-columns"), "max-columns-preview" in on, a.last("replace"), look, None, "column" in on, "byte-offset" in on)
        return at(df, F.col("line_no"), F.col("shown"))
    df = output.standard(c, r, number, "trim" in on, a.number("max-columns"), "max-columns-preview" in on, a.last("replace"), look, None if bare else path, "column" in on, "byte-offset" in on)
    return df.join(names, "file_id").select("path", F.col("line_no").alias("order"), F.col("shown").alias("row"))


_TIMES = {"modified": "mtime_ns", "accessed": "atime_ns", "created": "ctime_ns"}


def run(spark: SparkSession, argv: list[str], out=None) -> int:
    out = out or sys.stdout
    printed = 0

    def say(row: str) -> None:
        nonlocal printed
        printed += len(row.encode("utf-8", "replace")) + 1
        print(row, file=out)

    try:
        a = parse(argv)
        if "version" in a.on or "help" in a.on or "pcre2-version" in a.on:
            print(f"textloom {VERSION}" if "help" not in a.on else __doc__, file=out)
            return 0
        if "type-list" in a.on:
            for name in sorted(TYPES):
                print(f"{name}: {', '.join(TYPES[name])}", file=out)
            return 0
        look, by = style(a), a.last("sort") or a.last("sortr") or "path"
        if by not in ("path", "none", *_TIMES):
            raise UsageError(f"can't sort by {by}")
        c, quiet_ones = corpus(spark, a)
        if a.mode == "files":
            rows = output.sorted_files(c.select("path", *([_TIMES[by]] if by in _TIMES else [])), "path" if by == "none" else by, bool(a.last("sortr")))
            n = 0
            for r in rows.toLocalIterator():
                say(r.path)
                n += 1
            return 0 if n else 1
        r = request(a)
        if not r.patterns:
            return 1
        if "quiet" in a.on:
            every = c if quiet_ones is None else c.unionByName(quiet_ones)
            return 1 if search.files_with(every, r, a.mode == "files-without-match").limit(1).isEmpty() else 0
        heading = "heading" in a.on and "no-filename" not in a.on and a.mode == ""
        rows = shown(c, r, a, heading)
        if quiet_ones is not None:
            rows = rows.unionByName(_binary_rows(quiet_ones, r, None if heading or "no-filename" in a.on else F.col("path")))
        order = F.col("path")
        if by in _TIMES:
            every = c if quiet_ones is None else c.unionByName(quiet_ones)
            rows, order = rows.join(every.select("path", _TIMES[by]), "path"), F.col(_TIMES[by])
        n, last = 0, None
        for x in rows.orderBy(order.desc() if a.last("sortr") else order, "path", "order").toLocalIterator():
            if heading and x.path != last:
                if last is not None:
                    say("")
                say(spark.range(1).select(look.paint("path", F.lit(x.path))).first()[0] if look.colours else x.path)
                last = x.path
            say(x.row)
            n += 1
        if "stats" in a.on:
            for k, v in (search.stats(c, r).first().asDict() | {"bytes_printed": printed}).items():
                print(f"{v} {k.replace('_', ' ')}", file=out)
        return 0 if n else 1
    except (UsageError, PatternError, ValueError, OSError) as e:
        print(f"textloom: {e}", file=sys.stderr)
        return 2


def main() -> int:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
