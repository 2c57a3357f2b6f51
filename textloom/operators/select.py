"""Which files of a corpus are searched."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.globs import IgnoreRule, name_regex, types_with

#: A file is binary if a NUL is among its first bytes.
BINARY_HEAD = 8192


@dataclass(frozen=True)
class Selection:
    selectors: tuple[tuple[str, bool], ...] = ((".", True),)  # (path, is a directory)
    hidden: bool = False
    globs: tuple[str, ...] = ()
    iglobs: tuple[str, ...] = ()
    globs_icase: bool = False
    types: tuple[str, ...] = ()
    types_not: tuple[str, ...] = ()
    type_add: tuple[str, ...] = ()
    type_clear: tuple[str, ...] = ()
    rules: tuple[IgnoreRule, ...] = field(default=())
    max_depth: int | None = None
    max_size: int | None = None
    binary: bool = True


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, BINARY_HEAD), F.lit(b"\0"))


def is_hidden(path: Column) -> Column:
    """Some part of the path is longer than one character and begins with a dot."""
    return path.rlike(r"(?:^|/)\.[^/]")


def glob_filter(path: Column, globs: tuple[str, ...], icase: bool) -> Column | None:
    """Negated globs reject; if there are others, one must match."""
    bad = [g[1:] for g in globs if g.startswith("!")]
    good = [g for g in globs if not g.startswith("!")]
    test = None
    if bad:
        test = ~path.rlike(name_regex(bad, icase))
    if good:
        hit = path.rlike(name_regex(good, icase))
        test = hit if test is None else test & hit
    return test


def type_filter(path: Column, s: Selection) -> Column | None:
    table = types_with(list(s.type_add), list(s.type_clear))
    every = [g for gs in table.values() for g in gs]

    def of(names: tuple[str, ...]) -> Column:
        globs = [g for n in names for g in (every if n == "all" else table.get(n, []))]
        return path.rlike(name_regex(sorted(set(globs))))

    test = of(s.types) if s.types else None
    if s.types_not:
        no = ~of(s.types_not)
        test = no if test is None else test & no
    return test


def is_ignored(path: Column, rules: tuple[IgnoreRule, ...]) -> Column:
    """The last rule that applies decides; later rules come first in the chain."""
    out = F.lit(False)
    for r in rules:
        if r.base:
            applies = path.startswith(r.base + "/") & F.substring(path, F.lit(len(r.base) + 2), F.length(path)).rlike(r.regex())
        else:
            applies = path.rlike(r.regex())
        out = F.when(applies, F.lit(not r.negated)).otherwise(out)
    return out


def _under(path: Column, selector: str) -> Column:
    return F.lit(True) if selector == "." else (path == selector) | path.startswith(selector + "/")


def allowed(path: Column, size: Column | None, s: Selection) -> Column:
    """The whole test as one predicate, so that it sinks into the scan."""
    chosen = reduce(lambda a, b: a | b, (_under(path, p) if d else path == p for p, d in s.selectors))
    tests = []
    if s.max_depth is not None:
        depths = [_under(path, p) & (F.size(F.split(path, "/")) - (0 if p == "." else p.count("/") + 1) <= s.max_depth) for p, d in s.selectors if d]
        tests.append(reduce(lambda a, b: a | b, depths, F.lit(False)))
    if not s.hidden:
        tests.append(~is_hidden(path))
    if s.rules:
        tests.append(~is_ignored(path, s.rules))
    tests += [t for t in (glob_filter(path, s.globs, s.globs_icase), glob_filter(path, s.iglobs, True), type_filter(path, s)) if t is not None]
    inner = reduce(lambda a, b: a & b, tests, F.lit(True))
    named = [p for p, d in s.selectors if not d]
    if named:
        inner = path.isin(named) | inner
    out = chosen & inner
    if s.max_size is not None and size is not None:
        out = out & (size <= s.max_size)
    return out


def choose(corpus: DataFrame, s: Selection) -> DataFrame:
    size = F.col("size") if "size" in corpus.columns else None
    out = corpus.filter(allowed(F.col("path"), size, s))
    if not s.binary:
        out = out.filter(~F.col("binary") if "binary" in corpus.columns else ~is_binary(F.col("text").cast("binary")))
    return out


def scoped(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """Files whose file_id is in ``ids``; Spark broadcasts ``ids`` where it is small."""
    return corpus.join(ids.select("file_id").distinct(), "file_id", "left_semi")
