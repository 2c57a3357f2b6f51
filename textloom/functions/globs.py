"""File name patterns as Java regular expressions: globs, brace lists, ignore rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from textloom.functions.filetypes import TYPES


def expand_braces(glob: str) -> list[str]:
    """``a{b,c}d`` as ``abd``, ``acd``; the first closing brace ends a list."""
    a = glob.find("{")
    b = glob.find("}", a + 1)
    if a < 0 or b < 0:
        return [glob]
    tails = expand_braces(glob[b + 1 :])
    return [glob[:a] + x + t for x in glob[a + 1 : b].split(",") for t in tails]


def _quote(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):X}}}"


def _klass(body: str) -> str:
    neg = body[:1] in ("!", "^")
    items, out = body[1:] if neg else body, []
    i = 0
    while i < len(items):
        if i + 2 < len(items) and items[i + 1] == "-":
            if items[i] <= items[i + 2]:
                out.append(f"{_quote(items[i])}-{_quote(items[i + 2])}")
            i += 3
        else:
            out.append(_quote(items[i]))
            i += 1
    inner = "".join(out)
    if not inner:
        return "[^/]" if neg else r"(?!)"
    return f"(?!/)[{'^' if neg else ''}{inner}]"


def glob_regex(glob: str, icase: bool = False, slash_star: bool = False) -> str:
    """A whole-name expression.  ``*`` and ``?`` stop at slashes (unless ``slash_star``),
    ``**`` crosses them, ``**/`` is any number of directories."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
                continue
            if glob.startswith("**", i):
                out.append(".*")
                i += 2
                continue
            out.append(".*" if slash_star else "[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 1)
            if glob[i + 1 : i + 2] in ("!", "^") and end == i + 2 or end == i + 1:
                end = glob.find("]", end + 1)
            if end < 0:
                out.append(_quote(c))
            else:
                out.append(_klass(glob[i + 1 : end]))
                i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(_quote(glob[i]))
        else:
            out.append(_quote(c))
        i += 1
    return f"(?s{'iu' if icase else ''})^{''.join(out)}$"


def name_regex(globs: list[str], icase: bool = False) -> str:
    """Matches a path if some glob matches all of it or its last part."""
    parts = []
    for g in globs:
        body = glob_regex(g)[len("(?s)^") : -1]
        parts.append(body if g.startswith("**/") or "/" in g else f"(?:.*/)?{body}")
    return f"(?s{'iu' if icase else ''})^(?:{'|'.join(parts)})$" if parts else "(?!)"


def types_with(changes: list[str] = (), cleared: list[str] = ()) -> dict[str, list[str]]:
    """The type table after ``--type-clear`` and ``--type-add`` (``name:glob`` or ``name:include:a,b``)."""
    table = {k: list(v) for k, v in TYPES.items() if k not in cleared}
    for change in changes:
        name, sep, rule = change.partition(":")
        if not sep or not name or not rule:
            raise ValueError(f"bad type definition {change!r}")
        if rule.startswith("include:"):
            for other in rule[len("include:") :].split(","):
                if other not in table:
                    raise ValueError(f"unknown file type in include: {other}")
                table.setdefault(name, []).extend(list(table[other]))
        else:
            table.setdefault(name, []).extend(expand_braces(rule))
    return table


@dataclass(frozen=True)
class IgnoreRule:
    """``base``: directory (relative to the corpus root, '' for the root) that the rule's file lies in."""

    base: str
    glob: str
    negated: bool = False
    directory: bool = False
    icase: bool = False

    def regex(self) -> str:
        """Over paths below ``base``: whether the rule applies to the path or one of its parents."""
        anchored = self.glob.startswith("/")
        glob = self.glob.lstrip("/") if anchored else self.glob
        body = glob_regex(glob)[len("(?s)^") : -1]
        flags = "(?siu)" if self.icase else "(?s)"
        if self.directory:
            return f"{flags}^{body}/.*" if anchored or "/" in glob else f"{flags}^(?:.*/)?{body}/.*"
        if anchored or "/" in glob:
            return f"{flags}^{body}$"
        return f"{flags}^(?:.*/)?{body}(?:/.*)?$"


def parse_rules(text: str, base: str = "", icase: bool = False) -> list[IgnoreRule]:
    out = []
    for row in text.split("\n"):
        row = row.removesuffix("\r")
        if not row or row.startswith("#"):
            continue
        neg = row.startswith("!")
        row = row[1:] if neg else row
        directory = row.endswith("/")
        out.append(IgnoreRule(base, row[:-1] if directory else row, neg, directory, icase))
    return out


def size_bytes(text: str) -> int:
    """``10``, ``10K``, ``10M``, ``10G``."""
    m = re.fullmatch(r"(\d+)([KMG]?)", text)
    if not m:
        raise ValueError(f"bad size {text!r}")
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2]]
