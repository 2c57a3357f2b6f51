"""Corpora made from a seed, the same on every machine."""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_MASK = 2**64 - 1


class Lcg:
    """A 64-bit linear congruential generator."""

    def __init__(self, seed: int):
        self.state = seed & _MASK or 1

    def next(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) & _MASK
        return self.state

    def between(self, low: int, high: int) -> int:
        return low if low >= high else low + self.next() % (high - low + 1)

    def unit(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def pick(self, items):
        return items[self.between(0, len(items) - 1)]


class Category(enum.Enum):
    CODE = "code"
    LOGS = "logs"
    MINIFIED = "minified"
    UNICODE = "unicode"
    BINARY = "binary"
    LARGE = "large"
    DUPLICATES = "duplicates"


class Sizes(enum.Enum):
    UNIFORM = "uniform"
    SMALL = "small"
    LARGE = "large"
    BIMODAL = "bimodal"
    LONG_TAIL = "long-tail"


@dataclass(frozen=True)
class CorpusSpec:
    category: Category = Category.CODE
    sizes: Sizes = Sizes.UNIFORM
    files: int = 16
    least: int = 512
    most: int = 8192
    seed: int = 1


_NAMES = ("alpha", "buffer", "cache", "delta", "engine", "filter", "gauge", "handle", "index", "join", "kernel", "layout", "merge", "node", "offset", "parser")
_FOREIGN = ("naïve", "straße", "Σίσυφος", "привет", "世界", "こんにちは", "🌍", "crème", "mañana", "שלום")
_LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def _size(r: Lcg, s: CorpusSpec) -> int:
    if s.sizes is Sizes.SMALL:
        return r.between(s.least, s.least + (s.most - s.least) // 8)
    if s.sizes is Sizes.LARGE:
        return r.between(s.most - (s.most - s.least) // 8, s.most)
    if s.sizes is Sizes.BIMODAL:
        return s.least if r.unit() < 0.5 else s.most
    if s.sizes is Sizes.LONG_TAIL:
        return int(s.least + (s.most - s.least) * r.unit() ** 4)
    return r.between(s.least, s.most)


def _line(r: Lcg, c: Category, n: int) -> str:
    if c is Category.LOGS:
        return f"2024-01-{1 + n % 28:02d} {r.pick(_LEVELS)} [{r.pick(_NAMES)}-{r.between(1, 9)}] id={r.between(1000, 999999)} took {r.between(1, 900)} ms\n"
    if c is Category.MINIFIED:
        return f"function {r.pick(_NAMES)[0]}{r.between(0, 999)}(a,b){{return a+b*{r.between(0, 99)}}};"
    if c is Category.UNICODE:
        return " ".join(r.pick(_FOREIGN) for _ in range(8)) + "\n"
    return f"    {r.pick(_NAMES)}_{r.pick(_NAMES)} = {r.pick(_NAMES)}({r.between(0, 9999)})\n"


def documents(s: CorpusSpec) -> list[tuple[str, bytes]]:
    r, out = Lcg(s.seed), []
    end = {Category.LOGS: "log", Category.MINIFIED: "js", Category.UNICODE: "txt", Category.BINARY: "bin"}.get(s.category, "py")
    for i in range(s.files):
        size = _size(r, s) * (8 if s.category is Category.LARGE else 1)
        if s.category is Category.DUPLICATES and i % 4:
            data = out[i - i % 4][1]
        elif s.category is Category.BINARY:
            data = bytes(r.next() >> 56 for _ in range(size))
        else:
            parts, n = [], 0
            while n < size:
                parts.append(_line(r, s.category, len(parts)).encode())
                n += len(parts[-1])
            data = b"".join(parts)
        out.append((f"{s.category.value}/{i:05d}.{end}", data))
    return out


def corpus(spark: SparkSession, s: CorpusSpec) -> DataFrame:
    from textloom.sources.corpus import from_documents

    return from_documents(spark, documents(s))
