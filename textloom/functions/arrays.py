"""Array helpers that stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, by way of an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column) -> Column:
    """Sums of the elements before each element and, last, of all: n + 1 long.

    Blocks of ``BLOCK`` keep the cost linear for arrays of any length.
    """
    return _scanned(values, lambda s, v: s + v)


def running_max(values: Column) -> Column:
    """Like ``running`` for the largest of zero and the elements."""
    return _scanned(values, lambda s, v: F.greatest(s, v))


def _scanned(values: Column, op) -> Column:
    zero = F.lit(0).cast("bigint")
    nothing = F.slice(F.array(zero), 1, 0)

    def of(a: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(a) - 1) / BLOCK)).cast("int")
        part = lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK))
        total = lambda x: F.aggregate(x, zero, op)
        bases = F.aggregate(F.sequence(F.lit(0), last), F.array(zero), lambda acc, b: F.array_append(acc, op(F.element_at(acc, -1), total(part(b)))))

        def inner(base: Column) -> Column:
            fill = lambda b: F.aggregate(part(b), F.struct(F.get(base, b).alias("at"), nothing.alias("out")), lambda s, v: F.struct(op(s["at"], v).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))["out"]
            return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), last), fill)), F.array(F.element_at(base, -1)))

        return once(bases, inner)

    return once(F.transform(values, lambda v: v.cast("bigint")), of)
