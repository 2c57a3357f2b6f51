"""Cases of letters, one character for one."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small letters whose capitals came with Unicode 15 and later: left as they are, whatever the JVM knows.
_LATE = "ƛɤᲊꟍꟛ" + "".join(map(chr, range(0x10D70, 0x10D86)))
#: Letters with a single capital beside the longer one that ``upper`` writes.
_SINGLE = {"ß": "ẞ", "ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ"} | {chr(c): chr(c + 8) for low in (0x1F80, 0x1F90, 0x1FA0) for c in range(low, low + 8)}


def upper_each(text: Column) -> Column:
    """Capitals as DuckDB's upper has them: every character stays one (ß becomes ẞ, ŉ stays), so lengths in characters
    stay too.  Spark's ``upper`` writes several where Unicode has no single one, or has one besides (SS, ʼN)."""

    def one(c: Column) -> Column:
        up = F.upper(c)
        return F.when(F.contains(F.lit(_LATE), c), c).when(F.char_length(up) == 1, up).otherwise(F.translate(c, "".join(_SINGLE), "".join(_SINGLE.values())))

    return F.when(text.isNotNull(), F.array_join(F.transform(F.split(text, ""), one), ""))
