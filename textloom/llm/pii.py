"""Personal data and secrets, in DataFrame functions only.

Regular expressions propose spans, checks confirm them (digit counts, parts of
addresses, Luhn, mod-97), and words nearby adjust a score.  The four base kinds
are reported whenever their check holds; further kinds (iban, card15, localphone,
secret) only with a score of ``REPORT`` or more.  Nearby are whole words within
``NEAR`` code points on either side, up to the next proposal of the same kind.

Offsets come from the texts between matches, so a text is matched twice, and
only where a cheap test finds a character that the kind needs; cost is linear in
the text and in its spans.  Patterns are possessive and begin at the start of a
run: Java's matcher neither recurses nor retries within long runs, whatever the
text's length, and the matches are the same as the plain patterns' (a run that
fails from its start fails from anywhere inside it).

Defined cases: null text is empty; rows with equal or null doc_id are separate;
texts without matches give zero counts and the digest of the empty string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.arrays import once, running, running_max
from textloom.llm.common import table

REPORT = 0.6
NEAR = 40
_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """``guard``: what every text with a match has.  ``plain``: the pattern without Java's possessive forms.  ``context``: lower-case words."""

    name: str
    guard: str
    pattern: str
    plain: str
    base: bool
    score: float
    context: str


KINDS = (
    Kind("email", "@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", True, 0.9, "mail|email|e-mail|kontakt|contact|correo|courriel"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", True, 0.7, "ip|host|server|address|adresse|dirección"),
    Kind("card", "[0-9]", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9])+", True, 0.8, "card|visa|mastercard|credit|karte|kreditkarte|tarjeta|carte"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.7, "phone|tel|telefon|telephone|teléfono|téléphone|call|fax|mobile|mobil|rufen|llamar|appeler"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", False, 0.8, "iban|account|konto|cuenta|compte|bank|banco|banque"),
    Kind("card15", "[0-9]", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9])+", False, 0.4, "card|amex|american express|credit|karte|kreditkarte|tarjeta|carte"),
    Kind("localphone", "[0-9]", r"[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}", False, 0.3, "phone|tel|telefon|telephone|teléfono|téléphone|call|fax|mobile|mobil|rufen|llamar|appeler"),
    Kind("secret", "[A-Fa-f0-9]{32}", r"(?<![A-Za-z0-9_])[A-Fa-f0-9]{32,128}+(?![A-Za-z0-9_])", r"\b[A-Fa-f0-9]{32,128}\b", False, 0.4, "token|secret|key|api|apikey|password|passwort|passwd|credential|credentials|bearer|clave|clé|schlüssel"),
)
BASE = tuple(k.name for k in KINDS if k.base)
_WORDY = r"[\p{L}\p{N}]"


def _near(words: str) -> str:
    """Whole words, for Java and RE2."""
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{words})(?:[^\p{{L}}\p{{N}}]|$)"


def luhn(digits: Column) -> Column:
    """Whether a string of up to a few dozen digits passes."""
    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an IBAN's checksum is one."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))

    def add(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]+", "")
    n = F.length(digits)
    if kind == "ip":
        value = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(value(p)) > 3, False).otherwise(F.concat(F.lit("0"), value(p)).cast("int") <= 255))
    if kind in ("card", "card15"):
        return F.when(n.between(16, 19) if kind == "card" else n == 15, luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    return F.lit(True)


def _spans(kind: Kind, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of confirmed spans, in code points."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("gap")).cast("array<struct<m:string,gap:string>>")

    def before(gap: Column) -> Column:
        return F.when(F.length(gap) > NEAR, F.regexp_replace(F.right(gap, F.lit(NEAR)), f"^{_WORDY}+", "")).otherwise(gap)

    def after(gap: Column) -> Column:
        return F.when(F.length(gap) > NEAR, F.regexp_replace(F.left(gap, F.lit(NEAR)), f"{_WORDY}+$", "")).otherwise(gap)

    def found(z: Column) -> Column:
        def located(at: Column) -> Column:
            def row(x: Column, i: Column) -> Column:
                """Both gaps are at most NEAR long when they are looked at, so a span costs no more than its own length."""
                return F.struct((F.get(at, i) + F.length(x["gap"])).cast("int").alias("start"), F.get(at, i + 1).cast("int").alias("end"), x["m"].alias("m"), x["gap"].alias("left"), F.get(z, i + 1)["gap"].alias("right"))

            return F.filter(F.transform(z, row), lambda x: F.when(x["m"].isNull(), False).otherwise(_confirmed(kind.name, x["m"])))

        return once(running(F.transform(z, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0)))), located)

    def rated(x: Column) -> Column:
        around = F.lower(F.concat_ws(" ", before(x["left"]), after(x["right"])))
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.least(F.lit(1.0), F.lit(kind.score) + F.when(around.rlike(_near(kind.context)), 0.3).otherwise(0.0)).alias("score"))

    out = F.transform(once(pairs, found), rated)
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= REPORT)
    empty = F.slice(F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"))), 1, 0)
    return F.when(text.rlike(kind.guard), out).otherwise(empty)


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id`` and per kind its spans with scores; no shuffle."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.select("doc_id", *(_spans(k, F.col("text")).alias(k.name) for k in KINDS))


_BLOCK = 256


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """Code points [a, b) of a text in blocks of ``_BLOCK``; no walk from the text's start."""
    i, j = F.floor(a / _BLOCK).cast("int"), F.floor((b - 1) / _BLOCK).cast("int")
    at = (a % _BLOCK + 1).cast("int")
    wide = F.concat(F.substring(F.get(blocks, i), at, F.lit(_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(blocks, j), F.lit(1), (b - j * _BLOCK).cast("int")))
    return F.when(b <= a, "").when(i == j, F.substring(F.get(blocks, i), at, (b - a).cast("int"))).otherwise(wide)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span replaced by ``[KIND]``; all columns.
    Overlapping spans become one, named after the first."""
    text = F.col("text")
    spans = F.sort_array(F.concat(*(F.transform(_spans(k, text), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))) for k in KINDS)))

    def rewritten(s: Column) -> Column:
        def joined(blocks: Column) -> Column:
            def with_ends(upto: Column) -> Column:
                first = F.filter(F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), F.get(upto, i).alias("from"), x["kind"].alias("kind"))), lambda x: x["start"] >= x["from"])
                parts = F.transform(first, lambda x: F.concat(_piece(blocks, x["from"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
                return F.concat(F.array_join(parts, ""), _piece(blocks, F.element_at(upto, -1), F.length(text)))

            return once(running_max(F.transform(s, lambda x: x["end"])), with_ends)

        return F.when(F.size(s) > 0, once(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0)), joined)).otherwise(text)

    return docs.withColumn("text", once(spans, rewritten))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def named(kinds) -> Column:
        return F.concat_ws(",", F.flatten(F.array(*(F.transform(k, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))) for k in kinds))))

    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(named(BASE), 256).alias("base_sha256"),
        named([k.name for k in KINDS]).alias("spans"),
        F.concat_ws(",", F.flatten(F.array(*(F.transform(k.name, lambda x: F.round(x["score"] * 100).cast("int").cast("string")) for k in KINDS)))).alias("scores"),
    )


def _sql() -> str:
    digits = "regexp_replace(m, '[^0-9]+', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN 2 * CAST({digits}[-i] AS INT) - CASE WHEN CAST({digits}[-i] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST({digits}[-i] AS INT) END)) % 10 = 0"
    compact = "replace(m, ' ', '')"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST('0' || ltrim(p, '0') AS HUGEINT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn_sql}",
        "card15": f"length({digits}) = 15 AND {luhn_sql}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"list_reduce(list_transform(string_split({compact}[5:] || {compact}[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97, 0) = 1",
        "localphone": "true",
        "secret": "true",
    }
    left = f"CASE WHEN length(g) > {NEAR} THEN regexp_replace(right(g, {NEAR}), '^{_WORDY}+', '') ELSE g END"
    right = f"CASE WHEN length(g2) > {NEAR} THEN regexp_replace(left(g2, {NEAR}), '{_WORDY}+$', '') ELSE g2 END"
    parts = []
    for n, k in enumerate(KINDS):
        parts.append(rf"""
  SELECT rid, {n} AS n, '{k.name}' AS kind, a, b, least(1.0, {k.score} + CASE WHEN regexp_matches(lower(concat_ws(' ', {left}, {right})), '{_near(k.context)}') THEN 0.3 ELSE 0.0 END) AS score
  FROM (SELECT rid, m, g, lead(g) OVER (PARTITION BY rid ORDER BY i) AS g2, CAST(sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) - length(m) AS a,
               CAST(sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS b
        FROM (SELECT rid, unnest(regexp_extract_all(text, '{k.plain}')) AS m, unnest(string_split_regex(text, '{k.plain}')) AS g,
                     unnest(range(len(string_split_regex(text, '{k.plain}')))) AS i FROM one))
  WHERE m IS NOT NULL AND {checks[k.name]}""")
    return f"""
WITH one AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
told AS (SELECT *, kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(b AS BIGINT) AS VARCHAR) AS s FROM spans WHERE n < {len(BASE)} OR score >= {REPORT})
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)},
       sha256(coalesce(string_agg(s, ',' ORDER BY n, a) FILTER (WHERE n < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY n, a), '') AS spans,
       coalesce(string_agg(CAST(CAST(round(score * 100) AS INT) AS VARCHAR), ',' ORDER BY n, a), '') AS scores
FROM one LEFT JOIN told USING (rid) GROUP BY rid
"""


SQL = _sql()
