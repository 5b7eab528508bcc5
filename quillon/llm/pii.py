"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

All of it is column expressions. Positions come without a regular-expression offset function: each match is wrapped
in two control characters (any that the text holds are first replaced by a third, of the same length, which no
pattern matches), the text is split there, and the lengths of the pieces add up to code-point offsets. The patterns
are written so that no text makes them backtrack: a match starts where a run starts or where the last match ended.

Base kinds: email; ip (parts of at most 255); card (14 to 19 digits, Luhn); phone (international, 10 to 15
digits). Added by the method: iban (mod-97), and national phone numbers if a context word stands close before
them. Each span has a score: a prior of its kind, raised by context words.

Defined results: null texts are empty and have no spans. Rows are judged one by one, repeated rows and null ids
included. Extra columns are not read. The time for a text grows with its length; spans are gathered by blocks, so it
takes hundreds of thousands of matches in one text until their number tells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
SPAN = "struct<kind:string,start:int,end:int,score:double>"
#: Matches whose spans are gathered together.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """``hint``: a text without it holds no match. ``prior`` and ``boost`` make the score; spans under ``least`` go."""

    name: str
    pattern: str
    hint: str
    prior: float
    boost: float
    words: str
    least: float = 0.0
    base: bool = True


#: In the order of the kinds in a result. Context words are looked for in the 40 characters before a match.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.1, r"mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, 0.3, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "", 0.8, 0.2, r"card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, 0.3, r"phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", "", 0.9, 0.1, r"iban|account|bank", base=False),
    Kind("phone", r"(?<![0-9+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", "", 0.3, 0.5, r"phone|tel|call|mobile|fax", least=0.6, base=False),
)
ORDER = ("email", "ip", "card", "phone", "iban")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        value = F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int")
        return F.when(value > 9, rest * 100 + value).otherwise(rest * 10 + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: Kind, match: Column) -> Column:
    """What the pattern can't say: ranges, digit counts and checksums."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), lambda x: F.coalesce(F.substring(F.ltrim(x, F.lit("0")), F.lit(1), F.lit(4)).try_cast("int"), F.lit(0)) <= 255)
    if kind.name == "card":
        return F.length(digits).between(14, 19) & luhn(F.substring(digits, F.lit(1), F.lit(19)))
    if kind.name == "phone" and kind.base:
        return F.length(digits).between(10, 15)
    if kind.name == "iban":
        return mod97(match)
    return F.lit(True)


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of a kind, in order."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    parts = F.split(F.regexp_replace(F.translate(text, OPEN + CLOSE, OTHER * 2), kind.pattern, f"{OPEN}$0{CLOSE}"), OPEN)

    def gather(head: Column, tail: Column) -> Column:
        def step(have: Column, part: Column) -> Column:
            match = F.substring_index(part, CLOSE, 1)
            rest = F.substring_index(part, CLOSE, -1)
            score = kind.prior + F.when(have["near"].rlike(kind.words), kind.boost).otherwise(0.0)
            span = F.struct(F.lit(kind.name).alias("kind"), have["at"].alias("start"), (have["at"] + F.length(match)).alias("end"), score.alias("score"))
            fine = confirmed(kind, match) & (score >= kind.least)
            return F.struct((have["at"] + F.length(match) + F.length(rest)).alias("at"), F.lower(F.right(rest, F.lit(40))).alias("near"), F.when(fine, F.concat(have["found"], F.array(span))).otherwise(have["found"]).alias("found"))

        def block(have: Column, k: Column) -> Column:
            """The spans of ``BLOCK`` matches in one array, so that appending copies no more than a block."""
            own = F.aggregate(F.slice(tail, k * BLOCK + 1, F.lit(BLOCK)), F.struct(have["at"].alias("at"), have["near"].alias("near"), none.alias("found")), step)
            return F.transform(F.array(own), lambda x: F.struct(x["at"].alias("at"), x["near"].alias("near"), F.concat(have["blocks"], F.array(x["found"])).alias("blocks")))[0]

        start = F.struct(F.length(head).alias("at"), F.lower(F.right(head, F.lit(40))).alias("near"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("blocks"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(tail) - 1) / BLOCK).cast("int")), start, block)["blocks"])

    found = F.transform(F.array(parts), lambda p: F.when(F.size(p) > 1, gather(p[0], F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))).otherwise(none))[0]
    return F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(none) if kind.hint else found


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end, score; end exclusive, in order) for each row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    of = lambda base: F.flatten(F.array(*(spans_of(F.col("text"), k) for k in KINDS if k.base == base)))
    ranked = lambda x: F.array_sort(x, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(F.array_position(F.lit(list(ORDER)), a["kind"]).cast("int") - F.array_position(F.lit(list(ORDER)), b["kind"]).cast("int")))
    return rows.select("doc_id", of(True).alias("base"), of(False).alias("more")).select("doc_id", ranked(F.col("base")).alias("base"), ranked(F.concat("base", F.filter("more", lambda x: ~F.exists("base", lambda b: (b["kind"] == x["kind"]) & (b["start"] < x["end"]) & (x["start"] < b["end"]))))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans as text."""
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in ORDER[:4]), F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def _kind_sql(name: str, pattern: str) -> str:
    """Matches of a base kind with their places: the text is split at marks around each match."""
    return f"""SELECT doc_id, '{name}' AS kind, split_part(part, chr(2), 1) AS m, CAST(before AS BIGINT) AS start_ FROM (
  SELECT doc_id, part, i, coalesce(sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(x, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM t))) WHERE i > 1"""


#: The same with marks around the base kinds' matches, and place by place for the kinds with conditions on what stands around them.
ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS x, coalesce(text, '') AS raw FROM documents),
b AS ({_kind_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")} UNION ALL {_kind_sql("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")}
  UNION ALL {_kind_sql("card", r"[0-9]([ -]?[0-9])+")} UNION ALL {_kind_sql("phone", r"\+[0-9][ ().0-9-]+[0-9]")}),
d AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM b),
base AS (SELECT doc_id, kind, start_, start_ + length(m) AS end_ FROM d WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0
  WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
  ELSE length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(digits, length(digits) - i, 1) AS INT)
    ELSE CAST(substr(digits, length(digits) - i, 1) AS INT) * 2 - CASE WHEN CAST(substr(digits, length(digits) - i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END),
p AS (SELECT doc_id, x, unnest(range(1, length(x) + 1)) AS i FROM t WHERE regexp_matches(x, '[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}')),
pm AS (SELECT doc_id, x, i FROM p WHERE regexp_matches(substr(x, i, 12), '^[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}$') AND NOT (i > 1 AND regexp_matches(substr(x, i - 1, 1), '[0-9+.-]')) AND NOT regexp_matches(substr(x, i + 12, 1), '[0-9.-]')),
pc AS (SELECT *, greatest(i - 40, coalesce(lag(i + 12) OVER (PARTITION BY doc_id ORDER BY i), 1)) AS near FROM pm),
national AS (SELECT doc_id, 'phone' AS kind, i - 1 AS start_, i + 11 AS end_ FROM pc WHERE regexp_matches(lower(substr(x, near, i - near)), 'phone|tel|call|mobile|fax')),
q AS (SELECT doc_id, x, unnest(range(1, length(x) + 1)) AS i FROM t WHERE regexp_matches(x, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11}}')),
qm AS (SELECT doc_id, i, regexp_extract(substr(x, i, 34), '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AS code, x FROM q WHERE NOT (i > 1 AND regexp_matches(substr(x, i - 1, 1), '[A-Za-z0-9]'))),
iban AS (SELECT doc_id, 'iban' AS kind, i - 1 AS start_, i - 1 + length(code) AS end_ FROM qm WHERE code <> '' AND NOT regexp_matches(substr(x, i + length(code), 1), '[A-Za-z0-9]')
  AND list_reduce(list_prepend(0, list_transform(string_split(substr(code, 5) || substr(code, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1),
more AS (SELECT * FROM iban UNION ALL SELECT n.* FROM national n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = n.doc_id AND b.kind = 'phone' AND b.start_ < n.end_ AND n.start_ < b.end_)),
r AS (SELECT *, true AS own FROM base UNION ALL SELECT *, false FROM more),
o AS (SELECT *, kind || ':' || start_ || ':' || end_ AS shown, list_position(['email', 'ip', 'card', 'phone', 'iban'], kind) AS rank FROM r),
g AS (SELECT doc_id, count(*) FILTER (WHERE own AND kind = 'email') AS n_email, count(*) FILTER (WHERE own AND kind = 'ip') AS n_ip, count(*) FILTER (WHERE own AND kind = 'card') AS n_card, count(*) FILTER (WHERE own AND kind = 'phone') AS n_phone,
  string_agg(shown, ',' ORDER BY start_, rank) FILTER (WHERE own) AS base, string_agg(shown, ',' ORDER BY start_, rank) AS spans FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)
"""
