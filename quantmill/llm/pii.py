"""Personal data in texts, with Spark SQL expressions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for
IBANs), and words near a span adjust its score. Places come from the lengths of the
gaps between matches and of the matches themselves, so one projection does it all: no
shuffle and no Python.

Kinds, as listed: email, ip, card, phone (the base kinds: leftmost non-overlapping
matches, of which failing ones are dropped without a retry), then iban, ssn and secret, which
the method adds. A secret is a key of a known shape (its prefix says what it is) or what is
assigned to a name such as password or token, if it is as varied as one: a letter, a digit and
six different characters at least. Base spans always stay; an added span stays with a score of ``MIN_SCORE``
or more. Places are code points, the end exclusive.

Null text is empty and has no spans. Repeated rows are judged one by one, an empty table
gives an empty result. Only the text column is read for finding; ``redact`` keeps all
columns and has no helper columns that could clash; ``find_pii`` replaces a column named pii.

The patterns are the plain ones of each kind, written so that a long run of characters
is read once: possessive repeats where giving back cannot help, and a start only at the
beginning of a run or right after the previous match. An IBAN is as long as its country's
are, whatever follows it (a country that is not listed takes the whole run); IBANs are
proposed at every start, also inside of a proposal that fails.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]
MIN_SCORE = 0.5
#: Code points on each side of a span in which context words count.
NEAR = 40

#: Characters of an IBAN by country: the registry's, then those in use outside of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Group 1 is the IBAN that starts here; one letter is consumed, so that proposals may overlap."""
    known = {n: c.replace(" ", "|") for n, c in IBAN_LENGTHS.items()}
    shapes = [rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in known.items()]
    other = rf"(?!{'|'.join(known.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join([*shapes, other])})(?![A-Za-z0-9])))[A-Z]"


#: Keys that their prefix gives away.
KEYS = r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,250}+|[rs]k_live_[A-Za-z0-9]{16,250}+)(?![A-Za-z0-9_-])"
#: Names whose values are secret, what may stand between, and the value.
NAMES = r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)"
VALUE = r"[A-Za-z0-9+/_.~-]"
ASSIGNED = rf"(?<=[=:\x20\x22\x27])(?={VALUE}{{8}})(?<={NAMES}[\x22\x27]?\x20{{0,3}}[=:]\x20{{0,3}}[\x22\x27]?){VALUE}{{8,}}+"

#: One of these stands in each key.
KEY_SIGNS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AIza", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "rk_live_", "sk_live_")


def _any(text: Column, *parts: str) -> Column:
    return functools.reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


#: Kind: a substring or pattern without which there is no match, and the pattern.
PATTERNS = {
    "email": (lambda t: t.contains("@"), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": (lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (lambda t: t.contains("+"), r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (lambda t: t.rlike(r"[A-Z][A-Z][0-9][0-9]"), _iban()),
    "ssn": (lambda t: t.rlike(r"[0-9]-[0-9][0-9]-[0-9]"), r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "secret": (lambda t: _any(t, *KEY_SIGNS) | (_any(t, "=", ":") & t.rlike(rf"[=:]\x20{{0,3}}[\x22\x27]?{VALUE}{{8}}")), rf"{KEYS}|{ASSIGNED}"),
}
#: Score of a confirmed span before its context, and the words that raise it.
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.3, "secret": 0.6}
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|address|host|server|login", "card": "card|visa|credit|debit|payment|master", "phone": "phone|call|tel|mobile|fax|cell",
    "iban": "iban|bank|account|transfer", "ssn": "ssn|social|security|taxpayer", "secret": "key|secret|token|password|credential|login",
}
CONTEXT_GAIN = 0.25


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether at most 19 digits pass Luhn; leading zeros change nothing."""
    full = F.lpad(digits, 19, "0")
    doubled = F.translate(full, "123456789", "246813579")
    total = None
    for i in range(19):
        one = F.substring(full if i % 2 == 0 else doubled, 19 - i, 1).cast("int")
        total = one if total is None else total + one
    return total % 10 == 0


def mod_97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 (letters count 10 to 35)."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    codes = F.transform(F.split(turned, "(?<=.)(?=.)"), lambda c: F.ascii(c))
    step = lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)
    return F.aggregate(codes, F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        plain = F.regexp_replace(m, " ", "")
        return F.when(F.length(plain).between(15, 34), mod_97(plain)).otherwise(False)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9..)|-00-|0000$")
    if kind == "secret":
        return m.rlike(f"^{KEYS}") | (m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, "(?<=.)(?=.)"))) >= 6))
    return F.lit(True)


def _prefix_sums(sizes: Column) -> Column:
    """Sums of all earlier sizes, by blocks of 64 so that many matches stay cheap."""
    block = 64
    add = lambda a, x: a + x
    zero = F.lit(0)

    def with_blocks(b: Column) -> Column:
        s, blocks = b["s"], b["b"]
        starts = F.transform(F.sequence(F.lit(1), F.size(blocks)), lambda i: F.aggregate(F.slice(blocks, 1, i - 1), zero, add))
        place = lambda k, st: F.element_at(st["o"], (F.floor((k - 1) / block) + 1).cast("int")) + F.aggregate(F.slice(st["s"], (F.floor((k - 1) / block) * block + 1).cast("int"), ((k - 1) % block).cast("int")), zero, add)
        return let(F.struct(s.alias("s"), starts.alias("o")), lambda st: F.transform(F.sequence(F.lit(1), F.size(st["s"])), lambda k: place(k, st)))

    sums = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int")), lambda i: F.aggregate(F.slice(s, (i * block + 1).cast("int"), block), zero, add))
    return let(sizes, lambda s: let(F.struct(s.alias("s"), sums(s).alias("b")), with_blocks))


SPAN = "array<struct<start:int,k:int,end:int,score:double>>"


def _found(kind: str, text: Column, k: int) -> Column:
    """Confirmed spans of one kind: structs of start, k (place of the kind), end, score."""
    hint, pattern = PATTERNS[kind]
    ahead = kind == "iban"  # the match is looked at; its first letter is consumed
    taken = (lambda m: F.when(m.isNotNull(), 1)) if ahead else F.length

    def spans(p: Column) -> Column:
        at = _prefix_sums(F.transform(F.arrays_zip(p["g"].alias("g"), p["m"].alias("m")), lambda x: F.length(x["g"]) + F.coalesce(taken(x["m"]), F.lit(0))))

        def one(x: Column, first: Column) -> Column:
            start = first + F.length(x["g"])
            after = F.substring(x["n"], F.length(x["m"]) - taken(x["m"]) + 1, F.lit(NEAR)) if ahead else F.substring(x["n"], 1, NEAR)
            near = F.lower(F.concat(F.substring(F.substring(x["g"], -NEAR, NEAR), 1, NEAR), F.lit(" "), after))
            score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), CONTEXT_GAIN).otherwise(0.0))
            return F.struct(start.cast("int").alias("start"), F.lit(k).alias("k"), (start + F.length(x["m"])).cast("int").alias("end"), score.cast("double").alias("score"), x["m"].alias("m"))

        n = F.size(p["m"])
        rows = F.arrays_zip(F.slice(p["g"], 1, n).alias("g"), p["m"].alias("m"), F.slice(p["g"], 2, n).alias("n"))
        made = F.zip_with(rows, F.slice(at, 1, n), one)
        kept = F.filter(made, lambda s: _confirmed(kind, s["m"]) & (F.lit(kind in BASE_KINDS) | (s["score"] >= MIN_SCORE)))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["score"].alias("score")))

    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(int(ahead))).alias("m"))
    found = let(parts, lambda p: F.when(F.size(p["m"]) > 0, spans(p)))
    return F.coalesce(F.when(hint(text), found), F.array().cast(SPAN))


def _kinds(text: Column) -> list[Column]:
    return [_found(kind, text, k) for k, kind in enumerate(KINDS)]


def find_pii(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns of documents and pii: an array of (start, kind, end, score), by start, then kind.

    A column of documents that is named pii is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    spans = F.array_sort(F.concat(*_kinds(t)))
    names = F.array(*map(F.lit, KINDS))
    return documents.withColumn("pii", let(spans, lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), F.element_at(names, x["k"] + 1).alias("kind"), x["end"].alias("end"), x["score"].alias("score")))))


def digest(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, spans."""
    found = documents.select("doc_id", F.array_sort(F.concat(*_kinds(F.coalesce("text", F.lit(""))))).alias("s"))
    names = F.array(*map(F.lit, KINDS))
    line = lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))

    def out(s: Column) -> Column:
        count = lambda k: F.size(F.filter(s, lambda x: x["k"] == k)).cast("bigint")
        joined = lambda a: F.array_join(F.transform(a, line), ",")
        base = joined(F.filter(s, lambda x: x["k"] < len(BASE_KINDS)))
        return F.struct(*(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(s).alias("spans"))

    return found.select("doc_id", let(F.col("s"), out).alias("o")).select("doc_id", "o.*")


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets.

    Overlapping spans become one, named after the first. n_chars, where it is there, follows
    the new text. A null text stays null.
    """
    t = F.coalesce("text", F.lit(""))
    spans = F.array_sort(F.concat(*_kinds(t)))
    marks = F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS))

    def merge(a: Column, x: Column) -> Column:
        return F.when(x["start"] >= a["to"], F.struct(F.concat(a["out"], F.array(F.substring(t, a["to"] + 1, x["start"] - a["to"]), F.element_at(marks, x["k"] + 1))).alias("out"), x["end"].alias("to"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["to"], x["end"]).alias("to")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("to"))
    built = let(F.struct(spans.alias("s")), lambda p: F.when(F.size(p["s"]) > 0, F.aggregate(p["s"], start, merge, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["to"] + 1, F.length(t))))).otherwise(t))
    out = documents.withColumn("text", F.when(F.col("text").isNotNull(), built))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(documents.schema["n_chars"].dataType))
    return out.select(documents.columns)


def base_spans(documents: DataFrame) -> DataFrame:
    """What the base kinds alone give: doc_id, their counts and base_sha256."""
    return digest(documents).drop("spans")


#: The base kinds as SQL: pattern, and what confirms the match m (d: its digits).
_BASE_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INT ELSE (2 * d[length(d) - i]::INT) // 10 + (2 * d[length(d) - i]::INT) % 10 END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
}


def _kind_sql(k: int, kind: str) -> str:
    pattern, confirmed = _BASE_SQL[kind]
    return f"""SELECT rid, {k} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
      SELECT rid, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT rid, gaps, ms, ms[i] AS m, i FROM (
        SELECT rid, gaps, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS ms FROM d)))) WHERE {confirmed}"""


BASE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
  f AS ({" UNION ALL ".join(_kind_sql(k, kind) for k, kind in enumerate(BASE_KINDS))}),
  s AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE_KINDS)}, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE_KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN s USING (rid)
"""
