r"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust a score. Native functions only.

Kinds: email, ip, card, phone (the base kinds, always kept once confirmed), then iban (its country's length, mod-97), ssn and
secret (a long run of letters and digits, both), kept from `threshold` on. Context words on either side raise a score, words
that tell of samples or of other numbers lower it. Offsets are code points, ends exclusive. A span's place follows from the matches and the gaps between
them, so no Python is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: The length of each country's account numbers.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _ibans() -> str:
    """A country's code, check digits, and as many letters and digits as its numbers have, single blanks allowed between."""
    lengths = sorted(set(IBAN_LENGTHS.values()))
    codes = {n: "|".join(c for c, m in IBAN_LENGTHS.items() if m == n) for n in lengths}
    return "(?:" + "|".join(f"(?:{codes[n]})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n in lengths) + ")"


# Possessive loops keep Java's matcher from recursing; look-behinds keep long runs linear, a look-ahead spares the list of countries.
# All match as the plain forms do.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9_])(?=[A-Z]{{2}}[0-9]{{2}}){_ibans()}(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+",
}
BASE = ("email", "ip", "card", "phone")
#: A text without the hint has no match, so its scan is skipped.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Likewise, for kinds that no one character tells of.
SHAPES = {"iban": "[A-Z]{2}[0-9]{2}", "secret": "[A-Za-z_][0-9]|[0-9][A-Za-z_]"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.2}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|server|host",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security",
    "secret": "token|secret|key|password|passwd|credential|api",
}
#: Words that lower the score of any kind.
AGAINST = "example|sample|dummy|invoice|order|serial|part|version|checksum"
BONUS, MALUS, WINDOW = 0.3, 0.2, 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    at = lambda i: F.substring(digits, F.length(digits) - i + 1, 1).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's remainder is 1."""
    plain = F.replace(iban, F.lit(" "))
    turned = F.concat(F.substring(plain, 5, 2**31 - 1), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: (F.when(value(c) > 9, s * 100).otherwise(s * 10) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        return match.rlike(SHAPES["secret"]) & match.rlike("[A-Za-z]")
    return match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _spans(text: Column, kind: str) -> Column:
    """The confirmed spans of a kind as array<struct<kind,start,end,score>>."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.arrays_zip(matches.alias("m"), F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("g"))
    # The last gap has no match; its null is dropped below.
    placed = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<m:string,start:int>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNotNull() & _confirmed(kind, x["m"]), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), (acc["at"] + x["g"]).alias("start"))))).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    before = lambda x: F.substring(text, F.greatest(x["start"] + 1 - WINDOW, F.lit(1)), F.least(x["start"], F.lit(WINDOW)))
    near = lambda x: F.lower(F.concat(before(x), F.lit(" "), F.substring(text, x["start"] + F.length(x["m"]) + 1, F.lit(WINDOW))))
    says = lambda x, words: near(x).rlike(rf"(?<![A-Za-z0-9_])(?:{words})")
    score = lambda x: F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(says(x, CONTEXT[kind]), BONUS).otherwise(0.0) - F.when(says(x, AGAINST), MALUS).otherwise(0.0))
    out = F.transform(placed, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].cast("long").alias("start"), (x["start"] + F.length(x["m"])).cast("long").alias("end"), score(x).alias("score")))
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)")
    hit = text.rlike(pattern)
    if kind in HINTS:
        hit = F.contains(text, F.lit(HINTS[kind])) & hit
    if kind in SHAPES:
        hit = text.rlike(SHAPES[kind]) & hit
    return F.when(hit, out).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, out: str = "pii_spans") -> DataFrame:
    """Add column `out`: array<struct<kind,start,end,score>>, by kind in PATTERNS' order and then start.

    Null text counts as empty and gives an empty array. Rows, their order within a partition, repeated rows and other
    columns stay; an existing column of the name `out` is replaced. Base kinds ignore `threshold`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [_spans(text, k) if k in BASE else F.filter(_spans(text, k), lambda s: s["score"] >= threshold) for k in PATTERNS]
    return docs.withColumn(out, F.concat(*found))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Replace each span by its kind in brackets; where spans overlap, the one that starts first stands for them all. Other columns stay."""
    spans = unused(docs, "pii_spans")
    found = find_pii(docs, text_col, threshold, spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col(text_col)
    built = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))),
    )
    return found.withColumn(text_col, F.when(F.size(spans) > 0, built).otherwise(text)).drop(spans)
