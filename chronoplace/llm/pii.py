"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Native: DataFrame functions only. One pass over the texts, no shuffle.

Base kinds (always kept once their check holds): email, ip (parts at most 255),
card (14 to 19 digits that pass Luhn), phone (10 to 15 digits after a plus).
Scored kinds: iban (its country's length, mod-97 holds), ssn and local phone numbers. Each starts from
a prior, gains from context words of its kind within CONTEXT code points on
either side, loses from words that speak against it, and is a finding from
THRESHOLD on; an iban's checksum alone suffices.

Defined results: a null text has no spans and stays null; an empty text has
none; repeated rows give repeated results; columns of the input stay, and a
column whose name clashes with an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplace.llm import spans as S

BASE_KINDS = ("email", "ip", "card", "phone")
SCORED_KINDS = ("iban", "ssn", "local_phone")
CONTEXT = 48
THRESHOLD = 0.6

# The patterns of the kinds. The guards (?<!...) and possessive
# quantifiers don't change what matches: an attempt from inside a run can only
# succeed where the attempt from the run's start does. They keep the scan linear.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]?[0-9])",
}
# An IBAN's pattern finds where one may begin; _ibans finds its end. The longest run
# of groups from there, and the registry's lengths by country (ISO 13616).
_GROUPS = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])*(?![A-Za-z0-9])"
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.35, "local_phone": 0.35}
_FOR = {
    "email": "e-?mail|mail|contact|write|reach",
    "ip": "ip|address|host|server|login|client",
    "card": "card|visa|credit|debit|payment|amex|mastercard",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp",
    "iban": "iban|bank|account|transfer|sepa",
    "ssn": "ssn|social|security|taxpayer",
    "local_phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp",
}
_AGAINST = "version|isbn|issn|order|invoice|serial|example|sku|page"
FOR, AGAINST = 0.3, -0.3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """An IBAN's check: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    fits = F.length(plain).between(15, 34)
    return fits & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


def _iban_at(rest: Column) -> Column:
    """The IBAN that `rest` begins with, or null: it ends with a group, where its country's length says, or for a
    country that isn't listed at the last group for which mod-97 holds. What follows, of whatever case, is no part of it."""
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    groups = F.split(F.regexp_extract(rest, _GROUPS, 0), " ")
    ends = F.transform(F.sequence(F.size(groups), F.lit(1)), lambda i: F.array_join(F.slice(groups, F.lit(1), i), " "))

    def valid(value: Column) -> Column:
        wanted = F.try_element_at(lengths, F.substr(value, F.lit(1), F.lit(2)))
        n = F.length(F.replace(value, F.lit(" "), F.lit("")))
        return F.when(n.between(15, 34) & F.coalesce(n == wanted, F.lit(True)), _mod97(value)).otherwise(False)

    return F.try_element_at(F.filter(ends, valid), F.lit(1))


def _ibans(text: Column, heads: Column) -> Column:
    """Spans of the IBANs that begin at the heads; of two that overlap, the first."""
    # 34 characters with a space before each but the first four, and one more to see the end
    values = F.transform(heads, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), _iban_at(F.substring(text, s["start"] + 1, 34 + 30 + 1)).alias("value")))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + F.length(x["value"])
        span = F.struct(x["start"].alias("start"), end.alias("end"), F.lit("iban").alias("kind"), x["order"].alias("order"), x["value"].alias("value"))
        clear = x["value"].isNotNull() & ((F.size(acc) == 0) | (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) <= x["start"]))
        return F.when(clear, F.concat(acc, F.array(span)).cast(S.SPAN)).otherwise(acc)

    return F.when(F.size(heads) > 0, F.aggregate(values, S.nothing(), step)).otherwise(heads)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
    "iban": lambda v: F.lit(True),
    "ssn": lambda v: ~v.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$"),
    "local_phone": lambda v: F.lit(True),
}


def _guard(text: Column, kind: str) -> Column:
    """What any text with a match of the kind has; cheaper than the scan."""
    return {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike("[0-9]"),
        "phone": text.contains("+"),
        "iban": text.rlike("[A-Z]{2}[0-9]{2}"),
        "ssn": text.rlike("[0-9]-[0-9]{2}-[0-9]"),
        "local_phone": text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    }[kind]


def score(text: Column, span: Column, kind: str) -> Column:
    """Prior, plus context words for the kind, less words against it; from 0 to 1."""
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.substring(text, begin + 1, span["start"] - begin)
    near = F.lower(F.concat(before, F.lit(" "), F.substring(text, span["end"] + 1, F.lit(CONTEXT))))
    has = lambda words: near.rlike(rf"(?<![a-z])(?:{words})(?![a-z])")
    total = _PRIOR[kind] + F.when(has(_FOR[kind]), FOR).otherwise(0.0) + F.when(has(_AGAINST), AGAINST).otherwise(0.0)
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 3)


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans, spans (both in order) and scores (one for each of spans)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = [*BASE_KINDS, *SCORED_KINDS]
    found = {k: S.find(whole, PATTERNS[k], k, i, _VALID[k], _guard(whole, k)) for i, k in enumerate(kinds)}
    out = df.withColumns({f"__{k}": v for k, v in found.items()}).withColumn("__iban", _ibans(whole, F.col("__iban")))
    base = F.concat(*(F.col(f"__{k}") for k in BASE_KINDS))
    enough = lambda kind: lambda s: score(whole, s, kind) >= THRESHOLD
    scored = [F.filter(F.col(f"__{k}"), enough(k)) for k in SCORED_KINDS]
    # a scored span gives way to a base span that it overlaps
    clear = F.filter(F.concat(*scored), lambda s: ~F.exists(F.col("base_spans"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumn("base_spans", S.in_order(base)).withColumn("spans", S.in_order(F.concat(F.col("base_spans"), clear)))

    def rate(s: Column) -> Column:
        x = score(whole, s, kinds[-1])
        for k in kinds[:-1]:
            x = F.when(s["kind"] == k, score(whole, s, k)).otherwise(x)
        return x

    return out.withColumn("scores", F.transform("spans", rate)).drop(*(f"__{k}" for k in kinds))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of `text` by its kind in angle brackets; a null stays null. All other columns, whatever their
    names, stay as they are."""
    # the row is set aside, so that no column of the input meets one of detect's
    found = detect(df.select(F.struct("*").alias("__row"), F.col(f"`{text}`").alias("text")))
    mark = lambda kind: F.concat(F.lit("<"), F.upper(kind), F.lit(">"))
    clean = F.when(F.col("text").isNotNull(), S.replace(F.col("text"), F.col("spans"), mark))
    return found.select(*((clean if c == text else F.col("__row").getField(c)).alias(c) for c in df.columns))


def digest(found: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, their digest, and all spans."""
    return found.select(
        "doc_id",
        *(S.count(F.col("base_spans"), k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(S.written(F.col("base_spans")), 256).alias("base_sha256"),
        S.written(F.col("spans")).alias("spans"),
    )
