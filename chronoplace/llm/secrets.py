"""Secrets: fixed patterns, plus a randomness test battery for strings without a known shape.

Native: DataFrame functions only. Two passes over the texts; what is shuffled are sums.

Base kinds: assign (a credential word, then a value of 6 or more characters),
access (AKIA keys of 20 or more) and hex (24 or more digits). The method adds
`random`: runs of 24 or more characters of the base64 alphabets that no base
span touches. Their encoding is inferred (hex, base32, base36, letters, each in
one case; letters and digits in both; base64) and three tests ask whether the
symbols look drawn at random from that alphabet:

* chi-squared uniformity of the symbols over equal cells of the alphabet, as
  many cells as the length allows (expected count of 5 or more, 2 to 16 cells);
* the runs test about the middle of the alphabet;
* the serial correlation of neighbouring symbols.

The smallest of the three p-values, times three (Bonferroni), is p. Under
"random" p is about uniform. Under "structured" it has density a*p^(a-1), where
a = A_LENGTH / length: the longer a structured string, the surer the tests
reject it, so a long string that passes is stronger evidence than a short one.
With PRIOR for random strings this gives each candidate's local false-discovery
rate. Discoveries are controlled over the whole table: candidates are taken in rising
order of that rate, in steps of 1 / BINS, while the mean rate of all that are taken is
at most FDR, and never one that is likelier structured than random. So there are two
passes: one sums rates by step (at most BINS + 1 rows reach the driver) and finds the
cut, the second one takes the spans.

A known limit: letters that run through the alphabet look random in the order by
frequency that letters are tested in.

Defined results: a null or empty text has no spans; repeated rows give repeated
results and count in the control as often as they occur; candidates with equal rates
are taken together or not at all; a table without candidates has no cut and no random
spans; columns of the input stay, and clashing output names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplace.llm import spans as S

BASE_KINDS = ("assign", "access", "hex")
LEAST_RANDOM = 24
A_LENGTH, PRIOR, FDR = 1.0, 0.5, 0.1
BINS, MOST = 1000, 0.5

# The patterns of the kinds. hex and access carry their least length,
# which selects the same maximal runs; assign is filtered after the match.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "random": rf"[A-Za-z0-9+/_-]{{{LEAST_RANDOM},}}+={{0,2}}",
}
_ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
# Alphabets, the most special first. Those that words are written in have
# their letters by how common they are in prose: the tests hold for any order of the
# symbols, and in this one the letters of words crowd into few cells.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
ALPHABETS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[a-z]+$", _COMMON),
    ("^[A-Z]+$", _COMMON.upper()),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789" + _COMMON),
    ("^[0-9A-Z]+$", "0123456789" + _COMMON.upper()),
    ("^[A-Za-z]+$", _COMMON + _COMMON.upper()),
    ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"),
)


def upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, by a logistic form that is right to 2e-4."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def two_sided(z: Column) -> Column:
    return 2.0 * upper_tail(F.abs(z))


def p_random(value: Column) -> Column:
    """p-value of the battery: small where the symbols don't look drawn at random."""
    plain = F.regexp_replace(F.regexp_replace(value, "=+$", ""), "[-_]", "+")
    letters = F.lit(ALPHABETS[-1][1])
    for shape, alphabet in reversed(ALPHABETS[:-1]):
        letters = F.when(plain.rlike(shape), F.lit(alphabet)).otherwise(letters)
    n = F.length(plain)
    cells = F.when(n >= 80, 16).when(n >= 40, 8).otherwise(4)
    symbols = F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("instr", letters, F.substr(plain, i, F.lit(1))) - 1)
    given = F.array(F.struct(symbols.alias("x"), n.cast("double").alias("n"), F.length(letters).alias("m"), cells.alias("g")))

    def battery(t: Column) -> Column:
        x, n, m, g = t["x"], t["n"], t["m"], t["g"]
        pairs = F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b"))
        total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, y: acc + f(y))

        def cell(c: Column) -> Column:
            share = n * (F.ceil((c + 1) * m / g) - F.ceil(c * m / g)) / m
            seen = F.size(F.filter(x, lambda v: F.floor(v * g / m) == c))
            return (seen - share) * (seen - share) / share

        chi, free = total(F.sequence(F.lit(0), g - 1), cell), g - 1
        spread = 2.0 / (9.0 * free)
        uniform = upper_tail((F.pow(chi / free, F.lit(1.0 / 3)) - (1.0 - spread)) / F.sqrt(spread))
        turns = total(pairs, lambda p: F.when((p["a"] * 2 >= m) != (p["b"] * 2 >= m), 1.0).otherwise(0.0))
        runs = two_sided((turns - (n - 1) / 2) / F.sqrt((n - 1) / 4))
        middle = (m - 1) / 2.0
        lag = total(pairs, lambda p: (p["a"] - middle) * (p["b"] - middle)) / ((n - 1) * (m * m - 1) / 12.0)
        serial = two_sided(lag * F.sqrt(n - 1))
        return F.least(F.lit(1.0), 3.0 * F.least(uniform, runs, serial))

    return F.transform(given, battery)[0]


def local_fdr(value: Column) -> Column:
    """Chance that a candidate is structured text after all, given its p-value and its length."""
    a = F.least(F.lit(0.9), A_LENGTH / F.length(value))
    p = F.greatest(p_random(value), F.lit(1e-9))
    text = (1.0 - PRIOR) * a * F.pow(p, a - 1.0)
    return text / (text + PRIOR)


def _base(whole: Column) -> Column:
    always = lambda v: F.lit(True)
    assigned = lambda v: F.length(F.regexp_extract(v, _ASSIGNED, 1)) >= 6
    return S.in_order(
        F.concat(
            S.find(whole, PATTERNS["assign"], "assign", 0, assigned, whole.rlike("[:=]")),
            S.find(whole, PATTERNS["access"], "access", 1, always, whole.contains("AKIA")),
            S.find(whole, PATTERNS["hex"], "hex", 2, always),
        )
    )


def _rated(whole: Column, base: Column) -> Column:
    """(step, rate, span) of each candidate: a run that no base span touches."""
    runs = S.find(whole, PATTERNS["random"], "random", 3, lambda v: F.lit(True), whole.rlike(PATTERNS["random"]))
    free = F.filter(runs, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rated = F.transform(free, lambda s: F.struct(local_fdr(s["value"]).alias("rate"), s.alias("span")))
    return F.transform(rated, lambda r: F.struct(F.ceil(r["rate"] * BINS).cast("int").alias("step"), r["rate"].alias("rate"), r["span"].alias("span")))


def control(df: DataFrame, text: str = "text") -> int:
    """The last step that is taken; -1 if none is."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # texts without a run of a candidate's length end here
    rows = df.select(whole.alias("whole")).filter(F.col("whole").rlike(PATTERNS["random"])).withColumn("base", _base(F.col("whole")))
    steps = rows.select(F.explode(_rated(F.col("whole"), F.col("base"))).alias("r")).groupBy("r.step").agg(F.count("*").alias("n"), F.sum("r.rate").alias("sum"))
    taken, n, total = -1, 0, 0.0
    for r in sorted(steps.filter(F.col("step") <= int(MOST * BINS)).collect(), key=lambda r: r["step"]):
        n, total = n + r["n"], total + r["sum"]
        if total > FDR * n:
            break
        taken = r["step"]
    return taken


def detect(df: DataFrame, text: str = "text", cut: int | None = None) -> DataFrame:
    """Adds base_spans and spans, both in order. `cut` is what `control` found for the table; without one it is found here."""
    cut = control(df, text) if cut is None else cut
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = df.withColumn("base_spans", _base(whole)).withColumn("__rated", _rated(whole, F.col("base_spans")))
    taken = F.transform(F.filter("__rated", lambda r: r["step"] <= cut), lambda r: r["span"])
    return out.withColumn("spans", S.in_order(F.concat("base_spans", taken))).drop("__rated")


def digest(found: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, their digest, and all spans."""
    return found.select(
        "doc_id",
        *(S.count(F.col("base_spans"), k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(S.written(F.col("base_spans")), 256).alias("base_sha256"),
        S.written(F.col("spans")).alias("spans"),
    )
