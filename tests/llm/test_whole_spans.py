"""Personal data and secrets that a scan must not lose."""

import random
import string

from chronoplace.llm import pii, secrets

DE, SPACED, MT, GB = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "GB82 WEST 1234 5698 7654 32"


def mod97(value):
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def unlisted(body, country="ZZ"):
    return next(v for v in (f"{country}{i:02d}{body}" for i in range(2, 99)) if mod97(v) == 1)


def test_ibans_before_any_follower(spark):
    assert all(mod97(x) == 1 for x in (DE, SPACED, MT, GB))
    other, bad, head = unlisted("12345678901234567"), DE[:-1] + "1", "AB12 CDEFGHIJKLM"
    followers = ["", " to my bank", " Please pay", " A nice", " 2024", " NOW 12 B", " Ä", ". Then", ", X"]
    cases = [(v + f, [v]) for v in (DE, SPACED, MT, GB, other) for f in followers]
    cases += [(f"{head} {DE} Or {GB} Or {other} X", [DE, GB, other]), (f"PAY {DE}\nPay", [DE]), (f"{DE} {SPACED} 7", [DE, SPACED])]
    cases += [(bad + " Please", []), (DE + "X", []), ("x" + DE, []), (DE[:-2] + " Please", []), (DE + "a", []), (None, []), ("AB12", []), ("AB12 " * 400, [])]
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(table).collect()}
    for i, (text, expected) in enumerate(cases):
        spans = [s for s in got[i].spans if s.kind == "iban"]
        assert [s.value for s in spans] == expected, text
        assert all(text[s.start : s.end] == s.value for s in spans)
    redacted = {r.doc_id: r.text for r in pii.redact(table).collect()}
    assert redacted[2] == "<IBAN> Please pay" and redacted[4] == "<IBAN> 2024"


def test_random_strings_of_every_encoding_are_found(spark):
    rng, low, digits = random.Random(2), string.ascii_lowercase, string.digits
    kinds = {"hex": digits + "ABCDEF", "base36": digits + low, "BASE36": digits + low.upper(), "letters": low, "LETTERS": low.upper(), "Letters": low + low.upper(), "base62": digits + low + low.upper()}
    table = [(k, "key " + "".join(rng.choice(a) for _ in range(n)) + " end") for k, a in kinds.items() for n in (24, 40) for _ in range(50)]
    words = "Donaudampfschifffahrtsgesellschaft antidisestablishmentarianism getElementsByClassNameFromDocument electroencephalographically2 the-quick-brown-fox-jumps-over-it INTERNATIONALISIERUNGSPROBLEME".split()
    table += [("words", w) for w in words]
    found = {}
    for r in secrets.detect(spark.createDataFrame(table, "k string, text string")).select("k", "spans").collect():
        found.setdefault(r.k, []).append(any(s.kind == "random" for s in r.spans))
    assert not any(found.pop("words"))
    assert all(sum(v) >= 0.75 * len(v) for v in found.values()), {k: sum(v) for k, v in found.items()}
