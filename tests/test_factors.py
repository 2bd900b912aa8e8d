"""The prefilter of rules loses no match."""

import random
import re

import pytest

from veilgrid.functions.checksums import CHECKS
from veilgrid.operators import detect, factors
from veilgrid.operators.rules import RULES, Rule

from .test_detect import INJECTIONS, VECTORS

CUSTOM = tuple(
    Rule(i, "t", p, 0.7, "i" in f, multiline="m" in f, dotall="s" in f, sticky="y" in f)
    for i, p, f in [
        ("email", r"\bEMP-[0-9]{4}\b", "g"), ("card-like", r"(?:alpha|beta)+\s*[:=]\s*x?\d", "gi"), ("jwt", r"[^@]@", "g"), ("a", r"(?:ab|cd|ef|gh)(?:0|1|23)[xyz]", "g"), ("b", r"Ärger|Straße", "gi"),
        ("c", r"(?i:key)\d{2,}", "g"), ("d", r"x*", "g"), ("e", r"(?=id)id-\d{3}\d*(?!z)", "g"), ("f", r"\d(?:[ -]*\d){4}", "g"), ("g", r"[A-Z]{2}(?:\d{2}|-){2}\d", "g"), ("h", r"(?:a|b)?c.d", "gs"), ("i", r"^line\d$", "gm"),
        ("j", r"^(?:no|yes),", "gy"), ("k", r"(?:one)?two(?:three){2}", "g"), ("l", r"q(?!u)[^u]?", "g"), ("m", r"[0-9a-f]{8}", "g"),
    ]
)


def plain(rules, text):
    return [(k, span) for k, r in enumerate(rules) for span in detect.matches(r, text)]


def through_factors(rules, text):
    return [(k, span) for k, r in detect.able(rules, text) for span in detect.matches(r, text)]


def test_cards_with_wide_gaps_and_custom_rules_with_built_in_names():
    gaps = "card 4111      1111 1111  --  1111"
    assert [s[1] for s in detect.scan(gaps, "value", detect.rules_for(), "request")] == ["card-like"]
    rules = detect.rules_for(custom=CUSTOM[:2])
    assert [s[1:2] + s[6:] for s in detect.scan("EMP-1234 and Alpha = 7", "value", rules, "request")] == [("email", "EMP-1234"), ("card-like", "Alpha = 7")]


PIECES = (
    "4111 1111-1111  1111|  |-|--|      |1234567890123|900101-1234568|123-45-6789|+82|010-1234-5678|a@b.com|A.B@C.Org|@|sk_|pk_|sk-|sk-ant-|sk-proj-|ghp_|AIza|xoxb-|GOCSPX-|SG.|npm_|eyJ|.|-----BEGIN RSA |PRIVATE KEY-----|Bearer |token|API_KEY|secret|"
    ":|=|'|\"|DE89370400440532013000|123456789018|255081416802538|2A|12345678Z|X1234567L|RSSMRA85T10A562S|S1234567D|234123412346|86095742719|111222333|AB123456C|+441234567890|(212) |555-1234|AKIA|ASIA|AC|"
    "ignore |all |previous |instructions|you are now |an |unrestricted|new |system |<|im_start|>|<<SYS>>|[system]:|do not |tell |the user|silently |call |x.y |tool|EMP-|alpha|beta|ab|cd|01|23|x|y|Ärger|STRASSE|ſ|K|İ|é|文|\u3000|\u00a0|\n|\t|key|KEY|id-|line|no,|yes,|one|two|three|q|u|c|d"
).split("|") + ["|", *INJECTIONS.values(), *VECTORS.values()]


@pytest.mark.parametrize("direction", ["request", "response"])
def test_equal_to_all_rules_run_plainly(direction):
    rules, rng, hits = detect.rules_for(direction, CUSTOM), random.Random(11), set()
    letters = "aAbB09 -_./:=@+'\"xXkK1234567890"
    for i in range(50_000):
        text = "".join(rng.choice(PIECES) if rng.random() < 0.6 else "".join(rng.choices(letters, k=rng.choice((1, 2, 4, 16, 36)))) for _ in range(rng.randrange(1, 9)))
        want = plain(rules, text)
        assert through_factors(rules, text) == want, text
        hits |= {rules[k].id for k, _ in want}
    assert len(hits) >= 40


def test_needs_of_patterns():
    need = lambda p, f=re.ASCII: factors.needs(p, f)
    assert need(r"ab(?:cd|e[fg])h").clauses == [frozenset({"ab"}), frozenset({"cd", "ef", "eg"}), frozenset({"h"})]
    assert need(r"(?:ab)+c?").clauses == [frozenset({"ab"})] and need(r"(?:ab)*").clauses == [] and need(r"a|").clauses == []
    assert (need(r"\d{3,4}\d{2}").row, need(r"\d{2}-\d{3}").row, need(r"(?:\d[ -]*?){13,19}").digits) == (5, 3, 13)
    assert need(r"(?:\d{4}|a\d{2})\d").row == 2 and need(r"(?:\d{4}|a\d{2})\d").digits == 3
    assert need(r"\d", 0).row == 0 and need(r"(?u:\d)", re.ASCII).row == 0


# -- check digits: three texts that hold, three that don't --
GOOD = {
    "luhn": ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"], "kr_rrn": ["900101-1234568"], "us_ssn": ["123-45-6789", "001-01-0001", "899-99-9999"], "iban": ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"],
    "uk_nino": ["AB123456C", "ZY000000A", "CE987654D"], "kr_phone": ["010-1234-5678", "+82 10 1234 5678", "01012345678"],
}


def test_three_of_each_check():
    """From a body, the check digits that hold are found by trying all; all others must fail."""
    bodies = {
        "luhn": (["411111111111111", "550000000000000", "37828224631000"], "0123456789"), "kr_rrn": (["900101123456", "850515201234", "010203345678"], "0123456789"), "jp_mynumber": (["12345678901", "98765432109", "10000000000"], "0123456789"),
        "es_dni": (["12345678", "X1234567", "Y7654321"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "it_codice_fiscale": (["RSSMRA85T10A562", "VRDLGI80A01H501", "BNCGPP75C41F205"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "sg_nric": (["S1234567", "T7654321", "M1111111"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "in_aadhaar": (["23412341234", "99998888777", "50000000001"], "0123456789"), "de_steuer_id": (["8609574271", "6592997048", "1123456789"], "0123456789"), "nl_bsn": (["11122233", "12345678", "98765432"], "0123456789"),
    }
    for name, (several, letters) in bodies.items():
        for body in several:
            assert sum(CHECKS[name](body + c) for c in letters) <= 1
        assert sum(any(CHECKS[name](b + c) for c in letters) for b in several) >= 2, name
    for body in ("2550814168025", "1840275116001", "190022B123456"):
        assert sum(CHECKS["fr_nir"](body + f"{k:02}") for k in range(1, 98)) == 1
    for name, texts in GOOD.items():
        assert all(CHECKS[name](t) for t in texts), name
    for name, texts in {"us_ssn": ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000"], "iban": ["DE88370400440532013000", "GB82WEST12345698765431", "XX"], "uk_nino": ["GB123456C", "DA123456C", "AB123456E"], "kr_phone": ["1012345678", "821012345678", ""]}.items():
        assert not any(CHECKS[name](t) for t in texts), name


def test_all_rules_are_told_apart_by_their_patterns():
    assert all(isinstance(factors.needs(p.pattern, p.flags), factors.Needs) for r in RULES for p in detect._compiled(r) if p)
