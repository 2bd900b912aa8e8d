"""PII: detected entities get keyed surrogates of the same kind, gender, script and format. Spark's own functions alone.

What is found: e-mail addresses, phone numbers, IPv4 addresses, payment cards with a right check digit (one run of digits,
or groups of 4-4-4-4, 4-4-4-4-1 to 4-4-4-4-3, 4-6-4, 4-6-5, 4-5-6, 4-4-5 and 6-13), US social security numbers, IBANs with right check digits, secrets (assigned to a telling name, or with a well-known beginning) and persons:
after a title, before one (Han, kana, Hangul), or a listed given name with a capitalised name after it.

A surrogate is a keyed permutation of the entity's canonical form: a Feistel network over its characters that keeps each
in its class (digit, vowel, consonant, letters of a script), or over numbers where a kind has a range. So the same entity
gets the same surrogate in every document and notation (coreference), and different entities of a kind get different ones,
without a table of them. What stays: case, separators, lengths, an e-mail's last label, a phone's country code, an IBAN's
country, a card's first two digits, well-known beginnings of secrets, titles; check digits are made right again.

Of a person each part of a name is replaced by itself. A listed given name becomes the next in a cycle through the list of
its gender and script, whose order the key decides. Any other keeps its last letter, which often tells the gender, and
the rest is permuted, again and again as long as a listed name comes out. Such a walk leaves the listed names after as
many steps as there are of them, and is a permutation of the names that are not listed; so no two names get one surrogate.

``collisions`` checks over all entities of a corpus, distinct ones counted before anything moves, what the construction
promises: that no two get one surrogate. ``replace`` asks it first and raises ValueError if they do. Nothing needs a join
or moves a text.

Cases: null texts stay null and have no entities; empty texts stay; texts without entities stay as they are; long texts
cost in proportion; repeated rows are replaced alike; empty tables give no rows; all other columns are kept, and columns
named entities or n_entities are replaced. Letters without a capital of their own (as the German sharp s) stay as they
are, as do those beyond Unicode's basic plane but for Han."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default key; give a secret one.
KEY = "veilgrid"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Sra|Srta|Señora|[Гг]-жа|[Гг]оспожа|κα|[Κκ]υρία|גב'|גברת|السيدة"
MALE_TITLES = "Mr|Herr|Monsieur|Sr|Señor|[Гг]-н|[Гг]осподин|κ|κος|[Κκ]ύριος|מר|السيد"
TITLES = f"{FEMALE_TITLES}|{MALE_TITLES}|Dr|Prof|[Дд]октор|[Пп]рофессор|Δρ|ד[\"״]ר|פרופ'|الدكتور|الدكتورة"
AFTER = "先生|女士|小姐|教授|博士|医生|さん|様|氏|\x20?씨|\x20?선생님|\x20?교수님|\x20?박사님"
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟"
#: Given names by gender and script. No name is in two lists.
GIVEN = {
    "female latin": "anna maria julia laura sophie clara emma marie lucia elena sarah alice nina carla eva ines paula olga vera linda susan helen ruth diana mary patricia jennifer elizabeth barbara jessica margaret nancy karen lisa betty sandra ashley emily michelle amanda rebecca katharina monika sabine petra ursula claudia isabelle nathalie camille chloé amélie carmen pilar rosa isabel beatriz".split(),
    "male latin": "john peter paul thomas martin david michael daniel lukas felix jean pierre louis hugo carlos juan miguel pablo diego robert james george frank simon william richard joseph charles christopher matthew anthony mark donald steven andrew kenneth joshua kevin brian edward hans jürgen wolfgang klaus stefan andreas françois jacques philippe antoine nicolas étienne josé antonio manuel javier".split(),
    "female cyrillic": "анна мария елена ольга наталья татьяна ирина светлана екатерина юлия".split(),
    "male cyrillic": "иван алексей дмитрий сергей андрей михаил николай владимир александр павел".split(),
    "female greek": "μαρία ελένη κατερίνα σοφία αγγελική".split(),
    "male greek": "γιώργος δημήτρης κώστας νίκος παναγιώτης".split(),
}
_LISTED = [x for names in GIVEN.values() for x in names]
FEMALE, MALE = ([x for k, names in GIVEN.items() if k.startswith(g) for x in names] for g in ("female", "male"))

_WORD = r"[\p{L}\p{N}_]"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
ASSIGNED = rf"(?<!{_WORD})(?i:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|token|secret|password|passwd)[ \t]{{0,4}}[:=][ \t]{{0,4}}[\"']?[A-Za-z0-9._~+/-]{{12,}}"
PREFIXED = rf"(?<!{_WORD})(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36,255}}|sk-[A-Za-z0-9_-]{{20,}}|xox[baprs]-[0-9A-Za-z-]{{10,}})"
IBAN = rf"(?<!{_WORD})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{_WORD})"
_CASED = r"\p{Lu}[\p{L}\p{M}'’-]+"
_EAST = r"\p{IsHan}{2,4}|\p{IsHangul}{2,4}|[\p{IsHiragana}\p{IsKatakana}ー]{2,8}"
_CASELESS = r"[\p{Lo}\p{M}&&[^\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]]{2,}"
_TITLED = rf"(?:{TITLES})\.?\x20(?:{_CASED}(?:\x20{_CASED}){{0,2}}|{_EAST}|{_CASELESS}(?:\x20{_CASELESS})?)"
_KNOWN = rf"(?:{'|'.join(x.capitalize() for x in _LISTED)})"
# no other word begins with these letters
_BEGINS = rf"(?=[\p{{Lu}}\p{{Lo}}гдпκ])(?<!{_WORD})"
PERSON = (
    rf"{_BEGINS}(?:{_TITLED}|{_KNOWN}(?:-{_CASED})?(?:\x20{_CASED}){{1,2}})"
    rf"|(?:[{SURNAMES}]\p{{IsHan}}{{1,2}}(?=先生|女士|小姐|教授|博士|医生)|(?<!\p{{IsHan}})\p{{IsHan}}{{2,4}}(?=さん|様|氏)|(?<![\p{{IsKatakana}}ー])[\p{{IsKatakana}}ー]{{2,8}}(?=さん|様|氏)|(?<!\p{{IsHangul}})\p{{IsHangul}}{{2,4}}(?=\x20?(?:씨|선생님|교수님|박사님)(?!\p{{IsHangul}})))(?:{AFTER})"
)
SSN = r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])"
PHONE = r"(?<![\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![\p{N}])"
#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = "20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
IPV4 = r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\p{N}|\.[0-9])"
# one run of digits, or groups; after 4-4-4-4 up to three more that begin no other entity, which the check digit decides on
_CARD_16 = r"[0-9]{4}(?:[ -][0-9]{4}){3}"
CARD = rf"(?<![\p{{N}}])(?:[0-9]{{13,19}}|{_CARD_16}[ -](?!{EMAIL}|{SSN}|{PHONE}|{IPV4})[0-9]{{1,3}}|{_CARD_16}|[0-9]{{4}}[ -](?:[0-9]{{6}}[ -][0-9]{{4,5}}|[0-9]{{5}}[ -][0-9]{{6}}|[0-9]{{4}}[ -][0-9]{{5}})|[0-9]{{6}}[ -][0-9]{{13}})(?![\p{{N}}])"
ENTITY = "|".join((EMAIL, ASSIGNED, PREFIXED, IBAN, PERSON, SSN, PHONE, IPV4, CARD))
_VALUE = r"^(.*?[:=][ \t]{0,4}[\"']?)(\S+)$"
#: What a line must have to hold an entity: a sign that most kinds need, or a beginning of the others.
_SIGNS = rf"[0-9@:=_先女小教博医さ様氏씨님]|{_BEGINS}(?:(?:{TITLES})\.?|{_KNOWN}(?:-{_CASED})?)\x20"
_BEGINNINGS = ("AKIA", "ASIA", "sk-", "xox")

_DIGITS, _VOWELS, _CONSONANTS = "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Code points and numbers of large scripts: Han, its extensions A and B, Hangul.
_RANGES = ((0x4E00, 20992), (0x3400, 6592), (0x20000, 42720), (0xAC00, 11172))


def _classes() -> list[str]:
    """The letters of each script but the large ones, in blocks of 128 code points: small ones that have a capital of their
    own, and those of scripts without case. A letter that is alone in its block stays as it is."""
    common = ["αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώ", "".join(map(chr, range(0x430, 0x450)))]  # apart from old letters
    found: dict[tuple[str, int], str] = {}
    for code in range(0x80, 0xFB00):
        c = chr(code)
        if any(c in x for x in common) or any(first <= code < first + n for first, n in _RANGES) or unicodedata.category(c) not in ("Ll", "Lo"):
            continue
        if unicodedata.category(c) == "Ll" and not (len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c):
            continue
        script = unicodedata.name(c, "").split(" ")[0]
        found[script, code >> 7] = found.get((script, code >> 7), "") + c
    return common + [letters for _, letters in sorted(found.items()) if len(letters) > 1]


#: Classes of characters of names and the like, and of secrets, where hexadecimal ones stay hexadecimal and others don't become so.
_PLAIN, _SECRET = [_DIGITS, _VOWELS, _CONSONANTS, *_classes()], [_DIGITS, "abcdef", "ghijklmnopqrstuvwxyz"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prf(key: str, round_: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.concat(F.lit(f"{key}\x1e"), round_.cast("string")), *parts), 256)


def _moved(c: Column, by: Column, secret: Column) -> Column:
    """A character moved within its class by a random number. The classes are data, so that the plan stays small."""
    code = F.ascii(c)
    lists = F.when(secret, F.lit(_SECRET)).when(code < 128, F.lit(_PLAIN[:3])).otherwise(F.lit(_PLAIN[3:]))
    letters = F.get(F.filter(lists, lambda x: x.contains(c)), F.lit(0))
    within = F.substring(letters, (F.pmod(F.instr(letters, c) - 1 + by, F.char_length(letters)) + 1).cast("int"), F.lit(1))
    ranges = F.lit([[first, n] for first, n in _RANGES])
    spot = F.get(F.filter(ranges, lambda r: (code >= r[0]) & (code < r[0] + r[1])), F.lit(0))
    new = F.pmod(code - spot[0] + by, spot[1]) + spot[0]
    return F.when(letters.isNotNull(), within).when(spot.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(new), 8, "0")), "UTF-32")).otherwise(c)


def _shift(part: Column, seed: Column, secret: Column) -> Column:
    return F.when(part == "", part).otherwise(
        let(seed, lambda s: F.array_join(F.transform(F.split(part, ""), lambda c, i: _moved(c, F.shiftrightunsigned(F.xxhash64(s, i), 33), secret)), ""))
    )


def permuted(text: Column, key: str, tweak: Column, secret: Column | None = None) -> Column:
    """A permutation of the lower-case texts of each pattern of classes: four rounds of a Feistel network, each of which
    moves one half by a hash of the other."""
    secret = F.lit(False) if secret is None else secret
    cut = (F.char_length(text) / 2).cast("int")

    def round_(s: Column, k: Column) -> Column:
        first = k % 2 == 0
        new = _shift(F.when(first, s["a"]).otherwise(s["b"]), _prf(key, k, tweak, F.when(first, s["b"]).otherwise(s["a"])), secret)
        return F.struct(F.when(first, new).otherwise(s["a"]).alias("a"), F.when(first, s["b"]).otherwise(new).alias("b"))

    halves = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.char_length(text)).alias("b"))
    return F.aggregate(F.lit([0, 1, 2, 3]), halves, round_, lambda s: F.concat(s["a"], s["b"]))


def _walked(unit: Column, key: str) -> Column:
    """What a unit becomes: its text permuted but for the letters that stay, and of a name again while a listed one
    comes out."""

    def step(s: Column, _: Column) -> Column:
        n = F.char_length(s["text"]) - unit["keep"]
        last = F.substring(s["text"], n + 1, unit["keep"])
        new = F.concat(permuted(F.substring(s["text"], F.lit(1), n), key, F.concat(unit["tweak"], last), unit["secret"]), last)
        return F.when(s["go"], let(new, lambda x: F.struct(x.alias("text"), (unit["name"] & x.isin(_LISTED)).alias("go")))).otherwise(s)

    most = F.when(unit["name"], len(_LISTED)).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), most), F.struct(unit["text"].alias("text"), F.lit(True).alias("go")), step, lambda s: s["text"])


def next_names(key: str) -> dict[str, str]:
    """For each listed name the next of its list, in the order of a hash that the key decides."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda x: hmac.new(key.encode(), x.encode(), hashlib.sha256).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def _pair(a: Column, b: Column, m: int, n: int, key: str, tweak: str) -> Column:
    """A permutation of pairs of numbers below m and n, in four rounds too."""

    def round_(s: Column, k: Column) -> Column:
        first = k % 2 == 0
        move = F.xxhash64(_prf(key, k, F.lit(tweak), F.when(first, s["b"]).otherwise(s["a"]).cast("string")))
        return F.struct(F.when(first, F.pmod(s["a"] + F.pmod(move, F.lit(m)), F.lit(m))).otherwise(s["a"]).alias("a"), F.when(first, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(move, F.lit(n)), F.lit(n))).alias("b"))

    return F.aggregate(F.lit([0, 1, 2, 3]), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), round_)


def _recased(old: Column, new: Column) -> Column:
    one = lambda o, n: F.when(F.coalesce(o != F.lower(o), F.lit(False)), F.upper(n)).otherwise(n)
    return F.array_join(F.zip_with(F.split(old, ""), F.split(new, ""), one), "")


def _filled(form: Column, signs: Column) -> Column:
    """``form`` with its letters and digits replaced by ``signs`` in order."""
    step = lambda new: lambda s, c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), F.struct(F.concat(s["out"], F.substring(new, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return let(signs, lambda new: F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step(new), lambda s: s["out"]))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` and it a card number."""
    total = F.aggregate(F.split(F.reverse(body), ""), F.struct(F.lit(0).alias("sum"), F.lit(2).alias("by")), lambda s, c: F.struct(
        (s["sum"] + F.when(c.cast("int") * s["by"] > 9, c.cast("int") * s["by"] - 9).otherwise(c.cast("int") * s["by"])).alias("sum"), (3 - s["by"]).alias("by")), lambda s: s["sum"])
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _luhn_ok(m: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", _digits(m)), F.lit(False))


def entity(m: Column) -> Column:
    """What of a match of ENTITY is the entity: all, or the first 16 digits if with what follows they are no card."""
    return F.when(m.rlike(f"^{_CARD_16}[ -]") & ~_luhn_ok(m), F.substring(m, 1, 19)).otherwise(m)


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's letters and digits, letters counting from 10."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def kind(m: Column) -> Column:
    """The kind of a match of ENTITY; null if a check fails, and the match is then no entity."""
    iban = F.regexp_replace(m, " ", "")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{TITLES})\.?\x20|^{_KNOWN}[ -]|[\p{{IsHan}}\p{{IsHangul}}\p{{IsKatakana}}ー](?:{AFTER})$"), "person")
        .when(m.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[baprs]-)"), "secret")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), F.when(_mod97(F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))) == 1, "iban"))
        .when(m.rlike(r"^[A-Za-z]"), "secret")
        .when(m.rlike(f"^{SSN}$"), F.when(~m.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(m.rlike(r"^[+(]|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), "phone")
        .when(m.contains("."), "ipv4")
        .when(_luhn_ok(m), "card")
    )


def _country(m: Column) -> Column:
    """The digits of a phone number's country code; empty without a plus sign."""
    return F.regexp_extract(F.concat(F.substring(m, 1, 1), _digits(m)), rf"^\+([17]|{_TWO_DIGITS}|[0-9]{{3}})", 1)


def _national(m: Column) -> Column:
    return F.substring(_digits(m), F.char_length(_country(m)) + 1, F.char_length(m))


def canonical(kind_: Column, m: Column) -> Column:
    """The form in which an entity is the same in all notations; numbers without a country code are those of code 1."""
    return (
        F.when(kind_ == "email", F.lower(m))
        .when(kind_.isin("card", "ssn"), _digits(m))
        .when(kind_ == "phone", F.concat(F.coalesce(F.nullif(_country(m), F.lit("")), F.lit("1")), F.lit("-"), _national(m)))
        .when(kind_ == "person", F.lower(_names(m)["names"]))
        .when(kind_ == "iban", F.regexp_replace(m, " ", ""))
        .when(kind_ == "secret", F.lower(F.regexp_replace(m, _VALUE, "$2")))
        .otherwise(m)
    )


def _unit(text: Column, tweak: Column, secret: bool = False, name: bool = False, keep: Column | None = None) -> Column:
    """A lower-case text to permute, and how many of its last letters stay. All kinds share one permutation in the plan."""
    return F.struct(text.alias("text"), tweak.alias("tweak"), F.lit(secret).alias("secret"), F.lit(name).alias("name"), (F.lit(0) if keep is None else keep).alias("keep"))


def _names(m: Column) -> Column:
    """The title before a person's names, the names, and the title after them."""
    before = F.regexp_extract(m, rf"^(?:{TITLES})\.?\x20", 0)
    after = F.regexp_extract(m, rf"(?<=[\p{{IsHan}}\p{{IsHangul}}\p{{IsKatakana}}ー])(?:{AFTER})$", 0)
    cut = lambda b, a: F.substring(m, F.char_length(b) + 1, F.char_length(m) - F.char_length(b) - F.char_length(a))
    return let(F.struct(before.alias("before"), after.alias("after")), lambda x: F.struct(x["before"].alias("before"), cut(x["before"], x["after"]).alias("names"), x["after"].alias("after")))


_PART = r"[\p{L}\p{M}]+"


def _parts(names: Column) -> Column:
    return F.regexp_extract_all(names, F.lit(_PART), F.lit(0))


def _secret(m: Column) -> tuple[Column, Column]:
    """What stays of a secret's match, and the rest."""
    value = F.regexp_replace(m, _VALUE, "$2")
    begin = F.regexp_extract(value, r"^(?:AKIA|ASIA|gh[pousr]_|sk-)?", 0)
    return F.concat(F.regexp_extract(m, _VALUE, 1), begin), F.substring(value, F.char_length(begin) + 1, F.char_length(value))


_HOST = r"^[^@]*@(.*)(\.[^.]+)$"


def _units(kind_: Column, m: Column) -> Column:
    """What of a match is permuted."""
    local = F.split_part(m, F.lit("@"), F.lit(1))
    iban = F.regexp_replace(m, " ", "")
    name = lambda w: _unit(w, F.lit("name"), name=True, keep=(F.char_length(w) > 2).cast("int"))
    return (
        F.when(kind_ == "email", F.array(_unit(F.lower(local), F.concat(F.lit("local"), F.lower(F.split_part(m, F.lit("@"), F.lit(2))))), _unit(F.lower(F.regexp_extract(m, _HOST, 1)), F.lit("host"))))
        .when(kind_ == "phone", F.array(_unit(_national(m), F.lit("phone"))))
        .when(kind_ == "card", let(_digits(m), lambda d: F.array(_unit(F.substring(d, F.lit(3), F.char_length(d) - 3), F.concat(F.lit("card"), F.substring(d, 1, 2))))))
        .when(kind_ == "iban", F.array(_unit(F.lower(F.substring(iban, F.lit(5), F.char_length(iban))), F.concat(F.lit("iban"), F.substring(iban, 1, 2)))))
        .when(kind_ == "secret", F.array(_unit(F.lower(_secret(m)[1]), F.lit("secret"), secret=True)))
        .when(kind_ == "person", F.transform(_parts(_names(m)["names"]), lambda w: name(F.lower(w))))
    )


def _assembled(kind_: Column, m: Column, new: Column, key: str) -> Column:
    """A match's surrogate, from what its units became."""
    first = F.get(new, F.lit(0))
    kept, rest = _secret(m)
    secret = F.concat(kept, _recased(rest, first))
    local = F.split_part(m, F.lit("@"), F.lit(1))
    email = F.concat(_recased(local, first), F.lit("@"), _recased(F.regexp_extract(m, _HOST, 1), F.get(new, F.lit(1))), F.regexp_extract(m, _HOST, 2))
    phone = _filled(m, F.concat(_country(m), first))
    card = let(F.concat(F.substring(m, 1, 2), first), lambda b: _filled(m, F.concat(b, _luhn_digit(b))))
    land = F.substring(m, 1, 2)
    iban = let(F.upper(first), lambda b: _filled(m, F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b)))
    ssn = let(_digits(m), lambda d: let(
        _pair(F.substring(d, 1, 3).cast("int") - 1 - (F.substring(d, 1, 3).cast("int") > 666).cast("int"), (F.substring(d, 4, 2).cast("int") - 1) * 9999 + F.substring(d, 6, 4).cast("int") - 1, 898, 99 * 9999, key, "ssn"),
        lambda p: _filled(m, F.concat(F.lpad((p["a"] + 1 + (p["a"] >= 665).cast("int")).cast("string"), 3, "0"), F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0")))))
    ipv4 = let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), lambda o: let(
        _pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4"),
        lambda p: F.concat_ws(".", F.floor(p["a"] / 256).cast("string"), (p["a"] % 256).cast("string"), F.floor(p["b"] / 256).cast("string"), (p["b"] % 256).cast("string"))))
    known = next_names(key)
    cycle = F.lit([list(known), list(known.values())])

    def word(w: Column, x: Column) -> Column:
        at = F.array_position(cycle[0], F.lower(w)).cast("int")
        return F.when(at > 0, F.when(F.lower(w) == w, F.get(cycle[1], at - 1)).when(F.upper(w) == w, F.upper(F.get(cycle[1], at - 1))).otherwise(F.initcap(F.get(cycle[1], at - 1)))).otherwise(_recased(w, x))

    def person(n: Column) -> Column:
        between = F.split(n["names"], _PART, -1)
        one = lambda s, p: F.concat(s, F.coalesce(p, F.lit("")))
        return F.concat(n["before"], F.array_join(F.zip_with(between, F.zip_with(_parts(n["names"]), new, word), one), ""), n["after"])

    return (
        F.when(kind_ == "email", email).when(kind_ == "secret", secret).when(kind_ == "phone", phone).when(kind_ == "card", card)
        .when(kind_ == "ssn", ssn).when(kind_ == "ipv4", ipv4).when(kind_ == "iban", iban).when(kind_ == "person", let(_names(m), person))
    )


def surrogate(kind_: Column, m: Column, key: str) -> Column:
    """The surrogate of a match, in its notation."""
    new = F.transform(_units(kind_, m), lambda u: _walked(u, key))
    return let(new, lambda n: _assembled(kind_, m, n, key))


def _may_hold(text: Column) -> Column:
    """Whether a text could have an entity; much cheaper than to look for one."""
    out = text.rlike(_SIGNS)
    for x in _BEGINNINGS:
        out = out | text.contains(x)
    return out


def _matches(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the lines of the texts that may have entities, and each line's matches. No entity goes over a line's
    end, so the long expression runs only over the few lines that could have one."""
    one = lambda x: F.struct(x.alias("line"), F.when(_may_hold(x), F.regexp_extract_all(x, F.lit(ENTITY), F.lit(0))).alias("m"))
    return docs.withColumn("_veilgrid_lines", F.when(_may_hold(F.col(text)), F.transform(F.split(F.col(text), "\n", -1), one)))


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """kind, surrogate, entities: surrogates that more than one entity of ``docs`` would get. Entities are made distinct
    in each task before they move, so one that is in a third of all rows is a row a task."""
    found = _matches(docs.select(text), text).select(F.explode(F.flatten(F.transform(F.filter("_veilgrid_lines", lambda x: F.size(x["m"]) > 0), lambda x: x["m"]))).alias("m")).select(entity(F.col("m")).alias("m")).select(kind(F.col("m")).alias("kind"), "m").where(F.col("kind").isNotNull())
    distinct = found.groupBy("kind", canonical(F.col("kind"), F.col("m")).alias("entity")).agg(F.min("m").alias("m"))
    # the notation does not matter for what an entity becomes, so one of each will do
    new = distinct.select("kind", "entity", let(surrogate(F.col("kind"), F.col("m"), key), lambda x: canonical(F.col("kind"), x)).alias("surrogate"))
    return new.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


def replace(docs: DataFrame, key: str = KEY, text: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with surrogates in ``text``, and entities (kind, surrogate) and n_entities added."""
    if check and (found := collisions(docs, key, text).limit(1).collect()):
        raise ValueError(f"{found[0].entities} entities of kind {found[0].kind} have one surrogate")
    rest = lambda m, e: F.substring(m, F.char_length(e) + 1, F.char_length(m))
    one = lambda m: let(entity(m), lambda e: let(F.struct(e.alias("m"), kind(e).alias("k"), rest(m, e).alias("rest")), lambda x: F.struct(
        x["k"].alias("kind"), F.when(x["k"].isNull(), x["m"]).otherwise(surrogate(x["k"], x["m"], key)).alias("surrogate"), x["rest"].alias("rest"))))
    rows = _matches(docs.drop("entities", "n_entities"), text)
    rows = rows.withColumn("_veilgrid_found", F.transform("_veilgrid_lines", lambda x: F.when(F.size(x["m"]) > 0, F.transform(x["m"], one))))

    def joined(x: Column, e: Column) -> Column:
        parts = F.split(x["line"], ENTITY, -1)
        new = F.flatten(F.zip_with(parts, F.transform(e, lambda y: F.concat(y["surrogate"], y["rest"])), lambda p, s: F.array(p, F.coalesce(s, F.lit("")))))
        return F.when(e.isNull(), x["line"]).otherwise(F.array_join(new, ""))

    found = F.flatten(F.filter("_veilgrid_found", lambda e: e.isNotNull()))
    kept = F.coalesce(F.transform(F.filter(found, lambda e: e["kind"].isNotNull()), lambda e: e.dropFields("rest")), F.array().cast("array<struct<kind:string,surrogate:string>>"))
    any_ = F.exists("_veilgrid_lines", lambda x: F.size(x["m"]) > 0)
    new = F.when(any_, F.array_join(F.zip_with("_veilgrid_lines", "_veilgrid_found", joined), "\n")).otherwise(F.col(text)).alias(text)
    # one projection for all: each step is analysed anew together with the long expressions below it
    return rows.select(*(new if c == text else F.col(c) for c in rows.columns if c not in ("_veilgrid_lines", "_veilgrid_found")), kept.alias("entities"), F.size(kept).alias("n_entities"))
