"""Tables on which operators once did less than the whole job."""

import re

from veilgrid.llm import quality, surrogates, toxicity


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def card(digits, groups, sep=" "):
    """A number in groups that begins with ``digits`` and has a right check digit."""
    body = next(d for d in (digits[: sum(groups) - 1] + c for c in "0123456789") if luhn(d))
    return sep.join(body[sum(groups[:i]) : sum(groups[: i + 1])] for i in range(len(groups)))


def test_cards_in_groups_of_other_lengths(spark):
    layouts = [(4, 4, 4, 4), (4, 6, 4), (4, 6, 5), (4, 5, 6), (4, 4, 5), (6, 13), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3)]
    cards = ["3056 930902 5904"] + [card("6212345678901234567", g, sep) for g in layouts for sep in " -"]
    # what follows a card and is none of its digits stays, or is found for itself
    after = ["4111 1111 1111 1111 123", "4111 1111 1111 1111 123-45-6789", "4111 1111 1111 1111 10.1.2.3", "4111 1111 1111 1111 12ab@mail.example.com"]
    rows = [f"a {c}, b" for c in cards] + [f"{cards[-2]} 12/27", *after, "4111 1111 1111 1112 13"]
    got = surrogates.replace(spark.createDataFrame(list(enumerate(rows)), "id int, text string")).orderBy("id").collect()
    for c, r in zip(cards, got):
        new = r.text[2:-3]
        assert new != c and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", c) and luhn(re.sub("[^0-9]", "", new)) and [tuple(e) for e in r.entities] == [("card", new)]
    dated, plain, ssn, ipv4, email, none = got[len(cards) :]
    assert dated.text == got[len(cards) - 2].text[2:-3] + " 12/27"
    first = plain.text[:19]
    assert plain.text == first + " 123" and first != after[0][:19] and [tuple(e) for e in plain.entities] == [("card", first)]
    assert all(r.text.startswith(first + " ") and [e.kind for e in r.entities] == ["card", k] and r.text[20:] != t[20:] for r, t, k in zip((ssn, ipv4, email), after[1:], ("ssn", "ipv4", "email")))
    assert none.text == rows[-1] and none.n_entities == 0


def test_a_lexicon_has_all_terms_that_rows_give_reason_for():
    terms = [a + b + c + "ung" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    rows = [(i, f"some words {t} here", 1) for i, t in enumerate(terms * 3)] + [(1000 + i, "some words here", 0) for i in range(300)]
    model = toxicity.fit(rows)
    assert len(model.terms) > 48
    assert all(model.hits(text)[0] for _, text, label in rows if label)


def test_the_shape_of_a_word_is_that_of_the_whole_word():
    assert quality._shape("文" * 100 + "7!A") == "a9!A"
