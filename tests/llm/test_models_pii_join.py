import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import jaccard_join, quality, shingles, surrogates, toxicity
from veilgrid.llm.components import components
from veilgrid.llm.queries import op1_surrogates, op2_jaccard, op7_quality, op10_toxicity

BIG = "/root/testdata/sf0.1"  # enough held-out rows of either label


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("query,label,least", [(op7_quality, "quality", 0.99), (op10_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    rows = query(spark, BIG)
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    x = rows.where("held_out").join(labels, "doc_id").select("score", label, "predicted").collect()
    assert rows.count() == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert auc([r[1] for r in x], np.array([r.score for r in x])) >= least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in x)


def test_models_without_labels(spark, odd):
    for m, score in ((quality.fit([(1, "a b", 1)]), quality.score_quality), (toxicity.fit([(1, "a b", 1)]), toxicity.score_toxicity)):
        rows = score(odd, m).collect()
        assert len(rows) == 10 and {r.score for r in rows} == {0.5}
    assert quality.score_quality(odd.limit(0), quality.fit([(1, "a", 1)])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_the_automaton_against_edit_distances():
    terms = ["idiot", "moron", "abcd*", "wortlosigkeit", "ox"]
    a, r = toxicity.Automaton(terms), random.Random(0)
    for _ in range(3000):
        w = list(r.choice(["idiot", "moron", "abcdxyz", "wortlosigkeit", "ox", "hello"]))
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randrange(2)] = r.choice(["", "x", "o", "d"])
        w = "".join(w)
        best = None
        for k, t in enumerate(terms):
            d = min(distance(w[:n], t[:-1]) for n in range(len(w) + 1)) if t.endswith("*") else distance(w, t)
            if d <= toxicity.edits_allowed(t.rstrip("*")):
                best = min(best or (99, 0), (d, k))
        assert a.match(w) == best, w


def test_quotation_is_told_from_abuse():
    m = toxicity.Model(["idiot"])
    hits = lambda t: [(h[3], h[4]) for h in m.hits(t)[0]]
    assert hits('the word "idiot" is old') == [(True, False)] and hits("you are an idiot") == [(False, True)]
    assert hits("she said idiot was a word") == [(True, False)] and m.hits("an idiott!")[0][0][1] == 1 and hits("") == []


# -- surrogates --


def rows_of(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"entities": F.lit("x"), "kind": F.lit("y")})
    return sorted(surrogates.replace(df, **more).collect())


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_surrogates(spark):
    r = random.Random(0)
    cards = [c for c in ("".join(r.choice("0123456789") for _ in range(16)) for _ in range(400)) if luhn(c)]
    texts = [
        "x.19@mail5.example.com X.19@MAIL5.EXAMPLE.COM y.19@mail5.example.com", "+1 (499) 555-6503 and (499) 555-6503 and (499) 555-6504", " ".join(cards), "4111111111111112 v2.0. 1.2.3",
        "8.196.197.208 8.196.197.209", 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"###', "Mrs. Anna Smith, Mr. John Smith, Mr. Smith, Dr. Müller", None, "", "DE89 3704 0044 0532 0130 00", "123-45-6789 000-12-3456", "4111111111111111 123 4111 1111 1111 1111 12",
    ]
    got = rows_of(spark, texts)
    a = got[0].text.split()
    assert a[0].upper() == a[1] and a[0] != a[2] and a[0].split("@")[1] == a[2].split("@")[1] and a[0] != "x.19@mail5.example.com"
    assert re.fullmatch(r"[a-z]\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a[0])
    p = got[1].text.split(" and ")
    assert p[0] == "+1 " + p[1] and p[1] != p[2] and re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", p[1]) and "555-6503" not in got[1].text
    new = got[2].text.split()
    assert all(map(luhn, new)) and len(set(new)) == len(set(cards)) and not set(new) & set(cards) and [c[0] for c in new] == [c[0] for c in cards]
    assert got[3].text == texts[3] and got[3].n_entities == 0
    ips = got[4].text.split()
    assert len(set(ips)) == 2 and all(0 <= int(o) < 256 for i in ips for o in i.split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', got[5].text) and got[5].text != texts[5]
    m = re.fullmatch(r"Mrs\. (\w+) (\w+), Mr\. (\w+) (\w+), Mr\. (\w+), Dr\. \w+", got[6].text)
    assert m[1].lower() in surrogates.FEMALE and m[3].lower() in surrogates.MALE and m[2] == m[4] == m[5] != "Smith"
    assert (got[7].text, got[7].n_entities, got[8].text) == (None, 0, "")
    iban = got[9].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert got[10].n_entities == 1 and got[10].text.endswith("000-12-3456") and not got[10].text.startswith("123-45")
    m = re.fullmatch(r"(4\d{15}) 123 (4\d{3} \d{4} \d{4} \d{4}) 12", got[11].text)
    assert m[1] == m[2].replace(" ", "") != "4111111111111111"
    assert rows_of(spark, texts[:1], key="other")[0].text != got[0].text


def test_permutations_have_no_collisions(spark):
    df = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("t"))
    assert df.select(surrogates.permuted(F.col("t"), "k", F.lit("x")).alias("s")).distinct().count() == 100
    assert surrogates.collisions(spark.createDataFrame([("a@b.com c@d.org",), ("A@B.com",)], "text string"), "k").count() == 0


def test_a_hundred_thousand_names_get_as_many(spark):
    """All names of three letters of some patterns, short ones that walk over listed names most often, and listed ones."""
    small = [a + b + c for a in "abdeilmnv" for b in "aeinorv" for c in "abeinos"]
    given = spark.createDataFrame([(x,) for x in sorted({*small, *surrogates.FEMALE, *surrogates.MALE})], "g string")
    family = spark.range(180).select(F.concat(F.lit("sm"), F.translate(F.lpad(F.col("id").cast("string"), 3, "0"), "0123456789", "aeioubcdfg")).alias("f"))
    docs = given.join(family).select(F.concat(F.lit("Dr. "), F.initcap("g"), F.lit(" "), F.initcap("f")).alias("text"))
    n = docs.count()
    assert n > 100_000 and docs.limit(0).union(docs).count() == n
    for key in ("k", "another"):
        assert surrogates.collisions(docs.where("text like '%Smaaa%'"), key).count() == 0
    out = surrogates.replace(docs.repartition(8), check=False)
    assert out.select("text").distinct().count() == n and out.where("n_entities <> 1").count() == 0


@pytest.mark.parametrize("old,new,kinds", [
    ("Dr. 王伟 came", r"Dr\. \p{Han}{2} came", ["person"]),
    ("王伟先生 田中さん 김철수 씨", r"\p{Han}{2}先生 \p{Han}{2}さん \p{Hangul}{3} 씨", ["person"] * 3),
    ("Anna Schmidt wrote to John Smith", r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}{5}t wrote to \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}{3}h", ["person"] * 2),
    ("Mr. Łukasz Żółć and Ms. Anna-Maria Ёё", r"Mr\. \p{Latin}{5}z \p{Latin}{3}ć and Ms\. \w+-\w+ \p{Cyrillic}{2}", ["person"] * 2),
    ("г-жа Анна Петрова", r"г-жа \p{Cyrillic}+ \p{Lu}\p{Cyrillic}{5}а", ["person"]),
    ("+49 30 1234567 or +353 1 234 5678 or +7 495 123 4567", r"\+49 \d\d \d{7} or \+353 \d \d{3} \d{4} or \+7 \d{3} \d{3} \d{4}", None),
    ("3782 822463 10005 and 5555555555554444", r"37\d\d \d{6} \d{5} and 55\d{14}", ["card"] * 2),
    ("token = 'abcdef0123456789' token = 'zbcdef0123456789'", r"token = '[a-f]{6}\d{10}' token = '[g-z][a-f]{5}\d{10}'", ["secret"] * 2),
    ("Smith Anna, a Mister, Drs. of the house", "Smith Anna, a Mister, Drs\\. of the house", []),
])
def test_what_is_kept_and_what_is_not(spark, old, new, kinds):
    import regex

    (r,) = rows_of(spark, [old])
    assert regex.fullmatch(new, r.text), r.text
    assert kinds is None or [e.kind for e in r.entities] == kinds
    assert r.text != old or not r.n_entities
    letters = lambda t: [c for w in regex.findall(r"\w+", t) for c in w if ord(c) > 127 or c.isdigit()]
    assert not r.n_entities or letters(old) != letters(r.text) or not letters(old)


def test_names_keep_their_gender_whatever_the_key(spark):
    for key in ("a", "b", "c"):
        known = surrogates.next_names(key)
        assert sorted(known) == sorted(known.values()) and all(x != y for x, y in known.items())
        assert all((x in surrogates.FEMALE) == (y in surrogates.FEMALE) for x, y in known.items())
    assert surrogates.next_names("a") != surrogates.next_names("b")


class PlainSurrogates:
    """The same in plain Python, a match at a time."""

    def __init__(self, key):
        import regex

        java = surrogates.ENTITY.replace(r"\p{IsHan}", r"\p{Han}").replace(r"\p{IsHangul}", r"\p{Hangul}").replace(r"\p{IsHiragana}", r"\p{Hiragana}").replace(r"\p{IsKatakana}", r"\p{Katakana}")
        self.key, self.find, self.known = key, regex.compile(java, regex.V1), surrogates.next_names(key)

    def prf(self, k, *parts):
        import hashlib

        return hashlib.sha256("\x1f".join([f"{self.key}\x1e{k}", *parts]).encode()).hexdigest()

    def shift(self, part, seed, classes):
        import struct

        import xxhash

        out = ""
        for i, c in enumerate(part):
            by = xxhash.xxh64_intdigest(struct.pack("<i", i), seed=xxhash.xxh64_intdigest(seed.encode(), seed=42)) >> 33
            letters = next((x for x in classes if c in x), None)
            out += letters[(letters.index(c) + by) % len(letters)] if letters else c
        return out

    def permuted(self, text, tweak, secret=False):
        a, b = text[: len(text) // 2], text[len(text) // 2 :]
        classes = surrogates._SECRET if secret else surrogates._PLAIN
        for k in range(4):
            if k % 2:
                b = self.shift(b, self.prf(k, tweak, a), classes)
            else:
                a = self.shift(a, self.prf(k, tweak, b), classes)
        return a + b

    def recased(self, old, new):
        return "".join(n.upper() if o != o.lower() else n for o, n in zip(old, new))

    def filled(self, form, signs):
        it = iter(signs)
        return "".join(next(it) if c.isalnum() else c for c in form)

    def pair(self, a, b, m, n, tweak):
        import xxhash

        for k in range(4):
            move = xxhash.xxh64_intdigest(self.prf(k, tweak, str(a if k % 2 else b)).encode(), seed=42)
            move -= (move >> 63) << 64
            a, b = (a, (b + move) % n) if k % 2 else ((a + move) % m, b)
        return a, b

    def one(self, m):
        d = "".join(c for c in m if c.isdigit())
        if "@" in m:
            local, host = m.split("@")
            host, end = host.rsplit(".", 1)
            return self.recased(local, self.permuted(local.lower(), "local" + m.split("@")[1].lower())) + "@" + self.recased(host, self.permuted(host.lower(), "host")) + "." + end
        if re.match("[A-Za-z]", m):
            at = re.match(r"(.*?[:=][ \t]{0,4}[\"']?)(?=\S+$)", m)
            rest = m[at.end() if at else 0 :]
            begin = re.match("(?:AKIA|ASIA|gh[pousr]_|sk-)?", rest)[0]
            rest = rest[len(begin) :]
            return (at[0] if at else "") + begin + self.recased(rest, self.permuted(rest.lower(), "secret", True))
        if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
            a, b = int(d[:3]), (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1
            a, b = self.pair(a - 1 - (a > 666), b, 898, 99 * 9999, "ssn")
            return self.filled(m, f"{a + 1 + (a >= 665):03}{b // 9999 + 1:02}{b % 9999 + 1:04}")
        if m[0] in "+(" or re.fullmatch(r"\d{3}-\d{3}-\d{4}", m):
            country = re.match(rf"[17]|{surrogates._TWO_DIGITS}|\d{{3}}", d)[0] if m[0] == "+" else ""
            return self.filled(m, country + self.permuted(d[len(country) :], "phone"))
        if "." in m:
            o = list(map(int, m.split(".")))
            a, b = self.pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4")
            return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        if luhn(d):
            body = d[:2] + self.permuted(d[2:-1], "card" + d[:2])
            return self.filled(m, next(body + c for c in "0123456789" if luhn(body + c)))
        return None

    def replace(self, text):
        found = 0

        def change(m):
            nonlocal found
            new = self.one(m[0])
            found += new is not None
            return m[0] if new is None else new

        return "\n".join(self.find.sub(change, line) for line in text.split("\n")), found


def test_op1(spark, data, texts):
    rows = {r.doc_id: r for r in op1_surrogates(spark, data).collect()}
    plan = op1_surrogates(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    plain, entities = PlainSurrogates(surrogates.KEY), 0
    for r in texts.collect():
        got = rows.pop(r.doc_id)
        assert (got.text, got.n_entities) == (plain.replace(r.text) if r.text is not None else (None, 0))
        entities += got.n_entities
    assert not rows and entities


def test_surrogates_of_odd_rows(spark, odd):
    rows = surrogates.replace(odd).collect()
    assert len(rows) == 10 and all(r.n_entities == 0 for r in rows) and {r.text for r in rows} == {r.text for r in odd.collect()}
    assert rows[0].score == 0.5 and rows[0].found == [1]
    assert surrogates.replace(odd.limit(0)).count() == 0


# -- near copies --


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        out.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def plain_components(ids, sets):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for k in range(len(ids)):
        best[find(k)] = min(best.get(find(k), ids[k]), ids[k])
    return [best[find(k)] for k in range(len(ids))]


def families(seed, n, words):
    """Texts near one another and near the threshold, short ones, shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    passage = r.choices(vocabulary, k=50)
    out = ["", " ", "a", "A", "b c d e", "B c D e", "a b c d e f"]
    for _ in range(n):
        base = r.choices(vocabulary, k=r.choice([5, 6, 12, 40, 120]))
        for _ in range(r.randrange(1, 7)):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(t) // 30)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            if r.random() < 0.3:
                t = t + r.choices(vocabulary, k=r.randrange(6))
            if r.random() < 0.2:
                t = passage + t
            out.append(r.choice([" ", "\n"]).join(t))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [False, True])
def test_components_against_all_pairs(spark, monkeypatch, parts):
    if parts:
        monkeypatch.setattr(jaccard_join, "PART_DOCS", 3)
    texts = families(5 + parts, 60, 30 if parts else 400)
    ids = [3 * k + 1 for k in range(len(texts))]
    sets = plain_sets(texts)
    got = {r.doc_id: r for r in jaccard_join.near_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_shingles for i in ids] == list(map(len, sets))
    assert [got[i].component_id for i in ids] == plain_components(ids, sets)


def test_blocks_against_all_pairs():
    for seed in range(8):
        texts = [t for t in families(seed, 25, 25) if t.strip()]
        members = list(shingles.sets(__import__("pyarrow").array(texts)))
        links = jaccard_join.link_block(members)
        sets = plain_sets(texts)
        assert all(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i, j in links)
        root = list(range(len(texts)))
        for i, j in links:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        first = {}
        want = plain_components(list(range(len(texts))), sets)
        for k in range(len(texts)):
            assert first.setdefault(root[k], want[k]) == want[k]
        assert len(set(root)) == len(set(want))


def marks_batch(part):
    import pyarrow as pa

    c = list(zip(*part))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["sig", "node", "low", "high", "place", "other"])


def test_a_signature_over_many_batches_ties_all_its_rows(monkeypatch):
    r = random.Random(4)
    rows = sorted((r.choice([1, 1, 1, 2, 3]), r.randrange(90, 100), k) for k in range(200))
    rows = [(s, k, n, n, 50, None) for s, n, k in rows]
    for held in (5, 100_000):
        monkeypatch.setattr(jaccard_join, "MOST_HELD", held)
        root = list(range(200))
        for out in jaccard_join._ties(marks_batch(rows[i : i + 7]) for i in range(0, 200, 7)):
            for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
        assert len({root[x[1]] for x in rows}) == 3 and all(len({root[x[1]] for x in rows if x[0] == s}) == 1 for s in (1, 2, 3))


@pytest.mark.parametrize("held", [3, 100_000])
def test_signatures_that_tasks_have_tied_lose_no_tie(monkeypatch, held):
    """Sets of one signature, dealt to tasks that tie their own: all whose sizes a chain of others bridges are connected,
    and others are not."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard_join, "MOST_HELD", held)
    r = random.Random(7)
    for turn in range(30):
        sizes = {k: r.choice([5, 6, 7, 40, 50, 60, 70, 200, 1000]) for k in range(r.randrange(2, 80))}
        tasks = [[k for k in sizes if r.random() < 0.5] for _ in range(4)]
        tasks.append([k for k in sizes if not any(k in t for t in tasks)])
        made = []
        for t in tasks:
            monkeypatch.setattr(jaccard_join, "_different", lambda batches: ((k, np.arange(sizes[k])) for k in t))
            monkeypatch.setattr(jaccard_join, "signatures_of", lambda s, often, rank: np.array([7], np.int64))
            for b in jaccard_join._signatures(None, None)(iter([])):
                made += [tuple(c[i].as_py() for c in b.columns) for i in range(b.num_rows)]
        assert len([x for x in made if x[5] is None]) < len(sizes) * 4 + 1
        made.sort(key=lambda x: (x[0], x[2], x[1]))
        root = {k: k for k in sizes}
        for out in jaccard_join._ties(marks_batch(made[i : i + 5]) for i in range(0, len(made), 5)):
            for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                x, y = root[a], root[b]
                root = {k: min(x, y) if z in (x, y) else z for k, z in root.items()}
        order = sorted(sizes.values())
        for a in sizes:
            for b in sizes:
                if sizes[a] <= sizes[b] and 5 * sizes[a] >= 4 * sizes[b] and len(sizes) > jaccard_join.SMALL:
                    assert root[a] == root[b], (turn, sizes[a], sizes[b], order)


def test_many_near_copies_in_parts(spark, monkeypatch):
    """One large family of near copies, families that share its words but not enough, and links through single documents."""
    monkeypatch.setattr(jaccard_join, "PART_DOCS", 8)
    r = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for k in range(150):
        t = list(base)
        for _ in range(r.randrange(3)):
            t[r.randrange(80)] = f"x{r.randrange(50)}"
        texts.append(" ".join(t))
    for k in range(60):
        texts.append(" ".join(base[: r.randrange(40, 80)] + [f"y{r.randrange(9)}" for _ in range(r.randrange(30))]))
    r.shuffle(texts)
    ids = [2 * k + 5 for k in range(len(texts))]
    sets = plain_sets(texts)
    got = {r.doc_id: r for r in jaccard_join.near_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert [got[i].component_id for i in ids] == plain_components(ids, sets)


def test_op2(spark, data, texts):
    rows = sorted((r.doc_id, r.text) for r in texts.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_jaccard(spark, data).collect()}
    ids, sets = [i for i, _ in rows], plain_sets([t for _, t in rows])
    assert [got[i] for i in ids] == list(zip(map(len, sets), plain_components(ids, sets)))


def test_near_copies_of_odd_rows(spark, odd):
    rows = jaccard_join.near_components(odd).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5} and {r.component_id for r in rows if r.doc_id is None} == {None}
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 1), (0, 2), (0, 3)}
    assert jaccard_join.near_components(odd.limit(0)).count() == 0


def test_links_of_a_group_become_stars():
    assert sorted(jaccard_join._stars([(5, 9), (9, 2), (7, 8), (8, 7), (2, 5)])) == [(5, 2), (8, 7), (9, 2)]
    assert jaccard_join._stars([]) == []


def test_ids_with_several_texts_connect_their_copies(spark):
    """Id 3 has a text of either family, so both are one component, also where each is a group of its own."""
    one, two = ([" ".join(f"{w}{i}" for i in range(40)) + f" end{k}" for k in range(4)] for w in "pq")
    rows = [(1, one[0]), (3, one[1]), (5, one[2]), (2, two[0]), (3, two[1]), (6, two[2]), (9, "alone with words of its own here")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (3, 1), (5, 1), (2, 1), (6, 1), (9, 9)}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 450)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(500):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_components_of_paths_and_random_links(spark):
    rng = np.random.default_rng(5)
    path = rng.permutation(400)
    links = [(int(a), int(b)) for a, b in zip(path[:-1], path[1:])] + [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 300, (260, 2))] + [(5000, 5000), (5001, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in root} and len(got) == len(root)
