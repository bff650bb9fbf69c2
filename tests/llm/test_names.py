"""Linking of spellings: the comparison, the index, components and whole pairs."""

import difflib
import random

import pytest

from tests.conftest import all_rows
from tidegate.llm import names

NICK = [("Bill", "William"), ("Ola", "Aleksandra"), ("Tina", "Christina"), ("Tina", "Ernestine"), ("Fritz", "Frederick")]
PEOPLE = "rec_id long, full_name string, email string, phone string, ssn string, entity int"


def test_subsequence_ratio():
    r = random.Random(3)

    def slow(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return 2 * table[-1][-1] / (len(a) + len(b))

    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(1, 90))) for _ in range(2))
        assert names.lcs_ratio(a, b) == pytest.approx(slow(a, b))
    assert names.lcs_ratio("", "a") == 0 and names.lcs_ratio("", "") == 1
    assert difflib.SequenceMatcher(None, "ab", "ab").ratio() == names.lcs_ratio("ab", "ab")


@pytest.fixture(scope="module")
def compare():
    table = {"bill": {"bill", "william"}, "william": {"william"}, "tina": {"tina", "christina"}, "joseph": {"joseph"}, "josephine": {"josephine"}}
    sectors = frozenset("manufacturing foods chemicals shipping".split())
    shares = {"joseph": 0.02, "josephine": 0.02, "william": 0.02, "christina": 0.02, "manufacturing": 0.005, "foods": 0.005, "chemicals": 0.005, "shipping": 0.005}
    return names.Comparer({k: frozenset(v) for k, v in table.items()}, frozenset(("joseph", "josephine", "william", "christina")), sectors, shares)


@pytest.mark.parametrize(
    "a, b, contact, same",
    [
        ("William Hajadesart", "Hajadesart, Bill", "phone", True),
        ("W. Hajadesart", "William Hajadesart", "phone", True),
        ("Wiliam Hajadesrt", "William Hajadesart", "phone", True),
        ("WilliamHajadesart", "William Hajadesart", "phone", True),
        ("Dr. William Q. Hajadesart", "HAJADESART William", "ssn", True),
        ("Joseph Hajadesart", "Josephine Hajadesart", "phone", False),
        ("Maria Hajadesart", "William Hajadesart", "phone", False),
        ("William Lolekort", "William Hajadesart", "phone", False),
        ("William Hajadesart", "Hajadesart, William", "", True),
        ("William Hajadesert", "William Hajadesart", "", False),
        ("William A. Hajadesart", "William B. Hajadesart", "", False),
        ("Nafofofilm Manufacturing Corp", "NM Corp", "email", True),
        ("Nafofofilm Mfg. Corporation", "The Nafofofilm Manufacturing Corp", "phone", True),
        ("Nafofofilm Foods Ltd", "Zasipejend Foods Ltd", "email", False),
        ("Zasipejend Chemicals G.m.b.H.", "Zasipejend Cheemicals GmbH", "email", True),
    ],
)
def test_comparison(compare, a, b, contact, same):
    def profile(name, other):
        return (names.name_form(name), *("x@y.z" if k == contact == "email" else "1" if k == contact else "" for k in ("email", "phone", "ssn")))

    assert compare.same(profile(a, b), profile(b, a)) is same
    assert compare.same(profile(b, a), profile(a, b)) is same


def test_contact_keys():
    assert names.email_key(" <A.B @ Mail.Example>;") == "a.b@mail.example"
    assert names.digits_key("+1 (555) 010-9999 x12", 10) == "5550109999" and names.digits_key("555-0100", 10) == ""
    assert names.name_words("“Dr. Zoë  O'Net0finomp”") == ["zoe", "onetofinomp"]


def test_found(spark):
    rows = [
        (1, "William Hajadesart", "wh@x.test", "555-010-0001", None, 0),
        (2, "HAJADESART, Bill", "wh@x.test", None, None, 0),
        (3, "Wiliam Hajadesart", None, "(555) 010 0001", None, 0),
        (4, "William Hajadesart", "wh@x.test", None, None, 0),
        (5, "Maria Hajadesart", "mh@x.test", "555-010-0001", None, 0),
        (6, None, "wh@x.test", None, None, 0),
        (7, " ", None, None, None, 0),
        (8, "x" * 50_000, None, None, None, 0),
    ]
    customers = spark.createDataFrame(rows, PEOPLE)
    show = spark.createDataFrame([(100, "Bill Hajadesart", "wh@x.test", None, None, 0)], PEOPLE)
    nick = spark.createDataFrame(NICK, "nickname string, given_name string")
    got = all_rows(names.found(customers, show, nick))
    assert got == sorted([(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (1, 100), (2, 100), (3, 100), (4, 100)], key=repr)
    assert names.found(customers.limit(0), show.limit(0), nick).count() == 0


def test_common_keys_are_refined(spark):
    """A contact value of many people links spellings, not people."""
    r, rows = random.Random(11), []
    for i in range(60):
        surname = "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(6))
        rows += [(2 * i, f"William {surname.title()}", None, "555 010 0000", None, 0), (2 * i + 1, f"{surname.title()}, W.", None, "5550100000", None, 0)]
    profiles = spark.createDataFrame(rows, PEOPLE)
    nick = spark.createDataFrame(NICK, "nickname string, given_name string")
    g = {r.rec_id: r.entity for r in names.groups(profiles, nick).collect()}
    assert all(g[2 * i] == g[2 * i + 1] for i in range(60))
    assert len(set(g.values())) > 50


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (100, 102)]
    got = dict(map(tuple, names.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def entities(spark, rows):
    nick = spark.createDataFrame(NICK, "nickname string, given_name string")
    return {r.rec_id: r.entity for r in names.groups(spark.createDataFrame(rows, PEOPLE), nick).collect()}


@pytest.mark.parametrize("n", [60, 500])
def test_common_surname(spark, n):
    """Nicknames and initials meet under a surname that many names have, whether it is frequent or not."""
    r = random.Random(n)
    rows = [(i, f"{''.join(r.choice('bdfgklmnprstvz') + r.choice('aeou') for _ in range(4)).title()} Richardson", f"m{i}@x.test", f"555 01{i:05}", None, 0) for i in range(10, n)]
    rows += [(1, "Bill Richardson", None, None, None, 0), (2, "William Richardson", None, None, None, 0), (3, "J. Richardson", None, None, None, 0), (4, "James Richardson", None, None, None, 0)]
    rows += [(5, "Christop Richardson", None, None, None, 0), (6, "Christopher Richardson", "c@x.test", "5550200000", None, 0)]
    g = entities(spark, rows)
    assert g[1] == g[2] and g[3] == g[4] and g[5] == g[6]
    assert len({g[1], g[3], g[5]}) == 3 and len(set(g.values())) >= n - 10


def test_name_keys_hold_every_link_without_contact():
    table = {k: frozenset(v) for k, v in {"bill": {"bill", "william"}, "will": {"will", "william"}, "william": {"william"}, "ola": {"ola", "aleksandra"}}.items()}
    compare = names.Comparer(table, frozenset(("william", "joseph", "josephine")))
    r = random.Random(5)
    given = ["bill", "will", "william", "w", "wil", "joseph", "josephine", "j", "jo", "jos", "ola", "aleksandra", "van", "lee"]
    forms = sorted({" ".join(sorted(r.sample(given, r.choice((1, 1, 2))) + r.choice((["richardson"], ["hajadesart"], ["richardson", "hajadesart"], ["lee"])))) for _ in range(150)} | {"acme inc"})
    for a in forms:
        for b in forms:
            for flags in ((0, 0), (1, 0), (0, 1)):
                if a != b and compare.same((a, "a" * flags[0], "", ""), (b, "b" * flags[1], "", "")):
                    met = [(ra, rb) for ka, ra in compare.name_keys(a) for kb, rb in compare.name_keys(b) if ka == kb]
                    assert any(not (ra and rb) for ra, rb in met), (a, b)


def test_near_holds_every_accepted_pair():
    table = {k: frozenset(v) for k, v in {"bill": {"bill", "william"}, "william": {"william"}}.items()}
    compare = names.Comparer(table, frozenset(("william", "joseph")))
    r = random.Random(7)
    base = ["william hajadesart", "bob lee", "lee bill", "nafofofilm manufacturing corp", "ibm inc", "nm corp", "international bureau machines inc", "joseph kolemanipa", "li wu", "hajadesart", "van tor bill"]
    forms = set(base)
    for _ in range(400):
        t = list(r.choice(base))
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], [t[k], r.choice("aeirst")], [r.choice("aeirst")]])
            t = t or ["a"]
        if form := names.name_form("".join(t)):
            forms.add(form)
    forms = sorted(forms)
    near = names.near(forms, forms, compare)
    accepted = [(i, j) for i, a in enumerate(forms) for j, b in enumerate(forms) if compare.same((a, "", "1", ""), (b, "", "1", ""))]
    assert len(accepted) > len(forms) and all(near[i, j] for i, j in accepted)


def test_no_cap_on_equal_names(spark):
    """More profiles of one organisation, and of one contact value, than any block held before."""
    rows = [(i, "Acme Inc" if i % 2 else "ACME, Inc.", f"a{i}@x.test", f"555 01{i:05}", None, 0) for i in range(450)]
    r = random.Random(13)
    for i in range(1000, 1450):
        surname = "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4))
        rows.append((i, f"William {surname.title()}son", None, "555 020 0000", None, 0))
    rows += [(2000, "Bill Vaquerillo", "v@x.test", "5550200000", None, 0), (2001, "Vaquerilo, William", "w@x.test", "5550200000", None, 0)]
    g = entities(spark, rows)
    assert {g[i] for i in range(450)} == {0} and g[2000] == g[2001] == 2000


def test_common_contact_compares_short_words(spark):
    """Under a phone of many names a pair meets whatever its words: acronyms, short words, initials."""
    r = random.Random(17)
    rows = [(i, f"{''.join(r.choice('bdgkpz') + r.choice('aeiou') for _ in range(4)).title()} {''.join(r.choice('bdgkpz') + r.choice('aeiou') for _ in range(5)).title()}", None, "555 030 0000", None, 0) for i in range(10, 70)]
    rows += [(1, "NM Corp", None, "5550300000", None, 0), (2, "Nafofofilm Manufacturing Corp", None, "5550300000", None, 0), (3, "Wu Li", "l@x.test", "5550300000", None, 0), (4, "W. Li", "w@x.test", "5550300000", None, 0)]
    g = entities(spark, rows)
    assert g[1] == g[2] == 1 and g[3] == g[4] == 3


def test_misspelt_without_common_contact(spark):
    rows = [(1, "Ragnar Tijolapaven", None, None, "993115870", 0), (2, "Ragnar Tiolapaven", "r@x.test", "3385551697", None, 0), (3, "Maria Tiolapaven", "m@x.test", None, None, 0), (4, "Ragnar Tijolapavem", None, "3385551698", None, 0)]
    g = entities(spark, rows)
    assert g[1] == g[2] and len({g[1], g[3], g[4]}) == 3


@pytest.mark.parametrize(
    "name, email, spelt",
    [
        ("Hkoalidar, Jo", "hokalidar_jos@x.test", "hokalidar jo"),
        ("Rboert Lavavidan", "robert.lavavidan+shop@x.test", "lavavidan robert"),
        ("Patty Dirodomiby", "patricia.dirodomiby@x.test", "dirodomiby patricia"),
        ("J. Behazolirg", "jamesbehazolirg+crm@x.test", "behazolirg james"),
        ("Josephine Pijaderoth", "jpijageroth7@x.test", "josephine pijageroth"),
        ("Maria Behazolirg", "james.behazolirg@x.test", "behazolirg maria"),
        ("Kegtzanart Foods Ltd", "info.kegezanart@x.test", "kegezanart foods ltd"),
        ("Bob Lee", "", "bob lee"),
        ("Bob Lee", "a.b.c.d.e.f@x.test", "bob lee"),
    ],
)
def test_reading(name, email, spelt):
    assert names.reading(names.name_form(name), email, {"bill": frozenset(("bill", "william"))}) == spelt


@pytest.mark.parametrize(
    "a, b, beside, same",
    [
        ("William Hajadesart", "Bill Hajadesart", 3, True),
        ("William Hajadesart", "Bill Hajadesart", 300, False),
        ("W. Hajadesart", "William Hajadesart", 3, True),
        ("W. Q. Hajadesart", "William Q. Hajadesart", 3, True),
        ("W. Q. Hajadesart", "William P. Hajadesart", 3, False),
        ("C. Hajadesart", "Tina Hajadesart", 3, True),
        ("Chris Hajadesart", "Christina Hajadesart", 3, True),
        ("Joseph Hajadesart", "Josephine Hajadesart", 2, False),
        ("Maria Hajadesart", "William Hajadesart", 2, False),
        ("Zasipejend Chem. GmbH", "Chemicals Zasipejend", 2, True),
        ("Zasipejend Shpg Ltd", "Zasipejend Shipping Ltd", 2, True),
        ("Zasipejend Foods Ltd", "Zasipejend Shipping Ltd", 2, False),
        ("Zasipejend Foods Ltd", "Hajadesart Foods Ltd", 2, False),
        ("Bob Lee", "B. Lee", 2, False),
    ],
)
def test_rare_names_alone(compare, a, b, beside, same):
    """Without any common contact; ``beside`` says how many given names the surname has in the corpus."""
    x, y = names.name_form(a), names.name_form(b)
    k = [{w: beside for w in n.split() if len(w) >= names.MIN_SUFFIX} for n in (x, y)]
    assert compare.same((x, "a@x.t", "1", "1"), (y, "b@x.t", "2", "2"), *k) is same
    assert compare.same((y, "b@x.t", "2", "2"), (x, "a@x.t", "1", "1"), *k[::-1]) is same
    if same:
        met = [(ra, rb) for ka, ra in compare.name_keys(x) for kb, rb in compare.name_keys(y) if ka == kb]
        assert any(not (ra and rb) for ra, rb in met)


def test_changed_contacts(spark):
    """Everything but the name has changed: suffix keys alone bring the pairs together."""
    r, rows = random.Random(23), []
    for i in range(400):
        surname = "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)).title() + "sk"
        first = ("Joseph", "William", "Christina", "Frederick", "Zelda", "Ragnar", "Ulrike", "Amara")[i % 8]
        short = {"William": "Bill", "Frederick": "Fritz"}.get(first, first[0] + ".")
        rows += [(4 * i, f"{first} {surname}", f"a{i}@x.test", f"555 01{i:05}", None, 0), (4 * i + 1, f"{surname}, {short}", f"b{i}@y.test", f"555 02{i:05}", None, 0)]
        rows.append((4 * i + 2, f"{first} {surname[:4]}{surname[4]}{surname[4:]}", f"{first}.{surname}@z.test", f"555 03{i:05}", None, 0))
    g = entities(spark, rows)
    assert all(g[4 * i] == g[4 * i + 1] == g[4 * i + 2] for i in range(400))
    assert len(set(g.values())) >= 395
    table = {"bill": frozenset(("bill", "william")), "william": frozenset(("william",))}
    compare = names.Comparer(table, frozenset(("william", "joseph")))
    for a, b in (("hajadesart william", "hajadesart w"), ("hajadesart william", "hajadesrt william")):
        met = {ka for ka, _ in compare.name_keys(a)} & {kb for kb, _ in compare.name_keys(b)}
        assert {k[0] for k in met} <= {"s", "x"}


def test_components_of_long_chains(spark):
    """More rounds than any fixed number: a path whose ids rise and fall."""
    r = random.Random(3)
    ids = list(range(600))
    r.shuffle(ids)
    got = dict(map(tuple, names.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()))
    assert set(got.values()) == {0} and len(got) == 600


def test_acronyms_are_companies(compare):
    for contact in ("email", "phone"):
        profile = lambda w: (w, *("x" if k == contact else "" for k in ("email", "phone", "ssn")))  # noqa: B023, E731
        assert compare.same(profile("ns corp"), profile("nafofofilm shipping corp")) and compare.same(profile("ns corp"), profile("nafofofilm shipping"))
    assert not compare.company(["js", "inc"], ["jadebelond", "soren"])


def test_every_nickname_counts(spark):
    """No bound on the rows of the nickname table."""
    rows = [(f"Nick{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}", f"Given{i % 7}") for i in range(25_000)]
    table = names._nicknames(spark.createDataFrame([*rows, (None, "Ann"), ("Zzz", None), *NICK], "nickname string, given_name string"))
    assert len(table) >= 25_000 and table["bill"] >= {"bill", "william"} and table["william"] >= {"william"}


def _spellings(seed: int, n: int) -> list[str]:
    """Names of one to seven words, misspelt, cut off, joined, with initials, particles, legal forms and words of any length."""
    r = random.Random(seed)
    given = ["abigail", "bill", "william", "willy", "christina", "tina", "christian", "anna", "hanna", "johanna", "li", "bo", "josé", "żaneta"]
    surname = ["".join(r.choice("bdgklmnr") + r.choice("aeio") for _ in range(r.choice((2, 3, 4, 5)))) for _ in range(25)] + ["lee", "wu", "x" * 70, "abcdefghij" * 7]
    firm = ["foods", "shipping", "manufacturing", "corp", "inc", "gmbh", "mfg", "ns", "ibm"]
    out = set()
    while len(out) < n:
        ws = [r.choice(given) for _ in range(r.choice((0, 1, 1, 1, 2)))] + [r.choice(surname) for _ in range(r.choice((1, 1, 1, 2)))]
        ws += [r.choice("abhtw")] * (r.random() < 0.3) + ["van"] * (r.random() < 0.1) + [r.choice(firm) for _ in range(r.choice((0, 0, 0, 1, 2)))] + [r.choice(given) for _ in range(3 * (r.random() < 0.05))]
        t = list(" ".join(ws))
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], [t[k], r.choice("aeirst")], [r.choice("aeirst")], [t[k]] * 3])
            t = t or ["a"]
        if form := names.name_form("".join(t)):
            out.add(form)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_holds_every_accepted_spelling(seed):
    table = {"bill": {"bill", "william"}, "willy": {"willy", "william"}, "william": {"william"}, "tina": {"tina", "christina"}, "christina": {"christina"}}
    given, sectors = frozenset(("william", "christina", "christian", "abigail")), frozenset(("foods", "shipping", "manufacturing"))
    compare = names.Comparer({k: frozenset(v) for k, v in table.items()}, given, sectors)
    forms = _spellings(seed, 500)
    left, right = forms[::2], forms[1::2]
    near = names.near(left, right, compare)
    accepted = [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if compare.same((a, "", "1", ""), (b, "", "1", "")) or compare.same((b, "", "1", ""), (a, "", "1", ""))]
    assert len(accepted) > 100 and not [(left[i], right[j]) for i, j in accepted if not near[i, j]]


def test_near_follows_the_names_not_their_pairs(compare):
    """Names of one given name meet only if their surnames agree: of a contact value of many names few pairs are compared."""
    assert not names.near(["nolerotess william"], ["hetegoreth william", "hetegoreth joseph", "hetegoreth n william"], compare).any()
    r = random.Random(29)
    surname = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(5))
    forms = sorted({names.name_form(f"{r.choice(('William', 'Joseph', 'Christina', 'Zelda', 'Soren'))} {surname()} {r.choice('abc')}") for _ in range(800)})
    assert names.near(forms, forms, compare).sum() < 3 * len(forms)  # a name and itself, and little else


def test_every_strip_meets(spark, monkeypatch):
    """Strips of a few names against the half that follows them give the links of all pairs."""
    monkeypatch.setattr(names, "STRIP", 40)
    forms = _spellings(3, 330)
    compare = names.Comparer({"bill": frozenset(("bill", "william")), "william": frozenset(("william",))}, frozenset(("william",)), frozenset(("foods", "shipping")))
    ids = list(range(len(forms)))
    random.Random(4).shuffle(ids)
    rows = [(k, w, "", phone, "", w) for n, phone in ((330, "1"), (110, "2")) for k, w in ((k + 1000 * int(phone), w) for k, w in zip(ids[:n], forms))]
    got = names.link_contacts(spark.createDataFrame(rows, "pid long, words string, email string, phone string, ssn string, spelt string"), lambda: compare, 5)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] == b[3] and compare.same((a[1], "", "1", ""), (b[1], "", "1", ""))}
    assert len(want) > 100 and {tuple(x) for x in got.collect()} == want
