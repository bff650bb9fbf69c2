"""Details in notes."""

import pytest

from tests.conftest import all_rows
from tidegate.llm import pii

GIVEN = frozenset("amara daniel petra will yusuf kit".split())
COMMON = frozenset("met at the fair per do not contact dear thank you will decide grace for call queue signed by says flat is vacant and asked tel left msg w with on file brother pay thx".split())
KNOWN = pii.Disclosure(GIVEN, frozenset(("will",)), COMMON, frozenset(("signed by", "msg w", "^ dear", "^ met", "^ per", "^ thx")), frozenset(("says", "thank")), frozenset(("on file", "id")))


def kinds(note):
    return [(kind, note[a:b]) for a, b, kind in pii.find_details(note, KNOWN)]


@pytest.mark.parametrize(
    "note, want",
    [
        ("met Amara Zolerok at the fair", [("name", "Amara Zolerok")]),
        ("dear DANIEL VOKARG thank you", [("name", "DANIEL VOKARG")]),
        ("signed by petra lofimop", [("name", "petra lofimop")]),
        ("left msg w/ Zolerok, Yusuf, tel 555.010.2345", [("name", "Zolerok, Yusuf"), ("phone", "555.010.2345")]),
        ("per A. D'Zolerok: do not contact at +1 (555) 010-2345", [("name", "A. D'Zolerok"), ("phone", "+1 (555) 010-2345")]),
        ("Zolerok, Sandy says the flat is vacant", [("name", "Zolerok, Sandy")]),
        ("Daniel's brother will pay", [("name", "Daniel")]),
        ("grace for the Will call queue; will decide", []),
        ("signed by Will", [("name", "Will")]),
        ("Xenia Zolerok says the flat at 147B Saddler St. is vacant", [("name", "Xenia Zolerok"), ("street", "147B Saddler St.")]),
        ("mail a.b+c@mail.example, a [dot] b (at) mail [dot] example; x_y @ z.test", [("email", "a.b+c@mail.example"), ("email", "a [dot] b (at) mail [dot] example"), ("email", "x_y @ z.test")]),
        ("api@v2 errors; contact at docs.example/help; @northdesk", []),
        ("ssn on file 972456215; case 972456215; id 916 25 6459 / mob 5550102345", [("id_number", "972456215"), ("id_number", "916 25 6459"), ("phone", "5550102345")]),
        ("verified G2077901X by phone 001-555-010-3569", [("id_number", "G2077901X"), ("phone", "001-555-010-3569")]),
        ("PO 2761 99 3934, order 62080-1314, invoice 2024-555-0590, serial 979-84-55610, ticket 0941-02-53, batch +1 512 635, version 4.34.5579, score 979/345", []),
        ("ph.555-2409 (home), tel:+44 20 7946 0550", [("phone", "555-2409"), ("phone", "+44 20 7946 0550")]),
        ("moved to 125 Beacon Hill Blvd; see lane 12 at the depot; the High Street campaign", [("street", "125 Beacon Hill Blvd")]),
        ("60B rue des Tilleuls; ul. Lipowa 204; Lindenstraße 91; Am Alten Markt 119; Rua das Oliveiras, 107B; 12 Angry Ducks tour", [("street", x) for x in ("60B rue des Tilleuls", "ul. Lipowa 204", "Lindenstraße 91", "Am Alten Markt 119", "Rua das Oliveiras, 107B")]),
    ],
)
def test_details(note, want):
    assert kinds(note) == want


def test_redaction_keeps_the_rest():
    assert pii.redact("met Amara Zolerok at the fair,\ntel 555.010.2345!", KNOWN) == "met [NAME] at the fair,\ntel [PHONE]!"
    assert pii.redact(None, KNOWN) is None and pii.redact("", KNOWN) == "" and pii.redact(" \n", KNOWN) == " \n"
    long = "met Amara Zolerok at the fair; " * 2000
    assert pii.redact(long, KNOWN).count("[NAME]") == 2000


def test_found(spark):
    people = ["Amara", "Daniel", "Petra", "Yusuf", "Quentin"]
    syllables = ["zo", "le", "rok", "vi", "ma", "tul", "ke", "bar"]
    surname = lambda i: (syllables[i % 8] + syllables[i // 8 % 8] + syllables[(i * 5 + 3) % 8] + syllables[i // 3 % 8] + "sk").title()
    rows = []
    for i in range(400):
        g, s = people[i % 5], surname(i)
        note = [f"signed by {g} {s}", f"met {g} {s} at the fair", "call went to voicemail", (f"dear {g} thank you, ticket 0941-02-{i}" if i % 9 else f"dear {g} {s} thank you, ticket 0941-02-{i}"), None, ""][i % 6]
        rows.append((i, f"{people[(i * 3) % 5]} {surname(i + 77)}", note, 1))
    customers = spark.createDataFrame(rows, "rec_id long, full_name string, internal_notes string, found int")
    lines = spark.createDataFrame([(1, '7,Petra Zolerok,a,,,30,1.5,free,2024-01-02,"signed by Petra Zolerok, 5550102345"'), (2, "7,x,y,Petra"), (3, None)], "line_id long, raw_line string")
    nick = spark.createDataFrame([("Dan", "Daniel")], "nickname string, given_name string")
    got = all_rows(pii.found(customers, lines, nick))
    assert ("etl_lines", 1, "name", "Petra Zolerok") in got and ("etl_lines", 1, "phone", "5550102345") in got
    names = {r[1]: r[3] for r in got if r[0] == "customer_export"}
    assert names == {i: (f"{people[i % 5]} {surname(i)}" if i % 6 < 2 or i % 9 == 0 else people[i % 5]) for i in range(400) if i % 6 in (0, 1, 3)}
    clean = {(r.tbl, r.row_key): r.clean for r in pii.redacted(customers, lines, nick).collect()}
    assert clean["customer_export", 0] == "signed by [NAME]" and clean["customer_export", 4] is None and clean["customer_export", 5] == ""
    assert pii.found(customers.limit(0), lines.limit(0), nick.limit(0)).count() == 0


def test_numbers_are_told_by_what_announces_them(spark):
    """Nine bare digits: the words before them decide, whatever the words are."""
    note = ["badge shown, 955-21-{0:04}", "badge shown, 9552{0:05}", "claim no. 12-{0:05}", "claim no. 1234{0:05}", "permit N{0:07}Q seen", "permit 5552{0:05} seen", "12345{0:04} alone"]
    rows = [(i, "Amara Zolerok", note[i % 7].format(i), None) for i in range(700)]
    customers = spark.createDataFrame(rows, "rec_id long, full_name string, internal_notes string, extra string")
    lines = spark.createDataFrame([], "line_id long, raw_line string")
    nick = spark.createDataFrame([("Dan", "Daniel")], "nickname string, given_name string")
    got = {r.row_key: r.found for r in pii.found(customers, lines, nick).where("kind = 'id_number'").collect()}
    assert set(got) == {i for i in range(700) if i % 7 in (0, 1, 4, 5)} and got[1] == "955200001" and got[5] == "555200005"


@pytest.mark.parametrize("copies", [1, 40])
def test_copies_count_in_the_statistics(spark, copies):
    """A note that stands forty times in the corpus weighs forty times as much."""
    notes = spark.createDataFrame([("badge shown, 955-21-0001",)] * copies + [("badge shown, code 11-2",)] * 20, "note string")
    empty = spark.createDataFrame([], "full_name string")
    d = pii.learn(empty, spark.createDataFrame([], "nickname string, given_name string"), notes)
    assert ("badge" in d.common) and ("code" in d.common)
    assert ("badge shown" in d.announce) is (copies == 40)
    assert pii.announced("x badge shown, 123456789", 15) == ("badge shown", "shown") and pii.announced("123456789", 0) == ("", "")


def test_stored_contexts_are_those_of_a_note(spark):
    """The aggregates over the table of words see the contexts that the search for names sees."""
    notes = ["met Amara Zolerok at the fair; tel 555.010.2345, per Daniel", "dear DANIEL, thank you", "12 a@b.example Kit's flat - is vacant. and", "", "w"]
    common, given = frozenset("met at the fair dear thank you flat is and w".split()), frozenset("amara daniel kit".split())
    want = sorted((t.low, *c) for n in notes for s in [pii.formed(n)] for k in [pii.words(n, s)] for t, c in zip(k, pii.contexts(n, k, s, common)))
    table = spark.createDataFrame([(n, 2) for n in notes], "note string, copies long").mapInArrow(pii._part, pii.WORDS)
    seen = pii._flagged(pii._words(table), common, given).collect()
    assert sorted((r.word, r.before, r.after) for r in seen) == want and {r.copies for r in seen} == {2}
