"""Items in single texts, decoys, and whole tables against a plain loop."""

import random
import time
from datetime import datetime, timedelta

import pytest

from tidelog.llm import pii

FINDER = pii.Finder(["Robert", "Ngozi", "Rosa", "Dmitri"])
CASES = [
    ("Um, mail me at r.holokar+x@mail.fernby.test, thanks", [("email", "r.holokar+x@mail.fernby.test")]),
    ("it bounced for <LARS11@INBOX.EXAMPLE>", [("email", "LARS11@INBOX.EXAMPLE")]),
    ("cc rosa.k at post dot lumen dot example if it fails", [("email", "rosa.k at post dot lumen dot example")]),
    ("write to mei-4(at)saltwick(dot)invalid okay", [("email", "mei-4(at)saltwick(dot)invalid")]),
    ("contact: rosa42 [at] quietbox.test", [("email", "rosa42 [at] quietbox.test")]),
    ("tel. +44 7700 900762 after five", [("phone", "+44 7700 900762")]),
    ("(704) 555-0171 ext. 12 or 500.555.0100, 12085550175, 020 7946 0394", [("phone", "(704) 555-0171 ext. 12"), ("phone", "500.555.0100"), ("phone", "12085550175"), ("phone", "020 7946 0394")]),
    ("SSN 976481224. the social security number is 975-86-1718", [("id_number", "976481224"), ("id_number", "975-86-1718")]),
    ("her national insurance no is QQ 98 10 19 D; passport number reads K4368852", [("id_number", "QQ 98 10 19 D"), ("id_number", "K4368852")]),
    ("deliver it to flat 29, 25 Peartree Court, Brindleford", [("street_address", "25 Peartree Court")]),
    ("home address: 6057 east oldgate rd., apt 24b", [("street_address", "6057 east oldgate rd.")]),
    ("they moved to Via del Molino 77, ground floor; Birkenallee 42; Lindenhofstr. 7", [("street_address", "Via del Molino 77"), ("street_address", "Birkenallee 42"), ("street_address", "Lindenhofstr. 7")]),
    ("ship it to 94a Thornbury Rise Rd before Thursday", [("street_address", "94a Thornbury Rise Rd")]),
    ("met Ngozi Wésillilu of Tavorel Robotics with Robert J. Holokar", [("person_name", "Ngozi Wésillilu"), ("person_name", "Robert J. Holokar")]),
    ("on the list: Holokar, Rosa; the Mark IV lens", [("person_name", "Holokar, Rosa")]),
    ("So Dr. Hemenagum wants it, signed by V. Ursaloro and mrs pélfemo", [("person_name", "Hemenagum"), ("person_name", "V. Ursaloro"), ("person_name", "pélfemo")]),
    ("ask dmitri hémastulaf about the audit", [("person_name", "dmitri hémastulaf")]),
    ("İİ then Bob Holokar", [("person_name", "Bob Holokar")]),
    ("account 12345678901, acct no. 20-00-00 55779911", [("account_number", "12345678901"), ("account_number", "20-00-00 55779911")]),
    ("pay DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819", [("account_number", "DE89 3704 0044 0532 0130 00"), ("account_number", "GB29NWBK60161331926819")]),
    ("the account manager at 12085550175, sort code is 20-00-00", [("phone", "12085550175"), ("account_number", "20-00-00")]),
    ("it was 4111 1111 1111 1111 then", [("account_number", "4111 1111 1111 1111")]),
    ("tel:5550171 and mailto:rosa.k@a.test", [("email", "rosa.k@a.test"), ("phone", "5550171")]),
    ("Anneliese Kowalski called, my name is Wanda Orlik", [("person_name", "Anneliese Kowalski"), ("person_name", "Wanda Orlik")]),
    (f"{'a' * 90}@b.test or {'a' * 90} at {'b' * 90} dot test", [("email", f"{'a' * 90}@b.test"), ("email", f"{'a' * 90} at {'b' * 90} dot test")]),
    (f"at 12 {'Long' * 30} {'Peartree' * 4} Street; {'Holokar' * 9}, Rosa", [("street_address", f"12 {'Long' * 30} {'Peartree' * 4} Street"), ("person_name", f"{'Holokar' * 9}, Rosa")]),
]
DECOYS = [
    "the note on invoice 2024-0917, lot 77-1204, part no. 55-0188 and tracking code ZX-88-10-42",
    "the Alder Street project, the Grace period rule, the Rosewood table and Route 9 on page 212 of 340",
    "Speaker 2: met the print shop at Fernby market at 10:30 on the way home, 14 drafts, close to done",
    "Holokar Law Office and Tavorel Robotics; build 4.12.0; 18,000 lines at 7 a.m.. The answer was 2,750",
    "please look at the dot on the map, at noon (at least)",
    "see https://x.test/?id=12085550175&user=@me and 4111 1111 1111 1112",
    "Spring Street called, Tavorel Robotics said so and The Holokar Office wrote",
    "",
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_found(text, want):
    assert sorted((text.index(t), k, t) for k, t in want) == sorted((a, k, text[a:b]) for a, b, k in FINDER.find(text))


@pytest.mark.parametrize("text", DECOYS)
def test_decoys(text):
    assert FINDER.find(text) == []


def test_redacted():
    text = "ask Robert Holokar or mail a@b.test"
    assert pii.redacted(text, FINDER.find(text)) == "ask [PERSON_NAME] or mail [EMAIL]"
    long = " ".join(t for t, _ in CASES) * 200
    assert len(FINDER.find(long)) >= 200 * sum(len(w) for _, w in CASES) * 0.95


def test_linear_in_items():
    def took(n):
        text = "mail a@b.test or call 704-555-0171, Robert Holokar said. " * n
        t = time.process_time()
        pii.redacted(text, FINDER.find(text))
        return time.process_time() - t

    took(500)
    assert min(took(8_000) for _ in range(3)) < 4 * min(took(4_000) for _ in range(3))


def test_too_many_given_names(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_NAMES", 2)
    people = spark.createDataFrame([(f"{n} X",) for n in ("Ana", "Bea", "Ana")], "display_name string")
    assert {"ana", "bea"} <= pii.finder(people).given
    with pytest.raises(ValueError, match="given names"):
        pii.finder(people.union(spark.createDataFrame([("Cleo X",)], "display_name string")))


DDL = "id string, body string, received_at timestamp_ntz, text string, field int, pii_kind string"


def test_latest_delivery(spark):
    rnd = random.Random(1)
    t0, rows = datetime(2023, 1, 1), []
    for i in range(40):
        for _ in range(rnd.choice([1, 2, 3])):
            rows.append((f"k{i}", rnd.choice([None, "", *[t for t, _ in CASES], *DECOYS]), t0 + timedelta(hours=rnd.randint(0, 30) + 31 * len(rows)), "x", 1, "y"))
    rows += rows[:15] + [("none", CASES[0][0], None, "x", 1, "y")]
    df = spark.createDataFrame(rows, DDL)
    last = {}
    for r in rows:
        if r[0] not in last or r[2] and r[2] >= last[r[0]][2]:
            last[r[0]] = r
    want = sorted(("body", k, kind, a + 1, b - a) for k, r in last.items() for a, b, kind in FINDER.find(r[1] or ""))
    assert sorted(tuple(r) for r in pii.found(df, "id", ["body"], FINDER).collect()) == want
    clean = pii.cleaned(df, ["body"], FINDER)
    assert clean.schema == df.schema
    assert sorted(map(str, (r.body for r in clean.collect()))) == sorted(str(pii.redacted(r[1], FINDER.find(r[1])) if r[1] else r[1]) for r in rows)
    assert pii.found(df.limit(0), "id", ["body"], FINDER).count() == pii.cleaned(df.limit(0), ["body"], FINDER).count() == 0


def test_given_names(spark):
    people = spark.createDataFrame([("Tariq Wesevsear",), ("  tariq Bo",), (None,), ("Mononym",), ("Zoë-Ann X",)], "display_name string")
    assert {"tariq", "zoë-ann"} <= pii.finder(people).given and "mononym" not in pii.finder(people).given
