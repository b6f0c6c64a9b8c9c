"""Spellings by example, and labelled clusters held against the result."""

import pytest

from docuplane.llm import names as N
from docuplane.llm.components import components


@pytest.mark.parametrize(
    "raw, kind, name, given, initial, org",
    [
        ("Zachary Falsefaley", "person", "falsefaley", ["zachary"], "z", ""), ("Falsefaley, Zach", "person", "falsefaley", ["zachary"], "z", ""), ("FALSEFALEY, Z.", "person", "falsefaley", [], "z", ""),
        ("Dr. Matthias Orl, MSc", "person", "orl", ["matthias"], "m", ""), ("CORP\\zfalsefaley", "person", "falsefaley", [], "z", ""), ("z.falsefaley", "person", "falsefaley", [], "z", ""), ("zachary.falsefaley", "person", "falsefaley", ["zachary"], "z", ""),
        ("ZacharyFalsefaley", "person", "falsefaley", ["zachary"], "z", ""), ("Falsefaley_Zachary", "person", "falsefaley", ["zachary"], "z", ""), ("A. M. Fallo", "person", "fallo", [], "a", ""), ("Zachary Falsefaley <z@x.example>", "person", "falsefaley", ["zachary"], "z", ""),
        ("HÃ¤kan Nim (external)", "person", "nim", ["hakan"], "h", ""), ("Kvikavo Savings Bank", "org", "kvikavo", [], "", "sb"), ("Savings Bank of Kvikavo", "org", "kvikavo", [], "", "sb"), ("Kvikavo SB", "org", "kvikavo", [], "", "sb"),
        ("Harbour Auth. (Tarro), Ltd", "org", "tarro", [], "", "ha"), ("", "", "", [], "", ""), (None, "", "", [], "", ""), ("--", "", "", [], "", ""),
    ],
)
def test_read(raw, kind, name, given, initial, org):
    r = N.read_name(raw)
    assert (r["kind"], r["name"], r["given"], r["initial"], r["org"]) == (kind, name, given, initial, org)


def test_measures():
    assert [N.slips(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abdc"), ("abc", "ab"), ("abc", "axc"), ("abc", "xyz"), ("", "a"))] == [0, 1, 1, 1, 1, 2, 1]
    assert round(N.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(N.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133 and N.jaro_winkler("", "a") == 0


ENTITIES = [
    ["Giuseppe Pavhaldy", "Pavhaldy, Beppe", "G. Pavhaldy", "GIUSEPPE PAVHALDY", "Giusepee Pavhaldy", "Giuseppe Pavhadly", "LAN\\gpavhaldy", "Giuseppe  Pavhaldy ;"],
    ["Häkan Pavhaldy", "H. Pavhaldy", "hakan.pavhaldy", "Pavhaldy_Häkan"],
    ["Gabriel Orlnor", "Orlnor, Gabe"],
    ["Giuseppe Orlnor"],
    ["Kvikavo Savings Bank", "KVIKAVO SAVINGS BANK", "Kvikavo Svgs. Bank, Ltd", "The Kvikavo Savings Bank", "Kvikavo-Savings-Bank", "Kvikavo Svings Bank"],
    ["Kvikavo Water Department", "Water Dept. (Kvikavo)"],
]
AMBIGUOUS = ["G. Orlnor"]  # Gabriel or Giuseppe: linked with neither


def test_clusters(spark):
    rows, want = [], set()
    for e in ENTITIES:
        ids = []
        for n in e:
            ids.append(len(rows))
            rows.append((len(rows), "ix", n, 1))
        want |= {(a, b) for a in ids for b in ids if a < b}
    rows += [(len(rows) + i, "ix", n, 1) for i, n in enumerate(AMBIGUOUS)]
    rows += [(900, "other", "Giuseppe Pavhaldy", 0), (901, "ix", None, 0), (902, None, "Giuseppe Pavhaldy", 0), (903, "ix", "", 0), (904, "ix", "x" * 5000, 0)]
    df = spark.createDataFrame(rows, "value_id bigint, index_name string, creator string, entity int")
    got = [tuple(r) for r in N.entity_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert N.entity_pairs(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    links = spark.createDataFrame(chain + [(101, 100), (100, 101), (7, 7), (None, 3), (200, 200)], "a int, b int")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_names_in_another_order(spark):
    names = ["Kelvyn Smithson", "Smithson Kelvyn", "Smithson, Kelvyn", "Smithsn Kelvyn", "Kelvyn Brandt", "Smithson Arvid", "Marek Tolvan", "Tolvan, Marek", "Marek, Tolvan", "Harbour Quayside Ltd", "Quayside Harbour Ltd", "Quayside Lantern Ltd"]
    df = spark.createDataFrame([(i, "x", n) for i, n in enumerate(names)], "value_id bigint, index_name string, creator string")
    got = {(r.a, r.b) for r in N.name_links(df).collect()}
    assert {(0, 1), (1, 2), (0, 2), (0, 3), (2, 3), (9, 10), (6, 7)} <= got
    assert not {p for p in got if 4 in p or 5 in p or 11 in p} and (7, 8) not in got


def test_people_whose_names_are_in_no_table(spark):
    """Held-out recall: given names and families the tables don't know, in the usual ways of typing them."""
    import random

    rng = random.Random(6)
    given = {"Benjamin": "Benny", "Samuel": "Sammy", "Daniel": "Dan", "Christopher": "Chris", "Maximilian": "Max", "Josephine": "Josie", "Timothy": "Tim", "Gregory": "Greg", "Victoria": "Vicky", "Deborah": "Debbie", "Nathaniel": "Nat", "Philip": "Phil", "Stephanie": "Steffi", "Joshua": "Josh", "Raymond": "Ray", "Russell": "Russ", "Kenneth": "Kenny", "Gerald": "Gerry", "Leopold": "Leo", "Bernadette": "Bernie"}
    assert not {N.fold(n) for n in given} & set(N._GIVEN)
    families = ["".join(rng.choice(["bra", "kel", "mon", "tor", "ves", "lin", "dag", "hus", "per", "wol"]) for _ in range(3)).title() for _ in range(60)]
    rows, of = [], {}
    for i, last in enumerate(dict.fromkeys(families)):
        first, short = rng.choice(list(given.items()))
        k = rng.randrange(1, len(last) - 1)
        slip = last[:k] + last[k + 1 :]
        for v in (f"{first} {last}", f"{last}, {first}", f"{first[0]}. {last}", f"{short} {last}", f"{first.upper()} {last.upper()}", f"{last}, {first[0]}.", f"{first} {slip}", f"Dr. {first} {last}", f"{first} Q. {last}", f"{first.lower()}.{last.lower()}"):
            of[len(rows)] = i
            rows.append((len(rows), "idx", v))
    got = {tuple(r) for r in N.entity_pairs(spark.createDataFrame(rows, "value_id bigint, index_name string, creator string")).collect()}
    truth = {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    assert len(got & truth) / len(truth) > 0.9 and len(got & truth) / len(got) > 0.98


def test_a_short_form_of_two_names_is_nobodys(spark):
    rows = [(1, "i", "Christopher Amblin"), (2, "i", "Christina Amblin"), (3, "i", "Chris Amblin"), (4, "i", "Benjamin Corvel"), (5, "i", "Ben Corvel")]
    assert {tuple(r) for r in N.entity_pairs(spark.createDataFrame(rows, "value_id bigint, index_name string, creator string")).collect()} == {(4, 5)}
