"""Names and office-holders against literals and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import offices as O

NAMES = [
    ("the Rt. Hon. Sir Keir Starmer KCB MP", "Keir Starmer"), ("President Emmanuel Macron", "Emmanuel Macron"), ("H.E. Dr Ana Brnabić", "Ana Brnabić"), ("Luc FRIEDEN", "Luc Frieden"), ("Jean-Claude JUNCKER", "Jean-Claude Juncker"), ("Mary O'NEIL", "Mary O'Neil"),
    ("He met us. Marco Rubio", "Marco Rubio"), ("Luc Frieden is a politician", "Luc Frieden"), ("Luc Frieden has been minister since 2020", "Luc Frieden"), ("Luc Frieden visits Paris", "Luc Frieden"), ("Ana Maria Government of Spain", "Ana Maria"), ("Ana Maria EU Council", "Ana Maria"),
    ("Ana Maria NATO", "Ana Maria Nato"), ("Donald Trump's", "Donald Trump"), ("King Charles III", "Charles III"), ("", ""), (None, ""), ("Visits", "Visits"), (" , Luc  Frieden , ", "Luc Frieden"),
]


def test_names_are_cut_where_they_end(spark):
    df = spark.createDataFrame([(i, raw, "x") for i, (raw, _) in enumerate(NAMES)], "id int, raw string, name string").drop("name")
    assert {r.id: r["name"] for r in O.with_name(df, "raw").collect()} == {i: want for i, (_, want) in enumerate(NAMES)}


@pytest.mark.parametrize("name, person", [("Luc Frieden", True), ("Prime Minister", False), ("the King", False), ("of Spain", False), ("Breaking News", False), ("One Two Three Four Five Six", False), ("Luc", True), ("", False), ("12 34", False), ("Luc said", False)])
def test_what_is_a_person(spark, name, person):
    assert spark.range(1).select(O.is_person_name(F.lit(name)).alias("x")).collect()[0].x == person


def test_candidates_of_sources(spark):
    rows = [
        (1, "prime minister", "Luc Frieden | Gov", "Rt. Hon. Luc Frieden, Prime Minister, said so."), (2, "prime minister", "News", "Xavier Bettel became the Prime Minister in 2013."), (3, "prime minister", "Home", "Incumbent Luc Frieden since 2023"),
        (4, "prime minister", "FRIEDEN Luc - The Luxembourg Government", "Current role: Prime Minister"), (5, "president", "A page", "It rained."), (6, "king", None, None), (7, "president", "x", "Joe Biden became President. And since: Joe Biden is the President"), (8, "secretary of state", "x", "Marco Rubio was sworn in as the 72nd Secretary of State"),
    ]
    got = {r.source_id: (r["name"], r.kind) for r in O.candidates(spark.createDataFrame(rows, "source_id int, role string, title string, content string")).collect()}
    assert got == {1: ("Luc Frieden", "current"), 2: ("Xavier Bettel", "historical"), 3: ("Luc Frieden", "current"), 4: ("Luc Frieden", "current"), 7: ("Joe Biden", "current"), 8: ("Marco Rubio", "current")}


def source(i, qid, country, host, content, title="Page"):
    return (i, qid, "prime minister", country, f"W{i}", f"https://{host}/{i}", title, content)


def test_holders_are_elected(spark):
    said, became = "{}, Prime Minister, spoke.", "{} became the Prime Minister"
    rows = [
        # of now before of the past, though more domains tell of the past
        source(1, "a", "X", "a.org", said.format("Ana Novak")), source(2, "a", "X", "b.org", became.format("Petr Svoboda")), source(3, "a", "X", "c.org", became.format("Petr Svoboda")),
        # only official sources where there are any
        source(4, "b", "X", "gov.example", said.format("Jan Black")), source(5, "b", "X", "a.org", said.format("Eva White")), source(6, "b", "X", "b.org", said.format("Eva White")),
        # without a country two domains have to agree
        source(7, "c", None, "a.org", said.format("Lone Ranger")), source(8, "c", None, "b.org", said.format("Twin Peaks")), source(9, "c", None, "c.org", said.format("Twin Peaks")), source(10, "d", None, "c.org", said.format("Lone Ranger")),
        # noise and lists don't count, names that can be one person's don't conflict
        source(11, "e", "X", "facebook.com", said.format("No Body")), source(12, "e", "X", "d.org", said.format("Jan Peter Green")), source(13, "e", "X", "e.org", said.format("Jan Green")), source(14, "e", "X", "f.org", "government directory " + said.format("No Body")),
    ]
    df = spark.createDataFrame(rows, "source_id int, qid string, role string, country string, label string, url string, title string, content string")
    got = {r.qid: (r["name"], r.kind, r.conflict) for r in O.holders(df).collect()}
    assert got == {"a": ("Ana Novak", "current", True), "b": ("Jan Black", "current", False), "c": ("Twin Peaks", "current", False), "e": ("Jan Green", "current", False)}
    assert O.holders(df.limit(0)).count() == 0


def brute_conflict(names):
    def parts(n):
        words = [w for w in n.lower().split() if len(w) > 1]
        return set(words) - set(O.COURTESIES), words[-1] if words else ""

    def agree(a, b):
        (x, la), (y, lb) = parts(a), parts(b)
        if not x or not y:
            return False
        ends = len(x) > 1 and len(y) > 1 and (min(x), max(x)) == (min(y), max(y))
        return x <= y or y <= x or ends or bool(x & y) and la == lb

    return any(not agree(a, b) for a, b in itertools.combinations(sorted({n.lower() for n in names}), 2))


def test_conflicts_equal_every_pair(spark):
    r = random.Random(3)
    words = ["Jan", "Eva", "Petr", "Novak", "Green", "Mr", "X"]
    groups = {g: [" ".join(r.choices(words, k=r.choice([1, 2, 2, 3, 4]))) for _ in range(r.choice([1, 2, 2, 3, 5]))] for g in range(300)}
    df = spark.createDataFrame([(g, n, "k", "t") for g, ns in groups.items() for n in ns] + [(1000, None, "", ""), (0, "", "", "")], "qid int, name string, key string, t string")
    got = {x.qid: x.conflict for x in O.conflicts(df).collect()}
    assert got == {g: brute_conflict(ns) for g, ns in groups.items()} and set(got.values()) == {True, False}
