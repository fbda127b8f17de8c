"""Dates by what stands around them."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.operators import dates as D


def test_places_and_sides_are_those_of_the_matches(spark):
    pieces = st.sampled_from(["1-2", "33-4", " ", "x", "words between ", "é", "", "5-", "long " * 12])

    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.lists(pieces, max_size=14).map("".join), min_size=1, max_size=6))
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
        for r in df.select("id", D.placed(F.col("t"), "[0-9]+-[0-9]+", 20).alias("x")).collect():
            t = texts[r.id]
            assert [tuple(x) for x in r.x] == [(m.start(), m[0], t[max(0, m.start() - 20) : m.start()], t[m.end() : m.end() + 20]) for m in re.finditer("[0-9]+-[0-9]+", t)]

    run()


def test_best_dates(spark):
    rows = [
        (1, "Date of issue: 01.02.2020 Date of expiry: 01.02.2030", "When was it issued?"), (2, "Date of issue: 01.02.2020 Date of expiry: 01.02.2030", "When does it expire?"), (3, "Date 0f lssue: Ol.O2.2O2O", "date of issue"),
        (4, "paid en date du 03.03.2021, session of 2021-04-05", "What is the exam date?"), (5, "01.01.2001", "What is the date?"), (6, "date 01.01.2001 and date 02.01.2001", "date?"), (7, None, "date?"), (8, "", None), (9, "99.AB.2000 date", "date?"),
        (10, "issued 2020-01-01 issued 2021-01-01", "issued?"), (11, "date " + "x" * 70000 + " date 2020-01-01", "date?"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, question string, score int")
    assert {r.doc_id: r.value for r in D.best(df).collect()} == {1: "01.02.2020", 2: "01.02.2030", 3: "01.02.2020", 4: "2021-04-05", 6: "02.01.2001", 10: "2020-01-01", 11: "2020-01-01"}
    assert D.best(df.limit(0)).count() == 0


def test_defence_dates(spark):
    rows = [(1, "He defended his thesis on 3 May 2020. Born 1 Jan 1990"), (2, "PhD student 1 Jan 1990, " + "x " * 90 + "doctoral thesis 4 June 2001"), (3, "Born 1 Jan 1990"), (4, None), (5, "thesis 112 May 2020"), (6, "defence 2 March 2003")]
    got = {r.doc_id: r.date for r in D.defence_date(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "3 May 2020", 2: "4 June 2001", 3: None, 4: None, 5: None, 6: "2 March 2003"}
