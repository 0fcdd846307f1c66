"""Scalar functions: business numbers, names, digit tokens, dates, money, taxonomy."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tributary.functions import expr, similarity
from tributary.functions.text import clean_html, with_name_key


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_business_numbers(spark):
    cases = {"132162041": "132162041", "132162041RR0001": "132162041", "132162041rt0001": "132162041", "ARC 132162041 RP 0001": "132162041", "CRA132162041": "132162041", "132.162-041": "132162041", "12345678": None, "1234567890": None, "132162041RR001": None, "132162041XX0001": None, "H2X1Y4": None, "": None, None: None}
    assert apply(spark, expr.normalize_bn, list(cases)) == list(cases.values())


def test_reject_shapes(spark):
    assert apply(spark, expr.bn_reject_shape, ["12345678", "ABC", "", " - ", None]) == ["8 digits", "non-numeric", "blank", "blank", "blank"]


def test_registration_numbers_are_only_trimmed(spark):
    assert apply(spark, expr.valid_crn, [" 108091091 ", "108091091RR0001", "10754 2870 RP0001", "834767352RR001"]) == ["108091091", "108091091", None, None]


def test_names(spark):
    got = apply(spark, expr.normalize_name, ["The Canadian Red Cross Society", "Fondation du Grand Montréal | Foundation of Greater Montreal", "OF THE", "Œuvre Léger", None, "A–B"])
    assert got == ["CANADIAN RED CROSS", "GRAND MONTREAL", "OF THE", "OEUVRE LEGER", "", "A B"]
    assert apply(spark, expr.normalize_for_scoring, ["Centre de la petite enfance Origami", "L'Institut", "Club"]) == ["ORIGAMI", "L INSTITUT", "CLUB"]


def test_individuals(spark):
    assert apply(spark, expr.individual_donee, ["McConnell  Joanne", "Reid  Margaret (Peggy)", "Red Cross", "Big  Green House", None]) == [True, True, False, False, False]
    assert apply(spark, expr.individual_comma, ["McConnell, Erin (McMaster University)", "Sumalytics, Inc.", "AdMare, centre d'artistes", "Lee, Jennifer S", None]) == [True, False, False, True, False]


def test_digit_tokens(spark):
    rows = spark.createDataFrame([("CIRCUIT 1 B", 11), ("CIRCUIT 1B", 10), ("X 11B", 5), ("JEHOVAH S 60", 12), ("SCHOOL NO 13 T", 60), ("SCHOOL NO 13 T", 59)], "n string, l int")
    got = [r[0] for r in rows.select(expr.digit_tokens(F.col("n"), F.col("l"))).collect()]
    assert got == [["1B"], ["1B"], ["11B"], ["60"], ["13"], ["13T"]]


@pytest.mark.parametrize(("a", "b", "same"), [(["5A"], ["7A"], False), (["5A"], ["5A"], True), (["2013"], [], True), (["2013"], ["2014"], False), (["2013", "5"], ["5"], True), ([], [], True)])
def test_digit_gate(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(expr.digit_tokens_match(F.col("a"), F.col("b"))).first()[0] is same


def test_neighbours(spark):
    got = dict(tuple(x) for x in apply(spark, expr.bn_neighbours, ["119219814"])[0])
    assert len([e for e in got.values() if e == "substitution"]) == 81
    assert got["119218814"] == "substitution"
    assert got["011921981"] == "insertion_deletion"
    assert "119219814" not in got


def test_numbers(spark):
    assert apply(spark, expr.to_double, ["1d", "1_000", " 12.5 ", "1e3", "NaN", "", None, ".5", "-3"]) == [None, None, 12.5, 1000.0, None, None, None, 0.5, -3.0]
    assert apply(spark, expr.to_int, ["12.0", "12.7", "x", "99999999999"]) == [12, 13, None, None]
    assert apply(spark, expr.money, ["$1,234.50", " 12 ", "free"]) == [1234.5, 12.0, None]


def test_dates(spark):
    got = [str(d) if d else None for d in apply(spark, expr.any_date, ["2024-1-5", "2024/01/05", "05/01/2024", "2024", "31/02/2024", "", None])]
    assert got == ["2024-01-05"] * 3 + [None] * 4
    years = spark.sql("select date'2024-03-31' d union all select date'2024-04-01'").select(expr.fiscal_year(F.col("d"))).collect()
    assert [r[0] for r in years] == [2023, 2024]


def test_proration(spark):
    df = spark.createDataFrame([(1, 90.0, 2020, 2022), (2, 90.0, 2020, None), (3, 90.0, 2020, 2018), (4, 90.0, None, 2020), (5, None, 2020, 2021)], "i int, v double, s int, e int")
    got = {r.i: [tuple(p) for p in r.p] for r in df.select("i", expr.prorated(F.col("v"), F.col("s"), F.col("e")).alias("p")).collect()}
    assert got == {1: [(2020, 30.0), (2021, 30.0), (2022, 30.0)], 2: [(2020, 90.0)], 3: [(2020, 90.0)], 4: [], 5: []}


def test_search_forms(spark):
    names = ["École du Nord", "L'école", "Protocole", "100% Club"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    hit = lambda q: [r[0] for r in df.where(expr.word_start(expr.fold(F.col("n")), q)).collect()]
    assert hit("ecole") == ["École du Nord", "L'école"]
    assert hit("cole") == []
    assert hit("100%") == ["100% Club"]
    assert hit("\\e") == []


def test_taxonomy(spark):
    df = spark.createDataFrame([("AA000000", "AA010203"), ("AA010000", "AA020000"), ("00000000", "AA000000"), ("AA010200", "AA010203"), ("AA010203", "AA010203")], "a string, b string")
    assert [r[0] for r in df.select(expr.ancestor_or_self(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, True]


def test_places(spark):
    assert apply(spark, expr.normalize_postal, ["h2x 1y4", "H2X1Y", None]) == ["H2X1Y4", None, None]
    assert apply(spark, expr.clean_city, ["Laval (Québec)", "Laval, QC", "Québec"]) == ["Laval", "Laval", "Québec"]
    assert apply(spark, expr.slugify, ["Étude & Cie.", "--a--", "???"]) == ["tude-cie", "a", "org"]
    assert apply(spark, expr.fiscal_year_of_label, ["2019-2020", "FY2019", None]) == [2019, None, None]
    assert apply(spark, expr.fmt_money, [None, 5.0, 1234567.0, 1.26e9, 12.6e9], "double") == ["—", "$5", "$1.2M", "$1.3B", "$13B"]


def test_markup(spark):
    raw = ["<span lang='fr'>F&amp;eacute;d&eacute;ration  acadienne</span>", "Fédération acadienne", "", None, "A < B"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, n string")
    got = [r.c for r in clean_html(df, "n", "c").orderBy("i").collect()]
    assert got == ["Fédération acadienne", "Fédération acadienne", "", None, "A < B"]
    keys = [r.norm for r in with_name_key(df, "n").orderBy("i").collect()]
    assert keys[0] == keys[1] == "FEDERATION ACADIENNE"


def quadratic(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_the_quadratic_table():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(0, 90))) for _ in "12")
        assert similarity.lcs(a, b) == quadratic(a, b)


def test_known_scores():
    assert round(similarity.token_sort_ratio("ALBERTA CIRCUIT 5A OF JEHOVAHS WITNESSES".replace("OF ", ""), "ALBERTA CIRCUIT 7A JEHOVAHS WITNESSES"), 1) == 97.3
    assert similarity.token_sort_ratio("B A", "A B") == 100.0


def test_scores_only_distinct_pairs_and_keeps_the_bound(spark):
    df = spark.createDataFrame([("A B", "B A"), ("ABCD", "ABCE"), ("A", "ABCDEFGHIJ"), (None, "X"), ("ABCD", "ABCE")], "a string, b string")
    got = sorted((r.a, r.score) for r in similarity.scored(df, "a", "b", cutoff=60).collect())
    assert got == [("A B", 100.0), ("ABCD", 75.0), ("ABCD", 75.0)]


def test_lcs_table_equals_single_lcs():
    import random

    rnd = random.Random(3)
    for letters in ("ab", "abcdé 0\U0001f600"):
        make = lambda: ["".join(rnd.choices(letters, k=n)) for n in (0, 1, 5, 63, 64, 65, 127, 128, 129, 300)]  # noqa: B023, E731
        a, b = make() + make(), [*make(), "zz"]
        assert similarity.lcs_table(a, b).tolist() == [[similarity.lcs(x, y) for y in b] for x in a]
        assert similarity.lcs_table(a, b, room=64).tolist() == similarity.lcs_table(a, b).tolist()
    assert similarity.ratio_table(["", "ab"], ["", "ba"]).tolist() == [[100.0, 0.0], [0.0, 50.0]]
    assert similarity.lcs_table([], ["a"]).shape == (0, 1)
