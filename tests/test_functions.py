import datetime

import pytest
from pyspark.sql import functions as F

from mensura.functions import dates, names, numbers, text

CASES = {
    "number": (numbers.parse_number, [("5,4", 5.4), ("1 234,5", 1234.5), ("1 234,5", 1234.5), ("114", 114.0), ("1.234,5", 1234.5), ("5d", None), ("NaN", None), ("", None), (" ", None), ("-5", None), ("1,2,3", None), ("+3", 3.0), ("0,0", 0.0), ("7.", 7.0), (None, None)]),
    "value": (numbers.parse_value, [("5,4 !", 5.4), ("<1,0", None), (">5", None), ("neg", None), ("* 7", 7.0), ("↑ 8,1", 8.1), ("H", None), ("( * )", None), (None, None), ("12 mg", None)]),
    "unit": (numbers.canonical_unit, [("umol/l", "µmol/l"), ("μmol / L", "µmol/l"), ("x 109/l", "10^9/l"), ("10E9/l", "10^9/l"), ("10˄12/l", "10^12/l"), ("G/l", "10^9/l"), ("T/l", "10^12/l"), ("-", ""), ("1", ""), (" ", ""), ("U/l", "U/l"), ("ml/s/1,73m^2", "ml/s/1,73 m2"), ("ml/s/1,73m2", "ml/s/1,73 m2"), ("µmol / 24 h", "µmol/24 h"), (None, None)]),
    "material": (names.material_prefix, [("S_Glukóza", "s"), ("dU_Na", "du"), ("S/Sodík", "s"), ("S,P-glukóza", "s,p"), ("anti-TPO", None), ("S-100", None), ("ALP - x", None), ("xxx_e", "xxx"), (None, None)]),
    "key": (names.norm_key, [("S_Glukóza", "glukoza"), ("B_Neutrofily #", "neutrofily abs"), ("gGT", "ggt"), ("anti-TPO", "anti tpo"), ("S/Sodík", "sodik"), ("S-100 protein", "s 100 protein"), ("Žluť #1", "zlut abs1"), (None, ""), ("  ", "")]),
    "abbreviation": (names.abbreviation_key, [("B_x [MCV]", "mcv"), ("x [a] y", None), ("x [toolong7]", None), (None, None)]),
    "leading": (names.leading_code_key, [("URE urea", "urea"), ("KM * kyselina močová", "kyselina mocova"), ("HDL cholesterol", None), ("FE železo", None), ("ZE Železo", None)]),
    "tokens": (names.sorted_tokens, [("Novák Jan", "jan novak"), ("jan NOVÁK,", "jan novak")]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    f, cases = CASES[name]
    found = [r[0] for r in spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]
    assert found == [y for _, y in cases]


def test_ranges(spark):
    cases = {
        "4,11-5,60": (4.11, 5.6, None), "0,5 až 1,5": (0.5, 1.5, None), "< 5,00": (None, 5.0, None), "≤5": (None, 5.0, None), "do 5,0": (None, 5.0, None), "nad 0,5": (0.5, None, None), "7,8 - 12,8 fl": (7.8, 12.8, None),
        "0 - 15 let": (None, None, "0 - 15 let"), "M: 30 – 400": (30.0, 400.0, None), "M: 30-400 Ž: 15-150": (None, None, "M: 30-400 Ž: 15-150"), "negativní": (None, None, "negativní"), "(1–2)": (1.0, 2.0, None),
        "<1,0 negatívne": (None, None, "<1,0 negatívne"), "1,5-4,0 10^9/l": (1.5, 4.0, None), "dospělí: 0,5 - 1,2": (0.5, 1.2, None), "< 50 ng/ml": (None, 50.0, None), "": (None, None, None), "dospělí": (None, None, "dospělí"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", numbers.parse_range(F.col("x")).alias("r")).collect()
    assert {r.x: tuple(r.r) for r in rows} == cases


def test_tables_of_cells_as_expressions(spark):
    """The projections over a table give what the expressions give, hard cells included."""
    cells = ["5 - 7\u00a0mg", "M: 5 - 7 F: 3-4", "5 - 7 muži", "muži: < 5", "+5 - 7", "<= 5", "< 5 10^9/l", "5 - 7 x 10 ^9/l", "5 - 7 a b c d", "do5", "( 1 – 2 )", "1 234,5–2 000 g/l", "5 - -", None, "", "a" * 100_000, "1-" * 50_000]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, x string")
    got = {r.i: (tuple(r.r), tuple(r.e), r.r == r.e) for r in numbers.with_range(rows, F.col("x"), "r").select("i", "r", numbers.parse_range(F.col("x")).alias("e")).collect()}
    assert all(same for _, _, same in got.values()) and len(got) == len(cells)
    texts = [(5.0, 7.0, None), (None, None, cells[1]), (5.0, 7.0, None), (None, 5.0, None), (None, None, cells[4]), (None, None, cells[5]), (None, None, cells[6]), (5.0, 7.0, None), (None, None, cells[8]), (None, None, "do5"), (1.0, 2.0, None), (1234.5, 2000.0, None), (None, None, "5 - -"), (None, None, None), (None, None, None)]
    assert [got[i][0] for i in range(15)] == texts and got[15][0][2] == cells[15] and got[16][0][2] == cells[16]
    units = ["mmol\t/\u00a0L", "[U/L]", "10 6/l", "1 09", "cm^3", "1,73m^2/L", "ug/24 h", "kU/L", "×10^12/L", "L", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(units)], "i int, x string")
    found = [r[0] for r in numbers.with_unit(rows, F.col("x"), "u").orderBy("i").select("u").collect()]
    assert found == ["mmol/l", "[U/l]", "10^6/l", "1 09", "cm3", "1,73 m2/l", "µg/24 h", "kU/l", "10^12/l", "L", None]


def test_flags(spark):
    rows = spark.createDataFrame([(5.0, 5.0, 6.0), (4.9, 5.0, None), (7.0, None, 6.0), (None, 1.0, 2.0), (1.0, None, None)], "v double, lo double, hi double")
    assert [r[0] for r in rows.select(numbers.compute_flag(F.col("v"), F.col("lo"), F.col("hi"))).collect()] == ["normal", "low", "high", "unknown", "unknown"]
    raw = spark.createDataFrame([(">200", 150.0), (">5", 5.0), ("≥5", 5.0), (">=6 !", 5.0), ("<5", 1.0), (">x", 1.0), (">5", None)], "raw string, hi double")
    assert [r[0] for r in raw.select(numbers.censored_flag(F.col("raw"), F.col("hi"))).collect()] == ["high", "high", "unknown", "high", "unknown", "unknown", "unknown"]


def test_implausible_and_rounding(spark):
    rows = spark.createDataFrame([(44.5, 3.9, 5.6), (4.5, 3.9, 5.6), (900.0, 3.9, 5.6), (20.0, 3.9, 5.6), (1.0, 0.0, 0.0)], "v double, lo double, hi double")
    assert [r[0] for r in rows.select(numbers.implausible(F.col("v"), F.col("lo"), F.col("hi"))).collect()] == ["suspect-decimal", None, "impossible", None, None]
    assert [r[0] for r in spark.createDataFrame([(79.58000001,), (0.00123456,), (0.0,), (123456.0,)], "v double").select(numbers.significant(F.col("v"))).collect()] == pytest.approx([79.58, 0.001235, 0.0, 123500.0])


def test_dates(spark):
    df = spark.createDataFrame([("7103192745",), ("xx",), ("856121/5555",), ("535101123",)], "x string")
    found = [tuple(r[0]) for r in df.select(dates.birth_number(F.col("x"))).collect()]
    assert found[0] == (True, datetime.date(1971, 3, 19), "M") and not found[1][0] and found[3] == (True, datetime.date(1953, 1, 1), "F")
    two = spark.sql("select date'2023-08-31' a, date'2024-02-29' b").select(dates.whole_months(F.col("a"), F.col("b")), dates.age_on(F.col("a"), F.col("b"))).first()
    assert tuple(two) == (5, 0)
    doubts = spark.createDataFrame([(None,), ("2024-13-01",), ("2030-01-01",), ("1980-01-01",), ("2024-01-01",)], "x string").select(dates.date_doubt(F.col("x"), F.lit("2024-06-01").cast("date"))).collect()
    assert [r[0] for r in doubts] == ["missing", "unparseable", "future", "before 1990", None]


def test_similarity(spark):
    df = spark.createDataFrame([("glukoza", "glukosa"), ("a", "b"), ("ab", "ab"), ("", "x"), ("aaaa", "aa")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(names.dice(F.col("a"), F.col("b"))).collect()] == [0.667, 0.0, 1.0, 0.0, 0.5]
    assert round(df.select(names.trigram_dice(F.col("a"), F.col("b"))).first()[0], 3) == 0.571


def test_fold_keeps_length(spark):
    s = "Příliš žluťoučký kůň ñ Æ"
    assert spark.createDataFrame([(s,)], "s string").select(text.fold(F.col("s"))).first()[0] == "prilis zlutoucky kun n æ"
    assert len(text.FOLD[0]) == len(text.FOLD[1]) > 300


def test_pages_allowed(spark):
    from mensura.operators import ledger

    kinds = {"k": "send send send fail send fail send fail send fail send fail fail send".split(), "j": ["fail", "other", "send"], None: ["send"]}
    rows = spark.createDataFrame([(k, i, kind) for k, each in kinds.items() for i, kind in enumerate(each)], "key string, seq int, kind string")
    got = {tuple(r) for r in ledger.pages_allowed(rows, "key", "key string, sent long, failed long, refused long", 2).collect()}
    assert got == {("k", 6, 6, 2), ("j", 1, 0, 0), (None, 1, 0, 0)}
    assert ledger.pages_allowed(rows.limit(0), "key", "key string, sent long, failed long, refused long", 2).count() == 0
