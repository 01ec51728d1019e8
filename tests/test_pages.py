"""Pages as rows of reports: what is on a printed row, and what every reading and every row comes to."""

from mensura.operators import pages

READS = "page_id long, reader string, ord int, raw_name string, value_raw string, unit_raw string, ref_range_raw string, row_index int, lab string, report_date string, scan boolean"
PAGES = "page_id long, row_index int, cells array<string>"
INDEX = [("glukoza", "glu"), ("urea", "urea"), ("kreatinin", "krea"), ("bilirubin", "bili")]


def _candidates(spark, rows):
    given = spark.createDataFrame([(1, i, cells) for i, cells in enumerate(rows)], PAGES)
    return {r.row_index: (r.kind, r.name, r.result) for r in pages.candidates(given).collect()}


def test_candidates(spark):
    found = _candidates(
        spark,
        [
            ["Glukóza", "5,4", "mmol/l", "3,9 - 5,6"],
            ["A", "81234", "Urea", "7,1", "!", "mmol/l"],
            ["Pacient", "Jan Novák"],  # no number
            ["Datum", "1. 2. 2024"],  # a date is none
            ["Telefon", "123456"],  # no unit, interval or bound
            ["Bilirubin", "málo", "materiálu", "sérum"],
            ["HBsAg", "<1,0 negatívne", "index"],
            ["URE", "urea", "( * )", "6", "mmol/l"],
            ["BIOCHEMIE", "Sodík", "mmol/l", "140", "136-145"],
            ["Leukocyty", "5", "10", "^", "9/l"],
            ["Vitamin", "D", "30", "nmol/l"],
            ["CRP", "H", "12", "<5"],
            ["Nadpis"], [], [None, " ", "x"], ["5,4", "Glukóza", "mmol/l"], ["Erytrocyty", "10^12/l", "4", "."],
        ],
    )
    assert found == {
        0: ("numeric", "Glukóza", ""), 1: ("numeric", "Urea", ""), 5: ("qualitative", "Bilirubin", "málo materiálu"), 6: ("qualitative", "HBsAg", "<1,0 negatívne"), 7: ("numeric", "urea", ""),
        8: ("numeric", "Sodík", ""), 9: ("numeric", "Leukocyty", ""), 10: ("numeric", "Vitamin D", ""), 11: ("numeric", "CRP", ""), 16: ("numeric", "Erytrocyty", ""),
    }


def _interpret(spark, reads, printed, expected=1):
    none = spark.createDataFrame([], "alias_lab string, alias_name string, alias_unit string, target string")
    reads = spark.createDataFrame([(*r, "lab", day, scan) for *r, day, scan in reads], READS)
    printed = spark.createDataFrame(printed, PAGES)
    index, known = spark.createDataFrame(INDEX, "key string, id string"), spark.createDataFrame([("glu", "s"), ("urea", "s")], "canonical_id string, material string")
    return pages.interpret(reads, printed, index, none, known, expected), pages.page_facts(reads)


def test_every_row_is_told(spark):
    row = lambda page, reader, n, name, value, at, day="2024-01-01", scan=False: (page, reader, n, name, value, "mmol/l", "", at, day, scan)
    printed = [
        (1, 0, ["Moč"]), (1, 1, ["Glukóza", "5,4", "mmol/l"]), (1, 2, ["Urea", "7,1", "mmol/l"]), (1, 3, ["Kreatinin", "80", "umol/l"]), (1, 4, ["Bilirubin", "neprovedeno"]), (1, 5, ["Sodík", "140", "mmol/l"]),
        (None, 0, ["Urea", "1", "mmol/l"]), (3, 0, ["Urea", "5,45", "mmol/l"]),
    ]
    reads = [
        row(1, "a", 1, "Glukóza", "5,4", 2), row(1, "b", 1, "Glukóza", "5,4", 2, day="2024-01-02"),  # one row too high
        row(1, "a", 2, "Ureq", "7,1", 2), row(1, "b", 2, "Urea", "7,1", 2, day="2024-01-02"),  # two names of one row
        row(1, "a", 3, "Kreatinin", "90", 3), row(1, "b", 3, "Kreatinin", "90", 3, day="2024-01-02"),  # nowhere printed
        row(2, "a", 1, "Urea", "9", None, scan=True), row(2, "b", 1, "Urea", "9", None, scan=True),
        row(None, "a", 1, "Urea", "9", 1), row(3, "a", 1, "Urea", "5,4", 0), row(3, "b", 1, "Urea", "5,4", 0), row(3, "a", 2, "Draslík", "", None),
    ]
    found, facts = _interpret(spark, reads, printed, expected=2)
    rows = {(r.page_id, r.raw_name, r.source): r for r in found.collect()}
    told = {k: (r.row_index, r.placed, r.named, r.printed, r.doubt, r.canonical_id, r.via) for k, r in rows.items()}
    assert told == {
        (1, "Glukóza", "reading"): (1, "moved", "as read", "row", None, None, "refused"),
        (1, "Urea", "reading"): (2, "kept", "from row", "row", None, None, "refused"),
        (1, "Kreatinin", "reading"): (None, "broken", "as read", "absent", "not printed", "krea", "catalogue"),
        (1, "Kreatinin", "unread"): (3, "kept", "as printed", "row", None, "krea", "catalogue"),
        (1, "Bilirubin", "printed"): (4, "kept", "as printed", "row", None, "bili", "catalogue"),
        (1, "Sodík", "unread"): (5, "kept", "as printed", "row", None, None, None),
        (2, "Urea", "reading"): (None, "scan", "as read", "scan", None, "urea", "catalogue"),
        (3, "Urea", "reading"): (0, "kept", "as read", "page", None, "urea", "catalogue"),  # 5,4 stands in 5,45, but is no cell
        (3, "Draslík", "reading"): (None, "none", "as read", "empty", "seen by one reading", None, None),
    }
    assert rows[1, "Bilirubin", "printed"].value_raw == "neprovedeno" and rows[1, "Glukóza", "reading"].snippet == "Glukóza  5,4  mmol/l"
    counts = {r.page_id: r for r in pages.page_counts(found, facts).collect()}
    assert (counts[1].readings, counts[1].unread, counts[1].qualitative, counts[1].repaired, counts[1].renamed, counts[1].unverified) == (3, 2, 1, 1, 1, 1)
    assert counts[1].date_conflict == ["2024-01-01", "2024-01-02"] and counts[2].scan and counts[3].readings == 2


def test_empty_pages(spark):
    found, facts = _interpret(spark, [], [])
    assert found.count() == 0 and pages.page_counts(found, facts).count() == 0
    found, _ = _interpret(spark, [], [(1, 0, ["Urea", "7", "mmol/l"])])
    assert [(r.source, r.raw_name, r.lab) for r in found.collect()] == [("unread", "Urea", None)]


def test_czech_order(spark):
    from datetime import date

    from mensura.operators import series

    words = ["i", "chlor", "hz", "h", "c", "čas", "cz", "z", "žena", "š", "sz", "r", "ř", None]
    names = spark.createDataFrame([(1, w) for w in words + ["h"]], "patient_id long, name string")
    found = [r.name for r in series.ranked_names(names, ["patient_id"], "name").orderBy("rank").collect()]
    assert found == ["c", "cz", "čas", "h", "hz", "chlor", "i", "r", "ř", "sz", "š", "z", "žena", None]
    points = [(1, w, k, date(2024, 1, 1), 9.0, "high", 1.0, 6.0) for k, w in enumerate(["i", "chlor", "h", "čas", "cz"])]
    points = spark.createDataFrame(points, "patient_id long, series string, ord int, date date, value double, flag string, ref_low double, ref_high double")
    ranks = lambda c: [r.series for r in series.watch_list(points, ["patient_id"], "series", ["ord"], c).orderBy("rank").collect()]
    assert ranks("cs") == ["cz", "čas", "h", "chlor", "i"] and ranks(None) == ["chlor", "cz", "h", "i", "čas"]
