"""A page's readings as rows of a report: reconciled, put on their printed rows, named as printed, looked for on the page, matched, and
joined by what is printed and nobody has read. No row of a page is lost; each carries what every step has found.

reads: page_id, reader, ord, raw_name, value_raw, unit_raw, ref_range_raw, row_index, lab, report_date, scan (true where a page has no
printed text). pages: page_id, row_index, cells. Reads and rows without a page_id are of no page and give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import compatible, material_prefix, norm_key
from ..functions.numbers import bound
from ..functions.text import strip_marks
from ..sources.shared import dealt, told_once
from .matching import resolve
from .quality import interval_count
from .reading import reconcile
from .rows import bare, material_word, printed_on_row, with_materials

#: Units that stand in a cell of their own, in small letters; powers of ten per litre are told by their form.
UNITS = [
    "%", "‰", "g/l", "mg/l", "µg/l", "μg/l", "ug/l", "ng/l", "ng/ml", "pg/ml", "mmol/l", "µmol/l", "μmol/l", "umol/l", "nmol/l", "pmol/l", "µkat/l", "μkat/l", "ukat/l",
    "u/l", "iu/l", "ku/l", "miu/l", "mu/l", "fl", "pg", "l/l", "g/dl", "mg/dl", "mm/h", "mm", "s", "kpa", "ml/min", "ml/s", "index", "ratio", "miu/ml", "iu/ml", "µg/ml",
    "ug/ml", "mosm/kg", "mmol/kg", "mmol/mol", "bezrozm", "bezrozm.", "arbj", "arbj.", "arb.j", "arb.j.",
]
#: What clearance is related to, behind its unit.
SURFACES = ["/1,73m2", "/1.73m2", "/1,73m^2", "/1.73m^2", "/1,73m", "/1.73m"]
#: How results without a number begin, or what is in them; in small letters.
WORDED = [
    "málo materiálu", "nedostatok materiálu", "neprovedeno", "nevykonan", "negat", "pozit", "nelze", "hemolyz", "hemolýz", "chyloz", "chylóz", "ikter", "přijato", "stopy",
    "ojediněle", "normální", "přítomen", "nepřítomen",
]
_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_POWERS = ["10^", "x10^", "10˄", "10*"]


def _only(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "") == ""


def _at(text: Column, start: int) -> Column:
    return F.substr(text, F.lit(start))


def _is_number(bare: Column) -> Column:
    """Digits with at most one decimal sign between them, of a text without the minus that may stand before."""
    return F.left(bare, F.lit(1)).isin(list(_DIGITS)) & F.translate(bare, _DIGITS, "").isin("", ",", ".") & F.right(bare, F.lit(1)).isin(list(_DIGITS))


def _is_date(parts: Column) -> Column:
    size = lambda k: F.length(F.get(parts, F.lit(k)))
    return (F.size(parts) == 3) & _only(F.array_join(parts, ""), _DIGITS) & size(0).between(1, 2) & size(1).between(1, 2) & size(2).between(2, 4)


def _is_unit(low: Column) -> Column:
    """Of a text in small letters without blanks."""
    power = F.lit(False)
    for p in _POWERS:
        power = power | (F.startswith(low, F.lit(p)) & (F.length(low) > len(p) + 2) & _only(F.substr(low, F.lit(len(p) + 1), F.length(low) - len(p) - 2), _DIGITS))
    return low.isin(UNITS + [u + s for u in ("ml/min", "ml/s") for s in SURFACES]) | (F.endswith(low, F.lit("/l")) & power)


def _kinds(texts: Column) -> Column:
    """What each text is by itself. Functions of arrays work out a part anew wherever it is named, so what is named often is a step of its own."""
    signed = lambda t: F.left(t, F.lit(1)).isin("<", ">")
    steps = F.transform(texts, lambda t: F.struct(t.alias("text"), signed(t).alias("signed"), F.trim(F.when(signed(t), _at(t, 2)).otherwise(t)).alias("body"), F.lower(t).alias("low"), F.lower(F.translate(t, " ", "")).alias("tight"), t.rlike(r"\p{L}").alias("letters")))
    minus = lambda c: F.startswith(c["body"], F.lit("-"))
    dotted = lambda t: F.when(F.contains(t, F.lit(".")), F.split(F.regexp_replace(t, r"\. ?", "."), r"\.", -1))
    steps = F.transform(steps, lambda c: F.struct(c.alias("c"), minus(c).alias("minus"), _is_number(F.when(minus(c), _at(c["body"], 2)).otherwise(c["body"])).alias("number"), dotted(c["text"]).alias("parts")))

    def kind(s: Column) -> Column:
        c, t, number = s["c"], s["c"]["text"], s["number"]
        date = F.coalesce(_is_date(s["parts"]), F.lit(False))
        return F.struct(
            t.alias("text"), number.alias("number"), (c["signed"] & number & ~s["minus"]).alias("bound"), (F.length(t).between(3, 6) & _only(t, _DIGITS)).alias("code"), ((F.length(t) == 1) & _only(c["low"], _SMALL)).alias("flag"),
            (_only(t, "() *\t") | (t == ".")).alias("marker"), _is_unit(c["tight"]).alias("unit"), (c["letters"] & (F.length(t) >= 2) & ~number & ~date).alias("named"), (c["letters"] & c["low"].rlike("|".join(WORDED))).alias("worded"),
        )

    return F.transform(steps, kind)


def kinds(cells: Column) -> Column:
    """A row's cells that aren't blank, each with what it is."""
    return _kinds(F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: F.coalesce(c != "", F.lit(False))))


def _first(items: Column, test) -> Column:
    """The place, from 1, of the first item that passes; 0 if none does."""
    return F.array_position(F.transform(items, lambda c, i: F.coalesce(test(c, i), F.lit(False))), True).cast("int")


def _value(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "!*", ""), r"\s+", "")


def printed_name(k: Column, end: Column) -> Column:
    """The name in front of a row's cell `end` (from 1) of kinds k: what is left without an accreditation letter and a laboratory's code at
    the start, titles of sections, an abbreviation whose name follows, marks, worded results, and a unit or H and L at its end."""
    def named(head: Column) -> Column:
        def stays(c: Column, i: Column) -> Column:
            t, last = c["text"], (i == F.size(head) - 1) & (i > 0)
            later = F.slice(head, i + 2, F.size(head))
            capitals = (F.upper(t) == t) & (F.lower(t) != t)
            section = capitals & (F.length(t) >= 4) & (F.regexp_replace(t, r"\p{L}", "") == "") & F.exists(later, lambda x: F.length(F.regexp_replace(x["text"], r"\P{L}", "")) >= 2)
            short = (F.upper(t) == t) & F.length(t).between(2, 6) & (F.regexp_replace(t, r"[\p{L}0-9]", "") == "") & F.coalesce(F.get(later, F.lit(0))["text"].rlike(r"^\p{Ll}"), F.lit(False))
            start = ((i == 0) & c["flag"]) | ((i <= 1) & c["code"]) | (t == "#")
            return ~(start | (c["unit"] & last) | section | short | c["worded"] | _only(t, "|*!") | c["marker"] | (t.isin("H", "L") & last))

        return F.array_join(F.transform(F.filter(head, stays), lambda c: c["text"]), " ")

    return bound(F.slice(k, F.lit(1), end - 1), named)


def _end_of_name(k: Column) -> Column:
    number = _first(k, lambda c, i: c["number"] & ~((i <= 1) & c["code"]))
    return F.when(number > 0, number).otherwise(F.size(k) + 1)


def name_by_value(k: Column, value: Column) -> Column:
    """The name in front of the cell that is the value, else in front of the first number."""
    at = F.when(_value(value) != "", F.array_position(F.transform(k, lambda c: _value(c["text"])), _value(value)).cast("int"))
    return printed_name(k, F.when(at > 0, at).otherwise(_end_of_name(k)))


def _starts_worded(low: Column, whole: bool = True) -> Column:
    """Whether a text in small letters begins with a result in words; not whole: with the first word of one."""
    found = F.lit(False)
    for w in WORDED:
        found = found | F.startswith(low, F.lit(w if whole else w.split(" ")[0]))
    return found


def candidates(pages: DataFrame) -> DataFrame:
    """Rows of pages that a reader should have returned: page_id, row_index, kind, name, result. numeric: behind a name a number, and a
    unit, an interval or a bound; qualitative: behind a name, and without a number, a result in words that may go over several
    cells."""
    told = with_candidates(pages.where("page_id is not null"), F.col("cells"), "_told")
    # a filter would be pushed down and have every step computed again; it isn't through a generator
    return told.select("page_id", "row_index", F.inline_outer(F.array("_told"))).where("kind is not null")


def with_candidates(rows: DataFrame, cells: Column, into: str) -> DataFrame:
    """rows with the column `into`: kind (NULL for a row that is no candidate), name and result of candidates(). Each step is a projection of the one
    before it; nothing is shuffled."""
    kept = rows.columns
    rows = rows.withColumn("_k", kinds(cells))
    start = _first(F.slice("_k", 1, 3), lambda c, i: c["named"])
    rows = rows.withColumn("_start", start)
    behind = F.filter(F.slice("_k", F.col("_start") + 1, F.size("_k")), lambda c: ~c["marker"] & ~c["flag"])
    rows = rows.withColumns({"_after": behind, "_texts": F.transform("_k", lambda c: c["text"])})
    line = F.array_join("_texts", " ")
    power = F.contains(line, F.lit("10")) & F.regexp_replace(line, r"\s+", "").rlike(r"10[˄^][0-9/]*/l")
    begun = (F.col("_start") > 0) & F.forall(F.slice("_k", F.lit(1), F.greatest(F.col("_start") - 1, F.lit(0))), lambda c: c["flag"] | c["code"]) & (F.size("_after") > 0)
    measured = F.exists("_k", lambda c: c["unit"]) | F.exists("_after", lambda c: c["bound"]) | power | (interval_count(line) > 0)
    bare = F.transform("_texts", lambda t: F.when(t.rlike(r"^[<>0-9-]"), F.regexp_replace(t, r"^[<>]?\s*-?\d+(?:[,.]\d+)?\s+", "")).otherwise(t))  # a criterion's bound may stand before the word
    rows = rows.withColumns({"_begun": begun, "_number": F.exists("_after", lambda c: c["number"]), "_measured": measured, "_bare": bare})
    begins = lambda t, i: (i >= F.col("_start")) & bound(F.lower(F.concat_ws(" ", t, F.array_join(F.slice("_texts", i + 2, F.size("_texts")), " "))), lambda low: _starts_worded(low))
    rows = rows.withColumn("_word", F.when(F.col("_begun") & ~F.col("_number") & F.exists("_bare", lambda t: bound(F.lower(t), lambda low: _starts_worded(low, whole=False))), _first(F.col("_bare"), begins)))
    rest = F.slice("_k", F.col("_word") + 1, F.size("_k"))
    stop = F.when(F.col("_word") > 0, _first(rest, lambda c, i: c["text"].rlike(r"\d") | c["unit"] | material_word(c["text"]).isNotNull()))
    kind = F.when(F.col("_begun") & F.col("_number") & F.col("_measured"), "numeric").when(F.col("_word") > 0, "qualitative")
    rows = rows.withColumns({"_kind": kind, "_stop": stop})
    until = F.when(F.col("_word") > 0, F.col("_word")).otherwise(_end_of_name(F.col("_k")))
    rows = rows.withColumn("_until", F.when(F.col("_kind").isNotNull(), until))
    name, own, worded = printed_name(F.col("_k"), F.col("_until")), F.get("_texts", F.col("_start") - 1), F.col("_kind") == "qualitative"
    words = F.array_join(F.slice("_texts", F.col("_word"), F.when(F.col("_stop") > 0, F.col("_stop")).otherwise(F.size("_k"))), " ")
    rows = rows.withColumn("_name", F.when(F.col("_kind").isNotNull(), name))
    told = F.struct(F.col("_kind").alias("kind"), F.when((F.col("_name") == "") & worded, own).otherwise(F.col("_name")).alias("name"), F.when(worded, words).otherwise("").alias("result"))
    return rows.select(*kept, told.alias(into))


def page_facts(reads: DataFrame) -> DataFrame:
    """page_id, lab, report_date (the first that a reading gives), date_conflict (all dates, in order, where readings differ), scan."""
    at = F.struct("reader", "ord")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    dates = F.array_sort(F.collect_set("report_date"))
    return reads.where("page_id is not null").groupBy("page_id").agg(first("lab"), first("report_date"), F.when(F.size(dates) > 1, dates).alias("date_conflict"), F.coalesce(F.max("scan"), F.lit(False)).alias("scan"))


def _letters(text: Column) -> Column:
    return F.regexp_replace(strip_marks(F.lower(F.coalesce(text, F.lit("")))), "[^a-z0-9]", "")


def _glued(cells: Column) -> Column:
    return F.regexp_replace(F.array_join(cells, ""), r"\s+", "")


def printed_somewhere(values: DataFrame, pages: DataFrame) -> DataFrame:
    """The distinct (page_id, value) whose value stands in a row of the page, blanks left out. Values meet rows by the page and their first
    three characters, and a value's first row ends its search; a row goes on only with those characters that its page asks for and it has."""
    asked = values.select("page_id", "value").distinct().withColumn("_v", F.regexp_replace("value", r"\s+", ""))
    wanted = asked.where("_v <> ''").groupBy("page_id").agg(F.collect_set(F.left("_v", F.lit(3))).alias("_w"))
    text = pages.select("page_id", _glued(F.col("cells")).alias("_t")).join(wanted, "page_id")
    rows = text.select(F.col("page_id").alias("_page"), "_t", F.explode(F.filter("_w", lambda w: F.contains("_t", w))).alias("_s"))
    met = (F.col("page_id") == F.col("_page")) & (F.left("_v", F.lit(3)) == F.col("_s")) & F.contains("_t", F.col("_v"))
    return asked.where("_v <> ''").join(rows, met, "left_semi").select("page_id", "value")


def interpret(reads: DataFrame, pages: DataFrame, index: DataFrame, aliases: DataFrame, materials: DataFrame, expected: int = 1) -> DataFrame:
    """One row for each reconciled reading (source reading), each printed result in words that none points at (printed) and each printed row
    with a number that none points at (unread, which states no value). Beside its cells a row carries

    reconciled  the doubt that comparing readings has left, or NULL
    placed      kept, moved (to the row within three that has name and value), broken (no such row: no index), none given, scan
    named       as read, from row (the name isn't on its row, which has another), as printed
    printed     row (a cell of its row), page (elsewhere in a row), absent, empty (no value is claimed), scan
    via         how the entry was found (resolve); refused where the printed material contradicts the entry's and the name has no code
    doubt       not printed, else reconciled; confidence is low for what isn't printed and what no reader returned

    Readings and printed rows are dealt by page once and come together as rows of one page, in windows; what looks for values elsewhere on the page
    reads them from a table in buckets by page. Each distinct (lab, name, unit) is resolved once."""
    at = F.when(F.col("lab").isNotNull(), F.struct("reader", "ord"))
    merged = reconcile(reads.where("page_id is not null"), expected, pair=True, also=("row_index",), of_page={"lab": F.min_by("lab", at), "scan": F.max("scan")})
    merged = merged.withColumnsRenamed({"row_index": "_stated", "disagreement": "reconciled"}).drop("readers").withColumns({"_claim": F.coalesce("value_raw", F.lit("")), "scan": F.coalesce("scan", F.lit(False))})
    lines = with_materials(pages.where("page_id is not null").select("page_id", "row_index", "cells")).drop("source")
    rows = merged.withColumn("_line", F.lit(False)).unionByName(lines.withColumn("_line", F.lit(True)), allowMissingColumns=True)
    rows = _placed(rows)
    facts, claimed = Window.partitionBy("page_id"), Window.partitionBy("page_id", "row_index")
    rows = rows.withColumns(
        {
            "_claimed": F.count_if(~F.col("_line")).over(claimed) > 0, "lab": F.max("lab").over(facts), "scan": F.coalesce(F.max("scan").over(facts), F.lit(False)),
            "_asking": F.coalesce(F.bool_or(F.col("_printed").isNull() & ~F.col("_line")).over(facts), F.lit(False)),
        }
    )
    left = F.col("_line") & F.col("row_index").isNotNull() & ~F.col("_claimed") & ~F.col("scan")
    # a filter on kind would be pushed down and have every step computed again; it isn't through a generator
    rows = with_candidates(rows, F.when(left, F.col("cells")), "_told").select("*", F.inline_outer(F.array("_told"))).drop("_told")
    worded, told = F.col("kind") == "qualitative", F.col("kind").isNotNull()
    source = F.when(~F.col("_line"), "reading").when(worded, "printed").when(told, "unread")
    line = lambda c, then: F.when(F.col("_line"), then).otherwise(F.col(c)).alias(c)
    rows = rows.select(
        "page_id", line("key", F.concat(F.lit("row "), F.col("row_index").cast("string"))), source.alias("source"), "lab", line("raw_name", F.col("name")), line("value_raw", F.when(worded, F.col("result"))),
        line("unit_raw", F.when(worded, "")), line("ref_range_raw", F.when(worded, "")), F.when(~F.col("_line") & F.col("scan"), F.col("_stated")).otherwise(F.col("row_index")).alias("row_index"), "cells", "material", "reconciled",
        line("escalated", F.lit(False)), line("placed", F.lit("kept")), line("named", F.lit("as printed")), line("_printed", F.lit("row")), "_claim", "_line", "_asking", told.alias("_told"),
    )
    rows = dealt(rows.where(~F.col("_line") | F.col("_asking") | F.col("_told")), "rows", "page_id")
    asked = rows.where(~F.col("_line") & F.col("_printed").isNull()).select("page_id", F.col("_claim").alias("value"))
    found = printed_somewhere(asked, rows.where("_line").select("page_id", "cells")).select("page_id", F.col("value").alias("_claim"), F.lit(True).alias("_there"))

    def entry(names: DataFrame) -> DataFrame:
        known = resolve(names, index, aliases).join(materials.select("canonical_id", F.col("material").alias("_entry")), "canonical_id", "left")
        return known.withColumn("_code", material_prefix(F.col("raw_name")))

    rows = told_once(rows.where("source is not null"), ["lab", "raw_name", "unit_raw"], entry).join(found, ["page_id", "_claim"], "left")
    rows = rows.withColumn("printed", F.coalesce("_printed", F.when(F.col("_there"), "page").otherwise("absent")))
    absent, reading = F.col("printed") == "absent", F.col("source") == "reading"
    refused = F.coalesce((F.col("via") == "catalogue") & ~compatible(F.coalesce("_code", "material"), F.col("_entry")), F.lit(False))
    return rows.select(
        "page_id", "key", "source", "lab", "raw_name", "value_raw", "unit_raw", "ref_range_raw", "row_index", F.array_join("cells", "  ").alias("snippet"), "material", "reconciled", "escalated", "placed", "named", "printed",
        F.when(absent, "not printed").otherwise(F.col("reconciled")).alias("doubt"), F.when(absent | ~reading, "low").otherwise("high").alias("confidence"),
        F.when(~refused, F.col("canonical_id")).alias("canonical_id"), F.when(refused, "refused").otherwise(F.col("via")).alias("via"),
    )


def _placed(rows: DataFrame, reach: int = 3) -> DataFrame:
    """Readings (_line is false) and printed rows of pages: readings with the row that carries the value, as rows.repaired() finds it, its cells and its
    material; with the name that it prints; and with what _printed can tell from that row alone (NULL: the value may stand elsewhere)."""
    text, place = ~F.col("_line") & ~F.col("scan"), F.coalesce("_stated", "row_index")
    page = Window.partitionBy("page_id").orderBy("_at")
    near = F.collect_list(F.when(F.col("_line") & F.col("row_index").isNotNull(), F.struct("row_index", "cells", "material")))
    rows = rows.withColumn("_at", place).withColumn("_near", near.over(page.rangeBetween(-reach, reach)))
    plain = F.regexp_replace(F.translate("_claim", "!*", ""), r"\s+", "")
    rows = rows.withColumns({"_near": F.when(text & F.col("_stated").isNotNull(), F.col("_near")), "_want": bare(F.lower(plain)), "_key": norm_key(F.coalesce("raw_name", F.lit("")))})
    joined = lambda r: F.array_join(r["cells"], " ")
    carries = lambda r: F.contains(bare(F.lower(joined(r))), F.col("_want"))
    rows = rows.withColumn("_own", F.get(F.filter("_near", lambda r: (r["row_index"] == F.col("_stated")) & carries(r)), F.lit(0)))
    away = lambda r: r["row_index"] - F.col("_stated")
    others = F.filter("_near", lambda r: (r["row_index"] != F.col("_stated")) & carries(r) & F.contains(norm_key(joined(r)), F.col("_key")))
    nearest = F.array_min(F.transform(others, lambda r: F.struct(F.abs(away(r)).alias("d"), (-away(r)).alias("before"), r.alias("r"))))["r"]
    rows = rows.withColumn("_own", F.when(F.col("_own").isNotNull(), F.col("_own")).otherwise(nearest))
    own = lambda c: F.when(F.col("_line"), F.col(c)).otherwise(F.col(f"_own.{c}"))
    placed = F.when(F.col("scan"), "scan").when(F.col("_stated").isNull(), "none").when(F.col("_own").isNull(), "broken").when(F.col("_own.row_index") != F.col("_stated"), "moved").otherwise("kept")
    rows = rows.withColumns({"row_index": own("row_index"), "cells": own("cells"), "material": own("material"), "placed": placed}).drop("_near", "_want", "_key", "_own", "_at")
    name = _letters(F.col("raw_name"))
    off = ~F.col("_line") & F.col("cells").isNotNull() & ~((name != "") & F.contains(_letters(F.array_join("cells", " ")), name))
    rows = rows.withColumn("_k", F.when(off, kinds(F.col("cells"))))
    rows = rows.withColumn("_from", F.when(F.col("_k").isNotNull(), name_by_value(F.col("_k"), F.col("value_raw"))))
    renamed = F.coalesce(F.col("_from") != "", F.lit(False))
    blank = F.regexp_replace("_claim", r"\s+", "") == ""
    here = F.coalesce(F.contains(_glued(F.col("cells")), F.regexp_replace("_claim", r"\s+", "")) & printed_on_row(F.col("_claim"), F.col("cells")), F.lit(False))
    told = F.when(F.col("scan"), "scan").when(blank, "empty").when(~F.col("_line") & here, "row")
    return rows.withColumns({"_printed": told, "named": F.when(renamed, "from row").otherwise("as read"), "raw_name": F.when(renamed, F.col("_from")).otherwise(F.col("raw_name"))}).drop("_k", "_from")


def page_counts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Of interpret's rows, per page of facts: how many of each source, how many were moved, renamed, not printed, broken; the lab, the date and
    the dates that differ."""
    at = lambda c, v: F.count_if(F.col(c) == v)
    found = rows.groupBy("page_id").agg(
        at("source", "reading").alias("readings"), at("source", "printed").alias("qualitative"), at("source", "unread").alias("unread"), at("placed", "moved").alias("repaired"), at("placed", "broken").alias("broken"),
        at("named", "from row").alias("renamed"), at("printed", "absent").alias("unverified"), F.count("doubt").alias("doubts"), F.count("canonical_id").alias("matched"),
    )
    return facts.join(found, "page_id", "full").na.fill(0)
