"""Numbers, ranges and dates as they are printed, and small normalisers of text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import days_between, whole_months
from .names import norm_key
from .numbers import bound, parse_number, parse_value, significant
from .text import squeezed


def printed_number(x: Column) -> Column:
    """One, two or three decimals by size, without trailing zeros, with a decimal comma; a dash for NULL."""
    digits = F.when(F.abs(x) >= 100, F.format_string("%.1f", x)).when(F.abs(x) >= 1, F.format_string("%.2f", x)).otherwise(F.format_string("%.3f", x))
    bare = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.replace(bare, F.lit("."), F.lit(",")))


def printed_range(low: Column, high: Column) -> Column:
    """Both bounds; 0 and the upper one; > and the lower one; a dash."""
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.concat(printed_number(low), F.lit("–"), printed_number(high)))
        .when(high.isNotNull(), F.concat(F.lit("0–"), printed_number(high))).when(low.isNotNull(), F.concat(F.lit("> "), printed_number(low))).otherwise("—")
    )


def printed_date(day: Column) -> Column:
    return F.concat_ws(". ", F.dayofmonth(day).cast("string"), F.month(day).cast("string"), F.year(day).cast("string"))


def printed_unit(unit: Column) -> Column:
    """Exponents as superscripts."""
    sup = lambda s: F.translate(s, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    power = F.regexp_extract(unit, r"^(.*)\^(\d+)(.*)$", 2)
    return F.when(power == "", unit).otherwise(F.concat(F.regexp_extract(unit, r"^(.*)\^(\d+)(.*)$", 1), sup(power), F.regexp_extract(unit, r"^(.*)\^(\d+)(.*)$", 3)))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).when(n.between(2, 4), few).otherwise(many))


def correction_check(raw: Column, words: list[str]) -> Column:
    """ok, warn or reject for a value typed by hand: censored and worded results are fine, a negative number is stored with a
    warning, what is no number is rejected."""
    s = squeezed(raw)
    worded = F.lit(False)
    for w in words:
        worded = worded | F.contains(F.lower(s), F.lit(w))
    negative = s.rlike(r"^-\s*\d") & parse_value(F.regexp_replace(s, r"^-\s*", "")).isNotNull()
    return F.when(s.isNull() | (s == ""), "reject").when(s.rlike(r"^[<>]\s*\d") | worded, "ok").when(negative, "warn").when(parse_value(s).isNotNull(), "ok").otherwise("reject")


#: Labels of a draw's date, and a date.
DRAW_LABEL = r"(?iu)(odb[ěe]r[ua]?|odebr[áa]no|p[řr][íi]jet[íi]|p[řr][íi]jem|datum\s+vy[šs]et[řr]en[íi])"
DRAW_DATE = r"(\d{1,2})\s*\.\s*(\d{1,2})\s*\.\s*(\d{4}|\d{2})\b"


def draw_date(text: Column) -> Column:
    """The date behind a label of the draw on the same line as YYYY-MM-DD, years of two digits in this century; of several lines
    the first with a day and a month inside their bounds."""

    def of(line: Column) -> Column:
        behind = F.regexp_extract(F.regexp_replace(line, r"\s+", " "), rf"{DRAW_LABEL}.*", 0)
        parts = F.struct(*[F.regexp_extract(behind, DRAW_DATE, k).alias(f"d{k}") for k in (1, 2, 3)])

        def said(p: Column) -> Column:
            day, month, year = p["d1"].try_cast("int"), p["d2"].try_cast("int"), p["d3"].try_cast("int")
            whole = F.when(F.length(p["d3"]) == 2, year + 2000).otherwise(year)
            return F.when(month.between(1, 12) & day.between(1, 31), F.format_string("%04d-%02d-%02d", whole, month, day))

        return bound(parts, said)

    return F.get(F.filter(F.transform(F.split(text, r"\n"), of), lambda d: d.isNotNull()), F.lit(0))


def fingerprint(content: Column, salt: str) -> Column:
    """The first 16 hex digits of a salted SHA-256."""
    return F.left(F.sha2(F.concat(F.lit(salt).cast("binary"), content.cast("binary")), 256), F.lit(16))


def masked_route(route: Column) -> Column:
    """A route with its identifiers masked: numbers, and hexadecimal strings of eight signs or more."""
    return F.regexp_replace(route, r"(?i)/(?:\d+|[0-9a-f]{8,}(?:-[0-9a-f]+)*)(?=/|$)", "/:id")


def clamped(x: Column, low: float, high: float) -> Column:
    """A number inside its bounds, else NULL."""
    return F.when(x.between(low, high), x)


def slug(name: Column) -> Column:
    return F.replace(norm_key(name), F.lit(" "), F.lit("_"))


def nice_step(span: Column, most: int = 5) -> Column:
    """The least of 1, 2, 2.5, 5, 10 times a power of ten that divides a span into at most `most` steps."""
    raw = span / most
    return bound(F.pow(F.lit(10.0), F.floor(F.log10(raw))), lambda p: F.when(raw <= p, p).when(raw <= 2 * p, 2 * p).when(raw <= 2.5 * p, 2.5 * p).when(raw <= 5 * p, 5 * p).otherwise(10 * p))


#: Units, intervals and headings of a laboratory's sheet, and the score from which a page counts as one.
SHEET_UNIT = r"(?iu)(?:[mµμnp]?mol|[mµμnpk]?g|[mµμ]?kat|[mµμ]?IU|[mµμ]?U|j|IU)\s*/\s*(?:[mdµμ]?l|24\s*h|kg)\b|×?\s*10\s*[\^˄*]?\s*(?:9|12|6)\s*/\s*l\b|\bfl\b|\bpg\b"
SHEET_RANGE = r"\d+[,.]?\d*\s*[-–—]\s*\d+[,.]?\d*|[<>≤≥]\s*\d+[,.]?\d*"
SHEET_HEADER = r"(?iu)\b(v[ýy]sledek|v[ýy]sledok|jednotk[ay]|ref(?:\.|erenční|erenčn[ée])?\s*(?:meze|rozmez[íi]|hodnot[ay]|interval)|norma|vy[šs]etřen[íi]|biochemie|hematologie|materi[áa]l)\b"
SHEET_LEAST = 5.0


def sheet_signs(text: Column) -> Column:
    """STRUCT<units, ranges, headers, value_rows>: distinct units, intervals, headings, and lines with a word and a decimal."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), squeezed), lambda x: x != "")
    total = lambda pattern: F.aggregate(lines, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(pattern)))
    units = F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(SHEET_UNIT), F.lit(0)), lambda u: F.lower(F.regexp_replace(u, r"\s+", "")))))
    rows = F.size(F.filter(lines, lambda x: x.rlike(r"\p{L}{3,}") & x.rlike(r"\d+[,.]\d+")))
    return F.struct(F.size(F.array_distinct(units)).alias("units"), total(SHEET_RANGE).alias("ranges"), total(SHEET_HEADER).alias("headers"), rows.alias("value_rows"))


def sheet_score(text: Column) -> Column:
    """How much a text looks like a laboratory's sheet: a capped sum of its signs."""
    capped = lambda x, most, each: F.least(x, F.lit(most)) * each
    return bound(sheet_signs(text), lambda s: capped(s["units"], 6, 1.5) + capped(s["ranges"], 10, 0.5) + capped(s["headers"], 4, 1.0) + capped(s["value_rows"], 20, 0.25))


def printed_month(day: Column) -> Column:
    """Month and year for an axis, as 2/24."""
    return F.concat(F.month(day).cast("string"), F.lit("/"), F.date_format(day, "yy"))


def printed_exact(value: Column, raw: Column) -> Column:
    """The value as printed, without the laboratory's marks; the number with a decimal comma where nothing was printed."""
    printed = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[!*]", ""))
    plain = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.when(printed != "", printed).when(value.isNull() | F.isnan(value), "—").otherwise(F.replace(plain, F.lit("."), F.lit(",")))


def printed_money(amount: Column) -> Column:
    """Two decimals if there are any, none for a whole number; no-break spaces group thousands."""
    grouped = F.translate(F.when(amount == F.floor(amount), F.format_number(amount, 0)).otherwise(F.format_number(amount, 2)), ".,", ",\u00a0")
    return grouped


def printed_span(a: Column, b: Column) -> Column:
    """The time from a to b in words: years and months, months, or days; NULL if b is before a."""
    months = whole_months(a, b)
    years, rest = F.floor(months / 12).cast("int"), F.pmod(months, F.lit(12)).cast("int")
    y, m = plural(years, "rok", "roky", "let"), plural(rest, "měsíc", "měsíce", "měsíců")
    days = plural(days_between(a, b), "den", "dny", "dnů")
    return F.when(months.isNull() | (months < 0), None).when(months == 0, days).when(years == 0, m).when(rest == 0, y).otherwise(F.concat(y, F.lit(" a "), m))


def converted_text(raw: Column, value: Column, factor: Column) -> Column:
    """The text that a converted reading is shown with: the converted number; of a bound its sign and the converted number. Without
    a factor or a number it stays as printed."""
    found = F.regexp_extract(raw, r"([0-9][0-9\s.,]*)", 1)
    shown = lambda x: F.replace(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("."), F.lit(","))
    number = parse_number(F.trim(found))
    at = F.instr(raw, found)
    rebuilt = F.concat(F.substr(raw, F.lit(1), at - 1), shown(significant(number * factor)), F.ltrim(F.substr(raw, at + F.length(found))))
    return F.when(value.isNotNull(), shown(value)).when(factor.isNull() | (found == "") | number.isNull(), raw).otherwise(rebuilt)


def hashed_owner(owner: Column, salt: str, day: Column | None = None) -> Column:
    """A user or an address as 16 hex digits that change with the salt, and with the day if one is given."""
    said = F.concat_ws("|", F.lit(salt), *([F.date_format(day, "yyyy-MM-dd")] if day is not None else []), owner)
    return F.when(owner.isNotNull(), F.left(F.sha2(said, 256), F.lit(16)))
