"""Calendar arithmetic and national identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(a: Column, b: Column) -> Column:
    return F.coalesce(F.datediff(b, a), F.lit(0))


def whole_months(a: Column, b: Column) -> Column:
    """Whole months from a to b, without any rule for last days."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)


def age_on(birth: Column, day: Column) -> Column:
    return F.floor(whole_months(birth, day) / 12).cast("int")


def birth_number(text: Column) -> Column:
    """STRUCT<valid, birth DATE, sex> of a Czech or Slovak birth number of nine or ten digits: months with 20, 50 or 70 added,
    ten digits divisible by 11, nine digits before 1954."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s/]", "")
    shaped = digits.rlike(r"^\d{9,10}$")
    part = lambda a, n: F.substr(digits, F.lit(a), F.lit(n)).try_cast("int")
    yy, mm, dd, ten = part(1, 2), part(3, 2), part(5, 2), F.length(digits) == 10
    month = F.when(mm > 70, mm - 70).when(mm > 50, mm - 50).when(mm > 20, mm - 20).otherwise(mm)
    year = F.when(ten, F.when(yy >= 54, 1900 + yy).otherwise(2000 + yy)).otherwise(F.when(yy >= 54, 1800 + yy).otherwise(1900 + yy))
    birth = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, dd), "yyyy-MM-dd")
    check = ~ten | (F.substr(digits, F.lit(1), F.lit(10)).try_cast("long") % 11 == 0) | ((F.substr(digits, F.lit(1), F.lit(9)).try_cast("long") % 11 == 10) & F.endswith(digits, F.lit("0")))
    valid = F.coalesce(shaped & check & birth.isNotNull(), F.lit(False))
    return F.struct(valid.alias("valid"), F.when(valid, birth).alias("birth"), F.when(valid, F.when(mm > 50, "F").otherwise("M")).alias("sex"))


def date_doubt(day: Column, today: Column, stored: Column | None = None) -> Column:
    """Why a printed date is doubtful, or NULL: missing, unparseable, future (more than a day ahead), before 1990."""
    parsed = F.try_to_date(day, "yyyy-MM-dd")
    found = F.when(day.isNull() | (day == ""), "missing")
    if stored is not None:
        found = found.when(stored.isNotNull(), stored)
    return found.when(parsed.isNull(), "unparseable").when(parsed > F.date_add(today, 1), "future").when(F.year(parsed) < 1990, "before 1990")
