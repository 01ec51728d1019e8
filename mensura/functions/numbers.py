"""Numbers, intervals, units and flags from printed strings, as Column expressions. What doesn't parse is NULL, never an
invented number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WIDE_SPACES

#: Every white space that is deleted, or becomes a plain blank.
_BLANKS = " \t\n\r\f\v" + WIDE_SPACES

#: Marks beside a value that say nothing about the number.
VALUE_MARKS = "!*↑↓"
#: Dashes that stand for a hyphen between bounds.
DASHES = "‒–—−"
#: Words behind two numbers that make them ages or a criterion, not an interval.
NOT_A_UNIT = [
    "let", "léta", "rok", "roku", "roky", "roků", "rokov", "r", "měsíc", "měsíce", "měsíců", "mesiac", "mesiace", "mesiacov", "m", "týden",
    "týdne", "týdny", "týdnů", "týždeň", "týždne", "týždňov", "t", "den", "dne", "dny", "dní", "dnů", "deň", "dni", "dňov", "d", "hod",
    "hodin", "hodina", "hodiny", "hodín", "trimestr", "negativní", "negativně", "negatívne", "negatívny", "pozitivní", "pozitívne",
    "pozitívny", "hraniční", "hraničné", "reaktivní", "nereaktivní", "normální", "patologické", "stopy", "neprovedeno", "nevykonané",
    "přítomny", "přítomen", "nepřítomny", "nález",
]
#: Labels of a population in front of an interval; a single letter needs a point or a colon.
LETTERS = ["m", "ž", "f"]
PEOPLE = ["muži", "muž", "ženy", "žena", "dospělí", "dospělý"]
LABELS = [x + mark for x in LETTERS for mark in ".:"] + [x + mark for x in PEOPLE for mark in ("", ".", ":")]
#: What else announces a second interval.
CHILDREN = ["děti" + mark for mark in ("", ".", ":")]
#: The words and signs of a top and of a bottom, and what joins two bounds.
TOPS, BOTTOMS, JOINERS = ["<", "≤", "do"], [">", "≥", "nad"], ["-", "až"]
#: What a unit may begin with.
UNIT_START = r"^[A-Za-zµμ%‰/(×°]"
_DIGITS = "0123456789"
_RUN = "[0-9][0-9., ]*"
#: Stands for the ten of a power behind two bounds, so that it isn't taken for a part of the number before it.
_TEN = "\x01"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_number(text: Column) -> Column:
    """A printed number: comma or point as the decimal sign, points group if both occur, blanks group, no minus sign."""
    plain = F.translate(text, _BLANKS, "")
    both = F.contains(plain, F.lit(",")) & F.contains(plain, F.lit("."))
    dotted = F.translate(F.when(both, F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain), ",", ".")
    # only digits and their signs reach the cast, so it takes no 5d or NaN; it refuses a second decimal point itself
    clean = F.translate(plain, _DIGITS + ".,", "").isin("", "+") & ~F.left(F.replace(plain, F.lit("+"), F.lit("")), F.lit(1)).isin(".", ",")
    return F.when(clean, dotted.try_cast("double"))


def parse_value(text: Column) -> Column:
    """A result cell's number; censored and worded results are NULL, as a letter or a sign of comparison is no part of a number."""
    return parse_number(F.translate(text, VALUE_MARKS, ""))


def _is_unit(tail: Column) -> Column:
    """Whether a trimmed tail without double blanks is a unit by its words: three at most, the first one not of the list."""
    first = F.lower(F.rtrim(F.substring_index(tail, " ", 1), F.lit(".,;:)")))
    return (F.length(tail) - F.length(F.replace(tail, F.lit(" "), F.lit(""))) <= 2) & ~first.isin(NOT_A_UNIT)


# A cell is cut once into runs of digits and the words between them: the words in front of the first run say whose interval it is and
# which side it bounds, the words between two runs whether they are its ends, the rest whether it is a unit. Each step gives columns
# from the columns of the step before it, so that a table can take them as projections, in generated code and without repetition.
Step = Callable[[Callable[[str], Column]], dict[str, Column]]


def _bare(c) -> dict[str, Column]:
    flat = F.translate(c("text"), DASHES + _BLANKS, "-" * len(DASHES) + " " * len(_BLANKS))
    bare = F.btrim(F.btrim(F.btrim(flat), F.lit("()")))
    printed = F.btrim(F.btrim(F.btrim(c("text"), F.lit(_BLANKS)), F.lit("()")), F.lit(_BLANKS))
    return {"flat": bare, "said": F.translate(printed, DASHES, "-" * len(DASHES))}


def _cut(c) -> dict[str, Column]:
    power = F.translate(c("flat"), "^˄*", "") != c("flat")
    flat = F.when(power, F.regexp_replace(c("flat"), r"(?<=[0-9.,] {1,9})10(?= *[\^˄*])", _TEN)).otherwise(c("flat"))
    return {"said": c("said"), "flat": flat, "words": F.split(F.regexp_replace(flat, _RUN, "\x02$0\x02"), "\x02")}


def _parts(c) -> dict[str, Column]:
    # words and runs take turns
    piece = lambda k: F.coalesce(F.get(c("words"), F.lit(k)), F.lit(""))
    head = F.lower(F.trim(piece(0)))
    signed = F.right(head, F.lit(1)).isin(*TOPS[:2], *BOTTOMS[:2])
    worded = head.isin(TOPS[2], BOTTOMS[2]) & F.endswith(piece(0), F.lit(" "))
    size = lambda *ks: sum((F.length(piece(k)) for k in ks), F.lit(1))
    return {
        "said": c("said"), "words": c("words"), "a": piece(1), "b": piece(3), "joiner": F.lower(F.trim(piece(2))), "head": head,
        "sign": F.when(signed, F.right(head, F.lit(1))).when(worded, head).otherwise(""), "one": F.trim(F.substr(c("flat"), size(0, 1))), "two": F.trim(F.substr(c("flat"), size(0, 1, 2, 3))),
    }


def _kinds(c) -> dict[str, Column]:
    label = F.replace(F.left(c("head"), F.length(c("head")) - F.length(c("sign"))), F.lit(" "), F.lit(""))
    tail = F.when(c("sign") == "", c("two")).otherwise(c("one"))
    later = F.replace(F.replace(F.lower(F.array_join(F.slice(c("words"), F.lit(3), F.size(c("words"))), " ")), F.lit(" :"), F.lit(":")), F.lit(" ."), F.lit("."))
    again = F.arrays_overlap(F.split(later, " "), F.array(*[F.lit(x) for x in LABELS + CHILDREN]))
    return {
        "said": c("said"), "a": c("a"), "b": c("b"), "sign": c("sign"), "pair": (c("sign") == "") & c("joiner").isin(JOINERS), "tail": F.regexp_replace(tail, " {2,}", " "),
        "whose": (label == "") | (label.isin(LABELS) & ~again),  # a second label means two intervals
    }


def _ends(c) -> dict[str, Column]:
    unit = c("whose") & ((c("tail") == "") | ((c("tail").rlike(UNIT_START) | (c("pair") & F.startswith(c("tail"), F.lit(_TEN)))) & _is_unit(c("tail"))))
    return {"said": c("said"), "a": F.when(unit, parse_number(c("a"))), "b": F.when(unit & c("pair"), parse_number(c("b"))), "sign": c("sign"), "pair": c("pair")}


def _told(c) -> dict[str, Column]:
    both = c("pair") & c("a").isNotNull() & c("b").isNotNull()
    return {"said": c("said"), "low": F.when(both | c("sign").isin(BOTTOMS), c("a")), "high": F.when(both, c("b")).when(c("sign").isin(TOPS), c("a"))}


_STEPS: list[Step] = [_bare, _cut, _parts, _kinds, _ends, _told]


def _span(c) -> Column:
    text = F.when(c("low").isNull() & c("high").isNull() & (c("said") != ""), c("said"))
    return F.struct(c("low").alias("low"), c("high").alias("high"), text.alias("text"))


def _expression(text: Column, steps: list[Step], last: Callable[[Callable[[str], Column]], Column]) -> Column:
    def taken(step: Step) -> Callable[[Column], Column]:
        return lambda s: F.struct(*[v.alias(k) for k, v in step(lambda n: s[n]).items()])

    whole = F.struct(text.alias("text"))
    for step in steps:
        whole = bound(whole, taken(step))
    return bound(whole, lambda s: last(lambda n: s[n]))


def _projections(rows: DataFrame, text: Column, into: str, steps: list[Step], last: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    kept, at = rows.columns, lambda n: F.col(f"__{n}")
    rows = rows.withColumn("__text", text)
    for step in steps:
        rows = rows.select(*kept, *[v.alias(f"__{k}") for k, v in step(at).items()])
    return rows.withColumn(into, last(at)).select(*[c for c in kept if c != into], into)


def parse_range(text: Column) -> Column:
    """STRUCT<low, high, text> of a printed interval; what is no interval stays as its text. One expression; for a table's column
    with_range() gives the same in less time."""
    return _expression(text, _STEPS, _span)


def with_range(rows: DataFrame, text: Column, into: str) -> DataFrame:
    """rows with the column `into`, what parse_range() gives for text."""
    return _projections(rows, text, into, _STEPS, _span)


#: The powers in which laboratories count, and spellings that stand for such a unit or for none.
POWERS = ["3", "6", "9", "12"]
COUNTS = {"G/l": "10^9/l", "T/l": "10^12/l"}
DIMENSIONLESS = ["", "-", "–", "—", "1", "1/1"]
#: Units whose micro sign may be printed as u.
MICRO = {f"u{stem}": f"µ{stem}" for stem in ("mol", "kat", "g", "l")}
#: Spellings of a power of ten, without blanks: a sign of multiplication or none, ten, a sign of power or none, the power.
_TENS = [f"{times}10{sign}{power}" for times in ("", "x", "×", "*") for sign in ("", "^", "*", "E", "e") for power in POWERS]


# A unit is cut into runs of letters and runs of other signs; each run is spelled by what it is and by its neighbours, and the
# numerator of a count is looked up among the spellings of powers of ten.
def _tight(c) -> dict[str, Column]:
    flat = F.translate(c("text"), "μ˄" + _BLANKS, "µ^" + " " * len(_BLANKS))
    words = F.btrim(F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat))
    return {"tight": F.replace(F.replace(words, F.lit(" /"), F.lit("/")), F.lit("/ "), F.lit("/"))}


def _tokens(c) -> dict[str, Column]:
    # most units have none of the signs that can be spelled in two manners
    odd = F.translate(c("tight"), "uL^" + _DIGITS, "") != c("tight")
    return {"tight": c("tight"), "tokens": F.when(odd, F.split(F.regexp_replace(c("tight"), "[A-Za-z]+", "\x02$0\x02"), "\x02")).otherwise(F.array(c("tight")))}


def _spelled(c) -> dict[str, Column]:
    tokens = c("tokens")
    at = lambda k: F.coalesce(F.get(tokens, k), F.lit(""))

    def one(token: Column, i: Column) -> Column:
        # around letters stand other signs, maybe none
        before, behind = F.right(at(i - 1), F.lit(1)), at(i + 1)
        digit = lambda x: x.isin(list(_DIGITS))
        spelled = F.when(F.left(token, F.lit(2)).isin("^2", "^3") & F.endswith(at(i - 1), F.lit("m")), F.substr(token, F.lit(2)))
        spelled = spelled.when((token == "L") & (before == "/") & ~digit(F.left(behind, F.lit(1))), "l")
        spelled = spelled.when((token == "m") & digit(before) & F.left(F.ltrim(behind, F.lit("^")), F.lit(1)).isin("2", "3"), " m")
        for printed, spelling in MICRO.items():
            spelled = spelled.when(token == printed, spelling)
        return spelled.otherwise(token)

    out = F.when(F.size(tokens) > 1, F.array_join(F.transform(tokens, one), "")).otherwise(c("tight"))
    return {"tight": c("tight"), "out": out, "numerator": F.replace(F.substring_index(c("tight"), "/", 1), F.lit(" "), F.lit(""))}


def _unit(c) -> Column:
    power = F.when(F.endswith(c("numerator"), F.lit("12")), "12").otherwise(F.right(c("numerator"), F.lit(1)))
    unit = F.when(c("tight").isin(DIMENSIONLESS), "")
    for printed, spelling in COUNTS.items():
        unit = unit.when(c("out") == printed, spelling)
    counted = c("numerator").isin(_TENS) & F.contains(c("tight"), F.lit("/"))
    return unit.when(counted, F.concat(F.lit("10^"), power, F.substr(c("out"), F.instr(c("out"), "/")))).otherwise(c("out"))


_UNIT_STEPS: list[Step] = [_tight, _tokens, _spelled]


def canonical_unit(unit: Column) -> Column:
    """One spelling for each unit; dimensionless ones are the empty string, NULL stays NULL. One expression; for a table's column
    with_unit() gives the same in less time."""
    return _expression(unit, _UNIT_STEPS, _unit)


def with_unit(rows: DataFrame, unit: Column, into: str) -> DataFrame:
    """rows with the column `into`, what canonical_unit() gives for unit."""
    return _projections(rows, unit, into, _UNIT_STEPS, _unit)


def unit_key(unit: Column) -> Column:
    """A unit as compared: its canonical spelling without case and spaces."""
    return F.lower(F.regexp_replace(F.coalesce(canonical_unit(unit), F.lit("")), r"\s+", ""))


def compute_flag(value: Column, low: Column, high: Column) -> Column:
    """normal, low, high or unknown; a bound itself is normal."""
    return F.when(value.isNull() | (low.isNull() & high.isNull()), "unknown").when(value < low, "low").when(value > high, "high").otherwise("normal")


def censored_flag(raw: Column, high: Column) -> Column:
    """The flag of a result printed as a lower bound: high if it is past the interval's top. Below-a-bound results stay
    unknown."""
    bare = F.translate(raw, VALUE_MARKS + _BLANKS, "")
    inclusive = F.startswith(bare, F.lit(">=")) | F.startswith(bare, F.lit("≥"))
    number = parse_number(F.ltrim(bare, F.lit(">=≥")))
    past = F.when(inclusive, number > high).when(F.startswith(bare, F.lit(">")), number >= high)
    return F.when(F.coalesce(past, F.lit(False)), "high").otherwise("unknown")


def significant(value: Column, digits: int = 4) -> Column:
    """Rounded to that many significant digits."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.round(value * power, 0) / power)


def direction(new: Column, old: Column, share: float) -> Column:
    """rising, falling or stable: a change of at most that share of the old value is none; single without an old value."""
    eps = F.greatest(F.abs(old) * share, F.lit(1e-9))
    return F.when(old.isNull(), "single").when(F.abs(new - old) <= eps, "stable").when(new > old, "rising").otherwise("falling")


def implausible(value: Column, low: Column, high: Column) -> Column:
    """impossible beyond a hundred widths of the interval; suspect-decimal if out of it and a shift by one decimal place falls
    inside; else NULL."""
    span = F.when(high - low != 0, high - low).otherwise(high)
    impossible = (value > high + span * 100) | (value < F.greatest(F.lit(0.0), low - span * 100))
    shifted = (value * 10).between(low, high) | (value * 0.1).between(low, high)
    out = (value > high) | (value < low)
    return F.when((high > 0) & impossible, "impossible").when((high > 0) & out & shifted, "suspect-decimal")
