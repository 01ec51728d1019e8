"""Match keys of printed names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import bound, unit_key
from .text import fold, squeezed, strip_marks

#: Codes of materials in front of a name, and those of blood.
MATERIALS = ["s", "p", "b", "u", "du", "pk", "pe", "fw", "sp", "s,p", "k", "l", "x"]
BLOOD = ["s", "p", "b", "pk", "pe", "sp", "fw", "k"]
_SMALL, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_UNDERSCORE = r"(?i)^([a-z]{1,4})_"
_SEPARATED = r"(?iu)^([a-z]{1,4}(?:,[a-z]{1,4})?)[-/](?=\p{L})"
#: The code of a material in front of a name in small letters, as norm_key strips it: any before an underscore, else a known one.
_SMALL_PREFIX = rf"^(?:[a-z]{{1,4}}_|(?:{'|'.join(MATERIALS)})[-/](?=\p{{L}}))"


def material_prefix(name: Column) -> Column:
    """The code of the material in front of a name, or NULL."""
    s = F.trim(name)
    generic, listed = F.lower(F.regexp_extract(s, _UNDERSCORE, 1)), F.lower(F.regexp_extract(s, _SEPARATED, 1))
    return F.when(generic != "", generic).when(listed.isin(MATERIALS), listed)


def norm_key(name: Column) -> Column:
    """The key under which a name is looked up."""
    s = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    s = F.replace(F.regexp_replace(s, r"\s+#", " abs"), F.lit("#"), F.lit(" "))
    s = strip_marks(F.regexp_replace(F.trim(s), _SMALL_PREFIX, ""))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def abbreviation_key(name: Column) -> Column:
    """What stands in square brackets at a name's end, if it is two to six letters and digits, in lower case; else NULL."""
    s = F.lower(F.trim(name))
    inside = F.substring_index(F.left(s, F.length(s) - 1), "[", -1)
    found = F.endswith(s, F.lit("]")) & F.contains(s, F.lit("[")) & F.length(inside).between(2, 6)
    return F.when(found & (F.translate(inside, _SMALL + _DIGITS, "") == ""), inside)


def leading_code(name: Column) -> tuple[Column, Column]:
    """A short code of capitals in front of a name, and the name behind it; empty if there is none. A code is two to six capitals and
    digits, a capital first; an asterisk may stand behind it, a letter begins the name."""
    s = F.translate(F.trim(name), "\t\n\r", "   ")
    first = F.substring_index(s, " ", 1)
    code = F.when(F.endswith(first, F.lit("*")), F.left(first, F.length(first) - 1)).otherwise(first)
    behind = F.ltrim(F.substr(s, F.length(first) + 1))
    starred = F.startswith(behind, F.lit("* ")) & (code == first)
    rest = F.when(starred, F.ltrim(F.substr(behind, F.lit(2)))).otherwise(behind)
    fits = F.length(code).between(2, 6) & (F.translate(code, _SMALL.upper() + _DIGITS, "") == "") & ~F.left(code, F.lit(1)).isin(list(_DIGITS)) & rest.rlike(r"^\p{L}")
    return F.when(fits, code).otherwise(""), F.when(fits, rest).otherwise("")


def leading_code_key(name: Column) -> Column:
    """The name behind a code that can be its abbreviation: it begins with a small letter, the code's first one."""
    code, rest = leading_code(name)

    def of(x: Column) -> Column:
        fits = x["rest"].rlike(r"^\p{Ll}") & (F.left(fold(x["rest"]), F.lit(1)) == F.left(F.lower(x["code"]), F.lit(1)))
        return F.when((x["code"] != "") & fits, F.nullif(norm_key(x["rest"]), F.lit("")))

    return bound(F.struct(code.alias("code"), rest.alias("rest")), of)


def compatible(a: Column, b: Column) -> Column:
    """Whether two materials (codes joined by commas) share one, all kinds of blood being one; NULL if either is unknown."""
    family = lambda m: F.transform(F.split(m, ","), lambda x: F.when(x.isin(BLOOD), "blood").otherwise(x))
    return F.arrays_overlap(family(a), family(b))


def alias_place(lab: Column) -> Column:
    place = squeezed(F.lower(F.coalesce(lab, F.lit(""))))
    return F.when(place == "", "*").otherwise(place)


def alias_unit(unit: Column) -> Column:
    return F.when(unit.isNull(), "*").otherwise(unit_key(unit))


def alias_key(lab: Column, name: Column, unit: Column) -> Column:
    """Where a scoped alias holds; NULL of lab or unit means any."""
    return F.concat_ws("|", alias_place(lab), norm_key(name), alias_unit(unit))


def series_key(lab: Column, name: Column, unit: Column) -> Column:
    """The series of a name that isn't recognised: one laboratory's name in one unit."""
    return F.concat(F.lit("unrecognised:"), lab, F.lit("|"), norm_key(name), F.lit("|"), F.lower(F.trim(F.coalesce(unit, F.lit("")))))


def name_keys(name: Column) -> Column:
    """Every key under which a printed name is looked up, the full one first: abbreviation, name behind a code, what is outside
    and inside of brackets at the end, and the parts around a dash between blanks."""
    bracket = r"(?s)^(.*?)\s*\(([^()]+)\)\s*$"

    def of(raw: Column) -> Column:
        parts = F.split(raw, r"\s+[-–]\s+")
        keys = F.concat(
            F.array(norm_key(raw), abbreviation_key(raw), leading_code_key(raw), norm_key(F.regexp_extract(raw, bracket, 1)), norm_key(F.regexp_extract(raw, bracket, 2))),
            F.when(F.size(parts) > 1, F.transform(parts, norm_key)).otherwise(F.array().cast("array<string>")),
        )
        return F.array_distinct(F.filter(keys, lambda k: F.coalesce(k != "", F.lit(False))))

    return bound(F.trim(F.coalesce(name, F.lit(""))), of)  # a name may be a long expression; it is computed once


def materials_of(names: Column) -> Column:
    """The materials that an array of names announces, in order of occurrence, joined by commas; NULL if none does."""
    known = lambda n: F.when(material_prefix(n).isin(MATERIALS), F.split(material_prefix(n), ",")).otherwise(F.array().cast("array<string>"))
    found = F.array_join(F.array_distinct(F.flatten(F.transform(names, known))), ",")
    return F.when(found != "", found)


def merged_names(first: Column, second: Column, moved: Column) -> Column:
    """Both arrays of synonyms in order, without repeats and without the names that went to another entry."""
    return F.array_except(F.array_distinct(F.concat(first, second)), moved)


def friendly_name(name: Column) -> Column:
    """A code table's name without the bracket at its end that holds a semicolon. Brackets inside it may nest three deep."""
    s = F.trim(F.coalesce(name, F.lit("")))
    inner = r"[^()]*"
    for _ in range(3):
        inner = rf"[^()]*(?:\({inner}\)[^()]*)*"
    last = rf"(?s)^(.*)\(({inner})\)$"
    head, held = F.trim(F.regexp_extract(s, last, 1)), F.regexp_extract(s, last, 2)
    return F.when(F.contains(held, F.lit(";")) & (head != ""), head).otherwise(s)


#: Titles that are no part of a name.
TITLES = ["mudr", "mvdr", "mgr", "ing", "bc", "phdr", "rndr", "judr", "paeddr", "csc", "drsc", "dis", "phd", "prof", "doc", "dr"]


def sorted_tokens(name: Column) -> Column:
    """A person's name as compared: folded, letters only, without titles, tokens in order."""
    tokens = F.filter(F.split(F.regexp_replace(fold(name), "[^a-z]+", " "), " "), lambda t: (t != "") & ~t.isin(TITLES))
    return F.array_join(F.array_sort(tokens), " ")


def grams(text: Column, n: int) -> Column:
    """The n-character pieces of a text, with repeats."""
    last = F.length(text) - (n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the multisets of character pairs."""
    ga, gb = grams(a, 2), grams(b, 2)
    count = lambda all_, g: F.size(F.filter(all_, lambda x: x == g))
    hits = F.aggregate(F.array_distinct(ga), F.lit(0), lambda s, g: s + F.least(count(ga, g), count(gb, g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * hits / (F.size(ga) + F.size(gb)))


def trigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of character triples, with a blank at both ends."""
    ga, gb = (F.array_distinct(grams(F.concat(F.lit(" "), x, F.lit(" ")), 3)) for x in (a, b))
    return 2.0 * F.size(F.array_intersect(ga, gb)) / F.greatest(F.size(ga) + F.size(gb), F.lit(1))
