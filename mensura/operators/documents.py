"""Search in documents, excerpts, redaction and citation numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import birth_number
from ..functions.numbers import bound
from ..functions.text import excerpt, fold


def search(docs: DataFrame, query: str, top: int = 10, around: int = 240) -> DataFrame:
    """The newest `top` documents (by doc_id) that contain the query, whatever the case and marks, with an excerpt. The fold
    keeps offsets, so the place in the folded text is that in the text. Every match is checked before the limit."""
    from ..functions.text import FOLD

    needle = query.lower().translate(str.maketrans(*FOLD))
    at = F.instr(fold(F.col("text")), F.lit(needle))
    rows = docs.withColumn("at", at).where("at > 0").orderBy(F.desc("doc_id")).limit(top)
    return rows.select("doc_id", "at", excerpt(F.col("text"), F.col("at"), F.lit(len(needle)), around).alias("excerpt"))


def all_tokens(text: Column, query: str) -> Column:
    """Whether each of the query's words is part of the text, whatever the case and marks."""
    from ..functions.text import FOLD

    found = F.lit(True)
    for token in query.lower().translate(str.maketrans(*FOLD)).split():
        found = found & F.contains(fold(text), F.lit(token))
    return found


def substantive(text: Column, heading: str | None = None, least: int = 80, most: int = 240) -> Column:
    """The first paragraph of `least` characters and half letters or more, else the head; at most `most` characters. With a heading,
    what stands behind it goes first."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: (F.length(p) >= least) & (F.regexp_count(p, F.lit(r"\p{L}")) * 2 >= F.length(p)))
    found = F.coalesce(F.get(good, F.lit(0)), F.trim(F.coalesce(text, F.lit(""))))
    if heading:
        behind = F.regexp_extract(text, rf"(?is){heading}\s*:?\s*(\S.*)", 1)
        found = F.when(behind != "", behind).otherwise(found)
    return F.substr(found, F.lit(1), F.lit(most))


#: What counts as identity in a text, by name, and what it is replaced with.
IDENTITY = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "phone": r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}",
    "number": r"\b[0-9]{6}/[0-9]{3,4}\b",
}


#: A sign without which a kind can't occur: a quick look before the pattern.
_NEEDED = {"email": "@", "ip": ".", "phone": "+", "number": "/"}


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, the text without addresses and numbers, and how many of each kind were found; surviving: how many are found when the
    result is read again. Each kind is a step of its own, so no pattern runs twice over a text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    for kind, pattern in IDENTITY.items():
        may = F.contains("_t", F.lit(_NEEDED[kind]))
        rows = rows.withColumn(f"n_{kind}", F.when(may, F.regexp_count("_t", F.lit(pattern))).otherwise(0))
        rows = rows.withColumn("_t", F.when(F.col(f"n_{kind}") > 0, F.regexp_replace("_t", pattern, f"[{kind}]")).otherwise(F.col("_t")))
    left = sum((F.when(F.contains("_t", F.lit(_NEEDED[k])), F.regexp_count("_t", F.lit(p))).otherwise(0) for k, p in IDENTITY.items()), F.lit(0))
    return rows.select("doc_id", F.col("_t").alias("redacted"), *[f"n_{k}" for k in IDENTITY], left.alias("surviving"))


#: The labels in front of a person's data, in folded text, by kind; other labels end a value.
LABELS = {
    "birth-date": r"datum narozeni|datum nar\.?|dat\. ?nar\.?|narozena|narozen|nar\.",
    "birth-number": r"rodne cislo|rod\.? ?cislo|rod\. ?c\.|r\. ?c\.|rc|cislo pojistence|c\. ?pojistence|c\. ?poj\.|identifikace pacienta|id pacienta|id(?=\s*:)",
    "address": r"trvale bydliste|trvaly pobyt|bydliste|adresa pacienta|adresa|ulice",
    "name": r"jmeno a prijmeni|prijmeni a jmeno|jmeno pacienta|pacient/ka|pacientka|pacient|prijmeni|jmeno|nemocny|klient",
}
#: The formats of birth numbers and of birth dates.
BIRTH_NUMBER = r"\d(?:\s?\d){5}\s?/?\s?\d(?:\s?\d){2,3}"
BIRTH_DATE = r"\d{1,2}\.\s?\d{1,2}\.\s?(?:\d{4}|\d{2})(?!\d)|\d{4}-\d{2}-\d{2}"
_ANY = rf"(?<![a-z0-9])(?:{'|'.join(f'({x})' for x in LABELS.values())})(?![a-z0-9])\s*:?[ \t]*"
_NEXT = rf"(?<![a-z0-9])(?:{'|'.join(LABELS.values())})(?![a-z0-9])"
_LABELLED = rf"{_ANY}(.*?)(?=\s*(?:{_NEXT}|\t|\x20{{2}}|$))"
_MASK = "\u0001"


def _labelled(value: Column) -> Column:
    """Whether a value is another label with its own: two to forty signs without a digit, then a colon."""
    label = F.substring_index(value, ":", 1)
    return F.contains(value, F.lit(":")) & F.length(label).between(2, 40) & (F.translate(label, "0123456789", "") == label)


def identity_in(text: Column, bare: bool = True) -> Column:
    """ARRAY<STRUCT<kind, value>> of a person's data in a text, folded: what stands behind a label, in its cell or the next one of
    the line (cells end at a tab or two blanks), as far as the next label; and with bare, birth numbers anywhere that decode to
    a date, unless they are nine digits in groups, as telephone numbers are."""
    kinds = list(LABELS)

    def of(line: Column) -> Column:
        hits = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(_LABELLED), F.lit(k)).alias(f"g{k}") for k in range(1, 6)])

        def said(h: Column) -> Column:
            value = F.trim(F.regexp_replace(h["g5"], r"\s+", " "))
            number, date = F.regexp_extract(value, BIRTH_NUMBER, 0), F.regexp_extract(value, BIRTH_DATE, 0)
            own = ~_labelled(value)
            words = F.when(value.rlike("[a-z]") & (F.length(value) >= 2) & own, value)
            pair = lambda k, v: F.struct(F.lit(kinds[k]).alias("kind"), v.alias("value"))
            other = F.when((value != "") & own, value)
            return (
                F.when(h["g1"] != "", pair(0, F.when(date != "", date))).when(h["g2"] != "", pair(1, F.when(number != "", number).otherwise(other)))
                .when(h["g3"] != "", pair(2, words)).otherwise(pair(3, words))
            )

        found = F.transform(hits, said)
        if bare:
            numbers = F.filter(F.regexp_extract_all(line, F.lit(BIRTH_NUMBER), F.lit(0)), lambda n: birth_number(n)["valid"] & ~((F.length(F.regexp_replace(n, r"\D", "")) == 9) & ~F.contains(n, F.lit("/")) & n.rlike(r"\s")))
            found = F.concat(found, F.transform(numbers, lambda n: F.struct(F.lit("birth-number").alias("kind"), n.alias("value"))))
        return F.filter(found, lambda x: x["value"].isNotNull())

    # most lines have neither a label nor a number, which one look tells
    lines = F.filter(F.split(fold(text), "\n"), lambda line: line.rlike(rf"{_NEXT}|{BIRTH_NUMBER}" if bare else _NEXT))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.coalesce(F.flatten(F.transform(lines, of)), none)


def spellings(hits: Column) -> Column:
    """The spellings of identity_in()'s values that are looked for everywhere, the longest first: of names their parts too, of
    numbers with and without a slash."""

    def each(h: Column) -> Column:
        digits = F.regexp_replace(h["value"], r"\D", "")
        slashed = F.concat(F.left(digits, F.lit(6)), F.lit("/"), F.substr(digits, F.lit(7)))
        number = F.when(F.length(digits).isin(9, 10), F.array(h["value"], digits, slashed)).otherwise(F.array(h["value"]))
        return F.when(h["kind"] == "name", identity_variants(h["value"])).when(h["kind"] == "birth-number", number).otherwise(F.array(h["value"]))

    every = F.array_distinct(F.flatten(F.transform(hits, each)))
    return F.transform(F.reverse(F.array_sort(F.transform(every, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))), lambda x: x["v"])


def _whole(needle: Column) -> Column:
    return F.concat(F.lit(r"(?<![a-z0-9])\Q"), needle, F.lit(r"\E(?![a-z0-9])"))


def masked(text: Column, needles: Column) -> Column:
    """The text with every whole occurrence of the needles blacked out, whatever its case and marks; nothing else changes."""
    black = F.aggregate(needles, fold(text), lambda t, n: F.regexp_replace(t, _whole(n), F.repeat(F.lit(_MASK), F.length(n))))

    def rebuilt(folded: Column) -> Column:
        # kept pieces and blacked runs take turns; the fold keeps places, so the original is cut at the same ones
        runs = F.arrays_zip(F.split(folded, f"{_MASK}+").alias("piece"), F.regexp_extract_all(folded, F.lit(f"{_MASK}+"), F.lit(0)).alias("run"))
        start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
        n = lambda c: F.coalesce(F.length(c), F.lit(0))
        step = lambda s, x: F.struct((s["at"] + n(x["piece"]) + n(x["run"])).alias("at"), F.concat(s["out"], F.substr(text, s["at"], n(x["piece"])), F.repeat(F.lit("█"), n(x["run"]))).alias("out"))
        return F.aggregate(runs, start, step)["out"]

    return F.when(F.size(needles) > 0, bound(black, rebuilt)).otherwise(text)


def surviving(text: Column, needles: Column) -> Column:
    """The needles that can still be read in a text."""
    return F.filter(needles, lambda n: F.regexp_like(fold(text), _whole(n)))


def without_identity(docs: DataFrame, bare: bool = True) -> DataFrame:
    """doc_id, redacted, kinds (joined by commas), spellings (their number) and surviving (spellings that the result still has) of docs
    (doc_id, text): labelled data are found first, then every spelling of them anywhere in the text is blacked out."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).withColumn("_hits", identity_in(F.col("_t"), bare))
    rows = rows.withColumn("_needles", spellings(F.col("_hits"))).withColumn("redacted", masked(F.col("_t"), F.col("_needles")))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["kind"]))), ",")
    return rows.select("doc_id", "redacted", kinds.alias("kinds"), F.size("_needles").alias("spellings"), F.size(surviving(F.col("redacted"), F.col("_needles"))).alias("surviving"))


def identity_variants(name: Column) -> Column:
    """The spellings of a person's name that are looked for: as given, reversed, its parts; folded, of three characters or
    more."""
    parts = F.split(fold(name), r"\s+")
    every = F.array_distinct(F.concat(F.array(fold(name), F.array_join(F.reverse(parts), " ")), parts))
    return F.filter(every, lambda v: F.length(v) >= 3)


def citation_numbers(rows: DataFrame, group: str, key: str, order: list[str]) -> DataFrame:
    """Numbers of the distinct keys of each group, by first occurrence, ties by key."""
    first = rows.groupBy(group, key).agg(F.min(F.struct(*order)).alias("at"), F.count(F.lit(1)).alias("uses"))
    return first.select(group, key, "uses", F.row_number().over(Window.partitionBy(group).orderBy("at", key)).cast("long").alias("number"))


def tail(rows: DataFrame, group: str, order: str, n: int = 12) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return rows.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def nearest_heading(rows: DataFrame, group: str, order: str, is_heading: Column, value: Column) -> DataFrame:
    """rows with the value of the last heading at or above; a heading without a value ends the one before it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(F.when(is_heading, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"])
