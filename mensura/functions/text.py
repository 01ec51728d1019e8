"""Folding and searching of text, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII that printed numbers use for grouping: no-break, narrow no-break, thin, figure space, BOM.
WIDE_SPACES = "\u00a0\u202f\u2009\u2007\ufeff"


def _fold_table() -> tuple[str, str]:
    """Letters of the Latin blocks with marks, and their base letters: one for one, so offsets stay the same."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


FOLD = _fold_table()


def strip_marks(text: Column) -> Column:
    """Letters without their diacritical marks; combining marks go."""
    return F.regexp_replace(F.translate(text, *FOLD), r"\p{M}", "")


def fold(text: Column) -> Column:
    """Lower case without marks, of the same length as the text (when it has no combining marks)."""
    return F.translate(F.lower(text), *FOLD)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^[\s{WIDE_SPACES}]+|[\s{WIDE_SPACES}]+$", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[\s{WIDE_SPACES}]+", " "))


def excerpt(text: Column, at: Column, length: Column, around: int) -> Column:
    """`around` characters before and behind text[at, at + length), at from 1, with an ellipsis where something is left out."""
    start = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text) + 1, at + length + around)
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substr(text, start, end - start), F.when(end <= F.length(text), "…").otherwise(""))
