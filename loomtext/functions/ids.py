"""Identifiers that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White_Space of Unicode.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def kb_id(text: Column, letter: str) -> Column:
    """`Q12` from `Q12`, ` q12`, `kb:Q12` or `http://host/path/q12`; null where there is no such id.

    The id is the last part after `/`, `:` or `#`. Null stays null.
    """
    last = trimmed(text)
    for mark in "/:#":
        last = F.substring_index(last, mark, -1)
    last = F.ltrim(last)
    digits = F.substring(last, F.lit(2), F.length(last))
    found = F.substring(last, 1, 1).isin(letter.upper(), letter.lower()) & digits.rlike("^[0-9]+$")
    return F.when(found, F.concat(F.lit(letter), digits))
