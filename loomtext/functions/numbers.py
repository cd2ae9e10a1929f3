"""English number words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number words.
UNITS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
POWERS = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}


def number_of(text: str) -> int | None:
    """The number that words name, null where they name none.

    `nineteen eighty four` is 1984: two numbers below a hundred in a row imply a hundred between
    them, which no thousand or greater may follow. `and` and hyphens don't count; magnitudes must fall.
    """
    words = [w for w in re.split(r"[\s-]+", text.strip().lower()) if w and w != "and"]
    if not words:
        return None
    if words == ["zero"]:
        return 0
    total, group, pair, implied, lowest = 0, None, None, False, None
    #: group: hundreds so far; pair: number below a hundred being read
    hundreds = False
    for w in words:
        if w in TENS or w in UNITS:
            v = TENS.get(w, UNITS.get(w))
            if w == "zero":
                return None
            if pair is None:
                pair = v
            elif pair in TENS.values() and 0 < v < 10:
                pair += v
            elif group is None and not implied and total == 0 and not hundreds and v >= 10:
                group, pair, implied = pair * 100, v, True
            else:
                return None
        elif w == "hundred":
            if pair is None or hundreds or implied:
                return None
            group, pair, hundreds = pair * 100, None, True
        elif w in POWERS:
            if implied or (group is None and pair is None) or (lowest is not None and POWERS[w] >= lowest):
                return None
            total += ((group or 0) + (pair or 0)) * POWERS[w]
            group, pair, hundreds, lowest = None, None, False, POWERS[w]
        else:
            return None
    return total + (group or 0) + (pair or 0)


@F.pandas_udf(T.LongType())
def number_words(text: pd.Series) -> pd.Series:
    """The number of number words; null for other texts and null."""
    return pd.Series([None if t is None else number_of(t) for t in text], dtype="Int64")


def number_phrase(n: int) -> str:
    """The words of a number."""
    if n < 20:
        return next(w for w, v in UNITS.items() if v == n)
    if n < 100:
        return next(w for w, v in TENS.items() if v == n // 10 * 10) + (f" {number_phrase(n % 10)}" if n % 10 else "")
    if n < 1000:
        return f"{number_phrase(n // 100)} hundred" + (f" {number_phrase(n % 100)}" if n % 100 else "")
    name, size = max(((w, p) for w, p in POWERS.items() if p <= n), key=lambda x: x[1])
    return f"{number_phrase(n // size)} {name}" + (f" {number_phrase(n % size)}" if n % size else "")
