"""String functions."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters with marks, and what they fold to.
MARKED = "àáâãäåāăąçćčďèéêëēĕėęěìíîïīįłñńňòóôõöøōőŕřśşšťţùúûüūůűýÿźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŁŠŽ"
PLAIN = "aaaaaaaaacccdeeeeeeeeeiiiiiilnnnooooooooorrsssttuuuuuuuyyzzzAAAAAACEEEEIIIINOOOOOOUUUUYLSZ"

# English month names by their number.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks; ß, æ and œ become two letters."""
    out = F.translate(text, MARKED, PLAIN)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def match_form(text: Column) -> Column:
    """How values are compared: lower case, no spaces, no marks."""
    return fold_accents(F.replace(F.lower(text), F.lit(" ")))


def short_uri(uri: Column) -> Column:
    """The last path segment, without a `^^http…` type behind it."""
    return F.element_at(F.split(F.split_part(uri, F.lit("^^http"), F.lit(1)), "/"), -1)


def answer_number(short: Column) -> Column:
    """A number for an item (1 before its digits) or a date (2 before them); null for neither."""
    digits = F.regexp_replace(short, "[^0-9]", "")
    kind = F.when(short.rlike("^[QP][0-9]+$"), "1").when(short.rlike(r"^[+-]?[0-9]+-[0-9]{2}-[0-9]{2}"), "2")
    return F.concat(kind, digits).try_cast("decimal(38,0)")


def words_of_date(stamp: Column) -> Column:
    """`+1990-05-00T00:00:00Z` as words at the precision it has: `May 1990`, `03 May 1990`, `11:30 03 May 1990`; ` bc` after negative years.

    Month and day 00 are left out. A text that is no stamp, or a year of more than four digits, gives the part before the first inner hyphen.
    """
    rx = r"^[+-]?([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})Z$"
    part = lambda i: F.regexp_extract(stamp, rx, i)
    suffix = F.when(stamp.startswith("-"), " bc").otherwise("")
    month = F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.nullif(part(2), F.lit("")).try_cast("int") - 1)
    valid = stamp.rlike(rx) & (part(2) <= "12") & (part(3) <= "31") & ~((part(2) == "00") & (part(3) != "00"))
    words = F.concat_ws(" ", F.when((part(4) != "00") | (part(5) != "00"), F.concat(part(4), F.lit(":"), part(5))), F.when(part(3) != "00", part(3)), F.when(part(2) != "00", month), F.concat(part(1), suffix))
    return F.when(valid, words).otherwise(F.concat(F.split_part(F.regexp_replace(stamp, r"^[+-]", ""), F.lit("-"), F.lit(1)), suffix))


def date_precision(stamp: Column) -> Column:
    """year, month, day or time; null for no stamp."""
    rx = r"^[+-]?[0-9]+-([0-9]{2})-([0-9]{2})(?:T([0-9:]*)Z?)?$"
    part = lambda i: F.regexp_extract(stamp, rx, i)
    return F.when(~stamp.rlike(rx), None).when(part(1) == "00", "year").when(part(2) == "00", "month").when(part(3).isin("", "00:00:00"), "day").otherwise("time")


def within_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` bytes of UTF-8, no character cut."""
    lead = lambda i: F.substring(text, F.lit(1), i)
    top = F.least(F.length(text), F.lit(most))
    fits = F.filter(F.sequence(F.greatest(F.lit(0), F.floor(F.lit(most / 4)).cast("int")), F.greatest(top, F.floor(F.lit(most / 4)).cast("int"))), lambda i: F.octet_length(lead(i)) <= most)
    return F.when(F.octet_length(text) <= most, text).otherwise(lead(F.array_max(fits)))


def initials(name: Column) -> Column:
    """`J. R. Smith`-style and last-name forms of a person's name, with the name itself, without Jr., Sr. and numerals."""
    bare = F.trim(F.regexp_replace(name, r",? +(Jr\.?|Sr\.?|II|III|IV)$", ""))
    parts = F.split(bare, " +")
    last = F.element_at(parts, -1)
    firsts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    dotted = F.concat_ws(" ", F.transform(firsts, lambda p: F.concat(F.substring(p, 1, 1), F.lit("."))), F.array(last))
    return F.when(name.isNotNull(), F.array_distinct(F.array(name, bare, dotted, last)))


def value_in_text(key: Column, value: Column, text: Column, least: int = 5) -> Column:
    """Whether a value is grounded in a text: as a substring if it has `least` characters, else word by word; case is left aside."""
    low, words = F.lower(text), F.split(F.lower(text), "[^0-9a-z]+")
    tokens = F.filter(F.split(F.lower(value), "[^0-9a-z]+"), lambda t: t != "")
    return F.when(F.length(value) >= least, low.contains(F.lower(value))).otherwise((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.array_contains(words, t)))


def says_nothing(value: Column) -> Column:
    """Null, `n/a`, or without a letter or digit."""
    return value.isNull() | (F.lower(value) == "n/a") | ~value.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")


def ratio(a: str, b: str) -> float:
    """Likeness of two strings, 0 to 100."""
    return 100.0 * SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness, 0 to 100; null if either is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def fuzzy_find(text: str, part: str, most: int = 2) -> int | None:
    """Where the first substring within `most` edits of part ends best; its start, or null."""
    m = len(part)
    row, starts = list(range(m + 1)), [0] * (m + 1)
    best: tuple[int, int] | None = None
    for j, c in enumerate(text, 1):
        new, ns = [0], [j]
        for i in range(1, m + 1):
            options = ((row[i - 1] + (part[i - 1] != c), starts[i - 1]), (row[i] + 1, starts[i]), (new[i - 1] + 1, ns[i - 1]))
            cost, at = min(options)
            new.append(cost)
            ns.append(at)
        row, starts = new, ns
        if row[m] <= most and (best is None or row[m] < best[0]):
            best = (row[m], starts[m])
    return None if best is None else best[1]


def fuzzy_position(most: int = 2):
    """A function (text, part) to the 0-based start of a substring within `most` edits, null if there is none."""

    @F.pandas_udf(T.IntegerType())
    def f(text: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or p is None else fuzzy_find(t, p, most) for t, p in zip(text, part)], dtype="Int32")

    return f


def counts_of_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def detokenise(text: Column) -> Column:
    """Spaces before closing and after opening marks, and around apostrophes, removed."""
    out = F.regexp_replace(text, r" +([.,!?;:)\]%])", "$1")
    out = F.regexp_replace(out, r"([(\[$]) +", "$1")
    return F.regexp_replace(F.regexp_replace(out, r" +('s|n't|'re|'ve|'ll|'d|'m)\b", "$1"), r"`` *([^']*?) *''", '"$1"')


def camel_words(text: Column) -> Column:
    """`eatType` as `eat type`."""
    return F.lower(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"))


def rule_filter(key: Column, text: Column, rules: dict[str, Sequence[str]]) -> Column:
    """Whether one of a key's words stands in the text; keys without rules pass."""
    out, low = None, F.lower(text)
    for k, needles in rules.items():
        hit = F.greatest(*[low.contains(n.lower()).cast("int") for n in needles], F.lit(0)) == 1
        out = F.when(key == k, hit) if out is None else out.when(key == k, hit)
    return F.lit(True) if out is None else out.otherwise(F.lit(True))
