"""Typed reading of values that are written in several ways."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions.ids import kb_id, trimmed

# Words that say there is no value.
NO_VALUE_WORDS = ["", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "novalue", "null", "somevalue", "unknown"]

# Month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

TYPES = {"item": "string", "time": "string", "quantity": "double", "string": "string"}


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    # pyarrow's own NFC leaves text decomposed
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def is_no_value(text: Column) -> Column:
    """Null, empty, a word for no value, or a blank node."""
    plain = F.lower(trimmed(text))
    return text.isNull() | plain.isin(NO_VALUE_WORDS) | plain.startswith("_:")


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once per row, however often f names it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


_NUMBER = r"^([+-]?)([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,6}))?(?:\^\^.*)?$"


def number_key(text: Column) -> Column:
    """A key that is equal exactly for equal numbers of any size; null where the text is no number.

    A comma groups thousands, `^^type` may follow, exponents are read. The key is sign, digits
    without zeros at either end, and the power of ten.
    """
    text = trimmed(text)
    parts = F.struct(*[F.regexp_extract(text, _NUMBER, i).alias(n) for i, n in ((1, "sign"), (2, "whole"), (3, "frac"), (4, "power"))])

    def scaled(p: Column) -> Column:
        return F.struct(p["sign"].alias("sign"), F.regexp_replace(F.concat(F.replace(p["whole"], F.lit(",")), p["frac"]), "^0+", "").alias("digits"), (F.coalesce(p["power"].try_cast("int"), F.lit(0)) - F.length(p["frac"])).alias("power"))

    def key(p: Column) -> Column:
        bare = F.regexp_replace(p["digits"], "0+$", "")
        power = p["power"] + F.length(p["digits"]) - F.length(bare)
        return F.when(bare == "", "0").otherwise(F.concat(F.when(p["sign"] == "-", "-").otherwise(""), bare, F.lit("e"), power.cast("string")))

    return F.when(text.rlike(_NUMBER), _with(_with(parts, scaled), key))


_STAMP = r"^([+-]?)([0-9]{1,9})-([0-9]{2})-([0-9]{2})(?:[T ][0-9:.]*Z?)?(?:\^\^.*)?$"
_DAY_FIRST = r"^([0-9]{1,2})\.? +([A-Za-z]+),? +([0-9]{1,9})$"
_MONTH_FIRST = r"^([A-Za-z]+) +([0-9]{1,2}),? +([0-9]{1,9})$"


def time_key(text: Column) -> Column:
    """`+1990-05-00` from a stamp, `5 May 1990` or `May 5, 1990`; null for what is no date.

    Month and day 00 stay. There is no year 0, no month 13, and no day that the month hasn't.
    """
    text = trimmed(text)
    name = lambda c: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(c)).cast("int")
    get = lambda rx, i: F.regexp_extract(text, rx, i)
    num = lambda c: c.cast("int")
    stamp = F.struct(F.when(get(_STAMP, 1) == "-", "-").otherwise("+").alias("s"), F.regexp_replace(get(_STAMP, 2), "^0+", "").alias("y"), num(F.nullif(get(_STAMP, 3), F.lit(""))).alias("m"), num(F.nullif(get(_STAMP, 4), F.lit(""))).alias("d"))
    worded = lambda rx, m, d: F.struct(F.lit("+").alias("s"), F.regexp_replace(get(rx, 3), "^0+", "").alias("y"), name(get(rx, m)).alias("m"), num(F.nullif(get(rx, d), F.lit(""))).alias("d"))
    v = F.when(text.rlike(_STAMP), stamp).when(text.rlike(_DAY_FIRST), worded(_DAY_FIRST, 2, 1)).when(text.rlike(_MONTH_FIRST), worded(_MONTH_FIRST, 1, 2))
    worded_day = ~text.rlike(_STAMP)

    def key(v: Column) -> Column:
        year = v["y"].try_cast("int")
        leap = (v["s"] == "-") | ((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)))
        last = F.when(v["m"].isin(4, 6, 9, 11), 30).when(v["m"] == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        good = (v["y"] != "") & (v["m"] <= 12) & (v["d"] <= last) & ~(worded_day & ((v["m"] == 0) | (v["d"] == 0)))
        return F.when(good, F.concat(v["s"], F.when(F.length(v["y"]) < 4, F.lpad(v["y"], 4, "0")).otherwise(v["y"]), F.lit("-"), F.lpad(v["m"].cast("string"), 2, "0"), F.lit("-"), F.lpad(v["d"].cast("string"), 2, "0")))

    return _with(v, key)


def value_key(kind: Column, text: Column) -> Column:
    """The value as a string that is equal for equal values of the type `kind`; null for no value.

    item: Q and digits. quantity: see number_key. time: see time_key. string: trimmed, in NFC.
    Other kinds give null. Only strings that aren't plain ASCII go through Python, in Arrow batches.
    """
    odd = (kind == "string") & text.rlike(r"[^\x00-\x7F]")
    composed = nfc(F.when(odd, text))
    plain = F.when(kind == "item", kb_id(text, "Q")).when(kind == "quantity", number_key(text)).when(kind == "time", time_key(text)).when(kind == "string", trimmed(F.coalesce(composed, text)))
    return F.when(~is_no_value(text), plain)


def key_to_double(key: Column) -> Column:
    """The number of a number_key."""
    return key.try_cast("double")
