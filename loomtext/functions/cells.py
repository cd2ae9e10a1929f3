"""Cells of extracted rows: array<struct<normed: string, alts: array<string>>>.

A cell holds values in their order; each has a normalised form and the spellings that stand for
it. Empty text is turned into an empty cell on the way in and back on the way out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = "array<struct<normed:string,alts:array<string>>>"


def empty_cell() -> Column:
    return F.array().cast(CELL)


def cell_of(values: Column) -> Column:
    """A cell of an array of strings, repeats and empty values left out."""
    kept = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    return F.coalesce(F.transform(kept, lambda v: F.struct(v.alias("normed"), F.array(v).alias("alts"))).cast(CELL), empty_cell())


def cell_of_text(text: Column, single: bool = False) -> Column:
    """A cell of a text that lists values by ", "; `single` keeps it whole. Empty text gives an empty cell."""
    return cell_of(F.array(F.trim(text)) if single else F.transform(F.split(text, ", "), lambda x: F.trim(x)))


def merge_cells(cells: Column) -> Column:
    """One cell of an array of cells; values equal in normed are combined, the first keeps its place."""
    flat = F.flatten(cells)

    def add(acc: Column, v: Column) -> Column:
        known = F.exists(acc, lambda a: a["normed"] == v["normed"])
        joined = F.transform(acc, lambda a: F.when(a["normed"] == v["normed"], F.struct(a["normed"].alias("normed"), F.array_union(a["alts"], v["alts"]).alias("alts"))).otherwise(a))
        return F.when(known, joined).otherwise(F.array_append(acc, v))

    return F.aggregate(flat, empty_cell(), lambda acc, v: add(acc, v).cast(CELL))


def cell_text(cell: Column) -> Column:
    """The normalised values of a cell, listed by ", "; empty text for an empty or null cell."""
    return F.coalesce(F.array_join(F.transform(cell, lambda v: v["normed"]), ", "), F.lit(""))


def cell_has(cell: Column, spellings: Column) -> Column:
    """Whether a value of the cell is one of the spellings, case left aside."""
    wanted = F.transform(spellings, F.lower)
    return F.coalesce(F.exists(cell, lambda v: F.array_contains(wanted, F.lower(v["normed"])) | F.arrays_overlap(F.transform(v["alts"], F.lower), wanted)), F.lit(False))
