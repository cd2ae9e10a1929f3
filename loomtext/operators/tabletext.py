"""Tables written as text, and completions of language models that hold tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.ids import trimmed

BREAK = "<NEWLINE>"


def _trim_cells(line: Column) -> Column:
    """Cells of `| a | b |`, trimmed."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda x: F.trim(x))


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, F.lit(BREAK)), lambda x: F.trim(x)), lambda x: x != "")


def parse_tables(text: Column, name: str) -> Column:
    """array<array<string>> of the table headed `name:` in lines split by <NEWLINE>, up to the next heading; empty if there is none."""
    lines = text_lines(text)
    is_head = lambda x: x.rlike(r"^[^|]*:$")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<array<string>>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        inside = F.when(is_head(x), F.lower(x) == f"{name.lower()}:").otherwise(acc["inside"])
        add = acc["inside"] & ~is_head(x) & x.startswith("|")
        return F.struct(inside.alias("inside"), F.when(add, F.array_append(acc["rows"], _trim_cells(x))).otherwise(acc["rows"]).alias("rows"))

    return F.coalesce(F.aggregate(lines, start, step, lambda acc: acc["rows"]), F.array().cast("array<array<string>>"))


def parse_table(text: Column, strict: bool = False) -> Column:
    """array<array<string>> of a table of pipe lines; rows are padded or cut to the header's width, or with `strict` the whole is null when one differs."""
    rows = F.transform(F.filter(text_lines(text), lambda x: x.startswith("|")), _trim_cells)
    width = F.size(F.get(rows, F.lit(0)))
    fitted = F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width))
    whole = F.when(F.size(rows) > 0, fitted).otherwise(rows)
    return F.when(F.forall(rows, lambda r: F.size(r) == width), whole) if strict else whole


def table_text(rows: Column) -> Column:
    """The pipe lines of array<array<string>>."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), f" {BREAK} ")


def well_formed(text: Column) -> Column:
    """Whether the table in the text has rows that are all as wide as its header."""
    rows = F.transform(F.filter(text_lines(text), lambda x: x.startswith("|")), _trim_cells)
    return F.coalesce((F.size(rows) > 0) & F.forall(rows, lambda r: F.size(r) == F.size(F.get(rows, F.lit(0)))), F.lit(False))


def completion_rows(text: Column, header: Sequence[str], delimiter: str = ";") -> Column:
    """array<struct<header...>> of a completion, repaired.

    Lines with the delimiter count. Where the first names no column of the header (case aside),
    the header is put before it. Rows are padded or cut to its width, `x.0` becomes `x`, and
    columns are found by name; a column the completion lacks is empty text.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(delimiter))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), delimiter), lambda c: F.regexp_replace(F.trim(c), r"^(-?[0-9]+)\.0$", "$1")))
    low = F.array(*[F.lit(h.lower()) for h in header])
    first = F.transform(F.get(cells, F.lit(0)), F.lower)
    headed = F.coalesce(F.arrays_overlap(first, low), F.lit(False))
    names, body = F.when(headed, first).otherwise(low), F.when(headed, F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)

    def value(r: Column, h: str) -> Column:
        return F.coalesce(F.try_element_at(r, F.nullif(F.array_position(names, h.lower()), F.lit(0)).cast("int")), F.lit(""))

    return F.coalesce(F.transform(body, lambda r: F.struct(*[value(r, h).alias(h) for h in header])), F.array())


def split_outputs(text: Column, n: int) -> Column:
    """The n answers of a batched completion, cut at `Output:` or `Output 3:` lines; missing ones are empty text."""
    parts = F.split(text, r"Output( [0-9]+)?:\n")
    parts = F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts) - 1)).otherwise(parts)
    return F.slice(F.concat(F.transform(parts, trimmed), F.array_repeat(F.lit(""), n)), 1, n)


def prompt(text: Column, columns: Sequence[str], shots: Column | None = None) -> Column:
    """A request to list the columns found in a text as a delimited table, after worked examples."""
    ask = F.concat(F.lit(f"List {', '.join(columns)} of the following text as a table with ; between cells.\n"), F.coalesce(text, F.lit("")))
    return ask if shots is None else F.concat_ws("\n\n", shots, ask)


def cost(texts: Sequence[Column], answers: Sequence[Column], dollars_in: float, dollars_out: float) -> Column:
    """Dollars of a call by the words it sends and those it gets back, at prices per thousand; null texts cost nothing."""
    words = lambda x: F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != ""))
    total = lambda xs: sum((words(x) for x in xs), F.lit(0))
    return (total(texts) * F.lit(dollars_in) + total(answers) * F.lit(dollars_out)) / 1000


def allowed_tokens(prefix: Column, most_columns: int) -> Column:
    """What may follow the beginning of a table written cell by cell (array of tokens, `|` and `<NEWLINE>` among them): array of `|`, `<NEWLINE>` and `word`.

    A row begins and ends with `|`; the first row sets how many cells all have, at most `most_columns`. Null for a beginning that breaks this.
    """
    start = F.struct(F.lit(0).alias("bars"), F.lit(0).alias("width"), F.lit(0).alias("row"), F.lit(True).alias("ok"))

    def step(acc: Column, t: Column) -> Column:
        bars, width, row = acc["bars"], acc["width"], acc["row"]
        most = F.when(row == 0, F.lit(most_columns + 1)).otherwise(width)
        end = F.when(row == 0, bars >= 2).otherwise(bars == width)
        ok = acc["ok"] & F.when(t == "|", bars < most).when(t == BREAK, end).otherwise((bars > 0) & ~F.when(row == 0, bars > most_columns).otherwise(bars == width))
        return F.struct(F.when(t == BREAK, 0).when(t == "|", bars + 1).otherwise(bars).alias("bars"), F.when((t == BREAK) & (row == 0), bars).otherwise(width).alias("width"), F.when(t == BREAK, row + 1).otherwise(row).alias("row"), F.coalesce(ok, F.lit(False)).alias("ok"))

    def after(acc: Column) -> Column:
        most = F.when(acc["row"] == 0, F.lit(most_columns + 1)).otherwise(acc["width"])
        end = F.when(acc["row"] == 0, acc["bars"] >= 2).otherwise(acc["bars"] == acc["width"])
        may = [F.when(acc["bars"] < most, "|"), F.when(end, BREAK), F.when((acc["bars"] > 0) & (acc["bars"] < most), "word")]
        return F.when(acc["ok"], F.array_compact(F.array(*may)))

    return F.aggregate(prefix, start, step, after)


def fit_budget(messages: Column, budget: int) -> Column:
    """The last messages (array of strings) whose words together don't exceed the budget."""
    words = lambda m: F.size(F.filter(F.split(m, r"\s+"), lambda w: w != ""))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, m: Column) -> Column:
        full = acc["full"] | (acc["n"] + words(m) > budget)
        return F.struct((acc["n"] + words(m)).alias("n"), full.alias("full"), F.when(full, acc["kept"]).otherwise(F.array_prepend(acc["kept"], m)).alias("kept"))

    return F.aggregate(F.reverse(messages), start, step, lambda acc: acc["kept"])
