"""Databases of tables and text collections with latent tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession

from loomtext.operators.extractors import Extractor


@dataclass(frozen=True)
class Table:
    """A DataFrame with key columns, which need not be unique."""

    name: str
    df: DataFrame
    keys: tuple[str, ...]

    def __post_init__(self) -> None:
        missing = [k for k in self.keys if k not in self.df.columns]
        if missing:
            raise ValueError(f"{self.name} has no column {missing}")


@dataclass(frozen=True)
class TextView:
    """A latent table over a collection: attributes that an extractor fills; several rows per document if `identifying` is set."""

    name: str
    collection: TextCollection
    attributes: tuple[str, ...]
    extractor: Extractor
    identifying: str | None = None
    #: predicates on cells that are applied after extraction, by attribute
    pending: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    #: documents that can satisfy the predicates at all, where an index knows them: a row each, with the spellings looked for
    only: DataFrame | None = None
    #: attributes whose values are one value, however many an extractor lists
    single: tuple[str, ...] = ()
    #: words of a window and those that two windows share, where texts are too long for an extractor
    window: tuple[int, int] | None = None

    @property
    def multi_row(self) -> bool:
        return self.identifying is not None

    @property
    def full_name(self) -> str:
        return f"{self.collection.name}.{self.name}"

    def narrowed(self, attribute: str, test: Callable[[Column], Column], only: DataFrame | None) -> TextView:
        return replace(self, pending=(*self.pending, (attribute, test)), only=only)


@dataclass(frozen=True)
class TextCollection:
    """Documents: a DataFrame of exactly a key and a text."""

    name: str
    df: DataFrame
    key: str
    views: dict[str, TextView] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        kinds = dict(self.df.dtypes)
        if len(kinds) != 2 or self.key not in kinds or kinds[self.text] != "string":
            raise ValueError(f"{self.name} must have a key and a text column")

    @property
    def text(self) -> str:
        return next(c for c in self.df.columns if c != self.key)

    def view(self, name: str, attributes: Sequence[str], extractor: Extractor, identifying: str | None = None, single: Sequence[str] = (), window: tuple[int, int] | None = None, one_table: bool = False) -> TextView:
        """Registers a latent table; the key is left out of its attributes.

        single: attributes forced to one value. window: texts are extracted window by window and put together per document.
        one_table: the collection is to look as if this were its only table, so its other views are dropped.
        """
        unknown = [a for a in single if a not in attributes]
        if unknown or (window is not None and not 0 <= window[1] < window[0]):
            raise ValueError(f"{self.name}.{name}: {unknown or window}")
        made = TextView(name, self, tuple(a for a in attributes if a != self.key), extractor, identifying, single=tuple(single), window=window)
        if one_table:
            self.views.clear()
        self.views[name] = made
        return made


def evidence_columns(df: DataFrame, keys: Sequence[str], text: str | None = None) -> list[str]:
    """What of a table tells a model about its rows: keys that aren't numbers, and all other columns but the text."""
    numbers = ("tinyint", "smallint", "int", "bigint")
    kinds = dict(df.dtypes)
    return [k for k in keys if kinds[k] not in numbers] + [c for c in df.columns if c not in keys and c != text]


class Catalog:
    """Named tables and collections; `collection.view` names a latent table. Tables are temporary views too."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.texts: dict[str, TextCollection] = {}

    def table(self, name: str, df: DataFrame, keys: Sequence[str]) -> Table:
        self.tables[name] = Table(name, df, tuple(keys))
        df.createOrReplaceTempView(re.sub(r"\W", "__", name))
        return self.tables[name]

    def collection(self, name: str, df: DataFrame, key: str) -> TextCollection:
        self.texts[name] = TextCollection(name, df, key)
        df.createOrReplaceTempView(re.sub(r"\W", "__", name))
        return self.texts[name]

    def get(self, name: str) -> Table | TextView | TextCollection:
        head, _, tail = name.partition(".")
        if tail and head in self.texts and tail in self.texts[head].views:
            return self.texts[head].views[tail]
        found = self.tables.get(name) or self.texts.get(name)
        if found is None:
            raise KeyError(name)
        return found
