"""The operator algebra over tables and latent tables, lowered to one lazy DataFrame.

Only the attributes a plan needs are extracted; tables are joined with documents and documents
are limited before extraction, so its cost follows what is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.cells import CELL, cell_has, cell_of, cell_text, merge_cells
from loomtext.operators.ranking import global_rank
from loomtext.operators.spans import token_windows
from loomtext.plans.catalog import Catalog, Table, TextView
from loomtext.workspace import Workspace


#: Column of the documents of an indexed selection: the spellings in them that it looks for.
ASKED = "__asked"


def _short(columns: Sequence[str]) -> str:
    return ", ".join(columns) if len(columns) <= 4 else ", ".join(c[:2] for c in columns[:4]) + "…"


@dataclass(frozen=True)
class Lowered:
    df: DataFrame
    keys: tuple[str, ...]

    def cells(self) -> list[str]:
        return [c for c, t in self.df.dtypes if t == CELL]


class Node:
    """A plan; children are plans or names in the catalog."""

    def name(self) -> str:
        raise NotImplementedError

    def latex(self) -> str:
        table = {"⨝": r"\bowtie", "∪": r"\cup", "σ": r"\sigma", "π": r"\pi", "_": r"\_", "…": r"\dots"}
        return "$" + "".join(table.get(c, c) for c in self.name()) + "$"

    def lower(self, catalog: Catalog) -> Lowered:
        raise NotImplementedError

    def run(self, catalog: Catalog) -> DataFrame:
        return self.lower(catalog).df


Operand = Node | str


def _label(x: Operand) -> str:
    return x if isinstance(x, str) else x.name()


def _lower(x: Operand, catalog: Catalog) -> Lowered:
    if isinstance(x, Node):
        return x.lower(catalog)
    got = catalog.get(x)
    if not isinstance(got, Table):
        raise TypeError(f"{x} is no table")
    return Lowered(got.df, got.keys)


def _view(x: Operand, catalog: Catalog) -> TextView:
    got = x.view(catalog) if isinstance(x, TextSelect) else catalog.get(x) if isinstance(x, str) else None
    if not isinstance(got, TextView):
        raise TypeError(f"{_label(x)} is no latent table")
    return got


@dataclass(frozen=True)
class Project(Node):
    """Keys and the listed columns, in that order; repeated rows stay. An unknown column is an error."""

    child: Operand
    columns: tuple[str, ...]

    def name(self) -> str:
        return f"π {_short(self.columns)} ({_label(self.child)})"

    def lower(self, catalog: Catalog) -> Lowered:
        low = _lower(self.child, catalog)
        return Lowered(low.df.select(*low.keys, *[c for c in self.columns if c not in low.keys]), low.keys)


@dataclass(frozen=True)
class Select(Node):
    """The rows of the first max(int(n * share), 1) keys in order, nulls last.

    A key that occurs several times among those takes all its rows each time, as a lookup does.
    """

    child: Operand
    share: float

    def name(self) -> str:
        return f"σ {self.share:g} ({_label(self.child)})"

    def lower(self, catalog: Catalog) -> Lowered:
        low = _lower(self.child, catalog)
        n = max(int(low.df.count() * self.share), 1)
        ranked = global_rank(low.df.select(*low.keys), [F.col(k).asc_nulls_last() for k in low.keys], "__rank")
        first = ranked.where(F.col("__rank") <= n).select(*[F.col(k).alias(f"__{k}") for k in low.keys])
        same = [F.col(f"__{k}").eqNullSafe(low.df[k]) for k in low.keys]
        return Lowered(low.df.join(first, same).select(*low.df.columns), low.keys)


@dataclass(frozen=True)
class Join(Node):
    """Inner join on one key; the other keys stay keys. Columns are the right's and then the left's; clashing names get _x and _y."""

    left: Operand
    right: Operand
    key: str

    def name(self) -> str:
        return f"({_label(self.left)} ⨝ {_label(self.right)})"

    def lower(self, catalog: Catalog) -> Lowered:
        a, b = _lower(self.left, catalog), _lower(self.right, catalog)
        both = (set(a.df.columns) & set(b.df.columns)) - {self.key}
        left = a.df.select(*[F.col(c).alias(f"{c}_y" if c in both else c) for c in a.df.columns])
        right = b.df.select(*[F.col(c).alias(f"{c}_x" if c in both else c) for c in b.df.columns])
        keys = [self.key, *[f"{k}_x" if k in both else k for k in b.keys if k != self.key], *[f"{k}_y" if k in both else k for k in a.keys if k != self.key]]
        return Lowered(right.join(left, self.key).select(self.key, *[c for c in right.columns if c != self.key], *[c for c in left.columns if c != self.key]), tuple(dict.fromkeys(keys)))


def _forced(cell: Column) -> Column:
    """A cell whose values are one, listed by commas."""
    return F.when(F.size(cell) > 1, cell_of(F.array(cell_text(cell)))).otherwise(cell)


def _rows(view: TextView, docs: DataFrame, kept: Sequence[str], inner: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(kept..., names...) of whole texts."""
    source = view.collection
    ready, text = view.extractor.prepare(docs, source.key), F.col(source.text)
    if not view.multi_row:
        return ready.select(*kept, *[view.extractor.cell(text, a).alias(a) for a in names])
    rows = ready.select(*kept, F.explode(view.extractor.rows(text, inner, view.identifying)).alias("__r"))
    return rows.select(*kept, *[F.col(f"__r.`{a}`").alias(a) for a in names])


def _window_rows(view: TextView, docs: DataFrame, kept: Sequence[str], inner: Sequence[str], names: Sequence[str]) -> DataFrame:
    """As _rows, from windows of the texts: each is extracted on its own, and a document's are put together in their order.

    In a multi-row view a first pass collects the identifying values of all windows of a document,
    and a second one reads every window for each of them, so that what stands apart from a row's name is found as well.
    """
    source = view.collection
    words = F.split(F.coalesce(source.text, F.lit("")), r"\s+")
    each = docs.select(*kept, F.explode(token_windows(words, *view.window)).alias("__w")).select(*kept, F.array_join("__w.tokens", " ").alias(source.text), F.col("__w.number").alias("__n"))
    parts = _rows(view, each, [*kept, "__n"], inner, names)
    one = lambda a: merge_cells(F.transform(F.array_sort(F.collect_list(F.struct("__n", a))), lambda x: x[a])).alias(a)
    by = [source.key, *([view.identifying] if view.multi_row else [])]
    # further columns depend on the document alone
    rest = [F.first(c).alias(c) for c in kept if c != source.key]
    whole = parts.groupBy(*by).agg(*rest, *[one(a) for a in inner]) if rest or inner else parts.select(*by).distinct()
    return whole.select(*kept, *names)


def extract(view: TextView, attributes: Sequence[str], docs: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The document key and the attributes' cells; docs may hold further columns, which are kept.

    limit: the first documents by key. Pending predicates of the view are applied and their
    attributes dropped again unless asked for. In a multi-row view, the identifying attribute is
    a string.
    """
    source = view.collection
    docs = source.df if docs is None else docs
    if view.only is not None:
        # one row per document, with the spellings that its predicate looks for where the index gives them
        docs = docs.join(view.only, source.key)
    if limit is not None:
        docs = docs.orderBy(F.col(source.key).asc_nulls_last()).limit(limit)
    wanted = [a for a in dict.fromkeys(attributes) if a != source.key]
    helpers = [a for a, _ in view.pending if a not in wanted]
    every = wanted + list(dict.fromkeys(helpers))
    unknown = [a for a in every if a not in view.attributes]
    if unknown:
        raise ValueError(f"{view.full_name} has no attribute {unknown}")
    kept = [c for c in docs.columns if c != source.text]
    if view.multi_row:
        inner = [a for a in every if a != view.identifying]
        wanted = [view.identifying, *[a for a in wanted if a != view.identifying]]
        names = [view.identifying, *inner]
    else:
        inner = names = every
    found = _rows(view, docs, kept, inner, names) if view.window is None else _window_rows(view, docs, kept, inner, names)
    found = found.select(*kept, *[_forced(F.col(a)).alias(a) if a in view.single and a != view.identifying else F.col(a) for a in names])
    for attribute, test in view.pending:
        value = F.col(attribute)
        found = found.where(test(cell_of(F.array(value)) if attribute == view.identifying else value))
    return found.select(*[c for c in kept if c != ASKED], *wanted)


@dataclass(frozen=True)
class TextScan(Node):
    """The rows of a latent table: one per document, or any number for a view with an identifying attribute."""

    view: Operand
    columns: tuple[str, ...] | None = None
    limit: int | None = None

    def name(self) -> str:
        return f"scan({_label(self.view)})" if self.columns is None else f"π {_short(self.columns)} (scan({_label(self.view)}))"

    def lower(self, catalog: Catalog) -> Lowered:
        view = _view(self.view, catalog)
        found = extract(view, self.columns or view.attributes, limit=self.limit)
        if self.columns:
            found = found.select(view.collection.key, *[c for c in self.columns if c != view.collection.key])
        return Lowered(found, (view.collection.key,))


@dataclass(frozen=True)
class TextJoin(Node):
    """A table joined with what its documents say: only attributes that the table lacks are extracted.

    Where the identifying attribute is a column of the table, a row meets the extraction of its
    own value; a row without one gets empty cells.
    """

    table: Operand
    view: Operand
    key: str
    columns: tuple[str, ...] | None = None
    limit: int | None = None

    def name(self) -> str:
        return f"({_label(self.table)} ⨝ {_label(self.view)})"

    def lower(self, catalog: Catalog) -> Lowered:
        low, view = _lower(self.table, catalog), _view(self.view, catalog)
        docs = view.collection.df.withColumnRenamed(view.collection.key, self.key) if view.collection.key != self.key else view.collection.df
        have = low.df.columns
        attributes = [a for a in view.attributes if a not in have and (self.columns is None or a in self.columns)]
        conditioned = view.multi_row and view.identifying in have
        # the documents that the table names are chosen before any extraction
        asked = docs.join(low.df.select(self.key).distinct(), self.key, "left_semi").withColumnRenamed(self.key, view.collection.key)
        found = extract(view, attributes, asked, self.limit).withColumnRenamed(view.collection.key, self.key)
        if conditioned:
            if self.limit is not None:
                first = asked.select(view.collection.key).orderBy(F.col(view.collection.key)).limit(self.limit).withColumnRenamed(view.collection.key, self.key)
                out = low.df.join(first, self.key, "left_semi")
            else:
                out = low.df.join(docs.select(self.key), self.key, "left_semi")
            out = out.join(found, [self.key, view.identifying], "left")
            for a in attributes:
                out = out.withColumn(a, F.coalesce(F.col(a), F.array().cast(CELL)))
        else:
            out = low.df.join(found, self.key)
        keys = tuple(dict.fromkeys([*low.keys, self.key]))
        if self.columns is not None:
            out = out.select(*dict.fromkeys([*[k for k in keys if k in out.columns], *self.columns]))
        return Lowered(out, tuple(k for k in keys if k in out.columns))


@dataclass(frozen=True)
class TextUnion(Node):
    """A table's rows and those of a latent table, all kept; attributes common to both are extracted, missing ones are null.

    The table's columns that are attributes become cells. extracted_only leaves the table's rows out.
    """

    table: Operand
    view: Operand
    extracted_only: bool = False
    limit: int | None = None

    def name(self) -> str:
        return f"({_label(self.table)} ∪ {_label(self.view)})"

    def lower(self, catalog: Catalog) -> Lowered:
        low, view = _lower(self.table, catalog), _view(self.view, catalog)
        shared = [c for c in low.df.columns if c in view.attributes and c != view.collection.key]
        found = extract(view, shared, limit=self.limit)
        if self.extracted_only:
            return Lowered(found, (view.collection.key,))
        as_cell = lambda c: F.when(F.col(c).isNull(), F.array().cast(CELL)).otherwise(cell_of(F.array(F.col(c).cast("string")))).alias(c)
        kinds = dict(low.df.dtypes)
        plain = {view.identifying, view.collection.key}
        rows = low.df.select(*[as_cell(c) if c in shared and c not in plain and kinds[c] != CELL else F.col(c) for c in low.df.columns])
        return Lowered(rows.unionByName(found, allowMissingColumns=True), low.keys)


def value_index(view: TextView, attribute: str, representative: DataFrame | None = None) -> DataFrame:
    """(normed, spelling, doc): which documents hold a value, once per document, value and spelling.

    representative (value, rep): values known to mean the same go by that name, each with its own spellings.
    """
    key = view.collection.key
    cell = F.col(attribute) if attribute != view.identifying else cell_of(F.array(F.col(attribute)))
    each = extract(view, [attribute]).select(F.col(key).alias("doc"), F.explode(cell).alias("v"))
    flat = each.select("v.normed", F.explode("v.alts").alias("spelling"), "doc")
    if representative is not None:
        flat = flat.join(representative.select(F.col("value").alias("normed"), "rep"), "normed", "left").select(F.coalesce("rep", "normed").alias("normed"), "spelling", "doc")
    return flat.distinct()


def closest_value(index: DataFrame, documents: int, share: float) -> str | None:
    """The value whose frequency over the number of documents is closest to share; ties by value; null without values."""
    counts = index.groupBy("normed").agg(F.countDistinct("doc").alias("n"))
    best = counts.orderBy(F.abs(F.col("n") / F.lit(max(documents, 1)) - share), "normed").limit(1).collect()
    return best[0]["normed"] if best else None


@dataclass(frozen=True)
class TextSelect(Node):
    """A latent table narrowed to the rows whose attribute has the constant that comes closest to `share` of the documents (or `constant`).

    With `indexed`, documents that can't hold it are ruled out before extraction, and any spelling that an
    equal value has counts, without a bound on their number. Used as operand of TextScan, TextJoin and TextUnion.
    """

    source: str
    attribute: str
    share: float = 0.0
    constant: str | None = None
    indexed: bool = False
    #: (value, rep): values that mean the same, as cluster_values gives them; used by an indexed selection
    synonyms: DataFrame | None = None

    def name(self) -> str:
        return f"σ {self.attribute} ({self.source})"

    def view(self, catalog: Catalog) -> TextView:
        view = _view(self.source, catalog)
        if self.constant is not None and not self.indexed:
            return view.narrowed(self.attribute, lambda cell: cell_has(cell, F.array(F.lit(self.constant))), None)
        # the texts are read once for the index, however often it is asked
        index = Workspace(catalog.spark, "index").keep(value_index(view, self.attribute, self.synonyms), "index")
        constant = self.constant if self.constant is not None else closest_value(index, view.collection.df.count(), self.share)
        if constant is None:
            return view.narrowed(self.attribute, lambda cell: F.lit(False), None)
        if not self.indexed:
            return view.narrowed(self.attribute, lambda cell: cell_has(cell, F.array(F.lit(constant))), None)
        low = F.lower("spelling").alias("low")
        spellings = index.where(F.lower("normed") == constant.lower()).select(low).distinct()
        # each document with those of the value's spellings that it holds itself, however many the value has
        held = index.select("doc", low).join(spellings, "low", "left_semi")
        only = held.groupBy(F.col("doc").alias(view.collection.key)).agg(F.collect_set("low").alias(ASKED))
        return view.narrowed(self.attribute, lambda cell: cell_has(cell, F.col(ASKED)), only)

    def lower(self, catalog: Catalog) -> Lowered:
        return TextScan(self).lower(catalog)


@dataclass(frozen=True)
class TextAggregate(Node):
    """Groups rows by the values of an attribute; the cells of a group are merged, keys and other columns gathered in sorted lists.

    Each row goes to one group: of several values, the last in order of its representative.
    `representative` maps (value) to (value, rep); without it, a value stands for itself. Rows
    without a value, and groups whose representative is empty or starts with `#` or `.`, drop out.
    """

    child: Operand
    attribute: str
    representative: DataFrame | None = None

    def name(self) -> str:
        return f"G {self.attribute} ({_label(self.child)})"

    def lower(self, catalog: Catalog) -> Lowered:
        low = _lower(self.child, catalog)
        is_cell = self.attribute in low.cells()
        value = F.transform(self.attribute, lambda v: v["normed"]) if is_cell else F.array(F.col(self.attribute))
        rows = low.df
        if self.representative is None:
            # max over the row itself: no shuffle
            rows = rows.withColumn("__rep", F.array_max(F.array_compact(value)))
        else:
            # equal rows stay apart by a number of their own
            rows = rows.withColumn("__row", F.struct(F.monotonically_increasing_id().alias("__n"), *low.df.columns))
            pairs = rows.select("__row", F.explode(F.array_compact(value)).alias("value")).join(self.representative.select("value", "rep"), "value")
            rows = pairs.groupBy("__row").agg(F.max("rep").alias("__rep")).select("__row.*", "__rep").drop("__n")
        rows = rows.where(F.col("__rep").isNotNull() & (F.col("__rep") != "") & ~F.col("__rep").rlike(r"^[#.]"))
        gather: list[Column] = []
        for c, kind in low.df.dtypes:
            if c == self.attribute:
                continue
            if kind == CELL:
                ordered = F.array_sort(F.collect_list(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(low.keys)], F.col(c).alias("cell"))))
                gather.append(merge_cells(F.transform(ordered, lambda x: x["cell"])).alias(c))
            else:
                gather.append(F.array_sort(F.collect_list(c)).alias(c))
        return Lowered(rows.groupBy(F.col("__rep").alias(self.attribute)).agg(*gather), (self.attribute,))
