"""Deeply nested records into related flat tables by Merkle subtree identities.

Every object of a JSON payload gets a hash of its canonical form, built bottom-up from the
hashes of the objects it holds, so equal subtrees have equal hashes wherever they occur. The
parser calls for each object once those inside it are done, so nothing recurses. An
object's content is stored once. Its links to the objects inside it depend on that content alone, so they
are bridge rows of the object, with field, ordinal and place; the payloads in which an object stands at
the top or under other objects follow from the rows of the occurrences, which name their parent.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from json.encoder import encode_basestring

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.workspace import Workspace

_LINK = T.StructType([T.StructField("field", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("place", T.StringType()), T.StructField("hash", T.BinaryType()), T.StructField("value", T.StringType())])
_ROW = T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("hash", T.BinaryType()), T.StructField("root", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("content", T.LongType()),
    T.StructField("scalars", T.MapType(T.StringType(), T.StringType())), T.StructField("children", T.ArrayType(_LINK)),
])
#: Rows that are handed over at once, and the hashes a task remembers before it starts anew.
ROWS, SEEN = 50_000, 1_000_000
#: Numbers of up to so many digits are written out.
WRITTEN_OUT = 40
_PARTS = re.compile(r"(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([-+]?[0-9]+))?")
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


class _Num(str):
    """A number by its canonical digits; equal numbers are written equally, whatever their size."""


class _Ref(int):
    """The number of an object that is done."""


def _number(raw: str) -> _Num:
    if len(raw) < WRITTEN_OUT and raw.isdigit():
        return _Num(raw)
    sign, whole, frac, exp = _PARTS.fullmatch(raw).groups()
    digits = (whole + (frac or "")).lstrip("0")
    kept = digits.rstrip("0")
    if not kept:
        return _Num("0")
    try:
        e = int(exp or 0) - len(frac or "") + len(digits) - len(kept)
    except ValueError:
        # an exponent of thousands of digits
        return _Num(raw)
    if e >= 0 and (e == 0 or len(kept) + e <= WRITTEN_OUT):
        out = kept + "0" * e
    elif -WRITTEN_OUT <= e < 0:
        point = len(kept) + e
        out = f"{kept[:point]}.{kept[point:]}" if point > 0 else "0." + "0" * -point + kept
    else:
        out = f"{kept}E{e}"
    return _Num(sign + out)


def _refuse(name: str) -> None:
    raise ValueError(name)


def _unpaired(s: str) -> str:
    """Half surrogates can't be stored in UTF-8; they become U+FFFD."""
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not s.isascii() and any("\ud800" <= c <= "\udfff" for c in s) else s


def _text(v: object) -> str:
    """JSON of a value without objects."""
    out: list[str] = []
    stack: list = [iter((v,))]
    first = [True]
    while stack:
        for x in stack[-1]:
            if not first[-1]:
                out.append(",")
            first[-1] = False
            if type(x) is list:
                out.append("[")
                stack.append(iter(x))
                first.append(True)
                break
            out.append(x if type(x) is _Num else encode_basestring(_unpaired(x)) if type(x) is str else "null" if x is None else "true" if x else "false")
        else:
            stack.pop()
            first.pop()
            if stack:
                out.append("]")
    return "".join(out)


def _holders(x: list) -> set[int]:
    """Identities of the lists in x, and of x itself, that hold an object at any depth."""
    lists = [x]
    for v in lists:
        lists.extend(u for u in v if type(u) is list)
    out: set[int] = set()
    for v in reversed(lists):
        if any(type(u) is _Ref or (type(u) is list and id(u) in out) for u in v):
            out.add(id(v))
    return out


def _elements(x: list, holders: set[int]) -> list[tuple[str, object]]:
    """(place, element) of a list that holds objects; lists within that hold some are entered, others are elements."""
    out: list[tuple[str, object]] = []
    stack = [iter(enumerate(x))]
    way: list[str] = []
    while stack:
        for i, v in stack[-1]:
            if type(v) is list and id(v) in holders:
                way.append(f"{i}/")
                stack.append(iter(enumerate(v)))
                break
            out.append((f"{''.join(way)}{i}", v))
        else:
            stack.pop()
            if way:
                way.pop()
    return out


class Shredder:
    """Objects of payloads, those inside others first."""

    def __init__(self) -> None:
        #: [hash, root, parent, scalars, children] of the payload at hand
        self.nodes: list[list] = []
        self.parse = json.JSONDecoder(object_pairs_hook=self.done, parse_int=_number, parse_float=_number, parse_constant=_refuse).decode

    def done(self, pairs: list[tuple[str, object]]) -> _Ref:
        """Adds the object of these fields."""
        nodes, fields = self.nodes, dict(pairs)
        if len(fields) < len(pairs):
            seen: dict[str, int] = {}
            left = len(pairs)
            for name, v in pairs:
                left -= 1
                if any(name == later for later, _ in pairs[len(pairs) - left :]):
                    n = seen.get(name, 0) + 1
                    while f"{name}#{n}" in fields:
                        n += 1
                    seen[name], fields[f"{name}#{n}"] = n, v
        scalars, children, canon = [], [], []
        me = len(nodes)
        for field in sorted(fields):
            v = fields[field]
            kind, name = type(v), _unpaired(field)
            canon.append(f"{len(name)}:{name}")
            if kind is _Ref:
                children.append((name, 0, "", nodes[v][0], None))
                nodes[v][2] = me
                canon.append(f"o{nodes[v][0].hex()}")
                continue
            holders = _holders(v) if kind is list else ()
            if holders:
                canon.append("l")
                for i, (place, x) in enumerate(_elements(v, holders)):
                    if type(x) is _Ref:
                        children.append((name, i, place, nodes[x][0], None))
                        nodes[x][2] = me
                        canon.append(f"{place}o{nodes[x][0].hex()}")
                    else:
                        children.append((name, i, place, None, _text(x)))
                        canon.append(f"{place}s{len(children[-1][4])}:{children[-1][4]}")
                canon.append(";")
                continue
            s = '"' + _unpaired(v) if kind is str else v if kind is _Num else _text(v)
            scalars.append((name, s))
            canon.append(f"s{len(s)}:{s}")
        nodes.append([hashlib.blake2b("".join(canon).encode("utf-8", "surrogatepass"), digest_size=16).digest(), None, None, scalars, children])
        return _Ref(me)

    def _deep(self, s: str) -> object:
        """As the parser of the library, whose depth is limited."""
        at, n, stack, value = _SPACE.match(s).end(), len(s), [], None
        while True:
            # a value begins here
            c = s[at : at + 1]
            if c in ("{", "["):
                stack.append((c, []))
                at = _SPACE.match(s, at + 1).end()
                if s[at : at + 1] != ("}" if c == "{" else "]"):
                    if c == "{":
                        at = self._field(s, at, stack[-1][1])
                    continue
            else:
                if c == '"':
                    value, at = scanstring(s, at + 1, True)
                elif m := _NUMBER.match(s, at):
                    value, at = _number(m.group()), m.end()
                else:
                    word = next((w for w in _WORDS if s.startswith(w, at)), None)
                    if word is None:
                        raise ValueError(at)
                    value, at = _WORDS[word], at + len(word)
                if not stack:
                    break
                self._put(stack[-1], value)
                at = _SPACE.match(s, at).end()
            while stack:
                c, held = stack[-1]
                if s[at : at + 1] == ("}" if c == "{" else "]"):
                    stack.pop()
                    value = self.done([tuple(p) for p in held]) if c == "{" else held
                    at = _SPACE.match(s, at + 1).end()
                    if stack:
                        self._put(stack[-1], value)
                    continue
                if s[at : at + 1] != ",":
                    raise ValueError(at)
                at = _SPACE.match(s, at + 1).end()
                if c == "{":
                    at = self._field(s, at, held)
                break
            if not stack:
                break
        if _SPACE.match(s, at).end() != n:
            raise ValueError(at)
        return value

    @staticmethod
    def _field(s: str, at: int, held: list) -> int:
        if s[at : at + 1] != '"':
            raise ValueError(at)
        name, at = scanstring(s, at + 1, True)
        at = _SPACE.match(s, at).end()
        if s[at : at + 1] != ":":
            raise ValueError(at)
        held.append([name, None])
        return _SPACE.match(s, at + 1).end()

    @staticmethod
    def _put(frame: tuple[str, list], value: object) -> None:
        if frame[0] == "{":
            frame[1][-1][1] = value
        else:
            frame[1].append(value)

    def shred(self, payload: str | None) -> list[list] | None:
        """[hash, root, parent, scalars, children] of a payload's objects; null where it is no valid JSON."""
        self.nodes.clear()
        if payload is None or not payload.strip():
            return []
        try:
            try:
                top = self.parse(payload)
            except RecursionError:
                self.nodes.clear()
                top = self._deep(payload)
        except ValueError:
            return None
        if type(top) is _Ref:
            self.nodes[top][1] = 0
        elif type(top) is list:
            for i, (_, x) in enumerate(_elements(top, _holders(top))):
                if type(x) is _Ref:
                    self.nodes[x][1] = i
        return self.nodes


def shred_payload(payload: str | None) -> list[dict] | None:
    """Objects of a payload as {hash, root, parent, scalars, children}, children before parents; null where it is no valid JSON.

    A blank or null payload, or one without an object, has none. Fields that hold no object
    are scalars of their object: a string as `"` and the string itself, anything else as JSON. An object in a field, directly or in lists of
    any depth, becomes a child, (field, ordinal, place, hash, value): ordinal counts the elements, place is the way through the lists and empty
    for an object alone; other elements beside objects have no hash but a value. `root` numbers the
    objects at the top, null below; parent is the number of the object around it. Of a repeated field the last counts, and those
    before are kept as `name#1` and on. Depth and size of numbers are not limited; field order and how a number is written don't change a hash.
    """
    nodes = Shredder().shred(payload)
    return None if nodes is None else [dict(zip(("hash", "root", "parent", "scalars", "children"), n)) for n in nodes]


def _batch(kept: pa.RecordBatch, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """Rows (input row, at, hash, root, parent, content, scalars, children) beside the kept columns."""
    columns = [kept.column(n).take(pa.array([r[0] for r in rows], pa.int64())) for n in names]

    def ends(i: int) -> pa.Array:
        return pa.array(np.concatenate(([0], np.cumsum([len(r[i]) for r in rows]))), pa.int32())

    pairs, links = [p for r in rows for p in r[6]], [c for r in rows for c in r[7]]
    scalars = pa.MapArray.from_arrays(ends(6), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()))
    kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
    children = pa.ListArray.from_arrays(ends(7), pa.StructArray.from_arrays([pa.array([c[i] for c in links], k) for i, k in enumerate(kinds)], _LINK.names))
    columns += [pa.array([r[i] for r in rows], k) for i, k in ((1, pa.int32()), (2, pa.binary()), (3, pa.int32()), (4, pa.int32()), (5, pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, scalars, children], [*names, *_ROW.names])


def occurrences(df: DataFrame, payload: str, keep: dict[str, Column]) -> DataFrame:
    """(keep..., at, hash, root, parent, content, scalars, children): one row per object of each payload.

    `at` is its place in post-order, parent that of the object around it. Scalars and children are
    given where `content` is a number, unique among all rows: once in a task for each content, as far as it remembers, and empty elsewhere.
    """
    source = df.select(*[c.alias(n) for n, c in keep.items()], F.col(payload).alias("__payload"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder, seen, number = Shredder(), set(), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            for i, p in enumerate(batch.column("__payload").to_pylist()):
                for at, (digest, root, parent, scalars, children) in enumerate(shredder.shred(p) or ()):
                    new = digest not in seen
                    rows.append((i, at, digest, root, parent, number if new else None, scalars if new else (), children if new else ()))
                    if new:
                        seen.add(digest)
                        number += 1
                if len(rows) >= ROWS:
                    yield _batch(batch, names, rows)
                    rows = []
                if len(seen) > SEEN:
                    seen.clear()
            if rows:
                yield _batch(batch, names, rows)

    return source.mapInArrow(run, T.StructType([*[f for f in source.schema if f.name in keep], *_ROW]))


def objects(occ: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(hash, scalars, children): each distinct object once, out of written occurrences.

    Tasks have told equal objects apart already; only the hashes meet, and of those that several tasks have, the first is kept.
    """
    work = work or Workspace(occ.sparkSession, "objects")
    have = occ.where("content is not null")
    again = work.keep(have.groupBy("hash").agg(F.min("content").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first"), "again")
    return have.join(again, "hash", "left").where("first is null or content = first").select("hash", "scalars", "children")


def bridge(objs: DataFrame) -> DataFrame:
    """(parent, field, ordinal, place, child, value): the links inside each distinct object; child is null and value given for elements beside objects that are none."""
    return objs.select(F.col("hash").alias("parent"), F.explode("children").alias("c")).select("parent", "c.field", "c.ordinal", "c.place", F.col("c.hash").alias("child"), "c.value")


def text_of(value: Column) -> Column:
    """The string of a scalar that is one; null for other scalars and null."""
    return F.when(value.startswith('"'), F.substring(value, F.lit(2), F.length(value)))


def int_of(value: Column) -> Column:
    """An integer given as number or as text, with zeros or spaces around it; null otherwise."""
    return F.nullif(F.regexp_extract(value, r'^"?\s*([+-]?[0-9]+)(?:\.0*)?\s*$', 1), F.lit("")).try_cast("long")
