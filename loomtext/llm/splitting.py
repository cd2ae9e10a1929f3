"""Splitting oversized texts at natural boundaries by structure-tree packing.

A text is parsed into a tree: sections under headings of six levels, markup elements, list items by
their indentation, and in these the blocks (paragraphs, tables, fenced code). A node without nodes
below it is read further as lines, sentences and words. Whole sibling subtrees are merged from
the left up to the limit; only a node above the limit is opened, and what comes of it is never
joined to its siblings. Below the words there are no natural boundaries; such a stretch
is cut by characters, not between a character and its combining marks where that can be avoided.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White_Space of Unicode, the marks after which a text may be cut, and markup elements that are blocks.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STOPS = "。！？"
ELEMENTS = "article|aside|blockquote|div|dl|figure|footer|header|li|main|nav|ol|p|pre|section|table|tbody|thead|tr|ul"

_LINE = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
#: places where a line of the tree may begin: after a line end, and at a block's tag after white space
_STARTS = re.compile(rf"{_LINE}|(?<=[{WS}])(?=</?(?:{ELEMENTS}|h[1-6])[\s>])", re.I)
_HEAD = re.compile(rf"[ \t]{{0,3}}(?:(#{{1,6}}|={{1,6}})[{WS}]|<h([1-6])[\s>])", re.I)
_FENCE = re.compile(r"[ \t]*(```+|~~~+)")
_TAG = re.compile(rf"[ \t]*<(/?)({ELEMENTS})[\s>]", re.I)
_ITEM = re.compile(r"([ \t]*)(?:[-*+•‣–]|[0-9]{1,4}[.)]|\(?[a-z][.)])[ \t\xa0]+")
_ROW = re.compile(r"[ \t]*\|")
_INDENT = re.compile(r"[ \t]*")
_INK = re.compile(rf"[^{WS}]")
_LEVELS = [
    re.compile(_LINE),
    re.compile(rf"[.!?…;:][\"'»”’)\]]*[{WS}]+|[{STOPS}]"),
    re.compile(rf"[{WS}]|[^{WS}{STOPS}]+[{STOPS}]?|[{STOPS}]"),
]
_NATURAL = re.compile(rf"[{WS}{STOPS}]")


def _joins_on(text: str, at: int) -> bool:
    return bool(unicodedata.combining(text[at])) or text[at] in "\u200d\ufe0e\ufe0f" or text[at - 1] == "\u200d"


class Node:
    """A part of the text from start to where its next sibling or its parent ends; kids tile it, or there are none."""

    __slots__ = ("kind", "rank", "start", "kids")

    def __init__(self, kind: str, rank: object, start: int):
        self.kind, self.rank, self.start, self.kids = kind, rank, start, []


def structure(text: str) -> Node:
    """The tree of a text. A heading belongs to what first follows it; blank lines to what they follow."""
    root = Node("root", 0, 0)
    path, block, gap, fence = [root], None, False, ""

    def add(kind: str, rank: object, at: int) -> Node:
        node = Node(kind, rank, at if path[-1].kids else path[-1].start)
        path[-1].kids.append(node)
        return node

    def leave_items(indent: int) -> None:
        while path[-1].kind == "item" and path[-1].rank >= indent:
            path.pop()

    at, n = 0, len(text)
    while at < n:
        m = _STARTS.search(text, at + 1 if text[at] == "<" else at)
        here, at = at, n if m is None else max(m.end(), at + 1)
        if fence:
            m = _FENCE.match(text, here, at)
            fence = "" if m and m.group(1).startswith(fence) else fence
            continue
        if not _INK.search(text, here, at):
            gap = True
            continue
        head = _HEAD.match(text, here, at)
        if head:
            level = len(head.group(1)) if head.group(1) else int(head.group(2))
            while path[-1].kind != "root" and not (path[-1].kind == "section" and path[-1].rank < level):
                path.pop()
            path.append(add("section", level, here))
            block, gap = None, False
            continue
        tag = _TAG.match(text, here, at)
        if tag:
            name, block = tag.group(2).lower(), None
            if tag.group(1):
                own = len(path) - 1
                while own and path[own].kind != "section" and path[own].rank != name:
                    own -= 1
                if path[own].rank == name:
                    # what closes a node still belongs to it
                    del path[own:]
                elif not path[-1].kids:
                    add("block", None, here)
            else:
                node = add("element", name, here)
                if not re.search(rf"</{name}\s*>", text[tag.end() : at], re.I):
                    path.append(node)
            gap = False
            continue
        item = _ITEM.match(text, here, at)
        if item:
            indent = len(item.group(1).expandtabs(4))
            leave_items(indent)
            path.append(add("item", indent, here))
            add("block", None, here)
            block, gap = "text", False
            continue
        if gap:
            leave_items(len(_INDENT.match(text, here, at).group().expandtabs(4)))
        mark = _FENCE.match(text, here, at)
        kind = "fence" if mark else "table" if _ROW.match(text, here, at) else "text"
        if gap or kind != block or kind == "fence":
            add("block", None, here)
        block, gap, fence = kind, False, mark.group(1) if mark else ""
    return root


def split(text: str, max_len: int, overlap: int) -> tuple[list[tuple[int, int, bool]], int]:
    """(start, end, forced) of pieces of at most max_len code points that cover the text, and the longest stretch without natural boundary that had to be cut or else 0.

    A piece begins `overlap` code points before the end of the one before it, or at the natural
    boundary before that place if one is near, but not before the start of the text. forced: the piece
    ends in a stretch without natural boundary. An empty text has no pieces;
    an overlap that leaves no room for new text is lowered to max_len - 1, and max_len is at least 1.
    """
    n, max_len = len(text), max(1, max_len)
    overlap = max(0, min(overlap, max_len - 1))
    near = (max_len - overlap) // 4
    if n <= max_len:
        return [(0, n, False)] if n else [], 0
    leads = {0: 0}

    def lead(s: int) -> int:
        """Where the piece begins whose own part begins at s."""
        if s in leads:
            return leads[s]
        raw = max(0, s - overlap)
        best, least = raw, max(0, raw - near)
        if overlap and raw:
            at = raw
            while at > least and not _NATURAL.match(text[at - 1]):
                at -= 1
            if at > least or at == 0:
                best = at
            else:
                while best > max(least, raw - 16) and _joins_on(text, best):
                    best -= 1
                best = raw if _joins_on(text, best) else best
        leads[s] = best
        return best

    def fits(s: int, e: int) -> bool:
        return e - lead(s) <= max_len

    def parts(s: int, e: int, node: Node | None, level: int) -> Iterator[tuple[int, int, Node | None, int]]:
        """The parts of an oversized node."""
        if node is not None and node.kids:
            ends = [k.start for k in node.kids[1:]] + [e]
            yield from ((k.start, end, k, 0) for k, end in zip(node.kids, ends))
            return
        first = s
        while level == 0 and (m := _HEAD.match(text, first, e)):
            # the headings at the start stand with the line after them
            m = _LEVELS[0].search(text, m.end(), e)
            first = m and _INK.search(text, m.end(), e)
            first = e if first is None else first.start()
        for m in _LEVELS[level].finditer(text, first, e):
            yield s, m.end(), None, level + 1
            s = m.end()
        if s < e:
            yield s, e, None, level + 1

    out: list[tuple[int, int, bool]] = []
    longest, group = 0, None
    todo = [iter([(0, n, structure(text), 0)])]
    while todo:
        for s, e, node, level in todo[-1]:
            if group is not None:
                if fits(group[0], e):
                    group = (group[0], e, False)
                    continue
                out.append(group)
                group = None
            if fits(s, e):
                group = (s, e, False)
            elif level < len(_LEVELS):
                todo.append(parts(s, e, node, level))
                break
            else:
                longest = max(longest, e - s)
                while not fits(s, e):
                    cut = back = lead(s) + max_len
                    while back > s + 1 and cut - back < 16 and _joins_on(text, back):
                        back -= 1
                    cut = back if not _joins_on(text, back) else cut
                    out.append((s, cut, True))
                    s = cut
                group = (s, e, False)
        else:
            todo.pop()
            if group is not None:
                out.append(group)
                group = None
    return [(lead(s), e, forced) for s, e, forced in out], longest


_PIECE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("forced", T.BooleanType())])
_SPLIT = T.StructType([T.StructField("opened", T.IntegerType()), T.StructField("pieces", T.ArrayType(_PIECE))])


@F.arrow_udf(_SPLIT)
def _split(text: pa.Array, max_len: pa.Array, overlap: pa.Array) -> pa.Array:
    kind = pa.struct([("opened", pa.int32()), ("pieces", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("forced", pa.bool_())])))])
    out = []
    for t, m, o in zip(text.to_pylist(), max_len.to_pylist(), overlap.to_pylist()):
        if t is None:
            out.append(None)
            continue
        pieces, opened = split(t, len(t) if m is None else m, o or 0)
        out.append({"opened": opened, "pieces": [dict(zip(("start", "end", "forced"), p)) for p in pieces]})
    return pa.array(out, kind)


def split_texts(df: DataFrame, text: Column, max_len: Column, overlap: Column, keep: dict[str, Column]) -> DataFrame:
    """(keep..., text, max_len, overlap, opened, pieces): each row with its pieces, and the longest stretch without natural boundary that the tree had to cut, or 0.

    A null text has null opened and pieces; a null max_len means no limit: one piece.
    """
    put = df.select(*[c.alias(n) for n, c in keep.items()], text.alias("__t"), max_len.cast("int").alias("max_len"), overlap.cast("int").alias("overlap"))
    return put.withColumn("__s", _split("__t", "max_len", "overlap")).select(*keep, F.col("__t").alias("text"), "max_len", "overlap", "__s.opened", "__s.pieces")
