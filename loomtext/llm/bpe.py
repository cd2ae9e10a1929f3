"""Encoding with a public byte-level BPE vocabulary.

A pre-token is merged with a hierarchical-bitmap rank queue: a bucket per merge rank holds the
linked-list positions whose pair has that rank, two levels of bitmaps tell the lowest rank that
has a bucket (find-first-set), and entries that a merge has made stale are skipped when their
bucket is drained. A merge costs the same whatever the length, so very long pre-tokens take
time in proportion. Each worker keeps the pre-tokens it has met, up to a bound.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens kept by a worker, and the longest that is kept.
CACHE_ENTRIES, CACHE_LENGTH = 200_000, 48

# Fixed value: how the vocabularies' text is cut before merging; \s is White_Space of Unicode.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(text: str) -> regex.Pattern:
    return regex.compile(text.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", rf"[{_SPACE}]"))


class Encoder:
    """Ids of texts by the ranks of a vocabulary file in rank format (base64 bytes, rank)."""

    def __init__(self, vocabulary: bytes, pattern: str = PRE_TOKEN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.find = _pattern(pattern).findall
        self.pairs: dict[tuple[int, int], int] = {}
        self.known = _Cache(self)

    def pair_rank(self, a: int, b: int) -> int:
        """Rank of the token that a and b make, -1 if none."""
        r = self.pairs.get((a, b))
        if r is None:
            r = self.ranks.get(self.bytes[a] + self.bytes[b], -1)
            if len(self.pairs) < CACHE_ENTRIES:
                self.pairs[a, b] = r
        return r

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank = len(piece), self.pair_rank
        ids = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        for i in range(n - 1):
            r = rank(ids[i], ids[i + 1])
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    words[r >> 8] = words.get(r >> 8, 0) | 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            low = word & -word
            r = w << 8 | low.bit_length() - 1
            words[w] = word ^ low
            if word == low:
                top ^= 1 << w
            at = buckets.pop(r)
            at.sort()
            for k, i in enumerate(at):
                j = after[i]
                if ids[i] < 0 or j >= n or rank(ids[i], ids[j]) != r:
                    continue
                ids[i], ids[j] = r, -1
                after[i] = nxt = after[j]
                lower = False
                if nxt < n:
                    before[nxt] = i
                p = before[i]
                for q, m in ((p, -1 if p < 0 else rank(ids[p], r)), (i, -1 if nxt >= n else rank(r, ids[nxt]))):
                    if m >= 0:
                        if m in buckets:
                            buckets[m].append(q)
                        else:
                            buckets[m] = [q]
                            words[m >> 8] = words.get(m >> 8, 0) | 1 << (m & 255)
                            top |= 1 << (m >> 8)
                        lower |= m < r
                if lower and k + 1 < len(at):
                    # a lower rank goes first; the others of this rank wait
                    buckets[r] = at[k + 1 :]
                    words[w] = words.get(w, 0) | low
                    top |= 1 << w
                    break
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text; none for an empty or null one. Texts of special tokens are ordinary text."""
        if not text:
            return []
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))


class _Cache(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, token: str) -> list[int]:
        ids = self.encoder.merge(token.encode("utf-8", "replace"))
        if len(token) <= CACHE_LENGTH:
            self[token] = ids
        return ids


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = hash(shared.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _vocabulary(spark: SparkSession, path: str | None):
    """The file, read by the driver and broadcast: under 1 MB for 50,000 tokens, whatever the corpus."""
    with open(path or default_vocabulary(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """array<int> of ids of each text, without special tokens; empty for empty and null texts."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(text: pa.Array) -> pa.Array:
        encoder = _encoder(shared)
        found = [np.array(encoder.encode(t), np.int32) for t in text.to_pylist()]
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=ends[1:])
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        if ends[-1] >= 2**31:
            return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    return ids(text)


def token_counts(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Number of ids of each text; 0 for empty and null texts."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf(T.LongType())
    def counts(text: pa.Array) -> pa.Array:
        encoder = _encoder(shared)
        return pa.array([len(encoder.encode(t)) for t in text.to_pylist()], pa.int64())

    return counts(text)
