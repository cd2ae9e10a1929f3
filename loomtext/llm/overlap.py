"""Same or near-same records across splits.

Records are canonicalised (compatibility forms, case, marks, punctuation and white space don't
count) and hashed. Equal hashes make a class, and joining the hashes of held-out records with those of
training records gives the equal ones. For near copies the runs of words of each class are hashed and joined as well:
a class is reduced to the runs that may occur on both sides, ordered from rare to common by counts kept in a table of fixed size, and only
a prefix of which two sets above the threshold must share several takes part in the join; sizes and
positions rule out most candidates, and the common runs of the others are counted exactly.
Only classes are compared and linked; rows are counted by class, and copies are expanded in `pairs` alone.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.workspace import Workspace

#: Bits of a run's hash that name its slot when runs are counted to order them.
SLOTS = 23
#: Runs by which the prefix that must share one is made longer, so that it must share so many more.
MORE = 4
_ASCII = re.compile(r"[a-z0-9]+")
_ANY = regex.compile(r"[\p{L}\p{N}]+")
_MARKS = regex.compile(r"\p{M}+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKD, without combining marks, in lower case."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _ANY.findall(_MARKS.sub("", unicodedata.normalize("NFKD", _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower())))


_CANON = T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("canon", T.StringType())])


@F.arrow_udf(_CANON)
def canonical(text: pa.Array) -> pa.Array:
    """struct(sig, canon): a text's words with single spaces, and their hash; null sig without words."""
    canon = [" ".join(words(t)) if t else "" for t in text.to_pylist()]
    sig = [hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest() if c else None for c in canon]
    return pa.StructArray.from_arrays([pa.array(sig, pa.binary()), pa.array(canon, pa.string())], ["sig", "canon"])


def run_hashes(canon: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k consecutive words of a canonical text."""
    w = canon.split(" ") if canon else []
    if len(w) < k:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(" ".join(run)) for run in zip(*(w[i:] for i in range(k)))], np.uint64).view(np.int64))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - SLOTS)).astype(np.int64)


def runs_of(canon: Column, k: int) -> Column:
    """array<bigint>: the hashes of a canonical text's runs of k words."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def f(canon: pa.Array) -> pa.Array:
        found = [run_hashes(t, k) for t in canon.to_pylist()]
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=ends[1:])
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))).cast(pa.list_(pa.int64()))

    return f(canon)


class CrossSplit:
    """Overlaps of the rows of df (id, text, held) between held-out rows and the others.

    Null ids are dropped; of several rows of an id that with the greatest `order` counts, ties by
    content. Rows without words take no part, and those with fewer than k only as equal ones. Two rows match if
    their sets of runs of k words have at least `num / den` of their union in common. An empty
    table gives empty results.
    """

    def __init__(self, df: DataFrame, k: int = 3, num: int = 1, den: int = 2, order: Column | None = None, about: dict[str, Column] | None = None):
        self.num, self.den, self.k, self._near = num, den, k, None
        self.work = Workspace(df.sparkSession, "overlap")
        about = about or {}
        rows = df.select("id", (F.lit(0) if order is None else order).alias("order"), F.coalesce("held", F.lit(False)).alias("held"), *[c.alias(n) for n, c in about.items()], canonical(F.col("text")).alias("c"))
        # a test before the table is written would be pushed below the hashing, and it be done twice
        rows = self.work.keep(rows.select("id", "order", "held", *about, "c.sig", "c.canon"), "canonical")
        best = F.max(F.struct("order", "sig", "held", *about)).alias("r")
        #: (id, held, sig, about...)
        self.members = self.work.keep(rows.where("id is not null").groupBy("id").agg(best).select("id", "r.held", "r.sig", *[f"r.{n}" for n in about]), "members")
        sides = self.members.where("sig is not null").groupBy("sig").agg(F.max(F.col("held").cast("int")).alias("e"), F.max((~F.col("held")).cast("int")).alias("t"))
        texts = rows.where("sig is not null").groupBy("sig").agg(F.max("canon").alias("canon"))
        # the number's lowest bits tell the sides that have members
        number = F.monotonically_increasing_id() * 4 + F.col("e") * 2 + F.col("t")
        classes = texts.join(sides, "sig").select("sig", "e", "t", runs_of(F.col("canon"), k).alias("runs"))
        #: (c, sig, n, runs): n distinct runs
        self.classes = self.work.keep(classes.select(number.alias("c"), "sig", F.size("runs").alias("n"), "runs"), "classes")

    def _needed(self, a: str, b: str) -> Column:
        """The least number of common runs of sets of sizes a and b."""
        whole = self.num * (F.col(a) + F.col(b))
        return ((whole + (self.num + self.den - 1)) / (self.num + self.den)).cast("long")

    def same(self) -> DataFrame:
        """(sig, n): classes with rows on both sides."""
        return self.classes.where(F.col("c").bitwiseAND(F.lit(3)) == 3).select("sig", "n")

    def near(self) -> DataFrame:
        """(held_sig, train_sig, common, n_held, n_train): different classes above the threshold; sets of runs may be equal."""
        if self._near is None:
            self._near = self.work.keep(self._linked(), "near")
        return self._near

    def _levels(self, classes: DataFrame) -> np.ndarray:
        """How common the runs of each slot of hashes are among all classes, in quarter powers of two from 1; 0 where none is on both sides.

        2**SLOTS bytes whatever the corpus: with more runs than slots the levels tell less, but any order of runs gives the same links.
        """

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, train = np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, np.int64)
            for batch in batches:
                c, runs = batch.column("c").to_numpy(), batch.column("runs")
                slot = _slots(runs.flatten().to_numpy())
                side = np.repeat(c, np.diff(runs.offsets.to_numpy()))
                held += np.bincount(slot[side & 2 > 0], minlength=1 << SLOTS)
                train += np.bincount(slot[side & 1 > 0], minlength=1 << SLOTS)
            used = np.flatnonzero(held + train)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used]), pa.array(train[used])], ["slot", "e", "t"])

        sums = classes.select("c", "runs").mapInArrow(count, "slot int, e bigint, t bigint").groupBy("slot").agg(F.sum("e").alias("e"), F.sum("t").alias("t")).where("e > 0 and t > 0")
        found = sums.select("slot", F.least(F.lit(255), 1 + F.floor(4 * F.log2(F.col("e") + F.col("t")))).cast("short").alias("level")).toArrow()
        levels = np.zeros(1 << SLOTS, np.uint8)
        levels[found.column("slot").to_numpy()] = found.column("level").to_numpy()
        return levels

    def _linked(self) -> DataFrame:
        classes = self.classes.where("n > 0")
        e, t = F.shiftright("c", 1).bitwiseAND(F.lit(1)), F.col("c").bitwiseAND(F.lit(1))
        shared, num, den = classes.sparkSession.sparkContext.broadcast(self._levels(classes)), self.num, self.den

        @F.arrow_udf(T.StructType([T.StructField("s", T.ArrayType(T.LongType())), T.StructField("p", T.IntegerType())]))
        def ordered_runs(runs: pa.Array) -> pa.Array:
            levels, s, p = shared.value, [], []
            for h in runs:
                h = h.values.to_numpy()
                level = levels[_slots(h)]
                on = np.flatnonzero(level)
                s.append(h[on[np.argsort(level[on], kind="stable")]])
                p.append(max(0, len(on) + 1 + (-len(h) * num) // den))
            ends = np.zeros(len(s) + 1, np.int64)
            np.cumsum([len(x) for x in s], out=ends[1:])
            lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(s) if s else np.zeros(0, np.int64))).cast(pa.list_(pa.int64()))
            return pa.StructArray.from_arrays([lists, pa.array(p, pa.int32())], ["s", "p"])

        ordered = self.work.keep(classes.select("c", "n", ordered_runs("runs").alias("o")).select("c", "n", "o.s", "o.p"), "ordered").where("p > 0").withColumn("m", F.size("s"))
        # so many bits of the hashes are joined that few meet by chance; the counting below uses all
        runs = max(1, int(classes.agg(F.sum("n").alias("n")).first()["n"] or 0))
        prefix = ordered.select("c", "n", "m", F.posexplode(F.slice("s", F.lit(1), F.col("p") + MORE)).alias("i", "h")).select("c", "n", (F.col("m") - F.col("i")).alias("r"), F.shiftrightunsigned("h", 64 - min(64, runs.bit_length() + 6)).alias("h"))
        left = prefix.where(e == 1).select("h", F.col("c").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"))
        right = prefix.where(t == 1).select("h", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
        needed = self._needed("na", "nb")
        alike = (F.col("a") != F.col("b")) & (F.col("na") * self.den >= F.col("nb") * self.num) & (F.col("nb") * self.den >= F.col("na") * self.num)
        # of the runs that two sets share, the first MORE + 1 lie in both prefixes, and at least `needed` less MORE from there to the end
        met = left.join(right, "h").where(alike & (F.least("ra", "rb") >= needed - MORE)).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
        # once written, their size decides how the pairs meet the runs
        pairs = self.work.keep(met.where(F.col("k") >= F.least(needed, F.lit(MORE + 1))).select("a", "b", "na", "nb"), "pairs")
        sa, sb = ordered.select(F.col("c").alias("a"), F.col("s").alias("sa")), ordered.select(F.col("c").alias("b"), F.col("s").alias("sb"))
        counted = self.work.keep(pairs.join(sa, "a"), "with_runs").join(sb, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
        found = self.work.keep(counted.where(F.col("common") >= self._needed("na", "nb")), "found")
        named = found.join(classes.select(F.col("c").alias("a"), F.col("sig").alias("held_sig")), "a").join(classes.select(F.col("c").alias("b"), F.col("sig").alias("train_sig")), "b")
        return named.select("held_sig", "train_sig", "common", F.col("na").alias("n_held"), F.col("nb").alias("n_train"))

    def links(self, short: bool = False) -> DataFrame:
        """(held_sig, train_sig, similarity, same): linked classes, and classes with rows on both sides as linked to themselves.

        short: those of fewer than k words too.
        """
        near = self.near().select("held_sig", "train_sig", (F.col("common") / (F.col("n_held") + F.col("n_train") - F.col("common"))).alias("similarity"), F.lit(False).alias("same"))
        same = self.same() if short else self.same().where("n > 0")
        return near.unionByName(same.select(F.col("sig").alias("held_sig"), F.col("sig").alias("train_sig"), F.lit(1.0).alias("similarity"), F.lit(True).alias("same")))

    def pairs(self) -> DataFrame:
        """(held_id, train_id, similarity): every matching pair of a held-out and another row; 1.0 for equal sets."""
        held = self.members.where("held").select(F.col("sig").alias("held_sig"), F.col("id").alias("held_id"))
        train = self.members.where("not held").select(F.col("sig").alias("train_sig"), F.col("id").alias("train_id"))
        return self.links().join(held, "held_sig").join(train, "train_sig").select("held_id", "train_id", "similarity")

    def membership(self) -> DataFrame:
        """(id, held, class_id, n_links): each row's class, named by its least id, and the number of classes of the other side that it is linked to, its own included.

        Rows without words have a null class and no links.
        """
        classes = self.members.where("sig is not null").groupBy("sig").agg(F.min("id").alias("class_id"))
        links = self.links(short=True)
        ends = links.select(F.lit(True).alias("held"), F.col("held_sig").alias("sig")).unionByName(links.select(F.lit(False).alias("held"), F.col("train_sig").alias("sig")))
        n = ends.groupBy("sig", "held").agg(F.count("*").alias("n_links"))
        return self.members.join(classes, "sig", "left").join(n, ["sig", "held"], "left").select("id", "held", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

    def counts(self, held_by: list[str], train_by: list[str]) -> DataFrame:
        """(held_by..., train_..., n_pairs, n_texts, n_same): matching pairs, held-out rows in them, and pairs of equal rows, by columns of `about`.

        Rows are counted per class before classes meet, so copies cost nothing. Equal rows of fewer than k words count too.
        """
        train = self.members.where("not held and sig is not null").groupBy(F.col("sig").alias("train_sig"), *[F.col(c).alias(f"train_{c}") for c in train_by]).agg(F.count("*").alias("nt"))
        held = self.members.where("held and sig is not null").groupBy(F.col("sig").alias("held_sig"), *held_by).agg(F.count("*").alias("nh"))
        names = [f"train_{c}" for c in train_by]
        met = self.links(short=True).join(train, "train_sig").groupBy("held_sig", *names).agg(F.sum("nt").alias("nt"), F.sum(F.when(F.col("same"), F.col("nt")).otherwise(0)).alias("ns"))
        return met.join(held, "held_sig").groupBy(*held_by, *names).agg(F.sum(F.col("nh") * F.col("nt")).alias("n_pairs"), F.sum("nh").alias("n_texts"), F.sum(F.col("nh") * F.col("ns")).alias("n_same"))
