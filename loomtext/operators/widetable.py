"""Attribute-value rows into wide tables by column-block pivoting.

The attributes are divided into blocks, and the facts written once in a folder per block. Each
block's facts are gathered by (entity, attribute, salt), combined before the shuffle, so an entity
that holds a third of all rows is spread over the salts, and then put on their entity. There the block
is pivoted: the cells of an entity lie in an array in the order of the block's columns, a bitmap tells which
columns have one, and the number of bits below a column's is its place in the array. All
blocks are partitioned alike, and so are the distinct entities to which they are joined, so the
joins need no further exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.workspace import Workspace

SALTS = 16
#: Columns of a block at most, as many as a bitmap has bits.
MOST_COLUMNS = 62


def _block(facts: DataFrame, block: Sequence[tuple[str, str, bool]], typed: dict[str, Callable[[Column], Column]], conflicts: str, partitions: int) -> DataFrame:
    """(entity, attributes..., conflicts) of facts (entity, pos, key) of one block, in so many partitions by entity; pos numbers its attributes."""
    bits = sum(1 << i for i, (_, _, one) in enumerate(block) if one)
    single = F.expr(f"shiftright({bits}L, cast(pos as int)) & 1L") == 1
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    sets = facts.groupBy("entity", "pos", salt.alias("salt")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.collect_set(F.when(~single, F.col("key"))).alias("keys"))
    cells = sets.repartition(partitions, "entity").groupBy("entity", "pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.flatten(F.collect_list("keys")).alias("keys"))
    cell = F.struct("pos", "lo", F.array_sort("keys").alias("keys"))
    rows = cells.groupBy("entity").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"), F.bit_or(F.expr("shiftleft(1L, cast(pos as int))")).alias("has"),
        F.bit_or(F.when(single & (F.col("lo") != F.col("hi")), F.expr("shiftleft(1L, cast(pos as int))")).otherwise(F.lit(0).cast("long"))).alias("bad"),
    )

    def at(i: int) -> Column:
        below = F.bit_count(F.col("has").bitwiseAND(F.lit((1 << i) - 1)))
        return F.when(F.col("has").bitwiseAND(F.lit(1 << i)) != 0, F.get("cells", below))

    columns = [(typed[kind](at(i)["lo"]) if one else F.transform(at(i)["keys"], typed[kind])).alias(a) for i, (a, kind, one) in enumerate(block)]
    named = F.array_compact(F.array(*[F.when(F.col("bad").bitwiseAND(F.lit(1 << i)) != 0, F.lit(a)) for i, (a, _, one) in enumerate(block) if one]).cast("array<string>"))
    return rows.select("entity", *columns, F.when(F.col("bad") != 0, named).alias(conflicts))


def pivot_wide(facts: DataFrame, attributes: Sequence[tuple[str, str, bool]], typed: dict[str, Callable[[Column], Column]], block_size: int = MOST_COLUMNS) -> DataFrame:
    """One row per entity with a column per attribute, from facts (entity, attr, key), and `conflicts`.

    attributes: (name, type, single-valued); typed: by type a function from the key's Column to
    the cell's. Attributes of facts that aren't listed, and null entities, attributes and keys
    are dropped. A single-valued cell with several distinct keys holds the least and its
    attribute is named in `conflicts`; cells without facts are null. A list holds every distinct key, however many.
    A block has at most MOST_COLUMNS columns, whatever block_size. An empty table gives no rows.
    """
    attributes = list(attributes)
    work = Workspace(facts.sparkSession, "wide")
    size = max(1, min(block_size, MOST_COLUMNS))
    groups = [attributes[at : at + size] for at in range(0, len(attributes), size)]
    spark = facts.sparkSession
    # the place of each attribute: as many rows as there are columns
    places = F.broadcast(spark.createDataFrame([(a, i // size, i % size) for i, (a, _, _) in enumerate(attributes)], "attr string, block int, pos int"))
    # the facts are read and typed once; each block reads its own folder of them
    placed = facts.select("entity", "attr", "key").join(places, "attr").select("block", "entity", "pos", "key")
    written = work.keep(placed, "facts", by=("block",))
    good = written.where("entity is not null and key is not null")
    # equal numbers of partitions, so that blocks join where they are
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = [_block(good.where(F.col("block") == i), g, typed, f"conflicts_{i}", partitions) for i, g in enumerate(groups)]
    entities = good.select("entity").distinct().repartition(partitions, "entity")
    wide = blocks[0] if len(blocks) == 1 else reduce(lambda a, b: a.join(b, "entity", "left"), blocks, entities)
    every = F.concat(*[F.coalesce(f"conflicts_{i}", F.array().cast("array<string>")) for i in range(len(groups))])
    return wide.select("entity", *[f"`{a}`" for a, _, _ in attributes], F.array_sort(every).alias("conflicts"))
