"""Global ranks and deterministic choices without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.workspace import Workspace


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with a 1-based rank over all rows in `order` (break ties in it).

    The rows are range-partitioned and sorted, written once, and each partition's offset is
    added; only the counts per partition meet in one task.
    """
    work = Workspace(df.sparkSession, "rank")
    kept = work.keep(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("__part")).agg((F.max(at) + 1).alias("__n"))
    offsets = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__off"))
    return kept.withColumn("__part", part).join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__off") + at + 1).alias(name))


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank", size: str | None = None) -> DataFrame:
    """df with a 1-based rank within its group in `order` (break ties in it), and the group's size if a name is given for it.

    One order of all rows by group gives the ranks, so that a group of a third of all rows is spread over as
    many tasks as it needs; only each group's first rank and size are joined to it.
    """
    ranked = global_rank(df, [*[F.col(g).asc_nulls_first() for g in group], *order], "__all")
    firsts = ranked.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.min("__all").alias("__first"), F.count("*").alias("__size"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    return ranked.join(firsts, same).select(*df.columns, (F.col("__all") - F.col("__first") + 1).alias(name), *([F.col("__size").alias(size)] if size else []))


def rank_buckets(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: int, name: str = "bucket") -> DataFrame:
    """df with a bucket of `size` rows of its group by descending order: 0 holds the last ones."""
    return group_rank(df, group, order, "__r", "__n").withColumn(name, F.floor((F.col("__n") - F.col("__r")) / size)).drop("__r", "__n")


def hash_share(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on key and seed alone; md5, so other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def split_name(key: Column, shares: dict[str, float], seed: int = 0) -> Column:
    """Assigns each key to one of the named shares (adding up to 1), independently of other rows."""
    u, upto, out = hash_share(key, seed), 0.0, None
    for name, share in shares.items():
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(list(shares)[-1])


def weighted_sample(df: DataFrame, key: Column, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement with chances in proportion to weight, by seeded keys -ln(u)/w. Rows without positive weight are never taken."""
    u = F.greatest(hash_share(key, seed), F.lit(1e-12))
    return df.where(weight > 0).orderBy((-F.log(u) / weight).asc(), key.asc()).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark limits each task's groups before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def chunk(df: DataFrame, group: Sequence[str], key: str, size: int, seed: int = 0) -> DataFrame:
    """df with `chunk`: the rows of a group in seeded order, `size` at a time."""
    return group_rank(df, group, [hash_share(F.col(key), seed), F.col(key)], "__r").withColumn("chunk", F.floor((F.col("__r") - 1) / size)).drop("__r")
