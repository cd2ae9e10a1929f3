"""Parent-child links to full hierarchies by tree contraction.

`contract` alternates two steps until nothing is left:

* rake: nodes without children are taken off,
* compress: in a chain of nodes that have one parent and one child each, those of locally
  greatest random priority are spliced out, and one link replaces the two at the node.

Links between the same two nodes become one that knows the shortest and the longest way and the
number of ways it stands for, so a row of diamonds is a chain. Every removal is recorded with its
links to parents, so going through the rounds backwards gives each node its depths, roots and
ancestors from those of its parents, and no path is ever listed for that. Only `paths`, whose
result they are, keeps the ids along the links.

Cycles don't contract. `cycle_nodes` rakes from both ends and compresses until only the
nonterminating core is left. There each node picks one link at random; doubling the picks, each
node finds in logarithmically many steps the cycle on which it ends. The same is done backwards from those cycles.
A node that ends on a cycle from which it is reached lies on one too; all of these become one
node, and the contraction goes on. Cycle nodes then have their links to parents cut and are roots of their own.

Nothing is collected but counts. Each round writes its table into the shared folder. A parent
with very many children only ever meets a partial count and, going backwards, a join whose
skewed side AQE splits; a child's parents come from one row of the input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.workspace import Workspace

#: links to parents: the ids spliced out along it (kept for paths only), the shortest and longest way and the number of ways
UP = "array<struct<p:string,seg:array<string>,lo:bigint,hi:bigint,n:bigint>>"


def _none() -> Column:
    return F.array().cast(UP)


def links(df: DataFrame, node: str, parents: str) -> DataFrame:
    """(id, up, missing): one row per node with its distinct parents that are nodes themselves.

    `node` is unique. Null parents and repeated ones are dropped; a parent without a row of its
    own is counted in `missing` and otherwise ignored, so a node all of whose parents are missing is a root.
    """
    pairs = df.select(F.col(node).alias("id"), F.explode(F.array_distinct(parents)).alias("p")).where("p is not null")
    known = df.select(F.col(node).alias("p"), F.lit(1).alias("known"))
    one = F.lit(1).cast("long")
    up = F.struct("p", F.array().cast("array<string>").alias("seg"), one.alias("lo"), one.alias("hi"), one.alias("n"))
    found = pairs.join(known, "p", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("known") == 1, up))).alias("up"), F.count_if(F.col("known").isNull()).alias("missing"))
    return df.select(F.col(node).alias("id")).join(found, "id", "left").select("id", F.coalesce(F.col("up").cast(UP), _none()).alias("up"), F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))


def _priority(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def _round(nodes: DataFrame, turn: int) -> DataFrame:
    """(id, up, child, below, state): state is leaf, chain or keep; child is the only child of a chain node, below the shortest way to it."""
    down = nodes.select("id", F.explode("up").alias("u")).groupBy(F.col("u.p").alias("pid")).agg(F.count("*").alias("n"), F.min(F.struct("id", "u.lo")).alias("c"))
    both = nodes.join(down, F.col("id") == F.col("pid"), "left")
    parent, child, own = F.get("up", F.lit(0))["p"], F.col("c.id"), _priority(F.col("id"), turn)
    chain = (F.size("up") == 1) & (F.col("n") == 1) & (own > _priority(parent, turn)) & (own > _priority(child, turn))
    state = F.when(F.col("n").isNull(), "leaf").when(chain, "chain").otherwise("keep")
    return both.select("id", "up", child.alias("child"), F.col("c.lo").alias("below"), state.alias("state"))


def _as_one(ups: Column) -> Column:
    """Links to the same parent as one."""
    names = F.array_distinct(F.transform(ups, lambda x: x["p"]))

    def one(name: Column) -> Column:
        same = F.filter(ups, lambda y: y["p"] == name)
        ways = F.aggregate(same, F.lit(0).cast("long"), lambda total, z: F.try_add(total, z["n"]))
        return F.struct(name.alias("p"), F.array().cast("array<string>").alias("seg"), F.array_min(F.transform(same, lambda z: z["lo"])).alias("lo"), F.array_max(F.transform(same, lambda z: z["hi"])).alias("hi"), ways.alias("n"))

    return F.when(F.size(names) == F.size(ups), ups).otherwise(F.transform(names, one).cast(UP))


def _splice(table: DataFrame, state: str, trails: bool) -> DataFrame:
    """The nodes of a state, with links to spliced nodes led on to the parents of those."""
    out = table.where("state = 'chain'").groupBy(F.col("child").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("id", F.get("up", F.lit(0)).alias("to")))).alias("via"))
    kept = table.where(F.col("state") == state).select("id", "up").join(out, "id", "left")

    def lead(x: Column) -> Column:
        to = F.try_element_at(F.col("via"), x["p"])
        seg = F.concat(to["seg"], F.array(x["p"]), x["seg"]) if trails else x["seg"]
        return F.when(to.isNull(), x).otherwise(F.struct(to["p"].alias("p"), seg.alias("seg"), (to["lo"] + x["lo"]).alias("lo"), (to["hi"] + x["hi"]).alias("hi"), F.try_multiply(to["n"], x["n"]).alias("n")))

    led = kept.select("id", F.when(F.col("via").isNull(), F.col("up")).otherwise(F.transform("up", lead)).cast(UP).alias("up"))
    return led if trails else led.select("id", _as_one(F.col("up")).alias("up"))


@dataclass
class Round:
    """Nodes taken off in a round: leaves (id, up), and spliced ones (id, up, child, below) if there are any."""

    leaves: DataFrame
    chain: DataFrame | None

    def nodes(self) -> DataFrame:
        return self.leaves if self.chain is None else self.leaves.unionByName(self.chain.select("id", "up"))


def contract(nodes: DataFrame, work: Workspace, trails: bool = False) -> list[Round]:
    """The rounds of raking and compressing nodes (id, up) without cycles, in order of removal.

    trails: links keep the ids spliced out of them, and those between the same nodes stay apart.
    """
    rounds, turn, nodes = [], 0, nodes.select("id", "up")
    while True:
        table, n = work.measure(_round(nodes, turn), f"round{turn}", leaf=F.col("state") == "leaf", chain=F.col("state") == "chain", keep=F.col("state") == "keep")
        if not n["leaf"] and n["keep"]:
            raise ValueError("the links have a cycle")
        # a leaf may hang from a chain node that goes in the same round
        leaves = _splice(table, "leaf", trails) if n["chain"] else table.where("state = 'leaf'").select("id", "up")
        if n["leaf"]:
            rounds.append(Round(leaves, table.where("state = 'chain'").select("id", "up", "child", "below") if n["chain"] else None))
        if not n["keep"]:
            return rounds
        nodes, turn = _splice(table, "keep", trails) if n["chain"] else table.where("state = 'keep'").select("id", "up"), turn + 1


def _settled(edges: DataFrame) -> DataFrame:
    """(kind, a, b, tag) of links (a, b, tag) of which several may join the same nodes.

    kind edge: a link; loop: a link of a node to itself, one per tag; into: the tag a went into the tag b.
    """
    loops = edges.where("a = b").select(F.lit("loop").alias("kind"), "a", "b", "tag")
    same = Window.partitionBy("a", "b").orderBy(F.col("tag").asc_nulls_last())
    each = edges.where("a <> b").select("a", "b", "tag", F.row_number().over(same).alias("i"), F.first("tag").over(same).alias("head")).where("i = 1 or tag is not null")
    first = F.col("i") == 1
    rest = each.select(F.when(first, "edge").otherwise("into").alias("kind"), F.when(first, F.col("a")).otherwise(F.col("tag")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("head")).alias("b"), F.when(first, F.col("tag")).alias("tag"))
    return loops.unionByName(rest)


def _shrunk(edges: DataFrame, turn: int) -> DataFrame:
    """(kind, a, b, tag) as in _settled, after nodes without a way in or out are gone and chains compressed.

    A link that replaces two at a spliced node has that node as its tag, and their tags go into it.
    """
    outs = edges.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_out"), F.min(F.struct("b", "tag")).alias("o"))
    ins = edges.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n_in"), F.min(F.struct("a", "tag")).alias("i"))
    own = _priority(F.col("id"), turn)
    chain = (F.col("n_out") == 1) & (F.col("n_in") == 1) & (own > _priority(F.col("o.b"), turn)) & (own > _priority(F.col("i.a"), turn))
    state = F.when(F.col("n_out").isNull() | F.col("n_in").isNull(), "end").when(chain, "chain").otherwise("keep")
    nodes = outs.join(ins, "id", "full").select("id", state.alias("state"), F.col("o.b").alias("to"), F.col("o.tag").alias("above"), F.col("i.tag").alias("under"))
    at_a = nodes.where("state = 'keep'").select(F.col("id").alias("a"))
    at_b = nodes.where("state <> 'end'").select(F.col("id").alias("b"), "state", "to")
    led = F.col("state") == "chain"
    left = edges.join(at_a, "a", "left_semi").join(at_b, "b").select("a", F.when(led, F.col("to")).otherwise(F.col("b")).alias("b"), F.when(led, F.col("b")).otherwise(F.col("tag")).alias("tag"))
    gone = nodes.where("state = 'chain'").select(F.explode(F.array_compact(F.array("above", "under"))).alias("a"), F.col("id").alias("b"))
    return _settled(left).unionByName(gone.select(F.lit("into").alias("kind"), "a", "b", F.lit(None).cast("string").alias("tag")))


def _orbits(picks: DataFrame, work: Workspace) -> DataFrame:
    """(id, root, on) of a map (id, to) of nodes to nodes: the least node of the cycle on which each ends, and whether it lies on it.

    Each step doubles the reach. `alive` are the images of ever more steps; once they are no fewer after
    a doubling they are the cycles, and their least nodes are known once another doubling lowers none.
    """
    table, n = work.measure(picks.select("id", "to", F.col("to").alias("low"), F.lit(True).alias("alive"), F.lit(True).alias("moved")), "orbit", alive=F.lit(True))
    while True:
        on = table.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("then"))
        image = table.where("alive").select(F.col("to").alias("id")).distinct().withColumn("hit", F.lit(True))
        step = table.select("id", "to", "low").join(on, "to").join(image, "id", "left")
        before = n["alive"]
        table, n = work.measure(step.select("id", F.col("next").alias("to"), F.least("low", "then").alias("low"), F.coalesce("hit", F.lit(False)).alias("alive"), (F.col("then") < F.col("low")).alias("moved")), "orbit", alive=F.col("alive"), moved=F.col("alive") & F.col("moved"))
        if n["alive"] == before and not n["moved"]:
            ends = table.where("alive").select(F.col("id").alias("to"), F.col("low").alias("root"))
            return table.select("id", "to", F.col("alive").alias("on")).join(ends, "to").select("id", "root", "on")


def _joined(edges: DataFrame, work: Workspace, turn: int) -> DataFrame:
    """(id, into) of the nodes of a core that were found on cycles, and the node that stands for those of the same cycle.

    Every node of the links (a, b) has a way in and a way out.
    """
    chance = F.xxhash64("a", "b", F.lit(turn))
    ahead = work.keep(_orbits(edges.groupBy(F.col("a").alias("id")).agg(F.min_by("b", chance).alias("to")), work), "ahead")
    cycle = ahead.where("on").select("id", "root")
    of_a, of_b = cycle.select(F.col("id").alias("a"), F.col("root").alias("ra")), cycle.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    # back from the cycles that were found, where the way ends
    free = edges.join(of_b, "b", "left_anti").join(of_a, "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
    picks = free.groupBy(F.col("b").alias("id")).agg(F.min_by("a", chance).alias("to")).unionByName(cycle.select(F.col("root").alias("id"), F.col("root").alias("to")).distinct())
    back = _orbits(picks, work).select("id", F.col("root").alias("from"), F.col("on").alias("round"))
    into = F.when(F.col("on"), F.col("root")).when(F.col("round") | (F.col("from") == F.col("root")), F.col("from"))
    return ahead.join(back, "id", "left").select("id", into.alias("into")).where("into is not null")


def cycle_nodes(edges: DataFrame, work: Workspace) -> DataFrame:
    """(id): the nodes on cycles of links (a, b), each link once. Null ends are left out."""
    start = edges.where("a is not null and b is not null").select(F.when(F.col("a") == F.col("b"), "loop").otherwise("edge").alias("kind"), "a", "b", F.lit(None).cast("string").alias("tag"))
    loops, intos, found, turn = [], [], [], 0

    def put(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The links of a written table and their number; what else it holds is remembered."""
        table, n = work.measure(df, name, size=F.col("kind") == "edge", loop=F.col("kind") == "loop", into=F.col("kind") == "into")
        for kind, tables in (("loop", loops), ("into", intos)):
            if n[kind]:
                tables.append(table.where(F.col("kind") == kind).select("a", "b", "tag"))
        return table.where("kind = 'edge'").select("a", "b", "tag"), n["size"]

    def together(tables: list[DataFrame]) -> DataFrame:
        out = edges.sparkSession.createDataFrame([], "a string, b string, tag string")
        for t in tables:
            out = out.unionByName(t)
        return out

    table, size = put(start, "links")
    while size:
        before = None
        while size and size != before:
            before = size
            table, size = put(_shrunk(table, turn), "shrunk")
            turn += 1
        if not size:
            break
        joined = work.keep(_joined(table, work, turn), "joined")
        found.append(joined.select("id"))
        of_a, of_b = joined.select(F.col("id").alias("a"), F.col("into").alias("ja")), joined.select(F.col("id").alias("b"), F.col("into").alias("jb"))
        led = table.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ja", "a").alias("a"), F.coalesce("jb", "b").alias("b"), "tag")
        table, size = put(_settled(led), "core")
    looped = together(loops)
    tags, n = work.measure(looped.where("tag is not null").select(F.col("tag").alias("into")).distinct(), "tags", n=F.lit(True))
    out = looped.select(F.col("a").alias("id"))
    if n["n"]:
        into, n = work.measure(together(intos).select(F.col("a").alias("id"), F.col("b").alias("into")), "into", moved=F.lit(True))
        while n["moved"]:
            on = into.select(F.col("id").alias("into"), F.col("into").alias("next"))
            into, n = work.measure(into.join(on, "into", "left").select("id", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("m")), "into", moved=F.col("m"))
            into = into.select("id", "into")
        out = out.unionByName(tags.select(F.col("into").alias("id"))).unionByName(into.join(tags, "into", "left_semi").select("id"))
    for f in found:
        out = out.unionByName(f)
    return work.keep(out.distinct(), "cyclic")


@dataclass
class Hierarchy:
    """nodes (id, up, missing), cyclic (id), and the workspace.

    A cycle has no root: each of its nodes counts as one, and what is below a cycle starts at the
    cycle node it hangs from. Cycles are not entered from within.
    """

    nodes: DataFrame
    cyclic: DataFrame
    work: Workspace
    _rounds: dict[bool, list[Round]] = field(default_factory=dict, repr=False)

    def rounds(self, trails: bool = False) -> list[Round]:
        """The contraction of the links once cycle nodes have none to parents."""
        if trails not in self._rounds:
            cyclic = self.cyclic.select("id", F.lit(1).alias("cyc"))
            cut = self.nodes.join(cyclic, "id", "left").select("id", F.when(F.col("cyc") == 1, _none()).otherwise(F.col("up")).alias("up"))
            self._rounds[trails] = contract(self.work.keep(cut, "cut"), self.work, trails)
        return self._rounds[trails]

    def _backwards(self, trails: bool, root: DataFrame | None, start: list[Column], step, name: str) -> DataFrame:
        """The union of what `step` makes of each round, last removed first, out of (link, row of its parent)."""
        done = root
        for r in reversed(self.rounds(trails)):
            nodes = r.nodes()
            rows = nodes.where(F.size("up") == 0).select("id", *start)
            if done is not None:
                ups = nodes.select("id", F.explode("up").alias("u")).select("id", F.col("u.p").alias("p"), "u.seg", F.col("u.lo").alias("way"), F.col("u.hi").alias("far"), F.col("u.n").alias("ways"))
                rows = rows.unionByName(step(ups.join(done.withColumnRenamed("id", "p"), "p")))
            kept = self.work.keep(rows, name)
            done = kept if done is None else done.unionByName(kept)
        return done

    def paths(self) -> DataFrame:
        """(id, path): one row per way from a root down to the node, ends included."""
        step = lambda x: x.select("id", F.concat("path", "seg", F.array("id")).alias("path"))
        done = self._backwards(True, None, [F.array("id").alias("path")], step, "paths")
        return self.nodes.sparkSession.createDataFrame([], "id string, path array<string>") if done is None else done

    def reach(self) -> DataFrame:
        """(id, root, lo, hi, n): per node and root above it the shortest and longest way and the number of ways, null beyond 2**63 - 1."""
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

        def step(x: DataFrame) -> DataFrame:
            each = x.select("id", "root", (F.col("lo") + F.col("way")).alias("lo"), (F.col("hi") + F.col("far")).alias("hi"), F.try_multiply("n", "ways").alias("n"))
            # a null number of ways stays null
            return each.groupBy("id", "root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.when(F.count("n") == F.count("*"), F.try_sum("n")).alias("n"))

        done = self._backwards(False, None, [F.col("id").alias("root"), zero.alias("lo"), zero.alias("hi"), one.alias("n")], step, "reach")
        return self.nodes.sparkSession.createDataFrame([], "id string, root string, lo bigint, hi bigint, n bigint") if done is None else done

    def descendants(self) -> DataFrame:
        """(id, descendant, distance): one row per pair, distance along the shortest way.

        A node that is put back gets the ancestors of its parents; one that was spliced out of a
        link is put above all that its child is above, too.
        """
        pairs = None
        for r in reversed(self.rounds()):
            ups = r.nodes().select("id", F.explode("up").alias("u")).select(F.col("id").alias("descendant"), F.col("u.p").alias("p"), F.col("u.lo").alias("way"))
            near = ups.select(F.col("p").alias("id"), "descendant", F.col("way").alias("distance"))
            if pairs is not None:
                above = pairs.select("id", F.col("descendant").alias("p"), "distance")
                near = near.unionByName(ups.join(above, "p").select("id", "descendant", (F.col("way") + F.col("distance")).alias("distance")))
            new = self.work.keep(near.groupBy("id", "descendant").agg(F.min("distance").alias("distance")), "above")
            pairs = new if pairs is None else pairs.unionByName(new)
            if r.chain is not None:
                down = r.chain.select("id", "child", "below")
                further = down.join(pairs.select(F.col("id").alias("child"), "descendant", "distance"), "child").select("id", "descendant", (F.col("below") + F.col("distance")).alias("distance"))
                pairs = pairs.unionByName(self.work.keep(further.unionByName(down.select("id", F.col("child").alias("descendant"), F.col("below").alias("distance"))), "below"))
        return self.nodes.sparkSession.createDataFrame([], "id string, descendant string, distance bigint") if pairs is None else pairs

    def summary(self) -> DataFrame:
        """(id, depth, max_depth, n_paths, roots, on_cycle, under_cycle, n_descendants, missing): one row per node.

        depth is the length of the shortest path, max_depth that of the longest; n_paths is null beyond 2**63 - 1. roots is sorted
        and holds cycle nodes where a path starts at one; under_cycle tells that it does.
        """
        cyclic = self.cyclic.select("id", F.lit(True).alias("on_cycle"))
        heads = self.cyclic.select(F.col("id").alias("root"), F.lit(True).alias("cyc"))
        per = self.reach().join(heads, "root", "left").groupBy("id").agg(
            F.min("lo").alias("depth"), F.max("hi").alias("max_depth"), F.when(F.count("n") == F.count("*"), F.try_sum("n")).alias("n_paths"),
            F.array_sort(F.collect_list("root")).alias("roots"), F.coalesce(F.bool_or("cyc"), F.lit(False)).alias("headed"),
        )
        below = self.descendants().groupBy("id").agg(F.count("*").alias("n_descendants"))
        out = self.nodes.select("id", "missing").join(per, "id", "left").join(cyclic, "id", "left").join(below, "id", "left")
        on = F.coalesce("on_cycle", F.lit(False))
        return out.select("id", "depth", "max_depth", "n_paths", "roots", on.alias("on_cycle"), (F.col("headed") & ~on).alias("under_cycle"), F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"), "missing")


def hierarchy(df: DataFrame, node: str, parents: str) -> Hierarchy:
    """Finds the cycles of the graph that `parents` (array of ids) spans over the unique, non-null ids in `node`; the rest is contracted when asked for.

    A node named among its own parents lies on a cycle. An empty table gives empty results. Other columns are ignored.
    """
    work = Workspace(df.sparkSession, "hierarchy")
    nodes = work.keep(links(df, node, parents), "nodes")
    return Hierarchy(nodes, cycle_nodes(nodes.select(F.col("id").alias("a"), F.explode("up.p").alias("b")), work), work)
