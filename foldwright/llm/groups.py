"""Connected groups of near duplicates from shared keys, without emitting all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.session import cut_lineage

Verify = Callable[[DataFrame], DataFrame]
Near = Callable[[str, str], Column]
#: Nodes of a large group that are compared together.
BLOCK_NODES = 256
#: Rows of links and members that a task takes at least, before there are more tasks.
TASK_ROWS = 50_000


def settled(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """df, checkpointed, in as many partitions as its rows ask for: what follows has no more tasks than that."""
    done = cut_lineage(df)
    return done.coalesce(max(4, -(-done.count() // task_rows)))


def width(df: DataFrame) -> int:
    """Tasks for what is derived from a settled table."""
    return max(4, df.rdd.getNumPartitions())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) of links (a, b): comp is the smallest node that can be reached.

    Alternates the large-star and small-star steps until nothing changes; each step is two shuffles of the links,
    and a hub's rows are only joined with its one minimum, which adaptive execution splits when they are many.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        few = width(edges)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(few).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few)
        small = large.coalesce(few).join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(few).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def shared_keys(members: DataFrame, near: Near | None = None) -> DataFrame:
    """The rows (key, node, ...) that share their key with another row, one that is near if that is given.

    (key, node) are distinct. With near, a row looks for its first near one; no pairs are made.
    """
    if near:
        test = (F.col("l.key") == F.col("r.key")) & (F.col("l.node") != F.col("r.node")) & near("l", "r")
        return settled(members.alias("l").join(members.alias("r"), test, "left_semi"))
    many = members.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    return settled(members.join(many, "key"))


def _with_blocks(members: DataFrame) -> DataFrame:
    """members with a block of about BLOCK_NODES nodes for each node, nodes of a group together where they fit.

    A node's group is the smallest leader of its keys; small groups share blocks, large ones are cut into several.
    """
    few = width(members)
    lead = members.groupBy("key").agg(F.min("node").alias("lead")).coalesce(few)
    nodes = settled(members.select("key", "node").join(lead, "key").coalesce(few).groupBy("node").agg(F.min("lead").alias("lead")))
    blocks = max(1, nodes.count() // BLOCK_NODES)
    sizes = nodes.groupBy("lead").agg(F.count("*").alias("size")).coalesce(few)
    own = F.xxhash64("lead", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_NODES)))
    block = F.when(F.col("size") > BLOCK_NODES, own).otherwise(F.pmod(F.xxhash64("lead"), F.lit(blocks)))
    return settled(members.join(nodes.join(sizes, "lead").coalesce(few).select("node", block.alias("block")), "node"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b, block_a, block_b) with a < b."""
    one, two = F.struct(F.col("a").alias("n"), F.col("block_a").alias("k")), F.struct(F.col("b").alias("n"), F.col("block_b").alias("k"))
    low, high = F.least(one, two), F.greatest(one, two)
    return pairs.select(low["n"].alias("a"), high["n"].alias("b"), low["k"].alias("block_a"), high["k"].alias("block_b")).distinct()


def block_nodes(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (block_a, block_b, node): for each pair of blocks that share a key, the nodes of the one and of the
    other that have such a key. A group of n nodes is in n / BLOCK_NODES blocks, so it makes few pairs of them."""
    few = width(live)
    spots = live.select("key", "block").distinct().coalesce(few)
    test = (F.col("l.key") == F.col("r.key")) & (F.col("l.block") <= F.col("r.block"))
    pairs = spots.alias("l").join(spots.alias("r"), test).select("l.key", F.col("l.block").alias("block_a"), F.col("r.block").alias("block_b"))
    # a pair of a block with itself is of use only if the key has several of its nodes
    many = live.groupBy("key", "block").agg(F.count("*").alias("nodes")).where("nodes > 1").select("key", F.col("block").alias("block_a"))
    twice = pairs.where("block_a = block_b").join(many, ["key", "block_a"]).select("key", "block_a", "block_b")
    pairs = settled(pairs.where("block_a < block_b").union(twice))
    sides = []
    for side in ("block_a", "block_b"):
        at = live.select("key", "node", F.col("block").alias(side)).join(pairs, ["key", side])
        sides.append(settled(at.select("block_a", "block_b", "node").distinct()))
    return sides[0], sides[1]


def link_groups(
    members: DataFrame, verify: Verify, near: Near | None = None, search: Callable[[DataFrame], DataFrame] | None = None, leader_rounds: int = 2
) -> DataFrame:
    """(node, comp) for every node with a verified link to another.

    members: (key, node, and the columns that ``near`` reads), as shared_keys gives them: nodes that share a key may
    be linked. verify gets pairs (a, b, block_a, block_b) and gives the links among them as (a, b). near(left, right),
    if given, is a cheap necessary condition on the columns of two members, tested inside the joins that make pairs.
    search, if given, takes the members (key, node, block, comp, ...) and gives the links (a, b) between components
    in any other way than by pairs; it does the last round.

    A group of n copies would give n * n pairs. So each key first links its members to one leader. As long as a
    key holds nodes of several components, the node with most links of its largest component leads next; at last all
    pairs of nodes of different components that share a key are checked, so that no link which would join two
    groups is missed, whatever the leaders were.
    """
    links = None
    comps = None
    tried = None
    live = _with_blocks(members).withColumn("comp", F.col("node"))
    for turn in range(leader_rounds + 1):
        few = width(live)
        if turn > 0:
            degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "node")
            marks = comps.join(degree, "node").coalesce(few)
            known = live.drop("comp", "degree").join(marks, "node", "left").coalesce(few).withColumn("comp", F.coalesce("comp", "node"))
            mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key").coalesce(few)
            live = settled(known.join(mixed, "key"))
            few = width(live)
            if live.isEmpty():
                break
        test = F.col("l.key") == F.col("r.key")
        if turn < leader_rounds:
            if turn == 0:
                lead = live.groupBy("key").agg(F.min("node").alias("node")).coalesce(few)
            else:
                rank = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64("node", F.lit(turn)).alias("draw"), "node")
                lead = live.groupBy("key", "comp").agg(F.count("*").alias("size"), F.max(rank).alias("best")).coalesce(few)
                lead = lead.groupBy("key").agg(F.max(F.struct("size", "best")).alias("top")).select("key", F.col("top.best.node").alias("node")).coalesce(few)
            left = lead.join(live, ["key", "node"]).coalesce(few).alias("l")
            test = test & (F.col("l.comp") != F.col("r.comp"))
        elif search:
            links = settled(links.union(search(live)).distinct())
            comps = settled(connected_components(links))
            break
        else:
            left, test = live.alias("l"), test & (F.col("l.comp") < F.col("r.comp"))
        pairs = left.join(live.alias("r"), test & near("l", "r") if near else test).coalesce(few)
        pairs = pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.block").alias("block_a"), F.col("r.block").alias("block_b"))
        pairs = _ordered(pairs)
        pairs = settled(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        found = verify(pairs).select("a", "b")
        links = settled(found if links is None else links.union(found).distinct())
        comps = settled(connected_components(links))
    return comps
