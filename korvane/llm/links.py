"""Clusters of linked nodes from candidate buckets, without the pairs of a bucket.

Rows ``(bucket, node, size, full, level)`` say which nodes a bucket holds. A row with ``full`` is
one that others may meet there, one with ``level`` above 0 looks for partners: at level 1 it meets
the full rows if it is full itself, at level 2 also those that are not. One or two stars per
bucket connect nearly all that belongs together; then only pairs of *different* components that still
share a bucket matter, and none of those that may link is left out, so the components are exact
whatever the stars found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from korvane.session import materialize, release


#: Rows of a bucket up to which its pairs cost less than setting its nodes apart; both ways are exact.
SMALL = 32


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in ``edges`` (a, b), by contraction.

    Each round every node moves to the node with the smallest hash within two steps and the edges
    follow, so a star takes one round and a path of n nodes about log n. The label is a node.
    """
    live = materialize(edges.filter("a <> b").distinct(), "edges")
    labels = materialize(live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
                         .withColumn("comp", F.col("node")), "labels")
    step = 0
    while not live.isEmpty():
        step += 1
        both = live.union(live.select("b", "a"))
        nodes = both.union(both.select("a", F.col("a").alias("b")))
        near = materialize(
            nodes.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(step), "b").alias("h"),
                                                  F.col("b").alias("n"))).alias("near")), "near")
        move = materialize(
            nodes.join(near.select(F.col("a").alias("b"), "near"), "b").groupBy("a")
            .agg(F.min("near").alias("near")).select("a", F.col("near.n").alias("to")), "move")
        live = materialize(
            live.join(move, "a").select(F.col("to").alias("x"), "b")
            .join(move.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"),
                                                                F.col("to").alias("b"))
            .filter("a <> b").distinct(), "edges")
        labels = materialize(
            labels.join(move.withColumnRenamed("a", "comp"), "comp", "left")
            .select("node", F.coalesce("to", "comp").alias("comp")), "labels")
    return labels


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _mixed(rows: DataFrame, seed: int) -> DataFrame:
    """Buckets that hold several components, each with its centre of this round."""
    centre = F.min(F.when(F.col("full"), F.struct(
        F.xxhash64(F.lit(seed), "node").alias("h"), F.col("node").alias("centre"),
        F.col("comp").alias("centre_comp"), F.col("size").alias("centre_size"))))
    return rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                      centre.alias("c"), F.max("level").alias("level"),
                                      F.count("node").alias("held")) \
        .filter((F.col("lo") != F.col("hi")) & F.col("c").isNotNull() & (F.col("level") > 0)) \
        .select("bucket", "held", "c.*")


def _hubs(crowded: DataFrame) -> DataFrame:
    """The rows of ``crowded`` with their bucket's centre moved to its hub.

    Buckets of one family of texts hold different nodes of it, so each has another centre and a node
    meets as many centres as the family has buckets. Any node serves as a centre: the hub is the
    bucket's node that already is the centre of the most nodes, so overlapping buckets choose the same.
    """
    reach = materialize(crowded.select("centre", "node").distinct().groupBy("centre")
                        .agg(F.count("node").alias("reach")), "reach").withColumnRenamed("centre", "node")
    hub = F.max(F.struct(F.coalesce("reach", F.lit(0)).alias("reach"), F.xxhash64("node").alias("h"),
                         F.col("node").alias("centre"), F.col("size").alias("centre_size"))).alias("hub")
    hub = materialize(crowded.join(reach, "node", "left").groupBy("bucket").agg(hub)
                      .select("bucket", "hub.centre", "hub.centre_size"), "hubs")
    return crowded.drop("centre", "centre_size").join(hub, "bucket")


def cluster(rows: DataFrame, test: Callable[[DataFrame], DataFrame],
            sizes: Callable[[Column, Column], Column], stars: int = 2,
            narrow: Callable[[DataFrame], DataFrame] | None = None, hubs: bool = False) -> DataFrame:
    """(node, comp) of all nodes with a link; ``test`` keeps the linked pairs of (a, b). ``rows`` are
    read several times, so they should be a written step.

    ``sizes(large, small)`` says whether nodes of these sizes can link at all. ``narrow`` takes
    the nodes that share undecided buckets of more than ``SMALL`` rows with a centre (centre, centre_size, node, comp, size) and gives all
    pairs (a, b) of different components among each centre's nodes that may link; without it
    these are the pairs of the bucket rows. With ``hubs`` buckets that overlap share a centre, so that
    a node has few of them.
    """
    labels, linked = None, None

    def fits(x, y):
        return sizes(F.greatest(x, y), F.least(x, y))

    def absorb(pairs):
        nonlocal labels, linked
        good = materialize(test(materialize(pairs.distinct(), "pairs")).select("a", "b"), "linked")
        linked = good if linked is None else linked.union(good)
        labels = components(linked)
        release(rows.sparkSession)

    for seed in range(stars):
        now = _labelled(rows, labels)
        mixed = materialize(_mixed(now, seed), "mixed")
        pairs = (now.filter("level > 0").join(mixed, "bucket")
                 .filter((F.col("comp") != F.col("centre_comp"))
                         & fits(F.col("size"), F.col("centre_size"))))
        absorb(pairs.select(F.least("node", "centre").alias("a"),
                            F.greatest("node", "centre").alias("b")))
    now = _labelled(rows, labels)
    mixed = materialize(_mixed(now, -1), "mixed")
    undecided = materialize(now.join(mixed.select("bucket", "held", "centre", "centre_size"), "bucket"),
                            "left")
    left = undecided if narrow is None else undecided.filter(F.col("held") <= SMALL)
    one, two = left.filter("level > 0").alias("one"), left.alias("two")
    meets = (F.col("two.full") & (F.col("one.full") | (F.col("one.level") > 1))) \
        | (F.col("one.full") & (F.col("one.level") > 1))
    pairs = one.join(two, (F.col("one.bucket") == F.col("two.bucket"))
                     & (F.col("one.comp") != F.col("two.comp")) & meets
                     & (F.col("one.size") >= F.col("two.size"))
                     & sizes(F.col("one.size"), F.col("two.size")))
    pairs = pairs.select(F.least("one.node", "two.node").alias("a"),
                         F.greatest("one.node", "two.node").alias("b"))
    if narrow is not None:
        crowded = undecided.filter(F.col("held") > SMALL) \
            .select("bucket", "centre", "centre_size", "node", "comp", "size")
        members = _hubs(crowded) if hubs else crowded
        pairs = pairs.union(narrow(materialize(members.drop("bucket").distinct(), "members")))
    absorb(pairs)
    return labels


def near_pairs(members: DataFrame, elements: DataFrame, differ: Callable[[Column, Column], Column],
               sizes: Callable[[Column, Column], Column], sure: bool) -> DataFrame:
    """Pairs among a centre's nodes that may link, found from what sets them apart from it.

    Nodes are sets (``elements``: node, array), and linked ones differ in at most ``differ`` of
    their sizes elements. With X and Y the differences of two sets to their centre, the sets differ
    in |X| + |Y| - 2 |X and Y in common|, so they must share T = (|X| + |Y| - H) / 2 elements of X
    and Y, and if T > 0 at least one among the rarest |X| - T + 1 and |Y| - T + 1. Thousands of
    variants of one text have their own changes, so they share no such element and meet in no pair.

    ``sure`` says that nodes within ``differ`` of the centre are linked with it. Then a pair of
    different components has a node farther away, and T is above 0. Else the pairs with T up to 0,
    both very close to the centre, are given as well.
    """
    apart = (members.join(elements.toDF("node", "e"), "node")
             .join(elements.toDF("centre", "c"), "centre")
             .select("centre", "centre_size", "node", "comp", "size",
                     F.concat(F.array_except("e", "c"), F.array_except("c", "e")).alias("x")))
    far = F.size("x") > differ(F.col("size"), F.col("centre_size"))
    apart = materialize(apart.withColumns({"n": F.size("x"), "far": far}), "apart")
    direct = apart.filter(~F.col("far") & (F.col("node") != F.col("centre"))) \
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    tokens = apart.select("centre", "node", "comp", "size", "n", "far", F.explode("x").alias("t"))
    rare = materialize(tokens.groupBy("centre", "t").agg(F.count("t").alias("df"))
                       .filter("df > 1"), "token-counts")
    order = W.partitionBy("centre", "node").orderBy(F.coalesce("df", F.lit(1)), "t")
    placed = materialize(
        tokens.join(rare, ["centre", "t"], "left").withColumn("pos", F.row_number().over(order))
        .filter("df > 1"), "tokens")

    def meet(left, right):
        one, two = left.alias("one"), right.alias("two")
        small, large = F.least("one.size", "two.size"), F.greatest("one.size", "two.size")
        spare = F.col("one.n") + F.col("two.n") - differ(F.col("one.size"), F.col("two.size"))
        both = (F.col("one.centre") == F.col("two.centre")) & (F.col("one.comp") != F.col("two.comp")) \
            & sizes(large, small)
        return one, two, both, spare

    def named(pairs):
        return pairs.select(F.least("one.node", "two.node").alias("a"),
                            F.greatest("one.node", "two.node").alias("b"))

    one, two, both, spare = meet(placed.filter("far") if sure else placed, placed)
    share = F.ceil(spare / 2)
    found = direct.union(named(one.join(
        two, both & (F.col("one.t") == F.col("two.t")) & (share > 0)
        & (F.col("one.pos") <= F.col("one.n") - share + 1)
        & (F.col("two.pos") <= F.col("two.n") - share + 1))))
    if not sure:
        close = apart.select("centre", "node", "comp", "size", "n")
        one, two, both, spare = meet(close, close)
        found = found.union(named(one.join(
            two, both & (F.col("one.node") < F.col("two.node")) & (spare <= 0))))
    return found


def rare_pairs(members: DataFrame, elements: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs of ``members`` (node, comp, size) in different components that may reach Jaccard ``p / q``.

    Each element of a node is one row, however many buckets and centres the node has. Linked sets of
    sizes x and y share S = p (x + y) / (p + q) elements or more. All elements have one order: those that
    only one component has, then by how many nodes have them. The first element that two sets share
    is followed by at least S - 1 more in both, so sets meet by these first ones only. What a
    component has alone counts in its nodes' sizes and needs no row: a node with too much of its own meets
    nobody, and variants of one text, which share most elements, meet by few of them.
    """
    nodes = members.select("node", "comp", "size").distinct()
    tokens = materialize(nodes.join(elements.toDF("node", "e"), "node")
                         .select("node", "comp", "size", F.explode("e").alias("t")), "tokens")
    shared = tokens.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                     F.count("t").alias("df")).filter("lo <> hi").select("t", "df")
    # ``rest``: elements of the node from this one to the last
    order = W.partitionBy("node").orderBy(F.desc("df"), F.desc("t"))
    first = materialize(tokens.join(shared, "t").withColumn("rest", F.row_number().over(order))
                        .filter(q * F.col("rest") >= p * F.col("size"))
                        .select("t", "node", "comp", "size", "rest"), "rare-tokens")
    one, two = first.alias("one"), first.alias("two")
    least = p * (F.col("one.size") + F.col("two.size"))
    return one.join(two, (F.col("one.t") == F.col("two.t")) & (F.col("one.comp") < F.col("two.comp"))
                    & ((p + q) * F.col("one.rest") >= least) & ((p + q) * F.col("two.rest") >= least)) \
        .select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"))
