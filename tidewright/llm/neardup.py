"""Exact linking of near-equal sets: band collisions propose, full sets decide, and connected components are found by contraction.

Nothing here gathers a group of copies in one task or on the driver: equal sets are one node, large buckets are worked off by rounds of pivots, and
joins on a hot bucket or node are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, fits, maybe_broadcast, table


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of undirected edges (a, b): comp is the smallest node of its component.

    Every round hooks each node to the neighbour that comes first in a random order and contracts; a path or a star shrinks by a constant factor. The hooks of
    the rounds are put together from the last, smallest one back, so that a node is looked up once and not in every round.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = table(edges.where("a != b").select("a", "b"), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(key("b")).alias("m")).select("a", F.least(key("a"), F.col("m"))["v"].alias("m"))
        hook = table(near, "hooks")
        hook_a, hook_b = hook.select("a", F.col("m").alias("x")), hook.select(F.col("a").alias("b"), F.col("m").alias("y"))
        left = edges.join(hook_a, "a").join(hook_b, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        hooks.append(hook)
        old, edges = edges, table(left, "edges")
        drop(old)
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    found: DataFrame | None = None
    for hook in reversed(hooks):
        roots = hook.select(F.col("a").alias("node"), F.col("m").alias("root"))
        if found is not None:
            up = found.select(F.col("node").alias("root"), F.col("root").alias("up"))
            roots = table(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
            drop(found)
        found = roots
    least = found.groupBy("root").agg(F.min("node").alias("comp"))
    out = table(found.join(least, "root").select("node", "comp"), "components")
    drop(edges, found, *hooks)
    return out


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp), a former result of components, with further links (a, b): only these are worked off, between components."""
    of = lambda c, x: comps.select(F.col("node").alias(c), F.col("comp").alias(x))
    ends = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    step = components(ends.where("a != b").distinct())
    moved = comps.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = step.join(comps, "node", "left_anti").select("node", "comp")
    out = table(moved.union(fresh), "components")
    drop(comps, step)
    return out


def link(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, small: int = 8, done: Callable[[], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links of classes (node, bands: array<long>) whose sets have 100 * intersection >= percent * union, and their components.

    If classes have the column owner, rows may repeat a node, only buckets of several owners are looked at, and bands may be dealt over columns whose names begin so. done is called when classes are read no more. sets_of(nodes) gives (node, items: array<long>, distinct) for a frame of nodes. Returns links (a, b) between different nodes that settle all
    components, and (node, comp) for the nodes in them. No pair that shares a bucket and could join two components goes unexamined:

    1. The pivot of a bucket, its member with the most company in all its buckets, is compared with all others.
    2. Buckets of at most `small` members that aren't one component yet are compared in full.
    3. In larger ones, let B be the pivot's set and p the percentage. Two sets d and e are near only if they share at least
       o = p * (|d| + |e|) / (100 + p) items. At most min(|d & B|, |e & B|) of these lie in B, so q = o - min(...) at least lie outside.
       Where q can be below 1, d and e are compared at once (_inside). For the others the prefix principle holds: of the items outside B, ordered by how
       often they occur among the pivot's members, rarest first, d and e have one in common among all but the last q - 1 of either. These items are the
       buckets of what remains (_outside), which is worked off by rounds of pivots.
    4. At the first item that d and e have in common, all other common ones come later in both orders. With cap the number of items from there on,
       min(cap_d, cap_e) + min(|d & B|, |e & B|) >= o must hold; pairs for which it doesn't are left out (_possible).
    """
    member = _members(classes)
    if done is not None:
        done()
    sets = table(sets_of(member.select("node").distinct()).withColumn("size", F.size("items")), "sets")
    company = member.groupBy("node").agg(F.sum("n").alias("company"))
    pivot = member.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node"))["node"].alias("pivot"))
    member = table(member.join(pivot, "bucket").where("node != pivot"), "members")
    near = table(compared(member.select(F.col("pivot").alias("a"), F.col("node").alias("b")), sets), "compared")
    links, comps = _more(None, None, near, percent)

    left = table(_mixed(member.where("n > 2"), comps), "left")
    few = left.where(F.col("n") <= small)
    pairs = _across(few, few)
    many = table(left.where(F.col("n") > small).select(F.col("pivot").alias("a"), F.col("node").alias("b"), "comp").distinct().join(near, ["a", "b"]), "many")
    if many.isEmpty():
        return _more(links, comps, compared(pairs, sets), percent)
    least = many.groupBy("a").agg(F.min("size_b").alias("least"))
    need = F.ceil((F.col("size_b") + F.greatest("least", F.ceil(F.col("size_b") * percent / 100))) * percent / (100 + percent)) - F.col("both")
    many = many.join(least, "a").withColumn("need", F.greatest(need, F.lit(1))).withColumn("blunt", (need < 1) & ~_near(percent))
    inside = _inside(many, percent)
    links, comps = _more(links, comps, compared(pairs.union(inside), sets), percent)
    member = _outside(many, sets)
    pivots = small
    while True:
        left = table(_mixed(member, comps), "left")
        if left.isEmpty():
            return links, comps
        first = left.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy("node"))).where(f"k <= {pivots}").drop("k")
        first = table(first, "pivots")
        links, comps = _more(links, comps, compared(_possible(first, left, percent), sets), percent)
        member = left.drop("comp").join(first.select("bucket", "node"), ["bucket", "node"], "left_anti")
        pivots *= 4


def _inside(many: DataFrame, percent: int) -> DataFrame:
    """The pairs of members of one pivot that may be near without sharing anything outside it: they are few, as one set must be near the pivot's size."""
    far = many.where("blunt").select("a", F.col("b").alias("d"), F.col("size_b").alias("size_d"), F.col("comp").alias("comp_d"), F.col("both").alias("both_d"))
    enough = f"* {100 + percent} >= {percent} * (size_d + size_b)"
    may = f"comp != comp_d and least(both_d, both) {enough} and 100 * size_b >= {percent} * size_d and (least(both_d, both) + least(size_d - both_d, size_b - both)) {enough}"
    return far.join(many, "a").where(may).select(F.least("d", "b").alias("a"), F.greatest("d", "b").alias("b"))


def _outside(many: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, node, n, size, both, cap): for each member of a pivot the rare items outside it that any near partner must share one of."""
    many = table(many, "many")
    sets = _in_pairs(sets, many)
    of_a, of_b = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("node").alias("b"), "items")
    outside = many.select("a", "b", "need", "both", F.col("size_b").alias("size")).join(of_a, "a").join(of_b, "b")
    outside = outside.select("a", "b", "both", "size", F.array_except("items", "items_a").alias("rest"), "need")
    outside = outside.where(F.size("rest") >= F.col("need"))
    outside = outside.select("a", "b", "both", "size", F.explode("rest").alias("item"), F.size("rest").alias("n_rest"), (F.size("rest") - F.col("need") + 1).alias("prefix"))
    outside = table(outside, "outside")
    often = outside.groupBy("a", "item").agg(F.count("*").alias("often")).where("often > 1")  # items of one member come first in the order, and lead nowhere
    both = outside.join(often, ["a", "item"])
    order = W.partitionBy("a", "b").orderBy("often", "item")
    ranked = both.withColumn("k", F.col("n_rest") - F.count("*").over(W.partitionBy("a", "b")) + F.row_number().over(order)).where("k <= prefix")
    again = ranked.select(F.col("b").alias("node"), F.xxhash64("a", "item").alias("bucket"), "size", "both", (F.col("n_rest") - F.col("k") + 1).alias("cap"))
    again = table(again, "again")
    return again.join(maybe_broadcast(table(_shared(again), "shared")), "bucket")


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, node, n): the members of buckets of at least two nodes (and two owners, if classes have them), with how many they are."""
    if "owner" not in classes.columns:
        buckets = classes.select("node", F.explode("bands").alias("bucket"))
        return table(buckets.join(maybe_broadcast(table(_shared(buckets), "shared")), "bucket"), "members")
    # 32 bits are enough to tell two nodes or owners of a bucket apart (owners below 2**32 always); where all are alike, the bits set in one and in all are the same
    owner = F.col("owner").bitwiseXOR(F.shiftright("owner", 32) * 0x9E3779B1)
    who = F.shiftleft(owner, 32).bitwiseOR(F.col("node").bitwiseAND(0xFFFFFFFF))
    parts = []
    for bands in (c for c in classes.columns if c.startswith("bands")):  # one after the other, as each shuffle's files go before the next
        buckets = classes.select("node", who.alias("who"), F.explode(bands).alias("bucket"))
        seen = buckets.groupBy("bucket").agg(F.bit_or("who").bitwiseXOR(F.bit_and("who")).alias("apart"))
        shared = seen.where((F.col("apart").bitwiseAND(0xFFFFFFFF) != 0) & (F.shiftrightunsigned("apart", 32) != 0)).select("bucket")
        shared = maybe_broadcast(table(shared, "shared"))
        parts.append(table(buckets.select("node", "bucket").join(shared, "bucket", "left_semi").distinct(), "members"))
    member = reduce(DataFrame.union, parts)
    return table(member.join(_shared(member), "bucket"), "members")


def _shared(buckets: DataFrame) -> DataFrame:
    """The buckets of at least two members, with their number."""
    return buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")


def _mixed(member: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of buckets that aren't in one component, with their component."""
    named = member.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return named.join(mixed, "bucket")


def _across(some: DataFrame, others: DataFrame) -> DataFrame:
    """The pairs of a bucket, one of some and one of others, that lie in different components."""
    left = some.select("bucket", F.col("node").alias("x"), F.col("comp").alias("comp_x"))
    right = others.select("bucket", F.col("node").alias("y"), F.col("comp").alias("comp_y"))
    return left.join(right, "bucket").where("comp_x != comp_y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _possible(some: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """The pairs of _across that sizes and the places of the shared item leave possible."""
    of = lambda df, x: df.select("bucket", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("comp", "size", "both", "cap")])
    sizes = f"100 * least(size_x, size_y) >= {percent} * greatest(size_x, size_y)"
    shares = f"(least(both_x, both_y) + least(cap_x, cap_y)) * {100 + percent} >= {percent} * (size_x + size_y)"
    return of(some, "x").join(of(others, "y"), "bucket").where(f"comp_x != comp_y and {sizes} and {shares}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _near(percent: int):
    return F.col("both") * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))


def _more(links: DataFrame | None, comps: DataFrame | None, near: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The links with those of compared pairs, and the components if there are new ones."""
    new = table(near.where(_near(percent)).select("a", "b"), "near")
    if links is None or comps is None:
        return new, components(new)
    if new.isEmpty():
        return links, comps
    return links.union(new), joined(comps, new)


def _in_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the nodes in pairs (a, b), or all if these nodes are too many to be broadcast."""
    nodes = table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    return sets.join(F.broadcast(nodes), "node", "left_semi") if fits(nodes) else sets


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) with the sizes of their sets (size_a, size_b) and of what they share (both).

    Sets are shuffled only where they are in a pair, unless the nodes in pairs are too many to be broadcast.
    """
    pairs = table(pairs.distinct(), "pairs")
    sets = _in_pairs(sets, pairs)
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"), F.col("size").alias("size_a"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"), F.col("size").alias("size_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("both"))
