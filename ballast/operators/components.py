"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edge table; the number of rounds
is logarithmic in the size of the graph. Labels and edges never leave the executors; the driver only learns whether
a round has left anything to do. Wide keys go through the rounds as longs (:func:`numbered_components`), and links that are added to a known
result are a graph of its components alone (:func:`extended_components`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.durable import apart, cut

_SEEDS = range(1, 9)


def _star(links: DataFrame, keep) -> DataFrame:
    """Links each ``b`` beside ``a`` that ``keep`` allows to the least key near ``a``."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return links.join(apart(least, "a"), "a").where(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _stars(links: DataFrame) -> bool:
    """Whether each ``a`` has one link, to a ``b`` that has none itself: then all that is left to do is done."""
    sides = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    seen = links.select(sides.alias("s")).groupBy("s.node").agg(F.sum("s.up").alias("up"), F.max("s.down").alias("down"))
    return seen.where("up + down > 1 and up > 0").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge table; root is the least node.

    Null ends, self links and repeated links are allowed: a row with a null end is
    ignored, a self link makes its node a component of its own. Any orderable type works.
    No rows give no rows.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs = cut(raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    lone = pairs.where("a = b").select("a").distinct()
    links = pairs.where("a <> b")
    for _ in range(max_rounds):
        if _stars(links):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("b") > F.col("a")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(apart(least, "a"), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = cut(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("a")).distinct().withColumn("b", F.col("a"))
    rest = lone.withColumn("b", F.col("a"))
    known = links.unionByName(roots).unionByName(rest)
    return known.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def numbered_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """As :func:`connected_components`, for wide keys: the rounds shuffle 64-bit numbers of them.

    A key's number is its hash, so no join deals numbers out; should two keys of a graph share one, all are hashed anew with another seed.
    """
    raw = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"))
    ends = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    for seed in _SEEDS:
        number = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        book = cut(ends.select(number("node").alias("id"), "node"))
        if book.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("keys share their numbers under every seed")
    roots = connected_components(raw.select(number("a").alias("a"), number("b").alias("b")), "a", "b", max_rounds)
    named = cut(book.join(roots, book["id"] == roots["node"]).select(book["node"], roots["root"].alias("c")))
    least = named.groupBy("c").agg(F.min("node").alias("root"))
    return named.join(apart(least, "c"), "c").select("node", "root")


def extended_components(known: DataFrame, edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` of a known result ``(node, root)`` and further edges, as if all edges had been given at once.

    The new edges are drawn between the roots of their ends, so the rounds see a graph of the touched components, whatever the size of
    the known ones; those are joined once.
    """
    new = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    ends = new.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    seen = cut(ends.join(known, "node", "left").select("node", F.col("root").isNull().alias("fresh"), F.coalesce("root", "node").alias("root")))
    rooted = lambda side: seen.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    between = new.join(apart(rooted("a"), "a"), "a").join(apart(rooted("b"), "b"), "b").select("root_a", "root_b")
    moved = cut(numbered_components(between, "root_a", "root_b", max_rounds).select(F.col("node").alias("root"), F.col("root").alias("to")))
    nodes = known.select("node", "root").unionByName(seen.where("fresh").select("node", "root"))
    return nodes.join(apart(moved, "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
