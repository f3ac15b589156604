"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.lineage import stored

#: Parts that a hub's neighbours are dealt into, so that no task holds all of them.
SALTS = 16
#: Neighbours from which a node is a hub. Links over this are the most hubs there can be, which are broadcast.
HUB = 10_000


def _both(links: DataFrame) -> DataFrame:
    """Each link of links(src, dst) from either end."""
    return links.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))


def _hubs(links: DataFrame, n: int) -> bool:
    """Whether a node of links, of which there are n, has HUB neighbours or more. Where none has, none has more smaller ones after a large star."""
    return 2 * n >= HUB and bool(_both(links).groupBy("src").count().where(F.col("count") >= HUB).limit(1).count())


def _star(links: DataFrame, larger_only: bool, hubs: bool = True) -> DataFrame:
    """Large star: each node's larger neighbours go to its smallest one. Small star: the smaller ones do, and the node. hubs: whether there may be any."""
    if larger_only:
        both = _both(links)
    else:
        both = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    if not hubs:
        linked = both.withColumn("low", F.least(F.min("dst").over(Window.partitionBy("src")), F.col("src")))
        if larger_only:
            # the small star that follows makes links distinct
            return linked.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        out = linked.select(F.inline(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct("src", F.col("low").alias("dst")))))
        return out.where(F.col("src") != F.col("dst")).distinct()
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"), F.count("*").alias("n"))
    # only a hub has a row per part: a row per part of every node would be most of what is shuffled
    large = low.where(F.col("n") >= HUB).select(F.col("src").alias("hub"))
    dealt = both.join(F.broadcast(large), F.col("src") == F.col("hub"), "left").withColumn("salt", F.when(F.col("hub").isNotNull(), F.pmod(F.hash("dst"), F.lit(SALTS))).otherwise(0)).drop("hub")
    salted = low.select("src", "low", F.explode(F.sequence(F.lit(0), F.when(F.col("n") >= HUB, SALTS - 1).otherwise(0))).alias("salt"))
    linked = dealt.join(salted, ["src", "salt"])
    if larger_only:
        out = linked.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = linked.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(low.select("src", F.col("low").alias("dst")))
    return out.where(F.col("src") != F.col("dst")).distinct()


def _written(links: DataFrame) -> tuple[DataFrame, tuple[int, int | None]]:
    """links as a stored table, and its count and hash sum, taken as it is written."""
    state = Observation()
    kept = stored(links.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("hashes")))
    return kept, (state.get["n"], state.get["hashes"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(src, dst): root is the smallest node that it reaches.

    Each round does a large-star and a small-star step, so rounds grow with the logarithm of the
    longest path. Self links and repeated links change nothing; an empty table gives an empty one.
    The loop ends when a round leaves the link table as it was (equal counts and hash sums). Each job of
    a round costs the driver memory, so a round without hubs is one window per star.
    """
    links, state = _written(links.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    seen = None
    while state != seen and state[0]:
        seen, hubs = state, _hubs(links, state[0])
        links, state = _written(_star(_star(links, True, hubs), False, hubs))
    rooted = links.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return rooted.union(rooted.select(F.col("root"), F.col("root"))).distinct()
