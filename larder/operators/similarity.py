"""Collaborative filtering: Swing, cosine and Jaccard similarity, top-k and candidates.

Pairs arise only through a shared element (an equi-join), each unordered pair
once; sums are combined map-side and mirrored after the aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.session import shuffle_width

ALPHA1, ALPHA2, BETA = 5.0, 1.0, 0.3


#: Rows of one shared element that meet as one block; longer lists are split into blocks.
BLOCK = 1024


def _met(left: DataFrame, right: DataFrame, shared: str) -> DataFrame:
    """``left`` (with a) joined to ``right`` (with b) on the shared element.

    The list of an element with more than ``BLOCK`` rows is split on both sides by a hash of a and b, and every pair
    of blocks is a key of its own, so a long history or a hot item is spread over tasks. The number of partitions is
    fixed: pairs are many more than rows, so partitions must not be coalesced by the size of their input.
    """
    blocks = right.groupBy(shared).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    x = left.join(blocks, shared).withColumn("at_a", own("a")).withColumn("at_b", each).drop("blocks")
    y = right.join(blocks, shared).withColumn("at_b", own("b")).withColumn("at_a", each).drop("blocks")
    key = [shared, "at_a", "at_b"]
    width = shuffle_width(left.sparkSession)
    return x.repartition(width, *key).join(y.repartition(width, *key), key)


def degrees(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(key).agg(F.count(F.lit(1)).alias("deg"))


def swing(edges: DataFrame, entity: str, shared: str, queries: DataFrame | None = None, alpha1: float = ALPHA1, alpha2: float = ALPHA2, beta: float = BETA) -> DataFrame:
    """(a, b, sim) of entities by the elements they share; ``edges`` holds distinct (entity, shared).

    A shared element counts 1 / (its degree + alpha2), a pair is scaled by
    ((deg a + alpha1) (deg b + alpha1)) ** -beta. With ``queries`` (a column
    ``entity``) only their pairs are made, against all entities; else all pairs.
    Both directions are returned.
    """
    pop = degrees(edges, shared).select(shared, (1.0 / (F.col("deg") + alpha2)).alias("w"))
    weighted = edges.join(pop, shared)
    size = degrees(edges, entity).select(entity, F.pow(F.col("deg") + alpha1, F.lit(-beta)).alias("s"))
    left = weighted.select(F.col(entity).alias("a"), shared, "w")
    right = edges.select(F.col(entity).alias("b"), shared)
    if queries is None:
        raw = _met(left, right, shared).filter("a < b").groupBy("a", "b").agg(F.sum("w").alias("raw"))
    else:
        own = weighted.join(queries.select(entity), entity, "left_semi").select(F.col(entity).alias("a"), shared, "w")
        raw = _met(own, right, shared).filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("raw"))
    scaled = raw.join(size.select(F.col(entity).alias("a"), F.col("s").alias("sa")), "a").join(size.select(F.col(entity).alias("b"), F.col("s").alias("sb")), "b").select("a", "b", (F.col("raw") * F.col("sa") * F.col("sb")).alias("sim"))
    return scaled if queries is not None else mirrored(scaled)


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both directions of unordered pairs, from one pass over them."""
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return pairs.withColumn("p", both).select(F.col("p.x").alias("a"), F.col("p.y").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")])


def cosine(counts: DataFrame, entity: str, shared: str, queries: DataFrame) -> DataFrame:
    """(a, b, sim) of count vectors; ``counts`` holds (entity, shared, n)."""
    norm = counts.groupBy(entity).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    left = counts.join(queries.select(entity), entity, "left_semi").select(F.col(entity).alias("a"), shared, F.col("n").alias("na"))
    dots = _met(left, counts.select(F.col(entity).alias("b"), shared, F.col("n").alias("nb")), shared).filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    return dots.join(norm.select(F.col(entity).alias("a"), F.col("norm").alias("x")), "a").join(norm.select(F.col(entity).alias("b"), F.col("norm").alias("y")), "b").select("a", "b", (F.col("dot") / (F.col("x") * F.col("y"))).alias("sim"))


def jaccard(edges: DataFrame, entity: str, shared: str, queries: DataFrame) -> DataFrame:
    """(a, b, sim) of sets; ``edges`` holds distinct (entity, shared)."""
    deg = degrees(edges, entity)
    left = edges.join(queries.select(entity), entity, "left_semi").select(F.col(entity).alias("a"), shared)
    both = _met(left, edges.select(F.col(entity).alias("b"), shared), shared).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    out = both.join(deg.select(F.col(entity).alias("a"), F.col("deg").alias("x")), "a").join(deg.select(F.col(entity).alias("b"), F.col("deg").alias("y")), "b")
    return out.select("a", "b", (F.col("n") / (F.col("x") + F.col("y") - F.col("n"))).alias("sim"))


def top_similar(pairs: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k nearest of each a, with rank; only pairs that share something (similarity above 0) exist at all."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("sim", 12)), "b"))
    return pairs.filter(F.col("sim") >= least).withColumn("rank", rank).filter(F.col("rank") <= k)


def history_candidates(seen: DataFrame, similar: DataFrame, per_seed: int, most: int) -> DataFrame:
    """Candidates of each customer from the items of their history: per seed the nearest ``per_seed``, nothing
    already seen, the best score of an item over its seeds, at most ``most``.

    ``seen`` holds distinct (customer_id, item), ``similar`` (a, b, sim) of items.
    """
    # A seed's nearest unseen items stand among its first per_seed + |history| neighbours; an item is kept that far for
    # the longest history it is part of, so one long history widens its own items only.
    size = seen.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_seen"))
    sized = seen.join(size, "customer_id")
    reach = sized.groupBy(F.col("item").alias("a")).agg(F.max("n_seen").alias("reach"))
    by_rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("sim", 12)), "b"))
    first = similar.join(reach, "a").withColumn("at", by_rank).filter(F.col("at") <= F.col("reach") + per_seed)
    near = sized.join(first, (sized["item"] == first["a"]) & (first["at"] <= sized["n_seen"] + per_seed)).select("customer_id", "a", "b", "sim")
    fresh = near.join(seen.select("customer_id", F.col("item").alias("b")), ["customer_id", "b"], "left_anti")
    seed = Window.partitionBy("customer_id", "a").orderBy(F.desc(F.round("sim", 12)), "b")
    best = fresh.withColumn("rn", F.row_number().over(seed)).filter(F.col("rn") <= per_seed).groupBy("customer_id", "b").agg(F.max("sim").alias("score"))
    rank = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc(F.round("score", 12)), "b"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).withColumnRenamed("b", "item")
