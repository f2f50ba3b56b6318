"""Items that occur together, with association scores.

Ordinary baskets are gathered by one map-side combined exchange and their pairs
made inside the row. Baskets with more rows than a bound are never gathered:
their distinct items are cut into chunks and the products of chunk pairs are
spread over tasks. Both kinds of counts meet in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import durable, within

#: Baskets with more rows than this are cut into chunks of about ``CHUNK`` items.
MAX_BASKET, CHUNK = 128, 64
#: Up to so many ids of huge baskets (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 100_000


def _units(items: Column, kind: str) -> Column:
    """All that one basket counts for: itself (a, b null), each item (b null) and each pair a < b."""
    unit = lambda a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    s = F.array_sort(items)
    pairs = F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: unit(x, y))))
    singles = F.transform(s, lambda x: unit(x, none))
    whole = F.array(unit(none, none))
    return F.when(F.size(s) == 0, F.slice(whole, 1, 0)).when(F.size(s) == 1, F.concat(whole, singles)).otherwise(F.concat(whole, singles, pairs))


def pair_counts(rows: DataFrame, basket: str, items: dict[str, str], max_basket: int = MAX_BASKET, chunk: int = CHUNK) -> DataFrame:
    """Counts of distinct baskets: (kind, null, null) of all, (kind, a, null) of an item, (kind, a, b) of a pair."""
    rows = rows.filter(F.col(basket).isNotNull())
    huge = durable(rows.groupBy(F.col(basket).alias("basket")).count().filter(F.col("count") > max_basket).select("basket"))
    some, small = not huge.isEmpty(), within(huge, BROADCAST_IDS)
    narrow = rows.select(F.col(basket).alias("basket"), *[F.col(c).cast("string").alias(f"item_{k}") for k, c in items.items()])
    ids = F.broadcast(huge) if small else huge
    ordinary = narrow.join(ids, "basket", "left_anti") if some else narrow
    sets = ordinary.groupBy("basket").agg(*[F.collect_set(f"item_{k}").alias(k) for k in items])
    by_kind = [_units(F.col(k), k) for k in items]
    units = sets.select(F.explode(F.concat(*by_kind) if len(by_kind) > 1 else by_kind[0]).alias("u")).select("u.*")
    if some:
        units = units.unionByName(_chunked(narrow.join(ids, "basket", "left_semi"), list(items), chunk, small))
    return units.groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _chunked(narrow: DataFrame, kinds: list[str], chunk: int, small: bool) -> DataFrame:
    """The units of huge baskets, by chunk pairs; ``small``: their ids may be broadcast."""
    long = narrow.select("basket", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"item_{k}").alias("item")) for k in kinds])).alias("x")).select("basket", "x.kind", "x.item").filter("item is not null")
    held = durable(long.distinct())
    sizes = held.groupBy("kind", "basket").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("k"))
    placed = held.join(F.broadcast(sizes) if small else sizes, ["kind", "basket"]).withColumn("c", F.pmod(F.xxhash64("item"), F.col("k")).cast("int"))
    spread = placed.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("lo", F.least("c", "d")).withColumn("hi", F.greatest("c", "d"))
    # A block holds the items of two chunks at most; the left side are those of the lower chunk.
    blocks = spread.groupBy("kind", "basket", "lo", "hi").agg(F.collect_list(F.when(F.col("c") == F.col("lo"), F.col("item"))).alias("x"), F.collect_list(F.when(F.col("c") == F.col("hi"), F.col("item"))).alias("y"))
    pairs = blocks.withColumn("i", F.explode("x")).withColumn("j", F.explode("y")).filter("lo < hi or i < j").select("kind", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    none = F.lit(None).cast("string")
    singles = held.select("kind", F.col("item").alias("a"), none.alias("b"))
    whole = sizes.select("kind", none.alias("a"), none.alias("b"))
    return pairs.unionByName(singles).unionByName(whole)


def associations(rows: DataFrame, basket: str, items: dict[str, str], max_basket: int = MAX_BASKET, chunk: int = CHUNK, least: int = 1) -> DataFrame:
    """For each kind and pair of items a < b the shared baskets and their ratio to independent choice.

    ``items`` maps a kind to its column, in canonical form. Columns: kind, item_a,
    item_b, n_ab, n_a, n_b, n, ratio (n_ab * n / (n_a * n_b)), pmi (its base-2
    logarithm) and jaccard. Pairs with fewer than ``least`` shared baskets are left
    out before anything is kept. Counts are of distinct baskets; n counts those with
    at least one item of the kind. Null items count nowhere and rows without a
    basket are left out; repeated rows count once; an empty table gives no rows.
    """
    counts = durable(pair_counts(rows, basket, items, max_basket, chunk).filter(F.col("b").isNull() | (F.col("n") >= least)))
    pairs = counts.filter("b is not null").select("kind", F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("n").alias("n_ab"))
    single = counts.filter("a is not null and b is null")
    total = F.broadcast(counts.filter("a is null").select("kind", F.col("n").alias("n")))  # one row per kind
    out = pairs.join(single.select("kind", F.col("a").alias("item_a"), F.col("n").alias("n_a")), ["kind", "item_a"]).join(single.select("kind", F.col("a").alias("item_b"), F.col("n").alias("n_b")), ["kind", "item_b"]).join(total, "kind")
    ratio = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("kind", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", ratio.alias("ratio"), F.log2(ratio).alias("pmi"), (F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("jaccard"))
