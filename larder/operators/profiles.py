"""Customer and cuisine profiles: distributions, modes, price and loyalty figures.

All functions take item-grain rows with the canonical columns. Each is one or two
map-side combined aggregations on its key; nothing is collected per key but
lists whose length is bounded by a parameter or by the number of categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import scalars
from larder.session import durable

#: Total order of the rows of one order.
ROW_ORDER = ("day_num", "hour", "row_id")


def first_per_order(rows: DataFrame, *columns: str, none: str = "unknown") -> DataFrame:
    """(customer_id, order_id) with the first known value of each column in row order."""
    at = F.struct(*ROW_ORDER)
    known = lambda c: F.when(F.col(c).cast("string") != none, F.col(c))
    return rows.groupBy("customer_id", "order_id").agg(*[F.min_by(known(c), F.when(known(c).isNotNull(), at)).alias(c) for c in columns])


def order_grain(rows: DataFrame) -> DataFrame:
    """The first row of each order of a customer."""
    rest = [c for c in rows.columns if c not in ("customer_id", "order_id")]
    first = rows.groupBy("customer_id", "order_id").agg(F.min_by(F.struct(*rest), F.struct(*ROW_ORDER)).alias("x"))
    return first.select("customer_id", "order_id", "x.*")


def distribution(rows: DataFrame, key: str, category: str) -> DataFrame:
    """Count and share of each category within a key; null categories are left out."""
    n = rows.filter(F.col(category).isNotNull()).groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def top_categories(rows: DataFrame, key: str, category: str, k: int) -> DataFrame:
    """The k most frequent categories of a key, ties by category, with their rank."""
    n = rows.filter(F.col(category).isNotNull()).groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), category))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k)


def price_stats(rows: DataFrame, key: str) -> DataFrame:
    """Mean, sample deviation (0 below two orders), least and largest order total of a key."""
    totals = rows.groupBy(key, "order_id").agg(F.sum("unit_price").alias("total"))
    return totals.groupBy(key).agg(F.avg("total").alias("avg_total"), F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("std_total"), F.min("total").alias("min_total"), F.max("total").alias("max_total"))


def loyalty(rows: DataFrame) -> DataFrame:
    """Orders, vendors per order and items per order of each customer."""
    per_order = rows.groupBy("customer_id", "order_id").agg(F.count(F.lit(1)).alias("items"))
    size = per_order.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_orders"), F.avg("items").alias("basket_size"))
    vendors = rows.select("customer_id", "vendor_id").distinct().groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_vendors"))
    return size.join(vendors, "customer_id").withColumn("vendor_diversity", F.col("n_vendors") / F.col("n_orders"))


def popularity(rows: DataFrame, key: str) -> DataFrame:
    """Orders, customers and orders per customer of a key."""
    n = rows.select(key, "order_id", "customer_id").distinct().groupBy(key).agg(F.countDistinct("order_id").alias("n_orders"), F.countDistinct("customer_id").alias("n_customers"))
    return n.withColumn("orders_per_customer", F.col("n_orders") / F.greatest(F.col("n_customers"), F.lit(1)))


def as_map(shares: DataFrame, key: str, category: str, name: str) -> DataFrame:
    """Shares of a key as one map; categories are few by nature (hours, weekdays, cuisines, chains)."""
    return shares.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(category).alias("key"), F.col("share").alias("value"))))).alias(name))


def _listed(top: DataFrame, key: str, category: Column, name: str) -> DataFrame:
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", category.alias("c")))), lambda x: x["c"]).alias(name))


def customer_profiles(rows: DataFrame, max_history: int = 50) -> DataFrame:
    """One nested record per customer: preferences, times, price, loyalty, places and the latest purchases."""
    # Order grain, cut once: nine parts of the profile read it instead of the items.
    first = durable(order_grain(rows.select("customer_id", "order_id", *ROW_ORDER, "cuisine", "day_of_week", "vendor_id", "vendor_geohash", "chain_id")))
    cuisine = as_map(distribution(first, "customer_id", "cuisine"), "customer_id", "cuisine", "cuisine_shares")
    chain = as_map(distribution(first.filter("chain_id <> ''"), "customer_id", "chain_id"), "customer_id", "chain_id", "chain_shares")
    hours = _listed(top_categories(first, "customer_id", "hour", 3), "customer_id", F.col("hour"), "peak_hours")
    days = _listed(top_categories(first, "customer_id", "day_of_week", 3), "customer_id", F.col("day_of_week"), "peak_days")
    vendors = _listed(top_categories(first, "customer_id", "vendor_id", 5), "customer_id", F.struct(F.col("vendor_id"), F.col("n")), "top_vendors")
    places = _listed(top_categories(first, "customer_id", "vendor_geohash", 5), "customer_id", F.col("vendor_geohash"), "areas")
    home = top_categories(rows, "customer_id", "user_geohash", 1).select("customer_id", F.col("user_geohash").alias("home_geohash"))
    out = loyalty(rows).join(price_stats(rows, "customer_id"), "customer_id")
    for part in (home, cuisine, chain, hours, days, vendors, places, _histories(first, max_history)):
        out = out.join(part, "customer_id", "left")
    return out


def cuisine_profiles(rows: DataFrame) -> DataFrame:
    """One nested record per cuisine: popularity, hours, weekdays, meals, price, vendors and areas."""
    first = durable(order_grain(rows.select("customer_id", "order_id", *ROW_ORDER, "cuisine", "day_of_week", "vendor_id", "vendor_geohash"))).withColumn("meal", scalars.meal_of(F.col("hour")))
    out = popularity(rows, "cuisine").join(price_stats(rows, "cuisine"), "cuisine")
    for c, name in (("hour", "hour_shares"), ("day_of_week", "day_shares"), ("meal", "meal_shares")):
        out = out.join(as_map(distribution(first, "cuisine", c), "cuisine", c, name), "cuisine", "left")
    tops = (("hour", 3, "peak_hours"), ("day_of_week", 3, "peak_days"), ("vendor_id", 5, "top_vendors"), ("vendor_geohash", 5, "areas"))
    for c, k, name in tops:
        out = out.join(_listed(top_categories(first, "cuisine", c, k), "cuisine", F.col(c), name), "cuisine", "left")
    return out


def histories(rows: DataFrame, max_history: int) -> DataFrame:
    """The last ``max_history`` orders of each customer, oldest first, as an array; only so many are ever gathered."""
    return _histories(order_grain(rows), max_history)


def _histories(g: DataFrame, max_history: int) -> DataFrame:
    w = Window.partitionBy("customer_id").orderBy(F.desc("day_num"), F.desc("hour"), F.desc("order_id"))
    kept = g.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= max_history)
    entry = F.struct("day_num", "hour", "order_id", "vendor_id", "cuisine", "day_of_week", "vendor_geohash")
    return kept.groupBy("customer_id").agg(F.array_sort(F.collect_list(entry)).alias("history"))


def peak_cuisines(rows: DataFrame, hour: int, day_of_week: int, k: int) -> DataFrame:
    """Cuisines by 0.6 of their share at the hour and 0.4 of their share on the weekday."""
    g = order_grain(rows)
    at_hour = distribution(g, "cuisine", "hour").filter(F.col("hour") == hour).select("cuisine", F.col("share").alias("h"))
    on_day = distribution(g, "cuisine", "day_of_week").filter(F.col("day_of_week") == day_of_week).select("cuisine", F.col("share").alias("w"))
    score = 0.6 * F.coalesce("h", F.lit(0.0)) + 0.4 * F.coalesce("w", F.lit(0.0))
    return g.select("cuisine").distinct().join(at_hour, "cuisine", "left").join(on_day, "cuisine", "left").select("cuisine", score.alias("score")).orderBy(F.desc("score"), "cuisine").limit(k)
