"""Evaluation samples and sequences: histories, held-out orders, sliding windows, splits and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators.profiles import order_grain

#: Order of a customer's orders in time.
TIME = ("day_num", "hour", "order_id")


def numbered(orders: DataFrame) -> DataFrame:
    """Order-grain rows with their position from 1 and the number of orders of the customer."""
    w = Window.partitionBy("customer_id")
    return orders.withColumn("pos", F.row_number().over(w.orderBy(*TIME))).withColumn("n_orders", F.count(F.lit(1)).over(w))


def leave_last_out(rows: DataFrame) -> DataFrame:
    """Item rows of all orders but the last, of customers with at least two orders."""
    g = numbered(order_grain(rows)).filter("pos < n_orders").select("customer_id", "order_id")
    return rows.join(g, ["customer_id", "order_id"], "left_semi")


def last_orders(rows: DataFrame, min_history: int) -> DataFrame:
    """The last order of each customer with at least ``min_history`` orders in all, as ground truth."""
    return numbered(order_grain(rows)).filter((F.col("pos") == F.col("n_orders")) & (F.col("n_orders") >= min_history))


def train_test_samples(train: DataFrame, test: DataFrame, min_history: int) -> DataFrame:
    """Each test order of customers with at least ``min_history`` train orders: its first row and the length of the history."""
    n = train.select("customer_id", "order_id").distinct().groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_history")).filter(F.col("n_history") >= min_history)
    return order_grain(test).join(n, "customer_id")


def recency_distance(train: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples with the number of train orders since the vendor was last used; all of them if never."""
    g = numbered(order_grain(train))
    last = g.groupBy("customer_id", "vendor_id").agg(F.max("pos").alias("last_pos"))
    n = g.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_train"))
    joined = samples.join(n, "customer_id").join(last, ["customer_id", "vendor_id"], "left")
    return joined.withColumn("recency_distance", F.coalesce(F.col("n_train") - F.col("last_pos"), F.col("n_train")))


def within_recency(samples: DataFrame, most: int) -> DataFrame:
    """The recency filter; no limit for 0."""
    return samples.filter(F.col("recency_distance") <= most) if most > 0 else samples


def sliding_histories(events: DataFrame, entity: str, order: list[str], payload: str, n: int) -> DataFrame:
    """Events with exactly ``n`` predecessors of their entity, and these as an array."""
    w = Window.partitionBy(entity).orderBy(*order)
    h = events.withColumn("rn", F.row_number().over(w)).withColumn("history", F.collect_list(payload).over(w.rowsBetween(-n, -1)))
    return h.filter(F.col("rn") > n)


def chronological_split(events: DataFrame, entity: str, order: list[str], val: float, test: float) -> DataFrame:
    """Events with ``part``: the last max(1, n*test) of an entity are test, the max(1, n*val) before them validation."""
    w = Window.partitionBy(entity)
    rn, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    n_test, n_val = F.greatest(F.floor(n * test), F.lit(1)), F.greatest(F.floor(n * val), F.lit(1))
    part = F.when(rn > n - n_test, "test").when(rn > n - n_test - n_val, "val").otherwise("train")
    return events.withColumn("part", part)


def capped(rows: DataFrame, entity: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows per entity, the first in the given order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).filter(F.col("rn") <= most).drop("rn")


def sample_by_id(orders: DataFrame, first: int, last: int) -> DataFrame:
    """The rows from number ``first`` to ``last`` in the order of the ids as text; only ``last`` rows are ever sorted."""
    head = orders.withColumn("key", F.col("order_id").cast("string")).orderBy("key").limit(last)
    rn = F.row_number().over(Window.orderBy("key"))
    return head.withColumn("rn", rn).filter(F.col("rn") >= first).drop("key")


def random_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)
