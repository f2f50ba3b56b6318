"""The canonical item-grain view of orders, its train and test parts, and evaluation results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import ids, scalars
from larder.plans.sqlparts import CLEAN_IDS, CUISINE_NAMES
from larder.session import table

#: Orders before this day are the training part.
SPLIT_DAY = 96


class Registry:
    """Queries of a module with their oracle statements."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def deco(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return deco


def order_items(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned item rows of known, single customers and vendors, with sentinels in place of nulls."""
    raw = table(spark, d, "food_orders")
    named = ids.with_canonical(raw, "cuisine", "cuisine_name", table(spark, d, "vendors"), "primary_cuisine")
    day = ids.day_number(F.col("order_day"))
    rows = named.select(
        "row_id", ids.clean_id(F.col("customer_id")).alias("customer_id"), "order_id", ids.clean_id(F.col("vendor_id")).alias("vendor_id"), "product_id",
        "user_geohash", "vendor_geohash", ids.clean_id(F.col("chain_id")).alias("chain_id"), F.col("cuisine_name").alias("cuisine"), "product_name", "unit_price",
        scalars.hour_of(F.col("order_time")).alias("hour"), day.alias("day_num"), F.pmod(day, F.lit(7)).alias("day_of_week"),
    )
    known = rows.filter((F.col("customer_id") != ids.SHARED_ACCOUNT) & F.col("vendor_id").isNotNull())
    return known.fillna({"user_geohash": "unknown", "vendor_geohash": "unknown", "chain_id": "", "cuisine": "unknown", "product_name": "Unknown Product", "unit_price": 0.0})


OI = f"""
{CUISINE_NAMES},
oi AS (SELECT * FROM (
  SELECT f.row_id, {CLEAN_IDS.format("f.customer_id")} AS customer_id, f.order_id, {CLEAN_IDS.format("f.vendor_id")} AS vendor_id, f.product_id,
    coalesce(f.user_geohash, 'unknown') AS user_geohash, coalesce(f.vendor_geohash, 'unknown') AS vendor_geohash, coalesce({CLEAN_IDS.format("f.chain_id")}, '') AS chain_id,
    coalesce(n.name, 'unknown') AS cuisine, coalesce(f.product_name, 'Unknown Product') AS product_name, coalesce(f.unit_price, 0.0) AS unit_price,
    CAST(split_part(f.order_time, ':', 1) AS INT) AS hour, CAST(regexp_extract(f.order_day, '([0-9]+)', 1) AS INT) AS day_num,
    CAST(CAST(regexp_extract(f.order_day, '([0-9]+)', 1) AS INT) % 7 AS INT) AS day_of_week
  FROM food_orders f LEFT JOIN cuisine_names n ON n.raw = f.cuisine) WHERE customer_id <> 'guest' AND vendor_id IS NOT NULL),
og AS (SELECT * FROM oi QUALIFY row_number() OVER (PARTITION BY customer_id, order_id ORDER BY day_num, hour, row_id) = 1),
train AS (SELECT * FROM oi WHERE day_num < {SPLIT_DAY}), test AS (SELECT * FROM oi WHERE day_num >= {SPLIT_DAY}),
gtrain AS (SELECT * FROM train QUALIFY row_number() OVER (PARTITION BY customer_id, order_id ORDER BY day_num, hour, row_id) = 1),
gtest AS (SELECT * FROM test QUALIFY row_number() OVER (PARTITION BY customer_id, order_id ORDER BY day_num, hour, row_id) = 1)
"""


def train(spark: SparkSession, d: str) -> DataFrame:
    return order_items(spark, d).filter(F.col("day_num") < SPLIT_DAY)


def test(spark: SparkSession, d: str) -> DataFrame:
    return order_items(spark, d).filter(F.col("day_num") >= SPLIT_DAY)


def results(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records, one per sample: of samples appended again the row written last counts."""
    r = table(spark, d, "stage9_repeat_detailed")
    rest = [c for c in r.columns if c not in ("customer_id", "order_id")]
    last = r.groupBy("customer_id", "order_id").agg(F.max_by(F.struct(*rest), F.struct("written_at", "result_id")).alias("x"))
    return last.select("customer_id", "order_id", "x.*")


RES = "res AS (SELECT * FROM stage9_repeat_detailed QUALIFY row_number() OVER (PARTITION BY customer_id, order_id ORDER BY written_at DESC NULLS LAST, result_id DESC) = 1)"
