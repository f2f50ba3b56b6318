"""Scans: delimited tables by region, JSON or JSON lines, Parquet, ratings with titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.functions import ids, scalars

# The columns of the source tables.
SCHEMAS = {
    "orders": "customer_id string, order_id string, vendor_id string, product_id string, geohash string, order_time string, order_day string, day_of_week int",
    "vendors": "vendor_id string, primary_cuisine string, geohash string, chain_id string",
    "products": "vendor_id string, product_id string, name string, unit_price double",
    "ratings": "userId int, movieId int, rating double, timestamp long",
    "movies": "movieId int, title string",
}
DEFAULT_REGION = "se"


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def region_of(spark: SparkSession, folder: str) -> str:
    """The region of the first ``orders_<region>_train.txt``; the default without one."""
    for n in _names(spark, folder):
        if n.startswith("orders_") and n.endswith("_train.txt"):
            return n[len("orders_") : -len("_train.txt")]
    return DEFAULT_REGION


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A delimited file with a header and the fixed schema of its kind; unreadable numbers become null."""
    return spark.read.csv(path, header=True, schema=SCHEMAS[kind])


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself; an error naming every column it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def load_orders(spark: SparkSession, folder: str, part: str = "train", region: str | None = None) -> DataFrame:
    """Orders of a region's part with hour, day number and day name. A missing file is an error."""
    name = f"orders_{region or region_of(spark, folder)}_{part}.txt"
    if name not in _names(spark, folder):
        raise FileNotFoundError(f"{folder}/{name}")
    o = require_columns(read_table(spark, f"{folder}/{name}", "orders"), "customer_id", "order_id", "vendor_id")
    return o.withColumns({"hour": scalars.hour_of(F.col("order_time")), "day_num": ids.day_number(F.col("order_day")), "day_name": scalars.day_name(F.col("day_of_week"))})


def load_vendors(spark: SparkSession, folder: str, region: str | None = None) -> DataFrame:
    return read_table(spark, f"{folder}/vendors_{region or region_of(spark, folder)}.txt", "vendors").fillna({"chain_id": ""})


def load_products(spark: SparkSession, folder: str, region: str | None = None) -> DataFrame:
    return read_table(spark, f"{folder}/products_{region or region_of(spark, folder)}.txt", "products").fillna({"unit_price": 0.0, "name": "Unknown Product"})


def merged(orders: DataFrame, vendors: DataFrame, products: DataFrame) -> DataFrame:
    """Item-grain orders with vendor and product columns; both geohashes named, misses filled with sentinels."""
    v = vendors.select("vendor_id", F.col("primary_cuisine").alias("cuisine"), F.col("geohash").alias("vendor_geohash"), "chain_id")
    p = products.select("vendor_id", "product_id", F.col("name").alias("product_name"), "unit_price")
    out = orders.withColumnRenamed("geohash", "user_geohash").join(v, "vendor_id", "left").join(p, ["vendor_id", "product_id"], "left")
    return out.fillna({"cuisine": "unknown", "vendor_geohash": "unknown", "chain_id": "", "product_name": "Unknown Product", "unit_price": 0.0})


def read_json_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A file that holds either one JSON list or one object per line (blank lines skipped)."""
    head = next((r.value.strip() for r in spark.read.text(path).filter(F.trim("value") != "").take(1)), "")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path, multiLine=head.startswith("["))


def load_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings with titles; an unknown title is ``Movie <id>``."""
    r = read_table(spark, f"{folder}/ratings.csv", "ratings")
    m = read_table(spark, f"{folder}/movies.csv", "movies")
    return r.join(m, "movieId", "left").withColumn("title", F.coalesce("title", F.concat(F.lit("Movie "), F.col("movieId").cast("string"))))


def history_lines(ratings: DataFrame, n: int) -> DataFrame:
    """For every rating with ``n`` earlier ones of its user: these as numbered lines, oldest first."""
    from larder.operators.samples import sliding_histories

    rows = ratings.withColumn("seen", F.struct("title", "rating"))
    h = sliding_histories(rows, "userId", ["timestamp", "movieId"], "seen", n)
    line = lambda x, i: F.format_string("%d. %s (rating ≈ %.1f)", i + 1, x["title"], x["rating"])
    return h.select("userId", "movieId", "title", "rating", F.transform("history", line).alias("lines"))
