"""Sinks: JSON lines, previews, resumable results, event logs and run folders."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_results(results: DataFrame, path: str) -> None:
    """Append records as JSON lines; each task writes its own files, so no lock is needed."""
    results.write.mode("append").json(path)


def missing_from(samples: DataFrame, spark: SparkSession, path: str, keys: tuple[str, ...] = ("customer_id", "order_id")) -> DataFrame:
    """The samples whose composite key has no finished record at ``path`` (all of them if there is nothing yet)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return samples
    schema = ", ".join(f"{k} string" for k in keys)
    done = spark.read.schema(schema).json(path).dropna().distinct()
    same = [samples[k].cast("string") == done[k] for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return samples.join(done, on, "left_anti")


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows by key order of the columns, each with the total number of rows."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total_rows")))  # one row
    return df.orderBy(*[c for c, t in df.dtypes if not t.startswith(("array", "struct", "map"))]).limit(n).crossJoin(total)


def log_events(df: DataFrame, path: str) -> None:
    """Structured log events, partitioned by session, as JSON lines."""
    df.select("timestamp", "session_id", "type", "agent", "subtype", "message", "performance").write.mode("append").partitionBy("session_id").json(path)


def run_folder(base: str, at: datetime | None = None) -> str:
    """``base/YYYYMMDDHHMM``: the folder of a run."""
    return f"{base}/{(at or datetime.now()):%Y%m%d%H%M}"


def content_key(df: DataFrame, settings: dict[str, object]) -> str:
    """Key of a stage's cache: its rows as a multiset and its settings, independent of order and layout."""
    h = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    s = df.sparkSession.range(1).select(F.sha2(F.lit(repr((h.n, str(h.h), sorted(settings.items())))), 256)).first()
    return s[0]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cached_stage(spark: SparkSession, base: str, stage: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a stage kept under ``base/stage/key``, built and written first where no finished ones are there.

    ``key`` names content and settings (``content_key``); a write that was cut off leaves no mark and is done again.
    """
    where = f"{base}/{stage}/{key}"
    fs, mark = _path(spark, f"{where}/_SUCCESS")
    if not fs.exists(mark):
        build().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def cached_keys(spark: SparkSession, base: str, stage: str) -> list[str]:
    """Keys of the finished entries of a stage, in order."""
    fs, p = _path(spark, f"{base}/{stage}")
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if fs.exists(_path(spark, f"{base}/{stage}/{n}/_SUCCESS")[1]))


def clear_stage(spark: SparkSession, base: str, stage: str, key: str | None = None) -> bool:
    """Remove one entry of a stage, or all of them; whether there was anything."""
    fs, p = _path(spark, f"{base}/{stage}" + (f"/{key}" if key else ""))
    return bool(fs.delete(p, True))
