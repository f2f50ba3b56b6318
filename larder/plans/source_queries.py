"""Queries of sources and sinks, and of the streaming extension run as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.plans.canonical import OI, Registry, order_items
from larder.session import table
from larder.sources.sinks import preview

R = Registry()


@R.add(f"WITH {OI} SELECT row_id, customer_id, vendor_id, (SELECT count(*) FROM oi) AS total_rows FROM oi ORDER BY row_id, customer_id, vendor_id LIMIT 10")
def sink_preview(s, d):
    return preview(order_items(s, d).select("row_id", "customer_id", "vendor_id"), 10)


@R.add("SELECT source, count(*) AS n, min(length(text))::INT AS least, max(length(text))::INT AS most, round(avg(length(text)), 6) AS mean FROM documents GROUP BY 1")
def scan_text_lengths(s, d):
    n = F.length("text")
    return table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


@R.add("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS sum_value FROM events GROUP BY 1, 2")
def stream_hourly_counts(s, d):
    """The aggregation of the streaming job ``hourly_counts`` over the whole table at once."""
    from larder.streaming.jobs import windowed

    out = windowed(table(s, d, "events"), "1 hour")
    return out.withColumns({"sum_value": F.round("sum_value", 4), "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")})
