"""References to records that do not exist, or not on the day of the reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.ids import clean_id
from larder.session import durable, within

#: Orphan keys up to this number (some 50 bytes each) are broadcast to the rows; more are joined by shuffle.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class Parent:
    """A referenced table: its rows are valid from ``begins`` up to but not including ``ends`` (null: still)."""

    name: str
    rows: DataFrame
    key: str
    begins: str
    ends: str


def _references(rows: DataFrame, refs: dict[str, str], carry: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(t).alias("ref_table"), F.col(c).alias("ref_key")) for t, c in refs.items()])
    return rows.select(*carry, "day", F.explode(each).alias("r")).select(*carry, "day", "r.ref_table", "r.ref_key").filter("ref_key is not null")


def orphan_keys(rows: DataFrame, refs: dict[str, str], parents: list[Parent]) -> DataFrame:
    """Distinct (ref_table, ref_key, day) that hold no valid parent, with orphan_kind and the number of rows.

    Keys are anti-joined with the parent rows valid on their day; only what is
    left is looked up again to tell its kind. ``missing``: no parent row with that
    key; ``late``: all of them begin after the day; ``deleted``: some began by
    then, none is valid. A parent row without a begin counts as always begun;
    without an end, as still valid. Null parent keys match nothing. A reference
    without a day is only ever ``missing``.
    """
    keys = _references(rows, refs, []).groupBy("ref_table", "ref_key", "day").agg(F.count(F.lit(1)).alias("n_rows"))
    spans = None
    for p in parents:
        s = p.rows.select(F.lit(p.name).alias("ref_table"), clean_id(F.col(p.key)).alias("ref_key"), F.col(p.begins).alias("begins"), F.col(p.ends).alias("ends")).filter("ref_key is not null")
        spans = s if spans is None else spans.unionByName(s)
    same = (keys["ref_table"] == spans["ref_table"]) & (keys["ref_key"] == spans["ref_key"])
    begun = F.coalesce(spans["begins"] <= keys["day"], F.lit(True))
    valid = begun & F.coalesce(keys["day"] < spans["ends"], F.lit(True))
    orphans = keys.join(spans, same & valid, "left_anti")
    # One row per parent key: whether the key is there at all, and when its first row begins (null: always).
    known = spans.groupBy("ref_table", "ref_key").agg(F.when(F.count_if(F.col("begins").isNull()) == 0, F.min("begins")).alias("first"), F.lit(True).alias("there"))
    kind = F.when(F.col("there").isNull(), "missing").when(F.col("first") > F.col("day"), "late").otherwise("deleted")
    return orphans.join(known, ["ref_table", "ref_key"], "left").select("ref_table", "ref_key", "day", kind.alias("orphan_kind"), "n_rows")


def orphan_rows(rows: DataFrame, row_id: str, refs: dict[str, str], parents: list[Parent], broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per row and reference that does not hold: row_id, ref_table, ref_key, day, orphan_kind.

    ``rows`` has a column ``day`` and, for each table in ``refs``, a column with
    the clean key or null. The distinct orphan keys are found first and joined
    back: by broadcast within ``broadcast_keys``, else by a shuffled join whose
    key holds the day, so that one hot id spreads over its days. Repeated rows
    count each; empty tables give no rows.
    """
    keys = durable(orphan_keys(rows, refs, parents).withColumnRenamed("day", "_d").drop("n_rows"))
    keys = F.broadcast(keys) if within(keys, broadcast_keys) else keys
    r = _references(rows, refs, [row_id])
    same = (r["ref_table"] == keys["ref_table"]) & (r["ref_key"] == keys["ref_key"]) & r["day"].eqNullSafe(keys["_d"])
    return r.join(keys, same).select(r[row_id].alias("row_id"), r["ref_table"], r["ref_key"], r["day"], "orphan_kind")


def orphan_report(rows: DataFrame, refs: dict[str, str], parents: list[Parent], days_per_period: int = 7) -> DataFrame:
    """Rows and distinct keys that do not hold, per table, period (numbered from day 0) and kind."""
    keys = orphan_keys(rows, refs, parents).withColumn("period", F.floor(F.col("day") / days_per_period).cast("long"))
    return keys.groupBy("ref_table", "period", "orphan_kind", "ref_key").agg(F.sum("n_rows").alias("n")).groupBy("ref_table", "period", "orphan_kind").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
