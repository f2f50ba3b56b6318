"""Per-key results without imbalance between tasks.

Rows are combined map-side to (key, order) grain, range-partitioned on the key
and a secondary column with sampled quantiles, so that a heavy key is cut over
many partitions, and aggregated where they lie. The partial states of keys cut
at a boundary are stitched by the last, small aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import shuffle_width

#: Amounts are summed as whole multiples of this, so that sums don't depend on the order of rows.
UNIT = 10_000


def skew_safe_profile(rows: DataFrame, fields: list[str], unit: str, party: str, amount: str) -> DataFrame:
    """Rows, distinct ``unit``s, distinct ``party``s and the sum of ``amount`` for every value of every field.

    Columns: field_name, key_value, n_rows, n_units, n_parties, amount, total_rows
    (all rows of the table) and share. Null keys have no row but count in
    ``total_rows``; null units, parties and amounts add nothing. Repeated rows
    count each. An empty table gives no rows. Columns other than those named are
    never read.
    """
    n = shuffle_width(rows.sparkSession)
    cents = F.round(F.col(amount) * UNIT).cast("long")
    named = rows.select(*[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)], F.col(unit).cast("string").alias("_u") if rows.schema[unit].dataType.typeName() == "string" else F.col(unit).alias("_u"), F.col(party).cast("string").alias("_p"), cents.alias("_a"))
    keys = [f"_f{i}" for i in range(len(fields))]
    grain = named.groupBy(*keys, "_u", "_p").agg(F.count(F.lit(1)).alias("_n"), F.sum("_a").alias("_a"))
    entry = [F.struct(F.lit(i).cast("byte").alias("f"), F.col(k).alias("key")) for i, k in enumerate(keys)]
    long = grain.select(F.explode(F.array(*entry)).alias("e"), "_u", "_p", "_n", "_a").select("e.f", "e.key", "_u", "_p", "_n", "_a").filter("key is not null")

    # The exchange is by range of (field, key, unit); the first aggregation needs no other one.
    ranged = long.select("f", "key", "_u", "_n", "_a").repartitionByRange(n, "f", "key", "_u")
    states = ranged.groupBy("f", "key", "_u").agg(F.sum("_n").alias("_n"), F.sum("_a").alias("_a"))
    by_unit = states.groupBy("f", "key").agg(F.sum("_n").alias("n_rows"), F.count("_u").alias("n_units"), F.sum("_a").alias("_a"))

    # Distinct parties: combined map-side, so a heavy (key, party) is one row per task before it moves.
    own = fields.index(party) if party in fields else -1
    parties = long.filter(F.col("f") != own).filter("_p is not null").select("f", "key", "_p").distinct().groupBy("f", "key").agg(F.count(F.lit(1)).alias("n_parties"))
    both = by_unit.join(parties, ["f", "key"], "left")
    total = F.broadcast(grain.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows")))  # one row
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("f") + 1)
    n_parties = F.when(F.col("f") == own, F.lit(1)).otherwise(F.coalesce("n_parties", F.lit(0)))
    return both.crossJoin(total).select(name.alias("field_name"), F.col("key").alias("key_value"), "n_rows", "n_units", n_parties.cast("long").alias("n_parties"), (F.coalesce("_a", F.lit(0)) / UNIT).alias("amount"), "total_rows", (F.col("n_rows") / F.col("total_rows")).alias("share"))
