"""Ranking, basket and classification metrics, latency and length summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.scalars import hit_of, ndcg_of
from larder.session import durable, shuffle_width


def ranking_report(ranks: DataFrame, columns: dict[str, str], ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row of hit, NDCG and MRR averages per rank column; ``columns`` maps a prefix to a column (0: not found)."""
    out = []
    for prefix, c in columns.items():
        rank = F.col(c)
        for k in ks:
            out += [F.avg(hit_of(rank, k)).alias(f"{prefix}hit_{k}"), F.avg(ndcg_of(rank, k)).alias(f"{prefix}ndcg_{k}")]
        out.append(F.avg(F.when(rank > 0, 1.0 / rank).otherwise(0.0)).alias(f"{prefix}mrr"))
    return ranks.agg(*out)


def basket_scores(p: Column, g: Column, k: int) -> dict[str, Column]:
    """Hit, recall, precision, F1 and NDCG of a ranked list ``p`` against a set ``g`` at ``k``.

    Recall and precision count distinct items of the first k; precision divides
    by k. NDCG counts repeated items each; its ideal has min(|g|, k) hits. All are
    0 for an empty list or set.
    """
    top = F.slice(p, 1, k)
    common = F.size(F.array_intersect(top, g))
    n = F.size(g)
    recall = F.when(n > 0, common / n).otherwise(0.0)
    precision = F.when(n > 0, common / F.lit(float(k))).otherwise(0.0)
    gain = F.aggregate(F.transform(top, lambda x, i: F.when(F.array_contains(g, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    f1 = F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))
    return {"hit": F.when(common > 0, 1.0).otherwise(0.0), "recall": recall, "precision": precision, "f1": f1, "ndcg": F.when(n > 0, gain / ideal).otherwise(0.0)}


def basket_mrr(p: Column, g: Column) -> Column:
    """Reciprocal position of the first item of ``p`` in ``g``, 0 without one."""
    at = F.array_min(F.filter(F.transform(p, lambda x, i: F.when(F.array_contains(g, x), i + 1)), lambda i: i.isNotNull()))
    return F.coalesce(1.0 / at, F.lit(0.0))


def classification(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """tp, fp, fn, tn of Yes/No with accuracy, precision, recall and F1; other predictions are wrong but in no cell."""
    y, p = F.col(label), F.col(prediction)
    c = lambda cond, n: F.count_if(cond).alias(n)
    a = rows.agg(F.count(F.lit(1)).alias("n"), c(y == p, "correct"), c((y == "Yes") & (p == "Yes"), "tp"), c((y == "No") & (p == "Yes"), "fp"), c((y == "Yes") & (p == "No"), "fn"), c((y == "No") & (p == "No"), "tn"))
    zero = lambda x, z: F.coalesce(F.try_divide(x, z), F.lit(0.0))
    a = a.withColumn("accuracy", zero(F.col("correct"), F.col("n"))).withColumn("precision", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", zero(F.col("tp"), F.col("tp") + F.col("fn")))
    return a.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def disagreements(rows: DataFrame, label: str, base: str, tuned: str) -> DataFrame:
    """How often two classifiers differ, which of them is right then, and the net improvement."""
    y, b, t = F.col(label), F.col(base), F.col(tuned)
    a = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(b != t).alias("n_differ"), F.count_if((b != t) & (t == y)).alias("improvements"), F.count_if((b != t) & (b == y)).alias("regressions"), F.count_if((b != t) & (b != y) & (t != y)).alias("both_wrong"))
    return a.withColumn("pct_differ", F.coalesce(F.try_divide(100.0 * F.col("n_differ"), F.col("n")), F.lit(0.0))).withColumn("net", F.col("improvements") - F.col("regressions"))


def length_summary(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """Count, extremes, mean and exact interpolated percentiles of a length, and how many exceed ``limit``."""
    c = F.col(column)
    qs = {f"p{int(q * 100)}": q for q in (0.5, 0.9, 0.95, 0.99)}
    at = F.broadcast(interpolated_percentiles(rows, column, qs, shuffle_width(rows.sparkSession)))  # one row
    whole = rows.filter(c.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.count_if(c > limit).alias("n_over"), F.coalesce(F.try_divide(100.0 * F.count_if(c > limit), F.count(F.lit(1))), F.lit(0.0)).alias("pct_over"))
    return whole.crossJoin(at).select("n", "least", "most", "mean", *qs, "n_over", "pct_over")


def cumulated(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """(v, c, upto): distinct values of a column with their counts and the number of values up to each.

    Values are counted first, so the sort runs over distinct values, a range of them in each task. The ranges are cut
    durably, since they are read twice and must not be drawn again.
    """
    v = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranged = durable(v.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.sum("c").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    return ranged.join(F.broadcast(before), "part").select("v", "c", (F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v"))).alias("upto"))


def interpolated_percentiles(rows: DataFrame, column: str, qs: dict[str, float], parts: int) -> DataFrame:
    """One row with exact percentiles, interpolated between neighbouring values; null where there is none."""
    upto = cumulated(rows, column, parts)
    n = upto.agg(F.max("upto").alias("n"))  # one row
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v"))).cast("double")
    out = []
    for name, q in qs.items():
        place = (F.col("n") - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return upto.crossJoin(F.broadcast(n)).agg(*out)


def nearest_percentiles(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """Percentiles by index: element floor(n*q) of the sorted values, the largest where n is small."""
    upto = cumulated(rows, column, parts)
    n = F.broadcast(upto.agg(F.sum("c").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")))  # one row
    at = lambda q, least: F.when(F.col("n") >= least, F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v")))).otherwise(F.col("most"))
    return upto.crossJoin(n).groupBy("n", "least", "most", "mean").agg(at(0.5, 0).alias("p50"), at(0.9, 10).alias("p90"), at(0.95, 20).alias("p95"), at(0.99, 100).alias("p99"))
