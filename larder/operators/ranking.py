"""Candidates and rankings: place index, round-robin, ensembles, repair, injection and an offline scorer.

Lists per sample are bounded by a parameter; everything else stays in rows with
explicit positions, so no result depends on the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window


def place_index(rows: DataFrame) -> DataFrame:
    """(vendor_geohash, cuisine, vendor_id, pos): vendors of a place and cuisine, numbered by id."""
    pos = F.row_number().over(Window.partitionBy("vendor_geohash", "cuisine").orderBy("vendor_id"))
    return rows.select("vendor_geohash", "cuisine", "vendor_id").distinct().withColumn("pos", pos)


def vendor_metadata(rows: DataFrame) -> DataFrame:
    """Place and cuisine of each vendor, from its last row."""
    last = rows.groupBy("vendor_id").agg(F.max_by(F.struct("vendor_geohash", "cuisine"), "row_id").alias("x"))
    return last.select("vendor_id", "x.*")


def round_robin(wanted: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """Vendors of the wanted cuisines at the sample's place, taken in turn, at most ``most``.

    ``wanted``: sample, vendor_geohash, cuisine, cuisine_pos. Vendors are unique
    per sample; one that several cuisines offer keeps its earliest turn.
    """
    turns = wanted.join(index, ["vendor_geohash", "cuisine"]).select("sample", "vendor_id", F.struct("pos", "cuisine_pos").alias("turn"))
    once = turns.groupBy("sample", "vendor_id").agg(F.min("turn").alias("turn"))
    rank = F.row_number().over(Window.partitionBy("sample").orderBy("turn", "vendor_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).select("sample", "vendor_id", "rank")


def most_common(entries: DataFrame, key: str, value: str, pos: str, n: int) -> DataFrame:
    """The n most frequent values of a key; ties in the order of their first position."""
    c = entries.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return c.withColumn("rank", rank).filter(F.col("rank") <= n)


def with_frequent(predicted: Column, frequent: Column) -> Column:
    """Predictions whose last place goes to the first of the frequent items they lack; appended if there are none."""
    missing = F.get(F.filter(frequent, lambda x: ~F.array_contains(predicted, x)), F.lit(0))
    swapped = F.concat(F.slice(predicted, 1, F.greatest(F.size(predicted) - 1, F.lit(0))), F.array(missing))
    return F.when(missing.isNull(), predicted).when(F.size(predicted) == 0, F.array(missing)).otherwise(swapped)


def repaired(ranking: Column, candidates: Column) -> Column:
    """The valid, first-time items of a ranking in the candidates' spelling, then the missing candidates in order."""
    low = F.array_distinct(F.transform(F.filter(F.coalesce(ranking, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x))))
    spelled = lambda x: F.get(F.filter(candidates, lambda c: F.lower(c) == x), F.lit(0))
    kept = F.filter(F.transform(low, spelled), lambda x: x.isNotNull())
    return F.concat(kept, F.filter(candidates, lambda c: ~F.array_contains(low, F.lower(c))))


def mentioned_first(text: Column, candidates: Column) -> Column:
    """Candidates the text mentions, then the others, both in the candidates' order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.filter(candidates, lambda c: F.contains(low, F.lower(c))), F.filter(candidates, lambda c: ~F.contains(low, F.lower(c))))


def single_pick(text: Column, candidates: Column) -> Column:
    """The candidate equal to the text, else the first one in it, else the first one."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    first = lambda f: F.get(F.filter(candidates, f), F.lit(0))
    return F.coalesce(first(lambda c: F.lower(c) == low), first(lambda c: F.contains(low, F.lower(c))), F.get(candidates, F.lit(0)))


def hash_order(items: Column, seed: Column, prime: int = 7919) -> Column:
    """A shuffle that depends on the items' positions and a seed only."""
    keyed = F.transform(items, lambda x, i: F.struct(((seed + 1) * (i + 1) * prime % 10007).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda t: t["x"])


def injected(candidates: Column, truth: Column, seed: Column, most: int) -> Column:
    """Candidates with the truth; where it lacks, at a seeded position between the first and the last, and cut to ``most``.

    An item other than the truth makes room, so the truth always stays.
    """
    n = F.size(candidates)
    at = F.when(n <= 1, n).otherwise(1 + F.pmod(seed, F.greatest(n - 1, F.lit(1)))).cast("int")
    kept = F.when(n >= most, F.slice(candidates, 1, most - 1)).otherwise(candidates)
    at = F.least(at, F.size(kept))
    put = F.concat(F.slice(kept, F.lit(1), at), F.array(truth), F.slice(kept, at + 1, F.greatest(F.size(kept) - at, F.lit(0))))
    return F.when(F.array_contains(candidates, truth), candidates).otherwise(put)


def capped_evidence(records: DataFrame, per_peer: int, most: int) -> DataFrame:
    """Records of similar users: the last ``per_peer`` of each, the peers in order until ``most`` records in all.

    ``records``: sample, peer_pos, pos. The peer at which the cap is reached
    keeps its most recent records.
    """
    back = F.row_number().over(Window.partitionBy("sample", "peer_pos").orderBy(F.desc("pos")))
    last = records.withColumn("back", back).filter(F.col("back") <= per_peer)
    per = last.groupBy("sample", "peer_pos").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sample").orderBy("peer_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = per.select("sample", "peer_pos", (F.lit(most) - before).alias("room"))
    return last.join(room, ["sample", "peer_pos"]).filter(F.col("back") <= F.col("room")).drop("room")


Scorer = Callable[[pd.DataFrame], pd.Series]


def scored(samples: DataFrame, scorer: Scorer, column: str = "response") -> DataFrame:
    """Run a scorer over Arrow batches of prompts: the place where a language model would be called.

    ``scorer`` maps a batch (pandas frame) to responses; partitions are the workers.
    """
    schema = StructType([*samples.schema.fields, StructField(column, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[column] = scorer(batch)
            yield batch

    return samples.mapInPandas(run, schema)


def offline_scores(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """Deterministic scores in a model's place: frequency, then recency, then cuisine share of each candidate vendor.

    ``history``: sample, vendor_id, cuisine, pos; ``candidates``: sample, vendor_id, cuisine.
    """
    n = history.groupBy("sample").agg(F.max("pos").alias("n"))
    v = history.groupBy("sample", "vendor_id").agg(F.count(F.lit(1)).alias("freq"), F.max("pos").alias("last"))
    c = history.groupBy("sample", "cuisine").agg(F.count(F.lit(1)).alias("cfreq"))
    j = candidates.join(n, "sample").join(v, ["sample", "vendor_id"], "left").join(c, ["sample", "cuisine"], "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    score = 0.5 * zero("freq") / F.col("n") + 0.3 * zero("last") / F.col("n") + 0.2 * zero("cfreq") / F.col("n")
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc(F.round("score", 9)), "vendor_id"))
    return j.withColumn("score", score).withColumn("rank", rank).select("sample", "vendor_id", "cuisine", "score", "rank")
