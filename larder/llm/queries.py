"""Queries of the operators in this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import ids
from larder.llm.cooccurrence import associations
from larder.llm.langid import fit_on, language_segments
from larder.llm.leaks import leaked_items
from larder.llm.mixture import mix, prepared, shares
from larder.llm.pairs import count_ends, fit_bayes_on, pair_defects
from larder.llm.runs import collapse_runs
from larder.session import spread, table

#: Setting that names the vocabulary file of the mixtures' token counts, and the file used without it.
TOKENIZER_SETTING, TOKENIZER = "spark.larder.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"


def order_events(spark: SparkSession, d: str, as_written: bool = False) -> DataFrame:
    """One event per order: customer, vendor and cuisine of its lowest row_id, in clean form (the cuisine as written on request)."""
    rows = table(spark, d, "food_orders").select("order_id", "row_id", F.struct("customer_id", "vendor_id", "cuisine", "order_day", "order_time").alias("x"))
    first = rows.filter("order_id is not null").groupBy("order_id").agg(F.min_by("x", "row_id").alias("x")).select("order_id", "x.*")
    named = first.withColumn("cuisine_name", ids.squeezed(F.col("cuisine"))) if as_written else ids.with_canonical(first, "cuisine", "cuisine_name", table(spark, d, "vendors"), "primary_cuisine")
    day, sec = ids.day_number(F.col("order_day")), ids.seconds_of_day(F.col("order_time"))
    return named.select("order_id", ids.clean_id(F.col("customer_id")).alias("customer_id"), ids.clean_id(F.col("vendor_id")).alias("vendor_id"), F.col("cuisine_name").alias("cuisine"), day.alias("day"), "order_time", (day * 86400 + sec).alias("at")).filter(F.col("customer_id") != ids.SHARED_ACCOUNT)


def _runs(events: DataFrame, **how: object) -> DataFrame:
    runs = collapse_runs(events, "customer_id", ["day", "order_time", "order_id"], ["vendor_id", "cuisine"], "order_id", "at", **how)
    return runs.select(F.col("entity").alias("customer_id"), F.col("same_vendor_id").alias("vendor_id"), F.col("same_cuisine").alias("cuisine"), F.col("n").alias("n_orders"), F.col("first_id").alias("first_order_id"), F.col("last_id").alias("last_order_id"), F.col("duration").alias("seconds"))


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(order_events(spark, d))


def p2_week_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose orders lie no more than seven days apart."""
    return _runs(order_events(spark, d), max_gap=7 * 86400)


def p2_near_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two and more by the cuisine as written, at most two letters from the run's first, no more than 30 days apart."""
    return _runs(order_events(spark, d, as_written=True), max_gap=30 * 86400, tolerance={"cuisine": 2}, least=2)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    runs = collapse_runs(order_events(spark, d), "customer_id", ["day", "order_time", "order_id"], ["vendor_id", "cuisine"], "order_id", "at", least=2)
    return runs.select(F.col("entity").alias("customer_id"), F.col("first_id").alias("first_order_id"), F.col("last_id").alias("last_order_id"))


def p4_pairs(spark: SparkSession, d: str, least: int = 1) -> DataFrame:
    named = ids.with_canonical(table(spark, d, "food_orders").select("order_id", "vendor_id", "cuisine"), "cuisine", "cuisine_name", table(spark, d, "vendors"), "primary_cuisine")
    rows = named.select("order_id", ids.clean_id(F.col("vendor_id")).alias("vendor"), F.col("cuisine_name").alias("cuisine"))
    pairs = associations(rows, "order_id", {"cuisine": "cuisine", "vendor": "vendor"}, least=least).withColumnRenamed("kind", "item_kind")
    return pairs.withColumns({c: F.round(c, 6) for c in ("ratio", "pmi", "jaccard")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d, least=5).filter("n_ab >= 5 and n_ab * n >= 1.5 * n_a * n_b").select("item_kind", "item_a", "item_b")


def p3_defects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stage9_repeat_detailed")
    # One scan of the two rounds; ids, prompts and responses are all that is read.
    rounds = F.explode(F.array(*[F.struct(F.lit(n).alias("round_no"), F.col(f"round{n}_prompt").alias("prompt"), F.col(f"round{n}_raw_response").alias("response")) for n in (1, 2)]))
    read = rows.select("result_id", "round1_prompt", "round1_raw_response", "round2_prompt", "round2_raw_response")
    pairs = spread(read).select("result_id", rounds.alias("r")).select("result_id", "r.*")
    return pair_defects(pairs, fit_bayes_on(table(spark, d, "documents")), count_ends(pairs))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_defects(spark, d).select("result_id", "round_no", "defect")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "lang", "source", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_texts(spark, d), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents per item."""
    items = table(spark, d, "eval_items").select("item_id", "suite", "lang")
    hits = leaked_items(_texts(spark, d), table(spark, d, "eval_items")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_pieces").alias("most_pieces"))
    return items.join(hits, "item_id")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return prepared(_texts(spark, d), spark.conf.get(TOKENIZER_SETTING, TOKENIZER))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(_texts(spark, d), fit_on(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_segments(spark, d).filter("not label_ok").select("doc_id", "seg_no", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p2_found, p2_runs, p2_week_runs, p2_near_runs, p3_found, p3_defects, p4_found, p4_pairs, p7_found, p7_report, p8_mixture, p8_shares, p9_found, p9_segments)
    return {f.__name__: f for f in every}
