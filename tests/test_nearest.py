import random

import pytest
from pyspark.sql import functions as F

from larder.operators import nearest, similarity
from larder.plans import evaluation_queries, profile_queries, sample_queries


def exchanged(spark):
    """Rows written to exchanges since the session began."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("query", ["cf_user_cosine", "rank_similar_histories", "cf_user_jaccard", "cf_user_swing"])
def test_customers_of_one_hot_vendor_exchange_no_pairs(spark, monkeypatch, query):
    n = 300
    rows = spark.range(n * 6).select(F.col("id").alias("row_id"), F.col("id").alias("order_id"), F.concat(F.lit("c"), F.lpad((F.col("id") % n).cast("string"), 3, "0")).alias("customer_id"), F.when(F.col("id") < n, F.concat(F.lit("v"), (F.col("id") % 70).cast("string"))).otherwise("hot").alias("vendor_id"), F.lit("p").alias("product_id"), F.lit("x").alias("cuisine"), F.lit(1).alias("day_num"), F.lit(1).alias("hour"))
    for module in (sample_queries, profile_queries, evaluation_queries):
        monkeypatch.setattr(module, "train", lambda s, d: rows)
        monkeypatch.setattr(module, "test", lambda s, d: rows.withColumn("day_num", F.lit(100)), raising=False)
    module = evaluation_queries if query.startswith("rank") else sample_queries
    before = exchanged(spark)
    got = getattr(module, query)(spark, "").collect()
    assert len(got) == n * 5 * (5 if query.startswith("rank") else 1)
    assert exchanged(spark) - before < n * n / 2


@pytest.mark.parametrize("measure", ["swing", "cosine", "jaccard"])
def test_nearest_equals_the_search_over_all_pairs(spark, monkeypatch, measure):
    rnd = random.Random(3)
    rows = {(f"u{rnd.randrange(150)}", f"i{int(40 * rnd.random() ** 3)}") for _ in range(900)} | {(f"w{i}", "i0") for i in range(20)} | {("lone", "only")}
    edges = spark.createDataFrame([(u, i, rnd.randrange(1, 4)) for u, i in sorted(rows)], "u string, i string, n long")
    queries = edges.select("u").distinct().filter("u like 'u%' or u in ('w3', 'lone')").union(spark.createDataFrame([("absent",)], "u string"))
    pairs = {"swing": lambda: similarity.swing(edges.drop("n"), "u", "i", queries), "cosine": lambda: similarity.cosine(edges, "u", "i", queries), "jaccard": lambda: similarity.jaccard(edges.drop("n"), "u", "i", queries)}[measure]()
    told = lambda df: sorted((r.a, r.b, round(r.sim, 9), r["rank"]) for r in df.collect())
    whole = told(similarity.top_similar(pairs, 5))
    for bounds in ({}, {"HOT_ROWS": 20}, {"HOT_ROWS": 1, "HOT": 100}, {"HOT_ROWS": 20, "AT_ONCE": 30, "CHUNK_EDGES": 200, "BLOCK_QUERIES": 50}):
        with monkeypatch.context() as m:
            for name, bound in bounds.items():
                m.setattr(nearest, name, bound)
            assert told(nearest.nearest(edges, "u", "i", queries, 5, measure)) == whole, bounds


def test_nearest_keeps_numbers_missing_elements_and_no_queries(spark):
    edges = spark.createDataFrame([(9, "x"), (10, "x"), (10, None), (11, "x"), (None, "x")], "u long, i string")
    got = nearest.nearest(edges, "u", "i", edges.filter("u = 10").select("u"), 5, "jaccard").collect()
    assert [(r.a, r.b, r.sim, r["rank"]) for r in got] == [(10, 9, 0.5, 1), (10, 11, 0.5, 2)]
    assert nearest.nearest(edges, "u", "i", edges.filter("u = 99").select("u"), 5, "swing").collect() == []
