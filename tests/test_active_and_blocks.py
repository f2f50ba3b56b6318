from pyspark.sql import functions as F

from larder.operators import similarity
from larder.plans import profile_queries


def orders(spark, n):
    return spark.createDataFrame([("hot", i, "v1") for i in range(n)] + [("few", i, "v1") for i in range(4)] + [("some", i, "v1") for i in range(5)], "customer_id string, order_id long, vendor_id string")


def test_active_has_no_upper_bound_unless_given(spark):
    got = lambda **k: {r.customer_id: r.n_orders for r in profile_queries.active(orders(spark, 300), **k).collect()}
    assert got() == {"hot": 300, "some": 5}
    assert got(most=200) == {"some": 5}


def test_repeat_rows_keep_hot_customers(spark, monkeypatch):
    monkeypatch.setattr(profile_queries, "train", lambda s, d: orders(spark, 300))
    monkeypatch.setattr(profile_queries, "test", lambda s, d: spark.createDataFrame([("hot", 900, "v1"), ("hot", 901, "v2"), ("few", 902, "v1")], "customer_id string, order_id long, vendor_id string"))
    assert [r.order_id for r in profile_queries.repeat_rows(spark, "").collect()] == [900]


def test_pairs_do_not_depend_on_the_block(spark, monkeypatch):
    e = spark.range(60).select((F.col("id") % 20).alias("u"), (F.col("id") * 7 % 6).alias("i")).union(spark.range(20).select(F.col("id"), F.lit(9).cast("long"))).distinct()
    n, q = e.withColumn("n", F.lit(2)), e.filter("u < 4").select("u").distinct()

    def run():
        made = similarity.swing(e, "u", "i"), similarity.swing(e, "u", "i", q), similarity.cosine(n, "u", "i", q), similarity.jaccard(e, "u", "i", q)
        return [sorted((r.a, r.b, round(r.sim, 9)) for r in df.collect()) for df in made]

    whole = run()
    monkeypatch.setattr(similarity, "BLOCK", 3)
    assert run() == whole and all(whole)
