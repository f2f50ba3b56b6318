"""Samples, sequences and collaborative filtering, with their oracle statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars
from larder.operators import nearest, profiles, samples, similarity
from larder.plans.canonical import OI, RES, Registry, order_items, results, test, train
from larder.plans.profile_queries import ACTIVE, repeat_rows
from larder.session import durable, table

R = Registry()
r6 = lambda c: F.round(c, 6)


@R.add(f"WITH {OI} SELECT customer_id, order_id, row_id, vendor_id, cuisine, day_num, hour FROM og")
def win_order_grain(s, d):
    return profiles.order_grain(order_items(s, d)).select("customer_id", "order_id", "row_id", "vendor_id", "cuisine", "day_num", "hour")


@R.add(f"WITH {OI} SELECT customer_id, string_agg(order_id || '@' || vendor_id, ',' ORDER BY day_num, hour, order_id) AS history, count(*) AS n FROM (SELECT * FROM og QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY day_num DESC, hour DESC, order_id DESC) <= 10) GROUP BY 1")
def win_histories(s, d):
    h = profiles.histories(order_items(s, d), 10)
    return h.select("customer_id", F.array_join(F.transform("history", lambda x: F.concat_ws("@", x["order_id"].cast("string"), x["vendor_id"])), ",").alias("history"), F.size("history").cast("long").alias("n"))


@R.add(f"WITH {OI} SELECT row_id, customer_id, vendor_id FROM oi WHERE (customer_id, order_id) IN (SELECT (customer_id, order_id) FROM (SELECT customer_id, order_id, row_number() OVER (PARTITION BY customer_id ORDER BY day_num DESC, hour DESC, order_id DESC) AS back FROM og) WHERE back > 1)")
def win_leave_last_out(s, d):
    return samples.leave_last_out(order_items(s, d)).select("row_id", "customer_id", "vendor_id")


@R.add(f"WITH {OI} SELECT customer_id, order_id, cuisine, n_orders FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY day_num DESC, hour DESC, order_id DESC) AS back, count(*) OVER (PARTITION BY customer_id) AS n_orders FROM og) WHERE back = 1 AND n_orders >= 5")
def win_last_order_truth(s, d):
    return samples.last_orders(order_items(s, d), 5).select("customer_id", "order_id", "cuisine", "n_orders")


@R.add(f"WITH {OI} SELECT t.customer_id, t.order_id, t.vendor_id, t.cuisine, n_history FROM gtest t JOIN (SELECT customer_id, count(DISTINCT order_id) AS n_history FROM train GROUP BY 1 HAVING count(DISTINCT order_id) >= 5) USING (customer_id)")
def win_train_test_samples(s, d):
    return samples.train_test_samples(train(s, d), test(s, d), 5).select("customer_id", "order_id", "vendor_id", "cuisine", "n_history")


_REC = "rec AS (SELECT t.customer_id, t.order_id, t.vendor_id, n.n_train, n.n_train - coalesce(l.last_pos, 0) AS recency_distance FROM gtest t JOIN (SELECT customer_id, count(*) AS n_train FROM gtrain GROUP BY 1) n USING (customer_id) LEFT JOIN (SELECT customer_id, vendor_id, max(pos) AS last_pos FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY day_num, hour, order_id) AS pos FROM gtrain) GROUP BY 1, 2) l ON l.customer_id = t.customer_id AND l.vendor_id = t.vendor_id)"


@R.add(f"WITH {OI}, {_REC} SELECT * FROM rec")
def win_recency_distance(s, d):
    return samples.recency_distance(train(s, d), profiles.order_grain(test(s, d))).select("customer_id", "order_id", "vendor_id", "n_train", "recency_distance")


@R.add(f"WITH {OI}, {_REC} SELECT customer_id, order_id, recency_distance FROM rec WHERE recency_distance <= 5")
def filter_recency(s, d):
    return samples.within_recency(win_recency_distance(s, d), 5).select("customer_id", "order_id", "recency_distance")


@R.add("SELECT event_id, user_id, event_type, string_agg(event_type, ',') OVER w AS history FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 5")
def win_sliding_history(s, d):
    h = samples.sliding_histories(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type", 5)
    return h.select("event_id", "user_id", "event_type", F.array_join("history", ",").alias("history"))


@R.add("SELECT event_id, CASE WHEN rn > n - nt THEN 'test' WHEN rn > n - nt - nv THEN 'val' ELSE 'train' END AS part FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n, greatest(floor(count(*) OVER (PARTITION BY user_id) * 0.1), 1) AS nt, greatest(floor(count(*) OVER (PARTITION BY user_id) * 0.05), 1) AS nv FROM events)")
def win_chronological_split(s, d):
    return samples.chronological_split(table(s, d, "events"), "user_id", ["ts", "event_id"], 0.05, 0.1).select("event_id", "part")


@R.add("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 1009, event_id) AS rn FROM events) WHERE rn <= 20")
def top_capped_per_user(s, d):
    return samples.capped(table(s, d, "events"), "user_id", [F.col("event_id") % 1009, F.col("event_id")], 20).select("event_id", "user_id")


@R.add("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60")
def filter_long_sequences(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 60")


@R.add(f"WITH {OI} SELECT order_id, customer_id, CAST(rn AS INT) AS rn FROM (SELECT order_id, customer_id, row_number() OVER (ORDER BY CAST(order_id AS VARCHAR)) AS rn FROM (SELECT order_id, min(customer_id) AS customer_id FROM oi GROUP BY 1)) WHERE rn BETWEEN 11 AND 60")
def top_sample_by_id(s, d):
    o = order_items(s, d).groupBy("order_id").agg(F.min("customer_id").alias("customer_id"))
    return samples.sample_by_id(o, 11, 60).select("order_id", "customer_id", "rn")


@R.add(f"WITH {OI} SELECT customer_id FROM (SELECT DISTINCT customer_id FROM oi) ORDER BY md5(customer_id || ':42'), customer_id LIMIT 100")
def top_random_users(s, d):
    return samples.random_sample(order_items(s, d).select("customer_id").distinct(), "customer_id", 100, 42)


@R.add(f"WITH {OI} SELECT row_id, product_id, cuisine FROM oi WHERE customer_id = (SELECT min(customer_id) FROM oi)")
def filter_point_lookup(s, d):
    o = order_items(s, d)
    return o.join(F.broadcast(o.agg(F.min("customer_id").alias("customer_id"))), "customer_id").select("row_id", "product_id", "cuisine")  # one row


# --- interactions

@R.add(f"WITH {OI} SELECT customer_id, vendor_id FROM oi")
def cf_all_interactions(s, d):
    return order_items(s, d).select("customer_id", "vendor_id")


@R.add(f"WITH {OI} SELECT customer_id, vendor_id AS item FROM og")
def cf_order_interactions(s, d):
    return profiles.order_grain(order_items(s, d)).select("customer_id", F.col("vendor_id").alias("item"))


@R.add(f"WITH {OI} SELECT DISTINCT customer_id, cuisine FROM oi WHERE cuisine <> 'unknown'")
def cf_distinct_interactions(s, d):
    return order_items(s, d).filter("cuisine <> 'unknown'").select("customer_id", "cuisine").distinct()


@R.add(f"WITH {OI} SELECT vendor_id, count(DISTINCT customer_id) AS n_users FROM oi GROUP BY 1")
def cf_item_popularity(s, d):
    return order_items(s, d).select("vendor_id", "customer_id").distinct().groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n_users"))


@R.add(f"WITH {OI} SELECT vendor_id, CAST(row_number() OVER (ORDER BY vendor_id) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT vendor_id FROM oi)")
def cf_id_index(s, d):
    return id_index(order_items(s, d), "vendor_id")


def id_index(rows, column: str):
    """Ids numbered from 0 in sorted order: range-partitioned, counted per partition, then numbered within each."""
    from pyspark.sql.window import Window

    ids = durable(rows.select(column).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id()))  # read twice: the ranges must not be drawn again
    within = ids.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(column)))
    sizes = within.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row per partition
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(before.select("part", "before")), "part").select(column, (F.col("before") + F.col("rn") - 1).cast("long").alias("idx"))


@R.add(f"WITH {OI} SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(customer_id || '|' || vendor_id), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM oi")
def cf_interaction_fingerprint(s, d):
    """Content key of the interactions, independent of their order."""
    e = order_items(s, d).select("customer_id", "vendor_id")
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", "customer_id", "vendor_id").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


# --- similarity

_SWING = """edges AS (SELECT DISTINCT customer_id, vendor_id FROM {src}), du AS (SELECT customer_id, count(*) AS deg FROM edges GROUP BY 1), dv AS (SELECT vendor_id, count(*) AS deg FROM edges GROUP BY 1),
sw AS (SELECT x.vendor_id AS a, y.vendor_id AS b, sum(1.0 / (du.deg + 1.0)) * pow(any_value(p.deg) + 5.0, -0.3) * pow(any_value(q.deg) + 5.0, -0.3) AS sim FROM edges x JOIN edges y ON x.customer_id = y.customer_id AND x.vendor_id <> y.vendor_id JOIN du ON du.customer_id = x.customer_id JOIN dv p ON p.vendor_id = x.vendor_id JOIN dv q ON q.vendor_id = y.vendor_id GROUP BY 1, 2)"""
_TOP = "SELECT a, b, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS rank FROM {t}) WHERE rank <= {k}"


def vendor_edges(rows):
    """Distinct interactions, cut: similarity reads them several times."""
    return durable(rows.select("customer_id", "vendor_id").distinct())


def query_users(s, d):
    return durable(repeat_rows(s, d).select("customer_id").distinct())


@R.add(f"WITH {OI}, {_SWING.format(src='oi')} {_TOP.format(t='sw', k=10)}")
def cf_item_swing(s, d):
    return similarity.top_similar(similarity.swing(vendor_edges(order_items(s, d)), "vendor_id", "customer_id"), 10).withColumn("sim", r6("sim"))


@R.add(f"WITH {OI}, {ACTIVE}, {_SWING.format(src='repeats')} {_TOP.format(t='sw', k=5)}")
def repeat_item_swing_topk(s, d):
    """Repeat orders of active customers, item-item Swing over them, the five nearest vendors of each."""
    return similarity.top_similar(similarity.swing(vendor_edges(repeat_rows(s, d)), "vendor_id", "customer_id"), 5).withColumn("sim", r6("sim"))


_QUERY = "query_users AS (SELECT DISTINCT customer_id FROM repeats)"
_ITEM = "vendor_id || '||' || product_id"


@R.add(f"""WITH {OI}, {ACTIVE}, {_QUERY}, edges AS (SELECT DISTINCT customer_id, {_ITEM} AS item FROM train), du AS (SELECT customer_id, count(*) AS deg FROM edges GROUP BY 1), di AS (SELECT item, count(*) AS deg FROM edges GROUP BY 1),
sw AS (SELECT x.customer_id AS a, y.customer_id AS b, sum(1.0 / (di.deg + 1.0)) * pow(any_value(p.deg) + 5.0, -0.3) * pow(any_value(q.deg) + 5.0, -0.3) AS sim FROM edges x JOIN edges y ON x.item = y.item AND x.customer_id <> y.customer_id JOIN di ON di.item = x.item JOIN du p ON p.customer_id = x.customer_id JOIN du q ON q.customer_id = y.customer_id WHERE x.customer_id IN (SELECT customer_id FROM query_users) GROUP BY 1, 2) {_TOP.format(t='sw', k=5)}""")
def cf_user_swing(s, d):
    edges = durable(train(s, d).select("customer_id", F.concat_ws("||", "vendor_id", "product_id").alias("item")).distinct())
    return nearest.nearest(edges, "customer_id", "item", query_users(s, d), 5, "swing").withColumn("sim", r6("sim"))


@R.add(f"""WITH {OI}, {ACTIVE}, {_QUERY}, c AS (SELECT customer_id, vendor_id, count(*) AS n FROM train GROUP BY 1, 2), nm AS (SELECT customer_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM c GROUP BY 1),
cs AS (SELECT x.customer_id AS a, y.customer_id AS b, sum(x.n * y.n) / (any_value(p.norm) * any_value(q.norm)) AS sim FROM c x JOIN c y ON x.vendor_id = y.vendor_id AND x.customer_id <> y.customer_id JOIN nm p ON p.customer_id = x.customer_id JOIN nm q ON q.customer_id = y.customer_id WHERE x.customer_id IN (SELECT customer_id FROM query_users) GROUP BY 1, 2) {_TOP.format(t='cs', k=5)}""")
def cf_user_cosine(s, d):
    c = durable(train(s, d).groupBy("customer_id", "vendor_id").agg(F.count(F.lit(1)).alias("n")))
    return nearest.nearest(c, "customer_id", "vendor_id", query_users(s, d), 5, "cosine").withColumn("sim", r6("sim"))


@R.add(f"""WITH {OI}, {ACTIVE}, {_QUERY}, e AS (SELECT DISTINCT customer_id, vendor_id FROM train), dg AS (SELECT customer_id, count(*) AS deg FROM e GROUP BY 1),
jc AS (SELECT x.customer_id AS a, y.customer_id AS b, count(*) / (any_value(p.deg) + any_value(q.deg) - count(*)) AS sim FROM e x JOIN e y ON x.vendor_id = y.vendor_id AND x.customer_id <> y.customer_id JOIN dg p ON p.customer_id = x.customer_id JOIN dg q ON q.customer_id = y.customer_id WHERE x.customer_id IN (SELECT customer_id FROM query_users) GROUP BY 1, 2) {_TOP.format(t='jc', k=5)}""")
def cf_user_jaccard(s, d):
    return nearest.nearest(vendor_edges(train(s, d)), "customer_id", "vendor_id", query_users(s, d), 5, "jaccard").withColumn("sim", r6("sim"))


_CAND = f"""seen AS (SELECT DISTINCT customer_id, vendor_id AS item FROM train), near AS (SELECT s.customer_id, sw.a, sw.b, sw.sim FROM seen s JOIN sw ON sw.a = s.item WHERE NOT EXISTS (SELECT 1 FROM seen z WHERE z.customer_id = s.customer_id AND z.item = sw.b)),
best AS (SELECT customer_id, b AS item, max(sim) AS score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, a ORDER BY round(sim, 12) DESC, b) AS rn FROM near) WHERE rn <= 5 GROUP BY 1, 2)"""


@R.add(f"WITH {OI}, {_SWING.format(src='train')}, {_CAND} SELECT customer_id, item, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(score, 12) DESC, item) AS rank FROM best) WHERE rank <= 10")
def top_history_candidates(s, d):
    e = vendor_edges(train(s, d))
    out = similarity.history_candidates(e.withColumnRenamed("vendor_id", "item"), similarity.swing(e, "vendor_id", "customer_id"), 5, 10)
    return out.withColumn("score", r6("score")).select("customer_id", "item", "score", "rank")


@R.add(f"WITH {OI}, {_SWING.format(src='train')} SELECT s.customer_id, t.a, t.b, t.sim, t.rank FROM (SELECT DISTINCT customer_id, vendor_id FROM train) s JOIN (SELECT a, b, round(sim, 4) AS sim, CAST(row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS INT) AS rank FROM sw) t ON t.a = s.vendor_id WHERE t.rank <= 3")
def top_neighbours_per_seed(s, d):
    """The nearest vendors of each vendor of a history, seen ones included."""
    e = vendor_edges(train(s, d))
    near = similarity.top_similar(similarity.swing(e, "vendor_id", "customer_id"), 3).withColumn("sim", F.round("sim", 4))
    return e.join(near, e["vendor_id"] == near["a"]).select("customer_id", "a", "b", "sim", "rank")


@R.add(f"""WITH {RES}, peers AS (SELECT r.result_id, u.user_id, u.similarity, u.records FROM res r, unnest(r.similar_users) AS t(u) WHERE u IS NOT NULL AND u.user_id IS NOT NULL AND u.similarity IS NOT NULL),
own AS (SELECT r.result_id, h.cuisine FROM res r, unnest(r.order_history_tuples) AS t(h) WHERE h IS NOT NULL AND h.cuisine IS NOT NULL),
w AS (SELECT DISTINCT p.result_id, p.user_id, p.similarity, x.cuisine FROM peers p, unnest(p.records) AS t(x) WHERE x IS NOT NULL AND x.cuisine IS NOT NULL)
SELECT result_id, cuisine, round(sum(similarity), 6) AS score FROM w WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.result_id = w.result_id AND o.cuisine = w.cuisine) GROUP BY 1, 2""")
def agg_weighted_unseen_cuisines(s, d):
    """Similarity-weighted votes of similar users for cuisines outside the own history."""
    r = results(s, d)
    peers = r.select("result_id", F.explode("similar_users").alias("u")).filter("u.user_id is not null and u.similarity is not null")
    votes = peers.select("result_id", "u.user_id", "u.similarity", F.explode("u.records").alias("x")).filter("x.cuisine is not null").select("result_id", "user_id", "similarity", "x.cuisine").distinct()
    own = r.select("result_id", F.explode("order_history_tuples").alias("h")).select("result_id", "h.cuisine")
    return votes.join(own, ["result_id", "cuisine"], "left_anti").groupBy("result_id", "cuisine").agg(r6(F.sum("similarity")).alias("score"))


@R.add("WITH g AS (SELECT customer_id, order_id, arg_max(result_id, row(written_at, result_id)) AS result_id FROM stage9_repeat_detailed GROUP BY 1, 2) SELECT DISTINCT d.customer_id, d.order_id FROM stage9_repeat_detailed d WHERE NOT EXISTS (SELECT 1 FROM stage9_repeat_raw r WHERE contains(r.line, d.order_id))")
def sink_resume_missing(s, d):
    """Samples of the detailed results that no raw run mentions: what a resumed run would still have to do."""
    done = table(s, d, "stage9_repeat_raw").select(F.regexp_extract("line", r'"order_id": ?"?(\d+)', 1).alias("order_id")).filter("order_id <> ''").distinct()
    return table(s, d, "stage9_repeat_detailed").select("customer_id", "order_id").distinct().join(done, "order_id", "left_anti")
