"""Text rendering and parsing, small set and loss operators, with their oracle statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars
from larder.operators import graph, profiles, samples
from larder.plans.canonical import OI, RES, Registry, order_items, results
from larder.plans.metric_queries import RK, ranked
from larder.plans.ranking_queries import _ADJ, _HIST, _V0, _edges, history
from larder.plans.sample_queries import id_index
from larder.session import durable, table

R = Registry()
r6 = lambda c: F.round(c, 6)


@R.add("SELECT event_id, string_agg(line, chr(10) ORDER BY i) AS lines FROM (SELECT e.event_id, h.i, h.i || '. ' || coalesce(h.t, 'Movie') || ' (rating ≈ ' || printf('%.1f', h.v) || ')' AS line FROM (SELECT event_id, list(struct_pack(t := event_type, v := floor(value)::DOUBLE)) OVER w AS hist, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) e, LATERAL (SELECT unnest(range(1, 4)) AS i, unnest(e.hist).t AS t, unnest(e.hist).v AS v) h WHERE e.rn > 3) GROUP BY 1")
def render_rating_lines(s, d):
    """The three events before each event as numbered lines, their values cut to whole numbers and shown with one decimal."""
    rows = table(s, d, "events").withColumn("seen", F.struct(F.col("event_type").alias("t"), F.floor("value").cast("double").alias("v")))
    h = samples.sliding_histories(rows, "user_id", ["ts", "event_id"], "seen", 3)
    line = lambda x, i: F.format_string("%d. %s (rating ≈ %.1f)", i + 1, F.coalesce(x["t"], F.lit("Movie")), x["v"])
    return h.select("event_id", F.array_join(F.transform("history", line), "\n").alias("lines"))


@R.add("WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```json' || chr(10) ELSE '' END || '{\"predictions\": [{\"cuisine\": \" ' || upper(source) || ' \", \"confidence\": 0.' || (doc_id % 9) || '}, {\"cuisine\": \"' || coalesce(doc_type, '') || '\"}]}' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '```' ELSE '' END AS t FROM documents) SELECT doc_id, trim(lower(source)) AS cuisine, (doc_id % 9) / 10.0::DOUBLE AS confidence FROM documents WHERE trim(source) <> '' UNION ALL SELECT doc_id, trim(lower(doc_type)), 0.5::DOUBLE FROM documents WHERE coalesce(trim(doc_type), '') <> ''")
def parse_predictions(s, d):
    """Predictions from fenced or plain JSON: lower case, trimmed, confidence 0.5 by default, empty names dropped."""
    t = table(s, d, "documents")
    body = F.concat(F.lit('{"predictions": [{"cuisine": " '), F.upper("source"), F.lit(' ", "confidence": 0.'), (F.col("doc_id") % 9).cast("string"), F.lit('}, {"cuisine": "'), F.coalesce("doc_type", F.lit("")), F.lit('"}]}'))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return t.select("doc_id", F.explode(scalars.predictions(text)).alias("p")).select("doc_id", "p.cuisine", "p.confidence")


@R.add("SELECT doc_id, text AS clean FROM documents")
def proj_without_ansi(s, d):
    """Colour codes around a text are stripped again."""
    t = table(s, d, "documents")
    coloured = F.concat(F.lit("\x1b[1;31m"), "text", F.lit("\x1b[0m"))
    return t.select("doc_id", scalars.without_ansi(coloured).alias("clean"))


@R.add(f"WITH {OI}, pd AS (SELECT cuisine, string_agg(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][day_of_week + 1], ', ' ORDER BY rank) AS days FROM (SELECT cuisine, day_of_week, row_number() OVER (PARTITION BY cuisine ORDER BY count(*) DESC, day_of_week) AS rank FROM og GROUP BY 1, 2) WHERE rank <= 3 GROUP BY 1), n AS (SELECT cuisine, count(DISTINCT order_id) AS n_orders FROM oi GROUP BY 1) SELECT cuisine, cuisine || ': ' || n_orders || ' orders, most on ' || days AS summary FROM n JOIN pd USING (cuisine)")
def render_cuisine_summary(s, d):
    p = profiles.cuisine_profiles(order_items(s, d)).filter("peak_days is not null")
    return p.select("cuisine", F.format_string("%s: %d orders, most on %s", "cuisine", "n_orders", F.array_join(F.transform("peak_days", scalars.day_name), ", ")).alias("summary"))


@R.add(f"WITH {_HIST} SELECT result_id, string_agg(cuisine, ',' ORDER BY p) AS cuisines FROM (SELECT result_id, cuisine, min(pos) AS p FROM hist WHERE cuisine IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def set_ordered_distinct(s, d):
    """Distinct cuisines of each history in the order of their first appearance."""
    h = history(s, d).filter("cuisine is not null").groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cuisine"))).alias("l"))
    return h.select("result_id", F.array_join(F.array_distinct(F.transform("l", lambda x: x["cuisine"])), ",").alias("cuisines"))


@R.add(f"WITH {RK}, o AS (SELECT CAST(order_id AS VARCHAR) AS order_id, count(*) AS n_items, count(DISTINCT vendor_id) AS n_vendors FROM food_orders GROUP BY 1) SELECT rk.result_id, rk.customer_id, rk.order_id, final_rank, n_items, n_vendors FROM rk JOIN o ON o.order_id = rk.order_id")
def join_samples_results(s, d):
    """Evaluation records with the basket of their order, joined on the order's id as text."""
    o = table(s, d, "food_orders").groupBy(F.col("order_id").cast("string").alias("order_id")).agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("vendor_id").alias("n_vendors"))
    return ranked(s, d).select("result_id", "customer_id", "order_id", "final_rank").join(o, "order_id").select("result_id", "customer_id", "order_id", "final_rank", "n_items", "n_vendors")


@R.add(f"WITH {OI}, {_ADJ}, l0 AS ({_V0}), v AS (SELECT node, list(x ORDER BY j) AS v FROM l0 GROUP BY 1), its AS (SELECT i, lead(i) OVER (ORDER BY i) AS nxt, first_value(i) OVER (ORDER BY i) AS fst FROM (SELECT DISTINCT i FROM ed)), t AS (SELECT list_dot_product(a.v, p.v) - list_dot_product(a.v, q.v) AS x FROM ed JOIN its USING (i) JOIN v a ON a.node = 'u:' || ed.u JOIN v p ON p.node = 'i:' || ed.i JOIN v q ON q.node = 'i:' || coalesce(its.nxt, its.fst)) SELECT count(*) AS n, round(avg(ln(1 + exp(-x))), 6) AS loss FROM t")
def graph_pairwise_loss(s, d):
    """Mean pairwise ranking loss of the start vectors, each edge against the next item by id."""
    e = _edges(s, d)
    adj = durable(graph.normalised_edges(e))
    v = graph.initial_vectors(adj, 4)
    items = e.select("item").distinct()
    idx = durable(id_index(items, "item"))
    n = F.broadcast(idx.agg(F.count(F.lit(1)).alias("n")))  # one row
    nxt = idx.crossJoin(n).select("item", F.pmod(F.col("idx") + 1, F.col("n")).alias("j")).join(idx.select(F.col("item").alias("neg"), F.col("idx").alias("j")), "j").select("item", "neg")
    node = lambda name, c: v.select(F.col("node").alias(f"{name}_node"), F.col("v").alias(name))
    t = e.join(nxt, "item").join(node("a", v), F.concat(F.lit("u:"), "user") == F.col("a_node")).join(node("p", v), F.concat(F.lit("i:"), "item") == F.col("p_node")).join(node("q", v), F.concat(F.lit("i:"), "neg") == F.col("q_node"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda m, z: m + z)
    return t.select((dot("a", "p") - dot("a", "q")).alias("x")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.log1p(F.exp(-F.col("x"))))).alias("loss"))


@R.add(f"WITH {RES} SELECT result_id, array_to_string([lower(x.cuisine) FOR x IN coalesce(lightgcn_top_cuisines, []) IF x.cuisine IS NOT NULL AND x.score >= 0.5][1:3], ',') AS cuisines FROM res")
def filter_score_threshold(s, d):
    """Embedding cuisines with a score of at least one half, the first three."""
    kept = F.filter(F.coalesce("lightgcn_top_cuisines", F.array().cast("array<struct<cuisine:string,score:double>>")), lambda x: x["cuisine"].isNotNull() & (x["score"] >= 0.5))
    return results(s, d).select("result_id", F.array_join(F.slice(F.transform(kept, lambda x: F.lower(x["cuisine"])), 1, 3), ",").alias("cuisines"))
