"""Candidates, rankings, response parsing, prompts and graph embeddings, with their oracle statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars
from larder.operators import graph, profiles, ranking, similarity
from larder.plans.canonical import OI, RES, Registry, order_items, results, train
from larder.plans.sample_queries import _SWING, vendor_edges
from larder.session import durable, table

R = Registry()
r6 = lambda c: F.round(c, 6)
empty = lambda: F.array().cast("array<string>")


@R.add(f"WITH {OI} SELECT vendor_geohash, cuisine, vendor_id, CAST(row_number() OVER (PARTITION BY vendor_geohash, cuisine ORDER BY vendor_id) AS INT) AS pos FROM (SELECT DISTINCT vendor_geohash, cuisine, vendor_id FROM oi)")
def rank_place_index(s, d):
    return ranking.place_index(order_items(s, d))


@R.add(f"WITH {OI} SELECT vendor_id, arg_max(vendor_geohash, row_id) AS vendor_geohash, arg_max(cuisine, row_id) AS cuisine FROM oi GROUP BY 1")
def rank_vendor_metadata(s, d):
    return ranking.vendor_metadata(order_items(s, d))


_WANTED = f"wanted AS (SELECT customer_id AS sample, any_value(home) AS vendor_geohash, cuisine, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, cuisine) AS INT) AS cuisine_pos FROM (SELECT customer_id, cuisine, count(*) AS n, max(vendor_geohash) AS home FROM og GROUP BY 1, 2) GROUP BY customer_id, cuisine, n QUALIFY cuisine_pos <= 3)"


@R.add(f"WITH {OI}, {_WANTED}, idx AS (SELECT vendor_geohash, cuisine, vendor_id, CAST(row_number() OVER (PARTITION BY vendor_geohash, cuisine ORDER BY vendor_id) AS INT) AS pos FROM (SELECT DISTINCT vendor_geohash, cuisine, vendor_id FROM oi)), t AS (SELECT w.sample, i.vendor_id, min(i.pos * 1000 + w.cuisine_pos) AS turn FROM wanted w JOIN idx i USING (vendor_geohash, cuisine) GROUP BY 1, 2) SELECT sample, vendor_id, CAST(row_number() OVER (PARTITION BY sample ORDER BY turn, vendor_id) AS INT) AS rank FROM t QUALIFY rank <= 10")
def rank_round_robin(s, d):
    """Vendors for the three most frequent cuisines of every customer, in turn, at a place where they bought each."""
    o = order_items(s, d)
    n = profiles.order_grain(o).groupBy("customer_id", "cuisine").agg(F.count(F.lit(1)).alias("n"), F.max("vendor_geohash").alias("vendor_geohash"))
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("n"), "cuisine"))
    wanted = n.withColumn("cuisine_pos", pos).filter("cuisine_pos <= 3").select(F.col("customer_id").alias("sample"), "vendor_geohash", "cuisine", "cuisine_pos")
    return ranking.round_robin(wanted, ranking.place_index(o), 10)


_HIST = f"{RES}, hist AS (SELECT result_id, CAST(i AS INT) AS pos, h.vendor_id AS vendor_id, h.cuisine AS cuisine FROM (SELECT result_id, unnest(order_history_tuples) AS h, generate_subscripts(order_history_tuples, 1) AS i FROM res) WHERE h IS NOT NULL)"


def history(s, d):
    e = results(s, d).select("result_id", F.posexplode("order_history_tuples").alias("i", "h")).filter("h is not null")
    return e.select("result_id", (F.col("i") + 1).alias("pos"), "h.vendor_id", "h.cuisine")


@R.add(f"WITH {_HIST} SELECT result_id, cuisine, count(*) AS n, CAST(row_number() OVER (PARTITION BY result_id ORDER BY count(*) DESC, min(pos)) AS INT) AS rank FROM hist WHERE cuisine IS NOT NULL GROUP BY 1, 2 QUALIFY rank <= 2")
def rank_most_common(s, d):
    return ranking.most_common(history(s, d), "result_id", "cuisine", "pos", 2).select("result_id", "cuisine", "n", "rank")


_TOP2 = "top2 AS (SELECT result_id, list(cuisine ORDER BY rank) AS freq FROM (SELECT result_id, cuisine, row_number() OVER (PARTITION BY result_id ORDER BY count(*) DESC, min(pos)) AS rank FROM hist WHERE cuisine IS NOT NULL GROUP BY 1, 2) WHERE rank <= 2 GROUP BY 1)"


@R.add(f"WITH {_HIST}, {_TOP2}, p AS (SELECT r.result_id, [x FOR x IN coalesce(r.round1_predicted_cuisines, []) IF x IS NOT NULL] AS p, coalesce(t.freq, []) AS f FROM res r LEFT JOIN top2 t USING (result_id)), m AS (SELECT *, [x FOR x IN f IF NOT list_contains(p, x)][1] AS miss FROM p) SELECT result_id, array_to_string(CASE WHEN miss IS NULL THEN p WHEN len(p) = 0 THEN [miss] ELSE list_append(p[1:len(p) - 1], miss) END, ',') AS cuisines FROM m")
def rank_frequency_ensemble(s, d):
    top = ranking.most_common(history(s, d), "result_id", "cuisine", "pos", 2).groupBy("result_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cuisine"))), lambda x: x["cuisine"]).alias("f"))
    p = results(s, d).select("result_id", F.filter(F.coalesce("round1_predicted_cuisines", empty()), lambda x: x.isNotNull()).alias("p")).join(top, "result_id", "left")
    return p.select("result_id", F.array_join(ranking.with_frequent(F.col("p"), F.coalesce("f", empty())), ",").alias("cuisines"))


_CANDS = f"{_HIST}, cands AS (SELECT result_id, list(item ORDER BY first_pos) AS c FROM (SELECT result_id, vendor_id || '||' || cuisine AS item, min(pos) AS first_pos FROM hist WHERE vendor_id IS NOT NULL AND cuisine IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


def candidates(s, d):
    """The distinct vendor-cuisine items of each sample's history in order of first appearance."""
    h = history(s, d).filter("vendor_id is not null and cuisine is not null").groupBy("result_id", scalars.item_of("vendor_cuisine").alias("item")).agg(F.min("pos").alias("first"))
    return h.groupBy("result_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "item"))), lambda x: x["item"]).alias("c"))


@R.add(f"WITH {_CANDS}, r AS (SELECT c.result_id, c.c, list_distinct_first.low FROM cands c JOIN (SELECT result_id, [x FOR x, i IN l IF list_position(l, x) = i] AS low FROM (SELECT result_id, [lower(trim(x)) FOR x IN coalesce(final_ranking, []) IF x IS NOT NULL] AS l FROM res)) list_distinct_first USING (result_id)) SELECT result_id, array_to_string(list_concat([[y FOR y IN c IF lower(y) = x][1] FOR x IN low IF len([y FOR y IN c IF lower(y) = x]) > 0], [y FOR y IN c IF NOT list_contains(low, lower(y))]), ',') AS ranking FROM r")
def rank_repaired(s, d):
    j = candidates(s, d).join(results(s, d).select("result_id", "final_ranking"), "result_id")
    return j.select("result_id", F.array_join(ranking.repaired(F.col("final_ranking"), F.col("c")), ",").alias("ranking"))


@R.add(f"WITH {_CANDS}, r AS (SELECT result_id, c, lower(coalesce(round2_raw_response, '')) AS t FROM cands JOIN res USING (result_id)) SELECT result_id, array_to_string(list_concat([y FOR y IN c IF contains(t, lower(y))], [y FOR y IN c IF NOT contains(t, lower(y))]), ',') AS ranking FROM r")
def rank_mentions(s, d):
    j = candidates(s, d).join(results(s, d).select("result_id", "round2_raw_response"), "result_id")
    return j.select("result_id", F.array_join(ranking.mentioned_first(F.col("round2_raw_response"), F.col("c")), ",").alias("ranking"))


@R.add(f"WITH {_CANDS}, r AS (SELECT result_id, c, lower(trim(coalesce(round2_raw_response, ''))) AS t FROM cands JOIN res USING (result_id)) SELECT result_id, coalesce([y FOR y IN c IF lower(y) = t][1], [y FOR y IN c IF contains(t, lower(y))][1], c[1]) AS pick FROM r")
def rank_single_pick(s, d):
    j = candidates(s, d).join(results(s, d).select("result_id", "round2_raw_response"), "result_id")
    return j.select("result_id", ranking.single_pick(F.col("round2_raw_response"), F.col("c")).alias("pick"))


@R.add(f"WITH {_CANDS}, r AS (SELECT cands.result_id, c, ground_truth AS g, len(c) AS n FROM cands JOIN res USING (result_id) WHERE ground_truth IS NOT NULL), k AS (SELECT *, CASE WHEN n >= 8 THEN c[1:7] ELSE c END AS kept, CASE WHEN n <= 1 THEN n ELSE 1 + result_id % greatest(n - 1, 1) END AS a FROM r) SELECT result_id, array_to_string(CASE WHEN list_contains(c, g) THEN c ELSE list_concat(list_append(kept[1:least(a, len(kept))], g), kept[least(a, len(kept)) + 1:]) END, ',') AS cands FROM k")
def rank_injected_truth(s, d):
    j = candidates(s, d).join(results(s, d).select("result_id", F.col("ground_truth").alias("g")), "result_id").filter("g is not null")
    return j.select("result_id", F.array_join(ranking.injected(F.col("c"), F.col("g"), F.col("result_id"), 8), ",").alias("cands"))


@R.add(f"WITH {_CANDS} SELECT result_id, (SELECT string_agg(x, ',' ORDER BY (result_id + 1) * i * 7919 % 10007, i) FROM (SELECT unnest(c) AS x, generate_subscripts(c, 1) AS i)) AS shuffled FROM cands")
def rank_hash_shuffle(s, d):
    return candidates(s, d).select("result_id", F.array_join(ranking.hash_order(F.col("c"), F.col("result_id")), ",").alias("shuffled"))


_PEERS = f"{RES}, peers AS (SELECT result_id, CAST(pi AS INT) AS peer_pos, CAST(ri AS INT) AS pos, r.vendor_id AS vendor_id, lower(r.cuisine) AS cuisine, preds FROM (SELECT result_id, pi, preds, unnest(u.records) AS r, generate_subscripts(u.records, 1) AS ri FROM (SELECT result_id, [lower(x) FOR x IN coalesce(round1_predicted_cuisines, []) IF x IS NOT NULL] AS preds, unnest(similar_users) AS u, generate_subscripts(similar_users, 1) AS pi FROM res) WHERE u IS NOT NULL) WHERE r IS NOT NULL AND list_contains(preds, lower(r.cuisine)))"


@R.add(f"WITH {_PEERS}, l AS (SELECT *, row_number() OVER (PARTITION BY result_id, peer_pos ORDER BY pos DESC) AS back FROM peers), k AS (SELECT * FROM l WHERE back <= 5), n AS (SELECT result_id, peer_pos, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT result_id, peer_pos, 20 - coalesce(sum(n) OVER (PARTITION BY result_id ORDER BY peer_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM n) SELECT k.result_id, k.peer_pos, k.pos, k.vendor_id, k.cuisine FROM k JOIN r USING (result_id, peer_pos) WHERE back <= room")
def rank_peer_evidence(s, d):
    """Records of similar users in the predicted cuisines: five a user, twenty in all."""
    r = results(s, d).select("result_id", F.transform(F.filter(F.coalesce("round1_predicted_cuisines", empty()), lambda x: x.isNotNull()), lambda x: F.lower(x)).alias("p"), F.posexplode("similar_users").alias("pi", "u"))
    e = r.filter("u is not null").select(F.col("result_id").alias("sample"), "p", (F.col("pi") + 1).alias("peer_pos"), F.posexplode("u.records").alias("ri", "r")).filter("r is not null").select("sample", "p", "peer_pos", (F.col("ri") + 1).alias("pos"), "r.vendor_id", F.lower("r.cuisine").alias("cuisine"))
    e = e.filter(F.array_contains("p", F.col("cuisine")))
    return ranking.capped_evidence(e, 5, 20).select(F.col("sample").alias("result_id"), "peer_pos", "pos", "vendor_id", "cuisine")


# --- response parsing and prompts

@R.add("SELECT result_id, array_to_string([x FOR x IN from_json(nullif(regexp_extract(coalesce(round1_raw_response, ''), '(?s)(\\{[^{}]*\"cuisines\"[^{}]*\\})', 1), ''), '{\"cuisines\": [\"VARCHAR\"]}').cuisines IF x IS NOT NULL], ',') AS cuisines FROM stage9_repeat_detailed WHERE json_valid(nullif(regexp_extract(coalesce(round1_raw_response, ''), '(?s)(\\{[^{}]*\"cuisines\"[^{}]*\\})', 1), ''))")
def parse_embedded_json(s, d):
    t = table(s, d, "stage9_repeat_detailed").select("result_id", scalars.embedded_list(F.col("round1_raw_response"), "cuisines").alias("c")).filter("c is not null")
    return t.select("result_id", F.array_join("c", ",").alias("cuisines"))


@R.add("SELECT result_id, CASE WHEN contains(round1_raw_response, '```') THEN trim(regexp_extract(round1_raw_response, '(?s)```(?:json)?(.*?)(?:```|$)', 1)) ELSE trim(round1_raw_response) END AS body FROM stage9_repeat_detailed WHERE round1_raw_response IS NOT NULL")
def parse_code_fence(s, d):
    return table(s, d, "stage9_repeat_detailed").filter("round1_raw_response is not null").select("result_id", scalars.fenced(F.col("round1_raw_response")).alias("body"))


@R.add("WITH v AS (SELECT list(DISTINCT primary_cuisine ORDER BY primary_cuisine) AS names FROM vendors) SELECT result_id, array_to_string([x FOR x IN names IF contains(lower(coalesce(round1_raw_response, '')), lower(x))][1:5], ',') AS mentions FROM stage9_repeat_detailed, v")
def parse_mentions(s, d):
    """Known cuisines that a response mentions, the first five in order."""
    names = table(s, d, "vendors").select("primary_cuisine").filter("primary_cuisine is not null").distinct().agg(F.array_sort(F.collect_list("primary_cuisine")).alias("names"))  # a controlled vocabulary
    low = F.lower(F.coalesce("round1_raw_response", F.lit("")))
    return table(s, d, "stage9_repeat_detailed").crossJoin(F.broadcast(names)).select("result_id", F.array_join(F.slice(F.filter("names", lambda x: F.contains(low, F.lower(x))), 1, 5), ",").alias("mentions"))


@R.add(f"WITH {_HIST} SELECT result_id, string_agg(pos || '. ' || coalesce(vendor_id, '?') || '||' || coalesce(cuisine, '?') || CASE WHEN pos > n - 3 THEN ' [MOST RECENT]' ELSE '' END, chr(10) ORDER BY pos) AS prompt FROM (SELECT *, max(pos) OVER (PARTITION BY result_id) AS n FROM hist) GROUP BY 1")
def render_history(s, d):
    """The history part of a prompt: one numbered line per order, the last three marked."""
    from pyspark.sql.window import Window

    h = history(s, d).withColumn("n", F.max("pos").over(Window.partitionBy("result_id")))
    line = F.concat(F.col("pos").cast("string"), F.lit(". "), F.coalesce("vendor_id", F.lit("?")), F.lit("||"), F.coalesce("cuisine", F.lit("?")), F.when(F.col("pos") > F.col("n") - 3, " [MOST RECENT]").otherwise(""))
    lines = h.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))).alias("l"))
    return lines.select("result_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("prompt"))


@R.add(f"WITH {RES} SELECT result_id, 'user: ' || round1_prompt || ' assistant: ' || coalesce(round1_raw_response, '') AS chat, 2 + (coalesce(round1_raw_response, '') <> '')::INT AS n_messages FROM res")
def render_chat(s, d):
    """Chat records: system, user and, where there is an answer, assistant messages."""
    answer = F.coalesce("round1_raw_response", F.lit(""))
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    msgs = F.filter(F.array(m("system", F.lit("You recommend food delivery.")), m("user", F.col("round1_prompt")), m("assistant", answer)), lambda x: x["content"] != "")
    r = results(s, d).select("result_id", "round1_prompt", answer.alias("answer"), msgs.alias("messages"))
    return r.select("result_id", F.concat(F.lit("user: "), "round1_prompt", F.lit(" assistant: "), "answer").alias("chat"), F.size("messages").alias("n_messages"))


@R.add(f"WITH {_HIST}, c AS (SELECT DISTINCT result_id, vendor_id, cuisine FROM hist WHERE vendor_id IS NOT NULL AND cuisine IS NOT NULL), n AS (SELECT result_id, max(pos) AS n FROM hist GROUP BY 1), v AS (SELECT result_id, vendor_id, count(*) AS freq, max(pos) AS last FROM hist GROUP BY 1, 2), q AS (SELECT result_id, cuisine, count(*) AS cfreq FROM hist GROUP BY 1, 2), z AS (SELECT c.*, 0.5::DOUBLE * coalesce(freq, 0) / n + 0.3::DOUBLE * coalesce(last, 0) / n + 0.2::DOUBLE * coalesce(cfreq, 0) / n AS score FROM c JOIN n USING (result_id) LEFT JOIN v USING (result_id, vendor_id) LEFT JOIN q USING (result_id, cuisine)) SELECT result_id, vendor_id, cuisine, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY result_id ORDER BY round(score, 9) DESC, vendor_id, cuisine) AS INT) AS rank FROM z")
def rank_offline_pipeline(s, d):
    """All samples through candidates, offline scores and ranking in one plan."""
    from pyspark.sql.window import Window

    h = history(s, d).withColumnRenamed("result_id", "sample")
    c = h.filter("vendor_id is not null and cuisine is not null").select("sample", "vendor_id", "cuisine").distinct()
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc(F.round("score", 9)), "vendor_id", "cuisine"))
    return ranking.offline_scores(h, c).withColumn("rank", rank).select(F.col("sample").alias("result_id"), "vendor_id", "cuisine", r6("score").alias("score"), "rank")


@R.add(f"WITH {RES} SELECT result_id, regexp_extract(coalesce(round1_prompt, ''), '\\|\\|([a-z ]+)', 1) AS response FROM res")
def rank_scorer_interface(s, d):
    """Prompts through the pluggable scorer, here one that answers with the first listed item."""
    def first_item(batch):
        return batch["round1_prompt"].str.extract(r"\|\|([a-z ]+)", expand=False).fillna("")

    return ranking.scored(results(s, d).select("result_id", "round1_prompt"), first_item).select("result_id", "response")


@R.add(f"WITH {OI}, own AS (SELECT customer_id, cuisine, rank FROM (SELECT customer_id, cuisine, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, cuisine) AS rank FROM gtrain GROUP BY 1, 2) WHERE rank <= 5), pop AS (SELECT cuisine, row_number() OVER (ORDER BY count(*) DESC, cuisine) AS rank FROM gtrain GROUP BY 1), fill AS (SELECT u.customer_id, p.cuisine, 1000 + p.rank AS rank FROM (SELECT DISTINCT customer_id FROM gtrain) u, pop p), al AS (SELECT customer_id, cuisine, min(rank) AS rank FROM (SELECT * FROM own UNION ALL SELECT * FROM fill) GROUP BY 1, 2) SELECT customer_id, cuisine, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY rank) AS INT) AS rank FROM al QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY rank) <= 8")
def rank_hybrid_candidates(s, d):
    """Own frequent cuisines first, then the most popular ones, eight in all."""
    from pyspark.sql.window import Window

    g = profiles.order_grain(train(s, d))
    own = profiles.top_categories(g, "customer_id", "cuisine", 5).select("customer_id", "cuisine", F.col("rank").cast("long").alias("rank"))
    pop = g.groupBy("cuisine").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cuisine").limit(13)  # own five and eight more suffice
    order = F.broadcast(pop.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "cuisine"))), lambda x: x["cuisine"]).alias("l")))
    fill = g.select("customer_id").distinct().crossJoin(order).select("customer_id", F.posexplode("l").alias("i", "cuisine")).select("customer_id", "cuisine", (F.col("i") + 1001).cast("long").alias("rank"))
    best = own.unionByName(fill).groupBy("customer_id", "cuisine").agg(F.min("rank").alias("r"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("customer_id").orderBy("r"))).filter("rank <= 8").select("customer_id", "cuisine", "rank")


@R.add(f"WITH {OI}, {_SWING.format(src='train')}, near AS (SELECT a, string_agg(b, ',' ORDER BY rank) AS similar_vendors FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS rank FROM sw) WHERE rank <= 3 GROUP BY 1), topv AS (SELECT customer_id, vendor_id FROM (SELECT customer_id, vendor_id, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, vendor_id) AS rank FROM gtrain GROUP BY 1, 2) WHERE rank = 1) SELECT customer_id, vendor_id, similar_vendors FROM topv LEFT JOIN near ON near.a = topv.vendor_id")
def rank_customer_lookups(s, d):
    """What a recommender looks up per customer: the favourite vendor and its nearest ones."""
    t = train(s, d)
    near = similarity.top_similar(similarity.swing(vendor_edges(t), "vendor_id", "customer_id"), 3)
    lists = near.groupBy("a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), ",").alias("similar_vendors"))
    top = profiles.top_categories(profiles.order_grain(t), "customer_id", "vendor_id", 1).select("customer_id", "vendor_id")
    return top.join(lists, top["vendor_id"] == lists["a"], "left").select("customer_id", "vendor_id", "similar_vendors")


# --- graph

def _edges(s, d):
    return durable(train(s, d).select(F.col("customer_id").alias("user"), F.col("vendor_id").alias("item")).distinct())


_ADJ = "ed AS (SELECT DISTINCT customer_id AS u, vendor_id AS i FROM train), fw AS (SELECT 'u:' || ed.u AS src, 'i:' || ed.i AS dst, 1.0::DOUBLE / sqrt(a.n::DOUBLE * b.n) AS w FROM ed JOIN (SELECT u, count(*) AS n FROM ed GROUP BY 1) a USING (u) JOIN (SELECT i, count(*) AS n FROM ed GROUP BY 1) b USING (i)), adj AS (SELECT src, dst, w FROM fw UNION ALL SELECT dst, src, w FROM fw)"


@R.add(f"WITH {OI}, {_ADJ} SELECT src, dst, round(w, 6) AS w FROM adj")
def graph_adjacency(s, d):
    return graph.normalised_edges(_edges(s, d)).withColumn("w", r6("w"))


_V0 = "SELECT node, ((ascii(node[-1:]) * 31 + ascii(node[-2:-2]) * 17 + length(node)) * (j + 3) * 37 % 101) / 101.0::DOUBLE - 0.5::DOUBLE AS x, j FROM (SELECT DISTINCT src AS node FROM adj), (SELECT unnest(range(0, 4)) AS j)"
_STEP = "SELECT a.src AS node, sum(a.w * l.x) AS x, l.j FROM adj a JOIN {0} l ON l.node = a.dst GROUP BY 1, 3"


@R.add(f"WITH {OI}, {_ADJ}, l0 AS ({_V0}), l1 AS ({_STEP.format('l0')}), l2 AS ({_STEP.format('l1')}), l3 AS ({_STEP.format('l2')}) SELECT node, CAST(j AS INT) AS j, round(sum(x) / 4.0::DOUBLE, 6) AS x FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1, 2")
def graph_propagation(s, d):
    adj = durable(graph.normalised_edges(_edges(s, d)))
    v = graph.propagate(adj, graph.initial_vectors(adj, 4), 3, 4)
    return v.select("node", F.posexplode("v").alias("j", "x")).withColumn("x", r6("x"))


@R.add()
def graph_trained_embeddings(s, d):
    return graph.train(_edges(s, d), dims=64, epochs=50).select("node", "v", F.size("v").alias("dims"))


@R.add("WITH e AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0) SELECT q.vec_id AS query, e.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS INT) AS rank FROM q, e WHERE q.vec_id <> e.vec_id QUALIFY rank <= 10")
def graph_top_by_dot(s, d):
    """A search: every vector whose id is divisible by 20 against all vectors."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.top_by_dot(e.filter("id % 20 = 0"), e, 10).withColumn("score", F.round("score", 5))


@R.add("WITH e AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0), l AS (SELECT label, list(avg_x ORDER BY j) AS c FROM (SELECT label, j, avg(x) AS avg_x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM embeddings) GROUP BY 1, 2) GROUP BY 1) SELECT q.vec_id, l.label, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], l.c), 9) DESC, l.label) AS INT) AS rank FROM q, l")
def graph_rerank_labels(s, d):
    """Labels reranked for each query vector by the score of their mean vector."""
    e = table(s, d, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("j", "x")).groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda t: t["x"]).alias("v"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    top = graph.top_by_dot(q, c.select(F.col("label").alias("id"), "v"), 1000, exclude_self=False)
    return top.select(F.col("query").alias("vec_id"), F.col("item").cast("int").alias("label"), "rank")
