"""Metrics and result exploration over evaluation records, with their oracle statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import scalars
from larder.operators import metrics
from larder.plans.canonical import RES, Registry, results
from larder.session import shuffle_width, table

R = Registry()
r6 = lambda c: F.round(c, 6)


def ranked(s, d):
    """Evaluation records with the ranks of the truth in the three rankings and what the breakdowns use."""
    r = results(s, d)
    lg = F.transform("lightgcn_top_cuisines", lambda x: x["cuisine"])
    hist = F.filter(F.coalesce("order_history_tuples", F.array().cast("array<struct<vendor_id:string,cuisine:string,slot:string>>")), lambda x: x.isNotNull())
    sims = F.filter(F.transform("similar_users", lambda u: u["similarity"]), lambda x: x.isNotNull())
    return r.select(
        "result_id", "customer_id", "order_id", "ground_truth", "ground_truth_cuisine", "ground_truth_vendor_id", "target_hour", "target_day_of_week", "candidate_count", "round1_llm_ms", "round2_llm_ms",
        F.coalesce("error", F.lit(False)).alias("error"), "final_ranking", "round1_predicted_cuisines",
        scalars.rank_of(F.col("final_ranking"), F.col("ground_truth")).alias("final_rank"),
        scalars.rank_of(F.col("round1_predicted_cuisines"), F.col("ground_truth_cuisine")).alias("r1_rank"),
        scalars.rank_of(lg, F.col("ground_truth_cuisine")).alias("lg_rank"),
        F.size(hist).cast("long").alias("history_len"), hist.alias("hist"), sims.alias("sims"),
    )


_L = "[lower(x) FOR x IN {0}]"
RK = f"""{RES}, rk AS (SELECT result_id, customer_id, order_id, ground_truth, ground_truth_cuisine, ground_truth_vendor_id, target_hour, target_day_of_week, candidate_count, round1_llm_ms, round2_llm_ms, coalesce(error, false) AS error, final_ranking, round1_predicted_cuisines,
  CAST(coalesce(list_position({_L.format('final_ranking')}, lower(ground_truth)), 0) AS INT) AS final_rank, CAST(coalesce(list_position({_L.format('round1_predicted_cuisines')}, lower(ground_truth_cuisine)), 0) AS INT) AS r1_rank,
  CAST(coalesce(list_position([lower(x.cuisine) FOR x IN lightgcn_top_cuisines], lower(ground_truth_cuisine)), 0) AS INT) AS lg_rank,
  CAST(len([x FOR x IN coalesce(order_history_tuples, []) IF x IS NOT NULL]) AS BIGINT) AS history_len, [x FOR x IN coalesce(order_history_tuples, []) IF x IS NOT NULL] AS hist, [u.similarity FOR u IN similar_users IF u.similarity IS NOT NULL] AS sims FROM res)"""
VALID = "NOT error AND candidate_count > 0"
valid = lambda df: df.filter(VALID)


def _hit(c: str, k: int) -> str:
    return f"avg(CASE WHEN {c} BETWEEN 1 AND {k} THEN 1.0::DOUBLE ELSE 0 END)"


def _ndcg(c: str, k: int) -> str:
    return f"avg(CASE WHEN {c} BETWEEN 1 AND {k} THEN 1 / log2({c} + 1.0::DOUBLE) ELSE 0 END)"


def _mrr(c: str) -> str:
    return f"avg(CASE WHEN {c} > 0 THEN 1.0::DOUBLE / {c} ELSE 0 END)"


def _report(cols: dict[str, str], ks=(1, 3, 5)) -> str:
    out = []
    for p, c in cols.items():
        for k in ks:
            out += [f"round({_hit(c, k)}, 6) AS {p}hit_{k}", f"round({_ndcg(c, k)}, 6) AS {p}ndcg_{k}"]
        out.append(f"round({_mrr(c)}, 6) AS {p}mrr")
    return ", ".join(out)


THREE = {"r1_": "r1_rank", "lg_": "lg_rank", "": "final_rank"}
rounded = lambda df, *skip: df.withColumns({c: r6(c) for c, t in df.dtypes if t == "double" and c not in skip})


@R.add(f"WITH {RK} SELECT result_id, final_rank, r1_rank, lg_rank, history_len FROM rk")
def metric_ranks(s, d):
    return ranked(s, d).select("result_id", "final_rank", "r1_rank", "lg_rank", "history_len")


@R.add(f"WITH {RK} SELECT (SELECT count(*) FROM rk WHERE NOT error) AS total_samples, (SELECT count(*) FROM rk WHERE error) AS error_samples, count(*) AS valid_samples, {_report(THREE)}, round({_hit('final_rank', 3)} - {_hit('r1_rank', 3)}, 6) AS r1_to_final_hit_3, round(avg((final_rank > 0)::INT), 6) AS found_rate, round(avg(final_rank) FILTER (WHERE final_rank > 0), 6) AS avg_rank_found, round(avg(candidate_count), 6) AS avg_candidates FROM rk WHERE {VALID}")
def metric_repeat_report(s, d):
    k = ranked(s, d)
    n = k.agg(F.count_if(~F.col("error")).alias("total_samples"), F.count_if("error").alias("error_samples"))
    v = valid(k)
    m = metrics.ranking_report(v, THREE).withColumn("r1_to_final_hit_3", F.col("hit_3") - F.col("r1_hit_3"))
    e = v.agg(F.count(F.lit(1)).alias("valid_samples"), F.avg((F.col("final_rank") > 0).cast("int")).alias("found_rate"), F.avg(F.when(F.col("final_rank") > 0, F.col("final_rank"))).alias("avg_rank_found"), F.avg("candidate_count").alias("avg_candidates"))
    return rounded(n.crossJoin(m).crossJoin(e))  # one row each


@R.add(f"WITH {RK} SELECT count(*) AS n, {_report(THREE)} FROM rk WHERE final_rank > 0")
def metric_rerank_report(s, d):
    """The same over samples whose truth was ranked at all (survivors only)."""
    v = ranked(s, d).filter("final_rank > 0")
    return rounded(v.agg(F.count(F.lit(1)).alias("n")).crossJoin(metrics.ranking_report(v, THREE)))


@R.add(f"WITH {RK} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS ranking, {_report({'': c})} FROM rk WHERE {VALID}" for n, c in (("round1", "r1_rank"), ("embedding", "lg_rank"), ("final", "final_rank"))) + ")")
def metric_three_way(s, d):
    long = valid(ranked(s, d)).select(F.explode(F.array(*[F.struct(F.lit(n).alias("ranking"), F.col(c).alias("rank")) for n, c in (("round1", "r1_rank"), ("embedding", "lg_rank"), ("final", "final_rank"))])).alias("x")).select("x.*")
    aggs = []
    for k in (1, 3, 5):
        aggs += [F.avg(scalars.hit_of(F.col("rank"), k)).alias(f"hit_{k}"), F.avg(scalars.ndcg_of(F.col("rank"), k)).alias(f"ndcg_{k}")]
    return rounded(long.groupBy("ranking").agg(*aggs, F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr")))


@R.add(f"WITH {RK} SELECT k, round(avg(CASE WHEN final_rank BETWEEN 1 AND k THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM rk, (SELECT CAST(unnest(range(1, 21)) AS INT) AS k) WHERE {VALID} GROUP BY 1")
def metric_hit_curve(s, d):
    v = valid(ranked(s, d)).agg(*[F.avg(scalars.hit_of(F.col("final_rank"), k)).alias(str(k)) for k in range(1, 21)])
    return v.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), r6(F.col(str(k))).alias("hit_rate")) for k in range(1, 21)])).alias("x")).select("x.*")


# --- baskets: predicted cuisines against the true cuisine and the last three of the history

def baskets(s, d):
    k = ranked(s, d)
    last = F.transform(scalars.last_of(F.col("hist"), 3), lambda x: x["cuisine"])
    g = F.array_sort(F.array_distinct(F.filter(F.concat(last, F.array("ground_truth_cuisine")), lambda x: x.isNotNull())))
    p = F.filter(F.coalesce("round1_predicted_cuisines", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return k.select("result_id", "round1_llm_ms", p.alias("p"), g.alias("g"))


_BK = f"""{RK}, bk AS (SELECT result_id, round1_llm_ms, [x FOR x IN coalesce(round1_predicted_cuisines, []) IF x IS NOT NULL] AS p,
  list_distinct([x FOR x IN list_append([h.cuisine FOR h IN hist[greatest(len(hist) - 2, 1):]], ground_truth_cuisine) IF x IS NOT NULL]) AS g FROM rk),
ats AS (SELECT result_id, round1_llm_ms, p, g, unnest([1, 3, 5, 10]) AS k FROM bk),
sc AS (SELECT *, len(list_intersect(p[1:k], g)) AS common, len(g) AS n, list_sum([CASE WHEN list_contains(g, p[i]) THEN 1 / log2(i + 1.0::DOUBLE) ELSE 0.0::DOUBLE END FOR i IN range(1, least(k, len(p)) + 1)]) AS gain, list_sum([1 / log2(i + 1.0::DOUBLE) FOR i IN range(1, greatest(least(len(g), k), 1) + 1)]) AS ideal FROM ats),
bs AS (SELECT result_id, round1_llm_ms, k, len(p) AS n_pred, n, CASE WHEN common > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, CASE WHEN n > 0 THEN common / n ELSE 0 END AS recall, CASE WHEN n > 0 THEN common / k::DOUBLE ELSE 0 END AS prec, CASE WHEN n > 0 THEN coalesce(gain, 0) / ideal ELSE 0 END AS ndcg,
  coalesce(1.0::DOUBLE / list_min([i FOR i IN range(1, len(p) + 1) IF list_contains(g, p[i])]), 0) AS mrr FROM sc)"""


def basket_rows(s, d):
    b = baskets(s, d)
    each = F.array(*[F.struct(F.lit(k).alias("k"), *[v.alias(n) for n, v in metrics.basket_scores(F.col("p"), F.col("g"), k).items()]) for k in (1, 3, 5, 10)])
    return b.withColumn("mrr", metrics.basket_mrr(F.col("p"), F.col("g"))).select("result_id", "round1_llm_ms", F.size("p").alias("n_pred"), F.size("g").alias("n_true"), "mrr", F.explode(each).alias("x")).select("result_id", "round1_llm_ms", "n_pred", "n_true", "mrr", "x.*")


@R.add(f"WITH {_BK} SELECT result_id, CAST(k AS INT) AS k, hit, round(recall, 6) AS recall, round(prec, 6) AS precision, round(coalesce(2 * recall * prec / nullif(recall + prec, 0), 0), 6) AS f1, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM bs")
def metric_basket_samples(s, d):
    return rounded(basket_rows(s, d).select("result_id", "k", "hit", "recall", "precision", "f1", "ndcg", "mrr"))


@R.add(f"WITH {_BK} SELECT CAST(k AS INT) AS k, count(*) AS n_valid, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(prec), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(n), 6) AS avg_basket, round(avg(round1_llm_ms), 4) AS avg_ms FROM bs WHERE n_pred > 0 AND n > 0 GROUP BY 1")
def metric_basket_report(s, d):
    v = basket_rows(s, d).filter("n_pred > 0 and n_true > 0")
    return v.groupBy("k").agg(F.count(F.lit(1)).alias("n_valid"), *[r6(F.avg(c)).alias(c) for c in ("hit", "recall", "precision", "ndcg", "mrr")], r6(F.avg("n_true")).alias("avg_basket"), F.round(F.avg("round1_llm_ms"), 4).alias("avg_ms"))


@R.add(f"WITH {RK}, v AS (SELECT *, len(coalesce(round1_predicted_cuisines, [])) > 0 AND ground_truth_cuisine IS NOT NULL AS ok FROM rk) SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS n_valid, round(count(*) FILTER (WHERE ok AND r1_rank BETWEEN 1 AND 1) / count(*) FILTER (WHERE ok), 6) AS acc_1, round(count(*) FILTER (WHERE ok AND r1_rank BETWEEN 1 AND 3) / count(*) FILTER (WHERE ok), 6) AS acc_3, round(sum(CASE WHEN ok AND r1_rank > 0 THEN 1 / log2(r1_rank + 1.0::DOUBLE) ELSE 0 END) / count(*) FILTER (WHERE ok), 6) AS ndcg, round(avg(round1_llm_ms), 4) AS avg_ms FROM v")
def metric_topk_report(s, d):
    ok = (F.size(F.coalesce("round1_predicted_cuisines", F.array().cast("array<string>"))) > 0) & F.col("ground_truth_cuisine").isNotNull()
    k = ranked(s, d).withColumn("ok", ok)
    n, rank = F.count_if("ok"), F.col("r1_rank")
    return k.agg(F.count(F.lit(1)).alias("n"), n.alias("n_valid"), r6(F.count_if(F.col("ok") & rank.between(1, 1)) / n).alias("acc_1"), r6(F.count_if(F.col("ok") & rank.between(1, 3)) / n).alias("acc_3"), r6(F.sum(F.when(F.col("ok") & (rank > 0), 1 / F.log2(rank + 1.0)).otherwise(0.0)) / n).alias("ndcg"), F.round(F.avg("round1_llm_ms"), 4).alias("avg_ms"))


@R.add(f"WITH {RK} SELECT count(*) AS n, round(avg(CASE WHEN final_rank BETWEEN 1 AND 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN final_rank BETWEEN 1 AND 3 THEN 1 / 3.0::DOUBLE ELSE 0 END), 6) AS precision_3, round(avg(final_rank) FILTER (WHERE final_rank BETWEEN 1 AND 3), 6) AS first_hit, round(avg((final_rank > 0)::INT), 6) AS in_candidates, round(avg(final_rank) FILTER (WHERE final_rank > 0), 6) AS mean_rank FROM rk WHERE {VALID}")
def metric_k_pick(s, d):
    rank = F.col("final_rank")
    hit = rank.between(1, 3)
    return rounded(valid(ranked(s, d)).agg(F.count(F.lit(1)).alias("n"), F.avg(scalars.hit_of(rank, 3)).alias("recall_3"), F.avg(F.when(hit, 1 / F.lit(3.0)).otherwise(0.0)).alias("precision_3"), F.avg(F.when(hit, rank)).alias("first_hit"), F.avg((rank > 0).cast("int")).alias("in_candidates"), F.avg(F.when(rank > 0, rank)).alias("mean_rank")))


@R.add(f"WITH {RK} SELECT count(*) AS n, round(avg(lg_rank), 6) AS mean_rank, round(median(lg_rank), 6) AS median_rank, min(lg_rank) AS min_rank, max(lg_rank) AS max_rank, round(avg((lg_rank <= 5)::INT), 6) AS recall_5 FROM rk WHERE lg_rank > 0")
def metric_embedding_ranks(s, d):
    k = ranked(s, d).filter("lg_rank > 0")
    return rounded(k.agg(F.count(F.lit(1)).alias("n"), F.avg("lg_rank").alias("mean_rank"), F.percentile("lg_rank", F.lit(0.5)).alias("median_rank"), F.min("lg_rank").alias("min_rank"), F.max("lg_rank").alias("max_rank"), F.avg((F.col("lg_rank") <= 5).cast("int")).alias("recall_5")))


@R.add("SELECT run_id, count(*) AS n_lines, count(*) FILTER (WHERE line IS NULL OR trim(line) = '') AS n_blank, count(DISTINCT line) AS n_distinct FROM stage9_repeat_raw GROUP BY 1")
def metric_run_table(s, d):
    t = table(s, d, "stage9_repeat_raw")
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").isNull() | (F.trim("line") == "")).alias("n_blank"), F.countDistinct("line").alias("n_distinct"))


_YN = f"{RK}, yn AS (SELECT result_id, CASE WHEN final_rank = 1 THEN 'Yes' ELSE 'No' END AS label, CASE WHEN r1_rank = 1 THEN 'Yes' WHEN r1_rank = 0 THEN 'Unknown' ELSE 'No' END AS base, CASE WHEN lg_rank BETWEEN 1 AND 2 THEN 'Yes' ELSE 'No' END AS tuned FROM rk)"


def yes_no(s, d):
    """A binary task over the records: does a cheap ranking foretell a first place in the final one?"""
    k = ranked(s, d)
    return k.select("result_id", F.when(F.col("final_rank") == 1, "Yes").otherwise("No").alias("label"), F.when(F.col("r1_rank") == 1, "Yes").when(F.col("r1_rank") == 0, "Unknown").otherwise("No").alias("base"), F.when(F.col("lg_rank").between(1, 2), "Yes").otherwise("No").alias("tuned"))


@R.add(f"WITH {_YN}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = base) AS correct, count(*) FILTER (WHERE label = 'Yes' AND base = 'Yes') AS tp, count(*) FILTER (WHERE label = 'No' AND base = 'Yes') AS fp, count(*) FILTER (WHERE label = 'Yes' AND base = 'No') AS fn, count(*) FILTER (WHERE label = 'No' AND base = 'No') AS tn FROM yn), p AS (SELECT *, correct / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c) SELECT n, correct, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM p")
def metric_classification(s, d):
    return rounded(metrics.classification(yes_no(s, d), "label", "base"))


@R.add(f"WITH {_YN} SELECT count(*) AS n, count(*) FILTER (WHERE base <> tuned) AS n_differ, count(*) FILTER (WHERE base <> tuned AND tuned = label) AS improvements, count(*) FILTER (WHERE base <> tuned AND base = label) AS regressions, count(*) FILTER (WHERE base <> tuned AND base <> label AND tuned <> label) AS both_wrong, round(100.0::DOUBLE * count(*) FILTER (WHERE base <> tuned) / count(*), 6) AS pct_differ, count(*) FILTER (WHERE base <> tuned AND tuned = label) - count(*) FILTER (WHERE base <> tuned AND base = label) AS net FROM yn")
def metric_disagreements(s, d):
    return rounded(metrics.disagreements(yes_no(s, d), "label", "base", "tuned"))


@R.add("WITH t AS (SELECT length(round1_prompt) AS n FROM stage9_repeat_detailed WHERE round1_prompt IS NOT NULL) SELECT count(*) AS n, CAST(min(n) AS INT) AS least, CAST(max(n) AS INT) AS most, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, count(*) FILTER (WHERE n > 1200) AS n_over, round(100.0::DOUBLE * count(*) FILTER (WHERE n > 1200) / count(*), 6) AS pct_over FROM t")
def metric_prompt_lengths(s, d):
    t = table(s, d, "stage9_repeat_detailed").select(F.length("round1_prompt").alias("n"))
    return rounded(metrics.length_summary(t, "n", 1200))


@R.add("WITH v AS (SELECT round1_llm_ms AS x FROM stage9_repeat_detailed WHERE round1_llm_ms IS NOT NULL), l AS (SELECT list(x ORDER BY x) AS xs, count(*) AS n, avg(x) AS mean FROM v) SELECT n, xs[1] AS least, xs[n] AS most, round(mean, 6) AS mean, xs[CAST(floor(n * 0.5) AS INT) + 1] AS p50, CASE WHEN n >= 10 THEN xs[CAST(floor(n * 0.9) AS INT) + 1] ELSE xs[n] END AS p90, CASE WHEN n >= 20 THEN xs[CAST(floor(n * 0.95) AS INT) + 1] ELSE xs[n] END AS p95, CASE WHEN n >= 100 THEN xs[CAST(floor(n * 0.99) AS INT) + 1] ELSE xs[n] END AS p99 FROM l")
def metric_latency_percentiles(s, d):
    return metrics.nearest_percentiles(table(s, d, "stage9_repeat_detailed"), "round1_llm_ms", shuffle_width(s)).withColumn("mean", r6("mean"))


@R.add("WITH f AS (SELECT CASE WHEN round1_raw_response IS NULL THEN 'missing' WHEN starts_with(round1_raw_response, 'ERROR') THEN 'provider' WHEN error THEN 'flagged' END AS kind, length(round1_prompt) AS n, round1_llm_ms AS ms FROM stage9_repeat_detailed) SELECT kind, count(*) AS n_failures, CAST(min(n) AS INT) AS least_chars, CAST(max(n) AS INT) AS most_chars, round(avg(n), 6) AS avg_chars, count(*) FILTER (WHERE ms >= 0.9::DOUBLE * 4000) AS n_slow FROM f WHERE kind IS NOT NULL GROUP BY 1")
def metric_failures(s, d):
    t = table(s, d, "stage9_repeat_detailed")
    kind = F.when(F.col("round1_raw_response").isNull(), "missing").when(F.col("round1_raw_response").startswith("ERROR"), "provider").when(F.col("error"), "flagged")
    n = F.length("round1_prompt")
    return t.withColumn("kind", kind).filter("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n_failures"), F.min(n).alias("least_chars"), F.max(n).alias("most_chars"), r6(F.avg(n)).alias("avg_chars"), F.count_if(F.col("round1_llm_ms") >= 0.9 * 4000).alias("n_slow"))


@R.add("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, round(sum(value), 4) AS sum_value, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def metric_event_types(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("avg_value"), F.round(F.sum("value"), 4).alias("sum_value"), F.countDistinct("user_id").alias("n_users"))


@R.add("SELECT count(round1_llm_ms) AS n, round(avg(round1_llm_ms), 6) AS mean, round(stddev_samp(round1_llm_ms), 6) AS std, min(round1_llm_ms) AS least, round(quantile_cont(round1_llm_ms, 0.25), 6) AS p25, round(quantile_cont(round1_llm_ms, 0.5), 6) AS p50, round(quantile_cont(round1_llm_ms, 0.75), 6) AS p75, max(round1_llm_ms) AS most FROM stage9_repeat_detailed")
def metric_describe(s, d):
    c = F.col("round1_llm_ms")
    t = table(s, d, "stage9_repeat_detailed")
    at = metrics.interpolated_percentiles(t, "round1_llm_ms", {f"p{int(q * 100)}": q for q in (0.25, 0.5, 0.75)}, shuffle_width(s))  # one row
    return t.agg(F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("std"), F.min(c).alias("least"), F.max(c).alias("most")).crossJoin(F.broadcast(rounded(at)))


# --- exploration of results

@R.add(f"WITH {RK} SELECT result_id, final_rank > 0 AS gt_in_candidates, r1_rank > 0 AS gt_cuisine_in_round1, history_len, CAST(len(list_distinct([h.cuisine FOR h IN hist IF h.cuisine IS NOT NULL])) AS BIGINT) AS n_cuisines, lg_rank FROM rk")
def explore_flags(s, d):
    n = F.size(F.array_distinct(F.filter(F.transform("hist", lambda x: x["cuisine"]), lambda x: x.isNotNull()))).cast("long")
    return ranked(s, d).select("result_id", (F.col("final_rank") > 0).alias("gt_in_candidates"), (F.col("r1_rank") > 0).alias("gt_cuisine_in_round1"), "history_len", n.alias("n_cuisines"), "lg_rank")


_BREAK = "count(*) AS n, round(avg((final_rank BETWEEN 1 AND 1)::INT), 6) AS hit_1, round(avg((final_rank BETWEEN 1 AND 3)::INT), 6) AS hit_3, round(avg((final_rank > 0)::INT), 6) AS found_rate, round(avg(final_rank) FILTER (WHERE final_rank > 0), 6) AS mean_rank"


def breakdown(k, *keys):
    rank = F.col("final_rank")
    return rounded(k.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(rank.between(1, 1).cast("int")).alias("hit_1"), F.avg(rank.between(1, 3).cast("int")).alias("hit_3"), F.avg((rank > 0).cast("int")).alias("found_rate"), F.avg(F.when(rank > 0, rank)).alias("mean_rank")))


@R.add(f"WITH {RK} SELECT ground_truth_cuisine, {_BREAK} FROM rk WHERE {VALID} GROUP BY 1 HAVING count(*) >= 3")
def explore_by_cuisine(s, d):
    return breakdown(valid(ranked(s, d)), "ground_truth_cuisine").filter("n >= 3")


@R.add(f"WITH {RK} SELECT target_hour, {_BREAK} FROM rk WHERE {VALID} GROUP BY 1")
def explore_by_hour(s, d):
    return breakdown(valid(ranked(s, d)), "target_hour")


@R.add(f"WITH {RK} SELECT target_day_of_week, {_BREAK} FROM rk WHERE {VALID} GROUP BY 1")
def explore_by_weekday(s, d):
    return breakdown(valid(ranked(s, d)), "target_day_of_week")


@R.add(f"WITH {RK} SELECT result_id, CAST(len([h FOR h IN hist IF h.vendor_id = ground_truth_vendor_id]) AS BIGINT) AS vendor_repeats, CAST(len([h FOR h IN hist IF h.cuisine = ground_truth_cuisine]) AS BIGINT) AS cuisine_repeats FROM rk")
def explore_repeat_counts(s, d):
    k = ranked(s, d)
    return k.select("result_id", F.size(F.filter("hist", lambda x: F.coalesce(x["vendor_id"] == F.col("ground_truth_vendor_id"), F.lit(False)))).cast("long").alias("vendor_repeats"), F.size(F.filter("hist", lambda x: F.coalesce(x["cuisine"] == F.col("ground_truth_cuisine"), F.lit(False)))).cast("long").alias("cuisine_repeats"))


def cut(c, edges):
    """Right-closed bins (lo, hi] as text; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        out = F.when((c > lo) & (c <= hi), f"({lo}, {hi}]").otherwise(out)
    return out


def _cut_sql(c, edges):
    return "CASE " + " ".join(f"WHEN {c} > {lo} AND {c} <= {hi} THEN '({lo}, {hi}]'" for lo, hi in zip(edges, edges[1:])) + " END"


_E1, _E2 = (0, 3, 5, 10, 15, 21), (0, 5, 10, 20, 50, 100, 500)


@R.add(f"WITH {RK}, b AS (SELECT *, {_cut_sql('candidate_count', _E1)} AS candidates_bin FROM rk) SELECT candidates_bin, {_BREAK} FROM b WHERE NOT error AND candidates_bin IS NOT NULL GROUP BY 1")
def explore_candidate_bins(s, d):
    return breakdown(ranked(s, d).filter("not error").withColumn("candidates_bin", cut(F.col("candidate_count"), _E1)).filter("candidates_bin is not null"), "candidates_bin")


@R.add(f"WITH {RK}, b AS (SELECT *, {_cut_sql('history_len', _E2)} AS history_bin FROM rk) SELECT history_bin, {_BREAK} FROM b WHERE history_bin IS NOT NULL GROUP BY 1")
def explore_history_bins(s, d):
    return breakdown(ranked(s, d).withColumn("history_bin", cut(F.col("history_len"), _E2)).filter("history_bin is not null"), "history_bin")


@R.add(f"WITH {RK} SELECT result_id, list_max(sims) AS max_sim, round(list_avg(sims), 6) AS mean_sim FROM rk WHERE len(sims) > 0")
def explore_similarity(s, d):
    k = ranked(s, d).filter(F.size("sims") > 0)
    return k.select("result_id", F.array_max("sims").alias("max_sim"), r6(F.aggregate("sims", F.lit(0.0), lambda a, x: a + x) / F.size("sims")).alias("mean_sim"))


@R.add(f"WITH {RK}, m AS (SELECT *, list_max(sims) AS x FROM rk WHERE len(sims) > 0), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM m), z AS (SELECT m.*, CASE WHEN x <= a THEN 1 WHEN x <= b THEN 2 WHEN x <= c THEN 3 ELSE 4 END AS quartile FROM m, q) SELECT CAST(quartile AS INT) AS quartile, {_BREAK} FROM z GROUP BY 1")
def explore_similarity_quartiles(s, d):
    k = ranked(s, d).filter(F.size("sims") > 0).withColumn("x", F.array_max("sims"))
    at = metrics.interpolated_percentiles(k, "x", {"a": 0.25, "b": 0.5, "c": 0.75}, shuffle_width(s))
    q = F.broadcast(at.select(F.array("a", "b", "c").alias("q")))  # one row
    x = F.col("x")
    binned = k.crossJoin(q).withColumn("quartile", F.when(x <= F.col("q")[0], 1).when(x <= F.col("q")[1], 2).when(x <= F.col("q")[2], 3).otherwise(4))
    return breakdown(binned, "quartile")


@R.add(f"WITH {RK} SELECT CASE WHEN final_rank = 1 THEN 'hit' WHEN final_rank > 1 THEN 'ranked_low' WHEN r1_rank = 0 THEN 'cuisine_missed' ELSE 'vendor_missed' END AS outcome, count(*) AS n FROM rk WHERE {VALID} GROUP BY 1")
def explore_outcomes(s, d):
    o = F.when(F.col("final_rank") == 1, "hit").when(F.col("final_rank") > 1, "ranked_low").when(F.col("r1_rank") == 0, "cuisine_missed").otherwise("vendor_missed")
    return valid(ranked(s, d)).groupBy(o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {RK} SELECT ground_truth_cuisine, count(*) AS n_missed FROM rk WHERE {VALID} AND r1_rank = 0 AND ground_truth_cuisine IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def explore_missed_cuisines(s, d):
    m = valid(ranked(s, d)).filter("r1_rank = 0 and ground_truth_cuisine is not null").groupBy("ground_truth_cuisine").agg(F.count(F.lit(1)).alias("n_missed"))
    return m.orderBy(F.desc("n_missed"), "ground_truth_cuisine").limit(10)


_STAGES = (("all", "true"), ("no_error", "NOT error"), ("has_candidates", VALID), ("cuisine_found", f"{VALID} AND r1_rank > 0"), ("truth_ranked", f"{VALID} AND final_rank > 0"), ("top_5", f"{VALID} AND final_rank BETWEEN 1 AND 5"), ("top_1", f"{VALID} AND final_rank = 1"))


@R.add(f"WITH {RK} " + " UNION ALL ".join(f"SELECT '{n}' AS stage, count(*) FILTER (WHERE {c}) AS n FROM rk" for n, c in _STAGES))
def explore_funnel(s, d):
    a = ranked(s, d).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _STAGES])
    return a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n")) for n, _ in _STAGES])).alias("x")).select("x.*")


@R.add(f"WITH {RK} SELECT final_rank, count(*) AS n FROM rk GROUP BY 1")
def explore_rank_distribution(s, d):
    return ranked(s, d).groupBy("final_rank").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH {RK}, t AS (SELECT *, round1_llm_ms + round2_llm_ms AS llm, round1_llm_ms + round2_llm_ms + 50.0::DOUBLE AS total FROM rk) SELECT count(llm) AS n, round(avg(total - llm), 6) AS overhead, round(avg(llm / total), 6) AS llm_share FROM t")
def explore_llm_share(s, d):
    """Share of the time spent in the two calls, with 50 ms of other work assumed per sample."""
    llm = F.col("round1_llm_ms") + F.col("round2_llm_ms")
    return ranked(s, d).select(llm.alias("llm"), (llm + 50.0).alias("total")).agg(F.count("llm").alias("n"), r6(F.avg(F.col("total") - F.col("llm"))).alias("overhead"), r6(F.avg(F.col("llm") / F.col("total"))).alias("llm_share"))


@R.add("SELECT count(*) FILTER (WHERE contains(round1_raw_response, '<think>')) AS think_round1, count(*) FILTER (WHERE contains(round2_raw_response, '<think>')) AS think_round2 FROM stage9_repeat_detailed")
def explore_think_tags(s, d):
    return table(s, d, "stage9_repeat_detailed").agg(F.count_if(F.col("round1_raw_response").contains("<think>")).alias("think_round1"), F.count_if(F.col("round2_raw_response").contains("<think>")).alias("think_round2"))


@R.add("SELECT result_id, length(round2_raw_response)::INT AS n FROM stage9_repeat_detailed WHERE round2_raw_response IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 5")
def explore_longest_responses(s, d):
    return table(s, d, "stage9_repeat_detailed").select("result_id", F.length("round2_raw_response").alias("n")).filter("n is not null").orderBy(F.desc("n"), "result_id").limit(5)


@R.add(f"WITH {RK} SELECT result_id, ground_truth, final_rank FROM rk WHERE final_rank > 5 OR (final_rank > 3 AND candidate_count > 0)")
def explore_badly_ranked(s, d):
    return ranked(s, d).filter("final_rank > 5 or (final_rank > 3 and candidate_count > 0)").select("result_id", "ground_truth", "final_rank")


@R.add(f"WITH {RK} SELECT result_id, order_id, final_rank FROM rk WHERE customer_id = (SELECT min(customer_id) FROM rk)")
def explore_by_customer(s, d):
    k = ranked(s, d)
    return k.join(F.broadcast(k.agg(F.min("customer_id").alias("customer_id"))), "customer_id").select("result_id", "order_id", "final_rank")  # one row
