"""Candidate lists, prompts, chat records, a permutation ranker and reports over evaluation results, with their statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import scalars
from larder.operators import graph, profiles, ranking
from larder.operators.supervised import encode_supervised
from larder.plans.canonical import OI, RES, Registry, results, train
from larder.plans.metric_queries import RK, ranked
from larder.plans.ranking_queries import _CANDS, _HIST, candidates, history
from larder.plans.sample_queries import R as SAMPLES
from larder.plans.sample_queries import cf_user_jaccard
from larder.session import durable, table

R = Registry()
r6 = lambda c: F.round(c, 6)


# --- candidates: the own, then those of similar users, then any

_PEERS = "peers AS (SELECT result_id, user_id, similarity, records FROM (SELECT result_id, unnest(similar_users) AS u, generate_subscripts(similar_users, 1) AS i FROM res) s, (SELECT s.u.user_id AS user_id, s.u.similarity AS similarity, s.u.records AS records) WHERE user_id IS NOT NULL AND similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id, user_id ORDER BY i) = 1)"


@R.add(f"""WITH {_HIST}, {_PEERS},
own AS (SELECT result_id, cuisine, row_number() OVER (PARTITION BY result_id ORDER BY count(*) DESC, min(pos)) AS place FROM hist WHERE cuisine IS NOT NULL GROUP BY 1, 2 QUALIFY place <= 10),
votes AS (SELECT result_id, cuisine, round(sum(similarity), 9) AS score FROM (SELECT result_id, similarity, x.cuisine AS cuisine FROM (SELECT result_id, similarity, unnest(records) AS x FROM peers)) WHERE cuisine IS NOT NULL GROUP BY 1, 2),
names AS (SELECT DISTINCT primary_cuisine AS cuisine FROM vendors WHERE primary_cuisine IS NOT NULL),
every AS (SELECT result_id, cuisine, 1 AS origin, place, 0.0::DOUBLE AS score, '' AS seed FROM own
  UNION ALL SELECT result_id, cuisine, 2, 0, score, '' FROM votes UNION ALL SELECT result_id, cuisine, 3, 0, 0.0::DOUBLE, md5(result_id || cuisine) FROM res, names),
first AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY result_id, cuisine ORDER BY origin) = 1)
SELECT result_id, cuisine, ['own', 'similar', 'fill'][origin] AS origin, CAST(row_number() OVER w AS INT) AS rank FROM first WINDOW w AS (PARTITION BY result_id ORDER BY origin, place, score DESC, seed, cuisine) QUALIFY row_number() OVER w <= 20""")
def rank_cuisine_candidates(s, d):
    """Twenty cuisines a sample: the ten most frequent of its history, then what similar users ordered weighted by similarity, then others in seeded order."""
    own = ranking.most_common(history(s, d), "result_id", "cuisine", "pos", 10).select("result_id", "cuisine", F.lit(1).alias("origin"), F.col("rank").cast("int").alias("place"), F.lit(0.0).alias("score"), F.lit("").alias("seed"))
    u = results(s, d).select("result_id", F.posexplode("similar_users").alias("i", "u")).select("result_id", "i", "u.*").filter("user_id is not null and similarity is not null")
    once = u.groupBy("result_id", "user_id").agg(F.min_by(F.struct("similarity", "records"), "i").alias("x")).select("result_id", "x.similarity", F.explode("x.records").alias("r"))
    votes = once.select("result_id", "similarity", "r.cuisine").filter("cuisine is not null").groupBy("result_id", "cuisine").agg(F.round(F.sum("similarity"), 9).alias("score")).select("result_id", "cuisine", F.lit(2).alias("origin"), F.lit(0).alias("place"), "score", F.lit("").alias("seed"))
    names = table(s, d, "vendors").select(F.col("primary_cuisine").alias("cuisine")).filter("cuisine is not null").distinct().agg(F.collect_list("cuisine").alias("names"))  # a controlled vocabulary
    fill = results(s, d).select("result_id").crossJoin(F.broadcast(names)).select("result_id", F.explode("names").alias("cuisine"))
    fill = fill.select("result_id", "cuisine", F.lit(3).alias("origin"), F.lit(0).alias("place"), F.lit(0.0).alias("score"), F.md5(F.concat(F.col("result_id").cast("string"), "cuisine").cast("binary")).alias("seed"))
    first = own.unionByName(votes).unionByName(fill).groupBy("result_id", "cuisine").agg(F.min_by(F.struct("origin", "place", "score", "seed"), "origin").alias("x")).select("result_id", "cuisine", "x.*")
    rank = F.row_number().over(Window.partitionBy("result_id").orderBy("origin", "place", F.desc("score"), "seed", "cuisine"))
    return first.withColumn("rank", rank).filter("rank <= 20").select("result_id", "cuisine", F.element_at(F.array(*map(F.lit, ("own", "similar", "fill"))), F.col("origin")).alias("origin"), "rank")


# --- prompts

def _numbered(items: Column, n: Column, indent: str = "") -> Column:
    """Items as numbered lines; ``n`` is the number before the first."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(indent), (i + 1 + n).cast("string"), F.lit(". "), x)), "\n")


def _thousandths(c: str) -> Column:
    """A number with three digits behind the point, halves upwards."""
    return (F.floor(F.col(c) * 1000 + 0.5) / 1000).cast("decimal(12,3)").cast("string")


_LINES = f"""{_HIST}, slots AS (SELECT result_id, CAST(i AS INT) AS pos, coalesce(h.vendor_id, '?') || '||' || coalesce(h.cuisine, '?') || ' (' || coalesce(h.slot, '?') || ')' AS line FROM (SELECT result_id, unnest(order_history_tuples) AS h, generate_subscripts(order_history_tuples, 1) AS i FROM res) WHERE h IS NOT NULL),
lines AS (SELECT result_id, list(line ORDER BY pos) AS l FROM slots GROUP BY 1),
freq AS (SELECT result_id, string_agg('  ' || rank || '. ' || cuisine || ': ' || n || '/' || total || ' orders (' || CAST(floor(100.0::DOUBLE * n / total + 0.5) AS INT) || '%)', chr(10) ORDER BY rank) AS f
  FROM (SELECT result_id, cuisine, count(*) AS n, row_number() OVER (PARTITION BY result_id ORDER BY count(*) DESC, min(pos)) AS rank, sum(count(*)) OVER (PARTITION BY result_id) AS total FROM (SELECT result_id, pos, coalesce(cuisine, '?') AS cuisine FROM hist) GROUP BY 1, 2) GROUP BY 1),
time_of AS (SELECT result_id, coalesce(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][target_day_of_week + 1], 'Unknown') || ' at ' || coalesce(target_hour::VARCHAR, '?') || ':00' AS moment FROM res)"""


def _history_lines(s, d) -> DataFrame:
    """(result_id, l, f): the history as lines, oldest first, and the frequencies of its cuisines as text."""
    e = results(s, d).select("result_id", F.posexplode("order_history_tuples").alias("pos", "h")).filter("h is not null")
    shown = lambda c: F.coalesce(c, F.lit("?"))
    line = F.concat(shown("h.vendor_id"), F.lit("||"), shown("h.cuisine"), F.lit(" ("), shown("h.slot"), F.lit(")"))
    lines = e.groupBy("result_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]).alias("l"))
    n = e.groupBy("result_id", shown("h.cuisine").alias("cuisine")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    total = F.sum("n").over(Window.partitionBy("result_id"))
    text = F.concat("cuisine", F.lit(": "), F.col("n").cast("string"), F.lit("/"), total.cast("string"), F.lit(" orders ("), F.floor(100.0 * F.col("n") / total + 0.5).cast("int").cast("string"), F.lit("%)"))
    freq = n.withColumn("text", text).groupBy("result_id").agg(_numbered(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "text"))), lambda x: x["text"]), F.lit(0), "  ").alias("f"))
    return lines.join(freq, "result_id")


def _time_of() -> Column:
    return F.concat(scalars.day_name(F.col("target_day_of_week")), F.lit(" at "), F.coalesce(F.col("target_hour").cast("string"), F.lit("?")), F.lit(":00"))


@R.add(f"""WITH {_LINES}, cf AS (SELECT result_id, string_agg(rank || '. ' || cuisine || ': ' || CAST(floor(score * 1000 + 0.5::DOUBLE) / 1000 AS DECIMAL(12, 3)), chr(10) ORDER BY rank) AS c FROM (SELECT result_id, c.cuisine AS cuisine, c.score AS score, row_number() OVER (PARTITION BY result_id ORDER BY i) AS rank FROM (SELECT result_id, unnest(lightgcn_top_cuisines) AS c, generate_subscripts(lightgcn_top_cuisines, 1) AS i FROM res) WHERE c.cuisine IS NOT NULL AND c.score IS NOT NULL) WHERE rank <= 10 GROUP BY 1)
SELECT result_id, 'Name the three most likely cuisines of the next order.' || chr(10) || 'Orders (' || len(l) || '):' || chr(10) || (SELECT string_agg(i || '. ' || l[i], chr(10) ORDER BY i) FROM unnest(range(1, len(l) + 1)) AS t(i)) || chr(10) || 'Latest:' || chr(10) || (SELECT string_agg('  ' || (i - greatest(len(l) - 5, 0)) || '. ' || l[i], chr(10) ORDER BY i) FROM unnest(range(greatest(len(l) - 5, 0) + 1, len(l) + 1)) AS t(i)) || chr(10) || 'Frequencies:' || chr(10) || f || chr(10) || 'Moment: ' || moment || chr(10) || 'Scores of similar users:' || chr(10) || coalesce(c, '  (none)') || chr(10) || 'Answer as JSON: {{"cuisines": [...], "reasoning": "..."}}' AS prompt
FROM lines JOIN freq USING (result_id) JOIN time_of USING (result_id) LEFT JOIN cf USING (result_id)""")
def render_cuisine_prompt(s, d):
    """The prompt of the first round: history, its last five orders, cuisine frequencies in percent, moment and similarity scores."""
    e = results(s, d).select("result_id", F.posexplode("lightgcn_top_cuisines").alias("i", "c")).filter("c.cuisine is not null and c.score is not null")
    line = F.concat("c.cuisine", F.lit(": "), _thousandths("c.score"))
    cf = e.groupBy("result_id").agg(_numbered(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda x: x["t"]), 1, 10), F.lit(0)).alias("c"))
    h = _history_lines(s, d).join(results(s, d).select("result_id", _time_of().alias("at")), "result_id").join(cf, "result_id", "left")
    n = F.size("l").cast("string")
    parts = [F.lit("Name the three most likely cuisines of the next order."), F.concat(F.lit("Orders ("), n, F.lit("):")), _numbered(F.col("l"), F.lit(0)), F.lit("Latest:"), _numbered(scalars.last_of(F.col("l"), 5), F.lit(0), "  "), F.lit("Frequencies:"), F.col("f"), F.concat(F.lit("Moment: "), "at"), F.lit("Scores of similar users:"), F.coalesce("c", F.lit("  (none)")), F.lit('Answer as JSON: {"cuisines": [...], "reasoning": "..."}')]
    return h.select("result_id", F.concat_ws("\n", *parts).alias("prompt"))


@R.add(f"""WITH {_LINES}, cands AS (SELECT result_id, list(item ORDER BY md5(result_id || item)) AS c FROM (SELECT DISTINCT result_id, vendor_id || '||' || cuisine AS item FROM hist WHERE vendor_id IS NOT NULL AND cuisine IS NOT NULL) GROUP BY 1),
near AS (SELECT result_id, string_agg('  - ' || coalesce(r.vendor_id, '?') || '||' || coalesce(r.cuisine, '?') || ' (' || coalesce(r.slot, '?') || ') [sim=' || CAST(floor(similarity * 1000 + 0.5::DOUBLE) / 1000 AS DECIMAL(12, 3)) || ']', chr(10) ORDER BY i, j) AS s
  FROM (SELECT result_id, i, u.similarity AS similarity, unnest(u.records) AS r, generate_subscripts(u.records, 1) AS j FROM (SELECT result_id, unnest(similar_users) AS u, generate_subscripts(similar_users, 1) AS i FROM res) WHERE u.similarity IS NOT NULL) WHERE r IS NOT NULL GROUP BY 1)
SELECT l.result_id, 'Rank the candidates from most to least likely.' || chr(10) || 'Latest orders:' || chr(10) || (SELECT string_agg((i - greatest(len(l) - 10, 0)) || '. ' || l[i] || CASE WHEN i > len(l) - 3 THEN ' [MOST RECENT]' ELSE '' END, chr(10) ORDER BY i) FROM unnest(range(greatest(len(l) - 10, 0) + 1, len(l) + 1)) AS t(i)) || chr(10) || 'Moment: ' || moment || chr(10) || 'Cuisines of round one: ' || coalesce(array_to_string([x FOR x IN round1_predicted_cuisines IF x IS NOT NULL], ', '), '') || chr(10) || 'Candidates:' || chr(10) || (SELECT string_agg(i || '. ' || c[i], chr(10) ORDER BY i) FROM unnest(range(1, len(c) + 1)) AS t(i)) || chr(10) || 'Orders of similar users:' || chr(10) || coalesce(s, '  (none)') || chr(10) || 'Rank all ' || len(c) || ' as JSON: {{"final_ranking": [...], "reflection": "..."}}' AS prompt
FROM lines l JOIN time_of USING (result_id) JOIN cands USING (result_id) JOIN res USING (result_id) LEFT JOIN near USING (result_id)""")
def render_vendor_prompt(s, d):
    """The prompt of the second round: ten orders with the last three marked, moment, cuisines, candidates in seeded order, orders of similar users."""
    c = candidates(s, d).select("result_id", _shuffled(F.col("c"), F.col("result_id")).alias("c"))
    u = results(s, d).select("result_id", F.posexplode("similar_users").alias("i", "u")).filter("u.similarity is not null").select("result_id", "i", "u.similarity", F.posexplode("u.records").alias("j", "r")).filter("r is not null")
    shown = lambda c: F.coalesce(c, F.lit("?"))
    line = F.concat(F.lit("  - "), shown("r.vendor_id"), F.lit("||"), shown("r.cuisine"), F.lit(" ("), shown("r.slot"), F.lit(") [sim="), _thousandths("similarity"), F.lit("]"))
    near = u.groupBy("result_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", line.alias("t")))), lambda x: x["t"]), "\n").alias("s"))
    said = F.array_join(F.filter("round1_predicted_cuisines", lambda x: x.isNotNull()), ", ")
    h = _history_lines(s, d).join(results(s, d).select("result_id", _time_of().alias("at"), F.coalesce(said, F.lit("")).alias("p")), "result_id").join(c, "result_id").join(near, "result_id", "left")
    last = scalars.last_of(F.col("l"), 10)
    marked = F.transform(last, lambda x, i: F.concat(x, F.when(i >= F.size(last) - 3, " [MOST RECENT]").otherwise("")))
    parts = [F.lit("Rank the candidates from most to least likely."), F.lit("Latest orders:"), _numbered(marked, F.lit(0)), F.concat(F.lit("Moment: "), "at"), F.concat(F.lit("Cuisines of round one: "), "p"), F.lit("Candidates:"), _numbered(F.col("c"), F.lit(0)), F.lit("Orders of similar users:"), F.coalesce("s", F.lit("  (none)")), F.concat(F.lit("Rank all "), F.size("c").cast("string"), F.lit(' as JSON: {"final_ranking": [...], "reflection": "..."}'))]
    return h.select("result_id", F.concat_ws("\n", *parts).alias("prompt"))


def _shuffled(items: Column, seed: Column) -> Column:
    """Items in the order of a hash of a seed and each item: a seeded permutation."""
    keyed = F.transform(items, lambda x: F.struct(F.md5(F.concat(seed.cast("string"), x).cast("binary")).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda t: t["x"])


@R.add(f"WITH {_CANDS}, p AS (SELECT result_id, [y[33:] FOR y IN list_sort([md5(result_id || x) || x FOR x IN c])] AS c FROM cands) SELECT p.result_id, array_to_string(c, ',') AS ranking, CAST(coalesce(list_position(c, ground_truth), 0) AS INT) AS rank FROM p JOIN res USING (result_id)")
def rank_permuted(s, d):
    """A ranker that answers with a seeded permutation of the candidates as JSON, parsed back like any response, with the truth's rank."""
    j = candidates(s, d).join(results(s, d).select("result_id", "ground_truth"), "result_id")
    answer = F.to_json(F.struct(_shuffled(F.col("c"), F.col("result_id")).alias("final_ranking")))
    parsed = j.select("result_id", "ground_truth", scalars.embedded_list(answer, "final_ranking").alias("r"))
    return parsed.select("result_id", F.array_join("r", ",").alias("ranking"), F.coalesce(F.array_position("r", F.col("ground_truth")), F.lit(0)).cast("int").alias("rank"))


_ROUNDS = f"{RES}, ex AS (SELECT result_id, 1 AS round_no, 'You recommend food delivery.' AS system, round1_prompt AS instruction, NULL AS input, coalesce(round1_raw_response, '') AS output FROM res UNION ALL SELECT result_id, 2, NULL, 'Rank these places for the user.', round2_prompt, coalesce(round2_raw_response, '') FROM res)"


@R.add(f"WITH {_ROUNDS} SELECT result_id, round_no, CASE WHEN coalesce(input, '') = '' THEN coalesce(instruction, '') ELSE coalesce(instruction, '') || chr(10) || chr(10) || input END AS user_text, array_to_string([x FOR x IN [CASE WHEN coalesce(system, '') <> '' THEN 'system' END, 'user', 'assistant'] IF x IS NOT NULL], ',') AS roles, CAST(1 + (coalesce(system, '') <> '')::INT AS INT) AS n_generation FROM ex")
def render_instruction_records(s, d):
    """Instruction records of both rounds as chat messages, for training (with the answer) and for generation (without)."""
    t = results(s, d).select("result_id", "round1_prompt", "round2_prompt", F.coalesce("round1_raw_response", F.lit("")).alias("a"), F.coalesce("round2_raw_response", F.lit("")).alias("b"))
    rec = lambda n, system, instruction, given, output: F.struct(F.lit(n).alias("round_no"), system.alias("system"), instruction.alias("instruction"), given.alias("input"), output.alias("output"))
    none = F.lit(None).cast("string")
    both = F.array(rec(1, F.lit("You recommend food delivery."), F.col("round1_prompt"), none, F.col("a")), rec(2, none, F.lit("Rank these places for the user."), F.col("round2_prompt"), F.col("b")))
    x = t.select("result_id", F.explode(both).alias("x")).select("result_id", "x.*").withColumn("m", scalars.chat_messages(F.col("system"), F.col("instruction"), F.col("input")))
    full = F.concat("m", F.array(F.struct(F.lit("assistant").alias("role"), F.col("output").alias("content"))))
    return x.select("result_id", "round_no", F.element_at("m", -1)["content"].alias("user_text"), F.array_join(F.transform(full, lambda y: y["role"]), ",").alias("roles"), F.size("m").alias("n_generation"))


@R.add(f"WITH {RES} SELECT result_id, 'Customer ' || coalesce(customer_id, '') || ' at hour ' || coalesce(target_hour::VARCHAR, '') || ': {{' || coalesce(candidate_count::VARCHAR, '') || ' candidates}}' AS prompt FROM res")
def render_template(s, d):
    """A template with required variables over columns."""
    t = "Customer {customer} at hour {hour}: {{{n} candidates}}"
    values = {"customer": F.col("customer_id"), "hour": F.col("target_hour"), "n": F.col("candidate_count")}
    return results(s, d).select("result_id", scalars.filled_template(t, values, ("customer", "hour")).alias("prompt"))


_MARKER = "<|assistant|>"
_WORDS = "len(regexp_extract_all({0}, '\\S+'))"


@R.add(f"WITH {RES}, t AS (SELECT result_id, {_WORDS.format('round1_prompt')} + 1 AS p, {_WORDS.format('round1_raw_response')} AS a FROM res WHERE round1_raw_response IS NOT NULL) SELECT result_id, CAST(least(p + a, 96) AS INT) AS n_ids, CAST(greatest(least(p + a, 96) - a, 0) AS INT) AS n_masked, CAST(least(a, 96) AS INT) AS n_labels FROM t")
def encode_masked(s, d):
    """Chat texts as token ids with the prompt masked and the beginning cut, here by words numbered in a text."""
    import re

    def by_words():
        return lambda text: list(range(len(re.findall(r"\S+", text))))

    text = F.concat("round1_prompt", F.lit(f"\n{_MARKER}\n"), "round1_raw_response")
    t = encode_supervised(results(s, d).select("result_id", text.alias("text")), "result_id", "text", by_words, _MARKER, 96)
    n_masked = F.size(F.filter("labels", lambda x: x == -100))
    return t.select("result_id", F.size("input_ids").alias("n_ids"), n_masked.alias("n_masked"), (F.size("labels") - n_masked).alias("n_labels"))


# --- reports

@R.add(f"""WITH {_HIST}, seen AS (SELECT result_id, list(DISTINCT cuisine) AS h FROM hist WHERE cuisine IS NOT NULL GROUP BY 1), top AS (SELECT result_id, list(cuisine ORDER BY i) AS r FROM (SELECT result_id, c.cuisine AS cuisine, i FROM (SELECT result_id, unnest(lightgcn_top_cuisines) AS c, generate_subscripts(lightgcn_top_cuisines, 1) AS i FROM res) WHERE c.cuisine IS NOT NULL) GROUP BY 1),
x AS (SELECT result_id, coalesce(h, []) AS h, r, list_distinct(r[1:5]) AS t, ground_truth_cuisine AS g FROM res JOIN top USING (result_id) LEFT JOIN seen USING (result_id))
SELECT result_id, round(CASE WHEN len(h) > 0 THEN len(list_intersect(t, h)) / len(h) ELSE 0 END, 6) AS history_recall, round(len(list_intersect(t, h)) / 5.0::DOUBLE, 6) AS history_precision, CASE WHEN list_contains(t, g) THEN 1.0 ELSE 0.0 END::DOUBLE AS truth_recall, CASE WHEN list_contains(t, g) THEN 0.2 ELSE 0.0 END::DOUBLE AS truth_precision, coalesce(list_contains(t, g), false) AS hit, CAST(coalesce(nullif(list_position(r, g), 0), -1) AS INT) AS truth_rank, coalesce(list_contains(h, g), false) AS truth_in_history FROM x""")
def metric_embedding_samples(s, d):
    """For each sample how the first five cuisines by embedding score cover its history and its truth, and the truth's rank (-1: none)."""
    top = results(s, d).select("result_id", F.col("ground_truth_cuisine").alias("g"), F.filter(F.transform("lightgcn_top_cuisines", lambda c: c["cuisine"]), lambda c: c.isNotNull()).alias("r")).filter("size(r) > 0")
    seen = history(s, d).filter("cuisine is not null").groupBy("result_id").agg(F.collect_set("cuisine").alias("h"))
    x = top.join(seen, "result_id", "left").withColumn("h", F.coalesce("h", F.array().cast("array<string>"))).withColumn("t", F.array_distinct(F.slice("r", 1, 5)))
    common = F.size(F.array_intersect("t", "h"))
    hit = F.coalesce(F.array_contains("t", F.col("g")), F.lit(False))
    rank = F.coalesce(F.nullif(F.array_position("r", F.col("g")), F.lit(0)), F.lit(-1)).cast("int")
    return x.select("result_id", r6(F.when(F.size("h") > 0, common / F.size("h")).otherwise(0.0)).alias("history_recall"), r6(common / 5.0).alias("history_precision"), F.when(hit, 1.0).otherwise(0.0).alias("truth_recall"), F.when(hit, 0.2).otherwise(0.0).alias("truth_precision"), hit.alias("hit"), rank.alias("truth_rank"), F.coalesce(F.array_contains("h", F.col("g")), F.lit(False)).alias("truth_in_history"))


_RUN = "runs AS (SELECT DISTINCT run_id, regexp_extract(line, '\"customer_id\": ?\"([^\"]*)\"', 1) AS customer_id, regexp_extract(line, '\"order_id\": ?\"?([0-9]+)', 1) AS order_id FROM stage9_repeat_raw WHERE line IS NOT NULL)"


def run_samples(s, d) -> DataFrame:
    """(run_id, customer_id, order_id) of the samples that the lines of older runs name."""
    r = table(s, d, "stage9_repeat_raw").filter("line is not null")
    return r.select("run_id", F.regexp_extract("line", '"customer_id": ?"([^"]*)"', 1).alias("customer_id"), F.regexp_extract("line", '"order_id": ?"?([0-9]+)', 1).alias("order_id")).distinct()


@R.add(f"""WITH {RK}, {_RUN}, j AS (SELECT run_id, count(*) AS n_samples, count(rk.result_id) AS n_known, avg((final_rank BETWEEN 1 AND 1)::INT) AS hit_1, avg((final_rank BETWEEN 1 AND 3)::INT) AS hit_3, avg((final_rank BETWEEN 1 AND 5)::INT) AS hit_5, avg(CASE WHEN final_rank BETWEEN 1 AND 3 THEN 1 / log2(final_rank + 1) WHEN final_rank IS NOT NULL THEN 0 END) AS ndcg_3, avg(CASE WHEN final_rank > 0 THEN 1.0::DOUBLE / final_rank WHEN final_rank IS NOT NULL THEN 0 END) AS mrr FROM runs LEFT JOIN (SELECT res.customer_id, res.order_id, rk.result_id, rk.final_rank FROM rk JOIN res USING (result_id)) rk USING (customer_id, order_id) GROUP BY 1)
SELECT run_id, n_samples, n_known, round(hit_1, 6) AS hit_1, round(hit_3, 6) AS hit_3, round(hit_5, 6) AS hit_5, round(ndcg_3, 6) AS ndcg_3, round(mrr, 6) AS mrr, round(hit_3 - max(hit_3) OVER (), 6) AS hit_3_behind_best FROM j""")
def metric_run_comparison(s, d):
    """Runs side by side: the samples each names, and hits, NDCG and MRR of those in the final results, beside the best run."""
    ids = results(s, d).select("customer_id", "order_id", "result_id")
    k = ids.join(ranked(s, d).select("result_id", "final_rank"), "result_id")
    j = run_samples(s, d).join(k, ["customer_id", "order_id"], "left")
    rank = F.col("final_rank")
    known = lambda x: F.when(rank.isNotNull(), x)
    g = j.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_samples"), F.count("result_id").alias("n_known"), *[F.avg(known(scalars.hit_of(rank, n))).alias(f"hit_{n}") for n in (1, 3, 5)], F.avg(known(scalars.ndcg_of(rank, 3))).alias("ndcg_3"), F.avg(known(F.when(rank > 0, 1.0 / rank).otherwise(0.0))).alias("mrr"))
    best = F.max("hit_3").over(Window.partitionBy())  # one row per run
    return g.select("run_id", "n_samples", "n_known", *[r6(c).alias(c) for c in ("hit_1", "hit_3", "hit_5", "ndcg_3", "mrr")], r6(F.col("hit_3") - best).alias("hit_3_behind_best"))


@R.add(f"WITH {RES}, {_RUN} SELECT DISTINCT customer_id, order_id FROM stage9_repeat_detailed d WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.customer_id = d.customer_id AND r.order_id = d.order_id)")
def sink_resume_pairs(s, d):
    """Samples, by customer and order, that no line of an older run names: what a resumed run still has to do."""
    return table(s, d, "stage9_repeat_detailed").select("customer_id", "order_id").distinct().join(run_samples(s, d), ["customer_id", "order_id"], "left_anti")


_KIND = "CASE WHEN regexp_matches(x, '(?i)time[d]? ?out') THEN 'timeout' WHEN regexp_matches(x, '(?i)rate.?limit|\\b429\\b') THEN 'rate limit' WHEN regexp_matches(x, '(?i)^\\W*error|\"error\"') THEN 'provider' WHEN x IS NULL OR trim(x) = '' THEN 'missing' WHEN error THEN 'flagged' END"


@R.add(f"""WITH f AS (SELECT {_KIND} AS kind, nullif(regexp_extract(x, '\\b([45][0-9][0-9])\\b', 1), '') AS status, n, ms FROM (SELECT error, unnest([round1_raw_response, round2_raw_response]) AS x, unnest([length(round1_prompt), length(round2_prompt)]) AS n, unnest([round1_llm_ms, round2_llm_ms]) AS ms FROM stage9_repeat_detailed)),
k AS (SELECT * FROM f WHERE kind IS NOT NULL)
SELECT kind, count(*) AS n_failures, count(DISTINCT status) FILTER (WHERE status IS NOT NULL) AS n_statuses, CAST(min(n) AS INT) AS least_chars, CAST(max(n) AS INT) AS most_chars, CAST(list_sort(list(n))[CAST(count(n) // 2 AS INT) + 1] AS INT) AS median_chars, round(avg(ms), 4) AS avg_ms, count(*) FILTER (WHERE ms >= 3600) AS n_slow FROM k GROUP BY 1""")
def metric_failure_diagnostics(s, d):
    """Failed calls by type of error: HTTP statuses, prompt sizes with the median by index, durations and calls near the time limit."""
    t = table(s, d, "stage9_repeat_detailed")
    call = F.explode(F.array(*[F.struct(F.col(f"round{n}_raw_response").alias("x"), F.length(f"round{n}_prompt").alias("n"), F.col(f"round{n}_llm_ms").alias("ms")) for n in (1, 2)]))
    x = t.select("error", call.alias("c")).select("error", "c.*")
    has = lambda p: F.coalesce(F.col("x").rlike(p), F.lit(False))
    kind = F.when(has("(?i)time[d]? ?out"), "timeout").when(has(r"(?i)rate.?limit|\b429\b"), "rate limit").when(has(r'(?i)^\W*error|"error"'), "provider").when(F.col("x").isNull() | (F.trim("x") == ""), "missing").when(F.col("error"), "flagged")
    k = x.withColumn("kind", kind).filter("kind is not null").withColumn("status", F.nullif(F.regexp_extract("x", r"\b([45][0-9][0-9])\b", 1), F.lit("")))
    # The element at index n / 2 of the sorted sizes, from counts of distinct sizes.
    sizes = k.filter("n is not null").groupBy("kind", "n").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("kind")
    upto = sizes.withColumn("upto", F.sum("c").over(by.orderBy("n"))).withColumn("all", F.sum("c").over(by))
    median = upto.filter("upto > floor(all / 2)").groupBy("kind").agg(F.min("n").alias("median_chars"))
    g = k.groupBy("kind").agg(F.count(F.lit(1)).alias("n_failures"), F.countDistinct("status").alias("n_statuses"), F.min("n").alias("least_chars"), F.max("n").alias("most_chars"), F.round(F.avg("ms"), 4).alias("avg_ms"), F.count_if(F.col("ms") >= 3600).alias("n_slow"))
    return g.join(median, "kind", "left").select("kind", "n_failures", "n_statuses", "least_chars", "most_chars", "median_chars", "avg_ms", "n_slow")


@R.add("SELECT user_id, count(*) AS n_calls, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS session_seconds, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS avg_think, round(avg(value) FILTER (WHERE event_type IN ('click', 'purchase')), 6) AS avg_action, round(sum(value), 4) AS total_value, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) FILTER (WHERE event_type = 'error') AS n_errors, CAST(max(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS most_k FROM events GROUP BY 1")
def metric_sessions(s, d):
    """Sessions: length, mean value of thinking (views) and acting (clicks and purchases) events, totals and calls by kind."""
    e, kind = table(s, d, "events"), F.col("event_type")
    us = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_calls"), F.round(us(F.max("ts")) - us(F.min("ts")), 3).alias("session_seconds"), r6(F.avg(F.when(kind == "view", F.col("value")))).alias("avg_think"), r6(F.avg(F.when(kind.isin("click", "purchase"), F.col("value")))).alias("avg_action"), F.round(F.sum("value"), 4).alias("total_value"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count_if(kind == "error").alias("n_errors"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("most_k"))


@R.add(f"WITH {OI}, sim AS ({SAMPLES.sql['cf_user_jaccard']}), last5 AS (SELECT customer_id, vendor_id, cuisine, row_number() OVER (PARTITION BY customer_id ORDER BY day_num DESC, hour DESC, row_id DESC) AS back FROM gtrain QUALIFY back <= 5) SELECT sim.a AS customer_id, sim.b AS similar_customer, sim.sim, CAST(back AS INT) AS back, vendor_id, cuisine FROM sim JOIN last5 ON last5.customer_id = sim.b")
def rank_similar_histories(s, d):
    """What is looked up for a customer: the nearest customers with the last five orders of each."""
    g = profiles.order_grain(train(s, d))
    back = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("day_num"), F.desc("hour"), F.desc("row_id")))
    last = g.withColumn("back", back).filter("back <= 5").select(F.col("customer_id").alias("b"), "back", "vendor_id", "cuisine")
    return cf_user_jaccard(s, d).join(last, "b").select(F.col("a").alias("customer_id"), F.col("b").alias("similar_customer"), "sim", "back", "vendor_id", "cuisine")


#: Places a held-out item is ranked among besides its own.
NEGATIVES = 100


@R.add()
def graph_trained_ranking(s, d):
    """Held-out quality of trained vectors: of each customer with three vendors or more the last new one is held out and
    ranked by dot product among a hundred seeded others, the same for all; customers, hits at 10, MRR, and the hits of chance."""
    first = train(s, d).groupBy(F.col("customer_id").alias("user"), F.col("vendor_id").alias("item")).agg(F.min(F.struct("day_num", "hour", "row_id")).alias("at"))
    w = Window.partitionBy("user")
    marked = durable(first.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("last", F.row_number().over(w.orderBy(F.desc("at")))).select("user", "item", ((F.col("n") >= 3) & (F.col("last") == 1)).alias("held")))
    kept = durable(marked.filter("not held").select("user", "item"))
    vectors = durable(graph.train(kept, dims=32, epochs=20))
    u = vectors.filter("node like 'u:%'").select(F.substring("node", 3, 1 << 30).alias("user"), F.col("v").alias("x"))
    i = vectors.filter("node like 'i:%'").select(F.substring("node", 3, 1 << 30).alias("item"), F.col("v").alias("y"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    others = i.orderBy(F.xxhash64("item", F.lit(7)), "item").limit(NEGATIVES).agg(F.collect_list(F.struct("item", "y")).alias("others"))  # one row of NEGATIVES vectors
    asked = marked.filter("held").select("user", "item").join(i, "item").join(u, "user").withColumn("truth", dot(F.col("x"), F.col("y"))).crossJoin(F.broadcast(others))
    rest = F.filter("others", lambda o: o["item"] != F.col("item"))
    rank = asked.select((1 + F.size(F.filter(rest, lambda o: dot(F.col("x"), o["y"]) >= F.col("truth")))).alias("rank"), (1 + F.size(rest)).alias("among"))
    return rank.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rank") <= 10).cast("int")).alias("hit_10"), F.avg(1.0 / F.col("rank")).alias("mrr"), F.avg(F.least(10.0 / F.col("among"), F.lit(1.0))).alias("chance_10"))
