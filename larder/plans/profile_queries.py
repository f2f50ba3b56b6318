"""Scans, projections, joins, aggregations and profiles over orders, with their oracle statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import ids, scalars
from larder.operators import profiles
from larder.plans.canonical import OI, SPLIT_DAY, Registry, order_items, test, train
from larder.session import table

R = Registry()
r6 = lambda c: F.round(c, 6)


# --- scans and projections

@R.add("SELECT row_id, order_id, vendor_id, product_id, order_time, order_day, day_of_week, CASE WHEN day_of_week BETWEEN 0 AND 6 THEN ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][day_of_week + 1] ELSE 'Unknown' END AS day_name FROM food_orders")
def scan_orders(s, d):
    c = table(s, d, "food_orders").select("row_id", "order_id", "vendor_id", "product_id", "order_time", "order_day", "day_of_week")
    return c.withColumn("day_name", scalars.day_name(F.col("day_of_week")))


@R.add("SELECT vendor_id, primary_cuisine, geohash, coalesce(chain_id, '') AS chain_id FROM vendors")
def scan_vendors(s, d):
    return table(s, d, "vendors").select("vendor_id", "primary_cuisine", "geohash", "chain_id").fillna({"chain_id": ""})


@R.add("SELECT vendor_id, product_id, coalesce(name, 'Unknown Product') AS name, coalesce(unit_price, 0.0) AS unit_price FROM products")
def scan_products(s, d):
    return table(s, d, "products").fillna({"name": "Unknown Product", "unit_price": 0.0})


@R.add(f"WITH {OI} SELECT row_id, customer_id, order_id, vendor_id, product_id FROM test")
def scan_test_orders(s, d):
    return test(s, d).select("row_id", "customer_id", "order_id", "vendor_id", "product_id")


@R.add("SELECT row_id, CAST(split_part(order_time, ':', 1) AS INT) AS hour, CAST(regexp_extract(order_day, '([0-9]+)', 1) AS INT) AS day_num FROM food_orders")
def proj_time_columns(s, d):
    return table(s, d, "food_orders").select("row_id", scalars.hour_of(F.col("order_time")).alias("hour"), ids.day_number(F.col("order_day")).alias("day_num"))


@R.add("SELECT f.row_id, v.primary_cuisine AS cuisine, coalesce(v.geohash, 'unknown') AS vendor_geohash, f.user_geohash AS geohash FROM food_orders f LEFT JOIN (SELECT vendor_id, min(primary_cuisine) AS primary_cuisine, min(geohash) AS geohash FROM vendors GROUP BY 1) v USING (vendor_id)")
def join_orders_vendors(s, d):
    v = table(s, d, "vendors").groupBy("vendor_id").agg(F.min("primary_cuisine").alias("cuisine"), F.min("geohash").alias("vendor_geohash"))
    f = table(s, d, "food_orders").select("row_id", "vendor_id", F.col("user_geohash").alias("geohash"))
    return f.join(v, "vendor_id", "left").select("row_id", "cuisine", F.coalesce("vendor_geohash", F.lit("unknown")).alias("vendor_geohash"), "geohash")


@R.add("SELECT f.row_id, coalesce(p.name, 'Unknown Product') AS product_name, coalesce(p.unit_price, 0.0) AS unit_price FROM food_orders f LEFT JOIN (SELECT vendor_id, product_id, min(name) AS name, min(unit_price) AS unit_price FROM products GROUP BY 1, 2) p USING (vendor_id, product_id)")
def join_orders_products(s, d):
    p = table(s, d, "products").groupBy("vendor_id", "product_id").agg(F.min("name").alias("product_name"), F.min("unit_price").alias("unit_price"))
    f = table(s, d, "food_orders").select("row_id", "vendor_id", "product_id")
    return f.join(p, ["vendor_id", "product_id"], "left").fillna({"product_name": "Unknown Product", "unit_price": 0.0}).select("row_id", "product_name", "unit_price")


@R.add(f"WITH {OI} SELECT row_id, customer_id, order_id, vendor_id, product_id, user_geohash, vendor_geohash, chain_id, cuisine, product_name, unit_price, hour, day_num, day_of_week FROM oi")
def merged_orders(s, d):
    return order_items(s, d)


@R.add("SELECT f.row_id, coalesce(f.cuisine, v.primary_cuisine) AS cuisine FROM food_orders f LEFT JOIN (SELECT vendor_id, min(primary_cuisine) AS primary_cuisine FROM vendors GROUP BY 1) v USING (vendor_id)")
def join_cuisine_backfill(s, d):
    v = table(s, d, "vendors").groupBy("vendor_id").agg(F.min("primary_cuisine").alias("primary_cuisine"))
    f = table(s, d, "food_orders").select("row_id", "vendor_id", "cuisine")
    return f.join(v, "vendor_id", "left").select("row_id", F.coalesce("cuisine", "primary_cuisine").alias("cuisine"))


@R.add(f"WITH {OI} SELECT row_id, CASE WHEN hour BETWEEN 6 AND 10 THEN 'breakfast' WHEN hour BETWEEN 11 AND 14 THEN 'lunch' WHEN hour BETWEEN 15 AND 17 THEN 'afternoon' WHEN hour BETWEEN 18 AND 21 THEN 'dinner' ELSE 'late_night' END AS meal, vendor_id || '||' || cuisine AS item, vendor_id AS item_vendor, cuisine AS item_cuisine FROM oi")
def proj_meal_and_item(s, d):
    o = order_items(s, d).withColumn("item", scalars.item_of("vendor_cuisine"))
    return o.select("row_id", scalars.meal_of(F.col("hour")).alias("meal"), "item", scalars.item_vendor(F.col("item")).alias("item_vendor"), scalars.item_cuisine(F.col("item")).alias("item_cuisine"))


def _norm(c: str) -> str:
    for p in scalars.SIZE_PATTERNS:
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_CASES = " ".join(f"WHEN {' OR '.join(f'contains(w, {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{name}'" for name, keys in scalars.PRODUCT_KEYWORDS.items())


@R.add(f"WITH n AS (SELECT DISTINCT product_name FROM food_orders WHERE product_name IS NOT NULL), w AS (SELECT product_name, {_norm('lower(product_name)')} AS w FROM n) SELECT product_name, w AS words, CASE {_CASES} END AS category FROM w")
def proj_product_category(s, d):
    n = table(s, d, "food_orders").select("product_name").filter("product_name is not null").distinct().withColumn("words", scalars.product_words(F.col("product_name")))
    return n.withColumn("category", scalars.product_category(F.col("words")))


@R.add(f"WITH n AS (SELECT DISTINCT product_name FROM food_orders WHERE product_name IS NOT NULL), w AS (SELECT product_name, {_norm('lower(product_name)')} AS w FROM n) " + " UNION ALL ".join(f"SELECT product_name, '{name}' AS category, least(1.0::DOUBLE, 0.5::DOUBLE * ({' + '.join(f'contains(w, {chr(39)}{k}{chr(39)})::INT' for k in keys)})) AS confidence FROM w WHERE {' OR '.join(f'contains(w, {chr(39)}{k}{chr(39)})' for k in keys)}" for name, keys in scalars.PRODUCT_KEYWORDS.items()))
def proj_category_confidence(s, d):
    n = table(s, d, "food_orders").select("product_name").filter("product_name is not null").distinct().withColumn("words", scalars.product_words(F.col("product_name")))
    scores = F.array(*[F.struct(F.lit(k).alias("category"), scalars.category_confidence(F.col("words"), k).alias("confidence")) for k in scalars.PRODUCT_KEYWORDS])
    return n.select("product_name", F.explode(scores).alias("x")).select("product_name", "x.*").filter("confidence > 0")


@R.add("SELECT event_id, CASE WHEN value >= 50 THEN 'Yes' ELSE 'No' END AS label FROM events WHERE value IS NOT NULL")
def proj_rating_label(s, d):
    return table(s, d, "events").filter("value is not null").select("event_id", F.when(F.col("value") >= 50, "Yes").otherwise("No").alias("label"))


@R.add("SELECT result_id, length(round1_prompt) AS prompt_chars, coalesce(length(round1_raw_response), 0) AS response_chars, len(string_split(trim(regexp_replace(round1_prompt, '\\s+', ' ', 'g')), ' ')) AS prompt_words, length(round1_prompt) / 4.0::DOUBLE AS prompt_tokens FROM stage9_repeat_detailed")
def proj_text_sizes(s, d):
    t = table(s, d, "stage9_repeat_detailed")
    return t.select("result_id", F.length("round1_prompt").cast("long").alias("prompt_chars"), F.coalesce(F.length("round1_raw_response"), F.lit(0)).cast("long").alias("response_chars"), scalars.word_count(F.col("round1_prompt")).cast("long").alias("prompt_words"), (F.length("round1_prompt") / 4.0).alias("prompt_tokens"))


@R.add("SELECT result_id, CASE WHEN regexp_matches(t, '^yes') THEN 'Yes' WHEN regexp_matches(t, '^no') THEN 'No' WHEN contains(t, 'yes') AND NOT contains(t, 'no') THEN 'Yes' WHEN contains(t, 'no') AND NOT contains(t, 'yes') THEN 'No' ELSE 'Unknown' END AS answer FROM (SELECT result_id, lower(regexp_replace(regexp_replace(string_split(coalesce(round1_raw_response, ''), 'assistant')[-1], '(?s)<think>.*?</think>', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS t FROM stage9_repeat_detailed)")
def proj_yes_no_answer(s, d):
    return table(s, d, "stage9_repeat_detailed").select("result_id", scalars.yes_no(F.col("round1_raw_response")).alias("answer"))


@R.add("SELECT doc_id, CASE WHEN trim(sl, '_') = '' THEN 'agent' ELSE trim(sl, '_') END AS slug FROM (SELECT doc_id, regexp_replace(source || '/' || coalesce(doc_type, ''), '[^0-9A-Za-z]+', '_', 'g') AS sl FROM documents)")
def proj_slug(s, d):
    name = F.concat_ws("/", "source", F.coalesce("doc_type", F.lit("")))
    return table(s, d, "documents").filter("source is not null").select("doc_id", scalars.slug(name).alias("slug"))


# --- filters, semi-, anti- and outer joins, sets

@R.add(f"WITH {OI} SELECT customer_id, count(DISTINCT order_id) AS n_orders FROM train GROUP BY 1 HAVING count(DISTINCT order_id) >= 5")
def filter_active_customers(s, d):
    return active(train(s, d))


def active(rows, least: int = 5, most: int | None = None):
    """Customers with at least ``least`` orders, and at most ``most`` where that is given."""
    n = rows.select("customer_id", "order_id").distinct().groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_orders")).filter(F.col("n_orders") >= least)
    return n if most is None else n.filter(F.col("n_orders") <= most)


def repeat_rows(s, d, least: int = 5, most: int | None = None):
    known = train(s, d).join(active(train(s, d), least, most), "customer_id", "left_semi").select("customer_id", "vendor_id").distinct()
    return test(s, d).join(known, ["customer_id", "vendor_id"], "left_semi")


ACTIVE = "active AS (SELECT customer_id FROM train GROUP BY 1 HAVING count(DISTINCT order_id) >= 5), repeats AS (SELECT t.* FROM test t WHERE EXISTS (SELECT 1 FROM train x WHERE x.customer_id = t.customer_id AND x.vendor_id = t.vendor_id AND x.customer_id IN (SELECT customer_id FROM active)))"


@R.add(f"WITH {OI}, {ACTIVE} SELECT row_id, customer_id, order_id, vendor_id FROM repeats")
def filter_repeat_orders(s, d):
    return repeat_rows(s, d).select("row_id", "customer_id", "order_id", "vendor_id")


@R.add(f"WITH {OI}, {ACTIVE} SELECT (SELECT count(*) FROM test) AS rows_before, (SELECT count(*) FROM repeats) AS rows_after, (SELECT count(DISTINCT customer_id) FROM test WHERE customer_id IN (SELECT customer_id FROM train)) AS users_in_both, round((SELECT count(*) FROM repeats) / (SELECT count(*) FROM test), 6) AS repeat_rate")
def agg_filter_stats(s, d):
    t = test(s, d)
    flagged = t.join(train(s, d).select("customer_id", F.lit(1).alias("seen")).distinct(), "customer_id", "left").select("row_id", "customer_id", "seen")
    flagged = flagged.join(repeat_rows(s, d).select("row_id", F.lit(1).alias("kept")), "row_id", "left")
    a = flagged.agg(F.count(F.lit(1)).alias("rows_before"), F.count("kept").alias("rows_after"), F.countDistinct(F.when(F.col("seen") == 1, F.col("customer_id"))).alias("users_in_both"))
    return a.withColumn("repeat_rate", r6(F.try_divide(F.col("rows_after"), F.col("rows_before"))))


@R.add(f"WITH {OI} SELECT customer_id, customer_id IN (SELECT customer_id FROM train) AS warm, count(*) AS n_rows FROM test GROUP BY 1")
def filter_warm_cold(s, d):
    t = test(s, d).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_rows"))
    warm = train(s, d).select("customer_id", F.lit(True).alias("warm")).distinct()
    return t.join(warm, "customer_id", "left").select("customer_id", F.coalesce("warm", F.lit(False)).alias("warm"), "n_rows")


@R.add(f"WITH {OI} SELECT * FROM ((SELECT 'both' AS part, vendor_id FROM train INTERSECT SELECT 'both', vendor_id FROM test) UNION ALL (SELECT 'train_only', vendor_id FROM train EXCEPT SELECT 'train_only', vendor_id FROM test) UNION ALL (SELECT 'test_only', vendor_id FROM test EXCEPT SELECT 'test_only', vendor_id FROM train))")
def set_vendor_overlap(s, d):
    a, b = train(s, d).select("vendor_id"), test(s, d).select("vendor_id")
    tag = lambda df, name: df.select(F.lit(name).alias("part"), "vendor_id")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "train_only")).unionByName(tag(b.subtract(a), "test_only"))


@R.add(f"WITH {OI} SELECT coalesce(a.cuisine, b.cuisine) AS cuisine, coalesce(a.n, 0) AS n_train, coalesce(b.n, 0) AS n_test FROM (SELECT cuisine, count(*) AS n FROM train GROUP BY 1) a FULL JOIN (SELECT cuisine, count(*) AS n FROM test GROUP BY 1) b ON a.cuisine = b.cuisine")
def join_train_test_counts(s, d):
    a = train(s, d).groupBy("cuisine").agg(F.count(F.lit(1)).alias("n_train"))
    b = test(s, d).groupBy("cuisine").agg(F.count(F.lit(1)).alias("n_test"))
    return a.join(b, "cuisine", "full_outer").fillna(0, ["n_train", "n_test"])


_OVER = " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE a) AS n_train, count(*) FILTER (WHERE b) AS n_test, count(*) FILTER (WHERE a AND b) AS n_both, round(100.0 * count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a), 6)::DOUBLE AS pct_of_train, round(100.0 * count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE b), 6)::DOUBLE AS pct_of_test FROM (SELECT {c}, bool_or(day_num < {SPLIT_DAY}) AS a, bool_or(day_num >= {SPLIT_DAY}) AS b FROM oi GROUP BY 1)" for c in ("customer_id", "cuisine", "vendor_id"))


@R.add(f"WITH {OI} {_OVER}")
def agg_overlap_summary(s, d):
    o = order_items(s, d)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("customer_id", "cuisine", "vendor_id")]))
    v = o.select("day_num", each.alias("x")).groupBy("x.field", "x.v").agg(F.bool_or(F.col("day_num") < SPLIT_DAY).alias("a"), F.bool_or(F.col("day_num") >= SPLIT_DAY).alias("b"))
    n = v.groupBy("field").agg(F.count_if("a").alias("n_train"), F.count_if("b").alias("n_test"), F.count_if(F.col("a") & F.col("b")).alias("n_both"))
    return n.withColumn("pct_of_train", r6(F.try_divide(F.col("n_both") * 100.0, F.col("n_train")))).withColumn("pct_of_test", r6(F.try_divide(F.col("n_both") * 100.0, F.col("n_test"))))


@R.add(f"WITH {OI} SELECT count(*) AS n_rows, count(*) FILTER (WHERE customer_id NOT IN (SELECT customer_id FROM train)) AS cold_rows, round(count(*) FILTER (WHERE customer_id NOT IN (SELECT customer_id FROM train)) / count(*), 6) AS cold_share FROM test")
def agg_cold_start_share(s, d):
    seen = train(s, d).select("customer_id", F.lit(1).alias("seen")).distinct()
    a = test(s, d).select("customer_id").join(seen, "customer_id", "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("seen").isNull()).alias("cold_rows"))
    return a.withColumn("cold_share", r6(F.try_divide(F.col("cold_rows"), F.col("n_rows"))))


@R.add(f"WITH {OI} SELECT DISTINCT vendor_geohash, cuisine, vendor_id FROM oi")
def set_distinct_places(s, d):
    return order_items(s, d).select("vendor_geohash", "cuisine", "vendor_id").dropDuplicates()


@R.add(f"WITH {OI} SELECT customer_id AS src, vendor_id AS dst FROM (SELECT DISTINCT customer_id, vendor_id FROM oi) UNION ALL SELECT vendor_id, customer_id FROM (SELECT DISTINCT customer_id, vendor_id FROM oi)")
def set_edge_union(s, d):
    e = order_items(s, d).select(F.col("customer_id").alias("src"), F.col("vendor_id").alias("dst")).distinct()
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


# --- aggregations

@R.add(f"WITH {OI} SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, count(DISTINCT order_id) AS n_orders, count(DISTINCT vendor_id) AS n_vendors, count(DISTINCT cuisine) AS n_cuisines, count(DISTINCT product_id) AS n_products, round(count(*) / count(DISTINCT order_id), 6) AS rows_per_order FROM oi")
def agg_dataset_stats(s, d):
    a = order_items(s, d).agg(F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(c).alias(n) for c, n in (("customer_id", "n_customers"), ("order_id", "n_orders"), ("vendor_id", "n_vendors"), ("cuisine", "n_cuisines"), ("product_id", "n_products"))])
    return a.withColumn("rows_per_order", r6(F.try_divide(F.col("n_rows"), F.col("n_orders"))))


_FIRST = "firsts AS (SELECT customer_id, order_id, arg_min(cuisine, row(day_num, hour, row_id)) FILTER (WHERE cuisine <> 'unknown') AS cuisine FROM oi GROUP BY 1, 2)"


@R.add(f"WITH {OI}, {_FIRST} SELECT * FROM firsts")
def agg_first_per_order(s, d):
    return profiles.first_per_order(order_items(s, d), "cuisine")


@R.add(f"WITH {OI}, {_FIRST} SELECT customer_id, cuisine, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY customer_id), 6) AS share FROM firsts WHERE cuisine IS NOT NULL GROUP BY 1, 2")
def agg_cuisine_shares(s, d):
    return profiles.distribution(profiles.first_per_order(order_items(s, d), "cuisine"), "customer_id", "cuisine").withColumn("share", r6("share"))


@R.add(f"WITH {OI} SELECT customer_id, user_geohash AS home_geohash FROM (SELECT customer_id, user_geohash, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, user_geohash) AS rn FROM oi GROUP BY 1, 2) WHERE rn = 1")
def agg_home_geohash(s, d):
    return profiles.top_categories(order_items(s, d), "customer_id", "user_geohash", 1).select("customer_id", F.col("user_geohash").alias("home_geohash"))


def _top_sql(key: str, cat: str, k: int) -> str:
    return f"SELECT {key}, {cat}, n, CAST(rank AS INT) AS rank FROM (SELECT {key}, {cat}, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {cat}) AS rank FROM og GROUP BY 1, 2) WHERE rank <= {k}"


@R.add(f"WITH {OI} {_top_sql('customer_id', 'hour', 3)}")
def agg_peak_hours(s, d):
    return profiles.top_categories(profiles.order_grain(order_items(s, d)), "customer_id", "hour", 3)


@R.add(f"WITH {OI} {_top_sql('customer_id', 'vendor_id', 5)}")
def agg_top_vendors(s, d):
    return profiles.top_categories(profiles.order_grain(order_items(s, d)), "customer_id", "vendor_id", 5)


@R.add(f"WITH {OI}, t AS (SELECT customer_id, order_id, sum(unit_price) AS total FROM oi GROUP BY 1, 2) SELECT customer_id, round(avg(total), 8) AS avg_total, round(coalesce(stddev_samp(total), 0.0), 8) AS std_total, round(min(total), 8) AS min_total, round(max(total), 8) AS max_total FROM t GROUP BY 1")
def agg_price_stats(s, d):
    p = profiles.price_stats(order_items(s, d), "customer_id")
    return p.withColumns({c: F.round(c, 8) for c in p.columns if c != "customer_id"})


@R.add(f"WITH {OI}, t AS (SELECT customer_id, order_id, count(*) AS items FROM oi GROUP BY 1, 2), v AS (SELECT customer_id, count(DISTINCT vendor_id) AS n_vendors FROM oi GROUP BY 1) SELECT t.customer_id, count(*) AS n_orders, round(avg(items), 6) AS basket_size, any_value(n_vendors) AS n_vendors, round(any_value(n_vendors) / count(*), 6) AS vendor_diversity FROM t JOIN v USING (customer_id) GROUP BY 1")
def agg_loyalty(s, d):
    return profiles.loyalty(order_items(s, d)).withColumns({c: r6(c) for c in ("basket_size", "vendor_diversity")})


@R.add(f"WITH {OI} SELECT customer_id, chain_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY customer_id), 6) AS share FROM og WHERE chain_id <> '' GROUP BY 1, 2")
def agg_chain_shares(s, d):
    return profiles.distribution(profiles.order_grain(order_items(s, d)).filter("chain_id <> ''"), "customer_id", "chain_id").withColumn("share", r6("share"))


@R.add(f"WITH {OI}, m AS (SELECT cuisine, CASE WHEN hour BETWEEN 6 AND 10 THEN 'breakfast' WHEN hour BETWEEN 11 AND 14 THEN 'lunch' WHEN hour BETWEEN 15 AND 17 THEN 'afternoon' WHEN hour BETWEEN 18 AND 21 THEN 'dinner' ELSE 'late_night' END AS meal FROM og) SELECT cuisine, meal, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cuisine), 6) AS share FROM m GROUP BY 1, 2")
def agg_meal_shares(s, d):
    g = profiles.order_grain(order_items(s, d)).withColumn("meal", scalars.meal_of(F.col("hour")))
    return profiles.distribution(g, "cuisine", "meal").withColumn("share", r6("share"))


@R.add(f"WITH {OI} SELECT cuisine, count(DISTINCT order_id) AS n_orders, count(DISTINCT customer_id) AS n_customers, round(count(DISTINCT order_id) / greatest(count(DISTINCT customer_id), 1), 6) AS orders_per_customer FROM oi GROUP BY 1")
def agg_popularity(s, d):
    return profiles.popularity(order_items(s, d), "cuisine").withColumn("orders_per_customer", r6("orders_per_customer"))


_PROFILE_SQL = f"""WITH {OI}, f AS (SELECT * FROM og),
lists AS (SELECT customer_id, string_agg(hour::VARCHAR, ',' ORDER BY rank) AS peak_hours FROM ({_top_sql('customer_id', 'hour', 3)}) GROUP BY 1),
vend AS (SELECT customer_id, string_agg(vendor_id || ':' || n, ',' ORDER BY rank) AS top_vendors FROM ({_top_sql('customer_id', 'vendor_id', 5)}) GROUP BY 1),
shares AS (SELECT customer_id, string_agg(cuisine || '=' || n, ',' ORDER BY cuisine) AS cuisines FROM (SELECT customer_id, cuisine, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
hist AS (SELECT customer_id, string_agg(order_id::VARCHAR, ',' ORDER BY day_num, hour, order_id) AS history FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY day_num DESC, hour DESC, order_id DESC) <= 50) GROUP BY 1)
SELECT customer_id, peak_hours, top_vendors, cuisines, history FROM lists JOIN vend USING (customer_id) JOIN shares USING (customer_id) JOIN hist USING (customer_id)"""


@R.add(_PROFILE_SQL)
def profile_customers(s, d):
    p = profiles.customer_profiles(order_items(s, d))
    text = lambda a, f: F.array_join(F.transform(a, f), ",")
    shares = F.array_sort(F.map_entries("cuisine_shares"))
    return p.select("customer_id", text(F.col("peak_hours"), lambda x: x.cast("string")).alias("peak_hours"), text(F.col("top_vendors"), lambda x: F.concat_ws(":", x["vendor_id"], x["n"].cast("string"))).alias("top_vendors"), text(shares, lambda x: F.concat_ws("=", x["key"], F.round(x["value"] * F.col("n_orders")).cast("long").cast("string"))).alias("cuisines"), text(F.col("history"), lambda x: x["order_id"].cast("string")).alias("history"))


@R.add(f"""WITH {OI}, pop AS (SELECT cuisine, count(DISTINCT order_id) AS n_orders, count(DISTINCT customer_id) AS n_customers FROM oi GROUP BY 1),
hrs AS (SELECT cuisine, string_agg(hour::VARCHAR, ',' ORDER BY rank) AS peak_hours FROM ({_top_sql('cuisine', 'hour', 3)}) GROUP BY 1), dys AS (SELECT cuisine, string_agg(day_of_week::VARCHAR, ',' ORDER BY rank) AS peak_days FROM ({_top_sql('cuisine', 'day_of_week', 3)}) GROUP BY 1),
ven AS (SELECT cuisine, string_agg(vendor_id, ',' ORDER BY rank) AS top_vendors FROM ({_top_sql('cuisine', 'vendor_id', 5)}) GROUP BY 1)
SELECT * FROM pop JOIN hrs USING (cuisine) JOIN dys USING (cuisine) JOIN ven USING (cuisine)""")
def profile_cuisines(s, d):
    p = profiles.cuisine_profiles(order_items(s, d)).filter("peak_hours is not null")
    return p.select("cuisine", "n_orders", "n_customers", F.array_join(F.col("peak_hours").cast("array<string>"), ",").alias("peak_hours"), F.array_join(F.col("peak_days").cast("array<string>"), ",").alias("peak_days"), F.array_join("top_vendors", ",").alias("top_vendors"))


@R.add(f"WITH {OI}, t AS (SELECT customer_id, order_id, count(*) AS items, sum(unit_price) AS total FROM oi GROUP BY 1, 2), u AS (SELECT customer_id, count(*) AS n_orders, avg(items) AS basket, avg(total) AS total FROM t GROUP BY 1) SELECT count(*) AS n_customers, sum(n_orders)::BIGINT AS n_orders, round(avg(n_orders), 6) AS avg_orders, round(avg(basket), 6) AS avg_basket, round(avg(total), 4) AS avg_total FROM u")
def agg_customer_summary(s, d):
    o = order_items(s, d)
    u = profiles.loyalty(o).join(profiles.price_stats(o, "customer_id"), "customer_id")
    return u.agg(F.count(F.lit(1)).alias("n_customers"), F.sum("n_orders").alias("n_orders"), r6(F.avg("n_orders")).alias("avg_orders"), r6(F.avg("basket_size")).alias("avg_basket"), F.round(F.avg("avg_total"), 4).alias("avg_total"))


@R.add(f"WITH {OI}, h AS (SELECT cuisine, hour, count(*) / sum(count(*)) OVER (PARTITION BY cuisine) AS share FROM og GROUP BY 1, 2), w AS (SELECT cuisine, day_of_week, count(*) / sum(count(*)) OVER (PARTITION BY cuisine) AS share FROM og GROUP BY 1, 2) SELECT c.cuisine, round(0.6 * coalesce(h.share, 0) + 0.4 * coalesce(w.share, 0), 6) AS score FROM (SELECT DISTINCT cuisine FROM og) c LEFT JOIN h ON h.cuisine = c.cuisine AND h.hour = 19 LEFT JOIN w ON w.cuisine = c.cuisine AND w.day_of_week = 4 ORDER BY 0.6 * coalesce(h.share, 0) + 0.4 * coalesce(w.share, 0) DESC, c.cuisine LIMIT 10")
def top_peak_cuisines(s, d):
    return profiles.peak_cuisines(order_items(s, d), 19, 4, 10).withColumn("score", r6("score"))


@R.add(f"WITH {OI} SELECT customer_id, order_id, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM (SELECT DISTINCT customer_id, order_id, vendor_id || '||' || cuisine AS item FROM oi) GROUP BY 1, 2")
def agg_baskets(s, d):
    b = order_items(s, d).groupBy("customer_id", "order_id").agg(F.array_sort(F.collect_set(scalars.item_of("vendor_cuisine"))).alias("i"))
    return b.select("customer_id", "order_id", F.array_join("i", ",").alias("items"), F.size("i").cast("long").alias("n_items"))


@R.add(f"WITH {OI} SELECT customer_id, cuisine, count(DISTINCT order_id) AS n, round(count(DISTINCT order_id) / sum(count(DISTINCT order_id)) OVER (PARTITION BY customer_id), 6) AS share FROM oi GROUP BY 1, 2")
def agg_customer_cuisine_counts(s, d):
    n = order_items(s, d).select("customer_id", "cuisine", "order_id").distinct()
    return profiles.distribution(n, "customer_id", "cuisine").withColumn("share", r6("share"))


@R.add(f"WITH {OI} SELECT count(DISTINCT vendor_geohash) AS n_places, count(DISTINCT cuisine) AS n_cuisines, count(DISTINCT vendor_id) AS n_vendors, count(*) AS n_entries FROM (SELECT DISTINCT vendor_geohash, cuisine, vendor_id FROM oi)")
def agg_place_index_stats(s, d):
    e = order_items(s, d).select("vendor_geohash", "cuisine", "vendor_id").distinct()
    return e.agg(F.countDistinct("vendor_geohash").alias("n_places"), F.countDistinct("cuisine").alias("n_cuisines"), F.countDistinct("vendor_id").alias("n_vendors"), F.count(F.lit(1)).alias("n_entries"))


@R.add(f"WITH {OI}, e AS (SELECT DISTINCT customer_id, vendor_id FROM oi) SELECT count(DISTINCT customer_id) AS n_users, count(DISTINCT vendor_id) AS n_items, count(*) AS n_interactions, round(count(*) / count(DISTINCT customer_id), 6) AS avg_degree FROM e")
def agg_interaction_stats(s, d):
    e = order_items(s, d).select("customer_id", "vendor_id").distinct()
    a = e.agg(F.countDistinct("customer_id").alias("n_users"), F.countDistinct("vendor_id").alias("n_items"), F.count(F.lit(1)).alias("n_interactions"))
    return a.withColumn("avg_degree", r6(F.try_divide(F.col("n_interactions"), F.col("n_users"))))


@R.add(f"WITH {OI} SELECT cuisine, count(DISTINCT order_id) AS n_orders FROM oi GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_cuisines(s, d):
    n = order_items(s, d).select("cuisine", "order_id").distinct().groupBy("cuisine").agg(F.count(F.lit(1)).alias("n_orders"))
    return n.orderBy(F.desc("n_orders"), "cuisine").limit(10)
