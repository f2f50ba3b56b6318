"""DuckDB statements equal to the queries of this subpackage that SQL can express."""

from __future__ import annotations

from larder.plans.sqlparts import CLEAN_IDS, CUISINE_NAMES

_EVENTS = f"""
{CUISINE_NAMES},
first_rows AS (SELECT * FROM food_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY row_id) = 1),
events AS (SELECT f.order_id, {CLEAN_IDS.format('f.customer_id')} AS customer_id, {CLEAN_IDS.format('f.vendor_id')} AS vendor_id, n.name AS cuisine,
    CAST(regexp_extract(f.order_day, '([0-9]+)', 1) AS BIGINT) AS day, f.order_time
  FROM first_rows f JOIN cuisine_names n ON f.cuisine = n.raw),
kept AS (SELECT * FROM events WHERE customer_id IS NOT NULL AND vendor_id IS NOT NULL AND cuisine IS NOT NULL AND customer_id <> 'guest'),
numbered AS (SELECT *, row_number() OVER w - row_number() OVER v AS island, row_number() OVER w AS rn,
    day * 86400 + CAST(split_part(order_time, ':', 1) AS BIGINT) * 3600 + CAST(split_part(order_time, ':', 2) AS BIGINT) * 60 + CAST(split_part(order_time, ':', 3) AS BIGINT) AS ts
  FROM kept WINDOW w AS (PARTITION BY customer_id ORDER BY day, order_time, order_id), v AS (PARTITION BY customer_id, vendor_id, cuisine ORDER BY day, order_time, order_id)),
runs AS (SELECT customer_id, vendor_id, cuisine, count(*) AS n_orders, arg_min(order_id, rn) AS first_order_id, arg_max(order_id, rn) AS last_order_id, max(ts) - min(ts) AS seconds
  FROM numbered GROUP BY customer_id, vendor_id, cuisine, island)
"""

_NEAR = f"""
{CUISINE_NAMES},
first_rows AS (SELECT * FROM food_orders QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY row_id) = 1),
events AS (SELECT f.order_id, {CLEAN_IDS.format('f.customer_id')} AS customer_id, {CLEAN_IDS.format('f.vendor_id')} AS vendor_id, {CLEAN_IDS.format('r.squeezed')} AS cuisine,
    CAST(regexp_extract(f.order_day, '([0-9]+)', 1) AS BIGINT) AS day, f.order_time
  FROM first_rows f JOIN cuisine_raw r ON f.cuisine = r.raw),
kept AS (SELECT * FROM events WHERE customer_id IS NOT NULL AND vendor_id IS NOT NULL AND cuisine IS NOT NULL AND customer_id <> 'guest'),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY day, order_time, order_id) AS rn,
    day * 86400 + CAST(split_part(order_time, ':', 1) AS BIGINT) * 3600 + CAST(split_part(order_time, ':', 2) AS BIGINT) * 60 + CAST(split_part(order_time, ':', 3) AS BIGINT) AS ts
  FROM kept),
-- Each step goes on by one event a customer and carries the anchor of the open run.
walked AS (
  SELECT customer_id, rn, vendor_id, cuisine AS anchor, rn AS run, order_id, ts FROM numbered WHERE rn = 1
  UNION ALL
  SELECT e.customer_id, e.rn, e.vendor_id, CASE WHEN goes_on THEN anchor ELSE e.cuisine END, CASE WHEN goes_on THEN run ELSE e.rn END, e.order_id, e.ts
  FROM (SELECT w.anchor, w.run, x AS e, x.vendor_id = w.vendor_id AND levenshtein(x.cuisine, w.anchor) <= 2 AND x.ts - w.ts <= 30 * 86400 AS goes_on
        FROM walked w JOIN numbered x ON x.customer_id = w.customer_id AND x.rn = w.rn + 1))
SELECT customer_id, any_value(vendor_id) AS vendor_id, any_value(anchor) AS cuisine, count(*) AS n_orders, arg_min(order_id, rn) AS first_order_id, arg_max(order_id, rn) AS last_order_id, max(ts) - min(ts) AS seconds
FROM walked GROUP BY customer_id, run HAVING count(*) >= 2
"""

_WEEK = f"""
{_EVENTS},
broken AS (SELECT *, sum(CASE WHEN gap IS NOT NULL AND gap <= 7 * 86400 AND same THEN 0 ELSE 1 END) OVER (PARTITION BY customer_id ORDER BY rn) AS run
  FROM (SELECT *, ts - lag(ts) OVER w AS gap, vendor_id = lag(vendor_id) OVER w AND cuisine = lag(cuisine) OVER w AS same FROM numbered WINDOW w AS (PARTITION BY customer_id ORDER BY rn)))
SELECT customer_id, any_value(vendor_id) AS vendor_id, any_value(cuisine) AS cuisine, count(*) AS n_orders, arg_min(order_id, rn) AS first_order_id, arg_max(order_id, rn) AS last_order_id, max(ts) - min(ts) AS seconds
FROM broken GROUP BY customer_id, run
"""

_PAIRS = f"""
{CUISINE_NAMES},
items AS (
  SELECT DISTINCT 'cuisine' AS item_kind, f.order_id, n.name AS item FROM food_orders f JOIN cuisine_names n ON f.cuisine = n.raw WHERE n.name IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'vendor', order_id, {CLEAN_IDS.format('vendor_id')} FROM food_orders WHERE {CLEAN_IDS.format('vendor_id')} IS NOT NULL),
totals AS (SELECT item_kind, count(DISTINCT order_id) AS n FROM items GROUP BY 1),
singles AS (SELECT item_kind, item, count(*) AS c FROM items GROUP BY 1, 2),
both_items AS (SELECT a.item_kind, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM items a JOIN items b ON a.item_kind = b.item_kind AND a.order_id = b.order_id AND a.item < b.item GROUP BY 1, 2, 3),
pairs AS (SELECT p.item_kind, item_a, item_b, n_ab, x.c AS n_a, y.c AS n_b, t.n AS n,
    CAST(n_ab AS DOUBLE) * t.n / (CAST(x.c AS DOUBLE) * y.c) AS ratio, log2(CAST(n_ab AS DOUBLE) * t.n / (CAST(x.c AS DOUBLE) * y.c)) AS pmi, n_ab / (x.c + y.c - n_ab) AS jaccard
  FROM both_items p JOIN singles x ON x.item_kind = p.item_kind AND x.item = item_a JOIN singles y ON y.item_kind = p.item_kind AND y.item = item_b JOIN totals t ON t.item_kind = p.item_kind)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_EVENTS} SELECT customer_id, first_order_id, last_order_id FROM runs WHERE n_orders >= 2",
        "p2_runs": f"WITH {_EVENTS} SELECT * FROM runs",
        "p2_week_runs": f"WITH {_WEEK}",
        "p2_near_runs": f"WITH RECURSIVE {_NEAR}",
        "p4_found": f"WITH {_PAIRS} SELECT item_kind, item_a, item_b FROM pairs WHERE n_ab >= 5 AND n_ab * n >= 1.5 * n_a * n_b",
        "p4_pairs": f"WITH {_PAIRS} SELECT * REPLACE (round(ratio, 6) AS ratio, round(pmi, 6) AS pmi, round(jaccard, 6) AS jaccard) FROM pairs",
    }
