"""Queries of the general record operators (problems 1, 5 and 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import ids
from larder.operators.nested import Child, flatten_columns, flatten_lines
from larder.operators.orphans import Parent, orphan_report, orphan_rows
from larder.operators.skew import skew_safe_profile
from larder.plans.sqlparts import CLEAN_IDS, CUISINE_NAMES
from larder.session import spread, table


RECORD = Child("user_record", ("vendor_id", "cuisine"), ("vendor_id", "cuisine", "slot"))
RESULT = {
    "order_history_tuples": Child("history", ("vendor_id", "cuisine"), ("vendor_id", "cuisine", "slot")),
    "lightgcn_top_cuisines": Child("cuisine", ("cuisine",), ("cuisine", "score")),
    "similar_users": Child("user", ("user_id",), ("user_id", "similarity", "record_count", "records"), {"records": RECORD}),
}


def _children(spark: SparkSession, d: str, detail: bool) -> DataFrame:
    detailed = flatten_columns(spread(table(spark, d, "stage9_repeat_detailed").select("result_id", *RESULT)), "result_id", RESULT, detail)
    raw = flatten_lines(spread(table(spark, d, "stage9_repeat_raw").select("line_id", "line")), "line_id", "line", RESULT, detail)
    return detailed.withColumn("src", F.lit("detailed")).unionByName(raw.withColumn("src", F.lit("raw")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _children(spark, d, False).select("src", "rec_id", "child", "parent_pos", "pos", "item_key")


def p1_detailed(spark: SparkSession, d: str) -> DataFrame:
    """The child rows of the typed columns alone."""
    return flatten_columns(table(spark, d, "stage9_repeat_detailed").select("result_id", *RESULT), "result_id", RESULT).select("rec_id", "child", "parent_pos", "pos", "item_key")


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """The child tables with each element's own JSON text, from which its other fields can be read."""
    return _children(spark, d, True)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "food_orders").select("vendor_id", "cuisine", "customer_id", "order_id", "unit_price")
    named = ids.with_canonical(rows, "cuisine", "cuisine_name", table(spark, d, "vendors"), "primary_cuisine")
    clean = named.select(ids.clean_id(F.col("vendor_id")).alias("vendor_id"), F.col("cuisine_name").alias("cuisine"), ids.clean_id(F.col("customer_id")).alias("customer_id"), "order_id", "unit_price")
    out = skew_safe_profile(clean, ["vendor_id", "cuisine", "customer_id"], "order_id", "customer_id", "unit_price")
    return out.withColumnsRenamed({"n_units": "n_orders", "n_parties": "n_customers", "amount": "revenue"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_profile(spark, d).filter("n_rows * 100 >= total_rows * 7").select("field_name", "key_value")


REFERENCES = {"vendors": "vendor_key", "enriched_users": "customer_key", "chains": "chain_key"}


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, list[Parent]]:
    customer = ids.clean_id(F.col("customer_id"))
    rows = table(spark, d, "food_orders").select("row_id", ids.day_number(F.col("order_day")).alias("day"), ids.clean_id(F.col("vendor_id")).alias("vendor_key"), F.when(customer != ids.SHARED_ACCOUNT, customer).alias("customer_key"), ids.clean_id(F.col("chain_id")).alias("chain_key"))
    return rows, [Parent("vendors", table(spark, d, "vendors"), "vendor_id", "listed_day", "delisted_day"), Parent("enriched_users", table(spark, d, "enriched_users"), "customer_id", "registered_day", "deleted_day"), Parent("chains", table(spark, d, "chains"), "chain_id", "added_day", "removed_day")]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows, parents = _references(spark, d)
    return orphan_rows(rows, "row_id", REFERENCES, parents).select("row_id", "ref_table", "orphan_kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    rows, parents = _references(spark, d)
    return orphan_report(rows, REFERENCES, parents)


_P5 = f"""
{CUISINE_NAMES},
long AS (
  SELECT 'vendor_id' AS field_name, {CLEAN_IDS.format("vendor_id")} AS key_value, order_id, {CLEAN_IDS.format("customer_id")} AS customer, unit_price FROM food_orders
  UNION ALL SELECT 'customer_id', {CLEAN_IDS.format("customer_id")}, order_id, {CLEAN_IDS.format("customer_id")}, unit_price FROM food_orders
  UNION ALL SELECT 'cuisine', n.name, f.order_id, {CLEAN_IDS.format("f.customer_id")}, f.unit_price FROM food_orders f JOIN cuisine_names n ON f.cuisine = n.raw),
total AS (SELECT count(*) AS total_rows FROM food_orders),
prof AS (SELECT field_name, key_value, count(*) AS n_rows, count(DISTINCT order_id) AS n_orders, count(DISTINCT customer) AS n_customers, coalesce(sum(CAST(round(unit_price * 10000) AS BIGINT)), 0) / 10000 AS revenue
  FROM long WHERE key_value IS NOT NULL GROUP BY 1, 2)
"""

_P6 = f"""
refs AS (
  SELECT row_id, CAST(regexp_extract(order_day, '([0-9]+)', 1) AS INT) AS day, 'vendors' AS ref_table, {CLEAN_IDS.format("vendor_id")} AS k FROM food_orders
  UNION ALL SELECT row_id, CAST(regexp_extract(order_day, '([0-9]+)', 1) AS INT), 'enriched_users', nullif({CLEAN_IDS.format("customer_id")}, 'guest') FROM food_orders
  UNION ALL SELECT row_id, CAST(regexp_extract(order_day, '([0-9]+)', 1) AS INT), 'chains', {CLEAN_IDS.format("chain_id")} FROM food_orders),
spans AS (
  SELECT 'vendors' AS ref_table, {CLEAN_IDS.format("vendor_id")} AS k, listed_day AS b, delisted_day AS e FROM vendors
  UNION SELECT 'enriched_users', {CLEAN_IDS.format("customer_id")}, registered_day, deleted_day FROM enriched_users
  UNION SELECT 'chains', {CLEAN_IDS.format("chain_id")}, added_day, removed_day FROM chains),
judged AS (SELECT r.ref_table, r.k, r.day, r.n_rows, bool_or(s.k IS NOT NULL) AS there, bool_or(coalesce(s.k IS NOT NULL AND coalesce(s.b <= r.day, true), false)) AS begun,
    bool_or(coalesce(s.k IS NOT NULL AND coalesce(s.b <= r.day, true) AND coalesce(r.day < s.e, true), false)) AS valid
  FROM (SELECT ref_table, k, day, count(*) AS n_rows FROM refs WHERE k IS NOT NULL GROUP BY 1, 2, 3) r LEFT JOIN spans s ON s.ref_table = r.ref_table AND s.k = r.k GROUP BY 1, 2, 3, 4),
orphans AS (SELECT *, CASE WHEN NOT there THEN 'missing' WHEN NOT begun THEN 'late' ELSE 'deleted' END AS orphan_kind FROM judged WHERE NOT valid)
"""


def _elements(column: str, child: str, key: str) -> str:
    return f"SELECT result_id AS rec_id, '{child}' AS child, -1 AS parent_pos, CAST(i - 1 AS INT) AS pos, {key} AS item_key FROM (SELECT result_id, unnest({column}) AS x, generate_subscripts({column}, 1) AS i FROM stage9_repeat_detailed) WHERE x IS NOT NULL"


_PLACE = "coalesce(x.vendor_id, '') || '||' || coalesce(x.cuisine, '')"
_P1 = f"""{_elements("order_history_tuples", "history", _PLACE)}
UNION ALL {_elements("lightgcn_top_cuisines", "cuisine", "coalesce(x.cuisine, '')")}
UNION ALL {_elements("similar_users", "user", "coalesce(x.user_id, '')")}
UNION ALL SELECT result_id, 'user_record', CAST(i - 1 AS INT), CAST(j - 1 AS INT), {_PLACE} FROM (SELECT result_id, i, unnest(u.records) AS x, generate_subscripts(u.records, 1) AS j FROM (SELECT result_id, unnest(similar_users) AS u, generate_subscripts(similar_users, 1) AS i FROM stage9_repeat_detailed)) WHERE x IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_detailed": _P1,
        "p5_found": f"WITH {_P5} SELECT field_name, key_value FROM prof, total WHERE n_rows * 100 >= total_rows * 7",
        "p5_profile": f"WITH {_P5} SELECT *, n_rows / total_rows AS share FROM prof, total",
        "p6_found": f"WITH {_P6} SELECT r.row_id, r.ref_table, o.orphan_kind FROM refs r JOIN orphans o ON o.ref_table = r.ref_table AND o.k = r.k AND o.day = r.day",
        "p6_report": f"WITH {_P6} SELECT ref_table, CAST(floor(day / 7.0) AS BIGINT) AS period, orphan_kind, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(DISTINCT k) AS n_keys FROM orphans GROUP BY 1, 2, 3",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_detailed": p1_detailed, "p1_tables": p1_tables, "p5_found": p5_found, "p5_profile": p5_profile, "p6_found": p6_found, "p6_report": p6_report}
