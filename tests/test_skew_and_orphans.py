from collections import defaultdict

from larder.operators.orphans import Parent, orphan_keys, orphan_report, orphan_rows
from larder.operators.skew import skew_safe_profile

ROWS = "vendor string, cuisine string, customer string, order_id long, price double, key string"


def profile(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return {(r.field_name, r.key_value): (r.n_rows, r.n_units, r.n_parties, round(r.amount, 4), r.total_rows) for r in skew_safe_profile(df, ["vendor", "cuisine", "customer"], "order_id", "customer", "price").collect()}


def brute(rows):
    out = defaultdict(lambda: [0, set(), set(), 0.0])
    for v, c, p, o, a, _ in rows:
        for f, k in (("vendor", v), ("cuisine", c), ("customer", p)):
            if k is not None:
                x = out[f, k]
                x[0] += 1
                x[1] |= {o} - {None}
                x[2] |= {p} - {None}
                x[3] += a or 0
    return {k: (n, len(o), len(p), round(a, 4), len(rows)) for k, (n, o, p, a) in out.items()}


def test_profile_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"v{i % 7}", "c" if i % 5 else None, f"p{i % 11}" if i % 4 else None, i // 3, 0.1 * (i % 9), "x") for i in range(900)]
    rows += rows[:50] + [(None, None, None, None, None, None), ("v1", "c", "p1", None, None, "y")]
    assert profile(spark, rows) == brute(rows)


def test_profile_of_nothing(spark):
    assert profile(spark, []) == {}
    assert profile(spark, [(None, None, None, 1, 2.0, None)]) == {}


PARENT = "id string, b int, e int, day string"


def orphans(spark, rows, parents, **kw):
    df = spark.createDataFrame(rows, "row_id long, day int, k string, ref_table string")
    ps = [Parent("t", spark.createDataFrame(parents, PARENT), "id", "b", "e")]
    return sorted((r.row_id, r.orphan_kind) for r in orphan_rows(df, "row_id", {"t": "k"}, ps, **kw).collect())


CASES = [(1, 5, "a", "z"), (2, 0, "a", "z"), (3, 9, "a", "z"), (4, 5, "gone", "z"), (5, 5, None, "z"), (6, 7, "twice", "z"), (7, 3, "twice", "z"), (8, None, "a", "z"), (9, None, "gone", "z"), (1, 9, "a", "z"), (10, 1, "open", "z")]
PARENTS = [(" A ", 1, 8, "x"), ("A", 1, 8, "x"), ("twice", 0, 2, None), ("twice", 5, None, None), (None, 0, None, None), ("open", None, None, None), ("-", 0, None, None)]
WANT = [(1, "deleted"), (2, "late"), (3, "deleted"), (4, "missing"), (7, "deleted"), (9, "missing")]


def test_kinds_and_both_joins(spark):
    assert orphans(spark, CASES, PARENTS) == WANT
    assert orphans(spark, CASES, PARENTS, broadcast_keys=0) == WANT


def test_empty_sides(spark):
    assert orphans(spark, [], PARENTS) == []
    assert orphans(spark, [(1, 1, "a", "z")], []) == [(1, "missing")]


def test_report_adds_up(spark):
    df = spark.createDataFrame(CASES, "row_id long, day int, k string, ref_table string")
    ps = [Parent("t", spark.createDataFrame(PARENTS, PARENT), "id", "b", "e")]
    report = orphan_report(df, {"t": "k"}, ps, 7).collect()
    assert sum(r.n_rows for r in report) == sum(r.n_rows for r in orphan_keys(df, {"t": "k"}, ps).collect()) == len(WANT)
    assert {(r.period, r.orphan_kind): r.n_keys for r in report}[(1, "deleted")] == 1
