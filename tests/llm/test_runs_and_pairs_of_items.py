import itertools
import random

import pytest
from pyspark.sql import functions as F

from larder.llm.cooccurrence import associations
from larder.llm.runs import collapse_runs

EV = "who string, t long, id long, vendor string, cuisine string, entity string, n string"


def runs(spark, rows, parts=5, **kw):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = collapse_runs(spark.createDataFrame(rows, EV), "who", ["t", "id"], ["vendor", "cuisine"], "id", "t", **kw).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return sorted((r.entity, r.same_vendor, r.same_cuisine, r.n, r.first_id, r.last_id, r.duration) for r in out)


def brute(rows, max_gap=None, least=1):
    out = []
    kept = [r for r in rows if r[0] is not None and r[3] is not None and r[4] is not None]
    kept.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    for r in kept:
        last = out[-1] if out else None
        near = not last or max_gap is None or last[6] is None or r[1] is None or r[1] - last[6] <= max_gap
        if last and (last[0], last[1], last[2]) == (r[0], r[3], r[4]) and near:
            last[3] += 1
            last[5], last[6] = r[2], r[1]
        else:
            out.append([r[0], r[3], r[4], 1, r[2], r[2], r[1], r[1]])
    return sorted((w, v, c, n, a, b, None if t1 is None or t0 is None else t1 - t0) for w, v, c, n, a, b, t1, t0 in out if n >= least)


@pytest.mark.parametrize("max_gap,least", [(None, 1), (None, 2), (3, 1)])
def test_runs_over_boundaries(spark, max_gap, least):
    """A hot entity with long runs is cut over many tasks; runs at the cuts are whole."""
    rnd = random.Random(3)
    rows, v = [], "a"
    for i in range(1500):
        v = rnd.choice("ab:1") if rnd.random() < 0.03 else v
        rows.append(("hot", i * rnd.choice([1, 1, 1, 5]) if max_gap else i, i, v, "x", "e", "n"))
    rows += [(f"w{i % 40}", i // 40, 2000 + i, rnd.choice(["v1", "v2"]), rnd.choice(["c", "1:c"]), "e", "n") for i in range(400)]
    rnd.shuffle(rows)
    for parts in (1, 7, 23):
        assert runs(spark, rows, parts, max_gap=max_gap, least=least) == brute(rows, max_gap, least)


def test_one_run_over_all_tasks(spark):
    rows = [("hot", i, i, "v", "c", None, None) for i in range(800)]
    assert runs(spark, rows, 9) == [("hot", "v", "c", 800, 0, 799, 799)]


def test_nulls_ties_repeats_and_nothing(spark):
    rows = [("a", 1, 1, "v", "c", "", ""), ("a", 1, 1, "v", "c", "", ""), ("a", 1, 2, None, "c", "", ""), ("a", 2, 3, "v", "c", "", ""), (None, 1, 4, "v", "c", "", ""), ("a", None, 0, "", "c", "", "")]
    assert runs(spark, rows) == brute(rows)
    assert runs(spark, []) == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute_near(rows, tolerance, max_gap):
    out = []
    for w, t, i, v, c, *_ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last = out[-1] if out else None
        if last and last[:2] == [w, v] and distance(last[2], c) <= tolerance and (max_gap is None or t - last[6] <= max_gap):
            last[3] += 1
            last[5], last[6] = i, t
        else:
            out.append([w, v, c, 1, i, i, t, t])
    return sorted((w, v, c, n, a, b, t1 - t0) for w, v, c, n, a, b, t1, t0 in out)


@pytest.mark.parametrize("max_gap", [None, 6])
def test_runs_around_anchors(spark, max_gap):
    """Writings that drift away from the first of a run, in a hot entity over many tasks."""
    rnd = random.Random(8)
    rows, c, t = [], "abcd", 0
    for i in range(1200):
        t += rnd.choice([1, 1, 2, 9])
        if rnd.random() < 0.4:
            k = rnd.randrange(len(c))
            c = c[:k] + rnd.choice("abcd") + c[k + 1 :]
        rows.append(("hot", t, i, "v" if rnd.random() < 0.98 else "w", c, "", ""))
    rows += [(f"e{i % 30}", i, 5000 + i, "v", rnd.choice(["thai", "tahi", "thaii", "pizza"]), "", "") for i in range(300)]
    want = brute_near(rows, 1, max_gap)
    rnd.shuffle(rows)
    for parts in (1, 6, 17):
        assert runs(spark, rows, parts, tolerance={"cuisine": 1}, max_gap=max_gap) == want


def brute_pairs(rows):
    baskets = {}
    for b, x in rows:
        if b is not None:
            baskets.setdefault(b, set()).add(x)
    sets = [s - {None} for s in baskets.values() if s - {None}]
    n, one, two = len(sets), {}, {}
    for s in sets:
        for x in s:
            one[x] = one.get(x, 0) + 1
        for p in itertools.combinations(sorted(s), 2):
            two[p] = two.get(p, 0) + 1
    return sorted((a, b, k, one[a], one[b], n) for (a, b), k in two.items())


@pytest.mark.parametrize("max_basket,chunk", [(512, 256), (6, 3), (2, 2)])
def test_pairs_with_huge_baskets(spark, max_basket, chunk):
    rnd = random.Random(1)
    rows = [(i % 60, rnd.choice("abcdefghij")) for i in range(300)] + [(999, f"x{i % 25}") for i in range(90)] + [(5, None), (None, "a"), (7000, None), (999, "a")]
    df = spark.createDataFrame(rows, "basket long, item string").withColumn("kind", F.lit(1)).withColumn("n", F.lit("z"))
    got = sorted((r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n) for r in associations(df, "basket", {"i": "item"}, max_basket, chunk).collect())
    assert got == brute_pairs(rows)


def test_no_pairs(spark):
    df = spark.createDataFrame([], "basket long, item string")
    assert associations(df, "basket", {"i": "item"}).count() == 0
    assert associations(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "basket long, item string"), "basket", {"i": "item"}).count() == 0
