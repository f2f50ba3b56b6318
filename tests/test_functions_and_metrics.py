import math

import pytest
from pyspark.sql import functions as F

from larder.functions import scalars
from larder.operators import metrics, ranking, samples, similarity


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize("text,want", [("Yes", "Yes"), ("no, I don't think so", "No"), ("The answer is Yes.", "Yes"), ("<think>maybe no</think> Yes", "Yes"), ("Maybe", "Unknown"), ("I don't know", "No"), ("Both yes and no", "Unknown"), ("", "Unknown"), (None, "Unknown"), ("Uncertain", "Unknown"), ("prompt assistant\n yes", "Yes")])
def test_yes_no(spark, text, want):
    assert one(spark, scalars.yes_no(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("name,want", [("Large Pad Thai 500 g", "thai"), ("Margherita Pizza", "italian"), ("Chicken Tikka Masala", "indian"), ("Classic Burger 2 st", "burger"), ("Veggie Wok", "chinese"), ("Random Product Name", None), (None, None), ("", None), ("Lax Teriyaki", "japanese")])
def test_product_category(spark, name, want):
    assert one(spark, scalars.product_category(scalars.product_words(F.lit(name).cast("string")))) == want


def test_small_functions(spark):
    assert one(spark, scalars.product_words(F.lit("Stor  Pizza 33 cl XL"))) == "pizza"
    assert one(spark, scalars.category_confidence(F.lit("sushi maki ramen"), "japanese")) == 1.0
    assert one(spark, scalars.item_vendor(F.lit("a||b||c"))) == "a" and one(spark, scalars.item_cuisine(F.lit("a||b||c"))) == "b||c"
    assert one(spark, scalars.item_vendor(F.lit("x"))) == "unknown"
    assert one(spark, scalars.slug(F.lit("--"))) == "agent" and one(spark, scalars.slug(F.lit("My Agent!"))) == "My_Agent"
    assert one(spark, scalars.without_ansi(F.lit("\x1b[31mred\x1b[0m"))) == "red"
    assert one(spark, scalars.word_count(F.lit("  "))) == 0 and one(spark, scalars.word_count(F.lit(" a  b "))) == 2
    assert one(spark, scalars.day_name(F.lit(7))) == "Unknown" and one(spark, scalars.day_name(F.lit(0))) == "Mon"
    assert one(spark, scalars.embedded_list(F.lit('x {"ranking": ["a", "b"], "r": 1} y'), "ranking")) == ["a", "b"]
    assert one(spark, scalars.embedded_list(F.lit('x {"ranking": [ y}'), "ranking")) in (None, [])
    assert one(spark, scalars.last_of(arr("a", "b"), 5)) == ["a", "b"] and one(spark, scalars.last_of(arr("a", "b", "c"), 2)) == ["b", "c"]


P, G = ("Italian", "Chinese", "Thai"), ("Thai", "Indian")


def test_basket_golden(spark):
    at = lambda k, m, p=P, g=G: one(spark, metrics.basket_scores(arr(*p), arr(*g), k)[m])
    assert (at(3, "hit"), at(1, "hit"), at(3, "recall")) == (1.0, 0.0, 0.5)
    assert at(3, "precision") == pytest.approx(1 / 3)
    assert at(5, "ndcg", ("Thai", "Indian")) == pytest.approx(1.0)
    assert 0 < at(5, "ndcg", ("Chinese", "Thai", "Indian")) < 1
    assert [at(3, m, ()) for m in ("hit", "recall", "precision", "ndcg", "f1")] == [0.0] * 5
    assert [at(3, m, P, ()) for m in ("hit", "recall", "precision", "ndcg", "f1")] == [0.0] * 5
    assert at(1, "recall", ("Thai",), ("Thai",)) == 1.0
    assert one(spark, metrics.basket_mrr(arr(*P), arr(*G))) == pytest.approx(1 / 3)
    assert one(spark, metrics.basket_mrr(arr(), arr(*G))) == 0.0


def test_ranks(spark):
    assert one(spark, scalars.ndcg_of(F.lit(3), 5)) == pytest.approx(0.5) and one(spark, scalars.ndcg_of(F.lit(0), 5)) == 0
    assert one(spark, scalars.rank_of(arr("A", "b"), F.lit("B"))) == 2 and one(spark, scalars.rank_of(F.lit(None).cast("array<string>"), F.lit("b"))) == 0


def test_classification_golden(spark):
    rows = list(zip(["Yes", "Yes", "Yes", "No", "No"], ["Yes", "No", "Yes", "Unknown", "No"]))
    r = metrics.classification(spark.createDataFrame(rows, "y string, p string"), "y", "p").first()
    assert (r.accuracy, r.correct, r.n) == (0.6, 3, 5)
    rows = list(zip(["Yes", "Yes", "Yes", "No"], ["Yes", "No", "Yes", "No"]))
    r = metrics.classification(spark.createDataFrame(rows, "y string, p string"), "y", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision) == (2, 0, 1, 1, 1.0) and r.recall == pytest.approx(2 / 3) and r.f1 == pytest.approx(0.8)
    assert metrics.classification(spark.createDataFrame([], "y string, p string"), "y", "p").first().f1 == 0.0


def test_nearest_percentiles(spark):
    for n in (1, 5, 25, 150):
        v = sorted(float((i * 37) % 101) for i in range(n))
        r = metrics.nearest_percentiles(spark.createDataFrame([(x,) for x in v] + [(None,)], "x double"), "x", 3).first()
        assert (r.n, r.p50) == (n, v[n // 2])
        assert r.p90 == (v[int(n * 0.9)] if n >= 10 else v[-1]) and r.p99 == (v[int(n * 0.99)] if n >= 100 else v[-1])


def test_swing_cosine_jaccard_golden(spark):
    e = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "u string, i string")
    s = {(r.a, r.b): r.sim for r in similarity.swing(e, "u", "i").collect()}
    assert s[("A", "B")] == s[("B", "A")] == pytest.approx(1 / (7**0.3 * 6**0.3 * 3))
    q = spark.createDataFrame([("A",)], "u string")
    assert similarity.swing(e, "u", "i", q).first().sim == pytest.approx(s[("A", "B")])
    assert similarity.jaccard(e, "u", "i", q).first().sim == 0.5
    assert similarity.cosine(e.withColumn("n", F.lit(1)), "u", "i", q).first().sim == pytest.approx(1 / math.sqrt(2))


def test_recency_and_split(spark):
    cols = "customer_id string, order_id long, row_id long, vendor_id string, day_num int, hour int"
    train = spark.createDataFrame([("c", i, i, v, i, 1) for i, v in enumerate("abac")], cols)
    test = spark.createDataFrame([("c", 10, 10, "a", 9, 1), ("c", 11, 11, "d", 9, 2)], cols)
    got = {r.vendor_id: r.recency_distance for r in samples.recency_distance(train, test).collect()}
    assert got == {"a": 1, "d": 4}
    ev = spark.createDataFrame([("u", i) for i in range(20)], "u string, t int")
    parts = [r.part for r in samples.chronological_split(ev, "u", ["t"], 0.05, 0.1).orderBy("t").collect()]
    assert parts.index("val") == 17 and parts.index("test") == 18


def test_round_robin(spark):
    idx = spark.createDataFrame([("g", "p", v, i) for i, v in enumerate("123", 1)] + [("g", "q", "9", 1), ("other", "p", "8", 1)], "vendor_geohash string, cuisine string, vendor_id string, pos int")
    w = spark.createDataFrame([("s", "g", "p", 1), ("s", "g", "q", 2)], "sample string, vendor_geohash string, cuisine string, cuisine_pos int")
    assert [r.vendor_id for r in ranking.round_robin(w, idx, 3).orderBy("rank").collect()] == ["1", "9", "2"]


def test_rankings(spark):
    c = arr("A||x", "B||y", "C||z")
    assert one(spark, ranking.repaired(arr(" b||Y ", "b||y", "nope"), c)) == ["B||y", "A||x", "C||z"]
    assert one(spark, ranking.repaired(F.lit(None).cast("array<string>"), c)) == ["A||x", "B||y", "C||z"]
    assert one(spark, ranking.mentioned_first(F.lit("take c||z"), c)) == ["C||z", "A||x", "B||y"]
    assert one(spark, ranking.single_pick(F.lit("none"), c)) == "A||x" and one(spark, ranking.single_pick(F.lit("B||y "), c)) == "B||y"
    assert one(spark, ranking.with_frequent(arr("a", "b"), arr("b", "c"))) == ["a", "c"]
    assert one(spark, ranking.with_frequent(arr(), arr("b"))) == ["b"] and one(spark, ranking.with_frequent(arr("a", "b"), arr("a"))) == ["a", "b"]
    for n in range(4):
        got = one(spark, ranking.injected(c, F.lit("T"), F.lit(n), 3))
        assert len(got) == 3 and "T" in got and got[0] != "T"
    assert sorted(one(spark, ranking.hash_order(c, F.lit(5)))) == ["A||x", "B||y", "C||z"]


def test_evidence_caps(spark):
    rows = [("s", p, i) for p in range(1, 7) for i in range(1, 9)]
    got = ranking.capped_evidence(spark.createDataFrame(rows, "sample string, peer_pos int, pos int"), 5, 12).collect()
    by = {}
    for r in got:
        by.setdefault(r.peer_pos, []).append(r.pos)
    assert {k: sorted(v) for k, v in by.items()} == {1: [4, 5, 6, 7, 8], 2: [4, 5, 6, 7, 8], 3: [7, 8]}
