"""Chat records, seeded permutations and percentiles against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import scalars
from larder.operators import metrics, supervised
from larder.plans.evaluation_queries import _shuffled
from larder.sources import sinks

TURNS = "array<struct<role:string,content:string>>"


def plain(system, instruction, given, history):
    out = [("system", system)] if system else []
    out += [(r, c) for r, c in history or [] if r and c]
    return [*out, ("user", f"{instruction or ''}\n\n{given}" if given else instruction or "")]


def test_chat_messages(spark):
    cases = [
        ("be brief", "rank", "a, b", None), ("", "rank", "a, b", []), (None, "rank", "", [("user", "hi"), ("assistant", "yes")]), ("s", "rank", None, [("user", None), (None, "x"), ("", "y"), ("user", "")]),
        (None, None, None, None), ("s", None, "given", []), ("s", "two\nlines", " ", [("user", "långt " * 500)]),
    ]
    df = spark.createDataFrame(cases, f"system string, instruction string, given string, history {TURNS}")
    got = df.select("*", scalars.chat_messages(F.col("system"), F.col("instruction"), F.col("given"), F.col("history")).alias("m"), scalars.chat_messages(F.col("system"), F.col("instruction"), F.col("given")).alias("bare")).collect()
    for r in got:
        assert [tuple(x) for x in r.m] == plain(r.system, r.instruction, r.given, r.history)
        assert [tuple(x) for x in r.bare] == plain(r.system, r.instruction, r.given, None)


def test_a_permutation_holds_every_item_once(spark):
    df = spark.createDataFrame([(i, [f"v{j}" for j in range(12)]) for i in range(20)] + [(99, []), (98, ["a", "a"])], "id long, x array<string>")
    got = {r.id: r.y for r in df.select("id", _shuffled(F.col("x"), F.col("id")).alias("y")).collect()}
    assert all(sorted(got[i]) == sorted(f"v{j}" for j in range(12)) for i in range(20)) and len({tuple(got[i]) for i in range(20)}) > 15
    assert got[99] == [] and got[98] == ["a", "a"]


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 40 + [9.0], [float(x) for x in np.random.default_rng(1).normal(size=501).round(2)]])
def test_interpolated_percentiles(spark, values):
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    got = metrics.interpolated_percentiles(df, "x", qs, 5).first()
    np.testing.assert_allclose([got[k] for k in qs], [np.quantile(values, q) for q in qs.values()], rtol=1e-12)


def test_percentiles_of_nothing(spark):
    got = metrics.interpolated_percentiles(spark.createDataFrame([(None,)], "x double"), "x", {"a": 0.5}, 3).collect()
    assert [r.a for r in got] == [None]
    assert metrics.length_summary(spark.createDataFrame([], "x int"), "x", 3).first().n == 0


def test_templates(spark):
    df = spark.createDataFrame([("a", 1), (None, None)], "x string, n int")
    make = lambda t, **k: df.select(scalars.filled_template(t, {"x": F.col("x"), "n": F.col("n")}, **k).alias("t"))
    assert [r.t for r in make("{x}-{n} {{x}}").collect()] == ["a-1 {x}", "- {x}"]
    assert [r.t for r in make("").collect()] == ["", ""]
    with pytest.raises(ValueError, match="required.*y"):
        make("{x}", required=("x", "y"))
    with pytest.raises(ValueError, match="z"):
        make("{z}")


def test_masked_labels(spark):
    encode = lambda t: [ord(c) for c in t]
    assert supervised.masked(encode, "ab|cd", "|", 9) == ([97, 98, 124, 99, 100], [-100, -100, -100, 99, 100])
    assert supervised.masked(encode, "ab|cd|e", "|", 9)[1] == [-100] * 3 + [99, 100, 124, 101]
    assert supervised.masked(encode, "abcd", "|", 9) == ([97, 98, 99, 100],) * 2
    assert supervised.masked(encode, "word " * 900 + "|Yes", "|", 4) == ([124, 89, 101, 115], [-100, 89, 101, 115])
    assert supervised.masked(encode, "", "|", 4) == ([], []) and supervised.masked(encode, "a|b", "|", 0) == ([], [])
    df = spark.createDataFrame([(1, "a|b", "x"), (1, "a|b", "x"), (2, None, "x"), (3, "", "x")], "id long, t string, labels string")
    got = sorted((r.id, r.input_ids, r.attention_mask, r.labels) for r in supervised.encode_supervised(df, "id", "t", lambda: encode, "|", 5).collect())
    assert got == [(1, [97, 124, 98], [1, 1, 1], [-100, -100, 98])] * 2 + [(3, [], [], [])]
    assert supervised.encode_supervised(df.limit(0), "id", "t", lambda: encode, "|", 5).count() == 0


def test_stages_are_kept_and_cleared(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    key = sinks.content_key(spark.range(3), {"a": 1})
    for _ in range(2):
        assert sinks.cached_stage(spark, str(tmp_path), "s", key, build).count() == 5
    assert built == [1] and sinks.cached_keys(spark, str(tmp_path), "s") == [key]
    assert sinks.clear_stage(spark, str(tmp_path), "s", key) and sinks.cached_keys(spark, str(tmp_path), "s") == []
    assert sinks.cached_stage(spark, str(tmp_path), "s", key, build).count() == 5 and built == [1, 1]
    assert sinks.clear_stage(spark, str(tmp_path), "s") and sinks.cached_keys(spark, str(tmp_path), "s") == []
