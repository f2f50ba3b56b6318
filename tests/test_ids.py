import random

from pyspark.sql import functions as F

from larder.functions import ids


def test_clean_ids(spark):
    rows = [(" U1\t", "u1"), ("GUEST", "guest"), ("  ", None), ("N/A", None), (None, None), ("-", None), ("Unknown ", None), ("a b", "a b")]
    got = spark.createDataFrame(rows, "x string, want string").select(ids.clean_id(F.col("x")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_days_and_times(spark):
    rows = [("12 days", "01:02:03", 12, 3723), (" 3 days 00:00:00", "1:0:0", 3, 3600), ("none", "x", None, None), (None, None, None, None), ("99999999999999 days", "1:2", None, None)]
    for r in spark.createDataFrame(rows, "d string, t string, day int, sec int").select(ids.day_number(F.col("d")).alias("a"), "day", ids.seconds_of_day(F.col("t")).alias("b"), "sec").collect():
        assert (r.a, r.b) == (r.day, r.sec)


WRITINGS = [("poke bowls", "poke bowls"), (" Poke-Bowls.", "poke bowls"), ("Pok Ebowls", "poke bowls"), ("pkoe bowls", "poke bowls"), ("poke_bowl", "poke bowls"), ("tai", "thai"), ("Tahi", "thai"), ("THHAI", "thai"), ("fusion food", "fusion food"), ("  ", None), ("n/a", None), (None, None)]


def test_canonical_names(spark):
    df = spark.createDataFrame(WRITINGS, "x string, want string")
    vocab = spark.createDataFrame([("thai",), ("poke bowls",), ("thai",), (None,), ("burgers",)], "v string")
    for r in ids.with_canonical(df, "x", "got", vocab, "v").collect():
        assert r.got == r.want, r


def test_canonical_names_by_join(spark, monkeypatch):
    monkeypatch.setattr(ids, "VOCABULARY_BOUND", 2)
    df = spark.createDataFrame(WRITINGS, "x string, want string")
    vocab = spark.createDataFrame([("thai",), ("poke bowls",), ("burgers",)], "v string")
    assert ids.vocabulary(vocab, "v") is None
    for r in ids.with_canonical(df, "x", "got", vocab, "v").collect():
        assert r.got == r.want, r


def test_empty_vocabulary(spark):
    df = spark.createDataFrame([("A  b",)], "x string")
    assert ids.with_canonical(df, "x", "got", spark.createDataFrame([], "v string"), "v").first().got == "a b"


def test_both_ways_of_matching_agree(spark, monkeypatch):
    """Random words over few letters, many of them near several names; swaps of letters that are no neighbours are none."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcd ") for _ in range(n))
    names = [(word(rnd.randint(1, 6)),) for _ in range(40)] + [("abcd",), ("thai food",), ("thaifoo",), ("thaif ood",)]
    writings = [(w,) for w in {word(rnd.randint(0, 7)) for _ in range(400)} | {"bcda", "thai fod", "THAIFOOD", "adcb"}]
    df, vocab = spark.createDataFrame(writings, "x string"), spark.createDataFrame(names, "v string")
    got = {r.x: r.got for r in ids.with_canonical(df, "x", "got", vocab, "v").collect()}
    monkeypatch.setattr(ids, "VOCABULARY_BOUND", 2)
    assert {r.x: r.got for r in ids.with_canonical(df, "x", "got", vocab, "v").collect()} == got
    monkeypatch.setattr(ids, "BROADCAST_WRITINGS", 0)
    assert {r.x: r.got for r in ids.with_canonical(df, "x", "got", vocab, "v").collect()} == got
    few = spark.createDataFrame([("abcd",), ("thai food",), ("thaifoo",)], "v string")
    some = spark.createDataFrame([("bcda",), ("thai fod",)], "x string")
    assert {r.x: r.got for r in ids.with_canonical(some, "x", "got", few, "v").collect()} == {"bcda": "bcda", "thai fod": "thai food"}
