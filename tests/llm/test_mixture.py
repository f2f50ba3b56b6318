import math
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larder.llm import mixture

SIZED = "doc_id long, source string, weight double, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, rows, targets, total=None):
    s = spark.createDataFrame(rows, SIZED).repartition(3)
    t = spark.createDataFrame(targets, TARGETS)
    return s, t, mixture.mix(s, t, total).collect()


def brute(rows, targets, total, spark):
    """Sort every source by its keys and add up."""
    keys = {r.doc_id: r.u for r in spark.createDataFrame([(x,) for x in {r[0] for r in rows}], "doc_id long").select("doc_id", ((F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2**52)) + 0.5) / float(2**52)).alias("u")).collect()}
    total = total if total is not None else sum(r[3] for r in rows)
    out = {}
    for s, share, most in targets:
        own = [r for r in rows if r[1] == s and r[3] > 0]
        have = sum(r[3] for r in own)
        if not have:
            continue
        budget = min(math.floor(share * total), most * have)
        epochs, rest = divmod(budget, have)
        got = 0
        for r in sorted(own, key=lambda r: (-math.log(keys[r[0]]) / max(r[2] or 1e-6, 1e-6), r[0])):
            got += r[3]
            c = epochs + (got <= rest)
            if c:
                out[r[0]] = c
    return out


def test_same_as_brute_force(spark):
    rows = [(i, "big" if i % 3 else "small", 0.2 + (i % 5) / 5, 5 + i % 17) for i in range(600)] + [(1000 + i, "tiny", None if i else -1.0, 9) for i in range(4)] + [(2000, "none", 1.0, 50), (2001, "big", 1.0, 0)]
    targets = [("big", 0.5, 1), ("small", 0.35, 3), ("tiny", 0.1, 4), ("absent", 0.05, 4)]
    for total in (None, 3000, 40_000):
        _, _, got = mixed(spark, rows, targets, total)
        assert {r.doc_id: r.copies for r in got} == brute(rows, targets, total, spark)
        assert all(r.copies <= dict((s, m) for s, _, m in targets)[r.source] for r in got)


def test_shares_and_epochs(spark):
    rows = [(i, "a", 1.0, 10) for i in range(500)] + [(1000 + i, "b", 1.0, 10) for i in range(40)]
    s, t, got = mixed(spark, rows, [("a", 0.8, 1), ("b", 0.2, 2), ("c", 0.0, 1)], 4000)
    r = {x.source: x for x in mixture.shares(s, t, 4000).collect()}
    assert (r["a"].mixed_tokens, r["b"].mixed_tokens, r["b"].epochs, r["b"].most_copies) == (3200, 800, 2, 2)
    assert (r["a"].actual_share, r["c"].docs_used) == (0.8, 0)
    per = defaultdict(set)
    for x in got:
        per[x.source].add(x.copies)
    assert per == {"a": {1}, "b": {2}}


def test_weights_matter(spark):
    rows = [(i, "a", 5.0 if i % 2 else 0.5, 10) for i in range(2000)]
    _, _, got = mixed(spark, rows, [("a", 1.0, 1)], 6000)
    heavy = sum(r.doc_id % 2 for r in got)
    assert heavy > 0.75 * len(got)


def test_nothing(spark):
    s, t, got = mixed(spark, [], [("a", 1.0, 1)])
    assert got == [] and mixture.shares(s, t).first().mixed_tokens == 0


VOCABULARY = "/opt/tokenizers/byte_bpe_50k"


def test_no_vocabulary(spark):
    with pytest.raises(FileNotFoundError, match="vocabulary"):
        mixture.prepared(spark.createDataFrame([], "doc_id long, source string, text string"), "/nowhere/ranks")


def test_letter_shares():
    assert mixture.letter_shares(["ab 1!", "", "  ", "123", "åß不"]).tolist() == [0.5, 0.1, 0.1, 0.1, 1.0]
    assert mixture.letter_shares([]).tolist() == []


@pytest.mark.skipif(not Path(f"{VOCABULARY}.json").exists(), reason="no tokenizer")
def test_tokens(spark):
    from tokenizers import Tokenizer

    texts = ["Hello there", "", None, "不要葱 <|endoftext|>", "x " * 50_000]
    d = spark.createDataFrame([(i, "s", t, i) for i, t in enumerate(texts)] + [(9, None, "t", 1)], "doc_id long, source string, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in mixture.prepared(d, f"{VOCABULARY}.tiktoken").collect()}
    tok = Tokenizer.from_file(f"{VOCABULARY}.json")  # another library's counts with the same vocabulary
    tok.encode_special_tokens = True
    assert got == {i: len(tok.encode(t, add_special_tokens=False)) for i, t in enumerate(texts) if t is not None}
