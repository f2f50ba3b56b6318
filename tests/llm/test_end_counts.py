from larder.llm import pairs


def test_contexts_do_not_share_counts(spark):
    """Many distinct contexts leave the counts of a sound end as they are."""
    rows = [(f"Note: similar users also buy burgers number {i % 3}.",) for i in range(9)] + [("".join(chr(0x4E00 + (i * 7919 + j * j * 104729) % 20000) for j in range(60)),) for i in range(9000)]
    ends = pairs.count_ends(spark.createDataFrame(rows, "response string"))
    sound = pairs._classed(rows[0][0])
    at = {int(k): (int(e), int(t)) for k, e, t in zip(ends.keys, ends.ends, ends.total)}
    assert [at[k] for k in pairs._end_keys(sound)] == [(9, 9)] * pairs.CONTEXT
    assert ends.likelihood(rows[0][0]) > 0.9


def test_hashes_of_positions_and_ends_agree():
    for text in ("a", "short", "a longer text with 12 numbers."):
        assert set(pairs._end_keys(text)) <= set(pairs._all_keys(text).tolist())
        assert len(set(pairs._all_keys(text).tolist())) == len({("\x02" + text)[i : i + n] for n in range(1, 9) for i in range(len(text) + 2 - n)})
