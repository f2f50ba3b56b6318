import random

from larder.llm import leaks

RND = random.Random(11)
OPENING = "read the case below and answer with one vendor only giving no explanation and using nothing but the facts stated".split()


def text(n):
    return [f"w{RND.randrange(900)}x" for _ in range(n)]


def test_equal_and_near_equal_items_keep_their_leaks():
    case = text(60)
    near = [*case[:40], "changed", *case[41:]]
    ix = leaks.Items([(i, " ".join(OPENING + w)) for i, w in enumerate([case, case, case, near, text(60), text(60)])])
    assert set(ix.opened) == {len(OPENING)}
    assert sorted(k for k, _ in leaks.leaks_of(ix, " ".join(text(20) + case[5:35] + text(20)))) == [0, 1, 2, 3]
    assert leaks.Items([(i, " ".join(case)) for i in range(4)]).opened == [0] * 4


def test_stretches_that_straddle_the_opening():
    items = [OPENING + text(60) for _ in range(5)]
    ix = leaks.Items([(i, " ".join(w)) for i, w in enumerate(items)])
    n = len(OPENING)
    for at, wrong in ((n - 10, (5, 11)), (n - 12, (5, 10)), (n - 14, (6,))):
        length = 16 if len(wrong) == 2 else 15
        w = items[2][at : at + length]
        for x in wrong:
            w[x] = "other"
        assert [k for k, _ in leaks.leaks_of(ix, " ".join(text(30) + w + text(30)))] == [2], at
    for doc in (OPENING, OPENING[3:], [*OPENING[:8], "other", *OPENING[9:]]):
        assert leaks.leaks_of(ix, " ".join(text(30) + doc + text(30))) == []


def test_openings_are_found_over_all_passes(spark, monkeypatch):
    rows = [(i, " ".join(OPENING + text(40))) for i in range(6)]
    docs = spark.createDataFrame([(1, " ".join(OPENING + text(30))), (2, rows[4][1])], "doc_id long, text string")
    monkeypatch.setattr(leaks, "MAX_ITEMS", 2)
    got = leaks.leaked_items(docs, spark.createDataFrame(rows, "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in got.collect()] == [(2, 4)]


def test_a_passage_of_three_items_is_found_for_each():
    passage = text(30)
    ix = leaks.Items([(i, " ".join([*text(20), *passage, *text(20)])) for i in range(3)])
    assert sorted(k for k, _ in leaks.leaks_of(ix, " ".join(text(20) + passage + text(20)))) == [0, 1, 2]


def test_an_opening_before_another_case_of_the_same_mould_is_no_leak():
    mould = lambda: f"under rule {RND.randrange(999)} a frosted tenant from {RND.randrange(999)}q may decline {RND.randrange(999)} suppers until inspector {RND.randrange(999)}r objects".split()
    items = [OPENING + mould() + text(40) for _ in range(8)]
    ix = leaks.Items([(i, " ".join(w)) for i, w in enumerate(items)])
    assert leaks.leaks_of(ix, " ".join(text(10) + OPENING + mould() + text(20))) == []
    assert [k for k, _ in leaks.leaks_of(ix, " ".join(text(10) + items[4][len(OPENING) - 10 : len(OPENING) + 12] + text(20)))] == [4]


def test_markup_of_any_length_is_no_word():
    assert leaks.words(f'one <a href="{"x" * 500} y">two</a> three < four') == ["one", "two", "three", "four"]
    assert [x.tolist() for x in map(lambda t: leaks.words_of([t]).cuts, ("", "\x00", "a b"))] == [[0, 0], [0, 0], [0, 2]]


def test_same_rows_for_any_number_of_passes(spark, monkeypatch):
    shared, rows = text(30), []
    for i in range(9):
        rows.append((i, " ".join(OPENING + text(20) + (shared if i % 2 else text(30)))))
    docs = spark.createDataFrame([(1, " ".join(shared)), (2, " ".join(OPENING)), (3, rows[2][1])], "doc_id long, text string")
    ids = spark.createDataFrame(rows, "item_id long, text string")
    got = []
    for most in (50_000, 4, 2):
        monkeypatch.setattr(leaks, "MAX_ITEMS", most)
        got.append(sorted(tuple(r) for r in leaks.leaked_items(docs, ids).collect()))
    assert got[0] == got[1] == got[2] and {r[:2] for r in got[0]} == {(1, 1), (1, 3), (1, 5), (1, 7), (3, 2)}
