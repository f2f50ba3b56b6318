import random

import numpy as np
import pytest

from larder.llm import leaks

RND = random.Random(5)
VOCAB = [f"w{i}x" for i in range(400)]


def text(n):
    return [RND.choice(VOCAB) for _ in range(n)]


def words_of_item(ix, k):
    return leaks.words(ix.texts[k])


def distance(p, t):
    """Least edit distance of p to any stretch of t, by the plain table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    for _ in range(60):
        item = leaks.Items([(1, " ".join(RND.choice("abcde") + "q" for _ in range(30)))])
        n = RND.choice([15, 16, 24])
        region = [RND.choice("abcde") + "q" for _ in range(RND.randint(0, 40))]
        lanes = np.arange(30 - n + 1)
        got = leaks.least_distance(item.masks(0, n), n, leaks.words_of([" ".join(region)]).hashes.tolist(), lanes)
        assert got.tolist() == [min(n, distance(words_of_item(item, 0)[s : s + n], region)) for s in lanes]


def edited(words, errors):
    w = list(words)
    for _ in range(errors):
        i = RND.randrange(1, len(w) - 1)
        k = RND.randrange(3)
        w[i : i + 1] = [["new"], [w[i], "more"], []][k]
    return w


def test_found_and_not_found():
    items = [(i, " ".join(text(70))) for i in range(20)]
    ix = leaks.Items(items)
    for _ in range(150):
        k = RND.randrange(20)
        n = RND.randint(15, 60)
        at = RND.randrange(70 - n + 1)
        stretch = edited(words_of_item(ix, k)[at : at + n], RND.randint(0, n // 8))
        doc = " ".join(text(30) + stretch + text(30))
        assert k in [j for j, _ in leaks.leaks_of(ix, doc)]
    for _ in range(80):
        k = RND.randrange(20)
        n = RND.randint(5, 9)
        at = RND.randrange(70 - n + 1)
        assert leaks.leaks_of(ix, " ".join(text(30) + words_of_item(ix, k)[at : at + n] + text(30))) == []


def brute(ix, doc):
    """Every window of every item against the whole text."""
    w = leaks.words(doc)
    return {k for k, p in enumerate(words_of_item(ix, k) for k in range(len(ix.ids))) if any(distance(p[s : s + n], w) <= e for n, e in leaks.budgets(len(p)) for s in range(len(p) - n + 1))}


def test_same_as_brute_force():
    ix = leaks.Items([(i, " ".join(text(34))) for i in range(3)])
    for _ in range(25):
        k, n = RND.randrange(3), RND.randint(8, 30)
        at = RND.randrange(34 - n + 1)
        doc = " ".join(text(6) + edited(words_of_item(ix, k)[at : at + n], RND.randint(0, 4)) + text(6))
        assert {j for j, _ in leaks.leaks_of(ix, doc)} == brute(ix, doc)


def test_layout_markup_and_accents():
    item = "Hushållet Wemlo köpte 949 brickor Sulbor eftersom depån Drutas gömde sina 211 sneda säckar medan Tilodru-969 väntade länge på inspector svar"
    ix = leaks.Items([(1, item)])
    for doc in (item.upper(), item.replace(" ", "\n> "), item.replace("å", "a").replace("ö", "o").replace("ä", "a"), item.replace("brickor", "<b>brick­or</b>"), item.replace("inspector", "insp-\nector"), item.replace("Tilodru-969", "Tilodru969"), "|" + item.replace(" ", " | "), item.replace(" ", "&nbsp;"), "**" + item + "**"):
        assert [k for k, _ in leaks.leaks_of(ix, "before " + doc + " after")] == [0], doc


def test_shared_opening_is_no_leak(spark):
    opening = "read the case below and answer with one vendor only giving no explanation and using nothing but the facts stated"
    rows = [(i, opening + " " + " ".join(text(40))) for i in range(5)]
    docs = [(1, opening + " and then something else", "x"), (2, rows[3][1], "x"), (2, rows[3][1], "x"), (3, None, "x"), (4, "", "x"), (5, "word " * 20_000 + " ".join(rows[1][1].split()[25:50]), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = leaks.leaked_items(d, spark.createDataFrame([*rows, (9, None), (10, "short one")], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(2, 3), (2, 3), (5, 1)]
    assert leaks.leaked_items(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leaks.leaked_items(d.limit(0), spark.createDataFrame(rows, "item_id long, text string")).count() == 0


def test_several_passes(spark, monkeypatch):
    rows = [(i, " ".join(text(30))) for i in range(7)]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    monkeypatch.setattr(leaks, "MAX_ITEMS", 2)
    got = leaks.leaked_items(docs, spark.createDataFrame(rows, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(7)]


@pytest.mark.parametrize("n", range(15, 64))
def test_piece_bound(n):
    e = n // leaks.WORDS_PER_ERROR
    assert -(-(n - e) // (e + 1)) >= leaks.PIECE
