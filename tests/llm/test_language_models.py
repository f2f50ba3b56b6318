import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import langid, pairs
from larder.llm import text as T

DATA = "/root/testdata/sf0.01"
needs = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit_on(docs.filter("doc_id % 4 <> 0"))


def test_labels():
    for label, want in (("en-US", "en"), ("SWE", "sv"), (" zh-Hans ", "zh"), ("und", None), ("", None), (None, None), ("no", "?"), ("id", "?"), ("Malay", "ms"), ("sv_SE", "sv")):
        assert T.label_code(label) == want


def test_sentences():
    assert T.sentences('One is "a. b". Two?\r\nThree\n\n- four words are here\n- five。六七。') == ['One is "" .', "Two?", "Three", "- four words are here", "- five。", "六七。"]
    assert T.sentences("") == []


def test_grams_are_counted_per_row():
    row, dim, n = T.grams([" ab ", "", " ab "])
    assert set(row) == {0, 2} and dim[row == 0].tolist() == dim[row == 2].tolist() and n.min() >= 1
    assert T.grams([])[0].size == 0


@needs
def test_held_out_accuracy(docs, model):
    """Documents outside the fit with a plain label: nearly all are read as labelled (some labels are wrong)."""
    rows = [r for r in docs.filter("doc_id % 4 = 0").collect() if T.label_code(r.lang) in T.LANGUAGES]
    right = seen = 0
    for r in rows:
        us = [T.letters_only(s) for s in T.sentences(r.text)]
        segs = langid.segments(model.cosines(us), np.array([T.substance(u)[0] for u in us])) if us else []
        if len({s[0] for s in segs}) == 1:
            seen += 1
            right += T.LANGUAGES[segs[0][0]] == T.label_code(r.lang)
    assert seen > 150 and right / seen > 0.9


@needs
def test_segments_of_mixed_text(spark, model):
    en = "The kitchen opens late on Sunday, so orders are moved to the next branch. Our cook recommends the soup with a slice of lime."
    sv = "Leveransen tog alldeles för lång tid och maten var ljummen när den kom. Jag brukar äta italienskt på fredagen, men köket hade stängt."
    zh = "这家分店属于一个大型连锁品牌，和隔壁的店共用厨房。"
    rows = [(1, "en", f"{en} {sv} {en}"), (2, "sv", sv), (3, "en", sv), (4, None, en), (5, "en", "12 34 56\n9 9 9"), (6, "en", None), (7, "en", ""), (8, "en-GB", en.upper()), (9, "en", f'{en} The box read "utan lök, tack", as always.'), (10, "en", f"{en}\n{zh}"), (11, "?", "x " * 5), (12, "en", (en + " ") * 400)]
    got = {}
    for r in langid.language_segments(spark.createDataFrame(rows, "doc_id long, lang string, text string"), model).orderBy("doc_id", "seg_no").collect():
        got.setdefault(r.doc_id, []).append((r.seg_no, r.lang, r.label_ok))
        assert 0 < r.confidence <= 1
    assert got[1] == [(0, "en", False), (1, "sv", False), (2, "en", False)]
    assert got[2] == [(0, "sv", True)] and got[3] == [(0, "sv", False)] and got[4] == [(0, "en", False)]
    assert got[8] == got[9] == got[12] == [(0, "en", True)] and got[10] == [(0, "en", False), (1, "zh", False)]
    assert not {5, 6, 7, 11} & set(got)


PROMPT = "You recommend food delivery. Name the three cuisines that this user will most likely order next.\n1. thai: 0.5\n2. hot pot: 0.4\nReturn three cuisines as JSON:\n{\"cuisines\": [\"cuisine_1\", \"cuisine_2\"], \"reasoning\": \"brief explanation\"}"
CASES = [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("{}", "empty"), ("null", "empty"), ('""', "empty"), ("N/A", "empty"), ("```json\n```", "empty"), ("<think></think>", "empty"), ("ERROR: provider timeout", "empty"),
    ('{"cuisines": [], "reasoning": ""}', "empty"), ("[]", "empty"), ('{"error": "rate limit"}', "empty"), ("(no response)", "empty"),
    ("I'm sorry, but I cannot help with that.", "refusal"), ('{"cuisines": [], "reasoning": "I won’t give a list, as it relates to personal data."}', "refusal"), ("<think>A person.</think>Making guesses about private orders goes against my policy.", "refusal"),
    (PROMPT, "copied"), (PROMPT.lower().replace("\n", " "), "copied"), ('{"cuisines": ["cuisine_1", "cuisine_2"], "reasoning": "brief explanation"}', "copied"), (PROMPT[:90], "copied"),
    ("Leveransen tog alldeles för lång tid och maten var ljummen när den kom.", "other_language"), ('{"cuisines": ["thai", "hot pot"], "reasoning": "这家分店属于一个大型连锁品牌，和隔壁的店共用厨房。"}', "other_language"),
    ('{"cuisines": ["thai", "hot', "truncated"), ("```json\n{\"cuisines\": [\"thai\"]", "truncated"), ("<think>recent orders favour thai, and then", "truncated"), ("1. thai\n2. hot pot\n3. mexi", "truncated"),
    ('{"cuisines": ["thai", "hot pot", "mexican"], "reasoning": "recent orders favour thai"}', None), ("I can't be fully certain, but here is my best guess. {\"cuisines\": [\"thai\"], \"reasoning\": \"similar users agree with thai\"}", None),
    ("1. thai\n2. hot pot\n3. mexican\n\nSimilar users agree with thai.", None), ("1. thai\n2. hot pot\n3. mexican", None), ('You gave "- x||thai [sim=0.5]". {"cuisines": ["thai"], "reasoning": "the order note (\\"utan lök, tack\\") repeats with thai"}', None),
]


@needs
def test_pair_defects(spark, docs):
    sound = [(100 + i, 1, PROMPT, f'{{"cuisines": ["{a}", "{b}"], "reasoning": "recent orders favour {a}"}}', "") for i, (a, b) in enumerate([("thai", "mexican"), ("hot pot", "thai"), ("mexican", "hot pot")] * 10)]
    sound += [(200 + i, 1, PROMPT, "1. thai\n2. hot pot\n3. mexican\n\nSimilar users agree with thai.", "") for i in range(5)]
    rows = [(i, 1, PROMPT, r, "x") for i, (r, _) in enumerate(CASES)] + [(50, 2, None, "1. thai\n2. mexican", "x"), (0, 1, PROMPT, None, "x")] + sound
    df = spark.createDataFrame(rows, "result_id long, round_no int, prompt string, response string, defect string").repartition(3)
    got = pairs.pair_defects(df, pairs.fit_bayes_on(docs), pairs.count_ends(df)).collect()
    by = {r.result_id: r.defect for r in got}
    assert {i: by.get(i) for i in range(len(CASES))} == {i: w for i, (_, w) in enumerate(CASES)}
    assert sum(r.result_id == 0 for r in got) == 2 and not [i for i in by if i >= 50]
    assert pairs.pair_defects(df.limit(0), pairs.fit_bayes_on(docs), pairs.count_ends(df.limit(0))).count() == 0


@needs
def test_bayes_held_out(docs):
    bayes = pairs.fit_bayes_on(docs.filter("doc_id % 4 <> 0"))
    right = seen = 0
    for code, own in T.labelled_documents(docs.filter("doc_id % 4 = 0")):
        for k in bayes.mean_logs(own).argmax(axis=1) if own else []:
            seen += 1
            right += T.LANGUAGES[k] == code
    # About a tenth of these sentences stand in mixed documents or under a wrong label.
    assert seen > 500 and right / seen > 0.85


def test_end_contexts_agree():
    for t in ("", "a", "abc", "a long enough text"):
        assert set(pairs._end_keys(t)) <= set(pairs._all_keys(t).tolist())


def test_a_quoted_phrase_of_any_length_is_part_of_its_sentence():
    for n in (2, 8, 60):
        phrase = " ".join(["die suppe war kalt und das brot hart"] * n)
        assert len(T.sentences(f'The guest wrote "{phrase}" and left. We paid.')) == 2
    assert len(T.sentences('"All of it is quoted. Two sentences." More here.')) == 3
    assert T.sentences(f'See <a href="{"x" * 300}">this page</a> now.') == ["See this page now."]


def test_many_documents_at_once_equal_one_by_one():
    rnd = np.random.default_rng(3)
    size = rnd.integers(0, 7, 400)
    cos = rnd.random((size.sum(), len(T.LANGUAGES))).astype(np.float32) * rnd.choice([0.05, 0.3], (size.sum(), 1))
    cos[rnd.random(size.sum()) < 0.5, 2] += 0.5
    words, cuts = rnd.integers(0, 9, size.sum()), np.r_[0, np.cumsum(size)]
    got = langid.all_segments(cos, words, cuts)
    for i in range(400):
        want = langid.segments(cos[cuts[i] : cuts[i + 1]], words[cuts[i] : cuts[i + 1]]) if size[i] else []
        assert [(a, c) for a, _, c in got[i]] == [(a, c) for a, _, c in want]
        np.testing.assert_allclose([b for _, b, _ in got[i]], [b for _, b, _ in want], rtol=1e-5)


GERMAN = "Bitte nennen Sie drei Küchen, die dieser Gast wahrscheinlich als Nächstes bestellt, und begründen Sie Ihre Wahl kurz."
REASON = "Der Gast hat zuletzt immer thailändisch bestellt und war mit dem Essen sehr zufrieden."


@needs
@pytest.mark.parametrize("remembered", [20_000, 1])
def test_the_prompts_language_does_not_depend_on_what_is_remembered(docs, remembered, monkeypatch):
    monkeypatch.setattr(pairs, "REMEMBERED", remembered)
    bayes = pairs.fit_bayes_on(docs)
    home, ends = pairs.Home(bayes), pairs.Ends(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    # Boilerplate in another language first, the question itself last.
    prompts = [f"You recommend food delivery to the guests of a house.\n{GERMAN}\n{GERMAN}\n{GERMAN} {i}" for i in range(30)] + [PROMPT]
    said = [f'{{"cuisines": ["thai"], "reasoning": "{REASON}"}}'] * 31
    for _ in range(2):
        got = [d for d, _ in pairs.judge(prompts, said, bayes, ends, home)]
        assert got == [None] * 30 + ["other_language"]
    assert len(home.lines) <= max(remembered, 40)


@needs
def test_foreign_sentences_in_lists_and_nested_objects(docs):
    bayes = pairs.fit_bayes_on(docs)
    ends = pairs.Ends(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    said = [f'{{"cuisines": ["thai"], "notes": [{{"why": "{REASON}"}}]}}', f"1. thai\n2. {REASON}", f'{{"cuisines": ["thai"], "reasoning": "a1b2||thai: {REASON}"}}', '{"cuisines": ["thai"], "notes": [{"why": "similar users agree with thai"}]}']
    assert [d for d, _ in pairs.judge([PROMPT] * 4, said, bayes, ends, pairs.Home(bayes))] == ["other_language"] * 3 + [None]


@needs
def test_recall_of_made_defects(spark, docs):
    """Sound answers broken off at random places, replaced by refusals of unseen wording, or given another language."""
    rnd = np.random.default_rng(9)
    rows = spark.read.parquet(f"{DATA}/stage9_repeat_detailed.parquet").select("result_id", F.lit(1).alias("round_no"), F.col("round1_prompt").alias("prompt"), F.col("round1_raw_response").alias("response"))
    bayes = pairs.fit_bayes_on(docs)
    all_rows, home = rows.collect(), pairs.Home(bayes)
    found = pairs.judge([r.prompt for r in all_rows], [r.response for r in all_rows], bayes, pairs.count_ends(rows), home)
    sound = [r for r, (d, _) in zip(all_rows, found) if d is None]
    refusals = ["I cannot rank places for a person I do not know.", "My policy does not allow predictions on private orders.", "I won't provide a list, as this concerns personal data."]
    made = {
        "truncated": lambda i, r: r.response[: int(rnd.choice([m.start() + 1 for m in re.finditer(r"[a-z](?=[a-z])", r.response) if m.start() > 15]))],  # inside a word
        "refusal": lambda i, r: refusals[i % 3],
        "other_language": lambda i, r: f"{REASON}\n{r.response}",
        "empty": lambda i, r: ("", "null", "N/A", "[]", '{"cuisines": []}')[i % 5],
        "copied": lambda i, r: r.prompt[: int(rnd.integers(60, len(r.prompt)))].strip(),
    }
    for defect, make in made.items():
        some = [(i, 1, r.prompt, make(i, r) if i % 10 == 0 else r.response) for i, r in enumerate(sound * 4)]
        ends = pairs.count_ends(spark.createDataFrame(some, "result_id long, round_no int, prompt string, response string"))
        got = pairs.judge([r[2] for r in some], [r[3] for r in some], bayes, ends, home)
        hit = [d == defect for (i, *_), (d, _) in zip(some, got) if i % 10 == 0]
        other = [d for (i, *_), (d, _) in zip(some, got) if i % 10 and d]
        assert sum(hit) >= 0.9 * len(hit) and len(other) <= 0.01 * len(some), (defect, sum(hit), len(hit), len(other))


def test_letters_by_arrays_equal_letters_by_pattern():
    rnd = np.random.default_rng(2)
    signs = list("abcÅäß  ..,-_'12½不葱éİ\u0301\x00ø😀ـм")
    texts = ["".join(rnd.choice(signs, rnd.integers(0, 12))) for _ in range(500)] + ["", " ", "x", "不 要", "A1b"]
    code, size, words = T.letter_codes(texts)
    cuts = np.r_[0, np.cumsum(size)]
    got = ["".join(map(chr, code[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
    assert got == [T.letters_only(t) for t in texts]
    assert words.tolist() == [T.substance(T.letters_only(t))[0] for t in texts]
    assert [x.tolist() for x in T.code_grams(code, size)] == [x.tolist() for x in T.grams(got)]
    assert [x.tolist() for x in T.letter_codes([])] == [[], [], []]
