"""Broken prompt-response pairs and their type of defect.

Languages of prompt and response are compared by the posteriors of a naive Bayes
model over character n-grams; breaking off is found by the likelihood of a text
ending after its last characters and of parts being left open, a model counted
over all responses; declining is found by a naive Bayes model over
words, which all responses label themselves: what is said in place of an answer
against what is said beside one. All are read together
with the structure of the answer (JSON, list or prose).
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import DIMS, LANGUAGES, chunked_grams, grams, labelled_documents, letters_only, plain, row_sums, sentences, substance

SCHEMA = "result_id long, round_no int, defect string, score double"
_ARROW = pa.schema([("result_id", pa.int64()), ("round_no", pa.int32()), ("defect", pa.string()), ("score", pa.float64())])

# What stands for "no answer" once brackets, quotes and blanks are gone.
PLACEHOLDERS = frozenset("null none nil na n/a nan empty undefined tbd todo - -- . .. ... … ? unknown".split() + ["no response", "no answer", "no output", "empty response", "not available", "no content", "no data"])
_PROVIDER = re.compile(r"^\W*(?:api |provider |internal |server |http |llm )*(?:error|exception|timeout|timed out|traceback)\b\s*(?:\d+\s*)?(?:[:\-(]|$)", re.I)
_FENCE = re.compile(r"```[a-zA-Z]*")
_THINK = re.compile(r"<think>(.*?)</think>", re.S | re.I)
_ITEM = re.compile(r"^\s*(?:\d{1,3}[.)]|[-*•])\s+(.*)$")
_KEY = re.compile(r"\w+\|\|")

#: Least words of a sentence whose language counts, and least log-odds per n-gram against the prompt's language.
LEAST_WORDS, LEAST_ODDS = 4, 0.55
#: Lines of prompts whose languages a task remembers from one step to the next.
REMEMBERED = 20_000
#: Slots of hashed words and word pairs in the model of refusals (one byte-sized count table of fixed size).
WORD_SLOTS = 1 << 16
#: Ends of texts: length of the contexts, least likelihood of a sound end.
CONTEXT, LEAST_END = 8, 0.05
#: Kinds of parts with what opens them; one left open is a sound end only where most responses that open it leave it so.
PARTS = ("thought", "fence", "bracket")
_OPENS = {"thought": "<think>", "fence": "```", "bracket": "{"}
LEAST_OPEN = 0.5
#: Distinct contexts that a task holds before it passes their counts on.
HELD = 1 << 21
_STEP = 0x9E3779B97F4A7C15
#: Times a context must have been seen to count.
LEAST_SEEN = 3


@dataclass
class NaiveBayes:
    """Log-likelihoods of hashed character n-grams per language."""

    table: np.ndarray  # DIMS x languages
    known: np.ndarray

    def logs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, and its n-grams."""
        row, dim, count = grams(texts)
        total = row_sums(row, count, len(texts))
        logs = row_sums(row, self.table[dim] * count[:, None].astype(np.float32), len(texts))
        return np.where(self.known, logs, -np.inf), total

    def mean_logs(self, texts: list[str]) -> np.ndarray:
        logs, total = self.logs(texts)
        return logs / np.maximum(total, 1)[:, None]


def fit_bayes(labelled: list[tuple[str, list[str]]], smoothing: float = 0.5) -> NaiveBayes:
    """A model from the sentences of labelled documents; those nearer to another language after a first fit are left out of the second."""
    texts = [x for _, own in labelled for t in own for x in (t, plain(t))]
    lang = np.array([LANGUAGES.index(c) for c, own in labelled for _ in range(2 * len(own))])
    if not texts:
        return NaiveBayes(np.zeros((DIMS, len(LANGUAGES)), np.float32), np.arange(len(LANGUAGES)) == 0)
    row, dim, count = chunked_grams(texts)
    keep = np.ones(len(texts), bool)
    for last in (False, True):
        ok = keep[row]
        m = np.bincount(dim[ok].astype(np.int64) * len(LANGUAGES) + lang[row[ok]], count[ok], DIMS * len(LANGUAGES)).reshape(DIMS, -1)
        table = np.log((m + smoothing) / (m.sum(axis=0) + smoothing * DIMS)).astype(np.float32)
        known = np.bincount(lang[keep], minlength=len(LANGUAGES)) > 0
        if not last:
            logs = np.stack([row_sums(row, table[dim, k] * count, len(texts)) for k in range(len(LANGUAGES))], axis=1)
            keep = np.where(known, logs, -np.inf).argmax(axis=1) == lang
    return NaiveBayes(table, known)


def _classed(text: str) -> str:
    """Words with a digit (ids, numbers, times) as nines, so that contexts don't depend on their values."""
    return re.sub(r"\w*\d\w*", lambda m: "9" * len(m[0]), text)


def _end_keys(text: str) -> list[int]:
    """Hashes of the contexts of length 1..CONTEXT before the end of a text (a start mark counts as a character)."""
    return _contexts(f"\x02{text[-CONTEXT:]}" if len(text) < CONTEXT else text[-CONTEXT:])


def _contexts(tail: str) -> list[int]:
    """Hashes of 64 bits, as signed numbers."""
    h, out = 0, []
    for n, ch in enumerate(reversed(tail), 1):
        h = ((h ^ ord(ch)) * _STEP + n) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


def _all_keys(text: str) -> np.ndarray:
    """The same hashes for the contexts before every position of a text, by arrays."""
    code = np.frombuffer(f"\x02{text}".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, CONTEXT + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            # h[i] covers the n characters that end at position i + n - 1.
            h = ((h[1:] if n > 1 else h) ^ code[:m]) * np.uint64(_STEP) + np.uint64(n)
            h ^= h >> np.uint64(29)
            out.append(h.view(np.int64))
    return np.concatenate(out)


def _word_slots(text: str) -> np.ndarray:
    """Hashed words and pairs of neighbouring words of a text."""
    w = ["", *letters_only(text.replace("’", "'").replace("'", "")).split(), ""]
    return np.array([zlib.crc32(x.encode()) % (WORD_SLOTS - 1) for x in {*w[1:-1], *map(" ".join, zip(w, w[1:]))}], np.int64)


_NO_WORD = WORD_SLOTS - 1


@dataclass
class Ends:
    """Counts of contexts anywhere and before an end, by the sorted 64-bit hashes of the contexts; log-odds of words
    said in place of an answer against those beside one."""

    keys: np.ndarray
    ends: np.ndarray
    total: np.ndarray
    declining: np.ndarray | None = None
    left_open: dict[str, tuple[int, int]] = field(default_factory=dict)  # of each kind of part: responses that leave it open, that open it

    def likelihood(self, text: str) -> float:
        """Likelihood that a text ends after its last characters: of the longest context seen often enough."""
        best = 1.0
        own = np.array(_end_keys(_classed(text)), np.int64)
        for k, at in zip(own, np.searchsorted(self.keys, own)):
            if at == len(self.keys) or self.keys[at] != k or self.total[at] < LEAST_SEEN:
                break
            best = (self.ends[at] + 0.05) / (self.total[at] + 0.1)
        return float(best)

    def likelihood_open(self, part: str) -> float:
        """Likelihood that a response that opens such a part ends before it is closed."""
        left, opened = self.left_open.get(part, (0, 0))
        return (left + 0.05) / (opened + 0.1) if opened >= LEAST_SEEN else 0.0

    def declines(self, text: str) -> float:
        """Mean log-odds of the words of a text that it stands in place of an answer; 0 without any word."""
        slots = _word_slots(text)
        return float(self.declining[slots].mean()) if self.declining is not None and len(slots) else 0.0


@dataclass
class Answer:
    """Structure of a response."""

    prose: list[str]  # texts outside and inside the answer whose language counts
    items: list[str]
    leaves: list[str]
    broken: str  # the kind of an opened part that is not closed: thought, fence or bracket, else empty
    last: str  # what the text ends with, as read for its end
    structured: bool


def _object_end(text: str, at: int) -> int:
    """Position after the bracket that closes the one at ``at``, or -1."""
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        ch = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if depth == 0:
                return i + 1
    return -1


def _leaves(x: object) -> list[str]:
    if isinstance(x, dict):
        return [t for v in x.values() for t in _leaves(v)]
    if isinstance(x, list):
        return [t for v in x for t in _leaves(v)]
    return [] if x is None else [str(x)]


def read_answer(response: str) -> Answer:
    """Take a response apart into prose, listed items and the text it ends with."""
    text = response.strip()
    thoughts = _THINK.findall(text)
    text = _THINK.sub(" ", text)
    opened = re.search(r"<think>", text, re.I)
    if opened:
        return Answer([text[opened.end() :]], [], [], "thought", text, False)
    broken = "fence" if text.count("```") % 2 == 1 else ""
    text = _FENCE.sub(" ", text).strip()
    if text[:1] == '"' and text[-1:] == '"' and len(text) > 1:
        try:
            inner = json.loads(text)
            if isinstance(inner, str):
                return read_answer(inner)
        except ValueError:
            pass
    for m in re.finditer(r"[{\[]", text):
        at, end, parsed = m.start(), _object_end(text, m.start()), None
        if end > 0:
            try:
                parsed = json.loads(text[at:end])
            except ValueError:
                pass
        elif text[at] == "{" or at == 0:
            return Answer([*thoughts, text[:at]], [], [], "bracket", text, True)
        if parsed is None and (end < 0 or text[at] == "["):
            continue  # a bracket in prose
        rest = text[end:].strip()
        leaves = _leaves(parsed) if parsed is not None else re.findall(r'"((?:[^"\\]|\\.)*)"\s*[,}\]]', text[at:end])
        lists = [v for v in (parsed.values() if isinstance(parsed, dict) else [parsed]) if isinstance(v, list)]
        items = [t for v in lists for t in _leaves(v)] if parsed is not None else leaves[:1]
        said = [v for v in parsed.values() if isinstance(v, str)] if isinstance(parsed, dict) else []
        return Answer([*thoughts, text[:at], rest, *said], items, leaves, broken, rest, True)
    lines = [x for x in text.splitlines() if x.strip()]
    found = [_ITEM.match(x) for x in lines]
    items = [m.group(1).strip() for m in found if m]
    prose = "\n".join(x for x, m in zip(lines, found) if not m)
    if items:
        return Answer([*thoughts, prose], items, [], broken, items[-1] if found[-1] else lines[-1], True)
    return Answer([*thoughts, prose], [], [], broken, text, False)


def _bare(t: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[\[\](){}<>\"'`*_]", " ", t)).strip(" :,;").lower()


def _hollow(t: str) -> bool:
    b = _bare(t)
    return not b or b in PLACEHOLDERS or not re.search(r"\w", b)


def _alnum(t: str) -> str:
    return re.sub(r"[\W_]+", "", t.lower())


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    text = _FENCE.sub(" ", _THINK.sub(" ", response)).strip()
    if _hollow(text) or _PROVIDER.match(text):
        return True
    try:
        parsed = json.loads(text)
    except ValueError:
        return False
    if isinstance(parsed, dict) and parsed and all("error" in k.lower() or k.lower() in ("message", "code", "status", "type") for k in parsed):
        return True
    return all(_hollow(t) or _PROVIDER.match(t) for t in _leaves(parsed))


def is_copied(prompt: str, response: str, answer: Answer) -> bool:
    low = prompt.lower()
    text = _FENCE.sub(" ", response).lower()
    if not all(m[0] in low for m in re.finditer(r"[^\W_]+", text)):
        return False  # a word that the prompt doesn't hold
    own = _alnum(text)
    if len(own) < 6 or own not in _alnum(prompt):
        return False
    # A list of candidates is an answer, even where the prompt has them in that order.
    return not (answer.items and not answer.broken and all(_ITEM.match(x) or not x.strip() for x in response.strip().splitlines()))


def texts_of(answer: Answer) -> list[str]:
    """Sentences whose language counts, as letters: of remarks, thoughts and all strings of the answer, keys of places cut out."""
    out = []
    for t in dict.fromkeys([*answer.prose, *answer.items, *answer.leaves]):
        for s in sentences(_KEY.sub(" ", t)) if t.count(" ") >= LEAST_WORDS - 1 or not t.isascii() else ():
            x = letters_only(s)
            if substance(x)[0] >= LEAST_WORDS:
                out.append(x)
    return out


def said_by(answer: Answer) -> str:
    """What a response says besides its answer."""
    return " ".join(t for t in answer.prose if t)


def answers(answer: Answer) -> bool:
    """Whether a response names anything: an item that is more than a placeholder and no sentence."""
    return any(not _hollow(t) and len(t.split()) <= 4 for t in answer.items)


def end_texts(response: str | None) -> list[str]:
    """The texts of a response for the end model: whole items and remarks; none of broken structures."""
    if response is None or is_empty(response):
        return []
    a = read_answer(response)
    if a.broken:
        return []
    whole = [t for t in a.items if t] + [t for t in a.leaves if t and t not in a.items]
    return [*whole, a.last] if a.last and a.last not in whole else whole


def _summed(k: np.ndarray, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(k, return_inverse=True)
    return keys, np.bincount(at, e, len(keys)).astype(np.int64), np.bincount(at, t, len(keys)).astype(np.int64)


def count_ends(pairs: DataFrame) -> Ends:
    """Exact counts over the responses of all rows: of contexts, kept where they stand before an end at all (the end of
    every text to be judged is among those), of words said in place of an answer and beside one, and of parts left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held, words, parts_open = (none, none, none), np.zeros((2, WORD_SLOTS), np.int64), np.zeros((2, len(PARTS)), np.int64)
        rows = lambda kind, x: pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), kind, np.int8)), *map(pa.array, x)], names=["kind", "k", "e", "t"])
        for batch in batches:
            seen = Counter()
            for r in batch.column(0).to_pylist():
                if r is None or is_empty(r):
                    continue
                a = read_answer(r)
                for i, part in enumerate(PARTS):
                    parts_open[1, i] += _OPENS[part] in r.lower()
                    parts_open[0, i] += a.broken == part
                if a.broken:
                    continue
                seen.update(_classed(t) for t in end_texts(r))
                said = said_by(a)
                if len(said.split()) >= LEAST_WORDS:
                    words[int(answers(a))][np.r_[_word_slots(said), _NO_WORD]] += 1
            parts = [held]
            for t, n in seen.items():
                k, own = _all_keys(t), np.array(_end_keys(t), np.int64)
                parts += [(k, np.zeros(len(k), np.int64), np.full(len(k), n)), (own, np.full(len(own), n), np.zeros(len(own), np.int64))]
            held = _summed(*(np.concatenate(c) for c in zip(*parts)))
            if len(held[0]) > HELD:
                yield rows(0, held)
                held = (none, none, none)
        yield rows(0, held)
        slots = np.flatnonzero(words.any(axis=0))
        yield rows(1, (slots, words[0][slots], words[1][slots]))
        yield rows(2, (np.arange(len(PARTS)), parts_open[0], parts_open[1]))

    kept = pairs.select("response").mapInArrow(run, "kind byte, k long, e long, t long").groupBy("kind", "k").agg(F.sum("e").alias("e"), F.sum("t").alias("t")).filter(f"kind > 0 or (t >= {LEAST_SEEN} and e > 0)").toArrow()
    kind, keys, e, t = (kept[c].to_numpy() for c in ("kind", "k", "e", "t"))
    words = np.zeros((2, WORD_SLOTS))
    words[0][keys[kind == 1]], words[1][keys[kind == 1]] = e[kind == 1], t[kind == 1]
    # The empty word stands for the number of texts; what neither has seen says nothing.
    texts = np.maximum(words[:, _NO_WORD], 1)
    share = [w / n + 1e-3 for w, n in zip(words, texts)]
    own = np.flatnonzero(kind == 0)
    order = own[np.argsort(keys[own])]
    left_open = {PARTS[k]: (int(x), int(y)) for k, x, y in zip(keys[kind == 2], e[kind == 2], t[kind == 2])}
    return Ends(keys[order], e[order], t[order], np.log(share[0] / share[1]).astype(np.float32), left_open)


class Home:
    """Languages of prompts: the posterior over all of its lines. Lines recur and are read once; the oldest are
    forgotten between steps, never those of the step at hand."""

    def __init__(self, bayes: NaiveBayes):
        self.bayes = bayes
        self.lines: dict[str, np.ndarray] = {}

    def posteriors(self, prompts: list[str]) -> np.ndarray:
        """The log-posterior of each prompt over the languages; even where it holds no line of LEAST_WORDS words."""
        asked = [[x for x in map(str.strip, p.splitlines()) if x.count(" ") >= LEAST_WORDS - 1 or not x.isascii()] for p in prompts]
        new = list(dict.fromkeys(x for own in asked for x in own if x not in self.lines))
        if new:
            letters = [letters_only(_KEY.sub(" ", x)) for x in new]
            logs, total = self.bayes.logs(letters)
            for x, t, own, n in zip(new, letters, logs, total):
                self.lines[x] = own if substance(t)[0] >= LEAST_WORDS and n else np.zeros(len(LANGUAGES))
        out = np.zeros((len(prompts), len(LANGUAGES)))
        for i, own in enumerate(asked):
            if own:
                out[i] = np.sum([self.lines[x] for x in own], axis=0)
        if not out.any(axis=1).all():
            out[~out.any(axis=1), 0] = 1e3  # nothing to go by: English
        while len(self.lines) > REMEMBERED:
            del self.lines[next(iter(self.lines))]
        top = out.max(axis=1, keepdims=True)
        return out - top - np.log(np.exp(out - top).sum(axis=1, keepdims=True))


def judge(prompts: list[str], responses: list[str | None], bayes: NaiveBayes, ends: Ends, home: Home) -> list[tuple[str | None, float]]:
    """(defect or None, score) of each pair. ``home`` remembers the languages of prompt lines."""
    out: list[tuple[str | None, float]] = [(None, 0.0)] * len(responses)
    read: list[Answer | None] = []
    texts, owner = [], []
    for i, (p, r) in enumerate(zip(prompts, responses)):
        if is_empty(r):
            out[i] = ("empty", 1.0)
            read.append(None)
            continue
        a = read_answer(r)
        if is_copied(p, r, a):
            out[i] = ("copied", 1.0)
            read.append(None)
            continue
        read.append(a)
        own = texts_of(a)
        texts += own
        owner += [i] * len(own)
    foreign = np.zeros(len(responses))
    if texts:
        asked = home.posteriors(prompts)
        distinct = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        logs, total = bayes.logs(list(distinct))
        for i, t in zip(owner, texts):
            own, n = logs[distinct[t]], max(1, int(total[distinct[t]]))
            # Log-odds, an n-gram, of the best language against the languages of the prompt, weighted by their posterior.
            at_home = asked[i] + own
            top = at_home.max()
            expected = top + np.log(np.exp(at_home - top).sum()) if np.isfinite(top) else -np.inf
            foreign[i] = max(foreign[i], float(own.max() - expected) / n if np.isfinite(expected) else 1.0)
    for i, a in enumerate(read):
        if a is None:
            continue
        if a.broken:
            p_end = ends.likelihood_open(a.broken)
            if p_end < LEAST_OPEN:
                out[i] = ("truncated", 1 - p_end)
                continue
        said = said_by(a)
        answered = any(not _hollow(t) for t in a.items)
        if foreign[i] > LEAST_ODDS:
            out[i] = ("other_language", float(foreign[i]))
        elif not answers(a) and (odds := ends.declines(" ".join([said, *a.items]))) > 0:
            out[i] = ("refusal", float(1 / (1 + np.exp(-odds))))
        elif not answered:
            out[i] = ("empty", 0.5) if a.structured else ("truncated", 0.5)
        elif a.last and (p_end := ends.likelihood(a.last)) < LEAST_END:
            out[i] = ("truncated", 1 - p_end)
    return out


def pair_defects(pairs: DataFrame, bayes: NaiveBayes, ends: Ends) -> DataFrame:
    """One row per defective pair: result_id, round_no, defect, score.

    ``pairs`` has result_id, round_no, prompt and response; other columns are not
    read. A null or blank response is ``empty``; a null prompt counts as English
    and cannot be copied from. Texts of any length are read whole; repeated rows
    are judged each; an empty table gives no rows.
    """
    shared = pairs.sparkSession.sparkContext.broadcast((bayes, ends))  # a table of fixed size and 24 bytes for each context before an end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes, ends = shared.value
        home = Home(bayes)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, rounds, prompts, responses = (c.to_pylist() for c in batch.slice(at, 512).columns)
                found = judge([p or "" for p in prompts], responses, bayes, ends, home)
                rows = [(i, n, d, s) for i, n, (d, s) in zip(ids, rounds, found) if d]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return pairs.select(F.col("result_id").cast("long"), F.col("round_no").cast("int"), F.col("prompt").cast("string"), F.col("response").cast("string")).mapInArrow(run, SCHEMA)


def fit_bayes_on(docs: DataFrame) -> NaiveBayes:
    """A model fitted on a bounded sample of labelled documents (LABELLED_ROWS of larder.llm.text)."""
    return fit_bayes(labelled_documents(docs))
