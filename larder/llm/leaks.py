"""Evaluation texts that occur, whole or in part, in training documents.

A leak is a stretch of L words of an item found in a document with at most L/8
words changed, added or dropped. By the pigeonhole principle a stretch with a
budget of e errors, cut into e + 1 pieces, has one piece of at least ``PIECE``
words without any error; all such pieces of all items are looked up exactly in
every document, and only (document, item) pairs with enough hits are verified
with Myers' bit-parallel edit distance, words taking the place of characters.
Words are 64-bit hashes made by arrays over a batch of texts.

Words that several cases begin with are their opening. A stretch that lies
wholly inside it is no leak; one that goes beyond it is one by what stands behind
the opening: ten words or more within the budget, or a word of its own among
words of which at most one in four is wrong.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import durable

#: Least length of a leak and words per allowed error.
LEAST_WORDS, WORDS_PER_ERROR = 15, 8
#: Words of an exact piece: the least over all lengths L of L // (L // 8 + 1), with the words left over.
PIECE = 5
#: Words that so many different cases begin with are a shared instruction; a word of so many texts is none's own.
SHARED = 3
#: Least words behind an opening that are an excerpt by themselves.
EXCERPT = 10
#: Longest window of the verification, in words: one less than the bits of a machine word.
WINDOW = 63
#: Evaluation sets are small beside corpora; their index is broadcast, so their number is checked.
MAX_ITEMS = 50_000
#: Characters of documents that are taken apart at once (a longer text alone).
CHARS = 1 << 20

_ATTRIBUTE = r"""\s+[\w:.-]+(?:\s*=\s*(?:"[^"\x00]*"|'[^'\x00]*'|[^\s"'<>\x00]+))?"""
_MARKUP = re.compile(rf"</?[a-zA-Z][\w:.-]*(?:{_ATTRIBUTE})*\s*/?>|\{{\\[a-z]+ ?|\\[a-z]+\{{")
_BREAK = re.compile(r"[-‐‑­]\s*\r?\n\s*(?:[>|*#]+\s*)?")
_JOIN = re.compile(r"(?<=\w)[-‐‑–­​'’`´*_]+(?=\w)")
_HIDDEN = re.compile(r"[­​‌‍⁠﻿]")
# Letters whose plain form is no part of their decomposition.
_PLAIN = {"ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = np.uint64(31)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> _S)


@dataclass
class Words:
    """Words of several texts: the 64-bit hash of each, and the first word of each text (one more at the end)."""

    hashes: np.ndarray
    cuts: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def spelled(self) -> list[str]:
        return [self.codes[a:b].astype(np.uint32).tobytes().decode("utf-32-le") for a, b in zip(self.starts, self.ends)]


def words_of(texts: list[str]) -> Words:
    """Words of texts without layout, markup, case, punctuation and accents; hyphenation is undone."""
    # A NUL between two texts is no blank, word sign or part of any pattern, so nothing reaches across it.
    t = "\n\x00\n".join([x.replace("\x00", " ") if "\x00" in x else x for x in texts])
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = _HIDDEN.sub("", t)
    t = _MARKUP.sub(" ", _BREAK.sub("", t)).casefold()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
        for letter, plain in _PLAIN.items():
            if letter in t:
                t = t.replace(letter, plain)
    marks = "" if t.isascii() else "".join(c for c in set(t) if unicodedata.combining(c))
    if marks:
        t = re.sub(f"[{re.escape(marks)}]+", "", t)
    t = _JOIN.sub("", t)
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(int(codes.max(initial=0)) + 1, bool)
    there = np.flatnonzero(np.bincount(codes, minlength=1)) if len(codes) else np.zeros(0, np.int64)
    letter[there] = [chr(c).isalnum() for c in there]
    inside = np.r_[False, letter[codes] if len(codes) else np.zeros(0, bool), False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    between = np.flatnonzero(codes == 0)
    cuts = np.r_[0, np.searchsorted(starts, between), len(starts)] if texts else np.zeros(1, np.int64)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), cuts, codes, starts, ends)
    size = ends - starts
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()) + 1, _A | np.uint64(1), np.uint64))
        own = np.flatnonzero(inside[1:-1])
        place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        h = np.add.reduceat(_mixed(codes[own].astype(np.uint64) + _A) * power[place], np.cumsum(size) - size)
        return Words(_mixed(h + size.astype(np.uint64)), cuts, codes, starts, ends)


def words(text: str) -> list[str]:
    """The words of one text as strings."""
    return words_of([text]).spelled()


def pieces(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all stretches of PIECE words in a row."""
    n = len(hashes) - PIECE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = hashes[:n].copy()
        for j in range(1, PIECE):
            h = h * _A + hashes[j : n + j]
        return _mixed(h)


def budgets(longest: int) -> list[tuple[int, int]]:
    """(length, errors) of the stretches that need testing: any leak contains one of them."""
    out = [(LEAST_WORDS, LEAST_WORDS // WORDS_PER_ERROR)]
    out += [(n, n // WORDS_PER_ERROR) for n in range(2 * WORDS_PER_ERROR, min(longest, WINDOW) + 1, WORDS_PER_ERROR)]
    return [(n, e) for n, e in out if n <= longest]


def _different(a: list, b: list) -> bool:
    """Whether two texts are different cases: at least five pieces of the shorter, and half of them, are not in the other."""
    x, y = sorted(({tuple(w[at : at + PIECE]) for at in range(len(w) - PIECE + 1)} for w in (a, b)), key=len)
    return len(x - y) >= max(PIECE, (len(x) + 1) // 2)


def _cases(rests: Iterator[list]) -> int:
    """Different cases among texts, counted up to SHARED."""
    kept: list[list] = []
    for r in rests:
        if all(_different(r, k) for k in kept):
            kept.append(r)
            if len(kept) == SHARED:
                break
    return len(kept)


def openings(texts: list[list]) -> list[int]:
    """Words of each text that it begins with in common with SHARED - 1 others or more, equal and near-equal texts
    counting as one."""
    order = sorted(set(map(tuple, texts)))
    found = dict.fromkeys(order, 0)
    todo = [(0, len(order), -1)]
    while todo:
        lo, hi, above = todo.pop()
        if hi - lo < SHARED:
            continue
        first, last = order[lo], order[hi - 1]
        n = next((j for j, (x, y) in enumerate(zip(first, last)) if x != y), min(len(first), len(last)))
        if n >= PIECE and n > above:
            if _cases(list(t[n:]) for t in order[lo:hi]) < SHARED:
                continue
            found.update((t, n) for t in order[lo:hi])
        at = lo
        for k in range(lo + 1, hi + 1):
            if k == hi or order[k][n : n + 1] != order[at][n : n + 1]:
                todo.append((at, k, n))
                at = k
    return [found[tuple(t)] for t in texts]


def own_words(texts: list[list], opened: list[int]) -> list[list[int]]:
    """Places of the words behind each text's opening that fewer than SHARED different texts hold."""
    held: dict[object, int] = {}
    for t in set(map(tuple, texts)):
        for x in set(t):
            held[x] = held.get(x, 0) + 1
    return [[p for p in range(o, min(len(t), o + WINDOW)) if held[t[p]] < SHARED] if o else [] for t, o in zip(texts, opened)]


class Items:
    """Items with the sorted hashes of their exact pieces. Plain arrays, so that it travels as one broadcast."""

    def __init__(self, rows: list[tuple[int, str]], opened: list[int] | None = None, own: list[list[int]] | None = None):
        """``opened`` and ``own``: openings and own words, where they were found over more items than these."""
        self.ids, self.texts = [i for i, _ in rows], [t for _, t in rows]
        w = words_of(self.texts)
        self.cuts, self.hashes = w.cuts, w.hashes
        listed = [w.hashes[a:b].tolist() for a, b in zip(w.cuts[:-1], w.cuts[1:])]
        self.listed = listed
        self.opened = openings(listed) if opened is None else list(opened)
        self.behind = np.array(self.opened, np.int64)
        mine = np.zeros(len(w.hashes) + 1, np.int64)
        for k, places in enumerate(own_words(listed, self.opened) if own is None else own):
            mine[w.cuts[k] + 1 + np.array(places, np.int64)] = 1
        self.own = np.cumsum(mine)  # own words before each place
        key = pieces(w.hashes)
        item = np.repeat(np.arange(len(rows)), np.diff(w.cuts))[: len(key)]
        place = (np.arange(len(w.hashes)) - np.repeat(w.cuts[:-1], np.diff(w.cuts)))[: len(key)]
        inside = place + PIECE <= np.diff(w.cuts)[item] if len(key) else np.zeros(0, bool)
        key, item, place = key[inside], item[inside], place[inside]
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, first, self.many = np.unique(key[order], return_index=True, return_counts=True)
        self.first = first
        self.bits = np.uint64(64 - min(22, 6 + max(1, len(self.keys)).bit_length()))
        self.maybe = np.zeros(1 << (64 - int(self.bits)), bool)
        self.maybe[(self.keys >> self.bits).astype(np.int64)] = True
        self._masks: dict[tuple[int, int], dict[int, np.ndarray]] = {}

    def masks(self, k: int, n: int) -> dict[int, np.ndarray]:
        """For each word of item k the bit masks of its places in all windows of n words."""
        if (k, n) not in self._masks:
            if len(self._masks) > 4000:
                self._masks.clear()
            w = self.listed[k]
            lanes = len(w) - n + 1
            out: dict[int, np.ndarray] = {}
            for p, x in enumerate(w):
                m = out.setdefault(x, np.zeros(lanes, np.uint64))
                s = np.arange(max(0, p - n + 1), min(lanes - 1, p) + 1)
                m[s] |= np.uint64(1) << (p - s).astype(np.uint64)
            self._masks[k, n] = out
        return self._masks[k, n]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place in the text, place in the item) of every exact piece, in this order."""
        key = pieces(w.hashes)
        at = np.flatnonzero(self.maybe[(key >> self.bits).astype(np.int64)])
        found = np.searchsorted(self.keys, key[at])
        ok = found < len(self.keys)
        ok[ok] = self.keys[found[ok]] == key[at[ok]]
        at, found = at[ok], found[ok]
        text = np.searchsorted(w.cuts, at, "right") - 1
        ok = at + PIECE <= w.cuts[text + 1]
        at, found, text = at[ok], found[ok], text[ok]
        many = self.many[found]
        here = np.repeat(self.first[found] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        text, at, item, place = np.repeat(text, many), np.repeat(at - w.cuts[text], many), self.item[here], self.place[here]
        order = np.lexsort((place, at, item, text))
        return text[order], item[order], at[order], place[order]


def least_distance(masks: dict[int, np.ndarray], n: int, region: list[int], lanes: np.ndarray) -> np.ndarray:
    """Least edit distance of each window (lane) to any stretch of ``region``: Myers' algorithm, 64 bits a lane."""
    one = np.uint64(1)
    top = one << np.uint64(n - 1)
    full = np.uint64((1 << n) - 1)
    pv, mv = np.full(len(lanes), full), np.zeros(len(lanes), np.uint64)
    score = np.full(len(lanes), n)
    best = score.copy()
    none = np.zeros(len(lanes), np.uint64)
    with np.errstate(over="ignore"):
        for x in region:
            m = masks.get(x)
            eq = none if m is None else m[lanes]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            ph, mh = ph << one, mh << one  # a match may begin anywhere: no carry into the first bit
            pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
            np.minimum(best, score, out=best)
    return best


def _own_there(items: Items, k: int, m: int, e: int, w: list[int], slants: set[int]) -> bool:
    """Whether one of the m words behind an item's opening that are its own stands where the hits put it, give or take e."""
    size, opened, base = len(items.listed[k]), items.opened[k], int(items.cuts[k])
    for p in range(opened, min(size, opened + m)):
        if items.own[base + p + 1] > items.own[base + p]:
            x = items.listed[k][p]
            for d in slants:
                if x in w[max(0, d + p - e) : max(0, d + p + e + 1)]:
                    return True
    return False


def _beyond(items: Items, k: int, m: int, e: int, region: list[int], w: list[int], slants: set[int]) -> bool:
    """Whether a stretch with m words behind the opening is more than the opening met by chance words."""
    if m >= EXCERPT and least_distance(items.masks(k, m), m, region, items.behind[k : k + 1])[0] <= m // WORDS_PER_ERROR:
        return True
    before = min(2, items.opened[k])
    if least_distance(items.masks(k, before + m), before + m, region, items.behind[k : k + 1] - before)[0] > m // 4:
        return False
    return _own_there(items, k, m, e, w, slants)


def _verified(items: Items, k: int, w: list[int], at: np.ndarray, place: np.ndarray) -> bool:
    size, opened = len(items.listed[k]), items.opened[k]
    if opened and not (place >= opened).any() and not _own_there(items, k, WINDOW, WINDOW // WORDS_PER_ERROR, w, set((at - place).tolist())):
        return False  # ten words within the budget would hold a piece
    for n, e in budgets(size):
        least = n - PIECE + 1 - PIECE * e  # pieces that e errors leave at least
        cuts = np.flatnonzero(np.diff(at) > 2 * n) + 1  # regions of the document around neighbouring hits
        for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
            if j - i < least:
                continue
            there = np.zeros(size + 1, np.int64)
            there[place[i:j] + 1] = 1
            held = np.cumsum(there)
            starts = np.arange(max(0, opened - n + 1), size - n + 1)
            starts = starts[held[starts + n - PIECE + 1] - held[starts] >= least]
            if not len(starts):
                continue
            region = w[max(0, int(at[i]) - n - e) : int(at[j - 1]) + PIECE + n + e]
            near = starts[least_distance(items.masks(k, n), n, region, starts) <= e]
            if not len(near):
                continue
            slants = set((at[i:j] - place[i:j]).tolist())
            if near[-1] >= opened or any(_beyond(items, k, int(s + n - opened), e, region, w, slants) for s in near[::-1]):
                return True
    return False


def leaks_in(items: Items, texts: list[str]) -> list[tuple[int, int, int]]:
    """(text, item, exact pieces found) for every item that leaks into one of the texts."""
    w = words_of(texts)
    text, item, at, place = items.hits(w)
    if not len(text):
        return []
    new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    many = np.diff(np.r_[first, len(text)])
    leaks = np.zeros(len(first), bool)
    # Exact pieces on one diagonal are an exact stretch; long ones are leaks without further tests.
    slant = at - place
    order = np.lexsort((place, slant, group))
    g, s, p = group[order], slant[order], place[order]
    run = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)])
    lo, hi, g = p[run], p[np.r_[run[1:], len(p)] - 1] + PIECE, g[run]
    k = item[first[g]]
    behind = np.maximum(lo, items.behind[k])  # where the part of a run behind the opening begins
    own = items.own[items.cuts[k] + np.maximum(hi, behind)] - items.own[items.cuts[k] + behind]
    sound = (hi - lo >= LEAST_WORDS) & (hi > items.behind[k]) & ((lo >= items.behind[k]) | (hi - behind >= EXCERPT) | (own > 0))
    leaks[g[sound]] = True
    # No stretch of any budget keeps fewer pieces than this.
    fewest = min(n - PIECE + 1 - PIECE * e for n, e in budgets(WINDOW))
    for i in np.flatnonzero(~leaks & (many >= fewest)):
        a, b = first[i], first[i] + many[i]
        t = text[a]
        lo, hi = max(0, int(at[a:b].min()) - 3 * WINDOW), int(at[a:b].max()) + 3 * WINDOW
        near = w.hashes[w.cuts[t] + lo : min(w.cuts[t + 1], w.cuts[t] + hi)].tolist()
        leaks[i] = _verified(items, int(item[a]), near, at[a:b] - lo, place[a:b])
    return [(int(text[first[i]]), int(item[first[i]]), int(many[i])) for i in np.flatnonzero(leaks)]


def leaks_of(items: Items, text: str) -> list[tuple[int, int]]:
    """(item position, exact pieces found) for every item that leaks into a text."""
    return [(k, n) for _, k, n in leaks_in(items, [text])]


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item of which it holds a stretch: doc_id, item_id, n_pieces.

    ``docs`` has doc_id and text, ``items`` item_id and text. Every document is
    read once, whole, where it lies; nothing is shuffled. Null and empty texts and
    items of fewer than 15 words give no rows; repeated documents give repeated
    rows, equal items each their own. Other columns are not read. More than
    ``MAX_ITEMS`` items are taken in several passes, with the same rows.
    """
    rows = _with_openings(items.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text").distinct())
    total = rows.count()
    passes = max(1, -(-total // MAX_ITEMS))
    out = None
    for i in range(passes):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i) if passes > 1 else rows
        one = _one_pass(docs, part.orderBy("item_id", "text").collect())
        out = one if out is None else out.unionByName(one)
    return out


def _listed(texts: list[str]) -> list[list[int]]:
    w = words_of(texts)
    signed = w.hashes.view(np.int64)
    return [signed[a:b].tolist() for a, b in zip(w.cuts[:-1], w.cuts[1:])]


def _with_openings(rows: DataFrame) -> DataFrame:
    """Items with the number of words of their opening (opened) and the places of own words behind it (own), found over
    all items: those with one opening have their first words in common."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _listed(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.list_(pa.int64())), pa.array([" ".join(map(str, x[:PIECE])) for x in w], pa.string())], names=["item_id", "text", "words", "key"])

    def opened(group: pa.Table) -> pa.Table:
        n = openings(group["words"].to_pylist())
        return pa.table({"item_id": group["item_id"], "text": group["text"], "words": group["words"], "opened": pa.array(n, pa.int32())})

    known = durable(rows.mapInArrow(keyed, "item_id long, text string, words array<long>, key string").groupBy("key").applyInArrow(opened, "item_id long, text string, words array<long>, opened int"))
    common = known.select("text", F.explode(F.array_distinct("words")).alias("word")).distinct().groupBy("word").count().filter(F.col("count") >= SHARED).select("word")
    behind = known.filter("opened > 0").select("item_id", "text", F.posexplode(F.slice("words", F.col("opened") + 1, F.lit(WINDOW))).alias("i", "word"), "opened")
    own = behind.join(common, "word", "left_anti").groupBy("item_id", "text").agg(F.sort_array(F.collect_list(F.col("i") + F.col("opened"))).alias("own"))
    return durable(known.join(own, ["item_id", "text"], "left").select("item_id", "text", "opened", F.coalesce("own", F.array().cast("array<int>")).alias("own")))


def _one_pass(docs: DataFrame, rows: list) -> DataFrame:
    index = Items([(r.item_id, r.text) for r in rows], [r.opened for r in rows], [r.own for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(index)  # some 3 kB an item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, out = 0, []
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size == 0 or size + len(texts[end]) <= CHARS):
                    size += len(texts[end])
                    end += 1
                out += [(ids[at + t], items.ids[k], n) for t, k, n in leaks_in(items, texts[at:end])]
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "n_pieces"])

    return docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, n_pieces long")
