"""Sentences, hashed character n-grams and labelled samples for the language models."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.ids import NO_VALUE

# The languages and the names and codes under which labels call them.
LANGUAGES = ("en", "sv", "da", "de", "fr", "es", "ms", "zh")
LABELS = {
    "en": ("en", "eng", "english"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "da": ("da", "dan", "danish", "dansk"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "es": ("es", "spa", "spanish", "español"),
    "ms": ("ms", "msa", "may", "zsm", "malay", "bahasa melayu"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese"),
}
# Codes of "no or unknown language".
NO_LANGUAGE = (*NO_VALUE, "und", "zxx", "mis", "mul", "xx", "other")

#: Labelled rows used to fit a language model (the rows with the smallest hash of their id), and sentences of a language among them.
LABELLED_ROWS, LABELLED_SENTENCES = 6000, 1200
#: Texts whose n-grams are made at once; bounds the memory of a fit.
CHUNK = 1000

BITS = 15
DIMS = 1 << BITS
ORDERS = (1, 2, 3, 4)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Quoted phrases: pairs of marks on one line without the end of a sentence and a next one between them.
_PAIRS = ('""', "“”", "„“", "„”", "«»", "「」", "『』")
_QUOTED = re.compile("|".join(f"{a}[^{b}.!?…。！？\n]*(?:(?:[.!?…](?=\\S|\\s+[a-zß-öø-ÿ])|[。！？](?={b}))[^{b}.!?…。！？\n]*)*{b}" for a, b in _PAIRS))
_MARKS = re.compile("[" + "".join(sorted({p[0] for p in _PAIRS})) + "]")
_END = re.compile(r"(?<=[.!?…])[)\]\"'”’]*\s+|(?<=[。！？])|\n\s*\n|\n(?=\s*(?:[-*•#>|]|\d+[.)])\s)|(?<=[.!?…:)\]|])\s*\n")
_TAG = re.compile(r"<(?=[/!?\w])[^<>\n]+>")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_CJK = re.compile(r"[㐀-鿿豈-﫿぀-ヿ가-힯]")


def label_code(label: str | None) -> str | None:
    """The language a label names: a code of LANGUAGES, None for no value, "?" for any other language."""
    t = (label or "").strip().lower()
    if t in NO_LANGUAGE:
        return None
    head = re.split(r"[-_ ]", t)[0]
    for code, names in LABELS.items():
        if t in names or head in names:
            return code
    return "?"


def sentences(text: str) -> list[str]:
    """Whole sentences of a text in order, quoted phrases and markup left out."""
    t = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if _MARKS.search(t):
        t = _QUOTED.sub(' "" ', t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    return [s for s in (" ".join(x.split()) for x in _END.split(t)) if s]


def letters_only(s: str) -> str:
    """Lower case, everything but letters as single blanks, a blank at both ends."""
    return f" {_NOT_LETTER.sub(' ', s.lower()).strip()} "


def plain(s: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def substance(s: str) -> tuple[int, int]:
    """Words and letters of a letters_only text; a CJK sign counts as a half word and two letters."""
    signs = len(_CJK.findall(s))
    return len(s.split()) + signs // 2, len(s.replace(" ", "")) + signs


def letter_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``letters_only`` leaves of texts without line breaks, as (code points of all, length of each), and the words
    of each as ``substance`` counts them, by arrays."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer(("\n" + "\n".join(texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.flatnonzero(np.bincount(code))
    kind = np.zeros((int(code.max()) + 1, 2), bool)
    kind[there] = [(not _NOT_LETTER.match(chr(c)), bool(_CJK.match(chr(c)))) for c in there]
    letter, line = kind[code, 0], code == 10
    # The first sign of a run between two letters of a text stays as its blank; a line break is a blank at either side.
    after = np.r_[False, letter[:-1]] & ~letter & ~line
    firm = np.flatnonzero(letter | line)
    start = np.flatnonzero(after)
    after[start] = letter[firm[np.searchsorted(firm, start)]]
    times = letter + after + 2 * line.astype(np.int64)
    out = np.repeat(np.where(letter, code, np.uint32(32)), times)[1:-1]
    upto = np.cumsum(times)[line] - 2  # of the breaks' two blanks, one on either side
    row = np.cumsum(line) - 1
    words = np.bincount(row[letter & ~np.r_[False, letter[:-1]]], minlength=n)[:n]
    signs = np.bincount(row[kind[code, 1]], minlength=n)[:n]
    return out, np.diff(upto), words + signs // 2


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text: (row, dimension, count), sorted by row."""
    return code_grams(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64))


def code_grams(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the code points of all texts and the length of each."""
    code = code.astype(np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))
    keys = []
    h = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = (h[:m] + code[n - 1 :] + np.uint64(n)) * _MIX
            h ^= h >> np.uint64(29)
            if n not in ORDERS:
                continue
            ok = left[:m] >= n
            if n == 1:
                ok &= code[:m] != 32
            keys.append((row[:m][ok] << BITS) | (h[ok] >> np.uint64(64 - BITS)).astype(np.int64))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key >> BITS, key & (DIMS - 1), count


def row_sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the lines of ``values`` by ``row`` (sorted)."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def chunked_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``grams`` in small steps and compact types."""
    parts = [(at, grams(texts[at : at + CHUNK])) for at in range(0, len(texts), CHUNK)]
    join = lambda i, kind: np.concatenate([(g[i] + at if i == 0 else g[i]).astype(kind) for at, g in parts]) if parts else np.zeros(0, kind)
    return join(0, np.int32), join(1, np.int32), join(2, np.int32)


def labelled_documents(docs: DataFrame, rows: int = LABELLED_ROWS, per_language: int = LABELLED_SENTENCES) -> list[tuple[str, list[str]]]:
    """(language, letters of the sentences) of at most ``rows`` documents with a usable label.

    Documents are taken in the order of the hashes of their ids, of each language
    until ``per_language`` sentences are reached.
    """
    names = [n for v in LABELS.values() for n in v]
    head = F.element_at(F.split(F.lower(F.trim("lang")), "[-_ ]"), 1)
    # A hash threshold leaves about twice the bound, so that no task sends more than its part of that to the driver.
    part = min(1.0, 2 * rows / max(1, docs.count()))
    h = F.xxhash64("doc_id")
    usable = docs.filter((F.pmod(h, F.lit(1_000_000)) < F.lit(int(part * 1_000_000) + 1)) & head.isin(names) & F.col("text").isNotNull()).select("lang", "text", h.alias("h"), "doc_id")
    sample = usable.orderBy("h", "doc_id").limit(rows).select("lang", "text").collect()
    out: list[tuple[str, list[str]]] = []
    seen = dict.fromkeys(LANGUAGES, 0)
    for r in sample:
        code = label_code(r.lang)
        if seen[code] < per_language:
            own = [t for t in map(letters_only, sentences(r.text)) if substance(t)[0] >= 4]
            out.append((code, own))
            seen[code] += len(own)
    return out
