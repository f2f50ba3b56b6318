"""Languages of documents and of the segments of mixed documents.

Nearest-centroid classification: a sentence is a TF-IDF vector of hashed
character n-grams with length 1, compared by cosine with several centroids per
language. A sentence too far from all centroids, or too short, has no language
of its own and joins its neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import CHUNK, DIMS, LANGUAGES, chunked_grams, code_grams, grams, label_code, labelled_documents, letter_codes, plain, row_sums, sentences

#: A sentence is compared with the centroids of languages whose mean is at least so near, beside the nearest mean.
NEAR = 0.6
#: Clusters per language and rounds of fitting.
CLUSTERS, ROUNDS = 24, 4
#: Cost of a change of language between sentences while fitting, and least part of a language's sentences in a cluster.
FIT_COST, LEAST_CLUSTER = 0.15, 0.004
#: Least cosine with the nearest centroid of a sentence with a language of its own.
LEAST_COSINE = 0.10
#: Cost of a change of language between two sentences, in cosine.
CHANGE_COST = 0.10
#: Least words of a sentence, and words from which one counts in full.
LEAST_WORDS, FULL_WORDS = 3, 6
SCHEMA = "doc_id long, lang_label string, seg_no int, lang string, confidence double, n_sentences int, n_langs int, label_ok boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_label", pa.string()), ("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32()), ("n_langs", pa.int32()), ("label_ok", pa.bool_())])


@dataclass
class Centroids:
    idf: np.ndarray
    matrix: np.ndarray  # DIMS x centroids, those of a language side by side
    owner: np.ndarray  # language of each centroid, rising
    means: np.ndarray | None = None  # DIMS x languages: the mean of each language's sentences

    def __post_init__(self) -> None:
        present = np.unique(self.owner)
        self.of = {int(k): np.ascontiguousarray(self.matrix[:, self.owner == k]) for k in present}
        if self.means is None:
            self.means = np.zeros((DIMS, len(LANGUAGES)), np.float32)
            for k, own in self.of.items():
                m = own.sum(axis=1)
                self.means[:, k] = m / max(float(np.linalg.norm(m)), 1e-9)

    def __getstate__(self) -> tuple:
        return self.idf, self.matrix, self.owner, self.means

    def __setstate__(self, state: tuple) -> None:
        self.idf, self.matrix, self.owner, self.means = state
        self.__post_init__()

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Largest cosine per text and language; of languages whose mean is far off beside the nearest mean, the mean's."""
        return self._cosines(len(texts), *grams(texts))

    def read(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of sentences as they are, and their words."""
        code, size, words = letter_codes(sentences)
        return self._cosines(len(size), *code_grams(code, size)), words

    def _cosines(self, n: int, row: np.ndarray, dim: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[dim]
        norm = np.sqrt(row_sums(row, w * w, n))
        light, cuts = w.astype(np.float32), np.searchsorted(row, np.arange(n + 1)).tolist()
        out = np.zeros((n, len(LANGUAGES)), np.float32)
        held = np.empty((int(np.diff(cuts).max(initial=0)), max(self.matrix.shape[1], len(LANGUAGES))), np.float32).reshape(-1)

        def dots(i: int, m: np.ndarray) -> np.ndarray:
            lo, hi = cuts[i], cuts[i + 1]
            rows = held[: (hi - lo) * m.shape[1]].reshape(hi - lo, m.shape[1])
            m.take(dim[lo:hi], axis=0, out=rows, mode="clip")
            return light[lo:hi] @ rows

        some = [i for i in range(n) if cuts[i] < cuts[i + 1]]
        for i in some:
            out[i] = dots(i, self.means)
        close = out >= NEAR * out.max(axis=1, keepdims=True)
        # Language by language, so that the rows of its matrix stay in the processor's cache.
        for k, m in self.of.items():
            for i in np.flatnonzero(close[:, k]).tolist():
                if cuts[i] < cuts[i + 1]:
                    out[i, k] = dots(i, m).max()
        return out / np.maximum(norm, 1e-9).astype(np.float32)[:, None]


def _mean(row: np.ndarray, dim: np.ndarray, w: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Unit-length means of the texts in groups 0..k-1 (negative: none)."""
    g = group[row]
    ok = g >= 0
    m = np.bincount(g[ok].astype(np.int64) * DIMS + dim[ok], w[ok], k * DIMS).reshape(k, DIMS)
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _one(dim: np.ndarray, w: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The dense vector of one text."""
    out = np.zeros(DIMS, np.float32)
    out[dim[lo:hi]] = w[lo:hi]
    return out


def fit(labelled: list[tuple[str, list[str]]], clusters: int = CLUSTERS) -> Centroids:
    """Centroids from the sentences of labelled documents, some of which are in another language than their label.

    Each document is first read with the means of all languages; stretches of it
    that are clearly in another language are left out, and after clustering so
    are clusters of very few sentences. Each sentence also counts without accents.
    """
    labelled = [(c, [x for t in own for x in (t, plain(t))]) for c, own in labelled if own]
    texts = [t for _, own in labelled for t in own]
    lang = np.array([LANGUAGES.index(c) for c, own in labelled for _ in own], np.int64)
    if not texts:
        return Centroids(np.ones(DIMS), np.zeros((DIMS, 1), np.float32), np.array([0]))
    row, dim, count = chunked_grams(texts)
    df = np.bincount(dim, minlength=DIMS)
    idf = np.log((1 + len(texts)) / (1 + df)) + 0.1
    w = ((1 + np.log(count)) * idf[dim]).astype(np.float32)
    norm = np.sqrt(row_sums(row, w * w, len(texts)))
    w /= np.maximum(norm[row], 1e-9)

    def near(centres: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), len(centres)), np.float32)
        for k, c in enumerate(centres):
            out[:, k] = row_sums(row, c[dim] * w, len(texts))
        return out

    keep, words = lang, np.full(len(texts), FULL_WORDS)
    ends = np.cumsum([len(own) for _, own in labelled])
    for _ in range(3):
        score = near(_mean(row, dim, w, keep, len(LANGUAGES)))
        score[:, np.bincount(lang, minlength=len(LANGUAGES)) == 0] = -1
        path = np.concatenate([best_path(score[i:j], words[i:j], FIT_COST) for i, j in zip(np.r_[0, ends[:-1]], ends)])
        keep = np.where(path == lang, lang, -1)
    centres, owner = [], []
    for k in range(len(LANGUAGES)):
        mine = np.flatnonzero(keep == k)
        n = min(clusters, len(mine))
        if not n:
            continue
        # Only this language's n-grams take part in its clustering.
        own = keep[row] == k
        place = np.zeros(len(texts), np.int32)
        place[mine] = np.arange(len(mine))
        r, q, x = place[row[own]], dim[own], w[own]
        # Start from far sentences (k-means++ with a fixed seed), so that every kind of sentence finds a cluster.
        cuts = np.searchsorted(r, np.arange(len(mine) + 1))
        near_to = lambda i: row_sums(r, _one(q, x, cuts[i], cuts[i + 1])[q] * x, len(mine))
        rng, chosen = np.random.default_rng(k), [0]
        cos = [near_to(0)]
        while len(chosen) < n:
            far = np.maximum(1 - np.max(cos, axis=0), 0) ** 2
            if far.sum() <= 0:
                break
            chosen.append(int(rng.choice(len(mine), p=far / far.sum())))
            cos.append(near_to(chosen[-1]))
        part = np.argmax(cos, axis=0)
        n = len(chosen)
        for _ in range(ROUNDS):
            score = np.stack([row_sums(r, c[q] * x, len(mine)) for c in _mean(r, q, x, part, n)], axis=1)
            part = score.argmax(axis=1)
        size = np.bincount(part, minlength=n)
        m = _mean(r, q, x, part, n)[size >= max(1, LEAST_CLUSTER * len(mine))]
        centres.append(m)
        owner += [k] * len(m)
    means = _mean(row, dim, w, keep, len(LANGUAGES)).T
    return Centroids(idf, np.ascontiguousarray(np.concatenate(centres).T), np.array(owner), np.ascontiguousarray(means))


def best_path(cos: np.ndarray, words: np.ndarray, cost: float = CHANGE_COST) -> np.ndarray:
    """The language of each sentence of a document: its own evidence less a cost for every change (Viterbi)."""
    gain = np.where(cos.max(axis=1, keepdims=True) < LEAST_COSINE, 0, cos) * np.minimum(1, words / FULL_WORDS)[:, None]
    score, back = gain[0], []
    for g in gain[1:]:
        moved = score.max() - cost
        back.append(np.where(score >= moved, np.arange(len(score)), score.argmax()))
        score = np.maximum(score, moved) + g
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _confidence(cos: np.ndarray, lang: np.ndarray) -> np.ndarray:
    soft = np.exp((cos - cos.max(axis=1, keepdims=True)) * 25)
    return soft[np.arange(len(lang)), lang] / soft.sum(axis=1)


def segments(cos: np.ndarray, words: np.ndarray) -> list[tuple[int, float, int]]:
    """Runs of sentences in one language: (language, mean confidence, sentences); none without any real sentence."""
    real = (cos.max(axis=1, initial=0) >= LEAST_COSINE) & (words >= LEAST_WORDS)
    if not real.any():
        return []
    path = best_path(cos, words)
    conf = _confidence(cos, path)
    cuts = np.r_[0, np.flatnonzero(path[1:] != path[:-1]) + 1, len(path)]
    return [(int(path[i]), float(conf[i:j][real[i:j]].mean()) if real[i:j].any() else float(conf[i:j].mean()), int(j - i)) for i, j in zip(cuts[:-1], cuts[1:])]


def all_segments(cos: np.ndarray, words: np.ndarray, cuts: np.ndarray) -> list[list[tuple[int, float, int]]]:
    """``segments`` of many documents, document i having the sentences cuts[i] up to cuts[i + 1].

    Where all sentences with evidence are nearest to one language, that language is the best path (no other has
    more of any sentence, and it never changes); only the other documents need the search.
    """
    n = len(cuts) - 1
    out: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
    doc = np.repeat(np.arange(n), np.diff(cuts))
    top = cos.max(axis=1, initial=0)
    best = cos.argmax(axis=1) if len(cos) else np.zeros(0, np.int64)
    strong = (top >= LEAST_COSINE) & (words > 0)
    real = strong & (words >= LEAST_WORDS)
    any_real = np.bincount(doc[real], minlength=n) > 0
    low, high = np.full(n, len(LANGUAGES)), np.full(n, -1)
    np.minimum.at(low, doc[strong], best[strong])
    np.maximum.at(high, doc[strong], best[strong])
    one = any_real & (low == high)
    inside = real & one[doc]
    conf = np.bincount(doc[inside], _confidence(cos[inside], low[doc[inside]]), n) / np.maximum(np.bincount(doc[inside], minlength=n), 1)
    size = np.diff(cuts)
    for i in np.flatnonzero(any_real):
        out[i] = [(int(low[i]), float(conf[i]), int(size[i]))] if one[i] else segments(cos[cuts[i] : cuts[i + 1]], words[cuts[i] : cuts[i + 1]])
    return out


def _label_fits(label: str | None, langs: list[str]) -> bool:
    return len(set(langs)) == 1 and label_code(label) == langs[0]


def language_segments(docs: DataFrame, model: Centroids) -> DataFrame:
    """One row per segment: doc_id, lang_label, seg_no, lang, confidence, n_sentences, n_langs, label_ok.

    A segment is a longest run of sentences in one language, numbered from 0.
    Quoted phrases, markup, very short pieces and pieces far from every language
    belong to the segment around them. Null, empty and sentence-free texts give
    no rows; repeated documents give repeated rows; texts of any length are read
    whole. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x CLUSTERS x 8 floats, 25 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                ids, labels, texts = (c.to_pylist() for c in batch.slice(at, 2048).columns)
                units = [sentences(t) for t in texts]
                cuts = np.r_[0, np.cumsum([len(us) for us in units])]
                # A sentence that recurs is read once a step.
                seen: dict[str, int] = {}
                which = np.array([seen.setdefault(u, len(seen)) for us in units for u in us], np.int64)
                distinct = list(seen)
                read = [model.read(distinct[i : i + CHUNK]) for i in range(0, max(1, len(distinct)), CHUNK)]
                cos, words = (np.concatenate(x) for x in zip(*read))
                rows = []
                for i, label, segs in zip(ids, labels, all_segments(cos[which], words[which], cuts)):
                    langs = [LANGUAGES[s[0]] for s in segs]
                    fits = _label_fits(label, langs)
                    rows += [(i, label, j, LANGUAGES[s[0]], s[1], s[2], len(set(langs)), fits) for j, s in enumerate(segs)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return docs.filter("text is not null").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, SCHEMA)


def fit_on(docs: DataFrame) -> Centroids:
    """Centroids fitted on a bounded sample of labelled documents (LABELLED_ROWS of larder.llm.text)."""
    return fit(labelled_documents(docs))
