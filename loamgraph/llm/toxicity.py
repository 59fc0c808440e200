"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of a word and a landmark sums their common subsequences of ORDER bytes, each
weighted by DECAY to the power of the stretches it spans in both (Lodhi et al. 2002), as
a share of the landmark's kernel with itself. So it falls slowly with inserted or left
out characters, and what else the word holds doesn't matter. A sentence's kernel with a
landmark is the greatest of its words'; runs of single characters count as a word too.

Landmarks are substrings of words of the labelled toxic documents, chosen one by one to
cover most documents not covered yet while hardly any other document holds them. The
kernel values are mapped by the inverse root of the landmarks' own normalised kernel
matrix, which is symmetric and positive semi-definite. Labels
are for documents, so the SVM is trained on sentences by turns: of a toxic document the
sentence with the highest score, and those that hold a whole landmark, are positive; of
others all sentences are negative. A
document's score is a logistic function of its highest sentence's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import lower_ascii, string_column, text_slices, word_bounds
from .labelled import labelled_sample, split_of

ORDER = 4
DECAY = 0.8

#: Longest piece of a word that one kernel sees; longer words are seen in pieces that
#: overlap by half.
PIECE = 48

#: Kernel values below count as none.
FAINT = 0.2

#: What a document counts for the next landmark, for each that covers it.
COVERED = 0.6

_SENTENCE_END = np.zeros(256, dtype=bool)
_SENTENCE_END[[0x2E, 0x21, 0x3F, 0x0A]] = True

_BIT = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    if 97 <= _b <= 122:
        _BIT[_b] = 1 << (_b - 97)
    elif _b >= 128:
        _BIT[_b] = 1 << (26 + (_b & 31))
    elif 48 <= _b <= 57:
        _BIT[_b] = 1 << 58


def subsequence_kernel(words: np.ndarray, landmark: bytes) -> np.ndarray:
    """Kernel values of words (rows of bytes, padded with 0) with one landmark."""
    n, width = words.shape
    m = len(landmark)
    # part[i][j]: weighted common subsequences of i bytes of the word so far and of the
    # landmark's first j bytes, stretched to both ends.
    part = np.zeros((ORDER, m + 1, n), dtype=np.float32)
    part[0] = 1
    total = np.zeros(n, dtype=np.float32)
    for k in range(width):
        letter = words[:, k]
        hits = [letter == b for b in landmark]
        for j in range(m):
            total += hits[j] * part[ORDER - 1, j] * DECAY**2
        for i in range(ORDER - 1, 0, -1):
            run = np.zeros(n, dtype=np.float32)
            for j in range(1, m + 1):
                run = DECAY * run + hits[j - 1] * part[i - 1, j - 1] * DECAY**2
                part[i, j] = DECAY * part[i, j] + run
    return total


def _rows(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(lengths.max())
    inside = np.arange(lengths.max()) < lengths[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0)


def _self_kernel(landmark: bytes) -> float:
    return float(subsequence_kernel(np.frombuffer(landmark, dtype=np.uint8)[None], landmark)[0])


def _need(landmark: bytes) -> tuple[np.uint64, int]:
    """The landmark's letters as bits, and how many of them a word has to have."""
    bits = np.bitwise_or.reduce(_BIT[np.frombuffer(landmark, dtype=np.uint8)])
    n = int(np.bitwise_count(bits))
    return bits, max(min(3, n), -(-3 * n // 4))


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters and digits, and where each word's begin and end in them."""
    keep = _BIT[data] != 0
    before = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], before[starts], before[ends]


def _with_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, and one more for each run of single bytes: (bytes, starts, lengths, the
    word it stands at)."""
    lengths, at = ends - starts, np.arange(len(starts))
    single = np.concatenate(([False], lengths == 1, [False])).astype(np.int8)
    edge = np.diff(single)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_run = hi - lo >= ORDER
    lo, hi = lo[long_run], hi[long_run]
    if not len(lo):
        return data, starts, lengths, at
    joined = np.concatenate([data[starts[a:b]] for a, b in zip(lo, hi)])
    sizes = hi - lo
    return np.concatenate((data, joined)), np.concatenate((starts, len(data) + np.cumsum(sizes) - sizes)), np.concatenate((lengths, sizes)), np.concatenate((at, lo))


def sentence_kernels(offs: np.ndarray, data: np.ndarray, landmarks: list[bytes], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kernel values (sentences x landmarks) of the sentences of a slice that have any,
    and each one's row."""
    data = lower_ascii(data)
    starts, ends, first = word_bounds(offs, data)
    if not len(starts):
        return np.zeros((0, len(landmarks)), np.float32), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    fresh = np.zeros(len(starts), dtype=np.int64)
    fresh[1:] = _SENTENCE_END[data[ends[:-1] - 1]] | (data[ends[:-1].clip(max=len(data) - 1)] == 10) | (row[1:] != row[:-1])
    sentence = np.cumsum(fresh)
    data, starts, lengths, at = _with_runs(*_letters(data, starts, ends))
    if not len(data):
        return np.zeros((0, len(landmarks)), np.float32), np.zeros(0, np.int64)
    if lengths.max() > PIECE:
        pieces = np.where(lengths > PIECE, -(-(lengths - PIECE) // (PIECE // 2)) + 1, 1)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, rest, at = np.repeat(starts, pieces) + step * (PIECE // 2), np.repeat(lengths, pieces) - step * (PIECE // 2), np.repeat(at, pieces)
        lengths = np.minimum(rest, PIECE)
    # Letters of each word, from the running pieces between word starts.
    bits = np.zeros(len(starts), dtype=np.uint64)
    for lo in range(0, len(starts), 50_000):
        s, n = starts[lo : lo + 50_000], lengths[lo : lo + 50_000]
        for k in range(int(n.max())):
            here = np.flatnonzero(n > k)
            bits[lo + here] |= _BIT[data[s[here] + k]]
    hit_sentence, hit_mark, hit_value = [], [], []
    for m, mark in enumerate(landmarks):
        need, count = _need(mark)
        some = np.flatnonzero((np.bitwise_count(bits & need) >= count) & (lengths >= ORDER))
        some = some[np.argsort(lengths[some], kind="stable")]
        for lo in range(0, len(some), 4096):
            part = some[lo : lo + 4096]
            value = (subsequence_kernel(_rows(data, starts[part], lengths[part]), mark) / own[m]) ** 2
            keep = value >= FAINT
            hit_sentence.append(sentence[at[part[keep]]])
            hit_value.append(value[keep])
            hit_mark.append(np.full(int(keep.sum()), m))
    if not hit_sentence or not sum(map(len, hit_sentence)):
        return np.zeros((0, len(landmarks)), np.float32), np.zeros(0, np.int64)
    where, which = np.unique(np.concatenate(hit_sentence), return_inverse=True)
    out = np.zeros((len(where), len(landmarks)), dtype=np.float32)
    np.maximum.at(out, (which, np.concatenate(hit_mark)), np.minimum(np.concatenate(hit_value), 1))
    return out, row[np.searchsorted(sentence, where)]


def _substrings(word: bytes, lengths: tuple[int, int]) -> set[bytes]:
    return {word[i : i + n] for n in range(lengths[0], lengths[1] + 1) for i in range(len(word) - n + 1)}


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int = 24, least_docs: int = 4, least_share: float = 0.02, lengths: tuple[int, int] = (4, 10)) -> list[bytes]:
    """Substrings of toxic documents' words that cover these documents, greedily. Words
    that hold a landmark give no further one. A landmark is in `least_docs` and in
    `least_share` of the toxic documents at least, in the former so that chance alone
    hardly makes one, and at most a fiftieth as often in other documents as in these."""
    lowered = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    clean = [t for t, y in zip(lowered, toxic) if not y]
    # A word that several other documents hold gives no landmark; a few may be mislabelled.
    often = Counter(w for t in clean for w in set(t.split()))
    known = {w for w, c in often.items() if c > max(1, 0.001 * len(clean))}
    docs = [{w.strip(b".,;:!?*%&$#|\"'()") for w in set(t.split()) - known} for t, y in zip(lowered, toxic) if y]
    count = Counter(s for words in docs for s in set().union(*(_substrings(w, lengths) for w in words)))
    least = max(least_docs, least_share * len(docs))
    usable = {s for s, c in count.items() if c >= least}
    del count, often
    in_clean: dict[bytes, int] = {}
    held = [{w: c for w in words if (c := _substrings(w, lengths) & usable)} for words in docs]
    worth = [1.0] * len(held)
    chosen: list[bytes] = []
    while len(chosen) < most:
        weight: Counter = Counter()
        full: Counter = Counter()
        for w, words in zip(worth, held):
            for s in set().union(*words.values()) & usable:
                weight[s] += w
                full[s] += 1
        fits = [s for s in weight if full[s] >= least]
        # Of those worth nearly the most, the one that the fewest other documents hold.
        fits = sorted(fits, key=lambda s: (-round(weight[s], 6), -len(s), s))
        share = len(held) / max(len(clean), 1)
        mark = None
        while fits and mark is None:
            best = [s for s in fits[:24] if weight[s] >= 0.9 * weight[fits[0]]]
            for s in best:
                if s not in in_clean:  # counted as far as it matters
                    in_clean[s] = sum(1 for _ in islice((t for t in clean if s in t), int(0.02 * full[s] / share) + 1))
            fair = [s for s in best if in_clean[s] * share <= 0.02 * full[s]]
            usable.difference_update(s for s in best if s not in fair)
            if fair:
                mark = min(fair, key=lambda s: (round(5 * in_clean[s] * share - weight[s], 6), -len(s), s))
            fits = fits[len(best) :]
        if mark is None:
            return chosen
        chosen.append(mark)
        for i, words in enumerate(held):
            with_mark = [w for w, c in words.items() if mark in c]
            if with_mark:
                worth[i] *= COVERED  # a covered document counts less for later landmarks
                for w in with_mark:
                    del words[w]
    return chosen


@dataclass
class Model:
    landmarks: list[bytes]
    own: np.ndarray
    weights: np.ndarray  # of the kernel values
    bias: float
    slope: float
    level: float

    def documents(self, offs: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Scores of a slice's rows."""
        n = len(offs) - 1
        top = np.full(n, self.bias)
        values, row = sentence_kernels(offs, data, self.landmarks, self.own)
        if len(row):
            np.maximum.at(top, row, values @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.level, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-4, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Linear SVM by averaged subgradient steps over the whole sample; y is 1 or -1."""
    w, b, mean_w, mean_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for t in range(1, steps + 1):
        open_ = weight * y * (y * (x @ w + b) < 1)
        rate = 4.0 / np.sqrt(t)
        w = w * (1 - min(rate * reg, 1)) + rate * (open_ @ x)
        b += rate * open_.sum()
        if t > steps // 2:
            mean_w, mean_b = mean_w + w, mean_b + b
    return mean_w / (steps - steps // 2), float(mean_b / (steps - steps // 2))


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level by Newton steps with a small ridge; Platt's smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.column_stack((z, np.ones(len(z)))), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * theta)
    return float(theta[0]), float(theta[1])


def landmark_kernel(marks: list[bytes]) -> np.ndarray:
    """The landmarks' normalised kernel matrix, each value squared. Both keep it positive
    semi-definite: it is a product of two such matrices, value by value."""
    padded = np.zeros((len(marks), max(map(len, marks))), dtype=np.uint8)
    for i, m in enumerate(marks):
        padded[i, : len(m)] = np.frombuffer(m, dtype=np.uint8)
    raw = np.column_stack([subsequence_kernel(padded, m) for m in marks]).astype(float)
    norm = np.sqrt(np.diag(raw))
    return ((raw + raw.T) / 2 / np.outer(norm, norm)) ** 2


def inverse_root(kernel: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """The inverse root, with a ridge for landmarks that are nearly the same."""
    values, vectors = np.linalg.eigh(kernel)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + ridge)) @ vectors.T


def fit(sample: list[tuple[str, int]]) -> Model:
    texts, toxic = [t for t, _ in sample], np.array([y for _, y in sample], dtype=np.int64)
    marks = choose_landmarks(texts, toxic) if toxic.any() else []
    if not marks:
        share = (toxic.sum() + 0.5) / (len(toxic) + 2)
        return Model([b"\x00" * ORDER], np.ones(1), np.zeros(1), 0.0, 0.0, float(np.log(share / (1 - share))))
    own = np.array([_self_kernel(m) for m in marks])
    values, rows = [], []
    for lo, _, offs, data in text_slices(pa.array(texts, pa.large_string())):
        v, r = sentence_kernels(offs, data, marks, own)
        values.append(v)
        rows.append(r + lo)
    x, row = np.concatenate(values).astype(float), np.concatenate(rows)
    root = inverse_root(landmark_kernel(marks))
    mapped = x @ root
    top = x.max(1)
    whole = top > 0.95
    for _ in range(4):
        order = np.lexsort((-top, row))
        head = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))]
        heads = np.zeros(len(row), dtype=bool)
        heads[head] = True
        positive = np.flatnonzero((toxic[row] == 1) & (heads | whole))
        negative = np.flatnonzero(toxic[row] == 0)
        features = np.concatenate((mapped[positive], mapped[negative], np.zeros((1, len(marks)))))
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative) + 1)))
        quiet = (toxic == 0).sum() - len(np.unique(row[negative]))
        weight = np.concatenate((np.full(len(positive), 0.3 / len(positive)), np.ones(len(negative)), [max(quiet, 1)]))
        weight[len(positive) :] *= 0.7 / weight[len(positive) :].sum()
        w, b = _svm(features, y, weight)
        top = mapped @ w + b
    z = np.full(len(texts), b)
    np.maximum.at(z, row, top)
    slope, level = _logistic(z, toxic)
    return Model(marks, own, root @ w, b, slope, level)


SCORE = "__toxicity_score"


def _scored(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, sample: int) -> DataFrame:
    """`docs` with the score of each text in one more column."""
    fitted = fit(labelled_sample(docs, labels, label, split_of(F.col("doc_id"), mod) != held_out, sample))
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, offs, data in text_slices(string_column(b, "text")):
                yield b.slice(lo, hi - lo).append_column(SCORE, pa.array(model.value.documents(offs, data)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", mod: int = 4, held_out: int = 2, threshold: float = 0.3, sample: int = 4000) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 if score
    >= threshold).

    Fitted on about `sample` labelled documents (twice as many at most), never on those
    whose crc32(doc_id as text) mod `mod` is `held_out`. Scores come from the text alone.

    Null and empty texts, and texts without white space or letters, are scored like any
    text without an insult. Null doc_ids are not held out. Very long texts and words are
    read whole. Without labels every score is the same. Repeated rows stay; an empty
    table gives no rows.
    """
    scored = _scored(docs.select("doc_id", "text"), labels, label, mod, held_out, sample)
    held = F.coalesce(split_of(F.col("doc_id"), mod) == held_out, F.lit(False))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", mod: int = 4, held_out: int = 2, threshold: float = 0.3, sample: int = 4000) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold."""
    scored = _scored(docs, labels, label, mod, held_out, sample)
    return scored.where(F.col(SCORE) < threshold).drop(SCORE)
