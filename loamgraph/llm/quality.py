"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is described by its
shares of byte classes and by word shapes, and encoded by one hidden layer. Gated
attention (Ilse et al. 2018) gives each passage a weight,

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),

and a logistic layer scores the weighted sum of the encodings. All parts are trained
together from document labels, by Adam over batches of bags in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import _IS_SPACE, string_column, text_slices, word_bounds, word_hashes
from .labelled import labelled_sample, split_of

PASSAGE = 64

#: Byte classes: 0 upper case, 1 lower case, 2 digits, 3 white space but line feeds,
#: 4 line feeds, 5 bytes of non-ASCII characters, 6 control, 7 on: each ASCII mark.
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 5
_CLASS[_IS_SPACE] = 3
_CLASS[10] = 4
_MARKS = [b for b in range(33, 127) if _CLASS[b] == 6]
_CLASS[_MARKS] = np.arange(7, 7 + len(_MARKS))
N_CLASSES = 7 + len(_MARKS)
N_FEATURES = N_CLASSES + 8


def passages(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (passages x N_FEATURES) of a slice, and the first passage of each row
    (n + 1). A row without words has one passage of zeros."""
    starts, ends, first = word_bounds(offs, data)
    n_words = np.diff(first)
    n = np.maximum(-(-n_words // PASSAGE), 1)
    at = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(at[-1]) - at[row]
    lo = np.minimum(first[row] + step * PASSAGE, first[row + 1])
    hi = np.minimum(lo + PASSAGE, first[row + 1])
    out = np.zeros((at[-1], N_FEATURES), dtype=np.float32)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return out, at
    lo, hi = lo[some], hi[some]
    begin, end = starts[lo], ends[hi - 1]
    passage = np.zeros(len(data), dtype=np.int64)
    np.add.at(passage, begin, 1)
    passage = np.cumsum(passage) - 1
    inside = passage >= 0
    counts = np.bincount(passage[inside] * N_CLASSES + _CLASS[data[inside]], minlength=len(some) * N_CLASSES)[: len(some) * N_CLASSES].reshape(-1, N_CLASSES)
    size = np.maximum(counts.sum(1), 1)
    out[some, :N_CLASSES] = np.sqrt(counts / size[:, None])
    lengths = (ends - starts).astype(np.float64)
    words = hi - lo
    sums = lambda x: np.add.reduceat(x, lo)  # noqa: E731  passages follow each other without gaps
    hashes = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(some)), words)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    mean = sums(lengths) / words
    first_byte, last_byte = _CLASS[data[starts]], _CLASS[data[ends - 1]]
    extra = [
        np.log1p(mean) / 3,
        np.sqrt(np.clip(sums(lengths**2) / words - mean**2, 0, None)) / 8,
        np.bincount(owner[order][fresh], minlength=len(some)) / words,
        words / PASSAGE,
        sums((first_byte == 0).astype(float)) / words,
        sums((last_byte >= 7).astype(float)) / words,
        sums((first_byte >= 7).astype(float)) / words,
        sums((lengths > 20).astype(float)) / words,
    ]
    out[some, N_CLASSES:] = np.column_stack(extra)
    return out, at


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.parts, np.repeat(np.arange(len(at) - 1), np.diff(at))
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, at[:-1])[bag])
        a = e / np.add.reduceat(e, at[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, at[:-1])
        s = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s, "bag": bag}

    def documents(self, offs: np.ndarray, data: np.ndarray) -> np.ndarray:
        x, at = passages(offs, data)
        return self.forward(x.astype(np.float64), at)["s"]


def _gradient(p: dict[str, np.ndarray], f: dict[str, np.ndarray], at: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
    """Of the log loss, by back-propagation; error: weighted score less label of each bag."""
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    dz = error[:, None] * p["o"]
    along = (h * dz[bag]).sum(1)
    de = a * (along - np.add.reduceat(a * along, at[:-1])[bag])
    dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"o": f["z"].T @ error, "b": error.sum(keepdims=True), "w": (t * g).T @ de, "V": h.T @ dt, "U": h.T @ dg, "W": f["x"].T @ dh, "c": dh.sum(0)}


def fit(sample: list[tuple[str, int]], *, hidden: int = 24, gates: int = 12, epochs: int = 30, batch: int = 64, seed: int = 3, decay: float = 1e-4) -> Model:
    rng = np.random.default_rng(seed)
    shapes = {"W": (N_FEATURES, hidden), "c": (hidden,), "V": (hidden, gates), "U": (hidden, gates), "w": (gates,), "o": (hidden,), "b": (1,)}
    parts = {k: rng.normal(size=s) / np.sqrt(s[0]) * (k not in "bc") for k, s in shapes.items()}
    bags: list[np.ndarray] = []
    for _, _, offs, data in text_slices(pa.array([t for t, _ in sample], pa.large_string())):
        x, at = passages(offs, data)
        bags += [x[a:b].astype(np.float64) for a, b in zip(at[:-1], at[1:])]
    y = np.array([v for _, v in sample], dtype=np.float64)
    if not len(bags) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        parts["o"][:] = 0
        parts["b"][:] = np.log(share / (1 - share))
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), parts)
    every = np.concatenate(bags)
    model = Model(every.mean(0), np.maximum(every.std(0), 0.02), parts)
    first, second = ({k: np.zeros_like(v) for k, v in parts.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for lo in range(0, len(order), batch):
            picked = order[lo : lo + batch]
            x = np.concatenate([bags[i] for i in picked])
            at = np.concatenate(([0], np.cumsum([len(bags[i]) for i in picked])))
            f = model.forward(x, at)
            grads = _gradient(parts, f, at, (f["s"] - y[picked]) / len(picked))
            step += 1
            for k, v in parts.items():
                d = grads[k] + decay * v
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                v -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


SCORE = "__quality_score"


def _scored(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, sample: int) -> DataFrame:
    """`docs` with the score of each text in one more column."""
    fitted = fit(labelled_sample(docs, labels, label, split_of(F.col("doc_id"), mod) != held_out, sample))
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, offs, data in text_slices(string_column(b, "text")):
                yield b.slice(lo, hi - lo).append_column(SCORE, pa.array(model.value.documents(offs, data)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", mod: int = 5, held_out: int = 0, threshold: float = 0.3, sample: int = 4000) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 if score
    >= threshold).

    Fitted on about `sample` labelled documents (twice as many at most), never on those
    whose crc32(doc_id as text) mod `mod` is `held_out`. Scores come from the text alone,
    all of its passages.

    Null and empty texts and those without words have one passage of zeros. Null doc_ids
    are not held out. Without labels, or with labels of one kind, every score is the
    same. Repeated rows stay; an empty table gives no rows.
    """
    scored = _scored(docs.select("doc_id", "text"), labels, label, mod, held_out, sample)
    held = F.coalesce(split_of(F.col("doc_id"), mod) == held_out, F.lit(False))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, label: str = "quality", mod: int = 5, held_out: int = 0, threshold: float = 0.3, sample: int = 4000) -> DataFrame:
    """The rows of `docs`, all columns, whose score is not below the threshold."""
    scored = _scored(docs, labels, label, mod, held_out, sample)
    return scored.where(F.col(SCORE) >= threshold).drop(SCORE)
