"""Order-preserving packing of token streams by dynamic programming.

The documents of one partition form a stream, in their order. Candidate cuts lie at
document ends, sentence ends and, where neither comes for `gap` tokens, at fixed steps.
Over the candidates j the cost is

    best[j] = min over i of best[i] + padding(P[j] - P[i]) + penalty[j]

with P the token position and P[j] - P[i] at most the window. Padding is the window
less the length, so best[i] + P[i] is what has to be least over a sliding range of i:
a monotone queue keeps it in constant time. Lengths that are a power of two need no
padding; they are looked up directly. Blocks of the stream are solved in turn, the
last open window of a block starting the next one, so memory stays bounded.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .batches import string_column
from .tokenizer import default_path, encoder, text_groups

END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Packing:
    """window: tokens of a sequence. penalties: what a cut inside a document costs, in
    padding tokens, at a sentence end and elsewhere. gap: the longest stretch without a
    candidate cut. block: tokens solved at a time. least_power: the shortest length that
    may stay unpadded inside a stream (its last window may be split further)."""

    window: int = 2048
    sentence_penalty: float = 4.0
    hard_penalty: float = 64.0
    gap: int = 128
    block: int = 1 << 20
    least_power: int = 512


def candidates(p: Packing, doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from 0 to total) where a cut may lie, and each cut's penalty."""
    kind = np.zeros(total + 1, dtype=np.uint8)
    kind[sentence_ends] = 1
    kind[doc_ends] = 2
    kind[0] = kind[total] = 2
    natural = np.flatnonzero(kind)
    span = np.diff(natural)
    extra = np.where(span > p.gap, (span - 1) // p.gap, 0)
    if extra.sum():
        base = np.repeat(natural[:-1], extra)
        step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        kind[base + step * p.gap] = 3
    positions = np.flatnonzero(kind)
    return positions, np.array([0.0, p.sentence_penalty, 0.0, p.hard_penalty])[kind[positions]]


def least_cost_cuts(p: Packing, positions: np.ndarray, cost: np.ndarray, last: bool) -> list[int]:
    """The cuts chosen, from 0 on. Not last: ends with the cheapest cut among those from
    which the block's end can be reached in one window."""
    at, pay = positions.tolist(), cost.tolist()
    powers = [1 << k for k in range(p.window.bit_length()) if p.least_power <= 1 << k < p.window]
    index = {x: i for i, x in enumerate(at)}
    best, came = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    window = p.window
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        value += window - here
        for size in powers:
            k = index.get(here - size)
            if k is not None and best[k] < value:
                value, i = best[k], k
        value += pay[j]
        best[j], came[j] = value, i
        key = value + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = len(at) - 1
    if not last:
        first = int(np.searchsorted(positions, at[-1] - window, side="left"))
        j = min(range(max(first, 1), len(at)), key=lambda k: best[k] + at[k])
    cuts = [at[j]]
    while j:
        j = came[j]
        cuts.append(at[j])
    return cuts[::-1]


def split_tail(p: Packing, length: int) -> list[int]:
    """Lengths of the sequences for the last window: powers of two where the cuts cost
    less than the padding."""
    bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return bits if (len(bits) - 1) * p.hard_penalty < p.window - length else [length]


class _Stream:
    def __init__(self, p: Packing, ends_sentence: np.ndarray, first_sequence: int):
        self.p, self.ends_sentence, self.sequence = p, ends_sentence, first_sequence
        self.docs: list[tuple[int | None, int, int]] = []  # id, ids before this part, all ids
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids)))
        self.parts.append(ids)
        self.size += len(ids)

    def solve(self, last: bool) -> pa.RecordBatch | None:
        if not self.size:
            return None
        p, ids = self.p, np.concatenate(self.parts)
        lengths = np.array([len(x) for x in self.parts], dtype=np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        sentences = np.flatnonzero(self.ends_sentence[ids]) + 1
        cuts = least_cost_cuts(p, *candidates(p, ends, sentences, self.size), last)
        if last:
            cuts[-1:] = (cuts[-2] + np.cumsum(split_tail(p, cuts[-1] - cuts[-2]))).tolist()
        cut = np.array(cuts, dtype=np.int64)
        stop = int(cut[-1])
        start = np.union1d(cut[:-1], begins[begins < stop])
        length = np.diff(np.append(start, stop))
        doc = np.searchsorted(begins, start, side="right") - 1
        window = np.searchsorted(cut, start, side="right") - 1
        before = np.array([b for _, b, _ in self.docs], dtype=np.int64)
        raw = ids.astype("<u4").tobytes()
        out = pa.record_batch(
            [
                pa.array([self.docs[d][0] for d in doc], pa.int64()),
                pa.array(before[doc] + start - begins[doc]),
                pa.array(length),
                pa.array([zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(start.tolist(), length.tolist())], pa.int64()),
                pa.array(np.array([n for _, _, n in self.docs], dtype=np.int64)[doc]),
                pa.array(self.sequence + window),
                pa.array(start - cut[window]),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )
        self.sequence += len(cut) - 1
        keep = int(np.searchsorted(ends, stop, side="right"))
        if keep < len(self.docs):
            doc_id, done, n = self.docs[keep]
            taken = max(0, stop - int(begins[keep]))
            self.docs = [(doc_id, done + taken, n), *self.docs[keep + 1 :]]
            self.parts = [self.parts[keep][taken:], *self.parts[keep + 1 :]]
        else:
            self.docs, self.parts = [], []
        self.size -= stop
        return out


def pack(docs: DataFrame, *, packing: Packing = Packing(), vocabulary: str | None = None) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most `window` tokens.

    One row per piece: doc_id, start (ids of the document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset. A document's ids are its text's, then END_ID. Each
    partition is a stream of its own in its own order, without a shuffle; its number
    leads its sequence ids.

    Null texts count as empty and give the one id END_ID. Null and repeated doc_ids are
    kept: each row is a document. Very long texts are cut over many windows. An empty
    table gives no rows. Only doc_id and text are read, so other columns can't clash.
    """
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        stream = _Stream(packing, enc.ends_sentence, TaskContext.get().partitionId() << 32)
        end = np.array([END_ID], dtype=np.uint32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in text_groups(string_column(batch, "text")):
                ids, at = enc.encode(texts)
                for k in range(len(texts)):
                    stream.add(doc_ids[first + k], np.concatenate((ids[at[k] : at[k + 1]], end)))
                    if stream.size >= packing.block and (out := stream.solve(False)) is not None:
                        yield out
        if (out := stream.solve(True)) is not None:
            yield out

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
