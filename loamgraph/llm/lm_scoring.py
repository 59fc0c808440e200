"""Log-likelihood of whole documents under a gated recurrent language model.

The output softmax is factored by classes. Its units are the most frequent words, one
each, the end, and one for all other words of each ending (their last two bytes), so any
unseen word has a unit too. The units, by frequency, are cut into classes of about the
same share of all tokens. A GRU, fed with the unit before, gives from its state the
distribution of the next unit's class and, by weights of each unit, the distribution of
the units within that class. A word that shares its unit with others has in it its share
of the training count with one added, one more word standing for all unseen ones. Counts
come from all training tokens.

Training is by truncated back-propagation in numpy. A first model is fitted to a few
documents; then every partition goes on from it over all of its training documents, and
the weights are averaged by tokens. So the score of a text depends a little on how the
training rows are dealt out to partitions; for the same layout it is the same. Scoring
runs documents side by side in lanes, window by window; a lane's state is carried from
window to window and reset at a document's start, so the likelihood is that of the
complete document.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, batch_bytes
from .batches import SLICE_BYTES, lower_ascii, string_column, text_slices, word_bounds, word_hashes
from .labelled import split_of

#: Bytes of texts that are dealt out to lanes together, about: enough for many lanes beside
#: a long document, since the steps of a window cost much the same for a few lanes.
GROUP_BYTES = 16 << 20

#: Bytes of an Arrow batch of texts, about. The JVM's direct memory holds a batch several
#: times over, for each task.
BATCH_BYTES = 4 << 20

#: Rows of word counts that a task holds before it passes them on.
HELD_WORDS = 1 << 18


@dataclass(frozen=True)
class Settings:
    """words: units of one word. endings: units of one ending. classes: of units, about.
    hidden: state size. window: steps of truncated back-propagation. lanes: documents
    side by side. first_docs: documents of the first model, at most; all training
    documents follow. frequent: a word is looked up in a broadcast table if its share of
    the training tokens is at least 1 / frequent, which at most `frequent` words can
    have; others are joined. The result is the same."""

    words: int = 960
    endings: int = 62
    classes: int = 32
    hidden: int = 16
    window: int = 32
    lanes: int = 256
    first_docs: int = 400
    first_epochs: int = 4
    frequent: int = 1 << 20
    seed: int = 9

    @property
    def units(self) -> int:
        """0: the end; then words; then endings; the last: all other endings."""
        return self.words + self.endings + 2


def classes_of(weight: np.ndarray, most: int) -> np.ndarray:
    """For each unit its class. The units, by falling weight, are cut into runs of about
    the same total weight."""
    order = np.lexsort((np.arange(len(weight)), -weight))
    before = np.cumsum(weight[order]) - weight[order]
    out = np.empty(len(weight), dtype=np.int64)
    out[order] = np.minimum(before / weight.sum() * most, most - 1).astype(np.int64)
    return np.unique(out, return_inverse=True)[1]


class Gru:
    """weights: A (unit -> gates), U (state -> gates), c; O (state -> classes), d; Q (unit
    -> its weights on the state), e. class_of: each unit's class."""

    def __init__(self, s: Settings, class_of: np.ndarray, weights: dict[str, np.ndarray] | None = None, dtype=np.float32):
        rng, h, n, m = np.random.default_rng(s.seed), s.hidden, len(class_of), int(class_of.max()) + 1
        shapes = {"A": (n, 3 * h), "U": (h, 3 * h), "c": (3 * h,), "O": (h, m), "d": (m,), "Q": (n, h), "e": (n,)}
        self.s, self.shapes, self.dtype, self.class_of = s, shapes, dtype, class_of.astype(np.uint16)
        self.w = weights or {k: (rng.normal(size=v) * (0.3 if len(v) == 2 else 0)).astype(dtype) for k, v in shapes.items()}
        self.first = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.step = 0
        self.by_class = np.argsort(class_of, kind="stable")
        self.members = np.split(self.by_class, np.cumsum(np.bincount(class_of, minlength=m))[:-1])
        self.place = np.empty(n, dtype=np.int64)
        for units in self.members:
            self.place[units] = np.arange(len(units))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.shapes]).astype(np.float64)

    @classmethod
    def of(cls, s: Settings, class_of: np.ndarray, flat: np.ndarray) -> Gru:
        out, at = cls(s, class_of), 0
        for k, shape in out.shapes.items():
            size = int(np.prod(shape))
            out.w[k] = flat[at : at + size].reshape(shape).astype(out.dtype)
            at += size
        return out

    def start_from(self, weight: np.ndarray) -> None:
        """Biases that give each unit its share of the weight."""
        by_class = np.bincount(self.class_of, weights=weight)
        self.w["d"] = np.log(by_class / by_class.sum()).astype(self.dtype)
        self.w["e"] = np.log(weight / by_class[self.class_of]).astype(self.dtype)

    def states(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False):
        """inputs, fresh (steps x lanes): unit before, and 0 where a document starts.
        The states after each step, the gates z, r and n, and with `keep` the states
        before each step and what r was multiplied with. Each gate has an array of its
        own, (steps, lanes, hidden), so that a step works on whole blocks of memory."""
        h, (steps, lanes) = self.s.hidden, inputs.shape
        gates = np.take(_apart(self.w["A"] + self.w["c"], h), inputs, axis=1)
        u = _apart(self.w["U"], h)
        after = np.empty((steps, lanes, h), dtype=self.dtype)
        kept = np.empty((2, steps, lanes, h), dtype=self.dtype) if keep else None
        state, back = state.astype(self.dtype), np.empty((3, lanes, h), dtype=self.dtype)
        for t in range(steps):
            state[fresh[t] == 0] = 0
            np.matmul(state, u, out=back)
            if keep:
                kept[:, t] = state, back[2]
            zr, n = gates[:2, t], gates[2, t]
            zr += back[:2]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            back[2] *= zr[1]
            n += back[2]
            np.tanh(n, out=n)
            state -= n
            state *= zr[0]
            state += n
            after[t] = state
        return after, gates, kept

    def outputs(self, after: np.ndarray, targets: np.ndarray, used: np.ndarray | None = None):
        """Natural log-probability of each target unit (flat). With `used`, the weights
        of the targets in the loss: also its gradients, and those of the states. Rows are
        worked on by class; logits have a column for each row, so that sums over units
        add whole rows of memory."""
        w, wanted = self.w, self.class_of[targets]
        order = np.argsort(wanted, kind="stable")
        x, wanted, own = after.take(order, 0), wanted[order], self.place[targets[order]]
        rows, units = (np.searchsorted(c, np.arange(len(self.members) + 1)) for c in (wanted, self.class_of[self.by_class]))
        q, e = w["Q"][self.by_class], w["e"][self.by_class]
        used = None if used is None else used[order]
        logits = w["O"].T @ x.T
        logits += w["d"][:, None]
        log, g, down = _log_share(logits, wanted, used), None, None
        if used is not None:
            g = {"O": (logits @ x).T.copy(), "d": logits.sum(1), "Q": np.zeros_like(q), "e": np.zeros_like(e)}
            by_unit, down = {k: np.zeros_like(g[k]) for k in "Qe"}, logits.T @ w["O"].T
        for a, b, lo, hi in zip(rows[:-1], rows[1:], units[:-1], units[1:]):
            if a == b or hi - lo == 1:
                continue
            logits = q[lo:hi] @ x[a:b].T
            logits += e[lo:hi, None]
            log[a:b] += _log_share(logits, own[a:b], None if used is None else used[a:b])
            if used is not None:
                by_unit["Q"][lo:hi], by_unit["e"][lo:hi] = logits @ x[a:b], logits.sum(1)
                down[a:b] += logits.T @ q[lo:hi]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        if used is not None:
            for k, v in by_unit.items():
                g[k][self.by_class] = v
            down = down.take(back, 0)
        return log[back], g, down

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, used: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probability of each used target of a window (0 elsewhere), and the
        state after it."""
        after, _, _ = self.states(inputs, fresh, state)
        log, some = np.zeros(inputs.size, dtype=self.dtype), np.flatnonzero(used)
        log[some] = self.outputs(after.reshape(-1, self.s.hidden)[some], targets.ravel()[some])[0]
        return log.reshape(inputs.shape), after[-1]

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, used: np.ndarray, fresh: np.ndarray, state: np.ndarray):
        """Mean loss of a window, its gradients and the state after it."""
        h, (steps, lanes) = self.s.hidden, inputs.shape
        after, (z, r, n), (before, u) = self.states(inputs, fresh, state, keep=True)
        weight = (used.ravel() / max(used.sum(), 1)).astype(self.dtype)
        log, g, down = self.outputs(after.reshape(-1, h), targets.ravel(), weight)
        down = down.reshape(steps, lanes, h)
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), u * r * (1 - r)
        gates = np.empty((4, steps, lanes, h), dtype=self.dtype)  # of z, r, n, and n's times r
        back = _apart(self.w["U"], h).transpose(0, 2, 1).copy()
        later = np.zeros((lanes, h), dtype=self.dtype)
        for t in range(steps - 1, -1, -1):
            d, (dz, dr, dn, du) = down[t], gates[:, t]
            d += later
            np.multiply(d, to_z[t], out=dz)
            np.multiply(d, to_n[t], out=dn)
            np.multiply(dn, to_r[t], out=dr)
            np.multiply(dn, r[t], out=du)
            np.multiply(d, z[t], out=later)
            for x, given in zip((dz, dr, du), back):
                later += x @ given
            later[fresh[t] == 0] = 0
        flat, before = gates.reshape(4, -1, h), before.reshape(-1, h)
        g["U"] = np.concatenate([before.T @ flat[k] for k in (0, 1, 3)], axis=1)
        order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")
        found = inputs.ravel()[order]
        at = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        g["A"] = np.zeros_like(self.w["A"])
        for k in range(3):
            g["A"][found[at], k * h : (k + 1) * h] = np.add.reduceat(flat[k].take(order, 0), at, axis=0)
        g["c"] = g["A"].sum(0)
        return -float(log @ weight), g, after[-1]

    def train(self, inputs: np.ndarray, targets: np.ndarray, used: np.ndarray, fresh: np.ndarray, state: np.ndarray, rate: float) -> np.ndarray:
        """One step of Adam on a window; returns the state after it."""
        _, g, state = self.gradients(inputs, targets, used, fresh, state)
        self.step += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * self.dtype(min(1.0, 1.0 / max(norm, 1e-9)))
            first, second = self.first[k], self.second[k]
            first += self.dtype(0.1) * (x - first)
            second += self.dtype(0.01) * (x * x - second)
            self.w[k] -= self.dtype(rate / (1 - 0.9**self.step)) * first / (np.sqrt(second) * self.dtype(1 / np.sqrt(1 - 0.99**self.step)) + self.dtype(1e-8))
        return state


def _apart(gates: np.ndarray, h: int) -> np.ndarray:
    """(n, 3 * h) as (3, n, h): the weights of each gate in an array of their own."""
    return np.ascontiguousarray(gates.reshape(-1, 3, h).transpose(1, 0, 2))


def _log_share(logits: np.ndarray, picked: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The log of the softmax at one place of each column. With weights of the columns,
    `logits` becomes the gradient of the weighted sum of -log."""
    logits -= logits.max(0)
    columns = np.arange(logits.shape[1])
    own = logits[picked, columns]
    np.exp(logits, out=logits)
    total = logits.sum(0)
    if weight is not None:
        logits *= weight / total
        logits[picked, columns] -= weight
    return own - np.log(total)


def lanes_of(lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """Documents dealt out to lanes of about the same length, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    n = max(min(most, len(lengths), int(lengths.sum() // max(lengths.max(), 1)) + 1), 1) if len(lengths) else 0
    loads, lanes = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for d in order:
        load, i = heapq.heappop(loads)
        lanes[i].append(int(d))
        heapq.heappush(loads, (load + int(lengths[d]), i))
    return [np.array(x) for x in lanes]


def windows(units: np.ndarray, at: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, ...]]:
    """(inputs, targets, used, fresh, document) of each window, steps x lanes, over all
    documents; at: where each one's units begin (n + 1)."""
    lengths = np.diff(at)
    lanes = lanes_of(lengths, s.lanes)
    if not lanes:
        return
    longest = max(int(lengths[x].sum()) for x in lanes)
    steps = -(-longest // s.window) * s.window
    targets = np.zeros((len(lanes), steps), dtype=np.uint16)
    document = np.full((len(lanes), steps), -1, dtype=np.int32)
    for i, docs in enumerate(lanes):
        n = 0
        for d in docs:
            m = int(lengths[d])
            targets[i, n : n + m] = units[at[d] : at[d + 1]]
            document[i, n : n + m] = d
            n += m
    last, owner = np.zeros(len(lanes), dtype=np.intp), np.full(len(lanes), -2)
    for lo in range(0, steps, s.window):
        target = targets[:, lo : lo + s.window].T.astype(np.intp)
        own = document[:, lo : lo + s.window].T
        begins = np.vstack((own[:1] != owner, own[1:] != own[:-1]))
        inputs = np.vstack((last, target[:-1]))
        inputs[begins] = 0
        last, owner = target[-1], own[-1]
        yield inputs, target, (own >= 0).astype(np.float32), (~begins).astype(np.float32), own


def run_training(gru: Gru, units: np.ndarray, at: np.ndarray, rate: float) -> None:
    state = None
    for inputs, targets, used, fresh, _ in windows(units, at, gru.s):
        if state is None:
            state = np.zeros((inputs.shape[1], gru.s.hidden), dtype=gru.dtype)
        state = gru.train(inputs, targets, used, fresh, state, rate)


def unit_scores(gru: Gru, units: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each document's units."""
    out, state = np.zeros(len(at) - 1), None
    for inputs, targets, used, fresh, document in windows(units, at, gru.s):
        if state is None:
            state = np.zeros((inputs.shape[1], gru.s.hidden), dtype=gru.dtype)
        log, state = gru.log_probabilities(inputs, targets, used, fresh, state)
        some = used > 0
        out += np.bincount(document[some], weights=log[some].astype(np.float64), minlength=len(out))
    return out


@dataclass
class Units:
    hashes: np.ndarray  # of the words with a unit of their own, ascending
    own: np.ndarray  # their units
    ending: np.ndarray  # unit of each last two bytes

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = self.ending[endings].astype(np.int32)
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[k] == hashes, self.own[k], out)
        return out


def _pieces(offs: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes and last two bytes of a slice's words, and each row's first word (n + 1).
    A slice of one long text comes in pieces that end at white space."""
    lo = 0
    while True:
        hi = len(data) if len(data) - lo <= 2 * SLICE_BYTES or len(offs) > 2 else _cut(data, lo)
        yield _piece(np.clip(offs - lo, 0, hi - lo), data[lo:hi])
        lo = hi
        if lo >= len(data):
            return


def _piece(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(offs, data)
    low = lower_ascii(data).astype(np.int32)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0) if len(starts) else starts
    last = low[ends - 1] if len(starts) else starts
    return word_hashes(data, starts, ends).view(np.int64), (before * 256 + last).astype(np.int32), first


def _words(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of a slice as one."""
    hashes, endings, first = zip(*_pieces(offs, data))
    return np.concatenate(hashes), np.concatenate(endings), sum(first)


def _cut(data: np.ndarray, lo: int) -> int:
    """The end of a piece of about SLICE_BYTES from `lo` that cuts no word."""
    at, step = lo + SLICE_BYTES, 4096
    while at < len(data):
        gap = np.flatnonzero(data[at : at + step] <= 0x20)
        gap = gap[(data[at + gap] == 0x20) | ((data[at + gap] >= 0x09) & (data[at + gap] <= 0x0D))]
        if len(gap):
            return at + int(gap[0]) + 1
        at += step
    return len(data)


def _with_ends(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units with a 0 after each document, and where each document begins."""
    at = first + np.arange(len(first))
    out, word = np.zeros(at[-1], dtype=np.uint16), np.ones(at[-1], dtype=bool)
    word[at[1:] - 1] = False
    out[word] = units
    return out, at


def _groups(texts: Iterable[pa.Array], units: Units, look: Callable | None = None) -> Iterator[tuple]:
    """(units with ends, where each row begins, sums, words) of groups of rows, across
    arrays, that make about GROUP_BYTES. `look` takes the hashes, units and first words of
    a piece, and gives sums for each row (sums x rows) and some of the words. A group
    holds two bytes a word besides those; all else is made and left by pieces."""
    held, size = [], 0
    for some in texts:
        for _, _, offs, data in text_slices(some):
            if held and size + len(data) > GROUP_BYTES:
                group, held = _joined(held), []
                yield group
                size = 0
            held.append(_read(offs, data, units, look))
            size += len(data)
    if held:
        group, held = _joined(held), []
        yield group


def _read(offs: np.ndarray, data: np.ndarray, units: Units, look: Callable | None) -> tuple[np.ndarray, ...]:
    own, first, sums, words = [], 0, 0.0, [np.zeros(0, np.int64)]
    for hashes, endings, begins in _pieces(offs, data):
        own.append(units.of(hashes, endings).astype(np.uint16))
        first = first + begins
        if look:
            more, some = look(hashes, own[-1], begins)
            sums = sums + more
            words.append(some)
    return *_with_ends(np.concatenate(own), first), np.atleast_2d(sums), np.concatenate(words)


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    units, begins, sums, words = zip(*parts)
    before = np.cumsum([0, *(x[-1] for x in begins)])
    at = np.concatenate([*(x[:-1] + n for x, n in zip(begins, before)), before[-1:]])
    return np.concatenate(units), at, np.concatenate(sums, axis=1), np.concatenate(words)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def summed() -> tuple:
        words, ending, n = (np.concatenate(x) for x in zip(*held))
        found, at, which = np.unique(words, return_index=True, return_inverse=True)
        return found, ending[at], np.bincount(which, weights=n, minlength=len(found)).astype(np.int64)

    for b in batches:
        for _, _, offs, data in text_slices(string_column(b, "text")):
            for hashes, endings, _ in _pieces(offs, data):
                found, at, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((found, endings[at], n))
                size += len(found)
                if size >= HELD_WORDS:
                    held = [summed()]
                    size = len(held[0][0])
                    if size >= HELD_WORDS // 2:
                        yield pa.record_batch([pa.array(x) for x in held[0]], names=["word", "ending", "n"])
                        held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(x) for x in summed()], names=["word", "ending", "n"])


@dataclass
class Model:
    """flat: the network's weights. known: words looked up, and the log10 of their counts
    and one. log_size: of each shared unit. words: all training words with their counts.
    n_tokens, n_distinct, n_docs: of the training documents, ends counted."""

    flat: np.ndarray
    units: Units
    class_of: np.ndarray
    known: tuple[np.ndarray, np.ndarray]
    log_size: np.ndarray
    words: DataFrame
    n_tokens: int
    n_distinct: int
    n_docs: int


def fit(training: DataFrame, s: Settings, scratch: Scratch) -> Model:
    """Counts and network from the doc_id and text of the training documents."""
    spark = training.sparkSession
    counted = training.select("text").mapInArrow(_counted, "word long, ending int, n long")
    with batch_bytes(spark, BATCH_BYTES):
        words = scratch.write(counted.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")))
    ends = training.count()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_distinct = total["n"] + ends, total["v"] + (1 if ends else 0)
    top = words.orderBy(F.desc("n"), "word").limit(s.words).collect()
    rest = words.join(F.broadcast(spark.createDataFrame([(r["word"],) for r in top], "word long")), "word", "left_anti")
    endings = rest.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # 65,536 at most
    endings.sort(key=lambda r: (-r["n"], r["ending"]))
    table = np.full(1 << 16, s.units - 1, dtype=np.int32)
    size = np.ones(s.units)  # of shared units: count and distinct words, and one
    weight = np.ones(s.units)
    weight[0] += ends
    weight[1 : 1 + len(top)] += [r["n"] for r in top]
    for i, r in enumerate(endings):
        k = 1 + s.words + i if i < s.endings else s.units - 1
        table[r["ending"]] = k
        size[k] += r["n"] + r["v"]
        weight[k] += r["n"]
    order = np.argsort([r["word"] for r in top]) if top else np.zeros(0, np.int64)
    units = Units(np.array([r["word"] for r in top], dtype=np.int64)[order], (1 + order).astype(np.int32), table)
    class_of = classes_of(weight, s.classes)

    # Words with a unit of their own are looked up as well, so rare ones never have one.
    common = {r["word"]: r["n"] for r in top} | {r["word"]: r["n"] for r in words.where(F.col("n") * s.frequent >= n_tokens).select("word", "n").toLocalIterator()}
    seen = np.array(sorted(common), dtype=np.int64)
    known = seen, np.log10(np.array([common[w] for w in seen.tolist()], dtype=np.float64) + 1)

    # In the order of a hash, so that the same rows are taken wherever they lie.
    picked = F.xxhash64(F.lit(s.seed), "doc_id", "text")
    few = training.select(picked.alias("picked"), F.coalesce("text", F.lit("")).alias("text"))
    if ends > 4 * s.first_docs:
        few = few.where(F.pmod("picked", F.lit(1 << 30)) <= int(2 * s.first_docs / ends * (1 << 30)))
    few = [r["text"] for r in few.orderBy("picked", "text").limit(s.first_docs).collect()]
    gru = Gru(s, class_of)
    gru.start_from(weight)
    series = [(c, at) for c, at, _, _ in _groups([pa.array(few, pa.large_string())], units)]
    for epoch in range(s.first_epochs):
        for c, at in series:
            run_training(gru, c, at, 0.02 * (1 - epoch / s.first_epochs) + 0.002)
    start = spark.sparkContext.broadcast((gru.flat(), units, class_of))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, un, classes = start.value
        own, seen = Gru.of(s, classes, flat), 0
        for c, at, _, _ in _groups((string_column(b, "text") for b in batches), un):
            run_training(own, c, at, 0.002)
            seen += len(c)
        if seen:
            w = own.flat()
            yield pa.record_batch([pa.array(np.arange(len(w))), pa.array(w * seen), pa.array(np.full(len(w), seen))], names=["at", "sum", "n"])

    learned = training.select("text").mapInArrow(learn, "at long, sum double, n long").groupBy("at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).orderBy("at")
    with batch_bytes(spark, BATCH_BYTES):
        learned = learned.collect()
    weights = np.array([r["sum"] / r["n"] for r in learned]) if learned else gru.flat()
    return Model(weights, units, class_of, known, np.log10(size), words, n_tokens, n_distinct, ends)


def lm_scores(docs: DataFrame, *, mod: int = 7, held_out: int = 2, settings: Settings = Settings()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Tokens are the words, A-Z lower-cased, then one end. The model and the counts learn
    from the documents whose crc32(doc_id as text) mod `mod` is not `held_out`; null
    doc_ids are among them. n_known: tokens that occur there; train_tokens: N, all
    tokens there. base_score sums log10((c + 1) / (N + V + 1)) over the tokens, score is
    the recurrent model's log10 probability of the whole text.

    Null and empty texts have the end as their one token. Very long texts are scored
    whole. Repeated rows stay, each with its result. Without training documents all
    words are unseen. An empty table gives no rows. Only doc_id and text are read.
    """
    spark, s = docs.sparkSession, settings
    scratch = Scratch(spark)
    held = F.coalesce(split_of(F.col("doc_id"), mod) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    fitted = fit(rows.where(~F.col("held_out")), s, scratch)
    model = spark.sparkContext.broadcast((fitted.flat, fitted.units, fitted.class_of, fitted.known, fitted.log_size))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, un, classes, (seen, value), sizes = model.value
        net, row = Gru.of(s, classes, flat), TaskContext.get().partitionId() << 33

        def look(hashes: np.ndarray, k: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = len(first) - 1
            owner = np.repeat(np.arange(n), np.diff(first))
            hit, log_n = np.zeros(len(hashes), bool), np.zeros(len(hashes))
            if len(seen):
                place = np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)
                hit = seen[place] == hashes
                log_n = np.where(hit, value[place], 0.0)
            within = np.where(k <= s.words, 0.0, log_n - sizes[k])
            return np.array([np.bincount(owner, weights=x, minlength=n) for x in (hit, log_n, within, ~hit)], dtype=float), hashes[~hit]

        ids: list[tuple] = []  # of the rows read whose group is still open

        def texts() -> Iterator[pa.Array]:
            for b in batches:
                ids.extend(zip(b.column(0).to_pylist(), b.column(2).to_pylist()))  # a slice would hold the batch
                yield string_column(b, "text")

        for c, at, (known, base, within, others), rare in _groups(texts(), un, look):
            n, rare_at = len(at) - 1, np.cumsum([0, *others]).astype(np.int32)
            doc_id, held_out = zip(*ids[:n])
            del ids[:n]
            yield pa.record_batch([
                pa.array(row + np.arange(n)), pa.array(doc_id, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(np.diff(at).astype(np.int64)),
                pa.array(known.astype(np.int64)), pa.array(base),
                pa.array(within + unit_scores(net, c, at) / np.log(10)), pa.ListArray.from_arrays(pa.array(rare_at), pa.array(rare)),
            ], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"])
            row += n

    scored = rows.select("doc_id", "text", "held_out").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>")
    with batch_bytes(spark, BATCH_BYTES):
        scored = scratch.write(scored)
    tail = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    tail = tail.join(fitted.words.select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("log_n"))
    out = scored.drop("rare").join(tail, "row", "left")
    more = F.coalesce("log_n", F.lit(0.0))
    end_log = float(np.log10(fitted.n_docs + 1))
    base = F.col("base") + more + F.lit(end_log) - F.col("n_tokens") * F.lit(float(np.log10(fitted.n_tokens + fitted.n_distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + (1 if fitted.n_docs else 0)).alias("n_known"),
        F.lit(fitted.n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + more).alias("score"),
    )
