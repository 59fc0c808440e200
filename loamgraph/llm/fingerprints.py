"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases: each is the shortest run of characters, from where the
last phrase ended, that is not in the dictionary yet, and joins it. The phrases are
hashed and the least hashes make the fingerprint. The likeness of two fingerprints is
the share of their common least hashes, an estimate of the Jaccard index of the phrase
sets, which falls as one text helps less to compress the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mix, string_column

KEPT = 128

_STEP = 0x9E3779B97F4A7C15


def parse(text: str, phrases: dict[str, None], open_phrase: str = "") -> str:
    """Adds the phrases of `text` in their order; returns the open phrase at its end."""
    p = open_phrase
    for c in text:
        p += c
        if p not in phrases:
            phrases[p] = None
            p = ""
    return p


def sketch(text: str, phrases: dict[str, None], kept: int = KEPT) -> np.ndarray:
    """The least 32-bit hashes of the phrases, ascending. The phrases follow each other
    in the text, so their polynomial hashes are differences of one running sum."""
    n = len(phrases)
    if not n:
        return np.zeros(0, dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, phrases), dtype=np.int64, count=n))
    codes = np.frombuffer(text[: ends[-1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    weight = np.full(len(codes) + 1, _STEP, dtype=np.uint64)
    weight[0] = 1
    np.cumprod(weight, out=weight)
    run = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * weight[:-1], out=run[1:])
    starts = np.concatenate(([0], ends[:-1]))
    back = np.full(len(codes) + 1, pow(_STEP, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    hashes = (mix((run[ends] - run[starts]) * back[starts]) >> np.uint64(32)).astype(np.uint32)
    hashes = np.unique(hashes)
    return hashes[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """1 for equal phrase sets, two empty ones among them; 0 for disjoint ones."""
    both = np.union1d(a, b)[:kept]
    if not len(both):
        return 1.0
    return float(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).size) / len(both)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprint(text: str | None, kept: int = KEPT) -> np.ndarray:
    phrases: dict[str, None] = {}
    parse(text or "", phrases)
    return sketch(text or "", phrases, kept)


def fingerprints(docs: DataFrame, *, kept: int = KEPT) -> DataFrame:
    """doc_id, text and fingerprint (hex of the sorted 32-bit hashes) of each row.
    Null texts count as empty and have the empty fingerprint; rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = string_column(b, "text").to_pylist()
            yield b.append_column("fingerprint", pa.array([as_text(fingerprint(t, kept)) for t in texts], pa.string()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, fingerprint string")


def _ranges(docs: DataFrame, parts: int) -> np.ndarray:
    """The greatest doc_id of each of about `parts` even ranges, descending: one number
    for each partition."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    tops = ids.repartitionByRange(parts, F.desc("doc_id")).groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("top"))
    return np.array(sorted({r["top"] for r in tops.collect()}, reverse=True), dtype=np.int64)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, *, kept: int = KEPT) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) characters replaced by as many (or
    all) from the start of the next document by descending doc_id, after the last the
    first. near_edited and near_next: likeness to the edited text and to that next
    document. Both texts share a parse up to the edit.

    The documents are dealt out by ranges of doc_id, one shuffle in all; the first
    document of each range is also sent to the range before it.

    Null texts count as empty: n_chars 0, empty fingerprints, likeness 1 to each other
    and 0 to any other text. Null doc_ids come last. Rows of one doc_id follow each
    other by text, so repeated rows stay, each the next of the other. A lone document is
    its own next one. An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    tops = _ranges(docs, parts)
    n = max(len(tops), 1)
    rising = -tops

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(rising, -known, side="right") - 1
            part = np.where(ids.is_null().to_numpy(zero_copy_only=False), n - 1, part).astype(np.int32)
            first = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False) & (tops[part] == known)) if len(tops) else np.arange(b.num_rows)
            yield b.append_column("part", pa.array(part)).append_column("guest", pa.array(np.zeros(b.num_rows, bool)))
            if len(first):
                guests = b.take(pa.array(first))
                before = ((part[first] - 1) % n).astype(np.int32)
                yield guests.append_column("part", pa.array(before)).append_column("guest", pa.array(np.ones(len(first), bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), string_column(b, "text").to_pylist(), b.column(3).to_pylist())

        out: list[tuple] = []
        held = None
        source = rows()
        for doc_id, text, guest in source:
            here = (doc_id, text)
            if held is not None:
                out.append(_described(held, here, kept))
                held = (doc_id, text, out[-1][-1])
                out[-1] = out[-1][:-1]
            elif not guest:
                held = (doc_id, text, None)
            if guest:
                break
            if len(out) >= 500:
                yield _batch(out)
                out = []
        for _ in source:
            pass
        if out:
            yield _batch(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, "doc_id long, text string, part int, guest boolean")
    rows = rows.repartitionById(n, "part").sortWithinPartitions("guest", F.desc_nulls_last("doc_id"), F.col("text").asc_nulls_first())
    return rows.mapInArrow(run, SCHEMA)


def _described(held: tuple, after: tuple, kept: int) -> tuple:
    """The result row of `held`, then the sketch of the text after it, for its own turn.
    held: doc_id, text and the text's sketch if it is known already."""
    doc_id, text, own = held
    half = len(text) // 2
    stem = text[: len(text) - half]
    edited = stem + after[1][:half]
    phrases: dict[str, None] = {}
    p = parse(stem, phrases)
    changed = phrases.copy()
    parse(edited[len(stem) :], changed, p)
    if own is None:
        parse(text[len(stem) :], phrases, p)
        own = sketch(text, phrases, kept)
    other = sketch(edited, changed, kept)
    nxt = own if after[1] == text else fingerprint(after[1], kept)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(own, other, kept), likeness(own, nxt, kept), nxt)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])
