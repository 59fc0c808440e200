"""Token counts of a document's sections, from one encoding of the whole document.

The ids' byte lengths give every token's span of bytes, and so of characters, without
encoding a section on its own. Sections and tokens are both sorted, so the interval
join is two binary searches per section; only a section's first and last token can
cross its boundary, and `rule` says who gets them:

first     the section that holds the token's first character
last      the section that holds the token's last character
majority  the section that holds more than half of its characters; at exactly half,
          the one that holds its first character
split     each section, in proportion to the characters it holds
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import string_column
from .tokenizer import default_path, encoder, text_groups

RULES = ("first", "last", "majority", "split")
SCHEMA = "doc_id long, section int, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"


def char_spans(raw: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of consecutive tokens with these byte lengths. A token that holds
    only a part of a character spans that character."""
    ends = np.cumsum(n_bytes)
    starts = ends - n_bytes
    chars = np.cumsum((raw & 0xC0) != 0x80)
    return chars[starts] - 1, chars[ends - 1]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of a text's lines, each with its line feed."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    if len(codes) and (not len(ends) or ends[-1] < len(codes)):
        ends = np.append(ends, len(codes))
    return np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends


def allocate(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [lo, hi) under the rule, and tokens that cross its bounds.
    starts and ends: the tokens' spans, both ascending."""
    n = len(starts)
    a = np.searchsorted(ends, lo, side="right")
    b = np.maximum(np.searchsorted(starts, hi, side="left"), a)
    b = np.where(hi > lo, b, a)
    left = np.where(b > a, starts[np.minimum(a, n - 1)] < lo, False) if n else np.zeros(len(lo), bool)
    right = np.where(b > a, ends[np.minimum(np.maximum(b - 1, 0), n - 1)] > hi, False) if n else left
    crossing = left.astype(np.int64) + (right & ~(left & (b - a == 1)))
    if rule == "first":
        return (np.searchsorted(starts, np.maximum(hi, lo)) - np.searchsorted(starts, lo)).astype(float), crossing
    if rule == "last":
        return (np.searchsorted(ends, np.maximum(hi, lo), side="right") - np.searchsorted(ends, lo, side="right")).astype(float), crossing
    total = (b - a).astype(float)
    for at, which in ((a, left), (b - 1, right & ~(left & (b - a == 1)))):
        rows = np.flatnonzero(which)
        k = at[rows]
        size = ends[k] - starts[k]
        inside = np.minimum(ends[k], hi[rows]) - np.maximum(starts[k], lo[rows])
        share = inside / size
        if rule == "majority":
            share = ((2 * inside > size) | ((2 * inside == size) & (starts[k] >= lo[rows]))).astype(float)
        np.add.at(total, rows, share - 1)
    return total, crossing


def token_counts(docs: DataFrame, *, rule: str = "first", sections: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section (from 0), start_char, end_char,
    n_tokens, n_crossing (tokens over its bounds), doc_tokens.

    sections: a column array<struct<start, end>> of character spans, which may overlap,
    come in any order or leave gaps; without it, the text's lines. Spans are clipped to
    the text; null spans and those without characters get no tokens.

    Null and empty texts have no lines and so give no row, or rows of 0 tokens where
    spans are given. Very long texts are encoded whole. Null and repeated doc_ids are
    kept, each row by itself; an empty table gives no rows. Only the named columns are
    read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}: {rule}")
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            given = batch.column(2).to_pylist() if sections else None
            for first, texts in text_groups(string_column(batch, "text")):
                ids, at = enc.encode(texts)
                out: list[list] = [[] for _ in range(7)]
                for k, text in enumerate(texts):
                    raw = np.frombuffer(text.encode(), dtype=np.uint8)
                    starts, ends = char_spans(raw, enc.n_bytes[ids[at[k] : at[k + 1]]]) if len(raw) else (np.zeros(0, np.int64),) * 2
                    if given is None:
                        lo, hi = line_sections(text)
                    else:
                        spans = [((s or {}).get("start") or 0, (s or {}).get("end") or 0) for s in given[first + k] or ()]
                        lo, hi = np.clip(np.array(spans, dtype=np.int64).reshape(-1, 2).T, 0, len(text))
                    total, crossing = allocate(starts, ends, lo, hi, rule)
                    m = len(lo)
                    for column, values in zip(out, ([doc_ids[first + k]] * m, range(m), lo.tolist(), hi.tolist(), total.tolist(), crossing.tolist(), [len(starts)] * m)):
                        column.extend(values)
                if out[0]:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    if sections:
        columns.append(F.transform(F.col(sections), lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("sections"))
    return docs.select(*columns).mapInArrow(run, SCHEMA)
