"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int, seed: int = 11) -> list[tuple[str, int]]:
    """(text, label) of about `most` labelled documents, and at most twice as many: all
    of them, or the first ones by a hash of the id, wherever the rows lie. Only the ids
    and labels are sampled and broadcast. A null label or id takes no part, and a null
    text counts as empty; of a repeated doc_id one text, by its hash, takes part."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where("label in (0, 1) and doc_id is not null").where(keep).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = rows.count()
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(most / total * (1 << 30)))
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(2 * most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).toPandas()
    found = found.sort_values(["doc_id", "text"], kind="stable")
    return list(zip(found["text"].tolist(), found["label"].astype(int).tolist()))
