"""The chunk table with vectors: metadata filters, exact cosine top-k, maintenance."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import json_text


#: Queries that are searched in one pass.
QUERY_BLOCK = 1024


def metadata_filter(conditions: Mapping[str, object] | None, value_of: Callable[[str], Column] | None = None) -> Column:
    """All conditions hold: a value (equals), {"ne": value} (or the key is missing), or
    {"in": [values]} (an empty list matches nothing). Other operators raise an error."""
    value_of = value_of or (lambda key: json_text(F.col("source_metadata"), key))

    def one(key: str, wanted: object) -> Column:
        value = value_of(key)
        if not isinstance(wanted, Mapping):
            return value == str(wanted)
        op, operand = next(iter(wanted.items()))
        if op == "ne":
            return F.coalesce(value != str(operand), F.lit(True))
        if op == "in":
            return value.isin([str(x) for x in operand]) if operand else F.lit(False)
        raise ValueError(f"unknown filter operator: {op}")

    return reduce(and_, (one(k, v) for k, v in (conditions or {}).items()), F.lit(True))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """NaN for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(float("nan")))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _ranked(found: DataFrame, k: int, tie: str) -> DataFrame:
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    return found.orderBy(F.desc_nulls_last(score), tie).limit(k)


def top_k(chunks: DataFrame, query: Column, k: int = 5, *, where: Mapping[str, object] | None = None, vector: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """The k chunks nearest to the query by cosine, after the filter. A zero vector comes
    last; ties go to the least `tie`. Spark keeps k rows of each partition only."""
    return _ranked(chunks.where(metadata_filter(where)).withColumn("score", cosine(F.col(vector), query)), k, tie)


def top_k_for_queries(chunks: DataFrame, queries: DataFrame, k: int = 5, *, query_id: str = "query_id", query_vector: str = "query_vector", vector: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """query_id, rank, `tie` and score of the k nearest chunks of each query. Queries are
    taken by blocks of QUERY_BLOCK, each of which is one broadcast matrix and one pass over
    the chunks; a task keeps the k best of each query only."""
    asked = sorted(((r[0], r[1]) for r in queries.select(query_id, query_vector).toLocalIterator()), key=lambda r: r[0])
    kinds = dict(queries.dtypes)[query_id], dict(chunks.dtypes)[tie]
    out = chunks.sparkSession.createDataFrame([], f"{query_id} {kinds[0]}, {tie} {kinds[1]}, score double")
    for lo in range(0, len(asked), QUERY_BLOCK):
        out = out.unionByName(_block_scores(chunks.select(tie, vector), asked[lo : lo + QUERY_BLOCK], k, query_id, tie, kinds))
    place = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc_nulls_last("score"), tie))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def _block_scores(chunks: DataFrame, asked: list[tuple], k: int, query_id: str, tie: str, kinds: tuple[str, str]) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    ids = [i for i, _ in asked]
    q = np.array([v for _, v in asked], dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
    matrix = chunks.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        best: list[list] = [[] for _ in ids]
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                names = part.column(0).to_pylist()
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = matrix.value @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                for i, s in enumerate(np.where(np.isnan(scores), -2.0, scores)):
                    least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                    best[i] = sorted([*best[i], *((-s[j], names[j]) for j in np.flatnonzero(s >= least))])[:k]
        rows = [(i, name, None if s == 2.0 else -s) for i, found in zip(ids, best) for s, name in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[query_id, tie, "score"])

    return chunks.mapInArrow(run, f"{query_id} {kinds[0]}, {tie} {kinds[1]}, score double")


def top_k_or_all(chunks: DataFrame, query: Column, k: int, where: Mapping[str, object], *, vector: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """top_k after the filter, or without it where no chunk passes it, in one pass: the k
    best of either kind are found, and the matching ones win if there are any."""
    scored = chunks.withColumn("score", cosine(F.col(vector), query)).withColumn("matches", F.coalesce(metadata_filter(where), F.lit(False)))
    both = _ranked(scored.where("matches"), k, tie).unionByName(_ranked(scored.where("not matches"), k, tie))
    both = both.withColumn("any_match", F.max("matches").over(W.partitionBy()))
    return _ranked(both.where("matches or not any_match"), k, tie).drop("matches", "any_match")


def ranked(found: DataFrame, tie: str = "chunk_id") -> DataFrame:
    """Adds the rank (from 1) of the few rows that a search has found."""
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last(score), tie)))


def first_k_of_documents(chunks: DataFrame, documents: DataFrame | None, k: int = 3) -> DataFrame:
    """Up to k chunks of each document in the order of chunk_index, with score 1."""
    rows = chunks if documents is None else chunks.join(documents.select("document_id"), "document_id", "left_semi")
    place = F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))
    return rows.where("document_id is not null").withColumn("place", place).where(F.col("place") <= k).drop("place").withColumn("score", F.lit(1.0))


def split_writes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the legacy table, rows of the chunk table): all records without their
    document, and those that have one. Provider and metadata get their defaults."""
    filled = records.withColumn("provider", F.coalesce("provider", F.lit("ollama"))).withColumn("source_metadata", F.coalesce("source_metadata", F.lit("{}")))
    return filled.drop("document_id"), filled.where("document_id is not null")


def as_records(chunks: DataFrame, *, call: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows as a store receives them: chunk_index is the position in its call, and the
    text is also kept in the metadata."""
    place = (F.row_number().over(W.partitionBy(*call).orderBy(*order)) - 1).cast("int")
    metadata = F.to_json(F.map_concat(F.coalesce(F.from_json("source_metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("chunk_text"), F.col("chunk_text"))))
    return chunks.withColumn("chunk_index", place).withColumn("source_metadata", metadata)


def chunks_of_ingestion(table: DataFrame, ingestion_id: str) -> DataFrame:
    """An ingestion's chunks in their order; the caller tells an unknown one by no rows."""
    if ingestion_id == "":
        raise ValueError("no ingestion_id")
    return table.where(F.col("ingestion_id") == ingestion_id).orderBy("chunk_index", "chunk_id")


def delete_ingestion(table: DataFrame, ingestion_id: str | Column) -> DataFrame:
    return table.where(~F.coalesce(F.col("ingestion_id") == ingestion_id, F.lit(False)))


def mock_embedding(text: Column) -> Column:
    n = F.length(text)
    return F.array(n.cast("float"), (n % 10).cast("float"), F.lit(1.0).cast("float"))


Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

_EMBEDDERS: dict[str, Embedder] = {"mock": lambda texts: [[float(len(t)), float(len(t) % 10), 1.0] for t in texts]}


def register_embedder(name: str, embed: Embedder) -> None:
    _EMBEDDERS[name] = embed


def embedder(name: str) -> Embedder:
    if name not in _EMBEDDERS:
        raise ValueError(f"unknown embedding provider: {name}")
    return _EMBEDDERS[name]


def embed_query(text: str, provider: str = "mock") -> list[float]:
    """The vector of one question; blank text, or none back, is an error."""
    if not text.strip():
        raise ValueError("empty query")
    found = list(embedder(provider)([text]))
    if not found:
        raise ValueError("the provider gave no vector")
    return list(map(float, found[0]))


def batched(call: Embedder, size: int = 32) -> Embedder:
    """An embedder that calls a remote one for `size` texts at a time. A call that gives
    another number of vectors than texts raises an error."""

    def run(texts: Sequence[str]) -> list[Sequence[float]]:
        out: list[Sequence[float]] = []
        for lo in range(0, len(texts), size):
            part = list(texts[lo : lo + size])
            got = list(call(part))
            if len(got) != len(part):
                raise ValueError(f"{len(got)} embeddings for {len(part)} texts")
            out.extend(got)
        return out

    return run


def embed(df: DataFrame, *, text: str, provider: str = "mock", out: str = "embedding") -> DataFrame:
    """Adds the vectors of a provider, a batch of texts at a time. A provider that gives
    another number of vectors than it got texts raises an error."""
    call = embedder(provider)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        vectors = list(call(texts.fillna("").tolist()))
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} embeddings for {len(texts)} chunks")
        return pd.Series([list(map(float, v)) for v in vectors])

    return df.withColumn(out, run(F.col(text)))
