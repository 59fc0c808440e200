"""Approximate nearest neighbours over several shifted Hilbert orderings.

Each ordering projects the vectors by its own random orthogonal map, shifts and
quantises them, and sorts them by their Hilbert key. A query looks at a window of each
ordering around its own key; what the windows hold is reranked by the exact measure and
merged.

Inner products are turned into distances first: with M the greatest norm, a vector x is
placed at (x / M, sqrt(1 - |x|^2 / M^2)) and a query q at (q / |q|, 0).

How many neighbours a window has to hold depends on the vectors: on clustered ones a few
dozen do, whatever the table's size; on ones without any structure a random direction
tells little of the nearest, and no fixed window keeps the recall as the table grows. So
the window is measured. A sample of vectors is searched by brute force over all rows; how
far apart each of them and each of its true neighbours lie, in the ordering where they
are nearest, gives the least window that finds the wanted share of these neighbours. All
rows are indexed and searched alike, at any size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import Scratch
from .batches import runs


@dataclass(frozen=True)
class Curves:
    """orderings, axes and bits: of the Hilbert keys (axes * bits <= 62). recall: share of
    the sample's true neighbours that the window has to hold. sample: vectors that the
    window is measured by; its cost grows with the table and not with its square.
    least_window: of neighbours in an ordering, where there are as many. block: vectors
    of a task's step, at most."""

    orderings: int = 16
    axes: int = 8
    bits: int = 7
    recall: float = 0.95
    sample: int = 256
    least_window: int = 48
    block: int = 4096
    seed: int = 5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (rows x axes).

    From the top bit down, the axes' bits name a sub-cube; reflecting the lower bits of
    the first axis, or exchanging them with another's, turns each sub-cube the way the
    curve runs through it. The Gray code of the turned bits is the position.
    """
    axis = [c.astype(np.uint64) for c in cells.T]
    n = len(axis)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            set_here = (axis[i] & bit) != 0
            swap = np.where(set_here, np.uint64(0), (axis[0] ^ axis[i]) & low)
            axis[0] = np.where(set_here, axis[0] ^ low, axis[0] ^ swap)
            if i:
                axis[i] = axis[i] ^ swap
    for i in range(1, n):
        axis[i] = axis[i] ^ axis[i - 1]
    flip = np.zeros_like(axis[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((axis[-1] & np.uint64(1 << b)) != 0, flip ^ np.uint64((1 << b) - 1), flip)
    key = np.zeros_like(axis[0])
    for b in range(bits - 1, -1, -1):
        for a in axis:
            key = (key << np.uint64(1)) | (((a ^ flip) >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _placed(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    norm2 = (x * x).sum(1, keepdims=True)
    if query:
        return np.hstack((x / np.sqrt(norm2), np.zeros((len(x), 1))))
    return np.hstack((x / most, np.sqrt(np.clip(1 - norm2 / (most * most), 0, None))))


def _maps(c: Curves, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for o in range(c.orderings):
        rng = np.random.default_rng((c.seed, o))
        q, _ = np.linalg.qr(rng.normal(size=(dim + 1, min(c.axes, dim + 1))))
        out.append((q, rng.uniform(-0.5, 0.5, q.shape[1])))
    return out


def _valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id and embedding (doubles, no negative zeros) of the rows that take part."""
    x = F.transform(F.col(column), lambda v: v.cast("double") + F.lit(0.0))
    if dict(vectors.dtypes)[column] == "array<float>":
        x = x.cast("array<float>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(finite).where(F.exists("embedding", lambda v: v != 0))


def nearest(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding", k: int = 20, query_every: int = 20, curves: Curves = Curves(), notes: dict | None = None) -> DataFrame:
    """The k vectors found nearest to each query by inner product in double precision:
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Queries are the rows whose id is divisible by `query_every`; candidates are all rows
    but those of the query's id. All rows are indexed. Vectors that are null, empty, zero
    or have null or non-finite components take no part, nor do null ids; of vectors of
    several lengths those of the most frequent (then the shorter) do. Equal vectors are
    indexed once with their k + 1 least ids, so copies can't fill a window. A repeated
    id counts once, by its best vector. An empty table, or one without queries, gives no
    rows. Only the two columns are read. `notes` gets the window and the number of vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = _valid(vectors, id_column, column)
    shape = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v)).alias("norm2"))
    shape = shape.orderBy(F.desc("n"), "dim").first()
    dim, most = (shape["dim"], float(np.sqrt(shape["norm2"]))) if shape else (1, 1.0)
    rows = rows.where(F.size("embedding") == dim).withColumn("node", F.xxhash64("embedding"))

    ids = rows.select("node", "vec_id").distinct()
    least = ids.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    least = scratch.write(least.select("node", "vec_id"))
    asking = scratch.write(ids.where(F.col("vec_id") % query_every == 0))
    nodes = rows.groupBy("node").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.max(F.col("vec_id") % query_every == 0).alias("asks"))
    nodes = scratch.write(nodes)
    found = _search(spark, scratch, nodes, dim, most, k, curves, {} if notes is None else notes)

    named = found.join(least, "node").groupBy("query_node", "vec_id").agg(F.max("score").alias("score"))
    named = named.withColumn("place", F.row_number().over(W.partitionBy("query_node").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    pairs = asking.select(F.col("node").alias("query_node"), F.col("vec_id").alias("query_id")).join(named.drop("place"), "query_node").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(spark, scratch: Scratch, nodes: DataFrame, dim: int, most: float, k: int, c: Curves, notes: dict) -> DataFrame:
    """(query_node, node, score): the k + 1 best nodes in each query's windows."""
    maps = _maps(c, dim)
    axes = np.hstack([q for q, _ in maps])
    width = maps[0][0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, 0.0, 0.0
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                x = _matrix(b.column(0)[lo : lo + 4096], dim)
                y = np.hstack((_placed(x, most, False) @ axes, _placed(x, most, True) @ axes))
                n, first, second = n + len(y), first + y.sum(0), second + (y * y).sum(0)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(first))), pa.array(np.full(len(first), n)), pa.array(first), pa.array(second)], names=["at", "n", "first", "second"])

    stats = nodes.select("embedding").mapInArrow(sums, "at long, n long, first double, second double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("first").alias("first"), F.sum("second").alias("second")).orderBy("at").collect()
    total = stats[0]["n"] if stats else 0
    # Vectors as candidates and as queries are each standardised on their own.
    mean = np.array([r["first"] / r["n"] for r in stats]).reshape(2, -1)
    spread = np.array([max(r["second"] / r["n"] - (r["first"] / r["n"]) ** 2, 1e-12) ** 0.5 for r in stats]).reshape(2, -1)
    picked = nodes.select("node", "embedding").orderBy(F.xxhash64(F.lit(c.seed), "node"), "node").limit(c.sample).collect()
    sample = np.array(sorted(r["node"] for r in picked), dtype=np.int64)
    examples = np.array([r["embedding"] for r in sorted(picked, key=lambda r: r["node"])], dtype=np.float64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x, node = _matrix(part.column(1), dim), part.column(0).to_numpy()
                kind = np.where(part.column(3).to_numpy(zero_copy_only=False), 1, np.where(np.isin(node, sample), 2, 0))
                for query in (0, 1):
                    rows = np.flatnonzero(kind) if query else np.arange(len(x))
                    y = (_placed(x[rows], most, bool(query)) @ axes - mean[query]) / spread[query]
                    for o, (_, shift) in enumerate(maps if len(rows) else ()):
                        z = y[:, o * width : (o + 1) * width] + shift
                        cells = np.clip((z + 4) / 8 * (1 << c.bits), 0, (1 << c.bits) - 1)
                        yield pa.record_batch(
                            [pa.array(np.full(len(rows), o, np.int32)), pa.array(hilbert_keys(cells, c.bits)), pa.array((kind[rows] * query).astype(np.int32)), part.column(0).take(pa.array(rows)), part.column(2).take(pa.array(rows))],
                            names=["ordering", "key", "query", "node", "first_id"],
                        )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, last = TaskContext.get().partitionId(), 0, -1
        for b in batches:
            ordering, query = b.column(0).to_numpy(), b.column(2).to_numpy() > 0
            place = np.empty(b.num_rows, dtype=np.int64)
            for o in np.unique(ordering):
                if o != last:
                    before, last = 0, o
                here = np.flatnonzero(ordering == o)
                count = np.cumsum(~query[here])
                place[here] = before + count - ~query[here]
                before += int(count[-1])
            yield pa.record_batch([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(place), *(b.column(i) for i in range(2, 5))], names=["ordering", "part", "place", "query", "node", "first_id"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["ordering", "key", "first_id", "node", "query"]
    keyed = nodes.select("node", "embedding", "first_id", "asks").mapInArrow(keys, "ordering int, key long, query int, node long, first_id long")
    placed = scratch.write(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(places, "ordering int, part int, place long, query int, node long, first_id long"))
    # A number for each partition and ordering: where it starts in the ordering.
    counts = placed.where("query = 0").groupBy("ordering", "part").agg(F.count("*").alias("n"))
    every = placed.select("ordering", "part").distinct().join(counts, ["ordering", "part"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = every.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("ordering").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = placed.join(F.broadcast(starts), ["ordering", "part"]).withColumn("place", F.col("place") + F.col("start")).drop("part", "start")

    window = _window(nodes, placed, sample, examples, dim, k, c, total)
    notes |= {"window": window, "orderings": c.orderings, "vectors": total}
    size = 1 << min(max(window, 256).bit_length(), c.block.bit_length() - 1)
    low = F.greatest(F.least(F.col("place") - window // 2, F.lit(total - window)), F.lit(0))
    high = F.least(low + window, F.lit(max(total, 1)))
    blocks = F.when(F.col("query") > 0, F.sequence(F.floor(low / size), F.floor((high - 1) / size))).otherwise(F.array(F.floor(F.col("place") / size)))
    dealt = placed.where("query < 2").select("ordering", F.explode(blocks).alias("block"), F.col("query") > 0, "place", low.alias("low"), high.alias("high"), "node", "first_id").toDF("ordering", "block", "query", "place", "low", "high", "node", "first_id")
    dealt = dealt.join(nodes.select("node", "embedding"), "node").select("ordering", "block", "query", "place", "low", "high", "node", "first_id", "embedding")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block: first its candidates by place, then the queries that see some."""
        at, held, seen = None, [], None
        for b in batches:
            for lo, hi, key in runs(b, 3):
                part = b.slice(lo, hi - lo)
                if key[:2] != at:
                    at, held, seen = key[:2], [], None
                if not key[2]:
                    held.append(part)
                    continue
                if seen is None:
                    block = pa.Table.from_batches(held)
                    seen = (_matrix(block.column("embedding").combine_chunks(), dim), *(block.column(n).to_numpy() for n in ("node", "first_id", "place")))
                for q in range(0, part.num_rows, 64):
                    yield _scored(part.slice(q, 64), *seen, dim, k + 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1):
            ids, first, scores = (table.column(i).combine_chunks().flatten().to_numpy() for i in (1, 2, 3))
            ids, at = np.unique(ids, return_index=True)
            picked = _best(scores[at], first[at], k + 1)
            yield pa.record_batch([pa.array(np.full(len(picked), table.column(0)[0].as_py())), pa.array(ids[picked]), pa.array(scores[at][picked])], names=["query_node", "node", "score"])

    hits = dealt.repartition(parts, "ordering", "block").sortWithinPartitions("ordering", "block", "query", "place", "node").mapInArrow(rerank, "query_node long, nodes array<long>, firsts array<long>, scores array<double>")
    return hits.repartition(parts, "query_node").sortWithinPartitions("query_node").mapInArrow(merge, "query_node long, node long, score double")


def _window(nodes: DataFrame, placed: DataFrame, sample: np.ndarray, examples: np.ndarray, dim: int, k: int, c: Curves, total: int) -> int:
    """The least even window in which the wanted share of the sample's true neighbours
    lies in at least one ordering; nodes placed beyond the ends count from there."""
    if total < 2:
        return max(total, 1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of this partition for each vector of the sample, itself left out."""
        scores, ids = np.full((len(sample), 0), -np.inf), np.zeros((len(sample), 0), dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                node = b.column(0)[lo : lo + 2048].to_numpy()
                new = examples @ _matrix(b.column(1)[lo : lo + 2048], dim).T
                new[sample[:, None] == node] = -np.inf
                scores, ids = np.hstack((scores, new)), np.hstack((ids, np.broadcast_to(node, new.shape)))
                if scores.shape[1] > k:
                    kept = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    scores, ids = np.take_along_axis(scores, kept, 1), np.take_along_axis(ids, kept, 1)
        yield pa.record_batch([pa.array(np.repeat(sample, scores.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["sample", "node", "score"])

    found = nodes.select("node", "embedding").mapInArrow(best, "sample long, node long, score double").where("score > double('-infinity')")
    true = found.withColumn("rank", F.row_number().over(W.partitionBy("sample").orderBy(F.desc("score"), "node"))).where(F.col("rank") <= k).select("sample", "node")
    there = placed.where("query = 0").join(F.broadcast(true), "node").select("sample", "node", "ordering", "place")
    here = placed.where("query > 0").select(F.col("node").alias("sample"), "ordering", F.col("place").alias("own"))
    here = here.join(F.broadcast(true.select("sample").distinct()), "sample", "left_semi")
    half = F.min(F.abs(F.col("place") - F.col("own")))
    gaps = there.join(F.broadcast(here), ["sample", "ordering"]).groupBy("sample", "node").agg(half.alias("half")).select("half").toPandas()["half"].to_numpy()
    return int(min(max(2 * int(np.quantile(gaps, c.recall, method="higher")) + 2, c.least_window, 2 * k), total))


def _scored(part: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, first: np.ndarray, place: np.ndarray, dim: int, k: int) -> pa.RecordBatch:
    """The best k of each query among the candidates inside its window."""
    low, high = (np.searchsorted(place, part.column(part.schema.get_field_index(n)).to_numpy()) for n in ("low", "high"))
    a, z = int(low.min()), int(high.max())
    scores = _matrix(part.column(8), dim) @ x[a:z].T
    picked = [lo + _best(s[lo - a : hi - a], first[lo:hi], k) for s, lo, hi in zip(scores, low, high)]
    bounds = pa.array(np.cumsum([0, *map(len, picked)]).astype(np.int32))
    at = np.concatenate(picked)
    own = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
    lists = [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in (ids[at], first[at], scores[own, at - a])]
    return pa.record_batch([part.column(6), *lists], names=["query_node", "nodes", "firsts", "scores"])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """The runs of rows with equal leading columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        for lo, hi, here in runs(b, columns):
            if here != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = here
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
