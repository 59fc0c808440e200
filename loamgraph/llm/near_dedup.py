"""Near-duplicate classes by a multi-index Hamming join of b-bit minimum-hash signatures.

Each distinct shingle set gets `chunks` x `slots` minimum hashes of 10 bits. Two sets
are at the distance of the number of slots that differ. By pigeonhole, two signatures
at a distance below chunks * (errors + 1) have a chunk with at most `errors` differing
slots; so each chunk is indexed once for every choice of `errors` slots left out, and
every such pair meets under some key. Candidates are confirmed on their full sets.

With 5 chunks of 6 slots and 2 errors, all pairs at a distance of up to 14 of 30 meet,
and pairs at the similarity 0.8 (mean distance 6) fail to meet with probability 1e-5.
All that meet, at any distance, are confirmed where they could join two classes.

A key's group is never expanded into all its pairs. First each member is held against
one member of the group, which a hash of key and set picks, so that a set meets other
ones under other keys; the nearest few of them are confirmed, and what this links is
contracted. Only where members of different classes are left are those outside the
group's largest class joined with the group, which is dealt out in blocks. So a group of
n near copies costs a few times n comparisons, and a link between different texts that
could join two classes is still never skipped.

That join lets no pair through that an exact bound rules out. Each set has a bitmap of
the parities of its hashes in PARITY_BITS cells. A cell that differs needs a hash that
one of the two sets has alone, so the differing cells are at most the symmetric
difference, and a pair with more of them than the similarity allows can't be linked.
Sets of some 2,500 shingles and more fill the cells, so that the bound is met by all of
their pairs; these are all confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import TASK_ROWS, Scratch, in_few_tasks
from .batches import mix, runs, string_column, text_slices, word_bounds, word_hashes

#: Columns that hold a row's key while rows are chosen.
KEYS = ("__near_row_key", "__near_row_key_2")

#: Cells of a set's bitmap of parities.
PARITY_BITS = 1024

#: A set with more rows than this and one in HOT_SHARE of all is joined by a broadcast;
#: there are fewer than HOT_SHARE such sets.
HOT_ROWS, HOT_SHARE = 64, 4096

#: Rows of a key's group that one task of the second join holds.
BLOCK_ROWS = 2048

#: Members that each set is confirmed against at first; the rest is for the second join.
FIRST_LINKS = 3

#: Rows of ids and labels that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


@dataclass(frozen=True)
class Index:
    """slots * bits <= 63: a chunk is one 64-bit word."""

    chunks: int = 5
    slots: int = 6
    errors: int = 2
    bits: int = 10

    @property
    def hashes(self) -> int:
        return self.chunks * self.slots


def shingle_sets(batch_offs: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a slice, ascending, and their bounds (n + 1).
    A row of fewer words has its whole sequence as its one shingle; no words, none."""
    starts, ends, first = word_bounds(batch_offs, data)
    words = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    at = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(n)), n)
    head = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    size = np.minimum(n_words, width)[row]
    out = size.astype(np.uint64)
    for k in range(width):
        inside = size > k
        w = words[np.minimum(head + k, max(len(words) - 1, 0))] if len(words) else words
        out = np.where(inside, mix(out * np.uint64(0x9E3779B97F4A7C15) + w), out)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[fresh], row[fresh]
    return out, np.searchsorted(row, np.arange(len(n) + 1))


def row_key() -> Column:
    """96 bits of a hash of doc_id and text."""
    doc_id = F.col("doc_id").cast("long")
    return F.struct(F.xxhash64(doc_id, "text").alias("a"), F.hash("text", doc_id).alias("b"))


def signatures(sets: np.ndarray, at: np.ndarray, hashes: int) -> np.ndarray:
    """16-bit minimum hashes (rows x hashes) of non-empty sets."""
    factors = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    out = np.empty((len(at) - 1, hashes), dtype=np.uint16)
    for k, f in enumerate(factors):
        x = sets * f
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum.reduceat(x >> np.uint64(16), at[:-1])
        out[:, k] = mix(low).astype(np.uint16)
    return out


def parities(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set, 64-bit words whose bits are the parities of its hashes' cells."""
    n, words = len(at) - 1, PARITY_BITS // 64
    out = np.zeros((n, words), dtype=np.int64)
    cell = (mix(sets) >> np.uint64(64 - (PARITY_BITS - 1).bit_length())).astype(np.int64)
    for lo in range(0, n, 512):
        hi = min(lo + 512, n)
        row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
        odd = np.bincount(row * PARITY_BITS + cell[at[lo] : at[hi]], minlength=(hi - lo) * PARITY_BITS) & 1
        out[lo:hi] = np.packbits(odd.astype(bool).reshape(hi - lo, PARITY_BITS), axis=1).view(np.int64)
    return out


def _packed(signature: np.ndarray, index: Index) -> np.ndarray:
    """One word for each chunk, its slots from the low bits on."""
    slots = signature.reshape(len(signature), index.chunks, index.slots).astype(np.uint64) & np.uint64((1 << index.bits) - 1)
    return (slots << (np.arange(index.slots, dtype=np.uint64) * np.uint64(index.bits))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _set_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    run_sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(1)))))
    return mix(mix(run_sum[at[1:]] - run_sum[at[:-1]]) + np.diff(at).astype(np.uint64)).view(np.int64)


def _described(docs: DataFrame, width: int, index: Index) -> DataFrame:
    """doc_id, row_key (of doc_id and text), n_shingles, set_id (a hash of the whole set;
    null if empty), signature, bits (the parities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, offs, data in text_slices(string_column(b, "text")):
                sets, at = shingle_sets(offs, data, width)
                n = np.diff(at)
                some = np.flatnonzero(n)
                words = np.zeros((hi - lo, index.chunks), dtype=np.int64)
                if len(some):
                    words[some] = _packed(signatures(sets, np.append(at[some], len(sets)), index.hashes), index)
                bits = parities(sets, at)
                yield pa.record_batch([
                    b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(n), pa.array(_set_ids(sets, at), mask=n == 0),
                    _lists(words.ravel(), np.arange(hi - lo + 1) * words.shape[1]), _lists(bits.ravel(), np.arange(hi - lo + 1) * bits.shape[1]),
                ], names=["doc_id", "row_key", "n_shingles", "set_id", "signature", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"))
    return rows.mapInArrow(run, "doc_id long, row_key struct<a: long, b: int>, n_shingles long, set_id long, signature array<long>, bits array<long>")


def _keys(nodes: DataFrame, n_nodes: int, index: Index) -> DataFrame:
    """(key, set_id): for every chunk and every choice of slots left out. A key's low ten
    bits are the number of the choice. The nodes are dealt out by the number of keys, as
    the few files that hold them would put millions of keys into one task's memory."""
    masks = [(c, sum(((1 << index.bits) - 1) << index.bits * j for j in range(index.slots) if j not in out)) for c in range(index.chunks) for out in _left_out(index)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                words = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).view(np.uint64)
                keys = [(mix((words[:, c] & np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(v + 1)) << np.uint64(10)) | np.uint64(v) for v, (c, m) in enumerate(masks)]
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, len(keys)))], names=["key", "set_id"])

    tasks = min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_nodes * len(masks) // TASK_ROWS + 1)
    return nodes.select("set_id", "signature").repartition(tasks, "set_id").mapInArrow(run, "key long, set_id long")


def _left_out(index: Index) -> list[tuple[int, ...]]:
    """The slots of a chunk that each of its keys leaves out, in the order of the keys."""
    return list(combinations(range(index.slots), index.errors))


def _differing(a: Column, b: Column, index: Index) -> Column:
    """The highest bit of each slot that differs between two words."""
    low = sum(((1 << index.bits - 1) - 1) << index.bits * j for j in range(index.slots))
    high = sum(1 << index.bits * j + index.bits - 1 for j in range(index.slots))
    x = a.bitwiseXOR(b)
    return (x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(high))


def _distance(a: Column, b: Column, index: Index) -> Column:
    """Differing slots of two signatures."""
    return reduce(add, (F.bit_count(_differing(a[i], b[i], index)) for i in range(index.chunks)))


def _differing_slots(x: np.ndarray, index: Index) -> np.ndarray:
    low = np.int64(sum(((1 << index.bits - 1) - 1) << index.bits * j for j in range(index.slots)))
    high = np.int64(sum(1 << index.bits * j + index.bits - 1 for j in range(index.slots)))
    return (((x & low) + low) | x) & high


def _first_patterns(index: Index) -> list[list[int]]:
    """For each key of a chunk, the words of differing slots for which it is the first of
    the chunk's keys that two sets share."""
    out: list[list[int]] = []
    taken: set[tuple[int, ...]] = set()
    for left_out in _left_out(index):
        own = [m for k in range(index.errors + 1) for m in combinations(left_out, k) if m not in taken]
        taken |= set(own)
        out.append([sum(1 << index.bits * j + index.bits - 1 for j in m) for m in own])
    return out


def _alike(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def components(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, label) for the nodes of undirected edges (a, b), and their number; the label
    is the least node of the component. Alternates large and small stars until no edge
    changes."""
    e, n = scratch.counted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        few = lambda df: in_few_tasks(df, 2 * n)  # noqa: E731, B023
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = scratch.write(few(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("x"))
        new, n = scratch.counted(few(small.select("x.a", F.col("x.low").alias("b")).where("a <> b").distinct()))
        scratch.drop(large)
        scratch.drop(e)
        e = new
        # Done when the edges are stars: each leaf has one centre, and no centre is a leaf.
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        ends, nodes = scratch.counted(few(ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))))
        if ends.where("leaf > 1 or leaf + centre > 1").isEmpty():
            centre = ends.where("centre = 1").select("node", F.col("node").alias("label"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centre), nodes
        scratch.drop(ends)


class _Confirm:
    """Checks candidate pairs of sets on the whole sets, made anew from the texts of
    one document for each set."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, scratch: Scratch, width: int, percent: int):
        self.docs, self.nodes, self.scratch, self.width, self.percent = docs, nodes, scratch, width, percent

    def _sets(self, ids: DataFrame, count: int) -> DataFrame:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, offs, data in text_slices(string_column(b, "text")):
                    sets, at = shingle_sets(offs, data, width)
                    yield pa.record_batch([pa.array(_set_ids(sets, at)), _lists(sets, at)], names=["set_id", "members"])

        wanted = ids.select("doc_id").distinct()
        docs = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        docs = docs.join(F.broadcast(wanted) if count <= BROADCAST_IDS else wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        sets = docs.select("text").mapInArrow(run, "set_id long, members array<long>")
        known = ids.select("set_id")
        # A doc_id that repeats has other texts too; one copy of each wanted set is kept.
        sets = sets.join(F.broadcast(known) if count <= BROADCAST_IDS else known, "set_id", "left_semi")
        return sets.groupBy("set_id").agg(F.first("members").alias("members"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity."""
        pairs, n = self.scratch.counted(pairs)
        used = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        ids, m = self.scratch.counted(self.nodes.select("set_id", F.col("least_doc").alias("doc_id")).join(_small(in_few_tasks(used, 2 * n), 2 * n), "set_id", "left_semi"))
        sets = self.scratch.write(self._sets(ids, m))
        full = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("members").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        full = full.withColumn("common", common).where(100 * F.col("common") >= self.percent * (F.size("x") + F.size("y") - F.col("common")))
        out = self.scratch.write(full.select("a", "b"))
        for t in (pairs, ids, sets):
            self.scratch.drop(t)
        return out


def _classes(docs: DataFrame, width: int, percent: int, index: Index) -> tuple[DataFrame, DataFrame]:
    """The described rows, and for each set: its class (label), rows, least_doc and
    first_row."""
    scratch = Scratch(docs.sparkSession)
    described, n_docs = scratch.counted(_described(docs, width, index))
    # Nulls order last, as they do in no struct of Spark's.
    first_row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    nodes = described.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("least_doc"), F.min(first_row).alias("first_row"), F.count("*").alias("copies"),
        F.max("n_shingles").alias("n"), F.max("signature").alias("signature"), F.max("bits").alias("bits"),
    )
    nodes, n_nodes = scratch.counted(in_few_tasks(nodes, n_docs, 4096))
    keys = _keys(nodes, n_nodes, index)
    n_keys = n_nodes * index.chunks * len(_left_out(index))
    groups = keys.groupBy("key").agg(F.min_by("set_id", F.xxhash64("key", "set_id")).alias("low"), F.count("*").alias("rows")).where("rows > 1")
    groups = scratch.write(in_few_tasks(groups, n_keys))
    met, n_met = scratch.counted(in_few_tasks(keys.join(groups.drop("rows"), "key").where("set_id <> low"), n_keys))
    few = lambda df: in_few_tasks(df, n_met)

    side = lambda s: nodes.select(F.col("set_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"sig_{s}"))
    stars = met.select(F.col("set_id").alias("a"), F.col("low").alias("b")).distinct()
    stars = few(few(few(stars).join(side("b"), "b")).join(side("a"), "a")).withColumn("distance", _distance(F.col("sig_a"), F.col("sig_b"), index))
    stars = stars.where(_alike(F.col("n_a"), F.col("n_b"), percent))
    place = F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))
    stars = stars.select("a", "b", "distance").withColumn("place", place).where(F.col("place") <= FIRST_LINKS).select("a", "b")
    confirm = _Confirm(docs, nodes, scratch, width, percent)
    label, n_label = components(scratch, confirm.links(stars))
    label = scratch.write(in_few_tasks(label, n_label))

    pairs = _left_over(scratch, nodes, met.select("key", "set_id").unionByName(groups.select("key", F.col("low").alias("set_id"))), n_met, _small(label, n_label), percent, index)
    if pairs is not None:
        mapped = confirm.links(pairs)
        for s in ("a", "b"):
            mapped = mapped.join(_small(label.withColumnRenamed("node", s), n_label), s, "left").withColumn(s, F.coalesce("label", s)).drop("label")
        joined, n_joined = components(scratch, mapped.select("a", "b"))
        joined = scratch.write(in_few_tasks(joined, n_joined))
        old = label.join(_small(joined.select(F.col("node").alias("label"), F.col("label").alias("top")), n_joined), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        label = scratch.write(in_few_tasks(old.unionByName(joined.join(_small(label.select("node"), n_label), "node", "left_anti")), n_label + n_joined))
        n_label += n_joined

    sets = nodes.select("set_id", "copies", "least_doc", "first_row").join(_small(label.withColumnRenamed("node", "set_id"), n_label), "set_id", "left")
    return described, scratch.write(sets.withColumn("label", F.coalesce("label", "set_id")))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, index: Index = Index()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct hashes of its shingles of `width` words, A-Z
    lower-cased. Documents are linked where 100 * intersection >= percent * union;
    component_id is the least doc_id that links reach, kept says that it is the
    document's own.

    Documents without words, or with null text, have empty sets and link with nothing.
    Shorter ones have their whole sequence as their one shingle. Rows with equal sets
    are linked, at any number. A null doc_id takes part and gets its component's id; it
    is null, and the row kept, where the component has no other. Texts are read whole.
    Repeated rows stay, each with its own result. Only doc_id and text are read.
    """
    described, sets = _classes(docs, width, percent, index)
    least = sets.groupBy("label").agg(F.min("least_doc").alias("component_id"))
    final = sets.select("set_id", "copies", "label").join(least, "label").select("set_id", "copies", "component_id")
    final = Scratch(docs.sparkSession).write(final)
    rows = described.select("doc_id", "n_shingles", "set_id")
    # The sets of many rows: fewer than HOT_SHARE by their least number of rows.
    hot = F.broadcast(final.where(F.col("copies") > HOT_ROWS + rows.count() // HOT_SHARE).drop("copies"))
    some = rows.where("set_id is not null")
    out = some.join(hot, "set_id").unionByName(some.join(hot, "set_id", "left_anti").join(final.drop("copies"), "set_id"))
    out = out.unionByName(rows.where("set_id is null").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80, index: Index = Index()) -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their class of near
    duplicates: by doc_id, null last, then by a hash of doc_id and text.

    Rows without words are in no class and stay. Rows equal in doc_id and text count as
    one, of which one stays. Rows that share a doc_id but not the text are told apart.
    """
    described, sets = _classes(docs, width, percent, index)
    first = sets.groupBy("label").agg(F.min("first_row").alias("first_row"))
    keys = first.select("first_row.row_key").unionByName(described.where("set_id is null").select("row_key").distinct())
    kept = Scratch(docs.sparkSession).write(keys.select(F.col("row_key.a").alias(KEYS[0]), F.col("row_key.b").alias(KEYS[1])))
    rows = docs.withColumns(dict(zip(KEYS, (row_key()["a"], row_key()["b"]))))
    return rows.join(kept, list(KEYS), "left_semi").dropDuplicates(list(KEYS)).select(docs.columns)


def _left_over(scratch: Scratch, nodes: DataFrame, members: DataFrame, n_members: int, label: DataFrame, percent: int, index: Index) -> DataFrame | None:
    """Candidate pairs of members of one key's group that are in different classes so
    far. members: key and set_id of all groups of two and more; about n_members rows."""
    member = members.join(label.withColumnRenamed("node", "set_id"), "set_id", "left").select("key", "set_id", F.coalesce("label", "set_id").alias("label"))
    mixed = member.groupBy("key", "label").agg(F.count("*").alias("rows"))
    mixed = mixed.groupBy("key").agg(F.count("*").alias("labels"), F.sum("rows").alias("rows"), F.max(F.struct("rows", "label")).alias("main")).where("labels > 1")
    mixed, n_mixed = scratch.counted(in_few_tasks(mixed.select("key", F.col("main.label").alias("main"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("right_blocks"), F.ceil((F.col("rows") - F.col("main.rows")) / BLOCK_ROWS).cast("int").alias("left_blocks")), n_members))
    if not n_mixed:
        return None
    member = member.join(_small(mixed, n_mixed), "key").join(nodes.select("set_id", "n", "signature", "bits"), "set_id")
    outside = F.col("label") != F.col("main")
    # Both sides are dealt out in blocks, so that a task holds a block of each at a time.
    block = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda rows, left, i, j: rows.select("key", i.alias("left_block"), "right_blocks", "left_blocks", "set_id", "label", "n", "signature", "bits").select(
        "key", "left_block", j.alias("right_block"), F.lit(left).alias("is_left"), "set_id", "label", "n", "signature", "bits"
    )
    member = scratch.write(member)
    sides = one(member.where(outside), True, block("left_blocks"), every("right_blocks")).unionByName(one(member, False, every("left_blocks"), block("right_blocks")))
    # By number, since the work goes with the pairs and not with the bytes of a partition.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = sides.repartition(parts, "key", "left_block", "right_block").sortWithinPartitions("key", "left_block", "right_block", "is_left")
    return sides.mapInArrow(_pairs_of_blocks(index, percent), "a long, b long").distinct()


def _pairs_of_blocks(index: Index, percent: int):
    """Candidate pairs of a left and a right block of one key, sorted so that the right
    block comes first."""
    n_keys, patterns = len(_left_out(index)), [np.array(p, dtype=np.int64) for p in _first_patterns(index)]

    def columns(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(parts)
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        # Of a negative number, numpy counts the bits of the absolute value.
        return *(t.column(c).to_numpy() for c in ("set_id", "label", "n")), flat("signature"), flat("bits").view(np.uint64)

    def pairs(key: int, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
        ids_l, label_l, n_l, words_l, bits_l = left
        ids_r, label_r, n_r, words_r, bits_r = right
        apart = np.zeros((len(ids_l), len(ids_r)), dtype=np.int32)
        for w in range(bits_l.shape[1]):
            apart += np.bitwise_count(bits_l[:, w, None] ^ bits_r[None, :, w])
        # A symmetric difference d allows the similarity s where d <= (n + m) * (1 - s) / (1 + s).
        near = apart * (100 + percent) <= (n_l[:, None] + n_r) * (100 - percent)
        near &= (label_l[:, None] != label_r) & (100 * np.minimum(n_l[:, None], n_r) >= percent * np.maximum(n_l[:, None], n_r))
        i, j = np.nonzero(near)
        # A pair that meets under several keys comes from the first of them only.
        chunk, own = divmod(key & 1023, n_keys)
        differ = _differing_slots(words_l[i, : chunk + 1] ^ words_r[j, : chunk + 1], index)
        first = np.isin(differ[:, chunk], patterns[own]) & (np.bitwise_count(differ[:, :chunk]) > index.errors).all(axis=1)
        return ids_l[i[first]], ids_r[j[first]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, right = None, [], None
        for b in batches:
            for lo, hi, key in runs(b, 4):
                if key[:3] != at:
                    at, held, right = key[:3], [], None
                if not key[3]:
                    held.append(b.slice(lo, hi - lo))
                    continue
                if right is None:
                    right = columns(held)
                for k in range(lo, hi, 256):
                    l, r = pairs(key[0], columns([b.slice(k, min(256, hi - k))]), right)
                    if len(l):
                        yield pa.record_batch([pa.array(np.maximum(l, r)), pa.array(np.minimum(l, r))], names=["a", "b"])

    return run
