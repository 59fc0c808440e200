"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them). Tokens
flow from patterns to source quotas. The k-th use of a pattern's tokens is an arc of
its own with a cost that grows with k, so repetition is used as little and as evenly as
the quotas allow. A source that shares no document needs no flow: its pattern gives its
quota. Each pattern's flow is then whole copies of all of its documents and one more copy
of some. Those come in the order of a seeded hash, from each size class (by powers of
two) in proportion; the classes' last documents settle the remainder. A pattern of few
documents is settled by subset sums instead, where classes would be too coarse.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"

#: A pattern of at most so many documents is settled by subset sums; so many documents
#: of such patterns, those of the fewest first, are brought to the driver at most.
FEW, FEW_IN_ALL = 256, 1 << 18

#: Rows of a plan that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18

#: Documents that a subset sum is worked out over: the largest and the smallest ones.
LARGEST, SMALLEST = 40, 24

#: Sums are told apart up to so many steps.
STEPS = 1 << 20

#: Hash ranges of a pattern. One of them is sorted, so a task holds 1 / BUCKETS of it.
BUCKETS = 4096


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order(source: str | None) -> tuple[bool, str]:
    return source is None, source or ""


def capped_targets(sizes: dict[str | None, int], weights: Sequence[float], most: float, total: int) -> dict[str | None, float]:
    """Shares of `total` by weight, the weights repeating over the sources in their
    order. A share stops at `most` times its source's size and the excess is shared
    again by weight among the others, until none is above."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=_order))}
    fixed: dict[str | None, float] = {}
    while True:
        free = [s for s in weight if s not in fixed]
        rest, by = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / by for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


class _Flow:
    """Successive shortest paths with potentials; integral."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        high = [0] * len(self.arcs)
        while True:
            dist: dict[int, int] = {source: 0}
            came: dict[int, int] = {}
            heap, done = [(0, source)], set()
            while heap:
                d, a = heapq.heappop(heap)
                if a in done:
                    continue
                done.add(a)
                for e in self.arcs[a]:
                    b = self.to[e]
                    if self.room[e] and b not in done:
                        new = d + self.cost[e] + high[a] - high[b]
                        if new < dist.get(b, new + 1):
                            dist[b], came[b] = new, e
                            heapq.heappush(heap, (new, b))
            if sink not in came:
                return
            far = max(dist.values())
            high = [h + dist.get(v, far) for v, h in enumerate(high)]
            path, v = [], sink
            while v != source:
                path.append(came[v])
                v = self.to[came[v] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push


def route(capacity: dict[tuple, int], quota: dict[str | None, int], repeats: int) -> dict[tuple, int]:
    """Tokens to take from each pattern. The k-th use of its tokens costs k * (k - 1) / 2;
    parts of the graph that share no source are solved one by one."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p in capacity:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    parts: dict = defaultdict(list)
    for p in capacity:
        parts[find(p[0])].append(p)
    taken = {}
    for patterns in parts.values():
        if len(patterns) == len(patterns[0]) == 1:
            (p,) = patterns
            taken[p] = min(quota[p[0]], repeats * capacity[p])
            continue
        sources = sorted({s for p in patterns for s in p}, key=_order)
        at = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
        flow = _Flow(2 + len(patterns) + len(sources))
        for s in sources:
            flow.arc(at[s], 1, quota[s], 0)
        tiers = []
        for i, p in enumerate(patterns):
            tiers.append([flow.arc(0, 2 + i, capacity[p], k * (k + 1) // 2) for k in range(repeats)])
            for s in p:
                flow.arc(2 + i, at[s], repeats * capacity[p], 0)
        flow.run(0, 1)
        taken |= {p: sum(flow.room[e ^ 1] for e in es) for p, es in zip(patterns, tiers)}
    return taken


def nearest_sum(weights: Sequence[int], most: Sequence[int], wanted: int) -> list[int]:
    """How often to take each weight, up to its `most`, so that the sum comes nearest to
    `wanted`, the lesser of two. Sums beyond STEPS are told apart by steps of more than 1."""
    top = sum(w * m for w, m in zip(weights, most))
    step = max(1, -(-top // STEPS))
    units = [w // step for w in weights]
    reached, before = 1, []
    for u, m in zip(units, most):
        for _ in range(m if u else 0):
            before.append(reached)
            reached |= reached << u
    goal = max(wanted, 0) // step
    below = (reached & ((1 << (goal + 1)) - 1)).bit_length() - 1
    rest = reached >> (goal + 1)
    above = goal + 1 + ((rest & -rest).bit_length() - 1) if rest else None
    at = above if above is not None and above - goal < goal - below else below
    out = [0] * len(units)
    turns = [i for i, (u, m) in enumerate(zip(units, most)) for _ in range(m if u else 0)]
    for i, old in zip(reversed(turns), reversed(before)):
        if not old >> at & 1:
            out[i] += 1
            at -= units[i]
    return out


def few_copies(weights: Sequence[int], wanted: int, repeats: int) -> list[int]:
    """Copies of each of a few documents, in their order, whose sum comes near `wanted`:
    as even as the sum allows, and with 0 to `repeats` of the largest and smallest where
    that leaves more than a thousandth."""
    total = sum(weights)
    if not total:
        return [0] * len(weights)
    base, rest = divmod(min(wanted, repeats * total), total)
    if base == repeats:
        return [repeats] * len(weights)
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    core = order if len(order) <= LARGEST + SMALLEST else [*order[:LARGEST], *order[-SMALLEST:]]
    copies, bulk = [base] * len(weights), sorted(set(order) - set(core))
    share = rest * sum(weights[i] for i in bulk) // total
    for i in bulk:
        if weights[i] <= share:
            copies[i] += 1
            share -= weights[i]
            rest -= weights[i]
    own = [weights[i] for i in core]
    once = nearest_sum(own, [1] * len(core), rest)
    if abs(sum(w * n for w, n in zip(own, once)) - rest) * 1000 > wanted:
        free = nearest_sum(own, [repeats] * len(core), rest + base * sum(own))
        for i, n in zip(core, free):
            copies[i] = n
    else:
        for i, n in zip(core, once):
            copies[i] += n
    return copies


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


ADDED = ("size", "source_size", "target", "copies", "taken")

#: Columns that a mix adds while it is worked out.
OWN = "__mix_"


def mix_sources(docs: DataFrame, *, sources: str = "source", weights: Sequence[float] = (5, 2, 1), repeats: int = 3, seed: int = 17) -> DataFrame:
    """Adds to each document: size (words), source_size, target, copies and taken (size
    times copies), source_size and target summed over its sources.

    `sources` is a string column or an array<string> for documents in several sources.
    The sources, by code point with null last, weigh `weights`, repeating, and share
    the total of all sizes; a target stops at `repeats` times its source's size. Whole
    documents are taken, so a source comes as near to its target as its documents allow,
    within a small one where they are many and patterns don't overlap, and no document
    is taken more than `repeats` times. The same rows and seed give the same mix,
    wherever they lie.

    Null text: size 0. A null source is a source, as is a null element; an empty or
    null array counts as one null source. Repeated rows are documents of their own, but
    rows equal in doc_id, text and sources get the same copies. An empty table gives no
    rows. Columns of `docs` with the added names are replaced.

    The driver holds a few numbers for each pattern of sources and size class.
    """
    mixed = _with_copies(docs, sources, weights, repeats, seed)
    kept = [F.col(c) for c in docs.columns if c not in ADDED]
    own = [F.col(OWN + c).alias(c) for c in ADDED[:-1]]
    return mixed.select(*kept, *own, (F.col(f"{OWN}size") * F.col(f"{OWN}copies")).alias("taken"))


def take_mix(docs: DataFrame, *, sources: str = "source", weights: Sequence[float] = (5, 2, 1), repeats: int = 3, seed: int = 17) -> DataFrame:
    """The rows of `docs`, with its columns only, each as often as the mix takes it."""
    mixed = _with_copies(docs, sources, weights, repeats, seed).where(F.col(f"{OWN}copies") > 0)
    return mixed.withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(1), F.col(f"{OWN}copies").cast("int")))).select(docs.columns)


def _with_copies(docs: DataFrame, sources: str, weights: Sequence[float], repeats: int, seed: int) -> DataFrame:
    """`docs` with size, source_size, target and copies under names of their own."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    array = dict(docs.dtypes)[sources].startswith("array")
    members = F.array_sort(F.array_distinct(F.col(sources).cast("array<string>"))) if array else F.array(F.col(sources).cast("string"))
    if array:
        members = F.when(F.size(sources) > 0, members).otherwise(F.array(F.lit(None).cast("string")))
    pattern, klass, key, size = (OWN + n for n in ("pattern", "class", "key", "size"))
    sized = docs.withColumn(pattern, members).withColumn(size, word_count(F.col("text")))
    sized = sized.withColumn(key, F.struct(F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), F.col(size).alias("size")))
    bucket = F.shiftrightunsigned(F.col(key)["hash"], 64 - (BUCKETS - 1).bit_length())
    sized = sized.withColumn(klass, F.length(F.bin(size)))
    # Equal rows are one item, so that no number of them has to be sorted in one task.
    light = sized.select(F.col(pattern).alias("mix_pattern"), F.col(klass).alias("mix_class"), bucket.alias("bucket"), F.col(key).alias("mix_key"))
    light = light.groupBy("mix_pattern", "mix_class", "bucket", "mix_key").agg(F.count("*").alias("rows"))
    light = scratch.write(light.withColumn("weight", F.col("rows") * F.col("mix_key.size")).drop("rows"))

    sums = light.groupBy("mix_pattern", "mix_class", "bucket").agg(F.sum("weight").alias("words"), F.count("*").alias("items"))
    totals = sums.groupBy("mix_pattern").agg(F.sum("words").alias("words"), F.sum("items").alias("items")).collect()
    capacity = {tuple(r["mix_pattern"]): r["words"] for r in totals}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    target = capped_targets(sizes, weights, repeats, sum(capacity.values()))
    flow = route(capacity, {s: round(t) for s, t in target.items()}, repeats)

    few, held = [], 0
    for r in sorted(totals, key=lambda r: (r["items"], [_order(x) for x in r["mix_pattern"]])):
        if r["items"] > FEW or held + r["items"] > FEW_IN_ALL:
            break
        few.append(tuple(r["mix_pattern"]))
        held += r["items"]
    asked = _small(spark.createDataFrame([(list(p),) for p in few], "mix_pattern array<string>"), len(few))
    own = defaultdict(list)
    for r in light.join(asked, "mix_pattern", "left_semi").orderBy("mix_key").select("mix_pattern", "mix_key", "weight").collect():
        own[tuple(r["mix_pattern"])].append((tuple(r["mix_key"]), r["weight"]))
    settled = [(list(p), k, n) for p, items in own.items() for (k, _), n in zip(items, few_copies([w for _, w in items], flow[p], repeats))]
    settled = spark.createDataFrame(settled, f"{pattern} array<string>, {key} struct<hash: long, doc_id: long, size: long>, {OWN}settled int")

    many = {p: n for p, n in capacity.items() if p not in own and n}
    once = {p: flow[p] % max(n, 1) for p, n in many.items()}
    cells = [(list(p), once[p], n) for p, n in many.items()]
    cells = _small(spark.createDataFrame(cells, "mix_pattern array<string>, rest long, all_words long"), len(cells))

    # Each size class gives its share of a pattern's last copies. Where they end in it:
    # the hash range, then the last document that fits and the one that crosses the end.
    cell = ["mix_pattern", "mix_class"]
    run = W.partitionBy(*cell).rowsBetween(W.unboundedPreceding, -1)
    edge = scratch.write(sums.join(cells.select("mix_pattern"), "mix_pattern", "left_semi").withColumn("before", F.coalesce(F.sum("words").over(run.orderBy("bucket")), F.lit(0))))
    whole = edge.groupBy(*cell).agg(F.sum("words").alias("class_words")).join(cells, "mix_pattern")
    share = F.floor(F.col("rest").cast("decimal(38,0)") * F.col("class_words") / F.col("all_words")).cast("long")
    words_of, wanted = defaultdict(dict), defaultdict(dict)  # by pattern and class
    for r in whole.select(*cell, "class_words", share.alias("share")).collect():
        words_of[tuple(r["mix_pattern"])][r["mix_class"]] = r["class_words"]
        wanted[tuple(r["mix_pattern"])][r["mix_class"]] = r["share"] or 0

    def ends_of(wanted: dict) -> dict[tuple, list]:
        rests = [(list(p), c, n) for p, by in wanted.items() for c, n in by.items()]
        rests = _small(spark.createDataFrame(rests, "mix_pattern array<string>, mix_class int, rest long"), len(rests))
        cut = edge.join(rests, cell).where("before < rest and rest <= before + words").select(*cell, "bucket", F.col("before").alias("ahead"), "rest")
        cut = scratch.write(cut)
        inside = light.join(_small(cut, sum(map(len, wanted.values()))), [*cell, "bucket"])
        inside = inside.withColumn("upto", F.col("ahead") + F.coalesce(F.sum("weight").over(run.orderBy("mix_key")), F.lit(0)) + F.col("weight"))
        fits = F.col("upto") <= F.col("rest")
        crossing = F.min(F.when(~fits, F.struct("mix_key", "weight"))).alias("next")
        ends = inside.groupBy(*cell, "bucket").agg(F.max(F.when(fits, F.col("mix_key"))).alias("last_key"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.max("ahead")).alias("got"), crossing)
        out = defaultdict(list)
        for r in ends.collect():
            out[tuple(r["mix_pattern"])].append(r)
        return out

    # Of the crossing documents those are taken, the largest first, that still fit the
    # pattern's flow, and in the end the least of the others if it then comes nearer.
    def crossing(p: tuple, own: list, last: bool) -> tuple[set, int]:
        left = once[p] - sum(r["got"] for r in own)
        chosen, free = set(), sorted((r for r in own if r["next"] is not None), key=lambda r: -r["next"]["weight"])
        for r in free:
            if r["next"]["weight"] <= left:
                chosen.add(r["mix_class"])
                left -= r["next"]["weight"]
        near = min((r for r in free if r["mix_class"] not in chosen), key=lambda r: r["next"]["weight"], default=None)
        if last and near is not None and near["next"]["weight"] < 2 * left:
            chosen.add(near["mix_class"])
        return chosen, left

    # What the classes of long documents can't meet goes to those of the shortest ones.
    first = ends_of(wanted)
    for p, by in words_of.items():
        chosen, left = crossing(p, first[p], False)
        got = dict.fromkeys(by, 0) | {r["mix_class"]: r["got"] + (r["next"]["weight"] if r["mix_class"] in chosen else 0) for r in first[p]}
        for c in sorted(by):
            more = max(min(by[c] - got[c], left), 0)
            wanted[p][c] = got[c] + more
            left -= more
    by_pattern = ends_of(wanted)
    plan, cuts = [], []
    for p, n in capacity.items():
        plan.append((list(p), sum(sizes[s] for s in p), float(sum(target[s] for s in p)), flow[p] // max(n, 1)))
    for p in many:
        chosen, _ = crossing(p, by_pattern[p], True)
        for r in by_pattern[p]:
            last = r["next"]["mix_key"] if r["mix_class"] in chosen else r["last_key"]
            cuts.append((list(p), r["mix_class"], r["bucket"], tuple(last) if last else None))
    n_cuts = len(cuts)
    plan = spark.createDataFrame(plan, f"{pattern} array<string>, {OWN}source_size long, {OWN}target double, {OWN}base long")
    cuts = spark.createDataFrame(cuts, f"{pattern} array<string>, {klass} int, {OWN}edge long, {OWN}last_key struct<hash: long, doc_id: long, size: long>")

    full = sized.join(_small(plan, len(capacity)), pattern).join(_small(cuts, n_cuts), [pattern, klass], "left").join(F.broadcast(settled), [pattern, key], "left")
    more = (bucket < F.col(f"{OWN}edge")) | ((bucket == F.col(f"{OWN}edge")) & (F.col(key) <= F.col(f"{OWN}last_key")))
    copies = F.coalesce(F.col(f"{OWN}settled").cast("long"), F.col(f"{OWN}base") + F.when(more, 1).otherwise(0))
    return full.withColumn(f"{OWN}copies", copies)
