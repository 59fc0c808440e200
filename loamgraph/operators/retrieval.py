"""From a question to a bounded context: traversal choice, plan expansion, assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import prompt_part, shortened, summary_part, token_count
from ..runtime import Scratch
from .graph import of_types, reachable

#: Fixed values: (words looked for anywhere in the lower-cased question, the traversals
#: as relation type and direction). The first row that has one of its words decides;
#: "in" also fits inside of words.
TRAVERSALS = (
    (("method", "function", "class", "in"), (("DEFINES", "out"),)),
    (("callers", "calls", "called by", "who calls"), (("CALL", "in"),)),
    (("call",), (("CALL", "out"),)),
    (("import",), (("IMPORT", "in"),)),
    ((), (("DEFINES", "out"), ("CALL", "out"))),
)


#: Fixed value: the one provider of answers.
PROVIDER = "ollama"


def traversals(question: Column) -> Column:
    """The traversals that a question asks for: array of (relation_type, direction)."""
    low, out = F.lower(question), None
    for words, steps in TRAVERSALS:
        value = F.array(*(F.struct(F.lit(t).alias("relation_type"), F.lit(d).alias("direction")) for t, d in steps))
        if not words:
            return value if out is None else out.otherwise(value)
        test = F.lit(False)
        for w in words:
            test = test | F.coalesce(F.contains(low, F.lit(w)), F.lit(False))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def traverse_for(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, node): neighbours of each question's start by its traversals.

    asked: question_id, question, start. Both directions are one edge table with a
    direction column, so that all questions take one equi-join."""
    both = edges.select("relation_type", F.lit("out").alias("direction"), F.col("src").alias("start"), F.col("dst").alias("node"))
    both = both.unionByName(edges.select("relation_type", F.lit("in").alias("direction"), F.col("dst").alias("start"), F.col("src").alias("node")))
    steps = asked.select("question_id", "start", F.explode(traversals(F.col("question"))).alias("t")).select("question_id", "start", "t.*")
    return steps.join(both, ["start", "relation_type", "direction"]).where("node <> start").select("question_id", "node").distinct()


def start_node(hits: DataFrame, key: str = "canonical_id") -> DataFrame:
    """The longest id; ties go to the least."""
    return hits.orderBy(F.desc(F.length(key)), key).limit(1)


def expand_once(edges: DataFrame, seeds: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """(document_id, source_document_id, relation_type): documents one step from a seed.
    The least (seed, relation) that reaches a document is its provenance. Seeds may be
    reached too, from other seeds."""
    step = of_types(edges, types).join(seeds.select(F.col("document_id").alias("src")).distinct(), "src", "left_semi")
    first = F.min(F.struct("src", F.coalesce("relation_type", F.lit("UNKNOWN")).alias("rel"))).alias("first")
    return step.groupBy(F.col("dst").alias("document_id")).agg(first).select("document_id", F.col("first.src").alias("source_document_id"), F.col("first.rel").alias("relation_type"))


def expand(edges: DataFrame, seeds: DataFrame, *, types: Iterable[str] | None = None, depth: int = 1) -> DataFrame:
    """The same up to `depth` steps, by breadth: a document keeps the provenance of its
    least distance. (Depth-first search with a shared visited set, which could miss
    documents within the depth, isn't imitated.)"""
    scratch = Scratch(edges.sparkSession)
    seen = expand_once(edges, seeds, types)
    frontier = seen
    for _ in range(1, depth):
        new = expand_once(edges, frontier, types).join(seen, "document_id", "left_anti")
        frontier = scratch.write(new)
        seen = seen.unionByName(frontier)
    return seen


def plan_rows(seeds: DataFrame, expanded: DataFrame) -> DataFrame:
    """document_id, role (seed or expanded), provenance: the retrieval plan as a table.
    A document that is both is a seed."""
    none = F.lit(None).cast("string")
    own = seeds.select("document_id").distinct().select("document_id", F.lit("seed").alias("role"), none.alias("source_document_id"), none.alias("relation_type"))
    rest = expanded.join(own, "document_id", "left_anti").select("document_id", F.lit("expanded").alias("role"), "source_document_id", "relation_type")
    return own.unionByName(rest)


def document_order(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """Adds doc_rank: the best rank of the row's document."""
    return hits.withColumn("doc_rank", F.min(rank).over(W.partitionBy("document_id")))


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, with its first position."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def per_document(chunks: DataFrame, most: int = 5, *, by: Sequence[str] = ("chunk_index", "chunk_id")) -> DataFrame:
    """The first `most` chunks of each document."""
    place = F.row_number().over(W.partitionBy("document_id").orderBy(*by))
    return chunks.withColumn("place", place).where(F.col("place") <= most).drop("place")


def within_budget(chunks: DataFrame, budget: int, *, context: Sequence[str], by: Sequence[str], tokens: Column | None = None) -> DataFrame:
    """The chunks of each context before the first that would take the running number of
    tokens over the budget. Adds tokens and total. Token numbers aren't negative, so the
    running sum decides; a context is what one prompt holds."""
    tokens = token_count(F.col("text")) if tokens is None else tokens
    run = F.sum("tokens").over(W.partitionBy(*context).orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    return chunks.withColumn("tokens", tokens.cast("long")).withColumn("total", run).where(F.col("total") <= budget)


def at_most(chunks: DataFrame, cap: int, *, context: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The first `cap` chunks of each context; a cap below 1 counts as 1."""
    place = F.row_number().over(W.partitionBy(*context).orderBy(*by))
    return chunks.withColumn("place", place).where(F.col("place") <= max(cap, 1)).drop("place")


def prepare(chunks: DataFrame, *, context: Sequence[str], by: Sequence[str], per_doc: int = 5, keep: Column | None = None, budget: int | None = None, cap: int | None = None) -> DataFrame:
    """Slice of each document, then the caller's predicate, the budget, and the cap."""
    out = per_document(chunks, per_doc)
    if keep is not None:
        out = out.where(keep)
    if budget is not None:
        out = within_budget(out, budget, context=context, by=by)
    return out if cap is None else at_most(out, cap, context=context, by=by)


def context_text(chunks: DataFrame, *, context: Sequence[str], position: str, joiner: str = "\n\n") -> DataFrame:
    """One text per context: its chunks in order."""
    parts = F.sort_array(F.collect_list(F.struct(position, "text")))
    return chunks.groupBy(*context).agg(F.array_join(F.transform(parts, lambda x: x["text"]), joiner).alias("context_text"))


def summary_context(chunks: DataFrame, most: int = 5, chars: int = 4000) -> DataFrame:
    """The text that a document's summary is made from."""
    first = per_document(chunks, most)
    return context_text(first, context=["document_id"], position="chunk_index").withColumn("context_text", shortened(F.col("context_text"), chars))


def agent_prompt(summaries: DataFrame, chunks: DataFrame, *, position: str) -> DataFrame:
    """Summaries, then chunks, each as a marked part, in one column."""
    a = summaries.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("position"), "document_id", summary_part(F.col("document_id").cast("string"), F.col("summary")).alias("text"))
    b = chunks.select(F.lit(1).alias("kind"), F.col(position).cast("long").alias("position"), "document_id", prompt_part(F.col("document_id").cast("string"), F.col("chunk_id").cast("string"), F.col("text")).alias("text"))
    both = a.unionByName(b)
    parts = F.sort_array(F.collect_list(F.struct("kind", "position", "document_id", "text")))
    return both.agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("prompt"))


def clusters(documents: DataFrame, key: Column | None, *, document: str = "document_id") -> DataFrame:
    """cluster, members (sorted): documents by a metadata value, UNKNOWN where it is
    missing; all in one cluster, ALL, without a key."""
    name = F.lit("ALL") if key is None else F.coalesce(key.cast("string"), F.lit("UNKNOWN"))
    return documents.groupBy(name.alias("cluster")).agg(F.sort_array(F.collect_list(document)).alias("members"))


def cluster_sizes(documents: DataFrame, key: Column | None, *, document: str = "document_id") -> DataFrame:
    """cluster, n, first: the number of documents of each cluster and the least of them,
    without holding a cluster in one row."""
    name = F.lit("ALL") if key is None else F.coalesce(key.cast("string"), F.lit("UNKNOWN"))
    return documents.groupBy(name.alias("cluster")).agg(F.count(document).alias("n"), F.min(document).alias("first"))


def execute_plan(chunks: DataFrame, plan: DataFrame, per_doc: int = 5, *, by: Sequence[str] = ("chunk_index", "chunk_id")) -> DataFrame:
    """The first chunks of each document of the plan, and no other document's: the join
    is the boundary, so a chunk of another document can't leak in."""
    return per_document(chunks.join(plan.select("document_id").distinct(), "document_id", "left_semi"), per_doc, by=by)


def plan_json(plan: DataFrame) -> DataFrame:
    """One row: the plan as JSON, seeds and expanded documents sorted, and the provenance
    of the latter. A plan holds what one prompt is made from."""
    ids = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("document_id"))))
    origin = F.struct("document_id", "source_document_id", "relation_type")
    made = F.struct(
        ids("seed").alias("seed_document_ids"), ids("expanded").alias("expanded_document_ids"),
        F.sort_array(F.collect_set(F.when(F.col("role") == "expanded", origin))).alias("expansion_metadata"),
    )
    return plan.agg(F.to_json(made).alias("plan"))


HIT_COLUMNS = ("document_id", "chunk_id", "text", "score", "position")


def hybrid(hits: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, question: str, repo: str | Column, per_doc: int = 10) -> DataFrame:
    """Chunks of a code question's answer: document_id, chunk_id, text, score, role (hit
    or graph) and position (in the document).

    hits: ranked chunks (rank, document_id, chunk_id, text, score, canonical_id), those
    without a document left out. The graph is entered at the longest canonical id of the
    hits; the documents in the repository of the hits' ids and of the neighbours that the
    question asks for add their first chunks, unless a hit is theirs."""
    own = hits.where("document_id is not null")
    seeds = own.where("canonical_id is not null").select("canonical_id").distinct()
    start = start_node(seeds).select(F.lit(0).alias("question_id"), F.lit(question).alias("question"), F.col("canonical_id").alias("start"))
    ids = seeds.unionByName(traverse_for(edges, start).select(F.col("node").alias("canonical_id"))).distinct()
    there = nodes.where((F.col("repo_id") == repo) & F.col("document_id").isNotNull()).join(ids, "canonical_id", "left_semi").select("document_id").distinct()
    missing = there.join(own.select("document_id"), "document_id", "left_anti")
    return _with_fetched(own, chunks, missing, per_doc, "graph")


def _with_fetched(own: DataFrame, chunks: DataFrame, missing: DataFrame, per_doc: int, role: str) -> DataFrame:
    """The hits by rank, and the first chunks of the missing documents with the score 1."""
    place = F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))
    extra = chunks.join(missing, "document_id", "left_semi").withColumn("position", place).where(F.col("position") <= per_doc).withColumn("score", F.lit(1.0))
    rank = F.row_number().over(W.partitionBy("document_id").orderBy("rank"))
    hits = own.withColumn("doc_rank", F.min("rank").over(W.partitionBy("document_id"))).withColumn("position", rank)
    return hits.select(*HIT_COLUMNS, F.lit("hit").alias("role"), F.col("doc_rank").cast("int").alias("doc_rank")).unionByName(
        extra.select(*HIT_COLUMNS, F.lit(role).alias("role"), F.lit(None).cast("int").alias("doc_rank"))
    )


def _assembled(found: DataFrame, budget: int, per_doc: int, keep: Column | None) -> DataFrame:
    """Rows of an answer, in their order: the first chunks of each document, the caller's
    predicate; in_context says which lie before the token budget's end. Documents come
    by their best hit, then the fetched ones by id."""
    rows = per_document(found, per_doc, by=("position",))
    rows = rows if keep is None else rows.where(keep)
    order = W.orderBy(F.col("doc_rank").isNull(), "doc_rank", "document_id", "position")  # one prompt's chunks
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("tokens", token_count(F.col("text")).cast("long"))
    total = F.sum("tokens").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("place", "document_id", "chunk_id", "role", "tokens", "text").withColumn("in_context", total <= budget)


def run_rag(hits: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, question: str, repo: str | Column, *, per_doc: int = 5, budget: int = 4096, keep: Column | None = None) -> DataFrame:
    """What answers a code question: one row per chunk (place, document_id, chunk_id,
    role, tokens, text, in_context). The context is the rows in_context, joined; the
    sources are the document_id of all rows, repeats and rows beyond the budget among
    them. `generate` makes the answer."""
    return _assembled(hybrid(hits, nodes, edges, chunks, question, repo), budget, per_doc, keep)


def run_simple_rag(hits: DataFrame, edges: DataFrame, chunks: DataFrame, *, per_doc: int = 5, budget: int = 2048, keep: Column | None = None) -> DataFrame:
    """What answers a question on documents: the hits (their search leaves code out), and
    three chunks of each document that a hit's document DEFINES. Rows as in run_rag; the
    sources are its distinct documents in order. Only the hits' documents are ordered by
    rank, as there."""
    own = hits.where("document_id is not null")
    expanded = expand_once(edges, own.select("document_id"), ["DEFINES"]).select("document_id")
    found = _with_fetched(own, chunks, expanded.join(own.select("document_id"), "document_id", "left_anti"), 3, "expanded")
    return _assembled(found, budget, per_doc, keep)


def generate(context: str, question: str, provider: str | None = None, *, call: Callable[[str], str] | None = None) -> str:
    """The answer of the model behind `call` to the prompt; without one, the prompt. Any
    other provider than the known one is an error."""
    if provider not in (None, PROVIDER):
        raise ValueError(f"Unsupported LLM provider: {provider}")
    text = f"Context:\n{context}\n\nQuestion:\n{question}"
    return call(text) if call else text


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """reachable() in both directions, each node at its least distance."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation_type"))
    return reachable(both, starts, depth=depth)
