"""Artifact graphs as node and edge tables: building, lookup and traversal."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import Scratch

DEFINED = ("CLASS", "FUNCTION", "METHOD", "MARKDOWN_SECTION")
SYMBOLS = ("CLASS", "FUNCTION", "METHOD")


def keep_last(rows: DataFrame, key: Iterable[str], seq: str | Column) -> DataFrame:
    """One row per key: the one with the greatest `seq`."""
    key = list(key)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(*key, "last.*")


def _order(entities: DataFrame) -> Column:
    """The order of entities: by file, then by their place in it."""
    return F.struct("relative_path", "seq") if "relative_path" in entities.columns else F.struct("seq")


def first_by(rows: DataFrame, key: str, seq: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("first")).select(key, "first.*")


def symbol_table(entities: DataFrame) -> DataFrame:
    """name, canonical_id, artifact_type of classes, functions and methods; the last wins."""
    rows = entities.where(F.col("artifact_type").isin(*SYMBOLS)).select("name", "canonical_id", "artifact_type", _order(entities).alias("seq"))
    return keep_last(rows, ["name"], "seq").drop("seq")


def defines_edges(entities: DataFrame) -> DataFrame:
    """from_canonical_id, to_canonical_id: the first entity whose id is the parent's."""
    parents = first_by(entities.select("id", _order(entities).alias("seq"), F.col("canonical_id").alias("from_canonical_id")), "id", "seq").withColumnRenamed("id", "parent_id")
    rows = entities.where(F.col("artifact_type").isin(*DEFINED)).select("parent_id", F.col("canonical_id").alias("to_canonical_id"))
    return rows.join(parents.drop("seq"), "parent_id").select("from_canonical_id", "to_canonical_id")


def ancestors(entities: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, ancestor, distance), the entity itself at 0, at any depth, of all entities or
    of those in `ids` (id). A ring of parents ends where it comes back to an ancestor met
    before."""
    scratch = Scratch(entities.sparkSession)
    links = first_by(entities.select("id", "parent_id", _order(entities).alias("seq")), "id", "seq").where("parent_id is not null and parent_id <> id").select("id", "parent_id")
    level = (entities if ids is None else ids).select("id").distinct().select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    out = level
    up = scratch.write(links.select(F.col("id").alias("ancestor"), F.col("parent_id").alias("above")))
    for d in count(1):
        above = level.join(up, "ancestor").select("id", F.col("above").alias("ancestor"), F.lit(d).alias("distance"))
        level, rows = scratch.counted(above.join(out, ["id", "ancestor"], "left_anti").select("id", "ancestor", "distance"))
        if not rows:
            return out
        out = out.unionByName(level)


def call_edges(entities: DataFrame) -> DataFrame:
    """from (the caller's scope), to and confidence. A call of an enclosing scope's own
    name resolves there (1.0), else to the last symbol of that name (0.5), else not."""
    calls = entities.where("artifact_type = 'CALL'").select("parent_id", "name")
    scopes = first_by(entities.select("id", "name", F.col("canonical_id").alias("scope"), _order(entities).alias("seq")), "id", "seq").drop("seq")
    chain = ancestors(entities, calls.select(F.col("parent_id").alias("id"))).join(scopes.select(F.col("id").alias("ancestor"), F.col("name").alias("scope_name"), "scope"), "ancestor")
    near = calls.join(chain.withColumnRenamed("id", "parent_id"), "parent_id").where("scope_name = name")
    near = near.groupBy("parent_id", "name").agg(F.min_by("scope", "distance").alias("near"))
    far = symbol_table(entities).select("name", F.col("canonical_id").alias("far"))
    callers = scopes.select(F.col("id").alias("parent_id"), F.col("scope").alias("from_canonical_id"))
    rows = calls.join(callers, "parent_id").join(near, ["parent_id", "name"], "left").join(far, "name", "left")
    return rows.select("from_canonical_id", F.coalesce("near", "far").alias("to_canonical_id"), F.when(F.col("near").isNotNull(), 1.0).otherwise(0.5).alias("confidence")).where("to_canonical_id is not null")


def documents_edges(entities: DataFrame) -> DataFrame:
    """Sections to the symbol of their name, exact or else in lower case."""
    symbols = symbol_table(entities).select("name", F.col("canonical_id").alias("target"))
    rows = entities.where("artifact_type = 'MARKDOWN_SECTION'").select("canonical_id", "name").join(symbols, "name", "left")
    lower = symbols.select(F.col("name").alias("lower_name"), F.col("target").alias("lower_target"))
    rows = rows.withColumn("lower_name", F.lower("name")).join(lower, "lower_name", "left")
    return rows.select(F.col("canonical_id").alias("from_canonical_id"), F.coalesce("target", "lower_target").alias("to_canonical_id"), F.col("name").alias("section_name")).where("to_canonical_id is not null")


def repo_edges(entities: DataFrame) -> DataFrame:
    """All edges of a repository's entities, one table. What edges need of the entities
    is written first, since they are read many times and may come from parsed files."""
    used = ("id", "canonical_id", "artifact_type", "name", "parent_id", "relative_path", "seq")
    entities = Scratch(entities.sparkSession).write(entities.select(*(c for c in used if c in entities.columns)))
    named = lambda df, kind, meta: df.select("from_canonical_id", "to_canonical_id", F.lit(kind).alias("relation_type"), meta.alias("metadata"))
    out = named(defines_edges(entities), "DEFINES", F.lit("{}"))
    out = out.unionByName(named(call_edges(entities), "CALL", F.to_json(F.struct("confidence"))))
    doc = F.to_json(F.struct(F.lit("exact_name").alias("match_type"), "section_name", F.lit(1.0).alias("confidence")))
    return out.unionByName(named(documents_edges(entities), "DOCUMENTS", doc))


def with_known_endpoints(edges: DataFrame, nodes: DataFrame, key: str = "canonical_id") -> DataFrame:
    """Edges (src, dst, relation_type) whose ends are both nodes; parallel ones once."""
    ids = nodes.select(F.col(key).alias("src"))
    return edges.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst", "relation_type").distinct()


def dangling(edges: DataFrame, nodes: DataFrame, key: str = "canonical_id") -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select(F.col(key).alias("id")).distinct()
    hit = lambda side: ids.select(F.col("id").alias(side), F.lit(True).alias(f"has_{side}"))
    return edges.join(hit("src"), "src", "left").join(hit("dst"), "dst", "left").where("has_src is null or has_dst is null").select("src", "dst", "relation_type")


def adjacency(edges: DataFrame) -> DataFrame:
    """src and its targets, sorted by target and relation."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("to"), "relation_type"))).alias("targets"))


def touching(edges: DataFrame, document: str, *, outgoing: bool = True, incoming: bool = True) -> DataFrame:
    """Edges of a document in the directions asked for; none asked, none found."""
    test = F.lit(False)
    if outgoing:
        test = test | (F.col("src") == document)
    if incoming:
        test = test | (F.col("dst") == document)
    return edges.where(test)


def of_types(edges: DataFrame, types: Iterable[str] | None) -> DataFrame:
    types = list(types or ())
    return edges.where(F.col("relation_type").isin(*types)) if types else edges


def reachable(edges: DataFrame, starts: DataFrame, *, types: Iterable[str] | None = None, direction: str = "out", depth: int = 3, known: DataFrame | None = None) -> DataFrame:
    """(start, node, distance): nodes at 1 to `depth` steps by breadth, the start left out.

    starts has the column start. With `known` (node ids), unknown starts reach nothing.
    Each level joins the frontier with the edges and drops what was seen; levels are
    written tables, so the plan doesn't grow with the depth.
    """
    if direction not in ("out", "in"):
        raise ValueError(f"direction must be out or in: {direction}")
    scratch = Scratch(edges.sparkSession)
    kept = of_types(edges, types)
    steps = kept.select(F.col("src" if direction == "out" else "dst").alias("node"), F.col("dst" if direction == "out" else "src").alias("next")).distinct()
    steps = scratch.write(steps) if depth > 1 else steps  # else each level would make them anew
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")).distinct()
    if known is not None:
        seen = seen.join(known.select(F.col(known.columns[0]).alias("node")), "node", "left_semi").select("start", "node", "distance")
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        new = new.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(d))
        if d < depth:
            new = scratch.write(new)
        seen, frontier = seen.unionByName(new), new
    return seen.where("distance > 0")


def calls_from(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return reachable(edges, starts, types=["CALL"], depth=depth)


def defined_by(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return reachable(edges, starts, types=["DEFINES"], depth=depth)


def callers_of(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return reachable(edges, starts, types=["CALL"], direction="in", depth=depth)


def importers_of(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return reachable(edges, starts, types=["IMPORT"], direction="in", depth=depth)


def following_text(artifacts: DataFrame, page: Iterable[str], order: str = "order_index") -> DataFrame:
    """Adds text_id: on each page, the first text after an image, null if none follows."""
    after = W.partitionBy(*page).orderBy(order, "artifact_id").rowsBetween(1, W.unboundedFollowing)
    text = F.first(F.when(F.col("type") == "text", F.col("artifact_id")), ignorenulls=True).over(after)
    return artifacts.withColumn("text_id", F.when(F.col("type") == "image", text))


def page_graph(artifacts: DataFrame) -> DataFrame:
    """Edges of a document's artifacts (artifact_id, type, page_number, order_index): each
    text to its page; each image to the text that follows it there, or to the page."""
    page = F.concat(F.lit("page:"), "page_number")
    linked = following_text(artifacts, ["page_number"])
    kind = F.when(F.col("type") == "text", "text_to_page").when(F.col("text_id").isNotNull(), "image_to_text").otherwise("image_to_page")
    return linked.select(F.col("artifact_id").alias("src"), F.coalesce("text_id", page).alias("dst"), kind.alias("relation_type"))


def with_recognised_text(artifacts: DataFrame) -> DataFrame:
    """Adds a text artifact right after each image whose recognition gave text. Where its
    place is taken, the row with the later place in the list stays."""
    extra = artifacts.where("type = 'image' and ocr_text is not null and ocr_text <> ''").withColumn("type", F.lit("text")).withColumn("text", F.col("ocr_text")).withColumn("order_index", F.col("order_index") + 1).withColumn("late", F.lit(0))
    both = artifacts.withColumn("late", F.lit(1)).unionByName(extra)
    seq = F.struct("order_index", "late")
    return keep_last(both.withColumn("seq", seq), ["page_number", "type", "order_index"], "seq").drop("seq", "late")


def node(nodes: DataFrame, *, document_id: str | None = None, repo_id: str | None = None, canonical_id: str | None = None) -> DataFrame:
    """The node of a document id, or of a repository and canonical id."""
    if document_id is not None:
        return nodes.where(F.col("document_id") == document_id)
    if repo_id is None or canonical_id is None:
        raise ValueError("a document_id, or a repo_id and a canonical_id")
    return nodes.where((F.col("repo_id") == repo_id) & (F.col("canonical_id") == canonical_id))


def labelled_nodes(nodes: DataFrame, ids: Iterable[str], repo: str | Column) -> DataFrame:
    """Nodes of a repository with one of the ids; an empty list gives no rows."""
    ids = list(ids)
    return nodes.where((F.col("repo_id") == repo) & (F.col("canonical_id").isin(*ids) if ids else F.lit(False)))


def chunks_with_nodes(nodes: DataFrame, chunks: DataFrame, by: str = "chunk_index") -> DataFrame:
    """The chunks of the nodes, by title and then in their order: a check of what is
    stored for them."""
    return nodes.join(chunks, "document_id").orderBy("title", by)
