"""Catalogue roll-ups, ingestion states, and table maintenance as rewrites.

A maintenance function takes tables and returns their next version; the caller writes
it beside the old one and swaps. There is no atomicity across tables.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_default, repo_title, short_repo_name
from .graph import keep_last

#: The states of an ingestion.
STATES = ("accepted", "running", "completed", "failed")


def repo_rollup(nodes: DataFrame) -> DataFrame:
    """repo_id, n_nodes, n_files, over all nodes of a repository."""
    return nodes.groupBy("repo_id").agg(F.count("document_id").alias("n_nodes"), F.count_distinct("relative_path").alias("n_files"))


def repo_list(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Repositories of completed ingestions with their counts, newest first."""
    done = requests.where("status = 'completed'").select("ingestion_id", "status", "created_at")
    keys = nodes.select("repo_id", "ingestion_id").distinct().join(done, "ingestion_id")
    named = keys.join(repo_rollup(nodes), "repo_id").withColumn("name", short_repo_name(F.col("repo_id"))).withColumn("title", repo_title(F.col("repo_id")))
    return named.orderBy(F.desc("created_at"), "repo_id", "ingestion_id")


def newest_repo(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """The repository that a question without one is about: no row if none is complete."""
    return repo_list(nodes, requests).limit(1)


def ingestion_states(events: DataFrame) -> DataFrame:
    """The present state of each ingestion from its events (ingestion_id, status, at, seq,
    error): the last status, when it started and finished, and the last failure's error.
    One aggregation without a sort; transitions aren't checked."""
    started = F.min(F.when(F.col("status") == "running", F.col("at")))
    ended = F.max(F.when(F.col("status").isin("completed", "failed"), F.col("at")))
    error = F.max_by("error", F.when(F.col("status") == "failed", F.col("seq")))
    return events.where(F.col("status").isin(*STATES)).groupBy("ingestion_id").agg(F.max_by("status", "seq").alias("status"), started.alias("started_at"), ended.alias("finished_at"), error.alias("error"))


def merged(old: DataFrame, new: DataFrame, key: Sequence[str], seq: str | None = None) -> DataFrame:
    """Rows of `old` with those of `new` in place of equal keys, and the other new rows.
    Repeated keys in `new` count once: the greatest `seq`, if it has one."""
    key = list(key)
    fresh = keep_last(new, key, seq).select(old.columns) if seq else new.select(old.columns).dropDuplicates(key)
    return old.join(fresh.select(key), key, "left_anti").select(old.columns).unionByName(fresh)


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upsert on (src, dst, relation_type); new edges without known ends are left out."""
    ids = nodes.select(F.col("document_id").alias("src"))
    known = new.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return merged(old, known, ["src", "dst", "relation_type"])


def without_nodes(edges: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and chunks after the cascade of deleted nodes (document_id)."""
    ids = gone.select("document_id").distinct()
    edges = edges.join(ids.withColumnRenamed("document_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("document_id", "dst"), "dst", "left_anti")
    return edges, chunks.join(ids, "document_id", "left_anti")


def deleted_repo(nodes: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """The nodes without a repository's, and the number of those (0 if it is unknown)."""
    mine = F.coalesce(F.col("repo_id") == repo, F.lit(False))
    return nodes.where(~mine), nodes.where(mine).agg(F.count("*").alias("deleted"))


def resolved_repo(nodes: DataFrame, requests: DataFrame, asked: str | None = None) -> str:
    """The repository that a question is about: the one asked for if it is complete, or
    the newest. Errors: an unknown one, or none at all."""
    found = repo_list(nodes, requests)
    found = found.limit(1) if asked is None else found.where(F.col("repo_id") == asked).limit(1)
    row = found.first()
    if row is None:
        raise LookupError(f"unknown repository: {asked}" if asked is not None else "no repository has been ingested")
    return row["repo_id"]


def request_status(requests: DataFrame, ingestion_id: str) -> DataFrame:
    """The row of an ingestion: an error if the id is no UUID or unknown."""
    if not re.fullmatch(r"(?i)[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", ingestion_id):
        raise ValueError(f"no UUID: {ingestion_id}")
    found = requests.where(F.col("ingestion_id") == ingestion_id)
    if found.isEmpty():
        raise LookupError(f"unknown ingestion: {ingestion_id}")
    return found


def rebuilt(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, repo: str, fresh: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A repository's nodes replaced; what hung on the old ones goes with them."""
    mine = F.coalesce(F.col("repo_id") == repo, F.lit(False))
    edges, chunks = without_nodes(edges, chunks, nodes.where(mine))
    return nodes.where(~mine).unionByName(fresh), edges, chunks


def with_node_defaults(nodes: DataFrame) -> DataFrame:
    """Title, type and source of nodes that lack them, and the repository of loose ones."""
    fill = {"title": "Untitled", "doc_type": "unknown", "summary": "Summary pending"}
    out = nodes
    for name, value in fill.items():
        if name in nodes.columns:
            out = out.withColumn(name, or_default(F.col(name), value))
    if "source" in nodes.columns and "relative_path" in nodes.columns:
        out = out.withColumn("source", or_default(F.col("source"), F.col("relative_path")))
    return out.withColumn("repo_id", F.coalesce("repo_id", "ingestion_id"))


def with_summaries(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries (source, summary) set on the first node of each source."""
    first = nodes.groupBy("source").agg(F.min("document_id").alias("document_id"))
    new = summaries.dropDuplicates(["source"]).join(first, "source").select("document_id", F.col("summary").alias("new_summary"))
    return nodes.join(new, "document_id", "left").withColumn("summary", F.coalesce("new_summary", "summary")).drop("new_summary").select(nodes.columns)


def valid_and_rejected(rows: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a test, and the others; an unknown outcome is a reject."""
    ok = F.coalesce(test, F.lit(False))
    return rows.where(ok), rows.where(~ok)
