"""Registered queries of the artifact-graph and retrieval operators over the driver's
tables, and their DuckDB SQL. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import catalog, chunking, graph, retrieval, vectors
from ..runtime import ship, table
from ..sources import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- the chunk table, made from the embeddings

def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    metadata = F.to_json(F.struct(F.col("label").cast("string").alias("label"), F.when(F.col("vec_id") % 3 == 0, "code").otherwise("file").alias("source_type")))
    return e.select(
        F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 17 != 0, F.col("vec_id") % 50).alias("document_id"),
        F.floor(F.col("vec_id") / 50).cast("int").alias("chunk_index"), "embedding", metadata.alias("source_metadata"),
        F.col("label").cast("string").alias("ingestion_id"), F.lit(None).cast("string").alias("provider"),
    )


CHUNKS = """chunks AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 17 <> 0 THEN vec_id % 50 END AS document_id,
  CAST(floor(vec_id / 50) AS INT) AS chunk_index, embedding, label::VARCHAR AS label,
  CASE WHEN vec_id % 3 = 0 THEN 'code' ELSE 'file' END AS source_type FROM embeddings)"""

#: A fixed query vector of 64 components, so that no row has to be fetched first.
QUERY = [((7 * i) % 13 - 6) / 10 for i in range(64)]
VECTOR = f"[{', '.join(map(str, QUERY))}]::FLOAT[]"
SCORED = f"{CHUNKS}, scored AS (SELECT *, list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[]) AS score FROM chunks)"


def _hit(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", F.round("score", 5).alias("score"))


def _query():
    return vectors.literal_vector(QUERY)


@query(f"WITH {SCORED} SELECT chunk_id, round(score, 5) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 10")
def vector_top_k(spark, sf):
    return _hit(vectors.top_k(_chunks(spark, sf), _query(), 10))


@query(f"WITH {SCORED} SELECT chunk_id, round(score, 5) AS score FROM scored WHERE source_type <> 'code' AND label IN ('1', '2', '3') ORDER BY scored.score DESC, chunk_id LIMIT 10")
def vector_top_k_filtered(spark, sf):
    return _hit(vectors.top_k(_chunks(spark, sf), _query(), 10, where={"source_type": {"ne": "code"}, "label": {"in": [1, 2, 3]}}))


@query(f"WITH {SCORED} SELECT chunk_id, round(score, 5) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 5")
def vector_top_k_fallback(spark, sf):
    return _hit(vectors.top_k_or_all(_chunks(spark, sf), _query(), 5, {"source_type": "absent"}))


@query(f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS p FROM chunks WHERE document_id IS NOT NULL)
SELECT document_id, chunk_id, 1.0::DOUBLE AS score FROM r WHERE p <= 3""")
def chunks_by_document(spark, sf):
    return vectors.first_k_of_documents(_chunks(spark, sf), None, 3).select("document_id", "chunk_id", "score")


@query("SELECT event_id, json_extract_string(props, '$.k') AS n FROM events WHERE json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k') <> '1'")
def metadata_not_equal(spark, sf):
    value = lambda k: X.json_text(F.col("props"), k)
    return table(spark, sf, "events").where(vectors.metadata_filter({"k": {"ne": 1}}, value)).select("event_id", value("k").alias("n"))


@query(f"WITH {CHUNKS} SELECT 'vectors' AS target, count(*) AS n FROM chunks WHERE label <> '3' UNION ALL SELECT 'vector_chunks', count(document_id) FROM chunks WHERE label <> '3'")
def dual_write_and_delete(spark, sf):
    legacy, live = vectors.split_writes(_chunks(spark, sf))
    count = lambda df, name: vectors.delete_ingestion(df, "3").agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n")
    return count(legacy, "vectors").unionByName(count(live, "vector_chunks"))


# --- chunkers

@query("""SELECT doc_id, CAST(i // 900 AS INT) AS chunk_index, substr(text, (i + 1)::INT, 1000) AS chunk_text
FROM documents, LATERAL (SELECT unnest(range(0, length(text), 900)) AS i) WHERE length(text) > 0""")
def chunks_simple(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_table(docs, key="doc_id", made=lambda t: chunking.fixed_chars(t, 1000, 100))


def _fold_sql(parts: str, size: int, joiner: str) -> str:
    state = "{'d': []::VARCHAR[], 'b': ''}"
    return f"""WITH p AS (SELECT doc_id, {parts} AS parts FROM documents),
f AS (SELECT doc_id, list_reduce(list_transform(parts, lambda x: {{'d': []::VARCHAR[], 'b': x}}), lambda a, s:
  CASE WHEN length(a.b) + length(s.b) > {size} THEN {{'d': CASE WHEN a.b <> '' THEN list_append(a.d, a.b) ELSE a.d END, 'b': s.b}}
       ELSE {{'d': a.d, 'b': CASE WHEN a.b = '' THEN s.b ELSE a.b || {joiner} || s.b END}} END, {state}) AS r FROM p),
c AS (SELECT doc_id, CASE WHEN r.b <> '' THEN list_append(r.d, r.b) ELSE r.d END AS chunks FROM f)
SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, chunks[i] AS chunk_text FROM c, LATERAL (SELECT unnest(range(1, len(chunks) + 1)) AS i)"""


@query(_fold_sql(r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30))", 500, "' '"))
def chunks_sentence(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_table(docs, key="doc_id", made=lambda t: chunking.sentences(t, 500))


@query(_fold_sql(r"list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')", 500, "chr(10) || chr(10)"))
def chunks_paragraph(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_table(docs, key="doc_id", made=lambda t: chunking.paragraphs(t, 500))


@query("SELECT doc_id, CASE WHEN length(text) < 2000 THEN 'sentence' WHEN length(text) < 10000 THEN 'paragraph' ELSE 'simple' END AS chunk_strategy FROM documents")
def chunk_strategy(spark, sf):
    return table(spark, sf, "documents").select("doc_id", chunking.chosen_strategy(F.col("text")).alias("chunk_strategy"))


# --- scalars and embeddings

@query(r"""SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
  substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS repo_id
FROM (SELECT page_id, url, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(regexp_replace(rtrim(lower(trim(url)), '/'), '\.git$', ''))) AS h FROM pages)""")
def identity_scalars(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slug(F.col("url")).alias("slug"), X.repo_id(F.col("url")).alias("repo_id"))


@query("SELECT doc_id, length(text)::DOUBLE AS x, (length(text) % 10)::DOUBLE AS y, 1.0::DOUBLE AS z FROM documents")
def mock_embedding(spark, sf):
    v = vectors.mock_embedding(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *(v[i].cast("double").alias(n) for i, n in enumerate("xyz")))


# --- the graph, made from the TPC-H hierarchy

def _edges(spark, sf) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    ref = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c))
    edge = lambda df, a, b, rel: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("relation_type"))
    out = edge(t("nation"), ref("region", "n_regionkey"), ref("nation", "n_nationkey"), "DEFINES")
    out = out.unionByName(edge(t("customer"), ref("nation", "c_nationkey"), ref("customer", "c_custkey"), "DEFINES"))
    out = out.unionByName(edge(t("supplier"), ref("nation", "s_nationkey"), ref("supplier", "s_suppkey"), "DEFINES"))
    calls = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return out.unionByName(edge(calls, ref("customer", "o_custkey"), ref("supplier", "l_suppkey"), "CALL"))


EDGES = """edges AS (SELECT 'region/' || n_regionkey AS src, 'nation/' || n_nationkey AS dst, 'DEFINES' AS relation_type FROM nation
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 'DEFINES' FROM customer
  UNION ALL SELECT 'nation/' || s_nationkey, 'supplier/' || s_suppkey, 'DEFINES' FROM supplier
  UNION ALL SELECT DISTINCT 'customer/' || o_custkey, 'supplier/' || l_suppkey, 'CALL' FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def _starts(spark, sf):
    return table(spark, sf, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("start"))


@query(f"""WITH RECURSIVE {EDGES}, reach(start, node, distance) AS (SELECT 'region/' || r_regionkey, 'region/' || r_regionkey, 0 FROM region
  UNION SELECT r.start, e.dst, r.distance + 1 FROM reach r JOIN edges e ON e.src = r.node WHERE r.distance < 3)
SELECT start, node, min(distance) AS distance FROM reach WHERE node <> start GROUP BY start, node""")
def graph_reachable(spark, sf):
    return graph.reachable(_edges(spark, sf), _starts(spark, sf), depth=3)


_CYCLE = "cycle AS (SELECT vec_id AS s, (7 * vec_id + 1) % n AS d FROM embeddings, (SELECT count(*) AS n FROM embeddings) UNION ALL SELECT vec_id, (vec_id + 13) % n FROM embeddings, (SELECT count(*) AS n FROM embeddings))"


@query(f"""WITH RECURSIVE {_CYCLE}, reach(start, node, distance) AS (SELECT vec_id, vec_id, 0 FROM embeddings WHERE label = 0
  UNION SELECT r.start, d, r.distance + 1 FROM reach r JOIN cycle ON s = r.node WHERE r.distance < 3)
SELECT start, node, min(distance) AS distance FROM reach WHERE node <> start GROUP BY start, node""")
def graph_reachable_cycle(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    both = e.crossJoin(F.broadcast(n))  # one row
    kind = F.lit("CALL").alias("relation_type")
    edges = both.select(F.col("vec_id").alias("src"), ((7 * F.col("vec_id") + 1) % F.col("n")).alias("dst"), kind).unionByName(both.select(F.col("vec_id").alias("src"), ((F.col("vec_id") + 13) % F.col("n")).alias("dst"), kind))
    return graph.reachable(edges, e.where("label = 0").select(F.col("vec_id").alias("start")), depth=3)


@query(f"WITH {EDGES} SELECT src, string_agg(dst || ':' || relation_type, ',' ORDER BY dst, relation_type) AS targets FROM edges GROUP BY src")
def graph_adjacency(spark, sf):
    text = F.transform("targets", lambda t: F.concat(t["to"], F.lit(":"), t["relation_type"]))
    return graph.adjacency(_edges(spark, sf)).select("src", F.array_join(text, ",").alias("targets"))


@query(f"""WITH {EDGES}, f AS (SELECT dst, min(src) AS source_document_id FROM edges WHERE relation_type = 'DEFINES' AND src LIKE 'nation/%' GROUP BY dst)
SELECT dst AS document_id, source_document_id, 'DEFINES' AS relation_type FROM f""")
def plan_expansion(spark, sf):
    seeds = table(spark, sf, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("document_id"))
    return retrieval.expand_once(_edges(spark, sf), seeds, ["DEFINES"])


@query(f"""WITH {EDGES}, q AS (SELECT c_custkey AS question_id, 'customer/' || c_custkey AS start, CASE c_custkey % 4 WHEN 0 THEN 'who calls it' WHEN 1 THEN 'list methods' WHEN 2 THEN 'what does X call' ELSE 'tell me more' END AS question FROM customer),
t AS (SELECT *, CASE question WHEN 'who calls it' THEN 'define' WHEN 'list methods' THEN 'define' WHEN 'what does X call' THEN 'call' ELSE 'both' END AS k FROM q)
SELECT DISTINCT question_id, dst AS node FROM t JOIN edges ON src = start WHERE (k IN ('define', 'both') AND relation_type = 'DEFINES') OR (k IN ('call', 'both') AND relation_type = 'CALL')""")
def question_traversal(spark, sf):
    pick = F.col("c_custkey") % 4
    question = F.when(pick == 0, "who calls it in X").when(pick == 1, "list methods").when(pick == 2, "what does X call").otherwise("tell me more")
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("customer/"), "c_custkey").alias("start"), question.alias("question"))
    return retrieval.traverse_for(_edges(spark, sf), asked)


# --- pages as artifacts: image to the text that follows

_ARTIFACTS = "a AS (SELECT conv_id, turn, role = 'assistant' AS image FROM conversations)"


@query(f"""WITH {_ARTIFACTS}, i AS (SELECT conv_id, turn, (SELECT min(t.turn) FROM a t WHERE t.conv_id = a.conv_id AND NOT t.image AND t.turn > a.turn) AS nxt FROM a WHERE image)
SELECT conv_id, turn, nxt AS text_turn FROM i""")
def image_to_text(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "image").otherwise("text").alias("type"), F.col("turn").alias("artifact_id"))
    return graph.following_text(c, ["conv_id"], "turn").where("type = 'image'").select("conv_id", "turn", F.col("text_id").alias("text_turn"))


# --- context assembly

@query(r"""WITH t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS tokens FROM conversations),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM t) SELECT * FROM r WHERE total <= 120""")
def token_budget(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return retrieval.within_budget(c, 120, context=["conv_id"], by=["turn"]).drop("text")


@query("SELECT conv_id AS document_id, CASE WHEN length(c) > 4000 THEN substr(c, 1, 4000) || '...' ELSE c END AS context_text FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS c FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p <= 5 GROUP BY conv_id)")
def summary_context(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("turn").alias("chunk_id"), "text")
    return retrieval.summary_context(c)


@query("SELECT coalesce(quality::VARCHAR, 'UNKNOWN') AS cluster, count(*) AS n, min(d.doc_id) AS first FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id GROUP BY 1")
def document_clusters(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return retrieval.cluster_sizes(docs, F.col("quality"), document="doc_id")


# --- catalogue and maintenance

@query("SELECT source AS repo_id, count(doc_id) AS n_nodes, count(DISTINCT lang) AS n_files FROM documents GROUP BY source")
def repo_rollup(spark, sf):
    d = table(spark, sf, "documents")
    return catalog.repo_rollup(d.select(F.col("source").alias("repo_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("relative_path")))


_STATUS = "CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"


@query(f"""WITH e AS (SELECT user_id, {_STATUS} AS status, ts, event_id FROM events)
SELECT user_id AS ingestion_id, arg_max(status, event_id) AS status, min(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status IN ('completed', 'failed')) AS finished_at
FROM e WHERE status IS NOT NULL GROUP BY user_id""")
def ingestion_states(spark, sf):
    e = table(spark, sf, "events")
    status = F.expr(_STATUS)
    rows = e.select(F.col("user_id").alias("ingestion_id"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("error"))
    return catalog.ingestion_states(rows).drop("error")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def keep_last(spark, sf):
    return graph.keep_last(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def merge_upsert(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = old.where("o_custkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    return catalog.merged(old, new, ["o_orderkey"]).drop("o_custkey")


@query(f"WITH {EDGES} SELECT src, dst, relation_type FROM edges WHERE NOT (src LIKE 'nation/1%' OR dst LIKE 'nation/1%')")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("document_id")).where("document_id like 'nation/1%'")
    none = spark.createDataFrame([], "document_id string")
    return catalog.without_nodes(_edges(spark, sf), none, gone)[0]


# --- extraction (rows only: parsers)

@query()
def page_sections(spark, sf):
    ship(spark)
    pages = extract.pages_as_markdown(table(spark, sf, "pages"))
    files = pages.select(F.concat(F.lit("page"), F.col("page_id"), F.lit(".md")).alias("relative_path"), F.col("markdown").alias("source"))
    return extract.extracted(files).select("relative_path", "seq", "artifact_type", "id", "name", "parent_id")
