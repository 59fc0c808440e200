"""Queries from a question to its context: plans, budgets, prompts and whole answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval, vectors
from ..runtime import ship, table
from .queries import CHUNKS, QUERY, VECTOR, _chunks, query
from .repository import EDGES, duck, made

# --- plans

SEEDS = "SELECT 'nation/' || n_nationkey AS document_id FROM {nation} WHERE n_regionkey < 3 UNION ALL SELECT 'customer/7'"
_P = f"""WITH edges AS ({duck(EDGES)}), seeds AS ({duck(SEEDS)}), step AS (SELECT dst, min((src, relation_type)) AS first FROM edges WHERE src IN (FROM seeds) AND relation_type IN ('DEFINES', 'CALL') GROUP BY dst),
plan AS (SELECT document_id, 'seed' AS role, NULL AS source_document_id, NULL AS relation_type FROM seeds UNION ALL SELECT dst, 'expanded', first[1], first[2] FROM step WHERE dst NOT IN (FROM seeds))"""


def _plan(spark, sf):
    seeds = made(spark, sf, SEEDS)
    return retrieval.plan_rows(seeds, retrieval.expand_once(made(spark, sf, EDGES), seeds, ["DEFINES", "CALL"]))


@query(f"{_P} SELECT * FROM plan")
def retrieval_plan(spark, sf):
    return _plan(spark, sf)


@query(f"""{_P} SELECT '{{"seed_document_ids":[' || (SELECT string_agg('"' || document_id || '"', ',' ORDER BY document_id) FROM plan WHERE role = 'seed') || '],"expanded_document_ids":[' || (SELECT string_agg('"' || document_id || '"', ',' ORDER BY document_id) FROM plan WHERE role = 'expanded') || '],"expansion_metadata":[' ||
(SELECT string_agg('{{"document_id":"' || document_id || '","source_document_id":"' || source_document_id || '","relation_type":"' || relation_type || '"}}', ',' ORDER BY document_id) FROM plan WHERE role = 'expanded') || ']}}' AS plan""")
def plan_as_json(spark, sf):
    return retrieval.plan_json(_plan(spark, sf))


@query(f"{_P} SELECT document_id, o_orderkey AS chunk_id FROM (SELECT p.document_id, o_orderkey, row_number() OVER (PARTITION BY p.document_id ORDER BY o_orderkey) AS r FROM plan p JOIN orders ON p.document_id = 'customer/' || o_custkey) WHERE r <= 5")
def executed_plan(spark, sf):
    chunks = table(spark, sf, "orders").select(F.concat(F.lit("customer/"), "o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id"))
    return retrieval.execute_plan(chunks, _plan(spark, sf), by=("chunk_id",))


@query(f"WITH RECURSIVE edges AS ({duck(EDGES)}), walk(src, node, d) AS (SELECT 'nation/' || n_nationkey, 'nation/' || n_nationkey, 0 FROM nation UNION SELECT w.src, e.dst, d + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE d < 2) SELECT DISTINCT node AS document_id FROM walk WHERE d > 0")
def expansion_depth_two(spark, sf):
    seeds = table(spark, sf, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("document_id"))
    return retrieval.expand(made(spark, sf, EDGES), seeds, depth=2).select("document_id")


# --- orders, caps and prompts

_CONV = "SELECT conv_id AS document_id, turn AS chunk_id, turn AS chunk_index, text FROM {conversations}"


@query("SELECT c_nationkey AS document_id, c_custkey AS chunk_id, min(c_custkey * 7 % 1009) OVER (PARTITION BY c_nationkey) AS doc_rank FROM customer")
def document_order(spark, sf):
    hits = table(spark, sf, "customer").select(F.col("c_nationkey").alias("document_id"), F.col("c_custkey").alias("chunk_id"), (F.col("c_custkey") * 7 % 1009).alias("rank"))
    return retrieval.document_order(hits).drop("rank")


@query("SELECT o_custkey AS document_id, min(o_orderkey) AS position FROM orders GROUP BY o_custkey")
def ordered_distinct(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("position"))
    return retrieval.ordered_distinct(rows, "document_id", "position")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p <= 1")
def chunk_cap_of_zero(spark, sf):
    return retrieval.at_most(table(spark, sf, "conversations").select("conv_id", "turn"), 0, context=["conv_id"], by=["turn"])


@query(r"""WITH c AS (SELECT conv_id AS document_id, turn, role, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
k AS (SELECT *, sum(tokens) OVER (PARTITION BY document_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM c WHERE p <= 5 AND role <> 'system'), b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY turn) AS q FROM k WHERE total <= 90)
SELECT document_id, turn AS chunk_id, tokens, total FROM b WHERE q <= 3""")
def prepared_chunks(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_id"), F.col("turn").alias("chunk_index"), "role", "text")
    found = retrieval.prepare(c, context=["document_id"], by=["chunk_index"], keep=F.col("role") != "system", budget=90, cap=3)
    return found.select("document_id", "chunk_id", "tokens", "total")


@query("SELECT canonical_id FROM (SELECT n_name AS canonical_id FROM nation UNION SELECT c_name FROM customer) ORDER BY length(canonical_id) DESC, canonical_id LIMIT 1")
def start_node(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("canonical_id")).unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("canonical_id")))
    return retrieval.start_node(names)


@query(r"SELECT conv_id, turn, 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question:' || chr(10) || role AS prompt, '[' || conv_id || '/' || turn || '] ' || text AS part, '[SUMMARY:' || conv_id || '] ' || text AS summary FROM conversations")
def prompts(spark, sf):
    doc = F.col("conv_id").cast("string")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.prompt(F.col("text"), F.col("role")).alias("prompt"), X.prompt_part(doc, F.col("turn").cast("string"), F.col("text")).alias("part"), X.summary_part(doc, F.col("text")).alias("summary"))


@query("SELECT string_agg(x, chr(10) || chr(10) ORDER BY kind, p) AS prompt FROM (SELECT 0 AS kind, r_regionkey AS p, '[SUMMARY:' || r_regionkey || '] ' || r_name AS x FROM region UNION ALL SELECT 1, n_nationkey, '[' || n_regionkey || '/' || n_nationkey || '] ' || n_name FROM nation)")
def agent_prompt(spark, sf):
    summaries = table(spark, sf, "region").select(F.col("r_regionkey").alias("document_id"), F.col("r_name").alias("summary"))
    chunks = table(spark, sf, "nation").select(F.col("n_regionkey").alias("document_id"), F.col("n_nationkey").alias("chunk_id"), F.col("n_name").alias("text"))
    return retrieval.agent_prompt(summaries, chunks, position="chunk_id")


# --- the keyword rules, in both engines

_ASKED = "SELECT c_custkey AS question_id, 'customer/' || c_custkey AS start, CASE c_custkey % 6 WHEN 0 THEN 'List METHODS' WHEN 1 THEN 'who calls X' WHEN 2 THEN 'what does X call' WHEN 3 THEN 'what does it import' WHEN 4 THEN 'what uses import X' ELSE 'tell me more' END AS question FROM {customer}"


@query(f"""WITH edges AS ({duck(EDGES)}), q AS ({duck(_ASKED)}),
k AS (SELECT *, CASE WHEN lower(question) LIKE '%method%' OR lower(question) LIKE '%function%' OR lower(question) LIKE '%class%' OR lower(question) LIKE '%in%' THEN 'define'
  WHEN lower(question) LIKE '%callers%' OR lower(question) LIKE '%calls%' OR lower(question) LIKE '%called by%' OR lower(question) LIKE '%who calls%' THEN 'callers'
  WHEN lower(question) LIKE '%call%' THEN 'call' WHEN lower(question) LIKE '%import%' THEN 'import' ELSE 'both' END AS k FROM q)
SELECT DISTINCT question_id, node FROM (SELECT question_id, start, dst AS node FROM k JOIN edges ON src = start AND ((k IN ('define', 'both') AND relation_type = 'DEFINES') OR (k IN ('call', 'both') AND relation_type = 'CALL'))
UNION ALL SELECT question_id, start, src FROM k JOIN edges ON dst = start AND ((k = 'callers' AND relation_type = 'CALL') OR (k = 'import' AND relation_type = 'IMPORT'))) WHERE node <> start""")
def keyword_traversal(spark, sf):
    return retrieval.traverse_for(made(spark, sf, EDGES), made(spark, sf, _ASKED))


# --- vectors

@query(f"""WITH {CHUNKS}, q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE label = 1),
s AS (SELECT query_id, chunk_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM chunks, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, chunk_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 5) AS score FROM r WHERE rank <= 3""")
def top_k_for_queries(spark, sf):
    ship(spark)
    asked = table(spark, sf, "embeddings").where("label = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vectors.top_k_for_queries(_chunks(spark, sf), asked, 3)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 5).alias("score"))


# --- whole answers

_TEXT = "'chunk ' || chunk_id || ' of ' || coalesce(document_id::VARCHAR, 'none')"
_EDGE_SQL = "SELECT vec_id AS s, (7 * vec_id + 1) % 50 AS d, CASE WHEN vec_id % 2 = 0 THEN 'DEFINES' ELSE 'CALL' END AS r FROM embeddings WHERE vec_id < 50"
_HITS = f"""{CHUNKS}, c AS (SELECT *, {_TEXT} AS text, 'n' || (document_id * 37 % 50) AS canonical_id FROM chunks), scored AS (SELECT *, list_cosine_similarity(embedding::DOUBLE[], {VECTOR}::DOUBLE[]) AS score FROM c)"""
_TAIL = r"""first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY position) AS p FROM found) WHERE p <= 5),
placed AS (SELECT row_number() OVER (ORDER BY doc_rank NULLS LAST, document_id, position) AS place, * FROM first),
answer AS (SELECT CAST(place AS INT) AS place, document_id, chunk_id, role, len(string_split(text, ' '))::BIGINT AS tokens FROM placed)
SELECT place, document_id, chunk_id, role, tokens, sum(tokens) OVER (ORDER BY place) <= {budget} AS in_context FROM answer"""


def _hits(spark, sf, k, where, fall_back):
    chunks = _texts(spark, sf)
    ask = vectors.literal_vector(QUERY)
    found = vectors.top_k_or_all(chunks, ask, k, where) if fall_back else vectors.top_k(chunks, ask, k, where=where)
    return chunks, vectors.ranked(found)


def _texts(spark, sf):
    c = _chunks(spark, sf)
    text = F.concat(F.lit("chunk "), "chunk_id", F.lit(" of "), F.coalesce(F.col("document_id").cast("string"), F.lit("none")))
    return c.withColumn("text", text).withColumn("canonical_id", F.concat(F.lit("n"), F.col("document_id") * 37 % 50))


def _graph(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id < 50")
    return e.select(F.col("vec_id").alias("s"), ((7 * F.col("vec_id") + 1) % 50).alias("d"), F.when(F.col("vec_id") % 2 == 0, "DEFINES").otherwise("CALL").alias("relation_type"))


@query(f"""WITH {_HITS}, edges AS ({_EDGE_SQL}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY scored.score DESC, chunk_id) AS rank FROM scored WHERE source_type = 'code') WHERE rank <= 20 AND document_id IS NOT NULL),
start AS (SELECT canonical_id FROM hits ORDER BY length(canonical_id) DESC, canonical_id LIMIT 1),
near AS (SELECT 'n' || d AS canonical_id FROM edges JOIN start ON 'n' || s = canonical_id WHERE s <> d),
ids AS (SELECT canonical_id FROM hits UNION SELECT canonical_id FROM near),
docs AS (SELECT vec_id AS document_id FROM embeddings WHERE vec_id < 50 AND vec_id % 5 <> 4 AND 'n' || vec_id IN (FROM ids)),
missing AS (SELECT document_id FROM docs WHERE document_id NOT IN (SELECT document_id FROM hits)),
fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS position FROM c WHERE document_id IN (FROM missing)) WHERE position <= 10),
found AS (SELECT document_id, chunk_id, text, 'hit' AS role, row_number() OVER (PARTITION BY document_id ORDER BY rank) AS position, min(rank) OVER (PARTITION BY document_id) AS doc_rank FROM hits
  UNION ALL SELECT document_id, chunk_id, text, 'graph', position, NULL FROM fetched), {_TAIL.format(budget=60)}""")
def rag_answer(spark, sf):
    chunks, hits = _hits(spark, sf, 20, {"source_type": "code"}, True)
    edges = _graph(spark, sf).select(F.concat(F.lit("n"), "s").alias("src"), F.concat(F.lit("n"), "d").alias("dst"), "relation_type")
    nodes = table(spark, sf, "embeddings").where("vec_id < 50").select(F.col("vec_id").alias("document_id"), F.concat(F.lit("n"), "vec_id").alias("canonical_id"), F.when(F.col("vec_id") % 5 == 4, "other").otherwise("mine").alias("repo_id"))
    return retrieval.run_rag(hits, nodes, edges, chunks, "tell me more", "mine", budget=60).drop("text")


@query(f"""WITH {_HITS}, edges AS ({_EDGE_SQL}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY scored.score DESC, chunk_id) AS rank FROM scored WHERE source_type <> 'code') WHERE rank <= 20 AND document_id IS NOT NULL),
missing AS (SELECT DISTINCT d AS document_id FROM edges WHERE r = 'DEFINES' AND s IN (SELECT document_id FROM hits) AND d NOT IN (SELECT document_id FROM hits)),
fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS position FROM c WHERE document_id IN (FROM missing)) WHERE position <= 3),
found AS (SELECT document_id, chunk_id, text, 'hit' AS role, row_number() OVER (PARTITION BY document_id ORDER BY rank) AS position, min(rank) OVER (PARTITION BY document_id) AS doc_rank FROM hits
  UNION ALL SELECT document_id, chunk_id, text, 'expanded', position, NULL FROM fetched), {_TAIL.format(budget=50)}""")
def simple_rag_answer(spark, sf):
    chunks, hits = _hits(spark, sf, 20, {"source_type": {"ne": "code"}}, False)
    edges = _graph(spark, sf).select(F.col("s").alias("src"), F.col("d").alias("dst"), "relation_type")
    return retrieval.run_simple_rag(hits, edges, chunks, budget=50).drop("text")
