"""Queries of the artifact graph from files to edges and its upkeep. Their small tables
are made by one SQL text that both engines read, from whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, chunking, graph, vectors
from ..runtime import ship, table
from ..sources import extract
from .queries import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "documents", "embeddings", "events", "pages", "conversations", "labels", "lineitem")


def made(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """The table of a SQL text over the driver's tables, each named in braces."""
    named = {t: table(spark, sf, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **named)


def duck(sql: str) -> str:
    """The same text for the other engine."""
    return sql.format(**{t: t for t in TABLES})


# --- entities and edges

ENTITIES = """SELECT *, id AS canonical_id FROM (
SELECT 'n' || n_nationkey || '.py' AS relative_path, cast(0 AS BIGINT) AS seq, 'MODULE' AS artifact_type, 'n' || n_nationkey || '.py' AS id, n_name AS name, cast(NULL AS VARCHAR(99)) AS parent_id FROM {nation}
UNION ALL SELECT 'n' || c_nationkey || '.py', c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CLASS' ELSE 'METHOD' END, 'n' || c_nationkey || '.py#e' || c_custkey,
  CASE WHEN c_custkey % 10 = 0 THEN 'C' || (c_custkey % 7) ELSE 'm' || (c_custkey % 50) END,
  CASE WHEN c_custkey % 10 = 0 THEN 'n' || c_nationkey || '.py' ELSE 'n' || c_nationkey || '.py#e' || (c_custkey - c_custkey % 10) END FROM {customer}
UNION ALL SELECT 'n' || c_nationkey || '.py', 1000000 + o_orderkey, 'CALL', 'n' || c_nationkey || '.py#call:' || o_orderkey, 'm' || (o_orderkey % 60), 'n' || c_nationkey || '.py#e' || c_custkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT 'd.md', s_suppkey, 'MARKDOWN_SECTION', 'd.md#s' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'm' ELSE 'M' END || (s_suppkey % 80), 'd.md' FROM {supplier}) x"""
_E = f"""WITH RECURSIVE e AS ({duck(ENTITIES)}),
symbols AS (SELECT name, canonical_id, artifact_type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY relative_path DESC, seq DESC) AS p FROM e WHERE artifact_type IN ('CLASS', 'FUNCTION', 'METHOD')) WHERE p = 1),
defines AS (SELECT p.canonical_id AS from_canonical_id, e.canonical_id AS to_canonical_id FROM e JOIN e p ON p.id = e.parent_id WHERE e.artifact_type IN ('CLASS', 'METHOD', 'MARKDOWN_SECTION')),
up(id, ancestor, distance) AS (SELECT id, id, 0 FROM e UNION ALL SELECT up.id, e.parent_id, distance + 1 FROM up JOIN e ON e.id = up.ancestor WHERE e.parent_id IS NOT NULL),
near AS (SELECT c.id AS call_id, arg_min(s.id, up.distance) AS near FROM e c JOIN up ON up.id = c.parent_id JOIN e s ON s.id = up.ancestor WHERE c.artifact_type = 'CALL' AND s.name = c.name GROUP BY c.id),
calls AS (SELECT c.parent_id AS from_canonical_id, coalesce(near, symbols.canonical_id) AS to_canonical_id, CASE WHEN near IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence
  FROM e c JOIN e p ON p.id = c.parent_id LEFT JOIN near ON call_id = c.id LEFT JOIN symbols ON symbols.name = c.name WHERE c.artifact_type = 'CALL' AND coalesce(near, symbols.canonical_id) IS NOT NULL),
documents_edges AS (SELECT s.canonical_id AS from_canonical_id, coalesce(a.canonical_id, b.canonical_id) AS to_canonical_id, s.name AS section_name
  FROM e s LEFT JOIN symbols a ON a.name = s.name LEFT JOIN symbols b ON b.name = lower(s.name) WHERE s.artifact_type = 'MARKDOWN_SECTION' AND coalesce(a.canonical_id, b.canonical_id) IS NOT NULL)"""


def _entities(spark, sf):
    return made(spark, sf, ENTITIES)


@query(f"{_E} SELECT * FROM symbols")
def symbol_table(spark, sf):
    return graph.symbol_table(_entities(spark, sf))


@query(f"{_E} SELECT * FROM defines")
def entity_defines(spark, sf):
    return graph.defines_edges(_entities(spark, sf))


@query(f"{_E} SELECT * FROM calls")
def entity_calls(spark, sf):
    return graph.call_edges(_entities(spark, sf))


@query(f"{_E} SELECT * FROM documents_edges")
def section_documents(spark, sf):
    return graph.documents_edges(_entities(spark, sf))


@query(f"""{_E} SELECT from_canonical_id, to_canonical_id, 'DEFINES' AS relation_type, '{{}}' AS metadata FROM defines
UNION ALL SELECT from_canonical_id, to_canonical_id, 'CALL', '{{"confidence":' || confidence || '}}' FROM calls
UNION ALL SELECT from_canonical_id, to_canonical_id, 'DOCUMENTS', '{{"match_type":"exact_name","section_name":"' || section_name || '","confidence":1.0}}' FROM documents_edges""")
def repo_graph_edges(spark, sf):
    return graph.repo_edges(_entities(spark, sf))


#: Files whose entities are known from how they are made.
FILES = """SELECT 'c' || c_custkey || '.py' AS relative_path, 'import os' || chr(10) || 'from a.b import q' || c_custkey || chr(10) || 'class K' || c_custkey || '(Base):' || chr(10) || '    def m(self, x):' || chr(10) || '        return f' || c_custkey || '(x)' || chr(10) || 'def f' || c_custkey || '():' || chr(10) || '    pass' || chr(10) AS source FROM {customer}
UNION ALL SELECT 's' || s_suppkey || '.md', '# Top ' || s_suppkey || chr(10) || 'text' || chr(10) || '## K' || s_suppkey || chr(10) || 'more' || chr(10) || '# Top ' || s_suppkey || chr(10) || 'end' FROM {supplier}
UNION ALL SELECT 'bad' || r_regionkey || '.py', 'def (' FROM {region}"""
_FILES = """SELECT 'c' || c_custkey || '.py' AS f, 'K' || c_custkey AS k, 'f' || c_custkey AS g, 'q' || c_custkey AS q, c_custkey AS n FROM customer"""
_MD = "SELECT 's' || s_suppkey || '.md' AS f, s_suppkey AS n FROM supplier"


@query(f"""WITH c AS ({_FILES}), rows AS (
SELECT f, 0 AS seq, 'MODULE' AS artifact_type, f AS id, 'c' || n AS name, NULL AS parent_id FROM c
UNION ALL SELECT f, 1, 'IMPORT', f || '#import:os', 'os', f FROM c
UNION ALL SELECT f, 2, 'IMPORT', f || '#import:a.b.' || q, q, f FROM c
UNION ALL SELECT f, 3, 'CLASS', f || '#' || k, k, f FROM c
UNION ALL SELECT f, 4, 'METHOD', f || '#' || k || '.m', 'm', f || '#' || k FROM c
UNION ALL SELECT f, 5, 'CALL', f || '#call:' || g, g, f || '#' || k || '.m' FROM c
UNION ALL SELECT f, 6, 'FUNCTION', f || '#' || g, g, f FROM c)
SELECT f AS relative_path, seq, artifact_type, id, id AS canonical_id, name, parent_id,
  CASE artifact_type WHEN 'METHOD' THEN '    def m(self, x):' || chr(10) || '        return f' || substr(f, 2, length(f) - 4) || '(x)' WHEN 'FUNCTION' THEN 'def ' || name || '():' || chr(10) || '    pass' END AS text FROM rows""")
def python_entities(spark, sf):
    ship(spark)
    rows = extract.extracted(made(spark, sf, FILES), {".py": extract.python_artifacts})
    return rows.select("relative_path", "seq", "artifact_type", "id", "canonical_id", "name", "parent_id", F.when(F.col("artifact_type").isin("METHOD", "FUNCTION"), F.col("text")).alias("text"))


@query(f"""WITH c AS ({_MD})
SELECT f AS relative_path, 0 AS seq, 'MARKDOWN_MODULE' AS artifact_type, f AS id, 's' || n AS name, NULL AS parent_id, 'markdown_module' AS doc_type, NULL AS text FROM c
UNION ALL SELECT f, 1, 'MARKDOWN_SECTION', f || '#top_' || n, 'Top ' || n, f, 'markdown_section', '# Top ' || n || chr(10) || 'text' || chr(10) || '## K' || n || chr(10) || 'more' FROM c
UNION ALL SELECT f, 2, 'MARKDOWN_SECTION', f || '#top_' || n || '.k' || n, 'K' || n, f || '#top_' || n, 'markdown_section', '## K' || n || chr(10) || 'more' FROM c
UNION ALL SELECT f, 3, 'MARKDOWN_SECTION', f || '#top_' || n || '_2', 'Top ' || n, f, 'markdown_section', '# Top ' || n || chr(10) || 'end' FROM c""")
def markdown_entities(spark, sf):
    ship(spark)
    rows = extract.extracted(made(spark, sf, FILES), {".md": extract.markdown_artifacts})
    return rows.select("relative_path", "seq", "artifact_type", "id", "name", "parent_id", "doc_type", F.when(F.col("artifact_type") == "MARKDOWN_SECTION", F.col("text")).alias("text"))


@query(f"""WITH c AS ({_FILES}), m AS ({_MD}), e AS (
SELECT f AS from_canonical_id, f || '#' || k AS to_canonical_id, 'DEFINES' AS relation_type FROM c
UNION ALL SELECT f || '#' || k, f || '#' || k || '.m', 'DEFINES' FROM c
UNION ALL SELECT f, f || '#' || g, 'DEFINES' FROM c
UNION ALL SELECT f || '#' || k || '.m', f || '#' || g, 'CALL' FROM c
UNION ALL SELECT f, f || '#top_' || n, 'DEFINES' FROM m UNION ALL SELECT f || '#top_' || n, f || '#top_' || n || '.k' || n, 'DEFINES' FROM m UNION ALL SELECT f, f || '#top_' || n || '_2', 'DEFINES' FROM m
UNION ALL SELECT m.f || '#top_' || m.n || '.k' || m.n, c.f || '#' || c.k, 'DOCUMENTS' FROM m JOIN c ON c.n = m.n) SELECT * FROM e""")
def edges_from_files(spark, sf):
    """From files over entities to edges, all in one."""
    ship(spark)
    return graph.repo_edges(extract.extracted(made(spark, sf, FILES))).drop("metadata")


@query(r"SELECT 'page' || page_id || '.md' AS relative_path, len(regexp_extract_all(html, '<h[1-6][^>]*>'))::BIGINT AS n_sections FROM pages")
def page_section_counts(spark, sf):
    ship(spark)
    pages = extract.pages_as_markdown(table(spark, sf, "pages"))
    files = pages.select(F.concat(F.lit("page"), "page_id", F.lit(".md")).alias("relative_path"), F.col("markdown").alias("source"))
    return extract.extracted(files).groupBy("relative_path").agg(F.count(F.when(F.col("artifact_type") == "MARKDOWN_SECTION", 1)).alias("n_sections"))


@query("SELECT doc_id, text AS source FROM documents")
def decoded_texts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return extract.decoded(docs).select("doc_id", "source")


_NAMES = "SELECT p_partkey, p_name || CASE p_partkey % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.md' WHEN 3 THEN '.csv' WHEN 4 THEN '.docx' WHEN 5 THEN '.tar.GZ' ELSE '' END AS name FROM {part}"


@query(f"""WITH n AS ({duck(_NAMES)}), x AS (SELECT *, CASE p_partkey % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.md' WHEN 3 THEN '.csv' WHEN 4 THEN '.docx' WHEN 5 THEN '.gz' ELSE '' END AS extension FROM n)
SELECT p_partkey, extension, CASE extension WHEN '.pdf' THEN 'pdf' WHEN '.png' THEN 'image' WHEN '.md' THEN 'markdown' WHEN '.csv' THEN 'tabular' ELSE 'text' END AS route,
  CASE extension WHEN '.pdf' THEN 'pdf' WHEN '.png' THEN 'image' WHEN '.md' THEN 'markdown_module' WHEN '.csv' THEN 'tabular' ELSE 'file' END AS doc_type, extension = '.docx' AS converted FROM x""")
def file_routes(spark, sf):
    route, kind = extract.file_route("name")
    rows = made(spark, sf, _NAMES).withColumn("route", route)
    return rows.select("p_partkey", X.extension(F.col("name")).alias("extension"), "route", kind.alias("doc_type"), X.is_converted(F.col("name")).alias("converted"))


@query("SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def csv_lines(spark, sf):
    return extract.csv_as_markdown(table(spark, sf, "region").select("r_regionkey", "r_name"))


# --- nodes and edges in store

NODES = """SELECT 'nation/' || n_nationkey AS document_id, 'r' || n_regionkey AS repo_id, n_name AS canonical_id, 'i' || (n_nationkey % 3) AS ingestion_id, 'f' || (n_nationkey % 4) AS relative_path, 'f' || (n_nationkey % 4) AS source, cast(NULL AS VARCHAR(99)) AS summary, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS title FROM {nation}
UNION ALL SELECT 'customer/' || c_custkey, 'r' || (c_nationkey % 5), c_name, 'i' || (c_custkey % 3), 'f' || (c_custkey % 9), 'c' || (c_custkey % 40), 'old', c_name FROM {customer}"""
EDGES = """SELECT 'nation/' || c_nationkey AS src, 'customer/' || c_custkey AS dst, 'DEFINES' AS relation_type FROM {customer}
UNION ALL SELECT 'customer/' || c_custkey, 'customer/' || (c_custkey * 7 % 2000), 'CALL' FROM {customer}
UNION ALL SELECT 'nation/' || s_nationkey, 'supplier/' || s_suppkey, 'IMPORT' FROM {supplier}"""
_G = f"WITH RECURSIVE nodes AS ({duck(NODES)}), edges AS ({duck(EDGES)}), ids AS (SELECT document_id FROM nodes)"


def _nodes(spark, sf):
    return made(spark, sf, NODES)


def _edges(spark, sf):
    return made(spark, sf, EDGES)


@query(f"{_G} SELECT DISTINCT src, dst, relation_type FROM edges WHERE src IN (FROM ids) AND dst IN (FROM ids)")
def known_edges(spark, sf):
    return graph.with_known_endpoints(_edges(spark, sf), _nodes(spark, sf), key="document_id")


@query(f"{_G} SELECT src, dst, relation_type FROM edges WHERE src NOT IN (FROM ids) OR dst NOT IN (FROM ids)")
def dangling_edges(spark, sf):
    return graph.dangling(_edges(spark, sf), _nodes(spark, sf), key="document_id")


@query(f"{_G} SELECT src, dst, relation_type FROM edges WHERE src = 'customer/14' OR dst = 'customer/14'")
def touching_edges(spark, sf):
    return graph.touching(_edges(spark, sf), "customer/14")


@query(f"{_G} SELECT src, dst, relation_type FROM edges WHERE src = 'nation/3'")
def outgoing_edges(spark, sf):
    return graph.touching(_edges(spark, sf), "nation/3", incoming=False)


@query(f"{_G} SELECT document_id, canonical_id FROM nodes WHERE document_id = 'customer/11' UNION ALL SELECT document_id, canonical_id FROM nodes WHERE repo_id = 'r0' AND canonical_id = 'ALGERIA'")
def node_lookup(spark, sf):
    nodes = _nodes(spark, sf).select("document_id", "canonical_id", "repo_id")
    return graph.node(nodes, document_id="customer/11").unionByName(graph.node(nodes, repo_id="r0", canonical_id="ALGERIA")).drop("repo_id")


@query(f"{_G} SELECT document_id, canonical_id FROM nodes WHERE repo_id = 'r1' AND canonical_id IN (SELECT n_name FROM nation)")
def labelled_nodes(spark, sf):
    names = [r["n_name"] for r in table(spark, sf, "nation").collect()]
    return graph.labelled_nodes(_nodes(spark, sf), names, "r1").select("document_id", "canonical_id")


@query(f"{_G} SELECT 'customer/' || c_custkey AS start, src AS node, 1 AS distance FROM customer JOIN edges ON dst = 'customer/' || c_custkey AND relation_type = 'CALL' AND src <> dst GROUP BY ALL")
def callers(spark, sf):
    starts = table(spark, sf, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("start"))
    return graph.callers_of(_edges(spark, sf), starts)


@query(f"{_G} SELECT 'supplier/' || s_suppkey AS start, src AS node, 1 AS distance FROM supplier JOIN edges ON dst = 'supplier/' || s_suppkey AND relation_type = 'IMPORT'")
def importers(spark, sf):
    starts = table(spark, sf, "supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("start"))
    return graph.importers_of(_edges(spark, sf), starts)


@query(f"{_G} SELECT DISTINCT src AS start, dst AS node, 1 AS distance, relation_type FROM edges WHERE relation_type IN ('CALL', 'DEFINES') AND src <> dst")
def called_and_defined(spark, sf):
    edges = _edges(spark, sf)
    starts = edges.select(F.col("src").alias("start")).distinct()
    one = lambda f, kind: f(edges, starts).withColumn("relation_type", F.lit(kind))
    return one(graph.calls_from, "CALL").unionByName(one(graph.defined_by, "DEFINES"))


_NEW = "SELECT src, CASE WHEN relation_type = 'CALL' THEN src ELSE dst END AS dst, relation_type, 'new' AS metadata FROM ({edges}) x WHERE relation_type <> 'IMPORT'".replace("{edges}", EDGES)


@query(f"""{_G}, new AS (SELECT DISTINCT * FROM ({duck(_NEW)}) WHERE src IN (FROM ids) AND dst IN (FROM ids)), old AS (SELECT DISTINCT *, 'old' AS metadata FROM edges)
SELECT src, dst, relation_type, metadata FROM old WHERE (src, dst, relation_type) NOT IN (SELECT (src, dst, relation_type) FROM new) UNION ALL SELECT * FROM new""")
def merge_relationships(spark, sf):
    old = _edges(spark, sf).distinct().withColumn("metadata", F.lit("old"))
    return catalog.merge_edges(old, made(spark, sf, _NEW), _nodes(spark, sf))


@query(f"""{_G}, gone AS (SELECT document_id FROM nodes WHERE repo_id = 'r2')
SELECT 'nodes' AS kind, count(*) AS n FROM nodes WHERE repo_id <> 'r2' UNION ALL SELECT 'fresh', 1
UNION ALL SELECT 'edges', count(*) FROM edges WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone) UNION ALL SELECT 'deleted', (SELECT count(*) FROM gone)""")
def repo_rebuild(spark, sf):
    nodes, edges = _nodes(spark, sf), _edges(spark, sf)
    fresh = nodes.limit(1).withColumn("repo_id", F.lit("r2")).withColumn("document_id", F.lit("new"))
    n, e, _ = catalog.rebuilt(nodes, edges, spark.createDataFrame([], "document_id string"), "r2", fresh)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    deleted = catalog.deleted_repo(nodes, "r2")[1].select(F.lit("deleted").alias("kind"), F.col("deleted").alias("n"))
    return count(n.where("document_id <> 'new'"), "nodes").unionByName(count(n.where("document_id = 'new'"), "fresh")).unionByName(count(e, "edges")).unionByName(deleted)


@query(f"{_G} SELECT document_id, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, coalesce(summary, 'Summary pending') AS summary, repo_id FROM nodes")
def node_defaults(spark, sf):
    return catalog.with_node_defaults(_nodes(spark, sf)).select("document_id", "title", "summary", "repo_id")


@query(f"{_G}, first AS (SELECT source, min(document_id) AS document_id FROM nodes GROUP BY source) SELECT n.document_id, CASE WHEN f.document_id IS NOT NULL AND n.source LIKE 'c%' THEN 'S ' || n.source ELSE n.summary END AS summary FROM nodes n LEFT JOIN first f ON f.document_id = n.document_id")
def saved_summaries(spark, sf):
    nodes = _nodes(spark, sf)
    new = nodes.where("source like 'c%'").select("source", F.concat(F.lit("S "), "source").alias("summary")).distinct()
    return catalog.with_summaries(nodes, new).select("document_id", "summary")


REQUESTS = "SELECT 'i0' AS ingestion_id, 'completed' AS status, cast('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at UNION ALL SELECT 'i1', 'completed', cast('2024-02-01 00:00:00' AS TIMESTAMP) UNION ALL SELECT 'i2', 'failed', cast('2024-03-01 00:00:00' AS TIMESTAMP)"
_REPOS = f"""{_G}, requests AS ({REQUESTS}), rollup_ AS (SELECT repo_id, count(document_id) AS n_nodes, count(DISTINCT relative_path) AS n_files FROM nodes GROUP BY repo_id),
repos AS (SELECT k.repo_id, k.ingestion_id, created_at, n_nodes, n_files, 'repo-' || k.repo_id AS name, 'Repository ' || k.repo_id AS title FROM (SELECT DISTINCT repo_id, ingestion_id FROM nodes) k JOIN requests r ON r.ingestion_id = k.ingestion_id AND r.status = 'completed' JOIN rollup_ u ON u.repo_id = k.repo_id)"""


@query(f"{_REPOS} SELECT * FROM repos")
def repo_list(spark, sf):
    found = catalog.repo_list(_nodes(spark, sf), made(spark, sf, REQUESTS))
    return found.select("repo_id", "ingestion_id", "created_at", "n_nodes", "n_files", "name", "title")


@query(f"{_REPOS} SELECT repo_id, ingestion_id FROM repos ORDER BY created_at DESC, repo_id, ingestion_id LIMIT 1")
def newest_repo(spark, sf):
    return catalog.newest_repo(_nodes(spark, sf), made(spark, sf, REQUESTS)).select("repo_id", "ingestion_id")


@query("SELECT doc_id, length(text) > 2000 AS ok FROM documents")
def valid_rows(spark, sf):
    good, bad = catalog.valid_and_rejected(table(spark, sf, "documents").select("doc_id", "text"), F.length("text") > 2000)
    return good.select("doc_id", F.lit(True).alias("ok")).unionByName(bad.select("doc_id", F.lit(False).alias("ok")))


# --- pages of artifacts

ARTIFACTS = "SELECT 'a' || conv_id || ':' || turn AS artifact_id, CASE WHEN role = 'assistant' THEN 'image' ELSE 'text' END AS type, conv_id AS page_number, 2 * turn AS order_index, CASE WHEN role = 'assistant' THEN NULL ELSE text END AS text, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'read ' || turn END AS ocr_text FROM {conversations}"
_A = f"WITH a AS ({duck(ARTIFACTS)}), n AS (SELECT *, (SELECT arg_min(t.artifact_id, t.order_index) FROM a t WHERE t.page_number = a.page_number AND t.type = 'text' AND t.order_index > a.order_index) AS nxt FROM a)"


def _artifacts(spark, sf):
    return made(spark, sf, ARTIFACTS)


@query(f"{_A} SELECT artifact_id AS src, CASE WHEN type = 'image' AND nxt IS NOT NULL THEN nxt ELSE 'page:' || page_number END AS dst, CASE WHEN type = 'text' THEN 'text_to_page' WHEN nxt IS NOT NULL THEN 'image_to_text' ELSE 'image_to_page' END AS relation_type FROM n")
def page_graph(spark, sf):
    return graph.page_graph(_artifacts(spark, sf))


@query(f"{_A} SELECT page_number, type, order_index, text FROM a UNION ALL SELECT page_number, 'text', order_index + 1, ocr_text FROM a WHERE type = 'image' AND ocr_text <> ''")
def recognised_text(spark, sf):
    return graph.with_recognised_text(_artifacts(spark, sf)).select("page_number", "type", F.col("order_index"), "text")


@query(f"{_A}, body AS (SELECT artifact_id, page_number, coalesce(text, ocr_text) AS text FROM a WHERE coalesce(text, ocr_text) IS NOT NULL), images AS (SELECT nxt, string_agg(artifact_id, ',' ORDER BY artifact_id) AS ids FROM n WHERE type = 'image' AND nxt IS NOT NULL GROUP BY nxt) SELECT artifact_id, page_number, coalesce(ids, '') AS images FROM body LEFT JOIN images ON nxt = artifact_id WHERE trim(text) <> ''")
def artifact_chunks(spark, sf):
    a = _artifacts(spark, sf)
    linked = graph.following_text(a, ["page_number"]).where("type = 'image' and text_id is not null").select("text_id", F.col("artifact_id").alias("image_id"))
    found = chunking.artifact_chunks(a, linked).select("artifact_id", "page_number", F.array_join("associated_image_ids", ",").alias("images"))
    return found.distinct()  # an artifact's chunks all carry its images


# --- chunks of nodes

@query("SELECT doc_id AS document_id, count(*) AS chunks, CASE WHEN max(length(text)) < 2000 THEN 'sentence' WHEN max(length(text)) < 10000 THEN 'paragraph' ELSE 'simple' END AS chunk_strategy, 'code' AS source_type FROM documents WHERE trim(text) <> '' GROUP BY doc_id")
def repo_chunk_nodes(spark, sf):
    found = chunking.repo_chunks(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text"))
    return found.groupBy("document_id", "chunk_strategy", "source_type").agg(F.count(F.when(F.col("chunk_index") == 0, 1)).alias("chunks"))


@query("""SELECT doc_id, '{"chunk_strategy":"sentence","chunker_name":"sentence","chunker_params":{"chunk_size":' || CASE WHEN length(text) < 2000 THEN '200,"overlap":20' WHEN length(text) < 10000 THEN '500,"overlap":50' ELSE '1000,"overlap":100' END || '},"source_type":"file","provider":"mock","doc_type":"file"}' AS source_metadata FROM documents""")
def chunk_provenance(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    made_ = chunking.stamped(rows, source_type="file", provider="mock", doc_type="file", strategy=F.lit("sentence"), params=chunking.chosen_params(F.col("text")))
    return made_.select("doc_id", "source_metadata")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'file' AS source_type FROM events")
def metadata_defaults(spark, sf):
    m = chunking.with_defaults(F.from_json("props", "map<string,string>"), {"source_type": "file", "k": "default"})
    return table(spark, sf, "events").select("event_id", m["k"].alias("k"), m["source_type"].alias("source_type"))


_SECTIONS = "SELECT 'i' || (s_suppkey % 3) AS ingestion_id, 'd.md#s' || s_suppkey AS id, 'Section ' || s_name AS text FROM {supplier}"


@query(f"WITH s AS ({duck(_SECTIONS)}) SELECT id, 0 AS chunk_index, text AS chunk_text, 'unknown' AS chunk_strategy FROM s")
def section_chunks(spark, sf):
    found = chunking.section_chunks(made(spark, sf, _SECTIONS))
    return found.select("id", "chunk_index", "chunk_text", "chunk_strategy")


@query(f"""WITH c AS ({_MD}), n AS (SELECT f AS id, 's' || n AS title FROM c UNION ALL SELECT f || '#top_' || n, 'Top ' || n FROM c UNION ALL SELECT f || '#top_' || n || '.k' || n, 'K' || n FROM c UNION ALL SELECT f || '#top_' || n || '_2', 'Top ' || n FROM c),
e AS (SELECT f AS src, f || '#top_' || n AS dst FROM c UNION ALL SELECT f, f || '#top_' || n || '_2' FROM c UNION ALL SELECT f || '#top_' || n, f || '#top_' || n || '.k' || n FROM c)
SELECT 'node' AS kind, id AS a, title AS b FROM n UNION ALL SELECT 'edge', src, dst FROM e UNION ALL SELECT 'chunk', id, 'unknown' FROM n WHERE id LIKE '%#%'""")
def ingested_markdown(spark, sf):
    ship(spark)
    artifacts = extract.extracted(made(spark, sf, FILES), {".md": extract.markdown_artifacts})
    nodes, edges, chunks = chunking.ingested_sections(artifacts, F.lit("i1"))
    one = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    return one(nodes, "node", "canonical_id", "title").unionByName(one(edges, "edge", "src", "dst")).unionByName(one(chunks, "chunk", "id", "chunk_strategy"))


@query("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS chunk_index, text AS chunk_text FROM conversations""")
def stored_records(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.lit("{}").alias("source_metadata"), F.col("text").alias("chunk_text"))
    found = vectors.as_records(rows, call=["conv_id"], order=["turn"])
    return found.select("conv_id", "turn", "chunk_index", X.json_text(F.col("source_metadata"), "chunk_text").alias("chunk_text"))


_TEXTS = "SELECT doc_id AS ingestion_id, text, lang AS filename FROM {documents}"


@query("""SELECT doc_id AS ingestion_id, 'file_document_' || doc_id AS canonical_id, 'file_document_' || doc_id AS source, 'Summary pending' AS summary,
CASE WHEN regexp_matches(text, '\\S') THEN 'completed' ELSE 'failed' END AS status FROM documents""")
def ingested_nodes(spark, sf):
    nodes, _ = chunking.ingested(made(spark, sf, _TEXTS), source_type="file", provider="mock")
    return nodes.select("ingestion_id", "canonical_id", "source", "summary", "status")


@query("""SELECT doc_id AS ingestion_id, count(*) AS n, bool_and(ok) AS vectors_fit FROM (SELECT doc_id, true AS ok FROM documents WHERE regexp_matches(text, '\\S')) GROUP BY doc_id""")
def ingested_chunks(spark, sf):
    _, chunks = chunking.ingested(made(spark, sf, _TEXTS), source_type="file", provider="mock")
    v = F.col("embedding")
    fits = (F.size(v) == 3) & (v[0] == F.length("chunk_text")) & (v[2] == 1)
    chunks = vectors.embed(chunks, text="chunk_text")
    return chunks.groupBy("ingestion_id").agg(F.count(F.when(F.col("chunk_index") == 0, 1)).alias("n"), F.min(fits).alias("vectors_fit"))


@query("""SELECT vec_id AS chunk_id, vec_id // 50 AS chunk_index FROM embeddings WHERE label = 3""")
def ingestion_chunk_list(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 50).alias("chunk_index"), F.col("label").cast("string").alias("ingestion_id"))
    return vectors.chunks_of_ingestion(rows, "3").drop("ingestion_id")


@query(f"{_G} SELECT n.document_id, n.title, c.o_orderkey AS chunk_id FROM nodes n JOIN orders c ON n.document_id = 'customer/' || c.o_custkey WHERE n.source = 'c7'")
def chunk_node_check(spark, sf):
    chunks = table(spark, sf, "orders").select(F.concat(F.lit("customer/"), "o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id"))
    return graph.chunks_with_nodes(_nodes(spark, sf).where("source = 'c7'"), chunks, by="chunk_id").select("document_id", "title", "chunk_id")


# --- scalars

@query(r"""SELECT p_partkey, 'src/m' || p_partkey || '.py' AS canonical, 'src/m' || p_partkey || '.py#C.m' AS with_symbol, 'm' || p_partkey AS stem, 'src.m' || p_partkey AS module,
  'f.md#a.' || p_partkey AS nested, 'f.md#' || p_partkey AS top, 'a|b' AS listed, false AS is_uuid, 'x.' || p_partkey AS metadata_id, p_name AS embedding_text FROM part""")
def text_scalars(spark, sf):
    path = F.concat(F.lit("/src\\m"), "p_partkey", F.lit(".py"))
    clean = F.concat(F.lit("src/m"), "p_partkey", F.lit(".py"))
    key = F.col("p_partkey").cast("string")
    meta = F.to_json(F.struct(F.lit("").alias("canonical_id"), F.struct(F.concat(F.lit("x."), key).alias("canonical_id")).alias("source_metadata")))
    return table(spark, sf, "part").select(
        "p_partkey", X.canonical_id(path).alias("canonical"), X.global_id(F.lit("r"), path, F.lit(" C.m "))["canonical_id"].alias("with_symbol"), X.stem(clean).alias("stem"), X.module_name(clean).alias("module"),
        X.nested_section_id(F.lit("f.md"), F.lit("a"), key).alias("nested"), X.nested_section_id(F.lit("f.md"), F.lit(""), key).alias("top"), F.array_join(X.comma_list(F.lit(" a ,, b")), "|").alias("listed"),
        X.is_uuid(F.col("p_name")).alias("is_uuid"), X.metadata_canonical_id(meta).alias("metadata_id"), X.embedding_text(F.col("p_name")).alias("embedding_text"),
    )


@query("SELECT event_id, 'v' || event_id AS dotted FROM events")
def literal_json_keys(spark, sf):
    """A key with a dot is one key, not a path."""
    json = F.to_json(F.create_map(F.lit("a.b"), F.concat(F.lit("v"), "event_id")))
    rows = table(spark, sf, "events").select("event_id", json.alias("source_metadata"))
    kept = rows.where(vectors.metadata_filter({"a.b": {"ne": "none"}}))
    return kept.select("event_id", X.json_text(F.col("source_metadata"), "a.b").alias("dotted"))
