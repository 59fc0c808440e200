import pytest
from pyspark.sql import functions as F

from loamgraph.functions import text as X
from loamgraph.operators import catalog, chunking, graph, retrieval, vectors
from loamgraph.plans import repository
from loamgraph.sources import extract
from loamgraph.streaming.ingest import ingest_text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("made, text, want", [
    (lambda t: chunking.fixed_chars(t, 500, 0), "a" * 1200, ["a" * 500, "a" * 500, "a" * 200]),
    (lambda t: chunking.fixed_chars(t, 10, 2), "", []),
    (lambda t: chunking.sentences(t, 20), "Hello world. This is a test. Another sentence.", ["Hello world.", "This is a test.", "Another sentence."]),
    (lambda t: chunking.paragraphs(t, 50), "Para one.\n\nPara two.\n\nPara three.", ["Para one.\n\nPara two.\n\nPara three."]),
])
def test_chunkers(spark, made, text, want):
    assert one(spark, made(F.lit(text))) == want


def test_unknown_strategy_and_overlap():
    with pytest.raises(ValueError):
        chunking.chunker("unknown")
    with pytest.raises(ValueError):
        chunking.fixed_chars(None, 10, 10)


@pytest.mark.parametrize("length, want", [(0, "sentence"), (1999, "sentence"), (2000, "paragraph"), (9999, "paragraph"), (10000, "simple")])
def test_strategy(spark, length, want):
    assert one(spark, chunking.chosen_strategy(F.lit("x" * length))) == want


def test_identity(spark):
    import uuid

    assert one(spark, X.canonical_id(F.lit("src\\module.py"), F.lit("MyClass.my_method"))) == "src/module.py#MyClass.my_method"
    assert one(spark, X.repo_id(F.lit(" HTTPS://h/R.git/ "))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://h/r"))
    assert one(spark, X.module_name(F.lit("src/happy.py"))) == "src.ha"
    assert one(spark, X.slug(F.lit("--"))) == "section"


def edges_of(spark, *rows):
    return spark.createDataFrame(rows, "src string, dst string, relation_type string")


def test_traversal_depth_and_types(spark):
    chain = edges_of(spark, ("A", "B", "r"), ("B", "C", "r"), ("C", "D", "r"))
    start = spark.createDataFrame([("A",)], "start string")
    assert {r["node"] for r in graph.reachable(chain, start, depth=2).collect()} == {"B", "C"}
    typed = edges_of(spark, ("A", "B", "allowed"), ("A", "C", "blocked"))
    assert {r["node"] for r in graph.reachable(typed, start, types=["allowed"]).collect()} == {"B"}
    cycle = edges_of(spark, ("A", "B", "r"), ("B", "A", "r"))
    assert {r["node"] for r in graph.reachable(cycle, start).collect()} == {"B"}
    known = spark.createDataFrame([("Z",)], "document_id string")
    assert graph.reachable(chain, start, known=known).count() == 0


def test_expansion(spark):
    edges = edges_of(spark, ("d1", "d3", "r"), ("d2", "d3", "r"), ("d2", "d4", "r"), ("d4", "d5", "r"))
    seeds = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    assert {r["document_id"] for r in retrieval.expand(edges, seeds).collect()} == {"d3", "d4"}
    assert {r["document_id"] for r in retrieval.expand(edges, seeds, depth=2).collect()} == {"d3", "d4", "d5"}


@pytest.mark.parametrize("question, want", [
    ("methods of X", [("DEFINES", "out")]), ("something", [("DEFINES", "out")]), ("who calls X", [("CALL", "in")]),
    ("what does X call", [("CALL", "out")]), ("import X", [("IMPORT", "in")]), ("X?", [("DEFINES", "out"), ("CALL", "out")]),
])
def test_question(spark, question, want):
    assert [tuple(x) for x in one(spark, retrieval.traversals(F.lit(question)))] == want


@pytest.mark.parametrize("budget, kept", [(3, 1), (5, 2), (4, 1), (6, 3), (0, 0)])
def test_budget_edges(spark, budget, kept):
    rows = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "d e"), (1, 2, "f")], "c int, i int, text string")
    assert retrieval.within_budget(rows, budget, context=["c"], by=["i"]).count() == kept


def test_zero_vector_comes_last_and_filters(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0], "{}"), (2, [-1.0, 0.0], '{"a":"x"}')], "chunk_id int, embedding array<double>, source_metadata string")
    found = vectors.top_k(rows, vectors.literal_vector([1, 0]), 2).collect()
    assert [r["chunk_id"] for r in found] == [2, 1]
    assert [r["chunk_id"] for r in rows.where(vectors.metadata_filter({"a": {"ne": "x"}})).collect()] == [1]
    assert rows.where(vectors.metadata_filter({"a": {"in": []}})).count() == 0
    with pytest.raises(ValueError):
        vectors.metadata_filter({"a": {"gt": 1}})


def test_rebuild_cascades(spark):
    nodes = spark.createDataFrame([("r", "a"), ("s", "b")], "repo_id string, document_id string")
    chunks = spark.createDataFrame([("a",), ("b",), (None,)], "document_id string")
    n, e, c = catalog.rebuilt(nodes, edges_of(spark, ("a", "b", "x")), chunks, "r", spark.createDataFrame([("r", "n")], nodes.schema))
    assert {r["document_id"] for r in n.collect()} == {"b", "n"}
    assert e.count() == 0 and c.count() == 2


PY = '''import os
from a.b import c as d

class K(Base):
    def m(self, x):
        return helper(x.y())

async def run():
    go()

def top():
    def inner():
        pass
    return K()
'''


def test_python_artifacts():
    found = {(kind, name): (own, parent) for kind, own, name, parent, _, _ in extract.python_artifacts("p/m.py", PY)}
    assert found["METHOD", "m"] == ("p/m.py#K.m", "p/m.py#K")
    assert found["FUNCTION", "inner"] == ("p/m.py#inner", "p/m.py#top")
    assert found["CALL", "x.y"][1] == "p/m.py#K.m"
    assert found["CALL", "go"][1] == "p/m.py"
    assert found["IMPORT", "c"][0] == "p/m.py#import:a.b.c"
    assert ("FUNCTION", "run") not in found


def test_markdown_artifacts():
    md = "# A\ntext\n```\n# code\n```\n## B\nx\n# A\nUnder\n---\n"
    found = [(own, parent, text) for _, own, _, parent, text, _ in extract.markdown_artifacts("d.md", md)][1:]
    assert [f[0] for f in found] == ["d.md#a", "d.md#a.b", "d.md#a_2", "d.md#a_2.under"]
    assert found[1][1] == "d.md#a" and "# code" in found[0][2] and found[1][2] == "## B\nx"


def test_unparsable_files_are_left_out(spark):
    files = spark.createDataFrame([("a.py", "def ("), ("b.md", "# T"), ("c.txt", "x"), ("d.py", None)], "relative_path string, source string")
    assert {r["relative_path"] for r in extract.extracted(files).collect()} == {"b.md"}


def test_call_edges(spark):
    rows = [(i, *a) for i, a in enumerate(extract.python_artifacts("m.py", "def f():\n    f()\n    g()\ndef g():\n    pass\n"))]
    df = spark.createDataFrame([(i, k, own, own, n, p) for i, k, own, n, p, *_ in rows], "seq int, artifact_type string, id string, canonical_id string, name string, parent_id string")
    got = {(r["from_canonical_id"], r["to_canonical_id"], r["confidence"]) for r in graph.call_edges(df).collect()}
    assert got == {("m.py#f", "m.py#f", 1.0), ("m.py#f", "m.py#g", 0.5)}


def test_stream_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("One. Two.")
    (src / "b.txt").write_text(" \n")
    run = lambda: ingest_text(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    (src / "c.txt").write_text("Three.")
    run()
    assert sorted(r["chunk_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["One. Two.", "Three."]
    assert spark.read.parquet(str(tmp_path / "out_failed")).count() == 1


def test_symbols_and_scopes_over_files(spark):
    entity = "relative_path string, seq int, artifact_type string, id string, canonical_id string, name string, parent_id string"
    deep = [("b.py", i, "CLASS", f"b#{i}", f"b#{i}", f"c{i}", f"b#{i - 1}" if i else None) for i in range(14)]
    rows = [("a.py", 9, "FUNCTION", "a#f", "a#f", "f", None), ("b.py", 1, "FUNCTION", "b#f", "b#f", "f", None), *deep, ("b.py", 20, "CALL", "b#call:c0", "b#call:c0", "c0", "b#13")]
    entities = spark.createDataFrame(rows, entity)
    assert {r["name"]: r["canonical_id"] for r in graph.symbol_table(entities).collect()}["f"] == "b#f"
    assert [tuple(r) for r in graph.call_edges(entities).collect()] == [("b#13", "b#0", 1.0)]
    ring = spark.createDataFrame([("x.py", 0, "CLASS", "p", "p", "p", "q"), ("x.py", 1, "CLASS", "q", "q", "q", "p")], entity)
    assert graph.ancestors(ring).count() == 4


def test_repository_files(spark, tmp_path):
    for name, text in (("a.py", b"x = 1"), ("docs/b.md", b"# T"), (".hidden/c.py", b"y = 2"), ("d.txt", b"z"), ("e.py", b"\xff\xfe")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    found = extract.repo_files(spark, str(tmp_path))
    assert {(r["relative_path"], r["source"]) for r in found.collect()} == {("a.py", "x = 1"), ("docs/b.md", "# T")}


def test_decoding_falls_back(spark):
    files = spark.createDataFrame([(1, "é".encode()), (2, "é".encode("windows-1252")), (3, b"\x81"), (4, None)], "i int, content binary")
    assert {r["i"]: r["source"] for r in extract.decoded(files).collect()} == {1: "é", 2: "é", 3: "\x81", 4: None}


def test_generate():
    assert retrieval.generate("c", "q") == "Context:\nc\n\nQuestion:\nq"
    assert retrieval.generate("c", "q", "ollama", call=len) == 23
    with pytest.raises(ValueError, match="Unsupported LLM provider: other"):
        retrieval.generate("c", "q", "other")


def test_embedders():
    calls = []
    run = vectors.batched(lambda texts: calls.append(len(texts)) or [[1.0]] * len(texts), size=2)
    assert len(run(["a"] * 5)) == 5 and calls == [2, 2, 1]
    with pytest.raises(ValueError):
        vectors.batched(lambda texts: [])(["a"])
    assert vectors.embed_query("four") == [4.0, 4.0, 1.0]
    with pytest.raises(ValueError):
        vectors.embed_query(" ")
    with pytest.raises(ValueError):
        vectors.embedder("none")


def test_lookups_that_fail(spark):
    nodes = spark.createDataFrame([("r1", "i1", "d", "p")], "repo_id string, ingestion_id string, document_id string, relative_path string")
    done = spark.createDataFrame([("i1", "completed", 1)], "ingestion_id string, status string, created_at int")
    assert catalog.resolved_repo(nodes, done) == catalog.resolved_repo(nodes, done, "r1") == "r1"
    for frame, asked in ((done.limit(0), None), (done, "r2")):
        with pytest.raises(LookupError):
            catalog.resolved_repo(nodes, frame, asked)
    known = "123e4567-e89b-12d3-a456-426614174000"
    requests = spark.createDataFrame([(known, "running")], "ingestion_id string, status string")
    assert catalog.request_status(requests, known).first()["status"] == "running"
    for wrong, error in (("x", ValueError), (known.replace("1", "2"), LookupError)):
        with pytest.raises(error):
            catalog.request_status(requests, wrong)
    with pytest.raises(ValueError):
        graph.node(nodes, repo_id="r1")


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from loamgraph.runtime import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_many_files_share_a_batch():
    import pyarrow as pa

    files = pa.record_batch([pa.array([f"f{i}.py" for i in range(3000)] + ["x.txt", None]), pa.array(["import os\n"] * 3000 + ["", "x"])], names=["relative_path", "source"])
    made = list(extract.artifact_batches([files, files], {".py": extract.python_artifacts}))
    assert [b.num_rows for b in made] == [extract.BATCH_ROWS, 2000]
    assert pa.Table.from_batches(made).column("seq").to_pylist() == [0, 1] * 6000
    long = pa.record_batch([pa.array(["a.md", "b.md"]), pa.array(["x" * extract.BATCH_CHARS] * 2)], names=["relative_path", "source"])
    assert [b.num_rows for b in extract.artifact_batches([long], {".md": extract.markdown_artifacts})] == [1, 1]


def test_files_of_one_partition_are_parsed_in_many_tasks(spark):
    files = spark.range(200).coalesce(1).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("relative_path"), F.lit("x = 1").alias("source"))
    found = extract.extracted(files).withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 200 and len({r["task"] for r in found}) > 1


def test_queries_of_one_kind_of_file_parse_no_other(spark, sf, monkeypatch):
    seen, real = [], extract.extracted
    monkeypatch.setattr(extract, "extracted", lambda files, parsers=None: seen.append(sorted(parsers or {".py", ".md"})) or real(files, parsers))
    for query in (repository.python_entities, repository.markdown_entities, repository.ingested_markdown):
        query(spark, sf)
    assert seen == [[".py"], [".md"], [".md"]]


def counting(spark, parse):
    """A parser that counts the files it is given."""
    seen = spark.sparkContext.accumulator(0)

    def run(path, source):
        seen.add(1)
        return parse(path, source)

    return run, seen


def test_ingested_sections_parse_each_file_once(spark):
    run, seen = counting(spark, extract.markdown_artifacts)
    files = spark.createDataFrame([(f"f{i}.md", "# A\nx\n## B\ny") for i in range(20)], "relative_path string, source string")
    nodes, edges, chunks = chunking.ingested_sections(extract.extracted(files, {".md": run}), F.lit("i"))
    assert (nodes.count(), edges.count(), chunks.count()) == (60, 40, 40)
    assert {r["chunk_text"] for r in chunks.collect()} == {"# A\nx\n## B\ny", "## B\ny"}
    assert seen.value == 20


def test_edges_parse_each_file_once(spark):
    run, seen = counting(spark, extract.python_artifacts)
    files = spark.createDataFrame([(f"f{i}.py", f"def f{i}():\n    f{i}()\n") for i in range(20)], "relative_path string, source string")
    edges = graph.repo_edges(extract.extracted(files, {".py": run})).collect()
    assert sorted((r["to_canonical_id"], r["relation_type"]) for r in edges) == sorted((f"f{i}.py#f{i}", kind) for i in range(20) for kind in ("CALL", "DEFINES"))
    assert seen.value == 20


def test_only_callers_get_their_ancestors(spark):
    entity = "seq int, artifact_type string, id string, canonical_id string, name string, parent_id string"
    entities = spark.createDataFrame([(0, "MODULE", "m", "m", "m", None), (1, "CLASS", "m#K", "m#K", "K", "m"), (2, "METHOD", "m#K.f", "m#K.f", "f", "m#K"), (3, "METHOD", "m#K.g", "m#K.g", "g", "m#K")], entity)
    ids = spark.createDataFrame([("m#K.f",), (None,)], "id string")
    found = {(r["id"], r["ancestor"], r["distance"]) for r in graph.ancestors(entities, ids).where("id is not null").collect()}
    assert found == {("m#K.f", "m#K.f", 0), ("m#K.f", "m#K", 1), ("m#K.f", "m", 2)}
