"""Deterministic text chunkers as Column expressions, and chunk tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank, or_default, section_chunk_id, strip
from ..runtime import Scratch
from .graph import defines_edges


def fixed_chars(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Windows of `size` characters, each `size - overlap` after the last. A tail that
    lies inside the overlap is a chunk too; no text, no chunk."""
    if overlap >= size or size < 1:
        raise ValueError("overlap must be less than the chunk size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    cut = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def _folded(parts: Column, size: int, joiner: str) -> Column:
    """Greedy fold of parts into chunks: a part that would take the open chunk over
    `size` (the joiner not counted) starts the next one. A longer part stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        full = F.length(acc["open"]) + F.length(part) > size
        grown = F.when(acc["open"] == "", part).otherwise(F.concat(acc["open"], F.lit(joiner), part))
        done = F.when(full & (acc["open"] != ""), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, part).otherwise(grown).alias("open"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def sentences(text: Column, size: int = 500, overlap: int = 0) -> Column:
    """Sentences end before white space that follows . ! or ?; `overlap` is not used."""
    return _folded(F.split(text, r"(?U)(?<=[.!?])\s+", -1), size, " ")


def paragraphs(text: Column, size: int = 500, overlap: int = 0) -> Column:
    """Paragraphs lie between blank lines, stripped; `overlap` is not used."""
    return _folded(F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != ""), size, "\n\n")


CHUNKERS: dict[str, Callable[..., Column]] = {"fixed_char": fixed_chars, "simple": fixed_chars, "sentence": sentences, "paragraph": paragraphs}


def chunker(name: str) -> Callable[..., Column]:
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunk strategy: {name}")
    return CHUNKERS[name]


def chunks(text: Column, strategy: str = "simple", size: int = 500, overlap: int = 50) -> Column:
    return chunker(strategy)(text, size, overlap)


def chosen_strategy(text: Column) -> Column:
    """sentence below 2,000 characters, paragraph below 10,000, else simple."""
    return F.when(F.length(text) < 2000, "sentence").when(F.length(text) < 10000, "paragraph").otherwise("simple")


def chosen_chunks(text: Column) -> Column:
    """The chunks of the chosen strategy, at its own size and overlap."""
    return F.when(F.length(text) < 2000, sentences(text, 200)).when(F.length(text) < 10000, paragraphs(text, 500)).otherwise(fixed_chars(text, 1000, 100))


def chosen_params(text: Column) -> Column:
    """The size and overlap that go with the chosen strategy."""
    pair = lambda s, o: F.struct(F.lit(s).alias("chunk_size"), F.lit(o).alias("overlap"))
    return F.when(F.length(text) < 2000, pair(200, 20)).when(F.length(text) < 10000, pair(500, 50)).otherwise(pair(1000, 100))


def chunk_table(docs: DataFrame, *, key: str, text: str = "text", made: Callable[[Column], Column] = chosen_chunks) -> DataFrame:
    """One row per chunk: the columns of `docs` but its text, chunk_index from 0, chunk_text."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(made(F.col(text))).alias("chunk_index", "chunk_text"))


def stamped(table: DataFrame, *, source_type: str, provider: str, doc_type: str, strategy: Column, params: Column) -> DataFrame:
    """Adds source_metadata: how and from what each chunk was made, as JSON."""
    fields = [strategy.alias("chunk_strategy"), strategy.alias("chunker_name"), params.alias("chunker_params"), F.lit(source_type).alias("source_type"), F.lit(provider).alias("provider"), F.lit(doc_type).alias("doc_type")]
    fields += [F.col(c) for c in ("relative_path", "canonical_id") if c in table.columns]
    return table.withColumn("source_metadata", F.to_json(F.struct(*fields)))


def with_defaults(metadata: Column, defaults: dict[str, str]) -> Column:
    """A map with the defaults for keys that it lacks; present keys are never changed."""
    wanted = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    missing = F.map_filter(wanted, lambda k, v: ~F.map_contains_key(metadata, k))
    return F.map_concat(metadata, missing)


def repo_chunks(nodes: DataFrame) -> DataFrame:
    """Chunks of repository nodes with text, each with its node's identity."""
    live = nodes.where(strip(F.coalesce("text", F.lit(""))) != "").withColumn("chunk_strategy", chosen_strategy(F.col("text")))
    return chunk_table(live, key="document_id").withColumn("source_type", F.lit("code"))


def artifact_chunks(artifacts: DataFrame, linked: DataFrame) -> DataFrame:
    """Chunks of page artifacts: the text, or else what recognition read, with the images
    that belong to each text. artifacts: artifact_id, page_number, text, ocr_text.
    linked: text_id, image_id."""
    images = linked.groupBy(F.col("text_id").alias("artifact_id")).agg(F.sort_array(F.collect_set("image_id")).alias("associated_image_ids"))
    body = artifacts.select("artifact_id", "page_number", or_default(F.col("text"), F.col("ocr_text")).alias("text")).where(strip(F.coalesce("text", F.lit(""))) != "")
    table = chunk_table(body.withColumn("chunk_strategy", chosen_strategy(F.col("text"))), key="artifact_id")
    table = table.withColumn("chunk_id", F.concat("artifact_id", F.lit(":chunk:"), "chunk_index"))
    return table.join(images, "artifact_id", "left").withColumn("associated_image_ids", F.coalesce("associated_image_ids", F.array().cast("array<string>")))


def section_chunks(sections: DataFrame) -> DataFrame:
    """One chunk for each section (ingestion_id, id, text): no section is cut, and each is
    stored on its own, so its chunk_index is 0 and its strategy unknown."""
    rows = sections.where(non_blank(F.col("text")))
    return rows.select(
        "ingestion_id", "id", section_chunk_id(F.col("ingestion_id").cast("string"), F.col("id")).alias("chunk_id"),
        F.lit(0).alias("chunk_index"), F.lit("unknown").alias("chunk_strategy"), F.col("text").alias("chunk_text"),
    )


def ingested(texts: DataFrame, *, source_type: str, provider: str, doc_type: str = "file") -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) of texts (ingestion_id, text, filename). Each text has a node,
    made before it is looked at; blank ones fail and have no chunks."""
    name = F.concat(F.lit(f"{source_type}_document_"), F.col("ingestion_id").cast("string"))
    ok = non_blank(F.col("text"))
    nodes = texts.select(
        "ingestion_id", name.alias("canonical_id"), F.concat(F.lit(f"{source_type.title()} "), F.substring(F.col("ingestion_id").cast("string"), 1, 8)).alias("title"),
        F.concat(F.lit("file_document_"), F.col("ingestion_id").cast("string")).alias("source"), F.col("filename").alias("relative_path"), F.lit(doc_type).alias("doc_type"),
        F.lit("Summary pending").alias("summary"), F.when(ok, "completed").otherwise("failed").alias("status"),
    )
    live = texts.where(ok).select("ingestion_id", name.alias("canonical_id"), F.col("filename").alias("relative_path"), "text", chosen_strategy(F.col("text")).alias("chunk_strategy"), chosen_params(F.col("text")).alias("params"))
    chunks = chunk_table(live, key="ingestion_id")
    stamp = stamped(chunks, source_type=source_type, provider=provider, doc_type=doc_type, strategy=F.col("chunk_strategy"), params=F.col("params"))
    return nodes, stamp.drop("params")


def ingested_sections(artifacts: DataFrame, ingestion: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, chunks) of uploaded Markdown from its artifacts: a node for the file
    and each section, DEFINES edges from each parent to its sections, and one chunk for
    each section with text. What these need of the artifacts is written first, so that
    files are parsed once."""
    section = F.col("artifact_type") == "MARKDOWN_SECTION"
    rows = artifacts.withColumn("ingestion_id", ingestion).select(
        "ingestion_id", "id", "canonical_id", "artifact_type", "name", "parent_id", "relative_path", "seq", "doc_type", F.when(section, F.col("text")).alias("text"),
    )
    rows = Scratch(artifacts.sparkSession).write(rows)
    nodes = rows.select("ingestion_id", "canonical_id", F.col("name").alias("title"), "relative_path", "doc_type", F.lit("Summary pending").alias("summary"))
    edges = defines_edges(rows).select(F.col("from_canonical_id").alias("src"), F.col("to_canonical_id").alias("dst"), F.lit("DEFINES").alias("relation_type"))
    return nodes, edges, section_chunks(rows.where(section))
