"""Artifacts of source files: Python by its syntax tree, Markdown by its headings, HTML
turned into Markdown. Parsers need Python code, so each runs once per Arrow batch and
yields one schema; everything after it is DataFrame code."""

from __future__ import annotations

import ast
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq int, artifact_type string, id string, canonical_id string, name string, parent_id string, relative_path string, doc_type string, text string, metadata string"

Artifact = tuple[str, str, str, "str | None", str, dict]


def repo_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path and content of a folder's .py and .md files; parts of the relative
    path that start with a dot hide a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,md}").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.substring_index("path", base + "/", -1), "^/+", "")
    rows = files.select(path.alias("relative_path"), F.try_validate_utf8("content").alias("source"))
    return rows.where(~F.col("relative_path").rlike(r"(^|/)\.") & F.col("source").isNotNull())


class _Walk:
    """Depth-first over a syntax tree with the enclosing scope and class."""

    def __init__(self, path: str, source: str):
        self.path, self.lines = path, source.splitlines()
        self.found: list[Artifact] = []

    def _text(self, node: ast.AST) -> str:
        return "\n".join(self.lines[node.lineno - 1 : node.end_lineno])

    def _add(self, kind: str, tail: str, name: str, parent: str, node: ast.AST, text: str = "", **more) -> str:
        own = f"{self.path}#{tail}"
        self.found.append((kind, own, name, parent, text, {"lineno": node.lineno, "col_offset": node.col_offset} | more))
        return own

    def run(self, node: ast.AST, scope: str, cls: str | None) -> None:
        match node:
            case ast.ClassDef():
                scope = self._add("CLASS", node.name, node.name, scope, node, self._text(node), bases=[ast.unparse(b) for b in node.bases])
                cls = node.name
            case ast.FunctionDef():
                tail = f"{cls}.{node.name}" if cls else node.name
                scope = self._add("METHOD" if cls else "FUNCTION", tail, node.name, scope, node, self._text(node), args=[a.arg for a in node.args.args])
            case ast.Import() | ast.ImportFrom():
                module = (node.module or "") if isinstance(node, ast.ImportFrom) else None
                for a in node.names:
                    tail = a.name if module is None else f"{module}.{a.name}"
                    self._add("IMPORT", f"import:{tail}", a.name, scope, node, asname=a.asname, **({} if module is None else {"module": module}))
            case ast.Call():
                name = ast.unparse(node.func)
                self._add("CALL", f"call:{name}", name, scope, node)
        for child in ast.iter_child_nodes(node):
            self.run(child, scope, cls)


def python_artifacts(path: str, source: str) -> list[Artifact]:
    """Module, classes, functions, methods, imports and calls. Coroutines are no
    functions of their own: what they hold belongs to the scope around them. A method
    is named by its nearest class; nested classes aren't qualified."""
    walk = _Walk(path, source)
    walk.run(ast.parse(source), path, None)
    return [("MODULE", path, re.sub(r"[.py]+$", "", path.replace("/", ".")), None, source, {}), *walk.found]


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_BLOCK = re.compile(r" {0,3}(?:[-*+>]|\d+[.)])(?:\s|$)")


def headings(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(line, level, text) of ATX and underlined headings outside code."""
    fence = None
    para = None  # first line of the open paragraph
    for i, line in enumerate(lines):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not line.strip(" \t`~"):
                fence = None
            continue
        if mark:
            fence, para = mark[1], None
            continue
        atx = _ATX.match(line)
        if atx:
            yield i, len(atx[1]), (atx[2] or "").strip()
            para = None
        elif para is not None and (under := _UNDERLINE.match(line)):
            yield para, 1 if under[1][0] == "=" else 2, " ".join(x.strip() for x in lines[para:i])
            para = None
        elif not line.strip() or _BLOCK.match(line) or (para is None and re.match(r" {4}|\t", line)):
            para = None
        elif para is None:
            para = i


def _slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "_", text.lower().strip()).strip("_") or "section"


def markdown_artifacts(path: str, source: str) -> list[Artifact]:
    """The module and one section per heading, with the text up to the next heading of
    its level or above. The nth equal slug of a file gets _n from the second on."""
    out: list[Artifact] = [("MARKDOWN_MODULE", path, re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]), None, source, {})]
    lines = source.split("\n")
    found = sorted(headings(lines))
    seen: Counter[str] = Counter()
    above: list[tuple[int, str]] = []
    for k, (at, level, text) in enumerate(found):
        slug = _slug(text)
        seen[slug] += 1
        if seen[slug] > 1:
            slug = f"{slug}_{seen[slug]}"
        while above and above[-1][0] >= level:
            above.pop()
        parent = above[-1][1] if above else path
        own = f"{parent}.{slug}" if above else f"{path}#{slug}"
        above.append((level, own))
        end = next((a for a, lv, _ in found[k + 1 :] if lv <= level), len(lines))
        out.append(("MARKDOWN_SECTION", own, text, parent, "\n".join(lines[at:end]).strip(), {"level": level, "lineno": at + 1, "slug": slug}))
    return out


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.silent += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "ul", "ol", "pre", "blockquote", "header", "footer", "nav", "title", "body"):
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.silent = max(self.silent - 1, 0)
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif re.fullmatch("h[1-6]|p|div|title", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str) -> str:
    p = _Markdown()
    p.feed(html)
    p.close()
    lines = [x.strip() for x in "".join(p.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _doc_type(kind: str) -> str:
    return {"MARKDOWN_MODULE": "markdown_module", "MARKDOWN_SECTION": "markdown_section"}.get(kind, "python source")


#: Artifacts leave a task in batches of about so many rows, or characters of text if those come first.
BATCH_ROWS, BATCH_CHARS = 10_000, 4 << 20

Parsers = dict[str, Callable[[str, str], list[Artifact]]]


def artifact_batches(batches: Iterable[pa.RecordBatch], parsers: Parsers) -> Iterator[pa.RecordBatch]:
    """The artifacts of batches of files (path, source), those of many files in a batch."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int32()] + [pa.string()] * (len(names) - 1)
    held, chars = [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held), types)], names=names)

    for b in batches:
        for path, source in zip(b.column(0), b.column(1)):
            path, source = path.as_py(), source.as_py()
            parse = next((f for suffix, f in parsers.items() if path and path.endswith(suffix)), None)
            if parse is None or source is None:
                continue
            try:
                found = parse(path, source)
            except (SyntaxError, ValueError, RecursionError):
                continue
            for i, (kind, own, name, parent, text, meta) in enumerate(found):
                held.append((i, kind, own, own, name, parent, path, _doc_type(kind), text, json.dumps(meta)))
                chars += len(text)
                if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch()
                    held, chars = [], 0
    if held:
        yield batch()


def extracted(files: DataFrame, parsers: Parsers | None = None) -> DataFrame:
    """Artifacts of files (relative_path, source) by the suffix of their path; files with
    other suffixes, and those that can't be parsed, give none."""
    parsers = parsers or {".py": python_artifacts, ".md": markdown_artifacts}
    wanted = reduce(or_, (F.col("relative_path").endswith(suffix) for suffix in parsers))
    # By number, since parsing costs far more than a small table's bytes let Spark expect.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = files.select("relative_path", "source").where(wanted).repartition(parts)
    return files.mapInArrow(lambda batches: artifact_batches(batches, parsers), SCHEMA)


def pages_as_markdown(pages: DataFrame) -> DataFrame:
    """page_id, markdown; a null page is empty."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.fillna("").map(html_to_markdown)

    return pages.select("page_id", run("html").alias("markdown"))


#: Encodings tried in order; the last takes any bytes.
ENCODINGS = ("utf-8", "utf-8-sig", "windows-1252", "latin-1")


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds source: the bytes by the first encoding that takes them."""

    def one(raw: bytes) -> str:
        for name in ENCODINGS:
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return ""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else one(bytes(x)))

    return files.withColumn("source", run(F.col(content)))


def csv_as_markdown(rows: DataFrame) -> DataFrame:
    """One text column, line: each row as a row of a Markdown table."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns))
    return rows.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def file_route(name: str = "name") -> tuple:
    """(route, doc_type) columns by a file's extension."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    route = F.when(ext == ".pdf", "pdf").when(ext.isin(".png", ".jpg", ".jpeg"), "image").when(ext == ".md", "markdown").when(ext.isin(".csv", ".xlsx"), "tabular").otherwise("text")
    return route, F.when(route == "markdown", "markdown_module").when(route.isin("pdf", "image", "tabular"), route).otherwise("file")
