"""URL filters: a trie over reversed host labels, then over path segments.

A rule is a host and a path prefix with an action. It fits its host and all subdomains
where the url's path starts with the rule's path. Among the rules that fit, the longest
rule string decides; of equally long ones the one with the longer host, then block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rule characters that a broadcast trie may hold; larger lists are matched by a join.
TRIE_CHARS = 4_000_000


@dataclass(frozen=True, order=True)
class Rule:
    host: str
    path: str
    action: str

    def __post_init__(self):
        if self.action not in ("allow", "block"):
            raise ValueError(f"action must be allow or block: {self.action}")

    @classmethod
    def parse(cls, text: str, action: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host.translate(str.maketrans(UPPER, LOWER)), slash + path, action)

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple[int, int, bool]:
        return len(self.text), len(self.host), self.action == "block"


@dataclass
class _Segment:
    """below: whole path segments. open: rules that end inside the next segment, by
    their text there (an empty text fits any rest)."""

    below: dict[str, _Segment] = field(default_factory=dict)
    open: dict[str, Rule] = field(default_factory=dict)


@dataclass
class _Label:
    below: dict[str, _Label] = field(default_factory=dict)
    paths: _Segment | None = None


class Trie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Label()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Label())
            node.paths = node.paths or _Segment()
            *whole, rest = rule.path.split("/")
            step = node.paths
            for segment in whole:
                step = step.below.setdefault(segment, _Segment())
            held = step.open.get(rest)
            if held is None or rule.rank > held.rank:
                step.open[rest] = rule

    def match(self, host: str, path: str) -> Rule | None:
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            step = node.paths
            for i, segment in enumerate(segments):
                if step is None:
                    break
                if step.open:
                    for n in range(len(segment) + 1):
                        rule = step.open.get(segment[:n])
                        if rule is not None and (best is None or rule.rank > best.rank):
                            best = rule
                step = step.below.get(segment) if i < len(segments) - 1 else None
        return best


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def _by_trie(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and action by one walk of the broadcast trie for each row."""
    trie = rows.sparkSession.sparkContext.broadcast(Trie(rules))
    schema = f"{rows.selectExpr('*', 'string(null) rule', 'string(null) action').schema.simpleString()[7:-1]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for b in batches:
            found = [match(h, p) for h, p in zip(b.column(b.schema.get_field_index("host")).to_pylist(), b.column(b.schema.get_field_index("path")).to_pylist())]
            yield b.append_column("rule", pa.array([r and r.text for r in found], pa.string())).append_column("action", pa.array([r and r.action for r in found], pa.string()))

    return rows.mapInArrow(run, schema)


def _by_join(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """The same for rule lists over TRIE_CHARS: equi-joins the distinct (host, path) on
    host suffix and path prefix, the prefixes having only lengths that rules have."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.action) for r in rules], "rule_host string, rule_path string, rule string, action string")
    lengths = sorted({len(r.path) for r in rules})
    labels = F.split(F.col("host"), r"\.", -1)
    keys = rows.select("host", "path").distinct()
    keys = keys.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("rule_host"))
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    keys = keys.select("host", "path", "rule_host", F.explode(F.transform(fits, lambda n: F.substring("path", F.lit(1), n))).alias("rule_path"))
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("action") == "block", F.struct("rule", "action").alias("best"))
    best = keys.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(rank).alias("top"))
    return rows.join(best, ["host", "path"], "left").select(rows["*"], "top.best.rule", "top.best.action")


def filter_urls(pages: DataFrame, rules: Iterable[Rule], *, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", trie_chars: int = TRIE_CHARS) -> DataFrame:
    """One row per row of `pages`: the `keep` columns, host, path, rule, verdict.

    Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path:
    from there up to "?", "#" or the end. Urls that are null or have no "://" get both
    empty. rule is the deciding rule's text, or null; verdict is its action, or
    `default` where no rule fits.

    Repeated rows stay; very long urls are read whole; an empty table gives no rows.
    Only `url` and `keep` are read, so other columns can't clash.
    """
    rules = sorted(set(rules))
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    small = sum(len(r.text) for r in rules) <= trie_chars
    found = (_by_trie if small else _by_join)(rows, rules)
    return found.select(*keep, "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
