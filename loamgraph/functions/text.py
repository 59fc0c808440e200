"""Text, identity and path scalars as Column expressions.

White space is Unicode's (as a language runtime's strip and split see it), and lengths
are in code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the RFC 4122 namespace for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def non_blank(text: Column) -> Column:
    """False for null, empty and white-space texts."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def token_count(text: Column) -> Column:
    """Words between white space; null counts as 0."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def or_default(value: Column, default: str | Column) -> Column:
    """`default` for null or empty."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), default)


def canonical_id(path: Column, symbol: Column | None = None) -> Column:
    """path, or path#symbol; back slashes become slashes and outer slashes go."""
    clean = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    if symbol is None:
        return clean
    return F.when(F.coalesce(symbol, F.lit("")) == "", clean).otherwise(F.concat(clean, F.lit("#"), strip(symbol)))


def global_id(repo_id: Column, path: Column, symbol: Column | None = None) -> Column:
    return F.struct(repo_id.alias("repo_id"), canonical_id(path, symbol).alias("canonical_id"))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID: SHA-1 of namespace and name with the version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def repo_id(url: Column) -> Column:
    """UUID of a normalised repository address: stripped, lower case, no trailing slash
    and no final .git."""
    name = F.regexp_replace(F.lower(strip(url)), "/+$", "")
    return uuid5(URL_NAMESPACE, F.regexp_replace(name, r"\.git$", ""))


def document_id(repo: Column, canonical: Column) -> Column:
    """Deterministic id of a node, so that rebuilding a repository keeps its ids."""
    return uuid5(URL_NAMESPACE, F.concat_ws("\n", repo, canonical))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "_")
    return or_default(F.regexp_replace(s, "^_+|_+$", ""), "section")


def nested_section_id(path: Column, parent_slugs: Column, own: Column) -> Column:
    return F.concat(path, F.lit("#"), F.when(or_default(parent_slugs, "") == "", own).otherwise(F.concat(parent_slugs, F.lit("."), own)))


def stem(path: Column) -> Column:
    """Last path segment without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def module_name(path: Column) -> Column:
    """Dotted module of a path. All trailing characters in {., p, y} go, as the original
    behaves: happy.py becomes ha."""
    return F.regexp_replace(F.translate(path, "/", "."), "[.py]+$", "")


def extension(name: Column) -> Column:
    """The last dot and what follows it, lower-cased, or ''."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def embedding_text(text: Column, chars: int = 800, most_words: int = 400) -> Column:
    """The first characters; then, if these have more words, the first words."""
    cut = F.substring(text, 1, chars)
    return F.when(token_count(cut) > most_words, F.array_join(F.slice(words(cut), 1, most_words), " ")).otherwise(cut)


def json_text(json: Column, key: str) -> Column:
    """A top-level value as text; null for a missing key or a JSON null. The key is taken
    as it is: dots and brackets in it have no meaning."""
    if re.fullmatch(r"\w+", key, re.ASCII):
        return F.get_json_object(json, f"$.{key}")
    return F.from_json(json, "map<string,string>").getItem(key)


def metadata_canonical_id(json: Column) -> Column:
    """canonical_id, or else source_metadata.canonical_id; empty ones are skipped."""
    none = F.lit("")
    return F.coalesce(F.nullif(json_text(json, "canonical_id"), none), F.nullif(F.get_json_object(json, "$.source_metadata.canonical_id"), none))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ",", -1), strip), lambda x: x != "")


def short_repo_name(repo: Column) -> Column:
    return F.concat(F.lit("repo-"), F.substring(repo, 1, 8))


def repo_title(repo: Column) -> Column:
    return F.concat(F.lit("Repository "), F.substring(repo, 1, 8))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"), F.lit(False))


def prompt(context: Column, query: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion:\n"), query)


def prompt_part(document: Column, chunk: Column, text: Column) -> Column:
    return F.concat(F.lit("["), document, F.lit("/"), chunk, F.lit("] "), text)


def summary_part(document: Column, summary: Column) -> Column:
    return F.concat(F.lit("[SUMMARY:"), document, F.lit("] "), summary)


def section_chunk_id(ingestion: Column, artifact: Column) -> Column:
    """The id of the one chunk of a section."""
    return uuid5(URL_NAMESPACE, F.concat_ws("\n", ingestion, artifact))


#: File types that the converter takes.
CONVERTED = (".docx", ".pptx", ".html", ".htm", ".epub")


def is_converted(name: Column) -> Column:
    """Whether a file's extension is one that the converter takes."""
    return F.coalesce(extension(name).isin(*CONVERTED), F.lit(False))


def shortened(text: Column, most: int = 4000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
