"""Scalar functions on text, identifiers, dates and vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_array(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded up in whole numbers; null and empty give 0."""
    return F.coalesce(F.ceil(F.size(word_array(F.coalesce(text, F.lit("")))) * 13 / 10).cast("int"), F.lit(0))


def deterministic_id(source: Column, content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of source and the content's first 500 letters."""
    return F.left(F.sha2(F.concat(source, F.left(content, F.lit(500))), 256), F.lit(16))


def normalised_hash(text: Column) -> Column:
    """SHA-256 of lower-case text with single spaces."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256)


def event_fingerprint(files: Column, status: Column, session: Column) -> Column:
    """16 hex digits of the SHA-256 over sorted files, status and session."""
    return F.left(F.sha2(F.to_json(F.struct(F.array_sort(files).alias("files"), status.alias("status"), session.alias("session"))), 256), F.lit(16))


def slug(text: Column) -> Column:
    """Lower case, runs of other signs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def is_code_identifier(text: Column) -> Column:
    """camelCase, snake_case, dotted names and paths."""
    return text.rlike(r"[a-z][A-Z]") | text.rlike(r"\w_\w") | text.rlike(r"\w\.\w") | text.contains("/")


def quality_content(text: Column) -> Column:
    """At least 20 letters long and more than half of them alphanumeric."""
    return (F.length(text) >= 20) & (F.length(F.regexp_replace(text, r"[^A-Za-z0-9]", "")) / F.length(text) > 0.5)


def density_ok(text: Column) -> Column:
    """100 to 5000 letters, at least a tenth of them A to Z, not blank."""
    n = F.length(text)
    return n.between(100, 5000) & (F.length(F.regexp_replace(text, r"[^A-Za-z]", "")) / n >= 0.1) & (F.trim(text) != "")


def duration_minutes(text: Column) -> Column:
    """Minutes of texts like ``1h 22m``; null where no part matches."""
    part = lambda unit: F.regexp_extract(text, rf"(\d+)\s*{unit}", 1).try_cast("int")
    h, m = part("h"), part("m")
    return F.when(h.isNull() & m.isNull(), None).otherwise(F.coalesce(h, F.lit(0)) * 60 + F.coalesce(m, F.lit(0)))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 time, without a zone as UTC; bad texts are null."""
    return F.try_to_timestamp(F.regexp_replace(text, r"Z$", "+00:00"))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' sets of lower-case words; 0 if both have none."""
    x, y = F.array_distinct(word_array(F.lower(a))), F.array_distinct(word_array(F.lower(b)))
    n = F.size(F.array_union(x, y))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / n)


def keyword_coverage(query: Column, content: Column) -> Column:
    """The share of the query's distinct words that occur among the content's words."""
    q = F.array_distinct(word_array(F.lower(query)))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, word_array(F.lower(content)))) / F.size(q))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays; 0 where one has length zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def truncated_score(a: Column, b: Column, d: int) -> Column:
    """Cosine of the first d components, plus one."""
    return cosine(F.slice(a, 1, d), F.slice(b, 1, d)) + 1.0


def repo_relative(path: Column, roots: list[str]) -> Column:
    """The path without the first root that it begins with, and without leading slashes."""
    out = path
    for root in roots:
        out = F.regexp_replace(out, "^" + root.replace(".", r"\.").rstrip("/") + "/", "")
    return F.regexp_replace(out, r"^(\./|/)+", "")


def shebang(content: Column) -> Column:
    """The interpreter of a first line ``#!``; null without."""
    found = F.regexp_extract(content, r"^#!\s*(?:/usr/bin/env\s+)?(\S+)", 1)
    return F.when(found != "", F.element_at(F.split(found, "/"), -1))


def checklist_items(text: Column, most: int = 8) -> Column:
    """Bulleted, numbered and imperative lines, without their marks, the first ``most``."""
    mark = r"^\s*(?:[-*+]|\d+[.)])\s+"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(mark) | x.rlike(r"^\s*(?:Must|Should|Ensure|Verify|Use|Check|Avoid)\b"))
    return F.slice(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, mark, ""))), 1, most)


def language_of_labels(labels: Column) -> Column:
    """The first of Python, Fortran, Shell, Rocoto and Job in the joined labels, lower-cased."""
    text = F.array_join(labels, " ")
    out = F.when(text.contains("Python"), "python")
    for name in ("Fortran", "Shell", "Rocoto", "Job"):
        out = out.when(text.contains(name), name.lower())
    return out.otherwise("unknown")


def sanitised(metadata: Column) -> Column:
    """A map with every value as text; nulls become empty text."""
    return F.transform_values(metadata, lambda k, v: F.coalesce(v.cast("string"), F.lit("")))


#: Named character references that are replaced (fixed values); the ampersand comes last.
ENTITIES = [
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("copy", "\u00a9"), ("reg", "\u00ae"), ("deg", "\u00b0"), ("middot", "\u00b7"),
    ("laquo", "\u00ab"), ("raquo", "\u00bb"), ("times", "\u00d7"), ("ndash", "\u2013"), ("mdash", "\u2014"), ("lsquo", "\u2018"), ("rsquo", "\u2019"),
    ("ldquo", "\u201c"), ("rdquo", "\u201d"), ("bull", "\u2022"), ("hellip", "\u2026"), ("amp", "&"),
]


def unescape(text: Column) -> Column:
    """Character references replaced: the names in ``ENTITIES`` and any number; others stay as they are."""

    def one(part: Column) -> Column:
        number = F.regexp_extract(part, r"^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        code = F.when(number.rlike("^[xX]"), F.conv(F.substr(number, F.lit(2)), 16, 10).cast("long")).otherwise(number.cast("long"))
        valid = (number != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(letter, F.substr(part, F.length(number) + 2))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#")
    out = F.when(text.contains("&#"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))).otherwise(text)
    for name, letter in ENTITIES:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(letter))
    return F.when(text.contains("&"), out).otherwise(text)
