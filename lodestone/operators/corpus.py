"""Corpus preparation: chunking, quality scores, categories, deduplication and provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import density_ok, normalised_hash, unescape, word_array


def lines(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, n, line``: every line with its number from 0."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))


def marked_lines(rows: DataFrame) -> DataFrame:
    """Lines with ``fenced`` (inside a code fence), ``level`` of a heading (null if none), ``section``
    (running count of headings) and ``header_path`` (enclosing headings joined by ' > ')."""
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*```")
    x = rows.withColumn("fenced", (F.sum(fence.cast("int")).over(w) % 2 == 1) & ~fence | fence)
    head = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    x = x.withColumn("level", F.when((head != "") & ~F.col("fenced"), F.length(head)))
    x = x.withColumn("title", F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("line", r"^#+\s+", ""))))
    x = x.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(w))
    # a heading of some level holds until one of its level or above follows
    parts = []
    for k in range(1, 7):
        last = F.last(F.when(F.col("level") == k, F.col("n")), ignorenulls=True).over(w)
        above = F.last(F.when(F.col("level") < k, F.col("n")), ignorenulls=True).over(w)
        title = F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(w)
        parts.append(F.when(last.isNotNull() & (above.isNull() | (last > above)), title))
    return x.withColumn("header_path", F.concat_ws(" > ", *parts))


def chunk_markdown(docs: DataFrame, least: int = 200) -> DataFrame:
    """``id, section, header_path, text``: one row for each section of at least ``least`` letters, code fences kept whole.

    A heading closes what stands before it: that is a chunk if it is long enough and is left out otherwise.
    """
    x = marked_lines(lines(docs)).groupBy("id", "section").agg(F.min_by("header_path", "n").alias("header_path"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    x = x.select("id", "section", "header_path", F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("text"))
    return x.where(F.length("text") >= least)


def chunk_rst(docs: DataFrame) -> DataFrame:
    """``id, section, title, text``: sections that begin at underlined titles."""
    w = Window.partitionBy("id").orderBy("n")
    x = lines(docs).withColumn("under", F.lead("line").over(w))
    is_title = (F.length(F.trim("line")) > 0) & F.col("under").rlike(r"^([=\-~^\"'`#*+])\1{2,}\s*$") & (F.length("under") >= F.length("line"))
    x = x.withColumn("head", F.coalesce(is_title, F.lit(False)))
    x = x.withColumn("section", F.sum(F.col("head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy("id", "section").agg(F.max(F.when(F.col("head"), F.trim("line"))).alias("title"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return x.select("id", "section", "title", F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("text"))


def pack(sizes: list[int], splittable: list[bool], target: int, most: int) -> list[int]:
    """The chunk of each element: a chunk ends where the next would pass the target and cannot be
    split, or would pass the maximum."""
    out, chunk, size = [], 0, 0
    for n, can in zip(sizes, splittable, strict=True):
        if size > 0 and size + n > target and (not can or size + n > most):
            chunk, size = chunk + 1, 0
        size += n
        out.append(chunk)
    return out


def merge_small(sizes: list[int], least: int) -> list[int]:
    """New numbers of chunks where one below ``least`` joins its successor."""
    out, k, i = [], 0, 0
    while i < len(sizes):
        out.append(k)
        if sizes[i] < least and i + 1 < len(sizes):
            out.append(k)
            i += 1
        i, k = i + 1, k + 1
    return out


def pack_chunks(elements: DataFrame, target: int = 1500, most: int = 3000, least: int = 200) -> DataFrame:
    """``id, chunk, text`` of elements (``id, n, text, splittable``): greedy packing, then small chunks join their successors.

    Elements are taken by ``n``; a null text counts as empty, and ``splittable`` null as not. Both steps fold one document's sorted
    array, which one row holds; nothing leaves the JVM. An id without elements has no rows.
    """
    own = elements.select("id", F.struct("n", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("splittable", F.lit(False)).alias("can")).alias("e"))
    packed = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("size"))

    def put(a: Column, e: Column) -> Column:
        size = F.length(e["text"])
        full = (a["size"] > 0) & (a["size"] + size > target) & (~e["can"] | (a["size"] + size > most))
        text = F.when(full | a["held"].isNull(), e["text"]).otherwise(F.concat(a["held"], F.lit("\n"), e["text"]))
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]).alias("done"), text.alias("held"), F.when(full, size).otherwise(a["size"] + size).alias("size"))

    def join(a: Column, text: Column) -> Column:
        small = a["held"].isNull() & (F.length(text) < least)
        whole = F.when(a["held"].isNull(), text).otherwise(F.concat(a["held"], F.lit("\n"), text))
        return F.struct(F.when(small, a["done"]).otherwise(F.concat(a["done"], F.array(whole))).alias("done"), F.when(small, text).alias("held"))

    last = lambda a: F.concat(a["done"], F.when(a["held"].isNull(), F.array().cast("array<string>")).otherwise(F.array(a["held"])))
    merged = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))
    x = own.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("id", F.aggregate("e", packed, put, last).alias("chunks"))
    return x.select("id", F.posexplode(F.aggregate("chunks", merged, join, last)).alias("chunk", "text"))


def chunk_tokens(docs: DataFrame, size: int = 512, overlap: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, chunk, start, n_tokens``: sliding windows of words; a tail no longer than the overlap is
    part of the window before."""
    n = F.size(word_array(F.col(text_col)))
    step = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    x = docs.select(id_col, n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return x.where("n > 0").select(id_col, "chunk", (F.col("chunk") * step).alias("start"), F.least(F.lit(size), F.col("n") - F.col("chunk") * step).alias("n_tokens"))


def chunk_sentences(docs: DataFrame, size: int = 500) -> DataFrame:
    """``id, chunk, text``: sentences packed up to ``size`` letters; longer ones are cut at words.

    A sentence ends with white space behind ``.``, ``!`` or ``?``. A single longer word is a chunk by itself. The fold stays in the JVM.
    """
    sentences = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])[ \t\n\x0B\f\r]+"), lambda s: s != "")
    words = lambda s: F.filter(F.split(s, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    pieces = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(words(s))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def put(a: Column, p: Column) -> Column:
        full = (a["held"] != "") & (F.length(a["held"]) + 1 + F.length(p) > size)
        text = F.when(full | (a["held"] == ""), p).otherwise(F.concat(a["held"], F.lit(" "), p))
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]).alias("done"), text.alias("held"))

    end = lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"])))
    return docs.select("id", F.posexplode(F.aggregate(pieces, start, put, end)).alias("chunk", "text"))


def split_text(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` letters, cut at the coarsest separator that allows it."""
    if len(text) <= size:
        return [text] if text else []
    sep, rest = separators[0], separators[1:]
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    out, held = [], ""
    for part in text.split(sep):
        joined = held + sep + part if held else part
        if len(joined) <= size:
            held = joined
            continue
        if held:
            out.append(held)
        held = ""
        if len(part) > size:
            out += split_text(part, size, rest)
        else:
            held = part
    return out + ([held] if held else [])


def chunk_recursive(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``id, chunk, text``: recursive cuts at paragraphs, lines and words; each chunk but the first
    begins with the end of the one before."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for key, text in zip(part.id, part.text.fillna(""), strict=True):
                pieces = split_text(text, size - overlap)
                out += [(str(key), i, (pieces[i - 1][-overlap:] if i and overlap else "") + p) for i, p in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["id", "chunk", "text"])

    return docs.select("id", "text").mapInPandas(cut, "id string, chunk int, text string")


#: Elements of a page that are left out, and those that are its parts (fixed values).
SKIPPED = ["nav", "header", "footer", "aside"]
PARTS = {"p": "text", "li": "list", "pre": "code", "td": "table", "th": "table"}
#: Skipped elements may stand in others of the same name this deep.
SKIP_DEPTH = 4
_PART = r"(?:h[1-6]|" + "|".join(PARTS) + r")(?=[\s>/])"


def chunk_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, seq, kind, level, text``: headings, paragraphs, lists, code and tables of each page in order.

    Comments, scripts, styles, navigation, headers, footers and asides are left out with all that
    is in them. A part ends at its own end tag, at the next part, or with the page; other tags inside
    it go, and character references are replaced. Parts without text are left out; null pages have none.
    Each page is one row for regular expressions without backtracking, so no page is gathered from rows.
    """
    html = F.regexp_replace(html_col, r"(?s)<!--.*?(?:-->|\z)|(?i)<(script|style)(?=[\s>/])[^>]*>.*?(?:</\1\s*>|\z)", "")
    skipped = "|".join(SKIPPED)
    for _ in range(SKIP_DEPTH):  # the innermost first
        html = F.regexp_replace(html, rf"(?i)<({skipped})(?=[\s>/])[^<]*+(?:<(?!/?\1[\s>/])[^<]*+)*+</\1\s*>", "")
    html = F.regexp_replace(html, rf"(?is)<(?:{skipped})(?=[\s>/]).*", "")
    pattern = rf"(?i)<({_PART})[^>]*>([^<]*+(?:<(?!/\1\s*>|{_PART})[^<]*+)*+)"

    def part(x: Column) -> Column:
        tag = F.lower(x["0"])
        kind = F.when(tag.startswith("h"), "heading")
        for name, k in PARTS.items():
            kind = kind.when(tag == name, k)
        text = unescape(F.regexp_replace(x["1"], r"<(?=[A-Za-z/!?])[^>]*>", ""))
        return F.struct(kind.alias("kind"), F.when(tag.startswith("h"), F.substr(tag, F.lit(2)).cast("int")).alias("level"), F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "").alias("text"))

    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1), F.regexp_extract_all("html", F.lit(pattern), 2))
    found = F.filter(F.transform(both, part), lambda x: x["text"] != "")
    x = pages.select(F.col(id_col), html.alias("html")).select(F.col(id_col), F.posexplode(found).alias("seq", "part"))
    return x.select(id_col, "seq", "part.kind", "part.level", "part.text")


def _hits(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def quality_a(text: Column, keywords: list[str], code: list[str]) -> Column:
    """0.5, and 0.1 each for 200 and 500 letters, 0.05 for each keyword up to 0.2, 0.1 for code; at most 1."""
    n, low = F.length(text), F.lower(text)
    score = 0.5 + 0.1 * (n > 200).cast("int") + 0.1 * (n > 500).cast("int") + F.least(F.lit(0.2), 0.05 * _hits(low, keywords)) + 0.1 * (_hits(text, code) > 0).cast("int")
    return F.round(F.least(F.lit(1.0), score), 6)


def quality_b(text: Column, terms: list[str], position: Column) -> Column:
    """0.5 by length, terms and an early place in its document, between 0 and 1."""
    n = F.length(text)
    score = 0.5 + F.when(n < 100, -0.2).when(n > 1000, 0.1).otherwise(0.0) + F.least(F.lit(0.3), 0.1 * _hits(F.lower(text), terms)) + F.when(position < 3, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def quality_c(text: Column, url: Column, has_metadata: Column) -> Column:
    """(length band + density + url + structure + metadata) / 5.5."""
    n = F.length(text)
    band = F.when(n.between(500, 2000), 1.5).when(n.between(200, 5000), 1.0).otherwise(0.5)
    density = F.length(F.regexp_replace(text, r"[^A-Za-z]", "")) / F.greatest(n, F.lit(1))
    parts = band + density + F.when(url.isNotNull(), 1.0).otherwise(0.0) + F.when(text.contains("\n"), 1.0).otherwise(0.0) + F.when(has_metadata, 1.0).otherwise(0.0)
    return F.round(parts / 5.5, 6)


def quality_d(has_header: Column, has_code: Column, has_list: Column, size: Column) -> Column:
    """0.6, and 0.1 for a header, code, a list, and a size of 200 to 2000; at most 1."""
    one = lambda c: F.when(c, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.6 + one(has_header) + one(has_code) + one(has_list) + one(size.between(200, 2000))), 6)


def quality_e(size: Column, structured: Column, example: Column, level: Column, directive: Column, intent: Column, category: Column) -> Column:
    """Length band, structure, example, heading level, directive, and two confidences; at most 1."""
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    score = F.when(size.between(200, 2000), 0.3).when(size > 50, 0.15).otherwise(0.0) + one(structured, 0.2) + one(example, 0.1) + one(level <= 2, 0.1) + one(directive, 0.1) + 0.1 * intent + 0.1 * category
    return F.round(F.least(F.lit(1.0), score), 6)


def importance(text: Column, terms: list[str], strong: str, title: str) -> Column:
    """1.0, 0.3 for each term, 0.5 for a strong word, 0.4 for a title word; at most 3."""
    low = F.lower(text)
    return F.round(F.least(F.lit(3.0), 1.0 + 0.3 * _hits(low, terms) + F.when(low.contains(strong), 0.5).otherwise(0.0) + F.when(low.contains(title), 0.4).otherwise(0.0)), 6)


def keywords(text: Column, vocabulary: list[str], most: int = 10) -> Column:
    """The vocabulary's words that a text holds, in its order, the first ``most``."""
    low = F.lower(text)
    return F.slice(F.filter(F.array(*map(F.lit, vocabulary)), lambda w: F.contains(low, w)), 1, most)


def categorize(docs: DataFrame, rules: dict[str, list[str]], most: int = 3) -> DataFrame:
    """``doc_id, category, confidence``: the best categories, confidence a fifth of the matches, at most 1."""
    low = F.lower("text")
    found = F.array(*(F.struct(F.lit(c).alias("category"), F.least(F.lit(1.0), _hits(low, ws) / 5.0).alias("confidence")) for c, ws in rules.items()))
    x = docs.select("doc_id", F.inline(found)).where("confidence > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "category")
    return x.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def intent(text: Column, rules: dict[str, list[str]]) -> Column:
    """Struct of intent and confidence: most keyword hits, max(min(n / 20, .9), .5); none: validation, .3."""
    low = F.lower(text)
    best = F.array_max(F.array(*(F.struct(_hits(low, ws).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(rules.items()))))
    sure = F.greatest(F.least(best["n"] / 20.0, F.lit(0.9)), F.lit(0.5))
    return F.struct(F.when(best["n"] > 0, best["name"]).otherwise("validation").alias("intent"), F.when(best["n"] > 0, sure).otherwise(0.3).alias("confidence"))


def directives(docs: DataFrame) -> DataFrame:
    """``id, directive, argument, attributes, body`` of blocks that begin with ``.. name:: argument``."""
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = lines(docs).withColumn("mark", F.col("line").rlike(r"^\.\. [\w-]+::")).withColumn("block", F.sum(F.col("mark").cast("int")).over(w)).where("block > 0")
    x = x.groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l")).withColumn("l", F.transform("l", lambda r: r["line"]))
    head, rest = F.element_at("l", 1), F.filter(F.slice("l", 2, 1_000_000), lambda s: s.rlike(r"^\s+\S"))
    attrs = F.map_from_entries(F.transform(F.filter(rest, lambda s: s.rlike(r"^\s+:[\w-]+:")), lambda s: F.struct(F.regexp_extract(s, r":([\w-]+):", 1), F.trim(F.regexp_replace(s, r"^\s+:[\w-]+:", "")))))
    body = F.array_join(F.transform(F.filter(rest, lambda s: ~s.rlike(r"^\s+:[\w-]+:")), lambda s: F.trim(s)), "\n")
    return x.select("id", F.regexp_extract(head, r"^\.\. ([\w-]+)::", 1).alias("directive"), F.trim(F.regexp_replace(head, r"^\.\. [\w-]+::", "")).alias("argument"), attrs.alias("attributes"), body.alias("body"))


def code_blocks(docs: DataFrame) -> DataFrame:
    """``id, n, language, code`` of fenced blocks."""
    pattern = r"(?s)```([\w+-]*)[ \t]*\n(.*?)```"
    a, b = F.regexp_extract_all("text", F.lit(pattern), 1), F.regexp_extract_all("text", F.lit(pattern), 2)
    x = docs.select("id", F.posexplode(F.arrays_zip(a.alias("language"), b.alias("code"))).alias("n", "x"))
    return x.select("id", "n", F.when(F.col("x.language") != "", F.col("x.language")).alias("language"), F.col("x.code").alias("code"))


def chunk_functions(lines_: DataFrame, functions: DataFrame) -> DataFrame:
    """``chunk_id, path, name, text`` of functions (``path, name, first, last``) over lines (``path, n, line``),
    with a header of path and name."""
    x = lines_.join(functions, "path").where("n between first and last").groupBy("path", "name", "first").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda r: r["line"]), "\n")
    key = F.left(F.sha2(F.concat_ws(":", "path", "name", F.col("first").cast("string")), 256), F.lit(16))
    return x.select(key.alias("chunk_id"), "path", "name", F.concat(F.lit("# "), "path", F.lit(" "), "name", F.lit("\n"), body).alias("text"))


def dedupe_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest``: the smallest id of each normalised text."""
    return docs.groupBy(normalised_hash(F.col(text_col)).alias("digest")).agg(F.min(id_col).alias(id_col))


def dedupe_registry(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """``doc_id, digest, canonical_id, is_reference``: texts known to the registry (``digest, canonical_id``)
    or seen under a smaller id point at that row."""
    x = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    first = x.groupBy("digest").agg(F.min("doc_id").alias("first"))
    x = x.join(first, "digest").join(registry, "digest", "left").withColumn("canonical_id", F.coalesce("canonical_id", "first"))
    return x.select("doc_id", "digest", "canonical_id", (F.col("doc_id") != F.col("canonical_id")).alias("is_reference"))


def consolidate(collections: list[DataFrame]) -> DataFrame:
    """``doc_id, url, score``: all rows that pass the density filter, one for each text, then the best of
    each URL."""
    x = reduce(DataFrame.unionByName, collections).where(density_ok(F.col("text")))
    x = x.join(dedupe_exact(x).select("doc_id"), "doc_id", "left_semi")
    w = Window.partitionBy("url").orderBy(F.desc("score"), "doc_id")
    return x.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "url", "score")


def with_provenance(docs: DataFrame, source: str, commit: str, dirty: bool, profile: str, dimension: int) -> DataFrame:
    """Documents with columns of where they come from."""
    return docs.withColumns({"prov_source": F.lit(source), "prov_commit": F.lit(commit), "prov_dirty": F.lit(dirty), "prov_profile": F.lit(profile), "prov_dimension": F.lit(dimension)})


def pending_embeddings(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Ids of non-empty source rows without a vector."""
    return source.where(F.length(F.trim("text")) > 0).select(key).join(target.select(key), key, "left_anti")


def semantic_tags(text: Column, categories: list[str], technical: list[str], most: int = 10) -> Column:
    """Category words, the first five all-caps names (lower-cased) and technical words, sorted."""
    low = F.lower(text)
    found = F.filter(F.array(*map(F.lit, categories + technical)), lambda w: F.contains(low, w))
    caps = F.transform(F.slice(F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_])([A-Z][A-Z0-9_]{2,})"), 1), 1, 5), lambda w: F.lower(w))
    return F.slice(F.array_sort(F.array_distinct(F.concat(found, caps))), 1, most)


def apply_batches(docs: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's batch function over Arrow batches."""
    return docs.mapInPandas(fn, schema)
