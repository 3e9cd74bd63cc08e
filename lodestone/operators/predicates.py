"""Filters, classifiers and scoping predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_filter(df: DataFrame, spec: dict) -> DataFrame:
    """Rows that meet every condition: plain values, ``$eq``, ``$in``, ``$gte``, ``$lte``."""
    tests: list[Column] = []
    for name, want in spec.items():
        ops = want if isinstance(want, dict) else {"$eq": want}
        for op, value in ops.items():
            c = F.col(name)
            tests.append({"$eq": lambda: c == value, "$in": lambda: c.isin(list(value)), "$gte": lambda: c >= value, "$lte": lambda: c <= value}[op]())
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def clamp(score: Column) -> Column:
    """A score between 0 and 1; a missing one is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.cast("double"), F.lit(0.0))))


def apply_threshold(hits: DataFrame, least: float) -> DataFrame:
    """Hits with clamped scores of at least ``least``."""
    return hits.withColumn("score", clamp(F.col("score"))).where(F.col("score") >= least)


def distance_to_score(distance: Column, mode: str = "half") -> Column:
    """1 - distance / 2, or 1 - distance, between 0 and 1."""
    return clamp(1 - distance / 2 if mode == "half" else 1 - distance)


def tenant_scope(df: DataFrame, prefix: str | None, others: list[str], labels: str = "labels") -> DataFrame:
    """A tenant's rows have a label with its prefix; the default tenant's have none with another's."""
    if prefix:
        return df.where(F.exists(labels, lambda x: x.startswith(prefix)))
    return df.where(~F.exists(labels, lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in others], F.lit(False))))


def name_contains(df: DataFrame, text: str, name: str = "name") -> DataFrame:
    """Rows whose name holds the text in any case."""
    return df.where(F.lower(name).contains(text.lower()))


def suggest(df: DataFrame, text: str, limit: int = 5, name: str = "name") -> DataFrame:
    """The first names that hold the text."""
    return name_contains(df, text, name).select(name).distinct().orderBy(name).limit(limit)


def match_file(df: DataFrame, text: str) -> DataFrame:
    """Rows whose path holds the text or whose name it is."""
    return df.where(F.col("path").contains(text) | (F.col("name") == text))


def normalise_entity(col: Column) -> Column:
    """A name without its file extension."""
    return F.regexp_replace(col, r"\.(py|sh|ksh|bash|f90|F90|f|F|js|ts|xml|yaml|yml|md|rst|txt|cmake)$", "")


def first_match(col: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first pattern that a column matches."""
    out = reduce(lambda a, r: a.when(col.rlike(r[0]), r[1]) if a is not None else F.when(col.rlike(r[0]), r[1]), rules, None)
    return out.otherwise(default)


def categories(df: DataFrame, col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """One row for each category (pattern, name) that a row's column matches."""
    hits = F.array_compact(F.array(*(F.when(F.col(col).rlike(p), F.lit(n)) for p, n in rules)))
    return df.withColumn("category", F.explode(F.array_distinct(hits)))


def classify_script(path: Column) -> Column:
    """Kind of script by its path, the first that fits."""
    low = F.lower(path)
    return F.when(low.contains("/jobs/"), "job").when(low.contains("/ush/"), "utility").when(low.contains("/scripts/"), "script").when(low.contains("/parm/"), "config").when(low.contains("/sorc/"), "source").when(low.contains("/modulefiles/"), "module").otherwise("other")


def script_category(name: Column, order: list[tuple[str, str]]) -> Column:
    """The category of the first part that an upper-cased name holds."""
    up = F.upper(name)
    return reduce(lambda a, r: a.when(up.contains(r[0]), r[1]), order[1:], F.when(up.contains(order[0][0]), order[0][1])).otherwise("other")


TRACE, GLOBAL = r"(?i)\b(call|calls|called|trace|path|flow|depend|depends|chain)\b", r"(?i)\b(architecture|overview|overall|system|design|structure|all)\b"


def classify_query(text: Column, entity: Column) -> Column:
    """TRACE, HYBRID (global words and an entity), GLOBAL or LOCAL."""
    return F.when(text.rlike(TRACE), "TRACE").when(text.rlike(GLOBAL) & entity.isNotNull(), "HYBRID").when(text.rlike(GLOBAL), "GLOBAL").otherwise("LOCAL")


def route_sources(text: Column, groups: dict[str, list[str]], least: float = 0.7) -> Column:
    """Names of the sources whose keywords a query holds; all of them if the share of its groups is small."""
    low = F.lower(text)
    score = {g: F.least(F.lit(1.0), sum((low.contains(w).cast("int") for w in ws), F.lit(0)) / F.lit(2.0) + F.lit(0.2)) for g, ws in groups.items()}
    hit = F.array_compact(F.array(*(F.when(s >= least, F.lit(g)) for g, s in score.items())))
    return F.when(F.size(hit) == 0, F.array(*map(F.lit, groups))).otherwise(hit)


def canonical_url(url: Column) -> Column:
    """Without fragment, query parameters in order, and without a slash at the end."""
    plain = F.regexp_replace(url, r"#.*$", "")
    head, query = F.split_part(plain, F.lit("?"), F.lit(1)), F.regexp_extract(plain, r"\?(.*)$", 1)
    head = F.regexp_replace(head, r"/+$", "")
    return F.when(query == "", head).otherwise(F.concat(head, F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def admit_urls(df: DataFrame, url: str, allow: list[str] = (), deny: list[str] = (), exclude: list[str] = (), include: list[str] = (), max_depth: int | None = None) -> DataFrame:
    """Rows whose host is an allowed domain or below one and no denied one, whose path is not
    excluded, is included (if anything is), and is no deeper than ``max_depth``."""
    u, host = F.col(url), host_of(F.col(url))
    within = lambda names: reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in names])
    ok = F.lit(True)
    if allow:
        ok = ok & within(allow)
    if deny:
        ok = ok & ~within(deny)
    for p in exclude:
        ok = ok & ~u.rlike(p)
    if include:
        ok = ok & reduce(lambda a, b: a | b, [u.rlike(p) for p in include])
    if max_depth is not None:
        ok = ok & (F.size(F.filter(F.split(path_of(u), "/"), lambda x: x != "")) <= max_depth)
    return df.where(ok)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob with ``*``, ``**`` and ``?``."""
    out = re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^(?:.*/)?{out}$"


def filter_paths(df: DataFrame, exclude: list[str], sensitive: list[str], cap: int) -> DataFrame:
    """Rows (``event, path``) without excluded paths, sensitive ones redacted, the first ``cap`` an event."""
    bad = reduce(lambda a, b: a | b, [F.col("path").rlike(glob_pattern(g)) for g in exclude], F.lit(False))
    hide = reduce(lambda a, b: a | b, [F.col("path").rlike(glob_pattern(g)) for g in sensitive], F.lit(False))
    out = df.where(~bad).withColumn("redacted", hide).withColumn("path", F.when(hide, "[redacted]").otherwise(F.col("path")))
    return out.withColumn("n", F.row_number().over(Window.partitionBy("event").orderBy("path"))).where(F.col("n") <= cap).drop("n")


#: Patterns of secrets in texts, in the order of their replacement.
SECRETS = [r"(?i)(?:api[_-]?key|token|secret|password)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{8,}[\"']?", r"\b[A-Za-z0-9+/]{40,}\b", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"]


def redact(df: DataFrame, col: str) -> DataFrame:
    """The column with secrets replaced, and ``redacted`` saying whether there were any."""
    hit = reduce(lambda a, b: a | b, [F.col(col).rlike(p) for p in SECRETS])
    text = reduce(lambda c, p: F.regexp_replace(c, p, "[REDACTED]"), SECRETS, F.col(col))
    return df.withColumn("redacted", hit).withColumn(col, text)


def search_files(nodes: DataFrame, pattern: str | None = None, language: str | None = None, limit: int = 100) -> DataFrame:
    """Paths that hold a pattern, or of a language, in order, the first ``limit``."""
    out = nodes if pattern is None else nodes.where(F.col("path").contains(pattern))
    out = out if language is None else out.where(F.col("language") == language)
    return out.select("path").orderBy("path").limit(limit)


def code_test_case(df: DataFrame, col: str = "name") -> DataFrame:
    """``app, mode, resolution, hours, kind`` read from a test case's name."""
    n = F.lower(F.col(col))
    mode = F.when(n.contains("coupled") | n.contains("s2s"), "coupled").when(n.contains("atm"), "atmosphere").otherwise("other")
    res = F.regexp_extract(n, r"c(\d{2,4})", 1).try_cast("int")
    tier = F.when(res <= 96, "low").when(res <= 384, "medium").when(res > 384, "high").otherwise("unknown")
    kind = F.when(n.contains("cycled"), "cycled").when(n.contains("forecast"), "forecast").otherwise("other")
    return df.withColumns({"mode": mode, "resolution": tier, "hours": F.regexp_extract(n, r"(\d+)h", 1).try_cast("int"), "kind": kind})
