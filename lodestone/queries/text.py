"""Text, filter, window and set operators over documents, pages, events and the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import aggregates as A
from lodestone.operators import joins as J
from lodestone.operators import predicates as P
from lodestone.operators import ranking as W
from lodestone.operators import sets as U
from lodestone.operators import writes as S
from lodestone.plans.stages import table

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


#: Words between white space in DuckDB's SQL.
WORDS = "list_filter(string_split_regex({0}, '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '')"


def simple(name, expr, sql, source="documents", key="doc_id"):
    """A query of one expression for each row, and its SQL."""
    query(name, f"SELECT {key}, {sql} AS v FROM {source}")(lambda spark, d: table(spark, d, source).select(key, expr().alias("v")))


simple("f01_token_estimate", lambda: T.token_estimate(F.col("text")), f"CAST(ceil(len({WORDS.format('text')}) * 13 / 10.0) AS INT)")
simple("f02_deterministic_id", lambda: T.deterministic_id(F.col("source"), F.col("text")), "left(sha256(source || left(text, 500)), 16)")
simple("f03_normalised_hash", lambda: T.normalised_hash(F.col("text")), "sha256(trim(regexp_replace(lower(text), '[\\t\\n\\v\\f\\r ]+', ' ', 'g')))")
simple("f04_md5", lambda: F.md5("text"), "md5(text)")
simple("f06_slug", lambda: T.slug(F.col("text")), "regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
simple("f06_slug_whole", lambda: T.slug(F.col("text")), "regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
simple("f07_code_identifier", lambda: T.is_code_identifier(F.col("text")), "regexp_matches(text, '[a-z][A-Z]') OR regexp_matches(text, '\\w_\\w') OR regexp_matches(text, '\\w\\.\\w') OR contains(text, '/')")
simple("f08_quality_content", lambda: T.quality_content(F.col("text")), "length(text) >= 20 AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / length(text) > 0.5")
simple("f09_density", lambda: T.density_ok(F.col("text")), "length(text) BETWEEN 100 AND 5000 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) >= 0.1 AND trim(text) <> ''")
simple("f10_duration_minutes", lambda: T.duration_minutes(F.concat(F.pmod("event_id", F.lit(5)), F.lit("h "), F.pmod("event_id", F.lit(60)), F.lit("m"))), "(event_id % 5) * 60 + event_id % 60", "events", "event_id")
simple("p02_clamp", lambda: P.clamp(F.col("value") / 100), "greatest(0.0, least(1.0, coalesce(value / 100, 0.0)))", "events", "event_id")
simple("p03_distance_to_score", lambda: P.distance_to_score(F.col("value") / 50), "greatest(0.0, least(1.0, 1 - (value / 50) / 2))", "events", "event_id")
simple("p15_canonical_url", lambda: P.canonical_url(F.col("url")), "CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') AND regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) <> '' THEN regexp_replace(split_part(regexp_replace(url, '#.*$', ''), '?', 1), '/+$', '') || '?' || array_to_string(list_sort(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&')), '&') ELSE regexp_replace(split_part(regexp_replace(url, '#.*$', ''), '?', 1), '/+$', '') END", "pages", "page_id")
JOBS = [("(?i)promo", "promotion"), ("(?i)economy", "economy"), ("(?i)standard", "standard")]
simple("p08_categorize", lambda: P.first_match(F.col("p_type"), JOBS, "other"), "CASE WHEN regexp_matches(p_type, '(?i)promo') THEN 'promotion' WHEN regexp_matches(p_type, '(?i)economy') THEN 'economy' WHEN regexp_matches(p_type, '(?i)standard') THEN 'standard' ELSE 'other' END", "part", "p_partkey")
simple("p11_script_category", lambda: P.script_category(F.col("p_name"), [("A", "a"), ("E", "e"), ("1", "one")]), "CASE WHEN contains(upper(p_name), 'A') THEN 'a' WHEN contains(upper(p_name), 'E') THEN 'e' WHEN contains(upper(p_name), '1') THEN 'one' ELSE 'other' END", "part", "p_partkey")
simple("p13_classify_query", lambda: P.classify_query(F.col("text"), F.when(F.col("role") == "user", F.col("role"))), "CASE WHEN regexp_matches(text, '(?i)\\b(call|calls|called|trace|path|flow|depend|depends|chain)\\b') THEN 'TRACE' WHEN regexp_matches(text, '(?i)\\b(architecture|overview|overall|system|design|structure|all)\\b') AND role = 'user' THEN 'HYBRID' WHEN regexp_matches(text, '(?i)\\b(architecture|overview|overall|system|design|structure|all)\\b') THEN 'GLOBAL' ELSE 'LOCAL' END", "conversations", "conv_id, turn".split(",")[0])
simple("p14_route_sources", lambda: F.array_join(P.route_sources(F.col("text"), {"alpha": ["the", "and"], "beta": ["der", "und"]}), ","), "CASE WHEN a AND b THEN 'alpha,beta' WHEN a THEN 'alpha' WHEN b THEN 'beta' ELSE 'alpha,beta' END".replace(" a ", " (contains(lower(text), 'the') OR contains(lower(text), 'and')) ").replace(" b ", " (contains(lower(text), 'der') OR contains(lower(text), 'und')) "))
SECRET_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:api[_-]?key|token|secret|password)\\s*[=:]\\s*[\"'']?[A-Za-z0-9_\\-]{8,}[\"'']?', '[REDACTED]', 'g'), '\\b[A-Za-z0-9+/]{40,}\\b', '[REDACTED]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED]', 'g')"


@query("p18_redact", f"SELECT doc_id, md5({SECRET_SQL}) AS digest, {SECRET_SQL} <> text AS redacted FROM documents")
def p18(spark, d):
    return P.redact(docs(spark, d), "text").select("doc_id", F.md5("text").alias("digest"), "redacted")


@query("p01_where_filter", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 500 AND n_chars <= 3000 AND source = 'src1'")
def p01(spark, d):
    return P.where_filter(docs(spark, d), {"lang": {"$in": ["en", "de"]}, "n_chars": {"$gte": 500, "$lte": 3000}, "source": "src1"}).select("doc_id")


@query("p02_threshold", "SELECT event_id, greatest(0.0, least(1.0, coalesce(value / 100, 0.0))) AS score FROM events WHERE greatest(0.0, least(1.0, coalesce(value / 100, 0.0))) >= 0.5")
def p02(spark, d):
    return P.apply_threshold(table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("score")), 0.5)


@query("p04_tenant_scope", "SELECT doc_id FROM documents WHERE NOT (source LIKE 'src1%' OR lang LIKE 'src1%') AND NOT (source LIKE 'src2%' OR lang LIKE 'src2%')")
def p04(spark, d):
    return P.tenant_scope(docs(spark, d).withColumn("labels", F.array("source", "lang")), None, ["src1", "src2"]).select("doc_id")


@query("p05_name_contains", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a')")
def p05(spark, d):
    return P.name_contains(table(spark, d, "part"), "A", "p_name").select("p_partkey")


@query("p06_match_file", "SELECT page_id FROM pages WHERE contains(url, 'page') OR CAST(page_id AS VARCHAR) = 'page'")
def p06(spark, d):
    return P.match_file(table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.col("page_id").cast("string").alias("name")), "page").select("page_id")


@query("p09_categories", "SELECT category, count(*) AS n FROM (SELECT 'brass' AS category FROM part WHERE regexp_matches(p_type, '(?i)brass') UNION ALL SELECT 'promo' FROM part WHERE regexp_matches(p_type, '(?i)promo') UNION ALL SELECT 'any' FROM part) q GROUP BY 1")
def p09(spark, d):
    return A.label_counts(P.categories(table(spark, d, "part"), "p_type", [("(?i)brass", "brass"), ("(?i)promo", "promo"), (".", "any")]), "category").withColumnRenamed("label", "category")


HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"


@query("p16_admit_urls", f"SELECT page_id FROM pages WHERE ({HOST} = 'example.com' OR {HOST} LIKE '%.example.com' OR {HOST} LIKE '%.org') AND NOT regexp_matches(url, 'private') AND len(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) <= 3")
def p16(spark, d):
    return P.admit_urls(table(spark, d, "pages"), "url", allow=["example.com", "org"], exclude=["private"], max_depth=3).select("page_id")


@query("p19_search_files", "SELECT url AS path FROM pages WHERE contains(url, '1') ORDER BY url LIMIT 100")
def p19(spark, d):
    return P.search_files(table(spark, d, "pages").select(F.col("url").alias("path")), "1")


@query("s02_changed_files", "WITH a AS (SELECT doc_id AS path, text FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.text IS DISTINCT FROM b.text")
def s02(spark, d):
    x = docs(spark, d).select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    old = x.where("path % 3 <> 0").withColumn("content", F.when(F.expr("path % 5 = 0"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return S.changed_files(x.where("path % 7 <> 0"), old)


@query("s08_upsert", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'new', n_chars + 1 FROM documents WHERE doc_id % 4 = 0")
def s08(spark, d):
    x = docs(spark, d).select("doc_id", "source", "n_chars")
    new = x.where("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    return S.upsert_documents(x, new)


@query("s09_merge_nodes", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (WHERE value > 50) AS value FROM events GROUP BY user_id")
def s09(spark, d):
    x = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return S.merge_nodes(x, "user_id", "event_id")


@query("s11_pending_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s11(spark, d):
    return S.pending_files(docs(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("a10_lines_of_code", "SELECT source AS repo, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, count(*) AS files FROM documents GROUP BY 1")
def a10(spark, d):
    return A.lines_of_code(docs(spark, d), "source", "text")


@query("a15_hit_rate", "SELECT lang AS category, count(*) AS queries, round(avg(CAST(quality AS DOUBLE)), 6) AS hit_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a15(spark, d):
    return A.hit_rate(docs(spark, d).join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("category"), F.col("quality").alias("hit")))


@query("a16_source_health", "SELECT event_type AS source, count(*) AS n, round(avg(value), 2) AS quality, CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-24 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS recent, round(1 - sum(CASE WHEN ts >= TIMESTAMP '2024-01-24 00:00:00' THEN 1 ELSE 0 END) / count(*), 6) AS stale_ratio FROM events GROUP BY 1")
def a16(spark, d):
    return A.source_health(table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("value").alias("quality"), F.col("ts").alias("updated")), "2024-01-31 00:00:00")


@query("a17_crawl_stats", f"SELECT {HOST} AS host, len(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) AS depth, count(*) AS n FROM pages GROUP BY 1, 2")
def a17(spark, d):
    return A.crawl_stats(table(spark, d, "pages").select(P.host_of(F.col("url")).alias("host"), P.path_of(F.col("url")).alias("path")))


@query("a18_quality_buckets", "SELECT CASE WHEN value / 100 >= 0.8 THEN 'high' WHEN value / 100 >= 0.6 THEN 'medium' WHEN value / 100 >= 0.4 THEN 'low' ELSE 'very_low' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def a18(spark, d):
    return A.quality_buckets(table(spark, d, "events").withColumn("q", F.col("value") / 100), "q")


@query("a19_session_analytics", "SELECT user_id AS session, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END) = 2 THEN 'completed' WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'abandoned' ELSE 'started' END AS status, count(*) AS steps, round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60, 4) AS minutes FROM events GROUP BY 1")
def a19(spark, d):
    return sessions(spark, d).drop("last_ts")


def sessions(spark, d):
    return A.session_analytics(table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("event"), "ts"), "purchase", "error")


@query("a19_session_summary", """WITH s AS (SELECT user_id AS session, max(CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END) AS st, count(*) AS steps, round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60, 4) AS minutes, max(ts) AS last_ts FROM events GROUP BY 1),
    l AS (SELECT steps FROM s ORDER BY last_ts DESC, session DESC LIMIT 10)
    SELECT count(*) FILTER (WHERE st = 2) AS completed, count(*) FILTER (WHERE st = 1) AS abandoned, count(*) FILTER (WHERE st = 0) AS in_progress, round(avg(minutes) FILTER (WHERE st = 2), 4) AS mean_minutes, min(minutes) FILTER (WHERE st = 2) AS least_minutes, max(minutes) FILTER (WHERE st = 2) AS most_minutes, (SELECT round(avg(steps), 1) FROM l) AS mean_steps FROM s""")
def a19_summary(spark, d):
    return A.session_summary(sessions(spark, d))


@query("a19_tag_distribution", "SELECT coalesce(nullif(event_type, 'error'), 'unknown') AS tag, count(*) AS n, CAST(round_even(count(*) * 100 / (SELECT count(*) FROM events), 0) AS BIGINT) AS percent FROM events GROUP BY 1")
def a19_tags(spark, d):
    return A.tag_distribution(table(spark, d, "events").select(F.nullif("event_type", F.lit("error")).alias("tag")))


@query("a17_sitemap_stats", """WITH u AS (SELECT CASE WHEN length(url) % 3 > 0 THEN CAST(length(url) % 10 AS DOUBLE) / 8 END AS p, CASE WHEN url LIKE 'https%' THEN 'daily' END AS f FROM pages),
    x AS (SELECT 'priority' AS kind, CAST(floor(coalesce(nullif(p, 0), 0.5) * 10) / 10 AS VARCHAR) AS bucket FROM u UNION ALL SELECT 'changefreq', coalesce(f, 'unknown') FROM u) SELECT kind, bucket, count(*) AS n FROM x GROUP BY 1, 2""")
def a17_sitemap(spark, d):
    p = table(spark, d, "pages").select(F.expr("CASE WHEN length(url) % 3 > 0 THEN CAST(length(url) % 10 AS DOUBLE) / 8 END").alias("priority"), F.expr("CASE WHEN url LIKE 'https%' THEN 'daily' END").alias("changefreq"))
    return A.sitemap_stats(p)


@query("w02_snapshot_delta", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def w02(spark, d):
    return W.snapshot_delta(table(spark, d, "events"), "user_id", "ts", "value", "event_id").select("event_id", F.round("delta", 6).alias("delta"))


@query("w03_jump_anomalies", "SELECT event_id, round(abs(value - p) / p, 6) AS jump FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) q WHERE p > 0 AND abs(value - p) / p > 0.1")
def w03(spark, d):
    return W.jump_anomalies(table(spark, d, "events"), "user_id", "ts", "value", "event_id").select("event_id", F.round("jump", 6).alias("jump"))


@query("w04_trend", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), x AS (SELECT * FROM k WHERE n <= 10) SELECT user_id, arg_max(value, n) AS \"first\", arg_min(value, n) AS \"last\", round(avg(value), 6) AS mean, round(arg_min(value, n) - arg_max(value, n), 6) AS change FROM x GROUP BY 1")
def w04(spark, d):
    return W.trend(table(spark, d, "events"), "user_id", "ts", "value", "event_id", 10)


@query("w05_dedupe_first", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations) q WHERE n = 1")
def w05(spark, d):
    return W.dedupe_first(table(spark, d, "conversations"), F.struct("role", "text"), ["conv_id", "turn"]).select("conv_id", "turn")


@query("w05_dedupe_first_whole", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations) q WHERE n = 1")
def w05_whole(spark, d):
    return W.dedupe_first(table(spark, d, "conversations"), F.struct("role", "text"), ["conv_id", "turn"]).select("conv_id", "turn")


@query("w06_keep_richest", "SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY left(text, 200) ORDER BY n_chars DESC, source DESC, doc_id) AS n FROM documents) q WHERE n = 1")
def w06(spark, d):
    return W.keep_richest(docs(spark, d), F.left("text", F.lit(200)), F.col("n_chars"), "source", "doc_id").select("doc_id")


CANON = ORACLE_SQL["p15_canonical_url"].split("SELECT page_id, ", 1)[1].rsplit(" AS v FROM", 1)[0]


@query("w07_best_by_url", f"SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {CANON} ORDER BY length(html) DESC, page_id) AS n FROM pages) q WHERE n = 1")
def w07(spark, d):
    x = table(spark, d, "pages").select("page_id", P.canonical_url(F.col("url")).alias("u"), F.length("html").alias("score"))
    return W.best_by_url(x, "u", "score", "page_id").select("page_id")


@query("w08_cap_per_group", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) q WHERE n <= 2")
def w08(spark, d):
    return W.cap_per_group(table(spark, d, "conversations"), "conv_id", 2, ["turn"]).select("conv_id", "turn")


SESSIONS = """x AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
    y AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM x)"""


@query("w15_sessionize", f"WITH {SESSIONS} SELECT user_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM y GROUP BY 1, 2")
def w15(spark, d):
    return W.sessionize(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("t01_merge_topk", "WITH a AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang, left(text, 200) ORDER BY n_chars DESC, doc_id) AS n FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM a WHERE n = 1) SELECT lang, doc_id AS id FROM b WHERE k <= 10")
def t01(spark, d):
    x = docs(spark, d).select("lang", F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), F.col("text").alias("content"))
    return W.merge_topk(x, "lang", 10).select("lang", "id")


@query("t02_merge_by_distance", "SELECT source, doc_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM documents) q WHERE n <= 5")
def t02(spark, d):
    return W.merge_by_distance(docs(spark, d).select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("distance")), "source", 5).select("source", "id")


@query("t06_sample_metadata", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '0', doc_id::VARCHAR, source))) AS n FROM documents) x WHERE n <= 5")
def t06(spark, d):
    return W.sample_metadata(docs(spark, d).select("doc_id", "source"), "source", 100, 20)


@query("t07_last_sessions", "SELECT user_id, min(ts) AS first_ts FROM events GROUP BY 1 ORDER BY first_ts DESC, user_id LIMIT 20")
def t07(spark, d):
    return W.last_sessions(table(spark, d, "events"), "user_id", "ts", 20)


@query("u01_union_names", "SELECT c_name AS c_name FROM customer UNION SELECT s_name FROM supplier UNION SELECT n_name FROM nation")
def u01(spark, d):
    t = lambda n, c: table(spark, d, n).select(c)
    return U.union_names(t("customer", "c_name"), t("supplier", "s_name"), t("nation", "n_name"))


@query("u02_compare_results", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u02(spark, d):
    return U.compare_results(docs(spark, d).select("doc_id"), table(spark, d, "labels").select("doc_id"))


@query("u03_jaccard", "WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS x, list(DISTINCT o_orderstatus) AS y FROM orders GROUP BY 1) SELECT o_custkey, round(len(list_intersect(x, ['1-URGENT', '2-HIGH'])) / len(list_distinct(list_concat(x, ['1-URGENT', '2-HIGH']))), 6) AS j FROM a")
def u03(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("x"))
    return x.select("o_custkey", F.round(U.jaccard(F.col("x"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))), 6).alias("j"))


@query("j09_multi_collection", "SELECT doc_id AS id, 'documents' AS collection FROM documents UNION ALL SELECT page_id, 'pages' FROM pages UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def j09(spark, d):
    t = lambda n, c: table(spark, d, n).select(F.col(c).alias("id"))
    return J.multi_collection({"documents": t("documents", "doc_id"), "pages": t("pages", "page_id"), "benchmark": t("benchmark", "item_id")})


@query("j13_enrich_identifiers", "WITH k AS (SELECT DISTINCT source AS key FROM documents ORDER BY 1 LIMIT 15), x AS (SELECT source AS key, doc_id AS id, left(text, 500) AS content, n_chars AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE source IN (SELECT key FROM k)) SELECT key, id, content, score FROM x WHERE n = 1")
def j13(spark, d):
    x = docs(spark, d).select(F.col("source").alias("key"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("score"))
    return J.enrich_identifiers(x.select("key"), x)


@query("j14_resolve_references", "WITH c AS (SELECT text, min(doc_id) AS k FROM documents GROUP BY 1) SELECT doc_id AS id, CASE WHEN doc_id <> k THEN k END AS canonical_id, md5(d.text) AS digest FROM documents d JOIN c ON d.text = c.text")
def j14(spark, d):
    x = docs(spark, d)
    c = x.groupBy("text").agg(F.min("doc_id").alias("k"))
    x = x.join(c, "text").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") != F.col("k"), F.col("k")).alias("canonical_id"), F.when(F.col("doc_id") == F.col("k"), F.col("text")).alias("content"))
    return J.resolve_references(x).select("id", "canonical_id", F.md5("content").alias("digest"))


@query("j15_compare_counts", "WITH a AS (SELECT CAST(doc_id % 50 AS BIGINT) AS key, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT CAST(page_id % 40 AS BIGINT) AS key, count(*) AS n FROM pages GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, a.n AS left_n, b.n AS right_n, a.n IS NOT DISTINCT FROM b.n AS equal FROM a FULL JOIN b ON a.key = b.key")
def j15(spark, d):
    a = docs(spark, d).groupBy((F.col("doc_id") % 50).alias("key")).agg(F.count("*").alias("n"))
    return J.compare_counts(a, table(spark, d, "pages").groupBy((F.col("page_id") % 40).alias("key")).agg(F.count("*").alias("n")))


@query("f12_word_jaccard", f"WITH w AS (SELECT doc_id, list_distinct({WORDS.format('lower(text)')}) AS w FROM documents) SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS j FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def f12(spark, d):
    x = docs(spark, d)
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return x.join(y, "doc_id").select("doc_id", F.round(T.word_jaccard(F.col("text"), F.col("other")), 6).alias("j"))


@query("f14_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f14(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("f15_truncated_score", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding[1:16] AS DOUBLE[]), CAST(b.embedding[1:16] AS DOUBLE[])) + 1.0, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f15(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(T.truncated_score(F.col("embedding"), F.col("other"), 16), 6).alias("score"))
