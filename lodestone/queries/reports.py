"""Chunking, scores, reports, traversal bundles and evaluation over documents and the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import community as C
from lodestone.operators import corpus as D
from lodestone.operators import evaluate as E
from lodestone.operators import joins as J
from lodestone.operators import quality as Q
from lodestone.operators import ranking as W
from lodestone.operators import search as R
from lodestone.operators import traversal as G
from lodestone.plans.stages import table

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# -- chunks of markdown, reST and code that stand for the rows of orders

MARKDOWN = "'intro ' || o_orderkey || chr(10) || '# Order ' || o_orderkey || chr(10) || o_orderstatus || chr(10) || '```sh' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '## Status' || chr(10) || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '# Last' ELSE '' END"
RST = "'Order ' || o_orderkey || chr(10) || '===============' || chr(10) || o_orderstatus || chr(10) || chr(10) || 'Status' || chr(10) || '------' || chr(10) || o_orderpriority"


def orders(spark, d, text):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(text).alias("text"))


CODE = "o_orderstatus || chr(10) || '```sh' || chr(10) || '# no heading' || chr(10) || '```' || chr(10)"


@query("d01_chunk_markdown", f"""SELECT o_orderkey AS id, 0 AS section, '' AS header_path, 'intro ' || o_orderkey AS text FROM orders
    UNION ALL SELECT o_orderkey, 1, 'Order ' || o_orderkey, '# Order ' || o_orderkey || chr(10) || rtrim({CODE}, chr(10)) FROM orders
    UNION ALL SELECT o_orderkey, 2, 'Order ' || o_orderkey || ' > Status', '## Status' || chr(10) || o_orderpriority FROM orders
    UNION ALL SELECT o_orderkey, 3, 'Last', '# Last' FROM orders WHERE o_orderkey % 2 = 0""")
def d01(spark, d):
    return D.chunk_markdown(orders(spark, d, MARKDOWN), 0)


@query("w09_header_paths", """WITH l AS (SELECT o_orderkey AS id, unnest(range(0, 9)) AS n, o_orderkey % 2 = 0 AS even FROM orders) SELECT id, n, CASE WHEN n = 0 THEN '' WHEN n = 8 THEN 'Last' WHEN n >= 6 THEN 'Order ' || id || ' > Status' ELSE 'Order ' || id END AS header_path,
    n BETWEEN 3 AND 5 AS fenced, CASE WHEN n = 0 THEN 0 WHEN n < 6 THEN 1 WHEN n < 8 THEN 2 ELSE 3 END AS section FROM l WHERE even OR n < 8""")
def w09(spark, d):
    return D.marked_lines(D.lines(orders(spark, d, MARKDOWN))).select("id", "n", "header_path", "fenced", "section")


@query("d02_chunk_rst", """SELECT o_orderkey AS id, 1 AS section, 'Order ' || o_orderkey AS title, 'Order ' || o_orderkey || chr(10) || '===============' || chr(10) || o_orderstatus || chr(10) AS text FROM orders
    UNION ALL SELECT o_orderkey, 2, 'Status', 'Status' || chr(10) || '------' || chr(10) || o_orderpriority FROM orders""")
def d02(spark, d):
    return D.chunk_rst(orders(spark, d, RST))


DIRECTIVES = "'.. note:: order ' || o_orderkey || chr(10) || '   :name: n' || o_custkey || chr(10) || '   body ' || o_orderstatus || chr(10) || '.. code-block::' || chr(10) || '   x'"


@query("d16_directives", """SELECT o_orderkey AS id, 'note' AS directive, 'order ' || o_orderkey AS argument, 'n' || o_custkey AS name, 'body ' || o_orderstatus AS body FROM orders UNION ALL SELECT o_orderkey, 'code-block', '', NULL, 'x' FROM orders""")
def d16(spark, d):
    return D.directives(orders(spark, d, DIRECTIVES)).select("id", "directive", "argument", F.col("attributes")["name"].alias("name"), "body")


@query("d17_code_blocks", """SELECT o_orderkey AS id, 0 AS n, 'sh' AS language, '# no heading' || chr(10) AS code FROM orders""")
def d17(spark, d):
    return D.code_blocks(orders(spark, d, MARKDOWN))


@query("d07_chunk_functions", """WITH t AS (SELECT 'p' || o_custkey AS path, 'f' || o_orderkey AS name, 10 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first FROM orders)
    SELECT left(sha256(path || ':' || name || ':' || first), 16) AS chunk_id, path, name, '# ' || path || ' ' || name || chr(10) || 'l' || first || chr(10) || 'l' || (first + 1) AS text FROM t""")
def d07(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "orders").withColumn("first", 10 * F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    x = x.select(F.concat(F.lit("p"), "o_custkey").alias("path"), F.concat(F.lit("f"), "o_orderkey").alias("name"), "first")
    lines = x.select("path", F.explode(F.sequence(F.col("first"), F.col("first") + 4)).alias("n")).withColumn("line", F.concat(F.lit("l"), "n"))
    return D.chunk_functions(lines, x.withColumn("last", F.col("first") + 1))


# -- scores of documents


@query("d11_quality_d", "SELECT doc_id, round(least(1.0, 0.6 + CASE WHEN contains(text, 'the ') THEN 0.1 ELSE 0 END + CASE WHEN contains(text, '|') THEN 0.1 ELSE 0 END + CASE WHEN contains(text, '- ') THEN 0.1 ELSE 0 END + CASE WHEN length(text) BETWEEN 200 AND 2000 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS v FROM documents")
def d11(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", D.quality_d(t.contains("the "), t.contains("|"), t.contains("- "), F.length(t)).alias("v"))


@query("d25_quality_e", """SELECT doc_id, round(least(1.0, CASE WHEN length(text) BETWEEN 200 AND 2000 THEN 0.3 WHEN length(text) > 50 THEN 0.15 ELSE 0 END + CASE WHEN contains(text, '|') THEN 0.2 ELSE 0 END + CASE WHEN contains(text, 'the ') THEN 0.1 ELSE 0 END
    + CASE WHEN n_chars % 4 <= 2 THEN 0.1 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.1 ELSE 0 END + 0.1 * (n_chars % 10) / 10 + 0.1 * (n_chars % 5) / 5)::DOUBLE, 6) AS v FROM documents""")
def d25(spark, d):
    t, n = F.col("text"), F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", D.quality_e(F.length(t), t.contains("|"), t.contains("the "), n % 4, F.coalesce(F.col("lang") == "en", F.lit(False)), (n % 10) / 10, (n % 5) / 5).alias("v"))


@query("d19_fingerprint_dedupe", """WITH x AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 0 ELSE 1 END + CASE WHEN source IS NULL THEN 0 ELSE 1 END AS fields, n_chars, lower(left(text, 200)) AS f FROM documents WHERE text IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY fields DESC, n_chars DESC, doc_id) AS k FROM x) SELECT doc_id, fields FROM r WHERE k = 1""")
def d19(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "documents").where("text is not null")
    fields = F.col("lang").isNotNull().cast("int") + F.col("source").isNotNull().cast("int")
    x = x.select("doc_id", fields.alias("fields"), "n_chars", F.xxhash64(F.lower(F.left("text", F.lit(200)))).alias("f"))
    best = x.groupBy("f").agg(F.max_by(F.struct("doc_id", "fields"), F.struct("fields", "n_chars", -F.col("doc_id"))).alias("b"))
    return best.select("b.doc_id", "b.fields")


@query("d22_provenance", "SELECT doc_id, 'crawl' AS prov_source, 'abc' AS prov_commit, true AS prov_dirty, 'small' AS prov_profile, 256 AS prov_dimension FROM documents")
def d22(spark, d):
    return D.with_provenance(table(spark, d, "documents").select("doc_id"), "crawl", "abc", True, "small", 256)


# -- aggregates and reports


@query("a09_primary_language", """WITH n AS (SELECT source AS repo, lang AS language, count(*) AS n, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, first) AS k FROM n) SELECT repo, language FROM r WHERE k = 1""")
def a09(spark, d):
    return A.primary_language(table(spark, d, "documents").select(F.col("source").alias("repo"), F.col("lang").alias("language"), F.col("doc_id").alias("seq")))


@query("a11_source_summary", """WITH s AS (SELECT lang AS source_type, source AS scope, 'c' || (doc_id % 3) AS collection_target, doc_id % 4 <> 0 AS enabled, n_chars AS doc_count FROM documents)
    SELECT source_type, scope, collection_target, count(*) AS sources, CAST(sum(CAST(enabled AS INT)) AS BIGINT) AS enabled, CAST(sum(doc_count) AS BIGINT) AS declared FROM s GROUP BY GROUPING SETS ((source_type), (scope), (collection_target))""")
def a11(spark, d):
    x = table(spark, d, "documents")
    return A.source_summary(x.select(F.col("lang").alias("source_type"), F.col("source").alias("scope"), F.concat(F.lit("c"), F.col("doc_id") % 3).alias("collection_target"), (F.col("doc_id") % 4 != 0).alias("enabled"), F.col("n_chars").alias("doc_count")))


@query("a12_scan_summary", """WITH v AS (SELECT event_type AS category, 'p' || (user_id % 50) AS path, 'm' || (event_id % 7) AS message FROM events)
    SELECT category, count(*) AS issues, array_to_string(list_sort(list(DISTINCT path))[1:20], ',') AS files, array_to_string(list_sort(list(DISTINCT message))[1:3], ',') AS examples FROM v GROUP BY 1""")
def a12(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("category"), F.concat(F.lit("p"), F.col("user_id") % 50).alias("path"), F.concat(F.lit("m"), F.col("event_id") % 7).alias("message"))
    return A.scan_summary(x).withColumns({"files": F.array_join("files", ","), "examples": F.array_join("examples", ",")})


@query("t05_by_priority", "SELECT url, CASE WHEN page_id % 4 <> 0 THEN (page_id % 10) / 10.0 END::DOUBLE AS priority FROM pages")
def t05(spark, d):
    x = table(spark, d, "pages")
    return W.by_priority(x.select("url", F.when(F.col("page_id") % 4 != 0, (F.col("page_id") % 10) / 10).alias("priority")))


@query("q06_range_drift", """WITH m AS (SELECT event_type || user_id AS metric, event_type, avg(value) AS value FROM events GROUP BY 1, 2) SELECT metric, round(value, 6) AS value, low, high FROM (SELECT metric, value, 40.0::DOUBLE AS low, 60.0::DOUBLE AS high FROM m) x WHERE value < low OR value > high""")
def q06(spark, d):
    m = table(spark, d, "events").groupBy(F.concat("event_type", "user_id").alias("metric")).agg(Q.steady_mean(F.col("value")).alias("value"))
    ranges = m.select("metric", F.lit(40.0).alias("low"), F.lit(60.0).alias("high"))
    return Q.range_drift(m, ranges).withColumn("value", F.round("value", 6))


@query("q07_health", "SELECT user_id, CASE WHEN count(DISTINCT event_type) >= 5 AND count_if(value > 90) > 0 THEN 'healthy' WHEN count(DISTINCT event_type) >= 5 OR count_if(value > 90) > 0 THEN 'degraded' ELSE 'unhealthy' END AS status FROM events GROUP BY 1")
def q07(spark, d):
    x = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("a"), F.count_if(F.col("value") > 90).alias("b"))
    return x.select("user_id", Q.health(F.col("a"), F.col("b")).alias("status"))


@query("q08_run_report", "SELECT event_type AS tenant, 'b' || (user_id % 3) AS branch, 'full' AS mode, count(DISTINCT user_id) AS files, count(*) FILTER (value <= 90 OR value IS NULL) AS facts, count(*) FILTER (value > 90) AS errors FROM events GROUP BY 1, 2")
def q08(spark, d):
    x = table(spark, d, "events")
    return Q.run_report(x.select(F.col("event_type").alias("tenant"), F.concat(F.lit("b"), F.col("user_id") % 3).alias("branch"), F.lit("full").alias("mode"), F.col("user_id").alias("path"), F.when(F.col("value") > 90, "high").alias("error")))


# -- evaluation


@query("e10_composite_score", "SELECT event_id, round(0.3 * coalesce(value, 0) / 100 + 0.3 * (user_id % 10) / 10 + 0.2 * (event_id % 4) / 4 + 0.1 * (event_id % 3) / 3 + 0.1, 6) AS v FROM events")
def e10(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(E.composite_score(F.coalesce("value", F.lit(0.0)) / 100, F.col("user_id") % 10 / 10, F.col("event_id") % 4 / 4, F.col("event_id") % 3 / 3, F.lit(1.0)), 6).alias("v"))


CHAINS = "SELECT o_orderkey AS chain_id, 'Cust' || o_custkey AS entity1, 'Order' || (o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1000000 END) AS entity2, CASE WHEN o_orderkey % 4 = 0 THEN 'CALLS' ELSE 'USES' END AS expected_relationship FROM orders"
NEAR = "SELECT 'Cust' || o_custkey AS anchor, 'order' || o_orderkey || '.' AS name, 'CALLS' AS rel, CAST(o_totalprice AS DOUBLE) AS score FROM orders"


@query("e11_chain_evaluation", f"""WITH c AS ({CHAINS}), n AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, name) AS rank FROM ({NEAR}) q), x AS (SELECT c.chain_id, CASE WHEN contains(lower(name), lower(entity2)) OR contains(lower(entity2), lower(name)) THEN rank END AS r, rel = expected_relationship AS m FROM c LEFT JOIN n ON entity1 = anchor)
    SELECT chain_id, min(r) IS NOT NULL AS hit, min(r) AS rank, coalesce(min_by(m, r) FILTER (r IS NOT NULL), false) AS rel_match FROM x GROUP BY 1""")
def e11(spark, d):
    o = table(spark, d, "orders")
    chains = o.select(F.col("o_orderkey").alias("chain_id"), F.concat(F.lit("Cust"), "o_custkey").alias("entity1"), F.concat(F.lit("Order"), F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(1000000)).alias("entity2"), F.when(F.col("o_orderkey") % 4 == 0, "CALLS").otherwise("USES").alias("expected_relationship"))
    near = o.select(F.concat(F.lit("Cust"), "o_custkey").alias("anchor"), F.concat(F.lit("order"), "o_orderkey", F.lit(".")).alias("name"), F.lit("CALLS").alias("rel"), F.col("o_totalprice").cast("double").alias("score"))
    return E.chain_evaluation(chains, near)


@query("e12_weight_search", """WITH edges AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, CASE o_orderkey % 3 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'USES' ELSE 'SETS' END AS rel FROM orders), w AS (SELECT * FROM (VALUES ('CALLS', 0.7::DOUBLE), ('USES', 0.65::DOUBLE)) v(rel, weight)),
    c AS (SELECT min(o_orderkey) AS chain_id, 'c' || o_custkey AS entity1, 'o' || min(o_orderkey) AS entity2 FROM orders GROUP BY o_custkey), t AS (SELECT rel AS trial_rel, d * 0.1::DOUBLE AS delta FROM w CROSS JOIN (VALUES (-2), (-1), (1), (2)) x(d)),
    s AS (SELECT trial_rel, delta, chain_id, entity2, dst, coalesce(weight, 0.3::DOUBLE) + CASE WHEN e.rel = trial_rel THEN delta ELSE 0 END AS score FROM c JOIN edges e ON entity1 = src LEFT JOIN w ON e.rel = w.rel CROSS JOIN t),
    r AS (SELECT *, row_number() OVER (PARTITION BY trial_rel, delta, chain_id ORDER BY score DESC, dst) AS rank FROM s) SELECT trial_rel, round(delta, 3) AS delta, round(avg(rank), 6) AS mean_rank, count(*) AS hits FROM r WHERE dst = entity2 GROUP BY 1, 2""")
def e12(spark, d):
    o = table(spark, d, "orders")
    rel = F.when(F.col("o_orderkey") % 3 == 0, "CALLS").when(F.col("o_orderkey") % 3 == 1, "USES").otherwise("SETS")
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), rel.alias("rel"))
    chains = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("chain_id")).select("chain_id", F.concat(F.lit("c"), "o_custkey").alias("entity1"), F.concat(F.lit("o"), "chain_id").alias("entity2"))
    weights = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("rel"), F.lit(v).alias("weight")) for k, v in (("CALLS", 0.7), ("USES", 0.65))))))
    return E.weight_search(edges, chains, weights).withColumn("delta", F.round("delta", 3))


@query("e14_agreement", "SELECT 'p' || doc_id AS path, 'lang' AS kind, 'en' AS name, CASE WHEN lang = 'en' THEN 'missing' ELSE 'spurious' END AS side FROM documents WHERE (lang = 'en') <> (n_chars % 2 = 0)")
def e14(spark, d):
    x = table(spark, d, "documents").select(F.concat(F.lit("p"), "doc_id").alias("path"), F.lit("lang").alias("kind"), F.lit("en").alias("name"), "lang", "n_chars")
    return E.agreement(x.where("lang is not null and n_chars % 2 = 0"), x.where("lang = 'en'"))


# -- traversal bundles

STAR = """e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'CALLS' AS rel FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'DEFINES' FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'IMPORTS' FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'EXECUTES' FROM supplier)"""


def star(spark, d):
    k = lambda p, c: F.concat(F.lit(p), c)
    t = lambda n: table(spark, d, n)
    x = t("orders").select(k("o", "o_orderkey"), k("c", "o_custkey"), F.lit("CALLS")).union(t("customer").select(k("c", "c_custkey"), k("n", "c_nationkey"), F.lit("DEFINES")))
    return x.union(t("nation").select(k("n", "n_nationkey"), k("r", "n_regionkey"), F.lit("IMPORTS"))).union(t("supplier").select(k("s", "s_suppkey"), k("n", "s_nationkey"), F.lit("EXECUTES"))).toDF("src", "dst", "rel")


@query("g08_cross_language_trace", f"""WITH {STAR}, p AS (SELECT src AS root, dst AS program FROM e WHERE rel = 'EXECUTES') SELECT root, program, dst AS routine, CASE WHEN dst IS NOT NULL THEN 1 END AS depth FROM p LEFT JOIN (SELECT * FROM e WHERE rel = 'IMPORTS') i ON program = src""")
def g08(spark, d):
    roots = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("root"))
    return G.cross_language_trace(star(spark, d), roots, "EXECUTES", "IMPORTS", 3).select("root", F.inline("trace"))


LABELS = "CASE p_partkey % 4 WHEN 0 THEN 'PythonFunction' WHEN 1 THEN 'FortranSubroutine' WHEN 2 THEN 'PythonClass' ELSE 'Shell' END"


@query("g15_file_symbols", "SELECT DISTINCT 's' || l_suppkey AS file, p_name || p_partkey AS symbol, CASE p_partkey % 4 WHEN 2 THEN 'CLASS' ELSE 'FUNCTION' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 4 <> 3")
def g15(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.array(F.expr(LABELS)).alias("labels"), F.concat("p_name", "p_partkey").alias("name"))
    li = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("DEFINES").alias("rel"))
    return G.file_symbols(li, p)


@query("g16_entity_type", "SELECT p_partkey AS node_id, CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'fortran' WHEN 2 THEN 'python' ELSE 'shell' END AS kind FROM part")
def g16(spark, d):
    return G.entity_type(table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.array(F.expr(LABELS)).alias("labels")))


@query("g19_code_with_dependencies", f"""WITH {STAR}, h AS (SELECT dst AS symbol, src AS file FROM e WHERE rel = 'DEFINES'), c AS (SELECT dst AS symbol, src FROM e WHERE rel = 'EXECUTES')
    SELECT h.symbol, h.file, CAST(NULL AS VARCHAR) AS imports, 'Part ' || h.symbol AS functions, CAST(NULL AS VARCHAR) AS callers FROM h""")
def g19(spark, d):
    e = star(spark, d)
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"))
    nodes = n.select("node_id", F.array(F.lit("Function")).alias("labels"), F.concat(F.lit("Part "), "node_id").alias("name"))
    out = G.code_with_dependencies(e, nodes, n.select(F.col("node_id").alias("symbol")))
    return out.select("symbol", "file", F.array_join("imports", ",").alias("imports"), F.array_join("functions", ",").alias("functions"), F.array_join("callers", ",").alias("callers"))


@query("g20_script_env", """SELECT 'V' || o_custkey % 50 AS variable, string_agg(DISTINCT 's' || o_orderkey, ',' ORDER BY 's' || o_orderkey) FILTER (o_orderkey % 3 = 0) AS dependents, string_agg(DISTINCT 's' || o_orderkey, ',' ORDER BY 's' || o_orderkey) FILTER (o_orderkey % 3 = 1) AS exporters,
    string_agg(DISTINCT 's' || o_orderkey, ',' ORDER BY 's' || o_orderkey) FILTER (o_orderkey % 3 = 2) AS setters FROM orders GROUP BY 1""")
def g20(spark, d):
    rel = F.when(F.col("o_orderkey") % 3 == 0, "DEPENDS_ON_ENV").when(F.col("o_orderkey") % 3 == 1, "EXPORTS").otherwise("SETS")
    e = table(spark, d, "orders").select(F.concat(F.lit("s"), "o_orderkey").alias("src"), F.concat(F.lit("V"), F.col("o_custkey") % 50).alias("dst"), rel.alias("rel"))
    return G.script_env(e).select("variable", *(F.expr(f"nullif(array_join({c}, ','), '')").alias(c) for c in ("dependents", "exporters", "setters")))


CHAIN = "k AS (SELECT 'p' || p_partkey AS src, 'p' || (p_partkey + 1) AS dst FROM part WHERE p_partkey % 7 <> 6 UNION ALL SELECT 'p' || p_partkey, 'p' || (p_partkey + 3) FROM part WHERE p_partkey % 7 < 3)"


def part_chain(spark, d):
    p = table(spark, d, "part")
    k = lambda n: F.concat(F.lit("p"), F.col("p_partkey") + n)
    return p.where("p_partkey % 7 <> 6").select(k(0), k(1), F.lit("CALLS")).union(p.where("p_partkey % 7 < 3").select(k(0), k(3), F.lit("CALLS"))).toDF("src", "dst", "rel")


@query("g04_call_chain_depth_four", f"""WITH RECURSIVE {CHAIN}, r AS (SELECT 'p' || p_partkey AS anchor, 'p' || p_partkey AS node, 0 AS depth, 'p' || p_partkey AS path FROM part WHERE p_partkey % 7 = 0
    UNION ALL SELECT anchor, dst, depth + 1, path || '>' || dst FROM r JOIN k ON node = src WHERE depth < 4) SELECT anchor, node, depth, path FROM r WHERE depth > 0""")
def g04b(spark, d):
    a = table(spark, d, "part").where("p_partkey % 7 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("anchor"))
    return G.call_chain(part_chain(spark, d), a, 4).withColumn("path", F.array_join("path", ">"))


@query("g10_shortest_paths_depth_five", f"""WITH RECURSIVE {CHAIN}, r AS (SELECT 'p' || p_partkey AS src, 'p' || (p_partkey + 5) AS dst, 'p' || p_partkey AS node, 0 AS length, 'p' || p_partkey AS path FROM part WHERE p_partkey % 7 = 0
    UNION ALL SELECT r.src, r.dst, k.dst, length + 1, path || '>' || k.dst FROM r JOIN k ON node = k.src WHERE length < 5), h AS (SELECT *, min(length) OVER (PARTITION BY src, dst) AS m FROM r WHERE node = dst),
    o AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY path) AS n FROM h WHERE length = m) SELECT src, dst, length, path, rtrim(repeat('CALLS>', length), '>') AS rels FROM o WHERE n <= 3""")
def g10b(spark, d):
    p = table(spark, d, "part").where("p_partkey % 7 = 0")
    pairs = p.select(F.concat(F.lit("p"), "p_partkey").alias("src"), F.concat(F.lit("p"), F.col("p_partkey") + 5).alias("dst"))
    return G.shortest_paths(part_chain(spark, d), pairs, 5).withColumns({c: F.array_join(c, ">") for c in ("path", "rels")})


# -- retrieval


@query("r16_search_source", """WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '')) AS q FROM benchmark), c AS (SELECT conv_id * 1000 + turn AS id, list_distinct(list_filter(string_split_regex(lower(text), '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '')) AS t FROM conversations WHERE role = 'user' AND (turn % 5) / 4.0 >= 0.5),
    s AS (SELECT query_id, id, round(0.6 * len(list_intersect(q, t)) / greatest(len(list_distinct(list_concat(q, t))), 1) + 0.1 * len(list_intersect(q, t)) / len(q), 6) AS score FROM q CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0.1) SELECT query_id, id, score, rank FROM r WHERE rank <= 5""")
def r16(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.lit(None).cast("string").alias("title"), F.col("role").alias("source"), (F.col("turn") % 5 / 4).alias("quality"))
    return R.search_source(q, c, "user", 5)


@query("r17_attribution", "SELECT page_id, coalesce(CASE WHEN page_id % 3 <> 0 THEN 'site' END, 'unknown') AS source, url FROM pages")
def r17(spark, d):
    x = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 != 0, "site").alias("source"), "url")
    return R.attribute(x).select("page_id", "attribution.source", "attribution.url")


@query("j12_hybrid_query", f"""WITH e AS (SELECT 's' || l_suppkey AS file, 'p' || l_partkey AS d, l_linenumber % 2 AS k FROM lineitem), i AS (SELECT file, list_sort(list(DISTINCT d)) AS imports FROM e WHERE k = 0 GROUP BY 1), f AS (SELECT file, list_sort(list(DISTINCT d)) AS functions FROM e WHERE k = 1 GROUP BY 1),
    c AS (SELECT 'p' || p_partkey AS d, 'b' || p_size AS src FROM part), x AS (SELECT file, unnest(functions[1:3]) AS d FROM f), y AS (SELECT file, list_sort(list(DISTINCT src)) AS callers FROM x JOIN c USING (d) GROUP BY 1)
    SELECT 's' || s_suppkey AS file, array_to_string(imports, ',') AS imports, array_to_string(functions, ',') AS functions, array_to_string(callers, ',') AS callers FROM supplier LEFT JOIN i ON i.file = 's' || s_suppkey LEFT JOIN f ON f.file = 's' || s_suppkey LEFT JOIN y ON y.file = 's' || s_suppkey""")
def j12(spark, d):
    li = table(spark, d, "lineitem")
    e = li.select(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"), F.when(F.col("l_linenumber") % 2 == 0, "IMPORTS").otherwise("DEFINES"))
    e = e.union(table(spark, d, "part").select(F.concat(F.lit("b"), "p_size"), F.concat(F.lit("p"), "p_partkey"), F.lit("CALLS"))).toDF("src", "dst", "rel")
    out = J.hybrid_query(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file")), e)
    return out.select("file", *(F.array_join(c, ",").alias(c) for c in ("imports", "functions", "callers")))


@query("c10_infer_purpose", """WITH x AS (SELECT doc_id AS community, lower(text) AS t FROM documents), n AS (SELECT community, CAST(contains(t, 'the ') AS INT) + CAST(contains(t, 'and ') AS INT) AS a, CAST(contains(t, 'der ') AS INT) + CAST(contains(t, 'und ') AS INT) + CAST(contains(t, 'die ') AS INT) AS b FROM x)
    SELECT community, CASE WHEN greatest(a, b) < 2 OR a IS NULL THEN 'general' WHEN a >= b THEN 'english' ELSE 'german' END AS purpose FROM n""")
def c10(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("community"), "text")
    return C.infer_purpose(x, {"english": ["the ", "and "], "german": ["der ", "und ", "die "]})


MEMBER = "m AS (SELECT 'c' || c_custkey AS node, c_nationkey AS community, c_mktsegment AS label, c_name AS name FROM customer)"


@query("c08_summarize_leaf", f"""WITH {MEMBER}, b AS (SELECT community, label, count(*) AS n, list_sort(list(DISTINCT name))[1:10] AS names FROM m GROUP BY 1, 2), t AS (SELECT community, sum(n) AS size, string_agg(label || ' (' || n || '): ' || array_to_string(names, ', '), '; ' ORDER BY n DESC, label) AS body FROM b GROUP BY 1)
    SELECT community, 'Community of ' || size || ' members. ' || body AS summary FROM t""")
def c08(spark, d):
    m = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("community"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("name"))
    return C.summarize_leaf(m, star(spark, d).where("rel = 'CALLS'"))


@query("c09_summarize_parent", """SELECT n_regionkey AS community, count(*) || ' parts. ' || string_agg('Nation ' || n_name, ' ' ORDER BY 'Nation ' || n_name) AS summary FROM nation GROUP BY 1""")
def c09(spark, d):
    n = table(spark, d, "nation")
    children = n.select(F.col("n_regionkey").alias("community"), F.col("n_nationkey").alias("child"))
    summaries = n.select(F.col("n_nationkey").alias("community"), F.concat(F.lit("Nation "), "n_name").alias("summary"))
    none = n.select((F.col("n_nationkey") + 100).alias("a"), (F.col("n_nationkey") + 200).alias("b"), F.lit(1).alias("strength"))
    return C.summarize_parent(children, summaries, none)


@query("j18_resolve_sources", """WITH n AS (SELECT source, count(*) AS files FROM documents GROUP BY 1) SELECT source AS name, files, CASE WHEN files < 250 THEN 'below_minimum' WHEN source = 'src1' THEN 'off_pin' ELSE NULL END AS reason FROM n WHERE source IS NOT NULL""")
def j18(spark, d):
    x = table(spark, d, "documents").where("source is not null")
    s = x.select("source").distinct().select(F.col("source").alias("name"), F.concat(F.lit("root/"), "source").alias("root"), F.lit(250).alias("least"), F.lit("a").alias("pin"), F.when(F.col("source") == "src1", "b").otherwise("a").alias("commit"), F.lit(False).alias("dirty"))
    out = J.resolve_sources(s, x.select(F.concat(F.lit("root/"), "source", F.lit("/"), "doc_id").alias("path")))
    return out.select("name", "files", "reason")


@query("j04_lift_edges", "SELECT 't' || o_orderkey AS src, 'x' || o_custkey AS dst, 'USES' AS rel FROM orders WHERE o_orderkey % 2 = 0")
def j04(spark, d):
    o = table(spark, d, "orders")
    k = lambda p: F.concat(F.lit(p), "o_orderkey")
    e = o.select(k("f").alias("src"), F.concat(F.lit("x"), "o_custkey").alias("dst"), F.lit("USES").alias("rel"))
    a = o.select(k("f").alias("node_id"), F.concat(F.lit("repo/ush/s"), "o_orderkey", F.lit(".sh")).alias("path"))
    b = o.select(k("t").alias("node_id"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "ush/s").otherwise("other/s"), "o_orderkey", F.lit(".sh")).alias("path"))
    return J.lift_edges(e, a, b)
