"""Graph operators over the property graph of the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import community as C
from lodestone.operators import joins as J
from lodestone.operators import sets as U
from lodestone.operators import traversal as G
from lodestone.operators import writes as S
from lodestone.plans.stages import table
from lodestone.sources.star_graph import EDGES_SQL, NODES_SQL, WEIGHTS_SQL, edges, nodes

GRAPH = f"WITH {EDGES_SQL}, {NODES_SQL}, {WEIGHTS_SQL}, both_ways AS (SELECT src, dst, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges)"
WEIGHTED = GRAPH + ", e AS (SELECT b.src, b.dst, b.rel, coalesce(w.weight, CAST(0.3 AS DOUBLE)) AS weight FROM both_ways b LEFT JOIN weights w ON b.rel = w.rel)"
QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def customers(spark, d):
    return table(spark, d, "customer").where("c_nationkey = 7").select(F.concat(F.lit("c"), "c_custkey").alias("anchor"))


ANCHORS = "anchors AS (SELECT 'c' || c_custkey AS anchor FROM customer WHERE c_nationkey = 7)"
TRIM = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, name, rel) AS n FROM scored WHERE score >= {least}),
    used AS (SELECT anchor, name, rel, hop, score, CAST({header} + sum(15 + CAST(ceil(length(name) / 4.0) AS INT)) OVER (PARTITION BY anchor ORDER BY score DESC, name, rel ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM ranked WHERE n <= {most})
    SELECT * FROM used WHERE used <= {budget}"""


@query("g01_neighborhood", f"{WEIGHTED}, {ANCHORS}, scored AS (SELECT a.anchor, e.dst AS name, e.rel, 1 AS hop, e.weight * 0.5 AS score FROM anchors a JOIN e ON a.anchor = e.src)" + TRIM.format(least=0.1, most=50, header=0, budget=200))
def g01(spark, d):
    return G.neighborhood(edges(spark, d), customers(spark, d), 1, budget=200, min_weight=0.1)


TWO = """, hops AS (SELECT a.anchor, e.dst AS name, e.rel, 1 AS hop, e.weight AS w1, {one} AS score FROM anchors a JOIN e ON a.anchor = e.src),
    allhops AS (SELECT anchor, name, rel, hop, score FROM hops UNION ALL SELECT h.anchor, e.dst, e.rel, 2, {two} FROM hops h JOIN e ON h.name = e.src WHERE e.dst <> h.anchor),
    scored AS (SELECT anchor, name, rel, hop, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor, name ORDER BY {first}score DESC, rel) AS k FROM allhops) q WHERE k = 1)"""


@query("g01_neighborhood_two_hops", f"{WEIGHTED}, {ANCHORS}" + TWO.format(one="e.weight * 0.5", two="e.weight * 0.25", first="hop, ") + TRIM.format(least=0.0, most=50, header=0, budget=400))
def g01b(spark, d):
    return G.neighborhood(edges(spark, d), customers(spark, d), 2, budget=400)


@query("g02_product_scores", f"{WEIGHTED}, {ANCHORS}" + TWO.format(one="e.weight", two="h.w1 * e.weight * 0.5", first="") + TRIM.format(least=0.0, most=50, header=0, budget=400))
def g02(spark, d):
    return G.neighborhood(edges(spark, d), customers(spark, d), 2, budget=400, mode="product")


@query("g03_bridge_scores", f"""{WEIGHTED}, rows AS (SELECT e.src, e.dst, e.rel, e.weight, 2 AS hop, substr(e.dst, 1, 1) AS lang, substr(e.src, 1, 1) AS prev_lang FROM e WHERE e.rel = 'USES')
    SELECT src, dst, weight * pow(CASE WHEN lang <> prev_lang THEN 0.8 ELSE 0.5 END, hop - 1) AS score FROM rows""")
def g03(spark, d):
    e = G._weighted(edges(spark, d)).where("rel = 'USES'")
    rows = e.select("src", "dst", "weight", F.lit(2).alias("hop"), F.substring("dst", 1, 1).alias("lang"), F.substring("src", 1, 1).alias("prev_lang"))
    return G.bridge_scores(rows).select("src", "dst", "score")


@query("g04_call_chain", f"""{GRAPH}, a AS (SELECT 's' || s_suppkey AS anchor FROM supplier),
    one AS (SELECT anchor, dst AS node, 1 AS depth, anchor || '>' || dst AS path FROM a JOIN edges ON anchor = src),
    two AS (SELECT anchor, dst AS node, 2 AS depth, path || '>' || dst AS path FROM one JOIN edges ON node = src)
    SELECT * FROM one UNION ALL SELECT * FROM two""")
def g04(spark, d):
    anchors = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("anchor"))
    return G.call_chain(edges(spark, d), anchors, 3).withColumn("path", F.array_join("path", ">"))


@query("g05_typed_chain", f"""{GRAPH}, {ANCHORS}, one AS (SELECT anchor, dst AS node, 1 AS depth FROM anchors JOIN edges ON anchor = src AND rel = 'CALLS'),
    two AS (SELECT anchor, dst, 2 FROM one JOIN edges ON node = src AND rel IN ('CALLS', 'PROVIDED_BY')) SELECT * FROM one UNION ALL SELECT * FROM two""")
def g05(spark, d):
    e = edges(spark, d).where("rel in ('CALLS', 'PROVIDED_BY')")
    return G.call_chain(e, customers(spark, d), 2).select("anchor", "node", "depth")


@query("g06_one_hop", f"{GRAPH}, {ANCHORS} SELECT DISTINCT anchor, src AS node, rel FROM anchors JOIN edges ON anchor = dst WHERE rel IN ('DEPENDS_ON')")
def g06(spark, d):
    return G.one_hop(edges(spark, d), customers(spark, d), ["DEPENDS_ON"], "in")


REACH = f"""{GRAPH}, {ANCHORS}, h0 AS (SELECT anchor, anchor AS node, 0 AS hop, CAST(NULL AS VARCHAR) AS rel FROM anchors),
    h1 AS (SELECT DISTINCT h.anchor, e.dst AS node, 1 AS hop, e.rel FROM h0 h JOIN edges e ON h.node = e.src),
    h2 AS (SELECT DISTINCT h.anchor, e.dst AS node, 2 AS hop, e.rel FROM h1 h JOIN edges e ON h.node = e.src),
    h3 AS (SELECT DISTINCT h.anchor, e.dst AS node, 3 AS hop, e.rel FROM h2 h JOIN edges e ON h.node = e.src),
    r AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)"""


@query("g07_reach", REACH + " SELECT * FROM r")
def g07(spark, d):
    return G.reach(edges(spark, d), customers(spark, d), "out", 3)


@query("g07_bridge_crossings", REACH + " SELECT anchor, CAST(sum(CASE WHEN hop > 0 AND rel IN ('USES', 'PROVIDED_BY') THEN 1 ELSE 0 END) AS BIGINT) AS crossings FROM r GROUP BY anchor")
def g07b(spark, d):
    return G.bridge_crossings(G.reach(edges(spark, d), customers(spark, d), "out", 3), ["USES", "PROVIDED_BY"])


@query("g09_change_impact", f"""{GRAPH}, a AS (SELECT 's' || s_suppkey AS anchor FROM supplier UNION ALL SELECT 'n' || n_nationkey FROM nation),
    d AS (SELECT DISTINCT anchor, src AS node FROM a JOIN edges ON anchor = dst WHERE rel IN ('USES', 'PROVIDED_BY', 'CALLS', 'DEPENDS_ON')),
    n AS (SELECT anchor, count(*) AS direct FROM d GROUP BY anchor),
    s AS (SELECT DISTINCT d.anchor, e.src AS node FROM d JOIN n ON d.anchor = n.anchor AND n.direct < 600 JOIN edges e ON d.node = e.dst WHERE e.rel IN ('CALLS', 'USES') AND e.src <> d.anchor),
    m AS (SELECT s.anchor, count(*) AS indirect FROM s LEFT JOIN d ON s.anchor = d.anchor AND s.node = d.node WHERE d.node IS NULL GROUP BY s.anchor),
    x AS (SELECT a.anchor, coalesce(direct, 0) AS direct, coalesce(indirect, 0) AS indirect FROM a LEFT JOIN n ON a.anchor = n.anchor LEFT JOIN m ON a.anchor = m.anchor),
    y AS (SELECT *, round(least(direct / 20, 0.4) + least(indirect / 50, 0.2) + 0.15, 6) AS risk FROM x)
    SELECT *, CASE WHEN risk > 0.7 THEN 'HIGH' WHEN risk > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM y""")
def g09(spark, d):
    a = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("anchor"))
    a = a.union(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey")))
    return G.change_impact(edges(spark, d), a, ["USES", "PROVIDED_BY", "CALLS", "DEPENDS_ON"], ["CALLS", "USES"], 0.15, 600)


@query("g10_shortest_paths", f"""{GRAPH}, pairs AS (SELECT 'o' || o_orderkey AS a, 'n' || c_nationkey AS z FROM orders JOIN customer ON o_custkey = c_custkey),
    e AS (SELECT DISTINCT src, dst FROM edges), one AS (SELECT a, z, dst, a || '>' || dst AS path FROM pairs JOIN e ON a = src),
    two AS (SELECT a, z, e.dst, path || '>' || e.dst AS path FROM one JOIN e ON one.dst = e.src WHERE one.dst <> z),
    found AS (SELECT a, z, 1 AS length, path FROM one WHERE dst = z UNION ALL SELECT a, z, 2, path FROM two WHERE dst = z),
    best AS (SELECT *, min(length) OVER (PARTITION BY a, z) AS shortest, row_number() OVER (PARTITION BY a, z ORDER BY length, path) AS n FROM found)
    SELECT a AS src, z AS dst, length, path FROM best WHERE length = shortest AND n <= 3""")
def g10(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    pairs = o.join(c, F.expr("o_custkey = c_custkey")).select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return G.shortest_paths(edges(spark, d), pairs, 2).drop("rels").withColumn("path", F.array_join("path", ">"))


@query("g10_shortest_paths_all", ORACLE_SQL["g10_shortest_paths"])
def g10_all(spark, d):
    pairs = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return G.shortest_paths(edges(spark, d), pairs, 2).drop("rels").withColumn("path", F.array_join("path", ">"))


@query("g11_outgoing", f"{GRAPH}, {ANCHORS} SELECT anchor, rel, node FROM (SELECT anchor, rel, dst AS node, row_number() OVER (PARTITION BY anchor ORDER BY rel, dst) AS n FROM anchors JOIN edges ON anchor = src) q WHERE n <= 3")
def g11(spark, d):
    return G.outgoing(edges(spark, d), customers(spark, d), 3)


@query("g12_cycles", f"""{GRAPH}, e AS (SELECT DISTINCT src, dst FROM both_ways WHERE rel IN ('SAME_DIRECTORY', 'CALLS')),
    two AS (SELECT 2 AS length, a.src || '>' || a.dst AS path FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst),
    three AS (SELECT 3, a.src || '>' || a.dst || '>' || b.dst FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst)
    SELECT * FROM two UNION ALL SELECT * FROM three""")
def g12(spark, d):
    e = G.undirected(edges(spark, d).where("rel in ('SAME_DIRECTORY', 'CALLS')"))
    return G.cycles(e, 3).withColumn("path", F.array_join("path", ">"))


@query("g14_importers", f"{GRAPH} SELECT DISTINCT 'r' || r_regionkey AS anchor, src AS node, rel FROM region JOIN edges ON dst = 'r' || r_regionkey")
def g14(spark, d):
    return G.one_hop(edges(spark, d), table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("anchor")), None, "in")


@query("g17_guarded", f"""{GRAPH}, {ANCHORS}, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) q GROUP BY node),
    m AS (SELECT anchor, coalesce(degree > 12, true) AS hub FROM anchors LEFT JOIN deg ON anchor = node),
    h1 AS (SELECT DISTINCT anchor, dst AS node, 1 AS hop, hub FROM m JOIN edges ON anchor = src),
    h2 AS (SELECT DISTINCT anchor, dst AS node, 2 AS hop, hub FROM h1 JOIN edges ON node = src WHERE NOT hub)
    SELECT anchor, node, hop, hub AS degraded FROM h1 UNION ALL SELECT * FROM h2""")
def g17(spark, d):
    return G.guarded(edges(spark, d), customers(spark, d), 2, 12)


@query("g21_hard_negatives", f"""{GRAPH}, m AS (SELECT 'c' || c_custkey AS node, c_nationkey AS community FROM customer UNION ALL SELECT 'p' || p_partkey, p_size % 5 FROM part UNION ALL SELECT 's' || s_suppkey, s_nationkey % 5 FROM supplier),
    near AS (SELECT DISTINCT b.src AS anchor, b.dst AS node, x.community = y.community AS same FROM both_ways b JOIN m x ON b.src = x.node JOIN m y ON b.dst = y.node),
    k AS (SELECT *, row_number() OVER (PARTITION BY anchor, same ORDER BY node) AS n FROM near)
    SELECT a.anchor, a.node AS positive, b.node AS negative FROM k a JOIN k b ON a.anchor = b.anchor AND a.n = b.n AND a.same AND NOT b.same WHERE a.n <= 2""")
def g21(spark, d):
    t = lambda n: table(spark, d, n)
    m = t("customer").select(F.concat(F.lit("c"), "c_custkey"), F.col("c_nationkey")).union(t("part").select(F.concat(F.lit("p"), "p_partkey"), F.col("p_size") % 5))
    m = m.union(t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.col("s_nationkey") % 5)).toDF("node", "community")
    return G.hard_negatives(edges(spark, d), m, 2)


@query("a01_label_counts", f"{GRAPH} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def a01(spark, d):
    return A.label_counts(nodes(spark, d))


@query("a02_relationship_counts", f"{GRAPH} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def a02(spark, d):
    return A.relationship_counts(edges(spark, d))


@query("a03_graph_statistics", f"{GRAPH} SELECT (SELECT count(DISTINCT node_id) FROM nodes) AS nodes, (SELECT count(DISTINCT label) FROM nodes) AS labels, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT rel) FROM edges) AS rels")
def a03(spark, d):
    return A.graph_statistics(nodes(spark, d), edges(spark, d))


@query("a04_module_usage", f"{GRAPH} SELECT dst, count(DISTINCT src) AS importers, string_agg(DISTINCT src, ',' ORDER BY src) AS names FROM edges WHERE rel = 'PROVIDED_BY' GROUP BY dst")
def a04(spark, d):
    return A.module_usage(edges(spark, d), "PROVIDED_BY")


@query("a05_complexity", f"""{GRAPH}, x AS (SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) q GROUP BY node)
    SELECT *, fan_in * fan_out AS complexity, CASE WHEN fan_in * fan_out > 50 THEN 'high' WHEN fan_in * fan_out > 20 THEN 'moderate' ELSE 'low' END AS band FROM x""")
def a05(spark, d):
    return A.complexity(edges(spark, d))


@query("a06_degrees", f"{GRAPH} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) q GROUP BY node")
def a06(spark, d):
    return G.degrees(edges(spark, d))


@query("a07_impact_bands", f"{GRAPH}, x AS (SELECT dst, count(DISTINCT src) AS dependents FROM edges WHERE rel = 'CONTAINS' GROUP BY dst) SELECT *, CASE WHEN dependents > 50 THEN 'HIGH' WHEN dependents > 20 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM x")
def a07(spark, d):
    return A.impact_bands(edges(spark, d), "CONTAINS")


@query("a08_contributions", "SELECT o_custkey AS author, o_orderpriority AS component, count(*) AS n FROM orders GROUP BY 1, 2")
def a08(spark, d):
    return A.contributions(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("a20_language_stats", f"{GRAPH} SELECT a.label AS src_label, e.rel, b.label AS dst_label, count(*) AS n FROM edges e JOIN nodes a ON e.src = a.node_id JOIN nodes b ON e.dst = b.node_id GROUP BY 1, 2, 3")
def a20(spark, d):
    return A.language_stats(nodes(spark, d), edges(spark, d))


MEMBER = "member AS (SELECT 'c' || c_custkey AS node, c_nationkey AS community FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier)"


def member(spark, d):
    a = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), "c_nationkey")
    return a.union(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_nationkey")).toDF("node", "community")


@query("a13_community_stats", f"WITH {MEMBER}, n AS (SELECT community, count(*) AS n FROM member GROUP BY 1) SELECT count(*) AS communities, min(n) AS smallest, max(n) AS largest, round(avg(n), 1) AS mean FROM n")
def a13(spark, d):
    return A.community_stats(member(spark, d))


BUCKET = "CASE WHEN n <= 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' WHEN n <= 50 THEN '11-50' WHEN n <= 200 THEN '51-200' ELSE '200+' END"


@query("a13_size_buckets", f"WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT {BUCKET} AS bucket, count(*) AS communities FROM n GROUP BY 1")
def a13b(spark, d):
    return A.size_buckets(table(spark, d, "orders").select(F.col("o_custkey").alias("community")))


@query("t04_largest_communities", f"WITH {MEMBER} SELECT community, count(*) AS n FROM member GROUP BY 1 HAVING count(*) >= 60 ORDER BY n DESC, community LIMIT 10")
def t04(spark, d):
    return A.largest_communities(member(spark, d), 60, 10)


@query("a14_type_breakdown", "SELECT conv_id AS grp, role AS kind, count(*) AS n FROM conversations GROUP BY 1, 2")
def a14(spark, d):
    return A.type_breakdown(table(spark, d, "conversations"), "conv_id", "role")


@query("c01_project", f"""{GRAPH} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM edges WHERE rel IN ('USES', 'SAME_DIRECTORY', 'CALLS') AND src <> dst GROUP BY 1, 2""")
def c01(spark, d):
    return C.project(edges(spark, d), ["USES", "SAME_DIRECTORY", "CALLS"])


COMMUNITIES = """cm AS (SELECT 'c' || c_custkey AS node, c_nationkey AS community FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_nationkey FROM nation
    UNION ALL SELECT 'r' || r_regionkey, 100 + r_regionkey FROM region)"""
PROJECTED = "pe AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM edges WHERE rel IN ('USES', 'SAME_DIRECTORY') GROUP BY 1, 2)"


def communities(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), "n_nationkey")
    return member(spark, d).union(n).union(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.col("r_regionkey") + 100))


@query("c03_modularity", f"""{GRAPH}, {COMMUNITIES}, {PROJECTED}, m AS (SELECT sum(weight) AS total FROM pe),
    inside AS (SELECT x.community, sum(weight) AS w FROM pe JOIN cm x ON a = x.node JOIN cm y ON b = y.node WHERE x.community = y.community GROUP BY 1),
    deg AS (SELECT community, sum(weight) AS k FROM (SELECT a AS node, weight FROM pe UNION ALL SELECT b, weight FROM pe) q JOIN cm ON q.node = cm.node GROUP BY 1)
    SELECT round(sum(coalesce(w, 0) / total - (k / (2.0 * total)) * (k / (2.0 * total))), 6) AS modularity FROM deg LEFT JOIN inside ON deg.community = inside.community CROSS JOIN m""")
def c03(spark, d):
    return C.modularity(C.project(edges(spark, d), ["USES", "SAME_DIRECTORY"]), communities(spark, d))


LEVELS = """lv AS (SELECT 'c' || c_custkey AS node, 0 AS level, c_nationkey AS community FROM customer UNION ALL SELECT 'c' || c_custkey, 1, 100 + n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def levels(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    name = F.concat(F.lit("c"), "c_custkey")
    return c.select(name, F.lit(0), "c_nationkey").union(c.select(name, F.lit(1), F.col("n_regionkey") + 100)).toDF("node", "level", "community")


@query("c04_levels", f"WITH {LEVELS} SELECT level, community, count(*) AS members FROM lv GROUP BY 1, 2 HAVING count(*) >= 2")
def c04(spark, d):
    return C.materialize_levels(levels(spark, d))


@query("c05_hierarchy_edges", f"""WITH {LEVELS} SELECT node AS child, community AS parent, 'MEMBER_OF' AS rel FROM lv WHERE level = 0
    UNION ALL SELECT DISTINCT CAST(a.community AS VARCHAR), b.community, 'PARENT_OF' FROM lv a JOIN lv b ON a.node = b.node AND b.level = a.level + 1""")
def c05(spark, d):
    return C.hierarchy_edges(levels(spark, d))


@query("c06_interactions", f"""{GRAPH}, {COMMUNITIES} SELECT x.community AS a, y.community AS b, rel, count(*) AS strength FROM edges JOIN cm x ON src = x.node JOIN cm y ON dst = y.node WHERE x.community <> y.community GROUP BY 1, 2, 3 HAVING count(*) >= 1""")
def c06(spark, d):
    return C.interactions(edges(spark, d), communities(spark, d), 1)


@query("c07_enrich", f"""WITH {MEMBER}, k AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY node) AS n FROM member)
    SELECT community, count(*) AS member_count, string_agg(CASE WHEN n <= 10 THEN node END, ',' ORDER BY node) AS key_members, string_agg(DISTINCT substr(node, 1, 1), ',' ORDER BY substr(node, 1, 1)) AS languages FROM k GROUP BY 1""")
def c07(spark, d):
    return C.enrich(member(spark, d).withColumn("language", F.substring("node", 1, 1)))


@query("c11_internal_edges", f"{GRAPH}, {COMMUNITIES} SELECT x.community, src, dst, rel FROM edges JOIN cm x ON src = x.node JOIN cm y ON dst = y.node WHERE x.community = y.community")
def c11(spark, d):
    return C.internal_edges(edges(spark, d), communities(spark, d))


@query("c02_communities")
def c02(spark, d):
    e = C.project(edges(spark, d), ["USES", "SAME_DIRECTORY"])
    return C.communities(e)


@query("components_of_graph")
def components(spark, d):
    from lodestone.operators.components import contracted_components

    return contracted_components(edges(spark, d))


@query("j01_callers", f"{GRAPH} SELECT DISTINCT e.dst AS target, e.src AS caller, n.name AS caller_name FROM edges e LEFT JOIN nodes n ON e.src = n.node_id WHERE e.rel = 'CALLS'")
def j01(spark, d):
    return J.callers(edges(spark, d), nodes(spark, d), "CALLS")


@query("j02_related", f"""{GRAPH}, u AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'CALLS'),
    x AS (SELECT a.src AS file, b.src AS other, count(*) AS shared FROM u a JOIN u b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2)
    SELECT file, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY shared DESC, other) AS n FROM x) q WHERE n <= 3""")
def j02(spark, d):
    return J.related_files(edges(spark, d).where("rel = 'CALLS'"), 3)


@query("j10_degree_enrichment", f"""{GRAPH}, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) q GROUP BY node)
    SELECT s.s_name AS source, CAST(sum(degree) AS BIGINT) AS degree FROM supplier s JOIN nodes n ON n.name = s.s_name OR n.node_id = s.s_name JOIN deg ON deg.node = n.node_id GROUP BY 1""")
def j10(spark, d):
    hits = table(spark, d, "supplier").select(F.col("s_name").alias("source"))
    return J.enrich_with_degree(hits, nodes(spark, d), G.degrees(edges(spark, d)))


@query("j11_augment_hits", f"""{GRAPH}, {ANCHORS}, x AS (SELECT anchor, dst AS node, rel, row_number() OVER (PARTITION BY anchor ORDER BY rel, dst) AS n FROM anchors JOIN edges ON anchor = src)
    SELECT anchor, string_agg(rel || ':' || node, ',' ORDER BY rel || ':' || node) AS neighbours FROM x WHERE n <= 20 GROUP BY 1""")
def j11(spark, d):
    return J.augment_hits(customers(spark, d), edges(spark, d), 20)


@query("u04_orphans", f"{GRAPH} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM edges WHERE rel = 'CALLS') AND node_id NOT IN (SELECT dst FROM edges WHERE rel = 'CALLS')")
def u04(spark, d):
    return U.orphans(nodes(spark, d), edges(spark, d).where("rel = 'CALLS'"))


@query("s10_merge_edges", f"""{GRAPH} SELECT src, dst, rel, count(*) AS n FROM edges WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes WHERE label <> 'Region') GROUP BY 1, 2, 3""")
def s10(spark, d):
    return S.merge_edges(edges(spark, d), nodes(spark, d).where("label <> 'Region'").union(nodes(spark, d).where("1 = 0")), nodes(spark, d))


@query("s13_complete_nodes", f"""{GRAPH}, have AS (SELECT node_id FROM nodes WHERE label <> 'Nation') SELECT node_id, false AS is_placeholder FROM have
    UNION ALL SELECT DISTINCT node, true FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) q WHERE node NOT IN (SELECT node_id FROM have)""")
def s13(spark, d):
    return S.complete_nodes(nodes(spark, d).where("label <> 'Nation'"), edges(spark, d))


@query("s14_purge_edges", f"{GRAPH}, gone AS (SELECT node_id FROM nodes WHERE label = 'Supplier') SELECT src, dst, rel FROM edges WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone)")
def s14(spark, d):
    return S.purge(nodes(spark, d), edges(spark, d), F.col("label") == "Supplier")[1]


@query("x18_merge_duplicate_nodes", f"""{GRAPH}, deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) q GROUP BY node),
    k AS (SELECT node_id, first_value(node_id) OVER (PARTITION BY label, name ORDER BY coalesce(degree, 0) DESC, node_id) AS keeper FROM nodes LEFT JOIN deg ON node_id = node WHERE label = 'Part')
    SELECT DISTINCT coalesce(a.keeper, e.src) AS src, coalesce(b.keeper, e.dst) AS dst, e.rel FROM edges e LEFT JOIN k a ON e.src = a.node_id LEFT JOIN k b ON e.dst = b.node_id WHERE e.rel = 'PROVIDED_BY'""")
def x18(spark, d):
    return S.merge_duplicate_nodes(nodes(spark, d).where("label = 'Part'"), edges(spark, d))[1].where("rel = 'PROVIDED_BY'")


@query("g13_dependency_paths", f"{GRAPH}, {ANCHORS}, one AS (SELECT anchor, 1 AS depth, anchor || '>' || dst AS path, dst AS node FROM anchors JOIN edges ON anchor = src), two AS (SELECT anchor, 2, path || '>' || dst, dst FROM one JOIN edges ON node = src) SELECT anchor, depth, path FROM one UNION ALL SELECT anchor, 2, path FROM (SELECT anchor, path || '>' || dst AS path FROM one JOIN edges ON node = src) t")
def g13(spark, d):
    return G.dependency_paths(edges(spark, d), customers(spark, d), 2).withColumn("path", F.array_join("path", ">"))


@query("g18_details", f"{GRAPH} SELECT src AS job, coalesce(array_to_string(list_sort(list(DISTINCT dst) FILTER (WHERE rel = 'CONTAINS')), ','), '') AS parts, coalesce(array_to_string(list_sort(list(DISTINCT dst) FILTER (WHERE rel = 'DEPENDS_ON')), ','), '') AS owner FROM edges WHERE rel IN ('CONTAINS', 'DEPENDS_ON') GROUP BY 1")
def g18(spark, d):
    x = G.job_details(edges(spark, d), {"CONTAINS": "parts", "DEPENDS_ON": "owner"})
    return x.select("job", *(F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("parts", "owner")))
