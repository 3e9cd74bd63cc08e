"""Traversal, resolution and community operators on a small code graph."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import community as C
from lodestone.operators import joins as J
from lodestone.operators import traversal as G
from lodestone.operators import writes as S
from lodestone.operators.components import connected_components

EDGES = [
    ("a.sh", "b.sh", "SOURCES"), ("a.sh", "prog", "EXECUTES"), ("prog", "sub1", "CALLS"), ("sub1", "sub2", "CALLS"), ("b.sh", "run.py", "INVOKES"), ("run.py", "fn", "CALLS"),
    ("m1", "m2", "IMPORTS"), ("m2", "m3", "IMPORTS"), ("m3", "m1", "IMPORTS"), ("x1", "x2", "USES"), ("x2", "x3", "USES"), ("x3", "x4", "USES"), ("x4", "x5", "USES"), ("x5", "x1", "USES"),
    ("s", "p1", "CALLS"), ("s", "p2", "CALLS"), ("p1", "t", "CALLS"), ("p2", "t", "CALLS"),
] + [("hub", f"n{i}", "CALLS") for i in range(101)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, rel string")


def anchors(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "anchor string")


def test_depth_is_clamped():
    assert [G.clamp_depth(d) for d in (-5, 0, 3, 10**9)] == [1, 1, 3, 5]


def test_cycles_have_one_rotation(edges, rows):
    assert [(n, p) for n, p in rows(G.cycles(edges))] == [(3, ["m1", "m2", "m3"]), (5, ["x1", "x2", "x3", "x4", "x5"])]


def test_shortest_paths_keep_ties(spark, edges, rows):
    pairs = spark.createDataFrame([("s", "t"), ("m1", "m3"), ("t", "s")], "src string, dst string")
    got = rows(G.shortest_paths(edges, pairs).select("src", "dst", "length", "path"))
    assert all(len(r.rels) == r.length for r in G.shortest_paths(edges, pairs).collect())
    assert got == [("m1", "m3", 2, ["m1", "m2", "m3"]), ("s", "t", 2, ["s", "p1", "t"]), ("s", "t", 2, ["s", "p2", "t"])]


def test_call_chain_gives_a_row_for_each_path(spark, edges, rows):
    got = rows(G.call_chain(edges, anchors(spark, "s", "m1"), 4).select("anchor", "node", "depth"))
    assert got.count(("s", "t", 2)) == 2
    assert [r for r in got if r[0] == "m1"] == [("m1", "m1", 3), ("m1", "m2", 1), ("m1", "m3", 2)]  # the edge m1-m2 is not used again


def test_guard_degrades_hubs(spark, edges, rows):
    got = rows(G.guarded(edges, anchors(spark, "hub", "s"), 2, 100))
    assert sum(r[0] == "hub" for r in got) == 101 and all(r[3] for r in got if r[0] == "hub")
    assert ("s", "t", 2, False) in got


def test_reach_and_crossings(spark, edges, rows):
    r = G.reach(edges, anchors(spark, "a.sh"), "out", 5)
    assert {(n, h) for _, n, h, _ in rows(r)} == {("a.sh", 0), ("b.sh", 1), ("prog", 1), ("sub1", 2), ("sub2", 3), ("run.py", 2), ("fn", 3)}
    assert rows(G.bridge_crossings(r, ["EXECUTES", "INVOKES"])) == [("a.sh", 2)]


@settings(max_examples=5, deadline=None)
@given(budget=st.integers(0, 200))
def test_budget_keeps_a_prefix(spark, edges, budget):
    full = G.neighborhood(edges, anchors(spark, "hub"), budget=10**6).orderBy("used").collect()
    cut = G.neighborhood(edges, anchors(spark, "hub"), budget=budget).orderBy("used").collect()
    assert cut == full[: len(cut)] and all(r.used <= budget for r in cut)


def test_change_impact(spark, edges, rows):
    got = rows(G.change_impact(edges, anchors(spark, "t", "sub2"), ["CALLS"], ["CALLS"], 0.3).select("anchor", "direct", "indirect", "risk", "level"))
    assert got == [("sub2", 1, 1, 0.37, "LOW"), ("t", 2, 1, 0.42, "MEDIUM")]


def test_components_of_chains_and_empty(spark, rows):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 3)], "src long, dst long")
    assert {c for _, c in rows(connected_components(chain))} == {0, 100}
    assert rows(connected_components(chain.limit(0))) == []


def test_resolve_executable(spark, rows):
    refs = spark.createDataFrame([(x,) for x in ("model", "post", "gsi", "tool_v2_fast", "skip", "none")], "ref string")
    programs = spark.createDataFrame([(x,) for x in ("model", "post_main", "gsi_run", "tool", "skip")], "program string")
    known = spark.createDataFrame([("skip", None)], "ref string, program string")
    got = rows(J.resolve_executable(refs, programs, known))
    assert got == [("gsi", "gsi_run", 3), ("model", "model", 1), ("post", "post_main", 2), ("tool_v2_fast", "tool", 4)]


def test_links_by_basename(spark, rows):
    tasks = spark.createDataFrame([("t1", "/x/jobs/JRUN -a"), ("t2", "/x/none.sh")], "task string, command string")
    linked, rest = J.link_by_basename(tasks, spark.createDataFrame([("repo/jobs/JRUN",)], "path string"))
    assert rows(linked) == [("t1", "repo/jobs/JRUN")] and rows(rest) == [("t2",)]


def test_related_files_with_hubs(spark, rows):
    """Targets of all files, of many and of few, against all pairs."""
    rng = random.Random(5)
    own = {f"f{i:02}": {"all"} | {f"h{j}" for j in range(3) if rng.random() < 0.4} | {f"t{rng.randrange(12)}" for _ in range(rng.randrange(4))} for i in range(40)}
    own["lone"], own["far"] = {"all"}, {"t99"}
    edges = spark.createDataFrame([(f, t) for f, x in own.items() for t in x] + [("f00", "all"), (None, "all"), ("f01", None)], "src string, dst string")
    want = []
    for f, x in own.items():
        near = sorted(((-len(x & y), g) for g, y in own.items() if g != f and x & y))[:3]
        want += [(f, g, -n) for n, g in near]
    for hub in (1, 6, 20, 1000):
        assert rows(J.related_files(edges, 3, hub)) == sorted(want, key=repr)
    assert J.related_files(edges.limit(0), 3).count() == 0


def test_link_mentions_configs_chunks_and_references(spark, rows):
    files = spark.createDataFrame([("src/a/run.py",), ("src/b/go.sh",)], "path string")
    m = spark.createDataFrame([(1, "a/run.py"), (2, "b/run.py")], "doc int, mention string")
    assert rows(J.link_mentions(m, files)) == [(1, "src/a/run.py")]
    part = spark.createDataFrame([(1, "ush/run"), (2, "n_"), (3, "/"), (4, ""), (5, None), (6, "run_a.sh.x"), (7, "ush/run")], "doc int, mention string")
    paths = spark.createDataFrame([("x/ush/run_a.sh",), ("run",), (None,), ("",), ("x/ush/run_a.sh",)], "path string")
    assert rows(J.link_mentions(part, paths)) == [(i, "x/ush/run_a.sh") for i in (1, 2, 3, 7)]
    assert J.link_mentions(part, paths.limit(0)).count() == J.link_mentions(part.limit(0), paths).count() == 0
    c = spark.createDataFrame([("e1", "base"), ("e2", "config.resources.x")], "config string, short string")
    assert rows(J.resolve_configs(c, spark.createDataFrame([("g", "base"), ("h", "config.resources.x")], "config string, short string"))) == [("e1", "g")]
    nodes = spark.createDataFrame([("f", "p", None), ("f:g", "p", "g")], "node_id string, path string, name string")
    chunks = spark.createDataFrame([("c1", "p", None), ("c2", "p", "g"), ("c3", "q", None)], "chunk_id string, path string, name string")
    assert rows(J.link_chunks(nodes, chunks)) == [("c1", "f"), ("c2", "f:g")]


def test_lift_edges(spark, rows):
    e = spark.createDataFrame([("file1", "x", "DEFINES")], "src string, dst string, rel string")
    a = spark.createDataFrame([("file1", "repo/ush/a.sh")], "node_id string, path string")
    b = spark.createDataFrame([("script1", "ush/a.sh"), ("script2", "other/a.sh")], "node_id string, path string")
    assert rows(J.lift_edges(e, a, b)) == [("script1", "x", "DEFINES")]


def test_resolve_sources(spark, rows):
    s = spark.createDataFrame([("one", "a/b", 1, "p", "p", False), ("two", "c", 3, None, None, False), ("three", "a/b/d", 1, "p", "q", True), ("four", None, 1, None, None, False)], "name string, root string, least int, pin string, commit string, dirty boolean")
    f = spark.createDataFrame([("a/b/x",), ("a/b/d/y",), ("c/z",)], "path string")
    assert rows(J.resolve_sources(s, f)) == [("four", 0, "needs_crawl", "missing"), ("one", 2, "disk", None), ("three", 1, "needs_crawl", "off_pin"), ("two", 1, "needs_crawl", "below_minimum")]


def test_hybrid_query(spark, rows):
    e = spark.createDataFrame([("f", "m", "IMPORTS"), ("f", "g1", "DEFINES"), ("x", "g1", "CALLS")], "src string, dst string, rel string")
    assert rows(J.hybrid_query(spark.createDataFrame([("f",), ("z",)], "file string"), e)) == [("f", ["m"], ["g1"], None, ["x"]), ("z", None, None, None, None)]


def test_merge_duplicates_fill_nulls_and_move_edges(spark, rows):
    nodes = spark.createDataFrame([("1", "S", "a", None), ("2", "S", "a", "bash"), ("3", "S", "b", "ksh")], "node_id string, label string, name string, shell string")
    e = spark.createDataFrame([("1", "3", "R"), ("2", "3", "R"), ("1", "9", "R")], "src string, dst string, rel string")
    n, moved = S.merge_duplicate_nodes(nodes, e)
    assert rows(n.select("node_id", "name", "shell", "merged")) == [("1", "a", "bash", 2), ("3", "b", "ksh", 1)]
    assert rows(moved) == [("1", "3", "R"), ("1", "9", "R")]


def test_purge_counts(spark, rows):
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([("1", "A"), ("2", "B")], "node_id string, label string")
    e = spark.createDataFrame([("1", "2", "R")], "src string, dst string, rel string")
    kept, left, dry = S.purge(nodes, e, F.col("label") == "A")
    assert rows(kept) == [("2", "B")] and rows(left) == [] and rows(dry) == [("A", 1)]


def test_communities_of_two_cliques(spark):
    two = [(f"a{i}", f"a{j}") for i, j in itertools.combinations(range(5), 2)] + [(f"b{i}", f"b{j}") for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0")]
    pairs = spark.createDataFrame([(*p, 1) for p in two], "a string, b string, weight int")
    got = {r.node: r.community for r in C.communities(pairs, max_levels=1).collect()}
    best = C.modularity(pairs, C.communities(pairs, max_levels=1).select("node", "community")).first()[0]
    assert len(got) == 10 and best > 0.3


def test_refinement_parts_what_local_moves_leave_apart(spark):
    """Node 0 holds two triangles together in one community and then moves to a third group, which it is tied to more."""
    tri = lambda x: [(f"{x}{i}", f"{x}{j}", 4) for i, j in itertools.combinations(range(3), 2)]
    pairs = tri("a") + tri("b") + tri("d") + [("0", "a0", 1), ("0", "b0", 1), ("0", "d0", 6), ("0", "d1", 6)] + [(f"z{i}", f"z{j}", 9) for i, j in itertools.combinations(range(8), 2)]
    df = spark.createDataFrame(pairs, "a string, b string, weight int")
    ends = C._ends(df).toDF("node", "other", "weight")
    ends = ends.join(ends.groupBy("node").agg(F.sum("weight").alias("k")), "node").select("node", "other", "weight", "k")
    level = C._Level(ends, float(sum(p[2] for p in pairs)), 1.0)
    first = {n: "a0" if n[0] in "ab0" else n[0] for p in pairs for n in p[:2]}
    place = ends.groupBy("node").agg(F.max("k").alias("k")).join(spark.createDataFrame(list(first.items()), "node string, community string"), "node")
    best, _ = level.local_moves(place, 1)
    coarse = {r.node: r.community for r in best.collect()}
    assert coarse["0"] == coarse["d0"] and coarse["a1"] == coarse["b1"]  # no edge leads from a to b now
    parts, n = level.refined(best)
    fine = {r.node: r.part for r in parts.collect()}
    assert len(set(fine.values())) == n and not {fine[x] for x in fine if x[0] == "a"} & {fine[x] for x in fine if x[0] == "b"}
    got = {r.node: r.community for r in C.communities(df).where("level = 0").collect()}
    assert got["a0"] != got["b0"] and got["d0"] == got["0"]


def test_communities_are_connected_and_nested(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted((f"{g}{rng.randrange(12):02}", f"{h}{rng.randrange(12):02}"))) for g in "abcde" for h in "abcde" for _ in range(40 if g == h else 2)}
    pairs = [(a, b, 1) for a, b in pairs if a != b]
    df = spark.createDataFrame(pairs, "a string, b string, weight int")
    levels = {}
    for r in C.communities(df).collect():
        levels.setdefault(r.level, {})[r.node] = r.community
    for level in levels.values():
        for name in set(level.values()):
            own = {n for n, c in level.items() if c == name}
            reach, grown = {name}, None
            while reach != grown:
                grown, reach = reach, reach | {y for a, b, _ in pairs for x, y in ((a, b), (b, a)) if x in reach and y in own}
            assert min(own) == name and reach == own
    for i in range(max(levels)):
        up = {}
        assert all(up.setdefault(levels[i][n], levels[i + 1][n]) == levels[i + 1][n] for n in levels[i])
    last = levels[max(levels)]
    found = C.modularity(df, spark.createDataFrame(list(last.items()), "node string, community string")).first()[0]
    planted = C.modularity(df, spark.createDataFrame([(n, n[0]) for n in last], "node string, community string")).first()[0]
    assert found >= planted - 0.01
    assert C.communities(df.limit(0)).count() == 0


def test_communities_of_a_chain_need_three_levels(spark):
    n = 150
    pairs = spark.createDataFrame([(i, i + 1, 1) for i in range(n - 1)], "a long, b long, weight int")
    levels = {}
    for r in C.communities(pairs).collect():
        levels.setdefault(r.level, {})[r.node] = r.community
    degree = [1] + [2] * (n - 2) + [1]

    def quality(of):
        size = {}
        for i in range(n):
            size[of[i]] = size.get(of[i], 0) + degree[i]
        return sum(of[i] == of[i + 1] for i in range(n - 1)) / (n - 1) - sum((k / (2 * n - 2)) ** 2 for k in size.values())

    assert sorted(levels) == list(range(len(levels))) and 3 <= len(levels) <= 5
    assert all(len(of) == n for of in levels.values())
    scores = [quality(levels[k]) for k in sorted(levels)]
    assert scores == sorted(scores) and scores[-1] > 0.8
    # the last level is whole: joining no two neighbours would gain
    last = levels[len(levels) - 1]
    for i in range(n - 1):
        joined = {k: last[i] if c == last[i + 1] else c for k, c in last.items()}
        assert quality(joined) <= scores[-1] + 1e-9
    # a community holds a connected stretch and has its smallest node's name
    assert all(last[i] == last[i + 1] or last[i + 1] == i + 1 for i in range(n - 1))


def test_summaries(spark, rows):
    m = spark.createDataFrame([("1", 7, "Job", "alpha"), ("2", 7, "Job", "beta"), ("3", 7, "File", "c")], "node string, community int, label string, name string")
    e = spark.createDataFrame([("1", "2", "CALLS")], "src string, dst string, rel string")
    text = C.summarize_leaf(m, e)
    assert rows(text) == [(7, "Community of 3 members. Job (2): alpha, beta; File (1): c. Relationships: CALLS")]
    s = spark.createDataFrame([(7, 8, 5)], "a int, b int, strength int")
    parent = C.summarize_parent(spark.createDataFrame([(7, 7)], "community int, child int"), text, s)
    assert parent.first().summary.startswith("1 parts. Community of 3") and parent.first().summary.endswith("Works with: 8")
    ctx = C.community_contexts(m, e, s).first().context
    assert '"members":["1","2","3"]' in ctx and '"strength":5' in ctx
    t = spark.createDataFrame([(7, "run forecast model"), (8, "x")], "community int, text string")
    assert rows(C.infer_purpose(t, {"forecasting": ["forecast", "model"], "running": ["run"]})) == [(7, "forecasting"), (8, "general")]
    lv = spark.createDataFrame([("1", 0, 3), ("1", 1, 9), ("2", 0, 4), ("2", 1, 9)], "node string, level int, community int")
    assert rows(C.children(lv)) == [(9, 3), (9, 4)] and rows(C.members(lv.where("level = 1"), 9)) == [("1",), ("2",)]


NODES = [("fn", "fn", ["PythonFunction"]), ("run.py", "run.py", ["PythonModule"]), ("prog", "prog", ["FortranProgram"]), ("K", "K", ["PythonClass"]), ("x", "x", ["Thing"])]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "node_id string, name string, labels array<string>")


def test_symbols_types_and_bundles(spark, nodes, rows):
    e = spark.createDataFrame([("run.py", "fn", "DEFINES"), ("run.py", "K", "DEFINES"), ("run.py", "x", "DEFINES"), ("run.py", "os", "IMPORTS"), ("os", "sys", "IMPORTS"), ("a", "fn", "CALLS")], "src string, dst string, rel string")
    assert rows(G.file_symbols(e, nodes)) == [("run.py", "K", "CLASS"), ("run.py", "fn", "FUNCTION")]
    assert rows(G.entity_type(nodes)) == [("K", "python"), ("fn", "python"), ("prog", "fortran"), ("run.py", "python"), ("x", "unknown")]
    s = spark.createDataFrame([("fn",)], "symbol string")
    assert rows(G.code_with_dependencies(e, nodes, s)) == [("fn", "run.py", ["os", "sys"], ["fn"], ["a"])]


def test_jobs_variables_traces_and_paths(spark, edges, rows):
    e = spark.createDataFrame([("J", "c", "CONFIG"), ("J", "s", "SOURCES"), ("s1", "V", "EXPORTS"), ("s2", "V", "DEPENDS_ON_ENV")], "src string, dst string, rel string")
    assert rows(G.job_details(e, {"CONFIG": "config", "SOURCES": "sources"})) == [("J", ["c"], ["s"])]
    assert rows(G.script_env(e)) == [("V", ["s2"], ["s1"], [])] or rows(G.script_env(e)) == [("V", ["s2"], ["s1"], None)]
    roots = spark.createDataFrame([("a.sh",)], "root string")
    got = G.cross_language_trace(edges, roots, "EXECUTES", "CALLS").first()
    assert [tuple(x) for x in got.trace] == [("prog", "sub1", 1), ("prog", "sub2", 2)]
    labelled = spark.createDataFrame([("m1", "File"), ("m2", "File")], "node_id string, label string")
    assert (1, ["File:m1", "File:m2"]) in [(d, p) for _, d, p in rows(G.dependency_paths(edges, anchors(spark, "m1"), 1, labelled))]
