"""Bounded traversals of a property graph: one shuffle join for each hop.

``edges`` has ``src, dst, rel``; ``anchors`` has ``anchor``. Depth is a validated number, so
plans have a fixed size. Every ranking ends in the node's id, so results do not depend on
storage order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.stages import broadcast_if_small, materialise, small
from lodestone.sources.star_graph import UNKNOWN_WEIGHT, rel_weights

MAX_DEPTH = 5
#: Rows cost this many tokens besides their names.
ROW_TOKENS = 15


def clamp_depth(depth: int, ceiling: int = MAX_DEPTH) -> int:
    """``depth`` as a number between 1 and ``ceiling``."""
    return max(1, min(int(depth), ceiling))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.select("src", "dst", "rel").union(edges.select(F.col("dst"), F.col("src"), "rel").toDF("src", "dst", "rel"))


def row_tokens(name: Column) -> Column:
    """Tokens of a result row: 15 and a quarter of its name's letters, rounded up."""
    return F.lit(ROW_TOKENS) + F.ceil(F.length(name) / 4).cast("int")


def trim_to_budget(rows: DataFrame, key: str, order: list[Column], name: str, budget: int, header: int = 0) -> DataFrame:
    """Rows of each key in order, up to the first that would exceed the token budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(row_tokens(F.col(name))).over(w) + header).where(F.col("used") <= budget)


def _weighted(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Undirected edges with their relationship's weight; the vocabulary is a table in the code or a parameter."""
    w = F.broadcast(rel_weights(edges.sparkSession, weights))
    return undirected(edges).join(w, "rel", "left").withColumn("weight", F.coalesce("weight", F.lit(UNKNOWN_WEIGHT)))


def neighborhood(edges: DataFrame, anchors: DataFrame, hops: int = 1, budget: int = 4000, max_results: int = 50, min_weight: float = 0.0, mode: str = "decay", weights: dict[str, float] | None = None) -> DataFrame:
    """``anchor, name, rel, hop, score, used``: the scored neighbourhood of each anchor.

    decay: score = weight * 0.5 ** hop; over two hops the second relationship's weight
    counts and a name's first occurrence wins. product: one hop scores the weight, two hops
    the product of both weights times 0.5, and a name's best score wins. ``weights`` replaces the
    fixed vocabulary; relationships outside it weigh 0.3. Rows below ``min_weight`` go, the best ``max_results`` stay, then the token budget cuts.
    """
    e = _weighted(edges, weights)
    step = lambda w: w * (0.5 if mode == "decay" else 1.0)
    one = anchors.select("anchor").join(e, F.expr("anchor = src")).select("anchor", F.col("dst").alias("name"), "rel", F.lit(1).alias("hop"), "weight", step(F.col("weight")).alias("score"))
    rows = one.drop("weight")
    if clamp_depth(hops, 2) == 2:
        one = materialise(one, "near")
        rows = one.drop("weight")
        # A middle node's neighbours of one weight score the same for an anchor. Of these an anchor needs no more, by name, than
        # its results, itself and, as they keep their first score in decay mode, its direct neighbours.
        own = one.groupBy("anchor").agg(F.count_distinct("name").alias("direct"))
        need = F.when(F.lit(mode == "decay"), F.col("direct")).otherwise(0) + max_results + 1
        middle = one.select("anchor", F.col("name").alias("mid"), "weight").distinct().join(own, "anchor").withColumn("need", need).drop("direct")
        most = materialise(middle.groupBy("mid").agg(F.max("need").alias("most")), "middle")
        back = e.select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("rel").alias("rel2"), F.col("weight").alias("weight2"))
        back = back.join(broadcast_if_small(most), "mid").groupBy("mid", "far", "weight2", "most").agg(F.min("rel2").alias("rel2"))
        back = back.withColumn("place", F.row_number().over(Window.partitionBy("mid", "weight2").orderBy("far"))).where("place <= most")
        two = middle.join(back, "mid").where("place <= need and far <> anchor")
        score = F.col("weight2") * 0.25 if mode == "decay" else F.col("weight") * F.col("weight2") * 0.5
        rows = rows.union(two.select("anchor", "far", "rel2", F.lit(2), score))
        best = Window.partitionBy("anchor", "name").orderBy(*([F.col("hop")] if mode == "decay" else []), F.desc("score"), "rel")
        rows = rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    rows = rows.where(F.col("score") >= min_weight)
    order = [F.desc("score"), F.col("name"), F.col("rel")]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("n") <= max_results).drop("n")
    return trim_to_budget(rows, "anchor", order, "name", budget)


def _from(edges: DataFrame, frontier: DataFrame, near: str) -> DataFrame:
    """``edges`` that can start at a node of ``frontier`` (``node``), a filter that goes down to the tables that edges are made from.

    A small frontier is broadcast for a semi-join, which Spark puts below unions and distincts; a large one gives its smallest and largest node.
    """
    own = frontier.select(F.col("node").alias(near)).distinct()
    if small(own):
        return edges.join(F.broadcast(own), near, "left_semi")
    low, high = own.agg(F.min(near), F.max(near)).first()
    return edges.where(F.col(near).between(low, high))


def one_hop(edges: DataFrame, anchors: DataFrame, rels: list[str] | None = None, direction: str = "out") -> DataFrame:
    """``anchor, node, rel``: distinct direct neighbours over the relationships, out, in or both."""
    e = edges if rels is None else edges.where(F.col("rel").isin(rels))
    e = undirected(e) if direction == "both" else e
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    return anchors.select("anchor").join(e, F.col("anchor") == F.col(a)).select("anchor", F.col(b).alias("node"), "rel").distinct()


def call_chain(edges: DataFrame, anchors: DataFrame, depth: int = 4, rels: list[str] | None = None) -> DataFrame:
    """``anchor, node, depth, path``: one row for each path from an anchor, no edge twice in a path."""
    e = edges if rels is None else edges.where(F.col("rel").isin(rels))
    e = e.select("src", "dst", "rel")
    level = anchors.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("depth"), F.array("anchor").alias("path"), F.array().cast("array<string>").alias("used"))
    out = None
    for d in range(1, clamp_depth(depth, 4) + 1):
        onward = _from(e, level, "src").withColumn("edge", F.concat_ws("|", "src", "rel", "dst"))
        level = level.join(onward, F.col("node") == F.col("src")).where(~F.array_contains("used", F.col("edge")))
        level = level.select("anchor", F.col("dst").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array("edge")).alias("used"))
        level = materialise(level, "level")
        out = level if out is None else out.union(level)
    return out.select("anchor", "node", "depth", "path")


def reach(edges: DataFrame, anchors: DataFrame, direction: str = "out", depth: int = 5, rels: list[str] | None = None) -> DataFrame:
    """``anchor, node, hop, rel``: distinct (node, hop, last relationship), and the seed at hop 0."""
    e = edges if rels is None else edges.where(F.col("rel").isin(rels))
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    e = e.select(F.col(a).alias("near"), F.col(b).alias("far"), F.col("rel").alias("via"))
    level = anchors.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("rel"))
    out = level
    for d in range(1, clamp_depth(depth) + 1):
        onward = _from(e, level, "near")
        level = level.select("anchor", "node").distinct().join(onward, F.expr("node = near")).select("anchor", F.col("far").alias("node"), F.lit(d).alias("hop"), F.col("via").alias("rel")).distinct()
        level = materialise(level, "level")
        out = out.union(level)
    return out


def bridge_crossings(reached: DataFrame, bridges: list[str]) -> DataFrame:
    """``anchor, crossings``: rows beyond the seed that were reached over a bridge relationship."""
    return reached.groupBy("anchor").agg(F.sum(F.when((F.col("hop") > 0) & F.col("rel").isin(bridges), 1).otherwise(0)).alias("crossings"))


def change_impact(edges: DataFrame, anchors: DataFrame, direct_rels: list[str], indirect_rels: list[str], bias: float = 0.1, hub: int = 100) -> DataFrame:
    """``anchor, direct, indirect, risk, level`` of a change to each anchor.

    Direct dependents point at the anchor; indirect ones point at a direct one and are
    neither direct nor the anchor, and are only looked for below ``hub`` direct ones. risk =
    min(direct / 20, 0.4) + min(indirect / 50, 0.2) + bias; above 0.7 HIGH, above 0.4 MEDIUM.
    """
    e = edges.select("src", "dst", "rel")
    direct = anchors.select("anchor").join(e.where(F.col("rel").isin(direct_rels)), F.expr("anchor = dst")).select("anchor", F.col("src").alias("node")).distinct()
    n = direct.groupBy("anchor").agg(F.count("*").alias("direct"))
    few = direct.join(n.where(F.col("direct") < hub), "anchor", "left_semi")
    second = few.join(e.where(F.col("rel").isin(indirect_rels)), F.expr("node = dst")).select("anchor", F.col("src").alias("node")).where("node <> anchor").distinct()
    m = second.join(direct, ["anchor", "node"], "left_anti").groupBy("anchor").agg(F.count("*").alias("indirect"))
    out = anchors.select("anchor").distinct().join(n, "anchor", "left").join(m, "anchor", "left").fillna(0, ["direct", "indirect"])
    risk = F.least(F.col("direct") / 20, F.lit(0.4)) + F.least(F.col("indirect") / 50, F.lit(0.2)) + bias
    out = out.withColumn("risk", F.round(risk, 6))
    return out.withColumn("level", F.when(F.col("risk") > 0.7, "HIGH").when(F.col("risk") > 0.4, "MEDIUM").otherwise("LOW"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 5, ties: int = 3) -> DataFrame:
    """``src, dst, length, path, rels``: up to ``ties`` shortest directed paths of each pair, by their names.

    ``rels`` has the relationship of each step, the first by name where two nodes have several.

    Levels of a breadth-first search from each source: a node is entered at its first level only, so a level
    has at most one row for each source, node and predecessor, and each is written to shared storage. A level has only
    nodes from which some pair's end can still be reached in the steps left, the last one only ends of the source's own
    pairs, and a source whose ends were all met is left out. Paths are then followed back from the pairs that were met,
    over predecessors one level nearer.
    """
    most = clamp_depth(depth)
    asked = materialise(pairs.select("src", "dst").where("src <> dst").distinct(), "pairs")
    raw = edges.select(F.col("src").alias("near"), F.col("dst").alias("far"), "rel")
    raw = materialise(raw, "steps") if most > 1 else raw
    # ends[k]: nodes from which an end is at most k steps away
    ends = [materialise(asked.select(F.col("dst").alias("far")).distinct(), "ends")]
    for _ in range(1, most):
        before = raw.join(broadcast_if_small(ends[-1]), "far", "left_semi").select(F.col("near").alias("far"))
        ends.append(materialise(ends[-1].union(before).distinct(), "ends"))
    e = raw.join(broadcast_if_small(ends[-1]), "far", "left_semi")
    level = asked.select("src", F.col("src").alias("node")).distinct()
    seen, steps, met, left = level, [], None, asked
    for d in range(1, most + 1):
        onward = e if d == 1 else e.join(broadcast_if_small(ends[most - d]), "far", "left_semi")
        onward = onward.groupBy("near", "far").agg(F.min("rel").alias("rel"))
        new = level.join(onward, F.expr("node = near")).select("src", F.col("near").alias("before"), F.col("far").alias("node"), "rel")
        new = new.join(left.select("src", F.col("dst").alias("node")), ["src", "node"], "left_semi") if d == most else new
        new = materialise(new.join(seen, ["src", "node"], "left_anti"), "level")
        steps.append(new)
        reached = new.select("src", "node").distinct()
        hit = left.join(reached.withColumnRenamed("node", "dst"), ["src", "dst"], "left_semi").select("src", "dst", F.lit(d).alias("length"))
        met = hit if met is None else met.union(hit)
        if d == most or new.isEmpty():
            break
        left = materialise(left.join(hit.select("src", "dst"), ["src", "dst"], "left_anti"), "left")
        level, seen = reached.join(left.select("src").distinct(), "src", "left_semi"), seen.union(reached)
    met = materialise(met, "met")
    out = None
    for d in range(1, len(steps) + 1):
        paths = met.where(F.col("length") == d).select("src", "dst", "length", F.array("dst").alias("path"), F.array().cast("array<string>").alias("rels"), F.col("dst").alias("node"))
        for step in reversed(steps[:d]):
            paths = paths.join(step, ["src", "node"]).select("src", "dst", "length", F.concat(F.array("before"), "path").alias("path"), F.concat(F.array("rel"), "rels").alias("rels"), F.col("before").alias("node"))
        out = paths if out is None else out.union(paths)
    w = Window.partitionBy("src", "dst").orderBy("length", F.array_join("path", ">"))
    return out.drop("node").withColumn("n", F.row_number().over(w)).where(F.col("n") <= ties).drop("n")


def cycles(edges: DataFrame, max_len: int = 5) -> DataFrame:
    """``length, path`` of each simple cycle, as the rotation that starts at its smallest node."""
    e = edges.select("src", "dst").distinct().where("src <> dst")
    level = e.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    near = e.select(F.col("src").alias("near"), F.col("dst").alias("far"))
    out = None
    for d in range(2, max(2, min(max_len, MAX_DEPTH)) + 1):
        step = level.join(near, F.expr("at = near"))
        closed = step.where("far = start").select(F.lit(d).alias("length"), "path")
        out = closed if out is None else out.union(closed)
        level = step.where("far > start").where(~F.array_contains("path", F.col("far"))).select("start", F.col("far").alias("at"), F.concat("path", F.array("far")).alias("path"))
    return out


def guarded(edges: DataFrame, anchors: DataFrame, depth: int = 2, threshold: int = 100) -> DataFrame:
    """``anchor, node, hop, degraded``: reach of ordinary anchors, and only one hop of hubs."""
    own = anchors.select(F.col("anchor").alias("node"))
    # degrees are counted for the anchors only
    ends = _from(edges, own, "src").select(F.col("src").alias("anchor")).union(_from(edges, own, "dst").select("dst"))
    near = ends.groupBy("anchor").agg(F.count("*").alias("degree"))
    marked = materialise(anchors.select("anchor").join(near, "anchor", "left").withColumn("hub", F.coalesce(F.col("degree") > threshold, F.lit(True))), "marked")
    full = reach(edges, marked.where("not hub"), "out", depth).where("hop > 0").select("anchor", "node", "hop").distinct().withColumn("degraded", F.lit(False))
    hubs = marked.where("hub")
    onward = _from(edges, hubs.select(F.col("anchor").alias("node")), "src")
    return full.union(one_hop(onward, hubs).select("anchor", "node", F.lit(1), F.lit(True)).distinct())


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree`` over both directions."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def outgoing(edges: DataFrame, anchors: DataFrame, limit: int = 25) -> DataFrame:
    """``anchor, rel, node``: the first outgoing relationships by type and name."""
    rows = anchors.select("anchor").join(edges, F.expr("anchor = src")).select("anchor", "rel", F.col("dst").alias("node"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy("rel", "node"))).where(F.col("n") <= limit).drop("n")


def bridge_scores(rows: DataFrame) -> DataFrame:
    """``rows`` (weight, hop, lang, prev_lang) with score = weight * decay ** (hop - 1), where the
    decay is 0.8 across languages and 0.5 else."""
    decay = F.when(F.col("lang") != F.col("prev_lang"), 0.8).otherwise(0.5)
    return rows.withColumn("score", F.col("weight") * F.pow(decay, F.col("hop") - 1))


def hard_negatives(edges: DataFrame, membership: DataFrame, per_anchor: int = 3) -> DataFrame:
    """``anchor, positive, negative``: a neighbour of the anchor's community and one of another."""
    member = membership.select("node", "community")
    # edges lose the ends that are in no community before they are turned round, and are made only once
    e = edges.select("src", "dst").join(member.toDF("src", "a"), "src").join(member.toDF("dst", "b"), "dst").withColumn("same", F.col("a") == F.col("b"))
    ways = F.array(F.struct(F.col("src").alias("anchor"), F.col("dst").alias("node")), F.struct(F.col("dst").alias("anchor"), F.col("src").alias("node")))
    near = e.select(F.inline(ways), "same").distinct()
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("anchor", "same").orderBy("node"))).where(F.col("n") <= per_anchor)
    pairs = near.groupBy("anchor", "n").agg(F.max(F.when(F.col("same"), F.col("node"))).alias("positive"), F.max(F.when(~F.col("same"), F.col("node"))).alias("negative"))
    return pairs.where("positive is not null and negative is not null").select("anchor", "positive", "negative")


def dependency_paths(edges: DataFrame, files: DataFrame, depth: int, nodes: DataFrame | None = None) -> DataFrame:
    """``anchor, depth, path``: dependency paths of files; nodes' labels stand before their names if given."""
    chains = call_chain(edges, files, depth).select("anchor", "depth", "path")
    if nodes is None:
        return chains
    steps = chains.select("anchor", "depth", "path", F.posexplode("path").alias("i", "node_id"))
    steps = steps.join(nodes.select("node_id", "label"), "node_id", "left").withColumn("step", F.concat_ws(":", "label", "node_id"))
    typed = steps.groupBy("anchor", "depth", "path").agg(F.array_sort(F.collect_list(F.struct("i", "step"))).alias("s"))
    return typed.select("anchor", "depth", F.transform("s", lambda x: x["step"]).alias("path"))


def file_symbols(edges: DataFrame, nodes: DataFrame, rel: str = "DEFINES") -> DataFrame:
    """``file, symbol, kind``: functions and classes that a file defines, by their labels; others go."""
    labels = F.col("labels")
    kind = F.when(F.exists(labels, lambda x: x.contains("Class")), "CLASS").when(F.exists(labels, lambda x: x.contains("Function") | x.contains("Subroutine") | x.contains("Method")), "FUNCTION")
    symbols = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("symbol"), kind.alias("kind")).where("kind is not null")
    return edges.where(F.col("rel") == rel).join(symbols, "dst").select(F.col("src").alias("file"), "symbol", "kind").distinct()


def entity_type(nodes: DataFrame) -> DataFrame:
    """``node_id, kind``: python, fortran, shell or function, the first that a label names; else unknown."""
    text = F.array_join("labels", " ")
    out = None
    for word, kind in (("Python", "python"), ("Fortran", "fortran"), ("Shell", "shell"), ("Function", "function")):
        out = F.when(text.contains(word), kind) if out is None else out.when(text.contains(word), kind)
    return nodes.select("node_id", out.otherwise("unknown").alias("kind"))


def job_details(edges: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``job`` and a column of sorted names for each kind (``kinds``: relationship to kind)."""
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("rel")]
    rows = edges.select(F.col("src").alias("job"), kind.alias("kind"), "dst").where("kind is not null")
    return rows.groupBy("job").pivot("kind", sorted(set(kinds.values()))).agg(F.array_sort(F.collect_set("dst")))


def script_env(edges: DataFrame) -> DataFrame:
    """``variable, dependents, exporters, setters``: sorted scripts of each variable."""
    return job_details(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"), {"DEPENDS_ON_ENV": "dependents", "EXPORTS": "exporters", "SETS": "setters"}).withColumnRenamed("job", "variable")


def cross_language_trace(edges: DataFrame, roots: DataFrame, first: str, then: str, depth: int = 3) -> DataFrame:
    """``root, trace``: distinct (program, routine, depth) from each root over one bridge relationship,
    then over calls up to ``depth``; a program without calls has a null routine."""
    start = roots.select("root").join(edges.where(F.col("rel") == first), F.expr("root = src")).select("root", F.col("dst").alias("program")).distinct()
    calls = call_chain(edges, start.select(F.col("program").alias("anchor")).distinct(), depth, [then]).select(F.col("anchor").alias("program"), F.col("node").alias("routine"), "depth").distinct()
    rows = start.join(calls, "program", "left")
    return rows.groupBy("root").agg(F.array_sort(F.collect_set(F.struct("program", "routine", "depth"))).alias("trace"))


def code_with_dependencies(edges: DataFrame, nodes: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """``symbol, file, imports, functions, callers``: the file that defines each symbol and what belongs to it."""
    home = edges.where("rel = 'DEFINES'").join(symbols.select(F.col("symbol").alias("dst")), "dst").select(F.col("dst").alias("symbol"), F.col("src").alias("file")).distinct()
    imports = reach(edges, home.select(F.col("file").alias("anchor")).distinct(), "out", depth, ["IMPORTS"]).where("hop > 0").groupBy(F.col("anchor").alias("file")).agg(F.array_sort(F.collect_set("node")).alias("imports"))
    functions = file_symbols(edges, nodes).where("kind = 'FUNCTION'").groupBy("file").agg(F.array_sort(F.collect_set("symbol")).alias("functions"))
    callers = edges.where("rel = 'CALLS'").groupBy(F.col("dst").alias("symbol")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
    return home.join(imports, "file", "left").join(functions, "file", "left").join(callers, "symbol", "left").select("symbol", "file", "imports", "functions", "callers")
