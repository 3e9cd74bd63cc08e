"""Communities of a graph: detection, hierarchy, interactions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.plans.stages import materialise


def project(edges: DataFrame, rels: list[str]) -> DataFrame:
    """``a, b, weight``: undirected pairs over the relationships with how many edges they have."""
    e = edges.where(F.col("rel").isin(rels)).where("src <> dst")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "weight").union(pairs.select(F.col("b"), F.col("a"), "weight"))


def modularity(pairs: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row ``modularity`` of a partition (``node, community``) of an undirected graph."""
    m = membership.select("node", "community")
    total = pairs.agg(F.sum("weight").alias("total"))
    inside = pairs.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w"))
    deg = _ends(pairs).select(F.col("a").alias("node"), "weight").join(m, "node").groupBy("community").agg(F.sum("weight").alias("k"))
    x = deg.join(inside, "community", "left").withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    part = F.coalesce("w", F.lit(0)) / F.col("total") - F.lit(gamma) * F.pow(F.col("k") / (2 * F.col("total")), 2)
    return x.agg(F.round(F.sum(part), 6).alias("modularity"))


#: A move must gain more than this.
LEAST_GAIN = 1e-9


class _Level:
    """One level's graph: ``ends`` (``node, other, weight, k``, both ways) with ``k`` the node's weighted degree, which
    counts what lies inside it, and the weight of all edges."""

    def __init__(self, ends: DataFrame, total: float, gamma: float):
        self.ends, self.total, self.gamma = ends, total, gamma

    def expected(self, k: Column, rest: Column) -> Column:
        """The weight that chance puts between parts of these degrees."""
        return F.lit(self.gamma) * k * rest / (2 * self.total)

    def half(self, place: DataFrame, turn: Column) -> DataFrame:
        """``node, k, community, moved, w, kc`` after the nodes in turn have moved to their best communities.

        ``w`` is what a node had in its community before, ``kc`` that community's degree. A hub's edges are summed up by
        (node, community), and these by node, each time before the shuffle.
        """
        kc = place.groupBy("community").agg(F.sum("k").alias("kc"))
        at = place.select("node", "community").join(kc.hint("merge"), "community").select("node", "community", "kc")
        x = self.ends.join(at.hint("merge"), "node").join(at.toDF("other", "to", "kt").hint("merge"), "other")
        x = x.groupBy("node", "to").agg(F.sum("weight").alias("w"), *(F.max(c).alias(c) for c in ("k", "kt", "kc", "community")))
        own, loss = F.col("to") == F.col("community"), self.expected(F.col("k"), F.col("kt")) - F.col("w")
        x = x.groupBy("node").agg(F.coalesce(F.max(F.when(own, F.col("w"))), F.lit(0.0)).alias("w"), F.min(F.when(~own, F.struct(loss.alias("loss"), "to"))).alias("best"), *(F.max(c).alias(c) for c in ("k", "kc", "community")))
        stay = F.col("w") - self.expected(F.col("k"), F.col("kc") - F.col("k"))
        x = x.withColumn("moved", F.coalesce(turn & (-F.col("best.loss") > stay + LEAST_GAIN), F.lit(False)))
        return x.select("node", "k", F.when(F.col("moved"), F.col("best.to")).otherwise(F.col("community")).alias("community"), "moved", "w", "kc")

    def local_moves(self, place: DataFrame, patience: int) -> tuple[DataFrame, int]:
        """The best places that sweeps over both halves of the nodes reach, and how many communities they make."""
        best, most, waited, idle, step = place, None, 0, 0, 0
        while True:
            new = materialise(self.half(place, F.pmod(F.xxhash64("node", F.lit(step // 2)), F.lit(2)) == step % 2), "place")
            # the quality of the places before the moves, up to what lies inside the nodes
            moved, held, square = new.agg(F.sum(F.col("moved").cast("long")), F.sum("w"), F.sum(F.col("k") * F.col("kc"))).first()
            quality = (held or 0) / (2 * self.total) - self.gamma * (square or 0) / (2 * self.total) ** 2
            best, most, waited = (place, quality, 0) if most is None or quality > most + LEAST_GAIN else (best, most, waited + 1)
            idle = 0 if moved else idle + 1
            if idle == 2 or waited >= 2 * patience:
                return best, best.agg(F.count_distinct("community")).first()[0]
            place, step = new.select("node", "k", "community"), step + 1

    def refined(self, place: DataFrame) -> tuple[DataFrame, int]:
        """``node, k, community, part`` with well-connected nodes merged inside their communities, and the number of parts.

        Parts start as single nodes. A node that is still single and well connected with its community
        joins the well-connected part with the highest positive gain. Nodes of one half (a new one each
        time) may join what does not move then itself, so a part is connected: whoever joins has an edge into it.
        """
        at = place.select("node", "community")
        same = self.ends.join(at.hint("merge"), "node").join(at.toDF("other", "c").hint("merge"), "other")
        inner = materialise(same.where("community = c").select("node", "other", "weight", "k"), "inner")
        kc = place.groupBy("community").agg(F.sum("k").alias("kc"))
        tied = inner.groupBy("node").agg(F.sum("weight").alias("w"))
        start = place.select("node", "k", "community").join(kc.hint("merge"), "community").join(tied.hint("merge"), "node", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        parts, idle, step = materialise(start.withColumn("part", F.col("node")), "parts"), 0, 0
        count = place.count()
        while True:
            turn = lambda c: F.pmod(F.xxhash64(c, F.lit(step // 2)), F.lit(2)) == step % 2  # noqa: B023, E731
            own = parts.select("node", "part")
            near = inner.join(own.hint("merge"), "node").join(own.toDF("other", "to").hint("merge"), "other").groupBy("node", "to").agg(F.sum("weight").alias("v"), F.max("k").alias("k"), F.max("part").alias("part"))
            inside = near.where("part = to").groupBy("part").agg(F.sum("v").alias("inside"))
            size = parts.groupBy("part").agg(F.sum("k").alias("kp"), F.sum("w").alias("wp"), F.count("*").alias("n"), F.max("kc").alias("kc")).join(inside.hint("merge"), "part", "left")
            fine = F.col("wp") - F.coalesce("inside", F.lit(0.0)) >= self.expected(F.col("kp"), F.col("kc") - F.col("kp")) - LEAST_GAIN
            goal = size.where(fine & ((F.col("n") > 1) | ~turn("part"))).select(F.col("part").alias("to"), "kp")
            loss = self.expected(F.col("k"), F.col("kp")) - F.col("v")
            way = near.where(turn("node")).join(goal.hint("merge"), "to", "left").groupBy("node").agg(
                F.max(F.col("part") == F.col("to")).alias("joined"), F.min(F.when((F.col("part") != F.col("to")) & (loss < -LEAST_GAIN), F.struct(loss.alias("loss"), "to"))).alias("best"))
            # a node whose part holds none of its neighbours is still single
            way = way.where("not joined and best is not null").select("node", F.col("best.to").alias("goal"))
            well = F.col("w") >= self.expected(F.col("k"), F.col("kc") - F.col("k")) - LEAST_GAIN
            new = parts.join(way.hint("merge"), "node", "left").withColumn("moves", F.col("goal").isNotNull() & well)
            new = materialise(new.withColumn("part", F.when(F.col("moves"), F.col("goal")).otherwise(F.col("part"))).drop("goal"), "parts")
            moved = new.agg(F.sum(F.col("moves").cast("long"))).first()[0] or 0
            parts, step, count, idle = new.drop("moves"), step + 1, count - moved, 0 if moved else idle + 1
            if idle == 2:
                name = parts.groupBy("part").agg(F.min("node").alias("name"))
                return parts.join(name.hint("merge"), "part").select("node", "k", "community", F.col("name").alias("part")), count

    def contracted(self, parts: DataFrame) -> tuple[_Level, DataFrame]:
        """The graph of the parts, and their places in the communities that they came from."""
        parts = materialise(parts, "refined")
        degree = parts.groupBy("part").agg(F.sum("k").alias("k"), F.max("community").alias("community"))
        name = degree.groupBy("community").agg(F.min("part").alias("name"))
        place = materialise(degree.join(name.hint("merge"), "community").select(F.col("part").alias("node"), "k", F.col("name").alias("community")), "place")
        own = parts.select("node", "part")
        ends = self.ends.select("node", "other", "weight").join(own.hint("merge"), "node").join(own.toDF("other", "to").hint("merge"), "other").where("part <> to")
        ends = ends.groupBy(F.col("part").alias("node"), F.col("to").alias("other")).agg(F.sum("weight").alias("weight"))
        return _Level(materialise(ends.join(degree.select(F.col("part").alias("node"), "k").hint("merge"), "node").select("node", "other", "weight", "k"), "ends"), self.total, self.gamma), place


def communities(pairs: DataFrame, gamma: float = 1.0, max_levels: int = 5, patience: int = 1) -> DataFrame:
    """``node, level, community``: a hierarchy of connected communities by local moves, refinement and contraction (Leiden).

    On every level first one half of the nodes (by a hash of node and sweep), then the other moves to the
    neighbouring community with the highest gain of modularity, ties to the smallest name, until no
    node moves or ``patience`` sweeps on end have not raised it; the best places count. Each
    community is then taken apart into single nodes, which merge again only where they are well connected
    with it and with what they join. These parts are the level's communities and the nodes of
    the next level's graph, whose moves start from the communities before they were taken apart.
    The last level has the final communities, split where they are not connected; it is
    reached when refinement merges nothing more or after ``max_levels``.

    Each sweep is one job, written to shared storage. Joins are told to merge, as small sides would be broadcast through the
    driver in every sweep. Null ends and loops are left out, and an empty graph
    gives an empty result. Community names are those of their smallest nodes.
    """
    clean = pairs.where("a is not null and b is not null and a <> b").select("a", "b", F.col("weight").cast("double").alias("weight"))
    both = _ends(clean).toDF("node", "other", "weight").groupBy("node", "other").agg(F.sum("weight").alias("weight"))
    degree = both.groupBy("node").agg(F.sum("weight").alias("k"))
    ends = materialise(both.join(degree.hint("merge"), "node").select("node", "other", "weight", "k"), "ends")
    total = (ends.agg(F.sum("weight")).first()[0] or 2.0) / 2
    level, place = _Level(ends, total, gamma), ends.groupBy("node").agg(F.max("k").alias("k")).withColumn("community", F.col("node"))
    place, member, out, n = materialise(place, "place"), None, None, 0

    def add(found: DataFrame) -> DataFrame:
        """The level's rows for all nodes, from ``node, part`` of the level's own ones."""
        nonlocal member, out
        member = materialise(found if member is None else member.join(found.toDF("part", "up").hint("merge"), "part").select("node", F.col("up").alias("part")), "members")
        rows = member.select("node", F.lit(n).alias("level"), F.col("part").alias("community"))
        out = rows if out is None else out.union(rows)
        return out

    while True:
        best, count = level.local_moves(place, patience)
        whole = best.count()
        if count == whole and n:
            return out  # nothing merges any more
        parts, found = (best, whole) if n + 1 == max_levels else level.refined(best)
        if found == whole:
            inside = level.ends.join(best.select("node", "community").hint("merge"), "node").join(best.select(F.col("node").alias("other"), F.col("community").alias("c")).hint("merge"), "other").where("community = c")
            split = connected_components(inside, "node", "other") if count < whole else best.select("node", F.col("node").alias("component"))
            return add(best.join(split.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("part")))
        add(parts.select("node", "part"))
        level, place = level.contracted(parts)
        n += 1


def materialize_levels(membership: DataFrame, least: int = 2) -> DataFrame:
    """``level, community, members``: communities with at least ``least`` members at every level."""
    return membership.groupBy("level", "community").agg(F.count("*").alias("members")).where(F.col("members") >= least)


def hierarchy_edges(membership: DataFrame) -> DataFrame:
    """``child, parent, rel``: MEMBER_OF a level-0 community, PARENT_OF from one level to the next."""
    low = membership.where("level = 0").select(F.col("node").alias("child"), F.col("community").alias("parent"), F.lit("MEMBER_OF").alias("rel"))
    a = membership.select("node", "level", F.col("community").cast("string").alias("child"))
    b = membership.select("node", (F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    return low.union(a.join(b, ["node", "level"]).select("child", "parent", F.lit("PARENT_OF")).distinct())


def interactions(edges: DataFrame, membership: DataFrame, least: int = 3) -> DataFrame:
    """``a, b, rel, strength``: edges between different communities, by relationship."""
    m = membership.select("node", "community")
    x = edges.join(m.toDF("src", "a"), "src").join(m.toDF("dst", "b"), "dst").where("a <> b")
    return x.groupBy("a", "b", "rel").agg(F.count("*").alias("strength")).where(F.col("strength") >= least)


def enrich(membership: DataFrame, members: int = 10) -> DataFrame:
    """``community, member_count, key_members, languages``: its first members by name, and languages."""
    w = Window.partitionBy("community").orderBy("node")
    k = membership.withColumn("n", F.row_number().over(w))
    return k.groupBy("community").agg(
        F.count("*").alias("member_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= members, F.col("node")))), ",").alias("key_members"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )


def internal_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``community, src, dst, rel``: edges inside a community."""
    m = membership.select("node", "community")
    return edges.join(m.toDF("src", "community"), "src").join(m.toDF("dst", "other"), "dst").where("community = other").select("community", "src", "dst", "rel")


def members(membership: DataFrame, community: str | int) -> DataFrame:
    """The nodes of one community."""
    return membership.where(F.col("community") == community).select("node")


def children(membership: DataFrame) -> DataFrame:
    """``community, child``: the next lower level's communities in each community."""
    a = membership.select("node", "level", "community")
    b = membership.select("node", (F.col("level") + 1).alias("level"), F.col("community").alias("child"))
    return a.join(b, ["node", "level"]).select("community", "child").distinct()


def top_interactions(strengths: DataFrame, k: int = 5) -> DataFrame:
    """The k strongest interactions of each community, all relationships summed up."""
    both = strengths.select("a", "b", "strength").union(strengths.select(F.col("b"), F.col("a"), "strength"))
    s = both.groupBy("a", "b").agg(F.sum("strength").alias("strength"))
    return s.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("strength"), "b"))).where(F.col("n") <= k).drop("n")


def infer_purpose(texts: DataFrame, groups: dict[str, list[str]], least: int = 2, default: str = "general") -> DataFrame:
    """``community, purpose``: the keyword group with most distinct hits in the names, earlier groups
    first on a tie, with at least ``least`` hits."""
    low = F.lower("text")
    hits = [F.struct(sum((low.contains(k).cast("int") for k in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(g).alias("g")) for i, (g, words) in enumerate(groups.items())]
    best = F.array_max(F.array(*hits))
    return texts.select("community", F.when(best["n"] >= least, best["g"]).otherwise(default).alias("purpose"))


def summarize_leaf(membership: DataFrame, edges: DataFrame, names: int = 10) -> DataFrame:
    """``community, summary``: size, composition by label and names of a community (``node, label, name``)."""
    by = membership.groupBy("community", "label").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("name")), 1, names).alias("names"))
    line = F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.array_join("names", ", "))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), line.alias("line"))))
    text = by.groupBy("community").agg(F.sum("n").alias("size"), F.array_join(F.transform(parts, lambda x: x["line"]), "; ").alias("body"))
    rels = internal_edges(edges, membership).groupBy("community").agg(F.array_join(F.array_sort(F.collect_set("rel")), ", ").alias("rels"))
    text = text.join(rels, "community", "left")
    return text.select("community", F.concat(F.lit("Community of "), F.col("size").cast("string"), F.lit(" members. "), "body", F.when(F.col("rels").isNotNull(), F.concat(F.lit(". Relationships: "), "rels")).otherwise("")).alias("summary"))


def summarize_parent(child_rows: DataFrame, summaries: DataFrame, strengths: DataFrame, k: int = 3) -> DataFrame:
    """``community, summary`` of a parent: its children's summaries and strongest interactions."""
    s = child_rows.join(summaries.select(F.col("community").alias("child"), "summary"), "child")
    s = s.groupBy("community").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("summary")), " ").alias("body"))
    t = top_interactions(strengths, k).groupBy(F.col("a").alias("community")).agg(F.array_join(F.array_sort(F.collect_list(F.col("b").cast("string"))), ", ").alias("others"))
    s = s.join(t, "community", "left")
    return s.select("community", F.concat(F.col("n").cast("string"), F.lit(" parts. "), "body", F.when(F.col("others").isNotNull(), F.concat(F.lit(" Works with: "), "others")).otherwise("")).alias("summary"))


def community_contexts(membership: DataFrame, edges: DataFrame, strengths: DataFrame, most_edges: int = 50) -> DataFrame:
    """``community, context``: members, internal edges, and interactions as one JSON text."""
    inner = internal_edges(edges, membership)
    inner = inner.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("src", "dst", "rel"))).where(F.col("n") <= most_edges)
    inner = inner.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "rel"))).alias("edges"))
    out = membership.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("members")).join(inner, "community", "left")
    top = top_interactions(strengths).groupBy(F.col("a").alias("community")).agg(F.array_sort(F.collect_list(F.struct("b", "strength"))).alias("interactions"))
    return out.join(top, "community", "left").select("community", F.to_json(F.struct("members", "edges", "interactions")).alias("context"))
