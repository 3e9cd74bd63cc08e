"""Joins of hits, files, nodes and edges, and the resolution of names to nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.stages import broadcast_if_small, materialise


def callers(edges: DataFrame, nodes: DataFrame, rel: str) -> DataFrame:
    """``target, caller, caller_name``: distinct edges of a relationship with the caller's name, if known."""
    e = edges.where(F.col("rel") == rel).select(F.col("dst").alias("target"), F.col("src").alias("caller"))
    return e.join(nodes.select(F.col("node_id").alias("caller"), F.col("name").alias("caller_name")), "caller", "left").select("target", "caller", "caller_name").distinct()


#: Files of a target from which it is a hub.
HUB = 1000


def related_files(edges: DataFrame, k: int, hub: int = HUB) -> DataFrame:
    """``file, other, shared``: the k files that share most targets with each file (``src, dst``), itself left out; ties to the smaller name.

    Files meet over targets of at most ``hub`` files, which makes at most ``hub`` pairs an edge. Those with the same hubs
    are one class; classes meet over hubs, and each class keeps the k + 1 first of the files that share most hubs with it, so a target of
    all files makes one class and no pairs. Exact: a file that no other target leads to can only be among
    the k if it is among these.
    """
    u = materialise(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "targets")
    hubs = broadcast_if_small(u.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("dst"))
    rare = u.join(hubs, "dst", "left_anti")
    pairs = rare.select("dst", F.col("src").alias("file")).join(rare.select("dst", F.col("src").alias("other")), "dst").where("file <> other").groupBy("file", "other").agg(F.count("*").alias("shared"))
    # a file's hubs are its class
    member = materialise(u.join(hubs, "dst", "left_semi").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("hubs")).select("src", "hubs", F.sha2(F.array_join("hubs", "\n"), 256).alias("cls")), "members")
    own = member.groupBy("cls").agg(F.first("hubs").alias("hubs")).select("cls", F.explode("hubs").alias("hub"))
    over = materialise(own.toDF("cls", "hub").join(own.toDF("to", "hub"), "hub").groupBy("cls", "to").agg(F.count("*").alias("overlap")), "classes")
    order = lambda key, score, name: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), name))
    first = member.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("src"))).where(F.col("n") <= k + 1).select(F.col("cls").alias("to"), F.col("src").alias("other"))
    best = over.join(first, "to").withColumn("n", order("cls", "overlap", "other")).where(F.col("n") <= k + 1).select("cls", "other", F.col("overlap").alias("shared"))
    mine = member.select("src", "cls")
    far = mine.withColumnRenamed("src", "file").join(broadcast_if_small(best), "cls").where("file <> other").select("file", "other", "shared")
    near = pairs.join(mine.toDF("file", "cls"), "file", "left").join(mine.toDF("other", "to"), "other", "left").join(broadcast_if_small(over), ["cls", "to"], "left")
    near = near.select("file", "other", (F.col("shared") + F.coalesce("overlap", F.lit(0))).alias("shared"))
    x = near.union(far).groupBy("file", "other").agg(F.max("shared").alias("shared"))
    return x.withColumn("n", order("file", "shared", "other")).where(F.col("n") <= k).drop("n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def lift_edges(edges: DataFrame, from_nodes: DataFrame, to_nodes: DataFrame) -> DataFrame:
    """Edges of ``from_nodes`` copied to the ``to_nodes`` of the same file: equal names, or one path
    ends with the other's (matched on the basename)."""
    a = from_nodes.select(F.col("node_id").alias("src"), F.col("path").alias("pa"), basename(F.col("path")).alias("base"))
    b = to_nodes.select(F.col("node_id").alias("to"), F.col("path").alias("pb"), basename(F.col("path")).alias("base"))
    same = a.join(b, "base").where(F.col("pa").endswith(F.concat(F.lit("/"), "pb")) | F.col("pb").endswith(F.concat(F.lit("/"), "pa")) | (F.col("pa") == F.col("pb")))
    return edges.join(same.select("src", "to"), "src").select(F.col("to").alias("src"), "dst", "rel").distinct()


def link_by_basename(tasks: DataFrame, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``task, script`` for tasks (``task, command``) whose command's basename ends a script's path,
    and the tasks without one."""
    t = tasks.select("task", F.regexp_replace(basename(F.col("command")), r"\s.*$", "").alias("base"))
    s = scripts.select(F.col("path").alias("script"), basename(F.col("path")).alias("base"))
    linked = t.join(s, "base").select("task", "script").distinct()
    return linked, t.join(linked, "task", "left_anti").select("task")


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n letters of a text that has at least as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))


def contained_in(short: DataFrame, long: DataFrame, n: int = 3) -> DataFrame:
    """``short, long``: every distinct pair of texts of which the second contains the first; see :func:`_contained`."""
    return _contained(short, long, n)[0]


def _contained(short: DataFrame, long: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """``short, long``, every distinct pair of texts of which the second contains the first, and the ``short`` that can be in a pair.

    A short text is looked up by one of its runs of n letters, the one that fewest of the long texts have; a text of
    fewer letters by itself. Long texts give only those runs that some short text is looked up by, and these before
    the shuffle while the keys are few. Null and empty texts are in none.
    """
    s = materialise(short.select("short").where("short <> ''").distinct(), "short")
    texts = long.select("long").where("long <> ''").distinct()
    texts, out, known = materialise(texts, "long"), None, s.limit(0)
    for size in sorted(r[0] for r in s.select(F.least(F.length("short"), F.lit(n))).distinct().collect()):  # n lengths at most
        own = s.where(F.length("short") == size) if size < n else s.where(F.length("short") >= n)
        of = own.select("short", F.explode(_grams(F.col("short"), size)).alias("gram"))
        runs = texts.where(F.length("long") >= size).select("long", F.explode(_grams(F.col("long"), size)).alias("gram"))
        seen = runs.join(broadcast_if_small(of.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        # a run that no long text has tells that there is no pair
        key = of.join(seen, "gram", "left").groupBy("short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key")).where("key.n > 0")
        key = materialise(key.select("short", "key.gram"), "keys")
        near = runs.join(broadcast_if_small(key.select("gram").distinct()), "gram", "left_semi").join(broadcast_if_small(key), "gram").where(F.contains("long", "short")).select("short", "long")
        out, known = near if out is None else out.union(near), known.union(key.select("short"))
    return out if out is not None else s.join(texts.limit(0), F.lit(False)).select("short", "long"), known


#: Mentions for each block of documents that a text is mentioned in.
BLOCK = 4096


def link_mentions(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """``doc, path``: documents whose mentions (``doc, mention``) are part of a file's path, anywhere in it."""
    m = materialise(mentions.select("doc", F.col("mention").alias("short")).where("short <> ''").distinct(), "mentions")
    pairs, known = _contained(m, files.select(F.col("path").alias("long")))
    # pairs of texts are distinct, so only documents of several mentions can have a path twice
    several = m.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    alone, rest = m.join(several, "doc", "left_anti"), m.join(several, "doc", "left_semi")
    if m.where("doc is null").isEmpty():
        blocks = m.count() // BLOCK + 1

        def linked(x: DataFrame) -> DataFrame:
            # a text's documents go in blocks, so what is broadcast grows with the texts, and a pair is read once for a block
            of = x.join(known, "short", "left_semi").groupBy("short", F.pmod(F.hash("doc"), F.lit(blocks)).alias("block")).agg(F.collect_list("doc").alias("docs"))
            return pairs.join(broadcast_if_small(of.select("short", "docs")), "short").select(F.explode("docs").alias("doc"), F.col("long").alias("path"))

        return linked(alone) if rest.isEmpty() else linked(alone).union(linked(rest).distinct())
    return m.join(pairs, "short").select("doc", F.col("long").alias("path")).distinct()


def resolve_executable(refs: DataFrame, programs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``ref, program, rule``: the first rule that gives a program for each reference.

    Rules in order: the known table (a null there means no match), the exact name, the name
    with ``_main``, a program that begins with the name and an underscore, a program that the
    name begins with, and ever shorter names without their last parts.
    """
    r = refs.select("ref").distinct()
    parts = F.split("ref", "_")
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - i, F.lit(1))), "_"))
    p = programs.select("program").distinct()
    begins = F.transform(F.sequence(F.lit(1), F.size(F.split("program", "_"))), lambda i: F.array_join(F.slice(F.split("program", "_"), 1, i), "_"))
    by_prefix = p.select("program", F.explode(begins).alias("key")).where("key <> program")
    exact = p.select("program", F.col("program").alias("key"))
    rules = [
        r.select("ref", F.col("ref").alias("key"), F.lit(1).alias("rule")).join(exact, "key"),
        r.select("ref", F.concat("ref", F.lit("_main")).alias("key"), F.lit(2).alias("rule")).join(exact, "key"),
        r.select("ref", F.col("ref").alias("key"), F.lit(3).alias("rule")).join(by_prefix, "key"),
        r.select("ref", F.explode(cuts).alias("key"), F.lit(4).alias("rule")).where("key <> ref").join(exact, "key"),
    ]
    found = reduce(DataFrame.unionByName, [x.select("ref", "program", "rule", F.length("key").alias("size")) for x in rules])
    if known is not None:
        k = known.select(F.col("ref"), F.col("program"))
        found = found.join(k, "ref", "left_anti").unionByName(r.join(k, "ref").select("ref", "program", F.lit(0).alias("rule"), F.lit(0).alias("size")))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("ref").orderBy("rule", F.desc("size"), "program")))
    return best.where("n = 1 and program is not null").select("ref", "program", "rule")


def resolve_configs(configs: DataFrame, bases: DataFrame) -> DataFrame:
    """``config, base``: configurations (``config, short``) and base configurations of the same short
    name; resource configurations are left out."""
    return configs.where(~F.col("short").startswith("config.resources")).join(bases.select(F.col("config").alias("base"), "short"), "short").select("config", "base")


def multi_collection(hits: dict[str, DataFrame]) -> DataFrame:
    """All collections' hits in one table, with the collection's name."""
    return reduce(DataFrame.unionByName, [df.withColumn("collection", F.lit(name)) for name, df in hits.items()])


def enrich_with_degree(hits: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """``source, degree``: summed degree of the nodes whose name or id a hit's source is; none, no row."""
    keys = [F.col(c) for c in ("name", "node_id", "path") if c in nodes.columns]
    alias = nodes.select("node_id", F.explode(F.array_distinct(F.array(*keys))).alias("source")).join(hits.select("source").distinct(), "source", "left_semi")
    return alias.join(degrees.select(F.col("node").alias("node_id"), "degree"), "node_id").groupBy("source").agg(F.sum("degree").alias("degree"))


def augment_hits(hits: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """``anchor, neighbours``: up to ``limit`` typed neighbours of each hit, as sorted text."""
    x = hits.select("anchor").join(edges, F.expr("anchor = src"))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy("rel", "dst"))).where(F.col("n") <= limit)
    return x.groupBy("anchor").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rel", "dst"))), ",").alias("neighbours"))


def hybrid_query(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """``file, imports, functions, classes, callers`` of each hit's file; callers of its first three functions."""

    def names(rel: str, out: str) -> DataFrame:
        return edges.where(F.col("rel") == rel).groupBy(F.col("src").alias("file")).agg(F.array_sort(F.collect_set("dst")).alias(out))

    out = hits.select("file").distinct()
    for rel, name in (("IMPORTS", "imports"), ("DEFINES", "functions"), ("DEFINES_CLASS", "classes")):
        out = out.join(names(rel, name), "file", "left")
    first = out.select("file", F.explode(F.slice("functions", 1, 3)).alias("fn"))
    calls = first.join(edges.where("rel = 'CALLS'").select(F.col("dst").alias("fn"), "src"), "fn").groupBy("file").agg(F.array_sort(F.collect_set("src")).alias("callers"))
    return out.join(calls, "file", "left")


def enrich_identifiers(ids: DataFrame, hits: DataFrame, most: int = 15, letters: int = 500) -> DataFrame:
    """``key, id, content, score``: the best hit of each of the first identifiers, its content cut."""
    first = ids.select("key").distinct().orderBy("key").limit(most)
    x = hits.join(F.broadcast(first), "key")  # as many rows as ``most``
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where("n = 1")
    return x.select("key", "id", F.left("content", F.lit(letters)).alias("content"), "score")


def resolve_references(docs: DataFrame) -> DataFrame:
    """Rows (``id, content, canonical_id``) with the content of the row that they point at."""
    target = docs.where("canonical_id is null").select(F.col("id").alias("canonical_id"), F.col("content").alias("canonical"))
    return docs.join(target, "canonical_id", "left").select("id", "canonical_id", F.coalesce("content", "canonical").alias("content"))


def compare_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``key, left_n, right_n, equal`` of two systems' counts (``key, n``); a missing side is null."""
    out = a.select("key", F.col("n").alias("left_n")).join(b.select("key", F.col("n").alias("right_n")), "key", "full")
    return out.withColumn("equal", F.col("left_n").eqNullSafe(F.col("right_n")))


def link_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk_id, node_id``: chunks (``chunk_id, path, name``) to the file, or the named node in it."""
    file = chunks.where("name is null").join(nodes.where("name is null"), "path").select("chunk_id", "node_id")
    named = chunks.where("name is not null").join(nodes.where("name is not null"), ["path", "name"]).select("chunk_id", "node_id")
    return file.union(named)


def resolve_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """``name, files, decision, reason`` of sources (``name, root, least, pin, commit, dirty``).

    A file belongs to the source whose root is one of its ancestors. The first failing rule
    is the reason to crawl again: missing, empty, below_minimum, off_pin, dirty.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    n = files.select(F.explode(above).alias("root")).join(broadcast_if_small(sources.select("root")), "root").groupBy("root").agg(F.count("*").alias("files"))
    out = sources.join(n, "root", "left")
    reason = F.when(F.col("root").isNull(), "missing").when(F.coalesce("files", F.lit(0)) == 0, "empty").when(F.col("files") < F.col("least"), "below_minimum")
    reason = reason.when(F.col("pin").isNotNull() & ~F.col("pin").eqNullSafe(F.col("commit")), "off_pin").when(F.col("dirty"), "dirty")
    out = out.withColumn("reason", reason)
    return out.select("name", F.coalesce("files", F.lit(0)).alias("files"), F.when(F.col("reason").isNull(), "disk").otherwise("needs_crawl").alias("decision"), "reason")
