"""Sources, sinks and user functions over the given tables: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import udf as H
from lodestone.plans.stages import shared_dir, table
from lodestone.sources import files as S

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def place(spark, name):
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def graph(spark, d):
    """Suppliers with a text, a number, a fraction and a list, and an edge with a text to each one's nation."""
    s = table(spark, d, "supplier")
    key = F.concat(F.lit("s"), "s_suppkey")
    nodes = s.select(key.alias("node_id"), F.concat(F.lit("Supplier:"), "s_name").alias("label"), F.concat(F.lit('a "b", '), "s_name", F.lit(" \\ c")).alias("about"), "s_nationkey", (F.col("s_nationkey") / 4 + 0.125).alias("share"), F.array(F.lit('x"y'), F.col("s_name")).alias("tags"))
    edges = s.select(key.alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("USES").alias("rel"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("note"))
    return nodes, edges


@query("s04_graph_csv_round_trip", """SELECT 's' || s_suppkey AS id, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, 'Supplier' AS label, s_name AS name, u.key, u.value, u.kind FROM supplier,
    LATERAL (SELECT unnest([{'key': 'about', 'value': 'a "b", ' || s_name || ' \\ c', 'kind': 'string'}, {'key': 's_nationkey', 'value': s_nationkey::VARCHAR, 'kind': 'int'}, {'key': 'share', 'value': (s_nationkey / 4 + 0.125)::DOUBLE::VARCHAR, 'kind': 'float'}, {'key': 'tags', 'value': '["x\\"y","' || s_name || '"]', 'kind': 'json'}]) AS u) t
    UNION ALL SELECT sha256('s' || s_suppkey || '|USES|n' || s_nationkey), 's' || s_suppkey, 'n' || s_nationkey, 'USES', NULL, 'note', s_name, 'string' FROM supplier WHERE s_suppkey % 2 = 0""")
def s04(spark, d):
    path = place(spark, "graph")
    S.write_graph_csv(*graph(spark, d), path)
    return S.read_graph_csv(spark, f"{path}/nodes").unionByName(S.read_graph_csv(spark, f"{path}/edges"))


@query("s12_jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def s12(spark, d):
    path = place(spark, "log")
    S.write_jsonl(table(spark, d, "conversations"), path)
    return S.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("s01_tree_scan", "SELECT 'part-' || (p_size % 3) || '.txt' AS name, count(*) AS lines FROM part GROUP BY 1")
def s01(spark, d):
    root = place(spark, "tree")
    for k in range(3):
        table(spark, d, "part").where(F.col("p_size") % 3 == k).select("p_name").coalesce(1).write.text(f"{root}/part-{k}")
    files = S.read_tree(spark, root, "*.txt").where("size > 0")
    name = F.concat(F.regexp_extract("path", r"(part-\d)/[^/]*$", 1), F.lit(".txt"))
    return files.groupBy(name.alias("name")).agg(F.sum(F.size(F.split("content", "\n")) - 1).cast("long").alias("lines"))


@query("h01_embed", "SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS letters, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', '')))::DOUBLE AS a FROM documents")
def h01(spark, d):
    docs = H.embed(table(spark, d, "documents"), lambda: lambda texts: [[float(len(t)), float(t.count("a"))] for t in texts])
    return docs.select("doc_id", F.col("vector")[0].cast("double").alias("letters"), F.col("vector")[1].cast("double").alias("a"))


SIZE = "CAST(split_part(a, chr(4), 1) AS INT)"


@query("h03_pack_chunks_function", f"""WITH s AS (SELECT doc_id AS id, string_split(coalesce(text, ''), '. ') AS s FROM documents),
    f AS (SELECT id, list_reduce(list_concat([length(s[1])::VARCHAR || chr(4) || s[1] || chr(1)], s[2:]), lambda a, x: CASE WHEN {SIZE} > 0 AND {SIZE} + length(x) > 3000 THEN length(x)::VARCHAR || chr(4) || x || chr(1) || substr(a, instr(a, chr(4)) + 1)
        ELSE ({SIZE} + length(x))::VARCHAR || chr(4) || substr(a, instr(a, chr(4)) + 1, instr(a, chr(1)) - instr(a, chr(4)) - 1) || chr(10) || x || substr(a, instr(a, chr(1))) END) AS a FROM s),
    c AS (SELECT id, list_reverse(string_split(substr(a, instr(a, chr(4)) + 1), chr(1))[:-2]) AS c FROM f)
    SELECT id, unnest(range(0, len(c)))::INT AS chunk, unnest(c) AS text FROM c""")
def h03(spark, d):
    H.register(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), r"\. ").alias("e"))
    return spark.sql("SELECT id, chunk, text FROM {docs}, LATERAL pack_chunks(e, 1500, 3000)", docs=docs)
