"""File sources and sinks: trees, JSON lines, graph exchange files and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a string property, and the mark where it was cut.
MOST, MARK = 8000, "... [TRUNCATED]"


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, content, modified, size`` of every file below a root, but for version control's own."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return x.where(~F.col("path").contains("/.git/")).select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def read_jsonl(spark: SparkSession, path: str, schema: str, ts: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a JSON-lines log; lines that are no JSON go; the last ``limit`` by time."""
    x = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    x = x.where("_corrupt_record is null").drop("_corrupt_record")
    return x.orderBy(F.desc(ts)).limit(limit) if ts and limit else x


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_graph_csv(spark: SparkSession, path: str) -> DataFrame:
    """``id, src, dst, label, name, key, value, kind`` of a graph exchange file: one row for each
    property, typed as json, int, float or string; empty ones go, long ones are cut."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    own = {"~id", "~from", "~to", "~label"}
    props = [c for c in raw.columns if c not in own]
    get = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in props))) if props else F.explode(F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value"))))
    label = get("~label")
    x = raw.select(get("~id").alias("id"), get("~from").alias("src"), get("~to").alias("dst"), F.when(label.contains(":"), F.split_part(label, F.lit(":"), F.lit(1))).otherwise(F.coalesce(label, F.lit("Node"))).alias("label"), F.when(label.contains(":"), F.regexp_extract(label, r":(.*)$", 1)).alias("name"), pairs.alias("p"))
    x = x.select("id", "src", "dst", "label", "name", "p.key", "p.value").where("value is not null and value <> ''")
    value = F.when(F.length("value") > MOST, F.concat(F.left("value", F.lit(MOST)), F.lit(MARK))).otherwise(F.col("value"))
    is_list = F.col("value").startswith("[") & F.try_parse_json("value").isNotNull()
    kind = F.when(is_list, "json").when(F.col("value").try_cast("long").isNotNull() & F.col("value").rlike(r"^-?\d+$"), "int").when(F.col("value").try_cast("double").isNotNull(), "float").otherwise("string")
    return x.withColumn("kind", kind).withColumn("value", value)


def write_graph_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as graph exchange files below ``path``; arrays and maps as JSON."""

    def flat(df: DataFrame, keep: list[str]) -> list:
        return [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes if c not in keep]

    nodes.select(F.col("node_id").alias("~id"), F.col("label").alias("~label"), *flat(nodes, ["node_id", "label"])).write.mode("overwrite").option("header", True).option("escape", "\"").csv(f"{path}/nodes")
    edges.select(F.sha2(F.concat_ws("|", "src", "rel", "dst"), 256).alias("~id"), F.col("src").alias("~from"), F.col("dst").alias("~to"), F.col("rel").alias("~label"), *flat(edges, ["src", "dst", "rel"])).write.mode("overwrite").option("header", True).option("escape", "\"").csv(f"{path}/edges")


MANIFEST = "sources array<struct<name string, source_type string, collection_target string, embedding_profile string, enabled boolean, scope string, last_ingested string, doc_count long, type_fields map<string,string>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each source of a manifest; sources are enabled unless they say otherwise."""
    x = spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.inline("sources"))
    return x.withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def select_sources(df: DataFrame, source_type: str | None = None, enabled_only: bool = True) -> DataFrame:
    """Sources of a type, the enabled ones only if wanted."""
    x = df.where("enabled") if enabled_only else df
    return x if source_type is None else x.where(F.col("source_type") == source_type)


def manifest_violations(df: DataFrame, profiles: list[str], collections: list[str], required: dict[str, list[str]], scopes: list[str]) -> DataFrame:
    """``name, violation``: repeated names, unknown profiles and collections, missing fields, illegal scopes."""
    twice = df.groupBy("name").count().where("count > 1").select("name", F.lit("duplicate_name").alias("violation"))
    bad = lambda col, ok, v: df.where(F.col(col).isNull() | ~F.col(col).isin(ok)).select("name", F.lit(v))
    need = F.lit(None).cast("array<string>")
    for k, v in required.items():
        need = F.when(F.col("source_type") == k, F.array(*map(F.lit, v))).otherwise(need)
    missing = df.select("name", F.explode(F.array_except(need, F.coalesce(F.map_keys("type_fields"), F.array().cast("array<string>")))).alias("f")).select("name", F.concat(F.lit("missing_"), "f"))
    return twice.union(bad("embedding_profile", profiles, "unknown_profile")).union(bad("collection_target", collections, "unknown_collection")).union(missing).union(bad("scope", scopes, "illegal_scope"))
