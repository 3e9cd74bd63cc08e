"""Streams give what their batch forms give."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.streaming import streams as L

SCHEMA = "source string, ts timestamp, value double"


@pytest.fixture
def stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 10.0), ("a", "2024-01-01 00:10:00", 10.5), ("a", "2024-01-01 03:00:00", 20.0), ("b", "2024-01-01 00:05:00", 1.0), ("z", "2024-01-03 00:00:00", 1.0), ("z", "2024-01-05 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "source string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    return df, lambda: spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_and_sessions(spark, stream, tmp_path, rows):
    batch, read = stream
    got = rows(run(L.windowed_counts(read(), ["source"], "ts"), "win", tmp_path))
    want = rows(L.windowed_counts(batch, ["source"], "ts", late=None))
    assert got and set(got) <= set(want) and {r for r in want if r[0] != "z"} <= set(got)
    got = rows(run(L.session_rollup(read(), "source", "ts"), "ses", tmp_path))
    want = rows(L.session_rollup(batch, "source", "ts", late=None))
    assert got and {r for r in want if r[0] != "z"} <= set(got) <= set(want)


def test_jumps(spark, stream, tmp_path):
    got = run(L.jumps(stream[1](), "source", "ts", "value"), "jump", tmp_path).collect()
    assert [(r.source, r.previous, r.value) for r in got] == [("a", 10.5, 20.0)]


def test_jumps_of_rows_out_of_order(spark, tmp_path):
    """Rows of three micro-batches in any order give what the batch form gives; idle sources leave the state."""
    from lodestone.operators.ranking import jump_anomalies

    at = lambda m: f"2024-01-01 {m // 60:02}:{m % 60:02}:00"
    batches = [[("a", 40, 10.0), ("a", 0, 20.0), ("b", 5, 1.0)], [("a", 20, 10.5), ("a", 41, 30.0), ("b", 3, 4.0), ("b", 50, None)], [("z", 600, 1.0), ("a", 601, 30.5)], [("z", 900, 1.0)]]
    rows = [(s, at(m), v) for b in batches for s, m, v in b]
    (tmp_path / "in").mkdir()
    df = L.jumps(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), "source", "ts", "value", late="60 minutes", idle_minutes=120)
    q = df.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, b in enumerate(batches):
            pd.DataFrame([(s, at(m), v) for s, m, v in b], columns=["source", "ts", "value"]).to_json(tmp_path / f"{i}.json", orient="records", lines=True)
            (tmp_path / f"{i}.json").rename(tmp_path / f"in/{i}.json")
            q.processAllAvailable()
        left = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) for p in q.recentProgress) if p["stateOperators"]]
    finally:
        q.stop()
    got = sorted((r.source, str(r.ts), r.previous, r.value) for r in spark.table("late").collect())
    given = spark.createDataFrame(rows, "source string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).where("value is not null and ts < '2024-01-01 09:00:00'")
    want = sorted((r.source, str(r.ts), r.previous, r.value) for r in jump_anomalies(given, "source", "ts", "value", "value").collect())
    assert got == want and len(got) == 3
    assert left[-1] < max(left)


def test_fresh_documents_and_upsert(spark, tmp_path, rows):
    pd.DataFrame({"doc_id": [1, 1, 2], "text": ["a", "a", "b"], "ts": ["2024-01-01T00:00:00"] * 3}).to_json(tmp_path / "d.json", orient="records", lines=True)
    (tmp_path / "src").mkdir()
    (tmp_path / "d.json").rename(tmp_path / "src/d.json")
    read = spark.readStream.schema("doc_id long, text string, ts timestamp").json(str(tmp_path / "src"))
    assert sorted(r.doc_id for r in run(L.fresh_documents(read), "fresh", tmp_path).collect()) == [1, 2]
    q = read.writeStream.foreachBatch(L.upsert_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert L.current(spark, str(tmp_path / "out")).count() == 2


def test_upserts_leave_other_partitions_alone(spark, tmp_path):
    path, schema = str(tmp_path / "target"), "doc_id long, text string, ts long"
    write = L.upsert_batch(path, parts=8)
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "target").rglob("*.parquet")}
    write(spark.createDataFrame([(i, "a", 0) for i in range(100)] + [(None, "n", 0)], schema), 0)
    before = files()
    second = spark.createDataFrame([(5, "b", 1), (5, "c", 2), (200, "d", 1)], schema)
    write(second, 1)
    after = files()
    assert before.items() <= after.items()
    new = [p for p in after if p not in before and "/data/" in p]
    assert 1 <= len(new) <= 2 and all("version=1" in p for p in new)  # the two keys' partitions
    got = {r.doc_id: r.text for r in L.current(spark, path).collect()}
    assert got == {i: "a" for i in range(100)} | {None: "n", 5: "c", 200: "d"}
    write(second, 1)
    assert files() == after
    # data of an epoch whose manifest was never finished is written anew
    (tmp_path / "target/manifest/epoch=1/_SUCCESS").unlink()
    write(second, 1)
    assert {r.doc_id: r.text for r in L.current(spark, path).collect()} == got
