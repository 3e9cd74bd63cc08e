"""Structured Streaming forms of the append-only logs, and their batch equivalents.

The streaming functions take a streaming DataFrame with an event time and return one;
late rows fall to the watermark.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.writes import upsert_documents
from lodestone.plans.stages import materialise


def fresh_documents(docs: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Documents whose id and content hash did not arrive within the watermark before."""
    x = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark(ts, late)
    return x.dropDuplicatesWithinWatermark(["doc_id", "digest"])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs whose manifests are finished, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [p.getPath().getName() for p in files.listStatus(at)] if files.exists(at) else []
    return sorted(e for e in (int(n.split("=")[1]) for n in found if "=" in n) if _exists(spark, f"{path}/manifest/epoch={e}/_SUCCESS"))


def _places(spark: SparkSession, path: str, epoch: int | None) -> dict[int, int]:
    """For each part the epoch that wrote it last, by one manifest; as many entries as there are parts."""
    return {} if epoch is None else {r["part"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/epoch={epoch}").collect()}


def current(spark: SparkSession, path: str) -> DataFrame:
    """The target of :func:`upsert_batch` as its last finished manifest has it."""
    epoch = _epochs(spark, path)[-1]
    return spark.read.parquet(*(f"{path}/data/version={v}/part={p}" for p, v in sorted(_places(spark, path, epoch).items())))


def upsert_batch(path: str, key: str = "doc_id", order: str = "ts", parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that upserts each batch into a target of ``parts`` key-hash partitions below ``path``.

    Only partitions that some key of the batch falls into are read, merged and written, into folders of the epoch; a
    manifest, written last, names for each partition the epoch that holds it. Files of other partitions stay as they are. An
    epoch whose manifest is there is not written again, so a repeated batch changes nothing, and one that was
    lost on the way is written anew. :func:`current` reads the target. Null keys share a partition and are never equal.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = _epochs(spark, path)
        if epoch in done:
            return
        batch = materialise(batch.withColumn("part", F.coalesce(F.pmod(F.xxhash64(key), F.lit(parts)), F.lit(0)).cast("int")), "batch")
        places = _places(spark, path, max((e for e in done if e < epoch), default=None))
        touched = sorted(r["part"] for r in batch.select("part").distinct().collect())  # at most ``parts``
        old = [f"{path}/data/version={places[p]}/part={p}" for p in touched if p in places]
        target = spark.read.schema(batch.schema).option("basePath", f"{path}/data").parquet(*old).select(batch.columns) if old else batch.limit(0)
        merged = upsert_documents(target, batch, key, order)
        merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/version={epoch}")
        new = [(p, epoch if p in touched else places[p]) for p in sorted({*places, *touched})]
        spark.createDataFrame(new, "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch}")

    return write


class _Jumps(StatefulProcessor):
    """A source's rows, held back until the watermark has passed them, then compared in the order of their times."""

    def __init__(self, ts: str, value: str, share: float, idle: int):
        self.ts, self.value, self.share, self.idle = ts, value, share, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, value double")
        self.last = handle.getValueState("last", "at long, value double")

    def handleInputRows(self, key, rows, timerValues):
        held = pd.concat([part[[self.ts, self.value]] for part in rows]).dropna()
        at = held[self.ts].astype("datetime64[us]").astype("int64")
        if len(held):
            self.waiting.appendList(list(zip(at.tolist(), held[self.value].astype(float).tolist(), strict=True)))
            self._wake(int(at.min()) // 1000)
        return iter(())

    def _wake(self, ms: int) -> None:
        """One timer a source: at its earliest row that waits, or when it counts as idle."""
        for old in list(self.handle.listTimers()):
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, value in ready:
            if last is not None and last[1] > 0 and abs(value - last[1]) / last[1] > self.share:
                out.append((str(key[0]), pd.Timestamp(at, unit="us"), last[1], value, abs(value - last[1]) / last[1]))
            last = at, value
        if ready:
            self.last.update(last)
            self.waiting.put(rest) if rest else self.waiting.clear()
        fire = rest[0][0] // 1000 if rest else last[0] // 1000 + self.idle if last else 0
        if rest or (last and fire * 1000 > mark):
            self.handle.registerTimer(fire)
        else:
            self.last.clear()  # idle: nothing of the source is kept
        yield pd.DataFrame(out, columns=["source", "ts", "previous", "value", "jump"])

    def close(self) -> None:
        pass


def jumps(rows: DataFrame, source: str, ts: str, value: str, share: float = 0.10, late: str = "10 minutes", idle_minutes: int = 60 * 24 * 7) -> DataFrame:
    """``source, ts, previous, value, jump``: values that differ from the source's last one, by event time, by more than a share.

    Rows wait in the state until the watermark has passed them, and are then compared in the order of their times (of one
    time by value), however they were spread over micro-batches; later rows are dropped. A source without
    rows for ``idle_minutes`` leaves the state, and its next row counts as its first. Rows without a time or value are left out.
    Needs the RocksDB state store, which is set for the session.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = rows.select(F.col(source).cast("string").alias("source"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)
    step = _Jumps("ts", "value", share, idle_minutes * 60_000)
    return x.groupBy("source").transformWithStateInPandas(step, "source string, ts timestamp, previous double, value double, jump double", "append", "eventTime")


def session_rollup(events: DataFrame, key: str, ts: str, gap: str = "60 minutes", late: str | None = "10 minutes", event: str | None = None, terminal: dict[str, str] | None = None) -> DataFrame:
    """``key, first_ts, last_ts, events``: sessions that a pause of ``gap`` closes; ``late`` None: a batch.

    With ``event``, a column, there is a ``status`` too: that of the session's first terminal event
    (``terminal``: status by event), in_progress if it has none.
    """
    x = events.withWatermark(ts, late) if late else events
    more = []
    if event:
        known = terminal or {"completed": "completed", "abandoned": "abandoned"}
        status = reduce(lambda c, kv: c.when(F.col(event) == kv[0], F.lit(kv[1])), known.items(), F.when(F.lit(False), F.lit("")))
        more = [F.coalesce(F.min(F.when(F.col(event).isin(list(known)), F.struct(F.col(ts).alias("at"), status.alias("status"))))["status"], F.lit("in_progress")).alias("status")]
    # a session window ends a gap after its last event
    out = x.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"), *more)
    return out.drop("w")


def windowed_counts(events: DataFrame, keys: list[str], ts: str, window: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """``keys, start, n``: rows in tumbling windows; ``late`` None: a batch."""
    x = events.withWatermark(ts, late) if late else events
    out = x.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), "n")


def compact(events: DataFrame, session: str, ts: str, now: str, days: int, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Events that stay (recent, or of a session with a checkpoint event), and a summary of each session
    that goes."""
    old = F.col(ts) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    kept = events.where(F.col("event") == checkpoint).select(session).distinct()
    gone = events.where(old).join(kept, session, "left_anti")
    stay = events.where(~old).unionByName(events.where(old).join(kept, session, "left_semi"))
    return stay, gone.groupBy(session).agg(F.count("*").alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def search_log(tables: dict[str, DataFrame], text: str, ts: str, rows: int, most_bytes: int) -> DataFrame:
    """``kind, ts, body``: records of any kind that hold the text, newest first, within caps of rows and bytes."""
    x = reduce(DataFrame.union, [df.select(F.lit(k).alias("kind"), F.col(ts).alias("ts"), F.to_json(F.struct(*df.columns)).alias("body")) for k, df in tables.items()])
    x = x.where(F.contains(F.lower("body"), F.lit(text.lower()))).orderBy(F.desc("ts"), "kind", "body").limit(rows)
    # a window over at most ``rows`` rows
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("ts"), "kind", "body").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("used", F.sum(F.octet_length("body")).over(w)).where(F.col("used") <= most_bytes).drop("used")
