"""Stage boundaries: reading tables, cutting lineage into shared storage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes up to which a side may be broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, for narrow rows that much work follows: one small file would give one task."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session that names none (tests) gets a temporary folder, which is set, so that all of its
    stages use the same one. On a cluster that would be each machine's own, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage, survives the loss of executors, and later uses do
    not compute it again.
    """
    spark = df.sparkSession
    # below the application's own folder, which can go once it has ended
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(df: DataFrame) -> Column:
    """A row's size: the bytes of text and binary columns, eight for a number, an array's elements times eight."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map")):
            size = size + (F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) if "string" in kind else F.greatest(F.size(c), F.lit(0)) * 8)
        else:
            size = size + 8
    return size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes; reads no more than that many rows plus one."""
    n, b = df.limit(rows + 1).agg(F.count("*"), F.sum(_bytes(df))).first()
    return n <= rows and (b or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows and bytes allow it, else ``df`` as it is."""
    return F.broadcast(df) if small(df, rows, size) else df
