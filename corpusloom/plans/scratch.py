"""Tables that cut lineage between rounds, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a side of a join may have at most to be broadcast: rows, and bytes in their strings and arrays.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES, _BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def checked(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if a count finds it within the bounds; otherwise Spark shuffles both sides."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for c, kind in df.dtypes:
        value = F.col(f"`{c}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(value), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    n, total = df.select(size.alias("size")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most else df


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers by BATCH_BYTES in this session, unless a smaller bound is set."""
    if int(str(spark.conf.get(_BATCH_CONF, "67108864b")).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def cutter(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table there and reads it back."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    root = f"{named.rstrip('/')}/rounds-{uuid.uuid4().hex}"

    def cut(df: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return cut
