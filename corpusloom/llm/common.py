"""What the operators share: input views, tables cut from their lineage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: A side of a join is broadcast only if its rows and the bytes in them, counted before, are at most these.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Bytes of a batch that goes to a Python worker, and of what a worker remembers between rows.
BATCH_BYTES, MEMO_BYTES = 8 << 20, 12 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, *frames: DataFrame) -> str:
    """name, or the first name like it that no frame has."""
    used = {c.lower() for df in frames for c in df.columns}
    return next(n for n in (name + "_" * i for i in range(len(used) + 1)) if n.lower() not in used)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable, where a repeated expression would be evaluated again and again."""
    return F.transform(F.array(value), body)[0]


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8 bytes); a null text counts as empty, other columns are dropped before any shuffle."""
    return df.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"))


class Memo(dict):
    """A dictionary that forgets all it holds when that exceeds MEMO_BYTES, by the sizes that put() is told."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.size = most, 0

    def put(self, key, value, size: int):
        if self.size > self.most:
            self.clear()
            self.size = 0
        self.size += size
        self[key] = value
        return value


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python workers by BATCH_BYTES in this session, unless a smaller bound is set: with long
    texts, a worker would hold the default of 64 MB several times over."""
    if int(str(spark.conf.get(_BATCH_CONF, "67108864b")).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of this machine only where that is unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return _LOCAL[key]


class Scratch:
    """Tables written under the shared folder, which cut lineage: a lost executor costs no more than the tasks since.

    drop() deletes one as soon as nothing reads it any more; what a returned DataFrame still reads stays until
    the folder is cleared by its owner.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if a count finds its rows and the bytes of its columns within the bounds; otherwise Spark shuffles both sides."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for c, kind in df.dtypes:
        if kind == "string" or kind == "binary":
            size = size + F.coalesce(F.octet_length(col(c)), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(col(c)))), F.lit(0))
    n, total = df.select(size.alias("size")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most else df


def rows_of(batches: Iterable[pa.RecordBatch], *names: str, step: int = 500) -> Iterator[tuple]:
    """The rows of batches as tuples, step rows at a time, as Python's objects take a multiple of the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000, weight: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most size rows and about weight bytes."""
    held: list[tuple] = []
    grams = 0
    for row in rows:
        held.append(row)
        grams += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or grams >= weight:
            yield _batch(held, schema)
            held, grams = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
