"""Sinks: hash-ordered shards, decision ledgers, and immutable generations behind a pointer."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, order: str, rows: int = 20_000) -> None:
    """Shards of about rows rows, each sorted by a content hash, in ranges of it: stable for equal rows, written by all tasks."""
    n = df.count()
    df.repartitionByRange(max(1, -(-n // rows)), order).sortWithinPartitions(order).write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def shard_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, bytes, sha256) of each shard below path. Hashes are made by the tasks that read the files."""
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("rows"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    hashed = found.select(name(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return hashed.join(rows.select(name(F.col("p")).alias("path"), "rows"), "path", "left").select("path", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes", "sha256")


def write_labelled(df: DataFrame, path: str, label: str, allowed: list[str], *columns: str) -> None:
    """write_by columns and label, whose values must be among allowed."""
    bad = F.raise_error(F.concat(F.lit(f"unknown {label}: "), F.coalesce(F.col(label), F.lit("null")))).cast("string")
    write_by(df.withColumn(label, F.when(F.col(label).isin(allowed), F.col(label)).otherwise(bad)), path, *columns, label)


def write_decisions(scored: DataFrame, path: str, decision: str = "decision") -> None:
    """Rows by decision, as JSON lines: one folder each for accepted, quarantined and rejected ones."""
    scored.write.partitionBy(decision).json(path)


def report(rows: DataFrame, title: str, reason: str = "reason", text: str = "text", top: int = 20, examples: int = 10) -> str:
    """A short report in Markdown: the most frequent reasons, and the first rows by their text's hash as examples."""
    counts = rows.groupBy(reason).count().orderBy(F.desc("count"), reason).limit(top).collect()
    some = rows.select(reason, F.substring(F.regexp_replace(text, r"\s+", " "), 1, 240).alias("t"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("h")).orderBy("h", reason).limit(examples).collect()
    lines = [f"# {title}", "", "| Reason | Rows |", "|-|-|", *(f"| {r[reason]} | {r['count']} |" for r in counts), "", "## Examples", "", *(f"* {r[reason]}: {r.t}" for r in some)]
    return "\n".join(lines) + "\n"


def evidence_sheets(sheets: dict[str, DataFrame], path: str, columns: dict[str, list[str]]) -> dict[str, int]:
    """Writes each sheet as CSV with the columns it must have, and gives their rows; a missing column or an empty sheet is an error."""
    out = {}
    for name, df in sheets.items():
        if missing := set(columns.get(name, [])) - set(df.columns):
            raise ValueError(f"sheet {name} lacks {sorted(missing)}")
        df.write.option("header", "true").csv(f"{path}/{name}")
        out[name] = df.sparkSession.read.option("header", "true").csv(f"{path}/{name}").count()
        if not out[name]:
            raise ValueError(f"sheet {name} is empty")
    return out


def write_ledger(df: DataFrame, path: str) -> None:
    """Decisions by reason, as JSON lines."""
    df.write.partitionBy("reason").json(path)


def write_by(df: DataFrame, path: str, *columns: str) -> None:
    df.write.partitionBy(*columns).option("compression", "zstd").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(tables: dict[str, DataFrame], root: str, manifest: dict | None = None) -> str:
    """Writes tables as a new generation below root and then points CURRENT to it in one step; an empty table fails, the old generation stays, and
    a second writer at the same time is refused."""
    spark = next(iter(tables.values())).sparkSession
    name = f"generation-{uuid.uuid4().hex}"
    rows = {}
    with _writer_lock(spark, root):
        for key, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{root}/{name}/{key}")
            rows[key] = spark.read.parquet(f"{root}/{name}/{key}").count()
            if not rows[key]:
                raise ValueError(f"table {key} is empty; nothing is published")
        _write(spark, f"{root}/{name}/MANIFEST.json", json.dumps((manifest or {}) | {"rows": rows}, sort_keys=True))
        _write(spark, f"{root}/CURRENT.next", name)
        _replace(spark, f"{root}/CURRENT.next", f"{root}/CURRENT")
    return name


def publish_conversations(built: DataFrame, root: str, manifest: dict | None = None) -> str:
    """Publishes the rows of conversations.build as one generation: train and val, each ordered by its messages, and the quarantine; either split empty is an error."""
    rows = built.filter("reason is null").withColumn("_order", F.to_json("messages"))
    parts = {s: rows.filter(F.col("split") == s).orderBy("_order").select("conv_id", "messages", "group_id") for s in ("train", "val")}
    quarantine = built.filter("reason is not null").select("conv_id", "reason")
    return publish(parts | ({"quarantine": quarantine} if quarantine.limit(1).count() else {}), root, manifest)


@contextmanager
def _writer_lock(spark: SparkSession, root: str):
    """One writer at a time: the lock file is created, which fails if it is there. A writer that was killed leaves it; its owner removes it."""
    path, fs = _fs(spark, f"{root}/WRITER.lock")
    if not fs.createNewFile(path):
        raise OSError(f"another writer publishes to {root}")
    try:
        yield
    finally:
        fs.delete(path, False)


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another in one step, so that a reader finds the old one or the new one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else jvm.java.net.URI("file:///"), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(jvm.org.apache.hadoop.fs.Path(source), path, options)


def current(spark: SparkSession, root: str) -> str:
    return f"{root}/{spark.read.text(f'{root}/CURRENT').first()[0]}"


def _write(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def differing(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that only one side has, or with different values."""
    x, y = a.select(key, F.col(value).alias("left_value")), b.select(key, F.col(value).alias("right_value"))
    return x.join(y, key, "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both tables have the same rows, as often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
