"""Evidence over published tables: inventories, containment, accounting of parent and child, cross-split groups."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import leakage
from corpusloom.sources.sinks import differing, shard_ledger


def source_accounting(seen: DataFrame, quarantined: DataFrame, final: DataFrame) -> DataFrame:
    """For each source: rows seen, quarantined and final, and whether they add up."""
    parts = [d.groupBy("source").agg(F.count("*").alias(n)) for d, n in ((seen, "seen"), (quarantined, "quarantined"), (final, "final"))]
    out = parts[0].join(parts[1], "source", "full_outer").join(parts[2], "source", "full_outer").fillna(0, ["seen", "quarantined", "final"])
    return out.withColumn("balanced", F.col("seen") == F.col("quarantined") + F.col("final"))


def cross_split(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split: an empty table is the invariant."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits")).filter("splits > 1").select(key)


def not_contained(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of the child whose key the parent doesn't have."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def inventory_faults(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that only one side lists, or with another hash; both have path and sha256."""
    return differing(found, manifest, "path", "sha256")


def enlarged(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(split, source) groups of the child with more rows or characters than the parent's: an empty table is the invariant."""
    size = lambda d, n: d.groupBy("split", "source").agg(F.count("*").alias(f"{n}_rows"), F.sum("chars").alias(f"{n}_chars"))
    both = size(child, "child").join(size(parent, "parent"), ["split", "source"], "left").fillna(0, ["parent_rows", "parent_chars"])
    return both.filter("child_rows > parent_rows or child_chars > parent_chars")


def label_counts(df: DataFrame, label: str, expected: dict) -> DataFrame:
    """Labels whose number isn't the expected one."""
    want = df.sparkSession.createDataFrame([(str(k), int(v)) for k, v in expected.items()], "label string, expected long")
    got = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("found"))
    return got.join(want, "label", "full_outer").filter(~F.col("found").eqNullSafe(F.col("expected")))


def split_by_shares(df: DataFrame, order, shares: dict[str, float]) -> DataFrame:
    """df with split by ranges of a hash: each part's share of the hash space."""
    place = F.conv(F.substring(F.sha2(order, 256), 1, 13), 16, 10).cast("long") / float(16**13)
    out, at = None, 0.0
    for name, share in list(shares.items())[:-1]:
        at += share
        out = F.when(place < at, name) if out is None else out.when(place < at, name)
    last = list(shares)[-1]
    return df.withColumn("split", out.otherwise(last) if out is not None else F.lit(last))


def usability(lines: DataFrame, excluded: list[str]) -> DataFrame:
    """By input file of JSON lines (text, meta, problem): rows, usable ones, their characters, rows of excluded sources, and rows with replacement characters."""
    bad = F.col("meta")["source"].isin(excluded) if excluded else F.lit(False)
    t = F.coalesce("text", F.lit(""))
    usable = F.col("problem").isNull() & ~F.coalesce(bad, F.lit(False))
    return lines.groupBy("input_file").agg(
        F.count("*").alias("rows"), F.count(F.when(usable, 1)).alias("usable"), F.sum(F.when(usable, F.length(t)).otherwise(0)).cast("long").alias("chars"),
        F.count(F.when(bad, 1)).alias("excluded"), F.count(F.when(t.contains("\ufffd"), 1)).alias("replacement_rows"),
    )


def fingerprint(files: DataFrame) -> str:
    """One digest of an inventory (path, sha256): of its sorted entries, so by content and names alone."""
    row = files.select(F.sha2(F.concat_ws("\0", "path", "sha256"), 256).alias("h")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256)).first()
    return row[0]


def unbound(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): files found that no manifest lists, and listed ones that aren't there. Both have path."""
    a = found.select("path").distinct().join(listed.select("path"), "path", "left_anti").withColumn("problem", F.lit("unbound"))
    return a.unionByName(listed.select("path").distinct().join(found.select("path"), "path", "left_anti").withColumn("problem", F.lit("missing")))


def leak_audit(parts: dict[str, DataFrame], prompts: DataFrame, prompt_id: str = "item_id") -> DataFrame:
    """(part, documents, hits) for each named part (doc_id, text): documents that hold a prompt. A part without documents is an error, since nothing was checked."""
    out = None
    for name, df in parts.items():
        if not df.limit(1).count():
            raise ValueError(f"part {name} is empty: nothing to audit")
        hits = leakage.prompt_hits(df, prompts, "doc_id", prompt_id).agg(F.countDistinct("id").alias("hits"))  # one row
        one = df.agg(F.count("*").alias("documents")).join(F.broadcast(hits)).select(F.lit(name).alias("part"), "documents", "hits")
        out = one if out is None else out.unionByName(one)
    return out


def full_scan_faults(evidence: dict) -> list[str]:
    """What a full scan's evidence lacks. evidence: splits {split: {rows, chars, sources}}, files and fingerprint, checks {name: {status, rows, remaining}},
    required (names of checks), mixture {name: {chars, cap}}, accounting {seen, quarantined, final}."""
    faults, splits = [], evidence.get("splits", {})
    rows = sum(s["rows"] for s in splits.values())
    faults += [f"empty split: {k}" for k in ("train", "val") if splits.get(k, {}).get("rows", 0) <= 0]
    faults += [f"sources don't add up: {k}" for k, s in splits.items() if sum(x["rows"] for x in s["sources"].values()) != s["rows"] or sum(x["chars"] for x in s["sources"].values()) != s["chars"]]
    for name in evidence.get("required", []):
        check = evidence.get("checks", {}).get(name)
        if check is None or check.get("status") != "PASS":
            faults.append(f"check didn't pass: {name}")
        elif check.get("rows") != rows:
            faults.append(f"check doesn't cover every row: {name}")
        elif check.get("remaining", 0) != 0:
            faults.append(f"check left hits: {name}")
    total = sum(s["chars"] for s in splits.values())
    faults += [f"cap exceeded: {k}" for k, m in evidence.get("mixture", {}).items() if not 0 <= m["chars"] <= total or m["chars"] / max(total, 1) > m["cap"] + 1e-12]
    a = evidence.get("accounting", {})
    if a.get("seen") != a.get("quarantined", 0) + a.get("final", 0) or a.get("final") != rows:
        faults.append("rows don't add up")
    listed = hashlib.sha256("".join(sorted(f"{f['path']}\0{f['sha256']}\n" for f in evidence.get("files", []))).encode()).hexdigest()
    if evidence.get("fingerprint") != listed:
        faults.append("the inventory isn't the fingerprinted one")
    return faults


def subset_faults(parent: dict, child: dict) -> list[str]:
    """What makes child's evidence no strict subset of parent's: a parent with faults, another required check, an enlarged or new source, rows that don't add up with the removed ones."""
    faults = [f"parent: {f}" for f in full_scan_faults(parent)] + full_scan_faults(child | {"required": []})
    if child.get("required") != parent.get("required"):
        faults.append("inherited checks changed")
    removed = child.get("removed", {})
    for split, new in child.get("splits", {}).items():
        old = parent.get("splits", {}).get(split, {"rows": 0, "sources": {}})
        for name, stats in new["sources"].items():
            if name not in old["sources"] or any(stats[k] > old["sources"][name][k] for k in ("rows", "chars")):
                faults.append(f"source enlarged: {split}/{name}")
        if old["rows"] != new["rows"] + removed.get(split, 0) or removed.get(split, 0) < 0:
            faults.append(f"removed rows don't add up: {split}")
    return faults


def run_manifest(name: str, phase: str, config: dict, splits: dict[str, list[dict]], tokenizer: dict, checkpoints: list[dict] | None = None) -> dict:
    """A training run's manifest: its name, settings, the files of each split, its tokenizer and checkpoints, each file as path, bytes and sha256."""
    record = {"schema": 1, "name": name, "phase": phase, "config": config, "splits": splits, "tokenizer": tokenizer, "checkpoints": checkpoints or [], "status": "RECORDED" if checkpoints else "PREPARED"}
    if faults := manifest_faults(record):
        raise ValueError("; ".join(faults))
    return record


def manifest_faults(record: dict, found: dict[str, dict] | None = None, checkpoint: bool = False) -> list[str]:
    """What is wrong with a run's manifest; with found (path: {bytes, sha256}), also files that are missing or changed."""
    faults = []
    if record.get("schema") != 1:
        return ["unknown schema"]
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", str(record.get("name", ""))):
        faults.append("the name must be one safe name")
    if record.get("phase") not in ("base", "sft", "rl"):
        faults.append("unknown phase")
    if not isinstance(record.get("config"), dict) or not record["config"]:
        faults.append("no settings")
    splits = record.get("splits", {})
    if set(splits) != {"train", "val"} or not all(splits.values()):
        faults.append("both splits need files")
    entries = [f for part in splits.values() for f in part]
    if len({f["path"] for f in entries}) != len(entries):
        faults.append("a file is listed twice")
    if checkpoint and not record.get("checkpoints"):
        faults.append("no checkpoint is bound to the run")
    if record.get("status") != ("RECORDED" if record.get("checkpoints") else "PREPARED"):
        faults.append("the status doesn't fit the checkpoints")
    for f in [*entries, record.get("tokenizer") or {}, *record.get("checkpoints", [])]:
        if not {"path", "bytes", "sha256"} <= set(f):
            faults.append("an entry lacks path, bytes or sha256")
        elif found is not None and found.get(f["path"]) != {"bytes": f["bytes"], "sha256": f["sha256"]}:
            faults.append(f"changed or missing: {f['path']}")
    json.dumps(record, allow_nan=False)
    return faults


def path_faults(inputs: list[str], outputs: list[str]) -> list[str]:
    """Outputs that are an input or lie within one, or the other way round, and outputs named twice: writing there would change what is read."""
    plain = lambda p: PurePosixPath("/" + p.removeprefix("file:").lstrip("/"))
    faults = [f"named twice: {o}" for o in outputs if outputs.count(o) > 1]
    for i in inputs:
        for o in outputs:
            a, b = plain(i), plain(o)
            if a == b or a in b.parents or b in a.parents:
                faults.append(f"{o} overlaps {i}")
    return sorted(set(faults))


def stream_digest(df: DataFrame, order: list[str]) -> str:
    """A digest of the rows of df in order, whatever their partitions: each row's hash with its place, added up. Equal streams have equal digests."""
    columns = sorted(df.columns)
    ranged = df.repartitionByRange(64, *order).withColumn("_b", F.spark_partition_id())
    totals = ranged.groupBy("_b").agg(F.count("*").alias("_t"))
    shift = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.col("_o") + F.row_number().over(W.partitionBy("_b").orderBy(*order))
    row = F.sha2(F.to_json(F.struct(place.alias("_place"), *columns)), 256)
    halves = [F.sum(F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(38,0)")).cast("string") for a in (1, 16, 31, 46)]
    found = ranged.join(F.broadcast(shift), "_b").select(row.alias("h")).agg(F.count("*").cast("string"), *halves).first()
    return hashlib.sha256("|".join(str(x) for x in found).encode()).hexdigest()


def subset_proof(parent: DataFrame, child: DataFrame, ledger: DataFrame, key: str, order: list[str]) -> dict:
    """Rows of parent, child and ledger, and whether child is parent without the ledger's keys: the same whole rows in the same order."""
    kept = parent.join(ledger.select(key).distinct(), key, "left_anti").select(*parent.columns)
    counts = {"input_rows": parent.count(), "kept_rows": child.count(), "removed_rows": ledger.count()}
    same = stream_digest(kept, order) == stream_digest(child.select(*parent.columns), order)
    return counts | {"same_stream": same, "status": "PASS" if same and counts["input_rows"] == counts["kept_rows"] + counts["removed_rows"] else "FAIL"}


def corpus_faults(spark, folder: str, manifest: list[dict], pattern: str = r"(train|val)_\d+\.parquet") -> DataFrame:
    """(path, fault) of published shards: unlisted, missing, changed, with another number of rows, of an unexpected name, or with a blank text. manifest: path, rows, sha256."""
    listed = spark.createDataFrame([(m["path"], int(m["rows"]), m["sha256"]) for m in manifest], "path string, want_rows long, want_sha256 string")
    both = shard_ledger(spark, folder).join(listed, "path", "full_outer")
    fault = (
        F.when(F.col("want_sha256").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("want_sha256"), "changed")
        .when(F.col("rows") != F.col("want_rows"), "row_count").when(~F.col("path").rlike(f"^{pattern}$"), "name")
    )
    found = both.select("path", fault.alias("fault")).filter("fault is not null")
    blank = spark.read.parquet(folder).filter(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("path")).distinct()
    return found.unionByName(blank.withColumn("fault", F.lit("blank_text")))


def policy_audit(parts: dict[str, DataFrame], barred: list[str]) -> DataFrame:
    """(part, rows, barred) of named parts (source): how many rows are of barred sources; none may be."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("rows"), F.count(F.when(F.col("source").isin(barred), 1)).alias("barred")).select(F.lit(name).alias("part"), "rows", "barred")
        out = one if out is None else out.unionByName(one)
    return out
