"""Table functions, plain callables, and the proofs over published shards."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import evals, scoring, text, udtfs
from corpusloom.operators import conversations, evidence
from corpusloom.plans.scratch import cutter
from corpusloom.sources import sinks
from corpusloom.streaming import packing


def test_table_functions(spark):
    assert udtfs.register(spark) == ["text_blocks", "text_chunks", "word_shingles"]
    rnd = random.Random(1)
    whole = "\n\n".join("x" * rnd.randrange(1, 400) for _ in range(40))
    spark.createDataFrame([(1, "a b\n \nc"), (2, None), (3, whole)], "i int, t string").createOrReplaceTempView("texts")
    assert sorted(map(tuple, spark.sql("select i, block, text from texts, lateral text_blocks(t) where i < 3").collect())) == [(1, 0, "a b"), (1, 1, "c")]
    assert [r.shingle for r in spark.sql("select shingle from texts, lateral word_shingles(t, 2) where i = 1").collect()] == ["a b", "b c"]
    made = [r.text for r in spark.sql("select chunk, text from texts, lateral text_chunks(t, 100, 900) where i = 3 order by chunk").collect()]
    assert made == spark.table("texts").filter("i = 3").select(text.chunks(F.col("t"), 100, 900).alias("c")).first().c and len(made) > 3


def test_plain_callables(spark):
    df = spark.createDataFrame([(i, "ab" * (i + 1)) for i in range(10)], "doc long, prompt string")
    ids = df.select("doc", udtfs.encoded(F.col("prompt"), lambda t: [ord(c) for c in t]).alias("ids"))
    flat = [ord(c) for i in range(10) for c in "ab" * (i + 1)]
    rows = sorted(packing.pack(ids, "doc", "ids", 8).collect(), key=lambda r: r.row)
    assert [r.tokens for r in rows] == [flat[i * 8 : i * 8 + 9] for i in range(len(rows))] and len(rows) == (len(flat) - 1) // 8
    with pytest.raises(Exception, match="non-empty list"):
        df.select(udtfs.encoded(F.col("prompt"), lambda t: [])).collect()
    got = {r.doc: (r.answer, r.problem) for r in udtfs.answered(df, lambda p: p.upper() if len(p) > 2 else 1 // 0).collect()}
    assert got[1] == ("ABAB", None) and got[0][0] is None and got[0][1].startswith("ZeroDivisionError")


def test_streams_are_compared_in_order(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "i long, t string")
    one = evidence.stream_digest(df, ["i"])
    assert one == evidence.stream_digest(df.repartition(7).orderBy(F.desc("i")), ["i"]) != evidence.stream_digest(df, ["t"])
    ledger = df.filter("i % 10 = 3").select("i")
    child = df.filter("i % 10 <> 3")
    assert evidence.subset_proof(df, child, ledger, "i", ["i"]) == {"input_rows": 50, "kept_rows": 45, "removed_rows": 5, "same_stream": True, "status": "PASS"}
    changed = child.withColumn("t", F.when(F.col("i") == 1, "other").otherwise(F.col("t")))
    assert evidence.subset_proof(df, changed, ledger, "i", ["i"])["status"] == "FAIL"


def test_published_shards(spark, tmp_path):
    for n, texts in ((0, ["a", "b"]), (1, ["c", " "])):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (tmp_path / "c").mkdir(exist_ok=True)
        next((tmp_path / f"w{n}").glob("part*")).rename(tmp_path / "c" / f"train_0000{n}.parquet")
    manifest = [r.asDict() for r in sinks.shard_ledger(spark, str(tmp_path / "c")).collect()]
    assert sorted(map(tuple, evidence.corpus_faults(spark, str(tmp_path / "c"), manifest).collect())) == [("train_00001.parquet", "blank_text")]
    wrong = [manifest[0] | {"rows": 9}, {"path": "train_00009.parquet", "rows": 1, "sha256": "0"}]
    faults = dict(map(tuple, evidence.corpus_faults(spark, str(tmp_path / "c"), wrong).filter("fault <> 'blank_text'").collect()))
    assert faults == {manifest[0]["path"]: "row_count", manifest[1]["path"]: "unlisted", "train_00009.parquet": "missing"}
    part = spark.createDataFrame([("a",), ("b",), ("b",)], "source string")
    assert tuple(evidence.policy_audit({"train": part}, ["b"]).first()) == ("train", 3, 2)


def test_conversations_are_published(spark, tmp_path):
    rows = [(c, i, r, f"{t} {c}") for c in range(30) for i, (r, t) in enumerate([("user", "ask"), ("assistant", "say")])]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    built = cutter(spark)(conversations.build(turns, spark.createDataFrame([("ask 3",)], "text string"), cutter(spark), ratio=0.4))
    sinks.publish_conversations(built, str(tmp_path / "g"), {"version": 1})
    now = sinks.current(spark, str(tmp_path / "g"))
    n = {s: spark.read.parquet(f"{now}/{s}").count() for s in ("train", "val", "quarantine")}
    assert n["train"] + n["val"] == 29 and n["quarantine"] == 1 and re.search("generation-", now)


def test_language_of_roles(spark):
    rows = [(1, 0, "user", "это как что для"), (1, 1, "assistant", "The king of the land went to the sea and back."), (1, 2, "user", "le roi et les gens dans une ville pour elle"), (1, 3, "assistant", "нет")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    of = lambda *a: {(r.role, r.decision): r.rows for r in evals.role_language_report(turns, scoring.ENGLISH, *a).collect()}
    assert of("schema") == {("user", "unchecked"): 2, ("assistant", "unchecked"): 2}
    assert of("historical")["user", "unchecked"] == 2 and of("historical")["assistant", "ambiguous"] == 1 and of("strict")["user", "reject"] >= 1
    seen = turns.filter("turn = 0").select("role", F.sha2("text", 256).alias("digest"))
    assert of("strict", seen)["user", "reviewed"] == 1
    with pytest.raises(ValueError, match="mode"):
        of("other")
