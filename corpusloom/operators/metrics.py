"""Evaluation and corpus measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binary(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Accuracy, F1 and Matthews correlation; a null prediction is wrong, and with any, F1 and correlation are null."""
    p = lambda g, q: F.sum(((gold == g) & (predicted == q)).cast("double"))
    bad = F.sum(predicted.isNull().cast("long"))
    tp, tn, fp, fn = F.coalesce(p(1, 1), F.lit(0.0)), F.coalesce(p(0, 0), F.lit(0.0)), F.coalesce(p(0, 1), F.lit(0.0)), F.coalesce(p(1, 0), F.lit(0.0))
    counts = df.agg(F.count("*").alias("n"), bad.alias("invalid"), tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"))
    root = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    f1 = F.when(F.col("invalid") == 0, F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))
    mcc = F.when(F.col("invalid") == 0, F.when(root > 0, (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / root).otherwise(0.0))
    return counts.select("n", "invalid", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), f1.alias("f1"), mcc.alias("mcc"))


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high), clipped to [0, 1]; null without trials."""
    p = successes / total
    mid = (p + z * z / (2 * total)) / (1 + z * z / total)
    half = z / (1 + z * z / total) * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))
    return F.when(total > 0, F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high")))


def bits_per_byte(nats: Column, size: Column) -> Column:
    """Aggregate: total loss in bits by total bytes; targets without bytes don't count."""
    return F.sum(F.when(size > 0, nats)) / (F.log(F.lit(2.0)) * F.sum(F.when(size > 0, size)))


def census(df: DataFrame) -> DataFrame:
    """Documents, characters, bytes and words by source, and each source's share of all characters."""
    each = df.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("words"))
    total = each.agg(F.sum("chars").alias("all_chars"))  # one row
    return each.join(F.broadcast(total)).select("source", "docs", "chars", "bytes", "words", (F.col("chars") / F.col("all_chars")).alias("share"))


def pass_rates(df: DataFrame, passed: Column, weight: Column) -> DataFrame:
    return df.agg(F.avg(passed.cast("double")).alias("pass_rate"), (F.sum(F.when(passed, weight).otherwise(0.0)) / F.sum(weight)).alias("weighted_pass_rate"))


def detection_report(scored: DataFrame, score: str = "score", decision: str = "decision") -> DataFrame:
    """One row: rows, accepted, quarantined and rejected ones, mean score and accept rate to four places (0 for an empty table)."""
    n = F.count("*")
    of = lambda d: F.count(F.when(F.col(decision) == d, 1))
    return scored.agg(
        n.alias("rows"), *(of(d).alias(d) for d in ("accept", "quarantine", "reject")),
        F.round(F.coalesce(F.sum(score), F.lit(0.0)) / F.greatest(n, F.lit(1)), 4).alias("average_score"), F.round(of("accept") / F.greatest(n, F.lit(1)), 4).alias("accept_rate"),
    )


def language_rates(answers: DataFrame, score: Column) -> DataFrame:
    """One row on scored answers (scoring.generation_score): their number and the shares in the own language, dominated by another, short, mentioning others, refusing."""
    each = answers.select(score.alias("s")).select("s.*")
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4).alias(f"{c}_rate")
    return each.agg(F.count("*").alias("answers"), F.round(F.avg("own_score"), 4).alias("mean_own_score"), *(rate(c) for c in ("is_own", "rival_dominant", "other_dominant", "too_short", "mentions", "is_refusal")))


def macro_accuracy(df: DataFrame, config: str, correct: Column) -> DataFrame:
    """One row: configurations and the unweighted mean of their accuracies; a null answer is wrong."""
    each = df.groupBy(config).agg(F.avg(F.coalesce(correct, F.lit(False)).cast("double")).alias("accuracy"))
    return each.agg(F.count("*").alias("configs"), F.avg("accuracy").alias("macro_accuracy"))


def token_census(df: DataFrame, tokens: Column, source: str = "source") -> DataFrame:
    """By source and for all (source null): documents, chars, bytes, content tokens, one BOS a document, their sum, and the share of all tokens."""
    each = df.select(source, F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), tokens.cast("long").alias("n"))
    out = each.rollup(source).agg(F.grouping(source).alias("_all"), F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.sum("bytes").alias("utf8_bytes"), F.sum("n").alias("content_tokens"))
    out = out.withColumn("bos_tokens", F.col("documents")).withColumn("tokens", F.col("content_tokens") + F.col("bos_tokens"))
    total = out.filter("_all = 1").select(F.col("tokens").alias("_total"))  # one row
    return out.join(F.broadcast(total)).withColumn("token_share", F.col("tokens") / F.greatest("_total", F.lit(1))).drop("_all", "_total")


def census_faults(census: DataFrame, described: DataFrame) -> DataFrame:
    """Sources whose documents or chars in a token census differ from those of the prepared mixture (source, rows, chars), or that one side lacks."""
    a = census.filter("source is not null").select("source", "documents", F.col("chars").alias("token_chars"))
    return a.join(described.select("source", "rows", "chars"), "source", "full_outer").filter(~(F.col("documents").eqNullSafe(F.col("rows")) & F.col("token_chars").eqNullSafe(F.col("chars"))))


def rendered_census(rendered: DataFrame, column: str = "rendered") -> DataFrame:
    """One row on rendered conversations (arrays of id and mask): rows, tokens, supervised tokens after the first place, and the longest."""
    learned = F.size(F.filter(F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(1))), lambda x: x["mask"] == 1))
    return rendered.agg(F.count("*").alias("rows"), F.sum(F.size(column).cast("long")).alias("rendered_tokens"), F.sum(learned.cast("long")).alias("supervised_tokens"), F.max(F.size(column)).alias("max_rendered_tokens"))


def board(candidates: DataFrame, priority: str = "priority") -> DataFrame:
    """Candidates by priority."""
    return candidates.groupBy(priority).agg(F.count("*").alias("rows"))


def counts_by_file(rows: DataFrame, files: DataFrame, hit: Column, file: str = "input_file") -> DataFrame:
    """(file, rows, hits, problem) for each of files (one column): a listed file without rows is a problem, and so is one with hits."""
    counts = rows.groupBy(F.col(file).alias("_f")).agg(F.count("*").alias("rows"), F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias("hits"))
    out = files.select(F.col(files.columns[0]).alias("file")).join(counts, F.col("file") == F.col("_f"), "left").fillna(0, ["rows", "hits"]).drop("_f")
    return out.withColumn("problem", F.when(F.col("rows") == 0, "missing_or_empty").when(F.col("hits") > 0, "hits"))
