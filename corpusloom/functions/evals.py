"""Evaluation items and answers: item shape, prompts from fields, strict answers, captured event streams, role-scoped language checks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import scoring


def item(df: DataFrame) -> DataFrame:
    """df with the standard columns of an item: id, prompt, include, exclude, weight (1 unless given, positive), category."""
    have = set(df.columns)
    pick = lambda names, default: F.coalesce(*(F.col(n) for n in names if n in have), default)
    none = F.array().cast("array<string>")
    out = df.select(
        pick(["id", "eval_id"], F.lit(None).cast("string")).alias("id"), pick(["prompt", "question", "input"], F.lit(None).cast("string")).alias("prompt"), pick(["must_include_any", "must_contain"], none).alias("include"),
        pick(["must_not_include_any", "must_not_contain"], none).alias("exclude"), pick(["weight"], F.lit(1.0)).cast("double").alias("weight"), pick(["category"], F.lit("general")).alias("category"),
    )
    return out.withColumn("problem", F.when(F.coalesce(F.trim("prompt"), F.lit("")) == "", "no_prompt").when(~(F.col("weight") > 0) | F.isnan("weight"), "bad_weight"))


def prompt(fields: list[tuple[str, tuple[str, ...]]], columns: list[str]) -> Column:
    """Lines 'label: value' of the first present alias of each field; a missing field is left out."""
    parts = []
    for label, names in fields:
        present = [F.col(n) for n in names if n in columns]
        if present:
            parts.append(F.concat(F.lit(f"{label}: "), F.coalesce(*present)))
    return F.concat_ws("\n", *parts)


def strict_answer(text: Column) -> Column:
    """0 or 1 if that is all of the answer, else null."""
    return F.when(F.trim(text).rlike("^[01]$"), F.trim(text).cast("int"))


@F.pandas_udf(T.StructType([T.StructField("answer", T.StringType()), T.StructField("problem", T.StringType())]))
def _stream(texts: pd.Series) -> pd.DataFrame:
    def parse(text: str | None) -> tuple[str | None, str | None]:
        parts, done = [], False
        for line in (text or "").splitlines():
            if not line.startswith("data:"):
                continue
            body = line[5:].strip()
            if body == "[DONE]":
                done = True
                continue
            try:
                event = json.loads(body)
                choice = event["choices"][0]
                parts.append((choice.get("delta") or choice.get("message") or {}).get("content") or "")
                done = done or choice.get("finish_reason") is not None
            except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                return None, "bad_event"
        return ("".join(parts), None) if done else (None, "incomplete")

    return pd.DataFrame([parse(t) for t in texts], columns=["answer", "problem"])


def streamed_answer(text: Column) -> Column:
    """struct(answer, problem) of a captured stream of server-sent events; incomplete ones have no answer."""
    return _stream(text)


def role_language(turns: DataFrame, profile: scoring.LanguageProfile, strict: bool = False, exceptions: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, role, decision) of messages in another language: assistants' always, users' if strict. exceptions (role, digest) are
    reviewed messages that pass."""
    seen = turns.filter("role <> 'system'" if strict else "role = 'assistant'").select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), scoring.detect(F.col("text"), profile, least=10)["decision"].alias("decision"))
    bad = seen.filter("decision = 'reject'")
    return bad.join(exceptions, ["role", "digest"], "left_anti").drop("digest") if exceptions is not None else bad.drop("digest")


def role_language_report(turns: DataFrame, profile: scoring.LanguageProfile, mode: str = "historical", exceptions: DataFrame | None = None) -> DataFrame:
    """(role, decision, rows) of the messages but system ones. mode: historical judges answers, strict users' messages too, schema none (decision unchecked);
    reviewed exceptions (role, digest) count as such. A message of up to three words without a decision against it by letters is ambiguous, not refused."""
    if mode not in ("historical", "strict", "schema"):
        raise ValueError("mode must be historical, strict or schema")
    seen = turns.filter("role <> 'system'").select("role", F.sha2("text", 256).alias("digest"), scoring.detect(F.col("text"), profile, least=10)["decision"].alias("d"), (F.size(scoring.plain_words(F.col("text"))) <= 3).alias("few"))
    judged = F.lit(mode == "strict") | (F.lit(mode == "historical") & (F.col("role") == "assistant"))
    if exceptions is not None:
        seen = seen.join(exceptions.select("role", "digest").distinct().withColumn("reviewed", F.lit(True)), ["role", "digest"], "left")
    else:
        seen = seen.withColumn("reviewed", F.lit(None).cast("boolean"))
    decision = F.when(~judged, "unchecked").when(F.col("reviewed") & (F.col("d") == "reject"), "reviewed").when((F.col("d") == "reject") & F.col("few"), "ambiguous").otherwise(F.col("d"))
    return seen.groupBy("role", decision.alias("decision")).agg(F.count("*").alias("rows"))


def mixture_plan(sources: DataFrame, per_source: float, per_class: float) -> DataFrame:
    """(source, class, share): even shares, capped for each source and, in proportion, for each class, then scaled to one."""
    from pyspark.sql import Window as W

    everything = W.partitionBy()  # a row per source: a hand-written table
    even = sources.withColumn("share", F.least(F.lit(per_source), 1 / F.count("*").over(everything)))
    of_class = F.sum("share").over(W.partitionBy("class"))
    capped = even.withColumn("share", F.col("share") * F.least(F.lit(1.0), per_class / of_class))
    return capped.select("source", "class", (F.col("share") / F.sum("share").over(everything)).alias("share"))


def step_budget(tokens: int, batch_tokens: int, passes: float = 1.0, evaluations: int = 20) -> dict[str, int]:
    """Steps for the passes over tokens, rounded up, and the interval of evaluations."""
    if tokens <= 0 or batch_tokens <= 0 or passes <= 0:
        raise ValueError("tokens, batch and passes must be positive")
    steps = -(-int(tokens * passes) // batch_tokens)
    return {"steps": steps, "eval_every": max(1, steps // evaluations)}
