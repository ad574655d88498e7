"""Readers: text files, strict and lenient JSON lines, Parquet, numbered sentences, blank-line documents, markup dumps.

All are Spark scans, so they split, prune and read any file system that Spark knows; lineage comes from file metadata.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.plans.scratch import checked


def _path(df: DataFrame) -> DataFrame:
    return df.withColumn("input_file", F.col("_metadata.file_path"))


def text_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """(text, input_file): one row per file, below path; hidden files are skipped."""
    return _path(spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)).select(F.col("value").alias("text"), "input_file")


def _strict(line: str):
    """The JSON value of a line; duplicate keys, NaN and infinities are errors."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("duplicate key")
        return out

    def finite(name):
        raise ValueError(f"{name} is no JSON number")

    return json.loads(line, object_pairs_hook=unique, parse_constant=finite)


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(value, input_file, input_line): each line with its number in its file, from 1. Files are split as always: lines are counted in each block first."""
    raw = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=pattern).select("value", F.col("_metadata.file_path").alias("input_file"), F.col("_metadata.file_block_start").alias("_block"))

    def count(batches):
        seen: dict[tuple, int] = {}  # the blocks of a task
        for pdf in batches:
            numbers = []
            for key in zip(pdf["input_file"], pdf["_block"], strict=True):
                seen[key] = seen.get(key, 0) + 1
                numbers.append(seen[key])
            yield pdf.assign(_n=numbers)

    blocks = raw.groupBy("input_file", "_block").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("input_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.select("input_file", "_block", before.alias("_o"))
    numbered = raw.mapInPandas(count, "value string, input_file string, _block long, _n long")
    return numbered.join(checked(shift), ["input_file", "_block"]).select("value", "input_file", (F.col("_o") + F.col("_n")).alias("input_line"))


def json_lines(spark: SparkSession, path: str, text_keys: tuple[str, ...] = ("text", "content"), strict: bool = True, numbered: bool = False, pattern: str = "*") -> DataFrame:
    """(text, meta map, input_file, problem): a line is a string, or an object with one of text_keys; other keys go to meta. Compressed files too. With numbered
    also input_line, at the price of counting the lines of each block first.

    problem is null or says what is wrong with the line; with strict=False a line that isn't JSON is its own text.
    """
    lineage = "input_file string, input_line long" if numbered else "input_file string"

    def parse(batches):
        for pdf in batches:
            out = []
            for line in pdf["value"]:
                text, meta, problem = None, {}, None
                try:
                    value = _strict(line)
                    if isinstance(value, str):
                        text = value
                    elif isinstance(value, dict):
                        key = next((k for k in text_keys if isinstance(value.get(k), str) and value[k]), None)
                        text = value[key] if key else None
                        meta = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in value.items() if k != key}
                    elif isinstance(value, list) and not strict:
                        text = "\n".join(str(m.get("content", "")) for m in value if isinstance(m, dict))
                    problem = None if text and text.strip() else "no_text"
                except ValueError as e:
                    text, problem = (None, f"bad_json: {e}") if strict else (line, None)
                out.append((text, meta, problem))
            yield pdf.drop(columns="value").assign(text=[o[0] for o in out], meta=[o[1] for o in out], problem=[o[2] for o in out])

    raw = numbered_lines(spark, path, pattern) if numbered else _path(spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=pattern)).select("value", "input_file")
    return raw.filter(F.length(F.trim("value")) > 0).mapInPandas(parse, f"{lineage}, text string, meta map<string,string>, problem string")


def demand_valid(lines: DataFrame) -> DataFrame:
    """lines without the column problem; a line with one is an error that names its file and line number."""
    at = F.concat_ws(":", "input_file", *(["input_line"] if "input_line" in lines.columns else []), "problem")
    return lines.withColumn("text", F.when(F.col("problem").isNull(), F.col("text")).otherwise(F.raise_error(at).cast("string"))).drop("problem")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, turn, role, text, input_file, input_line) of JSON lines that are arrays of {role, content}; a line that is no valid conversation is an error
    that names its place. conv_id is file and line."""

    def parse(batches):
        for pdf in batches:
            out = []
            for value, file, line in zip(pdf["value"], pdf["input_file"], pdf["input_line"], strict=True):
                try:
                    messages = _strict(value)
                    if isinstance(messages, dict):
                        messages = messages.get("messages")
                    if not isinstance(messages, list) or not messages or any(not isinstance(m, dict) or not isinstance(m.get("role"), str) or not isinstance(m.get("content"), str) or not m["content"].strip() for m in messages):
                        raise ValueError("no list of messages with role and content")
                    body = messages[1:] if messages[0]["role"] == "system" else messages
                    if not body or len(body) % 2 or any(m["role"] != ("user", "assistant")[i % 2] for i, m in enumerate(body)):
                        raise ValueError("roles out of order or incomplete")
                except (ValueError, RecursionError) as e:
                    raise ValueError(f"{file}:{line}: {e}") from e
                out += [(f"{file}:{line}", i, m["role"], m["content"], file, line) for i, m in enumerate(messages)]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "input_file", "input_line"])

    lines = numbered_lines(spark, path).filter(F.length(F.trim("value")) > 0)
    return lines.mapInPandas(parse, "conv_id string, turn int, role string, text string, input_file string, input_line long")


def parquet(spark: SparkSession, path: str, text_col: str = "text", refuse_empty: bool = False) -> DataFrame:
    """The columns of path, which must have text_col, with input_file and input_row; an empty text is an error with refuse_empty."""
    df = spark.read.parquet(path)
    if text_col not in df.columns:
        raise ValueError(f"{path} has no column {text_col}")
    if refuse_empty:
        place = F.concat(F.lit("empty text: "), F.col("_metadata.file_path"), F.lit(":"), F.col("_metadata.row_index"))
        own = F.when(F.length(F.trim(F.coalesce(text_col, F.lit("")))) > 0, F.col(text_col)).otherwise(F.raise_error(place).cast("string"))
        return df.select(*(own.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns), F.col("_metadata.file_path").alias("input_file"), F.col("_metadata.row_index").alias("input_row"))
    return df.select("*", F.col("_metadata.file_path").alias("input_file"), F.col("_metadata.row_index").alias("input_row"))


def numbered_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(number, text) of lines of digits, tab, text; another line is an error."""
    got = _path(spark.read.text(path))
    number = F.regexp_extract("value", r"^(\d+)\t(.*)$", 1).try_cast("long")
    bad = F.raise_error(F.concat(F.lit("no numbered sentence in "), F.col("input_file"), F.lit(": "), F.substring("value", 1, 80))).cast("long")
    return got.select(F.coalesce(number, bad).alias("number"), F.regexp_extract("value", r"^(\d+)\t(.*)$", 2).alias("text"), "input_file")


def blank_line_documents(spark: SparkSession, path: str) -> DataFrame:
    """(text, input_file, input_row): the blocks between blank lines of each file."""
    got = _path(spark.read.text(path, wholetext=True)).select("input_file", F.posexplode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("input_row", "text"))
    return got.withColumn("text", F.trim("text")).filter(F.length("text") > 0)


def tab_sentences(spark: SparkSession, path: str, code: str) -> DataFrame:
    """(id, text) of lines of id, language code and text."""
    return spark.read.csv(path, sep="\t", quote="", schema="id string, code string, text string").filter(F.col("code") == code).select("id", "text")


def annotated_sentences(spark: SparkSession, path: str) -> DataFrame:
    """The sentences after '# text = ' of treebank files."""
    mark = "# text = "
    return spark.read.text(path).filter(F.col("value").startswith(mark)).select(F.substring("value", len(mark) + 1, 1 << 30).alias("text"))


def wiki_pages(spark: SparkSession, path: str, least: int = 200, limit_pages: int | None = None) -> DataFrame:
    """(title, text) of the articles (name space 0) of a compressed XML dump, without markup; with limit_pages, of so many of its first pages."""
    from corpusloom.functions.text import strip_wikitext

    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, ns long, revision struct<text: struct<_VALUE: string>>").load(path)
    pages = pages if limit_pages is None else pages.limit(limit_pages)
    return pages.filter("ns = 0").select("title", strip_wikitext(F.col("revision.text._VALUE")).alias("text")).filter(F.length("text") >= least)


def flattened(df: DataFrame, column: str, least: int = 20, skip: tuple[str, ...] = ("id", "label", "url")) -> DataFrame:
    """df with text: all distinct strings of least or more characters in a JSON column, in order, without the keys in skip."""

    @F.pandas_udf("string")
    def flat(values: pd.Series) -> pd.Series:
        def strings(v, key=""):
            if isinstance(v, dict):
                for k, x in v.items():
                    yield from strings(x, k.lower())
            elif isinstance(v, list):
                for x in v:
                    yield from strings(x, key)
            elif isinstance(v, str) and len(v) >= least and key not in skip:
                yield v

        return values.map(lambda v: "\n".join(dict.fromkeys(strings(json.loads(v)))), na_action="ignore")

    return df.withColumn("text", flat(F.col(column)))


def decoded(df: DataFrame, content: str = "content", codecs: tuple[str, ...] = ("utf-8-sig", "cp1251", "koi8-r", "cp866", "utf-16")) -> DataFrame:
    """df with text and codec: UTF-8 if it is valid, else the codec with the most letters less replacements and odd pairs in the whole text."""

    @F.pandas_udf("struct<text string, codec string>")
    def best(raws: pd.Series) -> pd.DataFrame:
        out = []
        for raw in raws:
            try:
                out.append((bytes(raw).decode("utf-8-sig"), "utf-8-sig"))
                continue
            except UnicodeDecodeError:
                pass
            tried = []
            for i, c in enumerate(codecs):
                text = bytes(raw).decode(c, "replace")
                kinds = text.translate({ord(ch): "l" if ch.islower() else "U" if ch.isupper() else "-" for ch in set(text)})
                letters = sum(n for ch, n in Counter(text).items() if ch.isalpha() and (ch.islower() or ch.isupper()))
                tried.append((letters - 20 * text.count("�") - 5 * kinds.count("lU"), -i, text, c))
            out.append(max(tried)[2:])
        return pd.DataFrame(out, columns=["text", "codec"])

    return df.withColumn("_d", best(F.col(content))).select("*", "_d.text", "_d.codec").drop("_d")


def script_gate(df: DataFrame, language: str, script: str, least: float = 0.9) -> DataFrame:
    """df with upstream_reject: set unless the upstream labels name the language and script with a finite score of least or more."""
    ok = (F.col("language") == language) & (F.col("script") == script) & ~F.isnan("score") & (F.col("score") >= least)
    return df.withColumn("upstream_reject", F.when(~F.coalesce(ok, F.lit(False)), "upstream_language_gate"))


def kept_lines(df: DataFrame, text_col: str, labels_col: str, language: str) -> DataFrame:
    """df with only the lines whose label is language, if there are as many labels as lines; else upstream_reject is set."""
    parts = F.split(text_col, "\n")
    same = F.size(parts) == F.size(labels_col)
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(parts.alias("line"), F.col(labels_col).alias("label")), lambda z: z["label"] == language), lambda z: z["line"]), "\n")
    return df.withColumn("upstream_reject", F.when(~F.coalesce(same, F.lit(False)), "label_count_mismatch")).withColumn(text_col, F.when(same, kept).otherwise(F.col(text_col)))


def repeated(spark: SparkSession, texts: list[str], times: int) -> DataFrame:
    """(n, text): each text times over, with a number, for smoke runs."""
    few = F.array(*map(F.lit, texts))
    return spark.range(len(texts) * times).select(F.col("id").alias("n"), F.concat(F.element_at(few, (F.col("id") % len(texts)).cast("int") + 1), F.lit(" "), F.col("id").cast("string")).alias("text"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file below path."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return got.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


READERS: dict[str, Callable[..., DataFrame]] = {"text": text_files, "jsonl": json_lines, "parquet": parquet, "numbered_sentences": numbered_sentences, "blank_line_documents": blank_line_documents, "tab_sentences": tab_sentences, "annotated_sentences": annotated_sentences, "wiki_pages": wiki_pages, "conversations": conversations}


def read_sources(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The union of entries {source, reader, path, ...}, each with its source and order; a path with sha256 is verified first."""
    out = None
    for i, entry in enumerate(entries):
        options = {k: v for k, v in entry.items() if k not in ("source", "reader", "path", "sha256")}
        pinned = entry.get("sha256")
        if pinned is not None:  # one hash, or {file name: hash} for a folder
            found = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files(spark, entry["path"]).collect()}  # of a hand-written list of files
            if (sorted(found.values()) != [pinned]) if isinstance(pinned, str) else found != pinned:
                raise ValueError(f"{entry['path']} isn't what is pinned")
        part = READERS[entry["reader"]](spark, entry["path"], **options).withColumn("source", F.lit(entry["source"])).withColumn("source_ord", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out
