"""Functions of one's own in the engine: table functions for SQL, and wrappers that take plain Python callables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class _Blocks:
    def eval(self, text: str):
        """The blocks between blank lines."""
        for i, block in enumerate(re.split(r"\r?\n[ \t]*\r?\n", text or "")):
            if block.strip():
                yield i, block.strip()


class _Shingles:
    def eval(self, text: str, n: int):
        """The distinct word n-grams, in order."""
        words = re.findall(r"\w+", (text or "").lower())
        yield from ((g,) for g in dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))


class _Chunks:
    def eval(self, text: str, least: int, most: int):
        """Paragraphs packed into chunks, as functions.text.chunks does."""
        now, at = "", 0
        for part in (p.strip() for p in re.split(r"\n\s*\n", text or "")):
            if not part:
                continue
            if now and len(now) + len(part) > most and len(now) >= least:
                yield at, now
                now, at = part, at + 1
            else:
                now = f"{now}\n\n{part}" if now else part
        if len(now) >= least:
            yield at, now


def register(spark: SparkSession) -> list[str]:
    """Makes text_blocks(text), word_shingles(text, n) and text_chunks(text, least, most) known to SQL, for lateral joins."""
    made = {
        "text_blocks": udtf(_Blocks, returnType="block int, text string"), "word_shingles": udtf(_Shingles, returnType="shingle string"),
        "text_chunks": udtf(_Chunks, returnType="chunk int, text string"),
    }
    for name, f in made.items():
        spark.udtf.register(name, f)
    return sorted(made)


def encoded(text: Column, encode: Callable[[str], list[int]]) -> Column:
    """The ids that encode gives for a text, as array<long>; an answer that is no non-empty list of ids from 0 on is an error."""

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                ids = list(encode(t or ""))
                if not ids or any(type(i) is not int or not 0 <= i < 2**63 for i in ids):
                    raise ValueError("encode must give a non-empty list of ids from 0 on")
                out.append(ids)
            yield pa.array(out, pa.list_(pa.int64()))

    return run(text)


def answered(items: DataFrame, ask: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """items with answer and problem: ask is called once an item, on the executors; what it raises becomes the item's problem."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "answer string", "problem string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf[prompt]:
                try:
                    out.append((ask(p), None))
                except Exception as e:  # an item's own failure
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pdf.assign(answer=[o[0] for o in out], problem=[o[1] for o in out])

    return items.mapInPandas(run, schema)
