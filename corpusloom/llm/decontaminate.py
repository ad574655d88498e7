"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints are the least hash of K-word grams in each window of W grams, taken alike from documents and benchmark items. A shared
span of K + W - 1 = SPAN words holds a whole window, so both sides take the same gram from it and meet. Hits are extended to all
windows of SPAN words around the gram, which are compared word by word. An item of fewer words is one window, found by the
hash of its whole sequence among the document's grams of that length.

Null and empty texts have no words; repeated rows give repeated results; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, col, let, small, unused

SPAN, K = 10, 5
W = SPAN - K + 1
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters a-z, digits and everything beyond ASCII, after lower-casing A-Z."""
    # lower() is the fast way, and the same as A-Z alone where there is nothing but ASCII
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(low, _NOT_WORD), ""), F.array().cast("array<string>"))


def _starts(n: Column, size: int) -> Column:
    """1 .. n - size + 1; none if that is less than 1."""
    return F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, size: int) -> Column:
    """Hashes of the grams of size words, from the words' hashes; empty if there are fewer words."""
    return let(hashes, lambda h: F.transform(_starts(F.size(h), size), lambda i: F.xxhash64(F.slice(h, i, size))))


def _winnowed(grams: Column, window: int) -> Column:
    """The distinct least hashes of all windows of grams."""
    return let(grams, lambda g: F.array_distinct(F.transform(_starts(F.size(g), window), lambda i: F.array_min(F.slice(g, i, window)))))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (array of strings, sorted), contaminated and row (the text's hash) of each row of df."""
    spark = df.sparkSession
    scratch = Scratch(spark, "winnow")
    items = benchmark.select(col(item_col).cast("string").alias("item_id"), words_of(col(item_text_col)).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).filter(F.size("words") > 0)
    items = scratch.cut(items, "items")
    short = sorted(r[0] for r in items.filter(F.size("words") < SPAN).select(F.size("words")).distinct().collect())  # 9 numbers at most
    size = F.least(F.size("words"), F.lit(SPAN))
    windows = items.select("item_id", "words", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("i")).select("item_id", "len", F.slice("words", F.col("i"), F.col("len")).alias("gram"))
    windows = scratch.cut(windows.withColumn("window", F.xxhash64("gram")), "windows")
    # what a document is probed with: fingerprints of long items, whole sequences of short ones
    keys = items.select(F.explode(F.when(F.size("words") < SPAN, F.array(F.xxhash64("hashes"))).otherwise(_winnowed(_grams(F.col("hashes"), K), W))).alias("key")).distinct()

    docs = df.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    row = F.xxhash64("text").alias("row")  # beside the id, so that rows of one id and several texts stay apart
    hashed = docs.select("doc_id", row, words_of(F.col("text")).alias("words")).select("doc_id", "row", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    probes = F.array_distinct(F.concat(_winnowed(_grams(F.col("hashes"), K), W), *(_grams(F.col("hashes"), n) for n in short))) if short else _winnowed(_grams(F.col("hashes"), K), W)
    met = hashed.select("doc_id", "row", F.explode(probes).alias("key")).join(small(keys), "key")
    hits = scratch.cut(met.groupBy("doc_id", "row").agg(F.collect_set("key").alias("keys")), "hits")

    # the texts of documents with hits, and the windows around their hits
    held = small(hits.select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row"), "keys"))
    found = docs.select("doc_id", row, "text").join(held, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")))
    found = found.dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "keys", words_of(F.col("text")).alias("words"))
    found = found.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    starts = [_around(K, SPAN), *(_around(n, n) for n in short)]
    spans = found.select("doc_id", "row", "words", F.explode(F.concat(*starts)).alias("s")).select("doc_id", "row", F.col("s.start").alias("start"), F.col("s.len").alias("len"), F.slice("words", F.col("s.start"), F.col("s.len")).alias("gram"))
    distinct = windows.select("window", F.col("gram").alias("wanted")).distinct()
    spans = spans.withColumn("window", F.xxhash64("gram")).join(small(distinct), "window").filter("gram = wanted").select("doc_id", "row", "start", "len", "window", "gram")
    spans = scratch.cut(spans, "spans")

    own = "partition by doc_id, row order by start, len rows between unbounded preceding and 1 preceding"
    covered = spans.select("doc_id", "row", "start", "len").distinct().withColumn("before", F.expr(f"max(start + len) over ({own})"))
    n_hit = covered.groupBy("doc_id", "row").agg(F.sum(F.expr("greatest(0, start + len - greatest(start, coalesce(before, start)))")).alias("n_hit"))
    of = spans.select("doc_id", "row", "window", "gram").distinct().join(small(windows.select("window", "gram", "item_id").distinct()), ["window", "gram"])
    named = of.select("doc_id", "row", "item_id").distinct().groupBy("doc_id", "row").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    result = n_hit.join(named.withColumnsRenamed({"doc_id": "d", "row": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row"), "n_hit", "item_ids")
    result = scratch.cut(result, "result")
    scratch.drop(spans, hits)

    counted = docs.select("doc_id", row, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(small(result), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "row")


def _around(size: int, span: int) -> Column:
    """Starts of the windows of span words that hold a gram among the keys, as (start, len)."""
    last = F.size("words") - (span - 1)
    grams = _grams(F.col("hashes"), size)
    # a hit at i belongs to the windows that start at i - (span - size) .. i
    at = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains("keys", g), i + 1)), lambda i: i.isNotNull())
    near = F.flatten(F.transform(at, lambda i: F.when(F.least(i, last) >= F.greatest(F.lit(1), i - (span - size)), F.sequence(F.greatest(F.lit(1), i - (span - size)), F.least(i, last))).otherwise(F.array().cast("array<int>"))))
    return F.transform(F.array_distinct(near), lambda s: F.struct(s.alias("start"), F.lit(span).alias("len")))


def op2_result(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def keep_clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that hold a window of a benchmark item, with all columns."""
    i, h = unused("_id", df), unused("_hash", df)
    found = contamination(df, benchmark, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias(i), F.col("row").alias(h)).distinct()
    found = Scratch(df.sparkSession, "clean").cut(found, "hits")
    same = col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(col(text_col), F.lit(""))) == F.col(h))
    return df.join(small(found), same, "left_anti")


ORACLE_SQL = """
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from documents),
b as (select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, n, item_id from dw join bw using (n, g)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""
