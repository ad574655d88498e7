"""Document fingerprints by I-Match, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band of shares of all documents. Its lower end is a share too, so
the lexicon has at most (mean distinct terms of a document) / LOW terms, whatever the number of documents. It has SUBSETS randomised subsets,
the same for every document, each of half of its terms: term t belongs to subset s if bit s of its hash is set. A document's
distinct lexicon terms are sorted, and those in each subset are hashed; its fingerprint is the list of these hashes. A change of c lexicon terms leaves
a subset's hash as it is with a probability of 2 ** -c. Likeness is the share of subsets with equal hashes, among those with
a term on either side.

Null and empty texts have no terms. Without lexicon terms a fingerprint is the hash of all terms, and likeness is 1 or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusloom.llm.common import Scratch, col, let, small

SUBSETS = 16
LOW, HIGH = 0.0005, 0.1
#: Bytes of texts that a task of op4_result is to hold, on average.
TASK_BYTES = 32 << 20
_END = -1  # stands in each document and in the lexicon, so that no document is lost
_NONE = "."  # the code of a subset without a term


def terms_of(text: Column) -> Column:
    """Hashes of the distinct lower-case terms of letters and digits."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def lexicon(df: DataFrame, text_col: str = "text", *, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term) of all terms of df within the band, and the end mark. Each document counts a term once, before the shuffle."""
    n = df.count()
    counts = df.select(F.explode(terms_of(col(text_col))).alias("term")).groupBy("term").count()
    kept = counts.filter((F.col("count") >= max(1.0, low * n)) & (F.col("count") <= max(2.0, high * n))).select("term")
    return kept.union(df.sparkSession.range(1).select(F.lit(_END).cast("long").alias("term")))


def _fingerprint(terms: Column, every: Column) -> Column:
    """The fingerprint of sorted lexicon terms; every is the hash of all terms."""

    def code(part: Column) -> Column:
        return F.when(F.size(part) == 0, _NONE).otherwise(F.lpad(F.hex(F.xxhash64(part)), 16, "0"))

    def within(t: Column, s: int) -> Column:
        return F.filter(t, lambda x: F.getbit(x, F.lit(s)) == 1)

    def of(t: Column) -> Column:
        codes = F.array(*(let(within(t, s), code) for s in range(SUBSETS)))
        return F.when(F.size(t) > 0, F.array_join(codes, ",")).otherwise(F.concat(F.lit("-"), F.hex(every)))

    return let(terms, of)


def likeness(x: str, y: str) -> Column:
    """Share of equal subsets, 0 to 1."""

    def of(a: Column, b: Column) -> Column:
        some = F.filter(F.zip_with(a, b, lambda p, q: F.when((p != _NONE) | (q != _NONE), (p == q).cast("int"))), lambda z: z.isNotNull())
        return let(some, lambda z: F.when(F.size(z) > 0, F.size(F.array_remove(z, 0)) / F.size(z)).otherwise(0.0))

    both = let(F.split(F.col(x), ","), lambda a: let(F.split(F.col(y), ","), lambda b: F.when((F.size(a) == SUBSETS) & (F.size(b) == SUBSETS), of(a, b)).otherwise(0.0)))
    return F.when(F.col(x) == F.col(y), F.lit(1.0)).otherwise(both).cast("double")


def _tagged(terms: str, of: int) -> Column:
    return F.transform(terms, lambda t: F.struct(F.lit(of).alias("of"), t.alias("term")))


def _lexicon_terms(frame: DataFrame, keys: list[str], texts: dict[str, str], lex: DataFrame) -> DataFrame:
    """frame with, for each text column, <name>_terms (sorted lexicon terms) and <name>_all (hash of all terms).

    keys name a row and must hold what frame is dealt out by, so that no exchange is needed after the broadcast join.
    """
    frame = frame.select("*", *(terms_of(F.col(c)).alias(f"_{name}") for name, c in texts.items()))
    held = [c for c in frame.columns if c not in {*texts.values(), *(f"_{n}" for n in texts)}]
    marked = F.concat(F.array(F.struct(F.lit(-1).alias("of"), F.lit(_END).cast("long").alias("term"))), *(_tagged(f"_{n}", i) for i, n in enumerate(texts)))
    # computed before the explode, which would otherwise have them computed for each of its rows
    frame = frame.select(*held, *(F.xxhash64(F.sort_array(f"_{n}")).alias(f"{n}_all") for n in texts), marked.alias("_marked"))
    frame = frame.select(*[c for c in frame.columns if c != "_marked"], F.explode("_marked").alias("_t")).select("*", F.col("_t.of").alias("_of"), F.col("_t.term").alias("term")).drop("_t")
    met = frame.join(small(lex), "term")
    rest = [c for c in held if c not in keys] + [f"{n}_all" for n in texts]
    return met.groupBy(*keys).agg(*(F.first(c).alias(c) for c in rest), *(F.sort_array(F.collect_list(F.when(F.col("_of") == i, F.col("term")))).alias(f"{n}_terms") for i, n in enumerate(texts)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id and fingerprint of each row. Rows of one text have one fingerprint, so distinct texts are dealt out once."""
    scratch = Scratch(df.sparkSession, "imatch")
    lex = scratch.cut(lexicon(df, text_col, low=low, high=high), "lexicon")
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()).repartition("row")
    made = _lexicon_terms(rows, ["row"], {"own": "text"}, lex)
    return made.select("doc_id", _fingerprint(F.col("own_terms"), F.col("own_all")).alias("fingerprint"))


def _with_next(tops: DataFrame, run: int = 10_000) -> DataFrame:
    """tops with above: the next bucket that is there, and for the last the first. Runs of buckets are ordered each in a task of its own; only one row
    a run, of some run * 500 documents, goes through a single task."""
    runs = tops.withColumn("run", F.floor(F.col("bucket") / run))
    edges = runs.groupBy("run").agg(F.min("bucket").alias("lowest")).selectExpr("run", "coalesce(lead(lowest) over (order by run), min(lowest) over ()) as beyond")
    inner = runs.withColumn("above", F.expr("lead(bucket) over (partition by run order by bucket)"))
    return inner.join(small(edges), "run").select("bucket", "top", F.coalesce("above", "beyond").alias("above"))


def op4_result(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, low: float = LOW, high: float = HIGH, rows_in_bucket: int = 500) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's, by descending numeric id (null last; rows of one
    id by descending text); the last document's next is the first.

    Documents are dealt out once, in buckets of neighbouring ids; the first row of the next bucket stands in both.
    """
    spark = df.sparkSession
    if not isinstance(df.select(col(id_col)).schema[0].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer, as ids tell which document is next")
    scratch = Scratch(spark, "imatch")
    docs = df.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    lex = scratch.cut(lexicon(docs, "text", low=low, high=high), "lexicon")
    n, size, lo, hi, cuts = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / 64 for i in range(1, 64)], 2000)).first()
    edges = sorted({int(lo), *map(int, cuts), int(hi) + 1}) if lo is not None else [0, 1]
    per = max(1, n // (len(edges) * rows_in_bucket) + 1)  # buckets of equal width between two of 64 quantiles
    bounds = F.array(*(F.lit(e).cast("long") for e in edges))
    part = F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))
    a, b = F.element_at(bounds, part), F.element_at(bounds, F.least(part + 1, F.lit(len(edges))))
    within = F.floor((F.col("doc_id") - a).cast("double") * per / F.greatest(b - a, F.lit(1)))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part.cast("long") * per + F.least(within, F.lit(per - 1))).cast("long")
    docs = docs.withColumn("bucket", bucket)
    # the greatest id of each bucket also goes to the bucket above; that of all goes to the lowest
    tops = scratch.cut(docs.groupBy("bucket").agg(F.max("doc_id").alias("top")), "tops")
    tops = scratch.cut(_with_next(tops), "next")
    first = docs.join(small(tops.select("top", F.col("bucket").alias("of"), "above")), F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("bucket") == F.col("of"))).select("doc_id", "text", F.col("above").alias("bucket"), F.lit(1).alias("extra"))
    both = docs.select("doc_id", "text", "bucket", F.lit(0).alias("extra")).unionByName(first)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    both = both.repartition(parts, "bucket")
    order = "partition by bucket order by extra, doc_id desc nulls last, text desc"
    both = both.withColumn("next", F.expr(f"lead(text) over ({order})")).withColumn("place", F.expr(f"row_number() over ({order})"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(F.left("text", F.char_length("text") - third), F.coalesce(F.left("next", third), F.lit(""))))
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("next")
    made = _lexicon_terms(both, ["bucket", "place"], {"own": "text", "new": "edited"}, lex)
    prints = (_fingerprint(F.col(f"{n}_terms"), F.col(f"{n}_all")).alias(out) for n, out in (("own", "fingerprint"), ("new", "edited_fingerprint")))
    made = made.select("bucket", "place", "extra", "doc_id", "n_chars", "edited_sha256", *prints)
    made = made.withColumn("next_fingerprint", F.expr("lead(fingerprint) over (partition by bucket order by place)")).filter("extra = 0")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
