"""What the two exact substring removers share: where a window of symbols may occur again, and what is taken out.

A window's anchor is the place of the least hash among its grams, so equal windows have anchors at equal places and meet under
the anchor's hash. Only anchors whose hash occurs twice can stand in repeated windows; each becomes a record: the
symbols of the windows that it anchors. Records of one hash are compared by the remover's own method. A hash of over HOT
records is dealt out in salted parts, in proportion to its count; what repeats in a part is settled. Each window left, of which a part has one of
a kind, meets its like of the other parts under a hash of the whole window, so no task ever holds all records of a hash.

Exact copies of a whole text are settled by their hash beforehand. Order is by numeric id, null ids last; rows of one
id don't precede each other, so equal rows of one id both stay. Null texts count as empty; extra columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from corpusloom.llm.common import Scratch, batches_of, col, rows_of, small, small_batches

_P = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1
#: Records of one hash beyond which they are compared in parts first, each of so many records or the root of their number.
HOT = 500
_SIDE = 1 << 15
_RUN = re.compile(b"\1+")
_PLACES = "doc_id long, row int, lo int, hi int, key long, window long"


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all grams of k symbols, by doubling; none if there are fewer."""
    if len(symbols) < k:
        return np.zeros(0, np.uint64)
    part, size, at, out = symbols.astype(np.uint64) + np.uint64(1), 1, 0, None
    total = len(symbols) - k + 1
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                piece = part[at : at + total]
                out = piece if out is None else out * np.uint64(pow(_P, size, 1 << 64)) + piece
                at += size
            if 2 * size > k:
                break
            part = part[:-size] * np.uint64(pow(_P, size, 1 << 64)) + part[size:]
            size *= 2
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return out ^ (out >> np.uint64(29))


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for the runs of windows of width grams that have one anchor, the leftmost least."""
    n = len(hashes) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    bits, found = 20, []
    low = np.uint64((1 << bits) - 1)
    block = (1 << bits) - width
    for start in range(0, n, block):
        x = (hashes[start : start + block + width - 1] & ~low) | np.arange(min(block + width - 1, len(hashes) - start), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            x = np.minimum(x[:-size], x[size:])
            size *= 2
        if size < width:
            x = np.minimum(x[: len(x) - (width - size)], x[width - size :])
        found.append((x & low).astype(np.int64) + start)
    at = np.concatenate(found)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], n] - 1


def remove(
    df: DataFrame, id_col: str, text_col: str, *, window: int, k: int, reader: Callable, matcher: Callable, cutter: Callable, hot: int = HOT
) -> DataFrame:
    """doc_id, n, n_removed, n_spans and kept (bytes) of each row of df.

    reader() gives a function from a text to its symbols as numbers. matcher takes the records of whole groups of one hash and salt,
    and gives for each an array of which of its windows repeat. cutter slices a text's symbols and joins what stays of them. Ids must be
    numbers or null, as they give the order.
    """
    spark = df.sparkSession
    if not isinstance(df.select(col(id_col)).schema[0].dataType, (IntegralType, DecimalType)):
        raise TypeError(f"{id_col} must be an integer: which of two equal windows stays goes by the order of ids")
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    width = window - k + 1
    doc_id = F.coalesce(col(id_col).cast("long"), F.lit(_LAST))
    docs = df.select(doc_id.alias("doc_id"), col(id_col).isNull().alias("no_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "no_id", F.hash("text").alias("hash"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    slim = scratch.cut(docs.select("doc_id", "hash", "h"), "slim")
    # row tells texts of one id apart; it is 0 where an id has one text, which costs nothing in a shuffle. Not a literal, which
    # would be folded out of the partitioning, so that the texts would be dealt out again for each join
    none = F.col("hash").bitwiseAND(F.lit(0))
    several = scratch.cut(slim.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("doc_id", F.lit(True).alias("several")), "several")
    numbered = lambda d: d.withColumn("row", none) if not any_several else d.join(small(several), "doc_id", "left").withColumn("row", F.when(F.col("several"), F.col("hash")).otherwise(none)).drop("several")
    any_several = bool(several.limit(1).count())
    docs, slim = numbered(docs), numbered(slim)
    shared = scratch.cut(slim.groupBy("hash", "h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id"), "shared")
    copies = scratch.cut(slim.join(small(shared), ["hash", "h"]).filter("doc_id > first_id").select("doc_id", "row").distinct(), "copies")
    held = small(copies)
    own = docs.join(held, ["doc_id", "row"], "left_anti").select("doc_id", "row", "text")

    def find(batches):
        read = reader()
        for batch in batches:
            keys, ids, rows, at, spans = [], [], [], [], []
            for d, r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = gram_hashes(read(text), k)
                a, first, last = anchors(h, width)
                if len(a):
                    keys.append(h[a] >> np.uint64(16))  # 48 bits: a chance meeting costs a comparison only
                    at.append(a)
                    spans.append((a - first) * _SIDE + (last - a + width))
                    ids.append(np.full(len(a), d, np.int64))
                    rows.append(np.full(len(a), r, np.int32))
            if keys:
                made = (np.concatenate(keys).view(np.int64), np.concatenate(ids), np.concatenate(rows), np.concatenate(at).astype(np.int32), np.concatenate(spans).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["key", "doc_id", "row", "at", "span"])

    # found twice, as a table of all anchors would take half the input's size on disk
    marks = own.mapInArrow(find, "key long, doc_id long, row int, at int, span int")
    parts = F.when(F.col("c") > hot, F.ceil(F.col("c") / F.greatest(F.lit(float(hot)), F.sqrt("c")))).otherwise(0).cast("int")
    often = scratch.cut(marks.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key", parts.alias("parts")), "often")
    some_hot = bool(often.filter("parts > 0").limit(1).count())
    if some_hot:
        salted = marks.join(small(often.filter("parts > 0")), "key", "left").withColumn("salt", F.coalesce(1 + F.pmod(F.xxhash64("doc_id", "row", "at"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        dealt_keys = often.select("key", F.explode(F.when(F.col("parts") > 0, F.sequence(F.lit(1), F.col("parts"))).otherwise(F.array(F.lit(0)))).alias("salt"))
        met = salted.join(dealt_keys.hint("shuffle_hash"), ["key", "salt"])
    else:
        met = marks.join(often.select("key").hint("shuffle_hash"), "key").withColumn("salt", F.lit(0))
    places = met.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "salt", "at", "span")).alias("places"))
    # one exchange of the texts: the same columns are dealt out here and at the end, so that Spark uses it twice
    dealt = docs.select("doc_id", "no_id", "row", "text").repartition("doc_id", "row")

    def record(batches):
        schema = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int32()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("part", pa.binary())])

        for batch in batches:
            places = batch.column("places")
            at_row, each = places.offsets.to_numpy(), places.flatten()  # columns of all rows' places
            key, salt, at, span = (each.field(n).to_numpy(zero_copy_only=False) for n in ("key", "salt", "at", "span"))
            first = at_row[:-1] - at_row[0]
            count = np.diff(at_row)
            lo, hi = at - span // _SIDE, at + span % _SIDE - width
            ids, rows = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            texts = batch.column("text")
            for start, end in _runs(count, 20_000):
                a, b = int(first[start]), int(first[end - 1] + count[end - 1])
                parts = []
                for j in range(start, end):
                    piece, x, y = cutter.pieces(texts[j].as_py()), int(first[j]), int(first[j] + count[j])
                    parts += [piece(p, q) for p, q in zip(lo[x:y].tolist(), (hi[x:y] + window).tolist(), strict=True)]
                d = np.repeat(ids[start:end], count[start:end])
                made = (key[a:b], salt[a:b], d, np.repeat(rows[start:end], count[start:end]), at[a:b], lo[a:b], hi[a:b], parts)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, schema.types, strict=True)], schema=schema)

    layout = "key long, salt int, doc_id long, row int, at int, lo int, hi int, part binary"
    records = dealt.join(places.hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "no_id", "row", "text", "places").mapInArrow(record, layout)
    found = _compared(records, reader, matcher, window)
    if some_hot:
        found = scratch.cut(found, "found")
        found = found.filter("window is null").select("doc_id", "row", "lo", "hi").unionByName(_across(found.filter("window is not null")))
    taken = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    whole = dealt.join(copies.select("doc_id", "row", F.lit(True).alias("copy")).hint("shuffle_hash"), ["doc_id", "row"], "left").join(taken.hint("shuffle_hash"), ["doc_id", "row"], "left")
    id_type = df.select(col(id_col)).schema[0].dataType

    def cut(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("no_id", pa.bool_()), ("n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

        def rows():
            for d, none, text, copy, spans in rows_of(batches, "doc_id", "no_id", "text", "copy", "spans"):
                symbols = cutter.symbols(text)
                n = len(symbols)
                merged: list[list[int]] = []
                for lo, hi in [(0, n)] if copy and n >= window else sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                yield d, none, n, sum(b - a for a, b in merged), len(merged), cutter.join(symbols, merged)

        return batches_of(rows(), schema)

    out = whole.select("doc_id", "no_id", "text", "copy", "spans").mapInArrow(cut, "doc_id long, no_id boolean, n long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).cast(id_type).alias("doc_id"), "n", "n_removed", "n_spans", "kept")


def _compared(records: DataFrame, reader: Callable, matcher: Callable, window: int) -> DataFrame:
    """(doc_id, row, lo, hi) of symbols that repeat, by comparing the records of each key and salt; and for the windows of salted records that
    don't repeat in their part, also their key and hash."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64()), ("window", pa.int64())])
        read = reader()

        def rows():
            for group in _blocks(rows_of(batches, "key", "salt", "doc_id", "row", "at", "lo", "hi", "part", step=5000)):
                for (key, salt, d, r, _, lo, _, part), repeated in zip(group, matcher(group, window), strict=True):
                    marks = repeated.tobytes()  # a byte for each window
                    for m in _RUN.finditer(marks):
                        yield d, r, lo + m.start(), lo + m.end() - 1 + window, None, None
                    if salt and b"\0" in marks:
                        hashes = gram_hashes(read(part), window).view(np.int64).tolist()
                        for j, (h, done) in enumerate(zip(hashes, marks, strict=True)):
                            if not done:
                                yield d, r, lo + j, lo + j + window, key, h

        return batches_of(rows(), schema, size=20_000)

    near = records.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc_id", "at", "row")
    return near.mapInArrow(run, _PLACES)


def _across(windows: DataFrame) -> DataFrame:
    """(doc_id, row, lo, hi) of the windows that also start earlier, in another part of their key. Equal windows have equal keys and hashes (112 bits
    together), and a part gives each window once, so a group has as many rows as its key has parts at most."""
    same = ["key", "window"]
    first = windows.groupBy(*same).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = windows.join(first, same)
    # of one row, only the first start stays
    own = met.groupBy(*same, "doc_id", "row").agg(F.min("first_id").alias("first_id"), F.min("lo").alias("least"), F.collect_list(F.struct("lo", "hi")).alias("at"))
    each = own.select("doc_id", "row", "first_id", "least", F.explode("at").alias("at"))
    return each.filter("doc_id > first_id or at.lo > least").select("doc_id", "row", "at.lo", "at.hi")


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about most, or of one row."""
    start = total = 0
    for j, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, j
            start, total = j, 0
        total += n
    if len(sizes):
        yield start, len(sizes)


def _blocks(rows: Iterator[tuple], weight: int = 8 << 20) -> Iterator[list[tuple]]:
    """Whole groups of one key and salt, several together up to weight bytes. A group has HOT records at most, or the root of its key's."""
    block: list[tuple] = []
    size, last, before = 0, None, None
    for r in rows:
        if r[:5] == before:  # a row that the table repeats: (key, salt, doc_id, row, at)
            continue
        before = r[:5]
        if r[:2] != last and size >= weight:
            yield block
            block, size = [], 0
        last = r[:2]
        block.append(r)
        size += len(r[-1]) + 200
    if block:
        yield block
