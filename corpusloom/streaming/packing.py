"""Token streams as tables: lossless packing, rank partitions, best-fit packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offsets(df: DataFrame, order: str, length: Column, buckets: int = 64) -> DataFrame:
    """df with offset: the lengths before each row in order. Sums run within ranges of the order and are shifted by the ranges' totals.

    The ranges' bounds are collected once: each use of a range partitioning samples its bounds anew, so sums and totals would be of different ranges.
    """
    bounds = df.select(order).repartitionByRange(buckets, order).groupBy(F.spark_partition_id().alias("_b")).agg(F.min(order).alias("least"))
    bounds = sorted(r.least for r in bounds.collect() if r.least is not None)
    kind = df.schema[order].dataType
    bucket = F.size(F.filter(F.array(*(F.lit(x).cast(kind) for x in bounds)), lambda x: x <= F.col(order))) if bounds else F.lit(0)
    sized = df.withColumn("_n", F.greatest(length.cast("long"), F.lit(0))).withColumn("_b", F.when(F.col(order).isNull(), 0).otherwise(bucket))
    totals = sized.groupBy("_b").agg(F.sum("_n").alias("_t"))
    shifts = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = F.coalesce(F.sum("_n").over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("_i", inner).join(F.broadcast(shifts), "_b").withColumn("offset", F.col("_o") + F.col("_i")).drop("_n", "_b", "_o", "_i")


def pack(df: DataFrame, order: str, tokens: str, capacity: int) -> DataFrame:
    """(row, tokens) of capacity + 1 tokens: the documents' tokens in order, cut at every capacity-th; neighbours share one token.
    Only complete rows. Documents are shuffled as slices, one for each row they have a share in."""
    placed = offsets(df.select(order, tokens), order, F.size(tokens)).filter(F.size(tokens) > 0)
    end = F.col("offset") + F.size(tokens)
    first = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("offset") / capacity) - 1)
    each = placed.select("offset", end.alias("end"), tokens, F.explode(F.sequence(first, F.floor((end - 1) / capacity))).alias("row"))
    start = F.greatest(F.col("offset"), F.col("row") * capacity)
    some = F.slice(tokens, (start - F.col("offset") + 1).cast("int"), (F.least("end", (F.col("row") + 1) * capacity + 1) - start).cast("int"))
    rows = each.select("row", start.alias("start"), some.alias("some")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "some"))).alias("t"))
    rows = rows.select("row", F.flatten(F.transform("t", lambda x: x["some"])).alias("tokens"))
    return rows.filter(F.size("tokens") == capacity + 1)


def rank_rows(df: DataFrame, ordinal: str, rank: int, world: int) -> DataFrame:
    return df.filter(F.pmod(F.col(ordinal), F.lit(world)) == rank)


def rank_cursor(df: DataFrame, ordinal: str, rank: int, world: int, state: dict | None = None) -> DataFrame:
    """The rank's rows from a cursor on: those of ordinal % world = rank and, with state {ordinal, epoch, identity}, of ordinals from state's on. Both are plain
    filters, so row groups outside are skipped by their statistics. The caller goes on with epoch + 1 and ordinal 0 after the last."""
    if not 0 <= rank < world:
        raise ValueError("the rank must be below the number of ranks")
    out = rank_rows(df, ordinal, rank, world)
    if state is not None:
        if state["ordinal"] < 0 or state["epoch"] < 1:
            raise ValueError("invalid cursor")
        out = out.filter(F.col(ordinal) >= state["ordinal"])
    return out


def stream_state(df: DataFrame, order: str, tokens: str, capacity: int, row: int, identity: str) -> dict:
    """What is needed to go on before row number row of pack(): the document in progress, how many of its tokens are used, and the token that both rows share.
    row 0 is the start."""
    if row == 0:
        return {"identity": identity, "capacity": capacity, "document": None, "offset": 0, "carry": None, "row": 0}
    place = row * capacity  # of the shared token, which is used up as the last of the row before
    found = offsets(df.select(order, tokens), order, F.size(tokens)).filter((F.col("offset") <= place) & (F.col("offset") + F.size(tokens) > place)).first()
    if found is None:
        raise ValueError(f"there is no row {row}")
    at = place - found["offset"]
    return {"identity": identity, "capacity": capacity, "document": found[order], "offset": at + 1, "carry": found[tokens][at], "row": row}


def resume(df: DataFrame, order: str, tokens: str, state: dict, capacity: int, identity: str) -> DataFrame:
    """(row, tokens) of pack() from a state on, read from its document only. The state is refused if it is of other data, another tokenizer or row size, or
    if the token it carries isn't the one at its place."""
    if set(state) != {"identity", "capacity", "document", "offset", "carry", "row"}:
        raise ValueError("invalid state")
    if state["identity"] != identity or state["capacity"] != capacity:
        raise ValueError("the state is of other data, another tokenizer or row size")
    if state["document"] is None:
        if state["offset"] or state["carry"] is not None or state["row"]:
            raise ValueError("a state at the start has no offset, carry or row")
        return pack(df, order, tokens, capacity)
    current = df.filter(F.col(order) == state["document"]).select(tokens).first()
    if current is None or not 0 < state["offset"] <= len(current[0]) or current[0][state["offset"] - 1] != state["carry"]:
        raise ValueError("the state's carry or offset disagrees with its document")
    rest = df.filter(F.col(order) >= state["document"]).select(order, F.when(F.col(order) == state["document"], F.expr(f"slice({tokens}, {state['offset']}, greatest(size({tokens}) - {state['offset'] - 1}, 0))")).otherwise(F.col(tokens)).alias(tokens))
    return pack(rest, order, tokens, capacity).withColumn("row", F.col("row") + state["row"])


def sft_rows(df: DataFrame, order: str, rendered: str, capacity: int, bos: int, world: int = 1, buffer: int = 100) -> DataFrame:
    """(rank, row, inputs, targets, content, supervised, cursor): rendered conversations (arrays of id and mask) packed by best_fit's rule into rows of capacity + 1 tokens, filled up
    with bos; targets are the next tokens, -1 where nothing is learned. cursor (next, consumed, buffer: conversations waiting) is the state before the row, from
    which packing can go on. A conversation that can't be trained on is an error: filter by conversations.rendered_problem first."""
    kind = df.schema[order].dataType.simpleString()
    schema = f"rank int, row long, inputs array<int>, targets array<int>, content int, supervised int, cursor struct<next: {kind}, consumed: long, buffer: array<{kind}>>"

    def run(batches):
        size = capacity + 1
        waiting: list[tuple] = []
        rank, row, consumed, now, mask, before = None, 0, 0, [], [], None
        out: list[tuple] = []

        def close():
            nonlocal row, now, mask, before
            content = len(now)
            ids, said = now + [bos] * (size - content), mask + [0] * (size - content)
            targets = [i if m else -1 for i, m in zip(ids[1:], said[1:], strict=True)]
            out.append((rank, row, ids[:-1], targets, content, sum(t >= 0 for t in targets), before))
            row, now, mask, before = row + 1, [], [], None

        def take(more: bool, following):
            nonlocal consumed, before
            while waiting and (not more or len(waiting) >= buffer):
                if before is None:
                    before = {"next": following, "consumed": consumed, "buffer": [w[0] for w in waiting]}
                fits = [(-len(w[1]), i) for i, w in enumerate(waiting) if len(now) + len(w[1]) <= size]
                if not fits:
                    if not now:
                        raise ValueError(f"conversation {waiting[0][0]} has more than {size} tokens")
                    close()
                    continue
                _, ids, said = waiting.pop(min(fits)[1])
                now.extend(ids)
                mask.extend(said)
                consumed += 1
                if len(now) == size:
                    close()

        def made():
            frame = pd.DataFrame(out, columns=["rank", "row", "inputs", "targets", "content", "supervised", "cursor"])
            out.clear()
            return frame

        for pdf in batches:
            for r, conv, both in zip(pdf["_r"], pdf[order], pdf[rendered], strict=True):
                if r != rank:
                    take(False, None)
                    if now:
                        close()
                    rank, row, consumed = int(r), 0, 0
                take(True, conv)
                waiting.append((conv, [x["id"] for x in both], [x["mask"] for x in both]))
            yield made()
        take(False, None)
        if now:
            close()
        yield made()

    ranked = df.select(F.pmod(F.col(order), F.lit(world)).cast("int").alias("_r"), order, rendered)
    return ranked.repartition(world, "_r").sortWithinPartitions("_r", order).mapInPandas(run, schema)


def best_fit(df: DataFrame, order: str, length: str, capacity: int, world: int = 1, buffer: int = 100) -> DataFrame:
    """(rank, row, conv, at): conversations packed into rows of capacity: from a buffer that is refilled in order, the longest that fits, the first
    on ties. Sequential within a rank, and streamed through it in batches; ranks run in parallel. Conversations longer than capacity have no
    row; best_fit_or_problem() returns them too."""
    kind = df.schema[order].dataType.simpleString()

    def run(batches):
        waiting: list[tuple] = []
        row = used = 0
        out: list[tuple] = []
        rank = None

        def take(more: bool):
            nonlocal row, used
            while waiting and (not more or len(waiting) >= buffer):
                fits = [(-n, i) for i, (_, n) in enumerate(waiting) if used + n <= capacity]
                if not fits:
                    if not used:  # longer than any row: left out
                        waiting.pop(0)
                        continue
                    row, used = row + 1, 0
                    continue
                conv, n = waiting.pop(min(fits)[1])
                out.append((rank, row, conv, used))
                used += n

        for pdf in batches:
            for r, conv, n in zip(pdf["_r"], pdf[order], pdf[length], strict=True):
                if r != rank:
                    take(False)
                    rank, row, used = int(r), 0, 0
                waiting.append((conv, int(n)))
                take(True)
            yield pd.DataFrame(out, columns=["rank", "row", "conv", "at"])
            out.clear()
        take(False)
        yield pd.DataFrame(out, columns=["rank", "row", "conv", "at"])

    ranked = df.select(F.pmod(F.col(order), F.lit(world)).cast("int").alias("_r"), order, length)
    return ranked.repartition(world, "_r").sortWithinPartitions("_r", order).mapInPandas(run, f"rank int, row long, conv {kind}, at long")


def best_fit_or_problem(df: DataFrame, order: str, length: str, capacity: int, world: int = 1, buffer: int = 100) -> DataFrame:
    """(rank, row, conv, at, problem): best_fit, and each conversation longer than capacity with a null row and a problem, since it must be split first."""
    rank = F.pmod(F.col(order), F.lit(world)).cast("int").alias("rank")
    said = F.concat(F.lit("exceeds_row_capacity: "), F.col(length).cast("string"), F.lit(f" > {capacity}"))
    long = df.filter(F.col(length) > capacity).select(rank, F.lit(None).cast("long").alias("row"), F.col(order).alias("conv"), F.lit(None).cast("long").alias("at"), said.alias("problem"))
    return best_fit(df, order, length, capacity, world, buffer).withColumn("problem", F.lit(None).cast("string")).unionByName(long)
