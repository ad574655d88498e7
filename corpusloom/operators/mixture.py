"""Splits, retention, caps and coverage: decisions by hashes of groups, so that they don't depend on order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _below(prefix16: Column, ratio: float) -> Column:
    """Whether 64 bits as 16 hex digits, over 2**64, are below ratio: exactly, by comparing hex strings."""
    limit = int(ratio * 2**64)
    return F.lit(True) if limit >= 2**64 else prefix16 < f"{limit:016x}"


def line_split(line: Column, ratio: float, salt: str) -> Column:
    return F.when(_below(F.substring(F.sha2(F.concat(F.lit(salt), line), 256), 1, 16), ratio), "val").otherwise("train")


def group_split(key: Column, ratio: float, salt: str) -> Column:
    return F.when(_below(F.substring(F.sha2(F.concat(F.lit(salt + "\0"), key), 256), 1, 16), ratio), "val").otherwise("train")


def priority(group: Column, salt: str = "mixture") -> Column:
    return F.sha2(F.concat(F.lit(salt + "\0"), group), 256)


def retained(group: Column, weight: Column, salt: str = "mixture") -> Column:
    """Bernoulli retention without replacement: the group's hash, as a fraction, is below its source's weight."""
    return F.conv(F.substring(priority(group, salt), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64) < weight


def groups_of(df: DataFrame, group: str = "group_id") -> DataFrame:
    """One row per group: its least (source, orthography) and its characters."""
    return df.groupBy(group).agg(F.min(F.struct("source", "orthography")).alias("_f"), F.sum("chars").alias("chars")).select(group, "_f.source", "_f.orthography", "chars")


def _fraction(hexes: Column) -> Column:
    return F.conv(F.substring(hexes, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def stratified_split(groups: DataFrame, ratio: float, group: str = "group_id", salt: str = "mixture") -> DataFrame:
    """(group, source, split): per source, by priority, max(1, min(n - 1, n * ratio rounded half to even)) groups go to validation.

    Priorities are even, so the wanted ones lie below a share of the hash space with room to spare; only those are ranked, and the last priority
    of each source that goes to validation, a small table, settles all groups without a shuffle. A source that its share doesn't cover is ranked whole.
    """
    own = priority(F.col(group), salt)
    want = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * ratio, 0).cast("long")))
    sizes = groups.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("_s"), "n", want.alias("want"))
    sizes = F.broadcast(sizes.withColumn("share", (F.col("want") + 6 * F.sqrt("want") + 20) / F.col("n")))  # one row a source

    def last(some: DataFrame) -> DataFrame:
        ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("_s").orderBy("p"))).filter("rank <= want")
        return ranked.groupBy("_s", "want").agg(F.max("p").alias("last"), F.count("*").alias("found"))

    each = groups.select("source", own.alias("p")).join(sizes, F.col("source").eqNullSafe(F.col("_s")))
    cut = last(each.filter(_fraction(F.col("p")) < F.col("share")))
    short = cut.filter("found < want").select("_s")
    rest = last(each.join(F.broadcast(short.withColumnRenamed("_s", "_short")), F.col("_s").eqNullSafe(F.col("_short")), "left_semi"))
    cuts = cut.filter("found = want").unionByName(rest).select("_s", "last")
    out = groups.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select(group, "source", F.when(own <= F.col("last"), "val").otherwise("train").alias("split"))


def capped(groups: DataFrame, member: Column, cap: float, group: str = "group_id", salt: str = "mixture") -> DataFrame:
    """groups with kept: members fit, by priority and skipping what doesn't fit, into the characters that leave them at most cap of all.

    Skipping makes it sequential, but only where the budget runs out: members before the first that doesn't fit are kept by a running sum over ranges
    of the priority, and those behind it that are larger than what is then left are out. The rest, (priority, characters) of small groups,
    runs through one task, in batches, without gathering them in memory.
    """
    flagged = groups.withColumn("_m", F.coalesce(member, F.lit(False)))
    other = flagged.filter(~F.col("_m")).agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    budget = other * cap / (1 - cap)

    kind = groups.schema[group].dataType.simpleString()
    own = flagged.filter("_m").select(group, "chars", priority(F.col(group), salt).alias("_p"))
    ranged = own.repartitionByRange(64, "_p").withColumn("_b", F.spark_partition_id())
    totals = ranged.groupBy("_b").agg(F.sum("chars").alias("_t"))
    shift = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    total = F.col("_o") + F.sum("chars").over(W.partitionBy("_b").orderBy("_p", group).rowsBetween(W.unboundedPreceding, 0))
    summed = ranged.join(F.broadcast(shift), "_b").select(group, "chars", "_p", total.alias("_sum"))
    first = summed.filter(F.col("_sum") <= budget)
    used = first.agg(F.coalesce(F.max("_sum"), F.lit(0))).first()[0]  # sums grow with the priority, so these are the first members
    rest = summed.filter((F.col("_sum") > budget) & (F.col("chars") <= budget - used)).select(group, "chars", "_p")

    def fit(batches):
        have = used
        for pdf in batches:
            kept = []
            for c in pdf["chars"]:
                kept.append(have + c <= budget)
                have += c if kept[-1] else 0
            yield pd.DataFrame({group: pdf[group], "_fits": kept})

    more = rest.orderBy("_p", group).coalesce(1).mapInPandas(fit, f"{group} {kind}, _fits boolean").filter("_fits")
    members = first.select(group).union(more.select(group)).withColumn("_fits", F.lit(True))
    out = flagged.join(members, group, "left")
    return out.withColumn("kept", ~F.col("_m") | F.coalesce("_fits", F.lit(False))).drop("_m", "_fits")


def split_stats(df: DataFrame) -> DataFrame:
    """Rows and characters by split and source, with totals."""
    return df.rollup("split", "source").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))


def coverage(df: DataFrame, required: list[str], least_rows: int = 10_000, least_share: float = 0.001) -> DataFrame:
    """For each source, whether it needs validation rows (required, or large), and whether it has them."""
    each = df.groupBy("source").agg(
        F.sum((F.col("split") == "train").cast("long")).alias("train_rows"), F.sum((F.col("split") == "val").cast("long")).alias("val_rows"), F.sum("chars").alias("chars")
    )
    share = F.col("chars") / F.greatest(F.sum("chars").over(W.partitionBy()), F.lit(1))
    need = F.col("source").isin(required) | (F.col("train_rows") >= least_rows) | (share >= least_share)
    status = F.when(F.col("train_rows") == 0, "val_only").when(F.col("val_rows") > 0, "covered").when(need, "missing_required_validation").otherwise("train_only_minor")
    return each.select("source", "train_rows", "val_rows", "chars", share.alias("share"), need.alias("needed"), status.alias("status"))


def fractions(df: DataFrame, synthetic: Column) -> DataFrame:
    """All characters, and the shares of synthetic ones and of each orthography."""
    total = F.sum("chars")
    return df.agg(total.alias("chars"), (F.sum(F.when(synthetic, F.col("chars")).otherwise(0)) / total).alias("synthetic_share"))


def budget_sample(df: DataFrame, order: list[str], budget: int, most: int = 10_000, buckets: int = 64) -> DataFrame:
    """Rows in order, each counting most characters at most, until budget characters are taken; the last is cut.

    Running sums are taken within ranges of the order and offset by the ranges' totals, a small table.
    """
    sized = df.withColumn("_n", F.least(F.length("text"), F.lit(most)).cast("long"))
    ranged = sized.repartitionByRange(buckets, *order).withColumn("_b", F.spark_partition_id())
    totals = ranged.groupBy("_b").agg(F.sum("_n").alias("_t"))
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = F.coalesce(F.sum("_n").over(W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(offsets), "_b").withColumn("before", F.col("_o") + inner)
    return placed.filter(F.col("before") < budget).withColumn("taken", F.least(F.col("_n"), budget - F.col("before"))).drop("_n", "_b", "_o")


def quota_sample(df: DataFrame, category: str, order: Column, quota: int) -> DataFrame:
    """The first quota rows of each category by a hash."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(category).orderBy(order))).filter(F.col("_r") <= quota).drop("_r")


def hash_sample(df: DataFrame, key: str, n: int, salt: str = "audit") -> DataFrame:
    """n rows of the least salted hash."""
    return df.orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), key).limit(n)


def select_groups(groups: DataFrame, weight: Column, synthetic: Column, synthetic_cap: float, minor: Column, minor_cap: float, group: str = "group_id", salt: str = "mixture", reweigh: bool = True) -> DataFrame:
    """groups with reason, null for the selected: retention by the source's weight (not again with reweigh=False, as after later removals), then the cap of synthetic
    groups, then that of a minor orthography, whose budget is measured after the synthetic removals."""
    keep = retained(F.col(group), weight, salt) if reweigh else F.lit(True)
    marked = groups.withColumn("reason", F.when(~keep, "source_weight"))
    for name, member, cap in (("synthetic_cap", synthetic, synthetic_cap), ("minor_cap", minor, minor_cap)):
        fits = capped(marked.filter("reason is null"), member, cap, group, salt).filter(~F.col("kept")).select(F.col(group).alias("_g"), F.lit(name).alias("_why"))
        marked = marked.join(fits, F.col(group) == F.col("_g"), "left").withColumn("reason", F.coalesce("reason", "_why")).drop("_g", "_why")
    return marked


def apply_mixture(docs: DataFrame, weights: dict[str, float], group: str = "group_id", salt: str = "mixture") -> DataFrame:
    """The rows of docs whose group is retained by its source's weight; a group of several sources, and a source without a weight, are errors."""
    each = docs.groupBy(group).agg(F.min("source").alias("low"), F.max("source").alias("high"))
    weight = F.lit(None).cast("double")
    for source, w in weights.items():
        weight = F.when(F.col("low") == source, F.lit(w)).otherwise(weight)
    error = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col(group))).cast("boolean")
    keep = F.when(F.col("low") != F.col("high"), error("a group of several sources")).when(weight.isNull(), error("a source without a weight")).otherwise(retained(F.col(group), weight, salt))
    return docs.join(each.filter(keep).select(group), group, "left_semi")


def mixture_check(df: DataFrame, caps: dict[str, tuple[Column, float]], slack: float = 1e-12) -> DataFrame:
    """(name, chars, share, cap, within) of each capped class among all characters."""
    total = F.sum("chars")
    row = df.agg(total.alias("total"), *(F.coalesce(F.sum(F.when(member, F.col("chars"))), F.lit(0)).alias(n) for n, (member, _) in caps.items()))
    parts = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("chars"), (F.col(n) / F.greatest("total", F.lit(1))).alias("share"), F.lit(float(cap)).alias("cap")) for n, (_, cap) in caps.items()))
    return row.select(F.explode(parts).alias("c")).select("c.*").withColumn("within", F.col("share") <= F.col("cap") + slack)


def round_robin(df: DataFrame, order: list[str], ways: int, buckets: int = 64) -> DataFrame:
    """df with way: 0, 1, ... dealt in turn in order. Rows are counted within ranges of the order, which are offset by the ranges before."""
    ranged = df.repartitionByRange(buckets, *order).withColumn("_b", F.spark_partition_id())
    totals = ranged.groupBy("_b").agg(F.count("*").alias("_t"))
    shift = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1
    return ranged.join(F.broadcast(shift), "_b").withColumn("way", F.pmod(F.col("_o") + inner, F.lit(ways)).cast("int")).drop("_b", "_o")


def category_split(df: DataFrame, category: str, key: str, share: float = 0.15, least: int = 2, salt: str = "category") -> DataFrame:
    """df with split: per category, by salted hash, max(least, floor(share n)) rows go to validation, and all of a smaller one."""
    own = F.sha2(F.concat(F.lit(salt + "\0"), F.col(key).cast("string")), 256)
    w = W.partitionBy(category)
    rank = F.row_number().over(w.orderBy(own, key))
    want = F.greatest(F.lit(least), F.floor(F.count("*").over(w) * share))
    return df.withColumn("split", F.when(rank <= want, "val").otherwise("train"))


def shuffled(df: DataFrame, key: str, salt: str) -> DataFrame:
    """df in the order of a salted hash: one order for each salt, whatever the input's."""
    return df.orderBy(F.sha2(F.concat(F.lit(salt + "\0"), F.col(key).cast("string")), 256), key)


def ranked_split(df: DataFrame, key: str, shares: dict[str, float], salt: str = "pairs") -> DataFrame:
    """df with split by rank of a salted hash: exactly the shares of the rows, rounded down, the last part taking the rest. The cuts between parts are found
    by their place in the order, so only a rank's row is fetched, not all ranks."""
    own = F.concat(F.sha2(F.concat(F.lit(salt + "\0"), F.col(key).cast("string")), 256), F.lit(":"), F.col(key).cast("string"))
    n, out, at = df.count(), None, 0.0
    hashed = df.select(own.alias("h"))
    for name, share in list(shares.items())[:-1]:
        at += share
        size = int(n * at + 1e-9)
        if size:
            last = _at_rank(hashed, size)
            out = F.when(own <= last, name) if out is None else out.when(own <= last, name)
    final = list(shares)[-1]
    return df.withColumn("split", out.otherwise(final) if out is not None else F.lit(final))


def _at_rank(hashed: DataFrame, rank: int) -> str:
    """The rank-th least of the hashes h: counts by their first three digits, then the rows of one of these 4,096 ranges."""
    counts = sorted(map(tuple, hashed.groupBy(F.substring("h", 1, 3).alias("p")).count().collect()))
    before = 0
    for p, c in counts:
        if before + c >= rank:
            return hashed.filter(F.substring("h", 1, 3) == p).orderBy("h").limit(rank - before).agg(F.max("h")).first()[0]
        before += c
    raise ValueError("the rank is beyond the rows")
