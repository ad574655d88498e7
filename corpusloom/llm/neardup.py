"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

Each distinct set of word shingles is a node with K symbols of 16 bits, one per hash function. Signatures are cut into chunks; two
signatures within the distance D agree, by pigeonhole, on some chunk but for the allowed number of errors (one).
Every chunk gives one key for each place where the error may be, so all pairs within D meet under a key. D is set so
that a pair at the similarity threshold is farther apart with a probability of one in a million at most.

Members of a key aren't paired with each other. Each is paired with the key's leader, the member that meets most others; links are
confirmed on full sets, and nodes in one component need no further pair. Where members of a key other than the leader still lie
in different components, an exact prefix and position filter over their full sets finds every link that is left.

Defined cases: null or empty texts, and texts without words, have no shingles and are linked with nothing; with fewer words than
a shingle takes, the whole sequence is one; repeated rows are copies of each other; a null id is never a component's id
unless all its members have none; ties between ids need no rule, as ids are compared only. Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import Memo, Scratch, batches_of, col, id_text, rows_of, small, small_batches, unused
from corpusloom.llm.graph import components

SYMBOLS = 64
_P = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, 512, dtype=np.uint64)


class Words(Memo):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        return self.put(word, xxhash.xxh3_64_intdigest(word), 180 + len(word))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    with np.errstate(over="ignore"):
        h = hashes[: n - k + 1] + np.uint64(k)
        for j in range(1, k):
            h = h * _P + hashes[j : n - k + 1 + j]
    return np.unique(_mix(h))


def signature(values: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    low = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    a, b = _A[:symbols], _B[:symbols]
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 4096):
            x = values[at : at + 4096, None] * a
            x += b
            np.minimum(low, x.min(0), out=low)
    return (_mix(low) >> np.uint64(48)).astype(np.uint16)


def node_of(values: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The id of a set, of so many bits, and 64 bits more that tell sets of one id apart."""
    high, low = divmod(xxhash.xxh3_128_intdigest(values.tobytes()), 1 << 64)
    return (low & (1 << bits) - 1) - (1 << 63), high - (1 << 63)


def _apart(df: DataFrame, met: DataFrame | None) -> DataFrame:
    """df with ids of their own for the sets whose ids (met) several sets share."""
    if met is None:
        return df
    own = F.when(F.col("_met").isNotNull(), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return df.join(small(met), F.col("node") == F.col("_met"), "left").withColumn("node", own).drop("_met")


def safe_distance(percent: int, symbols: int = SYMBOLS, miss: float = 1e-6) -> int:
    """The least D that a pair of similarity percent / 100 passes with probability at most miss."""
    p, left, d = 1 - percent / 100, 1.0, -1
    while left > miss and d < symbols:
        d += 1
        left -= math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
    return d


def chunks(distance: int, symbols: int = SYMBOLS) -> list[tuple[int, int]]:
    """Chunks so many that a pair within distance has one with one error at most."""
    m = min(distance // 2 + 1, symbols // 2)
    cuts = [round(i * symbols / m) for i in range(m + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def chunk_keys(sigs: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """(rows, symbols) keys: for each chunk and each place of the one allowed error, a hash of the other symbols."""
    out = []
    with np.errstate(over="ignore"):
        for a, b in parts:
            for gap in range(a, b):
                h = np.full(len(sigs), gap + 1, np.uint64)
                for j in range(a, b):
                    if j != gap:
                        h = h * _P + sigs[:, j].astype(np.uint64) + np.uint64(1)
                out.append(_mix(h))
    return np.stack(out, 1).view(np.int64)


def _ids(df: DataFrame, id_col: str):
    return df.select(col(id_col)).schema[0].dataType


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int, symbols: int = SYMBOLS, bits: int = 64) -> DataFrame:
    """doc_id, the text's hash, n_shingles, node and check (null without words) and signature of each row; no shuffle."""
    small_batches(df.sparkSession)
    kind = _ids(df, id_col)
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        words = Words()

        def rows():
            for i, h, text in rows_of(batches, "doc_id", "text_hash", "text"):
                s = shingles(words.hashes(text.lower().split()), shingle)
                yield (i, h, len(s), *node_of(s, bits), signature(s, symbols).tobytes()) if len(s) else (i, h, 0, None, None, None)

        return batches_of(rows(), schema)

    return id_text(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, text_hash long, n_shingles long, node long, check long, sig binary")


def _full_sets(df: DataFrame, id_col: str, text_col: str, shingle: int, bits: int = 64) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches):
        words = Words()

        def rows():
            for (text,) in rows_of(batches, "text"):
                s = shingles(words.hashes(text.lower().split()), shingle)
                if len(s):
                    yield *node_of(s, bits), len(s), s.view(np.int64)

        return batches_of(rows(), schema, size=200)

    return id_text(df, id_col, text_col).mapInArrow(run, "node long, check long, n long, members array<long>")


def _within(distance: int, symbols: int):
    @F.pandas_udf("boolean")
    def within(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(map(bytes, s)), np.uint16).reshape(-1, symbols) for s in (x, y))
        return pd.Series((a != b).sum(1) <= distance)

    return within


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("members").alias("xs"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("members").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys")).cast("long")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", both.alias("both")).filter(F.expr(f"100 * both >= {percent} * (na + nb - both)")).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, symbols: int = SYMBOLS, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links of percent / 100 or more), kept, node and text_hash of each row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    distance = safe_distance(percent, symbols)
    parts = chunks(distance, symbols)
    signed = scratch.cut(signatures(df, id_col, text_col, shingle, symbols, bits), "signed")

    def nodes_of(rows: DataFrame) -> DataFrame:
        each = rows.filter("node is not null").groupBy("node")
        return scratch.cut(each.agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), (F.min("check") < F.max("check")).alias("met")), "nodes")

    # exact copies of a set are one node; different sets of one 64-bit id, of which there are few or none, are told apart by 64 bits more
    nodes, met = nodes_of(signed), None
    if nodes.filter("met").limit(1).count():
        met = scratch.cut(nodes.filter("met").select(F.col("node").alias("_met")), "met")
        signed = scratch.cut(_apart(signed, met), "signed")
        nodes = nodes_of(signed)

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, symbols)
                flat = pa.array(chunk_keys(sigs, parts).reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, symbols, dtype=np.int32)), flat)], names=["node", "keys"])

    keys = nodes.select("node", "sig").mapInArrow(keyed, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    buckets = scratch.cut(keys.join(shared, "key"), "buckets")
    meets = buckets.groupBy("node").agg(F.sum("c").alias("meets"))
    leaders = buckets.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node"))["node"].alias("leader"))
    led = scratch.cut(buckets.join(leaders, "key").select("key", "node", "leader"), "led")
    pairs = led.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    sig = nodes.select("node", "sig")
    near = _within(distance, symbols)
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").filter(near("sa", "sb")).select("a", "b")
    pairs = scratch.cut(pairs, "pairs")

    # full sets of the nodes that share a key, from one document each
    wanted = scratch.cut(buckets.select("node").distinct().join(nodes.select("node", "least_id"), "node"), "wanted")
    ids = wanted.select(F.col("least_id").alias("wanted_id")).dropna()
    source = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    some = source.join(small(ids), source["doc_id"] == F.col("wanted_id"), "left_semi").union(source.filter("doc_id is null"))
    sets = scratch.cut(_apart(_full_sets(some, "doc_id", "text", shingle, bits), met).select("node", "n", "members").dropDuplicates(["node"]), "sets")

    links = scratch.cut(_linked(pairs, sets, percent), "links")
    labels = components(links, scratch)

    # members of a key, other than its leader, in different components
    own = F.coalesce("label", "node")
    rest = led.filter("node <> leader").join(labels, "node", "left").select("key", "node", own.alias("label"))
    open_keys = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    unsure = scratch.cut(rest.join(open_keys, "key").select("node", "label").distinct(), "unsure")
    more = scratch.cut(_linked(_prefix_pairs(unsure, sets, percent, scratch), sets, percent), "more")
    # links between components, if there are any, join them: the stars stand for the links that made them
    final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), scratch) if more.limit(1).count() else labels

    # a component may hold a third of all nodes, so its least id comes by broadcast; nodes in no link are their own
    comp = scratch.cut(final.join(nodes.select("node", "least_id"), "node"), "comp")
    least = scratch.cut(comp.groupBy("label").agg(F.min("least_id").alias("component_id")), "least")
    scratch.drop(buckets, led, pairs, wanted, sets, links, labels, unsure, more, *([final] if final is not labels else []))  # the result reads signed, nodes, comp and least
    linked = comp.join(small(least), "label").select("node", "component_id")
    alone = nodes.join(comp.select("node"), "node", "left_anti").select("node", F.col("least_id").alias("component_id"))
    of_node = linked.unionByName(alone)
    out = signed.join(of_node, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"), "node", "text_hash")


def _prefix_pairs(unsure: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs of unsure nodes (node, label) of different labels that may be similar enough.

    Shingles are ordered by how many of these sets hold them, the rarest first; similar sets share one among their first
    n - ceil(percent n / 100) + 1, and what stands behind it in either set must suffice for the overlap.
    """
    each = sets.join(unsure, "node").select("node", "label", "n", F.explode("members").alias("x"))
    df = each.groupBy("x").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    placed = each.join(df, "x").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x", (F.col("lo") < F.col("hi")).alias("of_use")))).alias("ordered"))
    first = F.expr(f"slice(ordered, 1, cast(n - (({percent} * n + 99) div 100) + 1 as int))")
    posted = placed.select("node", "label", "n", F.posexplode(first).alias("pos", "e")).filter("e.of_use").select("node", "label", "n", "pos", F.col("e.x").alias("x"))
    posted = scratch.cut(posted, "posted")
    a, b = posted.alias("a"), posted.alias("b")
    # At the first shingle that a pair shares, nothing before it is shared, so the overlap is 1 and what stands behind it at
    # most. A pair of percent / 100 needs an overlap of percent / (100 + percent) of both sizes, so it passes there.
    enough = f"(100 + {percent}) * (1 + least(a.n - a.pos - 1, b.n - b.pos - 1)) >= {percent} * (a.n + b.n)"
    found = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.label") < F.col("b.label")) & F.expr(enough))
    return found.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def op9_result(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """df with one document of each group of near-duplicates, with all columns; of rows that repeat an id and its words, one."""
    scratch = Scratch(df.sparkSession, "kept")
    found = scratch.cut(near_duplicates(df, id_col, text_col, shingle=shingle, percent=percent), "found")
    # of several texts of one id and one set, the one of the least hash stays
    one = found.filter("kept and node is not null").groupBy("doc_id", "node").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most"), F.count("*").alias("rows"))
    one = scratch.cut(one.filter("rows > 1"), "repeated")
    others = found.filter("kept").join(small(one.filter("least < most").select("doc_id", "node", "least")), ["doc_id", "node"]).filter("text_hash > least")
    i, h = unused("_id", df), unused("_hash", df)
    dropped = found.filter("not kept").select("doc_id", "text_hash").union(others.select("doc_id", "text_hash")).distinct().select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    dropped = scratch.cut(dropped, "dropped")
    same = col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(col(text_col), F.lit("")).cast("binary")) == F.col(h))
    out = df.join(small(dropped), same, "left_anti")
    repeated = one.filter("doc_id is not null").select(F.col("doc_id").alias(i), F.col("least").alias(h))
    if repeated.limit(1).count():
        again = out.join(small(repeated), same, "left_semi").dropDuplicates([id_col, text_col])
        out = out.join(small(repeated), same, "left_anti").union(again)
    scratch.drop(found)  # the result reads the others
    return out


def brute_components(rows: list[tuple], shingle: int = 5, percent: int = 80) -> list[tuple]:
    """The same by comparing all pairs, for tests: (doc_id, n_shingles, component_id, kept)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(shingle, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return [(d, len(sets[i]), c, d == c) for i, (d, _) in enumerate(rows) for c in [least.get(find(i), d)]]
