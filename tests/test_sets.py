"""Mixtures, conversations and token streams against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scoring
from corpusloom.operators import conversations, metrics, mixture
from corpusloom.operators.graph import star_components
from corpusloom.plans.scratch import cutter
from corpusloom.streaming import packing


def sha(*parts):
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def fill(members, other, cap):
    budget, used, kept = other * cap / (1 - cap), 0, set()
    for g, chars in sorted(members, key=lambda m: sha("mixture", m[0])):
        if used + chars <= budget:
            used += chars
            kept.add(g)
    return kept


def test_caps_come_in_order(spark):
    rnd = random.Random(1)
    rows = [(f"g{i}", rnd.choice(["a", "syn"]), rnd.choice(["n", "t"]), rnd.choice([0, 1, 5, 50, 900])) for i in range(300)]
    df = spark.createDataFrame(rows, "group_id string, source string, orthography string, chars long")
    weight = F.when(F.col("source") == "a", 0.8).otherwise(1.0)
    got = {r.group_id: r.reason for r in mixture.select_groups(df, weight, F.col("source") == "syn", 0.15, F.col("orthography") == "t", 0.1).collect()}
    kept = [r for r in rows if r[1] == "syn" or int(sha("mixture", r[0])[:16], 16) / 2**64 < 0.8]
    syn = fill([(r[0], r[3]) for r in kept if r[1] == "syn"], sum(r[3] for r in kept if r[1] != "syn"), 0.15)
    left = [r for r in kept if r[1] != "syn" or r[0] in syn]
    minor = fill([(r[0], r[3]) for r in left if r[2] == "t"], sum(r[3] for r in left if r[2] != "t"), 0.1)
    final = {r[0] for r in left if r[2] != "t" or r[0] in minor}
    assert {g for g, why in got.items() if why is None} == final and set(got.values()) == {None, "source_weight", "synthetic_cap", "minor_cap"}
    again = mixture.select_groups(df.join(spark.createDataFrame([(g,) for g in final], "group_id string"), "group_id"), weight, F.col("source") == "syn", 0.15, F.col("orthography") == "t", 0.1, reweigh=False)
    assert {r.reason for r in again.collect()} <= {None, "minor_cap", "synthetic_cap"}
    check = {r.name: r.within for r in mixture.mixture_check(df.join(spark.createDataFrame([(g,) for g in final], "group_id string"), "group_id"), {"syn": (F.col("source") == "syn", 0.15), "t": (F.col("orthography") == "t", 0.1)}).collect()}
    assert check["t"]


def test_mixture_of_shards(spark):
    df = spark.createDataFrame([("g1", "a"), ("g1", "a"), ("g2", "b"), ("g3", "a")], "group_id string, source string")
    got = mixture.apply_mixture(df, {"a": 1.0, "b": 0.0})
    assert sorted(r.group_id for r in got.collect()) == ["g1", "g1", "g3"]
    with pytest.raises(Exception, match="without a weight"):
        mixture.apply_mixture(df, {"a": 1.0}).collect()
    with pytest.raises(Exception, match="several sources"):
        mixture.apply_mixture(df.union(spark.createDataFrame([("g1", "b")], df.schema)), {"a": 1.0, "b": 1.0}).collect()


def test_orders_and_splits(spark):
    df = spark.createDataFrame([(i, "c" + str(i % 3)) for i in range(41)] + [(100, "rare")], "id long, category string")
    assert {r.id: r.way for r in mixture.round_robin(df, ["id"], 4, 5).collect()} == {i: n % 4 for n, i in enumerate([*range(41), 100])}
    split = mixture.category_split(df, "category", "id").groupBy("category", "split").count().collect()
    assert {(r.category, r.split): r["count"] for r in split} == {("c0", "val"): 2, ("c0", "train"): 12, ("c1", "val"): 2, ("c1", "train"): 12, ("c2", "val"): 2, ("c2", "train"): 11, ("rare", "val"): 1}
    order = [r.id for r in mixture.shuffled(df, "id", "s").collect()]
    assert order == sorted(order, key=lambda i: sha("s", str(i))) and [r.id for r in mixture.shuffled(df.orderBy(F.desc("id")), "id", "s").collect()] == order
    parts = mixture.ranked_split(df, "id", {"a": 0.5, "b": 0.25, "c": 0.25}).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"a": 21, "b": 10, "c": 11}


def turns(spark, convs):
    return spark.createDataFrame([(c, i, r, t) for c, ms in convs.items() for i, (r, t) in enumerate(ms)], "conv_id long, turn int, role string, text string")


def test_conversation_build(spark):
    u, a = "user", "assistant"
    convs = {
        1: [(u, "How is teh weather?"), (a, "It is fine, xx says.")], 2: [(u, "how is the weather"), (a, "Rain.")], 3: [(u, "Who are you?"), (a, "rain")], 4: [(u, "How is teh weather?"), (a, "It is fine, xx says.")],
        5: [(u, "Sealed question"), (a, "One")], 6: [(u, "Another"), (a, "one!")], 7: [(u, "Alone here"), (a, "Only me")],
    }
    got = {r.conv_id: r for r in conversations.build(turns(spark, convs), spark.createDataFrame([("sealed QUESTION!",)], "text string"), cutter(spark), corrections={"teh": "the"}, answer_fixes={"xx": "he"}, ratio=0.5).collect()}
    assert got[1].messages[0].text == "How is the weather?" and got[1].messages[1].text == "It is fine, he says." and got[4].reason == "duplicate" and got[4].split is None
    assert got[1].group_id == got[2].group_id == got[3].group_id != got[7].group_id and {got[5].reason, got[6].reason} == {"sealed_holdout_family"}
    assert got[1].split == got[2].split == got[3].split and got[7].split in ("train", "val")
    keys = sorted({hashlib.sha256(k.encode()).hexdigest() for k in ("user:alone here", "assistant:only me")})
    assert got[7].group_id == hashlib.sha256("\0".join(keys).encode()).hexdigest()


def test_components_of_a_long_chain(spark):
    edges = [(i, f"k{i}") for i in range(300)] + [(i + 1, f"k{i}") for i in range(300)] + [(1000 + i, "hot") for i in range(50)] + [(2000, "own")]
    df = spark.createDataFrame(edges, "conv_id long, key string")
    got = dict(map(tuple, conversations.components(df, cutter(spark)).collect()))
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)} | {2000: 2000}
    assert star_components(spark.createDataFrame([], "a long, b long"), cutter(spark)).count() == 0


def test_faults_of_sets(spark):
    u, a = "user", "assistant"
    train = turns(spark, {1: [(u, "a"), (a, "the same")], 2: [(u, "b"), (a, "the same")], 3: [(u, "q"), (a, "x")]})
    ev = turns(spark, {1: [(u, "q"), (a, "x")], 2: [(a, "no"), (u, "q")], 3: [(u, "s"), (a, " s ")]})
    category = spark.createDataFrame([("c",), ("c",), ("d",)], "category string")
    got = conversations.set_faults({"train": train, "eval": ev}, {"train": 3, "eval": 4}, most_prefix=1, category=category, most_share=0.5, required=["q", "missing"])
    assert got == ["category_share:0.6667", "count:eval:3", "duplicate_answers:1", "missing_prompt:missing", "overlap:eval:train:1", "repeated_prefix:the same:2"]
    assert conversations.set_faults({"train": ev}, {}, most_prefix=9) == []
    assert sorted(map(tuple, conversations.pair_faults(ev).collect())) == [(2, "wrong_roles"), (3, "echo")]
    faults = conversations.shape_faults(turns(spark, {1: [(u, "a"), (a, "bad: 123 123")], 2: [(a, "x"), (u, "y")]}), scoring.ENGLISH, "bad:", r"(123 ?){2}")
    assert sorted(map(tuple, faults.collect())) == [(1, "forbidden_prefix"), (1, "repetition_loop"), (1, "weak_signal"), (2, "wrong_roles")]


def rendered(spark, sizes):
    rows = [(i, [(i * 1000 + j, int(j > n // 2)) for j in range(n)]) for i, n in enumerate(sizes)]
    return rows, spark.createDataFrame(rows, "conv_id long, rendered array<struct<id: int, mask: int>>")


def test_rendering_and_its_problems(spark):
    df = turns(spark, {1: [("system", "s t"), ("user", "a"), ("assistant", "b c")], 2: [("user", "a")]})
    encode = lambda m: F.transform(F.split(m["text"], " "), lambda w: F.ascii(w))
    got = conversations.gathered(df).select("conv_id", conversations.rendered_ids(F.col("messages"), encode, 1, 2, 3, 4).alias("r"))
    out = {r.conv_id: [tuple(x) for x in r.r] for r in got.collect()}
    o = ord
    assert out[1] == [(1, 0), (2, 0), (o("s"), 0), (o("t"), 0), (o("a"), 0), (4, 0), (3, 0), (o("b"), 1), (o("c"), 1), (4, 1)]
    problems = {r.conv_id: r.p for r in got.select("conv_id", conversations.rendered_problem(F.col("r"), 9).alias("p")).collect()}
    assert problems == {1: "exceeds_row_capacity", 2: "no_supervised_target"}
    assert tuple(metrics.rendered_census(got, "r").first()) == (2, 14, 3, 10)


@pytest.mark.parametrize("world", [1, 2])
def test_rows_of_conversations(spark, world):
    rnd = random.Random(world)
    rows, df = rendered(spark, [rnd.randrange(2, 20) for _ in range(60)])
    got = sorted(packing.sft_rows(df, "conv_id", "rendered", 32, 7, world, 5).collect(), key=lambda r: (r.rank, r.row))
    want = []
    for rank in range(world):
        todo, waiting, now, mask, first = [r for r in rows if r[0] % world == rank], [], [], [], None
        consumed = 0
        while todo or waiting or now:
            while todo and len(waiting) < 5:
                waiting.append(todo.pop(0))
            if first is None:
                first = (todo[0][0] if todo else None, consumed, [w[0] for w in waiting])
            fits = [w for w in waiting if len(now) + len(w[1]) <= 33]
            if not fits:
                ids, said = now + [7] * (33 - len(now)), mask + [0] * (33 - len(mask))
                want.append((rank, ids[:-1], [i if m else -1 for i, m in zip(ids[1:], said[1:], strict=True)], len(now), first))
                now, mask, first = [], [], None
                continue
            best = max(fits, key=lambda w: len(w[1]))
            waiting.remove(best)
            now, mask, consumed = now + [x for x, _ in best[1]], mask + [m for _, m in best[1]], consumed + 1
    assert [(r.rank, r.inputs, r.targets, r.content) for r in got] == [w[:4] for w in want]
    assert all(r.supervised == sum(t >= 0 for t in r.targets) for r in got)
    assert [r.cursor.consumed for r in got] == [w[4][1] for w in want] and [r.cursor.buffer for r in got] == [w[4][2] for w in want]
    with pytest.raises(Exception, match="more than 5 tokens"):
        packing.sft_rows(df, "conv_id", "rendered", 4, 7).collect()


def test_streams_go_on_where_they_stopped(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, [i * 100 + j for j in range(rnd.randrange(1, 30))]) for i in range(40)], "doc long, tokens array<int>")
    every = {r.row: r.tokens for r in packing.pack(df, "doc", "tokens", 16).collect()}
    for row in (0, 1, 7, max(every)):
        state = packing.stream_state(df, "doc", "tokens", 16, row, "data-1")
        assert {r.row: r.tokens for r in packing.resume(df, "doc", "tokens", state, 16, "data-1").collect()} == {k: v for k, v in every.items() if k >= row}
    for bad in ({"carry": -1}, {"offset": 10_000}, {"identity": "data-2"}, {"capacity": 8}, {"document": 999}):
        with pytest.raises(ValueError):
            packing.resume(df, "doc", "tokens", state | bad, 16, "data-1")
    with pytest.raises(ValueError, match="invalid"):
        packing.resume(df, "doc", "tokens", {"row": 1}, 16, "data-1")
    rest = packing.rank_cursor(df, "doc", 1, 4, {"ordinal": 10, "epoch": 1})
    assert sorted(r.doc for r in rest.collect()) == [i for i in range(10, 40) if i % 4 == 1]
    assert re.search(r"PushedFilters|Filter", rest._jdf.queryExecution().toString())


def test_scores_of_answers(spark):
    df = spark.createDataFrame([(0, "The king and the queen"), (1, "le roi, les gens"), (2, "")], "i int, text string")
    marks = {"own": ["the ", "and "], "rival": ["le ", "les "], "other": ["der "]}
    score = scoring.generation_score(F.col("text"), scoring.ENGLISH, marks, ["queen"], "sorry")
    got = {r.i: r.s for r in df.select("i", score.alias("s")).collect()}
    assert got[0].is_own and got[0].mentions and not got[0].too_short and got[1].rival_dominant and not got[1].is_own and got[2].too_short
    check = {r.i: r.c for r in df.select("i", scoring.response_check(F.col("text"), scoring.ENGLISH, ["king"], ["queen"]).alias("c")).collect()}
    assert check[0] == "holds_excluded" and check[2] == "wrong_language"
    rates = metrics.language_rates(df, score).first()
    assert rates.answers == 3 and rates.is_own_rate == 0.3333
    report = metrics.detection_report(spark.createDataFrame([(4.0, "accept"), (1.0, "reject")], "score double, decision string")).first()
    assert (report.rows, report.average_score, report.accept_rate) == (2, 2.5, 0.5)
    profile = scoring.LanguageProfile("A-Za-z", "Ѐ-ӿ", "wk", scoring.ENGLISH.own, names=("PySpark",), code=True)
    rows = spark.createDataFrame([("PySpark `the the` https://x.org/the and of the in to",), ("def f(x):\n  return {x}; the and of in",)], "t string")
    a, b = (r.d for r in rows.select(scoring.detect(F.col("t"), profile, least=1).alias("d")).collect())
    assert "url_present" in a.reasons and "no_marker_letters" in a.reasons and "code_present" in b.reasons


def test_offsets_of_more_rows_than_ranges_are_drawn_from(spark):
    # ranges of a table of this size are drawn from a sample, which two uses of a partitioning don't share
    n = 60_000
    df = spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.pmod(F.col("id") * 7, F.lit(5)).cast("int")), lambda i: F.col("id") * 10 + i).alias("t")).repartition(3)
    sizes = [7 * i % 5 + 1 for i in range(n)]
    starts = [0]
    for k in sizes:
        starts.append(starts[-1] + k)
    assert {r.id: r.offset for r in packing.offsets(df, "id", F.size("t")).select("id", "offset").collect()} == dict(enumerate(starts[:-1]))
    stream = [10 * i + j for i, k in enumerate(sizes) for j in range(k)]
    rows = dict(map(tuple, packing.pack(df, "id", "t", 512).collect()))
    assert rows == {r: stream[r * 512 : r * 512 + 513] for r in range((len(stream) - 1) // 512)}
