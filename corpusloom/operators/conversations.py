"""Conversations of (conv_id, turn, role, text) rows: shape, pairs, duplicates, families, leakage, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scoring
from corpusloom.functions.text import SPACE, canonical, family, substitute
from corpusloom.operators import mixture
from corpusloom.operators.dedup import first_wins
from corpusloom.operators.graph import star_components


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): messages in the order of turns, as (turn, role, text). A conversation is a bounded group."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def problem(messages: Column) -> Column:
    """First fault of a conversation's shape, or null: an optional system message, then complete user/assistant pairs of non-blank text."""
    body = F.when(F.element_at(messages, 1)["role"] == "system", F.slice(messages, 2, F.size(messages))).otherwise(messages)
    blank = F.exists(messages, lambda m: F.length(F.regexp_replace(F.coalesce(m["text"], F.lit("")), SPACE, "")) == 0)
    order = F.forall(F.transform(body, lambda m, i: F.coalesce(m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False))), lambda ok: ok)
    return F.when(F.size(messages) == 0, "empty").when(blank, "blank_message").when(F.size(body) == 0, "no_pairs").when(~order, "roles_out_of_order").when(F.size(body) % 2 == 1, "incomplete_pair")


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, answer) of each user message that an assistant message follows directly."""
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")).where(F.col("role") == "assistant")
    return turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt")).join(nxt, ["conv_id", "turn"])


def conversation_hash(messages: Column, is_nfc: bool = True) -> Column:
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x01"), canonical(m["text"], is_nfc))), "\x02"), 256)


def family_edges(turns: DataFrame, wrappers: tuple[str, ...] = (), is_nfc: bool = True) -> DataFrame:
    """(conv_id, key) of each message but system ones; conversations with a key in common belong together."""
    return turns.filter("role <> 'system'").select("conv_id", F.concat(F.col("role"), F.lit(":"), family(F.col("text"), wrappers, is_nfc=is_nfc)).alias("key")).distinct()


def components(edges: DataFrame, cut, node: str = "conv_id") -> DataFrame:
    """(node, component): the least node that is reachable over common keys. Each key links its nodes to its least one, so a key of very many
    nodes has as many links, and the links are contracted to stars."""
    first = edges.groupBy("key").agg(F.min(node).alias("a"))
    links = edges.join(first, "key").select("a", F.col(node).alias("b"))
    labels = star_components(links, cut)
    every = edges.select(F.col(node).alias("node")).distinct()
    return every.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def sealed(comps: DataFrame, edges: DataFrame, keys: DataFrame, node: str = "conv_id") -> DataFrame:
    """Components of which any member has a sealed key."""
    bad = edges.join(keys, "key", "left_semi").select(F.col(node).alias("node"))
    return comps.join(bad, "node", "left_semi").select("component").distinct()


def prefix_counts(turns: DataFrame, n: int = 3) -> DataFrame:
    """Answers by their first n words, and the share of the most frequent beginnings."""
    head = F.array_join(F.slice(F.split(F.trim(F.lower("text")), f"{SPACE}+"), 1, n), " ").alias("prefix")
    counts = turns.filter("role = 'assistant'").select(head).groupBy("prefix").agg(F.count("*").alias("rows"))
    return counts


def render(messages: Column, bos: str = "<s>", user: str = "<user>", assistant: str = "<assistant>", end: str = "<end>") -> Column:
    """One string: a system message is folded into the first user message, each message stands between its marks."""
    has = F.element_at(messages, 1)["role"] == "system"
    body = F.when(has, F.slice(messages, 2, F.size(messages))).otherwise(messages)
    lead = F.when(has, F.concat(F.element_at(messages, 1)["text"], F.lit("\n\n"))).otherwise("")
    parts = F.transform(body, lambda m, i: F.concat(F.when(m["role"] == "user", user).otherwise(assistant), F.when(i == 0, lead).otherwise(""), m["text"], F.lit(end)))
    return F.concat(F.lit(bos), F.array_join(parts, ""))


def build(turns: DataFrame, sealed_texts: DataFrame, cut, *, corrections: dict[str, str] | None = None, answer_fixes: dict[str, str] | None = None, wrappers: tuple[str, ...] = (), ratio: float = 0.2, salt: str = "conversations", is_nfc: bool = False) -> DataFrame:
    """(conv_id, messages, group_id, split, reason): users' phrases corrected, literal fixes in answers, exact copies dropped (reason duplicate), conversations that
    share a message's family in one group, groups that hold a sealed prompt (sealed_texts: text) quarantined as a whole, the others
    split by the hash of their families. Rows with a null reason are published, ordered by their messages."""
    user = substitute(F.col("text"), corrections or {})
    answer = F.col("text")
    for old, new in (answer_fixes or {}).items():
        answer = F.replace(answer, F.lit(old), F.lit(new))
    turns = cut(turns.withColumn("text", F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", answer).otherwise(F.col("text"))))
    convs = gathered(turns).withColumn("hash", conversation_hash(F.col("messages"), True))
    convs = cut(first_wins(convs, "hash", ["conv_id"]))
    kept = convs.filter("kept").select("conv_id")
    edges = cut(family_edges(turns.join(kept, "conv_id", "left_semi"), wrappers, is_nfc))
    comps = cut(components(edges, cut))
    prompts = sealed_texts.select(F.concat(F.lit("user:"), family(F.col("text"), wrappers, is_nfc=is_nfc)).alias("key")).distinct()
    bad = sealed(comps, edges, prompts).withColumn("sealed", F.lit(True))
    # a group's id is the digest of its families, so it doesn't depend on numbering; the families' digests are what is gathered
    prints = edges.join(comps, edges["conv_id"] == comps["node"]).select("component", F.sha2("key", 256).alias("print")).distinct()
    groups = prints.groupBy("component").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("print")), "\0"), 256).alias("group_id"))
    of = comps.join(groups, "component").join(bad, "component", "left").select(F.col("node").alias("_node"), "group_id", "sealed")
    out = convs.join(of, convs["conv_id"] == of["_node"], "left")
    reason = F.when(~F.col("kept"), "duplicate").when(F.col("sealed"), "sealed_holdout_family")
    return out.select("conv_id", "messages", "group_id", F.when(reason.isNull(), mixture.group_split(F.col("group_id"), ratio, salt)).alias("split"), reason.alias("reason"))


def whole_overlap(parts: dict[str, DataFrame]) -> DataFrame:
    """(hash, left, right) of conversations that stand in two of the named parts (each of turns)."""
    out = None
    names = sorted(parts)
    hashed = {n: gathered(parts[n]).select(conversation_hash(F.col("messages")).alias("hash")).distinct() for n in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            found = hashed[a].intersect(hashed[b]).select("hash", F.lit(a).alias("left"), F.lit(b).alias("right"))
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("an overlap needs two parts")
    return out


def set_faults(parts: dict[str, DataFrame], counts: dict[str, int], train: str = "train", *, prefix_words: int = 3, most_prefix: int = 5, category: DataFrame | None = None, most_share: float = 0.15, required: list[str] | None = None, asked: str = "eval") -> list[str]:
    """Faults of a set of conversations, as a sorted list; none means it passes: counts, conversations in two parts, repeated answers and beginnings of answers
    in train, a category's share (category: one row an item), and required prompts that aren't asked."""
    faults = [f"count:{n}:{found}" for n, want in counts.items() if (found := parts[n].select("conv_id").distinct().count()) != want]
    faults += [f"overlap:{r.left}:{r.right}:{r.n}" for r in whole_overlap(parts).groupBy("left", "right").agg(F.count("*").alias("n")).collect()] if len(parts) > 1 else []
    answers = parts[train].filter("role = 'assistant'").select("text")
    total, distinct = answers.agg(F.count("*"), F.countDistinct("text")).first()
    faults += [f"duplicate_answers:{total - distinct}"] if total > distinct else []
    top = prefix_counts(parts[train], prefix_words).orderBy(F.desc("rows"), "prefix").first()
    faults += [f"repeated_prefix:{top.prefix}:{top.rows}"] if top and top.rows > most_prefix else []
    if category is not None:
        share = category.groupBy("category").count().agg(F.max("count") / F.sum("count")).first()[0]
        faults += [f"category_share:{share:.4f}"] if share is not None and share > most_share else []
    if required:
        have = {r.text for r in parts[asked].filter(F.col("text").isin(required)).select("text").distinct().collect()}  # required is a hand-written list
        faults += [f"missing_prompt:{p}" for p in sorted(set(required) - have)]
    return sorted(faults)


def shape_faults(turns: DataFrame, answer: scoring.LanguageProfile, prefix: str, loop: str) -> DataFrame:
    """(conv_id, fault) of raw conversations: those without a first user and second assistant message, and faults of the first answer."""
    convs = gathered(turns)
    roles = F.transform("messages", lambda m: m["role"])
    wrong = (F.size(roles) < 2) | (F.get(roles, F.lit(0)) != "user") | (F.get(roles, F.lit(1)) != "assistant")
    first = F.get("messages", F.lit(1))["text"]
    faults = F.when(wrong, F.array(F.lit("wrong_roles"))).otherwise(scoring.answer_faults(first, answer, prefix, loop))
    return convs.select("conv_id", F.explode(faults).alias("fault"))


def pair_faults(turns: DataFrame) -> DataFrame:
    """(conv_id, fault) of conversations that aren't exactly one user and one assistant message of different, non-blank text."""
    convs = gathered(turns).withColumn("n", F.size("messages"))
    text = lambda i: F.trim(F.coalesce(F.get("messages", F.lit(i))["text"], F.lit("")))
    role = lambda i: F.get("messages", F.lit(i))["role"]
    fault = F.when(F.col("n") != 2, "not_a_pair").when((role(0) != "user") | (role(1) != "assistant"), "wrong_roles").when((text(0) == "") | (text(1) == ""), "blank").when(text(0) == text(1), "echo")
    return convs.select("conv_id", fault.alias("fault")).filter("fault is not null")


def contrast_pairs(prompts: DataFrame, chosen: str, rejected: str, marks: tuple[str, ...]) -> DataFrame:
    """(conv_id, prompt, chosen, rejected) for prompts (conv_id, prompt) that hold one of marks, which ask for another language: the answer to give, and the one not to."""
    low, hit = F.lower("prompt"), F.lit(False)
    for m in marks:
        hit = hit | low.contains(m.lower())
    return prompts.filter(hit).select("conv_id", "prompt", F.lit(chosen).alias("chosen"), F.lit(rejected).alias("rejected"))


def rendered_ids(messages: Column, encode, bos: int, user: int, assistant: int, end: int) -> Column:
    """array of (id, mask): marks and token ids in order, a system message folded into the first user's, mask 1 for what a model learns to say: answers
    and their end marks. encode gives the ids of a text column, or messages have them as ids already."""
    has = F.element_at(messages, 1)["role"] == "system"
    body = F.when(has, F.slice(messages, 2, F.size(messages))).otherwise(messages)
    lead = F.when(has, encode(F.element_at(messages, 1))).otherwise(F.array().cast("array<int>"))

    def one(m: Column, i: Column) -> Column:
        own = m["role"] == "assistant"
        text = F.concat(F.when(i == 0, lead).otherwise(F.array().cast("array<int>")), encode(m))
        said = lambda x, mask: F.struct(x.cast("int").alias("id"), mask.cast("int").alias("mask"))
        mark = said(F.when(own, F.lit(assistant)).otherwise(F.lit(user)), F.lit(0))
        return F.concat(F.array(mark), F.transform(text, lambda x: said(x, own)), F.array(said(F.lit(end), own)))

    return F.concat(F.array(F.struct(F.lit(bos).cast("int").alias("id"), F.lit(0).alias("mask"))), F.flatten(F.transform(body, one)))


def rendered_problem(rendered: Column, capacity: int) -> Column:
    """Why a rendered conversation (array of id and mask) can't be trained on, or null: too short, longer than a row, a mask that isn't 0 or 1, or nothing to learn."""
    late = F.slice(rendered, 2, F.greatest(F.size(rendered) - 1, F.lit(1)))
    return (
        F.when(rendered.isNull() | (F.size(rendered) < 2), "too_short").when(F.size(rendered) > capacity, "exceeds_row_capacity")
        .when(F.exists(rendered, lambda x: ~F.coalesce(x["mask"].isin(0, 1), F.lit(False))), "invalid_mask").when(~F.exists(late, lambda x: x["mask"] == 1), "no_supervised_target")
    )
