"""Admission: source policy, boilerplate gates and routing, in a fixed order of reasons; policies are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import scoring, text, urls
from corpusloom.operators.outcomes import first_reason


@dataclass(frozen=True)
class SourceRule:
    """What a source must fulfil; base: whether it may be in the base corpus; weight: its retention."""

    least_chars: int = 80
    least_score: float = 0.45
    orthography: str | None = None
    base: bool = True
    weight: float = 1.0
    synthetic: bool = False

    def __post_init__(self):
        if not 0 <= self.weight <= 1 or self.least_chars < 0:
            raise ValueError("a weight must be in [0, 1] and a length not negative")


def rules_table(spark, rules: dict[str, SourceRule]) -> DataFrame:
    """The rules as a table; policies are written by hand, so it is small."""
    rows = [(k, r.least_chars, r.least_score, r.orthography, r.base, r.weight, r.synthetic) for k, r in rules.items()]
    return spark.createDataFrame(rows, "rule_source string, least_chars int, least_score double, orthography string, base boolean, weight double, synthetic boolean")


def with_rules(df: DataFrame, rules: DataFrame, aliases: dict[str, str] | None = None, required: bool = True) -> DataFrame:
    """df with its source's rule; a source without one is an error, or has nulls if required is False."""
    name = F.col("source")
    for old, new in (aliases or {}).items():
        name = F.when(F.col("source") == old, new).otherwise(name)
    out = df.withColumn("rule_source", name).join(F.broadcast(rules), "rule_source", "left").drop("rule_source")
    if required:
        known = F.col("base").isNotNull()
        out = out.withColumn("base", F.when(known, F.col("base")).otherwise(F.raise_error(F.concat(F.lit("source missing from policy: "), F.coalesce("source", F.lit("null")))).cast("boolean")))
    return out


def detected_source(path: Column, aliases: list[tuple[str, str]], sources: list[str]) -> Column:
    """The first alias in the path, else the longest source name in it, else unknown."""
    low, found = F.lower(path), None
    for mark, source in [*aliases, *((s, s) for s in sorted(sources, key=lambda s: -len(s)))]:
        found = F.when(low.contains(mark), source) if found is None else found.when(low.contains(mark), source)
    return found.otherwise("unknown") if found is not None else F.lit("unknown")


def base_problem(source: Column, meta: Column, detected: Column, barred: list[str]) -> Column:
    """Why a row can't be in the base corpus: its metadata, its status, or any of its three names. meta: map of strings."""
    flag = lambda k: F.lower(F.coalesce(meta[k], F.lit(""))) == "true"
    names = F.array(source, meta["source"], detected)
    hit = F.get(F.filter(names, lambda n: n.isin(barred)), F.lit(0)) if barred else F.lit(None).cast("string")
    return (
        F.when(flag("eval_only") | flag("never_train") | (F.lower(meta["base_pretrain_allowed"]) == "false"), "eval_only_metadata")
        .when(meta["status"].isin("manual_review", "quarantine", "rejected"), "unapproved_quality_status")
        .when(hit.isNotNull(), F.concat(F.lit("excluded_base_source:"), hit))
    )


@dataclass(frozen=True)
class Marks:
    """A gate on marker strings: at least distinct of them, in texts of at most chars characters, making up share of the text."""

    marks: tuple[str, ...] = ()
    distinct: int = 1
    share: float = 0.0
    chars: int = 1 << 30


@dataclass(frozen=True)
class AdmissionPolicy:
    """What a row is refused for; an empty entry turns its gate off. Hosts and URL parts are lower-case."""

    url_sources: tuple[str, ...] = ()
    blocked_hosts: tuple[str, ...] = ()
    clone_routes: tuple[tuple[str, str], ...] = ()  # (end of the host, first path segment) of machine-translated copies
    language_labels: tuple[str, ...] = ()  # first host label, first path segment, or value of one of query_keys
    query_keys: tuple[str, ...] = ("lang", "language", "locale")
    local_domains: tuple[str, ...] = ()  # ends of hosts that may have language labels
    exempt_hosts: tuple[str, ...] = ()
    excluded_sources: tuple[str, ...] = ()
    reviewed: tuple[tuple[str, str], ...] = ()  # (digest, source)
    archive_segments: tuple[str, ...] = ()
    page_segment: str = "page"
    template_fields: int = 2
    template_chars: int = 0
    template_share: float = 0.5
    teaser: tuple[str, ...] = ()  # "read more" in its forms
    teasers: int = 3
    dated_tag: str = ""
    dated_entries: int = 3
    menu: tuple[str, ...] = ()
    menu_share: float = 0.5
    menu_counts: int = 5
    game: Marks = Marks()
    store: Marks = Marks()
    common_short: frozenset[str] = frozenset()
    wiki_tail: tuple[str, ...] = ()
    wiki_controls: Marks = Marks()
    share_tail: tuple[str, ...] = ()
    share_share: float = 0.3
    share_lines: int = 5
    share_words: int = 8


_DATED = r"(?m)^\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
_COUNT = r"\(\d+\)"


def _dense(low: Column, gate: Marks) -> Column:
    """Whether enough of the gate's marks occur and make up enough of a text."""
    if not gate.marks:
        return F.lit(False)
    c = F.struct(*(scoring.marker_hits(low, [m]).alias(f"m{i}") for i, m in enumerate(gate.marks)))

    def judged(c: Column) -> Column:
        found, chars = F.lit(0), F.lit(0)
        for i, m in enumerate(gate.marks):
            found, chars = found + (c[f"m{i}"] > 0).cast("int"), chars + c[f"m{i}"] * len(m)
        return (found >= gate.distinct) & (chars / F.greatest(F.length(low), F.lit(1)) >= gate.share)

    return (F.length(low) <= gate.chars) & text.let(c, judged)


def _tails(low: Column, marks: tuple[str, ...], share: float, holds) -> Column:
    """Whether, for one of marks, what follows its first place is at least a share of the text and holds(tail)."""
    found = F.lit(False)
    for m in marks:
        at = F.instr(low, m)
        tail = F.substring(low, at, F.length(low))
        found = found | F.coalesce((at > 0) & ((F.length(low) - at + 1) / F.greatest(F.length(low), F.lit(1)) >= share) & holds(tail, m), F.lit(False))
    return found


def _text_gates(p: AdmissionPolicy, t: Column, segments: Column) -> list[tuple[str, Column]]:
    off = F.lit(False)
    low = F.lower(t)
    in_archive = F.arrays_overlap(segments, F.array(*map(F.lit, p.archive_segments))) if p.archive_segments else off
    n = F.size(segments)
    paged = (n >= 3) & (F.get(segments, n - 2) == p.page_segment) & F.get(segments, n - 1).rlike("^[0-9]+$")
    early = F.arrays_overlap(F.slice(segments, 1, F.greatest(n - 2, F.lit(0))), F.array(*map(F.lit, p.archive_segments))) if p.archive_segments else off
    # the scanner runs only where there is a template
    amount = F.when(t.contains("{{"), text.template_chars(F.when(t.contains("{{"), t), p.template_fields)).otherwise(F.lit(0))

    def short_lines(tail: Column, m: str) -> Column:
        sizes = F.transform(F.split(F.substring(tail, len(m) + 1, 1 << 30), text.LINE_END), lambda x: F.size(text.split_words(x)))
        return F.size(F.filter(sizes, lambda k: (k > 0) & (k <= p.share_words))) >= p.share_lines

    return [
        ("paginated_article_archive", paged & early),
        ("dominant_unexpanded_template", text.let(amount, lambda a: (a > 0) & (a >= p.template_chars) & (a / F.greatest(F.length(t), F.lit(1)) >= p.template_share))),
        ("article_teaser_archive", (scoring.marker_hits(low, list(p.teaser)) >= p.teasers) & in_archive if p.teaser else off),
        ("dated_tagged_news_index", (scoring.marker_hits(low, [p.dated_tag]) >= p.dated_entries) & (F.regexp_count(t, F.lit(_DATED)) >= p.dated_entries) if p.dated_tag else off),
        ("dominant_category_selection_menu", _tails(low, p.menu, p.menu_share, lambda tail, _: F.regexp_count(tail, F.lit(_COUNT)) >= p.menu_counts)),
        ("dominant_game_navigation_controls", _dense(low, p.game)),
        ("dominant_store_navigation_controls", _dense(low, p.store)),
        ("extreme_short_token_fragmentation", scoring.fragmented(t, common=p.common_short, rare_share=0.3 if p.common_short else 0.0)),
        ("substantial_wiki_navigation_tail", _tails(low, p.wiki_tail, p.wiki_controls.share, lambda tail, _: _dense(tail, Marks(p.wiki_controls.marks, p.wiki_controls.distinct)))),
        ("dominant_related_links_tail", _tails(low, p.share_tail, p.share_share, short_lines)),
    ]


def admission_reason(policy: AdmissionPolicy, source: str = "source", url: str = "url", body: str = "text", digest: str = "digest") -> Column:
    """First reason against a row: its source, a reviewed defect, its URL and route, then boilerplate. A reviewed digest under another source is an error."""
    t, u, s = F.coalesce(F.col(body), F.lit("")), F.col(url), F.col(source)
    web = s.isin(list(policy.url_sources)) if policy.url_sources else F.lit(False)
    host = urls.host(u)
    local = F.lit(False)
    for end in policy.local_domains:
        local = local | host.endswith("." + end)
    exempt = urls.host_matches(host, list(policy.exempt_hosts)) | F.coalesce(local, F.lit(False))
    segments = F.when(web, urls.path_segments(u)).otherwise(F.array().cast("array<string>"))
    clone = F.lit(False)
    for end, first in policy.clone_routes:
        clone = clone | (host.endswith("." + end) & (F.get(segments, F.lit(0)) == first))
    reviewed = F.lit(False)
    for value, owner in policy.reviewed:
        other = F.raise_error(F.concat(F.lit("reviewed content has another source: "), s)).cast("boolean")
        reviewed = reviewed | F.when(F.col(digest) == value, F.when(s == owner, True).otherwise(other)).otherwise(False)
    return first_reason(
        ("excluded_source", s.isin(list(policy.excluded_sources)) if policy.excluded_sources else F.lit(False)),
        ("reviewed_material_content_defect", reviewed),
        ("missing_source_url_for_admission", web & (F.coalesce(u, F.lit("")) == "")),
        ("invalid_source_url_for_admission", web & ~urls.is_valid(u)),
        ("reviewed_problem_source_family", web & urls.host_matches(host, list(policy.blocked_hosts))),
        ("unreviewed_translated_route", web & F.coalesce(clone, F.lit(False))),
        ("unreviewed_multilingual_route", web & ~exempt & (urls.route(u, list(policy.language_labels), policy.query_keys) if policy.language_labels else F.lit(False))),
        *_text_gates(policy, t, segments),
    )


def subset(df: DataFrame, policy: AdmissionPolicy) -> tuple[DataFrame, DataFrame]:
    """(admitted rows as they are, ledger of the others with digest, source and reason); df has digest."""
    marked = df.withColumn("reason", admission_reason(policy))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").select("digest", "source", "reason")
