"""Language and quality scores as Column expressions, for a language profile that is data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import WORD, let, plain_words, windows


@dataclass(frozen=True)
class LanguageProfile:
    """script and foreign: character classes; markers: letters that only this language has; own: its frequent words; rival: words of its nearest
    neighbour; other: words of a second neighbour; distant: words of a language of another script; names: technical names that are taken out
    before letters and words are counted; code: whether program code counts against a text; rival_marks, other_marks: letters that only
    the nearest or the second neighbour has."""

    script: str
    foreign: str
    markers: str
    own: frozenset[str]
    rival: frozenset[str] = frozenset()
    other: frozenset[str] = frozenset()
    distant: frozenset[str] = frozenset()
    names: tuple[str, ...] = field(default=())
    code: bool = False
    rival_marks: str = ""
    other_marks: str = ""

    @property
    def rival_only(self) -> list[str]:
        return sorted(self.rival - self.own - self.other)

    @property
    def own_only(self) -> list[str]:
        return sorted(self.own - self.rival - self.other)


#: Lines that look like program code.
CODE = r"(?m)^\s*(?:def|class|import|function|const|var|public|#include)\b.*[({;:]|[{};]\s*$"

#: For tables in Latin script: English against French, German and Spanish.
ENGLISH = LanguageProfile(
    "A-Za-z", "Ѐ-ӿ", "wk", frozenset("the and of to in is was that it for with as on by this are be at from or an".split()),
    frozenset("le la les de des et du un une en que qui dans pour par sur au ce il elle".split()), frozenset("der die das und den von zu mit ist im für auf dem ein eine".split()), frozenset("что это как для".split()), other_marks="äöüß",
)


def _hits(tokens: Column, lexicon) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(sorted(lexicon)))) if lexicon else F.lit(0)


def _chars(text: Column, kind: str) -> Column:
    # runs, as each match costs a copy of its own
    return F.length(F.regexp_replace(text, f"[^{kind}]++", ""))


def count_of(text: Column, marks: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{marks}]++", ""))


def sides(tokens: Column, p: LanguageProfile) -> Column:
    """A number for each token, so that words are looked up once: 1 if only the rival has it, plus 2 if only this language has it or it holds a marker."""
    return F.transform(tokens, lambda x: F.when(x.isin(p.rival_only), 1).otherwise(0) + F.when(x.isin(p.own_only) | x.rlike(f"[{p.markers}]"), 2).otherwise(0))


def _mixed(of: Column, window: int = 80, least: int = 20) -> Column:
    """mixed() over the sides of the tokens."""

    def bad(w: Column) -> Column:
        rival, own = F.size(F.filter(w, lambda x: x.isin(1, 3))), F.size(F.filter(w, lambda x: x >= 2))
        c = F.struct(rival.alias("rival"), own.alias("own"), F.size(w).alias("n"))
        return let(c, lambda c: (c["rival"] >= 6) & (c["rival"] / c["n"] >= 0.08) & (c["rival"] / F.greatest(c["rival"] + c["own"], F.lit(1)) >= 0.6))

    def judged(t: Column) -> Column:
        parts = F.filter(windows(t, window, window), lambda w: (F.size(w) >= least) & bad(w))
        mass = F.aggregate(parts, F.lit(0), lambda s, w: s + F.size(w))
        return F.when(F.size(t) < least, False).otherwise(bad(t) | (mass / F.size(t) > 0.15))

    return let(of, judged)


def mixed(tokens: Column, p: LanguageProfile, window: int = 80, least: int = 20) -> Column:
    """Whether the rival language dominates the text, or windows that hold over 15 % of its words."""
    return _mixed(sides(tokens, p), window, least)


def detect(text: Column, p: LanguageProfile, accept: float = 4.0, quarantine: float = 2.0, least: int = 40) -> Column:
    """struct(score, decision, reasons): additive rules on script shares, marker letters, words of each language, links and code."""

    def counted(whole: Column) -> Column:
        return let(without_names(whole, p.names), lambda t: cleaned(whole, t)) if p.names else cleaned(whole, whole)

    def cleaned(whole: Column, t: Column) -> Column:
        # the windows are those of the text as it is
        tokens = plain_words(t)
        mix = let(plain_words(whole), lambda w: _mixed(sides(w, p))) if p.names else None
        return F.struct(
            F.length(F.trim(t)).alias("chars"), _chars(t, p.script).alias("script"), _chars(t, p.foreign).alias("foreign"), count_of(t, p.markers + p.markers.upper()).alias("marks"),
            t.rlike(r"(?i)https?://|www\.").alias("url"), (t.rlike(CODE) if p.code else F.lit(False)).alias("code"), let(tokens, lambda w: F.struct(F.array_distinct(w).alias("words"), (_mixed(sides(w, p)) if mix is None else mix).alias("mixed"))).alias("of"),
        )

    def scored(c: Column) -> Column:
        letters = c["script"] + c["foreign"]
        share, other_share = (F.when(letters > 0, c[x] / letters).otherwise(0.0) for x in ("script", "foreign"))
        words = c["of"]["words"]
        return F.struct(
            c["chars"].alias("chars"), letters.alias("letters"), share.alias("share"), other_share.alias("other_share"), c["marks"].alias("marks"), c["url"].alias("url"), c["code"].alias("code"), c["of"]["mixed"].alias("mixed"),
            *(_hits(words, x).alias(n) for n, x in (("own", p.own), ("rival", p.rival), ("other", p.other), ("far", p.distant))),
        )

    def ruled(v: Column) -> Column:
        share, other_share, marks, own, rival, other, far = (v[x] for x in ("share", "other_share", "marks", "own", "rival", "other", "far"))
        clash = (rival >= F.greatest(F.lit(3), own + 2)) & (marks == 0)
        rules = [
            (v["chars"] < least, F.lit(-3.0), "short"),
            (v["letters"] == 0, F.lit(-5.0), "no_letters"),
            (share >= 0.70, F.lit(1.5), "mostly_own_script"),
            ((share < 0.70) & (share >= 0.45), F.lit(0.5), "mixed_script"),
            (share < 0.45, F.lit(-2.5), "low_own_script"),
            (other_share > 0.25, F.lit(-1.5), "foreign_script_high"),
            (other_share > 0.50, F.lit(-3.0), "foreign_script_dominant"),
            (marks > 0, F.least(F.lit(4.0), 0.7 * marks), "marker_letters"),
            (marks == 0, F.lit(-0.8), "no_marker_letters"),
            (own > 0, F.least(F.lit(5.0), 0.8 * own), "own_words"),
            (clash, F.lit(-3.0), "rival_words"),
            (~clash & (rival > 0), -F.least(F.lit(1.5), 0.2 * rival), "some_rival_words"),
            (other >= 2, -F.least(F.lit(3.0), 0.8 * other), "other_words"),
            ((far >= 4) | ((far >= 2) & (other_share > 0.20)), -F.least(F.lit(3.0), 0.6 * far), "distant_words"),
            (v["url"], F.lit(-0.5), "url_present"),
            (v["code"] & (other_share > 0.15), F.lit(-2.0), "code_or_config_like"),
        ]
        total = F.lit(0.0)
        for cond, points, _ in rules:
            total = total + F.when(cond, points).otherwise(0.0)
        score = let(total, lambda x: F.round(F.when(v["mixed"], F.least(x, F.lit(0.0))).otherwise(x), 3))
        reasons = F.array_compact(F.array(*(F.when(cond, name) for cond, _, name in rules), F.when(v["mixed"], "rival_segments")))
        return F.struct(score.alias("score"), reasons.alias("reasons"))

    found = let(let(let(F.coalesce(text, F.lit("")), counted), scored), ruled)
    return let(found, lambda s: F.struct(s["score"].alias("score"), F.when(s["score"] >= accept, "accept").when(s["score"] >= quarantine, "quarantine").otherwise("reject").alias("decision"), s["reasons"].alias("reasons")))


def additive(text: Column, p: LanguageProfile) -> Column:
    """Quarter and third steps added in a fixed order, as bands depend on the sum's last bit."""

    def of(t: Column) -> Column:
        low = F.lower(t)
        own, foreign = _chars(low, p.script), _chars(low, p.foreign)
        return let(plain_words(t), lambda w: (
            F.when(own >= 30, 0.25).otherwise(0.0) + F.when(foreign > F.greatest(F.lit(80.0), own * 0.25), -0.35).otherwise(0.0)
            + F.when(count_of(low, p.markers) >= 2, 0.35).otherwise(0.0) + F.when(_hits(w, p.own) >= 2, 0.35).otherwise(0.0)
            + F.when(_hits(w, p.rival) >= 4, -0.25).otherwise(0.0) + F.when(_hits(w, p.other) >= 2, -0.25).otherwise(0.0)
        ))

    return let(F.coalesce(text, F.lit("")), of)


def band(score: Column, least: float) -> Column:
    return F.when(score >= least, "accept").when(score >= least - 0.20, "quarantine").otherwise("reject")


def window_share(tokens: Column, predicate, size: int = 40, stride: int = 20, least: int = 20) -> Column:
    """Number of word places in windows for which predicate(window) holds; places in several windows count once."""

    def of(t: Column) -> Column:
        starts = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        hits = F.filter(starts, lambda i: (F.size(F.slice(t, i + 1, size)) >= least) & predicate(F.slice(t, i + 1, size)))
        places = F.flatten(F.transform(hits, lambda i: F.sequence(i, F.least(i + size, F.size(t)) - 1)))
        return F.size(F.array_distinct(places))

    return let(tokens, of)


def web_problem(text: Column, p: LanguageProfile) -> Column:
    """First reason against a web row: rival segments, foreign letters, a neighbour's letters, no evidence, rival or foreign windows, repetition; or null."""
    rival = lambda x: x.isin(p.rival_only) | (x.rlike(f"[{p.rival_marks}]") if p.rival_marks else F.lit(False))
    own = lambda x: x.isin(p.own_only) | x.rlike(f"[{p.markers}]")

    def rival_window(x: Column) -> Column:
        c = F.struct(F.size(F.filter(x, lambda v: v.isin(1, 3))).alias("r"), F.size(F.filter(x, lambda v: v >= 2)).alias("o"), F.size(x).alias("n"))
        return let(c, lambda c: (c["r"] >= 6) & (c["r"] / c["n"] >= 0.25) & (c["o"] / F.greatest(c["r"], F.lit(1)) <= 0.25))

    def counted(w: Column) -> Column:
        of = F.transform(w, lambda x: F.when(rival(x), 1).otherwise(0) + F.when(own(x), 2).otherwise(0))
        foreign = F.transform(w, lambda x: x.rlike(f"^[{p.foreign}]+$"))
        marked = F.size(F.filter(w, lambda x: x.rlike(f"[{p.other_marks}]"))) if p.other_marks else F.lit(0)
        return let(F.array_join(w, ""), lambda t: F.struct(
            F.size(w).alias("n"), F.length(F.regexp_replace(t, r"[^\p{L}]", "")).alias("letters"), _chars(t, p.script).alias("own"), count_of(t, p.markers).alias("marks"), _hits(w, p.own_only).alias("evidence"), marked.alias("marked"),
            window_share(of, rival_window).alias("rival"), window_share(foreign, lambda x: F.size(F.filter(x, lambda v: v)) / F.size(x) >= 0.75).alias("foreign"),
            F.size(F.array_distinct(w)).alias("distinct"), mixed(w, p).alias("mixed"),
        ))

    def of(c: Column) -> Column:
        n = F.greatest(c["n"], F.lit(1))
        return (
            F.when(c["mixed"], "rival_segments").when((c["letters"] > 0) & (c["own"] / F.greatest(c["letters"], F.lit(1)) < 0.65), "foreign_script_dominant")
            .when((c["marked"] >= 4) & (c["marked"] / n >= 0.03), "neighbour_marked").when((c["marks"] == 0) & (c["evidence"] < 2), "no_evidence")
            .when((c["rival"] >= 20) & (c["rival"] / n >= 0.10), "rival_windows").when((c["foreign"] >= 40) & (c["foreign"] / n >= 0.20), "foreign_windows")
            .when((c["n"] >= 100) & (c["distinct"] / n < 0.05), "extreme_token_repetition")
        )

    return let(let(plain_words(F.coalesce(text, F.lit(""))), counted), of)


def fragmented(text: Column, least: int = 120, short_share: float = 0.82, long_share: float = 0.03, mean: float = 3.0, common: frozenset[str] = frozenset(), rare_share: float = 0.0) -> Column:
    """Whether words are broken into pieces, as by bad recognition: many short, of them many that aren't common function words, few long, a low mean length."""
    rare = lambda w: F.size(F.filter(w, lambda x: (F.length(x) <= 3) & ~x.isin(sorted(common)))) if common else F.size(F.filter(w, lambda x: F.length(x) <= 3))
    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)), lambda w: let(F.transform(w, lambda x: F.length(x)), lambda n: F.when(F.size(n) < least, False).otherwise(
        (F.size(F.filter(n, lambda x: x <= 3)) / F.size(n) >= short_share) & (rare(w) / F.size(n) >= rare_share) & (F.size(F.filter(n, lambda x: x >= 6)) / F.size(n) <= long_share) & (F.aggregate(n, F.lit(0), lambda a, x: a + x) / F.size(n) <= mean)
    )))


def response_ok(text: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether an answer holds one of include (if any) and none of exclude, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = F.lit(not include)
    for x in include:
        any_of = any_of | low.contains(x.lower())
    for x in exclude:
        any_of = any_of & ~low.contains(x.lower())
    return any_of


def marker_hits(text: Column, marks: list[str]) -> Column:
    """Occurrences of all marks, without overlaps."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for m in marks:
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m)).cast("int")
    return total


def _clipped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def _script_words(text: Column, p: LanguageProfile) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{p.script}'ʼ’]+"), F.lit(0))


def _runs(text: Column, kind: str, least: int) -> Column:
    return F.regexp_count(text, F.lit(f"[{kind}]{{{least},}}"))


def without_names(text: Column, names: tuple[str, ...]) -> Column:
    """text without the given technical names, which say nothing about its language."""
    out = text
    for name in sorted(names, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(name)}(?![\p{{L}}\p{{N}}_])", " ")
    return out


def book_score(text: Column, p: LanguageProfile) -> Column:
    """0 to 1: a base, marker letters and own words, less rival words and runs of foreign letters; 0 without words."""

    def of(t: Column) -> Column:
        c = F.struct(count_of(t, p.markers + p.markers.upper()).alias("marks"), _runs(t, p.foreign, 4).alias("foreign"), _script_words(t, p).alias("w"))
        return let(c, lambda c: let(F.struct(F.size(c["w"]).alias("n"), _hits(c["w"], p.own).alias("own"), _hits(c["w"], p.rival).alias("rival")), lambda h: F.when(h["n"] == 0, 0.0).otherwise(_clipped(
            0.20 + F.least(F.lit(0.35), c["marks"] / 80) + F.least(F.lit(0.35), h["own"] / F.greatest(F.lit(20), h["n"]) * 6)
            - F.least(F.lit(0.25), h["rival"] / h["n"] * 3) - F.least(F.lit(0.20), c["foreign"] / h["n"])
        ))))

    return let(F.coalesce(text, F.lit("")), of)


def ready_score(text: Column, p: LanguageProfile, allowed: tuple[str, ...] = (), least: int = 20) -> Column:
    """struct(score, reasons) of prepared data: the script's share of letters, marker letters, own words, less foreign words that aren't allowed and rival words."""

    def of(t: Column) -> Column:
        foreign = F.regexp_extract_all(t, F.lit(f"[{p.foreign}]{{3,}}"), F.lit(0))
        c = F.struct(
            count_of(t, p.script).alias("script"), F.length(F.regexp_replace(t, r"[^\p{L}]", "")).alias("letters"), (count_of(t, p.markers + p.markers.upper()) > 0).alias("marked"),
            _script_words(t, p).alias("w"), F.size(F.filter(foreign, lambda x: ~x.isin(list(allowed))) if allowed else foreign).alias("foreign"),
        )

        def scored(c: Column) -> Column:
            h = F.struct((c["script"] / F.greatest(F.lit(1), c["letters"])).alias("ratio"), _hits(c["w"], p.own).alias("own"), _hits(c["w"], p.rival).alias("rival"))
            return let(h, lambda h: F.struct(
                _clipped(h["ratio"] * 0.45 + F.when(c["marked"], 0.25).otherwise(0.0) + F.least(F.lit(0.25), h["own"] * 0.025) - F.when(c["foreign"] > 0, 0.15).otherwise(0.0) - F.least(F.lit(0.25), h["rival"] * 0.04)).alias("score"),
                F.array_compact(F.array(F.when(c["marked"], "marker_letters"), F.when(h["own"] > 0, "own_words"), F.when(c["foreign"] > 0, "foreign_fragment"), F.when(h["rival"] > 0, "rival_words"), F.when(h["ratio"] < 0.75, "low_script_share"))).alias("reasons"),
            ))

        short = F.struct(F.lit(0.0).alias("score"), F.array(F.lit("too_short")).alias("reasons"))
        return F.when(F.length(F.trim(t)) < least, short).otherwise(let(c, scored))

    return let(F.coalesce(text, F.lit("")), of)


def source_score(text: Column, p: LanguageProfile) -> Column:
    """Marker letters and own words, and whether the script outweighs the foreign one twice."""

    def of(t: Column) -> Column:
        marks, own = count_of(F.lower(t), p.markers), _hits(_script_words(t, p), p.own)
        return marks * 0.2 + own * 0.1 + F.when(_chars(t, p.script) > 2 * _chars(t, p.foreign), 0.3).otherwise(-0.2)

    return let(F.coalesce(text, F.lit("")), of)


def generation_score(text: Column, p: LanguageProfile, marks: dict[str, list[str]], mentions: list[str], refusal: str, least: int = 15) -> Column:
    """struct on a model's answer: the share of its own marker substrings among those of all languages (marks: own, rival, other), which language
    dominates, whether it is short, mentions others or refuses, and the shares of both scripts."""

    def of(t: Column) -> Column:
        low = F.lower(t)
        mentioned = F.lit(False)
        for x in mentions:
            mentioned = mentioned | low.contains(x)
        c = F.struct(*(marker_hits(t, marks[k]).alias(k) for k in ("own", "rival", "other")), _chars(t, p.script).alias("script"), _chars(t, p.foreign).alias("foreign"), F.length(t).alias("n"))
        share = lambda c: c["own"] / F.greatest(c["own"] + c["rival"] + c["other"], F.lit(1))
        return let(c, lambda c: F.struct(
            F.round(share(c), 3).alias("own_score"), ((share(c) > 0.5) & (c["script"] > c["foreign"])).alias("is_own"), ((c["rival"] > c["own"]) & (c["rival"] > c["other"])).alias("rival_dominant"),
            ((c["other"] > c["own"]) & (c["other"] > c["rival"])).alias("other_dominant"), (c["n"] < least).alias("too_short"), mentioned.alias("mentions"), low.rlike(refusal).alias("is_refusal"),
            F.round(c["script"] / F.greatest(c["n"], F.lit(1)), 3).alias("script_share"), F.round(c["foreign"] / F.greatest(c["n"], F.lit(1)), 3).alias("foreign_share"),
        ))

    return let(F.coalesce(text, F.lit("")), of)


def answer_faults(text: Column, p: LanguageProfile, prefix: str, loop: str, least: int = 10) -> Column:
    """Faults of an answer: it holds the forbidden prefix, a repetition loop (a pattern), or hardly any sign of its language."""

    def of(t: Column) -> Column:
        weak = (count_of(t, p.markers + p.markers.upper()) == 0) & (_chars(t, p.script) < least)
        return F.array_compact(F.array(F.when(t.contains(prefix), "forbidden_prefix"), F.when(t.rlike(loop), "repetition_loop"), F.when(weak, "weak_signal")))

    return let(F.coalesce(text, F.lit("")), of)


def response_check(text: Column, p: LanguageProfile, include: list[str], exclude: list[str], least: int = 10) -> Column:
    """First fault of an answer, or null: its language, none of include, or one of exclude."""
    return F.when(detect(text, p, least=least)["decision"] == "reject", "wrong_language").when(~response_ok(text, include, []), "misses_expected").when(~response_ok(text, [], exclude), "holds_excluded")


__all__ = [
    "ENGLISH", "WORD", "LanguageProfile", "additive", "answer_faults", "band", "book_score", "detect", "fragmented", "generation_score", "marker_hits", "mixed",
    "ready_score", "response_check", "response_ok", "sides", "source_score", "web_problem", "window_share", "without_names",
]
