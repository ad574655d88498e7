"""Text as Column expressions: canonical forms, tokens, lines, n-grams, markup removal and chunking.

Each operator has its own canonical form; they are not interchangeable. Everything stays in the JVM but for NFC and the nested
template scanner, which Spark lacks.
"""

from __future__ import annotations

import functools
import html
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space and line ends as the canonical forms know them; word characters are letters, numbers and the underscore.
SPACE = "[\t-\r\x1c-\x20\x85\xa0  -     　]"
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Texts of these characters alone are in NFC: all below U+0300, Cyrillic letters without combining signs, and general punctuation.
_IN_NFC = r"\A[\x{0}-\x{2ff}\x{400}-\x{482}\x{48a}-\x{4ff}\x{2010}-\x{2027}\x{2030}-\x{205e}]*+\z"


def nfc(text: Column) -> Column:
    """The canonical composition. Only texts that may need it go through Python; nulls stay null."""
    return F.coalesce(_nfc(F.when(~text.rlike(_IN_NFC), text)), text)


@functools.cache
def control_class() -> str:
    """A character class of all control, format, unassigned and private code points but tab and line feed, by one table for all engines."""
    ranges, start = [], None
    for code in range(sys.maxunicode + 2):
        bad = code <= sys.maxunicode and code not in (9, 10) and not 0xD800 <= code <= 0xDFFF and unicodedata.category(chr(code))[0] == "C"
        if bad and start is None:
            start = code
        elif not bad and start is not None:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{code - 1:x}}}")
            start = None
    return "[" + "".join(ranges) + "]"


#: SPACE but for the space itself.
_OTHER_SPACE = SPACE.replace("\x1c-\x20", "\x1c-\x1f")


def _translated(text: Column, these: str, those: str) -> Column:
    """F.translate, which looks each character up, of the texts that have one of these only."""
    return let(text, lambda t: F.when(t.rlike(f"[{these}]"), F.translate(t, these, those)).otherwise(t))


def _single_spaces(text: Column) -> Column:
    """Runs of SPACE as one space; a space by itself is no match, as each costs a copy."""
    return F.regexp_replace(text, f"{SPACE}{{2,}}+|{_OTHER_SPACE}", " ")


def trimmed(text: Column) -> Column:
    """Without SPACE at both ends; most texts have none, which their first and last characters tell."""
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return let(text, lambda t: F.when(ends(t).rlike(SPACE), F.regexp_replace(t, f"^{SPACE}++|{SPACE}++$", "")).otherwise(t))


def normalized(text: Column, paragraphs: bool = True, is_nfc: bool = False) -> Column:
    """Line ends, NFC, dashes, apostrophes and quotes, control characters, spaces; flat: one line."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = out if is_nfc else nfc(out)
    out = _translated(out, "‐‑‒–−‘’ʼ“”", "-----’’’\"\"")
    # the exact class has hundreds of ranges; few texts hold any of the wider class that the JVM knows by itself
    out = let(out, lambda t: F.when(t.rlike(r"[\p{C}&&[^\t\n]]"), F.regexp_replace(t, control_class(), " ")).otherwise(t))
    if not paragraphs:
        return trimmed(_single_spaces(out))
    each = F.transform(F.split(out, LINE_END), lambda x: trimmed(F.regexp_replace(x, "[ \t\r\f\x0b]{2,}+|[\t\r\f\x0b]", " ")))
    return trimmed(F.regexp_replace(F.array_join(each, "\n"), "\n{4,}", "\n\n\n"))


def dedup_form(text: Column, is_nfc: bool = False) -> Column:
    """Flat, lower-case, without punctuation other than the apostrophe."""
    out = F.regexp_replace(F.lower(normalized(text, False, is_nfc)), r"[^\p{L}\p{N}_’" + SPACE[1:], " ")
    return trimmed(F.regexp_replace(out, f"{SPACE}+", " "))


def text_hash(text: Column, is_nfc: bool = False) -> Column:
    return F.sha2(dedup_form(text, is_nfc), 256)


def canonical(text: Column, is_nfc: bool = False) -> Column:
    """NFC, one apostrophe, single spaces; case and punctuation stay."""
    out = _translated(text if is_nfc else nfc(text), "'ʼ‘", "’’’")
    return trimmed(_single_spaces(out))


def content_hash(text: Column, is_nfc: bool = False) -> Column:
    return F.sha2(canonical(text, is_nfc), 256)


def words(text: Column, is_nfc: bool = False) -> Column:
    """Lower-case words of the NFC form."""
    return F.regexp_extract_all(F.lower(text if is_nfc else nfc(text)), F.lit(WORD), F.lit(0))


def plain_words(text: Column) -> Column:
    """Lower-case words, without NFC."""
    return words(text, True)


def split_words(text: Column) -> Column:
    """Lower-case pieces between white space."""
    return F.array_remove(F.split(F.lower(text), f"{SPACE}+"), "")


def digest(text: Column, is_nfc: bool = False) -> Column:
    return F.sha2(F.array_join(words(text, is_nfc), " "), 256)


def doc_key(source: Column, text: Column) -> Column:
    return F.concat(source, F.lit("_"), F.substring(F.sha2(text, 256), 1, 12))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams, joined by a space; none if there are fewer tokens."""
    starts = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return let(tokens, lambda t: F.transform(starts(t), lambda i: F.array_join(F.slice(t, i, n), " ")))


def windows(tokens: Column, size: int, stride: int) -> Column:
    """Slices of size tokens at every stride; the last ones may be shorter."""
    return let(tokens, lambda t: F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.size(t) - 1, F.lit(stride)), lambda i: F.slice(t, i + 1, size))).otherwise(F.array().cast("array<array<string>>")))


def lines(text: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(text, LINE_END), lambda x: F.length(trimmed(x)) > 0)


def paragraphs(text: Column, least: int = 30) -> Column:
    """Trimmed lines of at least least characters."""
    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: F.length(x) >= least)


def long_lines(text: Column, chars: int = 200, least_words: int = 40, is_nfc: bool = False) -> Column:
    """Digests of the lines that are long in words; null for the others, so places stay."""
    return F.transform(F.split(text, LINE_END), lambda x: let(words(x, is_nfc), lambda w: F.when((F.length(F.array_join(w, " ")) >= chars) & (F.size(w) >= least_words), F.sha2(F.array_join(w, " "), 256))))


def repeated_lines(text: Column, least: int = 10, share: float = 0.35, by_words: bool = False) -> Column:
    """Whether of least or more non-blank lines a smaller share than given is distinct, by their words alone if by_words."""
    form = (lambda x: F.array_join(plain_words(x), " ")) if by_words else trimmed
    return let(F.transform(lines(text), form), lambda x: (F.size(x) >= least) & (F.size(F.array_distinct(x)) / F.size(x) < share))


def clean_book(text: Column) -> Column:
    """Without byte order mark, with single spaces and at most one blank line."""
    out = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("﻿"), F.lit("")), "\r\n?", "\n"), "[ \t]+", " ")
    return trimmed(F.regexp_replace(out, "\n{3,}", "\n\n"))


def clean_scan(text: Column, is_nfc: bool = False) -> Column:
    """NFC; form feeds become spaces; lines of a page number or of control characters only go."""
    out = F.translate(text if is_nfc else nfc(text), "\x0b\x0c", "  ")
    kept = F.filter(F.split(out, "\n"), lambda x: ~x.rlike(r"^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$") & ~x.rlike(r"^[\p{Cc}\s]+$"))
    return trimmed(F.array_join(kept, "\n"))


def strip_wikitext(text: Column, depth: int = 4) -> Column:
    """Prose of wiki markup: no comments, references, tables, templates (depth levels), files, categories; links by their label."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>|\{\|.*?\|\}", " ")
    for _ in range(depth):
        out = F.regexp_replace(out, r"\{\{[^{}]*\}\}", " ")
    out = F.regexp_replace(out, r"(?i)\[\[(?:file|image|category|файл|катэгорыя):[^\[\]]*\]\]", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), r"\[\[([^\[\]]*)\]\]", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\[https?://\S+\s+([^\]]+)\]", "$1"), r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1")
    out = F.regexp_replace(out, r"<[^>]+>|'{2,}", "")
    return trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), " ?\n ?", "\n"), "\n{3,}", "\n\n"))


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def strip_wikitext_escaped(text: Column, depth: int = 4) -> Column:
    """strip_wikitext for markup that stands escaped in its dump: HTML entities are resolved first."""
    return strip_wikitext(_unescaped(text), depth)


def strip_marks(text: Column) -> Column:
    """The light variant of strip_wikitext: references, tags, single templates, links by their label, quotes and heading marks go; tables, files and categories stay."""
    out = F.regexp_replace(text, r"(?s)<ref[^>]*>.*?</ref>|<[^>]+>|\{\{[^{}]*\}\}", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), r"\[\[([^\[\]]*)\]\]", "$1")
    return trimmed(F.regexp_replace(F.regexp_replace(out, r"'{2,}|={2,}", ""), f"{SPACE}+", " "))


def preview(text: Column, n: int = 240) -> Column:
    """The first n characters, for reports."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def present_texts(columns: list[str], names: tuple[str, ...] = ("prompt", "text", "input", "question", "user")) -> Column:
    """The non-blank values of those of names that are among columns, in the order of names."""
    found = [F.when(F.length(F.trim(F.col(n).cast("string"))) > 0, F.col(n).cast("string")) for n in names if n in columns]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def record_text(columns: list[str], names: tuple[str, ...] = ("user", "system", "prompt", "question", "text")) -> Column:
    """The fields of a record that stand for it in an overlap check, one a line; missing ones are left out."""
    found = [F.col(n).cast("string") for n in names if n in columns]
    return F.concat_ws("\n", *found) if found else F.lit("")


def strip_html(page: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags; the five basic entities; single spaces."""
    out = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return trimmed(F.regexp_replace(out, f"{SPACE}+", " "))


@F.pandas_udf(T.LongType())
def _template_chars(texts: pd.Series, least: pd.Series) -> pd.Series:
    def count(text: str, pipes: int) -> int:
        total, depth, bars, start, at = 0, 0, 0, 0, 0
        while at < len(text):
            two = text[at : at + 2]
            if two == "{{":
                if not depth:
                    start, bars = at, 0
                depth, at = depth + 1, at + 2
            elif two == "}}" and depth:
                depth, at = depth - 1, at + 2
                if not depth and bars >= pipes:
                    total += at - start
            else:
                bars += text[at] == "|" and depth > 0
                at += 1
        return total + (len(text) - start if depth and bars >= pipes else 0)

    return pd.Series([0 if not t or "{{" not in t else count(t, p) for t, p in zip(texts, least, strict=True)])


def template_chars(text: Column, least_pipes: int = 1) -> Column:
    """Characters in nested double-brace templates with least_pipes bars or more; an unclosed one counts to the end."""
    return _template_chars(text, F.lit(least_pipes))


def substitute(text: Column, phrases: dict[str, str]) -> Column:
    """Whole phrases replaced, the longest first, whatever their case."""
    import re

    for old in sorted(phrases, key=lambda p: (-len(p), p)):
        text = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(old)}(?![\p{{L}}\p{{N}}_])", phrases[old].replace("\\", "\\\\").replace("$", "\\$"))
    return text


def family(text: Column, wrappers: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), is_nfc: bool = False) -> Column:
    """The words of a prompt without wrapping prefixes and a closing courtesy: prompts that ask the same have one family."""
    out = F.lower(canonical(text, is_nfc))
    if wrappers:
        out = F.regexp_replace(out, "^(?:" + "|".join(wrappers) + ")+", "")
    if suffixes:
        out = F.regexp_replace(out, "(?:" + "|".join(suffixes) + ")$", "")
    return F.array_join(F.regexp_extract_all(out, F.lit(WORD), F.lit(0)), " ")


def chunks(text: Column, least: int, most: int) -> Column:
    """Paragraphs packed in order into chunks: one is closed when the next paragraph would take it over most characters and it has least
    or more; the last stays only if it has least."""
    parts = F.filter(F.transform(F.split(text, "\n\\s*\n"), trimmed), lambda x: F.length(x) > 0)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s, x):
        full = (F.length(s["now"]) > 0) & (F.length(s["now"]) + F.length(x) > most) & (F.length(s["now"]) >= least)
        grown = F.when(F.length(s["now"]) > 0, F.concat(s["now"], F.lit("\n\n"), x)).otherwise(x)
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(full, x).otherwise(grown).alias("now"))

    return F.aggregate(parts, zero, step, lambda s: F.when(F.length(s["now"]) >= least, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
