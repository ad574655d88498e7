"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two models of order 2, one of random strings and one of ordinary identifiers, are counted from labelled samples.
A long token is reported when the mean log-likelihood ratio of its characters passes a threshold.
Null and empty texts have no spans; repeated rows give repeated results; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, col, id_text, rows_of, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WORDS = """get set user name list value index count total file path open close read write buffer stream node tree
graph map key item order line price date time start stop begin end data base table column row cell query result error
handler manager service client server request response session config option default parse format string number
token counter password field update delete insert create remove first last next previous size length width height
color image page text word letter message channel worker thread task queue lock event listener factory builder test
main init load save print debug trace version release module package import export public private static final""".split()
SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ung sch ber ein keit ment que aux eau cion ado ida mente".split()


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, bool]]:
    """n labelled tokens of each class, made by rule: random strings over usual key alphabets (true), and identifiers,
    paths and long words composed of words or syllables (false)."""
    rnd, out = random.Random(seed), []
    alphabets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", "0123456789abcdef", "0123456789ABCDEF", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62])
    joins = (
        lambda ws: ws[0] + "".join(w.title() for w in ws[1:]), lambda ws: "".join(w.title() for w in ws), "_".join, "-".join, "/".join, "".join,
        lambda ws: "_".join(ws).upper(), lambda ws: "_".join(ws) + f"_{rnd.randrange(3000)}", lambda ws: "/".join(ws) + f"/{rnd.randrange(10)}",
        lambda ws: "".join(ws).upper(), lambda ws: f"{rnd.randrange(1990, 2040)}-{rnd.randrange(1, 13):02d}-" + "-".join(ws), lambda ws: "=" * rnd.randrange(20, 60), lambda ws: "-" * rnd.randrange(20, 60),
        lambda ws: "_" * rnd.randrange(20, 60), lambda ws: str(rnd.randrange(10, 99)) * rnd.randrange(10, 20),
    )
    for _ in range(n):
        out.append(("".join(rnd.choices(rnd.choice(alphabets), k=rnd.randrange(20, 64))), True))
        words = rnd.choices(WORDS if rnd.random() < 0.6 else SYLLABLES, k=rnd.randrange(3, 9))
        out.append((rnd.choice(joins[:11] if rnd.random() < 0.9 else joins)(words), False))
    return out


class MarkovPair:
    """Log-likelihood ratios of (character | two before) between the two models, with add-alpha smoothing."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def fit(cls, samples: Iterable[tuple[str, bool]], alpha: float = 0.05) -> MarkovPair:
        """samples: (token, whether it is random). Characters outside the alphabet count as one class."""
        size = len(ALPHABET) + 2
        counts = np.full((2, size, size, size), 0.0)
        for token, label in samples:
            a, b, c = _codes(token)
            np.add.at(counts[int(bool(label))], (a, b, c), 1)
        # back off to the shorter context, so that rare contexts lean on what is known of the last character
        one = counts.sum(1, keepdims=True) + alpha
        one /= one.sum(3, keepdims=True)
        both = counts + 4 * one
        both /= both.sum(3, keepdims=True)
        return cls(np.log(both[1]) - np.log(both[0]))

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Mean ratio of each token's characters, in nats; an empty token scores 0."""
        out = np.zeros(len(tokens))
        full = [i for i, t in enumerate(tokens) if t]
        if full:
            parts = [_codes(tokens[i]) for i in full]
            ratio = self.table[tuple(np.concatenate(x) for x in zip(*parts, strict=True))]
            ends = np.cumsum([len(p[0]) for p in parts])
            out[full] = np.add.reduceat(ratio, np.r_[0, ends[:-1]]) / np.diff(np.r_[0, ends])
        return out


_CODE = np.full(256, len(ALPHABET), dtype=np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_START = len(ALPHABET) + 1


def _codes(token: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.r_[_START, _START, _CODE[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]]
    return x[:-2], x[1:-1], x[2:]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within each kind, in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, model: MarkovPair, base: list[tuple[int, int, int]], min_length: int, threshold: float, token: re.Pattern) -> list[tuple[int, int, int]]:
    """base, and tokens that the models call random and that touch no base span."""
    found, at, reach = [], 0, 0
    for m in token.finditer(text):  # both go by start, so one pass over base suffices
        a, b = m.span()
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a:
            found.append((a, b))
    if not found:
        return base
    keep = model.scores([text[a:b] for a, b in found]) > threshold
    return sorted(base + [(a, 3, b) for (a, b), k in zip(found, keep, strict=True) if k])


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _token(min_length: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{min_length},}}")


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: MarkovPair | None = None, min_length: int = 20, threshold: float = 0.9) -> DataFrame:
    """One row per input row: doc_id, counts by kind, base_spans and spans, as kind:start:end by start.

    The model's table has a fixed size (about 70 cubed), so it travels with the function.
    """
    model = model or MarkovPair.fit(labelled_samples())
    token = _token(min_length)
    id_type = df.select(col(id_col)).schema[0].dataType
    schema = pa.schema([("doc_id", _arrow(id_type)), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_spans", pa.string()), ("spans", pa.string())])

    def run(batches):
        def rows():
            for i, raw in rows_of(batches, "doc_id", "text"):
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                spans = all_spans(text, model, base, min_length, threshold, token)
                kinds = [k for _, k, _ in spans]
                yield (i, *(kinds.count(k) for k in range(4)), shown(base), shown(spans))

        return batches_of(rows(), schema)

    small_batches(df.sparkSession)
    out = ", ".join(["doc_id " + id_type.simpleString(), *(f"n_{k} long" for k in KINDS), "base_spans string", "spans string"])
    return id_text(df, id_col, text_col).mapInArrow(run, out)


def _arrow(spark_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)


def redact_secrets(df: DataFrame, text_col: str = "text", *, model: MarkovPair | None = None, min_length: int = 20, threshold: float = 0.9, mark: str = "<SECRET>") -> DataFrame:
    """df with each secret span of text_col replaced by mark (overlapping spans by one); null stays null.

    All columns and rows stay, in their order; nothing is shuffled.
    """
    model = model or MarkovPair.fit(labelled_samples())
    token = _token(min_length)

    def clean(text):
        if not text:
            return text
        out, at = [], 0
        for a, _, b in all_spans(text, model, base_spans(text), min_length, threshold, token):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    small_batches(df.sparkSession)
    return df.withColumn(text_col, redacted(col(text_col)))


def op1_digest(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def brute_spans(text: str) -> str:
    """The base spans by the plain patterns, for tests."""
    out = []
    for k, p in enumerate((ASSIGN, re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"))):
        for m in p.finditer(text):
            if (len(m[2]) >= 6) if k == 0 else len(m[0]) >= (20, 24)[k - 1]:
                out.append((m.start(), k, m.end()))
    return shown(sorted(out))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
