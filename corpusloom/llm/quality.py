"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade <= k) = sigmoid(theta_k - s), with one score s = sum of shared hashed-text weights and ordered thresholds.
Grades are 0, 1, ... The expected grade and the tail probabilities P(grade >= k) serve for selection.
Null and empty texts have the features of an empty text; with no rated rows at all every document is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Memo, batches_of, col, id_text, rows_of, small_batches

BITS = 18
#: Rated rows that a fit reads at most; they are the ones of the smallest hash of their id. More change nothing here.
MAX_RATED = 10_000
#: Production threshold: a document is kept if P(good) is at least this. Under a half, since short texts show little evidence.
KEEP_FROM = 0.3
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)))
_RUN = re.compile(rb"(.)\1+", re.S)


class Features:
    """Indices of binary features: lower-case words that occur, and word shapes with the share of words that have them."""

    def __init__(self, bits: int = BITS):
        self.mask, self.words, self.shapes = (1 << bits) - 1, Memo(), Memo()

    def __call__(self, text: bytes) -> np.ndarray:
        raw = text.split()
        out = set()
        seen: dict[bytes, int] = {}
        words, shapes, mask = self.words, self.shapes, self.mask
        for w in raw:
            got = words.get(w)
            if got is None:
                shape = _RUN.sub(rb"\1", w.translate(_SHAPE))
                got = words.put(w, (zlib.crc32(w.lower()) & mask, shape), 300 + len(w) + len(shape))
            out.add(got[0])
            seen[got[1]] = seen.get(got[1], 0) + 1
        for shape, n in seen.items():
            share = min(5, int(6 * n / len(raw)))
            key = (shape, share)
            at = shapes.get(key)
            if at is None:
                at = shapes.put(key, zlib.crc32(b"\0%d " % share + shape) & mask, 300 + len(shape))
            out.add(at)
        return np.fromiter(out, np.int32, len(out))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, *, bits: int = BITS, steps: int = 120, l2: float = 2e-3, min_rows: int = 4) -> OrdinalModel:
    """Adam on the whole sample; features of under min_rows rows are left out."""
    size, n = 1 << bits, len(rows)
    weights, cuts = np.zeros(size, np.float32), np.linspace(-1, 1, n_grades - 1)
    if not n:
        return OrdinalModel(weights, np.full(n_grades - 1, -50.0), bits)
    lengths = np.array([len(r) for r in rows])
    cols = np.concatenate(rows) if lengths.sum() else np.zeros(0, np.int32)
    df = np.bincount(cols, minlength=size)
    used = np.flatnonzero(df >= min_rows)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(n), lengths)
    keep = place[cols] >= 0
    row, cols = row[keep], place[cols[keep]]
    w, gaps = np.zeros(len(used)), np.log(np.diff(cuts))
    x = np.r_[w, cuts[0], gaps]
    m, v = np.zeros_like(x), np.zeros_like(x)
    scale = np.minimum(1, 40 / np.sqrt(df[used] + 1))  # a common feature takes smaller steps
    for t in range(1, steps + 1):
        w, theta = x[: len(used)], np.cumsum(np.r_[x[len(used)], np.exp(x[len(used) + 1 :])])
        s = np.bincount(row, w[cols], minlength=n)
        full = np.r_[-np.inf, theta, np.inf]
        up, low = _sig(full[grades + 1] - s), _sig(full[grades] - s)
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        ds = (du - dl) / n  # of the loss by the score
        dth = np.zeros(n_grades + 1)
        np.add.at(dth, grades + 1, -du / n)
        np.add.at(dth, grades, dl / n)
        dth = dth[1:-1]
        tail = np.cumsum(dth[::-1])[::-1]
        g = np.r_[np.bincount(cols, ds[row], minlength=len(used)) + l2 / 10 * w, tail[0], tail[1:] * np.exp(x[len(used) + 1 :])]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        step[: len(used)] *= scale
        x = x - step * (1 - t / (steps + 20))
    weights[used] = x[: len(used)]
    return OrdinalModel(weights, np.cumsum(np.r_[x[len(used)], np.exp(x[len(used) + 1 :])]), bits)


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_ratings(docs: DataFrame, ratings: DataFrame, n_grades: int, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_RATED, bits: int = BITS) -> OrdinalModel:
    """ratings: (id, grade 0 .. n_grades - 1). Executors turn the rated texts into features; the driver gets the feature
    indices of max_rows rated ids at most (some hundred 4-byte numbers each) and fits. Equal rows of an id count once; if ids have so many
    different texts that 2 * max_rows are exceeded, those of the least hash of id and text are taken, whatever their grade."""
    rated = ratings.select(col(id_col).alias("doc_id"), F.col("grade").cast("int").alias("grade")).dropna()
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    small_batches(docs.sparkSession)
    texts = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"))
    schema = pa.schema([("grade", pa.int32()), ("h", pa.int64()), ("features", pa.binary())])

    def run(batches):
        made = Features(bits)
        return batches_of(((g, h, np.sort(made(t)).tobytes()) for g, h, t in rows_of(batches, "grade", "h", "text")), schema)

    each = texts.join(F.broadcast(rated), "doc_id").dropDuplicates(["doc_id", "text"])
    made = each.select("grade", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(run, "grade int, h long, features binary")
    got = made.orderBy("h", "features").limit(2 * max_rows).toArrow()
    pairs = sorted(zip(got["grade"].to_pylist(), got["features"].to_pylist(), strict=True))
    return fit([np.frombuffer(f, np.int32) for _, f in pairs], np.array([g for g, _ in pairs], dtype=np.int64), n_grades, bits=bits)


def score(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, expected_grade and tails (P(grade >= k), k = 1, 2, ...) of each row."""
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((model.weights, model.thresholds))  # 2**bits floats, whatever the input
    bits = model.bits
    id_type = df.select(col(id_col)).schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("score", pa.float64()), ("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64()))])

    def run(batches):
        weights, thresholds = held.value
        own, made = OrdinalModel(weights, thresholds, bits), Features(bits)

        def rows():
            for i, t in rows_of(batches, "doc_id", "text"):
                s = float(np.sort(weights[made(t)]).sum(dtype=np.float64))
                tails = own.tails(np.array([s]))[0]
                yield i, s, float(tails.sum()), tails.tolist()

        return batches_of(rows(), schema)

    return id_text(df, id_col, text_col).mapInArrow(run, f"doc_id {id_type.simpleString()}, score double, expected_grade double, tails array<double>")


def keep_good(df: DataFrame, model: OrdinalModel, grade: int, *, text_col: str = "text", least: float = KEEP_FROM) -> DataFrame:
    """The rows of df whose P(grade >= grade) is least or more, with all their columns; nothing is shuffled."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    bits = model.bits

    @F.pandas_udf("double")
    def tail(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, thresholds = held.value
        made = Features(bits)
        for texts in batches:
            s = np.array([float(np.sort(weights[made((t or "").encode())]).sum(dtype=np.float64)) for t in texts])
            yield pd.Series(OrdinalModel(weights, thresholds, bits).tails(s)[:, grade - 1] if len(s) else s)

    return df.filter(tail(F.coalesce(col(text_col), F.lit(""))) >= least)


def grades_of(labels: DataFrame) -> DataFrame:
    """The labels table as grades: 0 toxic, 1 neither toxic nor good, 2 good; null ratings are dropped."""
    return labels.dropna(subset=["doc_id", "quality", "toxic"]).select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1).alias("grade"))
