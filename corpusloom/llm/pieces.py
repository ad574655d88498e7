"""SentencePiece encoding and decoding: Viterbi over piece scores, for batches of equal-length units at once.

Units are cut where no piece can reach across. All units of one length advance together: the hash of each substring is probed
among the sorted hashes of the pieces of that length, hits are compared in full, and a maximum over the
piece lengths gives the best score and its backpointer at each position. Characters without a piece become byte pieces.
A tie goes to the longer last piece. decode(encode(text)) is text, for every text. Null counts as empty: no pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Memo, batches_of, col, id_text, rows_of, small_batches, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_LITERAL = "\udfff"  # stands for a U+2581 of the text itself; no UTF-8 text holds this code point
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """(pieces, scores, kinds) by id; kind 0: ordinary, 1: byte, 2: control, unknown or unused."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n)]
    return [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds


@dataclass
class Encoder:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    known: Memo = field(default_factory=Memo)

    def __post_init__(self):
        self.byte_id = np.full(256, -1, np.int32)
        by_length: dict[int, list[int]] = {}
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == 1:
                self.byte_id[int(p[3:5], 16)] = i
            elif k == 0 and p:
                by_length.setdefault(len(p), []).append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model needs a byte piece for each byte")
        self.longest = max(by_length, default=1)
        ids = [i for n in by_length for i in by_length[n]]
        self.codes = np.zeros((len(ids), self.longest), np.uint32)  # aligned to the right
        for r, i in enumerate(ids):
            self.codes[r, self.longest - len(self.pieces[i]) :] = [ord(c) for c in self.pieces[i]]
        self.keys = np.concatenate([self._hash(np.array([[ord(c) for c in self.pieces[i]] for i in by_length[n]], np.uint32)) for n in by_length]) if ids else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        if len(np.unique(self.keys)) < len(ids):
            raise ValueError("two pieces have one hash")
        self.keys, self.codes, self.ids = self.keys[order], self.codes[order], np.array(ids, np.int32)[order]
        self.values = np.array([self.scores[i] for i in self.ids.tolist()])
        self.likely = np.zeros(1 << 20, bool)  # spares most substrings the search
        self.likely[self.keys >> np.uint64(44)] = True
        low = min((self.scores[i] for ids in by_length.values() for i in ids), default=0.0)
        self.byte_score = 2 * min(low, 0.0) - 10
        inner = {c for n, ids in by_length.items() if n > 1 for i in ids for c in self.pieces[i]}
        spaced = any(SPACE in p[1:].lstrip(SPACE) or (p.endswith(SPACE) and p.strip(SPACE)) for ids in by_length.values() for i in ids for p in [self.pieces[i]])
        letters = "".join(re.escape(c) for c in sorted(inner - {SPACE}))
        # a run of spaces starts a unit, unless some piece has one inside; a character that no longer piece holds is a unit
        self.units = re.compile(f"[{letters}{SPACE}]+|." if spaced else f"{SPACE}+[{letters}]*|[{letters}]+|.", re.S)
        self.output = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                h = h * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        return h

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as little-endian int32."""
        out: list[bytes] = [b""] * len(units)
        by_length: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            by_length.setdefault(len(u), []).append(k)
        for n, ks in by_length.items():
            step = max(1, 1_500_000 // ((n + 1) * min(n + 1, self.longest)))
            for at in range(0, len(ks), step):
                part = ks[at : at + step]
                for k, ids in zip(part, self._viterbi([units[k] for k in part], n), strict=True):
                    out[k] = ids
        return out

    def _viterbi(self, units: list[str], n: int) -> list[bytes]:
        m, most = len(units), self.longest
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        real = np.where(codes == ord(_LITERAL), ord(SPACE), codes)
        size = 1 + (real > 0x7F).astype(np.int8) + (real > 0x7FF) + (real > 0xFFFF)
        before = np.zeros((m, most + n), np.uint32)
        before[:, most:] = codes
        prefix, power = np.zeros((m, n + 1), np.uint64), np.ones(most + 1, np.uint64)
        best, back, made = np.full((m, n + 1), -np.inf), np.zeros((m, n + 1), np.int32), np.full((m, n + 1), -1, np.int32)
        best[:, 0] = 0
        rows = np.arange(m)
        with np.errstate(over="ignore"):
            for j in range(n):
                prefix[:, j + 1] = prefix[:, j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
            for j in range(1, most + 1):
                power[j] = power[j - 1] * _BASE
            for j in range(1, n + 1):
                k = min(j, most)  # columns: the substrings that end at j, the longest first
                probe = prefix[:, j, None] - prefix[:, j - k : j] * power[k:0:-1]
                r, c = np.nonzero(self.likely[probe >> np.uint64(44)])
                wanted = probe[r, c]
                at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = self.keys[at] == wanted
                r, c, at = r[hit], c[hit], at[hit]
                same = self.codes[at]
                full = ((same == before[r, j : j + most]) | (same == 0)).all(1)
                r, c, at = r[full], c[full], at[full]
                score, which = np.full((m, k), -np.inf), np.full((m, k), -1, np.int32)
                score[r, c], which[r, c] = best[r, j - k + c] + self.values[at], self.ids[at]
                fall = best[:, j - 1] + self.byte_score * size[:, j - 1]
                score[:, k - 1] = np.where(which[:, k - 1] >= 0, score[:, k - 1], fall)
                top = score.argmax(1)
                best[:, j], made[:, j], back[:, j] = score[rows, top], which[rows, top], j - k + top
        pos, steps = np.full(m, n), []
        while len(rows):
            start = back[rows, pos[rows]]
            steps.append((rows, start, made[rows, pos[rows]]))
            pos[rows] = start
            rows = rows[start > 0]
        row, start, ids = (np.concatenate(x) for x in zip(*reversed(steps), strict=True))
        order = np.argsort(row, kind="stable")
        row, start, ids = row[order], start[order], ids[order]
        ends = np.cumsum(np.bincount(row, minlength=m)).tolist()
        flat = ids.astype("<i4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
        for r in np.unique(row[ids < 0]).tolist():
            part = range(ends[r - 1] if r else 0, ends[r])
            out[r] = b"".join([ids[x].astype("<i4").tobytes() if ids[x] >= 0 else self.byte_id[np.frombuffer(chr(real[r, start[x]]).encode(), np.uint8)].astype("<i4").tobytes() for x in part])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian int32; an empty text has none."""
        cut = [self.units.findall(SPACE + t.replace(SPACE, _LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        new = list(dict.fromkeys(u for us in cut for u in us if u not in known))
        made = dict(zip(new, self.encode_units(new), strict=True))
        out = [b"".join([known.get(u) or made[u] for u in us]) for us in cut]
        for u, ids in made.items():
            known.put(u, ids, 220 + 4 * len(u) + len(ids))
        return out

    def decode(self, ids: bytes) -> str:
        """The text that was encoded: pieces joined, spaces restored, without the space put before the text."""
        output = self.output
        return b"".join([output[i] for i in np.frombuffer(ids, "<i4").tolist()])[1:].decode("utf-8", "replace")


_BUILT: dict[int, Encoder] = {}


def _encoder(held) -> Encoder:
    key = id(held.value)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Encoder(*held.value)
    return _BUILT[key]


def encode_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: tuple | None = None) -> DataFrame:
    """doc_id, n_chars, n_pieces, n_bytes (byte pieces), ids_sha256 (of little-endian int32 ids), decoded_sha256 (of the text decoded
    from the ids) and round_trip of each row. The piece table is broadcast; its size is the model's."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model or load_pieces())
    id_type = df.select(col(id_col)).schema[0].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(batches):
        made = _encoder(held)
        is_byte = np.array(made.kinds) == 1

        def rows():
            for part in _parts(rows_of(batches, "doc_id", "text")):
                texts = [t.decode("utf-8", "replace") for _, t in part]
                for (i, _), text, ids in zip(part, texts, made.encode_batch(texts), strict=True):
                    back = made.decode(ids)
                    n = np.frombuffer(ids, "<i4")
                    yield i, len(text), len(n), int(is_byte[n].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text

        return batches_of(rows(), schema)

    return id_text(df, id_col, text_col).mapInArrow(run, f"doc_id {id_type.simpleString()}, n_chars long, n_pieces long, n_bytes long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def encode_column(df: DataFrame, text_col: str = "text", out_col: str = "piece_ids", *, model: tuple | None = None, checked_col: str | None = None) -> DataFrame:
    """df with the piece ids of text_col as array<int> in out_col (replacing one of that name); null for a null text. With checked_col, that
    column says whether the ids decode to the text; true for a null text. Nothing is shuffled."""
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model or load_pieces())

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = _encoder(held)
        for texts in batches:
            ids, same = [], []
            for part in _parts((t, t or "") for at in range(0, len(texts), 500) for t in texts.slice(at, 500).to_pylist()):
                for (t, text), b in zip(part, made.encode_batch([x for _, x in part]), strict=True):
                    ids.append(None if t is None else b)
                    same.append(t is None or checked_col is None or made.decode(b) == text)
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(same, pa.bool_())], ["ids", "same"])

    made = encoded(col(text_col))
    if checked_col is None:
        return df.withColumn(out_col, made["ids"])
    held_col = unused("_pieces", df)
    return df.withColumn(held_col, made).withColumns({out_col: col(held_col)["ids"], checked_col: col(held_col)["same"]}).drop(held_col)


def decode_column(df: DataFrame, ids_col: str = "piece_ids", out_col: str = "text", *, model: tuple | None = None) -> DataFrame:
    """df with the text of the piece ids in ids_col as out_col; null for null."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model or load_pieces())

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = _encoder(held)
        for ids in batches:
            yield pa.array([None if not x.is_valid else made.decode(x.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()) for x in ids], pa.string())

    return df.withColumn(out_col, text(col(ids_col)))


def _lists(ids: list[bytes | None]) -> pa.Array:
    """Little-endian int32 ids as an Arrow array of lists."""
    ends = np.cumsum([0] + [len(b or b"") // 4 for b in ids]).astype(np.int32)
    valid = np.array([b is not None for b in ids], bool)
    flat = pa.array(np.frombuffer(b"".join(b or b"" for b in ids), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~valid))


def _parts(rows, weight: int = 3 << 20):
    """Lists of rows, of about weight characters or one row each."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[1])
        if size >= weight:
            yield part
            part, size = [], 0
    if part:
        yield part
