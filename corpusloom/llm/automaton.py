"""Substring dedup by suffix automata of reference shards.

The reference is every text, cut to the segments around fingerprints that occur again. A shard is segments of some SHARD words, and its automaton accepts
all their factors; each state knows the first segment, in the order of documents, that it stands in. Documents' segments stream past the
automaton for matching statistics, the length of the longest suffix read so far that the shard holds; where that is a window or more, the
state of just the window tells whether it starts earlier. A shard of an unbounded corpus goes to the one task that meets its fingerprints; a
reference of bounded size, such as a benchmark, is broadcast in shards by remove_reference().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import repeats
from corpusloom.llm.common import batches_of, col, id_text, rows_of
from corpusloom.llm.neardup import Words

WINDOW, GRAM = 20, 8
#: Words of the segments in one automaton, but for a segment or group that is longer by itself.
SHARD = 40_000


class SuffixAutomaton:
    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.first = [0]  # the string in which each state first stands
        self.last = self.string = 0

    def begin(self, string: int = 0) -> None:
        """What follows is another string, known by a number."""
        self.last, self.string = 0, string

    def extend(self, c) -> None:
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        q = nxt[p].get(c)
        if q is not None:  # the string so far is known already
            if length[q] == length[p] + 1:
                self.last = q
                return
            self.last = self._clone(p, q, c)
            return
        cur = len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        self.first.append(self.string)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        self.last = cur

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def step(self, state: int, size: int, c) -> tuple[int, int]:
        """The state and length of the longest suffix after reading c."""
        nxt, link, length = self.next, self.link, self.length
        while state and c not in nxt[state]:
            state = link[state]
            size = length[state]
        if c in nxt[state]:
            return nxt[state][c], size + 1
        return 0, 0

    def firsts(self, symbols, window: int) -> list[int]:
        """For each window of symbols, the first string that holds it; -1 if none does."""
        state, size, out = 0, 0, []
        link, length, first = self.link, self.length, self.first
        for c in symbols:
            state, size = self.step(state, size, c)
            if size >= window:
                q = state
                while length[link[q]] >= window:
                    q = link[q]
                out.append(first[q])
            else:
                out.append(-1)
        return out[window - 1 :]

    def statistics(self, symbols) -> list[int]:
        state, size, out = 0, 0, []
        for c in symbols:
            state, size = self.step(state, size, c)
            out.append(size)
        return out


def match(records: list[tuple], window: int = WINDOW) -> list[np.ndarray]:
    """For each record, which of its windows also occur in a record of a smaller id, or before in the same row. Records come
    sorted by key, salt, id and place; whole groups of one key and salt make a shard."""
    out: list[np.ndarray] = []
    at = words = 0
    for i, r in enumerate(records):
        if words >= SHARD and r[:2] != records[i - 1][:2]:
            out += _shard(records[at:i], window)
            at, words = i, 0
        words += r[6] - r[5] + window
    return out + _shard(records[at:], window) if records else out


def _shard(records: list[tuple], window: int) -> list[np.ndarray]:
    order = sorted(range(len(records)), key=lambda i: (records[i][2], records[i][4]))
    machine = SuffixAutomaton()
    kinds: dict[int, set[bytes]] = {}  # the distinct segments of each key
    for r in records:
        kinds.setdefault(r[0], set()).add(r[7])
    split: dict[bytes, list[bytes]] = {}
    firsts: dict[bytes, np.ndarray] = {}
    for i in order:
        part = records[i][7]
        if part in split:
            continue
        split[part] = part.split(b" ")
        if len(kinds[records[i][0]]) == 1:  # nothing else to meet: all its windows stand here first
            firsts[part] = np.full(len(split[part]) - window + 1, i, np.int64)
            continue
        machine.begin(i)
        for w in split[part]:
            machine.extend(w)
    ids, rows, places = (np.array([r[k] for r in records], np.int64) for k in (2, 3, 4))
    for part, words in split.items():
        if part not in firsts:
            firsts[part] = np.array(machine.firsts(words, window), np.int64)
    out: list[np.ndarray] = []
    for i, r in enumerate(records):
        first = firsts[r[7]]
        same = ids[first] == ids[i]
        flags = (ids[first] < ids[i]) | (same & (rows[first] == rows[i]) & (places[first] < places[i]))
        for j in np.flatnonzero(same & (rows[first] != rows[i])).tolist():
            # the first stands in another row of the id, which doesn't precede: look for an earlier one in the same row
            own = split[r[7]][j : j + window]
            flags[j] = any(o[2:4] == r[2:4] and o[4] < r[4] and o[0] == r[0] and _holds(split[o[7]], own) for o in records)
        out.append(flags)
    return out


def _holds(words: list[bytes], some: list[bytes]) -> bool:
    return any(words[a : a + len(some)] == some for a in range(len(words) - len(some) + 1))


class _Words:
    @staticmethod
    def symbols(text: bytes) -> list[bytes]:
        return text.split()

    @staticmethod
    def pieces(text: bytes):
        words = text.split()
        return lambda a, b: b" ".join(words[a:b])

    @staticmethod
    def join(words: list[bytes], spans: list[list[int]]) -> bytes:
        out, at = [], 0
        for a, b in spans:
            out += words[at:a]
            at = b
        return b" ".join(out + words[at:])


def _reader():
    known = Words()

    def read(text: bytes):
        return known.hashes(text.split())

    return read


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n (words), n_removed, n_spans and kept (words joined by one space, as bytes) of each row: without any word that is
    covered by a window which also starts earlier, in a smaller id or the same row. An empty table gives no rows."""
    return repeats.remove(df, id_col, text_col, window=window, k=GRAM, reader=_reader, matcher=match, cutter=_Words, hot=hot)


def remove_reference(df: DataFrame, reference: list[bytes], id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, max_words: int = 2_000_000, shard_words: int = 200_000) -> DataFrame:
    """The same for windows that occur in reference, texts of max_words words at most in all: broadcast automata of its shards.

    doc_id, n, n_removed, n_spans, kept.
    """
    shards: list[list[list[bytes]]] = [[]]
    total = size = 0
    for text in reference:
        words = text.split()
        total += len(words)
        if size + len(words) > shard_words and shards[-1]:
            shards.append([])
            size = 0
        size += len(words)
        shards[-1].append(words)
    if total > max_words:
        raise ValueError(f"the reference has {total} words, over the bound of {max_words}: use remove_repeats() on the union")
    held = df.sparkSession.sparkContext.broadcast(shards)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.select(col(id_col)).schema[0].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        machines = []
        for texts in held.value:
            machines.append(SuffixAutomaton())
            for words in texts:
                machines[-1].begin()
                for w in words:
                    machines[-1].extend(w)

        def rows():
            for i, text in rows_of(batches, "doc_id", "text"):
                words = text.split()
                gone = np.zeros(len(words), bool)
                for machine in machines:
                    for j, s in enumerate(machine.statistics(words)):
                        if s >= window:
                            gone[j - s + 1 : j + 1] = True
                edge = np.diff(np.r_[0, gone.astype(np.int8)])
                yield i, len(words), int(gone.sum()), int((edge == 1).sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)

        return batches_of(rows(), schema)

    return id_text(df, id_col, text_col).mapInArrow(run, f"doc_id {kind.simpleString()}, n long, n_removed long, n_spans long, kept binary")


def op7_result(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(doc_id, n, n_removed, kept) by a table of all windows, for tests; ids are distinct."""
    seen: set[tuple] = set()
    out = []
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        t = (text or "").encode().split()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            w = tuple(t[p : p + window])
            if w in seen:
                gone[p : p + window] = True
            seen.add(w)
        out.append((d, len(t), int(gone.sum()), b" ".join(w for w, g in zip(t, gone, strict=True) if not g)))
    return out
