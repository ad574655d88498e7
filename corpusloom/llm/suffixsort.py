"""Suffix-array dedup with deep-shallow sorting.

The suffixes that start at anchors of one key, and the reversed prefixes that end there, are sorted: by multikey quicksort, eight bytes a character,
down to a shallow depth, and then, in groups that still agree, by blind tries. Neighbours' common prefixes give, for any depth, classes of suffixes
that agree so far. A window lies partly before and partly behind its anchor; windows are equal if both classes are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import repeats

WINDOW, GRAM, SHALLOW = 100, 24, 32


class BlindTrie:
    """Sorts distinct strings of one length: inner nodes know only a depth and the bytes that branch there, so a descent looks at
    few bytes; the leaf that it reaches is compared in full once."""

    def __init__(self, strings: list[bytes]):
        self.root: list | int = 0  # a leaf is an index, an inner node [depth, {byte: child}]
        self.strings = strings
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        new, node = self.strings[i], self.root
        while isinstance(node, list):
            node = node[1].get(new[node[0]]) if new[node[0]] in node[1] else next(iter(node[1].values()))
        old = self.strings[node]
        depth = _first_difference(old, new)
        node, above = self.root, None
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][new[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][new[depth]] = i
            return
        made = [depth, {old[depth]: node, new[depth]: i}]
        if above is None:
            self.root = made
        else:
            above[1][new[above[0]]] = made

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def _first_difference(a: bytes, b: bytes) -> int:
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def deep_shallow(table: np.ndarray, shallow: int = SHALLOW, starts: np.ndarray | None = None) -> np.ndarray:
    """The order of the rows of a byte table within the ranges that begin at starts (one range without); equal rows in any order."""
    n, wide = table.shape
    order = np.arange(n)
    if not n:
        return order
    words = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    words[:, :wide] = table
    words = words.view(">u8").astype(np.uint64)
    for a, b in multikey_quicksort(words, order, np.zeros(1, np.int64) if starts is None else starts, min(words.shape[1], max(1, shallow // 8))):
        same: dict[bytes, list[int]] = {}
        for r in order[a:b].tolist():
            same.setdefault(table[r].tobytes(), []).append(r)
        if len(same) > 1:
            strings = list(same)
            order[a:b] = [r for i in BlindTrie(strings).order() for r in same[strings[i]]]
    return order


def multikey_quicksort(words: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Sorts order, in place, by the first most columns of words within the ranges that begin at starts. Each round splits every open range in three
    by a pivot of its own at its own depth: less, equal, greater; equal ones go on one column deeper. The ranges that agree in all most columns."""
    start, size = starts, np.diff(np.r_[starts, len(order)])
    depth = np.zeros(len(start), np.int64)
    done: list[tuple[int, int]] = []
    while True:
        full = (size > 1) & (depth >= most)
        done += zip(start[full].tolist(), (start[full] + size[full]).tolist(), strict=True)
        live = (size > 1) & (depth < most)
        start, size, depth = start[live], size[live], depth[live]
        if not len(start):
            return sorted(done)
        ends = np.cumsum(size)
        base = ends - size  # of each range among the live places
        of = np.repeat(np.arange(len(start)), size)
        place = np.arange(ends[-1]) + (start - base)[of]
        rows = order[place]
        key = words[rows, depth[of]]
        pivot = key[base + size // 2][of]
        less, equal = key < pivot, key == pivot
        n_less, n_equal = np.add.reduceat(less, base, dtype=np.int64), np.add.reduceat(equal, base, dtype=np.int64)
        rank = np.arange(ends[-1]) - base[of]
        a = np.cumsum(less) - less
        a -= a[base][of]  # less ones before, in the range
        b = np.cumsum(equal) - equal
        b -= b[base][of]
        to = np.where(less, a, np.where(equal, n_less[of] + b, (n_less + n_equal)[of] + rank - a - b))
        order[start[of] + to] = rows
        n_more = size - n_less - n_equal
        start, size, depth = np.r_[start, start + n_less, start + n_less + n_equal], np.r_[n_less, n_equal, n_more], np.r_[depth, depth + 1, depth]


def common_prefixes(table: np.ndarray, order: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each row of the order shares with the one before; 0 for the first, and where a range begins."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 50_000):
        part = order[at - 1 : at + 50_000]
        differ = table[part[1:]] != table[part[:-1]]
        out[at : at + len(part) - 1] = np.where(differ.any(1), differ.argmax(1), table.shape[1])
    if starts is not None:
        out[starts] = 0
    return out


def match(records: list[tuple], window: int = WINDOW) -> list[np.ndarray]:
    """For each record, which of its windows also occur in a record of a smaller id, or before in the same row."""
    m = len(records)
    back = window - GRAM
    at = np.array([r[4] for r in records], np.int64)
    lo, hi = np.array([r[5] for r in records], np.int64), np.array([r[6] for r in records], np.int64)
    ends = np.cumsum(hi - lo + 1)
    base = np.r_[0, ends[:-1]]
    flat = np.zeros(int(ends[-1]) if m else 0, bool)
    ids = np.array([r[2] for r in records], np.int64)
    rows = np.array([r[3] for r in records], np.int64)
    classes, longest = [], np.zeros(m, np.int64)
    keys = np.array([r[0] for r in records], np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if m else np.zeros(0, np.int64)
    for table in _tables(records, at, lo, window, back):
        order = deep_shallow(table, starts=starts)
        lcp = common_prefixes(table, order, starts)
        classes.append((order, lcp))
        longest[order] += np.maximum(lcp, np.r_[lcp[1:], 0][: len(lcp)])
    # a window needs its length in common with another record, before and behind the anchor together
    some = np.flatnonzero(longest >= window)
    rank = some[np.lexsort((at[some], ids[some]))]  # by id and place
    before = at - lo
    least = at - hi
    for i in range(back + 1):  # windows with i bytes before the anchor
        use = rank[(least[rank] <= i) & (i <= before[rank])]
        if len(use) < 2:
            continue
        both = np.zeros(len(use), np.int64)
        for (order, lcp), depth in zip(classes, (window - i, i), strict=True):
            key = np.empty(m, np.int64)
            key[order] = np.cumsum(lcp < depth)
            both = both * (m + 1) + key[use]
        by = np.argsort(both, kind="stable")
        new = np.r_[True, both[by][1:] != both[by][:-1]]
        if new.all():
            continue
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        here, head = use[by], use[by[first]]
        other = here != head
        # the first of the class precedes, unless it stands in another row of the same id
        dup = other & ((ids[head] < ids[here]) | (rows[head] == rows[here]))
        for x in np.flatnonzero(other & ~dup).tolist():  # look for an earlier window of the same row
            j = here[x]
            same = here[(first == first[x]) & (ids[here] == ids[j]) & (rows[here] == rows[j]) & (at[here] < at[j])]
            if len(same):
                flat[base[j] + before[j] - i] = True
        hit = here[dup]
        flat[base[hit] + before[hit] - i] = True
    return [flat[a:b] for a, b in zip(base.tolist(), ends.tolist(), strict=True)]


def _tables(records: list[tuple], at: np.ndarray, lo: np.ndarray, window: int, back: int):
    """The bytes from each anchor on, and those before it in reverse, as tables that are filled up with zeros."""
    sizes = np.array([len(r[7]) for r in records], np.int64)
    start = np.r_[0, np.cumsum(sizes)[:-1]]
    text = np.frombuffer(b"".join(r[7] for r in records) + b"\0", np.uint8)
    middle = (start + at - lo)[:, None]
    place = middle + np.arange(window)
    yield np.where(place < (start + sizes)[:, None], text[np.minimum(place, len(text) - 1)], 0).astype(np.uint8)
    place = middle - 1 - np.arange(back)
    yield np.where(place >= start[:, None], text[np.maximum(place, 0)], 0).astype(np.uint8)


class _Bytes:
    @staticmethod
    def symbols(text: bytes) -> bytes:
        return text

    @staticmethod
    def pieces(text: bytes):
        return lambda a, b: text[a:b]

    @staticmethod
    def join(text: bytes, spans: list[list[int]]) -> bytes:
        out, at = [], 0
        for a, b in spans:
            out.append(text[at:a])
            at = b
        return b"".join([*out, text[at:]])


def _reader():
    return lambda text: np.frombuffer(text, np.uint8)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n, n_removed, n_spans and kept (bytes, which may cut a character) of each row: without any byte that is covered by a window
    which also starts earlier, in a smaller id or the same row. An empty table gives no rows."""
    return repeats.remove(df, id_col, text_col, window=window, k=GRAM, reader=_reader, matcher=match, cutter=_Bytes, hot=hot)


def op5_result(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(doc_id, n, n_removed, n_spans, kept) by a table of all windows, for tests; ids are distinct."""
    seen: dict[bytes, tuple] = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    out = []
    for d, text in order:
        t = (text or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - window + 1):
            w = t[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            else:
                seen[w] = (d, p)
        edge = np.diff(np.r_[0, gone.astype(np.int8)])
        out.append((d, len(t), int(gone.sum()), int((edge == 1).sum()), bytes(c for c, g in zip(t, gone, strict=False) if not g)))
    return out
