"""Token counts: greedy longest-match word pieces counted by a linear automaton.

A trie holds the pieces that may start a word and, under a root of its own, those that may continue one. Each node has a
failure link and the number of pieces that are popped when the link is taken, so a word's number of greedy pieces comes
from one pass over its bytes, and no piece is built. Null and empty texts have no words.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import batches_of, col, id_text, rows_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(pieces that may start a word, pieces that may continue one), from a file of base64 ranks. A token with a leading space
    starts a word; one without white space continues one. Single bytes do both, so every word has pieces."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    single = {bytes([i]) for i in range(256)} - set(map(bytes, zip(b" \t\n\v\f\r")))
    first = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and len(t.split()) == 1 and t[1:].strip() == t[1:]}
    rest = {t for t in tokens if t and t.split() == [t]}
    return sorted(first | single), sorted(rest | single)


class LongestMatch:
    """delta: a node's children; link and pops: its failure link (-1: none) and the number of pieces popped on the way."""

    START, REST = 0, 1

    def __init__(self, first: list[bytes], rest: list[bytes]):
        self.delta: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((self.START, first), (self.REST, rest)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.delta[at].get(c)
                    if to is None:
                        to = self.delta[at][c] = len(self.delta)
                        self.delta.append({})
                        final.append(False)
                    at = to
                final[at] = final[at] or bool(piece)
        self.link, self.pops = [-1] * len(self.delta), [0] * len(self.delta)
        level = [self.START, self.REST]
        while level:  # breadth first: a link leads to a shorter string
            below = []
            for u in level:
                for c, v in self.delta[u].items():
                    below.append(v)
                    if final[v]:
                        self.link[v], self.pops[v] = self.REST, 1
                        continue
                    z, popped = self.link[u], self.pops[u]
                    while z != -1 and c not in self.delta[z]:
                        popped += self.pops[z]
                        z = self.link[z]
                    if z != -1:
                        self.link[v], self.pops[v] = self.delta[z][c], popped
            level = below

    def count(self, word: bytes) -> int:
        """Number of greedy pieces; -1 if the word can't be covered."""
        delta, link, pops = self.delta, self.link, self.pops
        at, n = self.START, 0
        for c in word:
            while (to := delta[at].get(c)) is None:
                if link[at] == -1:
                    return -1
                n += pops[at]
                at = link[at]
            at = to
        while at not in (self.START, self.REST):
            if link[at] == -1:
                return -1
            n += pops[at]
            at = link[at]
        return n


def greedy_count(word: bytes, first: set[bytes], rest: set[bytes]) -> int:
    """The same number by plain longest match, for tests."""
    n, at, longest = 0, 0, max(map(len, first | rest), default=0)
    while at < len(word):
        have = rest if at else first
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in have), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


_BUILT: dict[int, tuple[LongestMatch, dict[bytes, int]]] = {}


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: tuple[list[bytes], list[bytes]] | None = None, memory: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown (words that no pieces cover; they count as one token) of each row, over the words
    between ASCII white space. The vocabulary is broadcast; its size doesn't depend on the table. Each Python worker builds
    the automaton once and remembers the counts of up to memory words."""
    from pyspark.sql.pandas.types import to_arrow_type

    held = df.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())
    key = held.id if hasattr(held, "id") else id(held)
    id_type = df.select(col(id_col)).schema[0].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches):
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = (LongestMatch(*held.value), {})
        machine, known = _BUILT[key]

        def rows():
            for i, text in rows_of(batches, "doc_id", "text"):
                words, total, unknown = text.split(), 0, 0
                if len(known) > memory:
                    known.clear()
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = known[w] = machine.count(w)
                    if n < 0:
                        unknown, n = unknown + 1, 1
                    total += n
                yield i, len(words), total, unknown

        return batches_of(rows(), schema)

    return id_text(df, id_col, text_col).mapInArrow(run, f"doc_id {id_type.simpleString()}, n_words long, n_tokens long, n_unknown long")
