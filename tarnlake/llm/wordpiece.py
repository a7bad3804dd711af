"""Token counts by a linear longest-match automaton.

Greedy word pieces: a word (a run of bytes other than ASCII white space) takes the longest initial piece that it starts
with, then again and again the longest continuing piece. Only the number of pieces is wanted. The automaton is a trie over
the pieces with two roots, one for initial and one for continuing pieces. The failure link of a node leads to the node
reached by what is left after the pieces that greedy matching takes from the node's string, and the number of these
popped tokens stands beside it. So a word is read once, byte by byte, and no piece is ever built (Song and others, 2021).

All words of a batch are read at once, one byte of each at a time. A word that cannot be cut into pieces is one unknown
token.

The vocabulary is that of a byte-level tokenizer file: pieces that start with a space are initial, the others continue.
The space alone is no piece of a word, so a word that starts with no longer initial piece is unknown (those in Thai letters).

Defined cases: a null or empty text, or one of white space only, has no words and no tokens. Repeated rows each give a
row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hold, mapped, table, text_of

#: Words of more bytes are read one at a time; texts are read so many bytes at a time, or one by one.
LONG = 64
BYTES_AT_ONCE = 4_000_000
#: Roots of the trie, and no node at all.
INITIAL, CONTINUING, NONE = 0, 1, -1

_OPEN: dict[str, Automaton] = {}


def spelling() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable ones themselves, the others in their order from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """Initial and continuing pieces of a byte-level tokenizer file."""
    byte_of = spelling()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    initial, continuing = [], []
    for piece in spec["model"]["vocab"]:
        if piece in special or any(c not in byte_of for c in piece):
            continue  # no spelling of bytes
        raw = bytes(byte_of[c] for c in piece)
        if raw.startswith(b" "):
            if len(raw) > 1:
                initial.append(raw[1:])
        else:
            continuing.append(raw)
    return initial, continuing


class Automaton:
    """Transitions, failure links, numbers of popped tokens, and what is popped at a word's end."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        import numpy as np

        children: list[dict[int, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((INITIAL, initial), (CONTINUING, continuing)):
            for piece in pieces:
                node = root
                for byte in piece:
                    to = children[node].get(byte)
                    if to is None:
                        to = children[node][byte] = len(children)
                        children.append({})
                        token.append(False)
                    node = to
                token[node] = node > CONTINUING
        n = len(children)
        link, pops = [NONE] * n, [0] * n
        queue = deque((INITIAL, CONTINUING))
        while queue:
            node = queue.popleft()
            for byte, to in children[node].items():
                queue.append(to)
                if token[to]:
                    link[to], pops[to] = CONTINUING, 1
                    continue
                at, count = link[node], pops[node]
                while at != NONE and byte not in children[at]:
                    count += pops[at]
                    at = link[at]
                if at != NONE:
                    link[to], pops[to] = children[at][byte], count
        # at a word's end links are followed to the root of continuing pieces
        last = [NONE] * n
        last[CONTINUING] = 0
        for node in range(n):
            path = []
            while last[node] == NONE and link[node] != NONE:
                path.append(node)
                node = link[node]
            for before in reversed(path):
                last[before] = NONE if last[node] == NONE else last[node] + pops[before]
                node = before
        self.children, self.links, self.popped, self.ends = children, link, pops, last
        self.next = np.full((n, 256), NONE, np.int32)
        for node, to in enumerate(children):
            if to:
                self.next[node, list(to)] = list(to.values())
        self.link, self.pops, self.last = np.array(link, np.int32), np.array(pops, np.int32), np.array(last, np.int32)

    @classmethod
    def of(cls, path: str) -> Automaton:
        hold("wordpiece", _OPEN.clear)
        if path not in _OPEN:
            _OPEN[path] = cls(*vocabulary(path))
        return _OPEN[path]

    def count(self, word: bytes) -> int:
        """Pieces of one word; NONE if it has none."""
        node, total = INITIAL, 0
        for byte in word:
            while (to := self.children[node].get(byte)) is None:
                if self.links[node] == NONE:
                    return NONE
                total += self.popped[node]
                node = self.links[node]
            node = to
        return NONE if self.ends[node] == NONE else total + self.ends[node]

    def count_all(self, text: bytes):
        """(start of each word, its number of pieces or NONE) for all words of a text."""
        import numpy as np

        raw = np.frombuffer(text, np.uint8)
        blank = (raw == 32) | (raw >= 9) & (raw <= 13)
        edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
        start, length = edge[::2], edge[1::2] - edge[::2]
        order = np.argsort(-length, kind="stable")
        size = length[order]
        n_long = int(np.searchsorted(-size, -LONG, "left"))
        counts = np.zeros(len(start), np.int64)
        for k in order[:n_long]:
            counts[k] = self.count(text[start[k] : start[k] + length[k]])
        order, size = order[n_long:], size[n_long:]
        begin = start[order]
        node = np.zeros(len(order), np.int32)
        total = np.zeros(len(order), np.int32)
        for step in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -step, "left"))  # words longer than step
            byte = raw[begin[:k] + step]
            at = node[:k]
            to = self.next[at, byte]
            stuck = np.flatnonzero((to < 0) & (at >= 0))
            where = at[stuck]
            while len(stuck):
                total[stuck] += self.pops[where]
                where = self.link[where]
                lost = where < 0
                if lost.any():
                    to[stuck[lost]] = NONE
                    stuck, where = stuck[~lost], where[~lost]
                found = self.next[where, byte[stuck]]
                done = found >= 0
                to[stuck[done]] = found[done]
                stuck, where = stuck[~done], where[~done]
            node[:k] = np.where(at < 0, NONE, to)
        end = np.where(node < 0, NONE, self.last[node])
        counts[order] = np.where(end < 0, NONE, total + end)
        return start, counts


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """For every row: doc_id, n_words, n_tokens (pieces, and one for each unknown word), n_unknown."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        automaton = Automaton.of(path)
        for batch in batches:
            texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(1)]
            words, tokens, unknown = (np.zeros(len(texts), np.int64) for _ in range(3))
            first = 0
            while first < len(texts):
                stop, size = first, 0
                while stop < len(texts) and (stop == first or size + len(texts[stop]) <= BYTES_AT_ONCE):
                    size += len(texts[stop]) + 1
                    stop += 1
                start, counts = automaton.count_all(b" ".join(texts[first:stop]))
                begins = np.cumsum([0, *(len(t) + 1 for t in texts[first : stop - 1])])
                doc = np.searchsorted(begins, start, "right") - 1
                n = stop - first
                words[first:stop] = np.bincount(doc, minlength=n)
                unknown[first:stop] = np.bincount(doc, counts < 0, n)
                tokens[first:stop] = np.bincount(doc, np.where(counts < 0, 1, counts), n)
                first = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens), pa.array(unknown)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), rows, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
