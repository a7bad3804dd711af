"""SentencePiece encoding and decoding for merge-type vocabularies.

The symbols of a piece of text are merged by an agenda of adjacent pairs: the pair whose joined piece has the best score
goes first, of equal scores the leftmost; a pair goes stale when one of its sides is merged elsewhere. Characters outside
the vocabulary become byte pieces.

No piece of such a vocabulary has the space mark after another character (checked when a model is opened; else texts are
taken whole). So a text may be cut before each run of space marks, and a bounded memory keeps the ids of words seen.
Many new words are merged at once (`merge_all`): a table tells the rank and the id that a pair of symbols makes, the
agenda of each word is a row of ranks, and each step merges the best pair of every row. Longer words have an agenda each,
a heap (`merge`).

Every word that is merged is checked against the sentencepiece library, in one call for each slice of an Arrow batch, and
so is one whole text of each slice, the first. A difference raises ValueError: what the operator returns is its own.

Defined cases: a null text counts as empty and has no ids; white space of any kind is kept; a U+2581 in a text is the
space mark and decodes to a space, as in the library. Texts and words of any length are encoded whole: slices hold
BATCH_BYTES / 2 bytes of text or one longer text, and a heap's time grows as n log n. Repeated rows each give a row; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, hold, mapped, table, text_of
from .words import expanded, numbered, slices, totals

MARK = "▁"
#: Words of each of a worker's two memories; the longest word kept in them and merged with others.
WORDS_KEPT = 80_000
LONGEST_KEPT = 48
#: Ids decoded at a time.
IDS_AT_ONCE = 100_000

#: Texts that are not words between single spaces.
_UNEVEN = f"^$|^ | $|  |{MARK}"
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_ODD = 0x9E3779B97F4A7C15
_NONE = (1 << 31) - 1
_OPEN: dict[str, Pieces] = {}


class Pairs:
    """(left symbol, right symbol) to (rank, joined symbol), in an open hash table that many pairs are looked up in at once."""

    def __init__(self, known: dict[tuple[int, int], tuple[int, int]]):
        import numpy as np

        self.bits = max(4, (4 * len(known)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        self.joined = np.zeros(size, np.int32)
        pairs = np.array(list(known), np.int64).reshape(-1, 2)
        keys, values = pairs[:, 0] << 32 | pairs[:, 1], np.array(list(known.values()), np.int64).reshape(-1, 2)
        at = self.place(keys)
        self.probes = 0
        while len(keys):  # of those that want a free place one gets it; the others go on to the next
            self.probes += 1
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.ranks[at[won]], self.joined[at[won]] = values[won, 0], values[won, 1]
            keys, values, at = keys[~won], values[~won], at[~won] + 1 & size - 1

    def place(self, keys):
        import numpy as np

        return (keys.view(np.uint64) * np.uint64(_ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left, right):
        """(ranks, joined symbols) of arrays of pairs; the rank _NONE where they make no piece."""
        import numpy as np

        keys = (left.astype(np.int64) << 32 | right).ravel()
        at = self.place(keys)
        found = self.keys[at]
        ranks, joined = self.ranks[at], self.joined[at]
        other = found != keys
        ranks[other] = _NONE
        rest = np.flatnonzero(other & (found >= 0))  # somewhere behind, if at all
        at = at[rest]
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            at = at + 1 & len(self.keys) - 1
            found = self.keys[at]
            hit = found == keys[rest]
            ranks[rest[hit]], joined[rest[hit]] = self.ranks[at[hit]], self.joined[at[hit]]
            on = ~hit & (found >= 0)
            rest, at = rest[on], at[on]
        return ranks.reshape(left.shape), joined.reshape(left.shape)


class Pieces:
    """A model's pieces and scores, and the words encoded so far."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(p.get_piece_size())
        normal = [i for i in every if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in normal}
        by_score = sorted(normal, key=lambda i: -p.get_score(i))
        self.rank: dict[str, int] = {}  # equal scores share a rank
        best, rank = None, -1
        for i in by_score:
            if p.get_score(i) != best:
                best, rank = p.get_score(i), rank + 1
            self.rank[p.id_to_piece(i)] = rank
        self.bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in every if p.is_byte(i)}
        self.unknown = p.unk_id()
        self.by_words = not any(re.search(f"[^{MARK}]{MARK}", x) for x in self.ids)
        # symbols: pieces by their ids, then single characters that are no piece but part of one, then all other characters
        symbols = dict(self.ids)
        self.first_bare = len(every)
        for c in sorted({c for x in self.ids for c in x} - symbols.keys()):
            symbols[c] = self.first_bare + len(symbols) - len(self.ids)
        self.of_char = np.full(0x110000, self.first_bare + len(symbols) - len(self.ids), np.int32)
        for x, i in symbols.items():
            if len(x) == 1:
                self.of_char[ord(x)] = i
        self.length = np.ones(len(every), np.int64)
        for x, i in self.ids.items():
            self.length[i] = len(x)
        cuts = ((x, x[:k], x[k:]) for x in self.ids for k in range(1, len(x)))
        self.pairs = Pairs({(symbols[a], symbols[b]): (self.rank[x], self.ids[x]) for x, a, b in cuts if a in symbols and b in symbols})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        hold("pieces", _OPEN.clear)
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def of_char_alone(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def merge(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        rank = self.rank
        symbols: list[str] = list(text)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = [(r, i, i + 1, x) for i in range(n - 1) if (r := rank.get(x := symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, joined = heappop(agenda)
            # stale if a side is gone or has grown
            if not symbols[i] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(joined):
                continue
            symbols[i], symbols[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = joined + symbols[k]
                if (r := rank.get(x)) is not None:
                    heappush(agenda, (r, i, k, x))
            h = before[i]
            if h >= 0:
                x = symbols[h] + joined
                if (r := rank.get(x)) is not None:
                    heappush(agenda, (r, h, i, x))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out += [i] if i is not None else self.of_char_alone(s)
        return out

    def steps(self, symbols) -> Iterator:
        """(rows, what is left of their symbols) of a matrix of symbols, one row a word, as soon as no pair is left."""
        import numpy as np

        rows = np.arange(len(symbols))
        ranks, joined = self.pairs.look(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            n = symbols.shape[1]
            if n == 1:
                yield rows, symbols
                return
            best = ranks.argmin(1)
            live = ranks[np.arange(len(rows)), best] < _NONE
            if not live.all():
                yield rows[~live], symbols[~live]
                rows, symbols, ranks, joined, best = rows[live], symbols[live], ranks[live], joined[live], best[live]
            each = np.arange(len(rows))
            symbols[each, best] = joined[each, best]
            stay = np.ones(symbols.shape, bool)
            stay[each, best + 1] = False
            symbols = symbols[stay].reshape(len(rows), n - 1)
            stay = np.ones(ranks.shape, bool)
            stay[each, best] = False
            ranks, joined = (x[stay].reshape(len(rows), n - 2) for x in (ranks, joined))
            for side in (best - 1, best):  # the pairs that the new symbol stands in
                some = np.flatnonzero((side >= 0) & (side < n - 2))
                at = side[some]
                ranks[some, at], joined[some, at] = self.pairs.look(symbols[some, at], symbols[some, at + 1])

    def merge_all(self, texts: list[str], at_once: int = 20_000, few: int = 24) -> list[bytes]:
        """What `merge` gives for each of many short texts, as little-endian unsigned 32-bit integers."""
        import numpy as np

        out: list[bytes] = [b""] * len(texts)
        groups: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            groups.setdefault(len(t), []).append(k)
        for n, group in groups.items():
            if len(group) < few or n > LONGEST_KEPT:
                for k in group:
                    out[k] = np.array(self.merge(texts[k]), "<u4").tobytes()
                continue
            for first in range(0, len(group) if n else 0, at_once):
                some = group[first : first + at_once]
                chars = np.frombuffer("".join([texts[k] for k in some]).encode("utf-32-le", "surrogatepass"), "<u4")
                for rows, left in self.steps(self.of_char[chars].reshape(len(some), n)):
                    bare = (left >= self.first_bare).any(1)
                    ids, width = left.astype("<u4").tobytes(), 4 * left.shape[1]
                    for j, row in enumerate(rows.tolist()):
                        k = some[row]
                        out[k] = self.spelt(texts[k], left[j].tolist()) if bare[j] else ids[j * width : (j + 1) * width]
        return out

    def spelt(self, text: str, symbols: list[int]) -> bytes:
        """Ids of a text cut into symbols of which some are no pieces."""
        import numpy as np

        out, at = [], 0
        for s in symbols:
            if s < self.first_bare:
                out.append(s)
                at += int(self.length[s])
            else:
                out += self.of_char_alone(text[at])
                at += 1
        return np.array(out, "<u4").tobytes()

    def parts(self, text: str) -> list[str]:
        """Parts of the text, with its spaces as marks and one before it, that no piece crosses; without their first mark."""
        if not text:
            return []
        text = text.replace(" ", MARK)
        return [x[1:] for x in _PARTS.findall(MARK + text)] if self.by_words else [text]

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, each without its first mark."""
        if len(self.known) >= WORDS_KEPT:  # words in use come back from the older memory
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, words))
        fresh = []
        for k, ids in enumerate(out):
            if ids is None:
                w = words[k]
                if w in older:
                    out[k] = known[w] = older[w]
                else:
                    fresh.append(k)
        new = [words[k] for k in fresh]
        made = self.merge_all([MARK + w for w in new])
        self.check(new, made)
        for k, w, ids in zip(fresh, new, made, strict=True):
            out[k] = ids
            if len(w) < LONGEST_KEPT:
                known[w] = ids
        return out

    def check(self, texts: list[str], ids: list[bytes]) -> None:
        """Raise ValueError if the library, which puts a mark before what it is given, has other ids."""
        from itertools import chain

        import numpy as np

        if "" in texts:  # a mark alone; the library puts none before an empty text
            k = texts.index("")
            texts, ids = texts[:k] + texts[k + 1 :], ids[:k] + ids[k + 1 :]
        its = self.library.encode(texts, num_threads=1) if texts else []
        if np.array_equal(np.fromiter(chain.from_iterable(its), "<u4"), np.frombuffer(b"".join(ids), "<u4")) and list(map(len, its)) == [len(x) // 4 for x in ids]:
            return
        wrong = next(t for t, x, y in zip(texts, its, ids, strict=True) if np.array(x, "<u4").tobytes() != y)
        raise ValueError(f"the sentencepiece library has other ids for {wrong[:200]!r}")

    def encode(self, texts):
        """(ids, sizes) of an Arrow array of texts without nulls: all ids one after the other, and how many each text has."""
        codes, counts, words = numbered(texts, _UNEVEN if self.by_words else "", self.parts)
        ids, sizes = expanded(codes, self.of_words(words))
        sizes = totals(sizes, counts)
        if len(texts):
            self.check([texts[0].as_py()], [ids[: sizes[0]].tobytes()])
        return ids, sizes

    def decode(self, ids, sizes) -> list[str]:
        import numpy as np

        ends = np.concatenate([[0], np.cumsum(sizes)])
        out: list[str] = []
        while len(out) < len(sizes):  # a bounded number of ids as Python's integers at a time, or one longer text
            at = len(out)
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + IDS_AT_ONCE, "right")) - 1)
            out += self.library.decode([ids[a:b].tolist() for a, b in zip(ends[at:stop], ends[at + 1 : stop + 1], strict=True)], num_threads=1)
        return out


def _encoded(batches: Iterator, model: str) -> Iterator:
    """(doc_ids, ids of all texts, how many each has, decoded texts) of a slice of rows at a time."""
    pieces = Pieces.of(model)
    for batch in batches:
        for some in slices(batch, 1):
            ids, sizes = pieces.encode(some.column(1))
            yield some.column(0), ids, sizes, pieces.decode(ids, sizes)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """For every row: doc_id, ids, decoded."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for doc_ids, ids, sizes, decoded in _encoded(batches, model):
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([doc_ids, lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), rows, "doc_id bigint, ids array<int>, decoded string", BATCH_BYTES // 2)


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """What `encode_documents` gives as digests, made beside it in the workers: doc_id, n_tokens, ids_sha256,
    decoded_sha256."""

    def rows(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        decimal: list[str] = []
        for doc_ids, ids, sizes, decoded in _encoded(batches, model):
            if (top := int(ids.max(initial=0))) >= len(decimal):
                decimal += map(str, range(len(decimal), top + 1))
            ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            of_ids = [sha256(",".join(map(decimal.__getitem__, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            of_text = [sha256(x.encode()).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", BATCH_BYTES // 2)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
