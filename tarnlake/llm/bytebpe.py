"""Whole texts to ids by the tokenizers library, word by word with a bounded memory of words seen."""

from __future__ import annotations

import os
import re
import struct
from operator import attrgetter

from .common import hold
from .words import expanded, numbered, totals

#: Words of each of a worker's two memories, and the longest word kept in them.
WORDS_KEPT = 200_000
LONGEST_KEPT = 48
#: Short runs that no space precedes, remembered beside them.
UNITS_KEPT = 50_000

#: Texts with a space after other white space, which are cut less often (for RE2, all white space of Unicode).
_UNEVEN = r"[\s\v\x1c-\x1f\x{85}\p{Z}] "
_CUT = re.compile(r"(?<=\S) ")
#: Visible ASCII and Latin letters, for which the pattern's classes are beyond doubt, in lines; what the pattern cuts them into.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[!-~{_LATIN}]+(?:\n[!-~{_LATIN}]+)*")
_UNITS = re.compile(rf" [{_LATIN}]+| [0-9]+| [^\s{_LATIN}0-9]+|'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9]+|[^\s{_LATIN}0-9]+|\n")
_OPEN: dict[str, Encoder] = {}
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(64)]
_ID = attrgetter("id")


def _bytes(ids: list[int]) -> bytes:
    return _PACKED[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class _Spelling(dict):
    """How byte-level vocabularies spell a character, by code point, as the library says."""

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel

        (found, _), = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))
        self[code] = found
        return found


class Encoder:
    """The ids of ' ' + word by word, as little-endian unsigned 32-bit integers.

    A byte-level vocabulary with the usual pattern never joins what stands before and after a space that follows a
    character other than white space. So a text may be cut before each such space and its parts encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.of_word = self.tokenizer.model.tokenize
        self.spelt = _Spelling()
        self.space = " ".translate(self.spelt)
        # strings of special tokens, wherever they stand
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)").search
        self.marks = {c: self.direct(c) for c in ",.;:!?"}
        self.units = {"\n": self.direct("\n")}

    @classmethod
    def of(cls, path: str) -> Encoder:
        hold("bytebpe", _OPEN.clear)
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def direct(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def plain(self, letters: str) -> bytes:
        """Ids of ' ' and letters, remembered."""
        found = self.known.get(letters)
        if found is None:
            found = self.older.get(letters)
            if found is None:
                spelt = letters if letters.isascii() else letters.translate(self.spelt)  # visible ASCII spells itself
                found = _bytes(list(map(_ID, self.of_word(self.space + spelt))))
            if len(letters) <= LONGEST_KEPT:
                self.known[letters] = found
        return found

    def unit(self, text: str) -> bytes:
        """Ids of what the pattern keeps together."""
        if text[0] == " ":
            return self.plain(text[1:])
        found = self.units.get(text)
        if found is None:
            found = _bytes(list(map(_ID, self.of_word(text if text.isascii() else text.translate(self.spelt)))))
            if len(text) <= 16:
                if len(self.units) >= UNITS_KEPT:
                    self.units = {"\n": self.units["\n"]}
                self.units[text] = found
        return found

    def fresh(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.plain(word)
        mark = self.marks.get(word[-1:])
        if mark and (bare := word[:-1]).isascii() and bare.isalpha():  # a word and a mark
            return self.plain(bare) + mark
        if _PLAIN.fullmatch(word) and not self.special(word):
            return b"".join(map(self.unit, _UNITS.findall(" " + word)))
        found = self.direct(" " + word)
        if len(word) <= LONGEST_KEPT:
            self.known[word] = found
        return found

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of ' ' + word for distinct words."""
        if len(self.known) >= WORDS_KEPT:  # words in use come back from the older memory
            self.known, self.older = {}, self.known
        fresh = self.fresh
        return [ids or fresh(w) for w, ids in zip(words, map(self.known.get, words), strict=True)]

    def encode(self, texts, end: int | None = None):
        """(ids, sizes) of an Arrow array of texts without nulls: all ids one after the other, and how many each text has.
        `end` is appended to each."""
        import numpy as np

        codes, counts, words = numbered(texts, _UNEVEN, _CUT.split)
        ids = self.of_words(words)
        # the first word of each text has no space before it
        first = np.cumsum(counts) - counts
        heads = [words[c] for c in codes[first].tolist()]
        own: dict[str, int] = {}
        codes = codes.astype(np.int64)
        codes[first] = [own.setdefault(h, len(ids) + len(own)) for h in heads]
        ids += [self.direct(h) for h in own]
        if end is not None:
            codes = np.insert(codes, first + counts, len(ids))
            counts = counts + 1
            ids.append(_bytes([end]))
        flat, sizes = expanded(codes, ids)
        return flat, totals(sizes, counts)

    def check(self, text: str, ids) -> None:
        """Raise ValueError if the library has other ids for the whole text."""
        if self.tokenizer.encode(text, add_special_tokens=False).ids != ids.tolist():
            raise ValueError(f"the tokenizers library has other ids for {text[:200]!r}")
