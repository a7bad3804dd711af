"""The words of many texts at once, as numbers: what several encoders of this package build on."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

#: Bytes of text taken at a time; a longer text is taken alone.
BYTES_AT_ONCE = 8 << 20


def slices(batch, column: int, most: int = BYTES_AT_ONCE) -> Iterator:
    """A record batch in slices whose texts in `column` have `most` bytes together, or one row that has more."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def numbered(texts, uneven: str, parts: Callable[[str], list[str]]):
    """(codes, counts, words): the words of texts one after the other as places in `words`, and how many each text has.

    Words are what stands between single spaces, except in texts that match `uneven` (a pattern of RE2), whose words
    `parts` tells. The work on every word is Arrow's; Python sees each distinct word once.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(texts)
    odd = pc.match_substring_regex(texts, uneven)
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    plain = pc.if_else(odd, pa.scalar(None, texts.type), texts) if len(rows) else texts
    split = pc.split_pattern(plain, " ")
    counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    if len(rows):
        theirs = [parts(t) for t in texts.filter(odd).to_pylist()]
        more = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = pa.concat_arrays([flat, pa.array([w for t in theirs for w in t], flat.type)])
    found = flat.dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False)
    if len(rows):
        order = np.arange(n)
        order[rows] = n + np.arange(len(rows))
        codes = gathered(codes, np.concatenate([counts, more]), order)
        counts[rows] = more
    return codes, counts, found.dictionary.to_numpy(zero_copy_only=False).tolist()


def gathered(values, sizes, order):
    """Runs of `values`, of the given sizes, in another order or repeated, one after the other."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(sizes)])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(values))
    return lists.take(pa.array(order)).flatten().to_numpy(zero_copy_only=False)


def expanded(codes, ids: Sequence[bytes]):
    """(flat, sizes): the ids of all words one after the other, given each distinct word's as little-endian unsigned
    32-bit integers; and how many each of `codes` has."""
    import numpy as np

    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return gathered(np.frombuffer(b"".join(ids), "<u4"), sizes, codes), sizes[codes]


def totals(sizes, counts):
    """The sum of `sizes` over each run of `counts` of them."""
    import numpy as np

    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return ends[at[1:]] - ends[at[:-1]]
