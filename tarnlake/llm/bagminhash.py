"""Near-duplicates by weighted Jaccard similarity of word shingles.

A text is the multiset of its runs of SHINGLE words (words: runs between white space, in lower case; a shorter text is
one shingle). Two texts are near when the weighted Jaccard similarity of their multisets, the sum of the smaller over
the sum of the larger counts, is NEAR or more; classes are the connected components of nearness.

1. BagMinHash. The axis of counts is cut at 0, 1, 2, 4, 8 and so on. Each shingle has a Poisson process on each of these
   intervals, with a rate of the interval's width; each of its points has a time, a register and a level within the
   interval, found by halving. A shingle of count w uses the points of levels below w. A register keeps the first point of
   all shingles, so that two texts agree in a register with a probability of exactly their similarity. Points are made
   in the order of time until no register can change.
2. Copies. Texts of equal multisets are one node (skew.py settles groups of a third of all rows).
3. Bands. Nodes that agree in all registers of a band meet; within such a bucket, one byte of each register estimates the
   similarity. Pairs that might be near make candidate clusters. No pair leaves the task that compares it: a task
   returns a spanning star of what it finds.
4. Verification. Within a candidate cluster all pairs are compared exactly, as products of matrices of shingle
   occurrences.

Groups of more than TILE nodes, of buckets and of clusters alike, are first compared with their first node, row by row: the
group is dealt into parts of PART nodes, and each part gets a copy of the first. Only the nodes that are not near to it are
then compared with all others, in tiles of two blocks of TILE nodes at most; so a large group of near copies costs one
comparison a row, no task holds an unbounded group, and no pair is left out. What is compared is never broadcast; the
smallest nodes and sizes of frequent groups and components are (skew.py).

With 28 bands of 4 registers, a pair of similarity 0.8 meets nowhere with a probability of 4e-7, of 0.9 with 3e-13. The
estimate lets a pair of similarity 0.8 go with a probability of about 4e-6 for each bucket that it shares (about 11), and
a pair has to be let go in all of them.

Defined cases: a null or empty text, or one of white space only, has no shingles; all such texts are one class. A class
is named by its smallest doc_id, nulls last. Repeated rows are in one class, each with a row. Rows are told apart by doc_id
and two hashes of the text, so those without a doc_id are rows like others; texts are read whole, one at a time. An empty
table gives an empty table. Extra columns, whatever their names, are ignored by `classes` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, hold, mapped, rows_told, small, table, text_of, unused
from .skew import lookup, with_first
from .words import slices

SHINGLE = 5
NEAR = 0.8
BANDS = 28
ROWS = 4
REGISTERS = BANDS * ROWS
#: Nodes in a block of a tile; of a large group, nodes compared with its first in one task.
TILE = 256
PART = 512
#: Buckets that are broadcast with their sizes, at most.
HOT = 2000
#: An estimate may fall so many standard deviations short.
SLACK = 4.5
#: Rows and bytes of text taken at a time; words of a worker's memory.
ROWS_AT_ONCE = 500
BYTES_AT_ONCE = 1 << 20
WORDS_KEPT = 100_000
LONGEST_KEPT = 48

_SEEN: dict[str, int] = {}
_ODD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def mixed(x):
    """A permutation of 64-bit integers (the finaliser of SplitMix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    found = _SEEN.get(word)
    if found is None:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= LONGEST_KEPT:
            if len(_SEEN) >= WORDS_KEPT:
                _SEEN.clear()
            _SEEN[word] = found
    return found


def shingles(text: str, size: int = SHINGLE):
    """Hashes of the shingles, sorted, one for each occurrence."""
    return shingles_of([text], size)[0]


def shingles_of(texts: list[str], size: int = SHINGLE) -> list:
    """`shingles` of each text."""
    import numpy as np

    cut_ = [t.lower().split() for t in texts]
    n = np.array(list(map(len, cut_)), np.int64)
    hashes = np.array([word_hash(w) for words in cut_ for w in words], np.uint64)
    ends = np.cumsum(n)
    out: list = [np.zeros(0, np.uint64)] * len(texts)
    # texts of `size` words or more at once: where each of their shingles begins
    long = np.flatnonzero(n >= size)
    many = n[long] - size + 1
    stops = np.cumsum(many)
    begin = np.repeat(ends[long] - n[long] - (stops - many), many) + np.arange(many.sum())
    made = folded(hashes, begin, size)
    for k, a, b in zip(long.tolist(), (stops - many).tolist(), stops.tolist(), strict=True):
        part = made[a:b]
        part.sort()
        out[k] = part
    for k in np.flatnonzero((n > 0) & (n < size)).tolist():
        out[k] = folded(hashes, ends[k : k + 1] - n[k], int(n[k]))
    return out


def folded(hashes, begin, size: int):
    """One hash for each run of `size` hashes, given where they begin."""
    import numpy as np

    out = np.full(len(begin), size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(_ODD) + hashes[begin + k])
    return out


def occurrences(found):
    """Sorted hashes as a set: the k-th occurrence of a shingle is an element of its own. Then the Jaccard similarity of
    two sets is the weighted similarity of the multisets."""
    import numpy as np

    if not len(found):
        return found
    first = np.r_[True, found[1:] != found[:-1]]
    at = np.arange(len(found))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.sort(mixed(found + nth.astype(np.uint64) * np.uint64(_ODD)))


def sketch(found, registers: int = REGISTERS):
    """The point that each register keeps, of a sorted non-empty multiset of hashes."""
    return sketches_of([found], registers)[0]


def sketches_of(sets: list, registers: int = REGISTERS):
    """`sketch` of each multiset, as rows; rows of empty ones are 0. All points of a round are made at once."""
    import numpy as np

    sizes = np.array(list(map(len, sets)), np.int64)
    every, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    first = np.flatnonzero(np.r_[True, (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])][: len(every)])
    hashes, owner, counts = every[first], owner[first], np.diff(np.r_[first, len(every)])
    seeds, owners, low, width, weight = [hashes], [owner], [np.zeros(len(hashes), np.int64)], [np.ones(len(hashes), np.int64)], [counts]
    at = 1
    while (more := counts > at).any():
        seeds.append(mixed(hashes[more] + np.uint64(at * _ODD & _ALL)))
        owners.append(owner[more])
        low.append(np.full(more.sum(), at))
        width.append(np.full(more.sum(), at))
        weight.append(counts[more])
        at *= 2
    seed, owner, low, width, weight = map(np.concatenate, (seeds, owners, low, width, weight))
    seed = mixed(seed)
    time = np.zeros(len(seed))
    best = np.full(len(sets) * registers, np.inf)
    out = np.zeros(len(sets) * registers, np.uint64)
    step = 0
    while len(seed):
        step += 1
        point = mixed(seed + np.uint64(step * _ODD & _ALL))
        uniform = ((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / width
        other = mixed(point ^ np.uint64(0x2545F4914F6CDD1D))
        register = owner * registers + ((other >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        # widths are powers of two: each bit halves what is left of the interval
        level = low + ((other & np.uint64(0xFFFFFFFF)).astype(np.int64) & (width - 1))
        used = np.flatnonzero((level < weight) & (time < best[register]))
        mine, when = register[used], time[used]
        np.minimum.at(best, mine, when)
        won = when == best[mine]
        out[mine[won]] = point[used[won]]
        alive = np.flatnonzero(time < best.reshape(len(sets), registers).max(1)[owner])
        seed, owner, low, width, weight, time = seed[alive], owner[alive], low[alive], width[alive], weight[alive], time[alive]
    return out.reshape(len(sets), registers)


def band_keys(registers, rows: int = ROWS):
    import numpy as np

    wide = registers.reshape(*registers.shape[:-1], -1, rows)
    keys = np.broadcast_to(np.arange(wide.shape[-2], dtype=np.uint64), wide.shape[:-1])
    for k in range(rows):
        keys = mixed(keys * np.uint64(_ODD) + wide[..., k])
    return keys.view(np.int64)


def sliced(batches: Iterator, rows: int = ROWS_AT_ONCE) -> Iterator:
    """Batches of fewer rows, and memory given back at the end of the task."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    _SEEN.clear()
    give_back()


def hashes(text: Column) -> list[Column]:
    """Two hashes that together tell texts apart."""
    return [F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")]


def sketches(docs: DataFrame) -> DataFrame:
    """For every row: node (an id of the row), doc_id, t1 and t2 (hashes of the text as it stands), digest of the multiset,
    marks (a byte of each register), bands."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        hold("bagminhash", _SEEN.clear)
        for whole_batch in batches:
            for batch in slices(whole_batch, 1, BYTES_AT_ONCE):
                found = shingles_of(batch.column(1).to_pylist())
                some = np.array([len(f) > 0 for f in found], bool)
                kept = sketches_of(found)
                digests = pa.array([xxhash.xxh3_128_hexdigest(f.tobytes()) for f in found], pa.string())
                top = np.ascontiguousarray((kept >> np.uint64(56)).astype(np.uint8))
                marks = pa.array([row.tobytes() if own else b"" for row, own in zip(top, some, strict=True)], pa.binary())
                ends = np.concatenate([[0], np.cumsum(some * BANDS)])
                bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_keys(kept[some]).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], digests, marks, bands], ["doc_id", "t1", "t2", "digest", "marks", "bands"])
        _SEEN.clear()
        give_back()

    whole = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    made = mapped(whole.select("*", *hashes(F.col("text"))), rows, "doc_id bigint, t1 bigint, t2 bigint, digest string, marks binary, bands array<bigint>")
    return cut(made.select(F.monotonically_increasing_id().alias("node"), "*"))


# what makes two payloads near: marks by an estimate, sets of occurrences exactly ------------------------------------


def least_agreeing(registers: int = REGISTERS, near: float = NEAR, slack: float = SLACK) -> int:
    """Registers that two sketches of near texts share, at the least."""
    return max(1, int(registers * (near - slack * (near * (1 - near) / registers) ** 0.5)))


def marks_near(a: list[bytes], b: list[bytes]):
    """Matrix of whether marks of a and of b may belong to near texts."""
    import numpy as np

    wide = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
    x, y = wide(a), wide(b)
    out = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, len(x), 64):
        out[at : at + 64] = (x[at : at + 64, None, :] == y[None, :, :]).sum(2)
    return out >= least_agreeing(x.shape[1])


def sets_near(a: list[bytes], b: list[bytes]):
    """Matrix of whether sets of a and of b have a Jaccard similarity of NEAR or more."""
    import numpy as np

    sets = [np.frombuffer(x, "<u8") for x in (*a, *b)]
    sizes = np.array([len(x) for x in sets])
    found, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.where(shared[column], np.cumsum(shared)[column] - 1, -1)
    row = np.repeat(np.arange(len(sets)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    both = np.zeros((len(a), len(b)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(shared.sum()), 16_384):  # bounded memory
        lo, hi = np.searchsorted(column, [first, first + 16_384])
        names, inside = np.unique(column[lo:hi], return_inverse=True)
        part = np.zeros((len(sets), len(names)), np.float32)
        part[row[lo:hi], inside] = 1
        both += part[: len(a)] @ part[len(a) :].T
    together = sizes[: len(a), None] + sizes[None, len(a) :] - both
    return both >= NEAR * together - 1e-9


def star_edges(ids: list[int], near) -> list[tuple[int, int]]:
    """Edges from the first node of each component of a symmetric matrix to its others."""
    import numpy as np

    left, out = np.ones(len(ids), bool), []
    for u in range(len(ids)):
        if left[u]:
            left[u] = False
            front = near[u] & left
            while front.any():
                at = np.flatnonzero(front)
                left[at] = False
                out += [(ids[u], ids[v]) for v in at]
                front = near[at].any(0) & left
    return out


def to_first(near):
    """The function of a task that tells which rows of a part are near to its first, which stands before them."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        whose, its = None, None
        for batch in sliced(batches):
            found = []
            for key, part, node, payload, first in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if whose != (key, part):
                    whose, its = (key, part), payload
                    found.append(first == node and part == 0)  # its copies in other parts are no rows
                else:
                    found.append(bool(near([its], [payload])[0, 0]))
            # a copy of the first is dropped, the first itself is near
            own = [first != node or part == 0 for part, node, first in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4)), strict=True)]
            columns = [batch.column(k) for k in (0, 2, 3, 4)] + [pa.array(found, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "payload", "first", "near"]).filter(pa.array(own, pa.bool_()))

    return rows


def links(groups: DataFrame, near, any_large: bool, tile: int = TILE, part: int = PART) -> DataFrame:
    """Edges (a, b) with the components that nearness has within each group, from rows (key, n, first, node, payload): n is
    the number of rows of that key, first the smallest node of them. near: a function of two lists of payloads that gives a
    matrix. any_large: whether any n is above `tile`."""
    small_ = groups.filter(F.col("n") <= tile).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "node", "payload")
    large = groups.filter(F.col("n") > tile)
    tiles, stars = small_, None
    if any_large:
        parts = F.ceil(F.col("n") / part)
        mine = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts)))
        dealt = large.select("key", F.explode(mine).alias("part"), "node", "payload", "first")
        # the first of a group has its smallest node
        dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node")
        starred = cut(mapped(dealt, to_first(near), "key bigint, node bigint, payload binary, first bigint, near boolean"))
        stars = starred.filter("near and node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        blocks = lambda c: F.ceil(F.sum(F.when(c, 1).otherwise(0)) / tile).cast("int")
        counted = cut(starred.groupBy("key").agg(blocks(F.col("near")).alias("n_near"), blocks(~F.col("near")).alias("n_far")).filter("n_far > 0"))
        dealt = starred.join(small(counted, 16), "key")
        # blocks of nodes that are not near to the first come first; a tile is a pair of blocks, the first of such nodes
        block = F.when(F.col("near"), F.col("n_far") + F.pmod(F.xxhash64("node"), F.col("n_near")).cast("int")).otherwise(F.pmod(F.xxhash64("node"), F.col("n_far")).cast("int"))
        dealt = dealt.withColumn("block", block)
        all_blocks = F.sequence(F.lit(0), F.col("n_far") + F.col("n_near") - 1)
        pairs = F.when(F.col("near"), F.transform(F.sequence(F.lit(0), F.col("n_far") - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))).otherwise(
            F.transform(all_blocks, lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
        )
        dealt = dealt.withColumn("t", F.explode(pairs))
        tiles = small_.unionByName(dealt.select("key", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "block", "node", "payload"))

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def edges(rows: list[tuple]) -> list[tuple[int, int]]:
            _, i, j, *_ = rows[0]
            ids, payloads = [r[4] for r in rows], [r[5] for r in rows]
            if len(rows) < 2:
                return []
            if i == j:
                return star_edges(ids, near(payloads, payloads))
            mine = [k for k, r in enumerate(rows) if r[3] == i]
            its = [k for k, r in enumerate(rows) if r[3] != i]
            if not mine or not its:
                return []
            whole = np.zeros((len(rows), len(rows)), bool)
            whole[np.ix_(mine, its)] = near([payloads[k] for k in mine], [payloads[k] for k in its])
            return star_edges(ids, whole | whole.T)

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        held: list[tuple] = []
        for batch in sliced(batches):
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    found += edges(held)
                    held = []
                held.append(row)
            if found:
                yield out(found)
        if held:
            yield out(edges(held))

    made = mapped(tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node"), compare, "a bigint, b bigint")
    return (made if stars is None else made.unionByName(stars)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its connected component.

    Large and small stars in turn (Kiveris and others, 2014), each round cut in the shared folder, until nothing moves.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    before = state(edges)
    while before["n"]:
        # a node may have a third of all edges: minima are taken in each task first, and those of frequent nodes broadcast,
        # or all if they are few
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        edges = cut(lookup(both, "a", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = cut(edges.groupBy("a").agg(F.min("b").alias("m")))
        small_ = lookup(edges, "a", least).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        edges = cut(small_.filter("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def candidates(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Edges (a, b) of candidate clusters, from rows (node, marks, bands)."""
    met = nodes.select("node", F.explode("bands").alias("key"))
    buckets = cut(met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1"))
    # the few frequent buckets are told on the map side; others have few rows each
    hot = F.broadcast(cut(buckets.orderBy(F.col("n").desc(), "key").limit(HOT).filter(F.col("n") > tile)))
    near = met.join(hot, "key")
    far = met.join(hot, "key", "left_anti").join(buckets, "key")
    rows = near.unionByName(far).join(nodes.select("node", F.col("marks").alias("payload")), "node")
    return links(rows.select("key", "n", "first", "node", "payload"), marks_near, not buckets.filter(F.col("n") > tile).isEmpty(), tile)


def with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, n, first, node, digest, t1, t2; materialised) with the set of shingle occurrences of the text as payload."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in sliced(batches):
            *own, digest, text = batch.columns
            found = shingles_of(text.to_pylist())
            if [xxhash.xxh3_128_hexdigest(f.tobytes()) for f in found] != digest.to_pylist():
                raise ValueError("two texts have the same pair of hashes")
            sets = pa.array([occurrences(f).astype("<u8").tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*own, sets], ["key", "n", "first", "node", "payload"])

    texts = docs.select(text_of(docs).alias("text")).select("text", *hashes(F.col("text")))
    # texts of clusters only, and one of those that are equal
    texts = texts.join(small(wanted.select("t1", "t2"), 24), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.min("text").alias("text"))
    made = texts.join(wanted, ["t1", "t2"]).select("key", "n", "first", "node", "digest", "text")
    return mapped(made, rows, "key bigint, n bigint, first bigint, node bigint, payload binary")


def told(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """What `classes` tells, with t1 and t2, the hashes of the text."""
    known = sketches(docs)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "t1", "t2")
    copies = cut(with_first(known.select("digest", place.alias("place")), "digest", "place").select("place", "first", "digest"))
    firsts = copies.filter(F.col("place") == F.col("first")).select(F.col("place.node").alias("node"))
    nodes = known.join(firsts, "node").filter(F.size("bands") > 0)
    coarse = components(candidates(nodes, tile))
    sizes = cut(coarse.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    grouped = lookup(coarse, "root", sizes).select("node", F.col("root").alias("key"), "n", F.col("root").alias("first"))
    wanted = cut(grouped.join(known.select("node", "digest", "t1", "t2"), "node"))
    exact = components(links(cut(with_sets(docs, wanted)), sets_near, not sizes.filter(F.col("n") > tile).isEmpty(), tile))
    # the class of each node, and its first place; then of each row
    rooted = lookup(copies.select("place", F.col("first.node").alias("node")), "node", cut(exact))
    rooted = cut(rooted.select("place", F.coalesce("root", "node").alias("root")))
    return with_first(rooted, "root", "place").select(
        F.col("place.doc_id").alias("doc_id"), F.col("first.doc_id").alias("class_id"), F.col("size").alias("class_size"), (F.col("place") == F.col("first")).alias("kept"), "place.t1", "place.t2"
    )


def classes(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """For every row: doc_id, class_id (the smallest doc_id of its class), class_size, kept (one row of each class)."""
    return told(docs, tile).drop("t1", "t2")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with all their columns, one of each class: one with the smallest doc_id."""
    names = [unused(docs, n) for n in ("_id", "_no_id", "_t1", "_t2")]
    parts = lambda f, t: dict(zip(names, (F.coalesce(f["doc_id"].cast("long"), F.lit(0)), f["doc_id"].isNull(), *t), strict=True))
    found = told(docs)
    rows = found.select(*(c.alias(n) for n, c in parts(found, [found["t1"], found["t2"]]).items()), "kept")
    return rows_told(docs, parts(docs, hashes(text_of(docs))), rows, 40)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
