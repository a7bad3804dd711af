"""Token ids in files of bit planes.

Documents stand in ascending doc_id order; each range of them is one shard, whose ids form one stream. The stream is cut
into blocks of a fixed number of ids (the last of a shard is shorter). A block of n ids is transposed into planes: bit
planes (plane k holds bit k of every id, eight ids a byte, the first in the lowest bit) or byte planes (plane k holds
byte k of every id). As many planes are stored as the largest id of the block needs, each compressed with zstandard.

On disk a folder holds two tables in uncompressed Parquet, a container that Spark's writers commit task by task, so that
a lost executor leaves no half-written shard:

    blocks: shard, block, n_ids, kind ('bit' or 'byte'), planes (array of binary), and for the documents that have ids
            in the block doc_id, begin (place in the shard's stream) and length (in ids, end id included)
    index:  the chunk index: shard, block, start (ids in all blocks before), n_ids, n_bytes, n_docs

Defined cases: a null text counts as empty and has the end id only; a null doc_id comes first; rows that repeat a doc_id
are documents of their own, in the order of a hash of their texts. A text of any length is encoded whole; its ids may
fill many blocks. An empty table gives an empty folder of the same schema. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytebpe import Encoder
from .common import BATCH_BYTES, mapped, scratch, table, text_of
from .words import slices

#: Ids in a block; what is appended to each document.
BLOCK = 65_536
END = 2

PARTS = "shard int, block int, doc_id bigint, begin bigint, length bigint, ids binary"
BLOCKS = "shard int, block int, n_ids int, kind string, planes array<binary>, doc_ids array<bigint>, begins array<bigint>, lengths array<bigint>"


def to_planes(ids, kind: str = "bit") -> list[bytes]:
    """Planes of an array of ids, lowest first, each compressed."""
    import numpy as np
    import zstandard

    ids = np.ascontiguousarray(ids, "<u4")
    bits = max(1, int(ids.max(initial=0)).bit_length())
    pack = zstandard.ZstdCompressor(level=1).compress
    wide = ids.view("u1").reshape(-1, 4)[:, : (bits + 7) // 8]
    if kind == "byte":
        planes = np.ascontiguousarray(wide.T)
    else:
        planes = np.packbits(np.ascontiguousarray(np.unpackbits(wide, axis=1, bitorder="little").T[:bits]), axis=1, bitorder="little")
    return [pack(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str = "bit"):
    """The ids again."""
    import numpy as np
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    rows = [np.frombuffer(unpack(p), "u1") for p in planes]
    wide = np.zeros((n, 4), "u1")
    if kind == "byte":
        for k, row in enumerate(rows):
            wide[:, k] = row
    else:
        bits = np.zeros((-(-len(rows) // 8) * 8, n), "u1")
        for k, row in enumerate(rows):
            bits[k] = np.unpackbits(row, count=n, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        wide[:, : packed.shape[1]] = packed
    return wide.reshape(-1).view("<u4")


def write_documents(docs: DataFrame, path: str, vocabulary: str, end: int = END, block: int = BLOCK, kind: str = "byte") -> None:
    """Encode every whole text, append `end`, and write the ids in ascending doc_id order."""

    def shard(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        many = pa.list_(pa.int64())
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("doc_ids", many), ("begins", many), ("lengths", many)])
        encoder, number = Encoder.of(vocabulary), TaskContext.get().partitionId()
        held, n_held, made, open_docs, at = [], 0, 0, [], 0  # at: ids of the shard so far

        def out(ids) -> pa.RecordBatch:
            nonlocal made, open_docs
            stop = made * block + len(ids)
            row = {"shard": number, "block": made, "n_ids": len(ids), "kind": kind, "planes": to_planes(ids, kind)}
            row |= dict(zip(("doc_ids", "begins", "lengths"), map(list, zip(*[d for d in open_docs if d[1] < stop], strict=True)), strict=True))
            open_docs = [d for d in open_docs if d[1] + d[2] > stop]
            made += 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for some in slices(batch, 1):
                ids, sizes = encoder.encode(some.column(1), end)
                encoder.check(some.column(1)[0].as_py(), ids[: sizes[0] - 1])
                begins = at + np.cumsum(sizes) - sizes
                open_docs += zip(some.column(0).to_pylist(), begins.tolist(), sizes.tolist(), strict=True)
                at += len(ids)
                held.append(ids)
                n_held += len(ids)
                if n_held >= block:
                    every = np.concatenate(held)
                    for k in range(0, n_held - block + 1, block):
                        yield out(every[k : k + block])
                    n_held %= block
                    held = [every[len(every) - n_held :].copy()]
        if n_held:
            yield out(np.concatenate(held))

    whole = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), F.xxhash64(text_of(docs)).alias("turn"))
    # rows of one doc_id, or of none, are spread by the hash
    order = ("doc_id", "turn", "text")
    sorted_ = whole.repartitionByRange("doc_id", "turn").sortWithinPartitions(*order)
    mapped(sorted_.select("doc_id", "text"), shard, BLOCKS, 3 * BATCH_BYTES // 2).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.parquet(f"{path}/blocks")
    sizes = blocks.select("shard", "block", "n_ids", F.aggregate("planes", F.lit(0), lambda n, p: n + F.octet_length(p)).alias("n_bytes"), F.size("doc_ids").alias("n_docs"))
    # one row for each shard, of which there are as many as tasks
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    start = F.col("base") + F.col("block").cast("long") * block
    sizes.join(F.broadcast(shards), "shard").select("shard", "block", start.alias("start"), "n_ids", "n_bytes", "n_docs").write.option("compression", "none").parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), ids (little-endian unsigned 32-bit integers)."""

    def unpack(whole: bool):
        """Documents that lie in one block, or else the parts of others."""

        def rows(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
                for k in range(batch.num_rows):
                    n_ids, first = at["n_ids"][k].as_py(), at["first"][k].as_py()
                    ids = from_planes(at["planes"][k].as_py(), n_ids, at["kind"][k].as_py())
                    docs, begins, lengths = (at[n][k].values for n in ("doc_ids", "begins", "lengths"))
                    begin, length = begins.to_numpy(), lengths.to_numpy()
                    lo, hi = np.maximum(begin - first, 0), np.minimum(begin + length - first, n_ids)
                    rows = np.flatnonzero((hi - lo == length) == whole)
                    if len(rows):
                        size = len(rows)
                        picked = pa.array([ids[a:b].tobytes() for a, b in zip(lo[rows].tolist(), hi[rows].tolist(), strict=True)], pa.binary())
                        columns = [pa.array([at[n][k].as_py()] * size, pa.int32()) for n in ("shard", "block")]
                        columns += [x.take(pa.array(rows)) for x in (docs, begins, lengths)] + [picked]
                        yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "doc_id", "begin", "length", "ids"])

        return rows

    blocks, index = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/index")
    bases = F.broadcast(index.filter("block = 0").select("shard", F.col("start").alias("base")))
    # blocks of a shard follow each other, each as long as the first but the last
    full = F.broadcast(index.groupBy("shard").agg(F.max("n_ids").alias("full")))
    placed = blocks.join(full, "shard").withColumn("first", F.col("block").cast("long") * F.col("full"))
    placed = placed.select("shard", "block", "n_ids", "kind", "planes", "doc_ids", "begins", "lengths", "first")
    once = mapped(placed, unpack(True), PARTS).select("shard", "doc_id", "begin", "ids")
    # a document in several blocks: its own parts, in order, joined at once
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda x: F.hex(x["ids"])), ""))
    again = mapped(placed, unpack(False), PARTS).groupBy("shard", "doc_id", "begin").agg(joined.alias("ids"))
    return once.unionByName(again.select("shard", "doc_id", "begin", "ids")).join(bases, "shard").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "ids")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-planes")
    write_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = read_documents(spark, path)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
