"""Blocks of documents: packed rows of a few MB, stored once in buckets of their id.

Operators that must look up something for every position of every text (n-gram probabilities, repeated strings) work block
by block: a block sends each shard of the other side one sorted array of distinct keys, gets one array back, and meets its
own text again in a join on the block's id for which only the arrays move, as the blocks lie in buckets already.
"""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 8192


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Inside, an Arrow batch holds at most so many rows; for eager work only."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def encode(arrays: dict[str, np.ndarray]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.large_binary()) for x in arrays.values()] or [pa.array([0])], [f"{k}\t{x.dtype.str}" for k, x in arrays.items()] or ["-"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 1)


def decode(blob: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(zstandard.decompress(blob)).read_next_batch()
    out = {}
    for name, col in zip(batch.schema.names, batch.columns):
        if name != "-":
            key, kind = name.rsplit("\t", 1)
            out[key] = np.frombuffer(col[0].as_buffer(), np.dtype(kind))
    return out


def payload(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 1)


def unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_next_batch()


def write_blocks(scratch: Scratch, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """(blk long, payload binary) as a bucketed table, and its number of buckets.  No row of a block is larger than one
    text or BLOCK_BYTES; the ids are fixed by being written.  Tasks read a bucket block by block, so its size bounds no memory
    (the catalog takes 100,000 buckets at most)."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)

    def run(batches):
        ctx, seq, held, size = TaskContext.get(), 0, [], 0

        def out():
            nonlocal seq, held, size
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size, rows = [], 0, []
            for b in table:
                rows.append(((ctx.partitionId() << 32) | seq, payload(b)))
                seq += 1
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["blk", "payload"])

        for batch in batches:
            n = batch.column(at)
            lens = np.asarray(pa.compute.fill_null(pa.compute.binary_length(n.cast(pa.binary())), 0))
            start = 0
            for i, x in enumerate(lens.tolist()):
                if size and size + x > BLOCK_BYTES:
                    held.append(batch.slice(start, i - start))
                    held = [h for h in held if h.num_rows]
                    yield out()
                    start, size = i, 0
                size += x + 64
            held.append(batch.slice(start))
            held = [h for h in held if h.num_rows]
            if sum(h.num_rows for h in held) >= BLOCK_ROWS:
                yield out()
        if held:
            yield out()

    buckets = min(100_000, max(4, docs.rdd.getNumPartitions()))
    name = f"blocks_{uuid.uuid4().hex[:16]}"
    where = scratch.path("blocks")
    docs.mapInArrow(run, "blk long, payload binary").write.option("path", where).option("compression", "none").bucketBy(buckets, "blk").format("parquet").saveAsTable(name)
    table = spark.table(name)
    table._stored_as = (name, where)
    return table, buckets


def _folder(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shards_for(stored: DataFrame, shard_bytes: int = 16 << 20) -> int:
    """Shards of what all blocks send, so many that each stands for about shard_bytes of compressed text, whatever the session's
    number of shuffle partitions; never fewer than that number."""
    spark = stored.sparkSession
    fs, path = _folder(spark, stored._stored_as[1])
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fs.getContentSummary(path).getLength() // shard_bytes))


def release(stored: DataFrame) -> None:
    """Drop the table of blocks and its files, once nothing is going to read them."""
    spark, (name, where) = stored.sparkSession, stored._stored_as
    spark.sql(f"drop table if exists {name}")
    fs, path = _folder(spark, where)
    fs.delete(path, True)


def join_blocks(blocks: DataFrame, buckets: int, messages: DataFrame) -> DataFrame:
    """blk, payload, msgs: each block with all messages for it (null if none); only the messages are shuffled."""
    cols = [c for c in messages.columns if c != "blk"]
    m = messages.repartition(buckets, "blk").groupBy("blk").agg(F.collect_list(F.struct(*cols)).alias("msgs"))
    return blocks.join(m, "blk", "left").select("blk", "payload", "msgs")


def index(blocks: DataFrame, id_at: int) -> DataFrame:
    """blk, row, doc_id of every document stored."""

    def run(batches):
        for rows in batches:
            for blk, blob in zip(rows.column(0).to_pylist(), rows.column(1)):
                ids = unpack(blob.as_py()).column(id_at).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([blk] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), ids], ["blk", "row", "doc_id"])

    return blocks.mapInArrow(run, "blk long, row long, doc_id long")
