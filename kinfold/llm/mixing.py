"""Mixing sources to target weights.

Each source's words, in a fixed pseudorandom order of its documents, are cut into blocks of ``block`` words (the last block
takes the rest).  The mix is a sequence of slots of one block each, dealt over output shards.  How many slots of a shard
each source gets is a multinomial draw given the sources' totals: from the whole mix down, the slots of a range of shards
are split between its halves by multivariate hypergeometric draws, so each shard finds its counts, and the ordinals of
its slots within each source, on its own in log2(shards) draws.  Ordinal j of a source with n blocks is block
perm(j div n)(j mod n), a keyed Feistel permutation for each pass, so no block is taken twice within a pass.  Slots and
documents meet in a join on (source, block).  All draws depend on the seed alone: reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import WORD, Scratch, constants, fresh, mix64

#: Sources above this number are refused: their plan is made on the driver.
MAX_SOURCES = 200_000


def targets(sizes: dict, weights: tuple = (5, 2, 1), cap: float = 3.0) -> dict:
    """Source -> target words.  Sources by code point, null last, have the weights in turn and share all words; none has more
    than cap times its own words, and the excess is shared by weight among those below their cap until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, names, float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left, free = left - sum(out[s] for s in over), [s for s in free if s not in out]
    return out


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1 at the given indexes: Feistel network on the next even number of bits, walked until inside."""
    if n <= 1:
        return index.copy()
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), constants(6, key)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def hypergeometric(rng, good: int, bad: int, take: int) -> int:
    """How many of ``take`` items drawn from good + bad are good, exactly, for any numbers (numpy's sampler ends at 1e9).

    Above that every item is drawn on its own with probability take / all, by two binomial draws, and as many items as there are
    too few are drawn from the rest, or too many from those drawn: their number is about the root of take, so few rounds do.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, take)) if good and take else 0
    if take <= 16:
        got = 0
        for k in range(take):
            got += int(rng.integers(good + bad - k)) < good - got
        return got
    if 2 * take > good + bad:
        return good - hypergeometric(rng, good, bad, good + bad - take)
    p = take / (good + bad)
    x, y = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
    if x + y <= take:
        return x + hypergeometric(rng, good - x, bad - y, take - x - y)
    return x - hypergeometric(rng, x, y, x + y - take)


def _split(rng, counts: np.ndarray, take: int) -> np.ndarray:
    """How many of each source fall among `take` of all slots."""
    out, left, rest = np.zeros_like(counts), take, int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        k = hypergeometric(rng, c, rest - c, left)
        out[i], left, rest = k, left - k, rest - c
    return out


def shard_counts(counts: np.ndarray, shards: int, width: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one shard, and in all shards before it."""
    lo, hi, now, before = 0, shards, counts.astype(np.int64), np.zeros(len(counts), np.int64)
    total = int(now.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = _split(rng, now, min(total, mid * width) - lo * width)
        if shard < mid:
            now, hi = left, mid
        else:
            before, now, lo = before + left, now - left, mid
    return now, before


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), cap: int = 3, block: int = 64, slots_per_shard: int = 1 << 15, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (doc_id, source, thash, size, source_size, target, taken) and pieces (doc_id, source, thash, pass, start,
    length): the words of a document that the mix takes, pass by pass.

    A null text has no words; a null source is a source of its own, the last.  Rows with one id are separate documents
    (rows equal in id, source and text share their pieces); null ids are kept.  Ties in a source's pseudorandom order go by
    id and text.  A text of any length is cut over as many blocks as it fills.  An empty table gives empty tables.  Further
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("thash"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d = scratch.save(d, "sizes")
    found = d.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    sizes = {r.source: r.words for r in found}
    goal = targets(sizes, weights, cap)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    docs_of = {r.source: r.docs for r in found}
    rows = []
    for i, s in enumerate(names):
        n = max(1, sizes[s] // block)
        mean = sizes[s] / n
        slots = min(cap * n, math.ceil(goal[s] / mean - 1e-9)) if mean else 0
        last = round(goal[s] - (slots - 1) * mean) if slots else 0
        rows.append((i, s, sizes[s], float(goal[s]), n, slots, last, max(1, docs_of[s] // 4096)))
    plan_schema = "s int, source string, source_size long, target double, blocks long, slots long, last long, buckets long"
    plan = F.broadcast(spark.createDataFrame(rows, plan_schema))  # at most MAX_SOURCES rows

    count, n_blocks, last_len = (np.array([r[k] for r in rows], np.int64) for k in (5, 4, 6))
    total = int(count.sum())
    shards = -(-total // slots_per_shard)

    def deal(frames):
        for frame in frames:
            for shard in frame["id"]:
                now, before = shard_counts(count, shards, slots_per_shard, int(shard), seed)
                for s in np.flatnonzero(now):
                    at = before[s] + np.arange(now[s])
                    passes = at // n_blocks[s]
                    where = np.empty(len(at), np.int64)
                    for e in np.unique(passes):
                        m = passes == e
                        where[m] = permute(at[m] % n_blocks[s], int(n_blocks[s]), seed * 7919 + int(s) * 31 + int(e))
                    limit = np.where(at == count[s] - 1, last_len[s], np.iinfo(np.int64).max)
                    yield pd.DataFrame({"s": np.int32(s), "block": where, "pass": passes.astype(np.int32), "limit": limit})

    slots = spark.range(0, shards, 1, max(1, min(shards, 4096))).mapInPandas(deal, "s int, block long, pass int, limit long")

    d = d.join(plan, d.source.eqNullSafe(plan.source)).drop(plan.source)
    d = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "thash", F.lit(seed)), F.col("buckets")))
    starts = d.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    starts = starts.withColumn("base", F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("s", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    within = Window.partitionBy("s", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "thash").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("off", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["s", "bucket"])
    d = scratch.save(d.select("doc_id", "thash", "source", "size", "source_size", "target", "s", "blocks", (F.col("off") + F.col("base")).alias("off")), "offsets")

    final = lambda x: F.least(F.expr(f"({x}) div {block}"), F.col("blocks") - 1)
    parts = d.where("size > 0").select("doc_id", "thash", "s", "size", "off", "blocks", F.explode(F.sequence(final("off"), final("off + size - 1"))).alias("block"))
    # The size of what a function makes is unknown to the planner, which would take it for small and broadcast it.
    parts = parts.join(slots.hint("merge"), ["s", "block"])
    lo = F.greatest(F.col("block") * block, F.col("off"))
    end = F.when(F.col("block") == F.col("blocks") - 1, F.col("off") + F.col("size")).otherwise(F.least((F.col("block") + 1) * block, F.col("off") + F.col("size")))
    end = F.least(end, F.when(F.col("limit") < (1 << 40), F.col("block") * block + F.col("limit")).otherwise(end))
    pieces = parts.select("doc_id", "s", "thash", "off", "pass", (lo - F.col("off")).alias("start"), (end - lo).alias("length")).where("length > 0")
    pieces = scratch.save(pieces, "pieces")
    # A document is a source's place: words of other sources begin at the same offsets.
    taken = pieces.groupBy("doc_id", "s", "off").agg(F.sum("length").alias("taken"))
    pieces = pieces.join(plan.select("s", "source"), "s").drop("s", "off")
    out = d.join(taken, d.doc_id.eqNullSafe(taken.doc_id) & (d.s == taken.s) & (d.off == taken.off) & (d["size"] > 0), "left").select(d.doc_id, "source", "thash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return out, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: for each pass that takes words of a document one row, whose text holds
    those words with the white space between them (the whole text where all words are taken); parts that did not stand
    side by side are joined by a line break.  n_chars, where present, is the new text's length.  Nulls, ties, repeated rows,
    very long texts and empty tables are as in ``mix``; a document of which no word is taken gives no row."""
    import re

    spark = docs.sparkSession
    scratch = Scratch(spark, "mixed")
    _, pieces = mix(docs, **options)
    key, th, src, parts = fresh(docs, "__id", "__th", "__source", "__runs")
    runs = pieces.groupBy("doc_id", "source", "thash").agg(F.collect_set(F.struct(F.col("pass").alias("p"), "start", "length")).alias(parts))
    runs = runs.select(F.col("doc_id").alias(key), F.col("source").alias(src), F.col("thash").alias(th), parts)
    j = docs.join(runs, F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").cast("string").eqNullSafe(F.col(src)) & (F.xxhash64("text") == F.col(th))).drop(key, src, th)
    word = re.compile("[^\x20\x09-\x0d]+")
    fields = docs.schema

    def cut(batches):
        # Arrow rows, not pandas: a null among ids must not make floats of the others.
        for batch in batches:
            out, kind = [], pa.schema([f for f in batch.schema if f.name != parts])
            for row in batch.to_pylist():
                text, passes = row["text"], {}
                at = [m.span() for m in word.finditer(text)]
                for r in row.pop(parts):
                    passes.setdefault(r["p"], []).append((r["start"], r["start"] + r["length"]))
                for p in sorted(passes):
                    merged = []
                    for a, b in sorted(passes[p]):
                        if merged and merged[-1][1] == a:
                            merged[-1][1] = b
                        else:
                            merged.append([a, b])
                    new = text if merged == [[0, len(at)]] else "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in merged)
                    out.append(row | {"text": new} | ({"n_chars": len(new)} if "n_chars" in row else {}))
            yield pa.RecordBatch.from_pylist(out, kind)

    return j.mapInArrow(cut, fields)
