"""MinHash near-duplicate detection with tensored banding.

Instead of drawing fresh minhashes for each of L hash tables, two families of ``collections`` small groups of
``rows`` minhashes each are computed; table (i, j) is keyed by group i of the first family together with group j of
the second.  collections**2 tables of 2 * rows hashes thus cost 2 * collections * rows minhash evaluations in place of
2 * rows * collections**2.  A pair of similarity s is missed by all tables with probability at most
2 * (1 - s**rows)**collections: 7e-5 at 0.85 with the defaults, 3e-6 at 0.9.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, by_merge, components, constants, mix64, shingles


def signatures(docs: DataFrame, width: int, collections: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, group keys of both families."""
    n = 2 * collections * rows
    mult, add = constants(n, 11), constants(n, 12)
    fold = constants(rows, 13)

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                count, digest, keys = [], [], []
                for text in texts:
                    s = shingles(text.as_py(), width)
                    count.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    if not len(s):
                        keys.append(None)
                        continue
                    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(s), 4096):
                        np.minimum(low, (mult[:, None] * s[None, at : at + 4096] + add[:, None]).min(axis=1), out=low)
                    keys.append(mix64((mix64(low).reshape(2 * collections, rows) * fold).sum(axis=1, dtype=np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(count, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "keys"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, q) that are similar enough on their full sets, as (a, b)."""
    x, y = sets.select(F.col("id").alias("p"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("q"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(by_merge(y), "q").join(by_merge(x), "p").where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select(F.col("p").alias("a"), F.col("q").alias("b"))


def shingle_counts(sets: DataFrame, counters: int) -> np.ndarray:
    """How often shingles occur in the sets, by hash, in a fixed number of counters of two bytes: exact below 2**15, then 1024 levels to a doubling.

    A task adds up its own and sends one compressed array; these are added in up to 64 groups, then over the groups, and one
    array comes to the driver.  Levels keep the order of the counts but for ties.
    """

    def count(batches):
        total = np.zeros(counters, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() % counters, minlength=counters)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64]), pa.array([zstandard.compress(total.tobytes())])], ["g", "blob"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in frame["blob"])
        return pd.DataFrame({"g": [0], "blob": [zstandard.compress(total.tobytes())]})

    def level(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in frame["blob"])
        return pd.DataFrame({"g": [0], "blob": [zstandard.compress(np.where(total < 1 << 15, total, (1 << 15) + 1024 * (np.log2(np.maximum(total, 1)) - 15)).astype(np.uint16).tobytes())]})

    parts = sets.select("shingles").mapInArrow(count, "g long, blob binary")
    for f in (add, level):
        parts = parts.groupBy("g").applyInPandas(f, "g long, blob binary")
    got = parts.first()
    return np.frombuffer(zstandard.decompress(got.blob), np.uint16) if got else np.zeros(counters, np.uint16)


def remaining_pairs(scratch: Scratch, sets: DataFrame, percent: int, counters: int | None = None, step: float = 1.04) -> DataFrame:
    """Pairs (p, q) of sets (id, shingles, component) from different components that may be similar enough; none that is is left out.

    Two sets of sizes m and n are similar enough only if they share at least c = percent / (100 + percent) * (m + n) shingles, so
    in any fixed order of the shingles they share one among the first m - c + 1 of the one and the first n - c + 1 of the other.
    The order is rarest first (counts by hash; as many counters as there are shingles, between 2**18 and 2**23, so at most 16 MB
    are broadcast; more shingles share counters, which costs time and no pair), sizes are
    taken in classes of a factor ``step``, and rows meet on (shingle, both classes) where the rest of both sets, from the
    shingle on, is long enough for c.  Copies with many edits of their own thus
    meet only copies that share one of these edits.  In each such key only the members outside its largest component ask.
    """
    if counters is None:
        counters = 1 << min(23, max(18, int(sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(1))).first()[0]).bit_length()))
    shared = scratch.spark.sparkContext.broadcast(shingle_counts(sets, counters))
    log = float(np.log(step))

    def size_class(n):
        return int(np.floor(np.log(n) / log + 1e-9))

    def run(batches):
        count = shared.value
        for batch in batches:
            keys, side, place, size, owner, comps = [], [], [], [], [], []
            for i, x, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                x = np.asarray(x.values).astype(np.int64)
                n = len(x)
                own = size_class(n)
                x = x[np.lexsort((x, count[x % counters]))].view(np.uint64)
                for other in range(size_class(max(1, n * percent // 100)), size_class(n * 100 // percent + 1) + 1):
                    low = max(int(np.exp(other * log) * (1 - 1e-9)), -(-n * percent // 100))
                    need = -(-percent * (n + low) // (100 + percent))
                    first = n - need + 1
                    if first > 0:
                        tag = np.uint64(min(own, other) * 100003 + max(own, other))
                        keys.append(mix64(x[:first] ^ mix64(np.array([tag]))))
                        side.append(np.full(first, np.sign(own - other), np.int32))
                        place.append(np.arange(first, dtype=np.int32))
                        size.append(np.full(first, n, np.int32))
                        owner.append(np.full(first, i, np.int64))
                        comps.append(np.full(first, c, np.int64))
            if keys:
                cols = [np.concatenate(x) for x in (keys, side, place, size, owner, comps)]
                cols[0] = cols[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "side", "place", "n", "id", "component"])

    rows = sets.select("id", "shingles", "component").mapInArrow(run, "key long, side int, place int, n int, id long, component long")
    rows = scratch.save(rows, "prefixes")
    sizes = sets.groupBy("component").agg(F.count("*").alias("members"))
    keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("side").alias("low"), F.max("side").alias("high"))
    keys = keys.where("lo <> hi and (low <> high or low = 0)").select("key")
    rows = scratch.save(rows.join(by_merge(keys), "key").join(by_merge(sizes), "component"), "shared")
    top = rows.groupBy("key").agg(F.max(F.struct("members", "component")).alias("t")).select("key", F.col("t.component").alias("top"))
    # Rows of one class ask those of the other: sides are -1 and 1, or 0 where both classes are one.
    ask = rows.join(by_merge(top), "key").where("component <> top").select("key", (-F.col("side")).alias("side"), F.col("place").alias("px"), F.col("n").alias("nx"), F.col("id").alias("x"), F.col("component").alias("cx"))
    told = rows.select("key", "side", F.col("place").alias("py"), F.col("n").alias("ny"), F.col("id").alias("y"), F.col("component").alias("cy"))
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    pairs = ask.join(by_merge(told), ["key", "side"]).where("cx <> cy").where(rest * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent)
    return scratch.save(pairs.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).distinct(), "pairs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, collections: int = 8, rows: int = 2) -> DataFrame:
    """Classes of texts whose sets of word shingles have 100 * |intersection| >= percent * |union|, closed transitively.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest id that can be reached), kept
    (doc_id = component_id).  Rows with equal sets are one node from the start.  In each bucket of a table all members are
    checked against the smallest id, on the full sets.  Buckets that then lie in one component are done; the members of
    the others go through remaining_pairs, which gives every pair of different components that can be similar enough.
    So no bucket is gathered or paired with itself, and no candidate is dropped.  All joins are by merge: beside plans and counts
    the driver holds two bytes for each counter of rarity.

    A null or wordless text has an empty set and is linked with nothing.  Rows that share an id count as one document.
    A null id gives a null component and kept = true.  An empty table gives an empty result.  Further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = scratch.save(signatures(docs, width, collections, rows), "signatures")
    nodes = scratch.save(
        sigs.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "nodes"
    )
    # Below percent / (100 - percent) shingles, sets of different sizes can't reach the bound.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    usable = nodes.where(F.col("n") >= F.lit(least))
    first, second = F.slice("keys", 1, collections), F.slice("keys", collections + 1, collections)
    entries = usable.select("id", "n", F.posexplode(first).alias("i", "a"), second.alias("kb")).select("id", "n", "i", "a", F.posexplode("kb").alias("j", "b"))
    entries = entries.select(F.xxhash64("a", "b", F.col("i") * collections + F.col("j")).alias("key"), "id", "n")
    shared = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.max("id").alias("last")).where("p.id <> last").select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pn"))
    members = scratch.save(entries.join(by_merge(shared), "key"), "members")
    ids = members.select("id").distinct()
    sets = scratch.save(shingle_sets(docs.join(by_merge(ids), docs.doc_id == ids.id, "left_semi"), width).distinct(), "sets")
    pairs = members.where("id > pivot").where(F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent).select(F.col("pivot").alias("p"), F.col("id").alias("q")).distinct()
    links = scratch.save(verified(pairs, sets, percent), "links")
    comp = components(scratch, links)
    at = members.select("key", "id").join(by_merge(comp.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ids = scratch.save(at.join(by_merge(split), "key", "left_semi").select("id", "component").distinct(), "open")
    if not open_ids.isEmpty():
        more = verified(remaining_pairs(scratch, sets.join(by_merge(open_ids), "id"), percent), sets, percent)
        links = scratch.save(links.union(more), "links")
        comp = components(scratch, links)
    out = sigs.join(by_merge(nodes.select("digest", F.col("id").alias("node"))), "digest", "left")
    out = out.join(by_merge(comp), "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
