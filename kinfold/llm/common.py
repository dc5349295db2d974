"""Shared pieces: scratch tables in the cluster's shared folder, word and shingle hashing, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, and let Spark remove a query's shuffle files when it ends."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse (shared as well) where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables of one operator's run, written to the shared folder to cut lineage; an executor's loss costs no recomputation of earlier steps."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        tune(spark)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *dfs: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in dfs:
            for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if self.root.split("://")[-1].lstrip("/") in file:
                    p = jvm.org.apache.hadoop.fs.Path(file)
                    p.getFileSystem(conf).delete(p, True)


def by_merge(df: DataFrame) -> DataFrame:
    """The side of a join that else might be gathered by the driver and broadcast; both sides are shuffled and sorted instead."""
    return df.hint("merge")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such column."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


# ---- hashing -------------------------------------------------------------------------------------------------

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(seed * 1000003)) | np.uint64(1)


_BYTE = mix64(np.arange(256, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]
_BYTE_CASED = mix64(np.arange(256, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_ORDER = constants(64, 7)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, i < n at least."""
    global _POW, _INV
    with np.errstate(over="ignore"):
        while len(_POW) < n:
            k = len(_POW)
            _POW = np.concatenate([_POW, _POW * np.uint64(pow(_BASE, k, 1 << 64))])
            _INV = np.concatenate([_INV, _INV * np.uint64(pow(_BASE_INV, k, 1 << 64))])
    return _POW, _INV


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; words are found and hashed by array operations over the bytes."""
    if len(data) <= _CHUNK:
        return _word_hashes(np.frombuffer(data, np.uint8))
    parts, at, a = [], 0, np.frombuffer(data, np.uint8)
    while at < len(a):
        end = min(len(a), at + _CHUNK)
        if end < len(a) and not _SPACE[a[end]]:
            back = np.flatnonzero(_SPACE[a[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # one very long word
                while end < len(a) and not _SPACE[a[end]]:
                    end += 1
        parts.append(_word_hashes(a[at:end]))
        at = end
    return np.concatenate(parts)


def _word_hashes(a: np.ndarray) -> np.ndarray:
    edge = np.zeros(len(a) + 2, np.int8)
    edge[1:-1] = ~_SPACE[a]
    edge = np.diff(edge)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    pow_, inv = powers(len(a) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * pow_[: len(a)], out=total[1:])
        h = (total[ends] - total[starts]) * inv[starts]
        return mix64(h ^ ((ends - starts).astype(np.uint64) * _GOLD))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words the whole sequence is one; without words, none."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        if len(w) < width:
            return mix64(np.array([(w * _ORDER[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
        total = w[: len(w) - width + 1] * _ORDER[0]
        for i in range(1, width):
            total = total + w[i : len(w) - width + 1 + i] * _ORDER[i]
    return np.unique(mix64(total))


# ---- connected components ------------------------------------------------------------------------------------


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b): the smallest node that can be reached.

    Alternating large-star and small-star steps; every step is a few joins on keys and map-side minima, no node's
    neighbours are gathered, and each round is written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(edges, "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(by_merge(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(by_merge(least), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        nxt = small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        old, now = now, scratch.save(nxt, "edges")
        scratch.drop(old)
