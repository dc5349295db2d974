"""Document fingerprints: one-permutation MinHash, optimally densified, low-order bits packed, with bias correction.

The word shingles of a text are hashed once; the high bits of a hash choose one of BINS bins, and each bin keeps its least hash.
An empty bin takes the value of a full one that a second hash of (bin, attempt) chooses; the choice is the same for all
documents, so bins still agree with the sets' similarity as probability.  BITS low-order bits of each bin's value are kept.
Two fingerprints agree in a share m of their bins; as unequal values agree by chance in 1 of 2**BITS, the likeness is
(m - c) / (1 - c) with c = 2**-BITS, between 0 and 1.  Its standard error is below 1 / (2 * sqrt(BINS)) * 1.07: 0.033.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, mix64, shingles

BINS = 256
BITS = 4


def _attempts(bins: int, tries: int) -> np.ndarray:
    """probe[t, i]: the bin that empty bin i asks at attempt t."""
    i, t = np.arange(bins, dtype=np.uint64), np.arange(tries, dtype=np.uint64)
    return (mix64(i[None, :] * np.uint64(0x9E37) + mix64(t + np.uint64(77))[:, None]) % np.uint64(bins)).astype(np.int64)


_PROBE = _attempts(BINS, 2048)


def fingerprint(text: str | None, width: int = 5) -> np.ndarray | None:
    """The BITS-bit values of all bins; None for a text without words."""
    s = shingles(text, width)
    if not len(s):
        return None
    bins = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = bins[1:] != bins[:-1]  # hashes are sorted, so a bin's first is its least
    value, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[bins[first]], full[bins[first]] = s[first], True
    empty = np.flatnonzero(~full)
    for lo, hi in ((0, 32), (32, 2048)):
        if not len(empty):
            break
        ask = _PROBE[lo:hi, empty]
        hit = full[ask]
        found = hit.any(axis=0)
        source = ask[hit.argmax(axis=0), np.arange(len(empty))]
        value[empty[found]] = value[source[found]]
        empty = empty[~found]
    if len(empty):  # no full bin within all attempts: the next full one
        at = np.flatnonzero(full)
        value[empty] = value[at[np.searchsorted(at, empty) % len(at)]]
    return (mix64(value) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(values: np.ndarray | None) -> str:
    """Two 4-bit values a byte, in hexadecimal; empty for a text without words."""
    return "" if values is None else ((values[0::2] << 4) | values[1::2]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    c = 2.0**-BITS
    return min(1.0, max(0.0, (float((a == b).mean()) - c) / (1 - c)))


def with_next(docs: DataFrame, scratch: Scratch, part_rows: int = 1024) -> DataFrame:
    """(bucket, ghost, doc_id, text): rows in buckets of neighbouring ids; ghost rows are the first row of the following bucket.

    Bucket borders are quantiles of the ids (one for each part_rows rows, at most 100,000); which row heads a bucket is
    found on ids and hashes alone, so each text moves once.  Tasks stream through sorted buckets with one row in hand, so larger
    buckets (of more than 100,000,000 documents, or of one id repeated) bound no memory.
    """
    d = docs.withColumn("th", F.xxhash64("text"))
    n = docs.count()
    parts = int(min(100_000, max(1, n // part_rows)))
    borders = sorted(set(d.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    spark = docs.sparkSession
    if not borders:
        bucket = F.lit(0).cast("long")
        d = d.withColumn("bucket", bucket)
    else:
        # Buckets fall as ids rise: rows follow one another from large ids to small.
        lines = spark.sparkContext.broadcast(np.array(borders).astype(np.int64))  # at most 100,000 numbers

        @F.pandas_udf("long")
        def place(ids: pd.Series) -> pd.Series:
            return pd.Series(len(lines.value) - np.searchsorted(lines.value, ids.to_numpy(), side="right"))

        d = d.withColumn("bucket", place(F.coalesce("doc_id", F.lit(-(2**63)))))
    ids = scratch.save(d.select("bucket", "doc_id", "th"), "ids")
    heads = ids.groupBy("bucket").agg(F.max(F.struct("doc_id", "th")).alias("h")).orderBy("bucket").collect()  # one row a bucket
    follow = {}
    for i, r in enumerate(heads):
        follow[(r.h.doc_id, r.h.th)] = heads[i - 1].bucket
    rows = [(k[0], k[1], b) for k, b in follow.items()]
    if not rows:
        return d.select("bucket", F.lit(False).alias("ghost"), "doc_id", "th", "text")
    ghosts = F.broadcast(spark.createDataFrame(rows, "g_id long, g_th long, to_bucket long"))
    j = d.join(ghosts, d.doc_id.eqNullSafe(F.col("g_id")) & (d.th == F.col("g_th")), "left")
    both = F.when(F.col("to_bucket").isNull(), F.array(F.struct("bucket", F.lit(False).alias("ghost")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("ghost")), F.struct(F.col("to_bucket").alias("bucket"), F.lit(True).alias("ghost"))))
    return j.select(F.explode(both).alias("x"), "doc_id", "th", "text").select("x.bucket", "x.ghost", "doc_id", "th", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text whose last floor(n_chars / 3) code points give way to the first as many (or
    all) of the next document by falling id (after the last comes the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  A null text is empty; a text
    without words has the empty fingerprint, which is like itself (1) and unlike all others (0).  Ties of ids go by falling
    hash of the text, null ids come last.  A single document is its own next one.  An empty table gives no rows.  Texts of any length
    count whole; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "prints")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs, scratch)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), F.col("th").desc())

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # bucket, id, text, fingerprint of the row before
        for batch in batches:
            out = []
            for bucket, ghost, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = fingerprint(text)
                if held is not None and held[0] == bucket:
                    _, last, old, mark = held
                    cut = len(old) // 3
                    new = old[: len(old) - cut] + text[:cut] if cut else old
                    edit = mark if new == old else fingerprint(new)
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last, len(old), digest, packed(mark), packed(edit), likeness(mark, edit), likeness(mark, own)))
                held = None if ghost else (bucket, doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("bucket", "ghost", "doc_id", "text").mapInArrow(run, schema)
