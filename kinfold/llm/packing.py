"""Variable-capacity best-fit packing of documents into training sequences.

Permitted sequence lengths are optimised jointly: an item goes to the open bin with the least room that holds it; if none
does, a bin of the capacity with the least cost for each token that the items still to come can fill it with is opened; at the end every bin is cut
down to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, Scratch

CAPACITIES = (512, 1024, 2048, 4096)


def cost(capacity: int, fixed: int = 32, quadratic: float = 1 / 65536) -> float:
    """Cost of one sequence: its length, a share that every sequence has, and one for attention over it."""
    return capacity + fixed + capacity * capacity * quadratic


def filled(sizes: np.ndarray, falling: np.ndarray, sums: np.ndarray, i: int, capacity: int) -> int:
    """What a bin of the capacity opened for item i would hold, if it took of the smaller items still to come the largest that
    fits, again and again.  falling: the sizes negated; sums: their running sums, 0 first."""
    room, j, n = capacity - int(sizes[i]), i + 1, len(sizes)
    while room > 0 and j < n:
        j += int(np.searchsorted(falling[j:], -room))
        if j >= n:
            break
        k = int(np.searchsorted(sums, sums[j] + room, side="right")) - 1  # a run of items that fit one after the other
        room, j = room - int(sums[k] - sums[j]), k
    return capacity - room


def best_fit(sizes: np.ndarray, capacities: tuple = CAPACITIES, price=cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items in falling order of size: bin, offset in the bin; and each bin's final capacity.

    Bins are opened with a choice of all capacities, of each two and of each one that hold the largest item; the packing of the
    least total cost stands, so it is no worse than that of any single capacity.
    """
    caps = sorted(capacities)
    some = [tuple(caps), *itertools.combinations(caps, 2), *((c,) for c in caps)]
    top = int(sizes[0]) if len(sizes) else 0
    runs = [_best_fit(sizes, x, caps, price) for x in dict.fromkeys(some) if max(x) >= top]
    return min(runs, key=lambda r: sum(price(int(c)) * int(n) for c, n in zip(*np.unique(r[2], return_counts=True))))


def _best_fit(sizes: np.ndarray, opened: tuple, caps: list[int], price) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit where bins are opened at the capacities ``opened`` and cut down to any of ``caps``.

    The capacity to open is the one with the least cost a token: what the bin would hold is found from the sizes still to come (see
    ``filled``), and its cost is that of the smallest capacity that holds it, as bins are cut down in the end.  Open bins are kept
    by room in a sorted list; equal rooms go by age.  Ties between capacities go to the smaller.
    """
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []
    falling, sums = -np.asarray(sizes, np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    final = lambda n: caps[bisect.bisect_left(caps, n)]
    for i, size in enumerate(sizes.tolist()):
        k = bisect.bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            holds = {c: filled(sizes, falling, sums, i, c) for c in opened if c >= size}
            left = min(holds, key=lambda c: (price(final(holds[c])) / holds[c], c))
            b = len(used)
            used.append(0)
        bins[i], offset[i] = b, used[b]
        used[b] += size
        if left - size >= 1:
            bisect.insort(room, (left - size, b))
    return bins, offset, np.array([final(u) for u in used], np.int64)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple = CAPACITIES, shard_rows: int = 8192) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length (in words of the text), shard, bin, capacity, offset.

    Documents longer than the largest capacity are cut into pieces of that capacity.  Items are dealt by a hash of id and
    text to shards of about ``shard_rows`` documents (ids and lengths only travel), each packed on its own by falling size;
    the loss against one global packing is a bin or so for each shard.  Wordless and null texts give no piece.  Rows
    sharing an id are packed each (those equal in text too go to one shard); a null id is kept as null.  Ties in length go by that hash.
    An empty table gives no rows.  Further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    top = max(capacities)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("n")).where("n > 0")
    d = scratch.save(d.select("doc_id", "h", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {top}"))).alias("piece")), "items")
    shards = max(1, -(-d.count() // shard_rows))

    def one(items: pa.Table) -> pa.Table:
        # Arrow keeps ids as they are: a null among them must not make floats of the others.
        size, h, piece = (items.column(c).to_numpy() for c in ("length", "h", "piece"))
        items = items.take(pa.array(np.lexsort((piece, h, -size))))
        bins, offset, caps = best_fit(items.column("length").to_numpy(), capacities)
        for name, x in (("bin", bins), ("capacity", caps[bins]), ("offset", offset)):
            items = items.append_column(name, pa.array(x, pa.int64()))
        return items.select(["doc_id", "piece", "start", "length", "shard", "bin", "capacity", "offset"])

    d = d.select("doc_id", "h", F.col("piece").cast("long").alias("piece"), (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece").cast("long") * top).alias("length"))
    # Pieces are dealt one by one (a huge document spreads over shards); equal rows go apart by nothing, as they are equal items.
    d = d.withColumn("shard", F.pmod(F.xxhash64("h", "piece"), F.lit(shards)))
    schema = "doc_id long, piece long, start long, length long, shard long, bin long, capacity long, offset long"
    return d.select("doc_id", "h", "piece", "start", "length", "shard").groupBy("shard").applyInArrow(one, schema)
