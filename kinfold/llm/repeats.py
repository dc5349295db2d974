"""Repeated byte strings across documents, by the common-prefix interval tree of enhanced suffix arrays.

Every window of ``length`` bytes is assigned to its anchor, the leftmost least hash among its GRAM-byte grams; equal windows
have equal anchors.  Consecutive windows with one anchor form a stretch, and stretches are dealt to shards by their anchor, so equal windows
meet in one shard wherever they stand.  It goes block by block (see blocks):

1. a block sends each shard its distinct (anchor, stretch digest) with the smallest document that has it; the shard
   tells which stretches stand whole in a smaller document elsewhere, and which anchors have several different stretches;
2. of each different stretch of such an anchor one holder (the smallest document) sends the bytes.  The shard sorts the suffixes
   that begin windows, takes the common prefixes of neighbours, and scans them with a stack for the intervals of at
   least ``length`` bytes.  Intervals whose members are all preceded by one byte are left out (a longer repeat holds them);
   the rest are the maximal repeats with all their members, and members in larger documents than the smallest lose the bytes.
   Such intervals lie within suffixes of one first window, so the shard takes a part of its anchors at a time, and of these the
   suffixes whose first window occurs twice, in parts of whole windows: what it holds follows neither the share of
   anchors with several stretches, which grows with the corpus, nor the commonest anchor;
3. the block applies both answers to its texts.

Equal stretches collapse to one row for each block before anything moves, so a passage that stands in a third of all
documents costs one row a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .common import _BYTE_CASED, _GOLD, Scratch, mix64, powers

GRAM = 20
#: Suffixes that are sorted at once, about 200 bytes each.
SUFFIXES = 1 << 18


class Stretches:
    """The stretches of a block's documents; an anchor's stretches are runs of windows in one document."""

    def __init__(self, texts: list[bytes], ids: list, length: int):
        self.data = a = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        lo, hi, anchor, digest, row = [], [], [], [], []
        # Runs of documents of about 4 MB, so that memory follows one text at most.
        at = 0
        while at < len(texts):
            to = at + 1
            while to < len(texts) and self.ends[to] - self.starts[at] <= B.BLOCK_BYTES:
                to += 1
            got = self._some(a[self.starts[at] : self.ends[to - 1]], sizes[at:to], np.array([i is not None for i in ids[at:to]]), length)
            if got is not None:
                base = self.starts[at]
                lo.append(got[0] + base)
                hi.append(got[1] + base)
                anchor.append(got[2])
                digest.append(got[3])
                row.append(got[4] + at)
            at = to
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.lo, self.hi, self.row = cat(lo, np.int64), cat(hi, np.int64), cat(row, np.int64)
        self.anchor, self.digest = cat(anchor, np.uint64), cat(digest, np.uint64)
        doc = np.array([0 if i is None else i for i in ids], np.int64)[self.row] if len(self.row) else np.empty(0, np.int64)
        self.doc = doc
        # Distinct (anchor, digest) in order, the smallest document of each, and the occurrence that has it.
        by = np.lexsort((doc, self.digest, self.anchor))
        new = np.ones(len(by), bool)
        new[1:] = (self.anchor[by][1:] != self.anchor[by][:-1]) | (self.digest[by][1:] != self.digest[by][:-1])
        first = np.flatnonzero(new)
        self.key = np.empty(len(by), np.int64)
        self.key[by] = np.cumsum(new) - 1
        self.holder = by[first]

    @staticmethod
    def _some(a, sizes, known, length):
        n, w = len(a), length - GRAM + 1
        if n < length:
            return None
        pw, inv = powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_CASED[a] * pw[:n], out=total[1:])
            h = mix64((total[GRAM:] - total[:-GRAM]) * inv[: n - GRAM + 1])
            # Sliding minimum over w grams by doubling; strict comparison keeps the leftmost.
            val, idx, span = h, np.arange(len(h), dtype=np.int32), 1
            while span < w:
                step = min(span, w - span)
                right = val[step:]
                left = val[: len(right)]
                less = right < left
                idx = np.where(less, idx[step:], idx[: len(right)])
                val = np.minimum(left, right)
                span += step
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(val)]
            ok = (np.arange(len(val)) + length <= ends[row]) & known[row]
            new = np.ones(len(val), bool)
            new[1:] = (idx[1:] != idx[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1]
            lo = np.flatnonzero(new & ok)
            if not len(lo):
                return None
            stop = new | ~ok
            nxt = np.append(np.flatnonzero(stop), len(val))
            hi = nxt[np.searchsorted(nxt, lo, side="right")] - 1 + length
            digest = mix64(((total[hi] - total[lo]) * inv[lo]) ^ ((hi - lo).astype(np.uint64) * _GOLD))
        return lo, hi, val[lo], digest, row[lo].astype(np.int64)


def suffixes(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of the suffixes that have at least ``length`` bytes."""
    per = np.array([len(s) for s in strings], np.int64) - length + 1
    return np.repeat(np.arange(len(strings)), per), np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)


def first_windows(strings: list[bytes], length: int) -> np.ndarray:
    """A hash of the first ``length`` bytes of each of the suffixes, in their order; about a MB of strings at a time."""
    ends, at, out = np.cumsum([len(s) for s in strings]), 0, []
    while at < len(strings):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20))))
        a = np.frombuffer(b"".join(strings[at:to]), np.uint8)
        pw, inv = powers(len(a) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(_BYTE_CASED[a] * pw[: len(a)], out=total[1:])
            h = mix64((total[length:] - total[:-length]) * inv[: len(a) - length + 1])
        which, start = suffixes(strings[at:to], length)
        sizes = np.array([len(x) for x in strings[at:to]], np.int64)
        out.append(h[(np.cumsum(sizes) - sizes)[which] + start])
        at = to
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def interval_tree(strings: list[bytes], docs: np.ndarray, length: int, members: tuple[np.ndarray, np.ndarray] | None = None):
    """The maximal repeats of at least ``length`` bytes in the strings, and the suffixes in order.

    Returns (which, start) of the suffixes in the order of the suffix array (those with at least ``length`` bytes), and a list of
    (left, right, common prefix, smallest document): the members of a repeat are suffixes left .. right.  Parents come before
    their children.  ``members``: the (string, start) of the only suffixes to take, with all that share their first window.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    width = int(sizes.max())
    flat = np.frombuffer(b"".join(strings) + bytes(width), np.uint8)
    begin = np.cumsum(sizes) - sizes
    which, start = members or suffixes(strings, length)
    at, room = begin[which] + start, sizes[which] - start
    width = -(-width // 8) * 8
    # Sort by words of eight bytes, the last first; what lies beyond a string's end counts as zero.
    flat = np.concatenate([flat, np.zeros(width, np.uint8)])
    words = []
    for k in range(0, width, 8):
        w = np.zeros(len(at), np.uint64)
        for j in range(8):
            w = (w << np.uint64(8)) | np.where(room > k + j, flat[at + k + j], 0).astype(np.uint64)
        words.append(w)
    order = np.lexsort(words[::-1])
    which, start, room = which[order], start[order], room[order]
    # Common prefixes of neighbours: whole words, then the first differing byte within a word.
    lcp = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for w in words:
        w = w[order]
        x = w[1:] ^ w[:-1]
        add = np.full(len(x), 8, np.int64)
        nz = x != 0
        top = x[nz]
        zeros = np.zeros(len(top), np.int64)
        for shift in (32, 16, 8):
            empty = (top >> np.uint64(64 - shift)) == 0
            zeros[empty] += shift // 8
            top = np.where(empty, top << np.uint64(shift), top)
        add[nz] = zeros
        lcp[1:] += np.where(same, add, 0)
        same &= ~nz
    lcp[1:] = np.minimum(lcp[1:], np.minimum(room[1:], room[:-1]))
    # The byte before each suffix; none at a string's start, which differs from all.
    before = np.where(start > 0, flat[np.maximum(begin[which] + start - 1, 0)].astype(np.int64), -1 - np.arange(len(order)))
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    doc = docs[which]
    out = []
    deep = np.flatnonzero(lcp >= length)
    if not len(deep):
        return which, start, out
    runs = np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1)
    for run in runs:
        l0, r0 = int(run[0]) - 1, int(run[-1])
        stack: list[list[int]] = []  # common prefix, left, smallest document
        docs_, lcps = doc[l0 : r0 + 1].tolist(), [*lcp[l0 + 1 : r0 + 1].tolist(), 0]
        found = []
        for i, depth in enumerate(lcps):
            left, low = i, docs_[i]
            while stack and stack[-1][0] > depth:
                d, left, m = stack.pop()
                low = min(low, m)
                if change[l0 + i] != change[l0 + left]:
                    found.append((l0 + left, l0 + i, d, low))
                if stack:
                    stack[-1][2] = min(stack[-1][2], low)
            if depth and (not stack or stack[-1][0] < depth):
                stack.append([depth, left, low])
            elif stack:
                stack[-1][2] = min(stack[-1][2], low)
        out += reversed(found)
    return which, start, out


def removals(strings: list[bytes], docs: np.ndarray, length: int, most: int = SUFFIXES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, bytes): parts of strings that a string of a smaller document has too.  At most ``most`` suffixes are sorted
    at once, or those of one first window if these are more."""
    hashes = first_windows(strings, length)
    by = np.argsort(hashes, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], hashes[by][1:] != hashes[by][:-1]])) if len(by) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(by)))
    by, size = by[np.repeat(size > 1, size)], size[size > 1]
    del hashes, head
    all_, at = suffixes(strings, length), 0
    ends, out = np.cumsum(size), []
    while at < len(by):
        to = int(ends[max(np.searchsorted(ends, at + most, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        part = np.sort(by[at:to])
        which, start, tree = interval_tree(strings, docs, length, (all_[0][part], all_[1][part]))
        best, doc = np.zeros(len(which), np.int64), docs[which]
        for left, right, depth, low in tree:
            if right - left < 8:
                for i in range(left, right + 1):
                    if doc[i] > low:
                        best[i] = max(best[i], depth)
            else:
                span = best[left : right + 1]
                np.maximum(span, np.where(doc[left : right + 1] > low, depth, 0), out=span)
        hit = np.flatnonzero(best)
        out.append((which[hit], start[hit], best[hit]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def shard_removals(sent: list[dict[str, np.ndarray]], length: int, most: int = SUFFIXES) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(sender, key, start, bytes): the removals among the stretches that a shard was sent, by sender; the anchors' tags deal them into
    parts of about 4 * ``most`` suffixes, or those of one tag if these are more."""
    owner = np.repeat(np.arange(len(sent)), [len(g["k"]) for g in sent])
    k, o, n, tag = (np.concatenate([g[x] for g in sent]) for x in "kont")
    ends = np.concatenate([np.cumsum(g["n"]) for g in sent])
    raw = [memoryview(g["b"]) for g in sent]
    by = np.argsort(tag, kind="stable")
    tags, count = np.unique(tag, return_counts=True)
    last = np.cumsum(count)
    upto = np.cumsum((n - length + 1)[by])
    out, at = [], 0
    while at < len(by):
        full = np.searchsorted(upto, (upto[at - 1] if at else 0) + 4 * most, side="right")
        to = int(last[max(np.searchsorted(last, full, side="right") - 1, np.searchsorted(last, at, side="right"))])
        part = by[at:to]
        strings = [raw[i][e - x : e] for i, e, x in zip(owner[part].tolist(), ends[part].tolist(), n[part].tolist())]
        which, start, size = removals(strings, o[part], length, most)
        out.append((part[which], start, size))
        at = to
    which, start, size = (np.concatenate(x) for x in zip(*out))
    senders = owner[which]
    return [(int(i), k[which[m]], start[m], size[m]) for i in np.unique(senders) for m in [senders == i]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, shards: int | None = None) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

    One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of (start, length) of the removed
    runs, offsets in the original bytes).  Texts are UTF-8 bytes, null is empty; matches stay within documents, and strings
    are judged on the input.  Rows with one id don't remove from one another; a null id neither removes nor loses anything.
    A text of any length is one row of a block.  An empty table gives no rows.  Further columns are ignored.  Strings of over
    GRAM bytes only (length > 20).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stored, buckets = B.write_blocks(scratch, docs)
    shards = shards or B.shards_for(stored)

    def load(blob):
        batch = B.unpack(blob)
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        ids = batch.column(0).to_pylist()
        return texts, ids, Stretches(texts, ids, length)

    def parts(s: Stretches):
        """For each shard the distinct keys that go there."""
        shard = (s.anchor[s.holder] % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[by], np.arange(shards + 1))
        return [(j, by[cut[j] : cut[j + 1]]) for j in range(shards) if cut[j] < cut[j + 1]]

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["blk", "shard", "blob"])

    schema = "blk long, shard long, blob binary"

    def ask(batches):
        for got in batches:
            for blk, blob in zip(got.column(0).to_pylist(), got.column(1)):
                _, _, s = load(blob.as_py())
                h = s.holder
                yield rows([(blk, j, B.encode({"a": s.anchor[h[k]], "d": s.digest[h[k]], "o": s.doc[h[k]]})) for j, k in parts(s)])

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        """Flags for each key asked: 1 if a smaller document elsewhere has the stretch, 2 if its bytes are wanted."""
        got = [B.decode(b) for b in frame["blob"]]
        sizes = [len(g["a"]) for g in got]
        a, d, o = (np.concatenate([g.pop(k) for g in got]) for k in "ado")
        by = np.lexsort((o, d, a))
        a, d, o = a[by], d[by], o[by]
        new = np.ones(len(by), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        low = np.repeat(o[at], np.diff(np.append(at, len(by))))
        # Of each anchor: the smallest and the largest of its stretches' smallest documents.
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        lens = np.diff(np.append(head, len(by)))
        several = np.repeat(np.minimum.reduceat(low, head) != np.maximum.reduceat(low, head), lens)
        flags = np.empty(len(by), np.uint8)
        flags[by] = (low < o) + 2 * (several & (low == o)).astype(np.uint8)
        ends = np.cumsum(sizes)
        return pd.DataFrame({"blk": frame["blk"], "shard": frame["shard"], "blob": [B.encode({"f": x}) for x in np.split(flags, ends[:-1])]})

    def flags_of(s: Stretches, msgs, kind: int):
        flags = np.zeros(len(s.holder), np.uint8)
        got = {m["shard"].as_py(): m["blob"].as_py() for m in msgs.values if m["kind"].as_py() == kind} if msgs.is_valid else {}
        for j, k in parts(s):
            flags[k] = B.decode(got[j])["f"]
        return flags

    def send(batches):
        for got in batches:
            for blk, blob, msgs in zip(got.column(0).to_pylist(), got.column(1), got.column(2)):
                _, _, s = load(blob.as_py())
                flags, out = flags_of(s, msgs, 1), []
                for j, k in parts(s):
                    k = k[flags[k] & 2 > 0]
                    if len(k):
                        lo, hi = s.lo[s.holder[k]], s.hi[s.holder[k]]
                        size = hi - lo
                        take = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                        tag = (mix64(s.anchor[s.holder[k]]) >> np.uint64(48)).astype(np.uint16)
                        out.append((blk, j, B.encode({"k": k, "o": s.doc[s.holder[k]], "n": size, "t": tag, "b": s.data[take]})))
                if out:
                    yield rows(out)

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        found = shard_removals([B.decode(b) for b in frame["blob"]], length)
        out = [(int(frame["blk"].iloc[i]), int(frame["shard"].iloc[i]), B.encode({"k": k, "s": start, "n": size})) for i, k, start, size in found]
        return pd.DataFrame(out, columns=["blk", "shard", "blob"])

    def apply(batches):
        for got in batches:
            for blob, msgs in zip(got.column(1), got.column(2)):
                texts, ids, s = load(blob.as_py())
                # +1 where removed bytes begin, -1 where they end.
                edge = np.zeros(len(s.data) + 1, np.int32)
                if len(s.holder):
                    flags = flags_of(s, msgs, 1)
                    gone = (flags[s.key] & 1 > 0) | (s.doc > s.doc[s.holder[s.key]])
                    np.add.at(edge, s.lo[gone], 1)
                    np.add.at(edge, s.hi[gone], -1)
                    by = np.argsort(s.key, kind="stable")
                    keys = s.key[by]
                    for m in msgs.values if msgs.is_valid else ():
                        if m["kind"].as_py() == 2:
                            x = B.decode(m["blob"].as_py())
                            left, right = np.searchsorted(keys, x["k"]), np.searchsorted(keys, x["k"], side="right")
                            times = right - left
                            occ = by[np.repeat(left - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())]
                            a = s.lo[occ] + np.repeat(x["s"], times)
                            own = s.doc[occ] == s.doc[s.holder[s.key[occ]]]  # others are gone whole
                            np.add.at(edge, a[own], 1)
                            np.add.at(edge, (a + np.repeat(x["n"], times))[own], -1)
                cover = np.cumsum(edge[:-1]) > 0
                out = []
                for i, t in enumerate(texts):
                    c = cover[s.starts[i] : s.ends[i]]
                    d = np.diff(np.concatenate([[0], c.view(np.int8), [0]]).astype(np.int8)) if len(c) else np.zeros(0, np.int8)
                    a, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
                    kept = s.data[s.starts[i] : s.ends[i]][~c].tobytes() if len(a) else t
                    out.append((ids[i], len(t), int(c.sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": x, "length": y - x} for x, y in zip(a.tolist(), e.tolist())]))
                cols = list(zip(*out)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    with B.batch_rows(spark, 4):
        flags = scratch.save(stored.mapInArrow(ask, schema).groupBy("shard").applyInPandas(judge, schema).withColumn("kind", F.lit(1)), "flags")
        sent = B.join_blocks(stored, buckets, flags).mapInArrow(send, schema)
        spans = scratch.save(sent.groupBy("shard").applyInPandas(sort, schema).withColumn("kind", F.lit(2)), "spans")
        out = B.join_blocks(stored, buckets, flags.union(spans)).mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start long, length long>>")
        out = scratch.save(out, "result")
    scratch.drop(flags, spans)
    B.release(stored)
    return out
