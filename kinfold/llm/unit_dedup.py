"""Exact deduplication of paragraphs, lines or sentences: normalised units are hashed, digests grouped over the whole corpus, and only
the earliest occurrence of each stays.

A passage may stand in the middle of a line, between words that differ from copy to copy, so units go down to sentences: the
whole sentences of the passage are the same units in every copy.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, fresh

_S, _WHITE = r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r"
#: What stands between two units, by level.
BREAKS = {
    "paragraphs": re.compile(rf"{_S}*\n{_S}*\n{_S}*"),
    "lines": re.compile(rf"{_S}*\n{_S}*"),
    "sentences": re.compile(rf"{_S}*\n{_S}*|(?<=[.!?]){_S}+"),
}


def units(text: str, level: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end in code points, normalised bytes, words) of the units in order: A-Z lower-cased, a space between words.  White
    space around units belongs to none; a text without words has no unit."""
    out, at = [], 0
    for m in [*BREAKS[level].finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        words = part.encode("utf-8", "surrogatepass").lower().split()
        if words:
            out.append((at + len(part) - len(part.lstrip(_WHITE)), at + len(part.rstrip(_WHITE)), b" ".join(words), len(words)))
        at = m.end() if m else end
    return out


def without(text: str, every: list, gone: set) -> str:
    """The units that stay, each but the first after the white space that stood before it."""
    stay = [i for i in range(len(every)) if i not in gone]
    return "".join((text[every[i - 1][1] : every[i][0]] if k else "") + text[every[i][0] : every[i][1]] for k, i in enumerate(stay))


def remove_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: str = "sentences", min_words: int = 8) -> DataFrame:
    """All rows of ``docs``, the text without its repeated units, and __units, __removed, __spans (array of (start, length) of the
    removed units in code points of the original text), which take the place of columns of these names.

    level: paragraphs, lines or sentences (see BREAKS).  A unit counts if it has at least ``min_words`` words.  Its first
    occurrence by (id, hash of the text, place) stays; all later ones go, in the same document too.  A text that loses
    nothing stays as it is; one that loses a unit loses its outer white space too.  Null texts stay null, empty ones and those
    without words stay and have no units; null ids are left alone and keep nobody else from staying; rows with equal id and
    text are one place and lose the same.  A text is worked on whole, however long.  An empty table gives no rows.  Digests have
    128 bits.

    A digest of very many occurrences is split: digests are counted map-side, and the few that repeat are written before
    they meet the occurrences, so that join's large partitions are split at run time.
    """
    scratch = Scratch(docs.sparkSession, "units")

    def hashes(batches):
        for batch in batches:
            ids, ths, places, a, b = [], [], [], [], []
            for doc, th, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i, (_, _, n, size) in enumerate(units(text or "", level)):
                    if size >= min_words:
                        h = xxhash.xxh3_128_intdigest(n)
                        ids.append(doc)
                        ths.append(th)
                        places.append(i)
                        a.append(h >> 64)
                        b.append(h & 0xFFFFFFFFFFFFFFFF)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(places, pa.int64()), signed(a), signed(b)], ["doc_id", "th", "place", "a", "b"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    found = scratch.save(d.where("doc_id is not null").mapInArrow(hashes, "doc_id long, th long, place long, a long, b long"), "units")
    where = F.struct("doc_id", "th", "place")
    first = scratch.save(found.groupBy("a", "b").agg(F.count("*").alias("c"), F.min(where).alias("first")).where("c > 1").drop("c"), "repeated")
    later = found.join(first, ["a", "b"]).where(where > F.col("first"))
    key, th, places, cut_ = fresh(docs, "__id", "__th", "__gone", "__cut")
    gone = later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("place")).alias(places)).select(F.col("doc_id").alias(key), F.col("th").alias(th), places)
    j = docs.join(gone, (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(text_col) == F.col(th)), "left").drop(key, th)

    @F.pandas_udf("struct<text string, units long, removed long, spans array<struct<start long, length long>>>")
    def cut(text: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p in zip(text, places):
            every = units(t or "", level)
            if p is None:
                rows.append((t, len(every), 0, []))
            else:
                drop = set(np.asarray(p).tolist())
                rows.append((without(t, every, drop), len(every), len(drop), [{"start": every[i][0], "length": every[i][1] - every[i][0]} for i in sorted(drop)]))
        return pd.DataFrame(rows, columns=["text", "units", "removed", "spans"])

    j = j.withColumn(cut_, cut(F.col(text_col), F.col(places))).drop(places)
    done = F.col(cut_)
    return j.withColumn(text_col, done["text"]).withColumns({"__units": done["units"], "__removed": done["removed"], "__spans": done["spans"]}).drop(cut_)
