"""Repeated runs of lines, found by a suffix array over line-ID sequences built with distributed prefix doubling.

Each document is a sequence of line ids.  Level k ranks every position by the 2**k lines that begin there: the rank at
level k + 1 is the place of the pair (rank at i, rank at i + 2**k) in sorted order, so ranks at the last level are the
suffix array's order and the positions that share a rank at level k are the common-prefix interval of 2**k lines.
Positions whose rank is theirs alone leave after each level (no repeated run of that length begins there), so the table
shrinks to the longest repeats.  A run of any length L between 2**k and 2**(k+1) is the union of the level-k intervals that
begin in it, so a position whose interval has an earlier member marks its 2**k lines as a later copy, and the union of the
marks is the union of all maximal repeated runs of at least ``min_lines`` lines that stand earlier as well.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, fresh


def _ranked(scratch: Scratch, pairs: DataFrame, keys: list[str], level: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Positions of the keys that occur more than once, with the key's place in sorted order and the first position that has it."""
    where = F.struct("doc_id", "th", "idx")
    # Map-side counts and minima; the global sort makes monotonically_increasing_id follow the order of the keys.
    seen = pairs.groupBy(*keys).agg(F.count("*").alias("c"), F.min(where).alias("first")).where("c > 1").drop("c")
    seen = scratch.save(seen.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), f"ranks{level}")
    out = scratch.save(pairs.join(seen, keys).select("doc_id", "th", "idx", "rank", "first", *more), f"level{level}")
    scratch.drop(seen)
    return out


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """(doc_id, th, idx, length, first): lines idx .. idx + length - 1 of a document, length a power of two, also stand at
    ``first`` (doc_id, th, idx), which is earlier in the order of (doc_id, hash of the text, line).  min_lines is a power of two; with long_words,
    single lines of at least so many words count as well."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    scratch = Scratch(docs.sparkSession, "runs")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n", -1)).alias("idx", "line")).where("doc_id is not null")
    long = F.lit(False) if long_words is None else F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= long_words
    # Two hashes that do not follow from one another: Spark chains them, so the constant comes first.
    now = d.select("doc_id", "th", "idx", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), long.alias("long")).distinct()
    now = _ranked(scratch, now, ["a", "b"], 0, ("long",))
    level, covers = 0, None
    while True:
        if 1 << level >= min_lines or (level == 0 and long_words is not None):
            later = now.where("true" if 1 << level >= min_lines else "long").where(F.struct("doc_id", "th", "idx") > F.col("first")).select("doc_id", "th", "idx", F.lit(1 << level).alias("length"), "first")
            covers = later if covers is None else covers.union(later)
        right = now.select("doc_id", "th", (F.col("idx") - (1 << level)).alias("idx"), F.col("rank").alias("b"))
        pairs = now.select("doc_id", "th", "idx", F.col("rank").alias("a")).join(right, ["doc_id", "th", "idx"])
        level += 1
        now = _ranked(scratch, pairs, ["a", "b"], level)
        if now.isEmpty():
            return covers if covers is not None else now.select("doc_id", "th", "idx", F.lit(0).alias("length"), "first")


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """All rows of ``docs`` with later copies of repeated line runs deleted from the text, and the columns __lines, __removed
    (lines) and __spans (array of (start line, lines) removed), which take the place of columns of these names.

    Lines are what stands between line feeds, compared exactly.  Nulls keep a null text, and rows with a null id are left alone;
    an empty text is one empty line.  Rows that share id and text are one place: they don't delete one another.
    A text of any length is worked on whole (its lines are rows); an empty table gives no rows; further columns stay as they are.
    Ties go by the hash of the text.  A text whose lines all go becomes empty.
    """
    covers = repeated_runs(docs, id_col, text_col, min_lines, long_words)
    key, th, c, cut_ = fresh(docs, "__id", "__th", "__c", "__cut")
    spans = covers.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("idx", "length"))).alias(c)).select(F.col("doc_id").alias(key), F.col("th").alias(th), c)
    j = docs.join(spans, (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(text_col) == F.col(th)), "left").drop(key, th)

    def merge(c):
        out: list[list[int]] = []
        for r in c if c is not None else ():
            a, b = r["idx"], r["idx"] + r["length"]
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    @F.pandas_udf("struct<text string, lines long, removed long, spans array<struct<start long, lines long>>>")
    def cut(text: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x in zip(text, c):
            if t is None:
                rows.append((None, 0, 0, []))
                continue
            spans = merge(x)
            if not spans:
                rows.append((t, t.count("\n") + 1, 0, []))
                continue
            lines, kept, at = t.split("\n"), [], 0
            for a, b in spans:
                kept += lines[at:a]
                at = b
            kept += lines[at:]
            rows.append(("\n".join(kept), len(lines), len(lines) - len(kept), [{"start": a, "lines": b - a} for a, b in spans]))
        return pd.DataFrame(rows, columns=["text", "lines", "removed", "spans"])

    j = j.withColumn(cut_, cut(F.col(text_col), F.col(c))).drop(c)
    done = F.col(cut_)
    return j.withColumn(text_col, done["text"]).withColumns({"__lines": done["lines"], "__removed": done["removed"], "__spans": done["spans"]}).drop(cut_)
