"""Quality classifier: interpolated modified Kneser-Ney model over the characters of trusted text, one for each language.

Counts, continuation counts, discounts and interpolation weights are aggregations and joins on (language, n-gram) or (language,
context).  Documents are scored block by block: a block sends the distinct n-grams of all orders to the shards of the model,
each shard answers from its sorted arrays, and the answers meet the block's text again, which gives every document's
perplexity.  A document is kept if its perplexity is at most its language's bound, a quantile of held-out trusted text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .common import Scratch, mix64

#: A symbol has 16 bits: characters up to U+FFFF are themselves, those beyond share, by remainder, the ASTRAL symbols of the
#: surrogate range, which no character of a text has; its last two are the marks around a text.
BOS, EOS = 0xDFFE, 0xDFFF
ASTRAL = 2046
DENSE = 1 << 24


def symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(cp > 0xFFFF, 0xD800 + cp % ASTRAL, cp)


def lang_key(lang: str | None) -> str:
    """A language as a key that keeps null and the empty name apart."""
    return "-" if lang is None else "+" + lang


def sequence(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array, order - 1 BOS before and one EOS after each; the predicted positions; their counts by text."""
    parts, n = [], []
    for t in texts:
        s = symbols(t)
        parts += [np.full(order - 1, BOS, np.int64), s, np.array([EOS], np.int64)]
        n.append(len(s) + 1)
    seq = np.concatenate(parts) if parts else np.empty(0, np.int64)
    n = np.array(n, np.int64)
    ends = np.cumsum(n + order - 1)
    real = np.ones(len(seq), bool)
    for i in range(order - 1):
        real[ends - n - order + 1 + i] = False
    return seq, np.flatnonzero(real), n


def distinct(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in order, each position's rank, and the counts."""
    if size <= DENSE:
        count = np.bincount(ids, minlength=size)
        u = np.flatnonzero(count)
        rank = np.zeros(size, np.int32)
        rank[u] = np.arange(len(u), dtype=np.int32)
        return u, rank[ids], count[u]
    u, inv, count = np.unique(ids, return_inverse=True, return_counts=True)
    return u, inv.astype(np.int32), count


def grams(seq: np.ndarray, at: np.ndarray, order: int) -> list[dict]:
    """For k = 1 .. order: codes (16 bits a symbol), parent (rank of the first k - 1 symbols), suffix (rank of the last k - 1),
    inv (rank at each position from k - 1 on), count over the positions `at`."""
    out, sym, r1, _ = [], *distinct(seq, 1 << 16)
    prev_inv, prev_codes = r1, sym.astype(np.uint64)
    out.append({"codes": prev_codes, "inv": r1, "count": np.bincount(r1[at], minlength=len(sym))})
    for k in range(2, order + 1):
        ids = prev_inv[:-1].astype(np.int64) * len(sym) + r1[k - 1 :]
        u, inv, _ = distinct(ids, len(prev_codes) * len(sym))
        parent, last = u // len(sym), u % len(sym)
        suffix = np.zeros(len(u), np.int32)
        suffix[inv] = prev_inv[1:]
        codes = (prev_codes[parent] << np.uint64(16)) | sym[last].astype(np.uint64)
        out.append({"codes": codes, "parent": parent, "suffix": suffix, "inv": inv, "count": np.bincount(inv[at - k + 1], minlength=len(u)) if len(at) else np.zeros(len(u), np.int64)})
        prev_inv, prev_codes = inv, codes
    return out


def gram_counts(joined: DataFrame, columns: tuple[int, int, int], order: int) -> DataFrame:
    """(lang, code, c): the n-grams of the highest order in the rows that the messages name, counted within each 4 MB and then over all."""
    _, i_text, i_lang = columns

    def run(batches):
        held, size = {}, 0

        def flush():
            for lang, texts in held.items():
                seq, at, _ = sequence(texts, order)
                g = grams(seq, at, order)[-1]
                keep = g["count"] > 0
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(keep.sum())), pa.array(g["codes"][keep].view(np.int64)), pa.array(g["count"][keep].astype(np.int64))], ["lang", "code", "c"])
            held.clear()

        for rows in batches:
            for blob, msgs in zip(rows.column(1), rows.column(2)):
                if not msgs.is_valid:
                    continue
                batch = B.unpack(blob.as_py())
                for m in msgs.values:
                    i = m["row"].as_py()
                    t = batch.column(i_text)[i].as_py()
                    if t:
                        held.setdefault(lang_key(batch.column(i_lang)[i].as_py()), []).append(t)
                        size += len(t)
                    if size > B.BLOCK_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    return joined.mapInArrow(run, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))


def train(scratch: Scratch, joined: DataFrame, columns: tuple[int, int, int], order: int) -> DataFrame:
    """(lang, k, code, logp, logw): log probability of each n-gram seen, and log weight of what is left to shorter contexts
    where the n-gram is a context (0 where it is none).  k = 0 holds the probability of a symbol never seen."""
    with B.batch_rows(scratch.spark, 4):
        tables = {order: scratch.save(gram_counts(joined, columns, order), f"counts{order}")}
    for k in range(order - 1, 0, -1):
        low = tables[k + 1].select("lang", (F.col("code").bitwiseAND(F.lit((1 << 16 * k) - 1))).alias("code"))
        tables[k] = scratch.save(low.groupBy("lang", "code").agg(F.count("*").alias("c")), f"counts{k}")
    prob = None
    model = None
    for k in range(1, order + 1):
        t = tables[k].withColumn("ctx", F.shiftrightunsigned("code", 16) if k > 1 else F.lit(0).cast("long"))
        n = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        cc = t.groupBy("lang").agg(*n)
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        ds = [F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")) for i in (1, 2, 3)]
        # Discounts out of range (too few counts of counts) fall back to fixed ones.
        cc = cc.select("lang", *[F.when((x > 0.05) & (x < i), x).otherwise(f).alias(f"d{i}") for i, (x, f) in enumerate(zip(ds, (0.5, 1.0, 1.5)), 1)])
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(F.broadcast(cc), "lang").withColumn("d", d)  # a row for each language
        ctx = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("cut"), F.count("*").alias("v"))
        ctx = scratch.save(ctx.withColumn("w", F.col("cut") / F.col("total")), f"contexts{k}")
        if k == 1:
            ctx1 = F.broadcast(ctx.select("lang", "total", "w", "v"))  # a row for each language
            p = t.join(ctx1, "lang").select("lang", "code", ((F.col("c") - F.col("d")) / F.col("total") + F.col("w") / (F.col("v") + 1)).alias("p"))
            zero = ctx.select("lang", F.lit(0).alias("k"), F.lit(0).cast("long").alias("code"), F.log(F.col("w") / (F.col("v") + 1)).alias("logp"), F.lit(0.0).alias("logw"))
            model = zero
        else:
            below = prob.withColumnRenamed("code", "low").withColumnRenamed("p", "q")
            t = t.withColumn("low", F.col("code").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)))
            p = t.join(ctx.select("lang", "ctx", "total", "w"), ["lang", "ctx"]).join(below, ["lang", "low"]).select("lang", "code", ((F.col("c") - F.col("d")) / F.col("total") + F.col("w") * F.col("q")).alias("p"))
            # Weights go to the n-gram that is the context (some contexts, with BOS, are no n-grams themselves).
            w = ctx.select("lang", F.col("ctx").alias("code"), F.log("w").alias("logw"))
            model = model.union(prob.join(w, ["lang", "code"], "full").select("lang", F.lit(k - 1), "code", F.log("p"), F.coalesce("logw", F.lit(0.0))))
        prob = scratch.save(p, f"prob{k}")
    return scratch.save(model.union(prob.select("lang", F.lit(order), "code", F.log("p"), F.lit(0.0))), "model")


def perplexities(scratch: Scratch, stored: DataFrame, buckets: int, model: DataFrame, order: int, columns: tuple[int, int, int], shards: int) -> DataFrame:
    """(blk, row, doc_id, lang, n, perplexity) for each document of the blocks, lang as lang_key gives it; columns: places of id, text and language."""
    i_id, i_text, i_lang = columns

    def by_lang(batch):
        texts, langs = batch.column(i_text).to_pylist(), batch.column(i_lang).to_pylist()
        out: dict[str, list[int]] = {}
        for i, (t, lang) in enumerate(zip(texts, langs)):
            if t:
                out.setdefault(lang_key(lang), []).append(i)
        return texts, dict(sorted(out.items()))

    def shard_of(codes):
        return (mix64(codes) % np.uint64(shards)).astype(np.int64)

    def ask(batches):
        for rows in batches:
            for blk, blob in zip(rows.column(0).to_pylist(), rows.column(1)):
                texts, langs = by_lang(B.unpack(blob.as_py()))
                out: list[dict] = [{} for _ in range(shards)]
                for lang, at in langs.items():
                    seq, pos, _ = sequence([texts[i] for i in at], order)
                    for k, g in enumerate(grams(seq, pos, order), 1):
                        s = shard_of(g["codes"])
                        by = np.argsort(s, kind="stable")
                        cut = np.searchsorted(s[by], np.arange(shards + 1))
                        for j in range(shards):
                            if cut[j] < cut[j + 1]:
                                out[j][f"{k}|{lang}"] = np.sort(g["codes"][by[cut[j] : cut[j + 1]]])
                    out[0][f"0|{lang}"] = np.zeros(1, np.uint64)
                got = [(j, B.encode(x)) for j, x in enumerate(out) if x]
                yield pa.RecordBatch.from_arrays([pa.array([blk] * len(got), pa.int64()), pa.array([j for j, _ in got], pa.int64()), pa.array([b for _, b in got], pa.binary())], ["blk", "shard", "blob"])

    def put(batches):
        for b in batches:
            codes = b.column(2).to_numpy().view(np.uint64)
            s = np.where(b.column(1).to_numpy() == 0, 0, shard_of(codes))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.int64())], ["lang", "k", "code", "logp", "logw", "shard"])

    def answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        tables = {}
        for (lang, k), g in known.groupby(["lang", "k"]):
            codes = g["code"].to_numpy().view(np.uint64)
            o = np.argsort(codes)
            tables[f"{k}|{lang}"] = codes[o], g["logp"].to_numpy(np.float32)[o], g["logw"].to_numpy(np.float32)[o]
        blobs = []
        for blob in asked["blob"]:
            out = {}
            for key, codes in B.decode(blob).items():
                p, w = np.full(len(codes), np.nan, np.float32), np.zeros(len(codes), np.float32)
                if key in tables:
                    c, lp, lw = tables[key]
                    at = np.minimum(np.searchsorted(c, codes), len(c) - 1)
                    hit = c[at] == codes
                    p[hit], w[hit] = lp[at[hit]], lw[at[hit]]
                out[f"p{key}"], out[f"w{key}"] = p, w
            blobs.append(B.encode(out))
        return pd.DataFrame({"blk": asked["blk"], "shard": asked["shard"], "blob": blobs})

    def score(batches):
        for rows in batches:
            for blk, blob, msgs in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2)):
                batch = B.unpack(blob.as_py())
                texts, langs = by_lang(batch)
                got = {m["shard"].as_py(): B.decode(m["blob"].as_py()) for m in msgs.values} if msgs.is_valid else {}
                n_rows, per = batch.num_rows, np.full(batch.num_rows, np.nan)
                length = np.zeros(n_rows, np.int64)
                for lang, at in langs.items():
                    zero = got[0][f"p0|{lang}"][0]
                    seq, pos, n = sequence([texts[i] for i in at], order)
                    length[at] = n
                    if np.isnan(zero):
                        continue  # no trusted text in this language
                    low_p, low_w = np.full(1, zero), None
                    for k, g in enumerate(grams(seq, pos, order), 1):
                        s = shard_of(g["codes"])
                        p, w = np.empty(len(s)), np.empty(len(s))
                        by = np.lexsort((g["codes"], s))
                        cut = np.searchsorted(s[by], np.arange(shards + 1))
                        for j in range(shards):
                            if cut[j] < cut[j + 1]:
                                m = by[cut[j] : cut[j + 1]]
                                p[m], w[m] = got[j][f"p{k}|{lang}"], got[j][f"w{k}|{lang}"]
                        miss = np.isnan(p)
                        p[miss] = low_p[0] if k == 1 else low_w[g["parent"][miss]] + low_p[g["suffix"][miss]]
                        low_p, low_w = p, w
                    lp = low_p[g["inv"][pos - order + 1]]
                    ends = np.cumsum(n)
                    per[at] = np.exp(-np.add.reduceat(lp, ends - n) / n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([blk] * n_rows, pa.int64()), pa.array(np.arange(n_rows)), batch.column(i_id).cast(pa.int64()), pa.array([lang_key(x) for x in batch.column(i_lang).to_pylist()], pa.string()), pa.array(length), pa.array(per, pa.float64(), mask=np.isnan(per))],
                    ["blk", "row", "doc_id", "lang", "n", "perplexity"],
                )

    asked = stored.mapInArrow(ask, "blk long, shard long, blob binary")
    known = model.mapInArrow(put, "lang string, k int, code long, logp double, logw double, shard long")
    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(answer, "blk long, shard long, blob binary")
    scored = B.join_blocks(stored, buckets, answers).mapInArrow(score, "blk long, row long, doc_id long, lang string, n long, perplexity double")
    with B.batch_rows(scratch.spark, 4):
        return scratch.save(scored, "perplexities")


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, folds: int = 5, quantile: float = 0.99, slack: float = 0.05, shards: int | None = None):
    """Verdicts (blk, row, doc_id, lang, n, perplexity, bound, kept) for all rows of docs, with the stored blocks and buckets.

    trusted_ids: ids (column doc_id) of trusted documents.  The model is trained on all of them but one in ``folds`` (by a hash
    of the id); the ones left out are new to it as other documents are, and the ``quantile`` of their perplexities in a
    language is the language's bound, times 1 + slack where they are too few to tell the quantile from their greatest (under
    1 / (1 - quantile)).
    A document without text, or in a language without trusted text, has no perplexity and is kept; a null language is a
    language of its own, and so is the empty name.  Rows that share an id, or all, are judged each by its own text; a perplexity
    equal to the bound is kept; null ids are judged but never trusted.  A text of any length is one row of a block and scored
    whole.  An empty table gives no rows.  Further columns are ignored, whatever their names.
    The blocks stay until B.release.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    stored, buckets = B.write_blocks(scratch, docs, text_col)
    shards = shards or B.shards_for(stored)
    ids = trusted_ids.where("doc_id is not null").select("doc_id").distinct()
    columns = tuple(docs.columns.index(c) for c in (id_col, text_col, lang_col))
    with B.batch_rows(spark, 4):
        index = scratch.save(B.index(stored, columns[0]), "index")
    rows = index.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(folds)) > 0).join(ids, "doc_id", "left_semi").select("blk", "row")
    model = train(scratch, B.join_blocks(stored, buckets, rows), columns, order)
    per = perplexities(scratch, stored, buckets, model, order, columns, shards)
    held = per.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(folds)) == 0).join(ids, "doc_id", "left_semi")
    margin = F.when(F.count("perplexity") * (1 - quantile) < 1, 1 + slack).otherwise(1.0)
    bound = held.groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10000) * margin).alias("bound"))
    per = per.join(F.broadcast(bound), "lang", "left")  # a row for each language
    lang = F.when(F.col("lang") != "-", F.expr("substring(lang, 2)"))
    per = scratch.save(per.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("bound"), F.lit(True))).withColumn("lang", lang), "verdicts")
    return per, stored, buckets


def kept_documents(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    per, stored, buckets = classify(docs, trusted_ids, **options)
    scratch = Scratch(docs.sparkSession, "kept")

    def pick(batches):
        for rows in batches:
            for blob, msgs in zip(rows.column(1), rows.column(2)):
                if msgs.is_valid:
                    out = sorted(m["row"].as_py() for m in msgs.values)
                    yield unpacked(blob.as_py()).take(pa.array(out))

    unpacked = B.unpack
    with B.batch_rows(docs.sparkSession, 4):
        out = scratch.save(B.join_blocks(stored, buckets, per.where("kept").select("blk", "row")).mapInArrow(pick, docs.schema), "kept")
    B.release(stored)
    return out
