"""Language identification of mixed-language text.

Scripts narrow the candidates: a language may be given to a word only if the word's script makes up at least
SCRIPT_SHARE of the language's training words.  Within the candidates a word's score is the log likelihood of its character
n-grams (1 to 4, with word edges) under the language, smoothed, less the best candidate's, and at least -CLIP.
Viterbi then labels the sequence of words with a penalty for each change of language; the spans are its runs.
A document's language is the one with most letters in its spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import mix64

BUCKETS = 1 << 16
ORDERS = 4
SCRIPT_SHARE = 0.02
CLIP = 8.0
PENALTY = 6.0
#: Documents of one language that the model is fitted on, about: a hash of the id picks them.
SAMPLE = 2000
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: First code points of the blocks in which letters are told apart by script; the last block of each row goes to the next row's start.
SCRIPTS = ((0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"))
_LOWS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({b for _, b in SCRIPTS})
_OF = np.array([_NAMES.index(b) for _, b in SCRIPTS])


def words_of(text: str) -> list[str]:
    """Words in lower case, found in the text as it is (lower case may be longer, and move what follows)."""
    return [w.lower() for w in WORDS.findall(text)]


def scripts(words: list[str]) -> np.ndarray:
    """Index of the script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _OF[np.searchsorted(_LOWS, first, side="right") - 1]


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the words, and the word that each belongs to."""
    text = "".join(f"\x02{w}\x03" for w in words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    h, out, own = np.zeros(len(cp), np.uint64), [], []
    with np.errstate(over="ignore"):
        base = mix64(cp)
        for n in range(1, ORDERS + 1):
            if n == 1:
                h = base
                ok = np.ones(len(cp), bool)
            else:
                if len(cp) < n:
                    break
                h = h[: len(cp) - n + 1] * np.uint64(0x5851F42D4C957F2D) + base[n - 1 :]
                ok = owner[n - 1 :] == owner[: len(cp) - n + 1]
            out.append((mix64(h[ok] + np.uint64(n)) >> np.uint64(48)).astype(np.int64))
            own.append(owner[: len(h)][ok])
    return np.concatenate(out), np.concatenate(own)


class Model:
    """Log probabilities of the hash buckets (BUCKETS x languages) and the scripts that each language may have: a fixed size per language."""

    def __init__(self, langs: list[str], counts: np.ndarray, script_counts: np.ndarray):
        self.langs = langs
        total = counts.sum(axis=0, keepdims=True)
        self.logp = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32)
        share = script_counts / np.maximum(1, script_counts.sum(axis=0, keepdims=True))
        self.allowed = share >= SCRIPT_SHARE  # scripts x languages
        self.allowed[~self.allowed.any(axis=1)] = True  # a script that no language has narrows nothing

    def scores(self, words: list[str]) -> np.ndarray:
        b, own = gram_buckets(words)
        s = np.empty((len(words), len(self.langs)), np.float32)
        for j in range(len(self.langs)):
            s[:, j] = np.bincount(own, weights=self.logp[b, j], minlength=len(words))
        ok = self.allowed[scripts(words)]
        s = np.where(ok, s, -np.inf)
        s -= s.max(axis=1, keepdims=True)
        return np.where(ok, np.maximum(s, -CLIP), -4 * CLIP).astype(np.float32)


def viterbi(scores: np.ndarray, starts: np.ndarray, lens: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of many sequences at once (rows starts .. starts + lens of scores); all advance by one word a step, the
    longest first, so a step works on those that still have words."""
    labels = np.zeros(len(scores), np.int16)
    by = np.argsort(-lens, kind="stable")
    starts, lens = starts[by], lens[by]
    n_lang = scores.shape[1]
    if not len(lens) or n_lang == 1:
        return labels
    steps = int(lens[0])
    alive = np.searchsorted(-lens, -np.arange(steps), side="left")  # sequences longer than t
    stay = np.empty(scores.shape, bool)
    jump = np.empty(len(scores), np.int16)
    now = scores[starts].copy()
    for t in range(1, steps):
        a = alive[t]
        prev = now[:a]
        best = prev.argmax(axis=1)
        top = prev[np.arange(a), best][:, None] - penalty
        at = starts[:a] + t
        stay[at] = prev >= top
        jump[at] = best
        now[:a] = np.maximum(prev, top) + scores[at]
        now[:a] -= now[:a].max(axis=1, keepdims=True)
    state = now.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        at = starts[:a] + t
        labels[at] = state[:a]
        if t:
            keep = stay[at, state[:a]]
            state[:a] = np.where(keep, state[:a], jump[at])
    return labels


def label_texts(model: Model, texts: list[str | None], penalty: float = PENALTY, spans: bool = False):
    """(language, score, spans or None) for each text.  The score is the share of the text's letters in the language, times the
    chance of the language against the runner-up, by their mean scores a word over all words."""
    out: list = [("und", 0.0, [] if spans else None)] * len(texts)
    words = [words_of(t) if t else [] for t in texts]
    has = [i for i, w in enumerate(words) if w]
    if not has or not model.langs:
        return out
    index: dict[str, int] = {}
    ids = np.concatenate([np.fromiter((index.setdefault(w, len(index)) for w in words[i]), np.int32, len(words[i])) for i in has])
    unique = list(index)
    score_of = model.scores(unique)
    letters = np.fromiter(map(len, unique), np.int64, len(unique))
    scores = score_of[ids]
    lens = np.array([len(words[i]) for i in has])
    starts = np.cumsum(lens) - lens
    labels = viterbi(scores, starts, lens, penalty)
    weight = letters[ids]
    sums = np.add.reduceat(scores, starts, axis=0)
    n_lang = len(model.langs)
    doc = np.repeat(np.arange(len(has)), lens)
    share = np.bincount(doc * n_lang + labels, weights=weight, minlength=len(has) * n_lang).reshape(len(has), n_lang)
    for k, i in enumerate(has):
        best = int(share[k].argmax())
        part = float(share[k, best] / share[k].sum())
        others = np.delete(sums[k], best)
        gap = float(sums[k, best] - others.max()) / max(1.0, lens[k] ** 0.5) if len(others) else 50.0
        sure = 1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, gap))))
        runs = None
        if spans:
            at = [m.span() for m in WORDS.finditer(texts[i])]
            lab = labels[starts[k] : starts[k] + lens[k]]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(lab)) + 1, [len(lab)]])
            runs = [(at[a][0], at[b - 1][1], model.langs[lab[a]]) for a, b in zip(cut[:-1], cut[1:])]
        out[i] = (model.langs[best], part * sure, runs)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows (doc_id, text, lang), of each language about ``sample`` (all if it has fewer), picked by a hash of the
    id, so on whole texts.  Bucket counts are summed within tasks and then over them; a language is one row of fixed size.
    More than 1000 labels raise a ValueError: the model holds 256 kB a language in every task."""
    known = docs.where("lang is not null and text is not null")
    per = known.groupBy("lang").count().limit(1001).collect()  # one row a language
    if len(per) > 1000:
        raise ValueError("more than 1000 languages")
    span = 1 << 40
    rate = {r["lang"]: min(span, int(span * sample / r["count"]) + 1) for r in per}
    if not rate:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(_NAMES), 0)))
    limit = F.broadcast(docs.sparkSession.createDataFrame(list(rate.items()), "lang string, rate long"))
    picked = known.join(limit, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(span)) < F.col("rate")).select("lang", "text")

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words_of(text.as_py())
                if w:
                    c, s = held.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(_NAMES), np.int64)))
                    c += np.bincount(gram_buckets(w)[0], minlength=BUCKETS)
                    s += np.bincount(scripts(w), minlength=len(_NAMES))
        for lang, (c, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.tobytes()]), pa.array([s.tobytes()])], ["lang", "c", "s"])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        add = lambda col: sum(np.frombuffer(x, np.int64) for x in frame[col]).tobytes()
        return pd.DataFrame({"lang": frame["lang"][:1], "c": [add("c")], "s": [add("s")]})

    schema = "lang string, c binary, s binary"
    # A row from each task and language, half a MB each: summed in two steps, first in small groups of tasks.
    parts = picked.mapInArrow(count, schema).withColumn("g", F.pmod(F.xxhash64("c"), F.lit(64)))
    some = parts.groupBy("lang", "g").applyInPandas(lambda f: total(f[["lang", "c", "s"]]), schema)
    got = sorted((r["lang"], r["c"], r["s"]) for r in some.groupBy("lang").applyInPandas(total, schema).collect())  # one row of fixed size a language
    stack = lambda k: np.stack([np.frombuffer(r[k], np.int64) for r in got], axis=1)
    return Model([r[0] for r in got], stack(1), stack(2)) if got else Model([], np.zeros((BUCKETS, 0)), np.zeros((len(_NAMES), 0)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, and with ``spans`` an array of (start, end, lang) in code points of the text.

    Null texts and texts without a letter are 'und' with score 0; so is everything under a model without languages.  The
    whole text counts, however long (a task holds one text and its words).  Ties between languages go to the first by code point.
    One row for each input row, repeated ones too; further columns are ignored, whatever their names; null ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 kB a language
    kind = "doc_id long, lang_pred string, score double" + (", spans array<struct<start long, end long, lang string>>" if spans else "")

    def run(batches):
        m = shared.value
        for batch in batches:
            texts, got, held, size = batch.column(1), [], [], 0
            for t in texts:
                held.append(t.as_py())
                size += len(held[-1] or "")
                if size > 3_000_000:
                    got += label_texts(m, held, penalty, spans)
                    held, size = [], 0
            got += label_texts(m, held, penalty, spans)
            cols = [batch.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())]
            if spans:
                cols.append(pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in g[2]] for g in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score"] + ["spans"] * spans)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)
