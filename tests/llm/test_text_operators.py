"""The operators on documents against brute force, on tables with nulls, empty and long texts, ties, repeated rows and other columns."""

import hashlib
import random

import pytest

from kinfold.llm import blocks, common, fingerprints, kneser_ney, languages, line_runs, mixing, near_duplicates, packing, repeats, unit_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, id string, __c int, n int"


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], None if t is None else len(t), i, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [line(14) for _ in range(6)]
    out = []
    for i in range(150):
        lines = [line(r.randint(1, 12)) for _ in range(r.randint(1, 7))]
        if r.random() < 0.5:
            k = r.randint(0, 4)
            at = r.randint(0, len(lines))
            lines[at:at] = shared[k : k + r.randint(1, 3)]
        out.append("\n".join(lines))
    out += [out[3], out[3], None, "", "   \n\t", "\n\n\n", "ä€𝄞 " * 40, " ".join(words * 60), "a", "Same line of six words here\nSame line of six words here\nSame line of six words here"]
    base = out[0].split()
    for i in range(20):
        t = list(base)
        t[r.randrange(len(t))] = "edit"
        out.append(" ".join(t))
    return out


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(frame(spark, texts)).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a + 1, len(texts)):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert len(got) == len(texts)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)
    assert near_duplicates.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    odd = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(spark.createDataFrame([(None, texts[0]), (5, texts[0]), (5, texts[0])], "doc_id long, text string")).collect()}
    assert odd == {(None, None, True), (5, 5, True)}


def test_repeats(spark, texts):
    pool = [*texts, texts[5] + texts[6], texts[6][20:] + texts[5][10:], "ab" * 200, "ab" * 150]
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, pool), shards=3).collect()}
    seen: set = set()
    for i, t in enumerate(pool):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), set()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            own.add(w)
            if w in seen:
                gone[p : p + 50] = b"\1" * 50
        seen |= own
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        assert sum(s.length for s in got[i].spans) == sum(gone)
    assert repeats.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    odd = repeats.remove_repeats(spark.createDataFrame([(None, "z" * 80), (1, "z" * 80), (1, "z" * 80), (2, "z" * 80)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in odd) == [("1", 0), ("1", 0), ("2", 80), ("None", 0)]


def test_interval_tree():
    strings = [b"xx" + b"repeat of some length that goes on and on for a while, yes" + b"a", b"yy" + b"repeat of some length that goes on and on for a while, yes" + b"b", b"zrepeat of some length that goes on and on for a while, ye!"]
    which, start, tree = repeats.interval_tree(strings, repeats.np.array([3, 1, 2]), 50)
    members = [{(int(which[i]), int(start[i])) for i in range(a, b + 1)} for a, b, _, _ in tree]
    assert {(2, 1), (0, 2), (1, 2)} in members and {(0, 2), (1, 2)} in members
    assert all(m in ({(2, 1), (0, 2), (1, 2)}, {(0, 2), (1, 2)}) for m in members)  # shorter ones are preceded by one byte everywhere


def brute_runs(texts, m):
    first, out = {}, {}
    for i, t in enumerate(texts):
        if t is None:
            out[i] = None
            continue
        lines, gone = t.split("\n"), set()
        for j in range(len(lines) - m + 1):
            k = tuple(lines[j : j + m])
            if k in first:
                gone |= set(range(j, j + m))
            else:
                first[k] = (i, j)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


@pytest.mark.parametrize("m", [1, 2, 4])
def test_line_runs(spark, texts, m):
    df = frame(spark, texts)
    rows = line_runs.drop_repeated_runs(df, min_lines=m).collect()
    want = brute_runs(texts, m)
    assert {r.doc_id: r.text for r in rows} == want
    for r in rows:
        assert r["__lines"] - r["__removed"] == (0 if r.text is None or (not r.text and r["__removed"] == r["__lines"]) else r.text.count("\n") + 1)
    if m == 2:
        assert line_runs.drop_repeated_runs(spark.createDataFrame([], EMPTY)).count() == 0
        twice = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, "a\nb")], "doc_id long, text string")
        assert sorted((str(r.doc_id), r.text) for r in line_runs.drop_repeated_runs(twice).collect()) == [("1", "a\nb"), ("1", "a\nb"), ("2", ""), ("None", "a\nb")]


@pytest.mark.parametrize(("level", "least"), [("sentences", 8), ("lines", 5), ("paragraphs", 5)])
def test_units(spark, texts, level, least):
    """Against a plain scan: white space runs that end a unit, first occurrences kept."""
    import re

    r = random.Random(11)
    passage = " ".join(f"p{i}" + "." * (i % 11 == 10) for i in range(60))
    pool = [*texts, *(f"{' '.join(r.choices('abc', k=9))} {passage} {' '.join(r.choices('abc', k=9))}" for _ in range(30)), " lead. " + passage + "\n\n" + passage + " \n", "One two three four five six seven eight! " * 3]
    seen, want = set(), {}
    for i, t in enumerate(pool):
        found, at = [], 0  # (start, end) of units: words joined while the white space between does not end one
        words = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", t or "")]
        for a, b in words:
            white = t[at:a]
            ends = white.count("\n") >= (2 if level == "paragraphs" else 1) or (level == "sentences" and white and t[at - 1 : at] in tuple(".!?"))
            if found and not ends:
                found[-1][1] = b
            else:
                found.append([a, b])
            at = b
        gone = set()
        for k, (a, b) in enumerate(found):
            w = tuple(t[a:b].encode().lower().split())
            if len(w) >= least and w in seen:
                gone.add(k)
            seen.add(w)
        kept = [k for k in range(len(found)) if k not in gone]
        text = "".join((t[found[k - 1][1] : found[k][0]] if n else "") + t[found[k][0] : found[k][1]] for n, k in enumerate(kept)) if gone else t
        want[i] = (text, len(found), [(found[k][0], found[k][1] - found[k][0]) for k in sorted(gone)])
    rows = unit_dedup.remove_repeated_units(frame(spark, pool), level=level, min_words=least).collect()
    assert {r.doc_id: (r.text, r["__units"], [(s.start, s.length) for s in r["__spans"]]) for r in rows} == want
    assert level != "sentences" or sum(len(want[i][2]) >= 3 for i in range(len(texts), len(texts) + 30)) >= 29
    assert unit_dedup.remove_repeated_units(spark.createDataFrame([], EMPTY)).count() == 0
    same = "a b c d e f g h"
    odd = [(None, same), (3, same), (3, same), (4, same), (4, "x"), (None, None), (5, None), (6, "")]
    got = unit_dedup.remove_repeated_units(spark.createDataFrame(odd, "doc_id long, text string"), level=level, min_words=least).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [(None, same), (3, same), (3, same), (4, ""), (4, "x"), (None, None), (5, None), (6, "")]))


def test_fingerprints(spark, texts):
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, texts)).collect()}
    order = list(range(len(texts)))[::-1]
    off = []
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(t) // 3
        new = t[: len(t) - cut] + nxt[:cut]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = (set(common.shingles(x).tolist()) for x in (t, new, nxt))
        for got, x in ((rows[i].near_edited, b), (rows[i].near_next, c)):
            off.append(got - (len(a & x) / len(a | x) if a | x else 1.0))
            assert 0 <= got <= 1
    assert abs(sum(off) / len(off)) < 0.02 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.08
    assert rows[3].fingerprint == rows[150].fingerprint and len(rows[3].fingerprint) == 256
    assert fingerprints.edited_fingerprints(spark.createDataFrame([], EMPTY)).count() == 0
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    many = spark.createDataFrame([(i // 2, f"t{i} a b c d e") for i in range(9000)] + [(None, "n")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(many).count() == 9001


def test_languages(spark):
    r = random.Random(2)
    vocab = {"en": "the and of to in is that with for was are this from have not".split(), "de": "der die und das nicht mit ist ein auf für sich dem auch".split(), "ru": "и в не на что как это по из но они мы".split()}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(r.randint(5, 60))), k) for i in range(300) for k in [list(vocab)[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !!", "en"), (None, "the and of", None)], "doc_id long, text string, lang string")
    model = languages.fit(df.where("doc_id % 2 = 0"))
    got = {x.doc_id: x for x in languages.identify(df, model, spans=True).collect()}
    held = [i for i, *_ in rows if i % 2]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.99 * len(held)
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred, got[None].lang_pred) == ("und", 0.0, "und", "en")
    mixed = "the and of to in is that и в не на что как это по der die und das nicht mit ist ein auf"
    label, score, spans = languages.label_texts(model, [mixed], spans=True)[0]
    assert [s[2] for s in spans] == ["en", "ru", "de"] and mixed[spans[1][0] : spans[1][1]].startswith("и в") and 0 <= score <= 1
    assert languages.identify(df, languages.fit(df.limit(0))).where("lang_pred <> 'und'").isEmpty()


def test_viterbi_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        lens = rng.integers(1, 7, 4)
        scores = rng.normal(0, 3, (int(lens.sum()), 3)).astype(np.float32)
        starts = np.cumsum(lens) - lens
        got = languages.viterbi(scores, starts, lens, 2.0)
        for s, n in zip(starts, lens):
            value = lambda path, s=s: sum(scores[s + i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
            best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
            assert abs(value(got[s : s + n].tolist()) - best) < 1e-3


def test_best_fit(spark, texts):
    df = frame(spark, texts)
    rows = packing.pack(df, capacities=(16, 64, 128), shard_rows=40).collect()
    n = {i: len((t or "").split()) for i, t in enumerate(texts)}
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        bins.setdefault((r.shard, r["bin"]), []).append(r)
    assert {i for i in n if n[i]} == set(pieces)
    for i, p in pieces.items():
        assert [x[1] for x in sorted(p)] == list(range(0, n[i], 128)) and sum(x[2] for x in p) == n[i]
    for b in bins.values():
        used, at = sum(r.length for r in b), 0
        assert {r.capacity for r in b} == {min(c for c in (16, 64, 128) if c >= used)}
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert sum(r.length for r in rows) / sum(b[0].capacity for b in bins.values()) > 0.9
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0


def test_targets():
    t = mixing.targets({"a": 100, "b": 10, "c": 50, None: 40})
    assert abs(sum(t.values()) - 200) < 1e-9 and t["b"] == 30 and all(t[s] <= 3 * {"a": 100, "b": 10, "c": 50, None: 40}[s] + 1e-9 for s in t)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.permute(mixing.np.arange(n), n, 5).tolist()) == list(range(n))
    counts = mixing.np.array([50, 0, 130, 20])
    total, at = 0, mixing.np.zeros(4, int)
    for k in range(7):
        now, before = mixing.shard_counts(counts, 7, 30, k, 3)
        assert (before == at).all() and now.sum() == min(30, 200 - 30 * k)
        at = at + now
    assert (at == counts).all()


def test_mix(spark, texts):
    df = frame(spark, texts)
    rows, pieces = mixing.mix(df, block=8, slots_per_shard=50)
    rows = rows.collect()
    again = mixing.mix(df.repartition(3), block=8, slots_per_shard=50)[0].collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(texts)
    n = {i: len((t or "").split()) for i, t in enumerate(texts)}
    by: dict = {}
    for r in rows:
        assert r.size == n[r.doc_id] and 0 <= r.taken <= 3 * r.size
        x = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        x[0] += r.taken
        x[3] += r.size
    goal = mixing.targets({s: x[3] for s, x in by.items()})
    for s, (taken, target, size, _) in by.items():
        assert abs(target - goal[s]) < 1e-6 and size == by[s][3] and abs(taken - target) < 0.02 * target + 16
    docs = mixing.mixed_documents(df, block=8, slots_per_shard=50).collect()
    words: dict = {}
    for d in docs:
        assert d.n_chars == len(d.text)
        words[d.doc_id] = words.get(d.doc_id, 0) + len(d.text.split())
        assert set(d.text.split()) <= set(texts[d.doc_id].split())
    assert words == {r.doc_id: r.taken for r in rows if r.taken}
    assert mixing.mix(spark.createDataFrame([], EMPTY))[0].count() == 0


def test_kneser_ney_counts(spark):
    """Probabilities by hand: every context's sum to one, and the perplexity of a text is that of its symbols."""
    import math

    docs = ["abab abc", "abd abab", "cab dab", "b", "abc abd"] * 3
    df = spark.createDataFrame([(i, t, "x" if i % 4 else "y", "s", 0) for i, t in enumerate([*docs, "zzz", "", None])], EMPTY)
    ids = spark.createDataFrame([(i,) for i in range(len(docs))] + [(None,)], "doc_id long")
    scratch = common.Scratch(spark, "t")
    stored, buckets = blocks.write_blocks(scratch, df)
    rows = blocks.index(stored, 0).join(ids, "doc_id", "left_semi").select("blk", "row")
    order = 3
    model = kneser_ney.train(scratch, blocks.join_blocks(stored, buckets, rows), (0, 1, 2), order).collect()
    p = {(r.lang, r.k, r.code): (r.logp, r.logw) for r in model}
    for lang in ("+x", "+y"):
        for k in range(1, order + 1):
            sums: dict = {}
            for (g, kk, code), (lp, _) in p.items():
                if (g, kk) == (lang, k) and lp is not None:  # contexts of padding only have no probability
                    sums[code >> 16] = sums.get(code >> 16, 0) + math.exp(lp)
            assert all(0 < s <= 1 + 1e-9 for s in sums.values())
    assert abs(sum(math.exp(v[0]) for (g, k, _), v in p.items() if (g, k) == ("+x", 1) and v[0] is not None) + math.exp(p["+x", 0, 0][0]) - 1) < 1e-9

    def logp(lang, seq):
        if not seq:
            return p[lang, 0, 0][0]
        code = 0
        for s in seq:
            code = (code << 16) | s
        if (lang, len(seq), code) in p and p[lang, len(seq), code][0] is not None:
            return p[lang, len(seq), code][0]
        w = p.get((lang, len(seq) - 1, code >> 16), (None, 0.0))[1] if len(seq) > 1 else 0.0
        return w + logp(lang, seq[1:])

    got = {r.doc_id: r for r in kneser_ney.perplexities(scratch, stored, buckets, spark.createDataFrame(model, "lang string, k int, code long, logp double, logw double"), order, (0, 1, 2), 5).collect()}
    for i, t in enumerate([*docs, "zzz"]):
        lang = "+x" if i % 4 else "+y"
        seq = [kneser_ney.BOS, kneser_ney.BOS, *map(ord, t), kneser_ney.EOS]
        want = math.exp(-sum(logp(lang, seq[j - 2 : j + 1]) for j in range(2, len(seq))) / (len(t) + 1))
        assert abs(got[i].perplexity - want) < 1e-3 * want
    assert got[len(docs) + 1].perplexity is None and got[len(docs) + 2].perplexity is None


def test_quality(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "and", "river", "house", "walks", "green"]) for _ in range(40))
    junk = lambda: " ".join("".join(r.choice("!#%&$xq") for _ in range(5)) for _ in range(40))
    rows = [(i, junk() if i % 10 == 0 else good(), "en", "s", 0) for i in range(400)] + [(1000, None, "en", "s", 0), (1001, "", None, None, None), (None, good(), "en", "s", 0), (1002, "übrig", "de", "s", 5)]
    df = spark.createDataFrame(rows, EMPTY)
    ids = spark.createDataFrame([(i,) for i in range(200) if i % 10], "doc_id long")
    kept = kneser_ney.kept_documents(df, ids)
    assert kept.columns == df.columns
    have = {x.doc_id for x in kept.collect()}
    assert not have & set(range(0, 400, 10)) and {1000, 1001, 1002, None} <= have and len(have) >= 0.97 * 360
    assert kneser_ney.kept_documents(df.limit(0), ids).count() == 0
    assert kneser_ney.kept_documents(df, ids.limit(0)).count() == len(rows)


def test_symbols_and_languages_stay_apart(spark):
    """Marks, characters beyond U+FFFF and control characters are different symbols; null and the empty name are two languages."""
    s = kneser_ney.symbols("\x01\x02a\U00010001\U0001f600\U0001f602\ufffd")
    assert len(set(s.tolist())) == 7 and not {kneser_ney.BOS, kneser_ney.EOS} & set(s.tolist()) and s[2] == 97
    rows = [(i, "alpha beta gamma " * 3, None) for i in range(40)] + [(100 + i, "zulu yankee xray " * 3, "") for i in range(40)] + [(200, "alpha beta gamma " * 3, ""), (201, "zulu yankee xray " * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    per, stored, _ = kneser_ney.classify(df, df.where("doc_id < 200").select("doc_id"))
    got = {r.doc_id: (r.lang, r.kept) for r in per.collect()}
    blocks.release(stored)
    assert got[0] == (None, True) and got[100] == ("", True) and got[200] == ("", False) and got[201] == (None, False)


def test_counts_and_discounts_against_plain_kneser_ney(spark):
    """Counts of continuation, the three discounts and all probabilities, worked out here from the strings alone."""
    from collections import Counter, defaultdict

    r = random.Random(5)
    docs = ["".join(r.choice("aaabbcd ") for _ in range(r.randint(5, 60))) for _ in range(60)]
    order = 3
    df = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate(docs)], EMPTY)
    scratch = common.Scratch(spark, "t")
    stored, buckets = blocks.write_blocks(scratch, df)
    model = kneser_ney.train(scratch, blocks.join_blocks(stored, buckets, blocks.index(stored, 0).select("blk", "row")), (0, 1, 2), order).collect()
    got = {(m.k, m.code): m.logp for m in model if m.logp is not None}
    counts = {order: Counter()}
    for t in docs:
        s = [kneser_ney.BOS] * (order - 1) + [ord(c) for c in t] + [kneser_ney.EOS]
        counts[order].update(tuple(s[j : j + order]) for j in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    prob: dict = {}
    for k in range(1, order + 1):
        n = [sum(c == i for c in counts[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        d = [0.0] + [i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[1] else -1 for i in (1, 2, 3)]
        d = [0.0] + [d[i] if 0.05 < d[i] < i else (0.5, 1.0, 1.5)[i - 1] for i in (1, 2, 3)]
        total, cut, kinds = defaultdict(int), defaultdict(float), defaultdict(int)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            cut[g[:-1]] += d[min(c, 3)]
            kinds[g[:-1]] += 1
        for g, c in counts[k].items():
            h = g[:-1]
            low = prob[g[1:]] if k > 1 else 1 / (kinds[h] + 1)
            prob[g] = (c - d[min(c, 3)]) / total[h] + cut[h] / total[h] * low
    code = lambda g: sum(x << 16 * (len(g) - 1 - i) for i, x in enumerate(g))
    wrap = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    import math

    assert {(len(g), wrap(code(g))) for g in prob} == {k for k in got if k[0]}
    for g, p in prob.items():
        assert abs(math.exp(got[len(g), wrap(code(g))]) - p) < 1e-9
    blocks.release(stored)


def test_ids_beside_nulls(spark):
    """A null among large ids leaves their last digits alone."""
    big = [9007199254740993, 1152921504606846979]
    df = spark.createDataFrame([(big[0], "a b c d"), (None, "e f g"), (big[1], "h i j k l")], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack(df).collect()} == {*big, None}
    docs = df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(char_length(text) as long) as n_chars")
    assert {r.doc_id for r in mixing.mixed_documents(docs, block=2).collect()} == {*big, None}


def test_mix_with_one_id_in_two_sources(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(10)), "s1"), (1, " ".join(f"b{i}" for i in range(12)), "s2"), (1, " ".join(f"b{i}" for i in range(12)), "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.source: r for r in mixing.mix(df, block=1)[0].collect()}
    assert len(out) == 3
    for s in out:
        assert abs(out[s].taken - out[s].target) <= 1 and out[s].taken <= 3 * out[s].size
    got: dict = {}
    for r in mixing.mixed_documents(df, block=1).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {s: r.taken for s, r in out.items()}


def test_hypergeometric_beyond_numpy():
    """Exact draws where numpy's sampler ends: mean and variance, bounds, and the same law as numpy's where both work."""
    rng = mixing.np.random.default_rng(3)
    good, bad, take = 3 * 10**10, 7 * 10**10, 10**9
    x = [mixing.hypergeometric(rng, good, bad, take) for _ in range(400)]
    var = take * 0.3 * 0.7 * (1 - take / (good + bad))
    assert abs(sum(x) / 400 - 0.3 * take) < 5 * (var / 400) ** 0.5
    assert 0.7 < (sum((v - 0.3 * take) ** 2 for v in x) / 400) / var < 1.4
    assert mixing.hypergeometric(rng, 5, 2 * 10**9, 2 * 10**9 + 5) == 5 and mixing.hypergeometric(rng, 5, 2 * 10**9, 0) == 0
    assert sum(mixing.hypergeometric(rng, 10**9, 10**9, 8) for _ in range(500)) / 500 == pytest.approx(4, abs=0.4)


def test_packing_is_joint():
    """Total cost below that of the best single capacity on three mixes of sizes, and near the optimum on tiny ones."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(8)
    mixes = [rng.integers(1, 4097, 3000), np.concatenate([rng.integers(3000, 4000, 200), rng.integers(900, 1000, 600)]), np.concatenate([rng.integers(1980, 2049, 400), rng.integers(3900, 4097, 200), rng.integers(480, 513, 500)])]
    total = lambda caps: float(sum(packing.cost(int(c)) for c in caps))
    for sizes in mixes:
        sizes = np.sort(sizes)[::-1]
        joint = total(packing.best_fit(sizes)[2])
        singles = []
        for c in packing.CAPACITIES:
            pieces = np.sort(np.concatenate([np.minimum(c, sizes - k * c)[sizes > k * c] for k in range(-(-int(sizes.max()) // c))]))[::-1]
            singles.append(len(packing.best_fit(pieces, (c,))[2]) * packing.cost(c))
        whole = [x for c, x in zip(packing.CAPACITIES, singles) if c >= sizes.max()]
        assert joint < min(whole)
    for _ in range(30):
        caps = (8, 16, 32)
        sizes = np.sort(rng.integers(1, 33, 6))[::-1]
        price = lambda c: c + 2 + c * c / 256
        best = float("inf")
        for label in itertools.product(range(6), repeat=6):
            if all(x <= max(label[:i], default=-1) + 1 for i, x in enumerate(label)):
                used = [sum(int(s) for s, x in zip(sizes, label) if x == b) for b in range(max(label) + 1)]
                if max(used) <= 32:
                    best = min(best, sum(price(min(c for c in caps if c >= u)) for u in used))
        bins, offset, final = packing.best_fit(sizes, caps, price)
        got = sum(price(int(c)) for c in final)
        assert best <= got + 1e-9 <= 1.35 * best


def test_spans_keep_to_the_original(spark):
    """Lower case of U+0130 is two code points; spans are in those of the text."""
    model = languages.fit(spark.createDataFrame([(i, "the and of to in is that" if i % 2 else "и в не на что как это", "en" if i % 2 else "ru") for i in range(40)], "doc_id long, text string, lang string"))
    text = "\u0130\u0130\u0130\u0130 the and of to и в не на что"
    _, _, spans = languages.label_texts(model, [text], spans=True)[0]
    assert [text[a:b] for a, b, _ in spans] == ["\u0130\u0130\u0130\u0130 the and of to", "и в не на что"]


def test_texts_over_a_mebibyte(spark):
    """Chunks of word hashing, several blocks and long texts beside short ones."""
    import numpy as np

    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(260_000)]
    long = " ".join(words)
    assert len(long) > 1 << 20 and len(common.word_hashes(long.encode())) == len(words)
    tail = common.word_hashes(" ".join(words[-50:]).encode())
    assert (common.word_hashes(long.encode())[-50:] == tail).all()
    one = ("x" * 1_200_000).encode()
    assert len(common.word_hashes(one + b" y " + one)) == 3
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long + " end", "en", "a", len(long) + 4), (3, "w1 w2 w3 w4 w5 w6 w7 w8", "en", "b", 23), (4, "\n".join([long] * 2), "en", None, 0)], EMPTY)
    got = {x.doc_id: x for x in near_duplicates.near_duplicates(docs).collect()}
    assert got[2].component_id == 1 and got[3].kept and got[1].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    gone = {x.doc_id: x for x in repeats.remove_repeats(docs).collect()}
    assert gone[1].n_removed == 0 and gone[2].n_removed >= len(long) and gone[4].n_removed >= 2 * len(long) - 100
    n = {x.doc_id: x["__removed"] for x in unit_dedup.remove_repeated_units(docs).collect()}
    assert n == {1: 0, 2: 0, 3: 0, 4: 2}
    lines = {x.doc_id: x["__removed"] for x in line_runs.drop_repeated_runs(docs, long_words=50).collect()}
    assert lines == {1: 0, 2: 0, 3: 0, 4: 2}
    assert sum(x.length for x in packing.pack(docs).collect()) == sum(len(t.split()) for t in (long, long + " end", "w1 w2 w3 w4 w5 w6 w7 w8", long, long))
    taken = mixing.mix(docs)[0].collect()
    assert all(x.taken <= 3 * x.size for x in taken) and sum(x.taken for x in taken) == pytest.approx(sum(x.size for x in taken), rel=0.02)
    assert {x.doc_id: x.lang_pred for x in languages.identify(docs, languages.fit(docs)).collect()} == dict.fromkeys((1, 2, 3, 4), "en")
    prints = {x.doc_id: x for x in fingerprints.edited_fingerprints(docs).collect()}
    # The next document by falling id is nearly the same; the edited text lacks its last third.
    assert prints[2].near_next > 0.9 and 0.5 < prints[2].near_edited < 0.85 and prints[1].n_chars == len(long)
    per, stored, _ = kneser_ney.classify(docs, docs.select("doc_id"))
    assert {x.doc_id: x.n for x in per.collect()}[1] == len(long) + 1
    blocks.release(stored)
    assert np.isfinite([x.perplexity for x in per.where("perplexity is not null").collect()]).all()


def plans_since(spark, first):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [runs.apply(i).physicalPlanDescription() for i in range(runs.size()) if runs.apply(i).executionId() >= first]


def test_near_duplicates_leave_the_driver_little(spark, texts, tmp_path):
    """No side of a join is broadcast, and rarity comes to the driver as two bytes for each counter, in the order of the counts."""
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    first = 1 + max([-1, *(runs.apply(i).executionId() for i in range(runs.size()))])
    near_duplicates.near_duplicates(frame(spark, texts)).write.parquet(str(tmp_path / "out"))
    plans = plans_since(spark, first)
    assert any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)
    sets = spark.createDataFrame([([h] * n,) for h, n in ((5, 1), (6, 2), (7, 40), (8, 100_000))], "shingles array<long>")
    got = near_duplicates.shingle_counts(sets, 1 << 18)
    assert got.nbytes == 2 << 18 and got[4:8].tolist() == [0, 1, 2, 40] and 1 << 15 < got[8] < (1 << 15) + 2048


def test_suffixes_are_sorted_in_bounded_parts():
    """One phrase in 30,000 different contexts, beside strings of their own: brute force's removals, in a bounded part of memory."""
    import tracemalloc

    r, np = random.Random(11), repeats.np
    hot = r.randbytes(55)
    strings = [r.randbytes(12) + hot + r.randbytes(13) if i % 2 else r.randbytes(80) for i in range(40_000)] + [b"q" * 80, b"p" + b"q" * 79]
    docs = np.array([(i * 7919) % 40_009 for i in range(len(strings))])
    repeats.removals(strings[:2], docs[:2], 50)
    tracemalloc.start()
    which, start, size = repeats.removals(strings, docs, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = {}
    for s, d in zip(strings, docs.tolist()):
        for p in range(len(s) - 49):
            first[s[p : p + 50]] = min(d, first.get(s[p : p + 50], d))
    want = {i: {x for p in range(len(s) - 49) if first[s[p : p + 50]] < d for x in range(p, p + 50)} for i, (s, d) in enumerate(zip(strings, docs.tolist()))}

    def covered(found):
        got = {i: set() for i in want}
        for i, a, n in found:
            got[i] |= set(range(a, a + n))
        return got

    assert covered(zip(which.tolist(), start.tolist(), size.tolist())) == want
    assert peak < 200 << 20
    # As a shard gets them: two senders, tags that keep some strings apart from others, small parts.
    some = list(range(1, 400, 2)) + [40_000, 40_001]
    half = [some[::2], some[1::2]]
    sent = [{"k": np.array(h), "o": docs[h], "n": np.array([len(strings[i]) for i in h]), "t": np.array([i // 40_000 for i in h], np.uint16), "b": np.frombuffer(b"".join(strings[i] for i in h), np.uint8)} for h in half]
    got = [(i, a, n) for _, k, s, z in repeats.shard_removals(sent, 50, most=16) for i, a, n in zip(k.tolist(), s.tolist(), z.tolist())]
    low = min(docs[i] for i in some if i < 40_000)
    got = covered(got)
    assert all(got[i] == set() if docs[i] == low else got[i] >= set(range(12, 67)) for i in some if i < 40_000)
    assert got[40_000] | got[40_001] == want[40_000] | want[40_001]
