"""Local image descriptors that find cropped, resized, turned or edited copies.

Corners are the strongest local maxima of the Harris response in each cell of a grid, at scales a factor of the square root of two apart, so
their number follows the image's area.  Each gets an orientation from the intensity centroid around it and 256 comparisons
of smoothed pixel pairs, turned by that orientation; a comparison counts only beyond a share of the patch's contrast, so
noise in plain areas changes none.

Two images meet in Hamming tables.  A corner alone says little (all corners of plain shapes look alike), so a key stands for a corner
and two of its neighbours: some bits of the three descriptors and where the neighbours lie as the corner sees them.  Further
bits of the three must agree but for SKETCH_BITS, and the neighbours' places to an eighth or so; the join itself tests both.  The queries carry the cost of whatever
moves a key: borders of cells are probed on both sides, and a query is described at half a step of scale and a slight turn as
well.  Image pairs with two such hits are candidates.  For these, all descriptors are compared, each hit proposes a similarity
transform (scale, turn, shift), it is fitted to the matches that agree, and the places that agree are the votes.

Images are binary columns in the portable graymap format (P5, 8 bits).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, mix64

#: Least side of a level of the pyramid, side of a grid cell (a corner each), edge without corners.
LEAST_SIDE, CELL, EDGE = 22, 10, 4
RADIUS, TURNS, MARGIN = 9, 72, 0.2
#: Descriptors match at so many differing bits or less; a copy has so many votes, and this share of the query's places.
MAX_BITS, MIN_VOTES, MIN_SHARE = 30, 8, 0.3
#: Tables, bits of each descriptor in a key, neighbours of a corner (of the images, of the queries), least distance of a neighbour.
TABLES, KEY_BITS, NEAR, NEAR_QUERY, APART = 2, 13, 3, 4, 5
ANGLES, RATIO, BORDER, SKETCH_BITS = 10, 1.35, 0.2, 5
#: Steps of a cell in which the neighbours' places are kept, and steps by which they may differ.
STEPS, SHIFT = 16, 6
#: The query is described as it is, and scaled and turned (degrees) so.
VARIANTS = ((1.0, 0.0), (2**-0.25, 0.0), (1.0, 5.0), (2**-0.25, 20.0), (2**-0.125, 45.0), (2**-0.375, -10.0), (1.0, -30.0))
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("size", "<f4"), ("turn", "<f4"), ("layer", "u1"), ("bits", "u1", 32)])
_RNG = np.random.default_rng(5)
_PAIRS = np.clip(_RNG.normal(0, 3.6, (256, 4)), -RADIUS + 1, RADIUS - 1)
_YY, _XX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_YY**2 + _XX**2 <= RADIUS**2).astype(np.float32)


def _turned() -> np.ndarray:
    out = []
    for k in range(TURNS):
        c, s = np.cos(2 * np.pi * k / TURNS), np.sin(2 * np.pi * k / TURNS)
        y1, x1, y2, x2 = _PAIRS.T
        out.append(np.round(np.stack([s * x1 + c * y1, c * x1 - s * y1, s * x2 + c * y2, c * x2 - s * y2], 1)).astype(np.int64))
    return np.stack(out)


_PATTERN = _turned()


def to_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.clip(a, 0, 255).astype(np.uint8).tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    """The image, or None for null and malformed bytes."""
    try:
        kind, size, top, rest = data.split(b"\n", 3)
        w, h = map(int, size.split())
        if kind != b"P5" or w < 1 or h < 1 or len(rest) < w * h:
            return None
        return np.frombuffer(rest[: w * h], np.uint8).reshape(h, w).astype(np.float32)
    except (AttributeError, ValueError):
        return None


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2 r + 1, edges repeated."""
    p = np.pad(a, r, mode="edge")
    c = np.zeros((p.shape[0] + 1, p.shape[1] + 1))
    c[1:, 1:] = p.cumsum(0).cumsum(1)
    k = 2 * r + 1
    return ((c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]) / (k * k)).astype(np.float32)


def _at(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels; beyond the border the border's."""
    y, x = np.clip(y, 0, a.shape[0] - 1.001), np.clip(x, 0, a.shape[1] - 1.001)
    j, i = y.astype(np.int64), x.astype(np.int64)
    v, u = (y - j).astype(np.float32), (x - i).astype(np.float32)
    return (a[j, i] * (1 - v) + a[j + 1, i] * v) * (1 - u) + (a[j, i + 1] * (1 - v) + a[j + 1, i + 1] * v) * u


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    h, w = max(2, round(a.shape[0] * scale)), max(2, round(a.shape[1] * scale))
    soft = _box(a, max(1, round(0.5 / scale))) if scale < 1 else a
    return _at(soft, ((np.arange(h) + 0.5) / scale - 0.5)[:, None] + np.zeros(w), ((np.arange(w) + 0.5) / scale - 0.5)[None] + np.zeros((h, 1)))


def turned(a: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its middle, in the same frame."""
    t, (h, w) = np.deg2rad(degrees), a.shape
    y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    return _at(a, np.cos(t) * y - np.sin(t) * x + (h - 1) / 2, np.sin(t) * y + np.cos(t) * x + (w - 1) / 2)


def _corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of the strongest local maximum of the Harris response in each cell."""
    gy, gx = np.gradient(a)
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    core = r[1:-1, 1:-1]
    around = np.max([r[1 + dy : r.shape[0] - 1 + dy, 1 + dx : r.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], axis=0)
    high = np.zeros(r.shape, bool)
    high[1:-1, 1:-1] = (core > around) & (core > 10.0)
    high[:EDGE], high[-EDGE:], high[:, :EDGE], high[:, -EDGE:] = False, False, False, False
    y, x = np.nonzero(high)
    cell = (y // CELL) * (a.shape[1] // CELL + 1) + x // CELL
    by = np.lexsort((-r[y, x], cell))
    first = np.ones(len(by), bool)
    first[1:] = cell[by][1:] != cell[by][:-1]
    return y[by[first]], x[by[first]]


def points(image: np.ndarray, variant: int = 0) -> np.ndarray:
    """The corners (POINT) of a variant of the image: place, size and turn in the image's own frame; layer: variant and level."""
    scale, degrees = VARIANTS[variant]
    whole = resized(image, scale) if scale != 1 else turned(image, degrees) if degrees else image
    whole, out, level = _box(whole, 1), [], 0
    while min(whole.shape) * 2 ** (-level / 2) >= LEAST_SIDE and level < 32:
        f = 2 ** (-level / 2)
        a = resized(whole, f) if level else whole
        y, x = _corners(a)
        if len(y):
            p = np.pad(a, RADIUS + 1, mode="edge")
            py, px = y + RADIUS + 1, x + RADIUS + 1
            patch = p[py[:, None, None] + _YY, px[:, None, None] + _XX]
            off = (patch - (patch * _DISC).sum((1, 2), keepdims=True) / _DISC.sum()) * _DISC
            contrast = np.sqrt((off**2).sum((1, 2)) / _DISC.sum())
            turn = np.arctan2((off * _YY).sum((1, 2)), (off * _XX).sum((1, 2)))
            q, soft = _PATTERN[np.round(turn / (2 * np.pi) * TURNS).astype(np.int64) % TURNS], _box(p, 1)
            more = soft[py[:, None] + q[:, :, 2], px[:, None] + q[:, :, 3]] - soft[py[:, None] + q[:, :, 0], px[:, None] + q[:, :, 1]]
            got = np.empty(len(y), POINT)
            z = ((x + 0.5) + 1j * (y + 0.5)) / (f * scale)
            if degrees:  # back into the image's own frame
                mid = (image.shape[1] + 1j * image.shape[0]) / 2
                z, turn = (z - mid) * np.exp(1j * np.deg2rad(degrees)) + mid, turn + np.deg2rad(degrees)
            got["x"], got["y"], got["size"], got["turn"], got["layer"] = z.real, z.imag, f * scale, turn, variant * 32 + level
            got["bits"] = np.packbits(more > MARGIN * contrast[:, None], axis=1)
            out.append(got)
        level += 1
    return np.concatenate(out) if out else np.empty(0, POINT)


def keys(p: np.ndarray, table: int, query: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, sketch, fine, corner) of a table: one for each corner and pair of its neighbours, with ``query`` at both sides of close
    borders.  fine: where the neighbours lie, in STEPS of a cell, a byte for each distance and angle."""
    words = np.ascontiguousarray(p["bits"]).view(">u8").astype(np.uint64).reshape(len(p), 4)
    place, turn = (p["x"] + 1j * p["y"]) * p["size"], p["turn"]
    near, trios = NEAR_QUERY if query else NEAR, [np.empty((0, 3), np.int64)]
    for layer in np.unique(p["layer"]):
        m = np.flatnonzero(p["layer"] == layer)
        if len(m) < 3:
            continue
        z = place[m]
        for lo in range(0, len(m), 1024):  # large images have many corners
            d = np.abs(z[lo : lo + 1024, None] - z[None])
            d[d < APART] = np.inf
            nn = np.argpartition(d, min(near, len(m) - 1), axis=1)[:, : near + 1]
            far = np.take_along_axis(d, nn, 1)
            by = np.lexsort((nn, far), axis=1)[:, :near]
            nn, far = np.take_along_axis(nn, by, 1), np.take_along_axis(far, by, 1)
            for r1, r2 in itertools.combinations(range(nn.shape[1]), 2):
                a = np.flatnonzero(np.isfinite(far[:, r1]) & np.isfinite(far[:, r2]))
                trios.append(np.stack([m[a + lo], m[nn[a, r1]], m[nn[a, r2]]], 1))
    a, b, c = np.concatenate(trios).T
    vb, vc = ((place[x] - place[a]) * np.exp(-1j * turn[a]) for x in (b, c))
    swap = np.angle(vb) > np.angle(vc)
    b, c, vb, vc = np.where(swap, c, b), np.where(swap, b, c), np.where(swap, vc, vb), np.where(swap, vb, vc)
    where = [np.log(np.abs(vb)) / np.log(RATIO), np.log(np.abs(vc)) / np.log(RATIO), np.angle(vb) / (2 * np.pi) * ANGLES, np.angle(vc) / (2 * np.pi) * ANGLES]
    code, sketch = np.full(len(a), table, np.uint64), np.zeros(len(a), np.uint64)
    for x in (a, b, c):
        code = (code << np.uint64(KEY_BITS)) | ((words[x, table // 4] >> np.uint64(64 - KEY_BITS * (table % 4 + 1))) & np.uint64((1 << KEY_BITS) - 1))
        sketch = (sketch << np.uint64(21)) | (words[x, 3] >> np.uint64(43))
    fine = np.zeros(len(a), np.int64)
    for i, g in enumerate(where):
        fine = fine << 8 | np.round(g * STEPS).astype(np.int64) % (ANGLES * STEPS if i > 1 else 256)
    cells = []
    for i, g in enumerate(where):
        n = ANGLES if i > 1 else 64
        cells.append([(np.floor(g + s).astype(np.int64) % n).astype(np.uint64) * np.uint64(64**i) for s in ((-BORDER, BORDER) if query else (0,))])
    key = np.concatenate([mix64(code ^ mix64(sum(x))) for x in itertools.product(*cells)])
    times = len(key) // max(1, len(a))
    sketch, fine, corner = (np.tile(x, times) for x in (sketch, fine, a))
    if query:  # both sides of a border that is not close are one
        _, first = np.unique(key ^ mix64(sketch ^ mix64(fine.astype(np.uint64) ^ mix64(corner.astype(np.uint64)))), return_index=True)
        key, sketch, fine, corner = key[first], sketch[first], fine[first], corner[first]
    return key, sketch, fine, corner


def poses(p: np.ndarray) -> np.ndarray:
    """Place, turn and size of corners as one number each: half pixels (18 bits each), 1024 turns, size to 3 %."""
    x, y = (np.clip(np.round(p[c] * 2.0), 0, (1 << 18) - 1).astype(np.int64) for c in "xy")
    turn = np.round(p["turn"] / (2 * np.pi) * 1024).astype(np.int64) % 1024
    return (((x << 18 | y) << 10 | turn) << 10) | np.clip(np.round((np.log2(p["size"]) + 20) * 25), 0, 1023).astype(np.int64)


def placed(pose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places as complex numbers, turns and sizes of poses."""
    pose = np.asarray(pose, np.int64)
    z = (pose >> 38) / 2 + 1j * ((pose >> 20) & ((1 << 18) - 1)) / 2
    return z, ((pose >> 10) & 1023) / 1024 * 2 * np.pi, 2.0 ** ((pose & 1023) / 25 - 20)


def agreeing(q: np.ndarray, p: np.ndarray) -> int:
    """Hits (poses in the query, poses in the image) at different corners that the transform of one of them explains, at most."""
    z, tq, sq = placed(q)
    w, tp, sp = placed(p)
    turn, size = tp - tq, sq / sp
    along = (np.abs(np.angle(np.exp(1j * (turn[:, None] - turn)))) < 0.4) & (np.abs(np.log(size[:, None] / size)) < 0.5)
    off = np.abs((size * np.exp(1j * turn))[:, None] * (z[None] - z[:, None]) + w[:, None] - w[None])
    along &= off < 6 + 0.3 * size[:, None] * np.abs(z[None] - z[:, None])
    return max(min(_places(z[k]), _places(w[k])) for k in along)


def votes(q: np.ndarray, p: np.ndarray, hits: tuple[np.ndarray, np.ndarray], max_bits: int = MAX_BITS, reach: float = 3.0) -> int:
    """Places of the query q that lie, under one similarity transform, where matching corners of p are.  hits: poses in q and in p
    that propose a transform each."""
    if not len(q) or not len(p):
        return 0
    i, j = _matches(q, p, max_bits)
    z, w = (x["x"].astype(np.float64) + 1j * x["y"].astype(np.float64) for x in (q, p))
    turn, size = p["turn"][j].astype(np.float64) - q["turn"][i], q["size"][i].astype(np.float64) / p["size"][j]
    zi, wj, best = z[i], w[j], 0
    for za, ta, sa, wb, tb, sb in zip(*placed(hits[0]), *placed(hits[1])):
        t, s = tb - ta, sa / sb
        along = (np.abs(np.angle(np.exp(1j * (turn - t)))) < 0.5) & (np.abs(np.log(size / s)) < 0.4)
        ok = along & (np.abs(s * np.exp(1j * t) * (zi - za) + wb - wj) < reach + 0.2 * s * np.abs(zi - za))
        for _ in range(3):
            if ok.sum() < 3:
                break
            zm, wm = zi[ok].mean(), wj[ok].mean()
            spread = (np.abs(zi[ok] - zm) ** 2).sum()
            if spread < 1:
                ok = np.zeros_like(ok)
                break
            m = ((zi[ok] - zm).conj() * (wj[ok] - wm)).sum() / spread
            ok = (np.abs(np.angle(np.exp(1j * (turn - np.angle(m))))) < 0.5) & (np.abs(m * (zi - zm) + wm - wj) < reach * max(1.0, abs(m)))
        if ok.sum() >= 3:
            best = max(best, min(_places(zi[ok]), _places(wj[ok])))
    return best


def _matches(q: np.ndarray, p: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.ascontiguousarray(x["bits"]).view(np.uint64).reshape(len(x), 4) for x in (q, p))
    found = []
    for lo in range(0, len(a), 256):
        apart = sum(np.bitwise_count(a[lo : lo + 256, None, k] ^ b[None, :, k]).astype(np.int16) for k in range(4))
        i, j = np.nonzero(apart <= max_bits)
        found.append((i + lo, j))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _places(z: np.ndarray) -> int:
    return len(np.unique(np.round(z / 4)))


def needed(q: np.ndarray, min_votes: int = MIN_VOTES, min_share: float = MIN_SHARE) -> float:
    own = q[q["layer"] < 32]
    return max(min_votes, min_share * _places(own["x"] + 1j * own["y"]))


def describe(images: DataFrame, variants: int = 1) -> DataFrame:
    """(id, h, points) of images (id long, image binary): a 128-bit hash of the bytes and the corners of the first variants.  Null and
    malformed images and null ids are left out.  The images themselves go no further."""

    def run(batches):
        for batch in batches:
            ids, hs, out = [], [], []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                image = from_pgm(data) if i is not None else None
                if image is not None:
                    ids.append(i)
                    hs.append(xxhash.xxh3_128_digest(data))
                    out.append(np.concatenate([points(image, v) for v in range(variants)]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.binary()), pa.array(out, pa.binary())], ["id", "h", "points"])

    return images.mapInArrow(run, "id long, h binary, points binary")


def distinct_images(described: DataFrame) -> DataFrame:
    """(n, h, id, copies, points): equal images collapse, before they are shuffled, to the smallest id; n is a number of their own."""
    d = described.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("points").alias("points"))
    return d.select(F.monotonically_increasing_id().alias("n"), "h", "id", "copies", "points")


def table_rows(images: DataFrame, table: int, query: bool) -> DataFrame:
    """(key, sketch, fine, n, pose) of a Hamming table, see keys."""

    def run(batches):
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                p = np.frombuffer(blob.as_py(), POINT)
                key, sketch, fine, corner = keys(p, table, query)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sketch.view(np.int64)), pa.array(fine), pa.array(np.full(len(key), n, np.int64)), pa.array(poses(p)[corner])], ["key", "sketch", "fine", "n", "pose"])

    return images.select("n", "points").mapInArrow(run, "key long, sketch long, fine long, n long, pose long")


def candidates(scratch: Scratch, asks: DataFrame, base: DataFrame) -> DataFrame:
    """(q, n, qs, ps): image pairs that meet in the tables at two corners that agree on a transform, with the poses of all that met.

    The tables are joined one by one, so that the files of one at a time are on disk.  A frequent key has no limit: the sort-merge
    join's large partitions are split at run time, and the test of the sketches is part of the join."""
    part = lambda c, i: F.shiftright(c, 8 * (3 - i)).bitwiseAND(F.lit(255))
    turn, fine = ANGLES * STEPS, F.lit(True)
    for i in range(4):
        n = 256 if i < 2 else turn  # steps around, of a distance and of an angle
        fine &= F.pmod(part("qf", i) - part("bf", i) + SHIFT, F.lit(n)) <= 2 * SHIFT
    met = []
    for k in range(TABLES):
        a = table_rows(asks, k, True).select("key", F.col("sketch").alias("qs"), F.col("fine").alias("qf"), F.col("n").alias("q"), F.col("pose").alias("qp"))
        b = table_rows(base, k, False).select("key", F.col("sketch").alias("bs"), F.col("fine").alias("bf"), "n", F.col("pose").alias("bp"))
        on = (a.key == b.key) & (F.bit_count(F.col("qs").bitwiseXOR(F.col("bs"))) <= SKETCH_BITS) & fine
        met.append(scratch.save(a.hint("merge").join(b, on).select("q", "n", "qp", "bp"), f"met{k}"))
    every = met[0]
    for x in met[1:]:
        every = every.union(x)
    pairs = every.groupBy("q", "n").agg(F.collect_set(F.struct("qp", "bp")).alias("hits")).where(F.size("hits") >= 2)
    pairs = pairs.select("q", "n", F.transform("hits", lambda x: x["qp"]).alias("qs"), F.transform("hits", lambda x: x["bp"]).alias("ps"))

    def agree(batches):
        for batch in batches:
            keep = [agreeing(q.values.to_numpy(), p.values.to_numpy()) >= 2 for q, p in zip(batch.column(2), batch.column(3))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return scratch.save(pairs.mapInArrow(agree, pairs.schema), "candidates")


def find_copies(queries: DataFrame, images: DataFrame, max_bits: int = MAX_BITS, min_votes: int = MIN_VOTES, min_share: float = MIN_SHARE) -> DataFrame:
    """(query_id, match_id, votes, copies): for each query (id, image) the different images of which it is a cropped, resized, turned or
    edited copy; match_id is the smallest id of the ``copies`` rows that hold the image.  A copy has at least min_votes places, and
    min_share of the query's places, in common.

    Null, malformed and cornerless images match nothing.  Equal queries are searched once and answered each; equal images are
    one, so ties between them go to the smallest id.  Rows with one id and several images count with each.  Empty tables give no
    rows.  Further columns are ignored, whatever their names.  A large image has corners in proportion to its area; one row holds
    them all, so images are limited by a task's memory only.
    """
    scratch = Scratch(images.sparkSession, "images")
    asked = scratch.save(describe(queries.select("id", "image"), len(VARIANTS)), "asked")
    asks = scratch.save(distinct_images(asked), "queries")
    base = scratch.save(distinct_images(describe(images.select("id", "image"))), "images")
    hits = candidates(scratch, asks, base)

    def judge(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for h, i, copies, qp, bp, qs, ps in zip(*(batch.column(k).to_pylist() for k in range(3)), *(batch.column(k) for k in range(3, 7))):
                q = np.frombuffer(qp.as_py(), POINT)
                n = votes(q, np.frombuffer(bp.as_py(), POINT), (qs.values.to_numpy(), ps.values.to_numpy()), max_bits)
                if n >= needed(q, min_votes, min_share):
                    for col, x in zip(out, (h, i, n, copies)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["h", "match_id", "votes", "copies"])

    x = asks.select(F.col("n").alias("q"), "h", F.col("points").alias("qp"))
    y = base.select("n", F.col("id").alias("match_id"), "copies", F.col("points").alias("bp"))
    both = hits.join(y.hint("merge"), "n").join(x.hint("merge"), "q").select("h", "match_id", "copies", "qp", "bp", "qs", "ps")
    found = both.mapInArrow(judge, "h binary, match_id long, votes long, copies long")
    return asked.select(F.col("id").alias("query_id"), "h").join(found, "h").select("query_id", "match_id", "votes", "copies")


# ---- pictures of vectors ---------------------------------------------------------------------------------------


def picture(vector: np.ndarray, size: int = 80) -> np.ndarray:
    """A picture that depends on the vector alone: shaded rectangles at places drawn from a generator seeded by its bytes."""
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(np.asarray(vector, np.float32).tobytes()))
    a = np.full((size, size), 128, np.float32)
    for _ in range(22):
        y, x = rng.integers(0, size - 6, 2)
        h, w = rng.integers(6, 26, 2)
        a[y : y + h, x : x + w] = rng.integers(10, 245)
    return a


def edited(a: np.ndarray, seed: int) -> np.ndarray:
    """A copy with other contrast, brightness and some noise: half of the seeds give a crop of four fifths of each side, a quarter the
    picture turned by any angle, a quarter a crop of nine tenths resized by 0.75 to 1.4."""
    rng = np.random.default_rng(seed)
    kind = (seed // 50 + seed) % 4
    if kind != 2:
        h, w = a.shape
        share = 0.9 if kind == 3 else 0.8
        ch, cw = int(h * share), int(w * share)
        y, x = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
        a = a[y : y + ch, x : x + cw]
    a = turned(a, rng.uniform(-180, 180)) if kind == 2 else resized(a, rng.uniform(0.75, 1.4)) if kind == 3 else a
    return a * rng.uniform(0.8, 1.0) + rng.uniform(0, 20) + rng.normal(0, 1.0, a.shape)


def pictures(vectors: DataFrame, change: bool = False) -> DataFrame:
    """(id, image) of rows (id long, vector array<float>); with ``change`` an edited copy, seeded by the id."""

    def run(batches):
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.as_py()
                if v is None or any(x is None for x in v):
                    out.append(None)
                    continue
                p = picture(np.array(v, np.float32))
                out.append(to_pgm(edited(p, int(i) & 0x7FFFFFFF) if change else p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "image"])

    return vectors.mapInArrow(run, "id long, image binary")
