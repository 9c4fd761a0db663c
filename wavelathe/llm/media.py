"""Media columns: copies of images, cropped or edited, by local descriptors.

Corners are found at several scales, the strongest of every small cell, so a
larger image has more of them. The direction of the grey levels around a corner
turns a set of point-pair tests, whose bits describe it. A code is dealt into
parts; a Hamming table holds some of the parts, so codes whose differing bits
lie in the others meet in it. One code says little in a smooth image, so the
key of a table joins a corner's parts with those of a near corner and with how
the two lie to each other, the same from either of them. The more bits a key
holds, the fewer unrelated images share it, and the more tables and near corners
a copy needs: scales with few corners have keys of fewer bits besides. A pair of
images whose matched corners agree on one similarity transform (scale, turn,
shift) is a copy: each match proposes a transform, and the most supported one
counts.

Very many keys belong to one image alone. A first pass over the corners finds
those that several images have, as bits of a map of fixed size, and only these
become rows; a bit set by chance costs a row and changes nothing.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop, even_labels, free_shuffles, frugal, give_back, let_go, mix64, prepare, shuffle_partitions, small, spread_join, written

CELL = 8  # pixels of a cell, of which the strongest corner is kept
BITS = 64
NEAREST = 5  # corners that a corner's keys join it with
#: Parts of a code, parts that a table holds, and the seed by which bits are dealt into parts; of 1600 and 900 seeds, those with near the fewest equal codes in pictures of random grids.
DEAL, FEW_DEAL = (5, 3, 874), (4, 2, 36)
FEW = 8  # corners of a scale, at most, whose keys also go by FEW_DEAL
SECTORS = 8  # of a turn, in which how two corners lie to each other is told
MAP_BITS = 1 << 27
_MORE_BITS = 8  # of a key, beside its place in the map
ROUNDS = 1  # in which an image meets one other, before all that share an entry do
PAIR_ROWS = 1024  # of a table's entry that one task pairs with the others
PAIRS_A_CLASS = 2  # candidates, for each class, that are verified at a time
PAIRS_A_ROW = 2  # meetings in entries, for each row of the table, that are counted at a time
_STEPS = 5  # scales of an octave
_SCALES = tuple(2.0 ** (-k / _STEPS) for k in range(8))
_EDGE, _SMALLEST = 8, 24
_RNG = np.random.default_rng(20)
_TESTS = np.clip(_RNG.normal(0, 3.2, (BITS, 4)), -7, 7)
_DY, _DX = (g[np.hypot(*np.mgrid[-7:8, -7:8]) <= 7] for g in np.mgrid[-7:8, -7:8])
_CORNER = np.dtype([("code", "<u8"), ("x", "<f4"), ("y", "<f4"), ("s", "<f4"), ("t", "<f4")])
_TILE_KEYS = 1 << 21


def decode_grey(raw: bytes) -> np.ndarray | None:
    """A binary PGM (P5, 8 bits) or PPM (P6, 8 bits; channels averaged) as floats; None for anything else."""
    if not raw or raw[:2] not in (b"P5", b"P6"):
        return None
    numbers, at = [], 2
    while len(numbers) < 3:
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.find(b"\n", at) + 1
            if not at:
                return None
            continue
        end = at
        while end < len(raw) and raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        numbers.append(int(raw[at:end]))
        at = end
    w, h, top = numbers
    deep = 3 if raw[:2] == b"P6" else 1
    if top != 255 or w < 1 or h < 1 or len(raw) - at - 1 < w * h * deep:
        return None
    px = np.frombuffer(raw, np.uint8, w * h * deep, at + 1).astype(np.float64)
    return px.reshape(h, w, deep).mean(2)


def encode_pgm(px: np.ndarray) -> bytes:
    px = np.clip(np.rint(px), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (px.shape[1], px.shape[0]) + px.tobytes()


def resized(px: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned, over the last two axes."""
    y = np.clip((np.arange(h) + 0.5) * px.shape[-2] / h - 0.5, 0, px.shape[-2] - 1)
    x = np.clip((np.arange(w) + 0.5) * px.shape[-1] / w - 0.5, 0, px.shape[-1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, px.shape[-2] - 1), np.minimum(x0 + 1, px.shape[-1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    rows = px[..., y0, :] * (1 - fy) + px[..., y1, :] * fy
    return rows[..., x0] * (1 - fx) + rows[..., x1] * fx


def _blur(px: np.ndarray) -> np.ndarray:
    h, w = px.shape[-2:]
    p = np.pad(px, [(0, 0)] * (px.ndim - 2) + [(2, 2), (2, 2)], mode="edge")
    k = np.array([1, 4, 6, 4, 1]) / 16
    p = sum(k[i] * p[..., i : i + h, :] for i in range(5))
    return sum(k[i] * p[..., i : i + w] for i in range(5))


def described(stack: np.ndarray) -> list[np.ndarray]:
    """The corners of each image of a stack: code, place in the image, scale and turn."""
    n, found, owner = len(stack), [], []
    for s in _SCALES:
        h, w = round(stack.shape[1] * s), round(stack.shape[2] * s)
        if min(h, w) < _SMALLEST:
            continue
        g = _blur(stack if s == 1 else resized(_blur(stack) if s < 0.6 else stack, h, w))
        gy, gx = np.gradient(g, axis=(1, 2))
        a, b, c = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        pad = np.pad(r, [(0, 0), (1, 1), (1, 1)], constant_values=-np.inf)
        peak = r > np.maximum(1e-6, r.reshape(n, -1).max(1) * 0.005)[:, None, None]
        for dy, dx in itertools.product(range(3), range(3)):
            if (dy, dx) != (1, 1):
                peak &= r >= pad[:, dy : dy + h, dx : dx + w]
        peak[:, :_EDGE] = peak[:, -_EDGE:] = False
        peak[:, :, :_EDGE] = peak[:, :, -_EDGE:] = False
        i, y, x = np.nonzero(peak)
        if not len(i):
            continue
        cell = (i * (h // CELL + 1) + y // CELL) * (w // CELL + 1) + x // CELL
        order = np.lexsort((-r[i, y, x], cell))
        top = order[np.append(True, np.diff(cell[order]) != 0)]
        i, y, x = i[top], y[top], x[top]
        g = _blur(g)
        patch = g[i[:, None], y[:, None] + _DY, x[:, None] + _DX]
        turn = np.arctan2((patch * _DY).sum(1), (patch * _DX).sum(1))
        co, si = np.cos(turn)[:, None], np.sin(turn)[:, None]

        def at(tx, ty):
            ux, uy = np.rint(tx * co - ty * si).astype(int), np.rint(tx * si + ty * co).astype(int)
            return g[i[:, None], np.clip(y[:, None] + uy, 0, h - 1), np.clip(x[:, None] + ux, 0, w - 1)]

        bits = at(_TESTS[:, 0], _TESTS[:, 1]) < at(_TESTS[:, 2], _TESTS[:, 3])
        made = np.empty(len(x), _CORNER)
        made["code"] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
        made["x"], made["y"], made["s"], made["t"] = (x + 0.5) * stack.shape[2] / w, (y + 0.5) * stack.shape[1] / h, s, turn
        found.append(made)
        owner.append(i)
    if not found:
        return [np.empty(0, _CORNER)] * n
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.split(found[order], np.searchsorted(owner[order], np.arange(1, n)))


def described_all(images: list, most_pixels: int = 1 << 16) -> list[np.ndarray]:
    """The corners of each image (None: none), those of one size in stacks of about most_pixels."""
    out: list = [np.empty(0, _CORNER)] * len(images)
    by_size: dict = {}
    for i, px in enumerate(images):
        if px is not None:
            by_size.setdefault(px.shape, []).append(i)
    for (h, w), at in by_size.items():
        many = max(1, most_pixels // (h * w))
        for k in range(0, len(at), many):
            part = at[k : k + many]
            for i, corners in zip(part, described(np.stack([images[j] for j in part]))):
                out[i] = corners
    return out


def _masks(parts: int, kept: int, seed: int) -> list[np.uint64]:
    """The bits that each table holds."""
    dealt = np.array_split(np.random.default_rng(seed).permutation(BITS), parts)
    return [np.uint64(sum(1 << int(b) for b in np.concatenate(held))) for held in itertools.combinations(dealt, kept)]


_TABLES, _FEW_TABLES = _masks(*DEAL), _masks(*FEW_DEAL)


def table_keys(corners: np.ndarray) -> np.ndarray:
    """Keys of an image's Hamming tables: the kept parts of a corner and of one of its NEAREST at the same scale, and how they lie, hashed."""
    if len(corners) < 2:
        return np.empty(0, np.uint64)
    (x, y, t), code, n = (corners[c].astype(float) for c in "xyt"), corners["code"], len(corners)
    apart = np.hypot(x[:, None] - x, y[:, None] - y)
    apart[(corners["s"][:, None] != corners["s"]) | np.eye(n, dtype=bool)] = np.inf
    near = np.argsort(apart, axis=1, kind="stable")[:, :NEAREST]
    i, k = np.nonzero(np.isfinite(np.take_along_axis(apart, near, 1)))
    j = near[i, k]
    i, j = np.divmod(np.unique(np.minimum(i, j) * n + np.maximum(i, j)), n)
    sector = lambda a: np.floor(a % (2 * np.pi) / (2 * np.pi) * SECTORS).astype(np.uint64)
    way = np.arctan2(y[j] - y[i], x[j] - x[i])
    ends = (code[i], sector(way - t[i])), (code[j], sector(way + np.pi - t[j]))
    few = np.isfinite(apart).sum(1)[i] < FEW
    found = []
    with np.errstate(over="ignore"):
        for table, mask in enumerate(_TABLES + _FEW_TABLES):
            own = few if table >= len(_TABLES) else slice(None)
            a, b = (mix64(mix64((c[own] & mask) + np.uint64(table + 1)) + lie[own]) for c, lie in ends)
            found.append(mix64(a + b))
    return np.unique(np.concatenate(found))


def agreement(a: np.ndarray, b: np.ndarray, tolerance: float = 3.0) -> int:
    """The most matched corners (rows of a and b) at different places under one similarity transform that a match proposes, whose own scale and turn fit it too."""
    size = np.log(a["s"].astype(float) / b["s"])
    turn = b["t"].astype(float) - a["t"]
    (px, py), (qx, qy) = ((c["x"].astype(float), c["y"].astype(float)) for c in (a, b))
    best = 0
    for first in range(0, len(a), 256):  # proposals at a time
        i = np.arange(first, min(first + 256, len(a)))[:, None]
        scale = np.exp(size[i])
        co, si = np.cos(turn[i]) * scale, np.sin(turn[i]) * scale
        dx, dy = px - px[i], py - py[i]
        good = np.hypot(dx * co - dy * si + qx[i] - qx, dx * si + dy * co + qy[i] - qy) <= tolerance * np.maximum(1.0, scale)
        good &= (np.abs(size - size[i]) < 0.3) & (np.abs((turn - turn[i] + np.pi) % (2 * np.pi) - np.pi) < 0.4)
        count = good.sum(1)
        for k in np.argsort(-count, kind="stable"):
            if count[k] <= best:
                break
            best = max(best, len(set(zip(np.rint(px[good[k]] / 2), np.rint(py[good[k]] / 2)))))
    return best


def are_copies(a: np.ndarray, b: np.ndarray, near: int = 6, votes: int = 6, share: float = 0.15) -> bool:
    """Whether `votes` corners, and a share of the fewer corners of the two, agree. A corner matches the one of the nearest code in the other image, up to `near` bits away."""
    need = max(votes, share * min(len(a), len(b)))
    if min(len(a), len(b)) < need:
        return False
    apart = np.bitwise_count(a["code"][:, None] ^ b["code"][None, :])
    j = apart.argmin(1)
    i = np.flatnonzero(apart[np.arange(len(a)), j] <= near)
    return len(i) >= need and agreement(a[i], b[j[i]]) >= need


def _beside(rows: DataFrame, pairs: DataFrame, classes: DataFrame, on: str, by: str) -> DataFrame:
    """rows (some of pairs) with the corners `k` of their image in column `on`. An image of very many pairs meets them in several tasks, dealt by their column `by`."""
    spark = classes.sparkSession
    deals = F.ceil(F.col("held") / PAIR_ROWS).alias("deals")
    many = small(pairs.groupBy(on).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > PAIR_ROWS).select(on, deals))
    deals = F.coalesce("deals", F.lit(1).cast("long"))
    own = classes.select(F.col("rep").alias(on), F.col("corners").alias(f"k{on}")).join(many, on, "left")
    own = own.select(on, f"k{on}", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)).alias("deal"))
    dealt = rows.join(many, on, "left").withColumn("deal", F.pmod(F.xxhash64(by), deals)).drop("deals")
    # Few bytes, but much work: by a number of parts, which small parts do not lower.
    n = shuffle_partitions(spark)
    return dealt.repartition(n, on, "deal").join(own.repartition(n, on, "deal"), [on, "deal"]).drop("deal")


def _verified(pairs: DataFrame, classes: DataFrame, near: int, votes: int) -> DataFrame:
    """Of the pairs (a, b) of images, the copies, as written tables. Very many pairs may have the same a, or b.

    Corners are far larger than pairs, so only PAIRS_A_CLASS pairs a class are
    sent along with them at a time: what lies on disk is a few times the
    corners of all classes, however many pairs there are.
    """
    spark = classes.sparkSession

    @F.pandas_udf("boolean")
    def agree(ka: pd.Series, kb: pd.Series) -> pd.Series:
        return pd.Series([are_copies(np.frombuffer(p, _CORNER), np.frombuffer(q, _CORNER), near, votes) for p, q in zip(ka, kb)], dtype=bool)

    pairs = written(pairs, "media-pairs")
    free_shuffles(spark)
    turns = max(1, math.ceil(pairs.count() / max(1, PAIRS_A_CLASS * classes.count())))
    found = []
    for k in range(turns):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == k)
        both = _beside(_beside(part, pairs, classes, "a", "b"), pairs, classes, "b", "a")
        found.append(written(both.where(agree("ka", "kb")).select("a", "b"), "media-links"))
        free_shuffles(spark)
    drop(pairs)
    return functools.reduce(DataFrame.union, found)


def met_across(rest: DataFrame, shared: int, turns: int = 1, turn: int = 0) -> DataFrame:
    """Pairs (a, b) that meet in rest (key, root, rep: the images in an entry and their components), of components that share `shared` entries.

    Entries are counted by component, as links inside it hold for all of them.
    An entry's many images are dealt out, and each deal meets all the others.
    Two components' pairs all come in one of the turns.
    """
    apart = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo < hi")
    rows = spread_join(rest, apart.select("key", F.ceil(F.col("held") / PAIR_ROWS).alias("deals")), "key", "rep")
    a = rows.select("key", F.pmod(F.xxhash64("rep"), "deals").alias("deal"), F.col("root").alias("ra"), F.col("rep").alias("a"))
    b = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.col("root").alias("rb"), F.col("rep").alias("b"))
    pairs = a.join(b, ["key", "deal"]).where("ra < rb").where(F.pmod(F.xxhash64("ra", "rb"), F.lit(turns)) == turn).select("key", "ra", "rb", "a", "b")
    enough = pairs.select("key", "ra", "rb").distinct().groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared).select("ra", "rb")
    return pairs.select("ra", "rb", "a", "b").distinct().join(enough, ["ra", "rb"]).select("a", "b")


def turns_across(rest: DataFrame) -> int:
    """So many turns of met_across that in each about PAIRS_A_ROW times as many pairs meet in entries as rest has rows."""
    each = rest.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    r = each.agg(F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("met")).first()
    free_shuffles(rest.sparkSession)
    return max(1, math.ceil((r["met"] or 0) / (PAIRS_A_ROW * max(1, r["rows"] or 0))))


def packed_gaps(numbers: np.ndarray) -> bytes:
    """Ascending numbers from 0 as 16-bit gaps; 65535 is a step of as many without a number."""
    gap = np.diff(numbers.astype(np.int64), prepend=0)
    steps, rest = np.divmod(gap, 65535)
    out = np.full(len(gap) + int(steps.sum()), 65535, "<u2")
    out[np.cumsum(steps + 1) - 1] = rest
    return out.tobytes()


def unpacked_gaps(raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(raw, "<u2")
    return np.cumsum(gaps, dtype=np.int64)[gaps != 65535]


def nearest_heads(rest: DataFrame, shared: int) -> DataFrame:
    """Pairs (a, b) of rest (key, root, rep): each image b with the head of another component that it shares most entries with, `shared` at least.

    An entry's heads are the least image of its least component and the largest of its largest.
    """
    place = F.struct("root", "rep")
    heads = rest.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.root < hi.root")
    rows = spread_join(rest, heads, "key", "rep")
    head = F.when(F.col("lo.root") != F.col("root"), F.col("lo.rep")).otherwise(F.col("hi.rep"))
    counts = rows.groupBy(head.alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared)
    return counts.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")


def shared_entries(classes: DataFrame) -> DataFrame:
    """(key, rep) of the images' table keys, less nearly all keys that one image alone has."""
    spark = classes.sparkSession
    blocks = 1 << max(shuffle_partitions(spark) - 1, 1).bit_length()
    blocks = min(max(blocks, 16), 1 << 15)
    labels, slice_ = even_labels(spark, blocks), MAP_BITS // blocks

    def spots(keys):
        """A key's bit and _MORE_BITS more of its bits, as one number."""
        return ((keys & np.uint64(MAP_BITS - 1)) << np.uint64(_MORE_BITS) | (keys >> np.uint64(64 - _MORE_BITS))).astype(np.int64)

    def flush(held):
        found, n = np.unique(spots(np.concatenate(held)), return_counts=True)
        cut = np.searchsorted(found >> _MORE_BITS, np.arange(blocks + 1, dtype=np.int64) * slice_)
        for b in np.flatnonzero(np.diff(cut)):
            at = slice(cut[b], cut[b + 1])
            own = found[at] - (int(b) * slice_ << _MORE_BITS)
            yield labels[b], int(b), packed_gaps(own), packed_gaps(own[n[at] > 1])

    @frugal
    def tiles(batches):
        held, size = [], 0
        for pdf in batches:
            for raw in pdf["corners"]:
                held.append(table_keys(np.frombuffer(raw, _CORNER)))
                size += len(held[-1])
                if size >= _TILE_KEYS:
                    yield pd.DataFrame(flush(held), columns=["block", "number", "found", "several"])
                    held, size = [], 0
        if size:
            yield pd.DataFrame(flush(held), columns=["block", "number", "found", "several"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """A tile names each of its keys once, so one that two tiles name belongs to two images."""
        let_go()
        every = np.sort(np.concatenate([unpacked_gaps(r) for r in pdf["found"]]))
        both = np.concatenate([every[1:][every[1:] == every[:-1]], *map(unpacked_gaps, pdf["several"])])
        number = int(pdf["number"].iloc[0])
        bits = np.zeros(slice_, np.uint8)
        bits[both >> _MORE_BITS] = 1
        return pd.DataFrame([(number, np.packbits(bits, bitorder="little").tobytes())], columns=["number", "bits"])

    made = classes.select("corners").mapInPandas(tiles, "block long, number int, found binary, several binary")
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in made.groupBy("block").applyInPandas(meet, "number int, bits binary").toLocalIterator():
        at = r["number"] * (slice_ // 8)
        bits[at : at + slice_ // 8] = np.frombuffer(r["bits"], np.uint8)
    known = spark.sparkContext.broadcast(bits.tobytes())

    @frugal
    def entries(batches):
        bits = np.frombuffer(known.value, np.uint8)
        for pdf in batches:
            keys, reps = [], []
            for rep, raw in zip(pdf["rep"], pdf["corners"]):
                own = table_keys(np.frombuffer(raw, _CORNER))
                bit = own & np.uint64(MAP_BITS - 1)
                own = own[(bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                keys.append(own.view(np.int64))
                reps.append(np.full(len(own), rep))
            yield pd.DataFrame({"key": np.concatenate(keys) if keys else np.empty(0, np.int64), "rep": np.concatenate(reps) if reps else np.empty(0, np.int64)})

    out = written(classes.select("rep", "corners").mapInPandas(entries, "key long, rep long"), "media-entries")
    known.unpersist()
    return out


def media_copies(media: DataFrame, near: int = 6, votes: int = 6, shared: int = 1) -> DataFrame:
    """media (media_id, image binary): media_id, n_corners, component_id, n_links.

    An image that cannot be read, a null one and one without corners has no
    corners and stands alone. Images with equal bytes are one class, and so are
    repeated rows; a row with a null media_id is left out. Other columns are
    ignored. Classes that meet in `shared` table entries or more are
    candidates, and a candidate pair whose corners agree (are_copies) is a
    link; n_links counts a class's links found. First, for ROUNDS rounds, each
    class meets one head of another component, which is linear and connects
    groups of copies. Then all classes of an entry that lie in different
    components meet, where the two components share as many entries. Both
    the meetings and the verification are done in turns of a bounded size.
    """
    spark = prepare(media.sparkSession)
    own = media.where("media_id is not null").select(F.col("media_id").cast("long").alias("media_id"), F.sha2(F.coalesce("image", F.lit(b"")), 256).alias("cls"), "image")

    @frugal
    def look(batches):
        for pdf in batches:
            found = described_all([decode_grey(bytes(raw)) if raw is not None else None for raw in pdf["image"]])
            yield pd.DataFrame({"media_id": pdf["media_id"], "cls": pdf["cls"], "corners": [c.tobytes() for c in found]})
            give_back()

    # Images are read once, where they stand, and only their corners move.
    rows = written(own.mapInPandas(look, "media_id long, cls string, corners binary"), "media-rows")
    names = written(rows.select("media_id", "cls"), "media-names")
    # A class is known by a hash of its bytes' hash: rows of different bytes may have one id.
    first = rows.groupBy("cls").agg(F.any_value("corners").alias("corners"))
    classes = written(first.select("cls", F.xxhash64("cls").alias("rep"), "corners"), "media-corners")
    drop(rows)
    free_shuffles(spark)
    entries = shared_entries(classes)
    full = entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    table = written(spread_join(entries, full, "key", "rep").select("key", "rep"), "media-table")
    drop(entries)
    free_shuffles(spark)
    rest, links, stored = table.withColumn("root", F.col("rep")), None, table
    for _ in range(ROUNDS):
        found = _verified(nearest_heads(rest, shared), classes, near, votes)
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        roots = components(links if _ == 0 else roots.toDF("a", "b").union(found), "media-cc")
        free_shuffles(spark)
        stored = rest = written(table.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("root"), "rep"), "media-rest")
    if links is None:
        links = classes.limit(0).select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        roots = links.toDF("node", "root")
    else:
        drop(table)
    rest = rest.select("key", "root", "rep")
    roots = roots.withColumnRenamed("node", "rep")
    turns = turns_across(rest)
    more = functools.reduce(DataFrame.union, [_verified(met_across(rest, shared, turns, k), classes, near, votes) for k in range(turns)])
    drop(stored)
    edges = links.union(more)
    if not more.isEmpty():
        roots = components(roots.toDF("a", "b").union(more), "media-cc").withColumnRenamed("node", "rep")
    degree = edges.select(F.col("a").alias("rep")).union(edges.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    size = (F.octet_length("corners") / _CORNER.itemsize).cast("long")
    about = classes.select("cls", "rep", size.alias("n_corners")).join(roots, "rep", "left").join(degree, "rep", "left")
    about = about.select("cls", F.coalesce("root", "rep").alias("root"), "n_corners", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    found = written(spread_join(names, about, "cls", "media_id"), "media-found")
    least = found.groupBy("root").agg(F.min("media_id").alias("least"))
    out = spread_join(found, least, "root", "media_id")
    return out.select("media_id", "n_corners", F.when(F.col("n_corners") > 0, F.col("least")).otherwise(F.col("media_id")).alias("component_id"), "n_links")


_GRID, _SIDE = 14, 64


def drawn(vector: np.ndarray, side: int = _SIDE) -> np.ndarray:
    """A vector as a picture: grey levels on a grid, told by the hash of its numbers, enlarged. Equal vectors are one picture, any others unlike."""
    seed = int.from_bytes(hashlib.sha256(np.asarray(vector, "<f8").tobytes()).digest()[:8], "little")
    return np.rint(resized(np.random.default_rng(seed).uniform(0, 255, (_GRID, _GRID)), side, side))


#: Edits by number: a crop to five sixths, levels, noise, a quarter turn, enlarged, reduced, a crop to two thirds.
EDITS = (
    lambda a, rng: a[len(a) // 12 :, len(a) // 12 :][: 5 * len(a) // 6, : 5 * len(a) // 6], lambda a, rng: np.clip(a * 0.8 + 20, 0, 255), lambda a, rng: np.clip(a + rng.normal(0, 3, a.shape), 0, 255),
    lambda a, rng: np.rot90(a), lambda a, rng: resized(a, 4 * len(a) // 3, 4 * len(a) // 3), lambda a, rng: resized(a, 3 * len(a) // 4, 3 * len(a) // 4),
    lambda a, rng: a[len(a) // 6 :, len(a) // 8 :][: 2 * len(a) // 3, : 2 * len(a) // 3],
)


def rendered(vectors: DataFrame, every: int = 50) -> DataFrame:
    """(media_id, vec_id, edit, image): vectors (vec_id, embedding) drawn as grey images, for tables without media.

    Each vector is drawn (edit 0, media_id 8 * vec_id), and for one id in
    `every` an edited copy stands beside it (edit 1 to 7, media_id 8 * vec_id +
    edit), so that there is something to find. Null vectors, empty ones, and
    those with a null or non-finite component, have no image.
    """

    @F.pandas_udf("binary")
    def draw(v: pd.Series, ids: pd.Series, edit: pd.Series) -> pd.Series:
        out = []
        for e, i, k in zip(v, ids, edit):
            e = None if e is None else np.array(e, np.float64)
            if e is None or not len(e) or not np.isfinite(e).all():
                out.append(None)
                continue
            px = drawn(e)
            out.append(encode_pgm(EDITS[k - 1](px, np.random.default_rng(int(i) % (1 << 32))) if k else px))
        return pd.Series(out, dtype=object)

    own = vectors.where("vec_id is not null").select("vec_id", "embedding")
    edit = (F.pmod(F.floor(F.col("vec_id") / every), F.lit(len(EDITS))) + 1).cast("int")
    edits = F.when(F.pmod("vec_id", F.lit(every)) == 0, F.array(F.lit(0), edit)).otherwise(F.array(F.lit(0)))
    rows = own.select("*", F.explode(edits).alias("edit"))
    return rows.select((F.col("vec_id") * 8 + F.col("edit")).alias("media_id"), "vec_id", "edit", draw("embedding", "vec_id", "edit").alias("image"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per image drawn: vec_id, edit, n_corners, component_id (the least media_id, 8 * vec_id + edit) and n_links."""
    prepare(spark)
    found = media_copies(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return found.select(F.floor(F.col("media_id") / 8).alias("vec_id"), F.pmod("media_id", F.lit(8)).cast("int").alias("edit"), "n_corners", "component_id", "n_links")
