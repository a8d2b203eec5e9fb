"""Cropped and edited copies in a media column, by local image descriptors.

Each image gives corners at several scales (Harris response, local maxima). A corner's orientation is that of
its intensity centroid; 128 binary brightness tests, turned to it and chosen for little correlation, describe it.

Hamming tables. The tests are cut into bands of ``band_bits`` bits. A band's word alone is too common to be a
row once images are many, so a row is the word of a corner followed by that of its nearest corner on the same scale
(``least`` corners). No row is cut, split or sampled.

Quiet images lie in no row with more than ``crowd`` entries. Their rows give all their pairs, which ``crowd`` bounds
per entry. A meeting of two images also says how far the one is turned and scaled against the other; pairs with
``votes`` meetings that agree on both are candidates. The candidates' connected components are cut into blocks of
``block`` images; a task compares two blocks, or many small components. Every pair of a component with rows in common
(half of ``votes``) is verified.

Crowded images lie in some row with more entries. They are cut into blocks of up to ``wide`` images; a task takes two
blocks, counts the rows that each pair has in common, however crowded, and verifies every pair with half of ``votes``.
So the links of crowded images are those of a comparison of all pairs with rows in common, at a cost that grows with
the square of the number of crowded images. A pair with a quiet image has no crowded row, and is found above.

Verification is by geometric consensus: one similarity transform must carry enough matched corners of one image onto
the other, and make up enough of the corners in the area that both show. Its first steps are done for many images at
once, on the corners whose folded descriptors are close enough, and the whole where they leave it possible. A task returns one row per image: its number of links and the
smallest image it reaches. Links' connected components are the classes. So a pair needs no common smallest image to
be compared: strangers with smaller ids in its rows cost it nothing.

Images with equal pixels are one class from the start and are described once.

Media are portable greymaps or pixmaps (P5, P6) or PNG files (8 bits a channel, not interlaced) in a binary column.
The driver tables have no images, so ``vector_media`` draws one per embedding: a smooth field whose every value is a
projection of the whole vector; close vectors give edited copies.

Defined results
* null or undecodable image (JPEG among them): decoded false, no corners, class_id its own id, no links.
  Null id: class_id null.
* an image without corners: its own class, unless another has the same pixels.
* repeated ids: one image; its first by pixel digest stands for it. Empty table: empty result.
* extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, hashing
from .near_join import _roots, components


@dataclass(frozen=True)
class MediaParams:
    """scales: pyramid factors; least_response: share of an image's strongest corner that a corner must reach;
    least: corners of a table row; crowd: entries beyond which a row is crowded; most, popular: corners of the rows, and images
    that share one, from which ``candidate_ties`` of a whole table ties them without gathering them; block: images of a block; wide: images of a block of
    those that lie in crowded rows."""

    scales: tuple = (1.0, 0.75, 0.5)
    least_response: float = 0.05
    border: int = 9
    bands: int = 8
    band_bits: int = 16
    least: int = 2
    most: int = 4
    crowd: int = 6
    popular: int = 8192
    votes: int = 3
    max_distance: int = 20
    tolerance: float = 2.0
    min_inliers: int = 6
    min_share: float = 0.35
    block: int = 128
    wide: int = 12_288


TESTS = 128
TURNS = 30
#: Bits in a table row of whether it stands for two (1), of the corner's scale (3) and angle (5).
PLACE_BITS = 9
#: Ids or heads up to which they are sent to the images instead of the images to them.
BROADCAST_ROWS = 1_000_000
#: Pairs of corners compared at once, and those whose results are held.
CELLS, HELD_CELLS = 65_536, 4_194_304
#: Corners from which on it pays to learn which bits to fold.
LEARN = 50_000
#: One keypoint: x, y, scale, angle, descriptor.
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("s", "<f4"), ("a", "<f4"), ("d", "u1", TESTS // 8)])


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that a worker holds the objects of one part."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---------------------------------------------------------------- images


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + image.astype(np.uint8).tobytes()


def decode_pnm(data: bytes | None) -> np.ndarray | None:
    """A grey image, or None. Binary greymaps and pixmaps of 8 bits."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                return None
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if not data[at:end].isdigit():
            return None
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    depth = 1 if data[:2] == b"P5" else 3
    raw = data[at + 1 :]
    if top != 255 or w < 1 or h < 1 or len(raw) < w * h * depth:
        return None
    image = np.frombuffer(raw, np.uint8, w * h * depth).reshape(h, w, depth)
    return image[:, :, 0] if depth == 1 else _grey(image)


def _unfilter(raw: bytes, h: int, row: int, step: int) -> np.ndarray | None:
    """PNG scan lines without their filters. step: bytes of a pixel."""
    lines = np.frombuffer(raw, np.uint8)
    if len(lines) < h * (row + 1):
        return None
    lines = lines[: h * (row + 1)].reshape(h, row + 1)
    out = np.zeros((h + 1, row + step), np.int64)  # a blank line above and a blank pixel to the left
    for y in range(h):
        kind, line, up, here = int(lines[y, 0]), lines[y, 1:], out[y], out[y + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 1:
            here[step:] = np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
        elif kind == 2:
            here[step:] = (line + up[step:]) & 255
        elif kind in (3, 4):
            for x in range(step, row + step):
                left, above, corner = int(here[x - step]), int(up[x]), int(up[x - step])
                if kind == 3:
                    guess = (left + above) >> 1
                else:
                    guess = min((left, above, corner), key=lambda v: abs(left + above - corner - v))
                here[x] = (int(line[x - step]) + guess) & 255
        else:
            return None
    return out[1:, step:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray | None:
    """A grey image, or None. 8 bits a channel: grey, colour, palette, with or without alpha; not interlaced."""
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE" and size % 3 == 0:
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 3, 4, 6) or head[6]:
        return None
    w, h, depth = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), h * (w * depth + 1))
    except zlib.error:
        return None
    image = _unfilter(raw, h, w * depth, depth) if w and h else None
    if image is None:
        return None
    image = image.reshape(h, w, depth)
    if head[3] == 3:
        if palette is None or int(image.max()) >= len(palette):
            return None
        image = palette[image[:, :, 0]]
    return image[:, :, 0] if head[3] in (0, 4) else _grey(image)


def _grey(image: np.ndarray) -> np.ndarray:
    return (image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def decode_image(data: bytes | None) -> np.ndarray | None:
    return decode_png(data) if data and data[:8] == b"\x89PNG\r\n\x1a\n" else decode_pnm(data)


@lru_cache(maxsize=4)
def _fields(dims: int, side: int) -> tuple:
    """Projections to a coarse and a fine grid, each with its enlargement to the image and its weight."""
    rng = np.random.default_rng(11)
    return tuple(
        (rng.normal(size=(cells * cells, dims)).astype(np.float32), _shrink(cells, side / cells), weight)
        for cells, weight in ((8, 0.6), (20, 1.0))
    )


def draw_vector(vector: np.ndarray, side: int = 64) -> np.ndarray:
    """A smooth grey field; every value is a projection of the whole vector, scaled to unit length."""
    unit = vector / (float(np.linalg.norm(vector)) or 1.0)
    field = np.zeros((side, side), np.float32)
    for planes, enlarge, weight in _fields(len(vector), side):
        cells = enlarge.shape[1]
        field += weight * (enlarge @ (planes @ unit).reshape(cells, cells) @ enlarge.T)
    return np.clip(128 + 55 * field, 0, 255).astype(np.uint8)


def vector_media(embeddings: DataFrame) -> DataFrame:
    """id, image: one greymap per embedding; null for a null or empty vector. NaN and infinite coordinates count as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 512):
            images = []
            for v in batch.column(1):
                v = v.as_py()
                images.append(encode_pgm(draw_vector(np.nan_to_num(np.array(v, np.float32), posinf=0, neginf=0))) if v else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["id", "image"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "id long, image binary")


# ---------------------------------------------------------------- corners and tests


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r + 1) squared pixels, edges repeated."""
    for axis in (-2, -1):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = x.shape[axis]
        hi = np.take(c, range(2 * r + 1, 2 * r + 1 + n), axis=axis)
        x = (hi - np.take(c, range(n), axis=axis)) / (2 * r + 1)
    return x.astype(np.float32)


def _shrink(n: int, factor: float) -> np.ndarray:
    """Rows of a linear resampling from n to n * factor pixels."""
    m = max(1, int(round(n * factor)))
    out = np.zeros((m, n), np.float32)
    at = np.clip((np.arange(m) + 0.5) / factor - 0.5, 0, n - 1)
    lo = np.floor(at).astype(int)
    hi = np.minimum(lo + 1, n - 1)
    out[np.arange(m), lo] += 1 - (at - lo)
    out[np.arange(m), hi] += at - lo
    return out


def _tests(radius: int) -> np.ndarray:
    """Test positions (tests, 2 points, y x): of many random ones those that agree least on smoothed noise."""
    rng = np.random.default_rng(23)
    points = np.clip(rng.normal(0, radius / 2.2, (2400, 2, 2)), -radius + 1, radius - 1)
    points = points[np.linalg.norm(points[:, 0] - points[:, 1], axis=1) >= 4][:600]
    noise = rng.normal(size=(1500, 2 * radius + 9, 2 * radius + 9)).astype(np.float32)
    noise = _box(_box(noise, 2), 2)[:, 4:-4, 4:-4]
    at = np.rint(points).astype(int) + radius
    sign = np.where(noise[:, at[:, 0, 0], at[:, 0, 1]] < noise[:, at[:, 1, 0], at[:, 1, 1]], 1.0, -1.0)
    alike = np.abs(sign.T @ sign) / len(sign)
    chosen, worst = [0], alike[0].copy()
    while len(chosen) < TESTS:
        worst[chosen[-1]] = np.inf
        chosen.append(int(worst.argmin()))
        worst = np.maximum(worst, alike[chosen[-1]])
    return points[chosen]


def _turn(angle: np.ndarray) -> np.ndarray:
    """The nearest of the directions that tests are turned to."""
    return np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS


@lru_cache(maxsize=2)
def _patterns(radius: int) -> np.ndarray:
    """Test positions (directions, tests, 2 points, dy dx)."""
    points = _tests(radius)
    out = []
    for k in range(TURNS):
        c, s = np.cos(2 * np.pi * k / TURNS), np.sin(2 * np.pi * k / TURNS)
        y, x = points[..., 0], points[..., 1]
        out.append(np.stack([s * x + c * y, c * x - s * y], axis=-1))
    return np.clip(np.rint(np.array(out)), -radius, radius).astype(np.int64)


def describe_batch(images: np.ndarray, params: MediaParams = MediaParams()) -> list[np.ndarray]:
    """Keypoints (POINT) of equally large grey images."""
    count, h, w = images.shape
    found = [[] for _ in range(count)]
    base = _box(images.astype(np.float32), 1)
    r = params.border
    for factor in params.scales:
        level = base if factor == 1 else _shrink(h, factor) @ base @ _shrink(w, factor).T
        if min(level.shape[1:]) <= 2 * r + 2:
            continue
        gy, gx = np.gradient(level, axis=1), np.gradient(level, axis=2)
        xx, yy, xy = _box(gx * gx, 1), _box(gy * gy, 1), _box(gx * gy, 1)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[:, r:-r, r:-r]
        peak = np.ones(inner.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    other = response[:, r + dy : response.shape[1] - r + dy, r + dx : response.shape[2] - r + dx]
                    peak &= inner > other if (dy, dx) > (0, 0) else inner >= other
        strongest = inner.reshape(count, -1).max(axis=1)
        peak &= inner > np.maximum(params.least_response * strongest, 1.0)[:, None, None]
        n, y, x = np.nonzero(peak)
        if not len(n):
            continue
        y, x = y + r, x + r
        smooth = _box(level, 2)
        disc = [(dy, dx) for dy in range(-7, 8) for dx in range(-7, 8) if dy * dy + dx * dx <= 49]
        dy, dx = np.array(disc).T
        values = level[n[:, None], y[:, None] + dy, x[:, None] + dx]
        values = values - values.mean(axis=1, keepdims=True)
        angle = np.arctan2(values @ dy.astype(np.float32), values @ dx.astype(np.float32))
        tests = _patterns(r)[_turn(angle)]
        low = smooth[n[:, None], y[:, None] + tests[:, :, 0, 0], x[:, None] + tests[:, :, 0, 1]]
        high = smooth[n[:, None], y[:, None] + tests[:, :, 1, 0], x[:, None] + tests[:, :, 1, 1]]
        points = np.zeros(len(n), POINT)
        points["x"], points["y"], points["s"], points["a"] = (x + 0.5) / factor, (y + 0.5) / factor, 1 / factor, angle
        points["d"] = np.packbits(low < high, axis=1)
        for i, part in zip(*_split(n, points), strict=True):
            found[i].append(part)
    return [np.concatenate(f) if f else np.zeros(0, POINT) for f in found]


def _split(keys: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[cut].tolist(), np.split(rows, cut[1:])


def _words(points: np.ndarray, params: MediaParams) -> np.ndarray:
    """The word of every corner in every band."""
    bits = np.unpackbits(points["d"], axis=1)[:, : params.bands * params.band_bits]
    return bits.reshape(len(points), params.bands, params.band_bits).astype(np.int64) @ (1 << np.arange(params.band_bits, dtype=np.int64))


def _near_corners(points: np.ndarray, count: int) -> np.ndarray:
    """Indices of the nearest corners of the same scale, nearest first; -1 where there are too few."""
    gap = np.hypot(points["x"][:, None] - points["x"], points["y"][:, None] - points["y"]) / points["s"][:, None]
    gap[(points["s"][:, None] != points["s"]) | np.eye(len(points), dtype=bool)] = np.inf
    order = gap.argmin(axis=1)[:, None] if count == 1 else np.argsort(gap, axis=1, kind="stable")[:, :count]
    out = np.full((len(points), count), -1)
    out[:, : order.shape[1]] = np.where(np.isfinite(np.take_along_axis(gap, order, axis=1)), order, -1)
    return out


def _paths(words: np.ndarray, near: np.ndarray, params: MediaParams) -> tuple[np.ndarray, ...]:
    """Words along the path of every corner and band, hash of the first ``least``, corners that are their nearest's nearest, rows
    that stand: of two corners that are each other's nearest, the one with the smaller word speaks for both."""
    path = np.concatenate([words[:, :, None], np.where(near[:, None, :] >= 0, words[near].transpose(0, 2, 1), 0)], axis=2)
    head = np.broadcast_to(np.arange(1, params.bands + 1, dtype=np.uint64), words.shape)
    for k in range(params.least):
        head = hashing.mix64(head * np.uint64(0x9E3779B97F4A7C15) + path[:, :, k].astype(np.uint64))
    nearest = near[:, 0]
    mutual = (nearest >= 0) & (nearest[nearest] == np.arange(len(near)))
    return path, head, mutual, ~mutual[:, None] | (words <= words[nearest])


def row_heads(points: np.ndarray, params: MediaParams = MediaParams()) -> np.ndarray:
    """The heads of ``row_paths``, one for every corner that has them."""
    if not len(points):
        return np.zeros(0, np.int64)
    _, head, _, speaks = _paths(_words(points, params), _near_corners(points, max(1, params.least - 1)), params)
    return head.astype(np.int64)[speaks]


def row_paths(points: np.ndarray, params: MediaParams = MediaParams()) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of an image, one per corner and band: the hash of the first ``least`` words, and, packed into
    one number, the words of the following corners, the earlier ones higher, then the corner's place (``PLACE_BITS``)."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, near = _words(points, params), _near_corners(points, params.most - 1)
    path, head, mutual, speaks = _paths(words, near, params)
    rest = np.zeros(words.shape, np.int64)
    for k in range(params.least, params.most):
        rest = (rest << params.band_bits) | path[:, :, k]
    scale = np.abs(points["s"][:, None] - 1 / np.array(params.scales)).argmin(axis=1)
    rest = (rest << PLACE_BITS) | (mutual * 256 + scale * 32 + _turn(points["a"]))[:, None]
    both = np.unique(np.stack([head.astype(np.int64)[speaks], rest[speaks]], axis=1), axis=0)
    return both[:, 0], both[:, 1]


# ---------------------------------------------------------------- consensus


def _halves(points: np.ndarray) -> np.ndarray:
    """Descriptors as two 64-bit words."""
    return np.ascontiguousarray(points["d"]).view("<u8")


def consensus(a: np.ndarray, b: np.ndarray, size_a: tuple, size_b: tuple, params: MediaParams = MediaParams()) -> int:
    """Corners of a that one similarity transform carries onto matching corners of b; 0 where that proves nothing."""
    if len(a) < params.min_inliers or len(b) < params.min_inliers:
        return 0
    (low_a, high_a), (low_b, high_b) = (_halves(p).T for p in (a, b))
    distance = np.bitwise_count(low_a[:, None] ^ low_b) + np.bitwise_count(high_a[:, None] ^ high_b)
    i = np.arange(len(a))
    j = distance.argmin(axis=1)
    good = (distance[i, j] <= params.max_distance) & (distance.argmin(axis=0)[j] == i)
    i, j = i[good], j[good]
    if len(i) < params.min_inliers:
        return 0
    scale = b["s"][j] / a["s"][i]
    turn = b["a"][j] - a["a"][i]
    turn = np.where(np.abs((turn + np.pi) % (2 * np.pi) - np.pi) < 0.3, 0.0, turn)
    za, zb = a["x"] + 1j * a["y"], b["x"] + 1j * b["y"]
    m = scale * np.exp(1j * turn)
    t = zb[j] - m * za[i]
    moved = m[:, None] * za[i][None] + t[:, None]
    inside = np.abs(moved - zb[j][None]) <= params.tolerance * np.maximum(1, np.abs(m))[:, None]
    best = int(inside.sum(axis=1).argmax())
    own = inside[best]
    if own.sum() < params.min_inliers:
        return 0
    # refit on the inliers, then count again
    x, y = za[i][own], zb[j][own]
    spread = np.abs(x - x.mean()) ** 2
    if spread.sum() < 1:
        return 0
    m1 = (np.conj(x - x.mean()) * (y - y.mean())).sum() / spread.sum()
    t1 = y.mean() - m1 * x.mean()
    if not 0.2 < abs(m1) < 5:
        return 0
    fits = int((np.abs(m1 * za[i] + t1 - zb[j]) <= params.tolerance * max(1, abs(m1))).sum())

    def seen(z: np.ndarray, size: tuple) -> int:
        edge = params.border
        return int(((z.real >= edge) & (z.real < size[1] - edge) & (z.imag >= edge) & (z.imag < size[0] - edge)).sum())

    overlap = min(seen(m1 * za + t1, size_b), seen((zb - t1) / m1, size_a))
    return fits if fits >= params.min_inliers and fits >= params.min_share * max(overlap, 1) else 0


# ---------------------------------------------------------------- pairs of a task


def shared_rows(left: list[np.ndarray], right: list[np.ndarray], params: MediaParams, step: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """Number of table rows that each image of ``left`` (its corners) shares with each of ``right``: (first of a part of ``left``, counts)."""

    def heads(part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.unique(row_heads(p, params)) for p in part]
        words, owner = np.concatenate(rows), np.repeat(np.arange(len(part), dtype=np.int32), [len(w) for w in rows])
        rows.clear()
        order = np.argsort(words, kind="stable")
        words = words[order]
        return words, owner[order]

    words, owner = heads(right)
    for at in range(0, len(left), step):
        part = left[at : at + step]
        own, who = heads(part)
        lo = np.searchsorted(words, own, "left")
        n = np.searchsorted(words, own, "right") - lo
        ends = np.cumsum(n)
        votes = np.zeros(len(part) * len(right), np.int64)
        start = 0
        while start < len(n):  # so many meetings at a time
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + 1_000_000, "right")))
            k = n[start:stop]
            met = np.repeat(lo[start:stop] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            votes += np.bincount(np.repeat(who[start:stop].astype(np.int64), k) * len(right) + owner[met], minlength=len(votes))
            start = stop
        yield at, votes.reshape(len(part), len(right))


@dataclass
class Corners:
    """The corners of many images, one after another: place, scale, angle, the two halves of the descriptors and their exclusive or
    (``fold``): two folds differ in no more bits than the descriptors do. Bits are in the order of ``_fold_order``."""

    z: np.ndarray
    s: np.ndarray
    a: np.ndarray
    low: np.ndarray
    high: np.ndarray
    fold: np.ndarray
    start: np.ndarray
    size: np.ndarray
    room: tuple

    @staticmethod
    def of(points: list[np.ndarray]) -> Corners:
        size = np.array([len(p) for p in points])
        flat = np.concatenate(points)
        low, high = (x.copy() for x in _halves(flat).T)
        if len(flat) >= LEARN:
            order = _fold_order(flat["d"])
            for at in range(0, len(flat), LEARN):
                bits = np.unpackbits(flat["d"][at : at + LEARN], axis=1)[:, order]
                low[at : at + LEARN], high[at : at + LEARN] = np.ascontiguousarray(np.packbits(bits, axis=1)).view("<u8").T
        room = np.empty(CELLS, np.uint64), np.empty(HELD_CELLS, np.uint8), np.empty(HELD_CELLS, bool)
        z, s, a = flat["x"] + 1j * flat["y"], flat["s"].copy(), flat["a"].copy()
        return Corners(z, s, a, low, high, low ^ high, np.cumsum(size) - size, size, room)


def _fold_order(descriptors: np.ndarray) -> np.ndarray:
    """An order of the bits in which the one of place k and the one half the bits on seldom differ together between two corners, so
    that few unlike descriptors have like folds. Any order gives the same links."""
    one, other = np.random.default_rng(3).integers(0, len(descriptors), (2, 20_000))
    apart = np.unpackbits(descriptors[one] ^ descriptors[other], axis=1).astype(np.float32)
    share = apart.mean(axis=0)
    single = share[:, None] + share - 2 * (apart.T @ apart) / len(apart)  # how often one of two bits differs alone
    np.fill_diagonal(single, -1)
    pairs = []
    for _ in range(TESTS // 2):  # first the bit whose best partner is the worst
        best = single.max(axis=1)
        best[[k for pair in pairs for k in pair]] = np.inf
        bit = int(best.argmin())
        partner = int(single[bit].argmax())
        pairs.append((bit, partner))
        single[[bit, partner]] = -1
        single[:, [bit, partner]] = -1
    return np.array(pairs).T.ravel()


def _close(corners: Corners, image: int, others: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Corners of ``image`` and of ``others`` at most ``most`` bits apart: (index of the one, index of the other, whose that is in
    ``others``, bits). Folds are compared first."""
    begin, count = corners.start[image], int(corners.size[image])
    own = corners.fold[begin : begin + count, None]
    size = corners.size[others]
    who = np.repeat(np.arange(len(others)), size)
    place = np.arange(len(who)) + np.repeat(corners.start[others] - (np.cumsum(size) - size), size)
    folds, found = corners.fold[place], [(np.zeros(0, np.int64),) * 2]
    words, bits, near = corners.room
    for lo in range(0, len(place), CELLS):
        part = folds[lo : lo + CELLS]
        width = -(-len(part) // 8) * 8  # eight results are looked at as one
        held = max(1, HELD_CELLS // width)
        for top in range(0, count, held):
            rows = min(held, count - top)
            apart = bits[: rows * width].reshape(rows, width)
            apart[:, len(part) :] = 255
            step = max(1, CELLS // width)
            for at in range(0, rows, step):
                few = own[top + at : top + min(at + step, rows)]
                differ = np.bitwise_xor(few, part, out=words[: len(few) * len(part)].reshape(len(few), len(part)))
                np.bitwise_count(differ, out=apart[at : at + step, : len(part)])
            eight = np.less_equal(bits[: rows * width], min(most, TESTS), out=near[: rows * width]).view(np.uint64)
            some = np.flatnonzero(eight != 0)
            k = np.flatnonzero(eight[some].view(bool))
            flat = some[k >> 3] * 8 + (k & 7)
            i = np.repeat(np.arange(rows), np.diff(np.searchsorted(flat, np.arange(rows + 1) * width)))
            j = flat - i * width + lo
            i += top
            found.append((i, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    at, to = i + begin, place[j]
    apart = np.bitwise_count(corners.low[at] ^ corners.low[to]) + np.bitwise_count(corners.high[at] ^ corners.high[to])
    k = np.flatnonzero(apart <= most)
    return i[k], to[k], who[j[k]], apart[k].astype(np.int64)


def _maybe(corners: Corners, image: int, others: np.ndarray, params: MediaParams) -> np.ndarray:
    """Which of ``others`` can have a consensus with ``image``: its first steps for many images at once, with a little more tolerance.
    They come out the same whichever of two images is the first."""
    out = np.zeros(len(others), bool)
    least, begin, count, total = params.min_inliers, corners.start[image], corners.size[image], int(corners.size.max())
    for at in range(0, len(others), 384):
        part = others[at : at + 384]
        i, place, who, apart = _close(corners, image, part, params.max_distance)
        # each corner's closest, the first of equals
        j = who * total + place - corners.start[part][who]
        mine = who * count + i
        to_one, to_other = apart * count + i, apart * (len(part) * total) + j
        none = np.iinfo(np.int64).max
        best_i, best_j = np.full(len(part) * total, none), np.full(len(part) * count, none)
        np.minimum.at(best_i, j, to_one)
        np.minimum.at(best_j, mine, to_other)
        mutual = (best_i[j] == to_one) & (best_j[mine] == to_other)
        n = np.bincount(who[mutual], minlength=len(part))
        mutual &= (n >= least)[who]
        i, place, who = i[mutual] + begin, place[mutual], who[mutual]
        if not len(i):
            continue
        order = np.argsort(who, kind="stable")
        i, place, who = i[order], place[order], who[order]
        n = np.bincount(who, minlength=len(part))
        turn = corners.a[place] - corners.a[i]
        turn = np.where(np.abs((turn + np.pi) % (2 * np.pi) - np.pi) < 0.3, 0.0, turn)
        za, zb, m = corners.z[i], corners.z[place], corners.s[place] / corners.s[i]
        reach = (params.tolerance * np.maximum(1, m) + 0.01) ** 2
        m = m * np.exp(1j * turn)
        # every match's transform against every match of the same image
        k = n[who]
        guess = np.repeat(np.arange(len(who)), k)
        match = np.repeat((np.cumsum(n) - n)[who] - (np.cumsum(k) - k), k) + np.arange(len(guess))
        off = m[guess] * (za[match] - za[guess]) - (zb[match] - zb[guess])
        inside = off.real**2 + off.imag**2 <= reach[guess]
        fits = np.bincount(guess[inside], minlength=len(who))
        out[at + who[fits >= least]] = True
    return out


def linked_pairs(ids: np.ndarray, points: list[np.ndarray], sizes: list[tuple], side: np.ndarray, params: MediaParams, done: np.ndarray | None = None) -> np.ndarray:
    """Index pairs of verified links. ids ascend; side: 0 for one block (all pairs), else 1 and 2 (pairs across). Pairs of two ``done``
    images are left out."""
    one = bool((side == 0).all())
    l, r = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    found = []
    if not len(l) or not len(r):
        return np.zeros((0, 2), np.int64)
    corners = None
    for at, votes in shared_rows([points[i] for i in l], [points[i] for i in r], params):
        corners = corners or Corners.of(points)  # not beside the rows while these are sorted
        for row, v in enumerate(votes):
            i = int(l[at + row])
            near = r[v >= (params.votes + 1) // 2]  # a row may stand for two meetings
            near = near[near > i] if one else near
            if done is not None and done[i]:
                near = near[~done[near]]
            if not len(near):
                continue
            for j in near[_maybe(corners, i, near, params)].tolist():
                x, y = (j, i) if ids[j] > ids[i] else (i, j)
                if consensus(points[x], points[y], sizes[x], sizes[y], params):
                    found.append((i, j))
    return np.array(found, np.int64).reshape(-1, 2)


# ---------------------------------------------------------------- Spark


def describe(media: DataFrame, params: MediaParams = MediaParams()) -> DataFrame:
    """id, d1, d2 (digest of the pixels), h, w, n, points (packed): one row per decodable image with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("n", pa.int32()), ("points", pa.binary())]
        )
        for batch in _slices(batches, 256):
            by_shape: dict[tuple, list] = {}
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = decode_image(raw.as_py())
                if image is not None:
                    by_shape.setdefault(image.shape, []).append((k, image))
            for (h, w), group in by_shape.items():
                step = max(1, 262_144 // (h * w))
                for at in range(0, len(group), step):
                    part = group[at : at + step]
                    found = describe_batch(np.stack([x[1] for x in part]), params)
                    rows = []
                    for (k, image), p in zip(part, found, strict=True):
                        digest = np.frombuffer(xxhash.xxh3_128_digest(b"%d %d " % (h, w) + image.tobytes()), "<i8")
                        rows.append({"id": k, "d1": int(digest[0]), "d2": int(digest[1]), "h": h, "w": w, "n": len(p), "points": p.tobytes()})
                    yield pa.RecordBatch.from_pylist(rows, schema)

    rows = media.where(F.col("id").isNotNull() & F.col("image").isNotNull()).select("id", "image")
    return rows.mapInArrow(run, "id long, d1 long, d2 long, h int, w int, n int, points binary")


def table_rows(described: DataFrame, params: MediaParams) -> DataFrame:
    """id, head, rest: the rows of the Hamming tables that each image lies in (see ``row_paths``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 512):
            paths = [row_paths(np.frombuffer(p.as_py(), POINT), params) for p in batch.column(1)]
            if not paths:
                continue
            ids = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(p[0]) for p in paths])
            columns = [ids, *(np.concatenate([p[k] for p in paths]) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "head", "rest"])

    return described.select("id", "points").mapInArrow(run, "id long, head long, rest long")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def meetings(ids: np.ndarray, head: np.ndarray, rest: np.ndarray, params: MediaParams) -> tuple[np.ndarray, ...]:
    """(a, b, tie, scale, turn, weight) of rows sorted by head, rest and id, a > b: all pairs of the rows that are not crowded (the
    others are the business of ``crowd_links``). scale and turn: how a's corner differs from b's. tie is false."""
    found = []
    place = (rest & ((1 << PLACE_BITS) - 1)).astype(np.int32)
    run = np.cumsum(_starts(head)) - 1
    small = (np.bincount(run, minlength=len(ids)) <= params.crowd)[run]
    for apart in range(1, max(2, params.crowd)):
        one = np.flatnonzero(small[:-apart] & (run[:-apart] == run[apart:]))
        other = one + apart
        differ = ids[one] != ids[other]
        one, other = one[differ], other[differ]
        one, other = np.where(ids[one] > ids[other], (one, other), (other, one))
        scale, turn = (place[one] >> 5 & 7) - (place[other] >> 5 & 7), ((place[one] & 31) - (place[other] & 31)) % TURNS
        found.append((ids[one], ids[other], np.zeros(len(one), bool), scale, turn, 1 + ((place[one] & place[other]) >> 8)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def row_meetings(rows: DataFrame, params: MediaParams) -> DataFrame:
    """a, b, tie, scale, turn, weight of all rows; each task walks its sorted rows and holds those of one head, or a fixed number of them."""
    hold, names = 262_144, ["a", "b", "tie", "scale", "turn", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        for batch in _ending(batches):
            if batch is not None:
                kept = [np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
                if len(kept[0]) < hold:
                    continue
            cut = len(kept[0])
            if batch is not None:  # the last head may go on; a head that fills the task's hold is cut at its last full row
                for keys in (kept[1:2], [kept[1], kept[2] >> PLACE_BITS]):
                    cut = int(np.flatnonzero(_starts(*keys))[-1])
                    if cut:
                        break
                if not cut:
                    continue
            part, kept = [k[:cut] for k in kept], [k[cut:] for k in kept]
            if cut:
                met = meetings(*part, params)
                for at in range(0, len(met[0]), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536]) for x in met], names=names)

    dealt = rows.select("id", "head", "rest").repartition("head").sortWithinPartitions("head", "rest", "id")
    return dealt.mapInArrow(run, "a long, b long, tie boolean, scale int, turn int, weight int")


def _ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def popular_rows(able: DataFrame, params: MediaParams) -> DataFrame:
    """head, path of the rows that about ``popular`` images or more share, by one image in 256."""
    drawn = _pathed(table_rows(able.where(F.pmod(F.xxhash64("id"), F.lit(256)) == 0), params))
    least = max(2, params.popular // 256)
    return drawn.groupBy("head", "path").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("head", "path")


def _pathed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", F.shiftright("rest", PLACE_BITS))


def crowded_images(able: DataFrame, params: MediaParams) -> DataFrame:
    """id of the images that lie in a row (of ``least`` corners) with more than ``crowd`` entries. A corner whose row its image
    has already counts too, so ``meetings`` finds no row of another image crowded."""
    hold = 1_048_576

    def list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 512):
            heads = [row_heads(np.frombuffer(p.as_py(), POINT), params) for p in batch.column(1)]
            if heads:
                ids = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(h) for h in heads])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(heads))], names=["id", "head"])

    def list_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, head = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _ending(batches):
            if batch is not None:
                ids, head = (np.concatenate([k, batch.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate((ids, head)))
                if len(ids) < hold:
                    continue
            begin = np.flatnonzero(_starts(head))
            size = np.diff(np.append(begin, len(head)))
            found = np.unique(ids[np.repeat(size > params.crowd, size)])
            for at in range(0, len(found), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 65_536])], names=["id"])
            if batch is not None:  # of the last row, which may go on, as many entries as tell whether it is crowded
                last = max(int(begin[-1]), len(head) - params.crowd - 1)
                ids, head = ids[last:], head[last:]

    rows = able.select("id", "points").mapInArrow(list_rows, "id long, head long")
    return rows.repartition("head").sortWithinPartitions("head").mapInArrow(list_images, "id long").distinct()


def quiet_rows(able: DataFrame, crowded: DataFrame, params: MediaParams) -> DataFrame:
    """The table rows of ``able`` that hold an image which is not ``crowded``. None has more than ``crowd`` entries."""
    heads = common.written(table_rows(able.join(crowded, "id", "left_anti"), params).select("head").distinct(), "media-heads")
    return table_rows(able, params).join(F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads, "head", "left_semi")


def candidate_ties(able: DataFrame, params: MediaParams, rows: DataFrame | None = None) -> DataFrame:
    """a, b (a > b, distinct): pairs with ``votes`` meetings that agree in rows that are not crowded. rows: those to look at; without
    them all rows; images that lie in a row which very many share are tied to its smallest, and their other rows are not looked at."""
    popular, known = None, 0
    if rows is None:
        rows = table_rows(able, params)
        popular = common.written(popular_rows(able, params), "media-popular")
        known = popular.count()
    met = row_meetings(rows, params)
    if known:
        small = known <= 100_000
        row, rows = ["head", "path"], _pathed(rows)
        shared = rows.join(F.broadcast(popular) if small else popular, row)
        smallest = shared.groupBy(*row).agg(F.min("id").alias("b"))
        ties = shared.join(F.broadcast(smallest) if small else smallest, row).where("id > b")
        rest = rows.join(shared.select("id").distinct(), "id", "left_anti")
        met = row_meetings(rest, params).unionByName(
            ties.select(F.col("id").alias("a"), "b", F.lit(True).alias("tie"), *[F.lit(0).alias(c) for c in ("scale", "turn", "weight")])
        )
    # the sum of vectors is as long as the number of meetings that agree on the turn
    angle = F.col("turn") * (2 * np.pi / TURNS)
    votes = met.groupBy("a", "b", "scale").agg(F.sum(F.cos(angle) * F.col("weight")).alias("c"), F.sum(F.sin(angle) * F.col("weight")).alias("s"), F.max("tie").alias("tie"))
    return votes.where((F.hypot("c", "s") >= params.votes * np.cos(np.pi / 8)) | F.col("tie")).select("a", "b").distinct()


def verified(shown: DataFrame, comps: DataFrame, params: MediaParams) -> DataFrame:
    """id, n_links, root (smallest image reached): one row per image and task. Every pair of a component meets in one task, and is
    compared unless both are ``crowded``."""
    sized = comps.join(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("m")), "comp")
    packs = max(1, -(-sized.count() // params.block))
    placed = sized.select(F.col("node").alias("id"), "comp", F.ceil(F.col("m") / params.block).cast("int").alias("nb")).withColumn(
        "blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    )
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda o: F.struct(
            F.least("blk", o).alias("i"),
            F.greatest("blk", o).alias("j"),
            F.when(F.col("blk") == o, 0).when(F.col("blk") < o, 1).otherwise(2).alias("side"),
        ),
    )
    # small components share tasks; a task of a large one has two blocks
    pack = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.xxhash64("comp", "t.i", "t.j"))
    dealt = shown.join(placed, "id").withColumn("t", F.explode(tasks)).select(
        "id", "comp", "t.i", "t.j", "t.side", "points", "h", "w", "crowded", (F.col("nb") == 1).alias("whole"), pack.alias("pack")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["comp", "i", "j", "id"])
        cuts = np.flatnonzero((pdf[["comp", "i", "j"]].diff().fillna(1) != 0).any(axis=1).to_numpy())
        ids, side, done = pdf["id"].to_numpy(np.int64), pdf["side"].to_numpy(), pdf["crowded"].to_numpy(bool)
        points = [np.frombuffer(b, POINT) for b in pdf["points"]]
        sizes = list(zip(pdf["h"].tolist(), pdf["w"].tolist(), strict=True))
        count, root = np.zeros(len(pdf), np.int64), ids.copy()
        for lo, hi in zip(cuts, np.append(cuts[1:], len(pdf)), strict=True):
            if hi - lo > 1:
                pairs = linked_pairs(ids[lo:hi], points[lo:hi], sizes[lo:hi], side[lo:hi], params, done[lo:hi])
                count[lo:hi] = np.bincount(pairs.ravel(), minlength=hi - lo)
                root[lo:hi] = ids[lo:hi][_roots(hi - lo, pairs)]
        return pd.DataFrame({"id": ids, "n_links": count, "root": root})

    return dealt.groupBy("whole", "pack").applyInPandas(compare, "id long, n_links long, root long")


def crowd_links(shown: DataFrame, count: int, params: MediaParams) -> DataFrame:
    """id, n_links, root as of ``verified``, for the ``count`` images of ``shown``: all pairs with rows in common, however many images
    share the rows. A task compares two blocks of about ``wide`` images, fewer where a table is small."""
    cores = shown.sparkSession.sparkContext.defaultParallelism
    nb = max(-(-count // params.wide), min(-(-count // params.block), int(np.ceil(np.sqrt(4 * cores)))))
    tasks = F.transform(
        F.sequence(F.lit(0), F.lit(nb - 1)),
        lambda o: F.struct(
            (F.greatest("blk", o) * (F.greatest("blk", o) + 1) / 2 + F.least("blk", o)).cast("int").alias("task"),
            F.when(F.col("blk") == o, 0).when(F.col("blk") < o, 1).otherwise(2).alias("side"),
        ),
    )
    blocks = shown.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int"))
    dealt = blocks.withColumn("t", F.explode(tasks)).select("id", "points", "h", "w", "t.side", "t.task").repartitionById(nb * (nb + 1) // 2, "task").drop("task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not sum(b.num_rows for b in held):
            return
        ids, h, w, side = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("id", "h", "w", "side"))
        points = [np.frombuffer(p.as_py(), POINT) for b in held for p in b.column("points")]
        held.clear()
        order = np.argsort(ids)
        ids, side, points = ids[order], side[order], [points[k] for k in order]
        pairs = linked_pairs(ids, points, list(zip(h[order].tolist(), w[order].tolist(), strict=True)), side, params)
        links = np.bincount(pairs.ravel(), minlength=len(ids))
        some = links > 0
        columns = [ids[some], links[some], ids[_roots(len(ids), pairs)][some]]
        for at in range(0, int(some.sum()), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65_536]) for c in columns], names=["id", "n_links", "root"])

    return dealt.mapInArrow(compare, "id long, n_links long, root long")


def copy_classes(media: DataFrame, params: MediaParams = MediaParams()) -> DataFrame:
    """id, decoded, n_points, pixel_id (smallest id with the same pixels), class_id, n_links for every row of ``media``."""
    described = common.written(describe(media, params), "media-points")
    if not described.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        first = described.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("x")).select("id", "x.d1", "x.d2")
        described = common.written(described.join(first, ["id", "d1", "d2"]).dropDuplicates(["id"]), "media-points")
    pixels = ["d1", "d2"]
    heads = described.groupBy(*pixels).agg(F.min("id").alias("pixel_id"))
    owners = common.written(described.select("id", "n", *pixels).join(heads, pixels).select("id", "n", "pixel_id"), "media-pixels")
    copies = owners.where("id <> pixel_id").select("id")
    distinct = described if copies.isEmpty() else described.join(copies, "id", "left_anti")
    # fewer corners than a consensus needs make no link
    able = distinct.where(F.col("n") >= params.min_inliers)
    crowded = common.written(crowded_images(able, params), "media-crowded")
    many = crowded.count()
    if many:
        listed = F.broadcast(crowded) if many <= BROADCAST_ROWS else crowded
        links = [crowd_links(able.join(listed, "id"), many, params)]
        quiet = not able.join(listed, "id", "left_anti").isEmpty()
        rows = quiet_rows(able, listed, params) if quiet else None
        shown = able.join(listed.withColumn("crowded", F.lit(True)), "id", "left").fillna(False, ["crowded"])
    else:
        links, quiet, rows, shown = [], True, table_rows(able, params), able.withColumn("crowded", F.lit(False))
    if quiet:
        ties = common.written(candidate_ties(able, params, rows), "media-ties")
        together = common.written(components(ties), "media-together")
        links.append(verified(shown.select("id", "points", "h", "w", "crowded"), together, params))
    seen = common.written(reduce(DataFrame.unionByName, links), "media-links")
    both = seen.where("n_links > 0").groupBy(F.col("id").alias("a")).agg(F.sum("n_links").alias("n_links"))
    links = seen.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    comps = components(links) if not links.isEmpty() else None
    found = owners.join(both.select(F.col("a").alias("pixel_id"), "n_links"), "pixel_id", "left")
    if comps is not None:
        found = found.join(comps.select(F.col("node").alias("pixel_id"), "comp"), "pixel_id", "left")
    else:
        found = found.withColumn("comp", F.lit(None).cast("long"))
    found = found.select(
        F.col("id").alias("__id"), "pixel_id", F.col("n").alias("__n"), F.coalesce("comp", "pixel_id").alias("__class"), F.col("n_links").alias("__links")
    )
    joined = media.select("id").join(found, F.col("id") == F.col("__id"), "left")
    return joined.select(
        "id", F.col("__id").isNotNull().alias("decoded"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_points"), F.coalesce("pixel_id", "id").alias("pixel_id"),
        F.coalesce("__class", "id").alias("class_id"), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
    )
