"""Near joins, media, language model, BPE, WARC, toxicity and the pipeline."""

import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import bpe, language_model, media, near_join, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_counts(rows):
    return Counter(map(repr, rows))


# ---------------------------------------------------------------- near join


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    head = {}
    for i in sorted(sets):
        head.setdefault(sets[i], i)
    reps = [(i, s) for s, i in head.items() if s]
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(reps)):
        for b in range(a + 1, len(reps)):
            (i, s), (j, t) = reps[a], reps[b]
            both = len(s & t)
            if both and both / len(s | t) >= 0.8:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = []
    for i, t, *_ in rows:
        if i is None:
            out.append((None, None, None, 0))
        elif not sets[i]:
            out.append((i, i, i, 0))
        else:
            out.append((i, head[sets[i]], find(head[sets[i]]), links[head[sets[i]]]))
    return out


def near_rows(n=90, copies=14, seed=1):
    """Groups of near copies around the threshold, among texts that share passages."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocab) for _ in range(55)]
    rows = []
    for i in range(n):
        rows.append([rng.choice(vocab) for _ in range(rng.randint(3, 120))] + (passage if i % 3 == 0 else []))
    for i in range(copies):
        base = list(rows[i % 4 * 3])
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(vocab)
        rows.append(base)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_near_classes(spark, odd_docs, plain_rows, no_docs):
    for rows, docs in (
        (near_rows(), None),
        (plain_rows, odd_docs),
    ):
        docs = docs if docs is not None else spark.createDataFrame(rows, "doc_id long, text string")
        got = near_join.near_classes(docs).collect()
        assert by_counts(tuple(r) for r in got) == by_counts(brute_classes(rows))
    assert near_join.near_classes(no_docs).count() == 0


def test_large_groups_are_cut_into_blocks(spark):
    rows = near_rows(20, 60, seed=3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_join.near_classes(docs, near_join.NearParams(block=8)).collect()
    assert by_counts(tuple(r) for r in got) == by_counts(brute_classes(rows))


def boilerplate_rows(n, groups=6, copies=5, seed=8):
    """Texts of 110 words that share 64 of them (similarity about 0.39), and groups of near copies among them."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    shared = [rng.choice(vocab) for _ in range(64)]
    rows = [shared + [rng.choice(vocab) for _ in range(46)] for _ in range(n)]
    for g in range(groups):
        for k in range(copies):
            rows.append([*rows[g][:-1 - k], *[rng.choice(vocab) for _ in range(1 + k)]])
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_common_passages_make_no_crowds(spark):
    """The pairs compared grow with the texts, not with their square, and no link is lost."""
    p = near_join.NearParams(crowd=8)
    compared = {}
    for n in (150, 600):
        rows = boilerplate_rows(n)
        docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string")  # repeated rows too
        signed = near_join.signatures(docs, p)
        reps = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        reps = near_join.common.written(reps, "test-reps")
        loose = near_join.components(near_join.adaptive_ties(reps, p)).groupBy("comp").count().agg(F.max("count")).first()[0]
        sizes = [r["count"] for r in near_join.candidate_components(docs, reps, p).groupBy("comp").count().collect()]
        compared[n] = sum(m * (m - 1) // 2 for m in sizes)
        assert max(sizes) <= 8 < n / 4 < loose
    assert compared[600] <= 5 * max(compared[150], 90)
    for held in (1_000_000, 0):  # the counts sent to the texts, or met in a join
        got = near_join.near_classes(docs, near_join.NearParams(crowd=8, broadcast_rows=held)).collect()
        assert by_counts(tuple(r) for r in got) == by_counts(brute_classes(rows + rows[:40]))


def test_groups_of_copies_stay_whole(spark):
    """A large component of near copies is no crowd; one that passages chain is, though it holds copies."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    copies = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(60)]
    chained = [(1000 + i, t) for i, t in boilerplate_rows(150)]
    p = near_join.NearParams(crowd=8)
    docs = spark.createDataFrame(copies + chained, "doc_id long, text string")
    signed = near_join.signatures(docs, p)
    reps = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    reps = near_join.common.written(reps, "test-reps")
    ties = near_join.adaptive_ties(reps, p)
    comps = near_join.common.written(near_join.components(ties), "test-comps")
    mixed = {r.comp for r in near_join.mixed_crowds(ties, reps, comps, p).collect()}
    assert 0 not in mixed and mixed and min(mixed) >= 1000
    got = near_join.near_classes(docs, p).collect()
    assert by_counts(tuple(r) for r in got) == by_counts(brute_classes(copies + chained))


def test_prefixes_are_shortened(spark):
    """Recall of the start depth falls short for links at the threshold, so the depth shrinks until the bound holds."""
    p = near_join.NearParams()
    assert near_join.found_chance(0.8, p.start_depth, p.trees) < p.target
    assert near_join.found_chance(0.8, 4, p.trees) >= p.target
    docs = spark.createDataFrame(near_rows(), "doc_id long, text string")
    signed = near_join.signatures(docs, p)
    reps = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"))
    deep, shallow = (near_join.forest_ties(reps, d, p).count() for d in (8, 2))
    assert shallow >= deep


@pytest.mark.parametrize("close", [0, 6000])
def test_recall_holds_at_the_threshold(spark, close):
    """Links at 0.80 to 0.83 are found, alone and beside many close copies."""
    p, rng = near_join.NearParams(), np.random.default_rng(6)
    n = 3000
    share = np.concatenate([rng.uniform(0.8, 0.83, n), np.full(close, 0.97)])
    left = rng.integers(0, 2**16, (len(share), p.trees * p.depth)).astype("<u2")
    same = rng.random(left.shape) < share[:, None]
    right = np.where(same, left, rng.integers(0, 2**16, left.shape)).astype("<u2")
    rows = [(2 * i + k, x.tobytes()) for i, pair in enumerate(zip(left, right)) for k, x in enumerate(pair)]
    ties = near_join.adaptive_ties(spark.createDataFrame(rows, "node long, sig binary"), p).collect()
    found = {r.b // 2 for r in ties if r.a // 2 == r.b // 2 < n}
    assert len(found) / n >= p.target


def test_one_of_each_group_stays(odd_docs, plain_rows, no_docs):
    got = near_join.drop_near_copies(odd_docs)
    assert got.columns == odd_docs.columns
    heads = {c for _, _, c, _ in brute_classes(plain_rows) if c is not None}
    want = [r for r in plain_rows if r[0] is None or r[0] in heads]
    assert by_counts(tuple(r)[:5] for r in got.collect()) == by_counts(want)
    assert near_join.drop_near_copies(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    ties = spark.createDataFrame(edges * 2, "a long, b long").repartition(8)
    for held in (1_000_000, 20):
        got = near_join.components(ties, held).collect()
        assert {r.node: r.comp for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert near_join.components(ties.limit(0)).count() == 0


# ---------------------------------------------------------------- media


def scene(seed, h=96, w=96):
    rng = np.random.default_rng(seed)
    image = np.full((h, w), 128.0)
    for _ in range(40):
        y, x = rng.integers(0, h - 12), rng.integers(0, w - 12)
        image[y : y + rng.integers(5, 25), x : x + rng.integers(5, 25)] = rng.integers(0, 255)
    return image.astype(np.uint8)


def test_copies_are_found(spark, no_docs):
    rng = np.random.default_rng(5)
    images = [scene(i) for i in range(6)]
    edited = np.clip(images[0] + rng.normal(0, 3, images[0].shape), 0, 255).astype(np.uint8)
    edited[10:30, 10:30] = 255
    cropped, turned = images[1][20:90, 15:95], np.rot90(images[2]).copy()
    lit = np.clip(images[3] * 0.8 + 20, 0, 255).astype(np.uint8)
    rows = [*enumerate(map(media.encode_pgm, images)), (10, media.encode_pgm(edited)), (11, media.encode_pgm(cropped))]
    rows += [(12, media.encode_pgm(turned)), (13, media.encode_pgm(lit)), (14, media.encode_pgm(images[4])), (15, None), (16, b"junk"), (None, b"P5")]
    rows += [(17, media.encode_pgm(np.zeros((64, 64), np.uint8))), (18, b"P6\n2 1\n255\n" + bytes(6))]
    got = {r.id: r for r in media.copy_classes(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].class_id for i in (10, 11, 12, 13, 14)} == {10: 0, 11: 1, 12: 2, 13: 3, 14: 4}
    assert got[14].pixel_id == 4 and got[5].class_id == 5 and got[5].n_links == 0
    assert got[15].class_id == 15 and got[16].class_id == 16 and got[None].class_id is None
    empty = spark.createDataFrame([], "id long, image binary")
    assert media.copy_classes(empty).count() == 0


def brute_copies(images, params):
    """class_id and n_links of images by id: every pair with enough shared table rows is verified."""
    points = {i: media.describe_batch(x[None], params)[0] for i, x in images.items()}
    words = {i: set(media.row_paths(p, params)[0].tolist()) for i, p in points.items()}
    links, root = Counter(), {i: i for i in images}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(images):
        for b in sorted(images):
            if a > b and len(words[a] & words[b]) >= (params.votes + 1) // 2:
                if media.consensus(points[a], points[b], images[a].shape, images[b].shape, params):
                    links.update((a, b))
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in images}


@pytest.mark.parametrize("block", [4096, 4])
def test_copies_are_found_beside_strangers(spark, block):
    """Strangers with smaller ids lie in every table row that the copies share, a few rows each."""
    params = media.MediaParams(block=block)
    shared = scene(50)
    copies = {100: shared, 101: np.clip(shared * 0.9 + 12, 0, 255).astype(np.uint8), 102: shared[4:, 4:], 103: shared[:90, :92]}
    images = dict(copies)
    for k, (y, x) in enumerate((y, x) for y in range(0, 72, 12) for x in range(0, 72, 12)):
        other = scene(200 + k)
        other[72 - y : 96 - y, 72 - x : 96 - x] = shared[y : y + 24, x : x + 24]
        images[k] = other
    want = brute_copies(images, params)
    assert len({want[i][0] for i in copies}) == 1 and all(want[i][1] >= 3 for i in copies)
    rows = [(i, media.encode_pgm(x)) for i, x in images.items()]
    got = media.copy_classes(spark.createDataFrame(rows, "id long, image binary"), params).collect()
    assert {r.id: (r.class_id, r.n_links) for r in got} == want


@pytest.mark.parametrize("params", [media.MediaParams(), media.MediaParams(block=4), media.MediaParams(crowd=2)])
def test_pairs_of_crowded_rows_are_found(spark, params):
    """The corners that noisy copies share lie in rows that many strangers crowd, and the rows' next corners differ."""
    rng = np.random.default_rng(9)
    images = {}
    for c in range(6):
        whole = scene(900 + c)
        for k in range(2):
            images[1000 + 2 * c + k] = np.clip(whole + rng.normal(0, 10 + 2 * c, whole.shape), 0, 255).astype(np.uint8)
        for k in range(16):
            other = scene(100 * c + k)
            y, x = 14 * (k // 4), 14 * (k % 4)
            other[54 - y : 96 - y, 54 - x : 96 - x] = whole[y : y + 42, x : x + 42]
            images[16 * c + k] = other
    want = brute_copies(images, params)
    assert sum(want[i][1] > 0 for i in images) > 12
    rows = spark.createDataFrame([(i, media.encode_pgm(x)) for i, x in images.items()], "id long, image binary")
    got = media.copy_classes(rows, params).collect()
    assert {r.id: (r.class_id, r.n_links) for r in got} == want


@pytest.mark.parametrize("learn, cells, held", [(1 << 60, 65_536, 4_194_304), (1, 65_536, 4_194_304), (1, 256, 1024)])
def test_close_corners_are_found_with_less_counting(monkeypatch, learn, cells, held):
    """All corners within the distance, whatever the order of the bits and the size of the parts; about one word is counted for two corners."""
    for name, value in (("LEARN", learn), ("CELLS", cells), ("HELD_CELLS", held)):
        monkeypatch.setattr(media, name, value, raising=False)
    rng = np.random.default_rng(3)
    drawn = [media.draw_vector(rng.normal(size=64)) for _ in range(40)]
    drawn += [np.clip(drawn[k] + rng.normal(0, 4, drawn[k].shape), 0, 255).astype(np.uint8) for k in range(10)]
    points = media.describe_batch(np.stack(drawn))
    points.insert(7, points[0][:0])  # an image without corners
    corners = media.Corners.of(points)
    counted, compared, count = 0, 0, np.bitwise_count

    def counting(words, *args, **kwargs):
        nonlocal counted
        counted += words.size
        return count(words, *args, **kwargs)

    for most in (20, 128):
        for a in (0, 7, 12):
            others = np.setdiff1d(np.arange(len(points)), [a])
            want = set()
            for who, b in enumerate(others):
                apart = count(points[a]["d"][:, None] ^ points[b]["d"]).sum(axis=2, dtype=int)
                compared += apart.size * (most == 20)
                want |= {(i, int(corners.start[b]) + j, who, int(apart[i, j])) for i, j in np.argwhere(apart <= most).tolist()}
            with monkeypatch.context() as patch:
                if most == 20:
                    patch.setattr(np, "bitwise_count", counting)
                got = list(zip(*(x.tolist() for x in media._close(corners, a, others, most)), strict=True))
            assert len(got) == len(want) and set(got) == want
    assert compared and counted < 1.3 * compared


def resized(image, factor):
    return np.clip(media._shrink(image.shape[0], factor) @ image.astype(np.float32) @ media._shrink(image.shape[1], factor).T, 0, 255).astype(np.uint8)


def turned_by(image, degrees):
    """About the middle, linear between pixels, edges repeated."""
    h, w = image.shape
    t, (y, x) = np.deg2rad(degrees), np.mgrid[:h, :w]
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    sy, sx = -np.sin(t) * x + np.cos(t) * y + (h - 1) / 2, np.cos(t) * x + np.sin(t) * y + (w - 1) / 2
    y0, x0 = np.clip(np.floor(sy).astype(int), 0, h - 2), np.clip(np.floor(sx).astype(int), 0, w - 2)
    fy, fx, f = np.clip(sy - y0, 0, 1), np.clip(sx - x0, 0, 1), image.astype(float)
    rows = [f[y0 + d, x0] * (1 - fx) + f[y0 + d, x0 + 1] * fx for d in (0, 1)]
    return (rows[0] * (1 - fy) + rows[1] * fy).astype(np.uint8)


def test_recall_of_edits(spark):
    """Of the edited copies that consensus of all pairs links, the tables find 0.9 or more, for every kind of edit."""
    rng = np.random.default_rng(31)
    edits = {
        "brighter": lambda i: np.clip(i * 0.8 + 20, 0, 255).astype(np.uint8), "noise": lambda i: np.clip(i + rng.normal(0, 8, i.shape), 0, 255).astype(np.uint8),
        "crop 0.66": lambda i: i[6:58, 6:58], "crop 0.39": lambda i: i[12:52, 10:50], "quarter turn": lambda i: np.rot90(i).copy(),
        "turn of 20": lambda i: turned_by(i, 20), "larger": lambda i: resized(i, 1.5), "smaller": lambda i: resized(i, 0.75),
    }
    n = 40
    params, images = media.MediaParams(), {}
    for k, edit in enumerate(edits.values()):
        for i in range(n):
            whole = media.draw_vector(rng.normal(size=64))
            images[k * n + i], images[10_000 + k * n + i] = whole, edit(whole)
    points = {i: media.describe_batch(x[None], params)[0] for i, x in images.items()}
    rows = spark.createDataFrame([(i, media.encode_pgm(x)) for i, x in images.items()], "id long, image binary")
    got = {r.id: r.class_id for r in media.copy_classes(rows, params).collect()}
    recall = {}
    for k, name in enumerate(edits):
        pairs = [(10_000 + i, i) for i in range(k * n, k * n + n)]
        linked = [(a, b) for a, b in pairs if media.consensus(points[a], points[b], images[a].shape, images[b].shape, params)]
        assert len(linked) >= n / 2, name
        recall[name] = sum(got[a] == got[b] for a, b in linked) / len(linked)
    assert min(recall.values()) >= 0.9, recall
    assert all(c % 10_000 == i % 10_000 for i, c in got.items())  # no stranger joined


def test_popular_rows_are_tied(spark):
    """Rows that very many images share are tied through an aggregation; the classes stay the same."""
    image = scene(77)
    rng = np.random.default_rng(4)
    images = {i: np.clip(image + rng.normal(0, 2, image.shape), 0, 255).astype(np.uint8) for i in range(600)}
    images |= {1000 + i: scene(300 + i) for i in range(10)}
    rows = spark.createDataFrame([(i, media.encode_pgm(x)) for i, x in images.items()], "id long, image binary")
    able = media.common.written(media.describe(rows), "test-points")
    low = media.MediaParams(popular=512)
    assert media.popular_rows(able, low).count() > 0
    ties = media.candidate_ties(able, low).collect()
    comps = {r.node: r.comp for r in near_join.components(media.candidate_ties(able, low)).collect()}
    assert all(r.a > r.b for r in ties) and {comps[i] for i in range(600)} == {0}
    assert not any(i in comps and comps[i] == 0 for i in range(1000, 1010))


def png(image, kind=0, filters=(0,)):
    """A PNG of a grey, colour or alpha image; filters in turn, line by line."""
    h, w = image.shape[:2]
    flat = image.reshape(h, -1).astype(int)
    step, lines, above = flat.shape[1] // w, [], np.zeros(flat.shape[1], int)
    for y in range(h):
        left = np.concatenate([np.zeros(step, int), flat[y][:-step]])
        corner = np.concatenate([np.zeros(step, int), above[:-step]])
        near = np.array([min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left, above, corner)])
        f = filters[y % len(filters)]
        lines.append(bytes([f]) + ((flat[y] - [0, left, above, (left + above) // 2, near][f]) & 255).astype(np.uint8).tobytes())
        above = flat[y]
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)), (b"IDAT", zlib.compress(b"".join(lines))), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def test_png_is_read(spark):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (9, 7)).astype(np.uint8), rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    for filters in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)):
        assert (media.decode_image(png(grey, 0, filters)) == grey).all()
        assert (media.decode_image(png(colour, 2, filters)) == media._grey(colour)).all()
    data = png(grey)
    for broken in (data[:30], data[:-20][:50], data.replace(b"IDAT", b"XDAT"), b"\x89PNG\r\n\x1a\n", png(grey, 3)):
        assert media.decode_image(broken) is None
    big = scene(5)
    rows = [(1, png(big)), (2, media.encode_pgm(big)), (3, b"\xff\xd8\xff\xe0"), (2, media.encode_pgm(big)), (2, png(scene(6)))]
    frame = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "id long, image binary, n double, pixel_id string")
    got = media.copy_classes(frame).collect()
    assert sorted((r.id, r.decoded) for r in got) == [(1, True), (2, True), (2, True), (2, True), (3, False)]
    assert {r.class_id for r in got if r.id == 3} == {3} and len({r.class_id for r in got if r.id == 2}) == 1


def test_odd_vectors(spark):
    rows = [(1, [0.0] * 4), (2, [float("nan"), 1.0, float("inf"), -1.0]), (3, None), (4, []), (None, [1.0] * 4), (5, [1.0, 2.0, 3.0, 4.0]), (6, [1.0, 2.0, 3.0, 4.0])]
    got = {r.id: r for r in media.copy_classes(media.vector_media(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()}
    assert len(got) == 7 and not got[3].decoded and not got[4].decoded and got[1].decoded and got[None].class_id is None
    assert got[6].class_id == 5 and got[6].pixel_id == 5 and got[1].class_id == 1


# ---------------------------------------------------------------- language model


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def kneser_ney(train):
    pairs, count = Counter(), Counter()
    for t in train:
        w = tokens(t)
        count.update(w)
        pairs.update(zip([0, *w[:-1]], w))
    n, v = sum(count.values()), len(count)
    contexts = Counter(w for _, w in pairs)

    def steps(values):
        k = [sum(c == i for c in values) for i in (1, 2, 3, 4)]
        if not all(k):
            return [0, 0.5, 0.5, 0.5]
        y = k[0] / (k[0] + 2 * k[1])
        return [0, *(min(max(i - (i + 1) * y * k[i] / k[i - 1], 0), i) for i in (1, 2, 3))]

    d2, d1, total = steps(pairs.values()), steps(contexts.values()), len(pairs)
    followers = {}
    for (a, _), c in pairs.items():
        x = followers.setdefault(a, [0, 0, 0, 0])
        x[0] += c
        x[min(c, 3)] += 1
    back = sum(d1[min(c, 3)] for c in contexts.values()) / total if total else 1.0
    p1 = lambda w: (max(contexts[w] - d1[min(contexts[w], 3)], 0) / total if total else 0) + back / (v + 1)

    def p2(a, w):
        if a not in followers:
            return p1(w)
        x, c = followers[a], pairs.get((a, w), 0)
        return max(c - d2[min(c, 3)], 0) / x[0] + sum(d2[i] * x[i] for i in (1, 2, 3)) / x[0] * p1(w)

    return count, n, v, p2


@pytest.mark.parametrize("chars", [16_000_000, 2_000])
def test_language_model(odd_docs, plain_rows, chars):
    params = language_model.LmParams(chars_per_shard=chars, flush_tokens=500, score_tokens=700)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    count, n, v, p2 = kneser_ney([t for i, t, *_ in plain_rows if not held(i)])
    model = language_model.train(odd_docs.where(~language_model.held_out(F.col("doc_id"))), params)
    assert (model.tokens, model.vocabulary) == (n, v)
    got = language_model.score_documents(odd_docs, model, params).collect()
    assert len(got) == len(plain_rows)
    want = {}
    for i, t, *_ in plain_rows:
        w = tokens(t)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        want[i, len(w)] = (held(i), sum(count[x] > 0 for x in w), base, sum(math.log10(p2(a, b)) for a, b in zip([0, *w[:-1]], w)))
    for r in got:
        held_, known, base, score = want[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held_, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def kneser_ney_of(train, order):
    """log10 probability of a text under the model of that order, from the definition."""
    pad = [0] * (order - 1)
    grams = {order: Counter()}
    for t in train:
        w = pad + tokens(t)
        grams[order].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    for m in range(order - 1, 0, -1):
        grams[m] = Counter(g[1:] for g in grams[m + 1])
    v = len(grams[1])

    def steps(values):
        k = [sum(c == i for c in values) for i in (1, 2, 3, 4)]
        if not all(k):
            return [0, 0.5, 0.5, 0.5]
        y = k[0] / (k[0] + 2 * k[1])
        return [0, *(min(max(i - (i + 1) * y * k[i] / k[i - 1], 0), i) for i in (1, 2, 3))]

    d, after = {m: steps(c.values()) for m, c in grams.items()}, {}
    for m, c in grams.items():
        for g, k in c.items():
            x = after.setdefault((m, g[:-1]), [0, 0, 0, 0])
            x[0] += k
            x[min(k, 3)] += 1

    def p(ctx, w):
        m = len(ctx) + 1
        low = p(ctx[1:], w) if ctx else 1 / (v + 1)
        if (m, ctx) not in after:
            return low
        x, k = after[m, ctx], grams[m].get((*ctx, w), 0)
        return max(k - d[m][min(k, 3)], 0) / x[0] + sum(d[m][i] * x[i] for i in (1, 2, 3)) / x[0] * low

    def score(t):
        w = pad + tokens(t)
        return sum(math.log10(p(tuple(w[i : i + order - 1]), w[i + order - 1])) for i in range(len(w) - order + 1))

    return score


@pytest.mark.parametrize("order,chars", [(2, 900), (3, 16_000_000), (3, 700), (4, 700)])
def test_language_model_of_any_order(spark, order, chars):
    rng = random.Random(order)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab[: 1 + k % 40]) for _ in range(rng.randint(0, 60))) for k in range(90)] + ["", "w1", "w1 w2", "W1 W2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    params = language_model.LmParams(order=order, chars_per_shard=chars, flush_tokens=300, score_tokens=500)
    model = language_model.train(docs.where("doc_id % 3 > 0"), params)
    score = kneser_ney_of([t for i, t in enumerate(texts) if i % 3], order)
    got = {r.doc_id: r for r in language_model.score_documents(docs, model, params).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i].score, score(t), rel_tol=1e-9), (i, t)
    with pytest.raises(ValueError):
        language_model.train(docs, language_model.LmParams(order=1))


def test_large_counts_are_kept(tmp_path):
    """Counts beyond 32 bits pass through packing and the stored arrays."""
    v, w, c, s = (np.array(x, np.uint64) for x in ([1, 1, 2], [5, 6, 5], [2**40, 254, 255], [9, 9, 8]))
    gv, gw, counts, suffixes = language_model.unpack(language_model.pack(v, w, [c.astype(np.int64), w.astype(np.int64)], [s]))
    assert all((a == b).all() for a, b in zip((gv, gw, *counts, *suffixes), (v, w, c.astype(np.int64), w.astype(np.int64), s)))
    language_model._save(str(tmp_path), "x", [v, language_model._narrow(c), language_model._narrow(c[1:])])
    back = language_model._open(str(tmp_path), "x")
    assert back[1].tolist() == c.tolist() and back[2].dtype == np.dtype("<u4")


def test_probabilities_sum_to_one(spark):
    texts = ["a b a b c", "a c d", "b a", "d d d a b"]
    _, _, v, p2 = kneser_ney(texts)
    words = ["a", "b", "c", "d", None]
    for ctx in (0, "a", "d", "new"):
        assert math.isclose(sum(p2(ctx, w) for w in words) + p2(ctx, "unseen"), 1.0, rel_tol=1e-9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = language_model.train(docs)
    got = {r.doc_id: r.score for r in language_model.score_documents(docs, model).collect()}
    for i, t in enumerate(texts):
        w = tokens(t)
        assert math.isclose(got[i], sum(math.log10(p2(a, b)) for a, b in zip([0, *w[:-1]], w)), rel_tol=1e-9)


def test_no_training_text(spark, odd_docs, no_docs):
    model = language_model.train(no_docs)
    got = language_model.score_documents(odd_docs, model).collect()
    assert {(r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0.0, 0.0)}
    assert language_model.score_documents(no_docs, model).count() == 0


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_is_the_librarys(library):
    own, rng = bpe.load(bpe.default_path()), random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEZ'’ \t\n0123456789!?.-_éèüßñΣσςİıǅ中文字😀<|>\x1c\x85\xa0ﬁ́ั"
    texts = ["", "'S IT'S don't ''ll", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "ab" * 4000, "z" * 3001]
    for _ in range(800):
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))))
        texts.append("".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 60))))
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_queries(library, odd_docs, plain_rows, no_docs):
    want = []
    for i, t, *_ in plain_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe.encode_digests(odd_docs, bpe.default_path()).collect()
    assert by_counts(tuple(r) for r in got) == by_counts(want)
    full = bpe.encode_documents(odd_docs, bpe.default_path()).collect()
    assert by_counts((r.doc_id, len(r.ids)) for r in full) == by_counts((w[0], w[1]) for w in want)
    assert bpe.encode_digests(no_docs, bpe.default_path()).count() == 0


# ---------------------------------------------------------------- WARC

PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 60_000
    rows = [(1, "http://a/ b", "x" * 120), (2, None, "x" * 120), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "ü", "")]
    rows += [(7, "u", big), (8, "u", big), (8, "u", big), (7, "u", big), (None, "u", big), (None, "v", "y" * 200), (None, None, "y" * 200)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, PAGES), payloads=True).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        owner = min(ids, default=None) if len(data) >= 100 else None
        refers = owner if owner is not None and owner != page else None
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert by_counts((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == by_counts(want)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def archive(n=3):
    writer = warc.ArchiveWriter(b"WARC/1.1\r\n" * 20, 3)
    for i in range(n):
        p = b"payload %d " % i * 20
        writer.add(warc.record_bytes(i, "u", p, hashlib.sha256(p).hexdigest(), len(p)))
    return writer.bytes()


def test_faults_are_reported():
    data = archive()
    assert [r["page_id"] for r in warc.read_archive(data)] == [0, 1, 2]
    for broken in (data[8:], data[:-5], data[:40], b"", data + b"junkjunk", data[:-30] + bytes(30)):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(broken))
    good = warc.record_bytes(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3)
    warc.parse_record(good)
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 3", b"Content-Length: 4"), (b"abc", b"abd"), (b"WARC-Date: ", b"X-Date: "), (b"response", b"strange")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(good.replace(old, new, 1) if old != b"abc" else good.replace(old, new))


def test_archives_of_others(spark, tmp_path):
    """All record types, foreign ids, SHA-1 in base 32, folded headers; with and without a dictionary; clashing columns."""
    import base64

    import zstandard

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>page</p>"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"<p>page</p>").digest()).decode()
    whole = "sha1:" + hashlib.sha1(body).hexdigest().upper()

    def record(kind, block, *more, version="1.0"):
        head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    raw = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/"),
        record("response", body, http, f"WARC-Payload-Digest: {sha1}", f"WARC-Block-Digest: {whole}", "X-Note: folded", "  over lines", version="1.1"),
        record("revisit", body[:46], http, f"WARC-Payload-Digest: {sha1}", "WARC-Refers-To: <urn:uuid:response>"),
        record("metadata", b"", "WARC-Payload-Digest: tiger:unknown"),
    ]
    assert body[:46].endswith(b"\r\n\r\n") or b"\r\n\r\n" in body[:46]
    bare = zstandard.ZstdCompressor(write_content_size=False)
    files = {"bare": b"".join(bare.compress(r) for r in raw)}
    words = zstandard.ZstdCompressionDict(b"WARC/1.0 WARC-Type: response " * 30)
    with_words = zstandard.ZstdCompressor(dict_data=words)
    frames = [with_words.compress(r) for r in raw]
    frames.insert(2, struct.pack("<II", 0x184D2A50, 3) + b"xyz")  # frames to be skipped may stand anywhere
    files["worded"] = struct.pack("<II", 0x184D2A5D, len(words.as_bytes())) + words.as_bytes() + b"".join(frames)
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / n), "clash", 1) for n in files] + [(None, "", 0)], "path string, record_id string, offset int")
    got = warc.read_records(paths).collect()
    for name in files:
        rows = sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.offset)
        assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "revisit", "metadata"]
        assert [r.payload for r in rows] == [b"software: x\r\n", b"", b"<p>page</p>", None, b""]
        assert rows[3].refers_to == rows[2].record_id == "<urn:uuid:response>" and rows[2].payload_digest == sha1
    broken = raw[2].replace(b"<p>page", b"<p>pagf")
    with pytest.raises(warc.WarcError):
        warc.parse_warc(broken)
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(bare.compress(b"x" * 5000)), max_record=1000, dictionary=False))
    assert warc.read_records(paths.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity


def toxic_rows(n=260):
    rng = random.Random(9)
    vocab = ["".join(rng.choice(["th", "er", "on", "an", "ti", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "vile" + rng.choice(["st", "ness", "", "ly"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_learns(spark, odd_docs, labels, no_docs):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert {i for i in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [got[i].predicted == t for i, _, t in rows if got[i].held_out]
    assert np.mean(right) > 0.9
    odd = toxicity.score_documents(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count()
    assert {r.score for r in odd if r.doc_id in (200, 201, 202)} == {0.0}
    assert {r.score for r in toxicity.score_documents(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(no_docs, labels).count() == 0


def test_unbroken_texts_are_read_to_the_end():
    rng = random.Random(12)
    for n in (1, 199, 200, 201, 398, 399, 1000):
        word = "".join(rng.choice("abcdé中") for _ in range(n))
        pieces = toxicity.words_of("x " + word + " y")[1:-1]
        assert pieces[0] + "".join(p[2:] for p in pieces[1:]) == word and max(map(len, pieces)) <= 200
    rows, params = toxic_rows(), toxicity.ToxicParams()
    weights, _, _ = toxicity.fit([r[1] for r in rows], [r[2] for r in rows], params, 0.3)
    net, vocab = toxicity.Network(params, weights), toxicity.Vocabulary(params.buckets)
    for mark in ("_", "-", ",", "\u3000"):
        clean = mark.join(next(t for _, t, y in rows if not y and len(t) > 300).split())
        toxic = clean + mark + mark.join(["vileness", "vilest"] * 30)
        low, high = toxicity.best_logits(net, vocab, [toxicity.words_of(clean), toxicity.words_of(toxic)])
        assert high > low + 1, mark


def test_gradients():
    p = toxicity.ToxicParams(length=5, stride=3, buckets=16, word_dim=3, char_dim=4, hidden=3, attention=2)
    net, vocab = toxicity.Network(p), toxicity.Vocabulary(p.buckets)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    distinct, ids, sizes = toxicity.numbered(["a bc d bc e f g".split(), "x a".split()])
    rows, owner, _ = toxicity.windows(ids, sizes, p.length, p.stride)
    table = vocab.table(distinct)
    up = np.random.default_rng(0).normal(size=len(rows))

    def loss():
        return float(net.forward(net.inputs(table)[1], rows) @ up)

    x, gates = net.inputs(table)
    keep = {}
    net.forward(gates, rows, keep)
    grad = net.backward(up, table, x, rows, keep)
    rng = np.random.default_rng(1)
    for name, g in grad.items():
        w = net.w[name]
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            eps, old = 1e-3, w[at]
            w[at] = old + eps
            hi = loss()
            w[at] = old - eps
            lo = loss()
            w[at] = old
            assert abs((hi - lo) / (2 * eps) - g[at]) < 2e-3 + 0.02 * abs(g[at]), name


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        s = toxicity.window_starts(n, 32, 16)
        covered = {i for a in s for i in range(a, min(a + 32, n))}
        assert covered == set(range(n)) and len(set(s)) == len(s)


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_join", "source_mix", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.written(stage(spark, docs, sf), f"test-{name}")
        if name != "bpe":
            assert docs.columns == columns
        if name in ("quality_rules", "line_dedup", "near_join"):
            assert docs.count() <= seen
            seen = docs.count()
    got = corpus_pipeline.run(spark, sf)
    assert by_counts(tuple(r) for r in got.collect()) == by_counts(tuple(r) for r in docs.collect())
