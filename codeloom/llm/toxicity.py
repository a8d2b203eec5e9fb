"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its hashed embedding beside the mean of its hashed character-trigram embeddings. A word of
more than ``PIECE`` code points is read whole, as pieces of so many that overlap by two; each counts as a word. A text
is cut into overlapping windows of ``length`` words, ``stride`` apart; every window of every text is read in
both directions by gated recurrent units, pooled by attention and turned into a logit. A text's logit is
its highest window's; a two-number logistic fit on the training texts turns it into the score.

Training. A label belongs to a text, not to a window, so a text's windows share its loss by a softmax of
their logits that sharpens from epoch to epoch (multiple-instance learning). The sample is bounded: at most
``train_rows`` labelled texts, half of each class where there are enough, of ``train_chars`` code points or fewer, those with
the smallest seeded hashes. Words outside the sample are still read, by their characters and
hash buckets. Labels, language, source and doc_id are never inputs.

Defined results
* null or empty text, or one without words: score 0.
* null doc_id: its text form is empty, crc32 is 0, so it is held out.
* labels that repeat a doc_id: toxic if any label says so; null labels are skipped.
* labels of one class only, or none: the score is the share of toxic labels (0 without labels) for every text.
* repeated rows: the same score for each. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, hashing


@dataclass(frozen=True)
class ToxicParams:
    length: int = 32
    stride: int = 16
    buckets: int = 8192
    word_dim: int = 12
    char_dim: int = 20
    hidden: int = 16
    attention: int = 16
    train_rows: int = 3000
    train_chars: int = 8000
    epochs: int = 4
    batch_texts: int = 24
    rate: float = 0.01
    seed: int = 3
    score_words: int = 500_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Windows that are read at once: their buffers fit a core's cache.
CHUNK = 1024
#: Code points of a word that are read as one.
PIECE = 200

# ---------------------------------------------------------------- inputs


class Vocabulary:
    """Bucket numbers of words and of their character trigrams, all words at once."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, all trigram buckets end to end, and where each word's trigrams begin. A word is read as <word>."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 2)
        marked = "<" + "><".join(words) + ">"
        code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
        inside = np.ones(len(code), bool)
        inside[ends - 1] = inside[ends - 2] = False
        grams = hashing.mix64(mixed[inside[:-2]]) % np.uint64(self.buckets)
        own = hashing.mix64(hashing.hashes_of(words) + np.uint64(7)) % np.uint64(self.buckets)
        return own.astype(np.int64), grams.astype(np.int64), np.cumsum(sizes) - sizes


def words_of(text: str | None) -> list[str]:
    """Words between blanks; a long one in pieces, so that every trigram of it lies in one."""
    words = hashing.words_of((text or "").lower())
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[at : at + PIECE] for w in words for at in (range(0, len(w) - 2, PIECE - 2) if len(w) > PIECE else (0,))]


def window_starts(n: int, length: int, stride: int) -> np.ndarray:
    """Every window of a text of n words: stride apart, the last one ends the text."""
    if n <= length:
        return np.zeros(1 if n else 0, np.int64)
    starts = np.arange(0, n - length + stride, stride, dtype=np.int64)
    return np.minimum(starts, n - length)


def windows(ids: np.ndarray, sizes: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (rows of windows, -1 where a text ends early), owners of the windows, lengths."""
    begin = np.cumsum(sizes) - sizes
    starts = [window_starts(int(n), length, stride) for n in sizes]
    owner = np.repeat(np.arange(len(sizes)), [len(s) for s in starts])
    if not len(owner):
        return np.zeros((0, length), np.int64), owner, owner
    at = np.concatenate(starts)
    lens = np.minimum(sizes[owner], length)
    grid = begin[owner][:, None] + at[:, None] + np.arange(length)
    valid = np.arange(length) < lens[:, None]
    return np.where(valid, ids[np.minimum(grid, len(ids) - 1)], -1), owner, lens


# ---------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights by name; float32 throughout."""

    def __init__(self, params: ToxicParams, weights: dict[str, np.ndarray] | None = None):
        self.p = params
        if weights is not None:
            self.w = weights
            return
        rng = np.random.default_rng(params.seed)
        d, h, a = params.word_dim + params.char_dim, params.hidden, params.attention
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {
            "word": normal(0.3, params.buckets, params.word_dim),
            "char": normal(0.5, params.buckets, params.char_dim),
            "x": normal(d**-0.5, d, 6 * h),  # input gates: update, reset, new; forward, then backward
            "b": np.zeros(6 * h, np.float32),
            "uf": normal(h**-0.5, h, 3 * h),
            "ub": normal(h**-0.5, h, 3 * h),
            "a": normal((2 * h) ** -0.5, 2 * h, a),
            "ab": np.zeros(a, np.float32),
            "v": normal(a**-0.5, a),
            "o": normal((2 * h) ** -0.5, 2 * h),
            "ob": np.zeros(1, np.float32),
        }

    def inputs(self, table: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of distinct words, and their share of the gates."""
        word, grams, begin = table
        ends = np.append(begin, len(grams))
        x = np.empty((len(word), self.p.word_dim + self.p.char_dim), self.w["word"].dtype)
        x[:, : self.p.word_dim] = self.w["word"][word]
        for at in range(0, len(word), 4096):  # parts that fit the cache
            lo, hi = at, min(at + 4096, len(word))
            chars = np.add.reduceat(self.w["char"][grams[ends[lo] : ends[hi]]], begin[lo:hi] - ends[lo])
            x[lo:hi, self.p.word_dim :] = chars / np.diff(ends[lo : hi + 1])[:, None].astype(np.float32)
        return x, x @ self.w["x"] + self.w["b"]

    def _run(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, u: np.ndarray, order, keep: list | None) -> np.ndarray:
        h_n = self.p.hidden
        h = np.zeros((len(ids), h_n), np.float32)
        out = np.empty((len(ids), ids.shape[1], h_n), np.float32)
        for t in order:
            g = gates[ids[:, t]]
            z_r = _sigmoid(g[:, : 2 * h_n] + h @ u[:, : 2 * h_n])
            z, r = z_r[:, :h_n], z_r[:, h_n:]
            n = np.tanh(g[:, 2 * h_n :] + (r * h) @ u[:, 2 * h_n :])
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, n))
            h = h + m * z * (n - h)
            out[:, t] = h
        return out

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. gates: per distinct word; ids: windows of word numbers, -1 for none."""
        h3 = 3 * self.p.hidden
        mask = (ids >= 0).astype(np.float32)
        steps = ids.shape[1]
        f_keep, b_keep = ([], []) if keep is not None else (None, None)
        both = np.concatenate(
            [
                self._run(gates[:, :h3], ids, mask, self.w["uf"], range(steps), f_keep),
                self._run(gates[:, h3:], ids, mask, self.w["ub"], range(steps - 1, -1, -1), b_keep),
            ],
            axis=2,
        )
        s = np.tanh(both @ self.w["a"] + self.w["ab"])
        e = s @ self.w["v"]
        e = np.where(mask > 0, e, -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        att = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", att, both)
        if keep is not None:
            keep.update(mask=mask, both=both, s=s, att=att, pooled=pooled, f=f_keep, b=b_keep)
        return pooled @ self.w["o"] + self.w["ob"][0]

    def logits(self, tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
        """The same logits as ``forward`` without what training keeps: buffers are reused, gates halved in advance.

        tables: the two directions' gates from ``split_gates``.
        """
        count, steps = ids.shape
        h_n = self.p.hidden
        whole = bool((ids[:, -1] >= 0).all())  # windows end in a word: nothing to mask
        mask = None if whole else (ids >= 0).astype(np.float32)
        safe = ids if whole else np.maximum(ids, 0)
        by_step = np.ascontiguousarray(safe.T)
        both = np.empty((steps, count, 2 * h_n), np.float32)
        g, zr, n = np.empty((count, 3 * h_n), np.float32), np.empty((count, 2 * h_n), np.float32), np.empty((count, h_n), np.float32)
        for side, name in ((0, "uf"), (1, "ub")):
            table = tables[side]
            u_zr = np.ascontiguousarray(self.w[name][:, : 2 * h_n] * np.float32(0.5))
            u_n = np.ascontiguousarray(self.w[name][:, 2 * h_n :])
            h = np.zeros((count, h_n), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                np.take(table, by_step[t], axis=0, out=g)
                np.matmul(h, u_zr, out=zr)
                zr += g[:, : 2 * h_n]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                z, r = zr[:, :h_n], zr[:, h_n:]
                np.matmul(r * h, u_n, out=n)
                n += g[:, 2 * h_n :]
                np.tanh(n, out=n)
                n -= h
                n *= z
                if mask is not None:
                    n *= mask[:, t, None]
                h = h + n
                both[t, :, side * h_n : (side + 1) * h_n] = h
        s = both.reshape(-1, 2 * h_n) @ self.w["a"]
        s += self.w["ab"]
        np.tanh(s, out=s)
        e = (s @ self.w["v"]).reshape(steps, count)
        if mask is not None:
            e = np.where(mask.T > 0, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        if mask is not None:
            e *= mask.T
        value = (both.reshape(-1, 2 * h_n) @ self.w["o"]).reshape(steps, count)
        return (e * value).sum(axis=0) / np.maximum(e.sum(axis=0), 1e-9) + self.w["ob"][0]

    def split_gates(self, gates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gates of each direction, those of update and reset halved for the tanh form of the logistic function."""
        h3, out = 3 * self.p.hidden, []
        for part in (gates[:, :h3], gates[:, h3:]):
            part = np.array(part, np.float32, order="C")
            part[:, : 2 * self.p.hidden] *= 0.5
            out.append(part)
        return tuple(out)

    def backward(self, d_logit: np.ndarray, table: tuple, x: np.ndarray, ids: np.ndarray, keep: dict) -> dict[str, np.ndarray]:
        """Gradients of all weights, given those of the windows' logits."""
        h_n, w = self.p.hidden, self.w
        grad = {"o": keep["pooled"].T @ d_logit, "ob": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * w["o"]
        att, both, s, mask = keep["att"], keep["both"], keep["s"], keep["mask"]
        d_both = att[:, :, None] * d_pooled[:, None, :]
        d_att = np.einsum("nth,nh->nt", both, d_pooled)
        d_e = att * (d_att - (att * d_att).sum(axis=1, keepdims=True))
        grad["v"] = np.einsum("nta,nt->a", s, d_e)
        d_s = d_e[:, :, None] * w["v"] * (1 - s * s)
        grad["a"] = both.reshape(-1, 2 * h_n).T @ d_s.reshape(-1, self.p.attention)
        grad["ab"] = d_s.sum(axis=(0, 1))
        d_both += d_s @ w["a"].T
        d_gates = np.zeros((len(ids), ids.shape[1], 6 * h_n), np.float32)
        for side, name, steps in ((0, "uf", keep["f"]), (1, "ub", keep["b"])):
            u = w[name]
            g_u = np.zeros_like(u)
            d_h = np.zeros((len(ids), h_n), np.float32)
            for t, h, z, r, n in reversed(steps):
                d_h = d_h + d_both[:, t, side * h_n : (side + 1) * h_n]
                m = mask[:, t, None]
                d_n = d_h * m * z * (1 - n * n)
                d_z = d_h * m * (n - h) * z * (1 - z)
                d_rh = d_n @ u[:, 2 * h_n :].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                g_u[:, : 2 * h_n] += h.T @ d_zr
                g_u[:, 2 * h_n :] += (r * h).T @ d_n
                d_gates[:, t, side * 3 * h_n : (side + 1) * 3 * h_n] = np.concatenate([d_zr, d_n], axis=1)
                d_h = d_h * (1 - m * z) + d_rh * r + d_zr @ u[:, : 2 * h_n].T
            grad[name] = g_u
        flat, rows = ids.reshape(-1), d_gates.reshape(-1, 6 * h_n)
        own = np.flatnonzero(flat >= 0)
        d_table = _sum_by(flat[own], rows[own], len(x))
        grad["x"], grad["b"] = x.T @ d_table, d_table.sum(axis=0)
        d_x = d_table @ w["x"].T
        word, grams, begin = table
        grad["word"] = _sum_by(word, d_x[:, : self.p.word_dim], self.p.buckets)
        sizes = np.diff(np.append(begin, len(grams)))
        d_char = np.repeat(d_x[:, self.p.word_dim :] / sizes[:, None].astype(np.float32), sizes, axis=0)
        grad["char"] = _sum_by(grams, d_char, self.p.buckets)
        return grad


def _sum_by(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        out[sorted_keys[first]] = np.add.reduceat(rows[order], first)
    return out


def numbered(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the texts as word numbers end to end, the texts' sizes."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64)
    return list(number), ids, np.array([len(t) for t in texts], np.int64)


# ---------------------------------------------------------------- training


def fit(texts: list[str], labels: list[int], params: ToxicParams, prior: float) -> tuple[dict, float, float]:
    """Weights and the two numbers of the logistic fit. prior: the share of toxic texts outside the balanced sample."""
    net, vocab = Network(params), Vocabulary(params.buckets)
    words = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(params.seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(params.epochs):
        sharp = 1.0 + 2.0 * epoch
        order = rng.permutation(len(words))
        for at in range(0, len(order), params.batch_texts):
            pick = [i for i in order[at : at + params.batch_texts] if words[i]]
            if not pick:
                continue
            distinct, ids, sizes = numbered([words[i] for i in pick])
            rows, owner, _ = windows(ids, sizes, params.length, params.stride)
            table = vocab.table(distinct)
            x, gates = net.inputs(table)
            keep: dict = {}
            logit = net.forward(gates, rows, keep)
            share = _softmax_by(sharp * logit, owner, len(pick))
            whole = np.bincount(owner, share * logit, len(pick))
            error = (_sigmoid(whole) - y[pick]) / len(pick)
            grad = net.backward((share * error[owner]).astype(np.float32), table, x, rows, keep)
            step += 1
            rate = params.rate * min(1.0, step / 20) * (0.3 if epoch == params.epochs - 1 else 1.0)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    top = best_logits(net, vocab, words)
    there = np.isfinite(top)
    slope, shift = _logistic(top[there], y[there], prior)
    return net.w, slope, shift


def _softmax_by(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, x)
    e = np.exp(x - top[owner])
    return e / np.bincount(owner, e, n)[owner]


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Newton's method on two numbers, with a little shrinkage; classes weighted to the prior."""
    share = y.mean()
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 0.01 * (a - 1), (weight * (p - y)).sum() + 0.01 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b


def best_logits(net: Network, vocab: Vocabulary, texts: list[list[str]], chunk: int = CHUNK) -> np.ndarray:
    """Highest window logit per text; -inf for a text without words."""
    best = np.full(len(texts), -np.inf)
    distinct, ids, sizes = numbered(texts)
    if not distinct:
        return best
    _, gates = net.inputs(vocab.table(distinct))
    tables = net.split_gates(gates)
    rows, owner, lens = windows(ids, sizes, net.p.length, net.p.stride)
    order = np.argsort(lens, kind="stable")  # short windows together
    for at in range(0, len(rows), chunk):
        part = order[at : at + chunk]
        np.maximum.at(best, owner[part], net.logits(tables, rows[part][:, : max(1, int(lens[part].max()))]))
    return best


# ---------------------------------------------------------------- Spark


def training_sample(docs: DataFrame, labels: DataFrame, params: ToxicParams) -> tuple[list[str], list[int], float]:
    """Texts, labels and the share of toxic labels among all that may be learnt from. Ids are drawn before texts move."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = common.written(known, "toxic-labels")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if not (counts.get(0) and counts.get(1)):
        return [], [], prior
    short = docs.where(F.length("text") <= params.train_chars)
    # only ids that have a text short enough are drawn, so the sample is whole
    ids = short.where(F.col("doc_id").isNotNull()).select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = common.written(ids, "toxic-ids")
    counts = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = params.train_rows // 2
    wanted = {1: max(half, params.train_rows - counts.get(0, 0)), 0: max(half, params.train_rows - counts.get(1, 0))}
    rows = []
    for label, most in wanted.items():
        drawn = ids.where(F.col("toxic") == label).orderBy(F.xxhash64(F.lit(params.seed), "doc_id"), "doc_id").limit(most)
        # at most train_rows ids: a bound by parameter; one text for an id, however often it is there
        texts = short.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        rows += texts.select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows], prior


def score_documents(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows for every row of ``docs``."""
    texts, y, prior = training_sample(docs, labels, params)
    if len(set(y)) < 2:
        weights, slope, shift = None, 0.0, 0.0
    else:
        weights, slope, shift = fit(texts, y, params, prior)
    model = docs.sparkSession.sparkContext.broadcast((weights, slope, shift))  # fixed size: about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, shift = model.value
        net = Network(params, weights) if weights is not None else None
        vocab = Vocabulary(params.buckets)

        def scored(group: list[list[str]]) -> list[float]:
            if net is None:
                return [prior if g else 0.0 for g in group]
            top = best_logits(net, vocab, group)
            out = 1 / (1 + np.exp(-np.clip(slope * np.where(np.isfinite(top), top, 0) + shift, -30, 30)))
            return np.where(np.isfinite(top), out, 0.0).tolist()

        for batch in batches:
            ids, held, texts = batch.columns
            scores, n_windows, group, size = [], [], [], 0
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py())
                group.append(words)
                n_windows.append(len(window_starts(len(words), params.length, params.stride)))
                size += len(words)
                if size >= params.score_words:
                    scores += scored(group)
                    group, size = [], 0
            if group:
                scores += scored(group)
            s = np.array(scores, float)
            yield pa.RecordBatch.from_arrays(
                [ids, held, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(n_windows, pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_windows"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_windows long")
