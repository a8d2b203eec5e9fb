"""Interpolated modified Kneser-Ney model of any order, counted in Spark, memory-mapped for scoring.

Tokens are the words between ASCII blanks with A-Z lower-cased, then one end token per text; contexts of the first
words are filled with a start mark. Tokens and contexts are known by 64-bit hashes; the context of order m, of m - 1
words, is hashed from its first word and the context of order m - 1 that follows it.

Counting. A task sums the grams (context, word) of its texts and sends each context's grams, packed, to the context's
shard; a frequent context is thereby reduced to its distinct followers before anything moves. A shard merges what it
gets and writes sorted hash arrays: grams with their counts, contexts with their totals and the number of followers
seen once, twice and more often. From its distinct grams it passes on, summed and packed again, how many different
words stand before each gram that is a word shorter: the counts of the next order down, whose shards do the same.
The last shards are those of the words: how often each stands, after how many others. All texts count; nothing is
pruned.

A context that a tenth of a shard's worth of tokens follows (the start mark, the commonest words) is dealt by
context and word instead, over all shards; its totals are summed afterwards. Which contexts these are is read
off a sample and bears on placement alone, never on a count.

Files. Arrays lie in the shared folder, one file per order and shard, under a name that order and shard give: a task
writes aside and renames, so a retried task replaces a file by the same file, and no list of files is needed. Workers
map local files into memory; from a store without a mount they read the arrays they touch. No array is sent through
the driver: it gets counts of counts and totals, summed by Spark.

Probability. p(w|v) = max(c - D(c), 0) / c(v) + g(v) p(w|v'), v' being v without its first word, down to the words,
which are interpolated with 1 / (V + 1); that is also what a new word gets. Counts below the highest order are those
of different words before. D has three values per order, from the counts of counts; g is the mass that discounting
freed. A new context backs off wholly.

Defined results
* null or empty text: the end token alone. Null doc_id: belongs to the training part (its text form is empty).
* no training text: N = V = 0, every score is 0 (probability 1 for the one open event).
* repeated rows count as often as they stand there, and each gets its row. Empty table: empty result.
* extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, hashing

END = np.uint64(0x5E17D5E17D5E17D5)
START = np.uint64(0x57A57A57A57A57A5)
#: Files that a worker keeps mapped: far below what a process may map.
OPEN_FILES = 4096


@dataclass(frozen=True)
class LmParams:
    """order: words of the longest gram. chars_per_shard: text per shard of the model; the number of shards follows the
    input. max_spread bounds the contexts of an order that are spread over the shards, sample_texts the texts that they
    are guessed from."""

    order: int = 2
    chars_per_shard: int = 16_000_000
    flush_tokens: int = 3_000_000
    score_tokens: int = 600_000
    max_spread: int = 65_536
    sample_texts: int = 2_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def token_hashes(text: str | None) -> np.ndarray:
    words = hashing.words_of(hashing.ascii_lower(text or ""))
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = hashing.hashes_of(words)
    out[-1] = END
    return out


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return hashing.mix64(v * np.uint64(0x9E3779B97F4A7C15) ^ (w + np.uint64(0x2545F4914F6CDD1D)))


def contexts_of(tokens: np.ndarray, order: int = 2) -> list[np.ndarray]:
    """For each token its contexts of order 2 to ``order``."""
    out: list[np.ndarray] = []
    for m in range(2, order + 1):
        word = np.full(len(tokens), START)
        word[m - 1 :] = tokens[: max(0, len(tokens) - m + 1)]
        out.append(pair_hash(word, out[-1]) if out else word)
    return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def among(v: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of v are in the sorted array known."""
    if not len(known):
        return np.zeros(len(v), bool)
    return known[np.minimum(np.searchsorted(known, v), len(known) - 1)] == v


def pair_shard(v: np.ndarray, w: np.ndarray, shards: int, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each pair, and whether its context is spread (spread: sorted hashes)."""
    wide = among(v, spread)
    shard = shard_of(v, shards)
    shard[wide] = shard_of(pair_hash(v[wide], w[wide]), shards)
    return shard, wide


# ---------------------------------------------------------------- arrays


def merge_grams(v: np.ndarray, w: np.ndarray, counts: list, suffixes: list = ()) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Sum the counts of equal grams; sorted by v, then w. suffixes: further columns that v decides."""
    if not len(v):
        return v, w, list(counts), list(suffixes)
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    return v[first], w[first], [np.add.reduceat(c[order], first) for c in counts], [s[order][first] for s in suffixes]


def pack(v: np.ndarray, w: np.ndarray, counts: list, suffixes: list = ()) -> bytes:
    """Grams sorted by v: each v once, with its suffixes. Counts in the fewest bytes."""
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    runs = np.diff(np.append(first, len(v))).astype("<u4")
    parts = [v[first].astype("<u8"), *[s[first].astype("<u8") for s in suffixes], runs, w.astype("<u8")]
    big = []
    for c in counts:
        small = c < 255
        big.append(c[~small].astype("<u8"))
        parts += [np.where(small, c, 255).astype("u1"), big[-1]]
    head = np.array([len(first), len(v), len(suffixes), len(counts), *map(len, big)], "<u8")
    return b"".join(x.tobytes() for x in (head, *parts))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, list, list]:
    nv, n, ns, nc = (int(x) for x in np.frombuffer(data, "<u8", 4))
    big = [int(x) for x in np.frombuffer(data, "<u8", nc, 32)]
    at = 32 + 8 * nc

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, k, at)
        at += found.nbytes
        return found

    vs, suffixes = take("<u8", nv), [take("<u8", nv) for _ in range(ns)]
    runs, w, counts = take("<u4", nv), take("<u8", n), []
    for k in big:
        c = take("u1", n).astype(np.int64)
        c[c == 255] = take("<u8", k).astype(np.int64)
        counts.append(c)
    return np.repeat(vs, runs), w, counts, [np.repeat(s, runs) for s in suffixes]


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other behind a header of their lengths and types (8 bytes each)."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.dtype.itemsize)]], "<u8").tobytes()
    parts = [head]
    for a in arrays:
        raw = a.tobytes()
        parts.append(raw + b"\0" * (-len(raw) % 8))
    data = b"".join(parts)
    if (path := common.local_path(folder)) is not None:
        import os

        os.makedirs(path, exist_ok=True)
        aside = f"{path}/.{name}-{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            f.write(data)
        os.replace(aside, f"{path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}", compression=None) as f:  # a store shows a file when it is whole
            f.write(data)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in four bytes each, or eight where one needs them."""
    return counts.astype("<u8" if len(counts) and int(counts.max()) >= 2**32 else "<u4")


_KINDS = {1: "u1", 4: "<u4", 8: "<u8"}


def _open(folder: str, name: str) -> list[np.ndarray] | None:
    """The arrays of a file; None where no text led to that shard."""
    try:
        if (path := common.local_path(folder)) is not None:
            raw = np.memmap(f"{path}/{name}", np.uint8, "r")
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(folder)
            with store.open_input_file(f"{path}/{name}") as f:
                raw = np.frombuffer(f.read(), np.uint8)
    except FileNotFoundError:
        return None
    k = int(raw[:8].view("<u8")[0])
    shape = raw[8 : 8 + 16 * k].view("<u8").astype(np.int64).reshape(k, 2)
    out, at = [], 8 + 16 * k
    for n, width in shape:
        size = int(n * width)
        out.append(raw[at : at + size].view(_KINDS[int(width)]))
        at += size + (-size % 8)
    return out


# ---------------------------------------------------------------- counting


def frequent_contexts(texts: DataFrame, chars: int, params: LmParams) -> dict[int, np.ndarray]:
    """By order, sorted hashes of the start's context and of contexts that take a tenth of a shard's text or more."""
    share = min(1.0, params.chars_per_shard / max(chars, 1)) / 10
    n = texts.count()
    some = texts.select("text").sample(min(1.0, params.sample_texts / max(n, 1)), seed=1)
    orders = range(2, params.order + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                for m, v in zip(orders, contexts_of(token_hashes(text.as_py()), params.order), strict=True):
                    own, k = np.unique(v, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m)), pa.array(own.view(np.int64)), pa.array(k)], names=["m", "v", "k"])

    counts = some.mapInArrow(run, "m long, v long, k long").groupBy("m", "v").agg(F.sum("k").alias("n"))
    counts = common.written(counts, "lm-sample")
    out = {}
    for m in orders:
        own = counts.where(F.col("m") == m)
        total = own.agg(F.sum("n")).first()[0] or 0
        top = own.where(F.col("n") >= max(2.0, share * total)).orderBy(F.desc("n"), "v").limit(params.max_spread - 1).collect()
        start = contexts_of(np.array([END]), m)[-1]
        out[m] = np.unique(np.append(np.array([r["v"] for r in top], np.int64).view(np.uint64), start))
    return out


def _packs(v: np.ndarray, w: np.ndarray, counts: list, suffixes: list, shard: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A pack for each shard; grams are sorted by v, then w."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cut = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = order[lo:hi]
        yield int(shard[lo]), pack(v[own], w[own], [c[own] for c in counts], [s[own] for s in suffixes])


def _count_tasks(shards: int, spread: np.ndarray, params: LmParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ctx = [np.concatenate(x) for x in zip(*[contexts_of(t, params.order) for t in held], strict=True)]
            w = np.concatenate(held)
            v, w, counts, suffixes = merge_grams(ctx[-1], w, [np.ones(len(w), np.int64)], ctx[-2::-1])
            shard, _ = pair_shard(v, w, shards, spread)
            for p, data in _packs(v, w, counts, suffixes, shard):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([data], pa.binary())], names=["p", "data"])

        for batch in batches:
            texts = batch.column(0)
            for i in range(batch.num_rows):
                held.append(token_hashes(texts[i].as_py()))
                size += len(held[-1])
                if size >= params.flush_tokens:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _count_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _gram_shard(folder: str, m: int, shards: int, spread: dict[int, np.ndarray]):
    """Merge one shard's grams of order m; write grams and contexts; pass on what is learnt about grams a word shorter."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d) for d in pdf["data"]]
        join = lambda i, k: [np.concatenate([x[i][j] for x in parts]) for j in range(k)]
        v, w = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        v, w, counts, suffixes = merge_grams(v, w, join(2, len(parts[0][2])), join(3, len(parts[0][3])))
        del parts
        c, times = counts[0], counts[-1]  # the highest order's counts are both
        shard = int(pdf["p"].iloc[0])
        g = pair_hash(v, w)
        order = np.argsort(g)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        groups = [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c > 2)]
        context = v[first]
        wide = among(context, spread[m])
        rows = [
            {"kind": "spread", "p": shard, "stats": [int(context.view(np.int64)[i]), *[int(x[i]) for x in groups]], "data": None}
            for i in np.flatnonzero(wide)
        ]
        own = [context[~wide], groups[0][~wide].astype("<u8"), *[_narrow(x[~wide]) for x in groups[1:]]]
        _save(folder, f"{m}-{shard}", [g[order], _narrow(c[order]), *own])
        ones = np.ones(len(w), np.int64)
        if m > 2:
            v, w, counts, suffixes = merge_grams(suffixes[0], w, [ones, times], suffixes[1:])
            target, _ = pair_shard(v, w, shards, spread[m - 1])
        else:  # words: each is its own context
            v, w, counts, suffixes = merge_grams(w, w, [ones, times])
            target = shard_of(w, shards)
        rows += [{"kind": "next", "p": p, "stats": None, "data": data} for p, data in _packs(v, w, counts, suffixes, target)]
        rows.append({"kind": "counts", "p": shard, "stats": _count_of_counts(c), "data": None})
        return pd.DataFrame(rows, columns=["kind", "p", "stats", "data"])

    return run


def _word_shard(folder: str):
    """Merge one shard of words: hash, count, number of contexts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d) for d in pdf["data"]]
        w = np.concatenate([x[1] for x in parts])
        _, w, (contexts, times), _ = merge_grams(w, w, [np.concatenate([x[2][k] for x in parts]) for k in (0, 1)])
        shard = int(pdf["p"].iloc[0])
        _save(folder, f"1-{shard}", [w, times.astype("<u8"), contexts.astype("<u8")])
        stats = [*_count_of_counts(contexts), len(w), int(times.sum()), int(contexts.sum()), int((contexts > 2).sum())]
        return pd.DataFrame([{"p": shard, "stats": stats}])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D for counts 1, 2 and 3 or more; an absolute discount of a half where counts of counts are missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for d, k in zip(found, (1, 2, 3), strict=True))


@dataclass(frozen=True)
class LmModel:
    """Where the arrays lie, and the few numbers that hold for the whole corpus. discounts and spread are by order, from 2."""

    folder: str
    order: int
    shards: int
    discounts: tuple
    word_discounts: tuple
    tokens: int
    vocabulary: int
    pairs: int
    word_backoff: float
    spread: tuple = ()


def _sums(rows: DataFrame, n: int) -> list[int]:
    """Sums over all rows of the places of ``stats``."""
    found = rows.agg(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(n)]).first()
    return [int(x) for x in found]


def train(texts: DataFrame, params: LmParams = LmParams()) -> LmModel:
    """Count the column ``text`` of every row."""
    if params.order < 2:
        raise ValueError("the order of a model is 2 or more")
    spark = texts.sparkSession
    folder = common.fresh_path(spark, "lm")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-int(size) // params.chars_per_shard))
    spread = frequent_contexts(texts, int(size), params)
    packed = texts.select("text").mapInArrow(_count_tasks(shards, spread[params.order], params), "p int, data binary")
    found, wide = {}, {}
    for m in range(params.order, 1, -1):
        dealt = packed.groupBy("p").applyInPandas(_gram_shard(folder, m, shards, spread), "kind string, p int, stats array<long>, data binary")
        dealt = common.written(dealt, f"lm-{m}")
        found[m] = discounts(*_sums(dealt.where("kind = 'counts'"), 4))
        sums = [F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(1, 5)]
        # max_spread rows at most
        rows = dealt.where("kind = 'spread'").groupBy(F.get("stats", F.lit(0)).alias("v")).agg(*sums).collect()
        wide[m] = tuple(sorted(tuple(r) for r in rows))
        packed = dealt.where("kind = 'next'").select("p", "data")
    words = common.written(packed.groupBy("p").applyInPandas(_word_shard(folder), "p int, stats array<long>"), "lm-1")
    n1, n2, n3, n4, vocabulary, tokens, contexts, more = _sums(words, 8)
    word_d = discounts(n1, n2, n3, n4)
    freed = word_d[0] * n1 + word_d[1] * n2 + word_d[2] * more
    orders = range(2, params.order + 1)
    return LmModel(
        folder, params.order, shards, tuple(found[m] for m in orders), word_d, tokens, vocabulary, contexts,
        freed / contexts if contexts else 1.0, tuple(wide[m] for m in orders),
    )


# ---------------------------------------------------------------- scoring


class MappedModel:
    """The arrays of a model in one worker. Files are mapped when first touched."""

    def __init__(self, model: LmModel):
        self.model = model
        self.open: OrderedDict[str, list[np.ndarray]] = OrderedDict()
        self.spread = []
        for own in model.spread:
            table = np.array(sorted((v % 2**64, *rest) for v, *rest in own), dtype=object).reshape(-1, 5)
            self.spread.append((table[:, 0].astype(np.uint64), table[:, 1:].astype(float).T))

    def arrays(self, name: str) -> list[np.ndarray] | None:
        """The arrays of a file. At most ``OPEN_FILES`` stay mapped, those used last."""
        if name not in self.open:
            while len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)
            self.open[name] = _open(self.model.folder, name)
        self.open.move_to_end(name)
        return self.open[name]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of sorted wanted keys, and which are there."""
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)

    def words(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and unigram probability of distinct sorted word hashes."""
        m = self.model
        count, contexts = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        shard = shard_of(w, m.shards)
        for s in np.unique(shard):
            if (found := self.arrays(f"1-{s}")) is None:
                continue
            keys, times, ctx = found
            own = np.flatnonzero(shard == s)
            at, there = self._find(keys, w[own])
            count[own[there]] = times[at[there]]
            contexts[own[there]] = ctx[at[there]]
        d = np.array([0.0, *m.word_discounts])[np.minimum(contexts, 3)]
        kept = (contexts - d).clip(0) / m.pairs if m.pairs else np.zeros(len(w))
        return count, kept + m.word_backoff / (m.vocabulary + 1)

    def grams(self, level: int, v: np.ndarray, w: np.ndarray, p_word: np.ndarray) -> np.ndarray:
        """p(w|v) of grams of that order, given the probability of the next order down."""
        m = self.model
        out = p_word.copy()
        spread, spread_stats = self.spread[level - 2]
        shard, wide = pair_shard(v, w, m.shards, spread)
        order = np.argsort(shard, kind="stable")
        cut = np.append(np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0])), len(order))
        d = np.array([0.0, *m.discounts[level - 2]])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = order[lo:hi]
            if (found := self.arrays(f"{level}-{shard[own[0]]}")) is None:
                continue
            g, c, ctx, *stats = found
            keys, kback = np.unique(pair_hash(v[own], w[own]), return_inverse=True)
            at, there = self._find(g, keys)
            n = np.where(there, c[at], 0).astype(np.int64)
            kept = (n - d[np.minimum(n, 3)]).clip(0)[kback]
            for part, known, known_stats in ((~wide[own], ctx, stats), (wide[own], spread, spread_stats)):
                here = own[part]
                if not len(here):
                    continue
                contexts, back = np.unique(v[here], return_inverse=True)
                at, there = self._find(known, contexts)
                if len(known):
                    total, one, two, more = (np.where(there, x[at], 0).astype(float) for x in known_stats)
                else:
                    total = one = two = more = np.zeros(len(contexts))
                total = np.where(there, total, 1.0)
                free = np.where(there, d[1] * one + d[2] * two + d[3] * more, 1.0) / total
                out[here] = kept[part] / total[back] + free[back] * p_word[here]
        return out

    def score(self, docs: list[np.ndarray]) -> list[tuple]:
        """Per token array: n_tokens, n_known, base score, score."""
        m = self.model
        sizes = np.array([len(x) for x in docs])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        w = np.concatenate(docs)
        contexts = [np.concatenate(x) for x in zip(*[contexts_of(x, m.order) for x in docs], strict=True)]
        distinct, back = np.unique(w, return_inverse=True)
        count, p_word = self.words(distinct)
        base = np.log10((count + 1) / (m.tokens + m.vocabulary + 1))
        p = p_word[back]
        for level, v in enumerate(contexts, 2):
            p = self.grams(level, v, w, p)
        sums = [np.add.reduceat(x, first) for x in ((count > 0)[back].astype(np.int64), base[back], np.log10(p))]
        return list(zip(sizes.tolist(), *[x.tolist() for x in sums], strict=True))


@lru_cache(maxsize=1)
def _mapped(model: LmModel) -> MappedModel:
    return MappedModel(model)


def score_documents(docs: DataFrame, model: LmModel, params: LmParams = LmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = _mapped(model)
        for batch in batches:
            ids, held, texts = batch.columns
            at, rows, waiting, size = 0, [], [], 0
            for i in range(batch.num_rows):
                waiting.append(token_hashes(texts[i].as_py()))
                size += len(waiting[-1])
                if size >= params.score_tokens:
                    rows += mapped.score(waiting)
                    waiting, size = [], 0
            if waiting:
                rows += mapped.score(waiting)
            if not rows:
                continue
            n, known, base, score = (np.array(x) for x in zip(*rows, strict=True))
            with np.errstate(over="ignore"):
                perplexity = np.power(10.0, -score / n)
            yield pa.RecordBatch.from_arrays(
                [ids, held, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.tokens] * len(rows), pa.int64()),
                 pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(perplexity, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double",
    )
