"""Quality rules, line dedup, mixing, licenses: against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import licenses, line_dedup, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\f\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_counts(rows):
    return Counter(map(repr, rows))


# ---------------------------------------------------------------- quality rules


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def test_measures(odd_docs, plain_rows):
    got = quality_rules.measure(odd_docs, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    want = []
    for r in plain_rows:
        m = measures(r[1])
        want.append((r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert by_counts(tuple(r) for r in got.collect()) == by_counts(want)


def test_repeats_by_hand(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f", "x\nx\n\n \ny", "a b c d e q a b c d e q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in quality_rules.measure(docs, ["doc_id"]).collect()}
    assert got == {i: (measures(t)[4], measures(t)[3]) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (100, 3, 0.05), (5000, 12, 0.005), (1000, 0, 0.005), (40, 20, 0.5)])
def test_binomial(spark, n, k, p):
    exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
    row = spark.range(1).select(quality_rules.log_binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()
    assert math.isclose(math.exp(row[0]), exact, rel_tol=1e-6)


def test_cutoffs_are_proven(spark):
    """A symbol ratio that good documents never exceed is certified; one that they do is not; small strata certify nothing."""
    good = [(i, "en", 100, 300, 0, 0, 5, 0, False) for i in range(1500)]
    good += [(5000 + i, "en", 100, 300, 60, 0, 5, 0, False) for i in range(30)]  # ratio 0.2, too many to lose
    good += [(9000 + i, "de", 100, 300, 0, 0, 5, 0, False) for i in range(50)]
    cols = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, base_failed boolean"
    measured = spark.createDataFrame(good, cols)
    labels = measured.select("doc_id", F.lit(1).alias("quality"))
    cut = {r.stratum: r for r in quality_rules.calibrate(measured, labels).collect()}
    assert set(cut) == {"en"}
    assert cut["en"].max_symbol_ratio == 0.2  # "exceeds 0.2" rejects none; 0.15 would reject 30 of 1530
    assert cut["en"].max_repeat_ratio == 0.1
    judged = quality_rules.judge(measured.withColumn("n_symbols", F.lit(100)), quality_rules.calibrate(measured, labels))
    assert {(r.lang, r.kept) for r in judged.select("lang", "kept").distinct().collect()} == {("en", False), ("de", True)}


def test_every_stratum_is_tested(spark):
    """More strata than any fixed number: each with enough labels has its cutoffs, broadcast or not."""
    strata, each = 70, 2000
    cols = [((F.col("id") % strata).cast("string"), "lang"), (100, "n_words"), (300, "word_chars"), (0, "n_symbols"), (0, "n_dup_lines"), (5, "n_lines"), (0, "n_repeat_words")]
    measured = spark.range(strata * each).select(
        F.col("id").alias("doc_id"), *[(c if n == "lang" else F.lit(c).cast("long")).alias(n) for c, n in cols], F.lit(False).alias("base_failed")
    )
    cutoffs = quality_rules.calibrate(measured, measured.select("doc_id", F.lit(1).alias("quality")))
    assert {r.stratum for r in cutoffs.collect()} == {str(i) for i in range(strata)}
    noisy = measured.where(F.col("doc_id") < strata).withColumn("n_symbols", F.lit(100))
    for rows in (10_000, 0):
        judged = quality_rules.judge(noisy, cutoffs, quality_rules.RuleParams(broadcast_rows=rows))
        assert judged.where("NOT kept").count() == strata


def test_filter_keeps_columns_and_base_passes(odd_docs, plain_rows, labels, no_docs):
    kept = quality_rules.filter_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    passes = [r for r in plain_rows if (m := measures(r[1]))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    assert by_counts(tuple(r)[:5] for r in kept.collect()) == by_counts(passes)  # too few labels to certify more
    assert quality_rules.filter_documents(no_docs, labels).count() == 0
    assert quality_rules.quality_verdicts(odd_docs, labels.limit(0)).count() == len(plain_rows)


# ---------------------------------------------------------------- line dedup


def dedup(rows, min_chars=10):
    key = lambda x: lower(x.strip(BLANKS))
    holders = defaultdict(set)
    for i, text, *_ in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [i is not None and len(holders.get(key(x), ())) > 1 and i != min(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup(odd_docs, plain_rows, batches, fanout):
    params = line_dedup.LineParams(batches=batches, fanout=fanout)
    got = line_dedup.deduped(odd_docs, params).select("doc_id", "n_lines", "n_dropped", "kept_text")
    assert by_counts(tuple(r) for r in got.collect()) == by_counts(dedup(plain_rows))


def test_dedup_documents(odd_docs, plain_rows, no_docs):
    got = line_dedup.dedup_documents(odd_docs)
    assert got.columns == odd_docs.columns
    want = []
    for r, (_, _, n, text) in zip(plain_rows, dedup(plain_rows)):
        want.append((r[0], None if r[1] is None else text, r[2], r[3], len(text) if n else r[4]))
    assert by_counts(tuple(r)[:5] for r in got.collect()) == by_counts(want)
    assert line_dedup.dedup_documents(no_docs).count() == 0


def test_runs_are_compacted(spark):
    store = line_dedup.RunStore(spark, fanout=2, buckets=4)
    for i in range(4):
        store.add(spark.createDataFrame([(i, i)], "h1 long, h2 long"))
    assert [len(x) for x in store.levels] == [0, 0, 1]
    marked = store.mark(spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "h1 long, h2 long"))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert {(r.h1, r.h2): r.known for r in marked.collect()} == {(1, 1): True, (1, 2): False, (3, 3): True}
    assert "SortMergeJoin" in plan
    store.close()


def test_a_store_takes_new_batches(spark, tmp_path):
    """What earlier calls hold goes; a broken call leaves the list of runs as it was."""
    params, folder = line_dedup.LineParams(batches=2, fanout=2), str(tmp_path / "store")
    rng, seen = random.Random(3), set()
    for day in range(5):
        rows = [(100 * day + i, "\n".join(f"line number {rng.randrange(60)}" for _ in range(6)) + "\nshort") for i in range(12)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        store = line_dedup.RunStore.open(spark, folder, params)  # as a later session would
        got = {r.doc_id: r.kept_text for r in line_dedup.deduped(docs, params, store).collect()}
        fresh = dedup([(i, t) for i, t in rows])
        for (i, text), (_, _, _, left) in zip(rows, fresh):
            assert got[i] == "\n".join(x for x in left.split("\n") if x == "short" or x not in seen), (day, i)
        seen |= {x for _, t in rows for x in t.split("\n")}
        if day == 2:  # breaks off before its list is written
            broken = line_dedup.RunStore.open(spark, folder, params)
            broken.add(spark.createDataFrame([(7, 7)], "h1 long, h2 long"))
            assert broken.live() != line_dedup.RunStore.open(spark, folder, params).live()
    assert len(store.live()) <= 2 * len(store.levels)
    for name in store.live():
        spark.sql(f"DROP TABLE {name}")  # another session's catalog does not know the runs
    again = line_dedup.RunStore.open(spark, folder, params)
    assert sum(spark.table(t).count() for t in again.live()) == len(seen - {"short"})
    again.close()


# ---------------------------------------------------------------- mixing


def test_mix(odd_docs, plain_rows, no_docs):
    got = [r.asDict() for r in mixing.mix(odd_docs).collect()]
    again = [r.asDict() for r in mixing.mix(odd_docs.repartition(7)).collect()]
    assert by_counts(got) == by_counts(again)
    assert len(got) == len(plain_rows)
    size = defaultdict(int)
    for r in plain_rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= full
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert r["taken"] == sum((x["to"] - x["from"]) * x["times"] for x in r["spans"])
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 3 * 64
    assert mixing.mix(no_docs).count() == 0


def test_thin_sources_reach_their_targets(spark):
    """Sources of a few words a shard, over hundreds of shards."""
    text = lambda n: " ".join(["w"] * n)
    thin = [("a", 15), ("b", 20), ("c", 40), ("d", 100)]
    rows = [(f"{s}{i}", text(n), s) for s, n in thin for i in range(300)] + [(f"z{i}", text(500), "z") for i in range(300)]
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    for weights, repeats in (((5.0, 2.0, 1.0), 2), ((1.0,), 2), ((1.0, 1.5, 0.5, 3.0, 40.0), 3)):
        params = mixing.MixParams(shard_words=700, weights=weights, max_repeats=repeats)
        got = mixing.mix(docs, params).select("source", "taken", "target", "size", "shard", "spans").collect()
        assert len({r.shard for r in got}) > 200
        taken, target = Counter(), {r.source: r.target for r in got}
        for r in got:
            assert 0 <= r.taken <= repeats * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - target[s]) <= 64 for s in target), (weights, taken, target)


def test_apportion_is_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        votes = rng.integers(0, 50, n).astype(float)
        caps = rng.integers(0, 30, n)
        seats = int(rng.integers(0, 60))
        want = np.zeros(n, int)
        for _ in range(int(min(seats, caps[votes > 0].sum()))):
            q = np.where((want < caps) & (votes > 0), votes / (2 * want + 1), -1)
            want[int(q.argmax())] += 1
        got = mixing.apportion(votes, seats, caps)
        assert got.sum() == want.sum()
        # equal up to ties: the multiset of quotients given is the same
        given = lambda g: sorted(round(votes[i] / (2 * k + 1), 9) for i in range(n) for k in range(g[i]))
        assert given(got) == given(want)


def test_mix_documents(odd_docs, no_docs):
    spans = {(r.doc_id, r.row_key): r for r in mixing.mix(odd_docs).collect()}
    got = mixing.mix_documents(odd_docs)
    assert got.columns == odd_docs.columns
    words = defaultdict(int)
    for r in got.select("doc_id", F.col("text")).collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    repeats = Counter((r.doc_id) for r in odd_docs.select("doc_id").collect())
    for (i, _), r in spans.items():
        if i is not None and repeats[i] == 1:
            assert words[i] == r.taken, i
    assert mixing.mix_documents(no_docs).count() == 0


# ---------------------------------------------------------------- licenses


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark, odd_docs, no_docs):
    mit = licenses.NOTICES["mit-notice"]
    words = mit.split()
    texts = [
        "Under the MIT License, mit license; the Apache-License", "GNU General\nPublic License general public", None, "", mit,
        " ".join(["lorem"] * 40 + words[:30] + ["inserted", "words"] + words[32:] + ["ipsum"] * 5), " ".join(words[:20]),
        "mit mit license license", "MIT LICENSEé ümit license", "x" * 50_000 + " apache license",
    ]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c"), (0, "apache license", "c"), (None, "mit license", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = licenses.scan(docs).collect()
    assert by_counts((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == by_counts(
        (i, *license_base(t)) for i, t, _ in rows
    )
    found = {r.doc_id: r for r in got if r.doc_id not in (0, None)}
    assert found[4].labels == "mit-notice" and found[4].score == 1.0
    assert found[5].labels == "mit-notice" and 0.5 <= found[5].score < 1
    assert found[6].labels == "" and found[6].score == 0
    assert licenses.scan(odd_docs).count() == odd_docs.count()
    assert licenses.scan(no_docs).count() == 0


def test_kept_hash_matches(odd_docs, plain_rows):
    got = line_dedup.deduped(odd_docs).select(F.sha2("kept_text", 256)).collect()
    assert Counter(r[0] for r in got) == Counter(hashlib.sha256(x[3].encode()).hexdigest() for x in dedup(plain_rows))


def test_license_templates_can_be_given(spark):
    own = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 2
    given = [("own", own), ("own", own), ("short", "three words only"), (None, own), ("null", None)]
    templates = spark.createDataFrame(given, "label string, text string")
    rows = [(1, "x y " + own.upper() + " z"), (2, own[:60]), (3, licenses.TEXTS["isc-text"]), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for params in (licenses.LicenseParams(), licenses.LicenseParams(broadcast_rows=0)):
        got = {r.doc_id: r for r in licenses.scan(docs, params, templates).collect()}
        assert got[1].labels == "own" and got[1].score == 1.0 and got[1].base_labels == ""
        assert got[4].labels == "" and "isc-text" in got[3].labels.split(",")
    assert "own" not in licenses.scan(docs).where("doc_id = 1").first().labels
    for label, text in licenses.BUILT_IN:
        found = licenses.scan(spark.createDataFrame([(1, "before " + text.lower() + " after")], "doc_id long, text string")).first()
        assert label in found.labels.split(",") and found.score == 1.0
