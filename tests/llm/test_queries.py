"""The registered queries: those with SQL against it, the pipeline stage by stage, odd and empty tables."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from codeloom.llm import bpe, registry
from test_models_and_copies import brute_classes, by_counts
from test_text_operators import dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    assert rows
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.sql(registry.oracle_sql()[name])
        at = [found.columns.index(c) for c in cols]
        assert sorted(found.columns) == cols and rows == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def table_dir(spark, path, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage against a plain program over what the one before it kept: null, empty, long and repeated rows among them."""
    import corpus_pipeline

    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [f"shared line {i} of the corpus" for i in range(4)]
    docs = []
    for i in range(60):
        docs.append((i, prose(rng.randint(20, 90)) + ("\n" + rng.choice(shared) if i % 3 == 0 else ""), "en", rng.choice(["a", "b", None]), 7))
    for i in range(60, 75):  # near copies
        words = docs[i % 5][1].split(" ")
        words[-1] = f"end{i}"
        docs.append((i, " ".join(words), "en", "a", 7))
    docs += [(80, None, None, None, None), (81, "", "en", "a", 0), (82, "too short", "en", "b", 9), (83, "word " * 50, "en", "b", 9), (84, prose(6000), "de", "a", 1)]
    docs += [(None, prose(30), "en", "a", 3), docs[7], docs[7]]
    sf = table_dir(spark, tmp_path, docs, [(i, 1, 0) for i in range(30)] + [(None, None, None)])
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: [tuple(r) for r in df.collect()]

    def failed(text):
        words = (text or "").split()
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        return len(words) < 10 or 100 * len(covered) > 20 * len(words)

    frame = spark.createDataFrame(docs, DOCS)
    good = stages["quality_rules"](spark, frame, sf)
    kept = rows(good)  # labels are too few for a learned rule
    assert by_counts(kept) == by_counts(d for d in docs if not failed(d[1]))
    clean = rows(stages["line_dedup"](spark, good, sf))
    want = [(r[0], text, r[2], r[3], len(text) if n else r[4]) for r, (_, _, n, text) in zip(kept, dedup(kept))]
    assert by_counts(clean) == by_counts(want)
    apart = rows(stages["near_join"](spark, spark.createDataFrame(clean, DOCS), sf))
    heads = {c for _, _, c, _ in brute_classes(clean) if c is not None}
    assert by_counts(apart) == by_counts(r for r in clean if r[0] is None or r[0] in heads) and len(apart) < len(clean)
    mixed = rows(stages["source_mix"](spark, spark.createDataFrame(apart, DOCS), sf))
    assert {r[0] for r in mixed} <= {r[0] for r in apart} and max(Counter(mixed).values()) <= 2 * max(Counter(apart).values())
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    coded = []
    for r in mixed:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        coded.append((r[0], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert by_counts(rows(stages["bpe"](spark, spark.createDataFrame(mixed, DOCS), sf))) == by_counts(coded)
    assert by_counts(rows(corpus_pipeline.run(spark, sf))) == by_counts(coded)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    sf = table_dir(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
