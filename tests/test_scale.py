"""Steps whose cost must follow the rows: what the small tables cannot show by time is shown by the plan or by counting."""

import ast
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.jsast import scan
from codeloom.operators import coverage, duplicates, graph, plans, pyast
from codeloom.plans import code, forms
from codeloom.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("files", [code._python_files, code._js_files, lambda s, d: code._shape_files(s, d, True)])
def test_texts_to_parse_are_dealt_over_the_cores(spark, files):
    assert files(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_spread_keeps_rows_and_follows_bytes(spark):
    rows = tables.table(spark, SF, "part")
    many = tables.spread(rows, share=64)
    assert many.rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism
    assert sorted(many.collect()) == sorted(rows.collect())


@pytest.mark.parametrize("source", ["abc\\u0061 + abé * x́", "a b", " of\nin", "a  b /*\n*/ c // d\ne", "$a_1?.b#c", "if(x)y", "end", "'a\\\nb' c"])
def test_plain_names_are_read_as_by_the_general_rule(source, monkeypatch):
    def tokens():
        found, s, pos = [], scan.Scanner(source), 0
        while (t := s.token(pos, False)).kind != "end":
            found.append((t.kind, t.text, t.start, t.end, t.line, t.after_newline))
            pos = t.end
        return found

    quick = tokens()
    monkeypatch.setattr(scan, "_PLAIN", scan.re.compile("(?!)"))
    assert quick == tokens()


def test_tokens_are_read_once(monkeypatch):
    from codeloom.jsast.shapes import analyze

    read, whole = [], scan.Scanner._token
    monkeypatch.setattr(scan.Scanner, "_token", lambda s, pos, operand: read.append((pos, operand)) or whole(s, pos, operand))
    analyze("function f(a) { if (a && a.b) { a = (a) ? 1 : 2; } return a; }")
    assert len(read) == len(set(read))


def test_python_walk_misses_nothing():
    with open(pyast.__file__) as f:
        tree = ast.parse(f.read())
    kinds = lambda nodes: sorted(type(n).__name__ for n in nodes if not isinstance(n, ast.expr_context))
    assert kinds(pyast.everything(tree)) == kinds(ast.walk(tree))


def test_counts_of_functions_are_joined_not_searched(spark):
    """A map of a file's counts was searched for each of its functions, and two reports of one function made it fail."""
    found = spark.createDataFrame([("a.js", f"K{i % 3}.f{i}", 1, 2) for i in range(90)], "path string, function string, line int, end_line int")
    rows = [(r, "a.js", None, int(i % 5 > r), name) for i in range(60) for r, name in ((0, f"K{i % 3}.f{i}"), (3, f"f{i}"), (4, f"f{i}"))]
    rows += [(0, "a.js", 2, 1, None)]
    records = coverage.unique_hits(spark.createDataFrame(rows, "report int, path string, line int, hits int, function string"))
    got = coverage.js_gaps(found, records)
    assert "map" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.function for r in got.collect()) == sorted(f"K{i % 3}.f{i}" for i in range(60) if i % 5 == 0)


def first_fit(edges):
    before, color = {}, {}
    for a, b in edges:
        before.setdefault(b, []).append(a)
    for n in sorted({x for e in edges for x in e}):
        used, color[n] = {color[m] for m in before.get(n, ())}, 1
        while color[n] in used:
            color[n] += 1
    return {b: color[b] for b in before}


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_first_fit_in_a_stream(size):
    """Batches of any size give the plain loop's colors: chains, a node with very many neighbours, random graphs."""
    rng = random.Random(size)
    graphs = [[(i, i + 1) for i in range(99)], [(i, 99) for i in range(99)] + [(3, 5), (5, 99), (99, 100)]]
    graphs += [[tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * k)] for n in (5, 40, 150) for k in (1, 4, 12)]
    for edges in graphs:
        edges, fit, got = sorted(edges, key=lambda e: e[1]), plans.FirstFit(), {}
        a, b = np.array(edges, np.int64).T
        for i in range(0, len(edges), size):
            for found in fit.add(a[i : i + size], b[i : i + size]):
                got |= dict(zip(*(x.tolist() for x in found), strict=True))
        assert got | dict(zip(*(x.tolist() for x in fit.close()), strict=True)) == first_fit(edges)


def test_no_component_stands_in_one_group(spark):
    """One file ties all changes: what holds them keeps numbers and colors, not a component's edges."""
    rows = [(i, str(i), 1, "c", ["one", f"f{i % 7}"], [f"k:{i % 3}"], None, 1) for i in range(60)]
    changes = spark.createDataFrame(rows, plans.CHANGE.replace(", description string", ""))
    colored = plans.groups(changes)
    assert "FlatMapGroupsInPandas" not in colored._jdf.queryExecution().optimizedPlan().toString()
    assert {r.plan_order: r.color for r in colored.collect()} == {i: i + 1 for i in range(60)}
    wanted = plans.openers(colored).where("plan_order > 50")
    assert {(r.a, r.b) for r in plans.conflicts(changes, wanted).collect()} == {(a, b) for b in range(51, 60) for a in range(b)}
    sizes = {r.color: (r.members, r.files) for r in plans.group_sizes(changes, colored).collect()}
    assert sizes == {i + 1: (1, 2) for i in range(60)}


def test_all_near_pairs_as_by_brute_force(spark):
    """Repeated words, single words, equal words in other lines and texts at the threshold: no pair is lost, none is turned round."""
    rng = random.Random(4)
    texts = ["x", "y", "p q", "a\nb c", "a b\nc", "w " * 40 + "end", "w " * 41 + "end"]
    for _ in range(25):
        words = [f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randint(8, 60))]
        texts.append(" ".join(words))
        for n in (1, 1, 2, 3, 5):
            at = rng.sample(range(len(words)), n)
            texts.append(" ".join(f"z{rng.randint(0, 9)}" if i in at else w for i, w in enumerate(words)))
    texts = sorted(set(texts))
    rows = [(f"f{i:03d}", i, x, hashlib.sha1(x.encode()).hexdigest()) for i, x in enumerate(texts)]

    def dice(p, q):
        p, q = p.split(), q.split()
        x, y = (Counter(zip(t, t[1:])) for t in (p, q))
        return float(p == q) if len(p) == len(q) == 1 else 2 * (x & y).total() / (len(p) + len(q) - 2)

    want = {(a[1], b[1]): dice(a[2], b[2]) for a in rows for b in rows if a[3] < b[3] and dice(a[2], b[2]) >= 0.85}
    assert len(want) > 60
    got = duplicates.similar_pairs(spark.createDataFrame(rows, "path string, line int, block string, h string").repartition(3))
    assert {(r.a_line, r.b_line): r.ratio for r in got.collect()} == want
    # texts meet as numbers, and none is carried with its tokens and bigrams
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows", [lambda s, d: forms._named(s, d), forms.plan_entries])
def test_costly_expressions_are_dealt_over_the_cores(spark, rows):
    assert rows(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_members_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    rows = spark.createDataFrame([("x", "a", 1), ("x", "b", 1), ("y", "b", 1), ("y", "c", 9)], "cluster string, path string, line int")
    graph.merge_clusters(rows.withColumn("cluster", seen("cluster"))).collect()
    assert made.value == 4
