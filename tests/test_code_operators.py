"""Fixture pins and metamorphic tests of the line, duplicate and code operators."""

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import languages, text
from codeloom.jsast import shapes
from codeloom.jsast.parse import parse
from codeloom.jsast.scan import JsError
from codeloom.operators import comments, coverage, duplicates, functions, graph, lines, pyast
from codeloom.sources import tables

VALIDATORS = '''import os

def check_user(name, email):
    if not name:
        raise ValueError("name missing")
    if not email or "@" not in email:
        raise ValueError("mail malformed")
    return {"name": name, "email": email}

def check_admin(name, email):
    if not name:
        raise ValueError("name missing")
    if not email or "@" not in email:
        raise ValueError("mail malformed")
    return {"name": name, "email": email, "admin": True}

# a remark
RESULT = []
for i in range(3):
    if i % 2 == 0:
        RESULT.append(i)
'''
RUST_A = "// remark A\n/* block A */\nfn process(x: i32) -> i32 {\n    if x > 0 {\n        return x + 1;\n    }\n    x - 1\n}\n"
RUST_B = "// remark B, another one\n/* block B */\n// and more\nfn process(x: i32) -> i32 {\n    if x > 0 {\n        return x + 1;\n    }\n    x - 1\n}\n"


def frame(spark, *files):
    return spark.createDataFrame([(p, p[p.rindex("."):], c) for p, c in files], "path string, ext string, content string")


def near(blocks, least=0.85):
    texts = list(dict.fromkeys(b for _, _, b in sorted(blocks)))
    out = 0
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            a, b = texts[i], texts[j]
            out += abs(len(a) - len(b)) <= 0.4 * max(len(a), len(b)) and SequenceMatcher(None, a, b).ratio() >= least
    return out


def test_rust_fixture(spark):
    files = frame(spark, ("one.rs", RUST_A), ("other.rs", RUST_B))
    blocks = duplicates.windows(files, 5, strip_c=True)
    assert blocks.count() == 4
    assert duplicates.cluster_sizes(blocks).count() == 2
    assert duplicates.near_pairs_difflib(blocks).count() == 0
    loc = {r.path: (r.code, r.blank, r.comment) for r in lines.inventory(files).collect()}
    assert loc == {"one.rs": (6, 0, 2), "other.rs": (6, 0, 3)}


def test_python_fixture(spark):
    files = frame(spark, ("src/app.py", VALIDATORS))
    blocks = duplicates.windows(files, 5)
    rows = [(r.path, r.line, r.block) for r in blocks.collect()]
    assert len(rows) == 14
    assert duplicates.near_pairs_difflib(blocks).count() == near(rows) == 9
    assert duplicates.cluster_sizes(blocks).count() == 0
    assert tuple(lines.inventory(files).select("code", "blank", "comment").first()) == (17, 3, 1)
    total = functions.complexity_totals(functions.complexity(files)).first()
    assert (total.functions, total.total_complexity, total.avg_complexity, total.max_complexity) == (2, 8, 4.0, 4)


def sequential(source, ext):
    """The line classes by one walk over the file."""
    start, end = languages.BLOCK_COMMENT.get(ext, (None, None))
    marker, inside, out = languages.LINE_COMMENT.get(ext), False, Counter()
    for line in map(str.strip, source.split("\n")):
        if not line:
            out["blank"] += 1
        elif inside:
            out["comment"] += 1
            inside = end not in line
        elif start and line.startswith(start):
            out["comment"] += 1
            inside = end not in line[len(start):]
        elif marker and line.startswith(marker):
            out["comment"] += 1
        else:
            out["code"] += 1
    return out["code"], out["blank"], out["comment"]


@pytest.mark.parametrize("ext", [".py", ".js", ".html", ".css", ".svelte", ".mjs"])
def test_inventory_is_the_sequential_walk(spark, ext):
    rng = random.Random(ext)
    parts = ["/*", "*/", '"""', "<!--", "-->", "#", "//", "x = 1", " ", "\t", "/*/", "", "\u00a0"]
    sources = ["\n".join("".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) for _ in range(8)) for _ in range(400)]
    got = {r.path: (r.code, r.blank, r.comment) for r in lines.inventory(frame(spark, *[(f"{i}{ext}", s + "\n") for i, s in enumerate(sources)])).collect()}
    assert got == {f"{i}{ext}": sequential(s, ext) for i, s in enumerate(sources)}


def test_lines_and_masks(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n\nd",), ("",), ("x\n",), (None,)], "t string").select(text.split_lines(F.col("t")).alias("l"))
    assert [r.l for r in df.collect()] == [["a", "b", "c", "", "d"], [], ["x"], []]
    row = spark.createDataFrame([("  a\t 'x' +  \"y\" + 12 + 1.5 + v2 ",)], "t string").select(text.normalized(F.col("t"), True)).first()
    assert row[0] == "a STR + STR + NUM + NUM + v2"


def test_c_comments():
    source = ['int a; // x', 's = "// no"; /* b */ c', "d /* open", "still", "end */ e", "f // /* g", "/* one */ h /* two"]
    assert comments.strip_all(source) == ["int a; ", 's = "// no";  c', "d ", "", " e", "f ", " h /* two"]


def test_pair_budget_is_the_double_loop(spark):
    blocks = spark.createDataFrame([(f"h{i}", "p", i, f"b{i}") for i in range(13)], "h string, path string, line int, block string")
    for cap in (0, 1, 5, 20, 77, 500):
        for inclusive in (True, False):
            want, done = [], 0
            for i in range(13):
                for j in range(i + 1, 13):
                    done += 1
                    if done <= cap + inclusive:
                        want.append((i, j))
            got = duplicates.capped_pairs(blocks, cap, inclusive)
            assert sorted((r.a_line, r.b_line) for r in got.collect()) == want


def dice(a, b):
    if not a or not b:
        return float(not a and not b)
    if len(a) + len(b) == 2:
        return float(a == b)
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


def test_dice_and_uncapped_pairs(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += [t + " zz" for t in texts[:20]]
    pairs = [(texts[i].split(), texts[j].split()) for i in range(40) for j in (i, i + 1, i + 20)]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(duplicates.dice(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 9) for r in got] == [round(dice(a, b), 9) for a, b in pairs]
    own = [t for t in dict.fromkeys(texts) if len(t.split()) > 1]
    blocks = spark.createDataFrame([(str(i), "p", i, t) for i, t in enumerate(own)], "h string, path string, line int, block string")
    want = {tuple(sorted((i, j))) for i in range(len(own)) for j in range(i) if dice(own[i].split(), own[j].split()) >= 0.85}
    assert {tuple(sorted((r.a_line, r.b_line))) for r in duplicates.similar_pairs(blocks).collect()} == want


# ---------------------------------------------------------------- JavaScript

PAIRS = """
export function sameA(mail, age) {
  const m = mail.trim();
  if (!m) return false;
  if (m.length > 99) return false;
  if (!/^[^@]+@[^@]+$/.test(m)) return false;
  if (age < 13) return false;
  return true;
}
export function sameB(value, years) {
  const s = value.trim();
  if (years < 13) return false;
  if (!/^[^@]+@[^@]+$/.test(s)) return false;
  if (s.length > 99) return false;
  if (!s) return false;
  return true;
}
export function loop(users) {
  const out = [];
  for (const u of users) {
    if (u.active) {
      out.push(u.email);
    }
  }
  return out;
}
export function chain(list) {
  // remark
  return list
    .filter((u) => u.active)
    .map((u) => u.email);
}
"""
GUARDS = """
function byId(r) {
  const parts = [];
  parts.push(r.id);
  parts.push(r.id.toUpperCase());
  return parts.join("-");
}
function byName(r) {
  const parts = [];
  parts.push(r.name);
  parts.push(r.name.toUpperCase());
  return parts.join("-");
}
function down(a, b) {
  const t = a - b;
  const d = t - b;
  return d * 2;
}
function up(a, b) {
  const t = a + b;
  const d = t + b;
  return d * 2;
}
"""


def clusters(source, canonical):
    rows, error = shapes.analyze(source, canonical)
    assert error is None
    return sorted(n for n in Counter(r["fingerprint"] for r in rows if r["n_lines"] >= 5).values() if n > 1)


def test_canonical_shapes():
    assert clusters(PAIRS, False) == []
    assert clusters(PAIRS, True) == [2, 2]
    assert clusters(GUARDS, False) == [2, 2]
    assert clusters(GUARDS, True) == []


def test_renaming_keeps_the_shape_and_operators_do_not():
    base = "function f(a, b) {\n  let c = a + b;\n  while (c > 0) {\n    c -= a;\n  }\n  return c;\n}\n"
    one = shapes.analyze(base, True)[0][0]["fingerprint"]
    renamed = base.replace("a", "x").replace("b", "y").replace("c", "z").replace("funztion", "function")
    assert shapes.analyze(renamed.replace("xb", "y"), True)[0][0]["complexity"] == 2
    assert shapes.analyze("function g(p, q) {\n  let r = p + q;\n  while (r > 0) {\n    r -= p;\n  }\n  return r;\n}\n", True)[0][0]["fingerprint"] == one
    assert shapes.analyze(base.replace("a + b", "a - b"), True)[0][0]["fingerprint"] != one
    assert shapes.analyze(base.replace("a + b", "a - b"), False)[0][0]["fingerprint"] == shapes.analyze(base, False)[0][0]["fingerprint"]


def test_operand_order():
    one = "function f(a, b) {\n  if (a.x && b.y || null === a.z) {\n    return 1;\n  }\n  return 2;\n}\n"
    two = "function f(a, b) {\n  if (a.z === null || b.y && a.x) {\n    return 1;\n  }\n  return 2;\n}\n"
    (x,), (y,) = (shapes.analyze(s, True)[0] for s in (one, two))
    assert x["complexity"] == y["complexity"] == 4


SYNTAX = r"""
import React, {useState as us} from "react"; import type {A} from './a';
export default class Foo<T extends object> extends Bar<T> implements Baz { static #x = 1; readonly y?: string = "a"; constructor(private a: number, b = 2) { super(); }
 get z(): number { return this.#x ?? 0 } static async *gen({a, ...r}: {a: number}, [c,,d] = []) { yield* a; for await (const q of r) {} } @dec() method<K>(k: K): asserts k is K { return k! as unknown as K } [Symbol.iterator]() {} }
const f = async (x: number, y?: string): Promise<void> => { switch (x) { case 1: case 2: break; default: return } };
let g = <T,>(a: T) => a, h = a => b => ({a, b, get c() { return 1 }, async d() {}, [`k${a}`]: /re[/]x/g.test(b) ? a : b});
interface Q { a: string; b(): void } type U = { [K in keyof Q]?: Q[K] } | null; enum E { A = 1, B }
function over(a: string): void; function over(a: any) { label: for (let i = 0, n = a.length; i < n; i++) { if (!a[i]) continue label; } do { a-- } while (a > 0) try { throw new Error(`x ${a + `${1}`}`) } catch { } finally { debugger } }
const el = <div className="a" {...props}>don't {x && <B.C onClick={() => go(1)} />} <></> text's</div>;
var r = a / b / c, q2 = x ? (y) : z, w = x ? y => 1 : 2; [a, b] = [b, a]; ({a: b.c} = d); x ||= y ** 2 ** 3; a?.b?.[c]?.(d).e; new (foo())().bar; import("x").then(m => m.default); tag`a${1}b`;
for (const k in obj) if (k in obj) delete obj[k]; async function af() { await (async () => {})() } a = b
++c
"""


def test_syntax_is_read():
    rows, error = shapes.analyze(SYNTAX, True)
    assert error is None
    names = {r["function"]: r for r in rows}
    assert names["Foo.gen"]["params"] == ["(destructured)", "(complex)"] and names["Foo.constructor"]["params"] == ["a", "b"]
    assert names["over"]["complexity"] == 5 and names["f"]["complexity"] == 3 and "h.(anonymous).c" in names
    for bad in ("function (", "a b c", "'open", "x = `${", "if (", "}"):
        with pytest.raises(JsError):
            parse(bad)


def test_parse_errors_are_rows(spark):
    files = frame(spark, ("a.js", "function ("), ("b.py", "def ("), ("c.py", "x = 1"), ("d.ts", "let a: number = 1"))
    assert sorted(r.path for r in functions.parse_errors(files).collect()) == ["a.js", "b.py"]
    assert functions.complexity(files).count() == 0
    assert functions.complexity_totals(functions.complexity(files)).first().max_complexity == 0


def test_python_functions():
    source = "class A:\n    def m(self, a, n=3, *rest, email: str, **kw):\n        def inner():\n            return [x for x in a if x if n]\n        with a as b, n:\n            pass\n        return a and n and b if a else n\nasync def f(user_id, is_ok, data: dict, when: Optional[int], z):\n    async for i in z:\n        pass\n"
    rows, error = pyast.functions(source)
    assert error is None
    got = {r["function"]: (r["complexity"], r["line"], r["body_start"], r["is_method"]) for r in rows}
    assert got == {"A.m": (6, 2, 3, True), "A.m.inner": (3, 3, 4, False), "f": (2, 8, 9, False)}
    args = {r["function"]: r["arguments"] for r in rows}
    assert args["f"] == "user_id=0, is_ok=True, data={}, when=None, z=None"
    assert args["A.m"] == "a=None, n=3, *rest(), **kw={}"


# ---------------------------------------------------------------- coverage


def test_gaps(spark):
    source = "def covered():\n    x = 1\n    return x\n\ndef open_():\n    y = 2\n    return y\n"
    found = functions.python_functions(frame(spark, ("s.py", source)))
    report = spark.createDataFrame([('{"files": {"s.py": {"executed_lines": [1, 2, 3, 5, 6]}}}',)], "content string")
    executed = coverage.coverage_json(report)
    assert coverage.python_gaps(found, executed).count() == 0
    assert [r.function for r in coverage.python_gaps(found, executed.where("line < 5")).collect()] == ["open_"]
    assert coverage.python_gaps(found, executed.limit(0)).count() == 2
    stub = coverage.python_stub(coverage.python_gaps(found, executed.where("line < 5"))).first()
    assert "from s import open_" in stub.source and "def test_open_():" in stub.source


def test_stub_states(spark):
    rows = [(None,), ("by hand",), (f"# {coverage.HEADER}\n  assert x",), (f"# {coverage.HEADER}\nprint(1)",)]
    df = spark.createDataFrame(rows, "c string").select(coverage.stub_state(F.col("c")).alias("s"))
    acts = [tuple(r) for r in df.select("s", coverage.stub_action(F.col("s"), F.lit(True)), coverage.stub_action(F.col("s"), F.lit(False))).collect()]
    assert acts == [("missing", "write", "none"), ("pinned", "preserve", "preserve"), ("pinned", "preserve", "preserve"), ("generated", "refresh", "remove")]


def test_js_counts_decide(spark):
    found = functions.js_functions(frame(spark, ("a.js", "class K { m() {\n  x();\n} }\nfunction f() {\n  y();\n}\nfunction g() {\n  z();\n}\n")))
    lcov = ["SF:a.js", "FNDA:1,m", "FNDA:0,f", "DA:5,1", "DA:8,2", "end_of_record"]
    raw = spark.createDataFrame([("r", i, t) for i, t in enumerate(lcov)], "report string, line_no int, line string")
    records = coverage.unique_hits(coverage.lcov_records(raw))
    assert [r.function for r in coverage.js_gaps(found, records).collect()] == ["f"]  # its count says 0, though a line ran
    assert [r.function for r in coverage.js_gaps(found, records.limit(0)).orderBy("function").collect()] == ["K.m", "f", "g"]


# ---------------------------------------------------------------- graphs


def test_merge_clusters(spark):
    rows = [("x", "a", 1), ("x", "b", 1), ("y", "b", 1), ("y", "c", 9), ("z", "d", 4), ("z", "e", 4), ("w", "q", 1)]
    got = graph.merge_clusters(spark.createDataFrame(rows, "cluster string, path string, line int")).collect()
    by = {}
    for r in got:
        by.setdefault(r.cluster, set()).add((r.path, r.line))
    assert sorted(map(sorted, by.values())) == [[("a", 1), ("b", 1), ("c", 9)], [("d", 4), ("e", 4)]]


def test_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("s", "s"), ("x", "y"), ("y", "x"), ("y", "z")]
    got = graph.cycles(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r.node: r.cycle for r in got} == {"a": "a", "b": "a", "c": "a", "s": "s", "x": "x", "y": "x"}


def test_tables_as_corpora(spark):
    files = tables.document_files(spark, "/root/testdata/sf0.001")
    assert {r.ext for r in files.select("ext").distinct().collect()} <= {".py", ".js", ".html", ".rs", ".txt"}


def test_pairs_beyond_the_budget_are_found(spark, tmp_path):
    """The only near pair lies after the first 4,002 texts; one of its files is changed."""
    from codeloom.plans import catalogue

    text = lambda i: "\n".join(f"w{i}x{j} v{i}x{j} u{i}x{j} t{i}x{j}" for j in range(5))
    rows = [(10_000 + i, "s", "en", text(i)) for i in range(4100)] + [(99_999, "s", "en", text(4099) + "z")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(99_999,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("near_pairs_dice_all", "changed_scope_pairs_all"):
        got = catalogue.queries()[name](spark, str(tmp_path)).collect()
        assert [(r.a_path, r.b_path) for r in got] in ([("s/14099.py", "s/99999.py")], [("s/99999.py", "s/14099.py")]), name


def test_graphs_of_any_size(spark):
    """The forms for one task and for many rounds give what a plain search gives."""
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (75, 2))] + [(100 + i, 101 + i) for i in range(7)] + [(107, 100)]
    edges += [(200, 201), (201, 202), (202, 201), (202, 203), (203, 204), (204, 203), (300, 300)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def reach(a, links):
        seen, todo = set(), [a]
        while todo:
            for w in links.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    far = {a: reach(a, after) for a in after}
    want = {a: min(b for b in far[a] if a in far[b]) for a in after if a in far[a]}
    both = {}
    for a, b in edges:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    tied = {a: min({a} | reach(a, both)) for a in both}
    for kind, name in (("long", int), ("string", lambda x: f"n{x:04d}")):
        frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"src {kind}, dst {kind}").repartition(5)
        for held in (1_000_000, 12):
            assert {r.node: r.cycle for r in graph.cycles(frame, held).collect()} == {name(a): name(c) for a, c in want.items()}
            got = graph.components(frame.toDF("a", "b"), held).collect()
            assert {r.node: r.component for r in got} == {name(a): name(c) for a, c in tied.items()} and len(got) == len(tied)
    nothing = spark.createDataFrame([], "src long, dst long")
    assert graph.cycles(nothing).count() == 0 and graph.components(nothing.toDF("a", "b")).count() == 0
