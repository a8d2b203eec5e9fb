"""Plans, deltas, excludes, reports, configuration, sinks and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom import cli, config
from codeloom.functions import languages, text
from codeloom.operators import delta, excludes, lines, plans, report
from codeloom.plans import change as change_queries
from codeloom.sources import files as fs


def plan(spark, changes):
    body = changes if isinstance(changes, str) else json.dumps({"changes": changes})
    return plans.changes_of(plans.read_plan(spark.createDataFrame([("p", body)], "plan string, content string")))


def change(i, files, tier=1, cluster=None, target=None):
    return {"id": i, "tier": tier, "files": files, "duplicateCluster": cluster or [], "target": target, "category": "dup"}


def grouped(spark, changes):
    rows = plan(spark, changes)
    edges = plans.conflicts(plans.candidates(rows))
    colored = plans.groups(rows, edges)
    by = {}
    for r in colored.collect():
        by.setdefault(r.color, []).append(r.plan_order)
    return [sorted(by[c]) for c in sorted(by)], edges, colored, rows


def test_first_fit(spark):
    groups, edges, colored, rows = grouped(spark, [change(1, ["mod_a.py"]), change(2, ["mod_b.py"]), change(3, ["mod_c.py"]), change(4, ["./MOD_A.py"])])
    assert groups == [[1, 2, 3], [4]]
    assert [(r.a, r.b, r.shared) for r in plans.scanned_conflicts(edges, colored).collect()] == [(1, 4, "mod_a.py")]
    assert [r.plan_order for r in plans.blocked_by(edges, colored).collect()] == [4]
    assert tuple(plans.partition_totals(rows, colored).first()) == (4, 4, 2)


def test_cluster_conflicts(spark):
    rows = [
        change(10, ["a.py"], cluster=["a.py:1", {"path": "b.py", "line": 2}]),
        change(11, ["b.py"], cluster=["b.py:2"]),
        change(12, ["c.py"], target="./A.py:1"),
        change(13, ["d.py"], target={"path": "b.py", "line": 2}),
    ]
    groups, edges, _, own = grouped(spark, rows)
    assert {(r.a, r.b): r.rule for r in edges.collect()} == {(1, 2): 2, (1, 3): 3, (1, 4): 3, (2, 4): 3}
    assert groups == [[1], [2, 3], [4]]
    assert sorted(r.id for r in plans.blind_spots(own).collect()) == ["12", "13"]


def test_deferral_and_errors(spark):
    rows = plan(spark, [change(20, ["a"]), change(21, ["b"], 2), change(22, []), change(23, ["c"], 3)])
    assert {r.id: r.tier for r in plans.deferred(rows).collect()} == {"21": 2, "22": 1, "23": 3}
    bad = plan(spark, [{"id": 2, "files": ["a"]}, change(1, ["a"]), change(1, ["b"]), "text", {"id": 9, "tier": "1"}])
    assert [r.plan_order for r in plans.plan_errors(bad).orderBy("plan_order").collect()] == [1, 3, 4, 5]
    keyed = plan(spark, json.dumps({"changes": {"7": {"tier": 1, "files": "x.py"}}}))
    assert [(r.id, r.files) for r in keyed.collect()] == [("7", ["x.py"])]
    assert plan(spark, "\ufeff" + json.dumps([change(1, ["a"])])).count() == 1
    assert plan(spark, "no json").count() == 0


def first_fit(n, edges):
    colors = {}
    for i in range(n):
        used = {colors[a] for a, b in edges if b == i and a in colors}
        colors[i] = next(c for c in range(1, n + 2) if c not in used)
    return colors


def test_plan_totals_counts_groups(spark):
    """The query's group_count against first-fit by pairwise comparison of the tier-1 changes."""
    sf = "/root/testdata/sf0.001"
    rows = sorted(r for r in change_queries._changes(spark, sf).select("plan_order", "tier", "files", "cluster", "targets").collect())
    own = [(r.plan_order, set(r.files), set(r.cluster), set(r.targets)) for r in rows if r.tier == 1 and r.files]
    color = {}
    for i, (n, files, cluster, targets) in enumerate(own):
        used = {color[m] for m, f, c, t in own[:i] if files & f or cluster & c or targets & c or t & cluster}
        color[n] = min(set(range(1, len(own) + 1)) - used)
    assert max(color.values()) > 1
    assert tuple(change_queries.plan_totals(spark, sf).first()) == (len(rows), len(own), max(color.values()))


def test_coloring_is_first_fit(spark):
    import random

    rng = random.Random(8)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)})
    rows = spark.createDataFrame([(i, str(i), 1, "c", [f"f{i}"], [], [], 1) for i in range(40)], plans.CHANGE.replace(", description string", ""))
    got = plans.groups(rows, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.plan_order: r.color for r in got} == first_fit(40, edges)


def test_tiers(spark):
    rows = plan(spark, [change(1, ["src/a.py"]), change(2, ["lib/b.py"], 3)])
    got = plans.effective_tier(rows, [("src/**", 2), ("**", 1)]).select("id", "effective_tier").collect()
    assert {r.id: r.effective_tier for r in got} == {"1": 2, "2": 3}


def test_batch_manifest(spark):
    subjects = [("a1", "dedupe: merge two helpers [verified: unit tests]"), ("b2", "rename: x"), ("c3", "no category here")]
    got = plans.batch_manifest(spark.createDataFrame(subjects, "sha string, subject string")).collect()
    assert [tuple(r) for r in got] == [("a1", "dedupe", "merge two helpers", "unit tests"), ("b2", "rename", "x", None)]


# ---------------------------------------------------------------- excludes

PATHS = ["vendor", "vendor/a.py", "x/vendor/b.js", "src/gen/a.py", "src/gen/deep/b.py", ".github/x.py", "a.min.js", "x/a.min.js", "src/a.py"]


@pytest.mark.parametrize(
    "pattern,dialect,want",
    [
        ("vendor/**", "python", {"vendor", "vendor/a.py"}),
        ("vendor", "python", {"vendor", "vendor/a.py", "x/vendor/b.js"}),
        ("src/*.py", "python", {"src/gen/a.py", "src/gen/deep/b.py", "src/a.py"}),
        ("src/*.py", "segment", {"src/a.py"}),
        ("src/gen/**", "segment", {"src/gen/a.py", "src/gen/deep/b.py"}),
        ("*.min.js", "python", {"a.min.js", "x/a.min.js"}),
        ("*.min.js", "segment", {"a.min.js"}),
        ("**/*.min.js", "segment", {"x/a.min.js"}),
        (".github/**", "python", {".github/x.py"}),
        ("./src/a.py", "segment", {"src/a.py"}),
    ],
)
def test_patterns(spark, pattern, dialect, want):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string").where(excludes.excluded(F.col("path"), [pattern], dialect))
    assert {r.path for r in df.collect()} == want


def test_scan(spark):
    files = spark.createDataFrame([(p, ".py") for p in ("a.py", "build/a.py", ".x/a.py", "b/venv/c.py", "ok/a.py")], "path string, ext string")
    assert {r.path for r in excludes.scan(files, ("py",)).collect()} == {"a.py", "ok/a.py"}
    assert {r.path for r in excludes.scan(files, (".py",), ["ok"]).collect()} == {"a.py"}


# ---------------------------------------------------------------- deltas


@pytest.mark.parametrize("rows,want", [([("a", 1.0, 2.0), ("b", None, 3.0)], True), ([("a", 2.0, 1.0)], False), ([("a", None, 1.0)], None), ([], None)])
def test_regression_has_three_values(spark, rows, want):
    metrics = spark.createDataFrame(rows, "metric string, base double, head double")
    assert delta.regression(metrics).first()[0] is want


def test_scope(spark):
    members = spark.createDataFrame([("h", "a.py", 1), ("h", "b.py", 2), ("g", "b.py", 9), ("g", "c.py", 9)], "h string, path string, line int")
    changed = spark.createDataFrame([("./A.py",)], "path string")
    assert {r.path for r in delta.clusters_in_scope(members, changed).collect()} == {"a.py", "b.py"}
    pairs = spark.createDataFrame([("a.py", "z"), ("z", "a.py"), ("a.py", "a.py"), ("y", "z")], "a_path string, b_path string")
    assert delta.pairs_in_scope(pairs, changed).count() == 3


def test_comment(spark):
    metrics = spark.createDataFrame([("code", 10.0, 12.0), ("clusters", 0.0, 1.0)], "metric string, base double, head double")
    places = spark.createDataFrame([(f"f{i}|x", i) for i in range(12)], "path string, line int")
    body = delta.markdown_comment(metrics, places, 10).first()[0]
    assert "and 2 more" in body and "\\|" in body and "+20.0%" in body and "n/a" in body
    assert json.loads(delta.payload(metrics, places).first()[0])["regression"] is True


def test_upsert(spark):
    m = "<!-- m -->"
    events = lambda *b: spark.createDataFrame(list(enumerate(b)), "seq int, body string")
    state = lambda *b: spark.createDataFrame(list(b), "id long, body string")
    run = lambda s, e: sorted((r.action, r.id, r.body) for r in report.upsert_comments(s, e, m).collect())
    assert [r[0] for r in run(state(), events(m + "1"))] == ["create"]
    assert run(state((1, m + "1")), events(m + "2")) == [("update", 1, m + "2")]
    assert [r[:2] for r in run(state((1, m + "1"), (5, m + "1"), (3, "talk")), events(m + "2"))] == [("delete", 5), ("keep", 3), ("update", 1)]
    assert [r[0] for r in run(state((1, m + "1")), events("no marker"))] == ["keep"]


def test_sections(spark):
    doc = ["# Plan", "## Items NOT being touched", "- core — too risky", "text", "* api", "## Next", "- other"]
    lines_ = spark.createDataFrame([("d", i, t) for i, t in enumerate(doc)], "doc string, line_no int, line string")
    got = report.section_bullets(lines_, "Items not being touched").orderBy("line_no").collect()
    assert [(r.item, r.reason) for r in got] == [("core", "too risky"), ("api", "")]
    head = ["---", "name: 'x'", "description: >", "  words", "---", "name: y"]
    found = report.frontmatter(spark.createDataFrame([("d", i, t) for i, t in enumerate(head)], "doc string, line_no int, line string")).first()
    assert (found.name, found.has_description) == ("x", True)


def test_inputs(spark):
    one = lambda v: spark.createDataFrame([(json.dumps(v),)], "content string")
    batch = [{"sha": "a", "tier": 2, "summary": "s"}, 5]
    assert report.batches(one(batch)).count() == report.batches(one({"batches": batch})).count() == 1
    left = report.not_touched(one({"notTouched": ["x", {"name": "y", "why": "z"}]})).collect()
    assert [tuple(r) for r in left] == [("x", ""), ("y", "z")]


def test_formats(spark):
    row = spark.range(1).select(
        text.delta_label(F.lit(10), F.lit(12), "n/a"), text.delta_label(F.lit(0), F.lit(1), "n/a"), text.verdict(F.lit(2), F.lit(1)),
        text.bar_width(F.lit(0), F.lit(10)), text.bar_width(F.lit(5), F.lit(10)), text.html_escape(F.lit("<a & 'b'>")), text.identifier(F.lit("a.b-c")),
        text.display_path(F.lit("/w/x/y"), "/w"), text.path_key(F.lit(".\\A\\Straße")), text.block_key(F.lit("./P/a.PY: 12")),
    ).first()
    assert list(row) == ["+20.0%", "n/a", "good", 2, 190, "&lt;a &amp; &#x27;b&#x27;&gt;", "a_b_c", "x/y", "a/strasse", "p/a.py:12"]


def test_hints(spark):
    files = spark.createDataFrame([(".rs",), (".go",), (".py",)], "ext string")
    assert {r.language for r in languages.language_hints(files).collect()} == {"Rust", "Go"}


# ---------------------------------------------------------------- configuration, sinks, command line


def test_config(tmp_path):
    (tmp_path / "a/b/c/d").mkdir(parents=True)
    (tmp_path / "a" / config.FILE_NAME).write_text('{"_note": 1, "duplication": {"minLines": 3}, "ci": {"_x": 1}}')
    found, warning = config.load(str(tmp_path / "a/b/c"))
    assert warning is None and found["duplication"] == {"minLines": 3, "similarity": None} and "_note" not in found and found["ci"] == {"failOnRegression": False}
    assert config.load(str(tmp_path / "a/b/c/d"))[0]["duplication"]["minLines"] == 3
    (tmp_path / "a/b" / config.FILE_NAME).write_text("{")
    found, warning = config.load(str(tmp_path / "a/b"))
    assert found == config.DEFAULTS and warning
    assert config.resolve(0, 5) == 0 and config.resolve(None, False, 3) is False and config.resolve(None, None, 3) == 3


def test_archive_is_reproducible():
    files = [("b.txt", b"2"), ("a.txt", b"1")]
    one, two = fs.archive(files, "p"), fs.archive(files[::-1], "p")
    assert one == two and fs.verify_archive(one, files, "p") == []
    assert fs.verify_archive(one, [("b.txt", b"x"), ("a.txt", b"1")], "p") == ["p/b.txt"]


def test_checkpoints(spark, tmp_path):
    log = str(tmp_path / "log")
    for sha in ("aaa", "bbb"):
        fs.append_checkpoint(spark, log, sha, f"checkpoint: {sha}")
    fs.revert_checkpoint(spark, log, "aaa")
    assert [r.sha for r in plans.checkpoints(spark.read.parquet(log), "checkpoint").collect()] == ["bbb"]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "vendor").mkdir(parents=True)
    body = "def f(a):\n    if a:\n        return 1\n    b = a\n    c = b\n    return c\n"
    (root / "a.py").write_text(body)
    (root / "b.py").write_text("# x\n" + body)
    (root / "vendor/c.py").write_bytes(body.encode() + b"# \xff\xfe\n")
    (root / "t.js").write_text("function g(x) {\n  if (x) { return 1; }\n  return 2;\n}\n")
    return root


def test_tree_and_excludes(spark, tree):
    files = fs.read_tree(spark, str(tree))
    assert {r.path for r in files.collect()} == {"a.py", "b.py", "vendor/c.py", "t.js"}
    assert "\ufffd" not in "".join(r.content for r in files.collect())
    assert lines.totals(lines.inventory(files.where("ext = '.py'"))).first().files == 3


def test_commands(spark, tree, capsys, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    say = lambda *a: (cli.main([str(x) for x in a]), capsys.readouterr().out)
    assert say("loc", tree, "--save", tmp_path / "loc.json")[0] == 0
    assert json.loads((tmp_path / "loc.json").read_text())["totals"]["files"] == 4
    (tree / config.FILE_NAME).write_text('{"excludePaths": ["vendor/**"]}')
    code, body = say("loc", tree, "--diff", tmp_path / "loc.json")
    assert code == 0 and "files" in body and "-1" in body
    code, body = say("duplicates", tree, "--json")
    assert code == 0 and len(json.loads(body)["exact_clusters"]) == 2  # six lines hold two windows of five
    code, body = say("complexity", tree, "--save", tmp_path / "cx.json")
    assert code == 0 and json.loads((tmp_path / "cx.json").read_text())["totals"]["functions"] == 3
    assert json.loads(say("functions", tree)[1])["functions"][0]["params"] == ["x"]
    assert len(json.loads(say("gaps", tree, "--json", "--emit-dir", tmp_path / "stubs")[1])) == 3
    assert len(os.listdir(tmp_path / "stubs")) == 3
    (tmp_path / "plan.json").write_text(json.dumps({"changes": [change(1, ["a"]), change(2, ["a"])]}))
    found = json.loads(say("partition", tmp_path / "plan.json", "--json")[1])
    assert found["group_count"] == 2 and [[m["blockedBy"] for m in g["changes"]] for g in found["groups"]] == [[[]], [[{"id": "1", "reason": "same file: a"}]]]
    (tmp_path / "plan.json").write_text('{"changes": []}')
    assert say("partition", tmp_path / "plan.json")[0] == 2
    assert say("report", "--output", tmp_path / "r.html")[0] == 1
    assert say("report", "--loc-after", tmp_path / "loc.json", "--output", tmp_path / "r.html")[0] == 0
    assert "<html>" in (tmp_path / "r.html").read_text()
    (tmp_path / "changed.txt").write_text("a.py\n")
    assert say("delta", "--base", tree, "--head", tree, "--changed", tmp_path / "changed.txt", "--json", "--fail-on-regression")[0] == 0
    assert say("dead", tree)[0] == 0
    assert say("package", tree, "--output", tmp_path / "p.zip")[0] == 1  # no manual
    (tree / "SKILL.md").write_text("---\nname: my tool\ndescription: x\n---\n")
    assert say("package", tree, "--output", tmp_path / "p.zip")[0] == 1  # a name with a space
    (tree / "SKILL.md").write_text("---\nname: tool\ndescription: >\n  x\n---\n")
    assert say("package", tree, "--output", tmp_path / "p.zip")[0] == 0
    log = tmp_path / "log"
    assert say("checkpoint", "save", "--log", log, "--sha", "a")[0] == 1
    assert say("checkpoint", "start", "--log", log)[0] == 0 and say("checkpoint", "start", "--log", log)[0] == 1
    assert say("checkpoint", "save", "--log", log, "--sha", "a", "--subject", "dedup: x")[0] == 0
    assert say("checkpoint", "list", "--log", log)[1].split() == ["a", "checkpoint:", "dedup:", "x"]


SCRIPTS = {
    "a.js": "import { used } from './lib';\nimport x from 'left';\nexport function f(a) {\n  const b = a;\n  if (b) {\n    return used(b);\n  }\n  return x;\n}\n",
    "b.js": "import './a.js';\nfunction g(p) {\n  const q = p;\n  if (q) {\n    return use(q);\n  }\n  return y;\n}\n",
    "lib/index.ts": "import '../b';\nexport const used = (v: number) => v;\nexport class Unused {}\n",
    "lone.js": "const z = require('@s/pack/deep');\n",
    "node_modules/m/i.js": "export function inner() {}\n",
    "skip/me/s.js": "export function s() {}\n",
    "package.json": '{"dependencies": {"left": "1", "@s/pack": "2", "idle": "3"}, "devDependencies": {"jest": "1"}}',
}


def test_commands_for_scripts(spark, capsys, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    root = tmp_path / "web"
    for name, content in SCRIPTS.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (root / config.FILE_NAME).write_text('{"excludePaths": ["skip/*/s.js"]}')
    say = lambda *a: (cli.main([str(x) for x in a]), capsys.readouterr().out)
    code, body = say("dead", root)
    assert code == 0 and set(body.strip().split("\n")) == {
        "unused export a.js f", "unused export lib/index.ts Unused", "orphan lone.js", "cycle a.js, b.js, lib/index.ts", "unused dependency package.json idle"
    }
    found = json.loads(say("functions", root, "--mode", "all", "--canonicalize")[1])
    assert found["complexity"]["totals"]["functions"] == 3 and found["duplicates"]["canonicalize"] is True
    assert found["duplicates"]["compared"] == 0 and [m["path"] for m in found["duplicates"]["exact_clusters"][0]] == ["a.js", "b.js"]
    assert "complexity" not in json.loads(say("functions", root, "--mode", "duplicates")[1])
    assert say("functions", root, "--mode", "complexity", "--save", tmp_path / "c.json")[0] == 0
    assert "functions" in say("functions", root, "--mode", "complexity", "--diff", tmp_path / "c.json")[1]
    (root / "coverage").mkdir()
    (root / "coverage" / "lcov.info").write_text(f"SF:a.js\nFNDA:1,f\nend_of_record\n")
    (root / ".dot").mkdir()
    (root / ".dot" / "d.js").write_text("function d() {\n  return 1;\n}\n")  # coverage looks into dot folders
    left = json.loads(say("gaps", root, "--json", "--emit-dir", tmp_path / "stubs")[1])
    assert {r["function"] for r in left} == {"g", "used", "d"}
    assert all("vitest" not in (tmp_path / "stubs" / n).read_text() for n in os.listdir(tmp_path / "stubs"))  # jest, by the manifest


def test_folders_are_skipped_before_reading(spark, tmp_path):
    """What lies in a skipped folder is not read; names with an underscore or a dot are."""
    for name in ("a.js", "node_modules/m/b.js", "c.txt", "pkg/__init__.js", ".hidden/d.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    for root in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
        files = fs.read_tree(spark, root, (".js",), ("node_modules",))
        assert sorted((r.path, r.ext, r.content) for r in files.collect()) == [(p, ".js", "x") for p in (".hidden/d.js", "a.js", "pkg/__init__.js")]
    (tmp_path / "empty").mkdir()
    assert fs.read_tree(spark, str(tmp_path / "empty")).count() == 0
