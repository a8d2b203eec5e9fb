"""Command line: each command measures a tree (or reads a plan) and prints text or JSON.

python -m codeloom.cli loc|duplicates|complexity|functions|gaps|delta|partition|report|checkpoint|dead|package ...

Exit codes: 2 for a plan that cannot be read, 1 for a regression under --fail-on-regression, for a report without
inputs and for a package that does not verify, else 0.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import config
from codeloom.functions import languages, text
from codeloom.operators import coverage, delta, duplicates, excludes, functions, graph, lines, modules, plans, report
from codeloom.sources import files as fs
from codeloom.sources.checkpoints import written


def session() -> SparkSession:
    spark = SparkSession.builder.appName("codeloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tree(spark: SparkSession, path: str, exts: tuple, settings: dict, apply_excludes: bool = True, **how) -> DataFrame:
    """The files of a target that a scan takes; a single file stands for itself. how: what ``excludes.scan`` takes."""
    single = os.path.isfile(path)
    if single:
        root = os.path.dirname(os.path.abspath(path))
        found = fs.read_tree(spark, root, (os.path.basename(path),)).where(F.col("path") == os.path.basename(path))
    else:
        # only names that every scan skips go before the files are read; dot folders are the scan's choice
        found = fs.read_tree(spark, path, tuple(e if e.startswith(".") else "." + e for e in exts), ("node_modules", ".git"))
    return excludes.scan(found, exts, settings["excludePaths"], single_file=single, apply_excludes=apply_excludes, **how)


def scripts(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """JavaScript and TypeScript files; their excludes have a dialect of their own."""
    return tree(spark, path, languages.JS_EXTS, settings, dialect="segment")


def rows(df: DataFrame) -> list[dict]:
    """A sink's rows on the driver: what a terminal or a JSON file shows."""
    return [r.asDict(recursive=True) for r in df.collect()]


def out(value, as_json: bool, lines_of) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False) if as_json else "\n".join(lines_of(value)))


def saved(path: str | None, value: dict) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, ensure_ascii=False)


def loaded(path: str) -> dict:
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)


def _diff(before: dict, after: dict) -> list[str]:
    found = []
    for name, now in after.items():
        was = before.get(name)
        if was is not None and now is not None:
            share = (now - was) / was * 100 if was else 0.0
            found.append(f"{name:20} {was:>12,} -> {now:>12,}  {now - was:+,} ({share:+.1f}%)")
    return found


def loc(spark, a, settings) -> int:
    exts = tuple(a.ext) if a.ext else languages.LOC_EXTS
    counts = lines.inventory(tree(spark, a.path, exts, settings))
    total = rows(lines.totals(counts))[0] if not counts.isEmpty() else dict.fromkeys((*lines.COUNTS, "files"), 0)
    if a.save:
        found = rows(lines.snapshot(counts))[0]
        saved(a.save, {"per_file": found["per_file"], "totals": total})
    text_ = [f"{k:10} {v:>10,}" for k, v in total.items()] + [f"  {r['code']:>8,}  {r['path']}" for r in rows(lines.largest(counts))]
    print("\n".join(_diff(loaded(a.diff)["totals"], total) if a.diff else text_))
    return 0


def duplicates_(spark, a, settings) -> int:
    k = config.resolve(a.min_lines, settings["duplication"]["minLines"], 5)
    least = config.resolve(a.similarity, settings["duplication"]["similarity"], 0.85)
    exts = tuple(a.ext) if a.ext else languages.DUPLICATE_EXTS
    scanned = tree(spark, a.path, exts, settings, apply_excludes=False)
    blocks = duplicates.windows(scanned, k, a.normalize_literals, strip_c=True)
    exact = duplicates.cluster_members(blocks)
    shapes = written(functions.structural_blocks(scripts(spark, a.path, settings), a.canonicalize, k), "shapes")
    own = shapes.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    ast_members = shapes.join(own, "fingerprint").select(F.concat(F.lit("ast:"), "fingerprint").alias("cluster"), "path", "line")
    members = exact.select(F.col("h").alias("cluster"), "path", "line").unionByName(ast_members)
    merged = graph.merge_clusters(members).withColumnRenamed("cluster", "h")
    near = duplicates.near_pairs_difflib(blocks, a.max_compare, least)
    n = duplicates.first_seen(blocks).count()
    found = rows(duplicates.report(merged, near, min(a.max_compare + 1, n * (n - 1) // 2)))[0]
    if a.canonicalize:
        found["canonicalize"] = True
    out(found, a.json, lambda v: [
        f"{len(v['exact_clusters'])} exact clusters, {len(v['near_pairs'])} near pairs",
        *[f"  x{len(c)}: " + ", ".join(f"{m['path']}:{m['line']}" for m in c) for c in v["exact_clusters"][: a.top]],
        *[f"  {p['ratio']:.2f}: {p['a']['path']}:{p['a']['line']} ~ {p['b']['path']}:{p['b']['line']}" for p in v["near_pairs"][: a.top]],
    ])
    return 0


def complexity(spark, a, settings) -> int:
    scanned = tree(spark, a.path, (".py",), settings).unionByName(scripts(spark, a.path, settings))
    measured = functions.complexity(scanned)
    total = rows(functions.complexity_totals(measured))[0]
    if a.save:
        per = rows(measured.select(F.col("path").alias("file"), "function", "line", "complexity").orderBy("path", "line"))
        saved(a.save, {"per_function": per, "totals": total})
    if a.diff:
        print("\n".join(_diff(loaded(a.diff)["totals"], total)))
        return 0
    limit = config.resolve(a.threshold, settings["complexity"]["warnThreshold"], 10)
    over = functions.over_threshold(measured, limit).count()
    text_ = [f"{k:18} {v}" for k, v in total.items()] + [f"over {limit}: {over}"]
    text_ += [f"  {r['complexity']:>4}  {r['path']}:{r['line']} {r['function']}" for r in rows(functions.most_complex(measured, a.top))]
    hints = rows(languages.language_hints(tree(spark, a.path, languages.C_FAMILY, settings)))
    print("\n".join(text_ + [f"  {h['language']}: {h['hint']}" for h in sorted(hints, key=lambda h: h["language"])]))
    return 0


def functions_(spark, a, settings) -> int:
    """The analyzer's payloads: functions, duplicates, complexity or the last two."""
    files = scripts(spark, a.path, settings)
    found = functions.js_functions(files).where("error IS NULL").drop("error")
    if a.mode == "functions":
        out({"functions": rows(found.orderBy("path", "line"))}, True, list)
        return 0
    payload = {}
    if a.mode != "complexity":
        k = config.resolve(a.min_lines, settings["duplication"]["minLines"], 5)
        least = config.resolve(a.similarity, settings["duplication"]["similarity"], 0.85)
        blocks = written(functions.structural_blocks(files, a.canonicalize, k), "shapes")
        own = blocks.groupBy(F.col("fingerprint").alias("h")).agg(F.count(F.lit(1)).alias("n"))
        members = blocks.select(F.col("fingerprint").alias("h"), "path", "line").join(own.where("n > 1").select("h"), "h")
        near = functions.near_pairs_of(blocks, a.max_compare, least)
        n = own.count()
        payload["duplicates"] = rows(duplicates.report(members, near, min(a.max_compare, n * (n - 1) // 2)))[0]
        if a.canonicalize:
            payload["duplicates"]["canonicalize"] = True
    if a.mode != "duplicates":
        total = rows(functions.complexity_totals(found))[0]
        snapshot = {"per_function": rows(found.select(F.col("path").alias("file"), "function", "line", "complexity").orderBy("file", "line")), "totals": total}
        if a.save:
            saved(a.save, snapshot)
            print(f"saved {total['functions']} functions to {a.save}")
            return 0
        if a.diff:
            print("\n".join(_diff(loaded(a.diff)["totals"], total)))
            return 0
        payload["complexity"] = snapshot
    out(payload, True, list)
    return 0


def gaps(spark, a, settings) -> int:
    how = {"skip": languages.COVERAGE_SKIP_DIRS, "dotted": False}
    scanned = tree(spark, a.path, (".py", *languages.JS_EXTS), settings, **how).where(~coverage.is_test(F.col("path")))
    folder = a.path if os.path.isdir(a.path) else os.path.dirname(os.path.abspath(a.path))
    notes = []
    executed = spark.createDataFrame([], "path string, line int")
    report_path = a.coverage_json or (os.path.join(folder, "coverage.json") if os.path.isfile(os.path.join(folder, "coverage.json")) else None)
    if report_path:
        executed = coverage.coverage_json(spark.read.text(report_path, wholetext=True).withColumnRenamed("value", "content"))
    else:
        notes.append("no coverage.json: every Python function counts as uncovered")
    py = coverage.python_gaps(functions.python_functions(scanned).where("error IS NULL"), executed)
    records = spark.createDataFrame([], "report string, path string, line int, function string, hits int")
    lcov = a.lcov or _found_lcov(spark, folder)
    if lcov:
        raw = spark.read.text(lcov, wholetext=True).select(F.lit(lcov).alias("report"), F.posexplode(text.split_lines(F.col("value"))).alias("line_no", "line"))
        records = coverage.unique_hits(coverage.lcov_records(raw))
    js = coverage.js_gaps(functions.js_functions(scanned).where("error IS NULL"), records)
    found = rows(py.select("path", "function", "line").unionByName(js.select("path", "function", "line")).orderBy("path", "line"))
    if a.emit_dir:
        stubs = rows(coverage.python_stub(py)) + rows(coverage.js_stub(js, a.runner or _found_runner(spark, folder)))
        _write_stubs(spark, a.emit_dir, stubs)
    total = rows(coverage.gap_totals(py.select("path").unionByName(js.select("path"))).orderBy("path"))
    out(found, a.json, lambda v: [
        f"{len(v)} uncovered functions in {len(total)} files", *[f"  {r['path']}:{r['line']} {r['function']}" for r in v],
        *[f"  {t['uncovered']:>4} {t['path']}" for t in total], *[f"note: {n}" for n in notes],
    ])
    return 0


def _found_lcov(spark, folder: str) -> str | None:
    """The report to use: fixed places first, then the shallowest one."""
    listed = fs.read_tree(spark, folder, ("lcov.info",), ("node_modules", ".git"))
    place = coverage.lcov_place(listed.select("path")).first()
    return os.path.join(folder, place[0]) if place else None


def _found_runner(spark, folder: str) -> str:
    manifest = os.path.join(folder, "package.json")
    content = open(manifest, encoding="utf-8-sig").read() if os.path.isfile(manifest) else None
    here = spark.createDataFrame([(content, os.listdir(folder))], "package string, names array<string>")
    return here.select(coverage.js_runner(F.col("package"), F.col("names"))).first()[0]


def _write_stubs(spark, folder: str, stubs: list[dict]) -> None:
    os.makedirs(folder, exist_ok=True)
    wanted = {s["path"].replace("/", "_") + (".characterization.py" if s["path"].endswith(".py") else ".characterization.test.js"): s["source"] for s in stubs}
    present = {n: open(f"{folder}/{n}", encoding="utf-8", errors="ignore").read() for n in os.listdir(folder) if ".characterization." in n}
    state = spark.createDataFrame([(n, present.get(n), n in wanted) for n in {*wanted, *present}] or [("", None, False)], "name string, content string, has_gaps boolean")
    for r in rows(state.select("name", coverage.stub_action(coverage.stub_state(F.col("content")), F.col("has_gaps")).alias("action"))):
        if r["action"] in ("write", "refresh"):
            with open(f"{folder}/{r['name']}", "w", encoding="utf-8") as f:
                f.write(wanted[r["name"]])
        elif r["action"] == "remove":
            os.remove(f"{folder}/{r['name']}")


def delta_(spark, a, settings) -> int:
    exts = languages.LOC_EXTS
    both = fs.two_versions(tree(spark, a.base, exts, settings), tree(spark, a.head, exts, settings)) if a.base else tree(spark, a.head, exts, settings).withColumn("version", F.lit("head"))
    keyed = both.withColumn("path", F.concat("version", F.lit("\x1f"), "path"))
    with open(a.changed, encoding="utf-8") as f:
        changed = spark.createDataFrame([(x.strip(),) for x in f if x.strip()] or [("",)], "path string")
    split = lambda df: df.withColumn("version", F.get(F.split("path", "\x1f"), F.lit(0))).withColumn("path", F.get(F.split("path", "\x1f"), F.lit(1)))
    code = delta.in_scope(split(lines.inventory(keyed)), changed)
    cx = delta.in_scope(split(functions.complexity(keyed)), changed)
    members = split(duplicates.cluster_members_by(keyed, "\x1f"))
    clusters = delta.clusters_in_scope(members, changed)
    side = {r["version"]: r for r in rows(delta.side_totals(code, cx, clusters))}
    metric = [(m, *[(side.get(v) or {}).get(m) for v in ("base", "head")]) for m in ("code", "avg_complexity", "clusters")]
    metrics = spark.createDataFrame([(m, None if b is None else float(b), None if h is None else float(h)) for m, b, h in metric], "metric string, base double, head double")
    places = delta.locations(clusters.where("version = 'head'"))
    verdict = delta.regression(metrics).first()[0]
    print(delta.payload(metrics, places).first()[0] if a.json else delta.markdown_comment(metrics, places, a.top).first()[0])
    strict = a.fail_on_regression or settings["ci"]["failOnRegression"]
    return 1 if strict and verdict else 0


def partition(spark, a, settings) -> int:
    try:
        raw = spark.createDataFrame([(a.plan, open(a.plan, encoding="utf-8-sig").read())], "plan string, content string")
    except OSError as e:
        print(e, file=sys.stderr)
        return 2
    changes = plans.changes_of(plans.read_plan(raw))
    errors = rows(plans.plan_errors(changes).orderBy("plan_order"))
    if errors or changes.isEmpty():
        print("\n".join(e["error"] for e in errors) or "no changes to partition", file=sys.stderr)
        return 2
    edges = plans.conflicts(plans.candidates(changes))
    colored = plans.groups(changes, edges)
    met = plans.scanned_conflicts(edges, colored)
    own = {r["plan_order"]: r for r in rows(changes.select("plan_order", "id", "category", "tier", "files", "est", "description"))}
    ids = {k: r["id"] for k, r in own.items()}
    blocked = {r["plan_order"]: [{"id": ids[b["a"]], "reason": b["reason"]} for b in r["blockers"]] for r in rows(plans.blocked_by(edges, colored))}
    shown = lambda m: {"id": ids[m], "category": own[m]["category"], "tier": own[m]["tier"], "files": own[m]["files"], "estLinesSaved": own[m]["est"], "description": own[m]["description"], "blockedBy": blocked.get(m, [])}
    found = {
        "groups": [
            {"index": r["color"], "changeIds": [ids[m] for m in r["members"]], "files": r["files"], "changes": [shown(m) for m in r["members"]]}
            for r in rows(plans.group_files(changes, colored).orderBy("color"))
        ],
        "deferred": rows(plans.deferred(changes).select("id", "tier", "reason")),
        "conflicts": [{"a": ids[r["a"]], "b": ids[r["b"]], "reason": r["reason"]} for r in rows(met.select("a", "b", plans.reason(F.col("rule"), F.col("shared")).alias("reason")).orderBy("b", "a"))],
        "blindSpots": [r["id"] for r in rows(plans.blind_spots(changes).select("id"))],
        **rows(plans.partition_totals(changes, colored))[0], "finalSerialVerification": "required",
    }
    out(found, a.json, lambda v: [*[f"group {g['index']}: {', '.join(g['changeIds'])}" for g in v["groups"]], *[f"deferred {d['id']}: {d['reason']}" for d in v["deferred"]], *[f"{c['a']} x {c['b']}: {c['reason']}" for c in v["conflicts"]]])
    return 0


def report_(spark, a, settings) -> int:
    if not any((a.loc_before, a.loc_after, a.complexity_before, a.complexity_after, a.batches, a.duplicates)):
        print("a report needs at least one input", file=sys.stderr)
        return 1
    pick = lambda p, *keys: {k: loaded(p)["totals"].get(k) for k in keys} if p else {}
    before = pick(a.loc_before, "code", "files") | pick(a.complexity_before, "avg_complexity", "max_complexity", "total_complexity", "functions")
    after = pick(a.loc_after, "code", "files") | pick(a.complexity_after, "avg_complexity", "max_complexity", "total_complexity", "functions")
    metrics = [{"metric": k, "base": before.get(k), "head": after.get(k)} for k in {**before, **after}]
    wrap = lambda p: spark.createDataFrame([(open(p, encoding="utf-8-sig").read(),)], "content string")
    batch = rows(report.batches(wrap(a.batches))) if a.batches else []
    left = rows(report.not_touched(wrap(a.plan))) if a.plan and a.plan.endswith(".json") else []
    if a.plan and not left:
        body = wrap(a.plan).select(F.lit(a.plan).alias("doc"), F.posexplode(text.split_lines(F.col("content"))).alias("line_no", "line"))
        left = rows(report.section_bullets(body, "Items NOT being touched"))
    places = [m for c in loaded(a.duplicates)["exact_clusters"] for m in c] if a.duplicates else []
    with open(a.output, "w", encoding="utf-8") as f:
        f.write(report.page(metrics, batch, left, places, a.title))
    return 0


def checkpoint(spark, a, settings) -> int:
    if a.action == "start":  # an empty log under a name of its own; one that is there is never overwritten
        if os.path.exists(a.log):
            print(f"{a.log} is there already: a run starts from a clean state", file=sys.stderr)
            return 1
        fs.start_checkpoints(spark, a.log)
        print(f"checkpoints go to {a.log}")
    elif a.action == "save":
        if not a.subject:
            print("a checkpoint needs a subject: <category>: <what> [verified: <how>]", file=sys.stderr)
            return 1
        fs.append_checkpoint(spark, a.log, a.sha, f"{a.prefix}: {a.subject}" if not a.subject.startswith(a.prefix + ":") else a.subject)
    elif a.action == "revert":
        fs.revert_checkpoint(spark, a.log, a.sha)
    else:
        print("\n".join(f"{r['sha']} {r['subject']}" for r in rows(plans.checkpoints(spark.read.parquet(a.log), a.prefix))))
    return 0


def dead(spark, a, settings) -> int:
    """Candidates for removal, never verdicts: Python functions, exports, dependencies and modules that nothing names, and import cycles."""
    scanned = tree(spark, a.path, (".py",), settings)
    words = scanned.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?U)\w+"), F.lit(0))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    defined = functions.python_functions(scanned).where("error IS NULL").withColumn("name", F.element_at(F.split("function", r"\."), -1)).where(~F.col("name").startswith("__"))
    for r in rows(graph.unreferenced(defined, words.where("n > 1"), "name").select("path", "line", "function").orderBy("path", "line")):
        print(f"candidate {r['path']}:{r['line']} {r['function']}")
    files = scripts(spark, a.path, settings)
    edges = modules.import_edges(files)
    for r in rows(graph.unreferenced(modules.exports(files), modules.imported_names(files), "key").orderBy("path", "key")):
        print(f"unused export {r['path']} {r['key']}")
    for r in rows(graph.orphans(files.select(F.col("path").alias("node")), edges).orderBy("node")):
        print(f"orphan {r['node']}")
    cycle = graph.cycles(edges).groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("members"))
    for r in rows(cycle.orderBy("cycle")):
        print(f"cycle {r['members']}")
    manifests = tree(spark, a.path, (".json",), settings).where(F.element_at(F.split("path", "/"), -1) == "package.json")
    for r in rows(graph.unreferenced(modules.dependencies(manifests), modules.packages(files), "key").orderBy("path", "key")):
        print(f"unused dependency {r['path']} {r['key']}")
    return 0


def package(spark, a, settings) -> int:
    listed = fs.read_tree(spark, a.repo).where(~excludes.skipped(F.col("path")) & ~excludes.excluded(F.col("path"), settings["excludePaths"])).orderBy("path")
    own = [r["path"] for r in rows(listed.select("path"))]
    if a.list:
        print("\n".join(own))
        return 0
    content = [(p, open(os.path.join(a.repo, p), "rb").read()) for p in own]
    manual = next((c.decode("utf-8", "replace") for p, c in content if p == a.manual), None)
    if manual is None:
        print(f"{a.manual} not found in {a.repo}", file=sys.stderr)
        return 1
    lines_ = spark.createDataFrame([("m", i, x) for i, x in enumerate(manual.split("\n"))], "doc string, line_no int, line string")
    head = (rows(report.frontmatter(lines_)) if manual.startswith("---") else []) or [None]
    fault = report.contract_fault(head[0])
    if fault:
        print(f"{a.manual}: {fault}", file=sys.stderr)
        return 1
    name = head[0]["name"]
    data = fs.archive(content, name)
    if fs.verify_archive(data, content, name):
        return 1
    with open(a.output, "wb") as f:
        f.write(data)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options) -> None:
        c = sub.add_parser(name)
        for flags, kw in options:
            c.add_argument(*flags.split(), **kw)
        c.set_defaults(run=run)

    path, flag = ("path", {}), {"action": "store_true"}
    number = {"type": int}
    command("loc", loc, path, ("--ext", {"nargs": "*"}), ("--save", {}), ("--diff", {}))
    command(
        "duplicates", duplicates_, path, ("--min-lines", number), ("--similarity", {"type": float}), ("--normalize-literals", flag), ("--ext", {"nargs": "*"}),
        ("--max-compare", {"type": int, "default": 4000}), ("--top", {"type": int, "default": 25}), ("--canonicalize", flag), ("--json", flag),
    )
    command("complexity", complexity, path, ("--save", {}), ("--diff", {}), ("--top", {"type": int, "default": 15}), ("--threshold", number))
    command(
        "functions", functions_, path, ("--mode", {"choices": ["functions", "duplicates", "complexity", "all"], "default": "functions"}), ("--min-lines", number),
        ("--similarity", {"type": float}), ("--max-compare", {"type": int, "default": 4000}), ("--canonicalize", flag), ("--save", {}), ("--diff", {}),
    )
    command("gaps", gaps, path, ("--coverage-json", {}), ("--lcov", {}), ("--runner", {"choices": ["vitest", "jest"]}), ("--emit-dir", {}), ("--json", flag))
    command("delta", delta_, ("--base", {}), ("--head", {"required": True}), ("--changed", {"required": True}), ("--json", flag), ("--fail-on-regression", flag), ("--top", {"type": int, "default": 10}))
    command("partition", partition, ("plan", {}), ("--json", flag))
    command("report", report_, *[(f"--{n}", {}) for n in ("loc-before", "loc-after", "complexity-before", "complexity-after", "duplicates", "batches", "plan")], ("--output", {"required": True}), ("--title", {"default": "Code measurement"}))
    command("checkpoint", checkpoint, ("action", {"choices": ["start", "save", "list", "revert"]}), ("--log", {"required": True}), ("--sha", {"default": ""}), ("--subject", {"default": ""}), ("--prefix", {"default": "checkpoint"}))
    command("dead", dead, path)
    command("package", package, ("repo", {}), ("--manual", {"default": "SKILL.md"}), ("--output", {"default": "package.zip"}), ("--list", flag))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    target = next((getattr(a, n) for n in ("path", "head", "repo", "plan") if getattr(a, n, None)), ".")
    settings, warning = config.load(target)
    if warning:
        print(f"warning: {warning}", file=sys.stderr)
    return a.run(session(), a, settings)


if __name__ == "__main__":
    sys.exit(main())
