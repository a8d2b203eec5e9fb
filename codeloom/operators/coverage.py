"""Coverage: reports read into rows, functions that no executed line touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.pyast import NAME_PLACEHOLDERS

# Placeholder by parameter name in JavaScript, first match wins (case ignored).
JS_PLACEHOLDERS = [
    (r"email", '"user@example.com"'),
    (r"(^|_)(name|label|tag|title|message|text|content)$", '"placeholder"'),
    (r"password", '"placeholder-password"'),
    (
        r"(^|_)(age|count|num|number|qty|quantity|id|year|index|offset|size|length|limit|max|min|retries|attempts|tries|depth|width"
        r"|height|port|total|amount|price|score)$",
        "0",
    ),
    (r"^(is|has|should|can|did|use|allow|enable|include|verify|with)", "true"),
    (r"(^|_)(flag|ok|valid|enabled|checked|active)$", "true"),
    (r"(^|_)(url|uri|link|href)$", '"https://example.com"'),
    (r"(^|_)(path|file|filename)$", '"placeholder.txt"'),
    (r"(^|_)(list|items|arr|array|values|rows)$", "[]"),
    (r"(^|_)(data|payload|body|obj|options|config|record|item)$", "{}"),
]
# Endings of test files.
TEST_ENDINGS = (
    "_test.py", "_test.js", "_test.ts", "_test.jsx", "_test.tsx", ".test.js", ".test.ts", ".test.jsx", ".test.tsx", ".spec.js",
    ".spec.ts", ".spec.jsx", ".spec.tsx",
)
# Where an lcov report lies, in the order they are tried.
LCOV_PLACES = ("coverage/lcov.info", "lcov.info", "coverage/js/lcov.info", "coverage/lcov/lcov.info")


def is_test(path: Column) -> Column:
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    found = base.startswith("test_") | (base == "conftest.py") | base.contains(".characterization.")
    for end in TEST_ENDINGS:
        found = found | base.endswith(end)
    return found


def lcov_records(lines: DataFrame) -> DataFrame:
    """report(report, line_no, line) -> report, path, line, hits, function: DA and FNDA rows under their SF.

    The current file is carried forward inside a report, so reports are independent of each other.
    """
    order = Window.partitionBy("report").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    text = F.trim("line")
    source = F.when(text.startswith("SF:"), F.substr(text, F.lit(4)))
    placed = lines.select("report", "line_no", text.alias("t"), F.last(source, ignorenulls=True).over(order).alias("path"))
    at = F.regexp_extract("t", r"^DA:(\d+),(-?\d+)", 1)
    return placed.where("path IS NOT NULL").select(
        "report", "path",
        F.when(F.col("t").rlike(r"^DA:\d+,-?\d+"), at.cast("int")).alias("line"),
        F.when(F.col("t").startswith("FNDA:"), F.regexp_extract("t", r"^FNDA:\d+,(.*)$", 1)).alias("function"),
        F.when(F.col("t").rlike(r"^(DA:\d+|FNDA:\d+),"), F.coalesce(
            F.expr(r"try_cast(nullif(regexp_extract(t, '^DA:\\d+,(-?\\d+)', 1), '') as int)"),
            F.expr(r"try_cast(nullif(regexp_extract(t, '^FNDA:(\\d+),', 1), '') as int)"))).alias("hits"),
    ).where("line IS NOT NULL OR function IS NOT NULL")


def executed_lines(records: DataFrame) -> DataFrame:
    return records.where("line IS NOT NULL AND hits > 0").select("path", "line").distinct()


def coverage_json(reports: DataFrame) -> DataFrame:
    """report(content) -> path, line: executed lines of a coverage.json document."""
    schema = "struct<files: map<string, struct<executed_lines: array<int>>>>"
    files = reports.select(F.explode(F.from_json("content", schema)["files"]).alias("path", "x"))
    return files.select("path", F.explode("x.executed_lines").alias("line"))


def python_gaps(functions: DataFrame, executed: DataFrame) -> DataFrame:
    """Functions (path, function, body_start, end_line, ...) without an executed line between body start and end.

    Executed lines are gathered per file (a file has as many as it has lines) and tested in the row: no range join,
    whose output would grow with lines times functions.
    """
    by_file = executed.groupBy("path").agg(F.collect_set("line").alias("__lines"))
    joined = functions.join(by_file, "path", "left")
    hit = F.exists("__lines", lambda x: (x >= F.col("body_start")) & (x <= F.col("end_line")))
    return joined.where(~F.coalesce(hit, F.lit(False))).drop("__lines")


def js_gaps(functions: DataFrame, records: DataFrame) -> DataFrame:
    """The rule for JavaScript: a function's own count decides, by dotted name and then by its last part; without one, the lines after its first.

    Counts are joined by name: a file's counts in one map would be searched from end to end for each of its functions.
    Lines are gathered per file as in ``python_gaps``.
    """
    named = functions.where((F.col("line") > 0) & ~F.col("function").contains("(anonymous)"))
    lines = records.where("line IS NOT NULL AND hits > 0").groupBy("path").agg(F.collect_set("line").alias("__lines"))
    counts = records.where("function IS NOT NULL").groupBy("path", "function").agg(F.max("hits").alias("__hits"))
    joined = named.withColumn("__leaf", F.element_at(F.split("function", r"\."), -1)).join(counts, ["path", "function"], "left")
    last = counts.select("path", F.col("function").alias("__leaf"), F.col("__hits").alias("__leaf_hits"))
    joined = joined.join(last, ["path", "__leaf"], "left").join(lines, "path", "left")
    own = F.coalesce("__hits", "__leaf_hits")
    touched = F.exists("__lines", lambda x: (x >= F.col("line") + 1) & (x <= F.col("end_line")))
    covered = F.when(own.isNotNull(), own > 0).otherwise(F.coalesce(touched, F.lit(False)))
    return joined.where(~covered).select(*functions.columns)


def unique_hits(records: DataFrame) -> DataFrame:
    """One count per function of a report, the last one's maximum, so that it can be a map's key."""
    lines = records.where("line IS NOT NULL")
    names = records.where("function IS NOT NULL").groupBy("report", "path", "function").agg(F.max("hits").alias("hits"))
    return lines.unionByName(names.withColumn("line", F.lit(None).cast("int")).select(*lines.columns))


def placeholder(name: Column, rules=NAME_PLACEHOLDERS, other: str = "None") -> Column:
    found = F.lit(other)
    for pattern, value in reversed(rules):
        found = F.when(name.rlike("(?i)" + pattern), F.lit(value)).otherwise(found)
    return found


def js_arguments(params: Column) -> Column:
    """Placeholder arguments of a call, each with its parameter's name."""
    one = lambda p: (
        F.when(p.startswith("..."), F.lit("/* TODO: rest parameter, pass more if needed */"))
        .when(p.isin("(destructured)", "(complex)"), F.lit("null /* TODO: build the real shape */"))
        .otherwise(F.concat(placeholder(p, JS_PLACEHOLDERS, "null"), F.lit(" /* "), p, F.lit(" */")))
    )
    return F.array_join(F.transform(params, one), ", ")


def gap_totals(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("path").agg(F.count(F.lit(1)).alias("uncovered"))


# ---------------------------------------------------------------- stubs

HEADER = "generated characterization stub"


def stub_state(content: Column, header: str = HEADER) -> Column:
    """missing, pinned (written or completed by hand) or generated."""
    pinned = content.rlike(r"(?m)^\s*(assert\s|expected\s*=|expect\()")
    return F.when(content.isNull(), "missing").when(~content.contains(header) | pinned, "pinned").otherwise("generated")


def stub_action(state: Column, has_gaps: Column) -> Column:
    """What a run does with a stub: write, refresh, preserve, remove or keep."""
    return (
        F.when((state == "missing") & has_gaps, "write")
        .when(state == "missing", "none")
        .when(state == "pinned", "preserve")
        .when(has_gaps, "refresh")
        .otherwise("remove")
    )


def python_stub(gaps: DataFrame, header: str = HEADER) -> DataFrame:
    """path, source: a test module per file with gaps; methods are left to be completed by hand."""
    name = F.regexp_replace("function", r"(?U)\W", "_")
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    call = F.concat(F.element_at(F.split("function", r"\."), -1), F.lit("("), "arguments", F.lit(")"))
    todo = F.when(F.col("is_method"), F.lit("    # TODO: build an instance first\n")).otherwise(F.lit(""))
    test = F.concat(F.lit("def test_"), name, F.lit("():\n"), todo, F.lit("    result = "), call, F.lit('\n    print(repr(result))\n'))
    rows = gaps.select("path", "line", test.alias("test"), module.alias("module"), F.element_at(F.split("function", r"\."), 1).alias("top"))
    return rows.groupBy("path", "module").agg(
        F.array_join(F.array_sort(F.collect_set("top")), ", ").alias("names"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "test"))), lambda x: x["test"]), "\n\n").alias("tests"),
    ).select(
        "path",
        F.concat(F.lit(f'"""{header}"""\nfrom '), "module", F.lit(" import "), "names", F.lit("\n\n\n"), "tests").alias("source"),
    )


def js_stub(gaps: DataFrame, runner: str = "vitest", header: str = HEADER) -> DataFrame:
    """path, source: a test file per module with gaps, for vitest or jest."""
    first = "import { describe, it } from 'vitest';\n" if runner == "vitest" else ""
    leaf = F.element_at(F.split("function", r"\."), -1)
    test = F.concat(F.lit("  it('"), "function", F.lit("', () => {\n    const result = subject."), leaf, F.lit("("), js_arguments(F.col("params")), F.lit(");\n    console.log(result);\n  });"))
    rows = gaps.select("path", "line", test.alias("test"))
    return rows.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "test"))), lambda x: x["test"]), "\n").alias("tests")
    ).select(
        "path",
        F.concat(F.lit(f"// {header}\n{first}import * as subject from './"), F.element_at(F.split("path", "/"), -1), F.lit("';\n\ndescribe('"), "path", F.lit("', () => {\n"), "tests", F.lit("\n});\n")).alias("source"),
    )


def js_runner(package_json: Column, config_files: Column) -> Column:
    """vitest or jest: dependencies first, then configuration files, else vitest."""
    deps = F.concat_ws(
        " ", F.get_json_object(package_json, "$.dependencies"), F.get_json_object(package_json, "$.devDependencies")
    )
    return F.coalesce(
        F.when(deps.contains('"vitest"'), "vitest"), F.when(deps.contains('"jest"'), "jest"),
        F.when(F.exists(config_files, lambda f: f.startswith("vitest.config.")), "vitest"),
        F.when(F.exists(config_files, lambda f: f.startswith("jest.config.")), "jest"), F.lit("vitest"),
    )


def lcov_place(files: DataFrame) -> DataFrame:
    """path of the report to use: the fixed places first, then the shallowest file named lcov.info, three levels down at most."""
    depth = F.size(F.split("path", "/"))
    rank = F.coalesce(*[F.when(F.col("path") == p, i) for i, p in enumerate(LCOV_PLACES)], F.lit(len(LCOV_PLACES)) + depth)
    found = files.where(F.col("path").isin(*LCOV_PLACES) | (F.col("path").endswith("lcov.info") & (depth <= 4)))
    return found.orderBy(rank, "path").select("path").limit(1)
