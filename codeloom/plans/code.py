"""Queries over functions: complexity, shapes, coverage. Sources are generated from table rows, so SQL knows the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import coverage, functions
from codeloom.sources.tables import spread, table


def _python_files(spark, sf_dir):
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    body = F.concat(
        F.lit("def f_"), "p_partkey", F.lit("(a, b):\n"), F.repeat(F.lit("    if a > 1:\n        b += 1\n"), (F.col("p_size") % 7).cast("int")),
        F.lit("    return b\n"),
    )
    return part.select(F.concat(F.lit("part/"), "p_partkey", F.lit(".py")).alias("path"), F.lit(".py").alias("ext"), body.alias("content"))


def _js_files(spark, sf_dir):
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    body = F.concat(
        F.lit("function g_"), "p_partkey", F.lit("(a) {\n"), F.repeat(F.lit("  if (a && a.b) { a = a ? 1 : 2; }\n"), (F.col("p_size") % 5).cast("int")),
        F.lit("  return a;\n}\n"),
    )
    return part.select(F.concat(F.lit("part/"), "p_partkey", F.lit(".js")).alias("path"), F.lit(".js").alias("ext"), body.alias("content"))


def _fill(template: str, key: str):
    """The template with # as the key, so that every row has names of its own."""
    return F.replace(F.lit(template), F.lit("#"), F.col(key).cast("string"))


def _shape_files(spark, sf_dir, canonical: bool):
    rows = spread(table(spark, sf_dir, "supplier").select("s_suppkey"))
    if canonical:
        one, two = "  if (a#.x > 1) { a#.log(); }\n", "  if (b#.y < 2) { b#.out(); }\n"
        middle = F.when(F.col("s_suppkey") % 2 == 0, _fill(one + two, "s_suppkey")).otherwise(_fill(two + one, "s_suppkey"))
        tail = F.repeat(_fill("  b#.m(a#);\n", "s_suppkey"), (F.col("s_suppkey") % 5).cast("int"))
        body = F.concat(_fill("function c#(a#, b#) {\n", "s_suppkey"), middle, F.lit("  return 1;\n}\n\n"))
        body = F.concat(_fill("function c#(a#, b#) {\n", "s_suppkey"), middle, F.lit("  go();\n"), tail, F.lit("  return 1;\n}\n"))
    else:
        steps = F.repeat(_fill("  if (y#) { y# = y# + 1; }\n", "s_suppkey"), (F.col("s_suppkey") % 10 + 3).cast("int"))
        body = F.concat(_fill("function s#(x#) {\n  let y# = x#;\n", "s_suppkey"), steps, _fill("  return y#;\n}\n", "s_suppkey"))
    return rows.select(F.concat(F.lit("s/"), "s_suppkey", F.lit(".js")).alias("path"), F.lit(".js").alias("ext"), body.alias("content"))


def py_complexity(spark, sf_dir):
    return functions.python_functions(_python_files(spark, sf_dir)).where("error IS NULL").select("path", "function", "line", "end_line", "complexity")


def js_complexity(spark, sf_dir):
    return functions.js_functions(_js_files(spark, sf_dir)).where("error IS NULL").select("path", "function", "line", "end_line", "complexity")


def _both(spark, sf_dir):
    return functions.complexity(_python_files(spark, sf_dir).unionByName(_js_files(spark, sf_dir)))


def complexity_totals(spark, sf_dir):
    return functions.complexity_totals(_both(spark, sf_dir))


def complexity_over_threshold(spark, sf_dir):
    return functions.over_threshold(_both(spark, sf_dir), 6)


def complexity_top15(spark, sf_dir):
    return functions.most_complex(_both(spark, sf_dir)).select("path", "complexity")


def structural_clusters(spark, sf_dir):
    return functions.structural_clusters(_shape_files(spark, sf_dir, False)).drop("fingerprint")


def canonical_clusters(spark, sf_dir):
    return functions.structural_clusters(_shape_files(spark, sf_dir, True), canonical=True).drop("fingerprint")


def structural_near_pairs(spark, sf_dir):
    return functions.structural_near_pairs(_shape_files(spark, sf_dir, False))


# ---------------------------------------------------------------- coverage


def _spans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") % 9 + 1).cast("int")
    return orders.select(
        F.concat(F.lit("f"), F.col("o_orderkey") % 100, F.lit(".py")).alias("path"), F.concat(F.lit("m.fn"), "o_orderkey").alias("function"),
        start.alias("body_start"), start.alias("line"), (start + F.col("o_custkey") % 3).cast("int").alias("end_line"),
    )


def _hits(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.concat(F.lit("f"), F.col("l_orderkey") % 100, F.lit(".py")).alias("path"), (F.col("l_linenumber") * 2).cast("int").alias("line"),
        (F.col("l_quantity").cast("int") % 2).alias("hits"), F.lit(None).cast("string").alias("function"), F.lit("r").alias("report"),
    )


def coverage_gaps_py(spark, sf_dir):
    executed = coverage.executed_lines(_hits(spark, sf_dir))
    return coverage.python_gaps(_spans(spark, sf_dir), executed).select("path", "function")


def coverage_gaps_js(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 4 == 0)
    own = orders.select(
        F.concat(F.lit("f"), F.col("o_orderkey") % 100, F.lit(".py")).alias("path"), F.lit(None).cast("int").alias("line"),
        (F.col("o_custkey") % 3).cast("int").alias("hits"), F.concat(F.lit("fn"), "o_orderkey").alias("function"), F.lit("r").alias("report"),
    )
    records = coverage.unique_hits(_hits(spark, sf_dir).unionByName(own))
    return coverage.js_gaps(_spans(spark, sf_dir), records).select("path", "function")


def lcov_parse(spark, sf_dir):
    """A report per customer group: SF, DA rows, FNDA, end_of_record; written as text lines, read back as rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("report"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    at = lambda i: (F.col("o_orderkey") * 100 + i).alias("line_no")
    head = orders.select("report", at(0), F.concat(F.lit("SF:src/"), "o_orderkey", F.lit(".js")).alias("line"))
    foot = orders.select("report", at(98), F.concat(F.lit("FNDA:"), F.col("o_orderkey") % 3, F.lit(",fn"), "o_orderkey").alias("line"))
    end = orders.select("report", at(99), F.lit("end_of_record").alias("line"))
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "report", at(F.col("l_linenumber")), F.concat(F.lit("DA:"), "l_linenumber", F.lit(","), "q").alias("line")
    )
    return coverage.lcov_records(head.unionByName(rows).unionByName(foot).unionByName(end))


def placeholder_args(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name"))
    events = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("_count")).alias("name"))
    names = spark.createDataFrame([(n,) for n in ("user_email", "is_open", "file_path", "payload", "url", "title", "due_date", "x", "Password", "items")], "name string")
    found = part.unionByName(events).unionByName(names).distinct()
    return found.select(
        "name", coverage.placeholder(F.col("name")).alias("python"), coverage.placeholder(F.col("name"), coverage.JS_PLACEHOLDERS, "null").alias("js")
    )


def _case(rules, other: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN regexp_matches(name, {quote(p)}, 'i') THEN {quote(v)}" for p, v in rules) + f" ELSE '{other}' END"


PY_SQL = "py AS (SELECT 'part/' || p_partkey || '.py' AS path, 'f_' || p_partkey AS function, 1 AS line, CAST(2 + 2 * (p_size % 7) AS INT) AS end_line, CAST(1 + p_size % 7 AS INT) AS complexity FROM part)"
JS_SQL = "js AS (SELECT 'part/' || p_partkey || '.js' AS path, 'g_' || p_partkey AS function, 1 AS line, CAST(3 + p_size % 5 AS INT) AS end_line, CAST(1 + 3 * (p_size % 5) AS INT) AS complexity FROM part)"
BOTH_SQL = f"WITH {PY_SQL}, {JS_SQL}, b AS (SELECT path, function, line, complexity FROM py UNION ALL SELECT path, function, line, complexity FROM js) "
SPANS_SQL = """spans AS (
  SELECT 'f' || (o_orderkey % 100) || '.py' AS path, 'm.fn' || o_orderkey AS function, 'fn' || o_orderkey AS leaf, o_orderkey % 9 + 1 AS s,
         o_orderkey % 9 + 1 + o_custkey % 3 AS e, o_orderkey, o_custkey FROM orders),
hits AS (SELECT DISTINCT 'f' || (l_orderkey % 100) || '.py' AS path, l_linenumber * 2 AS line FROM lineitem WHERE CAST(l_quantity AS INT) % 2 > 0)"""


def _clusters_sql(modulus: int, prefix: str) -> str:
    return f"""SELECT count(*) AS n, min('s/' || s_suppkey || '.js') AS path, 1 AS line,
  min_by('{prefix}' || s_suppkey, 's/' || s_suppkey || '.js') AS function FROM supplier GROUP BY s_suppkey % {modulus} HAVING count(*) > 1"""


QUERIES = {
    "py_complexity": (py_complexity, f"WITH {PY_SQL} SELECT * FROM py"),
    "js_complexity": (js_complexity, f"WITH {JS_SQL} SELECT * FROM js"),
    "complexity_totals": (
        complexity_totals,
        BOTH_SQL + "SELECT count(*) AS functions, CAST(sum(complexity) AS BIGINT) AS total_complexity, round(avg(complexity), 2) AS avg_complexity, max(complexity) AS max_complexity FROM b",
    ),
    "complexity_over_threshold": (complexity_over_threshold, BOTH_SQL + "SELECT * FROM b WHERE complexity > 6"),
    "complexity_top15": (complexity_top15, BOTH_SQL + "SELECT path, complexity FROM b ORDER BY complexity DESC, path, line LIMIT 15"),
    "structural_clusters": (structural_clusters, _clusters_sql(10, "s")),
    "canonical_clusters": (canonical_clusters, _clusters_sql(5, "c")),
    "structural_near_pairs": (structural_near_pairs, None),
    "coverage_gaps_py": (
        coverage_gaps_py,
        f"WITH {SPANS_SQL} SELECT path, function FROM spans WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.path = spans.path AND line BETWEEN s AND e)",
    ),
    "coverage_gaps_js": (
        coverage_gaps_js,
        f"WITH {SPANS_SQL} SELECT path, function FROM spans WHERE CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 3 = 0 "
        "ELSE NOT EXISTS (SELECT 1 FROM hits WHERE hits.path = spans.path AND line BETWEEN s + 1 AND e) END",
    ),
    "lcov_parse": (
        lcov_parse,
        """SELECT o_custkey % 50 AS report, 'src/' || o_orderkey || '.js' AS path, l_linenumber AS line, NULL AS function, CAST(l_quantity AS INT) AS hits
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           UNION ALL SELECT o_custkey % 50, 'src/' || o_orderkey || '.js', NULL, 'fn' || o_orderkey, CAST(o_orderkey % 3 AS INT) FROM orders""",
    ),
    "placeholder_args": (
        placeholder_args,
        "WITH names AS (SELECT lower(replace(p_type, ' ', '_')) AS name FROM part UNION SELECT event_type || '_count' FROM events UNION "
        "SELECT unnest(['user_email', 'is_open', 'file_path', 'payload', 'url', 'title', 'due_date', 'x', 'Password', 'items'])) SELECT name, "
        + _case(coverage.NAME_PLACEHOLDERS, "None") + " AS python, " + _case(coverage.JS_PLACEHOLDERS, "null") + " AS js FROM names",
    ),
}
