"""Queries over changes: scope, verdicts, plans, rules, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import delta, duplicates, excludes, graph, lines, plans, report
from codeloom.plans.lines import FILES, LOC, NEAR_SQL, near_pairs_dice_all, windows_sql
from codeloom.sources import tables
from codeloom.sources.tables import table

# ---------------------------------------------------------------- paths


def _paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".py"))).alias("path"))


PATTERNS = ["src1/**", "de", "*7.py", "./src2/fr/*", "src[34]/es/1*.py"]
SEGMENT_PATTERNS = ["src*/en/*", "es", "**/*9.py", "./src5/de/**"]


def exclude_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(~excludes.excluded(F.col("path"), PATTERNS))


def segment_exclude(spark, sf_dir):
    return _paths(spark, sf_dir).where(~excludes.excluded(F.col("path"), SEGMENT_PATTERNS, "segment"))


# ---------------------------------------------------------------- scope


def _changed(spark, sf_dir):
    files, labels = tables.document_files(spark, sf_dir), table(spark, sf_dir, "labels")
    return files.join(labels, "doc_id", "left_semi").select(F.upper("path").alias("path"))


def changed_scope_loc(spark, sf_dir):
    counts = lines.inventory(tables.document_files(spark, sf_dir))
    return lines.totals(delta.in_scope(counts, _changed(spark, sf_dir)), "ext")


def changed_scope_clusters(spark, sf_dir):
    members = duplicates.cluster_members(duplicates.windows(tables.document_files(spark, sf_dir), 5))
    return delta.locations(delta.clusters_in_scope(members, _changed(spark, sf_dir)))


def changed_scope_pairs(spark, sf_dir):
    pairs = duplicates.near_pairs_dice(duplicates.windows(tables.document_files(spark, sf_dir), 5))
    return delta.pairs_in_scope(pairs, _changed(spark, sf_dir))


def changed_scope_pairs_all(spark, sf_dir):
    """Every near pair with a changed file; ``changed_scope_pairs`` filters after a pair budget."""
    return delta.pairs_in_scope(near_pairs_dice_all(spark, sf_dir), _changed(spark, sf_dir))


def regression_verdict(spark, sf_dir):
    """Even ids as base, odd ids as head: code lines and clusters; a third metric has no base."""
    files = tables.document_files(spark, sf_dir).withColumn("version", F.when(F.col("doc_id") % 2 == 0, "base").otherwise("head"))
    code = lines.inventory(files.withColumn("path", F.concat("version", F.lit("/"), "path"))).select(F.substring("path", 1, 4).alias("version"), "code")
    loc = code.groupBy().agg(*[F.sum(F.when(F.col("version") == v, F.col("code"))).cast("double").alias(v) for v in ("base", "head")])
    blocks = duplicates.windows(files.select(F.concat("version", F.lit("/"), "path").alias("path"), "ext", "content"), 3)
    # a digest counts for the version in which it comes twice
    per = blocks.groupBy("h").agg(*[F.count(F.when(F.col("path").startswith(v), 1)).alias(v) for v in ("base", "head")])
    clusters = per.agg(*[F.count(F.when(F.col(v) > 1, 1)).cast("double").alias(v) for v in ("base", "head")])
    missing = spark.createDataFrame([("complexity", None, 3.0)], "metric string, base double, head double")
    metrics = loc.select(F.lit("code").alias("metric"), "base", "head").unionByName(
        clusters.select(F.lit("clusters").alias("metric"), "base", "head")
    ).unionByName(missing)
    shown = delta.metric_rows(metrics).select("metric", "base", "head", "verdict")
    return shown.crossJoin(delta.regression(metrics))  # one row


# ---------------------------------------------------------------- plans


def _changes(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    block = F.concat(F.lit("s"), "l_suppkey", F.lit(":"), "l_linenumber")
    keys = items.groupBy("l_orderkey").agg(
        F.collect_set(F.concat(F.lit("mod/p"), "l_partkey")).alias("files"),
        F.collect_set(F.when(F.col("l_returnflag") == "R", block)).alias("cluster"),
        F.collect_set(F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), block)).alias("targets"),
    )
    joined = orders.join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("o_orderkey").alias("plan_order"), F.col("o_orderkey").cast("string").alias("id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"), F.col("o_orderstatus").alias("category"),
        *[F.coalesce(c, none).alias(c) for c in ("files", "cluster", "targets")], (F.col("o_custkey") % 40).alias("est"),
    )


def plan_conflicts(spark, sf_dir):
    found = plans.conflicts(plans.candidates(_changes(spark, sf_dir)))
    return found.select("a", "b", plans.reason(F.col("rule"), F.col("shared")).alias("reason"))


def plan_deferred(spark, sf_dir):
    return plans.deferred(_changes(spark, sf_dir)).select("id", "tier", "reason")


def plan_validation(spark, sf_dir):
    """Customers' ids as change ids: those that come again."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return plans.duplicate_ids(orders)


def plan_blind_spots(spark, sf_dir):
    return plans.blind_spots(_changes(spark, sf_dir)).select("id")


def plan_groups(spark, sf_dir):
    return plans.groups(_changes(spark, sf_dir))


def plan_totals(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    return plans.partition_totals(changes, plans.groups(changes))


def effective_tier(spark, sf_dir):
    return plans.effective_tier(_changes(spark, sf_dir), [("mod/p*7", 2), ("mod/p1?", 3)]).select("id", "tier", "effective_tier")


def verification_bar(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    return changes.groupBy(plans.verification_bar(F.col("tier")).alias("bar")).agg(F.count(F.lit(1)).alias("n"))


def projected_reduction(spark, sf_dir):
    return plans.projected_reduction(_changes(spark, sf_dir), lines.inventory(tables.document_files(spark, sf_dir)), 5.0)


def sign_off(spark, sf_dir):
    return plans.sign_off(_changes(spark, sf_dir)).select("id")


def batch_manifest(spark, sf_dir):
    subject = F.concat(
        "event_type", F.lit(": user "), "user_id", F.when(F.col("value") > 50, F.concat(F.lit(" [verified: "), "event_id", F.lit("]"))).otherwise("")
    )
    return plans.batch_manifest(table(spark, sf_dir, "events").select(F.col("event_id").alias("sha"), subject.alias("subject")))


def last_per_key(spark, sf_dir):
    return report.last_per_key(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


def section_items(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    line = F.when(F.col("turn") == 0, F.concat(F.lit("## "), "role")).otherwise(
        F.concat(F.lit("- turn "), "turn", F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" — "), "role")).otherwise(""))
    )
    return report.section_bullets(talks.select(F.col("conv_id").alias("doc"), F.col("turn").alias("line_no"), line.alias("line")), "User")


# ---------------------------------------------------------------- graphs

CUSTOMER = 1_000_000_000_000


def cluster_components(spark, sf_dir):
    """Orders tied to their customers, customers to the next one within their ten."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    own = orders.select(F.col("o_orderkey").alias("a"), (F.col("o_custkey") + CUSTOMER).alias("b"))
    nxt = customers.where(F.col("c_custkey") % 10 != 9).select((F.col("c_custkey") + CUSTOMER).alias("a"), (F.col("c_custkey") + CUSTOMER + 1).alias("b"))
    return graph.components(own.unionByName(nxt))


def orphans(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).where("src % 3 <> 0")
    return graph.orphans(nodes, edges)


def unused_definitions(spark, sf_dir):
    defined = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    used = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 200000).select(F.col("o_custkey").alias("key"))
    return graph.unreferenced(defined, used, "key")


def unused_dependencies(spark, sf_dir):
    declared = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    imported = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 9000).select(F.col("s_nationkey").alias("key"))
    return graph.unreferenced(declared, imported, "key")


def import_cycles(spark, sf_dir):
    """Parts in fives: each imports the next, and in every third five the last imports the first."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey")
    chain = part.where(key % 5 != 4).select(key.alias("src"), (key + 1).alias("dst"))
    back = part.where((key % 5 == 4) & (F.floor(key / 5) % 3 == 0)).select(key.alias("src"), (key - 4).alias("dst"))
    return graph.cycles(chain.unionByName(back))


CHANGED_SQL = "changed AS (SELECT path FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))"
CHANGES_SQL = """changes AS (
  SELECT o_orderkey AS plan_order, CAST(o_orderkey AS VARCHAR) AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS tier, o_orderstatus AS category, o_custkey % 40 AS est FROM orders),
item AS (
  SELECT l_orderkey AS o, 'mod/p' || l_partkey AS file, CASE WHEN l_returnflag = 'R' THEN 's' || l_suppkey || ':' || l_linenumber END AS cluster,
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 's' || l_suppkey || ':' || l_linenumber END AS target FROM lineitem)"""
PAIRS_SQL = f"""WITH {CHANGES_SQL},
own AS (SELECT i.* FROM item i JOIN changes c ON i.o = c.plan_order WHERE c.tier = 1),
hits AS (
  SELECT x.o AS a, y.o AS b, 1 AS rule, x.file AS shared FROM own x JOIN own y ON x.file = y.file AND x.o < y.o
  UNION ALL SELECT x.o, y.o, 2, x.cluster FROM own x JOIN own y ON x.cluster = y.cluster AND x.o < y.o
  UNION ALL SELECT least(x.o, y.o), greatest(x.o, y.o), 3, x.target FROM own x JOIN own y ON x.target = y.cluster AND x.o <> y.o),
best AS (SELECT a, b, min((rule, shared)) AS x FROM hits GROUP BY a, b)
SELECT a, b, CASE x[1] WHEN 1 THEN 'same file: ' WHEN 2 THEN 'duplicate cluster overlap: '
  ELSE 'target block is inside the other change''s duplicate cluster: ' END || x[2] AS reason FROM best"""
# First-fit in plan order, by recursion: each change takes the smallest color that no earlier neighbour has.
COLORS_SQL = f"""WITH RECURSIVE {CHANGES_SQL},
cand AS (SELECT plan_order, row_number() OVER (ORDER BY plan_order) AS i FROM changes WHERE tier = 1 AND EXISTS (SELECT 1 FROM item WHERE o = plan_order)),
edge AS (SELECT x.i AS i, y.i AS j FROM ({PAIRS_SQL}) p JOIN cand x ON p.b = x.plan_order JOIN cand y ON p.a = y.plan_order),
near AS (SELECT c.i, c.plan_order, list(e.j) FILTER (WHERE e.j IS NOT NULL) AS js FROM cand c LEFT JOIN edge e ON e.i = c.i GROUP BY c.i, c.plan_order),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS cs
  UNION ALL
  SELECT n.i, list_append(w.cs, list_filter(range(1, len(w.cs) + 2), lambda c: NOT list_contains(list_transform(coalesce(n.js, []), lambda j: w.cs[j]), c))[1])
  FROM walk w JOIN near n ON n.i = w.i + 1),
colors AS (SELECT n.plan_order, CAST(w.cs[w.i] AS INT) AS color FROM walk w JOIN near n ON n.i = w.i)"""
DEFERRED = "tier <> 1 OR NOT EXISTS (SELECT 1 FROM item WHERE o = plan_order)"
PATHS_SQL = "paths AS (SELECT source || '/' || lang || '/' || doc_id || '.py' AS path FROM documents)"

QUERIES = {
    "exclude_filter": (
        exclude_filter,
        f"WITH {PATHS_SQL} SELECT path FROM paths WHERE NOT (path LIKE 'src1/%' OR path LIKE '%/de/%' OR path LIKE '%7.py' OR path LIKE 'src2/fr/%' OR regexp_matches(path, '^src[34]/es/1.*\\.py$'))",
    ),
    "segment_exclude": (
        segment_exclude,
        f"WITH {PATHS_SQL} SELECT path FROM paths WHERE NOT (path LIKE '%/en/%' OR path LIKE '%/es/%' OR path LIKE '%9.py' OR path LIKE 'src5/de/%')",
    ),
    "changed_scope_loc": (
        changed_scope_loc,
        LOC + f", {CHANGED_SQL} SELECT ext, CAST(sum(code) AS BIGINT) AS code, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(comment) AS BIGINT) AS comment, "
        "CAST(sum(total) AS BIGINT) AS total, count(*) AS files FROM loc WHERE path IN (SELECT path FROM changed) GROUP BY ext",
    ),
    "changed_scope_clusters": (
        changed_scope_clusters,
        f"""WITH {FILES}, {CHANGED_SQL}, {windows_sql(5)},
big AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1 AND bool_or(path IN (SELECT path FROM changed)))
SELECT DISTINCT path, line FROM w WHERE h IN (SELECT h FROM big)""",
    ),
    "changed_scope_pairs": (
        changed_scope_pairs,
        f"WITH near AS ({NEAR_SQL}), {FILES}, {CHANGED_SQL} SELECT * FROM near WHERE a_path IN (SELECT path FROM changed) OR b_path IN (SELECT path FROM changed)",
    ),
    "changed_scope_pairs_all": (changed_scope_pairs_all, None),
    "regression_verdict": (
        regression_verdict,
        LOC + f""", {windows_sql(3, tag='3')},
sized AS (SELECT doc_id % 2 AS r, CAST(sum(code) AS DOUBLE) AS v FROM loc JOIN docs USING (path) GROUP BY 1),
twice AS (SELECT doc_id % 2 AS r, h FROM w3 JOIN docs USING (path) GROUP BY 1, 2 HAVING count(*) > 1),
m AS (SELECT 'code' AS metric, (SELECT v FROM sized WHERE r = 0) AS base, (SELECT v FROM sized WHERE r = 1) AS head
  UNION ALL SELECT 'clusters', (SELECT CAST(count(*) AS DOUBLE) FROM twice WHERE r = 0), (SELECT CAST(count(*) AS DOUBLE) FROM twice WHERE r = 1)
  UNION ALL SELECT 'complexity', NULL, 3.0)
SELECT metric, base, head, CASE WHEN base IS NULL THEN NULL WHEN head = base THEN 'neutral' WHEN head < base THEN 'good' ELSE 'bad' END AS verdict,
       (SELECT bool_or(head > base) FROM m WHERE base IS NOT NULL) AS regression FROM m""",
    ),
    "plan_conflicts": (plan_conflicts, PAIRS_SQL),
    "plan_deferred": (
        plan_deferred,
        f"WITH {CHANGES_SQL} SELECT id, tier, CASE WHEN tier <> 1 THEN 'tier ' || tier || ' is never parallelized (parallel execution is scoped to tier 1)' "
        f"ELSE 'no files declared: independence cannot be proven, so it runs serially' END AS reason FROM changes WHERE {DEFERRED}",
    ),
    "plan_validation": (plan_validation, "SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1"),
    "plan_blind_spots": (
        plan_blind_spots,
        f"WITH {CHANGES_SQL} SELECT id FROM changes WHERE tier = 1 AND NOT EXISTS (SELECT 1 FROM item WHERE o = plan_order AND cluster IS NOT NULL)",
    ),
    "plan_groups": (plan_groups, COLORS_SQL + " SELECT plan_order, color FROM colors"),
    "plan_totals": (
        plan_totals,
        COLORS_SQL + ", n AS (SELECT count(*) AS total_changes FROM changes) SELECT total_changes, count(*) AS parallelizable, max(color) AS group_count FROM colors, n GROUP BY total_changes",
    ),
    "effective_tier": (
        effective_tier,
        f"""WITH {CHANGES_SQL} SELECT id, tier, greatest(tier,
  CASE WHEN EXISTS (SELECT 1 FROM item WHERE o = plan_order AND file LIKE 'mod/p%7') THEN 2 ELSE 0 END,
  CASE WHEN EXISTS (SELECT 1 FROM item WHERE o = plan_order AND file LIKE 'mod/p1_') THEN 3 ELSE 0 END) AS effective_tier FROM changes""",
    ),
    "verification_bar": (
        verification_bar,
        f"WITH {CHANGES_SQL} SELECT CASE tier WHEN 1 THEN 'tests and build' WHEN 2 THEN 'tests, build and characterization test' ELSE 'human sign-off' END AS bar, count(*) AS n FROM changes GROUP BY 1",
    ),
    "projected_reduction": (
        projected_reduction,
        LOC + f", {CHANGES_SQL}, t AS (SELECT (SELECT CAST(sum(est) AS BIGINT) FROM changes) AS saved, (SELECT CAST(sum(code) AS BIGINT) FROM loc JOIN docs USING (path)) AS code) "
        "SELECT saved, code, round(saved / code * 100, 2) AS percent, round(saved / code * 100, 2) >= 5.0 AS met FROM t",
    ),
    "sign_off": (sign_off, f"WITH {CHANGES_SQL} SELECT id FROM changes WHERE tier = 3 OR category = 'judgment call'"),
    "batch_manifest": (
        batch_manifest,
        "SELECT event_id AS sha, event_type AS category, 'user ' || user_id AS summary, CASE WHEN value > 50 THEN CAST(event_id AS VARCHAR) END AS verification FROM events",
    ),
    "last_per_key": (last_per_key, "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
    "section_items": (
        section_items,
        """SELECT c.conv_id AS doc, c.turn AS line_no, 'turn ' || c.turn AS item, CASE WHEN c.turn % 2 = 1 THEN c.role ELSE '' END AS reason
           FROM conversations c JOIN (SELECT conv_id, role FROM conversations WHERE turn = 0) h USING (conv_id) WHERE lower(h.role) = 'user' AND c.turn > 0""",
    ),
    "cluster_components": (
        cluster_components,
        f"""WITH own AS (SELECT o_orderkey AS a, o_custkey AS c FROM orders),
cust AS (SELECT c_custkey AS c FROM customer UNION SELECT c_custkey + 1 FROM customer WHERE c_custkey % 10 <> 9 UNION SELECT c FROM own),
tied AS (SELECT c, c // 10 AS g FROM cust),
-- a customer stands in an edge if it has an order or a neighbour in its ten
edged AS (SELECT c, g FROM tied WHERE c IN (SELECT c FROM own) OR EXISTS (SELECT 1 FROM customer WHERE c_custkey % 10 <> 9 AND (c_custkey = tied.c OR c_custkey + 1 = tied.c))),
nodes AS (SELECT a AS node, c // 10 AS g FROM own UNION ALL SELECT c + {CUSTOMER}, g FROM edged)
SELECT node, min(node) OVER (PARTITION BY g) AS component FROM nodes""",
    ),
    "orphans": (
        orphans,
        "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_orderkey % 3 <> 0 AND l_orderkey <> l_partkey)",
    ),
    "unused_definitions": (
        unused_definitions,
        "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    ),
    "unused_dependencies": (
        unused_dependencies,
        "SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
    ),
    "import_cycles": (
        import_cycles,
        "SELECT p_partkey AS node, p_partkey // 5 * 5 AS cycle FROM part WHERE (p_partkey // 5) % 3 = 0 "
        "AND (SELECT count(*) FROM part q WHERE q.p_partkey // 5 = part.p_partkey // 5) = 5",
    ),
}
