"""Queries over lines: inventory, exact, masked and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import duplicates, lines
from codeloom.sources import tables


def _blocks(spark: SparkSession, sf_dir: str, k: int, mask: bool = False) -> DataFrame:
    return duplicates.windows(tables.document_files(spark, sf_dir), k, mask)


def loc_inventory(spark, sf_dir):
    files = tables.document_files(spark, sf_dir).select("path", "ext", "content")
    return lines.inventory(files.unionByName(tables.page_files(spark, sf_dir).select("path", "ext", "content")))


def loc_totals(spark, sf_dir):
    return lines.totals(loc_inventory(spark, sf_dir), "ext")


def loc_top10(spark, sf_dir):
    return lines.largest(loc_inventory(spark, sf_dir)).select("path", "code")


def loc_diff(spark, sf_dir):
    files = tables.document_files(spark, sf_dir)
    before, after = (lines.totals(lines.inventory(files.where(F.col("doc_id") % 2 == r))) for r in (0, 1))
    return lines.totals_delta(before, after)


def exact_clusters(k: int, mask: bool = False):
    return lambda spark, sf_dir: duplicates.cluster_sizes(_blocks(spark, sf_dir, k, mask))


def cluster_members(spark, sf_dir):
    return duplicates.cluster_members(_blocks(spark, sf_dir, 5))


def cluster_sizes_top25(spark, sf_dir):
    return duplicates.largest_clusters(_blocks(spark, sf_dir, 5)).select("h", "n")


def cross_corpus_duplicates(spark, sf_dir):
    bench = tables.table(spark, sf_dir, "benchmark")
    other = bench.select(F.col("item_id").cast("string").alias("path"), F.lit(".txt").alias("ext"), F.col("text").alias("content"))
    return duplicates.cross_corpus(_blocks(spark, sf_dir, 1), duplicates.windows(other, 1))


def near_pairs_dice(spark, sf_dir):
    return duplicates.near_pairs_dice(_blocks(spark, sf_dir, 5))


def near_pairs_dice_all(spark, sf_dir):
    """Every near pair; ``near_pairs_dice`` is the form with a pair budget, kept for compatibility."""
    return duplicates.similar_pairs(_blocks(spark, sf_dir, 5)).withColumn("ratio", F.round("ratio", 2))


def near_pairs_difflib(spark, sf_dir):
    return duplicates.near_pairs_difflib(_blocks(spark, sf_dir, 5))


def conversation_clusters(spark, sf_dir):
    return duplicates.cluster_sizes(duplicates.windows(tables.conversation_files(spark, sf_dir), 1))


# The path, extension and lines of each document, as SQL.
FILES = r"""
docs AS (
  SELECT source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.js' WHEN 'fr' THEN '.html' WHEN 'es' THEN '.rs' ELSE '.txt' END AS path,
         CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.js' WHEN 'fr' THEN '.html' WHEN 'es' THEN '.rs' ELSE '.txt' END AS ext,
         doc_id, coalesce(text, '') AS content FROM documents)"""

LOC = (
    "WITH "
    + FILES
    + r""",
files AS (
  SELECT path, ext, content FROM docs
  UNION ALL SELECT 'pages/' || page_id || '.html', '.html', replace(html, '>', '>' || chr(10)) FROM pages),
cut AS (SELECT path, ext, string_split_regex(content, '\r\n|\r|\n') AS parts FROM files),
whole AS (SELECT path, ext, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM cut),
raw AS (SELECT path, ext, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM whole),
marked AS (
  SELECT path, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line,
         CASE ext WHEN '.py' THEN '#' WHEN '.js' THEN '//' WHEN '.rs' THEN '//' END AS m,
         CASE ext WHEN '.py' THEN repeat('"', 3) WHEN '.js' THEN '/*' WHEN '.rs' THEN '/*' WHEN '.html' THEN '<!--' END AS s,
         CASE ext WHEN '.py' THEN repeat('"', 3) WHEN '.js' THEN '*/' WHEN '.rs' THEN '*/' WHEN '.html' THEN '-->' END AS e
  FROM raw),
-- what a line does to the comment state: keep, clear, set or flip it
acting AS (
  SELECT *, CASE WHEN line = '' OR s IS NULL THEN 'keep'
                 WHEN starts_with(line, s) AND contains(substr(line, length(s) + 1), e) THEN 'clear'
                 WHEN starts_with(line, s) AND contains(line, e) THEN 'flip'
                 WHEN starts_with(line, s) THEN 'set'
                 WHEN contains(line, e) THEN 'clear' ELSE 'keep' END AS act FROM marked),
grouped AS (
  SELECT *, coalesce(count(*) FILTER (WHERE act IN ('clear', 'set')) OVER before, 0) AS g,
         last_value(CASE act WHEN 'set' THEN 1 WHEN 'clear' THEN 0 END IGNORE NULLS) OVER before AS base
  FROM acting WINDOW before AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stated AS (
  SELECT *, (coalesce(base, 0) + coalesce(count(*) FILTER (WHERE act = 'flip') OVER (
    PARTITION BY path, g ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 AS inside FROM grouped),
judged AS (
  SELECT path, CASE WHEN line = '' THEN 'blank' WHEN inside = 1 THEN 'comment'
                    WHEN s IS NOT NULL AND starts_with(line, s) THEN 'comment'
                    WHEN m IS NOT NULL AND starts_with(line, m) THEN 'comment' ELSE 'code' END AS kind FROM stated),
loc AS (
  SELECT f.path, any_value(f.ext) AS ext, count(*) FILTER (WHERE kind = 'code') AS code, count(*) FILTER (WHERE kind = 'blank') AS blank,
         count(*) FILTER (WHERE kind = 'comment') AS comment, count(kind) AS total
  FROM files f LEFT JOIN judged j USING (path) GROUP BY f.path)
"""
)


def windows_sql(k: int, mask: bool = False, source: str = "docs", tag: str = "") -> str:
    """Windows of k lines as SQL: CTEs that end in w{tag}(path, line, block, h)."""
    norm = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"
    if mask:
        norm = rf"regexp_replace(regexp_replace({norm}, '''[^'']*''|\"[^\"]*\"', 'STR', 'g'), '\b\d+(\.\d+)?\b', 'NUM', 'g')"
        norm = norm.replace('\\"', '"')
    return rf"""
cut{tag} AS (SELECT path, string_split_regex(content, '\r\n|\r|\n') AS parts FROM {source}),
raw{tag} AS (SELECT path, unnest(parts) AS line, CAST(unnest(range(1, len(parts) + 1)) AS INT) AS line_no FROM cut{tag}),
own{tag} AS (SELECT path, line_no, {norm} AS norm FROM raw{tag}),
run{tag} AS (
  SELECT path, line_no AS line, string_agg(norm, chr(10)) OVER nxt AS block, count(*) OVER nxt AS c FROM own{tag} WHERE norm <> ''
  WINDOW nxt AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)),
w{tag} AS (SELECT path, line, block, sha1(block) AS h FROM run{tag} WHERE c = {k})
"""


def clusters_sql(k: int, mask: bool = False) -> str:
    return f"""WITH {FILES}, {windows_sql(k, mask)}
SELECT h, count(*) AS n, min((path, line))[1] AS path, min((path, line))[2] AS line FROM w GROUP BY h HAVING count(*) > 1"""


NEAR_SQL = f"""WITH {FILES}, {windows_sql(5)},
firsts AS (SELECT h, min((path, line, block)) AS x FROM w GROUP BY h),
texts AS (SELECT x[1] AS path, x[2] AS line, x[3] AS block, row_number() OVER (ORDER BY x[1], x[2]) - 1 AS i, count(*) OVER () AS n FROM firsts),
pairs AS (
  SELECT a.path AS a_path, a.line AS a_line, b.path AS b_path, b.line AS b_line,
         string_split_regex(a.block, '\\s+') AS p, string_split_regex(b.block, '\\s+') AS q
  FROM texts a JOIN texts b ON a.i < b.i AND b.i <= 4002
  WHERE a.i * a.n - a.i * (a.i + 1) / 2 + (b.i - a.i - 1) < 4000 AND a.i * a.n - a.i * (a.i + 1) / 2 < 4000
    AND abs(length(a.block) - length(b.block)) <= 0.4 * greatest(length(a.block), length(b.block))),
grams AS (
  SELECT *, list_transform(range(1, len(p)), lambda i: p[i] || chr(31) || p[i + 1]) AS gp,
            list_transform(range(1, len(q)), lambda i: q[i] || chr(31) || q[i + 1]) AS gq FROM pairs),
scored AS (
  SELECT *, CASE WHEN len(p) + len(q) = 2 THEN CAST(p = q AS DOUBLE)
    ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(gp), lambda g: least(len(list_filter(gp, lambda z: z = g)), len(list_filter(gq, lambda z: z = g))))), 0)
         / (len(p) - 1 + len(q) - 1) END AS ratio FROM grams)
SELECT round(ratio, 2) AS ratio, a_path, a_line, b_path, b_line FROM scored WHERE ratio >= 0.85"""

BENCH = "bench AS (SELECT CAST(item_id AS VARCHAR) AS path, text AS content FROM benchmark)"
TALKS = "talks AS (SELECT conv_id || '/' || turn AS path, text AS content FROM conversations)"

QUERIES = {
    "loc_inventory": (loc_inventory, LOC + "SELECT * FROM loc"),
    "loc_totals": (
        loc_totals,
        LOC + "SELECT ext, CAST(sum(code) AS BIGINT) AS code, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(comment) AS BIGINT) AS comment, "
        "CAST(sum(total) AS BIGINT) AS total, count(*) AS files FROM loc GROUP BY ext",
    ),
    "loc_top10": (loc_top10, LOC + "SELECT path, code FROM loc ORDER BY code DESC, path LIMIT 10"),
    "loc_diff": (
        loc_diff,
        LOC
        + """, halves AS (
  SELECT d.doc_id % 2 AS r, CAST(sum(code) AS BIGINT) AS code, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(comment) AS BIGINT) AS comment,
         CAST(sum(total) AS BIGINT) AS total, count(*) AS files FROM loc JOIN docs d USING (path) GROUP BY 1),
melted AS (UNPIVOT halves ON code, blank, comment, total, files INTO NAME metric VALUE v)
SELECT metric, a.v AS before, b.v AS after, b.v - a.v AS delta,
       round(CASE WHEN a.v = 0 THEN 0.0 ELSE (b.v - a.v) / a.v * 100 END, 1) AS percent
FROM (SELECT * FROM melted WHERE r = 0) a JOIN (SELECT * FROM melted WHERE r = 1) b USING (metric)""",
    ),
    **{f"exact_clusters_k{k}": (exact_clusters(k), clusters_sql(k)) for k in (2, 3, 5, 8)},
    "masked_clusters": (exact_clusters(5, True), clusters_sql(5, True)),
    "cluster_members": (
        cluster_members,
        f"WITH {FILES}, {windows_sql(5)} SELECT h, path, line FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)",
    ),
    "cluster_sizes_top25": (
        cluster_sizes_top25,
        f"WITH {FILES}, {windows_sql(5)} SELECT h, count(*) AS n FROM w GROUP BY h HAVING count(*) > 1 ORDER BY n DESC, h LIMIT 25",
    ),
    "cross_corpus_duplicates": (
        cross_corpus_duplicates,
        f"WITH {FILES}, {BENCH}, {windows_sql(1)}, {windows_sql(1, source='bench', tag='2')} "
        "SELECT h, n_left, n_right FROM (SELECT h, count(*) AS n_left FROM w GROUP BY h) JOIN (SELECT h, count(*) AS n_right FROM w2 GROUP BY h) USING (h)",
    ),
    "conversation_clusters": (
        conversation_clusters,
        f"WITH {TALKS}, {windows_sql(1, source='talks')} SELECT h, count(*) AS n, min((path, line))[1] AS path, min((path, line))[2] AS line "
        "FROM w GROUP BY h HAVING count(*) > 1",
    ),
    "near_pairs_dice": (near_pairs_dice, NEAR_SQL),
    "near_pairs_dice_all": (near_pairs_dice_all, None),
    "near_pairs_difflib": (near_pairs_difflib, None),
}
