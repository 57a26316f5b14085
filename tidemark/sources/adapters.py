"""Star-schema test tables seen as version-control history.

Events and orders become commits, line items file changes, nations repositories, parts a file tree. The same rules are
written as SQL in ``CTES``, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        n.cast("long").alias("repo_id"),
        F.col("n_name").alias("display_name"),
        (n % 8 != 7).alias("active"),
        F.when(n % 10 == 8, "stale").when(n % 10 == 9, "error").otherwise("ready").alias("status"),
        (n % 6 == 0).alias("is_shallow"),
        (n % 11 == 0).alias("is_partial"),
        (n % 13 == 0).alias("is_bare"),
        F.when(n % 2 == 0, "main").otherwise("trunk").alias("head_branch"),
        F.lit("main").alias("default_branch"),
        (n % 4).cast("int").alias("local_branches"),
        (n % 3).cast("int").alias("remote_branches"),
    )


def privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    kind = F.when(n % 5 == 4, None).when(n % 3 == 0, "public").otherwise("private")
    return read(spark, sf_dir, "nation").select(n.cast("long").alias("repo_id"), kind.alias("classification"))


def _calendar(ts: str) -> list:
    t = F.col(ts)
    return [
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("activity_at"),
        F.to_date(t).alias("activity_date"),
        F.year(t).alias("activity_year"),
        F.month(t).alias("activity_month"),
        F.weekday(t).alias("activity_weekday"),
        F.hour(t).alias("activity_hour"),
    ]


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of commits, one for each event."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user, event, k = F.col("user_id").cast("string"), F.col("event_id"), F.col("k")
    kinds = {"view": "docs", "click": "feat", "purchase": "release", "signup": "init", "error": "fix"}
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in kinds.items() for x in p)), F.col("event_type")), F.lit("other"))
    known = event % 20 != 0
    text = event.cast("string")
    subject = (
        F.when(event % 6 == 0, F.concat(F.lit("Feat(area"), k.cast("string"), F.lit("): part #"), text))
        .when(event % 6 == 1, F.concat(F.lit("fix!: see ABC-"), text))
        .when(event % 6 == 2, F.concat(F.lit("Merge branch "), text))
        .when(event % 6 == 3, F.lit("Revert it"))
        .when(event % 6 == 4, F.lit("  "))
        .otherwise(F.concat(F.lit("plain words "), text))
    )
    email = F.concat(F.lit("u"), user, F.lit("@example.org"))
    return e.select(
        (k % 10).cast("long").alias("repo_id"),
        text.alias("hash"),
        F.when(k % 7 == 0, 2).otherwise(1).alias("parent_count"),
        F.when(event % 97 == 0, F.concat(F.lit("Alt "), user)).otherwise(F.concat(F.lit("User "), (F.col("user_id") % 60).cast("string"))).alias("author_name_raw"),
        F.concat(F.lit("U"), user, F.lit("@Example.org")).alias("author_email_raw"),
        F.concat(F.lit("User "), user).alias("author_name"),
        email.alias("author_email"),
        F.substring(F.sha2(email, 256), 1, 24).alias("author_key"),
        (F.col("user_id") % 25 == 0).alias("author_is_bot"),
        F.substring(F.sha2(F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string")), 256), 1, 24).alias("committer_key"),
        *_calendar("ts"),
        ((F.col("user_id") % 5) * 60 - 120).cast("int").alias("timezone_offset_minutes"),
        subject.alias("subject"),
        kind.alias("message_type"),
        F.when(k % 4 != 0, F.concat(F.lit("scope"), (k % 13).cast("string"))).alias("message_scope"),
        (k % 11 == 0).alias("is_breaking"),
        (event % 3 == 0).alias("has_issue_reference"),
        (k % 7 == 0).alias("is_merge"),
        (event % 9 != 0).alias("is_trusted"),
        F.when(known, F.floor("value").cast("long")).otherwise(0).alias("insertions"),
        F.when(known, k.cast("long")).otherwise(0).alias("deletions"),
        (k % 5 + 1).alias("files_changed"),
        (k % 3).alias("binary_files"),
        known.alias("stats_collected"),
    )


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of commits, one for each order."""
    o = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        (o % 10).alias("repo_id"),
        o.cast("string").alias("hash"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("author_name"),
        F.col("o_custkey").cast("string").alias("author_key"),
        F.lit("").alias("author_email"),
        (F.col("o_custkey") % 50 == 0).alias("author_is_bot"),
        *_calendar("o_orderdate"),
        F.col("o_orderpriority").alias("message_type"),
        (o % 6 == 0).alias("is_merge"),
        (o % 7 != 0).alias("is_trusted"),
        F.floor(F.col("o_totalprice") / 1000).alias("insertions"),
        (o % 40).alias("deletions"),
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the files of order commits, one for each line item."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    line = read(spark, sf_dir, "lineitem").join(part, "l_partkey")
    o = F.col("l_orderkey")
    return line.select(
        (o % 10).alias("repo_id"),
        o.cast("string").alias("commit_hash"),
        F.col("p_name").alias("path"),
        F.col("p_type").alias("language"),
        F.col("p_brand").alias("top_directory"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("long")).alias("insertions"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("long")).alias("deletions"),
        (F.col("l_linenumber") == 7).alias("is_binary"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("repo_id"), F.col("p_type").alias("language"), F.col("p_size").cast("long").alias("size"))
    return files.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("repo_id"), F.col("p_brand").alias("file_type"), F.col("p_size").cast("long").alias("size"))
    return files.groupBy("repo_id", "file_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def tree_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CI systems and licences of repositories; one in nine has no row."""
    n = F.col("n_nationkey")
    ci = F.when(n % 4 == 0, F.array(F.lit("GitHub Actions"), F.lit("Jenkins"))).when(n % 4 == 1, F.array(F.lit("GitLab CI"))).otherwise(F.array().cast("array<string>"))
    licenses = F.when(n % 3 == 0, F.array(F.lit("MIT"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "nation").where(n % 9 != 5).select(n.cast("long").alias("repo_id"), ci.alias("ci_systems"), licenses.alias("licenses"))


def comment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment statistics by repository, language and kind, made up from the parts."""
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("repo_id"), F.col("p_type").alias("language"), F.col("p_size").cast("long").alias("n"), "p_partkey")
    all_of = p.groupBy("repo_id", "language", F.lit("all").alias("kind")).agg(
        F.count("*").alias("files"), F.sum(F.col("n") * 3).alias("code_lines"), F.sum("n").alias("comment_lines"), F.sum(F.col("p_partkey") % 3).alias("blank_lines")
    )
    kind = F.element_at(F.array(F.lit("line"), F.lit("block"), F.lit("documentation")), (F.col("p_partkey") % 3 + 1).cast("int"))
    zero = F.lit(0).cast("long")
    kinds = p.groupBy("repo_id", "language", kind.alias("kind")).agg(zero.alias("files"), zero.alias("code_lines"), F.sum("n").alias("comment_lines"), zero.alias("blank_lines"))
    return all_of.unionByName(kinds)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 25).alias("repo_id"),
        F.concat(F.lit("v"), o.cast("string")).alias("name"),
        F.when(o % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("created_at"),
        F.substring(F.sha2(o.cast("string"), 256), 1, 40).alias("object_hash"),
    )


# The same in DuckDB's SQL. ``ec`` are effective event commits, ``oc`` order commits, ``fc`` file changes of order commits.
REPOSITORIES = """
repositories AS (
  SELECT n_nationkey::BIGINT AS repo_id, n_name AS display_name, n_nationkey % 8 <> 7 AS active,
         CASE WHEN n_nationkey % 10 = 8 THEN 'stale' WHEN n_nationkey % 10 = 9 THEN 'error' ELSE 'ready' END AS status,
         n_nationkey % 6 = 0 AS is_shallow, n_nationkey % 11 = 0 AS is_partial, n_nationkey % 13 = 0 AS is_bare,
         CASE WHEN n_nationkey % 2 = 0 THEN 'main' ELSE 'trunk' END AS head_branch, 'main' AS default_branch,
         (n_nationkey % 4)::INTEGER AS local_branches, (n_nationkey % 3)::INTEGER AS remote_branches FROM nation
), names AS (SELECT repo_id, display_name AS repository FROM repositories WHERE active AND status IN ('ready', 'stale')
), privacy AS (
  SELECT n_nationkey::BIGINT AS repo_id, CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'public' ELSE 'private' END AS classification FROM nation
)"""
EVENTS = """
raw_commits AS (
  SELECT (k % 10)::BIGINT AS repo_id, event_id::VARCHAR AS hash, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS parent_count,
         CASE WHEN event_id % 97 = 0 THEN 'Alt ' || user_id ELSE 'User ' || (user_id % 60) END AS author_name_raw, 'U' || user_id || '@Example.org' AS author_email_raw,
         'User ' || user_id AS author_name, 'u' || user_id || '@example.org' AS author_email, substr(sha256('u' || user_id || '@example.org'), 1, 24) AS author_key,
         user_id % 25 = 0 AS author_is_bot, substr(sha256('c' || (user_id % 9)), 1, 24) AS committer_key,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS activity_at, ts::DATE AS activity_date, year(ts)::INTEGER AS activity_year, month(ts)::INTEGER AS activity_month,
         (isodow(ts) - 1)::INTEGER AS activity_weekday, hour(ts)::INTEGER AS activity_hour, ((user_id % 5) * 60 - 120)::INTEGER AS timezone_offset_minutes,
         CASE event_id % 6 WHEN 0 THEN 'Feat(area' || k || '): part #' || event_id WHEN 1 THEN 'fix!: see ABC-' || event_id WHEN 2 THEN 'Merge branch ' || event_id
              WHEN 3 THEN 'Revert it' WHEN 4 THEN '  ' ELSE 'plain words ' || event_id END AS subject,
         CASE event_type WHEN 'view' THEN 'docs' WHEN 'click' THEN 'feat' WHEN 'purchase' THEN 'release' WHEN 'signup' THEN 'init' WHEN 'error' THEN 'fix' ELSE 'other' END AS message_type,
         CASE WHEN k % 4 <> 0 THEN 'scope' || (k % 13) END AS message_scope, k % 11 = 0 AS is_breaking, event_id % 3 = 0 AS has_issue_reference, k % 7 = 0 AS is_merge,
         event_id % 9 <> 0 AS is_trusted, CASE WHEN event_id % 20 <> 0 THEN floor(value)::BIGINT ELSE 0 END AS insertions,
         CASE WHEN event_id % 20 <> 0 THEN k::BIGINT ELSE 0 END AS deletions, k % 5 + 1 AS files_changed, k % 3 AS binary_files, event_id % 20 <> 0 AS stats_collected
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
), ec AS (SELECT c.*, repository FROM raw_commits c JOIN names USING (repo_id))"""
ORDERS = """
order_commits AS (
  SELECT (o_orderkey % 10)::BIGINT AS repo_id, o_orderkey::VARCHAR AS hash, 'Customer ' || o_custkey AS author_name, o_custkey::VARCHAR AS author_key, '' AS author_email,
         o_custkey % 50 = 0 AS author_is_bot, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS activity_at, o_orderdate::DATE AS activity_date, year(o_orderdate)::INTEGER AS activity_year,
         o_orderpriority AS message_type, o_orderkey % 6 = 0 AS is_merge, o_orderkey % 7 <> 0 AS is_trusted, floor(o_totalprice / 1000)::BIGINT AS insertions, o_orderkey % 40 AS deletions FROM orders
), oc AS (SELECT c.*, repository FROM order_commits c JOIN names USING (repo_id))"""
CHANGES = """
file_changes AS (
  SELECT (l_orderkey % 10)::BIGINT AS repo_id, l_orderkey::VARCHAR AS commit_hash, p_name AS path, p_type AS language, p_brand AS top_directory,
         CASE WHEN l_linenumber <> 7 THEN l_quantity::BIGINT END AS insertions, CASE WHEN l_linenumber <> 7 THEN l_linenumber::BIGINT END AS deletions, l_linenumber = 7 AS is_binary
  FROM lineitem JOIN part ON p_partkey = l_partkey
), fc AS (SELECT f.*, oc.repository, oc.author_key, oc.activity_at FROM file_changes f JOIN oc ON oc.repo_id = f.repo_id AND oc.hash = f.commit_hash)"""
TREE = """
tree AS (SELECT (p_partkey % 25)::BIGINT AS repo_id, p_type AS language, count(*) AS files, sum(p_size)::BIGINT AS bytes FROM part GROUP BY 1, 2
), comment_totals AS (
  SELECT (p_partkey % 25)::BIGINT AS repo_id, p_type AS language, 'all' AS kind, count(*) AS files, sum(p_size * 3)::BIGINT AS code_lines, sum(p_size)::BIGINT AS comment_lines,
         sum(p_partkey % 3)::BIGINT AS blank_lines FROM part GROUP BY 1, 2
  UNION ALL
  SELECT (p_partkey % 25)::BIGINT, p_type, CASE p_partkey % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'block' ELSE 'documentation' END, 0, 0, sum(p_size)::BIGINT, 0 FROM part GROUP BY 1, 2, 3
), file_types AS (SELECT (p_partkey % 25)::BIGINT AS repo_id, p_brand AS file_type, count(*) AS files, sum(p_size)::BIGINT AS bytes FROM part GROUP BY 1, 2
), tree_signals AS (
  SELECT n_nationkey::BIGINT AS repo_id, CASE n_nationkey % 4 WHEN 0 THEN 'GitHub Actions,Jenkins' WHEN 1 THEN 'GitLab CI' ELSE '' END AS ci_systems,
         CASE WHEN n_nationkey % 3 = 0 THEN 'MIT' ELSE '' END AS licenses FROM nation WHERE n_nationkey % 9 <> 5
), tags AS (
  SELECT (o_custkey % 25)::BIGINT AS repo_id, 'v' || o_orderkey AS name, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS created_at,
         substr(sha256(o_orderkey::VARCHAR), 1, 40) AS object_hash FROM orders
)"""
CTES = {"events": EVENTS, "orders": ORDERS, "changes": CHANGES, "tree": TREE}


def with_tables(sql: str, *names: str) -> str:
    """``sql`` with the named tables in front of it."""
    return "WITH " + ", ".join([REPOSITORIES, *(CTES[n] for n in names)]) + "\n" + sql
