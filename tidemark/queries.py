"""The registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import settings
from tidemark.functions import identities, labels, paths, signals, subjects
from tidemark.functions.comments import line_counts
from tidemark.functions.globs import first_match
from tidemark.operators import activity, code, explore, network, people, repositories
from tidemark.operators.effective import effective_commits, effective_file_changes, with_author
from tidemark.operators.statistics import concentration
from tidemark.plans import checks, quality, report, sql_surface
from tidemark.sources import adapters as a
from tidemark.sources import forge, snapshot

#: The day up to which events are looked at, and orders.
EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-31", "2001-03-01"
IGNORED = (r"(?i)dependabot", r"(?i)user 1\d\b")


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, *tables: str):
    """Register a function of (spark, sf_dir) under its own name, with SQL over the named test tables."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = Query(run, a.with_tables(sql, *tables) if sql and tables else sql)
        return run

    return add


def events(s: SparkSession, d: str, **options: bool) -> DataFrame:
    return effective_commits(a.event_commits(s, d), a.repositories(s, d), **options)


def orders(s: SparkSession, d: str, **options: bool) -> DataFrame:
    return effective_commits(a.order_commits(s, d), a.repositories(s, d), **options)


def touched(s: SparkSession, d: str) -> DataFrame:
    commits = orders(s, d)
    return with_author(effective_file_changes(a.file_changes(s, d), commits), commits)


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def joined(*columns: str) -> dict[str, Column]:
    """Array columns as one string each."""
    return {c: F.array_join(c, ",") for c in columns}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles that two engines may sum in other orders."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"}) if any(k == "double" for _, k in df.dtypes) else df


_NAMES = "string_agg(DISTINCT repository, ',' ORDER BY repository) AS repository_names"
_MEASURES = """count(*) AS commits, count(DISTINCT author_key) AS authors, count(DISTINCT repo_id) AS repositories,
  sum(insertions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions"""


# ------------------------------------------------------------------------------------------------ effective rows
@query(
    "SELECT repository, count(*) AS commits, sum(insertions)::BIGINT AS insertions, min(activity_at) AS first_at FROM ec WHERE NOT author_is_bot GROUP BY repository", "events"
)
def effective_commits_filter(s, d):
    rows = events(s, d, include_bots=False).groupBy("repository")
    return rows.agg(F.count("*").alias("commits"), F.sum("insertions").alias("insertions"), F.min("activity_at").alias("first_at"))


@query(
    """SELECT repo_id, count(*) AS commits, sum(insertions)::BIGINT AS insertions FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY repo_id) AS k
  FROM (SELECT l_suppkey % 10 AS repo_id, l_orderkey AS hash, sum(l_quantity)::BIGINT AS insertions FROM lineitem GROUP BY ALL) JOIN (SELECT repo_id FROM (SELECT * FROM repositories WHERE active AND status IN ('ready', 'stale'))) USING (repo_id)
) WHERE k = 1 GROUP BY repo_id""",
    "tree",
)
def global_dedup(s, d):
    """An order's lines lie in several repositories, so hashes repeat across them."""
    line = a.read(s, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("repo_id"), F.col("l_orderkey").cast("string").alias("hash"))
    kept = effective_commits(line.agg(F.sum("l_quantity").cast("long").alias("insertions")), a.repositories(s, d), deduplicate=True)
    return kept.groupBy("repo_id").agg(F.count("*").alias("commits"), F.sum("insertions").alias("insertions"))


@query(
    """SELECT f.repo_id, count(*) AS changes, sum(f.insertions)::BIGINT AS insertions FROM file_changes f
WHERE EXISTS (SELECT 1 FROM oc WHERE oc.repo_id = f.repo_id AND oc.hash = f.commit_hash AND NOT oc.author_is_bot) GROUP BY f.repo_id""",
    "orders",
    "changes",
)
def effective_file_changes_semi(s, d):
    rows = effective_file_changes(a.file_changes(s, d), orders(s, d, include_bots=False))
    return rows.groupBy("repo_id").agg(F.count("*").alias("changes"), F.sum("insertions").alias("insertions"))


# ------------------------------------------------------------------------------------------------ activity
@query(f"SELECT activity_date AS date, {_MEASURES}, {_NAMES} FROM ec GROUP BY activity_date", "events")
def daily(s, d):
    return activity.daily(events(s, d)).withColumns(joined("repository_names"))


@query(
    f"""SELECT strftime(m, '%Y-%m') AS month, coalesce(commits, 0) AS commits, coalesce(authors, 0) AS authors, coalesce(repositories, 0) AS repositories,
  coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions, coalesce(repository_names, '') AS repository_names
FROM (SELECT unnest(generate_series(min(date_trunc('month', activity_date))::TIMESTAMP, max(date_trunc('month', activity_date))::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM oc)
LEFT JOIN (SELECT date_trunc('month', activity_date)::TIMESTAMP AS m, {_MEASURES}, {_NAMES} FROM oc GROUP BY 1) USING (m)""",
    "orders",
)
def monthly_dense(s, d):
    return activity.monthly(orders(s, d)).withColumns(joined("repository_names"))


@query(f"SELECT activity_year AS year, {_MEASURES}, {_NAMES} FROM oc GROUP BY activity_year", "orders")
def yearly(s, d):
    return activity.yearly(orders(s, d)).withColumns(joined("repository_names"))


_WEEK = "['Montag', 'Dienstag', 'Mittwoch', 'Donnerstag', 'Freitag', 'Samstag', 'Sonntag']"


@query(
    f"""SELECT w::INTEGER AS weekday, {_WEEK}[w + 1] AS label, h::INTEGER AS hour, coalesce(commits, 0) AS commits, coalesce(repository_names, '') AS repository_names
FROM range(7) a(w), range(24) b(h) LEFT JOIN (SELECT activity_weekday, activity_hour, count(*) AS commits, {_NAMES} FROM ec GROUP BY 1, 2) ON activity_weekday = w AND activity_hour = h""",
    "events",
)
def weekday_hour_matrix(s, d):
    return activity.week_matrix(events(s, d)).withColumns(joined("repository_names"))


@query(f"SELECT activity_weekday AS weekday, {_WEEK}[activity_weekday + 1] AS label, count(*) AS commits, {_NAMES} FROM ec GROUP BY 1, 2", "events")
def weekdays(s, d):
    return activity.weekdays(activity.week_matrix(events(s, d))).withColumns(joined("repository_names"))


@query(f"SELECT activity_hour AS hour, count(*) AS commits, {_NAMES} FROM ec GROUP BY 1", "events")
def hours(s, d):
    return activity.hours(activity.week_matrix(events(s, d))).withColumns(joined("repository_names"))


@query(
    f"""SELECT CASE WHEN activity_hour < 6 THEN 'Nacht' WHEN activity_hour < 12 THEN 'Vormittag' WHEN activity_hour < 18 THEN 'Nachmittag' ELSE 'Abend' END AS daypart,
  count(*) AS commits, {_NAMES} FROM ec GROUP BY 1""",
    "events",
)
def dayparts(s, d):
    return activity.dayparts(activity.week_matrix(events(s, d))).withColumns(joined("repository_names"))


@query(
    """SELECT round(count(*) FILTER (activity_weekday > 4) / count(*), 6) AS weekend_share,
  round(count(*) FILTER (activity_weekday > 4 OR activity_hour < 8 OR activity_hour >= 18) / count(*), 6) AS outside_work_time_share FROM ec""",
    "events",
)
def work_time_shares(s, d):
    return rounded(activity.work_time_shares(events(s, d)))


@query(
    f"""SELECT days::INTEGER AS days, current, previous, round(CASE WHEN previous > 0 THEN (current - previous) / previous WHEN current = 0 THEN 0 END, 6) AS delta,
  (DATE '{ORDERS_AS_OF}' - days::INTEGER + 1)::DATE AS start, DATE '{ORDERS_AS_OF}' AS "end"
FROM (SELECT days, count(*) FILTER (activity_date BETWEEN DATE '{ORDERS_AS_OF}' - days::INTEGER + 1 AND DATE '{ORDERS_AS_OF}') AS current,
  count(*) FILTER (activity_date BETWEEN DATE '{ORDERS_AS_OF}' - 2 * days::INTEGER + 1 AND DATE '{ORDERS_AS_OF}' - days::INTEGER) AS previous
  FROM oc, (VALUES (30), (90), (365)) v(days) GROUP BY days)""",
    "orders",
)
def recent_windows(s, d):
    return rounded(activity.recent_windows(orders(s, d), day(ORDERS_AS_OF)))


@query(
    f"""SELECT c::DATE AS date, coalesce(commits, 0) AS commits, coalesce(authors, 0) AS authors, coalesce(repositories, 0) AS repositories, coalesce(additions, 0) AS additions,
  coalesce(deletions, 0) AS deletions, coalesce(repository_names, '') AS repository_names
FROM (SELECT unnest(generate_series(TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 364 DAY, TIMESTAMP '{ORDERS_AS_OF}', INTERVAL 1 DAY))::DATE AS c)
LEFT JOIN (SELECT activity_date, {_MEASURES}, {_NAMES} FROM oc GROUP BY 1) ON activity_date = c""",
    "orders",
)
def calendar_365(s, d):
    return activity.calendar(orders(s, d), day(ORDERS_AS_OF)).withColumns(joined("repository_names"))


@query(f"SELECT activity_date AS date, {_MEASURES}, {_NAMES} FROM oc GROUP BY 1 ORDER BY commits DESC, date LIMIT 50", "orders")
def busiest_days(s, d):
    return activity.busiest_days(orders(s, d)).withColumns(joined("repository_names"))


@query(
    """SELECT count(*) AS active_days, round(avg(commits), 6) AS average_commits, round(median(commits), 6) AS median_commits FROM (SELECT activity_date, count(*) AS commits FROM oc GROUP BY 1)""",
    "orders",
)
def active_day_stats(s, d):
    return rounded(activity.active_day_stats(orders(s, d)))


_DAYS = "SELECT DISTINCT activity_date AS day FROM oc"


@query(
    f"""SELECT count(*)::INTEGER AS days, min(day) AS start, max(day) AS "end" FROM (SELECT day, day - row_number() OVER (ORDER BY day)::INTEGER AS run FROM ({_DAYS}))
GROUP BY run ORDER BY days DESC, start LIMIT 1""",
    "orders",
)
def longest_streak(s, d):
    return activity.longest_streak(orders(s, d))


@query(
    f"""SELECT (day - last - 1)::INTEGER AS days_without_commits, last AS start, day AS "end" FROM (SELECT day, lag(day) OVER (ORDER BY day) AS last FROM ({_DAYS}))
WHERE last IS NOT NULL ORDER BY 1 DESC, 2 LIMIT 1""",
    "orders",
)
def longest_gap(s, d):
    return activity.longest_gap(orders(s, d))


# ------------------------------------------------------------------------------------------------ people
_TOTALS = f"""SELECT author_key, max(author_name) AS name, max(author_email) AS email, bool_or(author_is_bot) AS is_bot, count(*) AS commits, count(DISTINCT repo_id) AS repositories,
  count(DISTINCT activity_date) AS active_days, sum(is_merge::INTEGER)::BIGINT AS merges, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions,
  sum(files_changed)::BIGINT AS files_changed, min(activity_at) AS first_commit, max(activity_at) AS last_commit, {_NAMES} FROM ec GROUP BY author_key"""


@query(f"SELECT *, round(commits / sum(commits) OVER (), 6) AS share, insertions + deletions AS churn FROM ({_TOTALS})", "events")
def contributors(s, d):
    return rounded(people.contributors(events(s, d))).withColumns(joined("repository_names"))


@query(
    """SELECT author_key, 'Autor ' || CASE WHEN k < 100 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS name, '' AS email
FROM (SELECT author_key, row_number() OVER (ORDER BY author_key) AS k FROM (SELECT DISTINCT author_key FROM ec))""",
    "events",
)
def anonymised_authors(s, d):
    return identities.anonymised(events(s, d))


_SPREAD = """SELECT {key} max(x) / max(total) AS top, min(CASE WHEN 100 * cum >= 50 * total THEN down END) AS bf50, min(CASE WHEN 100 * cum >= 80 * total THEN down END) AS bf80,
  2 * sum(up * x) / (count(*) * max(total)) - (count(*) + 1) / count(*) AS gini, sum((x / total) ** 2) AS hhi
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x) AS up, row_number() OVER (PARTITION BY g ORDER BY x DESC, author_key) AS down,
  sum(x) OVER (PARTITION BY g ORDER BY x DESC, author_key ROWS UNBOUNDED PRECEDING) AS cum, sum(x) OVER (PARTITION BY g) AS total
  FROM (SELECT {g} AS g, author_key, count(*) AS x FROM {rows} GROUP BY 1, 2)) {group}"""


@query(
    f"SELECT round(top, 6) AS top_author_share, bf50 AS bus_factor_50, bf80 AS bus_factor_80, round(gini, 6) AS gini, round(hhi, 6) AS hhi FROM ({_SPREAD.format(key='', g='1', rows='oc', group='')})",
    "orders",
)
def author_concentration(s, d):
    return rounded(people.author_concentration(orders(s, d)))


@query(
    f"""SELECT g AS repo_id, round(top, 6) AS top_share, bf50 AS bus_factor_50, bf80 AS bus_factor_80, round(gini, 6) AS gini, round(hhi, 6) AS hhi
FROM ({_SPREAD.format(key="g,", g="repo_id", rows="ec", group="GROUP BY g")})""",
    "events",
)
def repository_concentration(s, d):
    counts = events(s, d).groupBy("repo_id", "author_key").agg(F.count("*").alias("commits"))
    return rounded(concentration(counts, keys=["repo_id"]))


_RAW = "raw_commits c JOIN names USING (repo_id)"


@query(
    f"""SELECT 'name_multiple_emails' AS kind, name, vals AS values, commits FROM (SELECT lower(author_name_raw) AS k, max(author_name_raw) AS name,
  string_agg(DISTINCT lower(author_email_raw), ',' ORDER BY lower(author_email_raw)) AS vals, count(*) AS commits FROM {_RAW} WHERE trim(author_name_raw) <> ''
  GROUP BY 1 HAVING count(DISTINCT lower(author_email_raw)) > 1 ORDER BY commits DESC, k LIMIT 100)""",
    "events",
)
def identity_hints_names(s, d):
    return people.name_hints(a.event_commits(s, d), a.repositories(s, d)).withColumns(joined("values"))


@query(
    f"""SELECT 'email_multiple_names' AS kind, email, vals AS values, commits FROM (SELECT lower(author_email_raw) AS email,
  string_agg(DISTINCT author_name_raw, ',' ORDER BY author_name_raw) AS vals, count(*) AS commits FROM {_RAW} WHERE trim(author_email_raw) <> ''
  GROUP BY 1 HAVING count(DISTINCT author_name_raw) > 1 ORDER BY commits DESC, email LIMIT 100)""",
    "events",
)
def identity_hints_emails(s, d):
    return people.email_hints(a.event_commits(s, d), a.repositories(s, d)).withColumns(joined("values"))


@query(
    f"""SELECT t.repo_id, name AS top_author, author_key AS top_author_key, round(commits / total, 6) AS top_author_share, bf50 AS bus_factor_50 FROM (
  SELECT repo_id, author_key, max(author_name) AS name, count(*) AS commits, sum(count(*)) OVER (PARTITION BY repo_id) AS total,
    row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, author_key) AS k FROM ec GROUP BY 1, 2) t
JOIN ({_SPREAD.format(key="g,", g="repo_id", rows="ec", group="GROUP BY g")}) ON g = t.repo_id WHERE k = 1""",
    "events",
)
def repo_top_author(s, d):
    return rounded(people.top_authors(events(s, d)))


@query(f"SELECT count(*) AS new_authors FROM (SELECT author_key, min(activity_date) AS f FROM oc GROUP BY 1) WHERE f >= DATE '{ORDERS_AS_OF}' - 29", "orders")
def new_authors(s, d):
    return people.new_authors(orders(s, d), day(ORDERS_AS_OF))


@query(
    """SELECT author_key, max(author_name) AS author_name, max(author_email) AS author_email, bool_or(author_is_bot) AS is_bot, count(*) AS commits, count(DISTINCT repo_id) AS repositories,
  count(DISTINCT activity_date) AS active_days, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, min(activity_at) AS first_activity, max(activity_at) AS last_activity
FROM oc GROUP BY 1""",
    "orders",
)
def author_summary(s, d):
    return people.author_summary(a.order_commits(s, d), a.repositories(s, d))


_ALIASES = ({"name": "Team One", "email": "team@example.org", "match_emails": ["u1?@*", "u[3-4]@*"], "match_names": ["user 2*"]},)


@query(
    r"""SELECT user_id, name, email, substr(sha256(CASE WHEN email <> '' THEN email ELSE 'name:' || lower(name) END), 1, 24) AS key, regexp_matches(name || ' <' || email || '>', '(?i)user 7\d?\b') AS is_bot
FROM (SELECT user_id, CASE WHEN hit THEN 'Team One' WHEN n = '' THEN 'Unbekannt' ELSE n END AS name, CASE WHEN hit THEN 'team@example.org' ELSE e END AS email FROM (
  SELECT user_id, n, e, regexp_matches(e, '^u1.@') OR regexp_matches(e, '^u[3-4]@') OR starts_with(lower(n), 'user 2') AS hit FROM (
    SELECT DISTINCT user_id, CASE WHEN user_id % 11 = 0 THEN '' ELSE 'User ' || user_id END AS n, CASE WHEN user_id % 13 = 0 THEN '' ELSE 'u' || user_id || '@example.org' END AS e FROM events)))"""
)
def identity_resolution(s, d):
    user = F.col("user_id").cast("string")
    rows = a.read(s, d, "events").select("user_id").distinct()
    name = F.when(F.col("user_id") % 11 == 0, "  ").otherwise(F.concat(F.lit(" User "), user))
    email = F.when(F.col("user_id") % 13 == 0, "").otherwise(F.concat(F.lit("U"), user, F.lit("@Example.org ")))
    return rows.select("user_id", identities.resolved(name, email, _ALIASES, [r"(?i)user 7\d?\b"]).alias("i")).select("user_id", "i.*")


# ------------------------------------------------------------------------------------------------ repositories
_REPOS = f"""SELECT r.repo_id, display_name, r.status, coalesce(classification, 'private') AS classification, coalesce(commits, 0) AS commits, coalesce(authors, 0) AS authors,
  coalesce(active_days, 0) AS active_days, merges, coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions, files_changed, first_commit, last_commit,
  CASE WHEN commits IS NULL THEN 'empty' WHEN DATE '2024-04-27' - last_day >= 89 THEN 'dormant' WHEN DATE '2024-04-27' - last_day >= 88 THEN 'quiet' ELSE 'active' END AS activity_status,
  (DATE '2024-04-27' - last_day)::INTEGER AS days_since_last_commit
FROM repositories r LEFT JOIN privacy USING (repo_id) LEFT JOIN (
  SELECT repo_id, count(*) AS commits, count(DISTINCT author_key) AS authors, count(DISTINCT activity_date) AS active_days, sum(is_merge::INTEGER)::BIGINT AS merges,
    sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, sum(files_changed)::BIGINT AS files_changed, min(activity_at) AS first_commit,
    max(activity_at) AS last_commit, max(activity_date) AS last_day FROM ec GROUP BY 1) USING (repo_id) WHERE r.active"""
_REPO_COLUMNS = (
    "repo_id", "display_name", "status", "classification", "commits", "authors", "active_days", "merges", "insertions", "deletions", "files_changed", "first_commit", "last_commit",
    "activity_status", "days_since_last_commit",
)


def health(s: SparkSession, d: str) -> DataFrame:
    rows = repositories.repository_totals(a.repositories(s, d), events(s, d), a.privacy(s, d))
    return repositories.with_status(rows, day("2024-04-27"), quiet=88, dormant=89)


@query(_REPOS, "events")
def repository_matrix(s, d):
    return health(s, d).select(*_REPO_COLUMNS)


@query(f"SELECT activity_status, count(*) AS repositories FROM ({_REPOS}) GROUP BY 1", "events")
def status_counts(s, d):
    return repositories.status_counts(health(s, d))


_NESTED = """SELECT repo_id, arg_min(language, (-bytes, -files, language)) AS top_language,
  string_agg(concat_ws(':', language, files, bytes, code_lines, comment_lines), ',' ORDER BY bytes DESC, language) AS languages
FROM tree LEFT JOIN (SELECT repo_id, language, code_lines, comment_lines FROM comment_totals WHERE kind = 'all') USING (repo_id, language) GROUP BY repo_id"""


@query(_NESTED, "tree")
def repo_languages_nested(s, d):
    rows = repositories.nested_languages(a.tree(s, d), a.comment_totals(s, d))
    text = F.transform("languages", lambda x: F.concat_ws(":", x["language"], x["files"], x["bytes"], x["code_lines"], x["comment_lines"]))
    return rows.withColumn("languages", F.array_join(text, ","))


def whole_matrix(s: SparkSession, d: str) -> DataFrame:
    stats = (a.tree(s, d), a.comment_totals(s, d), a.privacy(s, d))
    return repositories.matrix(a.repositories(s, d), events(s, d), day("2024-04-27"), *stats, 88, 89, a.file_types(s, d), a.tree_signals(s, d), 90)


_MATRIX = f"""SELECT p.* EXCLUDE (merges, files_changed), coalesce(merges, 0) AS merges, insertions + deletions AS churn, top_author, round(top_author_share, 6) AS top_author_share,
  coalesce(bus_factor_50, 0) AS bus_factor_50, top_language, coalesce(languages, '') AS languages, coalesce(file_types, '') AS file_types, coalesce(ci_systems, '') AS ci_systems,
  coalesce(licenses, '') AS licenses, coalesce(code_lines, 0) AS code_lines, coalesce(comment_lines, 0) AS comment_lines, round(comment_lines / nullif(code_lines + comment_lines, 0), 6) AS comment_density,
  coalesce(tree_files, 0) AS tree_files, coalesce(tree_bytes, 0) AS tree_bytes,
  concat_ws(',', CASE WHEN is_shallow THEN 'shallow_history' END, CASE WHEN is_partial THEN 'partial_clone' END, CASE WHEN is_bare THEN 'bare_repository' END,
    CASE WHEN p.status = 'stale' THEN 'stale_snapshot' END, CASE WHEN p.status = 'error' THEN 'unreadable' END, CASE WHEN commits >= 90 THEN 'history_cut' END) AS warnings
FROM ({_REPOS}) p JOIN (SELECT repo_id, is_shallow, is_partial, is_bare FROM repositories) USING (repo_id) LEFT JOIN (
  SELECT repo_id, name AS top_author, commits / total AS top_author_share, bf50 AS bus_factor_50 FROM (
    SELECT repo_id, max(author_name) AS name, count(*) AS commits, sum(count(*)) OVER (PARTITION BY repo_id) AS total,
      row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, author_key) AS k FROM ec GROUP BY repo_id, author_key) t
  JOIN ({_SPREAD.format(key="g,", g="repo_id", rows="ec", group="GROUP BY g")}) ON g = t.repo_id WHERE k = 1) USING (repo_id) LEFT JOIN (
  SELECT repo_id, arg_min(language, (-bytes, -files, language)) AS top_language, sum(code_lines)::BIGINT AS code_lines, sum(comment_lines)::BIGINT AS comment_lines,
    sum(files)::BIGINT AS tree_files, sum(bytes)::BIGINT AS tree_bytes,
    string_agg(concat_ws(':', language, files, bytes, code_lines, comment_lines, blank_lines, kinds), ',' ORDER BY bytes DESC, language) AS languages
  FROM tree LEFT JOIN (
    SELECT repo_id, language, sum(code_lines)::BIGINT AS code_lines, (sum(comment_lines) FILTER (kind = 'all'))::BIGINT AS comment_lines, sum(blank_lines)::BIGINT AS blank_lines,
      string_agg(kind || '=' || comment_lines, '+' ORDER BY kind) FILTER (kind <> 'all') AS kinds FROM comment_totals GROUP BY 1, 2) USING (repo_id, language) GROUP BY repo_id) USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(concat_ws(':', file_type, files, bytes), ',' ORDER BY bytes DESC, file_type) AS file_types FROM file_types GROUP BY 1) USING (repo_id)
LEFT JOIN tree_signals USING (repo_id)"""


@query(_MATRIX, "events", "tree")
def matrix(s, d):
    """Survey item A16 whole; nested columns as text."""
    kinds = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), "+")
    counts = ("language", "files", "bytes", "code_lines", "comment_lines", "blank_lines")
    texts = {
        "languages": F.array_join(F.transform("languages", lambda x: F.concat_ws(":", *(x[c] for c in counts), kinds(x["comment_types"]))), ","),
        "file_types": F.array_join(F.transform("file_types", lambda x: F.concat_ws(":", x["file_type"], x["files"], x["bytes"])), ","),
        "merges": F.coalesce("merges", F.lit(0)),
    }
    more = ("churn", "top_author", "top_author_share", "bus_factor_50", "top_language", "languages", "file_types", "ci_systems", "licenses", "code_lines", "comment_lines", "comment_density")
    columns = [c for c in _REPO_COLUMNS if c != "files_changed"]
    return rounded(whole_matrix(s, d).withColumns(texts | joined("ci_systems", "licenses", "warnings")).select(*columns, *more, "tree_files", "tree_bytes", "warnings"))


_FILE_TYPE_LEFT = """repo_id IN (SELECT repo_id FROM repositories WHERE active) AND repo_id IN (SELECT repo_id FROM file_types WHERE file_type = (SELECT min(p_brand) FROM part))"""


def _with_file_type(s: SparkSession, d: str) -> DataFrame:
    wanted = a.read(s, d, "part").agg(F.min("p_brand")).first()[0]
    return explore.filter_repositories(whole_matrix(s, d), file_types=[wanted])


@query(
    f"SELECT file_type, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, count(DISTINCT repo_id) AS repositories FROM file_types WHERE {_FILE_TYPE_LEFT} GROUP BY 1", "tree"
)
def filtered_file_types(s, d):
    return explore.filtered_file_types(_with_file_type(s, d))


@query(f"SELECT kind, sum(comment_lines)::BIGINT AS lines FROM comment_totals WHERE kind <> 'all' AND {_FILE_TYPE_LEFT} GROUP BY 1", "tree")
def filtered_comment_kinds(s, d):
    return explore.merged_kinds(_with_file_type(s, d))


@query("SELECT repo_id, language, files, bytes FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, files DESC, language) AS k FROM tree) WHERE k = 1", "tree")
def top_language(s, d):
    return repositories.top_language(a.tree(s, d))


@query(
    """SELECT display_name AS repository, concat_ws(',', CASE WHEN is_shallow THEN 'shallow_history' END, CASE WHEN is_partial THEN 'partial_clone' END, CASE WHEN is_bare THEN 'bare_repository' END,
  CASE WHEN status = 'stale' THEN 'stale_snapshot' END, CASE WHEN status = 'error' THEN 'unreadable' END, CASE WHEN n >= 90 THEN 'history_cut' END) AS warnings
FROM repositories LEFT JOIN (SELECT repo_id, count(*) AS n FROM ec GROUP BY 1) USING (repo_id)
WHERE active AND (is_shallow OR is_partial OR is_bare OR status <> 'ready' OR coalesce(n, 0) >= 90)""",
    "events",
)
def repository_warnings(s, d):
    return repositories.warnings(repositories.repository_totals(a.repositories(s, d), events(s, d)), 90).withColumns(joined("warnings"))


@query(
    "SELECT repository, name, created_at, object_hash FROM tags JOIN names USING (repo_id) ORDER BY created_at DESC NULLS LAST, repository, name LIMIT 500", "tree"
)
def releases(s, d):
    return repositories.releases(a.tags(s, d), a.repositories(s, d))


@query(
    """SELECT count(*) AS tags, count(created_at) AS dated_tags, count(DISTINCT repo_id) AS repositories, min(created_at) AS first_release, max(created_at) AS last_release
FROM tags JOIN names USING (repo_id)""",
    "tree",
)
def release_summary(s, d):
    return repositories.release_summary(a.tags(s, d), a.repositories(s, d))


@query("SELECT timezone_offset_minutes AS offset_minutes, count(*) AS commits FROM ec GROUP BY 1", "events")
def timezone_offsets(s, d):
    return repositories.timezone_offsets(events(s, d))


_PUBLIC = "names JOIN privacy USING (repo_id) WHERE classification = 'public'"


@query(
    f"SELECT language, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM tree WHERE repo_id IN (SELECT repo_id FROM {_PUBLIC}) GROUP BY 1 ORDER BY bytes DESC, files DESC, language LIMIT 12",
    "tree",
)
def profile_public_languages(s, d):
    return repositories.profile_languages(a.tree(s, d), repositories.public_repositories(a.repositories(s, d), a.privacy(s, d)))


@query("SELECT repo_id, CASE WHEN n_name LIKE 'NATION_1%' THEN 'public' WHEN regexp_matches(n_name, '^[A-I].*') THEN 'exclude' ELSE 'private' END AS classification, n_name AS name FROM (SELECT n_nationkey::BIGINT AS repo_id, n_name FROM nation)")
def privacy_rules(s, d):
    rules = [("NATION_1*", "public"), ("[A-I]*", "exclude"), ("NATION_1?", "private")]
    return a.repositories(s, d).select("repo_id", first_match([F.col("display_name"), F.lit("none")], rules, "private").alias("classification"), F.col("display_name").alias("name"))


# ------------------------------------------------------------------------------------------------ code
@query(
    f"""SELECT message_type AS type, CASE message_type WHEN 'docs' THEN 'Dokumentation' WHEN 'feat' THEN 'Features' WHEN 'release' THEN 'Releases' WHEN 'init' THEN 'Initialisierung'
  WHEN 'fix' THEN 'Fixes' ELSE 'Sonstige' END AS label, count(*) AS commits, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions,
  count(DISTINCT author_key) AS authors, round(count(*) / sum(count(*)) OVER (), 6) AS share, {_NAMES} FROM ec GROUP BY 1""",
    "events",
)
def commit_types(s, d):
    return rounded(code.commit_types(events(s, d))).withColumns(joined("repository_names"))


@query(
    f"""SELECT place::INTEGER AS place, bucket, coalesce(commits, 0) AS commits, coalesce(repository_names, '') AS repository_names
FROM (VALUES (0, '0'), (1, '1–10'), (2, '11–50'), (3, '51–200'), (4, '201–1.000'), (5, '>1.000'), (6, 'Unbekannt')) b(place, bucket) LEFT JOIN (
  SELECT CASE WHEN NOT stats_collected THEN 'Unbekannt' WHEN n = 0 THEN '0' WHEN n <= 10 THEN '1–10' WHEN n <= 50 THEN '11–50' WHEN n <= 200 THEN '51–200' WHEN n <= 1000 THEN '201–1.000' ELSE '>1.000' END AS bucket,
  count(*) AS commits, {_NAMES} FROM (SELECT *, insertions + deletions AS n FROM ec WHERE NOT is_merge) GROUP BY 1) USING (bucket)""",
    "events",
)
def commit_sizes_dense(s, d):
    return code.commit_sizes(events(s, d)).withColumns(joined("repository_names"))


@query(
    """SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS maximum
FROM (SELECT insertions + deletions AS n FROM ec WHERE NOT is_merge AND stats_collected)""",
    "events",
)
def churn_percentiles(s, d):
    return rounded(code.churn_distribution(events(s, d)))


@query(
    """SELECT round(count(*) FILTER (message_type <> 'other') / count(*), 6) AS typed_commit_share, round(count(*) FILTER (has_issue_reference) / count(*), 6) AS issue_reference_share,
  count(*) FILTER (is_breaking) AS breaking_changes, round(count(*) FILTER (stats_collected) / count(*), 6) AS stats_known_share FROM ec""",
    "events",
)
def code_ratios(s, d):
    return rounded(code.code_ratios(events(s, d)))


@query(
    f"SELECT language, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, count(DISTINCT repo_id) AS repositories, {_NAMES} FROM tree JOIN names USING (repo_id) GROUP BY 1", "tree"
)
def tree_languages(s, d):
    return code.tree_languages(a.tree(s, d), a.repositories(s, d)).withColumns(joined("repository_names"))


_CHURN = """count(*) AS touches, sum(coalesce(insertions, 0))::BIGINT AS insertions, sum(coalesce(deletions, 0))::BIGINT AS deletions,
  sum(coalesce(insertions, 0) + coalesce(deletions, 0))::BIGINT AS churn"""


@query(
    f"SELECT language, {_CHURN}, count(DISTINCT repo_id) AS repositories, sum(is_binary::INTEGER)::BIGINT AS binary_changes, {_NAMES} FROM fc GROUP BY 1", "orders", "changes"
)
def churn_languages(s, d):
    return code.churn_languages(touched(s, d)).withColumns(joined("repository_names"))


@query(
    f"""SELECT language, sum(files)::BIGINT AS files, sum(code_lines)::BIGINT AS code_lines, sum(comment_lines)::BIGINT AS comment_lines, sum(blank_lines)::BIGINT AS blank_lines,
  count(DISTINCT repo_id) AS repositories, {_NAMES}, round(sum(comment_lines) / sum(comment_lines + code_lines), 6) AS comment_density
FROM comment_totals JOIN names USING (repo_id) WHERE kind = 'all' GROUP BY 1""",
    "tree",
)
def comment_languages(s, d):
    return rounded(code.comment_languages(a.comment_totals(s, d), a.repositories(s, d))).withColumns(joined("repository_names"))


@query(f"SELECT kind, sum(comment_lines)::BIGINT AS lines, {_NAMES} FROM comment_totals JOIN names USING (repo_id) WHERE kind <> 'all' GROUP BY 1", "tree")
def comment_kinds(s, d):
    return code.comment_kinds(a.comment_totals(s, d), a.repositories(s, d)).withColumns(joined("repository_names"))


@query(
    f"""SELECT repo_id, repository, path, min(language) AS language, {_CHURN}, count(DISTINCT author_key) AS authors, max(activity_at) AS last_change FROM fc
GROUP BY 1, 2, 3 ORDER BY touches DESC, churn DESC, repository, repo_id, path LIMIT 500""",
    "orders",
    "changes",
)
def hot_files(s, d):
    return code.hot_files(touched(s, d))


@query(f"SELECT top_directory, {_CHURN}, count(DISTINCT repo_id) AS repositories, {_NAMES} FROM fc GROUP BY 1 ORDER BY touches DESC, churn DESC, top_directory LIMIT 500", "orders", "changes")
def top_directories(s, d):
    return code.top_directories(touched(s, d)).withColumns(joined("repository_names"))


@query(f"SELECT message_scope AS scope, count(*) AS commits, {_NAMES} FROM ec WHERE trim(message_scope) <> '' GROUP BY 1 ORDER BY commits DESC, scope LIMIT 100", "events")
def top_scopes(s, d):
    return code.top_scopes(events(s, d)).withColumns(joined("repository_names"))


@query(
    "SELECT repository, hash, activity_at, subject, author_name, message_type FROM ec WHERE trim(subject) <> '' ORDER BY activity_at DESC, hash DESC, repository LIMIT 500", "events"
)
def recent_subjects(s, d):
    return code.recent_subjects(events(s, d))


@query(
    r"""SELECT hash, CASE WHEN parent_count > 1 OR starts_with(lower(subject), 'merge ') THEN 'merge' WHEN starts_with(trim(lower(subject)), 'revert') THEN 'revert'
    WHEN regexp_matches(trim(subject), '^[A-Za-z][A-Za-z0-9_-]*(\([^)]+\))?!?:\s+') THEN lower(regexp_extract(trim(subject), '^([A-Za-z][A-Za-z0-9_-]*)', 1)) ELSE 'other' END AS type,
  CASE WHEN parent_count = 1 AND regexp_matches(trim(subject), '^[A-Za-z][A-Za-z0-9_-]*\([^)]+\)!?:\s+') THEN regexp_extract(trim(subject), '\(([^)]+)\)', 1) END AS scope,
  parent_count = 1 AND regexp_matches(trim(subject), '^[A-Za-z][A-Za-z0-9_-]*(\([^)]+\))?!:\s+') AS breaking,
  regexp_matches(subject, '(#\d+\b|\b[A-Z][A-Z0-9]+-\d+\b)') AS issue FROM ec""",
    "events",
)
def subject_classification(s, d):
    made = subjects.classified(F.col("subject"), F.col("parent_count"))
    return events(s, d).select("hash", made.alias("c"), subjects.mentions_issue(F.col("subject")).alias("issue")).select("hash", "c.*", "issue")


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: Ends of made file names: every suffix that is known, as it is and in capitals, and some that mean nothing.
_ENDS = [*paths.SUFFIXES, *(x.upper() for x in paths.SUFFIXES), "", ".", ".tar.gz", ".D.ts", ".x.d.ts", "..py", ".unknown"]
_FULL_NAMES = [*paths.SPECIAL_FILES, *(x.title() for x in paths.SPECIAL_FILES), ".gitignore", ".env.toml", "..", "...py", ".py"]
_PATH_SQL = f"""made AS (SELECT p_partkey, lower(replace(p_type, ' ', '/')) AS folder, replace(p_name, ' ', '_') || ({_quoted(_ENDS)})[p_partkey % {len(_ENDS)} + 1] AS own,
  ({_quoted(_FULL_NAMES)})[p_size % {len(_FULL_NAMES)} + 1] AS fixed FROM part),
named AS (SELECT p_partkey, folder, CASE p_partkey % 3 WHEN 0 THEN fixed WHEN 1 THEN '.' || own ELSE own END AS name FROM made),
whole AS (SELECT CASE p_partkey % 5 WHEN 0 THEN folder || '/' || name WHEN 1 THEN '/' || folder || '//' || name WHEN 2 THEN replace(folder, '/', '\\') || '\\' || name WHEN 3 THEN './' || folder || '/./' || name ELSE name END AS path FROM named)"""


@query(
    f"""WITH {_PATH_SQL}, cut AS (SELECT list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.') AS own, starts_with(replace(path, '\\', '/'), '/') AS rooted FROM whole),
parts AS (SELECT CASE WHEN rooted THEN list_prepend('/', own) ELSE own END AS p FROM cut),
ends AS (SELECT p, lower(coalesce(nullif(p[-1], '/'), '')) AS name FROM parts),
found AS (SELECT p, name, regexp_extract(regexp_replace(name, '^\\.+', ''), '^.+(\\.[^.]+)$', 1) AS suffix FROM ends),
special(name, language) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in paths.SPECIAL_FILES.items())}),
known(suffix, language) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in paths.SUFFIXES.items())})
SELECT CASE WHEN s.language IS NOT NULL THEN s.language WHEN ends_with(f.name, '.d.ts') THEN 'TypeScript' ELSE coalesce(k.language, 'Other') END AS language,
  CASE WHEN s.language IS NOT NULL THEN f.name WHEN ends_with(f.name, '.d.ts') THEN '.d.ts' WHEN f.suffix <> '' THEN f.suffix ELSE '[ohne Endung]' END AS file_type,
  CASE WHEN len(p) > 1 THEN p[1] ELSE '[root]' END AS top_directory, count(*) AS files FROM found f LEFT JOIN special s USING (name) LEFT JOIN known k ON k.suffix = f.suffix GROUP BY 1, 2, 3"""
)
def path_classification(s, d):
    """Paths made from the names and types of parts, against the rules in SQL; only the lists of names and suffixes are shared."""
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    folder = F.lower(F.replace("p_type", F.lit(" "), F.lit("/")))
    own = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), pick(_ENDS, k))
    name = F.when(k % 3 == 0, pick(_FULL_NAMES, F.col("p_size"))).when(k % 3 == 1, F.concat(F.lit("."), own)).otherwise(own)
    back = F.replace(folder, F.lit("/"), F.lit("\\"))
    path = F.when(k % 5 == 0, F.concat(folder, F.lit("/"), name)).when(k % 5 == 1, F.concat(F.lit("/"), folder, F.lit("//"), name)).when(k % 5 == 2, F.concat(back, F.lit("\\"), name))
    rows = a.read(s, d, "part").select(path.when(k % 5 == 3, F.concat(F.lit("./"), folder, F.lit("/./"), name)).otherwise(name).alias("path"))
    each = rows.select(paths.language(F.col("path")).alias("language"), paths.file_type(F.col("path")).alias("file_type"), paths.top_directory(F.col("path")).alias("top_directory"))
    return each.groupBy("language", "file_type", "top_directory").agg(F.count("*").alias("files"))


@query(
    """SELECT coalesce(license, '(none)') AS license, count(*) AS documents FROM (SELECT CASE WHEN contains(t, 'MIT LICENSE') THEN 'MIT' WHEN contains(t, 'APACHE LICENSE') OR contains(t, 'APACHE SOFTWARE FOUNDATION') THEN 'Apache-2.0'
  WHEN contains(t, 'GNU GENERAL PUBLIC LICENSE') THEN 'GPL' WHEN contains(t, 'BSD 3-CLAUSE') OR contains(t, 'BSD 2-CLAUSE') THEN 'BSD' WHEN contains(t, 'MOZILLA PUBLIC LICENSE') THEN 'MPL'
  WHEN contains(t, 'CREATIVE COMMONS') THEN 'Creative Commons' END AS license FROM (SELECT upper(text) AS t FROM documents)) GROUP BY 1"""
)
def license_signals(s, d):
    rows = a.read(s, d, "documents").select(F.coalesce(signals.license_name(F.col("text"), head=None), F.lit("(none)")).alias("license"))
    return rows.groupBy("license").agg(F.count("*").alias("documents"))


@query(
    r"""SELECT lower(CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '://([^/:?#]+)', 1) WHEN page_id % 5 = 1 THEN 'local' ELSE regexp_extract(url, '://([^/:?#]+)', 1) END) AS host, count(*) AS pages FROM pages GROUP BY 1"""
)
def remote_hosts(s, d):
    url, k = F.col("url"), F.col("page_id") % 5
    made = F.when(k == 0, F.concat(F.lit("git@"), F.regexp_extract(url, "://([^/:?#]+)", 1), F.lit(":team/x.git"))).when(k == 1, F.lit("/srv/git/x")).otherwise(url)
    rows = a.read(s, d, "pages").select(signals.remote_host(made).alias("host"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"))


_CI_FOLDERS = [".github/workflows/", ".github/workflows/sub/", ".github/", "", "x/", ".circleci/", "X/.github/workflows/"]
_CI_NAMES = [*signals.CI_PATHS, *(x.upper() for x in signals.CI_PATHS), "jenkinsfile", "config.yml", "a.yml", "b.yaml", "c.YML", "d.txt", "e.yml.bak"]


@query(
    f"""SELECT path, coalesce(CASE WHEN starts_with(path, '.github/workflows/') AND (ends_with(path, '.yml') OR ends_with(path, '.yaml')) THEN 'GitHub Actions' ELSE system END, '(none)') AS system, count(*) AS files
  FROM (SELECT ({_quoted(_CI_FOLDERS)})[p_size % {len(_CI_FOLDERS)} + 1] || ({_quoted(_CI_NAMES)})[p_partkey % {len(_CI_NAMES)} + 1] AS path FROM part)
  LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in signals.CI_PATHS.items())}) v(known, system) ON path = known GROUP BY 1, 2"""
)
def ci_signals(s, d):
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    rows = a.read(s, d, "part").select(F.concat(pick(_CI_FOLDERS, F.col("p_size")), pick(_CI_NAMES, F.col("p_partkey"))).alias("path"))
    return rows.select("path", F.coalesce(signals.ci_system(F.col("path")), F.lit("(none)")).alias("system")).groupBy("path", "system").agg(F.count("*").alias("files"))


@query(
    r"""SELECT doc_id, lang, len(list_filter(l, lambda x: regexp_matches(x, '^[\s]*$')))::BIGINT AS blank, len(list_filter(l, lambda x: NOT regexp_matches(x, '^[\s]*$')))::BIGINT AS code FROM (
  SELECT doc_id, lang, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l FROM (SELECT doc_id, lang, string_split_regex(coalesce(text, ''), '\r\n|[\n\r]') AS p FROM documents))"""
)
def plain_line_counts(s, d):
    rows = a.read(s, d, "documents").select("doc_id", "lang", line_counts(F.col("text"), F.lit("Text")).alias("n"))
    return rows.select("doc_id", "lang", "n.blank", "n.code")


@query()
def comment_state_machine(s, d):
    """Comment statistics of pages as HTML and documents as a mix of languages; tested against a plain loop."""
    chosen = F.element_at(F.array(*map(F.lit, ("Python", "JavaScript", "SQL", "Markdown"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = a.read(s, d, "documents").select((F.col("doc_id") % 10).alias("repo_id"), chosen.alias("language"), "text")
    pages = a.read(s, d, "pages").select((F.col("page_id") % 10).alias("repo_id"), F.lit("HTML").alias("language"), F.col("html").alias("text"))
    return code.comment_stats(docs.unionByName(pages))


# ------------------------------------------------------------------------------------------------ whole portfolio
_ACTIVE = "SELECT repo_id FROM repositories WHERE active"
_EC_DAYS = "SELECT DISTINCT activity_date AS day FROM ec"
_EC_RUNS = f"""SELECT count(*)::INTEGER AS days, min(day) AS start, max(day) AS "end" FROM (SELECT day, day - row_number() OVER (ORDER BY day)::INTEGER AS run FROM ({_EC_DAYS}))
    GROUP BY run ORDER BY days DESC, start LIMIT 1"""
_LINES = f"(SELECT {{}} FROM comment_totals WHERE kind = 'all' AND repo_id IN ({_ACTIVE}))"


def _share(condition: str, digits: int = 6) -> str:
    return f"round((SELECT count(*) FILTER ({condition}) / count(*) FROM ec), {digits})"


_STATUSES = ", ".join(f"(SELECT count(*) FROM ({_REPOS.replace('>= 89', '>= 365').replace('>= 88', '>= 90').replace('2024-04-27', EVENTS_AS_OF)}) WHERE activity_status = '{x}') AS {x}_repositories" for x in ("active", "quiet", "dormant"))


@query(
    f"""SELECT (SELECT count(*) FROM ec) AS commits, (SELECT sum(is_merge::INTEGER)::BIGINT FROM ec) AS merge_commits, (SELECT count(DISTINCT author_key) FROM ec) AS authors,
  (SELECT count(DISTINCT committer_key) FROM ec) AS committers, (SELECT sum(author_is_bot::INTEGER)::BIGINT FROM ec) AS bot_commits_raw, (SELECT count(DISTINCT activity_date) FROM ec) AS active_days,
  (SELECT max(activity_at) FROM ec) AS last_commit, (SELECT sum(insertions + deletions)::BIGINT FROM ec) AS churn, (SELECT count(*) FROM repositories WHERE active) AS repositories,
  (SELECT count(*) FROM repositories WHERE active AND repo_id NOT IN (SELECT repo_id FROM ec)) AS empty_repositories,
  (SELECT count(*) FROM repositories WHERE active AND status IN ('stale', 'error')) AS failed_repositories, (SELECT count(*) FROM repositories WHERE active AND is_shallow) AS shallow_repositories,
  (SELECT count(*) FROM (SELECT min(activity_date) AS f FROM ec GROUP BY author_key) WHERE f >= DATE '{EVENTS_AS_OF}' - 29) AS new_authors_last_30_days,
  (SELECT count(*) FROM tags JOIN names USING (repo_id)) AS tags, round((SELECT count(*) FILTER (activity_weekday > 4) / count(*) FROM ec), 6) AS weekend_share,
  (SELECT count(*) FILTER (is_breaking) FROM ec) AS breaking_changes,
  (SELECT count(DISTINCT repo_id) FROM ec JOIN repositories USING (repo_id) WHERE active) AS repositories_with_commits, {_STATUSES},
  (SELECT count(*) FILTER (NOT is_merge) FROM ec) AS non_merge_commits, {_share("is_merge")} AS merge_share, (SELECT count(*) FILTER (author_is_bot) FROM ec) AS bot_commits_in_effective_set,
  (SELECT min(activity_at) FROM ec) AS first_commit, (SELECT DATE '{EVENTS_AS_OF}' - max(activity_date) FROM ec)::INTEGER AS days_since_last_commit,
  (SELECT sum(insertions)::BIGINT FROM ec) AS additions, (SELECT sum(deletions)::BIGINT FROM ec) AS deletions, (SELECT sum(files_changed)::BIGINT FROM ec) AS files_changed,
  (SELECT sum(binary_files)::BIGINT FROM ec) AS binary_files, (SELECT sum(files)::BIGINT FROM tree WHERE repo_id IN ({_ACTIVE})) AS tree_files,
  (SELECT sum(bytes)::BIGINT FROM tree WHERE repo_id IN ({_ACTIVE})) AS tree_bytes, {_LINES.format("sum(code_lines)::BIGINT")} AS code_lines,
  {_LINES.format("sum(comment_lines)::BIGINT")} AS comment_lines, {_LINES.format("round(sum(comment_lines) / sum(code_lines + comment_lines), 6)")} AS comment_density,
  (SELECT sum(local_branches)::BIGINT FROM repositories WHERE active) AS local_branches, (SELECT sum(remote_branches)::BIGINT FROM repositories WHERE active) AS remote_branches,
  (SELECT count(*) FROM tree_signals WHERE ci_systems <> '' AND repo_id IN ({_ACTIVE})) AS repositories_with_ci,
  round((SELECT count(*) FILTER (ci_systems <> '') / count(*) FROM ({_ACTIVE}) LEFT JOIN tree_signals USING (repo_id)), 6) AS ci_coverage,
  (SELECT count(*) FROM tree_signals WHERE licenses <> '' AND repo_id IN ({_ACTIVE})) AS repositories_with_license,
  round((SELECT count(*) FILTER (licenses <> '') / count(*) FROM ({_ACTIVE}) LEFT JOIN tree_signals USING (repo_id)), 6) AS license_coverage,
  (SELECT count(*) FROM repositories WHERE active AND is_partial) AS partial_repositories, (SELECT days FROM ({_EC_RUNS})) AS longest_streak_days,
  (SELECT start FROM ({_EC_RUNS})) AS longest_streak_start, (SELECT "end" FROM ({_EC_RUNS})) AS longest_streak_end,
  (SELECT coalesce(max(day - last - 1), 0)::INTEGER FROM (SELECT day, lag(day) OVER (ORDER BY day) AS last FROM ({_EC_DAYS}))) AS longest_gap_days,
  round((SELECT count(*) / count(DISTINCT activity_date) FROM ec), 6) AS average_commits_per_active_day, {_share("activity_weekday > 4 OR activity_hour < 8 OR activity_hour >= 18")} AS outside_work_time_share,
  round(top, 6) AS top_author_share, bf50 AS bus_factor_50, bf80 AS bus_factor_80, round(gini, 6) AS author_gini, round(hhi, 6) AS author_hhi,
  {_share("message_type <> 'other'")} AS typed_commit_share, {_share("has_issue_reference")} AS issue_reference_share,
  round((SELECT count(DISTINCT repo_id) FILTER (activity_status = 'active') / count(*) FROM ({_REPOS.replace('>= 89', '>= 365').replace('>= 88', '>= 90').replace('2024-04-27', EVENTS_AS_OF)})), 6) AS active_repository_share
FROM ({_SPREAD.format(key="", g="1", rows="ec", group="")})""",
    "events",
    "tree",
)
def summary(s, d):
    return rounded(_summary(s, d))


def tables(s: SparkSession, d: str) -> report.Tables:
    return report.Tables(a.repositories(s, d), a.event_commits(s, d), a.file_changes(s, d), a.tags(s, d), a.tree(s, d), a.comment_totals(s, d), a.privacy(s, d), None, None, a.file_types(s, d), a.tree_signals(s, d))


def _summary(s: SparkSession, d: str) -> DataFrame:
    work = {"working_days": [0, 1, 2, 3, 4], "start_hour": 8, "end_hour": 18}
    return report.summary(tables(s, d), events(s, d), day(EVENTS_AS_OF), work, 90, 365)


@query(
    f"""SELECT (SELECT {_WEEK}[activity_weekday + 1] FROM ec GROUP BY activity_weekday ORDER BY count(*) DESC, activity_weekday LIMIT 1) AS top_weekday,
  (SELECT activity_hour FROM ec GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_hour, (SELECT strftime(activity_date, '%Y-%m') FROM ec GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_month,
  (SELECT activity_date FROM ec GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS busiest_day,
  (SELECT max(author_name) FROM ec GROUP BY author_key ORDER BY count(*) DESC, lower(max(author_name)), author_key LIMIT 1) AS top_author,
  (SELECT repository FROM ec GROUP BY 1, repo_id ORDER BY count(*) DESC, lower(repository), repo_id LIMIT 1) AS top_repository,
  (SELECT language FROM tree JOIN names USING (repo_id) GROUP BY 1 ORDER BY sum(bytes) DESC, sum(files) DESC, language LIMIT 1) AS top_tree_language""",
    "events",
    "tree",
)
def insights(s, d):
    return report.insights(events(s, d), tables(s, d))


@query(
    """SELECT * FROM (VALUES ('failed_repositories', (SELECT count(*) FROM repositories WHERE active AND status IN ('stale', 'error')), 1::BIGINT), ('commits', (SELECT count(*) FROM ec), 1000000000::BIGINT),
  ('nothing', NULL, 5::BIGINT)) v(metric, value, "limit"), LATERAL (SELECT CASE WHEN value IS NULL THEN 'unavailable' WHEN value <= "limit" THEN 'passed' ELSE 'failed' END AS status)""",
    "events",
)
def check_limits(s, d):
    return checks.check(_summary(s, d), {"failed_repositories": 1, "commits": 1_000_000_000, "nothing": 5})


# ------------------------------------------------------------------------------------------------ network
_MEMBERS = """m AS (SELECT author_key, repo_id, repository, max(author_name) AS author_name, max(author_email) AS author_email, bool_or(author_is_bot) AS is_bot, count(*) AS commits,
  min(activity_date) AS first_date, max(activity_date) AS last_date FROM ec WHERE is_trusted GROUP BY 1, 2, 3),
kept AS (SELECT * FROM m WHERE commits >= 3 AND NOT is_bot AND NOT regexp_matches(author_name || ' <' || author_email || '>', '(?i)user 1\\d\\b'))"""


def _members(s: SparkSession, d: str) -> network.Memberships:
    return network.memberships(events(s, d), minimum=3, ignored=IGNORED)


def _with_members(sql: str) -> str:
    return a.with_tables("", "events").rstrip() + ", " + _MEMBERS + "\n" + sql


@query(_with_members("SELECT * FROM kept"))
def network_memberships(s, d):
    return _members(s, d).rows


@query(
    _with_members(
        """SELECT x.author_key, y.author_key AS co_author_key, tx.name AS author, ty.name AS co_author, x.repository, (tx.total + ty.total)::BIGINT AS commits
FROM kept x JOIN kept y ON x.repo_id = y.repo_id AND x.author_key < y.author_key AND y.first_date <= x.last_date + 5 AND x.first_date <= y.last_date + 5
JOIN (SELECT author_key, sum(commits) AS total, max(author_name) AS name FROM kept GROUP BY 1) tx ON tx.author_key = x.author_key
JOIN (SELECT author_key, sum(commits) AS total, max(author_name) AS name FROM kept GROUP BY 1) ty ON ty.author_key = y.author_key
ORDER BY commits DESC, lower(author), lower(co_author), x.author_key, co_author_key, repository LIMIT 500"""
    )
)
def network_direct_pairs(s, d):
    return network.direct_pairs(_members(s, d).rows, gap=5)


def _searched(members: str, start: str, gap: int, levels: int = 5) -> str:
    """The search level by level: ``l0`` and so on are the levels in line, ``reached`` all of them. The test tables need two levels; the last one here must be empty."""
    parts = [f"l0 AS MATERIALIZED (SELECT author_key, row_number() OVER (ORDER BY author_key) AS place, 0 AS distance, NULL::VARCHAR AS parent, NULL::VARCHAR AS via FROM ({start}) GROUP BY author_key)"]
    for k in range(levels):
        entered = " UNION ALL ".join(f"SELECT repo_id FROM c{i}" for i in range(k)) or "SELECT NULL::BIGINT WHERE false"
        known = " UNION ALL ".join(f"SELECT author_key FROM l{i}" for i in range(k + 1))
        parts.append(
            f"""c{k} AS MATERIALIZED (SELECT m.repo_id, m.repository, l.author_key, l.place, m.first_date, m.last_date FROM l{k} l JOIN {members} m USING (author_key)
  WHERE m.repo_id NOT IN ({entered}) QUALIFY row_number() OVER (PARTITION BY m.repo_id ORDER BY l.place, m.repository) = 1),
n{k} AS (SELECT m.author_key, c.place, c.repository AS via, c.repo_id, c.author_key AS parent FROM c{k} c JOIN {members} m USING (repo_id)
  WHERE m.first_date <= c.last_date + {gap} AND c.first_date <= m.last_date + {gap} AND m.author_key NOT IN ({known})
  QUALIFY row_number() OVER (PARTITION BY m.author_key ORDER BY c.place, c.repository, c.repo_id) = 1),
l{k + 1} AS MATERIALIZED (SELECT author_key, row_number() OVER (ORDER BY place, via, repo_id, author_key) AS place, {k + 1} AS distance, parent, via FROM n{k})"""
        )
    return ", ".join([*parts, "reached AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(levels + 1)) + ")"])


_LASTING = """om AS (SELECT author_key, repo_id, repository, max(author_name) AS author_name, count(*) AS commits, min(activity_date) AS first_date, max(activity_date) AS last_date FROM oc GROUP BY 1, 2, 3),
lasting AS (SELECT * FROM om WHERE commits >= 2)"""


@query(
    a.with_tables("", "orders").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    + ", "
    + _LASTING
    + ", "
    + _searched("lasting", "SELECT author_key FROM lasting ORDER BY commits DESC, author_key, repo_id LIMIT 1", 30)
    + """, ways AS (SELECT author_key, distance, []::VARCHAR[] AS names FROM reached WHERE distance = 0
  UNION ALL SELECT r.author_key, r.distance, list_append(w.names, r.via) FROM reached r JOIN ways w ON w.author_key = r.parent AND r.distance = w.distance + 1),
totals AS (SELECT author_key, max(author_name) AS author, sum(commits)::BIGINT AS commits, count(DISTINCT repo_id) AS repositories FROM lasting GROUP BY 1)
SELECT author_key, author, commits, repositories, distance::INTEGER AS distance, array_to_string(list_sort(list_distinct(coalesce(names, []))), ',') AS repository_names
FROM totals LEFT JOIN ways USING (author_key) ORDER BY distance NULLS LAST, commits DESC, lower(author), author_key LIMIT 500"""
)
def network_distances(s, d):
    """Distances from one reference author over long-lived memberships."""
    members = network.memberships(orders(s, d), minimum=2, trusted_only=False, exclude_service=False).rows
    start = members.orderBy(F.desc("commits"), "author_key", "repo_id").limit(1).select("author_key")
    reached = network.distances(members, start, gap=30)
    return network.author_rows(members, reached).select("author_key", "author", "commits", "repositories", "distance", F.array_join("repository_names", ",").alias("repository_names"))


def _reach(gap: int) -> str:
    start = "SELECT author_key FROM ec GROUP BY author_key HAVING lower(max(author_name)) = 'user 77'"
    return _with_members(
        _searched("kept", start, gap)
        + """ SELECT (SELECT count(DISTINCT author_key) FROM kept) AS authors, (SELECT count(*) FROM m) - (SELECT count(*) FROM kept) AS excluded_memberships,
  (SELECT count(*) FROM reached) AS connected_authors, (SELECT max(distance) FROM reached)::INTEGER AS max_distance, (SELECT count(DISTINCT author_key) FROM kept) > 20 AS truncated"""
    ).replace(_MEMBERS + "\n", _MEMBERS + ",\n", 1)


def _reached(s: SparkSession, d: str, gap: int) -> DataFrame:
    members = _members(s, d)
    return network.stats(members, network.distances(members.rows, network.references(events(s, d), ["user 77"]), gap=gap), limit=20)


@query(_reach(1))
def network_stats(s, d):
    return _reached(s, d, 1)


@query(_reach(5))
def network_reach_stats(s, d):
    """Survey item G7 whole: authors connected with the reference authors by the search, and its greatest distance."""
    return _reached(s, d, 5)


# ------------------------------------------------------------------------------------------------ exploration and SQL
_NESTED_HEALTH = f"""h AS ({_REPOS}), n AS (SELECT repo_id, language, files, bytes FROM tree)"""


def _explored(s: SparkSession, d: str) -> DataFrame:
    rows = health(s, d).join(repositories.nested_languages(a.tree(s, d)), "repo_id")
    wanted = a.read(s, d, "part").agg(F.min("p_type")).first()[0]
    return explore.filter_repositories(rows, languages=[wanted], within_days=100, as_of=day("2024-04-27"), branch="main")


_LEFT = f"""WITH {a.REPOSITORIES}, {a.EVENTS}, {a.TREE}, {_NESTED_HEALTH}, kept AS (
  SELECT h.* FROM h JOIN repositories r USING (repo_id) WHERE days_since_last_commit <= 100 AND (r.head_branch = 'main' OR r.default_branch = 'main')
  AND repo_id IN (SELECT repo_id FROM n WHERE language = (SELECT min(p_type) FROM part)))
"""


@query(
    _LEFT
    + """SELECT count(*) AS repositories, count(*) FILTER (commits > 0) AS repositories_with_commits, count(*) FILTER (activity_status = 'active') AS active_repositories,
  count(*) FILTER (activity_status = 'quiet') AS quiet_repositories, count(*) FILTER (activity_status = 'dormant') AS dormant_repositories, count(*) FILTER (activity_status = 'empty') AS empty_repositories,
  sum(commits)::BIGINT AS commits, sum(merges)::BIGINT AS merges, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, sum(files_changed)::BIGINT AS files_changed FROM kept"""
)
def filtered_summary(s, d):
    return explore.filtered_summary(_explored(s, d))


@query(_LEFT + "SELECT language, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, count(DISTINCT repo_id) AS repositories FROM n WHERE repo_id IN (SELECT repo_id FROM kept) GROUP BY 1")
def filtered_languages(s, d):
    return explore.filtered_languages(_explored(s, d)).select("language", "files", "bytes", "repositories")


def _ask(s: SparkSession, d: str, text: str) -> DataFrame:
    sql_surface.register(a.event_commits(s, d), a.file_changes(s, d), a.repositories(s, d))
    return sql_surface.query(s, text)


@query(
    """SELECT display_name AS repository, commits FROM repositories LEFT JOIN (SELECT repo_id, count(*) AS commits FROM raw_commits GROUP BY 1) USING (repo_id)
WHERE active AND status = 'ready' ORDER BY commits DESC NULLS LAST, repository LIMIT 5""",
    "events",
)
def sql_top_repositories(s, d):
    return _ask(s, d, "SELECT repository, commits FROM v_repository_summary WHERE status = 'ready' ORDER BY commits DESC NULLS LAST, repository LIMIT 5")


@query("SELECT activity_weekday, activity_hour, count(*) AS commits FROM ec GROUP BY ALL", "events")
def sql_heatmap(s, d):
    return _ask(s, d, "SELECT activity_weekday, activity_hour, count(*) AS commits FROM v_commits GROUP BY ALL")


@query("SELECT DISTINCT repository FROM ec WHERE is_merge UNION SELECT repository FROM ec WHERE insertions > 90 EXCEPT SELECT repository FROM ec WHERE repo_id = 1 ", "events")
def sql_set_operations(s, d):
    text = "SELECT DISTINCT repository FROM v_commits WHERE is_merge UNION SELECT repository FROM v_commits WHERE insertions > 90 EXCEPT SELECT repository FROM v_commits WHERE repo_id = 1"
    return _ask(s, d, text)


@query(
    """, span AS (SELECT min(activity_date) AS lo, max(activity_date) AS hi FROM ec)
SELECT g.d::DATE AS day, count(ec.hash) AS commits FROM (SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM span) g
LEFT JOIN ec ON activity_date = g.d::DATE GROUP BY 1""",
    "events",
)
def sql_recursive_calendar(s, d):
    text = """WITH RECURSIVE days(day, hi) AS (SELECT min(activity_date), max(activity_date) FROM v_commits UNION ALL SELECT date_add(day, 1), hi FROM days WHERE day < hi)
SELECT day, count(hash) AS commits FROM days LEFT JOIN v_commits ON activity_date = day GROUP BY day"""
    return _ask(s, d, text)


# ------------------------------------------------------------------------------------------------ quality, search, dedup
@query(
    """SELECT * FROM (SELECT 'shallow_history' AS code, count(*) FILTER (is_shallow) AS count FROM repositories WHERE active UNION ALL SELECT 'partial_clone', count(*) FILTER (is_partial) FROM repositories WHERE active
  UNION ALL SELECT 'stale_snapshot', count(*) FILTER (status = 'stale') FROM repositories WHERE active UNION ALL SELECT 'history_cut', 1 UNION ALL SELECT 'several_time_zones', count(DISTINCT timezone_offset_minutes) FROM ec)
WHERE count > 0""",
    "events",
)
def portfolio_warnings(s, d):
    history = settings({"history": {"max_commits_per_repository": 90}})["history"]
    return quality.portfolio_warnings(a.repositories(s, d).where("active"), history, repositories.timezone_offsets(events(s, d)))


@query("SELECT repo_id, display_name, status FROM repositories WHERE contains(lower(concat_ws(' ', repo_id, display_name, status)), 'n_1') OR contains(status, 'stal')", "events")
def text_search(s, d):
    rows = a.repositories(s, d).select("repo_id", "display_name", "status")
    return explore.search(rows, "N_1").union(explore.search(rows, "STAL")).distinct()


@query(
    """SELECT w AS weekday, h AS hour, CASE WHEN n <= 0 THEN 0 ELSE least(4, greatest(1, ceil(n * 4 / max(n) OVER ()))) END::INTEGER AS level
FROM (SELECT activity_weekday AS w, activity_hour AS h, count(*) AS n FROM ec GROUP BY 1, 2)""",
    "events",
)
def heat_levels(s, d):
    cells = events(s, d).groupBy(F.col("activity_weekday").alias("weekday"), F.col("activity_hour").alias("hour")).agg(F.count("*").alias("n"))
    most = cells.agg(F.max("n").alias("most"))
    return cells.crossJoin(F.broadcast(most)).select("weekday", "hour", signals.heat(F.col("n"), F.col("most")).alias("level"))  # one row


@query(
    """SELECT repo_id, sha256(count(*) || ':' || sum(('0x' || substr(sha256(hash), 1, 15))::BIGINT) || ':' || sum(('0x' || substr(sha256(hash), 16, 15))::BIGINT)) AS fingerprint
FROM oc GROUP BY repo_id""",
    "orders",
)
def repository_fingerprints(s, d):
    return repositories.fingerprints(orders(s, d))


@query("SELECT page_id, replace(replace(replace(url, 'http://www.example.com/en', '<repo:en>'), 'http://www.example.com', '<root>'), 'https://', '<git:>') AS url FROM pages")
def redacted_paths(s, d):
    known = [("http://www.example.com", "<root>"), ("https://", "<git:>"), ("http://www.example.com/en", "<repo:en>")]
    return a.read(s, d, "pages").select("page_id", signals.redacted(F.col("url"), known).alias("url"))


@query("SELECT k AS repo_key, min(path) AS path, CASE min(r) WHEN 0 THEN 'exclude' WHEN 1 THEN 'private' ELSE 'public' END AS classification FROM (SELECT s_nationkey::VARCHAR AS k, s_name AS path, (s_suppkey % 7 > 1)::INTEGER + (s_suppkey % 5 > 2)::INTEGER AS r FROM supplier) GROUP BY 1")
def work_tree_dedup(s, d):
    rank = (F.col("s_suppkey") % 7 > 1).cast("int") + (F.col("s_suppkey") % 5 > 2).cast("int")
    named = F.element_at(F.array(F.lit("exclude"), F.lit("private"), F.lit("public")), rank + 1)
    rows = a.read(s, d, "supplier").select(F.col("s_nationkey").cast("string").alias("repo_key"), F.col("s_name").alias("path"), named.alias("classification"))
    return snapshot.deduplicated(rows)


@query("SELECT c_name AS name, 'https://x/' || (c_custkey % 100) AS source, CASE WHEN c_custkey % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, 'no' AS fork, 'f' AS forge FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 4 > 0 QUALIFY row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey DESC) = 1")
def forge_listing(s, d):
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://x/"), (k % 100).cast("string"))
    rows = a.read(s, d, "customer").select(
        F.col("c_name").alias("full_name"), F.lit(None).cast("string").alias("path_with_namespace"), F.lit("n").alias("name"), url.alias("clone_url"), F.lit(None).cast("string").alias("ssh_url"),
        F.lit("http://none").alias("http_url_to_repo"), F.when(k % 6 != 0, k % 3 == 0).alias("private"), F.when(k % 6 == 0, "private").alias("visibility"), (k % 4 == 0).alias("fork"), k.alias("place"),
    )
    return forge.listed(rows, "f")


@query("""SELECT label, row_number() OVER (ORDER BY lower(split_part(label, '#', 1)), CAST(split_part(label, '#', 2) AS BIGINT), label) AS rank FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || '#' || c_custkey AS label FROM customer)
  QUALIFY rank <= 200""")
def natural_order_top(s, d):
    """Labels that only a natural order sorts as a reader does: ``building#9`` before ``BUILDING#10``."""
    k = F.col("c_custkey")
    rows = a.read(s, d, "customer").select(F.concat(F.when(k % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit("#"), k.cast("string")).alias("label"))
    first = explore.sorted_view(rows, "label").limit(200)
    return first.select("label", F.row_number().over(Window.orderBy(explore.natural_key(F.col("label")))).cast("long").alias("rank"))  # of 200 rows


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '–' ELSE replace(format('{:,}', CAST(o_orderkey AS BIGINT) * 1000), ',', '.') END AS keys FROM orders""")
def human_numbers(s, d):
    k = F.col("o_orderkey")
    return a.read(s, d, "orders").select("o_orderkey", labels.human_int(F.when(k % 7 != 0, k.cast("long") * 1000)).alias("keys"))


@query(
    """SELECT full_name AS name, 'https://x/' || k AS source, CASE WHEN k % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, 'no' AS fork, 'f' AS forge FROM (SELECT c_name AS full_name, c_custkey AS k FROM customer WHERE c_custkey % 4 > 0)
  WHERE k % 3 > 0 OR k % 5 = 1"""
)
def forge_union(s, d):
    """A public listing with the account's own listing, of which only its own rows are added."""
    k = F.col("c_custkey")
    rows = a.read(s, d, "customer").select(
        F.col("c_name").alias("full_name"), F.lit(None).cast("string").alias("path_with_namespace"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("https://x/"), k.cast("string")).alias("clone_url"),
        F.lit(None).cast("string").alias("ssh_url"), F.lit(None).cast("string").alias("http_url_to_repo"), (k % 3 == 0).alias("private"), F.lit(None).cast("string").alias("visibility"), (k % 4 == 0).alias("fork"),
        F.when(k % 5 == 1, "Me").otherwise("other").alias("owner"), k.alias("place"),
    )
    return forge.listed(rows.where("not private"), "f", visibility="all", own=rows, account="me")


@query(
    r"SELECT event_id, 'x' || chr(65533) || k || chr(9) || 'y' AS subject, CASE WHEN k = 0 THEN 'repository' ELSE 'repo-' || k END AS slug FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
)
def sanitized_text(s, d):
    k = F.get_json_object("props", "$.k").cast("int").cast("string")
    raw = F.concat(F.lit("x\x07"), k, F.lit("\ty"))
    slug = F.when(k == "0", "-ü-").otherwise(F.concat(F.lit("Repo  "), k, F.lit("!")))
    return a.read(s, d, "events").select("event_id", signals.sanitized(raw).alias("subject"), signals.slug(slug).alias("slug"))


@query("SELECT n AS missing FROM (VALUES ('nation_1'), ('nation_3'), ('elsewhere')) v(n) WHERE n NOT IN (SELECT lower(repository) FROM names JOIN privacy USING (repo_id) WHERE classification = 'public')", "events")
def requested_but_not_public(s, d):
    return repositories.not_public(a.repositories(s, d), a.privacy(s, d), ["NATION_1", "nation_3", "elsewhere"]).withColumnRenamed("folded", "missing")


@query("SELECT language AS name, (p_partkey % 25)::BIGINT AS repo_id, count(*) AS files, sum(p_size)::BIGINT AS bytes FROM (SELECT *, p_type AS language FROM part) GROUP BY 1, 2", "tree")
def tree_ingest(s, d):
    files = a.read(s, d, "part").select((F.col("p_partkey") % 25).alias("repo_id"), F.col("p_type").alias("name"), F.col("p_size").cast("long").alias("size"))
    return code.tree_totals(files, "name")


# ------------------------------------------------------------------------------------------------ more SQL over the views
@query("SELECT strftime(activity_date, '%Y-%m') AS month, count(*) AS commits, sum(insertions)::BIGINT AS insertions FROM ec GROUP BY 1", "events")
def sql_month_series(s, d):
    return _ask(s, d, "SELECT date_format(activity_date, 'yyyy-MM') AS month, count(*) AS commits, sum(insertions) AS insertions FROM v_commits GROUP BY 1")


@query(
    """SELECT author_name, commits FROM (SELECT author_key, max(author_name) AS author_name, count(*) AS commits FROM ec GROUP BY 1) ORDER BY commits DESC, author_name LIMIT 20""", "events"
)
def sql_authors(s, d):
    return _ask(s, d, "SELECT author_name, commits FROM v_author_summary ORDER BY commits DESC, author_name LIMIT 20")


@query(
    """SELECT repository, path, count(*) AS touches FROM file_changes JOIN names USING (repo_id) GROUP BY 1, 2 ORDER BY touches DESC, repository, path LIMIT 50""", "orders", "changes"
)
def sql_hotspots(s, d):
    return _ask(s, d, "SELECT repository, path, count(*) AS touches FROM v_file_changes GROUP BY 1, 2 ORDER BY touches DESC, repository, path LIMIT 50")


@query(
    "SELECT repo_id, language, files, bytes FROM (SELECT *, row_number() OVER (ORDER BY bytes DESC, lower(language), repo_id) AS k FROM tree) WHERE k <= 20", "tree"
)
def sorted_view_top(s, d):
    return explore.sorted_view(a.tree(s, d), "bytes", descending=True).orderBy(F.desc("bytes"), F.lower("language"), "repo_id").limit(20)
