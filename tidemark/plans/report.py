"""The datasets of a report, all of them lazy, from the tables of the data model."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import settings as make_settings
from tidemark.functions.signals import density
from tidemark.operators import activity, code, network, people, repositories
from tidemark.operators.effective import effective_commits, effective_file_changes, with_author
from tidemark.operators.statistics import concentration
from tidemark.scratch import kept


class Tables(NamedTuple):
    """The data model: what a snapshot holds. Optional parts may be missing."""

    repositories: DataFrame
    commits: DataFrame
    changes: DataFrame
    tags: DataFrame
    tree: DataFrame | None = None
    comments: DataFrame | None = None
    privacy: DataFrame | None = None
    runs: DataFrame | None = None
    errors: DataFrame | None = None
    file_types: DataFrame | None = None
    signals: DataFrame | None = None


#: What commits are rolled up by, each by itself; the empty one is everything.
_ROLLS = {"all": (), "author": ("author_key",), "committer": ("committer_key",), "day": ("activity_date",), "repository": ("repo_id",), "hour": ("activity_weekday", "activity_hour")}


def rolled_up(commits: DataFrame) -> DataFrame:
    """All that ``summary`` and ``insights`` count of commits, from one pass over them: a row for each author, committer, day, repository and hour of the week, and one for everything.

    It is written, since both read it several times; it has as many rows as there are different authors, committers, days and repositories.
    """
    yes = lambda c: F.sum(F.col(c).cast("int"))
    keys = list(dict.fromkeys(k for own in _ROLLS.values() for k in own))
    level = F.lit("all")
    for name, own in _ROLLS.items():
        if own:
            level = F.when(F.grouping(own[0]) == 0, name).otherwise(level)
    rows = commits.groupingSets([list(own) for own in _ROLLS.values()], *keys).agg(
        level.alias("level"),
        F.count("*").alias("commits"),
        yes("is_merge").alias("merges"),
        yes("author_is_bot").alias("bots"),
        *(F.sum(c).alias(c) for c in ("insertions", "deletions", "files_changed", "binary_files")),
        F.count_if(F.col("message_type") != "other").alias("typed"),
        F.count_if("has_issue_reference").alias("with_issue"),
        F.count_if("is_breaking").alias("breaking"),
        F.min("activity_at").alias("first_commit"),
        F.max("activity_at").alias("last_commit"),
        F.min("activity_date").alias("first_day"),
        F.max("activity_date").alias("last_day"),
        F.max("author_name").alias("name"),
    )
    return kept(rows, "rolled")


def summary(tables: Tables, commits: DataFrame, as_of: Column, work_time: Mapping[str, Any], quiet: int, dormant: int, rolled: DataFrame | None = None) -> DataFrame:
    """One row with the figures of the whole portfolio; each part is an aggregate of one row. Commits are read once, by ``rolled_up``, which may be shared, and raw ones once for their bots.

    Numbers of branches are there if the repositories have them. What isn't known counts as nothing; shares of nothing are null.
    """
    rolled = rolled_up(commits) if rolled is None else rolled
    of = lambda level: rolled.where(F.col("level") == level)
    bot = F.col("author_is_bot").cast("int")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    all_of = lambda c: F.max(F.when(F.col("level") == "all", F.col(c)))
    number = lambda c: F.coalesce(all_of(c), F.lit(0))
    known = lambda level, key: F.count_if((F.col("level") == level) & F.col(key).isNotNull())
    off = ~F.col("activity_weekday").isin(*work_time["working_days"])
    late = off | (F.col("activity_hour") < work_time["start_hour"]) | (F.col("activity_hour") >= work_time["end_hour"])
    at = lambda when: F.try_divide(F.coalesce(F.sum(F.when((F.col("level") == "hour") & when, F.col("commits"))), F.lit(0)), all_of("commits"))
    totals = rolled.agg(
        number("commits").alias("commits"),
        number("merges").alias("merge_commits"),
        known("author", "author_key").alias("authors"),
        known("committer", "committer_key").alias("committers"),
        number("bots").alias("bot_commits_in_effective_set"),
        known("day", "activity_date").alias("active_days"),
        all_of("first_commit").alias("first_commit"),
        all_of("last_commit").alias("last_commit"),
        F.datediff(as_of, all_of("last_day")).alias("days_since_last_commit"),
        number("insertions").alias("additions"),
        number("deletions").alias("deletions"),
        number("files_changed").alias("files_changed"),
        number("binary_files").alias("binary_files"),
        F.try_divide(all_of("typed"), all_of("commits")).alias("typed_commit_share"),
        F.try_divide(all_of("with_issue"), all_of("commits")).alias("issue_reference_share"),
        number("breaking").alias("breaking_changes"),
        at(off).alias("weekend_share"),
        at(late).alias("outside_work_time_share"),
        F.count_if((F.col("level") == "author") & (F.col("first_day") >= F.date_sub(as_of, 29))).alias("new_authors_last_30_days"),
        F.avg(F.when(F.col("level") == "day", F.col("commits"))).alias("average_commits_per_active_day"),
    )
    rows = tables.repositories.where("active").join(of("repository").select("repo_id", F.col("commits").alias("_n"), "last_day"), "repo_id", "left").withColumn("commits", F.coalesce("_n", F.lit(0).cast("long")))
    rows = repositories.with_status(rows, as_of, quiet, dormant)
    rows = repositories.with_contents(rows, tables.tree, tables.comments, tables.file_types, tables.signals)
    held = ("tree_files", "tree_bytes", "code_lines", "comment_lines", "local_branches", "remote_branches")
    health = rows.agg(
        F.count("*").alias("repositories"),
        F.count_if(F.col("commits") > 0).alias("repositories_with_commits"),
        *(F.count_if(F.col("activity_status") == s).alias(f"{s}_repositories") for s in ("active", "quiet", "dormant", "empty")),
        F.count_if(F.col("status").isin("stale", "error")).alias("failed_repositories"),
        F.count_if("is_shallow").alias("shallow_repositories"),
        F.count_if("is_partial").alias("partial_repositories"),
        *(zero(c).alias(c) for c in held if c in rows.columns),
        F.count_if(F.size("ci_systems") > 0).alias("repositories_with_ci"),
        F.count_if(F.size("licenses") > 0).alias("repositories_with_license"),
    )
    raw_bots = tables.commits.join(repositories.usable_repositories(tables.repositories).select("repo_id"), "repo_id", "left_semi")
    one = totals.crossJoin(health).crossJoin(raw_bots.agg(zero(bot).alias("bot_commits_raw")))  # one row each, as all below
    spread = concentration(of("author").select("author_key", "commits"))
    one = one.crossJoin(spread.withColumnsRenamed({"top_share": "top_author_share", "gini": "author_gini", "hhi": "author_hhi"}))
    days = of("day").select("activity_date")
    streak = activity.longest_streak(days).select(F.col("days").alias("longest_streak_days"), F.col("start").alias("longest_streak_start"), F.col("end").alias("longest_streak_end"))
    one = one.crossJoin(streak).crossJoin(activity.longest_gap(days).select(F.col("days_without_commits").alias("longest_gap_days")))
    one = one.crossJoin(repositories.release_summary(tables.tags, tables.repositories).select("tags"))
    return one.withColumns(
        {
            "non_merge_commits": F.col("commits") - F.col("merge_commits"),
            "merge_share": F.try_divide("merge_commits", "commits"),
            "churn": F.col("additions") + F.col("deletions"),
            "active_repository_share": F.try_divide("active_repositories", "repositories"),
            "ci_coverage": F.try_divide("repositories_with_ci", "repositories"),
            "license_coverage": F.try_divide("repositories_with_license", "repositories"),
            "comment_density": density(F.col("comment_lines"), F.col("code_lines")),
        }
    )


def insights(commits: DataFrame, tables: Tables, rolled: DataFrame | None = None) -> DataFrame:
    """One row: the strongest weekday, hour, month, author, repository, language and day; the earliest of equals. Commits are read once, by ``rolled_up``, which may be shared."""
    rolled = rolled_up(commits) if rolled is None else rolled
    of = lambda level: rolled.where(F.col("level") == level)
    first = lambda value, *keys: F.max(F.struct("commits", *keys, F.col(value).alias("v")))["v"]
    found = of("hour").select(F.col("activity_weekday").alias("weekday"), F.col("activity_hour").alias("hour"), "commits").withColumn("repository_names", F.array().cast("array<string>"))
    matrix = activity.week_cells(found)
    by_day = activity.weekdays(matrix).agg(first("label", (-F.col("weekday")).alias("k")).alias("top_weekday"))
    by_hour = activity.hours(matrix).agg(first("hour", (-F.col("hour")).alias("k")).alias("top_hour"))
    dated = of("day").where("activity_date is not null").select(F.col("activity_date").alias("date"), "commits")
    months = dated.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("commits").alias("commits")).withColumn("k", -F.replace("month", F.lit("-"), F.lit("")).cast("int"))
    by_month = months.agg(first("month", F.col("k")).alias("peak_month"))
    days = dated.agg(first("date", (-F.unix_date("date")).alias("k")).alias("busiest_day"))
    authors = of("author").agg(F.min(F.struct((-F.col("commits")).alias("c"), F.lower("name").alias("n"), "author_key", F.col("name").alias("v")))["v"].alias("top_author"))
    repos = tables.repositories.where("active").join(of("repository").select("repo_id", F.col("commits").alias("_n")), "repo_id", "left").withColumn("commits", F.coalesce("_n", F.lit(0).cast("long")))
    repos = repos.agg(F.min(F.struct((-F.col("commits")).alias("c"), F.lower("display_name").alias("n"), "repo_id", F.col("display_name").alias("v")))["v"].alias("top_repository"))
    one = by_day.crossJoin(by_hour).crossJoin(by_month).crossJoin(days).crossJoin(authors).crossJoin(repos)  # one row each
    if tables.tree is not None:
        tree = code.tree_languages(tables.tree, tables.repositories)
        one = one.crossJoin(tree.agg(F.min(F.struct((-F.col("bytes")).alias("b"), (-F.col("files")).alias("f"), "language"))["language"].alias("top_tree_language")))
    return one


#: What a report says of the run behind it, and of the history that was read.
RUN_FIELDS = ("run_id", "started_at", "finished_at", "repositories_found", "repositories_scanned", "repositories_cached", "repositories_failed", "status")
HISTORY_FIELDS = (
    "scope", "refs", "since", "until", "first_parent", "include_merges", "include_bots", "deduplicate_global", "activity_timestamp", "timezone", "respect_mailmap", "collect_churn",
    "detect_renames", "store_file_details", "store_subjects", "collect_tree", "collect_releases", "max_commits_per_repository",
)


def meta(runs: DataFrame, over: Mapping[str, Any] | None = None, roots: str = "roots") -> DataFrame:
    """One row about the report: the latest run, its roots (numbered unless paths may be shown) and the settings as JSON.

    Of fields that ``runs`` lacks there are nulls, and no roots; without any run the row has nulls for all of it.
    """
    s = make_settings(over)
    columns = [F.col(c) if c in runs.columns else F.lit(None).cast("string").alias(c) for c in (*RUN_FIELDS, "tool_version")]
    at = (F.col(roots) if roots in runs.columns else F.array()).cast("array<string>")
    latest = runs.select(*columns, at.alias("roots")).agg(F.max_by(F.struct(*RUN_FIELDS, "tool_version", "roots"), "run_id").alias("r"))
    shown = F.coalesce("r.roots", F.array().cast("array<string>"))
    if not s["privacy"]["include_absolute_paths"]:
        shown = F.transform(shown, lambda _, k: F.concat(F.lit("Root "), (k + 1).cast("string")))
    parts = {name: s[name] for name in ("work_time", "privacy", "profile", "report")} | {"history": {k: s["history"][k] for k in HISTORY_FIELDS}}
    texts = [F.lit(json.dumps(parts[name], ensure_ascii=False)).alias(name) for name in sorted(parts)]
    return latest.select(F.lit(s["report"].get("title")).cast("string").alias("title"), shown.alias("roots"), "r.tool_version", F.struct(*(F.col(f"r.{c}") for c in RUN_FIELDS)).alias("run"), *texts)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(1)


def run_errors(errors: DataFrame, runs: DataFrame) -> DataFrame:
    return errors.join(runs.agg(F.max("run_id").alias("run_id")), "run_id", "left_semi")


def build(tables: Tables, as_of: Column, over: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """Every dataset of a report by name. Only the roll-up behind ``summary`` and ``insights`` and the network's search run at once; nothing else runs until it is used."""
    s = make_settings(over)
    history, privacy, report, net = s["history"], s["privacy"], s["report"], s["network"]
    commits = effective_commits(tables.commits, tables.repositories, history["include_bots"], history["deduplicate_global"])
    changes = with_author(effective_file_changes(tables.changes, commits), commits)
    quiet, dormant = report["quiet_after_days"], report["dormant_after_days"]
    week = activity.week_matrix(commits)
    rolled = rolled_up(commits)
    anonymous, emails = privacy["anonymize_authors"], privacy["show_emails"]
    out = {
        "summary": summary(tables, commits, as_of, s["work_time"], quiet, dormant, rolled),
        "daily": activity.daily(commits),
        "monthly": activity.monthly(commits),
        "yearly": activity.yearly(commits),
        "weekday_hour": week,
        "weekdays": activity.weekdays(week),
        "hours": activity.hours(week),
        "dayparts": activity.dayparts(week),
        "recent": activity.recent_windows(commits, as_of),
        "calendar": activity.calendar(commits, as_of),
        "busiest_days": activity.busiest_days(commits),
        "contributors": people.contributors(commits, anonymous, emails),
        "concentration": people.author_concentration(commits),
        "repositories": repositories.matrix(
            tables.repositories, commits, as_of, tables.tree, tables.comments, tables.privacy, quiet, dormant, tables.file_types, tables.signals,
            history["max_commits_per_repository"], privacy["include_absolute_paths"],
        ),
        "commit_types": code.commit_types(commits),
        "commit_sizes": code.commit_sizes(commits),
        "churn_distribution": code.churn_distribution(commits),
        "churn_languages": code.churn_languages(changes),
        "hot_files": code.hot_files(changes),
        "top_directories": code.top_directories(changes),
        "top_scopes": code.top_scopes(commits),
        "recent_subjects": code.recent_subjects(commits),
        "releases": repositories.releases(tables.tags, tables.repositories),
        "release_summary": repositories.release_summary(tables.tags, tables.repositories),
        "timezone_offsets": repositories.timezone_offsets(commits),
        "insights": insights(commits, tables, rolled),
    }
    if not anonymous:
        out["name_hints"] = people.name_hints(tables.commits, tables.repositories, show_emails=emails)
        out["email_hints"] = people.email_hints(tables.commits, tables.repositories, show_emails=emails)
    if tables.tree is not None:
        out["tree_languages"] = code.tree_languages(tables.tree, tables.repositories)
    if tables.comments is not None:
        out["comment_languages"] = code.comment_languages(tables.comments, tables.repositories)
        out["comment_kinds"] = code.comment_kinds(tables.comments, tables.repositories)
    maximum = history["max_commits_per_repository"]
    out["repository_warnings"] = repositories.warnings(repositories.repository_totals(tables.repositories, commits), maximum)
    if tables.runs is not None:
        out["latest_run"] = latest_run(tables.runs)
        out["meta"] = meta(tables.runs, over)
        if tables.errors is not None:
            out["errors"] = run_errors(tables.errors, tables.runs)
    if net["enabled"]:
        found = network.memberships(
            commits, net["min_commits_per_author_repository"], net["require_remote_reference"], net["exclude_service_accounts"], net["ignored_account_patterns"]
        )
        start = network.references(commits, net["reference_names"])
        reached = network.distances(found.rows, start, net["max_contribution_gap_days"])
        out["network_authors"] = network.author_rows(found.rows, reached, net["max_display_nodes"])
        out["network_pairs"] = network.direct_pairs(found.rows, net["max_contribution_gap_days"], net["max_display_nodes"])
        out["network_stats"] = network.stats(found, reached, net["max_display_nodes"])
        out["network_model"] = network.model(commits.sparkSession, net, start)
    else:  # all that a page reads is there, with nothing in it
        spark = commits.sparkSession
        out["network_authors"] = spark.createDataFrame([], network.AUTHOR_ROWS)
        out["network_pairs"] = spark.createDataFrame([], network.PAIR_ROWS)
        out["network_stats"], out["network_model"] = network.no_stats(spark), network.model(spark, net)
    return out


def displayed(datasets: Mapping[str, DataFrame], over: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
    """What a page shows of a report: ``top_n`` rows of the lists that rank, and the last ``timeline_months`` months."""
    s = make_settings(over)["report"]
    top, months = s["top_n"], max(1, s["timeline_months"])
    out = dict(datasets)
    for name in ("contributors", "hot_files", "top_directories", "top_scopes", "busiest_days", "recent_subjects"):
        if name in out:
            out[name] = out[name].limit(top)
    if "monthly" in out:
        out["monthly"] = out["monthly"].orderBy(F.desc("month")).limit(months).orderBy("month")
    return out
