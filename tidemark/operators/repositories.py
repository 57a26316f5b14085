"""Repositories side by side: totals, health, languages, warnings, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.signals import density, status
from tidemark.operators.effective import usable_repositories
from tidemark.operators.people import top_authors


def repository_totals(repositories: DataFrame, commits: DataFrame, privacy: DataFrame | None = None) -> DataFrame:
    """Every active repository with its commits. Those without any keep zero counts and null sums."""
    sums = commits.groupBy("repo_id").agg(
        F.count("*").alias("commits"),
        F.countDistinct("author_key").alias("authors"),
        F.countDistinct("activity_date").alias("active_days"),
        F.sum(F.col("is_merge").cast("int")).alias("merges"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
        F.sum("files_changed").alias("files_changed"),
        F.min("activity_at").alias("first_commit"),
        F.max("activity_at").alias("last_commit"),
        F.max("activity_date").alias("last_day"),
    )
    rows = repositories.where("active").join(sums, "repo_id", "left")
    if privacy is not None:
        rows = rows.join(privacy.select("repo_id", "classification"), "repo_id", "left")
        rows = rows.withColumn("classification", F.coalesce("classification", F.lit("private")))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("commits", "authors", "active_days", "insertions", "deletions")}
    return rows.withColumns(zero)


def with_status(rows: DataFrame, as_of: Column, quiet: int = 90, dormant: int = 365) -> DataFrame:
    days = F.when(F.col("commits") > 0, F.datediff(as_of, "last_day"))
    return rows.withColumns({"activity_status": status(F.col("commits"), F.col("last_day"), as_of, quiet, dormant), "days_since_last_commit": days})


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("activity_status").agg(F.count("*").alias("repositories"))


def nested_languages(tree: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(repo_id, top_language, languages): languages as an array of structs, most bytes first, then by name, with their comment totals.

    ``top_language`` prefers more files among equal bytes. Languages without comment totals have zeros and no density.
    """
    rows = tree.select("repo_id", "language", "files", "bytes")
    counts = ("code_lines", "comment_lines", "blank_lines")
    pair = "struct<kind:string,lines:bigint>"
    if stats is not None:
        whole = F.col("kind") == "all"
        kinds = F.array_sort(F.collect_list(F.when(~whole, F.struct("kind", F.col("comment_lines").alias("lines")))))  # at most one for each kind
        made = stats.groupBy("repo_id", "language").agg(*(F.sum(F.when(whole, F.col(c))).alias(c) for c in counts), kinds.cast(f"array<{pair}>").alias("kinds"))
        rows = rows.join(made, ["repo_id", "language"], "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("long") for c in counts} | {"kinds": F.lit(None).cast(f"array<{pair}>")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | {"kinds": F.coalesce("kinds", F.array().cast(f"array<{pair}>"))})
    rows = rows.withColumn("comment_density", density(F.col("comment_lines"), F.col("code_lines")))
    names = ("language", "files", "bytes", *counts, "comment_density")
    made = rows.groupBy("repo_id").agg(
        F.min(F.struct((-F.col("bytes")).alias("b"), (-F.col("files")).alias("f"), "language"))["language"].alias("top_language"),
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), *names, "kinds"))).alias("all"),
    )
    languages = F.transform("all", lambda x: F.struct(*(x[n].alias(n) for n in names), F.map_from_entries(x["kinds"]).alias("comment_types")))
    return made.select("repo_id", "top_language", languages.alias("languages"))


def nested_file_types(file_types: DataFrame) -> DataFrame:
    """(repo_id, file_types): file types as an array of structs, most bytes first, then by name."""
    each = F.struct((-F.col("bytes")).alias("b"), "file_type", "files", "bytes")
    made = file_types.groupBy("repo_id").agg(F.array_sort(F.collect_list(each)).alias("all"))
    return made.select("repo_id", F.transform("all", lambda x: F.struct(x["file_type"].alias("file_type"), x["files"].alias("files"), x["bytes"].alias("bytes"))).alias("file_types"))


def top_language(tree: DataFrame) -> DataFrame:
    order = Window.partitionBy("repo_id").orderBy(F.desc("bytes"), F.desc("files"), "language")
    return tree.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("repo_id", "language", "files", "bytes")


def warning_codes(maximum: int | None = None) -> Column:
    """What limits a repository's figures, as codes."""
    found = [
        F.when(F.col("is_shallow"), "shallow_history"),
        F.when(F.col("is_partial"), "partial_clone"),
        F.when(F.col("is_bare"), "bare_repository"),
        F.when(F.col("status") == "stale", "stale_snapshot"),
        F.when(F.col("status") == "error", "unreadable"),
        F.when(F.col("commits") >= maximum, "history_cut") if maximum is not None else F.lit(None).cast("string"),
    ]
    return F.array_compact(F.array(*found))


def warnings(rows: DataFrame, maximum: int | None = None) -> DataFrame:
    """(repository, warnings) of the repositories with any."""
    return rows.select(F.col("display_name").alias("repository"), warning_codes(maximum).alias("warnings")).where(F.size("warnings") > 0)


_LANGUAGES = (
    "array<struct<language:string,files:bigint,bytes:bigint,code_lines:bigint,comment_lines:bigint,blank_lines:bigint,comment_density:double,comment_types:map<string,bigint>>>"
)
_FILE_TYPES = "array<struct<file_type:string,files:bigint,bytes:bigint>>"


def _nested_or_empty(rows: DataFrame, nested: DataFrame | None, kinds: dict[str, str]) -> DataFrame:
    """``rows`` with the array columns of ``nested``, empty where a repository has none."""
    if nested is not None:
        rows = rows.join(nested, "repo_id", "left")
    empty = {c: F.array().cast(kind) for c, kind in kinds.items()}
    return rows.withColumns({c: none if nested is None else F.coalesce(F.col(c).cast(kinds[c]), none) for c, none in empty.items()})


def with_contents(
    rows: DataFrame, tree: DataFrame | None = None, stats: DataFrame | None = None, file_types: DataFrame | None = None, signals: DataFrame | None = None
) -> DataFrame:
    """Repositories with what their head trees hold: languages, file types, CI systems, licences and totals of lines.

    ``tree_files`` and ``tree_bytes`` are sums over the languages unless the repositories have these columns.
    """
    rows = _nested_or_empty(rows, nested_languages(tree, stats) if tree is not None else None, {"languages": _LANGUAGES})
    if tree is None:
        rows = rows.withColumn("top_language", F.lit(None).cast("string"))
    rows = _nested_or_empty(rows, nested_file_types(file_types) if file_types is not None else None, {"file_types": _FILE_TYPES})
    found = signals.select("repo_id", "ci_systems", "licenses") if signals is not None else None
    rows = _nested_or_empty(rows, found, {"ci_systems": "array<string>", "licenses": "array<string>"})
    total = lambda name: F.aggregate("languages", F.lit(0).cast("long"), lambda s, x: s + x[name])
    sums = {"code_lines": total("code_lines"), "comment_lines": total("comment_lines")}
    sums |= {c: total(name) for c, name in (("tree_files", "files"), ("tree_bytes", "bytes")) if c not in rows.columns}
    return rows.withColumns(sums).withColumn("comment_density", density(F.col("comment_lines"), F.col("code_lines")))


def matrix(
    repositories: DataFrame,
    commits: DataFrame,
    as_of: Column,
    tree: DataFrame | None = None,
    stats: DataFrame | None = None,
    privacy: DataFrame | None = None,
    quiet: int = 90,
    dormant: int = 365,
    file_types: DataFrame | None = None,
    signals: DataFrame | None = None,
    maximum: int | None = None,
    include_paths: bool = False,
) -> DataFrame:
    """One row for each active repository with everything known of it; aggregates are made before they are joined, so nothing fans out.

    Most commits first, then by name whatever the case. Paths are left out unless ``include_paths``; ``maximum`` is the bound on commits that a scan had.
    """
    rows = with_status(repository_totals(repositories, commits, privacy), as_of, quiet, dormant).join(top_authors(commits), "repo_id", "left")
    rows = rows.withColumns({"bus_factor_50": F.coalesce("bus_factor_50", F.lit(0)), "churn": F.col("insertions") + F.col("deletions"), "warnings": warning_codes(maximum)})
    rows = with_contents(rows, tree, stats, file_types, signals)
    rows = rows if include_paths else rows.drop("path")
    return rows.orderBy(F.desc("commits"), F.lower("display_name"), "repo_id")


def releases(tags: DataFrame, repositories: DataFrame, limit: int = 500) -> DataFrame:
    rows = tags.join(usable_repositories(repositories).select("repo_id", F.col("display_name").alias("repository")), "repo_id")
    return rows.select("repository", "name", "created_at", "object_hash").orderBy(F.desc_nulls_last("created_at"), "repository", "name").limit(limit)


def release_summary(tags: DataFrame, repositories: DataFrame) -> DataFrame:
    rows = tags.join(usable_repositories(repositories).select("repo_id"), "repo_id", "left_semi")
    return rows.agg(
        F.count("*").alias("tags"),
        F.count("created_at").alias("dated_tags"),
        F.countDistinct("repo_id").alias("repositories"),
        F.min("created_at").alias("first_release"),
        F.max("created_at").alias("last_release"),
    )


def timezone_offsets(commits: DataFrame) -> DataFrame:
    return commits.groupBy(F.col("timezone_offset_minutes").alias("offset_minutes")).agg(F.count("*").alias("commits"))


def not_public(repositories: DataFrame, privacy: DataFrame, requested: list[str]) -> DataFrame:
    """(folded): the requested names, in lower case, that no usable public repository has."""
    public = usable_repositories(repositories).join(privacy.where("classification = 'public'").select("repo_id"), "repo_id", "left_semi")
    wanted = repositories.sparkSession.createDataFrame([(n.casefold(),) for n in dict.fromkeys(requested)], "folded string")
    return wanted.join(public.select(F.lower("display_name").alias("folded")), "folded", "left_anti")


def public_repositories(repositories: DataFrame, privacy: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Usable repositories that are public; of these the requested ones, whatever their case.

    It fails closed, when it is read: a requested name that isn't public, or nothing at all, is an error.
    """
    public = usable_repositories(repositories).join(privacy.where("classification = 'public'").select("repo_id"), "repo_id", "left_semi")
    missing = F.lit("")
    faults = public.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.lit("no public repository")).alias("fault"))
    if requested:
        gone = not_public(repositories, privacy, requested).agg(F.array_sort(F.collect_list("folded")).alias("names"))  # at most as many as were requested
        missing = F.when(F.size("names") > 0, F.concat(F.lit("not public: "), F.array_join("names", ", ")))
        faults = gone.select(missing.alias("fault")).union(faults)
        public = public.where(F.lower("display_name").isin([n.casefold() for n in requested]))
    fault = faults.agg(F.min("fault").alias("_fault"))  # one row
    return public.join(F.broadcast(fault), F.lit(True), "right").where(F.coalesce(F.when(F.col("_fault").isNotNull(), F.raise_error(F.col("_fault")).cast("boolean")), F.lit(True))).drop("_fault")


def profile_languages(tree: DataFrame, public: DataFrame, limit: int = 12) -> DataFrame:
    rows = tree.join(public.select("repo_id"), "repo_id", "left_semi").groupBy("language").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return rows.orderBy(F.desc("bytes"), F.desc("files"), "language").limit(limit)


def fingerprints(commits: DataFrame) -> DataFrame:
    """(repo_id, fingerprint): equal for equal bags of commit hashes, in whatever order.

    Sums of digests are combined before the shuffle, so no task holds the commits of a repository.
    """
    digest = F.sha2(F.col("hash").cast("binary"), 256)
    sums = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 16)]
    mark = F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256)
    return commits.groupBy("repo_id").agg(mark.alias("fingerprint"))
