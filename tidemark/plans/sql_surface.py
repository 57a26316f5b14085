"""Read-only SQL over the data model: registered views and a guard that only lets queries through."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.effective import usable_repositories
from tidemark.operators.people import author_summary

#: What a parsed statement may be at its root and anywhere below: reading only. Everything else is turned away.
_ROOTS = frozenset(
    "Project Filter Aggregate Sort Distinct GlobalLimit LocalLimit Offset UnresolvedWith Union Except Intersect SubqueryAlias UnresolvedRelation "
    "UnresolvedInlineTable OneRowRelation UnresolvedHaving Join Window WithWindowDefinition Generate UnresolvedTableValuedFunction Deduplicate Pivot Unpivot "
    "Sample LateralJoin UnresolvedSubqueryColumnAliases Expand Repartition RepartitionByExpression RebalancePartitions UnresolvedHint LocalRelation UnionLoop "
    "UnresolvedOrdinal Tail LimitAll LateralColumnAliasReference".split()
)


#: Functions of Spark's own that call into the JVM or read files of the driver, and table functions that are allowed.
_REACHING_OUT = frozenset("reflect java_method try_reflect from_protobuf to_protobuf".split())
_TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: Expressions that hold a plan, and those that stand for names known only later.
_SUBQUERIES = frozenset("ScalarSubquery ListQuery Exists LateralSubquery DynamicPruningSubquery FunctionTableSubqueryArgumentExpression".split())
_LATER = frozenset("ExpressionWithUnresolvedIdentifier NamedParameter PosParameter".split())


class NotReadOnly(ValueError):
    """The statement would do more than read."""


def register(commits: DataFrame, changes: DataFrame, repositories: DataFrame) -> None:
    """The views ``v_commits``, ``v_file_changes``, ``v_repository_summary`` and ``v_author_summary``."""
    names = usable_repositories(repositories).select("repo_id", F.col("display_name").alias("repository"))
    commits.join(names, "repo_id").createOrReplaceTempView("v_commits")
    changes.join(names, "repo_id").createOrReplaceTempView("v_file_changes")
    totals = commits.groupBy("repo_id").agg(
        F.count("*").alias("commits"),
        F.countDistinct("author_key").alias("authors"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
        F.min("activity_at").alias("first_activity"),
        F.max("activity_at").alias("last_activity"),
    )
    active = repositories.where("active").select("repo_id", F.col("display_name").alias("repository"), "status")
    active.join(totals, "repo_id", "left").drop("repo_id").createOrReplaceTempView("v_repository_summary")
    author_summary(commits, repositories).createOrReplaceTempView("v_author_summary")


def _items(sequence) -> list:
    return [sequence.apply(k) for k in range(sequence.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _plans(plan, local: frozenset[str] = frozenset()):
    """A plan's nodes, and those of the subqueries in its expressions, each with the names of the common table expressions that are in scope there.

    A common table expression sees those before it in its own list (itself only if the list is recursive) and those around the list; what follows the list sees all of it; nothing outside does.
    """
    yield plan, local
    for e in _expressions(plan):
        if _name(e) in _SUBQUERIES:
            yield from _plans(e.plan(), local)
    if _name(plan) == "UnresolvedWith":
        for relation in _items(plan.cteRelations()):
            name = frozenset({relation._1().lower()})
            yield from _plans(relation._2(), local | name if plan.allowRecursion() else local)
            local |= name
    for node in _items(plan.children()):
        yield from _plans(node, local)


def _expressions(plan):
    waiting = _items(plan.expressions())
    while waiting:
        found = waiting.pop()
        yield found
        waiting += _items(found.children())


def _refuse_functions(spark: SparkSession, plan, own: frozenset[str]) -> None:
    if _name(plan) == "UnresolvedTableValuedFunction":
        name = ".".join(_items(plan.name())).lower()
        if name not in _TABLE_FUNCTIONS:
            raise NotReadOnly(f"{name} is not among the table functions of queries")
    for e in _expressions(plan):
        if _name(e) in _LATER:
            raise NotReadOnly("names must be written out")
        if _name(e) == "UnresolvedFunction":
            name = ".".join(_items(e.nameParts())).lower()
        elif _name(e) == "UnresolvedGenerator":
            name = e.name().funcName().lower()
        else:
            continue
        if name in _REACHING_OUT or name not in own:
            raise NotReadOnly(f"{name} is not among Spark's own functions for queries")


def checked(spark: SparkSession, text: str) -> str:
    """``text`` if Spark's parser finds a single query in it that reads temporary views only and calls only Spark's own functions."""
    state = spark._jsparkSession.sessionState()
    plans = list(_plans(state.sqlParser().parsePlan(text)))
    own = frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
    for plan, local in plans:
        if _name(plan) not in _ROOTS:
            raise NotReadOnly(f"only queries are allowed, not {_name(plan)}")
        if _name(plan) == "UnresolvedRelation":
            parts = _items(plan.multipartIdentifier())
            if len(parts) > 1 or parts[0].lower() not in local and not state.catalog().getTempView(parts[0]).isDefined():
                raise NotReadOnly(f"{'.'.join(parts)} is no registered view")
        _refuse_functions(spark, plan, own)
    return text


def query(spark: SparkSession, text: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The result of a read-only statement over the registered views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(checked(spark, text))
