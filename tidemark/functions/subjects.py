"""What a commit's subject line says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: type(scope)!: with at least one blank after the colon.
CONVENTIONAL = r"(?U)^([A-Za-z][A-Za-z0-9_-]*)(?:\(([^)]+)\))?(!)?:\s+"
ISSUE = r"(?U)(?:#\d+\b|\b[A-Z][A-Z0-9]+-\d+\b)"
# Subjects of first commits.
FIRST_SUBJECTS = ("initial commit", "initial", "first commit")


def classified(subject: Column, parents: Column) -> Column:
    """struct(type, scope, breaking) of a subject.

    Merges come first, then reverts and first commits, then conventional types, known or not. Only conventional
    subjects have a scope or break anything.
    """
    text = F.coalesce(subject, F.lit(""))
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    plain = F.lower(stripped)
    merge = (F.coalesce(parents, F.lit(0)) > 1) | F.lower(text).startswith("merge ")
    conventional = stripped.rlike(CONVENTIONAL)
    special = merge | plain.startswith("revert") | plain.isin(*FIRST_SUBJECTS)
    kind = (
        F.when(merge, "merge")
        .when(plain.startswith("revert"), "revert")
        .when(plain.isin(*FIRST_SUBJECTS), "init")
        .when(conventional, F.lower(F.regexp_extract(stripped, CONVENTIONAL, 1)))
        .otherwise("other")
    )
    scope = F.when(~special & conventional, F.nullif(F.regexp_extract(stripped, CONVENTIONAL, 2), F.lit("")))
    breaking = ~special & conventional & (F.regexp_extract(stripped, CONVENTIONAL, 3) == "!")
    return F.struct(kind.alias("type"), scope.alias("scope"), breaking.alias("breaking"))


def mentions_issue(subject: Column) -> Column:
    return F.coalesce(subject, F.lit("")).rlike(ISSUE)
