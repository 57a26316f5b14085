"""What files and addresses say about a repository: licenses, CI systems, remote hosts; and small text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# License names by what the head of the file says, CI systems by path.
LICENSES = (
    ("MIT", ("MIT LICENSE",)),
    ("Apache-2.0", ("APACHE LICENSE", "APACHE SOFTWARE FOUNDATION")),
    ("GPL", ("GNU GENERAL PUBLIC LICENSE",)),
    ("BSD", ("BSD 3-CLAUSE", "BSD 2-CLAUSE")),
    ("MPL", ("MOZILLA PUBLIC LICENSE",)),
    ("Creative Commons", ("CREATIVE COMMONS",)),
)
CI_PATHS = {
    ".gitlab-ci.yml": "GitLab CI", "Jenkinsfile": "Jenkins", ".circleci/config.yml": "CircleCI", "azure-pipelines.yml": "Azure Pipelines",
    ".travis.yml": "Travis CI", "bitbucket-pipelines.yml": "Bitbucket Pipelines",
}
#: Characters of a license file that are looked at.
HEAD = 32_768


def license_name(text: Column, path: Column | None = None, head: int | None = HEAD) -> Column:
    """The license of a text by its head (None: by all of it), else the file's own name."""
    upper = F.upper(F.substring(text, 1, head) if head is not None else text)
    chain = F
    for name, marks in LICENSES:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | upper.contains(mark)
        chain = chain.when(hit, name)
    return chain.otherwise(F.element_at(F.split(path, "/"), -1) if path is not None else F.lit(None).cast("string"))


def is_license_file(path: Column) -> Column:
    return F.upper(F.element_at(F.split(path, "/"), -1)).rlike("^(LICENSE|COPYING)")


def ci_system(path: Column) -> Column:
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in CI_PATHS.items() for x in pair)), path)
    return F.when(path.rlike(r"(?s)^\.github/workflows/.*\.ya?ml\z"), "GitHub Actions").otherwise(known)


def remote_host(url: Column) -> Column:
    """The lower-cased host of ``user@host:path`` or a url, else ``local``."""
    scp = F.regexp_extract(url, r"^[^/@:]+@([^:/]+):", 1)
    full = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1)
    return F.lower(F.coalesce(F.nullif(scp, F.lit("")), F.nullif(full, F.lit("")), F.lit("local")))


def sanitized(text: Column) -> Column:
    """Control characters except tab and line ends become U+FFFD."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "�")


def slug(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("repository"))


def redacted(text: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """Known paths, longest first, become their labels, with slashes either way."""
    for raw, label in sorted((r for r in replacements if r[0]), key=lambda r: -len(r[0])):
        for form in dict.fromkeys((raw, raw.replace("\\", "/"), raw.replace("/", "\\"))):
            text = F.replace(text, F.lit(form), F.lit(label))
    return text


def density(comments: Column, code: Column) -> Column:
    """Comment lines among comment and code lines; blank lines don't count."""
    return F.try_divide(comments, comments + code)


def change(current: Column, previous: Column) -> Column:
    """Relative change: none from nothing to nothing, undefined from nothing to something."""
    return F.when(previous > 0, (current - previous) / previous).when(current == 0, F.lit(0.0))


def status(commits: Column, last_day: Column, as_of: Column, quiet: int, dormant: int) -> Column:
    days = F.datediff(as_of, last_day)
    return F.when((F.coalesce(commits, F.lit(0)) == 0) | last_day.isNull(), "empty").when(days >= dormant, "dormant").when(days >= quiet, "quiet").otherwise("active")


def heat(value: Column, most: Column) -> Column:
    """A level from 0 to 4."""
    return F.when(value <= 0, 0).otherwise(F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(F.try_divide(value * 4, most))))).cast("int")
