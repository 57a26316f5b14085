"""Settings of an analysis: defaults, merging and validation."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Mapping
from typing import Any

# The default settings and patterns of the data model.
DEFAULTS: dict[str, dict[str, Any]] = {
    "discovery": {
        "max_depth": None, "include_hidden": False, "follow_symlinks": False, "nested_repositories": False,
        "ignore": [
            ".git", "node_modules", "vendor", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", "target", "dist", "build",
        ],
    },
    "history": {
        "scope": "local", "refs": [], "main_branches": False, "since": None, "until": None, "first_parent": False, "include_merges": True,
        "include_bots": True, "deduplicate_global": False, "activity_timestamp": "author", "timezone": "commit", "respect_mailmap": True,
        "collect_churn": True, "detect_renames": True, "store_file_details": True, "store_subjects": False, "collect_tree": True,
        "collect_comments": True, "collect_releases": True, "collect_remote_hosts": True, "max_commits_per_repository": None,
    },
    "identity": {
        "aliases": [],
        "bot_patterns": [r"(?i)\[bot\]", r"(?i)(^|[\s._-])bot($|[\s@._-])", r"(?i)dependabot", r"(?i)renovate", r"(?i)github-actions"],
    },
    "work_time": {"working_days": [0, 1, 2, 3, 4], "start_hour": 8, "end_hour": 18},
    "privacy": {
        "include_absolute_paths": False, "show_emails": True, "anonymize_authors": False, "default_repository_classification": "private", "repository_rules": [],
    },
    "report": {"top_n": 15, "timeline_months": 60, "quiet_after_days": 90, "dormant_after_days": 365},
    "profile": {"include_repository_names": True, "include_languages": True, "include_exact_metrics": False, "include_last_activity_date": False},
    "network": {
        "enabled": False, "reference_names": [], "max_display_nodes": 500, "exclude_service_accounts": True,
        "ignored_account_patterns": [
            r"(?i)dependabot", r"(?i)renovate", r"(?i)github-actions", r"(?i)gitlab-ci", r"(?i)codex", r"(?i)claude", r"(?i)copilot", r"(?i)\[bot\]",
        ],
        "min_commits_per_author_repository": 2, "max_contribution_gap_days": 365, "require_remote_reference": True,
    },
    "performance": {"git_timeout_seconds": 900},
}
SCOPES = ("current", "local", "all")
CLASSES = ("exclude", "private", "public")


class ConfigError(ValueError):
    """A setting that cannot be used."""


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` on top of ``base``: objects are merged, lists and plain values replaced."""
    out = copy.deepcopy(dict(base))
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


def settings(over: Mapping[str, Any] | str | None = None) -> dict[str, Any]:
    """Validated settings from an object or JSON text."""
    found = json.loads(over) if isinstance(over, str) else over or {}
    made = merged(DEFAULTS, found)
    for complaint in _complaints(made):
        raise ConfigError(complaint)
    return made


def _complaints(s: Mapping[str, Any]):
    history, work, privacy, network = s["history"], s["work_time"], s["privacy"], s["network"]
    if history["scope"] not in SCOPES:
        yield f"history.scope must be one of {', '.join(SCOPES)}"
    if history["activity_timestamp"] not in ("author", "committer"):
        yield "history.activity_timestamp must be author or committer"
    limit = history["max_commits_per_repository"]
    if limit is not None and (not isinstance(limit, int) or limit < 1):
        yield "history.max_commits_per_repository must be positive or null"
    if not all(isinstance(d, int) and 0 <= d <= 6 for d in work["working_days"]):
        yield "work_time.working_days holds days from 0 (Monday) to 6"
    if not 0 <= work["start_hour"] < work["end_hour"] <= 24:
        yield "work_time hours must satisfy 0 <= start < end <= 24"
    if privacy["default_repository_classification"] not in CLASSES:
        yield f"privacy.default_repository_classification must be one of {', '.join(CLASSES)}"
    for rule in privacy["repository_rules"]:
        if not rule.get("match") or rule.get("classification") not in CLASSES:
            yield "privacy.repository_rules need match and classification"
    if not 0 < s["report"]["quiet_after_days"] <= s["report"]["dormant_after_days"]:
        yield "report.quiet_after_days must not exceed report.dormant_after_days"
    if network["min_commits_per_author_repository"] < 1 or network["max_contribution_gap_days"] < 0:
        yield "network thresholds must not be negative"
    for pattern in [*s["identity"]["bot_patterns"], *network["ignored_account_patterns"]]:
        try:
            re.compile(pattern)
        except re.error as error:
            yield f"pattern {pattern!r}: {error}"
