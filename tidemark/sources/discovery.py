"""Repositories below folders of the driver's file system."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

LOCATIONS = "path string, root string, display_name string"


def looks_like_repository(folder: Path) -> bool:
    """A work tree with ``.git``, or a bare repository."""
    if (folder / ".git").exists():
        return True
    return (folder / "HEAD").is_file() and (folder / "objects").is_dir() and (folder / "refs").is_dir()


def _children(folder: Path, root: Path, s: Mapping[str, Any]) -> Iterator[Path]:
    for child in sorted(folder.iterdir(), key=lambda p: p.name.casefold()):
        hidden = child.name.startswith(".") and not s["include_hidden"]
        link = child.is_symlink() and not s["follow_symlinks"]
        relative = child.relative_to(root).as_posix()
        ignored = any(fnmatch.fnmatch(child.name, p) or fnmatch.fnmatch(relative, p) for p in s["ignore"])
        if child.name != ".git" and not hidden and not link and not ignored and child.is_dir():
            yield child


def walk(roots: Iterable[str | Path], settings: Mapping[str, Any]) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """(path, root, name) of each repository, by name, and (path, message) of what couldn't be read.

    A folder is entered once, whatever links lead to it; below a repository the walk goes on only if nested ones are asked for.
    """
    places = [Path(r).expanduser().resolve() for r in roots]
    for place in places:
        if not place.is_dir():
            raise FileNotFoundError(f"not a folder: {place}")
    found: dict[str, tuple[str, str, str]] = {}
    issues: list[tuple[str, str]] = []
    for root in places:
        level, seen, depth = [root], set(), 0
        while level:
            below: list[Path] = []
            for folder in level:
                try:
                    stat = folder.stat()
                    if (stat.st_dev, stat.st_ino) in seen:
                        continue
                    seen.add((stat.st_dev, stat.st_ino))
                    if looks_like_repository(folder):
                        relative = folder.relative_to(root).as_posix()
                        name = root.name if relative == "." else relative
                        found.setdefault(str(folder), (str(folder), str(root), f"{root.name}/{relative}" if len(places) > 1 else name))
                        if not settings["nested_repositories"]:
                            continue
                    if settings["max_depth"] is None or depth < settings["max_depth"]:
                        below.extend(_children(folder, root, settings))
                except OSError as error:
                    issues.append((str(folder), str(error)))
            level, depth = below, depth + 1
    return sorted(found.values(), key=lambda x: (x[2].casefold(), x[0])), issues


def discovered(spark: SparkSession, roots: Iterable[str | Path], settings: Mapping[str, Any]) -> DataFrame:
    return spark.createDataFrame(walk(roots, settings)[0], LOCATIONS)


def inside_repository(target: str | Path) -> bool:
    """Whether a path lies in a repository: reports must not be written there."""
    place = Path(target).expanduser().resolve()
    return any(looks_like_repository(p) for p in (place, *place.parents) if p.is_dir())
