"""File-name patterns as regular expressions that Java understands."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_regex(pattern: str) -> str:
    """A shell pattern (``*``, ``?``, ``[set]``, ``[!set]``) as an expression for the whole text; ``*`` crosses slashes."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (stop := pattern.find("]", k + 1 + (pattern[k : k + 1] == "!"))) > 0:
            body = pattern[k:stop].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            k = stop + 1
            out.append("[^" + body[1:] + "]" if body.startswith("!") else "[" + ("\\" if body.startswith("^") else "") + body + "]")
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


def like(column: Column, pattern: str) -> Column:
    return column.rlike(as_regex(pattern))


def first_match(candidates: list[Column], rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule (pattern, value) that any candidate fits, case and all; else ``default``."""
    chain = F
    for pattern, value in rules:
        if pattern:
            hit = F.lit(False)
            for c in candidates:
                hit = hit | F.coalesce(like(c, pattern), F.lit(False))
            chain = chain.when(hit, value)
    return F.lit(default) if chain is F else chain.otherwise(default)
