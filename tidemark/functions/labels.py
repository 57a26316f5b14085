"""Names of days, parts of the day, commit types and sizes: values of the results, in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the data model.
WEEKDAYS = ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")
DAYPARTS = (("Nacht", 0, 6), ("Vormittag", 6, 12), ("Nachmittag", 12, 18), ("Abend", 18, 24))
TYPES = {
    "feat": "Features", "fix": "Fixes", "docs": "Dokumentation", "style": "Style", "refactor": "Refactoring", "perf": "Performance", "test": "Tests",
    "build": "Build", "ci": "CI", "chore": "Chores", "revert": "Reverts", "merge": "Merges", "release": "Releases", "security": "Security",
    "deps": "Dependencies", "init": "Initialisierung", "other": "Sonstige",
}
SIZES = ("0", "1–10", "11–50", "51–200", "201–1.000", ">1.000", "Unbekannt")
UNKNOWN_AUTHOR = "Unbekannt"
NO_EXTENSION = "[ohne Endung]"
ROOT = "[root]"


def weekday_label(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), day + 1)


def daypart(hour: Column) -> Column:
    chain = F
    for name, start, stop in DAYPARTS:
        chain = chain.when((hour >= start) & (hour < stop), name)
    return chain


def type_label(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, kind), kind)


def size_label(known: Column, lines: Column) -> Column:
    """The size class of a commit by changed lines; commits without statistics are unknown."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), SIZES[6])
        .when(lines == 0, SIZES[0])
        .when(lines <= 10, SIZES[1])
        .when(lines <= 50, SIZES[2])
        .when(lines <= 200, SIZES[3])
        .when(lines <= 1000, SIZES[4])
        .otherwise(SIZES[5])
    )


def human_int(value: Column) -> Column:
    """A whole number with points between thousands; a dash for none."""
    return F.coalesce(F.translate(F.format_number(value, 0), ",", "."), F.lit("–"))


def human_percent(share: Column, digits: int = 1) -> Column:
    """A share as a percentage with a decimal comma; a dash for none."""
    return F.coalesce(F.concat(F.translate(F.format_number(share * 100, digits), ".,", ","), F.lit("%")), F.lit("–"))


def stored_list(text: Column) -> Column:
    """The strings of a list that was stored as JSON; nothing for what is no such list."""
    return F.coalesce(F.filter(F.from_json(text, "array<string>"), lambda v: v.isNotNull()), F.array().cast("array<string>"))
