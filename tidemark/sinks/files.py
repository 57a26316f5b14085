"""Reports as files. A report's datasets are aggregates; each is bounded before it is brought to the driver."""

from __future__ import annotations

import hashlib
import html
import json
import os
import tempfile
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import kept_text, pieces, removed

#: Rows of one dataset that a document may hold; larger ones belong into ``write_parquet``.
MOST_ROWS = 100_000


class TooManyRows(ValueError):
    """A dataset is too long for a document."""


def collected(df: DataFrame, most: int = MOST_ROWS) -> list[dict[str, Any]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooManyRows(f"more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_parquet(datasets: Mapping[str, DataFrame], folder: str) -> None:
    """Every dataset as a table, whatever its length."""
    for name, df in datasets.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def write_text(path: str | Path, text: str) -> None:
    """Whole or not at all: written beside the target and moved onto it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            file.write(text)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def document(datasets: Mapping[str, DataFrame]) -> dict[str, list[dict[str, Any]]]:
    return {name: collected(df) for name, df in datasets.items()}


def write_json(datasets: Mapping[str, DataFrame], path: str | Path) -> None:
    write_text(path, json.dumps(document(datasets), ensure_ascii=False, indent=2, default=str) + "\n")


#: The files of a report's bundle with the dataset of each. Fixed values.
BUNDLE = {
    "repositories.csv": "repositories", "contributors.csv": "contributors", "collaboration_distances.csv": "network_authors", "identity_hints.csv": "identity_hints", "activity_daily.csv": "daily",
    "activity_monthly.csv": "monthly", "activity_yearly.csv": "yearly", "activity_weekdays.csv": "weekdays", "activity_hours.csv": "hours", "activity_dayparts.csv": "dayparts",
    "activity_busiest_days.csv": "busiest_days", "commit_types.csv": "commit_types", "commit_sizes.csv": "commit_sizes", "commit_scopes.csv": "top_scopes", "tree_languages.csv": "tree_languages",
    "churn_languages.csv": "churn_languages", "hot_files.csv": "hot_files", "top_directories.csv": "top_directories", "releases.csv": "releases", "scan_errors.csv": "errors",
    "timezone_offsets.csv": "timezone_offsets", "summary.csv": "summary",
}


def _lines(df: DataFrame) -> DataFrame:
    """A line of CSV for each row: booleans in words, nested values as JSON, nothing for null."""
    cells = []
    for field in df.schema:
        kind = field.dataType.typeName()
        value = F.col(f"`{field.name}`")
        cells.append((F.to_json(value) if kind in ("array", "map", "struct") else value.cast("string")).alias(field.name))
    options = {"escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return df.select(F.to_csv(F.struct(*cells), options).alias("value"))


def write_csv(df: DataFrame, path: str | Path) -> Path:
    """One file for spreadsheets, with a byte order mark, in the order of ``df``; ``no_data`` alone where there are no rows. It may have any number of rows.

    Spark writes the lines as parts into the shared folder; their bytes are then copied one after the other beside the target, which takes its name in one step. A job or a copy that fails leaves the target as it was.
    """
    spark = df.sparkSession
    lines = kept_text(_lines(df), "csv")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}-")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(b"\xef\xbb\xbf")
            head = True
            for piece in pieces(spark, lines):
                if head:
                    file.write(",".join(_quoted(c) for c in df.columns).encode() + b"\r\n")
                    head = False
                file.write(piece)
            if head:
                file.write(b"no_data\r\n")
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    finally:
        removed(spark, lines)
    return target


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\r\n') else name


def write_csv_bundle(datasets: Mapping[str, DataFrame], folder: str | Path) -> list[Path]:
    """The fixed bundle of a report, a file for each dataset; those that the report lacks have no data. All are written beside the folder, which takes the place of an older one when they are whole."""
    target = Path(folder)
    target.parent.mkdir(parents=True, exist_ok=True)
    found = dict(datasets)
    hints = [found[k] for k in ("name_hints", "email_hints") if k in found]
    if hints:
        found["identity_hints"] = hints[0] if len(hints) == 1 else hints[0].unionByName(hints[1], allowMissingColumns=True)
    with tempfile.TemporaryDirectory(dir=target.parent, prefix=f".{target.name}-") as scratch:
        fresh = Path(scratch, "new")
        fresh.mkdir()
        for file, name in BUNDLE.items():
            if name in found:
                write_csv(found[name], fresh / file)
            else:
                (fresh / file).write_bytes(b"\xef\xbb\xbfno_data\r\n")
        if target.exists():
            os.replace(target, Path(scratch, "old"))
        os.replace(fresh, target)
    return [target / file for file in BUNDLE]


def _escaped(value: Any) -> str:
    return str("" if value is None else value).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def markdown_table(rows: Sequence[Mapping[str, Any]], columns: Sequence[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(_escaped(r.get(c)) for c in columns) + " |" for r in rows])


def markdown(datasets: Mapping[str, DataFrame], top: int = 10) -> str:
    """Key figures, repositories and the most active contributors."""
    figures = [{"figure": k, "value": v} for k, v in collected(datasets["summary"])[0].items()]
    parts = ["# Report", "", "## Summary", "", markdown_table(figures, ["figure", "value"])]
    if "repositories" in datasets:
        kept = datasets["repositories"].select("display_name", "commits", "authors", "activity_status")
        parts += ["", "## Repositories", "", markdown_table(collected(kept.orderBy(F.desc("commits"), F.lower("display_name"))), kept.columns)]
    if "contributors" in datasets:
        people = datasets["contributors"].select("name", "commits", "share").limit(top)
        parts += ["", "## Contributors", "", markdown_table(collected(people), people.columns)]
    return "\n".join(parts) + "\n"


def json_island(value: Any) -> str:
    """JSON that may stand inside a script element."""
    text = json.dumps(value, ensure_ascii=False, default=str)
    for raw, safe in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        text = text.replace(raw, safe)
    return text


def html_page(datasets: Mapping[str, DataFrame], title: str = "Report") -> str:
    """One offline page: every dataset as a table that sorts by a click on a heading, from a JSON island."""
    script = """
const data = JSON.parse(document.getElementById("data").textContent);
const show = v => v === null ? "" : typeof v === "object" ? JSON.stringify(v) : String(v);
const order = (a, b) => typeof a === "number" && typeof b === "number" ? a - b : show(a).localeCompare(show(b), undefined, {numeric: true});
for (const [name, rows] of Object.entries(data)) {
  const section = document.body.appendChild(document.createElement("section"));
  section.appendChild(document.createElement("h2")).textContent = name;
  const table = section.appendChild(document.createElement("table")), columns = rows.length ? Object.keys(rows[0]) : [];
  const draw = () => { table.replaceChildren(); const head = table.insertRow();
    for (const c of columns) { const th = head.appendChild(document.createElement("th")); th.textContent = c;
      th.onclick = () => { const up = th.dataset.up = section.dataset.by === c && section.dataset.up === "1" ? "0" : "1"; section.dataset.by = c; section.dataset.up = up;
        rows.sort((x, y) => order(x[c], y[c]) * (up === "1" ? 1 : -1)); draw(); }; }
    for (const r of rows) { const tr = table.insertRow(); for (const c of columns) tr.insertCell().textContent = show(r[c]); } };
  draw();
}"""
    island = json_island(document(datasets))
    return (
        f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>'
        f'<script type="application/json" id="data">{island}</script><script>{script}</script></body></html>\n'
    )


def write_manifest(paths: Sequence[str | Path], target: str | Path) -> None:
    """SHA-256 and size of each file."""
    entries = [{"file": Path(p).name, "bytes": Path(p).stat().st_size, "sha256": hashlib.sha256(Path(p).read_bytes()).hexdigest()} for p in paths]
    write_text(target, json.dumps(entries, indent=2) + "\n")


def profile(public: DataFrame, languages: DataFrame, policy: Mapping[str, bool], user: str) -> str:
    """A public profile: only what ``policy`` allows of repositories that were checked to be public."""
    columns = ["display_name"] if policy["include_repository_names"] else []
    if columns and policy["include_exact_metrics"]:
        columns += [c for c in ("commits", "tree_files", "tags") if c in public.columns]
    if columns and policy["include_last_activity_date"] and "last_day" in public.columns:
        columns += ["last_day"]
    parts = [f"# {_escaped(user)}", ""]
    if columns:
        parts += ["## Repositories", "", markdown_table(collected(public.select(*columns).orderBy(F.lower("display_name"))), columns), ""]
    if policy["include_languages"]:
        parts += ["## Languages", "", ", ".join(_escaped(r["language"]) for r in collected(languages)) or "none yet", ""]
    return "\n".join(parts)


def text_table(rows: Sequence[Mapping[str, Any]], columns: Sequence[str]) -> str:
    """Left-aligned columns for a terminal."""
    cells = [[str("" if r.get(c) is None else r[c]) for c in columns] for r in rows]
    widths = [max([len(c), *(len(row[k]) for row in cells)]) for k, c in enumerate(columns)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in [list(columns), ["-" * w for w in widths], *cells])
