"""What a path says: language, file type and top directory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.labels import NO_EXTENSION, ROOT

# Languages by file name and by suffix.
SPECIAL_FILES = {
    "dockerfile": "Dockerfile", "makefile": "Makefile", "jenkinsfile": "Jenkins Pipeline", "gemfile": "Ruby", "rakefile": "Ruby", "cargo.lock": "Rust",
    "package-lock.json": "JSON", "pnpm-lock.yaml": "YAML", "yarn.lock": "Yarn Lock", "poetry.lock": "TOML",
}
SUFFIXES = {
    ".py": "Python", ".pyi": "Python", ".pyx": "Cython", ".js": "JavaScript", ".jsx": "JavaScript/React", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript",
    ".tsx": "TypeScript/React", ".d.ts": "TypeScript", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".go": "Go", ".rs": "Rust", ".c": "C", ".h": "C/C++ Header", ".cc": "C++",
    ".cpp": "C++", ".cxx": "C++", ".hpp": "C++ Header", ".cs": "C#", ".php": "PHP", ".rb": "Ruby", ".swift": "Swift", ".scala": "Scala", ".dart": "Dart", ".lua": "Lua", ".r": "R",
    ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".fish": "Shell", ".ps1": "PowerShell", ".sql": "SQL", ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS",
    ".sass": "Sass", ".less": "Less", ".vue": "Vue", ".svelte": "Svelte", ".xml": "XML", ".json": "JSON", ".jsonc": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".ini": "INI",
    ".cfg": "Config", ".conf": "Config", ".md": "Markdown", ".mdx": "Markdown", ".rst": "reStructuredText", ".txt": "Text", ".tex": "LaTeX", ".ipynb": "Jupyter Notebook",
    ".gradle": "Gradle", ".tf": "Terraform", ".tfvars": "Terraform", ".hcl": "HCL", ".proto": "Protocol Buffers", ".graphql": "GraphQL", ".gql": "GraphQL", ".sol": "Solidity",
    ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hrl": "Erlang", ".clj": "Clojure", ".cljs": "ClojureScript",
}
OTHER = "Other"


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def segments(path: Column) -> Column:
    """The parts of a path: backslashes are slashes; empty and ``.`` parts don't count; a leading slash is a part."""
    plain = F.translate(path, "\\", "/")
    named = F.filter(F.split(plain, "/"), lambda p: (p != "") & (p != "."))
    return F.when(plain.startswith("/"), F.concat(F.array(F.lit("/")), named)).otherwise(named)


def _name(path: Column) -> Column:
    last = F.try_element_at(segments(path), F.lit(-1))
    return F.lower(F.when(last != "/", last).otherwise(""))


def suffix(name: Column) -> Column:
    """From the last dot on, unless that dot begins the name (after other dots, too) or ends it."""
    return F.regexp_extract(F.regexp_replace(name, r"^\.+", ""), r"^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    name = _name(path)
    return (
        F.when(_lookup(name, SPECIAL_FILES).isNotNull(), _lookup(name, SPECIAL_FILES))
        .when(name.endswith(".d.ts"), "TypeScript")
        .otherwise(F.coalesce(_lookup(suffix(name), SUFFIXES), F.lit(OTHER)))
    )


def file_type(path: Column) -> Column:
    name = _name(path)
    known = F.nullif(suffix(name), F.lit(""))
    return F.when(name.isin(*SPECIAL_FILES), name).when(name.endswith(".d.ts"), ".d.ts").otherwise(F.coalesce(known, F.lit(NO_EXTENSION)))


def top_directory(path: Column) -> Column:
    parts = segments(path)
    return F.when(F.size(parts) > 1, parts[0]).otherwise(ROOT)
