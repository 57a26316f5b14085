"""Comment, code and blank lines of a text: a state machine folded over its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line-comment prefixes and block-comment languages.
PREFIXES = {
    "Python": ("#",), "Cython": ("#",), "Shell": ("#",), "Ruby": ("#",), "Perl": ("#",), "R": ("#",), "YAML": ("#",), "TOML": ("#",), "Config": ("#", ";"), "INI": ("#", ";"), "PowerShell": ("#",),
    "SQL": ("--",), "Lua": ("--",), "Haskell": ("--",), "JavaScript": ("//",), "JavaScript/React": ("//",), "TypeScript": ("//",), "TypeScript/React": ("//",), "Java": ("//",),
    "Kotlin": ("//",), "Go": ("//",), "Rust": ("//",), "C": ("//",), "C++": ("//",), "C#": ("//",), "PHP": ("//",), "Swift": ("//",), "Scala": ("//",), "Dart": ("//",), "CSS": (),
    "SCSS": ("//",), "Sass": ("//",),
}
MARKUP = ("HTML", "XML", "Vue", "Svelte", "Markdown")
BLOCKS = (
    "JavaScript", "JavaScript/React", "TypeScript", "TypeScript/React", "Java", "Kotlin", "Go", "Rust", "C", "C++", "C#", "PHP", "Swift", "Scala", "Dart",
    "CSS", "SCSS", "Sass", "SQL", *MARKUP,
)
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
KINDS = ("line", "block", "documentation")
#: What is trimmed from a line: Unicode's white space and the separators from U+001C to U+001F.
WHITE = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def lines(text: Column) -> Column:
    """The lines of a text; an end at the very end begins no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_counts(text: Column, language: Column) -> Column:
    """struct(code, blank, line, block, documentation) of a text in a language.

    In this order: blank; a Python docstring's first, inner and last lines; markup comments; block comments, which
    open at the start of a line and end with the line that holds the closer; line comments by prefix; else code.
    """
    empty = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("code", "blank", *KINDS)), F.lit(False).alias("open"), F.lit("").alias("quote"))

    def bumped(state: Column, counter: str, is_open: Column, quote: Column) -> Column:
        counts = [(state[n] + (1 if n == counter else 0)).alias(n) for n in ("code", "blank", *KINDS)]
        return F.struct(*counts, is_open.alias("open"), quote.alias("quote"))

    def facts(line: Column) -> Column:
        mark = F.substring(line, 1, 3)
        return F.struct(line.alias("line"), mark.alias("mark"), F.contains(F.substring(line, 4, 1 << 30), mark).alias("again"))

    def step(state: Column, x: Column) -> Column:
        line, mark, again = x["line"], x["mark"], x["again"]
        quoted = (language == "Python") & mark.isin('"""', "'''")
        inside = state["quote"] != ""
        prefixed = F.lit(False)
        for prefix in sorted({p for all_of in PREFIXES.values() for p in all_of}):
            prefixed = prefixed | (language.isin(*(n for n, all_of in PREFIXES.items() if prefix in all_of)) & line.startswith(prefix))
        return (
            F.when(line == "", bumped(state, "blank", state["open"], state["quote"]))
            .when(quoted, bumped(state, "documentation", state["open"], F.when((state["quote"] == mark) | again, "").otherwise(mark)))
            .when(inside, bumped(state, "documentation", state["open"], F.when(F.contains(line, state["quote"]), "").otherwise(state["quote"])))
            .when(language.isin(*MARKUP) & (state["open"] | line.startswith("<!--")), bumped(state, "block", ~line.contains("-->"), state["quote"]))
            .when(language.isin(*BLOCKS) & (state["open"] | line.startswith("/*")), bumped(state, "block", ~line.contains("*/"), state["quote"]))
            .when(prefixed, bumped(state, "line", state["open"], state["quote"]))
            .otherwise(bumped(state, "code", state["open"], state["quote"]))
        )

    # A lambda's expressions are computed wherever they are used, so each is an array of its own before the fold.
    trimmed = F.transform(lines(text), lambda raw: F.btrim(raw, F.lit(WHITE)))
    return F.aggregate(F.transform(trimmed, facts), empty, step, lambda s: F.struct(*(s[n].alias(n) for n in ("code", "blank", *KINDS))))
