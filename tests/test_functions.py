import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.config import ConfigError, settings
from tidemark.functions import identities, paths, signals, subjects
from tidemark.functions.comments import BLOCKS, MARKUP, PREFIXES, line_counts
from tidemark.functions.globs import as_regex, first_match
from tidemark.operators import activity
from tidemark.operators.statistics import concentration, distribution


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_subjects(spark):
    given = [("feat(core): first #12", 1), ("fix!: weekend ABC-42", 1), ("Merge branch x", 1), ("x", 2), ("  Revert that", 1), ("Initial commit", 1), ("odd-type: y", 1), ("feat:", 1), (None, 1), ("", 0)]
    df = spark.createDataFrame(given, "s string, p int").select(subjects.classified(F.col("s"), F.col("p")).alias("c"), subjects.mentions_issue(F.col("s")).alias("i"))
    got = [(r.c.type, r.c.scope, r.c.breaking, r.i) for r in df.collect()]
    assert got == [
        ("feat", "core", False, True), ("fix", None, True, True), ("merge", None, False, False), ("merge", None, False, False), ("revert", None, False, False), ("init", None, False, False),
        ("odd-type", None, False, False), ("other", None, False, False), ("other", None, False, False), ("other", None, False, False),
    ]


def test_paths(spark):
    given = ["src/app.py", "types/index.d.ts", "Dockerfile", r"a\b\C.KT", ".bashrc", "..x.py", "name.", "a/./b//c.tar.gz", ""]
    df = spark.createDataFrame([(p,) for p in given], "p string").select(paths.language(F.col("p")), paths.file_type(F.col("p")), paths.top_directory(F.col("p")))
    assert [tuple(r) for r in df.collect()] == [
        ("Python", ".py", "src"), ("TypeScript", ".d.ts", "types"), ("Dockerfile", "dockerfile", "[root]"), ("Kotlin", ".kt", "a"), ("Other", "[ohne Endung]", "[root]"), ("Python", ".py", "[root]"),
        ("Other", "[ohne Endung]", "[root]"), ("Other", ".gz", "a"), ("Other", "[ohne Endung]", "[root]"),
    ]


def test_identities(spark):
    alias = {"name": "Alice", "email": "alice@example.com", "match_emails": ["alice@old.*"], "match_names": ["alice o*"]}
    bots = settings()["identity"]["bot_patterns"]
    rows = [("Alice Old", "alice@old.example"), ("dependabot[bot]", "x@y"), (None, None), ("  Bob ", "BOB@E.org "), ("Robot", "r@e.org")]
    got = spark.createDataFrame(rows, "n string, e string").select(identities.resolved(F.col("n"), F.col("e"), [alias], bots).alias("i")).collect()
    assert [(r.i.name, r.i.email, r.i.is_bot) for r in got] == [
        ("Alice", "alice@example.com", False), ("dependabot[bot]", "x@y", True), ("Unbekannt", "", False), ("Bob", "bob@e.org", False), ("Robot", "r@e.org", False),
    ]
    assert all(len(r.i.key) == 24 for r in got) and len({r.i.key for r in got}) == 5


def test_globs(spark):
    assert as_regex("a*[!b]?") == r"(?s)^a.*[^b].\z"
    rules = [("team/*", "public"), ("*", "exclude")]
    assert values(spark, first_match([F.col("x")], rules, "private"), [("team/a/b",), ("Team/a",), (None,)]) == ["public", "exclude", "private"]
    assert values(spark, first_match([F.col("x")], [], "private"), [("a",)]) == ["private"]


def test_settings():
    assert settings({"history": {"refs": ["x"]}})["history"]["scope"] == "local"
    for bad in ({"history": {"scope": "odd"}}, {"work_time": {"start_hour": 20}}, {"identity": {"bot_patterns": ["("]}}, {"privacy": {"repository_rules": [{"match": "x"}]}}):
        with pytest.raises(ConfigError):
            settings(bad)


def test_signals(spark):
    assert values(spark, signals.license_name(F.col("x"), F.lit("a/LICENSE.txt")), [("the MIT License",), ("none",)]) == ["MIT", "LICENSE.txt"]
    assert values(spark, signals.remote_host(F.col("x")), [("git@Host.example:a/b.git",), ("https://u:p@host.example:8443/x",), ("/srv/x",)]) == ["host.example", "host.example", "local"]
    assert values(spark, signals.sanitized(F.col("x")), [("a\x00b\tc\x1b",)]) == ["a�b\tc�"]
    assert values(spark, signals.slug(F.col("x")), [("My Repo/ü",), ("ü",)]) == ["my-repo", "repository"]
    assert values(spark, signals.redacted(F.col("x"), [("/home/a", "<root>"), ("/home/a/b", "<repo:b>")]), [("at /home/a/b and \\home\\a",)]) == ["at <repo:b> and <root>"]
    assert values(spark, signals.ci_system(F.col("x")), [(".github/workflows/checks.yml",), ("Jenkinsfile",), ("x/Jenkinsfile",)]) == ["GitHub Actions", "Jenkins", None]
    assert values(spark, signals.heat(F.col("v"), F.lit(8)), [(0,), (1,), (8,), (5,)], "v int") == [0, 1, 4, 3]
    assert values(spark, signals.change(F.col("a"), F.col("b")), [(3, 2), (0, 0), (1, 0)], "a int, b int") == [0.5, 0.0, None]


def plain_counts(text, language):
    out = dict.fromkeys(("code", "blank", "line", "block", "documentation"), 0)
    is_open, quote = False, ""
    for raw in text.splitlines():
        line = raw.strip()
        if not line:
            out["blank"] += 1
        elif language == "Python" and line[:3] in ('"""', "'''"):
            out["documentation"] += 1
            quote = "" if quote == line[:3] or line.count(line[:3]) >= 2 else line[:3]
        elif quote:
            out["documentation"] += 1
            quote = "" if quote in line else quote
        elif language in MARKUP and (is_open or line.startswith("<!--")):
            out["block"] += 1
            is_open = "-->" not in line
        elif language in BLOCKS and (is_open or line.startswith("/*")):
            out["block"] += 1
            is_open = "*/" not in line
        elif line.startswith(PREFIXES.get(language, ())):
            out["line"] += 1
        else:
            out["code"] += 1
    return out


SAMPLES = [
    '# a\n"""one"""\nx = 1\n"""\ntext\nend"""\n\n\'\'\'q\nmore\n\'\'\'\ny', "/* a\n b */ c\n// d\ncode // e\n", "<!-- a\nb\n-->\n<p>/*\n/* x\n-->", "-- a\nselect 1\r\n\r\n/* b */", "",
    "\n", "x\x0by\x1cz z\x85w", '"""a\n\'\'\'\n"""\nb',
]


@pytest.mark.parametrize("language", ["Python", "Java", "HTML", "SQL", "INI", "CSS", "Text"])
def test_comment_lines(spark, language):
    got = spark.createDataFrame([(s,) for s in SAMPLES], "t string").select(line_counts(F.col("t"), F.lit(language)).alias("n")).collect()
    assert [r.n.asDict() for r in got] == [plain_counts(s, language) for s in SAMPLES]


def commits(spark, days):
    rows = [(dt.date(2024, 1, d), "a", 1, 1, 1, "r") for d in days]
    return spark.createDataFrame(rows, "activity_date date, author_key string, repo_id long, insertions long, deletions long, repository string")


def test_streaks_and_gaps(spark):
    c = commits(spark, [1, 2, 3, 3, 7])
    assert tuple(activity.longest_streak(c).first()) == (3, dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    assert tuple(activity.longest_gap(c).first()) == (3, dt.date(2024, 1, 3), dt.date(2024, 1, 7))
    assert tuple(activity.longest_gap(commits(spark, [4])).first()) == (0, None, None)
    assert tuple(activity.longest_streak(commits(spark, [])).first()) == (0, None, None)
    assert activity.monthly(commits(spark, [])).count() == 0
    assert tuple(activity.work_time_shares(c.withColumns({"activity_weekday": F.lit(6), "activity_hour": F.lit(9)})).first()) == (1.0, 1.0)


def test_spread(spark):
    one = concentration(spark.createDataFrame([(10,), (5,), (5,), (0,)], "commits long")).first()
    assert (one.top_share, one.bus_factor_50, one.bus_factor_80) == (0.5, 1, 3)
    assert round(one.gini, 9) == 0.375 and round(one.hhi, 9) == 0.375
    empty = concentration(spark.createDataFrame([], "commits long")).first()
    assert tuple(empty) == (None, 0, 0, None, None)
    assert tuple(distribution(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v long"), F.col("v")).first())[:2] == (2.5, 2.5)
