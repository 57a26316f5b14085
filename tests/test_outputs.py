"""Files that are whole or not there, reports read back, natural order and display slices."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark import queries
from tidemark.functions.labels import human_int, human_percent, stored_list
from tidemark.operators import repositories
from tidemark.operators.explore import sorted_view
from tidemark.plans import report, stored
from tidemark.sinks import files


def read(path):
    with open(path, encoding="utf-8-sig", newline="") as file:
        return list(csv.reader(file))


def test_csv(spark, tmp_path):
    rows = [(k, f'a "{k}", b\nc', None if k % 3 else "", k % 2 == 0, [{"x": str(k)}], "  padded ") for k in range(500)]
    df = spark.createDataFrame(rows, "n long, `t,x` string, e string, b boolean, l array<map<string,string>>, p string").repartition(7).orderBy(F.desc("n"))
    got = read(files.write_csv(df, tmp_path / "out" / "a.csv"))
    assert got[0] == ["n", "t,x", "e", "b", "l", "p"] and len(got) == 501
    assert got[1:] == [[str(k), f'a "{k}", b\nc', "", "true" if k % 2 == 0 else "false", json.dumps([{"x": str(k)}], separators=(",", ":")), "  padded "] for k in range(499, -1, -1)]
    assert (tmp_path / "out/a.csv").read_bytes().startswith(b"\xef\xbb\xbfn,") and b"\r\n" in (tmp_path / "out/a.csv").read_bytes()
    assert read(files.write_csv(df.where("false"), tmp_path / "none.csv")) == [["no_data"]]


def test_a_failed_csv_leaves_the_target_alone(spark, tmp_path, monkeypatch):
    target = files.write_csv(spark.range(3), tmp_path / "a.csv")
    before = target.read_bytes()
    with pytest.raises(Exception, match="broken"):  # the job fails
        files.write_csv(spark.range(3).select(F.raise_error(F.lit("broken"))), target)

    def cut(*_):
        yield b"0\r\n"
        raise OSError("full")

    monkeypatch.setattr(files, "pieces", cut)  # the copy fails midway
    with pytest.raises(OSError, match="full"):
        files.write_csv(spark.range(3), target)
    with pytest.raises(OSError, match="full"):
        files.write_csv_bundle({"daily": spark.range(3)}, tmp_path / "bundle")
    assert target.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["a.csv"]
    monkeypatch.undo()
    written = files.write_csv_bundle({"daily": spark.range(3)}, tmp_path / "bundle")
    assert {p.name for p in written} == set(files.BUNDLE) == {p.name for p in (tmp_path / "bundle").iterdir()}
    files.write_csv_bundle({"daily": spark.range(2)}, tmp_path / "bundle")
    assert read(tmp_path / "bundle/activity_daily.csv") == [["id"], ["0"], ["1"]] and read(tmp_path / "bundle/summary.csv") == [["no_data"]]


def test_stored_reports(spark, tmp_path, capsys):
    path = tmp_path / "r.json"
    summary = spark.createDataFrame([(1, 0, 12, "x")], "failed_repositories long, dormant_repositories long, days_since_last_commit int, other string")
    errors = spark.createDataFrame([(1, "/p", "scan", "m")], "run_id long, path string, stage string, message string")
    files.write_json({"summary": summary, "errors": errors}, path)
    rows = {r.metric: (r.value, r.status) for r in stored.check_stored(spark, str(path), {"failed_repositories": 0, "scan_errors": 1, "dormant_repositories": 0}).collect()}
    assert rows == {"failed_repositories": (1, "failed"), "scan_errors": (1, "passed"), "dormant_repositories": (0, "passed")}
    assert stored.main([str(path), "--max-scan-errors", "1"], spark) == 0 and stored.main([str(path), "--max-failed-repositories", "0"], spark) == 2
    assert "passed" in capsys.readouterr().out
    path.write_text(json.dumps({"summary": [{"failed_repositories": "many"}]}))
    assert {r.status for r in stored.check_stored(spark, str(path), {"failed_repositories": 9, "scan_errors": 9}).collect()} == {"unavailable"}
    for text in ("{", "[]", '{"summary": 3}', "", '{"other": []}'):
        path.write_text(text)
        assert stored.main([str(path), "--max-scan-errors", "1"], spark) == 1, text
    assert stored.main([str(path)], spark) == 1 and stored.main([str(path), "--max-scan-errors", "-1"], spark) == 1


def test_natural_order(spark):
    want = ["-3", "2", "10", "010x", "Äpfel 2", "apfel 10", "repo9", "Repo10", "repo 10b".replace(" ", ""), "v1.9.0", "v1.10.0", "zebra"]
    df = spark.createDataFrame([(w,) for w in sorted(want)] + [(None,)], "name string").repartition(3)
    got = [r[0] for r in sorted_view(df, "name").collect()]
    assert [g for g in got if g is not None] == want
    assert [r[0] for r in sorted_view(spark.range(5), "id", descending=True).collect()] == [4, 3, 2, 1, 0]


def test_words_for_numbers_and_stored_lists(spark):
    df = spark.createDataFrame([(1234567, 0.12345, '["a", "b"]'), (None, None, "not json"), (-5, 12.0, "[1, null]")], "n long, p double, t string")
    got = [tuple(r) for r in df.select(human_int(F.col("n")), human_percent(F.col("p")), stored_list(F.col("t"))).collect()]
    assert got == [("1.234.567", "12,3%", ["a", "b"]), ("–", "–", []), ("-5", "1200,0%", ["1"])]


def test_display_slices(spark):
    months = spark.createDataFrame([(f"2024-{k:02d}", k) for k in range(1, 13)], "month string, commits int")
    shown = report.displayed({"monthly": months, "hot_files": spark.range(40), "summary": spark.range(1)}, {"report": {"top_n": 5, "timeline_months": 3}})
    assert [r.month for r in shown["monthly"].collect()] == ["2024-10", "2024-11", "2024-12"] and shown["hot_files"].count() == 5 and shown["summary"].count() == 1


def test_profiles_fail_closed_when_they_are_read(spark):
    a = queries.a
    repos, privacy = a.repositories(spark, SF), a.privacy(spark, SF)
    public = repositories.public_repositories(repos, privacy)
    assert public.count() > 0 and "_fault" not in public.columns
    name = public.first()["display_name"]
    assert [r.display_name for r in repositories.public_repositories(repos, privacy, [name.upper()]).collect()] == [name]
    made = repositories.public_repositories(repos, privacy, ["elsewhere", name])
    with pytest.raises(Exception, match="not public: elsewhere"):
        made.collect()
    with pytest.raises(Exception, match="no public repository"):
        repositories.public_repositories(repos, privacy.where("false")).collect()
