"""Reachability over tables equals a walk over dictionaries, and what git itself finds."""

import random

import pytest

from tests.test_sources import run
from tidemark.config import settings
from tidemark.operators.reachability import chains, reachable, trusted
from tidemark.sources import git_history


def walk(parents, tips):
    seen, waiting = set(), [t for t in tips if t in parents]
    while waiting:
        at = waiting.pop()
        if at not in seen:
            seen.add(at)
            waiting += [p for p in parents[at] if p in parents]
    return seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_histories(spark, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    tips = []
    for repo in range(3):
        parents = {}
        for k in range(60):
            mine = [f"c{p}" for p in dict.fromkeys(rng.choice([max(0, k - 1), rng.randint(0, max(0, k - 1))]) for _ in range(rng.choice([1, 1, 1, 2, 3])))] if k else []
            parents[f"c{k}"] = mine if rng.random() < 0.97 else [*mine, "lost"]
        own = rng.sample(sorted(parents), 3) + ["nowhere"]
        rows += [(repo, h, p) for h, p in parents.items()]
        tips += [(repo, t) for t in own]
        want |= {(repo, h) for h in walk(parents, own)}
    graph = spark.createDataFrame(rows, "repo_id long, hash string, parents array<string>")
    got = [tuple(r) for r in reachable(graph, spark.createDataFrame(tips, "repo_id long, hash string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    placed = chains(graph).collect()
    assert len({(r.repo_id, r.chain, r.place) for r in placed}) == len(placed) == 180


def test_a_long_line_and_nothing(spark):
    graph = spark.createDataFrame([(1, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(300)], "repo_id long, hash string, parents array<string>")
    tips = spark.createDataFrame([(1, "c250")], "repo_id long, hash string")
    assert reachable(graph, tips).count() == 251
    assert reachable(graph, tips.where("false")).count() == 0 and reachable(graph.where("false"), tips).count() == 0


def test_trusted_commits_are_those_of_git(spark, tmp_path):
    far, near = tmp_path / "far", tmp_path / "near"
    far.mkdir()
    run(far, "init", "-q", "-b", "main")
    for k in range(3):
        run(far, "commit", "-q", "--allow-empty", "-m", f"m{k}")
    run(far, "checkout", "-q", "-b", "side", "HEAD~1")
    run(far, "commit", "-q", "--allow-empty", "-m", "s")
    run(far, "checkout", "-q", "main")
    run(far, "merge", "-q", "--no-ff", "-m", "merge", "side")
    run(tmp_path, "clone", "-q", str(far), str(near))
    run(near, "commit", "-q", "--allow-empty", "-m", "own")
    run(near, "checkout", "-q", "-b", "topic", "HEAD~2")
    run(near, "commit", "-q", "--allow-empty", "-m", "topic")
    s = settings({"history": {"scope": "all"}})
    read = {what: git_history.scan(spark, what, [(1, str(near)), (2, str(far))], s) for what in ("log", "graph", "refs")}
    want = {(r.repo_id, r.hash) for r in read["log"].where("is_trusted").collect()}
    assert len(want) == 5 and read["log"].where("repo_id = 1").count() == 7
    assert {tuple(r) for r in trusted(read["graph"], read["refs"]).collect()} == want
