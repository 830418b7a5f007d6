"""Analyses on literal commits."""

from datetime import date

import pytest

from commitlens.model import COMMITS, Options
from commitlens.operators import age, churn, communication, counts, coupling, effort
from commitlens.plans.analyses import ANALYSES
from commitlens.plans.present import REPORTS, present

SIMPLE = [("r1", "2024-01-01", "Alice", "foo.go", 5, 2), ("r1", "2024-01-01", "Alice", "bar.go", 1, 0), ("r2", "2024-01-02", "Bob", "foo.go", 3, 1)]
CHURN = [("r1", "2024-01-01", "Alice", "foo.go", 10, 5), ("r1", "2024-01-01", "Alice", "bar.go", 3, 1), ("r2", "2024-01-02", "Bob", "foo.go", 2, 8)]
LOOSE = Options(min_revs=1, min_shared_revs=1, min_coupling=0)


@pytest.fixture
def log(spark):
    def make(rows):
        full = [tuple(r) + ("", "", "", "", 0, 0)[len(r) :] if len(r) == 6 else (r[0], r[3] if len(r) > 3 else "2024-01-01", r[1], r[2], 0, 0) for r in rows]
        return spark.createDataFrame([(*r, i) for i, r in enumerate(full)], COMMITS)

    return make


def cells(frame):
    return [tuple(r) for r in frame.collect()]


def shown(frame, name, **kw):
    return cells(present(frame, name, **kw))


def test_revisions_summary_identity(log):
    commits = log(SIMPLE)
    assert shown(counts.revisions(commits), "revisions") == [("foo.go", "2"), ("bar.go", "1")]
    names = ["number-of-commits", "number-of-entities", "number-of-entities-changed", "number-of-authors"]
    assert shown(counts.summary(commits), "summary") == list(zip(names, "2232", strict=True))
    assert shown(counts.summary(commits.limit(0)), "summary") == list(zip(names, "0000", strict=True))
    assert shown(counts.identity(commits), "identity") == [(e, r, d, a, str(x), str(y)) for r, d, a, e, x, y in SIMPLE]


def test_churn(log):
    commits = log(CHURN)
    assert shown(churn.abs_churn(commits), "abs-churn") == [("2024-01-01", "13", "6", "1"), ("2024-01-02", "2", "8", "1")]
    assert shown(churn.author_churn(commits), "author-churn") == [("Alice", "13", "6", "1"), ("Bob", "2", "8", "1")]
    assert shown(churn.entity_churn(commits), "entity-churn") == [("foo.go", "12", "13", "2"), ("bar.go", "3", "1", "1")]
    assert shown(churn.entity_ownership(commits), "entity-ownership")[0] == ("bar.go", "Alice", "3", "1")
    assert shown(churn.main_dev(commits), "main-dev") == [("bar.go", "Alice", "3", "3", "100.00"), ("foo.go", "Alice", "10", "12", "83.33")]
    assert shown(churn.refactoring_main_dev(commits), "refactoring-main-dev")[1] == ("foo.go", "Bob", "8", "13", "61.54")


def test_ownership_of_nothing_is_zero_and_the_first_name_wins(log):
    commits = log([("r1", "d", "Bob", "x.png", 0, 0), ("r2", "d", "Al", "x.png", 0, 0)])
    assert shown(churn.main_dev(commits), "main-dev") == [("x.png", "Al", "0", "0", "0.00")]


def test_authors_count_distinct_revisions(log):
    commits = log([("r1", "Alice", "foo.go"), ("r2", "Bob", "foo.go"), ("r3", "Alice", "foo.go"), ("r1", "Alice", "bar.go"), ("r1", "Alice", "bar.go")])
    assert shown(counts.authors(commits), "authors") == [("foo.go", "2", "3"), ("bar.go", "1", "1")]


def test_effort(log):
    commits = log([("r1", "Alice", "foo"), ("r2", "Alice", "foo"), ("r1", "Bob", "foo"), ("r1", "Alice", "bar")])
    assert shown(effort.entity_effort(commits), "entity-effort") == [("bar", "Alice", "1", "1"), ("foo", "Alice", "2", "2"), ("foo", "Bob", "1", "2")]
    assert shown(effort.main_dev_by_revs(commits), "main-dev-by-revs")[1] == ("foo", "Alice", "2", "2", "100.00")
    split = log([("r1", "A", "one"), ("r2", "A", "one"), ("r1", "A", "two"), ("r2", "B", "two"), ("r1", "A", "all"), ("r1", "B", "all")])
    # authors who share a revision push the value under zero
    assert shown(effort.fragmentation(split), "fragmentation") == [("two", "0.50", "2"), ("one", "0.00", "2"), ("all", "-1.00", "1")]


def test_fragmentation_rounds_half_away_from_zero(log):
    revs = [(f"r{i}", "A" if i < 1 else "B", "x") for i in range(20)]
    assert cells(effort.fragmentation(log(revs))) == [("x", 0.1, 20)]  # 1 - (1 + 361) / 400 = 0.095


def test_coupling(log):
    commits = log([("r1", "A", "a"), ("r1", "A", "b"), ("r2", "A", "a"), ("r2", "A", "b"), ("r3", "A", "a"), ("r3", "A", "c")])
    assert shown(coupling.coupling(commits, LOOSE), "coupling") == [("a", "b", "80", "3"), ("a", "c", "50", "2")]
    verbose = Options(min_revs=1, min_shared_revs=1, min_coupling=0, verbose=True)
    assert shown(coupling.coupling(commits, verbose), "coupling", options=verbose)[0] == ("a", "b", "80", "3", "3", "2", "2")
    assert present(coupling.coupling(commits, verbose), "coupling", options=verbose).columns[-3:] == ["first-entity-revisions", "second-entity-revisions", "shared-revisions"]
    assert len(cells(coupling.coupling(commits, Options(min_revs=1, min_shared_revs=2, min_coupling=0)))) == 1
    assert cells(coupling.coupling(commits, Options())) == []
    assert shown(coupling.sum_of_coupling(commits), "soc") == [("a", "3"), ("b", "2"), ("c", "1")]
    # min_revs holds against the average, max_coupling against the floor of the degree
    assert len(cells(coupling.coupling(commits, Options(min_revs=2.5, min_shared_revs=1, min_coupling=0)))) == 1
    assert len(cells(coupling.coupling(commits, Options(min_revs=1, min_shared_revs=1, min_coupling=0, max_coupling=80)))) == 2


def test_large_changesets_are_dropped_but_single_files_count_zero(log):
    commits = log([("r1", "A", e) for e in "abc"] + [("r2", "A", "z")])
    two = Options(min_revs=1, min_shared_revs=1, min_coupling=0, max_changeset_size=2)
    assert cells(coupling.coupling(commits, two)) == []
    assert cells(coupling.sum_of_coupling(commits, two)) == [("z", 0)]


def test_truncated_degree(log):
    rows = [(f"s{i}", "A", e) for i in range(29) for e in "ab"] + [(f"x{i}", "A", "a") for i in range(71)] + [(f"y{i}", "A", "b") for i in range(71)]
    assert cells(coupling.coupling(log(rows), LOOSE)) == [("a", "b", 28, 100)]  # 29 / 100 * 100 is under 29


def test_communication(log):
    commits = log([("r1", "Alice", "foo"), ("r2", "Bob", "foo"), ("r3", "Alice", "bar"), ("r4", "Bob", "baz")])
    assert shown(communication.communication(commits), "communication") == [("Bob", "Alice", "1", "2", "50"), ("Alice", "Bob", "1", "2", "50")]
    rows = [("r", "Alice", e) for e in ("foo", "bar", "baz", "qux")] + [("s", "Bob", "foo"), ("s", "Bob", "x")]
    assert {r.strength for r in communication.communication(log(rows)).collect()} == {33}
    assert cells(communication.communication(log(rows[:4]))) == []


def test_age(log):
    commits = log([("r1", "A", "old.go", "2023-06-01"), ("r2", "A", "old.go", "2024-01-01"), ("r3", "A", "new.go", "2024-06-30"), ("r4", "A", "bad.go", "2024-01-01"), ("r5", "A", "bad.go", "2024-02-30"), ("r6", "A", "later.go", "2025-01-01")])
    assert shown(age.age(commits, date(2024, 7, 1)), "age") == [("later.go", "0"), ("new.go", "1"), ("old.go", "6")]


def test_limit_and_places(log, spark):
    commits = log(SIMPLE)
    assert len(shown(counts.revisions(commits), "revisions", rows=1)) == 1
    assert len(shown(counts.revisions(commits), "revisions", rows=-1)) == 2
    ties = spark.createDataFrame([("a", "m", 1, 1, 3.125), ("b", "m", 1, 1, 0.025), ("c", "m", 1, 1, 9.375)], "entity string, main_dev string, added long, total_added long, ownership double")
    assert [r[-1] for r in shown(ties, "main-dev")] == ["3.12", "0.03", "9.38"]
    assert set(ANALYSES) <= set(REPORTS)
