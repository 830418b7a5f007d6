"""The log scan, configuration readers, excludes, line counts, CSV and the command line."""

import io
import random
import subprocess

import pytest

from commitlens import cli
from commitlens.functions.patterns import exclude_regexes, java_regex
from commitlens.operators import loc
from commitlens.operators.transforms import apply_groups, apply_teams, exclude_log_lines, is_excluded
from commitlens.sources import producer, sinks
from commitlens.sources.gitlog import numstat, read_git_log
from commitlens.sources.specs import parse_groups, parse_teams

SAMPLE = "--abc123--2024-01-15--Alice\n10\t5\tsrc/foo.go\n3\t0\tsrc/bar.go\n\n--def456--2024-01-16--Bob\n-\t-\timage.png\n2\t1\tsrc/foo.go\n"


def scan(spark, path):
    return [tuple(r)[:-1] for r in read_git_log(spark, str(path)).orderBy("ord").collect()]


def test_sample_log(spark, tmp_path):
    (tmp_path / "log").write_text(SAMPLE)
    assert scan(spark, tmp_path / "log") == [
        ("abc123", "2024-01-15", "Alice", "src/foo.go", 10, 5), ("abc123", "2024-01-15", "Alice", "src/bar.go", 3, 0),
        ("def456", "2024-01-16", "Bob", "image.png", 0, 0), ("def456", "2024-01-16", "Bob", "src/foo.go", 2, 1),
    ]
    (tmp_path / "none").write_text("")
    (tmp_path / "head").write_text("--abc--2024-01-01--A\n")
    assert scan(spark, tmp_path / "none") == scan(spark, tmp_path / "head") == []


def plain_scan(text):
    """Line by line, with the header before the last malformed one."""
    rows, rev = [], None
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if line.startswith("--"):
            parts = line.split("--", 3)
            rev = tuple(parts[1:]) if len(parts) == 4 else rev
        elif rev and rev[0] and line.strip() and len(parts := line.split("\t", 2)) == 3:
            number = lambda s: int(s) if s.strip().lstrip("+-").isdigit() else 0
            rows.append((*rev, parts[2].strip(), number(parts[0]), number(parts[1])))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_random_logs(spark, tmp_path, seed):
    r = random.Random(seed)
    pieces = ["7\t8\tlost.go\n" if seed % 2 else ""]
    for i in range(400):
        bad = seed > 2 and r.random() < 0.1
        end = r.choice(["\n", "\r\n"])
        pieces.append(f"--r{i}--2024" + end if bad else f"--{'' if r.random() < 0.05 else f'r{i}'}--2024-01-0{i % 9 + 1}--{r.choice(['Al', 'B--C', 'Ünal'])}" + end)
        pieces += [f"{r.choice(['1', '-', 'x', '+2'])}\t{r.randrange(9)}\t{r.choice(['a.go', ' b.go ', 'c' + chr(9) + 'd'])}{end}" for _ in range(r.randrange(4))]
        pieces += r.choice([[], ["\n"], ["no tabs\n"]])
    text = "".join(pieces)
    (tmp_path / "log").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert scan(spark, tmp_path / "log") == plain_scan(text)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_groups(spark):
    rules = parse_groups(["# comment", "", "src/api => API", "src/core => Core", "^src/gen/ => Generated", "src/c++ => "])
    assert [n for _, n in rules] == ["API", "Core", "Generated", ""]
    for wrong in ("no arrow", "^[invalid => Bad", "^a(?=b) => Ahead"):
        with pytest.raises(ValueError):
            parse_groups([wrong])
    rows = spark.createDataFrame([(e,) for e in ("src/api/x", "src/core/y", "src/gen/z", "src/apis", "src/c++/w", "other")], "entity string")
    assert [r.entity for r in apply_groups(rows, rules).collect()] == ["API", "Core", "Generated"]
    assert apply_groups(rows, []) is rows
    assert apply_groups(rows, parse_groups(["src/api/ => Slash"])).count() == 0
    assert java_regex("^[[:alpha:]]+$") == r"^[\p{Alpha}]+$"


DIALECT = [
    (r"^src/c\++/", "src/c++/x", "src/c/x"), ("^[*+]x", "+x", "x"), (r"^src/\pL+$", "src/äb", "src/1"), (r"^\Qa.b\E/", "a.b/x", "aab/x"), (r"^\Qa.b", "a.b", "aab"),
    (r"^(?P<top>a|b)/(?:c|d)$", "b/c", "b/e"), ("^a{2,3}?b", "aab", "ab"), ("^[]a]b", "]b", "cb"), ("^[^[:digit:]_]$", "x", "1"), ("^[a&&b]$", "&", "c"), (r"^(?i)SRC\z", "src", "srcs"), (r"^[\pL-]+$", "a-b", "a1"),
]


def test_group_patterns_of_the_rules_dialect(spark):
    for pattern, yes, no in DIALECT:
        rows = spark.createDataFrame([(yes,), (no,)], "entity string")
        assert [r.entity for r in rows.filter(rows.entity.rlike(java_regex(pattern))).collect()] == [yes], pattern
    for wrong in ("^a(?=b)", "^(?<!a)b", r"^(a)\1", "^a**", "^a++", "^[a", "^(a", "^a)", "^*a", "^[[:none:]]", "^(?U)a+", "^[b-a]"):
        with pytest.raises(ValueError):
            java_regex(wrong)


def test_teams(spark):
    teams = parse_teams(["author,team\n", "# x\n", "Alice, Backend\n", "Bob,Old\n", "Bob,Frontend\n", "AUTHOR,Team\n"])
    assert teams == {"Alice": "Backend", "Bob": "Frontend"}
    rows = spark.createDataFrame([("r1", "Alice"), ("r2", "Bob"), ("r3", "Carol")], "rev string, author string")
    assert sorted(map(tuple, apply_teams(rows, teams).collect())) == [("r1", "Backend"), ("r2", "Frontend")]
    assert apply_teams(rows, {}) is rows
    with pytest.raises(ValueError):
        parse_teams(["a,b\n", "c\n"])


MATCHES = [
    ("vendor/github.com/foo/bar.go", "vendor/", True), ("vendor/foo.go", "vendor/", True), ("src/vendor/foo.go", "vendor/", False),
    ("src/api/types.pb.go", "*.pb.go", True), ("src/api/types.go", "*.pb.go", False), ("src/generated/types.pb.go", "src/generated/*.pb.go", True),
    ("src/other/types.pb.go", "src/generated/*.pb.go", False), ("go.sum", "go.sum", True), ("go.mod", "go.sum", False),
    ("a/b1.go", "b[0-9].go", True), ("a/bx.go", "b[^0-9].go", True), ("a/b1.go", "b[^0-9].go", False), ("a/b.go", "[", False), ("a/b*", "b\\*", True),
    ("a/b.go", "?.go", True), ("a/b.go", "a?b.go", False), ("a+b", "a+b", True), ("x]", "x]", True),
]


def test_exclude_patterns(spark):
    rows = spark.createDataFrame([(p,) for p in sorted({p for p, _, _ in MATCHES})], "path string")
    for pattern in sorted({q for _, q, _ in MATCHES}):
        got = {r.path: r.hit for r in rows.select("path", is_excluded("path", [pattern]).alias("hit")).collect()}
        for path, q, hit in MATCHES:
            if q == pattern:
                assert got[path] is hit, (path, pattern)
                assert (not list(producer.kept_lines([f"1\t2\t{path}\n"], [pattern]))) is hit, (path, pattern)
    assert exclude_regexes("vendor/") == ("vendor/", None)


def test_log_lines_keep_headers_and_ends(spark):
    lines = ["--a--2024-01-01--A", "1\t2\tvendor/x.go\r\n", "1\t2\tsrc/x.go\r\n", "", "vendor/ words"]
    wanted = [lines[0], *lines[2:]]
    assert list(producer.kept_lines(lines, ["vendor/"])) == wanted
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.value for r in exclude_log_lines(frame, ["vendor/"]).collect()] == wanted


def test_line_counts(spark):
    go = "package main\n\n// Doc comment\nfunc main() {\n\t/* a\n\n b */\n}\n"
    files = [("src/main.go", go), ("vendor/lib.go", "x\ny\n"), ("Makefile", "# c\nall:\n"), ("a.py", '"""doc\nmore\n"""\nx = 1'), ("empty.go", ""), ("notes.unknown", "x"), ("two.go", "x\n\n")]
    counts = loc.count_lines(spark.createDataFrame(files, "file string, text string"))
    got = {r.file: tuple(r)[1:] for r in counts.collect()}
    assert got == {"src/main.go": ("Go", 2, 3, 3), "vendor/lib.go": ("Go", 0, 0, 2), "Makefile": ("Makefile", 0, 1, 1), "a.py": ("Python", 0, 3, 1), "empty.go": ("Go", 0, 0, 0), "two.go": ("Go", 1, 0, 1)}
    sums = {r.language: (r.files, r.blank, r.comment, r.code) for r in loc.by_language(loc.exclude_files(counts, ["vendor/"])).collect()}
    assert sums["Go"] == (3, 3, 3, 4) and sums["TOTAL"] == (5, 3, 7, 6)


def test_csv(spark):
    rows = spark.createDataFrame([("a,b", 'say "x"'), (" lead", "plain"), ("two\nlines", r"\.")], "one string, two string").coalesce(1)
    to = io.StringIO()
    sinks.write_csv(rows, to)
    assert to.getvalue() == 'one,two\n"a,b","say ""x"""\n" lead",plain\n"two\nlines","\\."\n'


def test_files_wherever_spark_reads(spark, tmp_path):
    (tmp_path / "a[1]").mkdir()
    for name, data in (("a[1]/x*.go", b"x\n"), ("b.go", b"\0binary"), ("c{}.py", "é\n".encode())):
        (tmp_path / name).write_bytes(data)
    for top in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        every = {r.file: r.text for r in producer.texts_under(spark, top).collect()}
        assert every == {"a[1]/x*.go": "x\n", "c{}.py": "é\n"}
    named = producer.texts_under(spark, f"file://{tmp_path}", ["a[1]/x*.go", "b.go"]).collect()
    assert [(r.file, r.text) for r in named] == [("a[1]/x*.go", "x\n")] and producer.texts_under(spark, "file:///x", []).count() == 0


def test_numbers_beyond_64_bits_are_held_to_them(spark):
    rows = spark.createDataFrame([(x,) for x in ("9" * 30, "-" + "9" * 30, " +7 ", "-", "x", "")], "text string")
    assert [r.n for r in rows.select(numstat("text").alias("n")).collect()] == [(1 << 63) - 1, -(1 << 63), 7, 0, 0, 0]


def test_csv_to_any_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ä"), ("b", "2"), ("c", "3")], "one string, two string").coalesce(1)
    for path in (str(tmp_path / "1.csv"), f"file://{tmp_path}/2.csv"):
        sinks.write_csv_file(rows.limit(2), path)
        assert open(path.removeprefix("file://"), encoding="utf-8").read() == "one,two\na,ä\nb,2\n"


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Al", "-c", "user.email=a@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    (root / "sub").mkdir()
    (root / "main.go").write_text("package main\n\n// x\nfunc main() {\n}\n")
    (root / "sub/b.go").write_text("package b\n")
    (root / "untracked.go").write_text("x\n")
    git("add", "main.go", "sub/b.go")
    git("commit", "-qm", "one")
    return root


def test_command_line(spark, repository, tmp_path, capsys):
    log = tmp_path / "log"
    assert cli.main(["generate-log", "--path", str(repository), "-o", str(log)]) == 0
    assert f"Log written to {log}" in capsys.readouterr().err
    assert "\tmain.go" in log.read_text() and log.read_text().startswith("--")
    assert cli.main(["revisions", "-l", str(log)]) == 0
    assert capsys.readouterr().out == "entity,n-revs\nmain.go,1\nsub/b.go,1\n"
    groups, teams, out = tmp_path / "g", tmp_path / "t", tmp_path / "out.csv"
    groups.write_text("sub => Sub\n")
    teams.write_text("author,team\nAl,Core\n")
    assert cli.main(["main-dev", "-l", str(log), "-g", str(groups), "-p", str(teams), "-o", str(out)]) == 0
    assert out.read_text() == "entity,main-dev,added,total-added,ownership\nSub,Core,1,1,100.00\n"
    assert cli.main(["coupling", "-l", str(log), "-n", "1", "-m", "1", "--verbose-results", "-r", "1"]) == 0
    assert capsys.readouterr().out.splitlines()[1] == "main.go,sub/b.go,100,1,1,1,1"
    assert cli.main(["cloc", "--path", str(repository / "sub")]) == 0
    assert capsys.readouterr().out == "Language,Files,Blank,Comment,Code\nGo,2,1,1,4\nTOTAL,2,1,1,4\n"
    assert cli.main(["cloc", "--path", str(repository), "--by-file", "--exclude", "sub/"]) == 0
    assert capsys.readouterr().out == "File,Language,Blank,Comment,Code\nmain.go,Go,1,1,3\n"
    assert cli.main(["authors"]) == 1 and cli.main(["age", "-l", str(log), "-d", "2024-1-5"]) == 1 and cli.main(["cloc", "--path", str(tmp_path)]) == 1
    assert "needs a log file" in capsys.readouterr().err
