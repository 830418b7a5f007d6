"""Command line: ``python -m commitlens.cli ANALYSIS --log FILE``, ``generate-log``, ``cloc``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from commitlens.model import Options
from commitlens.operators import loc
from commitlens.operators.age import undated
from commitlens.operators.transforms import apply_groups, apply_teams
from commitlens.plans.analyses import ANALYSES
from commitlens.plans.present import present
from commitlens.sources import producer, sinks
from commitlens.sources.gitlog import read_git_log
from commitlens.sources.specs import read_groups, read_teams


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-l", "--log", default="", help="log file")
    common.add_argument("-o", "--outfile", default="", help="write here rather than to standard output")
    common.add_argument("-r", "--rows", type=int, default=0, help="at most so many rows (0: all)")
    common.add_argument("-g", "--group", default="", help="file of architectural groups")
    common.add_argument("-p", "--team-map-file", default="", help="CSV of authors and teams")
    top = argparse.ArgumentParser(prog="commitlens")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ANALYSES:
        c = commands.add_parser(name, parents=[common])
        if name == "age":
            c.add_argument("-d", "--age-time-now", default="", help="YYYY-MM-DD, today by default")
        if name in ("coupling", "soc"):
            c.add_argument("-n", "--min-revs", type=int, default=Options.min_revs)
            c.add_argument("-m", "--min-shared-revs", type=int, default=Options.min_shared_revs)
            c.add_argument("-i", "--min-coupling", type=float, default=Options.min_coupling)
            c.add_argument("-x", "--max-coupling", type=float, default=Options.max_coupling)
            c.add_argument("-s", "--max-changeset-size", type=int, default=Options.max_changeset_size)
        if name == "coupling":
            c.add_argument("--verbose-results", action="store_true")
    log = commands.add_parser("generate-log", parents=[common])
    log.add_argument("--after", default="")
    count = commands.add_parser("cloc", parents=[common])
    count.add_argument("--by-file", action="store_true")
    for c in (log, count):
        c.add_argument("--path", default=".")
        c.add_argument("--exclude", action="append", default=[])
    return top


def options_of(args: argparse.Namespace) -> Options:
    given = {k: getattr(args, k) for k in ("min_revs", "min_shared_revs", "min_coupling", "max_coupling", "max_changeset_size") if hasattr(args, k)}
    if text := getattr(args, "age_time_now", ""):
        try:
            given["age_time_now"] = datetime.strptime(text, "%Y-%m-%d").date()
            if len(text) != 10:
                raise ValueError
        except ValueError:
            raise ValueError(f"{text!r} is no day for --age-time-now, which takes YYYY-MM-DD") from None
    return Options(**given, verbose=getattr(args, "verbose_results", False))


def session() -> SparkSession:
    spark = SparkSession.builder.appName("commitlens").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(args: argparse.Namespace) -> None:
    if args.command == "generate-log":
        lines = producer.git_log(args.path, args.after, args.exclude)
        if args.outfile:
            with open(args.outfile, "w", encoding="utf-8", errors="surrogateescape", newline="") as to:
                to.writelines(lines)
            print(f"Log written to {args.outfile}", file=sys.stderr)
        else:
            sys.stdout.writelines(lines)
        return
    options = options_of(args)
    if args.command == "cloc":
        files = loc.exclude_files(producer.tracked_texts(session(), args.path), args.exclude)
        counts = loc.count_lines(files)
        if left := loc.unknown_files(files).count():
            print(f"left out: {left} files of languages that aren't known", file=sys.stderr)
        report = present(loc.by_file(counts), "cloc-by-file", args.rows) if args.by_file else present(loc.by_language(counts), "cloc", args.rows)
    else:
        if not args.log:
            raise ValueError(f"{args.command} needs a log file: --log or -l")
        commits = read_git_log(session(), args.log)
        commits = apply_groups(commits, read_groups(args.group)) if args.group else commits
        commits = apply_teams(commits, read_teams(args.team_map_file)) if args.team_map_file else commits
        if args.command == "age":
            for row in undated(commits).orderBy("entity").toLocalIterator():
                print(f"warning: no age for {row['entity']!r}, whose last date is {row['last']!r}", file=sys.stderr)
        report = present(ANALYSES[args.command](commits, options), args.command, args.rows, options)
    if args.outfile:
        sinks.write_csv_file(report, args.outfile)
    else:
        sinks.write_csv(report)


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except (ValueError, RuntimeError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
