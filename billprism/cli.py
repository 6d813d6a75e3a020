"""Command line: validate, extract, leitweg, rules.

Exit codes: 0 all valid, 1 something is invalid (or has warnings with --warnings-as-errors, or is no valid Leitweg-ID), 2 the command could not run: wrong
usage, a file that cannot be read, a PDF without an invoice, a rule set that is not there. Other files are still checked where one cannot be read.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

OK, INVALID, ERROR = 0, 1, 2


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rulesets(files: list[str]):
    """Each file is a rule set named after it; files beside it may be included."""
    from .plans.schematron import Ruleset

    out = []
    for f in files:
        near = {str(p.relative_to(base)) if base == Path(f).parent else f"../{p.name}": p.read_text("utf-8") for base in (Path(f).parent, Path(f).parent.parent) for p in base.glob("*.sch")}
        out.append(Ruleset.from_text(Path(f).read_text("utf-8"), Path(f).stem, near))
    return out


def main(argv: list[str] | None = None) -> int:
    from . import __version__

    parser = argparse.ArgumentParser("billprism", exit_on_error=False)
    parser.add_argument("--version", action="store_true")
    commands = parser.add_subparsers(dest="command")
    v = commands.add_parser("validate", exit_on_error=False)
    v.add_argument("files", nargs="+")
    v.add_argument("--rules", action="append", default=[], help="a Schematron file; its name is the rule set's id; without one the built-in rule sets are there")
    v.add_argument("--rule-sets", help="rule sets to apply instead of those of the profile, with commas between, each with a version behind @ or without")
    v.add_argument("--schema", action="append", default=[], metavar="SYNTAX=FILE", help="the main XML Schema file for ubl or cii; files beside and above it may be imported")
    v.add_argument("--no-schema", action="store_true")
    v.add_argument("--json", action="store_true")
    v.add_argument("--no-leitweg", action="store_true")
    v.add_argument("--strict-extended", action="store_true")
    v.add_argument("--warnings-as-errors", action="store_true")
    v.add_argument("--quiet", action="store_true", help="a line per file")
    v.add_argument("--lang", choices=("en", "de"), default="en")
    e = commands.add_parser("extract", exit_on_error=False)
    e.add_argument("file")
    e.add_argument("--out")
    w = commands.add_parser("leitweg", exit_on_error=False)
    w.add_argument("id")
    r = commands.add_parser("rules", exit_on_error=False)
    r.add_argument("files", nargs="*", help="Schematron files; without one the built-in rule sets")
    r.add_argument("--json", action="store_true")
    try:
        args = parser.parse_args(argv)
    except argparse.ArgumentError as error:
        print(error, file=sys.stderr)
        return ERROR
    except SystemExit as asked:  # --help ends with 0
        return ERROR if asked.code else OK
    if args.version:
        print(__version__)
        return OK
    if not args.command:
        parser.print_usage(sys.stderr)
        return ERROR
    try:
        return globals()[f"_{args.command}"](args)
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return ERROR


def _schemas(given: list[str]) -> dict:
    from .plans.schema import Schema

    out = {}
    for text in given:
        syntax, _, file = text.partition("=")
        if syntax not in ("ubl", "cii") or not file:
            raise ValueError(f"--schema {text}: ubl=FILE or cii=FILE is expected")
        base = Path(file).parent
        texts = {str(p.relative_to(base, walk_up=True)): p.read_text("utf-8") for folder in (base, base.parent) for p in folder.rglob("*.xsd")}
        out[syntax] = Schema.from_texts(texts, Path(file).name)
    return out


def _validate(args) -> int:
    from pyspark import StorageLevel

    from .api import Options, RulesetError, report, validate
    from .sources.documents import from_list

    spark = _session()
    asked = [x.strip() for x in args.rule_sets.split(",") if x.strip()] if args.rule_sets else None
    options = Options(asked, not args.no_leitweg, "strict" if args.strict_extended else "lenient", {} if args.no_schema else _schemas(args.schema), lang=args.lang)
    try:
        found = validate(from_list(spark, args.files), _rulesets(args.rules) or None, options)
    except RulesetError as error:
        print(f"SUM-RULESET: {error}", file=sys.stderr)
        return ERROR
    found.results = found.results.persist(StorageLevel.DISK_ONLY)  # lines and counts come from one evaluation
    try:
        rows = found.results.orderBy("input_idx")
        for line in (rows.toJSON().toLocalIterator() if args.json else (r["text"] for r in report(found, args.lang, args.quiet).orderBy("input_idx").toLocalIterator())):
            print(line)
        counts = found.results.selectExpr("count_if(read_error is not null) as unread", "count_if(not valid) as bad", "count_if(size(warnings) > 0) as warned").first()
    finally:
        found.results.unpersist()
        found.close()
    return ERROR if counts["unread"] else INVALID if counts["bad"] or (args.warnings_as_errors and counts["warned"]) else OK


def _extract(args) -> int:
    from .sources.documents import PdfError, embedded_invoice, read_pdf

    try:
        got = embedded_invoice(read_pdf(Path(args.file).read_bytes()))
    except (OSError, PdfError) as error:
        print(error, file=sys.stderr)
        return ERROR
    if got is None:
        print("no embedded invoice", file=sys.stderr)
        return ERROR
    if args.out:
        Path(args.out).write_text(got[0], "utf-8")
    else:
        print(got[0])
    return OK


def _leitweg(args) -> int:
    from pyspark.sql import functions as F

    from .functions import xp

    ok = _session().range(1).select(xp.leitweg_ok(F.lit(args.id)).alias("ok")).first()["ok"]
    print("valid" if ok else "invalid")
    return OK if ok else INVALID


def _rules(args) -> int:
    import json

    from .api import builtin

    for rs in _rulesets(args.files) if args.files else builtin():
        for row in rs.catalog():
            print(json.dumps(dict(zip(("rule_set", "pattern", "rule", "assert", "id", "flag", "context", "test"), row, strict=True))) if args.json else f"{row[0]:24} {row[5]:12} {row[4]}")
    return OK


if __name__ == "__main__":
    sys.exit(main())
