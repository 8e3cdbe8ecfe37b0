"""Command line: ``scan`` and ``clean``. Exit codes: 0 done, 1 error, 2 a file reaches the level of --fail-on."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docveil import __version__
from docveil.operators import dims
from docveil.operators import findings as fo
from docveil.plans import cleaning, inspect
from docveil.sources.facts import read_files, refused

EXTRA = {"custom_data": "office-customxml", "neutralize_links": "office-external-links", "accept_changes": "office-accept-changes"}


FAIL_ON = [level for level in dims.LEVEL_RANK if level != "clear"]


class Parser(argparse.ArgumentParser):
    """Exits with 1 on bad arguments: 2 says that a file reaches the level of --fail-on."""

    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = Parser(prog="docveil")
    p.add_argument("-v", "--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command")
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="+")
    s.add_argument("--json", action="store_true")
    s.add_argument("--markdown", action="store_true")
    s.add_argument("--fail-on", metavar="LEVEL")
    c = sub.add_parser("clean")
    c.add_argument("path")
    c.add_argument("--out")
    for flag in ("properties", "comments", "thumbnail", "custom-data", "neutralize-links", "accept-changes", "force-signed", "force-provenance"):
        c.add_argument(f"--{flag}", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 0
    if getattr(args, "fail_on", None) is not None and args.fail_on not in FAIL_ON:
        print(f"--fail-on must be one of: {', '.join(FAIL_ON)}.", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("docveil").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    paths = args.paths if args.command == "scan" else [args.path]
    if bad := refused(spark, *paths).head():
        print(f"{bad['file_id']}: the file is {bad['error']}", file=sys.stderr)
        return 1
    s = inspect.scan(read_files(spark, *paths))
    if args.command == "scan":
        rows = inspect.reports(s)
        if args.json:
            found = [r["json"] for r in inspect.json_reports(rows, pretty=True).orderBy("file_id").toLocalIterator()]
            print(found[0] if len(found) == 1 else "[" + ",\n".join(found) + "]")
        elif args.markdown:
            print("\n\n".join(r["markdown"] for r in inspect.markdown_reports(rows).orderBy("file_id").toLocalIterator()))
        else:
            for r in inspect.console_lines(rows).orderBy("file_id").toLocalIterator():
                print(r["line"])
            n, total = s.summary.agg(F.count("*"), F.sum("actionable")).first()
            print(f"{n} file(s), {total} finding(s) to act on")
        return 2 if args.fail_on and fo.gate(s.summary, args.fail_on).first()["failed"] else 0
    kind = s.types.first()["kind"]
    actions = ["office-properties", "office-comments", "office-thumbnail", *(a for f, a in EXTRA.items() if getattr(args, f))] if kind == "ooxml" else ["image-metadata"]
    row = cleaning.clean(s, actions, args.force_signed, args.force_provenance).first()
    if row["error"]:
        print(row["error"], file=sys.stderr)
        return 1
    out = Path(args.out) if args.out else Path(args.path).with_name(f"{Path(args.path).stem}.safe{Path(args.path).suffix}")
    out.write_bytes(row["content"])
    print(f"{out}\nFindings: {row['original_findings']} → {row['sanitized_findings']}\nSame content: {row['same_content']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
