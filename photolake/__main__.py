"""Command line: ``python -m photolake [--library DIR] COMMAND``."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from photolake import __version__
from photolake.operators import detect, manifest
from photolake.options import Options
from photolake.plans.library import Library


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("photolake")
    p.add_argument("--library", default=os.path.expanduser("~/.photolake"))
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("scan").add_argument("roots", nargs="+")
    a = c.add_parser("analyze")
    a.add_argument("--near-dist", type=int, default=6)
    a.add_argument("--subject-min", type=int, default=5)
    a.add_argument("--blur-threshold", type=float, default=120)
    a.add_argument("--no-learn", action="store_true")
    a.add_argument("--overrides")
    c.add_parser("tag").add_argument("-i", "--input", required=True)
    d = c.add_parser("decide")
    d.add_argument("image_id", type=int)
    d.add_argument("action", choices=("delete", "keep", "clear"))
    c.add_parser("summary")
    c.add_parser("groups").add_argument("category")
    e = c.add_parser("export")
    e.add_argument("-o", "--output", required=True)
    e.add_argument("--format", choices=("json", "csv"), default="json")
    c.add_parser("dupes")
    c.add_parser("version").add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(json.dumps({"version": __version__}) if args.json else __version__)
        return
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    library = Library(spark, args.library)
    if args.command == "scan":
        print(json.dumps(library.scan(*args.roots)))
    elif args.command == "analyze":
        counts, log = library.analyze(Options(near_dist=args.near_dist, subject_min=args.subject_min, blur_threshold=args.blur_threshold, no_learn=args.no_learn), args.overrides)
        print(*log, json.dumps(dict(sorted(counts.items()))), sep="\n")
    elif args.command == "tag":
        print(library.tag(args.input))
    elif args.command == "decide":
        library.decide(args.image_id, args.action)
    elif args.command == "summary":
        print(library.summary().toJSON().first())
    elif args.command == "groups":
        for line in library.groups(args.category).orderBy("cluster_id").toJSON().toLocalIterator():
            print(line)
    elif args.command == "export":
        if args.format == "json":
            print(manifest.write_json(library.manifest(), args.output))
        else:
            manifest.write_csv(library.manifest(), args.output)
    elif args.command == "dupes":
        for row in detect.duplicate_report(library.images.read()).orderBy("sha256").toLocalIterator():
            print(row["sha256"], *row["paths"], sep="\n  ")


if __name__ == "__main__":
    main()
