"""Queries and dataset jobs from the command line.

    python -m kerbside                                      the names of the queries
    python -m kerbside NAME TABLES [--out F] [--limit N]    run one
    python -m kerbside convert FOLDER --as NAME --in train=a.json val=b.json [--member M] [--prefix P] [--max-side N]
    python -m kerbside resplit FOLDER [--share S] [--seed N]
    python -m kerbside audit FOLDER
    python -m kerbside complete FOLDER --detections PARQUET --sizes PARQUET --teacher-class N --class N [--prefix P] [--score S]
    python -m kerbside report FOLDER
    python -m kerbside sources CATALOGUE.yaml [NAME ...] [--all]   list them, or fetch those named
"""

from __future__ import annotations

import argparse
import json
import sys

from kerbside import commands
from kerbside.plans.catalogue import QUERIES
from kerbside.session import build_session


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    if arguments and arguments[0] in JOBS:
        return JOBS[arguments[0]](arguments[1:])
    return query(arguments)


def query(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="kerbside", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("name", nargs="?", help="a query")
    parser.add_argument("tables", nargs="?", help="the folder of the Parquet tables")
    parser.add_argument("--out", help="write the result there as Parquet instead of showing it")
    parser.add_argument("--limit", type=int, default=20, help="rows to show")
    given = parser.parse_args(arguments)
    if not given.name:
        print("\n".join(sorted(QUERIES)))
        return 0
    if given.name not in QUERIES or not given.tables:
        parser.error("name a query of the list and the folder of the tables")
    made = QUERIES[given.name](build_session(), given.tables)
    if given.out:
        made.write.mode("overwrite").parquet(given.out)
    else:
        made.show(given.limit, truncate=False)
    return 0


def _folder(job: str) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog=f"kerbside {job}")
    parser.add_argument("folder", help="the dataset")
    return parser


def _told(result: object) -> int:
    print(json.dumps(result, indent=2))
    return 0


def convert(arguments: list[str]) -> int:
    parser = _folder("convert")
    parser.add_argument("--as", dest="name", required=True, help="the batch, which is added once")
    parser.add_argument("--in", dest="inputs", nargs="+", required=True, metavar="SPLIT=PATH")
    parser.add_argument("--member", help="the annotation file inside archives")
    parser.add_argument("--prefix", default="")
    parser.add_argument("--max-side", type=int, default=1280)
    parser.add_argument("--drop-negatives", action="store_true")
    given = parser.parse_args(arguments)
    inputs = dict(i.split("=", 1) for i in given.inputs if "=" in i)
    if len(inputs) != len(given.inputs):
        parser.error("every input is SPLIT=PATH, one a split")
    return _told(commands.convert(build_session(), given.folder, inputs, given.name, member=given.member, prefix=given.prefix, max_side=given.max_side, keep_negatives=not given.drop_negatives))


def resplit(arguments: list[str]) -> int:
    parser = _folder("resplit")
    parser.add_argument("--share", type=float, default=0.27)
    parser.add_argument("--seed", type=int, default=0)
    given = parser.parse_args(arguments)
    return _told(commands.resplit(build_session(), given.folder, given.share, given.seed))


def audit(arguments: list[str]) -> int:
    """1 where a leak was found."""
    row = commands.audit(build_session(), _folder("audit").parse_args(arguments).folder)
    _told(row)
    return int(row["leaked"])


def complete(arguments: list[str]) -> int:
    parser = _folder("complete")
    parser.add_argument("--detections", required=True, help="Parquet: stem, class_id, score, x1, y1, x2, y2")
    parser.add_argument("--sizes", required=True, help="Parquet: stem, width, height")
    parser.add_argument("--teacher-class", type=int, required=True)
    parser.add_argument("--class", dest="cls", type=int, required=True)
    parser.add_argument("--prefix", default="")
    parser.add_argument("--score", type=float, default=0.55)
    given = parser.parse_args(arguments)
    spark = build_session()
    found, sizes = (spark.read.parquet(p) for p in (given.detections, given.sizes))
    return _told(commands.complete(spark, given.folder, found, sizes.select("stem", "width", "height"), given.teacher_class, given.cls, given.prefix, given.score))


def report(arguments: list[str]) -> int:
    print(commands.report(build_session(), _folder("report").parse_args(arguments).folder))
    return 0


def sources(arguments: list[str]) -> int:
    """1 where a source stayed incomplete; the same call resumes."""
    from kerbside.config import read_yaml
    from kerbside.sources import catalogue

    parser = argparse.ArgumentParser(prog="kerbside sources")
    parser.add_argument("catalogue")
    parser.add_argument("names", nargs="*")
    parser.add_argument("--all", action="store_true")
    given = parser.parse_args(arguments)
    known = catalogue.catalogue(read_yaml(given.catalogue))
    if not (given.names or given.all):
        print("\n".join(s.line() for s in known))
        return 0
    try:
        chosen = catalogue.selected(known, given.names, given.all)
    except ValueError as wrong:
        parser.error(str(wrong))
    made = catalogue.obtain(build_session(), chosen).collect()
    print("\n".join(f"{r.name}: {r.done} of {r.chunks} parts" for r in made))
    return int(any(r.done != r.chunks for r in made))


JOBS = {f.__name__: f for f in (convert, resplit, audit, complete, report, sources)}

if __name__ == "__main__":
    sys.exit(main())
