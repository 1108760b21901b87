"""Jobs from the command line: `python -m rasterloom run job.json`, `check job.json`, `example`, `tags file...`."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import jobs


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rasterloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "check"):
        commands.add_parser(name).add_argument("config")
    commands.add_parser("example")
    commands.add_parser("tags").add_argument("files", nargs="+")
    known = parser.parse_args(arguments)
    if known.command == "example":
        print(json.dumps(jobs.EXAMPLE, indent=2))
        return 0
    if known.command == "tags":
        from .sources.tiff import tiff_tags

        for row in tiff_tags(SparkSession.builder.getOrCreate(), known.files).collect():
            print(json.dumps(row.asDict(), ensure_ascii=False))
        return 0
    with open(known.config, encoding="utf-8") as f:
        config = json.load(f)
    wrong = jobs.problems(config)
    for problem in wrong:
        print(problem)
    if wrong or known.command == "check":
        return int(bool(wrong))
    from .plans.slides import run_job

    print(run_job(SparkSession.builder.getOrCreate(), config))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
