"""run: executes a mapping."""

from __future__ import annotations

import logging
import sys
import time

from kgspark import ship, sinks
from kgspark.commands import Command
from kgspark.plans.mapping import Mapping, Options

log = logging.getLogger(__name__)


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("kgspark").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    ship(spark)
    return spark


def run_mapping(path: str, output: str | None = None, explain: bool = False, explain_json: bool = False, strict: bool = False, options: Options | None = None) -> int:
    """To a folder, to one file (an output with an extension, unless it ends in '/'), or to standard output. Gives an exit code."""
    began = time.time()
    try:
        plan = Mapping.from_file(path, options).plan()
        if explain or explain_json:
            print(plan.explain_json() if explain_json else plan.explain())
            return 0
        result = plan.execute(session(), strict=strict)
        if output is None:
            for row in sinks.lines(result, "-.nq").toLocalIterator():
                print(row["line"])
        else:
            sinks.write(result, output.rstrip("/"), single_file=not output.endswith(("/", ".parquet")))
        log.info("done in %.1f s", time.time() - began)
        return 0
    except Exception as e:
        log.exception("the mapping failed")
        print(f"kgspark: {e}", file=sys.stderr)
        return 1


class Run(Command):
    name, help = "run", "execute a mapping file"

    def arguments(self, parser):
        parser.add_argument("-m", "--mapping", required=True, help="an RML or R2RML mapping in Turtle")
        parser.add_argument("-o", "--output", help="a file, a folder (ending in '/') or a .parquet folder; default: standard output")
        parser.add_argument("--explain", action="store_true", help="print the plan instead")
        parser.add_argument("--explain-json", action="store_true", help="print the plan as JSON instead")
        parser.add_argument("--strict", action="store_true", help="a reference without any value is an error")
        parser.add_argument("--tables", help="a folder of Parquet tables for logical tables")

    def run(self, args):
        return run_mapping(args.mapping, args.output, args.explain, args.explain_json, args.strict, Options(folder=args.tables))
