"""``python -m riftscan REPOSITORY [BRANCH_A [BRANCH_B]]``, or ``python -m riftscan --diff FILE``: risks as JSON lines."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from riftscan.errors import ScanError
from riftscan.operators import report
from riftscan.plans import analysis
from riftscan.sources import gitrepo


def main(args: list[str]) -> int:
    if not args or args[0] in ("-h", "--help") or (args[0] == "--diff" and len(args) != 2):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("riftscan").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if args[0] == "--diff":
            risks = analysis.analyze_security(gitrepo.read_diff_texts(spark, args[1]))
        else:
            risks = analysis.branch_risks(analysis.analyze_branches(spark, *args[:3])).drop("part")
        for line in report.nest(risks).toJSON().toLocalIterator():
            print(line)
    except ScanError as e:
        print(e.as_dict(), file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
