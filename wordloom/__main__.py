"""python -m wordloom qualify|blockers|ablation|mantissas FOLDER [--form markdown|csv|json] [--out FILE]
python -m wordloom pack|verify FOLDER ARCHIVE; unpack ARCHIVE FOLDER; compare BASE TARGET"""

from __future__ import annotations

import argparse
import sys

from wordloom.plans import drivers


def main(arguments: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="wordloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("driver", choices=[*drivers.REPORTS, "pack", "verify", "unpack", "compare"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--form", choices=["markdown", "csv", "json"], default="markdown")
    parser.add_argument("--out")
    known = parser.parse_args(arguments)
    if len(known.paths) != (1 if known.driver in drivers.REPORTS else 2):
        parser.error(f"{known.driver} takes {1 if known.driver in drivers.REPORTS else 2} paths")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if known.driver in drivers.REPORTS:
        results = drivers.REPORTS[known.driver](spark, *known.paths)
    else:
        results = {known.driver: getattr(drivers, known.driver)(spark, *known.paths)}
    text = drivers.report(results, known.form)
    if known.out:
        with open(known.out, "w") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
