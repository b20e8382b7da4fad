"""``python -m quarrylane.refresh --data-dir DIR --out STORE --catalogue FILE``: bring the warehouse up to date with a directory of extracts.

Prints one line for each staged and each unrecognised file, then the months written and the rows of every table.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quarrylane.operators import warehouse
from quarrylane.session import session
from quarrylane.sources import stored


def run(spark: SparkSession, data_dir: str, out: str, catalogue: str) -> dict:
    """One refresh with the stored catalogue."""
    return warehouse.refresh(spark, data_dir, out, stored.catalogue(spark, catalogue))


def lines(report: dict) -> list[str]:
    found = [f"[staged] {path} ({s['dataset']}): {s['rows']:,} rows" for path, s in sorted(report["staged"].items())]
    found += [f"[unrecognised] {path}" for path in report["unrecognised"]]
    found += [f"{name}: months {', '.join(months)}" for name, months in sorted(report["months"].items()) if months]
    return [*found, f"version {report['version']}: " + (", ".join(f"{n} {c:,}" for n, c in sorted(report["rows"].items())) or "nothing changed")]


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data-dir", required=True, help="directory of CSV extracts")
    parser.add_argument("--out", required=True, help="folder of the warehouse's versions")
    parser.add_argument("--catalogue", required=True, help="the stored catalogue, a SQLite file")
    given = parser.parse_args(args)
    print("\n".join(lines(run(session(), given.data_dir, given.out, given.catalogue))))


if __name__ == "__main__":
    main()
