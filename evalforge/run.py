"""python -m evalforge.run QUERY SF_DIR [--out PATH] [--rows N]: run a registered query, show it or write it as Parquet."""

from __future__ import annotations

import argparse

from .plans import catalog
from .session import local_session


def main(argv: list[str] | None = None) -> int:
    known = catalog.queries()
    parser = argparse.ArgumentParser(prog="evalforge.run", description="Run a registered query over the tables of a folder.")
    parser.add_argument("query", choices=sorted(known), metavar="QUERY", help="one of: " + ", ".join(sorted(known)))
    parser.add_argument("tables", metavar="SF_DIR")
    parser.add_argument("--out", help="a folder to write Parquet to; else rows are shown")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    args = parser.parse_args(argv)
    result = known[args.query](local_session(), args.tables)
    if args.out:
        result.write.parquet(args.out)
    else:
        result.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
